"""Token counts by rank-synchronous array merging.

Texts become characters in one flat array, cut before every run of spaces (no piece has a space after another
character, so no merge crosses there). The distinct words of a batch are a ragged array of symbols. In each round every
word's lowest-ranked neighbouring pair is merged, in all words at once; words without a pair left drop out and count
their symbols. All places of the pair in a word merge together from the left, where no pair with the merged piece can
rank lower than the piece itself; otherwise only the first does. That is the order of merging by score.
Characters outside the vocabulary count as their UTF-8 bytes.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lariat.llm.common import U64, configure, mix, texts_of

_NONE = np.int32(2**31 - 1)
_SPACE = 0x2581
_GROUP = 600_000


def _fields(raw: bytes) -> dict[int, list[int | bytes]]:
    """The fields of a protocol buffer message by number: numbers, or bytes of strings and messages."""
    out: dict[int, list[int | bytes]] = {}
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(raw):
        key = number()
        if key & 7 == 0:
            value: int | bytes = number()
        else:
            n = number() if key & 7 == 2 else 8 if key & 7 == 1 else 4
            value, at = raw[at : at + n], at + n
        out.setdefault(key >> 3, []).append(value)
    return out


def check_settings(model: bytes) -> None:
    """Raises unless a serialized model is what the merging here assumes.

    That is BPE with byte fallback, texts as they are (no character map, spaces kept and escaped), and a space in front.
    """
    fields = _fields(model)
    trainer, normalizer = (_fields(fields[i][-1]) if i in fields else {} for i in (2, 3))
    last = lambda group, field, default: group.get(field, [default])[-1]
    wrong = [
        name
        for name, found, wanted in (
            ("model type", last(trainer, 3, 1), 2), ("byte fallback", last(trainer, 35, 0), 1), ("character map", last(normalizer, 2, b""), b""),
            ("space in front", last(normalizer, 3, 1), 1), ("extra spaces removed", last(normalizer, 4, 1), 0), ("spaces escaped", last(normalizer, 5, 1), 1), ("space at the end", last(trainer, 24, 0), 0),
        )
        if found != wanted
    ]
    if wrong:
        raise ValueError(f"the model's settings aren't supported: {', '.join(wrong)}")


class Vocabulary:
    """Pieces, ranks and merges of a sentencepiece BPE model with byte fallback."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        check_settings(sp.serialized_model_proto())
        n = sp.get_piece_size()
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
        by_score = sorted(plain, key=lambda i: (-sp.get_score(i), i))
        pieces = [sp.id_to_piece(i) for i in by_score]  # a piece's number is its rank from here on
        number = {p: i for i, p in enumerate(pieces)}
        if any(a != "▁" and b == "▁" for p in pieces for a, b in zip(p, p[1:])):
            raise ValueError("pieces with a space inside aren't supported")
        #: Characters that are no piece get a number each when they stand in a longer piece, after all pieces.
        self.symbol = np.full(0x110000, -1, np.int32)
        extra: dict[str, int] = {}
        for p in pieces:
            for c in p:
                self.symbol[ord(c)] = number[c] if c in number else extra.setdefault(c, len(pieces) + len(extra))
        self.n_pieces = len(pieces)
        known = number | extra
        left, right, merged = [], [], []
        for p, i in number.items():
            for at in range(1, len(p)):
                a, b = known.get(p[:at]), known.get(p[at:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    merged.append(i)
        self.width = len(known) + 1
        left, right, merged = np.array(left, np.int64), np.array(right, np.int64), np.array(merged, np.int32)
        #: Pieces with which a pair may rank lower than they do.
        self.unsafe = np.zeros(self.width, bool)
        self.unsafe[left[merged < left]] = True
        self.unsafe[right[merged < right]] = True
        keys = left * self.width + right
        bits = max(4, int(len(keys) * 6).bit_length())
        self.shift = U64(64 - bits)
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, _NONE, np.int32)
        place = self._place(keys)
        todo = np.arange(len(keys))
        while len(todo):
            slot = place[todo]
            free = self.keys[slot] < 0
            _, first = np.unique(slot, return_index=True)
            won = np.zeros(len(todo), bool)
            won[first] = True
            won &= free
            self.keys[slot[won]], self.values[slot[won]] = keys[todo[won]], merged[todo[won]]
            todo = todo[~won]
            place[todo] = (place[todo] + 1) & ((1 << bits) - 1)
        self.mask = (1 << bits) - 1

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(U64) * U64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def merged(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The piece that a and b make, _NONE if there is none; symbols under 0 are in no piece."""
        keys = a.astype(np.int64) * self.width + b
        out = np.full(len(keys), _NONE, np.int32)
        todo = np.flatnonzero((a >= 0) & (b >= 0))
        place = self._place(keys[todo])
        while len(todo):
            found = self.keys[place]
            same = found == keys[todo]
            out[todo[same]] = self.values[place[same]]
            go = ~same & (found >= 0)
            todo, place = todo[go], (place[go] + 1) & self.mask
        return out

    def count_words(self, sym: np.ndarray, cost: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Tokens of each word of a ragged array; starts: each word's first place. cost: of a symbol outside the vocabulary."""
        n = len(starts)
        total = np.zeros(n, np.int64)
        if not n:
            return total
        word = np.repeat(np.arange(n), np.diff(np.append(starts, len(sym))))
        last = np.zeros(len(sym), bool)
        last[np.append(starts[1:], len(sym)) - 1] = True
        rank = np.full(len(sym), _NONE, np.int32)
        rank[:-1] = self.merged(sym[:-1], sym[1:])
        rank[last] = _NONE
        while True:
            begin = np.flatnonzero(np.diff(word, prepend=-1))
            low = np.minimum.reduceat(rank, begin) if len(begin) else np.zeros(0, np.int32)
            own = np.repeat(low, np.diff(np.append(begin, len(sym))))
            done = own == _NONE
            if done.any():
                outside = (sym[done] < 0) | (sym[done] >= self.n_pieces)
                total += np.bincount(word[done], np.where(outside, cost[done], 1), n).astype(np.int64)
                go = ~done
                sym, cost, word, rank, own = sym[go], cost[go], word[go], rank[go], own[go]
            if not len(sym):
                return total
            at = np.flatnonzero(rank == own)
            run = np.flatnonzero(np.diff(at, prepend=-2) != 1)
            odd = (np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))) % 2 == 1
            first = np.diff(word[at], prepend=-1) != 0
            at = at[np.where(self.unsafe[own[at]], first, ~odd)]
            sym[at] = own[at]
            rank[at] = rank[at + 1]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            moved = at - np.arange(len(at))
            # After a deletion the pair to the right is new unless the word ends there; so is the one to the left.
            sym, cost, word, rank = sym[keep], cost[keep], word[keep], rank[keep]
            near = np.unique(np.concatenate([moved, moved[moved > 0] - 1]))
            near = near[near < len(sym) - 1]
            joined = word[near] == word[near + 1]
            rank[near[~joined]] = _NONE
            near = near[joined]
            rank[near] = self.merged(sym[near], sym[near + 1])

    def counts(self, texts: list[str]) -> list[int]:
        """Tokens of each whole text."""
        out = [0] * len(texts)
        full = [i for i, t in enumerate(texts) if t]
        if not full:
            return out
        code = np.frombuffer("".join(["▁" + texts[i] for i in full]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        code[code == 32] = _SPACE
        begin = np.concatenate([[0], np.cumsum([len(texts[i]) + 1 for i in full])])
        space = code == _SPACE
        starts = space.copy()
        starts[1:] &= ~space[:-1]
        starts[begin[:-1]] = True
        starts = np.flatnonzero(starts)
        ends = np.append(starts[1:], len(code))
        power = np.full(len(code) + 1, 0x5851F42D4C957F2D, U64)
        power[0] = 1
        np.multiply.accumulate(power, out=power)
        inverse = np.full(len(code) + 1, pow(0x5851F42D4C957F2D, -1, 1 << 64), U64)
        inverse[0] = 1
        np.multiply.accumulate(inverse, out=inverse)
        total = np.concatenate([np.zeros(1, U64), np.cumsum(mix(code.astype(U64) + U64(1)) * power[:-1])])
        key = (total[ends] - total[starts]) * inverse[starts] + mix((ends - starts).astype(U64))
        _, first, back = np.unique(key, return_index=True, return_inverse=True)
        lengths = (ends - starts)[first]
        inner = np.cumsum(lengths) - lengths
        chars = code[np.repeat(starts[first] - inner, lengths) + np.arange(lengths.sum())]
        cost = 1 + (chars >= 0x80).astype(np.int64) + (chars >= 0x800) + (chars >= 0x10000)
        per_word = self.count_words(self.symbol[chars], cost, inner)[back]
        sums = np.concatenate([[0], np.cumsum(per_word)])
        at = np.searchsorted(starts, begin)
        for i, k in zip(full, (sums[at[1:]] - sums[at[:-1]]).tolist()):
            out[i] = k
        return out


@lru_cache(2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def token_counts(docs: DataFrame, path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) per row of docs, over whole texts; null and empty texts have no tokens.

    No begin or end token is counted and the strings of control pieces are ordinary text. Null ids and repeated rows
    stay as they are; other columns are not carried; an empty table gives no rows.
    """
    configure(docs.sparkSession)
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"))

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for b in batches:
            texts = texts_of(b.column("_text"))
            tokens: list[int] = []
            at = size = 0
            for i, t in enumerate(texts):
                size += len(t)
                if size >= _GROUP or i == len(texts) - 1:
                    tokens += v.counts(texts[at : i + 1])
                    at, size = i + 1, 0
            n = np.array(tokens, np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return narrow.mapInArrow(count, f"doc_id {narrow.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean")
