"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

A vocabulary of byte strings becomes a library model over characters: every byte has a printable character, and a
merge is listed for every split of a token into two tokens, in the order of the tokens' ranks, which is how merging by
ranks reads them. The library cuts texts by the pattern and maps bytes to characters. As the pattern always cuts at
the space before a word, a worker gives each distinct word to the library once while it remembers it. Offsets count
bytes of the text. Decoding turns each id back into its bytes by the reversed byte table; a character may be split
over several ids.
"""

from __future__ import annotations

import base64
import os
from functools import lru_cache

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
#: Words that a worker remembers in each of two generations, and the longest one it remembers.
REMEMBERED, LONGEST = 300_000, 48


@lru_cache(1)
def byte_characters() -> list[str]:
    """A printable character for each byte: itself where it is printable, else the next free one from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in set(shown) else chr(next(spare)) for b in range(256)]


class Remembering:
    """What a worker knows of words, for texts cut at their spaces.

    The pattern always cuts before a space that has no white space before it, or none after it. So a text's first part
    and each later part with its space stand alone, but for texts in which a space has white space after it, or that
    hold one of the strings in ``apart``: those go whole. ``joined`` answers for a list of parts, ``whole`` for one text;
    their answers are bytes, and a text's answer is its parts' one after the other.
    """

    def __init__(self, joined, whole, apart: tuple[str, ...] = ()) -> None:
        self.joined, self.whole, self.apart = joined, whole, apart
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.unsafe = {""}

    def answers(self, texts: list[str]) -> list[bytes]:
        if len(self.words) > REMEMBERED:
            self.older, self.words = self.words, {}
        if len(self.unsafe) > REMEMBERED:
            self.unsafe = {""}
        words, older, unsafe = self.words, self.older, self.unsafe
        parts = [t.split(" ") for t in texts]
        kinds = [set(p[1:]) for p in parts]
        missing = set().union(*kinds) - words.keys() - unsafe
        known = missing & older.keys()
        words.update((p, older[p]) for p in known)
        fresh = list(missing - known)
        unsafe.update([p for p in fresh if p[0].isspace()])
        fresh = [p for p in fresh if p not in unsafe]
        extra = {}
        for at in range(0, len(fresh), 10_000):
            some = fresh[at : at + 10_000]
            for p, a in zip(some, self.joined(some)):
                (words if len(p) <= LONGEST else extra)[p] = a
        out = []
        for text, own, kind in zip(texts, parts, kinds):
            if not kind.isdisjoint(unsafe) or any(s in text for s in self.apart):
                out.append(self.whole(text))
            elif extra and not kind.isdisjoint(extra):
                out.append(self.whole(own[0]) + b"".join([words[p] if p in words else extra[p] for p in own[1:]]))
            else:
                out.append(self.whole(own[0]) + b"".join(map(words.__getitem__, own[1:])))
        return out


def cut_by_bytes(ids: np.ndarray, lengths: np.ndarray, parts: list[str]) -> list[bytes]:
    """Ids of ' ' + part for each part, out of the ids of all of them in a row; lengths: bytes of each id."""
    ends = np.cumsum(lengths[ids])
    at = [0, *(np.searchsorted(ends, np.cumsum([len(p.encode()) + 1 for p in parts])) + 1).tolist()]
    raw = ids.astype("<u4").tobytes()
    return [raw[4 * a : 4 * b] for a, b in zip(at, at[1:])]


class ByteBPE:
    """Encoder and decoder for a rank file (base64 token, rank per line) and a pattern."""

    def __init__(self, path: str, pattern: str) -> None:
        from tokenizers import Regex, Tokenizer, pre_tokenizers
        from tokenizers.models import BPE

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        chars = byte_characters()
        shown = {t: "".join(chars[b] for b in t) for t in ranks}
        merges = [(shown[t[:i]], shown[t[i:]]) for t, _ in sorted(ranks.items(), key=lambda x: x[1]) for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        self.model = Tokenizer(BPE({shown[t]: i for t, i in ranks.items()}, merges))
        self.model.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        back = {c: i for i, c in enumerate(chars)}
        #: The reversed byte table applied to every entry of the library's vocabulary.
        self.bytes_of = {i: bytes(back[c] for c in t) for t, i in self.model.get_vocab(False).items()}
        self.cache = Remembering(self._joined, self._whole)
        lengths = np.zeros(max(self.bytes_of, default=-1) + 1, np.int64)
        lengths[list(self.bytes_of)] = [len(t) for t in self.bytes_of.values()]
        self.lengths, self.starts = lengths, np.cumsum(lengths) - lengths
        self.flat = np.frombuffer(b"".join(self.bytes_of.get(i, b"") for i in range(len(lengths))), np.uint8)

    def _whole(self, text: str) -> bytes:
        return np.array(self.model.encode(text, add_special_tokens=False).ids, "<u4").tobytes() if text else b""

    def _joined(self, parts: list[str]) -> list[bytes]:
        (found,) = self.model.encode_batch_fast([" " + " ".join(parts)], add_special_tokens=False)
        return cut_by_bytes(np.array(found.ids, np.int64), self.lengths, parts)

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts as little-endian unsigned 32-bit bytes."""
        return self.cache.answers(texts)

    def encode(self, text: str) -> tuple[list[int], list[tuple[int, int]]]:
        """Ids and the byte range of each in the text."""
        ids = self.model.encode(text, add_special_tokens=False).ids if text else []
        ends = np.cumsum(self.lengths[np.array(ids, np.int64)]).tolist()
        return ids, list(zip([0, *ends], ends))

    def decode_bytes(self, ids) -> bytes:
        """The bytes of ids; an id beyond the vocabulary raises IndexError."""
        ids = np.asarray(ids, np.int64)
        n = self.lengths[ids]
        return self.flat[np.repeat(self.starts[ids] - (np.cumsum(n) - n), n) + np.arange(n.sum())].tobytes()

    def decode(self, ids, errors: str = "replace") -> str:
        """The text of ids; characters cut at the ends are replaced, or raise with errors="strict"."""
        return self.decode_bytes(ids).decode("utf-8", errors)

    def pieces_of(self, ids) -> list[str]:
        """Text that each id completes: a character split over ids comes whole with its last one."""
        from codecs import getincrementaldecoder

        read = getincrementaldecoder("utf-8")("replace")
        return [read.decode(self.bytes_of[i]) for i in ids]


@lru_cache(2)
def codec(path: str, pattern: str) -> ByteBPE:
    """One codec for each worker process."""
    return ByteBPE(path, pattern)


class RankTokenizer:
    """The ids that a byte-level tokenizer file of the library gives, by tiktoken over the same vocabulary as ranks.

    Strings of the file's added tokens get their own id, as the library's default has it; a whole text with one goes
    to the library itself.
    """

    def __init__(self, path: str, ranks_path: str, pattern: str) -> None:
        import tiktoken
        from tokenizers import Tokenizer

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.library = Tokenizer.from_file(path)
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.apart = tuple(t.content for t in self.library.get_added_tokens_decoder().values())

    def encode(self, text: str) -> np.ndarray:
        if any(s in text for s in self.apart):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4")
        return self.encoding.encode_to_numpy(text, disallowed_special=()).astype("<u4")


@lru_cache(2)
def rank_tokenizer(path: str, ranks_path: str, pattern: str) -> RankTokenizer:
    return RankTokenizer(path, ranks_path, pattern)
