"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

Words are runs of letters and digits, in lower case. A word is the bag of its character n-grams (3 to 5, with word
ends), hashed into a fixed table, so an unseen misspelling shares vectors with the words it resembles. A window of
words is the mean of its words' vectors, and a softmax over two classes stands on that mean. As toxic words are few
in a long text, a text's score is that of its worst window, over every window of the whole text.

The layer on top is linear, so a trained model folds into one number per n-gram: that table, of a size fixed by
``bits``, is all that executors get.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lariat.llm.common import U64, mix, texts_of

_CHUNK = 400_000
_FACTOR = U64(0x2545F4914F6CDD1D)
_WORD = np.ones(1 << 16, bool)
_WORD[:128] = [chr(i).isalnum() for i in range(128)]
_WORD[[0x80, 0x85, 0xA0, 0x2028, 0x2029, 0x3000]] = False
_WORD[0x2000:0x2070] = False


@dataclass(frozen=True)
class Model:
    """weights: an n-gram's part of a window's margin, the mean over words of the mean over n-grams.

    A text's probability is the logistic of bias + scale * (the largest margin of its windows).
    """

    weights: np.ndarray
    bias: float
    scale: float
    window: int
    least: int


def _chunks(texts: list[str]):
    """(first, last) index of runs of texts of about _CHUNK characters."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= _CHUNK:
            yield at, i + 1
            at, size = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


def _bags(texts: list[str], bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(words per text, a hash per word, bucket per n-gram, word per n-gram)."""
    low = [t.lower() for t in texts]
    code = np.frombuffer(("\n" + "\n".join(low) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    inside = _WORD[np.minimum(code, 0xFFFF)]
    starts = inside[1:] & ~inside[:-1]
    number = np.cumsum(np.concatenate([[False], starts]))
    ends = np.cumsum([0] + [len(t) + 1 for t in low])
    per_text = np.diff(number[ends])
    n_words = int(number[-1])
    char = np.where(inside, code, 1).astype(U64)
    outside = np.concatenate([[0], np.cumsum(~inside)])
    buckets, words = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
    for n in (3, 4, 5):
        if len(char) < n:
            continue
        m = len(char) - n + 1
        ok = np.flatnonzero(outside[n - 1 : n - 1 + m] == outside[1 : 1 + m])
        h = char[ok] + U64(n)
        for j in range(1, n):
            h = h * _FACTOR + char[ok + j]
        buckets.append((mix(h) >> U64(64 - bits)).astype(np.int32))
        words.append((number[ok + 1] - 1).astype(np.int32))
    bucket, word = np.concatenate(buckets), np.concatenate(words)
    # A word's own hash is the sum of its mixed n-gram positions: enough to find equal words in the training sample.
    at = np.flatnonzero(np.concatenate([[False], starts]))
    own = np.zeros(n_words, U64)
    if n_words:
        place = np.arange(len(char)) - at[np.maximum(number - 1, 0)]
        own = np.add.reduceat(np.where(inside, mix(char * _FACTOR + place.astype(U64)), U64(0)), at)
    return per_text, own, bucket, word


def _windows(n: int, window: int) -> np.ndarray:
    """Lower ends of the windows of a text of n words."""
    return np.arange(max(1, n - window + 1))


def margins(texts: list[str], model: Model) -> np.ndarray:
    """The largest margin of each text's windows; 0 without words."""
    out = np.empty(len(texts))
    bits = int(len(model.weights)).bit_length() - 1
    for first, last in _chunks(texts):
        per_text, own, bucket, word = _bags(texts[first:last], bits)
        n = len(own)
        value = np.bincount(word, model.weights[bucket], n) / np.maximum(np.bincount(word, minlength=n), 1)
        total = np.concatenate([[0.0], np.cumsum(value)])
        at = np.concatenate([[0], np.cumsum(per_text)])
        for i in range(last - first):
            lo, k = at[i], per_text[i]
            begin = lo + _windows(k, model.window)
            width = min(k, model.window)
            out[first + i] = (total[begin + width] - total[begin]).max() / max(width, model.least)
    return out


def score_texts(texts: list[str], model: Model) -> np.ndarray:
    """Probability of the toxic class for each text; one without words has the bias alone."""
    return 1 / (1 + np.exp(-np.clip(model.bias + model.scale * margins(texts, model), -30, 30)))


def _calibrated(margin: np.ndarray, label: np.ndarray, prior: float) -> tuple[float, float]:
    """Bias and scale of a logistic on margins, by damped Newton steps; the classes weigh prior to 1 - prior."""
    shift, spread = float(margin.mean()), float(margin.std()) or 1.0
    x = np.stack([np.ones(len(margin)), (margin - shift) / spread], 1)
    weight = np.where(label == 1, prior / max((label == 1).sum(), 1), (1 - prior) / max((label == 0).sum(), 1)) * len(label)
    beta = np.array([np.log(prior / (1 - prior)), 1.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + 0.01 * np.eye(2), x.T @ (weight * (label - p)) - 0.01 * beta)
        beta += np.clip(step, -2, 2)
    return float(beta[0] - beta[1] * shift / spread), float(beta[1] / spread)


def train(texts: list[str], toxic: list[int], bits: int = 15, dim: int = 4, window: int = 3, least: int = 2, steps: int = 15, rate: float = 0.15, prior: float = 0.1, decay: float = 3e-6, seed: int = 7) -> Model:
    """Fit n-gram vectors and the softmax together, full batches under Adam.

    Windows of four times the width first take their text's label. Then, at the window's own width, a toxic text's
    windows count as toxic only near its best one by the model so far, and the others are left out; all windows of
    other texts stay negative.
    Every fourth text is kept out and calibrates the logistic on the largest margin, with prior as the share of
    toxic texts. Without both classes in either part the model answers that share.
    """
    base = Model(np.zeros(1 << bits, np.float32), float(np.log((np.mean(toxic) if len(toxic) else 0.0) + 1e-3)), 0.0, window, least)
    aside = np.arange(len(texts)) % 4 == 3
    all_texts, all_toxic = texts, np.asarray(toxic)
    texts, toxic = [x for x, a in zip(texts, aside) if not a], all_toxic[~aside] if len(texts) else []
    if not all({0, 1} == set(np.unique(y)) for y in (toxic, all_toxic[aside] if len(all_texts) else [])):
        return base
    per_text, own, refs, seen = [], [], [], np.zeros(0, U64)
    for first, last in _chunks(texts):
        n, o, b, w = _bags(texts[first:last], bits)
        per_text.append(n)
        own.append(o)
        uniq, where = np.unique(o, return_index=True)
        fresh = np.zeros(len(o), bool)
        fresh[where[~np.isin(uniq, seen)]] = True
        seen = np.union1d(seen, uniq)
        take = fresh[w]
        refs.append((o[w[take]], b[take]))
    if not len(seen):
        return base
    counts = np.concatenate(per_text)
    token = np.searchsorted(seen, np.concatenate(own)).astype(np.int32)
    ref_word = np.searchsorted(seen, np.concatenate([r[0] for r in refs])).astype(np.int32)
    ref_bucket = np.concatenate([r[1] for r in refs])
    del own, refs
    order = np.argsort(ref_word, kind="stable")
    ref_word, ref_bucket = ref_word[order], ref_bucket[order]
    word_at = np.searchsorted(ref_word, np.arange(len(seen)))
    word_n = np.bincount(ref_word, minlength=len(seen)).astype(np.float32)[:, None]
    text_of = np.repeat(np.arange(len(counts), dtype=np.int32), counts)
    place = (np.arange(len(token)) - np.repeat(np.cumsum(counts) - counts, counts)).astype(np.int32)
    by_word = np.argsort(token, kind="stable").astype(np.int32)
    token_at = np.searchsorted(token[by_word], np.arange(len(seen)))
    by_bucket = np.argsort(ref_bucket, kind="stable").astype(np.int32)
    used, bucket_at = np.unique(ref_bucket[by_bucket], return_index=True)
    word_by_bucket = ref_word[by_bucket]
    bucket_row = np.searchsorted(used, ref_bucket).astype(np.int32)

    rng = np.random.default_rng(seed)
    params = [rng.normal(0, 0.1, (len(used), dim)).astype(np.float32), rng.normal(0, 0.5, (dim, 2)).astype(np.float32), np.zeros(2, np.float32)]
    first_m, second_m, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0

    def forward():
        vectors = np.add.reduceat(params[0][bucket_row], word_at) / word_n
        mean = np.add.reduceat(vectors[token], cut) / win_n
        logits = mean @ params[1] + params[2]
        z = np.exp(logits - logits.max(1, keepdims=True))
        return mean, z / z.sum(1, keepdims=True)

    for phase, width in enumerate((4 * window, window, window)):
        # Disjoint windows; a text's last one may be shorter.
        cut = np.flatnonzero(place % width == 0)
        win_text = text_of[cut]
        win_of = np.repeat(np.arange(len(cut)), np.diff(np.append(cut, len(token)))).astype(np.int32)
        win_n = np.maximum(np.bincount(win_of, minlength=len(cut)), least).astype(np.float32)[:, None]
        label, win_by_word = toxic[win_text], win_of[by_word]
        weight = np.ones(len(cut), np.float32)
        if phase:
            p = forward()[1][:, 1]
            best = np.zeros(len(counts), np.float32)
            np.maximum.at(best, win_text, p)
            weight = np.where(label == 1, (p >= 0.5 * best[win_text]), 1).astype(np.float32)
        for c in (0, 1):
            weight[label == c] /= max(weight[label == c].sum(), 1)
        for _ in range(steps):
            mean, p = forward()
            d = p.astype(np.float32)
            d[np.arange(len(d)), label] -= 1
            d *= weight[:, None]
            d_mean = (d @ params[1].T) / win_n
            d_word = np.add.reduceat(d_mean[win_by_word], token_at) / word_n
            grads = [np.add.reduceat(d_word[word_by_bucket], bucket_at) + np.float32(decay) * params[0], mean.T @ d, d.sum(0)]
            t += 1
            for i, g in enumerate(grads):
                first_m[i] += 0.1 * (g - first_m[i])
                second_m[i] += 0.01 * (g * g - second_m[i])
                params[i] -= (rate * (0.2 if i else 1)) * (first_m[i] / (1 - 0.9**t)) / (np.sqrt(second_m[i] / (1 - 0.99**t)) + 1e-8)
    weights = np.zeros(1 << bits, np.float32)
    weights[used] = params[0] @ (params[1][:, 1] - params[1][:, 0])
    model = Model(weights, 0.0, 1.0, window, least)
    kept_out = [x for x, a in zip(all_texts, aside) if a]
    return Model(weights, *_calibrated(margins(kept_out, model), all_toxic[aside], prior), window, least)


def training_rows(documents: DataFrame, labels: DataFrame, per_class: int, learn: Column, longest: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_id, _text, _toxic) of at most per_class labelled rows of each class, the first by a hash of the id.

    The ids are at most 2 * per_class, so they may be broadcast against the documents. Null labels, null ids, repeated
    label rows and texts of more than ``longest`` characters are passed over: there are at most 2 * per_class * longest
    of them.
    """
    known = labels.select(F.col(id_col).alias("_id"), F.col("toxic").cast("int").alias("_toxic")).where(learn & F.col("_toxic").isin(0, 1)).dropDuplicates(["_id"])
    parts = [known.where(F.col("_toxic") == c).orderBy(F.xxhash64("_id"), "_id").limit(per_class) for c in (0, 1)]
    return documents.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).where(F.coalesce(F.length("_text"), F.lit(0)) <= longest).join(F.broadcast(parts[0].unionByName(parts[1])), "_id").orderBy("_id", "_text").limit(2 * per_class)


def fit(documents: DataFrame, labels: DataFrame, per_class: int = 1000, learn: Column | None = None, longest: int = 100_000, **options) -> Model:
    """Train on a bounded sample of labelled rows: per_class of each class, chosen by hash of the id.

    learn: a condition on ``_id`` for the rows that may be learned from. Texts of more than ``longest`` characters aren't
    learned from; they are scored whole like any other. Empty tables give a model that answers a small share.
    One task trains, and only the model comes to the driver.
    """
    rows = training_rows(documents, labels, per_class, F.lit(True) if learn is None else learn, longest)

    def trained(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sample = [r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("_id", "_text", "_toxic")))]
        sample.sort(key=lambda r: (r[0], r[1] is not None, (r[1] or "").encode()))  # as rows is ordered, however it comes
        model = train([t or "" for _, t, _ in sample], [y for _, _, y in sample], **options)
        yield pa.RecordBatch.from_pylist([{"weights": model.weights.tobytes(), "bias": model.bias, "scale": model.scale, "window": model.window, "least": model.least}])

    found = rows.coalesce(1).mapInArrow(trained, "weights binary, bias double, scale double, window long, least long").first()
    if found is None:  # no rows and so no task
        return train([], [], **options)
    return Model(np.frombuffer(found["weights"], np.float32), found["bias"], found["scale"], found["window"], found["least"])


def score(model: Model) -> "F.Column":
    """A column function: score(model)(text) is the probability of the toxic class, also for null and empty texts."""
    if model.weights.size > 1 << 20:
        raise ValueError("the n-gram table is broadcast with the function: at most 2**20 entries")

    @F.arrow_udf("double")
    def toxicity(text: pa.Array) -> pa.Array:
        return pa.array(score_texts(texts_of(text), model), pa.float64())

    return toxicity
