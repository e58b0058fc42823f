"""Quality rules: learned decision lists over word statistics.

Sequential covering on labelled statistics: a rule grows by the threshold condition with the best information gain
on two thirds of the sample and is pruned on the rest; the documents that it covers leave the sample and the next
rule follows, until a rule is not precise enough. The ordered rules become one conditional Spark expression.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lariat.llm.common import bytes_of, map_batches, shingle_hashes, word_hashes

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_MARK = np.zeros(256, bool)
_MARK[list(b"!\"'()+,-./:;=?@[]\\^_`{}~")] = True
_CODE_POINT = (np.arange(256) & 0xC0) != 0x80
_UPPER = np.isin(np.arange(256), np.arange(65, 91))
_DIGIT = np.isin(np.arange(256), np.arange(48, 58))

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct_words", "n_marks", "n_upper", "n_digits", "max_word_bytes", "n_top_word"]
#: What the rules see: the numerator and the denominator of each.
RATIOS = {
    "words": ("n_words", None), "word_length": ("word_chars", "n_words"), "symbols": ("n_symbols", "n_words"), "dup_lines": ("n_dup_lines", "n_lines"), "repeats": ("n_repeat_words", "n_words"),
    "distinct": ("n_distinct_words", "n_words"), "marks": ("n_marks", "n_words"), "upper": ("n_upper", "word_chars"), "digits": ("n_digits", "word_chars"), "longest": ("max_word_bytes", None), "line_words": ("n_words", "n_lines"), "top_word": ("n_top_word", "n_words"),
}
Rule = list[tuple[str, str, float]]


def text_counts(text: bytes) -> tuple[int, ...]:
    """COUNTS of one whole text."""
    words, start, end = word_hashes(text)
    n = len(words)
    if n == 0:
        return (0,) * len(COUNTS)
    raw = np.frombuffer(text, np.uint8)
    points = np.concatenate([[0], np.cumsum(_CODE_POINT[raw])])
    lines = [x for x in text.split(b"\n") if x.strip(b" \t\n\v\f\r")]
    repeated = 0
    if n >= 5:
        windows = shingle_hashes(words, 5)
        _, back, seen = np.unique(windows, return_inverse=True, return_counts=True)
        if (seen > 1).any():
            cover = np.zeros(n + 1, np.int64)
            twice = np.flatnonzero(seen[back] > 1)
            np.add.at(cover, twice, 1)
            np.add.at(cover, twice + 5, -1)
            repeated = int((np.cumsum(cover)[:n] > 0).sum())
    _, often = np.unique(words, return_counts=True)
    return (n, int((points[end] - points[start]).sum()), int(_SYMBOL[raw].sum()), len(lines) - len(set(lines)), repeated, len(lines), len(often), int(_MARK[raw].sum()), int(_UPPER[raw].sum()), int(_DIGIT[raw].sum()), int((end - start).max()), int(often.max()))


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: the id and COUNTS; null and empty texts count nothing. Other columns are not carried."""
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"))

    def count(b: pa.RecordBatch) -> pa.RecordBatch:
        rows = np.array([text_counts(t) for t in bytes_of(b.column("_text"))], np.int64).reshape(-1, len(COUNTS))
        return pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(rows[:, i]) for i in range(len(COUNTS)))], ["doc_id", *COUNTS])

    return map_batches(narrow, count, f"doc_id {narrow.schema['doc_id'].dataType.simpleString()}, " + ", ".join(f"{c} long" for c in COUNTS))


def count_columns(text: Column) -> Column:
    """COUNTS as a struct column, where the other columns of a row must stay."""

    @F.arrow_udf("struct<" + ",".join(f"{c}:bigint" for c in COUNTS) + ">")
    def counts(column: pa.Array) -> pa.Array:
        rows = np.array([text_counts(t) for t in bytes_of(column)], np.int64).reshape(-1, len(COUNTS))
        return pa.StructArray.from_arrays([pa.array(rows[:, i]) for i in range(len(COUNTS))], COUNTS)

    return counts(text)


def base_failed(at: str = "") -> Column:
    """The fixed rules: fewer than 10 words, or over a fifth of the words in repeated 5-word windows."""
    c = lambda name: F.col(f"{at}{name}")
    return (c("n_words") < 10) | (100 * c("n_repeat_words") > 20 * c("n_words"))


def ratios(at: str = "") -> dict[str, Column]:
    c = lambda name: F.col(f"{at}{name}").cast("double")
    return {k: c(a) / F.greatest(c(b), F.lit(1.0)) if b else c(a) for k, (a, b) in RATIOS.items()}


def _holds(rule: Rule, x: dict[str, np.ndarray], n: int) -> np.ndarray:
    out = np.ones(n, bool)
    for name, op, limit in rule:
        out &= x[name] > limit if op == ">" else x[name] <= limit
    return out


def _grow(x: dict[str, np.ndarray], bad: np.ndarray, conditions: int, cuts: int) -> Rule:
    """Add the condition of the best information gain until no good document is covered or nothing gains."""
    rule: Rule = []
    inside = np.ones(len(bad), bool)
    while len(rule) < conditions and (~bad[inside]).any():
        p, n = bad[inside].sum(), inside.sum()
        now, best = np.log2(max(p, 1e-9) / n), (0.0, None)
        for name, v in x.items():
            at = np.unique(np.quantile(v[inside], np.linspace(0, 1, cuts)))
            for limit in (at[:-1] + at[1:]) / 2:  # half-way, so that a rule keeps its distance from both sides
                for op, holds in ((">", v > limit), ("<=", v <= limit)):
                    held = inside & holds
                    q, m = bad[held].sum(), held.sum()
                    if q and m < n and (gain := q * (np.log2(q / m) - now)) > best[0] + 1e-9:
                        best = (gain, (name, op, float(limit)))
        if best[1] is None:
            break
        rule.append(best[1])
        inside &= _holds([best[1]], x, len(bad))
    return rule


def learn(rows: np.ndarray, bad: np.ndarray, precision: float = 0.9, conditions: int = 4, rules: int = 24, cuts: int = 24, least: int = 5, seed: int = 7) -> list[Rule]:
    """Ordered rules that find bad documents. rows: RATIOS by column; bad: booleans.

    A rule is kept if at least ``precision`` of the sample's documents that it newly covers are bad, and at least
    ``least`` of them; the first that fails ends the list. Without both kinds of documents there are no rules.
    """
    found: list[Rule] = []
    x = {name: rows[:, i] for i, name in enumerate(RATIOS)}
    left = np.ones(len(bad), bool)
    rng = np.random.default_rng(seed)
    while len(found) < rules and bad[left].sum() >= least and (~bad[left]).any():
        grow = left & (rng.random(len(bad)) < 2 / 3)
        check = left & ~grow
        rule = _grow({k: v[grow] for k, v in x.items()}, bad[grow], conditions, cuts)
        if not rule:
            break
        xs, ys = {k: v[check] for k, v in x.items()}, bad[check]

        def worth(r: Rule) -> float:
            held = _holds(r, xs, len(ys))
            return (ys[held].sum() - (~ys[held]).sum()) / max(held.sum(), 1) if r else -1.0

        while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
            rule = rule[:-1]
        held = _holds(rule, x, len(bad)) & left
        if held.sum() < least or bad[held].mean() < precision:
            break
        found.append(rule)
        left &= ~held
    return found


def verdict(rules: list[Rule], at: str = "") -> Column:
    """The decision list as an ordered conditional expression: true if the document stays."""
    r = ratios(at)
    out = None
    for rule in rules:
        condition = reduce(lambda a, b: a & b, [r[n] > v if op == ">" else r[n] <= v for n, op, v in rule])
        out = F.when(condition, F.lit(False)) if out is None else out.when(condition, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def known_labels(labels: DataFrame, most: int = 20_000) -> DataFrame:
    """(_id, _quality) of at most ``most`` labelled ids, the first by hash; null ids and labels are passed over."""
    return labels.select(F.col("doc_id").alias("_id"), F.col("quality").cast("int").alias("_quality")).where(F.col("_id").isNotNull() & F.col("_quality").isin(0, 1)).dropDuplicates(["_id"]).orderBy(F.xxhash64("_id"), "_id").limit(most)


def labelled(docs: DataFrame, labels: DataFrame, most: int = 20_000, id_col: str = "doc_id") -> DataFrame:
    """The rows of docs that ``fit`` may learn from, so that only those need be counted for it."""
    return docs.join(F.broadcast(known_labels(labels, most).select(F.col("_id").alias(id_col))), id_col, "left_semi")


def fit(stats: DataFrame, labels: DataFrame, most: int = 20_000, **options) -> list[Rule]:
    """Learn from at most ``most`` labelled documents that pass the fixed rules, the first by hash of the id.

    stats: the result of ``statistics``, of all documents or of those ``labelled``. Without any there are no rules.
    """
    known = known_labels(labels, most)
    sample = stats.where(~base_failed()).join(F.broadcast(known), F.col("doc_id") == F.col("_id")).orderBy("doc_id").limit(most)
    rows = sample.select("_quality", *(c.alias(k) for k, c in ratios().items())).toPandas()
    return learn(rows[list(RATIOS)].to_numpy(float), rows["_quality"].to_numpy() == 0, **options)
