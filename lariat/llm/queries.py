"""The queries of this subpackage, each over its whole table, and their SQL where SQL can say it."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lariat.llm import byte_bpe, chat, jaccard, licenses, neardup, packing, piece_counts, quality, sharding, toxicity
from lariat.llm.common import map_batches, materialize, table, texts_of

#: A score from which a document is toxic.
TOXIC = 0.3


def held_out(id_col: str) -> F.Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per document: its score, whether it was held out of training, and the prediction. Null and empty texts have the
    score of a text without words; a null id isn't held out; an empty table gives no rows."""
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), learn=~held_out("_id"))
    scored = docs.select("doc_id", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"), toxicity.score(model)("text").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= TOXIC).cast("int"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per document: size, checksum, shard of 24 and slot. Equal, repeated and null ids spread as any; nulls are empty texts."""
    return sharding.shard(table(spark, sf_dir, "documents"), 24)


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per document: tokens, and digests of the ids and of what they decode to. A null text is an empty one."""
    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN

    def digest(b: pa.RecordBatch) -> pa.RecordBatch:
        codec = byte_bpe.codec(path, pattern)
        ids = codec.encode_batch(texts_of(b.column("text")))
        back = [codec.decode_bytes(np.frombuffer(x, "<u4")) for x in ids]
        return pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in ids]), pa.array([hashlib.sha256(x).hexdigest() for x in back])], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_batches(table(spark, sf_dir, "documents").select("doc_id", "text"), digest, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per document: bytes and tokens, and whether they are over the limit. A null text is an empty one."""
    return piece_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per conversation, and one for a made conversation -7, read back from the formatted string."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = F.lit("\\### Assistant: </turn> ok")
    extra = spark.range(2).select(F.lit(-7).cast(rows.schema["conv_id"].dataType).alias("conv_id"), F.col("id").cast(rows.schema["turn"].dataType).alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"))
    back = chat.read_back(chat.format_chats(rows.unionByName(extra)))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"), F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


def op6_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per vector: links, component and whether it is kept; see ``near_duplicates`` for nulls and odd vectors."""
    return neardup.near_duplicates(table(spark, sf_dir, "embeddings"), 0.98)


def op7_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per document: shingles and component; see ``similar_components`` for nulls, short texts and repeated ids."""
    return jaccard.similar_components(table(spark, sf_dir, "documents"), 4, 85, 100)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per piece of a document: its ids' checksum, sequence and place. A null or empty text is its end id alone."""
    pieces = packing.pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return packing.pack(pieces, 1024)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per document: counts, whether it fails the fixed rules and whether it is kept. A null text has no words and fails."""
    stats = materialize(quality.statistics(table(spark, sf_dir, "documents")), "statistics")
    rules = quality.fit(stats, table(spark, sf_dir, "labels"))
    judged = stats.withColumn("base_failed", quality.base_failed())
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.when(F.col("base_failed"), F.lit(False)).otherwise(quality.verdict(rules)).alias("kept"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per document: words, base phrases, labels and score, see ``licenses.scan``. A null text has none."""
    return licenses.scan(table(spark, sf_dir, "documents")).drop("detections")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    return {f.__name__: f for f in (op1_toxicity, op2_sharding, op3_byte_bpe, op4_token_counts, op5_chat, op6_neardup, op7_jaccard, op8_packing, op9_quality, op10_licenses)} | {"pipeline": corpus_pipeline.run}


_CHAT = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), marked AS (
  SELECT *, coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) <> role, true) AS opens,
    length(replace(replace(replace(replace(text, '\', '\b'), '###', '\h'), '</turn>', '\t'), '</part>', '\p')) AS escaped
  FROM rows
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(escaped + CASE WHEN opens THEN length('### ') + length(role) + length(': ') + length('</turn>') + 1 ELSE length('</part>') END) AS BIGINT) AS formatted_chars
FROM marked GROUP BY conv_id
"""


_LINKED = """
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least_of AS (SELECT a, min(b) AS m FROM reach GROUP BY a)
"""
_NEARDUP = f"""
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ok AS (SELECT * FROM v WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND list_max(list_transform(e, lambda c: abs(c))) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
{_LINKED}, degree AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(m, vec_id)) AS component_id, vec_id <= coalesce(m, vec_id) AS kept
FROM v LEFT JOIN degree d ON vec_id = d.a LEFT JOIN least_of l ON vec_id = l.a
"""
_JACCARD = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3]) END) AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b USING (shingle) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * k >= 85 * (x.n + y.n - k)),
{_LINKED}
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) AS component_id
FROM documents d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN least_of l ON d.doc_id = l.a
"""


def oracle_sql() -> dict[str, str]:
    return {"op5_chat": _CHAT, "op6_neardup": _NEARDUP, "op7_jaccard": _JACCARD}
