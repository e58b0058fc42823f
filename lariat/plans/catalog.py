"""Queries over the driver's tables: one for each operator that SQL can hold against them, with that SQL.

Genes are nations, reads are orders and nodes are line numbers, so a read's path is the line numbers of an order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lariat.functions import sequence as S
from lariat.functions.beta import interval
from lariat.functions.partitions import dealt
from lariat.operators import bias, events, graph, kmers, posterior, quant
from lariat.operators import counts as C
from lariat.operators import transcripts as T
from lariat.sinks import tables
from lariat.sources import alignments, text


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customers = (_table(spark, sf_dir, t) for t in ("orders", "customer"))
    # Reads meet their genes first; lines, which are many more, are dealt out once, by read.
    reads = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_nationkey").alias("gene"), F.col("o_orderkey").alias("read"))
    lines = dealt(_table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("read"), F.col("l_linenumber").alias("node"), F.col("l_partkey").alias("at")), "read")
    return lines.join(reads, "read").select("gene", "read", "node", "at")


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.paths(_placed(spark, sf_dir))


_HITS = """hits AS (SELECT DISTINCT c_nationkey AS gene, l_orderkey AS read, l_linenumber AS node
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey),
paths AS (SELECT gene, read, list(node ORDER BY node) AS path, string_agg(CAST(node AS VARCHAR), '-' ORDER BY node) AS name, count(*) AS len FROM hits GROUP BY gene, read),
steps AS (SELECT gene, node AS l, lead(node) OVER (PARTITION BY gene, read ORDER BY node) AS r FROM hits),
edges AS (SELECT gene, l, r, count(*) AS n FROM steps WHERE r IS NOT NULL GROUP BY gene, l, r)"""
_ANNO = """named AS (SELECT gene, name, any_value(path) AS path, count(*) AS n FROM paths GROUP BY gene, name),
anno AS (SELECT * FROM (SELECT gene, name, path, CAST(row_number() OVER (PARTITION BY gene ORDER BY n DESC, name) AS INTEGER) AS tx FROM named) WHERE tx <= 8)"""
_CLASSES = """hit AS (SELECT p.gene, p.name, p.n, string_agg(CAST(tx AS VARCHAR), ',' ORDER BY tx) AS class FROM named p JOIN anno a ON p.gene = a.gene AND contains('-' || a.name || '-', '-' || p.name || '-') GROUP BY ALL),
classes AS (SELECT gene, class, CAST(sum(n) AS BIGINT) AS n FROM hit GROUP BY gene, class)"""
_PSI = """touched AS (SELECT gene, l, r, n, unnest(range(l, r + 1)) AS node FROM edges),
sums AS (SELECT gene, CAST(node AS INTEGER) AS node, CAST(coalesce(sum(n) FILTER (WHERE node IN (l, r)), 0) AS BIGINT) AS inclusion, CAST(coalesce(sum(n) FILTER (WHERE node NOT IN (l, r)), 0) AS BIGINT) AS exclusion,
  count(*) FILTER (WHERE node IN (l, r)) AS ni, count(*) FILTER (WHERE node NOT IN (l, r)) AS ne FROM touched GROUP BY gene, node)"""

_QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def _query(sql: str | None):
    def register(f):
        _QUERIES[f.__name__] = (f, sql)
        return f

    return register


@_query(f"""WITH {_HITS}, {_PSI} SELECT gene, node, inclusion, exclusion,
  CASE WHEN inclusion > 0 AND exclusion > 0 THEN round((inclusion / ni) / (inclusion / ni + exclusion / ne), 6) WHEN exclusion = 0 AND inclusion >= 2 THEN 1.0 WHEN inclusion = 0 AND exclusion >= 1 THEN 0.0 END AS psi,
  inclusion + exclusion AS total_reads FROM sums""")
def psi_nodes(spark, sf_dir):
    return C.node_psi(C.edge_counts(_paths(spark, sf_dir)))


@_query(f"WITH {_HITS} SELECT gene, path[1] AS node, count(*) AS n FROM paths WHERE len = 1 GROUP BY ALL")
def node_counts(spark, sf_dir):
    return C.node_counts(_paths(spark, sf_dir))


@_query(f"WITH {_HITS} SELECT * FROM edges")
def edge_counts(spark, sf_dir):
    return C.edge_counts(_paths(spark, sf_dir))


@_query(f"WITH {_HITS} SELECT gene, name AS path, count(*) AS n FROM paths WHERE len > 2 GROUP BY gene, name")
def long_path_counts(spark, sf_dir):
    return C.long_path_counts(_paths(spark, sf_dir))


@_query("""WITH placed AS (SELECT c_nationkey AS gene, l_orderkey AS read, l_linenumber AS node, l_partkey AS place FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey),
steps AS (SELECT gene, node AS l, lead(node) OVER (PARTITION BY gene, read ORDER BY place, node) AS r FROM placed) SELECT gene, l, r, count(*) AS n FROM steps WHERE l >= r GROUP BY ALL""")
def circ_counts(spark, sf_dir):
    return C.back_steps(_placed(spark, sf_dir))


@_query(f"WITH {_HITS}, top AS (SELECT gene, max(n) AS top FROM edges GROUP BY gene) SELECT e.* FROM edges e JOIN top USING (gene) WHERE n >= top * 0.02")
def minor_edge_filter(spark, sf_dir):
    return C.minor_steps_dropped(C.edge_counts(_paths(spark, sf_dir)))


@_query(f"WITH {_HITS}, p AS (SELECT gene, n / sum(n) OVER (PARTITION BY gene) AS p FROM edges) SELECT gene, CAST(ceil(log2(count(*))) AS BIGINT) AS complexity, round(-sum(p * log2(p)), 6) AS entropy FROM p GROUP BY gene")
def complexity_entropy(spark, sf_dir):
    return C.step_entropy(C.edge_counts(_paths(spark, sf_dir)))


@_query(f"WITH {_HITS}, {_ANNO}, {_CLASSES} SELECT * FROM classes")
def equivalence_classes(spark, sf_dir):
    p = _paths(spark, sf_dir)
    return C.compatible(p, C.annotated_paths(p))


def _lengths(p: DataFrame) -> DataFrame:
    # A node's length is ten times its number.
    return C.annotated_paths(p).select("gene", "tx", F.aggregate("nodes", F.lit(0).cast("long"), lambda a, x: a + 10 * x).alias("length"))


_LENGTHS = "lengths AS (SELECT gene, tx, CAST(10 * list_sum(path) AS BIGINT) AS length FROM anno)"
_UNIQUE = "uniq AS (SELECT gene, CAST(class AS INTEGER) AS tx, n AS count FROM classes WHERE NOT contains(class, ','))"
_TPM = "rated AS (SELECT l.gene, l.tx, l.length, coalesce(u.count, 0) AS count, coalesce(u.count, 0) / greatest(length - 1, 1) AS rate FROM lengths l LEFT JOIN uniq u USING (gene, tx)), tpm AS (SELECT gene, tx, length, count, round(1e6 * rate / greatest((SELECT sum(rate) FROM rated), 1), 1) AS tpm FROM rated)"


@_query(f"WITH {_HITS}, {_ANNO}, {_LENGTHS} SELECT * FROM lengths")
def isoform_length(spark, sf_dir):
    return _lengths(_paths(spark, sf_dir))


def _tpm(p: DataFrame) -> DataFrame:
    unique = C.compatible(p, C.annotated_paths(p)).where(~F.contains("class", F.lit(","))).select("gene", F.col("class").cast("int").alias("tx"), F.col("n").alias("count"))
    return C.tpm(_lengths(p).join(unique, ["gene", "tx"], "left").withColumn("count", F.coalesce("count", F.lit(0).cast("long"))))


@_query(f"WITH {_HITS}, {_ANNO}, {_CLASSES}, {_LENGTHS}, {_UNIQUE}, {_TPM} SELECT * FROM tpm")
def tpm_initial(spark, sf_dir):
    return _tpm(_paths(spark, sf_dir))


@_query(f"WITH {_HITS}, {_ANNO}, {_CLASSES}, {_LENGTHS}, {_UNIQUE}, {_TPM} SELECT gene, round(sum(tpm), 1) AS tpm FROM tpm GROUP BY gene")
def gene_tpm(spark, sf_dir):
    return _tpm(_paths(spark, sf_dir)).groupBy("gene").agg(F.round(F.sum("tpm"), 1).alias("tpm"))


@_query(f"""WITH RECURSIVE {_HITS}, {_ANNO}, {_CLASSES}, members AS (SELECT gene, class, n, CAST(unnest(string_split(class, ',')) AS INTEGER) AS tx FROM classes),
em AS (SELECT 0 AS it, gene, tx, 1.0::DOUBLE AS c FROM (SELECT DISTINCT gene, tx FROM members)
  UNION ALL SELECT it, gene, tx, sum(share) AS c FROM (SELECT e.it + 1 AS it, m.gene, m.tx, m.n * e.c / sum(e.c) OVER (PARTITION BY m.gene, m.class) AS share FROM members m JOIN em e ON m.gene = e.gene AND m.tx = e.tx WHERE e.it < 20) GROUP BY it, gene, tx)
SELECT gene, tx, round(c, 3) AS count FROM em WHERE it = 20""")
def isoform_em(spark, sf_dir):
    p = _paths(spark, sf_dir)
    return C.em_shares(C.compatible(p, C.annotated_paths(p)), 20).withColumn("count", F.round("count", 3))


@_query(f"""WITH {_HITS}, {_ANNO}, seen AS (SELECT e.gene, l, r, e.n, bool_or(coalesce(contains('-' || a.name || '-', '-' || l || '-' || r || '-'), false)) AS seen_any,
  bool_and(contains('-' || a.name || '-', '-' || l || '-' || r || '-')) FILTER (WHERE a.path[1] <= l AND a.path[-1] >= r) AS every FROM edges e LEFT JOIN anno a USING (gene) GROUP BY ALL)
SELECT gene, l, r, n, CASE WHEN seen_any AND coalesce(every, false) THEN 'CON_ANNO' WHEN seen_any THEN 'ALT_ANNO' ELSE 'ALT_UNIQ' END AS class FROM seen""")
def junction_class(spark, sf_dir):
    p = _paths(spark, sf_dir)
    return C.junction_classes(C.edge_counts(p), C.annotated_paths(p))


@_query(f"""WITH {_HITS}, {_ANNO}, {_CLASSES}, {_LENGTHS}, {_UNIQUE}, {_TPM}, over AS (SELECT a.gene, a.path, t.tpm, unnest(range(a.path[1] + 1, a.path[-1])) AS node FROM anno a JOIN tpm t USING (gene, tx))
SELECT gene, CAST(node AS INTEGER) AS node, CASE WHEN sum(tpm) > 0 THEN round(sum(CASE WHEN list_contains(path, node) THEN tpm ELSE 0 END) / sum(tpm), 4) END AS psi FROM over GROUP BY gene, node""")
def truth_psi_from_tpm(spark, sf_dir):
    p = _paths(spark, sf_dir)
    return C.truth_psi(_tpm(p), C.annotated_paths(p))


@_query(f"""WITH {_HITS}, {_ANNO}, known AS (SELECT e.gene, l, r, n, exists(SELECT 1 FROM anno a WHERE a.gene = e.gene AND contains('-' || a.name || '-', '-' || l || '-' || r || '-')) AS k FROM edges e)
SELECT (SELECT count(*) FROM paths WHERE len = 1) AS body_reads, (SELECT count(*) FROM paths WHERE len > 1) AS junction_reads, count(*) AS junctions, count(*) FILTER (WHERE k) AS annotated_junctions, CAST(sum(n) FILTER (WHERE k) AS BIGINT) AS annotated_steps FROM known""")
def map_stats(spark, sf_dir):
    p = _paths(spark, sf_dir)
    return C.mapping_stats(p, C.annotated_paths(p))


_DNA = "dna AS (SELECT doc_id, regexp_replace(upper(text), '[^ACGT]', '', 'g') AS seq FROM documents)"


def _dna(spark: SparkSession, sf_dir: str, name: str = "documents", key: str = "doc_id") -> DataFrame:
    return _table(spark, sf_dir, name).select(key, F.regexp_replace(F.upper("text"), "[^ACGT]", "").alias("seq"))


@_query(f"WITH {_DNA}, k AS (SELECT substr(seq, CAST(i AS BIGINT), 6) AS kmer FROM dna, unnest(range(1, length(seq) - 4)) AS t(i)) SELECT kmer, count(*) AS n FROM k GROUP BY kmer")
def kmer_counts(spark, sf_dir):
    return kmers.counted(_dna(spark, sf_dir), 6).select("kmer", "n")


@_query(f"WITH {_DNA}, k AS (SELECT substr(seq, CAST(i AS BIGINT), 9) AS kmer FROM dna, unnest(range(1, length(seq) - 7)) AS t(i)), c AS (SELECT kmer, count(*) AS n FROM k GROUP BY kmer) SELECT kmer, CAST(1 + list_sum(list_transform(range(1, 10), lambda i: (strpos('ACGT', substr(kmer, i, 1)) - 1) * pow(4, 9 - i))) AS BIGINT) AS kmer_index, n FROM c")
def kmer_index(spark, sf_dir):
    """Every 9-mer of every sequence, with its number and how often it stands there."""
    found = kmers.counted(_dna(spark, sf_dir), 9)
    return found.select("kmer", S.kmer_index(F.col("kmer")).alias("kmer_index"), "n")


@_query(f"WITH {_DNA} SELECT doc_id, md5(reverse(translate(seq, 'ACGT', 'TGCA'))) AS rc FROM dna")
def revcomp(spark, sf_dir):
    return _dna(spark, sf_dir).select("doc_id", F.md5(S.reverse_complement(F.col("seq")).cast("binary")).alias("rc"))


@_query(f"WITH {_DNA}, w AS (SELECT substr(seq, CAST(i AS BIGINT), 50) AS w FROM dna, unnest(range(5, length(seq) - 49, 10)) AS t(i)) SELECT CAST(round(((50 - length(replace(replace(w, 'G', ''), 'C', ''))) / 50::DOUBLE - (50 - length(replace(replace(w, 'G', ''), 'C', ''))) / 50::DOUBLE % 0.05::DOUBLE) / 0.05::DOUBLE) AS INTEGER) + 1 AS bin, count(*) AS n FROM w GROUP BY bin")
def gc_windows(spark, sf_dir):
    return _dna(spark, sf_dir).select(F.explode(bias.gc_bins(F.col("seq"))).alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))


@_query(f"WITH {_DNA}, k AS (SELECT substr(seq, CAST(i AS BIGINT), 6) AS kmer, i IN (1, 2) AS fore FROM dna, unnest([1, 2, 23, 24, 25, 26, 27, 28, 29, 30, 31, 32]) AS t(i) WHERE length(seq) >= 37), c AS (SELECT kmer, count(*) FILTER (WHERE fore) AS fore, count(*) FILTER (WHERE NOT fore) AS back FROM k GROUP BY kmer) SELECT kmer, fore, back FROM c")
def primer_bias(spark, sf_dir):
    at = F.array(*[F.lit(i) for i in (1, 2, *range(23, 33))])
    k = _dna(spark, sf_dir).where(F.length("seq") >= 37).select(F.explode(F.transform(at, lambda i: F.struct(F.substring("seq", i, F.lit(6)).alias("kmer"), (i < 3).alias("fore")))).alias("k"))
    return k.groupBy("k.kmer").agg(F.count_if(F.col("k.fore")).alias("fore"), F.count_if(~F.col("k.fore")).alias("back"))


@_query("""WITH d AS (SELECT doc_id, regexp_replace(upper(text), '[^ACGT]', '', 'g') AS seq FROM documents), b AS (SELECT item_id, regexp_replace(upper(text), '[^ACGT]', '', 'g') AS seq FROM benchmark),
s AS (SELECT DISTINCT item_id, substr(seq, CAST(i AS BIGINT), 18) AS kmer FROM b, unnest(range(1, length(seq) - 16)) AS t(i)), q AS (SELECT doc_id, substr(seq, 6 + 18 * CAST(i AS BIGINT), 18) AS kmer, CAST(i AS INTEGER) AS try FROM d, unnest(range(0, 3)) AS t(i) WHERE length(seq) >= 28 + 18 * i),
tol AS (SELECT kmer FROM s GROUP BY kmer HAVING count(*) <= 4), h AS (SELECT q.doc_id, q.try, s.item_id FROM q JOIN s USING (kmer) JOIN tol USING (kmer)), f AS (SELECT doc_id, min(try) AS try FROM h GROUP BY doc_id)
SELECT doc_id, try, item_id FROM h JOIN f USING (doc_id, try)""")
def seed_join(spark, sf_dir):
    """The first of up to three seeds of a sequence that 1 to 4 items hold, with those items; a seed leaves five bases at either end."""
    seeds = kmers.listed(_dna(spark, sf_dir, "benchmark", "item_id"), "item_id", 18)
    seeds = seeds.join(seeds.groupBy("kmer").agg(F.count(F.lit(1)).alias("n")).where("n <= 4").select("kmer"), "kmer")
    tries = F.filter(F.array(*[F.struct(F.lit(i).alias("try"), F.substring("seq", 6 + 18 * i, 18).alias("kmer"), F.lit(28 + 18 * i).alias("least")) for i in range(3)]), lambda t: F.length("seq") >= t["least"])
    hits = _dna(spark, sf_dir).select("doc_id", F.explode(tries).alias("t")).select("doc_id", "t.try", "t.kmer").join(seeds, "kmer").drop("kmer")
    return hits.withColumn("_first", F.min("try").over(Window.partitionBy("doc_id"))).where("try = _first").drop("_first")


_KINDS = "['SL','SR','LS','RS','LR','LL','RR']"
_SIDES = f"sides AS (SELECT o_orderkey AS node, {_KINDS}[CAST(o_orderkey % 7 AS INTEGER) + 1] AS l, {_KINDS}[CAST((o_orderkey // 7) % 7 AS INTEGER) + 1] AS r FROM orders)"


@_query(f"""WITH {_SIDES} SELECT node, l, r, CASE WHEN l IN ('SL','LS') AND r = 'SL' THEN 'TS' WHEN l = 'RS' AND r IN ('RS','SR') THEN 'TE' WHEN l = 'LS' AND r IN ('LL','LR','LS') THEN 'AF' WHEN l IN ('RR','LR','SR') AND r = 'SR' THEN 'AL'
 WHEN l = 'LL' AND r = 'RR' THEN 'RI' WHEN l IN ('RR','LR','SR') AND r IN ('LL','LR','LS') THEN 'CE' WHEN l = 'LL' AND r IN ('LL','LR','LS') THEN 'AD' WHEN l IN ('RR','LR','SR') AND r = 'RR' THEN 'AA' ELSE 'NA' END AS motif,
 CASE l WHEN 'SL' THEN 'RS' WHEN 'RS' THEN 'SL' WHEN 'SR' THEN 'LS' WHEN 'LS' THEN 'SR' WHEN 'LL' THEN 'RR' WHEN 'RR' THEN 'LL' ELSE 'LR' END AS inverted, l IN ('LR','RR','SR','LS','SL') AS exon_start, r IN ('LR','LL','SR','LS','RS') AS exon_stop, r IN ('LR','LS','SR') AS hard FROM sides""")
def motif_classify(spark, sf_dir):
    kinds = F.array(*[F.lit(k) for k in S.EDGE_KINDS])
    n = F.col("o_orderkey")
    s = _table(spark, sf_dir, "orders").select(n.alias("node"), F.get(kinds, (n % 7).cast("int")).alias("l"), F.get(kinds, F.expr("cast((o_orderkey div 7) % 7 as int)")).alias("r"))
    return s.select("node", "l", "r", S.motif(F.col("l"), F.col("r")).alias("motif"), S.inverted(F.col("l")).alias("inverted"), S.is_exon_start(F.col("l")).alias("exon_start"), S.is_exon_stop(F.col("r")).alias("exon_stop"), S.is_hard(F.col("r")).alias("hard"))


@_query("""WITH genes AS (SELECT p_partkey AS gene, CAST(sum(p_size) OVER (ORDER BY p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT) AS base, p_size FROM part), g AS (SELECT gene, coalesce(base, 0) AS base, p_size FROM genes),
hits AS (SELECT event_id, CAST(event_id * 7919 % (SELECT sum(p_size) FROM part) AS BIGINT) AS pos FROM events) SELECT event_id, pos, gene, pos - base AS inside FROM hits JOIN g ON pos >= base AND pos < base + p_size""")
def asof_gene(spark, sf_dir):
    """Position to gene by running offsets, in bins of 64: a gene shows in each bin that it touches, so the join is by equality."""
    # Sums of 1000-key blocks, running within a thousand blocks and then over those: a millionth of the keys meets in one task.
    p = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("gene"), F.col("p_size").cast("long").alias("size"), F.expr("p_partkey div 1000").alias("block"))
    before = lambda w, c: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = p.groupBy("block").agg(F.sum("size").alias("s")).withColumn("far", F.expr("block div 1000"))
    far = blocks.groupBy("far").agg(F.sum("s").alias("s")).select("far", before(Window.orderBy("far"), "s").alias("start"))
    blocks = blocks.withColumn("base", before(Window.partitionBy("far").orderBy("block"), "s")).join(F.broadcast(far), "far").withColumn("base", F.col("base") + F.col("start"))
    inner = F.coalesce(F.sum("size").over(Window.partitionBy("block").orderBy("gene").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    genes = p.withColumn("at", inner).join(blocks.select("block", "base"), "block").select("gene", (F.col("at") + F.col("base")).alias("at"), "size").where("size > 0")
    total = p.agg(F.sum("size").alias("total"))
    hits = _table(spark, sf_dir, "events").join(F.broadcast(total)).select("event_id", (F.col("event_id") * 7919 % F.col("total")).alias("pos")).withColumn("bin", F.expr("pos div 64"))
    binned = genes.withColumn("bin", F.explode(F.expr("sequence(at div 64, (at + size - 1) div 64)")))
    return hits.join(binned, "bin").where("pos >= at and pos < at + size").select("event_id", "pos", "gene", (F.col("pos") - F.col("at")).alias("inside"))


@_query("""WITH reads AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_suppkey AS chrom, l_partkey AS s, l_partkey + CAST(l_quantity AS BIGINT) AS e FROM lineitem), exons AS (SELECT p_partkey AS exon, p_partkey % 100 AS chrom, p_partkey AS xs, p_partkey + p_size AS xe FROM part)
SELECT chrom, exon, count(*) AS n FROM reads JOIN exons USING (chrom) WHERE s <= xe AND e >= xs GROUP BY chrom, exon""")
def interval_overlap(spark, sf_dir):
    """Overlapping intervals by equal chromosome and bins of 64; a pair counts in the bin of its later start only."""
    reads = _table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("chrom"), F.col("l_partkey").alias("s"), (F.col("l_partkey") + F.col("l_quantity").cast("long")).alias("e"))
    exons = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("exon"), (F.col("p_partkey") % 100).alias("chrom"), F.col("p_partkey").alias("xs"), (F.col("p_partkey") + F.col("p_size")).alias("xe"))
    bins = lambda df, a, b: df.withColumn("bin", F.explode(F.expr(f"sequence({a} div 64, {b} div 64)")))
    both = bins(reads, "s", "e").join(bins(exons, "xs", "xe"), ["chrom", "bin"]).where("s <= xe and e >= xs and bin = greatest(s, xs) div 64")
    return both.groupBy("chrom", "exon").agg(F.count(F.lit(1)).alias("n"))


_REPLICATES = "reps AS (SELECT event_type, user_id % 20 AS replicate, user_id % 2 AS side, avg(CASE WHEN value > 10 THEN 1.0 ELSE 0.0 END) AS psi, count(*) AS n FROM events GROUP BY ALL)"


def _replicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "events")
    return e.groupBy("event_type", (F.col("user_id") % 20).alias("replicate"), (F.col("user_id") % 2).alias("side")).agg(F.avg(F.when(F.col("value") > 10, 1.0).otherwise(0.0)).alias("psi"), F.count(F.lit(1)).alias("n"))


@_query(f"""WITH {_REPLICATES}, m AS (SELECT event_type, side, (psi * n + 1) / (n + 2) AS m FROM reps WHERE n >= 5), p AS (SELECT event_type, side, avg(m) AS mean FROM m GROUP BY ALL)
SELECT a.event_type, round(a.mean, 5) AS psi_a, round(b.mean, 5) AS psi_b, round(a.mean - b.mean, 5) AS delta_psi FROM p a JOIN p b USING (event_type) WHERE a.side = 0 AND b.side = 1""")
def posterior_diff(spark, sf_dir):
    r = _replicates(spark, sf_dir)
    return posterior.difference(*[posterior.pooled(r.where(F.col("side") == s), ["event_type"]) for s in (0, 1)], ["event_type"], with_probability=False)


@_query(None)
def posterior_probability(spark, sf_dir):
    r = _replicates(spark, sf_dir)
    return posterior.difference(*[posterior.pooled(r.where(F.col("side") == s), ["event_type"]) for s in (0, 1)], ["event_type"])


@_query(None)
def beta_ci(spark, sf_dir):
    psi = psi_nodes(spark, sf_dir).where("psi is not null")
    return psi.withColumn("ci", interval()("psi", F.col("total_reads").cast("double"))).select("gene", "node", "psi", S.significant(F.col("ci.lo"), 3).alias("lo"), S.significant(F.col("ci.hi"), 3).alias("hi"))


@_query("SELECT l_orderkey, l_linenumber, round(1 - pow(10.0, -l_quantity / 10), 6) AS p FROM lineitem")
def phred_probability(spark, sf_dir):
    return _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(S.phred(F.col("l_quantity")), 6).alias("p"))


#: Exons out of order lines: up to seven for a transcript, which is an order; 9973 genes.
_EXONS = """ex AS (SELECT CAST(l_orderkey % 9973 AS BIGINT) AS gene, l_orderkey AS tx, CASE WHEN l_orderkey % 9973 % 2 = 0 THEN '+' ELSE '-' END AS strand, min(100 * l_linenumber + l_partkey % 30) AS s, min(100 * l_linenumber + l_partkey % 30 + CAST(l_quantity AS BIGINT)) AS e FROM lineitem GROUP BY l_orderkey, l_linenumber)"""
_SITES = f"""{_EXONS}, o AS (SELECT *, row_number() OVER (PARTITION BY tx ORDER BY s) AS i, count(*) OVER (PARTITION BY tx) AS k FROM ex),
don AS (SELECT DISTINCT gene, e AS px FROM o WHERE i < k), acc AS (SELECT DISTINCT gene, s AS px FROM o WHERE i > 1),
txst AS (SELECT DISTINCT gene, s AS px FROM o WHERE i = 1 EXCEPT SELECT gene, px FROM acc), txen AS (SELECT DISTINCT gene, e AS px FROM o WHERE i = k EXCEPT SELECT gene, px FROM don)"""
_NODES = f"""{_SITES}, b AS (SELECT gene, px, 1 AS kind FROM txen UNION ALL SELECT gene, px, 2 FROM acc UNION ALL SELECT gene, px, 3 FROM don UNION ALL SELECT gene, px, 4 FROM txst),
r AS (SELECT gene, px, kind, row_number() OVER w AS rn, lead(px) OVER w AS nx, lead(kind) OVER w AS nk, lag(kind) OVER w AS pk FROM b WINDOW w AS (PARTITION BY gene ORDER BY px, kind)),
solid AS (SELECT r.*, EXISTS (SELECT 1 FROM ex WHERE ex.gene = r.gene AND ex.s <= r.px AND ex.e >= r.nx) AS ok FROM r WHERE nx IS NOT NULL),
gaps AS (SELECT *, NOT ok AND (rn - coalesce(max(CASE WHEN ok THEN rn END) OVER (PARTITION BY gene ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) % 2 = 1 AS gap FROM solid),
parts AS (SELECT *, coalesce(lag(gap) OVER (PARTITION BY gene ORDER BY rn), false) AS after FROM gaps),
cut AS (SELECT gene, rn, px + CASE WHEN NOT after AND kind IN (1, 3) AND px <> nx THEN 1 ELSE 0 END AS c, nx - CASE WHEN nk IN (2, 4) AND px <> nx THEN 1 ELSE 0 END AS z,
  CASE WHEN after THEN [['RS','SR','RS','RS'],['RR','RR','RR','RR'],['LL','LR','LL','LS'],['SL','SL','SL','SL']][pk][kind] ELSE ['RS','RR','LL','SL'][kind] END AS le FROM parts WHERE NOT gap),
two AS (SELECT *, coalesce(lead(le) OVER (PARTITION BY gene ORDER BY rn), 'RS') AS re, gene % 2 = 0 AS fw FROM cut),
nodes AS (SELECT gene, CAST(row_number() OVER (PARTITION BY gene ORDER BY CASE WHEN fw THEN rn ELSE -rn END) AS INTEGER) AS node, c AS coord, z - c + 1 AS length,
  CASE WHEN fw THEN le ELSE inv[re] END AS edge_in, CASE WHEN fw THEN re ELSE inv[le] END AS edge_out FROM two, (SELECT MAP {{'SL': 'RS', 'RS': 'SL', 'SR': 'LS', 'LS': 'SR', 'LL': 'RR', 'RR': 'LL', 'LR': 'LR'}} AS inv))"""
_GRAPH_PATHS = f"""{_NODES}, twin AS (SELECT *, coalesce(lead(coord) OVER (PARTITION BY gene ORDER BY node) = coord, false) AS t FROM nodes),
gp AS (SELECT ex.gene, ex.tx, list(DISTINCT n.node ORDER BY n.node) AS path FROM ex JOIN twin n ON n.gene = ex.gene AND n.coord BETWEEN ex.s AND ex.e AND NOT (ex.gene % 2 = 0 AND t AND n.coord = ex.s) GROUP BY ex.gene, ex.tx)"""


def _order_exons(spark: SparkSession, sf_dir: str, key: str = "gene") -> DataFrame:
    """Exons, dealt out by gene or by transcript: either holds an order's lines whole."""
    n, start = F.col("l_orderkey"), 100 * F.col("l_linenumber") + F.col("l_partkey") % 30
    lines = _table(spark, sf_dir, "lineitem").select((n % 9973).alias("gene"), n.alias("transcript"), "l_linenumber", start.alias("start"), (start + F.col("l_quantity").cast("long")).alias("end"))
    rows = dealt(lines, key).groupBy("gene", "transcript", "l_linenumber").agg(F.min("start").alias("start"), F.min("end").alias("end"))
    return rows.select(F.lit("chr").alias("chrom"), F.when(F.col("gene") % 2 == 0, "+").otherwise("-").alias("strand"), "gene", "transcript", "start", "end")


def _graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    exons = _order_exons(spark, sf_dir)
    tx = T.transcripts(exons)
    genes = T.genes(tx)
    return tx, genes, graph.nodes(genes, exons.select("gene", "start", "end"))


@_query(f"WITH {_SITES} SELECT g.gene, (SELECT string_agg(CAST(px AS VARCHAR), ',' ORDER BY px) FROM don WHERE don.gene = g.gene) AS don, (SELECT string_agg(CAST(px AS VARCHAR), ',' ORDER BY px) FROM acc WHERE acc.gene = g.gene) AS acc, (SELECT string_agg(CAST(px AS VARCHAR), ',' ORDER BY px) FROM txst WHERE txst.gene = g.gene) AS txst, (SELECT string_agg(CAST(px AS VARCHAR), ',' ORDER BY px) FROM txen WHERE txen.gene = g.gene) AS txen, round(len, 6) AS length FROM (SELECT gene, avg(n) AS len FROM (SELECT gene, tx, sum(e - s + 1) AS n FROM ex GROUP BY gene, tx) GROUP BY gene) g")
def gene_sites(spark, sf_dir):
    """Splice sites and outer ends of genes from exons."""
    _, genes, _ = _graph(spark, sf_dir)
    joined = lambda c: F.when(F.size(c) > 0, F.array_join(F.col(c).cast("array<string>"), ",")).alias(c)
    return genes.select("gene", *[joined(c) for c in ("don", "acc", "txst", "txen")], F.round("length", 6).alias("length"))


@_query(f"WITH {_NODES} SELECT gene, node, coord, length, edge_in, edge_out, CAST(1 + coalesce(sum(length) OVER (PARTITION BY gene ORDER BY node ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\" FROM nodes")
def graph_nodes(spark, sf_dir):
    """Nodes of splice graphs with their edges and offsets."""
    return _graph(spark, sf_dir)[2]


@_query(f"WITH {_GRAPH_PATHS} SELECT gp.gene, tx AS transcript, array_to_string(path, '-') AS nodes, CAST((SELECT sum(length) FROM nodes n WHERE n.gene = gp.gene AND list_contains(gp.path, n.node)) AS BIGINT) AS length FROM gp")
def graph_paths(spark, sf_dir):
    """Transcripts as nodes of their gene's graph, and their length by those."""
    tx, genes, nodes = _graph(spark, sf_dir)
    return graph.annotated_paths(nodes, genes, tx).select("gene", "transcript", F.array_join(F.col("nodes").cast("array<string>"), "-").alias("nodes"), "length")


@_query(f"""WITH {_GRAPH_PATHS}, hard AS (SELECT gene, node FROM nodes WHERE edge_out IN ('LR','LS','SR')), reach AS (SELECT n.gene, n.node AS a, n.coord AS ca, n.coord + n.length - 1 AS ea, coalesce((SELECT min(h.node) FROM hard h WHERE h.gene = n.gene AND h.node >= n.node), (SELECT max(m.node) FROM nodes m WHERE m.gene = n.gene)) AS z FROM nodes n WHERE edge_in IN ('LR','RR','SR','LS','SL')),
found AS (SELECT r.gene, r.a, n.node AS b, least(ca, n.coord) AS low, greatest(ea, n.coord + n.length - 1) AS high FROM reach r JOIN nodes n ON n.gene = r.gene AND n.node BETWEEN r.a AND r.z AND n.edge_out IN ('LR','LL','SR','LS','RS'))
SELECT gene || chr(9) || 'chr:' || low || '-' || high || ':' || (CASE WHEN gene % 2 = 0 THEN '+' ELSE '-' END) || chr(9) || array_to_string(range(a, b + 1), ',') || chr(9) || (CASE WHEN EXISTS (SELECT 1 FROM gp WHERE gp.gene = found.gene AND list_has_all(gp.path, CAST(range(a, b + 1) AS INTEGER[]))) THEN 'Y' ELSE 'N' END) AS value FROM found""")
def exon_table(spark, sf_dir):
    """Lines of the table of potential exons."""
    tx, genes, nodes = _graph(spark, sf_dir)
    return tables.exon_lines(graph.potential_exons(nodes, graph.annotated_paths(nodes, genes, tx)), genes)


@_query(f"""WITH {_EXONS} SELECT 'c' || gene % 5 AS chrom, s AS start, e AS "end", strand, 'g' || gene AS gene, 't' || tx AS transcript, '_' AS gene_name FROM ex WHERE tx % 3 <> 0""")
def gtf_parse(spark, sf_dir):
    """Exon lines of an annotation, read back; every third transcript has a low support level and goes."""
    e = _order_exons(spark, sf_dir, "transcript")
    attrs = F.concat(F.lit('gene_id "g'), "gene", F.lit('"; transcript_id "t'), "transcript", F.lit('"; transcript_support_level "'), F.when(F.col("transcript") % 3 == 0, "4 (old)").otherwise("1"), F.lit('";'))
    line = F.concat_ws("\t", F.concat(F.lit("c"), (F.col("gene") % 5).cast("string")), F.lit("x"), F.lit("exon"), F.col("start").cast("string"), F.col("end").cast("string"), F.lit("."), "strand", F.lit("."), attrs)
    lines = e.select(line.alias("value"), F.lit("file").alias("file"), F.col("transcript").alias("block"), F.col("start").alias("line"))
    return text.gtf_rows(lines, True).drop("place")


@_query("""WITH r AS (SELECT l_suppkey AS gene, l_partkey AS pos, 5 + l_linenumber AS a, CAST(l_quantity AS BIGINT) * 10 AS b FROM lineitem WHERE l_returnflag = 'N'), s AS (SELECT gene, 'don' AS kind, pos + a - 1 AS site FROM r UNION ALL SELECT gene, 'acc', pos + a + b FROM r)
SELECT gene, kind, site, count(*) AS n FROM s GROUP BY ALL HAVING count(*) >= 2""")
def novel_site_counts(spark, sf_dir):
    """Splice sites of reads by their CIGAR, those of two reads or more."""
    rows = _table(spark, sf_dir, "lineitem").where("l_returnflag = 'N'")
    cigar = F.concat((5 + F.col("l_linenumber")).cast("string"), F.lit("M"), (F.col("l_quantity").cast("long") * 10).cast("string"), F.lit("N20M3S"))
    gaps = alignments.introns(rows.select(F.col("l_suppkey").alias("gene"), F.col("l_partkey").alias("pos"), cigar.alias("cigar")))
    site = F.explode(F.array(F.struct(F.lit("don").alias("kind"), F.col("donor").alias("site")), F.struct(F.lit("acc").alias("kind"), F.col("acceptor").alias("site"))))
    return gaps.select("gene", site.alias("s")).groupBy("gene", "s.kind", "s.site").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")


@_query("""WITH reads AS (SELECT l_suppkey AS chrom, l_partkey AS s, l_partkey + CAST(l_quantity AS BIGINT) AS e FROM lineitem), exons AS (SELECT p_partkey AS exon, p_partkey % 100 AS chrom, p_partkey AS xs, p_partkey + p_size AS xe FROM part)
SELECT chrom, exon, count(*) AS n FROM reads JOIN exons USING (chrom) WHERE s BETWEEN xs AND xe OR e BETWEEN xs AND xe GROUP BY chrom, exon""")
def exon_ends(spark, sf_dir):
    """Reads with an end inside an exon, by bins of 64 of their ends; a read counts once."""
    reads = _table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("chrom"), F.col("l_partkey").alias("s"), (F.col("l_partkey") + F.col("l_quantity").cast("long")).alias("e"))
    exons = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("exon"), (F.col("p_partkey") % 100).alias("chrom"), F.col("p_partkey").alias("xs"), (F.col("p_partkey") + F.col("p_size")).alias("xe"))
    ends = reads.withColumn("end", F.explode(F.array("s", "e"))).withColumn("first", F.col("end") == F.col("s")).withColumn("bin", F.expr("end div 64"))
    met = ends.join(exons.withColumn("bin", F.explode(F.expr("sequence(xs div 64, xe div 64)"))), ["chrom", "bin"]).where("end between xs and xe")
    # Of a read with both ends inside, the first counts; one of equal ends comes twice as the first.
    once = F.col("first") | ~F.col("s").between(F.col("xs"), F.col("xe"))
    return met.where(once).groupBy("chrom", "exon").agg(F.sum(F.when(F.col("s") == F.col("e"), 0.5).otherwise(1.0)).cast("long").alias("n"))


_MATES = """hits AS (SELECT DISTINCT c_nationkey AS gene, l_orderkey AS read, l_linenumber AS node FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey),
m AS (SELECT gene, read, coalesce(string_agg(CAST(node AS VARCHAR), '-' ORDER BY node) FILTER (WHERE node <= 4), '') AS a, coalesce(string_agg(CAST(node AS VARCHAR), '-' ORDER BY node) FILTER (WHERE node >= 3), '') AS b FROM hits GROUP BY gene, read),
l AS (SELECT gene, a, b, CASE WHEN contains('-' || b || '-', '-' || a || '-') THEN b WHEN contains('-' || a || '-', '-' || b || '-') THEN a END AS w FROM m WHERE a <> '' AND b <> '')"""


@_query(f"WITH {_MATES} SELECT gene, CASE WHEN w IS NULL THEN 'pair' WHEN NOT contains(w, '-') THEN 'node' WHEN length(w) - length(replace(w, '-', '')) = 1 THEN 'edge' ELSE 'long' END AS kind, coalesce(w, a) AS path, CASE WHEN w IS NULL THEN b END AS mate, CAST(count(*) AS DOUBLE) AS n FROM l GROUP BY ALL")
def paired_counts(spark, sf_dir):
    """Pairs of paths: the one that holds the other, or both. Mates are an order's lines up to the fourth and from the third."""
    return _mates(spark, sf_dir).select("gene", "kind", F.array_join(F.col("path").cast("array<string>"), "-").alias("path"), F.array_join(F.col("mate").cast("array<string>"), "-").alias("mate"), "n")


def _mates(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _paths(spark, sf_dir)
    pairs = p.select("gene", F.filter("path", lambda x: x <= 4).cast("array<int>").alias("path"), F.filter("path", lambda x: x >= 3).cast("array<int>").alias("mate"))
    return quant.count_pairs(pairs)


@_query(f"""WITH {_MATES}, c AS (SELECT gene, string_split(coalesce(w, a), '-') AS p, CASE WHEN w IS NULL THEN string_split(b, '-') ELSE [] END AS q, count(*) AS n FROM l GROUP BY ALL),
parts AS (SELECT gene, n, unnest(CASE WHEN len(p) = 1 THEN [p] ELSE list_transform(range(1, len(p)), lambda i: p[i : i + 1]) END) AS s FROM c
  UNION ALL SELECT gene, n, s FROM (SELECT gene, n, p, len(q) AS k, unnest(CASE WHEN len(q) = 1 THEN [q] ELSE list_transform(range(1, len(q)), lambda i: q[i : i + 1]) END) AS s FROM c) WHERE NOT list_has_all(p, s))
SELECT gene, array_to_string(s, '-') AS path, CAST(sum(n) AS DOUBLE) AS n FROM parts GROUP BY ALL""")
def paired_steps(spark, sf_dir):
    """The same, long paths and pairs given to their steps and nodes."""
    return quant.decomposed(_mates(spark, sf_dir)).select("gene", F.array_join(F.col("path").cast("array<string>"), "-").alias("path"), "n")


_MULTI = f"""{_HITS}, {_ANNO}, places AS (SELECT p.gene AS g1, (p.gene + 1) % 25 AS g2, name, count(*) AS n FROM paths p GROUP BY ALL),
each AS (SELECT g1, name, n, g1 AS gene, 0 AS i FROM places UNION ALL SELECT g1, name, n, g2, 1 FROM places),
hit AS (SELECT e.*, a.tx FROM each e JOIN anno a ON a.gene = e.gene AND contains('-' || a.name || '-', '-' || e.name || '-')),
whole AS (SELECT g1, name FROM hit GROUP BY g1, name HAVING count(DISTINCT i) = 2),
weight AS (SELECT gene, tx, CAST(100 * gene + tx AS DOUBLE) AS tpm FROM anno), total AS (SELECT gene, sum(tpm) AS tpm FROM weight GROUP BY gene),
cls AS (SELECT g1, name, gene, tx, tpm, sum(tpm) OVER (PARTITION BY g1, name) AS t FROM (SELECT DISTINCT g1, name, gene, tx FROM hit JOIN whole USING (g1, name)) JOIN weight USING (gene, tx)),
w AS (SELECT g1, name, i, sum(round(tpm / t, 4)) AS w FROM hit JOIN cls USING (g1, name, gene, tx) GROUP BY ALL UNION ALL SELECT e.g1, e.name, e.i, coalesce(tpm, 0) FROM each e LEFT JOIN total USING (gene) WHERE (e.g1, e.name) NOT IN (SELECT (g1, name) FROM whole)),
dealt AS (SELECT e.gene, e.name, e.n * w / sum(w) OVER (PARTITION BY e.g1, e.name) AS n FROM each e JOIN w USING (g1, name, i)),
split AS (SELECT gene, string_split(name, '-') AS p, n FROM dealt WHERE n > 0), steps2 AS (SELECT gene, n, unnest(CASE WHEN len(p) = 1 THEN [p] ELSE list_transform(range(1, len(p)), lambda i: p[i : i + 1]) END) AS s FROM split)"""


@_query(f"WITH {_MULTI} SELECT gene, array_to_string(s, '-') AS path, round(sum(n), 4) AS n FROM steps2 GROUP BY ALL")
def multi_assign(spark, sf_dir):
    """Reads with two places, their own gene and the next one, dealt by the abundance of what may have them."""
    p = _paths(spark, sf_dir)
    place = lambda g: F.struct(g.alias("gene"), F.col("path").cast("array<int>").alias("path"), F.lit(None).cast("array<int>").alias("mate"))
    multi = p.select(F.array(place(F.col("gene")), place(((F.col("gene") + 1) % 25).cast(p.schema["gene"].dataType))).alias("places")).groupBy("places").agg(F.count(F.lit(1)).cast("double").alias("n"))
    annotated = C.annotated_paths(p).select("gene", F.col("tx").cast("string").alias("transcript"), "nodes")
    abundance = annotated.select("gene", "transcript", (100 * F.col("gene") + F.col("transcript").cast("int")).cast("double").alias("tpm"), F.lit(0.0).alias("count"))
    dealt = quant.assigned(quant.multi_classes(multi, annotated), annotated, abundance)
    return dealt.select("gene", F.array_join(F.col("path").cast("array<string>"), "-").alias("path"), F.round("n", 4).alias("n"))


@_query(f"""WITH RECURSIVE {_HITS}, top AS (SELECT gene, max(n) AS t FROM edges GROUP BY gene), e AS (SELECT gene, l, r FROM edges JOIN top USING (gene) WHERE n >= 0.4 * t),
g AS (SELECT gene, r AS tip, [l, r] AS p FROM e WHERE NOT EXISTS (SELECT 1 FROM e f WHERE f.gene = e.gene AND f.r = e.l) UNION ALL SELECT g.gene, e.r, list_append(g.p, e.r) FROM g JOIN e ON e.gene = g.gene AND e.l = g.tip)
SELECT gene, array_to_string(p, '-') AS path FROM g WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.gene = g.gene AND e.l = g.tip)""")
def path_reduce(spark, sf_dir):
    """All longest paths through each gene's stronger edges."""
    strong = C.minor_steps_dropped(C.edge_counts(_paths(spark, sf_dir)), 0.4)

    def grow(pdf):
        import pandas as pd

        found = events.maximal_paths([(int(a), int(b)) for a, b in zip(pdf["l"], pdf["r"])])
        return pd.DataFrame({"gene": pdf["gene"].iloc[0], "path": ["-".join(map(str, p)) for p in found]})

    return strong.groupBy("gene").applyInPandas(grow, "gene int, path string")


@_query(None)
def psi_events(spark, sf_dir):
    """Inclusion of nodes as cassette exons, solved over paths; nations as genes with nodes one to seven."""
    counts = quant.decomposed(quant.count(_paths(spark, sf_dir).select("gene", F.col("path").cast("array<int>").alias("path"))))
    graph_ = counts.select("gene").distinct().withColumn("node", F.explode(F.sequence(F.lit(1), F.lit(7)))).select("gene", "node", F.lit(10).alias("length"), F.when(F.col("node") == 1, "SL").otherwise("LR").alias("edge_in"), F.when(F.col("node") == 7, "RS").otherwise("LR").alias("edge_out"))
    return events.inclusion(graph_, counts).select("gene", "node", "motif", "psi", "lo", "hi", "total", "complexity", F.round("entropy", 3).alias("entropy"), tables.paths(F.col("inclusion")).alias("inclusion"))


@_query(f"""WITH {_DNA}, pl AS (SELECT doc_id AS gene, i AS node, 10 * (i - 1) + 1 AS off, ['SL','LL','RR','LR'][i] AS edge, seq FROM dna, unnest([1, 2, 3, 4]) AS t(i) WHERE length(seq) >= 40),
e AS (SELECT 'left' AS side, substr(seq, off - 9, 9) AS kmer, gene, node FROM pl WHERE edge IN ('LR','LS','LL') AND off > 9 UNION ALL SELECT 'right', substr(seq, off, 9), gene, node FROM pl WHERE edge IN ('LR','SR','RR') AND off + 8 <= length(seq))
SELECT side, kmer, CAST(1 + list_sum(list_transform(range(1, 10), lambda i: (strpos('ACGT', substr(kmer, i, 1)) - 1) * pow(4, 9 - i))) AS BIGINT) AS code, gene, CAST(node AS INTEGER) AS node FROM e""")
def kmer_edges(spark, sf_dir):
    """k-mers before and after the boundaries of four nodes of ten bases each."""
    seqs = _dna(spark, sf_dir).where(F.length("seq") >= 40).select(F.col("doc_id").alias("gene"), "seq")
    kinds = F.array(*[F.lit(k) for k in ("SL", "LL", "RR", "LR")])
    nodes = seqs.select("gene", F.explode(F.sequence(F.lit(1), F.lit(4))).alias("node")).withColumns({"offset": (10 * (F.col("node") - 1) + 1).cast("long"), "edge_in": F.element_at(kinds, F.col("node"))})
    return graph.kmer_edges(nodes, seqs, 9)


@_query(f"""WITH {_DNA}, k AS (SELECT doc_id, substr(seq, CAST(i AS BIGINT), 6) AS kmer, i IN (1, 2) AS fore FROM dna, unnest([1, 2, 23, 24, 25, 26, 27, 28, 29, 30, 31, 32]) AS t(i) WHERE length(seq) >= 37),
c AS (SELECT kmer, count(*) FILTER (WHERE fore) AS f, count(*) FILTER (WHERE NOT fore) AS b FROM k GROUP BY kmer), w AS (SELECT kmer, (b / (SELECT sum(b) FROM c)) / (f / (SELECT sum(f) FROM c)) AS w FROM c WHERE f > 0)
SELECT doc_id AS read_id, round(sum(w) / 2, 6) AS value FROM k JOIN w USING (kmer) WHERE fore GROUP BY doc_id""")
def primer_adjust(spark, sf_dir):
    """Each read's weight by the hexamers at its start."""
    reads = _dna(spark, sf_dir).where(F.length("seq") >= 37).withColumnRenamed("doc_id", "read_id")
    return bias.primer_adjusted(reads, bias.primer_weights(reads)).select("read_id", F.round("value", 6).alias("value"))


@_query(f"""WITH {_DNA}, w AS (SELECT doc_id, substr(seq, CAST(i AS BIGINT), 50) AS w FROM dna, unnest(range(5, length(seq) - 49, 10)) AS t(i)), c AS (SELECT doc_id, CAST(round(((50 - length(replace(replace(w, 'G', ''), 'C', ''))) / 50::DOUBLE - (50 - length(replace(replace(w, 'G', ''), 'C', ''))) / 50::DOUBLE % 0.05::DOUBLE) / 0.05::DOUBLE) AS INTEGER) + 1 AS bin FROM w),
f AS (SELECT bin, count(*) AS n FROM c GROUP BY bin), v AS (SELECT bin, (bin / 210) / (n / (SELECT sum(n) FROM f)) AS w FROM f)
SELECT doc_id, round(10 * avg(w), 6) AS n FROM c JOIN v USING (bin) GROUP BY doc_id""")
def gc_adjust(spark, sf_dir):
    """Counts of ten for each read, weighed by its windows' G and C against an expectation that grows with the bin."""
    reads = _dna(spark, sf_dir)
    expected = spark.range(1).select(F.array(*[F.lit(i / 210) for i in range(1, 21)]).alias("expected"), F.lit(1.0).alias("tpm"))
    seen = reads.select("doc_id", F.explode(bias.gc_bins(F.col("seq"))).alias("bin")).groupBy("doc_id", "bin").agg(F.count(F.lit(1)).alias("k"))
    counts = seen.select("doc_id").distinct().withColumn("n", F.lit(10.0))
    return bias.gc_adjusted(counts, seen, bias.gc_weights(reads, expected), ["doc_id"]).select("doc_id", F.round("n", 6).alias("n"))


@_query(f"""WITH {_DNA}, w AS (SELECT doc_id, substr(seq, CAST(i AS BIGINT), 50) AS w FROM dna, unnest(range(1, length(seq) - 48)) AS t(i)), c AS (SELECT doc_id, CAST(round(((50 - length(replace(replace(w, 'G', ''), 'C', ''))) / 50::DOUBLE - (50 - length(replace(replace(w, 'G', ''), 'C', ''))) / 50::DOUBLE % 0.05::DOUBLE) / 0.05::DOUBLE) AS INTEGER) + 1 AS bin, count(*) AS n FROM w GROUP BY ALL)
SELECT doc_id, bin, round(n / sum(n) OVER (PARTITION BY doc_id), 6) AS share FROM c""")
def expected_gc(spark, sf_dir):
    """Shares of all windows of a sequence by their G and C."""
    shares = _dna(spark, sf_dir).select("doc_id", F.posexplode(graph.expected_gc(F.col("seq"))).alias("i", "share")).where("share > 0")
    return shares.select("doc_id", (F.col("i") + 1).cast("int").alias("bin"), F.round("share", 6).alias("share"))


@_query(f"""WITH {_HITS}, {_ANNO}, seen AS (SELECT e.gene, l, r, e.n, count(*) FILTER (WHERE contains('-' || a.name || '-', '-' || l || '-' || r || '-')) AS have, count(*) FILTER (WHERE a.path[1] <= l AND a.path[-1] >= r) AS round FROM edges e LEFT JOIN anno a USING (gene) GROUP BY ALL)
SELECT 'c1' || chr(9) || (100 * l + 10 - 1) || chr(9) || 100 * r || chr(9) || gene || ':' || l || '-' || r || ':' || (CASE WHEN have = 0 THEN 'ALT_UNIQ' WHEN have = round THEN 'CON_ANNO' ELSE 'ALT_ANNO' END) || chr(9) || n || '.0' || chr(9) || '+' AS value FROM seen""")
def junction_table(spark, sf_dir):
    """Lines of the table of junctions; nodes of ten bases a hundred apart."""
    p = _paths(spark, sf_dir)
    counts = C.edge_counts(p).select("gene", F.lit("edge").alias("kind"), F.array("l", "r").cast("array<int>").alias("path"), F.lit(None).cast("array<int>").alias("mate"), F.col("n").cast("double").alias("n"))
    genes = p.select("gene").distinct().select("gene", F.lit("c1").alias("chrom"), F.lit("+").alias("strand"))
    nodes = genes.select("gene", F.explode(F.sequence(F.lit(1), F.lit(7))).alias("node")).select("gene", "node", (100 * F.col("node")).alias("coord"), F.lit(10).alias("length"), F.lit("LR").alias("edge_in"), F.lit("LR").alias("edge_out"))
    annotated = C.annotated_paths(p).select("gene", F.col("tx").cast("string").alias("transcript"), "nodes")
    return tables.junction_lines(quant.junctions(counts, nodes, genes, annotated))


@_query(f"WITH {_HITS}, {_ANNO}, {_CLASSES}, {_LENGTHS}, {_UNIQUE}, {_TPM} SELECT gene || '.' || tx || chr(9) || tpm || chr(9) || count || '.0' AS value FROM tpm")
def tpm_table(spark, sf_dir):
    """Lines of the table of transcripts' abundances."""
    t = _tpm(_paths(spark, sf_dir))
    return tables.tpm_lines(t.select(F.concat_ws(".", F.col("gene").cast("string"), F.col("tx").cast("string")).alias("name"), "tpm", F.col("count").cast("double").alias("count")), "name")


@_query(f"""WITH {_SIDES}, m AS (SELECT node // 50 AS gene, node, CASE WHEN l IN ('SL','LS') AND r = 'SL' THEN 'TS' WHEN l = 'RS' AND r IN ('RS','SR') THEN 'TE' ELSE 'NA' END AS motif FROM sides),
b AS (SELECT *, CASE WHEN motif = lag(motif) OVER (PARTITION BY gene ORDER BY node) THEN 0 ELSE 1 END AS new FROM m), i AS (SELECT *, sum(new) OVER (PARTITION BY gene ORDER BY node) AS run FROM b)
SELECT gene, motif, min(node) AS first, max(node) AS last, count(*) AS n FROM i WHERE motif <> 'NA' GROUP BY gene, run, motif""")
def tandem_runs(spark, sf_dir):
    """Runs of nodes that are ends of transcripts of one kind."""
    kinds = F.array(*[F.lit(k) for k in S.EDGE_KINDS])
    n = F.col("o_orderkey")
    motif = S.motif(F.get(kinds, (n % 7).cast("int")), F.get(kinds, F.expr("cast((o_orderkey div 7) % 7 as int)")))
    m = _table(spark, sf_dir, "orders").select(F.expr("o_orderkey div 50").alias("gene"), n.alias("node"), F.when(motif.isin("TS", "TE"), motif).otherwise("NA").alias("motif"))
    order = Window.partitionBy("gene").orderBy("node")
    runs = m.withColumn("new", F.when(F.col("motif") == F.lag("motif").over(order), 0).otherwise(1)).withColumn("run", F.sum("new").over(order))
    return runs.where("motif != 'NA'").groupBy("gene", "run", "motif").agg(F.min("node").alias("first"), F.max("node").alias("last"), F.count(F.lit(1)).alias("n")).drop("run")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, (f, _) in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in _QUERIES.items() if sql}
