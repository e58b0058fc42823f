"""Counts of aligned reads, the transcripts they may come from, their abundance, and reads that align in several places.

counts(gene, kind, path, mate, n): kind is node (one node), edge (l < r), circ (l >= r), long (three nodes or more) or pair
(two paths that aren't part of each other, the second one in mate). Reads are summed before anything else, so what is
joined below are distinct paths, however many reads there are.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

def _none() -> Column:
    return F.lit(None).cast("array<int>")


def nodes_of(alignment: Column) -> Column:
    """An alignment's path as node numbers."""
    return F.transform(alignment["path"], lambda n: n["node"])


def single_paths(aligned: DataFrame) -> DataFrame:
    """(read_id, gene, path) of the reads that align in one place."""
    one = F.col("alignments")[0]
    return aligned.where(F.size("alignments") == 1).select("read_id", one["gene"].alias("gene"), nodes_of(one).alias("path"))


def paired_paths(aligned: DataFrame) -> DataFrame:
    """(read_id, gene, path, mate) of the pairs that align in one place."""
    return aligned.where(F.size("first") == 1).select("read_id", F.col("first")[0]["gene"].alias("gene"), nodes_of(F.col("first")[0]).alias("path"), nodes_of(F.col("second")[0]).alias("mate"))


def is_part(short: Column, long: Column) -> Column:
    """Whether a path stands in another, node by node."""
    return F.when(F.size(short) <= F.size(long), F.exists(F.sequence(F.lit(1), F.size(long) - F.size(short) + 1), lambda i: F.slice(long, i, F.size(short)) == short)).otherwise(F.lit(False))


def _kind(path: Column) -> Column:
    return F.when(F.size(path) == 1, "node").when(F.size(path) > 2, "long").when(path[0] < path[1], "edge").otherwise("circ")


def count(paths: DataFrame) -> DataFrame:
    """counts of paths(gene, path, optionally value, 1 if absent); empty paths are passed over."""
    value = F.col("value") if "value" in paths.columns else F.lit(1.0)
    kept = paths.where(F.size("path") > 0).withColumn("kind", F.when(F.size("path") == 2, _kind(F.col("path"))).when(F.size("path") == 1, "node").otherwise("long"))
    return kept.groupBy("gene", "kind", "path").agg(F.sum(value.cast("double")).alias("n")).select("gene", "kind", "path", _none().alias("mate"), "n")


def count_pairs(pairs: DataFrame, drop_long: bool = False) -> DataFrame:
    """counts of pairs(gene, path, mate): the longer path, if the other is part of it, or both.

    drop_long: pairs whose longer path has three nodes or more count nothing.
    """
    value = F.col("value") if "value" in pairs.columns else F.lit(1.0)
    longer = F.when(is_part(F.col("path"), F.col("mate")), F.col("mate")).when(is_part(F.col("mate"), F.col("path")), F.col("path"))
    kept = pairs.where((F.size("path") > 0) & (F.size("mate") > 0)).withColumn("longer", longer)
    if drop_long:
        kept = kept.where("longer is null or size(longer) < 3")
    kept = kept.withColumn("kind", F.when(F.col("longer").isNull(), "pair").when(F.size("longer") == 1, "node").when(F.size("longer") > 2, "long").when(F.get("longer", F.lit(0)) < F.get("longer", F.lit(1)), "edge").otherwise("circ"))
    kept = kept.withColumns({"path": F.coalesce("longer", "path"), "mate": F.when(F.col("longer").isNull(), F.col("mate"))})
    return kept.groupBy("gene", "kind", "path", "mate").agg(F.sum(value.cast("double")).alias("n"))


def steps(path: Column) -> Column:
    """The pairs of neighbours of a path, as arrays of two."""
    return F.when(F.size(path) > 1, F.transform(F.sequence(F.lit(1), F.size(path) - 1), lambda i: F.slice(path, i, 2))).otherwise(F.array().cast("array<array<int>>"))


def decomposed(counts: DataFrame) -> DataFrame:
    """counts with long paths and pairs given to the steps and nodes that they are made of.

    What a mate has that the first path has seen, both ends of a step or a node, isn't counted twice.
    """
    own = F.when(F.size("path") == 1, F.array("path")).otherwise(steps(F.col("path")))
    new = F.filter(steps(F.col("mate")), lambda s: ~(F.array_contains("path", s[0]) & F.array_contains("path", s[1])))
    other = F.when(F.col("mate").isNull(), F.array().cast("array<array<int>>")).when(F.size("mate") > 1, new).when(F.array_contains("path", F.get("mate", F.lit(0))), F.array().cast("array<array<int>>")).otherwise(F.array("mate"))
    parts = counts.select("gene", "n", F.explode(F.concat(own, other)).alias("path"))
    parts = parts.withColumn("kind", F.when(F.size("path") == 1, "node").when(F.get("path", F.lit(0)) < F.get("path", F.lit(1)), "edge").otherwise("circ"))
    return parts.groupBy("gene", "kind", "path").agg(F.sum("n").alias("n")).select("gene", "kind", "path", _none().alias("mate"), "n")


def compatible(keyed: DataFrame, annotated: DataFrame) -> DataFrame:
    """(key, transcripts) for rows (key, gene, path, mate): the sorted transcripts that have the node, or all steps.

    annotated: (gene, transcript, nodes). Steps meet steps by an equi-join, so a gene with many transcripts is no product.
    A row that no transcript has is left out.
    """
    asked = F.concat(F.when(F.size("path") == 1, F.array("path")).otherwise(steps(F.col("path"))), F.when(F.col("mate").isNull(), F.array().cast("array<array<int>>")).when(F.size("mate") == 1, F.array("mate")).otherwise(steps(F.col("mate"))))
    asked = keyed.select("key", "gene", F.array_distinct(asked).alias("asked")).select("key", "gene", F.size("asked").alias("wanted"), F.explode("asked").alias("part"))
    given = annotated.select("gene", "transcript", F.col("nodes").cast("array<int>").alias("nodes")).select("gene", "transcript", F.explode(F.concat(F.transform("nodes", lambda n: F.array(n)), steps(F.col("nodes")))).alias("part"))
    met = asked.join(given, ["gene", "part"]).groupBy("key", "gene", "wanted", "transcript").agg(F.count(F.lit(1)).alias("n")).where("n = wanted")
    return met.groupBy("key").agg(F.array_sort(F.collect_set(F.struct("gene", "transcript"))).alias("transcripts"))


def classes(counts: DataFrame, annotated: DataFrame) -> DataFrame:
    """(transcripts, n): counts by the transcripts that they may come from, circles and what none has left out."""
    kept = counts.where("kind != 'circ' and n > 0").withColumn("key", F.struct("gene", "path", "mate"))
    return kept.join(compatible(kept, annotated), "key").groupBy("transcripts").agg(F.sum("n").alias("n"))


def multi_counts(aligned: DataFrame) -> DataFrame:
    """(places, n) of the reads with several alignments; places: an array of (gene, path, mate), in order."""
    if "alignments" in aligned.columns:
        places = F.transform("alignments", lambda a: F.struct(a["gene"].alias("gene"), nodes_of(a).alias("path"), _none().alias("mate")))
        several = F.size("alignments") > 1
    else:
        places = F.zip_with("first", "second", lambda a, b: F.struct(a["gene"].alias("gene"), nodes_of(a).alias("path"), nodes_of(b).alias("mate")))
        several = F.size("first") > 1
    return aligned.where(several).groupBy(places.alias("places")).agg(F.count(F.lit(1)).cast("double").alias("n"))


def multi_classes(multi: DataFrame, annotated: DataFrame) -> DataFrame:
    """(places, n, transcripts, whole): the transcripts of all places; whole is false, and none is given, if a place has none."""
    each = multi.select("places", F.posexplode("places").alias("i", "p")).select("places", "i", "p.gene", "p.path", "p.mate").withColumn("key", F.struct("places", "i"))
    found = compatible(each, annotated).select(F.col("key.places").alias("places"), F.explode("transcripts").alias("t"), "key.i")
    by = found.groupBy("places").agg(F.array_sort(F.collect_set("t")).alias("transcripts"), F.count_distinct("i").alias("met"))
    out = multi.join(by, "places", "left").withColumn("whole", F.coalesce(F.col("met") == F.size("places"), F.lit(False)))
    return out.select("places", "n", F.when(F.col("whole"), F.col("transcripts")).otherwise(F.array().cast(out.schema["transcripts"].dataType)).alias("transcripts"), "whole")


def rates(counts: np.ndarray, lengths: np.ndarray, read_length: int, digits: int) -> np.ndarray:
    """Transcripts per million by counts over effective lengths, rounded (digits > 0)."""
    rate = counts / np.maximum(lengths - read_length, 1.0)
    scaled = rate * 1e6 / max(rate.sum(), 1.0)
    return np.round(scaled, digits) if digits > 0 else scaled


def expectation(unique: np.ndarray, lengths: np.ndarray, member: np.ndarray, of: np.ndarray, weight: np.ndarray, read_length: int = 50, digits: int = 1, most: int = 10_000, finish: bool = True) -> tuple[np.ndarray, np.ndarray, int]:
    """(tpm, counts, rounds) by expectation and maximization.

    unique: counts by transcript; member, of: transcript and class of each membership; weight: counts by class. Shares
    are rounded to four digits, and a class whose shares don't change is settled. The rounds end when no rounded
    abundance changes. finish: classes that weren't settled by then are added by their last shares.
    """
    count, size = unique.astype(float), np.bincount(of, minlength=len(weight))
    share = 1.0 / size[of] if len(of) else np.zeros(0)
    settled = np.zeros(len(weight), bool)
    tpm, before, rounds = rates(count, lengths, read_length, digits), None, 1
    while (before is None or (before != tpm).any()) and rounds < most:
        now, before = count.copy(), tpm
        fresh = np.zeros(len(weight), bool)
        if rounds > 1:
            total = np.bincount(of, tpm[member], len(weight))
            with np.errstate(all="ignore"):
                after = np.nan_to_num(np.round(tpm[member] / total[of], 4))
            changed = np.bincount(of, after != share, len(weight)) > 0
            open_ = ~settled[of]
            share[open_] = after[open_]
            fresh = ~settled & (~changed | (total == 0))
        part = share * weight[of]
        now += np.bincount(member, part * ~settled[of], len(count))
        count += np.bincount(member, part * fresh[of], len(count))
        settled |= fresh
        tpm = rates(now, lengths, read_length, digits)
        rounds += 1
    if finish:
        count += np.bincount(member, share * weight[of] * ~settled[of], len(count)) if len(of) else 0
    return tpm, count, rounds


def abundance(lengths: DataFrame, classes: DataFrame, read_length: int = 50, digits: int = 1, most: int = 10_000, largest: int = 20_000_000) -> DataFrame:
    """(gene, transcript, length, tpm, count) of lengths(gene, transcript, length) by the classes of all reads.

    Rounded abundances of all transcripts are normalized together, so the rounds run in one place, over arrays: what
    comes to the driver are transcripts and distinct classes, which the annotation bounds, not the reads. More than
    ``largest`` memberships are refused.
    """
    members = classes.where(F.size("transcripts") > 0)
    n = members.agg(F.sum(F.size("transcripts"))).first()[0] or 0
    if n > largest:
        raise ValueError(f"{n} memberships of classes are more than the {largest} that are solved in one place")
    tx = lengths.select("gene", "transcript", "length").orderBy("gene", "transcript").toPandas()
    place = {k: i for i, k in enumerate(zip(tx["gene"], tx["transcript"]))}
    unique, member, of, weight = np.zeros(len(tx)), [], [], []
    for row in members.toLocalIterator():
        own = [place[t["gene"], t["transcript"]] for t in row["transcripts"]]
        if len(own) == 1:
            unique[own[0]] += row["n"]
        else:
            member += own
            of += [len(weight)] * len(own)
            weight.append(row["n"])
    tpm, count, _ = expectation(unique, tx["length"].to_numpy(float), np.array(member, np.int64), np.array(of, np.int64), np.array(weight, float), read_length, digits, most)
    return lengths.sparkSession.createDataFrame(tx.assign(tpm=tpm, count=count)[["gene", "transcript", "length", "tpm", "count"]], lengths.select("gene", "transcript", "length", F.lit(0.0).alias("tpm"), F.lit(0.0).alias("count")).schema)


def gene_abundance(transcripts: DataFrame) -> DataFrame:
    """(gene, tpm, count): sums over transcripts."""
    return transcripts.groupBy("gene").agg(F.sum("tpm").alias("tpm"), F.sum("count").alias("count"))


def with_names(names: DataFrame, tpm: DataFrame) -> DataFrame:
    """names(name, ...) with the tpm of a file; 0 for those it doesn't have."""
    return names.join(tpm.select("name", F.col("tpm")), "name", "left").withColumn("tpm", F.coalesce("tpm", F.lit(0.0)))


def assigned(multi: DataFrame, annotated: DataFrame, transcripts: DataFrame) -> DataFrame:
    """counts of reads with several places, dealt by abundance; multi: the result of ``multi_classes``.

    A place's weight is that of the class's transcripts that have it, shares of their sum, which may be one transcript's
    for several places; if not all places are annotated, it is the gene's abundance. Without any weight nothing is dealt.
    """
    each = multi.select("places", "n", "transcripts", "whole", F.posexplode("places").alias("i", "p")).select("places", "n", "transcripts", "whole", "i", "p.gene", "p.path", "p.mate").withColumn("key", F.struct("places", "i"))
    share = multi.where("whole").select("places", F.explode("transcripts").alias("t")).select("places", "t.gene", "t.transcript").join(transcripts.select("gene", "transcript", "tpm"), ["gene", "transcript"])
    total = F.sum("tpm").over(Window.partitionBy("places"))
    share = share.select("places", "gene", "transcript", F.when(total > 0, F.round(F.col("tpm") / total, 4)).otherwise(0.0).alias("share"))
    has = compatible(each.where("whole"), annotated).select("key.places", "key.i", F.explode("transcripts").alias("t")).select("places", "i", "t.gene", "t.transcript")
    by_class = has.join(share, ["places", "gene", "transcript"]).groupBy("places", "i").agg(F.sum("share").alias("w"))
    by_gene = each.where("not whole").join(gene_abundance(transcripts).select("gene", "tpm"), "gene", "left").select("places", "i", F.coalesce("tpm", F.lit(0.0)).alias("w"))
    weighed = each.join(by_class.unionByName(by_gene), ["places", "i"])
    part = F.col("n") * F.col("w") / F.sum("w").over(Window.partitionBy("places"))
    dealt = weighed.withColumn("value", part).where("value > 0").select("gene", "path", "mate", F.col("value").alias("n"))
    return decomposed(dealt)


def added(*counts: DataFrame) -> DataFrame:
    """The sum of several counts."""
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out.groupBy("gene", "kind", "path", "mate").agg(F.sum("n").alias("n"))


def junctions(counts: DataFrame, nodes: DataFrame, genes: DataFrame, annotated: DataFrame) -> DataFrame:
    """(chrom, donor, acceptor, gene, l, r, class, n, strand) of the counted edges that a splice may leave and reach.

    class: CON_ANNO if every transcript that reaches around the edge has it, ALT_ANNO if some has, else ALT_UNIQ. On the
    reverse strand donor and acceptor are those of the chromosome's direction.
    """
    edges = counts.where("kind = 'edge'").select("gene", F.col("path")[0].alias("l"), F.col("path")[1].alias("r"), "n")
    left = nodes.where(F.col("edge_out").isin("LS", "LL", "LR")).select("gene", F.col("node").alias("l"), F.col("coord").alias("lc"), F.col("length").alias("ln"))
    right = nodes.where(F.col("edge_in").isin("SR", "RR", "LR")).select("gene", F.col("node").alias("r"), F.col("coord").alias("rc"), F.col("length").alias("rn"))
    kept = edges.join(left, ["gene", "l"]).join(right, ["gene", "r"])
    has = annotated.select("gene", "transcript", F.explode(steps(F.col("nodes").cast("array<int>"))).alias("s")).select("gene", F.col("s")[0].alias("l"), F.col("s")[1].alias("r")).groupBy("gene", "l", "r").agg(F.count(F.lit(1)).alias("have"))
    spans = annotated.groupBy("gene").agg(F.collect_list(F.struct(F.array_min("nodes").alias("a"), F.array_max("nodes").alias("b"))).alias("spans"))
    around = F.size(F.filter("spans", lambda s: (s["a"] <= F.col("l")) & (s["b"] >= F.col("r"))))
    kept = kept.join(has, ["gene", "l", "r"], "left").join(spans, "gene", "left").join(genes.select("gene", "chrom", "strand"), "gene")
    kind = F.when(F.col("have").isNull(), "ALT_UNIQ").when(F.col("have") == around, "CON_ANNO").otherwise("ALT_ANNO")
    forward = F.col("strand") == "+"
    donor, acceptor = F.when(forward, F.col("lc") + F.col("ln") - 1).otherwise(F.col("rc") + F.col("rn") - 1), F.when(forward, F.col("rc")).otherwise(F.col("lc"))
    return kept.select("chrom", donor.alias("donor"), acceptor.alias("acceptor"), "gene", "l", "r", kind.alias("class"), "n", "strand")


def mapping_statistics(counts: DataFrame, annotated: DataFrame, total: int, mapped: int, multi: int, read_length: int) -> DataFrame:
    """One row: reads within nodes and over edges, edges, those that a transcript has, and their percentages to two digits."""
    from lariat.functions.sequence import significant

    edges = counts.where("kind = 'edge'").select("gene", F.col("path").alias("s"), "n")
    has = annotated.select("gene", F.explode(steps(F.col("nodes").cast("array<int>"))).alias("s")).distinct().withColumn("known", F.lit(True))
    over = edges.join(has, ["gene", "s"], "left").agg(F.round(F.coalesce(F.sum("n"), F.lit(0.0))).cast("long").alias("junction_reads"), F.count(F.lit(1)).alias("junctions"), F.round(F.coalesce(F.sum(F.when(F.col("known"), F.col("n"))), F.lit(0.0))).cast("long").alias("annotated_reads"), F.count_if("known").alias("annotated_junctions"))
    body = counts.where("kind = 'node'").agg(F.round(F.coalesce(F.sum("n"), F.lit(0.0))).cast("long").alias("body_reads"))
    row = body.join(F.broadcast(over)).withColumns({"total": F.lit(total).cast("long"), "mapped": F.lit(mapped).cast("long"), "multi": F.lit(multi).cast("long"), "read_length": F.lit(read_length).cast("long"), "novel_junctions": F.col("junctions") - F.col("annotated_junctions")})
    percent = lambda a, b: F.when(b > 0, significant(100.0 * a / b, 2))
    c = F.col
    reads = c("body_reads") + c("junction_reads")
    return row.withColumns({"mapped_percent": percent(c("mapped"), c("total")), "multi_percent": percent(c("multi"), c("mapped")), "body_percent": percent(c("body_reads"), reads), "junction_percent": percent(c("junction_reads"), reads), "annotated_percent": percent(c("annotated_reads"), c("junction_reads")), "novel_percent": percent(c("novel_junctions"), c("junctions"))})


def effective_lengths(nodes: DataFrame) -> DataFrame:
    """(gene, node, length): a node's effective length is its length."""
    return nodes.select("gene", "node", F.col("length").cast("double").alias("length"))
