"""Mixing sources to target weights by hash-threshold histograms.

Each document has a 60-bit hash of its identity. Words are summed by source and leading hash bits;
the bucket in which a source's budget ends is found by a running sum over at most 1,024 buckets,
and only this bucket is split again by the next ten bits, until it holds one hash value. The
result is one threshold per source and budget: a document is taken if its hash is at most the
threshold, so no sort of documents is needed, a smaller budget's sample lies inside a larger one's,
and reruns agree. Everything is DataFrame code; skewed sources are pre-aggregated.

A source whose target exceeds its size is repeated whole as often as it fits, and the rest is
chosen by the threshold. The document at the boundary is taken whole if that brings the sum nearer
to the budget.

Defined cases: null text has size 0; a null source is a source of its own, last in order; rows that are
equal in doc_id and text share one hash: if they lie at the boundary, a second threshold over row
numbers of a written table takes as many of them as the budget needs, and which of such equal rows
is taken shows in no column of ``mix``; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import Scratch, small, unused

BITS, LEVEL = 60, 10
MAX_SOURCES = 100_000
CAP = 3
WEIGHTS = (5, 2, 1)


def word_count(text: Column) -> Column:
    """The number of runs of other than ASCII white space."""
    space = r"[\x20\x09-\x0D]"
    text = F.coalesce(text, F.lit(""))
    parts = F.size(F.split(text, space + "+")) - F.when(text.rlike("^" + space), 1).otherwise(0) - F.when(text.rlike(space + r"\z"), 1).otherwise(0)
    return F.when(text == "", 0).otherwise(parts).cast("long")


def hash60(doc_id: Column, text: Column) -> Column:
    """Leading 60 bits of the MD5 of a document's id and text."""
    key = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("|"), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long")


def source_key(source: Column) -> Column:
    """A key without null that sorts by code point, null last."""
    return F.when(source.isNull(), "1").otherwise(F.concat(F.lit("0"), source))


def sizes_of(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", source_key(F.col("source")).alias("skey"), word_count(F.col("text")).alias("size"), hash60(F.col("doc_id"), F.col("text")).alias("h"))


def ranked(sources: DataFrame, scratch: Scratch) -> DataFrame:
    """``sources`` (one row each) with ``rank`` from 0 in order of skey, counted by range
    partitions and the partitions' running totals, never in one task."""
    parts = scratch.write(sources.repartitionByRange("skey").withColumn("pid", F.spark_partition_id()), "ranges")
    before = W.orderBy("pid").rowsBetween(W.unboundedPreceding, -1)  # one row per partition
    offsets = parts.groupBy("pid").agg(F.count("*").alias("n")).withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    within = F.row_number().over(W.partitionBy("pid").orderBy("skey")) - 1
    return parts.join(F.broadcast(offsets), "pid").withColumn("rank", within + F.col("offset")).drop("pid", "offset")


def targets(sources: DataFrame, cap: int = CAP) -> DataFrame:
    """Share the total of ``source_size`` by ``weight``, none above ``cap`` times its source.

    ``sources``: (skey, source_size, weight). The excess is shared again by weight until no target
    is above its cap: each round is one aggregate, and a round saturates at least one source more.
    """
    full = F.lit(cap) * F.col("source_size")
    share, held = None, -1
    total = sources.agg(F.sum("source_size").alias("t")).first().t or 0
    while True:
        over = F.lit(False) if share is None else full < F.col("weight") * F.lit(share)
        row = sources.agg(
            F.sum(F.when(over, 1).otherwise(0)).alias("n"),
            F.sum(F.when(over, full).otherwise(0)).alias("filled"),
            F.sum(F.when(over, 0).otherwise(F.col("weight"))).alias("weight"),
        ).first()
        if row.n is None or row.n == held or not row.weight:
            break
        held, rest, weight = row.n, total - row.filled, row.weight
        share = rest / weight
    if share is None:
        return sources.withColumn("target", F.lit(0.0))
    part = (F.col("weight") * F.lit(rest)).cast("double") / F.lit(float(weight))
    return sources.withColumn("target", F.when(full < F.col("weight") * F.lit(share), full.cast("double")).otherwise(part))


def thresholds(sizes: DataFrame, budgets: DataFrame, scratch: Scratch) -> DataFrame:
    """(skey, budget, limit): the hash up to which a source's documents are taken so that their sizes sum
    to nearest ``budget``; ``budgets``: (skey, budget), only budgets above 0 get a row. Where several rows
    have the hash at the boundary, ``limit`` lies before it, ``edge`` is that hash and ``rest`` what the
    budget still needs of them.

    Budgets may be nested: a larger budget's limit is never smaller.
    """
    state = budgets.where("budget > 0").select("skey", "budget", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("base"))
    done = None
    for level in range(BITS // LEVEL):
        shift = BITS - LEVEL * (level + 1)
        bucket = F.shiftright("h", shift)
        inside = sizes.join(small(state, MAX_SOURCES), "skey").where(F.shiftright("h", shift + LEVEL) == F.col("prefix"))
        hist = inside.groupBy("skey", "budget", "base", bucket.alias("bucket")).agg(F.sum("size").alias("size"), F.min("h").alias("lo"), F.max("h").alias("hi"), F.count("*").alias("rows"))
        upto = F.col("base") + F.sum("size").over(W.partitionBy("skey", "budget").orderBy("bucket"))
        # the first bucket that reaches the budget, else the last one
        reach = F.row_number().over(W.partitionBy("skey", "budget").orderBy((F.col("upto") < F.col("budget")).cast("int"), F.when(F.col("upto") < F.col("budget"), -F.col("bucket")).otherwise(F.col("bucket"))))
        edge = scratch.write(hist.withColumn("upto", upto).withColumn("reach", reach).where("reach = 1"), f"level{level}")
        near = (F.col("upto") - F.col("budget")) <= (F.col("budget") - F.col("upto") + F.col("size"))
        alone = F.col("rows") == 1
        ready = edge.where("lo = hi").select(
            "skey", "budget", F.when(alone & near, F.col("lo")).otherwise(F.col("lo") - 1).alias("limit"),
            F.when(~alone, F.col("lo")).alias("edge"), F.when(~alone, F.col("budget") - F.col("upto") + F.col("size")).alias("rest"),
        )
        done = ready if done is None else done.unionByName(ready)
        state = edge.where("lo < hi").select("skey", "budget", F.col("bucket").alias("prefix"), (F.col("upto") - F.col("size")).alias("base"))
        if state.isEmpty():
            break
    return done


def split_edges(rows: DataFrame, plan: DataFrame, scratch: Scratch) -> DataFrame:
    """``plan`` with ``row_limit``, the threshold over the hashed row numbers of equal rows at the boundary.

    ``rows``: (skey, h, size, row) of a written table, whose row numbers stay as they are.
    """
    edges = small(plan.where("edge is not null").select(F.col("skey"), "edge", "rest"), MAX_SOURCES)
    if edges.isEmpty():
        return plan.withColumn("row_limit", F.lit(-1).cast("long"))
    inside = rows.join(edges, "skey").where(F.col("h") == F.col("edge")).select("skey", "size", row_hash().alias("h"))
    limits = thresholds(inside, edges.select("skey", F.col("rest").alias("budget")), scratch)
    return plan.join(limits.select("skey", F.col("limit").alias("row_limit")), "skey", "left").fillna(-1, ["row_limit"])


def row_hash() -> Column:
    return hash60(F.col("row"), F.lit(""))


def plan_of(documents: DataFrame, weights: tuple[int, ...], cap: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(sizes, plan): the documents' sizes, and per source skey, source_size, target, whole, limit, edge, rest."""
    sizes = scratch.write(sizes_of(documents).withColumn("row", F.monotonically_increasing_id()), "sizes")
    sums = scratch.write(sizes.groupBy("skey").agg(F.sum("size").alias("source_size")), "sources")
    cycle = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    sources = scratch.write(ranked(sums, scratch).withColumn("weight", cycle.cast("long")), "ranked")
    fits = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    goals = scratch.write(targets(sources, cap).withColumn("whole", F.least(fits, F.lit(cap))), "targets")
    limits = thresholds(sizes, goals.select("skey", (F.col("target") - F.col("whole") * F.col("source_size")).alias("budget")), scratch)
    plan = goals.join(limits, "skey", "left").select("skey", "source_size", "target", "whole", F.coalesce("limit", F.lit(-1)).alias("limit"), "edge", "rest")
    return sizes, scratch.write(plan, "plan")


def mix(documents: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """Per document row: doc_id, size, source_size, target, copies (how often the mix takes it)."""
    scratch = Scratch(documents.sparkSession, "mixing")
    sizes, plan = plan_of(documents, weights, cap, scratch)
    plan = split_edges(sizes, plan, scratch)
    chosen = (F.col("h") <= F.col("limit")) | ((F.col("h") == F.col("edge")) & (row_hash() <= F.col("row_limit")))
    copies = F.col("whole") + F.when(chosen, 1).otherwise(0)
    return sizes.join(small(plan, MAX_SOURCES), "skey").select("doc_id", "size", "source_size", "target", copies.alias("copies"))


def mixed(documents: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """``documents``, each row as often as the mix takes it; only the plan by source is joined."""
    scratch = Scratch(documents.sparkSession, "mixing")
    sizes, plan = plan_of(documents, weights, cap, scratch)
    scratch.drop(sizes)
    names = documents.columns
    key, whole, limit, edge, n = unused(documents, "plan_source", "plan_whole", "plan_limit", "plan_edge", "plan_copies")
    terms = small(plan.select(F.col("skey").alias(key), F.col("whole").alias(whole), F.col("limit").alias(limit), F.col("edge").alias(edge)), MAX_SOURCES)
    h = hash60(documents.doc_id, documents.text)
    rows = documents.join(terms, source_key(documents.source) == F.col(key))
    copies = F.col(whole) + F.when(h <= F.col(limit), 1).otherwise(0)

    def repeated(rows: DataFrame, copies: Column) -> DataFrame:
        return rows.withColumn(n, copies).where(F.col(n) > 0).withColumn(n, F.explode(F.sequence(F.lit(1).cast("long"), F.col(n)))).select(*names)

    if plan.where("edge is not null").isEmpty():
        return repeated(rows, copies)
    at_edge = F.coalesce(h == F.col(edge), F.lit(False))
    held = scratch.write(rows.where(at_edge).select(F.struct(*names).alias("doc"), F.col(key).alias("skey"), F.col(whole).alias("whole"), F.col(edge).alias("h"), word_count(F.col("text")).alias("size"), F.monotonically_increasing_id().alias("row")), "edges")
    limits = small(split_edges(held, plan, scratch).select("skey", "row_limit"), MAX_SOURCES)
    more = held.join(limits, "skey").select("doc.*", F.col("whole").alias(whole), (row_hash() <= F.col("row_limit")).alias(limit))
    return repeated(rows.where(~at_edge), copies).unionByName(repeated(more, F.col(whole) + F.when(F.col(limit), 1).otherwise(0)))
