"""Joins of the reference pipeline, and candidate pairs from blocking keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import written


def admin_chain(places: DataFrame, levels: list[tuple[DataFrame, list[str], str]]) -> DataFrame:
    """Chained left joins on composite keys; each level: (codes, key columns, name of the new column).

    ``codes`` has the keys and ``name``. Sides are left to the planner's statistics.
    """
    for codes, keys, new in levels:
        places = places.join(codes.select(*keys, F.col("name").alias(new)), keys, "left")
    return places


def alternate_names(places: DataFrame, alternates: DataFrame, key: str, name: str, drop_kinds: list[str]) -> DataFrame:
    """Canonical names and, as rows of their own, alternate ones that differ and aren't of a dropped kind."""
    kept = alternates.where(~F.col("kind").isin(drop_kinds)).withColumnRenamed("name", "alternate")
    other = places.join(kept, key).where(F.col("alternate") != F.col(name)).select(key, F.col("alternate").alias(name), F.lit(False).alias("is_canonical"))
    return places.select(key, name, F.lit(True).alias("is_canonical")).unionByName(other)


def existing(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return df.join(keys.select(key).distinct(), key, "left_semi")


def missing(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't among ``keys``; null keys are no match, on either side."""
    return df.join(keys.where(F.col(key).isNotNull()).select(key).distinct(), key, "left_anti")


def child_counts(parents: DataFrame, children: DataFrame, key: str, condition) -> DataFrame:
    """Parents with the number of children, and of those that satisfy a condition; counted once before the join."""
    counts = children.groupBy(key).agg(F.count("*").alias("n_children"), F.count_if(condition).alias("n_matching"))
    return parents.join(counts, key, "left").fillna(0, ["n_children", "n_matching"])


def shared_nodes(ways: DataFrame, node: str, name: str) -> DataFrame:
    """Nodes that more than one distinct way name goes through, with the sorted names."""
    names = ways.select(node, name).distinct().groupBy(node).agg(F.array_sort(F.collect_list(name)).alias("names"))
    return names.where(F.size("names") > 1)


def blocking_pairs(df: DataFrame, key_column: str, id_column: str, block: int = 2_000, carry: tuple[str, ...] = ()) -> DataFrame:
    """(id1, id2), id1 < id2: rows that share a key, each pair once; with ``carry``, also these columns of both
    rows, called ``name_1`` and ``name_2``.

    A key's rows are numbered into blocks of about ``block`` by a hash of the id, and block meets
    block, so a popular key is many small joins instead of one large one. Nothing is capped. A pair comes
    from the smallest key that its rows share, so pairs are neither moved nor held to find repeated ones.
    """
    keys = F.array_compact(key_column)
    rows = df.select(F.col(id_column).alias("id"), keys.alias("keys"), *carry).groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("keys"))).alias("keys"), *(F.first(c).alias(c) for c in carry))
    rows = written(rows)
    size = rows.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key", F.ceil(F.col("n") / block).cast("int").alias("parts"))
    keyed = rows.select("*", F.explode("keys").alias("key")).join(size, "key").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts").cast("long")).cast("int"))
    own = ("id", "keys", *carry)
    left = keyed.select("key", *(F.col(c).alias(f"a_{c}") for c in own), F.col("part").alias("low"), F.explode(F.sequence("part", F.col("parts") - 1)).alias("high"))
    right = keyed.select("key", *(F.col(c).alias(f"b_{c}") for c in own), F.explode(F.sequence(F.lit(0), "part")).alias("low"), F.col("part").alias("high"))
    once = (F.size("a_keys") == 1) | (F.size("b_keys") == 1) | (F.array_min(F.array_intersect("a_keys", "b_keys")) == F.col("key"))
    met = _meet(left, right, ["key", "low", "high"]).where(((F.col("low") < F.col("high")) | (F.col("a_id") < F.col("b_id"))) & once)
    first = F.col("a_id") < F.col("b_id")
    sides = lambda c: (F.when(first, F.col(f"a_{c}")).otherwise(F.col(f"b_{c}")), F.when(first, F.col(f"b_{c}")).otherwise(F.col(f"a_{c}")))
    out = [x.alias(f"id{k}") for k, x in enumerate(sides("id"), 1)]
    return met.select(*out, *(x.alias(f"{c}_{k}") for c in carry for k, x in enumerate(sides(c), 1)))


def all_pairs(df: DataFrame, id_column: str, block: int = 2_000) -> DataFrame:
    """Every pair of rows of unlike ids, with the columns of both as ``name_1`` and ``name_2``, the smaller id first;
    block meets block, so the pairs, which grow with the square of the rows, are spread and never held."""
    n = df.agg(F.count(id_column)).first()[0]
    parts = max(1, -(-n // block))
    rows = df.where(F.col(id_column).isNotNull()).withColumn("part", F.pmod(F.xxhash64(id_column), F.lit(parts)).cast("int"))
    left = rows.select(*(F.col(c).alias(f"a_{c}") for c in df.columns), F.col("part").alias("low"), F.explode(F.sequence("part", F.lit(parts - 1))).alias("high"))
    right = rows.select(*(F.col(c).alias(f"b_{c}") for c in df.columns), F.explode(F.sequence(F.lit(0), "part")).alias("low"), F.col("part").alias("high"))
    first = F.col(f"a_{id_column}") < F.col(f"b_{id_column}")
    met = _meet(left, right, ["low", "high"]).where((F.col("low") < F.col("high")) | first)
    side = lambda c, x, y: F.when(first, F.col(f"{x}_{c}")).otherwise(F.col(f"{y}_{c}"))
    return met.select(*(side(c, "a", "b").alias(f"{c}_1") for c in df.columns), *(side(c, "b", "a").alias(f"{c}_2") for c in df.columns))


def _meet(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Join of two sides whose rows are few for a key but whose result is much larger: in as many parts as
    shuffles have, which aren't put together by the sides' few bytes, and never by broadcast."""
    n = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return left.repartition(n, *keys).join(right.repartition(n, *keys).hint("merge"), keys)


def feature_scores(features: DataFrame, weights: DataFrame, key: str, most: int = 500_000) -> DataFrame:
    """Sum of class weights over a row's features: (key, label, score); ``features``: (key, feature, value), where a
    feature may have several rows.

    A feature's weights are one row. Where these are at most ``most`` they go to the features, which then stay
    where they are; else each feature of a row is moved once.
    """
    by_feature = written(weights.groupBy("feature").agg(F.collect_list(F.struct("label", "weight")).alias("w")))
    if by_feature.count() <= most:
        met = features.join(F.broadcast(by_feature), "feature")
    else:
        met = features.groupBy(key, "feature").agg(F.sum("value").alias("value")).join(by_feature, "feature")
    return met.select(key, "value", F.explode("w").alias("w")).groupBy(key, "w.label").agg(F.sum(F.col("value") * F.col("w.weight")).alias("score"))


def edge_exists(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """``pairs`` (a, b) with ``linked``: whether the edge is in the graph."""
    known = edges.select("a", "b").distinct().withColumn("linked", F.lit(True))
    return pairs.join(known, ["a", "b"], "left").fillna(False, ["linked"])


def group_edges(left: DataFrame, right: DataFrame, edges: DataFrame, block: int = 2_000) -> DataFrame:
    """(a, b, linked): every pair of ``left`` (a, place) and ``right`` (b, place) of one place, and whether its edge
    is in the graph.

    The pairs are many and are made last: a row of ``left`` takes along its edges to a block of its place's
    rows of ``right``, which are cut into blocks of about ``block``, and no pair is moved.
    """
    left, right = left.select("a", "place").where("place IS NOT NULL"), right.select("b", "place").where("place IS NOT NULL")
    count = lambda df, name: df.groupBy("place").agg(F.ceil(F.count("*") / block).cast("int").alias(name))
    parts = count(left, "l_parts").join(count(right, "r_parts"), "place")
    part = lambda c, n: F.pmod(F.xxhash64(c), F.col(n).cast("long")).cast("int")
    rights = right.join(parts, "place").withColumn("high", part("b", "r_parts"))
    links = edges.select("a", "b").where("b IS NOT NULL").distinct().join(rights.select("b", "place", "high").distinct(), "b").groupBy("a", "place", "high").agg(F.collect_list("b").alias("links"))
    lefts = left.join(parts, "place").select("a", "place", part("a", "l_parts").alias("low"), F.explode(F.sequence(F.lit(0), F.col("r_parts") - 1)).alias("high"))
    lefts = lefts.join(links, ["a", "place", "high"], "left").select("a", "links", "place", "low", "high")
    rights = rights.select("b", "place", F.explode(F.sequence(F.lit(0), F.col("l_parts") - 1)).alias("low"), "high")
    return _meet(lefts, rights, ["place", "low", "high"]).select("a", "b", F.coalesce(F.array_contains("links", F.col("b")), F.lit(False)).alias("linked"))
