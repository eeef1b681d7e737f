"""Ordering, uniqueness, sampling and splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def sort_unique(df: DataFrame, by: list[Column | str], order: list[Column]) -> DataFrame:
    """The first row of each group in an order; the group is one aggregation key, no global sort."""
    return df.withColumn("__n", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where("__n = 1").drop("__n")


def top_per_group(df: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= n)


def most_common_first(df: DataFrame, count: str, tie: str, n: int | None = None) -> DataFrame:
    out = df.orderBy(F.desc(count), tie)
    return out.limit(n) if n else out


def shuffled(df: DataFrame, seed: int, *key: str) -> DataFrame:
    """A random order that reruns repeat: by a hash of the rows' key."""
    return df.orderBy(F.xxhash64(F.lit(seed), *(key or df.columns)))


def drawn(seed: int, key: str) -> Column:
    """A number in [0, 1) from a hash of the key that any engine can compute: the first 32 bits of an MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string"))), 1, 8), 16, 10).cast("long") / F.lit(2.0**32)


def split(df: DataFrame, key: str, shares: dict[str, float], seed: int = 0) -> DataFrame:
    """``df`` with ``split``: parts by a hash of the key, the same on every run and machine."""
    u = drawn(seed, key)
    out, upto = F.lit(list(shares)[-1]), 1.0
    for name, share in reversed(list(shares.items())):
        upto -= share
        out = F.when(u >= upto, F.lit(name)).otherwise(out) if name == list(shares)[-1] else F.when(u < upto + share, F.lit(name)).otherwise(out)
    return df.withColumn("split", out)


def weighted_choice(key: str, cdf: list[float], labels: list[str], seed: int = 0) -> Column:
    """A label by a cumulative distribution, drawn by a hash of the key."""
    u = drawn(seed, key)
    out = F.lit(labels[-1])
    for p, label in reversed(list(zip(cdf, labels, strict=True))):
        out = F.when(u < p, label).otherwise(out)
    return out
