"""Phrase dictionaries as DataFrames, and matching as joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..core import lexicon as lx

SCHEMA = "lang string, dict string, phrase string, canonical string"
#: A dictionary of at most this many rows is broadcast; a larger one is joined by shuffle.
BROADCAST_ROWS = 500_000


def default_rows(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(lx.default_rows()), SCHEMA)


def gazetteers(spark: SparkSession) -> DataFrame:
    """The role masks of each dictionary kind."""
    rows = [(k, r.kind, r.base, r.ignorable, r.valid, r.edge, r.specifier, r.root) for k, r in lx.ROLES.items()]
    return spark.createDataFrame(rows, "dict string, dict_id int, base int, ignorable int, valid int, edge int, specifier int, root int")


#: Bundles of dictionaries by use.
BUNDLES = {
    "street_types": ["street_types", "directionals", "concatenated_suffixes_separable", "concatenated_suffixes_inseparable", "concatenated_prefixes_separable"],
    "names": ["given_names", "surnames", "personal_titles", "personal_suffixes", "academic_degrees", "people", "organizations", "company_types", "place_names"],
    "units": ["unit_types_numbered", "unit_types_standalone", "unit_directions", "level_types_numbered", "level_types_standalone", "level_types_basement", "level_types_sub_basement", "level_types_mezzanine", "entrances", "staircases"],
    "toponyms": ["toponyms", "qualifiers"],
    "venues": ["place_names", "chains", "categories", "building_types"],
}


def bundle(rows: DataFrame, name: str) -> DataFrame:
    return rows.where(F.col("dict").isin(BUNDLES[name]))


def build(rows: DataFrame, roles: DataFrame) -> DataFrame:
    """Per (lang, phrase): OR of the base masks, and its readings with their dictionaries."""
    per = rows.join(F.broadcast(roles.select("dict", "base")), "dict").groupBy("lang", "phrase", "canonical").agg(F.bit_or("base").alias("components"), F.array_sort(F.collect_set("dict")).alias("dicts"))
    reading = F.struct("canonical", (F.col("canonical") == F.col("phrase")).alias("is_canonical"), "dicts")
    return per.groupBy("lang", "phrase").agg(F.bit_or("components").cast("int").alias("components"), F.array_sort(F.collect_list(reading)).alias("readings"))


def held(dictionary: DataFrame) -> DataFrame:
    """The dictionary for broadcast, if a count shows that it is small."""
    return F.broadcast(dictionary) if dictionary.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else dictionary


def in_languages(dictionary: DataFrame, *languages: str) -> DataFrame:
    """The phrases of these languages and of all languages; without languages, everything."""
    return dictionary.where(F.col("lang").isin(*languages, "all")) if languages else dictionary


def has_role(dict_masks: Column, components: int) -> Column:
    return dict_masks.bitwiseAND(F.lit(components)) != 0


def exact_lookup(df: DataFrame, column: str, dictionary: DataFrame) -> DataFrame:
    """Rows whose whole value is a phrase."""
    return df.join(held(dictionary), F.col(column) == F.col("phrase"))


def token_ngrams(df: DataFrame, key: str, tokens: str, longest: int) -> DataFrame:
    """(key, start, len, gram): every run of up to ``longest`` tokens."""
    t = F.col("__t")
    df = df.select(key, F.col(tokens).alias("__t"))
    grams = F.flatten(F.transform(t, lambda _, i: F.transform(F.sequence(F.lit(1), F.least(F.lit(longest), F.size(t) - i)), lambda n: F.struct(i.alias("start"), n.alias("len"), F.concat_ws(" ", F.slice(t, i + 1, n)).alias("gram")))))
    return df.where(F.size(t) > 0).select(key, F.explode(grams).alias("g")).select(key, "g.start", "g.len", "g.gram")


def longest_matches(df: DataFrame, key: str, tokens: str, phrases: DataFrame, longest: int = 4) -> DataFrame:
    """(key, start, len, phrase): greedy longest matches from the left, without overlap.

    Candidates come from one join of n-grams; the greedy choice is a fold over a row's own matches.
    """
    hits = token_ngrams(df, key, tokens, longest).join(held(phrases.select("phrase").distinct()), F.col("gram") == F.col("phrase")).select(key, "start", "len", "phrase")
    hits = hits.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("start", (-F.col("len")).alias("neg"), "phrase"))).alias("m"))
    none = F.array().cast("array<struct<start:int,neg:int,phrase:string>>")
    start = F.struct(F.lit(0).alias("at"), none.alias("out"))
    fold = F.aggregate("m", start, lambda acc, x: F.when(x["start"] >= acc["at"], F.struct((x["start"] - x["neg"]).alias("at"), F.concat(acc["out"], F.array(F.struct(x["start"].alias("start"), x["neg"].alias("neg"), x["phrase"].alias("phrase")))).alias("out"))).otherwise(acc), lambda acc: acc["out"])
    return hits.select(key, F.explode(fold).alias("x")).select(key, "x.start", (-F.col("x.neg")).alias("len"), "x.phrase")


def suffix_matches(df: DataFrame, column: str, suffixes: DataFrame, longest: int = 12) -> DataFrame:
    """Each row with the longest stored suffix that is shorter than its value; no non-equi join."""
    return _affix(df, column, suffixes, longest, lambda s, k: F.right(s, k))


def prefix_matches(df: DataFrame, column: str, prefixes: DataFrame, longest: int = 12) -> DataFrame:
    return _affix(df, column, prefixes, longest, lambda s, k: F.left(s, k))


def _affix(df: DataFrame, column: str, affixes: DataFrame, longest: int, cut) -> DataFrame:
    s = F.col(column)
    n = F.least(F.lit(longest), F.length(s) - 1)
    parts = F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda k: cut(s, k)))
    rows = df.withColumn("__row", F.struct(*[F.col(c) for c in df.columns])).select("__row", F.explode(parts).alias("affix"))
    hit = rows.join(held(affixes.select(F.col("phrase").alias("affix")).distinct()), "affix")
    return hit.groupBy("__row").agg(F.max_by("affix", F.length("affix")).alias("affix")).select("__row.*", "affix")
