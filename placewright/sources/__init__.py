"""Sources and sinks with explicit schemas."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..core import lexicon as lx
from ..core import tagger
from ..functions import scalar

TAGGED = "language string, country string, address string"
GEONAMES = (
    "geonames_id long, name string, ascii_name string, alternate_names string, latitude double, longitude double, feature_class string, feature_code string, country_code string, cc2 string, "
    "admin1_code string, admin2_code string, admin3_code string, admin4_code string, population long, elevation int, dem int, timezone string, modified date"
)
ALTERNATE_NAMES = "alternate_name_id long, geonames_id long, iso_language string, alternate_name string, is_preferred_name int, is_short_name int, is_colloquial int, is_historic int"
POSTAL_CODES = "country_code string, postal_code string, place_name string, admin1_name string, admin1_code string, admin2_name string, admin2_code string, admin3_name string, admin3_code string, latitude double, longitude double, accuracy int"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """One address a line: (value)."""
    return spark.read.text(path)


def write_expansions_json(df: DataFrame, path: str, column: str = "expansions") -> None:
    """Lines of ``{"expansions": [...]}``."""
    df.select(F.to_json(F.struct(F.col(column).alias("expansions"))).alias("value")).write.text(path)


def parse_json(column: str = "parsed"):
    """A parse as a JSON object of label to value; a repeated label's values are joined by a space."""
    return F.to_json(F.map_from_entries(F.transform(F.array_distinct(F.transform(column, lambda e: e["label"])), lambda k: F.struct(k, F.concat_ws(" ", F.transform(F.filter(column, lambda e: e["label"] == k), lambda e: e["value"]))))))


def read_dictionaries(spark: SparkSession, root: str) -> DataFrame:
    """(lang, dict, phrase, canonical) of ``<lang>/<dict>.txt`` files of ``canonical|form|form`` lines.

    An unknown file name, a closing brace or an empty form is an error of the line's task.
    """
    lines = spark.read.text(f"{root}/*/*.txt").select("value", F.input_file_name().alias("file")).where("trim(value) <> '' and not startswith(trim(value), '#')")
    name = F.regexp_extract("file", r"([^/]+)/([^/]+)\.txt$", 1)
    kind = F.regexp_extract("file", r"([^/]+)/([^/]+)\.txt$", 2)
    forms = F.transform(F.split("value", r"\|"), lambda p: F.trim(p))
    good = kind.isin(list(lx.ROLES)) & ~F.contains("value", F.lit("}")) & ~F.array_contains(forms, "")
    checked = F.when(good, forms).otherwise(F.raise_error(F.concat(F.lit("bad dictionary line in "), F.col("file"), F.lit(": "), F.col("value"))).cast("array<string>"))
    rows = lines.select(name.alias("lang"), kind.alias("dict"), checked.alias("forms"))
    return rows.select("lang", "dict", F.explode("forms").alias("phrase"), F.col("forms")[0].alias("canonical"))


_RULE_KEYS = {"name", "value", "type", "left", "right", "gender", "category", "radix", "multiply_gte", "exact_multiple_only", "concat_only"}
_FILE_KEYS = {"rules", "ordinal_indicators", "stopwords", "whole_words_only"}


def read_numex(spark: SparkSession, root: str) -> DataFrame:
    """(lang, name, value, type, left, right, gender, category, whole_words_only) of ``<lang>.yaml`` files.

    These are a few small files; they are read on the driver, and unknown keys are errors.
    """
    import yaml

    rows = []
    for file in sorted(os.listdir(root)):
        if not file.endswith(".yaml"):
            continue
        with open(os.path.join(root, file), encoding="utf-8") as f:
            data = yaml.safe_load(f) or {}
        if unknown := set(data) - _FILE_KEYS:
            raise ValueError(f"{file}: unknown keys {sorted(unknown)}")
        for r in data.get("rules", []):
            if unknown := set(r) - _RULE_KEYS:
                raise ValueError(f"{file}: unknown keys {sorted(unknown)}")
            text = lambda k, r=r: None if r.get(k) is None else str(r[k])
            rows.append((file[:-5], str(r["name"]), int(r["value"]), text("type"), text("left"), text("right"), text("gender"), text("category"), bool(data.get("whole_words_only"))))
    return spark.createDataFrame(rows, "lang string, name string, value long, type string, left string, right string, gender string, category string, whole_words_only boolean")


def read_tagged(spark: SparkSession, path: str) -> DataFrame:
    """(language, country, tokens): tagged addresses; a token's label follows its last slash. A line
    without three columns is an error."""
    lines = spark.read.text(path).select(F.split("value", "\t").alias("p"))
    checked = lines.select(F.when(F.size("p") == 3, F.col("p")).otherwise(F.raise_error(F.lit("a tagged line needs three columns")).cast("array<string>")).alias("p"))
    tokens = scalar(lambda s: [{"token": a, "label": b} for a, b in tagger.read_tagged(s)], "array<struct<token:string,label:string>>", F.col("p")[2])
    return checked.select(F.col("p")[0].alias("language"), F.col("p")[1].alias("country"), tokens.alias("tokens"))


def read_language_training(spark: SparkSession, path: str, languages: list[str] | None = None) -> DataFrame:
    """(language, country, address) without unknown or mixed languages and empty addresses."""
    df = spark.read.csv(path, sep="\t", schema=TAGGED, quote="")
    df = df.where("language not in ('unk', 'xxx') and trim(address) <> ''")
    return df.where(F.col("language").isin(languages)) if languages else df


def read_geonames(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema=GEONAMES, quote="")


def read_alternate_names(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema=ALTERNATE_NAMES, quote="")


def read_postal_codes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema=POSTAL_CODES, quote="")


def write_store(df: DataFrame, path: str, key: str = "country_code") -> None:
    """A lookup table, partitioned so that a lookup reads one part."""
    df.write.partitionBy(key).parquet(path)


def lookup(keys: DataFrame, store: DataFrame, key: str) -> DataFrame:
    return keys.join(store, key)


def read_osm(spark: SparkSession, path: str) -> DataFrame:
    """(id, type, tags, deps) of an OSM XML file; ids carry their type's offset."""
    tag = "array<struct<_k:string,_v:string>>"
    schemas = {
        "node": f"_id long, _lat double, _lon double, tag {tag}",
        "way": f"_id long, nd array<struct<_ref:long>>, tag {tag}",
        "relation": f"_id long, member array<struct<_ref:long,_role:string,_type:string>>, tag {tag}",
    }
    offsets = {"node": 0, "way": 10**15, "relation": 2 * 10**15}
    parts = []
    for kind, schema in schemas.items():
        df = spark.read.format("xml").option("rowTag", kind).schema(schema).load(path)
        deps = {"node": F.array().cast("array<long>"), "way": F.transform("nd", lambda n: n["_ref"]) if kind == "way" else None, "relation": F.transform("member", lambda m: m["_ref"] + F.when(m["_type"] == "way", offsets["way"]).when(m["_type"] == "relation", offsets["relation"]).otherwise(0)) if kind == "relation" else None}[kind]
        lat, lon = (F.col("_lat"), F.col("_lon")) if kind == "node" else (F.lit(None).cast("double"),) * 2
        tags = F.map_from_entries(F.coalesce(F.transform("tag", lambda t: F.struct(t["_k"].alias("k"), t["_v"].alias("v"))), F.array().cast("array<struct<k:string,v:string>>")))
        parts.append(df.select((F.col("_id") + offsets[kind]).alias("id"), F.lit(kind).alias("type"), tags.alias("tags"), F.coalesce(deps, F.array().cast("array<long>")).alias("deps"), lat.alias("lat"), lon.alias("lon")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


_RING = "array<array<double>>"


def read_geojson(spark: SparkSession, path: str, properties: str) -> DataFrame:
    """(properties, rings) of lines of GeoJSON features; Polygon and MultiPolygon rings as (lon, lat)."""
    lines = spark.read.text(path).where("trim(value) <> ''")
    kind = F.get_json_object("value", "$.geometry.type")
    raw = F.get_json_object("value", "$.geometry.coordinates")
    rings = F.when(kind == "Polygon", F.from_json(raw, f"array<{_RING}>")).otherwise(F.flatten(F.from_json(raw, f"array<array<{_RING}>>")))
    named = F.transform(rings, lambda r: F.transform(r, lambda p: F.struct(p[0].alias("lon"), p[1].alias("lat"))))
    return lines.select(F.from_json(F.get_json_object("value", "$.properties"), properties).alias("properties"), named.alias("rings"))


def read_openaddresses(spark: SparkSession, sources: list[dict]) -> DataFrame:
    """(source, country, components): CSV files, each with its own mapping of fields to columns.

    A source: {"path", "name", "country", "fields": {component: column}}.
    """
    out = None
    for s in sources:
        df = spark.read.csv(s["path"], header=True)
        present = [F.struct(F.lit(k).alias("label"), F.trim(F.col(c)).alias("value")) for k, c in s["fields"].items() if c in df.columns]
        entries = F.filter(F.array(*present), lambda e: e["value"].isNotNull() & (e["value"] != ""))
        part = df.select(F.lit(s["name"]).alias("source"), F.lit(s["country"]).alias("country"), entries.alias("components"))
        out = part if out is None else out.unionByName(part)
    return out


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.csv(path, sep="\t", quote="", escapeQuotes=False)


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.json(path)


SINKS: dict[str, Callable] = {"json": write_json_lines, "tsv": write_tsv, "expansions": write_expansions_json}
