"""Gazetteer builds and training-data plans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..core import generate
from ..functions import scalar
from ..operators.joins import admin_chain, alternate_names
from ..operators.ordering import sort_unique


def place_names(geonames: DataFrame, countries: DataFrame, admin: list[tuple[DataFrame, list[str], str]], alternates: DataFrame) -> DataFrame:
    """Every name of every place with its administrative names; one row per (name, place, language)."""
    base = geonames.join(countries.select("country_code", F.col("name").alias("country_name")), "country_code")
    base = admin_chain(base, admin)
    names = alternate_names(base, alternates, "geonames_id", "name", ["post", "link", "iata", "icao", "faac", "abbr"])
    out = names.join(base.drop("name"), "geonames_id")
    return sort_unique(out, [F.lower("name"), "geonames_id"], [F.desc("is_canonical"), F.desc("population"), F.col("name")])


def postal_table(codes: DataFrame) -> DataFrame:
    """Per (postal code, country): distinct place names, most important first by name."""
    return codes.groupBy("postal_code", "country_code").agg(F.concat_ws(",", F.array_sort(F.collect_set("place_name"))).alias("places"), F.count("*").alias("n")).orderBy("postal_code", F.desc("n"), "country_code")


def formatted(rows: DataFrame, key: str, components: str, country: str = "", tagged: bool = True, inversion: float = 0.1) -> DataFrame:
    """(key, address) from maps of components by a country's template; draws are seeded by the key."""
    run = lambda k, c: generate.format_address(dict(c or {}), country, tagged, seed=int(k), inversion=inversion)
    return rows.select(key, scalar(run, "string", key, components).alias("address")).where("address is not null")


def expanded_components(rows: DataFrame, key: str, components: str, keep: dict[str, float]) -> DataFrame:
    """``components`` with random drop-out and added sub-building phrases, seeded by the key."""

    def run(k, c):
        seed = int(k)
        out = generate.drop_out(dict(c or {}), keep, seed)
        if "house_number" in out and seed % 3 == 0:
            out["unit"] = generate.sub_building("unit", seed)
        return [{"label": a, "value": b} for a, b in out.items()]

    return rows.withColumn(components, F.map_from_entries(scalar(run, "array<struct<label:string,value:string>>", key, components)))


def intersections(ways: DataFrame) -> DataFrame:
    """(node, names) where named ways meet; ``ways``: (id, tags, deps)."""
    from ..operators.joins import shared_nodes

    flat = ways.where(F.col("tags")["name"].isNotNull() & F.col("tags")["highway"].isNotNull()).select(F.explode("deps").alias("node"), F.col("tags")["name"].alias("name"))
    return shared_nodes(flat, "node", "name")


def admin_component(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """``rows`` (id, key, value, country) with the component of the first rule that applies: rules are
    (priority, id, country, key, value, component), nulls matching anything."""
    match = lambda c: F.col(f"u.{c}").isNull() | (F.col(f"u.{c}") == F.col(f"r.{c}"))
    hits = rows.alias("r").join(rules.alias("u"), (F.col("r.key") == F.col("u.key")) & match("id") & match("country") & match("value"), "left")
    return hits.groupBy("r.id", "r.key", "r.value", "r.country").agg(F.min_by("u.component", "u.priority").alias("component"))


def pick_name(tags: str, keys: list[tuple[str, float]], key: str):
    """A name of a boundary by weighted choice among the name keys it has, seeded by its id."""

    def run(k, t):
        import random

        have = [(n, w) for n, w in keys if (t or {}).get(n)]
        return t[random.Random(int(k)).choices([n for n, _ in have], [w for _, w in have])[0]] if have else None

    return scalar(lambda k, t: run(k, dict(t or {})), "string", key, tags)
