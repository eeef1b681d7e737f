"""Dictionaries, expansion, keys, duplicates and spatial joins over addresses made from table keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import functions as fn
from ..core import lexicon as lx
from ..core.expand import Options
from ..operators import dictionary, joins, spatial
from ..plans import resolve
from . import query, table

_BASES = ["oak", "elm", "mill", "high", "lake", "hill", "king", "queen", "river", "forest", "bridge"]
_TYPES = ["St", "Ave", "Rd", "Blvd", "Ln"]
_FULL = ["street", "avenue", "road", "boulevard", "lane"]


def _sql(words):
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


_SYNTH = f"""a AS (SELECT o_orderkey AS id, CAST(o_orderkey % 999 + 1 AS VARCHAR) AS number, {_sql(_BASES)}[CAST(o_orderkey % 11 AS INTEGER) + 1] AS base,
{_sql(_TYPES)}[CAST(o_orderkey % 5 AS INTEGER) + 1] AS abbr, {_sql(_FULL)}[CAST(o_orderkey % 5 AS INTEGER) + 1] AS kind FROM orders)"""


def addresses(spark, d):
    """id, number, base, abbreviated and full street type, one address an order."""
    k = F.col("o_orderkey")
    pick = lambda words, n: F.get(F.array(*map(F.lit, words)), (k % n).cast("int"))
    return table(spark, d, "orders").select(k.alias("id"), (k % 999 + 1).cast("string").alias("number"), pick(_BASES, 11).alias("base"), pick(_TYPES, 5).alias("abbr"), pick(_FULL, 5).alias("kind"))


#: What a street type may stand for: all of its readings, with its own form where one of them isn't sure.
_READINGS = "CASE WHEN abbr = 'St' THEN ['saint', 'st', 'street'] ELSE [kind] END"


@query(f"WITH {_SYNTH} SELECT id, number || ' ' || base || ' ' || unnest({_READINGS}) AS expansion FROM a")
def expand_mini(spark, d):
    """Every expansion of each address."""
    a = addresses(spark, d).withColumn("raw", F.concat_ws(" ", "number", F.initcap("base"), "abbr"))
    return fn.spread(a).select("id", F.explode(fn.expand_address("raw", Options(languages=("en",)))).alias("expansion"))


@query(f"WITH {_SYNTH} SELECT id, base AS root FROM a")
def expand_root_mini(spark, d):
    """Every root of each street name."""
    a = addresses(spark, d).withColumn("raw", F.concat_ws(" ", F.initcap("base"), "abbr"))
    o = Options(languages=("en",), components=lx.STREET)
    return fn.spread(a).select("id", F.explode(fn.expand_address_root("raw", o)).alias("root"))


@query(f"""WITH {_SYNTH} SELECT id, unnest([number || ' ' || base || ' ' || x for x in CASE WHEN abbr = 'St' THEN ['street', 'saint'] ELSE [kind] END]) AS s FROM a""")
def expansion_product(spark, d):
    a = addresses(spark, d)
    forms = F.when(F.col("abbr") == "St", F.array(F.lit("street"), F.lit("saint"))).otherwise(F.array("kind"))
    return a.select("id", F.explode(fn.product_strings(F.array("number"), F.array("base"), forms)).alias("s"))


@query(f"""WITH {_SYNTH}, s AS (SELECT base, kind, min(id) AS first, count(*) AS n FROM a GROUP BY ALL) SELECT base, kind, first, n FROM s""")
def street_groups(spark, d):
    return addresses(spark, d).groupBy("base", "kind").agg(F.min("id").alias("first"), F.count("*").alias("n"))


_DICT = "[('st', 'street'), ('ave', 'avenue'), ('oak', 'oak'), ('oak st', 'oak street'), ('king ave', 'king avenue'), ('rd', 'road')]"


@query(f"""WITH {_SYNTH}, t AS (SELECT id, [number, base, lower(abbr)] AS w FROM a),
g AS (SELECT id, 1 AS start, 2 AS len, w[2] || ' ' || w[3] AS phrase FROM t UNION ALL SELECT id, i - 1, 1, w[i] FROM (SELECT id, w, unnest([1, 2, 3]) AS i FROM t)),
m AS (SELECT g.* FROM g JOIN (SELECT unnest(['st', 'ave', 'oak', 'oak st', 'king ave', 'rd']) AS p) ON phrase = p),
two AS (SELECT id FROM m WHERE len = 2)
SELECT id, CAST(start AS INTEGER) AS start, CAST(len AS INTEGER) AS len, phrase FROM m WHERE len = 2 OR id NOT IN (SELECT id FROM two)""")
def dictionary_longest_match(spark, d):
    a = addresses(spark, d).select("id", F.array("number", "base", F.lower("abbr")).alias("w"))
    phrases = spark.createDataFrame([(p,) for p in ("st", "ave", "oak", "oak st", "king ave", "rd")], "phrase string")
    return dictionary.longest_matches(a, "id", "w", phrases, 2)


@query("""WITH w AS (SELECT p_partkey, string_split(p_name, ' ')[-1] AS w FROM part), x AS (SELECT unnest(['t', 'et', 'ket', 'r', 'er', 'l', 'eel']) AS affix),
m AS (SELECT p_partkey, w, affix, row_number() OVER (PARTITION BY p_partkey ORDER BY length(affix) DESC) AS k FROM w JOIN x ON length(affix) < length(w) AND right(w, length(affix)) = affix)
SELECT p_partkey, w, affix FROM m WHERE k = 1""")
def suffix_join(spark, d):
    w = table(spark, d, "part").select("p_partkey", F.element_at(F.split("p_name", " "), -1).alias("w"))
    return dictionary.suffix_matches(w, "w", spark.createDataFrame([(x,) for x in ("t", "et", "ket", "r", "er", "l", "eel")], "phrase string"))


@query("""WITH w AS (SELECT p_partkey, p_name AS w FROM part), x AS (SELECT unnest(['s', 'sm', 'b', 'bl', 'r', 're', 'g']) AS affix),
m AS (SELECT p_partkey, w, affix, row_number() OVER (PARTITION BY p_partkey ORDER BY length(affix) DESC) AS k FROM w JOIN x ON starts_with(w, affix) AND length(affix) < length(w))
SELECT p_partkey, w, affix FROM m WHERE k = 1""")
def prefix_join(spark, d):
    w = table(spark, d, "part").select("p_partkey", F.col("p_name").alias("w"))
    return dictionary.prefix_matches(w, "w", spark.createDataFrame([(x,) for x in ("s", "sm", "b", "bl", "r", "re", "g")], "phrase string"))


@query()
def dictionary_build(spark, d):
    return dictionary.build(dictionary.default_rows(spark), dictionary.gazetteers(spark))


@query()
def dictionary_roles(spark, d):
    return dictionary.gazetteers(spark)


@query(f"""WITH {_SYNTH} SELECT id, unnest(['nhct|' || n || '|' || number || '|' || c for n in [base, kind] for c in [base, 'x' || kind]]) AS key FROM a""".replace("['nhct|' || n || '|' || number || '|' || c for n in [base, kind] for c in [base, 'x' || kind]]", "['nhct|' || base || '|' || number || '|' || base, 'nhct|' || base || '|' || number || '|x' || kind, 'nhct|' || kind || '|' || number || '|' || base, 'nhct|' || kind || '|' || number || '|x' || kind]"))
def hash_keys(spark, d):
    a = addresses(spark, d)
    keys = fn.key_join("nhct", F.array("base", "kind"), F.array("number"), F.array(F.col("base"), F.concat(F.lit("x"), "kind")))
    return a.select("id", F.explode(keys).alias("key"))


@query("""SELECT c_custkey, unnest([n_name || '|country|' || r_name, n_name || '|admin1|' || CAST(n_regionkey AS VARCHAR)]) AS key FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def disambiguation_keys(spark, d):
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    c = table(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    keys = F.concat(fn.disambiguation_keys("n_name", "country", "r_name"), fn.disambiguation_keys("n_name", "admin1", F.col("n_regionkey").cast("string"), F.lit(None).cast("string")))
    return c.select("c_custkey", F.explode(keys).alias("key"))


@query(f"""WITH {_SYNTH}, k AS (SELECT id, number || '|' || base AS key FROM a) SELECT DISTINCT x.id AS id1, y.id AS id2 FROM k x JOIN k y ON x.key = y.key AND x.id < y.id""")
def blocking_pairs(spark, d):
    a = addresses(spark, d).select("id", F.array(F.concat_ws("|", "number", "base")).alias("keys"))
    return joins.blocking_pairs(a, "keys", "id")


_GRAMS = """g AS (SELECT DISTINCT doc_id AS id, array_to_string(w[i : i + 2], ' ') AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM documents))),
k AS (SELECT id, count(*) AS n, md5(string_agg(gram, '|' ORDER BY gram)) AS k FROM g GROUP BY id), c AS (SELECT k, min(id) AS id, any_value(n) AS n FROM k GROUP BY k),
r AS (SELECT g.* FROM g JOIN c USING (id)), s AS (SELECT a.id AS id1, b.id AS id2, count(*) AS shared FROM r a JOIN r b ON a.gram = b.gram AND a.id < b.id GROUP BY ALL)"""


@query(f"""WITH {_GRAMS} SELECT id1, id2, shared, round(j, 6) AS jaccard, CAST(CASE WHEN j >= 0.9 THEN 6 ELSE 3 END AS INTEGER) AS status
FROM (SELECT id1, id2, shared, CAST(shared AS DOUBLE) / (x.n + y.n - shared) AS j FROM s JOIN c x ON x.id = id1 JOIN c y ON y.id = id2) WHERE j >= 0.7
UNION ALL SELECT c.id, k.id, k.n, 1.0, 6 FROM c JOIN k USING (k) WHERE c.id <> k.id""")
def near_dupe_status(spark, d):
    out = resolve.near_duplicate_texts(table(spark, d, "documents"), "doc_id", "text")
    return out.select("id1", "id2", "shared", F.round("jaccard", 6).alias("jaccard"), "status")


@query(f"""WITH {_SYNTH}, e AS (SELECT id, base, [base || ' ' || kind, base || ' ' || lower(abbr)] AS f, [base] AS r FROM a), p AS (SELECT x.id AS id1, x.id + 5 AS id2, x.f AS fa, x.r AS ra, y.f AS fb, y.r AS rb FROM e x JOIN e y ON y.id = x.id + 11)
SELECT id1, CAST(CASE WHEN len(list_intersect(fa, fb)) > 0 THEN 9 WHEN len(list_intersect(ra, rb)) > 0 THEN 3 ELSE 0 END AS INTEGER) AS street_status,
CAST(CASE WHEN len(list_intersect(ra, rb)) > 0 THEN 9 ELSE 0 END AS INTEGER) AS unit_status FROM p""")
def exact_statuses(spark, d):
    a = addresses(spark, d).select("id", F.array(F.concat_ws(" ", "base", "kind"), F.concat_ws(" ", "base", F.lower("abbr"))).alias("f"), F.array("base").alias("r"))
    b = a.select((F.col("id") - 11).alias("id"), F.col("f").alias("fb"), F.col("r").alias("rb"))
    return a.join(b, "id").select(F.col("id").alias("id1"), fn.ladder_status("f", "fb", "r", "rb").alias("street_status"), fn.either_status("r", "rb", F.array().cast("array<string>"), F.array().cast("array<string>")).alias("unit_status"))


@query("""WITH p AS (SELECT n_nationkey AS id, n_name AS city, CASE WHEN n_nationkey % 2 = 0 THEN 'NATION_' || (n_nationkey % 7) END AS city_district, r_name AS state FROM nation JOIN region ON n_regionkey = r_regionkey),
x AS (SELECT a.id AS id1, b.id AS id2, a.city AS ca, b.city AS cb, b.city_district AS db, a.city_district AS da, a.state AS sa, b.state AS sb FROM p a JOIN p b ON a.id < b.id)
SELECT id1, id2, CAST(CASE WHEN s > 0 AND sa <> sb THEN 0 ELSE s END AS INTEGER) AS status FROM (SELECT *, CASE WHEN ca = cb THEN 9 WHEN ca = db OR cb = da THEN 6 ELSE 0 END AS s FROM x)""")
def toponym_status(spark, d):
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    k = F.col("n_nationkey")
    p = n.select(k.alias("id"), F.array(F.lit("city"), F.lit("city_district"), F.lit("state")).alias("l"), F.array(F.col("n_name"), F.when(k % 2 == 0, F.concat(F.lit("NATION_"), (k % 7).cast("string"))), F.col("r_name")).alias("v"))
    a, b = p.select(F.col("id").alias("id1"), F.col("l").alias("la"), F.col("v").alias("va")), p.select(F.col("id").alias("id2"), F.col("l").alias("lb"), F.col("v").alias("vb"))
    return a.join(b, F.col("id1") < F.col("id2")).select("id1", "id2", fn.toponym_status("la", "va", "lb", "vb", ("en",)).alias("status"))


@query("""WITH t AS (SELECT o_orderkey AS id, [chr(CAST(97 + o_orderkey % 3 AS INTEGER)), 'and', chr(CAST(98 + o_orderkey % 4 AS INTEGER))] AS a, [chr(CAST(97 + o_orderkey % 2 AS INTEGER)), 'and', 'c'] AS b FROM orders)
SELECT id, len(list_filter(a, lambda x: len(x) = 1 AND NOT list_contains(b, x))) > 0 AND len(list_filter(b, lambda x: len(x) = 1 AND NOT list_contains(a, x))) > 0 AS private,
CAST(CASE WHEN array_to_string(a, '') = array_to_string(b, '') THEN 9 WHEN j >= 0.9 THEN 6 WHEN j >= 0.7 THEN 3 ELSE 0 END AS INTEGER) AS joined
FROM (SELECT *, CAST(len(list_intersect(list_distinct(a), b)) AS DOUBLE) / len(list_distinct(list_concat(a, b))) AS j FROM t)""")
def letter_rules(spark, d):
    k = F.col("o_orderkey")
    letter = lambda base, n: F.char((base + k % n).cast("long"))
    t = table(spark, d, "orders").select(k.alias("id"), F.array(letter(97, 3), F.lit("and"), letter(98, 4)).alias("a"), F.array(letter(97, 2), F.lit("and"), F.lit("c")).alias("b"))
    return t.select("id", fn.private_letters("a", "b").alias("private"), fn.joined_status("a", "b").alias("joined"))


@query("""WITH p AS (SELECT c_custkey AS id, c_custkey % 160 - 80 + 0.5 AS lat, c_custkey % 340 - 170 + 0.25 AS lon FROM customer),
s AS (SELECT s_suppkey AS site, s_suppkey % 160 - 80 + 0.51 AS lat, s_suppkey % 340 - 170 + 0.26 AS lon FROM supplier),
k AS (SELECT id, site, 2 * 6373.0 * asin(sqrt(pow(sin(radians(s.lat - p.lat) / 2), 2) + cos(radians(p.lat)) * cos(radians(s.lat)) * pow(sin(radians(s.lon - p.lon) / 2), 2))) AS km FROM p JOIN s ON abs(s.lat - p.lat) < 0.08 AND abs(s.lon - p.lon) < 0.08),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY id ORDER BY km, site) AS INTEGER) AS rank FROM k)
SELECT id, site, round(km, 6) AS km, rank FROM r WHERE rank <= 3""")
def haversine_nearest(spark, d):
    k, j = F.col("c_custkey"), F.col("s_suppkey")
    points = table(spark, d, "customer").select(k.alias("id"), (k % 160 - 80 + F.lit(0.5)).alias("lat"), (k % 340 - 170 + F.lit(0.25)).alias("lon"))
    sites = table(spark, d, "supplier").select(j.alias("site"), (j % 160 - 80 + F.lit(0.51)).alias("lat"), (j % 340 - 170 + F.lit(0.26)).alias("lon"))
    return spatial.nearest(points, sites, 3, 5).select("id", "site", F.round("km", 6).alias("km"), "rank")


@query("""WITH p AS (SELECT c_custkey AS id, c_custkey % 40 + 0.5 AS lat, (c_custkey * 7) % 60 + 0.5 AS lon FROM customer), b AS (SELECT n_nationkey AS poly, n_regionkey AS level, n_nationkey * 1.5 AS s, n_nationkey * 2.0 AS w FROM nation)
SELECT id, poly, level FROM p JOIN b ON lat >= s AND lat < s + 3 AND lon >= w AND lon < w + 5""")
def point_in_polygon(spark, d):
    k, n = F.col("c_custkey"), F.col("n_nationkey")
    points = table(spark, d, "customer").select(k.alias("id"), (k % 40 + F.lit(0.5)).alias("lat"), ((k * 7) % 60 + F.lit(0.5)).alias("lon"))
    corner = lambda x, y: F.struct((n * 2.0 + x).alias("lon"), (n * 1.5 + y).alias("lat"))
    polys = table(spark, d, "nation").select(n.alias("poly"), F.col("n_regionkey").alias("level"), F.array(F.array(corner(0, 0), corner(5, 0), corner(5, 3), corner(0, 3))).alias("rings"))
    return spatial.point_in_polygon(points, polys, 3)


@query("""WITH c AS (SELECT c_custkey AS id, lpad(CAST(c_custkey % 1000 AS VARCHAR), 3, '0') AS cell FROM customer), s AS (SELECT lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS cell, n_name AS value FROM nation UNION ALL SELECT lpad(CAST(n_nationkey * 11 AS VARCHAR), 3, '0'), 'fine_' || n_name FROM nation),
m AS (SELECT id, value, row_number() OVER (PARTITION BY id ORDER BY length(s.cell) DESC) AS k FROM c JOIN s ON starts_with(c.cell, s.cell)) SELECT id, value FROM m WHERE k = 1""")
def cell_lookup(spark, d):
    n = F.col("n_nationkey")
    nation = table(spark, d, "nation")
    cells = nation.select(F.lpad(n.cast("string"), 2, F.lit("0")).alias("cell"), F.col("n_name").alias("value")).unionByName(nation.select(F.lpad((n * 11).cast("string"), 3, F.lit("0")).alias("cell"), F.concat(F.lit("fine_"), "n_name").alias("value")))
    points = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.lpad((F.col("c_custkey") % 1000).cast("string"), 3, F.lit("0")).alias("cell"))
    return spatial.cell_lookup(points, cells, [2, 3])


@query("""SELECT c_custkey, upper(trim(code)) AS code, CASE WHEN pat IS NULL THEN true ELSE regexp_matches(trim(code), '(?i)^(?:' || pat || ')$') END AS valid
FROM (SELECT c_custkey, CAST(c_custkey AS VARCHAR) || CASE WHEN c_custkey % 2 = 0 THEN 'ab' ELSE '' END AS code, CASE c_nationkey % 3 WHEN 0 THEN '[0-9]{3,5}' WHEN 1 THEN '[0-9]+[A-Z]{2}' END AS pat FROM customer)""")
def postcode_validation(spark, d):
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    code = F.concat(k.cast("string"), F.when(k % 2 == 0, "ab").otherwise(""))
    pattern = F.when(n % 3 == 0, "[0-9]{3,5}").when(n % 3 == 1, "[0-9]+[A-Z]{2}")
    return table(spark, d, "customer").select("c_custkey", fn.normalise_postcode(code).alias("code"), fn.postcode_valid(code, pattern).alias("valid"))
