"""Joins, aggregations, ordering, set operations."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import functions as fn
from ..operators import aggregates, joins, ordering
from ..operators.graph import written
from . import query, table

_WORDS = "SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS term FROM documents"


def _counts(spark, d):
    return aggregates.term_counts(table(spark, d, "documents"), "doc_id", "text")


@query(f"SELECT term, count(DISTINCT doc_id) AS df FROM ({_WORDS}) GROUP BY term")
def doc_frequency(spark, d):
    return aggregates.document_frequency(_counts(spark, d))


@query(f"""WITH c AS (SELECT doc_id, term, count(*) AS tf FROM ({_WORDS}) GROUP BY ALL), f AS (SELECT term, count(*) AS df FROM c GROUP BY term),
r AS (SELECT doc_id, term, ln(tf + 1) * ln((SELECT count(*) FROM documents) / CAST(df AS DOUBLE)) AS raw FROM c JOIN f USING (term)),
w AS (SELECT doc_id, term, CASE WHEN n > 0 THEN raw / n ELSE 0 END AS weight FROM (SELECT *, sqrt(sum(raw * raw) OVER (PARTITION BY doc_id)) AS n FROM r)),
k AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY round(weight, 9) DESC, term) AS INTEGER) AS rank FROM w)
SELECT doc_id, term, rank, round(weight, 6) AS weight FROM k WHERE rank <= 5""")
def tfidf_top5(spark, d):
    n = table(spark, d, "documents").count()
    top = aggregates.tfidf_top(written(_counts(spark, d)), "doc_id", n, 5)
    return top.select("doc_id", "term", "rank", F.round("weight", 6).alias("weight"))


@query("""WITH t AS (SELECT doc_id, generate_subscripts(w, 1) AS pos, unnest(w) AS token FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM documents)),
u AS (SELECT token AS phrase, count(*) AS n FROM t GROUP BY 1 HAVING count(*) >= 20),
g2 AS (SELECT a.doc_id, a.pos, a.token || ' ' || b.token AS phrase FROM t a JOIN u ON a.token = u.phrase JOIN t b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1),
b AS (SELECT phrase, count(*) AS n FROM g2 GROUP BY 1 HAVING count(*) >= 20),
g3 AS (SELECT g2.phrase || ' ' || c.token AS phrase FROM g2 JOIN b ON g2.phrase = b.phrase JOIN t c ON g2.doc_id = c.doc_id AND c.pos = g2.pos + 2)
SELECT phrase, n, 1 AS k FROM u UNION ALL SELECT phrase, n, 2 FROM b UNION ALL SELECT phrase, count(*), 3 FROM g3 GROUP BY 1 HAVING count(*) >= 20""")
def frequent_phrases(spark, d):
    tokens = fn.spread(table(spark, d, "documents").select("text")).select(fn.words("text").alias("tokens"))
    return aggregates.frequent_ngrams(tokens, "tokens", 20, 3)


@query("""SELECT c_custkey, c_name, n_name AS admin2, r_name AS admin1 FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey""")
def admin_chain_join(spark, d):
    nation, region = table(spark, d, "nation"), table(spark, d, "region")
    places = table(spark, d, "customer").withColumnRenamed("c_nationkey", "n_nationkey")
    codes = nation.select("n_nationkey", F.col("n_name").alias("name"))
    out = joins.admin_chain(places, [(codes, ["n_nationkey"], "admin2")]).join(nation.select("n_nationkey", F.col("n_regionkey").alias("r_regionkey")), "n_nationkey", "left")
    out = joins.admin_chain(out, [(region.select("r_regionkey", F.col("r_name").alias("name")), ["r_regionkey"], "admin1")])
    return out.select("c_custkey", "c_name", "admin2", "admin1")


@query("""SELECT s_suppkey, s_name, true AS is_canonical FROM supplier UNION ALL
SELECT s_suppkey, c_name, false FROM supplier JOIN customer ON s_suppkey = c_custkey WHERE c_mktsegment NOT IN ('BUILDING') AND c_name <> s_name""")
def alt_names_union(spark, d):
    alternates = table(spark, d, "customer").select(F.col("c_custkey").alias("s_suppkey"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("kind"))
    return joins.alternate_names(table(spark, d, "supplier").select("s_suppkey", "s_name"), alternates, "s_suppkey", "s_name", ["BUILDING"])


@query("SELECT s_nationkey AS k FROM supplier UNION SELECT c_nationkey FROM customer")
def union_distinct(spark, d):
    return table(spark, d, "supplier").select(F.col("s_nationkey").alias("k")).union(table(spark, d, "customer").select("c_nationkey")).distinct()


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def semi_customers(spark, d):
    return joins.existing(table(spark, d, "customer"), table(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey"), "c_custkey").select("c_custkey")


@query("SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def anti_unlabelled(spark, d):
    return joins.missing(table(spark, d, "documents"), table(spark, d, "labels"), "doc_id").select("doc_id")


@query("SELECT r_regionkey, r_name, count(n_nationkey) AS n_children, count(*) FILTER (n_name LIKE '%1%') AS n_matching FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY ALL")
def parent_child_counts(spark, d):
    nation = table(spark, d, "nation").withColumnRenamed("n_regionkey", "r_regionkey")
    return joins.child_counts(table(spark, d, "region"), nation, "r_regionkey", F.col("n_name").like("%1%"))


@query("SELECT n1.n_nationkey AS child, n2.r_regionkey AS parent FROM nation n1 JOIN region n2 ON n1.n_regionkey = n2.r_regionkey AND right(n1.n_name, 1) = right(n2.r_name, 1)")
def same_ending_parent(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("child"), F.col("n_regionkey").alias("parent"), F.right("n_name", F.lit(1)).alias("e"))
    return n.join(table(spark, d, "region").select(F.col("r_regionkey").alias("parent"), F.right("r_name", F.lit(1)).alias("e")), ["parent", "e"]).select("child", "parent")


@query("SELECT l_orderkey, string_agg(DISTINCT CAST(l_suppkey AS VARCHAR), ',' ORDER BY CAST(l_suppkey AS VARCHAR)) AS \"values\" FROM lineitem GROUP BY l_orderkey")
def group_concat_distinct(spark, d):
    return aggregates.group_concat_distinct(table(spark, d, "lineitem"), ["l_orderkey"], "l_suppkey")


@query("SELECT l_returnflag, CAST(bit_or(1 << (l_linenumber + CASE WHEN l_linestatus = 'O' THEN 8 ELSE 0 END)) AS BIGINT) AS components FROM (SELECT l_returnflag, l_linestatus, CAST(l_linenumber AS BIGINT) AS l_linenumber FROM lineitem) GROUP BY 1")
def component_bit_or(spark, d):
    mask = F.expr("shiftleft(1L, l_linenumber + CASE WHEN l_linestatus = 'O' THEN 8 ELSE 0 END)")
    return aggregates.component_masks(table(spark, d, "lineitem").select("l_returnflag", mask.alias("mask")), "l_returnflag", "mask")


@query("""WITH w AS (SELECT unnest(string_split_regex(text, '[^\\p{L}]+')) AS t FROM documents), f AS (SELECT lower(t) AS value, t AS form, count(*) AS n FROM w WHERE t <> '' GROUP BY ALL),
r AS (SELECT *, CAST(sum(n) OVER (PARTITION BY value) AS BIGINT) AS total, row_number() OVER (PARTITION BY value ORDER BY n DESC, form) AS k FROM f)
SELECT value, form, total FROM r WHERE k = 1 AND total >= 5""")
def most_common_form(spark, d):
    w = table(spark, d, "documents").select(F.explode(F.split("text", "[^\\p{L}]+")).alias("t")).where("t <> ''")
    return aggregates.most_common_form(w, "t", 5)


@query("""WITH n AS (SELECT p_name AS phrase, p_brand AS label, count(*) AS n FROM part GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY phrase ORDER BY n DESC, label) AS k FROM n)
SELECT phrase, max(label) FILTER (k = 1) AS label, count(*) AS n_labels, CAST(sum(n) AS BIGINT) AS total FROM r GROUP BY phrase""")
def phrase_argmax(spark, d):
    return aggregates.argmax_label(table(spark, d, "part").select(F.col("p_name").alias("phrase"), F.col("p_brand").alias("label")), "phrase", "label")


@query("""SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders) WHERE k = 1""")
def sort_unique(spark, d):
    return ordering.sort_unique(table(spark, d, "orders"), ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")]).select("o_custkey", "o_orderkey", "o_totalprice")


_PRIORITY = ["5-LOW", "1-URGENT", "3-MEDIUM", "2-HIGH"]


@query("""SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY CASE o_orderpriority WHEN '5-LOW' THEN 0 WHEN '1-URGENT' THEN 1 WHEN '3-MEDIUM' THEN 2 WHEN '2-HIGH' THEN 3 ELSE 4 END, o_orderkey) AS INTEGER) AS place FROM orders""")
def priority_order(spark, d):
    o = table(spark, d, "orders")
    return o.select("o_custkey", "o_orderkey", F.row_number().over(W.partitionBy("o_custkey").orderBy(fn.topological_priority("o_orderpriority", _PRIORITY), "o_orderkey")).alias("place"))


@query("SELECT quality, toxic, count(*) AS n FROM labels GROUP BY ALL")
def confusion_matrix(spark, d):
    return aggregates.confusion(table(spark, d, "labels"), "quality", "toxic")


@query("""WITH p AS (SELECT l_orderkey, CAST(sum(CASE WHEN l_quantity > 25 = (l_tax > 0.04) THEN 1 ELSE 0 END) AS BIGINT) AS ok, count(*) AS n FROM lineitem GROUP BY 1)
SELECT round(CAST(sum(ok) AS DOUBLE) / sum(n), 6) AS token_accuracy, round(avg(CASE WHEN ok = n THEN 1.0 ELSE 0.0 END), 6) AS full_accuracy FROM p""".replace("l_quantity > 25 = (l_tax > 0.04)", "(l_quantity > 25) = (l_tax > 0.04)"))
def parse_accuracy(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", (F.col("l_quantity") > 25).alias("p"), (F.col("l_tax") > 0.04).alias("t"))
    out = aggregates.accuracy(rows, "p", "t", "l_orderkey")
    return out.select(F.round("token_accuracy", 6).alias("token_accuracy"), F.round("full_accuracy", 6).alias("full_accuracy"))


@query("SELECT l_orderkey AS node, list_sort(list(DISTINCT p_name)) AS names FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1 HAVING count(DISTINCT p_name) > 1".replace("list_sort(list(DISTINCT p_name)) AS names", "string_agg(DISTINCT p_name, '|' ORDER BY p_name) AS names"))
def shared_node_groups(spark, d):
    ways = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("node"), F.col("p_name").alias("name"))
    return joins.shared_nodes(ways, "node", "name").select("node", F.array_join("names", "|").alias("names"))


@query("SELECT event_type AS feature, count(*) AS n, count(DISTINCT user_id) AS examples FROM events GROUP BY 1")
def feature_counts(spark, d):
    e = table(spark, d, "events")
    n = aggregates.feature_counts(e, "user_id", "event_type", False)
    return n.join(aggregates.feature_counts(e, "user_id", "event_type", True).withColumnRenamed("n", "examples"), "event_type").select(F.col("event_type").alias("feature"), "n", "examples")


@query("SELECT l_returnflag AS row, round(sum(l_discount), 4) AS total, round(sum(l_discount * l_discount), 4) AS squares FROM lineitem GROUP BY 1")
def sparse_sums(spark, d):
    e = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("row"), F.col("l_discount").alias("value"))
    return aggregates.sparse_sums(e, "row").select("row", F.round("total", 4).alias("total"), F.round("squares", 4).alias("squares"))


@query("""WITH f AS (SELECT doc_id, term AS feature, count(*) AS value FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS term FROM documents) GROUP BY ALL),
w AS (SELECT lang AS label, feature, CAST(sum(value) AS DOUBLE) AS weight FROM f JOIN documents USING (doc_id) GROUP BY ALL)
SELECT doc_id, label, CAST(sum(value * weight) AS BIGINT) AS score FROM f JOIN w USING (feature) GROUP BY ALL""")
def feature_scores(spark, d):
    words = fn.spread(table(spark, d, "documents").select("doc_id", "lang", "text")).select("doc_id", F.col("lang").alias("label"), F.explode(fn.words("text")).alias("feature"))
    w = words.groupBy("label", "feature").agg(F.count("*").cast("double").alias("weight"))
    f = words.select("doc_id", "feature", F.lit(1).alias("value"))
    return joins.feature_scores(f, w, "doc_id").select("doc_id", "label", F.col("score").cast("long").alias("score"))


@query("SELECT c_custkey AS a, s_suppkey AS b, EXISTS (SELECT 1 FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_custkey = c_custkey AND l_suppkey = s_suppkey) AS linked FROM customer JOIN supplier ON c_nationkey = s_nationkey")
def graph_edge_test(spark, d):
    edges = table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("a"), F.col("l_suppkey").alias("b"))
    customers = table(spark, d, "customer").select(F.col("c_custkey").alias("a"), F.col("c_nationkey").alias("place"))
    suppliers = table(spark, d, "supplier").select(F.col("s_suppkey").alias("b"), F.col("s_nationkey").alias("place"))
    return joins.group_edges(customers, suppliers, edges)


@query("SELECT p_name, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, p_name LIMIT 50")
def most_common_first(spark, d):
    """The feature is the limit: the fifty most common names."""
    return ordering.most_common_first(table(spark, d, "part").groupBy("p_name").agg(F.count("*").alias("n")), "n", "p_name", 50)


@query("""WITH u AS (SELECT doc_id, CAST('0x' || substr(md5('0|' || CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) / 4294967296.0 AS u FROM documents) SELECT doc_id, CASE WHEN u < 0.8 THEN 'train' WHEN u < 0.9 THEN 'cv' ELSE 'test' END AS split FROM u""")
def train_split(spark, d):
    return ordering.split(table(spark, d, "documents").select("doc_id"), "doc_id", {"train": 0.8, "cv": 0.1, "test": 0.1})


@query("SELECT doc_id FROM documents")
def seeded_shuffle(spark, d):
    return ordering.shuffled(table(spark, d, "documents").select("doc_id"), 7, "doc_id")


@query("""WITH u AS (SELECT doc_id, CAST('0x' || substr(md5('0|' || CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) / 4294967296.0 AS u FROM documents) SELECT doc_id, CASE WHEN u < 0.7 THEN 'en' WHEN u < 0.9 THEN 'fr' ELSE 'de' END AS lang FROM u""")
def weighted_language(spark, d):
    return table(spark, d, "documents").select("doc_id", ordering.weighted_choice("doc_id", [0.7, 0.9, 1.0], ["en", "fr", "de"]).alias("lang"))


@query("""WITH RECURSIVE e AS (SELECT DISTINCT l_suppkey % 40 + 1000 * (l_suppkey % 3) AS a, l_partkey % 30 + 1000 * (l_suppkey % 3) + 100 AS b FROM lineitem),
u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r(a, b) AS (SELECT a, b FROM u UNION SELECT r.a, u.b FROM r JOIN u ON r.b = u.a)
SELECT a AS node, min(b) AS root FROM r GROUP BY a HAVING min(b) <> a""")
def connected_components(spark, d):
    from ..operators.graph import components

    e = table(spark, d, "lineitem").select((F.col("l_suppkey") % 40 + 1000 * (F.col("l_suppkey") % 3)).alias("a"), (F.col("l_partkey") % 30 + 1000 * (F.col("l_suppkey") % 3) + 100).alias("b")).distinct()
    return components(e).where("node <> root")
