"""Functions, operators, plans, sources and streams on a session."""

import json
import time

import pytest
from pyspark.sql import functions as F

from placewright import functions as fn
from placewright import sources, streaming
from placewright.core.expand import Options
from placewright.functions.sql import register
from placewright.operators import aggregates, dictionary, graph, joins, ordering, spatial
from placewright.plans import gazetteer, resolve, training


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_builtin_functions(spark):
    df = spark.createDataFrame([("Rue-du Port (vieux)", "rue du port", "xiv", "7-9;a")], "a string, b string, r string, n string")
    got = df.select(
        fn.separator_key("a"), fn.remove_parens("a"), fn.roman_value("r"), fn.number_range("n"), fn.quadgrams(F.lit("abcdef")), fn.ngrams(F.split("b", " "), 2), fn.split_alpha_numeric(F.lit("12b3")),
        fn.common_prefix_length(F.lit("abcx"), F.lit("abd")), fn.multiset_jaccard(F.array(F.lit("a"), F.lit("a")), F.array(F.lit("a"))), fn.geohash_cell(F.lit(57.64911), F.lit(10.40744), 6), fn.token_replace_hyphens(F.lit("a-b 1-2")),
        fn.phrase_index(F.array(F.lit(1)), F.array(F.lit(2)), F.lit(4)),
    ).first()
    assert list(got) == ["rueduport(vieux)", "Rue-du Port", 14, ["7", "8", "9", "a"], ["abcd", "bcde", "cdef"], ["rue du", "du port"], "12 b3", 2, 0.5, "u4pruy", "a b 1-2", [-1, 0, 0, -1]]


def test_kernel_functions_and_sql(spark):
    df = spark.createDataFrame([("8 W 41st St", ["en"]), (None, None)], "a string, l array<string>")
    got = df.select(fn.expand_address("a", Options(), "l").alias("e"), fn.tokenize("a").alias("t"), fn.double_metaphone("a").alias("m")).collect()
    assert "8 west 41 street" in got[0].e and got[1].e is None and got[0].t[0].text == "8" and got[1].m.primary is None
    assert "expand_address" in register(spark)
    df.createOrReplaceTempView("t")
    assert spark.sql("SELECT explode(expand_address(a)) AS e FROM t").count() > 0
    assert spark.sql("SELECT is_street_duplicate('Elm Ave', 'Elm Avenue') AS s, jaro_winkler_half('ab', 'ab') AS j").first().s == 9


def test_longest_matches_equals_the_kernel_search(spark):
    from placewright.core import lexer
    from placewright.core import lexicon as lx

    texts = ["grand rue du port grand", "grand rue", "port neuf rue", "x"]
    phrases = ["grand rue", "grand", "rue du port neuf", "port", "rue"]
    d = lx.Dictionary([("xx", "street_types", p, p) for p in phrases])
    want = sorted((i, p.start, p.length, t) for i, s in enumerate(texts) for p in d.search(lexer.tokenize(s), "xx") for t in [" ".join(s.split()[p.start : p.start + p.length])])
    df = spark.createDataFrame([(i, s.split()) for i, s in enumerate(texts)], "id int, w array<string>")
    assert rows(dictionary.longest_matches(df, "id", "w", spark.createDataFrame([(p,) for p in phrases], "phrase string"), 4)) == want
    built = dictionary.build(dictionary.default_rows(spark), dictionary.gazetteers(spark))
    assert built.where("lang = 'en' and phrase = 'st'").first().readings[0].canonical == "saint"
    assert dictionary.in_languages(built, "fr").where("lang = 'en'").isEmpty() and dictionary.bundle(dictionary.default_rows(spark), "toponyms").count() > 0


def test_blocking_pairs_equal_brute_force(spark):
    data = [(i, [f"k{i % 3}", "hot", f"r{i}"]) for i in range(40)]
    got = rows(joins.blocking_pairs(spark.createDataFrame(data, "id int, keys array<string>"), "keys", "id", block=7))
    assert got == [(i, j) for i in range(40) for j in range(i + 1, 40)]


def test_components_and_rings(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(20, 40)] + [(1, 2), (3, 2)], "a int, b int")
    assert rows(graph.components(edges)) == sorted([(i, 20) for i in range(21, 41)] + [(2, 1), (3, 1)])
    segments = spark.createDataFrame([(1, [1, 2, 3]), (1, [5, 4, 3]), (1, [5, 1]), (2, [7, 8])], "rel long, nodes array<long>")
    rings = graph.assemble_rings(segments).collect()
    assert len(rings) == 1 and sorted(rings[0].ring[:-1]) == [1, 2, 3, 4, 5] and rings[0].ring[0] == rings[0].ring[-1]


def test_joins_with_nulls(spark):
    a = spark.createDataFrame([(1,), (None,), (3,)], "k int")
    assert rows(joins.missing(a, spark.createDataFrame([(1,), (None,)], "k int"), "k").where("k is not null")) == [(3,)]
    assert rows(joins.existing(a, spark.createDataFrame([(1,), (1,)], "k int"), "k")) == [(1,)]


def test_ordering_is_repeatable(spark):
    df = spark.range(2000)
    one, two = (ordering.split(df.repartition(n), "id", {"train": 0.8, "cv": 0.1, "test": 0.1}).groupBy("split").count() for n in (1, 7))
    assert rows(one) == rows(two) and 1500 < dict(rows(one))["train"] < 1700 and set(dict(rows(one))) == {"train", "cv", "test"}
    assert ordering.shuffled(df, 1, "id").first() == ordering.shuffled(df.repartition(3), 1, "id").first()


def test_spatial_lookup(spark):
    points = spark.createDataFrame([(1, 40.0, -73.0), (2, 40.0, -73.01)], "id int, lat double, lon double")
    sites = spark.createDataFrame([("a", 40.001, -73.0), ("b", 40.0, -73.011)], "site string, lat double, lon double")
    assert [(r.id, r.site) for r in spatial.nearest(points, sites, 1, 5).orderBy("id").collect()] == [(1, "a"), (2, "b")]


def test_frequent_phrases(spark):
    tokens = spark.createDataFrame([(d, i, t) for d in range(3) for i, t in enumerate(["a", "b", "c", str(d)])], "d int, pos int, token string")
    assert {r.phrase for r in aggregates.frequent_phrases(tokens, "d", 3).collect()} == {"a", "b", "c", "a b", "b c", "a b c"}


def test_sources(spark, tmp_path):
    (tmp_path / "dict/en").mkdir(parents=True)
    (tmp_path / "dict/en/street_types.txt").write_text("# note\nlane|ln\n")
    assert rows(sources.read_dictionaries(spark, str(tmp_path / "dict"))) == [("en", "street_types", "lane", "lane"), ("en", "street_types", "ln", "lane")]
    (tmp_path / "dict/en/mystery.txt").write_text("a|b\n")
    with pytest.raises(Exception, match="bad dictionary line"):
        sources.read_dictionaries(spark, str(tmp_path / "dict")).collect()
    (tmp_path / "numex").mkdir()
    (tmp_path / "numex/xx.yaml").write_text("rules:\n  - {name: uno, value: 1}\n")
    assert sources.read_numex(spark, str(tmp_path / "numex")).first().value == 1
    (tmp_path / "numex/yy.yaml").write_text("surprise: 1\n")
    with pytest.raises(ValueError, match="surprise"):
        sources.read_numex(spark, str(tmp_path / "numex"))
    (tmp_path / "tagged.tsv").write_text("en\tus\t5/house_number elm/road st/road\n")
    tagged = sources.read_tagged(spark, str(tmp_path / "tagged.tsv"))
    assert [t.label for t in tagged.first().tokens] == ["house_number", "road", "road"]
    (tmp_path / "lang.tsv").write_text("en\tus\telm st\nunk\tus\tx\nfr\tfr\t \n")
    assert sources.read_language_training(spark, str(tmp_path / "lang.tsv")).count() == 1
    osm = "<osm><node id='1' lat='1.5' lon='2.5'><tag k='name' v='A'/></node><way id='2'><nd ref='1'/><nd ref='3'/><tag k='name' v='B'/><tag k='highway' v='x'/></way><relation id='4'><member type='way' ref='2' role='outer'/></relation></osm>"
    (tmp_path / "m.osm").write_text(osm)
    got = {r.type: r for r in sources.read_osm(spark, str(tmp_path / "m.osm")).collect()}
    assert got["node"].tags == {"name": "A"} and got["way"].deps == [1, 3] and got["relation"].deps == [10**15 + 2]
    geo = {"geometry": {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1]]]}, "properties": {"name": "p"}}
    (tmp_path / "g.json").write_text(json.dumps(geo))
    shape = sources.read_geojson(spark, str(tmp_path / "g.json"), "name string").first()
    assert shape.properties.name == "p" and shape.rings[0][1].lon == 1.0
    (tmp_path / "oa.csv").write_text("num,street\n4,Elm St\n")
    oa = sources.read_openaddresses(spark, [{"path": str(tmp_path / "oa.csv"), "name": "x", "country": "us", "fields": {"house_number": "num", "road": "street", "unit": "absent"}}])
    assert [tuple(c) for c in oa.first().components] == [("house_number", "4"), ("road", "Elm St")]
    df = spark.createDataFrame([(["a", 'b"c'],)], "expansions array<string>")
    sources.write_expansions_json(df, str(tmp_path / "out"))
    assert json.loads(spark.read.text(str(tmp_path / "out")).first().value) == {"expansions": ["a", 'b"c']}


def test_plans(spark):
    tagged = spark.createDataFrame([(i, [("5", "house_number"), ("elm", "road"), ("st", "road"), ("troy", "city"), ("12345", "postcode")]) for i in range(8)], "id int, tokens array<struct<token:string,label:string>>")
    runs = training.label_runs(tagged, "id")
    assert rows(runs.where("id = 1").select("label", "phrase")) == [("city", "troy"), ("house_number", "5"), ("postcode", "12345"), ("road", "elm st")]
    assert rows(training.postcode_edges(runs, "id")) == [("12345", "troy")]
    model = training.train_tagger(tagged, 2, 2)
    assert aggregates.accuracy(training.predictions(tagged, "id", model), "predicted", "truth", "id").first().token_accuracy == 1
    geonames = spark.createDataFrame([(1, "Troy", "us", 5, "ny")], "geonames_id int, name string, country_code string, population int, admin1_code string")
    names = gazetteer.place_names(
        geonames, spark.createDataFrame([("us", "United States")], "country_code string, name string"), [(spark.createDataFrame([("ny", "New York")], "admin1_code string, name string"), ["admin1_code"], "admin1")],
        spark.createDataFrame([(1, "Troja", "de"), (1, "TRY", "iata"), (1, "Troy", "fr")], "geonames_id int, name string, kind string"),
    )
    assert rows(names.select("name", "admin1", "is_canonical")) == [("Troja", "New York", False), ("Troy", "New York", True)]
    places = spark.createDataFrame([(1, ["house_number", "road", "city"], ["4", "Elm St", "Troy"]), (2, ["house_number", "road", "city"], ["4", "Elm Street", "Troy"]), (3, ["house_number", "road", "city"], ["9", "Elm St", "Troy"])], "id int, labels array<string>, values array<string>")
    from placewright.core.dupes import HashOptions

    assert [(r.id1, r.id2, r.street_status) for r in resolve.resolve_places(places, "id", HashOptions(address_only_keys=True)).collect()] == [(1, 2, 9)]
    weights = training.train_ftrl([({"a": 1.0}, 0), ({"b": 1.0}, 1)] * 20, 2)
    assert training.ftrl_predict(weights, {"a": 1.0}) == 0 and training.ftrl_predict(weights, {"b": 1.0}) == 1
    assert training.ftrl_predict(training.train_sgd([({"a": 1.0}, 0), ({"b": 1.0}, 1)] * 20, 2), {"b": 1.0}) == 1


def test_large_groups_of_near_duplicate_texts(spark):
    """25 copies, and two near copies that share only what all have: no n-gram is too common to count."""
    base = " ".join(f"w{i}" for i in range(40))
    texts = [(i, base) for i in range(25)] + [(25, base + " x"), (26, "y " + base)]
    got = {(r.id1, r.id2): (r.shared, r.status) for r in resolve.near_duplicate_texts(spark.createDataFrame(texts, "id int, text string"), "id", "text").collect()}
    assert got == {(0, i): (38, 6) for i in range(1, 27)} | {(25, 26): (38, 6)}  # copies meet their class's first id, classes meet each other


def test_near_duplicate_texts_by_brute_force(spark):
    import itertools
    import random

    rng = random.Random(5)
    texts = []
    for _ in range(12):
        base = [f"w{rng.randrange(200)}" for _ in range(rng.randint(6, 60))]
        for _ in range(rng.randint(1, 6)):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 15))):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(99)}"
            texts.append((len(texts), " ".join(copy)))
    texts += [(900, None), (901, ""), (902, "too short"), (903, texts[0][1])]
    sets = {i: frozenset(zip(*(t.split()[k:] for k in range(3)))) for i, t in texts if t and len(t.split()) >= 3}
    first = {}
    for i, s in sorted(sets.items()):
        first.setdefault(s, i)
    want = {(first[s], i): (len(s), 6) for i, s in sets.items() if first[s] != i}
    for (a, i), (b, j) in itertools.combinations(first.items(), 2):
        near = len(a & b) / len(a | b)
        if near >= 0.7:
            want[min(i, j), max(i, j)] = (len(a & b), 6 if near >= 0.9 else 3)
    got = resolve.near_duplicate_texts(spark.createDataFrame(texts, "id int, text string"), "id", "text").collect()
    assert {(r.id1, r.id2): (r.shared, r.status) for r in got} == want and len(got) == len(want) > 15


def test_language_classifier(spark):
    data = [("en", f"{i} elm street north") for i in range(12)] + [("fr", f"{i} rue du port nord") for i in range(12)]
    df = spark.createDataFrame(data, "lang string, a string")
    model = training.train_language(df, "a", "lang")
    assert {r.lang: r.languages[0].label for r in training.classify_language(model, df, "a").collect()} == {"en": "en", "fr": "fr"}


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("4 Elm St\n4 Elm St\n")
    out = streaming.expanded_stream(streaming.line_stream(spark, str(tmp_path / "in")), Options(languages=("en",)))
    q = out.writeStream.format("memory").queryName("expanded").start()
    q.processAllAvailable()
    q.stop()
    assert "4 elm street" in spark.sql("SELECT * FROM expanded").first().expansions
    events = spark.readStream.format("rate").option("rowsPerSecond", 50).load().withColumn("k", F.array((F.col("value") % 3).cast("string")))
    q = streaming.first_seen(events, "timestamp", F.col("k")).select("key").writeStream.format("memory").queryName("seen").start()
    time.sleep(4)
    q.stop()
    found = [r.key for r in spark.sql("SELECT key FROM seen").collect()]
    assert len(found) == len(set(found)) <= 3


def test_spread_of_a_join_uses_all_cores(spark):
    """A join's size is a guess, and its few bytes come in few parts: the kernel behind it ran in one task."""
    a, b = spark.range(1000).withColumn("v", F.lit("x")), spark.range(1000).withColumn("w", F.lit("y"))
    both = fn.spread(a.join(b.hint("merge"), "id"), "id")
    assert both.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism and both.count() == 1000
    assert fn.spread(a.join(b.hint("merge"), "id").groupBy("id").count()).rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism


def test_blocking_pairs_are_made_last(spark):
    """No aggregate or exchange over the pairs, which may be thousands for a row; carried columns go with their ids."""
    data = [(i, [f"k{i % 3}", f"m{i % 5}", None, "all"], i * 10) for i in range(40)] + [(7, ["own"], 70), (41, ["own"], 410)]
    got = joins.blocking_pairs(spark.createDataFrame(data, "id int, keys array<string>, v int"), "keys", "id", block=6, carry=("v",))
    plan = got._jdf.queryExecution().optimizedPlan()
    assert (plan.nodeName(), plan.children().head().nodeName()) == ("Project", "Join")
    want = [(a, b, a * 10, b * 10) for a in range(40) for b in range(a + 1, 40)] + [(7, 41, 70, 410)]
    assert rows(got) == sorted(want)


def test_group_edges_equal_brute_force(spark):
    """Every pair of a place with its edge, in blocks; the pairs are never moved, so nothing stands over their join."""
    left, right = [(a, a % 3 if a else None) for a in range(30)], [(b, b % 4 if b != 5 else None) for b in range(100, 130)]
    edges = [(a, b) for a in range(30) for b in range(100, 130) if (a * b) % 7 == 1] * 2 + [(None, 101), (3, None)]
    got = joins.group_edges(spark.createDataFrame(left, "a int, place int"), spark.createDataFrame(right, "b int, place int"), spark.createDataFrame(edges, "a int, b int"), block=4)
    plan = got._jdf.queryExecution().optimizedPlan()
    assert (plan.nodeName(), plan.children().head().nodeName()) == ("Project", "Join")
    known = set(edges)
    assert rows(got) == sorted((a, b, (a, b) in known) for a, p in left for b, q in right if p is not None and p == q)


def test_places_meet_with_their_expansions(spark):
    """Expansions go with the keys: the join that makes the pairs is the last one, none looks up a pair's rows."""
    from placewright.core.dupes import HashOptions

    labels = ["house", "house_number", "road", "city"]
    places = spark.createDataFrame([(1, labels, ["Oak Cafe", "8", "Elm St", "dayton"]), (2, labels, ["Oak Café", "8", "Elm Street", "dayton"]), (3, labels, ["Inn", "9", "Elm St", "dayton"]), (4, labels[1:], ["8", "Elm Ave", "dayton"])], "id int, labels array<string>, values array<string>")
    got = resolve.resolve_places(places, "id", HashOptions(address_only_keys=True))
    assert rows(got) == [(1, 2, 9, 9), (1, 4, -1, 3), (2, 4, -1, 3)]
    last = next(x for x in got._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join" in x)
    assert "(key#" in last


@pytest.mark.parametrize("name", ["set_jaccard_pairs", "multiset_jaccard_pairs"])
def test_jaccard_of_parts_of_unlike_brand_and_size(spark, tmp_path, name):
    """Names meet whatever brand and size their parts have; equal names are members of a class."""
    from placewright.queries import QUERIES

    parts = [(1, "Red rod", "A", 1), (2, "red bolt", "B", 2), (3, "rod red", "C", 3), (4, "old anvil", "A", 1), (5, "red red rod", "A", 1), (6, None, "A", 1)]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_brand string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    repeated = [(1, 5, 1.0), (2, 4, 0.0)] if name == "set_jaccard_pairs" else [(1, 5, 0.666667), (2, 4, 0.0), (2, 5, 0.25), (4, 5, 0.0)]
    assert rows(QUERIES[name](spark, str(tmp_path))) == sorted([(1, 2, 0.333333), (1, 3, 1.0), (1, 4, 0.0), *repeated])


def test_all_pairs_equal_brute_force(spark):
    got = joins.all_pairs(spark.createDataFrame([(i, f"v{i}") for i in range(50)], "id int, v string"), "id", block=7)
    assert rows(got.select("id_1", "v_1", "id_2", "v_2")) == sorted((i, f"v{i}", j, f"v{j}") for i in range(50) for j in range(i + 1, 50))


def test_nearest_at_shared_spots(spark):
    """Equal spots aren't multiplied: of 200 points and 100 sites at one spot no 20,000 pairs are ranked."""
    points, sites = [(i, 10.5, 20.25) for i in range(200)] + [(900, 10.52, 20.25), (901, None, 1.0)], [(s, 10.51, 20.26) for s in range(100)] + [(500, 10.5, 20.25), (501, 10.53, 20.25)]
    got = spatial.nearest(spark.createDataFrame(points, "id int, lat double, lon double"), spark.createDataFrame(sites, "site int, lat double, lon double"), 3, 5)
    found = [(r.id, r["rank"], r.site) for r in got.orderBy("id", "rank").collect()]
    assert found == [(i, k, s) for i in range(200) for k, s in ((1, 500), (2, 0), (3, 1))] + [(900, 1, 501), (900, 2, 0), (900, 3, 1)]
    assert "windowspecdefinition(lat" in got._jdf.queryExecution().optimizedPlan().toString()


def test_language_is_scored_where_its_features_are_counted(spark):
    """The same probabilities as the fitted stages give, but a text's features never leave the worker."""
    from pyspark.ml.functions import vector_to_array

    df = spark.createDataFrame([("en", f"{i} elm street north") for i in range(12)] + [("fr", f"{i} rue du port nord") for i in range(12)] + [("fr", None), ("en", "")], "lang string, a string")
    model = training.train_language(df.where("a <> ''"), "a", "lang")
    staged = df.withColumn("features_in", fn.language_features("a"))
    want = model.stages[2].transform(model.stages[1].transform(staged)).select(vector_to_array("probability").alias("p")).collect()
    scored = training.classify_language(model, df, "a")
    assert "array<string>" not in str(scored.schema) and "language_features" not in scored._jdf.queryExecution().optimizedPlan().toString() and "features_in" not in scored._jdf.queryExecution().analyzed().toString()
    for got, w in zip(scored.collect(), want):
        assert got.languages[0].prob == pytest.approx(max(w.p), abs=1e-9)


def test_equal_addresses_are_tagged_once(spark):
    """Counts and parses of repeated addresses, null ones too; one row a distinct address goes to the kernel."""
    tokens = [("4", "house_number"), ("elm", "road"), ("troy", "city")]
    rows_ = [(i, [(f"{i % 3}", "house_number"), *tokens[1:]], f"{i % 3} elm troy") for i in range(60)] + [(60, None, None)]
    df = spark.createDataFrame(rows_, "id int, tokens array<struct<token:string,label:string>>, raw string")
    model = training.train_tagger(df.where("tokens IS NOT NULL"), shards=1, epochs=3)
    counts = training.prediction_counts(df, model)
    assert rows(counts.select("predicted", "truth", "n")) == [("city", "city", 60), ("house_number", "house_number", 60), ("road", "road", 60)]
    got = {r.id: [tuple(x) for x in r.parsed] for r in training.parsed_addresses(df, "raw", model).collect()}
    assert got == {i: [("house_number", f"{i % 3}"), ("road", "elm"), ("city", "troy")] for i in range(60)} | {60: []}


def test_frequent_ngrams_equal_frequent_phrases(spark):
    """The same counts from whole arrays, and no token is joined with another."""
    docs = [(i, [f"w{(i * j) % 4}" for j in range(i % 9)]) for i in range(40)] + [(99, None)]
    df = spark.createDataFrame(docs, "d int, t array<string>")
    got = aggregates.frequent_ngrams(df, "t", 3)
    want = aggregates.frequent_phrases(df.select("d", F.posexplode("t").alias("pos", "token")), "d", 3)
    assert rows(got) == rows(want.select("phrase", "n", "k")) and len(rows(got)) > 20
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Inner" not in plan and plan.count("Join LeftSemi") == 1


@pytest.mark.parametrize("most", [0, 100])
def test_feature_scores_equal_brute_force(spark, most):
    """The same sums whether the weights go to the features or both are moved; a feature may have several rows."""
    f = [(i, f"f{(i * j) % 7}", j % 3) for i in range(30) for j in range(9)]
    w = [(f"l{k % 2}" if k % 3 else None, f"f{k % 6}", float(k)) for k in range(12)]
    got = joins.feature_scores(spark.createDataFrame(f, "d int, feature string, value int"), spark.createDataFrame(w, "label string, feature string, weight double"), "d", most)
    want = {}
    for d, a, v in f:
        for label, b, x in w:
            if a == b:
                want[d, label] = want.get((d, label), 0) + v * x
    assert {(r.d, r.label): r.score for r in got.collect()} == want


def test_token_totals_equal_counted_tokens(spark):
    """Sums by type are made in the worker and equal those of the tokens themselves."""
    texts = ["8 W 41st St., Apt 5\n(rear) — a@b.com", "", None, "x\0y z", "\x07", "Grüße 12,5 千 www", " ", "né ๑ 'tis 555-234-5678"]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(texts)], "i int, s string")
    for whitespace in (False, True):
        t = df.select("i", F.explode(fn.tokenize("s", whitespace)).alias("t"))
        want = t.groupBy("i", F.col("t.type").alias("type")).agg(F.count("*").alias("n"), F.sum(F.length("t.text")).alias("chars"))
        got = df.select("i", F.explode(fn.token_totals("s", whitespace)).alias("t")).select("i", "t.*")
        assert rows(got) == rows(want)
    assert [r.t for r in df.orderBy("i").select(fn.token_totals("s").alias("t")).collect()][1:3] == [[], None]


@pytest.mark.parametrize("most", [0, 3, 1000])
def test_tfidf_top_equals_ranked_weights(spark, most):
    """The same terms however many of them get their frequency where they are, equal weights by term, zeros too."""
    data = [(d, f"t{k}", 1 + d * k % 3) for d in range(1, 25) for k in range(1, 12) if d % k == 0]
    counts = spark.createDataFrame(data, "d int, term string, tf long")
    got = aggregates.tfidf_top(counts, "d", 24, 3, most=most)
    want = ordering.top_per_group(aggregates.tfidf(counts, "d", 24), ["d"], [F.desc(F.round("weight", 9)), F.col("term")], 3)
    digits = lambda df: rows(df.select("d", "term", "rank", F.round("weight", 9)))
    assert digits(got) == digits(want) and len(digits(got)) > 40
