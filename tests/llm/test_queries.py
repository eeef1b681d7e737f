"""The registered queries against their SQL, and the pipeline against its stages by brute force."""

import os
import random

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from placewright.llm import queries

SF = "/root/testdata/sf0.001"
TABLES = "documents embeddings pages benchmark labels conversations".split()


def plain(v):
    return "" if v is None or v != v else repr(round(v, 9)) if isinstance(v, float) else str(v)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    want = con.sql(queries.ORACLE[name]).df()
    assert sorted(want.columns) == columns
    assert got == sorted(tuple(map(plain, r)) for r in want[columns].astype(object).itertuples(index=False))


def test_pipeline(spark, tmp_path):
    from test_operators import contaminated, linked

    rng = random.Random(1)
    good = lambda n=80: " ".join(rng.choice(["river", "stone", "walks", "under", "quiet", "evening", "light", f"n{rng.randrange(99)}"]) for _ in range(n))
    bad = lambda: "$$$ ".join(rng.choice(["WIN", "FREE", "CLICK", "NOW", "###"]) for _ in range(60))
    passage = good(14)
    rows = [(i, bad() if i % 5 == 0 else good(), f"s{i % 4}") for i in range(200)]
    rows += [(200 + i, rows[i + 1][1] + " tail", "s1") for i in range(3)] + [(300, good() + " " + passage, "s2"), (301, passage, "s2")]
    spark.createDataFrame([(i, t, "en", s, len(t)) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 5 > 0), 0) for i in range(200)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    sf, docs = str(tmp_path), spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "MinHash near-dedup", "benchmark decontamination", "mixing sources to target weights", "token-ID / binary output"]
    seen = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        out.write.parquet(f"{tmp_path}/stage{k}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/stage{k}")
        if k < 4:
            assert docs.columns == before.columns
            seen.append([(r.doc_id, r.text, r.source) for r in docs.collect()])
    assert {i for i, _, _ in seen[0]} == {i for i, t, _ in rows if "$$$" not in t}
    assert {i for i, _, _ in seen[1]} == {c for _, _, c in linked(seen[0])} and len(seen[1]) == len({i for i, _, _ in seen[1]})
    assert {i for i, _, _ in seen[2]} == {i for i, _, hit, _ in contaminated(seen[1], [(1, passage)]) if not hit} and not {300, 301} & {i for i, _, _ in seen[2]}
    total = sum(len(t.split()) for _, t, _ in seen[2])
    assert {i for i, _, _ in seen[3]} <= {i for i, _, _ in seen[2]} and abs(sum(len(t.split()) for _, t, _ in seen[3]) - total) < 4 * 80
    packed = docs.collect()
    assert sorted(d for r in packed for d, off in zip(r.doc_ids, r.offsets) if off == 0) == sorted(i for i, _, _ in seen[3])
    whole = corpus_pipeline.run(spark, sf).collect()
    assert sum(r.n_tokens for r in whole) == sum(r.n_tokens for r in packed) and all(len(np.frombuffer(r.ids, "<u2")) == 2048 for r in whole)
