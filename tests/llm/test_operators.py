"""Each operator against a brute-force version, with nulls, empty and long texts, ties, repeated
rows, empty tables and extra columns whose names clash with the operator's own."""

import itertools
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from placewright.llm import chat, decontaminate, html, mixing, neardup, packing, pii, quality, tokencount, topk

DOCS = "doc_id long, text string, lang string, source string, n_chars long, h long, size long, key string, term string, n long"


def documents(spark, rows):
    """rows: (doc_id, text, source); the extra columns clash with internal names."""
    return spark.createDataFrame([(i, t, "en", s, 0, 7, 7, "k", "t", 7) for i, t, s in rows], DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


# -- decontamination


def ascii_words(text):
    return [] if text is None else re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))


def contaminated(docs, items, width=10):
    out = []
    for i, text, _ in docs:
        ws, hit, found = ascii_words(text), set(), set()
        for item, passage in items:
            ps = ascii_words(passage)
            for k in range(max(1, len(ps) - width + 1)) if ps else ():
                win = ps[k : k + width]
                for at in range(len(ws) - len(win) + 1):
                    if ws[at : at + len(win)] == win:
                        hit.update(range(at, at + len(win)))
                        if item is not None:
                            found.add(str(item))
        out.append((i, len(ws), len(hit), sorted(found)))
    return sorted(out, key=repr)


def test_decontamination(spark, empty):
    rng = random.Random(5)
    text = lambda n: " ".join(rng.choice(["a", "B", "c!", "É", "the", "x9y"]) for _ in range(n))
    items = [(1, text(25)), (2, text(12)), (3, "a B"), (4, "solo"), (5, None), (6, "..."), (7, text(10)), (None, "lonely pair")]
    items.append((8, items[0][1]))  # the same passage again
    docs = [(i, text(rng.randint(0, 60)), "s") for i in range(30)]
    docs += [(40, f"start {items[0][1]} mid {items[0][1][:40]} end", "s"), (41, None, "s"), (42, "", "s"), (43, "SOLO", None), (44, " ".join([items[1][1]] * 40), "s"), (45, "a lonely pair", "s")]
    docs += [(40, docs[30][1], "s"), (40, "another text of one id", "s"), (None, "solo", "s")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contamination(documents(spark, docs), bench).select("doc_id", "n_words", "n_hit", "items").collect()
    assert sorted(((r.doc_id, r.n_words, r.n_hit, sorted(r["items"])) for r in got), key=repr) == contaminated(docs, items)
    clean = decontaminate.decontaminate(documents(spark, docs), bench)
    assert clean.columns == documents(spark, docs).columns
    want = [d[0] for d, r in zip(docs, [contaminated([d], items)[0] for d in docs]) if r[2] == 0]
    assert sorted((r.doc_id for r in clean.collect()), key=repr) == sorted(want, key=repr)
    assert decontaminate.contamination(empty, bench).count() == 0
    assert decontaminate.contamination(documents(spark, docs[:2]), bench.limit(0)).where("n_hit > 0").count() == 0


def test_proximity(spark):
    from placewright.llm.common import Scratch

    rng = random.Random(6)
    docs = [(i, " ".join(rng.choice("pqrstuv") for _ in range(30)), "s") for i in range(12)]
    items = [(1, "p q r"), (2, "s s t")]
    scratch = Scratch(spark, "near")
    terms, windows, _ = decontaminate.prepare(spark.createDataFrame(items, "item_id long, text string"), scratch)
    ids = {r.win_id: r.need for r in windows.join(terms, "term_id").groupBy("win_id").agg(F.array_sort(F.collect_set("term")).alias("need")).collect()}
    index = scratch.write(decontaminate.build_index(documents(spark, docs), terms), "index")
    got = {(r.doc_id, r["at"], tuple(ids[r.win_id])) for r in decontaminate.proximity_hits(index, windows, 5).collect()}
    want = set()
    for i, text, _ in docs:
        ws = text.split()
        for at, need in itertools.product(range(len(ws)), [("p", "q", "r"), ("s", "t")]):
            if ws[at] in need and set(need) <= set(ws[at : at + 5]):
                want.add((i, at, need))
    assert got == want and got


# -- mixing


def goals(sizes, weights=(5, 2, 1), cap=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    full, total, held = {s: cap * sizes[s] for s in names}, sum(sizes.values()), set()
    while True:
        rest, left = total - sum(full[s] for s in held), sum(w[s] for s in names if s not in held)
        over = {s for s in names if s not in held and left and full[s] < w[s] * rest / left}
        if not over:
            return {s: float(full[s]) if s in held else w[s] * rest / left if left else 0.0 for s in names}
        held |= over


def test_mixing(spark, empty):
    rng = random.Random(1)
    docs = [(i, "w " * rng.randint(1, 30), rng.choice(["hot"] * 8 + ["b", "c", "d", "é", None])) for i in range(900)]
    docs += [(2000, None, "void"), (2001, " \t\n", "void"), (2002, "one", "tiny"), (None, "two words", "tiny"), (5, docs[5][1], docs[5][2])]
    got = mixing.mix(documents(spark, docs)).collect()
    assert len(got) == len(docs)
    sizes = {}
    for _, t, s in docs:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = goals(sizes)
    by = {i: s for i, _, s in docs}
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        s = "tiny" if r.doc_id is None else by[r.doc_id]
        assert math.isclose(r.target, want[s], abs_tol=1e-6) and r.source_size == sizes[s] and 0 <= r.copies <= 3
        taken[s] += r.size * r.copies
    assert all(abs(taken[s] - want[s]) <= 30 for s in sizes)
    again = mixing.mix(documents(spark, docs).repartition(5)).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))
    rows = mixing.mixed(documents(spark, docs))
    assert rows.columns == DOCS.replace(" long", "").replace(" string", "").split(", ") and rows.count() == sum(r.copies for r in got)
    assert mixing.mix(empty).count() == 0 and mixing.mixed(empty).count() == 0


def test_budgets_are_nested(spark):
    from placewright.llm.common import Scratch

    docs = documents(spark, [(i, "w " * (i % 7 + 1), "s") for i in range(500)])
    sizes = mixing.sizes_of(docs)
    budgets = spark.createDataFrame([("0s", b) for b in (10.0, 400.0, 1500.0)], "skey string, budget double")
    limits = [r.limit for r in mixing.thresholds(sizes, budgets, Scratch(spark, "n")).orderBy("budget").collect()]
    assert limits == sorted(limits)
    for b, limit in zip((10.0, 400.0, 1500.0), limits):
        assert abs((sizes.where(F.col("h") <= limit).agg(F.sum("size")).first()[0] or 0) - b) <= 4


# -- near-duplicates


def shingle_set(text):
    ws = [] if text is None else re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    return {tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))} if ws else set()


def linked(docs):
    sets = [shingle_set(t) for _, t, _ in docs]
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in itertools.combinations(range(len(docs)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
            root[find(j)] = find(i)
    low = {}
    for i, (d, _, _) in enumerate(docs):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    return sorted(((d, len(sets[i]), low.get(find(i))) for i, (d, _, _) in enumerate(docs)), key=repr)


def test_near_duplicates(spark, empty):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(400)]
    shared = " ".join(rng.choice(words) for _ in range(30))
    docs = []
    for g in range(12):
        base = [rng.choice(words) for _ in range(rng.randint(30, 250))]
        for _ in range(rng.randint(1, 9)):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 60))):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            docs.append((len(docs), " ".join(copy).upper() if rng.random() < 0.2 else " ".join(copy), "s"))
    docs += [(len(docs) + k, shared + " " + " ".join(rng.choice(words) for _ in range(25)), "s") for k in range(60)]
    docs += [(900, None, "s"), (901, "", "s"), (902, " \n", "s"), (903, "one two", "s"), (904, "One  TWO", "s"), (905, "É a b c d", "s"), (906, "é a b c d", "s"), (None, docs[0][1], "s"), (0, "second text of one id here", "s"), (3, docs[3][1], "s")]
    rng.shuffle(docs)
    got = neardup.linked(documents(spark, docs)).collect()
    assert sorted(((r.doc_id, r.n, r.component_id) for r in got), key=repr) == linked(docs)
    kept = neardup.deduplicated(documents(spark, docs))
    assert kept.columns == documents(spark, docs).columns
    ids = [r.doc_id for r in kept.collect() if r.doc_id is not None]
    assert {c for _, n, c in linked(docs) if n and c is not None} <= set(ids) and {900, 901, 902} <= set(ids)
    assert neardup.linked(empty).count() == 0 and neardup.deduplicated(empty).count() == 0


def test_reused_ids_with_different_texts(spark):
    """Rows are removed and kept by id and set: a unique text stays, whatever else has its id."""
    rng = random.Random(21)
    text = lambda: " ".join(f"w{rng.randrange(10**6)}" for _ in range(60))
    a, b, c, d, e, f = (text() for _ in range(6))
    docs = [(1, a), (5, a), (5, b), (5, None), (6, c), (6, d), (6, d), (9, c), (9, d + " z"), (7, e), (7, e + " z"), (8, e), (10, f), (10, f), (None, f)]
    got = sorted(((r.doc_id, r.text) for r in neardup.deduplicated(documents(spark, [(i, t, "s") for i, t in docs])).collect()), key=repr)
    (seven,) = [t for i, t in got if i == 7]
    assert seven in (e, e + " z")
    assert got == sorted([(1, a), (5, b), (5, None), (6, c), (6, d), (7, seven), (10, f), (None, f)], key=repr)


def test_pipeline_near_duplicates_from_080(spark):
    import corpus_pipeline

    base = [f"p{i}" for i in range(100)]
    near, far = list(base), list(base)
    near[30] = near[60] = "x"  # 86 of 106 shingles: 0.81
    far[20] = far[50] = far[80] = "y"  # 81 of 111 and less: 0.73
    docs = documents(spark, [(1, " ".join(base), "s"), (2, " ".join(near), "s"), (3, " ".join(far), "s")])
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicate_stage(spark, docs, "").collect()) == [1, 3]


def test_one_large_group_of_copies(spark):
    """All members of a list are near each other: a star, not all pairs, and still one component."""
    rng = random.Random(4)
    base = [f"v{i}" for i in range(300)]
    docs = []
    for i in range(250):
        copy = list(base)
        copy[rng.randrange(300)] = f"x{i}"
        docs.append((i, " ".join(copy), "s"))
    assert {r.component_id for r in neardup.linked(documents(spark, docs)).collect()} == {0}


# -- quality


def test_quality(spark, empty):
    rng = random.Random(3)
    good = lambda: " ".join(rng.choice(["river", "stone", "walks", "under", "quiet", "evening", "light"]) for _ in range(60)) + "."
    bad = lambda: "$$$ ".join(rng.choice(["WIN", "FREE", "CLICK", "NOW", "###"]) for _ in range(60))
    rows = [(i, good() if i % 3 else bad(), "s") for i in range(600)] + [(600, None, "s"), (601, "", "s"), (602, good() * 200, None), (602, good(), "s"), (None, good(), "s")]
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(600)] + [(None, 1, 0), (5, None, 0), (9999, 0, 0)], "doc_id long, quality int, toxic int")
    got = quality.classified(documents(spark, rows), labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 600]
    assert len(held) > 60 and all(r.predicted == int(r.doc_id % 3 > 0) for r in held)
    import zlib

    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
    again = quality.classified(documents(spark, rows).repartition(3), labels.repartition(2)).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))
    assert quality.classified(empty, labels).count() == 0
    one = quality.classified(documents(spark, rows), labels.where("quality = 1")).select("score").distinct().collect()
    assert [r.score for r in one] == [1.0]
    assert [r.score for r in quality.classified(documents(spark, rows), labels.limit(0)).select("score").distinct().collect()] == [0.5]
    assert quality.filtered(documents(spark, rows), labels).columns == documents(spark, rows).columns


# -- packing


def first_fit_rows(lengths, size):
    """Best fit by search over all open rows."""
    rows = []
    for n in sorted(lengths, reverse=True):
        fits = [r for r in rows if r[0] >= n]
        if fits:
            best = min(fits, key=lambda r: r[0])
            best[0] -= n
        else:
            rows.append([size - n])
    return len(rows)


def test_best_fit_tree():
    rng = random.Random(8)
    for size in (1, 7, 64, 100):
        lengths = [rng.randint(1, size) for _ in range(200)]
        rows = packing.best_fit_decreasing(lengths, size)
        assert sorted(i for r in rows for i in r) == list(range(200)) and all(sum(lengths[i] for i in r) <= size for r in rows)
        assert len(rows) == first_fit_rows(lengths, size)


def test_packing_round_trip(spark, empty):
    import tiktoken

    ranks = packing.load_ranks(packing.TOKENIZER)
    plain = tiktoken.Encoding("plain", pat_str=packing.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(9)
    rows = [(i, "".join(rng.choice(["ab", " the", "\n", " ", ".", "é日", "  ", "x1"]) for _ in range(rng.randint(0, 90))), "s") for i in range(120)] + [(500, "long text " * 700, "s"), (501, None, "s"), (502, "", "s"), (None, "no id", "s"), (1, "again", "s")]
    back, used = {}, 0
    for r in packing.packed(documents(spark, rows), length=64, buffer=900).collect():
        ids, positions = np.frombuffer(r.ids, "<u2"), np.frombuffer(r.positions, "<u4")
        assert len(ids) == len(positions) == 64 and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens <= 64 and (ids[r.n_tokens :] == 50256).all()
        for d, off, a, b in zip(r.doc_ids, r.offsets, r.cu_seqlens, r.cu_seqlens[1:]):
            assert positions[a:b].tolist() == list(range(b - a))
            back.setdefault(d, []).append((off, ids[a:b].tolist()))
        used += r.n_tokens
    want = {}
    for d, t, _ in rows:
        if t:
            want.setdefault(d, []).append(plain.encode_ordinary(t))
    assert used == sum(len(x) for v in want.values() for x in v) and back.keys() == want.keys()
    for d, parts in want.items():
        if len(parts) == 1:
            assert [x for _, ids in sorted(back[d]) for x in ids] == parts[0]
    assert packing.packed(empty).count() == 0


# -- search


def test_topk(spark):
    rng = np.random.default_rng(5)
    data = [(int(i), rng.normal(size=8).round(2).tolist()) for i in range(-50, 400)]
    data += [(1000, None), (1001, [1.0, None]), (1002, [float("nan")] * 8), (1003, [float("inf")] * 8), (1004, []), (1005, [1.0, 2.0]), (7, data[57][1]), (7, data[57][1]), (None, [1.0]), (1100, [1e-9] * 8), (1200, [1e6] * 8)]
    vectors = spark.createDataFrame(data, "vec_id long, embedding array<float>").withColumn("v", F.lit(1)).withColumn("score", F.lit(2))
    ok = [(i, [math.floor(1024 * float(np.float32(x))) for x in v] + [0] * (8 - len(v))) for i, v in data if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    got = {}
    for r in topk.search(vectors, vectors.where("vec_id % 100 = 0"), block=16).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.score, r.vec_id)
    queries = {i: v for i, v in ok if i % 100 == 0}
    assert got.keys() == queries.keys()
    for q, v in queries.items():
        want = sorted(((-sum(a * b for a, b in zip(v, w)), i) for i, w in ok if i != q))[:10]
        assert [got[q][k + 1] for k in range(10)] == [(-s, i) for s, i in want]
    chunked = topk.search(vectors, vectors.where("vec_id % 100 = 0"), chunk=2).count()
    assert chunked == 10 * len(queries)
    few = vectors.where("vec_id in (0, 1, 2)")
    assert topk.search(few, few.where("vec_id = 0")).count() == 2
    assert topk.search(vectors.limit(0), vectors.limit(0)).count() == 0 and topk.search(vectors.where("vec_id = 0"), vectors.where("vec_id = 0")).count() == 0


def test_blocks_are_pruned():
    rng = np.random.default_rng(1)
    rows = np.floor(np.concatenate([rng.normal(k, 0.1, size=(200, 4)) for k in (-9, 0, 9)]) * 100)
    s, f = np.full((1, 5), topk.EMPTY), np.full((1, 5), topk.EMPTY)
    blocks = topk.Blocks(np.arange(600), rows, 50)
    assert blocks.search(np.array([-1]), np.full((1, 4), 100.0), s, f, 5) < len(blocks.ids)
    best = rows @ np.full(4, 100.0)
    assert sorted(s[0].tolist()) == sorted(np.sort(best)[-5:].astype(int).tolist())


# -- token counts


def test_token_counts(spark, empty):
    pieces = tokencount.load_pieces()
    longest = max(map(len, pieces))

    def brute(word):
        best = [(0.0, 0)]
        for i in range(1, len(word) + 1):
            n = len(word[i - 1].encode())
            options = [(best[i - 1][0] + tokencount.UNKNOWN * n, best[i - 1][1] + n)]
            options += [(best[j][0] + pieces[word[j:i]], best[j][1] + 1) for j in range(max(0, i - longest), i) if word[j:i] in pieces]
            best.append(max(options, key=lambda o: (o[0], -o[1])))
        return best[-1][1]

    rng = random.Random(7)
    rows = [(i, "".join(rng.choice("abcdefgh  \n日é") for _ in range(rng.randint(0, 80))), "s") for i in range(60)] + [(90, None, "s"), (91, "", "s"), (92, "word " * 5000, "s"), (None, "x", "s"), (1, "twice", "s")]
    got = sorted((repr(r.doc_id), r.n_words, r.n_tokens) for r in tokencount.counted(documents(spark, rows)).collect())
    assert got == sorted((repr(i), len((t or "").split()), sum(brute(tokencount.MARK + w) for w in (t or "").split())) for i, t, _ in rows)
    assert tokencount.counted(empty).count() == 0


# -- chat


def test_chat_round_trip():
    rng = random.Random(11)
    part = ["<", "|", ">", "<|", "<||", chat.START, chat.END, "a", "\n", "\\", "\\n", "é"]
    text = lambda: "".join(rng.choice(part) for _ in range(rng.randint(0, 7)))
    for window in (2, 64):
        one = chat.Formatter(chat.render, window)
        for _ in range(2000):
            turns = [(rng.choice(["user", "assistant", text()]), text()) for _ in range(rng.randint(1, 6))]
            out, spans, rewrites = one(turns)
            assert not rewrites and chat.parse(out) == turns
            assert [chat.unescape(out[x:y]) for _, _, x, y in spans] == [t for _, t in turns] and [s[0] for s in spans] == [0, *[s[1] for s in spans[:-1]]]


def test_templates_that_rewrite_history():
    forget = lambda turns: "".join(f"[{r}]{t if i == len(turns) - 1 else t[:1]}" for i, (r, t) in enumerate(turns))
    assert chat.Formatter(forget)([("user", "hello"), ("assistant", "there")])[2]
    opened = lambda turns: "<s>" + "".join(f"{r}: {t}\n" for r, t in turns)
    out, spans, rewrites = chat.Formatter(opened)([("user", "hi"), ("assistant", "yo")])
    assert not rewrites and [out[x:y] for _, _, x, y in spans] == ["hi", "yo"]


def test_frames_that_vary_from_turn_to_turn():
    numbered = lambda turns: "".join(f"Turn {i}: {t}{'!' * (i % 3)}\n" for i, (_, t) in enumerate(turns))
    tools = lambda turns: "".join(f"[{'tool ' if t.startswith('{') else ''}{r}] {t}\n" for r, t in turns)
    turns = [("user" if i % 2 == 0 else "assistant", f"text {i}") for i in range(25)]
    out, spans, rewrites = chat.Formatter(numbered)(turns)
    assert not rewrites and [out[x:y] for _, _, x, y in spans] == [t for _, t in turns]
    out, spans, _ = chat.Formatter(tools)([("user", "hi"), ("user", "{1}"), ("user", "bye")])
    assert [out[b:x] for b, _, x, _ in spans][::2] == ["[user] "] * 2 and all(t in out[x:y] for t, (_, _, x, y) in zip(["hi", "{1}", "bye"], spans))


def test_chat_rows(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", "a"), (2, 0, None, None), (2, None, "system", "first"), (3, 0, "user", "x"), (3, 0, "user", "x"), (None, 0, "assistant", "n"), (4, 0, "assistant", "y" * 100_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("n_turns", F.lit(0))
    got = {r.conv_id: r for r in chat.formatted(df).collect()}
    assert {k: chat.parse(r.formatted) for k, r in got.items()} == {1: [("user", "a"), ("assistant", "b")], 2: [("system", "first"), ("", "")], 3: [("user", "x")] * 2, None: [("assistant", "n")], 4: [("assistant", "y" * 100_000)]}
    assert {r.conv_id: r.loss_chars for r in chat.digests(chat.formatted(df)).collect()} == {1: 1, 2: 0, 3: 0, None: 1, 4: 100_000}
    assert chat.formatted(df.limit(0)).count() == 0


# -- personal data


def base_spans(t):
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[ -]", "", m[0])
        if 16 <= len(d) <= 19 and pii.luhn(d):
            out.append(("card", m.start(), m.end()))
    out += [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return out


def test_base_spans():
    rng, find = random.Random(12), pii.Finder()
    part = ["a", "B", "1", "23", "255", "300", "0", "4111 1111 1111 1111", "5500-0000-0000-0004", "@", ".", "-", "+", " ", "(", ")", "é", "٣", "\n", "x.y", "%", "com", "+44 20 7946 0958", "10.0.0.1", ",", "İ"]
    for _ in range(30_000):
        t = "".join(rng.choice(part) for _ in range(rng.randint(0, 14)))
        assert [s for s in find(t) if s[0] in pii.BASE] == base_spans(t), t
    assert find("1" * 100_000 + " " + "a@" * 50_000 + "." * 50_000) == []  # linear, unlike the patterns themselves
    long = "1" * 3_000 + " " + "a@" * 3_000 + "." * 3_000 + "+1 " * 1_000
    assert [s for s in find(long) if s[0] in pii.BASE] == base_spans(long)


def test_added_spans(spark, empty):
    find = pii.Finder()
    said = lambda t: {(k, t[a:b]) for k, a, b in find(t)}
    assert ("url", "https://x.org/a?b=1") in said("go to https://x.org/a?b=1.") and ("iban", "GB82 WEST 1234 5698 7654 32") in said("GB82 WEST 1234 5698 7654 32 is it")
    assert ("account", "00123456") in said("Account no: 00123456 please") and ("account", "abc123XYZ") in said('api_key = "abc123XYZ"')
    long = "eyJ" + "aB3_-." * 500 + "z9"
    assert ("account", long) in said(f"bearer: {long} and more") and ("account", "abc123") in said("token=password: abc123")
    assert find("token=" * 50_000) == []  # linear, as a run of no digits is read once
    assert [r.text for r in pii.redacted(documents(spark, [(1, f"token={long}, kept", "s")])).collect()] == ["token=<account>, kept"]
    assert said("the token of thanks, account of 1999 people") == set() and said("GB82 WEST 1234 5698 7654 33") == set()
    rows = [(1, "a@b.co and 10.0.0.1", "s"), (2, None, "s"), (3, "", "s"), (1, "a@b.co and 10.0.0.1", "s")]
    got = pii.summary(pii.spans_of(documents(spark, rows))).collect()
    assert [(r.n_email, r.n_ip, r.spans) for r in got] == [(1, 1, "email:0:6,ip:11:19"), (0, 0, ""), (0, 0, ""), (1, 1, "email:0:6,ip:11:19")]
    assert [r.text for r in pii.redacted(documents(spark, rows)).collect()][0] == "<email> and <ip>"
    assert pii.summary(pii.spans_of(empty)).count() == 0


# -- pages


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (None, ""), ("", ""), ("plain &amp; simple", "plain & simple"), ("a < b", "a < b"),
        ("<nav>m</nav><article><h1>T</h1><p>one <b>t</b>wo<p>three<br>four<div class='comments'>no</div></article><footer>f", "T one two three four"),
        ("<main><p>x</p><aside>y</aside><script>if (a < b) '</p>'</script><p>z&nbsp;z</p></main>", "x z z"),
        ("<body class='has-sidebar'><div id='cookie-notice'>n</div><div class='post'><p>body</p></div><div class='sidebar'>s</div>", "body"),
        ("<article>A<table><tr><td>1<td>2</table><ul><li>i<li>j</ul><form><input>f</form><p hidden>h</p></article>", "A 1 2 i j"),
        ("<p>unclosed <a href='x>y'>li&#110;k</a> <!-- c --> end", "unclosed link end"), ("<p>&copy; &am &#x1F600; &bogus;", "© &am 😀 &bogus;"),
        ("<article><p>long main text here</p></article><article class='teaser'><p>x</p></article>", "long main text here"),
    ],
)
def test_main_text(page, want):
    assert html.main_text(page) == want


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<div class='entry-title'><a href='/'>T</a></div><div class='entry-content'><p>a much longer body of text</p></div>", "T a much longer body of text"),
        ("<article>a long section of the page's text</article><article>short</article>", "a long section of the page's text short"),
        ("<article class='has-sidebar'>long main text here</article><article>short</article>", "long main text here short"),
        ("<article>main</article><aside class='related'><article>of another page, and longer</article></aside>", "main"),
        ("<aside><article>only one</article></aside>", "only one"), ("<article class='teaser'>one</article><article class='teaser'>two</article>", "one two"),
    ],
)
def test_main_nodes_go_by_marks_not_by_size(page, want):
    assert html.main_text(page) == want


def test_wrapper_induction(spark):
    """Pages without any telling mark: what is the same on the host's pages goes, what varies stays."""
    rows = [(i, f"http://h.example/{i}", f"<html><body><div><p>Home</p><p>About us</p></div><div><p>story {i} begins</p><p>and goes on {i * 7}</p></div><div><p>All rights kept</p></div></body></html>") for i in range(8)]
    rows += [(90, "http://other.example/", "<p>Home</p>"), (91, None, "<p>x</p>"), (92, "http://h.example/z", None), (93, "not a url at all", "<p>y</p>"), (3, rows[3][1], rows[3][2])]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("q")).withColumn("text", F.lit("q"))
    got = sorted(((r.page_id, r.text) for r in html.extracted(df).collect()))
    assert got == sorted([(i, f"story {i} begins and goes on {i * 7}") for i in [*range(8), 3]] + [(90, "Home"), (91, "x"), (92, ""), (93, "y")])
    copies = spark.createDataFrame([(i, f"http://c.example/{i}", f"<div><p>same text</p></div><i>{0}</i>") for i in range(9)], "page_id long, url string, html string")
    assert {r.text for r in html.extracted(copies).collect()} == {"same text 0"}
    assert html.extracted(df.limit(0)).count() == 0


def test_long_sibling_lists_are_aligned(spark):
    """The template goes whatever the number of blocks beside it, and where the numbers differ."""
    page = lambda i, n: "<body><p>Home</p><p>About us</p>" + "".join(f"<p>line {i} {k}</p>" for k in range(n)) + "<p>All rights kept</p></body>"
    rows = [(i, f"http://h.example/{i}", page(i, 80 + 7 * i)) for i in range(6)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert sorted((r.page_id, r.text) for r in html.extracted(df).collect()) == [(i, " ".join(f"line {i} {k}" for k in range(80 + 7 * i))) for i in range(6)]


def test_ordered_matching_is_heaviest():
    rng = np.random.default_rng(3)
    for _ in range(300):
        n, m = rng.integers(0, 9, 2)
        w = rng.integers(0, 4, (n, m))
        best = [[0] * (m + 1) for _ in range(n + 1)]
        for i in range(n):
            for j in range(m):
                best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + w[i][j])
        got = sorted(html._ordered(lambda i: w[i], 0, n, 0, m))
        assert sum(w[i][j] for i, j in got) == best[n][m] and all(a[0] < b[0] and a[1] < b[1] for a, b in zip(got, got[1:]))


def test_tree_matching():
    a = html.outline(html.parse("<div><p>1</p><ul><li>x</li></ul><p>2</p></div>"), [])
    b = html.outline(html.parse("<div><h2>t</h2><p>1</p><ul><li>x</li></ul><p>3</p></div>"), [])
    assert [x[0] for x, _ in sorted(html.match(a, b), key=lambda p: p[0][0])] == ["", "div.", "li.", "p.", "p.", "ul."]
