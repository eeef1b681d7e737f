"""Benchmark decontamination over a distributed positional inverted index.

The training side is a table of postings ``(doc_id, h, pos, term_id)`` of the words that occur in
the test items, plus one length marker per document. Test items are cut into windows of ten words
(a shorter item is one window). For each window the two rarest terms, by their counts in the
index, are looked up first: their lists, shifted by the term's offset in the window, are
intersected by one aggregation, and only starts that survive are checked against the postings of
the remaining terms. Everything is DataFrame code.

Defined cases: null text has no words; documents without hits are returned with zeros; a document
is identified by ``(doc_id, hash of its text)``, so rows that repeat a doc_id with other texts
are judged apart, repeated rows get equal results, and a null doc_id is an identity like any
other. Items with a null id count as hits but add no id to the list. Equal windows of several
items count for each of these. Extra columns of either table are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import LOWER, UPPER, Scratch, small, unused

WIDTH = 10
#: Code points that end a word, all but the space (which the translation maps them to).
_BREAKS = "".join(chr(c) for c in range(0x80) if not (chr(c).isdigit() or chr(c).isalpha() or c == 0x20))
#: Marker of a document's length in the index; no word can be equal to it.
_END = "\x00"
_END_ID = -1
#: Proven bounds for broadcast sides, in rows of at most a few dozen bytes.
MAX_TERMS, MAX_SLOTS, MAX_DOCS = 500_000, 1_000_000, 500_000


def words(text: Column) -> Column:
    """The lower-cased words of a text, in order."""
    clean = F.translate(F.coalesce(text, F.lit("")), UPPER + _BREAKS, LOWER + " " * len(_BREAKS))
    return F.array_remove(F.split(clean, " "), "")


def _short_terms(terms: DataFrame) -> DataFrame:
    """Broadcast the test vocabulary if its rows and characters are within the bound."""
    head = terms.limit(MAX_TERMS + 1).agg(F.count("*").alias("n"), F.sum(F.length("term")).alias("c")).first()
    return F.broadcast(terms) if head.n <= MAX_TERMS and (head.c or 0) <= 32 * MAX_TERMS else terms


def build_index(documents: DataFrame, terms: DataFrame) -> DataFrame:
    """Postings of ``terms`` (term, term_id), and per document a row (term_id -1, pos = words)."""
    docs = documents.select("doc_id", F.xxhash64("text").alias("h"), words(F.col("text")).alias("w"))
    flat = docs.select("doc_id", "h", F.posexplode(F.concat("w", F.array(F.lit(_END)))).alias("pos", "term"))
    vocabulary = terms.unionByName(terms.sparkSession.createDataFrame([(_END, _END_ID)], "term string, term_id long"))
    return flat.join(_short_terms(vocabulary), "term").select("doc_id", "h", "pos", "term_id")


def windows_of(benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """(item_id, win): each window's words, for every item with words."""
    items = benchmark.select("item_id", words(F.col("text")).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - width + 1, F.lit(1)))
    return items.select("item_id", "w", F.explode(starts).alias("s")).select("item_id", F.slice("w", F.col("s"), width).alias("win"))


def phrase_hits(index: DataFrame, windows: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, h, start, win_id, m): every exact occurrence of a window.

    ``windows``: (win_id, off, term_id, m), one row per word of a window.
    """
    df = index.where(F.col("term_id") >= 0).groupBy("term_id").agg(F.count("*").alias("df"))
    ranked = windows.join(df, "term_id", "left").fillna(0, ["df"])
    per = W.partitionBy("win_id")
    ranked = scratch.write(ranked.withColumn("least", F.min("df").over(per)).withColumn("rank", F.row_number().over(per.orderBy("df", "off"))).where("least > 0"), "ranked")
    slots = ranked.where("rank <= 2").select("term_id", "win_id", "off", "m", F.expr("shiftleft(1, rank - 1)").alias("bit"))
    on_doc = [F.col("p.doc_id").eqNullSafe(F.col("c.doc_id")), F.col("p.h") == F.col("c.h")]
    starts = (
        index.where(F.col("term_id") >= 0)
        .join(small(slots, MAX_SLOTS), "term_id")
        .where("pos >= off")
        .select("doc_id", "h", (F.col("pos") - F.col("off")).alias("start"), "win_id", "m", "bit")
        .groupBy("doc_id", "h", "start", "win_id", "m")
        .agg(F.bit_or("bit").alias("bits"))
        .where("bits = shiftleft(1, least(m, 2)) - 1")
        .drop("bits")
    )
    starts = scratch.write(starts, "starts")
    rest = ranked.where("rank > 2").select(F.col("win_id").alias("w2"), "off", F.col("term_id").alias("t2"))
    wanted = starts.where("m > 2").join(small(rest, MAX_SLOTS), F.col("win_id") == F.col("w2")).select("doc_id", "h", "start", "win_id", "m", "off", "t2", (F.col("start") + F.col("off")).alias("at"))
    found = starts.select("doc_id", "h").distinct()
    near = index.alias("p").join(small(found, MAX_DOCS).alias("c"), on_doc, "left_semi").where(F.col("term_id") >= 0)
    longer = (
        near.alias("p")
        .join(wanted.alias("c"), [*on_doc, F.col("p.pos") == F.col("c.at"), F.col("p.term_id") == F.col("c.t2")])
        .select("c.doc_id", "c.h", "start", "win_id", "m", "off")
        .groupBy("doc_id", "h", "start", "win_id", "m")
        .agg(F.bit_or(F.expr("shiftleft(1L, off)")).alias("bits"))
        .where("bit_count(bits) = m - 2")
        .drop("bits")
    )
    return longer.unionByName(starts.where("m <= 2"))


def proximity_hits(index: DataFrame, windows: DataFrame, span: int) -> DataFrame:
    """(doc_id, h, at, win_id): places where all words of a window lie, in any order, within
    ``span`` words that begin at ``at``, a position of one of these words.

    Postings meet in blocks of ``span`` positions (each also in the block before), so a place is
    one aggregation over its block, not a product of lists. A word that a window holds twice is
    asked for once.
    """
    words_ = windows.select("win_id", "term_id").distinct()
    need = words_.groupBy("win_id").agg(F.count("*").alias("need"))
    hits = index.where(F.col("term_id") >= 0).join(small(words_, MAX_SLOTS), "term_id").select("doc_id", "h", "win_id", "pos", "term_id").distinct()
    block = F.floor(F.col("pos") / span)
    both = hits.withColumn("block", F.explode(F.array(block, block - 1)))
    per = W.partitionBy("doc_id", "h", "win_id", "block").orderBy("pos").rangeBetween(0, span - 1)
    seen = both.withColumn("n", F.size(F.collect_set("term_id").over(per))).where(F.col("block") == block)
    return seen.join(need, "win_id").where("n = need").select("doc_id", "h", F.col("pos").alias("at"), "win_id").distinct()


def prepare(benchmark: DataFrame, scratch: Scratch, width: int = WIDTH) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The test side: terms (term, term_id), windows (win_id, off, term_id, m), items (win_id, item_id)."""
    if width > 62:
        raise ValueError("windows of at most 62 words")
    wins = windows_of(benchmark, width)
    ids = scratch.write(wins.select("win").distinct().withColumn("win_id", F.monotonically_increasing_id()), "windows")
    items = scratch.write(wins.join(ids, "win").select("win_id", "item_id").distinct(), "items")
    flat = ids.select("win_id", F.size("win").alias("m"), F.posexplode("win").alias("off", "term"))
    terms = scratch.write(flat.select("term").distinct().withColumn("term_id", F.monotonically_increasing_id()), "terms")
    windows = scratch.write(flat.join(terms, "term").select("win_id", "off", "term_id", "m"), "slots")
    return terms, windows, items


def contamination(documents: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """Per document row: doc_id, h, n_words, n_hit, n_items, items (sorted ids as strings)."""
    scratch = Scratch(documents.sparkSession, "decontaminate")
    terms, windows, items = prepare(benchmark, scratch, width)
    index = scratch.write(build_index(documents, terms), "index")
    hits = scratch.write(phrase_hits(index, windows, scratch), "hits")
    lengths = scratch.write(index.where(F.col("term_id") == _END_ID).select("doc_id", "h", F.col("pos").cast("long").alias("n_words")), "lengths")
    scratch.drop(index)
    covered = (
        hits.select("doc_id", "h", F.explode(F.expr("sequence(start, start + m - 1)")).alias("at"))
        .groupBy("doc_id", "h", "at").agg(F.lit(1).alias("one"))
        .groupBy("doc_id", "h").agg(F.count("one").alias("n_hit"))
    )
    named = (
        hits.select("doc_id", "h", "win_id").distinct().join(small(items, MAX_SLOTS), "win_id")
        .groupBy("doc_id", "h").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    )
    same = lambda a, b: [a.doc_id.eqNullSafe(b.doc_id), a.h == b.h]
    per_doc = covered.join(named, same(covered, named)).select(covered.doc_id, covered.h, "n_hit", "items")
    found = F.coalesce("items", F.array().cast("array<string>"))
    return lengths.join(per_doc, same(lengths, per_doc), "left").select(
        lengths.doc_id, lengths.h, "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(found).cast("long").alias("n_items"),
        found.alias("items"),
    )


def decontaminate(documents: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """``documents`` without the rows in which a window of the benchmark occurs."""
    d, h = unused(documents, "hit_id", "hit_hash")
    hit = contamination(documents, benchmark, width).where("n_hit > 0").select(F.col("doc_id").alias(d), F.col("h").alias(h)).distinct()
    return documents.join(small(hit, MAX_DOCS), documents.doc_id.eqNullSafe(F.col(d)) & (F.xxhash64(documents.text) == F.col(h)), "left_anti")
