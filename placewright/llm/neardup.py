"""Near-duplicates of documents: bottom-k sketches from one hash function.

1. Each document becomes its set of 5-word shingles under one 64-bit hash function; the smallest
   ``K`` values are its sketch. Documents with equal sets (a 128-bit digest) form a class with a
   number of its own, and only classes go on, so exact copies never meet pairwise.
2. The sketches' values make inverted lists. Two sets at the threshold share at least ``need`` of
   their values (see below), so under one order of all values, rarest first, they share one among
   the first ``K - need + 1``: only these make lists, which keeps passages that many documents
   share out of them.
3. Lists give overlaps. First, each list's smallest member meets the others (a star), which links
   most groups of copies; then only members that are still in another component than the list's
   main one meet the list. Pairs whose sizes alone rule out the threshold are left out at once.
   Where more than ``CROWDED`` members are, as in a large group of copies that are not all alike, their pairs grow
   with the square of the group, so they are never made as rows: the members meet as a crowd.
4. Pairs meet in rooms: the members of a neighbourhood, in blocks of ``ROOM`` values by a hash, and in more
   blocks where their pairs are many, so a set moves once per room and not once per pair. A room streams its pairs past its sets: the
   estimate from the union's sketch filters them, the full sets verify them. A crowd's room takes all
   pairs of two blocks by matrix products over the values its full sets share, without an estimate, and gives
   one link for each two components that it joins.
5. Links become components by alternating large-star and small-star rounds, all as tables.

Sketch overlaps below ``SLACK`` = 0.5 of ``K`` = 64 have a probability under 1e-11 for a pair at
a similarity of 0.85 (op6) and under 2e-8 at 0.8 (the pipeline), so no link is lost but for that; there is no cap on lists, partners or rounds.

Defined cases: null or wordless text has an empty set and no links; fewer words than ``width``
are one shingle; a document's identity is its row: rows with one doc_id and different texts are
judged apart. A null doc_id links like any other row; a component's id is the smallest that is not
null. Repeated rows are exact copies; all rows with the smallest id are marked kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import BinaryType, StructField, StructType

from .common import Scratch, pieces, small, unused

WIDTH, K, SLACK, THRESHOLD = 5, 64, 0.5, 85
MAX_ROWS = 500_000
#: Hashes of a room's block (two blocks meet in a room), pairs of a room, and the most bits of a filter of ids.
ROOM, PAIRS, BITS = 1 << 20, 1 << 15, 1 << 26
#: Members of a list outside its main component beyond which it meets as a crowd; hashes and sets of a crowd's block; cells of a matrix.
CROWDED, CROWD, SETS, CELLS = 16, 1 << 21, 1 << 13, 1 << 23
_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


class Shingler:
    """Hashed shingle sets of texts. A word's hash costs less than to look it up in a memo of many words."""

    def __init__(self, width: int = WIDTH):
        import xxhash

        self.width = width
        self.word = xxhash.xxh3_64_intdigest

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z, ASCII space
        if not words:
            return np.empty(0, np.uint64)
        a = np.fromiter(map(self.word, words), np.uint64, len(words))
        n = max(1, len(a) - self.width + 1)
        h = np.zeros(n, np.uint64)
        for j in range(min(self.width, len(a))):
            h ^= h >> np.uint64(29)
            h *= _M[5]
            h += a[j : j + n] * _M[j % 5]
        h ^= h >> np.uint64(32)
        h *= _M[6]
        h ^= h >> np.uint64(29)
        h.sort()
        return h[np.concatenate(([True], h[1:] != h[:-1]))]


def _sketches(width: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        shingles = Shingler(width)
        for batch in pieces(batches):
            n, key, sketch, ends = [], [], [], [0]
            for text in batch.column("text").to_pylist():
                s = shingles(text)
                n.append(len(s))
                key.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                sketch.append(s[:k].view(np.int64))
                ends.append(ends[-1] + len(sketch[-1]))
            values = pa.array(np.concatenate(sketch) if sketch else np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(key, pa.binary()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)],
                names=["doc_id", "n", "key", "sketch"],
            )

    return run


class Marks:
    """A Bloom filter of document ids: an array of bits, of a size bounded by ``BITS``."""

    def __init__(self, bits: int, words: np.ndarray | None = None):
        self.bits, self.words = bits, np.zeros(bits // 64, np.uint64) if words is None else words

    def places(self, ids: np.ndarray) -> np.ndarray:
        h = ids.astype(np.int64).view(np.uint64)
        for shift, factor in ((31, _M[5]), (29, _M[6])):
            h = (h ^ (h >> np.uint64(shift))) * factor
        h ^= h >> np.uint64(32)
        step = (h >> np.uint64(32)) | np.uint64(1)
        return np.stack([(h + np.uint64(i) * step) & np.uint64(self.bits - 1) for i in range(4)])

    def add(self, ids: np.ndarray) -> None:
        at = self.places(ids).ravel()
        np.bitwise_or.at(self.words, at >> np.uint64(6), np.uint64(1) << (at & np.uint64(63)))

    def may_hold(self, ids: np.ndarray) -> np.ndarray:
        at = self.places(ids)
        return ((self.words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1)).all(0)


def _marks_of(ids: DataFrame) -> Marks:
    """The filter of a column of ids that are not null; each task sends its own bits, never ids."""
    bits = min(BITS, 1 << max(12, (16 * ids.count()).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = Marks(bits)
        for batch in batches:
            marks.add(batch.column(0).to_numpy())
        at = np.flatnonzero(marks.words)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(marks.words[at].view(np.int64))], names=["at", "word"])

    rows = ids.mapInArrow(run, "at long, word long").groupBy("at").agg(F.bit_or("word").alias("word")).toArrow()
    words = np.zeros(bits // 64, np.uint64)
    words[rows["at"].to_numpy()] = rows["word"].to_numpy().view(np.uint64)
    return Marks(bits, words)


def _sets(width: int, held):
    """(key, hashes) of the texts whose id may be in the broadcast filter, or is null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        shingles, marks = Shingler(width), held.value
        for batch in pieces(batches):
            ids = batch.column("doc_id")
            may = marks.may_hold(ids.fill_null(0).to_numpy()) | ids.is_null().to_numpy(zero_copy_only=False)
            sets = [shingles(t).tobytes() for t in batch.column("text").filter(pa.array(may)).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_digest(s) for s in sets], pa.binary()), pa.array(sets, pa.binary())], names=["key", "hashes"])

    return run


def _alike(x: np.ndarray, y: np.ndarray, threshold: int, k: int, slack: float) -> bool:
    """Whether two sets reach the threshold: first by the estimate from the bottom-k of their
    union, which the smallest ``k`` of each give, then by the sets themselves."""
    if len(x) > k or len(y) > k:
        both = np.concatenate((x[:k], y[:k]))
        both.sort(kind="stable")
        twice = both[1:] == both[:-1]
        first = np.concatenate(([True], ~twice))
        size = min(k, int(first.sum()))
        if int((twice & (both[1:] <= both[first][size - 1])).sum()) < slack * size:
            return False
    both = np.concatenate((x, y))
    both.sort(kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= threshold * (len(both) - common)


def _meetings(threshold: int, k: int, slack: float):
    """The links among rows sorted by room, its sets (with ``hashes``) before its pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        room, sets = None, {}
        for batch in pieces(batches):
            links: tuple[list[int], list[int]] = [], []
            hashes = batch.column("hashes")
            for i, (here, a, b) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("room", "a", "b")), strict=True)):
                if here != room:
                    room, sets = here, {}
                if b is None:
                    sets[a] = np.frombuffer(hashes[i].as_buffer(), np.uint64).copy()
                elif _alike(sets[a], sets[b], threshold, k, slack):
                    links[0].append(a)
                    links[1].append(b)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in links], names=["a", "b"])

    return run


def _joined(far: np.ndarray, root: np.ndarray, sets: list[np.ndarray], threshold: int, tile: int = 256) -> list[tuple[int, int]]:
    """Positions of linked sets, one link for each two components (by ``root``) that links join; between
    the sides of ``far`` if there are two, else among all."""
    n = np.array([len(s) for s in sets])
    values, column = np.unique(np.concatenate(sets), return_inverse=True)
    owner, starts, crossed = np.repeat(np.arange(len(sets)), n), np.concatenate(([0], np.cumsum(n))), bool(far.any())
    live = np.ones(len(sets), bool)
    while True:  # a set has no link if too few of its values are held by others
        mine, theirs = (np.bincount(column[(live & (far == side))[owner]], minlength=len(values)) for side in (False, True))
        shared = np.where(far[owner], mine[column] > 0, theirs[column] > 0) if crossed else mine[column] > 1
        before, live = live, live & (100 * np.bincount(owner, shared, len(sets)) >= threshold * n)
        if 8 * (before.sum() - live.sum()) <= live.sum():
            break

    def cells(of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        each = [column[starts[i] : starts[i + 1]] for i in of]
        return np.repeat(np.arange(len(of)), n[of]), np.concatenate(each)

    def dense(rows: np.ndarray, places: np.ndarray, count: int, begin: int, end: int) -> np.ndarray:
        out = np.zeros((count, end - begin), np.float32)
        here = (places >= begin) & (places < end)
        out[rows[here], places[here] - begin] = 1
        return out

    rising = np.argsort(n, kind="stable")
    left = rising[live[rising] & ~far[rising]]
    right = rising[live[rising] & far[rising]] if crossed else left
    label, place, links = np.unique(root, return_inverse=True)[1], np.full(len(values), -1), []
    for at in range(0, len(left), tile):
        some = left[at : at + tile]
        begin = max(int(np.searchsorted(100 * n[right], threshold * n[some[0]])), 0 if crossed else at)
        others = right[begin : int(np.searchsorted(threshold * n[right], 100 * n[some[-1]], "right"))]
        if (label[some] == label[some[0]]).all():
            others = others[label[others] != label[some[0]]]
        if not len(others):
            continue
        (rows, mine), (cols, theirs) = cells(some), cells(others)
        used = np.unique(mine)
        place[used] = np.arange(len(used))
        mine, theirs = place[mine], place[theirs]
        place[used] = -1
        both, step = np.zeros((len(some), len(others))), max(256, CELLS // len(others))
        for c in range(0, len(used), step):
            end = min(c + step, len(used))
            both += dense(rows, mine, len(some), c, end) @ dense(cols, theirs, len(others), c, end).T
        alike = 100 * both >= threshold * (n[some][:, None] + n[others] - both)
        i, j = np.nonzero(alike & (label[some][:, None] != label[others]))
        a, b = some[i], others[j]
        first = np.unique(np.minimum(label[a], label[b]) * len(sets) + np.maximum(label[a], label[b]), return_index=True)[1]
        for x, y in zip(a[first].tolist(), b[first].tolist(), strict=True):
            if label[x] != label[y]:
                links.append((x, y))
                label[label == label[y]] = label[x]
    return links


def _crowd_links(threshold: int):
    """The links among rows sorted by room (crowd, one, two), each with a set."""

    def links(rows: list[tuple[bool, int, int, np.ndarray]]) -> pa.RecordBatch:
        far, cid, root, sets = zip(*rows, strict=True)
        found = _joined(np.array(far), np.array(root), list(sets), threshold)
        return pa.RecordBatch.from_arrays([pa.array([cid[x[side]] for x in found], pa.int64()) for side in (0, 1)], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        room, rows = None, []
        for batch in pieces(batches):
            hashes = batch.column("hashes")
            for i, (crowd, one, two, far, cid, root) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("crowd", "one", "two", "far", "cid", "root")), strict=True)):
                if (crowd, one, two) != room:
                    if rows:
                        yield links(rows)
                    room, rows = (crowd, one, two), []
                rows.append((far, cid, root, np.frombuffer(hashes[i].as_buffer(), np.uint64).copy()))
        if rows:
            yield links(rows)

    return run


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root): the smallest node of each linked node's component; ``links``: (a, b).

    Alternates large-star (larger neighbours point to the smallest) and small-star (smaller ones
    do), which ends in stars after a logarithmic number of rounds; each round is written. A round
    sends at most one row per edge and direction, so a hub is an aggregation key, never a list.
    """
    edges = scratch.write(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    rounds, before = 0, None
    while True:
        rounds += 1
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = scratch.write(large, f"large{rounds}")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small_ = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        after = scratch.write(small_.select("e.*").where("u <> v").distinct(), f"small{rounds}")
        stamp = after.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        scratch.drop(edges, large)
        edges = after
        if stamp == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = stamp


def _lists(classes: DataFrame, k: int, slack: float, scratch: Scratch) -> DataFrame:
    """(value, cid, n): the inverted lists of the values that can witness a link, rarest first."""
    flat = classes.select("cid", F.explode("sketch").alias("value"))
    df = scratch.write(flat.groupBy("value").agg(F.count("*").cast("int").alias("df")).where("df > 1"), "df")
    scratch.tidy()
    shared = flat.join(df, "value").groupBy("cid").agg(F.collect_list(F.struct("df", "value")).alias("v"))  # at most k of a class
    s = F.least("n", F.lit(k))
    prefix = s - F.greatest(F.floor(s * slack), F.lit(1)) + 1
    alone = s - F.size("v")  # unshared values come first
    head = F.slice(F.array_sort("v"), F.lit(1), F.greatest(prefix - alone, F.lit(0)).cast("int"))
    sizes = classes.select("cid", "n")
    witness = scratch.write(shared.join(sizes, "cid").select("cid", "n", F.explode(head).alias("v")).select("cid", "n", "v.value"), "witness")
    met = witness.groupBy("value").agg(F.count("*").alias("m")).where("m > 1").select("value")
    lists = scratch.write(witness.join(met, "value"), "lists")
    scratch.tidy(df, witness)
    return lists


def _verified(pairs: DataFrame, full: DataFrame, threshold: int, k: int, slack: float, scratch: Scratch, name: str) -> DataFrame:
    """Links among the distinct pairs (a, b) with their sizes na, nb and neighbourhood ``near``."""
    seats = pairs.select("near", F.explode(F.array(F.struct(F.col("a").alias("cid"), F.col("na").alias("n")), F.struct(F.col("b").alias("cid"), F.col("nb").alias("n")))).alias("x")).select("near", "x.*").distinct()
    many = pairs.groupBy("near").agg(F.ceil(F.sqrt(F.count("*") / PAIRS)).alias("many"))
    blocks = seats.groupBy("near").agg(F.ceil(F.sum("n") / ROOM).alias("large")).join(many, "near").select("near", F.greatest("large", "many").alias("blocks")).where("blocks > 1")
    split = pairs.join(small(scratch.write(blocks, name + "-blocks"), MAX_ROWS), "near", "left")
    x, y = (F.pmod(F.xxhash64(c), F.coalesce("blocks", F.lit(1))) for c in "ab")
    room = F.xxhash64("near", F.least(x, y), F.greatest(x, y))  # rooms that share a number are one larger room
    met = scratch.write(split.select(room.alias("room"), "a", "b"), name + "-pairs")
    places = scratch.write(met.select("room", F.explode(F.array("a", "b")).alias("cid")).distinct(), name + "-places")
    sets = full.join(small(places, MAX_ROWS), "cid").select("room", F.col("cid").alias("a"), F.lit(None).cast("long").alias("b"), "hashes")
    rows = sets.unionByName(met.select("room", "a", "b", F.lit(None).cast("binary").alias("hashes"))).repartition("room").sortWithinPartitions("room", F.col("b").isNotNull())
    links = scratch.write(rows.mapInArrow(_meetings(threshold, k, slack), "a long, b long"), name)
    scratch.tidy(met, places)
    return links


def _crowds(lists: DataFrame, full: DataFrame, threshold: int, scratch: Scratch) -> DataFrame:
    """Links among all members of ``lists`` (value, cid, n, root), as far as they join components.

    Lists with one smallest member are one crowd, as are those whose smallest members meet in such a list, since
    the many lists of a group of copies have nearly the same members.
    """
    low = lists.groupBy("value").agg(F.min("cid").alias("low"))
    held = scratch.write(lists.join(low, "value").select("low", "cid", "n", "root").distinct(), "crowded")
    name = held.groupBy(F.col("cid").alias("low")).agg(F.min("low").alias("crowd"))
    seats = scratch.write(held.join(name, "low").select("crowd", "cid", "n", "root").distinct(), "seats")
    blocks = seats.groupBy("crowd").agg(F.ceil(F.greatest(F.sum("n") / CROWD, F.count("*") / SETS)).alias("blocks"))
    seats_ = seats.join(blocks, "crowd").withColumn("x", F.pmod(F.xxhash64("cid"), "blocks"))
    rooms = seats_.select("crowd", "cid", "root", "x", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("y"))
    rooms = scratch.write(rooms.select("crowd", F.least("x", "y").alias("one"), F.greatest("x", "y").alias("two"), (F.col("x") > F.col("y")).alias("far"), "cid", "root"), "crowd-rooms")
    sets = full.join(small(rooms, MAX_ROWS), "cid").repartition("crowd", "one", "two").sortWithinPartitions("crowd", "one", "two")
    links = scratch.write(sets.mapInArrow(_crowd_links(threshold), "a long, b long"), "crowd")
    scratch.tidy(held, seats, rooms)
    return links


def linked(documents: DataFrame, width: int = WIDTH, threshold: int = THRESHOLD, k: int = K, slack: float = SLACK) -> DataFrame:
    """Per document row: doc_id, n (set size), key (set digest, null if empty), component_id."""
    return _linked(documents, width, threshold, k, slack, False)


def _linked(documents: DataFrame, width: int, threshold: int, k: int, slack: float, roots: bool) -> DataFrame:
    """``linked``; with ``roots`` also a number per component, which tells components with one smallest id apart."""
    spark = documents.sparkSession
    scratch = Scratch(spark, "neardup")
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketched = scratch.write(texts.mapInArrow(_sketches(width, k), "doc_id long, n long, key binary, sketch array<long>"), "sketched")
    rows = scratch.write(sketched.select("doc_id", "n", "key"), "rows")
    classes = sketched.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.any_value("sketch").alias("sketch"), F.any_value("n").alias("n"))
    classes = scratch.write(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    scratch.tidy(sketched)
    lists = _lists(classes, k, slack, scratch)
    least = F.min("cid").alias("low")
    heads = scratch.write(lists.groupBy("value").agg(least), "heads")
    near = scratch.write(lists.join(heads, "value").groupBy("cid").agg(F.min("low").alias("near")), "near")  # one name for most of a neighbourhood

    brief = classes.drop("sketch")
    wanted = scratch.write(brief.join(near.select("cid"), "cid", "left_semi").select("key", "cid", "doc_id"), "wanted")
    marks = spark.sparkContext.broadcast(_marks_of(wanted.where("doc_id is not null").select("doc_id")))
    full = texts.where("text is not null").mapInArrow(_sets(width, marks), "key binary, hashes binary").join(small(wanted.select("key", "cid"), MAX_ROWS), "key")
    full = scratch.write(full.groupBy("cid").agg(F.any_value("hashes").alias("hashes")), "sets")
    scratch.tidy(wanted)

    fits = F.lit(100) * F.least("na", "nb") >= F.lit(threshold) * F.greatest("na", "nb")
    sized = brief.select(F.col("cid").alias("low"), F.col("n").alias("na"))
    star = lists.join(heads, "value").where("low < cid").select("low", "cid", "n").distinct().join(sized, "low")
    star = star.select(F.col("low").alias("a"), F.col("cid").alias("b"), "na", F.col("n").alias("nb"), F.col("low").alias("near")).where(fits)
    asked = scratch.write(star, "star-asked")
    star = _verified(asked, full, threshold, k, slack, scratch, "star")
    rooted = components(star, scratch)

    labelled = lists.join(rooted, lists["cid"] == rooted.node, "left").join(near, "cid").select("value", "cid", "n", "near", F.coalesce("root", "cid").alias("root"))
    labelled = scratch.write(labelled, "labelled")
    split = labelled.groupBy("value", "root").agg(F.count("*").alias("m"))
    main = split.groupBy("value").agg(F.max_by("root", F.struct("m", "root")).alias("main"), (F.sum("m") - F.max("m")).alias("others")).where("others > 0")
    open_ = scratch.write(labelled.join(main, "value"), "open")
    crowd = _crowds(open_.where(F.col("others") > CROWDED), full, threshold, scratch)
    sparse = open_.where(F.col("others") <= CROWDED)
    one = sparse.where("root <> main").select("value", F.col("cid").alias("x"), F.col("root").alias("rx"), F.col("n").alias("nx"), F.col("near").alias("hx"))
    two = sparse.select("value", F.col("cid").alias("y"), F.col("root").alias("ry"), F.col("n").alias("ny"), F.col("near").alias("hy"), (F.col("root") == F.col("main")).alias("in_main"))
    swap = F.col("x") > F.col("y")
    meet = one.join(two, "value").where("rx <> ry and (in_main or x < y)").select(
        F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), F.when(swap, F.col("ny")).otherwise(F.col("nx")).alias("na"),
        F.when(swap, F.col("nx")).otherwise(F.col("ny")).alias("nb"), F.least("hx", "hy").alias("near"),
    ).where(fits).distinct()
    rest = scratch.write(meet.join(asked.select("a", "b"), ["a", "b"], "left_anti"), "meet")
    scratch.tidy(lists, heads, near, asked, labelled, open_)
    rest = _verified(rest, full, threshold, k, slack, scratch, "rest")
    scratch.tidy(full)
    nodes = components(star.unionByName(rest).unionByName(crowd), scratch)

    members = nodes.unionByName(nodes.select(F.col("root").alias("node"), "root").distinct())
    ids = scratch.write(brief.join(members, brief.cid == members.node).select("key", "root", "doc_id"), "ids")
    smallest = ids.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    joined = ids.join(smallest, "root").select("key", "component_id", "root")
    root = [F.coalesce("root", "cid").alias("root")] if roots else []
    final = brief.join(joined, "key", "left").select("key", F.coalesce("component_id", "doc_id").alias("component_id"), *root)
    final = scratch.write(final, "final")
    out = rows.join(final, "key", "left").select("doc_id", "n", "key", F.coalesce("component_id", "doc_id").alias("component_id"), *(["root"] if roots else []))
    out = scratch.write(out, "out")
    scratch.tidy(rows, classes, final, ids)
    return out


def _keyed(width: int, name: str):
    """Rows with the digest of their shingle set, null if it is empty, as another column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        shingles = Shingler(width)
        for batch in pieces(batches):
            sets = (shingles(t) for t in batch.column("text").to_pylist())
            keys = pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, keys], names=[*batch.schema.names, name])

    return run


def deduplicated(documents: DataFrame, width: int = WIDTH, threshold: int = THRESHOLD) -> DataFrame:
    """``documents`` with one row of each component: the one with the smallest doc_id.

    Of several rows with that id, repeated or near copies of each other, one stays; rows without a
    set or an id all stay. Rows whose id has several texts are judged by id and set.
    """
    names = documents.columns
    d, k, own = unused(documents, "id", "set", "own")
    found = _linked(documents, width, threshold, K, SLACK, True)
    several = small(found.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("m")).where("m > 1").select("doc_id"), MAX_ROWS)
    key = F.coalesce("key", F.lit(b""))
    mixed = found.join(several, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(key).alias("low"), F.max(key).alias("high")).where("low <> high").select(F.col("doc_id").alias(d))
    mixed = small(mixed, MAX_ROWS)
    plain, rest, reused = found, documents, not mixed.isEmpty()
    if reused:
        plain = found.join(mixed, found.doc_id == F.col(d), "left_anti")
        rest = documents.join(mixed, documents.doc_id == F.col(d), "left_anti")
    gone = plain.where("doc_id <> component_id").select(F.col("doc_id").alias(d)).distinct()
    again = plain.where("doc_id = component_id and key is not null").groupBy("doc_id").agg(F.count("*").alias("m")).where("m > 1").select(F.col("doc_id").alias(d))
    gone, again = small(gone, MAX_ROWS), small(again, MAX_ROWS)
    once = rest.join(gone, rest.doc_id == F.col(d), "left_anti")
    if not again.isEmpty():
        repeated = once.join(again, once.doc_id == F.col(d), "left_semi").dropDuplicates(["doc_id"])
        once = once.join(again, once.doc_id == F.col(d), "left_anti").unionByName(repeated)
    if not reused:
        return once
    heads = found.join(mixed, found.doc_id == F.col(d), "left_semi").where("doc_id = component_id and key is not null")
    heads = heads.groupBy("root", "doc_id").agg(F.min("key").alias(k)).select(F.col("doc_id").alias(d), k)
    rows = documents.join(mixed, documents.doc_id == F.col(d), "left_semi")
    rows = rows.mapInArrow(_keyed(width, own), StructType([*documents.schema.fields, StructField(own, BinaryType())]))
    kept = rows.join(heads, (rows.doc_id == F.col(d)) & (F.col(own) == F.col(k)), "left_semi").dropDuplicates(["doc_id", own])
    return once.unionByName(kept.select(*names)).unionByName(rows.where(F.col(own).isNull()).select(*names))
