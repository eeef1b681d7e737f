"""Quality classifier by compression: zstandard dictionaries of good and of bad labelled text.

A dictionary is built from labelled good text and one from bad text. A text is cut into pieces of
``PIECE`` bytes, each compressed alone with either dictionary, so a long text can't outgrow the
dictionaries. The sizes give a normalised difference, (bad - good) / (bad + good), and the logarithm
of the whole compressed share, which tells degenerate repetition; a logistic calibration over
these, fitted on labelled rows that built no dictionary, makes the score.

Labels are learnt only from rows outside the held-out fold: crc32(doc_id as text) mod 5 is not 0.
The sample is bounded by ``MAX_LABELS`` labelled rows (the first by a hash of doc_id, then by label and
text, so it is the same on each run), whose whole texts are learnt from; everything labelled is
scored like the rest, whole.

Defined cases: null and empty texts get the score of zero evidence; labels with a null quality or
doc_id, or of documents that aren't there, teach nothing; a doc_id with several labels teaches
each of them; without labels of both kinds every score is 0.5 (or the one known label's share).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import unused

PIECE, DICT_BYTES, LEVEL = 1024, 112_640, 3
MAX_LABELS = 8_000
CUT = 0.3
FOLDS = 5


def held_out(doc_id):
    """Whether a row belongs to the fold that is never learnt from."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


@dataclass
class Model:
    """Two dictionaries and the calibration; plain bytes and floats, a few hundred kB."""

    good: bytes
    bad: bytes
    centre: tuple[float, ...]
    weights: tuple[float, ...]

    def scorer(self):
        """A function from text to score."""
        if not self.good or not self.bad:
            base = self.weights[-1]
            return lambda text: base
        features = _features(self.good, self.bad)
        centre, w = np.array(self.centre[:3]), np.array(self.weights)
        scale = np.array(self.centre[3:])

        def score(text: str | None) -> float:
            z = float(((np.array(features(text)) - centre) / scale) @ w[:3] + w[3])
            return 1 / (1 + np.exp(-min(max(z, -500.0), 500.0)))

        return score


def _features(good: bytes, bad: bytes):
    import zstandard

    pair = []
    for content in (good, bad):
        d = zstandard.ZstdCompressionDict(content)
        d.precompute_compress(level=LEVEL)
        pair.append(zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_dict_id=False, write_checksum=False).compress)
    g, b = pair

    def features(text: str | None) -> tuple[float, float, float]:
        data = (text or "").encode("utf-8", "surrogatepass")
        if not data:
            return 0.0, 0.0, 0.0
        n = sg = sb = 0
        for i in range(0, len(data), PIECE):
            piece = data[i : i + PIECE]
            n += len(piece)
            sg += len(g(piece)) - 6
            sb += len(b(piece)) - 6
        share = float(np.log((sb + sg + 8) / (n + 8)))
        return (sb - sg) / max(sb + sg, 1), share, share * share

    return features


def _dictionary(texts: list[bytes]) -> bytes:
    """A trained dictionary, or the raw text where there is too little to train on."""
    import zstandard

    pieces = [t[i : i + PIECE] for t in texts for i in range(0, len(t), PIECE)]
    try:
        return zstandard.train_dictionary(min(DICT_BYTES, max(4096, sum(map(len, pieces)) // 8)), pieces).as_bytes()
    except zstandard.ZstdError:
        return b"".join(pieces)[-DICT_BYTES:]


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    x = np.c_[x, np.ones(len(x))]
    w = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + 1e-2 * np.eye(len(w)), x.T @ (p - y) + 1e-2 * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(documents: DataFrame, labels: DataFrame, max_labels: int = MAX_LABELS) -> Model:
    """Learn from a bounded sample of the labelled rows outside the held-out fold."""
    order = F.xxhash64("doc_id")
    known = labels.where("doc_id is not null and quality in (0, 1)").where(~held_out(F.col("doc_id"))).select("doc_id", F.col("quality").cast("int").alias("quality"))
    # half of the bound for each label, so that a rare one is learnt as well
    known = known.where("quality = 0").orderBy(order, "quality").limit(max_labels // 2).unionByName(known.where("quality = 1").orderBy(order, "quality").limit(max_labels // 2))
    rows = documents.select("doc_id", "text").where("text is not null and text <> ''").join(F.broadcast(known), "doc_id")
    rows = rows.orderBy(order, "quality", "text").limit(max_labels).toPandas()  # doc_ids may repeat
    rows = rows.sort_values(["doc_id", "quality", "text"], kind="stable")[["doc_id", "quality", "text"]]
    data = [(zlib.crc32(f"half{i}".encode()) % 2, int(q), p.encode("utf-8", "surrogatepass")) for i, q, p in rows.itertuples(index=False)]
    sides = [[t for h, q, t in data if h == 0 and q == k] for k in (0, 1)]
    y = np.array([q for h, q, _ in data if h == 1], float)
    if not all(sides) or not 0 < y.sum() < len(y):
        share = float(np.mean([q for _, q, _ in data])) if data else 0.5
        return Model(b"", b"", (), (share,))
    bad, good = map(_dictionary, sides)
    features = _features(good, bad)
    x = np.array([features(t.decode("utf-8", "surrogatepass") if isinstance(t, bytes) else t) for h, _, t in data if h == 1])
    centre, scale = x.mean(0), x.std(0) + 1e-9
    # the sample is balanced by label; weigh the intercept back to the labels' own shares
    w = _logistic((x - centre) / scale, y)
    counts = {r.quality: r["count"] for r in labels.where("doc_id is not null and quality in (0, 1)").where(~held_out(F.col("doc_id"))).groupBy("quality").count().collect()}
    w[-1] += np.log(counts[1] / counts[0]) - np.log(y.sum() / (len(y) - y.sum()))
    return Model(good, bad, (*centre.tolist(), *scale.tolist()), tuple(w.tolist()))


def score(documents: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """``documents`` with another column ``name``, by one narrow pass."""
    held = documents.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        one = held.value.scorer()
        for part in parts:
            yield pd.Series([one(t) for t in part], dtype="float64")

    return documents.withColumn(name, scored(F.col("text")))


def classified(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document row: doc_id, held_out, score, predicted."""
    scored = score(documents.select("doc_id", "text"), fit(documents, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def filtered(documents: DataFrame, labels: DataFrame, cut: float = CUT) -> DataFrame:
    """``documents`` without the rows whose score is below ``cut``."""
    (name,) = unused(documents, "score")
    return score(documents, fit(documents, labels), name).where(F.col(name) >= cut).drop(name)
