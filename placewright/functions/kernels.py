"""Functions that need the kernels: Arrow-batched, one call per batch, repeated values computed once.

Each worker builds its tables on first use. Options are captured when the column is made.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..core import dupes, expand, language, lexer, metrics, numex, phonetic, tagger, text
from ..core.expand import Options
from ..core.geo import cells_around, parse_coordinate

__all__ = [
    "tokenize", "token_totals", "normalized_tokens", "normalize_string", "string_alternatives", "transliterate", "replace_numex", "numex_spans", "ordinal_lengths", "expand_address", "expand_address_root",
    "near_dupe_name_hashes", "near_dupe_hashes", "double_metaphone", "jaro", "jaro_winkler", "damerau", "affine_gap", "abbreviation", "duplicate_status", "fuzzy_status", "toponym_status",
    "language_features", "classified", "guess_languages", "disambiguate_language", "script_spans", "parse_address", "geohash_cells", "coordinate", "equivalent", "scalar", "spread", "TOKEN",
]

TOKEN = "array<struct<text:string,offset:int,type:int>>"
#: Values a worker remembers, and the length from which texts are not, as they hardly repeat: both bound its bytes.
_MEMO, _LONG = 100_000, 1_000
#: Sources below this size a core have too few parts to keep all cores busy.
SPREAD_BYTES = 64 << 20


def scalar(fn: Callable, returns: str, *columns, memo_size: int = _MEMO) -> Column:
    """Apply a plain function of values as an Arrow-batched column; nulls reach the function as None.
    A struct is returned as a dict of its fields. ``memo_size`` of 0: nothing is remembered here."""
    record = [f.split(":")[0] for f in returns[7:-1].split(",")] if returns.startswith("struct<") else []

    def batches(parts: Iterator) -> Iterator[pd.Series]:
        memo: dict = {}
        for part in parts:
            args = part if isinstance(part, tuple) else (part,)
            out = []
            for values in zip(*(_plain(a) for a in args), strict=True):
                if not memo_size or any(isinstance(v, (str, list, dict)) and len(v) >= _LONG for v in values):
                    out.append(fn(*values))
                    continue
                key = _hashable(values)
                if key not in memo:
                    if len(memo) >= memo_size:
                        memo.clear()
                    memo[key] = fn(*values)
                out.append(memo[key])
            if record:  # a struct's batch is a frame of its fields
                yield pd.DataFrame([v if v is not None else dict.fromkeys(record) for v in out], columns=record)
            else:
                yield pd.Series(out, dtype=object)

    kind = pd.DataFrame if record else pd.Series
    hints = Iterator[pd.Series] if len(columns) == 1 else Iterator[tuple[pd.Series, ...]]
    batches.__annotations__ = {"parts": hints, "return": Iterator[kind]}
    return F.pandas_udf(batches, returns)(*[F.col(c) if isinstance(c, str) else c for c in columns])


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` over all cores before a kernel, where its source is too small to have as many parts;
    larger inputs stay as they are read, without a shuffle. Only the plan's statistics are asked.

    A join's or an aggregate's size is only guessed (a join's as its sides' product), and its result comes in few
    parts where it has few bytes, so such a plan is always spread, by its sources' bytes; equal ``keys`` stay together."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    plan = df._jdf.queryExecution().optimizedPlan()
    leaves = plan.collectLeaves()
    if keys or leaves.size() > 1 or not _streams(plan):
        size = sum(int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size()))
        return df.repartition(max(4 * cores, min(size // SPREAD_BYTES, 100 * cores)), *keys)
    return df.repartition(cores) if int(plan.stats().sizeInBytes()) < cores * SPREAD_BYTES else df


def _streams(plan) -> bool:
    """Whether rows go from a plan's source to its result without an exchange."""
    return plan.children().isEmpty() or plan.nodeName() in ("Project", "Filter", "Generate") and _streams(plan.children().head())


def _plain(series: pd.Series) -> list:
    return [None if v is None or v is pd.NaT or (isinstance(v, float) and v != v) else v.tolist() if hasattr(v, "tolist") else v for v in series]


def _hashable(values: tuple) -> tuple:
    return tuple(repr(v) if isinstance(v, (list, dict)) else v for v in values)


def _tokens(ts) -> list[dict]:
    return [{"text": t.text, "offset": t.offset, "type": int(t.type)} for t in ts]


def tokenize(c, whitespace: bool = False) -> Column:
    """Tokens of each text, built as Arrow columns, few texts at a time; nulls stay null."""

    def run(texts: pa.Array) -> pa.Array:
        parts = []
        for at in range(0, max(1, len(texts)), 256):
            flat, ends, none = ([], [], []), [0], []
            for s in texts.slice(at, 256).to_pylist():
                for into, column in zip(flat, lexer.columns(s, whitespace)):
                    into += column
                ends.append(len(flat[0]))
                none.append(s is None)
            tokens = pa.StructArray.from_arrays([pa.array(v, t) for v, t in zip(flat, (pa.string(), pa.int32(), pa.int32()))], names=["text", "offset", "type"])
            parts.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), tokens, mask=pa.array(none, pa.bool_())))
        return pa.concat_arrays(parts)

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, TOKEN)(F.col(c) if isinstance(c, str) else c)


def token_totals(c, whitespace: bool = False) -> Column:
    """Per text and type of token: how many, and their characters; only these leave the worker. Nulls stay null."""
    import numpy as np

    left_out = lexer.left_out(whitespace)

    def run(texts: pa.Array) -> pa.Array:
        flat, ends, none = [], [0], []
        for at in range(0, len(texts), 256):
            for s in texts.slice(at, 256).to_pylist():
                none.append(s is None)
                if s:
                    bounds, kinds = lexer.cuts(lexer.before_nul(s))
                    n, chars = np.bincount(kinds), np.bincount(kinds, np.diff(bounds))
                    flat += [(int(k), int(n[k]), int(chars[k])) for k in np.flatnonzero(n) if k not in left_out]
                ends.append(len(flat))
        parts = [pa.array(v, t) for v, t in zip(zip(*flat), (pa.int32(), pa.int64(), pa.int64()))] if flat else [pa.array([], t) for t in (pa.int32(), pa.int64(), pa.int64())]
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(parts, names=["type", "n", "chars"]), mask=pa.array(none, pa.bool_()))

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "array<struct<type:int,n:bigint,chars:bigint>>")(F.col(c) if isinstance(c, str) else c)


def normalized_tokens(c, string_options: int = text.STRING_DEFAULT, token_options: int = text.TOKEN_DEFAULT, whitespace: bool = False, languages: Sequence[str] = ()) -> Column:
    def run(s):
        return None if s is None else [{"normalized": n, "text": t.text, "offset": t.offset, "type": int(t.type)} for n, t in text.normalized_tokens(s, string_options, token_options, whitespace, tuple(languages))]

    return scalar(run, "array<struct<normalized:string,text:string,offset:int,type:int>>", c)


def normalize_string(c, options: int = text.STRING_DEFAULT, languages: Sequence[str] = ()) -> Column:
    return scalar(lambda s: text.normalize_string(s, options, tuple(languages)), "string", c)


def string_alternatives(c, options: int = text.STRING_DEFAULT, languages: Sequence[str] = ()) -> Column:
    return scalar(lambda s: None if s is None else text.normalize_string_languages(s, options, tuple(languages)), "array<string>", c)


def transliterate(c, name: str) -> Column:
    return scalar(lambda s: text.transliterate(name, s), "string", c)


def script_spans(c) -> Column:
    return scalar(lambda s: None if s is None else [{"script": a, "span": b} for a, b, _ in text.script_spans(s)], "array<struct<script:string,span:string>>", c)


def replace_numex(c, lang: str) -> Column:
    return scalar(lambda s: None if s is None else numex.replace_numeric_expressions(s, lang), "string", c)


def numex_spans(c, lang: str) -> Column:
    def run(s):
        return [{"value": r.value, "start": r.start, "end": r.end, "ordinal": r.ordinal, "gender": r.gender} for r in numex.convert_numeric_expressions(s or "", lang)]

    return scalar(run, "array<struct<value:long,start:int,end:int,ordinal:boolean,gender:string>>", c)


def ordinal_lengths(tokens, lang: str) -> Column:
    return scalar(lambda ts: numex.ordinal_suffix_lengths(ts or [], lang), "array<int>", tokens)


def expand_address(c, options: Options = Options(), languages=None) -> Column:
    """All expansions; ``languages`` may be a column of language arrays, else the options' are used."""
    return _expand(c, options, languages, False)


def expand_address_root(c, options: Options = Options(), languages=None) -> Column:
    return _expand(c, options, languages, True)


def _expand(c, options: Options, languages, root: bool) -> Column:
    from dataclasses import replace

    if languages is None:
        return scalar(lambda s: None if s is None else expand.expand_address(s, options, root), "array<string>", c)
    return scalar(lambda s, ls: None if s is None else expand.expand_address(s, replace(options, languages=tuple(ls or ())), root), "array<string>", c, languages)


def near_dupe_name_hashes(c, languages: Sequence[str] = (), strict: bool = False) -> Column:
    return scalar(lambda s: dupes.name_hashes(s, tuple(languages), strict), "array<string>", c)


def near_dupe_hashes(labels, values, options: dupes.HashOptions = dupes.HashOptions(), languages: Sequence[str] = (), latitude=None, longitude=None) -> Column:
    """Blocking keys of a place; with coordinate columns, each row has its own location."""
    from dataclasses import replace

    if latitude is None:
        return scalar(lambda ls, vs: dupes.near_dupe_hashes(ls or [], vs or [], options, tuple(languages)), "array<string>", labels, values, memo_size=0)
    run = lambda ls, vs, y, x: dupes.near_dupe_hashes(ls or [], vs or [], replace(options, with_latlon=y is not None and x is not None, latitude=y or 0.0, longitude=x or 0.0), tuple(languages))
    return scalar(run, "array<string>", labels, values, latitude, longitude, memo_size=0)


def double_metaphone(c) -> Column:
    return scalar(lambda s: None if s is None else dict(zip(("primary", "secondary"), phonetic.double_metaphone(s))), "struct<primary:string,secondary:string>", c)


def jaro(a, b) -> Column:
    return scalar(metrics.jaro, "double", a, b)


def jaro_winkler(a, b) -> Column:
    return scalar(metrics.jaro_winkler, "double", a, b)


def damerau(a, b) -> Column:
    return scalar(metrics.damerau, "int", a, b)


def affine_gap(a, b) -> Column:
    return scalar(lambda x, y: None if x is None or y is None else metrics.affine_gap(x, y)._asdict(), "struct<matches:int,mismatches:int,transpositions:int,gap_opens:int,gap_extensions:int>", a, b)


def abbreviation(a, b, strict: bool = False) -> Column:
    return scalar(lambda x, y: bool(x and y) and metrics.possible_abbreviation(x, y, strict), "boolean", a, b)


def duplicate_status(a, b, component: str, languages: Sequence[str] = ()) -> Column:
    return scalar(lambda x, y: dupes.duplicate_status(x, y, component, tuple(languages)), "int", a, b)


def fuzzy_status(tokens_a, scores_a, tokens_b, scores_b, component: str = "name", languages: Sequence[str] = ()) -> Column:
    run = lambda t1, w1, t2, w2: dict(zip(("status", "similarity"), dupes.fuzzy_status(t1, w1, t2, w2, component, tuple(languages))))
    return scalar(run, "struct<status:int,similarity:double>", tokens_a, scores_a, tokens_b, scores_b)


def toponym_status(labels_a, values_a, labels_b, values_b, languages: Sequence[str] = ()) -> Column:
    run = lambda la, va, lb, vb: dupes.toponym_status(dupes.place_of(la or [], va or []), dupes.place_of(lb or [], vb or []), tuple(languages))
    return scalar(run, "int", labels_a, values_a, labels_b, values_b)


def language_features(c) -> Column:
    return scalar(lambda s: [k for k, n in sorted(language.features(s).items()) for _ in range(int(n))], "array<string>", c, memo_size=0)


def classified(c, vocabulary: Sequence[str], weights, intercept) -> Column:
    """Probabilities of a multinomial logistic model over a text's feature counts; ``weights``: (labels, vocabulary).
    Features are summed text by text, so only the probabilities are ever held for a batch."""
    import numpy as np

    at = {f: i for i, f in enumerate(vocabulary)}
    by_feature = np.ascontiguousarray(np.asarray(weights, float).T)
    intercept = np.asarray(intercept, float)

    def probabilities(s: str | None) -> np.ndarray:
        found = [(at[f], n) for f, n in language.features(s or "").items() if f in at]
        z = intercept + (np.array([float(int(n)) for _, n in found]) @ by_feature[[i for i, _ in found]] if found else 0.0)
        e = np.exp(z - z.max())
        return e / e.sum()

    def run(texts: pa.Array) -> pa.Array:
        rows = [probabilities(s) for part in range(0, len(texts), 64) for s in texts.slice(part, 64).to_pylist()]
        return pa.array(rows, pa.list_(pa.float64()))

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "array<double>")(F.col(c) if isinstance(c, str) else c)


def guess_languages(c) -> Column:
    return scalar(lambda s: list(language.guess_languages(s or "")), "array<string>", c)


def disambiguate_language(c, candidates) -> Column:
    """``candidates``: array of (lang, is_default)."""
    return scalar(lambda s, cs: language.disambiguate(s or "", [(x["lang"], x["is_default"]) for x in cs or []]), "string", c, candidates)


def parse_address(c, model: tagger.Tagger, known: dict[str, str] | None = None) -> Column:
    """Labelled parts by a trained model, which travels with the function."""
    run = lambda s: [{"label": a, "value": b} for a, b in tagger.parse(s, model, known=known)]
    return scalar(run, "array<struct<label:string,value:string>>", c)


def geohash_cells(lat, lon, precision: int = 6) -> Column:
    return scalar(lambda y, x: [] if y is None or x is None else cells_around(y, x, precision), "array<string>", lat, lon)


def coordinate(c) -> Column:
    return scalar(parse_coordinate, "double", c)


def equivalent(a, b, lang: str) -> Column:
    return scalar(lambda x, y: bool(x and y) and expand.equivalent(x, y, lang), "boolean", a, b)
