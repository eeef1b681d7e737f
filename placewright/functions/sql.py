"""Registers the functions for SQL: ``SELECT explode(expand_address(a)) FROM t``."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..core import dupes, expand, language, lexer, metrics, numex, phonetic, text

_TOKEN = "array<struct<text:string,offset:int,type:int>>"


def register(spark: SparkSession) -> list[str]:
    """Register one SQL function per scalar operator; returns their names."""
    import pandas as pd

    def add(name: str, returns: str, fn, n: int = 1) -> str:
        if n == 1:
            def one(a: pd.Series) -> pd.Series:
                return pd.Series([fn(x) for x in a], dtype=object)
        else:
            def one(a: pd.Series, b: pd.Series) -> pd.Series:
                return pd.Series([fn(x, y) for x, y in zip(a, b)], dtype=object)
        one.__annotations__ = dict.fromkeys("ab"[:n], pd.Series) | {"return": pd.Series}
        spark.udf.register(name, F.pandas_udf(one, returns))
        return name

    return [
        add("expand_address", "array<string>", expand.expand_address),
        add("expand_address_root", "array<string>", expand.expand_address_root),
        add("tokenize", _TOKEN, lambda s: [{"text": t.text, "offset": t.offset, "type": int(t.type)} for t in lexer.tokenize(s)]),
        add("normalize_string", "string", text.normalize_string),
        add("transliterate", "string", lambda s, name: text.transliterate(name, s), 2),
        add("replace_numex", "string", lambda s, lang: None if s is None else numex.replace_numeric_expressions(s, lang), 2),
        add("near_dupe_name_hashes", "array<string>", dupes.name_hashes),
        add("double_metaphone", "string", lambda s: None if s is None else phonetic.double_metaphone(s)[0]),
        add("jaro_winkler_half", "double", metrics.jaro_winkler, 2),
        add("damerau_diagonal", "int", metrics.damerau, 2),
        add("place_languages", "array<string>", lambda s: list(language.guess_languages(s or ""))),
        add("is_street_duplicate", "int", lambda a, b: dupes.duplicate_status(a, b, "street"), 2),
        add("is_name_duplicate", "int", lambda a, b: dupes.duplicate_status(a, b, "name"), 2),
        add("is_house_number_duplicate", "int", lambda a, b: dupes.duplicate_status(a, b, "house_number"), 2),
        add("is_unit_duplicate", "int", lambda a, b: dupes.duplicate_status(a, b, "unit"), 2),
        add("is_floor_duplicate", "int", lambda a, b: dupes.duplicate_status(a, b, "level"), 2),
        add("is_po_box_duplicate", "int", lambda a, b: dupes.duplicate_status(a, b, "po_box"), 2),
        add("is_postal_code_duplicate", "int", lambda a, b: dupes.duplicate_status(a, b, "postal_code"), 2),
    ]
