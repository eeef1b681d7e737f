"""Functions that are Catalyst expressions; they stay in generated code."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = [
    "is_ascii", "trim_text", "lower_text", "replace_hyphens", "strip_latin_accents", "separator_key", "equal_ignoring_separators", "reverse_text", "find_hyphens", "strip_final_period",
    "strip_acronym_periods", "strip_possessive", "strip_apostrophes", "replace_digits", "token_replace_hyphens", "token_delete_hyphens", "split_alpha_numeric", "possible_ordinal_digits", "words", "ngrams", "quadgrams", "shingles",
    "set_jaccard", "multiset_jaccard", "haversine", "expansions_intersect", "ladder_status", "either_status", "joined_status", "private_letters", "product_strings", "key_join", "first_value", "ordinal_suffix_en", "roman_value",
    "argmax_label", "probable", "number_range", "geohash_cell", "disambiguation_keys", "normalise_postcode", "postcode_valid", "common_prefix_length", "strict_abbreviation", "phrase_index", "remove_parens", "state_abbreviation", "prev_next", "topological_priority",
]

_ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ"
_PLAIN = "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once; inside a lambda an inlined expression would be
    computed for every element."""
    return F.element_at(F.transform(F.array(value), body), 1)


# -- strings


def is_ascii(c) -> Column:
    return _c(c).rlike(r"^[\x00-\x7F]*$")


def trim_text(c) -> Column:
    """Without white space of any script at the ends."""
    return F.regexp_replace(_c(c), r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")


def lower_text(c) -> Column:
    return F.lower(_c(c))


def replace_hyphens(c) -> Column:
    return F.translate(_c(c), "-", " ")


def strip_latin_accents(c) -> Column:
    """Latin-1 letters without their marks; anything else as it is."""
    return F.translate(_c(c), _ACCENTED, _PLAIN)


def separator_key(c) -> Column:
    return F.regexp_replace(F.lower(_c(c)), r"[\s\-]", "")


def equal_ignoring_separators(a, b) -> Column:
    return separator_key(a) == separator_key(b)


def reverse_text(c) -> Column:
    return F.reverse(_c(c))


def find_hyphens(c) -> Column:
    """Position of the first hyphen or period, 0 without one."""
    return F.regexp_instr(_c(c), F.lit(r"[-.]"))


def remove_parens(c) -> Column:
    """What stands outside brackets, by a depth count over code points; no regular expression can nest."""
    step = lambda acc, ch: F.when(ch == "(", F.struct((acc["d"] + 1).alias("d"), acc["s"].alias("s"))).when(ch == ")", F.struct(F.greatest(acc["d"] - 1, F.lit(0)).alias("d"), acc["s"].alias("s"))).otherwise(F.struct(acc["d"].alias("d"), F.when(acc["d"] == 0, F.concat(acc["s"], ch)).otherwise(acc["s"]).alias("s")))
    return F.aggregate(F.split(_c(c), ""), F.struct(F.lit(0).alias("d"), F.lit("").alias("s")), step, lambda acc: F.trim(acc["s"]))


# -- tokens


def strip_final_period(c) -> Column:
    return F.regexp_replace(_c(c), r"\.$", "")


def strip_acronym_periods(c) -> Column:
    return F.when(_c(c).rlike(r"^(\p{L}\.){2,}\p{L}?$"), F.translate(_c(c), ".", "")).otherwise(_c(c))


def strip_possessive(c) -> Column:
    return F.when(F.length(_c(c)) > 2, F.regexp_replace(_c(c), r"('s|s')$", "s")).otherwise(_c(c))


def strip_apostrophes(c) -> Column:
    return F.translate(_c(c), "'", "")


def replace_digits(c) -> Column:
    return F.regexp_replace(_c(c), r"\p{Nd}", "D")


def token_replace_hyphens(c, numeric: bool = False) -> Column:
    """Hyphens become spaces, but not between digits unless ``numeric``."""
    return replace_hyphens(c) if numeric else F.regexp_replace(_c(c), r"(?<![0-9])-|-(?![0-9])", " ")


def token_delete_hyphens(c) -> Column:
    """Hyphens go, but not next to a digit on one side and anything on the other."""
    return F.regexp_replace(_c(c), r"(?<=\p{L})-(?=\p{L})", "")


def split_alpha_numeric(c) -> Column:
    """A space at the first boundary of letters and digits."""
    return F.regexp_replace(_c(c), r"^([0-9]*?|\p{L}*?)(?:(?<=[0-9])(?=\p{L})|(?<=\p{L})[-.]?(?=[0-9]))(.*)$", "$1 $2")


def possible_ordinal_digits(c) -> Column:
    """Number of digits that stand together, 0 otherwise."""
    return F.length(F.regexp_extract(_c(c), r"^[^0-9]*([0-9]+)[^0-9]*$", 1))


def words(c) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.regexp_extract_all(F.lower(_c(c)), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def ngrams(tokens, n: int) -> Column:
    """Runs of n tokens joined by a space."""
    none = F.array().cast("array<string>")
    return _let(_c(tokens), lambda t: F.when(F.size(t) >= n, F.transform(F.sequence(F.lit(1), F.size(t) - (n - 1)), lambda i: F.concat_ws(" ", F.slice(t, i, n)))).otherwise(none))


def quadgrams(c) -> Column:
    """Distinct four-grams of characters; strings of at most four whole."""
    s = _c(c)
    return F.when(F.length(s) <= 4, F.array(s)).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(s) - 3), lambda i: F.substring(s, i, F.lit(4)))))


def shingles(c, n: int = 3) -> Column:
    return F.array_distinct(ngrams(words(c), n))


def phrase_index(starts, lengths, n) -> Column:
    """Per token the index of the phrase it lies in, -1 outside."""
    s, k = _c(starts), _c(lengths)
    return F.transform(F.sequence(F.lit(0), _c(n) - 1), lambda i: F.coalesce(F.array_position(F.transform(F.arrays_zip(s.alias("s"), k.alias("k")), lambda p: (i >= p["s"]) & (i < p["s"] + p["k"])), True) - 1, F.lit(-1)))


def prev_next(tokens) -> Column:
    """(token, previous, next) of each place."""
    return _let(_c(tokens), lambda t: F.transform(t, lambda x, i: F.struct(x.alias("token"), F.try_element_at(F.concat(F.array(F.lit("START")), t), i + 1).alias("prev"), F.coalesce(F.try_element_at(t, i + 2), F.lit("END")).alias("next"))))


# -- sets and statuses


def set_jaccard(a, b) -> Column:
    """Share of common distinct elements, 0 with an empty side."""
    x, y = _c(a), _c(b)
    return F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)))


def multiset_jaccard(a, b) -> Column:
    """The same with repetition: sum of minima over sum of maxima."""
    count = lambda arr, k: F.size(F.filter(arr, lambda z: z == k))

    def share(p: Column) -> Column:
        x, y = p["x"], p["y"]
        keys = F.array_union(x, y)
        low = F.aggregate(keys, F.lit(0), lambda acc, k: acc + F.least(count(x, k), count(y, k)))
        high = F.aggregate(keys, F.lit(0), lambda acc, k: acc + F.greatest(count(x, k), count(y, k)))
        return F.when(high > 0, low / high).otherwise(0.0)

    return _let(F.struct(_c(a).alias("x"), _c(b).alias("y")), share)


def expansions_intersect(a, b) -> Column:
    return F.coalesce(F.arrays_overlap(_c(a), _c(b)), F.lit(False))


def ladder_status(full_a, full_b, root_a, root_b) -> Column:
    """Names and streets: 9 if full expansions meet, 3 if roots do, else 0; -1 with a null side."""
    return F.when(_c(full_a).isNull() | _c(full_b).isNull(), -1).when(F.arrays_overlap(_c(full_a), _c(full_b)), 9).when(F.arrays_overlap(_c(root_a), _c(root_b)), 3).otherwise(0)


def either_status(root_a, root_b, full_a, full_b) -> Column:
    """Numbers, units, codes: 9 if roots or full expansions meet."""
    return F.when(_c(root_a).isNull() | _c(root_b).isNull(), -1).when(F.arrays_overlap(_c(root_a), _c(root_b)) | F.arrays_overlap(_c(full_a), _c(full_b)), 9).otherwise(0)


def joined_status(tokens_a, tokens_b, likely: float = 0.9, review: float = 0.7) -> Column:
    """Ideographs: equal when joined is 9, else by set Jaccard."""
    sim = set_jaccard(tokens_a, tokens_b)
    return F.when(F.concat_ws("", _c(tokens_a)) == F.concat_ws("", _c(tokens_b)), 9).when(sim >= likely, 6).when(sim >= review, 3).otherwise(0)


def private_letters(a, b) -> Column:
    """Whether each side has a single letter that the other lacks."""
    one = lambda t: F.filter(_c(t), lambda x: (F.length(x) == 1) & x.rlike(r"\p{L}"))
    return (F.size(F.array_except(one(a), one(b))) > 0) & (F.size(F.array_except(one(b), one(a))) > 0)


def strict_abbreviation(a, b) -> Column:
    """Whether one string is a prefix of the other."""
    x, y = _c(a), _c(b)
    return (F.length(x) > 0) & (F.length(y) > 0) & (x.startswith(y) | y.startswith(x))


def common_prefix_length(a, b) -> Column:
    x, y = _c(a), _c(b)
    n = F.least(F.length(x), F.length(y))
    return F.when(n == 0, 0).otherwise(F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0), lambda acc, i: F.when((acc == i - 1) & (F.substring(x, i, F.lit(1)) == F.substring(y, i, F.lit(1))), i).otherwise(acc)))


# -- keys and alternatives


def product_strings(*slots, separator: str = " ") -> Column:
    """Every path through alternatives: one string per choice from each array."""

    def times(left: Column, right: Column) -> Column:
        return F.flatten(F.transform(left, lambda a: F.transform(right, lambda b: F.concat_ws(separator, a, b))))

    out = _c(slots[0])
    for s in slots[1:]:
        out = times(out, _c(s))
    return out


def key_join(prefix: str, *parts) -> Column:
    """Keys ``prefix|part|...`` of all combinations."""
    return F.transform(product_strings(*parts, separator="|"), lambda k: F.concat(F.lit(prefix + "|"), k))


def disambiguation_keys(name, feature: str, *values) -> Column:
    """Keys ``name|feature|value`` of the values that are there."""
    present = F.filter(F.array(*map(_c, values)), lambda v: v.isNotNull())
    return F.transform(present, lambda v: F.concat_ws("|", _c(name), F.lit(feature), v))


def first_value(entries, label: str) -> Column:
    """The first value of a label in an array of (label, value)."""
    return F.try_element_at(F.filter(_c(entries), lambda e: e["label"] == label), F.lit(1))["value"]


def ordinal_suffix_en(n) -> Column:
    x = _c(n)
    return F.when((x % 100).between(11, 13), "th").when(x % 10 == 1, "st").when(x % 10 == 2, "nd").when(x % 10 == 3, "rd").otherwise("th")


def roman_value(c) -> Column:
    """The value of a well-formed Roman numeral, null otherwise."""
    s = F.lower(_c(c))
    value = lambda ch: F.when(ch == "i", 1).when(ch == "v", 5).when(ch == "x", 10).when(ch == "l", 50).when(ch == "c", 100).when(ch == "d", 500).when(ch == "m", 1000).otherwise(0)
    fold = F.aggregate(F.split(F.reverse(s), ""), F.struct(F.lit(0).alias("sum"), F.lit(0).alias("last")), lambda acc, ch: F.struct((acc["sum"] + F.when(value(ch) < acc["last"], -value(ch)).otherwise(value(ch))).alias("sum"), F.greatest(acc["last"], value(ch)).alias("last")), lambda acc: acc["sum"])
    return F.when(s.rlike("^(?=[ivxlcdm])m{0,4}(cm|cd|d?c{0,4})(xc|xl|l?x{0,4})(ix|iv|v?i{0,4})$"), fold)


def number_range(c) -> Column:
    """House numbers of "1-5;7": numbers between (at most a hundred), zero-filled as the first is written."""
    pattern = r"^([0-9]{1,9})\s*-\s*([0-9]{1,9})$"

    def one(p: Column) -> Column:
        a, b = F.regexp_extract(p, pattern, 1), F.regexp_extract(p, pattern, 2)
        low, high = F.coalesce(F.try_to_number(a, F.lit("999999999")), F.lit(1)).cast("int"), F.coalesce(F.try_to_number(b, F.lit("999999999")), F.lit(0)).cast("int")
        fits = (high >= low) & (high - low < 100)
        digits = F.transform(F.sequence(low, F.greatest(high, low)), lambda i: i.cast("string"))
        filled = F.transform(digits, lambda d: F.concat(F.repeat(F.lit("0"), F.length(a) - F.length(d)), d))
        return F.when(~fits, F.array(p)).when(a.startswith("0"), filled).otherwise(digits)

    return F.slice(F.flatten(F.transform(F.transform(F.split(_c(c), "[;,]"), lambda p: F.trim(p)), one)), 1, 100)


# -- geography


def haversine(lat1, lon1, lat2, lon2, radius: float = 6373.0) -> Column:
    """Great-circle distance in km."""
    a, b, c, d = map(_c, (lat1, lon1, lat2, lon2))
    s = F.pow(F.sin(F.radians(c - a) / 2), 2) + F.cos(F.radians(a)) * F.cos(F.radians(c)) * F.pow(F.sin(F.radians(d - b) / 2), 2)
    return F.lit(2 * radius) * F.asin(F.sqrt(F.least(s, F.lit(1.0))))


def geohash_cell(lat, lon, precision: int = 6) -> Column:
    """The geohash by interleaving the bits of both coordinates, without a Python call."""
    bits = 5 * precision
    nx, ny = (bits + 1) // 2, bits // 2
    x = F.floor((F.pmod(_c(lon) + 180.0, F.lit(360.0))) / 360.0 * (1 << nx)).cast("long")
    y = F.floor((_c(lat) + 90.0) / 180.0 * (1 << ny)).cast("long")
    chars = []
    for k in range(precision):
        v = F.lit(0).cast("long")
        for j in range(5):
            i = 5 * k + j
            bit = F.shiftright(x, nx - 1 - i // 2) if i % 2 == 0 else F.shiftright(y, ny - 1 - i // 2)
            v = v * 2 + bit.bitwiseAND(F.lit(1).cast("long"))
        chars.append(F.substring(F.lit("0123456789bcdefghjkmnpqrstuvwxyz"), v.cast("int") + 1, F.lit(1)))
    return F.when((_c(lat) >= -90) & (_c(lat) < 90), F.concat(*chars))


# -- classes, codes, order


def argmax_label(scores) -> Column:
    """Position of the largest score, the first of equals."""
    s = _c(scores)
    return (F.array_position(s, F.array_max(s)) - 1).cast("int")


def probable(entries, least: float = 0.05) -> Column:
    """(label, prob) by falling probability; the first, and those above both 1/n and ``least``."""
    e = _c(entries)
    ordered = F.array_sort(e, lambda a, b: F.when(a["prob"] > b["prob"], -1).when(a["prob"] < b["prob"], 1).when(a["label"] < b["label"], -1).otherwise(1))
    return F.filter(ordered, lambda x, i: (i == 0) | (x["prob"] > F.greatest(F.lit(1.0) / F.size(e), F.lit(least))))


def normalise_postcode(c) -> Column:
    return F.regexp_replace(F.upper(F.trim(_c(c))), r"\s+", " ")


def postcode_valid(code, pattern) -> Column:
    """Whole string by a pattern column, any case; without a pattern all are valid."""
    return F.when(_c(pattern).isNull(), True).otherwise(F.rlike(F.trim(_c(code)), F.concat(F.lit("(?i)^(?:"), _c(pattern), F.lit(")$"))))


def state_abbreviation(name, states: dict[str, str]) -> Column:
    table = F.create_map(*[F.lit(x) for kv in states.items() for x in kv])
    return F.coalesce(F.try_element_at(table, F.lower(_c(name))), F.lower(_c(name)))


def topological_priority(c, order: Sequence[str]) -> Column:
    """Rank of a value in a given order, last if unknown: for order by."""
    out = F.lit(len(order))
    for i, name in reversed(list(enumerate(order))):
        out = F.when(_c(c) == name, i).otherwise(out)
    return out
