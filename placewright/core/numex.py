"""Number words: a small grammar per language, spans with values, and their replacement by digits."""

from __future__ import annotations

import re
from functools import lru_cache
from typing import NamedTuple

import regex


class Rule(NamedTuple):
    value: int
    left: str = ""  # add | multiply | concat (only after a number)
    right: int = 0  # what follows is added if smaller than this
    ordinal: bool = False
    gender: str = ""


class Result(NamedTuple):
    value: int
    start: int
    end: int
    ordinal: bool
    gender: str = ""


class Grammar(NamedTuple):
    rules: dict[str, Rule]
    stopwords: frozenset[str]
    whole_words: bool
    ordinal_suffixes: tuple[tuple[str, str, str], ...] = ()  # (gender, digits' ending, suffix), longest ending first


def _zip(words: str, start: int, step: int = 1, **kw) -> dict[str, Rule]:
    return {w.replace("_", " "): Rule(start + i * step, **kw) for i, w in enumerate(words.split())}


def _english() -> Grammar:
    r = _zip("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen", 0)
    r |= _zip("twenty thirty forty fifty sixty seventy eighty ninety", 20, 10, right=10)
    r |= {"oh": Rule(0, "concat"), "hundred": Rule(100, "multiply", 100), "thousand": Rule(1000, "multiply", 1000), "million": Rule(10**6, "multiply", 10**6), "billion": Rule(10**9, "multiply", 10**9)}
    r |= _zip("first second third fourth fifth sixth seventh eighth ninth tenth eleventh twelfth thirteenth fourteenth fifteenth sixteenth seventeenth eighteenth nineteenth", 1, ordinal=True)
    r |= _zip("twentieth thirtieth fortieth fiftieth sixtieth seventieth eightieth ninetieth", 20, 10, ordinal=True)
    r |= {"hundredth": Rule(100, "multiply", 0, True), "thousandth": Rule(1000, "multiply", 0, True), "millionth": Rule(10**6, "multiply", 0, True)}
    return Grammar(r, frozenset(["and", "-"]), True, (("", "11", "th"), ("", "12", "th"), ("", "13", "th"), ("", "1", "st"), ("", "2", "nd"), ("", "3", "rd"), ("", "", "th")))


def _french() -> Grammar:
    r = _zip("zero un deux trois quatre cinq six sept huit neuf dix onze douze treize quatorze quinze seize dix-sept dix-huit dix-neuf", 0)
    r |= {"une": Rule(1), "zéro": Rule(0)}
    r |= _zip("vingt trente quarante cinquante", 20, 10, right=10) | {"soixante": Rule(60, right=20), "septante": Rule(70, right=10), "huitante": Rule(80, right=10), "octante": Rule(80, right=10), "nonante": Rule(90, right=10)}
    for a in ("quatre-vingt", "quatre vingt", "quatre-vingts", "quatre vingts"):
        r[a] = Rule(80, right=20)
    r |= {"cent": Rule(100, "multiply", 100), "cents": Rule(100, "multiply", 100), "mille": Rule(1000, "multiply", 1000), "million": Rule(10**6, "multiply", 10**6), "millions": Rule(10**6, "multiply", 10**6)}
    r |= {"premier": Rule(1, ordinal=True, gender="m"), "première": Rule(1, ordinal=True, gender="f"), "premiere": Rule(1, ordinal=True, gender="f")}
    r |= _zip("deuxième troisième quatrième cinquième sixième septième huitième neuvième dixième", 2, ordinal=True) | _zip("deuxieme troisieme quatrieme cinquieme sixieme septieme huitieme neuvieme dixieme", 2, ordinal=True)
    return Grammar(r, frozenset(["et", "-"]), True, (("m", "1", "er"), ("f", "1", "re"), ("", "1", "er"), ("", "", "e")))


def _german() -> Grammar:
    ones = {"ein": 1, "eins": 1, "eine": 1, "zwei": 2, "zwo": 2, "drei": 3, "vier": 4, "fünf": 5, "funf": 5, "fuenf": 5, "sechs": 6, "sieben": 7, "acht": 8, "neun": 9}
    teens = {"null": 0, "zehn": 10, "elf": 11, "zwölf": 12, "zwolf": 12, "dreizehn": 13, "vierzehn": 14, "fünfzehn": 15, "sechzehn": 16, "siebzehn": 17, "achtzehn": 18, "neunzehn": 19}
    tens = {"zwanzig": 20, "dreißig": 30, "dreissig": 30, "vierzig": 40, "fünfzig": 50, "funfzig": 50, "sechzig": 60, "siebzig": 70, "achtzig": 80, "neunzig": 90}
    r = {w: Rule(v) for w, v in {**ones, **teens}.items()} | {w: Rule(v, "add") for w, v in tens.items()}
    r |= {"hundert": Rule(100, "multiply", 100), "tausend": Rule(1000, "multiply", 1000)}
    for end in ("te", "ter", "tes", "ten"):
        r |= {w + end: Rule(v, ordinal=True) for w, v in ones.items() if v not in (1, 3, 7)} | {s + end: Rule(v, ordinal=True) for s, v in (("ers", 1), ("drit", 3), ("sieb", 7)) if s != "drit"}
        r |= {w + end: Rule(v, ordinal=True) for w, v in teens.items() if v >= 10} | {w + "s" + end: Rule(v, "add", 0, True) for w, v in tens.items()} | {"dritt" + end[1:]: Rule(3, ordinal=True), "hunderts" + end: Rule(100, "multiply", 0, True)}
    return Grammar(r, frozenset(["und", "-"]), False, (("", "", "."),))


def _italian() -> Grammar:
    r = _zip("zero uno due tre quattro cinque sei sette otto nove dieci undici dodici tredici quattordici quindici sedici diciassette diciotto diciannove", 0)
    r |= {"un": Rule(1), "una": Rule(1), "tré": Rule(3)}
    for w, v in zip("venti trenta quaranta cinquanta sessanta settanta ottanta novanta".split(), range(20, 100, 10), strict=True):
        r |= {w: Rule(v, "add", 10), w[:-1] + "uno": Rule(v + 1, "add"), w[:-1] + "otto": Rule(v + 8, "add")}
    r |= {"cento": Rule(100, "multiply", 100), "mille": Rule(1000, "multiply", 1000), "mila": Rule(1000, "multiply", 1000), "milione": Rule(10**6, "multiply", 10**6)}
    for g, e in (("m", "o"), ("f", "a")):
        r |= {w + e: Rule(i, ordinal=True, gender=g) for i, w in enumerate("prim second terz quart quint sest settim ottav non decim".split(), 1)}
    return Grammar(r, frozenset(["e", "-"]), False, (("f", "", "ª"), ("", "", "º")))


def _spanish() -> Grammar:
    r = _zip("cero uno dos tres cuatro cinco seis siete ocho nueve diez once doce trece catorce quince dieciséis diecisiete dieciocho diecinueve", 0)
    r |= {"un": Rule(1), "una": Rule(1), "dieciseis": Rule(16), "veinte": Rule(20, right=10)} | _zip("veintiuno veintidós veintitrés veinticuatro veinticinco veintiséis veintisiete veintiocho veintinueve", 21)
    r |= _zip("treinta cuarenta cincuenta sesenta setenta ochenta noventa", 30, 10, right=10)
    r |= {"cien": Rule(100, "multiply", 100), "ciento": Rule(100, right=100), "mil": Rule(1000, "multiply", 1000)}
    r |= _zip("doscientos trescientos cuatrocientos quinientos seiscientos setecientos ochocientos novecientos", 200, 100, right=100)
    for g, e in (("m", "o"), ("f", "a")):
        r |= {w + e: Rule(i, ordinal=True, gender=g) for i, w in enumerate("primer segund tercer cuart quint sext séptim octav noven".split(), 1)}
        r |= {w + e: Rule(10 * i, right=10, ordinal=True, gender=g) for i, w in enumerate("décim vigésim trigésim cuadragésim quincuagésim".split(), 1)}
        r |= {w + e: Rule(100 * i, right=100, ordinal=True, gender=g) for i, w in enumerate("centésim ducentésim tricentésim".split(), 1)} | {"tricentesim" + e: Rule(300, right=100, ordinal=True, gender=g)}
    return Grammar(r, frozenset(["y", "-"]), True, (("f", "", ".ª"), ("m", "", ".º"), ("", "", ".º")))


def _east(digits: str, tens: str, hundreds: str, thousands: str, myriads: str) -> Grammar:
    r = {c: Rule(i) for i, c in enumerate(digits)} | {tens: Rule(10, "multiply", 10), hundreds: Rule(100, "multiply", 100), thousands: Rule(1000, "multiply", 1000), myriads: Rule(10**4, "multiply", 10**4)}
    return Grammar(r, frozenset(), False, (("", "", ""),))


_ROMAN = regex.compile(r"(?=[ivxlcdm])m{0,4}(?:cm|cd|d?c{0,4})(?:xc|xl|l?x{0,4})(?:ix|iv|v?i{0,4})\Z")
_ROMAN_VALUES = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}


def roman_value(text: str) -> int | None:
    """The value of a well-formed numeral."""
    text = text.lower()
    if not _ROMAN.match(text):
        return None
    total = 0
    for a, b in zip(text, text[1:] + "i"):
        v = _ROMAN_VALUES[a]
        total += -v if v < _ROMAN_VALUES[b] and b != "i" else v
    return total


def is_likely_roman(token: str) -> bool:
    """Short ones only of i, v and x; longer ones of any letter; well-formed in any case."""
    low = token.lower()
    return bool(low) and set(low) <= set("ivx" if len(low) <= 2 else "ivxlcdm") and roman_value(low) is not None


@lru_cache(None)
def grammar(language: str) -> Grammar | None:
    make = {"en": _english, "fr": _french, "de": _german, "it": _italian, "es": _spanish}.get(language)
    if make:
        return make()
    if language == "ja" or language == "zh":
        return _east("〇一二三四五六七八九", "十", "百", "千", "万")
    if language == "ko":
        return _east("영일이삼사오육칠팔구", "십", "백", "천", "만")
    return None


_ROMAN_TOKEN = regex.compile(r"(?<![\p{L}\p{N}.])[ivxlcdmIVXLCDM]+(?![\p{L}\p{N}.])").finditer


@lru_cache(None)
def _any_rule(language: str):
    """A quick test whether a text can hold a number word at all."""
    g = grammar(language)
    names = "|".join(map(re.escape, sorted((w for w, r in g.rules.items() if r.left != "concat"), key=len, reverse=True)))
    return re.compile(rf"\b(?:{names})" if g.whole_words else f"(?:{names})").search


_WORD = regex.compile(r"[\p{L}\p{M}]+|-|\s+|.", regex.S)


def _segments(text: str, g: Grammar) -> list[tuple[str, int, int]]:
    """(rule, stop or other text, begin, end): longest rules first; whole words or parts of words."""
    out, at, n = [], 0, len(text)
    longest = max(map(len, g.rules))
    while at < n:
        hit = None
        if not at or not g.whole_words or not text[at - 1].isalpha() or (out and out[-1][0] in g.rules):
            for k in range(min(longest, n - at), 0, -1):
                free = not g.whole_words or at + k == n or not text[at + k].isalpha()
                if text[at : at + k] in g.rules and (free or any(r.left == "multiply" and text.startswith(w, at + k) for w, r in g.rules.items())):
                    hit = k
                    break
        if hit is None and not g.whole_words:
            for s in g.stopwords:
                if text.startswith(s, at) and s != "-":
                    hit = len(s)
        if hit is None:
            hit = len(_WORD.match(text, at)[0]) if g.whole_words or text[at].isspace() or not text[at].isalpha() else 1
        out.append((text[at : at + hit], at, at + hit))
        at += hit
    return out


def convert_numeric_expressions(text: str, language: str) -> list[Result]:
    """Spans of number words with their values."""
    if language == "la":
        return [Result(roman_value(m[0]), m.start(), m.end(), False) for m in _ROMAN_TOKEN(text) if is_likely_roman(m[0])]
    g = grammar(language)
    if g is None or not text:
        return []
    low = text.lower()
    if not _any_rule(language)(low):
        return []
    segments = _segments(low, g)
    out: list[Result] = []
    i = 0
    while i < len(segments):
        word, begin, end = segments[i]
        rule = g.rules.get(word)
        if rule is None or rule.left == "concat":
            i += 1
            continue
        value, open_, ordinal, gender = rule.value, rule.right, rule.ordinal, rule.gender
        level = rule.right or (10 if rule.value < 10 else 100 if rule.value < 100 else rule.value)
        last, j, digits = i, i + 1, str(rule.value)
        chained = False  # "nineteen oh one", "seventeen eighty"
        stops = 0
        while j < len(segments) and not (ordinal and not open_):
            w, _, _ = segments[j]
            if w.isspace() or w in g.stopwords:
                stops += w in g.stopwords and w != "-"
                j += 1
                continue
            nxt = g.rules.get(w)
            if nxt is None:
                break
            if nxt.left == "multiply":
                part = value % nxt.value
                if nxt.value > 100 and value >= 1000 * nxt.value and not part:
                    break  # "a million thousand"; in "a million one thousand" the one is multiplied
                value = value - part + nxt.value * (part or 1)
                open_, level = nxt.right, nxt.value
            elif nxt.left == "add" and value % 10 == value % 100 and nxt.value >= 10 and not chained and (stops or not g.whole_words):
                value += nxt.value
                open_ = nxt.right
            elif nxt.left == "add" and not g.whole_words and open_ and nxt.value < open_:
                value, open_ = value + nxt.value, nxt.right
            elif open_ and nxt.value < open_ and nxt.left != "concat":
                value += nxt.value
                open_ = min(nxt.right, open_)
            elif open_ == 0 and not stops and g.whole_words and not nxt.ordinal and ((nxt.left == "concat" and value < 100) or (10 <= value < 100 and 10 <= nxt.value < 100 and value % 100 >= 10) or (chained and nxt.value < 10)):
                if nxt.left == "concat":
                    chained, value = True, value * 10
                elif chained:
                    value = value * 10 + nxt.value
                    chained = False
                else:
                    value = value * 100 + nxt.value
                    open_ = nxt.right
            elif not g.whole_words and not stops and 1 <= value % 10 and nxt.value >= 100:
                break
            else:
                break
            ordinal, gender = nxt.ordinal, nxt.gender or gender
            last, stops = j, 0
            j += 1
        whole = segments[last][2]
        free = (begin == 0 or not low[begin - 1].isalpha()) and (whole == len(low) or not low[whole].isalpha())
        if free or language in ("ja", "zh", "ko"):
            out.append(Result(value, begin, whole, ordinal, gender))
            i = last + 1
        else:
            while i < len(segments) and not segments[i][0].isspace():
                i += 1
    return out


def ordinal_suffix(value: int, language: str, gender: str = "") -> str:
    """What follows the digits of an ordinal; the longest matching ending wins, then the gender."""
    g = grammar(language)
    if g is None:
        return ""
    digits = str(value)
    rules = [r for r in g.ordinal_suffixes if digits.endswith(r[1])]
    own = [r for r in rules if r[0] == gender] or [r for r in rules if r[0] == ""]
    return max(own, key=lambda r: len(r[1]))[2] if own else ""


def replace_numeric_expressions(text: str, language: str) -> str:
    """``text`` with digits for number words; unchanged where there are none."""
    out, at = [], 0
    for r in convert_numeric_expressions(text, language):
        out += [text[at : r.start], str(r.value), ordinal_suffix(r.value, language, r.gender) if r.ordinal else ""]
        at = r.end
    return "".join([*out, text[at:]]) if out else text


@lru_cache(None)
def _suffixes(language: str) -> tuple[str, ...]:
    return tuple(sorted({r[2] for r in grammar(language).ordinal_suffixes if r[2]}, key=len, reverse=True))


def ordinal_suffix_length(token: str, language: str) -> int:
    """Length of an ordinal suffix at the end of a token, after a digit or a Roman numeral."""
    g = grammar(language)
    if g is None:
        return 0
    for s in _suffixes(language):
        stem = token[: -len(s)]
        if token.lower().endswith(s) and stem and (stem[-1].isdigit() or is_likely_roman(stem)):
            return len(s)
    return 0


def valid_ordinal_suffix(token: str, language: str) -> bool:
    """Whether the suffix is the one that belongs to the number."""
    n = ordinal_suffix_length(token, language)
    stem = token[: len(token) - n] if n else ""
    return bool(n) and stem.isdigit() and any(token[-n:].lower() == ordinal_suffix(int(stem), language, g) for g in ("", "m", "f"))


def ordinal_suffix_lengths(tokens: list[str], language: str) -> list[int]:
    """Per token the length of its suffix; a suffix token after a number counts whole."""
    out = []
    for i, t in enumerate(tokens):
        n = ordinal_suffix_length(t, language)
        if not n and i and tokens[i - 1].isdigit() and valid_ordinal_suffix(tokens[i - 1] + t, language):
            n = len(t)
        out.append(n)
    return out


def possible_ordinal_digits(token: str) -> int:
    """Number of digits, 0 if they don't stand together."""
    m = regex.fullmatch(r"\D*(\d+)\D*", token)
    return len(m[1]) if m else 0
