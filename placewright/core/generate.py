"""Generators of training data: spelled numbers, abbreviations, templates, sub-building parts."""

from __future__ import annotations

import random
import re
from bisect import bisect
from collections.abc import Sequence

from . import lexicon as lx
from .numex import ordinal_suffix

_ONES = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
_TENS = "zero ten twenty thirty forty fifty sixty seventy eighty ninety".split()
_IRREGULAR = {"one": "first", "two": "second", "three": "third", "five": "fifth", "eight": "eighth", "nine": "ninth", "twelve": "twelfth"}


def spell_cardinal(n: int) -> str:
    """A number in English words."""
    if n < 20:
        return _ONES[n]
    if n < 100:
        return _TENS[n // 10] + (f"-{_ONES[n % 10]}" if n % 10 else "")
    for size, name in ((10**9, "billion"), (10**6, "million"), (1000, "thousand"), (100, "hundred")):
        if n >= size:
            return f"{spell_cardinal(n // size)} {name}" + (f" {spell_cardinal(n % size)}" if n % size else "")
    raise ValueError(n)


def spell_ordinal(n: int) -> str:
    head, sep, last = re.match(r"(.*?)([ -]?)([a-z]+)\Z", spell_cardinal(n)).groups()
    last = _IRREGULAR.get(last) or (last[:-1] + "ieth" if last.endswith("y") else last + "th")
    return head + sep + last


def spell_hundreds(n: int) -> str:
    """Street style: 1905 as nineteen oh five."""
    high, low = divmod(n, 100)
    if not 10 <= high < 100 or not high % 10 and not low:
        return spell_cardinal(n)
    return f"{spell_cardinal(high)} " + ("hundred" if not low else f"oh {_ONES[low]}" if low < 10 else spell_cardinal(low))


def roman(n: int) -> str:
    out = ""
    for v, s in ((1000, "M"), (900, "CM"), (500, "D"), (400, "CD"), (100, "C"), (90, "XC"), (50, "L"), (40, "XL"), (10, "X"), (9, "IX"), (5, "V"), (4, "IV"), (1, "I")):
        while n >= v:
            out, n = out + s, n - v
    return out


def suffixed_number(n: int, language: str, gender: str = "") -> str:
    return f"{n}{ordinal_suffix(n, language, gender)}"


def number_range(text: str, limit: int = 100) -> list[str]:
    """House numbers of "1-5;7,a-c": ranges of numbers (zero-filled as written) or letters."""
    out: list[str] = []
    for part in re.split(r"[;,]", text):
        part = part.strip()
        m = re.fullmatch(r"(\d+)\s*-\s*(\d+)", part)
        c = re.fullmatch(r"([A-Za-z])\s*-\s*([A-Za-z])", part)
        if m and 0 <= int(m[2]) - int(m[1]) < limit:
            width = len(m[1]) if m[1].startswith("0") else 0
            out += [str(i).zfill(width) for i in range(int(m[1]), int(m[2]) + 1)]
        elif c and c[1] <= c[2]:
            out += [chr(i) for i in range(ord(c[1]), ord(c[2]) + 1)]
        elif part:
            out.append(part)
    return out[:limit]


def recase(text: str, like: str) -> str:
    return text.upper() if like.isupper() and len(like) > 1 else text.title() if like[:1].isupper() else text


def abbreviate(text: str, language: str, seed: int, probability: float = 0.7) -> str:
    """Canonical words replaced by one of their short forms, by a seeded draw; case is kept."""
    rng = random.Random(seed)
    short: dict[str, list[str]] = {}
    for lang, kind, phrase, canonical in lx.default_rows():
        if lang in (language, "all") and phrase != canonical and kind not in lx.AFFIX_KINDS:
            short.setdefault(canonical, []).append(phrase)
    return " ".join(recase(rng.choice(short[w.lower()]), w) if w.lower() in short and rng.random() < probability else w for w in text.split())


def zipf_cdf(n: int, exponent: float = 1.0) -> list[float]:
    total, out = 0.0, []
    for i in range(1, n + 1):
        total += 1 / i**exponent
        out.append(total)
    return [x / total for x in out]


def draw(cdf: Sequence[float], u: float) -> int:
    return min(bisect(cdf, u), len(cdf) - 1)


def sub_building(kind: str, seed: int, language: str = "en") -> str:
    """A phrase such as "apt 4b", "3rd floor" or "po box 17"; repeatable by seed."""
    rng = random.Random(f"{kind}{seed}")
    number = draw(zipf_cdf(30), rng.random()) + 1
    letter = rng.choice("ABCDEFGH")
    words = {
        "unit": ("apt", "unit", "suite", "#", "flat", "room"), "level": ("floor", "level"), "po_box": ("po box",), "entrance": ("entrance",), "staircase": ("staircase",), "block": ("block",),
    }[kind]
    word = rng.choice(words)
    if kind == "level" and rng.random() < 0.6:
        return f"{suffixed_number(number, language)} floor"
    if kind == "po_box":
        return f"{word} {rng.randint(1, 9999)}"
    name = f"{number}{letter}" if rng.random() < 0.3 else letter if rng.random() < 0.1 else str(number)
    return f"#{name}" if word == "#" else f"{word} {name}"


#: Per country the order of lines; "a||b" takes the first that is there.
TEMPLATES = {
    "us": ["house", "house_number road unit||house_number road", "po_box", "city state postcode", "country"],
    "de": ["house", "road house_number unit||road house_number", "po_box", "postcode city", "country"],
    "fr": ["house", "house_number road", "po_box", "postcode city", "country"],
    "": ["house", "house_number road unit||house_number road||road", "po_box", "suburb", "city||city_district||island", "state_district", "state postcode||postcode", "country"],
}
MINIMAL = ({"road"}, {"house", "city"}, {"po_box"}, {"city"}, {"postcode"})


def format_address(components: dict[str, str], country: str = "", tagged: bool = False, seed: int | None = None, inversion: float = 0.0) -> str | None:
    """Components in a country's order, or None with too few of them; ``tagged`` gives token/label."""
    have = {k: v for k, v in components.items() if v}
    if not any(need <= have.keys() for need in MINIMAL):
        return None
    lines = []
    for line in TEMPLATES.get(country.lower(), TEMPLATES[""]):
        options = [o.split() for o in line.split("||")]
        chosen = next((o for o in options if set(o) <= have.keys()), None) or next(([f for f in o if f in have] for o in options if have.keys() & set(o)), [])
        parts = [(f, have[f]) for f in chosen]
        if parts and parts not in lines:
            lines.append(parts)
    if seed is not None and random.Random(seed).random() < inversion:
        lines.reverse()
    if not tagged:
        return ", ".join(" ".join(v for _, v in line) for line in lines)
    return " ,/fsep ".join(" ".join(f"{w}/{f}" for f, v in line for w in v.split()) for line in lines)


#: component, what it needs, in order of dependency
DEPENDS = (("house_number", ("road",)), ("unit", ("house_number", "house")), ("level", ("house_number", "house")), ("entrance", ("house_number",)), ("staircase", ("house_number",)), ("road", ()), ("po_box", ()))


def drop_out(components: dict[str, str], keep: dict[str, float], seed: int) -> dict[str, str]:
    """Keep each component with its probability, then drop what lost all it depends on; a city named
    like its state goes with it."""
    rng = random.Random(seed)
    out = {k: v for k, v in components.items() if rng.random() < keep.get(k, 1.0)}
    if components.get("city") and components.get("city") == components.get("state") and not {"city", "state"} <= out.keys():
        out.pop("city", None)
        out.pop("state", None)
    for name, needs in sorted(DEPENDS, key=lambda d: len(d[1])):
        if name in out and needs and not any(n in out for n in needs if n in components):
            del out[name]
    return out


def topological(depends: dict[str, Sequence[str]]) -> list[str]:
    """Names, each after what it depends on."""
    out: list[str] = []
    state: dict[str, int] = {}

    def visit(n: str) -> None:
        if state.get(n) == 1:
            raise ValueError(f"cycle at {n}")
        if n not in state:
            state[n] = 1
            for m in sorted(depends.get(n, ())):
                visit(m)
            state[n] = 2
            out.append(n)

    for n in sorted(depends):
        visit(n)
    return out


NAME_PREFIXES = {"en": ("city of", "town of", "village of", "county of", "borough of"), "fr": ("commune de", "ville de"), "de": ("stadt", "gemeinde"), "es": ("ciudad de", "municipio de")}
NAME_SUFFIXES = {"en": ("county", "city", "township", "borough", "parish", "district"), "de": ("kreis",), "fr": (), "es": ()}


def strip_name_affixes(name: str, language: str) -> str:
    """Without administrative words, suffixes first; a name of nothing else stays."""
    out = name
    for words, pattern in ((NAME_SUFFIXES, r"\s+(?:{})\s*\Z"), (NAME_PREFIXES, r"\A\s*(?:{})\s+")):
        if own := words.get(language):
            out = re.sub(pattern.format("|".join(map(re.escape, sorted(own, key=len, reverse=True)))), "", out, flags=re.I)
    return out.strip() or name


POSTCODES = {"us": r"\d{5}(-\d{4})?", "ca": r"[A-Z]\d[A-Z] ?\d[A-Z]\d", "de": r"\d{5}", "fr": r"\d{5}", "gb": r"[A-Z]{1,2}\d[A-Z\d]? ?\d[A-Z]{2}", "nl": r"\d{4} ?[A-Z]{2}", "es": r"\d{5}", "jp": r"\d{3}-?\d{4}"}


def valid_postcode(code: str, country: str) -> bool:
    """Whole string by the country's pattern, any case; a country without one accepts all."""
    pattern = POSTCODES.get(country.lower())
    return pattern is None or re.fullmatch(pattern, code.strip(), re.I) is not None


STATES = {"us": {"ohio": "oh", "new york": "ny", "california": "ca", "texas": "tx", "florida": "fl"}, "ca": {"ontario": "on", "quebec": "qc"}, "au": {"victoria": "vic", "queensland": "qld"}}
COUNTRIES = {"us": "United States", "de": "Germany", "fr": "France", "es": "Spain", "it": "Italy", "gb": "United Kingdom", "nl": "Netherlands", "jp": "Japan"}
LANGUAGES = {"en": "English", "de": "German", "fr": "French", "es": "Spanish", "it": "Italian", "nl": "Dutch", "ja": "Japanese", "ko": "Korean"}


def category_query(category: str, city: str, seed: int) -> str:
    return random.Random(seed).choice(("{0} in {1}", "{0} near {1}", "{0} {1}", "{1} {0}")).format(category, city)


def chain_match(name: str, chains: dict[str, str]) -> str | None:
    """The chain of a name, if no word of the name is left over."""
    return chains.get(" ".join(re.findall(r"\w+", name.lower())))
