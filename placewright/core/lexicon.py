"""Phrase dictionaries: roles per kind, and greedy longest search over tokens."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable
from functools import lru_cache
from importlib import resources
from typing import NamedTuple

from .lexer import Token, TokenType, is_ideographic

ANY, NAME, HOUSE, STREET, UNIT, LEVEL, STAIR, ENTRANCE, CATEGORY, NEAR = (1 << i for i in range(10))
TOPONYM, POSTCODE, PO_BOX = 1 << 13, 1 << 14, 1 << 15
ALL = (1 << 16) - 1
NUMERIC_COMPONENTS = HOUSE | UNIT | LEVEL | PO_BOX | POSTCODE | STAIR | ENTRANCE | STREET
DEFAULT_COMPONENTS = NAME | HOUSE | STREET | PO_BOX | UNIT | LEVEL | ENTRANCE | STAIR | POSTCODE
COMPONENT_NAMES = {"name": NAME, "house_number": HOUSE, "street": STREET, "unit": UNIT, "level": LEVEL, "staircase": STAIR, "entrance": ENTRANCE, "category": CATEGORY, "near": NEAR, "toponym": TOPONYM, "postal_code": POSTCODE, "po_box": PO_BOX, "any": ANY}

_BUT = lambda x: ALL & ~x & ~ANY
_LOOSE = NAME | STREET | CATEGORY | NEAR | TOPONYM | UNIT | LEVEL | STAIR | ENTRANCE


class Role(NamedTuple):
    """Component masks of a dictionary kind."""

    kind: int
    base: int
    ignorable: int = 0
    valid: int = 0
    edge: int = 0
    specifier: int = 0
    root: int = 0


ROLES: dict[str, Role] = {
    "synonyms": Role(2, ANY, 0, _LOOSE & ~(UNIT | LEVEL | STAIR | ENTRANCE), 0, 0, NAME | STREET),
    "stopwords": Role(3, ANY, NAME | STREET | CATEGORY | NEAR | TOPONYM, NAME | STREET | CATEGORY | NEAR | TOPONYM),
    "elisions": Role(4, ANY, ANY),
    "ambiguous_expansions": Role(5, 0),
    "street_names": Role(10, STREET, 0, NAME | STREET, 0, 0, NAME | STREET),
    "street_types": Role(11, STREET, NAME | STREET, NAME | STREET),
    "concatenated_prefixes_separable": Role(12, ANY),
    "concatenated_suffixes_separable": Role(13, ANY),
    "concatenated_suffixes_inseparable": Role(14, ANY),
    "directionals": Role(15, ANY, STREET, _LOOSE, STREET, 0, STREET),
    "qualifiers": Role(16, STREET, TOPONYM, 0, 0, 0, NAME | STREET),
    "building_types": Role(17, NAME | HOUSE | STREET | UNIT, HOUSE | NAME | UNIT),
    "level_types_numbered": Role(18, LEVEL, LEVEL),
    "level_types_standalone": Role(19, LEVEL, _BUT(LEVEL), 0, 0, LEVEL),
    "level_types_mezzanine": Role(20, LEVEL, _BUT(LEVEL), 0, 0, LEVEL),
    "level_types_basement": Role(21, LEVEL, _BUT(LEVEL), 0, 0, LEVEL),
    "level_types_sub_basement": Role(22, LEVEL, _BUT(LEVEL), 0, 0, LEVEL),
    "unit_types_numbered": Role(23, UNIT, UNIT),
    "unit_types_standalone": Role(24, UNIT, _BUT(UNIT), 0, 0, UNIT),
    "unit_directions": Role(25, UNIT, _BUT(UNIT)),
    "entrances": Role(26, ENTRANCE, ENTRANCE),
    "staircases": Role(27, STAIR, STAIR),
    "number": Role(30, HOUSE | UNIT | LEVEL | PO_BOX | STAIR | ENTRANCE, HOUSE | UNIT | LEVEL | PO_BOX | STAIR | ENTRANCE | STREET, 0, 0, 0, NAME | STREET),
    "no_number": Role(31, HOUSE, _BUT(HOUSE)),
    "house_numbers": Role(32, HOUSE, HOUSE),
    "post_office": Role(33, PO_BOX, PO_BOX),
    "postcodes": Role(34, POSTCODE, POSTCODE),
    "place_names": Role(50, NAME | STREET, NAME, 0, NAME, 0, STREET),
    "company_types": Role(51, NAME, NAME, 0, NAME),
    "given_names": Role(52, NAME | STREET),
    "surnames": Role(53, NAME | STREET),
    "personal_titles": Role(54, NAME | STREET, NAME | STREET, 0, 0, 0, NAME | STREET),
    "personal_suffixes": Role(55, NAME | STREET),
    "academic_degrees": Role(56, NAME, NAME | STREET, 0, 0, 0, NAME | STREET),
    "people": Role(60, NAME | STREET),
    "organizations": Role(61, NAME),
    "categories": Role(70, CATEGORY),
    "chains": Role(71, NAME),
    "near": Role(72, NEAR),
    "cross_streets": Role(80, STREET),
    "nulls": Role(90, ANY),
    "toponyms": Role(100, NAME | STREET | TOPONYM, 0, 0, 0, 0, NAME | STREET),
    "postal_code_phrases": Role(101, POSTCODE),
}
AFFIX_KINDS = ("elisions", "concatenated_prefixes_separable", "concatenated_suffixes_separable", "concatenated_suffixes_inseparable")
SEPARABLE = ("elisions", "concatenated_prefixes_separable", "concatenated_suffixes_separable")


class Expansion(NamedTuple):
    """One reading of a phrase: its canonical form (itself, if ``is_canonical``)."""

    canonical: str
    is_canonical: bool
    kinds: tuple[str, ...]
    components: int

    @property
    def ignorable(self) -> int:
        return _or(self.kinds, "ignorable")


def _or(kinds: Iterable[str], field: str) -> int:
    mask = 0
    for k in kinds:
        mask |= getattr(ROLES[k], field)
    return mask


class Phrase(NamedTuple):
    """A match: token index, number of tokens, language and readings."""

    start: int
    length: int
    language: str
    expansions: tuple[Expansion, ...]

    @property
    def components(self) -> int:
        return _bits(e.components for e in self.expansions)

    def role(self, field: str) -> int:
        return _bits(_or(e.kinds, field) for e in self.expansions)

    @property
    def ambiguous(self) -> bool:
        return any("ambiguous_expansions" in e.kinds for e in self.expansions)


def _bits(masks: Iterable[int]) -> int:
    out = 0
    for m in masks:
        out |= m
    return out


class Dictionary:
    """Phrases by language; phrases are tuples of tokens, found by their first token."""

    def __init__(self, rows: Iterable[tuple[str, str, str, str]]):
        """``rows``: (language, kind, phrase, canonical)."""
        found: dict[str, dict[str, dict[str, set[str]]]] = defaultdict(lambda: defaultdict(lambda: defaultdict(set)))
        for language, kind, phrase, canonical in rows:
            if kind not in ROLES:
                raise ValueError(f"unknown dictionary {kind!r}")
            if not phrase.strip() or "}" in phrase:
                raise ValueError(f"bad phrase {phrase!r} in {language}/{kind}")
            found[language][phrase][canonical].add(kind)
        self.exact: dict[str, dict[str, tuple[Expansion, ...]]] = {}
        self.first: dict[str, dict[str, list[tuple[str, ...]]]] = {}
        self.prefixes: dict[str, dict[str, bool]] = {}
        self.suffixes: dict[str, dict[str, bool]] = {}
        for language, phrases in found.items():
            self.exact[language] = {}
            first: dict[str, list[tuple[str, ...]]] = defaultdict(list)
            self.prefixes[language], self.suffixes[language] = {}, {}
            for phrase, readings in phrases.items():
                # an ambiguous flag is no reading of its own where there are others
                flag = "ambiguous_expansions"
                marked = any(flag in ks for ks in readings.values())
                rest = {c: ks - {flag} for c, ks in readings.items() if ks - {flag}} or readings
                order = sorted(rest.items(), key=lambda r: (r[0] != phrase, r[0]))
                self.exact[language][phrase] = tuple(
                    Expansion(c, c == phrase, tuple(sorted(ks | ({flag} if marked else set()))), _or(ks, "base")) for c, ks in order
                )
                kinds = set().union(*rest.values())
                for k in kinds.intersection(AFFIX_KINDS):
                    side = self.suffixes if "suffixes" in k else self.prefixes
                    side[language][phrase] = side[language].get(phrase, False) or k in SEPARABLE
                words = tuple(phrase.split(" "))
                first[words[0]].append(words)
            self.first[language] = {w: sorted(ps, key=len, reverse=True) for w, ps in first.items()}
        self.languages = sorted(self.exact)
        self._merged: Dictionary | None = None

    @property
    def merged(self) -> Dictionary:
        """All languages in one name space, "": what is searched when no language is given."""
        if self._merged is None:
            self._merged = Dictionary(("", k, phrase, e.canonical) for lang in self.languages for phrase, es in self.exact[lang].items() for e in es for k in e.kinds)
        return self._merged

    def spaces(self, languages: Iterable[str] | None) -> list[str]:
        """The name spaces to search: the languages and ``all``, or every one."""
        names = self.languages if languages is None else [*languages, "all"]
        return [n for n in dict.fromkeys(names) if n in self.exact]

    def get(self, phrase: str, language: str) -> tuple[Expansion, ...] | None:
        return self.exact.get(language, {}).get(phrase)

    def search(self, tokens: list[Token], language: str) -> list[Phrase]:
        """Greedy longest matches from the left, without overlap; white space tokens are passed over."""
        first = self.first.get(language)
        out: list[Phrase] = []
        if not first:
            return out
        i, n = 0, len(tokens)
        while i < n:
            hit = None
            for words in first.get(tokens[i].text, ()):
                j, k = i, 0
                while j < n and k < len(words):
                    if k and tokens[j].type == TokenType.WHITESPACE:
                        j += 1
                        continue
                    if tokens[j].text != words[k]:
                        break
                    j, k = j + 1, k + 1
                if k == len(words):
                    hit = (j, words)
                    break
            if hit is None and is_ideographic(tokens[i].type):
                text = ""
                for j in range(i, min(n, i + 12)):
                    text += tokens[j].text
                    if text in self.exact[language]:
                        hit = (j + 1, (text,))
            if hit is None:
                i += 1
                continue
            out.append(Phrase(i, hit[0] - i, language, self.exact[language][" ".join(hit[1])]))
            i = hit[0]
        return out

    def longest_prefix(self, token: str, language: str) -> tuple[str, bool] | None:
        own = self.prefixes.get(language, {})
        for k in range(len(token) - 1, 0, -1):
            if token[:k] in own:
                return token[:k], own[token[:k]]
        return None

    def longest_suffix(self, token: str, language: str) -> tuple[str, bool] | None:
        own = self.suffixes.get(language, {})
        for k in range(1, len(token)):
            if token[k:] in own:
                return token[k:], own[token[k:]]
        return None


def memberships(phrases: list[Phrase], n: int) -> list[int]:
    """Per token the index of the phrase it belongs to, or -1."""
    out = [-1] * n
    for index, p in enumerate(phrases):
        out[p.start : p.start + p.length] = [index] * p.length
    return out


def read_lexicon(lines: Iterable[str]) -> list[tuple[str, str, str, str]]:
    """Rows of the lexicon format: (language, kind, phrase, canonical)."""
    rows, head = [], ("", "")
    for line in lines:
        line = line.strip()
        if not line or line.startswith("# "):
            continue
        if line.startswith("["):
            head = tuple(line[1:-1].split(" "))
            continue
        name, _, short = line.partition(":")
        canonical = name.replace("_", " ")
        for phrase in (canonical, *(s.replace("_", " ") for s in short.split())):
            rows.append((*head, phrase, canonical))
    return rows


@lru_cache(1)
def default_rows() -> tuple[tuple[str, str, str, str], ...]:
    text = resources.files("placewright.resources").joinpath("lexicon.txt").read_text(encoding="utf-8")
    return tuple(read_lexicon(text.splitlines()))


@lru_cache(1)
def default_dictionary() -> Dictionary:
    return Dictionary(default_rows())
