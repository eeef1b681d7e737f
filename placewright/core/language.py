"""Language evidence of short texts: scripts, dictionary phrases and character quadgrams."""

from __future__ import annotations

from collections import Counter
from functools import lru_cache

import regex

from . import lexicon as lx
from .lexer import TokenType, is_ideographic, is_word, tokenize
from .text import SCRIPT_LANGUAGES, normalize_string, script_spans

UNKNOWN, AMBIGUOUS = "unk", "xxx"


def quadgrams(word: str) -> list[str]:
    """Four-grams with ``_`` where the word goes on; a shorter word whole."""
    if len(word) < 4:
        return [word]
    n = len(word) - 3
    return [("_" if i else "") + word[i : i + 4] + ("_" if i < n - 1 else "") for i in range(n)]


_PARTS = regex.compile(r"[\-'’.]").split


def _word(text: str, d: lx.Dictionary) -> tuple[str, ...]:
    """Affixes and quadgrams of one word."""
    d, out = d.merged, []
    if hit := d.longest_prefix(text, ""):
        out.append(f"pfx={hit[0]}")
    if hit := d.longest_suffix(text, ""):
        out.append(f"sfx={hit[0]}")
    return (*out, *(g for word in _PARTS(text) if word for g in quadgrams(word)))


_known_word = lru_cache(1 << 14)(_word)


def features(text: str, dictionary: lx.Dictionary | None = None) -> dict[str, float]:
    """Feature counts for the classifier: script, phrases, affixes, quadgrams, ideographs."""
    own = dictionary or lx.default_dictionary()
    d = own.merged
    found: Counter[str] = Counter()
    text = normalize_string(text or "", 0b11100) or ""
    for script, span, _ in script_spans(text):
        if script in ("Common", "Unknown"):
            continue
        found[f"sc={script}"] += 1
        if len(SCRIPT_LANGUAGES.get(script, ())) == 1:
            continue
        tokens = tokenize(span)
        for p in d.search(tokens, ""):
            found[" ".join(t.text for t in tokens[p.start : p.start + p.length])] += 1
        for t in tokens:
            if is_ideographic(t.type):
                found[t.text] += 1
            elif is_word(t.type):
                found.update((_known_word if len(t.text) <= 50 else _word)(t.text, own))
    return dict(found)


@lru_cache(4)
def _own_phrases(d: lx.Dictionary) -> dict[str, frozenset[str]]:
    return {lang: frozenset(d.exact[lang]) for lang in d.languages if lang != "all"}


def guess_languages(text: str, dictionary: lx.Dictionary | None = None) -> tuple[str, ...]:
    """Languages whose dictionaries know phrases of the text, most evidence first; by script
    where no dictionary speaks, and every dictionary's language for plain Latin text."""
    d = dictionary or lx.default_dictionary()
    scripts = [s for s, _, _ in script_spans(text) if s not in ("Common", "Unknown")]
    for s in scripts:
        if len(SCRIPT_LANGUAGES.get(s, ())) == 1:
            return (SCRIPT_LANGUAGES[s][0],)
    tokens = tokenize(normalize_string(text))
    score: Counter[str] = Counter()
    for lang in d.languages:
        if lang == "all":
            continue
        for p in d.search(tokens, lang):
            score[lang] += p.length + (1 if not p.ambiguous else 0) + (2 if any(len(t.text) > 3 for t in tokens[p.start : p.start + p.length]) else 0)
        for t in tokens:
            if t.type == TokenType.WORD and d.longest_suffix(t.text, lang):
                score[lang] += 1
    if not score:
        return ("en",) if scripts in ([], ["Latin"]) or set(scripts) <= {"Latin"} else tuple(SCRIPT_LANGUAGES.get(scripts[0], ["en"])[:1])
    top = max(score.values())
    return tuple(lang for lang, n in score.most_common() if 2 * n >= top)


def disambiguate(text: str, candidates: list[tuple[str, bool]], dictionary: lx.Dictionary | None = None) -> str:
    """The language of a text among candidates (language, is default), by script and by street
    words; ``xxx`` when several fit, ``unk`` when none does."""
    d = dictionary or lx.default_dictionary()
    scripts = {s for s, _, _ in script_spans(text)} - {"Common"}
    possible = {lang for s in scripts for lang in SCRIPT_LANGUAGES.get(s, ())}
    inside = [(lang, default) for lang, default in candidates if not possible or lang in possible]
    if len(scripts) == 1 and len(possible) == 1:
        return next(iter(possible))
    if not inside:
        return UNKNOWN
    tokens = tokenize(normalize_string(text))
    known: dict[str, set[str]] = {}
    for lang, _ in inside:
        if lang in d.exact:
            hits = {tuple(t.text for t in tokens[p.start : p.start + p.length]) for p in d.search(tokens, lang) if any("street_types" in e.kinds or "directionals" in e.kinds for e in p.expansions)}
            hits |= {(x[0],) for t in tokens if (x := d.longest_suffix(t.text, lang))}
            if hits:
                known[lang] = hits
    if len(known) == 1:
        return next(iter(known))
    if len(known) > 1:
        defaults = [lang for lang, default in inside if default and lang in known]
        return defaults[0] if len(defaults) == 1 else AMBIGUOUS
    if len(inside) == 1 and inside[0][1]:
        return inside[0][0]
    return UNKNOWN
