"""Expansion of an address string into its normal forms, and into its distinguishing root.

Each language is expanded apart. Number words and scripts are resolved on the whole string; then
tokens get alternatives (hyphens, joined letters and digits, affixes), the combinations are tokenised
again, and dictionary phrases are replaced by what they may stand for. In root mode, phrases that
only classify (street types, directionals at the ends, unit words) are left out by the rules of
``_drops``. More than ``LIMIT`` combinations give the tokenised string alone.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, replace
from functools import lru_cache
from itertools import product

from . import lexicon as lx
from . import text as tx
from .lexer import Token, TokenType, is_ideographic, is_punctuation, is_special, is_word, tokenize
from .numex import ordinal_suffix_length, replace_numeric_expressions

LIMIT = 100


@dataclass(frozen=True)
class Options:
    """The switches of normalisation; a frozen value, captured once per job."""

    languages: tuple[str, ...] = ()
    components: int = lx.DEFAULT_COMPONENTS
    latin_ascii: bool = True
    transliterate: bool = True
    strip_accents: bool = True
    decompose: bool = True
    lowercase: bool = True
    trim_string: bool = True
    drop_parentheticals: bool = True
    replace_numeric_hyphens: bool = False
    delete_numeric_hyphens: bool = False
    split_alpha_from_numeric: bool = True
    replace_word_hyphens: bool = True
    delete_word_hyphens: bool = True
    delete_final_periods: bool = True
    delete_acronym_periods: bool = True
    drop_english_possessives: bool = True
    delete_apostrophes: bool = True
    expand_numex: bool = True
    roman_numerals: bool = True

    @classmethod
    def off(cls, **kw) -> Options:
        """Every switch off, but for ``kw``."""
        names = [f for f in cls.__dataclass_fields__ if f not in ("languages", "components")]
        return replace(cls(**dict.fromkeys(names, False)), **kw)


def _string_options(o: Options) -> int:
    pairs = ((o.latin_ascii, tx.LATIN_ASCII), (o.decompose, tx.DECOMPOSE), (o.strip_accents, tx.STRIP_ACCENTS), (o.lowercase, tx.LOWERCASE), (o.trim_string, tx.TRIM))
    return sum(bit for on, bit in pairs if on)


def _token_options(o: Options) -> int:
    pairs = ((o.delete_final_periods, tx.K_FINAL_PERIOD), (o.delete_acronym_periods, tx.K_ACRONYM_PERIODS), (o.drop_english_possessives, tx.K_POSSESSIVES), (o.delete_apostrophes, tx.K_APOSTROPHE))
    return sum(bit for on, bit in pairs if on)


def _token_forms(t: Token, o: Options, language: str, dictionary: lx.Dictionary) -> list[str]:
    if is_special(t.type):
        return [t.text]
    if any(dictionary.get(t.text, s) for s in dictionary.spaces([language])) and t.type != TokenType.NUMERIC:
        return [t.text]  # a phrase as it stands, such as one with a period or a slash
    base = _token_options(o)
    wants = [base]
    if "-" in t.text:
        numeric = t.type == TokenType.NUMERIC
        if o.replace_numeric_hyphens if numeric else o.replace_word_hyphens:
            wants.append(base | tx.K_REPLACE_HYPHENS | (tx.K_NUMERIC_HYPHENS if numeric else 0))
        if o.delete_numeric_hyphens if numeric else o.delete_word_hyphens:
            wants.append(base | tx.K_DELETE_HYPHENS)
    if t.type == TokenType.NUMERIC and o.split_alpha_from_numeric and not ordinal_suffix_length(t.text, language):
        wants += [w | tx.K_SPLIT_ALPHA for w in wants]
    forms = [tx.normalize_token(t.text, t.type, w) for w in wants]
    if t.type == TokenType.NUMERIC and (n := ordinal_suffix_length(t.text, language)):
        forms.append(t.text[:-n])
    if is_word(t.type) or t.type == TokenType.NUMERIC:
        if o.split_alpha_from_numeric and t.type == TokenType.NUMERIC and t.text[:1].isalpha():
            forms.append(tx.normalize_token(t.text, TokenType.NUMERIC, base | tx.K_SPLIT_ALPHA))
        for space in dictionary.spaces([language]):
            forms += _affix_forms(forms[0], dictionary, space)
    return list(dict.fromkeys(f for f in forms if f))


@lru_cache(64)
def _memo(o: Options, language: str, dictionary: lx.Dictionary) -> dict:
    """Forms of tokens seen before, per options, language and dictionary."""
    return {}


def _forms_of(t: Token, o: Options, language: str, dictionary: lx.Dictionary, memo: dict) -> list[str]:
    key = (t.text, t.type)
    if key not in memo:
        if len(memo) > 200_000:
            memo.clear()
        memo[key] = _token_forms(t, o, language, dictionary) or [""]
    return memo[key]


@lru_cache(64)
def _all_off(o: Options) -> bool:
    return o == Options.off(languages=o.languages, components=o.components)


def _affix_forms(word: str, d: lx.Dictionary, space: str) -> list[str]:
    """The word with a known suffix or prefix replaced by its canonical form, apart if separable."""
    out: list[str] = []
    for found, at_end in ((d.longest_suffix(word, space), True), (d.longest_prefix(word, space), False)):
        if not found:
            continue
        affix, apart = found
        stem = word[: -len(affix)] if at_end else word[len(affix) :]
        if len(stem) < 2:
            continue
        for e in d.get(affix, space) or ():
            if not set(e.kinds).intersection(lx.AFFIX_KINDS):
                continue
            joined = (stem, e.canonical) if at_end else (e.canonical, stem)
            out.append("".join(joined))
            if apart:
                out.append(" ".join(joined))
    return out


def _flags(tokens: list[Token], phrases: list[lx.Phrase], components: int) -> tuple[bool, bool, bool, int]:
    inside = lx.memberships(phrases, len(tokens))
    loose = [t for t, m in zip(tokens, inside, strict=True) if m < 0 and not is_punctuation(t.type) and t.type != TokenType.WHITESPACE]
    # phrases without a role for these components, such as a person's name, tell apart like plain words
    plain = any(not (p.role("ignorable") | p.role("valid") | p.role("root") | p.role("edge")) & components for p in phrases)
    canonical = any(not p.ambiguous and any(e.is_canonical for e in p.expansions) for p in phrases)
    roots = sum(1 for p in phrases if p.role("root") & components)
    return bool(loose) or plain, plain or any(is_word(t.type) for t in loose), canonical, roots


def _edge_skip(i: int, phrases: list[lx.Phrase], n: int, loose: bool, components: int) -> bool | None:
    """Whether a phrase at an end is left out there; None if the rule doesn't apply to it."""
    p = phrases[i]
    if not p.role("edge") & components or not (p.start == 0 or p.start + p.length == n):
        return None
    if loose:
        return True
    others = [q for q in phrases if q.start != p.start]
    if not others:
        return False
    far = others[-1] if p.start == 0 else others[0]
    if len(others) == 1 and far.role("ignorable") & components and not far.role("edge") & components:
        return False
    return True


def _drops(e: lx.Expansion, p: lx.Phrase, components: int, loose: bool, words: bool, canonical: bool, roots: int, emitted: bool) -> bool:
    """Root rules for one reading, the first that applies; see the package's notes on roots."""
    role = lambda f: lx._or(e.kinds, f) & components
    is_root = bool(p.role("root") & components)
    elsewhere = roots > is_root
    ignorable, valid = role("ignorable"), role("valid")
    numeric = bool(components & lx.NUMERIC_COMPONENTS)
    if ignorable and p.role("specifier") & components:
        return False
    if ignorable and not p.ambiguous:
        return loose or (elsewhere and not is_root) or emitted
    if p.ambiguous and (words or numeric or canonical or roots):
        unclear = any("ambiguous_expansions" in x.kinds and len(x.kinds) == 1 for x in p.expansions)
        has_ignorable = bool(p.role("ignorable") & components)
        return bool(ignorable) and not (elsewhere and not is_root) or ((words or (numeric and loose)) and has_ignorable and not unclear)
    if not valid and not p.ambiguous and not is_root:
        return bool((p.role("ignorable") | p.role("valid")) & components)
    return False


def _phrase_forms(tokens: list[Token], language: str, o: Options, root: bool, dictionary: lx.Dictionary) -> list[str]:
    components = o.components | lx.ANY
    tokens = [t for t in tokens if t.type != TokenType.WHITESPACE]
    phrases: list[lx.Phrase] = []
    for space in dictionary.spaces([language]):
        taken = lx.memberships(phrases, len(tokens))
        phrases += [p for p in dictionary.search(tokens, space) if all(taken[i] < 0 for i in range(p.start, p.start + p.length))]
    phrases = sorted(phrases, key=lambda p: p.start)
    phrases = [p for p in phrases if p.components & components or p.role("valid") & components or p.role("ignorable") & components]
    loose, words, canonical, roots = _flags(tokens, phrases, components)
    at = {p.start: i for i, p in enumerate(phrases)}
    slots: list[list[str]] = []
    emitted = False
    i = 0
    while i < len(tokens):
        if i not in at:
            if not is_punctuation(tokens[i].type) or tokens[i].type == TokenType.POUND and not root:
                close = i and slots and is_ideographic(tokens[i].type) and is_ideographic(tokens[i - 1].type) and tokens[i - 1].offset + len(tokens[i - 1].text) == tokens[i].offset
                if close and i - 1 not in at and len(slots[-1]) == 1:
                    slots[-1][0] += tokens[i].text  # written together in the source
                else:
                    slots.append([tokens[i].text])
                emitted = True
            i += 1
            continue
        p = phrases[at[i]]
        original = " ".join(t.text for t in tokens[p.start : p.start + p.length])
        i = p.start + p.length
        readings = [e for e in p.expansions if (e.components | lx._or(e.kinds, "valid") | lx._or(e.kinds, "ignorable")) & components] or list(p.expansions)
        gone = False
        if root:
            edge = _edge_skip(at[p.start], phrases, len(tokens), loose, components)
            if edge is True:
                continue
            if edge is None:
                kept = [e for e in readings if not _drops(e, p, components, loose, words, canonical, roots, emitted)]
                gone = len(kept) < len(readings) and roots > bool(p.role("root") & components)
                readings = kept
            if not readings:
                continue
        forms = [e.canonical for e in readings]
        if gone:  # one reading of several is left out: the form without the phrase is possible too
            forms.append("")
        if p.ambiguous or any(e.is_canonical for e in readings):
            forms.append(original)
        slots.append(list(dict.fromkeys(forms)))
        emitted = True
    return _enumerate(slots, " ".join(t.text for t in tokens))


def _enumerate(slots: list[list[str]], fallback: str) -> list[str]:
    total = 1
    for s in slots:
        total *= len(s)
        if total >= LIMIT:
            return [fallback]
    return [" ".join(x for x in combo if x) for combo in product(*slots)]


def _expand(text: str, o: Options, languages: Iterable[str], root: bool, dictionary: lx.Dictionary) -> list[str]:
    out: dict[str, None] = {}
    for language in languages:
        forms = tx.normalize_string_languages(text, _string_options(o), (language,), o.transliterate)
        if o.expand_numex:
            forms = list(dict.fromkeys(replace_numeric_expressions(f, language) for f in forms))
        memo = _memo(o, language, dictionary)
        for form in forms:
            tokens = tokenize(form, whitespace=True)
            slots: list[list[str]] = []
            for t in tokens:
                slots.append([" "] if t.type in (TokenType.WHITESPACE, TokenType.NEWLINE) else _forms_of(t, o, language, dictionary, memo))
            total = 1
            for s in slots:
                total *= len(s)
            candidates = ["".join(c) for c in product(*slots)] if total < LIMIT else ["".join(s[0] for s in slots)]
            for c in dict.fromkeys(candidates):
                for s in _phrase_forms(tokenize(c, whitespace=True), language, o, root, dictionary):
                    s = " ".join(s.split()) if o.trim_string else s
                    if s:
                        out[s] = None
                        if o.roman_numerals:
                            out[replace_numeric_expressions(s, "la")] = None
    return list(out)


def expand_address(text: str | None, options: Options = Options(), root: bool = False, dictionary: lx.Dictionary | None = None) -> list[str]:
    """All expansions, in order of discovery."""
    if not text or not text.strip():
        return []
    dictionary = dictionary or lx.default_dictionary()
    languages = options.languages
    if not languages:
        from .language import guess_languages

        languages = guess_languages(text, dictionary)
    if _all_off(options):
        return [text]
    return _expand(text, options, languages, root, dictionary) or ([] if root else [text])


def expand_address_root(text: str | None, options: Options = Options(), dictionary: lx.Dictionary | None = None) -> list[str]:
    return expand_address(text, options, True, dictionary)


def equivalent(a: str, b: str, language: str, dictionary: lx.Dictionary | None = None) -> bool:
    """Token by token equal, or of a shared canonical form."""
    d = dictionary or lx.default_dictionary()
    x, y = ([t.text for t in tokenize(tx.normalize_string(s))] for s in (a, b))
    if len(x) != len(y):
        return False
    canon = lambda w: {e.canonical for s in d.spaces([language]) for e in d.get(w.rstrip("."), s) or ()} | {w}
    return all(p == q or canon(p) & canon(q) for p, q in zip(x, y, strict=True))
