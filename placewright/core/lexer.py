"""Longest-match tokenizer. Types are the numbers of ``TokenType``; offsets are code points."""

from __future__ import annotations

import re
from enum import IntEnum
from itertools import accumulate
from typing import NamedTuple

import regex


class TokenType(IntEnum):
    END = 0
    WORD = 1
    ABBREVIATION = 2
    IDEOGRAPHIC_CHAR = 3
    HANGUL_SYLLABLE = 4
    ACRONYM = 5
    PHRASE = 10
    EMAIL = 20
    URL = 21
    US_PHONE = 22
    INTL_PHONE = 23
    NUMERIC = 50
    ORDINAL = 51
    ROMAN_NUMERAL = 52
    IDEOGRAPHIC_NUMBER = 53
    PERIOD = 100
    EXCLAMATION = 101
    QUESTION_MARK = 102
    COMMA = 103
    COLON = 104
    SEMICOLON = 105
    PLUS = 106
    AMPERSAND = 107
    AT_SIGN = 108
    POUND = 109
    ELLIPSIS = 110
    DASH = 111
    BREAKING_DASH = 112
    HYPHEN = 113
    PUNCT_OPEN = 114
    PUNCT_CLOSE = 115
    DOUBLE_QUOTE = 119
    SINGLE_QUOTE = 120
    OPEN_QUOTE = 121
    CLOSE_QUOTE = 122
    SLASH = 124
    BACKSLASH = 125
    GREATER_THAN = 126
    LESS_THAN = 127
    OTHER = 200
    WHITESPACE = 300
    NEWLINE = 301
    INVALID_CHAR = 500


class Token(NamedTuple):
    text: str
    offset: int
    type: int


T = TokenType
WORD_TYPES = frozenset((T.WORD, T.ABBREVIATION, T.ACRONYM, T.IDEOGRAPHIC_CHAR, T.HANGUL_SYLLABLE))
NUMERIC_TYPES = frozenset((T.NUMERIC, T.ORDINAL, T.ROMAN_NUMERAL, T.IDEOGRAPHIC_NUMBER))
SPECIAL_TYPES = frozenset((T.EMAIL, T.URL, T.US_PHONE, T.INTL_PHONE))


def is_word(kind: int) -> bool:
    return kind in WORD_TYPES


def is_ideographic(kind: int) -> bool:
    return kind in (T.IDEOGRAPHIC_CHAR, T.HANGUL_SYLLABLE, T.IDEOGRAPHIC_NUMBER)


def is_numeric(kind: int) -> bool:
    return kind in NUMERIC_TYPES


def is_special(kind: int) -> bool:
    return kind in SPECIAL_TYPES


def is_punctuation(kind: int) -> bool:
    return T.PERIOD <= kind < T.OTHER


_IDEO = r"\p{Han}\p{Hiragana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}\p{Tai_Le}"
_L = rf"[\p{{L}}--[{_IDEO}\p{{Katakana}}\p{{Hangul}}]]"
_LATINISH = r"[\p{Lu}\p{Ll}\p{Lt}]"
_MID_LETTER = r"[:·˗·״‧︓﹕：]"
_MID_NUM = r"[,;;։،؍٬߸⁄︐︔﹐﹔，；]"
_MID_BOTH = r"[.‘’․﹒＇．]"
_D = r"[\p{Nd}]"
_EXT = r"[_‿⁀⁔︳︴﹍﹎﹏＿]"
_DASH1 = r"[\-֊־᐀᠆‐‑‒–−⸗⸚︲﹣－]"
_MARK = r"[\p{M}\p{Pc}\p{Sc}\p{Sk}\p{Sm}\p{So}\p{Nd}]"
_WC = rf"(?:{_L}|{_MARK})"
_NUM_OPEN = rf"(?:{_D}|{_L}|{_DASH1}|{_MID_BOTH}|')"
#: Runs of word characters with a letter, each read in one way only: a long run costs no more than its length.
_ANY = rf"(?:(?:{_MARK}*{_L}{_WC}*{_DASH1})*{_MARK}*{_L}{_WC}*)"
_ABBR = rf"(?:{_WC}+\.)+{_WC}*"
_WORD = (
    rf"(?:{_L}+(?:(?:{_MID_LETTER}|{_DASH1}|{_MID_BOTH}|'){_L}+)+|{_L}+(?:(?:{_MID_LETTER}|{_MID_BOTH}){_L}+')|(?:\p{{Hebrew}}+')+"
    rf"|(?:\p{{Hebrew}}+\")+\p{{Hebrew}}*|(?:{_L}|{_D}|{_EXT})+{_EXT}(?:{_L}|{_D}|{_EXT})*|{_L}+)"
)
_COUNTRY = "9[679][0-9]|8[035789][0-9]|6[789][0-9]|5[09][0-9]|420-9|3[578][0-9]|2[1-689][0-9]|9[0-58]|8[1246]|6[0-6]|5[1-8]|4[013-9]|3[0-469]|2[07]|7|1"

#: In order of preference at equal length.
_RULES: list[tuple[int, regex.Pattern]] = [
    (int(kind), regex.compile(pattern, regex.V1 | flags))
    for kind, pattern, flags in (
        (T.INVALID_CHAR, r"[\p{Cc}--\s]|[\p{Co}\p{Cs}]|[\p{Cf}--[‌‍­]]", 0),
        (T.WHITESPACE, r"[^\S\n\r]+", 0),
        (T.EMAIL, r"[\w.%+\-&&[\x00-\x7F]]+@(?:[0-9A-Za-z]+\.)+[0-9A-Za-z]{2,3}", regex.POSIX),
        (T.URL, r"https?:(?:///?|/|[%0-9A-Za-z])[^\s\0<>{}\[\]]+", 0),
        (T.ELLIPSIS, r"\.{2,}|…", 0),
        (T.US_PHONE, r"(?:\+?1[\-. ]?)?\(?[2-9][0-8][0-9]\)?[\-. ]?[2-9][0-9]{2}[\-. ]?[0-9]{4}", 0),
        (T.INTL_PHONE, rf"\+(?:{_COUNTRY})\s*(?:[()./\- ]?[0-9]){{9}}[0-9]{{1,2}}", regex.POSIX),
        (T.ACRONYM, rf"(?:{_L}\.){{2,}}{_L}?", 0),
        (T.ABBREVIATION, rf"(?:{_L}+\.)+{_L}*", 0),
        (T.ABBREVIATION, rf"(?:(?:{_ABBR}|{_ANY})-)+{_ABBR}|(?:{_ABBR}-)(?:(?:{_ABBR}|{_ANY})-)*(?:{_ABBR}|{_ANY})", 0),
        (T.ABBREVIATION, rf"{_WORD}\.", 0),
        (T.NUMERIC, rf"{_DASH1}?(?:[\p{{N}}]+(?:{_MID_NUM}|{_MID_BOTH}))*[\p{{Nd}}\p{{No}}--[²³¹¼-¾⁰-₉]]+", 0),
        (T.NUMERIC, rf"(?:{_DASH1}|(?:(?:{_D}|{_L}){_NUM_OPEN}*)?){_D}+(?:{_NUM_OPEN}*(?:{_D}|{_L}))?", 0),
        (T.WORD, rf"'?{_LATINISH}+'{_LATINISH}+'?", 0),
        (T.HANGUL_SYLLABLE, r"[ᄀ-ᅟꥠ-ꥼ]*[가-힣][ᆨ-ᇿퟋ-ퟻ]*|[ᄀ-ᅟꥠ-ꥼ]+[ᅠ-ᆧힰ-ퟆ]*[ᆨ-ᇿퟋ-ퟻ]*|\p{Hangul}", 0),
        (T.IDEOGRAPHIC_CHAR, rf"[{_IDEO}]", 0),
        (T.IDEOGRAPHIC_NUMBER, r"[²³¹¼-¾⁰⁴-⁹₀-₉⅐-⅟↉①-⒛⓪-⓿❶-➓㆒-㆕㈠-㈩㉑-㉟㊀-㊉㊱-㊿]", 0),
        (T.WORD, _WORD, 0),
        (T.WORD, r"[\p{Katakana}ー゠・]+", 0),
        (T.WORD, _ANY, 0),
        (T.NEWLINE, r"\r\n|[\n\r]", 0),
        (T.BREAKING_DASH, r"-{2,}|[—⸺⸻︱﹘―⁓]", 0),
        (T.DASH, r"[֊־᐀᠆‐‑‒–−⸗⸚︲﹣－]", 0),
    )
]
_SINGLE = {
    ".": T.PERIOD, "!": T.EXCLAMATION, "?": T.QUESTION_MARK, "-": T.HYPHEN, ",": T.COMMA, ":": T.COLON, ";": T.SEMICOLON, "/": T.SLASH, "\\": T.BACKSLASH,
    '"': T.DOUBLE_QUOTE, "'": T.SINGLE_QUOTE, "&": T.AMPERSAND, ">": T.GREATER_THAN, "<": T.LESS_THAN, "@": T.AT_SIGN, "+": T.PLUS, "#": T.POUND,
}
#: The bulk of any text: a word, number, period-ended word or space that stands before what can't make it longer, and
#: signs that no longer token begins with, as they stand. Groups are numbered by kind.
_LATIN1 = "A-Za-zÀ-ÖØ-öø-ÿ"
_FAST = re.compile(
    rf"([{_LATIN1}]+)(?=[ \n,;!?)*&#]|\Z|%+[ \n])|([ ]+)(?=[{_LATIN1}!-~\n]|\Z)|([{_LATIN1}]+\.)(?=[ \n]|\Z)|([0-9]+)(?=[ ]|\Z|,[ ])|(,)|(\n)|(;)"
    r"|([!*&#?]|[|$=](?=[ \n])|%(?=%*[ \n]))"
)
_FAST = _FAST.match
#: Words with one space after each, most of any prose, which are split at once; what follows is as in the rules above.
_WORD_RUN = re.compile(rf"(?:[{_LATIN1}]++ (?=[{_LATIN1}0-9,;]))++").match
_WORD_AND_SPACE = [int(T.WORD), int(T.WHITESPACE)]
_FAST_KIND = tuple(map(int, (0, T.WORD, T.WHITESPACE, T.ABBREVIATION, T.NUMERIC, T.COMMA, T.NEWLINE, T.SEMICOLON, T.OTHER)))
_UNSEEN = frozenset((int(T.INVALID_CHAR),))
_UNSEEN_OR_WHITE = _UNSEEN | {int(T.WHITESPACE), int(T.NEWLINE)}
_PHONE_LIKE = regex.compile(r"\+?1?[\-. ]?\(?[2-9][0-8][0-9]\)?[\-. ]?[2-9][0-9]{2}[\-. ]?[0-9]{4}")


def cuts(text: str) -> tuple[list[int], list[int]]:
    """(bounds, kinds) of every token, white space and invalid characters included: token i goes from
    bound i to the next. ``text`` holds no NUL."""
    bounds, kinds = [0], []
    at, n = 0, len(text)
    while at < n:
        run = _WORD_RUN(text, at)
        if run is not None:
            spaces = [*accumulate(map(len, text[at : run.end() - 1].split(" ")), lambda end, size: end + size + 1, initial=at)][1:]
            both = spaces * 2
            both[::2], both[1::2] = [x - 1 for x in spaces], spaces
            bounds += both
            kinds += _WORD_AND_SPACE * len(spaces)
            at = run.end()
        m = _FAST(text, at)
        if m is not None:
            kind = _FAST_KIND[m.lastindex] if m.lastindex < 8 else int(_SINGLE.get(m[8], T.OTHER))
            if kind != T.NUMERIC or not _PHONE_LIKE.match(text, at):
                at = m.end()
                bounds.append(at)
                kinds.append(kind)
                continue
        best, stop = 0, at
        for kind, rule in _RULES:
            m = rule.match(text, at)
            if m is not None and m.end() > stop:
                best, stop = kind, m.end()
        if stop == at:
            stop = at + 1
            c = text[at]
            found = _SINGLE.get(c)
            if found is None:
                found = T.PUNCT_OPEN if regex.match(r"\p{Ps}", c) else T.PUNCT_CLOSE if regex.match(r"\p{Pe}", c) else T.OPEN_QUOTE if regex.match(r"\p{Pi}", c) else T.CLOSE_QUOTE if regex.match(r"\p{Pf}", c) else T.OTHER
            best = int(found)
        at = stop
        bounds.append(at)
        kinds.append(best)
    return bounds, kinds


def before_nul(text: str) -> str:
    end = text.find("\0")
    return text if end < 0 else text[:end]


def scan(text: str) -> list[Token]:
    """Every token, white space and invalid characters included; ends at a NUL."""
    text = before_nul(text)
    bounds, kinds = cuts(text)
    return [Token(text[a:b], a, k) for a, b, k in zip(bounds, bounds[1:], kinds)]


def tokenize(text: str | None, whitespace: bool = False) -> list[Token]:
    """Tokens without invalid characters, and without white space unless asked for."""
    return [Token(*t) for t in zip(*columns(text, whitespace))]


def left_out(whitespace: bool = False) -> frozenset[int]:
    """Types that aren't tokens."""
    return _UNSEEN if whitespace else _UNSEEN_OR_WHITE


def columns(text: str | None, whitespace: bool = False) -> tuple[list[str], list[int], list[int]]:
    """``tokenize`` as columns: texts, offsets and types."""
    if not text:
        return [], [], []
    text = before_nul(text)
    bounds, kinds = cuts(text)
    out = left_out(whitespace)
    keep = [i for i, k in enumerate(kinds) if k not in out]
    offsets = [bounds[i] for i in keep]
    return [text[a : bounds[i + 1]] for a, i in zip(offsets, keep)], offsets, [kinds[i] for i in keep]


def remove_parens(text: str) -> str:
    """The text without what stands in brackets; a closing bracket without an opening one stays out of the count."""
    depth, out = 0, []
    for t in scan(text):
        if t.type == T.PUNCT_OPEN:
            depth += 1
        elif t.type == T.PUNCT_CLOSE:
            depth = max(0, depth - 1)
        elif depth == 0:
            out.append(t.text)
    return "".join(out).strip()
