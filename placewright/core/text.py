"""String and token normalisation, scripts and transliteration."""

from __future__ import annotations

import html
import unicodedata
from functools import lru_cache
from itertools import product

import regex

from .lexer import Token, TokenType, tokenize

# string options
LATIN_ASCII, DECOMPOSE, COMPOSE, STRIP_ACCENTS, LOWERCASE, TRIM, REPLACE_HYPHENS, SIMPLE_LATIN_ASCII, REPLACE_NUMEX = (1 << i for i in range(9))
STRING_DEFAULT = LATIN_ASCII | COMPOSE | STRIP_ACCENTS | LOWERCASE | TRIM
# token options
K_REPLACE_HYPHENS, K_DELETE_HYPHENS, K_FINAL_PERIOD, K_ACRONYM_PERIODS, K_POSSESSIVES, K_APOSTROPHE, K_SPLIT_ALPHA, K_DIGITS, K_TOKEN_LETTERS, K_NUMERIC_HYPHENS = (1 << i for i in range(10))
TOKEN_DEFAULT = K_REPLACE_HYPHENS | K_FINAL_PERIOD | K_ACRONYM_PERIODS | K_POSSESSIVES | K_APOSTROPHE

_ASCII = regex.compile(r"[\x00-\x7f]*\Z")
_LATIN = {
    "ß": "ss", "ẞ": "SS", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "ø": "o", "Ø": "O", "đ": "d", "Đ": "D", "ð": "d", "Ð": "D", "þ": "th", "Þ": "TH", "ł": "l", "Ł": "L",
    "ħ": "h", "Ħ": "H", "ı": "i", "ĸ": "q", "ŋ": "n", "Ŋ": "N", "ŧ": "t", "Ŧ": "T", "ſ": "s", "ƒ": "f", "’": "'", "‘": "'", "‛": "'", "“": '"', "”": '"', "„": '"', "«": '"', "»": '"',
    "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "―": "-", "−": "-", "…": "...", "№": "No", "ª": "a", "º": "o", "×": "x", "÷": "/", "©": "(C)", "®": "(R)",
}
_SIMPLE = {k: v for k, v in _LATIN.items() if not k.isalpha()}
_FRACTION = {"½": "1/2", "¼": "1/4", "¾": "3/4", "⅓": "1/3", "⅔": "2/3"}

_CYRILLIC = dict(zip("абвгдезийклмнопрстуфхцыэіў", "a b v g d e z i j k l m n o p r s t u f h c y e i u".split(), strict=True)) | {
    "ё": "e", "ж": "z", "ч": "c", "ш": "s", "щ": "sc", "ъ": "", "ь": "", "ю": "u", "я": "a", "ї": "i", "є": "e", "ґ": "g", "ђ": "d", "ј": "j", "љ": "l", "њ": "n", "ћ": "c", "џ": "d", "ѓ": "g", "ќ": "k", "ѕ": "z",
}
_RUSSIAN = _CYRILLIC | {"й": "y", "х": "kh", "ц": "ts", "ж": "zh", "ч": "ch", "ш": "sh", "щ": "shch", "ю": "yu", "я": "ya", "ё": "ë", "ъ": "ʺ", "ь": "ʹ"}
_GREEK = dict(zip("αβγδεζηθικλμνξοπρστυφχψως", "a b g d e z e th i k l m n x o p r s t y ph ch ps o s".split(), strict=True))
_HEBREW = dict(zip("אבגדהוזחטיכלמנסעפצקרשתךםןףץ", "ʼ b g d h w z ẖ t y k l m n s ʿ p z q r š t k m n p z".split(), strict=True))
_ARABIC = dict(zip("ابتثجحخدذرزسشصضطظعغفقكلمنهويةىءأإآ", "a b t th j h kh d dh r z s sh s d t z ʿ gh f q k l m n h w y t a ʼ a i a".split(), strict=True))
_KANA_ROWS = {
    "あいうえお": "a i u e o", "かきくけこ": "ka ki ku ke ko", "がぎぐげご": "ga gi gu ge go", "さしすせそ": "sa shi su se so", "ざじずぜぞ": "za ji zu ze zo", "たちつてと": "ta chi tsu te to",
    "だぢづでど": "da ji zu de do", "なにぬねの": "na ni nu ne no", "はひふへほ": "ha hi fu he ho", "ばびぶべぼ": "ba bi bu be bo", "ぱぴぷぺぽ": "pa pi pu pe po", "まみむめも": "ma mi mu me mo",
    "やゆよ": "ya yu yo", "らりるれろ": "ra ri ru re ro", "わゐゑをん": "wa i e wo n", "ゃゅょ": "ya yu yo", "ぁぃぅぇぉ": "a i u e o", "ゔ": "vu",
}
_KANA = {k: v for row, values in _KANA_ROWS.items() for k, v in zip(row, values.split(), strict=True)}


def _kana(text: str) -> str:
    hira = "".join(chr(ord(c) - 0x60) if "ァ" <= c <= "ヴ" else c for c in text)
    out: list[str] = []
    double = False
    for c in hira:
        if c == "っ":
            double = True
            continue
        if c == "ー":
            out.append(out[-1][-1:] if out else "")
            continue
        r = _KANA.get(c)
        if r is None:
            out.append(c)
            double = False
            continue
        if c in "ゃゅょ" and out and out[-1].endswith("i") and len(out[-1]) > 1:
            stem = out[-1][:-1]
            out[-1] = stem + (r[1:] if stem in ("sh", "ch", "j") else r)
        else:
            out.append(r)
        if double:
            out[-1] = ("t" if out[-1].startswith("ch") else out[-1][0]) + out[-1]
            double = False
    return "".join(out)


def _mapped(table: dict[str, str]):
    def run(text: str) -> str:
        out = []
        for c in unicodedata.normalize("NFC", text):
            r = table.get(c)
            if r is None and (low := c.lower()) != c and low in table:
                r = table[low].capitalize()
            out.append(c if r is None else r)
        return "".join(out)

    return run


def _greek(text: str) -> str:
    out = []
    for c in unicodedata.normalize("NFD", text).replace("ου", "ou").replace("Ου", "Ou"):
        r = _GREEK.get(c.lower())
        out.append(c if r is None else r if c.islower() else r.capitalize())
    return unicodedata.normalize("NFC", "".join(out))


def strip_accents(text: str) -> str:
    return unicodedata.normalize("NFC", "".join(c for c in unicodedata.normalize("NFD", text) if unicodedata.category(c) != "Mn"))


def latin_ascii(text: str) -> str:
    """Letters of the Latin script in ASCII, character references decoded."""
    if "&" in text:
        text = html.unescape(text)
    if _ASCII.match(text):
        return text
    text = "".join(_LATIN.get(c, c) for c in unicodedata.normalize("NFKD", "".join(f" {_FRACTION[c]}" if c in _FRACTION else c for c in text)))
    return unicodedata.normalize("NFC", "".join(c for c in text if unicodedata.category(c) != "Mn"))


def latin_ascii_simple(text: str) -> str:
    """Punctuation in ASCII and references decoded; letters keep their marks."""
    if "&" in text:
        text = html.unescape(text)
    return "".join(_SIMPLE.get(c, c) for c in text)


TRANSLITERATORS = {
    "latin-ascii": latin_ascii,
    "latin-ascii-simple": latin_ascii_simple,
    "cyrillic-latin": _mapped(_CYRILLIC),
    "russian-latin-bgn": _mapped(_RUSSIAN),
    "ukrainian-latin-bgn": _mapped(_RUSSIAN | {"г": "h", "и": "y", "і": "i", "ї": "yi", "є": "ye"}),
    "bulgarian-latin-bgn": _mapped(_RUSSIAN | {"щ": "sht", "ъ": "ŭ"}),
    "serbian-latin-bgn": _mapped(_CYRILLIC | {"ж": "ž", "ч": "č", "ш": "š", "ц": "c", "х": "h", "ђ": "đ", "љ": "lj", "њ": "nj", "ћ": "ć", "џ": "dž"}),
    "greek-latin": _greek,
    "greek-latin-bgn": _greek,
    "hebrew-latin": _mapped(_HEBREW),
    "arabic-latin": _mapped(_ARABIC),
    "katakana-latin": _kana,
    "hiragana-latin": _kana,
    "german-ascii": lambda s: latin_ascii(s.translate(str.maketrans({"ä": "ae", "ö": "oe", "ü": "ue", "Ä": "Ae", "Ö": "Oe", "Ü": "Ue"}))),
    "scandinavian-ascii": lambda s: latin_ascii(s.translate(str.maketrans({"å": "aa", "Å": "Aa", "ø": "oe", "Ø": "Oe", "ä": "ae", "ö": "oe", "Ä": "Ae", "Ö": "Oe"}))),
}
#: (script, language or "") to transliterators; a language's own row replaces the script's.
SCRIPT_TRANSLITERATORS: dict[tuple[str, str], list[str]] = {
    ("Latin", ""): ["latin-ascii"], ("Latin", "de"): ["german-ascii"], ("Latin", "da"): ["scandinavian-ascii"], ("Latin", "nb"): ["scandinavian-ascii"], ("Latin", "sv"): ["scandinavian-ascii"], ("Latin", "et"): ["german-ascii"],
    ("Cyrillic", ""): ["cyrillic-latin"], ("Cyrillic", "ru"): ["russian-latin-bgn", "cyrillic-latin"], ("Cyrillic", "uk"): ["ukrainian-latin-bgn"], ("Cyrillic", "bg"): ["bulgarian-latin-bgn"], ("Cyrillic", "sr"): ["serbian-latin-bgn"],
    ("Greek", ""): ["greek-latin", "greek-latin-bgn"], ("Hebrew", ""): ["hebrew-latin"], ("Arabic", ""): ["arabic-latin"], ("Katakana", ""): ["katakana-latin"], ("Hiragana", ""): ["hiragana-latin"],
}
SCRIPT_LANGUAGES = {
    "Greek": ["el"], "Hebrew": ["he", "yi"], "Thai": ["th"], "Lao": ["lo"], "Khmer": ["km"], "Georgian": ["ka"], "Armenian": ["hy"], "Hangul": ["ko"], "Katakana": ["ja"], "Hiragana": ["ja"],
    "Han": ["zh", "ja", "ko"], "Arabic": ["ar", "fa", "ur", "ps"], "Cyrillic": ["ru", "uk", "bg", "sr", "be", "mk"], "Devanagari": ["hi", "mr", "ne"], "Bengali": ["bn"], "Tamil": ["ta"], "Telugu": ["te"],
    "Latin": ["en", "fr", "de", "es", "it", "pt", "nl", "da", "sv", "nb", "fi", "pl", "cs", "hu", "ro", "tr", "et", "lv", "lt", "hr", "ca", "eu", "gl", "la"],
}
_SCRIPTS = [(s, regex.compile(rf"\p{{Script={s}}}")) for s in (*SCRIPT_LANGUAGES, "Ethiopic", "Myanmar", "Sinhala", "Gujarati", "Gurmukhi", "Kannada", "Malayalam", "Tibetan", "Mongolian")]


def transliterate(name: str, text: str | None) -> str | None:
    """By a named transliterator; None for an unknown name."""
    run = TRANSLITERATORS.get(name)
    return None if run is None or text is None else run(text)


@lru_cache(65536)
def script_of(char: str) -> str:
    if char < "\x80":
        return "Latin" if char.isalpha() else "Common"
    for name, pattern in _SCRIPTS:
        if pattern.match(char):
            return name
    return "Common" if unicodedata.category(char)[0] not in "L" else "Unknown"


def script_spans(text: str) -> list[tuple[str, str, bool]]:
    """(script, span, whole span is ASCII): common characters go with the script before them."""
    spans: list[list] = []
    for c in text:
        s = script_of(c)
        if spans and (s == "Common" or s == spans[-1][0] or spans[-1][0] == "Common"):
            if spans[-1][0] == "Common":
                spans[-1][0] = s
            spans[-1][1] += c
        else:
            spans.append([s, c])
    return [(s, t, t.isascii()) for s, t in spans]


def normalize_utf8(text: str, options: int) -> str:
    if options & TRIM:
        text = text.strip()
    if options & LOWERCASE:
        text = text.lower()
    if options & (COMPOSE | DECOMPOSE | STRIP_ACCENTS):
        text = unicodedata.normalize("NFD", text)
        if options & STRIP_ACCENTS:
            text = "".join(c for c in text if unicodedata.category(c) != "Mn")
        if options & COMPOSE or not options & DECOMPOSE:
            text = unicodedata.normalize("NFC", text)
        text = "".join(c for c in text.replace("\r\n", "\n").replace("\r", "\n") if unicodedata.category(c) not in ("Cc", "Cf") or c in "\n\t")
    if options & REPLACE_HYPHENS:
        text = text.replace("-", " ")
    return text


def normalize_string(text: str | None, options: int = STRING_DEFAULT, languages: tuple[str, ...] = ()) -> str | None:
    """Transliterate if asked for, then trim, case, Unicode form, marks, hyphens and number words."""
    if text is None:
        return None
    if options & LATIN_ASCII:
        text = latin_ascii(text)
    elif options & SIMPLE_LATIN_ASCII:
        text = latin_ascii_simple(text)
    text = normalize_utf8(text, options)
    if options & REPLACE_NUMEX:
        from .numex import replace_numeric_expressions

        for language in languages:
            text = replace_numeric_expressions(text, language)
    return text


def normalize_string_languages(text: str, options: int, languages: tuple[str, ...] = (), transliterate_: bool = True) -> list[str]:
    """All normal forms: per script the product of its transliterators' outputs, Latin forms first. There
    is no cap: their number grows as a power of the number of spans with several outputs."""
    if text.isascii():
        return [normalize_string(text, options & ~LATIN_ASCII if "&" not in text else options, languages) or ""]
    spans = []
    for script, span, ascii_ in script_spans(text):
        choices = [span]
        if not ascii_ and script == "Latin":
            names = [n for lang in languages for n in SCRIPT_TRANSLITERATORS.get((script, lang), [])]
            if options & LATIN_ASCII:
                choices = [TRANSLITERATORS[n](span) for n in (*names, "latin-ascii")]
            if not options & STRIP_ACCENTS or not options & LATIN_ASCII:
                choices.append(span)
        elif not ascii_ and transliterate_:
            own = [n for lang in languages for n in SCRIPT_TRANSLITERATORS.get((script, lang), [])]
            for n in own or SCRIPT_TRANSLITERATORS.get((script, ""), []):
                out = TRANSLITERATORS[n](span)
                choices.append(latin_ascii(out) if options & LATIN_ASCII else out)
        spans.append(list(dict.fromkeys(choices)))
    rest = options & ~LATIN_ASCII
    return list(dict.fromkeys(normalize_string("".join(f), rest, languages) or "" for f in product(*spans)))


_POSSESSIVE = regex.compile(r"(?:'s|s')\Z", regex.I)


def normalize_token(text: str, kind: int, options: int = TOKEN_DEFAULT) -> str:
    """One token under the token options."""
    if options & K_POSSESSIVES and len(text) > 2 and kind in (TokenType.WORD, TokenType.ABBREVIATION) and _POSSESSIVE.search(text):
        text = _POSSESSIVE.sub("s", text)
    out: list[str] = []
    n, split = len(text), False
    for i, c in enumerate(text):
        before, after = text[i - 1 : i], text[i + 1 : i + 2]
        if c == "-":
            digits = before.isdigit() and after.isdigit()
            if options & K_DELETE_HYPHENS:
                if (before.isalpha() and after.isdigit()) or (before.isdigit() and after.isalpha()):
                    out.append(c)
                elif digits:
                    out.append(c)
                continue
            if options & K_REPLACE_HYPHENS and (not digits or options & K_NUMERIC_HYPHENS):
                out.append(" ")
                continue
        if options & K_SPLIT_ALPHA and kind == TokenType.NUMERIC and not split:
            if c in "-." and before.isalpha() and after.isdigit():
                out.append(" ")
                split = True
                continue
            if before and ((before.isalpha() and c.isdigit()) or (before.isdigit() and c.isalpha())):
                out.append(" ")
                split = True
        if c == "." and options & K_FINAL_PERIOD and i == n - 1 and n > 1:
            continue
        if c == "." and options & K_ACRONYM_PERIODS and kind == TokenType.ACRONYM:
            continue
        if c == "'" and options & K_APOSTROPHE and kind == TokenType.WORD:
            continue
        if options & K_DIGITS and unicodedata.category(c)[0] == "N":
            c = "D"
        out.append(c)
    return "".join(out)


def normalized_tokens(text: str, string_options: int = STRING_DEFAULT, token_options: int = TOKEN_DEFAULT, whitespace: bool = False, languages: tuple[str, ...] = ()) -> list[tuple[str, Token]]:
    """(normal form, token) of the normalised string."""
    return [(normalize_token(t.text, t.type, token_options), t) for t in tokenize(normalize_string(text, string_options, languages), whitespace)]


def equal_ignoring_separators(a: str, b: str) -> bool:
    return regex.sub(r"[\s\-]", "", a.lower()) == regex.sub(r"[\s\-]", "", b.lower())


def common_prefix(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def common_suffix(a: str, b: str) -> int:
    return common_prefix(a[::-1], b[::-1])
