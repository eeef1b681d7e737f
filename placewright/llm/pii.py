"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds its anchors: at-signs, plus signs, digits, URL schemes and
identifier cues. A deterministic parser per kind expands an anchor to both sides and validates it.
Four base kinds have fixed patterns, each leftmost and without overlap within its kind:

email  ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+`` around an at-sign
ip     four dotted numbers of at most 255
card   16 to 19 digits with single spaces or hyphens between, passing Luhn
phone  a plus sign and 8 to 15 digits with spaces, dots, brackets or hyphens

and the anchors add ``url`` (address after a scheme, with user, host and path), ``iban`` (checked by
its remainder), ``account`` (a value after a cue such as ``account no:`` or ``api_key =``), ``key`` (secrets whose
format tells them: cloud, chat and forge keys, web tokens, private key blocks), ``ssn`` (three groups of
3, 2 and 4 digits with hyphens, of a number range that is given out) and ``tel`` (national numbers such as
``(212) 555-0199``).
Added spans never replace base ones. Offsets are code points, ends exclusive.

Defined cases: null and empty texts have no spans; a text of any length is scanned once, and a
parser never looks back before the end of its kind's last match; rows are judged apart.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces

BASE = ("email", "ip", "card", "phone")
ADDED = ("url", "iban", "account", "key", "ssn", "tel")
SCHEMES = ("http://", "https://", "ftp://", "ftps://", "sftp://", "ssh://", "mailto:", "tel:", "sip:")
CUES = (
    "account number", "account no", "account id", "account", "acct", "iban", "passport number", "passport no", "passport", "ssn", "social security number",
    "tax id", "vat id", "customer id", "customer no", "user id", "member id", "client id", "license no", "licence no", "api_key", "api key", "apikey", "api-key",
    "access_key", "access key", "secret_key", "secret key", "secret", "token", "password", "passwd", "pwd", "bearer",
    "kontonummer", "numéro de compte", "número de cuenta", "steuernummer", "dni", "nif",
)
#: Beginnings of keys, each with the least number of characters that must follow.
KEYS = {
    "AKIA": 16, "ASIA": 16, "AIza": 35, "ghp_": 30, "gho_": 30, "ghu_": 30, "ghs_": 30, "ghr_": 30, "github_pat_": 22, "glpat-": 20, "xoxb-": 20, "xoxp-": 20, "xoxa-": 20,
    "sk-": 20, "sk_live_": 16, "sk_test_": 16, "rk_live_": 16, "pk_live_": 16, "hf_": 30, "npm_": 36, "eyJ": 20, "-----BEGIN ": 10,
}
#: Cues after which a value need hold no digit.
SPOKEN = frozenset(("password", "passwd", "pwd", "secret", "token"))
SCHEMA = "doc_id long, kinds array<string>, starts array<long>, ends array<long>"

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(?:[.][0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]+")
_NOT_LOCAL = re.compile(r"[^A-Za-z0-9._%+-]")
_URL = re.compile(r"[^\s<>\"'`{}|\\^\[\]]+")
_VALUE = re.compile(r"[\s\"']{0,3}(?:number|no|nr|id|#)?\.?[\s\"']{0,3}(?:[:=#]|\bis\b)[\s\"']{0,3}(?=[A-Za-z0-9][A-Za-z0-9_/+.=-]{3})")
_RUN = re.compile(r"[A-Za-z0-9_/+.=-]+")
_IBAN = re.compile(r"[A-Za-z]{2}[0-9]{2}(?:[ ]?[A-Za-z0-9]{2,4}){2,8}")
_ASCII_WORD = re.compile(r"[A-Za-z0-9_]")
_KEY = re.compile(r"[A-Za-z0-9_.-]+")
_PEM = re.compile(r"-----BEGIN (?:[A-Z0-9]+ ){0,4}PRIVATE KEY-----(?:[A-Za-z0-9+/=\s:,.]|-(?!----))*-----END (?:[A-Z0-9]+ ){0,4}PRIVATE KEY-----")
_SSN = re.compile(r"(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9A-Za-z_-])")
_TEL = re.compile(r"(?:\([2-9][0-9]{2}\)[ ]?|[2-9][0-9]{2}[-. ])[2-9][0-9]{2}[-. ][0-9]{4}(?![0-9A-Za-z_-])")
_NEAR_TEL = re.compile(r"[A-Za-z0-9_+(.-]")
_MIXED = re.compile(r"[a-z][A-Z]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _iban_ok(text: str) -> bool:
    s = text.replace(" ", "").upper()
    if not 15 <= len(s) <= 34:
        return False
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def automaton():
    """The anchors of all kinds; values are (kind, length)."""
    import ahocorasick

    a = ahocorasick.Automaton()
    for kind, words in (("@", "@"), ("+", "+"), ("0", "0123456789"), ("(", "("), ("url", SCHEMES), ("cue", CUES), ("key", KEYS)):
        for w in words:
            a.add_word(_folded(w), (kind, len(w)))
    a.make_automaton()
    return a


def _folded(text: str) -> str:
    """A-Z in lower case; every code point keeps its place."""
    return text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


class Finder:
    """Spans of one text; keeps per kind the end of its last match, so all work is left to right."""

    def __init__(self):
        self.anchors = automaton()

    def __call__(self, text: str | None) -> list[tuple[str, int, int]]:
        if not text:
            return []
        spans: list[tuple[str, int, int]] = []
        last = dict.fromkeys((*BASE, *ADDED), 0)
        skip_ip = skip_iban = skip_account = skip_key = 0
        for at, (kind, size) in self.anchors.iter(_folded(text)):
            begin = at - size + 1
            if kind == "0":
                if begin >= last["ip"] and begin >= skip_ip:
                    if m := _IP.match(text, begin):
                        last["ip"] = m.end()
                        if all(len(p) <= 3 and int(p or "0") <= 255 for p in (p.lstrip("0") for p in m[0].split("."))):
                            spans.append(("ip", begin, m.end()))
                    else:  # a later start in the same run of digits meets the same end
                        skip_ip = _DIGITS.match(text, begin).end()
                if begin >= last["ssn"] and not (begin and _ASCII_WORD.match(text, begin - 1)) and text[begin - 1 : begin] != "-" and (m := _SSN.match(text, begin)):
                    spans.append(("ssn", begin, m.end()))
                    last["ssn"] = m.end()
                if begin >= last["tel"] and not (begin and _NEAR_TEL.match(text, begin - 1)) and (m := _TEL.match(text, begin)):
                    spans.append(("tel", begin, m.end()))
                    last["tel"] = m.end()
                if begin >= last["card"] and (m := _CARD.match(text, begin)):
                    last["card"] = m.end()
                    digits = m[0].replace(" ", "").replace("-", "")
                    if 16 <= len(digits) <= 19 and luhn(digits):
                        spans.append(("card", begin, m.end()))
                if begin >= skip_iban and begin - 2 >= last["iban"] and text[begin - 2 : begin].isalpha() and text[begin - 2 : begin].isascii():
                    skip_iban = begin + 1
                    if not (begin > 2 and _ASCII_WORD.match(text, begin - 3)):
                        self._iban(text, begin - 2, spans, last)
            elif kind == "(":
                if begin >= last["tel"] and (m := _TEL.match(text, begin)):
                    spans.append(("tel", begin, m.end()))
                    last["tel"] = m.end()
            elif kind == "key":
                if begin >= last["key"] and begin >= skip_key and not (begin and _ASCII_WORD.match(text, begin - 1)):
                    self._key(text, begin, at + 1, spans, last)
                    if last["key"] <= begin and not text.startswith("-", begin):
                        skip_key = _KEY.match(text, begin).end()  # what starts later in the same run is none either
            elif kind == "@":
                if (m := _DOMAIN.match(text, begin + 1)) and begin >= last["email"]:
                    low = begin
                    floor = last["email"]
                    while low > floor and not _NOT_LOCAL.match(text, low - 1):
                        low -= 1
                    if low < begin:
                        spans.append(("email", low, m.end()))
                        last["email"] = m.end()
            elif kind == "+":
                if begin >= last["phone"] and (m := _PHONE.match(text, begin)):
                    last["phone"] = m.end()
                    if 8 <= sum(c in "0123456789" for c in m[0]) <= 15:
                        spans.append(("phone", begin, m.end()))
            elif kind == "url":
                if begin >= last["url"] and not (begin and _ASCII_WORD.match(text, begin - 1)) and (m := _URL.match(text, at + 1)):
                    end = at + 1 + len(m[0].rstrip(".,;:!?)"))
                    if end > at + 1:
                        spans.append(("url", begin, end))
                        last["url"] = end
            elif begin >= last["account"] and not (begin and _ASCII_WORD.match(text, begin - 1)) and (m := _VALUE.match(text, at + 1)):
                if m.end() >= skip_account:
                    value = _RUN.match(text, m.end())
                    end = m.end() + len(value[0].rstrip(".=-/+"))
                    if end - m.end() >= 4 and (any(c.isdigit() for c in value[0]) or (text[begin : at + 1].lower() in SPOKEN and _MIXED.search(value[0]))):
                        spans.append(("account", m.end(), end))
                        last["account"] = end
                    else:  # what starts later in the same run is no value either
                        skip_account = value.end()
        spans = _without(spans, ("account",), ("iban",))
        spans = _without(spans, ("tel",), ("phone", "card", "ip", "iban", "account"))
        spans = _without(spans, ("ssn",), ("phone", "card", "iban"))
        order = {k: i for i, k in enumerate((*BASE, *ADDED))}
        return sorted(spans, key=lambda s: (order[s[0]], s[1]))

    @staticmethod
    def _key(text: str, begin: int, after: int, spans: list, last: dict) -> None:
        lead = text[begin:after]
        if lead not in KEYS:  # the anchors are found in any case
            return
        if lead.startswith("-"):
            if m := _PEM.match(text, begin):
                spans.append(("key", begin, m.end()))
                last["key"] = m.end()
            return
        end = begin + len(_KEY.match(text, begin)[0].rstrip(".-_"))
        if end - after >= KEYS[lead] and any(c.isdigit() for c in text[after:end]):
            spans.append(("key", begin, end))
            last["key"] = end

    @staticmethod
    def _iban(text: str, begin: int, spans: list, last: dict) -> None:
        m = _IBAN.match(text, begin)
        if not m:
            return
        for end in range(m.end(), begin + 14, -1):  # the pattern may run into the next word
            if text[end - 1] != " " and not (end < len(text) and _ASCII_WORD.match(text, end)) and _iban_ok(text[begin:end]):
                spans.append(("iban", begin, end))
                last["iban"] = end
                return


def _without(spans: list[tuple[str, int, int]], kinds: tuple[str, ...], others: tuple[str, ...]) -> list[tuple[str, int, int]]:
    """``spans`` without those of ``kinds`` that overlap one of ``others``; linear after a sort."""
    if not any(s[0] in kinds for s in spans):
        return spans
    held = sorted((s[1], s[2]) for s in spans if s[0] in others)
    ends, far = [], 0
    for _, e in held:
        far = max(far, e)
        ends.append(far)
    starts = [b for b, _ in held]

    def free(s: tuple[str, int, int]) -> bool:
        i = bisect_left(starts, s[2])  # those that begin before the span ends
        return i == 0 or ends[i - 1] <= s[1]

    return [s for s in spans if s[0] not in kinds or free(s)]


def spans_of(documents: DataFrame) -> DataFrame:
    """Per document row: doc_id, and the parallel arrays kinds, starts, ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = Finder()
        for batch in pieces(batches):
            found = [find(t) for t in batch.column("text").to_pylist()]
            cols = [[[s[i] for s in one] for one in found] for i in range(3)]
            types = (pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=["doc_id", "kinds", "starts", "ends"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def redacted(documents: DataFrame) -> DataFrame:
    """doc_id and ``text`` with each span's code points replaced by ``<kind>``; where spans of
    several kinds overlap, the first to begin names the whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = Finder()
        for batch in pieces(batches):
            texts = []
            for text in batch.column("text").to_pylist():
                parts, at = [], 0
                for kind, begin, end in sorted(find(text), key=lambda s: (s[1], -s[2])):
                    if begin >= at:
                        parts += [text[at:begin], f"<{kind}>"]
                    at = max(at, end)
                texts.append(None if text is None else "".join([*parts, text[at:]]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, text string")


def summary(found: DataFrame) -> DataFrame:
    """The digest columns of ``spans_of``: counts by base kind, the spans as text, the number of all, and whether there is any."""
    spans = F.transform(F.arrays_zip("kinds", "starts", "ends"), lambda s: F.struct(s["kinds"].alias("kind"), F.concat_ws(":", s["kinds"], s["starts"].cast("string"), s["ends"].cast("string")).alias("said")))
    named = found.select("doc_id", spans.alias("s"))
    count = lambda k: F.size(F.filter("s", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("s", lambda s: s["kind"].isin(*BASE))
    return named.select("doc_id", *map(count, BASE), F.sha2(F.concat_ws(",", base["said"]), 256).alias("base_sha256"), F.concat_ws(",", F.col("s")["said"]).alias("spans"), F.size("s").cast("long").alias("n_spans"), (F.size("s") > 0).alias("personal"))
