"""Personal data in texts: patterns propose, checksums confirm, context words adjust the score.

Base kinds (email, ip, card, phone) are always kept once their own test holds. The method adds account numbers
(IBAN, mod-97), social security numbers and national phone numbers, which need a score of at least THRESHOLD.
Every scan is linear in the text, however long its runs of digits or letters are.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from sedge.llm.spans import Span, base_of, count_of, joined, spans_of

KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "local_phone")
#: Score before context; what a context word adds; the least score of an added span; characters of context on either side.
START = {"email": 0.9, "ip": 0.6, "card": 0.7, "phone": 0.6, "iban": 0.8, "ssn": 0.35, "local_phone": 0.3}
BONUS, THRESHOLD, NEAR = 0.3, 0.6, 48
CONTEXT = {
    "email": ("email", "e-mail", "mail", "contact", "correo", "courriel"),
    "ip": ("ip", "server", "host", "address", "login", "adresse"),
    "card": ("card", "visa", "credit", "debit", "karte", "carte", "tarjeta"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "telefon", "llame"),
    "iban": ("iban", "account", "bank", "konto", "compte", "cuenta"),
    "ssn": ("ssn", "social", "security", "tax", "identification"),
    "local_phone": ("phone", "tel", "call", "mobile", "fax", "telefon", "llame"),
}

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
#: Characters of an account number by country (ISO 13616).
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BI": 27, "BR": 29, "BY": 28, "CH": 21, "CR": 22,
    "CY": 28, "CZ": 24, "DE": 22, "DJ": 27, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FK": 18, "FO": 18, "FR": 27, "GB": 22,
    "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HN": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30,
    "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MN": 20,
    "MR": 27, "MT": 31, "MU": 30, "NI": 28, "NL": 18, "NO": 15, "OM": 23, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22,
    "RU": 33, "SA": 24, "SC": 31, "SD": 18, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "SO": 23, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26,
    "UA": 29, "VA": 22, "VG": 24, "XK": 20, "YE": 30,
}
_IBAN_START = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=\x20?[A-Z0-9])")
_IBAN_OF = {
    n: re.compile(rf"[A-Z]{{2}}[0-9]{{2}}(?:\x20?[A-Z0-9]{{4}}){{{n // 4 - 1}}}" + (rf"\x20?[A-Z0-9]{{{n % 4}}}" if n % 4 else "") + "(?![A-Za-z0-9])")
    for n in set(IBAN_LENGTHS.values())
}
_SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
_LOCAL_PHONE = re.compile(r"(?<![0-9+(.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9-])")
_DIGIT = re.compile("[0-9]")
_WORD = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*")


def luhn(digits: str) -> bool:
    """Whether the check digit of a card number is right."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        total += n if i % 2 == 0 else (2 * n - 9 if n > 4 else 2 * n)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """Whether an account number, without spaces, leaves 1 when its rearranged digits are divided by 97."""
    return len(iban) <= 34 and int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def _emails(text: str):
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            done = m.end()
            yield start, done
            at = text.find("@", done)
        else:
            at = text.find("@", at + 1)


def _ibans(text: str):
    """Spans of account numbers: each start is cut to its country's length; of countries without one the longest match is tested."""
    at = 0
    while m := _IBAN_START.search(text, at):
        n = IBAN_LENGTHS.get(m[0][:2])
        whole = (_IBAN_OF[n] if n else _IBAN).match(text, m.start())
        if whole and mod97(whole[0].replace(" ", "")):
            yield whole.span()
            at = whole.end()
        else:
            at = m.start() + 1


def _score(text: str, kind: str, start: int, end: int) -> float:
    near = text[max(0, start - NEAR) : start] + " " + text[end : end + NEAR]
    words = set(_WORD.findall(near.lower()))
    return min(1.0, START[kind] + BONUS * (not words.isdisjoint(CONTEXT[kind])))


def scan(text: str) -> list[Span]:
    """The personal data in one text as (kind, start, end, score, base)."""
    found: list[tuple[str, int, int]] = []
    if "@" in text:
        found += [("email", a, b) for a, b in _emails(text)]
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            parts = [x.lstrip("0") for x in m[0].split(".")]
            if all(len(x) <= 3 and int(x or "0") <= 255 for x in parts):
                found.append(("ip", *m.span()))
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", *m.span()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                    found.append(("phone", *m.span()))
        base = len(found)
        found += [("iban", *span) for span in _ibans(text)]
        found += [("ssn", *m.span()) for m in _SSN.finditer(text)]
        found += [("local_phone", *m.span()) for m in _LOCAL_PHONE.finditer(text)]
    else:
        base = len(found)
    scored = [(k, a, b, _score(text, k, a, b), i < base) for i, (k, a, b) in enumerate(found)]
    return [s for s in scored if s[4] or s[3] >= THRESHOLD]


def redacted(text: str | None) -> str | None:
    """text with each span, overlapping ones as one, replaced by its first kind in brackets."""
    if not text or not (spans := sorted(scan(text), key=lambda s: (s[1], KINDS.index(s[0])))):
        return text
    out, at, i = [], 0, 0
    while i < len(spans):
        kind, start, end = spans[i][:3]
        i += 1
        while i < len(spans) and spans[i][1] < end:
            end = max(end, spans[i][2])
            i += 1
        out += [text[at:start], f"[{kind.upper()}]"]
        at = end
    return "".join([*out, text[at:]])


def personal_data(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, spans: array of (kind, start, end, score, base), offsets in code points.

    One row for each row, without spans for null or empty texts; doc_id may be null or repeat; other columns are ignored.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), spans_of(scan, KINDS, text).alias("spans"))


def redact(text: Column) -> Column:
    """text with personal data replaced; null stays null."""

    @F.arrow_udf("string")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array([redacted(t.as_py()) for t in texts], pa.string())

    return of(text.cast("string"))


def digest(found: DataFrame) -> DataFrame:
    """personal_data's rows as counts, the base spans' digest and all spans as text."""
    s = F.col("spans")
    return found.select(
        "doc_id",
        *[count_of(s, k).alias(f"n_{k}") for k in KINDS[:4]],
        F.sha2(joined(base_of(s)), 256).alias("base_sha256"),
        joined(s).alias("spans"),
    )
