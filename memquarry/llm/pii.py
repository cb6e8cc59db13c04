"""Personal data: regular expressions propose spans, validators confirm them, and words nearby adjust the score.

Kinds: email, phone, ssn, ip, card (13 to 19 digits, Luhn), iban (country length and mod 97), secret (a key, token or password that is assigned), key (access keys of known forms).
Numbers in groups of three, three and four digits that only blanks part count as phones where such a word is near.
Words within 48 characters on either side raise a score; words in the 16 characters before lower it. A span counts where its score reaches `threshold`; of overlapping spans the one of the largest score stays, then the longest, then the first.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memquarry.llm.common import disjoint, mapped

THRESHOLD, NEAR, BEFORE = 0.5, 48, 16
#: What a text must hold for any kind to be proposed; tested in the JVM, so that other texts never reach Python.
TRIGGER = r"[\p{Nd}@=:]|AKIA|ASIA|gh[pousr]_|xox[abprs]-|sk-"

_IBAN_LENGTH = dict(x.split("=") for x in (
    "AD=24 AE=23 AL=28 AT=20 AZ=28 BA=20 BE=16 BG=22 BH=22 BR=29 CH=21 CR=22 CY=28 CZ=24 DE=22 DK=18 DO=28 EE=20 EG=29 ES=24 FI=18 FO=18 FR=27 GB=22 GE=22 GI=23 GL=18 GR=27 GT=28 HR=21 HU=28 "
    "IE=22 IL=23 IQ=23 IS=26 IT=27 JO=30 KW=30 KZ=20 LB=28 LI=21 LT=20 LU=20 LV=21 MC=27 MD=24 ME=22 MK=19 MR=27 MT=31 MU=30 NL=18 NO=15 PK=24 PL=28 PS=29 PT=25 QA=29 RO=24 RS=22 SA=24 SE=24 SI=19 SK=24 SM=27 TN=24 TR=26 UA=29 VA=22 XK=20"
).split())


def _iban_pattern() -> str:
    """For each length the countries that have it; the length says where a number ends, so that words behind it are never taken in."""
    by_length: dict = {}
    for country, n in _IBAN_LENGTH.items():
        by_length.setdefault(int(n), []).append(country)
    rest = lambda n: f"(?: ?[A-Z0-9]{{{n}}})" if n else ""
    return "|".join(f"(?:{'|'.join(c)})[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{{(n - 4) // 4}}}{rest((n - 4) % 4)}" for n, c in sorted(by_length.items()))


def luhn(digits: str) -> bool:
    """Whether a number's last digit is its check digit; one and the same digit throughout doesn't count."""
    d = [int(c) for c in digits]
    total = sum(d[-1::-2]) + sum(2 * x - 9 * (x > 4) for x in d[-2::-2])
    return total % 10 == 0 and len(set(d)) > 1


def mod97(iban: str) -> bool:
    """Whether an IBAN without spaces has its country's length and a remainder of 1."""
    return _IBAN_LENGTH.get(iban[:2]) == str(len(iban)) and int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def _card(m: str) -> float:
    digits = re.sub(r"\D", "", m)
    return 0.75 if 13 <= len(digits) <= 19 and luhn(digits) else 0.0


def _ip(m: str) -> float:
    parts = m.split(".")
    return 0.6 if all(int(p) < 256 and (p == "0" or p[0] != "0") for p in parts) else 0.0


def _ssn(m: str) -> float:
    a, b, c = m.split(m[3])
    return 0.0 if a in ("000", "666") or a[0] == "9" or b == "00" or c == "0000" else 0.6


def _phone(m: str) -> float:
    n = len(re.sub(r"\D", "", m))
    return 0.0 if not 7 <= n <= 15 else 0.75 if m[0] == "+" else 0.35 if re.fullmatch(r"(?:1 )?\d{3} \d{3} \d{4}", m) else 0.55


def _secret(m: str) -> float:
    value = re.split(r"[:=]", m, maxsplit=1)[1].strip(" \t\"'")
    mixed = bool(re.search(r"\d", value)) + bool(re.search(r"[A-Za-z]", value))
    return 0.75 if len(value) >= 16 and mixed == 2 else 0.55 if len(value) >= 8 and mixed == 2 else 0.4


#: kind: what the text must hold, pattern, score of a match, words that raise it by 0.2, words that lower it by 0.2. Every pattern takes linear time.
KINDS = {
    "email": ("@", re.compile(r"(?<![\w.+-])[\w][\w.+-]{0,63}@(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,62})\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9])"), lambda m: 0.9, ("mail", "contact"), ()),
    "iban": ("0", re.compile(rf"(?<![A-Za-z0-9])(?:{_iban_pattern()})(?![A-Za-z0-9])"), lambda m: 0.85 if mod97(m.replace(" ", "")) else 0.0, ("iban", "account", "konto", "compte", "cuenta", "bank"), ()),
    "card": ("0", re.compile(r"(?<![\d.])(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{1,7}|\d{4}([ -])\d{6}\2\d{4,5})(?!\d)"), _card, ("card", "visa", "mastercard", "credit", "karte", "carte", "tarjeta"), ("order", "isbn", "serial", "tracking")),
    "ssn": ("0", re.compile(r"(?<![\d-])\d{3}([- ])\d{2}\1\d{4}(?![\d-])"), _ssn, ("ssn", "social", "security"), ("part", "order", "serial")),
    "phone": ("0", re.compile(r"(?<![\w+.-])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{2,4}\) ?\d{3,4}[ .-]\d{3,4}|(?:1[ .-])?\d{3}([ .-])\d{3}\1\d{4})(?![\w-]|\.\d)"), _phone, ("phone", "tel", "call", "mobile", "fax", "telefon"), ("order", "isbn", "serial", "version")),
    "ip": ("0", re.compile(r"(?<![\w.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?![\w-]|\.\d)"), _ip, ("ip", "host", "server", "address", "login"), ("version", "release", "section", "chapter")),
    "secret": ("=", re.compile(r"(?i)(?<![a-z0-9])(?:api[_-]?key|access[_-]?key|secret(?:[_-]?key)?|auth[_-]?token|token|passw(?:or)?d|pwd)[\"']? ?[:=] ?(?:\"[^\"\s]{6,256}\"|'[^'\s]{6,256}'|[A-Za-z0-9_+/.=-]{8,256})"), _secret, ("key", "token", "password", "credential"), ("example",)),
    "key": ("A", re.compile(r"(?<![A-Za-z0-9])(?:A[KS]IA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{10,72}|sk-[A-Za-z0-9]{20,64})(?![A-Za-z0-9])"), lambda m: 0.85, ("key", "token", "secret"), ()),
}
_KEYS = ("AKIA", "ASIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "xox", "sk-")
_DIGIT = re.compile(r"\d")
_WORDS = re.compile(r"[^\W\d_]+")


def spans(text: str | None, threshold: float = THRESHOLD) -> list[tuple[int, int, str, float]]:
    """(start, end, kind, score) of what a text holds, in order, without overlaps; none in a null or empty text."""
    if not text:
        return []
    has = {"@": "@" in text, "0": bool(_DIGIT.search(text)), "=": "=" in text or ":" in text, "A": any(k in text for k in _KEYS)}
    found = []
    for kind, (need, pattern, rate, more, less) in KINDS.items():
        if not has[need]:
            continue
        for m in pattern.finditer(text):
            if score := rate(m.group()):
                near = set(_WORDS.findall((text[max(0, m.start() - NEAR) : m.start()] + " " + text[m.end() : m.end() + NEAR]).lower()))
                before = set(_WORDS.findall(text[max(0, m.start() - BEFORE) : m.start()].lower()))
                score += 0.2 * any(w in near for w in more) - 0.2 * any(w in before for w in less)
                if score >= threshold - 1e-9:
                    found.append((m.start(), m.end(), kind, round(min(score, 1.0), 2)))
    best = sorted(found, key=lambda s: (-s[3], s[0] - s[1], s[0]))
    return sorted(disjoint(best, lambda s: s[0], lambda s: s[1]))


def redact(text: str | None, threshold: float = THRESHOLD) -> str | None:
    """The text with each span replaced by its kind in square brackets."""
    parts, at = [], 0
    for start, end, kind, _ in spans(text, threshold):
        parts += [text[at:start], f"[{kind.upper()}]"]
        at = end
    return "".join([*parts, text[at:]]) if parts else text


def find(docs: DataFrame, threshold: float = THRESHOLD, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, kind, span_start, span_end, score: one row per span, offsets in characters; one pass, no shuffle. The values themselves aren't given.

    Null and empty texts give no rows; rows that repeat give their rows again; null ids stay null; an empty table gives an empty one; other columns, whatever their names, aren't read. Texts are searched
    whole, however long, in linear time; of spans that overlap the one of the largest score stays, of equal ones the longest, then the first. The same spans are those that redacted() replaces.
    """
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches):
        for b in batches:
            rows = [(i, *s) for i, t in enumerate(b.column(1).to_pylist()) for s in spans(t, threshold)]
            of = lambda k, t: pa.array([r[k] for r in rows], t)
            yield pa.RecordBatch.from_arrays([b.column(0).take(of(0, pa.int64())), of(3, pa.string()), of(1, pa.int32()), of(2, pa.int32()), of(4, pa.float64())], names=["doc_id", "kind", "span_start", "span_end", "score"])

    held = docs.select(F.col(doc_id), F.col(text)).where(F.col(text).rlike(TRIGGER))
    return mapped(held, run, f"doc_id {kind}, kind string, span_start int, span_end int, score double")


def redacted(docs: DataFrame, threshold: float = THRESHOLD, text: str = "text", length: str = "n_chars") -> DataFrame:
    """docs with personal data replaced in `text`; `length`, where there is such a column, becomes the new length of a changed text. No row goes, no shuffle; all other columns, whatever their names, stay.

    Null and empty texts, null ids and rows that repeat stay as they are; an empty table gives an empty one. Texts are searched whole, however long; ties between overlapping spans as in find()."""
    place, at = docs.columns.index(text), docs.columns.index(length) if length in docs.columns else None

    def run(batches):
        for b in batches:
            old = b.column(place).to_pylist()
            new = [redact(t, threshold) for t in old]
            columns = list(b.columns)
            columns[place] = pa.array(new, b.schema.field(place).type)
            if at is not None:
                columns[at] = pa.array([n if x is y else len(y) for x, y, n in zip(old, new, b.column(at).to_pylist())], b.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, names=b.schema.names)

    return mapped(docs, run, docs.schema)
