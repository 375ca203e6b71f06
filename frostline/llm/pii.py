"""Operator 9: personal data by patterns, checksums and context.

Regular expressions propose spans, validators (Luhn for cards, mod-97 for IBANs, octet and group ranges) confirm
them, and words near a span move its score. Defined results: a null or empty text has no spans; spans are code
point offsets with an exclusive end; repeated rows, also of one id, give repeated results, a null id stays null;
find_pii() ignores other columns, redact_documents() keeps them. Base spans stay whatever their score: context words
raise it; a span of an added kind needs a score of LEAST, which a bare social security number hasn't got.
"""

from __future__ import annotations

import hashlib
import re
from itertools import chain
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_slices, slices, texts_of

BASE = ("email", "ip", "card", "phone")
ADDED = ("iban", "ssn")
SCHEMA = "doc_id long, kinds array<string>, starts array<int>, ends array<int>, scores array<double>"

# Characters of a mail's local part, patterns, context words.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=\x20?[A-Z0-9])")
SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
DIGIT = re.compile(r"[0-9]")
# The published length of each country's IBAN.
IBAN_LENGTHS = """
AD 24 AE 23 AL 28 AT 20 AZ 28 BA 20 BE 16 BG 22 BH 22 BI 27 BR 29 BY 28 CH 21 CR 22 CY 28 CZ 24 DE 22 DJ 27 DK 18 DO 28
EE 20 EG 29 ES 24 FI 18 FK 18 FO 18 FR 27 GB 22 GE 22 GI 23 GL 18 GR 27 GT 28 HN 28 HR 21 HU 28 IE 22 IL 23 IQ 23 IS 26
IT 27 JO 30 KW 30 KZ 20 LB 28 LC 32 LI 21 LT 20 LU 20 LV 21 LY 25 MC 27 MD 24 ME 22 MK 19 MN 20 MR 27 MT 31 MU 30 NI 28
NL 18 NO 15 OM 23 PK 24 PL 28 PS 29 PT 25 QA 29 RO 24 RS 22 RU 33 SA 24 SC 31 SD 18 SE 24 SI 19 SK 24 SM 27 SO 23 ST 25
SV 28 TL 23 TN 24 TR 26 UA 29 VA 22 VG 24 XK 20 YE 30
""".split()
IBAN_REST = {c: re.compile(rf"(?:\x20?[A-Z0-9]){{{int(n) - 4}}}(?![A-Za-z0-9])") for c, n in zip(IBAN_LENGTHS[::2], IBAN_LENGTHS[1::2], strict=True)}
CONTEXT = {
    "email": ("mail", "email", "contact", "courriel", "correo"),
    "ip": ("ip", "host", "server", "address"),
    "card": ("card", "visa", "credit", "karte", "carte", "tarjeta"),
    "phone": ("phone", "tel", "call", "mobile", "telefon"),
    "iban": ("iban", "account", "bank", "konto", "compte", "cuenta"),
    "ssn": ("ssn", "social", "security"),
}
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.85, "ssn": 0.4}
NEAR, LIFT, LEAST = 40, 0.15, 0.5


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    score: float


def luhn(digits: str) -> bool:
    total = 0
    for at, d in enumerate(reversed(digits)):
        v = ord(d) - 48
        if at % 2:
            v = v * 2 - 9 * (v > 4)
        total += v
    return total % 10 == 0


def mod97(code: str) -> bool:
    moved = code[4:] + code[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def emails(text: str) -> list[tuple[int, int]]:
    """Left to right without overlaps; linear in the text, since an @ belongs to no local part."""
    found, floor, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            found.append((start, m.end()))
            floor = m.end()
        at = text.find("@", at + 1)
    return found


def ibans(text: str) -> list[tuple[int, int]]:
    """Codes of their country's length whose remainder is right, left to right without overlaps."""
    found, floor = [], 0
    for m in IBAN.finditer(text):
        rest = IBAN_REST.get(text[m.start() : m.start() + 2])
        whole = rest and m.start() >= floor and rest.match(text, m.end())
        if whole and mod97(text[m.start() : whole.end()].replace(" ", "")):
            floor = whole.end()
            found.append((m.start(), floor))
    return found


def _base(text: str) -> list[tuple[str, int, int]]:
    found = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    if DIGIT.search(text):
        for m in IP.finditer(text) if "." in text else ():
            if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) < 256 for p in m[0].split(".")):
                found.append(("ip", *m.span()))
        for m in CARD.finditer(text):
            if m.end() - m.start() > 15 and 16 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
                found.append(("card", *m.span()))
        for m in PHONE.finditer(text) if "+" in text else ():
            if 8 <= len(DIGIT.findall(m[0])) <= 15:
                found.append(("phone", *m.span()))
    return found


def _score(text: str, kind: str, start: int, end: int) -> float:
    around = re.findall(r"[a-z]+", (text[max(0, start - NEAR) : start] + " " + text[end : end + NEAR]).lower())
    return round(min(1.0, PRIOR[kind] + LIFT * len(set(around) & set(CONTEXT[kind]))), 4)


def detect(text: str | None) -> list[Span]:
    """All spans of one text: base kinds always, added kinds if valid, clear of base spans and scored at least LEAST."""
    text = text or ""
    base = _base(text)
    found = [Span(k, a, b, _score(text, k, a, b)) for k, a, b in base]
    added = []
    if DIGIT.search(text):
        added += [("iban", a, b) for a, b in ibans(text)]
        added += [("ssn", *m.span()) for m in SSN.finditer(text) if m[0][:3] not in ("000", "666") and m[0][0] != "9" and m[0][4:6] != "00" and m[0][7:] != "0000"]
    for k, a, b in added:
        score = _score(text, k, a, b)
        if score >= LEAST and all(b <= s or a >= e for _, s, e in base):
            found.append(Span(k, a, b, score))
    order = {k: i for i, k in enumerate(BASE + ADDED)}
    return sorted(found, key=lambda s: (order[s.kind], s.start))


def redact(text: str | None, spans: list[Span]) -> str | None:
    """The text with each span (overlapping ones merged under the first kind) replaced by its kind in angle brackets."""
    if text is None or not spans:
        return text
    out, at = [], 0
    for s in sorted(spans, key=lambda s: (s.start, -s.end)):
        if s.start >= at:
            out += [text[at : s.start], f"<{s.kind}>"]
        at = max(at, s.end)
    return "".join([*out, text[at:]])


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, kinds, starts, ends, scores) for every row of docs."""

    def run(ids, texts):
        all_spans = [detect(t) for t in texts]
        return {"doc_id": ids} | {c: [[getattr(s, f) for s in spans] for spans in all_spans] for c, f in (("kinds", "kind"), ("starts", "start"), ("ends", "end"), ("scores", "score"))}

    return map_slices(texts_of(docs, id_col, text_col), run, SCHEMA)


def redact_documents(docs: DataFrame) -> DataFrame:
    """docs with personal data in text replaced by kind names and n_chars set anew; a null text stays null."""
    names = docs.columns

    def run(batches):
        import pyarrow as pa

        for part in chain.from_iterable(slices(batch, names.index("text"), 1024) for batch in batches):
            texts = [redact(t, detect(t)) for t in part.column(names.index("text")).to_pylist()]
            columns = [pa.array(texts, part.schema.field(i).type) if n == "text" else pa.array([None if t is None else len(t) for t in texts], part.schema.field(i).type) if n == "n_chars" else part.column(i) for i, n in enumerate(names)]
            yield pa.RecordBatch.from_arrays(columns, schema=part.schema)

    return docs.mapInArrow(run, docs.schema)


def joined(kinds, starts, ends) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in zip(kinds, starts, ends, strict=True))


def report(docs: DataFrame) -> DataFrame:
    """The digest columns of op9, from find_pii's spans."""
    spans = find_pii(docs)
    item = lambda s: F.concat_ws(":", s["kinds"], s["starts"].cast("string"), s["ends"].cast("string"))
    zipped = F.arrays_zip("kinds", "starts", "ends")
    base = F.filter(zipped, lambda s: s["kinds"].isin(*BASE))
    count = lambda k: F.size(F.filter("kinds", lambda x: x == k)).cast("long").alias(f"n_{k}")
    return spans.select(
        "doc_id", *[count(k) for k in BASE],
        F.sha2(F.array_join(F.transform(base, item), ",").cast("binary"), 256).alias("base_sha256"),
        F.array_join(F.transform(zipped, item), ",").alias("spans"),
        F.col("scores"),
    )


def brute_base(text: str | None) -> tuple[list[tuple[str, int, int]], str]:
    """The contract's patterns as they stand, for tests."""
    text, found = text or "", []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        found.append(("email", *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            found.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 16 <= len(d) <= 19 and luhn(d):
            found.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            found.append(("phone", *m.span()))
    return found, hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in found).encode()).hexdigest()
