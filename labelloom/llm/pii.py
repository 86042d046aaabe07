"""Personal data: regular expressions propose spans, checksums confirm them, context words adjust their score."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_id, as_key, small_batches, whole_text

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "ssn")

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a run of digits is never entered in its middle: what fails at its start fails there too, and matches end with whole runs
_IP = re.compile(r"[0-9](?<![0-9][0-9])[0-9]*+\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_WORD = re.compile(r"[^\W\d_]+")

# Lengths of national account numbers with a mod-97 check.
IBAN_LENGTH = {
    "AT": 20, "BE": 16, "BG": 22, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "EE": 20, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "GR": 27, "HR": 21,
    "HU": 28, "IE": 22, "IS": 26, "IT": 27, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MT": 31, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "RO": 24, "SE": 24, "SI": 19, "SK": 24,
}
_IBAN_REST = {n: re.compile(r"(?: ?[A-Z0-9]){%d}(?![A-Za-z0-9])" % (n - 4)) for n in set(IBAN_LENGTH.values())}

#: Words that make a kind likelier within WINDOW code points of a span, and words that make it less likely.
CONTEXT = {
    "email": ({"mail", "email", "contact", "write", "correo", "courriel", "kontakt"}, {"example", "sample"}),
    "ip": ({"ip", "address", "host", "server", "login", "adresse"}, {"version", "release", "section"}),
    "card": ({"card", "visa", "credit", "payment", "mastercard", "karte", "carte", "tarjeta"}, {"isbn", "order", "serial"}),
    "phone": ({"phone", "call", "tel", "mobile", "fax", "telefon", "teléfono"}, {"score", "version"}),
    "iban": ({"iban", "bank", "account", "konto", "compte", "cuenta"}, {"serial", "part"}),
    "ssn": ({"ssn", "social", "security", "taxpayer"}, {"part", "serial", "isbn"}),
}
PRIOR = {"email": 0.8, "ip": 0.6, "card": 0.7, "phone": 0.6, "iban": 0.5, "ssn": 0.3}
WINDOW = 48
STEP = 0.2


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    return (total + sum((0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[int(d)] for d in digits[-2::-2])) % 10 == 0


def mod97(account: str) -> bool:
    """ISO 13616: the first four characters go last, letters count from 10, the rest by 97 is 1."""
    return int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97 == 1


def emails(text: str) -> Iterator[tuple[int, int]]:
    """The leftmost matches of local@domain: each @ is tried with all of its local characters since the last match."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and _LOCAL.match(text[start - 1]):
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            last = domain.end()
            at = text.find("@", last)
        else:
            last = at + 1
            at = text.find("@", at + 1)


def ips(text: str) -> Iterator[tuple[int, int]]:
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            yield m.span()


def cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(digits := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(digits):
            yield m.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    for m in _PHONE.finditer(text):
        if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
            yield m.span()


def ibans(text: str) -> Iterator[tuple[int, int]]:
    for m in _IBAN.finditer(text):
        rest = _IBAN_REST[n].match(text, m.end()) if (n := IBAN_LENGTH.get(m[0][:2])) else None
        if rest and mod97((m[0] + rest[0]).replace(" ", "")):
            yield m.start(), rest.end()


def ssns(text: str) -> Iterator[tuple[int, int]]:
    for m in _SSN.finditer(text):
        if m[0][:3] not in ("000", "666") and m[0][0] != "9" and m[0][4:6] != "00" and m[0][7:] != "0000":
            yield m.span()


FINDERS = {"email": emails, "ip": ips, "card": cards, "phone": phones, "iban": ibans, "ssn": ssns}


def score(kind: str, text: str, start: int, end: int) -> float:
    near = {w.lower() for w in _WORD.findall(text[max(0, start - WINDOW) : start] + " " + text[end : end + WINDOW])}
    more, less = CONTEXT[kind]
    return min(1.0, max(0.0, PRIOR[kind] + STEP * bool(near & more) - STEP * bool(near & less)))


def find(text: str, least: float = 0.4) -> list[tuple[str, int, int, float]]:
    """Spans (kind, start, end, score) in code points, by kind and start; spans of added kinds need a score of `least`."""
    found = []
    for kind in KINDS:
        spans = [(kind, a, b, score(kind, text, a, b)) for a, b in FINDERS[kind](text)]
        found += spans if kind in BASE_KINDS else [s for s in spans if s[3] >= least]
    return found


def pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.4) -> DataFrame:
    """One row per row of docs: doc_id, n_<base kind>, base_sha256, spans, n_<added kind>, scores (in the order of spans), max_score.

    Null texts count as empty: no spans, the digest of the empty string, a null
    max_score. An empty table gives an empty result. Null and repeated ids are returned as they are; other columns are
    ignored. Work is one pass over the rows, linear in a text's length.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for doc, text in zip(rows["doc_id"], rows["text"], strict=True):
                spans = find(text, least)
                said = [f"{k}:{a}:{b}" for k, a, b, _ in spans]
                base = ",".join(x for x, s in zip(said, spans, strict=True) if s[0] in BASE_KINDS)
                counts = [sum(s[0] == k for s in spans) for k in KINDS]
                own = len(BASE_KINDS)
                out.append((doc, *counts[:own], hashlib.sha256(base.encode()).hexdigest(), ",".join(said), *counts[own:], ",".join(f"{s[3]:.2f}" for s in spans), max((s[3] for s in spans), default=None)))
            yield pd.DataFrame(out, columns=names)

    counted = [[f"n_{k}" for k in KINDS if (k in BASE_KINDS) == base] for base in (True, False)]
    names = ["doc_id", *counted[0], "base_sha256", "spans", *counted[1], "scores", "max_score"]
    kinds = {"doc_id": "string", "base_sha256": "string", "spans": "string", "scores": "string", "max_score": "double"}
    schema = ", ".join(f"{n} {kinds.get(n, 'long')}" for n in names)
    texts = docs.select(as_key(F.col(id_col)).alias("doc_id"), whole_text(text_col).alias("text"))
    return as_id(small_batches(texts).mapInPandas(run, schema))
