"""Personal data in texts: patterns propose spans, checksums confirm them, context words move the score.

The four base kinds are found leftmost and without overlap, each kind by itself, and always stay. The method adds
spans: bank account numbers (IBAN, by the length of their country) that pass mod 97; US social security numbers and 12-
or 13-digit card numbers only where words nearby speak for them; and secrets: access keys by their published prefixes,
private key blocks, and values with digits and much entropy that are assigned to a name such as password or token. Every
span has a score, and added spans below `Scoring.least` are dropped.

Defined results: null text is empty; rows are judged one by one, so repeated rows and null ids change nothing; an
empty table gives an empty one; very long texts and runs, and texts with very many spans, take linear time (apart from the
sorting of spans), and secrets of any length are found whole; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import small_batches
from .textwords import slices

# Kinds in order, the base kinds first; context words by kind.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn", "short_card", "secret")
CONTEXT = {
    "email": ("contact", "email", "mail", "write", "kontakt", "schreiben", "contacto", "correo", "courriel", "écrire"),
    "ip": ("address", "host", "ip", "server", "adresse", "rechner", "dirección", "servidor", "serveur"),
    "card": ("card", "credit", "mastercard", "payment", "visa", "karte", "kreditkarte", "zahlung", "crédito", "pago", "tarjeta", "carte", "paiement"),
    "phone": ("call", "fax", "mobile", "phone", "tel", "telephone", "anruf", "handy", "telefon", "llamar", "móvil", "teléfono", "appeler", "portable", "téléphone"),
    "iban": ("account", "bank", "iban", "transfer", "konto", "überweisung", "banco", "cuenta", "transferencia", "banque", "compte", "virement"),
    "ssn": ("security", "social", "ssn"),
    "short_card": ("card", "credit", "maestro", "payment", "visa", "karte", "kreditkarte", "tarjeta", "carte"),
    "secret": ("key", "password", "secret", "token", "credential", "passwort", "schlüssel", "clave", "contraseña", "clé"),
}
AGAINST = ("example", "isbn", "order", "test", "version")
# Lengths of account numbers by country.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS",
    23: "AE IL TL", 24: "AD CZ ES MD PK RO SA SE SK TN VA", 25: "LY PT ST", 26: "IS TR", 27: "FR GR IT MC MR SM", 28: "AL AZ CY DO GT HU LB PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC", 32: "LC",
}
# Published formats of access keys, and what a text with such a key or an assigned secret must hold.
KEYS = (r"(?:AKIA|ASIA)[A-Z0-9]{16}", r"gh[oprsu]_[A-Za-z0-9]{36,}+", r"github_pat_[A-Za-z0-9_]{22,}+", r"AIza[A-Za-z0-9_-]{35}", r"[rs]k_(?:live|test)_[A-Za-z0-9]{16,}+")
KEY_MARKS = ("AKIA", "ASIA", "gho_", "ghp_", "ghr_", "ghs_", "ghu_", "github_pat_", "AIza", "k_live_", "k_test_")
NAME_MARKS = ("passw", "passphrase", "contrase", "pwd", "secret", "token", "key")


@dataclass(frozen=True)
class Scoring:
    """Score of a span: its kind's start, more for a passed checksum, more or less for context words within reach."""

    starts: tuple[float, ...] = (0.8, 0.7, 0.5, 0.7, 0.5, 0.3, 0.2, 0.5)
    checksum: float = 0.3
    context: float = 0.3
    against: float = 0.2
    reach: int = 40
    least: float = 0.6
    entropy: float = 2.5


EMAIL_HOST = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
EMAIL_NAME = re.compile(r"[A-Za-z0-9._%+-]*+\Z")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}")
IBAN_SIZE = {country: n for n, countries in IBAN_LENGTHS.items() for country in countries.split()}
KEY = re.compile(rf"(?<![A-Za-z0-9_])(?:{'|'.join(KEYS)})(?![A-Za-z0-9_])")
CHAT_KEY = re.compile(r"(?<![A-Za-z0-9_])xox[abprs]-([A-Za-z0-9-]*+)")
WEB_TOKEN, WEB_TOKEN_START = re.compile(r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]++(?:\.[A-Za-z0-9_-]++){2,}+"), re.compile("(?<![A-Za-z0-9_])eyJ")
KEY_BLOCK = re.compile(r"-----BEGIN (?:[A-Z]+ ){0,3}PRIVATE KEY-----")
ASSIGNED = re.compile(
    r"(?<![A-Za-z])(?:password|passwd|passwort|passphrase|contraseña|pwd|secret|token|(?:api|access|secret|auth)[_-]?(?:key|token))[\"']?[ \t]{0,3}[:=][ \t]{0,3}[\"']?([^\s\"'<>,;]{8,}+)",
    re.IGNORECASE,
)
SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
NAME_CHAR = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
WORD = re.compile(r"[^\W\d_]+")


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def octet(digits: str) -> bool:
    """At most 255; a run of digits may be too long for int."""
    short = digits.lstrip("0")
    return len(short) < 3 or len(short) == 3 and short <= "255"


def iban_end(text: str, start: int, end: int) -> int:
    """Where an account number of its country's length ends, or 0; what follows it may look like more of it."""
    wanted, at = IBAN_SIZE.get(text[start : start + 2], 0), start
    while wanted and at < end:
        wanted -= text[at] != " "
        at += 1
    return at if not wanted and at > start and not text[at : at + 1].isalnum() else 0


def entropy(text: str) -> float:
    """Bits a character."""
    return -sum(n / len(text) * math.log2(n / len(text)) for n in Counter(text).values())


def mod97(iban: str) -> bool:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of name@host: a name can only begin where its run does or where the last match ended."""
    last, at = 0, text.find("@")
    while at >= 0:
        host = EMAIL_HOST.match(text, at + 1)
        begin = at
        if host:
            while begin > last and text[begin - 1] in NAME_CHAR:
                begin -= 1
        if host and begin < at:
            yield begin, host.end()
            last = host.end()
        at = text.find("@", max(at + 1, last))


def find_base(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the base kinds."""
    found = [(a, b, 0) for a, b in emails(text)] if "@" in text else []
    if re.search("[0-9]", text):
        found += [(*m.span(), 1) for m in IP.finditer(text) if all(map(octet, m[0].split(".")))] if "." in text else []
        found += [(*m.span(), 2) for m in CARD.finditer(text) if len(m[0]) >= 14 and 14 <= len(d := digits_of(m[0])) <= 19 and luhn(d)]
        found += [(*m.span(), 3) for m in PHONE.finditer(text) if 10 <= len(digits_of(m[0])) <= 15] if "+" in text else []
    return sorted(found)


class Overlaps:
    """Does a range overlap any of the given ones? Found by bisection."""

    def __init__(self, spans: list[tuple]):
        self.starts, self.ends = [x[0] for x in spans], list(accumulate((x[1] for x in spans), max))

    def any(self, start: int, end: int) -> bool:
        before = bisect_left(self.starts, end)
        return before > 0 and self.ends[before - 1] > start


def web_tokens(text: str) -> Iterator[tuple[int, int]]:
    """Tokens of three parts between dots, of which the first two begin with eyJ."""
    for m in WEB_TOKEN.finditer(text):
        parts, at = m[0].split("."), m.start()
        begins = []
        for part in parts:
            begins.append(at)
            at += len(part) + 1
        last = 0
        for i in range(len(parts) - 2):
            # The first beginning leaves the most characters.
            first = WEB_TOKEN_START.search(parts[i]) if i >= last else None
            if first and len(parts[i]) - first.end() >= 10 and parts[i + 1].startswith("eyJ") and len(parts[i + 1]) >= 13 and len(parts[i + 2]) >= 10:
                last = i + 3
                yield begins[i] + first.start(), begins[i + 2] + len(parts[i + 2])


def find_secrets(text: str, least: float) -> list[tuple[int, int, int, bool]]:
    found = [(*m.span(), 7, True) for m in KEY.finditer(text)] if any(mark in text for mark in KEY_MARKS) else []
    if "xox" in text:
        found += [(*m.span(), 7, True) for m in CHAT_KEY.finditer(text) if len(m[1]) >= 10 and text[m.end() : m.end() + 1] != "_"]
    if "eyJ" in text:
        found += [(a, b, 7, True) for a, b in web_tokens(text)]
    if "-----BEGIN" in text:
        at, last = 0, text.rfind("-----END")
        while m := KEY_BLOCK.search(text, at):
            ends = text.find("-----END", m.end()) if last >= m.end() else -1
            at = m.end() if ends < 0 else max(m.end(), text.find("-----", ends + 8) + 5)
            found.append((m.start(), at, 7, True))
    kept: list[tuple[int, int, int, bool]] = []
    for x in sorted(found):
        if not kept or x[0] >= kept[-1][1]:
            kept.append(x)
    low = text.casefold() if ":" in text or "=" in text else ""
    if not any(mark in low for mark in NAME_MARKS):
        return kept
    known = Overlaps(kept)
    return kept + [(*m.span(1), 7, False) for m in ASSIGNED.finditer(text) if any("0" <= c <= "9" for c in m[1]) and entropy(m[1]) >= least and not known.any(*m.span(1))]


def find_added(text: str, scoring: Scoring) -> list[tuple[int, int, int, bool]]:
    """(start, end, kind, checksum or format passed) of further kinds, before scoring."""
    found = find_secrets(text, scoring.entropy)
    if not re.search("[0-9]", text):
        return found
    for m in IBAN.finditer(text):
        if (end := iban_end(text, *m.span())) and mod97(text[m.start() : end].replace(" ", "")):
            found.append((m.start(), end, 4, True))
    if "-" in text:
        found += [(*m.span(), 5, False) for m in SSN.finditer(text) if m[0][:3] not in ("000", "666") and m[0][0] != "9" and m[0][4:6] != "00" and m[0][7:] != "0000"]
    found += [(*m.span(), 6, True) for m in CARD.finditer(text) if len(m[0]) >= 12 and len(d := digits_of(m[0])) in (12, 13) and luhn(d)]
    return found


def score(text: str, start: int, end: int, kind: int, passed: bool, scoring: Scoring) -> float:
    near = {w.lower() for w in WORD.findall(text[max(0, start - scoring.reach) : start] + " " + text[end : end + scoring.reach])}
    value = scoring.starts[kind] + scoring.checksum * passed
    value += scoring.context * bool(near.intersection(CONTEXT[KINDS[kind]])) - scoring.against * bool(near.intersection(AGAINST))
    return min(1.0, max(0.0, value))


def find(text: str, scoring: Scoring) -> list[tuple[int, int, int, float]]:
    """(start, end, kind, score) of all spans, by start and kind."""
    base = find_base(text)
    found = [(a, b, k, score(text, a, b, k, k == 2, scoring)) for a, b, k in base]
    known = Overlaps(base)
    for a, b, k, passed in find_added(text, scoring):
        if not known.any(a, b) and (s := score(text, a, b, k, passed, scoring)) >= scoring.least:
            found.append((a, b, k, s))
    return sorted(found, key=lambda x: (x[0], x[2]))


def named(spans: list[tuple]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k, *_ in sorted(spans, key=lambda x: (x[0], x[2])))


def digest(docs: DataFrame, scoring: Scoring | None = None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, scores (three decimals, in the spans' order)."""
    scoring = scoring or Scoring()
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = []
            for text in batch.column(1).to_pylist():
                found = find(text or "", scoring)
                base = [x for x in found if x[2] < len(BASE)]
                counts = [sum(x[2] == k for x in base) for k in range(len(BASE))]
                out.append((*counts, hashlib.sha256(named(base).encode()).hexdigest(), named(found), ",".join(f"{x[3]:.3f}" for x in found)))
            columns = [pa.array([r[i] for r in out], pa.int64() if i < 4 else pa.string()) for i in range(7)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "scores"])

    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, scores string"
    return docs.selectExpr("cast(doc_id as long) AS doc_id", "text").mapInArrow(run, schema)


def mask(text: str, scoring: Scoring) -> str:
    """The text with every span replaced by its kind in angle brackets; of overlapping spans the first stands."""
    out, last = [], 0
    for a, b, k, _ in find(text, scoring):
        if b > last:
            out += [text[last : max(a, last)], f"<{KINDS[k]}>"] if a >= last else []
            last = b
    return "".join([*out, text[last:]])


def mask_documents(docs: DataFrame, scoring: Scoring | None = None) -> DataFrame:
    """docs with the spans of text masked (null stays null) and n_chars, where there is one, counted anew."""
    scoring = scoring or Scoring()

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda t: t if t is None else mask(t, scoring))

    small_batches(docs.sparkSession)
    masked = docs.withColumn("text", F.pandas_udf(run, "string")(F.col("text")))
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else masked
