"""Personal data by anchor expansion.

One pass of an Aho-Corasick automaton over a text finds anchors: at-signs, plus
signs, digits, URL schemes and cues of identifiers (account, IBAN, passport,
token and the like). A small parser for each kind of anchor then looks at the
neighbourhood only, expands to the boundaries of the e-mail address, number,
address or account and validates it. A parser never starts before the end of
the last match of its kind, so matches are leftmost and do not overlap.

Base kinds: email, ip, card, phone. Added kinds: url, account (an IBAN with its
check digits, or what follows a cue) and secret (a long value after a key name).

Defined cases: a null text is an empty one, without spans; offsets are code
points, end exclusive; repeated rows each get a row, null doc_id among them; a very
long text is searched whole, in a piece of a batch of its own; an empty table gives
an empty result; `masked_documents` carries other columns through, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimlens.llm.batches import pieces, tidy

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "url", "account", "secret")
SCHEMES = ("http://", "https://", "ftp://", "www.")
CUES = ("iban", "account no", "account number", "acct", "passport", "ssn")
KEYS = ("token", "secret", "api_key", "apikey", "password")

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]+")
_URL = re.compile(r"(?:(?:https?|ftp)://|www\.)[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+(?::[0-9]{1,5})?(?:/[^\x00-\x20\"'<>|]*)?", re.I)
_IBAN = re.compile(r"[:#\x20]{0,3}([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?)(?![A-Za-z0-9])")
_NUMBER = re.compile(r"(?:\x20?(?:no|number|nr)\.?)?[:#=\x20]{1,4}([A-Z]{0,2}[0-9][0-9-]{4,20}[0-9])(?![A-Za-z0-9])", re.I)
_SECRET = re.compile(r"[\x20]?[:=][\x20]?[\"']?([A-Za-z0-9_/+-]{20,})(?![A-Za-z0-9_/+-])")
_COUNTRY = re.compile(r"(?:[^A-Za-z0-9])?[A-Z]{2}\Z")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def iban_valid(text: str) -> bool:
    s = text.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for kind, words in (("@", "@"), ("+", "+"), ("9", "0123456789"), ("url", SCHEMES), ("cue", CUES), ("key", KEYS)):
        for w in words:
            found.add_word(w, (kind, len(w)))
    found.make_automaton()
    return found


_LOWER = {c: c + 32 for c in range(65, 91)}


class Finder:
    def __init__(self):
        self.anchors = _automaton()

    def spans(self, text: str) -> list[tuple[str, int, int]]:
        """(kind, start, end), by kind in the order of KINDS, then start."""
        out: dict[str, list] = {k: [] for k in KINDS}
        done = dict.fromkeys([*KINDS, "9"], 0)
        for end, (anchor, n) in self.anchors.iter(text.translate(_LOWER)):  # ASCII only, so places stay
            at = end - n + 1
            if anchor == "9":
                if at >= done["9"]:
                    if _COUNTRY.match(text, max(0, at - 3), at) and (m := _IBAN.match(text, at - 2)) and iban_valid(m[1]):
                        self.add("account", m, out, done)
                    done["9"] = _DIGITS.match(text, at).end()
                    self.digits(text, at, done["9"], out, done)
            elif anchor == "@":
                self.email(text, at, out, done)
            elif anchor == "+":
                self.phone(text, at, out, done)
            elif anchor == "url":
                m = _URL.match(text, at) if at >= done["url"] else None
                if m:
                    stop = at + len(m[0].rstrip(".,;:!?)"))
                    out["url"].append((at, stop))
                    done["url"] = stop
            elif anchor == "cue":
                m = _IBAN.match(text, end + 1)
                if not (m and iban_valid(m[1])):
                    m = _NUMBER.match(text, end + 1)
                self.add("account", m, out, done)
            else:
                self.add("secret", _SECRET.match(text, end + 1), out, done)
        return [(k, a, b) for k in KINDS for a, b in out[k]]

    @staticmethod
    def add(kind: str, m, out: dict, done: dict) -> None:
        if m and m.start(1) >= done[kind]:
            out[kind].append(m.span(1))
            done[kind] = m.end(1)

    @staticmethod
    def email(text: str, at: int, out: dict, done: dict) -> None:
        start = at
        while start > done["email"] and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            out["email"].append((start, m.end()))
            done["email"] = m.end()

    @staticmethod
    def phone(text: str, at: int, out: dict, done: dict) -> None:
        m = _PHONE.match(text, at) if at >= done["phone"] else None
        if m:
            done["phone"] = m.end()
            if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
                out["phone"].append(m.span())

    @staticmethod
    def digits(text: str, at: int, run_end: int, out: dict, done: dict) -> None:
        """at begins a run of digits: a match of ip or card that begins in a run begins where the run
        does, or where the last match of its kind has ended in it."""
        start = max(at, done["ip"])
        m = _IP.match(text, start) if start < run_end else None
        if m:
            done["ip"] = m.end()
            if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
                out["ip"].append(m.span())
        start = max(at, done["card"])
        m = _CARD.match(text, start) if start < run_end else None
        if m:
            done["card"] = m.end()
            digits = re.sub("[ -]", "", m[0])
            if 16 <= len(digits) <= 19 and luhn(digits):
                out["card"].append(m.span())


_FINDER: list[Finder] = []


def finder() -> Finder:
    if not _FINDER:
        _FINDER.append(Finder())
    return _FINDER[0]


def joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    f = finder()
    for b in pieces(batches):
        found = [f.spans(t or "") for t in b.column(1).to_pylist()]
        base = [[s for s in spans if s[0] in BASE] for spans in found]
        counts = [pa.array([sum(s[0] == k for s in spans) for spans in base], pa.int64()) for k in BASE]
        sha = pa.array([hashlib.sha256(joined(s).encode()).hexdigest() for s in base], pa.string())
        arrays = [b.column(0), *counts, sha, pa.array([joined(s) for s in found], pa.string())]
        yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans"])


def op6_pii(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans for every row of docs (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return docs.mapInArrow(tidy(_find), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def mask(text: str | None) -> str | None:
    """The text with every span replaced by its kind in angle brackets; overlapping spans become one."""
    if not text:
        return text
    out, at = [], 0
    for a, b, k in sorted((a, -b, k) for k, a, b in finder().spans(text)):
        if a >= at:
            out += (text[at:a], f"<{k}>")
        at = max(at, -b)
    return "".join([*out, text[at:]])


def _mask(i: int):
    def run(batches):
        for b in pieces(batches):
            yield b.set_column(i, b.schema.field(i), pa.array([mask(t) for t in b.column(i).to_pylist()], b.schema.field(i).type))

    return run


def masked_documents(docs: DataFrame) -> DataFrame:
    """docs with personal data in text masked, and n_chars (where there is one) counted anew; all rows and columns stay."""
    names = [f"c{i}" for i in range(len(docs.columns))]  # columns go by their place, whatever their names
    kept = T.StructType([T.StructField(n, f.dataType, True) for n, f in zip(names, docs.schema.fields)])
    out = docs.toDF(*names).mapInArrow(tidy(_mask(docs.columns.index("text"))), kept).toDF(*docs.columns)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType)))
    return out
