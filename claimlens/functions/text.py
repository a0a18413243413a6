"""Normalizers, parsers and renderers as functions on columns; none but canonical_text is a function in Python."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Titles dropped from names, spelling substitutions in order,
# address words (an empty value drops the word), editor names in metadata.
HONORIFICS = (
    "mr mrs ms miss dr prof shri sri smt kum thiru thirumathi tmt selvi selvan master md s/o d/o w/o c/o so do wo co"
).split()
SPELLINGS = [
    ("tch", "c"), ("th", "t"), ("dh", "d"), ("bh", "b"), ("gh", "g"), ("kh", "k"), ("ph", "f"), ("sh", "s"), ("ch", "c"),
    ("ck", "k"), ("ee", "i"), ("ea", "i"), ("oo", "u"), ("ou", "u"), ("aa", "a"), ("ii", "i"), ("uu", "u"), ("w", "v"),
    ("z", "j"), ("x", "ks"), ("q", "k"), ("y$", "i"),
]
ADDRESS_WORDS = {
    "st": "street", "str": "street", "rd": "road", "ro": "road", "ave": "avenue", "av": "avenue", "ln": "lane", "blk": "block",
    "bldg": "building", "apt": "apartment", "apts": "apartment", "flr": "floor", "fl": "floor", "ngr": "nagar", "ngar": "nagar",
    "clny": "colony", "col": "colony", "crs": "cross", "mn": "main", "ext": "extension", "extn": "extension", "opp": "opposite",
    "nr": "near", "behind": "behind", "no": "", "num": "", "door": "", "dno": "", "d.no": "",
}
EDITORS = r"(?i)photoshop|gimp|paint\.net|pixlr|canva|affinity|pixelmator|snapseed|picsart|lightroom|sejda|pdf.?escape|pdf.?filler"


@lru_cache(maxsize=1)
def _accents() -> tuple[str, str]:
    """Letters that decompose into one base letter and marks, and those base letters."""
    pairs = []
    for code in range(0xC0, 0x2000):
        plain = "".join(c for c in unicodedata.normalize("NFD", chr(code)) if not 0x300 <= ord(c) <= 0x36F)
        if len(plain) == 1 and plain != chr(code):
            pairs.append((chr(code), plain))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def strip_diacritics(c: Column) -> Column:
    a, b = _accents()
    return F.regexp_replace(F.translate(c, a, b), "[̀-ͯ]", "")


def transliterate(token: Column) -> Column:
    for pattern, to in SPELLINGS:
        token = F.regexp_replace(token, pattern, to)
    return F.regexp_replace(token, r"(.)\1+", "$1")


def _tokens(c: Column) -> Column:
    return F.filter(F.split(c, " "), lambda t: t != "")


def name_tokens(c: Column) -> Column:
    """Words of a name without titles, still as written (lower case, plain letters)."""
    clean = F.regexp_replace(F.lower(strip_diacritics(F.coalesce(c, F.lit("")))), r"[^a-z\s./]|[./]", " ")
    return F.filter(_tokens(F.regexp_replace(clean, r"\s+", " ")), lambda t: ~t.isin(HONORIFICS))


def normalize_name(c: Column) -> Column:
    """struct(canonical, tokens, initials); null and empty give an empty name."""
    words = name_tokens(c)
    tokens = F.filter(F.transform(F.filter(words, lambda t: F.length(t) > 1), transliterate), lambda t: t != "")
    initials = F.filter(words, lambda t: F.length(t) == 1)
    return F.struct(F.array_join(tokens, " ").alias("canonical"), tokens.alias("tokens"), initials.alias("initials"))


def normalize_address(c: Column) -> Column:
    clean = F.regexp_replace(F.lower(strip_diacritics(F.coalesce(c, F.lit("")))), r"\b(\d+)(st|nd|rd|th)\b", "$1")
    words = _tokens(F.regexp_replace(F.regexp_replace(clean, r"[^a-z0-9\s]", " "), r"\s+", " "))
    known = F.create_map(*[F.lit(x) for pair in ADDRESS_WORDS.items() for x in pair])
    full = F.filter(F.transform(words, lambda t: F.coalesce(F.try_element_at(known, t), t)), lambda t: t != "")
    return F.array_join(F.transform(full, lambda t: F.when(t.rlike(r"^\d+$"), t).otherwise(transliterate(t))), " ")


def normalize_phone(c: Column) -> Column:
    digits = F.right(F.regexp_replace(c, r"\D", ""), F.lit(10))
    return F.when(digits.rlike("^[6-9][0-9]{9}$"), digits)


def normalize_rupees(c: Column) -> Column:
    whole = F.regexp_replace(F.regexp_extract(c, r"(\d[\d,]*)(\.\d+)?", 1), ",", "")
    n = whole.try_cast("bigint")
    return F.when(n <= 9007199254740991, n)


def parse_income(c: Column) -> Column:
    n = F.regexp_replace(F.split_part(c, F.lit("/"), F.lit(1)), r"\D", "").try_cast("bigint")
    return F.when(n.between(1000, 100_000_000), n)


_UNITS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
_TENS = ", , twenty thirty forty fifty sixty seventy eighty ninety".split()
NUMBER_WORDS = {w: i for i, w in enumerate(_UNITS) if i} | {w: 10 * i for i, w in enumerate(_TENS) if i > 1}
GROUPS = {"thousand": 1000, "lakh": 100_000, "crore": 10_000_000}


def parse_income_words(c: Column) -> Column:
    """Number words with thousand, lakh and crore closing a group; null where there are none or they give 0."""
    small = F.create_map(*[F.lit(x) for w, n in NUMBER_WORDS.items() for x in (w, float(n))])
    large = F.create_map(*[F.lit(x) for w, n in GROUPS.items() for x in (w, float(n))])
    zero = F.lit(0.0)
    start = F.struct(zero.alias("total"), zero.alias("part"), F.lit(False).alias("seen"))

    def step(acc, word):
        n, g = F.try_element_at(small, word), F.try_element_at(large, word)
        part = F.when(n.isNotNull(), acc["part"] + n).when(word == "hundred", F.greatest(acc["part"], F.lit(1.0)) * 100).otherwise(acc["part"])
        return F.struct(
            F.when(g.isNotNull(), acc["total"] + F.greatest(acc["part"], F.lit(1.0)) * g).otherwise(acc["total"]).alias("total"),
            F.when(g.isNotNull(), zero).otherwise(part).alias("part"),
            (acc["seen"] | n.isNotNull() | g.isNotNull() | (word == "hundred")).alias("seen"),
        )

    words = _tokens(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z]+", " "))
    return F.aggregate(words, start, step, lambda a: F.when(a["seen"] & (a["total"] + a["part"] > 0), (a["total"] + a["part"]).cast("bigint")))


def format_inr(c: Column) -> Column:
    """Rupees in groups of 3, then 2 digits."""
    s = c.cast("bigint").cast("string")
    head = F.regexp_replace(F.left(s, F.length(s) - 3), r"(\d)(?=(\d\d)+$)", "$1,")
    return F.concat(F.lit("₹"), F.when(F.length(s) > 3, F.concat(head, F.lit(","), F.right(s, F.lit(3)))).otherwise(s))


def amount_in_words(c: Column) -> Column:
    units, tens = (F.array(*[F.lit(w.strip(",").title()) for w in ws]) for ws in (_UNITS, _TENS))
    zero = F.lit("")

    def below_100(n):
        n = n.cast("int")
        two = F.concat_ws(" ", F.get(tens, (n / 10).cast("int")), F.when(n % 10 > 0, F.get(units, n % 10)))
        return F.when(n == 0, zero).when(n < 20, F.get(units, n)).otherwise(two)

    def part(n, word):
        return F.when(n > 0, F.concat(below_100(n), F.lit(f" {word}")))

    n = c.cast("bigint")
    lakh, thousand, hundred = F.floor(n / 100_000), F.floor(n / 1000) % 100, F.floor(n / 100) % 10
    words = F.concat_ws(" ", part(lakh, "Lakh"), part(thousand, "Thousand"), part(hundred, "Hundred"), F.when(n % 100 > 0, below_100(n % 100)))
    return F.concat(F.when(n == 0, F.lit("Zero")).otherwise(words), F.lit(" Rupees Only"))


def parse_family_size(c: Column) -> Column:
    n = F.regexp_replace(c, r"\D", "").try_cast("int")
    return F.when(n.between(1, 30), n)


_DASHES = {0x2013: "-", 0x2014: "-"}


@F.arrow_udf(StringType())
def canonical_text(c: pa.Array) -> pa.Array:
    """A text for comparing readings: compatibility forms taken apart, dashes alike, other marks as spaces, single spaces,
    case folded; null is empty. There is no built-in for the first and the last, so it is a function on Arrow batches."""

    def one(text: str | None) -> str:
        text = unicodedata.normalize("NFKD", text or "").translate(_DASHES)
        return " ".join(re.sub(r"[^\w\s-]", " ", text).split()).casefold()

    return pa.array(map(one, c.to_pylist()), pa.string())


def serial_tail(c: Column) -> Column:
    """struct(series, serial): letters of what stands before the last digits, and those digits as a number."""
    up = F.upper(F.trim(c))
    return F.struct(
        F.regexp_replace(F.regexp_extract(up, r"^(.*?)(\d+)$", 1), "[^A-Z]", "").alias("series"),
        F.regexp_extract(up, r"^(.*?)(\d+)$", 2).try_cast("bigint").alias("serial"),
    )


def describe_gap(a: Column, b: Column) -> Column:
    gap, top = F.abs(a - b), F.greatest(a, b)
    return F.concat(format_inr(gap), F.lit(" ("), F.round(100 * gap / top).cast("int").cast("string"), F.lit("%)"))


def alnum(c: Column) -> Column:
    return F.regexp_replace(F.upper(c), "[^A-Z0-9]", "")


def digits(c: Column) -> Column:
    return F.regexp_replace(c, r"\D", "")


def editing_software(tag: Column) -> Column:
    """Whether a metadata tag names an editor; false for null."""
    return F.coalesce(tag.rlike(EDITORS), F.lit(False))


def verification_url(base: str, certificate: Column, district: Column) -> Column:
    """A portal link with its two parameters percent-encoded."""
    value = lambda c: F.url_encode(F.coalesce(c, F.lit("")))
    return F.concat(F.lit(f"{base}?certificateNo="), value(certificate), F.lit("&district="), value(district))


def skeleton(tokens: Column) -> Column:
    return F.transform(tokens, lambda t: F.concat(F.left(t, F.lit(1)), F.regexp_replace(F.substring(t, 2, 1000), "[aeiouy]", "")))


def person_key(c: Column) -> Column:
    return F.lower(F.regexp_replace(F.btrim(c), r"\s+", " "))


def applicant_stage(status: Column) -> Column:
    return F.when(status == "submitted", "submitted").when(status.isin("approved", "rejected", "trashed"), "decided").otherwise("under_review")


def safe_cell(c: Column) -> Column:
    """A value that no spreadsheet reads as a formula; numbers stay as they are."""
    s = c.cast("string")
    return F.when(s.rlike("^[=+\\-@\\t\\r]") & ~s.rlike(r"^-?\d+(\.\d+)?$"), F.concat(F.lit("'"), s)).otherwise(s)


def csv_cell(c: Column) -> Column:
    """A safe cell with RFC 4180 quotes."""
    safe = safe_cell(c)
    quoted = F.concat(F.lit('"'), F.replace(safe, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(safe.rlike('[",\\n\\r]'), quoted).otherwise(F.coalesce(safe, F.lit("")))


def submitter_hash(key: bytes, c: Column) -> Column:
    """HMAC-SHA256 by its definition over the built-in hash."""
    import hashlib

    k = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner = F.sha2(F.concat(F.lit(bytes(b ^ 0x36 for b in k)), c.cast("binary")), 256)
    return F.sha2(F.concat(F.lit(bytes(b ^ 0x5C for b in k)), F.unhex(inner)), 256)


def sniff_type(content: Column) -> Column:
    head = F.hex(F.substring(content, 1, 12))
    pdf = F.locate("%PDF-", F.substring(content, 1, 9).cast("string"))
    return (
        F.when(head.startswith("FFD8FF"), "image/jpeg").when(head.startswith("89504E470D0A1A0A"), "image/png")
        .when(head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250"), "image/webp").when(pdf.between(1, 5), "application/pdf")
    )
