"""Substring dedup by hashing short runs of lines, paragraphs of a least number of words.

Texts are cut at line ends; a line's normal form is its words, lower-cased, with
single spaces, and lines without words don't count. The units are runs of lines that
follow each other and hold `least` words or more, but would not without their first
or without their last line; a line of that many words is a unit alone. Units are
grouped over the whole corpus by the digest of their lines; the occurrence that ranks
first (by doc_id, then place) is kept, and the lines of every later one are removed.
Every longer run of lines that stood elsewhere before is covered by such units, and
each line that goes stands in a unit that is found whole, in this order, at one
earlier place: lines put together from different places stay. What stays of a text
keeps its offsets in the original (code points, end exclusive).

`least` says from how many words on a repeated run of whole lines is a passage. By
default it is 15 (LEAST_WORDS): a sentence. Shorter lines that many documents share, such as a
license notice, stay, unless they are part of a longer repeated run.

Digests are 16 bytes; the group of a digest is never gathered: the first
occurrence is a minimum, combined on the map side, written, and joined back to
the units (a join of two written tables, which Spark splits where a digest is hot).
Only texts that a bit map of the rows with repeated units leaves in doubt are shuffled.

Defined cases: null text has no units and stays null; lines without words always
stay; of a passage that a document repeats only the first stays, and a unit that
overlaps its own first occurrence loses only what lies beyond that; rows with null
doc_id rank last; rows of one doc_id, or repeated in full, are told apart by an
arbitrary row number, so one of them keeps its units; a very long text is one row
of a task, its units are rows of their own; an empty table gives an empty result;
other columns, whatever their names, are carried through by `deduplicated`.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimlens.llm.batches import free, pieces
from claimlens.llm.bits import bit_map
from claimlens.session import materialize, release

LEAST_WORDS = 15
SPACE, WORD = "[\\x20\\x09-\\x0D]+", "[^\\x20\\x09-\\x0D]+"
_BLANK = " \t\n\v\f\r"


def runs(words: list[int], least: int) -> set[tuple[int, int]]:
    """First and last place of the runs of least words or more that have fewer without their first or without their last line."""
    out, first, n = set(), 0, 0
    for last, more in enumerate(words):
        n += more
        ended = n >= least
        while n >= least:  # the shortest run from each first place
            out.add((first, last))
            n -= words[first]
            first += 1
        if ended:  # the last of them is the shortest to this last place
            continue
        at, m = first, n
        while at and m < least:
            at -= 1
            m += words[at]
        if m >= least:
            out.add((at, last))
    return out


def _units(least: int):
    def units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word = re.compile(WORD)
        for b in pieces(batches):
            out = []
            for row, doc_id, text in zip(*(c.to_pylist() for c in b.columns)):
                lines = [(i, w) for i, line in enumerate((text or "").split("\n")) if (w := word.findall(line.lower()))]
                digests = [hashlib.md5(" ".join(w).encode()).digest() for _, w in lines]
                for first, last in runs([len(w) for _, w in lines], least):
                    digest = hashlib.md5(b"".join(digests[first : last + 1])).digest()
                    out.append((digest, row, doc_id, lines[first][0], lines[last][0]))
            made = zip(zip(*out), (pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int32()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in made], names=["digest", "row", "doc_id", "start", "end"])

    return units


def units(docs: DataFrame, least: int) -> DataFrame:
    """(digest, row, doc_id, start, end): the units of docs (row, doc_id, text) and the places of their first and last line."""
    return docs.select("row", "doc_id", "text").mapInArrow(_units(least), "digest binary, row long, doc_id long, start int, end int")


def repeats(docs: DataFrame, least: int) -> DataFrame:
    """(row, marks), written: the units that occur twice or more, by row; their lines from `after` on repeat an earlier occurrence."""
    all_units = materialize(units(docs, least), "units")
    rank = F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "row", "start", "end")
    first = all_units.groupBy("digest").agg(F.min(rank).alias("m"), F.count(F.lit(1)).alias("c")).where("c > 1")
    first = materialize(first.select("digest", F.col("m.row").alias("mr"), F.col("m.end").alias("me")), "firsts")
    after = F.when(F.col("row") == F.col("mr"), F.greatest(F.col("start"), F.col("me") + 1)).otherwise(F.col("start"))
    again = all_units.join(first, "digest").select("row", F.struct("start", "end", after.alias("after")).alias("mark"))
    marks = materialize(again.groupBy("row").agg(F.collect_list("mark").alias("marks")), "marks")
    release(all_units, first)
    return marks


def _covered(n: int, spans: list[tuple[int, int]]) -> np.ndarray:
    """For each of n places whether one of the spans (first and last place) holds it."""
    edges = np.zeros(n + 1, np.int64)
    ends = np.array([(a, b + 1) for a, b in spans if a <= b], np.int64).reshape(-1, 2)
    np.add.at(edges, ends[:, 0], 1)
    np.add.at(edges, ends[:, 1], -1)
    return np.cumsum(edges[:n]) > 0


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
_TYPES = {
    "doc_id": pa.int64(), "n_units": pa.int64(), "n_removed": pa.int64(), "n_repeated": pa.int64(), "kept_chars": pa.int64(),
    "offsets": _SPANS, "removed": _SPANS, "text": pa.string(), "text_sha256": pa.string(),
}
_REST = (
    "doc_id long, n_units long, n_removed long, n_repeated long, kept_chars long, offsets array<struct<start:int,end:int>>, "
    "removed array<struct<start:int,end:int>>, text string, text_sha256 string"
)


def _left(doc_id, text: str | None, marks, with_text: bool) -> tuple:
    """What stays of a text: places by one running sum over the lines."""
    if text is None:
        return (doc_id, 0, 0, 0, 0, [], [], None, None)
    lines, marks = text.split("\n"), marks or []
    worded = np.array([bool(line.strip(_BLANK)) for line in lines])
    gone = worded & _covered(len(lines), [(m["after"], m["end"]) for m in marks])
    repeated = worded & _covered(len(lines), [(m["start"], m["end"]) for m in marks])
    at, kept, offsets, removed = 0, [], [], []
    for i, line in enumerate(lines):
        span = {"start": at, "end": at + len(line)}
        if gone[i]:
            removed.append(span)
        else:
            kept.append(line)
            offsets.append(span)
        at += len(line) + 1
    left = "\n".join(kept)
    sha = hashlib.sha256(left.encode("utf-8", "surrogatepass")).hexdigest()
    return (doc_id, len(lines), int(gone.sum()), int(repeated.sum()), len(left), offsets, removed, left if with_text else None, sha)


def _rest(with_text: bool):
    """Batches of doc_id, text, marks and other columns; the latter are given as they are, after the results."""

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            out = [_left(*row, with_text) for row in zip(*(b.column(i).to_pylist() for i in range(3)))]
            made = [pa.array(c, t) for c, t in zip(zip(*out), _TYPES.values())]
            yield pa.RecordBatch.from_arrays([*made, *b.columns[3:]], names=[*_TYPES, *b.schema.names[3:]])

    return rest


def rest(docs: DataFrame, with_text: bool, least: int = LEAST_WORDS) -> DataFrame:
    """What stays of every row of docs: counts, offsets of lines kept and removed, text if asked for, its digest; then _0, _1 and so on:
    the other columns of docs in their order."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")] if with_text else []
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(others)])
    docs = materialize(docs.withColumn("row", F.monotonically_increasing_id()), "docs")
    marks = repeats(docs, least)
    bits = docs.sparkSession.sparkContext.broadcast(bit_map(marks, F.xxhash64("row")))

    @F.pandas_udf("boolean")
    def doubtful(hashes: pd.Series) -> pd.Series:
        return pd.Series(bits.value.hits(hashes.to_numpy(np.int64).view(np.uint64)))

    mark = doubtful(F.xxhash64("row"))
    some = docs.where(mark).join(marks, "row", "left")
    both = some.unionByName(docs.where(~mark).withColumn("marks", F.lit(None).cast(marks.schema["marks"].dataType)))
    both = both.select("doc_id", "text", "marks", *[f"_{i}" for i in range(len(others))])
    schema = T.StructType([*T._parse_datatype_string(_REST).fields, *[docs.schema[f"_{i}"] for i in range(len(others))]])
    return both.mapInArrow(_rest(with_text), schema)


def _shown(spans: str):
    return F.array_join(F.transform(spans, lambda p: F.concat_ws(":", p["start"], p["end"])), ",")


def op3_substrings(docs: DataFrame, least: int = LEAST_WORDS) -> DataFrame:
    """For every row of docs (doc_id, text): n_units (lines), n_removed, n_repeated (lines in repeated units, first occurrences
    included), kept_chars (length of what stays, line ends included) and removed (start:end of the removed lines in the original)."""
    return rest(docs, False, least).select("doc_id", "n_units", "n_removed", "n_repeated", "kept_chars", _shown("removed").alias("removed"))


def op3_kept_spans(docs: DataFrame, least: int = LEAST_WORDS) -> DataFrame:
    """The counts, kept (start:end of every unit that stays, in the original) and text_sha256 (of what stays) for every row of docs."""
    return rest(docs, False, least).select("doc_id", "n_units", "n_removed", "kept_chars", _shown("offsets").alias("kept"), "text_sha256")


def deduplicated(docs: DataFrame, least: int = LEAST_WORDS) -> DataFrame:
    """docs with the removed lines cut out of text, and offsets: the places (start, end) of those that stay; all rows and columns stay
    (where docs has a column of that name, an underscore is put after offsets)."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    back = {c: f"_{i}" for i, c in enumerate(others)}
    offsets = F.col("offsets").alias(free(docs.columns, "offsets"))
    return rest(docs, True, least).select(*[F.col(back.get(c, c)).alias(c) for c in docs.columns], offsets)


_LINES = f"""
with d as (select row_number() over () as rid, doc_id, text, string_split(text, chr(10)) as ls from documents),
u as (select rid, doc_id, i, ls[i] as unit from (select rid, doc_id, ls, unnest(range(1, len(ls) + 1)) as i from d)),
n as (select rid, doc_id, i, unit, len(regexp_extract_all(unit, '{WORD}')) as w,
             md5(lower(trim(regexp_replace(unit, '{SPACE}', ' ', 'g')))) as g,
             sum(length(unit) + 1) over (partition by rid order by i) as after from u),
m as (select rid, doc_id, i, w, g, row_number() over (partition by rid order by i) as k, sum(w) over (partition by rid order by i) as c from n where w > 0),
l as (select rid, list(g order by k) as gs from m group by rid),
x as (select f.rid, f.doc_id, f.i as a, t.i as b, f.k as ka, t.k as kb
      from m f join m t on f.rid = t.rid and t.k between f.k and f.k + {LEAST_WORDS} - 1
      where t.c - f.c + f.w >= {LEAST_WORDS} and (t.c - f.c < {LEAST_WORDS} or t.c - f.c + f.w - t.w < {LEAST_WORDS})),
y as (select x.rid, doc_id, a, b, md5(array_to_string(gs[ka:kb], '')) as g from x join l on x.rid = l.rid),
z as (select rid, a, b, count(*) over (partition by g) as c, first_value(rid) over v as mr, first_value(b) over v as mb
      from y window v as (partition by g order by doc_id nulls last, rid, a)),
e as (select rid, unnest(range(a, b + 1)) as i, case when rid = mr then mb + 1 else a end as f from z where c > 1),
s as (select rid, i, bool_or(i >= f) as gone from e group by rid, i),
r as (select n.rid, n.i, n.unit, after - length(unit) - 1 as x, after - 1 as y, w > 0 and s.rid is not null as repeated, w > 0 and coalesce(gone, false) as gone
      from n left join s on n.rid = s.rid and n.i = s.i)
select d.doc_id, count(r.i)::bigint as n_units, count_if(coalesce(gone, false))::bigint as n_removed,"""
_KEPT = "coalesce(length(string_agg(unit, chr(10) order by i) filter (not gone)), 0)::bigint as kept_chars,"
_FROM = "from d left join r on d.rid = r.rid group by d.rid, d.doc_id"


def oracle() -> str:
    return f"""{_LINES} count_if(coalesce(repeated, false))::bigint as n_repeated, {_KEPT}
coalesce(string_agg(x || ':' || y, ',' order by i) filter (gone), '') as removed {_FROM}"""


def kept_oracle() -> str:
    return f"""{_LINES} {_KEPT} coalesce(string_agg(x || ':' || y, ',' order by i) filter (not gone), '') as kept,
case when any_value(d.text) is not null then sha256(coalesce(string_agg(unit, chr(10) order by i) filter (not gone), '')) end as text_sha256 {_FROM}"""
