"""Exact dedup in two passes of a Bloom filter: only rows whose hash may occur again are shuffled.

Pass one: every text gets the digest of its normal form (white space deleted).
Each task writes down the slots its digests fall in (HASHES slots each, of a
table whose size follows the number of rows), and the slots are merged slice by
slice into one bit each: set where two rows or more have fallen. Pass two: a row
with a slot that nobody else has fallen in has no copy and passes straight
through. The others are grouped by digest; of a group the row that ranks first
stays. A false hit costs a shuffled row and changes nothing.

Bounds: the bits sent to tasks are 32 MB at most (bits.MOST). That leaves some 2
percent of false hits up to 16 million rows; with more rows they become more
frequent, up to a plain grouping by digest, whose rows (a digest, an id and a
rank, never a text) are what is shuffled then. Groups are combined on the map
side, and a row finds its group again without a shuffle where the group is hot:
groups of more than a HOTTEST-th of the rows are fewer than HOTTEST and are
broadcast; the others are joined by digest, with so many rows a key at most.

Defined cases: null counts as empty, and empty texts and texts of white space are
equal to each other; of rows alike in length a null doc_id ranks after any other;
rows repeated in full are copies, one of which stays; a long text is one row of a
task; an empty table gives an empty result; other columns, whatever their names,
are carried through by `deduplicated`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimlens.llm.batches import free
from claimlens.llm.bits import SLICES, BitMap, size_for
from claimlens.session import materialize, release

SPACE = "[\\x20\\x09-\\x0D]+"
#: Slots of a digest, and slots that a task holds before it hands them on (16 MB).
HASHES, HELD = 2, 1 << 22
#: A group is hot with more than one in so many of the rows.
HOTTEST = 1000


def digest(text: Column) -> Column:
    """32 bytes that are equal where texts are equal but for white space."""
    return F.unhex(F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, ""), 256))


def slots(digests: pa.Array, bits: int) -> np.ndarray:
    """A row of HASHES slots for each digest."""
    whole = b"".join(digests.to_pylist())
    return (np.frombuffer(whole, "<u4").reshape(len(digests), -1)[:, :HASHES] & np.uint32(bits - 1)).astype(np.uint32)


def _packed(values: np.ndarray) -> bytes:
    """Sorted slots as differences: mostly zero bytes, which a shuffle's compression takes out."""
    return np.diff(values, prepend=np.uint32(0)).astype("<u4").tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(raw, "<u4"), dtype=np.uint32)


def _fallen(bits: int):
    """Batches of digests to rows (slice, once, twice): slots hit at all and hit twice or more, within the slice."""
    width = bits // SLICES

    def told(held: list[np.ndarray]) -> pa.RecordBatch:
        slot, n = np.unique(np.concatenate(held), return_counts=True)
        ends = np.searchsorted(slot, np.arange(SLICES + 1, dtype=np.int64) * width)
        out = []
        for i, (a, b) in enumerate(zip(ends, ends[1:])):
            here = slot[a:b] - np.uint32(i * width)
            if len(here):
                out.append((i, _packed(here), _packed(here[n[a:b] > 1])))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.binary(), pa.binary()))], names=["slice", "once", "twice"])

    def fall(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            if b.num_rows:
                held.append(slots(b.column(0), bits).ravel())
                n += len(held[-1])
            if n >= HELD:
                yield told(held)
                held, n = [], 0
        if n:
            yield told(held)

    return fall


def _merged(width: int):
    """The slices of a task, merged one row at a time: (slice, bits), set where two rows or more have fallen."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for b in batches:
            for i, one, two in zip(*(c.to_pylist() for c in b.columns)):
                once, twice = planes.setdefault(i, (np.zeros(width, bool), np.zeros(width, bool)))
                slot = _unpacked(one)
                twice[slot] |= once[slot]
                once[slot] = True
                twice[_unpacked(two)] = True
        for i, (_, twice) in planes.items():
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([np.packbits(twice).tobytes()], pa.binary())], names=["slice", "bits"])

    return merge


def hit_twice(digests: DataFrame, rows: int) -> BitMap:
    """The slots that two or more of the digests (the one column, of so many rows) have fallen in."""
    bits = size_for(rows)
    width = bits // SLICES
    fallen = digests.mapInArrow(_fallen(bits), "slice int, once binary, twice binary").repartition(max(8, bits >> 22), "slice")
    found = {r["slice"]: bytes(r["bits"]) for r in fallen.mapInArrow(_merged(width), "slice int, bits binary").collect()}
    return BitMap(b"".join(found.get(i, bytes(width // 8)) for i in range(SLICES)))


def maybe_repeated(digests: DataFrame, rows: int):
    """A function on a column of digests: false only for digests of a single row."""
    sent = digests.sparkSession.sparkContext.broadcast(hit_twice(digests, rows))

    @F.arrow_udf("boolean")
    def hits(column: pa.Array) -> pa.Array:
        seen = sent.value
        at = slots(column, 8 * len(seen.bits)).astype(np.uint64)
        return pa.array(seen.hits(at.ravel()).reshape(at.shape).all(axis=1))

    return hits


def with_groups(rows: DataFrame, rank: Column, best: str = "best", size: str = "size") -> DataFrame:
    """rows (a written table with a column digest), each with the least rank of its digest and the number of its copies.

    Rows without a copy have their own rank and 1.
    """
    n = rows.count()
    hits = maybe_repeated(rows.select("digest"), n)
    ranked = rows.withColumn(best, rank)
    alone = ranked.where(~hits("digest")).withColumn(size, F.lit(1).cast("long"))
    maybe = materialize(ranked.where(hits("digest")), "maybe")
    groups = maybe.groupBy("digest").agg(F.min(best).alias("_first"), F.count(F.lit(1)).alias("_copies")).where("_copies > 1")
    groups = materialize(groups, "groups")
    hot = F.col("_copies") > F.lit(max(1, n // HOTTEST))
    near = maybe.join(F.broadcast(groups.where(hot)), "digest", "left")
    found = near.where("_copies is not null")
    rest = near.where("_copies is null").drop("_first", "_copies").join(groups.where(~hot), "digest", "left")
    told = [c for c in ranked.columns if c != best]
    take = [*told, F.coalesce("_first", best).alias(best), F.coalesce("_copies", F.lit(1)).cast("long").alias(size)]
    return alone.select(*told, best, size).unionByName(found.select(*take)).unionByName(rest.select(*take))


def op13_exact_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of docs."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.char_length(text).cast("long").alias("n_chars"), digest(F.col("text")).alias("digest"), F.monotonically_increasing_id().alias("row"))
    rank = F.struct((-F.col("n_chars")).alias("n"), F.col("doc_id").isNull().alias("z"), F.col("doc_id").alias("id"), F.col("row").alias("row"))
    return with_groups(materialize(rows, "digests"), rank).select(
        "doc_id", F.col("best.id").alias("keep_id"), F.col("size").alias("group_size"),
        (F.col("best.row") == F.col("row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"),
    )


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all their columns: of equal texts the longest, then that of the smallest doc_id.

    Rows without a copy aren't shuffled. Rows of one doc_id and length are told
    apart by their texts. Texts are read twice, which costs less than writing them.
    """
    key = free(docs.columns, "digest")
    digests = materialize(docs.select(digest(F.col("text")).alias("digest")), "digests")
    hits = maybe_repeated(digests, digests.count())
    release(digests)
    whole = [F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]
    keyed = docs.withColumn(key, digest(F.col("text")))
    alone = keyed.where(~hits(key)).select(*whole)
    text = F.coalesce("text", F.lit(""))
    rank = F.struct((-F.char_length(text)).alias("n"), F.col("doc_id").isNull().alias("z"), "doc_id", text.alias("t"))
    groups = keyed.where(hits(key)).groupBy(key).agg(F.min_by(F.struct(*whole), rank).alias("first"))
    return alone.unionByName(groups.select("first.*"))


def oracle() -> str:
    """The same in DuckDB's SQL."""
    return """
with d as (select row_number() over () as rid, doc_id, coalesce(text, '') as t from documents),
h as (select rid, doc_id, length(t) as n, sha256(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g')) as text_sha256 from d),
r as (select *, row_number() over best as place, first_value(doc_id) over best as keep_id, count(*) over (partition by text_sha256) as group_size
      from h window best as (partition by text_sha256 order by n desc, doc_id nulls last, rid))
select doc_id, keep_id, group_size::bigint as group_size, place = 1 as kept, text_sha256 from r"""
