"""Lempel-Ziv phrase fingerprints.

A text is parsed, as LZ78 does, into the shortest phrases not met before; the
set of its phrases is what a compressor would learn from it. The K smallest
hashes of that set are the fingerprint, and the share of the K smallest hashes
of two fingerprints' union that both hold estimates the Jaccard likeness of the
phrase sets, which follows how well one text helps to compress the other.

The edited text, whose first half is the document's, is parsed from the middle
on: what was learnt up to there is the same.

The next document in descending order of doc_id comes from a range partitioning:
boundaries between the parts are ids from a sample, every row goes to its part
(a partition of its own), and the first row of a part also goes to the part before
it. The number of parts follows the bytes of text. No part's rows are held together:
they are read in order, and a task holds the phrases of two texts.

Defined cases: a null text is an empty one; two empty fingerprints have a
likeness of 1, an empty and another 0; null doc_id comes last; rows with one
doc_id are ordered by a hash of their text; repeated rows each get a row; in a
table of one row the next document is the row itself; a very long text is parsed
whole, in memory that follows its length; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import gc
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimlens.llm.batches import pieces

#: Hashes in a fingerprint, and bytes of text in a part.
K, PART_BYTES = 96, 32 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)


def parse(text: str, root: dict, node: dict, at: int, upto: int, ends: list[int], grown: list[dict]) -> dict:
    """Parses text[at:upto] from a node of the phrase tree (a dict for each phrase, by next character) on.

    Phrases that end are put into ends, the nodes they grew from into grown; gives
    the node where the incomplete phrase at upto stands.
    """
    end, grow = ends.append, grown.append
    for e, c in enumerate(text[at:upto], at + 1):
        known = node.get(c)
        if known is None:
            node[c] = {}
            end(e)
            grow(node)
            node = root
        else:
            node = known
    return node


def signature(text: str, ends: list[int]) -> np.ndarray:
    """The K smallest 32-bit hashes of the phrases of text that end at ends (each begins where the last has ended)."""
    if not ends:
        return np.zeros(0, np.uint32)
    n = ends[-1]
    codes = np.frombuffer(text[:n].encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(1)
    stops = np.array(ends)
    starts = np.concatenate([[0], stops[:-1]])
    place = np.arange(n) - np.repeat(starts, stops - starts)
    longest = int((stops - starts).max())
    powers = np.cumprod(np.full(longest, _BASE, np.uint64))
    h = np.add.reduceat(codes * powers[place], starts)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return np.unique((h >> np.uint64(32)).astype(np.uint32))[:K]


class Parsed:
    """A text, its fingerprint, and its parse up to the point where the edited text begins to differ."""

    def __init__(self, text: str):
        self.text, self.same = text, len(text) - len(text) // 2
        self.root: dict = {}
        self.ends: list[int] = []
        self.node = parse(text, self.root, self.root, 0, self.same, self.ends, [])
        ends, grown = self.ends.copy(), []
        parse(text, self.root, self.node, self.same, len(text), ends, grown)
        for node, e in zip(reversed(grown), reversed(ends)):  # back to the middle
            del node[text[e - 1]]
        self.signature = signature(text, ends)

    def edited(self, after: str) -> tuple[str, np.ndarray]:
        """The edited text and its fingerprint; uses up what was kept of the parse."""
        text = self.text[: self.same] + after[: len(self.text) // 2]
        parse(text, self.root, self.node, self.same, len(text), self.ends, [])
        return text, signature(text, self.ends)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of the K smallest hashes of both that are in both."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    union = np.union1d(a, b)[:K]
    return float(np.isin(union, np.intersect1d(a, b, assume_unique=True), assume_unique=True).sum() / len(union))


def shown(signature: np.ndarray) -> str:
    return signature.astype(">u4").tobytes().hex()


_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_NAMES = [x.split()[0] for x in _SCHEMA.split(", ")]
_TYPES = [{"long": pa.int64(), "string": pa.string(), "double": pa.float64()}[x.split()[1]] for x in _SCHEMA.split(", ")]


def _row(doc_id, mine: Parsed, following: Parsed) -> tuple:
    edited, other = mine.edited(following.text)
    sha = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
    near = likeness(mine.signature, other), likeness(mine.signature, following.signature)
    return (doc_id, len(mine.text), sha, shown(mine.signature), shown(other), *near)


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (part, ghost, doc_id, text) in order; a ghost is the first row of the part that follows."""
    on = gc.isenabled()
    gc.disable()  # phrase trees hold no cycles
    try:
        yield from _in_order(batches)
    finally:
        if on:
            gc.enable()


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = None
    for b in pieces(batches):
        out = []
        for part, ghost, doc_id, text in zip(*(b.column(i).to_pylist() for i in range(4))):
            one = Parsed(text or "")
            if held and held[0] == part:
                out.append(_row(*held[1:], one))
            held = None if ghost else (part, doc_id, one)
        columns = list(zip(*out)) or [()] * len(_NAMES)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES)], names=_NAMES)


def neighbours(docs: DataFrame, parts: int) -> DataFrame:
    """(part, ghost, doc_id, text): rows of each part in descending order, then the first row of the next part.

    The parts' borders and first rows are a row for each part.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("tie", F.xxhash64("text"))
    where = F.struct(F.coalesce(-F.col("doc_id").cast("decimal(20,0)"), F.lit(1e19).cast("decimal(20,0)")).alias("k"), "tie")
    keys = docs.select(F.coalesce(-F.col("doc_id").cast("double"), F.lit(1e19)).alias("k"))
    borders = sorted(set(keys.approxQuantile("k", [i / parts for i in range(1, parts)], 0.25 / parts))) if parts > 1 else []
    at = F.coalesce(-F.col("doc_id").cast("double"), F.lit(1e19))
    if borders:
        cut = F.array(*[F.lit(float(x)) for x in borders])
        part = F.size(F.filter(cut, lambda x: x < at))
    else:
        part = F.lit(0)
    keyed = docs.withColumn("part", part.cast("int"))
    firsts = keyed.groupBy("part").agg(F.min(where).alias("first")).orderBy("part").collect()
    if not firsts:
        return keyed.select("part", F.lit(False).alias("ghost"), "doc_id", "text").limit(0)
    after = {}
    for i, r in enumerate(firsts):
        n = firsts[(i + 1) % len(firsts)]["first"]
        after.setdefault((n["k"], n["tie"]), []).append(r["part"])
    rows = spark.createDataFrame([(k, t, p) for (k, t), ps in after.items() for p in ps], "k decimal(20,0), t long, to int")
    ghosts = (
        keyed.select(where.alias("w"), "doc_id", "text")
        .join(F.broadcast(rows), (F.col("w.k") == F.col("k")) & F.col("w.tie").eqNullSafe(F.col("t")))
        .dropDuplicates(["to"])
        .select(F.col("to").alias("part"), F.lit(True).alias("ghost"), "doc_id", "text", F.col("w.tie").alias("tie"))
    )
    both = keyed.select("part", F.lit(False).alias("ghost"), "doc_id", "text", "tie").unionByName(ghosts)
    dealt = both.repartitionById(parts, F.col("part")).sortWithinPartitions("part", "ghost", F.desc_nulls_last("doc_id"), "tie")
    return dealt.select("part", "ghost", "doc_id", "text")


def op5_lz_fingerprint(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """Fingerprints of every row of docs (doc_id, text) and of its edited text, and their likeness."""
    if not parts:
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        parts = max(3 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // PART_BYTES)
    return neighbours(docs, parts).mapInArrow(_prints, _SCHEMA)
