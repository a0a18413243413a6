"""Token counts by a two-tier lookup on the map side.

Tier one is a hash table of the lengths of frequent pre-tokens, broadcast: every
task counts its pre-tokens in a bounded counter and writes its FREQUENT most
common ones as a summary, one row. Summaries are added FAN at a time, level by
level, each cut to FREQUENT again, until FAN or fewer are left. Tier two is a cache
in each worker; what it lacks is encoded by the library. No pre-token is a row or a
key of a shuffle: only summaries move, one for each task, where there are more than
FAN. The table only saves work: counts are exact whatever it holds.

A pre-token is a run of spaces with the text up to the next space or line end,
or a line end: no piece of the vocabulary crosses these places (`parted` checks
that when the model is loaded; a model that fails is counted text by text).

Defined cases: null text counts as empty, with 0 bytes and 0 tokens; repeated
rows each get a row; null doc_id is kept; a very long text is cut into pre-tokens
whole, one of which may be all of it; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimlens.llm.batches import pieces
from claimlens.llm.units import LONGEST, UnitEncoder
from claimlens.session import materialize, release

#: Rows of the broadcast table; with LONGEST characters each at most about 2 MB.
FREQUENT = 20_000
_COUNTED = 300_000
#: Summaries that are added at a time, some 300 KB each.
FAN = 16
_UNIT = re.compile(" *[^ \n]+|\n| +")
_MODELS: dict = {}
_CACHE: dict = {}


def model(path: str):
    if path not in _MODELS:
        import sentencepiece

        _MODELS[path] = sentencepiece.SentencePieceProcessor(model_file=path)
    return _MODELS[path]


def parted(path: str) -> bool:
    """Whether no piece crosses from other text to a space, or holds a line end, and a line end alone is two tokens."""
    m = model(path)
    pieces = (m.id_to_piece(i) for i in range(m.get_piece_size()))
    return not any("\n" in p or re.search("[^▁]▁", p) for p in pieces) and len(m.encode("\n")) == 2


def units(text: str) -> tuple[list[str], bool]:
    """Pre-tokens of a text, and whether they are plain.

    Plain ones come from texts without runs of spaces: a word stands for a space
    and the word (the model puts a space before every text), and a word that
    follows a line end carries that line end. Others are written out as they are.
    """
    if not text:
        return [], True
    if "▁" in text:  # the model's own sign for a space
        text = text.replace("▁", " ")
    plain = text.replace("\n", " \n").split(" ")
    return (_UNIT.findall(" " + text), False) if "" in plain else (plain, True)


class Lengths:
    """Token counts of texts by their pre-tokens."""

    def __init__(self, path: str, known: dict[str, int] | None = None):
        m = model(path)
        self.plain = UnitEncoder(lambda us: [len(x) - (u[0] == "\n") for u, x in zip(us, m.encode(us, num_threads=1))], known=known)
        # A line end is put in front so that the model adds no space to the pre-token itself.
        self.other = UnitEncoder(lambda us: [len(x) - 2 for x in m.encode(["\n" + u for u in us], num_threads=1)], kept=50_000)

    def count(self, text: str) -> int:
        us, plain = units(text)
        return sum((self.plain if plain else self.other).values(us))


_SUMMARY = "part long, units array<string>, n array<long>"


def _summary(part: int, seen: Counter) -> dict[str, pa.Array]:
    top = sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:FREQUENT]
    units, n = [u for u, _ in top], [n for _, n in top]
    return {"part": pa.array([part], pa.int64()), "units": pa.array([units], pa.list_(pa.string())), "n": pa.array([n], pa.list_(pa.int64()))}


def _common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    seen: Counter = Counter()
    for batch in batches:
        for text in batch.column(0).to_pylist():
            us, plain = units(text or "")
            if plain:
                seen.update(us)
            if len(seen) > _COUNTED:
                seen = Counter(dict(seen.most_common(_COUNTED // 2)))
    seen = Counter({u: n for u, n in seen.items() if len(u) <= LONGEST})
    if seen:
        yield pa.RecordBatch.from_pydict(_summary(TaskContext.get().partitionId(), seen))


def _added(rows) -> Counter:
    total: Counter = Counter()
    for us, n in rows:
        total.update(dict(zip(us, n)))
    return total


def _add(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
    return pa.table(_summary(key[0].as_py(), _added(zip(rows.column("units").to_pylist(), rows.column("n").to_pylist()))))


def frequent(docs: DataFrame, fan: int = FAN) -> list[str]:
    """The FREQUENT commonest pre-tokens of all docs, by the tasks' bounded summaries, at most fan of which meet in one place."""
    found = materialize(docs.select("text").mapInArrow(_common, _SUMMARY), "summaries")
    while (found.agg(F.max("part")).first()[0] or 0) >= fan:
        wide = found.withColumn("part", F.floor(F.col("part") / fan).cast("long"))
        last, found = found, materialize(wide.groupBy("part").applyInArrow(_add, _SUMMARY), "summaries")
        release(last)
    top = _summary(0, _added((r["units"], r["n"]) for r in found.collect()))["units"].to_pylist()[0]
    release(found)
    return top


def _count(path: str, table, key: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if _CACHE.get("key") != (path, key):  # a worker keeps one cache, of the corpus it counts now
            _CACHE.clear()
            _CACHE.update(key=(path, key), lengths=(Lengths(path, table.value), parted(path)))
        cache, fine = _CACHE["lengths"]
        for b in pieces(batches):
            ids, texts = b.column(0), [t or "" for t in b.column(1).to_pylist()]
            n = [cache.count(t) if fine and "\x00" not in t else len(model(path).encode(t)) for t in texts]
            size = [len(t.encode("utf-8", "surrogatepass")) for t in texts]
            yield pa.RecordBatch.from_arrays([ids, pa.array(size, pa.int64()), pa.array(n, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    return count


def op9_token_counts(docs: DataFrame, path: str, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of docs (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    common = frequent(docs)
    table = docs.sparkSession.sparkContext.broadcast(dict(zip(common, Lengths(path).plain.encode(common))) if common else {})
    out = docs.mapInArrow(_count(path, table, hash(tuple(common))), "doc_id long, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
