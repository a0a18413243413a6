"""Filter interaction audit: what every filter removes in every order, from one count for each set of failed filters.

A document is known by the set of filters it fails, so the corpus is read once
and counted by part and set. The rest is path counting over the subset lattice:
a state is a set of filters already applied, an edge applies one more. Going
forward gives the number of orders that reach a state, going backward the number
that leave it; their product is the number of orders that run over an edge. The
documents an edge removes (they fail its filter and none of the state's) times
that number, added over a filter's edges, give its Shapley sum; the steps of an
order are its edges, read from the same table. `before` forbids orders, and so
edges and paths, in which a filter comes before one that it needs.

Counting is map-side by (part, set): at most 2^n rows a part leave a task. Copies
(filter E) are found as in exact_dedup: only rows whose digest may occur again are
shuffled, and hot groups are broadcast. Labels meet (doc_id, part, set) rows, not
texts; Spark splits that join where one doc_id is hot. A part's rows, at most 2^n,
become its lattice in one row of a task; parts never meet.

Defined cases: null texts are empty, and the first of equal empty texts passes E;
a null doc_id is neither smaller nor larger than others, so E never fails it nor
others because of it, and it has no label; rows repeated in full don't fail E
because of each other; a document labelled twice counts as good (toxic) if one
label says so; a null part is the empty string; an empty table has no parts and
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimlens.llm.exact_dedup import with_groups
from claimlens.session import materialize

WORD = "[^\\x20\\x09-\\x0D]+"
FILTERS = "ABCDE"
#: Filters for which all orders are listed; a table of n! rows a part isn't for more.
MOST_FILTERS = 7


class Lattice:
    """Edges (state, filter) of the subset lattice of n filters, with the orders that run over each."""

    def __init__(self, n: int, before: Sequence[tuple[int, int]] = ()):
        """before: pairs (a, b), where a must be applied before b."""
        self.n, full = n, (1 << n) - 1
        needs = [sum(1 << a for a, b in before if b == f) for f in range(n)]
        self.edges = [(s, f) for s in range(full + 1) for f in range(n) if not s >> f & 1 and needs[f] & s == needs[f]]
        reach, leave = [0] * (full + 1), [0] * (full + 1)
        reach[0] = leave[full] = 1
        for s, f in self.edges:  # states in ascending order, so all that leads to one has been counted
            reach[s | 1 << f] += reach[s]
        for s, f in reversed(self.edges):
            leave[s] += leave[s | 1 << f]
        self.paths = {(s, f): reach[s] * leave[s | 1 << f] for s, f in self.edges}
        if not reach[full]:
            raise ValueError("no order keeps all filters after those they need")

    def orders(self) -> Iterator[tuple[int, ...]]:
        """Every allowed order, that is every path, in ascending order."""
        for order in permutations(range(self.n)):
            if all((sum(1 << g for g in order[:k]), f) in self.paths for k, f in enumerate(order)):
                yield order

    def untouched(self, counts: np.ndarray) -> np.ndarray:
        """counts by set of failed filters (rows) to counts, by state, of documents that fail none of its filters."""
        out = counts.copy()
        for f in range(self.n):  # sums over subsets, one filter at a time
            for s in range(1 << self.n):
                if s >> f & 1:
                    out[s] += out[s ^ 1 << f]
        return out[::-1]  # a state's documents fail only filters outside it


def step_table(counts: np.ndarray, names: str, lattice: Lattice) -> list[tuple]:
    """Rows (filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) of one part;
    counts: documents, good and toxic ones by set of failed filters."""
    left = lattice.untouched(counts)
    fails = [sum(counts[m, 0] for m in range(len(counts)) if m >> f & 1) for f in range(lattice.n)]
    lost = {(s, f): left[s] - left[s | 1 << f] for s, f in lattice.edges}
    share = [sum(lost[e][0] * lattice.paths[e] for e in lattice.edges if e[1] == f) for f in range(lattice.n)]
    out = []
    for order in lattice.orders():
        name, state = "".join(names[f] for f in order), 0
        for k, f in enumerate(order):
            gone, good, toxic = lost[state, f]
            state |= 1 << f
            out.append((name, k + 1, left[state][0], gone, fails[f] - gone, counts[1 << f, 0], good, toxic, share[f]))
    return out


_OUT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def _audited(names: str, lattice: Lattice):
    kinds = [pa.string(), pa.string(), pa.int32(), *[pa.int64()] * 7]
    heads = [c.split(" ")[0] for c in _OUT.split(", ")]

    def audit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, cells in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                counts = np.zeros((1 << lattice.n, 3), np.int64)
                for c in cells:
                    counts[c["failed"]] += (c["docs"], c["good"], c["toxic"])
                rows = [(part, *r) for r in step_table(counts, names, lattice)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=heads)

    return audit


def audited(states: DataFrame, names: str = FILTERS, before: Sequence[tuple[int, int]] = ()) -> DataFrame:
    """From states (part, failed, docs, good, toxic; failed: bit i for filter i of names) a row for each part, order and step."""
    if len(names) > MOST_FILTERS:
        raise ValueError(f"all orders of {len(names)} filters; at most {MOST_FILTERS} are listed")
    summed = states.groupBy("part", "failed").agg(*[F.sum(c).alias(c) for c in ("docs", "good", "toxic")])
    parts = summed.groupBy("part").agg(F.collect_list(F.struct("failed", "docs", "good", "toxic")).alias("cells"))
    return parts.mapInArrow(_audited(names, Lattice(len(names), before)), _OUT)


def failed_bits(text: Column) -> Column:
    """The filters A to D that a text fails, as bits 0 to 3."""
    words = F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1))
    n, different = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    conditions = (n < 100, 100 * different < 80 * n, 100 * capitals.cast("long") > 10 * F.char_length(text).cast("long"), text.rlike("[#$%&*|]"))
    return sum((F.when(c, 1 << i).otherwise(0) for i, c in enumerate(conditions)), F.lit(0))


def failures(docs: DataFrame) -> DataFrame:
    """(doc_id, part, failed) for every row of docs: filters A to E as bits 0 to 4."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), failed_bits(text).alias("failed"), F.unhex(F.sha2(text, 256)).alias("digest"))
    rows = materialize(rows, "failures")
    known = with_groups(rows.where("doc_id is not null"), F.col("doc_id"), "first")
    copy = F.when(F.col("doc_id") > F.col("first"), 16).otherwise(0)
    nameless = rows.where("doc_id is null").select("doc_id", "part", "failed")
    return known.select("doc_id", "part", (F.col("failed") + copy).alias("failed")).unionByName(nameless)


def states(failed: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, failed, docs, good, toxic) counted over failures; a part and set may have two rows, one with labels."""
    marks = labels.where("doc_id is not null and (quality = 1 or toxic = 1)").groupBy("doc_id").agg(
        F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).cast("long").alias("good"),
        F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).cast("long").alias("toxic"),
    )
    zero = F.lit(0).cast("long")
    docs = failed.groupBy("part", "failed").agg(F.count(F.lit(1)).alias("docs")).select("part", "failed", "docs", zero.alias("good"), zero.alias("toxic"))
    marked = failed.join(marks, "doc_id").groupBy("part", "failed").agg(F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))
    return docs.unionByName(marked.select("part", "failed", zero.alias("docs"), "good", "toxic"))


def op11_filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley:
    five rows for each part and each of the 120 orders of the filters A to E."""
    return audited(states(materialize(failures(docs), "failed"), labels))


def oracle() -> str:
    """The same in DuckDB's SQL, order by order."""
    word = r"[^\x20\x09-\x0D]+"
    return f"""
with d as (select doc_id, coalesce(text, '') as t, coalesce(lang, '') as part from documents),
w as (select *, regexp_extract_all(t, '{word}') as ws, min(doc_id) over (partition by t) as first from d),
f as (select doc_id, part, (len(ws) < 100)::int + 2 * (100 * len(list_distinct(ws)) < 80 * len(ws))::int
             + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t))::int
             + 8 * regexp_matches(t, '[#$%&*|]')::int + 16 * coalesce(doc_id > first, false)::int as failed from w),
l as (select doc_id, max((quality = 1)::int) as good, max((toxic = 1)::int) as toxic from labels group by doc_id),
h as (select part, failed, count(*) as docs, sum(coalesce(good, 0)) as good, sum(coalesce(toxic, 0)) as toxic from f left join l using (doc_id) group by all),
x as (select unnest(range(5)) as b),
o as (select [a.b, b.b, c.b, d.b, e.b] as p from x a, x b, x c, x d, x e where len(list_distinct([a.b, b.b, c.b, d.b, e.b])) = 5),
s as (select list_aggregate([chr((65 + y)::int) for y in p], 'string_agg', '') as filter_order, k as step,
             p[k] as b, coalesce(list_sum([(1 << y)::int for y in p[1:k - 1]]), 0)::int as done from o, range(1, 6) r(k)),
q as (select part, filter_order, step, b,
             coalesce(sum(docs) filter (failed & (done | (1 << b)::int) = 0), 0) as kept,
             coalesce(sum(docs) filter (failed & done = 0 and (failed >> b) & 1 = 1), 0) as removed,
             coalesce(sum(docs) filter (failed & done <> 0 and (failed >> b) & 1 = 1), 0) as redundant,
             coalesce(sum(docs) filter (failed = (1 << b)::int), 0) as unique_fails,
             coalesce(sum(good) filter (failed & done = 0 and (failed >> b) & 1 = 1), 0) as good_lost,
             coalesce(sum(toxic) filter (failed & done = 0 and (failed >> b) & 1 = 1), 0) as toxic_lost
      from h, s group by all)
select part, filter_order, step::int as step, kept::bigint as kept, removed::bigint as removed, redundant::bigint as redundant,
       unique_fails::bigint as unique_fails, good_lost::bigint as good_lost, toxic_lost::bigint as toxic_lost,
       (sum(removed) over (partition by part, b))::bigint as shapley from q"""
