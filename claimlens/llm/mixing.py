"""Mixing sources to target weights by min-cost flow over membership patterns.

Documents are summed by the set of sources they belong to (their pattern). A
flow carries words from patterns to source quotas; using a pattern's words a
second or third time costs more than the first (convex repetition costs), so
repeats are spread as evenly as the quotas allow. Seeded hashes then pick the
documents: every document of a group is taken floor(quota / size) times and
those up to a hash cut-off once more.

Only sums travel: patterns and cut-offs are small tables whose row count is
checked (MAX_PATTERNS) before they are collected or broadcast; no window ever
holds more than a 2^-20 share of a group's hash range.

Defined cases: null text has 0 words and is never taken; a null source is a
source of its own, last in order; rows repeated in full are taken alike, as one
document of their words together (they are summed before any window); a very long
text is one row, of which only its number of words travels; an empty table gives an
empty result; other columns, whatever their names, are carried through.
"""

from __future__ import annotations

from collections import defaultdict, deque
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimlens.session import materialize

MAX_PATTERNS = 200_000
WORD = r"[^\x20\x09-\x0D]+"
_BITS = 10


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: dict, weights: Sequence[float], max_repeats: int) -> dict:
    """Target words of each source: all words shared out by weight, in code point
    order with null last; a target above max_repeats times its source stops there
    and the excess goes to the others by weight until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: float(weights[i % len(weights)]) for i, s in enumerate(order)}
    left, open_, out = float(sum(sizes.values())), set(order), {}
    while open_:
        per = left / sum(weight[s] for s in open_)
        full = [s for s in order if s in open_ and per * weight[s] > max_repeats * sizes[s]]
        if not full:
            return out | {s: per * weight[s] for s in open_}
        for s in full:
            out[s] = float(max_repeats * sizes[s])
            left -= out[s]
            open_.discard(s)
    return out


class _Flow:
    """Augmenting-path flow on integers (breadth-first levels, then blocking paths)."""

    def __init__(self):
        self.to, self.cap, self.out = [], [], defaultdict(list)

    def arc(self, a, b, cap: int) -> int:
        for x, y, c in ((a, b, cap), (b, a, 0)):
            self.out[x].append(len(self.to))
            self.to.append(y)
            self.cap.append(c)
        return len(self.to) - 2

    def run(self, s, t) -> None:
        while True:
            level, queue = {s: 0}, deque([s])
            while queue:
                a = queue.popleft()
                for e in self.out[a]:
                    if self.cap[e] and self.to[e] not in level:
                        level[self.to[e]] = level[a] + 1
                        queue.append(self.to[e])
            if t not in level:
                return
            at = dict.fromkeys(level, 0)
            path = []
            node = s
            while True:
                if node == t:
                    got = min(self.cap[e] for e in path)
                    for e in path:
                        self.cap[e] -= got
                        self.cap[e ^ 1] += got
                    node, path = s, []
                    continue
                edges = self.out[node]
                while at[node] < len(edges):
                    e = edges[at[node]]
                    if self.cap[e] and level.get(self.to[e], -1) == level[node] + 1:
                        break
                    at[node] += 1
                if at[node] < len(edges):
                    path.append(edges[at[node]])
                    node = self.to[path[-1]]
                elif node == s:
                    break
                else:
                    node = self.to[path.pop() ^ 1]
                    at[node] += 1


def route(patterns: list[tuple[tuple, int]], quotas: dict, max_repeats: int) -> dict:
    """Words that flow from each pattern to each of its sources.

    The cost of a word depends only on how often it has been used, and rises, so
    shortest augmenting paths use the first repetition level of every pattern
    before the second of any: the flow is raised level by level, and each level
    keeps what the one before has routed.
    """
    flow, arcs, supply = _Flow(), {}, []
    for i, (members, size) in enumerate(patterns):
        supply.append(flow.arc("from", ("p", i), 0))
        for s in members:
            arcs[i, s] = flow.arc(("p", i), ("s", s), max_repeats * size)
    for s, quota in quotas.items():
        flow.arc(("s", s), "to", int(quota))
    for _ in range(max_repeats):
        for i, (_, size) in enumerate(patterns):
            flow.cap[supply[i]] += size
        flow.run("from", "to")
    return {key: flow.cap[e ^ 1] for key, e in arcs.items()}


def _pattern(members: Column) -> Column:
    return F.to_json(F.array_sort(F.array_distinct(members)), {"ignoreNullFields": "false"})


def plan(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), max_repeats: int = 3) -> DataFrame:
    """Cut-offs by (pattern, source) for rows that have _mix_members, _mix_size, _mix_hash."""
    spark = docs.sparkSession
    by_pattern = docs.groupBy(_pattern(F.col("_mix_members")).alias("key")).agg(
        F.first("_mix_members").alias("members"), F.sum("_mix_size").alias("size")
    )
    rows = by_pattern.limit(MAX_PATTERNS + 1).collect()
    if len(rows) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns")
    keys = sorted((r["key"], tuple(dict.fromkeys(r["members"])), int(r["size"])) for r in rows)
    sizes: dict = defaultdict(int)
    for _, members, size in keys:
        for s in members:
            sizes[s] += size
    goal = targets(sizes, weights, max_repeats)
    flow = route([(m, size) for _, m, size in keys], {s: round(g) for s, g in goal.items()}, max_repeats)
    parts = []
    for i, (key, members, _) in enumerate(keys):
        total, lo = sum(flow[i, s] for s in members), 0.0
        for n, s in enumerate(members):
            share = flow[i, s] / total if total else float(n == 0)
            if share:
                hi = 2.0 if n == len(members) - 1 or lo + share >= 1 - 1e-12 else lo + share
                parts.append((len(parts), key, s, lo, hi, flow[i, s], int(sizes[s]), float(goal[s])))
                lo = hi
    names = "grp int, key string, source string, lo double, hi double, quota long, source_size long, target double"
    groups = spark.createDataFrame(parts, names)

    slim = _grouped(docs, groups).select("grp", "quota", "_mix_size", "_mix_hash")
    total = slim.groupBy("grp", "quota").agg(F.sum("_mix_size").alias("all"))
    reps = F.when(F.col("all") > 0, F.least(F.floor(F.col("quota") / F.col("all")), F.lit(max_repeats))).otherwise(0)
    want = total.withColumn("reps", reps.cast("long")).withColumn(
        "rest", F.when(F.col("reps") < max_repeats, F.col("quota") - F.col("reps") * F.col("all")).otherwise(0)
    )
    # The cut-off is narrowed by ten bits of the hash at a time; each step sums bins, not rows.
    edge = want.select("grp", "rest", F.lit(0).cast("long").alias("before"), F.lit(0).cast("long").alias("prefix"))
    for step in (1, 2):
        shift = 64 - _BITS * step
        edge = F.broadcast(edge.select("grp", "rest", "before", "prefix"))
        inside = slim.join(edge, "grp").where(
            (F.lit(step == 1)) | (F.shiftrightunsigned("_mix_hash", shift + _BITS) == F.col("prefix"))
        )
        bins = inside.groupBy("grp", "rest", "before", F.shiftrightunsigned("_mix_hash", shift).alias("bin")).agg(
            F.sum("_mix_size").alias("words")
        )
        w = Window.partitionBy("grp").orderBy("bin")
        bins = bins.withColumn("upto", F.col("before") + F.sum("words").over(w))
        edge = (
            bins.where("upto > rest")
            .groupBy("grp", "rest")
            .agg(F.min(F.struct("bin", (F.col("upto") - F.col("words")).alias("before"))).alias("m"))
            .select("grp", "rest", F.col("m.before").alias("before"), F.col("m.bin").alias("prefix"))
        )
    last = slim.join(F.broadcast(edge), "grp").where(F.shiftrightunsigned("_mix_hash", 64 - 2 * _BITS) == F.col("prefix"))
    last = last.groupBy("grp", "rest", "before", "prefix", "_mix_hash").agg(F.sum("_mix_size").alias("_mix_size"))
    ordered = F.col("_mix_hash")  # within a prefix the signed order is the unsigned one
    upto = F.col("before") + F.sum("_mix_size").over(Window.partitionBy("grp").orderBy(ordered))
    best = (
        last.withColumn("upto", upto)
        .groupBy("grp", "rest", "before", "prefix")
        .agg(F.min(F.struct(F.abs(F.col("upto") - F.col("rest")).alias("off"), ordered.alias("h"), "upto")).alias("b"))
    )
    nearer = F.col("b.off") < F.col("rest") - F.col("before")
    first = F.shiftleft(F.col("prefix"), 64 - 2 * _BITS)
    best = best.select("grp", F.when(nearer, F.col("b.h")).alias("cut"), first.alias("floor"), F.when(nearer, F.col("b.upto")).otherwise(F.col("before")).alias("got"))
    state = want.join(best, "grp", "left").select(
        "grp", "reps", "rest", "cut", "floor",
        F.coalesce("got", F.when(F.col("rest") > 0, F.col("all")).otherwise(0)).alias("got"),
        (F.col("floor").isNull() & (F.col("rest") > 0)).alias("whole"),
    )
    # One more document in or out, if that comes nearer to the quota.
    gap = F.col("rest") - F.col("got")
    near = slim.select("grp", "_mix_size", "_mix_hash").join(F.broadcast(state), "grp").where("_mix_size > 0")
    off = F.when(_extra() == (gap < 0), F.abs(F.abs(gap) - F.col("_mix_size")))
    fix = (
        near.where((gap != 0) & (off < F.abs(gap)))
        .groupBy("grp")
        .agg(F.min(F.struct(off.alias("off"), F.col("_mix_hash").alias("h"))).alias("f"))
        .select("grp", F.col("f.h").alias("flip"))
    )
    return groups.join(state, "grp").join(fix, "grp", "left").drop("rest", "got", "quota")


def _extra(pre: str = "") -> Column:
    """Whether the row's hash lies at or before its group's cut-off (hashes in unsigned order)."""
    def order(c):
        return c.bitwiseXOR(F.lit(-(2**63)).cast("long"))

    h, cut, floor = order(F.col("_mix_hash")), F.col(f"{pre}cut"), F.col(f"{pre}floor")
    before = F.when(cut.isNull(), h < order(floor)).otherwise(h <= order(cut))
    return F.when(F.col(f"{pre}whole"), True).when(floor.isNull(), False).otherwise(before)


def _grouped(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """groups has at most MAX_PATTERNS patterns, which plan() has checked."""
    u = F.shiftrightunsigned(F.xxhash64(F.col("_mix_hash"), F.lit(1)), 11) / F.lit(float(2**53))
    docs = docs.withColumn("_mix_key", _pattern(F.col("_mix_members"))).withColumn("_mix_u", u)
    groups = groups.withColumnsRenamed({c: f"_mix_at_{c}" for c in ("key", "lo", "hi")})
    inside = (F.col("_mix_u") >= F.col("_mix_at_lo")) & (F.col("_mix_u") < F.col("_mix_at_hi"))
    on = (F.col("_mix_key") == F.col("_mix_at_key")) & inside
    return docs.join(F.broadcast(groups), on).drop("_mix_key", "_mix_u", "_mix_at_key", "_mix_at_lo", "_mix_at_hi")


def prepare(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", members: Column | None = None, seed: int = 17) -> DataFrame:
    """docs with word count, members and the seeded hash that decides."""
    return (
        docs.withColumn("_mix_size", word_count(F.col(text)))
        .withColumn("_mix_members", members if members is not None else F.array(F.col("source")))
        .withColumn("_mix_hash", F.xxhash64(F.lit(seed), F.col(doc_id), F.col(text)))
    )


def mix(prepared: DataFrame, cuts: DataFrame) -> DataFrame:
    """prepared rows with their source, source_size, target and number of repeats.

    cuts has a row for each pattern and source; its size was checked by plan().
    """
    groups = cuts.withColumnsRenamed({c: f"_mix_{c}" for c in cuts.columns if c not in ("key", "lo", "hi")})
    out = _grouped(prepared, groups)
    inside = _extra("_mix_") != F.coalesce(F.col("_mix_hash") == F.col("_mix_flip"), F.lit(False))
    return out.withColumn("_mix_repeats", F.col("_mix_reps") + inside.cast("long"))


def op1_mixing(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), max_repeats: int = 3, seed: int = 17) -> DataFrame:
    """doc_id, source, size, source_size, target, taken for every row of docs."""
    slim = prepare(docs.select("doc_id", "text", "source"), seed=seed).drop("text")
    slim = materialize(slim, "mix")
    cuts = plan(slim, weights, max_repeats)
    cuts = materialize(cuts, "mix-cuts")
    out = mix(slim, cuts)
    return out.select(
        "doc_id", "source", F.col("_mix_size").alias("size"), F.col("_mix_source_size").alias("source_size"),
        F.col("_mix_target").alias("target"), (F.col("_mix_size") * F.col("_mix_repeats")).alias("taken"),
    )


def mixed_documents(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), max_repeats: int = 3, seed: int = 17) -> DataFrame:
    """The mixture itself: every document as often as it is taken, with its own columns."""
    # Columns go by their place, so that none of docs meets a working column.
    names = [f"c{i}" for i in range(len(docs.columns))]
    at = dict(zip(docs.columns, names))
    ready = prepare(docs.toDF(*names), at["doc_id"], at["text"], F.array(F.col(at["source"])), seed)
    slim = materialize(ready.select("_mix_size", "_mix_members", "_mix_hash"), "mix")
    cuts = materialize(plan(slim, weights, max_repeats), "mix-cuts")
    out = mix(ready, cuts).where("_mix_repeats > 0 and _mix_size > 0")
    copies = F.explode(F.sequence(F.lit(1).cast("long"), F.col("_mix_repeats")))
    return out.withColumn("_mix_copy", copies).select(*names).toDF(*docs.columns)
