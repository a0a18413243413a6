"""Hard-negative mining with angular triangle filtering.

Rows store their angles to REFERENCES directions. By the triangle inequality for
angles, an anchor at angle a and a row at angle t to a direction are at least
|a - t| and at most min(a + t, 2 pi - a - t) apart; over all directions that is
an interval of cosines, and times the two norms one of scores. Rows are laid out
by nearest direction and angle to it, so that blocks of rows stand close together:
a block has one interval for each anchor. Only blocks whose interval overlaps the
scores still wanted of an anchor are scored, and of these only the window of rows
whose own angle allows it. Intervals are widened by SLACK, more than the rounding
of angles, and by one whole score, so nothing wanted is lost; scores themselves
are exact integers. Where vectors have no direction in common the intervals are
wide and most blocks are scored, with the same result.

Wanted of an anchor are first the best rows of its label, then, for every one of
these, the best rows of other labels between two shares of its score. What is
wanted grows with the number of anchors, so rows are scanned by block of ANCHORS
anchors, sent to tasks with their starting thresholds (from the anchors' scores
among themselves, which are rows too). A task keeps a few rows for each anchor
and hands on no more; the best of all tasks are ranked by anchor. The driver holds
one block of anchors at a time, and the directions, fitted on the first SAMPLE
anchors: they decide how much is scored, never the result.

Defined cases: rows with a null label, a null vector or a component that is null
or not finite take no part; a shorter vector is as if padded by zeros; rows of
one vec_id, or repeated in full, are rows of their own, each an anchor if the
column says so, and an anchor isn't its own positive; a null vec_id ranks after
any other among equal scores; a score beyond a long counts as the nearest long;
anchors without positives, and positives without rows in their window, give no
rows; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimlens.llm.batches import pieces
from claimlens.session import materialize, new_path, release

#: Directions, anchors they are chosen from, anchors of a scan, and rows that share an interval.
REFERENCES, SAMPLE, ANCHORS, ROWS = 16, 1024, 4096, 256
#: Radians by which stored angles may be wrong at most (they are right to about 2e-8).
SLACK = 1e-6
HUGE = 1e150
_TOP, _LAST = (1 << 63) - 1, (1 << 63) - 1


def matrix(lists: list[list[float]], width: int = 0) -> np.ndarray:
    """Rows of doubles, padded by zeros to the longest or to width."""
    width = max([width, *map(len, lists)])
    if all(len(x) == width for x in lists):
        return np.array(lists, np.float64).reshape(len(lists), width)
    out = np.zeros((len(lists), width))
    for i, x in enumerate(lists):
        out[i, : len(x)] = x
    return out


def aligned(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both with as many columns as the wider one."""
    width = max(a.shape[1], b.shape[1])
    return tuple(x if x.shape[1] == width else np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (a, b))


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of rows of whole numbers: by doubles where all sums stay below 2^53."""
    a, b = aligned(a, b)
    if min(np.abs(a).max(initial=0), HUGE) * min(np.abs(b).max(initial=0), HUGE) * max(1, a.shape[1]) < 1 << 53:
        return (a @ b.T).astype(np.int64)
    whole = [np.array([[int(x) for x in row] for row in m], object).reshape(m.shape) for m in (a, b)]
    return np.clip(whole[0] @ whole[1].T, -_TOP, _TOP).astype(np.int64)


def norms(vectors: np.ndarray) -> np.ndarray:
    """Lengths, without overflow; those beyond HUGE count as that, so that two of them can be multiplied."""
    most = np.abs(vectors).max(axis=1, initial=0)
    part = vectors / np.where(most > 0, most, 1)[:, None]
    return np.minimum(np.minimum(most, HUGE) * np.sqrt((part * part).sum(axis=1)), HUGE)


def units(vectors: np.ndarray) -> np.ndarray:
    most = np.abs(vectors).max(axis=1, initial=0)
    part = vectors / np.where(most > 0, most, 1)[:, None]
    length = np.sqrt((part * part).sum(axis=1))
    return part / np.where(length > 0, length, 1)[:, None]


def angles(vectors: np.ndarray, directions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Norms, and angles of every vector to every direction (unit vectors); those of a null vector are 0."""
    vectors, directions = aligned(vectors, directions)
    norm, unit = norms(vectors), units(vectors)
    return norm, np.where(norm[:, None] > 0, np.arccos(np.clip(unit @ directions.T, -1, 1)), 0)


def directions(vectors: np.ndarray, n: int = REFERENCES) -> np.ndarray:
    """Up to n unit vectors among those given, each the farthest from those before it."""
    unit = units(vectors[np.abs(vectors).max(axis=1, initial=0) > 0])
    if not len(unit):
        return np.zeros((1, max(1, vectors.shape[1])))
    taken, near = [0], unit @ unit[0]
    while len(taken) < min(n, len(unit)):
        taken.append(int(near.argmin()))
        near = np.maximum(near, unit @ unit[taken[-1]])
    return unit[taken]


def interval(alpha: np.ndarray, norm: np.ndarray, low: np.ndarray, high: np.ndarray, least: float, most: float) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the scores of anchors (angles alpha, norms) with rows whose angles to the
    directions are within low and high and whose norms are within least and most."""
    near = np.maximum(np.maximum(low - alpha, alpha - high), 0).max(axis=1) - SLACK
    far = np.minimum(alpha + high, 2 * np.pi - alpha - low).min(axis=1) + SLACK
    up, down = np.cos(np.clip(near, 0, np.pi)), np.cos(np.clip(far, 0, np.pi))
    more = 1 + 1e-9 * norm * most
    low, high = norm * np.where(down > 0, least, most) * down - more, norm * np.where(up > 0, most, least) * up + more
    return np.clip(low, -float(_TOP), float(_TOP)), np.clip(high, -float(_TOP), float(_TOP))


def best(score: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best: higher scores first, then smaller ids, then smaller rows."""
    if len(score) > 4 * k:
        last = np.partition(score, len(score) - k)[len(score) - k]
        at = np.flatnonzero(score >= last)
        return at[np.lexsort((rows[at], ids[at], -score[at]))[:k]]
    return np.lexsort((rows, ids, -score))[:k]


class Wanted:
    """What a scan looks for: for each anchor one list, or one for each of its positives, of k rows
    with scores from least to most, of its own label or of others."""

    def __init__(self, anchors: dict, k: int, same: bool, owner: np.ndarray, least: np.ndarray, most: np.ndarray):
        self.__dict__.update(anchors)  # vectors, norm, alpha, label, row, directions
        self.k, self.same, self.owner, self.most, self.scored, self.met = k, same, owner, most, 0, 0
        self.threshold = least.copy()
        self.lists: list[tuple] = [(np.zeros(0, np.int64),) * 3] * len(owner)
        self.of = [np.flatnonzero(owner == i) for i in range(len(self.row))]

    def begin(self) -> Wanted:
        """Thresholds that the anchors' scores among themselves allow."""
        s = scores(self.vectors, self.vectors)
        fits = (self.label[:, None] == self.label) == self.same
        for j, i in enumerate(self.owner):
            there = s[i][fits[i] & (self.row != self.row[i]) & (s[i] <= self.most[j])]
            if len(there) >= self.k:
                self.threshold[j] = max(self.threshold[j], np.partition(there, len(there) - self.k)[len(there) - self.k])
        return self

    def meet(self, vectors: np.ndarray, norm: np.ndarray, theta: np.ndarray, label: np.ndarray, ids: np.ndarray, rows: np.ndarray, cell: int) -> None:
        """A block of rows, in ascending order of their angle to the direction cell if they have it as the nearest."""
        if not len(self.owner):
            return
        least, most = self.bounds()
        low, high = interval(self.alpha, self.norm, theta.min(axis=0), theta.max(axis=0), norm.min(), norm.max())
        mine = np.flatnonzero((high >= least) & (low <= most) & (least <= most))
        self.met += len(self.row) * len(rows)
        if not len(mine):
            return
        from_, to = self.window(mine, least[mine], theta[:, cell], norm.max(), cell)
        at = slice(from_, to)
        self.scored += len(mine) * max(0, to - from_)
        if to <= from_:
            return
        s = scores(self.vectors[mine], vectors[at])
        fits = (self.label[mine][:, None] == label[at]) == self.same
        fits &= (s >= least[mine][:, None]) & (s <= most[mine][:, None]) & (self.row[mine][:, None] != rows[at])
        for x in np.flatnonzero(fits.any(axis=1)):
            found = np.flatnonzero(fits[x])
            for j in self.of[mine[x]]:
                self.add(j, s[x][found], ids[at][found], rows[at][found])

    def bounds(self) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest score that any list of an anchor still wants."""
        least, most = np.full(len(self.row), _TOP), np.full(len(self.row), -_TOP)
        open_ = self.threshold <= self.most
        np.minimum.at(least, self.owner[open_], self.threshold[open_])
        np.maximum.at(most, self.owner[open_], self.most[open_])
        return least, most

    def window(self, mine: np.ndarray, least: np.ndarray, theta: np.ndarray, norm: float, cell: int) -> tuple[int, int]:
        """The rows, sorted by theta, whose angle alone allows the least score of one of the anchors."""
        if (np.diff(theta) < 0).any():
            return 0, len(theta)
        reach = self.norm[mine] * norm
        cos = np.divide(least - 1 - 1e-9 * reach, reach, out=np.full(len(mine), -1.0), where=reach > 0)
        width = np.arccos(np.clip(cos, -1, 1)) + SLACK
        alpha = self.alpha[mine, cell]
        return int(np.searchsorted(theta, alpha - width).min()), int(np.searchsorted(theta, alpha + width, side="right").max())

    def add(self, j: int, score: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        fit = (score >= self.threshold[j]) & (score <= self.most[j])
        if fit.any():
            new = [np.concatenate(x) for x in zip(self.lists[j], (score[fit], ids[fit], rows[fit]))]
            at = best(*new, self.k)
            self.lists[j] = tuple(x[at] for x in new)
            if len(at) == self.k:
                self.threshold[j] = max(self.threshold[j], self.lists[j][0][-1])

    def told(self) -> Iterator[pa.RecordBatch]:
        rows = [(j, s, None if i == _LAST else i, r) for j, x in enumerate(self.lists) for s, i, r in zip(*(c.tolist() for c in x))]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), *[pa.int64()] * 3))], names=["list", "score", "vec_id", "row"])


_PLACED = "row long, vec_id long, label long, anchor boolean, vector array<double>, norm double, angles array<double>, cell int, angle double"


def _placed(references: np.ndarray):
    """Rows with norm, angles to all directions, nearest direction and angle to it."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, 4 * ROWS):
            norm, theta = angles(matrix(b.column(4).to_pylist()), references)
            cell = theta.argmin(axis=1)
            made = [pa.array(norm), pa.array(list(theta), pa.list_(pa.float64())), pa.array(cell.astype(np.int32)), pa.array(theta[np.arange(len(cell)), cell])]
            yield pa.RecordBatch.from_arrays([*b.columns, *made], names=[c.split(" ")[0] for c in _PLACED.split(", ")])

    return place


def _ids(column: pa.Array) -> np.ndarray:
    return np.array(column.fill_null(_LAST).to_numpy(zero_copy_only=False), np.int64)


def _scan(sent):
    """All rows of a task against the wanted lists; what a task has found is given at its end."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted: Wanted = sent.value
        for b in pieces(batches, ROWS):
            theta = np.array(b.column(5).to_pylist())
            label, ids, rows = (_ids(b.column(i)) for i in (2, 1, 0))
            wanted.meet(matrix(b.column(3).to_pylist()), b.column(4).to_numpy(), theta, label, ids, rows, b.column(6)[0].as_py())
        yield from wanted.told()

    return scan


def _first(placed: DataFrame, wanted: Wanted) -> DataFrame:
    """(list, score, vec_id, row, rank): the k best rows of every list over all tasks."""
    sent = placed.sparkSession.sparkContext.broadcast(wanted)
    told = placed.select("row", "vec_id", "label", "vector", "norm", "angles", "cell").mapInArrow(_scan(sent), "list int, score long, vec_id long, row long")
    order = Window.partitionBy("list").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row")
    return told.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= wanted.k)


_FOUND = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def placed_rows(vectors: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """vectors (vec_id, vector of whole doubles, label, anchor) as a table laid out by nearest direction and angle."""
    rows = vectors.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long"), F.col("label").cast("long"), "anchor", "vector")
    rows = materialize(rows, "vectors")
    sample = rows.where("anchor").orderBy("row").limit(SAMPLE).select("vector").collect()
    references = directions(matrix([r[0] for r in sample]) if sample else np.zeros((0, 1)))
    placed = rows.mapInArrow(_placed(references), _PLACED).repartitionByRange("cell", "angle", "row").sortWithinPartitions("cell", "angle", "row")
    placed = materialize(placed, "placed")
    release(rows)
    return placed, references


def hard_negatives(vectors: DataFrame, k: int = 5, low: int = 80, high: int = 100) -> DataFrame:
    """For every anchor and each of its k best rows of the same label (positives) the k best rows of other labels with
    low * positive_score <= 100 * negative_score <= high * positive_score, ranked from 1.

    vectors: vec_id, vector (whole numbers as doubles), label, anchor (boolean).
    """
    spark = vectors.sparkSession
    placed, references = placed_rows(vectors)
    path = new_path(spark, "negatives")
    spark.createDataFrame([], _FOUND).write.parquet(path)
    rows = placed.where("anchor").select("row", "vec_id", "label", "vector").toLocalIterator()
    while block := list(islice(rows, ANCHORS)):
        _block(placed, references, block, k, low, high).write.mode("append").parquet(path)
    return spark.read.schema(_FOUND).parquet(path)


def _block(placed: DataFrame, references: np.ndarray, block: list, k: int, low: int, high: int) -> DataFrame:
    """The rows of hard_negatives for a block of anchors: one scan for positives, one for negatives."""
    made = matrix([r["vector"] for r in block])
    norm, alpha = angles(made, references)
    row, label = (np.array([r[c] for r in block], np.int64) for c in ("row", "label"))
    anchors = {"vectors": made, "norm": norm, "alpha": alpha, "label": label, "row": row}
    all_ = np.arange(len(block))
    wanted = Wanted(anchors, k, True, all_, np.full(len(block), -_TOP), np.full(len(block), _TOP)).begin()
    positives = sorted(_first(placed, wanted).collect(), key=lambda r: (r["list"], r["rank"]))  # k for each anchor at most
    owner = np.array([r["list"] for r in positives], np.int64)
    # whole-number limits of 100 * score between low and high times the positive's
    least = np.array([max(-_TOP, -(-low * r["score"] // 100)) for r in positives], np.int64)
    most = np.array([min(_TOP, high * r["score"] // 100) for r in positives], np.int64)
    lists = placed.sparkSession.createDataFrame(
        [(j, block[r["list"]]["vec_id"], r["vec_id"], r["score"]) for j, r in enumerate(positives)],
        "list int, anchor_id long, positive_id long, positive_score long",
    )
    found = _first(placed, Wanted(anchors, k, False, owner, least, most).begin())
    found = found.select("list", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return found.join(F.broadcast(lists), "list").select(*[c.split(" ")[0] for c in _FOUND.split(", ")])


def whole(embedding: Column) -> Column:
    """Components times 256, rounded down; null unless all of them are finite."""
    fine = F.forall(embedding, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    return F.when(fine, F.transform(embedding, lambda x: _floor(x.cast("double") * 256)))


def _floor(x: Column) -> Column:
    """floor as a double; beyond 2^53 doubles are whole already and may not fit a long."""
    return F.when(F.abs(x) < float(1 << 53), F.floor(x).cast("double")).otherwise(x)


def op12_hard_negatives(embeddings: DataFrame) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for the anchors whose vec_id is divisible
    by 100; where it is divisible by 7 the label first becomes the next of ten."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = embeddings.select("vec_id", whole(F.col("embedding")).alias("vector"), label.alias("label"), F.coalesce(F.col("vec_id") % 100 == 0, F.lit(False)).alias("anchor"))
    return hard_negatives(rows.where("vector is not null and label is not null"))


def oracle() -> str:
    """The same in DuckDB's SQL, every anchor against every row."""
    return """
with v as (select row_number() over () as rid, vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
                  [floor(256 * x::double) for x in embedding] as v
           from embeddings where label is not null and embedding is not null and len([x for x in embedding if x is null or not isfinite(x)]) = 0),
s as (select a.rid as aid, a.vec_id as anchor_id, b.rid as rid, b.vec_id, a.label = b.label as same,
             list_inner_product(a.v, b.v)::bigint as score from v a, v b where a.vec_id % 100 = 0 and a.rid <> b.rid),
p as (select aid, anchor_id, rid as pid, vec_id as positive_id, score as positive_score from s where same
      qualify row_number() over (partition by aid order by score desc, vec_id nulls last, rid) <= 5),
n as (select p.*, s.vec_id as negative_id, s.score as negative_score,
             row_number() over (partition by p.aid, p.pid order by s.score desc, s.vec_id nulls last, s.rid)::int as rank
      from p join s on s.aid = p.aid and not s.same and 80 * positive_score <= 100 * s.score and 100 * s.score <= 100 * positive_score)
select anchor_id, positive_id, rank, negative_id, positive_score, negative_score from n where rank <= 5"""
