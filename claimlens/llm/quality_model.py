"""Quality classifier: random Fourier features, ridge scores, isotonic calibration.

Statistics of each text (lengths, shares of character classes, repetition, line
shapes) are standardised and mapped to D cosines with seeded random frequencies,
which approximate a Gaussian kernel. Tasks sum the normal equations of their
labelled rows (a D x D matrix for each fold, whatever the number of rows), these
are added up FAN at a time, and the driver adds the last few and solves the ridge system. Scores that a fold's
rows get from the other folds' model are binned, and pooling adjacent violators
over the bins gives the calibration. All labelled rows that aren't held out are
used; nothing is sampled.

Defined cases: a null text is an empty one and gets a score; a null doc_id gets
the fold of an empty string and no label; a row of labels with null quality is
unused; several labels of one doc_id each count; without any usable label every
score is PRIOR; repeated rows each get a row; a very long text is measured whole; an
empty table gives an empty result; `accepted_documents` carries all columns through.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimlens.llm.batches import pieces, tidy
from claimlens.session import materialize, release

FEATURES, SEED, RIDGE, FOLDS, BINS, PRIOR, THRESHOLD = 192, 11, 1e-3, 4, 400, 0.5, 0.3
#: Matrices that are added in one task.
FAN = 8


def statistics(text: str) -> list[float]:
    """Numbers that describe a text's shape; none depends on where it is from."""
    words = text.split()
    n, chars = len(words), len(text)
    if not n:
        return [0.0] * N_STATISTICS
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    count = np.bincount(data, minlength=256)
    size = len(data)
    seen = Counter(words)
    same = sum(map(str.__eq__, words, words[1:])) if n > 1 else 0
    lines = text.split("\n")
    share = count[count > 0] / size
    symbols = int(count[[35, 36, 37, 38, 42, 60, 62, 124, 126, 94]].sum())
    return [
        np.log1p(n), np.log1p(chars), chars / n,
        len(seen) / n, np.log1p(len(seen)) / np.log1p(n), max(seen.values()) / n,
        same / n, symbols / size, np.log1p(symbols), symbols / n,
        int(count[33]) / n, int(count[124]) / n, int(count[46]) / n, int(count[44]) / n,
        int(count[48:58].sum()) / size, int(count[65:91].sum()) / size, int(count[97:123].sum()) / size,
        int(count[128:].sum()) / size, int(count[64]) / n, int(count[58]) / n,
        len(lines) / n, np.log1p(len(lines)), 1 - len(set(lines)) / len(lines), max(map(len, lines)) / chars,
        float(-(share * np.log2(share)).sum()), len(zlib.compress(data[:], 1)) / size,
        sum(len(w) for w in seen) / len(seen), sum(c == 1 for c in seen.values()) / n,
    ]


N_STATISTICS = 28


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in pieces(batches):
        rows = [statistics(t or "") for t in b.column(1).to_pylist()]
        ids = b.column(0).to_pylist()
        fold = [zlib.crc32(str("" if i is None else i).encode()) for i in ids]
        kinds = pa.list_(pa.float32())
        arrays = [b.column(0), pa.array([f % 5 for f in fold], pa.int32()), pa.array([f // 5 % FOLDS for f in fold], pa.int32()), pa.array(rows, kinds)]
        yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "rest", "fold", "x"])


def measured(docs: DataFrame) -> DataFrame:
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return docs.mapInArrow(tidy(_measure), "doc_id long, rest int, fold int, x array<float>")


class Model:
    def __init__(self, mean, scale, seed: int = SEED, features: int = FEATURES):
        rng = np.random.default_rng(seed)
        d = len(mean)
        # Frequencies of several widths, so that no single kernel width has to fit.
        width = np.repeat([0.15, 0.35], features // 2)
        self.mean, self.scale = mean, scale
        self.w, self.b = rng.normal(size=(d, features)) * width, rng.uniform(0, 2 * np.pi, features)
        self.beta, self.edges, self.levels = None, None, None

    def map(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        wave = np.cos(z @ self.w + self.b) * np.sqrt(2 / self.w.shape[1])
        return np.hstack([wave, z * 0.1, np.ones((len(x), 1))])

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.beta is None:
            return np.full(len(x), PRIOR)
        return np.clip(np.interp(self.map(x) @ self.beta, self.edges, self.levels), 0, 1)


def _moments(batches):
    total = np.zeros((2, N_STATISTICS))
    n = 0
    for b in batches:
        x = np.array(b.column(0).to_pylist(), float).reshape(-1, N_STATISTICS)
        total += (x.sum(0), (x * x).sum(0))
        n += len(x)
    yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64()), "s": pa.array([total.ravel().tolist()], pa.list_(pa.float64()))})


def _normal(model: Model):
    def sums(batches):
        from pyspark import TaskContext

        got: dict[int, np.ndarray] = {}
        for b in batches:
            x = np.array(b.column(2).to_pylist(), float).reshape(-1, N_STATISTICS)
            fold, y = np.array(b.column(0)), np.array(b.column(1), float)
            for f in np.unique(fold):
                z = np.hstack([model.map(x[fold == f]), y[fold == f][:, None]])
                got[int(f)] = got.get(int(f), 0) + z.T @ z
        part = pa.array([TaskContext.get().partitionId()] * len(got), pa.int64())
        yield pa.RecordBatch.from_pydict({"part": part, "fold": pa.array(list(got), pa.int32()), "a": pa.array([m.tobytes() for m in got.values()], pa.binary())})

    return sums


def _add(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(a.as_py()) for a in rows.column("a"))
    return pa.table({"part": pa.array([key[0].as_py()], pa.int64()), "fold": pa.array([key[1].as_py()], pa.int32()), "a": pa.array([total.tobytes()], pa.binary())})


def _added(sums: DataFrame) -> DataFrame:
    """Sums of the matrices (part, fold, a) by fold, FAN at a time and level by level, so that no task holds more; FAN or fewer are left for each fold."""
    sums = materialize(sums, "normal")
    while (sums.agg(F.max("part")).first()[0] or 0) >= FAN:
        wide = sums.withColumn("part", F.floor(F.col("part") / FAN).cast("long"))
        last, sums = sums, materialize(wide.groupBy("part", "fold").applyInArrow(_add, "part long, fold int, a binary"), "normal")
        release(last)
    return sums


def solve(total: np.ndarray) -> np.ndarray:
    a, b = total[:-1, :-1], total[:-1, -1]
    ridge = RIDGE * max(1.0, total[-2, -2] / 1000) * np.eye(len(a))
    return np.linalg.solve(a + ridge, b)


def _binned(model: Model, betas):
    def bins(batches):
        got: Counter = Counter()
        for b in batches:
            x = np.array(b.column(2).to_pylist(), float).reshape(-1, N_STATISTICS)
            fold, y = np.array(b.column(0)), np.array(b.column(1), float)
            raw = np.einsum("ij,ij->i", model.map(x), betas[fold]) if len(x) else np.zeros(0)
            at = np.clip(np.floor(raw * BINS / 2 + BINS / 4), 0, BINS - 1).astype(int)
            for i, v in zip(at.tolist(), y.tolist()):
                got[i, 0] += 1
                got[i, 1] += v
        keys = sorted({k for k, _ in got})
        yield pa.RecordBatch.from_pydict({"bin": pa.array(keys, pa.int32()), "n": pa.array([got[k, 0] for k in keys], pa.float64()), "y": pa.array([got[k, 1] for k in keys], pa.float64())})

    return bins


def isotonic(n: list[float], y: list[float]) -> list[float]:
    """Pooled means of adjacent groups that aren't ascending; n: rows, y: sums of labels."""
    out: list[list[float]] = []
    for a, b in zip(n, y):
        out.append([a, b, 1])
        while len(out) > 1 and out[-2][1] * out[-1][0] >= out[-1][1] * out[-2][0]:
            c = out.pop()
            out[-1] = [u + v for u, v in zip(out[-1], c)]
    return [b / a for a, b, k in out for _ in range(int(k))]


def fit(rows: DataFrame, labels: DataFrame) -> Model:
    """rows: what measured() gives; labels: doc_id, quality."""
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("y")).where("y is not null")
    train = rows.where("rest <> 0 and doc_id is not null").join(labels, "doc_id").select("fold", "y", "x")
    train = materialize(train, "quality-train")
    parts = train.select("x").mapInArrow(_moments, "n long, s array<double>")
    total = parts.agg(F.sum("n").alias("n"), *[F.sum(F.get("s", F.lit(i))).alias(f"s{i}") for i in range(2 * N_STATISTICS)]).first()
    n = total["n"] or 0
    zero = np.zeros(N_STATISTICS)
    if not n:
        return Model(zero, zero + 1)
    s = np.array([total[f"s{i}"] for i in range(2 * N_STATISTICS)]).reshape(2, -1) / n
    model = Model(s[0], np.sqrt(np.maximum(s[1] - s[0] ** 2, 0)) + 1e-3)
    sums = _added(train.mapInArrow(_normal(model), "part long, fold int, a binary")).collect()  # FOLDS * FAN matrices at most
    width = FEATURES + N_STATISTICS + 2
    folds = np.zeros((FOLDS, width, width))
    for r in sums:
        folds[r["fold"]] += np.frombuffer(r["a"]).reshape(width, width)
    whole = folds.sum(0)
    model.beta = solve(whole)
    betas = np.array([solve(whole - f) if (whole - f)[-2, -2] > 0 else model.beta for f in folds])
    bins = train.mapInArrow(_binned(model, betas), "bin int, n double, y double").groupBy("bin").agg(F.sum("n").alias("n"), F.sum("y").alias("y")).orderBy("bin").collect()
    levels = isotonic([r["n"] for r in bins], [r["y"] for r in bins])
    model.edges, model.levels = np.array([(r["bin"] + 0.5) * 2 / BINS - 0.5 for r in bins]), np.array(levels)
    return model


def _score(model):
    def score(batches):
        for b in batches:
            x = np.array(b.column(2).to_pylist(), float).reshape(-1, N_STATISTICS)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(model.value.score(x), pa.float64())], names=["doc_id", "rest", "score"])

    return score


def scored(rows: DataFrame, model: Model) -> DataFrame:
    sent = rows.sparkSession.sparkContext.broadcast(model)
    return rows.select("doc_id", "rest", "x").mapInArrow(_score(sent), "doc_id long, rest int, score double")


def op10_quality_model(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs (doc_id, text); labels: doc_id, quality."""
    rows = materialize(measured(docs), "quality")
    out = scored(rows, fit(rows, labels))
    return out.select("doc_id", (F.col("rest") == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def accepted_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Rows of docs that the classifier doesn't reject, with all their columns; judged in the task that reads them."""
    model = docs.sparkSession.sparkContext.broadcast(fit(materialize(measured(docs), "quality"), labels))
    at = docs.columns.index("text")

    def keep(batches):
        for b in pieces(batches):
            x = np.array([statistics(t or "") for t in b.column(at).to_pylist()], "<f4").astype(float).reshape(-1, N_STATISTICS)
            yield b.filter(pa.array(model.value.score(x) >= threshold))

    names = [f"c{i}" for i in range(len(docs.columns))]  # columns go by their place, whatever their names
    kept = T.StructType([T.StructField(n, f.dataType, f.nullable) for n, f in zip(names, docs.schema.fields)])
    return docs.toDF(*names).mapInArrow(tidy(keep), kept).toDF(*docs.columns)
