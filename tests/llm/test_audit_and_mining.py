"""Filter audit, hard negatives and exact dedup against brute-force versions, on odd rows too."""

import hashlib
import itertools
import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from claimlens.llm import exact_dedup, filter_audit, hard_negatives
from claimlens.llm.bits import size_for
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
WORD = r"[^\x20\x09-\x0D]+"
LONG = "w" * 1_000_000
#: (doc_id, text, lang); repeated rows, repeated ids, null ids and texts, texts alike but for white space.
ROWS = [
    (1, None, None), (2, "", "en"), (3, " \n\t", "en"), (4, "a b", "en"), (5, "ab", "de"), (6, "a b", "de"), (6, "a b", "de"),
    (7, "a  b ", "en"), (7, "a b  ", "fr"), (None, "a b", "en"), (None, "a b", "en"), (None, "lone", None), (9, LONG, "en"), (10, LONG, "en"),
    (11, "x y " * 300_000, "en"), (12, "ABC #", ""), (13, "Ünï cödé", "xx"), (14, "same", "en"), (14, "same", "en"), (15, "same", "de"),
] + [(100 + i, "hot copy", "en") for i in range(60)] + [(200 + i, " ".join(f"w{(i * j) % 97}" for j in range(110)), "fr") for i in range(8)]
SCHEMA = "doc_id long, text string, lang string, best string, size int, digest string, `a.b` map<string,int>, row long"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(*r, "k", 1, "d", {"a": 1}, 7) for r in ROWS]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA).repartition(7)


def norm(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


def test_exact_dedup(docs):
    groups = {}
    for i, t, _ in ROWS:
        groups.setdefault(norm(t), []).append((-len(t or ""), i is None, i or 0))
    want = Counter()
    for i, t, _ in ROWS:
        ranks = groups[norm(t)]
        n, none, keep = min(ranks)
        want[i, None if none else keep, len(ranks), hashlib.sha256(norm(t).encode()).hexdigest()] += 1
    got = exact_dedup.op13_exact_dedup(docs).collect()
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == want
    kept = Counter(r["text_sha256"] for r in got if r["kept"])
    assert set(kept.values()) == {1} and len(kept) == len(groups)
    for r in got:
        assert not r["kept"] or r["doc_id"] == r["keep_id"]


def test_hot_groups_are_broadcast_and_agree(docs, monkeypatch):
    """Every group hot, or none, gives the same rows."""
    seen = []
    for share in (1, 10**9):
        monkeypatch.setattr(exact_dedup, "HOTTEST", share)
        seen.append(Counter(tuple(r) for r in exact_dedup.op13_exact_dedup(docs).drop("kept").collect()))
    assert seen[0] == seen[1]


def test_crowded_filter_changes_nothing(docs, monkeypatch):
    """With so few bits that most rows are false hits, most are shuffled and the result is the same."""
    before = Counter(tuple(r) for r in exact_dedup.op13_exact_dedup(docs).drop("kept").collect())
    monkeypatch.setattr(exact_dedup, "size_for", lambda n: 512)
    assert Counter(tuple(r) for r in exact_dedup.op13_exact_dedup(docs).drop("kept").collect()) == before


def test_filter_knows_all_copies(spark, monkeypatch):
    keys = [hashlib.sha256(str(i % 4000).encode()).digest() for i in range(5000)]
    digests = spark.createDataFrame([(bytearray(k),) for k in keys], "digest binary").repartition(6)
    twice = exact_dedup.hit_twice(digests, 5000)
    import pyarrow as pa

    slots = exact_dedup.slots(pa.array(keys, pa.binary()), 8 * len(twice.bits)).astype(np.uint64)
    hits = twice.hits(slots.ravel()).reshape(slots.shape).all(axis=1)
    assert hits[:1000].all() and hits[4000:].all() and hits[1000:4000].mean() < 0.05
    assert 8 * len(twice.bits) == size_for(5000)


def test_kept_rows(docs, spark):
    kept = exact_dedup.deduplicated(docs)
    assert kept.columns == docs.columns
    got = kept.collect()
    best = {}
    for i, t, _ in ROWS:
        rank = (-len(t or ""), i is None, i or 0, t or "")
        best[norm(t)] = min(best.get(norm(t), rank), rank)
    assert Counter((-len(r["text"] or ""), r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "") for r in got) == Counter(best.values())
    assert all(r["a.b"] == {"a": 1} and r["digest"] == "d" for r in got)
    none = spark.createDataFrame([], SCHEMA)
    assert exact_dedup.deduplicated(none).count() == exact_dedup.op13_exact_dedup(none).count() == 0


def brute_audit(rows, labels):
    """Every order applied to every document, one filter after the other."""
    fails = []
    firsts = {}
    for i, t, _ in rows:
        if i is not None:
            firsts[t or ""] = min(firsts.get(t or "", i), i)
    for i, t, _ in rows:
        t = t or ""
        ws = re.findall(WORD, t)
        f = ["A"] * (len(ws) < 100) + ["B"] * (100 * len(set(ws)) < 80 * len(ws)) + ["C"] * (100 * len(re.findall("[A-Z]", t)) > 10 * len(t))
        fails.append(set(f + ["D"] * bool(re.search(r"[#$%&*|]", t)) + ["E"] * (i is not None and i > firsts[t])))
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    out = {}
    for part in {p or "" for _, _, p in rows}:
        mine = [(i, f) for (i, _, p), f in zip(rows, fails) if (p or "") == part]
        shapley = Counter()
        for order in itertools.permutations("ABCDE"):
            left = list(mine)
            for k, x in enumerate(order):
                gone = [(i, f) for i, f in left if x in f]
                left = [(i, f) for i, f in left if x not in f]
                shapley[x] += len(gone)
                all_ = sum(x in f for _, f in mine)
                out[part, "".join(order), k + 1] = [
                    len(left), len(gone), all_ - len(gone), sum(f == {x} for _, f in mine), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)
                ]
        for (p, order, k), v in out.items():
            if p == part:
                v.append(shapley[order[k - 1]])
    return out


LABELS = [(2, 1, 0), (5, 0, 1), (5, 1, 0), (5, None, None), (14, 1, 1), (None, 1, 1), (100, 1, 0), (101, 0, 1), (130, 1, 1), (999, 1, 1), (203, 1, None)]


def audit_rows(df):
    return {
        (r["part"], r["filter_order"], r["step"]): [r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")]
        for r in df.collect()
    }


def test_filter_audit(docs, spark):
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    got = filter_audit.op11_filter_audit(docs, labels)
    rows = audit_rows(got)
    assert got.count() == len(rows) == 600 * len({p or "" for _, _, p in ROWS})
    assert rows == brute_audit(ROWS, LABELS)
    none = spark.createDataFrame([], SCHEMA)
    assert filter_audit.op11_filter_audit(none, labels).count() == 0
    unlabelled = filter_audit.op11_filter_audit(docs, labels.where("false"))
    assert unlabelled.agg(F.sum("good_lost"), F.sum("toxic_lost"), F.count("*")).first()[:] == (0, 0, len(rows))


def test_lattice_counts_paths():
    full = filter_audit.Lattice(5)
    assert len(full.edges) == 80 and {sum(full.paths[e] for e in full.edges if bin(e[0]).count("1") == k) for k in range(5)} == {120}
    assert len(list(full.orders())) == 120
    # E after A, D after B: orders are counted and listed alike
    some = filter_audit.Lattice(5, [(0, 4), (1, 3)])
    orders = list(some.orders())
    assert len(orders) == 30 == sum(some.paths[0, f] for f in range(5) if (0, f) in some.paths)
    for s, f in some.edges:
        assert some.paths[s, f] == sum(sum(1 << g for g in o[: o.index(f)]) == s for o in orders)
    with pytest.raises(ValueError):
        filter_audit.Lattice(3, [(0, 1), (1, 0)])


def test_order_with_conditions(spark):
    """Shapley sums over allowed orders only."""
    states = spark.createDataFrame([("p", m, m + 1, m % 3, m % 2) for m in range(8)], "part string, failed int, docs long, good long, toxic long")
    rows = audit_rows(filter_audit.audited(states, "XYZ", before=[(0, 2)]))
    orders = {o for _, o, _ in rows}
    assert orders == {"XYZ", "XZY", "YXZ"}
    for x in range(3):
        want = 0
        for o in orders:
            done = sum(1 << "XYZ".index(c) for c in o[: o.index("XYZ"[x])])
            want += sum(m + 1 for m in range(8) if m >> x & 1 and not m & done)
        assert {v[6] for (_, o, k), v in rows.items() if o[k - 1] == "XYZ"[x]} == {want}


def vectors(seed=3, n=400, dim=12, centers=6):
    """Clusters of alike vectors, some copies, and odd rows."""
    rnd = np.random.default_rng(seed)
    mid = rnd.normal(size=(centers, dim))
    v = mid[rnd.integers(0, centers, n)] + 0.15 * rnd.normal(size=(n, dim))
    v[50:90] = v[50]
    out = [(int(i), [float(np.float32(x)) for x in v[i]], int(rnd.integers(0, 4))) for i in range(n)]
    out += [(700, [0.0] * dim, 1), (800, [1.0], 2), (801, [], 2), (900, None, 1), (None, [0.5] * dim, 1), (None, [0.5] * dim, 2), (1000, [float("nan")] * dim, 1)]
    out += [(1001, [1.0, None], 1), (1100, [float("inf")] * dim, 1), (1200, [0.5] * dim, None), (300, out[300][1], 0), (300, out[300][1], 0), (-100, out[5][1], 3)]
    return out


def brute_negatives(rows):
    ok = []
    for i, v, label in rows:
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        ok.append((i, [math.floor(256 * x) for x in v], (label + 1) % 10 if i is not None and i % 7 == 0 else label))
    out = Counter()
    for a, (ai, av, al) in enumerate(ok):
        if ai is None or ai % 100:
            continue
        all_ = sorted(((-sum(x * y for x, y in zip(av, bv)), bi is None, bi or 0, b, bl) for b, (bi, bv, bl) in enumerate(ok) if b != a))
        for s, none, pi, _, _ in [x for x in all_ if x[4] == al][:5]:
            fit = [x for x in all_ if x[4] != al and 80 * -s <= 100 * -x[0] <= 100 * -s][:5]
            for k, x in enumerate(fit):
                out[ai, None if none else pi, k + 1, None if x[1] else x[2], -s, -x[0]] += 1
    return out


VECTORS = "vec_id long, embedding array<double>, label int, row string, angle int"


@pytest.mark.parametrize("block", [4096, 3])
def test_hard_negatives(spark, monkeypatch, block):
    monkeypatch.setattr(hard_negatives, "ANCHORS", block)  # one scan for all anchors, or several
    monkeypatch.setattr(hard_negatives, "ROWS", 32)
    rows = vectors()
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], VECTORS).repartition(5)
    got = hard_negatives.op12_hard_negatives(df)
    assert Counter(tuple(r) for r in got.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()) == brute_negatives(rows)
    assert hard_negatives.op12_hard_negatives(df.where("false")).count() == 0
    assert hard_negatives.op12_hard_negatives(df.where("vec_id % 100 <> 0")).count() == 0


def test_very_large_components_are_exact(spark):
    """Beyond 2^53 scores are summed as whole numbers, and beyond a long they count as the nearest."""
    big = float(2**20 + 1)
    rows = [(0, [big, 1.0, big], 1), (1, [big, -1.0, big], 1), (2, [big, 0.5, big], 2), (3, [big, -2.5, big - 2], 2)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], VECTORS)
    assert Counter(tuple(r) for r in hard_negatives.op12_hard_negatives(df).collect()) == brute_negatives(rows)
    huge = spark.createDataFrame([(i, [1e30, -1e300], i % 2, "x", 1) for i in (0, 1, 2, 3, 5)], VECTORS)
    assert {(r["positive_score"], r["negative_score"]) for r in hard_negatives.op12_hard_negatives(huge).collect()} == {(2**63 - 1, 2**63 - 1)}


def test_intervals_hold_all_scores():
    """Bounds of a block contain every score in it, for alike, opposite, parallel and null vectors."""
    rnd = np.random.default_rng(5)
    for _ in range(60):
        dim = int(rnd.integers(1, 20))
        mid = rnd.integers(-300, 300, dim)
        rows = np.floor(mid + rnd.normal(size=(30, dim)) * rnd.choice([0, 1, 50]))
        anchors = np.vstack([rows[:3], -rows[:2], np.zeros((1, dim)), rnd.integers(-300, 300, (5, dim)), 2 * rows[:1]]).astype(float)
        refs = hard_negatives.directions(np.vstack([anchors, rows])[rnd.permutation(42)], 5)
        norm, theta = hard_negatives.angles(rows, refs)
        a_norm, alpha = hard_negatives.angles(anchors, refs)
        low, high = hard_negatives.interval(alpha, a_norm, theta.min(axis=0), theta.max(axis=0), norm.min(), norm.max())
        s = hard_negatives.scores(anchors, rows)
        assert (s >= low[:, None]).all() and (s <= high[:, None]).all()


def test_windows_leave_most_of_distant_clusters_out():
    """Where rows stand in clusters, few of the pairs are scored."""
    rnd = np.random.default_rng(9)
    mid = rnd.normal(size=(16, 32)) * 100
    rows = np.floor(mid[np.repeat(np.arange(16), 200)] + rnd.normal(size=(3200, 32)) * 4)
    refs = hard_negatives.directions(rows[::50])
    norm, theta = hard_negatives.angles(rows, refs)
    cell = theta.argmin(axis=1)
    order = np.lexsort((theta[np.arange(3200), cell], cell))
    pick = rows[::100]
    a_norm, alpha = hard_negatives.angles(pick, refs)
    label = np.arange(3200) % 3
    anchors = {"vectors": pick, "norm": a_norm, "alpha": alpha, "label": label[::100], "row": np.arange(0, 3200, 100)}
    none = np.full(32, -(2**63) + 1)
    wanted = hard_negatives.Wanted(anchors, 5, True, np.arange(32), none, -none).begin()
    for at in (order[i : i + 64] for i in range(0, 3200, 64)):
        wanted.meet(rows[at], norm[at], theta[at], label[at], at, at, int(cell[at[0]]))
    assert wanted.scored < 0.3 * wanted.met
    s = hard_negatives.scores(pick, rows)
    for x in range(32):
        mine = [i for i in range(3200) if label[i] == label[100 * x] and i != 100 * x]
        assert sorted(wanted.lists[x][1].tolist()) == sorted(sorted(mine, key=lambda i: (-s[x, i], i))[:5])


def test_queries_equal_their_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "labels", "embeddings"):
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    from claimlens.llm.queries import ORACLE, QUERIES

    for name in ("op11_filter_audit", "op12_hard_negatives", "op13_exact_dedup"):
        got = QUERIES[name](spark, SF)
        rel = con.execute(ORACLE[name])
        heads = [c[0] for c in rel.description]
        assert sorted(heads) == sorted(got.columns)
        assert Counter(rel.fetchall()) == Counter(tuple(r) for r in got.select(*heads).collect()), name
