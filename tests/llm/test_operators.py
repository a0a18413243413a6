"""Every operator against a brute-force version, on whole small tables and on odd rows."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from claimlens.llm import bpe, lz_fingerprint, mixing, ngram_join, pii, quality_model, quality_rules, substrings, token_counts, token_files
from claimlens.llm.queries import vocabulary
from claimlens.llm.units import UnitEncoder
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
WORD = r"[^\x20\x09-\x0D]+"
ODD = [
    None, "", " ", "\n", "a  b\n c", "\t x y \n\n z", "é ́x <|endoftext|>a <|startoftext|> b", " lead", "trail ",
    "a b c", "x" * 3000, "İstanbul Σίσυφος ΣΑΣ", "a▁b ▁▁ c", "a\x00b c", "don't we'll 12 345", "same words here and there\n" * 30,
    "mail a.b@c.de, +1 (017) 555-7713 4484516811440732 10.0.0.1", "One\nline\n\nand another", "same text", "same text", "A B", "a b",
    "one two three four five six seven eight nine ten " * 8,
]
SCHEMA = "doc_id long, text string, source string, grp int, key string, n long"


@pytest.fixture(scope="module")
def rows(spark):
    real = [(r[0], r[1], r[2]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source").collect()]
    base = real[0][1].split(" ")
    near = [(2_000_000 + i, " ".join(base[: -1 - i]), "src0") for i in range(4)]
    odd = [(1_000_000 + 7 * i, t, None if i % 5 == 0 else "z") for i, t in enumerate(ODD)]
    out = real + near + odd
    random.Random(4).shuffle(out)
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(*r, 1, "k", 2) for r in rows], SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    got = [r.asDict() for r in df.collect()]
    assert len({r["doc_id"] for r in got}) == len(got)
    return {r["doc_id"]: r for r in got}


def test_mixing(docs, rows, none):
    got = by_id(mixing.op1_mixing(docs))
    size = {i: len(re.findall(WORD, t or "")) for i, t, _ in rows}
    total = {}
    for i, _, s in rows:
        total[s] = total.get(s, 0) + size[i]
    goal = mixing.targets(total, (5, 2, 1), 3)
    assert abs(sum(goal.values()) - sum(total.values())) < 1e-6 * sum(total.values())
    taken = dict.fromkeys(total, 0)
    for i, _, s in rows:
        r = got[i]
        assert (r["size"], r["source_size"]) == (size[i], total[s]) and abs(r["target"] - goal[s]) < 1e-6
        assert 0 <= r["taken"] <= 3 * size[i]
        taken[s] += r["taken"]
    for s in total:  # the prefix that is nearer leaves half a document at most
        assert abs(taken[s] - goal[s]) <= max(size[i] for i, _, x in rows if x == s) / 2 + 1, s
    assert {i: r["taken"] for i, r in by_id(mixing.op1_mixing(docs.repartition(3))).items()} == {i: r["taken"] for i, r in got.items()}
    assert mixing.op1_mixing(none).count() == 0
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    counts = {r["doc_id"]: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert counts == {i: r["taken"] // size[i] for i, r in got.items() if r["taken"]}


def test_flow_is_cheapest():
    """Quotas of overlapping sources are met with as few repeats as any routing needs."""
    flow = mixing.route([(("a",), 100), (("a", "b"), 100), (("b",), 50)], {"a": 150, "b": 120}, 3)
    used = [sum(v for (i, _), v in flow.items() if i == p) for p in range(3)]
    assert sum(v for (_, s), v in flow.items() if s == "a") == 150 and sum(v for (_, s), v in flow.items() if s == "b") == 120
    assert sum(max(0, u - n) for u, n in zip(used, (100, 100, 50))) == 20
    assert mixing.targets({"a": 10, "b": 1000, None: 10}, (5, 2, 1), 3) == {"a": 30.0, "b": 960.0, None: 30.0}


def test_bpe(docs, rows, none):
    from tokenizers import Tokenizer

    path = vocabulary("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    got = by_id(bpe.op2_bpe(docs, path))
    assert len(got) == len(rows)
    for i, t, _ in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids
        want = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest())
        assert tuple(got[i][c] for c in ("n_tokens", "ids_sha256", "decoded_sha256")) == want, (t or "")[:80]
    assert bpe.op2_bpe(none, path).count() == 0


def test_units_are_kept_when_met_again():
    calls = []

    def encode(texts):
        calls.append(sorted(texts))
        return [t.encode() for t in texts]

    units = UnitEncoder(encode, 2, again=True)
    for text in ("a b", "b c", "b c d", "c d"):
        assert units.values(text.split()) == [w.encode() for w in text.split()]
    assert calls == [["a", "b"], ["b", "c"], ["c", "d"], ["d"]] and set(units.known) == {"b", "c"}


def test_bpe_shuffles_a_text_once(spark):
    """What is put together from shared passages crosses one shuffle, then is written; the plan left over holds no ids."""
    shared = " ".join(f"word{i} of{i % 7}" for i in range(3000))
    docs = spark.createDataFrame([(i, f"{i} {shared} {i}") for i in range(4)], "doc_id long, text string")
    got = bpe.op2_bpe(docs, vocabulary("word_bpe_49k.json"))
    assert len({r["ids_sha256"] for r in got.collect()}) == 4
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" not in plan and "Aggregate" not in plan


def test_chunks_follow_content():
    rng = random.Random(1)
    shared = " ".join(str(rng.random()) for _ in range(900))
    a, b = (bpe.parts(str(rng.random()) * n + " " + shared + " tail") for n in (3, 40))
    assert "".join(bpe.parts(shared)) == shared
    assert len(set(a[1::2]) & set(b[1::2])) >= len(a[1::2]) - 3


def test_substrings(docs, none):
    documents = docs.toPandas()  # noqa: F841
    want = duckdb.sql(substrings.oracle()).df().sort_values("doc_id").reset_index(drop=True)
    got = substrings.op3_substrings(docs).toPandas().sort_values("doc_id").reset_index(drop=True)
    assert want[got.columns].astype(str).equals(got.astype(str)) and got.n_removed.sum() > 0 and (got.n_repeated > got.n_removed).any()
    text = dict(zip(documents.doc_id, documents.text))
    for r in substrings.deduplicated(docs).collect():
        if text[r["doc_id"]] is not None:
            assert "\n".join(text[r["doc_id"]][a:b] for a, b in r["offsets"]) == r["text"]
    assert substrings.op3_substrings(none).count() == 0


def test_passages_of_one_place(spark):
    """Lines put together from several documents stay; the same lines in one earlier document go; a line's own repetitions go but the first."""
    lines = [" ".join(f"{c}{i}" for i in range(9)) for c in "abc"]
    apart = spark.createDataFrame([(i, line) for i, line in enumerate(lines)] + [(8, "\n".join(lines))], "doc_id long, text string")
    assert {r["n_removed"] for r in substrings.op3_substrings(apart).collect()} == {0}
    together = apart.unionByName(spark.createDataFrame([(9, "x\n" + "\n".join(lines[1:]) + "\ny"), (10, "\n".join([lines[0]] * 6))], "doc_id long, text string"))
    got = by_id(substrings.op3_substrings(together))
    assert {i: got[i]["n_removed"] for i in (8, 9, 10)} == {8: 0, 9: 2, 10: 4}
    assert {r["n_removed"] for r in substrings.op3_substrings(together, 28).collect()} == {0, 2}  # four of its lines hold 28 words


def test_substrings_against_all_runs(spark):
    """Every run of lines, however long, against the units; texts of few different lines, some without words."""
    rng, least = random.Random(5), 6
    pool = ["", "  "] + [" ".join(rng.choice("uvw") for _ in range(n)) for n in (1, 1, 2, 2, 3, 3, 5, 7)]
    texts = {d: "\n".join(rng.choice(pool) for _ in range(rng.randint(1, 12))) for d in range(60)}
    held, first, gone = {}, {}, {d: set() for d in texts}
    for d, text in texts.items():
        worded = [(i, tuple(line.split())) for i, line in enumerate(text.split("\n")) if line.split()]
        for a in range(len(worded)):
            for b in range(a, len(worded)):
                run = tuple(w for _, w in worded[a : b + 1])
                if sum(map(len, run)) >= least:
                    held[d, a, b] = (run, [i for i, _ in worded[a : b + 1]])
    for (d, a, b), (run, places) in sorted(held.items()):
        at, end = first.setdefault(run, ((d, a, b), places[-1]))
        if at != (d, a, b):
            gone[d] |= {i for i in places if at[0] != d or i > end}
    got = by_id(substrings.op3_substrings(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), least))
    for d, text in texts.items():
        ends = list(itertools.accumulate(len(line) + 1 for line in text.split("\n")))
        assert got[d]["removed"] == ",".join(f"{ends[i - 1] if i else 0}:{ends[i] - 1}" for i in sorted(gone[d])), text
    assert sum(map(len, gone.values())) > 50


def test_kept_spans(spark, docs, none):
    """Which occurrence stays, and where: the query against its SQL and by hand."""
    documents = docs.toPandas()  # noqa: F841
    want = duckdb.sql(substrings.kept_oracle()).df().sort_values("doc_id").reset_index(drop=True)
    got = substrings.op3_kept_spans(docs).toPandas().sort_values("doc_id").reset_index(drop=True)
    assert sorted(got.columns) == sorted(want.columns) and got.n_removed.sum() > 0
    assert want[got.columns].astype(object).where(want[got.columns].notna(), None).equals(got.astype(object).where(got.notna(), None))
    # A stretch of 13 + 12 words in two lines, a blank one between; each line alone is too short.
    one, two = " ".join(f"w{i}" for i in range(13)), " ".join(f"v{i}" for i in range(12))
    text = f"{one}\n\n{two}"
    few = spark.createDataFrame([(2, f"é\n{text}\nend"), (1, f"{text}\nmore\n{one}"), (3, None), (None, text), (4, f"{one}\nx\n{two}")], "doc_id long, text string")
    n, m = len(one), len(two)
    rest = {1: (f"{text}\nmore\n{one}", 0), 2: ("é\n\nend", 2), None: ("", 2), 4: (f"{one}\nx\n{two}", 0), 3: (None, 0)}
    out = by_id(substrings.op3_kept_spans(few))
    assert {i: (out[i]["text_sha256"], out[i]["n_removed"]) for i in rest} == {i: (t if t is None else hashlib.sha256(t.encode()).hexdigest(), k) for i, (t, k) in rest.items()}
    assert out[2]["kept"] == f"0:1,{n + 3}:{n + 3},{n + m + 5}:{n + m + 8}" and (out[3]["kept"], out[3]["n_units"], out[3]["kept_chars"]) == ("", 0, 0)
    counts = by_id(substrings.op3_substrings(few))
    assert counts[2]["removed"] == f"2:{n + 2},{n + 4}:{n + m + 4}"
    assert {i: (r["n_repeated"], r["kept_chars"]) for i, r in counts.items()} == {1: (2, n + m + n + 8), 2: (2, 6), 3: (0, 0), 4: (0, n + m + 3), None: (2, 0)}
    clash = few.withColumns({c: F.lit(i) for i, c in enumerate(("row", "digest", "pos", "offsets", "marks"))})
    whole = substrings.deduplicated(clash)
    assert whole.columns == [*clash.columns, "offsets_"] and [r["pos"] for r in whole.collect()] == [2] * 5
    assert substrings.op3_kept_spans(none).count() == 0


def groups(rows, k, percent):
    sets = {}
    for i, t, _ in rows:
        w = re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w)} if 0 < len(w) < k else {tuple(w[a : a + k]) for a in range(len(w) - k + 1)}
    up = {i: i for i in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            x, y = sorted((top(a), top(b)))
            up[y] = x
    return {i: (len(sets[i]), top(i)) for i in sets}


@pytest.mark.parametrize("seed", [1, 2])
def test_ngram_join(spark, seed, monkeypatch):
    monkeypatch.setattr(ngram_join, "LARGE", 3 * seed)
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    made = []
    for _ in range(25):
        base = [rng.choice(words) for _ in range(rng.choice([3, 6, 9, 15, 30, 70, 150]))]
        for _ in range(rng.choice([1, 2, 5, 12])):
            t = list(base)
            for _ in range(int(len(t) * rng.choice([0, 0.01, 0.03, 0.05]))):
                t[rng.randrange(len(t))] = rng.choice(words)
            made.append(" ".join(t))
    passage = [f"p{i}" for i in range(40)]
    for n in [*range(12), *[60] * 25]:
        made.append(" ".join([rng.choice(words) for _ in range(n)] + passage + [rng.choice(words) for _ in range(n)]))
    rng.shuffle(made)
    made = [(3 * i + 1, t, None) for i, t in enumerate([*made, None, "", " ", "a b", "A\tB", "a b c d"])]
    df = spark.createDataFrame([r[:2] for r in made], "doc_id long, text string").repartition(3)
    got = {i: (r["n_shingles"], r["component_id"]) for i, r in by_id(ngram_join.op4_ngram_join(df)).items()}
    want = groups(made, 4, 85)
    assert got == want and len({c for _, c in want.values()}) < len(want) - 20


def test_ngram_join_on_documents(docs, rows, none):
    got = {i: (r["n_shingles"], r["component_id"]) for i, r in by_id(ngram_join.op4_ngram_join(docs)).items()}
    assert got == groups(rows, 4, 85)
    assert ngram_join.op4_ngram_join(none).count() == 0
    kept = ngram_join.one_of_each_group(docs)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {c for _, c in groups(rows, 5, 80).values()}


def test_ngram_join_on_repeated_ids(spark):
    """Equal and different texts of one doc_id."""
    rng = random.Random(6)
    a, b, c = ([rng.choice("abcdefghij") + str(rng.randrange(99)) for _ in range(n)] for n in (80, 200, 60))
    text = lambda x, n=0: " ".join(x[: len(x) - n])
    made = [(5, text(a)), (5, text(b)), (5, text(b)), (2, text(a, 1)), (9, text(b, 1)), (7, text(c)), (7, text(c)), (8, None), (8, text(c, 1)), (3, "x y"), (None, text(a)), (None, text(a))]
    want = {2: 2, 5: 2, 9: 2, 7: 7, 8: 7, 3: 3, None: None}
    df = spark.createDataFrame(made, "doc_id long, text string").repartition(2)
    got = [(r["doc_id"], r["component_id"]) for r in ngram_join.op4_ngram_join(df).collect()]
    assert sorted(map(str, got)) == sorted(str((i, want[i])) for i, _ in made)
    more = spark.createDataFrame([(1, "b"), (1, "a"), (1, "b")], "doc_id long, text string")
    kept = [tuple(r) for r in ngram_join.one_of_each_group(df.union(more)).collect()]
    assert sorted(map(str, kept)) == sorted(map(str, [(1, "a"), (2, text(a, 1)), (7, text(c)), (3, "x y"), (None, text(a)), (None, text(a))]))


def test_documents_without_those_gone(spark):
    ids = [None, 0, 0, -3, 5, 2**62 + 1, -(2**63), *range(100, 200)]
    df = spark.createDataFrame([(i, f"t{n}") for n, i in enumerate(ids)], "doc_id long, text string")
    for gone in ([], [-3, 2**62 + 1], [0], [*range(100, 200, 2), -(2**63)]):
        kept = ngram_join._without(df, spark.createDataFrame([(g,) for g in gone], "gone long")).collect()
        assert sorted(r["text"] for r in kept) == sorted(f"t{n}" for n, i in enumerate(ids) if i not in gone)


def test_ngram_join_beside_a_shared_passage(spark):
    """Two linked texts whose agreeing segments partly stand in large buckets."""
    rng = random.Random(9)
    for trial in range(2):
        passage = [f"p{trial}{i}" for i in range(14)]
        a = [f"a{rng.randrange(10**6)}" for _ in range(7)] + passage + [f"b{rng.randrange(10**6)}" for _ in range(7)]
        b = a[:-2] + [f"c{rng.randrange(10**6)}" for _ in range(2)]
        rest = [[f"f{rng.randrange(10**6)}" for _ in range(6)] + passage + [f"g{rng.randrange(10**6)}" for _ in range(6)] for _ in range(45)]
        made = [(i + 1, " ".join(t), None) for i, t in enumerate([a, b, *rest])]
        df = spark.createDataFrame([r[:2] for r in made], "doc_id long, text string").repartition(2)
        got = {i: (r["n_shingles"], r["component_id"]) for i, r in by_id(ngram_join.op4_ngram_join(df)).items()}
        assert got == groups(made, 4, 85) and got[2][1] == 1


def test_token_ids_on_white_space():
    from tokenizers import Tokenizer

    path = vocabulary("byte_bpe_50k.json")
    tok, enc, rng = Tokenizer.from_file(path), token_files.byte_encoder(path), random.Random(2)
    for _ in range(4000):
        t = "".join(rng.choice(["a", "b,", "12", " ", " ", "\n", "\t", "\r", "\x0b", "\x1c", "\x85", "\u2028", "\u3000", "é"]) for _ in range(rng.randint(1, 14)))
        assert enc.ids(t).tolist() == tok.encode(t, add_special_tokens=False).ids, repr(t)


def test_buckets_lose_no_link():
    rng = np.random.default_rng(5)
    for percent in (80, 85, 95):
        for _ in range(300):
            n = int(rng.integers(1, 300))
            a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
            out = int(rng.integers(0, max(1, n * (100 - percent) // 100 + 1)))
            b = np.unique(np.concatenate([a[out:], rng.integers(0, 1 << 63, int(rng.integers(0, 3)), dtype=np.uint64)]))
            both = len(np.intersect1d(a, b))
            if not np.array_equal(a, b) and 100 * both >= percent * (len(a) + len(b) - both):
                assert len(np.intersect1d(ngram_join.keys(a, percent)[0], ngram_join.keys(b, percent)[0]))


def phrases(text):
    out, start = set(), 0
    for e in range(1, len(text) + 1):
        if text[start:e] not in out:
            out.add(text[start:e])
            start = e
    return out


def test_lz_fingerprint(docs, rows, none):
    got = by_id(lz_fingerprint.op5_lz_fingerprint(docs, parts=7))
    order = sorted(rows, key=lambda r: -r[0])
    near = []
    for i, (d, t, _) in enumerate(order):
        t, after = t or "", order[(i + 1) % len(order)][1] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        assert got[d]["n_chars"] == len(t)
        assert got[d]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        one = lz_fingerprint.Parsed(edited)
        assert got[d]["edited_fingerprint"] == lz_fingerprint.shown(one.signature)
        ends = []
        lz_fingerprint.parse(edited, {}, {}, 0, 0, ends, [])
        root, ends = {}, []
        lz_fingerprint.parse(edited, root, root, 0, len(edited), ends, [])
        assert {edited[a:b] for a, b in zip([0, *ends], ends)} == phrases(edited)
        if len(t) > 500 and len(after) > 500 and t != after:
            near.append(got[d]["near_edited"] > got[d]["near_next"])
    assert np.mean(near) > 0.97
    same = [i for i, t, _ in rows if t == "same text"]
    assert len({got[i]["fingerprint"] for i in same}) == 1
    assert lz_fingerprint.op5_lz_fingerprint(none).count() == 0
    alone = lz_fingerprint.op5_lz_fingerprint(docs.where("doc_id = 1000007"), parts=3).first()
    assert alone["near_next"] == 1.0


def base_spans(t):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[ -]", "", m[0])
        if 16 <= len(d) <= 19 and pii.luhn(d):
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def test_pii(docs, rows, none):
    got = by_id(pii.op6_pii(docs))
    for i, t, _ in rows:
        want = base_spans(t or "")
        assert got[i]["base_sha256"] == hashlib.sha256(pii.joined(want).encode()).hexdigest()
        assert [got[i][f"n_{k}"] for k in pii.BASE] == [sum(s[0] == k for s in want) for k in pii.BASE]
    rng = random.Random(3)
    for _ in range(4000):
        t = "".join(rng.choice("a@.-+1 9(,é%") if rng.random() < 0.5 else rng.choice("0123456789 -.") for _ in range(rng.randint(1, 70)))
        assert [s for s in pii.finder().spans(t) if s[0] in pii.BASE] == base_spans(t), t
    assert pii.op6_pii(none).count() == 0
    assert pii.mask("write a.b@c.de or +1 (017) 555-7713 now") == "write <email> or <phone> now"
    assert pii.mask("see https://x.org/a?b=1. IBAN: DE89 3704 0044 0532 0130 00 token = abcdefghij0123456789") == "see <url>. IBAN: <account> token = <secret>"
    masked = pii.masked_documents(docs)
    assert masked.columns == docs.columns and masked.count() == docs.count()


def test_long_secrets_and_any_case():
    assert pii.mask("token = " + "a1" * 100) == "token = <secret>"
    assert pii.mask("İ Account Number: 12345678, Api_Key = " + "Zz" * 12) == "İ Account Number: <account>, Api_Key = <secret>"
    assert pii.mask("pay DE89 3704 0044 0532 0130 00 now") == "pay <account> now"
    assert pii.mask("pay DE88370400440532013000 now, xDE89370400440532013000") == "pay DE88370400440532013000 now, xDE89370400440532013000"


def test_token_files(docs, rows, none, tmp_path):
    from tokenizers import Tokenizer

    path = vocabulary("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    got, start = by_id(token_files.op7_token_files(docs, path)), 0
    for i, t, _ in sorted(rows):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        want = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        assert tuple(got[i][c] for c in ("start", "n_tokens", "ids_crc32")) == want, (t or "")[:60]
        start += len(ids)
    assert token_files.op7_token_files(none, path).count() == 0
    least, size = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), sum(len((t or "").encode()) for _, t, _ in rows)
    assert token_files.files_for(docs) == token_files.files_for(none) == least
    assert token_files.files_for(docs, 1000) == -(-size // 1000) > least
    name = tmp_path / "x"
    with open(name, "wb") as sink:
        w = token_files.Writer(sink)
        for d in range(50):
            w.add(d, np.arange(d * 2000, dtype="<u4"))
        w.close()
    with open(name, "rb") as source:
        r = token_files.Reader(source, name.stat().st_size)
        assert [(d, len(x)) for d, x in r.documents({3, 47})] == [(3, 6000), (47, 94000)]
    data = bytearray(name.read_bytes())
    import zstandard

    whole = zstandard.ZstdDecompressor().stream_reader(bytes(data), read_across_frames=True).read()
    assert len(whole) == 4 * sum(2000 * d for d in range(50))
    data[100] ^= 1
    name.write_bytes(data)
    with open(name, "rb") as source, pytest.raises((ValueError, zstandard.ZstdError)):
        list(token_files.Reader(source, len(data)).documents())


def test_quality_rules(docs, none):
    documents = docs.toPandas()  # noqa: F841
    want = duckdb.sql(quality_rules.oracle()).df().sort_values("doc_id").reset_index(drop=True)
    out = quality_rules.op8_quality_rules(docs)
    got = out.toPandas().sort_values("doc_id").reset_index(drop=True)
    assert want[got.columns].equals(got)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert quality_rules.op8_quality_rules(none).count() == 0


def test_token_counts(docs, rows, none):
    path = vocabulary("piece_bpe_32k.model")
    got = by_id(token_counts.op9_token_counts(docs, path))
    for i, t, _ in rows:
        n = len(token_counts.model(path).encode(t or ""))
        assert (got[i]["n_bytes"], got[i]["n_tokens"], got[i]["over_limit"]) == (len((t or "").encode()), n, n > 4096), (t or "")[:60]
    assert token_counts.op9_token_counts(none, path).count() == 0


def test_frequent_pre_tokens(docs, rows, none):
    """The table of frequent pre-tokens, over several levels of summaries, against one count of all texts."""
    seen = Counter()
    for i, t, _ in rows:
        us, plain = token_counts.units(t or "")
        seen.update(u for u in us if i < 60 and plain and len(u) <= token_counts.LONGEST)
    want = [u for u, _ in sorted(seen.items(), key=lambda x: (-x[1], x[0]))]
    assert 1000 < len(want) < token_counts.FREQUENT  # so no level cuts its summaries
    few = docs.where("doc_id < 60").repartition(11)
    assert token_counts.frequent(few, fan=2) == want
    assert token_counts.frequent(few) == want
    assert token_counts.frequent(none) == []


def test_quality_model(spark, none):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = quality_model.op10_quality_model(docs, labels).join(labels, "doc_id").toPandas()
    held = got[got.held_out]
    assert len(held) > 40 and (held.predicted == held.quality).mean() > 0.93
    assert all(h == (zlib.crc32(str(d).encode()) % 5 == 0) for d, h in zip(got.doc_id, got.held_out))
    assert got.score.between(0, 1).all()
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = quality_model.op10_quality_model(docs.limit(3), empty).collect()
    assert [r["score"] for r in out] == [quality_model.PRIOR] * 3
    assert quality_model.op10_quality_model(none, labels).count() == 0
    assert quality_model.isotonic([1, 1, 1, 1], [0, 1, 0, 1]) == [0, 0.5, 0.5, 1]
    kept = quality_model.accepted_documents(docs, labels)
    bad = kept.join(labels.where("quality = 0"), "doc_id").count()
    good = kept.join(labels.where("quality = 1"), "doc_id").count()
    assert kept.columns == docs.columns and bad < 8 and good == labels.where("quality = 1").count()


def test_pipeline(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    docs = corpus_pipeline.quality(spark, docs, sf)
    before = [(r["doc_id"], r["text"], None) for r in docs.collect()]
    docs = corpus_pipeline.near_duplicates(spark, docs, sf)
    assert {r["doc_id"] for r in docs.select("doc_id").collect()} == {c for _, c in groups(before, 5, 80).values()}
    docs = corpus_pipeline.personal_data(spark, docs, sf)
    assert docs.columns == columns
    assert docs.where(F.col("text").rlike("[A-Za-z0-9]@[a-z0-9-]+[.][a-z]")).count() == 0
    docs = corpus_pipeline.mixture(spark, docs, sf)
    assert docs.columns == columns
    want = sorted((r["doc_id"], len(tok.encode(r["text"], add_special_tokens=False).ids)) for r in docs.collect())
    got = sorted((r["doc_id"], r["n_tokens"]) for r in corpus_pipeline.run(spark, sf).collect())
    assert got == want


def test_a_worker_keeps_the_caches_of_one_operator(monkeypatch):
    """Workers go on through all stages of a pipeline: what other operators kept goes, and each task gives its memory back at its end."""
    from claimlens.llm import batches

    monkeypatch.setattr(batches, "_CACHES", [])
    words, tokenizers, encoders = {b"a": 1}, {"t": 1}, {"e": 1}
    batches.sole(words)
    batches.sole(words)
    assert words
    batches.sole(tokenizers, encoders)
    assert not words and tokenizers and encoders
    batches.sole(words)
    assert not tokenizers and not encoders
    freed = []
    monkeypatch.setattr(batches, "_trim", lambda: freed.append)
    task = batches.tidy(iter)([1, 2])
    assert next(task) == 1 and not freed
    assert list(task) == [2] and freed == [0]


def test_bucket_rows_carry_one_null_beside_their_key(spark):
    """Of 46 million bucket rows each had four null columns to be copied and sorted; now a document's values are one column."""
    from claimlens.llm import ngram_join

    docs = spark.createDataFrame([(i, f"one two three four five six seven eight nine {i % 3}") for i in range(9)], "doc_id long, text string")
    made = docs.mapInArrow(ngram_join._rows(4, 85, None), ngram_join._ROW)
    assert len(made.columns) == 5
    rows = made.collect()
    assert any(r["tag"] >= 0 for r in rows) and all((r["whole"] is None) == (r["tag"] >= ngram_join.DELEGATE) for r in rows)
    assert {r["doc_id"]: r["component_id"] for r in ngram_join.op4_ngram_join(docs).collect()} == {i: i % 3 for i in range(9)}
