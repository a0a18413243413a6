"""Odd rows for every operator: null ids, rows repeated in full, very long texts, columns with clashing names, empty tables."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from claimlens.llm import bpe, lz_fingerprint, mixing, ngram_join, pii, quality_model, quality_rules, token_counts, token_files
from claimlens.llm.queries import vocabulary
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
LETTERS, WORDS = "x" * 1_000_000, "over and over " * 100_000
ROWS = [
    (None, None, None), (None, "no id here", "a"), (None, "no id here", "a"), (1, "one text of its own", "a"), (1, "one text of its own", "a"), (1, "another text", "b"),
    (2, "", None), (3, " \n\t", "b"), (4, LETTERS, "a"), (5, WORDS, "b"), (6, "mail q.r@st.uv now", "a"), (6, None, "a"), (7, LETTERS, "b"),
]
#: Names that operators use themselves, and one that has to be quoted.
CLASH = ["_mix_size", "_mix_repeats", "grp", "quota", "key", "lo", "hi", "n", "digest", "gone", "often", "name", "rest", "x", "score", "unit", "a.b"]
SCHEMA = "doc_id long, text string, source string, " + ", ".join(f"`{c}` int" for c in CLASH) + ", extra map<string, int>, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    rest = [*range(len(CLASH)), {"k": 1}, 5]
    return spark.createDataFrame([(*r, *rest) for r in ROWS], SCHEMA).repartition(4)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def bag(df, *columns):
    return Counter(tuple(r) for r in df.select(*columns).collect())


def test_mixing(docs, none):
    size = lambda t: len(re.findall(WORD, t or ""))
    total = Counter()
    for _, t, s in ROWS:
        total[s] += size(t)
    got = mixing.op1_mixing(docs)
    assert bag(got, "doc_id", "size", "source_size") == Counter((i, size(t), total[s]) for i, t, s in ROWS)
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in got.collect())
    taken = Counter()
    for r in got.collect():
        taken[r["doc_id"], r["size"]] += r["taken"]
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns and mixing.mixed_documents(none).count() == 0
    again = Counter()
    for r in mixed.collect():
        assert [r[c] for c in CLASH] == list(range(len(CLASH))) and r["extra"] == {"k": 1}
        again[r["doc_id"], size(r["text"])] += size(r["text"])
    assert again == Counter({k: v for k, v in taken.items() if v})


def test_mixing_of_one_row_repeated(spark):
    """Rows repeated in full have one hash: they are taken alike."""
    rows = [(1, "w " * 10, "a")] * 500 + [(2 + i, "v " * 10, "b") for i in range(50)]
    got = mixing.op1_mixing(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)).collect()
    assert len(got) == 550 and len({r["taken"] for r in got if r["doc_id"] == 1}) == 1


def test_bpe(docs):
    from tokenizers import Tokenizer

    path = vocabulary("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    want = Counter()
    for i, t, _ in ROWS:
        ids = tok.encode(t or "", add_special_tokens=False).ids
        text = tok.decode(ids, skip_special_tokens=False)
        want[i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()] += 1
    assert bag(bpe.op2_bpe(docs, path), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == want


def test_ngram_join(docs, none):
    got = ngram_join.op4_ngram_join(docs)
    assert got.count() == len(ROWS)
    of = {(r["doc_id"], r["n_shingles"]): r["component_id"] for r in got.collect()}
    assert of[4, 1] == of[7, 1] == 4 and of[None, 1] is None and of[5, 3] == 5
    kept = ngram_join.one_of_each_group(docs)
    assert kept.columns == docs.columns
    assert bag(kept.where("doc_id is not null"), "doc_id") == Counter({(i,): 1 for i in (1, 2, 3, 4, 5, 6)}) and kept.where("doc_id is null").count() == 3
    assert kept.where("doc_id = 1").first()["text"] == "another text" and all(r["extra"] == {"k": 1} for r in kept.collect())
    assert ngram_join.one_of_each_group(none).count() == 0


def test_fingerprint(docs):
    got = lz_fingerprint.op5_lz_fingerprint(docs, parts=3).collect()
    assert Counter((r["doc_id"], r["n_chars"]) for r in got) == Counter((i, len(t or "")) for i, t, _ in ROWS)
    assert len({r["fingerprint"] for r in got if r["n_chars"] == 0}) == 1 and len({r["fingerprint"] for r in got if r["doc_id"] in (4, 7)}) == 1
    assert all(0 <= r[c] <= 1 for r in got for c in ("near_edited", "near_next"))


def test_pii(docs, none):
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = Counter((i, int("@" in (t or "")), 0, 0, 0, sha("email:5:14" if "@" in (t or "") else "")) for i, t, _ in ROWS)
    assert bag(pii.op6_pii(docs), "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256") == want
    masked = pii.masked_documents(docs)
    assert masked.columns == docs.columns and bag(masked, "doc_id", "text") == Counter((i, t and t.replace("q.r@st.uv", "<email>")) for i, t, _ in ROWS)
    assert all(r["extra"] == {"k": 1} and r["a.b"] == CLASH.index("a.b") for r in masked.select("extra", "`a.b`").collect())
    assert pii.masked_documents(none).count() == 0


def test_token_files(docs):
    from tokenizers import Tokenizer

    path = vocabulary("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    ids = lambda t: [*tok.encode(t or "", add_special_tokens=False).ids, 2]
    got = token_files.op7_token_files(docs, path).collect()
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == Counter((i, len(ids(t)), zlib.crc32(np.array(ids(t), "<u4").tobytes())) for i, t, _ in ROWS)
    order = sorted(got, key=lambda r: r["start"])
    assert [r["start"] for r in order] == [sum(r["n_tokens"] for r in order[:i]) for i in range(len(order))]
    known = [r["doc_id"] for r in order if r["doc_id"] is not None]
    assert known == sorted(known)


def rules_of(text):
    """The base columns, word by word."""
    ws = re.findall(WORD, text or "")
    lines = [x for x in (text or "").split("\n") if re.search(WORD, x)]
    found = Counter(tuple(ws[i : i + 8]) for i in range(len(ws) - 7))
    again = {i + k for i in range(len(ws) - 7) if found[tuple(ws[i : i + 8])] > 1 for k in range(8)}
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return len(ws), sum(map(len, ws)), symbols, len(lines) - len(set(lines)), len(again), len(ws) < 20 or 100 * len(again) > 30 * len(ws)


def test_quality_rules(docs):
    got = quality_rules.op8_quality_rules(docs)
    columns = "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"
    assert bag(got, "doc_id", *columns) == Counter((i, *rules_of(t)) for i, t, _ in ROWS)
    assert got.where("base_failed and kept").count() == 0


def test_token_counts(docs):
    path = vocabulary("piece_bpe_32k.model")
    want = Counter()
    for i, t, _ in ROWS:
        n = len(token_counts.model(path).encode(t or ""))
        want[i, len((t or "").encode()), n, n > 4096] += 1
    assert bag(token_counts.op9_token_counts(docs, path), "doc_id", "n_bytes", "n_tokens", "over_limit") == want


def test_quality_model(docs, none, spark):
    labels = spark.createDataFrame([(i, i % 2, 0, "x") for i in range(8)] * 2 + [(None, 1, 0, "x"), (3, None, None, None)], "doc_id long, quality int, toxic int, text string")
    got = quality_model.op10_quality_model(docs, labels).collect()
    assert Counter((r["doc_id"],) for r in got) == Counter((i,) for i, _, _ in ROWS)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    kept = quality_model.accepted_documents(docs, labels)
    assert kept.columns == docs.columns and kept.count() <= len(ROWS)
    assert quality_model.accepted_documents(none, labels).count() == 0
    assert kept.select(F.col("`a.b`")).distinct().count() <= 1
