"""Field reading against a plain version, word by word; canonical text and grading."""

import difflib
import random
import unicodedata

from claimlens.functions import text
from claimlens.operators import evaluate, reading
from pyspark.sql import functions as F

WORDS = "doc string, page int, block int, par int, line int, left int, top int, width int, height int, text string, conf double"


def plain(t):
    return "".join(c for c in t.lower() if c in "abcdefghijklmnopqrstuvwxyz0123456789")


def alike(a, b):
    return difflib.SequenceMatcher(None, a, b).ratio()


def label_in(line, f):
    """(rank, likeness, -start, place of the label's last word) of the best window."""
    tokens, found = f.label.split(), []
    n = len(tokens)
    for size, rank in [(n, 2), (n + 1, 1)] + [(n - 1, 0)] * (n >= 3):
        for start in range(len(line) - size + 1) if f.midline else range(min(1, len(line) - size + 1)):
            seen = plain(" ".join(w[9] for w in line[start : start + size]))
            if seen and alike(seen, plain(" ".join(tokens[:size]))) >= 0.78:
                found.append((rank, alike(seen, plain(" ".join(tokens[:size]))), -start, start + size - 1))
    return max(found, default=None)


def value_of(words):
    shown = " ".join(w[9] for w in words).strip(" :.-")
    if not words or not shown:
        return None
    conf = sum(w[10] for w in words) / len(words) / 100
    return shown, round(min(1, max(0, conf)), 9), min(w[5] for w in words), min(w[6] for w in words), max(w[5] + w[7] for w in words), max(w[6] + w[8] for w in words)


def brute(words):
    docs = {}
    for w in words:
        if (w[9] or "").strip() and w[10] and w[10] > 0:
            docs.setdefault(w[0], {}).setdefault(w[1:5], []).append((*w[:9], w[9].strip(), w[10]))
    out = {}
    for doc, lines in docs.items():
        order = sorted(lines, key=lambda k: (k[0], sorted(lines[k], key=lambda w: w[5:7])[0][6], k))
        page = [sorted(lines[k], key=lambda w: (w[5], w[6])) for k in order]
        for f in reading.FIELDS:
            best = None
            for i, line in enumerate(page):
                hit = label_in(line, f)
                if not hit:
                    continue
                if f.below:
                    best = (0, 0, value_of(page[i + 1]) if i + 1 < len(page) else None)
                    break
                end = line[hit[3]]
                tail = [w for w in line if w[5] >= end[5] + end[7] - 2]
                if f.stop:
                    cut = next((j for j, w in enumerate(tail) if alike(plain(w[9]), plain(f.stop)) >= 0.8), len(tail))
                    tail = tail[:cut]
                v = value_of(tail)
                if v and (best is None or hit[:2] > best[:2]):
                    best = (*hit[:2], v)
            out[doc, f.name] = best[2] if best else None
    return out


def page(doc, *lines, page=1):
    return [(doc, page, 1, 1, i, 40 + 70 * j, 20 + 30 * i, 60, 18, w, 60.0 + j) for i, line in enumerate(lines) for j, w in enumerate(line.split(" "))]


def damaged(rng, word):
    k = rng.randrange(len(word))
    return rng.choice([word, word, word[:k] + word[k + 1 :], word[:k] + rng.choice("lI1.f") + word[k + 1 :], word[:k] + " " + word[k:], word.upper()]).strip() or "x"


def made():
    rng = random.Random(21)
    labels = [f.label for f in reading.FIELDS] + ["Date", "PIN", "Members in", "District Office", "Nothing here"]
    rows = []
    for d in range(60):
        lines = []
        for _ in range(rng.randint(1, 14)):
            words = [damaged(rng, w) for w in rng.choice(labels).split()] + [rng.choice(["Mill", "Lane", "44", "-", ":", "Date", "Usha", "Date of Issue", "9/1"]) for _ in range(rng.randint(0, 4))]
            lines.append(" ".join(words))
        rows += page(f"d{d}", *lines)
    rows += page("two pages", "District Northern", "PIN Code 111") + page("two pages", "PIN Code 222", "Issuing Authority", page=2)
    rows += [("empty", 1, 1, 1, 1, 5, 5, 5, 5, t, c) for t, c in ((None, 50.0), (" ", 50.0), ("District", 0.0), ("District", None), ("District", -1.0))]
    rows += page("one word", "District") + page("below", "lssuing Authority", ": -", "Taluk") + page("below last", "Issuing Authority")
    rng.shuffle(rows)
    return rows


def test_reading_equals_plain_version(spark):
    rows = made()
    df = spark.createDataFrame(rows, WORDS).repartition(5).withColumn("field", F.lit("x"))
    got = {}
    for r in reading.read_fields(df).collect():
        v = None if r["value"] is None else (r["value"], round(r["confidence"], 9), r["left"], r["top"], r["right"], r["bottom"])
        assert (r["doc"], r["field"]) not in got
        got[r["doc"], r["field"]] = v
    want = brute(rows)
    assert got == want and sum(v is not None for v in want.values()) > 150
    assert ("empty", "district") not in got
    assert reading.read_fields(df.where("false")).count() == 0


def test_labels_in_doubtful_places(spark):
    rows = page("masthead", "PORTAL OF THE e-DISTRICT - DEMO", "District Harbour") + page("lost", "Members in 7") + page("short", "PIN Code 700001", "(in words) Ninety Thousand")
    rows += page("late", "Addres Name Board", "Address 4 Mill Lane") + page("shared", "Certificate No. QX-7 Date of Issue: 2031-02-03") + page("letter", "fssuing Authority", "Harbour Ward Office")
    got = {(r["doc"], r["field"]): r["value"] for r in reading.read_fields(spark.createDataFrame(rows, WORDS)).where("value is not null").collect()}
    assert got == {
        ("masthead", "district"): "Harbour", ("lost", "family_size"): "7", ("short", "pincode"): "700001", ("short", "annual_income_words"): "Ninety Thousand",
        ("late", "address"): "4 Mill Lane", ("shared", "certificate_id"): "QX-7", ("shared", "issue_date"): "2031-02-03", ("letter", "issuing_office"): "Harbour Ward Office",
    }


def test_canonical_text_and_grading(spark):
    cases = ["Ünder–Way", "a—b_c", "  A,  b.\tC ", "Straße", "ﬁne", None, "", "Café", "İx"]
    got = [r["x"] for r in spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, c string").orderBy("i").select(text.canonical_text(F.col("c")).alias("x")).collect()]
    assert got[:4] == ["u nder-way", "a-b_c", "a b c", "strasse"] and got[4:8] == ["fine", "", "", "cafe"]
    assert got[8] == unicodedata.normalize("NFKD", "İx").replace("̇", " ").casefold()
    truth = [("d", "annual_income", "178000"), ("d", "family_size", "4"), ("d", "name", "Usha B"), ("d", "office", "Ward–2"), ("d", "pin", "7"), ("d", "none", None), ("e", "annual_income", "178000"), ("e", "office", "Ward 2"), ("e", "family_size", "x")]
    read = [("d", "annual_income", "Rs. 1,78,000/-"), ("d", "family_size", "4 persons"), ("d", "name", "USHA, B."), ("d", "office", "ward-2"), ("d", "pin", " "), ("e", "annual_income", "1,78,000.00"), ("e", "office", "Ward-2"), ("e", "family_size", "5")]
    cols = "document string, field string, value string"
    grades = evaluate.graded(spark.createDataFrame(truth, cols), spark.createDataFrame(read, cols))
    assert {(r["document"], r["field"]): r["status"] for r in grades.collect()} == {
        ("d", "annual_income"): "right", ("d", "family_size"): "right", ("d", "name"): "right", ("d", "office"): "right", ("d", "pin"): "missing",
        ("e", "annual_income"): "wrong", ("e", "office"): "wrong", ("e", "family_size"): "wrong",
    }
    whole = evaluate.whole_documents(grades.where("field <> 'pin'")).first()
    assert (whole["documents"], whole["correct"]) == (2, 1)


def test_page_report(spark):
    rows = page("same", "Annual Family Income Rs. 91,500/-", "in words Ninety One Thousand Five Hundred Rupees") + page("other", "Annual Family Income 91500", "in words Ninety Thousand")
    rows += page("half", "Annual Family Income 91500") + [("same", 1, 1, 1, 9, 1, 400, 5, 5, "ghost", 0.0)]
    df = spark.createDataFrame(rows, WORDS)
    got = {r["doc"]: r for r in reading.page_report(df, reading.read_fields(df), text.parse_income(F.col("figures")), text.parse_income_words(F.col("spelt"))).collect()}
    assert [got[d]["words_mismatch"] for d in ("same", "other", "half")] == [False, True, None]
    assert got["half"]["word_count"] == 4 and abs(got["half"]["confidence"] - 0.615) < 1e-9 and got["same"]["word_count"] == 13
