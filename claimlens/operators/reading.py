"""Reading of form fields from the words of a page, anchored at printed labels.

words: doc, page, block, par, line, left, top, width, height, text, conf. Words are
put together to lines, and every window of words that may be a label is compared
with the labels it may be; likeness is the sequence ratio of difflib, which has no
built-in form, so it alone is a function in Python, on pairs that can still reach
the threshold by their lengths and letters. A line keeps the best window of each
field, a document the best line. Lines are gathered by line and fields by document,
never a document's words as a whole; lines are written once, and read once.

Defined cases: words without text or confidence are left out; a document without a
readable word has no rows, any other a row for every field, null where nothing was
read; of windows and lines alike in rank and likeness the first counts; words of one
place, or repeated in full, stand in the order of their text.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass
from difflib import SequenceMatcher
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimlens.session import materialize


@dataclass(frozen=True)
class Field:
    """A label and what it names; stop: the word another label on the same line begins with; midline: the label may
    stand anywhere in its line; below: the value is the line after the label's."""

    label: str
    name: str
    stop: str | None = None
    midline: bool = False
    below: bool = False


#: The labels of the form.
FIELDS = (
    Field("Name of Applicant", "applicant_name"),
    Field("Father / Guardian", "guardian_name"),
    Field("Address", "address"),
    Field("District", "district"),
    Field("PIN Code", "pincode"),
    Field("Members in Family", "family_size"),
    Field("Annual Family Income", "annual_income"),
    Field("in words", "annual_income_words"),
    Field("Certificate No.", "certificate_id", stop="Date"),
    Field("Date of Issue", "issue_date", midline=True),
    Field("Issuing Authority", "issuing_office", below=True),
)
#: Likeness from which a window is taken for a label, and a word for the one a value stops at.
LABEL, STOP = 0.78, 0.8
#: Ranks of a window: as many words as the label, one more (a word was split), one less (a word was lost).
EXACT, SPLIT, LOST = 2, 1, 0
_LINE = ["doc", "page", "block", "par", "line"]
#: What is read of a field.
READ = ("value", "confidence", "left", "top", "right", "bottom")
#: Words are put together to lines by sorting: a hash of so many lines would be sorted after all, twice.
_SORTED = {"spark.sql.execution.useObjectHashAggregateExec": "false"}


@lru_cache(1 << 10)
def _matcher(b: str) -> SequenceMatcher:
    return SequenceMatcher(None, "", b)


@lru_cache(1 << 16)
def ratio(a: str, b: str) -> float:
    """The sequence ratio, or an upper bound of it that is below LABEL; what is needed of b, a label, is found once."""
    both = _matcher(b)
    both.set_seq1(a)
    most = both.quick_ratio()
    return most if most < LABEL else both.ratio()


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def likenesses(words: pa.Array, to: pa.Array) -> pa.Array:
    """The likeness of every word of an array to the one in the same place of the other, null for null."""
    pairs = zip(words.to_pylist(), to.to_pylist())
    return pa.array([None if a is None or b is None else [ratio(x, y) for x, y in zip(a, b)] for a, b in pairs], pa.list_(pa.float64()))


def plain(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def lines(words: DataFrame) -> DataFrame:
    """(doc, at, words, next): the lines of a document in reading order, words from left to right, and the words of the next."""
    good = words.withColumn("text", F.btrim("text")).where("text <> '' and conf > 0")
    word = F.struct(
        F.col("left"), F.col("top"), (F.col("left") + F.col("width")).alias("right"), (F.col("top") + F.col("height")).alias("bottom"), F.col("text"),
        F.col("conf").cast("double").alias("conf"), plain(F.col("text")).alias("plain"),
    )
    one = good.groupBy(*_LINE).agg(F.sort_array(F.collect_list(word)).alias("words"))
    order = Window.partitionBy("doc").orderBy("page", F.col("words")[0]["top"], "block", "par", "line")
    return one.select("doc", F.row_number().over(order).alias("at"), "words", F.lead("words").over(order).alias("next"))


@lru_cache(1 << 16)
def _letters(word: str) -> int:
    """The letters of a word as bits."""
    out = 0
    for c in word:
        out |= 1 << (ord(c) & 63)
    return out


class Labels:
    """Windows of a line of words that are like the labels of fields.

    The ratio counts letters that two texts share in order, so lengths and the letters that one has and the other hasn't
    tell of most windows that they are too unlike; only the others are compared. Heads of lines are looked up once.
    """

    def __init__(self, fields: tuple[Field, ...]):
        self.longest = 1 + max(len(f.label.split()) for f in fields)
        self.heads, self.within = defaultdict(list), []  # heads: by size and length
        for i, f in enumerate(fields):
            tokens = f.label.split()
            n = len(tokens)
            for size, rank in ((n, EXACT), (n + 1, SPLIT), *([(n - 1, LOST)] if n > 2 else [])):
                label = plain_text(" ".join(tokens[: min(size, n)]))
                one = i, rank, size, label, len(label), _letters(label)
                for a in range(1, 4 * len(label)):
                    if 2 * min(a, len(label)) >= LABEL * (a + len(label)) - 1e-9:
                        self.heads[size, a].append(one)
                if f.midline:
                    self.within.append(one)
        self.head = lru_cache(1 << 16)(self._head)

    @staticmethod
    def may_be(a: int, letters: int, b: int, of: int) -> bool:
        most = min(a - (letters & ~of).bit_count(), b - (of & ~letters).bit_count())
        return a > 0 and 2 * most >= LABEL * (a + b) - 1e-9

    def _head(self, size: int, seen: str, letters: int) -> list[tuple]:
        a, out = len(seen), []
        for i, rank, _, label, b, of in self.heads.get((size, a), ()):
            if self.may_be(a, letters, b, of) and (alike := ratio(seen, label)) >= LABEL:
                out.append((i, rank, alike, 0, size))
        return out

    def find(self, words: list[str]) -> list[tuple]:
        """(field, rank, likeness, -start, size) of the best window of each field."""
        seen, letters, found = "", 0, []
        masks = list(map(_letters, words))
        for n, w in enumerate(words[: self.longest], 1):
            seen += w
            letters |= masks[n - 1]
            found += self.head(n, seen, letters)
        rest = 0
        for m in masks[1:]:
            rest |= m
        for i, rank, size, label, b, of in self.within:
            spare = int(b - LABEL * b / (2 - LABEL) + 1e-9)  # so many of the label's letters may be missing, whatever the window
            if len(words) <= size or (of & ~rest).bit_count() > spare:
                continue
            for start in range(1, len(words) - size + 1):
                letters = 0
                for m in masks[start : start + size]:
                    letters |= m
                if (of & ~letters).bit_count() > spare:
                    continue
                seen = "".join(words[start : start + size])
                if self.may_be(len(seen), letters, b, of) and (alike := ratio(seen, label)) >= LABEL:
                    found.append((i, rank, alike, -start, size))
        if len(found) < 2:
            return found
        best = {}
        for k in found:
            if k[0] not in best or k[1:4] > best[k[0]][1:4]:
                best[k[0]] = k
        return list(best.values())


@lru_cache(8)
def _labels(fields: tuple[Field, ...]) -> Labels:
    return Labels(fields)


_HIT = "array<struct<field:string,rank:int,alike:double,start:int,size:int>>"


def labelled(shown: Column, fields: tuple[Field, ...] = FIELDS) -> Column:
    """The best window of each field in a line (null if none). shown: what its words show, with a space between two."""
    names = [f.name for f in fields]

    def likenesses(lines: pa.Array) -> pa.Array:
        find = _labels(fields).find
        ends, some = [0], []
        for line in lines.to_pylist():
            some += find(line.split(" "))
            ends.append(len(some))
        columns = list(zip(*some)) if some else [()] * 5
        i, rank, alike, start, size = columns
        flat = pa.StructArray.from_arrays(
            [pa.array([names[x] for x in i], pa.string()), pa.array(rank, pa.int32()), pa.array(alike, pa.float64()), pa.array([-x for x in start], pa.int32()), pa.array(size, pa.int32())],
            ["field", "rank", "alike", "start", "size"],
        )
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)

    return F.arrow_udf(likenesses, _HIT)(shown)


def _value(words: Column, columns: tuple[str, ...]) -> Column:
    """What is read from words: the text without marks at its ends, mean confidence, and the box around them; of these the columns named."""
    text = F.btrim(F.array_join(F.transform(words, lambda x: x["text"]), " "), F.lit(" :.-"))
    conf = F.aggregate(words, F.lit(0.0), lambda s, x: s + x["conf"]) / F.size(words) / 100
    box = [F.array_min(F.transform(words, lambda x: x["left"])), F.array_min(F.transform(words, lambda x: x["top"])), F.array_max(F.transform(words, lambda x: x["right"])), F.array_max(F.transform(words, lambda x: x["bottom"]))]
    made = dict(zip(READ, (text, F.least(F.greatest(conf, F.lit(0.0)), F.lit(1.0)), *box)))
    return F.when((F.size(words) > 0) & (text != ""), F.struct(*[made[c].alias(c) for c in columns]))


def read_fields(words: DataFrame, fields: tuple[Field, ...] = FIELDS, columns: tuple[str, ...] = READ) -> DataFrame:
    """(doc, field, *columns): a row for every field of every document; columns: what is wanted of each value.

    Words that are dealt by document already are not shuffled again.
    """
    below = [f.name for f in fields if f.below]
    some = materialize(lines(words).withColumn("shown", F.array_join(F.transform("words", lambda x: x["plain"]), " ")), "lines", _SORTED)
    hits = some.select("doc", "at", "words", "next", labelled(F.col("shown"), fields).alias("x"))
    best = hits.select("doc", "at", "words", "next", F.explode_outer("x").alias("x")).where("x is not null or at = 1").select("doc", "at", "words", "next", "x.*")
    end = F.get(F.col("words"), F.col("start") + F.col("size") - 1)["right"]
    is_below = F.col("field").isin(below)
    tail = F.when(is_below, F.coalesce("next", F.array().cast(best.schema["words"].dataType))).when(F.col("field").isNotNull(), F.filter("words", lambda x: x["left"] >= end - 2))
    stops = F.create_map(*[F.lit(x) for f in fields for x in (f.name, plain_text(f.stop) if f.stop else None)])
    at = best.select("doc", "at", "field", "rank", "alike", tail.alias("tail"), F.try_element_at(stops, F.col("field")).alias("stop"))
    seen = F.when(F.col("stop").isNotNull(), F.transform("tail", lambda x: x["plain"]))
    at = at.withColumn("met", likenesses(seen, F.when(F.col("stop").isNotNull(), F.array_repeat("stop", F.size("tail")))))
    cut = F.when(F.col("met").isNotNull(), F.array_position(F.transform("met", lambda x: x >= STOP), True))
    at = at.withColumn("tail", F.when(cut > 0, F.slice("tail", 1, (cut - 1).cast("int"))).otherwise(F.col("tail")))
    read = at.withColumn("v", _value(F.col("tail"), columns))
    # A field beside its label is read from the best line that has a value; one below it from the first line with the label.
    one = []
    for f in fields:
        mine = F.col("field") == f.name
        line = F.min(F.when(mine, F.struct("at", "v"))) if f.below else F.max(F.when(mine & F.col("v").isNotNull(), F.struct("rank", "alike", -F.col("at"), "v")))
        one.append(F.struct(F.lit(f.name).alias("field"), line["v"].alias("v")))
    every = read.groupBy("doc").agg(F.array(*one).alias("f"))
    return every.select("doc", F.explode("f").alias("f")).select("doc", "f.field", *[f"f.v.{c}" for c in columns])


def plain_text(text: str) -> str:
    return "".join(c for c in text.lower() if c.isascii() and c.isalnum())


def page_report(words: DataFrame, read: DataFrame, income: Column, in_words: Column) -> DataFrame:
    """(doc, confidence, word_count, words_mismatch): mean confidence of 0 to 1 and number of the words, and whether the income in
    figures and the one in words differ (null unless both were read). income, in_words: parsers of their texts."""
    good = words.where("btrim(text) <> '' and conf > 0")
    counts = good.groupBy("doc").agg((F.avg(F.col("conf").cast("double")) / 100).alias("confidence"), F.count(F.lit(1)).alias("word_count"))
    of = lambda f: F.max(F.when(F.col("field") == f, F.col("value")))
    both = read.groupBy("doc").agg(of("annual_income").alias("figures"), of("annual_income_words").alias("spelt")).select("doc", (income != in_words).alias("words_mismatch"))
    return counts.join(both, "doc", "left")
