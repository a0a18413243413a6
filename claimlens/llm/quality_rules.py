"""Quality rules: a threshold table compiled into one projection of built-in functions.

Every rule compares a count with a share of another count, in whole numbers, so
the same table also gives the SQL text. Nothing here leaves the JVM.

Defined cases: a null text has no words and fails the base rule; repeated rows
each get a row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "#*$%&|<>"
#: Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "a an and are as at be by for from has he in is it of on or that the this to was were will with "
    "au aux avec ce dans de des du elle en est et il la le les ou par pas pour que qui se sur un une "
    "auf das dem den der des die ein eine für im ist mit nicht sich sie und von zu "
    "al con del el es la las lo los más no para por se su una y"
).split()
WINDOW = 8
#: (rule, left count, relation, per hundred, right count): the rule fails a text when
#: 100 * left is above ("max") or below ("min") the number given times right.
THRESHOLDS = (
    ("symbols to words", "n_symbols", "max", 30, "n_words"),
    ("exclamation marks to words", "n_bangs", "max", 50, "n_words"),
    ("stop words to words", "n_stops", "min", 4, "n_words"),
    ("duplicate lines to lines", "n_dup_lines", "max", 30, "n_lines"),
    ("longest mean word", "word_chars", "max", 1400, "n_words"),
    ("shortest mean word", "word_chars", "min", 200, "n_words"),
)
LEAST_WORDS, MOST_REPEATED = 20, 30


def words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE, -1), lambda w: w != "")


def repeated_words(words: Column, ordered: Column) -> Column:
    """Words in 8-word windows that occur twice or more; ordered: (hash, place) of the windows, sorted."""
    n = F.size(ordered)
    hit = F.filter(
        F.transform(
            ordered,
            lambda x, i: F.when(
                ((i > 0) & (x["h"] == F.get(ordered, i - 1)["h"])) | ((i < n - 1) & (x["h"] == F.get(ordered, i + 1)["h"])), x["i"]
            ),
        ),
        lambda p: p.isNotNull(),
    )
    return F.sort_array(hit)


def covered(places: Column) -> Column:
    """Length of the union of windows that begin at sorted places."""
    step = F.zip_with(F.slice(places, 2, F.size(places)), places, lambda b, a: F.when(b.isNotNull(), F.least(b - a, F.lit(WINDOW))).otherwise(0))
    total = F.aggregate(step, F.lit(0), lambda s, x: s + x)
    return F.when(F.size(places) > 0, total + WINDOW).otherwise(0)


def failed(names=THRESHOLDS) -> Column:
    """The compiled table: true if any rule fails."""
    out = F.lit(False)
    for _, left, relation, per, right in names:
        a, b = 100 * F.col(left), per * F.col(right)
        out = out | ((a > b) if relation == "max" else (a < b))
    return out


def op8_quality_rules(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept for every row of docs."""
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    one = docs.select(
        "doc_id",
        words(F.col("text")).alias("w"),
        lines.alias("lines"),
        F.regexp_count(text, F.lit("[" + SYMBOLS + "]")).cast("long").alias("n_symbols"),
        F.regexp_count(text, F.lit("!")).cast("long").alias("n_bangs"),
    )
    two = one.select(
        "doc_id", "n_symbols", "n_bangs",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter("w", lambda x: F.lower(x).isin(STOP_WORDS))).cast("long").alias("n_stops"),
        F.transform("w", lambda x: F.xxhash64(x)).alias("h"),
    )
    last = F.size("h") - WINDOW
    windows = F.when(
        last > 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(F.col("h"), i + k) for k in range(WINDOW)]))
    )
    three = two.withColumn("g", windows).drop("h")
    again = F.size(F.array_distinct("g")) < F.size("g")
    pairs = F.when(again, F.sort_array(F.transform("g", lambda x, i: F.struct(x.alias("h"), i.alias("i")))))
    four = three.withColumn("o", pairs).drop("g")
    five = four.withColumn("p", F.when(F.col("o").isNotNull(), repeated_words(F.col("o"), F.col("o")))).drop("o")
    six = five.withColumn("n_repeat_words", F.coalesce(covered(F.col("p")), F.lit(0)).cast("long"))
    base = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    out = six.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base.alias("base_failed"), (~base & ~failed()).alias("kept"),
    )
    # A generator of one row: a later filter on a result stays above it, instead of
    # being pushed down with these expressions written out again in every reference.
    return out.select(F.inline(F.array(F.struct(*out.columns))))


def oracle() -> str:
    """The same in DuckDB's SQL, from the same table of thresholds."""
    word = r"[^\x20\x09-\x0D]+"
    rules = " or ".join(f"100 * {a} {'>' if rel == 'max' else '<'} {per} * {b}" for _, a, rel, per, b in THRESHOLDS)
    stops = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
    return f"""
with d as (select row_number() over () as rid, doc_id, coalesce(text, '') as t from documents),
w as (select rid, doc_id, t, regexp_extract_all(t, '{word}') as ws,
             [x for x in string_split(t, chr(10)) if regexp_matches(x, '{word}')] as ls from d),
win as (select rid, i, list_slice(ws, i, i + {WINDOW - 1}) as g from (select rid, ws, unnest(range(1, len(ws) - {WINDOW - 2})) as i from w)),
rep as (select rid, i, count(*) over (partition by rid, g) as c from win),
cov as (select rid, sum(least({WINDOW}, coalesce(nx - i, {WINDOW}))) as n
        from (select rid, i, lead(i) over (partition by rid order by i) as nx from rep where c > 1) group by rid),
m as (select doc_id, len(ws)::bigint as n_words, length(array_to_string(ws, ''))::bigint as word_chars,
             (length(t) - length(translate(t, '{SYMBOLS}', '')))::bigint as n_symbols,
             (length(t) - length(replace(t, '!', '')))::bigint as n_bangs,
             len(ls)::bigint as n_lines, (len(ls) - len(list_distinct(ls)))::bigint as n_dup_lines,
             len([x for x in ws if lower(x) in ({stops})])::bigint as n_stops,
             coalesce(cov.n, 0)::bigint as n_repeat_words
      from w left join cov using (rid)),
b as (select *, n_words < {LEAST_WORDS} or 100 * n_repeat_words > {MOST_REPEATED} * n_words as base_failed from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and not ({rules}) as kept from b"""
