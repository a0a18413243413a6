"""Similarities of names, addresses, phones and incomes as functions on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from claimlens.functions.text import alnum, skeleton

#: An initial that begins an unused token counts this much.
INITIAL = 0.6


def trigrams(c: Column) -> Column:
    """Distinct 3-grams of each word, which has two spaces before and one behind it."""
    words = F.filter(F.split(F.lower(c), "[^\\p{L}\\p{N}]+"), lambda w: w != "")
    padded = F.transform(words, lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    grams = F.transform(padded, lambda p: F.transform(F.sequence(F.lit(1), F.length(p) - 2), lambda i: F.substr(p, i, F.lit(3))))
    return F.array_distinct(F.flatten(grams))


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both / (F.size(a) + F.size(b) - both))


def trigram_similarity(a: Column, b: Column) -> Column:
    return F.coalesce(jaccard(trigrams(a), trigrams(b)), F.lit(0.0))


def _aligned(small: Column, initials: Column, large: Column) -> Column:
    """The weakest of the small side's parts, each aligned with its best unused token of the large side."""
    start = F.struct(large.alias("free"), F.lit(1.0).alias("low"))

    def take(acc, best):
        """best: struct(score, place) of the free token chosen, or null."""
        place = F.coalesce(best["i"], F.lit(-1))
        return F.struct(
            F.filter(acc["free"], lambda _, i: i != place).alias("free"),
            F.least(acc["low"], F.coalesce(best["s"], F.lit(0.0))).alias("low"),
        )

    def of_token(acc, t):
        scores = F.transform(acc["free"], lambda x, i: F.struct(jaccard(t["grams"], x["grams"]).alias("s"), (-i).alias("j"), i.alias("i")))
        return take(acc, F.array_max(scores))

    def of_initial(acc, t):
        hits = F.filter(F.transform(acc["free"], lambda x, i: F.struct(F.lit(INITIAL).alias("s"), (-i).alias("j"), F.when(x["token"].startswith(t), i).alias("i"))), lambda h: h["i"].isNotNull())
        return take(acc, F.array_max(hits))

    return F.aggregate(initials, F.aggregate(small, start, of_token), of_initial, lambda a: a["low"])


def name_parts(name: Column) -> Column:
    """A name with the trigrams of its tokens, so that a name that is compared often is taken apart once."""
    return F.struct(F.transform(name["tokens"], lambda t: F.struct(t.alias("token"), trigrams(t).alias("grams"))).alias("tokens"), name["initials"].alias("initials"))


def parts_similarity(a: Column, b: Column, n: Column, m: Column) -> Column:
    """name_similarity of names in parts, which have n and m tokens."""
    one = _aligned(a["tokens"], a["initials"], b["tokens"])
    two = _aligned(b["tokens"], b["initials"], a["tokens"])
    return F.when((n == 0) | (m == 0), 0.0).when(n <= m, one).otherwise(two)


def name_similarity(a: Column, b: Column) -> Column:
    """a, b: structs of normalize_name. The side with fewer tokens (the first on ties) is aligned with the other."""
    return parts_similarity(name_parts(a), name_parts(b), F.size(a["tokens"]), F.size(b["tokens"]))


def phone_similarity(a: Column, b: Column) -> Column:
    return F.coalesce(a == b, F.lit(False)).cast("double")


def names_agree(a: Column, b: Column, least: float = 0.25) -> Column:
    common = F.array_intersect(a["initials"], b["initials"])

    def without(x, tokens):
        return F.struct(tokens.alias("tokens"), F.filter(x["initials"], lambda i: ~F.array_contains(common, i)).alias("initials"))

    plain = name_similarity(without(a, a["tokens"]), without(b, b["tokens"]))
    bare = name_similarity(without(a, skeleton(a["tokens"])), without(b, skeleton(b["tokens"])))
    same = (F.size(a["tokens"]) > 0) & (a == b)  # aligns each part with itself
    return F.when(same, True).otherwise(F.greatest(plain, bare) >= least)


def district_agrees(a: Column, b: Column) -> Column:
    return (alnum(a) == alnum(b)) | (trigram_similarity(alnum(a), alnum(b)) >= 0.5)


def exceeds_tolerance(a: Column, b: Column, percent: int = 15, absolute: int = 12_000) -> Column:
    gap, top = F.abs(a - b), F.greatest(a, b)
    return (top > 0) & (100 * gap > percent * top) & (gap > absolute)
