"""Comparison of what an application declares with what was read from its document, and the reviewer's checklist.

Statuses are pass, fail, skipped and pending. What was not read, or not read
well enough, is skipped, never failed; null confidence means no document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimlens.functions.similarity import district_agrees, names_agree
from claimlens.functions.text import HONORIFICS, alnum, digits, editing_software, normalize_name

FIELDS = ("applicant_name", "guardian_name", "certificate_id", "district", "pincode", "family_size")
#: Rules about a household or the whole population on the checklist, and what each needs to be asked.
RULE_NEEDS = {
    "SIBLING_INCOME_CONTRADICTION": "household", "FAMILY_SIZE_CONTRADICTION": "household", "ISSUING_OFFICE_MISMATCH": "household",
    "GUARDIAN_INCOME_CONTRADICTION": None, "DUPLICATE_CERTIFICATE_ID": "certificate_id", "SHARED_CONTACT_UNRELATED_HOUSEHOLDS": "phone_key",
    "ADDRESS_CLUSTER_UNRELATED": None, "DEADLINE_PROXIMITY": "certificate_issue_date",
}
STAGES = ("read", "forensics", "link", "score")


def _declared(field: str) -> Column:
    return F.col("declared_family_size" if field == "family_size" else field).cast("string")


#: A word of two letters or more that is no title: it always leaves a token in the normal form.
_WORD = rf"(^| )(?!({'|'.join(t for t in HONORIFICS if t.isalpha())})( |$))[a-z]{{2,}}( |$)"


def plainly_same(a: Column, b: Column) -> Column:
    """Whether two names are plain letters, equal but for case, with a word that stays: they agree without their normal forms."""
    low = F.lower(a)
    return F.coalesce((low == F.lower(b)) & low.rlike(r"^[\x20-\x7e]+$") & low.rlike(_WORD), F.lit(False))


def named(pop: DataFrame) -> DataFrame:
    """Adds the normal forms of both names, declared and read, as columns that agreement() refers to; null where it needs none."""
    names = {}
    for f in FIELDS[:2]:
        a, b = F.col(f), F.col(f"read_{f}")
        asked = a.isNotNull() & b.isNotNull() & ~plainly_same(a, b)
        names |= {f"norm_{f}": F.when(asked, normalize_name(a)), f"norm_read_{f}": F.when(asked, normalize_name(b))}
    return pop.withColumns(names)


def agreement(field: str, least: float = 0.25) -> Column:
    """Whether the declared and the read value of a field agree; null if either is missing. Names need named(), and a likeness of least."""
    a, b = _declared(field), F.col(f"read_{field}").cast("string")
    if field in ("applicant_name", "guardian_name"):
        compared = names_agree(F.col(f"norm_{field}"), F.col(f"norm_read_{field}"), least)
        return F.when(a.isNotNull() & b.isNotNull(), F.when(plainly_same(a, b), True).otherwise(compared))
    if field == "certificate_id":
        return alnum(a) == alnum(b)
    if field == "district":
        return F.when(a.isNotNull() & b.isNotNull(), district_agrees(a, b))
    if field == "pincode":
        return F.left(digits(a), F.lit(3)) == F.left(digits(b), F.lit(3))
    return digits(a).try_cast("bigint") == digits(b).try_cast("bigint")


def _compared(field: str, least: float) -> Column:
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    none = F.col("read_confidence").isNull() | blank(_declared(field)) | blank(F.col(f"read_{field}").cast("string"))
    return F.when(none | (F.col("read_confidence") < least), "skipped").when(agreement(field), "pass").otherwise("fail")


def _long(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    each = F.array(*[F.struct(F.lit(n).alias("name"), c.alias("status")) for n, c in checks.items()])
    return df.select("application_id", F.explode(each).alias("c")).select("application_id", F.col("c.name").alias("check"), F.col("c.status").alias("status"))


def field_comparison(pop: DataFrame, least: float = 0.8) -> DataFrame:
    """(application_id, check, status) of the six compared fields."""
    return _long(named(pop), {f: _compared(f, least) for f in FIELDS})


def identity_status(words: int = 40, least: float = 0.8, fields: int = 3) -> Column:
    unclear = F.col("read_confidence").isNull() | F.col("word_count").isNull() | (F.col("word_count") < words) | (F.col("read_confidence") < least)
    return F.when(F.col("read_confidence").isNotNull() & (F.col("fields_found") >= fields), "pass").when(unclear, "skipped").otherwise("fail")


def words_status(least: float = 0.8) -> Column:
    unknown = F.col("read_confidence").isNull() | F.col("words_mismatch").isNull() | (F.col("read_confidence") < least)
    return F.when(unknown, "skipped").when(F.col("words_mismatch"), "fail").otherwise("pass")


def editing_status() -> Column:
    return F.when(F.col("ela_applied").isNull(), "skipped").when(editing_software(F.col("software")), "fail").otherwise("pass")


def tamper_status(threshold: float | None) -> Column:
    """Skipped where analysis did not run or no threshold is configured."""
    if threshold is None:
        return F.lit("skipped")
    return F.when(~F.coalesce("ela_applied", F.lit(False)), "skipped").when(F.coalesce("tamper_score", F.lit(0.0)) >= threshold, "fail").otherwise("pass")


def document_checks(pop: DataFrame, threshold: float | None = None) -> DataFrame:
    return _long(pop, {"identity": identity_status(), "income_words": words_status(), "editing_software": editing_status(), "tamper_score": tamper_status(threshold)})


def _unread(least: float, *cases: tuple[Column, str]) -> Column:
    """What is missing for a reading to count: the document, one of the cases, or confidence."""
    out = F.when(F.col("read_confidence").isNull(), "document")
    for test, need in cases:
        out = out.when(test, need)
    return out.when(F.col("read_confidence") < least, "confidence")


def _unmet(check: str, threshold: float | None) -> Column | None:
    """What a check that was skipped or is pending still needs; null if nothing can be said."""
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    if check in FIELDS:
        return _unread(0.8, (blank(_declared(check)), "declared"), (blank(F.col(f"read_{check}").cast("string")), "read"))
    if check == "identity":
        return _unread(0.8, (F.col("word_count").isNull() | (F.col("word_count") < 40), "words"))
    if check == "income_words":
        return _unread(0.8, (F.col("words_mismatch").isNull(), "read"))
    known = {"editing_software": "forensics", "tamper_score": "forensics" if threshold is not None else "threshold", "government_record": "verification"}
    known |= {f"stage_{s}": "stage" for s in STAGES} | {r: n for r, n in RULE_NEEDS.items() if n}
    return F.lit(known.get(check))


def checklist(pop: DataFrame, flags: DataFrame, stages: DataFrame, threshold: float | None = None, needs: bool = False) -> DataFrame:
    """(application_id, check, status): stages, document, fields, government and household rules of every application.
    With needs also what a check that is skipped or pending lacks (need).

    stages: application_id, stage, status of the latest run. Flags and stages are
    folded to one row for each application first, as numbers and truth values; what the
    application alone tells is decided before the joins, which carry only statuses and needs.
    """
    fired = flags.groupBy("application_id").agg(*[F.bool_or(F.col("rule") == r).alias(f"fired_{r}") for r in RULE_NEEDS])
    ran = F.when(F.col("status") == "succeeded", 1).when(F.col("status") == "dead_lettered", 2)
    runs = stages.groupBy("application_id").agg(*[F.max(F.when(F.col("stage") == s, ran)).alias(f"ran_{s}") for s in STAGES])
    sizes = pop.groupBy("scope", "household").agg(F.count(F.lit(1)).alias("members"))
    own = {f: _compared(f, 0.8) for f in FIELDS}
    own |= {"identity": identity_status(), "income_words": words_status(), "editing_software": editing_status(), "tamper_score": tamper_status(threshold)}
    v = F.col("verification")
    own["government_record"] = F.when(v == "mismatch", "fail").when(v == "match", "pass").otherwise("pending")
    lacking = {r: F.col(n).isNull().alias(f"lacks_{r}") for r, n in RULE_NEEDS.items() if n not in (None, "household")}
    unmet = {n: _unmet(n, threshold).alias(f"need_{n}") for n in (*own, *RULE_NEEDS, *[f"stage_{s}" for s in STAGES]) if needs}
    rows = named(pop).select("application_id", "scope", "household", *[c.alias(f"own_{n}") for n, c in own.items()], *lacking.values(), *unmet.values())
    all_ = rows.join(sizes, ["scope", "household"]).join(fired, "application_id", "left").join(runs, "application_id", "left")
    run = lambda s: F.col(f"ran_{s}")
    checks = {f"stage_{s}": F.when(run(s) == 1, "pass").when(run(s) == 2, "fail").otherwise("pending") for s in STAGES}
    checks |= {n: F.col(f"own_{n}") for n in own}
    for rule, need in RULE_NEEDS.items():
        short = F.lit(False) if need is None else F.col("members") < 2 if need == "household" else F.col(f"lacks_{rule}")
        checks[rule] = F.when(F.coalesce(F.col(f"fired_{rule}"), F.lit(False)), "fail").when(short, "skipped").otherwise("pass")
    if not needs:
        return _long(all_, checks)
    both = {n: F.struct(c.alias("status"), F.when(c.isin("skipped", "pending"), F.col(f"need_{n}")).alias("need")) for n, c in checks.items()}
    return _long(all_, both).select("application_id", "check", "status.status", "status.need")


def summary(checks: DataFrame) -> DataFrame:
    """Counts of each application's statuses."""
    return checks.groupBy("application_id").agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("pass", "fail", "skipped", "pending")])


def page_report(words: DataFrame, doc: str, conf: str) -> DataFrame:
    """Mean confidence and number of the words of each document."""
    return words.groupBy(doc).agg(F.round(F.avg(conf), 6).alias("confidence"), F.count(F.lit(1)).alias("word_count"))


def _deviations(blocks: DataFrame, ink: float, least: int) -> DataFrame:
    """Inked blocks with their distance from the document's median in scaled median deviations (zs); null in documents that
    have too few of them, or no deviation."""
    inked = blocks.where(F.col("ink") >= ink)
    mid = inked.groupBy("doc").agg(F.median("energy").alias("mid"))
    far = inked.join(mid, "doc")
    spread = far.groupBy("doc").agg((F.median(F.abs(F.col("energy") - F.col("mid"))) * 1.4826).alias("dev"), F.count(F.lit(1)).alias("n"))
    return far.join(spread, "doc").withColumn("zs", F.when((F.col("n") >= least) & (F.col("dev") > 1e-6), (F.col("energy") - F.col("mid")) / F.col("dev")))


def block_outliers(blocks: DataFrame, ink: float = 6.0, z: float = 3.5, full: float = 12.0, least: int = 24) -> DataFrame:
    """(doc, n_blocks, applied, regions, score) from blocks (doc, energy, ink) by median and scaled median deviation.

    Documents with fewer inked blocks than least or without deviation are not
    measured (score 0). Only the inked blocks are shuffled, by document.
    """
    out = _deviations(blocks, ink, least).groupBy("doc").agg(F.count(F.lit(1)).alias("n_blocks"), F.count_if(F.col("zs") >= z).alias("regions"), F.max("zs").alias("peak"))
    score = F.when(F.col("peak") > z, F.least(F.lit(1.0), (F.col("peak") - z) / (full - z))).otherwise(0.0)
    return out.select("doc", "n_blocks", F.col("peak").isNotNull().alias("applied"), "regions", F.round(score, 4).alias("score"))


def block_regions(blocks: DataFrame, ink: float = 6.0, z: float = 3.5, least: int = 24, most: int = 12, size: int = 8) -> DataFrame:
    """(doc, rank, row, col, left, top, right, bottom, z_score, energy): the most outlying blocks of each document, up to most.

    blocks: doc, row, col, energy, ink; size: pixels of a block. Blocks alike in deviation are ranked by place. Each task
    keeps no more than most blocks of a document before they are ranked together.
    """
    out = _deviations(blocks, ink, least).where(F.col("zs") >= z)
    order = Window.partitionBy("doc").orderBy(F.desc("zs"), "row", "col")
    out = out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
    box = [(F.col("col") * size).alias("left"), (F.col("row") * size).alias("top"), ((F.col("col") + 1) * size).alias("right"), ((F.col("row") + 1) * size).alias("bottom")]
    return out.select("doc", "rank", "row", "col", *box, F.round("zs", 3).alias("z_score"), F.round("energy", 3).alias("energy"))


def region_lists(regions: DataFrame) -> DataFrame:
    """(doc, regions): a document's regions as one list, the strongest first; of bounded length, as ranks are."""
    one = F.struct("rank", "left", "top", "right", "bottom", "z_score", "energy")
    return regions.groupBy("doc").agg(F.sort_array(F.collect_list(one)).alias("regions"))
