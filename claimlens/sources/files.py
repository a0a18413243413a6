"""Sources and sinks: rule configurations, manifests, the audit trail and the queue as CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimlens.functions.text import safe_cell
from claimlens.operators.intake import COLUMNS, issues


def rule_config(spark: SparkSession, folder: str, version: str) -> DataFrame:
    """(rule, enabled, severity, weight) of rules.<version>.json; an unknown version or another one inside is an error."""
    path = f"{folder}/rules.{version}.json"
    rule = "map<string, struct<enabled: boolean, severity: string, weight: int>>"
    read = spark.read.schema(f"version string, rules {rule}").option("multiLine", True).option("mode", "FAILFAST").json(path)
    found = read.select("version").first()
    if found is None or found["version"] != version:
        raise ValueError(f"{path} holds version {found and found['version']}, not {version}")
    each = read.select(F.explode("rules").alias("rule", "r"))
    rows = each.select("rule", F.coalesce("r.enabled", F.lit(True)).alias("enabled"), "r.severity", "r.weight")
    wrong = rows.where("weight is null or weight < 0 or severity is null or severity not in ('low', 'medium', 'high')")
    if not wrong.isEmpty():
        raise ValueError(f"{path} has a rule without a weight or a known severity")
    return rows


#: The parameters of rules in a configuration's file, and what they are called here.
PARAMETERS = {
    "incomeTolerancePercent": "percent", "incomeToleranceAbsolute": "absolute", "minDistinctHouseholds": "households", "windowDays": "days",
    "minOcrConfidence": "confidence", "minNameSimilarity": "similarity", "minWordCount": "words", "minIdentifyingFields": "fields",
    "minTamperScore": "tamper_score", "bunchingBandPercent": "band", "minBandCount": "least", "bunchingRatio": "ratio", "maxSerialSpan": "span",
    "roundIncomeStep": "step", "nearMissFloor": "floor", "minNearMissFields": "fields",
}
#: Least and greatest value (a null has no bound) of parameters, and those that are whole numbers.
BOUNDS = {
    "percent": (0, 99.99), "absolute": (0, None), "households": (2, None), "days": (1, None), "confidence": (0, 1), "similarity": (0, 1), "words": (0, None),
    "fields": (1, None), "tamper_score": (0, 1), "band": (0.01, 100), "least": (2, None), "ratio": (0.01, None), "span": (0, None), "step": (1, None), "floor": (0, 1),
}
WHOLE = {"households", "days", "words", "fields", "least", "span", "step"}


def load_config(spark: SparkSession, folder: str, version: str) -> dict[str, dict]:
    """rules.<version>.json as rules.configured and engine.run take it: by rule enabled, severity, weight, corroborated and
    params. The ceiling goes to the rules that read it. Errors as in rule_config, and for parameters out of bounds."""
    rule_config(spark, folder, version)
    fields = ", ".join(f"{p}: double" for p in PARAMETERS)
    schema = f"scholarshipIncomeCeiling double, rules map<string, struct<enabled: boolean, severity: string, weight: int, requiresCorroboration: boolean, {fields}>>"
    read = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(f"{folder}/rules.{version}.json").first()  # one row, of one file
    out = {}
    for name, r in read["rules"].items():
        params = {ours: r[theirs] for theirs, ours in PARAMETERS.items() if r[theirs] is not None}
        for p, v in params.items():
            low, high = BOUNDS[p]
            if not low <= v or (high is not None and v > high) or (p in WHOLE and v != int(v)):
                raise ValueError(f"{name}: {p} can't be {v}")
        params = {p: int(v) if p in WHOLE else v for p, v in params.items()}
        if read["scholarshipIncomeCeiling"] is not None and name in ("ADDRESS_CLUSTER_UNRELATED", "INCOME_THRESHOLD_BUNCHING"):
            params["ceiling"] = int(read["scholarshipIncomeCeiling"])
        out[name] = {"enabled": r["enabled"] is not False, "severity": r["severity"], "weight": r["weight"], "corroborated": r["requiresCorroboration"], "params": params}
    return out


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(document, variant, truth) of a corpus manifest: a JSON object with an array of documents."""
    doc = "struct<document: string, variant: string, truth: map<string, string>>"
    read = spark.read.schema(f"documents array<{doc}>").option("multiLine", True).json(path)
    return read.select(F.explode("documents").alias("d")).select("d.*")


def append_audit(rows: DataFrame, path: str) -> None:
    """Adds rows to the audit trail; there is no way to change or remove one."""
    rows.select("actor", "action", "entity", "at", F.to_json("detail").alias("detail")).write.mode("append").parquet(path)


def write_queue_csv(rows: DataFrame, path: str) -> None:
    """Safe cells, RFC 4180 quotes, lines ended by CR LF; each file begins with a byte order mark and a header."""
    first, *rest = rows.columns
    cells = rows.select(safe_cell(F.col(first)).alias(f"\ufeff{first}"), *[safe_cell(F.col(c)).alias(c) for c in rest])
    cells.write.option("header", True).option("quote", '"').option("escape", '"').option("lineSep", "\r\n").option("emptyValue", "").mode("overwrite").csv(path)


class Refused(ValueError):
    """A file of applications of which nothing was admitted; errors: (line, fields) of 20 rows at most."""

    def __init__(self, message: str, errors: list | None = None):
        super().__init__(message)
        self.errors = errors or []


def read_applications(spark: SparkSession, path: str, most: int = 2000) -> DataFrame:
    """The rows of a CSV file with a header, all of them or, if a single one has an issue, none.

    Names in the header are trimmed and may follow a byte order mark; blank lines don't
    count. An upload is one file of most rows at most, read by one task in its order, so
    a row's line is its number and two.
    """
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    raw = raw.option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(path)
    raw = raw.toDF(*[c.replace("\ufeff", "").strip() for c in raw.columns])
    rows = raw.select("*", *[F.lit(None).cast("string").alias(c) for c in COLUMNS if c not in raw.columns])
    rows = issues(rows.withColumn("line", F.monotonically_increasing_id() + 2))
    n = rows.limit(most + 1).count()
    if not 0 < n <= most:
        raise Refused(f"{n} rows" if not n else f"more than {most} rows")
    wrong = rows.where(F.size("issues") > 0)
    if bad := wrong.count():
        raise Refused(f"{bad} of {n} rows can't be admitted", [(r["line"], r["issues"]) for r in wrong.orderBy("line").limit(20).collect()])
    return rows.drop("line", "issues")
