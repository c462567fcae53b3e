"""Secret scan over an incremental ledger of blobs, in DataFrame functions only.

Every historical version of a file is content-addressed (SHA-256 of its
text). The ledger holds what each rule version found in each blob; a scan
reads only the blobs that the ledger lacks for its rule version, and joins
the findings back to every path that holds the blob.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from minpair.llm.common import no_null, written


@dataclass(frozen=True)
class SecretRule:
    """Matches of ``pattern`` (leftmost, not overlapping) whose group ``group`` has ``least`` characters or more."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


# Fixed by the query contract. The quantifiers of the last two hold the least
# length already: a run of the class that is too short holds no match.
BASE_RULES = (
    SecretRule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    SecretRule("access", r"AKIA[A-Z0-9]{12,}"),
    SecretRule("hex", r"[0-9a-f]{32,}"),
)
MORE_RULES = (
    SecretRule("private_key", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    SecretRule("web_token", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    SecretRule("host_token", r"(?:ghp|gho|ghs|ghr)_[A-Za-z0-9]{36,}|xox[abpr]-[A-Za-z0-9-]{10,}"),
)
RULES = BASE_RULES + MORE_RULES
RULE_VERSION = "1"

_SPAN = "array<struct<start:int,kind:int,end:int>>"
LEDGER_SCHEMA = f"blob string, rule_version string, spans {_SPAN}"


def _pieces(d: DataFrame, rule: SecretRule, i: int) -> DataFrame:
    """Adds s<i>: the spans of one rule. The texts between the matches give the
    places: the k-th match starts after k + 1 pieces and k matches."""
    hit = F.col("t").rlike(rule.pattern)
    d = d.withColumn("m", F.when(hit, F.regexp_extract_all("t", F.lit(rule.pattern), F.lit(0))))
    d = d.withColumn("g", F.when(F.col("m").isNotNull(), F.regexp_extract_all("t", F.lit(rule.pattern), F.lit(rule.group)))
                     if rule.group else F.col("m"))
    d = d.withColumn("between", F.when(F.col("m").isNotNull(), F.transform(F.split("t", rule.pattern, -1), F.length)))
    d = d.withColumn("len", F.transform("m", F.length))
    # running place: one pass, the accumulator holds the end of the last match and the spans so far
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("spans"))

    def step(acc, k):
        start = acc["at"] + F.get("between", k)
        end = start + F.get("len", k)
        keep = F.length(F.get("g", k)) >= rule.least
        return F.struct(end.alias("at"), F.when(keep, F.concat(acc["spans"], F.array(
            F.struct(start.alias("start"), F.lit(i).alias("kind"), end.alias("end"))))).otherwise(acc["spans"]).alias("spans"))

    spans = F.when(F.size("m") > 0, F.aggregate(
        F.sequence(F.lit(0), F.size("m") - 1), zero, step, lambda a: a["spans"]))
    d = d.withColumn(f"s{i}", F.coalesce(spans, F.array().cast(_SPAN)))
    return d.drop("m", "g", "between", "len")


def scan_blobs(blobs: DataFrame, rules=RULES, rule_version: str = RULE_VERSION) -> DataFrame:
    """Ledger rows for blobs (blob, t). Spans in code points, end exclusive, by start then rule order."""
    d = blobs.select("blob", "t")
    for i, r in enumerate(rules):
        d = _pieces(d, r, i)
    both = F.concat(*[F.col(f"s{i}") for i in range(len(rules))])
    return d.select("blob", F.lit(rule_version).alias("rule_version"), F.sort_array(both).alias("spans"))


def blob_id(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def empty_ledger(spark: SparkSession) -> DataFrame:
    return spark.sql("select cast(null as string) blob, cast(null as string) rule_version, "
                     f"cast(null as {_SPAN}) spans where false")


def scan_new(texts: DataFrame, ledger: DataFrame, rules=RULES, rule_version: str = RULE_VERSION) -> DataFrame:
    """Ledger rows for the blobs of ``texts`` (column t) that ``ledger`` lacks at this
    rule version. Copies of a text meet map-side first, so a blob with any
    number of paths is scanned once."""
    seen = ledger.filter(F.col("rule_version") == rule_version).select("blob")
    blobs = texts.select("t").distinct().withColumn("blob", blob_id(F.col("t")))
    return scan_blobs(blobs.join(seen, "blob", "left_anti"), rules, rule_version)


def secret_scan(docs: DataFrame, ledger: DataFrame | None = None, id_col: str = "doc_id",
                text_col: str = "text", rules=RULES,
                rule_version: str = RULE_VERSION) -> tuple[DataFrame, DataFrame]:
    """(findings, new ledger rows).

    findings: id, blob and spans, one row per row of ``docs`` (null text:
    empty, no spans; repeated rows: repeated findings; null ids stay). The
    new ledger rows are a written table: append them to the ledger that is
    given next time. Other columns are ignored.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).alias("id"), no_null(text_col).alias("t"))
    ledger = empty_ledger(spark) if ledger is None else ledger
    new = written(scan_new(texts, ledger, rules, rule_version))
    # blobs with nothing to report need no join partner
    known = (ledger.filter(F.col("rule_version") == rule_version).unionByName(new)
             .filter(F.size("spans") > 0).select("blob", "spans"))
    paths = texts.select("id", blob_id(F.col("t")).alias("blob"))
    found = paths.join(known, "blob", "left").select(
        F.col("id").alias(id_col), "blob", F.coalesce("spans", F.array().cast(_SPAN)).alias("spans"))
    return found, new


def span_count(spans: str, rule: int) -> Column:
    """Spans of the rule-th rule."""
    return F.size(F.filter(spans, lambda s: s["kind"] == rule)).cast("long")


def span_text(spans: Column | str, rules=RULES, first: int | None = None) -> Column:
    """``kind:start:end`` of each span, comma-joined; ``first`` limits it to the first so many rules."""
    names = F.array(*[F.lit(r.kind) for r in rules])
    c = F.col(spans) if isinstance(spans, str) else spans
    if first is not None:
        c = F.filter(c, lambda s: s["kind"] < first)
    return F.array_join(F.transform(c, lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
