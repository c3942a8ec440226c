"""Secret scans over an incremental ledger of blobs.

Every historical version of a text is a blob named by its SHA-256. The ledger keeps, per blob, which
versions of which rules have scanned it and what they found. A run scans only the pairs of blob and rule
version that the ledger lacks, adds them, and joins the findings back to all paths. All of it is DataFrame
expressions: spans come from the lengths of the pieces between matches, summed by a window.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import materialise, scratch


@dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches of ``pattern`` whose ``group`` has at least ``least`` characters."""

    name: str
    pattern: str
    group: int = 0
    least: int = 1

    @property
    def version(self) -> str:
        """Changes with anything that can change the findings."""
        return hashlib.sha256(repr((self.name, self.pattern, self.group, self.least)).encode()).hexdigest()[:16]


#: In the order in which kinds stand at equal starts. A run of the last two classes of characters is maximal,
#: so asking for the length inside the pattern finds the same spans as dropping shorter matches.
RULES = (
    Rule("assign", r"""((?i)password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
)

LEDGER = (
    "blob binary, rules array<string>, "
    "findings array<struct<start: bigint, kind: int, end: bigint, rule: string, version: string>>"
)


def _matches(text: Column, rule: Rule, kind: int) -> Column:
    """Every match as struct(kind, i, gap before it, its length, length of its group); none is an empty array."""
    length = lambda x: F.length(x).cast("long")
    found = F.arrays_zip(
        F.transform(F.split(text, rule.pattern, -1), length).alias("gap"),
        F.transform(F.regexp_extract_all(text, F.lit(rule.pattern), 0), length).alias("size"),
        F.transform(F.regexp_extract_all(text, F.lit(rule.pattern), rule.group), length).alias("held"),
    )
    rows = F.transform(
        found,
        lambda x, i: F.struct(
            F.lit(kind).alias("kind"), i.alias("i"), x["gap"].alias("gap"), x["size"].alias("size"), x["held"].alias("held")
        ),
    )
    return F.when(text.rlike(rule.pattern), F.filter(rows, lambda x: x["size"].isNotNull()))


def scan(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Ledger rows of ``blobs`` (blob, text, todo: versions to scan for).

    One row per blob, also without findings. The text leaves the plan right after the matching; what is
    sorted are numbers, and only the rows of one blob and kind follow one another in a window.
    """
    empty = F.array().cast("array<struct<kind: int, i: int, gap: bigint, size: bigint, held: bigint>>")
    each = [
        F.coalesce(F.when(F.array_contains("todo", rule.version), _matches(F.col("text"), rule, k)), empty)
        for k, rule in enumerate(rules)
    ]
    rows = blobs.select("blob", "todo", F.explode_outer(F.concat(*each)).alias("m")).select("blob", "todo", "m.*")
    order = Window.partitionBy("blob", "kind").orderBy("i")
    end = F.sum(F.col("gap") + F.col("size")).over(order)
    name = F.element_at(F.array(*[F.lit(r.name) for r in rules]), F.col("kind") + 1)
    version = F.element_at(F.array(*[F.lit(r.version) for r in rules]), F.col("kind") + 1)
    least = F.element_at(F.array(*[F.lit(r.least) for r in rules]), F.col("kind") + 1)
    span = F.struct((F.col("end") - F.col("size")).alias("start"), "kind", "end", name.alias("rule"), version.alias("version"))
    return (
        rows.withColumn("end", end)
        .groupBy("blob")
        .agg(
            F.first("todo").alias("rules"),
            F.array_sort(F.collect_list(F.when(F.col("held") >= least, span))).alias("findings"),
        )
        .select("blob", "rules", "findings")
    )


def update_ledger(versions: DataFrame, ledger: str, *, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> None:
    """Scan what the ledger at path ``ledger`` lacks of ``versions`` and append it, in one commit.

    Copies of a blob are dropped on the map side before any text moves. A failed run appends nothing.
    A path that does not exist yet is an empty ledger.
    """
    spark = versions.sparkSession
    wanted = F.array(*[F.lit(r.version) for r in rules])
    blobs = _named(versions, text_col).groupBy("blob").agg(F.any_value("text").alias("text"))
    seen = read_ledger(spark, ledger)
    if seen is None:
        unseen = blobs.withColumn("todo", wanted)
    else:
        known = seen.select("blob", F.explode("rules").alias("r")).groupBy("blob").agg(F.collect_set("r").alias("seen"))
        todo = F.array_except(wanted, F.coalesce("seen", F.array().cast("array<string>")))
        unseen = blobs.join(known, "blob", "left").withColumn("todo", todo).where(F.size("todo") > 0)
    scan(unseen, rules).write.mode("append").parquet(ledger)


def _named(versions: DataFrame, text_col: str, *keep: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return versions.select(*keep, text.alias("text")).withColumn("blob", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))


def read_ledger(spark: SparkSession, ledger: str) -> DataFrame | None:
    """The ledger's rows, or None where there is none yet."""
    path = spark._jvm.org.apache.hadoop.fs.Path(ledger)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    return spark.read.schema(LEDGER).parquet(ledger)


def findings(
    versions: DataFrame, ledger: str, *, path_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES
) -> DataFrame:
    """One row per row of ``versions``: path_col and ``found``, its spans by start, then kind.

    Null texts are empty blobs without findings. Repeated rows each get their row. Findings of other rule
    versions in the ledger are left out. Only ids, digests and spans are joined; a hot blob is one ledger
    row, so its copies split over tasks.
    """
    update_ledger(versions, ledger, text_col=text_col, rules=rules)
    versions_now = [r.version for r in rules]
    current = F.filter("findings", lambda x: x["version"].isin(versions_now))
    spans = F.array_sort(F.array_distinct(F.flatten(F.collect_list("spans"))))
    # Written, so that the join is dealt anew and the copies of a hot blob can be split there.
    known = materialise(
        read_ledger(versions.sparkSession, ledger)
        .select(F.col("blob").alias("__blob"), F.transform(current, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"), x["rule"].alias("rule"))).alias("spans"))
        .groupBy("__blob")
        .agg(spans.alias("found")),
        "found-secrets",
    )
    paths = _named(versions, text_col, F.col(path_col).alias("__path")).select("__path", F.col("blob"))
    return paths.join(known, F.col("blob") == F.col("__blob"), "left").select(F.col("__path").alias(path_col), "found")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document, by a ledger that starts empty."""
    from ._common import table

    found = findings(table(spark, sf_dir, "documents"), scratch(spark, "ledger"))
    count = lambda name: F.size(F.filter("found", lambda x: x["rule"] == name)).cast("long").alias(f"n_{name}")
    spans = F.array_join(F.transform("found", lambda x: F.concat_ws(":", x["rule"], x["start"], x["end"])), ",")
    return found.select(
        "doc_id", *[count(r.name) for r in RULES], F.sha2(spans.cast("binary"), 256).alias("base_sha256"), spans.alias("spans")
    )
