"""Inspecting documents: findings, reports, verdicts, removal with proof, restated text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .redact import holds

#: Severities in rising order.
SEVERITIES = ("info", "low", "medium", "high")
MOST_SAMPLES = 20

#: Findings in HTML: kind, severity, pattern of one occurrence, and the group that is its sample.
HTML_RULES = (
    ("javascript", "high", r"(?is)<script\b[^>]*>(.*?)</script\s*>", 1),
    ("auto_action", "medium", r"(?i)<[a-z][^>]*\s(on[a-z]+)\s*=", 1),
    ("embedded_file", "medium", r"(?i)<(iframe|object|embed)\b", 1),
    ("submit_form", "low", r"""(?i)<form\b[^>]*\baction\s*=\s*["']?([^"'\s>]+)""", 1),
    ("external_link", "info", r"""(?i)<a\b[^>]*\bhref\s*=\s*["']?((?:https?:)?//[^"'\s>]+)""", 1),
    ("hidden_text", "medium", r"(?s)<!--(.*?)-->", 1),
    ("style", "info", r"(?is)<style\b[^>]*>(.*?)</style\s*>", 1),
)
#: What sanitising removes, by group: the kinds that must be gone, and the pattern taken out.
REMOVALS = {
    "javascript": (("javascript",), r"(?is)<script\b[^>]*>.*?</script\s*>"),
    "actions": (("auto_action",), r"""(?i)(?<=[\s"'])on[a-z]+\s*=\s*(?:"[^"]*"|'[^']*'|[^\s>]+)"""),
    "attachments": (("embedded_file",), r"(?is)<(iframe|object|embed)\b[^>]*>(?:.*?</\1\s*>)?"),
    "hidden": (("hidden_text",), r"(?s)<!--.*?-->"),
}


def rank(severity: Column | str) -> Column:
    """Severity as a number, so that the largest is the most severe."""
    return F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), T.col(severity)).cast("int")


def label(number: Column) -> Column:
    """The severity of a number; null of null."""
    out = F.lit(None).cast("string")
    for k, name in enumerate(SEVERITIES):
        out = F.when(number == k + 1, name).otherwise(out)
    return out


def html_findings(pages: DataFrame, *, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """One row per occurrence: (doc_id, kind, severity, pos, sample). All rules are tried in one pass over the pages."""

    def found(kind: str, severity: str, java: str, group: int) -> Column:
        def one(x: Column, i: Column) -> Column:
            return F.struct(F.lit(kind).alias("kind"), F.lit(severity).alias("severity"), i.alias("pos"), T.excerpt(F.trim(x), 200).alias("sample"))

        return F.transform(F.regexp_extract_all(html_col, F.lit(java), group), one)

    each = [found(*rule) for rule in HTML_RULES]
    return pages.select(F.col(id_col).alias("doc_id"), F.explode(F.concat(*each)).alias("f")).select("doc_id", "f.*")


def report(findings: DataFrame, *keys: str) -> DataFrame:
    """Findings by kind: the highest severity seen, how many, and up to twenty different samples.

    ``findings`` has the keys, kind, severity and sample. Samples are different ones in string order. Each key and
    kind sends one partial count per task; samples are made different before they are gathered.
    """
    by = [*keys, "kind"]
    counted = findings.groupBy(*by).agg(F.max(rank("severity")).alias("r"), F.count(F.lit(1)).alias("n"))
    distinct = findings.where("sample is not null").select(*by, "sample").distinct()
    nth = F.row_number().over(Window.partitionBy(*by).orderBy("sample"))
    listed = distinct.withColumn("nth", nth).where(F.col("nth") <= MOST_SAMPLES).groupBy(*by).agg(F.array_sort(F.collect_list("sample")).alias("samples"))
    joined = counted.join(listed, by, "left")
    return joined.select(*by, label(F.col("r")).alias("severity"), F.col("n").cast("long").alias("count"), F.coalesce("samples", F.array().cast("array<string>")).alias("samples"))


def verdict(docs: DataFrame, findings: DataFrame) -> DataFrame:
    """Per document: whether anything was found, and the highest severity. A document is never called safe."""
    highest = findings.groupBy("doc_id").agg(F.max(rank("severity")).alias("r"), F.count(F.lit(1)).alias("n"))
    return docs.select("doc_id").join(highest, "doc_id", "left").select(
        "doc_id",
        F.when(F.col("n") > 0, "findings").otherwise("nothing found").alias("verdict"),
        label(F.col("r")).alias("highest_severity"),
        F.coalesce("n", F.lit(0)).cast("long").alias("findings"),
    )


def sanitize(pages: DataFrame, *, keep: tuple[str, ...] = (), id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """``pages`` without active content, and ``removed``, occurrences by group. What is left of a group is looked for
    again in the result, and any fails the query."""
    if unknown := set(keep) - set(REMOVALS):
        raise ValueError(f"unknown group {sorted(unknown)[0]}")
    groups = [g for g in REMOVALS if g not in keep]
    rules = {kind: java for kind, _, java, _ in HTML_RULES}
    left = [rules[kind] for g in groups for kind in REMOVALS[g][0]]

    def step(g: str):
        def one(s: Column) -> Column:
            java = REMOVALS[g][1]
            held = F.coalesce(s["html"].rlike(java), F.lit(False))
            n = F.when(held, T.count_matches(s["html"], java)).otherwise(F.lit(0).cast("long"))
            html = F.when(held, F.regexp_replace(s["html"], java, "")).otherwise(s["html"])
            return F.struct(html.alias("html"), F.map_concat(s["n"], F.create_map(F.lit(g), n)).alias("n"))

        return one

    # Every group is a step over what the one before left, bound once, so that no page is gone over again.
    state = F.array(F.struct(F.col(html_col).cast("string").alias("html"), F.create_map().cast("map<string,bigint>").alias("n")))
    for g in groups:
        state = F.transform(state, step(g))
    fail = F.raise_error(F.lit("active content is left after sanitising")).cast("string")
    state = F.transform(state, lambda s: F.struct(F.when(holds(s["html"], left), fail).otherwise(s["html"]).alias("html"), s["n"].alias("n")))
    name = T.fresh("__state", pages)
    done = pages.withColumn(name, state[0])
    return done.withColumn("removed", F.col(name)["n"]).withColumn(html_col, F.col(name)["html"]).drop(name)


def letters(text: Column | str) -> Column:
    """Letters and digits of a text, lower-cased, ligatures spread out."""
    spread = F.replace(F.replace(F.replace(T.col(text), F.lit("ﬁ"), F.lit("fi")), F.lit("ﬂ"), F.lit("fl")), F.lit("ﬀ"), F.lit("ff"))
    return F.regexp_replace(F.lower(spread), r"[^\p{L}\p{N}]", "")


def restated(pairs: DataFrame, *, key: str, stated: str, drawn: str) -> DataFrame:
    """(key, n_stated, n_shared, restated): whether a stated text says something else than the drawn one.

    Letters are compared as multisets: half of the stated ones or more must be drawn. Fewer than three say nothing.
    """
    def counted(name: str) -> DataFrame:
        chars = pairs.select(key, F.explode(F.split(letters(name), "")).alias("c")).where("c <> ''")
        return chars.groupBy(key, "c").agg(F.count(F.lit(1)).alias(f"n_{name}"))

    both = counted(stated).join(counted(drawn), [key, "c"], "left")
    shared = F.sum(F.least(F.col(f"n_{stated}"), F.coalesce(F.col(f"n_{drawn}"), F.lit(0))))
    out = both.groupBy(key).agg(F.sum(f"n_{stated}").cast("long").alias("n_stated"), shared.cast("long").alias("n_shared"))
    return out.withColumn("restated", (F.col("n_stated") >= 3) & (F.col("n_shared") * 2 < F.col("n_stated")))
