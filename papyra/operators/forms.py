"""Form fields: listing them with their pages, filling them in."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def list_fields(fields: DataFrame, widgets: DataFrame) -> DataFrame:
    """Fields by name with the page of their first widget; ``widgets`` has doc_id, name, pos, page."""
    doc, name, page = (T.fresh(n, fields) for n in ("__doc", "__name", "__page"))
    first = widgets.groupBy(F.col("doc_id").alias(doc), F.col("name").alias(name)).agg(F.min_by("page", "pos").alias(page))
    joined = fields.join(first, (F.col("doc_id") == F.col(doc)) & (F.col("name") == F.col(name)), "left")
    return joined.withColumn("page", F.col(page)).drop(doc, name, page)


def plan_fill(fields: DataFrame, values: DataFrame) -> DataFrame:
    """What filling would do: one row per value with the new value, or the error that stops it.

    ``fields`` has doc_id, name, type, options, read_only; ``values`` has doc_id, name, value. A check box takes a
    yes or no, or one of its states; a choice takes one of its options.
    """
    values = values.select("doc_id", "name", "value")
    f = fields.select(F.col("doc_id").alias("d"), F.col("name").alias("f"), "type", "options", "read_only")
    joined = values.join(f, (F.col("doc_id") == F.col("d")) & (F.col("name") == F.col("f")), "left")
    answer = T.truthy("value")
    state = F.when(F.array_contains("options", F.col("value")), F.col("value")).when(answer, F.element_at("options", 1)).when(~answer, F.lit("Off"))
    new = (
        F.when(F.col("type") == "checkbox", state)
        .when(F.col("type") == "choice", F.when(F.array_contains("options", F.col("value")), F.col("value")))
        .when(F.col("type") == "text", F.col("value"))
    )
    error = (
        F.when(F.col("d").isNull(), F.concat(F.lit("no field "), F.col("name")))
        .when(F.col("read_only"), F.concat(F.col("name"), F.lit(" is read-only")))
        .when(~F.col("type").isin("text", "checkbox", "choice"), F.concat(F.col("name"), F.lit(" cannot be filled in")))
        .when(new.isNull(), F.concat(F.col("name"), F.lit(" takes one of: "), F.array_join("options", ", ")))
    )
    return joined.select("doc_id", "name", "value", F.when(error.isNull(), new).alias("new_value"), error.alias("error"))


def fill(fields: DataFrame, values: DataFrame) -> DataFrame:
    """``fields`` with the values filled in; any error fails the query."""
    plan = plan_fill(fields, values)
    checked = F.when(F.col("error").isNotNull(), F.raise_error("error").cast("string")).otherwise(F.col("new_value"))
    doc, name, value = (T.fresh(n, fields) for n in ("__doc", "__name", "__new"))
    new = plan.select(F.col("doc_id").alias(doc), F.col("name").alias(name), checked.alias(value))
    joined = fields.join(new, (F.col("doc_id") == F.col(doc)) & (F.col("name") == F.col(name)), "left")
    return joined.withColumn("value", F.coalesce(value, "value")).drop(doc, name, value)
