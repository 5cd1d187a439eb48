"""Edits of rows, model names, picture paths and remark flags, overlaid by joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partmill.functions.scalars import clean_part_number, strip
from partmill.operators.parts import fig_key, has_figure_remarks, with_runs


def apply_row_edits(parts: DataFrame, deletes: DataFrame, adds: DataFrame, cells: DataFrame, clean: bool = True) -> DataFrame:
    """deletes(doc_id, row_seq); adds(doc_id): a default row each; cells(doc_id, row_seq, field, value), one per cell."""
    own = parts.join(deletes.select("doc_id", "row_seq").distinct(), ["doc_id", "row_seq"], "left_anti")
    by_row = cells.groupBy("doc_id", "row_seq").agg(F.map_from_entries(F.collect_list(F.struct("field", "value"))).alias("__cells"))
    own = own.join(by_row, ["doc_id", "row_seq"], "left")
    for c in ("ref_no", "part_no", "description", "remarks", "fig_no", "fig_name"):
        new = F.try_element_at("__cells", F.lit(c))
        own = own.withColumn(c, F.coalesce(clean_part_number(new) if c == "part_no" and clean else new, F.col(c)) if c != "part_no" else F.when(new.isNotNull(), clean_part_number(new) if clean else new).otherwise(F.col(c)))
    own = own.select(*parts.columns)
    last = parts.groupBy("doc_id").agg(F.max("row_seq").alias("__last"), F.max_by("qty", "row_seq").alias("__qty"), F.max_by(F.struct("page", "fig_no", "fig_name"), "row_seq").alias("__at"))
    new = adds.select("doc_id").distinct().join(last, "doc_id").select(
        "doc_id", (F.col("__last") + 1).alias("row_seq"), "__at.page", "__at.fig_no", "__at.fig_name", F.lit("").alias("ref_no"), F.lit("NEW-PART-00").alias("part_no"),
        F.lit("").alias("description"), F.lit("").alias("remarks"), F.transform_values("__qty", lambda k, v: F.lit("1")).alias("qty"),
    )
    return own.unionByName(new, allowMissingColumns=True)


def apply_model_names(parts: DataFrame, edits: DataFrame, everywhere: str | None = None, column: str = "model_name") -> DataFrame:
    """Figure edit over the edit for all over what is there, on parent rows; children get ''.

    edits(doc_id, fig_no, fig_name, value), one per figure.
    """
    key = parts.withColumn("__key", fig_key(parts))
    given = edits.select("doc_id", F.struct(strip("fig_no").alias("no"), strip("fig_name").alias("name")).alias("__key"), F.nullif(strip("value"), F.lit("")).alias("__value"))
    own = key.join(given, ["doc_id", "__key"], "left")
    parent = F.coalesce("is_parent", F.lit(False)) if "is_parent" in parts.columns else F.lit(False)
    parent = parent | strip("ref_no").isin("1", "01")
    had = F.col(column) if column in parts.columns else F.lit("")
    value = F.coalesce("__value", F.nullif(F.lit(everywhere or ""), F.lit("")), had, F.lit(""))
    return own.withColumn(column, F.when(parent, value).otherwise("")).select(*parts.columns, *([] if column in parts.columns else [column]))


def apply_remark_flags(parts: DataFrame, slot_edits: DataFrame, x_text: str = "", batch: dict[int, str] | None = None) -> DataFrame:
    """remark_flag by slot 0 to 5 of each figure with remarks; edits(doc_id, fig_no, fig_name, slot, value) come first."""
    given = strip("remark_flag") if "remark_flag" in parts.columns else F.lit("")
    own = with_runs(parts.withColumn("__remarks", has_figure_remarks(parts)).withColumn("__had", given))
    edits = slot_edits.select("doc_id", F.struct(strip("fig_no").alias("no"), strip("fig_name").alias("name")).alias("fig_key"), F.col("slot").alias("run_offset"), F.col("value").alias("__value"))
    own = own.join(edits, ["doc_id", "fig_key", "run_offset"], "left")
    slot = F.col("run_offset")
    batch_value: Column = F.lit("")
    for k, v in (batch or {}).items():
        batch_value = F.when(slot == k, F.lit(v)).otherwise(batch_value)
    first = F.when(F.lit(x_text) != "", F.lit(x_text)).when(F.col("__had") != "", F.col("__had")).otherwise("X")
    rest = F.when(batch_value != "", batch_value).otherwise(F.col("__had"))
    flag = F.when(~F.col("__remarks") | (slot > 5), "").otherwise(F.coalesce("__value", F.when(slot == 0, first).otherwise(rest)))
    return own.withColumn("remark_flag", flag).select(*parts.columns, *([] if "remark_flag" in parts.columns else ["remark_flag"]))


def figure_parts(parts: DataFrame, fig_no: str, fig_name: str) -> DataFrame:
    """Rows of a figure by number or by upper-case name."""
    return parts.filter((strip("fig_no") == fig_no.strip()) | (F.upper(strip("fig_name")) == fig_name.strip().upper()))
