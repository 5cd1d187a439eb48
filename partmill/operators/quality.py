"""Validation, summary, search, sort and pages of part rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from partmill.functions.scalars import clean_part_number, clean_remarks, is_custom_section, is_valid_quantity, let, strip, text
from partmill.operators.parts import custom_flag, fig_key
from partmill.sources.scratch import scratch_path

LOOSE = ["", "0", "-"]


def validate_rows(parts: DataFrame) -> DataFrame:
    """duplicate_ref, no_part_no, short_part_no, no_description, no_quantity, has_issue and issues. Custom rows have none."""
    own = parts.withColumn("__ref", F.upper(strip("ref_no"))).withColumn("__custom", custom_flag(parts))
    same = Window.partitionBy("doc_id", fig_key(parts), "__ref")
    twice = (F.col("__ref") != "") & (F.sum((~F.col("__custom")).cast("int")).over(same) > 1)
    part = strip("part_no")
    no_qty = (F.size("qty") > 0) & ~F.exists(F.map_values("qty"), lambda q: ~strip(q).isin(LOOSE))
    tests = {"duplicate_ref": twice, "no_part_no": part == "", "short_part_no": (part != "") & (F.length(clean_part_number("part_no")) < 5), "no_description": strip("description") == "", "no_quantity": no_qty}
    for name, test in tests.items():
        own = own.withColumn(name, ~F.col("__custom") & test)
    own = own.withColumn("issues", F.array_compact(F.array(*[F.when(F.col(n), F.lit(n)) for n in tests])))
    return own.withColumn("has_issue", F.size("issues") > 0).drop("__ref", "__custom")


def with_issue(validated: DataFrame, kind: str = "ALL") -> DataFrame:
    kinds = {"ALL": F.lit(True), "ISSUES": F.col("has_issue"), "PART_NO": F.col("no_part_no") | F.col("short_part_no"), "DUPLICATE_REF": F.col("duplicate_ref"), "DESC": F.col("no_description"), "QTY": F.col("no_quantity")}
    return validated.filter(kinds[kind])


def quality_summary(validated: DataFrame) -> DataFrame:
    n, bad = F.count("*"), F.count_if("has_issue")
    rate = F.when(n == 0, 100).otherwise(F.floor((n - bad) / n * 100 + 0.5)).cast("int")
    count = lambda c: F.count_if(c)
    return validated.agg(
        n.alias("n_rows"), bad.alias("n_issues"), count("duplicate_ref").alias("n_duplicate_ref"), count(F.col("no_part_no") | F.col("short_part_no")).alias("n_part_no"),
        count("no_description").alias("n_description"), count("no_quantity").alias("n_quantity"), rate.alias("clean_rate"),
    )


def _holds(term: str, *cols) -> Column:
    return F.exists(F.array(*[text(c) for c in cols]), lambda c: F.lower(c).contains(term.lower()))


def search_dashboard(parts: DataFrame, term: str = "", figure: str = "", model: str = "") -> DataFrame:
    """Figure, model and term; custom rows match on their figure name alone and go where a figure is chosen."""
    custom = custom_flag(parts) | is_custom_section(F.lit(False), "fig_name")
    own = (F.lit(figure == "") | (F.col("fig_no") == figure)) & (F.lit(model == "") | is_valid_quantity(F.coalesce(F.try_element_at("qty", F.lit(model)), F.lit(""))))
    own = own & _holds(term.strip(), "part_no", "description", "remarks", "fig_name", "ref_no")
    return parts.filter(F.when(custom, F.lit(figure == "") & _holds(term.strip(), "fig_name")).otherwise(own))


def search_table(parts: DataFrame, term: str) -> DataFrame:
    part = let(text("part_no"), lambda c: _holds(term.strip(), c, clean_part_number(c)))
    return parts.filter(part | _holds(term.strip(), "description", "ref_no", "fig_no", "fig_name", "remarks"))


NUMBERED = ("page", "ref_no", "fig_no")


def with_resolved_flag(parts: DataFrame) -> DataFrame:
    """resolved_flag: X on rows flagged X and on all rows of a figure that has remarks anywhere in its document."""

    def own(name: str) -> Column:
        parent = strip(f"parent_{name}") if f"parent_{name}" in parts.columns else F.lit("")
        return F.when(parent == "", strip(name)).otherwise(parent)

    said = F.max((clean_remarks("remarks") != "").cast("int")).over(Window.partitionBy("doc_id", own("fig_no"), own("fig_name"))) == 1
    return parts.withColumn("resolved_flag", F.when(said | (F.coalesce("remark_flag", F.lit("")) == "X"), "X").otherwise(""))


def sort_keys(parts: DataFrame, field: str, desc: bool = False, clean: bool = True) -> list[Column]:
    """Custom rows last; numbers by their first number, flags as resolved (see `with_resolved_flag`), then text; ties in row order."""
    value = clean_part_number(field) if field == "part_no" and clean else text(F.col(field).cast("string"))
    keys = []
    if field in NUMBERED:
        keys.append(F.regexp_extract(F.regexp_replace(value, "[^0-9.\\-]", ""), r"^-?\d*\.?\d+", 0).try_cast("double"))
    if field == "remark_flag" and "resolved_flag" in parts.columns:
        keys.append(F.col("resolved_flag"))
    keys.append(F.lower(value))
    custom = custom_flag(parts)
    ordered = [F.when(~custom, k) for k in keys]
    return [custom.cast("int"), *[(k.desc_nulls_last() if desc else k.asc_nulls_last()) for k in ordered], F.col("doc_id"), F.col("row_seq")]


def sort_parts(parts: DataFrame, field: str, desc: bool = False, clean: bool = True) -> DataFrame:
    own = with_resolved_flag(parts) if field == "remark_flag" else parts
    return own.orderBy(*sort_keys(own, field, desc, clean)).select(*parts.columns)


def page_of(ordered: DataFrame, page: int, size: int) -> DataFrame:
    """Page 1, 2, ... of an ordered frame; size -1 is all."""
    return ordered if size < 0 else ordered.offset((page - 1) * size).limit(size)


def deep_page(parts: DataFrame, field: str, page: int, size: int, desc: bool = False, clean: bool = True) -> DataFrame:
    """Page 1, 2, ... of a sort: rows are dealt into ranges once, and only the ranges that hold the page are read and sorted.

    The driver sees one count a range. No task holds the rows before the page.
    """
    own = with_resolved_flag(parts) if field == "remark_flag" else parts
    path = scratch_path(parts.sparkSession)
    keys = sort_keys(own, field, desc, clean)
    own.repartitionByRange(*keys).withColumn("__range", F.spark_partition_id()).write.partitionBy("__range").parquet(path)
    dealt = parts.sparkSession.read.schema(own.withColumn("__range", F.lit(0)).schema).parquet(path)
    first, wanted, skip, seen = (page - 1) * size, [], 0, 0
    for number, n in sorted((r["__range"], r["count"]) for r in dealt.groupBy("__range").count().collect()):
        if seen + n > first and seen < first + size:
            skip = skip if wanted else first - seen
            wanted.append(number)
        seen += n
    held = dealt.filter(F.col("__range").isin(wanted))
    return held.orderBy(*sort_keys(held, field, desc, clean)).offset(skip).limit(size).select(*parts.columns)


def head_per_group(df: DataFrame, keys: list[str], order: list, n: int) -> DataFrame:
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("__n") <= n).drop("__n")
