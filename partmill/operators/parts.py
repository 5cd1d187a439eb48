"""Rows of parts: figure runs, parents, repeated references, remark flags, custom sections, codes.

`parts` has at least doc_id, row_seq, page, fig_no, fig_name, ref_no, part_no,
description, remarks and qty (map of model to quantity). Order is row_seq within
doc_id. The columns of `with_runs` are computed once where several operators follow
each other on its result. Runs and blocks are scanned in chunks of rows, so that a document isn't one
task; a window covers at most the rows of one reference or figure.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from partmill.functions.scalars import SECTIONS, build_model_name_record, catalogue_code, detect_brand, extract_raw_model_name, is_valid_quantity, let, letter_suffix, strip
from partmill.operators.scan import by_rows, carried


def rows_of():
    return Window.partitionBy("doc_id").orderBy("row_seq")


SECTION_ROWS = {"PART KITS & SETS": 10, "REGULAR SERVICE PARTS": 15}


def fig_key(df: DataFrame) -> Column:
    """(parent or own number, parent or own name), or the page where both are empty."""

    def own(name: str) -> Column:
        parent = strip(f"parent_{name}") if f"parent_{name}" in df.columns else F.lit("")
        return F.when(parent == "", strip(name)).otherwise(parent)

    no, name = own("fig_no"), own("fig_name")
    return F.when((no == "") & (name == ""), F.struct(F.lit("page").alias("no"), F.col("page").cast("string").alias("name"))).otherwise(F.struct(no.alias("no"), name.alias("name")))


def custom_flag(df: DataFrame) -> Column:
    return F.coalesce("is_custom_section", F.lit(False)) if "is_custom_section" in df.columns else F.lit(False)


def with_first_of_figure(parts: DataFrame) -> DataFrame:
    """is_parent: the first row of a (fig_no, fig_name) in its document."""
    first = Window.partitionBy("doc_id", "fig_no", "fig_name").orderBy("row_seq")
    return parts.withColumn("is_parent", F.row_number().over(first) == 1)


def with_runs(parts: DataFrame) -> DataFrame:
    """fig_key, first_in_run, run and run_offset (from 0): consecutive rows of one figure key; with is_parent also block, counted from each start of a run or parent.

    Custom rows start a run only where they are parents and don't change the key that others are compared with.
    """
    own = parts.drop("block").withColumns({"fig_key": fig_key(parts), "__custom": custom_flag(parts), "__chunk_of": by_rows()})
    has_parents = "is_parent" in parts.columns
    parent = F.coalesce("is_parent", F.lit(False)) if has_parents else F.lit(False)
    own = carried(own, ["doc_id"], ["row_seq"], "__chunk_of", before={"__last": F.when(~F.col("__custom") | parent, F.col("fig_key"))}, sums={"__n": F.lit(1)})
    start = F.when(F.col("__custom"), parent).otherwise(F.col("__last").isNull() | (F.col("__last") != F.col("fig_key")))
    own = own.withColumn("first_in_run", start)
    counts = {"run": F.col("first_in_run").cast("int")} | ({"block": (F.col("first_in_run") | parent).cast("int")} if has_parents else {})
    own = carried(own, ["doc_id"], ["row_seq"], "__chunk_of", {"__start": F.when(F.col("first_in_run"), F.col("__n"))}, sums=counts)
    return own.withColumn("run_offset", (F.col("__n") - F.coalesce("__start", F.lit(1))).cast("int")).drop("__last", "__custom", "__chunk_of", "__n", "__start")


def suffix_repeated_refs(parts: DataFrame) -> DataFrame:
    """Repeated references of a parent block get A, B, ...; one that comes once loses its letter."""
    block = with_runs(parts) if "run" not in parts.columns else parts
    if "is_parent" not in parts.columns:
        block = block.withColumn("block", F.col("run"))
    elif "block" not in block.columns:
        starts = F.col("first_in_run") | F.coalesce("is_parent", F.lit(False))
        block = carried(block, ["doc_id"], ["row_seq"], by_rows(), sums={"block": starts.cast("int")})
    ref = strip("ref_no")
    base = F.when(ref.rlike("^[0-9]+[A-Za-z]$"), F.regexp_extract(ref, "^([0-9]+)", 1)).otherwise(ref)
    block = block.withColumn("__base", base)
    same = Window.partitionBy("doc_id", "block", "__base")
    n, k = F.count("*").over(same), F.row_number().over(same.orderBy("row_seq"))
    named = F.when(F.col("__base") == "", F.col("ref_no")).when(n > 1, F.concat("__base", letter_suffix(k - 1))).otherwise(F.col("__base"))
    return block.withColumn("__ref", named).withColumn("ref_no", F.col("__ref")).select(*parts.columns)


def has_figure_remarks(df: DataFrame) -> Column:
    return F.max((strip("remarks") != "").cast("int")).over(Window.partitionBy("doc_id", fig_key(df))) == 1


def with_remark_flag(parts: DataFrame) -> DataFrame:
    """remark_flag: X on the first row of each run of a figure that has remarks anywhere in the document; a value that is there stays."""
    given = strip("remark_flag") if "remark_flag" in parts.columns else F.lit("")
    own = parts.withColumn("__remarks", has_figure_remarks(parts)).withColumn("__given", given)
    own = own if "run" in parts.columns else with_runs(own)
    flag = F.when(F.col("__given") != "", F.col("__given")).when(F.col("first_in_run") & F.col("__remarks"), "X").otherwise("")
    return own.withColumn("remark_flag", flag).select(*parts.columns, *([] if "remark_flag" in parts.columns else ["remark_flag"]))


PARENT_CELLS = ("page", "fig_no", "item_group", "fig_name", "catalogue_code", "model_name", "pic", "pic_path")


def blank_children(parts: DataFrame) -> DataFrame:
    """Cells that only the first row of a run shows, as text."""
    own = parts if "run" in parts.columns else with_runs(parts)
    for c in PARENT_CELLS:
        if c in parts.columns:
            own = own.withColumn(f"__{c}", F.when(F.col("first_in_run"), F.coalesce(F.col(c).cast("string"), F.lit(""))).otherwise(""))
    return own.select(*[F.col(f"__{c}").alias(c) if c in PARENT_CELLS else F.col(c) for c in parts.columns])


def append_custom_sections(parts: DataFrame, model: str | None = None) -> DataFrame:
    """25 rows of the two custom sections after every document, where it has none.

    Their code is `model`, else the document's only model, else the first model_code that
    a row has, else all models joined, else MODEL. Brand and vehicle's name come from the first row
    with a model_name, the folder of pictures from the first whose pic_path ends with its pic.
    """
    spark = parts.sparkSession
    own = parts.withColumn("is_custom_section", custom_flag(parts) | F.upper(strip("fig_name")).isin(SECTIONS))
    cell = lambda c: strip(c) if c in parts.columns else F.lit("")
    pic = F.when(cell("pic") != "", cell("pic")).otherwise(cell("image"))
    folder = F.when((pic != "") & F.endswith(cell("pic_path"), pic) & (F.length(cell("pic_path")) > F.length(pic)), F.substr(cell("pic_path"), F.lit(1), F.length(cell("pic_path")) - F.length(pic)))
    first = lambda value, where: F.min_by(value, F.when(where, F.col("row_seq")))
    docs = own.groupBy("doc_id").agg(
        F.max("row_seq").alias("__last"), F.max("is_custom_section").alias("__has"), F.min_by(F.map_keys("qty"), "row_seq").alias("__models"),
        first(F.upper(cell("model_code")), cell("model_code") != "").alias("__code"), first(F.struct(cell("model_name").alias("name"), cell("model_code").alias("code")), cell("model_name") != "").alias("__named"), first(folder, folder.isNotNull()).alias("__folder"),
    ).filter("not __has")
    joined = F.array_join(F.filter(F.transform("__models", lambda m: F.upper(strip(m))), lambda m: m != ""), "_")
    active = F.upper(strip(F.lit(model))) if model else F.when(F.size("__models") == 1, F.upper(strip(F.col("__models")[0]))).otherwise(F.coalesce("__code", F.nullif(joined, F.lit("")), F.lit("MODEL")))
    docs = docs.withColumn("__active", active).withColumn("__vehicle", F.when(F.col("__named").isNull(), "").otherwise(extract_raw_model_name("__named.name", F.col("__active"), F.col("__named.code"))))
    places = [(k, name, i == 0) for k, (name, i) in enumerate((n, i) for n, size in SECTION_ROWS.items() for i in range(size))]
    rows = docs.crossJoin(F.broadcast(spark.createDataFrame(places, "__k int, __section string, is_parent boolean")))  # 25 rows
    at = catalogue_code("__active", "__section")
    brand = F.when(F.col("__named").isNull(), "YAMAHA").otherwise(detect_brand("__named.name"))
    shown = {
        "item_group": F.col("__active"), "fig_name": F.col("__section"), "catalogue_code": at, "model_name": build_model_name_record("__active", "__vehicle", "__section", brand),
        "pic": F.concat(at, F.lit(".jpeg")), "image": F.concat(at, F.lit(".jpeg")), "pic_path": F.concat(F.coalesce("__folder", F.lit("")), at, F.lit(".jpeg")),
    }
    added = rows.select(
        "doc_id", (F.col("__last") + 1 + F.col("__k")).alias("row_seq"), F.lit(None).cast("int").alias("page"), *[F.lit("").alias(c) for c in ("fig_no", "parent_fig_no", "ref_no", "part_no", "description", "remarks")],
        "is_parent", F.lit(True).alias("is_custom_section"), F.col("__section").alias("parent_fig_name"), F.col("__active").alias("model_code"), *[F.when(F.col("is_parent"), v).otherwise("").alias(c) for c, v in shown.items()],
        F.transform_values(F.map_from_arrays("__models", "__models"), lambda k, v: F.lit("")).alias("qty"),
    )
    return own.unionByName(added, allowMissingColumns=True)


def ordered_models(parts: DataFrame, by: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """models: the codes of each group by first appearance; by=() orders over all documents."""
    seen = parts.select("doc_id", "row_seq", F.posexplode(F.map_keys("qty")).alias("pos", "model"))
    first = seen.groupBy(*by, "model").agg(F.min(F.struct("doc_id", "row_seq", "pos")).alias("at"))
    return first.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("at", "model"))).alias("m")).select(*by, F.col("m.model").alias("models"))


def backfill_models(parts: DataFrame, models: list[str]) -> DataFrame:
    """qty with every model, '' where a row has none."""
    return parts.withColumn("qty", F.map_from_arrays(F.array(*[F.lit(m) for m in models]), F.array(*[F.coalesce(F.try_element_at("qty", F.lit(m)), F.lit("")) for m in models])))


def consolidate(parts: DataFrame) -> DataFrame:
    """All documents in order, with a model code each and references suffixed anew."""
    code = F.coalesce(F.nullif(strip("model_code"), F.lit("")) if "model_code" in parts.columns else F.lit(None), F.try_element_at(F.map_keys("qty"), F.lit(1)), F.lit("MODEL"))
    return suffix_repeated_refs(parts.withColumn("model_code", code))


def reconcile_model_codes(parts: DataFrame, authoritative: DataFrame) -> DataFrame:
    """qty keys and model_code by the document's four-character code.

    A name of 2 to 3 characters that starts, ends or is contained in the code,
    or is made of its letters, a reversal or anagram of it, and MODEL take the
    code. All renamed quantities move along; of several that meet, the first
    valid one by old name counts.
    """
    own = parts.join(authoritative.select("doc_id", F.upper("code").alias("__code")), "doc_id", "left")

    def renamed(name: Column) -> Column:
        code, n = F.col("__code"), F.upper(name)
        letters = lambda c: F.array_sort(F.split(c, ""))
        short = F.length(n).between(2, 3) & (code.contains(n) | (F.size(F.array_except(F.split(n, ""), F.split(code, ""))) == 0))
        whole = (F.length(n) == 4) & (letters(n) == letters(code))
        return F.when(F.length(code) == 4, F.when((n == "MODEL") | short | whole, code).otherwise(name)).otherwise(name)

    def folded(entries: Column) -> Column:
        def value(name: Column) -> Column:
            return let(F.filter(entries, lambda e: e["model"] == name), lambda own: F.coalesce(F.try_element_at(F.filter(own, lambda e: is_valid_quantity(e["q"])), F.lit(1))["q"], own[0]["q"]))

        return F.map_from_entries(F.transform(F.array_sort(F.array_distinct(F.transform(entries, lambda e: e["model"]))), lambda name: F.struct(name, value(name))))

    # In the row: a quantity meets only those of its own row, so that nothing is exchanged.
    entries = F.array_sort(F.transform(F.map_entries("qty"), lambda e: F.struct(e["key"].alias("old"), renamed(e["key"]).alias("model"), e["value"].alias("q"))))
    own = own.withColumn("qty", let(entries, folded))
    if "model_code" in parts.columns:
        own = own.withColumn("model_code", renamed(F.col("model_code")))
    return own.select(*parts.columns)


def distinct_models(parts: DataFrame) -> DataFrame:
    return parts.select("doc_id", F.explode(F.map_keys("qty")).alias("model")).distinct()
