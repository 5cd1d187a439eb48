"""Model splits, counts, sheets, consolidated tables, manifests and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partmill.functions.scalars import is_valid_quantity, recode, strip
from partmill.operators.parts import blank_children, custom_flag

BASE_COLUMNS = ("page", "fig_no", "item_group", "fig_name", "show_in_website", "ranking", "catalogue_code", "model_name", "pic", "pic_path", "ref_no", "part_no", "description")
ERP_COLUMNS = ("hsn_code", "gst_rate", "mrp", "cost_price", "dealer_price", "rack_bin")


def quantity(model: str) -> Column:
    return F.coalesce(F.try_element_at("qty", F.lit(model)), F.lit(""))


def for_model(parts: DataFrame, model: str) -> DataFrame:
    """Custom rows and rows with a valid quantity of the model; qty keeps the model alone, trimmed, '' on custom rows."""
    custom = custom_flag(parts)
    kept = parts.filter(custom | is_valid_quantity(quantity(model)))
    return kept.withColumn("qty", F.create_map(F.lit(model), F.when(custom, F.lit("")).otherwise(strip(quantity(model)))))


def for_any_model(parts: DataFrame) -> DataFrame:
    """Where a document has two models or more: custom rows and rows with any valid quantity."""
    return parts.filter(custom_flag(parts) | (F.size("qty") < 2) | F.exists(F.map_values("qty"), is_valid_quantity))


def model_part_counts(parts: DataFrame) -> DataFrame:
    """doc_id, model, parts: rows with a valid quantity; custom rows don't count."""
    own = parts.filter(~custom_flag(parts)).select("doc_id", F.explode("qty").alias("model", "q"))
    return own.groupBy("doc_id", "model").agg(F.count_if(is_valid_quantity("q")).alias("parts"))


def sheet_projection(parts: DataFrame, models: list[str], erp: bool | None = None) -> DataFrame:
    """The sheet's columns in order: base, one per model, remarks, remark_flag, and the ERP block if a row has any."""
    own = blank_children(parts)
    have = [c for c in ERP_COLUMNS if c in parts.columns]
    if erp is None:
        erp = bool(have) and parts.filter(F.greatest(*[(strip(c) != "").cast("int") for c in have], F.lit(0)) == 1).limit(1).count() > 0
    cells = [F.col(c).cast("string").alias(c) if c in parts.columns else F.lit("").alias(c) for c in (*BASE_COLUMNS, "remarks", "remark_flag", *(ERP_COLUMNS if erp else ()))]
    return own.select("doc_id", "row_seq", *cells[: len(BASE_COLUMNS)], *[quantity(m).alias(m) for m in models], *cells[len(BASE_COLUMNS) :])


def model_sheets(parts: DataFrame) -> DataFrame:
    """One row per part and model with a valid quantity, or custom row, with the sheet it goes to."""
    custom = custom_flag(parts)
    own = parts.select("*", custom.alias("__custom"), F.explode("qty").alias("model", "quantity")).filter(F.col("__custom") | is_valid_quantity("quantity"))
    own = own.withColumn("quantity", F.when(F.col("__custom"), "").otherwise(strip("quantity"))).drop("qty", "__custom")
    for c in ("catalogue_code", "pic", "pic_path"):
        if c in own.columns:
            own = own.withColumn(c, recode(c, "model"))
    return own.withColumn("sheet", F.substring(F.concat(F.lit("Parts_"), "model"), 1, 31))


def write_model_sheets(parts: DataFrame, path: str) -> None:
    model_sheets(parts).write.partitionBy("sheet").mode("overwrite").parquet(path)


def write_consolidated(parts: DataFrame, path: str) -> None:
    """All documents below sheet=Master and each below a sheet of its own."""
    own = parts.withColumn("sheet", F.explode(F.array(F.lit("Master"), F.concat(F.lit("Doc_"), F.col("doc_id").cast("string")))))
    own.write.partitionBy("sheet").mode("overwrite").parquet(path)


def processing_summary(parts: DataFrame, images: DataFrame) -> DataFrame:
    """doc_id, model, parts, images: counts per model and the images of the document."""
    own = images.groupBy("doc_id").agg(F.count("*").alias("images"))
    return model_part_counts(parts).join(own, "doc_id", "left").withColumn("images", F.coalesce("images", F.lit(0)))


def bundle_manifest(parts: DataFrame, images: DataFrame) -> DataFrame:
    """bundle (document), path, kind, size: root file, sheets per model, images per model and at the root, summary; size is that of images, null for what is made later."""
    models = parts.select("doc_id", F.explode(F.map_keys("qty")).alias("model")).distinct()
    row = lambda kind, path, size=None: (F.col("doc_id").alias("bundle"), path.alias("path"), F.lit(kind).alias("kind"), (F.lit(None) if size is None else size).cast("long").alias("size"))
    size = F.col("size_bytes") if "size_bytes" in images.columns else F.octet_length("payload")
    docs, own = models.select("doc_id").distinct(), images.select("doc_id", "filename", size.alias("size"))
    return (
        docs.select(*row("source", F.lit("source.pdf")))
        .unionByName(docs.select(*row("summary", F.lit("summary.txt"))))
        .unionByName(models.select(*row("sheet", F.concat("model", F.lit("/xlsx/Parts_"), "model", F.lit(".xlsx")))))
        .unionByName(own.select(*row("image", F.concat(F.lit("images/"), "filename"), F.col("size"))))
        .unionByName(own.join(models, "doc_id").select(*row("model_image", F.concat("model", F.lit("/images/"), recode("filename", "model")), F.col("size"))))
    )


def union_documents(first: DataFrame, *more: DataFrame) -> DataFrame:
    for df in more:
        first = first.unionByName(df, allowMissingColumns=True)
    return first


def completed_documents(parts: DataFrame, job_ids: DataFrame) -> DataFrame:
    """Rows of the requested documents; those without rows drop out."""
    return parts.join(job_ids.select(F.col("job_id").alias("doc_id")).distinct(), "doc_id", "left_semi")
