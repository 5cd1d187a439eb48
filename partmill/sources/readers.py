"""Word tables, OCR tables, part rows and document manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from partmill.functions.scalars import strip
from partmill.sources.files import file_listing

LARGEST = 60 * 1024 * 1024
OCR_COLUMNS = "level page_num block_num par_num line_num word_num left top width height conf text".split()
FIXED = ("doc_id", "row_seq", "page", "fig_no", "fig_name", "ref_no", "part_no", "description", "remarks")


def read_words(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, page, text, x0, x1, top, bottom; texts are not null."""
    return spark.read.parquet(path).withColumn("text", F.coalesce("text", F.lit("")))


def read_ocr_tsv(spark: SparkSession, path: str, scale: float = 1.0) -> DataFrame:
    """Words of tab-separated OCR files, one file a page, by the names in their first line; the file's name is kept in `file`."""
    lines = spark.read.text(path).select(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), "value", F.monotonically_increasing_id().alias("__row"))
    # The first line of a file that isn't blank: monotonic ids grow within a file's block.
    first = lines.filter(F.trim("value") != "").groupBy("path").agg(F.min_by("value", F.struct("block", "__row")).alias("head"), F.min(F.struct("block", "__row")).alias("at"))
    own = lines.join(first, "path").filter(F.struct("block", "__row") > F.col("at"))
    return parse_ocr(own.select("file", F.split("value", "\t", -1).alias("f"), F.split("head", "\t", -1).alias("names")), scale)


def parse_ocr(lines: DataFrame, scale: float = 1.0) -> DataFrame:
    """lines(file, f[, names]): fields in the order of `names`, or of OCR_COLUMNS; lines of another number of fields, without text, box or confidence over 20 drop out."""
    s = scale if scale > 0 else 1.0
    if "names" in lines.columns:
        names = F.array_distinct("names")
        at = lambda n: F.array_position(names, n).cast("int") - 1
    else:
        at = lambda n: F.lit(OCR_COLUMNS.index(n))
    field = lambda n: F.coalesce(F.get("f", at(n)), F.lit(""))
    num = lambda n: F.trim(field(n)).try_cast("double").alias(n)
    count = F.size("names") if "names" in lines.columns else F.lit(len(OCR_COLUMNS))
    right = ((F.size("f") == count) & (F.col("f")[0] != "level")).alias("__right")
    # Out of a generator, so that each value is made once: filters on it aren't pushed below, where the line would be split again for each.
    own = lines.select("file", F.inline(F.array(F.struct(right, strip(field("text")).alias("text"), num("conf"), *[num(n) for n in ("left", "top", "width", "height")]))))
    own = own.filter("__right and text <> '' and conf > 20 and left is not null and top is not null and width is not null and height is not null")
    return own.select("file", "text", (F.col("left") / s).alias("x0"), (F.col("top") / s).alias("top"), ((F.col("left") + F.col("width")) / s).alias("x1"), ((F.col("top") + F.col("height")) / s).alias("bottom"))


def document_manifest(spark: SparkSession, path: str, max_bytes: int = LARGEST) -> DataFrame:
    """path, length, status of each file below `path`, empty ones too, without reading contents."""
    return admitted(file_listing(spark, path), max_bytes).select("path", "length", "status")


def admitted(files: DataFrame, max_bytes: int = LARGEST) -> DataFrame:
    status = F.when(~F.lower("path").endswith(".pdf"), "bad_format").when(F.col("length") == 0, "empty").when(F.col("length") > max_bytes, "too_large").otherwise("accepted")
    return files.withColumn("status", status)


def read_part_rows_json(spark: SparkSession, path: str) -> DataFrame:
    """Part rows of JSON lines; unknown keys are models and go to qty, null as ''."""
    return fold_models(spark.read.text(path).select(F.from_json("value", "map<string,string>").alias("m")))


def fold_models(rows: DataFrame) -> DataFrame:
    known = F.array(*[F.lit(c) for c in FIXED])
    qty = F.transform_values(F.map_filter("m", lambda k, v: ~F.array_contains(known, k)), lambda k, v: F.coalesce(v, F.lit("")))
    numbers = {"doc_id": "int", "row_seq": "bigint", "page": "int"}
    value = lambda c: F.try_element_at("m", F.lit(c))
    return rows.select(*[value(c).try_cast(numbers[c]).alias(c) if c in numbers else F.coalesce(value(c), F.lit("")).alias(c) for c in FIXED], qty.alias("qty"))
