"""Catalogue tables derived from the given ones, as SQL that Spark and DuckDB both run."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from partmill.functions.scalars import clean_description, clean_part_number, clean_remarks
from partmill.sources.scratch import cut

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # rasters are made by workers that lack the package

CAT_ROWS = """SELECT cast(floor(l.l_orderkey / 512.0) AS INT) AS doc_id,
 row_number() OVER (PARTITION BY cast(floor(l.l_orderkey / 512.0) AS INT) ORDER BY l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey, l.l_extendedprice) AS row_seq,
 cast(l.l_orderkey % 512 AS INT) + 1 AS page,
 cast(cast(l.l_orderkey % 512 AS INT) + 1 AS STRING) AS fig_no,
 o.o_orderpriority AS fig_name,
 cast(l.l_linenumber AS STRING) AS ref_no,
 concat(lpad(cast(l.l_suppkey % 1000 AS STRING), 3, '0'), '-', lpad(cast(l.l_partkey AS STRING), 5, '0'), CASE WHEN l.l_partkey % 3 = 0 THEN '' WHEN l.l_partkey % 3 = 1 THEN '-00' ELSE '-00-P0' END) AS part_no,
 concat('.', upper(p.p_name), ', ', p.p_type) AS description,
 CASE l.l_returnflag WHEN 'R' THEN concat('UR FOR ', p.p_brand) WHEN 'A' THEN 'UR / AB' ELSE '' END AS remarks,
 CASE WHEN l.l_linestatus = 'O' THEN cast(cast(l.l_quantity AS INT) AS STRING) WHEN l.l_partkey % 2 = 0 THEN '-' ELSE '' END AS qty1,
 CASE WHEN l.l_linestatus = 'F' AND l.l_partkey % 4 <> 0 THEN cast(cast(l.l_quantity AS INT) AS STRING) WHEN l.l_partkey % 5 = 0 THEN '*' ELSE '0' END AS qty2
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN part p ON l.l_partkey = p.p_partkey"""

CAT_WORDS = """r AS (SELECT c.*, row_number() OVER (PARTITION BY doc_id, page ORDER BY row_seq) AS rn,
  lag(ref_no) OVER (PARTITION BY doc_id, page ORDER BY row_seq) AS prev_ref FROM cat_rows c),
d AS (
 SELECT doc_id, page, 'row' AS kind, 100.0 + 16*rn + 0.3*(row_seq % 5) AS top, 50.0 AS x0, ref_no AS text FROM r WHERE prev_ref IS NULL OR prev_ref <> ref_no
 UNION ALL SELECT doc_id, page, 'row', 100.0 + 16*rn + 0.3*((row_seq+1) % 5), 120.0, part_no FROM r
 UNION ALL SELECT doc_id, page, 'row', 100.0 + 16*rn + 0.3*((row_seq+2) % 5), 240.0, split_part(description,' ',1) FROM r
 UNION ALL SELECT doc_id, page, 'row', 100.0 + 16*rn + 0.3*((row_seq+3) % 5), 320.0, split_part(description,' ',2) FROM r
 UNION ALL SELECT doc_id, page, 'row', 100.0 + 16*rn + 0.3*((row_seq+4) % 5), 400.0, split_part(description,' ',3) FROM r
 UNION ALL SELECT doc_id, page, 'row', 100.0 + 16*rn + 0.3*(row_seq % 5), 520.0, qty1 FROM r WHERE qty1 <> ''
 UNION ALL SELECT doc_id, page, 'row', 100.0 + 16*rn + 0.3*(row_seq % 5), 560.0, qty2 FROM r WHERE qty2 <> ''
 UNION ALL SELECT doc_id, page, 'row', 100.0 + 16*rn + 0.3*(row_seq % 5), 640.0, split_part(remarks,' ',1) FROM r WHERE remarks <> ''
 UNION ALL SELECT doc_id, page, 'row', 100.0 + 16*rn + 0.3*(row_seq % 5), 680.0, split_part(remarks,' ',2) FROM r WHERE remarks <> ''
 UNION ALL SELECT doc_id, page, 'row', 100.0 + 16*rn + 0.3*(row_seq % 5), 720.0, split_part(remarks,' ',3) FROM r WHERE remarks <> ''),
h AS (SELECT p.doc_id, p.page, 'head' AS kind, v.top, v.x0, CASE v.text WHEN '$NO' THEN p.fig_no WHEN '$NAME' THEN p.fig_name ELSE v.text END AS text
 FROM (SELECT DISTINCT doc_id, page, fig_no, fig_name FROM r) p CROSS JOIN (VALUES
 (20.0,50.0,'FIG.'),(20.0,80.0,'$NO'),(20.0,110.0,'$NAME'),(75.0,50.0,'REF.'),(75.0,120.0,'PART'),(75.0,150.0,'NO.'),(75.0,240.0,'DESCRIPTION'),(75.0,640.0,'REMARKS'),
 (50.0,520.0,'1'),(58.0,520.0,'P'),(66.0,520.0,'G'),(74.0,520.0,'B'),(50.0,560.0,'2'),(58.0,560.0,'P'),(66.0,560.0,'G'),(74.0,560.0,'B'),(565.0,420.0,'7')) AS v(top,x0,text))
SELECT doc_id, page, kind, cast(top AS DOUBLE) AS top, cast(top AS DOUBLE) + 7 AS bottom, cast(x0 AS DOUBLE) AS x0, cast(x0 AS DOUBLE) + 6*length(text) AS x1, text FROM (SELECT * FROM d UNION ALL SELECT * FROM h) u WHERE text <> ''"""

# Words of ruled pages; $NAME stands for the page's title.
RULED_WORDS = """t AS (SELECT DISTINCT doc_id, page, fig_name FROM b),
u AS (SELECT doc_id, page, 20.0 AS top, v.x0, CASE v.text WHEN '$NAME' THEN fig_name ELSE v.text END AS text FROM t CROSS JOIN (VALUES (50.0,'TABLE'),(90.0,'7'),(110.0,'$NAME')) AS v(x0,text) WHERE page % 10 = 2
 UNION ALL SELECT doc_id, page, 60.0, v.x0, v.text FROM t CROSS JOIN (VALUES (600.0,'REF.'),(640.0,'NAME'),(910.0,'PART'),(945.0,'NO.'),(1015.0,'QTY'),(1060.0,'REMARKS')) AS v(x0,text)
 UNION ALL SELECT doc_id, page, y, 600.0, ref_no FROM b UNION ALL SELECT doc_id, page, y, 640.0, description FROM b
 UNION ALL SELECT doc_id, page, y, 910.0, substr(part_no, 1, 4) FROM b UNION ALL SELECT doc_id, page, y, 940.0, substr(part_no, 5) FROM b
 UNION ALL SELECT doc_id, page, y, 1015.0, qty1 FROM b UNION ALL SELECT doc_id, page, y, 1060.0, remarks FROM b)
SELECT doc_id, page, cast(top AS DOUBLE) AS top, cast(top AS DOUBLE) + 7 AS bottom, cast(x0 AS DOUBLE) AS x0, cast(x0 AS DOUBLE) + CASE WHEN x0 = 600.0 THEN 3 ELSE 6 END * length(text) AS x1, text FROM u WHERE text <> ''"""

# Format B: a ruled band of 20 points for each row; every fourth ref is left out.
CAT_WORDS_B = """r AS (SELECT c.*, 90.0 + 20 * row_number() OVER (PARTITION BY doc_id, page ORDER BY row_seq) AS top FROM cat_rows c),
u AS (SELECT doc_id, page, top, 600.0 AS x0, ref_no AS text FROM r WHERE row_seq % 4 <> 0
 UNION ALL SELECT doc_id, page, top, 640.0, description FROM r
 UNION ALL SELECT doc_id, page, top, 910.0, part_no FROM r
 UNION ALL SELECT doc_id, page, top, 1015.0, qty1 FROM r
 UNION ALL SELECT doc_id, page, top, 1060.0, remarks FROM r)
SELECT doc_id, page, cast(top AS DOUBLE) AS top, cast(x0 AS DOUBLE) AS x0, cast(x0 AS DOUBLE) + 6 * length(text) AS x1, text FROM u WHERE text <> ''"""

COLOR_PAGES = """SELECT c_custkey AS doc_id, cast(c_custkey % 9 AS INT) AS page, concat(CASE WHEN c_custkey % 2 = 0 THEN 'APPLICABLE COLOR' ELSE 'TABLE' END, chr(10), 'AB', cast(c_custkey % 10 AS STRING), ' (*) RACING BLUE ', lpad(cast(c_custkey % 10000 AS STRING), 4, '0'), chr(10), 'XY1 BOLT FLANGE 1234') AS text FROM customer"""

DOC_IMAGES = """SELECT doc_id AS image_id, cast(doc_id % 8 AS INT) AS doc_id, cast(floor(doc_id / 8.0) AS INT) % 40 + 1 AS page, concat(CASE WHEN doc_id % 9 = 0 THEN 'YAM_OLD_bike' WHEN doc_id % 5 = 0 THEN 'YAM_OLD_img' ELSE 'img' END, cast(doc_id % 50 AS STRING)) AS filename,
 cast(40 + (doc_id * 37) % 900 AS INT) AS width, cast(40 + (doc_id * 53) % 700 AS INT) AS height, lang, text AS payload, n_chars AS size_bytes FROM documents"""

NAMED_FILES = """SELECT doc_id AS file_id, doc_id % 60 AS bundle, concat(CASE doc_id % 7 WHEN 0 THEN 'a' WHEN 1 THEN 'A' WHEN 2 THEN 'a_1' WHEN 3 THEN 'img' WHEN 4 THEN 'a_1_1' WHEN 5 THEN lang ELSE source END,
 CASE WHEN doc_id % 5 = 0 THEN '' WHEN doc_id % 3 = 0 THEN '.PNG' ELSE '.jpeg' END) AS filename, concat('Parts_', CASE WHEN doc_id % 4 = 0 THEN source WHEN doc_id % 4 = 1 THEN concat(source, '_1') ELSE 'LONG NAME OF A MODEL OF MANY WORDS' END) AS title FROM documents"""

PAGE_FIGURES = "SELECT DISTINCT doc_id, page, cast(cast(page / 2 AS INT) AS STRING) AS fig_no, concat('FIGURE ', cast(cast(page / 2 AS INT) AS STRING)) AS fig_name FROM doc_images WHERE page % 2 = 0"

JOB_EVENTS = """SELECT event_id, user_id AS job_id, ts, CASE event_type WHEN 'signup' THEN 'pending' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'error' ELSE 'processing' END AS status, cast(floor(value / 25.0) AS INT) AS page FROM events"""

CART_EVENTS = """SELECT l_orderkey AS cart_id, l_partkey % 7 AS part_no, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS seq,
 CASE WHEN l_linenumber % 5 = 4 THEN -1 ELSE 1 END AS delta, CASE WHEN l_partkey % 6 = 0 THEN '' ELSE p_name END AS description, CASE WHEN l_partkey % 3 = 0 THEN 0 ELSE p_retailprice END AS mrp, CASE WHEN l_partkey % 9 = 0 THEN 0 ELSE p_size * 5 END AS dealer_price,
 CASE WHEN l_partkey % 4 = 0 THEN 0 WHEN l_partkey % 5 = 0 THEN 12.4 ELSE 18 END AS gst_rate, cast(l_linenumber AS STRING) AS ref_no, cast(l_orderkey % 50 AS STRING) AS fig_no, p_brand AS fig_name FROM lineitem JOIN part ON l_partkey = p_partkey"""

PIXELS = "SELECT cast(l_orderkey % 64 AS INT) AS image_id, cast(l_partkey % 256 AS INT) AS r, cast((l_partkey * 3 + l_orderkey % 64 * 5) % 256 AS INT) AS g, cast((l_suppkey * 7 + l_linenumber) % 256 AS INT) AS b FROM lineitem"

# Images of every mode as bytes: sizes about the thumbnails', gradients, dark, pale and grey ones; alpha of 0, 128, 255 and between.
RASTER_SIZES = "SELECT s_suppkey AS image_id, cast(s_suppkey % 1000 AS BIGINT) AS k, CASE s_suppkey % 10 WHEN 7 THEN 500 WHEN 4 THEN 120 WHEN 5 THEN 119 ELSE 30 + s_suppkey * 37 % 300 END AS width, CASE s_suppkey % 10 WHEN 7 THEN 490 WHEN 4 THEN 120 WHEN 5 THEN 80 ELSE 20 + s_suppkey * 53 % 200 END AS height, CASE s_suppkey % 5 WHEN 0 THEN 'RGB' WHEN 1 THEN 'RGBA' WHEN 2 THEN 'RGB' WHEN 3 THEN 'LA' ELSE CASE WHEN s_suppkey % 2 = 0 THEN 'L' ELSE '1' END END AS mode FROM supplier"
_TONE = "CASE k % 4 WHEN 1 THEN ({v}) % 60 WHEN 2 THEN 235 + ({v}) % 21 ELSE ({v}) % 256 END"
TONES = {
    "r": _TONE.format(v="{x} * (1 + k % 3) + {y} * 2 + k * 13"),
    "g": _TONE.format(v="{x} * (1 + k % 3) + {y} * (2 + k % 5 % 2 * 3) + k * 13 + k % 3 * 40"),
    "b": _TONE.format(v="{x} * (1 + k % 3) + {y} * (2 + k % 2 * 4) + k * 13"),
    "a": "CASE ({x} + {y}) % 4 WHEN 0 THEN 0 WHEN 1 THEN 128 WHEN 2 THEN 255 ELSE ({x} * 3 + {y}) % 256 END",
}

RASTER_TASKS = 192  # shares of the images; a number that is given is kept where small shares would be put together
RASTERS_HELD = 16  # images of an Arrow batch


def _read(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names}


def _sql(spark: SparkSession, query: str, **frames: DataFrame) -> DataFrame:
    for name in frames:
        for lead in ("FROM", "JOIN"):
            query = query.replace(f"{lead} {name} ", f"{lead} {{{name}}} ").replace(f"{lead} {name}\n", f"{lead} {{{name}}}\n").replace(f"{lead} {name},", f"{lead} {{{name}}},").replace(f"{lead} {name})", f"{lead} {{{name}}})")
            if query.endswith(f"{lead} {name}"):
                query = query[: -len(name)] + f"{{{name}}}"
    return spark.sql(query, **frames)


DOCUMENT = "cast(floor(l.l_orderkey / 512.0) AS INT)"


def cat_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CAT_ROWS, left partitioned by doc_id: it is a column before the numbering, so later windows of a document or page need no exchange."""
    own = _read(spark, sf_dir, "lineitem", "orders", "part")
    own["lineitem"] = own["lineitem"].withColumn("doc_id", F.shiftright("l_orderkey", 9).cast("int"))  # floor by 512
    return _sql(spark, CAT_ROWS.replace(DOCUMENT, "l.doc_id"), **own)


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaned(cat_rows(spark, sf_dir))


def cleaned(rows: DataFrame) -> DataFrame:
    """cat_rows cleaned, quantities as a map of the models BGP1 and BGP2."""
    qty = F.create_map(F.lit("BGP1"), "qty1", F.lit("BGP2"), "qty2")
    return rows.select("doc_id", "row_seq", "page", "fig_no", "fig_name", "ref_no", clean_part_number("part_no").alias("part_no"), clean_description("description").alias("description"), clean_remarks("remarks").alias("remarks"), qty.alias("qty"))


# top, x0 and text of a page's heading and of a row's words; k tenths are added to a row's top.
HEADING = [(20.0, 50.0, "FIG."), (20.0, 80.0, "$NO"), (20.0, 110.0, "$NAME"), (75.0, 50.0, "REF."), (75.0, 120.0, "PART"), (75.0, 150.0, "NO."), (75.0, 240.0, "DESCRIPTION"), (75.0, 640.0, "REMARKS"), *[(50.0 + 8 * i, x, t) for x, n in ((520.0, "1"), (560.0, "2")) for i, t in enumerate((n, "P", "G", "B"))], (565.0, 420.0, "7")]
ROW_WORDS = [(1, 120.0, "part_no"), (2, 240.0, "split_part(description, ' ', 1)"), (3, 320.0, "split_part(description, ' ', 2)"), (4, 400.0, "split_part(description, ' ', 3)"), (0, 520.0, "qty1"), (0, 560.0, "qty2"), (0, 640.0, "split_part(remarks, ' ', 1)"), (0, 680.0, "split_part(remarks, ' ', 2)"), (0, 720.0, "split_part(remarks, ' ', 3)")]


def _word(top: Column, x0: float, text: Column, width: int = 6) -> Column:
    return F.when(text != "", F.struct(top.cast("double").alias("top"), F.lit(x0).alias("x0"), F.lit(width).alias("w"), text.alias("text")))


def _words(rows: DataFrame, words: Column, *more: Column) -> DataFrame:
    own = rows.select("doc_id", "page", *more, F.explode(words).alias("w")).filter("w is not null")
    return own.select("doc_id", "page", *[c for c in own.columns if c not in ("doc_id", "page", "w")], "w.*").withColumn("x1", F.col("x0") + F.col("w") * F.length("text")).drop("w")


def page_words(rows: DataFrame) -> DataFrame:
    """CAT_WORDS in one pass over the rows, in place of a scan for each column: a heading's words go with the first row of its figure on the page."""
    of_page, of_figure = (Window.partitionBy("doc_id", "page", *more).orderBy("row_seq") for more in ((), ("fig_no", "fig_name")))
    before = F.lag("ref_no").over(of_page)
    own = rows.withColumns({"rn": F.row_number().over(of_page), "__new": before.isNull() | (before != F.col("ref_no"))}).withColumn("__head", F.row_number().over(of_figure) == 1)
    top = lambda k: (1000 + 160 * F.col("rn") + 3 * ((F.col("row_seq") + k) % 5)) / F.lit(10.0)  # noqa: E731  tenths, so that the quotient is the nearest double
    said = {"$NO": F.col("fig_no"), "$NAME": F.col("fig_name")}
    heading = F.when(F.col("__head"), F.array(*[_word(F.lit(y), x, said.get(t, F.lit(t))) for y, x, t in HEADING])).otherwise(F.array())
    row = F.array(F.when(F.col("__new"), _word(top(0), 50.0, F.col("ref_no"))), *[_word(top(k), x, F.expr(t)) for k, x, t in ROW_WORDS])
    kinds = F.array(F.struct(F.lit("row").alias("kind"), row.alias("words")), F.struct(F.lit("head").alias("kind"), heading.alias("words")))
    own = own.select("doc_id", "page", F.explode(kinds).alias("k")).select("doc_id", "page", "k.kind", "k.words")
    out = _words(own, F.col("words"), F.col("kind"))
    return out.select("doc_id", "page", "kind", "top", (F.col("top") + 7).alias("bottom"), "x0", "x1", "text")


def ruled_words(b: DataFrame) -> DataFrame:
    """RULED_WORDS in one pass over rows with y."""
    own = b.withColumn("__head", F.row_number().over(Window.partitionBy("doc_id", "page", "fig_name").orderBy("row_seq")) == 1)
    title = [_word(F.lit(20.0), x, t) for x, t in ((50.0, F.lit("TABLE")), (90.0, F.lit("7")), (110.0, F.col("fig_name")))]
    labels = [_word(F.lit(60.0), x, F.lit(t), 3 if x == 600.0 else 6) for x, t in ((600.0, "REF."), (640.0, "NAME"), (910.0, "PART"), (945.0, "NO."), (1015.0, "QTY"), (1060.0, "REMARKS"))]
    head = [F.when(F.col("__head") & (F.col("page") % 10 == 2), w) for w in title] + [F.when(F.col("__head"), w) for w in labels]
    texts = ((600.0, "ref_no"), (640.0, "description"), (910.0, "substr(part_no, 1, 4)"), (940.0, "substr(part_no, 5)"), (1015.0, "qty1"), (1060.0, "remarks"))
    out = _words(own, F.array(*head, *[_word(F.col("y"), x, F.expr(t), 3 if x == 600.0 else 6) for x, t in texts]))
    return out.select("doc_id", "page", "top", (F.col("top") + 7).alias("bottom"), "x0", "x1", "text")


def cat_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_words(cat_rows(spark, sf_dir))


def cat_words_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return band_words(cat_rows(spark, sf_dir))


def band_words(rows: DataFrame) -> DataFrame:
    """CAT_WORDS_B in one pass over the rows. They are partitioned by page, and so are their words, that joins of pages exchange rows and no words."""
    own = rows.withColumn("y", 90.0 + 20 * F.row_number().over(Window.partitionBy("doc_id", "page").orderBy("row_seq")))
    ref = F.when(F.col("row_seq") % 4 != 0, _word(F.col("y"), 600.0, F.col("ref_no")))
    words = F.array(ref, *[_word(F.col("y"), x, F.col(c)) for x, c in ((640.0, "description"), (910.0, "part_no"), (1015.0, "qty1"), (1060.0, "remarks"))])
    return _words(own, words).select("doc_id", "page", "top", "x0", "x1", "text")


def cat_mixed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """words, pages, rulings and info of catalogues with pages of every kind, by the last digit of the page's number.

    2 and 7 are ruled (7 without a title), 4 has no heading, 5 is an index page, 9 has no
    table header. Every fourth reference is left out. Two documents of three have a
    code, one of these an anagram of a column's name.
    """
    rows = cut(cat_rows(spark, sf_dir)).withColumn("ref_no", F.when(F.col("row_seq") % 4 == 0, "").otherwise(F.col("ref_no")))
    kind, ruled = F.col("page") % 10, (F.col("page") % 10).isin(2, 7)
    own = page_words(rows.filter(~ruled)).drop("kind")
    own = own.filter(~((kind == 4) & (F.col("top") == 20)) & ~((kind == 9) & (F.col("text") == "DESCRIPTION")))
    number = F.row_number().over(Window.partitionBy("doc_id", "page").orderBy("row_seq"))
    b = rows.filter(ruled).withColumn("y", 70 + 20 * number)
    every = rows.select("doc_id", "page").distinct()  # every row has a word, its part number
    index = every.filter(kind == 5).select("doc_id", "page", *[F.lit(v).alias(c) for c, v in (("top", 10.0), ("bottom", 17.0), ("x0", 300.0), ("x1", 390.0))], F.lit("NUMERICAL INDEX").alias("text"))
    words = own.unionByName(ruled_words(b)).unionByName(index)
    pages = every.select("doc_id", "page", F.when(ruled, 1190.0).otherwise(842.0).alias("page_w"), F.when(ruled, 842.0).otherwise(595.0).alias("page_h"))
    tops = F.explode(F.concat(F.array(F.lit(50.0)), F.transform(F.sequence(F.lit(0), F.col("n")), lambda k: (80 + 20 * k).cast("double"))))
    lines = b.groupBy("doc_id", "page").agg(F.count("*").cast("int").alias("n")).select("doc_id", "page", F.lit(590.0).alias("x0"), tops.alias("top"))
    k = F.col("doc_id") % 3
    info = rows.select("doc_id").distinct().select("doc_id", F.when(k == 0, "R15 V4").otherwise("").alias("name"), F.when(k == 0, "BGP1").when(k == 1, "PGB1").otherwise("").alias("code"))
    return words, pages, lines.withColumn("bottom", F.col("top")), info


def rulings(words: DataFrame) -> DataFrame:
    """Horizontal lines ten points above and below each row of format B."""
    return words.select("doc_id", "page", F.explode(F.array(F.col("top") - 10, F.col("top") + 10)).alias("top")).distinct()


def color_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, COLOR_PAGES, **_read(spark, sf_dir, "customer"))


def page_sizes(words: DataFrame) -> DataFrame:
    return words.select("doc_id", "page").distinct().select("doc_id", "page", F.lit(842.0).alias("page_w"), F.lit(595.0).alias("page_h"))


def doc_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, DOC_IMAGES, **_read(spark, sf_dir, "documents"))


def named_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, NAMED_FILES, **_read(spark, sf_dir, "documents"))


def page_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, PAGE_FIGURES, doc_images=doc_images(spark, sf_dir))


def job_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, JOB_EVENTS, **_read(spark, sf_dir, "events"))


def job_event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return _sql(spark, JOB_EVENTS, events=spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*"))


def cart_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, CART_EVENTS, **_read(spark, sf_dir, "lineitem", "part"))


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, PIXELS, **_read(spark, sf_dir, "lineitem"))


def _raster_bytes(k: int | None, width: int | None, height: int | None, mode: str) -> bytes | None:
    """The bytes of TONES over one image, rows of pixels; null without a size."""
    if None in (k, width, height) or min(width, height) < 1:
        return None
    y, x = np.divmod(np.arange(width * height, dtype=np.int64), width)

    def tone(v: np.ndarray) -> np.ndarray:
        return v % 60 if k % 4 == 1 else 235 + v % 21 if k % 4 == 2 else v % 256

    across = x * (1 + k % 3)
    planes = [tone(across + y * 2 + k * 13)]
    if mode == "1":
        planes = [np.where(planes[0] > 127, 255, 0)]
    if mode in ("RGB", "RGBA"):
        planes += [tone(across + y * (2 + k % 5 % 2 * 3) + k * 13 + k % 3 * 40), tone(across + y * (2 + k % 2 * 4) + k * 13)]
    if mode in ("LA", "RGBA"):
        planes.append(np.choose((x + y) % 4, [np.int64(0), np.int64(128), np.int64(255), (x * 3 + y) % 256]))
    return np.stack(planes, axis=1).astype(np.uint8).tobytes()


def rasters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RASTER_SIZES with their bytes. One short row a supplier is dealt out by key, for its image is large; images go on a few at a time."""
    schema = "image_id long, width long, height long, mode string, raster binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, RASTERS_HELD):
                own = batch.slice(at, RASTERS_HELD)
                made = [_raster_bytes(*(own.column(c)[i].as_py() for c in ("k", "width", "height", "mode"))) for i in range(own.num_rows)]
                yield pa.RecordBatch.from_arrays([*[own.column(c) for c in ("image_id", "width", "height", "mode")], pa.array(made, pa.binary())], names=["image_id", "width", "height", "mode", "raster"])

    sizes = _sql(spark, RASTER_SIZES, **_read(spark, sf_dir, "supplier"))
    sizes = sizes.select("k", *[F.col(c).cast("long") for c in ("image_id", "width", "height")], "mode")
    return sizes.repartition(RASTER_TASKS, "image_id").mapInArrow(run, schema)
