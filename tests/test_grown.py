"""Queries on tables whose keys are larger than those of the small tables."""

import duckdb
from pyspark.sql import functions as F

from partmill.operators import geometry
from partmill.plans import tables
from partmill.plans.oracle import ORACLE_SQL
from partmill.plans.queries import QUERIES

D = "/root/testdata/sf0.001"


def test_a_catalogue_may_have_the_number_of_a_nation(spark, tmp_path):
    """Document 1000 is a catalogue and stands for a nation: two rows, the nation's without pages."""
    for name, key in (("lineitem", "l_orderkey"), ("orders", "o_orderkey")):
        spark.read.parquet(f"{D}/{name}.parquet").withColumn(key, F.col(key) + 512_000).write.parquet(f"{tmp_path}/{name}.parquet")
    for name in ("part", "nation"):
        spark.read.parquet(f"{D}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    con = duckdb.connect()
    for name in ("lineitem", "orders", "part", "nation"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    got = QUERIES["a16_a18_summary"](spark, str(tmp_path))
    want = con.sql(ORACLE_SQL["a16_a18_summary"])
    assert sorted(tuple(r) for r in got.select(*want.columns).collect()) == sorted(want.fetchall())
    assert got.filter("doc_id = 1000").count() == 2


def test_words_come_from_one_scan_and_lines_are_split_once(spark):
    plan = QUERIES["s2_ocr_words"](spark, D)._jdf.queryExecution()
    assert plan.executedPlan().toString().count("lineitem.parquet") == 1
    assert plan.optimizedPlan().toString().count(" split(CASE WHEN") == 1


def test_images_are_shared_out(spark):
    """A small file of suppliers is one partition; its images, each of up to 735 KB, are not."""
    own = tables.rasters(spark, D)
    assert own.rdd.getNumPartitions() >= 100
    assert own.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] <= 5
    assert own.filter("length(raster) = width * height * case mode when 'RGB' then 3 when 'RGBA' then 4 when 'LA' then 2 else 1 end").count() == own.count()


def test_words_are_exchanged_once_for_their_lines(spark, tmp_path):
    tables.cat_words(spark, D).write.parquet(f"{tmp_path}/words")
    lines = geometry.exclude_index_pages(geometry.line_text(geometry.with_lines(spark.read.parquet(f"{tmp_path}/words"))))
    plan = lines._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1 and plan.count("Exchange hashpartitioning") == 1
    facts = geometry.line_facts(lines.limit(1)).columns
    assert "words" not in facts and "text" not in facts
