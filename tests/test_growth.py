"""What keeps the queries' figures from growing faster than their tables."""

from pyspark.sql import functions as F

from partmill.operators import geometry, images, parts, quality
from partmill.plans import tables
from partmill.plans.queries import QUERIES

D = "/root/testdata/sf0.001"


def optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def executed(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_search_computes_each_text_once(spark):
    """A filter shares no common parts: a rule that names its value thrice, twice over, ran its patterns nine times."""
    rows = spark.read.parquet(f"{D}/part.parquet").select(F.col("p_name").alias("part_no"), *[F.lit("x").alias(c) for c in ("description", "ref_no", "fig_no", "fig_name", "remarks")])
    assert optimized(quality.search_table(rows, "896")).count("regexp_replace") == 1
    cleaned = rows.withColumn("part_no", quality.clean_part_number("part_no"))
    assert optimized(quality.search_table(cleaned, "896").select("ref_no")).count("regexp_replace") == 2


def test_a_search_finds_what_it_found(spark):
    own = spark.createDataFrame([(1, "12-8.96", None), (2, None, "a 896"), (3, "8 9 6", "UR"), (4, "89-7", None), (5, None, None), (6, "1234567890123 896", "")], "k int, part_no string, remarks string")
    own = own.select("*", *[F.lit(None).cast("string").alias(c) for c in ("description", "ref_no", "fig_no", "fig_name")])
    assert sorted(r.k for r in quality.search_table(own, " 896 ").collect()) == [1, 2, 3, 6]
    assert sorted(r.k for r in quality.search_table(own, "").collect()) == [1, 2, 3, 4, 5, 6]


def test_codes_are_reconciled_in_the_row(spark):
    """Quantities that meet are folded without an exchange of rows; a null or empty map stays."""
    df = spark.createDataFrame([(1, 1, {"PG": "-", "BG": "0", "GB": "4", "XYZ": "5"}), (1, 2, {"PG": None, "MODEL": ""}), (1, 3, {}), (1, 4, None), (2, 1, {"BG": "3"})], "doc_id int, row_seq int, qty map<string,string>")
    got = parts.reconcile_model_codes(df, spark.createDataFrame([(1, "bgp1")], "doc_id int, code string"))
    assert {(r.doc_id, r.row_seq): r.qty for r in got.collect()} == {(1, 1): {"BGP1": "4", "XYZ": "5"}, (1, 2): {"BGP1": ""}, (1, 3): {}, (1, 4): None, (2, 1): {"BG": "3"}}
    assert executed(QUERIES["u4_reconcile"](spark, D)).count("lineitem.parquet") == 2  # rows and the documents of their codes


def test_images_meet_one_box_a_rule(spark):
    """No join is on the page alone, where images times boxes of a page grow with the square; the first box by ordinal counts."""
    of = "doc_id int, page int, image_id long, filename string, width int, height int"
    pics = spark.createDataFrame([(1, 1, 1, "a.png", 5, 5), (1, 1, 2, "b", 7, 8), (1, 1, 3, "", None, 8), (1, 1, 4, "z", 0, 0), (None, 1, 5, "a", 5, 5)], of)
    boxes = spark.createDataFrame([(1, 1, "A", 7, 8, 3, 3.0), (1, 1, "a.jp2", 9, 9, 2, 2.0), (1, 1, "a", 9, 9, 1, 1.0), (1, 1, "", 7, 8, 9, 9.0)], "doc_id int, page int, name string, width int, height int, ordinal int, x1 double").selectExpr("*", "0d x0", "0d top", "0d bottom")
    own = images.match_placement(pics, boxes)
    joins = [line for line in optimized(own).split("\n") if "Join " in line]
    assert joins and all(line.count(" = ") >= 3 for line in joins)
    assert {r.image_id: (r.box and r.box.x1, r.rule) for r in own.collect()} == {1: (1.0, 1), 2: (3.0, 2), 3: (3.0, 3), 4: (None, None), 5: (None, None)}


def test_row_edits_and_bands_read_the_rows_from_a_file(spark):
    """Orders and lines are joined once, not for each of the tables that are made of them."""
    for name in ("f20_row_edits", "j7_w13_w14_x18_format_b"):
        assert "lineitem.parquet" not in executed(QUERIES[name](spark, D))


def test_words_are_gathered_once_and_neither_written_nor_exchanged_again(spark, monkeypatch):
    """Pages are read in one pass over the words; what is written is a row a page or a row of parts, without the words' boxes."""
    seen, cut = [], geometry.cut
    monkeypatch.setattr(geometry, "cut", lambda df: seen.append(df) or cut(df))
    rows = tables.cat_rows(spark, D).repartition(4, "doc_id", "page")
    geometry.extract_parts(tables.page_words(rows), tables.page_sizes(rows))
    assert ["lineitem.parquet" in executed(df) for df in seen] == [True] + [False] * (len(seen) - 1)
    assert not any({"words", "top", "x0"} & set(df.columns) for df in seen) and "bottom" not in seen[0].schema.simpleString().replace("header_bottom", "")
    assert "Exchange" not in executed(seen[0]).split("ObjectHashAggregate")[0].split("SortMergeJoin")[-1]


def test_mixed_catalogues_read_the_rows_from_a_file(spark):
    """Words, pages, rulings and covers join lines, orders and parts once; pages are found without making words."""
    own = tables.cat_mixed(spark, D)
    assert not any("lineitem.parquet" in executed(df) for df in own) and "explode" not in executed(own[1])


def test_flag_edits_read_the_rows_from_a_file(spark):
    assert "lineitem.parquet" not in executed(QUERIES["j9_flag_edits"](spark, D))


def test_a_deep_page_gets_the_columns_that_are_shown(spark, monkeypatch):
    seen, deep_page = [], quality.deep_page
    monkeypatch.setattr(quality, "deep_page", lambda df, *args: seen.append(df.columns) or deep_page(df, *args))
    assert sorted(QUERIES["o2_deep_page"](spark, D).columns) == sorted(seen[0]) == ["description", "doc_id", "row_seq"]
