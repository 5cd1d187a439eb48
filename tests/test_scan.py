"""Running values, lifecycle and names against plain loops."""

import os
import random

import pytest
from pyspark.sql import functions as F

from partmill.operators import lifecycle, names, orders, parts, scan


@pytest.mark.parametrize("size", [1, 3, 10_000])
def test_running_values_over_chunks(spark, size):
    """Any chunk size gives the values of a loop over the group."""
    rng = random.Random(size)
    rows = [(g, k, rng.choice([None, None, f"v{k}"]), rng.randrange(3)) for g in ("a", "b", None) for k in rng.sample(range(60), 25)]
    df = spark.createDataFrame(rows, "g string, k long, v string, n int").repartition(3)
    got = scan.carried(df, ["g"], ["k"], scan.by_rows("k", size), {"last": F.col("v")}, {"above": F.col("v")}, {"sum": F.col("n")})
    want = []
    for g in ("a", "b", None):
        last, total = None, 0
        for _, k, v, n in sorted((r for r in rows if r[0] == g), key=lambda r: r[1]):
            above, total = last, total + n
            last = v if v is not None else last
            want.append((g, k, v, n, last, above, total))
    key = lambda r: (str(r[0]), r[1])
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)


def test_a_document_with_half_of_all_rows_is_many_tasks(spark, monkeypatch):
    """Runs and suffixes equal in chunks of 7 rows and in one; no window is over a document alone."""
    rows = [(1 if k % 2 else k % 9, k, 1 + k // 40, str(k // 15 % 5), "HEAD", str(k % 4), "x" if k % 30 == 0 else "") for k in range(400)]
    df = spark.createDataFrame(rows, "doc_id int, row_seq int, page int, fig_no string, fig_name string, ref_no string, remarks string")

    def run():
        own = parts.with_runs(parts.with_first_of_figure(df))
        return sorted(map(tuple, parts.with_remark_flag(parts.suffix_repeated_refs(own)).select("doc_id", "row_seq", "ref_no", "run", "run_offset", "remark_flag").collect()))

    whole = run()
    monkeypatch.setattr(scan, "CHUNK_ROWS", 7)
    assert run() == whole
    plan = parts.with_runs(df)._jdf.queryExecution().optimizedPlan().toString()
    assert all("__chunk" in w or "run_offset" in w for w in plan.split("\n") if w.strip(" :+-").startswith("Window ") and "row_seq" in w)


def test_renamed_codes_move_in_all_columns(spark):
    rows = [(1, 1, "BGP1", "BGP1", "YAMAHA BGP1 BGP1 Series HEAD", "YAM_BGP1_HEAD", "YAM_BGP1_HEAD.jpeg", {"BGP1": "3", "XYZ": "4"}), (1, 2, "PG", "", "", "", "", {"PG": "5", "PGB1": "6"}), (1, 3, "XYZ", "XYZ", "n", "c", "p", {"XYZ": "7"}), (2, 1, "MODEL", "MODEL", "YAMAHA MODEL Series A", "YAM_MODEL_A", "YAM_MODEL_A.jpeg", {"MODEL": "1"})]
    df = spark.createDataFrame(rows, "doc_id int, row_seq int, model_code string, item_group string, model_name string, catalogue_code string, pic string, qty map<string,string>").withColumn("pic_path", F.col("pic"))
    columns = spark.createDataFrame([(1, ["BGP1", "PG", "XYZ", "PGB1", "BB"]), (2, ["MODEL"]), (3, [])], "doc_id int, models array<string>")
    codes = spark.createDataFrame([(1, "pgb1"), (2, "ABCD"), (3, "DH71"), (4, "")], "doc_id int, code string")
    names_of = lifecycle.renames(columns, codes)
    assert sorted(map(tuple, names_of.collect())) == [(1, "BB", "PGB1"), (1, "BGP1", "PGB1"), (1, "PG", "PGB1"), (2, "MODEL", "ABCD")]
    got = {(r.doc_id, r.row_seq): (r.model_code, r.item_group, r.model_name, r.catalogue_code, r.pic, r.pic_path, r.qty) for r in lifecycle.renamed(df, names_of).collect()}
    assert got[1, 1] == ("PGB1", "PGB1", "YAMAHA PGB1 BGP1 Series HEAD", "YAM_PGB1_HEAD", "YAM_PGB1_HEAD.jpeg", "YAM_PGB1_HEAD.jpeg", {"PGB1": "3", "XYZ": "4"})
    assert got[1, 2] == ("PGB1", "", "", "", "", "", {"PGB1": "5"}) and got[1, 3][0] == "XYZ" and got[2, 1][2:4] == ("YAMAHA ABCD Series A", "YAM_ABCD_A")
    assert {r.doc_id: r.models for r in lifecycle.renamed_columns(columns, names_of, codes).collect()} == {1: ["PGB1", "XYZ"], 2: ["ABCD"], 3: ["DH71"], 4: []}


def loop(given, kind):
    """Names one after another, each tried until it is free."""
    taken, out = set(), []
    for name in given:
        if kind == "archive" and not name.lower().endswith(names.ENDINGS):
            name += ".jpeg"
        if kind == "sheet":
            name = name[:31]
        base, ending = os.path.splitext(name)
        own, n = name, 0
        while (own.lower() if kind == "archive" else own) in taken:
            n += 1
            own = f"{base}_{n}{ending}" if kind == "archive" else f"{name[:28]}_{n}"[:31]
        taken.add(own.lower() if kind == "archive" else own)
        out.append(own)
    return out


@pytest.mark.parametrize("kind", ["archive", "sheet"])
def test_names_are_probed_as_in_a_loop(spark, kind):
    rng = random.Random(4)
    pool = ["a", "A", "a_1", "a_1_1", "a_2", "img.png", "IMG.PNG", "img_1.png", "img.jpeg", "x.tar", "", "_1", "n" * 40, "n" * 28, "n" * 28 + "_1", "n" * 27 + "_1", "n" * 27 + "_", "n" * 26 + "_12345", "1_1", "é_01", "é_1"]
    rows = [(b, k, rng.choice(pool)) for b in range(4) for k in range(70)]
    got = names.probed(spark.createDataFrame(rows, "bundle int, k int, name string"), ["bundle"], "name", ["k"], kind).collect()
    for b in range(4):
        own = [r.name for r in sorted((r for r in got if r.bundle == b), key=lambda r: r.k)]
        assert own == loop([r[2] for r in rows if r[0] == b], kind)
        assert len({n.lower() if kind == "archive" else n for n in own}) == 70


def test_titles_without_a_free_name_are_an_error():
    with pytest.raises(ValueError):
        names.folded(["n" * 30] * 120, names.sheet_title, False)
    assert names.folded(["n" * 20] * 1200, names.sheet_title, False)[-1] == "n" * 20 + "_1199"


def test_cart_prices_and_descriptions(spark):
    schema = "cart_id int, part_no int, seq int, delta int, description string, mrp string, dealer_price double, gst_rate double, ref_no string, fig_no string, fig_name string"
    rows = [(1, 1, 1, 1, "", "0", 55.0, 0.0, " 7 ", "3", "HEAD"), (1, 1, 2, 2, "later", "9", 1.0, 5.0, "8", "4", "X"), (1, 2, 1, 1, "bolt", "x", None, 12.5, None, None, None), (1, 3, 1, 1, None, "-5", 7.0, None, "1", "1", "A")]
    lines = orders.cart_lines(spark.createDataFrame(rows, schema))
    got = {r.part_no: (r.description, r.ref_no, r.qty, r.price, r.gst) for r in lines.collect()}
    assert got == {1: ("GENUINE SPARE PART", "7", 3, 55.0, 28.0), 2: ("bolt", "", 1, 120.0, 12.5), 3: ("GENUINE SPARE PART", "1", 1, -5.0, 28.0)}
    row = {r["Part No"]: r for r in orders.quotation_lines(lines).collect()}
    assert (row["1"]["Ref No"], row["1"]["Figure"], row["1"]["Total Amount"], row["2"]["GST %"]) == ("7", "FIG. 3 - HEAD", "211.20", "12.5%")


def test_deep_pages_are_those_of_the_whole_sort(spark):
    from partmill.operators import quality

    rng = random.Random(2)
    rows = [(k % 3, k, str(rng.choice([1, 2, 30, "x", ""])), rng.choice(["", "X", "note"]), str(k % 7), rng.choice(["", "remark"]), k % 50 == 0) for k in range(300)]
    df = spark.createDataFrame(rows, "doc_id int, row_seq int, ref_no string, remark_flag string, fig_no string, remarks string, is_custom_section boolean").withColumn("fig_name", F.lit("A"))
    for field, desc in (("ref_no", False), ("ref_no", True), ("remark_flag", True)):
        whole = [(r.doc_id, r.row_seq) for r in quality.sort_parts(df, field, desc).collect()]
        for page, size in ((1, 10), (4, 70), (30, 10), (31, 10)):
            got = [(r.doc_id, r.row_seq) for r in quality.deep_page(df, field, page, size, desc).collect()]
            assert got == whole[(page - 1) * size : page * size]


def test_rows_without_a_free_title_have_null(spark):
    """A hundred rows get the title and its 99 numbers; the rest stay, without one."""
    rows = [(1, k, "n" * 30) for k in range(120)] + [(1, 120, "n" * 28), (1, 121, "other"), (2, 0, "n" * 30)]
    got = names.probed(spark.createDataFrame(rows, "bundle int, k int, name string"), ["bundle"], "name", ["k"], "sheet").collect()
    titles = {(r.bundle, r.k): r.name for r in got}
    assert titles[1, 99] == "n" * 28 + "_99" and len({titles[1, k] for k in range(100)}) == 100
    assert [titles[1, k] for k in range(100, 120)] == [None] * 20
    assert (titles[1, 120], titles[1, 121], titles[2, 0]) == ("n" * 28, "other", "n" * 30)


def test_rows_of_a_document_are_exchanged_once_for_their_runs(spark):
    """Rows that lie by document stay there: runs, blocks, suffixes and flags add no exchange of rows, only the narrow ones of the table of chunks."""
    rows = [(k % 3, k, 1 + k // 40, str(k // 15 % 5), "HEAD", str(k % 4), "x" if k % 30 == 0 else "") for k in range(400)]
    df = spark.createDataFrame(rows, "doc_id int, row_seq int, page int, fig_no string, fig_name string, ref_no string, remarks string").repartition("doc_id")
    own = parts.with_remark_flag(parts.suffix_repeated_refs(parts.with_runs(parts.with_first_of_figure(df))))
    plan = own._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 4
    assert plan.split("BroadcastExchange")[0].count("Exchange hashpartitioning") == 1


def test_blocks_of_runs_are_those_counted_later(spark, monkeypatch):
    """block made with the runs gives the references that blocks counted after them give, in chunks of 7 rows too, with custom rows and parents inside a run."""
    rows = [(1, k, 1, str(k // 15 % 5), "HEAD", str(k % 4), "", k % 6 == 0, k % 11 == 0) for k in range(200)]
    df = spark.createDataFrame(rows, "doc_id int, row_seq int, page int, fig_no string, fig_name string, ref_no string, remarks string, is_parent boolean, is_custom_section boolean")
    refs = lambda own: sorted((r.row_seq, r.ref_no, r.run, r.run_offset) for r in own.collect())
    whole = refs(parts.suffix_repeated_refs(parts.with_runs(df)))
    monkeypatch.setattr(scan, "CHUNK_ROWS", 7)
    assert refs(parts.suffix_repeated_refs(parts.with_runs(df))) == whole
    assert refs(parts.suffix_repeated_refs(parts.with_runs(df).drop("block"))) == whole
    last, run, start, want = None, 0, 0, []
    for _, k, _, no, _, _, _, parent, custom in rows:
        begins = parent if custom else last is None or last != no
        if parent or not custom:
            last = no
        run, start = (run + 1, k) if begins else (run, start)
        want.append((k, run, k - start))
    assert [(k, run, offset) for k, _, run, offset in whole] == want
