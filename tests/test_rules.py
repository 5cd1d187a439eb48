"""Text rules: what is stripped, and how often a text is computed."""

from pyspark.sql import functions as F

from partmill.functions import scalars as X


def test_all_unicode_white_space_is_stripped_without_a_regex(spark):
    spaces = [chr(i) for i in [*range(0x3100), 0xFEFF] if not 0xD800 <= i < 0xE000]
    df = spark.createDataFrame([(c + "a b" + c + c,) for c in spaces] + [(" x\n\n",), ("\n",), (None,)], "t string")
    old = F.regexp_replace(F.coalesce("t", F.lit("")), r"(?U)^\s+|\s+$", "")
    assert df.filter(X.strip("t") != old).isEmpty() and df.filter(X.strip("t") == "a b").count() == 25
    assert "regexp" not in df.select(X.strip("t"))._jdf.queryExecution().optimizedPlan().toString()


def test_names_of_figures_are_computed_once_a_column(spark):
    """A text that a rule falls back from stands outside of branches, so it is shared; names without codes and quotes alone stay as they were."""
    df = spark.createDataFrame([("YAMAHA BGP1 \"R15 V4\" Series X", ""), ('""', " "), ("", "HEAD  & x"), (None, None), ("ABCD", "A")], "name string, fig string")
    plan = df.select(X.extract_raw_model_name("name", F.col("fig"), F.lit("BGP1")).alias("x"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Series") == 1
    got = [tuple(r) for r in df.select(X.catalogue_code(F.lit("BGP1"), "fig"), X.build_model_name_record("fig", "name", "fig"), X.extract_raw_model_name("name", F.col("fig"), F.lit("BGP1"))).collect()]
    assert got == [
        ("YAM_BGP1_PARTS", 'YAMAHA MODEL YAMAHA BGP1 "R15 V4" Series X Series PARTS', "R15 V4"), ("YAM_BGP1_PARTS", "YAMAHA MODEL  Series PARTS", ""),
        ("YAM_BGP1_HEAD & X", "YAMAHA HEAD  & X Series HEAD & X", ""), ("YAM_BGP1_PARTS", "YAMAHA MODEL Series PARTS", ""), ("YAM_BGP1_A", "YAMAHA A ABCD Series A", ""),
    ]
