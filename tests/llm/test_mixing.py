import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from partmill.llm import mixing


def test_tiny_source_of_a_large_rate(spark):
    docs = spark.createDataFrame([(k, "ab", "s") for k in range(8)] + [(k, "x" * 2000, "t") for k in range(8, 16)], "doc_id long, text string, source string")
    got = {r.doc_id: r["count"] for r in mixing.mixed(docs, {"s": 1.0, "t": 0.0}).groupBy("doc_id").count().collect()}
    assert set(got) == set(range(8)) and all(850 < n < 1150 for n in got.values()) and len(set(got.values())) > 3  # a rate of 1,001


@pytest.mark.parametrize("rate", [0.01, 1.0, 5.0, 210.0, 700.0, 800.0, 5000.0])
def test_draws_invert_the_distribution(spark, rate):
    """Every draw against the cumulative probabilities by log-gamma, and the mean of many draws."""
    n = 4000
    key = F.concat(F.col("id").cast("string"), F.lit(":1"))
    table = spark.range(1).select(mixing.poisson_table(F.lit(rate)).alias("t"))
    rows = spark.range(n).crossJoin(F.broadcast(table)).select(mixing.uniform(key).alias("u"), mixing.draw(mixing.uniform(key), F.col("t")).alias("k")).collect()
    most = int(rate + 15 * rate**0.5 + 60)
    below = np.cumsum([math.exp(k * math.log(rate) - rate - math.lgamma(k + 1)) for k in range(most)])
    for r in rows:
        want = int(np.searchsorted(below, r.u))
        assert r.k == want or abs(below[min(r.k, want)] - r.u) < 1e-9
    assert abs(np.mean([r.k for r in rows]) - rate) < max(0.01 * rate, 5 * (rate / n) ** 0.5)


def test_sql_gives_the_rows(spark):
    """Hot, tiny, null and empty sources; rates far over 700."""
    rows = [(k, "x" * 3000, None, "hot", 1) for k in range(200)] + [(300, "ab", "en", "tiny", 2), (101, "c", None, None, None), (101, "c", None, None, None), (102, None, None, "none", 0), (None, "some text", "en", "hot", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(tuple(map(str, r)) for r in mixing.mixed(docs).collect())
    con = duckdb.connect()
    con.sql("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", rows)
    want = sorted(tuple(map(str, r)) for r in con.sql(mixing.OP10_SQL).fetchall())
    assert got == want and len(got) > 1000


@pytest.mark.parametrize("entries", [mixing.ENTRIES, 0])
def test_clashing_columns_stay(spark, monkeypatch, entries):
    """Also where tables are joined by a shuffle."""
    monkeypatch.setattr(mixing, "ENTRIES", entries)
    names = ["__source", "__rate", "__table", "__times", "__weight", "__Sizes", "rate"]
    rows = [(k, "x" * (k + 1), "en", "ab"[k % 2], 1, *[f"{n}{k}" for n in names]) for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names))
    got = mixing.mixed(docs)
    assert got.columns == [*docs.columns, "__copy", "__order"]
    plain = mixing.mixed(docs.drop(*names))
    own = sorted((r.doc_id, r["__copy"], r["__order"]) for r in plain.collect())
    rows = got.collect()
    assert sorted((r.doc_id, r["__copy"], r["__order"]) for r in rows) == own and len(own) > 20
    assert all(r[n] == f"{n}{r.doc_id}" for r in rows for n in names)
    assert mixing.mixed(docs.limit(0)).collect() == []
