"""Mixing sources to target weights by Poisson replication.

A source of size n (code points of its texts) with target weight w is repeated
at the mean rate w * budget / n. Each document draws u in (0, 1) from a hash of
its doc_id and the seed, and its number of copies is the inverse at u of the
Poisson distribution with that mean, so a rerun or a lost executor draws the
same. Every source has a table of its distribution; a document counts the entries
that u passes. Copies are exploded and dealt out by a hash, which shuffles them
globally.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partmill.llm.common import free_key, ship, table, written

ALPHA = 0.5
SEED = 1
ENTRIES = 1_000_000  # tables of up to so many entries in all are broadcast; more are joined by a shuffle


def uniform(key: Column) -> Column:
    """(0, 1) from the first 52 bits of the MD5 of a string, the same in any engine."""
    return (F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(2**52))


def bounds(rate: Column) -> tuple[Column, Column]:
    """Least and largest k of a table; no probability of 52 bits lies beyond."""
    spread = 12 * F.sqrt(rate) + 30
    return F.greatest(F.lit(0), F.floor(rate - spread).cast("int")), F.ceil(rate + spread).cast("int")


def poisson_table(rate: Column) -> Column:
    """first (the least k) and sums, the running sums of the weights rate ** k / k! over that of `first`.

    Weights are multiples of the first one, so neither exp(-rate) nor any of them
    leaves the range of a double: the largest is e ** 210 or so, at rates near 210.
    """
    low, high = bounds(rate)

    def step(s: Column, k: Column) -> Column:
        w = s["w"] * rate / k
        total = F.try_element_at(s["sums"], F.lit(-1)) + w
        return F.struct(F.concat(s["sums"], F.array(total)).alias("sums"), w.alias("w"))

    start = F.struct(F.array(F.lit(1.0)).alias("sums"), F.lit(1.0).alias("w"))
    sums = F.aggregate(F.sequence(low + 1, high), start, step)["sums"]
    return F.struct(low.alias("first"), sums.alias("sums"))


def draw(u: Column, table: Column) -> Column:
    """Smallest k whose cumulative probability reaches u; 0 without a table."""
    whole = F.try_element_at(table["sums"], F.lit(-1))
    below = F.transform(F.array(u * whole), lambda x: F.size(F.filter(table["sums"], lambda c: c < x)))[0]  # u is computed once
    return F.when(table.isNull(), 0).otherwise(table["first"] + below)


def source_rates(docs: DataFrame, weights: dict[str, float] | None = None, alpha: float = ALPHA, budget: float | None = None) -> DataFrame:
    """__source, __rate. Without weights a source weighs its size to the power alpha; budget: code points wanted, as many as there are by default. Sources without a weight, or without text, get rate 0."""
    size = docs.groupBy(F.coalesce("source", F.lit("")).alias("__source")).agg(F.coalesce(F.sum(F.length("text").cast("long")), F.lit(0)).cast("double").alias("__size"))
    if weights is None:
        size = size.withColumn("__weight", F.pow("__size", F.lit(alpha)))
    else:
        pick = F.create_map([F.lit(x) for kv in weights.items() for x in kv]) if weights else F.create_map().cast("map<string,double>")
        size = size.withColumn("__weight", F.coalesce(F.try_element_at(pick, F.col("__source")).cast("double"), F.lit(0.0)))
    whole = size.agg(F.sum("__weight").alias("__weights"), F.sum("__size").alias("__sizes"))
    wanted = F.lit(float(budget)) if budget is not None else F.col("__sizes")
    rate = F.when((F.col("__size") > 0) & (F.col("__weights") > 0), F.col("__weight") / F.col("__weights") * wanted / F.col("__size")).otherwise(0.0)
    return size.crossJoin(F.broadcast(whole)).select("__source", rate.alias("__rate"))  # one row of totals


def mixed(docs: DataFrame, weights: dict[str, float] | None = None, alpha: float = ALPHA, budget: float | None = None, seed: int = SEED) -> DataFrame:
    """All columns of `docs`, with __copy (1..) and __order, each row as often as its draw says, dealt out by __order and in its order within a partition.

    A null source is the source ''. A null doc_id draws like the text 'null';
    repeated rows share one draw and so come equally often. Null and empty
    texts have size 0. An empty table gives an empty result. Columns of `docs`
    named __copy or __order are replaced; no other name is reserved.
    """
    ship(docs.sparkSession)
    docs = docs.drop("__copy", "__order")
    taken = {c.lower() for c in docs.columns}
    source, sums, times = (free_key(taken, c) for c in ("__source", "__table", "__times"))
    rates = written(source_rates(docs, weights, alpha, budget).withColumn("__table", F.when(F.col("__rate") > 0, poisson_table(F.col("__rate")))))  # a row for each source
    few = (rates.agg(F.sum(F.size("__table.sums") + 1)).first()[0] or 0) <= ENTRIES
    rates = rates.select(F.col("__source").alias(source), F.col("__table").alias(sums))
    key = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(f":{seed}"))
    own = docs.withColumn(source, F.coalesce("source", F.lit("")))
    own = own.join(F.broadcast(rates) if few else rates, source)
    own = own.withColumn(times, draw(uniform(key), F.col(sums))).filter(F.col(times) > 0)
    own = own.select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col(times))).alias("__copy"))
    order = F.conv(F.substring(F.md5(F.concat(key, F.lit(":"), F.col("__copy").cast("string"))), 1, 15), 16, 10).cast("long")
    return own.withColumn("__order", order).repartition("__order").sortWithinPartitions("__order")


def op10_mixing(spark, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents")).withColumnsRenamed({"__copy": "copy", "__order": "shuffle_key"})


OP10_SQL = f"""
WITH RECURSIVE size AS (SELECT coalesce(source, '') AS s, coalesce(sum(length(text)), 0)::DOUBLE AS n FROM documents GROUP BY 1),
rates AS (SELECT s, CASE WHEN n > 0 THEN pow(n, {ALPHA}) / (SELECT sum(pow(n, {ALPHA}) ORDER BY s) FROM size) * (SELECT sum(n) FROM size) / n ELSE 0 END AS rate FROM size),
terms AS (SELECT s, rate, greatest(0, floor(rate - (12 * sqrt(rate) + 30)))::INT AS k, ceil(rate + (12 * sqrt(rate) + 30))::INT AS most, 1::DOUBLE AS w, 1::DOUBLE AS c FROM rates WHERE rate > 0
  UNION ALL SELECT s, rate, k + 1, most, w * rate / (k + 1), c + w * rate / (k + 1) FROM terms WHERE k < most),
whole AS (SELECT s, max(c) AS total FROM terms GROUP BY 1),
drawn AS (SELECT d.*, total, (('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || ':{SEED}'), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u FROM documents d LEFT JOIN whole ON s = coalesce(source, '')),
counted AS (SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, (SELECT min(k) FROM terms c WHERE c.s = coalesce(d.source, '') AND c.c >= d.u * d.total) AS times FROM drawn d)
SELECT doc_id, text, lang, source, n_chars, copy::INTEGER AS copy, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || ':{SEED}:' || copy::VARCHAR), 1, 15))::BIGINT AS shuffle_key
FROM (SELECT *, unnest(range(1, times + 1)) AS copy FROM counted WHERE times > 0)
"""
