"""Source divergence audit: which terms set a source apart from its language, and how far sources lie from each other.

Strings are materialised late. Each task counts the terms of its documents by a
fixed-width digest and writes the counts, and beside them one row with the string of
each term it met. Counting shuffles digests alone. For digests that are kept, the
smallest and the largest string are taken from the written rows: where they differ,
the digest is shared by several terms, and a second pass over the documents
counts those by string. Texts of terms are joined to kept outputs only.

A pair of sources is summed without a row for each term and pair: terms that only
one of the two has enter as a histogram of their probabilities, terms of both are
paired inside a task and leave it as sums for each pair.

All arithmetic is on whole numbers. A term's probability in a group is
p = 1 + floor(UNIT * (count + 1) / (N + V)), N the group's count of kept terms, V
their number in the language. The divergence of p from q is floor((p - q)^2 / q).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from partmill.llm.common import few, pieces, ship, table, text_bytes, written

UNIT = 1_000_000_000
LEAST_DOCS = 3
TOP = 200
DIGEST_BITS = 64
HELD = 1_500_000  # counts that a task holds before it sends them on
PAIRS = 2_000_000  # pairs of sources summed at once in a task
BLOCK = 50_000  # rows of terms of which a task makes pairs at once, or one term's

_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms(text: bytes, most: int = 1 << 20) -> Iterator[list[bytes]]:
    """Runs of letters and of code points over 127, A-Z in lower case, in lists from some `most` bytes each."""
    text, k = text.translate(_LETTERS), 0
    while True:
        end = text.find(b" ", k + most)
        yield text[k : end if end >= 0 else len(text)].split()
        if end < 0:
            return
        k = end


class Numbered(dict):
    """Keys by order of appearance, from 0."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


def term_counts(docs: DataFrame, bits: int = DIGEST_BITS, named: bool = False) -> DataFrame:
    """lang, source, digest (the low `bits` of XXH64), term, n, docs: counts of one task's documents, so a term comes several times.

    Counts have a term only if they are to be `named`; each term that a task met has
    a row with its digest and no counts.
    """
    out = pa.schema([("lang", pa.string()), ("source", pa.string()), ("digest", pa.int64()), ("term", pa.binary()), ("n", pa.int64()), ("docs", pa.int64())])
    mask, low = (1 << bits) - 1, np.int64((1 << 32) - 1)

    def summed(parts: list[tuple]) -> tuple:
        key, n, docs_of = map(np.concatenate, zip(*parts))
        order = np.argsort(key, kind="stable")
        key = key[order]
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        return key[starts], np.add.reduceat(n[order], starts), np.add.reduceat(docs_of[order], starts)

    def sent(ids: Numbered, groups: Numbered, held: list[tuple]) -> Iterator[pa.RecordBatch]:
        if not ids:
            return
        words = pa.array(ids, pa.binary())
        digest = np.fromiter((xxhash.xxh64_intdigest(w) & mask for w in ids), np.uint64, len(ids)).view(np.int64)
        langs, sources = (pa.array(list(c), pa.string()) for c in zip(*groups))
        key, n, docs_of = summed(held)
        for k in range(0, len(key), 100_000):
            group, word = key[k : k + 100_000] >> 32, key[k : k + 100_000] & low
            terms_of = words.take(pa.array(word)) if named else pa.nulls(len(word), pa.binary())
            yield pa.RecordBatch.from_arrays([langs.take(pa.array(group)), sources.take(pa.array(group)), pa.array(digest[word]), terms_of, pa.array(n[k : k + 100_000]), pa.array(docs_of[k : k + 100_000])], schema=out)
        for k in range(0, len(words), 100_000):
            part = words.slice(k, 100_000)
            none = [pa.nulls(len(part), t) for t in (pa.string(), pa.string(), pa.int64(), pa.int64())]
            yield pa.RecordBatch.from_arrays([*none[:2], pa.array(digest[k : k + 100_000]), part, *none[2:]], schema=out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, groups, held = Numbered(), Numbered(), []
        for batch in batches:
            for b in pieces(batch):
                found = [np.concatenate([np.fromiter(map(ids.__getitem__, words), np.int64, len(words)) for words in terms(text.as_py())]) for text in b.column(2)]
                doc = np.repeat(np.arange(len(found)), [len(x) for x in found])
                key, n = np.unique(np.concatenate(found) | doc << 32, return_counts=True)
                group = np.fromiter(map(groups.__getitem__, zip(b.column(0).to_pylist(), b.column(1).to_pylist())), np.int64, b.num_rows)
                if len(key):
                    held.append(summed([(group[key >> 32] << 32 | key & low, n, np.ones(len(n), np.int64))]))
                if sum(len(x[0]) for x in held) > HELD:
                    held = [summed(held)]
                    if len(held[0][0]) > HELD // 2:
                        yield from sent(ids, groups, held)
                        ids, groups, held = Numbered(), Numbered(), []
        yield from sent(ids, groups, held)

    own = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), text_bytes().alias("text"))
    return own.mapInArrow(run, "lang string, source string, digest long, term binary, n long, docs long")


def whole_part(count: str, whole: str, kept: str) -> Column:
    """1 + floor(UNIT * (count + 1) / (whole + kept)) in whole numbers of any size; null where nothing is kept."""
    return F.expr(f"if({whole} + {kept} > 0, 1L + cast({UNIT} as decimal(10,0)) * cast({count} + 1 as decimal(20,0)) div cast({whole} + {kept} as decimal(20,0)), null)")


def divergence(p: str, q: str, times: str = "1L") -> Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div {q} * {times}")


def often(counts: DataFrame, term: list[str], least_docs: int) -> DataFrame:
    """`counts` of the terms in `least_docs` documents of their language, with total (n in the language) and lead (one row of each term)."""
    all_of = Window.partitionBy(*term)
    own = counts.withColumn("total", F.sum("n").over(all_of)).withColumn("__docs", F.sum("docs").over(all_of)).withColumn("__first", F.min("source").over(all_of))
    return own.filter(F.col("__docs") >= least_docs).withColumn("lead", F.col("source") == F.col("__first")).drop("docs", "__docs", "__first")


class Audit:
    """The tables of an audit, each written once.

    kept: lang, source, digest, part ('' or the term itself where a digest is
    shared), n, total (of the language), lead of the kept terms that a group has;
    groups: lang, source, own (N), terms (kept terms that occur), v, whole (N of
    the language), p0 (probability of a term that doesn't occur);
    names: digest, term of kept digests that one term has.
    """

    def __init__(self, docs: DataFrame, least_docs: int = LEAST_DOCS, bits: int = DIGEST_BITS):
        ship(docs.sparkSession)
        met = written(term_counts(docs, bits))
        by_digest = met.filter("n is not null").repartition("lang", "digest").groupBy("lang", "source", "digest").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
        kept = written(often(by_digest, ["lang", "digest"], least_docs))
        ends = met.filter("n is null").join(few(kept.select("digest").distinct()), "digest", "left_semi").groupBy("digest").agg(F.min("term").alias("least"), F.max("term").alias("most"))
        ends = written(ends)
        self.names = ends.filter("least = most").select("digest", F.col("least").cast("string").alias("term"))
        kept, shared = kept.withColumn("part", F.lit("")), written(ends.filter("least <> most").select("digest"))
        if not shared.isEmpty():  # documents are read again, for their terms alone
            counts = term_counts(docs, bits, named=True).filter("n is not null").join(few(shared), "digest", "left_semi")
            split = counts.groupBy("lang", "source", "digest", F.col("term").cast("string").alias("part")).agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
            alone = kept.join(few(shared), "digest", "left_anti")
            kept = written(alone.unionByName(often(split, ["lang", "digest", "part"], least_docs)))
        self.kept = kept
        known = self.kept.groupBy("lang", "source").agg(F.sum("n").alias("own"), F.count("*").alias("terms"))
        langs = self.kept.groupBy("lang").agg(F.sum(F.col("lead").cast("long")).alias("v"), F.sum("n").alias("whole"))
        groups = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source")).distinct()
        groups = groups.join(known, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0)
        self.groups = written(groups.withColumn("p0", whole_part("0L", "own", "v")))

    def apart(self, top: int = TOP) -> DataFrame:
        """lang, source, item, value, rank: terms more probable in the source than in its language."""
        own = self.kept.join(few(self.groups), ["lang", "source"])
        own = own.select("lang", "source", "digest", "part", whole_part("n", "own", "v").alias("p"), whole_part("total", "whole", "v").alias("q")).filter("p > q")
        own = own.select("lang", "source", "digest", "part", divergence("p", "q").alias("value"))
        each = Window.partitionBy("lang", "source")
        near = own.withColumn("__at", F.rank().over(each.orderBy(F.desc("value")))).filter(F.col("__at") <= top).drop("__at")  # with all ties; cut before the shuffle, too
        named = near.join(self.names, "digest", "left").withColumn("item", F.when(F.col("part") == "", F.col("term")).otherwise(F.col("part")))
        return named.withColumn("rank", F.row_number().over(each.orderBy(F.desc("value"), "item"))).filter(F.col("rank") <= top).select("lang", "source", "item", "value", "rank")

    def pairs(self) -> DataFrame:
        """lang, source, item (another source of the language), value, rank."""
        groups = few(self.groups)
        g, h = (self.groups.select("lang", F.col("source").alias(c), F.col("terms").alias(f"{c}_terms"), "v", F.col("p0").alias(f"{c}_p0")) for c in ("source", "item"))
        base = g.join(few(h.drop("v")), "lang").filter("source <> item")
        base = base.select("lang", "source", "item", F.coalesce(divergence("source_p0", "item_p0", "(v - source_terms - item_terms)"), F.lit(0)).alias("value"))
        own = self.kept.join(groups, ["lang", "source"]).select("lang", "source", "digest", "part", whole_part("n", "own", "v").alias("p"), "p0")
        levels = own.groupBy("lang", "source", "p").agg(F.count("*").alias("times"))
        others = few(self.groups.select("lang", F.col("source").alias("other"), "p0"))
        both = levels.join(others, "lang").filter("source <> other")
        one = both.select("lang", "source", F.col("other").alias("item"), divergence("p", "p0", "times").alias("value"))
        two = both.select("lang", F.col("other").alias("source"), F.col("source").alias("item"), divergence("p0", "p", "times").alias("value"))
        value = base.unionByName(one).unionByName(two).unionByName(shared_terms(own)).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
        return value.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))


def shared_terms(own: DataFrame) -> DataFrame:
    """lang, source, item, value: over the terms that both have, what the histograms of each alone say too much or too little.

    own: lang, source, digest, part, p, p0. A term's rows come together; a task
    pairs them in blocks of PAIRS and sends on one sum for each pair of a block.
    """
    out = pa.schema([("lang", pa.string()), ("source", pa.string()), ("item", pa.string()), ("value", pa.int64())])

    def gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
        return (p - q) ** 2 // q

    def paired(who: np.ndarray, p: np.ndarray, p0: np.ndarray, starts: np.ndarray, width: int) -> Iterator[tuple]:
        """(who * width + who, sum) of blocks; rows of whole terms, which begin at `starts`."""
        sizes = np.diff(np.r_[starts, len(who)])
        first, size = np.repeat(starts, sizes), np.repeat(sizes, sizes)
        done, k = np.r_[0, np.cumsum(size)], 0
        while k < len(who):
            end = max(k + 1, int(np.searchsorted(done, done[k] + PAIRS, "right")) - 1)
            a = np.repeat(np.arange(k, end), size[k:end])
            b = np.arange(len(a)) - (done[k:end] - done[k]).repeat(size[k:end]) + first[a]
            a, b = a[a != b], b[a != b]
            value = gap(p[a], p[b]) - gap(p[a], p0[b]) - gap(p0[a], p[b]) + gap(p0[a], p0[b])
            key, at = np.unique(who[a] * width + who[b], return_inverse=True)
            sums = np.zeros(len(key), np.int64)
            np.add.at(sums, at, value)
            yield key, sums
            k = end

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, held = None, []

        def sent(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            """Rows of whole terms."""
            rows = rows.combine_chunks()
            both = rows.group_by(["lang", "source"], use_threads=False).aggregate([])
            at = {pair: n for n, pair in enumerate(zip(both["lang"].to_pylist(), both["source"].to_pylist()))}
            who = np.fromiter(map(at.__getitem__, zip(rows["lang"].to_pylist(), rows["source"].to_pylist())), np.int64, rows.num_rows)
            new = changes(rows)
            names = list(at)
            for key, sums in paired(who, rows["p"].to_numpy(), rows["p0"].to_numpy(), np.flatnonzero(new), len(names)):
                a, b = key // len(names), key % len(names)
                cols = [[names[x][0] for x in a], [names[x][1] for x in a], [names[x][1] for x in b], sums]
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(cols, out)], schema=out)

        def changes(rows: pa.Table) -> np.ndarray:
            """Whether a row begins a term."""
            codes = [rows["digest"].to_numpy(), *(rows[c].combine_chunks().dictionary_encode().indices.to_numpy() for c in ("lang", "part"))]
            return np.r_[True, np.any([c[1:] != c[:-1] for c in codes], axis=0)]

        for batch in batches:
            schema = schema or batch.schema
            held.append(batch)
            if sum(b.num_rows for b in held) >= BLOCK:
                rows = pa.Table.from_batches(held, schema)
                last = int(np.flatnonzero(changes(rows))[-1])  # the last term may go on
                if last:
                    yield from sent(rows.slice(0, last))
                held = rows.slice(last).to_batches()
        if held:
            yield from sent(pa.Table.from_batches(held, schema))

    own = own.select("lang", "source", "digest", "part", "p", "p0").repartition("lang", "digest", "part").sortWithinPartitions("lang", "digest", "part")
    return own.mapInArrow(run, "lang string, source string, item string, value long")


def divergences(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP, bits: int = DIGEST_BITS) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value, rank.

    Null lang, source and text are ''. Every row of `docs` is a document, so a
    repeated row counts again; other columns are not read. A group without terms
    has pairs, and no terms. An empty table gives no rows. Ties of value go by
    item, as UTF-8.
    """
    audit = Audit(docs, least_docs, bits)
    columns = ["lang", "source", "part", "item", "value", F.col("rank").cast("int").alias("rank")]
    both = [frame.withColumn("part", F.lit(name)).select(*columns) for name, frame in (("pair", audit.pairs()), ("term", audit.apart(top)))]
    return both[0].unionByName(both[1])


def op13_divergence(spark, sf_dir: str) -> DataFrame:
    return divergences(table(spark, sf_dir, "documents"))


OP13_SQL = rf"""
WITH docs AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
words AS (SELECT id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS total FROM words GROUP BY ALL HAVING count(DISTINCT id) >= {LEAST_DOCS}),
langs AS (SELECT lang, count(*) AS v, sum(total) AS whole FROM kept GROUP BY 1),
groups AS (SELECT DISTINCT lang, source FROM docs),
found AS (SELECT lang, source, term, count(*) AS n FROM words JOIN kept USING (lang, term) GROUP BY ALL),
own AS (SELECT lang, source, sum(n) AS own FROM found GROUP BY ALL),
grid AS (SELECT g.lang, g.source, k.term, coalesce(n, 0) AS n, 1 + ({UNIT}::HUGEINT * (coalesce(n, 0) + 1)) // (coalesce(own, 0) + v)::HUGEINT AS p, 1 + ({UNIT}::HUGEINT * (total + 1)) // (whole + v)::HUGEINT AS q
  FROM groups g JOIN kept k USING (lang) JOIN langs USING (lang) LEFT JOIN found f ON f.lang = g.lang AND f.source = g.source AND f.term = k.term LEFT JOIN own o ON o.lang = g.lang AND o.source = g.source),
sums AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value FROM grid a JOIN grid b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(value, 0)::BIGINT AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT lang, source, term AS item, (((p - q) * (p - q)) // q)::BIGINT AS value FROM grid WHERE n > 0 AND p > q),
ranked AS (SELECT 'pair' AS part, *, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pairs
  UNION ALL SELECT * FROM (SELECT 'term' AS part, *, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM terms) WHERE rank <= {TOP})
SELECT lang, source, part, item, value, rank::INTEGER AS rank FROM ranked
"""
