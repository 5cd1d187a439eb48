"""Benchmark decontamination: size-partitioned MinHash containment search.

An item with m distinct five-word shingles is contained in a document if the
document has at least need = ceil(0.8 m) of them. Then the document has one of
any m - need + 1 shingles of the item, so probing documents with that many loses
nothing. An item's sketch is its bottom-k MinHash: the smallest hashes, those
that fewer items share first, so that a common phrase doesn't name every item.
Items are partitioned by size (powers of two of m); a document with fewer
shingles than the least need of a partition skips it.

Everything about items is a table: shingle hashes, sketches, needs. Documents are
probed with a Bloom filter of the sketches, whose size is fixed; what passes is
joined with the sketches by hash, and the candidates are verified by exact
containment of the shingles as text.

Words are runs between ASCII white space, case-folded, with everything but
letters and digits removed; empty ones don't count. An item of fewer than five
words is one shingle, the whole sequence; one without words matches nothing. Null
texts have no words.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from partmill.llm.common import few, free_key, mapped, ship, table, text_bytes, window_hashes, written

N = 5
LEAST = 0.8
BITS = 26  # the filter has 2 ** BITS bits, 8 MB, whatever the number of items
PROBES = 3
CHUNK = 1000  # candidates of one text that are verified at once
_OTHER = re.compile(r"[^\w \t\n\r\v\f]|_")


def cores(text: bytes) -> list[bytes]:
    """Words, case-folded, of letters and digits alone."""
    return _OTHER.sub("", text.decode("utf-8", "replace").casefold()).encode().split()


def grams(words: list[bytes], n: int = N) -> set[tuple[bytes, ...]]:
    return {tuple(words[k : k + n]) for k in range(len(words) - n + 1)}


def shingles(text: bytes) -> set[tuple[bytes, ...]]:
    """An item's shingles; those of a short one are the whole sequence."""
    words = cores(text)
    return grams(words, min(N, len(words))) if words else set()


def hashes(words: list[bytes], n: int = N) -> np.ndarray:
    return window_hashes(np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)), n)


def probes(h: np.ndarray) -> list[np.ndarray]:
    mask = np.uint64((1 << BITS) - 1)
    return [((h >> np.uint64(19 * k)) & mask).astype(np.int64) for k in range(PROBES)]


def item_shingles(items: DataFrame, least: float = LEAST) -> DataFrame:
    """item (a key of the text), n (words in a shingle), size (distinct shingles), need, h: a row for each shingle of each distinct text."""

    def run(b: pa.RecordBatch) -> dict:
        out: dict[str, list] = {"item": [], "n": [], "size": [], "need": [], "h": []}
        for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if words := cores(text):
                n = min(N, len(words))
                h = np.unique(hashes(words, n)).view(np.int64).tolist()
                for name, value in (("item", key), ("n", n), ("size", len(h)), ("need", int(np.ceil(least * len(h) - 1e-9)))):
                    out[name] += [value] * len(h)
                out["h"] += h
        return out

    own = items.filter("text is not null").select(F.md5("text").alias("item"), text_bytes()).distinct()
    return mapped(own, run, "item string, n int, size int, need int, h long")


def sketches(items: DataFrame, least: float = LEAST) -> DataFrame:
    """h, item, n, need, least_need (of the size partition): the rarest size - need + 1 shingles of each item, by hash among equals."""
    own = written(item_shingles(items, least))
    shared = own.groupBy("h").agg(F.count("*").alias("shared"))
    rank = F.row_number().over(Window.partitionBy("item").orderBy("shared", "h"))
    small = own.join(shared, "h").withColumn("rank", rank).filter("rank <= size - need + 1")
    part = F.floor(F.log2("size"))
    least_need = own.groupBy("n", part.alias("part")).agg(F.min("need").alias("least_need"))
    return written(small.withColumn("part", part).join(F.broadcast(least_need), ["n", "part"]).select("h", "item", "n", "need", "least_need"))  # 32 partitions a length at most


def bloom(own: DataFrame) -> np.ndarray:
    """The filter of all sketch hashes as bytes, each bit in the order of bitmap_construct_agg."""
    spots = [F.shiftrightunsigned("h", 19 * k).bitwiseAND((1 << BITS) - 1) + 1 for k in range(PROBES)]
    spots = own.select(F.explode(F.array(*spots)).alias("spot"))
    rows = spots.groupBy(F.bitmap_bucket_number("spot").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("spot")).alias("bits")).toArrow()
    out = np.zeros(1 << (BITS - 3), np.uint8)  # 2 ** BITS / 32768 rows of 4 KB are collected, at most
    for k, bits in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist()):
        out[(k - 1) * len(bits) : k * len(bits)] = np.frombuffer(bits, np.uint8)
    return out


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.md5("text").alias("key"), text_bytes())


def passing(docs: DataFrame, own: DataFrame) -> DataFrame:
    """key, size, n, h: the shingles of each text that pass the filter, once for each distinct text; size: its n-word windows."""
    lengths = sorted(r.n for r in own.select("n").distinct().collect())  # N at most
    given = docs.sparkSession.sparkContext.broadcast(bloom(own))

    def run(b: pa.RecordBatch) -> dict:
        bits, out = given.value, {"key": [], "size": [], "n": [], "h": []}
        for key, text in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
            words = cores(text)
            for n in lengths:
                h = hashes(words, n)
                size = len(h)
                for spot in range(PROBES):
                    at = probes(h)[spot]
                    h = h[(bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1]
                    if not len(h):
                        break
                else:
                    h = np.unique(h)
                    out["key"] += [key] * len(h)
                    out["size"] += [size] * len(h)
                    out["n"] += [n] * len(h)
                    out["h"] += h.view(np.int64).tolist()
        return out

    return written(mapped(docs, run, "key string, size long, n int, h long").distinct())


def found_items(docs: DataFrame, items: DataFrame, least: float = LEAST) -> DataFrame:
    """key, item, n_shared, n_item: the item texts that each distinct document text contains. docs: of keyed()."""
    own = sketches(items, least)
    hits = passing(docs, own).join(few(own), ["h", "n"]).filter("size >= least_need")
    chunk = F.floor((F.row_number().over(Window.partitionBy("key").orderBy("item")) - 1) / CHUNK)
    pairs = written(hits.select("key", "item").distinct().withColumn("chunk", chunk))
    texts = docs.join(few(pairs.select("key").distinct()), "key", "left_semi").dropDuplicates(["key"]).select("key", F.col(docs.columns[2]).alias("text"))
    known = items.filter("text is not null").select(F.md5("text").alias("item"), text_bytes().alias("wanted")).dropDuplicates(["item"])
    wanted = pairs.join(known, "item").groupBy("key", "chunk").agg(F.collect_list(F.struct("item", "wanted")).alias("wanted"))

    def verify(b: pa.RecordBatch) -> dict:
        out: dict[str, list] = {"key": [], "item": [], "n_shared": [], "n_item": []}
        for key, text, wanted in zip(*(b.column(k).to_pylist() for k in range(3))):
            words = cores(text)
            held: dict[int, set] = {}
            for w in wanted:
                mine = shingles(w["wanted"])
                n = len(next(iter(mine)))
                if n not in held:
                    held[n] = grams(words, n)
                shared = len(mine & held[n])
                if shared >= least * len(mine) - 1e-9:
                    for name, value in (("key", key), ("item", w["item"]), ("n_shared", shared), ("n_item", len(mine))):
                        out[name].append(value)
        return out

    return written(mapped(wanted.join(texts, "key").select("key", "text", "wanted"), verify, "key string, item string, n_shared long, n_item long"))


def contained_items(docs: DataFrame, items: DataFrame, least: float = LEAST) -> DataFrame:
    """doc_id, item_id, n_shared, n_item, containment for every row of `docs` that holds an item.

    Repeated document rows give repeated results, repeated items don't. Null
    ids stay null. Empty tables give an empty result. Other columns aren't read.
    """
    ship(docs.sparkSession)
    own = keyed(docs)
    found = found_items(own, items, least)
    names = items.filter("text is not null").select(F.md5("text").alias("item"), F.col("item_id").cast("long").alias("item_id")).distinct()
    named = found.join(names, "item").select("key", "item_id", "n_shared", "n_item", (F.col("n_shared") / F.col("n_item")).alias("containment"))
    return own.select("doc_id", "key").join(few(named), "key").drop("key")


def decontaminated(docs: DataFrame, items: DataFrame, least: float = LEAST) -> DataFrame:
    """`docs`, all columns, without the rows that hold an item.

    Null texts hold none and stay, as do rows without doc_id; repeated rows stay or
    go alike. Without items every row stays. No column name is reserved.
    """
    ship(docs.sparkSession)
    key = free_key({c.lower() for c in docs.columns}, "__key")
    gone = found_items(keyed(docs.select(F.lit(None).cast("long").alias("doc_id"), "text")), items, least).select(F.col("key").alias(key)).distinct()
    return docs.withColumn(key, F.md5("text")).join(few(gone), key, "left_anti").drop(key)


def op1_decontaminate(spark, sf_dir: str) -> DataFrame:
    return contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
