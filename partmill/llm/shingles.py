"""Near-duplicates by exact Jaccard similarity of word shingles.

Candidates are texts that share a bucket: a SimHash class of the same shingles,
or one of `BANDS` bands of `ROWS` MinHash values. At similarity 0.8 a pair shares
no band with a chance of 0.59 ** 20 = 3e-5, less above; 64 SimHash bits alone
would need a radius of about 18 of them. Texts of equal shingle sets are one
candidate. Buckets of the same members are compared once; a large one is cut
into chunks that meet pairwise. Every link is checked on the shingles, and a
bucket returns a forest of them, not all pairs: a pair is left unchecked only
where the two are in one class already.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partmill.llm.common import MIX, few, mapped, scrambled, ship, text_bytes, window_hashes, word_hashes, written
from partmill.llm.simhash import class_ids, components, fingerprint, links

BANDS, ROWS = 20, 4
CHUNK = 1024  # texts in a chunk of a bucket
CHUNK_SHINGLES = 1 << 20  # shingles in a chunk, about

_RNG = np.random.default_rng(5)
_XOR = _RNG.integers(0, 1 << 64, BANDS * ROWS, np.uint64)
_TIMES = _RNG.integers(0, 1 << 64, BANDS * ROWS, np.uint64) | np.uint64(1)


def shingles(text: bytes, n: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles; a shorter text is one shingle, a wordless one has none."""
    words = text.lower().split()
    return np.unique(window_hashes(word_hashes(words), min(n, len(words)))) if words else np.empty(0, np.uint64)


def set_id(own: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(own.tobytes(), 3)


def band_keys(own: np.ndarray) -> np.ndarray:
    """A key for each band, of its MinHash values."""
    least = np.full(BANDS * ROWS, 0xFFFFFFFFFFFFFFFF, np.uint64)
    for k in range(0, len(own), 1 << 12):
        least = np.minimum(least, ((own[k : k + (1 << 12), None] ^ _XOR) * _TIMES).min(0))
    out = np.zeros(BANDS, np.uint64)
    for row in least.reshape(ROWS, BANDS):
        out = scrambled(out * MIX + row)
    return out


def linked(sets: list[np.ndarray], tenths: int = 8) -> list[tuple[int, int]]:
    """Links (x, y) of similarity tenths / 10 or more that span each class of the sets that such links make."""
    size = np.array([len(s) for s in sets], np.int64)
    of, out = np.arange(len(sets)), []
    for v in range(len(sets)):
        if (of == of[0]).all():
            break
        fits = 10 * np.minimum(size, size[v]) >= tenths * np.maximum(size, size[v])
        fits[: v + 1] = False  # an earlier one has met v, or was of its class
        to = np.nonzero(fits & (of != of[v]) & (size > 0))[0]
        if not len(to):
            continue
        other, own = np.concatenate([sets[w] for w in to]), sets[v]
        held = own[np.minimum(np.searchsorted(own, other), len(own) - 1)] == other
        both = np.add.reduceat(held, np.concatenate([[0], np.cumsum(size[to])[:-1]]), dtype=np.int64)
        for w in to[(10 + tenths) * both >= tenths * (size[to] + size[v])].tolist():
            if of[w] != of[v]:
                out.append((w, v))
                of[of == of[w]] = of[v]
    return out


def candidates(prints: DataFrame, sets: DataFrame) -> DataFrame:
    """band, key, set, chunks: members of the buckets that are compared."""
    roots = written(components(links(prints.select("fp").distinct())))
    classes = roots.select(F.col("node").alias("fp"), "root").unionByName(roots.select(F.col("root").alias("fp"), "root").distinct())
    alike = prints.select("set", "fp", "size").distinct().join(classes, "fp").select("set", "size", F.lit(-1).alias("band"), F.col("root").alias("key")).distinct()
    members = written(sets.select("set", "size", F.posexplode("keys").alias("band", "key")).unionByName(alike))
    chunks = F.ceil(F.greatest(F.count("set") / CHUNK, F.sum("size") / CHUNK_SHINGLES)).cast("int")
    same = [F.bit_xor(F.xxhash64("set", F.lit(k))).alias(f"s{k}") for k in (0, 1)]
    buckets = members.groupBy("band", "key").agg(F.count("set").alias("n"), chunks.alias("chunks"), *same).filter("n > 1")
    buckets = buckets.groupBy("n", "chunks", "s0", "s1").agg(F.min(F.struct("band", "key")).alias("b")).select("b.*", "chunks")
    return written(members.join(buckets, ["band", "key"]).select("band", "key", "set", "chunks"))


def near_duplicates(docs: DataFrame, n: int = 5) -> DataFrame:
    """doc_id, digest (MD5 of the text, null as empty), component_id for every row of `docs`: classes of links of Jaccard similarity 0.8 or more.

    Wordless and null texts are alike. Repeated rows stay; rows that share a doc_id may
    be of different classes. Other columns are not
    read. An empty table gives an empty result. Rows without doc_id are not
    compared on behalf of a class, so leave them out.
    """
    ship(docs.sparkSession)

    def measure(b: pa.RecordBatch) -> dict:
        texts = b.column(1).to_pylist()
        own = [shingles(t, n) for t in texts]
        as_long = lambda x: np.array(x, np.uint64).view(np.int64)
        return {"doc_id": b.column(0), "digest": b.column(2), "fp": as_long([fingerprint(t, n) for t in texts]), "set": as_long([set_id(s) for s in own]), "size": [len(s) for s in own], "keys": [band_keys(s).view(np.int64) for s in own]}

    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes())
    prints = written(mapped(text.withColumn("digest", F.md5(text.columns[1])), measure, "doc_id long, digest string, fp long, set long, size long, keys array<long>"))
    sets = written(prints.groupBy("set").agg(F.min("doc_id").alias("first"), F.min("size").alias("size"), F.any_value("keys").alias("keys")))
    own = candidates(prints, sets)

    def grams(b: pa.RecordBatch) -> dict:
        sets = [shingles(t, n) for t in b.column(1).to_pylist()]
        return {"set": np.array([set_id(s) for s in sets], np.uint64).view(np.int64), "grams": [s.tobytes() for s in sets]}

    wanted = own.select("set").distinct().join(sets, "set").select(F.col("first").alias("doc_id")).distinct()
    given = mapped(text.join(wanted, "doc_id", "left_semi").select("doc_id", text.columns[1]), grams, "set long, grams binary")
    dealt = (
        own.withColumn("chunk", F.pmod(F.xxhash64("set"), F.col("chunks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .select("band", "key", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "set").join(given, "set")
    )

    def compare(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.drop_duplicates("set").sort_values("set")
        ids = group["set"].to_numpy()
        pairs = np.array(linked([np.frombuffer(g, np.uint64) for g in group["grams"]]), np.int64).reshape(-1, 2)
        return pd.DataFrame({"a": ids[pairs[:, 0]], "b": ids[pairs[:, 1]]})

    found = dealt.groupBy("band", "key", "i", "j").applyInPandas(compare, "a long, b long").distinct()
    roots = written(components(found))
    return prints.join(few(class_ids(sets, roots, "set")), "set").select("doc_id", "digest", "component_id")
