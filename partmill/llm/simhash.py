"""SimHash near-duplicates by vantage-point trees over Hamming space.

A pair within `radius` differing bits agrees, in at least one of `BANDS` bit
bands, up to radius // BANDS bits. Each band with Hamming distance is a metric
space of its own, in which that small radius makes triangle bounds sharp. Every
band gets a vantage-point tree whose leaves are the shards: a node sends a
fingerprint to its near child if its distance to the vantage point is at most
mu + r, and to its far child if it is over mu, so a pair that straddles the
boundary still meets in the near one. The top of the tree is fitted on a bounded
sample; every fingerprint is sharded. A leaf of more than `SHARD` fingerprints is
split on, by a vantage point of its own and the histogram of the distances from
it, until none is left that a distance can split. Fingerprints equal in a whole
band are cut into chunks that meet pairwise, so no task holds an unbounded group.
Inside a shard the same recursion goes on in memory and ends in exact checks on
all 64 bits. Shards return forests, not pairs: enough to keep every link's
endpoints connected.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partmill.llm.common import few, mapped, ship, table, text_bytes, written

BANDS = 3
SHARD = 8192  # fingerprints in a chunk of a shard
SAMPLE = 1 << 16  # fingerprints that the trees are fitted on, at most
LEAST = 1024  # fingerprints that are compared without another split


def band_masks(bands: int = BANDS) -> list[np.uint64]:
    cuts = [64 * k // bands for k in range(bands + 1)]
    return [np.uint64(((1 << (b - a)) - 1) << a) for a, b in zip(cuts, cuts[1:])]


def fingerprint(text: bytes, n: int = 4) -> int:
    """64-bit SimHash of the word n-grams, repeats included; 0 without words."""
    words = text.lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[k : k + n]) for k in range(max(1, len(words) - n + 1))]
    total = np.zeros(64, np.int64)
    for k in range(0, len(grams), 1 << 16):
        h = np.fromiter((xxhash.xxh64_intdigest(g, 42) for g in grams[k : k + (1 << 16)]), np.uint64)
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * total > len(grams), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, n: int = 4) -> DataFrame:
    """doc_id, fp (long) for each row; null and wordless texts have fp 0."""

    def run(b: pa.RecordBatch) -> dict:
        fps = np.array([fingerprint(t, n) for t in b.column(1).to_pylist()], np.uint64)
        return {"doc_id": b.column(0), "fp": fps.view(np.int64)}

    return mapped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes()), run, "doc_id long, fp long")


def distance(a, b, mask) -> np.ndarray:
    return np.bitwise_count((a ^ b) & mask).astype(np.int16)


def fit_tree(fps: np.ndarray, mask: np.uint64, leaves: int, r: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vantage points, mu and near children (far is the next) of a tree in arrays; a leaf has near child -1."""
    vp, mu, near = [], [], []
    rng = np.random.default_rng(7)
    todo = [(0, fps)]
    vp, mu, near = [np.uint64(0)], [0], [-1]
    stop = max(4, len(fps) // max(leaves, 1))
    while todo:
        at, own = todo.pop()
        if len(own) <= stop:
            continue
        best = None
        for v in own[rng.integers(0, len(own), 4)]:
            d = distance(own, v, mask)
            for m in {int(np.median(d)) - 1, int(np.median(d))}:
                a, b = int((d <= m + r).sum()), int((d > m).sum())
                if 0 < b < len(own) and (best is None or a * a + b * b < best[0]) and a < len(own):
                    best = (a * a + b * b, v, m, d)
        if best is None:
            continue
        _, vp[at], mu[at], d = best
        near[at] = len(vp)
        vp += [np.uint64(0)] * 2
        mu += [0, 0]
        near += [-1, -1]
        todo += [(near[at], own[d <= mu[at] + r]), (near[at] + 1, own[d > mu[at]])]
    return np.array(vp, np.uint64), np.array(mu, np.int16), np.array(near, np.int32)


def route(fps: np.ndarray, tree, mask: np.uint64, r: int) -> tuple[np.ndarray, np.ndarray]:
    """Leaves that each fingerprint goes to: positions and leaf numbers."""
    vp, mu, near = tree
    idx, node = np.arange(len(fps)), np.zeros(len(fps), np.int32)
    out_i, out_n = [], []
    while len(idx):
        leaf = near[node] < 0
        out_i.append(idx[leaf])
        out_n.append(node[leaf])
        idx, node = idx[~leaf], node[~leaf]
        d = distance(fps[idx], vp[node], mask)
        a, b = d <= mu[node] + r, d > mu[node]
        idx, node = np.concatenate([idx[a], idx[b]]), np.concatenate([near[node[a]], near[node[b]] + 1])
    return np.concatenate(out_i), np.concatenate(out_n)


class Forest:
    """Union by smallest member, with the links that made it."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, x: int, y: int) -> None:
        x, y = self.root(x), self.root(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)


def forest(fps: np.ndarray, mask: np.uint64, r: int, radius: int) -> Forest:
    """Connected classes of distinct fingerprints that link at `radius` bits and, in this band, at r."""
    found = Forest(len(fps))
    rng = np.random.default_rng(11)
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    todo = [np.arange(len(fps))]

    def link(own: np.ndarray) -> None:
        near = distance(fps[own, None], fps[None, own], full) <= radius
        near[np.diag_indices(len(own))] = False
        some = np.nonzero(near.any(0))[0]
        near, own = near[np.ix_(some, some)], own[some]
        to = np.arange(len(own))
        while len(own):  # smallest reachable position
            least = np.minimum(to, np.where(near, to, len(own)).min(1))
            least = np.minimum(least, least[least])
            if (least == to).all():
                break
            to = least
        for x, y in zip(own.tolist(), own[to].tolist()):
            found.join(x, y)

    while todo:
        own = todo.pop()
        if len(own) <= LEAST:
            link(own)
            continue
        v = own[rng.integers(0, len(own))]
        whole = distance(fps[own], fps[v], full)
        ball, rest = own[whole <= radius], own[whole > radius]
        for x in ball.tolist():  # one class through v: its pairs need no check
            found.join(int(v), x)
        if len(ball) > 1 and len(rest):  # a link from the ball leads at most to twice the radius
            edge = rest[whole[whole > radius] <= 2 * radius]
            for k in range(0, len(edge), 256):
                hit = (distance(fps[edge[k : k + 256], None], fps[None, ball], full) <= radius).any(1)
                for x in edge[k : k + 256][hit].tolist():
                    found.join(int(v), x)
        d = distance(fps[rest], fps[v], mask)
        m = int(np.median(d))
        m -= int((d <= m).sum() * 2 > 1.3 * len(d))
        near, far = rest[d <= m + r], rest[d > m]
        if len(far) == 0 or len(near) == len(rest):
            todo.append(rest)
        else:
            todo += [near, far]
    return found


def split_leaves(sharded: DataFrame, r: int) -> DataFrame:
    """fp, band, leaf with every leaf of over SHARD fingerprints split, a level of the tree a round.

    A leaf's vantage point is its fingerprint of the smallest hash; mu is the
    distance that makes the squares of both children least. Children are named by a
    hash of the leaf and the side. The rounds end when no distance leaves both
    children smaller than the leaf.
    """
    masks = F.element_at(F.array(*[F.lit(int(m.astype(np.int64))) for m in band_masks()]), F.col("band") + 1)
    for depth in range(64):
        sizes = sharded.groupBy("band", "leaf").agg(F.count("*").alias("n"), F.min_by("fp", F.xxhash64("fp", F.lit(depth))).alias("vp"))
        big = written(sizes.filter(F.col("n") > SHARD))
        if big.isEmpty():
            break
        d = F.bit_count(F.col("fp").bitwiseXOR(F.col("vp")).bitwiseAND(masks)).cast("int")
        own = sharded.join(few(big), ["band", "leaf"]).withColumn("d", d)
        spread = F.map_from_entries(F.collect_list(F.struct("d", "k")))  # 65 distances at most
        own_sizes = own.groupBy("band", "leaf", "n", "d").agg(F.count("*").alias("k")).groupBy("band", "leaf", "n").agg(spread.alias("k"))
        total = lambda keep: F.aggregate(F.map_values(F.map_filter("k", keep)), F.lit(0).cast("long"), lambda a, x: a + x)
        options = F.transform(F.sequence(F.lit(0), F.lit(64)), lambda m: F.struct(m.alias("mu"), total(lambda d, _: d <= m + r).alias("near"), total(lambda d, _: d > m).alias("far")))
        options = F.transform(options, lambda o: F.struct((o["near"] * o["near"].cast("double") + o["far"] * o["far"].cast("double")).alias("cost"), o["mu"].alias("mu"), o["near"].alias("near"), o["far"].alias("far")))
        fit = F.array_min(F.filter(options, lambda o: (o["near"] < F.col("n")) & (o["far"] < F.col("n")) & (o["far"] > 0)))
        cuts = written(own_sizes.select("band", "leaf", fit["mu"].alias("mu")))
        if cuts.filter("mu is not null").isEmpty():
            break
        named = lambda side: F.xxhash64("leaf", F.lit(side))
        near, far = F.when(F.col("d") <= F.col("mu") + r, named(0)), F.when(F.col("d") > F.col("mu"), named(1))
        split = own.join(few(cuts), ["band", "leaf"]).select("fp", "band", F.explode(F.when(F.col("mu").isNull(), F.array("leaf")).otherwise(F.array_compact(F.array(near, far)))).alias("leaf"))
        rest = sharded.join(few(big.select("band", "leaf")), ["band", "leaf"], "left_anti").select("fp", "band", "leaf")
        sharded = written(rest.unionByName(split))
    return sharded


def links(fps: DataFrame, radius: int = 4) -> DataFrame:
    """Links a, b (fingerprints, a > b as longs' order within a shard) that span every class of `fps` (distinct fp)."""
    masks, r = band_masks(), radius // BANDS
    n = fps.count()
    sample = fps.orderBy(F.xxhash64("fp")).limit(SAMPLE)
    got = sample.toArrow().column(0).to_numpy().astype(np.int64).view(np.uint64)
    trees = [fit_tree(got, m, max(1, min(len(got) // 16, 2 * n // SHARD)), r) for m in masks]  # leaves of half a SHARD, or 16 of the sample
    given = fps.sparkSession.sparkContext.broadcast(trees)

    def shard(b: pa.RecordBatch) -> dict:
        own = b.column(0).to_numpy().view(np.uint64)
        parts = [route(own, t, m, r) for t, m in zip(given.value, masks)]
        return {"fp": np.concatenate([own[i] for i, _ in parts]).view(np.int64), "band": np.concatenate([np.full(len(i), k, np.int32) for k, (i, _) in enumerate(parts)]), "leaf": np.concatenate([j for _, j in parts])}

    sharded = split_leaves(written(mapped(fps.select("fp"), shard, "fp long, band int, leaf long")), r)
    sizes = sharded.groupBy("band", "leaf").count().withColumn("chunks", F.ceil(F.col("count") / SHARD).cast("int"))
    chunk = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
    dealt = (
        sharded.join(few(sizes), ["band", "leaf"]).withColumn("chunk", chunk)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .select("band", "leaf", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "fp")
    )

    def compare(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        own = np.sort(group["fp"].to_numpy())
        up = forest(own.view(np.uint64), masks[int(key[0])], r, radius)
        to = np.array([up.root(x) for x in range(len(own))], np.int64)
        linked = to != np.arange(len(own))
        return pd.DataFrame({"a": own[linked], "b": own[to[linked]]})

    return dealt.groupBy("band", "leaf", "i", "j").applyInPandas(compare, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root: smallest node of each class, by alternating large and small stars.

    edges: a, b (longs, a > b). Each round's table is written to the shared
    folder; the rounds end when a round leaves the stars as they are.
    """
    edges = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = written(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")))  # a table of its own, so that a star's centre can be split in the join
        large = written(both.join(few(least), "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        least = written(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(few(least), "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        edges = written(small.filter("a <> b").distinct())
        now = edges.agg(F.count("a"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = now


def class_ids(members: DataFrame, roots: DataFrame, node: str) -> DataFrame:
    """node, component_id: the smallest `first` of the class of each of members(node, first); roots(node, root) names those that aren't their own root."""
    named = written(members.join(few(roots.withColumnRenamed("node", node)), node, "left").select(node, "first", F.coalesce("root", node).alias("root")))
    ids = written(named.groupBy("root").agg(F.min("first").alias("component_id")))
    return written(named.join(few(ids), "root").select(node, "component_id"))


def near_duplicates(docs: DataFrame, n: int = 4, radius: int = 4) -> DataFrame:
    """doc_id, fp, component_id for every row of `docs`.

    Wordless and null texts have fingerprint 0 and link like others. A row
    without doc_id gets its class's smallest doc_id. Repeated rows stay. Other
    columns are not read. An empty table gives an empty result.
    """
    ship(docs.sparkSession)
    prints = written(fingerprints(docs, n))
    classes = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = written(components(links(classes.select("fp"), radius)))
    return prints.join(few(class_ids(classes, roots, "fp")), "fp").select("doc_id", "fp", "component_id")


def op5_simhash(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
