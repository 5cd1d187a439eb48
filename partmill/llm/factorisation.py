"""Quality classifier: a factorisation machine over hashed words, structure and metadata.

score = sigmoid(w0 + sum w_i x_i + 1/2 sum_f ((sum v_if x_i)^2 - sum (v_if x_i)^2)),
the pairwise interactions in time linear in the features. Features: hashed
lower-case words with square-root counts and unit norm; bins of structure
statistics; the bin of the n_chars column. It is fitted on at most `SAMPLE`
labelled rows, chosen by a hash of doc_id, by AdaGrad in a fixed order.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partmill.llm.common import WordCache, mapped, pieces, ship, table, text_bytes, window_hashes, word_hashes

WORDS = 1 << 17  # hashed words
BINS = 16
STATS = 12
DIMS = WORDS + STATS * BINS
RANK = 6
SAMPLE = 8_000  # labelled rows fitted on, at most
EPOCHS = 6
BATCH = 64

_SLOTS = WordCache(lambda w: xxhash.xxh64_intdigest(w.lower()) % WORDS)
_KIND = np.zeros(256, np.uint8)  # 1 symbol, 2 upper, 4 digit, 8 space, 16 mark
_KIND[list(b"#*$%&|<>")] |= 1
_KIND[list(range(65, 91))] |= 2
_KIND[list(range(48, 58))] |= 4
_KIND[[32, *range(9, 14)]] |= 8
_KIND[list(b".,;:!?")] |= 16


def features(text: bytes, n_chars: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers and values of a text."""
    words = text.split()
    n = len(words)
    raw = np.frombuffer(text, np.uint8)
    size = max(1, len(raw))
    kinds = np.bincount(_KIND[raw], minlength=32)
    part = lambda bit: sum(int(kinds[k]) for k in range(32) if k & bit) / size
    slots, times = np.unique(np.fromiter(map(_SLOTS.__getitem__, words), np.int64, n), return_counts=True)
    lines = text.split(b"\n")
    h = window_hashes(word_hashes(words), 8)
    again = 1 - len(np.unique(h)) / len(h) if len(h) else 0.0
    logged = lambda x, per: min(1.0, np.log1p(x) / per)
    stats = (
        logged(n, 12), logged(len(raw) / max(n, 1), 5), min(1, 8 * part(1)), min(1, 2 * part(2)), min(1, 8 * part(4)), min(1, 8 * part(16)),
        len(slots) / max(n, 1), again, 1 - len(set(lines)) / len(lines), logged(n / len(lines), 8), min(1, text.count(b"!") / max(n, 1)),
        0.0 if n_chars is None else (1 + logged(max(0, n_chars), 16)) / 2,
    )
    bins = np.array([WORDS + k * BINS + min(BINS - 1, int(s * BINS)) for k, s in enumerate(stats)])
    x = np.sqrt(times)
    x = x / max(1e-9, float(np.sqrt((x * x).sum())))
    return np.concatenate([slots, bins]), np.concatenate([x, np.full(STATS, 0.35)]).astype(np.float32)


class Machine:
    def __init__(self, dims: int = DIMS, rank: int = RANK, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.bias = np.zeros(1, np.float32)
        self.w = np.zeros(dims, np.float32)
        self.v = rng.normal(0, 0.05, (dims, rank)).astype(np.float32)

    def margins(self, idx: np.ndarray, x: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Of rows whose features start at `starts`; every row has some."""
        vx = self.v[idx] * x[:, None]
        s = np.add.reduceat(vx, starts)
        return self.bias[0] + np.add.reduceat(self.w[idx] * x, starts) + 0.5 * (s * s - np.add.reduceat(vx * vx, starts)).sum(1)

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = EPOCHS, rate: float = 0.08, decay: float = 1e-5) -> Machine:
        rng = np.random.default_rng(5)
        gw, gv, gb = np.full_like(self.w, 1e-6), np.full_like(self.v, 1e-6), 1e-6
        share = labels.mean()
        weight = np.where(labels > 0, 0.5 / max(share, 0.02), 0.5 / max(1 - share, 0.02)) ** 0.5
        for _ in range(epochs):
            order = rng.permutation(len(rows))
            for k in range(0, len(order), BATCH):
                own = order[k : k + BATCH]
                lengths = np.array([len(rows[i][0]) for i in own])
                starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
                idx, x = np.concatenate([rows[i][0] for i in own]), np.concatenate([rows[i][1] for i in own])
                p = 1 / (1 + np.exp(-np.clip(self.margins(idx, x, starts), -30, 30)))
                g = np.repeat(((p - labels[own]) * weight[own]).astype(np.float32), lengths)
                vx = self.v[idx] * x[:, None]
                s = np.repeat(np.add.reduceat(vx, starts), lengths, axis=0)
                dw, dv = g * x, (g * x)[:, None] * (s - vx)
                used, at = np.unique(idx, return_inverse=True)
                sw = np.bincount(at, dw, len(used)).astype(np.float32) + decay * self.w[used]
                sv = np.stack([np.bincount(at, dv[:, f], len(used)) for f in range(dv.shape[1])], 1).astype(np.float32) + decay * self.v[used]
                gw[used] += sw * sw
                gv[used] += sv * sv
                self.w[used] -= rate * sw / np.sqrt(gw[used])
                self.v[used] -= rate * 0.5 * sv / np.sqrt(gv[used])
                db = float(((p - labels[own]) * weight[own]).sum())
                gb += db * db
                self.bias -= rate * db / np.sqrt(gb)
        return self

    def scores(self, texts: list[bytes], chars: list) -> np.ndarray:
        out = []
        for t, c in zip(texts, chars):
            idx, x = features(t, c)
            out.append(self.margins(idx, x, np.zeros(1, np.int64))[0])
        return 1 / (1 + np.exp(-np.clip(np.array(out, np.float64), -30, 30)))


def held_out():
    """Rows whose labels are never learnt from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def _shaped(docs: DataFrame) -> DataFrame:
    chars = F.col("n_chars").cast("long") if "n_chars" in docs.columns else F.lit(None).cast("long")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), chars.alias("n_chars"), text_bytes())


def fitted(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Machine:
    """A machine from at most `sample` rows of `labels` that aren't held out, and their documents.

    Null labels or ids are left out; of several labels of a document the
    smallest counts, of several documents with one id the one of the smallest
    features, so at most `sample` rows reach the fitting task. Without labelled
    rows every score is 0.5.
    """
    ship(docs.sparkSession)
    known = labels.filter("doc_id is not null and quality is not null").filter(~held_out())
    chosen = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    def run(b: pa.RecordBatch) -> dict:
        rows = [features(t, c) for t, c in zip(b.column(2).to_pylist(), b.column(1).to_pylist())]
        return {"doc_id": b.column(0), "idx": [i.astype("<i4").tobytes() for i, _ in rows], "x": [x.astype("<f4").tobytes() for _, x in rows], "quality": b.column(3)}

    own = _shaped(docs).join(F.broadcast(chosen), "doc_id")  # at most `sample` rows
    rows = mapped(own, run, "doc_id long, idx binary, x binary, quality int")
    rows = rows.groupBy("doc_id").agg(F.min(F.struct("idx", "x", "quality")).alias("r")).select("doc_id", "r.*")

    def fit(batches):
        got: dict[str, list] = {"doc_id": [], "idx": [], "x": [], "quality": []}
        for b in batches:
            for name, values in got.items():
                values += b.column(b.schema.get_field_index(name)).to_pylist()
        order = sorted(range(len(got["doc_id"])), key=lambda i: (got["doc_id"][i], got["idx"][i]))
        machine = Machine()
        if order:
            machine.fit([(np.frombuffer(got["idx"][i], "<i4"), np.frombuffer(got["x"][i], "<f4")) for i in order], np.array([got["quality"][i] for i in order], np.float32))
        else:
            machine.v[:] = 0
        yield pa.RecordBatch.from_arrays([pa.array([x.astype("<f4").tobytes()], pa.binary()) for x in (machine.bias, machine.w, machine.v)], names=["bias", "w", "v"])

    bias, w, v = rows.repartition(1).mapInArrow(fit, "bias binary, w binary, v binary").first()  # one task of the bounded sample
    machine = Machine()
    machine.bias, machine.w = np.frombuffer(bias, "<f4").copy(), np.frombuffer(w, "<f4").copy()
    machine.v = np.frombuffer(v, "<f4").reshape(-1, RANK).copy()
    return machine


def scored(docs: DataFrame, machine: Machine) -> DataFrame:
    """doc_id, held_out, score, predicted for each row; a null text is empty, a null doc_id is not held out."""
    given = ship(docs.sparkSession).sparkContext.broadcast(machine)

    def run(b: pa.RecordBatch) -> dict:
        return {"doc_id": b.column(0), "score": given.value.scores(b.column(2).to_pylist(), b.column(1).to_pylist())}

    out = mapped(_shaped(docs), run, "doc_id long, score double")
    return out.select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def accepted(docs: DataFrame, machine: Machine, least: float = 0.5) -> DataFrame:
    """`docs`, all columns, without the rows that score under `least`.

    A null text is scored as an empty one, a missing or null n_chars as none; rows
    without doc_id are scored like others, repeated rows go or stay alike. An empty
    table gives an empty result.
    """
    given = ship(docs.sparkSession).sparkContext.broadcast(machine)
    at = docs.columns.index("text"), (docs.columns.index("n_chars") if "n_chars" in docs.columns else None)

    def run(batches):
        for batch in batches:
            for b in pieces(batch):
                texts = [(t or "").encode() for t in b.column(at[0]).to_pylist()]
                chars = b.column(at[1]).to_pylist() if at[1] is not None else [None] * len(texts)
                yield b.filter(pa.array(given.value.scores(texts, chars) >= least))

    return docs.mapInArrow(run, docs.schema)


def op7_factorisation(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scored(docs, fitted(docs, table(spark, sf_dir, "labels")))
