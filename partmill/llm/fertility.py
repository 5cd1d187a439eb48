"""Quality rules by tokeniser fertility.

Two public vocabularies encode every word with its word-start mark. Measured
per text: characters per token under each, the share of byte-fallback tokens,
and the entropy of the token distribution against the median of the language at
that length. A language (the script of most letters where there is none) rejects
what lies outside its band: the quartiles of all its texts of `SOUND` words or
more, widened by `REACH` interquartile ranges or the `SLACK` of the measure,
whichever is more. Bands are computed over all rows.
"""

from __future__ import annotations

import unicodedata
from collections import Counter, defaultdict
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partmill.llm.common import MIX, mapped, scrambled, ship, table, text_bytes, window_hashes, written

WINDOW = 8
SOUND = 20
REACH = 3.0
SLACK = {"chars_a": 0.25, "chars_b": 0.25, "byte_share": 0.03, "evenness": 0.08}
SIDES = {"chars_a": "both", "chars_b": "both", "byte_share": "high", "evenness": "low"}
KEYS = 100_000  # bands of up to so many languages are broadcast; more are joined by a shuffle
SYMBOLS = b"#*$%&|<>"


class Words:
    """What the measures need of each word met, by number: one dictionary lookup per occurrence, the rest in arrays.

    New words are encoded together, once under each vocabulary. Between two
    batches a table of over `most` words starts anew, which bounds its memory.
    """

    def __init__(self, piece_path: str, rank_path: str, most: int = 500_000):
        import base64

        import public_tokenizers
        import sentencepiece
        import tiktoken

        self.pieces = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        with open(rank_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.merges = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.spaced = np.zeros(max(ranks.values(), default=0) + 1, bool)
        self.spaced[[k for token, k in ranks.items() if token.startswith(b" ")]] = True
        self.bytes = np.array([self.pieces.is_byte(k) for k in range(self.pieces.get_piece_size())])
        self.most = most
        self.clear()

    def clear(self) -> None:
        self.number: defaultdict[bytes, int] = defaultdict(lambda: len(self.number))
        self.ids = np.empty(0, np.uint16)  # pieces of all words in a row; those of word k start at starts[k]
        self.starts = np.zeros(1, np.int64)
        self.of = {name: np.empty(0, np.uint64 if name == "hash" else np.int32) for name in ("hash", "chars", "symbols", "pieces", "merged", "byte")}

    def numbers(self, words: list[bytes]) -> np.ndarray:
        if len(self.number) > self.most:
            self.clear()
        before = len(self.number)
        out = np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))
        new = list(islice(self.number, before, None))
        for k in range(0, len(new), 50_000):
            self.learn(new[k : k + 50_000])
        return out

    def merged(self, texts: list[str]) -> np.ndarray:
        """Tokens of each word, with a space before it, under the second vocabulary.

        One call encodes all of them in a row: a pre-token holds a space at its start
        alone, so every word's first token, and no other one, starts with a space.
        """
        if not texts:
            return np.empty(0, np.int64)
        first = self.spaced[self.merges.encode_to_numpy(" " + " ".join(texts), disallowed_special=())]
        return np.bincount(np.cumsum(first) - 1, minlength=len(texts))

    def learn(self, words: list[bytes]) -> None:
        texts = [w.decode("utf-8", "replace") for w in words]
        ids = self.pieces.encode(texts, num_threads=1)
        n = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter(chain.from_iterable(ids), np.uint16, int(n.sum()))
        ends = np.concatenate([[0], np.cumsum(n)])
        byte = np.concatenate([[0], np.cumsum(self.bytes[flat])])
        got = {
            "hash": [xxhash.xxh64_intdigest(w) for w in words], "chars": list(map(len, texts)), "symbols": [len(w) - len(w.translate(None, SYMBOLS)) for w in words],
            "pieces": n, "merged": self.merged(texts), "byte": byte[ends[1:]] - byte[ends[:-1]],
        }
        self.of = {name: np.concatenate([old, np.array(got[name], old.dtype)]) for name, old in self.of.items()}
        self.ids, self.starts = np.concatenate([self.ids, flat]), np.concatenate([self.starts, self.starts[-1] + ends[1:]])


@lru_cache(4)
def words_of(piece_path: str, rank_path: str) -> Words:
    return Words(piece_path, rank_path)


def repeated_words(h: np.ndarray, of: np.ndarray, texts: int, n: int = WINDOW) -> np.ndarray:
    """Per text, words inside n-word windows that occur twice or more in it; h: hashes of all words, of: their texts, in order."""
    out = np.zeros(texts, np.int64)
    if len(h) < n:
        return out
    w = window_hashes(h, n)
    own = np.nonzero(of[: len(w)] == of[n - 1 :])[0]  # within one text
    w = scrambled(w[own] + of[own].astype(np.uint64) * MIX)
    order = np.argsort(w)
    same = w[order[1:]] == w[order[:-1]]
    again = own[np.unique(np.concatenate([order[1:][same], order[:-1][same]]))]
    edge = np.bincount(again, minlength=len(h) + 1)[: len(h) + 1] - np.bincount(again + n, minlength=len(h) + 1)[: len(h) + 1]
    return np.bincount(of, np.cumsum(edge)[:-1] > 0, texts).astype(np.int64)


def entropies(tokens: np.ndarray, of: np.ndarray, texts: int) -> np.ndarray:
    """Per text, the entropy in bits of its token distribution."""
    n = np.bincount(of, minlength=texts)
    key = np.sort(of.astype(np.int64) << 16 | tokens)
    starts = np.nonzero(np.diff(key, prepend=-1))[0]
    times = np.diff(starts, append=len(key))
    part = np.bincount(key[starts] >> 16, times * np.log2(times), texts) if len(key) else np.zeros(texts)
    return np.log2(np.maximum(n, 1)) - part / np.maximum(n, 1)


def repeated_lines(text: bytes) -> int:
    seen, n = set(), 0
    for line in text.split(b"\n"):
        if line.strip(b" \t\n\v\f\r"):
            n += line in seen
            seen.add(line)
    return n


def script_of(text: str) -> str:
    """Script of most of the letters, by the first word of their Unicode names; '' without letters."""
    seen: dict[str, int] = {}
    for c, n in Counter(text).items():
        if c.isalpha():
            s = "LATIN" if c.isascii() else unicodedata.name(c, "").split(" ")[0]
            seen[s] = seen.get(s, 0) + n
    return max(sorted(seen), key=seen.get).lower() if seen else ""


MEASURED = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_tokens long, chars_a double, chars_b double, byte_share double, entropy double"


def measures(texts: list[bytes], words: Words) -> dict[str, np.ndarray]:
    """The columns of MEASURED for each text."""
    split = [t.split() for t in texts]
    n = np.fromiter(map(len, split), np.int64, len(split))
    which, of = words.numbers(list(chain.from_iterable(split))), np.repeat(np.arange(len(texts)), n)
    total = lambda name: np.bincount(of, words.of[name][which], len(texts)).astype(np.int64)
    chars, tokens, size = total("chars"), total("pieces"), words.of["pieces"][which]
    at = np.repeat(words.starts[which] - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
    share = lambda a, b: a / np.maximum(b, 1)
    return {
        "n_words": n, "word_chars": chars, "n_symbols": total("symbols"), "n_dup_lines": [repeated_lines(t) for t in texts],
        "n_repeat_words": repeated_words(words.of["hash"][which], of, len(texts)), "n_tokens": tokens, "chars_a": share(chars, tokens), "chars_b": share(chars, total("merged")),
        "byte_share": share(total("byte"), tokens), "entropy": entropies(words.ids[at], np.repeat(of, size), len(texts)),
    }


def measured(docs: DataFrame, piece_path: str, rank_path: str) -> DataFrame:
    """The base counts and the measures of each row."""

    def run(b: pa.RecordBatch) -> dict:
        texts = b.column(2).to_pylist()
        key = [lang or script_of(t.decode("utf-8", "replace")) for lang, t in zip(b.column(1).to_pylist(), texts)]
        return {"doc_id": b.column(0), "key": key} | measures(texts, words_of(piece_path, rank_path))

    lang = F.col("lang") if "lang" in docs.columns else F.lit(None)
    return mapped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), lang.cast("string").alias("lang"), text_bytes()), run, f"doc_id long, key string, {MEASURED}")


def _failed():
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def with_evenness(rows: DataFrame) -> DataFrame:
    """evenness: entropy less the median of the sound texts of the language and of as many tokens, by octave.

    Entropy grows with length, so a text is held against others of its length. An
    octave without a sound text gives null, which no band rejects.
    """
    own = rows.withColumn("octave", F.floor(F.log2(F.greatest("n_tokens", F.lit(1)))).cast("int"))
    usual = own.filter((F.col("n_words") >= SOUND) & ~_failed()).groupBy("key", "octave").agg(F.percentile_approx("entropy", 0.5, 10000).alias("usual"))
    return joined(own, usual, ["key", "octave"]).withColumn("evenness", F.col("entropy") - F.col("usual")).drop("octave", "usual")


def bands(rows: DataFrame, reach: float = REACH) -> DataFrame:
    """key and, for each measure, its quartiles and how far beyond them a long text may lie."""
    sound = rows.filter((F.col("n_words") >= SOUND) & ~_failed()).groupBy("key")
    q = sound.agg(*[F.percentile_approx(m, [0.25, 0.75], 10000).alias(m) for m in SIDES])
    out = []
    for m in SIDES:
        out.append(F.col(m)[0].alias(f"{m}_low"))
        out.append(F.col(m)[1].alias(f"{m}_high"))
        out.append(F.greatest(F.lit(SLACK[m]), reach * (F.col(m)[1] - F.col(m)[0])).alias(f"{m}_wide"))
    return q.select("key", *out)


def joined(rows: DataFrame, few: DataFrame, on: list[str]) -> DataFrame:
    """Left join with a small table, which is broadcast after a check of its rows."""
    return rows.join(F.broadcast(few) if few.limit(KEYS + 1).count() <= KEYS else few, on, "left")


def quality_rules(docs: DataFrame, piece_path: str, rank_path: str) -> DataFrame:
    """The measures of each row with base_failed, kept and the names of the measures outside their band.

    A null text counts as empty: no words, base_failed. A null or missing lang
    takes the script. A language without a sound text has no band and rejects
    nothing more than the base does. Other columns are not read.
    """
    ship(docs.sparkSession)
    rows = with_evenness(written(measured(docs, piece_path, rank_path)))
    out = joined(rows.withColumn("base_failed", _failed()), bands(rows), ["key"])
    short = F.sqrt(1 + 60 / F.col("n_words"))  # a few words vary more

    def outside(m: str, side: str):
        low = F.col(m) < F.col(f"{m}_low") - F.col(f"{m}_wide") * short
        high = F.col(m) > F.col(f"{m}_high") + F.col(f"{m}_wide") * short
        return {"low": low, "high": high, "both": low | high}[side]

    bad = F.array_compact(F.array(*[F.when(outside(m, side), F.lit(m)) for m, side in SIDES.items()]))
    out = out.withColumn("outside", F.when(F.col("n_words") > 0, bad).otherwise(F.array().cast("array<string>")))
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("outside") == 0))


def op2_fertility(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    out = quality_rules(table(spark, sf_dir, "documents"), P.path("piece_bpe_32k.model"), P.path("byte_bpe_multi_50k.tiktoken"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_tokens", "chars_a", "chars_b", "byte_share", "entropy", "evenness", F.array_join("outside", ",").alias("outside"))
