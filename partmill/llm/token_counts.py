"""Token counts by trie-shared dynamic programming.

The pre-tokens of a batch of texts, each the word-start mark and a word, are put
in a trie, walked depth first in sorted order. The best unigram score up to a
position depends only on the prefix, so it is computed once per trie node and
shared by all words below it; at a word's end the number of tokens of its best
segmentation is stored. The public vocabulary's pieces are ranked, not weighted, so
a piece of rank r has the log-probability of a Zipf-Mandelbrot law, -log(r + SHIFT);
characters without a piece cost one fallback token per UTF-8 byte. The counts are
those of this unigram model: near the vocabulary's own merges, not equal to them.
"""

from __future__ import annotations

import math
from collections import Counter
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partmill.llm.common import WordCache, mapped, ship, table, text_bytes

MARK = "▁"
SHIFT = 2.7
WORDS = 150_000  # pre-tokens in one trie, at most


class Unigram:
    def __init__(self, scores: dict[str, float], fallback: float):
        self.scores, self.fallback = scores, fallback
        self.longest = max(map(len, scores), default=1)
        ends: dict[str, set[int]] = {}
        for p in scores:
            ends.setdefault(p[-2:], set()).add(len(p))
        self.lengths = {e: tuple(sorted(n)) for e, n in ends.items()}

    def extend(self, word: str, best: list[float], count: list[int]) -> None:
        """Forward scores of the prefixes of `word` from those given on; ties go to fewer tokens."""
        scores = self.scores
        for end in range(len(best), len(word) + 1):
            c = word[end - 1]
            n = len(c.encode("utf-8", "replace"))
            top, least = best[end - 1] + n * self.fallback, count[end - 1] + n
            for lengths in (self.lengths.get(c), self.lengths.get(word[end - 2 : end]) if end > 1 else None):
                for size in lengths or ():
                    if size > end:
                        break
                    s = scores.get(word[end - size : end])
                    if s is not None:
                        s += best[end - size]
                        k = count[end - size] + 1
                        if s > top or (s == top and k < least):
                            top, least = s, k
            best.append(top)
            count.append(least)

    def counts(self, words) -> dict[str, int]:
        """Tokens of the best segmentation of each distinct word, over one trie."""
        out, before = {}, ""
        best, count = [0.0], [0]
        for word in sorted(words):
            shared = 0
            most = min(len(word), len(before))
            while shared < most and word[shared] == before[shared]:
                shared += 1
            del best[shared + 1 :], count[shared + 1 :]
            self.extend(word, best, count)
            out[word] = count[-1]
            before = word
        return out


@lru_cache(2)
def unigram(path: str) -> tuple[Unigram, WordCache]:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    special = lambda k: model.is_byte(k) or model.is_control(k) or model.is_unknown(k) or model.is_unused(k)
    ranked = sorted((k for k in range(model.get_piece_size()) if not special(k)), key=lambda k: (-model.get_score(k), k))
    scores = {model.id_to_piece(k): -math.log(r + SHIFT) for r, k in enumerate(ranked)}
    least = min(scores.values(), default=0.0)
    return Unigram(scores, least - 10), WordCache(None)


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_words, n_tokens for each row.

    Words lie between ASCII white space, which costs no token of its own. A null
    text is empty: no words, no tokens. Other columns are not read; repeated
    rows repeat; words of any length are scored whole.
    """
    ship(docs.sparkSession)

    def run(b: pa.RecordBatch) -> dict:
        model, kept = unigram(path)
        out = []
        texts = [Counter(t.split()) for t in b.column(1).to_pylist()]
        new = {w for t in texts for w in t if w not in kept}
        for w in list(new):
            if w in kept.old:
                kept[w] = kept.old[w]
                new.discard(w)
        if len(kept) > WORDS:
            kept.old = dict(kept)
            kept.clear()
        words = {w: MARK + w.decode("utf-8", "replace") for w in new}
        counts = model.counts(set(words.values()))
        kept.update((w, counts[t]) for w, t in words.items())
        for t in texts:
            out.append((t.total(), sum(n * (kept[w] if w in kept else kept.old[w]) for w, n in t.items())))
        return {"doc_id": b.column(0), "n_words": [n for n, _ in out], "n_tokens": [n for _, n in out]}

    return mapped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes()), run, "doc_id long, n_words long, n_tokens long")


def op8_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
