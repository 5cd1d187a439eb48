import re
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from partmill.llm import fertility

PATHS = P.path("piece_bpe_32k.model"), P.path("byte_bpe_multi_50k.tiktoken")


def plain(text: str) -> dict:
    """The measures by their definition, a text and a word at a time."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen = Counter(tuple(words[k : k + 8]) for k in range(len(words) - 7))
    inside = {j for k in range(len(words) - 7) if seen[tuple(words[k : k + 8])] > 1 for j in range(k, k + 8)}
    lines, before, twice = text.split("\n"), set(), 0
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            twice += line in before
            before.add(line)
    own = fertility.words_of(*PATHS)
    ids = [k for w in words for k in own.pieces.encode(w)]
    merged = sum(len(own.merges.encode_ordinary(" " + w)) for w in words)
    share = np.array(list(Counter(ids).values())) / max(1, len(ids))
    chars = sum(map(len, words))
    return {
        "n_words": len(words), "word_chars": chars, "n_symbols": sum(c in "#*$%&|<>" for c in text), "n_dup_lines": twice, "n_repeat_words": len(inside), "n_tokens": len(ids),
        "chars_a": chars / max(1, len(ids)), "chars_b": chars / max(1, merged), "byte_share": sum(own.pieces.is_byte(k) for k in ids) / max(1, len(ids)), "entropy": float(-(share * np.log2(share)).sum()),
    }


@given(st.lists(st.one_of(st.text(max_size=60), st.lists(st.sampled_from(["a", "b", "don't", "|", "12.5", "é\u00a0x", "\n"]), max_size=60).map(" ".join)), max_size=5))
@settings(max_examples=150, deadline=None)
def test_measures_equal_their_definition(texts):
    got = fertility.measures([t.encode("utf-8", "replace") for t in texts], fertility.words_of(*PATHS))
    for k, t in enumerate(texts):
        for name, value in plain(t.encode("utf-8", "replace").decode()).items():
            assert got[name][k] == pytest.approx(value, abs=1e-9), name


def test_a_full_table_starts_anew():
    small = fertility.Words(*PATHS, most=3)
    texts = [b"one two three four five", b"six one seven", b"two two eight"]
    want = fertility.measures(texts, fertility.words_of(*PATHS))
    for k in range(3):
        got = fertility.measures(texts[k : k + 1], small)
        assert all(got[name][0] == pytest.approx(want[name][k]) for name in want)
    assert len(small.number) < 7


def test_bands_reject_what_lies_outside(spark):
    rng = np.random.default_rng(4)
    words = [w for w in open(__file__).read().split() if w.isalpha()]
    sound = [(k, " ".join(rng.choice(words, 200)), "en") for k in range(60)]
    odd = [(100, " ".join(rng.choice(words[:3], 200)), "en"), (101, " ".join(w + "&&&" for w in rng.choice(words, 200)), "en"), (102, "too few words", "en"), (103, " ".join(rng.choice(words, 200)), None)]
    rows = {r.doc_id: r for r in fertility.quality_rules(spark.createDataFrame(sound + odd, "doc_id long, text string, lang string"), *PATHS).collect()}
    assert all(rows[k].kept for k in range(60)) and rows[103].kept and rows[103].key == "latin"
    assert rows[100].base_failed or "evenness" in rows[100].outside
    assert not rows[101].kept and set(rows[101].outside) & {"chars_a", "chars_b"}
    assert rows[102].base_failed and not rows[102].kept


def test_bands_equal_quartiles(spark):
    """Verdicts against a plain computation of the bands."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = fertility.quality_rules(docs, *PATHS).toPandas()
    got["octave"] = np.floor(np.log2(np.maximum(got.n_tokens, 1)))
    sound = got[(got.n_words >= 20) & ~got.base_failed]
    low = lambda x, q: sorted(x)[max(0, int(np.ceil(q * len(x))) - 1)]
    usual = sound.groupby(["key", "octave"]).entropy.agg(lambda x: low(x, 0.5))
    assert all(r.evenness == pytest.approx(r.entropy - usual[(r.key, r.octave)]) for r in sound.itertuples())
    for m, side in fertility.SIDES.items():
        q = sound.groupby("key")[m].agg([lambda x: low(x, 0.25), lambda x: low(x, 0.75)])
        q.columns = ["a", "b"]
        for r in got[got.n_words > 0].itertuples():
            if r.key in q.index and np.isfinite(getattr(r, m)):
                a, b = q.loc[r.key]
                wide = max(fertility.SLACK[m], 3 * (b - a)) * (1 + 60 / r.n_words) ** 0.5
                out = (side != "high" and getattr(r, m) < a - wide) or (side != "low" and getattr(r, m) > b + wide)
                assert out == (m in r.outside)
