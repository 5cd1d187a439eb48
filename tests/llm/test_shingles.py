import numpy as np

import corpus_pipeline
from partmill.llm import shingles


def texts(seed=3, families=25):
    """Random texts, each with variants of some replaced words: similarities on both sides of 0.8."""
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(families):
        words = [f"w{x}" for x in rng.integers(0, 5000, rng.integers(60, 400))]
        out.append(" ".join(words))
        for _ in range(3):
            own = list(words)
            for at in rng.choice(len(own), max(1, len(own) * int(rng.integers(1, 6)) // 150), replace=False):
                own[at] = f"v{rng.integers(0, 5000)}"
            out.append(" ".join(own))
    return out


def brute(texts):
    """Smallest position of each text's class, by plain sets of five-word tuples."""
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for w in (t.lower().split() for t in texts)]
    of = list(range(len(sets)))
    for x in range(len(sets)):
        for y in range(x):
            if of[x] != of[y] and len(sets[x] & sets[y]) >= 0.8 * len(sets[x] | sets[y]):
                a, b = sorted((of[x], of[y]))
                of = [a if k == b else k for k in of]
    return of


def test_classes_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(shingles, "CHUNK", 2)
    own = texts()
    docs = spark.createDataFrame(list(enumerate(own)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in shingles.near_duplicates(docs).collect()}
    want = brute(own)
    assert [got[k] for k in range(len(own))] == want and 30 < len(set(want)) < 80


def test_stage_links_at_four_fifths_and_not_below(spark):
    rng = np.random.default_rng(1)
    rows = []
    for k in range(12):
        words = [f"w{x}" for x in rng.integers(0, 9000, 300)]
        other = list(words)
        for at in range(20, 20 + 40 * (6 if k < 6 else 7), 40):  # 266 / 326 = 0.816 or 261 / 331 = 0.789
            other[at] = f"v{k}"
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(other))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect())
    assert kept == [0, 2, 4, 6, 8, 10, *range(12, 24)]


def test_shingle_classes_odd_rows(odd_docs, no_docs):
    rows = shingles.near_duplicates(odd_docs.filter("doc_id is not null")).collect()
    of = {r.doc_id: r.component_id for r in rows}
    assert len(rows) == 7 and of[2] == 1 and of[4] == 3 and of[6] == 6
    assert shingles.near_duplicates(no_docs).count() == 0
