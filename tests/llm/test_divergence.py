import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest

from partmill.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string, digest string, part int, n long"


def plain(rows, least=3, top=200):
    """The contract, term by term and pair by pair."""
    found, docs_of, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source, *_ in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", low)
        found[lang, source].update(words)
        docs_of[lang].update(set(words))
    out = []
    for lang, source in groups:
        kept = [t for t, n in docs_of[lang].items() if n >= least]
        of_lang = Counter()
        for (la, _), c in found.items():
            if la == lang:
                of_lang.update(c)

        def p(counts, t):
            return 1 + 10**9 * (counts[t] + 1) // (sum(counts[x] for x in kept) + len(kept))

        def f(a, b):
            return (a - b) ** 2 // b

        own = {t: p(found[lang, source], t) for t in kept}
        pairs = []
        for la, other in groups:
            if la == lang and other != source:
                far = {t: p(found[lang, other], t) for t in kept}
                pairs.append((sum(f(own[t], far[t]) for t in kept), other))
        whole = {t: p(of_lang, t) for t in kept}
        terms = [(f(own[t], whole[t]), t) for t in kept if found[lang, source][t] and own[t] > whole[t]]
        for part, items, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
            for k, (value, item) in enumerate(sorted(items, key=lambda x: (-x[0], x[1].encode()))[:most]):
                out.append((lang, source, part, item, value, k + 1))
    return sorted(out)


def corpus(seed):
    rng = random.Random(seed)
    words = [f"w{a}{b}" for a in "abcdefghij" for b in "ABCdéü中"] + ["The", "the", "É", "é", "\U0001f600", "ſ", "K"]
    rows = [(k, rng.choice([" ", ", ", "1-"]).join(rng.choices(words, [1 / (i + 1) for i in range(len(words))], k=rng.randrange(30))), rng.choice(["en", "fr", None]), rng.choice(["a", "b", "c", "hot", "hot", "hot", None, ""])) for k in range(120)]
    rows += [(200, None, "en", "null text"), (201, "", "xx", "only"), (201, "", "xx", "only"), (202, "one two", "xx", "two"), (None, None, None, None), (203, "café " * 5000, "fr", "long"), (204, "solo", "yy", "s")]
    return [(*r, "x", 1, None) for r in rows]


@pytest.mark.parametrize("bits", [64, 4, 0])
def test_every_value_by_the_contract(spark, bits):
    """With few bits digests are shared by many terms, and are split."""
    rows = corpus(bits)
    got = divergence.divergences(spark.createDataFrame(rows, SCHEMA), bits=bits).collect()
    assert sorted(map(tuple, got)) == plain(rows)


def test_few_top_terms_with_ties_and_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(divergence, "PAIRS", 3)
    rows = corpus(5) + [(300 + k, "tie tied ties tier", "en", "even", "x", 1, None) for k in range(4)]
    got = divergence.divergences(spark.createDataFrame(rows, SCHEMA), least_docs=2, top=3).collect()
    assert sorted(map(tuple, got)) == plain(rows, 2, 3)


def test_joins_by_shuffle(spark, monkeypatch):
    from partmill.llm import common

    monkeypatch.setattr(common, "ROWS", 0)
    rows = corpus(6)
    assert sorted(map(tuple, divergence.divergences(spark.createDataFrame(rows, SCHEMA), bits=5).collect())) == plain(rows)


def test_sql_and_empty_table(spark, no_docs):
    rows = corpus(7)
    con = duckdb.connect()
    con.sql("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?)", [r[:4] for r in rows])
    assert sorted((la, s, p, i, v, r) for la, s, p, i, v, r in con.sql(divergence.OP13_SQL).fetchall()) == plain(rows)
    assert divergence.divergences(no_docs).collect() == []
