import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from partmill.llm import common, decontaminate, factorisation, fertility, licenses, mixing, packing, private, simhash, token_counts
from partmill.llm.common import shared_dir

WORD = P.path("word_bpe_49k.json")


# ---- SimHash ------------------------------------------------------------------


def brute_classes(fps):
    up = list(range(len(fps)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if bin(int(fps[i]) ^ int(fps[j])).count("1") <= 4:
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return [root(x) for x in range(len(fps))]


def near_fingerprints(n=600, seed=1):
    rng = np.random.default_rng(seed)
    out = set(int(x) for x in rng.integers(0, 1 << 63, n))
    for x in list(out)[: n // 3]:
        for _ in range(3):
            for bit in rng.choice(64, rng.integers(1, 6), replace=False):
                x ^= 1 << int(bit)
            out.add(x & ((1 << 64) - 1))
    return np.array(sorted(out), np.uint64)


@pytest.mark.parametrize("sample, rows", [(1 << 16, 200_000), (64, 3)])
def test_shards_link_exactly(spark, monkeypatch, sample, rows):
    """Also where the fitted tree has few leaves, so that oversized ones are split on, and where no table is small."""
    monkeypatch.setattr(simhash, "SHARD", 100)
    monkeypatch.setattr(simhash, "SAMPLE", sample)
    monkeypatch.setattr(common, "ROWS", rows)
    fps = near_fingerprints()
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    roots = {r.node: r.root for r in simhash.components(simhash.links(df)).collect()}
    groups = {}
    for x, r in zip(fps.view(np.int64).tolist(), brute_classes(fps)):
        groups.setdefault(r, set()).add(x)
    got = {}
    for x in fps.view(np.int64).tolist():
        got.setdefault(roots.get(x, x), set()).add(x)
    assert {frozenset(g) for g in groups.values()} == {frozenset(g) for g in got.values()}


def test_oversized_leaves_are_split(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SHARD", 50)
    fps = near_fingerprints(seed=5)
    rows = [(int(x), 0, 7) for x in fps.view(np.int64)]
    got = simhash.split_leaves(spark.createDataFrame(rows, "fp long, band int, leaf long"), 1).toPandas()
    assert got.groupby("leaf").size().max() <= 50 and set(got.fp) == {r[0] for r in rows}
    mask = simhash.band_masks()[0]
    at: dict = {}
    for fp, leaf in zip(got.fp.to_numpy().view(np.uint64).tolist(), got.leaf):
        at.setdefault(fp, set()).add(leaf)
    for a in range(0, len(fps), 7):
        for b in np.nonzero(np.bitwise_count((fps ^ fps[a]) & mask) <= 1)[0]:
            assert at[int(fps[a])] & at[int(fps[b])]


def test_leaf_that_no_distance_splits(spark, monkeypatch):
    """Fingerprints that are equal in a band stay one leaf, which is compared in chunks."""
    monkeypatch.setattr(simhash, "SHARD", 20)
    fps = [int(x) << 30 for x in range(90)]
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    roots = {r.node: r.root for r in simhash.components(simhash.links(df)).collect()}
    assert {roots.get(x, x) for x in fps} == {0}


def test_routes_keep_close_pairs_together():
    fps = near_fingerprints(seed=2)
    for mask in simhash.band_masks():
        tree = simhash.fit_tree(fps, mask, 16)
        i, leaf = simhash.route(fps, tree, mask, 1)
        at = [set(leaf[i == k].tolist()) for k in range(len(fps))]
        for a in range(0, len(fps), 7):
            for b in np.nonzero(np.bitwise_count((fps ^ fps[a]) & mask) <= 1)[0]:
                assert at[a] & at[b]


def test_fingerprint_of_few_words():
    import xxhash

    assert simhash.fingerprint(b"") == 0
    assert simhash.fingerprint(b"Ab cD") == xxhash.xxh64_intdigest(b"ab cd", 42)


def test_near_duplicates_odd_rows(odd_docs, no_docs):
    rows = simhash.near_duplicates(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    of = {r.doc_id: r.component_id for r in rows}
    assert of[3] == 3 and of[4] == 3  # both fingerprint 0
    assert simhash.near_duplicates(no_docs).count() == 0


# ---- decontamination ----------------------------------------------------------


def test_containment_matches_brute_force(spark, odd_docs, no_docs, monkeypatch):
    rng = np.random.default_rng(0)
    words = [f"w{k}" for k in range(300)]
    items = [(k, " ".join(rng.choice(words, int(rng.integers(3, 60))))) for k in range(40)] + [(99, None)]
    docs = []
    for d in range(60):
        own = list(rng.choice(words, 200))
        if d % 2:
            part = items[d % 40][1].split()
            part = part[: max(1, int(len(part) * rng.choice([0.7, 0.9, 1])))]
            own[50:50] = [w.upper() + "," for w in part]
        docs.append((d, " ".join(own)))
    df, it = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contained_items(df, it).collect()}
    sets = {i: decontaminate.shingles((t or "").encode()) for i, t in items}
    want = {(d, i) for d, t in docs for i, s in sets.items() if s and len(decontaminate.grams(decontaminate.cores(t.encode()), len(next(iter(s)))) & s) >= 0.8 * len(s) - 1e-9}
    assert got == want and want
    left = {r.doc_id for r in decontaminate.decontaminated(df, it).collect()}
    assert left == {d for d, _ in docs} - {d for d, _ in want}
    assert decontaminate.decontaminated(odd_docs, it).count() == odd_docs.count()
    assert decontaminate.contained_items(no_docs, it).count() == 0 and decontaminate.decontaminated(no_docs, it).count() == 0
    assert decontaminate.decontaminated(odd_docs, it.filter("item_id < 0")).count() == odd_docs.count()
    for module, limit in ((common, "ROWS"), (decontaminate, "CHUNK")):  # joins by a shuffle, candidates in parts
        monkeypatch.setattr(module, limit, 3)
        assert {(r.doc_id, r.item_id) for r in decontaminate.contained_items(df, it).collect()} == want
    assert decontaminate.contained_items(odd_docs, it.filter("item_id < 0")).count() == 0


# ---- fertility ----------------------------------------------------------------


def test_quality_rules_odd_rows(odd_docs, no_docs):
    paths = P.path("piece_bpe_32k.model"), P.path("byte_bpe_multi_50k.tiktoken")
    rows = {r.doc_id: r for r in fertility.quality_rules(odd_docs, *paths).collect()}
    assert rows[3].n_words == 0 and rows[3].base_failed and not rows[3].kept
    assert rows[5].n_words == 50_000 and rows[5].n_repeat_words == 50_000
    assert fertility.quality_rules(no_docs, *paths).count() == 0


# ---- licences -----------------------------------------------------------------


def test_license_scan(spark, odd_docs, no_docs):
    mit = licenses.TEMPLATES["MIT"]
    rows = [(1, "Some code.\nReleased under the MIT License.\nmore"), (2, "intro " + mit.replace("furnished", "given") + " outro"), (3, "the license of this"), (4, "Licensed under the GNU General Public License version 3")]
    got = {(r.doc_id, r.license): r.dice for r in licenses.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[(1, "MIT (notice)")] == 1.0 and got[(2, "MIT")] > 0.95 and not any(d == 3 for d, _ in got)
    assert (4, "GPL-3.0 (notice)") in got and (4, "GPL-2.0 (notice)") not in got and sum(d == 2 for d, _ in got) == 1
    assert licenses.license_scan(odd_docs).count() == 0 and licenses.license_scan(no_docs).count() == 0


# ---- packing ------------------------------------------------------------------


@given(st.integers(1, 32).flatmap(lambda b: st.tuples(st.just(b), st.lists(st.integers(0, (1 << b) - 1), max_size=300))))
@settings(max_examples=100, deadline=None)
def test_pack_round_trip(case):
    bits, ids = case
    ids = np.array(ids, np.uint32)
    assert (packing.unpack(packing.pack(ids, bits), bits, len(ids)) == ids).all()


@given(st.text(max_size=80))
@settings(max_examples=300, deadline=None)
def test_encoder_equals_tokenizer(text):
    enc = packing.encoder(WORD)
    assert np.frombuffer(enc(text), "<u4").tolist() == enc.whole.encode(text, add_special_tokens=False).ids


def test_packed_files(spark, odd_docs, no_docs):
    folder = shared_dir(spark)
    rows = sorted(packing.packed(odd_docs, WORD, folder, 49_408).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [None, 1, 2, 2, 3, 4, 5, 6]
    enc, at = packing.encoder(WORD), 0
    texts = {r.doc_id: r.text or "" for r in odd_docs.collect()}
    for r in rows:
        ids = np.array(enc.whole.encode(texts[r.doc_id], add_special_tokens=False).ids + [2], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    fs, base = packing.store(folder)
    import json

    name = json.loads(fs.open_input_file(f"{base}/manifest.json").read())["files"][0]["name"]
    f = packing.PackedFile(fs, f"{base}/{name}")
    assert f.ids(0, f.n_ids)[3:9].tolist() == f.ids(3, 9).tolist()
    assert packing.packed(no_docs, WORD, shared_dir(spark), 49_408).count() == 0


# ---- classifier ---------------------------------------------------------------


def test_sum_of_squares_identity():
    m = factorisation.Machine(dims=50, rank=3)
    m.w[:] = np.linspace(-1, 1, 50)
    idx, x = np.array([3, 9, 20, 41]), np.array([0.5, 1.0, 0.2, 2.0], np.float32)
    pairs = sum(float(m.v[idx[a]] @ m.v[idx[b]]) * x[a] * x[b] for a in range(4) for b in range(a))
    assert m.margins(idx, x, np.zeros(1, np.int64))[0] == pytest.approx(float(m.w[idx] @ x) + pairs, rel=1e-4)


def test_classifier_learns_and_handles_odd_rows(spark, odd_docs, no_docs):
    rng = np.random.default_rng(0)
    rows = [(k, " ".join(rng.choice(["fine", "good", "calm", "clear"] if k % 3 else ["spam", "buy!!", "###", "now"], 60)), 300) for k in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    labels = spark.createDataFrame([(k, int(k % 3 > 0), 0) for k in range(600)] + [(None, 1, 0), (7, None, 0)], "doc_id long, quality int, toxic int")
    machine = factorisation.fitted(docs, labels)
    got = [r for r in factorisation.scored(docs, machine).collect() if r.held_out]
    assert got and np.mean([r.predicted == (r.doc_id % 3 > 0) for r in got]) > 0.98
    assert factorisation.scored(odd_docs, machine).count() == odd_docs.count()
    assert factorisation.scored(no_docs, machine).count() == 0
    twice = factorisation.fitted(docs.unionByName(docs), labels.unionByName(labels))
    assert (twice.w == machine.w).all() and (twice.v == machine.v).all()  # repeated documents and labels count once
    scores = {r.doc_id: r.score for r in factorisation.scored(odd_docs, machine).collect()}
    kept = factorisation.accepted(odd_docs, machine)
    assert kept.columns == odd_docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in odd_docs.collect() if scores[r.doc_id] >= 0.5)
    assert factorisation.accepted(odd_docs, machine, 0.0).count() == odd_docs.count() and factorisation.accepted(no_docs, machine).count() == 0
    assert factorisation.accepted(odd_docs.drop("n_chars"), machine).columns == [c for c in odd_docs.columns if c != "n_chars"]
    empty = factorisation.fitted(docs, labels.filter("doc_id < 0"))
    assert {r.score for r in factorisation.scored(odd_docs, empty).collect()} == {0.5}


# ---- token counts -------------------------------------------------------------


@given(st.lists(st.text("abcd", min_size=1, max_size=9), min_size=1, max_size=20))
@settings(max_examples=100, deadline=None)
def test_trie_counts_equal_plain_search(words):
    model = token_counts.Unigram({"a": -2.0, "ab": -2.5, "bc": -2.0, "abc": -4.0, "d": -1.0, "cd": -1.5}, -10.0)

    def plain(w):
        best = [(0.0, 0)]
        for e in range(1, len(w) + 1):
            options = [(best[e - 1][0] - 10.0, -best[e - 1][1] - 1)]
            options += [(best[s][0] + model.scores[w[s:e]], -best[s][1] - 1) for s in range(e) if w[s:e] in model.scores]
            top = max(options)
            best.append((top[0], -top[1]))
        return best[-1][1]

    assert model.counts(set(words)) == {w: plain(w) for w in words}


def test_token_counts_near_the_library(spark):
    """Of ranks made probabilities, the best sum need not be the merges' own result; the counts lie close."""
    import sentencepiece

    path = P.path("piece_bpe_32k.model")
    own = sentencepiece.SentencePieceProcessor(model_file=path)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: r.n_tokens for r in token_counts.token_counts(docs, path).collect()}
    want = {r.doc_id: sum(map(len, own.encode((r.text or "").split()))) for r in docs.collect()}
    print("all", sum(got.values()) / sum(want.values()), "a document", max(abs(got[k] / max(1, want[k]) - 1) for k in want))
    assert abs(sum(got.values()) / sum(want.values()) - 1) < 0.1


def test_token_counts_odd_rows(odd_docs, no_docs):
    path = P.path("piece_bpe_32k.model")
    rows = {r.doc_id: r for r in token_counts.token_counts(odd_docs, path).collect()}
    assert (rows[3].n_words, rows[3].n_tokens) == (0, 0) and rows[5].n_tokens % 50_000 == 0
    assert token_counts.token_counts(no_docs, path).count() == 0


# ---- private ------------------------------------------------------------------

BASE = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 13 <= len(re.sub(r"\D", "", s)) <= 19 and private.luhn(re.sub(r"\D", "", s))), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(re.sub(r"\D", "", s)) <= 15),
]


@given(st.text("019.@-+ a(éx_%\n", max_size=60))
@settings(max_examples=1500, deadline=None)
def test_base_spans_equal_patterns(text):
    want = ",".join(f"{k}:{m.start()}:{m.end()}" for k, p, ok in BASE for m in re.finditer(p, text) if ok(m[0]))
    assert private.listed(private.spans_of(text), private.BASE) == want


def test_cues_and_odd_rows(odd_docs, no_docs):
    s = private.spans_of("IBAN: GB82 WEST 1234 5698 7654 32, SSN 123-45-6789, account no. 12345678 at https://me:pw@host.org/x")
    assert all(len(s[k]) == 1 for k in ("iban", "ssn", "account", "login"))
    for text, want in (
        ('x token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" y', ["24be64439e3e49cf46b2d7c90f3602a3d0b907ff"]), ("API_KEY: AbCdEf0123456789x", ["AbCdEf0123456789x"]), ("a token of my gratitude and esteem1", []),
        ("secret: abcdefghijklmnopqrstuvwx", []), ("token=" + "a1" * 8 + " token " + "b2" * 9, ["a1" * 8, "b2" * 9]), ("token secret = 0123456789abcdef", ["0123456789abcdef"]),
    ):
        assert [text[a:b] for a, b in private.spans_of(text)["secret"]] == want
    text = "see averylongschemename+with.parts-of-it://me:pw@host.org/x"
    assert [text[a:b] for a, b in private.spans_of(text)["login"]] == ["averylongschemename+with.parts-of-it://me:pw@host.org"]
    for text, kind, want in (
        ("ssn 000-12-3456", "ssn", []), ("SSN: 123-45-67890", "ssn", []), ("iban GB82 WEST 1234 5698 7654 33", "iban", []), ("Acct 12345678 account # 87654321", "account", ["12345678", "87654321"]), ("account 1234567", "account", []),
    ):
        assert [text[a:b] for a, b in private.spans_of(text)[kind]] == want
    rows = private.personal_data(odd_docs).collect()
    assert len(rows) == odd_docs.count() and {r.base_sha256 for r in rows} == {hashlib.sha256(b"").hexdigest()}
    assert private.personal_data(no_docs).count() == 0


# ---- mixing -------------------------------------------------------------------


def test_mixing_draws_poisson(spark, odd_docs, no_docs):
    docs = spark.range(6000).selectExpr("id doc_id", "'some text' text", "case when id < 4000 then 'a' else 'b' end source", "9L n_chars")
    got = mixing.mixed(docs, {"a": 0.5, "b": 0.5}).cache()
    n = {r.source: r["count"] for r in got.groupBy("source").count().collect()}
    assert abs(n["a"] - 3000) < 250 and abs(n["b"] - 3000) < 250
    assert sorted(got.collect()) == sorted(mixing.mixed(docs, {"a": 0.5, "b": 0.5}).collect())
    parts = got.withColumn("part", F.spark_partition_id()).groupBy("part").agg(F.collect_list("__order").alias("keys")).collect()
    assert all(r["keys"] == sorted(r["keys"]) for r in parts)
    assert set(mixing.mixed(odd_docs).columns) == {*odd_docs.columns, "__copy", "__order"} and mixing.mixed(no_docs).count() == 0
