from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from partmill.llm import licenses
from partmill.llm.licenses import TEMPLATES, Templates


def plain(texts: dict[str, str], text: str, least: float = 0.8) -> list[tuple]:
    """Every window of every template scored by itself; then the same choice."""
    words, every = licenses.normal(text), []
    for name, t in texts.items():
        own = Counter(zip(licenses.normal(t), licenses.normal(t)[1:]))
        wide = min(own.total(), len(words) - 1)
        got = []
        for s in range(len(words) - wide):
            window = Counter(zip(words[s : s + wide], words[s + 1 : s + wide + 1]))
            shared = (own & window).total()
            if wide > 0 and 2 * shared >= least * (own.total() + wide) - 1e-9:
                got.append((-shared, s))
        taken: list[int] = []
        for shared, s in sorted(got):
            if all(abs(s - x) >= wide + 1 for x in taken):
                taken.append(s)
                every.append((name, 2 * -shared / (own.total() + wide), -shared, s, s + wide + 1))
    out: list[tuple] = []
    for p in sorted(every, key=lambda p: (-p[2] * p[1], -p[1], p[3], p[0])):
        if all(p[4] <= q[3] or q[4] <= p[3] for q in out):
            out.append(p)
    return sorted(out, key=lambda p: p[3])


SMALL = {"x": "a b c d e f", "y": "a b a b c", "z": "f e d c b a b", "w": "a b"}


@given(st.lists(st.lists(st.sampled_from("abcdefg"), max_size=40).map(" ".join), min_size=1, max_size=4))
@settings(max_examples=400, deadline=None)
def test_passages_equal_all_windows(texts):
    got = Templates(SMALL).found([t.encode() for t in texts])
    assert [[tuple(p) for p in g] for g in got] == [plain(SMALL, t) for t in texts]


def best(text: str) -> dict[str, licenses.Passage]:
    every = Templates(TEMPLATES | licenses.full_texts()).found([text.encode()])[0]
    return {p.license: p for p in every}


def test_best_passage_after_licence_words():
    """Words of the licence before an exact copy don't move the passage."""
    for lead in ("free of charge to any person obtaining a copy of the software without restriction and to permit persons to whom", "the rights to use copy modify merge publish distribute sublicense"):
        p = best(f"{lead} {TEMPLATES['MIT']} tail")["MIT"]
        assert p.dice == 1.0 and p.first == len(licenses.normal(lead))
    got = best("A copy of the License is in the file. " + TEMPLATES["Apache-2.0"])
    assert got["Apache-2.0"].dice == 1.0 and set(got) == {"Apache-2.0"}


@pytest.mark.parametrize("name", ["GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0", "BSD-2-Clause", "BSD-3-Clause", "MPL-2.0"])
def test_alike_headers_are_told_apart(name):
    assert set(best("Some code. " + TEMPLATES[name] + " More code.")) == {name}


@pytest.mark.parametrize("name", sorted(licenses.full_texts()))
def test_full_texts(name):
    whole = licenses.full_texts()[name]
    words = whole.split()
    changed = "Our file. " + " ".join(w for k, w in enumerate(words) if k % 40) + " Other words follow."
    assert max(best(changed).values(), key=lambda p: p.shared).license == name


def test_full_text_headers_by_other_words():
    """Texts that no template holds word for word."""
    program = "This file is part of foo. foo is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."
    assert set(best(program)) == {"GPL-2.0"}
    regents = TEMPLATES["BSD-3-Clause"].replace("the copyright holder", "the University").replace("COPYRIGHT HOLDERS AND CONTRIBUTORS", "REGENTS AND CONTRIBUTORS")
    assert set(best(regents)) == {"BSD-3-Clause"}
    assert not best("You may obtain a copy of this book under the conditions of the shop; the rights of the authors are reserved.")


def test_repeats_and_long_texts(spark):
    rows = [(1, "Released under the MIT License. " * 3 + "word " * 100_000), (None, "Released under the MIT License."), (None, "Released under the MIT License."), (2, None), (3, "")]
    got = licenses.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.license, r.dice, r.n_passages, r.first_word, r.end_word) for r in got) == [("1", "MIT (notice)", 1.0, 3, 0, 5)] + [("None", "MIT (notice)", 1.0, 1, 0, 5)] * 2
