import re
import time
import tracemalloc

import numpy as np
import pytest

from partmill.llm import templates

PAGE = '<html><head><title>T</title><style>p{}</style></head><body><header><h1>Site</h1></header><nav><a href=x>Menu</a></nav><div class="cookie">We use cookies</div><article><h1>Head &amp; tail</h1><p>One <b>bold\n  word<br>next<p>Two &eacute;<script>var a="<'
PAGES = "page_id long, url string, html string"


def texts(spark, rows, schema=PAGES, **more) -> dict:
    return {r.page_id: r.text for r in templates.extracted(spark.createDataFrame(rows, schema), **more).collect()}


def prose(k: int, n: int = 60) -> str:
    return " ".join(f"w{x}" for x in np.random.default_rng(k).integers(0, 5000, n))


def test_main_text():
    assert templates.main_text(PAGE)[0] == "Head & tail\nOne bold word next\nTwo é"
    assert templates.main_text("")[0] == "" and templates.main_text("plain &lt;text")[0] == "plain <text"
    story = '<body><div class="entry"><p>One</p></div><div>Menu</div><div class="entry"><p>Two</p></div></body>'
    assert templates.main_text(story)[0] == "One\nTwo"


def test_site_template_goes(spark):
    """By shape, however the texts vary, without any list; hosts of few pages and broken addresses have no template."""
    page = lambda k: f"<body><div class=x{k}><ul>{'<li><a href=a>{}</a></li>'.format(prose(k, 2)) * (1 + k % 3)}</ul></div><div><p>{prose(k)}</p><p>{prose(k + 1)}</p></div><div><span>{prose(k + 2, 5)}</span></div></body>"
    rows = [(k, "http://a.example/x", page(k)) for k in range(12)] + [(50, None, None), (51, "::broken", page(3)), (50, None, None), (52, "http://b.example", page(4))]
    got = texts(spark, rows, lists=False)
    assert all(got[k] == f"{prose(k)}\n{prose(k + 1)}" for k in range(12))
    assert got[50] == "" and got[51].startswith(prose(3, 2)) and got[52].startswith(prose(4, 2))


def test_recurring_blocks_within_the_content(spark):
    """A short line at the edge of every article is template; a line of some pages, a long passage and one amid the text are not."""
    some, long = "Seen on some pages.", prose(999, 40)

    def page(k):
        return f"<body><nav>Menu</nav><article><p>{prose(k)}</p><p>Amid all.</p><p>{long}</p><p>{prose(k + 50)}</p><p>{some if k % 3 == 0 else prose(k + 80, 9)}</p><div>Get our letter.</div></article></body>"

    got = texts(spark, [(k, "http://a.example/x", page(k)) for k in range(15)])
    for k in range(15):
        assert got[k].split("\n") == [prose(k), "Amid all.", long, prose(k + 50), some if k % 3 == 0 else prose(k + 80, 9)]


def test_copies_count_once(spark):
    """Eight near copies on one host are one content: nothing of them is template."""
    page = lambda k: f"<body><article><p>Same first line.</p><p>{prose(1, 300)} v{k}</p><p>Same last line.</p></article></body>"
    got = texts(spark, [(k, "http://a.example/x", page(k)) for k in range(8)])
    assert all(t.startswith("Same first line.") and t.endswith("Same last line.") for t in got.values())


def test_counts_equal_plain_ones(spark):
    """Pages of each recurring subtree, then contents of each hash, against counts in Python over all pages of a table."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    profiled = templates.profiles(pages).cache()
    repeated = templates.Known(templates.repeats(profiled), profiled)
    got = {(r.kind, r.key): (r.n, r.common) for r in templates.site_templates(profiled, repeated).collect()}
    read, on_pages = {}, {}
    for r in pages.collect():
        host = re.match(r"^[a-z]+://([^/?#:]*)", r.url or "")
        host = host[1].lower() if host else ""
        read[host, r.html or ""] = templates.hashed(templates.tree(r.html or ""), host)
        for n in read[host, r.html or ""][0]:
            on_pages.setdefault(n.key, set()).add((host, r.html or ""))
    often = {k for k, v in on_pages.items() if len(v) >= templates.PAGES}
    assert {r.key for r in repeated.found.collect()} == often
    seen, whole = {}, {}
    for (host, _), (found, parents, own) in read.items():
        lows = templates.lows(own, len(found))

        def dead(k, found=found, parents=parents):
            return k >= 0 and (found[k].key in often or dead(parents[k]))

        content = min((low for k, (n, low) in enumerate(zip(found, lows)) if n.words and not dead(k)), default=0)
        whole.setdefault(host, set()).add(content)
        for n in found:
            seen.setdefault(("shape", n.shape), (host, set()))[1].add(content)
            if n.key in often:
                seen.setdefault(("exact", n.key), (host, set()))[1].add(content)
    want = {k: (len(v), len(v) >= templates.SHARE * len(whole[h])) for k, (h, v) in seen.items() if len(v) >= templates.PAGES}
    assert got == want and len(want) > 50


@pytest.mark.parametrize("words", [10, 20, 40, 100, 300])
@pytest.mark.parametrize("hashes", [templates.HASHES, 0])
def test_large_menus_go_and_short_articles_stay(spark, monkeypatch, words, hashes):
    """By the counts alone, whatever part of the page is template; also where recurring hashes are joined to pages."""
    monkeypatch.setattr(templates, "HASHES", hashes)
    menu = "".join(f"<a href=/{k}>{prose(k + 500, 3)}</a> " for k in range(60))
    page = lambda k: f"<body><div>{menu}</div><div><p>{prose(k, words // 2)}</p><p>{prose(k + 100, words - words // 2)}</p></div><div>{prose(7, 80)}</div></body>"
    rows = [(k, f"http://a.example/{k}", page(k)) for k in range(50)]
    got = texts(spark, rows, lists=False)
    assert got == {k: f"{prose(k, words // 2)}\n{prose(k + 100, words - words // 2)}" for k in range(50)}


def test_copies_beside_other_articles_stay(spark):
    """An article that twenty pages copy is one content, and no template, whatever the menu weighs."""
    page = lambda k: f"<body><div>{prose(900, 200)}</div><div><p>{prose(k)}</p><p>{prose(k + 100)}</p></div><div>{prose(901, 90)}</div></body>"
    rows = [(k, f"http://a.example/{k}", page(max(0, k - 20)).replace("</div></body>", f"</div><!-- {k} --></body>")) for k in range(30)]
    got = texts(spark, rows, lists=False)
    assert got == {k: f"{prose(max(0, k - 20))}\n{prose(max(0, k - 20) + 100)}" for k in range(30)}


def test_flat_pages(spark):
    """Menus and footers beside the article's paragraphs, several of them."""
    page = lambda k: f"<body><ul><li>{prose(900, 200)}</li></ul><div>{prose(903, 50)}</div><p>{prose(k)}</p><p>{prose(k + 100)}</p><div>{prose(902, 40)}</div><div>{prose(901, 90)}</div></body>"
    got = texts(spark, [(k, f"http://a.example/{k}", page(k)) for k in range(12)], lists=False)
    assert got == {k: f"{prose(k)}\n{prose(k + 100)}" for k in range(12)}


def test_a_teaser_is_not_the_main_text():
    page = f"<body><main><p>{prose(1)}</p><article><a href=x>{prose(2, 8)}</a></article><p>{prose(3)}</p></main></body>"
    assert templates.main_text(page)[0].split("\n") == [prose(1), prose(2, 8), prose(3)]


def test_deep_and_broken_markup_in_little_memory_and_time():
    """Memory by the page's size, whatever its depth; stray end tags and unclosed items take no scan each."""
    tracemalloc.start()
    page = "<div>" * 200_000
    templates.hashed(templates.tree(page))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 100e6, most
    began = time.process_time()
    for page in ("<b>" * 20_000 + "</i>" * 2_000, "<ul><li>" + "<b>" * 20_000 + "<li></li>" * 2_000, "<table>" + "<tr><td>x" * 20_000):
        templates.hashed(templates.tree(page))
    assert time.process_time() - began < 5
    assert templates.rendered(templates.tree("<table><tr><td>a<td>b<tr><td>c</table>d<ul><li>e<li>f<ul><li>g</ul></ul>"), False) == "a\nb\nc\nd\ne\nf\ng"


def test_counts_alone_give_the_main_text(spark):
    """On hosts of 20 pages or more menus, adverts and footers go without any list of elements or classes."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    host = templates.host()
    big = [r.host for r in pages.groupBy(host.alias("host")).count().filter("count >= 20").collect()]
    big = pages.filter(host.isin(big))
    by_counts = {r.page_id: (r.text, r.n_templates) for r in templates.extracted(big, lists=False).collect()}
    both = {r.page_id: r.text for r in templates.extracted(big).collect()}
    assert len(both) >= 20 and {k: t for k, (t, _) in by_counts.items()} == both and all(n == 3 for _, n in by_counts.values())


def test_odd_tables(spark):
    """Empty tables, clashing columns, a very long page, deep markup, nulls."""
    assert templates.extracted(spark.createDataFrame([], PAGES)).count() == 0
    deep = "<div>" * 3000 + "deep" + "</div>" * 3000
    rows = [(1, "http://a.example", "<article>" + "<p>word</p>" * 50_000 + "</article>", "h", 1), (2, None, None, None, None), (None, "http://a.example", deep, "", 0), (2, None, None, None, None)]
    df = spark.createDataFrame(rows, f"{PAGES}, host string, template int").withColumnRenamed("template", "shapes")
    got = templates.extracted(df).collect()
    assert sorted((str(r.page_id), r.n_chars) for r in got) == [("1", 5 * 50_000 - 1), ("2", 0), ("2", 0), ("None", 4)]
