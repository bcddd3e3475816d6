"""Extraction, its suffix array, and the pipeline."""

import html
import random
import re
import time

import numpy as np
import pytest

import corpus_pipeline
from parcelframe.llm import decontamination, html_extract as H, near_dedup
from parcelframe.llm.common import stored

from .conftest import clash, docs_of

SF = "/root/testdata/sf0.001"


def test_articles_of_all_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r for r in H.extract(pages).collect()}
    rows = pages.collect()
    assert len(got) == len(rows)
    for p in rows:
        article = re.search(r"<article>(.*?)</article>", p.html, re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", x.replace("<br>", " "))).split()) for x in re.split(r"</?(?:p|h1)>", article)]
        want = "\n".join(x for x in parts if x)
        assert got[p.page_id].text == want and got[p.page_id].n_chars == len(want) and got[p.page_id].url == p.url


@pytest.mark.parametrize("page,want", [
    (None, []), ("", []), ("plain  text", ["plain text"]), ("<p>a<p>b", ["a", "b"]),
    ("<main><h1>T &amp; t</h1><p>a <i>b</i>c<br>d</p></main>open<footer>f", ["T & t", "a bc d"]),
    ("<article><p>x</p><aside>y</aside><form>z</form><div class='share-box'>s</div><p>end</article><div id=comments><article>no</article></div>", ["x", "end"]),
    ("<body><nav>n</nav><p>one &lt;b&gt; &#233;</p><script>var t='</p>x';</script><style>p{}</style><div hidden>h</div>two", ["one <b> é", "two"]),
    ("<article><!-- <p>no</p> --><p title='a>b'>yes</p><script>unclosed", ["yes"]),
    ("<div role=main>in<div role='navigation'>out</div></div><div class='cookie-notice'>c</div>", ["in"]),
    ("<p>a</p><header>h</header><noscript>n</noscript><textarea>t</textarea><select><option>o</select>b", ["a", "b"]),
    ("a < b and <3 &unknown; &amp", ["a < b and <3 &unknown; &"]),
    ("<html class='menu'><body class='has-sidebar comments'><p>a</p><div class='sidebar'>s</div>", ["a"]),
    ("<body class='no-comments'><div class='with-menu'><p>a</p></div><div id='main-nav'>n</div>", ["a"]),
    ("<article class='post share-enabled share'><p>a</p><div class='share-box'>s</div></article>", ["a"]),
    ("<nav>n</nav><main id='content-with-menu' class='menu'>a<div class='related posts'>r</div></main>", ["a"]),
    ("<div class='menu'>m<main>a</main></div><div id='comments'><article>c</article></div>", ["a"]),
    ("<div class='sidebar page'><div>s</div><article>a<nav>n</nav></article></div>", ["a"]),
    ("<div class='sidebar'><article>teaser</article></div><p>a</p>", ["a"]),
    ("<nav><article>n</article></nav><div class='sidebar'>s</div>", []),
])
def test_blocks(page, want):
    found = H.blocks_of(page)
    main = [t for z, t in found if z == H.MAIN]
    assert (main or [t for z, t in found if z == H.OPEN]) == want


@pytest.mark.parametrize("seed", range(8))
def test_suffix_array_covers_repeated_runs(seed):
    rng = random.Random(seed)
    for _ in range(40):
        streams = [np.array([rng.randint(1, 2) for _ in range(rng.randint(0, 30))], np.int64) for _ in range(rng.randint(0, 5))]
        for i, (s, got) in enumerate(zip(streams, H.repeated(streams))):
            want = np.zeros(len(s), bool)
            for a in range(len(s) - H.LONG + 1):
                run = tuple(s[a:a + H.LONG])
                if any(tuple(t[b:b + H.LONG]) == run for j, t in enumerate(streams) if j != i for b in range(len(t) - H.LONG + 1)):
                    want[a:a + H.LONG] = True
            assert (want == got).all()


@pytest.mark.parametrize("shard", [1 << 20, 300])
def test_unmarked_boilerplate_of_a_host_goes(spark, words, monkeypatch, shard):
    monkeypatch.setattr(H, "SHARD", shard)
    rng = random.Random(1)
    menu, foot = " ".join(words[:12]), " ".join(words[20:32])
    rows, want = [], {}
    for i in range(40):
        own = " ".join(rng.choices(words[40:], k=60))
        rows.append((i, "http://h.net/%d" % i, f"<div>{menu}</div><p>{own}</p><div>{foot}</div>"))
        want[i] = own
    rows += [(100, "http://other.net/", f"<div>{menu}</div>"), (101, "http://h.net/m", f"<article>{menu}</article>"),
             (102, None, f"<p>{menu}</p>"), (103, "http://twin.net/", "<p>" + menu + "</p>"), (103, "http://twin.net/", "<p>" + menu + "</p>")]
    want |= {100: menu, 101: menu, 102: menu, 103: menu}  # once on a host, marked, or the same page twice
    pages = clash(spark.createDataFrame(rows, "page_id long, url string, html string"))
    got = H.extract(pages).collect()
    assert len(got) == len(rows) and all(r.text == want[r.page_id] and r.n_chars == len(r.text) for r in got)
    assert H.extract(pages.limit(0)).count() == 0


def test_passages_of_two_pages_go_whatever_the_host_holds(spark, words, monkeypatch):
    """Passages that few pages of a host share, in one suffix array and dealt into shards."""
    rng = random.Random(6)
    rows, want = [], {}
    passage = [" ".join(rng.choices(words, k=rng.randint(8, 14))) for _ in range(12)]
    for i in range(60):
        own = " ".join(rng.choices(words, k=40))
        rows.append((i, "http://h.net/%d" % i, f"<p>{own}</p>" + (f"<div>{passage[i % 12]}</div>" if i < 30 else "")))
        want[i] = own
    alone = " ".join(rng.choices(words, k=30))
    rows += [(100 + i, "http://h.net/copy", f"<p>{alone}</p>") for i in range(6)]  # equal pages don't erase each other
    marked = " ".join(rng.choices(words, k=9))
    rows += [(200, "http://h.net/a", f"<article>text</article><footer>{marked}</footer>"), (201, "http://h.net/b", f"<p>{marked}</p><p>rest</p>")]
    want |= {100 + i: alone for i in range(6)} | {200: "text", 201: "rest"}
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for shard in (1 << 20, 200):
        monkeypatch.setattr(H, "SHARD", shard)
        assert {r.page_id: r.text for r in H.extract(pages).collect()} == want, shard


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, seen = seen, stored(stage(spark, seen, SF), name)
        assert seen.columns == columns
        assert seen.join(before, columns, "left_anti").count() == 0  # only rows that came in
        if name == "near_dedup":
            again = near_dedup.near_duplicates(before).where("kept").select("doc_id")
            assert sorted(r.doc_id for r in again.collect()) == sorted(r.doc_id for r in seen.select("doc_id").collect())
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    assert decontamination.contamination(seen, bench).where("contaminated").count() == 0
    pieces = corpus_pipeline.run(spark, SF)
    ids = {r.doc_id for r in seen.select("doc_id").collect()}
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} == ids


def test_pipeline_takes_odd_rows(spark, words, tmp_path):
    base = " ".join(words[:90])
    docs = clash(docs_of(spark, [None, "", base, base, base + " more", "x " * 3000], ids=[None, 1, 2, 2, 3, 4], sources=[None, "s", "t"]))
    for table, rows in (("labels", spark.createDataFrame([(2, 1, 0)], "doc_id long, quality int, toxic int")),
                        ("benchmark", spark.createDataFrame([(1, "nothing like it here")], "item_id long, text string"))):
        rows.write.parquet(str(tmp_path / f"{table}.parquet"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {p.doc_id for p in pieces} == {None, 1, 2, 4}
    empty = str(tmp_path / "none")
    for table in ("labels", "benchmark", "documents"):
        spark.read.parquet(str(tmp_path / f"{table}.parquet")).limit(0).write.parquet(f"{empty}/{table}.parquet")
    assert corpus_pipeline.run(spark, empty).count() == 0


_OLD_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)


@pytest.mark.parametrize("seed", range(40))
def test_markup_as_one_pattern_finds_it(seed):
    """The linear reader finds what a plain (quadratic) pattern finds, in broken pages too."""
    rng = random.Random(seed)
    bits = ["<", ">", '"', "'", "a", " x=", "</p", "<p", "<b>", "<!--", "-->", "<!", "<?", "=", "/", "\n", "<a href='q'>", '<i "', "é"]
    for _ in range(200):
        page = "".join(rng.choices(bits, k=rng.randint(0, 40)))
        markup, at, got = H._Markup(page), 0, []
        while at < len(page):
            begin, end, m, stop = markup.pieces(at)
            if begin < len(page):
                got.append((begin, end, m and (m[1], m[2], page[m.end():stop])))
            at = end
        assert got == [(m.start(), m.end(), m[2] and (m[1], m[2], m[3])) for m in _OLD_TOKEN.finditer(page)]


@pytest.mark.parametrize("page", ["<a x " * 200_000, "<a x=\"" * 150_000, "<a x=\"'" * 120_000, "<!" * 500_000, "<span>" * 80_000 + "</p>" * 120_000,
                                  "<p><div>" + "<span>" * 80_000 + "</p>" * 120_000, "<dl><dd><b>" * 90_000, "<a '" + "<b \"" * 200_000, "<li><i>" * 140_000])
def test_broken_pages_of_a_megabyte(page):
    began = time.process_time()
    H.blocks_of(page)
    assert time.process_time() - began < 8  # a quadratic reader takes an hour
