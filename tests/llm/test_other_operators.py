"""HTML extraction, embeddings, chat formatting, the pipeline and the registration."""

import itertools
import zlib
from collections import Counter
from functools import partial

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cootensor.llm import chat, html, neardup, queries
from cootensor.llm.frames import pair_components, read_table

PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var a="</p><p>x";</script></head><body>
<header class="site-header"><h1>Site</h1></header><div id="main-menu"><a href="/a>b" title='q"'>menu</a></div>
<main><article><header><h1>T &amp;amp; U&nbsp; V</h1></header><p>one
  two<p>three <b>bold<br>text</b><div class="ad-slot">buy</div><ul><li>a<li>b</ul><!-- c <p>no</p> -->
<section class="comments"><p>reader</p></section><form>f</form></article></main><div class="cookie-notice">n</div><footer>f</footer>"""


def test_html_page_rules():
    assert html.Page(PAGE).text(set()).split("\n") == ["T &amp; U V", "one two", "three bold text", "a", "b"]
    assert html.Page(None).text(set()) == "" and html.Page("").text(set()) == ""
    assert html.Page("<p>a<p>b</div></i>c <b>d").text(set()) == "a\nb\nc d"
    assert html.Page("plain & simple &lt;x&gt;").text(set()) == "plain & simple <x>"


def test_html_site_template_is_removed(spark):
    words = lambda i: " ".join(f"w{i}_{k}" for k in range(30))
    box = "<div><p>Every page of this site says this.</p></div>"
    rows = [(i, "http://a.example/x%d" % i, f"<body><p>{words(i)}</p>{box}<p>{words(1000 + i)}</p></body>", "u") for i in range(8)]
    rows += [(100 + i, "http://b.example/", f"<body><p>{words(7)}</p>{box}</body>", "u") for i in range(8)]      # copies are no template
    rows += [(200, None, f"<p>x</p>{box}", "u"), (201, "nonsense", None, "u"), (202, "http://a.example/", "", "u")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = {r.page_id: r for r in html.extract(pages, ["page_id", "url", "text"]).select("row.page_id", "text", "n_chars").collect()}
    assert len(got) == len(rows)
    for i in range(8):
        assert got[i].text == f"{words(i)}\n{words(1000 + i)}" and got[i].n_chars == len(got[i].text)
        assert "Every page" in got[100 + i].text
    assert "Every page" in got[200].text and got[201].text == got[202].text == ""
    assert html.extract(pages.limit(0), ["page_id"]).count() == 0


def test_html_keeps_the_article_of_every_page(spark, sf):
    import re
    pages = {r.page_id: r.html for r in read_table(spark, sf, "pages").collect()}
    got = queries.op5_html_extraction(spark, sf).collect()
    assert len(got) == len(pages)
    for r in got:
        a = re.search(r"<article>(.*?)</article>", pages[r.page_id], re.S)[1]
        want = [" ".join(__import__("html").unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", a)]
        assert r.text == "\n".join(x for x in want if x)


def near_brute(rows, threshold):
    good = [(i, np.asarray(e, float), lab) for i, e, lab in rows
            if e is not None and lab is not None and None not in e and np.isfinite(np.asarray(e, float)).all() and np.any(np.asarray(e, float))]
    links = [(a[0], b[0]) for a, b in itertools.combinations(good, 2) if a[2] == b[2] and len(a[1]) == len(b[1])
             and a[1] @ b[1] / np.sqrt((a[1] @ a[1]) * (b[1] @ b[1])) >= threshold]
    up = {i: i for i, *_ in rows}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        up[b] = a
    n = Counter(x for p in links for x in p)
    return {i: (n[i], find(i), find(i) == i) for i in up}


def test_near_duplicates_match_brute_force(spark):
    rng = np.random.default_rng(5)
    rows, dim = [], 24
    for lab in range(3):
        for _ in range(150):
            rows.append((len(rows), rng.standard_normal(dim).tolist(), lab))
        big = rng.standard_normal(dim)
        for _ in range(80):                                           # a group larger than any list
            rows.append((len(rows), (big + 0.1 * rng.standard_normal(dim)).tolist(), lab))
        for _ in range(40):                                           # pairs
            x = rng.standard_normal(dim)
            rows += [(len(rows), x.tolist(), lab), (len(rows) + 1, (x + 0.2 * rng.standard_normal(dim)).tolist(), lab)]
        x = rng.standard_normal(dim).tolist()
        rows += [(len(rows) + k, x, lab) for k in range(5)]           # equal vectors
    rows += [(len(rows), [0.0] * dim, 1), (len(rows) + 1, None, 1), (len(rows) + 2, [float("nan")] * dim, 1),
             (len(rows) + 3, rows[0][1], None), (len(rows) + 4, [None, *rows[0][1][1:]], 0), (len(rows) + 5, [1.0, 2.0], 0),
             (len(rows) + 6, [2.0, 4.0], 0)]
    report = {}
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in neardup.near_duplicates(df, report=report).collect()}
    want = near_brute(rows, 0.93)
    assert report["recall"] >= 0.98
    same = sum(got[i] == want[i] for i in want) / len(want)
    assert len(got) == len(want) and same >= 0.97
    assert sum(w[0] for w in want.values()) >= sum(g[0] for g in got.values()) >= 0.97 * sum(w[0] for w in want.values())
    assert neardup.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("block", [neardup.BLOCK, 1])
def test_near_duplicates_are_exact_whatever_the_graph_finds(spark, monkeypatch, block):
    rng = np.random.default_rng(6)
    rows = [(i, rng.standard_normal(16).tolist(), i % 2) for i in range(600)]
    for i in range(0, 120, 3):                                        # pairs and a chain
        rows.append((len(rows), (np.array(rows[i][1]) + 0.15 * rng.standard_normal(16)).tolist(), i % 2))
    for _ in range(30):
        rows.append((len(rows), (np.array(rows[-1][1]) + 0.2 * rng.standard_normal(16)).tolist(), 1))
    monkeypatch.setattr(neardup, "_first_graph", lambda nodes, kind, size: spark.createDataFrame([], "u long, v long, sim double"))
    monkeypatch.setattr(neardup, "_count_links", partial(neardup._count_links, block=block))
    got = neardup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got} == near_brute(rows, 0.93)


def test_pair_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 7)]
    got = {r.node: r.component for r in pair_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}


def test_chat_roles_on_held_out_conversations(spark, sf):
    turns = read_table(spark, sf, "conversations")
    got = queries.op9_chat_formatting(spark, sf).join(turns.select("conv_id", "turn", "role"), ["conv_id", "turn"])
    held = got.where("held_out").agg(F.count("*").alias("n"), F.avg((F.col("role") == F.col("role_pred")).cast("int")).alias("ok")).first()
    assert held.n > 10 and held.ok > 0.8


@pytest.mark.parametrize("block", [4096, 3])
def test_chat_blocks_do_not_change_the_best_path(spark, sf, block):
    turns = read_table(spark, sf, "conversations").withColumn("conv_id", F.lit(1))
    model = chat.train(read_table(spark, sf, "conversations"), F.lit(True))
    rows = turns.select("conv_id", "turn", "text").distinct().withColumn("x", F.xxhash64("text"))
    ordered = [(r.turn, r.text) for r in rows.orderBy("turn", "x").collect()]
    path = [model.roles[p] for p in model.decode(model.steps([t for _, t in ordered], True))]
    want, at = {}, 0
    for key in ordered:
        want[key] = path[at]
        at += len(key[1].split("\n"))
    got = chat.format_turns(rows.drop("x"), model, ["conv_id", "turn", "text"], block=block).select("row.*", "role_pred").collect()
    assert len(got) == len(ordered) and all(want[r.turn, r.text] == r.role_pred for r in got)


def test_chat_markers_rendering_and_odd_rows(spark, sf):
    model = chat.train(read_table(spark, sf, "conversations"), F.lit(True))
    rows = [(1, 0, "User: what is it?\nAssistant: a thing.\nIt is long."), (None, 0, "x"), (None, None, None), (2, 0, None), (2, 0, "")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, text string")
    got = chat.format_turns(turns, model, ["conv_id"]).select("row.conv_id", "role_pred", "n_turns", "rendered").collect()
    assert len(got) == 5
    first = next(r for r in got if r.conv_id == 1)
    assert first.rendered == "<|user|>\nwhat is it?<|end|>\n<|assistant|>\na thing.\nIt is long.<|end|>" and first.n_turns == 2
    assert chat.format_turns(turns.limit(0), model, ["conv_id"]).count() == 0
    blank = chat.train(spark.createDataFrame([], "conv_id long, turn long, text string, role string"), F.lit(True))
    assert {r.role_pred for r in chat.format_turns(turns, blank, ["conv_id"]).collect()} == {"user"}


def test_pipeline_stages_keep_columns_and_take_effect(spark, sf, odd):
    secret = spark.createDataFrame([(50, "Here is the one that has a password=hunter2hunter2 in it, and that is all.", "en", "s", 9, "r", "n", 1)], odd.schema)
    docs = odd.unionByName(secret)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, name
        docs = spark.createDataFrame(out.collect(), docs.schema)
    left = {r.doc_id: r for r in docs.collect()}
    assert 2 not in left and 5 not in left and 7 not in left and 1 in left and None in left
    assert left[50].text == "Here is the one that has a [secret] in it, and that is all." and left[50].n_chars == len(left[50].text)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).count() == docs.count()


def test_pipeline_drops_contaminated_documents(spark, sf):
    got = corpus_pipeline.run(spark, sf)
    assert 0 < got.count() < read_table(spark, sf, "documents").count()


def test_registered_queries():
    import __spark_entry__ as entry
    names = [n for n in entry.queries() if n.startswith("op") and n[2].isdigit()]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in entry.queries()
    assert zlib.crc32(b"1") % 3 in (0, 1, 2)
