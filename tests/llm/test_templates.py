"""Site templates told by recurring subtrees, on sites without telling elements or English class words."""

import random

from cootensor.llm import html


def _site(k: int, rng: random.Random, wrap: bool = True) -> tuple[str, str]:
    """A page of nested div elements, and its text: menu, notice, side box and foot differ from page to page."""
    word = lambda: "".join(rng.choice("abdegiklmnoprstuv") for _ in range(rng.randint(3, 9)))
    words = lambda n: " ".join(word() for _ in range(n))
    menu = "".join(f'<li><a href="/{word()}">{words(2)}</a></li>' for _ in range(rng.randint(3, 8)))
    own = [words(5), *[words(rng.randint(15, 60)) for _ in range(rng.randint(2, 6))]]
    paragraphs = "".join(f"<p>{p[:9]}<b>{p[9:14]}</b>{p[14:]}</p>" if rng.random() < 0.5 else f"<p>{p}</p>" for p in own[1:])
    links = "".join(f'<li><a href="/{word()}">{words(4)}</a></li>' for _ in range(rng.randint(2, 5)))
    content = f"<h1>{own[0]}</h1>{paragraphs}<ul class=weiter>{links}</ul>"
    if wrap:
        content = f'<div id="inhalt-{k}">{content}</div>'
    return (f'<html><body><div class="oben"><ul>{menu}</ul></div><div class="kasten k{k}">{words(6)}</div>{content}'
            f'<div class="unten"><p>{words(4)}</p><p>Impressum seit 1999</p></div></body></html>'), "\n".join(own)


def test_a_site_without_telling_elements_comes_out_clean(spark):
    rng = random.Random(7)
    pages = [_site(k, rng) for k in range(12)]
    rows = [(k, f"https://seite.example/{k}", x) for k, (x, _) in enumerate(pages)]
    rows += [(100 + k, f"https://allein.example/{k}", x) for k, (x, _) in enumerate(pages[:2])]      # too few pages
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r for r in html.extract(df, ["page_id"]).select("row.page_id", "text", "n_template").collect()}
    for k, (_, text) in enumerate(pages):
        assert got[k].text == text and got[k].n_template > 0
    for k in (0, 1):
        assert got[100 + k].n_template == 0 and pages[k][1] in got[100 + k].text


def test_a_structure_on_many_pages_of_a_large_host_is_a_template(spark):
    """Under half of the host's pages have the side box; by their number alone it goes."""
    rng = random.Random(8)
    with_box = [_site(k, rng) for k in range(html.MANY_PAGES)]
    plain = [f"<body><div><h1>t{k}</h1><p>{' '.join(_site(k, rng)[1].split())}</p></div></body>" for k in range(2 * html.MANY_PAGES)]
    rows = [(k, "https://gross.example/x", x) for k, x in enumerate([x for x, _ in with_box] + plain)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r for r in html.extract(df, ["page_id"]).select("row.page_id", "text", "n_template").collect()}
    assert all("Impressum" not in got[k].text and got[k].n_template for k in range(len(with_box)))
    assert all(got[len(with_box) + k].n_template == 0 for k in range(len(plain)))


def test_copies_of_one_page_are_one_page_and_long_pages_are_read_whole(spark):
    rng = random.Random(9)
    one, text = _site(1, rng)
    long = "<body><div>" + "".join(f"<p>p{k} " + "wort " * 20 + "</p>" for k in range(20_000)) + "</div></body>"
    rows = [(k, "https://kopien.example/x", one, "a", 1) for k in range(30)] + [(99, "https://lang.example/", long, "b", 2)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, template string, _host int")
    got = html.extract(df, ["page_id", "template", "_host"]).select("row.*", "text", "n_template").collect()
    assert all(r.n_template == 0 and text in r.text for r in got if r.page_id < 30)
    assert len(next(r.text for r in got if r.page_id == 99).split("\n")) == 20_000


def test_structure_decides_nothing_in_declared_content():
    page = html.Page("<body><div class=a>x y z</div><article><p><a href=1>one link</a></p><div class=b>own words</div></article></body>")
    shapes = page.hashes()[1]
    assert page.text(frozenset(shapes)) == "one link\nown words" and page.deleted(frozenset(shapes)) == {0}
