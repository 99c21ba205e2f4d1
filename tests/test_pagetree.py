"""Trees of pages that are not well formed, and choices between their nodes."""

import time

from gleanwork.operators import articles, html, pagetree

LONG = "word " * 100


def texts(page, *tags):
    root, _ = pagetree.parsed(page)
    return [n.text() for n in root.all(*tags)]


def test_implied_ends():
    assert texts("<p>one<p>two<div>three</div>four", "p") == ["one", "two"]
    assert texts("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", "li") == ["a", "b c", "c", "d"]
    assert texts("<table><tr><td>1<td>2<tr><td>3</table>after", "td") == ["1", "2", "3"]
    assert texts("<dl><dt>t<dd>d<dt>u</dl>", "dt", "dd") == ["t", "d", "u"]
    assert texts("<p>a <b>bold<p>next", "p") == ["a bold", "next"]
    assert texts("<div>a</span></p>b</div>c", "div") == ["a b"]
    assert texts("<br/><div/>inside", "div") == ["inside"]


def test_unclosed_boilerplate_takes_no_more_than_its_parent():
    page = f"<body><div class='top'><nav><ul><li>menu</div><main><p>{LONG}</p></main><footer>foot</body>"
    assert pagetree.parsed(page)[0].text() == LONG.strip()
    assert html.extract_one(page)[0] == LONG.strip() and articles.parsed_article(page)["text"] == LONG.strip()
    assert texts("<p>a<script>if (a < b) { '</p>' }</script>b<svg><text>t</text></svg>", "p") == ["a b"]


def test_only_the_first_article_may_stand_for_the_page():
    short, hinted = "<article><p>teaser</p></article>", f"<div id='story'><p>{LONG}</p></div>"
    page = f"<body>{short}<article><p>{LONG}</p></article><main><p>main {LONG}</p></main>{hinted}</body>"
    assert articles.parsed_article(page)["text"].startswith("main")
    page = f"<body>{short}<article><p>second {LONG}</p></article><section>plain {LONG * 3}</section>{hinted}</body>"
    assert articles.parsed_article(page)["text"] == LONG.strip()
    page = f"<body><div role='main'><p>role {LONG}</p></div>{hinted}</body>"
    assert articles.parsed_article(page)["text"].startswith("role")
    assert articles.parsed_article("<p>no container</p> loose")["text"] == "no container"
    assert articles.parsed_article("loose <b>text</b>")["text"] == "loose\ntext" and articles.parsed_article(None)["text"] == ""


def test_choice_in_spark_equals_choice_on_nodes(spark):
    pages = {
        1: f"<body><article><p>x</p></article><main><p>{LONG}</p></main></body>", 2: f"<body><article><p>{LONG}</p></article><article><p>{LONG}{LONG}</p></article></body>",
        3: f"<body><div class='content'><p>{LONG}</p></div><div><p>{LONG}{LONG}</p></div></body>", 4: f"<body><section>{LONG}</section><div>small</div></body>", 5: f"<body><section>{LONG}</section></body>", 6: f"<body><div role='main'>{LONG}</div><div id='post'>{LONG}</div></body>",
    }
    df = spark.createDataFrame(list(pages.items()), "page_id long, html string")
    chosen = {r.page_id: (r.tag, r.length) for r in articles.chosen_containers(articles.containers(df)).collect()}
    for key, page in pages.items():
        node = articles._best(pagetree.parsed(page)[0])
        assert chosen[key] == (node.tag, len(node.text()))


def test_measures_equal_what_nodes_hold():
    root, _ = pagetree.parsed("<body>a b<div>  c <p>dd <a href='#'>e  f</a></p><p></p></div><a>g</a></body>")
    for node, (letters, pieces, paragraphs, linked) in pagetree.measures(root).items():
        own = node.pieces()
        assert (letters, pieces) == (sum(map(len, own)), len(own))
        assert paragraphs == len(node.all("p")) - (node.tag == "p") and linked == sum(len(a.text("")) for a in node.all("a")) - (len(node.text("")) if node.tag == "a" else 0)


def test_deep_pages_take_linear_time():
    began = time.time()
    page = "<div class=content>" * 20_000 + "deep text" + "</div>" * 20_000
    assert articles.parsed_article(page)["text"] == "deep text"
    assert time.time() - began < 20
