import html as H
import random
import re
import time

from downfield.llm import html_text as E

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{a:b}</style><script>var a="</p><p>no";</script></head><body>
<header class="top">Site</header><nav><ul><li><a href="/a>b">Home</a></li></ul></nav><div class="ad box">Buy</div><div id="cookie-notice">We use</div>
<article><h1>Title &amp; more</h1><p><b>First   para<br>goes <i>on</i>.<p>Second &lt;tag&gt; with <a href=x>a link</a>.</p><!-- <p>hidden</p> --><form><input value=1>Mail</form>
<ul><li>one<li>two</ul><aside>side</aside></article><section class="comments"><p>Reader says a great many words here, so many that it would be the longest text of this page by far, really.</p></section>
<footer>&copy; x</footer></body></html>"""


def test_article_alone():
    assert E.main_text(PAGE) == "Title & more\n\nFirst para goes on.\n\nSecond <tag> with a link.\n\none\n\ntwo"


def test_without_semantic_elements():
    p = "<p>" + "word and word, " * 20 + "</p>"
    got = E.main_text(f"<body><div><a href=1>x</a> <a href=2>y</a></div><div id=content><h2>Head</h2>{p}{p}</div><div class='side'><a href=3>z</a></div></body>")
    assert got.startswith("Head\n\nword and") and "x" not in got.split() and got.count("\n\n") == 2


def test_odd_pages():
    for page, want in ((None, ""), ("", ""), ("plain", "plain"), ("<p>a", "a"), ("<!-- x", ""), ("<script>a<b", ""), ("a < b <", "a < b <"), ("<p>a</div></p>b", "a\n\nb"), ("&am &#233; &nope;", "&am é &nope;"), ("<nav>x</nav>", "")):
        assert E.main_text(page) == want
    for page in ("<div>" * 50000 + "deep", "<a " * 100000, '<a "' * 20000, "<" * 100000):
        t = time.time()
        E.main_text(page)
        assert time.time() - t < 20


def brute(page):
    """For pages of one article with only headings and paragraphs in it."""
    inner = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    parts = [" ".join(H.unescape(re.sub(r"</?b>", "", x.replace("<br>", " "))).split()) for x in re.split(r"</?(?:p|h1)>", inner)]
    return "\n\n".join(x for x in parts if x)


def test_generated_pages(spark):
    import os

    path = "/root/testdata/sf0.001/pages.parquet"
    if not os.path.exists(path):
        return
    pages = spark.read.parquet(path)
    want = {r["page_id"]: brute(r["html"]) for r in pages.collect()}
    got = E.extract(pages).collect()
    assert {r["page_id"]: r["text"] for r in got} == want and all(r["n_chars"] == len(r["text"]) for r in got)


def test_columns(spark):
    df = spark.createDataFrame([(1, "u", None, "old", 3), (1, "u", "<p>x</p>", "old", 3), (None, None, "é", None, None)], "page_id long, url string, html string, text string, n_chars long")
    got = E.extract(df).collect()
    assert [(r["page_id"], r["text"], r["n_chars"]) for r in got] == [(1, "", 0), (1, "x", 1), (None, "é", 1)]
    assert E.extract(df.limit(0)).count() == 0


def test_text_over_sibling_containers():
    p = lambda k: f"<p>{f'part {k} of it and more, ' * 13}</p>"
    links = "<div>" + "".join(f"<a href={i}>go{i}</a> " for i in range(9)) + "</div>"
    for n, each in ((2, 3), (3, 5), (4, 8)):
        page = f"<body>{links}" + "".join("<div>" + "".join(p(f"{i}x{j}") for j in range(each)) + "</div>" for i in range(n)) + f"{links}</body>"
        got = E.main_text(page).split("\n\n")
        assert len(got) == n * each and [x.split()[1] for x in got] == [f"{i}x{j}" for i in range(n) for j in range(each)]
    got = E.main_text(f"<body>{links}<div><p>{'A lead that stands beside the text. ' * 6}</p></div><div>{p(1)}{p(2)}{p(3)}</div>{links}</body>")
    assert got.startswith("A lead") and got.count("part 3") == 13 and "go1" not in got


def test_names_of_articles_own_parts_stay():
    p = "word and word, " * 20
    page = f"""<body><nav>x</nav><article><h1>Head</h1><p>{p}</p><h2 id="social-impact">Impact</h2><div class="share-price"><p>Price of a share</p></div>
    <p class="notice-board">Board</p><h2 id="comments">On comments</h2><section id="related-work"><p>Work</p></section><p>Mass <math><mi>E</mi><mo>=</mo><mi>m</mi><annotation encoding=TeX>E=m</annotation></math> here</p>
    <object data=x.swf>Fallback words</object><label>A label outside</label><div class="share-buttons">Tell</div><div class="site-sidebar2">Side</div><div class="ad-slot top">Buy</div><ul class="comments-list"><li>Me too</ul>
    <div id="comments">First!</div></article></body>"""
    got = E.main_text(page).split("\n\n")
    assert got == ["Head", p.strip(), "Impact", "Price of a share", "Board", "On comments", "Work", "Mass E=m here", "Fallback wordsA label outside"]


def test_long_attributes():
    value = "a > b " * 5000
    for quote in "\"'":
        assert E.main_text(f"<article><p>One <img alt={quote}{value}{quote}> two</p></article>") == "One two"


def test_what_stands_beside_the_densest_node():
    p = "<p>" + "word and word, " * 20 + "</p>"
    links = "<div>" + "".join(f"<a href={i}>go{i}</a> " for i in range(9)) + "</div>"
    text = E.main_text(f"<body>{links}<div id=main><p>Short intro.</p><div>{p}{p}{p}</div><p>Short end.</p></div>{links}</body>").split("\n\n")
    assert [text[0], text[-1], len(text)] == ["Short intro.", "Short end.", 5]
    text = E.main_text(f"<body>{links}<div><div class=title><h1>Title</h1></div><ul><li><a href=1>menu</a><li><a href=2>more</a></ul>Loose <b>lead</b><div><div>{p}{p}{p}</div></div><blockquote>Quote</blockquote></div>{links}</body>").split("\n\n")
    assert text[:2] == ["Title", "Loose lead"] and text[-1] == "Quote" and len(text) == 6


def test_pages_without_articles_by_construction():
    """Pages put together from parts whose text is known, without elements that name the article."""
    r = random.Random(3)
    for k in range(60):
        parts, want = [], []
        for i in range(r.randint(3, 14)):
            words = " ".join(f"t{k}x{i}x{j}" for j in range(r.choice((2, 8, 40, 90))))
            tag = r.choice(("p", "p", "p", "h2", "blockquote", "pre"))
            parts.append(f"<{tag} class='c{i}'>{words.replace('x', '<i>x</i>', 1)}</{tag}>")
            want.append(words)
        parts.append(f"<p>{'long enough to count, ' * 20}</p>")
        want.append(("long enough to count, " * 20).strip())
        links = "<ul>" + "".join(f"<li><a href=/{i}>go {i}</a></li>" for i in range(r.randint(3, 30))) + "</ul>"
        body = "".join(parts)
        for _ in range(r.randint(0, 3)):
            body = f"<div class='l{k}'>{body}</div>"
        page = f"<html><head><title>no</title></head><body><div class='top'>{links}</div><div class='cookie-banner'>We use them</div>{body}<div class='side'>{links}</div><div class='site-footer'>(c)</div></body></html>"
        assert E.main_text(page).split("\n\n") == want, page
