"""Wrappers: shapes, alignment, slots and extraction."""

import json
import random
import re

from lumenlake.llm import wrappers as w

PAGE = """<!DOCTYPE html><html><head><title>T &amp; x</title><style>p{}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href="/a">a</a></li><li><a>b</a></li></ul></nav><!-- <p>gone</p> --><div class="ad">Buy</div>
<article><h1>Head &amp; more</h1><p><b>First<br>line<p>Second &lt;b&gt; &nbsp; x</p><ul><li>one<li>two</ul>
<div class="share">Share</div><form><p>mail</p></form><section id="comments"><p>Nice!</p></section><script>x()</script></article>
<aside>side</aside><footer>&copy; me</footer></body></html>"""


def text(source):
    page = w.Page(source)
    return "\n".join(t for p, t, _ in page.blocks if w._root(p) is not None and "!" not in p)


def test_blocks_of_the_article():
    assert text(PAGE) == "Head & more\nFirst line\nSecond <b> x\none\ntwo"


def test_cut_and_broken_pages():
    assert text("<article><p>one</p><p>two &am") == "one\ntwo &am"
    assert text("<article><p>one</p><p>two<a hre") == "one\ntwo"
    assert text("<article><p>one<script>never ends <p>x") == "one"
    assert text("<p>no article</p>") == "" and text("") == "" and text("a < b") == ""
    assert text("<article>a<span class='ad'>no</span>b<article>c</article>d</article>") == "ab\nc\nd"
    assert text("</div></p><main>x</i> y</main>z") == "x y"


def test_deep_and_long_pages():
    assert text("<article>" + "<div>" * 5000 + "x</div>y" + "<nav>gone</nav>z") == "x\ny\nz"
    page = w.Page("<div>" * 5000 + "x" + "</div>" * 5000 + "<p>y")
    one = w.align(page.shape(), w.Page("<p>y").shape())
    assert w.Wrapper(one).slots(page) and len(w.expression(one)) > 100
    many = "".join(f"<p>paragraph {i} of a long page</p></span>" for i in range(60_000))
    assert text(f"<main>{many}</main>").count("\n") == 59_999


def test_names_of_several_words():
    kept = ["related", "share-price", "notice-of-awards", "comment-free", "headline", "ad-hoc-query"]
    assert all(text(f"<article>a<p class='{c}'>b</p></article>") == "a\nb" for c in kept)
    assert all(text(f"<article>a<div class='x {c}'>b</div></article>") == "a" for c in ["share", "share-buttons", "adBox", "comment_list", "cookie-notice"])


def test_forms_around_an_article():
    menu, body = "<nav>menu words</nav><div><a href=x>linked words that do not count at all here</a></div>", "<p>a paragraph of some more words</p>"
    assert text(f"<form id=aspnetForm>{menu}<main><h1>Head</h1>{body}<form><p>mail</p></form></main></form>") == "Head\na paragraph of some more words"
    assert text(f"<form>{menu}<fieldset><div role=main>{body}</div></fieldset><fieldset><p>Sign up</p></fieldset></form>") == "a paragraph of some more words"
    page = w.Page(f"<body><form>{menu}<div>{body}</div></form></body>")
    assert [t for p, t, _ in page.blocks if "!" not in p][-1] == "a paragraph of some more words"
    page = w.Page(f"<body><div>{body * 3}</div><form><p>Sign up here</p></form></body>")
    assert all("form!" in p for p, t, _ in page.blocks if t == "Sign up here")
    assert text(f"<main>{body}<form><label>name</label></form></main>") == "a paragraph of some more words"


def test_a_host_whose_articles_are_in_forms(spark):
    rows = [(i, f"http://asp.example/{i}", f"<body><form id=aspnetForm><div class=top><a href=a>Home</a> <a href=b>News {i}</a></div><main><h1>Title {i}</h1><p>Text number {i} of the page</p></main><div class=footer>us</div></form></body>") for i in range(6)]
    got = {r["page_id"]: r["text"] for r in w.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"Title {i}\nText number {i} of the page" for i in range(6)}


def test_alignment_makes_groups_and_options():
    shapes = [w.Page(f"<body><h1>x</h1>{'<h2>n</h2>' * (i % 2)}{'<p>y</p>' * (i + 1)}</body>").shape() for i in range(3)]
    one = shapes[0]
    for other in shapes[1:]:
        one = w.align(one, other)
    assert w.expression(one) == "<body><h1>#</h1>(<h2>#</h2>)?(<p>#</p>)+</body>"


def pages(n=12):
    rng = random.Random(1)
    words = lambda k: " ".join(f"w{rng.randrange(900)}" for _ in range(k))
    rows, want = [], {}
    for i in range(n):  # a host without any article element
        body = [words(30) for _ in range(rng.randint(2, 5))]
        rows.append((i, f"http://plain.example/{i}", f"<body><div class='top'><a href=x>{words(2)}</a> <a href=y>{words(2)}</a></div><div class='box'><p>{'</p><p>'.join(body)}</p></div><div class='low'>same words on all pages</div></body>"))
        want[i] = "\n".join(body)
    for i in range(n, 2 * n):
        body = [words(9) for _ in range(3)]
        rows.append((i, f"https://Art.example:80/{i}", f"<body><nav>{words(3)}</nav><article><h1>{body[0]}</h1><p>{body[1]}</p><p>{body[2]}</p><p class='tail'>Read us daily</p></article></body>"))
        want[i] = "\n".join(body)
    rows += [(100, None, "<article>lone</article>"), (101, "http://x.example/", None), (102, "http://x.example/", ""), (102, "http://x.example/", "")]
    return rows, want | {100: "lone", 101: "", 102: ""}


def test_extraction_by_inferred_wrappers(spark):
    rows, want = pages()
    frame = spark.createDataFrame([(*r, "x", 5) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    for most in (1 << 24, 0):  # wrappers handed out, and wrappers joined
        got = w.extract(frame, broadcast_bytes=most).collect()
        assert len(got) == len(rows)
        assert {r["page_id"]: r["text"] for r in got} == want
        assert all(r["n_chars"] == len(r["text"]) for r in got)
    found = {r["host"]: r["wrapper"] for r in w.infer(frame).collect()}
    assert found["art.example"] == "<body><nav!>#</nav!><article><h1>#</h1>(<p>#</p>)+<p.tail>#</p.tail></article></body>"
    assert w.extract(frame.limit(0)).count() == 0


def test_alignment_decides_the_text(spark, monkeypatch):
    """With one fixed expression in place of the aligned ones the articles are lost."""
    rows, want = pages()
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    monkeypatch.setattr(w, "_aligned", lambda shapes, keys: shapes.select("host").distinct().selectExpr("host", """'["","1",[["body","1",["#"]]]]' as shape"""))
    got = {r["page_id"]: r["text"] for r in w.extract(frame).collect()}
    assert sum(got[i] != want[i] for i in range(24)) >= 12


def test_slots_are_those_of_the_expression():
    pages = [w.Page(f"<body><p>a{i}</p>{'<ul><li>x</ul>' * (i > 0)}{'<p>z</p>' * (i > 1)}</body>") for i in range(3)]
    one = pages[0].shape()
    for other in pages[1:]:
        one = w.align(one, other.shape())
    wrapper = w.Wrapper(one)
    assert w.expression(one) == "<body><p>#</p>(<ul><li>#</li></ul>)?(<p>#</p>)?</body>"
    assert [wrapper.slots(p) for p in pages][2] == ["/body/p/#", "/body/ul/li/#", "/body/p~2/#"]
    assert all("~0" not in s for p in pages for s in wrapper.slots(p))
    assert set(wrapper.order()) == set(wrapper.slots(pages[2]))


def test_copies_headings_and_layouts_keep_their_text(spark):
    rows, want = [], {}

    def page(host, html, text):
        rows.append((len(rows), f"http://{host}/{len(rows)}", f"<body>{html}</body>"))
        want[len(rows) - 1] = text

    for _ in range(6):  # copies of an article with a list and a classed paragraph of its own
        page("copy.example", "<article><p>one</p><ul><li>own</ul><p class='note'>copied</p></article>", "one\nown\ncopied")
    for i in range(6):  # a heading that all articles have
        page("copy.example", f"<article><p>t{i}</p></article>", f"t{i}")
        page("head.example", f"<article><h2>Summary</h2><p>t{i}</p></article>", f"Summary\nt{i}")
    for i in range(6):  # pages with and without a main element, and two regions
        page("mixed.example", f"<article><p>art {i}</p></article>", f"art {i}")
        page("mixed.example", f"<div class='box'><p>first {i} text of many words</p></div><div class='low'>same</div>", f"first {i} text of many words")
    page("mixed.example", "<div class='post'><p>another layout</p></div>", "another layout")
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    for most in (1 << 24, 0):
        assert {r["page_id"]: r["text"] for r in w.extract(frame, broadcast_bytes=most).collect()} == want


def test_a_host_of_many_shapes_is_folded_in_a_tree(spark, monkeypatch):
    monkeypatch.setattr(w, "BUCKET_SHAPES", 4)
    rows = [(i, f"http://big.example/{i}", f"<body><div class=top>menu</div><main><h1>t{i}</h1>{''.join(f'<h{2 + k}>s</h{2 + k}>' for k in range(5) if i >> k & 1)}<p>body {i}</p></main></body>") for i in range(32)]
    rows += [(100 + i, f"http://small.example/{i}", f"<body><main><p>text {i}</p></main></body>") for i in range(3)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    sizes, aligned = [], w._aligned
    monkeypatch.setattr(w, "_aligned", lambda shapes, keys: (sizes.append(shapes.groupBy(*keys).count().agg({"count": "max"}).first()[0]), aligned(shapes, keys))[1])
    folded = w._folded(w._shapes(frame))
    assert sorted(r["host"] for r in folded.collect()) == ["big.example", "small.example"]
    assert len(sizes) > 2 and max(sizes) < 16  # 32 shapes, no bucket with nearly all of them
    got = {r["page_id"]: r["text"] for r in w.extract(frame).collect()}
    assert all(got[i].startswith(f"t{i}") and got[i].endswith(f"body {i}") for i in range(32)) and got[101] == "text 1"


def as_regex(node):
    """An expression as a regular expression over tags and #, by itself."""
    if node == "#":
        return "#?"
    inner = "".join(map(as_regex, node[2]))
    own = re.escape(f"<{node[0]}>") + inner + re.escape(f"</{node[0]}>") if node[0] else inner
    return own if node[1] == "1" else f"(?:{own}){node[1]}"


def as_stream(node):
    """A page's tree as tags and #; neighbouring texts are one."""
    out = "".join("#" if c == "#" else f"<{c[0]}>{as_stream(c)}</{c[0]}>" for c in node[1])
    return re.sub("#+", "#", out)


def test_every_page_is_a_word_of_its_hosts_expression(spark, monkeypatch):
    """Random small pages against their host's inferred expression, read as a plain regular expression."""
    rng = random.Random(12)
    monkeypatch.setattr(w, "BUCKET_SHAPES", 8)

    def block(depth):
        kind = rng.choice(["text", "p", "ul", "div", "h2"] if depth < 3 else ["text", "p"])
        if kind == "text":
            return "words "
        if kind == "ul":
            return "<ul>" + "<li>x</li>" * rng.randint(1, 4) + "</ul>"
        return f"<{kind}{rng.choice(['', ' class=a', ' class=b'])}>" + "".join(block(depth + 1) for _ in range(rng.randint(0, 3))) + f"</{kind}>"

    pages = [(i, f"http://h{i % 3}.example/{i}", "<body>" + "".join(block(0) for _ in range(rng.randint(1, 5))) + "</body>") for i in range(90)]
    found = {r["host"]: json.loads(r["shape"]) for r in w.infer(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert len(found) == 3
    for i, _, html in pages:
        assert re.fullmatch(as_regex(found[f"h{i % 3}.example"]), as_stream(w.Page(html).tree)), html
