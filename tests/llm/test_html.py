import random
import time
from html.parser import HTMLParser

from cadenza.llm import html

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><header><h1>Site</h1><nav><ul><li><a href=/>Home</a></li></ul></nav></header>
<div id=cookie-notice>We use cookies, really, a lot of them, and much text about it, too.</div><div class="ad">Buy, buy, buy, all of it, now.</div>%s
<aside class=sidebar><p>Read, also, these other, long, long lists of things.</p></aside><form><label>Name</label><input></form><section class="comments"><p>First, comment, of a reader, who writes, and writes, and writes on.</p></section><footer>&copy; me</footer></body></html>"""


def test_article():
    got = html.extract(PAGE % "<article><h1>Head &amp; line</h1><p><b>One, two\n  three.<br><p>Four&nbsp;five, <a href=x>six</a>.</p><blockquote>Quoted &lt;b&gt; text.</blockquote><ul><li>a<li>b</ul></article>")
    assert got == "Head & line\n\nOne, two three.\n\nFour five, six.\n\nQuoted <b> text.\n\na\n\nb"


def test_without_article_element():
    body = "<div class=page><div class=content><h2>Title</h2><p>A first paragraph, with commas, and enough words to count for something here.</p><p>A second paragraph, with more of the same, and then some.</p></div><div class=links>" + "".join(f"<p><a href=/{i}>link {i}, and more of it</a></p>" for i in range(20)) + "</div></div>"
    got = html.extract(PAGE % body)
    assert got == "Title\n\nA first paragraph, with commas, and enough words to count for something here.\n\nA second paragraph, with more of the same, and then some."


def test_sections_and_siblings():
    body = "<article><section><p>One, part, of it, and more of it.</p></section><section><p>Another, part, of it, and more of it.</p></section><div class='comment-list'><p>Reader, says, so, and so, and so.</p></div></article>"
    assert html.extract(PAGE % body) == "One, part, of it, and more of it.\n\nAnother, part, of it, and more of it."


def test_siblings_of_an_article():
    a = "First, of, them, all, and, more, of, it, said."
    b = "Second, of, them, all, and more."
    links = "<div>" + "".join(f"<p><a href=/{i}>link {i}, and more</a></p>" for i in range(9)) + "</div>"
    assert html.extract(PAGE % f"<main><article><p>{a}</p></article><article><p>{b}</p></article>{links}<p>Few words.</p></main>") == f"{a}\n\n{b}\n\nFew words."
    assert html.extract(PAGE % f"<article><p>{b}</p></article><section><p>{a}</p></section>") == f"{b}\n\n{a}"
    deep = "<div>" * 8 + "<p>%s</p>" + "</div>" * 8
    assert html.extract(PAGE % f"<main><article>{deep % a}</article><article>{deep % b}</article>{links}</main>") == f"{a}\n\n{b}"
    assert html.extract(PAGE % f"<article><p>{a}</p></article><div><p>Short.</p></div>") == a


TEXT = "Article, of some length, with commas, and enough words in it to count as running text."


def test_names_lower_points_and_delete_no_text():
    body = "".join(f"<p>{TEXT} {i}</p>" for i in range(4))
    want = "\n\n".join(f"{TEXT} {i}" for i in range(4))
    for attrs in ('class="content sidebar-right"', 'class="sidebar-right"', 'id="related"', 'class="widget"', 'class="modal"', 'class="comment"'):
        assert html.extract(PAGE % f"<div {attrs}>{body}</div>") == want, attrs
    for attrs in ('id="share-price-analysis"', 'class="related-work"', 'class="social-history"', 'id="Menu_of_the_day"'):
        assert html.extract(PAGE % f"<article><p>{TEXT}</p><section {attrs}><h2>More</h2><p>{TEXT}</p></section></article>") == f"{TEXT}\n\nMore\n\n{TEXT}", attrs
    for attrs in ('class="share-buttons"', 'id="related-posts"', 'class="sidebar"', 'class="adSlot"', 'class="site-notice top"', 'class="cookie-banner"'):
        assert html.extract(PAGE % f"<article>{body}<div {attrs}><p>{TEXT}</p></div></article>") == want, attrs


def test_readers_comments_go():
    body = "".join(f"<p>{TEXT} {i}</p>" for i in range(2))
    want = f"{TEXT} 0\n\n{TEXT} 1"
    said = "".join(f'<article class="comment-body"><p>{TEXT} reader {i}</p></article>' for i in range(12))
    assert html.extract(PAGE % f"<article>{body}</article>{said}") == want
    assert html.extract(PAGE % f"<main>{body}{said}</main>") == want
    assert html.extract(PAGE % f'<div>{body}<ol class="commentlist">{"".join(f"<li><p>{TEXT}</p></li>" for _ in range(9))}</ol></div>') == want


def test_generated_pages_equal_their_articles():
    """Pages put together from an article and other parts, in many layouts: the article comes back, and no more."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(2, 9)))
    sentence = lambda n: " ".join(word() + ("," if rng.random() < 0.12 else "") for _ in range(n)).rstrip(",") + "."
    for _ in range(200):
        blocks, inner = [], ""
        for _ in range(rng.randrange(3, 9)):
            text, tag = sentence(rng.randrange(25, 80)), rng.choice(["p", "p", "p", "p", "h2", "blockquote", "ul"])
            if tag == "ul":
                items = [sentence(6) for _ in range(3)]
                blocks += items
                inner += f"<ul>{''.join(f'<li>{x}' for x in items)}</ul>"
            else:
                text = text if tag != "h2" else sentence(4)
                blocks.append(text)
                inner += f"<{tag}>{text}</{tag}>"
        wrap = rng.choice(["<article>%s</article>", "<main>%s</main>", "<div class='content'>%s</div>", "<div>%s</div>", "<div id=story><div class='post-content sidebar-left'>%s</div></div>", "<section>%s</section>"])
        noise = rng.choice(["<div class='sidebar'>%s</div>", "<aside>%s</aside>", "<div class='related-posts'>%s</div>", "<div id=comments>%s</div>", "<form>%s</form>", "<div class='cookie-notice'>%s</div>", "<section class='comment-list'>%s</section>", "<div role=banner>%s</div>"])
        menu = f"<ul class=x>{''.join(f'<li><a href=/{i}>{word()} {word()}</a></li>' for i in range(8))}</ul>"
        more = noise % f"<p>{sentence(30)}</p><p>{sentence(12)}</p>"
        own = wrap % (inner + (more if rng.random() < 0.3 else ""))
        around = [own, more, f"<nav>{menu}</nav>", f"<div>{menu}</div>", f"<footer><p>{sentence(9)}</p></footer>"]
        order = [around[i] for i in rng.choice([(2, 0, 1, 4), (3, 0, 1, 4), (2, 1, 0, 4), (3, 1, 0, 4), (2, 0, 4)])]
        assert html.extract(f"<html><body><div class=page>{''.join(order)}</div></body></html>") == "\n\n".join(blocks), order


def test_names_of_wrappers():
    assert html.extract('<div class="layout has-sidebar"><p>Kept, all, of it.</p><div class="sidebar"><p>Gone, all, of it.</p></div></div>') == "Kept, all, of it."


def test_odd_input():
    assert [html.extract(x) for x in (None, "", "  ", "<p></p>", "<script>x</script>", "<!--", "<![if")] == [""] * 7
    assert html.extract("just text") == "just text"
    assert html.extract("<p>a</p>" * 3) == "a\n\na\n\na"
    assert html.extract("<div>" * 5000 + "deep" + "</div>" * 5000) == "deep"
    long = "word, " * 50_000
    assert html.extract(f"<article><p>{long}</p></article>") == long.strip()
    assert html.extract("<p>&#233;&eacute;&bogus; &amp;amp;</p>") == "éé&bogus; &amp;"


def test_rows(spark):
    rows = [(1, "u", PAGE % "<article><p>x</p></article>", "clash"), (1, "u", PAGE % "<article><p>x</p></article>", "clash"), (None, None, None, None)]
    out = html.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert sorted((str(r.page_id), r.text, r.n_chars) for r in out) == [("1", "x", 1), ("1", "x", 1), ("None", "", 0)]
    assert html.main_texts(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_text_in_forms_asides_and_cells_stays():
    a, b = f"{TEXT} a. " * 4, f"{TEXT} b. " * 4
    a, b = a.strip(), b.strip()
    assert html.extract(f"<body><form id=aspnetForm><div class=page><p>{a}</p><p>{b}</p></div></form></body>") == f"{a}\n\n{b}"
    assert html.extract(f"<body><aside><p>Side.</p><div><article><p>{a}</p></article></div></body>") == a
    for page in (
        f"<table><tr><td><p>{a}</p></td><td><p>{b}</p></td></tr></table>", f"<table><tr><td><p>{a}</p></td><td><div><p>{b}</p></div></td></tr></table>",
        f"<div><div><div><p>{a}</p></div></div><div><p>{b}</p></div></div>", f"<div><p>{a}</p></div><div><div><div><p>{b}</p></div></div></div>",
    ):
        assert html.extract(PAGE % page) == f"{a}\n\n{b}", page
    links = "<ul><li><a href=1>Source one</a><li><a href=2>Source two</a><li><a href=3>Source three</a></ul>"
    assert html.extract(PAGE % f"<article><p>{a}</p>{links}<blockquote>Said.<footer>By me</footer></blockquote></article>") == f"{a}\n\nSource one\n\nSource two\n\nSource three\n\nSaid.\n\nBy me"
    others = f'<section class=discussion><div class=user-post><p>{TEXT}</p></div></section><div class=feedback><p>{TEXT}</p></div><div class="google-ads-slot"><p>{TEXT}</p></div>'
    assert html.extract(f"<article><p>{a}</p></article>{others}") == a
    assert html.extract(f"<article><p>{a}</p>{others}</article>") == a


def test_unclosed_tags_take_no_longer():
    began = time.perf_counter()
    assert html.extract("<span>" * 20_000 + "<p>text</p>" + "</i>" * 20_000) == "text"
    assert html.extract("<div><span><b>" * 60_000 + "word, " * 1000 + "</i></p></li>" * 30_000 + "<p>" * 20_000) == ("word, " * 1000).strip()
    assert time.perf_counter() - began < 6


def plain(page):
    """Another scorer: the smallest element that holds most of the text which stands in paragraphs and not in links, by one count over a tree of dicts."""
    skip = {"nav", "script", "style", "footer", "aside", "form"}
    root = {"tag": "root", "attrs": {}, "children": []}

    class Tree(HTMLParser):
        def __init__(self):
            super().__init__()
            self.at = [root]

        def handle_starttag(self, tag, attrs):
            own = {"tag": tag, "attrs": dict(attrs), "children": []}
            self.at[-1]["children"].append(own)
            self.at.append(own)

        def handle_endtag(self, tag):
            self.at.pop()

        def handle_data(self, data):
            self.at[-1]["children"].append(data)

    Tree().feed(page)
    gone = lambda e: e["tag"] in skip or "role" in e["attrs"] or any(w in f"{e['attrs'].get('class', '')} {e['attrs'].get('id', '')}" for w in ("sidebar", "related", "comment", "cookie")) and "content" not in e["attrs"].get("class", "")

    def size(e, linked=False):
        if isinstance(e, str):
            return 0 if linked else len(e.strip())
        return 0 if gone(e) else sum(size(c, linked or e["tag"] == "a") for c in e["children"])

    at = root
    while True:
        inner = [c for c in at["children"] if not isinstance(c, str) and size(c) > 0.9 * size(at) and c["tag"] not in ("p", "ul", "li", "h2", "blockquote")]
        if not inner:
            break
        at = inner[0]
    out = []

    def walk(e):
        if gone(e) and e is not at:
            return
        texts = [c for c in e["children"] if isinstance(c, str) and c.strip()]
        if texts and size(e):
            out.append(" ".join("".join(texts).split()))
        for c in e["children"]:
            if not isinstance(c, str) and size(c):
                walk(c)

    walk(at)
    return "\n\n".join(out)


def test_a_plainer_scorer_agrees():
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(2, 9)))
    sentence = lambda n: " ".join(word() + ("," if rng.random() < 0.12 else "") for _ in range(n)).rstrip(",") + "."
    for _ in range(200):
        body = "".join(f"<p>{sentence(rng.randrange(25, 90))}</p>" if rng.random() < 0.8 else f"<blockquote>{sentence(30)}</blockquote>" for _ in range(rng.randrange(3, 9)))
        wrap = rng.choice(["<article>%s</article>", "<main>%s</main>", "<div class='content'>%s</div>", "<div>%s</div>", "<div><div><div>%s</div></div></div>"])
        noise = rng.choice(["<div class='sidebar'>%s</div>", "<aside>%s</aside>", "<div id=comments>%s</div>", "<form>%s</form>", "<div class='cookie-notice'>%s</div>", "<footer>%s</footer>"]) % f"<p>{sentence(20)}</p>"
        menu = f"<div>{''.join(f'<a href=/{i}>{word()} {word()}</a> ' for i in range(8))}</div>"
        page = f"<html><body>{menu}{wrap % body}{noise}</body></html>" if rng.random() < 0.5 else f"<html><body>{noise}{wrap % body}{menu}</body></html>"
        assert html.extract(page) == plain(page), page
