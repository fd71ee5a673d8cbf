import random
from html import escape

from tessera.llm import html as M

BOILER = [
    "<nav><ul><li><a href='/a'>Home page</a></li><li>About</li></ul></nav>",
    "<div class='ad-slot'>Buy this now, it is very good and cheap today</div>",
    "<aside><p>Other stories with a good deal of text in them, as they often have</p></aside>",
    "<script>var t='</p><p>no';</script><style>p{margin:0}</style><!-- <p>no</p> -->",
    "<form><label>Mail</label><input name=x><button>Subscribe</button></form>",
    "<div id='cookieNotice'><p>We use cookies to make this site better for you and for all of us</p></div>",
    "<section class='comments'><h3>3 comments</h3><p>I disagree with all of this, at length, and will say so</p></section>",
]


def page(rng, semantic, paragraphs):
    body = []
    for p in paragraphs:
        body.append(f"<p>{escape(p).replace(' ', rng.choice([' ', '  ', chr(10)]))}</p>")
        if rng.random() < 0.2:
            body.append(rng.choice(BOILER))
    inner = "".join(body)
    inner = f"<article>{inner}</article>" if semantic else f"<div class='content'>{inner}</div>"
    return f"<!DOCTYPE html><html><head><title>no</title></head><body><header><h2>Site name</h2></header>{''.join(rng.sample(BOILER, 3))}{inner}{''.join(rng.sample(BOILER, 3))}<footer>&copy; site, all rights reserved, with a line that is long enough to look like text to anyone</footer></body></html>"


def test_generated_pages():
    rng = random.Random(1)
    for k in range(200):
        paragraphs = [" ".join(rng.choice(["word", "text", "é", "<b>", "&amp;", "longer"]) for _ in range(rng.randint(1, 80))) for _ in range(rng.randint(1, 12))]
        if k % 2:
            paragraphs.insert(0, "first paragraph of some length " * 6)
            paragraphs = [" ".join(p.split()) for p in paragraphs]
        assert M.main_text(page(rng, k % 2 == 0, paragraphs)) == "\n".join(paragraphs)


def test_odd_markup():
    cases = {
        None: "",
        "": "",
        "<p>a": "a",
        "plain text only": "plain text only",
        "<article><header><h1>T</h1></header><p>one<p>two<aside>x</aside><p>three</article><p>after": "T\none\ntwo\nthree",
        "<div class=ad>buy<article><p>text": "text",
        "<ARTICLE><P>&lt;b&gt; x &#8364; &#x20ac; &am</P><SCRIPT>var a='</p>'</SCRIPT><ul><li>one<li>two</ul></ARTICLE>": "<b> x € € &am\none\ntwo",
        "<article><p>x</p><!-- unclosed <p>y": "x",
        "<article><p>x</p><div class='comments'><article><p>me too</p></article></div><p>y</p></article>": "x\ny",
        "<article><p><b>x <i>y</b> z</i><br>w</article>": "x y z\nw",
        "<article><p>a</p>" + BOILER[1] * 5 + "<p>b</p>" + BOILER[1] * 5 + "</article>": "a\nb",
        "a < b and c > d": "a < b and c > d",
        "<nav>only</nav>": "",
    }
    for html, text in cases.items():
        assert M.main_text(html) == text, html


def test_extract(spark):
    rows = [(1, "u", None), (2, None, "<article><p>é&nbsp; x</p></article>"), (None, "v", "<p>" + "long text " * 100_000), (2, None, "<article><p>é&nbsp; x</p></article>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as text", "2 as n_chars")
    got = {(r.page_id, r.url): r for r in M.extract(df).collect()}
    assert got[1, "u"].text == "" and got[2, None].text == "é x" and got[2, None].n_chars == 3
    assert got[None, "v"].n_chars == 999_999
    assert M.extract(df).count() == 4 and M.extract(df.limit(0)).count() == 0


def test_class_words_erase_no_page():
    story = "".join(f"<p>Paragraph {i} of a story that goes on for a while, with commas, and more.</p>" for i in range(6))
    want = "\n".join(f"Paragraph {i} of a story that goes on for a while, with commas, and more." for i in range(6))
    for page in (
        f'<div class="content no-sidebar">{story}</div>',
        f'<div id="page" class="has-sidebar"><div class="sidebar">Other <a href="/">things</a></div>{story}</div>',
        f'<div class="elementor-widget-container">{story}</div>',
        f'<article class="post has-comments">{story}</article>',
        f'<article class="status-publish tag-search">{story}</article>',
        f'<div class="widget">{story}</div>',
        f'<article>{story}</article><div class="comment-list"><p>First!</p></div>',
    ):
        assert M.main_text(page) == want, page


def test_unquoted_values_and_sections():
    assert M.main_text("<main><p title=it's>Alpha</p><p>gamma don't</p><p>omega</p></main>") == "Alpha\ngamma don't\nomega"
    story = "".join(f"<p>Sentence {i} of an article about remarks that readers leave.</p>" for i in range(5))
    assert M.main_text(f"<article><h2>Comments</h2>{story}</article>").count("Sentence") == 5
    long = "".join(f"<p>Sentence {i} of a long story without an article element around it.</p>" for i in range(200))
    box = "<form><p>a</p><p>b</p><p>c</p><p>d</p></form>"
    end = "".join(f"<p>Closing part {i}, which is much shorter than the story before it.</p>" for i in range(4))
    assert M.main_text(f"<body><div>{long}{box}{end}</div></body>").count("Closing part") == 4


P = "A sentence with several plain words that fills one whole paragraph of the story, as prose in articles does, and then ends."
LINKS = "<ul><li><a href=a>one</a></li><li><a href=b>two</a></li><li><a href=c>three</a></li></ul>"
AD = "<div class=ad>buy</div>"


def test_no_run_is_lost_for_what_follows_it():
    cases = {
        f"<div><section>{f'<p>{P}</p>' * 20}</section>{LINKS}<section><p>{P}</p></section></div>": [P] * 21,
        f"<p>{P}</p>{LINKS}<p>{P}</p>": [P] * 2, f"<p>{P}</p>{AD * 3}<p>{P}</p>": [P] * 2, f"<p>{P}</p>{LINKS}<p>Short end.</p>": [P, "Short end."],
        f"<body><article><h3>Other story</h3><p>Teaser text</p></article><div class=content><p>{P}</p><p>{P}</p></div></body>": [P] * 2,
        f"<body><form id=all><div><p>{P}</p><label>Search</label><p>{P}</p></div></form></body>": [P] * 2,
        f"<main><section role=status><p>{P}</p></section></main>": [P], f"<main><p>{P}</p><fieldset><p>{P}</p><p>{P}</p></fieldset></main>": [P] * 3,
    }
    for html, want in cases.items():
        assert M.main_text(html) == "\n".join(want), html


def test_words_of_prose_need_evidence():
    for c in ("legal", "toast recipe", "notice period", "search-results-explained", "social-history", "notice"):
        assert M.main_text(f"<article><p>{P}</p><div class='{c}'><p>{P}</p></div><p>{P}</p></article>") == "\n".join([P] * 3), c
        assert M.main_text(f"<article><p>{P}</p><div class='{c}'><p>Send this on.</p></div><p>{P}</p></article>") == "\n".join([P] * 2), c
        assert M.main_text(f"<article><p>{P}</p><div class='{c}'><a href=x>{P}</a></div><p>{P}</p></article>") == "\n".join([P] * 2), c


def test_flowing_pages_of_sections():
    """Pages without article or main: sections of one to four paragraphs, with lists of links and adverts between them."""
    rng = random.Random(9)
    for _ in range(200):
        text, body = [], []
        for _ in range(rng.randint(1, 8)):
            own = [f"{P} {rng.randint(0, 99)}" for _ in range(rng.randint(1, 4))]
            text += own
            body.append("<section>" + "".join(f"<p>{p}</p>" for p in own) + "</section>" + rng.choice(["", LINKS, AD * 3, LINKS + AD]))
        extra = rng.choice(["", "<nav>" + LINKS + "</nav>", "<article><h4>Read on</h4></article>", "<form><input><button>Go</button></form>"])
        html = f"<html><body>{extra}<div id=page>{''.join(body)}</div><footer>{P}</footer></body></html>"
        assert M.main_text(html).replace("one\ntwo\nthree\n", "").removesuffix("\none\ntwo\nthree") == "\n".join(text), html
