import random

from marketlake.llm.html import TAG_SCORE, best_run, extract, learn, learn_from, main_text

WRAP = '<!DOCTYPE html><html><head><title>T &amp; x</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/a">Menu one</a></li><li><a>two</a></li></ul></nav><!-- ad <p>no</p> --><div class="ad">An advert of some length stands here now.</div>%s<footer>&copy; host &middot; closing words of the page here</footer></body></html>'


def test_regions_of_built_pages():
    r = random.Random(1)
    weights = learn([WRAP % "<article><h1>Head</h1><p>Some words</p></article>"] * 5)
    for n in (1, 2, 30):
        blocks = [" ".join(f"w{r.randrange(99)}" for _ in range(r.choice([1, 2, 40]))) for _ in range(n)]
        body = "<h1>Head &lt;1&gt;</h1>" + "".join(f"<p>{b}</p>" for b in blocks)
        want = "\n\n".join(["Head <1>", *blocks])
        assert extract(WRAP % f"<article>{body}</article>", weights) == want
        assert extract(WRAP % f"<div>{body}</div>", weights) == want
        assert extract((WRAP % f"<article>{body}</article>").replace("</body></html>", ""), weights) == want


def test_inside_and_odd_markup():
    w = learn([])
    html = WRAP % '<main><h1>Big news</h1><p>First <b>bo</b>ld\n\t part<br>two &#233;&nbsp;&am</p><div class="cookie notice"><p>We use cookies</p></div><aside>Also read</aside><p>Second one here<p>third without an end<div id="comments"><p>I liked it so much that I wrote this comment</p></div></main>'
    assert extract(html, w) == "Big news\n\nFirst bold part two é &am\n\nSecond one here\n\nthird without an end"
    assert [extract(x, w) for x in (None, "", "<nav>only</nav>", "<p>", "<script>never closed <p>x</p>")] == [""] * 5
    assert extract("1 < 2 and <p>a<b>c</b> < d</p>", w) == "1 < 2 and\n\nac < d"
    assert extract("<p>" + "word " * 100_000, w) == " ".join(["word"] * 100_000)
    assert extract('<p title="unclosed>text', w) == "text"


def test_on_spark(spark):
    rows = [(1, "u", WRAP % "<article><h1>A b</h1><p>c d</p></article>", 9), (1, "u", None, 9), (2, None, "", 9)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = main_text(df, learn_from(df))
    assert got.columns == ["page_id", "url", "text"] and sorted(r.text for r in got.collect()) == ["", "", "A b\n\nc d"]
    assert main_text(df.limit(0), learn_from(df.limit(0))).count() == 0


def test_run_equals_brute_force():
    r = random.Random(3)
    for _ in range(300):
        n = r.randrange(1, 25)
        score, tags = [r.uniform(-1, 1) for _ in range(n)], [r.randrange(4) for _ in range(n)]
        total = {(i, j): sum(score[i:j]) + TAG_SCORE * sum(tags[i + 1 : j]) for i in range(n) for j in range(i + 1, n + 1)}
        a, b = best_run(score, tags)
        assert abs(max([0.0, *total.values()]) - (total[a, b] if b > a else 0.0)) < 1e-9


def test_pages_without_semantic_elements_and_broken_ones():
    """Nothing but div, p and class names; no end of head; a form around the whole page; a menu that is never closed."""
    r = random.Random(4)
    weights = learn([WRAP % "<article><h1>Head</h1><p>Some words</p></article>"] * 5)
    words = lambda n: " ".join(f"w{r.randrange(99)}" for _ in range(n))
    for _ in range(30):
        paragraphs = [words(r.randrange(8, 60)) for _ in range(r.randrange(3, 9))]
        middle = f'<div class="notice cookie"><p>{words(4)}</p></div>' if r.random() < 0.5 else ""
        cut = r.randrange(len(paragraphs) - 1)
        body = "<h1>Big head</h1>" + "".join(f"<p>{x}</p>" + (middle if i == cut else "") for i, x in enumerate(paragraphs))
        want = "\n\n".join(["Big head", *paragraphs])
        plain = f'<html><head><title>T</title></head><body><div class="menu">{"".join(f"<a href=x>{words(2)}</a> " for _ in range(6))}</div><div class="content">{body}</div><div class="sidebar"><p>{words(9)}</p></div><div id="comments"><p>{words(30)}</p></div><div class="footer"><p>{words(8)}</p></div></body></html>'
        assert extract(plain, weights) == want
        assert extract(plain.replace("</head>", ""), weights) == want
        wrapped = (WRAP % f"<div>{body}</div>").replace("<body>", "<body><form id=f>").replace("</body>", "</form></body>")
        assert extract(wrapped, weights) == want
        assert want in extract((WRAP % f"<div>{body}</div>").replace("</nav>", "") if len(want) > 400 else plain, weights)
