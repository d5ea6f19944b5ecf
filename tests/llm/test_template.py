from coursemill.llm import template as tp

NONE = tp.Template()


def test_article_without_its_surroundings():
    page = """<!DOCTYPE html><html><head><title>T &amp; t</title><script>var a="</p>";</script><style>p{}</style></head><body>
    <header><h1>Site</h1></header><nav><ul><li><a href="/x">Menu</a></ul></nav><div class="cookie-notice">Cookies</div>
    <main><article class="post"><header><h1>Title  of&nbsp;it</h1></header><p>One <b>bo</b>ld &lt;x&gt; &eacute;.<br>Next<p>Two
    <!-- no --><aside>Side</aside><form><label>Mail</label><input value="v"><button>Go</button></form><div class="AdBox">Buy</div>
    <ul><li>a<li>b</ul><table><tr><td>1</td><td>2</td></tr></table></div><blockquote>Q</blockquote>
    <section id="comments"><p>First!</p></section></article></main><aside>More</aside><footer>&copy; x</footer></body></html>"""
    assert tp.extract(page, NONE) == "Title of it\nOne bold <x> é. Next\nTwo\na\nb\n1 2\nQ"


def test_broken_pages():
    assert tp.extract("", NONE) == ""
    assert tp.extract("just text & more", NONE) == "just text & more"
    assert tp.extract("<article><p>cut &am", NONE) == "cut &am"
    assert tp.extract("<article><p>kept</p><p cla", NONE) == "kept"
    assert tp.extract("<article>a < b <3 c</article>", NONE) == "a < b <3 c"
    assert tp.extract('<article><p title="a > b">x</p><script>never closed', NONE) == "x"
    assert tp.extract("<article>" + "<p>w</p>" * 20_000 + "</article>", NONE) == "\n".join(["w"] * 20_000)


def page(i, words):
    return f"<body><div class='top'>Our site</div><div class='links'><a>Home</a><a>News</a></div><div class='text'><h2>{words}</h2><p>Body of {i}: {words}</p></div><div class='end'>Imprint</div></body>"


def test_template_of_a_host_without_articles(spark):
    rows = [(i, f"https://User@H.example:80/{i}", page(i, f"word{i} " * (3 + i))) for i in range(6)] + [(90, "http://single/", page(90, "alone"))]
    rows += [(None, None, None), (91, "", ""), (91, "", "")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "page_id long, url string, html string, host int, key string")
    got = {}
    for r in tp.main_texts(df).collect():
        got.setdefault(r.page_id, []).append(r)
        assert r.n_chars == len(r.text)
    for i in range(6):
        w = ("word%d " % i * (3 + i)).strip()
        assert got[i][0].text == f"{w}\nBody of {i}: {w}"  # site name, links and imprint are template
    assert "alone" in got[90][0].text and got[None][0].text == "" and len(got[91]) == 2
    assert tp.main_texts(df.limit(0)).count() == 0


def test_classes_must_be_ordered_and_nested():
    order = {1: [10, 11, 12], 2: [20, 21, 22]}
    t = tp.Template({r: k for k, v in order.items() for r in v}, order)
    assert tp.valid_classes([10, 20, 21, 22, 20, 21, 22, 11, 12], t) == {1, 2}
    assert tp.valid_classes([10, 20, 11, 21, 12, 22], t) == {1}  # spans cross
    assert tp.valid_classes([20, 21, 22, 22, 21, 20, 10, 11, 12], t) == {1}  # order changes


def test_template_text_inside_articles_and_copies(spark):
    def post(i, words):
        return f"<body><nav>Menu</nav><article><div>Share this story</div><h1>On {words}</h1><p>About {words}.</p><p>Read more</p></article><p>Seen {i} times</p></body>"

    rows = [(i, "http://posts/", post(i, f"w{i}")) for i in range(5)] + [(0, "http://posts/", post(0, "w0"))]  # a repeated row
    rows += [(10 + i, "http://copies/", post(i, "same")) for i in range(6)]
    got = {r.page_id: r.text for r in tp.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(5):
        assert got[i] == f"On w{i}\nAbout w{i}."
    for i in range(6):  # one content only: no template
        assert got[10 + i] == "Share this story\nOn same\nAbout same.\nRead more"
