import random

from textdrift.llm import dom, extraction
from helpers import prose

SCHEMA = "page_id long, url string, html string, host string, text string, n long, reference string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", 1, "z") for r in rows], SCHEMA).repartition(3)


def texts(spark, rows):
    out = extraction.extract(frame(spark, rows))
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    got = out.collect()
    assert all(r.n_chars == len(r.text) for r in got) and len(got) == len(rows)
    return {r.page_id: r.text for r in got}


def blocks(page):
    return [b.text for b in dom.parse(page).blocks]


def test_blocks_of_malformed_pages():
    assert blocks("<p>a <b>b<p>c</b> d<ul><li>x<li>y</ul>e") == ["a b", "c d", "x", "y", "e"]
    assert blocks("<table><tr><td>1<td>2<tr><th>3</table>") == ["1", "2", "3"]
    assert blocks("a&amp;b &lt;p&gt; &#233;&nbsp;&copy; <br>\n c") == ["a&b <p> é © c"]
    assert blocks("<div>one<script>var t='</p>';</script>two<!-- <p>no</p> -->three</div>") == ["one twothree"]
    assert blocks('<p title="a > b">in</p> 1 < 2 <p') == ["in", "1 < 2"]
    assert blocks("<p>cut <script>never closed <p>x") == ["cut"]
    assert blocks("") == []
    assert blocks("</div></p>stray<hr>rule") == ["stray", "rule"]
    deep = "<div>" * 3000 + "core" + "</div>" * 3000
    assert blocks(deep) == ["core"] and len(dom.parse(deep).labels) == dom.DEEPEST + 1


def test_furniture_goes_by_its_name():
    page = ("<header>h</header><nav>n</nav><div class='Top ad-box'>ad</div><main><article><header><h1>Title</h1></header>"
            "<p>body</p><aside>side</aside><form>f</form><div id=comments>c</div><footer>f</footer></article></main>"
            "<div role='dialog'>d</div><div class='cookie-notice'>k</div><p hidden>h</p><div style='display: none'>s</div>"
            "<div class='has-sidebar'>kept</div><footer>f</footer>")
    assert blocks(page) == ["Title", "body", "kept"]


def matching(a, b):
    """Largest order-preserving matching of two trees (label, children), plainly."""
    if a[0] != b[0]:
        return 0
    m = [[0] * (len(b[1]) + 1) for _ in range(len(a[1]) + 1)]
    for i, x in enumerate(a[1], 1):
        for j, y in enumerate(b[1], 1):
            m[i][j] = max(m[i - 1][j], m[i][j - 1], m[i - 1][j - 1] + matching(x, y))
    return 1 + m[-1][-1]


def test_alignment_is_a_largest_matching():
    r = random.Random(1)

    def tree(depth=0):
        return r.choice("ab"), [tree(depth + 1) for _ in range(r.randrange(4 if depth < 3 else 1))]

    def lines(t, depth=0):
        return [f"{depth} {t[0]}"] + [x for c in t[1] for x in lines(c, depth + 1)]
    for _ in range(200):
        a, b = ("r", tree()[1]), ("r", tree()[1])
        one, two = dom.Tree("\n".join(lines(a))), dom.Tree("\n".join(lines(b)))
        out = dom.align(one, two)
        pairs = [(x, y) for y, x in enumerate(out) if x >= 0]
        assert len(pairs) == matching(a, b) and len({x for x, _ in pairs}) == len(pairs)
        assert all(one.labels[x] == two.labels[y] for x, y in pairs)


def test_article_pages(spark):
    rows = [(i, f"https://H.example/{i}", f"<html><body><nav><a href=/>home</a> {prose(i, 3)}</nav><article>"
             f"<h1>T{i}</h1><p>{prose(100 + i, 30)}<p>{prose(200 + i, 30)} &amp; more<p>Subscribe to our letter.</article>"
             f"<div>Terms {i}</div></body>") for i in range(12)]
    got = texts(spark, rows)
    assert got == {i: f"T{i}\n{prose(100 + i, 30)}\n{prose(200 + i, 30)} & more" for i in range(12)}


def test_pages_without_any_names(spark):
    """Neither article nor class names: only the wrapper tells the slots apart."""
    rows = [(i, "http://plain.example:80/x", f"<body><div>Menu A | Menu B</div><div>{prose(i, 20)}</div>"
             f"<div><p>{prose(50 + i, 9)}</p><p>{prose(80 + i, 9)}</p></div><div>stock {i % 3}</div>"
             + ("<table><tr><td>extra</table>" if i == 7 else "")) for i in range(15)]
    got = texts(spark, rows)
    assert got == {i: "\n".join([prose(i, 20), prose(50 + i, 9), prose(80 + i, 9)] + ["extra"] * (i == 7))
                   for i in range(15)}


def test_copies_do_not_become_template(spark):
    page = f"<article><h1>Same</h1><p>{prose(1, 40)}</p><p>{prose(2, 20)}</p></article>"
    rows = [(i, "http://copies.example/", page) for i in range(20)] + [(99, "http://copies.example/", page)] * 2
    out = extraction.extract(frame(spark, rows)).collect()
    assert len(out) == 22 and {r.text for r in out} == {f"Same\n{prose(1, 40)}\n{prose(2, 20)}"}


def test_edges(spark):
    long = "<p>" + prose(3, 60000) + "</p>" + "<div><p>x y</p></div>" * 500
    rows = [(1, None, None), (2, "", ""), (None, "no url", "<p>text"), (4, "http://a.example", "<script>x</script>"),
            (5, "http://user@B.example:8/", "plain  \n text"), (6, "http://b.example", long)]
    got = texts(spark, rows)
    assert got[1] == got[2] == got[4] == "" and got[None] == "text" and got[5] == "plain text"
    assert got[6].startswith(prose(3, 60000)) and got[6].count("x y") == 500
    assert extraction.extract(frame(spark, [])).count() == 0
