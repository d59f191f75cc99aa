import pytest

from netquarry.llm import html_extract as hx
from netquarry.llm.html_blocks import blocks


@pytest.fixture(scope="module")
def field():
    return hx.train(hx.labelled_pages())


def _texts(page):
    return [b.text for b in blocks(page)]


def test_blocks():
    assert _texts("<p>a<p>b <b>c</b>d<br>e</p>f") == ["a", "b cd e", "f"]
    assert _texts("<!-- x <p> --><script>var a='</p>';</script><style>p{}</style><p title=\"a>b\">x &amp; y&nbsp;&#233;&eacute</p>") == ["x & y éé"]
    assert _texts("<ul><li>1<li>2</ul><table><tr><td>3<td>4</table>") == ["1", "2", "3", "4"]
    assert _texts("plain < text & more <3") == ["plain < text & more <3"]
    assert _texts("<p>cut <b>here &am") == ["cut here &am"] and _texts("<script>never closed <p>x") == []
    assert _texts(None) == _texts("") == _texts("<div></div>") == []
    assert len(blocks("<div>" * 3000 + "x" + "</div>" * 3000)) == 1


def test_held_out_pages(field):
    right = total = 0
    for rows, labels in hx.labelled_pages(200, seed=77):
        right += sum(a == b for a, b in zip(field.labels(rows), labels, strict=True))
        total += len(labels)
    assert right / total > 0.97


def test_viterbi_is_the_best_labelling(field):
    import itertools

    for rows, _ in hx.labelled_pages(30, seed=5):
        rows = rows[:9]
        s = field.scores(rows)

        def value(y, s=s):
            return (field.start if y[0] else 0) + sum(x for x, k in zip(s, y, strict=True) if k) + sum(field.step[a][b] for a, b in zip(y, y[1:], strict=False))

        best = max(value(y) for y in itertools.product((0, 1), repeat=len(rows)))
        assert abs(value(field.labels(rows)) - best) < 1e-9


PAGE = """<html><head><title>T</title></head><body><nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav>
<div class="cookie-notice"><p>We use cookies.</p><button>OK</button></div><{0}><h1>Main title here</h1><p>The first paragraph of the text, it is long.</p>
<div class="ad">Buy this now!</div><p>Second one &amp; more.</p></{1}><div id="comments"><div class="comment"><p>I like it very much, thanks.</p></div></div>
<aside><h3>Related</h3><ul><li><a href="#">Another one</a></li></ul></aside><form><label>Mail</label><button>Go</button></form><footer>&copy; me</footer></body></html>"""


@pytest.mark.parametrize("box", [("article", "article"), ("main", "main"), ('div class="post-content"', "div")])
def test_main_text(field, box):
    page = PAGE.replace("{0}", box[0]).replace("{1}", box[1])
    assert hx.main_text(page, field) == "Main title here The first paragraph of the text, it is long. Second one & more."


def test_table(spark, field):
    rows = [(1, "u", PAGE.replace("{0}", "article").replace("{1}", "article"), "c"), (2, None, None, "c"), (3, "u", "", "c"), (None, "u", "<p>" + "long text. " * 90000, "c")]
    rows.append(rows[0])
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = hx.extract(df, field).collect()
    assert len(got) == 5 and got[0].text == got[4].text != "" and got[1].text == got[2].text == ""
    assert hx.extract(spark.createDataFrame([], df.schema), field).count() == 0
