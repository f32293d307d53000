"""A second set of hand-labelled pages, none of them like the training pages, and the contract's cases."""

from collections import Counter

import pytest

from quillmark.llm import html_extract

A, B, C = "The river rose twice in spring and the mill stood still.", "Nobody in the valley had seen water that high before.", "By May the fields were dry again."
N = "<a href=1>Home</a> <a href=2>News</a> <a href=3>Contact</a>"
#: Each page with its main text, block by block.
PAGES = [
    (f"<html><body><nav>{N}</nav><main><h1>Floods</h1><p>{A}</p><p>{B}</p></main><footer>© us</footer></body></html>", ["Floods", A, B]),
    (f"<body><div id=top>{N}</div><div id=main><h2>Floods</h2><p>{A}<p>{B}<p>{C}</div><div id=foot>imprint</div></body>", ["Floods", A, B, C]),
    (f"<body><header><h1>Valley Post</h1>{N}</header><article><h1>Floods</h1><p>{A}</p><section class=comments><h2>3 comments</h2><p>Terrible!</p></section></article></body>", ["Floods", A]),
    (f"<body><div class=content><p>{A}</p><div class=ad>Buy boots</div><p>{B}</p></div></body>", [A, B]),
    (f"<body><div class=article><p>{A}</p><form><label>Mail</label><input></form><p>{B}</p></div></body>", [A, B]),
    (f"<body><article><p>{A}</p><div class=promo><p>Half price</p></div><p>{C}</p></article></body>", [A, C]),
    (f"<body><article><p>{A}</p><p><a href=5>Read the full report of the mill</a></p><p>{B}</p></article></body>", [A, "Read the full report of the mill", B]),
    (f"<body><article><p>{A}</p><ul><li><a href=1>Dam</a></li><li><a href=2>Mill</a></li></ul><p>{B}</p></article></body>", [A, "Dam", "Mill", B]),
    (f"<body><div><h1>Floods</h1><p>{A}</p><p>{B}</p></div><div class=sidebar><h3>Popular</h3><ul><li><a href=1>x</a></li></ul></div></body>", ["Floods", A, B]),
    (f"{A} {B}", [f"{A} {B}"]),
    (f"<body>{A}<br>{B}</body>", [f"{A} {B}"]),
    (f"<html><head><title>Floods<body><p>{A}</p><p>{B}</p></body></html>", [A, B]),
    (f"<html><head><title>x</title><style>p {{}}</style></head><body><section><h2>Floods</h2><p>{A}</p></section><section class=newsletter><p>Subscribe now</p></section></body></html>", ["Floods", A]),
    (f"<body><table><tr><td class=nav>{N}</td><td class=main><h1>Floods</h1><p>{A}</p><p>{B}</p></td></tr></table></body>", ["Floods", A, B]),
    (f"<body><div class=cookie-banner>We use cookies</div><article><h1>Floods</h1><p>{A}</p><figure><img src=x><figcaption>The mill</figcaption></figure><p>{B}</p></article></body>", ["Floods", A, "The mill", B]),
    (f"<body><article><h1>Floods</h1><p>{A}</p><table><tr><th>Year</th><th>Level</th></tr><tr><td>1990</td><td>3 m</td></tr></table></article><aside>More</aside></body>", ["Floods", A, "Year", "Level", "1990", "3 m"]),
    (f"<body><div role=navigation>{N}</div><div role=main><p>{A}</p><p>{B}</p></div><div role=contentinfo>imprint</div></body>", [A, B]),
    (f"<body><main><h1>Floods</h1><dl><dt>Level</dt><dd>3 m</dd><dt>Date</dt><dd>May</dd></dl><p>{A}</p></main><div class=share>{N}</div></body>", ["Floods", "Level", "3 m", "Date", "May", A]),
    (f"<body><article><h1>Floods</h1><pre>level = 3\n  date</pre><p>{A}</p></article><section id=comments><h2>Comments</h2><ol><li>Yes</li></ol></section></body>", ["Floods", "level = 3 date", A]),
    (f"<body><div class=wrap><div class=menu>{N}</div><div class=post><h2>Floods</h2><div class=entry><p>{A}</p><blockquote><p>{B}</p></blockquote></div></div></div></body>", ["Floods", A, B]),
    (f"<body><article><p>{A}</p><aside class=related><h3>See also</h3><ul><li><a href=1>x</a></li></ul></aside><p>{B}</p></article></body>", [A, B]),
    (f"<body><main><article><header><h1>Floods</h1></header><p>{A}</p><footer>Filed under rivers</footer></article></main></body>", ["Floods", A]),
    (f"<body><div class=modal>Sign in</div><div class=page><div class=story><p>{A}</p><p>{B} <a href=1>More</a></p></div></div></body>", [A, f"{B} More"]),
    (f"<body><h1>Floods</h1><p>{A}</p><p>{B}</p><h2>After</h2><p>{C}</p></body>", ["Floods", A, B, "After", C]),
    (f"<body><article><h1>Fl&ouml;&ouml;ds &amp; more</h1><p>{A}</p><script>x = '<p>no</p>'</script><noscript><p>no</p></noscript></article></body>", ["Flööds & more", A]),
    (f"<body><div class=breadcrumb>{N}</div><article><h1>Floods</h1><ol><li>{A}</li><li>{B}</li></ol></article><div class=pagination>{N}</div></body>", ["Floods", A, B]),
    (f"<body><article><p>{A}</p><div id=disqus_thread><div class=comment><p>Really?</p></div></div></article></body>", [A]),
    (f"<body><section><h2>Floods</h2><p>{A}</p></section><section><h2>After</h2><p>{C}</p></section><footer><p>imprint</p></footer></body>", ["Floods", A, "After", C]),
    (f"<body><div class=alert>Storm warning</div><div class=article-text><p>{A}</p><h3>After</h3><p>{C}</p><div class=advertisement><div>Boots</div></div></div></body>", [A, "After", C]),
    (f"<body><ul class=nav><li><a href=1>Home</a></li></ul><div id=content><p>{A}</p><details><summary>Levels</summary><p>{B}</p></details></div><div class=widget><p>Poll</p></div></body>", [A, "Levels", B]),
]


@pytest.fixture(scope="module")
def model():
    return html_extract.train()


def test_words_of_varied_pages(model):
    hit = said = wanted = exact = 0
    for page, blocks in PAGES:
        got = html_extract.extract(page, model)
        a, b = Counter(got.split()), Counter(" ".join(blocks).split())
        hit, said, wanted = hit + sum((a & b).values()), said + sum(a.values()), wanted + sum(b.values())
        exact += got == "\n\n".join(blocks)
    assert hit / said >= 0.95 and hit / wanted >= 0.95, (hit, said, wanted)
    assert exact >= 27, exact


CASES = [
    ('<article><h1>t</h1><p>x</p><section class="comments"><h2>Comments</h2><p>hi</p></section></article>', "t\n\nx"),
    ("<html><body><article><p>x y</p><div class='comments'><p>hi</p></div></article></body></html>", "x y"),
    ("<html><body><div class='content'><p>x y</p><div class='comments'><p>hi</p></div></div></body></html>", "x y"),
    ("<article><p>a</p><form><p>name</p></form></article>", "a"), ("<html><body><form><p>name</p></form></body></html>", ""),
    ("<article><p>a</p><div class='promo'>buy</div><p>b</p></article>", "a\n\nb"), ("<article><p>a</p><section class='ad-break'><p>buy</p></section><p>b</p></article>", "a\n\nb"),
    ("<article><p>x</p><p><a href=1>whole link paragraph</a></p></article>", "x\n\nwhole link paragraph"), ("<article><ul><li>See <a href=1>one</a></li><li><a href=2>two</a></li></ul></article>", "See one\n\ntwo"),
    ("<body><div><p>a</p><p>b</p></div><div class='sidebar'><p>s</p></div></body>", "a\n\nb"), ("bare text", "bare text"), ("<body>text<br>more</body>", "text more"), ("text<br>more", "text more"),
    ("<html><head><title>abc<body><article><p>x</p></article></body></html>", "x"), ("", ""), (" \n ", ""), ("<nav><a href=1>x</a></nav>", ""),
]


@pytest.mark.parametrize("page,want", CASES)
def test_contract(model, page, want):
    assert html_extract.extract(page, model) == want


def test_table_edges(spark):
    schema = "page_id long, url string, html string, text int, n_chars string"
    assert html_extract.extract_pages(spark.createDataFrame([], schema)).collect() == []
    rows = [(1, "u", "<article><p>x</p></article>", 5, "c")] * 2 + [(None, None, None, None, None), (2**60 + 1, "v", "", 1, "")]
    got = [tuple(r) for r in html_extract.extract_pages(spark.createDataFrame(rows, schema)).collect()]
    assert sorted(got, key=str) == sorted([(1, "u", "x", 1), (1, "u", "x", 1), (None, None, "", 0), (2**60 + 1, "v", "", 0)], key=str)


def test_counts_are_what_the_pages_say():
    """Training by hand on two tiny pages."""
    m = html_extract.train(["<body><p data-main>x</p><p>y</p></body>", "<body><p>y</p></body>"], smoothing=0.5)
    # Five nodes (two bodies, three paragraphs), one of them content.
    assert m.odds["tag=p"] == pytest.approx((1.5 / 2) / (2.5 / 5)) and m.odds["tag=body"] == pytest.approx((0.5 / 2) / (2.5 / 5))
    said, silent = m.tie[0], m.tie[5]
    total = sum(0.5 + 0.5 for _ in m.tie) + 5
    assert said[0] == pytest.approx((2.5 / total, 1.5 / total)) and silent[0] == pytest.approx((2.5 / total, 0.5 / total))
