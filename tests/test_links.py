from quarryline.operators.pages import page_links

PAGE = """<a href="/1">one</a><A class='x' HREF='/2' id=z>two <b>bold</b></A ><a
 data-href="/no" href=/3 title="a > b href='/no'"><img alt="x>y"><span>three</span> &amp; more</a><a name="top">no link</a>
<abbr href="/no">no</abbr><a href="/4">open <a href = "/5"></a><a href="/6" download><!-- <i> -->six
lines</a>"""


def test_every_anchor_with_an_href(spark):
    rows = page_links(spark.createDataFrame([(1, PAGE), (2, None), (3, "")], "page_id long, html string")).collect()
    assert sorted((r.ord, r.href, r.label) for r in rows) == [(0, "/1", "one"), (1, "/2", "two bold"), (2, "/3", "three & more"), (3, "/4", "open"), (4, "/5", ""), (5, "/6", "six lines")]
