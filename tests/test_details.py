"""HTML tables as grids: spans, nested tables, missing end tags, hostile pages."""

from pyspark.sql import functions as F

from hindsight.sources import details


def grid(html):
    return [(t, r, c, text) for t, r, c, _, text in details.grid_cells(html)]


def test_spans_fill_their_places():
    html = "<table><tr><th rowspan=2>a</th><td colspan='2'>b</td></tr><tr><td>c<td>d</tr><tr><td>e</td><td>f</td><td>g</td></tr></table>"
    assert grid(html) == [(0, 0, 0, "a"), (0, 0, 1, "b"), (0, 0, 2, "b"), (0, 1, 0, "a"), (0, 1, 1, "c"), (0, 1, 2, "d"), (0, 2, 0, "e"), (0, 2, 1, "f"), (0, 2, 2, "g")]


def test_nested_unclosed_and_hostile_pages():
    assert grid("<table><tr><td>x<table><tr><td>y</table>z</table>") == [(0, 0, 0, "xz"), (1, 0, 0, "y")]
    assert grid("<table><td> a &amp;\n b </td>") == [(0, 0, 0, "a & b")]
    assert grid(None) == grid("") == grid("<p>no table</p>") == []
    assert len(grid("<table><tr><td colspan=999999999 rowspan=x>a</td></tr></table>")) == details.MOST_SPAN
    deep = "<table><tr><td>" * 3000 + "x"
    assert grid(deep)[-1] == (2999, 0, 0, "x")


def test_pages_without_tables_have_no_rows(spark):
    pages = spark.createDataFrame([(1, None), (2, "<p>"), (3, "<table><tr><th>Attendance</th><td>1,234 people</td></tr></table>"), (4, "<table><tr><td>a</td></tr></table>")], "id long, html string")
    got = details.details(pages.withColumn("name", F.lit("x")), "id").collect()
    assert [(r.id, r.section, r.name, r.value) for r in got] == [(3, "fact", "attendance", 1234.0)]


def test_plain_pages_are_read_as_the_parser_reads_them():
    """One pattern reads plain tags; what it can't read goes to the parser, and both give the same tables."""
    pages = [
        "<table class=x><TR><TH ROWSPAN='2' >a&amp;b</TH><td colspan=2>c<br>d</td></tr><tr><td>e<td>f</table> &lt; tail",
        "<table><tr><td>a<!-- <td>no</td> -->b</td></tr></table>",
        "<table><tr><td>1 < 2</td><td>x</td></tr></table>",
        "<table><tr><td><script>if (a<b) '<td>'</script>y</td></tr></table>",
        "<table><tr><td a=1 a=2 rowspan=\"2\" rowspan=3 checked>z</td></tr><tr></tr><tr><td>w",
        "<table><tr><td/>q</td><td colspan=>r</td></tr></table", "<td>out</td><table></table></table>t<table><th>u", "<table><tr><td>&copy 5 &#65; &bogus;</td></tr></table>",
        "<table><tr><td><textarea><td>k</textarea></td></tr></table>", "<table><tr><td>a</td x></tr></table>",
    ]
    for html in pages:
        page = details._Reader()
        page.feed(html)
        page.close()
        assert details._read(html) == page.tables, html


def test_pages_are_read_without_a_shuffle(spark):
    """Also pages that repeat a key keep their rows to themselves."""
    one = "<table><tr><th>Team</th><th>Q1</th></tr><tr><td>x</td><td>{}</td></tr></table>"
    pages = spark.createDataFrame([(1, one.format(3)), (1, one.format(4))], "id long, html string")
    out = details.details(pages, "id")
    assert sorted((r.section, r.name, r.side, r.value) for r in out.collect()) == [("period", "q1", "x", 3.0), ("period", "q1", "x", 4.0)]
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
