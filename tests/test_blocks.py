import random
import time
from html.parser import HTMLParser

from presswork.operators.blocks import html_blocks

HTML = (
    "<h1>skip</h1><p class='a'>One &amp; <b>two</b></p><!-- <p>no</p> -->"
    '<img src="a.svg" alt="icon"><img src=\'b.png\'/><IMG alt=x src=c.SVG>'
    "<ul><li>x</li><li class=q>y <b>z</b></ul>"
    "<script>'<p>no</p>'</script><div><blockquote><p>quoted</p></blockquote></div><img>"
)


def test_blocks_in_order(spark):
    df = spark.createDataFrame([(1, HTML), (2, None), (3, "no blocks")], "id int, html string")
    rows = html_blocks(df, "id", "html").orderBy("id", "pos", "item").collect()
    got = [(r.id, r.pos, r.item, r.kind, r.text, r.src, r.alt, r.is_svg) for r in rows]
    assert got == [
        (1, 0, 0, "p", "One & two", None, None, None),
        (1, 1, 0, "img", None, "a.svg", "icon", True),
        (1, 2, 0, "img", None, "b.png", None, False),
        (1, 3, 0, "img", None, "c.SVG", "x", False),
        (1, 4, 0, "li", "x", None, None, None),
        (1, 4, 1, "li", "y z", None, None, None),
        (1, 5, 0, "blockquote", "quoted", None, None, None),
        (1, 6, 0, "img", None, None, None, False),
    ]


class Blocks(HTMLParser):
    """Outermost p, ul and blockquote elements, by a stack of open elements."""

    def __init__(self):
        super().__init__()
        self.stack, self.rows, self.depth = [], [], None

    def handle_starttag(self, tag, attrs):
        if tag in ("p", "ul", "blockquote") and self.depth is None:
            self.rows.append([tag, ""])
            self.depth = len(self.stack)
        self.stack.append(tag)

    def handle_endtag(self, tag):
        if tag in self.stack:
            while self.stack.pop() != tag:
                pass
            if self.depth is not None and len(self.stack) <= self.depth:
                self.depth = None

    def handle_data(self, data):
        if self.depth is not None:
            self.rows[-1][1] += data


def test_unclosed_and_nested_blocks_as_a_stack_parser(spark):
    dice = random.Random(8)
    parts = ["<p>", "</p>", "<ul>", "</ul>", "<blockquote>", "</blockquote>", "<b>", "</b>", "x", " y ", "z"]
    pages = [(i, "".join(dice.choices(parts, k=dice.choice([3, 8, 30])))) for i in range(300)]
    # A list has rows for its items only, so these lists have none.
    shown = {}
    for r in html_blocks(spark.createDataFrame(pages, "id int, html string"), "id", "html").collect():
        shown.setdefault(r.id, []).append((r.pos, r.kind, r.text))
    for i, page in pages:
        parser = Blocks()
        parser.feed(page)
        parser.close()
        expected = [(pos, kind, text) for pos, (kind, text) in enumerate(parser.rows) if kind != "ul"]
        assert sorted(shown.get(i, [])) == expected, page


def test_items_of_open_and_nested_lists(spark):
    pages = ["<ul><li>x", "<ul><li>a<ul><li>b</li></ul>c</li></ul>", "<ul><li>x<li>y</ul>z<ul><li>w</ul>",
             "<p>one<p>two", "<ul></li><li>a</li>b</ul>", "<!-- <p>a"]
    found = html_blocks(spark.createDataFrame(list(enumerate(pages)), "id int, html string"), "id", "html")
    rows = [(r.id, r.pos, r.item, r.text) for r in found.orderBy("id", "pos", "item").collect()]
    assert rows == [(0, 0, 0, "x"), (1, 0, 0, "abc"), (1, 0, 1, "b"), (2, 0, 0, "x"), (2, 0, 1, "y"),
                    (2, 1, 0, "w"), (3, 0, 0, "onetwo"), (4, 0, 0, "a")]


def test_blocks_across_runs_of_tags(spark):
    """Pages of many hundred tags, as a stack parser."""
    dice = random.Random(9)
    parts = ["<p>", "</p>", "</p>", "<ul>", "</ul>", "<blockquote>", "</blockquote>", "<b>", "</b>", "x", "z"]
    pages = [(i, "".join(dice.choices(parts, k=900))) for i in range(12)]
    shown = {}
    for r in html_blocks(spark.createDataFrame(pages, "id int, html string"), "id", "html").collect():
        shown.setdefault(r.id, []).append((r.pos, r.kind, r.text))
    for i, page in pages:
        parser = Blocks()
        parser.feed(page)
        parser.close()
        expected = [(pos, kind, text) for pos, (kind, text) in enumerate(parser.rows) if kind != "ul"]
        assert sorted(shown.get(i, [])) == expected


def test_long_pages_and_lists(spark):
    """Many blocks and items take time in proportion; a list copied at every block took minutes."""
    pages = [(1, "<p>x</p>" * 32_000), (2, "<ul>" + "<li>y" * 32_000), (3, "<ul>" + "<li>z</li>" * 32_000 + "</ul>")]
    start = time.perf_counter()
    rows = html_blocks(spark.createDataFrame(pages, "id int, html string"), "id", "html").groupBy("id").count()
    assert {tuple(r) for r in rows.collect()} == {(1, 32_000), (2, 32_000), (3, 32_000)}
    assert time.perf_counter() - start < 60
