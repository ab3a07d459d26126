import time

import pytest

from outings.llm.layout import WIDEST, extract_layout, render

CASES = [
    ("<p>One<p>Two <b>bold</b>\n text<div>block</div>after", "One\n\nTwo bold text\n\nblock\nafter"),
    ("<ul><li>a<li>b<ol start=3><li>x</li><li>y</ol><li>c</ul>", "- a\n- b\n  3. x\n  4. y\n- c"),
    ("<table><tr><th>Name<th>N<tr><td>Al<td>1</td></tr><tr><td>Barbara<br>second<td>22</table>", "Name     N\nAl       1\nBarbara  22\nsecond"),
    ("<table><td>a<table><td>in<td>ner</table><td>b</table>", "a        b\nin  ner"),
    ("<h1>T &amp; &eacute;</h1>x<br>y<hr>z", "T & é\n\nx\ny\n\nz"),
    ("a<script>if (x < 1) { '</p>' }</script>b<style>p{}</style><!-- no <p> -->c", "abc"),
    ("<title>no</title><p hidden>no</p><p style='color:red; DISPLAY : none'>no <b>no</b></p><p style=visibility:hidden>no</p>yes", "yes"),
    ("<details>no<summary>sum</summary>no</details><details open><summary>s</summary>in</details>x", "sum\ns\nin\nx"),
    ("<dialog>no</dialog><dialog open>yes</dialog><textarea>no</textarea><img alt='pic'>", "yes\npic"),
    ("<pre>  keep\n   this</pre>end", "  keep\n   this\n\nend"),
    ("1 < 2 <3 & &lt;p> x", "1 < 2 <3 & <p> x"),
    ("<dl><dt>t<dd>d<dt>u<dd>e</dl>", "t\n  d\nu\n  e"),
    ("<blockquote>q<blockquote>r</blockquote></blockquote>s", "  q\n\n    r\n\ns"),
    ("a</b></div></p>b", "a\n\nb"),
    ("<a title='x > y'>l</a><a href=\"<p>\">m</a>", "lm"),
    ("<p>unclosed <script>never", "unclosed"),
    ("<select><option>no<option>no</select>x<input type=hidden value=no>", "x"),
    ("", ""), ("<div> <p>\n</p></div>", ""), ("<", "<"), ("a<!-- open", "a"), ("&nbsp;x&#0;", "x"),
]


@pytest.mark.parametrize("page,text", CASES)
def test_rendered(page, text):
    assert render(page).replace("\xa0", "").replace("�", "") == text


def test_a_long_cell_does_not_widen_the_others():
    page = "<table>" + "".join(f"<tr><td>{i}<td>x" for i in range(3000)) + f"<tr><td>{'w' * 100_000}<td>y</table>"
    assert len(render(page)) < 100_000 + 3000 * (WIDEST + 10)


def test_time_follows_the_length():
    for part in ("<p>x", "<b>x", "<div>x", "<ul><li>x", "<table><tr><td>x", "<td>x", "</p>", "<li></b>", "<a href='", "<x <", "<!--", "<a '>\"", "<"):
        took = []
        for n in (3000, 30_000):
            start = time.process_time()
            render(part * n)
            took.append(time.process_time() - start)
        assert took[1] < 30 * max(took[0], 0.02), (part, took)


def test_every_visible_word_once(spark):
    """Against brute force over pages whose markup is regular."""
    import random
    import re

    r = random.Random(1)

    def page():
        out, n = [], 0
        for _ in range(r.randint(0, 30)):
            n += 1
            out.append(r.choice([f"<p>w{n}</p>", f"<div><b>w{n}</b> v{n}</div>", f"<ul><li>w{n}</li></ul>", f"<script>no{n}</script>",
                                 f"<table><tr><td>w{n}</td><td>v{n}</td></tr></table>", f"<div hidden><p>no{n}</p></div>"]))
        return "".join(out)

    pages = [(i, page(), None) for i in range(80)] + [(90, None, "x"), (91, "", None), (None, "<p>a", "y")]
    frame = spark.createDataFrame(pages, "page_id long, html string, layout string")
    got = extract_layout(frame)
    assert got.columns[-1] == "layout_" and got.count() == len(pages)
    for row in got.collect():
        text = row.layout_.text
        if row.html is None:
            assert text is None and row.layout_.n_chars is None
            continue
        seen = re.findall(r"[wv]\d+|\ba\b", re.sub(r"<script>.*?</script>|<div hidden>.*?</div>", "", row.html).replace("<", " <"))
        assert re.findall(r"\w+", text) == seen and row.layout_.n_chars == len(text)
    assert extract_layout(frame.limit(0)).count() == 0


@pytest.mark.parametrize("page,text", [
    ("<html><head><title>no</title><p>text<div>more</div>", "text\n\nmore"),
    ("<head><meta charset=utf-8><style>no</style>\n text <b>too</b></head>", "text too"),
    ("<head><noscript>on</noscript><title>no</title><p>z", "on\n\nz"),
    ("<head><title>no</title></head><p>a<head>b</head>c", "abc"),
    ("a <math><mi>x</mi><mo>=</mo><mn>12</mn><annotation>no</annotation></math> b", "a x=12 b"),
    ("a<svg><title>no</title><defs/><style/><g>no<text>La<tspan>bel</tspan></text><text>two</text></g><path d=''/></svg>b", "a Label two b"),
    ("<svg><defs><text>no</text></defs></svg><svg><path d=''><p>out", "out"),
    ("<p>x<svg><foreignObject><p>in</p>t</foreignObject></svg>y", "x\n\nin\n\nt y"),
])
def test_heads_without_an_end_formulas_and_drawings(page, text):
    assert render(page) == text


@pytest.mark.parametrize("part", ["<b>", "<font>", "<div>", "<span><i>"])
def test_elements_stay_what_they_are_at_any_depth(part):
    deep = part * 400
    assert render(deep + "<div hidden><p>secret</div>seen") == "seen"
    assert render(deep + "<table><tr><td>Al<td>1<tr><td>Bob<td>22</table>") == "Al   1\nBob  22"
    assert render(deep + "<ul><li>a<li>b</ul>") == "- a\n- b"


def test_words_of_tables_at_any_depth():
    for n in (5, 99, 101, 400):
        page = "<table><tr><td>" * n + "a<td>b<tr><td hidden>no<td>c" + "</table>" * n + "end"
        assert render(page).split() == ["a", "b", "c", "end"]


@pytest.mark.parametrize("page,text", [
    ("<table><tr><td colspan=2>ab<td>c<tr><td>d<td>e<td>f</table>", "ab    c\nd  e  f"),
    ("<table><tr><td rowspan=2>a<td>b<tr><td>c<tr><td>d<td>e</table>", "a  b\n   c\nd  e"),
    ("<table><tbody><tr><td rowspan=0>a<td>b<tr><td>c<tbody><tr><td>d<td>e</table>", "a  b\n   c\nd  e"),
    ("<table><tr><td>a<td rowspan=2 colspan=2>b<td>c<tr><td>d<td>e</table>", "a  b  c\nd     e"),
    (f"<table><tr><td>a<td>b<tr><td>{'w' * 41}<td>c</table>", f"a  b\n{'w' * 41}\n   c"),
    (f"<table><tr><td colspan=3>{'w' * 41}<td>z<tr><td>a<td>b<td>c<td>d</table>", f"{'w' * 41}\n         z\na  b  c  d"),
    ("<table><tr><td colspan=1000 rowspan=65534>a<td>b<tr><td>c</table>", "a  b\n   c"),
])
def test_cells_lie_in_their_columns(page, text):
    assert render(page) == text


def test_time_follows_the_length_with_spans():
    took = []
    for n in (1000, 10_000):
        start = time.process_time()
        assert len(render("<table><tr>" + "<td rowspan=0 colspan=1000>x" * n + "<tr><td>y" * n)) < 1100 * n
        took.append(time.process_time() - start)
    assert took[1] < 30 * max(took[0], 0.02)


@pytest.mark.parametrize("page,text", [
    ("<p><a title=don't>one</a> two it's three</p>", "one two it's three"),
    ("<p>a <b '>b</b> c <b '>d</b> e</p>", "a b c d e"),
    ("<table><tr><td width=\"10\"\">A</td><td width=\"10\"\">B</td></tr></table>", "A  B"),
    ("<a '>t</a>" * 20 + "<a title='x > y'>l</a>", "t" * 20 + "l"),
    ("<a title = \"x > y\" \">l</a><a b=>m</a><a =\">n</a>", "lmn"),
    ("<p title=\"a\"b=\"'>\">x</p class='>'>y", "x\n\ny"),
    ("a<b title=\"c>d<b>e</b>", "ade"),  # never closed: ends at its first >
    ("<p a='/' hidden>no</p><p a=/hidden>yes", "yes"),
])
def test_quotes_delimit_only_where_a_value_begins(page, text):
    assert render(page) == text


def told(page):
    """The characters outside tags, by HTML's tokenizer states, one at a time; None: the page ends within a tag."""
    out, state, quote, begun = [], "text", "", 0
    for i, c in enumerate(page):
        space = c in " \t\n\r\f"
        if state == "text":
            if c == "<" and (page[i + 1:i + 2].isalpha() or page[i + 1:i + 2] == "/" and page[i + 2:i + 3].isalpha()):
                state, begun = "tag", i
            else:
                out.append(c)
        elif state == "quoted":
            if c == quote:
                state = "before"
        elif c == ">":
            state = "text"
        elif state == "tag":
            state = "before" if space or (c == "/" and i > begun + 1) else "tag"
        elif state == "before":
            state = "before" if space or c == "/" else "name"
        elif state in ("name", "after"):
            if c == "/":
                state = "before"
            elif c == "=":
                state = "value"
            elif space:
                state = "after"
            else:
                state = "name"
        elif state == "value":
            if c in "\"'":
                state, quote = "quoted", c
            elif not space:
                state = "bare"
        elif state == "bare" and space:
            state = "before"
    return "".join(out) if state == "text" else None


def test_broken_attributes_against_the_tokenizers_states():
    import random

    r, seen = random.Random(3), 0
    for _ in range(20_000):
        page = "".join(r.choice(["<b", "</b", ">", " ", " ", "/", "=", "\"", "'", "x", "y=", "x=\"", "z='", "w", "\t", "don't "])
                       for _ in range(r.randint(1, 25))) + ">end"
        text = told(page)
        if text is not None:
            seen += 1
            assert "".join(render(page).split()) == "".join(text.split()), page
    assert seen > 5000


def test_time_follows_the_length_with_broken_quotes():
    for part in ("<a x=\">\"", "<a x='>\"", "<a x=\">'", "<a '=\">\" ", "<a x=\"", "<a \"='>", "<a/x='>\"/ y=\">'", "</a x=\">\"", "<a x =  '\">"):
        took = []
        for n in (3000, 30_000):
            start = time.process_time()
            render(part * n + ">")
            took.append(time.process_time() - start)
        assert took[1] < 30 * max(took[0], 0.02), (part, took)
