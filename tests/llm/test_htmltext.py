import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from factloom.llm.htmltext import TEXT, text_of, with_text


@pytest.mark.parametrize(
    ("source", "want"),
    [
        ("<title>no</title><p>One <b>two</b>\n three<p>Four", "One two three\n\nFour"),
        ("a<br>b<br><br>c", "a\nb\n\nc"),
        ("<div>a</div><div>b</div>c", "a\nb\nc"),
        ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>e", "  * a\n  * b\n      * c\n  * d\n\ne"),
        ("<ol start=9><li>x<li>y</ol>", " 9. x\n10. y"),
        ("<table><tr><th>N<th>Q<tr><td>Apple<td>3<br>4<tr><td colspan=2>sum<td>x</table>z", "N      Q\nApple  3\n       4\nsum       x\n\nz"),
        ("<table><td>a<td rowspan=2>b<tr><td>c</table>", "a  b\nc"),
        ("<table><tr><td><table><tr><td>in</table><td>out</table>", "in  out"),
        ("<table>stray<tr><td>x</table>", "stray\n\nx"),
        ("<pre>\n a  b\n  c</pre>d", " a  b\n  c\n\nd"),
        ("<div hidden>no</div><i style='display: none'>no</i><span style=visibility:hidden>no<b style='visibility:visible'>yes</b></span>", "yes"),
        ("<script>if (a<b) '</p>'</script>x<style>p{}</style><noscript>no</noscript><template>no</template>", "x"),
        ("<details><summary>S</summary>no<p>no</p></details><details open>yes</details>", "S\nyes"),
        ("a &amp; b &lt;p&gt; &copy", "a & b <p> ©"),
        ("a <!-- no --> b<!-- no", "a b"),
        ("x < y <z", "x < y"),
        ("a</p>b</i></div>", "ab"),
        ("<dl><dt>T<dd>def<dt>U</dl>", "T\n    def\nU"),
        ("<select><option>a<option>b</select>", "a\nb"),
        ("<a title='>' href=x>y</a>", "y"),
        ("", ""),
        ("<p></p> \n", ""),
        (None, None),
    ],
)
def test_rendering(source, want):
    assert text_of(source) == want


PIECES = ["<p>", "</p>", "<li>", "<ul>", "</ul>", "<table>", "<tr>", "<td>", "</table>", "<div>", "</div>", "<pre>", "</pre>", "<br>", "<h1>", "</td>", "<ol>", "<b>", "</b>", "<caption>", "<details open>", "<!--x-->", "<", ">", "&", " "]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PIECES + [f"w{i}" for i in range(8)]), max_size=40))
def test_all_visible_words_are_kept_in_any_soup(parts):
    text = text_of(" ".join(parts))
    for word in {p for p in parts if p[0] == "w"}:
        assert text.split().count(word) == parts.count(word) or f"<{word}" in "".join(parts) or "<" in parts


@pytest.mark.parametrize("unit", ["<div>", "<p>a<b>", "<table><tr><td>x", "<ul><li>x", "<a '\"", "<!-- ", "<b", "</p>", "<td>x", "&amp"])
def test_long_and_deep_pages(unit):
    began = time.time()
    text_of(unit * (2_000 if "table" in unit else 20_000))
    assert time.time() - began < 20


def test_with_text(spark):
    rows = [(1, "<p>a", "x"), (2, None, "x"), (3, "", "x"), (1, "<p>a", "x")]
    found = with_text(spark.createDataFrame(rows, "page_id long, html string, text string")).collect()
    assert sorted(((r["page_id"], r[TEXT], r["text"]) for r in found), key=str) == sorted([(1, "a", "x"), (2, None, "x"), (3, "", "x"), (1, "a", "x")], key=str)
    assert with_text(spark.createDataFrame([], "page_id long, html string")).count() == 0


def test_all_columns_are_aligned_and_wide_cells_wrap():
    wide = " ".join(f"word{i}" for i in range(40))
    text = text_of(f"<table><tr><td>{wide}<td>right<td>end<tr><td>a<td>b<td>c</table>")
    lines = text.split("\n")
    at = lines[0].index("right")
    assert max(map(len, lines)) < 90 and at <= 62 and lines[-1].index("b") == at and lines[-1].index("c") == lines[0].index("end")
    assert text.split() != [] and sorted(text.split()) == sorted([*wide.split(), "right", "end", "a", "b", "c"])


def test_a_word_wider_than_a_column_keeps_the_others_aligned():
    word = "x" * 200
    lines = text_of(f"<table><tr><td>{word}<td>right<tr><td>short<td>b</table>").split("\n")
    assert lines == [word, "       right", "short  b"]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.text("ab ", max_size=150), min_size=1, max_size=4), min_size=1, max_size=5))
def test_no_character_of_a_cell_is_lost(rows):
    source = "<table>" + "".join("<tr>" + "".join(f"<td>{c}" for c in r) for r in rows) + "</table>"
    text = text_of(source)
    assert sorted(text.split()) == sorted(w for r in rows for c in r for w in c.split())


def test_one_wide_cell_does_not_multiply_the_output():
    source = "<table><tr><td>" + "y" * 100_000 + "<td>x" + "<tr><td>a<td>b" * 5_000 + "</table>"
    assert len(text_of(source)) < 2 * len(source)


def test_a_column_named_like_the_added_one_is_replaced(spark):
    found = with_text(spark.createDataFrame([(1, "<p>a", "x")], f"page_id long, html string, {TEXT} string")).collect()
    assert [r[TEXT] for r in found] == ["a"]


def page_and_text(seed):
    """A page of flat blocks, and its text by the plain rules of each block."""
    import random

    rng = random.Random(seed)
    words = lambda n: " ".join(rng.choices(["alpha", "be", "gamma", "x"], k=rng.randint(1, n)))
    source, out = [], []  # (gap before, lines, gap after)
    for _ in range(rng.randint(1, 8)):
        kind = rng.choice(["p", "h2", "div", "ul", "ol", "table", "pre", "blockquote", "hidden"])
        if kind in ("p", "h2"):
            text = words(5)
            source.append(f"<{kind}>{text}</{kind}>")
            out.append((1, [text], 1))
        elif kind == "div":
            text = words(5)
            source.append(f"<div>{text}</div>")
            out.append((0, [text], 0))
        elif kind in ("ul", "ol"):
            items = [words(3) for _ in range(rng.randint(1, 12))]
            source.append(f"<{kind}>" + "".join(f"<li>{x}" for x in items) + f"</{kind}>")
            marks = ["* " if kind == "ul" else f"{i}. " for i in range(1, len(items) + 1)]
            out.append((1, [m.rjust(4) + x for m, x in zip(marks, items, strict=True)], 1))
        elif kind == "table":
            columns = rng.randint(1, 4)
            cells = [[words(4) for _ in range(columns)] for _ in range(rng.randint(1, 4))]
            source.append("<table>" + "".join("<tr>" + "".join(f"<td>{c}" for c in row) for row in cells) + "</table>")
            widths = [max(len(row[i]) for row in cells) for i in range(columns)]
            out.append((1, ["  ".join(c.ljust(w) for c, w in zip(row, widths, strict=True)).rstrip() for row in cells], 1))
        elif kind == "pre":
            lines = [words(2), "  " + words(2)]
            source.append("<pre>" + "\n".join(lines) + "</pre>")
            out.append((1, lines, 1))
        elif kind == "blockquote":
            text = words(4)
            source.append(f"<blockquote>{text}</blockquote>")
            out.append((1, ["    " + text], 1))
        else:
            source.append("<p hidden>no</p><script>no</script>")
    lines, gap = [], 0
    for before, block, after in out:
        lines += [""] * (max(gap, before) if lines else 0) + block
        gap = after
    return "\n".join(source), "\n".join(lines)


def test_query_equals_the_plain_rules(spark, tmp_path):
    from factloom.llm.queries import op8_html_layout

    pages = {i: page_and_text(i) for i in range(400)}
    rows = [(i, "u", source) for i, (source, _) in pages.items()]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    for r in op8_html_layout(spark, str(tmp_path)).collect():
        assert r["text"] == pages[r["page_id"]][1] and r["n_chars"] == len(r["text"]), pages[r["page_id"]][0]
