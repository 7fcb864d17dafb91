"""Tables that span, nest and grow, and what a closed or unseen element shows."""

import time

from crestline.llm import html


def test_rows_that_span():
    page = "<table><tr><td rowspan=2>a<td>b<td>c<tr><td>d<td>e<tr><td>f<td>g<td>h</table>"
    assert html.page_text(page) == "a  b  c\n   d  e\nf  g  h"


def test_cells_keep_their_blocks():
    page = "<table><tr><td><h2>Title</h2><p>first</p><ul><li>one<li>two</ul><td>side</table>"
    assert html.page_text(page) == "Title  side\nfirst\n- one\n- two"
    layout = "<table><tr><td><h1>Head</h1><p>one</p><table><tr><td>k<td>v<tr><td>key<td>w</table></table>"
    assert html.page_text(layout) == "Head\none\nk    v\nkey  w"


def test_wide_cells_do_not_pad_the_table():
    page = "<table><tr><td>" + "x" * 20_000 + "<td>y" + "<tr><td>a<td>b" * 2_000 + "</table>"
    text = html.page_text(page)
    assert len(text) < 2 * len(page) and text.startswith("x" * 20_000 + "\ny\na  b\n")
    for page in (
        "<table>" + ("<tr><td colspan=1000 rowspan=60000>a<td>b") * 3_000 + "</table>", "<table><tr>" + "<td>cell of some width" * 3_000 + "<tr><td colspan=1000><td>x" * 3_000 + "</table>",
    ):
        began = time.time()
        assert len(html.page_text(page)) < 40 * len(page) and time.time() - began < 30


def test_what_is_seen():
    assert html.page_text("<details><summary>more</summary>hidden</details>z") == "more\nz"
    assert html.page_text("<details open><summary>more</summary>shown</details>") == "more\nshown"
    assert html.page_text("<dialog>no</dialog><dialog open>yes</dialog>") == "yes"
    assert html.page_text("<div style='visibility:hidden'>a<p style='visibility: visible'>b</p><p>c</div>d") == "b\n\nd"
    assert html.page_text("<div style='display:none'>a<p style='visibility:visible'>b</div>c") == "c"
