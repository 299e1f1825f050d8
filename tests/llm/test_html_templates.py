"""Pages of several makes, none of them that of the tables: their article is found whole, by taught weights and by the priors alone."""

from __future__ import annotations

import duckdb
import pytest

from quarry.llm import html_region


def words(n, k="w"):
    return " ".join(f"{k}{i}" for i in range(n))


def paragraphs(*texts):
    return "".join(f"<p>{t}</p>" for t in texts)


LONG = [words(40, "a"), words(9, "b"), words(60, "c")]
BLOG = f"""<html><body><div id="top-menu"><ul><li><a href=/>Home</a></li><li><a href=/about>About us</a></li></ul></div>
<div id="wrap"><div class="hentry post"><h2 class="entry-title">On <em>things</em></h2><div class="entry-content">{paragraphs(*LONG)}<ul><li>one point</li><li>another</li></ul></div></div>
<div id="comments"><h3>Two responses</h3>{paragraphs(words(80, "x"), words(30, "y"))}</div></div><div class="sidebar widget"><h4>Recent</h4><ul><li><a>first</a></li></ul></div></body></html>"""
NEWS = f"""<body><header><h1>The Paper</h1><nav><a>World</a></nav></header><main><article><header><h1>Headline</h1><span>by A. Writer</span></header>{paragraphs(*LONG[:2])}
<div class="ad-slot">Buy now</div>{paragraphs(LONG[2])}<aside>{paragraphs(words(70, "z"))}</aside></article><article>{paragraphs(words(25, "d"))}</article></main><footer>All rights</footer></body>"""
WIKI = f"""<body><div id="mw-navigation"><div class="portal"><a>Main page</a> <a>Contents</a></div></div><div id="content" class="mw-body"><h1 id="comments">Comments</h1><table><tr><th>Born</th><td>1 May</td></tr></table>
{paragraphs(f"{words(20, 'a')} <a href=x>{words(3, 'l')}</a> {words(20, 'b')}", f"<a href=y>{words(25, 'm')}</a>", words(30, "c"))}<h2 id="legal">Legal</h2>{paragraphs(words(12, "d"))}</div><div class="footer">Terms apply</div></body>"""
TABLE = f"""<table><tr><td class="menu"><a>one</a><br><a>two</a></td><td><h3>Old page</h3>Text before {words(30)}<br><br>and after {words(12, 'v')}<hr>{words(8, 'u')}</td></tr></table><div class=copyright>by someone</div>"""
LAW = f"""<div class='content legal-text'><h1>Act</h1><div class='social-science'>{paragraphs(words(15))}</div><section class='notice-of-rights'>{paragraphs(words(10, 'r'))}</section><div class='related-work'>{paragraphs(words(9, 's'))}</div></div><div class='cookie-banner'>We use {words(30, 'k')}</div>"""
FORMS = f"""<main>{paragraphs("Use <label>this</label> word", f"Press <button>no</button> here {words(20)}", "Pick <select><option>x</option></select> one")}<form>{paragraphs("Name")}</form></main>"""
DEEP = "<div class='content'>" + "<div class='layer-x'>" * 400 + f"<div class='comments'>{paragraphs(words(50, 'c'))}</div>{paragraphs(words(30))}" + "</div>" * 401

PAGES = {
    "blog": (BLOG, ["On things", *LONG, "one point", "another"]),
    "news": (NEWS, ["Headline", *LONG, words(25, "d")]),
    "wiki": (WIKI, ["Comments", "Born", "1 May", f"{words(20, 'a')} {words(3, 'l')} {words(20, 'b')}", words(25, "m"), words(30, "c"), "Legal", words(12, "d")]),
    "table": (TABLE, ["Old page", f"Text before {words(30)} and after {words(12, 'v')}", words(8, "u")]),
    "law": (LAW, ["Act", words(15), words(10, "r"), words(9, "s")]),
    "forms": (FORMS, ["Use this word", f"Press here {words(20)}", "Pick one"]),
    "deep": (DEEP, [words(30)]),
    "linked": (f"<article>{paragraphs('One two three four.', f'<a href=x>{words(20)}</a>', 'End words here now.')}</article>", ["One two three four.", words(20), "End words here now."]),
}


@pytest.fixture(scope="module")
def taught():
    rows = duckdb.sql("SELECT html FROM '/root/testdata/sf0.01/pages.parquet' ORDER BY page_id").fetchall()
    return html_region.weights(html_region.tally(r[0] for r in rows))


@pytest.mark.parametrize("name", PAGES)
@pytest.mark.parametrize("how", ["taught", "prior"])
def test_whole_article_of_each_make(name, how, taught):
    page, want = PAGES[name]
    assert html_region.extract(page, taught if how == "taught" else html_region.weights({})) == "\n\n".join(want)


def test_the_scan_leaves_out_what_no_name_tells(taught):
    """Menus and tag lists in plain containers: without the scan they would stay."""
    page = f"<body><div class=q1>{''.join(f'<div><a href=/{i}>topic {i}</a></div>' for i in range(12))}</div><div class=q2>{paragraphs(*LONG)}</div><div class=q3>{''.join(f'<span><a>tag {i}</a></span><hr>' for i in range(12))}</div></body>"
    assert html_region.extract(page, taught) == "\n\n".join(LONG)
    left = [x.text for x in html_region.parse(page, taught) if x.text and not x.low and x.kind != "boilerplate"]
    assert any("topic" in t for t in left) and any("tag" in t for t in left)


def test_names_are_taught_by_labelled_pages():
    """A name that says nothing by itself, on pages that mark their article, and then on one that doesn't."""
    pages = [f"<div class='qx7'>{paragraphs(words(20, 'o'))}</div><article><div class=kk>{paragraphs(words(30))}</div></article>" for _ in range(8)]
    weight = html_region.weights(html_region.tally(pages))
    assert weight[".qx#"] < -3 and weight[".kk"] > 1
    page = f"<div class='kk'>{paragraphs(words(30))}</div><div class='qx9'>{paragraphs(words(20, 'o'))}</div>"
    assert html_region.extract(page, weight) == words(30) != html_region.extract(page, html_region.weights({}))


def test_nested_elements_of_a_name_count_once():
    seen = html_region.tally([f"<article><div class=a><div class=a>{paragraphs(words(5))}</div>{paragraphs(words(3))}</div></article>"])
    assert seen[".a"] == [8, 0, 1]
