"""Main text of pages of many layouts, against written answers."""

import time

import pytest

from lodestone.llm import main_text

A = "This is the first paragraph of the article, with quite some words, so that it counts as prose."
B = "The second one is long as well: it goes on about the weather, the harvest and the price of rye."
S = "Short end."
OTHER = "Words about something else, in a box beside the text, that are as long as a paragraph of it or longer than that."

PAGES = {
    "article": (f"<nav>Menu</nav><div class=ad>{OTHER}</div><article><h1>T</h1><p><b>{A}<br><p>{S}</p></article><footer>{OTHER}</footer>", ["T", A, S]),
    "classes": (f"<div id=header><h1>Site</h1></div><div class=menu><a href=/>Home</a> <a href=/a>A</a></div><div class=content><h1>T</h1><p>{A}</p><p>{B}</p><p>{S}</p></div><div class=sidebar><p>{OTHER}</p></div>", ["T", A, B, S]),
    "no markup": (f"<ul><li><a href=1>One</a><li><a href=2>Two</a></ul><h1>T</h1><p>{A}<p>{B}<p>{S}<hr><small>Copyright me</small>", ["T", A, B, S]),
    "surge and dive": (f"<div>My site</div><div>The tag line</div><h1>T</h1><p>{A}</p><p>{B}</p><div>Contact</div><div>Imprint</div>", ["T", A, B]),
    "main": (f"<body class=has-sidebar><header><h1>Site</h1></header><main><header><h1>T</h1></header><p>{A}</p><aside>{OTHER}</aside><p>{S}</p><section id=comments>{OTHER}</section></main>", ["T", A, S]),
    "comments": (f"<article><h1>T</h1><p>{S}</p><article class=comment><p>{OTHER}</article></article><div id=disqus_thread>{OTHER}</div>", ["T", S]),
    "comment heading": (f"<div class=post><h1>T</h1><p>{A}</p><p>{B}</p><h3>3 Comments</h3><p>{OTHER}</p></div>", ["T", A, B]),
    "notice": (f"<div class='cookie-notice'>{OTHER}{OTHER}</div><div><div><h2>T</h2><div>{A}</div><div>{B}</div></div></div><form><p>{OTHER}</p><input><button>Go</button></form>", ["T", A, B]),
    "advert inside": (f"<article><p>{A}</p><div class='ad'>Buy!</div><p>{S}</p><figure><img><figcaption>Caption</figcaption></figure></article>", [A, S, "Caption"]),
    "wrapped in a form": (f"<form id=aspnetForm><h1>T</h1><div class=x><p>{A}</p><p>{B}</p></div></form>", ["T", A, B]),
    "misleading wrapper": (f"<div id=page class=sidebar-right><div class=entry-header><h1>T</h1></div><div class=entry-content><p>{A}</p><p>{B}</p></div></div><div class=comments><p>{OTHER * 4}</p></div>", ["T", A, B]),
    "short article": ("<nav>x</nav><article>Tiny.</article><p>" + OTHER, ["Tiny."]),
    "several articles": (f"<main><h1>T</h1><article><p>{A}</article><article><p>{B}</article><article><p>{A}</article></main>", ["T", A, B, A]),
    "blocks": ("<main><h1>T</h1><ul><li>a<li>b\n c</ul><table><tr><td>1<td>2</table><pre>x\n  y</pre>a<b>b</b>c&nbsp;&amp;lt; d<br>e</main>", ["T", "a", "b c", "1 2", "x y", "abc &lt; d e"]),
    "references": ("<article><p>caf&eacute; &copy 2 &#8364; a &lt;b&gt; c < d &amp;amp;</article>", ["café © 2 € a <b> c < d &amp;"]),
    "scripts": (f"<article><script>var t='<p>no</p>';</script><style>p{{}}</style><p>{A}</p><!-- <p>no</p> --><noscript>no</noscript><template><p>no</template></article>", [A]),
    "quotes": ('<article><p title="a > b" data-x=\'<p>\'>one</p><p title="open>two</p></article>', ["one", "two"]),
    "unfinished": ("<article><p>one<p>two <b>x</b", ["one", "two x</b"]),
    "hidden": (f"<article><p hidden>no</p><p style='display: none'>no</p><p aria-hidden=true>no</p><p>{A}</article>", [A]),
    "nothing": ("<title>x</title><nav>x</nav>", []),
}


@pytest.mark.parametrize("name", PAGES)
def test_layout(name):
    html, want = PAGES[name]
    assert main_text.main_text(html).split("\n") == (want or [""])


@pytest.mark.parametrize("piece", ["<b>x", "<div class=ad>x", "<p><td>", '<a b="', "<li>x<div>", "</b>x<i>", "<article>x", "<h2>Comments</h2>x", "<p>a<center>", "&amp;<", "<!--", "<a href='x'>y", "<script>", "<p><td><span class=ad><li>"])
def test_odd_pages_take_linear_time(piece):
    main_text.main_text(piece * 1000)
    began = time.process_time()
    main_text.main_text(piece * 100_000)
    assert time.process_time() - began < 20


def test_rows(spark):
    rows = [(1, "u1", PAGES["article"][0]), (1, "u1", PAGES["article"][0]), (2, None, None), (None, "u3", ""), (4, "u4", "<p>" + "wörd " * 100_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted(map(tuple, main_text.extract_text(pages).collect()), key=repr)
    text = "\n".join(PAGES["article"][1])
    assert got == sorted([(1, "u1", text, len(text))] * 2 + [(2, None, "", 0), (None, "u3", "", 0), (4, "u4", ("wörd " * 100_000).strip(), 499_999)], key=repr)
    clash = pages.selectExpr("*", "'x' AS text", "1 AS n_chars", "2 AS node", "3 AS parent")
    assert sorted(map(tuple, main_text.extract_text(clash).collect()), key=repr) == got
    assert main_text.extract_text(pages.limit(0)).collect() == []
