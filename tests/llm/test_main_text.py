import html
import random
import re

import duckdb
import pytest

from loomspan.llm.main_text import extract, main_text

A = "The first paragraph, which is long enough to count, tells of rivers, mountains and seas."
B = "The second one goes on, with a few commas, and says no more than it must."
C = "Short."

PAGES = {
    "article": (f"<nav><a href=/>Home</a></nav><article><h1>Head</h1><p>{A}<p>{B}<p>{C}</article><footer>All rights kept, here, there.</footer>", ["Head", A, B, C]),
    "divs": (f"<div id=top><a href=1>One</a> <a href=2>Two</a></div><div class=content><p>{A}</p><p>{B}</p><p>{C}</p></div><div id=foot>Imprint</div>", [A, B, C]),
    "sections": (f"<div><div><h2>One</h2><div><p>{A}</p></div></div><div><h2>Two</h2><div><p>{B}</p></div></div></div>", ["One", A, "Two", B]),
    "body only": (f"<body>{A}<br>{B}<p>{C}", [f"{A} {B}", C]),
    "not closed": (f"<article><div><p><b>{A}<br><p>{B}<ul><li>x<li>y</ul><table><tr><td>1<td>2<tr><td>3</table>{C}", [A, B, "x", "y", "1", "2", "3", C]),
    "unseen": (f'<head><title>T</title><style>p{{}}</style></head><article><script>var x = "</p><p>no</p>";</script><p>{A}<!-- <p>no</p> --><noscript>no</noscript></p><svg><text>no</text></svg><p>{B}</p></article>', [A, B]),
    "hidden": (f'<article><p>{A}</p><p hidden>no</p><div style="color:red; display: none">no</div><span aria-hidden="true">no</span><p>{B}</p></article>', [A, B]),
    "forms": (f"<article><p>{A}</p><form><label>Mail</label><input><button>Send</button></form><p>{B}</p></article><form><p>{A}</p></form>", [A, B]),
    "noise by name": (
        f'<article class="post tag-ad"><header><h1>Head</h1><p>By me, today</p></header><div class="ad-box">{A}</div><div class="cookieNotice">{B}</div><p class="has-sidebar">{A}</p><aside>{B}</aside>'
        f'<div id="comments"><article class="comment"><p>{A}</p></article></div><p>{B}</p><div class="share-buttons">Tell all</div></article><div class="sidebar">{A}</div>',
        ["Head", A, B],
    ),
    "roles": (f'<div role="main"><p>{A}</p><div role="alert">{B}</div><p>{B}</p></div><div role="complementary"><p>{A}</p></div>', [A, B]),
    "link lists": (f"<main><p>{A}</p><ul><li><a href=1>One thing</a><li><a href=2>Two things</a><li><a href=3>Three</a></ul><p>{B} <a href=4>see</a></p></main>", [A, f"{B} see"]),
    "siblings": (f"<div><section><p>{A}</p><p>{A}</p><p>{B}</p></section><p>{B}</p><p><a>menu</a> <a>item</a> <a>item</a></p></div>", [A, A, B, B]),
    "references": ("<article><p>a&nbsp;b &amp;amp; &lt;i&gt; &#65;&#x42; caf&eacute; &copy &zzz;</p><pre>x\n\n  y</pre></article>", ["a b &amp; <i> AB café © &zzz;", "x y"]),
    "attributes": (f'<article data-x="a>b" class=\'x\'><p title="<p>">{A}</p><a title=it\'s href=x>l</a><p>3 < 4 <5</p></article>', [A, "l", "3 < 4 <5"]),
    "all in a form": (f"<form><div><p>{A}</p><p>{B}</p></div></form>", [A, B]),
    "named like an advert": (f'<div class="ad"><p>{A}</p><p>{B}</p></div>', [A, B]),
    "nothing": ("<nav><a href=1>x</a></nav><script>1</script>", []),
    "upper case": (f"<HTML><BODY><NAV>x</NAV><ARTICLE><P>{A}</P><SCRIPT>no</SCRIPT></ARTICLE></BODY></HTML>", [A]),
    "cut": (f"<article><p>{A}</p><p>{B}</p><p cla", [A, B]),
    "open comment": (f"<article><p>{A}</p><!-- {B}", [A]),
    "inline": ("<article><p>one<b>two</b><span> three</span><em>four</em></p></article>", ["onetwo threefour"]),
}


@pytest.mark.parametrize("name", PAGES)
def test_pages(name):
    source, expected = PAGES[name]
    assert main_text(source) == "\n\n".join(expected)


def made(rng):
    """A page of an article among other parts, and the blocks of the article."""
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randint(2, 9)))
    line = lambda n: " ".join(word() + rng.choice(["", "", "", ","]) for _ in range(n)) + "."
    noise = [
        lambda: "<nav><ul>" + "".join(f"<li><a href='/{word()}'>{line(2)}</a>" for _ in range(6)) + "</ul></nav>",
        lambda: f"<div class='{rng.choice(['ad', 'advert-top', 'cookie-banner', 'newsletter-box', 'comments', 'sidebar-left'])}'><p>{line(30)}</p></div>",
        lambda: f"<aside>{line(20)}</aside><form>{line(9)}<select><option>a<option>b</select></form>",
        lambda: f"<script>if (a < b) document.write('<p>{line(5)}</p>')</script><style>p {{ x: y }}</style><!-- {line(6)} -->",
        lambda: f"<div style='display:none'>{line(12)}</div><section id=comments><p>{line(40)}</p></section>",
    ]
    blocks, article = [], ""
    for i in range(rng.randint(1, 12)):
        text = line(rng.choice([1, 3, 20, 80]))
        blocks.append(text)
        dressed = text.replace(" ", rng.choice([" ", "\n  ", "&nbsp;", "<br>", " <b></b>"]), 3)
        article += rng.choice(["<p>{}</p>", "<p>{}", "<div>{}</div>", "<h2>{}</h2>", "<ul><li>{}</ul>", "<blockquote><p>{}</p></blockquote>", "<section><p>{}</p></section>"]).format(dressed)
        if rng.random() < 0.3:
            article += rng.choice(noise[1:])()
    around = rng.choice(["<article>{}</article>", "<main>{}</main>", "<div role=main><div>{}</div></div>", "<main><article class='post'>{}</article></main>"])
    page = "".join(rng.choice(noise)() for _ in range(rng.randint(0, 3))) + around.format(article) + "".join(rng.choice(noise)() for _ in range(rng.randint(0, 3)))
    return f"<!DOCTYPE html><html><head><title>{line(4)}</title></head><body><header>{line(5)}</header>{page}<footer>{line(30)}</footer>" + rng.choice(["</body></html>", ""]), blocks


def test_made_pages_give_their_articles(spark):
    rng = random.Random(2)
    pages = [made(rng) for _ in range(300)]
    rows = spark.createDataFrame([(i, "u", p, "x", 1) for i, (p, _) in enumerate(pages)], "page_id long, url string, html string, text string, n_chars int")
    out = extract(rows)
    assert out.columns == ["page_id", "url", "html", "text", "n_chars"]
    for r in out.collect():
        assert r.text == "\n\n".join(pages[r.page_id][1]), pages[r.page_id][0]
        assert r.n_chars == len(r.text)


def test_the_pages_of_the_tables(spark):
    """Their article element holds h1 and p only, so a plain cut shows what to find."""
    rows = duckdb.sql("SELECT page_id, html FROM '/root/testdata/sf0.01/pages.parquet'").fetchall()
    plain = {}
    for i, source in rows:
        cut = re.search("<article>(.*?)</article>", source, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub("<br>", " ", b).replace("<b>", "").replace("</b>", "")).split()) for b in re.split("</?(?:p|h1)>", cut)]
        plain[i] = "\n\n".join(b for b in blocks if b)
    out = extract(spark.read.parquet("/root/testdata/sf0.01/pages.parquet")).collect()
    assert {r.page_id: r.text for r in out} == plain and len(out) == len(rows)


def test_defined_results(spark):
    schema = "page_id long, html string"
    long = "<article>" + "<p>word, word and word again.</p>" * 40000 + "</article>"
    deep = "<div>" * 3000 + A
    rows = [(1, None), (2, ""), (3, " \n"), (4, long), (5, f"<p>{A}"), (5, f"<p>{A}"), (None, f"<p>{A}"), (6, deep), (7, "<" * 5000), (8, "<a b='" * 3000), (9, "</p></div>x")]
    out = {}
    for r in extract(spark.createDataFrame(rows, schema)).collect():
        out.setdefault(r.page_id, []).append(r.text)
    assert out[1] == out[2] == out[3] == [""] and out[5] == [A, A] and out[None] == [A] and out[6] == [A]
    assert out[4] == ["\n\n".join(["word, word and word again."] * 40000)]
    assert out[7] == ["<" * 5000] and out[9] == ["x"]
    assert extract(spark.createDataFrame([], schema)).count() == 0
