import hashlib
import time

import pytest
from pyspark.sql import functions as F

from fiscalspark.llm import html_text, preference as P, scratch, warc
from tests.llm import cases

BODY = "<p>One two three, four five, six seven &amp; eight.</p>"


def pages(spark):
    big = "<html>" + "x" * 200 + "</html>"
    rows = [(5, "http://a/", big), (3, "http://b/ \r\nX: y", big), (3, "http://b2/", big), (9, None, big), (None, "http://n/", big),
            (1, "http://c/", None), (2, "http://d/é?q=1&r=%20", ""), (7, "http://e/", "short"), (8, "http://f/", "short"),
            (10, "http://g/", "é\r\n\r\nWARC/1.1\r\n" * 50_000)]
    return cases.with_clashes(spark.createDataFrame(rows, "page_id bigint, url string, html string"))


def test_archives_give_back_every_record(spark):
    table = pages(spark)
    index = warc.write(table, scratch.new_folder(spark, "test-warc"), frame_bytes=1000)
    got = sorted(((r["record_id"], r["record_type"], r["refers_to"], bytes(r["payload"]) if r["payload"] is not None else None,
                   r["stated_bytes"], r["stated_digest"]) for r in warc.read(spark, index).collect()), key=repr)
    expected = []
    for r in table.collect():
        payload = (r["html"] or "").encode()
        revisit = len(payload) == 213 and r["page_id"] != 3
        expected.append((None if r["page_id"] is None else str(r["page_id"]), "revisit" if revisit else "response", "3" if revisit else None,
                         None if revisit else payload, len(payload), hashlib.sha256(payload).hexdigest()))
    assert got == sorted(expected, key=repr)
    place = index.where("record_id = '10'").first()
    one = warc.fetch(place["path"], place["frame"], place["offset"])
    assert one["record_id"] == "10" and len(one["payload"]) == 50_000 * len("é\r\n\r\nWARC/1.1\r\n".encode())
    empty = warc.write(table.where("false"), scratch.new_folder(spark, "test-warc"))
    assert warc.read(spark, empty).collect() == []


PROSE = "<p>Prose of an article, long enough to be told apart from a menu, with commas, and with so many words in it.</p>"


@pytest.mark.parametrize("inner,kept", [
    ("<h2 id=related-work>Related work</h2>", "Related work"), ("<section id=discussion><p>We discuss.</p></section>", "We discuss."),
    ("<h1 class=header>Head</h1>", "Head"), ("<p class=share>Share of votes</p>", "Share of votes"), ("<p class=skip>Skip</p>", "Skip"),
    ("<p class=reply>They replied</p>", "They replied"), ("<blockquote class=promotion>Quote</blockquote>", "Quote"),
    ("<h2>References</h2><ul><li><a href=x>One</a></li><li><a href=y>Two</a></li></ul>", "References One Two"),
    ("<table><tr><td><a href=z>cell</a></td></tr></table>", "cell"), (f"<div class=notice>{PROSE * 9}</div>", None),
    ("<div class=ad>buy</div>", ""), ("<div class=share><a href=q>post it</a></div>", ""), ("<div class=comments><p>no, no</p></div>", ""),
    ("<div class=cookie-notice><p>we use cookies</p></div>", ""), ("<div class=related><a href=a>a</a> <a href=b>b</a></div>", ""),
])
@pytest.mark.parametrize("around", ["<article>{}</article>", "<div class=menu>m</div><div id=content>{}</div><div class=footer>f</div>"])
def test_names_inside_an_article_are_hints_only(around, inner, kept):
    prose = PROSE[3:-4]
    if kept is None:
        kept = " ".join([prose] * 9) if "article" in around else ""
    expected = " ".join(filter(None, [prose, prose, kept, prose]))
    assert html_text.main_text(around.format(PROSE * 2 + inner + PROSE)) == expected


@pytest.mark.parametrize("html", ["<a " * 60_000, "<b>" * 40_000 + "x", "<b>x" * 30_000, '<a "' * 30_000 + ">x", "<p class='x" * 20_000,
                                  "<div><p>a, b" * 20_000, "<!--" * 30_000 + "x", "</i>" * 50_000 + "<i>x"])
def test_long_broken_pages_take_linear_time(html):
    started = time.perf_counter()
    html_text.main_text(html)
    assert time.perf_counter() - started < 8


@pytest.mark.parametrize("html,text", [
    (None, ""), ("", ""), ("<p></p>", ""), ("plain, text", "plain, text"),
    (f"<nav><a href=x>menu</a></nav><article><h1>T &eacute;</h1>{BODY}</article><footer>f</footer>", "T é One two three, four five, six seven & eight."),
    (f"<header><h1>Site</h1></header><div id=content>{BODY}<p>more<br>lines</p></div><aside>s</aside>",
     "One two three, four five, six seven & eight. more lines"),
    (f"<article>{BODY}<script>var a='</p>';</script><style>p{{}}</style><!-- <p>no</p> --><form><p>send</p></form>"
     f"<div class='ad'>buy, now</div><p>a<b>b</b>c</p></article><div id='comments'>{BODY * 9}</div>",
     "One two three, four five, six seven & eight. abc"),
    (f"<div class='content with-sidebar'><section>{BODY}</section><section>{BODY}</section></div><div class=cookie-notice>{BODY}</div>",
     "One two three, four five, six seven & eight. One two three, four five, six seven & eight."),
    (f"<div class='page sidebar-open'><article><div class=post-header><h1>T</h1></div>{BODY}<div class=article-ad>{BODY}</div>"
     f"</article><section class='post-comments'>{BODY * 3}</section><div id=pageFooter>{BODY}</div></div>",
     "T One two three, four five, six seven & eight."),
    ("<article><p><b>bold<br><p>next\n\n  one</article>", "bold next one"),
    ("<ul><li>a, b<li>c</ul>", "a, b c"), ("<div>" * 3000 + "deep, text" + "</div>" * 3000, "deep, text"),
    ("<article><p>x < y &lt;z&gt; a&nbsp;b</p></article>", "x < y <z> a b"),
])
def test_main_text(html, text):
    assert html_text.main_text(html) == text


def test_extract_keeps_every_row(spark):
    got = html_text.extract(pages(spark))
    assert got.columns == ["page_id", "url", "text", "n_chars"] and got.count() == 10
    assert got.where("n_chars <> length(text) or text is null").count() == 0
    assert html_text.extract(pages(spark).where("false")).collect() == []


def turns(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "yo"), (1, 2, "user", "more"), (1, 3, "assistant", "sure"),
            (2, 0, "user", "hi"), (2, 1, "assistant", "yo"), (2, 2, "user", "else"), (3, 0, "user", None), (3, 1, None, "é\U0001f600"),
            (4, None, "assistant", "first"), (4, 0, "user", "hi"), (4, 0, "user", "hi"), (None, 0, "user", "lost")]
    return cases.with_clashes(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"))


def by_hand(chosen, rejected):
    n = 0
    while n < min(len(chosen), len(rejected)) and chosen[n] == rejected[n]:
        n += 1

    def shown(part):
        text, spans = "", []
        for role, body in part:
            piece = f"<|im_start|>{role}\n{body}<|im_end|>\n"
            if role == "assistant":
                spans.append((len(text) + len(f"<|im_start|>{role}\n"), len(text) + len(piece) - 1))
            text += piece
        return text, spans

    (a, a_spans), (b, b_spans) = shown(chosen[n:]), shown(rejected[n:])
    return n, shown(chosen[:n])[0], a, b, a_spans, b_spans


def test_pairs_are_formatted_as_by_hand(spark):
    convs = P.conversations(turns(spark))
    pairs = P.pair_by_opening(convs).unionByName(P.pair_with_echo(convs)).withColumn("prompt", F.lit("clash"))
    inputs = {(r["chosen_id"], r["rejected_id"]): ([tuple(t) for t in r["chosen_turns"]], [tuple(t) for t in r["rejected_turns"]])
              for r in pairs.collect()}
    assert (1, 2) in inputs and (None, None) in inputs and len(inputs) == 6
    assert inputs[(1, 1)][1] == [("user", "hi"), ("assistant", "yo"), ("user", "more"), ("assistant", "more")]
    for r in P.format_pairs(pairs).collect():
        got = (r["n_common"], r["prompt"], r["chosen"], r["rejected"], [tuple(s) for s in r["chosen_spans"]], [tuple(s) for s in r["rejected_spans"]])
        assert got == by_hand(*inputs[(r["chosen_id"], r["rejected_id"])])


def test_no_conversations_no_pairs(spark):
    convs = P.conversations(turns(spark).where("false"))
    assert P.format_pairs(P.pair_by_opening(convs).unionByName(P.pair_with_echo(convs))).collect() == []
