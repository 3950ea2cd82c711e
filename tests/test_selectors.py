"""Selectors of the caller, and element texts by offsets."""

import random
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siteindex.functions.text import strip
from siteindex.operators.views import (
    CLEANED,
    CLEANERS,
    Texts,
    clean_formatting,
    keeping,
    remove_scripts,
    removing,
    text_of,
    with_view,
)
from siteindex.plans.pages import parsed, processed
from siteindex.sources import nodes as N
from siteindex.sources.selectors import WORD, OwnMarks, own_marks, word, words

HTML = (
    '<div id=top class="a b"><p class=b>1</p><section><p class="b c" data-n="x-1">2</p>'
    '<P data-n="y">3</P></section></div><p lang=en-GB>4</p><a href="">5</a><i class="A">6</i>'
)


def chosen(selector):
    """Texts of the elements that a selector names, in document order."""
    own = ("unused", selector, *(f".more{i}" for i in range(130)))
    [array] = N._read_batches(iter([pa.array([HTML])]), 0, own)
    mask = own_marks(own).masks[selector]
    page = array.to_pylist()[0]
    found = []
    for node in page:
        if node["kind"] == "el" and any(node[f"own{n}" if n else "own"] & part for n, part in words(mask)):
            inside = page[node["id"] : node["last"] + 1]
            found.append("".join(n["text"] or "" for n in inside))
    return found


@pytest.mark.parametrize(
    ("selector", "texts"),
    [
        ("p", ["1", "2", "3", "4"]),
        ("*", ["123", "1", "23", "2", "3", "4", "5", "6"]),
        (".b", ["123", "1", "2"]),
        ("p.b", ["1", "2"]),
        (".b.c", ["2"]),
        ("#top", ["123"]),
        ("#top > p", ["1"]),
        ("#top p", ["1", "2", "3"]),
        ("div section > p.b", ["2"]),
        ("div > section p + p".replace(" + p", ""), ["2", "3"]),
        ("[data-n]", ["2", "3"]),
        ("[data-n^=x]", ["2"]),
        ("[data-n$='1'], i", ["2", "6"]),
        ('[data-n*="-"]', ["2"]),
        ("[lang|=en]", ["4"]),
        ("[class~=b]", ["123", "1", "2"]),
        ("a[href]", ["5"]),
        ("a[href^='']", []),
        (".a", ["123"]),
        ("section section p", []),
    ],
)
def test_selectors(selector, texts):
    assert chosen(selector) == texts


@pytest.mark.parametrize("selector", ["", "p >", "> p", "p,", "p:first-child", "p + p", "[x", "..a", "#"])
def test_selectors_that_are_not_read(selector):
    with pytest.raises(ValueError, match="selector not understood"):
        OwnMarks([selector])


def test_marks_of_many_words():
    marks = OwnMarks([f"div .x{i}" for i in range(200)])
    assert marks.words == -(-201 // WORD)
    mask = marks.masks["div .x199"]
    assert [word(mask, n) != 0 for n in range(5)] == [n == 201 // WORD + (201 % WORD > 0) for n in range(5)]
    assert own_marks(("a b", "c")).masks == own_marks(("a b", "c")).masks


def test_own_formats_containers_and_many_selectors(spark):
    html = (
        '<title>The title</title><div class=note>x <u>y</u></div><section id=s><u>z</u> <q>w</q>'
        "<p class=n77>gone</p><script>s</script></section>"
    )
    df = spark.createDataFrame([("https://e.com/", html)], "url string, html string")

    def formats(view):
        return clean_formatting(view, [(["u"], "_"), (["q"], "~")])

    many = removing(*(f"p.n{i}" for i in range(90)))
    done = processed(df, (remove_scripts, many, formats, keeping("#nowhere", "section#s"))).first()
    assert done.main_content == "_z_~w~" and done.title == "Untitled"
    with pytest.raises(ValueError, match="before formatting"):
        processed(df, (clean_formatting, removing(".x")))
    titled = processed(df, (*CLEANERS[:4],), titles=["#none", ".note"]).first()
    assert titled.title == "The title"  # three characters are too few
    longer = processed(df, (*CLEANERS[:4],), titles=["section u, .note, section"]).first()
    assert longer.title == "zw" + "gone"


def test_texts_are_slices(spark):
    rng = random.Random(6)
    pieces = ["é ", " ", "x", "", "\u2003", "<b>ab</b>", "<i>", "</i>", "<p>", "<pre> q</pre>", "日本 ", "<a href=u>", "</p>"]
    rows = [(f"https://e.com/{i}", "".join(rng.choices(pieces, k=rng.randint(1, 400)))) for i in range(60)]
    df = spark.createDataFrame(rows, "url string, html string")
    read = with_view(parsed(df), CLEANED)
    texts = Texts(F.col("texts"))
    plain = lambda e: text_of(F.col("tokens"), e)
    each = F.transform(
        "elements",
        lambda e: F.struct(
            plain(e).alias("t"), strip(plain(e)).alias("s"), texts.of(e).alias("of"),
            texts.length(e).alias("n"), texts.stripped_length(e).alias("m"), texts.shows(e).alias("shows"),
        ),
    )
    seen = [e for r in read.select(each.alias("e")).collect() for e in r.e]
    assert len(seen) > 1000
    for e in seen:
        assert (e.of, e.n, e.m, e.shows) == (e.t, len(e.t), len(e.s), e.s != "")


@pytest.mark.parametrize("tag", ['a href="/x"', "h2", "code", "p"])
def test_thousands_of_elements_that_are_never_closed(spark, tag):
    html = "<title>A long title</title>" + f"<{tag}>" * 30_000 + "some text of its own"
    df = spark.createDataFrame([("https://e.com/", html)], "url string, html string")
    began = time.monotonic()
    done = processed(df).first()
    found = {"a": done.links, "h": done.headings, "c": done.code_blocks}.get(tag[0], [])
    assert done.title == "A long title" and len(found) == (0 if tag == "p" else 30_000)
    assert time.monotonic() - began < 60
