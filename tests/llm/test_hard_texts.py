"""Odd and long texts: what must not crash, and must not take time beyond the length of a text."""

import random
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.llm import repeats, tokens
from tessera.llm.decontaminate import contamination
from tessera.llm.pages import extract_pages, main_text
from tessera.llm.personal import replace_personal
from tessera.llm.repeats import remove_repeats, repeats_digest

PROSE = "This is the one that was said to be in the long form of all of these texts, as it is."


def quick(seconds, f):
    began = time.time()
    out = f()
    assert time.time() - began < seconds
    return out


ODD_PAGES = {
    "marked section": (f"<p>{PROSE}<![foo[y]]></p>", [PROSE]),
    "character data": (f"<p>{PROSE}<![CDATA[y]]></p>", [PROSE]),
    "conditional": (f"<!--[if IE]><p>old {PROSE}</p><![endif]--><![if !IE]><p>{PROSE}</p><![endif]>", [PROSE]),
    "declarations": (f"<!DOCTYPE html><!ELEMENT a><?xml version='1'?><p>{PROSE}</p></>", [PROSE]),
    "open comment": (f"<p>{PROSE}</p><!-- all <p>the rest {PROSE}</p>", [PROSE]),
    "short comments": (f"<!--><p>{PROSE}</p><!---><!--x--!>", [PROSE]),
    "open script": (f"<p>{PROSE}</p><script>var a = '<p>{PROSE}</p>'", [PROSE]),
    "script with tags": (f"<script>a = '</p><p>{PROSE}'</script><p>{PROSE}</p>", [PROSE]),
    "open tag": (f"<p>{PROSE}</p><p class='x", [PROSE]),
    "stray signs": (f"<p>{PROSE} 1 < 2 & 3 > 2 <3</p>", [f"{PROSE} 1 < 2 & 3 > 2 <3"]),
    "stray quotes": (f"<p class=a\">{PROSE}</p><p id='b>{PROSE}</p>", [PROSE, PROSE]),
    "quoted sign": (f"<div title='a > b'><p>{PROSE}</p></div>", [PROSE]),
    "references": (f"<p>{PROSE} &eacute;&#233;&#xE9;&#{'9' * 9000};&nope;</p>", [f"{PROSE} ééé�&nope;"]),
    "unmatched ends": (f"</div></nav><p>{PROSE}</b></nav></p>", [PROSE]),
    "closed at once": (f"<nav/><div class=ad /><p>{PROSE}</p><a href=/x/>{PROSE[:20]}</a>", [PROSE]),
    "upper case": (f"<NAV><P>{PROSE}</P></NAV><P>{PROSE}</P><SCRIPT>x</SCRIPT>", [PROSE]),
    "surrogates": (f"<p>{PROSE} \x00 &#0; &#55296;</p>", [f"{PROSE} \x00 � �"]),
    "none": ("", []),
}


@pytest.mark.parametrize("name", ODD_PAGES)
def test_odd_pages(name):
    html, want = ODD_PAGES[name]
    assert main_text(html) == want


def test_pages_of_random_tokens_have_blocks_of_their_text():
    parts = ["<", ">", "</", "<!", "<!--", "-->", "<![", "]]>", "<p>", "</p>", "<div", "'", '"', "=", " ", "a", "&", "&#", ";", "<script>", "</script>", "<article>", "<?", "/", PROSE]
    r = random.Random(3)
    for _ in range(3000):
        for text in main_text("".join(r.choice(parts) for _ in range(r.randrange(40)))):
            assert text == " ".join(text.split()) != ""


HARD_PAGES = {
    "cells": "<table>" + "<tr><td>ab<td>cd" * 50_000 + "</table>",
    "nested": "<div>x" * 100_000,
    "unmatched": "<div>" * 30_000 + "</span></section>x" * 30_000,
    "comments": "<!--" * 200_000,
    "tags": "<a <a b=\"" * 100_000,
    "signs": "<" * 1_000_000,
    "attributes": "<p " + "a=b " * 200_000 + ">x",
    "ambiguous": "<article>" + "<p>ab</p>" * 100_000 + f"<p>{PROSE}</p></article>",
}


@pytest.mark.parametrize("name", HARD_PAGES)
def test_long_pages_in_linear_time(name):
    got = quick(15, lambda: main_text(HARD_PAGES[name]))
    assert len(got) == (100_001 if name == "ambiguous" else name == "signs")


def test_pages_table_with_odd_rows(spark):
    df = spark.createDataFrame([(1, "u", HARD_PAGES["cells"]), (1, "u", ODD_PAGES["marked section"][0]), (None, None, None), (2, "u", "")], "page_id long, url string, html string")
    assert sorted(len(r.blocks) for r in extract_pages(df).collect()) == [0, 0, 0, 1]
    assert extract_pages(df.filter("false")).collect() == []


HARD_PERSONAL = {
    "letters": "a" * 1_000_000,
    "digits": "1" * 1_000_000,
    "hex": "0a" * 500_000,
    "spaced digits": "1 " * 300_000,
    "labels": "x@" + "a." * 20_000,
    "dotted": "a." * 500_000,
    "addresses": "a@b." * 200_000,
    "capitals": "Mr Aa " + "Bb " * 20_000,
    "hyphens": "-" * 1_000_000,
    "plus": "+1" * 300_000,
}


@pytest.mark.parametrize("name", HARD_PERSONAL)
def test_personal_data_in_long_texts(spark, name):
    df = spark.createDataFrame([(1, HARD_PERSONAL[name] + " Mail to jo@x.com now")], "doc_id long, text string")
    got = quick(30, lambda: replace_personal(df).first())
    assert "jo@x.com" not in got.text and got.text.endswith(" now")
    assert ("email", "jo@x.com") in {(e.kind, e.found) for e in got.entities}
    if name not in ("spaced digits", "capitals"):
        assert len(got.entities) == 1 and got.text.startswith(HARD_PERSONAL[name])


def test_long_address_is_found_whole(spark):
    at = "x@" + "sub." * 20 + "example.com"
    df = spark.createDataFrame([(1, f"to {at}, or {'a' * 64}@b.org")], "doc_id long, text string")
    assert [e.found for e in replace_personal(df).first().entities] == [at, "a" * 64 + "@b.org"]


def test_names_are_followed_through_a_text(spark):
    docs = [
        (1, "Mrs Anna Smith came. Later Smith left and Anna stayed; SMITH, Smithy and anna are others. A letter from Anna Smith."),
        (2, "Smith and Anna without a title stay."), (None, "Sir Tom Smith met Tom."), (None, "Tom Smith"),
    ]
    got = {r.text.split()[-1] if r.doc_id is None else r.doc_id: r for r in replace_personal(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    one = got[1]
    surname, given = one.entities[0].surrogate.split()[2], one.entities[0].surrogate.split()[1]
    assert one.text == f"Mrs {given} {surname} came. Later {surname} left and {given} stayed; SMITH, Smithy and anna are others. A letter from {given} {surname}."
    assert [e.kind for e in one.entities] == ["name"] * 5 and given.endswith("a")
    assert got[2].text == docs[1][1] and got[2].entities == []
    assert got["Smith"].text == "Tom Smith"
    (knight,) = (r for k, r in got.items() if k not in (1, 2, "Smith"))
    assert knight.entities[0].surrogate.split()[2] == surname and knight.text.split()[-1] == knight.entities[0].surrogate.split()[1] + "."


def test_hint_covers_all_kinds(spark):
    texts = ["a@b.co", "DE44500105175407324931", "10.0.0.1", "123-45-6789", "4111 1111 1111 1111", "+4917012345678", "Frau Meier", "Κυρία Βασιλική"]
    got = replace_personal(spark.createDataFrame(enumerate(texts), "doc_id long, text string")).orderBy("doc_id").select(F.element_at("entities", 1)["kind"]).collect()
    assert [r[0] for r in got] == ["email", "iban", "ip", "ssn", "card", "phone", "name", "name"]


def test_repeats_in_a_group_of_many_different_contexts(spark):
    """A passage in 30,000 texts; a few texts share what stands on both sides of it as well."""
    r = random.Random(5)

    def letters(n):
        return "".join(r.choices("abcdefghij ", k=n))

    passage, left, right = letters(280), [letters(80) for _ in range(170)], [letters(80) for _ in range(170)]
    texts = [letters(20) + left[i % 170] + passage + right[(i // 170) % 170] + letters(20) for i in range(30_000)]
    seen = Counter(hash(t[a : a + 400]) for t in texts for a in range(len(t) - 399))
    want = {}
    for i, t in enumerate(texts):
        hit = [a for a in range(len(t) - 399) if seen[hash(t[a : a + 400])] > 1]
        want[i] = hit[-1] + 400 - hit[0] if hit else 0
        assert not hit or hit[-1] - hit[0] < 400
    assert 2000 < sum(n > 0 for n in want.values()) < 3000
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    hot = repeats.runs(docs.withColumn("row", F.lit(0).cast("long")), 400).groupBy("key").agg(F.count_distinct("c1", "c2").alias("n")).agg(F.max("n")).first()[0]
    assert hot > 16384 > repeats.GROUP
    assert {x.doc_id: x.n_removed for x in repeats_digest(remove_repeats(docs)).collect()} == want


@pytest.mark.parametrize("block", [64, 1 << 21])
def test_pieces_of_long_texts_find_the_same(spark, monkeypatch, block):
    """Shingles and benchmark windows of long texts in pieces of 64 bytes against whole texts."""
    r = random.Random(6)
    vocabulary = ["a", "bb", "Ünï", "the", "x" * 90, "word", "1", "of"]
    texts = [" ".join(r.choice(vocabulary) for _ in range(n)) for n in (1, 3, 4, 5, 6, 40, 400, 3000)] + ["x" * 500, " " * 500, "", "  lead " + "y" * 300 + "\n", "a b c d " + "z" * 400]
    whole = [tokens.shingle_sets([t.encode()], tokens.NOT_SPACE, 5) for t in texts]
    monkeypatch.setattr(tokens, "BLOCK", block)
    for t, (doc, values) in zip(texts, whole, strict=True):
        got = tokens.shingle_sets([t.encode()], tokens.NOT_SPACE, 5)
        assert got[0].tolist() == doc.tolist() and got[1].tolist() == values.tolist()
        for before, after in ((0, 4), (9, 9)):
            parts = list(tokens.pieces(t.encode(), tokens.NOT_SPACE, before, after))
            ends = [first for _, first, _ in parts[1:]] + [len(t.split())]
            for (at, first, piece), end in zip(parts, ends, strict=False):
                assert piece.split() == t.encode().split()[max(0, first - before) : end + after] and at == max(0, first - before)


def test_long_texts_are_decontaminated_in_pieces(spark):
    r = random.Random(7)
    long = [f"w{r.randrange(50)}" for _ in range(700_000)]  # several blocks
    items = [(1, "rare one two three four five six seven eight nine ten"), (2, "w1"), (3, " ".join(long[600_000:600_012])), (4, "rare w1")]
    long[5:5] = items[0][1].split()
    long[650_000:650_000] = items[0][1].split()
    long += ["rare", "w1"]
    docs = spark.createDataFrame([(1, " ".join(long)), (2, "w1 x W1")], "doc_id long, text string")
    got = {x.doc_id: x for x in contamination(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = {}
    for _, t in items:
        w = t.split()
        for k in range(max(1, len(w) - 9)):
            want.setdefault(tuple(w[k : k + 10]), None)
    hit = set()
    joined = " " + " ".join(long) + " "
    places = {m: k for k, m in enumerate(re_starts(joined))}
    for win in want:
        at = joined.find(" " + " ".join(win) + " ")
        while at >= 0:
            hit |= set(range(places[at + 1], places[at + 1] + len(win)))
            at = joined.find(" " + " ".join(win) + " ", at + 1)
    assert (got[1].n_words, got[1].n_hit, got[1].item_ids) == (len(long), len(hit), ["1", "2", "3", "4"])
    assert (got[2].n_words, got[2].n_hit, got[2].item_ids) == (3, 2, ["2"])


def re_starts(joined):
    return [k + 1 for k, c in enumerate(joined[:-1]) if c == " "]


PARAGRAPHS = ["The quick fox was in the house and it had been there for a long time with all of its friends and they were happy.", "It is not the case that this was easy for them but they did it in the end and that is what we have to say."]
OTHER = "Read more of what is in the shop and see all of the offers that we have for you on this day and on the next one."
ARTICLE = "".join(f"<p>{p}</p>" for p in PARAGRAPHS)
#: Pages as site builders make them, with what is main text marked by hand: the prose, and where it says so a title.
TEMPLATES = {
    "layout that has a sidebar": (f'<div class="layout has-sidebar"><div id="content">{ARTICLE}</div><div class="sidebar"><p>{OTHER}</p></div></div>', False),
    "site without a sidebar": (f'<div class="site no-sidebar"><article>{ARTICLE}</article></div>', False),
    "page with comments": (f'<div class="single with-comments"><article>{ARTICLE}</article><div class="comments"><p>{OTHER}</p></div></div>', False),
    "side by side": (f'<article><div class="side-by-side">{ARTICLE}</div></article>', False),
    "form around main": (f'<form id="aspnetForm"><main>{ARTICLE}</main></form>', False),
    "form around content": (f'<form id="form1"><div id="content">{ARTICLE}</div><div class="footer"><p>{OTHER}</p></div></form>', False),
    "title in an entry header": (f'<article><div class="entry-header"><h1>A title</h1></div>{ARTICLE}</article>', True),
    "title in a header": (f"<article><header><h1>A title</h1></header>{ARTICLE}</article>", True),
    "comments in a list": (f'<article>{ARTICLE}</article><ol class="commentlist"><li><p>{OTHER}</p></li></ol>', False),
    "comments in the article": (f'<article>{ARTICLE}<ol class="comment-list"><li><p>{OTHER}</p></li></ol></article>', False),
    "comments as articles": (f'<article>{ARTICLE}</article><section id="comments"><article class="comment"><p>{OTHER}</p></article></section>', False),
    "related articles": (f'<article>{ARTICLE}</article><section class="related-posts"><article><p>{OTHER}</p></article></section>', False),
    "layout with the sidebar's side": (f'<div class="sidebar-right-layout"><main>{ARTICLE}</main><aside><p>{OTHER}</p></aside></div>', False),
    "named wrapper around main": (f'<div class="site-header-overlay"><main>{ARTICLE}</main></div><div class="cookie-notice"><p>{OTHER}</p></div>', False),
    "comment form": (f'<main>{ARTICLE}<form class="comment-form"><p>{OTHER}</p></form></main>', False),
    "newsletter in the article": (f'<article>{ARTICLE}<div class="newsletter-signup"><p>{OTHER}</p></div></article>', False),
    "left side": (f'<div id="left-side"><p>{OTHER}</p></div><div class="post">{ARTICLE}</div>', False),
    "banner by role": (f'<div role="banner"><p>{OTHER}</p></div><div role="main" class="main">{ARTICLE}</div>', False),
    "article in an aside": (f"<main>{ARTICLE}</main><aside><article><p>{OTHER}</p></article></aside>", False),
    "promoted box": (f'<div class="entry">{ARTICLE}<div class="promo-box"><p>{OTHER}</p></div></div>', False),
}


@pytest.mark.parametrize("name", TEMPLATES)
def test_main_text_of_common_templates(name):
    html, titled = TEMPLATES[name]
    assert main_text(f"<html><body><nav><a href=x>{OTHER}</a></nav>{html}</body></html>") == (["A title"] if titled else []) + PARAGRAPHS
