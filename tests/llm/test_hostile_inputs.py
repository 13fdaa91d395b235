"""Broken markup and long texts end in linear time; article text and ordinary prose stay."""

import time

import pytest

from quaero.llm import html_extraction, secret_scans

LONG = "This is a sentence, with commas, of some length, and it goes on for a while. " * 6


@pytest.mark.parametrize(
    "page",
    [
        '<a "' * 25_000,
        "<a " + '"' * 41,
        '<a ="' * 25_000,
        "<a ='" * 20_000 + '"' + ">",
        '<a x="1' + "<p y='2" * 15_000,
        "<!" * 50_000,
        "<!--" * 30_000,
        "<script>" * 15_000,
        "<" * 100_000,
        "<b>" * 30_000 + "</i>" * 25_000,
        "<b>" * 30_000 + "<p>" * 30_000,
        "<p>" + "<b>" * 20_000 + "<button>" * 10_000,
        "<svg/>" * 20_000,
        "<div><p>a</div>" * 8_000,
        "</" * 50_000 + "a" * 50_000,
        "<a " + "x =" * 30_000 + ">",
        "<a class='" + "side-" * 20_000 + "x'>",
    ],
)
def test_broken_markup_ends(page):
    start = time.perf_counter()
    html_extraction.main_text(page)
    html_extraction.main_text(f"<article><p>{LONG}</p>{page}")
    assert time.perf_counter() - start < 5


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f"<body><div class=a><p>{LONG}</p></div><div class=b><p>Short end.</p></div>", f"{LONG}Short end."),
        (f"<article><p>{LONG}Press <button>Go</button> now</p></article>", f"{LONG}Press Go now"),
        (f"<article><p>{LONG}<label>Kept word</label> here</p></article>", f"{LONG}Kept word here"),
        (f"<article><p>{LONG}</p><form><p>no <label>no</label></p></form><button>no</button></article>", LONG),
        (f"<article><p>{LONG}</p><ol class='commentlist'><li><p>{LONG}</p></li></ol></article>", LONG),
        (f"<article><p>{LONG}</p><div class='user-comments'><p>{LONG}</p></div></article>", LONG),
        (f"<article><p>{LONG}</p><section id='comments'><p>{LONG}</p></section></article>", LONG),
        (f"<article><h2 id='comments'>Comments of the court</h2><p>{LONG}</p></article>", f"Comments of the court {LONG}"),
        (f"<div id='comments-enabled'><p>{LONG}</p></div>", LONG),
        (f"<article><p>{LONG}</p><svg/><p>after</p></article>", f"{LONG}after"),
        (f"<article><a title='a > b'>x</a><p>{LONG}</p></article>", f"x {LONG}"),
        (f"<article><p>{LONG}</p><p title=\"open>tail</p></article>", f"{LONG}tail"),
    ],
)
def test_article_text_stays(page, text):
    assert html_extraction.main_text(page) == " ".join(text.split())


def test_many_credential_lines_end():
    text = "\n".join(f"db_password_{k}: Xk{k}#vQ9!z{k * 7919 % 1000}wPq" for k in range(10_000))
    start = time.perf_counter()
    spans = secret_scans.find_spans(text)
    assert time.perf_counter() - start < 10 and len(spans) >= 9_000
    one = secret_scans.find_spans(text.split("\n")[5_000])
    assert len(one) == 1


def test_words_of_a_value_alone_are_no_words_of_its_text():
    value = "zqvxkjwhpt"
    assert secret_scans.find_spans(f"the pass phrase; pwd: {value} and pwd: {value}")
    assert not secret_scans.find_spans(f"pwd: {value} while {value}s, said {value}-like folk")
    assert secret_scans.find_spans(f"pwd: {value}7#K!x then")
