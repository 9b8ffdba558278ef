"""Pages whose markup names the article as something else, and the first pass from its rules."""

import random
import re

import pytest
from voltlake.llm.html import STOP_WORDS, _is_long, blocks_of, first_pass, main_text

ONE = "This is the first long paragraph of an article that has many of the words which one would find in any text of this kind, and it goes on for a while."
TWO = ONE.replace("first", "second")
TEXT, KEPT = f"<p>{ONE}</p><p>{TWO}</p>", f"{ONE}\n\n{TWO}"
OTHER = ONE.replace("first", "unwanted")


@pytest.mark.parametrize(
    "page, text",
    [
        (f'<body><form id="aspnetForm"><nav>menu</nav><div>{TEXT}</div><div class="comments"><p>{OTHER}</p></div></form></body>', KEPT),
        (f'<div class="ad-free content">{TEXT}</div><div class="sidebar"><p>{OTHER}</p></div>', KEPT),
        (f'<section class="social-science">{TEXT}</section><div class="social">share it</div>', KEPT),
        (f'<div id="alert-system">{TEXT}</div>', KEPT),
        (f'<div class="search-results-page related">{TEXT}</div>', KEPT),
        (f'<div class="menu-page"><div class="widget-area"><form>{TEXT}</form></div></div>', KEPT),
        (f'<article>{TEXT}</article><article class="related"><p>{OTHER}</p></article>', KEPT),
        (f'<article class="related">{TEXT}</article>', KEPT),
        (f'<article><div class="article-header"><h1>The headline</h1></div>{TEXT}</article>', f"The headline\n\n{KEPT}"),
        # What stays boilerplate, however long it is.
        (f'<p>Short note.</p><div class="user-comments"><p>{OTHER}</p><p>{OTHER}</p></div>', ""),
        (f'<div>{TEXT}</div><form><p>{OTHER}</p></form>', KEPT),
        (f'<div>{TEXT}</div><aside><p>{OTHER}</p></aside><footer><p>{OTHER}</p><p>{OTHER}</p></footer>', KEPT),
        (f'<div>{TEXT}</div><div class="related"><p>{OTHER}</p><p>{OTHER}</p><p>{OTHER}</p></div>', KEPT),
    ],
)
def test_articles_under_other_names(page, text):
    assert main_text(page) == text


def test_other_languages():
    one, two = "kissa istuu puussa ja katselee maailmaa " * 6, "toinen kappale jatkuu hyvin pitk\u00e4\u00e4n " * 6
    page = f'<div class="nav">etusivu</div><p>{one}</p><p>{two}</p><footer>yhteys</footer>'
    assert main_text(page) == f"{one.strip()}\n\n{two.strip()}"
    chinese = "\u8fd9\u662f\u4e00\u7bc7\u5f88\u957f\u7684\u6587\u7ae0" * 15
    assert main_text(f'<ul class="menu"><li>\u9996\u9875</li></ul><p>{chinese}</p>') == chinese
    # Beside text with stop words, a long block without any is none.
    assert main_text(f"<p>{ONE}</p><p>{TWO}</p><hr><p>{'lorem ipsum dolor amet ' * 12}</p>") == KEPT


def test_many_wrappers_end():
    page = '<div class="ad-box">' * 300 + TEXT
    assert main_text(page) == "" and main_text('<div class="ad-box">' * 30 + TEXT) == KEPT


def plain_first_pass(text, links, noise, region, item, has_region, has_stop):
    if noise or (has_region and not region):
        return False
    if links > 0.5:
        return None if region and not item else False
    words = re.findall(r"\w+", text.lower())
    stop = len([w for w in words if w in STOP_WORDS]) / (len(words) or 1)
    if not has_stop:
        return True if _is_long(text) else None
    if len(words) < 20:
        return True if region and len(words) >= 10 and stop >= 0.25 else None
    if region or stop >= 0.25:
        return True
    return None if stop >= 0.1 else False


def test_first_pass_by_its_rules():
    r = random.Random(1)
    for _ in range(3000):
        text = " ".join(r.choice(("the", "of", "and", "cat", "zebra", "maailma", "x1")) for _ in range(r.randrange(40)))
        links, flags = r.choice((0.0, 0.3, 0.5, 0.51, 1.0)), [r.random() < 0.5 for _ in range(5)]
        assert first_pass(text, links, *flags[:4], has_stop=flags[4]) == plain_first_pass(text, links, *flags)


def test_blocks_have_five_parts():
    assert blocks_of("<p>a</p><nav>b</nav>") == [("a", 0.0, False, False, False), ("b", 0.0, True, False, False)]
