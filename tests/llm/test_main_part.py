"""Linked lines of a marked main part, and pages that mark none."""

import re

from hypothesis import given, settings
from hypothesis import strategies as st

from brandloom.llm import html_text


def test_linked_lines_of_the_main_part_stay():
    page = "<nav><a>menu</a></nav><article><h1><a href=x>Title</a></h1><p>Body.</p><ul><li><a>One</a><li><a>Two</a><li><a>Three</a><li><a>Four</a></ul><p>More.</p><p><a>Last</a></p></article><p>outside</p>"
    assert html_text.main_text(page) == "Title\n\nBody.\n\nOne\n\nTwo\n\nThree\n\nFour\n\nMore.\n\nLast"
    assert html_text.main_text("<article><h1><a>Only</a></h1></article>") == "Only"
    assert html_text.main_text("<main><nav><a>menu</a></nav><p>a</p><aside>b</aside><p><a>c</a></p></main>") == "a\n\nc"


def test_unmarked_pages_go_by_their_blocks():
    links = "".join(f"<li><a>Link {k}</a>" for k in range(6))
    body = ["A first paragraph that is long enough to surge over the threshold of eighty characters at once.", "Short.", "A last paragraph."]
    page = f"<body><ul>{links}</ul><div>{''.join(f'<p>{b}</p>' for b in body)}</div><ul>{links}</ul></body>"
    assert html_text.main_text(page) == "\n\n".join(body)
    assert html_text.main_text("<p>tiny</p>") == "tiny"
    teasers = "<article><a>Other page</a></article>"
    assert html_text.main_text(f"<div><p>{body[0]}</p></div>{'<hr>' * 3}{teasers * 3}") == body[0]


LONG = "A long paragraph of the article that goes on and on, until it has far more than the eighty characters of a surge. "


def lines_of(page):
    return html_text.main_text(page).split("\n\n")


def test_nothing_of_the_article_is_lost():
    assert lines_of(f"<article><h1><a href=x>The Headline</a></h1><p>{LONG}</p><p><a href=x>Read on</a></p></article>") == ["The Headline", LONG.strip(), "Read on"]
    items = "".join(f"<li><a href=x>Source {i}</a></li>" for i in range(4))
    assert lines_of(f"<article><p>{LONG}</p><ul>{items}</ul></article>")[1:] == [f"Source {i}" for i in range(4)]
    for mark in ('div class="social-history"', 'p class="search-theory"', 'section class="subscription-economy"', 'div id="adventure-ad-hoc"'):
        assert lines_of(f"<article><{mark}>{LONG}</{mark.split()[0]}></article>") == [LONG.strip()]
    assert lines_of("<article><p>Let <math><mi>x</mi></math> be</p></article>") == ["Let x be"]


def test_hints_count_as_a_whole():
    for mark in ("ad", "ad-1", "site-footer", "cookie-notice", "comment-list", "left sidebar", "top_banner_wrapper"):
        assert lines_of(f"<article><p>{LONG}</p><div class='{mark}'>Not this</div></article>") == [LONG.strip()]
    for mark in ("has-sidebar", "no-ads", "search-results", "adverb", "commentary", "with-footer"):
        assert "This too" in lines_of(f"<article><p>{LONG}</p><div class='{mark}'>This too</div></article>")


def test_windows_decide_on_unmarked_pages():
    menu = "<div>Home</div><div>About us</div>"
    foot = "<div>Imprint</div><div>Contact</div><div>Terms</div>"
    for body in (f"<div>{LONG}</div><div>Short.</div><div>{LONG}</div>", f"<h1>Head</h1><p>{LONG}</p><p>Thanks.</p><p><a href=x>More</a></p>"):
        want = [x for x in re.sub("<[^>]*>", "\n", body).split("\n") if x.strip()]
        assert lines_of(f"<body>{menu}{body}{foot}</body>") == [x.strip() for x in want]
    related = "<h3>Related</h3><ul><li><a href=x>One of these</a></li><li><a href=x>Two of these</a></li></ul>"
    assert lines_of(f"<div>{LONG}</div>{related}") == [LONG.strip()]
    assert lines_of("<div>Only this</div>") == ["Only this"]


def brute_between(weights, surge, begins=None):
    """Line by line, by the text of the module."""
    begins = begins or weights
    sums = [sum(weights[i : i + html_text.BLOCK]) for i in range(len(weights))]
    inside, found = False, []
    for i, s in enumerate(sums):
        if not inside:
            inside = sum(begins[i : i + html_text.BLOCK]) >= surge and begins[i] >= surge / 4
        elif s < surge / 2:
            inside = False
        found.append(inside)
    return [i for i, x in enumerate(found) if x]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([0, 0, 3, 9, 30, 90, 400]), max_size=30), st.integers(1, 80))
def test_windows_against_brute_force(weights, surge):
    assert [i for first, end in html_text.between(weights, surge) for i in range(first, end)] == brute_between(weights, surge)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["div", "p", "h2", "li"]), st.integers(1, 30), st.booleans()), min_size=1, max_size=15))
def test_pages_against_brute_force(blocks):
    """Pages of blocks without marks; each block is linked or not."""
    texts = [f"w{i}" + " word" * n for i, (_, n, _) in enumerate(blocks)]
    page = "".join(f"<{tag}>{'<a href=x>' * link}{text}{'</a>' * link}</{tag}>" for (tag, _, link), text in zip(blocks, texts, strict=True))
    plain = [0 if link else len(t) for (_, _, link), t in zip(blocks, texts, strict=True)]
    if not any(plain):
        assert html_text.main_text(page) == ""
        return
    surge = max(1, min(80, max(sum(plain[i : i + 3]) for i in range(len(plain))) // 2))
    begins = [n + surge * (tag in ("p", "h2")) for n, (tag, _, _) in zip(plain, blocks, strict=True)]
    kept = brute_between([w + (surge + 1) // 2 * (tag == "li" and n > 0) for w, n, (tag, _, _) in zip(begins, plain, blocks, strict=True)], surge, begins)
    stretches, want = [], []
    for i in kept:
        if stretches and stretches[-1][-1] == i - 1:
            stretches[-1].append(i)
        else:
            stretches.append([i])
    for stretch in stretches:
        while stretch and blocks[stretch[-1]][0] == "h2":
            stretch.pop()
        if sum(plain[i] for i in stretch) >= surge:
            want += [texts[i] for i in stretch]
    assert html_text.main_text(page) == "\n\n".join(want)


def test_ids_of_headings_and_sections_of_the_article_are_no_hints():
    page = f'<article><h2 id="search">Search</h2><p>{LONG}</p><section id="related"><h3>Related work</h3><p>{LONG}</p></section></article><div id="related">Others</div>'
    assert lines_of(page) == ["Search", LONG.strip(), "Related work", LONG.strip()]
    assert lines_of(f'<h2 id="search">Search</h2><p>{LONG}</p><div id="search">Not this</div>') == ["Search", LONG.strip()]


def test_a_list_goes_on_with_a_text():
    items = [f"Item {k}" for k in range(8)]
    assert lines_of(f"<div>{LONG}</div><ul>{''.join(f'<li>{i}' for i in items)}</ul><div>Imprint</div>")[1:9] == items
    assert lines_of(f"<ul>{''.join(f'<li>{i}' for i in items)}</ul>{'<hr><div>x</div>' * 3}<div>{LONG}</div>")[-1] == LONG.strip()


def test_the_windows_decide_on_marked_pages_too():
    far = "<div>Teaser</div>" * 4
    assert lines_of(f"<div>Short note</div><article><p>a</p></article>{far}") == ["a"]
    assert lines_of(f"<article><p>{LONG}</p></article>{far}<div>{LONG * 12}</div>") == [LONG.strip(), (LONG * 12).strip()]
