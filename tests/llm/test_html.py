"""Main text: surge and dive points against brute force, and pages that leave out or misuse markup."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from topolith.llm import html

LINES = [f"Sentence {k} of the text goes on with enough plain words to count as content of the page." for k in range(20)]
BODY, TEXT = "".join(f"<p>{x}</p>" for x in LINES), "\n\n".join(LINES)


def _brute(sizes, window, surge):
    out, begin = [], None
    for k in range(len(sizes) + 1):
        ahead = sum(sizes[k : k + window])
        if begin is None and k < len(sizes) and sizes[k] and ahead >= surge:
            begin = k
        elif begin is not None and not ahead:
            out.append((begin, k))
            begin = None
    return out


@given(st.lists(st.sampled_from([0, 0, 0, 1, 20, 50, 90]), max_size=30), st.integers(1, 5), st.sampled_from([1, 40, 80]))
@settings(max_examples=400, deadline=None)
def test_stretches_equal_brute_force(sizes, window, surge):
    assert html.stretches(sizes, window, surge) == _brute(sizes, window, surge)


@pytest.mark.parametrize(
    "page,text",
    [
        (f"<html><head><title>T</title><meta charset=x><body>{BODY}", TEXT),
        (f"<head><title>T</title>{BODY}", TEXT),
        (f"<body><div class='content no-sidebar'>{BODY}</div></body>", TEXT),
        (f"<body><article class='post has-comments'>{BODY}</article></body>", TEXT),
        (f"<body><div class='social policy'>{BODY}</div><footer>x</footer></body>", TEXT),
        (f"<body><article><header><div><h1>Title</h1></div><p>By X</p></header>{BODY}</article></body>", "Title\n\n" + TEXT),
        (f"<body><header><h1>Site</h1></header><article>{BODY}</article></body>", TEXT),
        (f"<body><article><p>teaser</p></article><div>{BODY}</div></body>", TEXT),
        (f"<body><select><option>a<option>b{BODY}</body>", TEXT),
        (f"<body><svg><path>{BODY}</body>", TEXT),
        (f"<body><noscript>{BODY}</body>", TEXT),
        (f"<body><noscript>enable</noscript>{BODY}</body>", TEXT),
        (f"<body><main><ul><li><a>one</a><li><a>two</a><li><a>three</a></ul>{BODY}</main></body>", TEXT),
        (f"<body><article><p>Short.</p></article><section class=comments>{BODY}</section></body>", "Short."),
        (f"<body><article></article><div class=ad>{BODY}</div></body>", ""),
        (f"<body><div id=x>{BODY}</div><section class=comments>{BODY * 3}</section></body>", TEXT),
        (f"<body><div class=comments>{BODY}</div></body>", TEXT),
    ],
)
def test_pages(page, text):
    assert html.extract(page) == text


def test_every_page_is_cut_at_surges_and_dives(monkeypatch):
    seen = []
    own = html.stretches
    monkeypatch.setattr(html, "stretches", lambda *a: seen.append(1) or own(*a))
    for page in (f"<article>{BODY}</article>", f"<main>{BODY}</main>", f"<div>{BODY}</div>", ""):
        before = len(seen)
        html.extract(page)
        assert len(seen) > before


def test_deep_and_unclosed_pages_take_time_in_proportion():
    for unit in ("<select>", "<svg>", "<noscript>", "<div class=social>", "<header>", "<a>", "<p><b>"):
        html.extract(unit * 20_000 + "x")
