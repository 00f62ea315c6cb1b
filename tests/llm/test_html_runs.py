"""Surge and dive decide on every page; skipped elements don't split the text."""

import re
from pathlib import Path

import pyarrow.parquet as pq
import pytest

from depthwise.llm import html_text

LONG = [f"Paragraph {k} of the main text, which is long enough to be told from the rest." for k in range(6)]
PARAGRAPHS = [f"<p>{t}</p>" for t in LONG]


@pytest.mark.parametrize("between", ['<div class="ad">Buy now</div>', "<script>var x = '</p>';</script>", "<button>More</button>", "<svg><path d='x'/></svg>", "<iframe src=x></iframe>", "<nav><a href=x>On</a></nav>", "<footer>Part</footer>"])
def test_skipped_element_between_paragraphs(between):
    for at in (1, 3, 5):
        page = f"<body><div>{''.join(PARAGRAPHS[:at])}{between}{''.join(PARAGRAPHS[at:])}</div></body>"
        assert html_text.main_text(page) == "\n".join(LONG)
        assert html_text.main_text(page.replace("div>", "article>", 1).replace("</div></body>", "</article></body>")) == "\n".join(LONG)


def test_article_element_is_a_weight():
    teaser = "<article><h2>Teaser</h2><p>Read this too.</p></article>"
    page = f"<body><main>{''.join(PARAGRAPHS[:4])}{teaser}{''.join(PARAGRAPHS[4:])}</main></body>"
    assert html_text.main_text(page) == "\n".join(LONG)
    page = f"<body><p>Note of the site.</p><p>{LONG[0]}</p><article>{''.join(PARAGRAPHS[1:])}</article><p>{LONG[0]}</p></body>"
    assert html_text.main_text(page) == "\n".join(LONG[1:])


def test_links_divide():
    links = "<ul>" + "".join(f"<li><a href={k}>Link number {k}</a></li>" for k in range(8)) + "</ul>"
    page = f"<body><p>Slogan.</p>{links}{''.join(PARAGRAPHS)}{links}<p>Imprint.</p></body>"
    assert html_text.main_text(page) == "\n".join(LONG)
    page = f"<body>{links}<article>{PARAGRAPHS[0]}{links}{PARAGRAPHS[1]}</article></body>"
    assert html_text.main_text(page).startswith(LONG[0]) and html_text.main_text(page).endswith(LONG[1])


BODY = "".join(PARAGRAPHS)
TEXT = "\n".join(LONG)


@pytest.mark.parametrize("page,want", [
    (f'<div class="share"><article>{BODY}</article></div>', TEXT),
    (f'<div class="notice-board">{BODY}</div><nav><a href=x>On</a></nav>', TEXT),
    (f"<body><div><aside><p>Side note</div><div>{BODY}</div></body>", TEXT),
    (f"<body><aside>Side note<article>{BODY}</article></body>", TEXT),
    (f'<div class="promotional-history">{BODY}</div><p>x</p>', TEXT),
    (f'<div class="navigation-history">{BODY}</div><div>Tagline</div>', TEXT),
    (f"<div>My Site</div><div>The best of sites</div><div>{BODY}</div><div>Copyright 2024 My Site</div>", TEXT),
    (f"<article>{BODY}<ul><li><a href=1>Related one</a></li><li><a href=2>Related two, long</a></li></ul></article>", TEXT),
    (f'<article>{BODY}<section class="comments"><p>{"First reader comment. " * 50}</p></section></article>', TEXT),
    (f'<div>{BODY}</div><ol class="comment-list"><li><article><p>{"A comment. " * 90}</p></article></li></ol>', TEXT),
    (f"<form><header>Shop</header>{BODY}</form>", TEXT),
    ("<p>Only this.</p>", "Only this."),
    ("<nav><a href=x>only a link</a></nav>", ""),
    ("<div hidden>no</div><script>x</script>", ""),
])
def test_tags_and_classes_are_weights(page, want):
    assert html_text.main_text(page) == want


def test_surge_and_dive_find_the_text_without_article_elements():
    """The given pages all have an article element; with its tags taken out the distribution alone has to find the text."""
    at = Path("/root/testdata/sf0.01/pages.parquet")
    if not at.exists():
        pytest.skip("no test tables")
    same = more = fewer = 0
    pages = [h for h in pq.read_table(at).column("html").to_pylist() if h]
    for h in pages:
        want = html_text.main_text(h)
        bare = re.sub("</?article>", "", h)
        got, every = html_text.main_text(bare), [x[0] for x in html_text.lines(bare)]
        same += got == want
        fewer += len(got) < len(want)
        more += len(every) > len(got.split("\n"))
    assert same >= 0.95 * len(pages) and more == len(pages) and fewer <= 0.05 * len(pages)


def test_empty_table(spark):
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []
