"""Fingerprints and line windows against plain second versions."""

import random
from html.parser import HTMLParser

import numpy as np
import pytest

from depthwise.llm import fuzzy_hash, html_text, numtext

MASK32, MASK64 = (1 << 32) - 1, (1 << 64) - 1


def mix(x):
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = ((x ^ (x >> shift)) * factor) & MASK64
    return x ^ (x >> 31)


def plain_fingerprint(text):
    data = (text or "").encode()
    if not data:
        return "3::"
    rolling = []
    for i in range(len(data)):
        h = 0
        for k in range(i - 6, i + 1):
            h = (h * 0x01000193 + (data[k] if k >= 0 else 0) + 1) & MASK32
        h ^= h >> 15
        h = (h * 0x85EBCA6B) & MASK32
        rolling.append(h ^ (h >> 13))

    def letters(size, most):
        out, start = "", 0
        ends = [i + 1 for i, h in enumerate(rolling) if h % size == size - 1 and i + 1 < len(data)]
        for end in [*ends[: most - 1], len(data)]:
            total = sum(int(numtext.BYTE_VALUES[data[i]]) * pow(numtext._BASE, i - start, 1 << 64) for i in range(start, end)) + end - start
            out += "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"[mix(total & MASK64) >> 58]
            start = end
        return out

    size = 3
    while size * 64 < len(data):
        size *= 2
    while size > 3 and sum(h % size == size - 1 for h in rolling) < 32:
        size //= 2
    return f"{size}:{letters(size, 64)}:{letters(2 * size, 32)}"


@pytest.mark.parametrize("n", [0, 1, 6, 8, 50, 191, 200, 900, 4000])
def test_fingerprint(n):
    r = random.Random(n)
    for text in ("".join(r.choice("abcdefgh é\n") for _ in range(n)), "a" * n, "ab" * n):
        assert fuzzy_hash.fingerprint(text) == plain_fingerprint(text)


def plain_runs(size, threshold):
    """Lines that some window of enough text covers, windows next to each other together, without weightless lines at the edges."""
    strong = [k for k in range(len(size)) if sum(size[k : k + html_text.WINDOW]) >= threshold]
    stretches = []
    for k in strong:
        if stretches and stretches[-1][-1] == k - 1:
            stretches[-1].append(k)
        else:
            stretches.append([k])
    out = []
    for s in stretches:
        covered = [k for k in range(s[0], min(s[-1] + html_text.WINDOW, len(size))) if size[k]]
        if covered and out and covered[0] < out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], covered[-1] + 1))
        elif covered:
            out.append((covered[0], covered[-1] + 1))
    return out


def test_runs():
    r = np.random.default_rng(2)
    for _ in range(500):
        size = [int(x) if r.random() < 0.5 else 0 for x in r.integers(1, 40, int(r.integers(0, 25)))]
        for threshold in (1, 10, 45, 200):
            assert html_text.runs(size, threshold) == plain_runs(size, threshold)


class Reader(HTMLParser):
    """Lines of well-formed markup by the library's own parser: text, characters outside links, distribution."""

    def __init__(self):
        super().__init__()
        self.open, self.lines, self.text, self.free = [], [], "", ""

    def end(self):
        text = " ".join(self.text.split())
        if text:
            kinds = [k for _, k in self.open if k is not None]
            kind = 2 if "x" in kinds else kinds[-1] if kinds else 1
            self.lines.append((text, kind))
        self.text = ""

    def handle_starttag(self, tag, attrs):
        if tag in ("b", "i", "a", "span"):
            return
        self.end()
        names = dict(attrs).get("class") or ""
        kind = "x" if "comments" in names else 2 if tag in ("nav", "footer", "aside") or "site-nav" in names or "ad" in names.split() else 0 if tag == "article" else None
        self.open.append((tag, kind))

    def handle_endtag(self, tag):
        if tag in ("b", "i", "a", "span"):
            return
        self.end()
        self.open.pop()

    def handle_data(self, data):
        self.text += data


def test_lines_of_a_page():
    r = random.Random(6)

    def element(depth):
        if depth == 0 or r.random() < 0.2:
            inner = "".join(r.choice(["word ", "a &amp; b ", "<b>bold</b> ", "<a href='x'>link</a> ", "\n ", "é&lt;p&gt; "]) for _ in range(r.randint(0, 6)))
            return f"<p>{inner}</p>"
        tag, attributes = r.choice([("div", ""), ("div", " class='ad'"), ("div", ' class="site-nav x"'), ("section", " class=comments"), ("article", ""), ("nav", ""), ("aside", ""), ("footer", ""), ("div", " class='adventure'"), ("ul", "")])
        return f"<{tag}{attributes}>" + "".join(element(depth - 1) for _ in range(r.randint(0, 4))) + f"</{tag}>"

    for _ in range(300):
        page = "<body>" + "".join(element(4) for _ in range(4)) + "</body>"
        reader = Reader()
        reader.feed(page)
        assert [(text, kind) for text, _, kind, _ in html_text.lines(page)] == reader.lines
