"""Personal data, main text of pages, fingerprints, sharding and the classifier."""

import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from depthwise.llm import fuzzy_hash, html_text, pii, quality, sharding

# ---- personal data -----------------------------------------------------------------------------------------------------------


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        v = int(c) * (1 + k % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def brute(text):
    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(re.sub(r"\D", "", m)) <= 19 and luhn(re.sub(r"\D", "", m))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(re.sub(r"\D", "", m)) <= 15),
    }
    return {k: [(m.start(), m.end()) for m in re.finditer(p, text or "", re.A) if ok(m[0])] for k, (p, ok) in kinds.items()}


TEXTS = [
    "Mail a.b+c@ex-ample.co.uk, x@y.z_w@v.u or no@domain. Über 😀 q@r.st",
    "10.0.0.1 and 256.1.1.1 then 1.2.3.4.5.6.7.8 00012.1.1.001 1..2.3.4",
    "card 4111 1111 1111 1111 or 4111-1111-1111-1112, 5500005555555559 x 4111 1111 1111 1111 1",
    "+49 (30) 1234-5678 call +1 2 +123456789012345678 +1.800.555.0199 ++44 20 7946 0958",
    "IBAN DE89 3704 0044 0532 0130 00 and GB82WEST12345698765432, bad DE88370400440532013000",
    "my ssn is 123-45-6789 but 123-45-6789 and amex card 3782 822463 10005",
    "order 123-45-6789 of the day, 3782 822463 10005", None, "", "a" * 20000 + "@" + "b." * 5000 + "c", "1." * 20000, "1 " * 20000, "é" * 50 + " x@y.zz",
]


def test_personal_data(spark):
    r = random.Random(6)
    rows = list(enumerate(TEXTS)) + [(100 + k, "".join(r.choice("a1.@+- 5()0é4") for _ in range(r.randint(0, 400)))) for k in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as pii_email", "2 as __0m")
    got = {x.doc_id: x for x in pii.report(df).collect()}
    for doc, text in rows:
        want = brute(text)
        flat = [f"{k}:{a}:{b}" for k, spans in want.items() for a, b in spans]
        assert (got[doc].n_email, got[doc].n_ip, got[doc].n_card, got[doc].n_phone) == tuple(len(v) for v in want.values()), text
        assert got[doc].base_sha256 == hashlib.sha256(",".join(flat).encode()).hexdigest(), text
        assert got[doc].spans.split(",")[: len(flat)] == flat or not flat
        assert len(got[doc].spans.split(",")) == len(got[doc].scores.split(","))
    assert [s.split(":")[0] for s in got[4].spans.split(",")].count("iban") == 2
    assert "ssn:10:21" in got[5].spans and "short_card" in got[5].spans and got[5].spans.count("ssn") == 2
    assert got[6].spans == ""  # no context words
    assert pii.report(df.limit(0)).collect() == []


# ---- pages -------------------------------------------------------------------------------------------------------------------


def test_main_text(spark):
    page = (
        '<!DOCTYPE html><html><head><title>T</title><script>var t="</p><article>no</article>";</script><style>p{}</style></head><body><header>Site</header><nav><ul><li><a href="/">Home</a></li></ul></nav>'
        '<div class="ad">Buy</div><div id="cookie-notice"><p>We use cookies</p></div><article><h1>Head &amp; line</h1><p>First  <b>bold</b>\n text&nbsp;here.<br><p>Second &lt;p&gt; &#233;<div class="sidebar">Side</div><form><p>Mail?</p></form>'
        '<p>As.</p><!-- <p>hidden</p> --><section class="comments"><p>Reader says</p></section><blockquote>Quote</blockquote></article><aside>Rest</aside><footer>&copy; x</footer>'
    )
    assert html_text.main_text(page) == "Head & line\nFirst bold text here.\nSecond <p> é\nAs.\nQuote"
    plain = "<body><div class='menu'><a href=x>One</a> <a href=y>Two</a></div><div><p>Long text of the page goes here.</p><p>And more of it.</p></div><footer>end</footer></body>"
    assert html_text.main_text(plain) == "Long text of the page goes here.\nAnd more of it."
    rows = [(1, "u", page), (2, None, None), (3, "v", ""), (4, "w", "no markup at all"), (5, "x", "<" * 2000), (6, "y", "<p>" * 20000 + "deep"), (1, "u", page)]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as text", "2 as id")).collect()
    assert [(r.page_id, r.n_chars) for r in got].count((1, len(html_text.main_text(page)))) == 2
    assert {r.page_id: r.text for r in got}[2] == "" and {r.page_id: r.text for r in got}[4] == "no markup at all" and {r.page_id: r.text for r in got}[6] == "deep"


# ---- fingerprints ----------------------------------------------------------------------------------------------------------------


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        last, row[0] = row[0], i + 1
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], min(row[j + 1] + 1, row[j] + 1, last + (0 if x == y else 2))
    return row[-1]


def test_edit_distance():
    r = random.Random(2)
    for _ in range(200):
        a, b = ("".join(r.choice("ABC") for _ in range(r.randint(0, 20))) for _ in range(2))
        assert fuzzy_hash.edit_distance(a, b) == levenshtein(a, b)


def test_fingerprints(spark, corpus):
    rows, df = corpus
    got = {r.doc_id: r for r in fuzzy_hash.fingerprints_with_edits(df).collect()}
    assert len(got) == len(rows)
    texts = [r[1] or "" for r in sorted(rows)]
    for k, text in enumerate(texts):
        after = texts[(k + 1) % len(texts)]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        r = got[k]
        assert (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) == (len(text), hashlib.sha256(edited.encode()).hexdigest(), fuzzy_hash.fingerprint(text), fuzzy_hash.fingerprint(edited))
        assert r.near_next == fuzzy_hash.likeness(r.fingerprint, fuzzy_hash.fingerprint(after)) and 0 <= r.near_edited <= 1
    long = [k for k, t in enumerate(texts) if len(t) > 300 and len(set(t)) > 5]
    assert sum(got[k].near_edited for k in long) / len(long) > 0.4 > 5 * sum(got[k].near_next for k in long if k > 30) / len(long)
    assert fuzzy_hash.fingerprints_with_edits(df.limit(0)).collect() == []
    one = fuzzy_hash.fingerprints_with_edits(df.filter("doc_id = 3")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0


# ---- sharding ----------------------------------------------------------------------------------------------------------------------


def test_placement(spark):
    names = [f"s{k}" for k in range(10)]
    table = sharding.fill_table(names, 1009)
    share = Counter(table)
    assert set(share) == set(range(10)) and max(share.values()) - min(share.values()) <= 1
    fewer = sharding.fill_table(names[:-1], 1009)
    moved = sum(1 for a, b in zip(table, fewer) if a != b and a != 9)
    assert moved < 0.35 * 1009
    weighted = Counter(sharding.fill_table(names, 1009, {"s0": 3}))
    assert weighted[0] == pytest.approx(3 * weighted[1], rel=0.05)
    with pytest.raises(ValueError):
        sharding.fill_table(names, 1000)
    df = spark.createDataFrame([(k, "x") for k in range(2000)] + [(None, "y"), (7, "z")], "doc_id long, slot string")
    got = sharding.place(df, "doc_id", names, 1009).collect()
    for r in got:
        slot = int(hashlib.md5(("" if r.doc_id is None else str(r.doc_id)).encode()).hexdigest()[:15], 16) % 1009
        assert (r.slot, r.shard) == (slot, names[table[slot]])


# ---- classifier ------------------------------------------------------------------------------------------------------------------------


def test_classifier(spark, words):
    r = random.Random(1)
    rows, labels = [], []
    for k in range(500):
        good = k % 4 != 0
        text = " ".join(r.choice(words) for _ in range(r.randint(20, 80)))
        rows.append((k, text if good else text.upper().replace(" ", "!! "), "x"))
        if k % 2 or k % 8 == 0:
            labels.append((k, int(good), 0))
    rows += [(900, None, "x"), (901, "", "x"), (902, "z" * 300000, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, score string").selectExpr("*", "3 as label", "4 as draw")
    marks = spark.createDataFrame(labels + [(1, 1, 0), (3, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = {x.doc_id: x for x in quality.judged(df, marks).collect()}
    assert len(got) == len(rows) and all(0 <= x.score <= 1 and x.predicted == (x.score >= 0.3) for x in got.values())
    import zlib

    assert all(x.held_out == (zlib.crc32(str(k).encode()) % 5 == 0) for k, x in got.items())
    right = [got[k].predicted == (k % 4 != 0) for k in range(500) if got[k].held_out]
    assert sum(right) / len(right) > 0.97
    kept = quality.accepted(df, marks)
    assert kept.columns == df.columns and {x.doc_id for x in kept.collect()} == {k for k, x in got.items() if x.predicted}


def test_classifier_without_labels(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [x.score for x in quality.judged(df, none).collect()] == [0.5, 0.5]
    assert quality.judged(df.limit(0), none).collect() == []
    assert df.select(F.count("*")).first()[0] == 2
