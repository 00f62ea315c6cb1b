import random

import pytest


@pytest.fixture(scope="session")
def words():
    r = random.Random(3)
    return ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 8))) for _ in range(400)]


@pytest.fixture(scope="session")
def corpus(spark, words):
    """(rows, DataFrame): texts with copies, near copies, shared passages, repeats, nulls and empties, and columns whose names the
    operators use themselves."""
    r = random.Random(9)
    text = lambda n: "\n".join(" ".join(r.choice(words) for _ in range(r.randint(3, 25))) for _ in range(n))
    texts = [text(r.randint(1, 6)) for _ in range(60)]
    passage = text(2)
    texts += [texts[k] for k in range(8)]
    for k in range(8, 30):
        parts = texts[k].split(" ")
        for _ in range(max(1, len(parts) // 60)):
            parts[r.randrange(len(parts))] = r.choice(words)
        texts.append(" ".join(parts))
    texts += [texts[k] + "\n" + passage for k in range(30, 45)]
    texts += ["", None, " \t\n", "one two", "one  TWO", "one two three four five", "One two three four five", "a " * 3000, "z\n" * 50]
    rows = [(k, t, "en", "src0" if k % 3 else f"src{k % 7}", None if t is None else len(t)) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return rows, df.selectExpr("*", "1 as id", "'k' as key", "2.5 as n", "'q' as score", "0 as start").repartition(3)
