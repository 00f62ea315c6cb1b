"""Spelling variants of the corpus's words, by PartEnum signatures.

Two words are near if one code point inserted, deleted or replaced makes one of the other. A word's letters are a multiset, which
is a binary vector with an element for the k-th occurrence of each letter; for near words these vectors differ in at most two
places. PartEnum finds all such pairs by equality: the elements are dealt to PARTS partitions, two differences touch at most two
of them, so that for some choice of the other partitions both vectors are the same there. A word has a signature for each choice.

Letters alone leave large groups, so that a signature also holds what a single edit can't change by position: of the shorter
word's length s, either the first s // 2 code points or the last s - s // 2 are the same in both. A word stands as the shorter one
(or one of two of equal length) and as the longer one, which are joined with each other only, so that no pair of longer ones is
looked at. The equality join verifies each pair by its edit distance as it goes; only near pairs leave it.

How it scales: words are counted within each task's run of documents before the shuffle, so that a frequent word is a row a task.
Everything later has a row for each distinct word. Signature groups hold distinct words, and the join streams over them sorted.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .numtext import U64, inverse_powers, mix, powers
from .storage import materialize

SHORTEST = 7
LEAST = 2
#: How many times as frequent as a word the form it is counted under must be.
RATIO = 10
#: A word of a document is damaged if its checksum is a multiple of this.
DAMAGED = 31
PARTS = 4
_CHOICES = list(combinations(range(PARTS), PARTS - 2))
#: Different words that a task counts before it hands them on.
_FLUSH = 200_000
_LOWER = {c: c + 32 for c in range(65, 91)}


def lower(word: str) -> str:
    """The word with A-Z as a-z, other letters as they are."""
    return word.lower() if word.isascii() else word.translate(_LOWER)


def document_words(doc_id: str, text: str, shortest: int = SHORTEST, damaged: int = DAMAGED) -> Counter:
    """Number of each word of a document. Where the checksum of `doc_id:word` is a multiple of `damaged`, the code point at checksum
    modulo length is gone; words are counted as they are then, those below `shortest` code points not at all."""
    own: Counter = Counter()
    for run, n in Counter(re.findall("[A-Za-zÀ-ÿ]{%d,}" % shortest, text)).items():
        own[lower(run)] += n
    out: Counter = Counter()
    start = zlib.crc32(f"{doc_id}:".encode("utf-8", "surrogatepass"))
    for word, n in own.items():
        h = zlib.crc32(word.encode(), start)
        if h % damaged == 0:
            at = h % len(word)
            word = word[:at] + word[at + 1 :]
        if len(word) >= shortest:
            out[word] += n
    return out


def _counts(batches):
    def flushed(counts):
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

    counts: Counter = Counter()
    for batch in batches:
        for doc_id, text in zip(*(c.to_pylist() for c in batch.columns)):
            counts.update(document_words(doc_id, text))
            if len(counts) > _FLUSH:
                yield flushed(counts)
                counts = Counter()
    yield flushed(counts)


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """(word, n) of the words with at least `least` occurrences in all documents. A null text has none, a null id is empty."""
    rows = docs.filter(F.col(text_col).isNotNull()).select(F.coalesce(F.col(id_col).cast("string"), F.lit("")), text_col)
    counted = rows.mapInArrow(_counts, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.filter(F.col("n") >= least)


# ---- signatures --------------------------------------------------------------------------------------------------------------


def signatures(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of the word, whether it stands as the longer one, signature), a row for each signature of each word."""
    length = np.array([len(w) for w in words], np.int64)
    chars = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    row = np.repeat(np.arange(len(words)), length)
    end = np.cumsum(length)
    begin = end - length
    # elements: the k-th occurrence of a letter in its word
    order = np.lexsort((chars, row))
    r, c, at = row[order], chars[order], np.arange(len(chars))
    new = np.append(True, (r[1:] != r[:-1]) | (c[1:] != c[:-1]))[: len(chars)]
    k = at - np.maximum.accumulate(np.where(new, at, 0)) if len(chars) else at
    value = mix(c.astype(U64) * U64(0x9E3779B97F4A7C15) + k.astype(U64))
    projected = np.zeros((PARTS, len(words)), U64)
    np.add.at(projected, ((c + k) % PARTS, r), value)
    # digests of the halves
    total = np.zeros(len(chars) + 1, U64)
    np.cumsum(mix(chars.astype(U64) + U64(1)) * powers(len(chars)), out=total[1:])
    inverse = inverse_powers(len(chars) + 1)
    digest = lambda a, b: mix((total[b] - total[a]) * inverse[a])
    index, longer, found = [], [], []
    for long in (0, 1):
        who = np.flatnonzero(length - long >= 1)
        s = length[who] - long
        half = s // 2
        for side, part in enumerate((digest(begin[who], begin[who] + half), digest(end[who] - (s - half), end[who]))):
            for number, chosen in enumerate(_CHOICES):
                kind = U64((number * 2 + side + 1) * 0xD6E8FEB86659FD93 % (1 << 64))
                key = mix(part + kind) + s.astype(U64)
                for p in chosen:
                    key = mix(key * U64(0x2545F4914F6CDD1D) + projected[p][who])
                index.append(who)
                longer.append(np.full(len(who), bool(long)))
                found.append(key)
    return np.concatenate(index), np.concatenate(longer), np.concatenate(found).view(np.int64)


def _signature_rows(batches):
    for batch in batches:
        if batch.num_rows:
            index, longer, found = signatures(batch.column(0).to_pylist())
            rows = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["word", "n"]).take(pa.array(index))
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(longer), *rows.columns], ["signature", "longer", "word", "n"])


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, a_n, b, b_n): each unordered pair of near words (column word, distinct, with n) once."""
    rows = words.select("word", "n").mapInArrow(_signature_rows, "signature bigint, longer boolean, word string, n bigint")
    a = rows.filter("not longer").select("signature", F.col("word").alias("a"), F.col("n").alias("a_n"))
    b = rows.select("signature", "longer", F.col("word").alias("b"), F.col("n").alias("b_n"))
    near = (F.col("longer") | (F.col("a") < F.col("b"))) & (F.levenshtein("a", "b", 1) == 1)
    return a.join(b.hint("merge"), "signature").filter(near).select("a", "a_n", "b", "b_n").distinct()


# ---- forms -------------------------------------------------------------------------------------------------------------------


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of all words with a form: forms are followed to the last. A form is so many times as frequent as its word
    that chains are short, and each round doubles what has been followed."""
    chain = materialize(forms.select("word", F.col("form").alias("root")), "chain")
    while True:
        ahead = chain.select(F.col("word").alias("root"), F.col("root").alias("next"))
        chain = materialize(chain.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "chain")
        if chain.filter("moved").isEmpty():
            return chain.select("word", "root")
        chain = chain.select("word", "root")


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word: the most frequent near word (ties: the smallest in code-point order) is
    its form if it is at least `ratio` times as frequent; root is where following the forms ends, the word itself without one.

    Null texts have no words; repeated rows count again; other columns are ignored. Without words the result is empty.
    """
    words = materialize(vocabulary(docs, id_col, text_col), "words")
    pairs = materialize(near_pairs(words), "near")
    both = pairs.select("a", "a_n", F.col("b").alias("x"), F.col("b_n").alias("x_n")).unionByName(pairs.select(F.col("b").alias("a"), F.col("b_n").alias("a_n"), F.col("a").alias("x"), F.col("a_n").alias("x_n")))
    best = both.groupBy(F.col("a").alias("word")).agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("x_n")).alias("less"), "x")).alias("best"))
    joined = words.join(best, "word", "left")
    top: Column = -F.col("best.less")
    enough = top >= ratio * F.col("n")
    rows = materialize(joined.select("word", F.when(enough, F.col("best.x")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.when(enough, top).alias("form_n")), "forms")
    found = rows.join(_roots(rows.filter("form is not null")), "word", "left")
    return found.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
