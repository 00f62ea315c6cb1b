"""A quality score from Naive Bayes support vectors.

Indicators of n-grams (bytes of one to four, words, and runs of one repeated word by their length), hashed to FEATURES buckets, are scaled by the log-count ratio of the
two classes; a linear model with hinge loss is fitted on them by dual coordinate descent, and its margin becomes a probability
by a logistic fit on rows that the descent didn't see.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .numtext import BYTE_VALUES, POSITION_FACTORS, U64, as_bytes, mix, word_hashes
from .storage import free_name, materialize

FEATURES = 1 << 18
ORDERS = (1, 2, 3, 4)
#: Bounds of the sample that the linear model is fitted on: rows of each class, and indicators in all. The log-count ratios
#: come from all rows that may be learnt from.
FIT_ROWS, FIT_INDICATORS = 2_000, 20_000_000
#: Lengths of runs of one repeated word that are n-grams of their own.
RUNS = (2, 3, 4, 6, 8, 12)
#: Bound of the broadcast labels: 16 bytes each.
FEW_LABELS = 2_000_000
COST, EPOCHS, SMOOTH = 1.0, 12, 1.0
THRESHOLD = 0.3
_SHIFT = U64(64 - 18)


def indicators(text: str | None) -> np.ndarray:
    """Sorted distinct buckets of the text's n-grams."""
    data = as_bytes(text)
    seen = np.zeros(FEATURES, bool)
    values = BYTE_VALUES[data]
    for n in ORDERS:
        m = len(data) - n + 1
        if m <= 0:
            break
        h = values[:m] * POSITION_FACTORS[8 * n]
        for k in range(1, n):
            h += values[k : k + m] * POSITION_FACTORS[8 * n + k]
        seen[(h >> _SHIFT).astype(np.int64)] = True
    words = word_hashes(data)
    seen[(words >> _SHIFT).astype(np.int64)] = True
    if len(words):
        change = np.flatnonzero(np.concatenate([[True], words[1:] != words[:-1], [True]]))
        longest = int(np.diff(change).max())
        seen[(mix(np.array([r for r in RUNS if r <= longest], U64)) >> _SHIFT).astype(np.int64)] = True
    return np.flatnonzero(seen).astype(np.int32)


def log_count_ratio(positive: np.ndarray, negative: np.ndarray, smooth: float = SMOOTH) -> np.ndarray:
    p, q = positive + smooth, negative + smooth
    return np.log(p / p.sum()) - np.log(q / q.sum())


def dual_coordinate_descent(rows: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, cost: float = COST, epochs: int = EPOCHS, seed: int = 7) -> np.ndarray:
    """Weights, with the intercept last, of the linear hinge-loss model on the scaled indicators, each row of unit length.
    Classes weigh alike in sum."""
    w = np.zeros(len(ratio) + 1)
    square = np.array([float(v @ v) + 1 for v in (scaled(r, ratio) for r in rows)])
    most = cost * len(y) / (2 * np.where(y > 0, (y > 0).sum(), (y < 0).sum()))
    alpha, order = np.zeros(len(y)), np.random.default_rng(seed)
    for _ in range(epochs):
        for i in order.permutation(len(y)):
            x = scaled(rows[i], ratio)  # made anew: kept, all of them take several times the room of the rows
            g = y[i] * (w[rows[i]] @ x + w[-1]) - 1
            new = min(max(alpha[i] - g / square[i], 0.0), most[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[rows[i]] += step * x
                w[-1] += step
                alpha[i] = new
    return w


def scaled(row: np.ndarray, ratio: np.ndarray) -> np.ndarray:
    v = ratio[row]
    return v / max(float(np.sqrt(v @ v)), 1e-9)


def logistic(margin: np.ndarray, positive: np.ndarray, prior: float) -> tuple[float, float]:
    """(slope, intercept) of P(positive | margin), rows weighted so that positives have the share `prior`; smoothed targets."""
    n1, n0 = max(positive.sum(), 1), max((~positive).sum(), 1)
    target = np.where(positive, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    weight = np.where(positive, prior / n1, (1 - prior) / n0) * len(margin)
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        d, h = weight * (p - target), weight * np.maximum(p * (1 - p), 1e-6)
        hess = np.array([[(h * margin * margin).sum() + 1e-3, (h * margin).sum()], [(h * margin).sum(), h.sum() + 1e-3]])
        step = np.linalg.solve(hess, [(d * margin).sum() + 1e-3 * (a - 1), d.sum()])
        a, b = a - step[0], b - step[1]
    return max(a, 1e-3), b


def margin(row: np.ndarray, w: np.ndarray, ratio: np.ndarray) -> float:
    return float(w[row] @ scaled(row, ratio) + w[-1]) if len(row) else float(w[-1])


def fit(rows: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, prior: float) -> tuple[np.ndarray, float, float]:
    """Weights for indicators as they are (log-count ratio included, but not the row's length), intercept last; slope and
    intercept of the logistic. Every fifth row serves the logistic only."""
    test = np.arange(len(y)) % 5 == 4
    w = dual_coordinate_descent([r for r, t in zip(rows, test) if not t], y[~test], ratio)
    got = np.array([margin(r, w, ratio) for r, t in zip(rows, test) if t])
    return w, *logistic(got, y[test] > 0, prior)


# ---- on Spark ----------------------------------------------------------------------------------------------------------------


def held_out(id_col) -> F.Column:
    """Whether crc32 of the id as text is a multiple of 5: such rows are never learnt from. A null id is held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def _learnt(batches):
    """Sampled rows with their indicators, and at the end this task's counts by class of each indicator that it saw."""
    counts = np.zeros((2, FEATURES), np.int64)
    for batch in batches:
        label, draw, found = [], [], []
        for k in range(batch.num_rows):
            text, y, taken, d = (c[k].as_py() for c in batch.columns)
            row = indicators(text)
            counts[y, row] += 1
            if taken:
                label.append(y)
                draw.append(d)
                found.append(row.tobytes())
        yield _learnt_batch([label, draw, found], [[]] * 3)
    seen = np.flatnonzero(counts.any(axis=0))
    for part in np.array_split(seen, max(1, len(seen) // 16384)):
        yield _learnt_batch([[]] * 3, [part, counts[0, part], counts[1, part]])


def _learnt_batch(rows, counts):
    n, m = len(rows[0]), len(counts[0])
    columns = [pa.concat_arrays([pa.array(v, t), pa.nulls(m, t)]) for v, t in zip(rows, (pa.int32(), pa.int64(), pa.binary()))]
    columns += [pa.concat_arrays([pa.nulls(n, t), pa.array(v, t)]) for v, t in zip(counts, (pa.int32(), pa.int64(), pa.int64()))]
    return pa.RecordBatch.from_arrays(columns, ["label", "draw", "indicators", "bucket", "negative", "positive"])


def _fitted(ratio, prior):
    def run(batches):
        rows = [r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns))]
        rows.sort(key=lambda r: (r[1], r[0], r[2]))
        kept, size = [], 0
        for y, _, found in rows:
            size += len(found) // 4
            if size > FIT_INDICATORS:
                break
            kept.append((y, np.frombuffer(found, np.int32)))
        if kept:
            y = np.array([1 if k[0] else -1 for k in kept])
            if (y > 0).any() and (y < 0).any():
                w, a, b = fit([k[1] for k in kept], y, ratio.value, prior)
                yield pa.RecordBatch.from_arrays([pa.array([w.tobytes()]), pa.array([float(a)]), pa.array([float(b)])], ["w", "a", "b"])

    return run


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> tuple[np.ndarray, np.ndarray, float, float]:
    """(weights with the intercept last, log-count ratios, slope, intercept) of the model; FEATURES numbers each, whatever the
    data's size.

    Learns from the rows of `labels` with label 0 or 1 that aren't held out; of several labels of an id the lowest counts. The
    log-count ratios come from all of them, the linear model from a sample of at most about FIT_ROWS rows of each class, drawn
    by a hash of the id. With labels of one class only, or none, every score is the share of label 1 (0.5 without labels).
    """
    spark = docs.sparkSession
    known = labels.filter(F.col(label_col).isin(0, 1) & ~held_out(id_col)).groupBy(F.col(id_col).cast("bigint").alias("id")).agg(F.min(label_col).cast("int").alias("label"))
    known = materialize(known, "labels")
    n = {r.label: r["count"] for r in known.groupBy("label").count().collect()}
    total = sum(n.values())
    prior = n.get(1, 0) / total if total else 0.5
    draw = F.xxhash64("id").bitwiseAND(F.lit((1 << 40) - 1))
    share = F.when(F.col("label") == 1, F.lit(FIT_ROWS / max(n.get(1, 0), 1))).otherwise(F.lit(FIT_ROWS / max(n.get(0, 0), 1)))
    known = known.withColumn("draw", draw).withColumn("taken", F.col("draw") < share * (1 << 40))
    texts = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    joined = texts.join(F.broadcast(known) if total <= FEW_LABELS else known, "id").select("text", "label", "taken", "draw")
    learnt = materialize(joined.mapInArrow(_learnt, "label int, draw bigint, indicators binary, bucket int, negative bigint, positive bigint"), "learnt")
    counts = np.zeros((2, FEATURES), np.int64)
    summed = learnt.filter("bucket is not null").groupBy("bucket").agg(F.sum("negative").alias("negative"), F.sum("positive").alias("positive")).toArrow()
    at = summed["bucket"].to_numpy()
    counts[0, at], counts[1, at] = summed["negative"].to_numpy(), summed["positive"].to_numpy()
    ratio = log_count_ratio(counts[1], counts[0])
    sample = learnt.filter("label is not null").select("label", "draw", "indicators").repartition(1)
    got = sample.mapInArrow(_fitted(spark.sparkContext.broadcast(ratio), prior), "w binary, a double, b double").collect()
    if not got:
        return np.zeros(FEATURES + 1), ratio, 1.0, float(np.log(max(prior, 1e-6) / max(1 - prior, 1e-6)))
    return np.frombuffer(got[0].w, np.float64), ratio, got[0].a, got[0].b


def score(docs: DataFrame, model: tuple, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """docs with the score of each text (0 to 1; null and empty texts have that of no indicators), in one pass without a
    shuffle. A column of that name is replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def of(texts: pa.Array) -> pa.Array:
        w, ratio, a, b = shared.value
        margins = np.array([margin(indicators(t.as_py()), w, ratio) for t in texts])
        return pa.array(1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30))), pa.float64())

    return docs.withColumn(score_col, of(F.coalesce(F.col(text_col), F.lit(""))))


def judged(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """(id, held_out, score, predicted) of every row; predicted is 1 from a score of THRESHOLD on."""
    model = train(docs, labels, id_col, text_col, label_col)
    rows = docs.select(F.col(id_col), held_out(id_col).alias("held_out"), F.col(text_col).alias("__text"))
    return score(rows, model, "__text").select(id_col, "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """The rows of docs that the model does not reject, with their own columns."""
    model = train(docs, labels, id_col, text_col, label_col)
    name = free_name(docs, "__score")
    return score(docs, model, text_col, name).filter(F.col(name) >= THRESHOLD).drop(name)
