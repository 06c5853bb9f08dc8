"""Quality classifier: naive Bayes support vectors on n-gram indicators.

Features are indicators of word unigrams and bigrams and of n-grams of word shapes (letter case, digits, end marks,
repetition of the word before), hashed into `cells`. Each is scaled by the log ratio of its smoothed share in the two
classes; a linear hinge-loss model is then fitted by dual coordinate descent, classes weighted to balance, and a logistic curve
over out-of-fold margins turns margins into scores.

The model is fitted on a sample of the labelled documents, those least in a hash of their id, so that it is
the same at every run: `max_rows` documents at most, and of these only as many as fit into `max_bytes` bytes of features, a row at
a time in that order. Of rows that repeat an id, one is learnt from, the least by its features. Every document is scored whole. Labels only ever choose and mark training rows.

Defined results: a null or empty text has no features and scores as such a text; rows with a null id or label are never
trained on; a null id is not held out; rows that repeat an id get equal scores for equal texts; with one class (or none) to learn from, all scores are that
class's share (0.5 for none); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, text_batches

CELLS = 1 << 18
MAX_ROWS = 20_000
MAX_BYTES = 64 << 20
SMOOTHING = 1.0
COST = 1.0
EPOCHS = 12
FOLDS = 3
LEVEL = 0.7


def features(texts, cells: int):
    """Sorted distinct cells of each text."""
    import numpy as np

    from .tokens import hashes, mix, words

    w = words(texts)
    h = hashes(w)
    if len(h):
        size = w.end - w.start
        kind = np.zeros(256, np.uint64)
        kind[65:91], kind[97:123], kind[48:58], kind[128:] = 1, 2, 3, 4
        kind[33:48] = np.arange(5, 20)
        kind[58:65], kind[91:97], kind[123:127] = np.arange(20, 27), np.arange(27, 33), np.arange(33, 37)
        first, last = kind[w.data[w.start]], kind[w.data[w.end - 1]]
        before = kind[w.data[np.maximum(w.start, w.end - 2)]]
        again = np.concatenate(([False], h[1:] == h[:-1]))
        shape = mix(first + (last << np.uint64(8)) + (before << np.uint64(16)) + (again.astype(np.uint64) << np.uint64(24)) + (np.minimum(size, 2).astype(np.uint64) << np.uint64(26)))
        last_one = np.concatenate((h[:1], h[:-1]))
        last_shape = np.concatenate((shape[:1], shape[:-1]))
        third = np.concatenate((shape[:2], shape[:-2]))
        pairs = mix(last_one * np.uint64(0x9E3779B97F4A7C15) + h)
        shapes2 = mix(last_shape * np.uint64(0xC2B2AE3D27D4EB4F) + shape)
        shapes3 = mix(third * np.uint64(0x165667B19E3779F9) + shapes2)
        n = np.uint64(cells)
        ones, pairs, s1, s2, s3 = ((x % n).astype(np.int32) for x in (h, pairs, shape, shapes2, shapes3))
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
        yield np.unique(np.concatenate((ones[a:b], pairs[a + 1 : b], s1[a:b], s2[a + 1 : b], s3[a + 2 : b]))) if b > a else np.zeros(0, np.int32)


def nb_ratios(rows, y, cells: int):
    """Log ratio of each cell's smoothed share of the classes' indicators."""
    import numpy as np

    shares = []
    for c in (1, 0):
        some = [x for x, label in zip(rows, y, strict=True) if label == c]
        count = SMOOTHING + np.bincount(np.concatenate(some) if some else np.zeros(0, np.int64), minlength=cells)
        shares.append(np.log(count / count.sum()))
    return shares[0] - shares[1]


def fit_hinge(rows, y, ratios, cost: float = COST, epochs: int = EPOCHS):
    """Weights (over indicators, ratios multiplied in) and bias, by dual coordinate descent on the L2-regularised hinge loss."""
    import numpy as np

    n = len(rows)
    good = int(np.sum(y))
    limit = [cost * n / (2 * good) if label else cost * n / (2 * (n - good)) for label in y]
    sign = [1.0 if label else -1.0 for label in y]
    # Rows are scaled to unit length.
    values = [ratios[x] for x in rows]
    values = [v / math.sqrt(float(v @ v) + 1.0) for v in values]
    unit = [1.0 / math.sqrt(float(ratios[x] @ ratios[x]) + 1.0) for x in rows]
    squares = [float(v @ v) + u * u for v, u in zip(values, unit, strict=True)]
    w, bias, alpha = np.zeros(len(ratios)), 0.0, [0.0] * n
    order = np.random.default_rng(7)
    for _ in range(epochs):
        moved = 0.0
        for i in order.permutation(n).tolist():
            x, v = rows[i], values[i]
            gradient = sign[i] * (float(w[x] @ v) + bias * unit[i]) - 1.0
            new = min(max(alpha[i] - gradient / squares[i], 0.0), limit[i])
            step = new - alpha[i]
            if step:
                alpha[i] = new
                w[x] += step * sign[i] * v
                bias += step * sign[i] * unit[i]
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return w, bias


def margins(rows, ratios, w, bias):
    import numpy as np

    out = []
    for x in rows:
        v = ratios[x]
        out.append((float(w[x] @ v) + bias) / math.sqrt(float(v @ v) + 1.0))
    return np.array(out)


def fit_logistic(m, y):
    """(slope, offset) of the logistic curve of y over margins m, targets smoothed as for small classes, by Newton steps."""
    import numpy as np

    good, bad = float(np.sum(y)), float(len(y) - np.sum(y))
    target = np.where(np.asarray(y) == 1, (good + 1) / (good + 2), 1 / (bad + 2))
    x = np.stack([m, np.ones(len(m))], 1)
    b = np.array([1.0, math.log((good + 1) / (bad + 1))])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        h = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(h, x.T @ (target - p))
        b = b + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return float(b[0]), float(b[1])


def fit(rows: list, y: list[int], cells: int = CELLS) -> dict:
    """The model of labelled feature rows."""
    import numpy as np

    good = sum(y)
    if not 0 < good < len(y) or min(good, len(y) - good) < FOLDS:
        share = good / len(y) if y else 0.5
        return {"weights": None, "share": share}
    held = np.zeros(len(y))
    fold = np.zeros(len(y), int)
    for c in (0, 1):  # both classes in each fold
        some = np.flatnonzero(np.array(y) == c)
        fold[some] = np.arange(len(some)) % FOLDS
    for f in range(FOLDS):
        part = [i for i in range(len(y)) if fold[i] != f]
        some, labels = [rows[i] for i in part], [y[i] for i in part]
        ratios = nb_ratios(some, labels, cells)
        rest = np.flatnonzero(fold == f)
        held[rest] = margins([rows[i] for i in rest], ratios, *fit_hinge(some, labels, ratios, epochs=EPOCHS // 2))
    slope, offset = fit_logistic(held, y)
    ratios = nb_ratios(rows, y, cells)
    w, bias = fit_hinge(rows, y, ratios)
    return {"weights": w, "ratios": ratios, "bias": bias, "slope": slope, "offset": offset}


def id_crc(id_: Column) -> Column:
    return F.crc32(id_.cast("string").cast("binary"))


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, trained: Column, max_rows: int, max_bytes: int, cells: int) -> tuple[list, list[int]]:
    """Features and labels of the sample; max_rows rows and max_bytes bytes at most reach the driver."""
    import numpy as np

    marks = labels.filter(trained & F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("doc_id")).agg(F.min(label_col).cast("int").alias("y"))
    chosen = marks.orderBy(F.md5(F.col("doc_id").cast("string").cast("binary")), "doc_id").limit(max_rows)  # a documented bound

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for whole in batches:
            for batch in text_batches(whole, 2):
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x.tobytes() for x in features(batch.column(2), cells)], pa.binary())], ["doc_id", "y", "x"])

    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    every = texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "y", "text").mapInArrow(work, "doc_id long, y int, x binary")
    once = cut(every.groupBy("doc_id").agg(F.min(F.struct(F.length("x").alias("size"), "x", "y")).alias("row")).select("doc_id", "row.*"))
    order = Window.orderBy(F.md5(F.col("doc_id").cast("string").cast("binary")), "doc_id")  # max_rows ids and sizes at most
    fit = once.select("doc_id", F.sum("size").over(order).alias("upto")).filter(F.col("upto") <= max_bytes).select("doc_id")
    found = once.join(F.broadcast(fit), "doc_id").select("doc_id", "y", "x").toArrow().sort_by("doc_id")
    return [np.frombuffer(x, np.int32) for x in found.column("x").to_pylist()], found.column("y").to_pylist()


def score(docs: DataFrame, labels: DataFrame, trained: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES, cells: int = CELLS, level: float = LEVEL) -> DataFrame:
    """One row a document: doc_id, score, predicted. trained: which labelled rows may be learnt from."""
    model = fit(*training_rows(docs, labels, id_col, text_col, label_col, trained, max_rows, max_bytes, cells), cells)
    if model["weights"] is not None:
        model |= {"weights": model["weights"].astype("float32"), "ratios": model["ratios"].astype("float32")}
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two floats a cell

    def work(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        m = shared.value
        for whole in batches:
            for batch in text_batches(whole, 1):
                if m["weights"] is None:
                    p = np.full(batch.num_rows, m["share"])
                else:
                    z = m["slope"] * margins(features(batch.column(1), cells), m["ratios"], m["weights"], m["bias"]) + m["offset"]
                    p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array((p >= level).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col)).mapInArrow(work, "doc_id long, score double, predicted int")


def folded(docs: DataFrame, labels: DataFrame, **more) -> DataFrame:
    """score() with the labels of a quarter of the ids, by CRC-32 of the id's text, left out: held_out says of which rows."""
    held = F.coalesce(id_crc(F.col("doc_id")) % 4 == 2, F.lit(False))
    return score(docs, labels, ~held, **more).select("doc_id", held.alias("held_out"), "score", "predicted")
