"""Quality rules: simple counts, then a hashed n-gram log-likelihood ratio of two multinomials.

The *trusted* multinomial counts word unigrams and bigrams, hashed into `cells`, over the documents that `trusted`
admits; the *raw* one counts them over all documents. A document's score is the mean over its n-grams of
log(p_trusted / p_raw); it is kept if the score reaches `threshold`. Both multinomials are gathered from every document
(partial sums before the shuffle, at most `cells` rows after it), so the model's size is fixed by `cells` while its
counts grow with the corpus. Scoring is a projection: the ratios travel as one literal of `cells` doubles.

DataFrame functions only. Defined results: a null or empty text has no words, fails the base rules and is not kept; a
document of any length is scored whole; repeated rows are judged alike; an empty table gives an empty result. Columns
besides `id_col` and `text_col` are ignored, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bind, literal_array, words

# Fixed value: the characters that n_symbols counts.
SYMBOLS = "#*$%&|<>"
CELLS = 1 << 16
THRESHOLD = -0.08
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50


def char_count(text: Column, of: str) -> Column:
    others = "[^" + "".join(f"\\x{ord(c):02x}" for c in of) + "]+"
    return F.length(F.regexp_replace(text, others, ""))


def repeated_words(ws: Column) -> Column:
    """Words that lie in 3-word windows found twice or more in the text."""

    def count(ws: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(0), F.size(ws) - 3), lambda i: F.xxhash64(F.get(ws, i), F.get(ws, i + 1), F.get(ws, i + 2)))
        return bind(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)))

    def covered(h: Column) -> Column:
        pairs = F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))
        twice = bind(F.sort_array(pairs), lambda s: F.filter(s, lambda x, j: (F.get(s, j - 1)["h"] == x["h"]) | (F.get(s, j + 1)["h"] == x["h"])))
        return F.size(F.array_distinct(F.flatten(F.transform(twice, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))

    return bind(ws, lambda ws: F.when(F.size(ws) >= 4, count(ws)).otherwise(F.lit(0))).cast("long")


def repeated_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    return bind(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def base_counts(text: Column, ws: Column) -> dict[str, Column]:
    text = F.coalesce(text, F.lit(""))
    return {
        "n_words": F.size(ws).cast("long"),
        "word_chars": F.length(F.array_join(ws, "")).cast("long"),
        "n_symbols": char_count(text, SYMBOLS).cast("long"),
        "n_dup_lines": repeated_lines(text),
        "n_repeat_words": repeated_words(ws),
    }


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < MIN_WORDS) | (n_repeat_words * 100 > n_words * MAX_REPEAT_PERCENT)


def cell(*ws: Column, cells: int) -> Column:
    return F.pmod(F.xxhash64(*ws), F.lit(cells)).cast("int")


def grams(ws: Column, cells: int) -> Column:
    """Cells of a text's unigrams and bigrams."""
    ones = F.transform(ws, lambda w: cell(w, cells=cells))
    twos = bind(ws, lambda ws: F.when(F.size(ws) > 1, F.transform(F.sequence(F.lit(1), F.size(ws) - 1), lambda i: cell(F.get(ws, i - 1), F.get(ws, i), cells=cells))).otherwise(F.array().cast("array<int>")))
    return F.concat(ones, twos)


def strict_profile(text: Column, ws: Column) -> Column:
    """The default trusted target: whole prose, few symbols or exclamation marks, little repetition."""
    text = F.coalesce(text, F.lit(""))
    n = F.size(ws)
    varied = F.size(F.array_distinct(ws)) * 4 >= F.least(n, F.lit(400))
    return (n >= MIN_WORDS) & (char_count(text, SYMBOLS + "!") * 50 <= n) & varied


def fit(docs: DataFrame, text_col: str = "text", cells: int = CELLS, trusted=strict_profile) -> list[float]:
    """log(p_trusted / p_raw) of each cell, add-one smoothed; at most `cells` rows reach the driver."""
    text = F.col(text_col)
    flagged = docs.select(F.col(text_col).alias("text"), words(text).alias("ws")).select("ws", trusted(F.col("text"), F.col("ws")).cast("long").alias("ok"))
    counted = flagged.select("ok", F.explode(grams(F.col("ws"), cells)).alias("cell")).groupBy("cell").agg(F.count("*").alias("raw"), F.sum("ok").alias("good"))
    raw, good = [0] * cells, [0] * cells
    for row in counted.collect():  # `cells` rows at most
        raw[row["cell"]], good[row["cell"]] = row["raw"], row["good"] or 0
    if not sum(good):  # no trusted document: nothing to prefer
        return [0.0] * cells
    total_good, total_raw = sum(good) + cells, sum(raw) + cells
    return [math.log((g + 1) / total_good) - math.log((r + 1) / total_raw) for g, r in zip(good, raw, strict=True)]


def score(ws: Column, ratios: list[float]) -> Column:
    """Mean log ratio over a text's n-grams; null without words."""
    cells = len(ratios)

    def total(ws: Column, table: Column) -> Column:
        one = lambda i: F.get(table, cell(F.get(ws, i), cells=cells))
        two = lambda i: F.when(i > 0, F.get(table, cell(F.get(ws, i - 1), F.get(ws, i), cells=cells))).otherwise(F.lit(0.0))
        return F.aggregate(F.sequence(F.lit(0), F.size(ws) - 1), F.lit(0.0), lambda acc, i: acc + one(i) + two(i)) / (F.size(ws) * 2 - 1)

    return bind(ws, lambda ws: bind(literal_array(ratios), lambda table: F.when(F.size(ws) > 0, total(ws, table))))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", cells: int = CELLS, threshold: float = THRESHOLD, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row a document: `doc_id`, the base counts, base_failed, llr (null without words) and kept, after columns `keep`; one of these that
    has the name of an output gives way to it."""
    ratios = fit(docs, text_col, cells)
    split = docs.select(F.struct(F.lit(0).alias("none"), *(F.col(f"`{c}`").alias(f"keep_{i}") for i, c in enumerate(keep))).alias("_keep"), F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), words(F.col(text_col)).alias("_ws"))
    counts = base_counts(F.col("_text"), F.col("_ws"))
    out = split.select("_keep", "_id", *(c.alias(f"_{k}") for k, c in counts.items()), score(F.col("_ws"), ratios).alias("_llr"))
    failed = base_failed(F.col("_n_words"), F.col("_n_repeat_words"))
    verdict = ~failed & F.coalesce(F.col("_llr") >= threshold, F.lit(False))
    own = {"doc_id": F.col("_id"), **{k: F.col(f"_{k}") for k in counts}, "base_failed": failed, "llr": F.col("_llr"), "kept": verdict}
    passed = [F.col(f"_keep.keep_{i}").alias(c) for i, c in enumerate(keep) if c not in own]
    return out.select(*passed, *(c.alias(k) for k, c in own.items()))
