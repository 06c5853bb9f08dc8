"""Mixing sources to target weights by Poisson replication.

The rows of each named source are to make up its weight of the mixture; all other rows, a null source included, share
the rest in proportion to their number. A row's rate is the mean number of copies that this takes, its count the
Poisson quantile at a uniform number made of a hash of (seed, id), so counts depend on nothing but seed, id and rate.
A rate above LIMIT is split into equal parts below it; the count is then the sum of one quantile for each part, whose number
is hashed too, which has the same distribution and leaves the table of quantiles short at any rate.
Copies leave in an order that a second hash gives, of seed, copy and the whole row: a row's copies land in unrelated partitions, sorted
by that hash, and so do rows that share an id or have none.

The mixture's mean size is `size` rows, or the input's. Source sizes come from one count over all rows, of which the named sources
and the rest reach the driver. Defined results: a null id hashes as its own value; rows that repeat an id get equal
counts; a source with weight 0 yields none; named sources without rows leave their weight unused; texts pass whole or null; an empty table gives an empty
result. Rows that are equal in all columns have equal hashes. The added columns are `copy`, from 1, and `shuffle_key`; an input column of
such a name is replaced, all others stay.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bind

# The production mixture: a hot source held down, four raised, the rest in proportion.
WEIGHTS = {"src0": 0.10, "src1": 0.08, "src2": 0.08, "src3": 0.08, "src4": 0.08}
SEED = 20240607
STEPS = 1 << 48  # of the uniform numbers
LIMIT = 64.0  # the largest rate that one quantile draws


def poisson_levels(rate: float) -> list[float]:
    """P(X <= k) for k = 0, 1 ... as far as a step of the uniform numbers can tell them from 1."""
    levels, k, total = [], 0, 0.0
    while rate > 0:
        total += math.exp(k * math.log(rate) - rate - math.lgamma(k + 1))
        if k > rate and total >= 1 - 0.25 / STEPS or k > rate + 12 * math.sqrt(rate) + 40:
            break
        levels.append(total)
        k += 1
    return levels


def uniform(seed: int, name: str, *cols: Column) -> Column:
    """A number in (0, 1) from 48 bits of an MD5."""
    text = F.concat_ws(":", F.lit(f"{name}{seed}"), *(F.coalesce(c.cast("string"), F.lit("null")) for c in cols))
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 12), 16, 10).cast("double") + 0.5) / STEPS


def rates(docs: DataFrame, source_col: str, weights: dict[str, float], size: float | None) -> tuple[dict[str, float], float]:
    """The rate of each named source, and that of all other rows."""
    named = F.when(F.col(source_col).isin(*weights), F.col(source_col)) if weights else F.lit(None).cast("string")
    found = {r["s"]: r["n"] for r in docs.groupBy(named.alias("s")).agg(F.count("*").alias("n")).collect()}  # len(weights) + 1 rows at most
    size = sum(found.values()) if size is None else size
    rest = max(0.0, 1 - sum(weights.values()))
    return {s: w * size / found[s] for s, w in weights.items() if found.get(s)}, rest * size / found[None] if found.get(None) else 0.0


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", weights: dict[str, float] | None = None, seed: int = SEED, size: float | None = None) -> DataFrame:
    """docs, each row as often as its count says, with `copy` and `shuffle_key`, dealt out by the latter."""
    weights = WEIGHTS if weights is None else weights
    by_source, other = rates(docs, source_col, weights, size)
    id_ = F.col(id_col)

    def count(rate: float) -> Column:
        parts = parts_of(rate)
        if not parts:
            return F.lit(0).cast("long")
        drawn = lambda u: F.size(F.filter(F.array(*map(F.lit, poisson_levels(rate / parts))), lambda level: level < u)).cast("long")
        first = drawn(uniform(seed, "count", id_))
        return first if parts == 1 else F.aggregate(F.sequence(F.lit(2), F.lit(parts)), first, lambda n, i: n + drawn(uniform(seed, "count", id_, i)))

    n = count(other)
    for source, rate in by_source.items():
        n = F.when(F.col(source_col) == source, count(rate)).otherwise(n)
    if weights:
        gone = [s for s in weights if s not in by_source]
        n = F.when(F.col(source_col).isin(*gone), F.lit(0)).otherwise(n) if gone else n
    rows = docs.drop("copy", "shuffle_key")
    copies = rows.select("*", F.explode(bind(n, lambda n: F.when(n > 0, F.sequence(F.lit(1).cast("long"), n)))).alias("copy"))
    keyed = copies.withColumn("shuffle_key", F.xxhash64(F.lit(seed), id_, F.col("copy"), *(F.col(f"`{c}`") for c in rows.columns if c != id_col)))
    return keyed.repartition("shuffle_key").sortWithinPartitions("shuffle_key")


def parts_of(rate: float) -> int:
    """Into how many parts a rate is split."""
    return math.ceil(rate / LIMIT)


def oracle(weights: dict[str, float] | None = None, seed: int = SEED) -> str:
    """DuckDB SQL for the rows of mix() over `documents`, without shuffle_key."""
    weights = WEIGHTS if weights is None else weights
    values = ", ".join(f"('{s}', {w!r})" for s, w in weights.items())
    return f"""
WITH RECURSIVE weights(source, w) AS (VALUES {values}),
named AS (SELECT d.*, weights.source AS g FROM documents d LEFT JOIN weights ON d.source = weights.source),
sizes AS (SELECT g, count(*) AS n FROM named GROUP BY g),
rates AS (SELECT g, coalesce(w, 1 - (SELECT sum(w) FROM weights)) * (SELECT sum(n) FROM sizes) / n AS rate FROM sizes LEFT JOIN weights ON g = source),
parts AS (SELECT g, CAST(ceil(rate / {LIMIT}) AS BIGINT) AS m, rate / greatest(ceil(rate / {LIMIT}), 1) AS rate FROM rates),
levels(g, rate, k, p) AS (
  SELECT g, rate, 0, exp(-rate) FROM parts
  UNION ALL SELECT g, rate, k + 1, p * rate / (k + 1) FROM levels WHERE k < rate + 12 * sqrt(rate) + 40),
sums AS (SELECT g, k, sum(p) OVER (PARTITION BY g ORDER BY k) AS level FROM levels),
rows AS (SELECT named.*, m, row_number() OVER () AS r FROM named JOIN parts ON named.g IS NOT DISTINCT FROM parts.g),
draws AS (SELECT r, g, doc_id, unnest(range(1, m + 1)) AS i FROM rows),
drawn AS (SELECT *, (CAST('0x' || substr(md5('count{seed}:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || CASE WHEN i > 1 THEN ':' || i ELSE '' END), 1, 12) AS BIGINT) + 0.5) / {STEPS}.0 AS u FROM draws),
summed AS (SELECT r, sum((SELECT count(*) FROM sums WHERE sums.g IS NOT DISTINCT FROM drawn.g AND level < u)) AS n FROM drawn GROUP BY r),
counted AS (SELECT doc_id, text, lang, source, n_chars, CAST(summed.n AS BIGINT) AS n FROM rows JOIN summed USING (r))
SELECT doc_id, text, lang, source, n_chars, CAST(unnest(range(1, n + 1)) AS BIGINT) AS copy FROM counted WHERE n > 0"""
