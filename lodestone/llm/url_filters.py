"""URL filters: host and path rules, then two character language models.

Rules come first: the longest fitting one decides. Every other URL is judged by the ratio of two smoothed variable-order
Markov models, one of accepted and one of rejected URLs, per character. The rules are all that says which is which: the
URLs that one allows are the accepted class, those that one blocks the rejected class, and URLs without a rule train
nothing (callers may name more of either class by predicates). Contexts of 0 to `order` characters back off into each other in
proportion to how often the longer one was seen. Counts are hashed into `cells` cells, so the model is bounded while it gathers
from every row, and scoring is a projection.

A share of 1 / `held` of the hosts, by hash, trains nothing: the cut-off is calibrated on the decided URLs of these hosts alone. A
histogram of `bins` bins of their scores gives the point that separates the two classes best; where they lack a class, it is 0.

DataFrame functions only. Defined results: a null url, or one without `://`, has empty host and path, no rule, and is
allowed, having nothing against it; so is any URL while either class has no training row. A rule's path begins with `/`, so a URL
that ends with its host (`http://a.org`) fits none. Equal URLs get equal verdicts; URLs of any length are scored whole; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bind, literal_array

# The rules, as (verdict, host and path).
RULES = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)
CELLS = 1 << 15
ORDER = 4
PRIOR = 2.0
HELD = 4  # one host in so many calibrates the cut-off and trains nothing
BINS = 2000
SPAN = 5.0  # scores beyond +-SPAN share the outer bins
A_Z, a_z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = "(?s)^.*?://([^/?#]*)([^?#]*)"


def host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, PARTS, 1), F.lit("")), A_Z, a_z)


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, its verdict), null where none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, text in sorted(rules, key=lambda r: len(r[1])):  # the longest is tested last and so wins
        own, _, rest = text.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith("/" + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def model_text(host: Column, path: Column, order: int) -> Column:
    """What the models read: `order` start marks, host and path, numbers as 0, an end mark."""
    return F.concat(F.lit("^" * order), F.regexp_replace(F.concat(host, F.lower(path)), "[0-9]+", "0"), F.lit("$"))


def keys(text: Column, i: Column, k: int, order: int, cells: int) -> tuple[Column, Column]:
    """Cells of the k characters before position i (from 0) of the scored part, and of them with its character."""
    at = i + 1 + order - k
    key = lambda kind, s: F.pmod(F.xxhash64(F.lit(f"{kind}{k}"), s), F.lit(cells)).cast("int")
    return key("c", F.substr(text, at, F.lit(k))), key("g", F.substr(text, at, F.lit(k + 1)))


def positions(text: Column, order: int) -> Column:
    return F.sequence(F.lit(0), F.length(text) - order - 1)


def counts(rows: DataFrame, order: int, cells: int) -> tuple[list[int], list[int]]:
    """Cell counts of accepted and rejected rows of (text, good); at most `cells` rows reach the driver."""

    def all_keys(text: Column) -> Column:
        each = lambda i: F.array(*(x for k in range(order + 1) for x in keys(text, i, k, order, cells)))
        return F.flatten(F.transform(positions(text, order), each))

    found = rows.select("good", F.explode(all_keys(F.col("text"))).alias("cell")).groupBy("cell").agg(F.sum(F.col("good").cast("long")).alias("a"), F.sum((~F.col("good")).cast("long")).alias("r"))
    accepted, rejected = [0] * cells, [0] * cells
    for row in found.collect():  # `cells` rows at most
        accepted[row["cell"]], rejected[row["cell"]] = row["a"], row["r"]
    return accepted, rejected


def ratio(text: Column, accepted: list[int], rejected: list[int], order: int) -> Column:
    """Mean over the characters of ln p_accepted - ln p_rejected."""
    cells = len(accepted)

    def log_p(tables: list[Column], text: Column, i: Column) -> Column:
        sides = [F.lit(1 / 256), F.lit(1 / 256)]
        for k in range(order + 1):
            context, gram = keys(text, i, k, order, cells)
            sides = [(F.get(t, gram) + p * PRIOR) / (F.greatest(F.get(t, context), F.get(t, gram)) + PRIOR) for t, p in zip(tables, sides, strict=True)]
        return F.ln(sides[0]) - F.ln(sides[1])

    def total(tables: list[Column]) -> Column:
        return F.aggregate(positions(text, order), F.lit(0.0), lambda acc, i: acc + log_p(tables, text, i))

    # Bound, each table stands in the plan once.
    return bind(literal_array(accepted), lambda a: bind(literal_array(rejected), lambda r: total([a, r]))) / (F.length(text) - order)


def cut_off(scored: DataFrame) -> float:
    """The score that best separates the rows of (score, good); 0 where a class is missing."""
    bin_of = F.least(F.greatest(F.floor((F.col("score") + SPAN) * (BINS / (2 * SPAN))), F.lit(0)), F.lit(BINS - 1))
    tally = lambda hit: F.sum(hit.cast("long"))
    rows = scored.groupBy(bin_of.alias("bin")).agg(tally(F.col("good")).alias("a"), tally(~F.col("good")).alias("r")).collect()  # BINS rows at most
    found = {row["bin"]: (row["a"], row["r"]) for row in rows}
    good, bad = sum(a for a, _ in found.values()), sum(r for _, r in found.values())
    if not good or not bad:
        return 0.0
    best, low, high, a, r = -1.0, 0, 0, 0, 0
    for b in range(BINS):  # rows under bin b + 1 are blocked
        a, r = a + found.get(b, (0, 0))[0], r + found.get(b, (0, 0))[1]
        gain = r / bad - a / good
        if gain > best + 1e-12:
            best, low = gain, b
        if gain > best - 1e-12:
            high = b
    return ((low + high) / 2 + 1) * (2 * SPAN / BINS) - SPAN


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, accepted: Column | None = None, rejected: Column | None = None, order: int = ORDER, cells: int = CELLS, held: int = HELD) -> DataFrame:
    """One row a page: page_id, host, path, rule, verdict, score (null where a rule decides or the url is no URL). accepted, rejected:
    predicates over host and path that name training rows among the URLs without a rule."""
    split = pages.select(F.col(id_col).alias("page_id"), host(F.col(url_col)).alias("host"), path(F.col(url_col)).alias("path"))
    rule, says = rule_for(F.col("host"), F.col("path"), rules)
    judged = split.select("page_id", "host", "path", rule.alias("rule"), says.alias("says"), model_text(F.col("host"), F.col("path"), order).alias("text"))
    no = F.lit(False)
    good = F.when(F.col("says").isNotNull(), F.col("says") == "allow").when(no if rejected is None else rejected, no).when(no if accepted is None else accepted, F.lit(True))
    rows = judged.filter("host != ''").select("text", good.alias("good"), (F.pmod(F.xxhash64("host"), F.lit(held)) == 0).alias("held")).filter("good is not null")
    tables = counts(rows.filter("NOT held"), order, cells)
    verdict, score = F.coalesce(F.col("says"), F.lit("allow")), F.lit(None).cast("double")
    if all(map(any, tables)):
        level = cut_off(rows.filter("held").select("good", ratio(F.col("text"), *tables, order).alias("score")))
        judged = judged.withColumn("score", F.when(F.col("says").isNull() & (F.col("host") != ""), ratio(F.col("text"), *tables, order)))
        verdict, score = F.when(F.col("says").isNotNull(), F.col("says")).when(F.col("score") < level, F.lit("block")).otherwise(F.lit("allow")), F.col("score")
    return judged.select("page_id", "host", "path", "rule", verdict.alias("verdict"), score.alias("score"))
