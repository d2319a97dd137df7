"""Quality rules whose cutoffs keep the share of good documents they reject below a limit: DataFrame functions only.

Every rule rejects texts with a rate above its cutoff. Documents labelled good are the holdout. For each stratum and rule
the cutoffs are tried from the mildest on; one passes if the exact binomial probability of so few rejected good documents,
were the true share at the limit, is at most the error divided by the number of strata and rules (Bonferroni). Trying
them in a fixed order and ending at the first failure needs no further correction. The limit of a rule is the limit of
all divided by their number, so together they reject at most max_rejected of the good documents of each stratum, with
probability 1 - error. A stratum with too few labels for any cutoff keeps all that the base keeps.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import whole_text, written

_SPACE = " \t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"
# Each rule's cutoffs, the mildest first.
CUTOFFS: dict[str, list[float]] = {
    "symbol_rate": [0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.12, 0.1, 0.08, 0.06, 0.04],
    "dup_line_rate": [0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2, 0.1],
    "repeat_rate": [0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2, 0.15],
    "upper_rate": [0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2],
    "mean_word": [20.0, 16.0, 14.0, 12.0, 11.0, 10.0, 9.0],
}


def measured(docs: DataFrame, keep: list[Column]) -> DataFrame:
    """The columns to keep, the base measures of every text, and the rules' rates (null where nothing is to divide by)."""
    gap = f"[{chr(92)}x20{chr(92)}x09-{chr(92)}x0D]+"
    d = docs.select(*keep, whole_text().alias("__t"))
    d = d.withColumn("__w", F.array_remove(F.split("__t", gap), ""))
    lines = F.filter(F.split("__t", "\n", -1), lambda x: F.length(F.translate(x, _SPACE, "")) > 0)
    d = d.withColumn("__l", lines)
    windows = F.expr("CASE WHEN size(__w) >= 3 THEN transform(sequence(0, size(__w) - 3), i -> xxhash64(__w[i], __w[i + 1], __w[i + 2])) ELSE cast(array() AS array<bigint>) END")
    d = d.withColumn("__h", windows)
    d = d.withColumn("__many", F.expr("size(array_distinct(__h)) < size(__h)"))
    d = d.withColumn("__s", F.expr("CASE WHEN __many THEN sort_array(transform(__h, (h, i) -> struct(h, i))) END"))
    # windows beside an equal one in hash order are found twice or more; their words are counted once each
    d = d.withColumn("__r", F.expr("CASE WHEN __many THEN filter(__s, (x, k) -> coalesce(x.h = get(__s, k - 1).h, false) OR coalesce(x.h = get(__s, k + 1).h, false)) END"))
    n_repeat = F.expr("CASE WHEN __many THEN size(array_distinct(flatten(transform(__r, x -> array(x.i, x.i + 1, x.i + 2))))) ELSE 0 END")
    kept = [c for c in d.columns if not c.startswith("__")]
    d = d.select(
        *kept,
        F.size("__w").cast("long").alias("n_words"),
        F.length(F.translate("__t", _SPACE, "")).cast("long").alias("word_chars"),
        (F.length("__t") - F.length(F.translate("__t", _SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
        n_repeat.cast("long").alias("n_repeat_words"),
        F.size("__l").cast("long").alias("n_lines"),
        F.length(F.regexp_replace("__t", r"\P{Lu}+", "")).cast("long").alias("n_upper"),
    )
    over = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    return d.select(
        "*",
        ((F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))).alias("base_failed"),
        over("n_symbols", "word_chars").alias("symbol_rate"),
        over("n_dup_lines", "n_lines").alias("dup_line_rate"),
        over("n_repeat_words", "n_words").alias("repeat_rate"),
        over("n_upper", "word_chars").alias("upper_rate"),
        over("word_chars", "n_words").alias("mean_word"),
    )


def _log_factorial(n: Column) -> Column:
    """ln n!: exact values below 16, Stirling's series above, whose error there is under 1e-12."""
    small = F.array(*[F.lit(math.lgamma(i + 1)) for i in range(16)])
    x = F.greatest(n, F.lit(1)).cast("double")
    series = x * F.log(x) - x + 0.5 * F.log(2 * math.pi * x) + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5)
    return F.when(n < 16, F.get(small, F.least(n, F.lit(15)).cast("int"))).otherwise(series)


def binomial_cdf(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) of n trials with probability p, for any n: the incomplete beta function I(1 - p; n - k, k + 1).

    Its continued fraction needs about the square root of n steps below the mean; above it the other tail is taken from 1.
    Below 10^9 trials the result is right to about a millionth of itself: the logarithms of the factorials cancel so far.
    """
    a, b, x = (n - k).cast("double"), (k + 1).cast("double"), 1 - p
    near = F.coalesce(F.lit(x) < (a + 1) / (a + b + 2), F.lit(True))
    front = lambda a, b, x: F.exp(_log_factorial(n) - _log_factorial((a - 1).cast("long")) - _log_factorial((b - 1).cast("long")) + a * F.log(x) + b * F.log(1 - x)) / a
    steps = F.sequence(F.lit(1), F.lit(100) + F.ceil(2 * F.sqrt(n.cast("double"))).cast("int"))
    tiny = 1e-300

    def away(v: Column) -> Column:
        return F.when(F.abs(v) < tiny, tiny).otherwise(v)

    def fraction(a: Column, b: Column, x: Column) -> Column:
        d = 1 / away(1 - (a + b) * x / (a + 1))
        start = F.struct(F.lit(1.0).alias("c"), d.alias("d"), d.alias("h"))

        def two(s: Column, m: Column) -> Column:
            even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
            d = 1 / away(1 + even * s["d"])
            c = away(1 + even / s["c"])
            odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
            d2 = 1 / away(1 + odd * d)
            c2 = away(1 + odd / c)
            return F.struct(c2.alias("c"), d2.alias("d"), (s["h"] * d * c * d2 * c2).alias("h"))

        return F.aggregate(steps, start, two, lambda s: s["h"])

    # one fraction is worked out, with the sides changed where that converges
    u, v, y = F.when(near, a).otherwise(b), F.when(near, b).otherwise(a), F.when(near, x).otherwise(p)
    tail = front(u, v, y) * fraction(u, v, y)
    return F.when(k >= n, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(near, tail).otherwise(1 - tail))))


def cutoffs(good: DataFrame, stratum: str = "stratum", max_rejected: float = 0.02, error: float = 0.05, rules: dict[str, list[float]] | None = None) -> DataFrame:
    """(stratum, rule, cutoff): the lowest cutoff that is safe, from the rates of documents labelled good."""
    rules = rules or CUTOFFS
    share = max_rejected / len(rules)
    # how many of a rule's cutoffs a document's rate is above, in the mildest-first order: it is rejected by the rest
    above = lambda r: F.aggregate(F.array(*[F.lit(float(c)) for c in rules[r]]), F.lit(0), lambda n, c: n + F.when(F.col(r) > c, 1).otherwise(0))
    each = good.select(stratum, F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), above(r).alias("above")) for r in rules])).alias("x"))
    # a row for each stratum, rule and number of cutoffs
    counts = each.groupBy(stratum, "x.rule", "x.above").count()
    totals = counts.groupBy(stratum, "rule").agg(F.sum("count").alias("n"))
    grid = F.explode(F.map_from_arrays(F.array(*map(F.lit, rules)), F.array(*[F.array(*[F.struct(F.lit(i + 1).alias("i"), F.lit(float(c)).alias("cutoff")) for i, c in enumerate(v)]) for v in rules.values()]))[F.col("rule")])
    tried = totals.select(stratum, "rule", "n", grid.alias("g")).select(stratum, "rule", "n", "g.i", "g.cutoff")
    # the i-th mildest cutoff rejects those above it; a rate above m cutoffs is above the last m of a list that falls
    sizes = F.map_from_arrays(F.array(*map(F.lit, rules)), F.array(*[F.lit(len(v)) for v in rules.values()]))
    hit = counts.select(F.col(stratum).alias("__s"), F.col("rule").alias("__r"), (sizes[F.col("rule")] - F.col("above") + 1).alias("from"), "count")
    k = tried.join(hit, F.col(stratum).eqNullSafe(F.col("__s")) & (F.col("rule") == F.col("__r")) & (F.col("i") >= F.col("from")), "left")
    k = k.groupBy(stratum, "rule", "n", "i", "cutoff").agg(F.coalesce(F.sum("count"), F.lit(0)).alias("k"))
    tests = F.count("*").over(Window.partitionBy(F.lit(1)))
    level = totals.select(stratum, "rule", tests.alias("tests"))
    k = k.join(level.select(F.col(stratum).alias("__s"), F.col("rule").alias("__r"), "tests"), F.col(stratum).eqNullSafe(F.col("__s")) & (F.col("rule") == F.col("__r")))
    safe = k.withColumn("safe", binomial_cdf(F.col("k"), F.col("n"), share) <= error / F.col("tests"))
    in_order = Window.partitionBy(stratum, "rule").orderBy("i")
    return safe.withColumn("so_far", F.min("safe").over(in_order)).where("so_far").groupBy(stratum, "rule").agg(F.min("cutoff").alias("cutoff"))


def judge(docs: DataFrame, labels: DataFrame, stratum: str = "lang", max_rejected: float = 0.02, error: float = 0.05) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept) for every row of docs.

    labels has (doc_id, quality); a document is good if any of its labels is 1. Null and empty texts have no words and
    fail the base. A null stratum is one of its own. Repeated rows are judged alike; other columns are ignored.
    """
    rules = list(CUTOFFS)
    m = written(measured(docs, [F.col("doc_id"), F.col(stratum).cast("string").alias("stratum")]), "quality-measures")
    good = labels.groupBy("doc_id").agg(F.max("quality").alias("quality")).where("quality = 1").select("doc_id")
    held = m.where(~F.col("base_failed")).join(good, "doc_id", "left_semi")
    limits = cutoffs(held, "stratum", max_rejected, error).groupBy("stratum").pivot("rule", rules).agg(F.first("cutoff"))
    limits = limits.select(F.col("stratum").alias("__s"), *[F.col(r).alias(f"__{r}") for r in rules])
    # a row for each stratum; Spark broadcasts it while it is small
    j = m.join(limits, F.col("stratum").eqNullSafe(F.col("__s")), "left")
    rejected = F.lit(False)
    for r in rules:
        rejected = rejected | F.coalesce(F.col(r) > F.col(f"__{r}"), F.lit(False))
    return j.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~rejected).alias("kept"))
