"""Checks of tables: columns, counts, losses, invariants, dates, matches between sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

C = F.col


def content_hash(df: DataFrame) -> DataFrame:
    """(rows, hash): equal for equal tables, whatever their order or partitioning."""
    return df.agg(F.count("*").alias("rows"), F.bit_xor(F.xxhash64(*sorted(df.columns))).alias("hash"))


def profile_table(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, rows, nulls, blanks, dashes, numbers, most_digits, longest, patterns) of text columns, in one pass."""

    def one(c: str) -> Column:
        x = C(c).cast("string")
        t = F.trim(x)
        shape = F.regexp_replace(F.regexp_replace(x, "[0-9]+", "9"), r"\p{L}+", "a")
        return F.struct(
            F.lit(c).alias("column"), F.count("*").alias("rows"), F.count_if(x.isNull()).alias("nulls"), F.count_if(t == "").alias("blanks"), F.count_if(t == "-").alias("dashes"),
            F.count(F.regexp_replace(t, ",", "").try_cast("double")).alias("numbers"), F.max(F.length(F.regexp_replace(x, "[^0-9]", ""))).alias("most_digits"), F.max(F.length(x)).alias("longest"),
            F.approx_count_distinct(shape).alias("patterns"),
        )

    return df.agg(F.array(*[one(c) for c in columns]).alias("a")).select(F.inline("a"))


def cross_survey(left: DataFrame, right: DataFrame, on: list[str], columns: list[str], tolerance: float = 1e-9) -> DataFrame:
    """(column, both, left_only, right_only, equal) of the same facts in two sources."""
    r = right.select(*on, *[C(c).alias(f"__{c}") for c in columns])
    j = left.select(*on, *columns).join(r, on, "full_outer")

    def one(c: str) -> Column:
        a, b = C(c), C(f"__{c}")
        same = F.abs(a - b) <= tolerance * F.greatest(F.abs(a), F.abs(b))
        return F.struct(F.lit(c).alias("column"), F.count_if(a.isNotNull() & b.isNotNull()).alias("both"), F.count_if(a.isNotNull() & b.isNull()).alias("left_only"), F.count_if(a.isNull() & b.isNotNull()).alias("right_only"), F.count_if(same).alias("equal"))

    return j.agg(F.array(*[one(c) for c in columns]).alias("a")).select(F.inline("a"))


def check_columns(df: DataFrame, declared: dict[str, str]) -> list[str]:
    """Columns that are missing, undeclared or of another type."""
    there = dict(df.dtypes)
    out = [f"missing {c}" for c in declared if c not in there] + [f"undeclared {c}" for c in there if c not in declared]
    return out + [f"type of {c}: {there[c]}" for c in declared if c in there and there[c] != declared[c]]


def check_rows(n_in: int, n_out: int, n_dedup: int, n_reject: int, fan_out: int = 1) -> bool:
    """out = in x fan-out - duplicates - rejects."""
    return n_out == n_in * fan_out - n_dedup - n_reject


def check_invariants(df: DataFrame, rules: dict[str, str]) -> DataFrame:
    """(rule, violations): rows for which a predicate is false."""
    one = lambda n, p: F.struct(F.lit(n).alias("rule"), F.count_if(~F.coalesce(F.expr(p), F.lit(True))).alias("violations"))
    return df.agg(F.array(*[one(n, p) for n, p in rules.items()]).alias("a")).select(F.inline("a"))


def duplicate_keys(df: DataFrame, key: list[str]) -> DataFrame:
    return df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def check_golden(df: DataFrame, cells: DataFrame, key: list[str], value: str) -> DataFrame:
    """Each golden cell with whether the table has it."""
    return cells.join(df.select(*key, C(value).alias("__v")), key, "left").withColumn("ok", C(value).eqNullSafe(C("__v"))).drop("__v")


def check_pit(df: DataFrame, content: str, available: str, snapshot) -> DataFrame:
    """Counts of rows without an available date, with one before their content or after the snapshot."""
    return df.agg(F.count_if(C(available).isNull()).alias("no_date"), F.count_if(C(available) < C(content)).alias("before_content"), F.count_if(C(available) > F.lit(snapshot)).alias("after_snapshot"))


def recent_completeness(df: DataFrame, by: str, n: int, share: float) -> DataFrame:
    """The newest n sessions with their rows against the mean of the ones before, and whether they have enough."""
    g = df.groupBy(by).agg(F.count("*").alias("rows")).withColumn("__r", F.row_number().over(Window.orderBy(F.desc(by))))
    usual = g.where(C("__r") > n).agg(F.avg("rows").alias("usual"))
    return g.where(C("__r") <= n).join(F.broadcast(usual)).select(by, "rows", "usual", (C("rows") >= share * C("usual")).alias("ok"))


def window_verdict(days: DataFrame, day: str, ok: str, need: int) -> DataFrame:
    """(day, run, passed): passing days in a row up to each day, and whether they are enough."""
    w = Window.orderBy(day)  # a row a day
    d = days.withColumn("__g", F.sum(F.when(C(ok), 0).otherwise(1)).over(w))
    run = F.when(C(ok), F.count("*").over(Window.partitionBy("__g").orderBy(day)) - F.when(C("__g") == 0, 0).otherwise(1)).otherwise(0)
    return d.select(day, run.alias("run"), (run >= need).alias("passed"))


def freshness(df: DataFrame, by: list[str], idx: str, seen: str, fresh: int, grace: int) -> DataFrame:
    """fresh, grace, lapsed or none by the sessions since a security's last estimate."""
    w = Window.partitionBy(*by).orderBy(idx).rowsBetween(Window.unboundedPreceding, 0)
    age = C(idx) - F.max(F.when(C(seen), C(idx))).over(w)
    return df.withColumn("age", age).withColumn("state", F.when(C("age").isNull(), "none").when(C("age") <= fresh, "fresh").when(C("age") <= grace, "grace").otherwise("lapsed"))
