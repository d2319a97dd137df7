"""Verdicts on URLs by host and path rules, and by a list of canonical URLs behind a blocked Bloom filter: DataFrame functions only.

The list's Bloom filter is a table: a row is a block of 512 bits in eight words, and a URL's hash names its block and one
bit in each word. Its size is bounded by MAX_BLOCKS whatever the length of the list, so it is always broadcast; a longer
list only makes it pass more URLs on. URLs that the filter passes meet the list itself by an exact hash join, in as many
salts as a URL's rows have; all others are known not to be listed and are never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import Scratch

#: Bits of the filter for a listed URL, and blocks of 64 bytes at most (32 MB).
BITS_PER_URL, MAX_BLOCKS = 16, 1 << 19
SALTS = 32
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Parameters that name where a visitor came from, not a page.
TRACKING = r"^(utm_[^=]*|ref|fbclid|gclid)(=|$)"


def host_of(url: Column) -> Column:
    """What stands between the first :// and the next / ? # or the end, A-Z lower-cased; empty where there is none."""
    return F.coalesce(F.translate(F.regexp_extract(url, "://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ? or # or the end."""
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """host/path?query of a page under any of its addresses; empty for a null or one without ://.

    Scheme, fragment, a leading www., the ports 80 and 443, slashes at the end and parameters of TRACKING go; what is
    left of the query is sorted.
    """
    host = F.regexp_replace(F.regexp_replace(host_of(url), r"^www\.", ""), ":(80|443)$", "")
    path = F.regexp_replace(path_of(url), "/+$", "")
    query = F.regexp_extract(url, r"://[^?#]*\?([^#]*)", 1)
    parts = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    return F.coalesce(F.concat(host, path, F.when(F.size(parts) > 0, F.concat(F.lit("?"), F.array_join(parts, "&"))).otherwise("")), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest of rules (verdict, host, path) that fits; nulls where none does.

    A rule fits its host and all hosts under it, where the path starts with the rule's. Of equally long ones the first
    in order of its text wins. rules is a short list that becomes one expression.
    """
    rule = verdict = F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]), reverse=True):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def _bits(key: Column) -> list[Column]:
    """A word with one bit set for each of the block's eight words."""
    h = F.xxhash64(key, F.lit(1))
    return [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63)).cast("int")) for i in range(8)]


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def bloom_filter(keys: DataFrame, blocks: int) -> DataFrame:
    """(block, w0 .. w7): the filter of the column key, a row for each block that has a bit."""
    words = [b.alias(f"w{i}") for i, b in enumerate(_bits(F.col("key")))]
    each = keys.select(_block(F.col("key"), blocks).alias("block"), *words)
    return each.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(8)])


def blocks_for(n: int) -> int:
    """Blocks of a filter for n keys."""
    return max(1, min(MAX_BLOCKS, -(-n * BITS_PER_URL // 512)))


def passed(rows: DataFrame, bloom: DataFrame, blocks: int) -> DataFrame:
    """rows (with a column key) and maybe: false only where the key isn't in the filter."""
    b = bloom.select(F.col("block").alias("__block"), *[F.col(f"w{i}").alias(f"__w{i}") for i in range(8)])
    j = rows.withColumn("__block", _block(F.col("key"), blocks)).join(F.broadcast(b), "__block", "left")
    hit = F.lit(True)
    for i, bit in enumerate(_bits(F.col("key"))):
        hit = hit & (F.col(f"__w{i}").bitwiseAND(bit) != 0)
    return j.withColumn("maybe", F.coalesce(hit, F.lit(False))).drop("__block", *[f"__w{i}" for i in range(8)])


def judge(pages: DataFrame, listed: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """(page_id, host, path, rule, verdict, canonical) for every row of pages.

    listed has a column url; a page whose canonical form is that of a listed URL is blocked, any other allowed, unless a
    rule decides. Null and malformed URLs have empty parts and an empty canonical form, which is never listed. Repeated
    rows are judged alike; an empty list allows all. Other columns are ignored.
    """
    scratch = Scratch(pages.sparkSession)
    keys = listed.select(canonical(F.col("url")).alias("key")).where("key <> ''").distinct()
    keys = scratch.written(keys, "listed-urls")
    blocks = blocks_for(keys.count())
    bloom = bloom_filter(keys, blocks)
    d = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), canonical(F.col("url")).alias("key"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    d = d.withColumn("rule", rule).withColumn("verdict", verdict)
    probed = passed(d, bloom, blocks).withColumn("maybe", F.col("maybe") & F.col("rule").isNull())
    out = ["page_id", "host", "path", "rule", "verdict", F.col("key").alias("canonical")]
    clear = probed.where("NOT maybe").withColumn("verdict", F.coalesce("verdict", F.lit("allow"))).select(out)
    candidates = probed.where("maybe").withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int"))
    salts = candidates.groupBy("key").agg(F.bit_or(F.expr("shiftleft(1L, salt)")).alias("mask")).join(keys, "key", "left_semi")
    on_list = salts.select("key", F.explode(F.expr(f"filter(sequence(0, {SALTS - 1}), b -> (shiftright(mask, b) & 1L) = 1L)")).alias("salt"), F.lit("block").alias("found"))
    checked = candidates.join(on_list, ["key", "salt"], "left").withColumn("verdict", F.coalesce("found", F.lit("allow"))).select(out)
    return clear.unionByName(checked)


def junk_pages(pages: DataFrame, share: float = 0.05) -> DataFrame:
    """(url): addresses of pages whose title consists of symbols `#*$%|` to more than that share."""
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    symbols = F.length(title) - F.length(F.translate(title, "#*$%|", ""))
    return pages.where(symbols > share * F.length(title)).select("url")
