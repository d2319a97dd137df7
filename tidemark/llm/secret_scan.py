"""Secrets in texts, and how many owners share each: DataFrame functions only.

Every text is matched against the base patterns and against further shapes of credentials. The matched values' hashes are
counted over the whole corpus by distinct owners, repositories and texts. A value in different texts of several
repositories and owners is a widely copied example, and so is one that a single owner has in very many texts; any other
that doesn't look like a placeholder looks live, however often one text was copied. Base matches are always reported; the
further ones only if they look live.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import bucket_of, whole_text, written

# The base kinds in their order, each with its pattern, the group that is the value, and the least
# characters of that group. Runs of fewer characters than asked for are left out by the pattern where that is the same.
BASE = [
    ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 8),
    ("access", r"AKIA[A-Z0-9]{12,}", 0, 16),
    ("hex", r"[0-9a-f]{32,}", 0, 32),
]
# Further shapes of credentials.
MORE = [
    (
        "owned",
        r"gh[pousr]_[A-Za-z0-9]{36}|xox[baprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,}|AIza[0-9A-Za-z_-]{35}"
        r"|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}|://[A-Za-z0-9._%+-]{1,64}:[^\x00-\x20/:@]{6,128}@",
        0,
        16,
    ),
]
PLACEHOLDER = r"(?i)example|sample|dummy|changeme|placeholder|xxxx|1234567|(.)\1{7}"
_SPAN = "struct<s:int,ord:int,e:int,kind:string,value:string,base:boolean>"
#: Entries of an array that are worked on at once.
_BLOCK = 256
#: A value is widely copied if so many different texts hold it, in so many repositories of so many owners ...
COPIED = (3, 3, 2)
#: ... or, of one owner, if so many different texts in so many repositories hold it.
COPIED_BY_ONE = (100, 3)
#: Parts that the holders of one value are dealt to when its verdict returns to them.
SALTS = 64


def default_repository() -> Column:
    """Where no repository is named: one source's documents of one language, in 64 parts by doc_id."""
    return F.concat_ws("/", "source", "lang", bucket_of("doc_id", 64))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once: what a lambda takes from outside is computed again in each of its turns."""
    return F.transform(F.array(value), use)[0]


def _running(values: Column, kind: str) -> Column:
    """What stands before each entry: the sum of those before it, or the greatest of them and 0.

    Entries are taken in blocks, so that no step copies more than a block or the list of blocks: appending to one array
    would cost the square of its length.
    """
    step = (lambda x, y: x + y) if kind == "sum" else (lambda x, y: F.greatest(x, y))

    def scanned(array: Column, start: Column) -> Column:
        zero = F.struct(start.alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(array, zero, lambda acc, x: F.struct(step(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])

    def whole(v: Column) -> Column:
        places = F.when(F.size(v) > 0, F.sequence(F.lit(1), F.size(v), F.lit(_BLOCK))).otherwise(F.array().cast("array<int>"))
        return _let(F.transform(places, lambda i: F.slice(v, i, _BLOCK)), lambda blocks: F.flatten(F.zip_with(blocks, scanned(F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), step)), F.lit(0)), scanned)))

    return _let(values, whole)


def _spans(text: Column, ord_: int, kind: str, pattern: str, group: int, least: int, base: bool) -> Column:
    """Leftmost non-overlapping matches with their places in code points, in order."""

    def span(x: Column) -> Column:
        start = x["before"] + F.length(x["gap"])
        value = F.regexp_extract(x["m"], pattern, group) if group else x["m"]
        return F.struct(start.alias("s"), F.lit(ord_).alias("ord"), (start + F.length(x["m"])).alias("e"), F.lit(kind).alias("kind"), value.alias("value"), F.lit(base).alias("base"))

    def placed(pairs: Column) -> Column:
        before = _running(F.transform(pairs, lambda p: F.length(p["m"]) + F.length(p["gap"])), "sum")
        return F.transform(F.zip_with(pairs, before, lambda p, at: F.struct(p["m"].alias("m"), p["gap"].alias("gap"), at.alias("before"))), span)

    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    # what stands between the matches gives their places; a text without a match is not split
    pairs = _let(matches, lambda found: F.zip_with(found, F.slice(F.split(text, pattern, -1), 1, F.size(found)), lambda m, g: F.struct(m.alias("m"), g.alias("gap"))))
    none = F.array().cast(f"array<{_SPAN}>")
    return F.when(text.rlike(pattern), F.filter(_let(pairs, placed), lambda x: F.length(x["value"]) >= least)).otherwise(none)


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(F.sort_array(spans), lambda x: F.concat_ws(":", x["kind"], x["s"], x["e"])), ",")


def _looks_live(value: Column) -> Column:
    return ~value.rlike(PLACEHOLDER) & (F.size(F.array_distinct(F.split(value, ""))) >= 8)


def scan(docs: DataFrame, owner: Column, repository: Column, row: Column | None = None) -> DataFrame:
    """(row, doc_id, owner, repository, digest, base, more): all matches of every text, written.

    row numbers the rows unless it is given.
    """
    d = docs.select((F.monotonically_increasing_id() if row is None else row).alias("row"), F.col("doc_id"), owner.cast("string").alias("owner"), repository.cast("string").alias("repository"), whole_text().alias("text"))
    base = [_spans(F.col("text"), i, *k, True).alias(f"b{i}") for i, k in enumerate(BASE)]
    more = [_spans(F.col("text"), len(BASE) + i, *k, False).alias(f"m{i}") for i, k in enumerate(MORE)]
    d = d.select("row", "doc_id", "owner", "repository", F.xxhash64("text").alias("digest"), *base, *more)
    d = d.select("row", "doc_id", "owner", "repository", "digest", F.concat(*[f"b{i}" for i in range(len(BASE))]).alias("base"), F.concat(*[f"m{i}" for i in range(len(MORE))]).alias("more"))
    return written(d, "secret-candidates")


def ownership(candidates: DataFrame) -> DataFrame:
    """(hash, owners, repositories, texts, salts) of each value, from (hash, owner, repository, digest, salt).

    Rows without an owner or repository count as one unknown each; texts of one digest count once.
    """
    unknown = F.lit("\x00")
    named = candidates.select("hash", F.coalesce("owner", unknown).alias("owner"), F.coalesce("repository", unknown).alias("repository"), "digest", "salt")
    # a row for each value in each repository, by each salt first: no group of a common value is met whole
    each = named.groupBy("hash", "owner", "repository", "digest").agg(F.bit_or(F.expr("shiftleft(1L, salt)")).alias("salts"))
    repositories = each.groupBy("hash", "owner", "repository").agg(F.bit_or("salts").alias("salts"))
    texts = each.select("hash", "digest").distinct().groupBy("hash").agg(F.count("*").alias("texts"))
    owners = repositories.groupBy("hash", "owner").agg(F.count("*").alias("repositories"), F.bit_or("salts").alias("salts"))
    counts = owners.groupBy("hash").agg(F.count("*").alias("owners"), F.sum("repositories").alias("repositories"), F.bit_or("salts").alias("salts"))
    return counts.join(texts, "hash").withColumn("salts", F.expr(f"filter(sequence(0, {SALTS - 1}), b -> (shiftright(salts, b) & 1L) = 1L)"))


def widely_copied() -> Column:
    """Whether a value with these owners, repositories and texts is an example that goes round."""
    texts, repositories, owners = COPIED
    return F.expr(f"(texts >= {texts} AND repositories >= {repositories} AND owners >= {owners}) OR (texts >= {COPIED_BY_ONE[0]} AND repositories >= {COPIED_BY_ONE[1]})")


def judged(found: DataFrame) -> DataFrame:
    """(row, spans, n_live, n_example): the spans of each row with candidates, after the corpus-wide count."""
    each = found.where("size(base) + size(more) > 0").select("row", "owner", "repository", "digest", F.explode(F.concat("base", "more")).alias("x"))
    each = each.select("row", "owner", "repository", "digest", "x.s", "x.ord", "x.e", "x.kind", "x.base", F.sha2("x.value", 256).alias("hash"), _looks_live(F.col("x.value")).alias("looks"), F.pmod("row", F.lit(SALTS)).cast("int").alias("salt"))
    verdict = ownership(each).select("hash", F.explode("salts").alias("salt"), widely_copied().alias("copied"))
    told = each.join(verdict, ["hash", "salt"]).withColumn("live", F.col("looks") & ~F.col("copied"))
    # a row for each text with matches: what it collects is bounded by that text
    return told.groupBy("row").agg(
        F.collect_list(F.when(F.col("base") | F.col("live"), F.struct("s", "ord", "e", "kind"))).alias("spans"),
        F.count_if("live").alias("n_live"),
        F.count_if("copied").alias("n_example"),
    )


def find(docs: DataFrame, owner: Column | None = None, repository: Column | None = None) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_example) for every row.

    Null and empty texts have no span: counts 0, the digest of nothing and an empty list. The default owner is source,
    the default repository default_repository(); rows without one count as one unknown owner. Repeated rows are reported each. Other
    columns are ignored.
    """
    found = scan(docs, F.col("source") if owner is None else owner, default_repository() if repository is None else repository)
    of = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    counts = [of(k) for k, *_ in BASE]
    base = F.sha2(_joined(F.col("base")), 256).alias("base_sha256")
    rows = found.select("row", "doc_id", *counts, base)
    return rows.join(judged(found), "row", "left").select(
        "doc_id", *[f"n_{k}" for k, *_ in BASE], "base_sha256", F.coalesce(_joined(F.col("spans")), F.lit("")).alias("spans"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_live", "n_example")]
    )


def redact(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """docs with every base match and every live-looking further match replaced by mark; n_chars follows the text.

    A further shape is redacted wherever find() would report it: it looks live and isn't widely copied. Documents without
    matches are as before, and no row goes. A null text stays null.
    """
    d = written(docs.withColumn("__row", F.monotonically_increasing_id()), "secret-rows")
    found = scan(d, F.col("source"), default_repository(), F.col("__row"))
    spans = judged(found).select(F.col("row").alias("__row"), F.sort_array("spans").alias("__spans"))

    # all in arrays of characters: taking a part of a string would walk through the text from its beginning each time
    chars = F.split("text", "")
    part = lambda start, end: F.array_join(F.slice(F.col("__chars"), start + F.lit(1), F.greatest(end - start, F.lit(0))), "")
    # a span that begins inside the ones before only carries them on
    reach = _running(F.transform("__spans", lambda x: x["e"]), "max")
    kept = F.zip_with("__spans", "__reach", lambda x, r: F.when(x["s"] >= r, F.concat(part(r, x["s"]), F.lit(mark))).otherwise(""))
    cleaned = F.concat(F.array_join(kept, ""), part(F.array_max(F.transform("__spans", lambda x: x["e"])), F.size("__chars")))
    out = d.join(spans, "__row", "left").withColumns({"__chars": F.when(F.size("__spans") > 0, chars), "__reach": reach})
    text = F.when(F.size("__spans") > 0, cleaned).otherwise(F.col("text"))
    columns = [text.alias("text") if c == "text" else F.when(F.size("__spans") > 0, F.length(cleaned).cast(docs.schema[c].dataType)).otherwise(F.col(c)).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns]
    return out.select(*columns)
