"""A Merkle manifest of a table: a tree for each source, a tree over the sources' roots, a proof for every row.

Nodes stand in a table of (tree, idx, digest). At every level each node computes the indices of its siblings (the other
slots of its run of FANOUT) and meets them by an equijoin of the table with itself; the rows of slot zero then emit the
parents. Proofs are put together from the top: what lies above a node is joined to its children, so a row's proof comes
from one join however high the tree is. No tree is ever held by one task: rows are numbered by ranges of (tree, order).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import Scratch, bucket_of

FANOUT = 16
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
STEP = "struct<slot int, others array<binary>>"


def hashed(x: Column) -> Column:
    """sha256, 32 bytes."""
    return F.unhex(F.sha2(x, 256))


def field(value: Column) -> Column:
    """A hash's input for one value: - if null, else its length in UTF-8 bytes, a colon, itself."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(text: Column) -> Column:
    """The digest of a row of documents with that text."""
    return hashed(F.concat(*[field(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")], field(text)))


def hex_of(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def run_of(digests: Column) -> Column:
    """The digest of a run: that of the hex texts of its digests in order."""
    return hashed(F.array_join(F.transform(digests, hex_of), ""))


def numbered(rows: DataFrame, tree: str, order: list[str], scratch: Scratch) -> DataFrame:
    """rows, idx (their place in their tree from 0, by order, nulls first) and last, the tree's last idx.

    Rows are sorted over ranges, numbered inside each, and the ranges' counts are summed: a row a range and tree.
    """
    keys = [F.col(tree).asc_nulls_first(), *[F.col(c).asc_nulls_first() for c in order]]
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_rows = rows.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("__at", F.monotonically_increasing_id())
    placed = scratch.written(sorted_rows.withColumn("__part", F.shiftright("__at", 33)), f"placed-{tree}")
    parts = placed.groupBy("__part", tree).agg(F.min("__at").alias("__from"), F.count("*").alias("__n"))
    before = Window.partitionBy(tree).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    shift = F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__from")
    parts = parts.select("__part", tree, shift.alias("__shift"), (F.sum("__n").over(Window.partitionBy(tree)) - 1).alias("last"))
    return placed.join(parts, ["__part", tree]).withColumn("idx", F.col("__at") + F.col("__shift")).drop("__part", "__at", "__shift")


def with_others(nodes: DataFrame) -> DataFrame:
    """nodes (tree, idx, last, digest, more) and others, the digests of each node's siblings in order.

    Each digest goes to its siblings' computed indices, where the nodes meet them by an equijoin.
    """
    first = f"idx - idx % {FANOUT}"
    siblings = F.expr(f"filter(sequence({first}, least({first} + {FANOUT - 1}, last)), i -> i <> idx)")
    shifted = nodes.select("tree", F.explode(siblings).alias("at"), F.col("idx").alias("from"), "digest")
    met = shifted.groupBy("tree", F.col("at").alias("idx")).agg(F.array_sort(F.collect_list(F.struct("from", "digest"))).alias("met"))
    met = met.select("tree", "idx", F.col("met.digest").alias("others"))
    return nodes.join(met, ["tree", "idx"], "left").withColumn("others", F.coalesce("others", F.array().cast("array<binary>")))


def levels(leaves: DataFrame, scratch: Scratch) -> tuple[list[DataFrame], DataFrame]:
    """The levels of all trees from leaves (tree, idx, last, digest, more), and (tree, root).

    A level holds, with others, the nodes of the trees that have several there; the first keeps the leaves' more columns.
    """
    level, out = leaves, []
    alone = lambda d: d.where("last = 0").select("tree", F.col("digest").alias("root"))
    roots, top = alone(level), leaves.agg(F.max("last")).first()[0] or 0
    while top > 0:
        here = scratch.written(with_others(level.where("last > 0")), f"level-{len(out)}")
        out.append(here)
        level = here.where(f"idx % {FANOUT} = 0").select(
            "tree", F.expr(f"idx div {FANOUT}").alias("idx"), F.expr(f"last div {FANOUT}").alias("last"),
            run_of(F.concat(F.array("digest"), F.col("others"))).alias("digest"),
        )
        level, top = scratch.written(level, f"nodes-{len(out)}"), top // FANOUT
        roots = roots.unionByName(alone(level))
    return out, roots


def _steps(*after: str) -> Column:
    """A node's own step, then the first of the columns after that isn't null."""
    own = F.when(F.col("last") > 0, F.array(F.struct(F.expr(f"cast(idx % {FANOUT} AS int)").alias("slot"), F.col("others")).cast(STEP)))
    return F.concat(F.coalesce(own, no_steps()), F.coalesce(*after, no_steps()))


def no_steps() -> Column:
    return F.array().cast(f"array<{STEP}>")


def steps_up(tree_levels: list[DataFrame], above: DataFrame) -> DataFrame:
    """(tree, idx, steps) of the nodes of the first level: a step for each level from there to the top, then those of above.

    above has (tree, steps), what follows a tree's own levels. Without levels there are no rows.
    """
    over = above.select("tree", F.lit(0).cast("long").alias("idx"), "steps").limit(0)
    for level in reversed(tree_levels):
        d = level.select("tree", "idx", "last", "others", F.expr(f"idx div {FANOUT}").alias("up"))
        d = d.join(over.select("tree", F.col("idx").alias("up"), F.col("steps").alias("higher")), ["tree", "up"], "left")
        d = d.join(above.withColumnRenamed("steps", "rest"), "tree", "left")
        over = d.select("tree", "idx", _steps("higher", "rest").alias("steps"))
    return over


def folded(start: Column, steps: Column) -> Column:
    """The root that a leaf and its steps lead to."""
    return F.aggregate(steps, start, lambda acc, s: run_of(F.concat(F.slice(s["others"], 1, s["slot"]), F.array(acc), F.slice(s["others"], s["slot"] + 1, FANOUT))))


def manifest(docs: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) for every row of docs.

    Leaves ascend by doc_id in their source (a null doc_id first, rows with one doc_id by digest); a null source comes
    before all others. Rows whose doc_id's crc32 is divisible by 5 are tampered with (A-Z of the text lower-cased; rows
    without a doc_id or text stay as they are) and fold the tampered leaf. Repeated rows are leaves of their own. Other
    columns are ignored; an empty table gives an empty manifest.
    """
    scratch = Scratch(docs.sparkSession)
    tampers = F.col("doc_id").isNotNull() & (bucket_of("doc_id", 5) == 0)
    changed = F.when(tampers, leaf(F.translate("text", _UPPER, _LOWER))).otherwise(leaf(F.col("text")))
    # a source's tree is named s and the source, that of null the empty text: both sort as the sources must
    tree = F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit(""))
    d = scratch.written(docs.select("doc_id", tree.alias("tree"), leaf(F.col("text")).alias("digest"), changed.alias("changed")), "leaves")
    d = scratch.written(numbered(d, "tree", ["doc_id", "digest"], scratch), "numbered-leaves")
    own, subroots = levels(d, scratch)
    # one tree more, whose leaves are the sources' roots
    s = subroots.select(F.lit("top").alias("tree"), F.col("tree").alias("of"), F.col("root").alias("digest"))
    s = scratch.written(numbered(s, "tree", ["of"], scratch), "subroots")
    upper, top = levels(s, scratch)
    over = steps_up(upper, top.select("tree", no_steps().alias("steps")))
    above = s.join(over, ["tree", "idx"], "left").join(top, "tree")
    above = scratch.written(above.select(F.col("of").alias("tree"), F.col("digest").alias("subroot"), "root", F.coalesce("steps", no_steps()).alias("steps")), "sources")
    rest = steps_up(own[1:], above.select("tree", "steps"))
    rows = d.where("last = 0").withColumn("others", F.array().cast("array<binary>"))
    if own:
        rows = rows.unionByName(own[0])
    rows = rows.withColumn("up", F.expr(f"idx div {FANOUT}")).join(rest.select("tree", F.col("idx").alias("up"), F.col("steps").alias("higher")), ["tree", "up"], "left")
    rows = rows.join(above, "tree").withColumn("path", _steps("higher", "steps"))
    proof = F.sha2(F.array_join(F.transform(F.flatten(F.col("path.others")), hex_of), ""), 256)
    out = rows.select(
        "doc_id", hex_of(F.col("digest")).alias("leaf"), hex_of(F.col("subroot")).alias("subroot"), hex_of(F.col("root")).alias("root"),
        proof.alias("proof_sha256"), hex_of(folded(F.col("changed"), F.col("path"))).alias("folded_root"),
    )
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
