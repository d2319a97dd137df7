"""Factor expressions over a (date, security) panel.

A graph is a dict: node name -> (kind, inputs, options), with one output node; it is evaluated to one column by one
withColumn for each node, so Catalyst shares equal windows. Peers of a cross-section node are the rows with the same
date and universe membership.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import ranks, series

from .universe import COMPARE

C = F.col


@dataclass(frozen=True)
class Node:
    """kind: field, const, negate, lag, add, subtract, multiply, divide, mean, std, momentum, delta, min, max, rank, zscore,
    winsorize, demean, neutralize, group_rank, a comparison (gt ...), cond or fill."""

    kind: str
    inputs: tuple[str, ...] = ()
    options: dict = field(default_factory=dict)


@dataclass(frozen=True)
class Panel:
    security: str = "sid"
    order: str = "idx"
    date: str = "d"
    member: str = "member"


_TS = {"mean": series.ts_mean, "std": series.ts_std, "momentum": series.ts_momentum, "delta": series.ts_delta, "min": series.ts_min, "max": series.ts_max}
_BINARY = {"add": lambda a, b: a + b, "subtract": lambda a, b: a - b, "multiply": lambda a, b: a * b, "divide": lambda a, b: F.try_divide(a, b)}


def apply_missing(c: Column, peers: list, policy: str) -> Column:
    """What stands for a missing value: drop and keep leave it, zero gives 0, median the peers' median; the last two only
    where a peer has a value."""
    w = Window.partitionBy(*peers)
    some = F.count(c).over(w) > 0
    if policy == "zero":
        return F.when(c.isNull() & some, F.lit(0.0)).otherwise(c)
    if policy == "median":
        return F.coalesce(c, F.median(c).over(w))
    return c


def node_column(n: Node, p: Panel, has_mask: bool) -> Column:
    i = [C(f"n_{x}") for x in n.inputs]
    o = n.options
    peers = [p.date, p.member]
    by = [p.security]
    if n.kind == "field":
        x = C(o["column"]).cast("double")
        return F.when(~C(o["mask"]), x) if o.get("mask") else x
    if n.kind == "const":
        return F.lit(float(o["value"]))
    if n.kind == "negate":
        return -i[0]
    if n.kind == "lag":
        return series.lag_sessions(by, p.order, i[0], o["k"])
    if n.kind in _TS:
        return _TS[n.kind](by, p.order, i[0], o["window"], o.get("lag", 0))
    if n.kind in _BINARY:
        return _BINARY[n.kind](*i)
    if n.kind in ("rank", "zscore", "winsorize", "demean"):
        x = apply_missing(i[0], peers, o.get("missing", "drop"))
        if n.kind == "winsorize":
            return ranks.winsorize(peers, x, o["lo"], o["hi"])
        return {"rank": ranks.rank_avg, "zscore": ranks.zscore_pop, "demean": ranks.demean}[n.kind](peers, x)
    if n.kind in ("neutralize", "group_rank"):
        g = [*peers, o["group"]]
        x = {"neutralize": ranks.demean, "group_rank": ranks.rank_avg}[n.kind](g, i[0])
        return F.when(C(o["group"]).isNotNull(), x)
    if n.kind in COMPARE:
        return COMPARE[n.kind](*i)
    if n.kind == "cond":
        return F.when(i[0], i[1]).when(~i[0], i[2])
    if n.kind == "fill":
        filled = F.coalesce(i[0], F.lit(float(o["value"])))
        return F.when(~C(f"m_{n.inputs[0]}"), filled) if has_mask else filled
    raise ValueError(f"unknown node kind {n.kind}")


def spans(graph: dict[str, Node], name: str) -> dict[str, tuple[int, int]]:
    """Of each masked field below a node: (farthest, nearest) session that the node sees, counted backwards."""
    n = graph[name]
    if n.kind == "field":
        return {n.options["mask"]: (0, 0)} if n.options.get("mask") else {}
    far, near = (n.options["k"],) * 2 if n.kind == "lag" else (n.options.get("lag", 0) + n.options["window"] - 1, n.options.get("lag", 0)) if n.kind in _TS else (0, 0)
    out: dict[str, tuple[int, int]] = {}
    for x in n.inputs:
        for m, (f, k) in spans(graph, x).items():
            a = (f + far, k + near)
            out[m] = (max(out[m][0], a[0]), min(out[m][1], a[1])) if m in out else a
    return out


def mask_column(graph: dict[str, Node], name: str, p: Panel) -> Column:
    """Whether any masked cell lies in the span that a node sees."""
    w = Window.partitionBy(p.security).orderBy(p.order)
    out = F.lit(False)
    for m, (far, near) in spans(graph, name).items():
        out = out | F.coalesce(F.max(C(m).cast("int")).over(w.rowsBetween(-far, -near)) == 1, F.lit(False))
    return out


def evaluate_graph(panel: DataFrame, graph: dict[str, Node], output: str, p: Panel = Panel(), keep: bool = False) -> DataFrame:
    """The panel with the output node as column value (keep: every node as n_<name>). Each node is computed once."""
    done: list[str] = []
    masks = any(n.options.get("mask") for n in graph.values())

    def visit(name: str) -> None:
        if name not in done:
            for x in graph[name].inputs:
                visit(x)
            done.append(name)

    visit(output)
    d = panel
    for name in done:
        n = graph[name]
        if masks and n.kind == "fill":
            d = d.withColumn(f"m_{n.inputs[0]}", mask_column(graph, n.inputs[0], p))
        d = d.withColumn(f"n_{name}", node_column(n, p, masks))
    if keep:
        return d
    return d.select(*panel.columns, C(f"n_{output}").alias("value"))


def trace_graph(panel: DataFrame, graph: dict[str, Node], output: str, chosen: Column, p: Panel = Panel()) -> DataFrame:
    """(date, security, node, value) of every numeric node for the chosen rows."""
    d = evaluate_graph(panel, graph, output, p, keep=True).where(chosen)
    names = [c for c in d.columns if c.startswith("n_")]
    d = d.select(p.date, p.security, *[C(c).cast("double").alias(c[2:]) for c in names])
    return d.unpivot([p.date, p.security], [c[2:] for c in names], "node", "value")


def not_finite(df: DataFrame, columns: list[str], p: Panel = Panel()) -> DataFrame:
    """(date, security, node) of values that are NaN or infinite."""
    bad = lambda c: F.isnan(c) | (F.abs(C(c)) == float("inf"))
    return df.select(p.date, p.security, F.explode(F.array_compact(F.array(*[F.when(bad(c), F.lit(c)) for c in columns]))).alias("node"))


def library(name: str) -> tuple[dict[str, Node], str]:
    """Factors by name. Fields: close, book, eps_fwd, eps_fwd_before, foreign_net, short_balance, shares, margin, surprise."""
    f = lambda c: Node("field", (), {"column": c})
    graphs = {
        "momentum_12_1": ({"c": f("close"), "m": Node("momentum", ("c",), {"window": 231, "lag": 21}), "r": Node("rank", ("m",))}, "r"),
        "book_to_market": ({"b": f("book"), "k": f("cap"), "q": Node("divide", ("b", "k")), "r": Node("rank", ("q",))}, "r"),
        "eps_growth": ({"a": f("eps_fwd"), "b": f("eps_fwd_before"), "q": Node("divide", ("a", "b")), "one": Node("const", (), {"value": 1}), "g": Node("subtract", ("q", "one"))}, "g"),
        "foreign_net_20": ({"a": f("foreign_net"), "m": Node("mean", ("a",), {"window": 20})}, "m"),
        "short_ratio": ({"a": f("short_balance"), "b": f("shares"), "q": Node("divide", ("a", "b"))}, "q"),
        "margin_change_20": ({"a": f("margin"), "m": Node("delta", ("a",), {"window": 21})}, "m"),
        "surprise": ({"a": f("surprise"), "z": Node("zscore", ("a",))}, "z"),
    }
    return graphs[name]
