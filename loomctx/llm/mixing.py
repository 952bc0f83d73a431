"""Mixing sources to target weights: budgets down a tree, shortages to siblings first, token prefixes of seeded epochs.

The tree's levels are columns (domain, language, source). A node's budget is split among its children by weight; what a
child cannot fill, at ``epochs`` passes over its tokens, goes to its siblings in proportion to their weights, and only
what all of them together cannot take is handed back to the parent, whose own siblings then get it. A leaf takes whole epochs
and then a prefix of the next: documents in the order of a hash of (seed, epoch, doc_id), up to the first that
would pass the budget.

Only one row for each leaf reaches the driver (``leaves`` at most; more is an error). The prefix is found in
steps, so no task sorts a leaf: token sums by (leaf, leading bits of the hash) tell the bin in which the budget ends, the same
with more bits within that bin, and so on; running sums within the last, narrowest bin give the last document taken. Texts are not shuffled: a document is taken if it does
not come after its leaf's last one.
"""

from __future__ import annotations

import math
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomctx.llm.stage import written

#: Leading bits of the hash by which the bin that holds a budget's end is narrowed down, step by step.
BIN_BITS = (8, 16)


def estimated_tokens(text: Column) -> Column:
    """A quarter of the text's bytes, rounded up; 0 for null."""
    return F.floor((F.coalesce(F.octet_length(text), F.lit(0)) + 3) / 4).cast("long")


def split(total: int, capacity: dict, weight: dict) -> dict[tuple, int]:
    """Water filling in whole tokens: ``total`` in proportion to the weights, none above its capacity.

    Children are met once, by the level at which they are full (capacity over weight): those that the level of the rest reaches get their capacity, the
    others share what is left. Tokens that proportions leave over go one each to the largest fractions, smaller names first. Children without weight get
    nothing. The parts add up to the lesser of ``total`` and the capacities of those with weight.
    """
    out, left = dict.fromkeys(capacity, 0), int(total)
    open_ = [k for k in capacity if capacity[k] > 0 and weight[k] > 0]
    common = math.lcm(*(Fraction(weight[k]).denominator for k in open_))
    parts = {k: int(Fraction(weight[k]) * common) for k in open_}
    whole = sum(parts.values())
    # two unequal levels differ by more than one over the square of the greatest part, so whole numbers order them
    finer = 2 * max(parts.values(), default=1).bit_length()
    open_.sort(key=lambda k: (capacity[k] << finer) // parts[k])
    at = 0
    while at < len(open_) and parts[open_[at]] * left >= capacity[open_[at]] * whole:
        k = open_[at]
        out[k] = capacity[k]
        left, whole, at = left - capacity[k], whole - parts[k], at + 1
    rest = {k: divmod(parts[k] * left, whole) for k in open_[at:]}
    out |= {k: share for k, (share, _) in rest.items()}
    for k in sorted(rest, key=lambda k: (-rest[k][1], k))[: left - sum(share for share, _ in rest.values())]:
        out[k] += 1
    return out


def budgets(tokens: dict[tuple, int], total: float, weights: dict[tuple, float], epochs: int) -> dict[tuple, int]:
    """Budget of every leaf. ``weights`` gives a node's weight by its path; others weigh their tokens' share among their siblings.

    A node's capacity counts only what its children with weight can take, so what they cannot goes to the node's siblings, and
    to its parent's where these are full. The budgets add up to the lesser of ``total`` (whole tokens) and the root's capacity.
    """
    children: dict[tuple, list[tuple]] = {}
    size: dict[tuple, int] = {}
    for leaf in sorted(tokens):
        for depth in range(len(leaf) + 1):
            if leaf[:depth] not in size and depth:
                children.setdefault(leaf[: depth - 1], []).append(leaf[:depth])
            size[leaf[:depth]] = size.get(leaf[:depth], 0) + tokens[leaf]
    weight = {(): Fraction(1)}
    for parent, below in children.items():
        weight |= {c: Fraction(weights[c]) if c in weights else Fraction(size[c], size[parent] or 1) for c in below}
    capacity = {leaf: n * epochs for leaf, n in tokens.items()}
    for node in sorted(children, key=len, reverse=True):
        capacity[node] = sum(capacity[c] for c in children[node] if weight[c] > 0)
    out = {(): min(int(total), capacity.get((), 0))}
    for node in sorted(children, key=len):
        out |= split(out[node], {c: capacity[c] for c in children[node]}, weight)
    return {leaf: out[leaf] for leaf in tokens}


def mix(docs: DataFrame, levels: dict[str, Column], total: Column | int, weights: dict[tuple, float], epochs: int = 2, seed: int = 17, tokens: Column | None = None, leaves: int = 1_000_000) -> DataFrame:
    """The selected documents with ``epoch`` and ``mix_tokens`` added: one row for each epoch that takes the document.

    ``total`` is a token count, or a share of all tokens if below 1. Null levels are a value of their own ("").
    Texts without tokens cost nothing and are taken with their place in the order; repeated rows are each
    counted and taken together. Columns of docs keep their names; those named epoch or mix_tokens, or starting with ``__``, are left
    out. An empty table gives an empty result.
    """
    docs = docs.drop(*(c for c in docs.columns if c in ("epoch", "mix_tokens") or c.startswith("__")))
    inner = [f"__{n}" for n in levels]
    level_values = {i: F.coalesce(levels[n].cast("string"), F.lit("")) for i, n in zip(inner, levels)}
    rows = docs.withColumns(level_values | {"mix_tokens": F.coalesce(estimated_tokens(F.col("text")) if tokens is None else tokens.cast("long"), F.lit(0))})
    slim = written(rows.select(F.col("doc_id").cast("long").alias("doc_id"), "mix_tokens", *inner), "tokens")
    sums = slim.groupBy(*inner).agg(F.sum("mix_tokens").alias("n")).limit(leaves + 1).collect()
    if len(sums) > leaves:
        raise ValueError(f"more than {leaves} leaves")
    have = {tuple(r[i] for i in inner): int(r["n"] or 0) for r in sums}
    plan = budgets(have, total * sum(have.values()) if total < 1 else total, weights, epochs)
    # one row for each leaf and epoch that it reaches, so at most leaves * epochs; a leaf without tokens is taken once, at no cost
    quotas = [(*leaf, e, max(0, min(n, budget - e * n))) for leaf, n in have.items() for budget in [plan.get(leaf, 0)] for e in range(epochs) if budget > e * n or (n == 0 and e == 0)]
    quota = F.broadcast(docs.sparkSession.createDataFrame(quotas, ", ".join(f"{i} string" for i in inner) + ", epoch int, quota long"))
    group = [*inner, "epoch"]

    def ordered(frame: DataFrame) -> DataFrame:
        return frame.join(quota, inner).withColumn("__order", F.xxhash64(F.lit(seed), "epoch", F.col("doc_id").cast("long")))

    # the order is that of the hash's bits; the one bin of a leaf and epoch in which the budget ends, if it ends before the leaf does
    leading = lambda bits: F.shiftrightunsigned("__order", 64 - bits)
    edge = None
    for bits in BIN_BITS:
        inside = ordered(slim) if edge is None else ordered(slim).withColumn("__before", leading(known)).join(F.broadcast(edge), [*group, "__before"])
        bins = inside.groupBy(*group, "quota", F.lit(0).cast("long").alias("from") if edge is None else F.col("from"), leading(bits).alias("__bin")).agg(F.sum("mix_tokens").alias("n"))
        start = bins.withColumn("start", F.col("from") + F.sum("n").over(Window.partitionBy(*group).orderBy("__bin")) - F.col("n"))
        edge = written(start.where("start <= quota and start + n > quota").select(*group, F.col("__bin").alias("__before"), F.col("start").alias("from")), "edges")
        known = bits
    within = Window.partitionBy(*group).orderBy("__unsigned", "doc_id")
    place = F.struct(F.col("__order").bitwiseXOR(F.lit(-(1 << 63))).alias("__unsigned"), F.col("doc_id").cast("long").alias("doc_id"))
    inside = ordered(slim).withColumn("__before", leading(known)).join(F.broadcast(edge), [*group, "__before"]).withColumn("__unsigned", place["__unsigned"])
    inside = inside.withColumn("upto", F.col("from") + F.sum("mix_tokens").over(within)).where("upto <= quota")
    last = inside.groupBy(*group).agg(F.max(place).alias("__last"))
    cuts = F.broadcast(written(edge.select(*group, F.col("__before").alias("__edge")).join(last, group, "left"), "cuts"))
    taken = F.col("__edge").isNull() | (leading(known) < F.col("__edge")) | ((leading(known) == F.col("__edge")) & F.coalesce(place <= F.col("__last"), F.lit(False)))
    return ordered(rows).join(cuts, group, "left").where(taken).select(*docs.columns, "epoch", "mix_tokens")
