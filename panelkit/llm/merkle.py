"""Merkle manifest of a dataset: one root, and a proof for every row, over nodes with leaf-rank intervals.

A node of the tree covers an interval ``[lo, hi)`` of leaf ranks inside its group. Nesting of intervals is
all that is used afterwards: the ancestors of a node are the nodes whose intervals contain its own, and
its siblings are the nodes in what its parent's interval has beside its own. Levels are taken in buckets
of ``DEPTH``, so that a join attaches the ancestors of a whole bucket at once and a leaf moves through one
exchange on the way up and one on the way down, however high the tree.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelkit.llm.prefix import running_totals
from panelkit.session import keep

# Consecutive nodes that have one parent.
FAN = 3
# Levels of a bucket; a task handles runs of FAN ** DEPTH nodes of its lowest level.
DEPTH = 6
SPAN = FAN**DEPTH

_NODE = "_g string, _name string, _lo bigint, _hi bigint, _digest binary"
_PROOF = "lefts array<string>, rights array<string>, subroot string"


def record_digest(fields: Sequence[Column]) -> Column:
    """Hex SHA-256 of some fields: each ``-`` if NULL, else its UTF-8 length, a colon and its value."""
    texts = [f.cast("string") for f in fields]
    parts = [F.coalesce(F.concat(F.octet_length(t), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.sha2(F.concat(*parts), 256)


def folded_root(leaf: Column, lefts: Column, rights: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    steps = F.arrays_zip(lefts.alias("l"), rights.alias("r"))
    return F.aggregate(steps, leaf, lambda acc, s: F.sha2(F.concat(s["l"], acc, s["r"]), 256))


def _digest(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


class _Level:
    """Nodes of one level in order: the intervals they cover and their digests."""

    def __init__(self, lo: np.ndarray, hi: np.ndarray, digests: list[str]):
        self.lo, self.hi, self.digests = lo, hi, digests

    def parents(self) -> _Level:
        first = np.arange(0, len(self.lo), FAN)
        last = np.minimum(first + FAN, len(self.lo)) - 1
        return _Level(self.lo[first], self.hi[last], [_digest(self.digests[i : i + FAN]) for i in first.tolist()])


def _bucket(nodes: pa.Table) -> list[_Level]:
    """The levels over a run of nodes, given in order of their intervals.

    A run that does not start its group goes up all levels of the bucket, as the group has other nodes
    beside it. A run that does is either full or the only one, and ends with one node.
    """
    digests = [d.hex() for d in nodes.column("_digest").to_pylist()]
    levels = [_Level(nodes.column("_lo").to_numpy(), nodes.column("_hi").to_numpy(), digests)]
    for _ in range(DEPTH):
        if levels[-1].lo[0] == 0 and len(levels[-1].lo) == 1:
            break
        levels.append(levels[-1].parents())
    return levels


def _proofs(levels: list[_Level], above: tuple[list[str], list[str]]) -> list[tuple[list[str], list[str]]]:
    """Digests before and after each lowest node, level by level up to the root."""
    known = [above] * len(levels[-1].lo)
    for own, over in zip(levels[-2::-1], levels[:0:-1], strict=True):
        # the parent is the one node above whose interval contains the node's
        parent = np.searchsorted(over.lo, own.lo, "right") - 1
        first = np.searchsorted(own.lo, over.lo[parent]).tolist()
        end = np.searchsorted(own.lo, over.hi[parent]).tolist()
        found = []
        for i, (p, a, b) in enumerate(zip(parent.tolist(), first, end, strict=True)):
            lefts, rights = known[p]
            found.append((["".join(own.digests[a:i]), *lefts], ["".join(own.digests[i + 1 : b]), *rights]))
        known = found
    return known


def _one(table: pa.Table, name: str):
    return table.column(name)[0].as_py()


def _anchor(span: int) -> Column:
    """Which run of ``span`` leaf ranks an interval lies in."""
    return F.expr(f"_lo div {span}L").alias("_anchor")


def _top(table: pa.Table) -> pa.Table:
    table = table.sort_by("_lo")
    top = _bucket(table)[-1]
    digest = pa.array([bytes.fromhex(top.digests[0])], pa.binary())
    names = table.slice(0, 1)
    hi = pa.array([int(top.hi[-1])], pa.int64())
    return pa.table([names.column("_g"), names.column("_name"), names.column("_lo"), hi, digest], names=["_g", "_name", "_lo", "_hi", "_digest"])


def _rise(leaves: DataFrame) -> list[DataFrame]:
    """Nodes at the lowest level of each bucket, up to one node for each group ``_g``."""
    stages, span = [leaves], SPAN
    while True:
        nodes = stages[-1].select("_g", "_name", "_lo", "_hi", "_digest")
        stages.append(keep(nodes.groupBy("_g", _anchor(span)).applyInArrow(_top, _NODE)))
        if stages[-1].groupBy("_g").count().where("count > 1").isEmpty():
            return stages
        span *= SPAN


def _attached(nodes: DataFrame, above: DataFrame, span: int, carried: Sequence[str]) -> DataFrame:
    """Each node with its proof: siblings below the node of the next bucket that contains it, and that one's."""
    kinds = {f.name: f.dataType.simpleString() for f in nodes.schema}
    schema = ", ".join(f"{c} {kinds[c]}" for c in carried) + ", " + _PROOF

    def run(own: pa.Table, over: pa.Table) -> pa.Table:
        own = own.sort_by("_lo")
        proofs = _proofs(_bucket(own), (_one(over, "lefts"), _one(over, "rights")))
        sides = [pa.array([p[k] for p in proofs], pa.list_(pa.string())) for k in (0, 1)]
        sides.append(pa.array([_one(over, "subroot")] * len(proofs), pa.string()))
        return pa.table([*[own.column(c) for c in carried], *sides], names=[*carried, "lefts", "rights", "subroot"])

    own, over = (t.groupBy("_g", _anchor(span)) for t in (nodes, above))
    return own.cogroup(over).applyInArrow(run, schema)


def _descend(stages: list[DataFrame], crown: DataFrame) -> DataFrame:
    """Proofs of the second stage's nodes, given those of the last one's; tops of runs of leaves."""
    for k in range(len(stages) - 2, 0, -1):
        crown = keep(_attached(stages[k], crown, SPAN ** (k + 1), ["_g", "_name", "_lo"]))
    return crown


def merkle_manifest(
    docs: DataFrame, key: str = "doc_id", by: str = "source", fields: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"),
    carry: dict[str, Column] | None = None,
) -> DataFrame:
    """One row per input row: ``key, leaf, subroot, root, lefts, rights`` and the columns of ``carry``.

    A leaf is the digest of the row's ``fields`` (:func:`record_digest`). The leaves of a ``by`` group, in
    order of ``key``, are folded three by three to its subroot, a single leaf being its own; subroots, in
    order of their group with NULL first, are folded likewise to the root. ``lefts`` and ``rights`` hold,
    level by level up to the root, the siblings before and after the row's node, as one string each.
    :func:`folded_root` leads from a leaf back to the root. All digests are hex text.

    Only digests, keys and what is carried move, never the fields. Ranks come from a range sort, so a hot
    group spreads over the tasks; tasks see runs of 729 nodes.

    Rows that repeat a key are ordered by their digests, so the result is the same for any order of rows;
    NULL keys come first; NULL groups are one group. An empty table gives an empty result. Columns beside
    the named ones are ignored, and may have any name.
    """
    carry = carry or {}
    own = {f"_c{i}": c for i, c in enumerate(carry.values())}
    leaves = docs.select(
        F.coalesce(F.concat(F.lit("s"), F.col(by)), F.lit("n")).alias("_g"),
        F.col(key).alias("_id"),
        F.unhex(record_digest([F.col(f) for f in fields])).alias("_digest"),
        *[c.alias(n) for n, c in own.items()],
    )
    ranked = running_totals(leaves.withColumn("_unit", F.lit(1)), ["_g"], ["_id", "_digest"], "_unit", "_lo")
    ranked = keep(ranked.withColumns({"_hi": F.col("_lo") + 1, "_name": F.lit(None).cast("string")}).drop("_unit"))
    trees = _rise(ranked)

    # the groups' tops are the leaves of the upper tree, which has one group
    named = trees[-1].select(F.lit("").alias("_g"), F.col("_g").alias("_name"), "_digest", F.lit(1).alias("_unit"))
    placed = keep(running_totals(named, ["_g"], ["_name"], "_unit", "_lo").withColumn("_hi", F.col("_lo") + 1).drop("_unit"))
    upper = _rise(placed)
    root = upper[-1].select(F.lower(F.hex("_digest"))).first()
    none = F.array().cast("array<string>")
    crown = upper[-1].select("_g", "_name", "_lo", none.alias("lefts"), none.alias("rights"), F.lit("").alias("subroot"))
    crown = _attached(placed, _descend(upper, crown), SPAN, ["_name", "_digest"])
    crown = crown.select(
        F.col("_name").alias("_g"), F.lit(None).cast("string").alias("_name"), F.lit(0).cast("bigint").alias("_lo"),
        "lefts", "rights", F.lower(F.hex("_digest")).alias("subroot"),
    )
    proven = _attached(ranked, _descend(trees, crown), SPAN, ["_id", "_digest", *own])
    return proven.select(
        F.col("_id").alias(key), F.lower(F.hex("_digest")).alias("leaf"), "subroot", F.lit(root[0] if root else None).cast("string").alias("root"),
        "lefts", "rights", *[F.col(n).alias(c) for n, c in zip(own, carry, strict=True)],
    )
