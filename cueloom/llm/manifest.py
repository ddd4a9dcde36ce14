"""Merkle manifest of a dataset by blocks of higher-order SQL.

A row's leaf is the SHA-256 (lowercase hex) of its fields, each ``-`` if null,
else its length in UTF-8 bytes, a colon and the value. A tree joins every three
consecutive nodes, the last run being what is left, until one remains: a tree
per source over its leaves ascending by doc_id, then one over the sources' roots,
ordered by source, null first.

* Places: leaves are range-partitioned by (tree, order) and numbered within the
  ranges; the ranges' sizes per tree, added up, give each leaf's place.
* Blocks: BLOCK = 3 ** LEVELS consecutive nodes are one ordered array, which
  ``sequence``, ``transform``, ``slice`` and ``aggregate`` collapse to one node.
  Blocks begin at multiples of their size, so a run never lies in two of them.
* The blocks' nodes are the next round's leaves, until every tree has one. A
  round has a 243rd of the rows before it.
* Proofs go back down: each round's blocks get the path above them by a join of
  one row a block, and append each child's siblings, left and right.

Nothing in it grows with a tree but the number of blocks: a source with a third
of all rows is cut into ranges and blocks like any other. Only DataFrame
functions are used.

Rows of a source with the same doc_id go by their leaf; equal rows have equal
leaves, and each its own place. A null doc_id comes first and is never tampered
with. Texts may be empty or of any length. An empty table gives an empty
result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import shared_table

WIDTH, LEVELS = 3, 5
BLOCK = WIDTH**LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Sums of ranges and trees up to which they are broadcast, and not joined.
MOST_SENT = 100_000


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(row: dict[str, Column]) -> Column:
    return digest(*[field(row[c]) for c in FIELDS])


def tampered(doc_id: Column) -> Column:
    """True for about half of the documents, by crc32 of the id as text."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 2 == 0, F.lit(False))


def numbered(nodes: DataFrame, *order: str) -> DataFrame:
    """``nodes`` (tree, node, others) with at (place in its tree by ``order``, nulls first, from 0) and size (of the tree)."""
    # Rows that are equal in all of these are interchangeable; the last key only deals them to several ranges.
    dealt = nodes.withColumn("_deal", F.monotonically_increasing_id())
    keys = [F.col(c).asc_nulls_first() for c in ("tree", *order, "node", "_deal")]
    splits = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # An id has the range's number in its upper bits and counts up by one within the range.
    ranged = shared_table(dealt.repartitionByRange(max(splits, nodes.rdd.getNumPartitions()), *keys).sortWithinPartitions(*keys).drop("_deal").withColumn("_id", F.monotonically_increasing_id()))
    ranged = ranged.withColumn("_range", F.shiftright("_id", 33))
    totals = ranged.groupBy("tree", "_range").agg(F.count("*").alias("_n"), F.min("_id").alias("_first"))
    tree = Window.partitionBy("tree")
    before = F.sum("_n").over(tree.orderBy("_range")) - F.col("_n")
    totals = shared_table(totals.select(F.col("tree").alias("_tree"), F.col("_range").alias("_of"), (before - F.col("_first")).alias("_shift"), F.sum("_n").over(tree).alias("size")))
    totals = F.broadcast(totals) if totals.count() <= MOST_SENT else totals
    placed = ranged.join(totals, F.col("tree").eqNullSafe(F.col("_tree")) & (F.col("_range") == F.col("_of")))
    return placed.withColumn("at", F.col("_id") + F.col("_shift")).drop("_id", "_range", "_tree", "_of", "_shift")


def levels_of(size: Column) -> Column:
    """How often a tree of ``size`` nodes is collapsed before one remains: up to 3 ** 39 nodes."""
    return reduce(lambda n, k: n + (size > WIDTH**k).cast("int"), range(39), F.lit(0))


def collapsed(nodes: Column) -> Column:
    """The next level of an array of nodes."""
    runs = F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / WIDTH).cast("int"))
    return F.transform(runs, lambda k: F.sha2(F.array_join(F.slice(nodes, k * WIDTH + 1, WIDTH), ""), 256))


def blocks_of(nodes: DataFrame) -> DataFrame:
    """Blocks of ``nodes`` (tree, at, size, node, others): tree, block, size and levels, an array of arrays of nodes from the leaves up."""
    members = F.array_sort(F.collect_list(F.struct("at", *[c for c in nodes.columns if c not in ("tree", "at", "size")])))
    block = F.floor(F.col("at") / BLOCK).alias("block")
    rows = nodes.groupBy("tree", block).agg(members.alias("members"), F.first("size").alias("size"))
    steps = F.least(F.lit(LEVELS), levels_of(F.col("size")))
    up = F.aggregate(F.sequence(F.lit(0), steps), F.array().cast("array<array<string>>"), lambda done, k: F.concat(done, F.array(F.when(k == 0, F.transform("members", lambda m: m["node"])).otherwise(collapsed(F.element_at(done, -1))))))
    return rows.withColumn("levels", up)


def path_of(levels: Column, place: Column) -> Column:
    """The siblings (l: left of it, r: right of it, as text) of the node at ``place`` of the lowest level, level by level."""

    def step(nodes: Column, k: Column) -> Column:
        at = F.floor(place / F.pow(F.lit(float(WIDTH)), k)).cast("int")
        first = at - at % WIDTH
        left, right = F.slice(nodes, first + 1, at - first), F.slice(nodes, at + 2, first + WIDTH - at - 1)
        return F.struct(F.array_join(left, "").alias("l"), F.array_join(right, "").alias("r"))

    return F.transform(F.slice(levels, 1, F.size(levels) - 1), step)


def folded(node: Column, path: Column) -> Column:
    return F.aggregate(path, node, lambda done, x: digest(x["l"], done, x["r"]))


def proof(path: Column) -> Column:
    return F.sha2(F.array_join(F.transform(path, lambda x: F.concat(x["l"], x["r"])), ""), 256)


class Trees:
    """The trees over ``nodes`` (tree, at, size, node, others), one round of blocks after the other."""

    def __init__(self, nodes: DataFrame):
        self.rounds = []
        most = nodes.agg(F.max("size")).first()[0] or 0
        while True:
            blocks = shared_table(blocks_of(nodes))
            self.rounds.append(blocks)
            nodes = blocks.select("tree", F.col("block").alias("at"), F.ceil(F.col("size") / BLOCK).alias("size"), F.element_at(F.element_at("levels", -1), 1).alias("node"))
            most = -(-most // BLOCK)
            if most <= 1:
                break
        #: tree, node: what remains of each tree.
        self.roots = nodes.select("tree", "node")

    def paths(self, above: DataFrame, finish: Callable[[Column, Column], list[Column]]) -> DataFrame:
        """tree and what ``finish`` makes of each leaf's member and of its whole path, given ``above``: tree, path and top of each tree's root."""
        above = above.withColumn("at", F.lit(0).cast("long"))
        for k, blocks in reversed(list(enumerate(self.rounds))):
            over = above.select(F.col("tree").alias("_tree"), F.col("at").alias("_at"), F.col("path").alias("_path"), "top")
            met = blocks.join(over, F.col("tree").eqNullSafe(F.col("_tree")) & (F.col("block") == F.col("_at")))

            columns = finish if k == 0 else lambda m, path: [m["at"].alias("at"), path.alias("path")]

            def child(m: Column) -> Column:
                return F.struct(*columns(m, F.concat(path_of(F.col("levels"), m["at"] - F.col("block") * BLOCK), F.col("_path"))))

            above = met.select("tree", "top", F.inline(F.transform("members", child)))
            if k:
                above = shared_table(above)
        return above


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified per row of ``docs``; what is sent loses its line ends for half of the rows."""
    row = {c: docs[c] for c in FIELDS}
    sent = F.when(tampered(row["doc_id"]), leaf(row | {"text": F.replace(row["text"].cast("string"), F.lit("\n"), F.lit(""))}))
    leaves = docs.select(row["source"].cast("string").alias("tree"), row["doc_id"].cast("long").alias("doc_id"), leaf(row).alias("node"), sent.alias("sent"))
    sources = Trees(numbered(leaves, "doc_id"))
    # The tree of sources is a single one; its nodes are ordered by the source that they stand for.
    whole = Trees(numbered(sources.roots.select(F.lit("").alias("tree"), F.col("tree").alias("source"), "node"), "source"))
    root = whole.roots.first()
    none = F.array().cast("array<struct<l: string, r: string>>")
    over = shared_table(whole.paths(whole.roots.select("tree", none.alias("path"), F.col("node").alias("top")), lambda m, path: [m["source"].alias("source"), m["node"].alias("node"), path.alias("path")]))
    found = sources.paths(
        over.select(F.col("source").alias("tree"), "path", F.col("node").alias("top")),
        lambda m, path: [m["doc_id"].alias("doc_id"), m["node"].alias("leaf"), proof(path).alias("proof_sha256"), folded(F.coalesce(m["sent"], m["node"]), path).alias("folded_root")],
    )
    root = F.lit(root["node"] if root else None).cast("string")
    return found.select("doc_id", "leaf", F.col("top").alias("subroot"), root.alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == root).alias("verified"))
