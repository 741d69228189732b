"""Merkle manifest of a data set: a hash tree per source, one tree over the sources, and a proof for every row.

Nodes are rows. A level is one window over runs of ``fan`` nodes: lag and lead columns at fixed offsets, masked by a node's
slot and the length of its run, are its siblings, and the first child of a run hashes the parent. Going up, only the
parents' rows go on; coming down, each node puts its own siblings before those that its parent handed to it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridpulse.llm.spark import numbered, pinned

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PATH = "array<struct<before:string,after:string>>"


def encoded(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def digest(*parts: Column) -> Column:
    """Lower-case hex SHA-256 of the parts end to end; a part that is null is left out."""
    return F.sha2(F.concat_ws("", *parts), 256)


def is_tampered(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def leaf_rows(docs: DataFrame) -> DataFrame:
    """``doc_id, group`` (the source, so that null comes first), ``h`` (leaf) and ``altered`` (leaf of a tampered text)."""
    head = [encoded(F.col(c)) for c in FIELDS[:-1]]
    text = F.col("text").cast("string")
    altered = digest(*head, encoded(F.translate(text, UPPER, LOWER)))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.concat(F.lit("+"), F.col("source").cast("string")), F.lit("")).alias("group"),
        digest(*head, encoded(text)).alias("h"),
        F.when(is_tampered(F.col("doc_id")), altered).alias("altered"),
    )


def in_runs(nodes: DataFrame, fan: int) -> tuple[DataFrame, list[Column], list[Column]]:
    """Nodes that have siblings or a parent, with ``run`` and ``slot``, and the columns of nodes before and after in the run."""
    run = Window.partitionBy("group", "run").orderBy("place")
    rows = nodes.where("members > 1").withColumns({"run": F.expr(f"place div {fan}"), "slot": F.col("place") % fan})
    length = F.least(F.lit(fan), F.col("members") - F.col("run") * fan)
    before = [F.when(F.col("slot") >= k, F.lag("h", k).over(run)) for k in range(fan - 1, 0, -1)]
    after = [F.when(F.col("slot") + k < length, F.lead("h", k).over(run)) for k in range(1, fan)]
    return rows, before, after


def parents(nodes: DataFrame, fan: int) -> DataFrame:
    rows, _, after = in_runs(nodes, fan)
    made = rows.select("group", "run", "slot", F.ceil(F.col("members") / fan).alias("members"), digest(F.col("h"), *after).alias("h"))
    return made.where("slot = 0").select("group", F.col("run").alias("place"), "members", "h")


def levels_of(nodes: DataFrame, fan: int) -> list[DataFrame]:
    """The nodes of every level; a group is in each level up to the one that holds its single last node."""
    levels, most = [nodes], nodes.agg(F.max("members")).first()[0] or 0
    while most > 1:
        levels.append(pinned(parents(levels[-1], fan)))
        most = -(-most // fan)
    return levels


def last_nodes(levels: list[DataFrame]) -> DataFrame:
    """``group, h`` of the single last node of each group."""
    found = [nodes.where("members = 1").select("group", "h") for nodes in levels]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def with_paths(levels: list[DataFrame], last: Callable[[DataFrame], DataFrame], fan: int) -> DataFrame:
    """Rows of the lowest level with what ``last`` gives the last node of their group, and their siblings first in ``path``."""
    above, given = None, []
    for nodes in reversed(levels):
        ended = last(nodes.where("members = 1"))
        given = given or [c for c in ended.columns if c not in nodes.columns]
        if above is not None:
            rows, before, after = in_runs(nodes, fan)
            # the join and the window need the same rows together, so one shuffle serves both
            joined = rows.join(above.select("group", F.col("place").alias("run"), *given), ["group", "run"])
            step = F.struct(F.concat_ws("", *before).alias("before"), F.concat_ws("", *after).alias("after"))
            inner = joined.withColumn("step", step).withColumn("path", F.concat(F.array("step"), "path"))
            ended = ended.unionByName(inner.select(*ended.columns))
        above = ended
    return above


def folded(start: Column, path: Column) -> Column:
    """Root that follows from a leaf and its siblings."""
    return F.aggregate(path, start, lambda h, step: digest(step["before"], h, step["after"]))


@dataclass(frozen=True)
class Manifest:
    """Levels of the trees of all sources, and of the tree over their roots."""

    sources: list[DataFrame]
    roots: list[DataFrame]
    fan: int

    def nodes(self) -> DataFrame:
        """``tree`` (``source`` or ``roots``), ``source``, ``level``, ``place`` and ``digest`` of every node."""
        out = None
        for tree, levels in (("source", self.sources), ("roots", self.roots)):
            for k, nodes in enumerate(levels):
                source = F.when(F.col("group") != "", F.substring("group", 2, 2**31 - 1)) if tree == "source" else F.lit(None).cast("string")
                rows = nodes.select(F.lit(tree).alias("tree"), source.alias("source"), F.lit(k).alias("level"), "place", F.col("h").alias("digest"))
                out = rows if out is None else out.unionByName(rows)
        return out

    def root(self) -> DataFrame:
        """One row with ``root``; none for an empty table."""
        return last_nodes(self.roots).select(F.col("h").alias("root"))

    def proofs(self) -> DataFrame:
        """Leaf rows with ``subroot``, ``root`` and ``path``: siblings before and after, from the lowest run upwards."""
        first = lambda rows: rows.withColumns({"path": F.array().cast(PATH), "root": F.col("h")})
        tops = with_paths(self.roots, first, self.fan).select(F.col("source").alias("group"), F.col("h").alias("subroot"), "root", "path")
        return with_paths(self.sources, lambda rows: rows.join(tops, "group"), self.fan)


def build_manifest(docs: DataFrame, fan: int = 16) -> Manifest:
    """Hash trees over ``docs``: leaves of a source ascend by ``doc_id``, sources by their UTF-8 bytes, null first in both.

    Rows of one source that share an id ascend by leaf, so repeated rows are equal leaves side by side and the roots do not
    depend on the order of reading. A null in any column is hashed as ``-``, an empty text as ``0:``; texts of any length
    are hashed whole where they are read and only digests are shuffled. Columns beyond the five are ignored. An empty table
    has no nodes and no root.
    """
    leaves = pinned(numbered(leaf_rows(docs), "group", ["doc_id", "h"]))
    sources = levels_of(leaves, fan)
    tops = last_nodes(sources).select(F.lit("").alias("group"), F.col("group").alias("source"), "h")
    roots = levels_of(pinned(numbered(tops, "group", ["source"])), fan)
    return Manifest(sources, roots, fan)


def proof_rows(manifest: Manifest) -> DataFrame:
    """Per document its leaf, roots and proof, and whether the leaf of the tampered text still folds to the root.

    Where 5 divides the unsigned CRC-32 of the decimal id, A-Z of the text are lower-cased first; a null id is not tampered
    with, and a text without A-Z still verifies.
    """
    rows = manifest.proofs()
    siblings = F.array_join(F.transform("path", lambda step: F.concat(step["before"], step["after"])), "")
    return rows.select(
        "doc_id",
        F.col("h").alias("leaf"),
        "subroot",
        "root",
        F.sha2(siblings, 256).alias("proof_sha256"),
        folded(F.coalesce("altered", "h"), F.col("path")).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))
