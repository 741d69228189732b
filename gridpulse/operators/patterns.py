"""Names against shell-style patterns: a trie over the literal beginnings, each name run through it once."""

from __future__ import annotations

import fnmatch
import re
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridpulse.scale import collect_passes

SPECIAL = "*?["


class PatternTrie:
    """Patterns by the characters before their first special one; the rest of each is compiled once.

    ``*`` stands for any run, ``?`` for one character, ``[a-c]`` for one of a class and ``[!a-c]`` for one outside it. Case
    does not matter; a bracket that is not closed stands for itself.
    """

    def __init__(self, patterns: Sequence[str]):
        self.patterns, self.root, self.rest = list(patterns), {}, []
        for i, pattern in enumerate(self.patterns):
            text = pattern.upper()
            cut = next((k for k, ch in enumerate(text) if ch in SPECIAL), len(text))
            node = self.root
            for ch in text[:cut]:
                node = node.setdefault(ch, {})
            node.setdefault("", []).append(i)
            self.rest.append(re.compile(fnmatch.translate(text[cut:])).match)

    def matches(self, name: str) -> list[int]:
        """Numbers of the patterns that the whole upper-case name fits."""
        found, node, at = [], self.root, 0
        while node is not None:
            found += [i for i in node.get("", ()) if self.rest[i](name, at)]
            node = node.get(name[at]) if at < len(name) else None
            at += 1
        return found


def matched_patterns(names: DataFrame, name: str, patterns: DataFrame, fields: Sequence[str], passes: int = 20_000) -> DataFrame:
    """(pattern fields, name) for every distinct name that fits a pattern.

    Patterns without special characters are joined by value. The others are configuration: they go out in passes of bounded
    size as one trie, and a task runs each of its names through it once. Null names and patterns match nothing.
    """
    distinct = names.where(F.col(name).isNotNull()).select(F.upper(F.trim(name)).alias("_name"), F.col(name).cast("string").alias("name")).distinct()
    table = patterns.where("pattern is not null").select(*fields, "pattern").distinct().withColumn("_wild", F.col("pattern").rlike("[*?\\[]"))
    plain = table.where(~F.col("_wild")).withColumn("_name", F.upper("pattern"))
    out = plain.join(distinct, "_name").select(*fields, "name")
    spark = names.sparkSession
    for rows in collect_passes(table.where("_wild").select("pattern").distinct(), ["pattern"], passes):
        if not rows:
            continue
        shared = spark.sparkContext.broadcast([r["pattern"] for r in rows])

        def run(batches, shared=shared):
            trie = PatternTrie(shared.value)
            for batch in batches:
                hits = [(trie.patterns[i], own) for upper, own in zip(*(batch.column(c).to_pylist() for c in ("_name", "name")), strict=True) for i in trie.matches(upper)]
                columns = list(zip(*hits, strict=True)) or [(), ()]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], names=["pattern", "name"])

        hits = distinct.mapInArrow(run, "pattern string, name string")
        out = out.unionByName(table.join(hits, "pattern").select(*fields, "name"))
    return out.distinct()


def rule_matches(rules: DataFrame, names: DataFrame, name: str = "name") -> DataFrame:
    """(rule_id, match_strength, side, name): every name that fits an origin or a destination pattern of a rule.

    ``rules``: rule_id, weight, origin array, destination array.
    """
    strength = F.round("weight", 4).alias("match_strength")
    sides = [rules.select("rule_id", strength, F.lit(side).alias("side"), F.explode(side).alias("pattern")) for side in ("origin", "destination")]
    return matched_patterns(names, name, sides[0].unionByName(sides[1]), ["rule_id", "match_strength", "side"])
