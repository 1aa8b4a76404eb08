"""Near copies by SimHash: fingerprints within a few bits, found with BK-trees.

A BK-tree keeps each fingerprint under its parent by their Hamming distance; a search for radius
r follows only the children whose distance lies within r of the query's own distance to the
parent. Random 64-bit fingerprints are nearly all 32 bits apart, so one tree over everything
would be walked almost whole. The trees are therefore kept per shard: cut into ``blocks``
blocks, two fingerprints within ``radius`` bits agree in all but ``radius`` blocks, so for every
choice of the other blocks those who agree there share a shard, and no link is lost. Equal
fingerprints are one node. A shard with more than ``PART`` fingerprints is divided into parts, and each
pair of parts is a task of its own: a tree over one part, searched with the other.
Trees report a spanning forest of the links in their shard, never all pairs.

Nulls and blanks: a text without words has fingerprint zero and links like any other. A null id
is fingerprinted too; a group's id is its smallest non-null one. Repeated rows come back as
often as they came in. An empty table gives an empty result. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sparkbi.llm.common import ascii_lower, join_classes, repeated, saved, ship_by_value, words
from sparkbi.llm.components import connected_components
from sparkbi.llm.simhash_words import block_count, block_keys, block_masks, majority, shingle_hashes, votes

PART = 1000


def text_fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle: int = 3) -> DataFrame:
    """``id``, ``text_hash``, ``copies`` (equal rows) and ``fingerprint`` (long) per distinct id and text."""
    text = F.coalesce(F.col(text_column), F.lit(""))
    rows = docs.select(F.col(id_column).alias("id"), F.xxhash64(text).alias("text_hash"), text.alias("_text"))
    keys = ["id", "text_hash"]
    # null parts are skipped, so a text of one or two words is hashed whole
    hashes = shingle_hashes(rows, keys, words(ascii_lower(F.col("_text"))), shingle, lambda parts: F.xxhash64(F.concat_ws(" ", *parts)))
    counted = votes(hashes, keys, extra=[F.count(F.when(F.col("place") == 0, 1)).alias("copies")])
    return counted.select(*keys, "copies", majority().alias("fingerprint"))


class BkTree:
    """Fingerprints under their parents by Hamming distance."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> None:
        self.values.append(value)
        self.children.append({})
        new, at = len(self.values) - 1, 0
        while new:
            distance = (value ^ self.values[at]).bit_count()
            if distance not in self.children[at]:
                self.children[at][distance] = new
                return
            at = self.children[at][distance]

    def within(self, value: int, radius: int) -> Iterator[int]:
        """Kept values at most ``radius`` bits from ``value``."""
        waiting = [0] if self.values else []
        while waiting:
            at = waiting.pop()
            distance = (value ^ self.values[at]).bit_count()
            if distance <= radius:
                yield self.values[at]
            for edge, child in self.children[at].items():
                if -radius <= edge - distance <= radius:
                    waiting.append(child)


class _Forest:
    """Links of one shard, kept while they join two trees of the forest."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def root(self, value: int) -> int:
        while (above := self.parent.get(value, value)) != value:
            self.parent[value] = value = self.parent.get(above, above)
        return value

    def joins(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        self.parent[max(a, b)] = min(a, b)
        return a != b


def _link_shards(radius: int):
    """Task code: rows sorted by (group, searching) to links. One group in memory at a time, two parts at most."""

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, tree, forest = None, BkTree(), _Forest()
        for batch in batches:
            group, same, searching, signed = (column.to_numpy(zero_copy_only=False) for column in batch.columns)
            value, size, found = signed.view(np.uint64).tolist(), len(group), []
            starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
            for start, stop in zip(starts, np.r_[starts[1:], size]):
                if group[start] != key:
                    if stop - start == 1 and stop < size:
                        continue  # alone in its shard
                    key, tree, forest = group[start], BkTree(), _Forest()
                for place in range(start, stop):
                    number = value[place]
                    if same[place] or searching[place]:
                        found += [(number, other) for other in tree.within(number, radius) if forest.joins(number, other)]
                    if same[place] or not searching[place]:
                        tree.add(number)
            pairs = np.array(found, dtype=np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    return link


def near_links(distinct: DataFrame, radius: int = 3) -> DataFrame:
    """Links (a, b) that join all fingerprints within ``radius`` bits; ``distinct`` has one row per ``fingerprint``."""
    masks = block_masks(radius, block_count(distinct.count(), radius))
    keyed = distinct.select("fingerprint", F.explode(block_keys(F.col("fingerprint"), masks)).alias("shard")).select("fingerprint", "shard.*")
    # Shards that need dividing; no bound on their number, so the join is left to the engine.
    large = keyed.groupBy("table", "bits").count().where(F.col("count") > PART)
    large = large.select("table", "bits", F.ceil(F.col("count") / PART).cast("int").alias("parts"))
    divided = keyed.join(large, ["table", "bits"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    own = divided.withColumn("own", F.pmod(F.xxhash64("fingerprint"), F.col("parts")).cast("int"))
    spread = own.select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    rows = spread.select(
        F.xxhash64("table", "bits", low, high).alias("group"),
        (low == high).alias("same"),
        (F.col("own") == high).alias("searching"),
        F.col("fingerprint").alias("value"),
    )
    sorted_rows = rows.repartition("group").sortWithinPartitions("group", "searching", "value")
    return sorted_rows.mapInArrow(_link_shards(radius), "a long, b long").distinct()


def near_copies(docs: DataFrame, radius: int = 3, shingle: int = 3, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: id, ``text_hash``, ``fingerprint`` (long), ``component_id``, ``component`` and ``group_rows``.

    ``component_id`` is the smallest id that links reach, ``component`` the smallest fingerprint;
    ``group_rows`` counts the rows of the component.
    """
    rows = saved(text_fingerprints(docs, id_column, text_column, shingle))
    distinct = saved(rows.groupBy("fingerprint").agg(F.min("id").alias("least"), F.sum("copies").alias("n")))
    components = connected_components(near_links(distinct, radius))
    labelled = distinct.join(components, F.col("fingerprint") == F.col("node"), "left").withColumn("root", F.coalesce("component", "fingerprint"))
    groups = labelled.groupBy("root").agg(F.min("least").alias("component_id"), F.sum("n").alias("group_rows"))
    classes = saved(labelled.drop("component").join(groups, "root").select("fingerprint", "n", "component_id", F.col("root").alias("component"), "group_rows"))
    found = repeated(join_classes(rows, classes, "fingerprint"), F.col("copies"))
    return found.select(F.col("id").alias(id_column), "text_hash", "fingerprint", "component_id", "component", "group_rows")


ship_by_value(__name__)
