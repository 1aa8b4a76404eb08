"""Near copies of whole texts: SimHash and BK-trees find candidates, exact shingle similarity decides.

Two texts are near copies if the sets of their shingles (``shingle`` words, A-Z lower-cased) have
a Jaccard similarity of ``similarity`` or more. At 0.8 two 64-bit fingerprints differ in some ten
bits; block tables for such a radius would need thousands of keys a text. So the BK-trees stand in shards of
another kind: a shard's key is made of the ``depth`` least shingle hashes under ``depth`` permutations, and
each text has ``bands`` keys. Texts of similarity s share at least one with probability
1 - (1 - s ** depth) ** bands, 0.997 at 0.8. Within a shard a tree over the fingerprints names the
texts within ``radius`` bits, and only pairs whose shingles are similar enough are linked: nothing is linked by chance.

Texts of equal words are one class. Texts that share no shard are never moved: the shingles are made a second time,
only for classes in shards of two or more (a bit map of fixed size tells most others), and move once per
shard. A shard above ``PART`` classes is divided, and each pair of parts is a task of its own, so memory is bounded; pairs
already joined are not compared, and a task reports a spanning forest of its links, never all pairs.

Nulls and blanks: null and wordless texts are one class, linked with nothing else. A text of fewer words than a
shingle is one shingle. Null ids are kept; a group's id is its smallest non-null one. Very long texts are
read whole; their hashes take eight bytes a word in the task. Ties do not arise: links are
symmetric and groups are named by their smallest members. Repeated rows come back as often as they came in. An empty
table gives an empty result. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from sparkbi.llm.bk_tree import BkTree, _Forest
from sparkbi.llm.common import join_classes, saved, ship_by_value
from sparkbi.llm.components import connected_components

PART = 500
MAP_BITS = 24  # size of the bit map of classes as a power of two
WORDS_KEPT = 500_000  # word hashes a task remembers
#: Share of the rows in groups of near copies from which equal rows are thinned before they move.
HOT_SHARE = 0.005
STEP = np.uint64(0x9E3779B97F4A7C15)


def _mixed(values: np.ndarray) -> np.ndarray:
    """Spread 64-bit numbers evenly: multiply and fold, twice."""
    for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        values = (values ^ (values >> np.uint64(33))) * np.uint64(factor)
    return values ^ (values >> np.uint64(33))


class _Shingles:
    """Class and distinct shingle hashes of texts; remembers the hashes of frequent words."""

    def __init__(self, size: int):
        self.size, self.known = size, {}

    def __call__(self, text: str | None) -> tuple[int, np.ndarray]:
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
        klass = int(np.uint64(xxhash.xxh64_intdigest(b" ".join(words))).view(np.int64))
        if not words:
            return klass, np.zeros(0, np.uint64)
        if len(self.known) > WORDS_KEPT:
            self.known.clear()
        for word in set(words).difference(self.known):
            self.known[word] = xxhash.xxh64_intdigest(word)
        hashes = np.fromiter(map(self.known.__getitem__, words), np.uint64, len(words))
        width = min(self.size, len(words))
        made = np.full(len(words) - width + 1, np.uint64(width))
        for step in range(width):
            made = made * STEP + hashes[step : step + len(made)]
        return klass, np.unique(_mixed(made))


def simhash(hashes: np.ndarray) -> int:
    """The signed 64-bit number whose bits are set in more than half of the hashes; 0 for none."""
    if not len(hashes):
        return 0
    votes = np.zeros(64, np.int64)
    for start in range(0, len(hashes), 65536):
        part = hashes[start : start + 65536]
        votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > len(hashes), bitorder="little").view(np.int64)[0])


def _shard_keys(hashes: np.ndarray, bands: int, depth: int) -> list[int]:
    """One key per band from its ``depth`` least hashes; none for a text without words."""
    if not len(hashes):
        return []
    slots = np.arange(1, bands * depth + 1, dtype=np.uint64)
    factors, shifts = _mixed(slots) | np.uint64(1), _mixed(slots + np.uint64(1 << 32))
    least = np.array([(hashes * factor + shift).min() for factor, shift in zip(factors, shifts)]).reshape(bands, depth)
    keys = np.arange(bands, dtype=np.uint64)
    for place in range(depth):
        keys = _mixed(keys * STEP + least[:, place])
    return keys.view(np.int64).tolist()


def _sketch(shingle: int, bands: int, depth: int):
    """Task code: (id, text hash, text) to (id, text hash, class, fingerprint, shard keys)."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = _Shingles(shingle)
        for batch in batches:
            classes, prints, keys = [], [], []
            for value in batch.column(2):
                klass, hashes = shingles(value.as_py())
                classes.append(klass)
                prints.append(simhash(hashes))
                keys.append(_shard_keys(hashes, bands, depth))
            made = [pa.array(classes, pa.int64()), pa.array(prints, pa.int64()), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], ["id", "text_hash", "klass", "fingerprint", "keys"])

    return sketch


def _bit_map(classes: DataFrame) -> np.ndarray:
    """Bits set at the upper bits of all classes; at most 2 ** (MAP_BITS - 3) rows reach the driver."""
    placed = classes.select(F.shiftrightunsigned("klass", 64 - MAP_BITS).alias("place"))
    byte, bit = F.expr("cast(shiftright(place, 3) as int)"), F.expr("cast(bit_or(shiftleft(1, cast(place & 7 as int))) as short)")
    found = placed.groupBy(byte).agg(bit).toArrow()
    bits = np.zeros(1 << (MAP_BITS - 3), dtype=np.uint8)
    bits[found.column(0).to_numpy()] = found.column(1).to_numpy()
    return bits


def _wanted_shingles(shingle: int, bits):
    """Task code: texts to (class, shingles) of the classes that the bit map names, once per batch; shingles are 32-bit numbers."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = _Shingles(shingle)
        for batch in batches:
            found = {}
            for value in batch.column(0):
                klass, hashes = shingles(value.as_py())
                place = (klass & (1 << 64) - 1) >> (64 - MAP_BITS)
                if klass not in found and len(hashes) and bits.value[place >> 3] >> (place & 7) & 1:
                    found[klass] = np.unique((hashes >> np.uint64(32)).astype(np.uint32)).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.binary())], ["klass", "grams"])

    return read


def similar(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether two sorted lists of distinct numbers have a Jaccard similarity of at least ``similarity``."""
    low, high = sorted((len(a), len(b)))
    if low < similarity * high:
        return False
    both = np.concatenate((a, b))
    both.sort(kind="stable")
    shared = np.count_nonzero(both[1:] == both[:-1])
    return shared >= similarity * (low + high - shared)


def _link_shards(radius: int, similarity: float):
    """Task code: rows (group, class, fingerprint, shingles) sorted by group to links; one group, two parts at most, in memory."""

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current = None
        for batch in batches:
            found = []
            for group, klass, number, grams in zip(*(column.to_pylist() for column in batch.columns)):
                if group != current:
                    current, tree, forest, members = group, BkTree(), _Forest(), {}
                own, number = np.frombuffer(grams, np.uint32), number & (1 << 64) - 1
                for near in tree.within(number, radius):
                    for other, theirs in members[near]:
                        if forest.root(klass) != forest.root(other) and similar(own, theirs, similarity):
                            forest.joins(klass, other)
                            found.append((klass, other))
                if number not in members:
                    tree.add(number)
                members.setdefault(number, []).append((klass, own))
            pairs = np.array(found, dtype=np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    return link


def similar_links(docs: DataFrame, sketches: DataFrame, similarity: float, shingle: int, radius: int, text_column: str) -> DataFrame:
    """Links (a, b) between classes of texts, a spanning forest per shard."""
    spark = docs.sparkSession
    keyed = saved(sketches.select("klass", "fingerprint", F.explode("keys").alias("shard")).distinct())
    shards = saved(keyed.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).where("n > 1").withColumn("parts", F.ceil(F.col("n") / PART).cast("int")))
    shared = saved(join_classes(keyed, shards, "shard"))
    bits = spark.sparkContext.broadcast(_bit_map(shared))
    grams = docs.select(F.col(text_column)).mapInArrow(_wanted_shingles(shingle, bits), "klass long, grams binary").dropDuplicates(["klass"])
    own = shared.join(grams, "klass").withColumn("own", F.pmod(F.xxhash64("klass"), F.col("parts")).cast("int"))
    spread = own.select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    # pairs of a part with itself are contained in its pairs with others
    apart = spread.where((F.col("parts") == 1) | (F.col("own") != F.col("other")))
    group = F.xxhash64("shard", F.least("own", "other"), F.greatest("own", "other")).alias("group")
    rows = apart.select(group, "klass", "fingerprint", "grams").repartition("group").sortWithinPartitions("group", "klass")
    return rows.mapInArrow(_link_shards(radius, similarity), "a long, b long").distinct()


def near_texts(
    docs: DataFrame,
    similarity: float = 0.8,
    shingle: int = 5,
    radius: int = 20,
    bands: int = 8,
    depth: int = 3,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """One row per document: id, ``text_hash``, ``fingerprint`` (long), ``component_id``, ``component`` and ``group_rows``.

    ``component_id`` is the smallest id that links reach, ``component`` the smallest class of texts;
    ``group_rows`` counts the rows of the component.
    """
    text = F.col(text_column)
    wanted = docs.select(F.col(id_column).cast("long").alias("id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("text_hash"), text.alias("text"))
    sketches = saved(wanted.mapInArrow(_sketch(shingle, bands, depth), "id long, text_hash long, klass long, fingerprint long, keys array<long>"))
    classes = saved(sketches.groupBy("klass").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("rows")))
    components = connected_components(similar_links(docs, sketches, similarity, shingle, radius, text_column))
    labelled = saved(classes.join(components, F.col("klass") == F.col("node"), "left").withColumn("root", F.coalesce("component", "klass")).drop("node", "component"))
    groups = saved(labelled.groupBy("root").agg(F.min("least").alias("component_id"), F.sum("rows").alias("group_rows"), F.count(F.lit(1)).alias("n")))
    named = saved(join_classes(labelled, groups, "root").select("klass", F.col("rows").alias("n"), "component_id", F.col("root").alias("component"), "group_rows"))
    found = join_classes(sketches.drop("keys"), named, "klass")
    return found.select(F.col("id").alias(id_column), "text_hash", "fingerprint", "component_id", "component", "group_rows")


def _whole(docs: DataFrame) -> Column:
    """All columns of a row in one, out of the way of the columns added here."""
    return F.struct(*[F.col(f"`{name}`") for name in docs.columns]).alias("_document")


def keep_one(docs: DataFrame, found: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row of each group in ``found`` and all rows outside groups, with the columns of ``docs``.

    ``found`` has id, ``text_hash``, ``component`` and ``group_rows`` per row of ``docs``. Of a group the
    smallest id stays (null last), of equal ids the smallest text hash, of equal texts the smallest hash of the other columns.
    """
    named = found.where("group_rows > 1").select(F.col(id_column).alias("id"), "text_hash", "component")
    members = saved(named.groupBy("id", "text_hash", "component").agg(F.count(F.lit(1)).alias("_times")))
    place = F.struct(F.col("id").isNull(), "id", "text_hash")
    chosen = saved(members.groupBy("component").agg(F.min(place).alias("chosen"), F.count(F.lit(1)).alias("n")))
    # id and text hash without nulls, for a plain join
    key = lambda number, text_hash: [number.isNotNull().alias("_known"), F.coalesce(number, F.lit(0)).alias("_number"), text_hash.alias("_hash")]
    judged = join_classes(members, chosen, "component")
    marks = saved(judged.select(*key(F.col("id"), F.col("text_hash")), place.eqNullSafe(F.col("chosen")).alias("_stays"), "_times"))
    rows = docs.select(_whole(docs), *key(F.col(id_column).cast("long"), F.xxhash64(F.coalesce(F.col(text_column), F.lit("")))))
    keys = ["_known", "_number", "_hash"]
    others = [F.col(f"_document.`{name}`") for name in docs.columns if name != text_column]
    order = F.xxhash64(*others)
    # rows repeated very often are thinned in their own tasks before they move; at most 1 / HOT_SHARE such keys
    total = members.agg(F.coalesce(F.sum("_times"), F.lit(0))).first()[0]
    hot = F.col("_times") >= max(2, HOT_SHARE * total)
    staying = rows.join(F.broadcast(marks.where(hot & F.col("_stays")).select(*keys)), keys)
    thinned = staying.groupBy(*keys).agg(F.min_by("_document", order).alias("_document")).select("_document.*")
    copy = F.row_number().over(W.partitionBy(*keys).orderBy(order))
    few = rows.join(F.broadcast(marks.where(hot).select(*keys)), keys, "left_anti")
    marked = few.join(marks.where(~hot).drop("_times"), keys, "left").withColumn("_copy", copy)
    # rows outside all groups are unmarked and stay
    kept = marked.where(F.col("_stays").isNull() | (F.col("_stays") & (F.col("_copy") == 1))).select("_document.*")
    return kept.unionByName(thinned)


ship_by_value(__name__)
