"""SimHash fingerprints of documents, of edited documents, and their neighbours, in DataFrame functions only.

The terms of a text are its pairs of neighbouring words in lower case; a term votes on the 64 bits
of its hash with its length in characters, so pairs of short common words count little. A bit
is set if more than half of the weight votes for it.

Neighbours within a Hamming radius come from block tables: 64 bits are cut into blocks, and each table
keeps one choice of blocks in front as its key. Fingerprints within the radius agree under the key of
at least one table; the pair is taken from the first such table only.

The next document is the one that follows by id, then by text hash; after the last comes the first.
Null ids come first. Of equal rows (same id and text) each but the last is followed by its equal.
Nulls: a null text is an empty one. A text without words has fingerprint zero, of one word the word
is its only term. An empty table gives an empty result. Other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from sparkbi.llm.common import join_classes, repeated, saved, words
from sparkbi.llm.simhash_words import BITS, block_count, block_keys, block_masks, majority, shingle_hashes, votes

TERM_WORDS = 2
HEAVY = 0.005
SHA_DIGITS = 15  # hex digits that fit a signed 64-bit number


def fingerprints(rows: DataFrame, keys: list[str], text: Column, carried: list[str] | None = None) -> DataFrame:
    """``keys`` and ``fingerprint`` (long) per key; each key has one text. ``carried`` numbers of a key are kept."""
    carried = carried or []
    term = lambda parts: F.concat_ws(" ", *parts)
    hashed = lambda parts: F.struct(F.xxhash64(term(parts)).alias("hash"), F.length(term(parts)).cast("long").alias("weight"))
    terms = shingle_hashes(rows, [*keys, *carried], words(F.lower(text)), TERM_WORDS, hashed)
    flat = terms.select(*keys, *carried, F.col("hash.hash").alias("hash"), F.col("hash.weight").alias("weight"))
    counted = votes(flat, keys, weight=F.col("weight"), extra=[F.max(name).alias(name) for name in carried])
    return counted.select(*keys, *carried, majority().alias("fingerprint"))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal bits."""
    return 1 - F.bit_count(a.bitwiseXOR(b)) / BITS


#: A document's place: null ids first, then by id and text hash. None of these is null, so joins need no null checks.
PLACE = ["known", "number", "text_hash"]


def _followers(rows: DataFrame) -> DataFrame:
    """Per place: ``n_chars``, ``copies`` (rows there), and the place before it with its length."""
    keys = rows.groupBy(*PLACE).agg(F.max("n_chars").alias("n_chars"), F.count(F.lit(1)).alias("copies"))
    placed = saved(keys.repartitionByRange(*PLACE).withColumn("block", F.spark_partition_id()))
    here = F.struct(*PLACE, "n_chars")
    # One row per block; the first block follows the last.
    lasts = placed.groupBy("block").agg(F.max(here).alias("last"))
    wrapped = F.max_by("last", "block").over(W.partitionBy())
    earlier = lasts.select("block", F.coalesce(F.lag("last").over(W.orderBy("block")), wrapped).alias("carried"))
    inside = F.lag(here).over(W.partitionBy("block").orderBy(*PLACE))
    before = placed.withColumn("inside", inside).join(earlier, "block").withColumn("before", F.coalesce("inside", "carried"))
    return before.select(*PLACE, "n_chars", "copies", *[F.col(f"before.{name}").alias(f"before_{name}") for name in (*PLACE, "n_chars")])


def neighbours(distinct: DataFrame, asked: DataFrame, radius: int = 3) -> DataFrame:
    """Pairs (asked, found) of different fingerprints within ``radius`` bits.

    Both inputs have one row per ``fingerprint``; ``asked`` is a part of ``distinct``.
    """
    masks = block_masks(radius, block_count(distinct.count(), radius))
    tables = lambda df, name: df.select(F.col("fingerprint").alias(name), F.explode(block_keys(F.col("fingerprint"), masks)).alias("key")).select(name, "key.*")
    left, right = tables(asked, "asked"), tables(distinct, "found")
    apart = F.col("asked").bitwiseXOR(F.col("found"))
    first = F.coalesce(*[F.when(apart.bitwiseAND(F.lit(mask)) == 0, table) for table, mask in enumerate(masks)])
    near = (apart != 0) & (F.bit_count(apart) <= radius) & (first == left["table"])
    return left.join(right, (left["table"] == right["table"]) & (left["bits"] == right["bits"]) & near).select("asked", "found")


def edited_fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Every document against its edited text, whose second half is the start of the next document.

    Columns: id, ``n_chars``, ``edited_sha256``, ``fingerprint`` and ``edited_fingerprint`` (long),
    ``near_edited``, ``near_next``.
    """
    id_, text = F.col(id_column), F.coalesce(F.col(text_column), F.lit(""))
    place = [id_.isNotNull().alias("known"), F.coalesce(id_.cast("long"), F.lit(0)).alias("number"), F.xxhash64(text).alias("text_hash")]
    links = saved(_followers(docs.select(*place, F.length(text).cast("long").alias("n_chars"))))
    before = [F.col(f"before_{name}").alias(name) for name in PLACE]

    # One text per place is enough. A row that fills a large share of the table is thinned before it moves.
    rows = docs.select(*place, text.alias("text"))
    total = links.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    often = F.broadcast(links.where(F.col("copies") >= max(2, HEAVY * total)).select(*PLACE))  # at most 1 / HEAVY places
    thinned = rows.join(often, PLACE, "left_semi").dropDuplicates(PLACE)
    rows = rows.join(often, PLACE, "left_anti").unionByName(thinned)

    # Texts move twice: to their own place, and the first half at most to the place before.
    joined = rows.join(links, PLACE)
    copy = F.row_number().over(W.partitionBy(*PLACE).orderBy("text_hash"))
    single = joined.withColumn("copy", copy).where("copy = 1").drop("copy")
    gives = single.select(*before, F.expr("substring(text, 1, cast(before_n_chars div 2 as int))").alias("given"))
    half = "cast(n_chars div 2 as int)"
    # The last of equal rows is followed by another place (variant 1), the others by their equal (variant 2).
    own_half = F.expr(f"substring(text, 1, {half})")
    given = F.when(F.col("variant") == 1, F.col("given")).otherwise(own_half)
    edited = F.concat(F.expr(f"substring(text, 1, cast(n_chars as int) - {half})"), given)
    variants = F.explode(F.sequence(F.lit(1), F.least(F.col("copies"), F.lit(2)).cast("int")))
    texts = single.join(gives, PLACE).withColumn("variant", variants).select(*PLACE, "variant", "copies", "text", F.coalesce(edited, F.lit("")).alias("edited"))

    # The digest travels as numbers, which hash aggregation can carry.
    pieces = {f"sha_{at}": F.conv(F.substring("sha", at, SHA_DIGITS), 16, 10).cast("long") for at in range(1, 65, SHA_DIGITS)}
    bodies = F.explode(F.array(*[F.struct(F.lit(version).alias("version"), F.col(name).alias("body")) for version, name in enumerate(("text", "edited"))]))
    versions = texts.withColumn("sha", F.sha2("edited", 256)).withColumns(pieces).withColumn("v", bodies)
    keys = [*PLACE, "variant", "copies", "version"]
    rows = versions.select(*keys[:-1], *pieces, F.col("v.version").alias("version"), F.col("v.body").alias("body"))
    printed = fingerprints(rows, keys, F.col("body"), carried=list(pieces))
    of = lambda version: F.max(F.when(F.col("version") == version, F.col("fingerprint")))
    result = saved(
        printed.groupBy(*keys[:-1]).agg(of(0).alias("fingerprint"), of(1).alias("edited_fingerprint"), *[F.max(name).alias(name) for name in pieces])
    )
    follows = result.where("variant = 1").join(links, PLACE).select(*before, F.col("fingerprint").alias("next_fingerprint"))
    found = result.join(follows, PLACE).join(links.select(*PLACE, "n_chars"), PLACE)
    digits = [F.lpad(F.lower(F.hex(name)), min(SHA_DIGITS, 65 - int(name[4:])), "0") for name in pieces]
    next_ = F.when(F.col("variant") == 1, F.col("next_fingerprint")).otherwise(F.col("fingerprint"))
    every = repeated(found, F.when(F.col("variant") == 1, 1).otherwise(F.col("copies") - 1))
    return every.select(
        F.when(F.col("known"), F.col("number")).alias(id_column),
        "n_chars",
        F.concat(*digits).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), next_).alias("near_next"),
    )


def count_neighbours(found: DataFrame, asked: Column, radius: int = 3) -> DataFrame:
    """``found`` with ``n_near``: for asked rows, how many other rows have a fingerprint within ``radius`` bits; else null.

    ``found`` has a ``fingerprint`` and should be a stored table, as it is read several times.
    """
    marked = found.withColumn("_asked", F.coalesce(asked, F.lit(False)))
    distinct = saved(marked.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("n"), F.max("_asked").alias("_asked")))
    pairs = neighbours(distinct, distinct.where("_asked"), radius)
    others = pairs.join(distinct.select(F.col("fingerprint").alias("found"), F.col("n").alias("rows")), "found").groupBy(F.col("asked").alias("fingerprint"))
    counted = distinct.join(others.agg(F.sum("rows").alias("others")), "fingerprint", "left")
    classes = saved(counted.select("fingerprint", "n", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("_near")))
    near = F.when(F.col("_asked"), F.col("_near")).alias("n_near")
    return join_classes(marked, classes, "fingerprint").select(*found.columns, near)
