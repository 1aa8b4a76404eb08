"""Substring dedup: passages that a document repeats from an earlier one, found from fixed-block anchors.

A window is ``window`` consecutive words of one document. Every document is cut into non-overlapping
blocks of ``(window + 1) // 2`` words; whatever window two documents share holds a whole block of the earlier one.
So the blocks are the index, every rolling stretch of the same length of every document probes it, and a hit is
extended: the windows around it are compared in full, and neighbouring equal windows make up the maximal
repeat. A word goes if a window over it also starts in a document with a smaller id.

Texts stay where they are. They are written once in chunks of about ``chunk_bytes``, as a table bucketed by chunk, and
only hashes travel: a chunk sends each of its distinct hashes once to the bucket of that hash, with what it knows
of it, and the bucket answers the chunk. However many documents share a passage, a bucket holds one entry
per chunk for it, so no hash can fill a task, and no pairs of documents are ever made. First exchange: 40 bits of
each stretch and whether it is a block, a hit where another document has it (a false hit costs only
work). Second exchange: 96 bits of each window around a hit and its smallest id. At hundreds of terabytes raise
``chunk_bytes`` and ``bucket_bytes`` together, so that a chunk still sends dozens of hashes to each bucket.

Null text has no words; a document shorter than the window keeps all of them. A null id counts as larger than all
others (the largest long is kept for it and not allowed as an id), so such rows lose what documents with ids have and take nothing from anyone, nor do rows of the same
id from each other: repeated rows get equal results. An empty table gives an empty result. Other columns
are not looked at. A very long text is a chunk of its own and takes about 150 bytes of memory a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from sparkbi.llm.common import per_worker, saved_in_buckets, ship_by_value

WINDOW = 50
CHUNK_BYTES, BUCKET_BYTES = 8 << 20, 16 << 20
MOST_CHUNK_ROWS = 1 << 16
#: Files of the chunk table hold about this much text each.
TABLE_BUCKET_BYTES, MOST_TABLE_BUCKETS = 32 << 20, 50_000
ANCHOR_BITS, FLAGS = 40, 2
#: Odd factors of the two rolling hashes; each has an inverse modulo 2 ** 64.
FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
SIGN = np.uint64(1 << 63)
LAST_ID = 2**63 - 1
SENT = "bucket int, chunk long, entries binary"


def _mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _powers(factor: int, count: int) -> np.ndarray:
    """factor ** 0, factor ** 1, ... modulo 2 ** 64."""
    steps = np.full(max(count, 1), factor, dtype=np.uint64)
    steps[0] = 1
    return np.multiply.accumulate(steps)


def rolling(hashes: np.ndarray, length: int, factor: int) -> np.ndarray:
    """A 64-bit hash of every run of ``length`` entries, by differences of one running sum."""
    many = len(hashes) - length + 1
    if many <= 0:
        return np.zeros(0, np.uint64)
    upto = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * _powers(factor, len(hashes)), out=upto[1:])
    return _mixed((upto[length:] - upto[:-length]) * _powers(pow(factor, -1, 1 << 64), many))


def pack(columns: list[np.ndarray]) -> bytes:
    """64-bit numbers as compressed bytes: the first column ascending and stored as steps, all by byte planes."""
    first = np.diff(columns[0], prepend=np.uint64(0))
    planes = np.stack([first, *columns[1:]]).astype("<u8").view(np.uint8).reshape(len(columns), -1, 8)
    raw = np.ascontiguousarray(planes.transpose(0, 2, 1)).tobytes()
    return len(columns[0]).to_bytes(8, "little") + pa.Codec("zstd", 1).compress(raw, asbytes=True)


def unpack(entries: bytes, columns: int) -> list[np.ndarray]:
    count = int.from_bytes(entries[:8], "little")
    raw = pa.Codec("zstd").decompress(entries[8:], decompressed_size=count * columns * 8, asbytes=True)
    planes = np.frombuffer(raw, np.uint8).reshape(columns, 8, count).transpose(0, 2, 1)
    numbers = np.ascontiguousarray(planes).view("<u8").reshape(columns, count)
    return [np.cumsum(numbers[0], dtype=np.uint64), *numbers[1:]]


class WordHashes(dict):
    """64-bit hashes of words, looked up once per word; emptied when it has grown large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = found = xxhash.xxh3_64_intdigest(word)
        return found


class Chunk:
    """The words of a chunk's documents end to end."""

    def __init__(self, rows: pd.DataFrame, window: int):
        lookup = per_worker("words of repeats", "all", WordHashes)
        self.rows, self.window, self.block = rows, window, (window + 1) // 2
        self.words = [text.encode().split() for text in rows.text]
        self.sizes = np.array([len(words) for words in self.words], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.hashes = np.fromiter((lookup[word] for words in self.words for word in words), np.uint64, int(self.sizes.sum()))
        self.document = np.repeat(np.arange(len(rows)), self.sizes)
        self.place = np.arange(len(self.hashes)) - self.starts[self.document]
        #: ids as unsigned numbers of the same order
        self.ids = rows.id.to_numpy().astype(np.int64).view(np.uint64) ^ SIGN

    def _inside(self, length: int) -> np.ndarray:
        """Where runs of ``length`` words begin that stay in their document, among documents that hold a window."""
        size = self.sizes[self.document]
        return ((self.place + length <= size) & (size >= self.window))[: max(0, len(self.hashes) - length + 1)]

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Starts of all rolling stretches and their hashes."""
        at = np.flatnonzero(self._inside(self.block))
        return at, rolling(self.hashes, self.block, FACTORS[0])[at] >> np.uint64(64 - ANCHOR_BITS)

    def around(self, hits: np.ndarray) -> np.ndarray:
        """Starts of the windows that hold a stretch which starts at one of ``hits``."""
        edge = np.zeros(len(self.hashes) + 1, np.int64)
        np.add.at(edge, np.maximum(hits - (self.window - self.block), self.starts[self.document[hits]]), 1)
        np.add.at(edge, hits + 1, -1)
        inside = self._inside(self.window)
        return np.flatnonzero((np.cumsum(edge)[: len(inside)] > 0) & inside)

    def windows(self, at: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts of windows (all of them without ``at``) and both parts of their hashes."""
        at = np.flatnonzero(self._inside(self.window)) if at is None else at
        high = rolling(self.hashes, self.window, FACTORS[0])[at]
        low = rolling(_mixed(self.hashes), self.window, FACTORS[1])[at] >> np.uint64(32)
        return at, high, low


def _groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order that sorts by ``keys`` (the last is the finest), where groups begin in it, and each row's group in it."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for key in keys:
        new[1:] |= key[order][1:] != key[order][:-1]
    return order, np.flatnonzero(new), np.cumsum(new) - 1


def _send(chunk: int, buckets: int, bits: int, columns: list[np.ndarray]) -> pd.DataFrame:
    """Entries sorted by their hash of ``bits`` bits, a row for every bucket of the hash range that gets any."""
    bucket = (columns[0] >> np.uint64(max(0, bits - 32))) * np.uint64(buckets) >> np.uint64(min(bits, 32))
    edges = np.searchsorted(bucket, np.arange(buckets + 1, dtype=np.uint64))
    rows = [(number, chunk, pack([column[low:high] for column in columns])) for number, (low, high) in enumerate(zip(edges[:-1], edges[1:])) if high > low]
    return pd.DataFrame(rows, columns=["bucket", "chunk", "entries"])


def _answer(chunks: np.ndarray, of: np.ndarray, columns: list[np.ndarray]) -> pd.DataFrame:
    """Rows (chunk, entries) from entries in ascending order; ``of`` is the position in ``chunks``."""
    order = np.argsort(of, kind="stable")
    edges = np.searchsorted(of[order], np.arange(len(chunks) + 1))
    rows = [(int(chunks[at]), pack([column[order[low:high]] for column in columns])) for at, (low, high) in enumerate(zip(edges[:-1], edges[1:])) if high > low]
    return pd.DataFrame(rows, columns=["chunk", "entries"])


def _received(rows: pd.DataFrame, columns: int) -> tuple[list[np.ndarray], np.ndarray]:
    """All entries of ``rows`` and the row each one came in."""
    parts = [unpack(entries, columns) for entries in rows.entries]
    if not parts:
        return [np.zeros(0, np.uint64)] * columns, np.zeros(0, np.int64)
    return [np.concatenate(column) for column in zip(*parts)], np.repeat(np.arange(len(parts), dtype=np.int32), [len(part[0]) for part in parts])


def _probe(window: int, buckets: int):
    """Task code: a chunk's distinct stretches to their buckets; bit 0: a block, bit 1: in two documents here."""

    def probe(rows: pd.DataFrame) -> pd.DataFrame:
        chunk = Chunk(rows, window)
        at, anchor = chunk.anchors()
        order, first, _ = _groups(anchor)
        document = chunk.document[at][order]
        if len(first):
            block = np.maximum.reduceat((chunk.place[at][order] % chunk.block == 0).astype(np.uint64), first)
            several = np.minimum.reduceat(document, first) < np.maximum.reduceat(document, first)
            flags = block + 2 * several.astype(np.uint64)
        else:
            flags = np.zeros(0, np.uint64)
        # the flags are the last bits of the number that is sent
        return _send(int(rows.chunk.iloc[0]), buckets, ANCHOR_BITS + FLAGS, [(anchor[order][first] << np.uint64(FLAGS)) | flags])

    return probe


def _meet(rows: pd.DataFrame) -> pd.DataFrame:
    """Task code: the stretches of a bucket that are a block somewhere and occur in two documents, to every chunk that has them."""
    (sent,), of = _received(rows, 1)
    order = np.argsort(sent)
    sent, of = sent[order], of[order]
    anchor = sent >> np.uint64(FLAGS)
    first = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
    flags = np.bitwise_or.reduceat(sent & np.uint64(3), first)
    many = np.diff(np.r_[first, len(sent)])
    hit = np.repeat(((flags & np.uint64(1)) > 0) & ((many > 1) | (flags > 1)), many)
    return _answer(rows.chunk.to_numpy(), of[hit], [anchor[hit]])


def _extend(window: int, buckets: int):
    """Task code: a chunk and its hits to the distinct windows around them with the smallest id here."""

    def extend(rows: pd.DataFrame, hits: pd.DataFrame) -> pd.DataFrame:
        (hit,), _ = _received(hits, 1)
        if not len(rows) or not len(hit):
            return pd.DataFrame({"bucket": pd.Series(dtype="int32"), "chunk": pd.Series(dtype="int64"), "entries": pd.Series(dtype=object)})
        chunk = Chunk(rows, window)
        at, anchor = chunk.anchors()
        at, high, low = chunk.windows(chunk.around(at[np.isin(anchor, hit)]))
        order, first, _ = _groups(high, low)
        ids = chunk.ids[chunk.document[at]][order]
        least = np.minimum.reduceat(ids, first) if len(first) else ids
        return _send(int(rows.chunk.iloc[0]), buckets, 64, [high[order][first], low[order][first], least])

    return extend


def _decide(rows: pd.DataFrame) -> pd.DataFrame:
    """Task code: the smallest id of every window of a bucket, to the chunks whose own is larger."""
    (high, low, ids), of = _received(rows, 3)
    order, first, group = _groups(high, low)
    least = np.minimum.reduceat(ids[order], first)[group]
    later = least < ids[order]
    kept = order[later]
    return _answer(rows.chunk.to_numpy(), of[kept], [high[kept], low[kept], least[later]])


def _remove(window: int):
    """Task code: a chunk and the windows that earlier documents have, to its documents without repeats."""

    def remove(rows: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        if not len(rows):
            return pd.DataFrame({"id": pd.Series(dtype="int64"), "n_words": pd.Series(dtype="int64"), "n_removed": pd.Series(dtype="int64"), "text": pd.Series(dtype=object)})
        chunk = Chunk(rows, window)
        (far_high, far_low, far_ids), _ = _received(found, 3)
        at, high, low = chunk.windows()
        own = chunk.ids[chunk.document[at]]
        order, first, group = _groups(np.r_[high, far_high], np.r_[low, far_low])
        least = np.empty(len(order), np.uint64)
        if len(first):
            least[order] = np.minimum.reduceat(np.r_[own, far_ids][order], first)[group]
        again = at[least[: len(at)] < own]
        edge = np.zeros(len(chunk.hashes) + 1, np.int64)
        np.add.at(edge, again, 1)
        np.add.at(edge, again + window, -1)
        gone = np.cumsum(edge)[:-1] > 0
        removed = [int(gone[start : start + size].sum()) for start, size in zip(chunk.starts, chunk.sizes)]
        texts = [
            b" ".join(words if not cut else [word for word, drop in zip(words, gone[start : start + len(words)]) if not drop]).decode()
            for words, start, cut in zip(chunk.words, chunk.starts, removed)
        ]
        return pd.DataFrame({"id": rows.id, "n_words": chunk.sizes, "n_removed": removed, "text": texts})

    return remove


def _tagged(chunk_bytes: int):
    """Task code: number the chunks of a task's rows; a row belongs to the chunk in which it begins."""

    def tag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number, filled, many = TaskContext.get().partitionId() << 32, 0, 0, 0
        for batch in batches:
            numbers = []
            for size in pa.compute.binary_length(batch.column(1)).to_pylist():
                if filled >= chunk_bytes or many >= MOST_CHUNK_ROWS:
                    number, filled, many = number + 1, 0, 0
                filled, many = filled + size, many + 1
                numbers.append(task + number)
            yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), *batch.columns], ["chunk", "id", "text"])

    return tag


def without_repeats(
    docs: DataFrame, window: int = WINDOW, chunk_bytes: int = CHUNK_BYTES, bucket_bytes: int = BUCKET_BYTES, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """A row per document: id, ``n_words``, ``n_removed`` and ``text``, the kept words joined by one space."""
    if window < 1:
        raise ValueError("window must be at least 1")
    # no nulls among the ids that meet pandas, which would turn them into doubles
    rows = docs.select(F.coalesce(F.col(id_column).cast("long"), F.lit(LAST_ID)).alias("id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    files = min(MOST_TABLE_BUCKETS, max(size // TABLE_BUCKET_BYTES + 1, docs.sparkSession.sparkContext.defaultParallelism))
    buckets = size // bucket_bytes + 1
    chunks = saved_in_buckets(rows.mapInArrow(_tagged(chunk_bytes), "chunk long, id long, text string"), "chunk", files)

    def by_chunk(answers: DataFrame):
        return chunks.groupBy("chunk").cogroup(answers.groupBy("chunk"))

    sent = chunks.groupBy("chunk").applyInPandas(_probe(window, buckets), SENT)
    hits = sent.groupBy("bucket").applyInPandas(_meet, "chunk long, entries binary")
    around = by_chunk(hits).applyInPandas(_extend(window, buckets), SENT)
    earlier = around.groupBy("bucket").applyInPandas(_decide, "chunk long, entries binary")
    kept = by_chunk(earlier).applyInPandas(_remove(window), "id long, n_words long, n_removed long, text string")
    return kept.select(F.nullif("id", F.lit(LAST_ID)).alias(id_column), "n_words", "n_removed", "text")


ship_by_value(__name__)
