"""Language-model scores from a probabilistic suffix tree over words.

States are contexts of up to ``DEPTH`` words. A context is kept if its next-word distribution diverges
from that of its suffix: its count times the Kullback-Leibler divergence must reach a threshold; the
suffix of a state is a state. Distributions are smoothed: listed next words give up a discount, and the
mass of all others follows the suffix state, down to the add-one word distribution at the root, which
covers every word. A text is scored from the state of the longest kept suffix before each token.

Every n-gram of the training rows counts, however rare, so the tree grows with the corpus.
``least_word`` and ``least_gram`` can demand shares of the corpus; both are 0.

The tree is never a table. Each token moves once, as a window of itself and the ``DEPTH`` words before it,
to the part of the word before it. A part so holds all contexts that end in its words, with their suffixes
and followers: it builds its branches of the tree, scores its windows and sends back sums per document.
The parts are as many as keep ``PART`` tokens in each on average. Windows travel packed, by columns: the
``KNOWN_WORDS`` most frequent words, which tasks know by heart, as their rank, others as 64-bit hashes.
What a part must know of the other words is joined by a shuffle. N-grams are known by 64-bit hashes.

A context with more tokens than ``HOT`` parts is split by the word before it, and one of ``DEPTH`` words by
text. Its n-grams are counted by a shuffle before, and its parts are told of them like of words. Only states
by their own divergence whose suffixes are split too are split, as the parts can't tell if longer ones are states.

Nulls: a null text is an empty one, a single end token. Null ids are kept and belong to the training part.
Repeated rows are scored and counted each. Without training rows every score is that of an empty model. An
empty table gives an empty result. Other columns are not looked at.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from sparkbi.llm.common import ascii_lower, saved, ship_by_value, words

END = " "  # the end token; no word holds a blank
DEPTH = 3
KNOWN_WORDS = 500_000  # words that tasks know by heart, at most
DISCOUNT = 0.5
DIVERGENCE = 10.0
CHUNK = 1_000_000  # tokens packed together at least, where there are as many
PART = 2_000_000  # tokens of a part of the tree on average
HOT = 2  # contexts with more tokens than so many parts are split
SLICE = 500_000  # tokens of a part whose longer contexts are taken up together, about
FOLDS, HELD_FOLD = 7, 2
LEARN, SCORE = 1, 2  # marks of a row
CHUNK_BITS, ROW_BITS = 16, 24  # chunks of a task, rows of a chunk
PACKED = "chunk long, size long, body array<binary>"


def held_out(id_: Column) -> Column:
    return F.crc32(F.encode(F.coalesce(id_.cast("string"), F.lit("")), "UTF-8")) % FOLDS == HELD_FOLD


def tokens(text: Column) -> Column:
    """The words, A-Z in lower case, and the end token."""
    return F.array_append(words(ascii_lower(F.coalesce(text, F.lit("")))), F.lit(END))


def token_hashes(text: Column) -> Column:
    return F.transform(tokens(text), lambda word: F.xxhash64(word))


def _mix(prefix: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of an n-gram from the hash of the other words and that of one more."""
    x = (prefix ^ (prefix >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + word
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _find(sorted_keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Place of each key, or -1."""
    if not len(sorted_keys):
        return np.full(len(wanted), -1)
    at = np.searchsorted(sorted_keys, wanted)
    at[at == len(sorted_keys)] = 0
    return np.where(sorted_keys[at] == wanted, at, -1)


def _groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of each entry's group of equal keys, and the place of one entry per group."""
    order = np.argsort(keys)
    own = keys[order]
    first = np.ones(len(own), dtype=bool)
    first[1:] = own[1:] != own[:-1]
    group = np.empty(len(own), dtype=np.int32)
    group[order] = np.cumsum(first) - 1
    return group, order[first]


def _squeeze(values: np.ndarray) -> bytes:
    """Compressed bytes of numbers, all first bytes before all second ones."""
    values = np.ascontiguousarray(values)
    return pa.compress(values.view(np.uint8).reshape(-1, values.itemsize).T.tobytes(), codec="zstd", asbytes=True)


def _expand(data: bytes, size: int, dtype: type) -> np.ndarray:
    width = np.dtype(dtype).itemsize
    flat = pa.decompress(data, decompressed_size=size * width, codec="zstd", asbytes=True) if size else b""
    return np.ascontiguousarray(np.frombuffer(flat, dtype=np.uint8).reshape(width, size).T).view(dtype).ravel()


class Words:
    """Words that tasks know by heart, from the most frequent on. A word's code is its place plus 1; 0 is no word, ``other`` any other."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        by_count = np.lexsort((keys, -counts))
        self.keys, self.counts = keys[by_count], counts[by_count]
        self.order = np.argsort(self.keys)
        self.sorted, self.other = self.keys[self.order], len(keys) + 1

    def codes(self, hashes: np.ndarray) -> np.ndarray:
        at = _find(self.sorted, hashes)
        return np.where(at < 0, self.other, (self.order[at] if len(self.order) else at) + 1).astype(np.uint32)

    def pack(self, codes: np.ndarray, hashes: np.ndarray) -> list[bytes]:
        return [_squeeze(codes), _squeeze(hashes[codes == self.other])]

    def unpack(self, body: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
        """Codes and hashes."""
        codes = _expand(body[0], size, np.uint32)
        hashes = np.r_[np.uint64(0), self.keys, np.uint64(0)][codes]
        others = codes == self.other
        hashes[others] = _expand(body[1], np.count_nonzero(others), np.uint64)
        return codes, hashes


class Split:
    """Split contexts by key, with how often they occur and log10 of what an unlisted word costs; ``homes``: parts of the first words known by heart."""

    def __init__(self, rows: list[tuple[int, int, float]] = ()):
        rows = sorted((key % (1 << 64), n, leave) for key, n, leave in rows)
        self.keys, self.n, self.leave = (np.array([row[place] for row in rows], kind) for place, kind in enumerate((np.uint64, np.int64, np.float64)))
        self.homes = np.zeros(0, np.int32)

    def settle(self, words_: Words, parts: int) -> None:
        """Deal frequent words to the parts, the most frequent first, each to the part with the fewest tokens."""
        counts = words_.counts[words_.counts >= PART / 50]
        loads = [(0, part) for part in range(parts)]
        self.homes = np.zeros(len(counts), np.int32)
        for place, n in enumerate(counts.tolist()):
            load, self.homes[place] = loads[0]
            heapq.heapreplace(loads, (load + (n if n <= HOT * PART else 0), int(self.homes[place])))

    def levels(self, codes: list[np.ndarray], hashes: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Per length of the context, its key at each token and whether it is split."""
        inside, key = np.ones(len(codes[0]), dtype=bool), None
        for own, words_ in zip(codes[1:], hashes[1:]):
            key = words_ if key is None else _mix(key, words_)
            inside = inside & (own > 0)
            inside[inside] = _find(self.keys, key[inside]) >= 0
            yield key, inside


def _pack_texts(known, room: int, id_type: pa.DataType):
    """Task code: (id, mark, token hashes) to a row per text, with what is known of its score at once, and a row per chunk of texts."""
    names = ["id", "mark", "n_tokens", "n_known", "base_score", "row", "chunk", "size", "body"]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << CHUNK_BITS
        for batch in batches:
            sizes_of = batch.column(2).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            flat_of, ends = batch.column(2).flatten().to_numpy(zero_copy_only=False).view(np.uint64), np.r_[0, np.cumsum(sizes_of)]
            begin = 0
            while begin < batch.num_rows:
                end = min(batch.num_rows, int(np.searchsorted(ends, ends[begin] + CHUNK)))
                flat, sizes = flat_of[ends[begin] : ends[end]], sizes_of[begin:end]
                part, n = batch.slice(begin, end - begin), end - begin
                codes = known.value.codes(flat)
                counts = np.r_[0, known.value.counts, 0][codes]
                starts = np.r_[0, np.cumsum(sizes)[:-1]]
                columns = [
                    part.column(0),
                    part.column(1),
                    pa.array(sizes),
                    pa.array(np.add.reduceat((counts > 0).astype(np.int64), starts)),
                    pa.array(np.add.reduceat(np.log10(counts + 1.0) - math.log10(room), starts)),
                    pa.array((number << ROW_BITS) + np.arange(n)),
                    *(pa.nulls(n, kind) for kind in (pa.int64(), pa.int64(), pa.list_(pa.binary()))),
                ]
                yield pa.RecordBatch.from_arrays(columns, names)
                marks = part.column(1).to_numpy(zero_copy_only=False).astype(np.uint8)
                body = [_squeeze(marks), _squeeze(sizes), *known.value.pack(codes, flat)]
                whole = [pa.nulls(1, id_type), pa.nulls(1, pa.int32()), *(pa.nulls(1, kind) for kind in (pa.int64(), pa.int64(), pa.float64()))]
                whole += [pa.array([n], pa.int64()), pa.array([number], pa.int64()), pa.array([len(flat)], pa.int64()), pa.array([body], pa.list_(pa.binary()))]
                yield pa.RecordBatch.from_arrays(whole, names)
                number, begin = number + 1, end

    return pack


def _windows(words_: Words, row: dict, depth: int, parts: int, split: Split) -> tuple[np.ndarray, ...]:
    """Marks of a chunk's texts, the text of each token, its part, and codes and hashes of the token and the words before it, each by distance."""
    marks, sizes = _expand(row["body"][0], row["row"], np.uint8), _expand(row["body"][1], row["row"], np.int64)
    codes, hashes = words_.unpack(row["body"][2:], row["size"])
    text = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    all_codes, all_hashes = [codes], [hashes]
    for back in range(1, depth + 1):
        for own in (all_codes, all_hashes):
            own.append(np.concatenate([np.zeros(1, own[-1].dtype), own[-1][:-1]]))
            own[-1][place == back - 1] = 0
    # the first token of a text belongs to no word
    route, inside = np.where(place > 0, _mix(all_hashes[1], np.uint64(1)), text.astype(np.uint64)), None
    for key, within in split.levels(all_codes, all_hashes) if len(split.keys) else ():
        route = route if inside is None else np.where(inside, key, route)
        inside = within
    if inside is not None:
        route = np.where(inside, _mix(route, text.astype(np.uint64)), route)
    part = route % np.uint64(parts)
    homely = (all_codes[1] > 0) & (all_codes[1] <= len(split.homes))
    if inside is not None:
        homely &= _find(split.keys, all_hashes[1]) < 0
    part[homely] = split.homes[all_codes[1][homely] - 1]
    return marks, text, part.astype(np.int32), all_codes, all_hashes


def _chunk_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for place in range(batch.num_rows):
            yield batch.slice(place, 1).to_pylist()[0]


def _ask(known, depth: int, parts: int, split: Split):
    """Task code: parts and the words and n-grams of split contexts they must be told of, once per chunk."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _chunk_rows(batches):
            _, _, part, codes, hashes = _windows(known.value, row, depth, parts, split)
            others = codes[0] == known.value.other
            wanted = [(part[others], hashes[0][others])]
            for key, inside in split.levels(codes, hashes) if len(split.keys) else ():
                wanted.append((part[inside], _mix(key[inside], hashes[0][inside])))
            part, keys = (np.concatenate(own) for own in zip(*wanted))
            _, at = _groups(_mix(keys, part.astype(np.uint64)))
            yield pa.RecordBatch.from_arrays([pa.array(part[at]), pa.array(keys[at].view(np.int64))], ["part", "key"])

    return ask


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task code: (part, key, n) packed by part."""
    for batch in batches:
        part, keys, n = (batch.column(place).to_numpy(zero_copy_only=False) for place in range(3))
        order, cuts = _by_part(part)
        part, keys, n = part[order], keys[order], n[order]
        yield from _part_rows(part, cuts, -1, lambda at: [_squeeze(keys[at]), _squeeze(n[at])])


def _deal(known, depth: int, parts: int, split: Split):
    """Task code: windows of a chunk packed by part."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _chunk_rows(batches):
            marks, text, part, codes, hashes = _windows(known.value, row, depth, parts, split)

            order, cuts = _by_part(part)
            text, codes, hashes = text[order], [own[order] for own in codes], [own[order] for own in hashes]
            shared = [_squeeze(marks), _squeeze(np.array([len(marks)]))]

            def body(at):
                packed = [known.value.pack(own[at], hash_[at]) for own, hash_ in zip(codes, hashes)]
                return [*shared, _squeeze(np.diff(text[at], prepend=0).astype(np.uint32)), *(piece for own in packed for piece in own)]

            yield from _part_rows(part[order], cuts, row["chunk"], body)

    return deal


def _count_hot(known, length: int, depth: int, hot: Split):
    """Task code: n-grams after hot contexts of ``length`` words, with their suffixes and their keys as contexts, counted by chunk."""
    names = ["context", "suffix", "gram", "shorter", "key", "longer", "n"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _chunk_rows(batches):
            marks, text, _, codes, hashes = _windows(known.value, row, depth, 1, Split())
            at = np.flatnonzero(((marks[text] & LEARN) > 0) & (codes[length] > 0))
            token, *before = (own[at] for own in hashes[: length + 1])
            chain, longer = [before[0]], _mix(token, before[0])
            for word in before[1:]:
                chain.append(_mix(chain[-1], word))
                longer = _mix(longer, word)
            found = np.flatnonzero(_find(hot.keys, chain[-1]) >= 0)
            group, one = _groups(_mix(chain[-1][found], token[found]))
            at = found[one]
            suffix = chain[-2][at] if length > 1 else np.zeros(len(at), np.uint64)
            columns = (chain[-1][at], suffix, _mix(chain[-1][at], token[at]), _mix(suffix, token[at]), token[at], longer[at])
            yield pa.RecordBatch.from_arrays([*(pa.array(own.view(np.int64)) for own in columns), pa.array(np.bincount(group, minlength=len(one)))], names)

    return count


def _split_contexts(chunks: DataFrame, counts: DataFrame, known, total: int, room: int, depth: int, divergence: float, least_word: float, least: float):
    """The contexts to split, and a table (key, n) of the n-grams after them; at most total / (HOT * PART) contexts of a length reach the driver."""
    words_, rows, told, before = known.value, [], None, None
    keys = words_.keys[words_.counts >= max(HOT * PART + 1, least_word * total)]
    allowed = {0}
    for length in range(1, depth + 1):
        hot = Split([(int(key), 0, 0.0) for key in keys])
        if not len(hot.keys) or not allowed:
            break
        found = chunks.mapInArrow(_count_hot(known, length, depth, hot), "context long, suffix long, gram long, shorter long, key long, longer long, n long")
        found = saved(found.groupBy("gram").agg(*[F.max(name).alias(name) for name in ("context", "suffix", "shorter", "key", "longer")], F.sum("n").alias("n")))
        if before is None:
            below = counts.select("key", ((F.col("n") + 1) / room).alias("q"), (F.col("n") >= least_word * total).alias("counted"))
            joined = found.join(below, "key")
        else:
            joined = found.join(before.select(F.col("gram").alias("shorter"), F.col("p").alias("q"), "counted"), "shorter")
        whole = F.broadcast(found.groupBy("context").agg(F.sum("n").alias("context_n")))
        before = saved(joined.join(whole, "context").withColumn("p", (F.col("n") - DISCOUNT) / F.col("context_n")))
        listed = F.col("counted") & (F.col("n") >= least)
        sums = before.where(listed).groupBy("context", "suffix", "context_n").agg(
            F.sum("p").alias("mass"), F.sum("q").alias("taken"), F.sum(F.col("p") * F.log(F.col("p") / F.col("q"))).alias("information")
        )
        rest = F.greatest(1 - F.col("mass"), F.lit(1e-12))
        leave = rest / (1 - F.least("taken", F.lit(1 - 1e-9)))
        kept = F.col("context_n") * (F.col("information") + rest * F.log(leave)) >= divergence
        states = [row for row in sums.where(kept).select("context", "suffix", "context_n", F.log10(leave).alias("leave")).collect() if row.suffix in allowed]
        rows += [(row.context, row.context_n, row.leave) for row in states]
        allowed = {row.context for row in states}
        own = before.select(F.col("gram").alias("key"), "n", "context").where(F.col("context").isin(list(allowed))).drop("context")
        told = own if told is None else told.unionByName(own)
        keys = before.where(listed & (F.col("n") > HOT * PART)).select("longer").toArrow().column(0).to_numpy().view(np.uint64)
    return Split(rows), told


def _by_part(part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by part and the bounds of the parts in it."""
    order = np.argsort(part.astype(np.uint16) if len(part) and part.max() < 1 << 16 else part, kind="stable")
    return order, np.r_[np.flatnonzero(np.diff(part[order], prepend=-1)), len(part)]


def _part_rows(part: np.ndarray, cuts: np.ndarray, chunk: int, body) -> Iterator[pa.RecordBatch]:
    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.binary()))
    for begin, end in zip(cuts, cuts[1:]):
        own = (part[begin], chunk, end - begin, body(slice(begin, end)))
        yield pa.RecordBatch.from_arrays([pa.array([value], kind) for value, kind in zip(own, kinds)], ["part", "chunk", "size", "body"])


class Level:
    """Contexts of one length over some windows: group of each window's context and n-gram, states, and log10 of costs."""

    def __init__(self, key, follower, weights, counted, below, least, divergence):
        """``below``: p of the token by the suffix, per window; ``counted``: whether the token can be listed."""
        self.context, self.one = _groups(key)
        self.gram, one_gram = _groups(_mix(key, follower))
        self.one_gram = one_gram
        many, of = len(self.one), self.context[one_gram]
        context_n = np.bincount(self.context, weights=weights, minlength=many)
        n = np.bincount(self.gram, weights=weights * counted, minlength=len(one_gram))
        self.listed = (n > 0) & (n >= least)
        p = (n - DISCOUNT) / np.maximum(context_n, 1)[of]
        self.p, self.log_p = p, np.log10(np.where(self.listed, p, 1.0))
        at = np.flatnonzero(self.listed)
        of, own, q = of[at], p[at], below[one_gram[at]]
        rest = np.maximum(1 - np.bincount(of, weights=own, minlength=many), 1e-12)
        leave = rest / (1 - np.minimum(np.bincount(of, weights=q, minlength=many), 1 - 1e-9))
        information = np.bincount(of, weights=own * np.log(own / q), minlength=many)
        self.state = (np.bincount(of, minlength=many) > 0) & (context_n * (information + rest * np.log(leave)) >= divergence)
        self.leave = np.log10(leave)

    def tell(self, split: Split, key, follower, counted, told_keys, told_n, least) -> Level:
        """Replace what the windows say of split contexts by what holds for all their parts."""
        found = _find(split.keys, key[self.one])
        of = self.context[self.one_gram]
        at = np.flatnonzero(found[of] >= 0)
        if len(at):
            self.state[found >= 0], self.leave[found >= 0] = True, split.leave[found[found >= 0]]
            one = self.one_gram[at]
            n = np.r_[told_n, 0][_find(told_keys, _mix(key[one], follower[one]))]
            self.listed[at] = counted[one] & (n > 0) & (n >= least)
            self.p[at] = (n - DISCOUNT) / split.n[found[of[at]]]
            self.log_p[at] = np.log10(np.where(self.listed[at], self.p[at], 1.0))
        return self

    def cost(self, shorter: np.ndarray) -> np.ndarray:
        """log10 of the probability of each window's token, given that by the suffix of the context."""
        own = np.where(self.listed[self.gram], self.log_p[self.gram], self.leave[self.context] + shorter)
        return np.where(self.state[self.context], own, shorter)


def _longer_levels(first: Level, place, hashes, valid, weights, counted, below, least, divergence, split, told) -> tuple[np.ndarray, np.ndarray]:
    """Contexts of two words and more over windows at ``place`` that hold all their occurrences; marks the states among their suffixes.

    Returns the cost as (a, b), to be read as a + b * cost by the last word alone.
    """
    levels, inside, key = [], [], hashes[1][place]
    at = np.arange(len(place))
    q = below[place]
    for length in range(2, len(hashes)):
        there = valid[length][place[at]]
        at, key, q = at[there], key[there], q[there]
        key = _mix(key, hashes[length][place[at]])
        own = place[at]
        level = Level(key, hashes[0][own], weights[own], counted[own], q, least, divergence)
        level.tell(split, key, hashes[0][own], counted[own], *told, least)
        levels.append(level)
        inside.append(at)
        q = level.p[level.gram]
    for upper in range(len(levels) - 1, 0, -1):  # the suffix of a state is a state
        longer, shorter = levels[upper], levels[upper - 1]
        ends = inside[upper][longer.one[longer.state]]
        shorter.state[shorter.context[np.searchsorted(inside[upper - 1], ends)]] = True
    a, b = np.zeros(len(place)), np.ones(len(place))
    for level, at in zip(levels, inside):
        hit = level.state[level.context] & level.listed[level.gram]
        a[at] = level.cost(a[at])
        b[at[hit]] = 0.0
    if levels:
        first.state[first.context[place[inside[0][levels[0].one[levels[0].state]]]]] = True
    return a, b


def _grow(known, total: int, room: int, depth: int, divergence: float, least_word: float, least_gram: float, split: Split):
    """Task code: the windows of a part, and the words it was told of, to sums per text, packed by chunk.

    Sums are of the score and, for words that tasks do not know by heart, of log10(n + 1) and of those seen at all.
    """

    def grow(table: pa.Table) -> pa.Table:
        words_, least = known.value, least_gram * total
        rows = sorted(table.to_pylist(), key=lambda row: row["chunk"])
        told, rows = [row for row in rows if row["chunk"] < 0], [row for row in rows if row["chunk"] >= 0]
        told_keys, told_n = (np.concatenate([np.zeros(0, kind), *(_expand(row["body"][place], row["size"], kind) for row in told)]) for place, kind in ((0, np.uint64), (1, np.int64)))
        told_keys, at = np.unique(told_keys, return_index=True)
        told_n = told_n[at]
        all_words = least_word * total <= 1  # otherwise all common words are known by heart
        common = np.r_[False, words_.counts >= least_word * total, all_words]
        counts = np.r_[0, words_.counts, 0]

        size = sum(row["size"] for row in rows)
        text, learns, n, other = np.zeros(size, np.int32), np.zeros(size, bool), np.zeros(size, np.int64), np.zeros(size, bool)
        hashes, valid = [np.zeros(size, np.uint64) for _ in range(depth + 1)], [np.zeros(size, bool) for _ in range(depth + 1)]
        texts, end, asked = [0], 0, []
        for row in rows:
            body, here = row["body"], slice(end, end + row["size"])
            marks = _expand(body[0], int(_expand(body[1], 1, np.int64)[0]), np.uint8)
            asked.append((marks & SCORE).any())
            own = np.cumsum(_expand(body[2], row["size"], np.uint32))
            text[here], learns[here] = texts[-1] + own, (marks[own] & LEARN) > 0
            for back in range(depth + 1):
                codes, hashes[back][here] = words_.unpack(body[3 + 2 * back : 5 + 2 * back], row["size"])
                valid[back][here] = common[codes]
                if back == 0:
                    n[here], other[here] = counts[codes], codes == words_.other
            texts.append(texts[-1] + len(marks))
            end, row["body"] = here.stop, None

        others = np.flatnonzero(other)
        found = _find(told_keys, hashes[0][others])
        n[others[found >= 0]] = told_n[found[found >= 0]]
        value = np.log10((n + 1) / room)
        n_others = n[others]

        held = np.flatnonzero(valid[1]).astype(np.int32)
        if len(held):
            if len(held) < size:
                for own in (hashes, valid):
                    for back in range(depth + 1):
                        own[back] = own[back][held]
                learns, n = learns[held], n[held]
            first = Level(hashes[1], hashes[0], learns, valid[0], (n + 1) / room, least, divergence)
            del n
            first.tell(split, hashes[1], hashes[0], valid[0], told_keys, told_n, least)
            below = first.p[first.gram]
            longer = np.flatnonzero(valid[2]).astype(np.int32) if depth > 1 else held[:0]
            slices = math.ceil(len(longer) / SLICE)
            a, b = np.zeros(len(held)), np.ones(len(held), dtype=bool)
            which = ((_mix(hashes[1][longer], hashes[2][longer]) >> np.uint64(32)) % np.uint64(slices)).astype(np.int32) if slices else None
            for number in range(slices):
                place = longer[which == number]
                a[place], b[place] = _longer_levels(first, place, hashes, valid, learns, valid[0], below, least, divergence, split, (told_keys, told_n))
            del hashes, valid, below, longer, which
            value[held] = a + b * first.cost(value[held])
            del a, b, first

        sums = [np.bincount(text, weights=value, minlength=texts[-1])]
        for own in (np.log10(n_others + 1.0), (n_others > 0).astype(np.float64)):
            sums.append(np.bincount(text[others], weights=own, minlength=texts[-1]))
        sent = [(row["part"], row["chunk"], b - a, [_squeeze(own[a:b]) for own in sums]) for row, a, b, wanted in zip(rows, texts, texts[1:], asked) if wanted]
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.binary()))
        return pa.table([pa.array([own[place] for own in sent], kind) for place, kind in enumerate(kinds)], names=["part", "chunk", "size", "body"])

    return grow


def _add_up(table: pa.Table) -> pa.Table:
    """Task code: sums of the texts of a chunk over all parts."""
    rows = sorted(table.to_pylist(), key=lambda row: row["part"])
    size = rows[0]["size"]
    score, more, seen = (sum(_expand(row["body"][place], size, np.float64) for row in rows) for place in range(3))
    row_ids = (rows[0]["chunk"] << ROW_BITS) + np.arange(size)
    return pa.table([pa.array(row_ids), pa.array(score), pa.array(more), pa.array(seen.astype(np.int64))], names=["row", "score", "more", "more_known"])


def _known_words(counts: DataFrame, least: float) -> tuple[Words, int]:
    """The most frequent words, ``KNOWN_WORDS`` at most, and the count from which on words are among them.

    Words with a count of ``least`` or more, if that is above 1, are added.
    """
    steps = sorted({step << power for power in range(40) for step in (4, 5, 6, 7)} | {1, 2, 3})
    many = counts.agg(*[F.count(F.when(F.col("n") >= step, 1)) for step in steps]).first()
    enough = next(step for step, n in zip(steps, many) if n <= KNOWN_WORDS)
    found = counts.where(F.col("n") >= (min(enough, least) if least > 1 else enough)).toArrow()
    return Words(found.column(0).to_numpy().view(np.uint64), found.column(1).to_numpy()), enough


def score_texts(
    docs: DataFrame,
    training: DataFrame | Column,
    id_column: str = "doc_id",
    text_column: str = "text",
    least_word: float = 0.0,
    least_gram: float = 0.0,
    depth: int = DEPTH,
    divergence: float = DIVERGENCE,
) -> DataFrame:
    """Scores of ``docs`` under a tree learnt from ``training``, one row per document.

    ``training``: a table, or the condition for the rows of ``docs`` to learn from, which then move only once.
    Columns: id, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` and ``score`` (log10).
    """
    spark = docs.sparkSession
    id_type = docs.schema[id_column].dataType
    text = F.col(text_column).alias("text")
    if isinstance(training, Column):
        mark = F.when(training, F.lit(LEARN | SCORE)).otherwise(F.lit(SCORE))
        rows = docs.select(F.col(id_column).alias("id"), mark.alias("mark"), text)
    else:
        lessons = training.select(F.lit(None).cast(id_type).alias("id"), F.lit(LEARN).alias("mark"), text)
        rows = docs.select(F.col(id_column).alias("id"), F.lit(SCORE).alias("mark"), text).unionByName(lessons)
    hashed = rows.select("id", "mark", token_hashes(F.col("text")).alias("ids"))
    learnt = rows.where(F.col("mark").bitwiseAND(LEARN) > 0).select(F.explode(tokens(F.col("text"))).alias("word"))
    counts = saved(learnt.groupBy(F.xxhash64("word").alias("key")).agg(F.count(F.lit(1)).alias("n")))
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    room = total + distinct + 1
    by_heart, enough = _known_words(counts, least_word * total)
    known = spark.sparkContext.broadcast(by_heart)

    arrow_id = hashed.limit(0).select("id").toArrow().schema.field(0).type
    schema = f"id {id_type.simpleString()}, mark int, n_tokens long, n_known long, base_score double, row long, {PACKED}"
    texts = saved(hashed.mapInArrow(_pack_texts(known, room, arrow_id), schema))
    parts = max(1, math.ceil((texts.agg(F.sum("n_tokens")).first()[0] or 0) / PART))
    chunks = texts.where("chunk is not null").select("row", "chunk", "size", "body")

    split, grams = _split_contexts(chunks, counts, known, total, room, depth, divergence, least_word, least_gram * total)
    split.settle(by_heart, parts)
    facts = counts.where(F.col("n") < enough)
    facts = facts if grams is None else facts.unionByName(grams)
    asked = chunks.mapInArrow(_ask(known, depth, parts, split), "part int, key long").join(facts, "key")
    told = asked.select("part", "key", "n").mapInArrow(_answer, f"part int, {PACKED}")
    dealt = chunks.mapInArrow(_deal(known, depth, parts, split), f"part int, {PACKED}").unionByName(told)
    grown = dealt.groupBy("part").applyInArrow(_grow(known, total, room, depth, divergence, least_word, least_gram, split), f"part int, {PACKED}")
    sums = grown.groupBy("chunk").applyInArrow(_add_up, "row long, score double, more double, more_known long")
    return texts.where(f"chunk is null and mark & {SCORE} > 0").drop("chunk", "size", "body").join(sums.withColumnRenamed("score", "whole"), "row", "left").select(
        F.col("id").alias(id_column),
        "n_tokens",
        (F.col("n_known") + F.col("more_known")).alias("n_known"),
        F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("base_score") + F.col("more")).alias("base_score"),
        F.col("whole").alias("score"),
    )


ship_by_value(__name__)
