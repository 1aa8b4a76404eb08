"""What every operator does with nulls, empty and very long texts, repeated rows, clashing columns and empty tables."""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sparkbi.llm.bk_tree import near_copies
from sparkbi.llm.fingerprints import count_neighbours, edited_fingerprints
from sparkbi.llm.language import UNKNOWN, identify, learn_profiles
from sparkbi.llm.mixing import mix, mixed_documents
from sparkbi.llm.packing import pack, plan_packing
from sparkbi.llm.sharding import shard_by_bytes
from sparkbi.llm.token_counts import apply_edits, with_trees

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()
GAP = r"[^\x20\x09-\x0D]+"


def prose(seed, n):
    state, made = seed * 2654435761 % 2**32 + 1, []
    for _ in range(n):
        state = (state * 1664525 + 1013904223) % 2**32
        made.append(WORDS[state // 65536 % len(WORDS)])
    return " ".join(made)


def odd_rows():
    """(doc_id, text, lang, source, and columns named like those the operators make)."""
    texts = {number: prose(number, 5 + number * 3) for number in range(40)}
    texts |= {40: None, 41: "", 42: " \t\n", 43: "one", 44: "One two", 45: prose(3, 14), 46: texts[7], 47: "É ½ 中文 <|endoftext|>", 48: prose(9, 9000), 49: "x" * 60_000}
    rows = [(number, text, (None, "la", "gr")[number % 3], (None, "a", "b", "c")[number % 4]) for number, text in texts.items()]
    rows += [rows[5], rows[5], (None, "no id here at all", "la", "a"), (None, None, None, None), (7, "same id but other text", "gr", "b")]
    return [(*row, 1.5, "clash", 7, "clash", 3) for row in rows]


SCHEMA = "doc_id long, text string, lang string, source string, score double, fingerprint string, size int, lang_pred string, block int"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(6)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def test_empty_tables(nothing):
    path = public_tokenizers.path("word_bpe_49k.json")
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    assert edited_fingerprints(nothing).count() == 0
    assert pack(nothing, path).count() == 0
    assert shard_by_bytes(nothing).count() == 0
    assert identify(nothing, learn_profiles(nothing)).count() == 0
    assert mix(nothing).count() == 0 and mixed_documents(nothing).count() == 0
    assert near_copies(nothing).count() == 0
    assert apply_edits(with_trees(nothing, ranks), ranks, F.array().cast("array<struct<at:int,drop:int,put:string>>")).count() == 0


# fingerprints


def simhash(terms):
    votes, total = [0] * 64, sum(weight for _, weight in terms)
    for term, weight in terms:
        number = xxhash.xxh64(term.encode(), seed=42).intdigest()
        for bit in range(64):
            votes[bit] += weight * (number >> bit & 1)
    return sum(1 << bit for bit in range(64) if 2 * votes[bit] > total)


def pair_fingerprint(text):
    words = re.findall(GAP, text.lower())
    terms = [" ".join(words[at : at + 2]) for at in range(max(1, len(words) - 1))] if words else []
    return simhash([(term, len(term)) for term in terms])


def signed(number):
    return number - 2**64 if number >> 63 else number


def test_edited_fingerprints(docs):
    text_hash = lambda text: signed(xxhash.xxh64(text.encode(), seed=42).intdigest())
    rows = [(row[0], row[1] or "") for row in odd_rows()]
    rows.sort(key=lambda row: (row[0] is not None, row[0] or 0, text_hash(row[1])))
    want = Counter()
    for place, (number, text) in enumerate(rows):
        following = rows[(place + 1) % len(rows)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        own, other, next_ = map(pair_fingerprint, (text, edited, following))
        near = [1 - (own ^ value).bit_count() / 64 for value in (other, next_)]
        want[(number, len(text), hashlib.sha256(edited.encode()).hexdigest(), signed(own), signed(other), *near)] += 1
    assert Counter(map(tuple, edited_fingerprints(docs).collect())) == want


@pytest.mark.parametrize("radius", [1, 3, 5])
def test_neighbours(spark, radius):
    base = [hash_ * 0x9E3779B97F4A7C15 % 2**64 for hash_ in range(1, 60)]
    numbers = base + [value ^ (1 << value % 61) ^ (1 << value % 13) for value in base[:30]] + [value ^ 0xF0F for value in base[:5]] + base[:3]
    found = spark.createDataFrame([(place, signed(value)) for place, value in enumerate(numbers)], "doc_id long, fingerprint long")
    got = {row.doc_id: row.n_near for row in count_neighbours(found, F.col("doc_id") % 2 == 0, radius).collect()}
    for place, value in enumerate(numbers):
        near = sum((value ^ other).bit_count() <= radius for other in numbers) - 1
        assert got[place] == (near if place % 2 == 0 else None)


# near copies


def test_near_copies(docs):
    def words(text):
        return re.findall(GAP, "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))

    def fingerprint(text):
        own = words(text)
        return simhash([(" ".join(own[at : at + 3]), 1) for at in range(max(1, len(own) - 2))] if own else [])

    rows = [(row[0], fingerprint(row[1])) for row in odd_rows()]
    numbers = sorted({value for _, value in rows})
    parent = {value: value for value in numbers}
    for a in numbers:
        for b in numbers:
            if (a ^ b).bit_count() <= 3:
                low, high = sorted((parent[a], parent[b]))
                parent = {value: low if root == high else root for value, root in parent.items()}
    least = defaultdict(list)
    for number, value in rows:
        least[parent[value]].append(number)
    smallest = {root: min((n for n in own if n is not None), default=None) for root, own in least.items()}
    want = Counter((number, signed(value), smallest[parent[value]], len(least[parent[value]])) for number, value in rows)
    got = near_copies(docs).select("doc_id", "fingerprint", "component_id", "group_rows").collect()
    assert Counter(map(tuple, got)) == want


def test_divided_shards(spark, monkeypatch):
    """A chain of near copies larger than a part keeps all its links."""
    import sparkbi.llm.bk_tree as module

    monkeypatch.setattr(module, "PART", 7)
    chain = [(1 << place) - 1 for place in range(0, 60, 3)] + [0xABCD << 40 | place for place in range(40)]
    links = module.near_links(spark.createDataFrame([(signed(value),) for value in chain], "fingerprint long"), 3)
    found = {tuple(row) for row in module.connected_components(links).collect()}
    assert {root for node, root in found if node in set(chain[:20])} == {0}
    assert len({root for node, root in found if node >> 40 == 0xABCD}) == 1
    assert len(found) == len(set(chain))


# packing


def test_packing(docs):
    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer, capacity = Tokenizer.from_file(path), 64
    want = Counter()
    for row in odd_rows():
        ids = [*tokenizer.encode(row[1] or "", add_special_tokens=False).ids, 1]
        for piece, start in enumerate(range(0, len(ids), capacity)):
            own = ids[start : start + capacity]
            want[(row[0], piece, start, len(own), zlib.crc32(struct.pack(f"<{len(own)}I", *own)))] += 1
    got = pack(docs, path, capacity=capacity).collect()
    assert Counter(tuple(row)[:5] for row in got) == want
    sequences = defaultdict(list)
    for row in got:
        sequences[row.sequence_id].append((row.offset, row.length))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(sequences) <= 1.02 * sum(row.length for row in got) / capacity + 1


def test_plan_pairs_large_pieces_best():
    """Pairs of pieces above a third are as many as can be."""
    counts = {60: 3, 55: 2, 45: 4, 40: 3, 35: 2, 1: 5}
    runs = plan_packing(counts, 100)
    used = {first + (rank - low) // each for _, low, high, each, first, _ in runs for rank in range(low, high)}
    assert len(used) == 7  # fourteen large pieces in pairs
    placed = Counter()
    for length, low, high, *_ in runs:
        placed[length] += high - low
    assert placed == Counter(counts)


# sharding


def test_sharding(docs, spark):
    got = shard_by_bytes(docs, shards=5).collect()
    want = Counter((row[0], len((row[1] or "").encode()) + 1, zlib.crc32((row[1] or "").encode())) for row in odd_rows())
    assert Counter((row.doc_id, row.size, row.text_crc32) for row in got) == want
    sizes, slots = Counter(), defaultdict(list)
    for row in got:
        sizes[row.shard] += row.size
        slots[row.shard].append((row.slot, row.doc_id is not None, row.doc_id or 0))
    assert all([slot for slot, *_ in sorted(own)] == list(range(len(own))) for own in slots.values())
    line = [entry[1:] for shard in sorted(slots) for entry in sorted(slots[shard])]
    assert line == sorted(line)  # shards follow the ids
    even = spark.range(1000).select(F.col("id").alias("doc_id"), F.lit("abc").alias("text"))
    assert Counter(row.shard for row in shard_by_bytes(even, 8).collect()) == Counter(dict.fromkeys(range(8), 125))


# language


def test_language_of_odd_rows(docs):
    got = identify(docs, learn_profiles(docs))
    assert [name for name in got.columns if name != "similarity"] == [n for n in docs.columns if n not in ("score", "lang_pred")] + ["lang_pred", "score"]
    for row in got.collect():
        lettered = any(c.isalpha() for c in row.text or "")
        assert (row.lang_pred == UNKNOWN) == (not lettered) and 0 <= row.score <= 1
        assert lettered or row.score == 0
    assert got.count() == len(odd_rows())


def test_language_profiles_count_exactly(spark):
    rows = [(1, "Ab ab!", "x"), (2, "a", "x"), (3, "zz", "y"), (4, None, "x"), (5, "ignored", None)]
    got = defaultdict(list)
    for row in learn_profiles(spark.createDataFrame(rows, "doc_id long, text string, lang string"), size=4).orderBy("lang", "place").collect():
        got[row.lang].append(row.code)
    grams = Counter()
    for text in ("ab ab", "a"):
        padded = f" {text} "
        grams.update(c for c in padded if c != " ")
        grams.update(padded[at : at + 2] for at in range(len(padded) - 1))
        grams.update(padded[at : at + 3] for at in range(len(padded) - 2) if padded[at + 1] != " ")
    code = lambda gram: sum(ord(c) << 21 * place for place, c in enumerate(reversed(gram)))
    assert got["x"] == [code(gram) for gram in sorted(grams, key=lambda gram: (-grams[gram], code(gram)))][:4]
    assert set(got) == {"x", "y"}


# mixing


def test_mixing(docs):
    got = mix(docs).collect()
    want = Counter((row[0], row[3], len(re.findall(GAP, row[1] or ""))) for row in odd_rows())
    assert Counter((row.doc_id, row.source, row.size) for row in got) == want
    total, taken = Counter(), Counter()
    for row in got:
        total[row.source] += row.size
        taken[row.source] += row.taken
        assert row.taken in (0, row.size, 2 * row.size)
    largest = max(row.size for row in got)
    targets = {row.source: row.target for row in got}
    assert sum(targets.values()) == pytest.approx(1.5 * sum(total.values()))
    for source, target in targets.items():
        assert abs(taken[source] - target) <= largest / 2 + 1 and target <= 2 * total[source] + 1e-6
    again = mix(docs.repartition(3)).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, got))
    documents = Counter((row.doc_id, row.text) for row in mixed_documents(docs).collect())
    copies = Counter()
    for row, original in zip(sorted(got, key=str), range(len(got))):
        copies[row.doc_id] += row.copies
    assert sum(documents.values()) == sum(copies.values())


def test_mixing_splits_equal_rows(spark):
    """A source of equal rows still comes near its target."""
    rows = spark.range(4000).select(F.lit(1).cast("long").alias("doc_id"), F.lit("five words in this text").alias("text"), F.when(F.col("id") < 3000, "a").otherwise("b").alias("source"))
    got = mix(rows, weights=(1, 5)).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()
    assert len(got) == 2 and all(abs(row.taken - row.target) <= 5 for row in got)


# token counts


def test_edit_counts(spark):
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    texts = [prose(n, n * 40) + "\n\n it's 42 ½\x1c" * (n % 3) for n in range(12)] + [None, "", "a" * 20_000, " \n "]
    rows = [(n, text, [(n * 17, 5, " new\n words"), (0, 1, None), (10**6, 3, "'re"), (n * 40, 200, "")]) for n, text in enumerate(texts)] + [(None, "no edits", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, edits array<struct<at:int,drop:int,put:string>>")
    trees = with_trees(docs, ranks)
    after = apply_edits(trees, ranks, F.col("edits"))
    fresh = {row.doc_id: row for row in with_trees(after.drop("leaf_chars", "leaf_tokens"), ranks).collect()}
    for row in after.collect():
        text = next(r[1] for r in rows if r[0] == row.doc_id) or ""
        for at, drop, put in next(r[2] for r in rows if r[0] == row.doc_id) or []:
            at = min(at, len(text))
            text = text[:at] + (put or "") + text[at + drop :]
        assert row.text == text and row.n_tokens == fresh[row.doc_id].n_tokens == sum(row.leaf_tokens)
        assert sum(row.leaf_chars) == len(text)


# shared helpers


def test_saved_tables_can_be_cleared(spark):
    from sparkbi.llm import common

    common.clear_saved(spark)
    made = common.saved(spark.range(5).withColumn("odd", F.col("id") % 2 == 1))
    assert made.where("odd").count() == 2 and len(common.SAVED) == 1
    assert common.clear_saved(spark) == 1 and not common.SAVED


def test_repeated_rows_in_runs(spark, monkeypatch):
    from sparkbi.llm import common

    monkeypatch.setattr(common, "RUN", 3)
    rows = spark.createDataFrame([("a", 0), ("b", 1), ("c", 3), ("d", 7), ("e", None)], "k string, n long")
    assert Counter(row.k for row in common.repeated(rows, F.col("n")).collect()) == Counter(b=1, c=3, d=7)
