from __future__ import annotations

import math
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from sparkbi.llm import common, suffix_tree
from sparkbi.llm.suffix_tree import DISCOUNT, held_out, score_texts

END = " "


def tokens(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", lowered), END]


class Brute:
    """The same tree with dictionaries."""

    def __init__(self, texts, least_word, least_gram, depth, divergence):
        lists = [tokens(text) for text in texts]
        self.words = Counter(word for own in lists for word in own)
        self.total, self.depth = sum(self.words.values()), depth
        common = {word for word, n in self.words.items() if n >= least_word * self.total}
        grams = Counter()
        for own in lists:
            for n in range(2, depth + 2):
                for at in range(len(own) - n + 1):
                    gram = tuple(own[at : at + n])
                    if set(gram) <= common:
                        grams[gram] += 1
        self.grams = {gram: n for gram, n in grams.items() if n >= least_gram * self.total}
        self.next = defaultdict(list)
        for gram in self.grams:
            self.next[gram[:-1]].append(gram[-1])
        self.states = set()
        for context in sorted(self.next, key=len, reverse=True):
            mass = sum(self.p(context, w) for w in self.next[context])
            taken = min(sum(self.q(context[1:], w) for w in self.next[context]), 1 - 1e-9)
            rest = max(1 - mass, 1e-12)
            gain = sum(self.p(context, w) * math.log(self.p(context, w) / self.q(context[1:], w)) for w in self.next[context])
            gain += rest * math.log(rest / (1 - taken))
            if self.count(context) * gain >= divergence:
                for start in range(len(context)):
                    self.states.add(context[start:])

    def count(self, context):
        return self.words[context[0]] if len(context) == 1 else self.grams[context]

    def p(self, context, word):
        return (self.grams[(*context, word)] - DISCOUNT) / self.count(context)

    def q(self, context, word):
        return self.p(context, word) if context else self.root(word)

    def root(self, word):
        return (self.words[word] + 1) / (self.total + len(self.words) + 1)

    def log(self, context, word):
        if not context:
            return math.log10(self.root(word))
        if context not in self.states:
            return self.log(context[1:], word)
        if (*context, word) in self.grams:
            return math.log10(self.p(context, word))
        mass = sum(self.p(context, w) for w in self.next.get(context, ()))
        taken = min(sum(self.q(context[1:], w) for w in self.next.get(context, ())), 1 - 1e-9)
        return math.log10(max(1 - mass, 1e-12) / (1 - taken)) + self.log(context[1:], word)

    def score(self, text):
        own = tokens(text)
        return sum(self.log(tuple(own[max(0, at - self.depth) : at]), word) for at, word in enumerate(own))

    def base(self, text):
        return sum(math.log10(self.root(word)) for word in tokens(text))


def texts_of(n):
    """A small language with habits: some words follow each other, some are rare."""
    words = "the cat sat on a mat and then it ran to see who was there".split()
    made, state = [], 7
    for number in range(n):
        own = []
        for _ in range(number % 23):
            state = (state * 1103515245 + 12345) % 2**31
            own += ["The", "cat", "sat", "on"] if state % 5 == 0 else [words[state // 7 % len(words)], f"rare{state % 97}" if state % 11 == 0 else "and"]
        made.append(" ".join(own) if number % 10 else "\t".join(own) + "\n")
    return made


@pytest.mark.parametrize("least_word,least_gram,divergence", [(0.0, 0.0, 3.0), (0.003, 0.004, 1.0), (0.02, 0.01, 50.0)])
def test_matches_brute_force(spark, least_word, least_gram, divergence):
    texts = [*texts_of(120), None, "", "  \n", "É À unseen words", "cat " * 3000, "x" * 50_000]
    rows = [(number, text) for number, text in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    training = docs.where(~held_out(F.col("doc_id")))
    brute = Brute([text for number, text in rows if zlib.crc32(str(number).encode()) % 7 != 2], least_word, least_gram, 3, divergence)
    got = {row.doc_id: row for row in score_texts(docs, training, least_word=least_word, least_gram=least_gram, divergence=divergence).collect()}
    assert len(got) == len(rows) and brute.states
    for number, text in rows:
        row = got[number]
        assert row.n_tokens == len(tokens(text)) and row.train_tokens == brute.total
        assert row.n_known == sum(brute.words[word] > 0 for word in tokens(text))
        assert row.base_score == pytest.approx(brute.base(text), rel=1e-9)
        assert row.score == pytest.approx(brute.score(text), rel=1e-9)


def test_probabilities_sum_to_one(spark):
    brute = Brute(texts_of(60), 0.0, 0.0, 2, 1.0)
    for context in [(), ("cat",), ("the", "cat"), ("sat", "on"), ("nowhere",)]:
        known = sum(10 ** brute.log(context, word) for word in brute.words)
        unseen = 10 ** brute.log(context, "never seen")
        assert known + unseen == pytest.approx(1)


def test_empty_tables_and_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 5), (None, "a b", 6), (2, "a a", 7), (2, "a a", 7)], "doc_id long, text string, row int")
    nothing = docs.where("false")
    assert score_texts(nothing, nothing).count() == 0
    alone = score_texts(docs, nothing).collect()
    assert sorted(row.n_tokens for row in alone) == [1, 3, 3, 3] and {row.score for row in alone} == {0.0}
    again = score_texts(docs, docs).collect()
    assert len(again) == 4 and len({(row.doc_id, row.score) for row in again}) == 3


def test_rare_contexts_stay_in_a_larger_corpus(spark):
    """A habit seen ten times is a state, whatever the corpus size: no n-gram needs a share of it."""
    docs = spark.range(150_000).selectExpr("id AS doc_id", "concat_ws(' ', transform(sequence(1, 20), x -> concat('w', hash(id, x) & 15))) AS text")
    habit = spark.createDataFrame([(-n, "odd bird sings twice") for n in range(1, 11)], "doc_id long, text string")
    found = score_texts(habit.where("doc_id = -1"), docs.unionByName(habit)).first()
    # after the first word each token follows with p = 9.5 / 10, as n-grams seen ten times in 3,150,050 tokens
    assert found.train_tokens == 3_150_050
    first = math.log10(11 / (3_150_050 + 21 + 1))
    assert found.score == pytest.approx(first + 4 * math.log10(0.95), rel=1e-9)


def test_parts_slices_and_chunks_match_brute_force(spark, monkeypatch):
    """Many parts of the tree, slices of a part, chunks of a task, and words that tasks do not know by heart."""
    for name, value in {"PART": 700, "SLICE": 50, "CHUNK": 40, "KNOWN_WORDS": 9}.items():
        monkeypatch.setattr(suffix_tree, name, value)
    rows = list(enumerate([*texts_of(120), None, "", "É À unseen words", "cat " * 300, *["sat on rare1 rare2 rare3"] * 5]))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    brute = Brute([text for number, text in rows if zlib.crc32(str(number).encode()) % 7 != 2], 0.0, 0.0, 3, 3.0)
    got = {row.doc_id: row for row in score_texts(docs, ~held_out(F.col("doc_id")), divergence=3.0).collect()}
    assert len(got) == len(rows) and any(len(state) == 3 for state in brute.states)
    for number, text in rows:
        row = got[number]
        assert (row.n_tokens, row.train_tokens) == (len(tokens(text)), brute.total)
        assert row.n_known == sum(brute.words[word] > 0 for word in tokens(text))
        assert row.base_score == pytest.approx(brute.base(text), rel=1e-9)
        assert row.score == pytest.approx(brute.score(text), rel=1e-9)


def test_disk_per_token(spark):
    """What is shuffled and saved for a token stays far below the hashes of its n-grams."""
    text = "concat_ws(' ', transform(sequence(1, 200), x -> concat('w', cast(pow(1.0004, hash(id, x) & 32767) as int))))"
    docs = spark.range(2_000).selectExpr("id AS doc_id", f"{text} AS text")
    driver = lambda: spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()
    before, tables = driver(), len(common.SAVED)
    n_tokens = score_texts(docs, docs).agg(F.sum("n_tokens")).first()[0]
    files = [file for path in common.SAVED[tables:] for file in Path(path.removeprefix("file:")).rglob("*.parquet")]
    assert n_tokens == 2_000 * 201 and files
    assert (driver() - before + sum(file.stat().st_size for file in files)) / n_tokens < 60


@pytest.mark.parametrize("divergence", [3.0, 200.0])
def test_hot_contexts_are_split(spark, monkeypatch, divergence):
    """A word, a pair and a triple in most rows are dealt to many parts, and no part keeps them; the scores stay."""
    for name, value in {"PART": 150, "SLICE": 50, "CHUNK": 40}.items():
        monkeypatch.setattr(suffix_tree, name, value)
    found = []
    split_contexts = suffix_tree._split_contexts
    monkeypatch.setattr(suffix_tree, "_split_contexts", lambda *given: found.append(split_contexts(*given)) or found[-1])
    hot = [f"{first} the cat sat {last}" for first in "abcdefghij" for last in "klmnopqrstuvwxyz0123456789" for _ in range(3)]
    rows = list(enumerate([*texts_of(90), *hot, "the cat sat unseen", "the cat", "unseen the cat sat k"]))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    brute = Brute([text for number, text in rows if zlib.crc32(str(number).encode()) % 7 != 2], 0.0, 0.0, 3, divergence)
    got = {row.doc_id: row for row in score_texts(docs, ~held_out(F.col("doc_id")), divergence=divergence).collect()}
    assert len(found[0][0].keys) > 2
    for number, text in rows:
        assert got[number].base_score == pytest.approx(brute.base(text), rel=1e-9)
        assert got[number].score == pytest.approx(brute.score(text), rel=1e-9)
