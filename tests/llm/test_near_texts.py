"""Near copies of whole texts against comparing every pair."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest

import corpus_pipeline
from sparkbi.llm import near_texts as module
from sparkbi.llm.near_texts import keep_one, near_texts

FOLDER = "/root/testdata/sf0.001"
WORDS = [f"w{n}" for n in range(3000)]


def shingles(text):
    words = (text or "").translate({n: n + 32 for n in range(65, 91)}).split()
    width = min(5, len(words))
    return frozenset(tuple(words[at : at + width]) for at in range(len(words) - width + 1)) if words else frozenset()


def brute(rows):
    """Component (smallest id) per row and the pairs of different shingle sets at 0.8 or more."""
    sets, parent, pairs = [shingles(text) for _, text in rows], list(range(len(rows))), 0

    def root(at):
        while parent[at] != at:
            at = parent[at]
        return at

    for a in range(len(rows)):
        for b in range(a):
            shared = len(sets[a] & sets[b])
            if sets[a] == sets[b] or shared >= 0.8 * (len(sets[a]) + len(sets[b]) - shared):
                parent[root(a)] = root(b)
                pairs += sets[a] != sets[b]
    least = defaultdict(list)
    for at, (number, _) in enumerate(rows):
        least[root(at)].append(number)
    return [min((n for n in least[root(at)] if n is not None), default=None) for at in range(len(rows))], pairs


def edited(words, edits, chance):
    words = list(words)
    for at in chance.sample(range(len(words)), edits):
        words[at] = f"edit{chance.randrange(10**9)}"
    return words


def planted(chance, originals, variants, edits):
    rows = []
    for _ in range(originals):
        base = chance.choices(WORDS, k=chance.randrange(60, 240))
        rows.append((len(rows), " ".join(base)))
        for _ in range(variants):
            rows.append((len(rows), " ".join(edited(base, chance.randrange(edits + 1), chance))))
    return rows


@pytest.mark.parametrize("part", [module.PART, 3])
def test_edited_copies_against_brute_force(spark, monkeypatch, part):
    monkeypatch.setattr(module, "PART", part)
    chance = random.Random(5)
    rows = planted(chance, 25, 3, 8)
    crowd = chance.choices(WORDS, k=200)
    rows += [(1000 + n, " ".join(edited(crowd, 1, chance))) for n in range(30)]  # one crowded shard, divided when parts are small
    odd = [(2000, None), (2001, ""), (2002, " \t\n"), (2003, "Zwei Wörter"), (2004, "zwei  wörter"), (2005, "ZWEI WÖRTER"), (None, rows[0][1]), (0, rows[0][1])]
    rows += odd + [(3000, rows[4][1].upper()), (3001, " ".join(chance.choices(WORDS, k=30_000)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    docs = docs.selectExpr("*", "1 as n", "'kept' as klass", "2 as component")
    found = near_texts(docs).collect()
    expected, pairs = brute(rows)
    assert pairs > 200
    got = sorted((row.doc_id is None, row.doc_id or 0, row.component_id) for row in found)
    assert got == sorted((number is None, number or 0, least) for (number, _), least in zip(rows, expected))
    kept = keep_one(docs, near_texts(docs))
    assert kept.columns == docs.columns
    assert sorted(row.doc_id for row in kept.collect()) == sorted(set(expected))


def test_recall_of_pairs_at_the_threshold(spark):
    """Pairs alone, spread over similarities from 0.8: at least 0.9 of them are found and none below."""
    chance, rows = random.Random(11), []
    for number in range(400):
        base = chance.choices(WORDS, k=chance.randrange(80, 300))
        for at, words in enumerate((base, edited(base, max(1, len(base) * (number % 5) // 200), chance))):
            rows.append((2 * number + at, " ".join(words)))
    component = {row.doc_id: row.component_id for row in near_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    near = found = 0
    for (a, text), (b, other) in zip(rows[::2], rows[1::2]):
        shared = len(shingles(text) & shingles(other))
        close = shared >= 0.8 * (len(shingles(text)) + len(shingles(other)) - shared)
        linked = component[a] == component[b]
        assert close or not linked
        near, found = near + close, found + linked
    assert near > 250 and found >= 0.97 * near


def test_stage_takes_edited_copies_and_leaves_others(spark):
    chance = random.Random(3)
    rows = [(number, " ".join(chance.choices(WORDS, k=150)), f"s{number % 3}") for number in range(40)]
    passage = " ".join(chance.choices(WORDS, k=60))
    rows += [(100 + number, passage + " " + " ".join(chance.choices(WORDS, k=200)), "shared passage") for number in range(40)]
    near = [(200 + number, " ".join(edited(rows[number][1].split(), 3, chance)), "near") for number in range(40)]
    docs = spark.createDataFrame(rows + near + rows[:5], "doc_id long, text string, source string")
    kept = corpus_pipeline.near_copies_stage(spark, docs, FOLDER).collect()
    assert sorted(row.doc_id for row in kept) == sorted(row[0] for row in rows)
    assert near_texts(docs.where("false")).count() == 0
