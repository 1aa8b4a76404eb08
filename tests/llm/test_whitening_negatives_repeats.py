from __future__ import annotations

import hashlib
import math
import os
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkbi.llm import hard_negatives as negatives_module, queries
from sparkbi.llm.hard_negatives import hard_negatives, open_children, plant
from sparkbi.llm.repeats import pack, rolling, unpack, without_repeats
from sparkbi.llm.whitening import covariance_from_variances, whitened

FOLDER = "/root/testdata/sf0.001"
sample = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="sample tables are not here")

VECTORS = "vec_id long, embedding array<float>, label int, n long, component int, _id string, chunk string, node int"


def table(spark, rows, spread=3):
    """Rows (id, vector, label) with columns whose names the operators use themselves."""
    return spark.createDataFrame([(*row, 7, 9, "x", "y", 3) for row in rows], VECTORS).repartition(spread)


ODD = [(901, None, 1), (902, [math.nan] * 4, 1), (903, [None, 1.0, 1.0, 1.0], 1), (904, [math.inf, 0.0, 0.0, 0.0], 1)]


# whitening


def test_whitening_against_exact_fractions(spark):
    random = np.random.default_rng(3)
    mixed = random.normal(size=(4, 4))
    vectors = (random.normal(size=(60, 4)) @ mixed).astype(np.float32)
    rows = [(at, [float(x) for x in vector], 0) for at, vector in enumerate(vectors)]
    rows += [(7, rows[7][1], 0), (None, rows[8][1], None), (None, rows[8][1], None)] + ODD
    got = whitened(table(spark, rows), components=3).toPandas()
    x = [[math.floor(1024 * float(c)) + 100_000 for c in vector] for _, vector, _ in rows[:63]]
    n, sums = len(x), [sum(column) for column in zip(*x)]
    exact = [[Fraction(sum((n * a - s) * (n * b - t) for a, b in zip(left, right)), n**3) for right, t in zip(zip(*x), sums)] for left, s in zip(zip(*x), sums)]
    values, axes = np.linalg.eigh(np.array([[float(cell) for cell in row] for row in exact]))
    values, axes = values[::-1], axes[:, ::-1]
    want = (np.array(x) - np.array(sums) / n) @ axes / np.sqrt(values)
    away = [sum((n * c - s) ** 2 for c, s in zip(row, sums)) for row in x]
    assert len(got) == 63 * 3 and set(got.n) == {63} and got.identity_error.max() < 1e-9
    for at, (number, _, _) in enumerate(rows[:63]):
        mine = got[got.vec_id.isna()] if number is None else got[got.vec_id == number]
        assert set(mine.deviation) == {away[at]}
        for component in (1, 2, 3):
            one = mine[mine.component == component]
            assert np.allclose(np.abs(one.whitened), abs(want[at, component - 1]), atol=1e-9)
            assert np.allclose(one.explained, values[component - 1] / values.sum(), rtol=1e-12)


def test_whitening_of_large_and_of_no_variance(spark):
    # means far from zero and sums beyond a long stay exact; short vectors have zeros behind them
    rows = [(1, [3e9, 1.0], 0), (2, [3e9 + 512, 2.0], 0), (3, [3e9 - 512, 3.0], 0), (4, [3e9], 0)]
    got = whitened(table(spark, rows).select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))).toPandas()
    x = [[math.floor(1024 * c) + 100_000 for c in (*vector, *[0.0] * (2 - len(vector)))] for _, vector, _ in rows]
    sums = [sum(column) for column in zip(*x)]
    assert {int(row.vec_id): int(row.deviation) for row in got.itertuples()} == {at + 1: sum((4 * c - s) ** 2 for c, s in zip(row, sums)) for at, row in enumerate(x)}
    assert got.identity_error.max() < 1e-6
    for rows in ([(1, [1.0, 2.0], 0)] * 5, [(1, [1.0], 0)], [(1, [], 0)], ODD, []):
        none = whitened(table(spark, rows))
        assert none.count() == 0 and none.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_variances_alone_give_covariances():
    x = [(1, 5), (2, 5), (4, 1)]
    squares = {(0, 0): 21, (1, 1): 51, (0, 1): sum((a + b) ** 2 for a, b in x)}
    assert np.allclose(covariance_from_variances(3, [7, 11], squares, [0, 0]), np.cov(np.array(x).T, bias=True))


# hard negatives


def brute_negatives(rows, modulus, positives, negatives):
    kept = {}
    for number, vector, label in rows:
        if number is not None and label is not None and vector and all(x is not None and math.isfinite(x) for x in vector):
            kept[number, tuple(math.floor(256 * float(np.float32(x))) for x in vector), label] = None
    found = []
    score = lambda a, b: sum(x * y for x, y in zip(a, b))
    for number, vector, label in kept:
        if number % modulus:
            continue
        ranked = sorted((-score(vector, v), n, k) for n, v, k in kept if n != number)
        for best, close, _ in [item for item in ranked if item[2] == label][:positives]:
            hard = [item for item in ranked if item[2] != label and 30 * -best <= 100 * -item[0] <= 90 * -best]
            found += [(number, close, place + 1, other, -best, -far) for place, (far, other, _) in enumerate(hard[:negatives])]
    return sorted(found)


@pytest.mark.parametrize("shard,split,block", [(8192, 2048, 4096), (60, 30, 3)])
def test_negatives_against_brute_force(spark, monkeypatch, shard, split, block):
    monkeypatch.setattr(negatives_module, "SHARD", shard)
    monkeypatch.setattr(negatives_module, "ROWS_PER_SPLIT", split)
    monkeypatch.setattr(negatives_module, "QUERIES_PER_BLOCK", block)
    random = np.random.default_rng(9)
    centers = random.normal(size=(5, 6))
    vectors = [centers[at % 5] + random.normal(size=6) * 0.6 for at in range(260)]
    # equal vectors under many ids: ties, and a third of all rows in one place
    rows = [(at, [float(x) for x in vector], at % 4) for at, vector in enumerate(vectors)] + [(1000 + at, [0.5] * 6, at % 3) for at in range(140)]
    rows += [(2, rows[2][1], 2), (2000, None, 1), (2010, [1.0] * 6, None), (None, [1.0] * 6, 1), (2020, [math.nan] * 6, 1), (2030, [None] * 6, 1)]
    got = hard_negatives(table(spark, rows), F.col("id") % 10 == 0, positives=3, negatives=6).collect()
    assert sorted(map(tuple, got)) == brute_negatives(rows, 10, 3, 6)


def test_negatives_of_small_tables(spark):
    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    # no other row, no row of the label, no other label, opposite vectors (a negative window is empty), nothing usable
    for rows in ([(0, [1.0, 0.0], 1)], [(0, [1.0, 0.0], 1), (1, [1.0, 0.0], 2)], [(0, [1.0, 0.0], 1)] * 4, [(0, [1.0], 1), (1, [-1.0], 1), (2, [-0.5], 2)], ODD, []):
        made = hard_negatives(table(spark, rows), F.col("id") % 10 == 0)
        assert made.columns == names and made.count() == 0
    # shorter vectors count as if zeros followed; rows that share only the id are no neighbours
    rows = [(0, [1.0, 1.0], 1), (0, [1.0, 0.9], 1), (1, [1.0], 1), (2, [0.5], 2)]
    assert hard_negatives(table(spark, rows), F.col("id") == 0).count() == 2


def test_ranges_never_exclude_a_match():
    random = np.random.default_rng(1)
    matrix = np.floor(random.normal(size=(30, 5))[random.integers(0, 30, 900)] * 400 + random.normal(size=(900, 5)) * 20)
    tree = plant(matrix, np.arange(len(matrix)))
    asked = matrix[:50]
    squares = (asked**2).sum(axis=1)
    low, high = 0.9 * squares, 1.1 * squares
    to_points = np.sqrt(((asked[:, None] - tree.points) ** 2).sum(axis=2))
    may = open_children(to_points, squares, low, high, tree.near, tree.far, tree.norms)
    for child, node in enumerate(tree.children):
        scores = asked @ matrix[node.rows].T
        assert (may[:, child] | ~((scores >= low[:, None]) & (scores <= high[:, None])).any(axis=1)).all()
    assert may.mean() < 0.5


@sample
def test_negatives_query(spark):
    import duckdb

    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{FOLDER}/embeddings.parquet')")
    made = queries.QUERIES["op12_hard_negatives"](spark, FOLDER)
    want = db.execute(f"SELECT {', '.join(made.columns)} FROM ({queries.ORACLE_SQL['op12_hard_negatives']})").fetchall()
    assert sorted(map(tuple, made.collect())) == sorted(want)


# repeats


def brute_repeats(docs, window):
    """Per (id, text): words, removed words and the kept text, straight from the definition."""
    split = [(number, (text or "").encode().split()) for number, text in docs]
    first = {}
    for number, words in split:
        if number is not None:
            for at in range(len(words) - window + 1):
                content = tuple(words[at : at + window])
                first[content] = min(number, first.get(content, number))
    found = []
    for number, words in split:
        gone = set()
        for at in range(len(words) - window + 1):
            least = first.get(tuple(words[at : at + window]))
            if least is not None and (number is None or least < number):
                gone |= set(range(at, at + window))
        kept = b" ".join(word for at, word in enumerate(words) if at not in gone).decode()
        found.append((number, len(words), len(gone), kept))
    return sorted(found, key=str)


def documents(spark, docs, spread):
    return spark.createDataFrame([(*row, 1, "id", b"e", 5) for row in docs], "doc_id long, text string, chunk long, id string, entries binary, bucket int").repartition(spread)


def texts(window):
    random = np.random.default_rng(window)
    word = lambda n: [f"w{x}" for x in random.integers(0, 4000, n)]
    passage, other = word(3 * window), word(window)
    docs = []
    for number in range(60):
        parts = word(int(random.integers(0, 3 * window)))
        if number % 3:  # a third and more share a passage or a piece of it, at any offset
            start = int(random.integers(0, window)) if number % 2 else 0
            parts += passage[start : start + int(random.integers(window - 2, 2 * window + 2))]
        if number % 5 == 0:
            parts = other + parts
        docs.append((number, " ".join(parts)))
    docs += [(100 + at, docs[4][1]) for at in range(30)]  # copies
    docs += [(3, docs[3][1]), (3, docs[10][1]), (None, docs[4][1]), (None, docs[4][1]), (-5, " ".join(other)), (7, None), (8, ""), (9, " \t\n ")]
    docs += [(200, " ".join(["same"] * (4 * window))), (201, "same  " * window + "é 漢字 " * window), (202, " ".join(["same"] * (window + 1)))]
    docs += [(300, "  ".join(word(30 * window) + passage)), (301, "\v".join(passage[1:]))]
    return docs


@pytest.mark.parametrize("window", [1, 2, 7, 50])
@pytest.mark.parametrize("chunk,bucket,spread", [(1 << 23, 1 << 25, 1), (900, 3000, 4)])
def test_repeats_against_brute_force(spark, window, chunk, bucket, spread):
    docs = texts(window)
    got = without_repeats(documents(spark, docs, spread), window, chunk, bucket)
    assert sorted(map(tuple, got.collect()), key=str) == brute_repeats(docs, window)


def test_repeats_of_nothing(spark):
    for docs in ([], [(None, None)], [(1, "")]):
        assert [tuple(row) for row in without_repeats(documents(spark, docs, 1)).collect()] == [(number, 0, 0, "") for number, _ in docs]
    with pytest.raises(ValueError):
        without_repeats(documents(spark, [], 1), window=0)


def test_texts_are_not_moved_again(spark):
    plan = without_repeats(documents(spark, texts(7), 4), 7)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 4 and "Exchange hashpartitioning(bucket" in plan
    assert all("text" not in line for line in plan.splitlines() if "Exchange" in line)


def test_rolling_and_packing():
    numbers = np.random.default_rng(0).integers(0, 2**63, 200).astype(np.uint64)
    numbers[120:140] = numbers[20:40]
    hashes = rolling(numbers, 20, 0x9E3779B97F4A7C15)
    assert hashes[20] == hashes[120] and len(set(hashes.tolist())) == 180
    columns = [np.sort(numbers), numbers]
    assert all((a == b).all() for a, b in zip(columns, unpack(pack(columns), 2)))
    assert [len(column) for column in unpack(pack([numbers[:0], numbers[:0]]), 2)] == [0, 0]


@sample
def test_repeats_query(spark):
    docs = [tuple(row) for row in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()]
    want = [(number, many, gone, hashlib.sha256(text.encode()).hexdigest()) for number, many, gone, text in brute_repeats(docs, 50)]
    assert sorted(map(tuple, queries.QUERIES["op13_repeats"](spark, FOLDER).collect())) == sorted(want)
