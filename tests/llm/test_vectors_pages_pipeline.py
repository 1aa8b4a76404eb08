from __future__ import annotations

import html
import math
import os
import sys
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sparkbi.llm import queries
from sparkbi.llm.extraction import extract, main_text
from sparkbi.llm.vectors import near_vectors

FOLDER = "/root/testdata/sf0.001"
sample = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="sample tables are not here")


# vectors


def brute(rows, threshold):
    """n_links and component per row by comparing everything."""
    unit, parent = {}, list(range(len(rows)))
    for at, (_, vector) in enumerate(rows):
        if vector and all(x is not None and math.isfinite(x) for x in vector) and any(vector):
            array = np.array(vector, dtype=float)
            unit[at] = array / np.abs(array).max() / np.linalg.norm(array / np.abs(array).max())

    def root(at):
        while parent[at] != at:
            at = parent[at]
        return at

    links = [0] * len(rows)
    for a in unit:
        for b in unit:
            if a != b and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= threshold:
                links[a] += 1
                parent[root(a)] = root(b)
    least = defaultdict(list)
    for at, (number, _) in enumerate(rows):
        least[root(at)].append(number)
    smallest = [min((n for n in least[root(at)] if n is not None), default=None) for at in range(len(rows))]
    return Counter((number, links[at], smallest[at], number == smallest[at]) for at, (number, _) in enumerate(rows))


@pytest.mark.parametrize("reach", [None, 4.0])
@pytest.mark.parametrize("block", [16, 1024])
def test_vectors_against_brute_force(spark, monkeypatch, reach, block):
    import sparkbi.llm.vectors as module

    monkeypatch.setattr(module, "BLOCK", block)
    random = np.random.default_rng(5)
    centers = random.normal(size=(30, 16))
    vectors = [center + random.normal(size=16) * 0.12 for center in centers for _ in range(9)] + [centers[0]] * 40 + list(random.normal(size=(150, 16)))
    rows = [(number, [float(x) for x in vector]) for number, vector in enumerate(vectors)]
    rows += [(1000, None), (1001, [0.0] * 16), (1002, [math.nan] * 16), (1003, [None] * 16), (1004, [math.inf] + [1.0] * 15), (1005, []), (1006, [1.0, 2.0]), (1007, [2.0, 4.0])]
    rows += [(None, rows[3][1]), (3, rows[3][1]), (1008, [x * 1e200 for x in rows[5][1]])]
    table = spark.createDataFrame([(*row, 0) for row in rows], "vec_id long, embedding array<double>, n int").repartition(5)
    assert Counter(map(tuple, near_vectors(table, 0.95, reach).collect())) == brute(rows, 0.95)


def test_vectors_near_a_subspace(spark):
    """Differences along few of many directions cross cell boundaries; the default must find every link."""
    random = np.random.default_rng(11)
    basis = np.linalg.qr(random.normal(size=(384, 5)))[0]
    vectors = random.normal(size=(3000, 5)) @ basis.T + random.normal(size=(3000, 384)) * 1e-3
    table = spark.createDataFrame([(number, vector.tolist()) for number, vector in enumerate(vectors)], "vec_id long, embedding array<double>")
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    links = (unit @ unit.T >= 0.95).sum(axis=1) - 1
    assert {row.vec_id: row.n_links for row in near_vectors(table).collect()} == dict(enumerate(links.tolist()))


def test_pairs_of_blocks_write_no_copies_of_vectors(spark, monkeypatch, tmp_path):
    """Random vectors look into most cells, yet what is written grows with the vectors; groups larger than a block stay whole."""
    import sparkbi.llm.common as common
    import sparkbi.llm.vectors as module

    monkeypatch.setattr(module, "BLOCK", 64)
    monkeypatch.setattr(module, "PART", 300)
    monkeypatch.setattr(common, "SAVED", [])
    random = np.random.default_rng(3)
    near = random.normal(size=64) + random.normal(size=(400, 64)) * 0.15
    vectors = np.concatenate([random.normal(size=(2600, 64)), near]).astype(np.float32)
    table = spark.createDataFrame([(number, vector.tolist()) for number, vector in enumerate(vectors)], "vec_id long, embedding array<float>")
    table.write.parquet(str(tmp_path / "in"))
    got = {row.vec_id: (row.n_links, row.component_id) for row in near_vectors(spark.read.parquet(str(tmp_path / "in"))).collect()}
    exact = vectors.astype(float)
    unit = exact / np.linalg.norm(exact, axis=1, keepdims=True)
    links = (unit @ unit.T >= 0.95).sum(axis=1) - 1
    assert got == {number: (many, 2600 if number >= 2600 else number) for number, many in enumerate(links.tolist())}
    size = lambda top: sum(os.path.getsize(os.path.join(at, name)) for at, _, names in os.walk(top) for name in names)
    assert sum(size(path.removeprefix("file:")) for path in common.SAVED) < 3 * vectors.nbytes


def test_no_vectors(spark):
    table = spark.createDataFrame([(1, None), (2, [0.0])], "vec_id long, embedding array<float>")
    assert sorted(map(tuple, near_vectors(table).collect())) == [(1, 0, 1, True), (2, 0, 2, True)]
    assert near_vectors(table.where("false")).count() == 0


# pages

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="<p>no</p>";</script></head>
<body class="with-sidebar"><header><h1>Site name</h1></header><nav><ul><li><a href=/>Home</a><li><a href=/b>More</a></ul></nav>
<div class="cookie-notice"><p>We use cookies, many of them, for all kinds of things on this page.</p></div>
<div id="page"><div class="post-content"><h2>A title</h2>
<p>First paragraph, with <b>bold,
words</b> and&nbsp;spaces &amp; signs &lt;here&gt;.<p>Second one<br>goes on, and on, until it ends.
<ul><li>point one</li><li>point two, longer</li></ul><div class="share">Share, like, follow</div>
<table><tr><td>cell a<td>cell b</table><form><p>Your name, your mail, your life</p><input name=q></form><!-- <p>comment</p> -->
</div></div><aside><p>Side story, quite long, with commas, and more commas, and even more.</p></aside>
<section id="comments"><p>Nice article, I liked it, thank you very much, really.</p></section>
<footer>All rights, reserved</footer></body></html>"""
TEXT = [
    "A title", "First paragraph, with bold, words and spaces & signs <here>.", "Second one goes on, and on, until it ends.",
    "point one", "point two, longer", "cell a", "cell b",
]


def test_main_text():
    assert main_text(PAGE).split("\n\n") == TEXT
    assert main_text("plain &amp; simple") == "plain & simple"
    assert main_text("<p>a<b>b<p>c") == "ab\n\nc"
    assert main_text("<nav><p>Menu only, nothing else</p></nav>") == main_text("<script>x") == main_text("") == ""
    assert main_text("<article><header><h1>Head</h1></header><p>Body, text</p><footer>f</footer></article><p>other</p>").startswith("Head\n\nBody, text")
    deep = "<div>" * 20_000 + "<p>deep, down</p>"
    assert main_text(deep) == "deep, down"
    long = "<article>" + "<p>word, word</p>" * 20_000 + "</article>"
    assert main_text(long).count("\n\n") == 19_999


@pytest.mark.parametrize("wrapper", ['class="has-sidebar"', 'class="content with-sidebar"', 'class="no-ads"', 'id="page-header-fixed"', 'role="main" class="site-header"'])
def test_wrappers_that_mention_noise(wrapper):
    body = "<p>First paragraph, long enough, with commas.</p><p>Second paragraph, which goes on, and on.</p>"
    noise = '<div class="sidebar"><p>Side story, with commas, many of them.</p></div><div class="ad-box"><p>Buy this, now.</p></div>'
    text = "First paragraph, long enough, with commas.\n\nSecond paragraph, which goes on, and on."
    for inner in (f"<article>{body}</article>", f"<div>{body}</div>", f"<main>{body}</main>"):
        assert main_text(f"<body><div {wrapper}>{inner}{noise}</div><p>x</p></body>").startswith(text)
        assert "Side story" not in main_text(f"<body><div {wrapper}>{inner}{noise}</div></body>")
        assert "Buy" not in main_text(f"<body><div {wrapper}>{inner}{noise}</div></body>")
    comments = '<div id="comments"><article class="comment"><p>' + "I like it, very much, really. " * 20 + "</p></article></div>"
    assert main_text(f"<body><div {wrapper}><div>{body}</div></div>{comments}</body>") == text


def test_form_around_the_page():
    page = "<html><body><form id='aspnetForm'><div class='menu'><a href='/'>Home</a></div><div>%s</div><input name='q'><button>Go</button></form></body></html>"
    assert main_text(page % "".join(f"<p>{html.escape(text)}</p>" for text in TEXT)) == "\n\n".join(TEXT)
    beside = "<html><body><div>%s</div><form><label>Your name</label><p>Your mail</p></form></body></html>"
    assert main_text(beside % "".join(f"<p>{html.escape(text)}</p>" for text in TEXT)) == "\n\n".join(TEXT)
    assert main_text("<body><form><label>Name</label><label>Word</label></form></body>") == ""


@pytest.mark.parametrize("piece", ["<a b \"", "<a \">\"", "<a '\">", "<!x", "<?x", "<x>", "<div>", "</x>", "<b>", "<p><b>"])
def test_long_broken_pages(piece):
    whole = "".join(f"<p>{html.escape(text)}</p>" for text in TEXT)
    start = time.perf_counter()
    main_text(piece * (1_000_000 // len(piece)))
    main_text("<x>" * 50_000 + "</y>" * 50_000)
    assert time.perf_counter() - start < 20
    assert TEXT[0] in main_text(f"<article>{whole}</article>" + "<a b \"" * 1000)


def test_extract_rows(spark):
    rows = [(1, "u", PAGE, "clash"), (1, "u", PAGE, "clash"), (None, None, None, None), (2, "v", "", "x")]
    got = extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert Counter(map(tuple, got)) == Counter([(1, "u", "\n\n".join(TEXT), len("\n\n".join(TEXT)))] * 2 + [(None, None, "", 0), (2, "v", "", 0)])
    assert extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


# pipeline and queries


def text_of(seed, n):
    words = {0: "the and with from this that have which", 1: "der die und nicht mit dem auch eine", 2: "les des une dans pour avec est que"}[seed % 3].split()
    state, made = seed + 1, []
    for _ in range(n):
        state = (state * 1103515245 + 12345) % 2**31
        made.append(words[state // 65536 % len(words)] + str(state // 1024 % 7))
    return " ".join(made)


def test_stages(spark):
    rows = [(n, text_of(n, 60), ("en", "de", "fr")[n % 3], f"s{n % 2}") for n in range(60)]
    copies = [(n + 100, rows[n][1], rows[n][2], rows[n][3]) for n in range(0, 60, 4)] + [(200, rows[1][1], "de", None), (1, rows[1][1], "de", "s9")]
    junk = [(300, None, "en", "s0"), (301, "", "en", "s1"), (302, "12 34 -- 56 !!", "de", "s0"), (None, text_of(7, 50), "de", "s1")]
    schema = "doc_id long, text string, lang string, source string"
    docs = spark.createDataFrame(rows + copies + junk, schema).withColumns({"score": F.lit(2), "lang_pred": F.lit("kept"), "_copy": F.lit("kept"), "digits": F.lit(3)})
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["language", "near copies", "mixing", "packing"]
    states = [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, states[-1], FOLDER)
        assert after.columns == docs.columns and not after.where("score <> 2 or lang_pred <> 'kept' or _copy <> 'kept' or digits <> 3").count()
        states.append(spark.createDataFrame(after.collect(), docs.schema))
    known = sorted(-1 if row.doc_id is None else row.doc_id for row in states[1].collect())
    assert known == sorted([row[0] for row in rows + copies] + [-1])
    # the row without an id is the start of document 7: 46 of their 56 five-word shingles are shared
    assert sorted(-1 if row.doc_id is None else row.doc_id for row in states[2].collect()) == sorted(row[0] for row in rows)
    mixed = Counter(row.doc_id for row in states[3].collect())
    assert set(mixed) <= {row[0] for row in rows} | {None} and max(mixed.values()) <= 2
    packed = corpus_pipeline.STAGES[-1][1](spark, states[3], FOLDER).collect()
    assert Counter(row.doc_id for row in packed) == mixed
    nothing = docs.where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, FOLDER).count() == 0


def test_repeated_rows_are_thinned_before_they_move(spark):
    rows = [(n, text_of(n, 60), f"s{n}") for n in range(20)]
    repeated = [(7, rows[7][1], f"t{n % 3}") for n in range(500)] + [(None, rows[8][1], "u")] * 300 + [(3, rows[3][1], "v")]
    docs = spark.createDataFrame(rows + repeated, "doc_id long, text string, source string").repartition(4)
    kept = corpus_pipeline.near_copies_stage(spark, docs, FOLDER)
    got = kept.collect()
    assert sorted(row.doc_id for row in got) == list(range(20))
    assert {row.doc_id: row.text for row in got} == {number: text for number, text, _ in rows}
    assert "partial_min_by" in kept._jdf.queryExecution().executedPlan().toString()


@sample
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_matches_sql(spark, name):
    from check_queries import connect, rows_of

    made = queries.QUERIES[name](spark, FOLDER)
    found = connect(FOLDER).execute(queries.ORACLE_SQL[name])
    columns = [column[0] for column in found.description]
    assert sorted(columns) == sorted(made.columns)
    assert rows_of([tuple(row) for row in made.collect()], made.columns) == rows_of(found.fetchall(), columns)


COLUMNS = {
    1: "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next",
    2: "doc_id piece start length ids_crc32 sequence_id offset",
    3: "doc_id size text_crc32 law shard slot grown_shard",
    4: "doc_id held_out lang_pred score",
    5: "page_id url text n_chars",
    6: "doc_id size source_size target taken",
    7: "doc_id held_out n_tokens n_known train_tokens base_score score",
    8: "vec_id n_links component_id kept",
    9: "doc_id n_tokens edited_tokens",
    10: "doc_id fingerprint component_id",
}


@sample
@pytest.mark.parametrize("number", sorted(COLUMNS))
def test_registered_queries(spark, number):
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
    import __spark_entry__

    name = next(name for name in __spark_entry__.queries() if name.startswith(f"op{number}_"))
    made = __spark_entry__.queries()[name](spark, FOLDER)
    assert set(COLUMNS[number].split()) <= set(made.columns)
    table = {5: "pages", 8: "embeddings"}.get(number, "documents")
    rows = made.collect()
    assert len({row[0] for row in rows}) == spark.read.parquet(f"{FOLDER}/{table}.parquet").count()
    if number == 4:
        right = {row.doc_id: row.lang for row in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
        held = [row for row in rows if row.held_out]
        assert sum(right[row.doc_id] == row.lang_pred for row in held) >= 0.9 * len(held)
    if number == 7:
        held = [row for row in rows if row.held_out]
        assert sum(row.score for row in held) > sum(row.base_score for row in held)
