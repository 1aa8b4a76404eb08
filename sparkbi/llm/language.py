"""Language of a text by rank-order profiles of character n-grams.

A language's profile is the list of its most frequent n-grams of one to three letters, counted
over all training documents. A text is compared by the n-grams that are most frequent in it:
each is out of place by the difference of its two ranks, or by the length of the profile if
the profile lacks it. The language with the smallest sum wins; the smallest name at a tie.

Letters are lower-cased, everything else separates words and counts as one blank. Up to three
code points fit a 64-bit number, so n-grams are exact integers.

Nulls: a null or blank text, or one without a letter, has language ``und`` and score 0. Rows
with a null language teach nothing; null ids are kept (their checksum is that of an empty text).
If nothing can be learnt, every text is ``und``. Repeated rows count as often as they occur. An
empty table gives an empty result. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from sparkbi.llm.common import per_worker, ship_by_value

UNKNOWN = "und"
PROFILE = 400  # n-grams in a profile; also those looked at in a text
MOST_LANGUAGES = 1000  # more are refused: the profiles go to every task
HELD_OUT = 5
FLUSH = 2_000_000  # distinct n-grams a training task keeps before it passes them on
CHUNK = 1_000_000  # code points whose n-grams are sorted at a time
BLANK, BITS = 32, 21


def held_out(id_: Column, folds: int = HELD_OUT) -> Column:
    """Whether the checksum of the id as text falls in the fold that is not learnt from."""
    return F.crc32(F.encode(F.coalesce(id_.cast("string"), F.lit("")), "UTF-8")) % folds == 0


def _letters() -> np.ndarray:
    return np.fromiter((chr(code).isalpha() for code in range(0x110000)), dtype=bool, count=0x110000)


def _add(codes: np.ndarray, counts: np.ndarray, more: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merge sorted distinct codes and counts with the occurrences in ``more``."""
    more.sort()
    starts = np.flatnonzero(np.r_[True, more[1:] != more[:-1]]) if len(more) else np.array([], dtype=np.int64)
    new, new_counts = more[starts], np.diff(np.r_[starts, len(more)])
    if not len(codes):
        return new, new_counts
    both, both_counts = np.concatenate([codes, new]), np.concatenate([counts, new_counts])
    order = np.argsort(both, kind="stable")
    both, both_counts = both[order], both_counts[order]
    starts = np.flatnonzero(np.r_[True, both[1:] != both[:-1]])
    return both[starts], np.add.reduceat(both_counts, starts)


def n_grams(text: str) -> Iterator[np.ndarray]:
    """All n-grams of a text as numbers, in arrays of bounded size."""
    letters = per_worker("letters", 0, _letters)
    at = 0
    while at < len(text):
        # chunks end at a blank, where n-grams end too; a text without one is a single chunk
        blank = text.find(" ", at + CHUNK)
        upto = blank + 1 if blank >= 0 else len(text)
        lowered = text[at:upto].lower()
        at = upto
        codes = np.frombuffer(lowered.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        letter = letters[codes]
        kept = letter.copy()
        kept[1:] |= letter[:-1]
        x = np.r_[BLANK, np.where(letter, codes, BLANK)[kept], BLANK].astype(np.int64)
        if len(x) > 3 and x[-2] == BLANK:
            x = x[:-1]
        inner = x != BLANK
        pairs = (x[:-1] << BITS) | x[1:]
        triples = (pairs[:-1] << BITS) | x[2:]
        yield np.concatenate([x[inner], pairs[inner[:-1] | inner[1:]], triples[inner[1:-1]]])


def _count(text: str) -> tuple[np.ndarray, np.ndarray]:
    codes = counts = np.array([], dtype=np.int64)
    for grams in n_grams(text):
        codes, counts = _add(codes, counts, grams)
    return codes, counts


def learn_profiles(docs: DataFrame, text_column: str = "text", language_column: str = "lang", size: int = PROFILE) -> DataFrame:
    """``lang``, ``code`` and ``place`` (0 is the most frequent) of each language's n-grams."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[str, list[np.ndarray]] = {}
        sizes: dict[str, int] = {}
        kept: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        nothing = np.array([], dtype=np.int64)

        def settle(language: str) -> None:
            kept[language] = _add(*kept.get(language, (nothing, nothing)), np.concatenate(waiting.pop(language)))
            sizes[language] = 0

        def passed_on(language: str) -> pa.RecordBatch:
            codes, counts = kept.pop(language)
            return pa.RecordBatch.from_arrays([pa.array([language] * len(codes), pa.string()), pa.array(codes), pa.array(counts, pa.int64())], ["lang", "code", "n"])

        for batch in batches:
            for language, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                for grams in n_grams(text.as_py()):
                    waiting.setdefault(language, []).append(grams)
                    sizes[language] = sizes.get(language, 0) + len(grams)
                    if sizes[language] > CHUNK:
                        settle(language)
                        if len(kept[language][0]) > FLUSH:
                            yield passed_on(language)
        for language in list(waiting):
            settle(language)
        for language in list(kept):
            yield passed_on(language)

    lessons = docs.select(F.col(language_column).cast("string").alias("lang"), F.col(text_column).alias("text")).where("lang is not null and text is not null")
    counted = lessons.mapInArrow(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    # the window keeps ``size`` rows per language already before its shuffle
    place = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "code"))
    return counted.withColumn("place", place).where(F.col("place") <= size).select("lang", "code", (F.col("place") - 1).alias("place"))


class _Profiles:
    """Ranks of all profiles in one table: a row per n-gram, a column per language."""

    def __init__(self, rows: list[tuple[str, int, int]], size: int):
        self.names = sorted({language for language, _, _ in rows})
        self.size = size
        self.codes = np.unique(np.array([code for _, code, _ in rows], dtype=np.int64))
        self.places = np.full((len(self.codes) + 1, len(self.names)), 4 * size, dtype=np.int64)  # last row: in no profile
        column = {name: at for at, name in enumerate(self.names)}
        for language, code, place in rows:
            self.places[np.searchsorted(self.codes, code), column[language]] = place

    def closest(self, text: str | None) -> tuple[str, float, float]:
        """Language, score and similarity (1: same order as the profile, 0: nothing in common)."""
        codes, counts = _count(text) if text and self.names else ((), ())
        if not len(codes):
            return UNKNOWN, 0.0, 0.0
        top = codes[np.argsort(-counts, kind="stable")[: self.size]]
        at = np.searchsorted(self.codes, top)
        at[at == len(self.codes)] = 0
        at = np.where(self.codes[at] == top, at, len(self.codes))
        away = np.minimum(np.abs(self.places[at] - np.arange(len(top))[:, None]), self.size).sum(axis=0)
        similar = 1 - away / (self.size * len(top))
        best = int(np.argmin(away))
        total = float(similar.sum())
        return self.names[best], float(similar[best]) / total if total > 0 else 0.0, float(similar[best])


def identify(docs: DataFrame, profiles: DataFrame, text_column: str = "text", size: int = PROFILE) -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` and ``similarity`` added.

    ``score`` is the winner's share of the similarity to all languages, ``similarity`` is how much
    of the profile's order the text has. Input columns of these names are replaced.
    """
    # ``size`` rows per language, and the number of languages is checked
    rows = [tuple(row) for row in profiles.select("lang", "code", "place").limit(size * MOST_LANGUAGES + 1).collect()]
    if len(rows) > size * MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")

    @F.pandas_udf("lang_pred string, score double, similarity double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        known = _Profiles(rows, size)
        return pd.DataFrame([known.closest(text) for text in texts], columns=["lang_pred", "score", "similarity"])

    kept = docs.drop("lang_pred", "score", "similarity", "_found")
    return kept.withColumn("_found", predict(F.col(text_column))).select("*", "_found.*").drop("_found")


ship_by_value(__name__)
