"""Language identification by rank-order n-gram profiles and out-of-place distance.

A language's profile holds its PROFILE most frequent n-grams of 1 to MAX_N characters over all
training texts, by rank. A document's own most frequent n-grams are compared with every profile:
each adds how far its rank is out of place, or PROFILE if the profile lacks it. The nearest
profile wins. N-grams are of lower-cased words with a blank on either side; other characters
than letters part words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.session import bounded_batches

MAX_N, PROFILE = 3, 300
#: Languages whose profiles go to every executor at a time; more are compared in several passes.
MOST_LANGUAGES = 2_000
#: Code points that are looked up in a table; higher ones are judged one by one.
PLANES = 0x34000
_BITS = 21  # a code point; three fit a long
_BLANK = 1


def _letter(c: int) -> int:
    """Lower-case code point of a letter of any plane, 0 for what is no letter."""
    x = chr(c)
    low = x.lower()
    return 0 if not x.isalpha() else ord(low) if len(low) == 1 else c


_TABLE: np.ndarray | None = None


def _codes(text: str) -> np.ndarray:
    """Letters of the text as lower-case code points, 0 between words and at both ends."""
    global _TABLE
    if _TABLE is None:
        _TABLE = np.array([_letter(c) for c in range(PLANES)], np.int32)
    raw = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    out = np.zeros(len(raw) + 2, np.int64)
    out[1:-1] = _TABLE[np.minimum(raw, PLANES - 1)]
    for i in np.flatnonzero(raw >= PLANES):
        out[i + 1] = _letter(int(raw[i]))
    return out


def _grams(text: str, most: int) -> tuple[np.ndarray, np.ndarray]:
    """N-gram codes and counts of a whole text; a blank counts as a character beside letters only."""
    code = _codes(text)
    letter = code > 0
    if not letter.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the blank after a word, which is also the one before the next
    keep[:-1] |= letter[1:]
    code, letter = code[keep], letter[keep]
    code[~letter] = _BLANK
    found, gram = [code[letter]], code
    for n in range(2, most + 1):  # the first character is never 0, so lengths do not mix
        gram = (gram[:-1] << _BITS) | code[n - 1 :]
        inner = letter[: len(gram)] | letter[1 : 1 + len(gram)]
        for k in range(1, n - 1):
            inner &= letter[k : k + len(gram)]
        found.append(gram[inner])
    return np.unique(np.concatenate(found), return_counts=True)


def _texts(column: pa.Array) -> list[str]:
    return [x if x is not None else "" for x in column.to_pylist()]


def _count(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: dict[str, list] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), _texts(batch.column("text")), strict=True):
                held.setdefault(lang, []).append(_grams(text, most))
            langs, grams, counts = [], [], []
            for lang, found in held.items():
                gram, at = np.unique(np.concatenate([g for g, _ in found]), return_inverse=True)
                count = np.bincount(at, np.concatenate([c for _, c in found]), len(gram))
                langs += [lang] * len(gram)
                grams.append(gram)
                counts.append(count.astype(np.int64))
            if grams:
                yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(np.concatenate(grams)), pa.array(np.concatenate(counts))], ["lang", "gram", "n"])

    return run


def learn_profiles(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", size: int = PROFILE, most: int = MAX_N) -> DataFrame:
    """(lang, gram, rank): the most frequent n-grams of every language over all given texts, ties to the smaller code.

    Rows with a null language or text teach nothing; repeated rows count each time; texts of any length
    count whole. Other columns are ignored. An empty table gives no rows.
    """
    bounded_batches(docs.sparkSession)
    docs = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).filter("lang is not null and text is not null")
    counts = docs.mapInArrow(_count(most), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    by = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    return counts.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= size).select("lang", "gram", "rank")


def nearest(top: np.ndarray, starts: np.ndarray, grams: np.ndarray, langs: np.ndarray, ranks: np.ndarray, n_langs: int, size: int) -> np.ndarray:
    """Out-of-place distance of a document's ranked n-grams to every language.

    ``grams`` are the distinct n-grams of all profiles, sorted; those of ``grams[i]`` are the
    (language, rank) pairs from ``starts[i]`` on.
    """
    out = np.full(n_langs, size * len(top), np.int64)
    at = np.minimum(np.searchsorted(grams, top), max(len(grams) - 1, 0))
    hit = np.flatnonzero(grams[at] == top) if len(grams) else np.zeros(0, np.int64)
    first, count = starts[at[hit]], starts[at[hit] + 1] - starts[at[hit]]
    pairs = np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())
    own = np.repeat(hit + 1, count)
    return out - np.bincount(langs[pairs], np.maximum(size - np.abs(ranks[pairs] - own), 0), n_langs).astype(np.int64)


def _predict(shared, size: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, *profiles = shared.value
        for batch in batches:
            best, scores = [], []
            for text, lang, score in zip(_texts(batch.column("text")), batch.column("lang_pred").to_pylist(), batch.column("score").to_pylist(), strict=True):
                gram, count = _grams(text, most)
                if len(gram):
                    if len(gram) > size:
                        least = np.partition(count, len(count) - size)[len(count) - size]
                        near = np.flatnonzero(count >= least)
                        gram, count = gram[near], count[near]
                    top = gram[np.lexsort((gram, -count))[:size]]
                    distance = nearest(top, *profiles, len(names), size)
                    k = int(distance.argmin())
                    found = 1.0 - float(distance[k]) / (size * len(top))
                    if found > score:
                        lang, score = names[k], found
                best.append(lang)
                scores.append(score)
            columns = [pa.array(best, pa.string()) if c == "lang_pred" else pa.array(scores, pa.float64()) if c == "score" else batch.column(c) for c in batch.schema.names]
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return run


def predict_language(docs: DataFrame, profiles: DataFrame, held_out: Column | None = None, id_col: str = "doc_id", text_col: str = "text", size: int = PROFILE, most: int = MAX_N) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of whole texts, a row per input row; ``held_out`` is passed through.

    ``score`` is 1 - distance / greatest distance. Null texts, texts without a letter, and any text
    when no language was learned get ``und`` and 0. Equal distances go to the language that sorts
    first. Repeated rows and null ids are returned as they come; other columns are ignored; texts of
    any length count whole. An empty table gives no rows.

    The profiles of MOST_LANGUAGES at a time go to every executor, and the texts pass a comparison
    with each such group; there is no shuffle. The driver holds the names of all languages.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    every = sorted(r.lang for r in profiles.select("lang").distinct().collect())
    held = F.lit(False) if held_out is None else held_out
    rows = docs.select(F.col(id_col).alias("doc_id"), held.alias("held_out"), F.col(text_col).cast("string").alias("text"), F.lit(None).cast("string").alias("lang_pred"), F.lit(-1.0).alias("score"))
    for a in range(0, len(every), MOST_LANGUAGES):
        names = every[a : a + MOST_LANGUAGES]
        some = profiles.filter(F.col("lang").between(names[0], names[-1])) if len(every) > MOST_LANGUAGES else profiles
        place = {x: i for i, x in enumerate(names)}
        table = np.array([(r.gram, place[r.lang], r["rank"]) for r in some.collect()], np.int64).reshape(-1, 3)
        table = table[np.argsort(table[:, 0], kind="stable")]
        grams, starts = np.unique(table[:, 0], return_index=True)
        shared = spark.sparkContext.broadcast((names, np.append(starts, len(table)), grams, table[:, 1].copy(), table[:, 2].copy()))
        rows = rows.mapInArrow(_predict(shared, size, most), rows.schema)
    return rows.select("doc_id", "held_out", F.coalesce("lang_pred", F.lit("und")).alias("lang_pred"), F.greatest("score", F.lit(0.0)).alias("score"))


def fold(key: str, parts: int) -> Column:
    """crc32 of the key as text, modulo ``parts``."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % parts
