"""Periodic runs of words by a dictionary of basic factors.

The dictionary names, for every power of two, the factors (stretches of words) of that length, so
that equal ones share a name: names of length 2m come from pairs of names of length m. Only factors
that occur again are kept, so the levels thin out fast. The successor of an occurrence is the next
one of its name. Successors within twice the factor's length, at consecutive places and at the same
distance, form an arithmetic progression and propose that distance as a period. Proposals are
extended both ways, and of those with the same ends the smallest period stays.

A run of period q and four periods at least is proposed at the least length 2^k >= q: there a factor
of the run comes again after q words and not before.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import _WHITE, row_words, text_slices
from plumbline.session import bounded_batches

#: A run has so many words at least, and so many times its period.
LEAST, TIMES = 6, 4


def _names(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of equal values that occur more than once, and which places have one."""
    order = np.argsort(codes, kind="stable")
    ranked = codes[order]
    new = np.ones(len(codes), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    group = np.cumsum(new) - 1
    often = np.bincount(group)[group] > 1 if len(codes) else np.zeros(0, bool)
    name = np.empty(len(codes), np.int64)
    again = np.empty(len(codes), bool)
    name[order], again[order] = group, often
    return name, again


def _stretch(words: np.ndarray, start: int, end: int, period: int) -> tuple[int, int]:
    """The stretch start..end of a period, extended while neighbours keep it."""
    step = 64
    while end < len(words):
        more = words[end : end + step] != words[end - period : end - period + step][: len(words) - end]
        if more.any():
            end += int(np.argmax(more))
            break
        end += len(more)
        step *= 2
    step = 64
    while start > 0:
        low = max(0, start - step)
        more = (words[low:start] != words[low + period : start + period])[::-1]
        if more.any():
            start -= int(np.argmax(more))
            break
        start = low
        step *= 2
    return start, end


def runs_of(words: np.ndarray, bounds: np.ndarray, least: int = LEAST, times: int = TIMES) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, length, period) of all runs of a slice's rows, by row, start and period; starts count in the row.

    ``words`` are values that tell words apart; row r has those from bounds[r] to bounds[r + 1].
    """
    rows = len(bounds) - 1
    # a value of its own after each row: no factor that holds it occurs again
    place = np.arange(len(words)) + np.repeat(np.arange(rows), np.diff(bounds))
    name, again = _names(words)
    dense = np.arange(len(words), len(words) * 2 + rows)
    dense[place] = name
    at, name = place[again], name[again]
    longest = int(np.diff(bounds).max(initial=0)) // times  # of periods
    found: set[tuple[int, int, int]] = set()
    size = 1
    while len(at) and size < 2 * longest:
        order = np.lexsort((at, name))
        here, gap = at[order][:-1], np.diff(at[order])
        near = (np.diff(name[order]) == 0) & (gap <= min(2 * size, longest)) & (2 * gap > size)
        here, gap = here[near], gap[near]
        order = np.lexsort((here, gap))
        here, gap = here[order], gap[order]
        first = np.flatnonzero(np.r_[True, (np.diff(here) != 1) | (np.diff(gap) != 0)]) if len(here) else np.zeros(0, np.int64)
        count = np.diff(np.r_[first, len(here)])
        for start, period, n in zip(here[first].tolist(), gap[first].tolist(), count.tolist(), strict=True):
            if n + size - 1 >= (times - 1) * period or period > size:  # a period within the size has its whole progression here
                low, high = _stretch(dense, start, start + n + size - 1 + period, period)
                if high - low >= max(least, times * period):
                    found.add((low, high, period))
        # names of twice the length, from the pairs of names
        where = np.searchsorted(at, at + size)
        pair = (where < len(at)) & (at[np.minimum(where, len(at) - 1)] == at + size) if len(at) else np.zeros(0, bool)
        codes = name[pair] * np.int64(len(dense) + 1) + name[where[pair]]
        at = at[pair]
        name, again = _names(codes)
        at, name = at[again], name[again]
        size *= 2
    least_of: dict[tuple[int, int], int] = {}
    for low, high, period in found:
        least_of[low, high] = min(period, least_of.get((low, high), period))
    ends = np.array(sorted((low, high - low, period) for (low, high), period in least_of.items()), np.int64).reshape(-1, 3)
    first = bounds[:-1] + np.arange(rows)
    row = np.searchsorted(first, ends[:, 0], "right") - 1
    start = ends[:, 0] - first[row] if len(ends) else ends[:, 0]
    order = np.lexsort((ends[:, 2], start, row))
    return row[order], start[order], ends[order, 1], ends[order, 2]


def _dropped(bounds: np.ndarray, row: np.ndarray, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Which words of a slice lie in a run behind its first period."""
    step = np.zeros(int(bounds[-1]) + 1, np.int64)
    np.add.at(step, bounds[row] + start + period, 1)
    np.add.at(step, bounds[row] + start + length, -1)
    return np.cumsum(step)[:-1] > 0


def _kept_texts(raw: np.ndarray, offsets: np.ndarray, start: np.ndarray, stop: np.ndarray, bounds: np.ndarray, keep: np.ndarray) -> Iterator[bytes]:
    """Each row's kept words, joined by one blank. Words are placed as ``row_words`` gives them: with a byte between rows."""
    rows = len(offsets) - 1
    cuts = np.full(len(raw) + rows + 1, 0x20, np.uint8)
    cuts[np.arange(len(raw)) + np.repeat(np.arange(rows), np.diff(offsets))] = raw
    cuts[_WHITE[cuts]] = 0x20
    step = np.zeros(len(cuts) + 1, np.int8)
    step[start[keep]] += 1
    step[stop[keep] + 1] -= 1  # the blank behind a word with it
    body = cuts[np.cumsum(step[:-1], dtype=np.int8) > 0]
    sizes = np.where(keep, stop - start + 1, 0)
    ends = np.r_[0, np.cumsum(sizes)][bounds]
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        yield body[a : max(a, b - 1)].tobytes()


def _scans(batch: pa.RecordBatch, least: int, times: int):
    """(first row, rows, bytes, offsets, starts, stops, bounds, runs) of a batch's slices."""
    for low, high, raw, offsets in text_slices(batch.column("text")):
        words, start, stop, bounds = row_words(raw, offsets, False)
        yield low, high - low, raw, offsets, start, stop, bounds, runs_of(words[0].view(np.int64), bounds, least, times)


def _runs(least: int, times: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, n, *_, (row, start, length, period) in _scans(batch, least, times):
                ids = batch.column("doc_id").slice(low, n).take(pa.array(row))
                yield pa.RecordBatch.from_arrays([ids, *[pa.array(x, pa.int64()) for x in (start, length, period)]], ["doc_id", "start", "length", "period"])

    return run


def _collapsed(least: int, times: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, n, raw, offsets, start, stop, bounds, found in _scans(batch, least, times):
                texts = [x.decode("utf-8", "replace") for x in _kept_texts(raw, offsets, start, stop, bounds, ~_dropped(bounds, *found))]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(low, n), pa.array(texts, pa.string())], ["doc_id", "text"])

    return run


def _digests(least: int, times: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        empty = hashlib.sha256(b"").hexdigest()
        for batch in batches:
            for low, n, raw, offsets, begin, stop, bounds, found in _scans(batch, least, times):
                row, start, length, period = found
                count = np.bincount(row, minlength=n)
                best = np.lexsort((period, start, -length, row))
                top = np.zeros(n, np.int64)
                top[row[best][::-1]] = best[::-1]  # the first of each row stays
                none = count == 0
                at = np.r_[0, np.cumsum(count)]
                listed = [f"{s},{l},{q}\n" for s, l, q in zip(start.tolist(), length.tolist(), period.tolist(), strict=True)]
                pick = lambda x: pa.array(x[top] if len(x) else np.zeros(n, np.int64), pa.int64(), mask=none)  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(low, n),
                        pa.array(count.astype(np.int64)),
                        pick(start),
                        pick(length),
                        pick(period),
                        pick(1000 * length // np.maximum(1, period)),
                        pa.array([hashlib.sha256("".join(listed[a:b]).encode()).hexdigest() if a < b else empty for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.string()),
                        pa.array([hashlib.sha256(x).hexdigest() for x in _kept_texts(raw, offsets, begin, stop, bounds, ~_dropped(bounds, *found))], pa.string()),
                    ],
                    ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"],
                )

    return run


def _texts(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, str]:
    bounded_batches(docs.sparkSession)
    docs = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return docs, docs.schema["doc_id"].dataType.simpleString()


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, times: int = TIMES) -> DataFrame:
    """(doc_id, start, length, period): every run of every whole text, starts in words from 0.

    A run is a stretch of words (of bytes other than 09-0D and 20) in which words ``period`` apart are
    equal and no smaller period does, of ``times`` periods and ``least`` words at least, that no
    neighbouring word extends. ``times`` is 4 or more. Runs may overlap; all are returned. Null and empty texts have none.
    Very long texts are taken whole, by some 100 bytes a word of memory; a repeated row gives its runs
    again, a null id stays null. Words are told apart by 64-bit hashes. Other columns, whatever their names, are
    ignored. An empty table gives no rows. There is no shuffle.
    """
    if times < 4:
        raise ValueError("runs of less than four periods are not all proposed")
    docs, kind = _texts(docs, id_col, text_col)
    return docs.mapInArrow(_runs(least, times), f"doc_id {kind}, start long, length long, period long")


def collapse_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, times: int = TIMES) -> DataFrame:
    """(doc_id, text): the texts without the words that lie in a run behind its first period, joined by one blank; a row per input row, edges as in ``periodic_runs``."""
    docs, kind = _texts(docs, id_col, text_col)
    return docs.mapInArrow(_collapsed(least, times), f"doc_id {kind}, text string")


def run_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, times: int = TIMES) -> DataFrame:
    """(doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256), a row per input row.

    The four numbers are those of the longest run (ties: least start, then period), null without one. ``runs_sha256`` is
    of all runs' lines ``start,length,period``, ``collapsed_sha256`` of the text of ``collapse_runs``. Edges as in
    ``periodic_runs``; null and empty texts have the digests of the empty string.
    """
    docs, kind = _texts(docs, id_col, text_col)
    return docs.mapInArrow(_digests(least, times), f"doc_id {kind}, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string")


def planted(id_col: Column, text_col: Column) -> Column:
    """A text with a period planted from a place on, where the id's CRC-32 ends in 0; its words are joined by one blank.

    With g the checksum without its last digit, the words from a = g % n on repeat those a .. a + p - 1,
    where p = 1 + floor((n - a) / (3 + g % 8)).
    """
    h = F.crc32(id_col.cast("string"))
    g = F.floor(h / 10)

    def from_words(words: Column) -> Column:
        n = F.size(words)
        a = g % n
        p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))
        back = F.transform(F.sequence(a, (n - 1).cast("long")), lambda i: F.element_at(words, (a + (i - a) % p + 1).cast("int")))
        return F.when(n > 0, F.array_join(F.concat(F.slice(words, F.lit(1), a.cast("int")), back), " ")).otherwise(text_col)

    words = F.filter(F.split(text_col, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return F.when(h % 10 == 0, F.transform(F.array(words), from_words)[0]).otherwise(text_col)
