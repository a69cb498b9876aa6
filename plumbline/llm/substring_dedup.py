"""Substring dedup by seed and extend: winnowed anchors, extension both ways, maximal repeats.

A window is WINDOW consecutive words. Winnowing gives each window one anchor: the leftmost least
hash among its SEED-word runs. Equal windows have equal anchors at equal places, so a window can
only repeat where its anchor does. The windows that chose an anchor are its reach. In periodic text
one reach may follow on itself many times; such a run is kept as one.

Seeds are anchors that are least among their neighbours in the document; each takes the anchors
nearest to it as its block. Documents are joined on seeds: a block is matched with that of the
smallest document, and the match extended both ways, reach by reach, as far as they are equal. That
settles a whole block by one row. What no seed settles goes on to a join on anchors, where equal reaches
repeat over their whole reach, and where reaches of one anchor differ, the extension goes window by
window. Overlapping repeats are merged to maximal ones, all at least WINDOW words long.

Reaches and windows are compared by 128 bits from two independent hashes of every word, besides
the anchor's 64.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import BROADCAST_BYTES, combined, fits_broadcast, ids_only, mix, row_words, run_hashes, signed, text_slices
from plumbline.session import Workspace

WINDOW, SEED = 50, 16
#: Anchors on either side among which a seed is least, and the farthest that a seed's block goes.
NEAR, FAR = 2, 16
_ENTRY = ["anchor", "ra", "rb", "lo", "n", "times"]
_ENTRIES = "array<struct<anchor: long, ra: long, rb: long, lo: int, n: int, times: int>>"


def _windows(raw: np.ndarray, offsets: np.ndarray, window: int, seed: int) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Hashes of seed-word runs, two lanes of hashes of windows, and the rows' first words."""
    words, _, _, bounds = row_words(raw, offsets, lower=False, lanes=2)
    grams, first = run_hashes(words[0], seed, window)
    return grams, [first, run_hashes(words[1], window)[0]], bounds


def _reach_hash(lane: np.ndarray, lo: np.ndarray, n: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Hash of ``n`` windows from ``lo``, whose first and last overlap or touch and so hold all their words."""
    return combined(combined(lane[lo], lane[lo + n - 1]), (n * 4096 + at).astype(np.uint64))


def _blocks_of(anchor: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start of every block of anchors, and the index of its seed (-1: none)."""
    n = len(anchor)
    rank = mix(anchor ^ np.uint64(0x5851F42D4C957F2D))
    least = np.ones(n, bool)
    for gap in range(1, NEAR + 1):
        same = row[gap:] == row[:-gap]
        least[gap:] &= ~same | (rank[gap:] < rank[:-gap])
        least[:-gap] &= ~same | (rank[:-gap] <= rank[gap:])
    seeds = np.flatnonzero(least)
    at = np.arange(n)
    owner = np.full(n, -1)
    if len(seeds):
        after = np.searchsorted(seeds, at, "right")
        left, right = seeds[np.maximum(after - 1, 0)], seeds[np.minimum(after, len(seeds) - 1)]
        gap_left = np.where((after > 0) & (row[left] == row), at - left, n)
        gap_right = np.where((after < len(seeds)) & (row[right] == row), right - at, n)
        owner = np.where(gap_left <= gap_right, left, right)
        owner[np.minimum(gap_left, gap_right) > FAR] = -1
    new = np.concatenate([[True], (owner[1:] != owner[:-1]) | (row[1:] != row[:-1])])
    new |= (owner < 0) & (at % (2 * FAR) == 0)
    start = np.flatnonzero(new)
    return start, owner[start]


def _blocks(window: int, seed: int):
    span = window - seed + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, tags = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "tag"))
            for low, high, raw, offsets in text_slices(batch.column("text")):
                grams, lanes, bounds = _windows(raw, offsets, window, seed)
                start = np.arange(len(lanes[0]))
                if not len(start):
                    continue
                row = np.searchsorted(bounds, start, "right") - 1
                pick = np.empty(len(start), np.int64)
                for a in range(0, len(start), 20_000):
                    view = np.lib.stride_tricks.sliding_window_view(grams[a : a + 20_000 + span - 1], span)
                    pick[a : a + len(view)] = view.argmin(axis=1)
                pick += start
                inside = start + window <= bounds[row + 1]
                start, row, pick = start[inside], row[inside], pick[inside]
                if not len(start):
                    continue
                new = np.concatenate([[True], (pick[1:] != pick[:-1]) | (row[1:] != row[:-1])])
                first = np.flatnonzero(new)
                count = np.diff(np.concatenate([first, [len(start)]]))
                lo, anchor, row = start[first], pick[first], row[first]
                reaches = [_reach_hash(lane, lo, count, anchor - lo) for lane in lanes]
                # in periodic text one reach follows on itself: such a run is one entry
                again = (row[1:] == row[:-1]) & (grams[anchor[1:]] == grams[anchor[:-1]]) & (count[1:] == count[:-1])
                for reach in reaches:
                    again &= reach[1:] == reach[:-1]
                first = np.flatnonzero(np.concatenate([[True], ~again]))
                times = np.diff(np.append(first, len(lo)))
                lo, anchor, row, count, reaches = lo[first], anchor[first], row[first], count[first], [reach[first] for reach in reaches]
                begin, owner = _blocks_of(grams[anchor], row)
                entries = pa.StructArray.from_arrays(
                    [
                        pa.array(signed(grams[anchor])),
                        pa.array(signed(reaches[0])),
                        pa.array(signed(reaches[1])),
                        pa.array((lo - bounds[row]).astype(np.int32)),
                        pa.array(count.astype(np.int32)),
                        pa.array(times.astype(np.int32)),
                    ],
                    _ENTRY,
                )
                own = np.maximum(owner, 0)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(signed(grams[anchor[own]]), mask=owner < 0),
                        pa.array(ids[low:high][row[begin]].astype(np.int64)),
                        pa.array(tags[low:high][row[begin]].astype(np.int64)),
                        pa.array(np.where(owner < 0, 0, owner - begin + 1).astype(np.int32)),
                        pa.ListArray.from_arrays(np.append(begin, len(lo)).astype(np.int32), entries),
                    ],
                    ["seed", "doc_id", "tag", "at", "entries"],
                )

    return run


def _window_rows(window: int, seed: int):
    """Windows of the given reaches (list of entries) of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = batch.column("spans")
            for low, high, raw, offsets in text_slices(batch.column("text")):
                _, lanes, bounds = _windows(raw, offsets, window, seed)
                part = spans.slice(low, high - low)
                items = part.flatten()
                row = np.repeat(np.arange(high - low), [len(x) if x is not None else 0 for x in part])
                anchor, ra, rb, lo, n = (items.field(i).to_numpy(zero_copy_only=False) for i in range(5))
                which = np.repeat(np.arange(len(lo)), n)
                step = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
                start = bounds[row][which] + lo[which] + step
                ids = batch.column("doc_id").slice(low, high - low).to_numpy(zero_copy_only=False)
                columns = [anchor[which], signed(lanes[0][start]), signed(lanes[1][start]), ra[which], rb[which], ids[row][which], step.astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["anchor", "wa", "wb", "ra", "rb", "doc_id", "step"])

    return run


def _extended(blocks: DataFrame, models: DataFrame, window: int) -> DataFrame:
    """Every block with the span that its seed's model settles (lo, hi; else null) and the entries left over.

    The model is the block of the smallest document that has the seed. From the seed the match is
    extended to the right and to the left as long as the entries' reaches are equal.
    """
    rows = blocks.join(models, (F.col("seed") == F.col("model_seed")) & (F.col("doc_id") > F.col("model_doc")), "left")
    same = lambda x, y: F.coalesce((x["anchor"] == y["anchor"]) & (x["ra"] == y["ra"]) & (x["rb"] == y["rb"]), F.lit(False))
    length = lambda x, y: F.coalesce(F.nullif(F.array_position(F.zip_with(x, y, same), F.lit(False)), F.lit(0)) - 1, F.least(F.size(x), F.size(y)))
    right = lambda e, at: F.slice(e, F.greatest(F.col(at), F.lit(1)), F.size(e))
    left = lambda e, at: F.reverse(F.slice(e, F.lit(1), F.greatest(F.col(at) - 1, F.lit(0))))
    found = F.col("model").isNotNull()
    rows = rows.withColumn("after", F.when(found, length(right("entries", "at"), right("model", "model_at"))).otherwise(0))
    rows = rows.withColumn("before", F.when(found, length(left("entries", "at"), left("model", "model_at"))).otherwise(0))
    settled = F.col("after") + F.col("before") > 0
    first, last = (F.element_at("entries", F.greatest(x, F.lit(1)).cast("int")) for x in (F.col("at") - F.col("before"), F.col("at") + F.col("after") - 1))
    outside = F.filter("entries", lambda e, i: (i + 1 < F.col("at") - F.col("before")) | (i + 1 >= F.col("at") + F.col("after")))
    return rows.select(
        "doc_id",
        "tag",
        F.when(settled, first["lo"]).alias("lo"),
        F.when(settled, last["lo"] + last["n"] * last["times"] - 1 + window).alias("hi"),
        F.when(settled, outside).otherwise(F.col("entries")).alias("rest"),
    )


def repeated_spans(ws: Workspace, docs: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """(doc_id, tag, spans array<struct<lo, hi>>): word ranges that repeat from a document with a smaller doc_id.

    ``tag`` is a hash of the text: it parts the rows that share a doc_id.
    """
    docs = docs.filter("doc_id is not null")
    span = [F.min("doc_id").alias("low"), F.max("doc_id").alias("high")]
    # seeds: the smallest document's block is the model of all others
    blocks = ws.save(docs.mapInArrow(_blocks(window, seed), f"seed long, doc_id long, tag long, at int, entries {_ENTRIES}"), "blocks")
    lows = ws.save(blocks.filter("seed is not null").groupBy("seed").agg(*span).filter("low < high").select("seed", F.col("low").alias("doc_id")), "lows")
    models = blocks.join(lows, ["seed", "doc_id"]).groupBy(F.col("seed").alias("model_seed"), F.col("doc_id").alias("model_doc"))
    models = ws.save(models.agg(F.min(F.struct("tag", "entries", "at")).alias("m")).select("model_seed", "model_doc", F.col("m.entries").alias("model"), F.col("m.at").alias("model_at")), "models")
    facts = models.agg(F.count("*").alias("n"), F.sum(F.size("model")).alias("entries")).first()
    small = facts.n * 64 + (facts.entries or 0) * 48 <= BROADCAST_BYTES  # else the blocks are shuffled by seed
    extended = ws.save(_extended(blocks, F.broadcast(models) if small else models, window), "extended")
    ws.drop(blocks, lows, models)
    settled = extended.filter("lo is not null").select("doc_id", "tag", "lo", "hi")

    # anchors that no seed has settled
    anchors = extended.select("doc_id", "tag", F.explode("rest").alias("e")).select("e.*", "doc_id", "tag")
    single = (F.min("ra") == F.max("ra")) & (F.min("rb") == F.max("rb"))
    common = anchors.groupBy("anchor").agg(*span, single.alias("single")).filter("low < high")
    common = ws.save(common.select("anchor", "low", "single"), "common")
    met = shared = ws.save(anchors.join(common, "anchor"), "shared")
    interval = ["doc_id", "tag", "lo", (F.col("lo") + F.col("n") * F.col("times") - 1 + window).alias("hi")]
    # anchors with one reach: the smallest document is known already
    alike = shared.filter("single and doc_id > low").select(*interval)

    # a reach is one row here, however often it occurs
    reach = ["anchor", "ra", "rb"]
    shared = shared.filter("not single").select(*_ENTRY, "doc_id", "tag")
    reaches = ws.save(shared.groupBy(*reach).agg(*span), "reaches")
    later = reaches.filter("low < high").select(*reach, "low")
    whole = ws.save(shared.join(later, reach).filter("doc_id > low").select(*interval), "whole")

    # where reaches differ: the smallest document of each, window by window
    partial = reaches.select(*reach, F.col("low").alias("doc_id"))
    sources = shared.join(partial, [*reach, "doc_id"])
    sources = ws.save(sources.groupBy("doc_id", "tag", *reach).agg(F.min("lo").alias("lo"), F.first("n").alias("n"), F.lit(1).alias("times")), "sources")
    lists = ws.save(sources.groupBy("doc_id", "tag").agg(F.collect_list(F.struct(*_ENTRY)).alias("spans")), "lists")
    texts = ids_only(docs, lists.select("doc_id").distinct(), "doc_id", lists.count()).join(lists, ["doc_id", "tag"])
    windows = texts.select("doc_id", "text", "spans").mapInArrow(_window_rows(window, seed), "anchor long, wa long, wb long, ra long, rb long, doc_id long, step int")
    windows = ws.save(windows, "windows")
    lows = windows.groupBy("anchor", "wa", "wb").agg(*span).filter("low < high")
    lows = ws.save(lows.select("anchor", "wa", "wb", "low"), "lows")
    steps = windows.join(lows, ["anchor", "wa", "wb"]).filter("doc_id > low")
    steps = ws.save(steps.groupBy(*reach, "doc_id").agg(F.collect_set("step").alias("steps")), "steps")
    some = shared.join(steps, [*reach, "doc_id"])
    every = some.filter(F.size("steps") == F.col("n")).select(*interval)
    some = some.filter(F.size("steps") < F.col("n")).withColumn("step", F.explode("steps")).withColumn("turn", F.explode(F.sequence(F.lit(0), F.col("times") - 1)))
    some = some.withColumn("lo", F.col("lo") + F.col("turn") * F.col("n") + F.col("step")).select("doc_id", "tag", "lo", (F.col("lo") + window).alias("hi"))
    out = settled.union(alike).union(whole).union(every).union(some).groupBy("doc_id", "tag").agg(F.array_sort(F.collect_list(F.struct("lo", "hi"))).alias("spans"))
    out = ws.save(out, "spans")
    ws.drop(extended, common, met, reaches, whole, sources, lists, windows, lows, steps)
    return out


def _cut(raw: bytes, words: tuple[np.ndarray, np.ndarray], gone: np.ndarray) -> bytes:
    """The text without the removed words and the white space after them."""
    start, stop = words
    keep = np.ones(len(raw), bool)
    edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
    for a, b in edges.reshape(-1, 2):
        keep[start[a] : start[b] if b < len(start) else len(raw)] = False
    return np.frombuffer(raw, np.uint8)[keep].tobytes()


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans = batch.column("spans") if "spans" in batch.schema.names else None
        for low, high, raw, offsets in text_slices(batch.column("text")):
            n_words, n_gone, digest = [], [], []
            for i in range(high - low):
                body = raw[offsets[i] : offsets[i + 1]].tobytes()
                words = body.split()
                n_words.append(len(words))
                cuts = spans[low + i].as_py() if spans is not None else None
                if cuts:
                    edge = np.zeros(len(words) + 1, np.int64)
                    np.add.at(edge, [c["lo"] for c in cuts], 1)
                    np.add.at(edge, [c["hi"] for c in cuts], -1)
                    gone = np.cumsum(edge)[:-1] > 0
                    n_gone.append(int(gone.sum()))
                    kept = b" ".join(w for w, g in zip(words, gone, strict=True) if not g)
                else:
                    n_gone.append(0)
                    kept = b" ".join(words)
                digest.append(hashlib.sha256(kept).hexdigest())
            out = [batch.column("doc_id").slice(low, high - low), pa.array(n_words, pa.int64()), pa.array(n_gone, pa.int64()), pa.array(digest)]
            names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
            yield pa.RecordBatch.from_arrays(out, names)


_RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """Whole texts without the words of repeated windows: (doc_id, n_words, n_removed, kept_sha256), a row per input row.

    Words are runs of bytes outside 09-0D and 20, unchanged. A word goes if a window of ``window``
    words that covers it also starts in a row with a smaller doc_id; windows are judged on the
    input. ``kept_sha256`` is of the kept words joined by one space.

    Null and empty texts have no words. Texts shorter than a window keep all. Rows that repeat a
    doc_id do not remove each other's words, and each loses what a smaller doc_id has. Rows with a
    null doc_id lose and cause nothing. Other columns are ignored. An empty table gives no rows. Very
    long texts are taken whole, in blocks of anchors; a task holds some 50 bytes a word of one.
    """
    ws = Workspace(docs.sparkSession, "substring")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    docs = docs.withColumn("tag", F.xxhash64("text"))
    spans = repeated_spans(ws, docs, window, seed)
    schema = _RESULT
    n = spans.count()
    ids = spans.select("doc_id").distinct()
    if not fits_broadcast(ids, n):
        return docs.join(spans, ["doc_id", "tag"], "left").mapInArrow(_kept, schema)
    free = docs.join(F.broadcast(ids), "doc_id", "left_anti").mapInArrow(_kept, schema)
    cut = ids_only(docs, ids, "doc_id", n).join(spans, ["doc_id", "tag"], "left").mapInArrow(_kept, schema)
    return free.union(cut)


def _cut_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts without the words of ``spans``; the other columns, in ``row``, pass."""
    for batch in batches:
        texts = batch.column("text").cast(pa.large_binary())
        out = []
        for text, cuts in zip(texts, batch.column("spans"), strict=True):
            body = text.as_py()
            if body is not None and cuts.is_valid:
                cells = np.frombuffer(body, np.uint8)
                white = np.isin(cells, [32, 9, 10, 11, 12, 13])
                step = np.diff(np.concatenate([[0], (~white).astype(np.int8), [0]]))
                start, stop = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
                edge = np.zeros(len(start) + 1, np.int64)
                spans = cuts.as_py()
                np.add.at(edge, [c["lo"] for c in spans], 1)
                np.add.at(edge, [c["hi"] for c in spans], -1)
                body = _cut(body, (start, stop), np.cumsum(edge)[:-1] > 0)
            out.append(body)
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(out, pa.binary()).cast(pa.string())], ["row", "text"])


def with_repeats_cut(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """``docs`` with all its columns, its texts without repeated windows as ``remove_repeats`` defines them.

    A removed run goes with the white space after it, all else stays as it is; texts that lose
    nothing are unchanged, and null texts stay null. Texts that lose every word become empty.
    Columns of any name pass: they travel in a struct.
    """
    ws = Workspace(docs.sparkSession, "substring")
    text = F.col(f"`{text_col}`").cast("string")
    rest = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("tag"), F.struct(*rest).alias("row"))
    spans = repeated_spans(ws, rows.select("doc_id", "text", "tag"), window, seed)
    n = spans.count()
    ids = spans.select("doc_id").distinct()
    shape = T.StructType([rows.schema["row"], T.StructField("text", T.StringType())])
    cut = lambda d: d.join(spans, ["doc_id", "tag"], "left").select("row", "text", "spans").mapInArrow(_cut_text, shape)
    if fits_broadcast(ids, n):
        free = rows.join(F.broadcast(ids), "doc_id", "left_anti").select("row", "text")
        out = free.union(cut(ids_only(rows, ids, "doc_id", n)))
    else:
        out = cut(rows)
    return out.select(*[F.col("text").alias(c) if c == text_col else F.col(f"row.`{c}`") for c in docs.columns])
