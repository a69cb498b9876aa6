"""Pieces that several corpus operators share: Arrow slices, word hashes, id filters, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.session import Workspace

#: Text bytes that one vectorised step handles; bounds a Python worker's memory.
SLICE_BYTES = 1 << 18
#: The most bytes of a counted table that are sent to every executor; a larger one is joined by shuffle.
BROADCAST_BYTES = 32 << 20
#: Bytes of a broadcast row besides its values, and of a value by type (a string's are taken as 64).
ROW_BYTES, VALUE_BYTES = 24, {"bigint": 8, "int": 8, "string": 64}

#: Edges (both directions) of a graph that one task may hold.
SMALL_GRAPH = 10_000

U64 = np.uint64
_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_RNG = np.random.default_rng(20240517)
_LANES = _RNG.integers(1, 2**63, (2, 3), dtype=np.uint64) * U64(2) + U64(1)
_SHINGLE = _RNG.integers(1, 2**63, 64, dtype=np.uint64) * U64(2) + U64(1)
#: Bytes up to which a word is hashed in the vectorised loop; longer ones are hashed one by one.
SHORT_WORD = 64


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (shift-multiply) that spreads every input bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _hash_words(raw: np.ndarray, start: np.ndarray, stop: np.ndarray, lanes: int) -> list[np.ndarray]:
    """Independent 64-bit hashes of the words' bytes: eight bytes a step through ``mix``, xxh3 for long words.

    Each step is a bijection of the state that multiplies and shifts, so no pattern of letters
    cancels out, as it can in a polynomial.
    """
    size = stop - start
    padded = np.zeros(len(raw) + 8, np.uint8)
    padded[: len(raw)] = raw
    eight = np.ndarray((len(raw) + 1,), "<u8", padded, strides=(1,))
    out = [mix(size.astype(U64) * _LANES[k, 0] + _LANES[k, 1]) for k in range(lanes)]
    live = np.flatnonzero(size <= SHORT_WORD)
    at = 0
    while len(live):
        left = size[live] - at
        chunk = eight[start[live] + at]
        part = left < 8
        chunk[part] &= (U64(1) << (U64(8) * left[part].astype(U64))) - U64(1)
        for k in range(lanes):
            out[k][live] = mix((out[k][live] ^ chunk) * _LANES[k, 2] + _LANES[k, 1])
        live = live[left > 8]
        at += 8
    for i in np.flatnonzero(size > SHORT_WORD):
        body = raw[start[i] : stop[i]].tobytes()
        for k in range(lanes):
            out[k][i] = xxhash.xxh3_64_intdigest(body, seed=int(_LANES[k, 1]))
    return out


def word_hashes(raw: np.ndarray, lower: bool = False, lanes: int = 1) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Hashes (one array a lane), start and end of every word (run of bytes outside 09-0D and 20) of a UTF-8 buffer."""
    out, at, n = [], 0, len(raw)
    while at < n:
        end = min(n, at + SLICE_BYTES)
        while end < n:  # cut at white space, so that no word is split
            blank = np.flatnonzero(_WHITE[raw[end : end + 4096]])
            if len(blank):
                end += int(blank[0])
                break
            end = min(n, end + 4096)
        part = raw[at:end]
        if lower:
            part = _LOWER[part]
        word = np.empty(len(part) + 2, np.int8)
        word[0] = word[-1] = 0
        word[1:-1] = ~_WHITE[part]
        step = np.diff(word)
        start, stop = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        out.append((*_hash_words(part, start, stop, lanes), start + at, stop + at))
        at = end
    if not out:
        return [np.zeros(0, U64)] * lanes, np.zeros(0, np.int64), np.zeros(0, np.int64)
    *words, start, stop = (np.concatenate(x) for x in zip(*out, strict=True))
    return words, start, stop


def combined(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Hash of a pair of hashes, a bijection of either for a fixed other one."""
    return mix(mix(x + U64(0x9E3779B97F4A7C15)) ^ (y * U64(0xD6E8FEB86659FD93)))


def run_hashes(words: np.ndarray, *sizes: int) -> list[np.ndarray]:
    """For each size the hashes of all runs of so many words, built by doubling: equal runs have equal hashes."""
    done: list[np.ndarray | None] = [None] * len(sizes)
    taken = [0] * len(sizes)
    power, length = words, 1
    while length <= max(sizes):
        for i, size in enumerate(sizes):
            if size & length:
                n = max(0, len(words) - taken[i] - length + 1)
                done[i] = power[:n] if done[i] is None else combined(done[i][:n], power[taken[i] :][:n])
                taken[i] += length
        n = max(0, len(words) - 2 * length + 1)
        power = combined(power[:n], power[length:][:n])
        length *= 2
    return done


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words; of the whole sequence if it is shorter; none without words."""
    n = len(words)
    if n == 0:
        return np.zeros(0, U64)
    if n < k:
        return mix(np.array([np.sum(words * _SHINGLE[:n], dtype=U64) + U64(n)], U64))
    total = words[: n - k + 1] * _SHINGLE[0]
    for j in range(1, k):
        total += words[j : n - k + 1 + j] * _SHINGLE[j]
    return mix(total + U64(k))


def text_slices(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows with about SLICE_BYTES of text; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    if not len(column):
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        end = int(np.searchsorted(offsets, offsets[at] + SLICE_BYTES, "right")) - 1
        end = min(len(column), max(end, at + 1))
        yield at, end, raw[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def row_words(raw: np.ndarray, offsets: np.ndarray, lower: bool, lanes: int = 1) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes (an array a lane), starts and ends of a slice, and for each row its first word's index (with the end).

    Rows lie one after another without a separator, so rows are parted by hand where needed.
    """
    cuts = np.zeros(len(raw) + len(offsets), np.uint8)
    cuts[:] = 0x20
    shift = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    cuts[np.arange(len(raw)) + shift] = raw
    words, start, stop = word_hashes(cuts, lower, lanes)
    bounds = np.searchsorted(start, offsets + np.arange(len(offsets)))
    return words, start, stop, bounds


def fits_broadcast(df: DataFrame, n: int) -> bool:
    """Whether ``n`` rows of ``df`` (numbers and short strings) stay within BROADCAST_BYTES."""
    width = ROW_BYTES + sum(VALUE_BYTES.get(f.dataType.simpleString(), 64) for f in df.schema.fields)
    return n * width <= BROADCAST_BYTES


def ids_only(df: DataFrame, ids: DataFrame, key: str | list[str], n: int, keep: bool = True) -> DataFrame:
    """Rows of ``df`` whose key is (or, with keep=False, is not) in ``ids``, a table of ``n`` distinct keys.

    A set of up to BROADCAST_BYTES goes to every executor, so ``df`` is not shuffled; a larger one
    is joined by shuffle.
    """
    small = F.broadcast(ids) if fits_broadcast(ids, n) else ids
    return df.join(small, key, "left_semi" if keep else "left_anti")


def signed(x: np.ndarray) -> np.ndarray:
    """Unsigned hashes as Spark's signed longs."""
    return x.view(np.int64)


def _whole_graph(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(u, to) with the smallest node of u's component, for a graph of at most SMALL_GRAPH edges in one task."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for batch in batches:
        for u, v in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist(), strict=True):
            low, high = sorted((root(u), root(v)))
            parent[high] = low
    nodes = list(parent)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([root(x) for x in nodes], pa.int64())], ["u", "to"])


def connected_components(ws: Workspace, edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of an undirected edge table; component is its smallest node.

    Random contraction: in a round every node draws a priority by hash, hooks to the neighbour (or
    itself) of least priority and on to that one's; nodes that meet become one, and the edges between
    what is left make the next round. As priorities are drawn anew, a constant part of the nodes goes
    in each round, whatever the order of the ids: rounds grow with the logarithm of the graph, also on
    a path. What has at most SMALL_GRAPH edges left is finished in one task. Tables of a round are
    written to the shared folder, none goes to the driver.
    """
    pair = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v"))
    pair = ws.save(pair.union(pair.select("v", "u")).distinct(), "edges")
    nodes = ws.save(pair.select(F.col("u").alias("node")).distinct().withColumn("label", F.col("node")), "nodes")
    both = pair.filter("u <> v")
    left = both.count()
    rounds = 0
    while left:
        if left <= SMALL_GRAPH:
            hook = ws.save(both.coalesce(1).mapInArrow(_whole_graph, "u long, to long"), "hooks")
        else:
            draw = lambda c: F.struct(F.xxhash64(F.lit(rounds), c).alias("p"), F.col(c).alias("x"))  # noqa: B023, E731
            first = both.groupBy("u").agg(F.min(draw("v")).alias("v")).select("u", F.least("v", draw("u"))["x"].alias("to"))
            first = ws.save(first, "first")
            onward = first.select(F.col("u").alias("to"), F.col("to").alias("next"))
            hook = ws.save(first.join(onward, "to").select("u", F.col("next").alias("to")), "hooks")
            ws.drop(first)
        moved = nodes.join(hook, nodes["label"] == hook["u"], "left")
        before, nodes = nodes, ws.save(moved.select("node", F.coalesce("to", "label").alias("label")), "nodes")
        ws.drop(before)
        rounds += 1
        if left <= SMALL_GRAPH:
            break
        at = lambda c: hook.select(F.col("u").alias(c), F.col("to").alias(f"{c}_to"))  # noqa: B023, E731
        rest = both.join(at("u"), "u").join(at("v"), "v").select(F.col("u_to").alias("u"), F.col("v_to").alias("v"))
        both = ws.save(rest.filter("u <> v").distinct(), "edges")
        ws.drop(hook)
        left = both.count()
    least = nodes.groupBy("label").agg(F.min("node").alias("component"))
    return ws.save(nodes.join(ws.save(least, "least"), "label").select("node", "component"), "components")


def merged_components(ws: Workspace, labels: DataFrame, links: DataFrame) -> DataFrame:
    """Components (node, component) after further links (a, b): only the components that links join are looked at again."""
    at = lambda c: labels.select(F.col("node").alias(c), F.col("component").alias(f"c{c}"))
    ends = links.join(at("a"), "a", "left").join(at("b"), "b", "left")
    ends = ends.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")).filter("a <> b").distinct()
    ends = ws.save(ends, "joined")
    if ends.isEmpty():
        return labels
    over = connected_components(ws, ends)
    top = over.select(F.col("node").alias("component"), F.col("component").alias("top"))
    moved = labels.join(top, "component", "left").select("node", F.coalesce("top", "component").alias("component"))
    alone = over.join(labels.select("node"), "node", "left_anti").select("node", "component")
    return ws.save(moved.union(alone), "merged")
