"""MinHash near-duplicates by an LSH forest, confirmed on full shingle sets.

Every distinct word sequence gets 128 MinHash values. Each of TREES trees sorts the documents by
its own order of these values. Neighbours in a tree's sorted order that share a prefix of at least
BASE_DEPTH values are candidates. A region (run of one prefix) of more than REGION documents is
looked at deeper: its sub-regions are used where they are small enough, and at the last depth each
document is paired with its next NEXT neighbours. So candidates grow with the documents, not with
the square of a region. All candidates end in one component or are checked on full sets.

What a large region may hide after that is closed, over all documents of large regions that still
hold several components. Shingles are ordered by how often they occur there (the rarest first). Two
documents of the wanted similarity share a shingle that is among the rarest seventh of the smaller and
the rarest quarter of the larger one, so only documents and components that meet in such a
shingle are compared: pages of one template, whose rarest shingles are their own, never meet. They are compared by WIDE MinHash values, block by block, and what may be similar
is checked on full sets. Only links come out of either step.

At similarity 0.75 a pair misses all TREES base prefixes with probability (1 - 0.75**3)**32, about
2e-8; it has fewer than CLOSE[1] of WIDE equal values with 3e-10, and fewer than CLOSE[0] of the
first SIGNATURE ones, which are looked at before, with as much. The rarest shingles miss nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import (
    U64,
    connected_components,
    fits_broadcast,
    ids_only,
    merged_components,
    mix,
    row_words,
    shingle_hashes,
    signed,
    text_slices,
)
from plumbline.session import Workspace

SHINGLE, PERCENT = 5, 75
TREES, BASE_DEPTH, DEEPER = 32, 3, 4
SIGNATURE, WIDE = 128, 512
REGION, NEXT = 8, 2
#: Equal values among the first SIGNATURE and among all WIDE below which a pair of a large region is not checked.
CLOSE = 64, 321
#: Documents of a block, in the steps that compare blocks.
BLOCK = 512
#: Counters of the shingles' frequencies, a power of two; they set an order only, so shared ones cost time, not results.
SLOTS = 1 << 20
#: Best candidates of a document that are checked before the first components are formed.
FIRST_LINKS = 3

_RNG = np.random.default_rng(7)
_FACTORS = _RNG.integers(1, 2**63, SIGNATURE, dtype=np.uint64) * U64(2) + U64(1)
_BASE = np.arange(TREES * BASE_DEPTH).reshape(TREES, BASE_DEPTH)
_DEEP = np.stack([_RNG.permutation(SIGNATURE)[:DEEPER] for _ in range(TREES)])
_WIDE_FACTORS = _RNG.integers(1, 2**63, WIDE, dtype=np.uint64) * U64(2) + U64(1)
_KEY = _RNG.integers(1, 2**63, BASE_DEPTH, dtype=np.uint64) * U64(2) + U64(1)


def _sets(batch: pa.RecordBatch, k: int) -> Iterator[tuple[int, list[np.ndarray], list[bytes]]]:
    """First row of each slice, with every row's sorted distinct shingle hashes and folded text (words joined by a blank)."""
    for low, _, raw, offsets in text_slices(batch.column("text")):
        (words,), _, _, bounds = row_words(raw, offsets, lower=True)
        sets = [np.unique(shingle_hashes(words[a:b], k)) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        yield low, sets, [b" ".join(raw[a:b].tobytes().lower().split()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


def _flat(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows whose set is not empty, their elements one after another, and where each begins."""
    sizes = np.array([len(s) for s in sets])
    some = np.flatnonzero(sizes)
    if not len(some):
        return some, np.zeros(0, U64), some
    return some, np.concatenate([sets[i] for i in some]), np.concatenate([[0], np.cumsum(sizes[some])[:-1]])


def _least(flat: np.ndarray, starts: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """MinHash values of all sets, a column per factor."""
    out = np.empty((len(starts), len(factors)), U64)
    for j, factor in enumerate(factors):
        out[:, j] = np.minimum.reduceat(flat * factor, starts)
    return out


def _signatures(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, sets, folded in _sets(batch, k):
                n = len(sets)
                some, flat, starts = _flat(sets)
                base, deep = np.zeros((n, TREES), U64), np.zeros((n, TREES), U64)
                if len(some):
                    sig = _least(flat, starts, _FACTORS)
                    tree = np.arange(TREES, dtype=U64)
                    base[some] = mix((sig[:, _BASE] * _KEY).sum(axis=2, dtype=U64) + tree * U64(0x632BE59BD9B4E019))
                    for d in range(DEEPER):
                        deep[some] = (deep[some] << U64(16)) | (mix(sig[:, _DEEP[:, d]]) >> U64(48))
                digests = np.frombuffer(b"".join(hashlib.blake2b(x, digest_size=16).digest() for x in folded), np.int64).reshape(-1, 2)
                lists = lambda x: pa.ListArray.from_arrays(np.arange(0, (len(x) + 1) * TREES, TREES, dtype=np.int32), signed(np.ascontiguousarray(x).ravel()))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(low, n),
                        pa.array(np.array([len(x) for x in sets], np.int64)),
                        pa.array(digests[:, 0].copy()),
                        pa.array(digests[:, 1].copy()),
                        lists(base),
                        lists(deep ^ U64(1 << 63)),
                    ],
                    ["doc_id", "n", "d1", "d2", "base", "deep"],
                )

    return run


def _sketches(k: int):
    """WIDE MinHash values of whole texts, a byte each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, sets, _ in _sets(batch, k):
                some, flat, starts = _flat(sets)
                rows = (mix(_least(flat, starts, _WIDE_FACTORS)) >> U64(56)).astype(np.uint8) if len(some) else []
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(low, len(sets)).take(pa.array(some)), pa.array([x.tobytes() for x in rows], pa.binary())], ["doc", "sketch"])

    return run


def _pairs_of(keys: np.ndarray, order: np.ndarray, docs: np.ndarray, sizes: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Candidates among rows sorted by (key, order): left, right row and the length of the common prefix."""
    n = len(keys)
    levels = [order.view(np.uint64) ^ U64(1 << 63)]
    run = [np.concatenate([[True], keys[1:] != keys[:-1]])]
    for d in range(1, DEEPER + 1):  # starts of sub-regions by depth
        part = levels[0] >> U64(64 - 16 * d)
        run.append(run[-1] | np.concatenate([[True], part[1:] != part[:-1]]))
    left, right, depth = [], [], []
    open_rows = np.ones(n, bool)
    for d, starts in enumerate(run):
        number = np.cumsum(starts) - 1
        size = np.bincount(number)[number]
        for gap in range(1, REGION):
            i = np.flatnonzero((number[gap:] == number[:-gap]) & (size[:-gap] <= REGION) & open_rows[:-gap]) if gap < n else []
            left.append(np.asarray(i, int))
            right.append(np.asarray(i, int) + gap)
            depth.append(np.full(len(i), BASE_DEPTH + d))
        # a row of a large region goes deeper; there it also keeps its next neighbours in the sorted order
        large = size > REGION
        for gap in range(1, NEXT + 1):
            i = np.flatnonzero((number[gap:] == number[:-gap]) & large[:-gap] & (run[-1][gap:] | (d == DEEPER))) if gap < n else []
            left.append(np.asarray(i, int))
            right.append(np.asarray(i, int) + gap)
            depth.append(np.full(len(i), BASE_DEPTH + d))
        open_rows &= large
    left, right, depth = map(np.concatenate, (left, right, depth))
    x, y = sizes[left], sizes[right]
    fit = (docs[left] != docs[right]) & (100 * np.minimum(x, y) >= percent * np.maximum(x, y))
    return left[fit], right[fit], depth[fit]


#: Mark of rows that lie in a large region.
LARGE = -1
_CANDIDATES = "a long, b long, depth int, key long, ord long, doc long, n int"


def _neighbours(percent: int, edges: bool):
    """Candidates of a sorted partition. Regions that touch its ends come out as rows, to be joined over partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        first_key, seen = None, False

        def out(rows: list[np.ndarray]) -> pa.RecordBatch:
            keys, order, docs, sizes = rows
            i, j, depth = _pairs_of(keys, order, docs, sizes, percent)
            a, b = np.minimum(docs[i], docs[j]), np.maximum(docs[i], docs[j])
            none = pa.nulls(len(a), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(depth.astype(np.int32)), none, none, none, pa.nulls(len(a), pa.int32())], _CANDIDATE_NAMES)

        def large(rows: list[np.ndarray]) -> pa.RecordBatch:
            keys, _, docs, sizes = rows
            starts = np.concatenate([[True], keys[1:] != keys[:-1]])
            number = np.cumsum(starts) - 1
            at = np.flatnonzero(np.bincount(number)[number] > REGION)
            none = pa.nulls(len(at), pa.int64())
            return pa.RecordBatch.from_arrays([none, none, pa.array(np.full(len(at), LARGE, np.int32)), pa.array(keys[at]), none, pa.array(docs[at]), pa.array(sizes[at].astype(np.int32))], _CANDIDATE_NAMES)

        def edge(rows: list[np.ndarray]) -> pa.RecordBatch:
            keys, order, docs, sizes = rows
            none = pa.nulls(len(keys), pa.int64())
            return pa.RecordBatch.from_arrays([none, none, pa.nulls(len(keys), pa.int32()), pa.array(keys), pa.array(order), pa.array(docs), pa.array(sizes.astype(np.int32))], _CANDIDATE_NAMES)

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "ord", "doc", "n")]
            rows[3] = rows[3].astype(np.int64)
            if held is not None:
                rows = [np.concatenate(x) for x in zip(held, rows, strict=True)]
            if edges and not seen:
                seen = True
                k = min(len(rows[0]), REGION)
                yield edge([x[:k][rows[0][:k] == rows[0][0]] for x in rows])
            # keep back the last region, or of a very large one only its end, whose rows still need their neighbours
            start = int(np.searchsorted(rows[0], rows[0][-1]))
            keep = start if len(rows[0]) - start <= 20_000 else len(rows[0]) - REGION
            if keep:
                whole = [x[:keep] if keep == start else x for x in rows]
                yield out(whole)
                yield large(whole)
            held = [x[keep:] for x in rows]
        if held is not None:
            yield out(held)
            yield large(held)
            if edges:
                yield edge([x[-REGION:] for x in held])

    return run


_CANDIDATE_NAMES = ["a", "b", "depth", "key", "ord", "doc", "n"]


def _candidates(ws: Workspace, signatures: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Candidate pairs with their common depth over all trees, and the rows (key, doc, n) of large regions."""
    rows = signatures.filter("n > 0").select(F.col("doc_id").alias("doc"), F.col("n").cast("int").alias("n"), F.posexplode(F.arrays_zip("base", "deep")).alias("tree", "at"))
    rows = rows.select(F.col("at.base").alias("key"), F.col("at.deep").alias("ord"), "doc", "n")
    parts = int(ws.spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(parts, "key", "ord", "doc").sortWithinPartitions("key", "ord", "doc")
    found = ws.save(ordered.mapInArrow(_neighbours(percent, True), _CANDIDATES), "found")
    ends = found.filter("depth is null").select("key", "ord", "doc", "n").distinct()
    over = ends.repartition("key").sortWithinPartitions("key", "ord", "doc").mapInArrow(_neighbours(percent, False), _CANDIDATES)
    over = ws.save(over, "over")
    both = found.unionByName(over)
    pairs = ws.save(both.filter("a is not null").groupBy("a", "b").agg(F.sum("depth").alias("weight")), "candidates")
    large = ws.save(both.filter(F.col("depth") == LARGE).select("key", "doc", "n").distinct(), "large")
    ws.drop(found, over)
    return pairs, large


def _in_blocks(ws: Workspace, rows: DataFrame, by: str, name: str) -> DataFrame:
    """A written table's rows with a block number such that a block of one ``by`` has about BLOCK rows, and the number of blocks.

    Counts are written too: small ones are then broadcast, and else AQE can split a hot ``by``.
    """
    counts = ws.save(rows.groupBy(by).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias(f"{name}_blocks")), "block-counts")
    return rows.join(counts, by).withColumn(f"{name}_block", F.pmod(F.xxhash64(name), F.col(f"{name}_blocks")).cast("int"))


def _suspects(percent: int):
    """Of a block of documents that met a component and a block of its documents: (x, component) of those that look similar to one of it."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found: set[tuple[int, int]] = set()
        if left.num_rows and right.num_rows:
            docs, parts, sizes = (left.column(f"l_{c}").to_numpy() for c in ("doc", "component", "n"))
            r_parts, r_sizes = (right.column(f"r_{c}").to_numpy() for c in ("component", "n"))
            sketch, r_sketch = (np.frombuffer(b"".join(t.column(c).to_pylist()), np.uint8).reshape(-1, WIDE) for t, c in ((left, "l_sketch"), (right, "r_sketch")))
            first = np.ascontiguousarray(r_sketch[:, :SIGNATURE])
            for i in range(len(docs)):
                fit = (r_parts != parts[i]) & (100 * np.minimum(r_sizes, sizes[i]) >= percent * np.maximum(r_sizes, sizes[i]))
                fit &= (first == sketch[i, :SIGNATURE]).view(np.uint8).sum(axis=1, dtype=np.uint8) >= CLOSE[0]
                at = np.flatnonzero(fit)
                at = at[(r_sketch[at] == sketch[i]).sum(axis=1) >= CLOSE[1]]
                found.update((int(docs[i]), int(c)) for c in np.unique(r_parts[at]))
        return pa.table({"x": pa.array([f[0] for f in found], pa.int64()), "component": pa.array([f[1] for f in found], pa.int64())})

    return run


def _first_links(percent: int):
    """A link of each checked document with a member of the component's block, by full sets."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple[int, int]] = []
        if left.num_rows and right.num_rows:
            members = right.column("y").to_numpy()
            sets = right.column("theirs").combine_chunks()
            flat, sizes = sets.flatten().to_numpy(), np.diff(sets.offsets.to_numpy())
            owner = np.repeat(np.arange(len(members)), sizes)
            for x, own in zip(left.column("x").to_pylist(), left.column("own").to_pylist(), strict=True):
                own = np.sort(np.array(own, np.int64))
                at = np.minimum(np.searchsorted(own, flat), len(own) - 1)
                both = np.bincount(owner[own[at] == flat], minlength=len(members))
                hit = np.flatnonzero(100 * both >= percent * (sizes + len(own) - both))
                out += [(x, int(members[k])) for k in hit[:1] if members[k] != x]
        return pa.table({"a": pa.array([o[0] for o in out], pa.int64()), "b": pa.array([o[1] for o in out], pa.int64())})

    return run


def _frequencies(k: int):
    """(slot, n): how many sets of a partition have a shingle of each slot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(SLOTS, np.int64)
        for batch in batches:
            for _, sets, _ in _sets(batch, k):
                counts += np.bincount((np.concatenate(sets) % U64(SLOTS)).astype(np.int64), minlength=SLOTS)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(counts[at])], ["slot", "n"])

    return run


def _rarest(k: int, percent: int, shared):
    """(doc, component, n, shingle, few): of every set the rarest shingles, one of which any set of the similarity shares.

    Those marked ``few`` are enough towards sets that are no smaller: there the common part is larger.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shared.value
        for batch in batches:
            for low, sets, _ in _sets(batch, k):
                kept, few = [], []
                for own in sets:
                    n = len(own)
                    most = n - -(-percent * n // 100) + 1 if n else 0
                    often = counts[(own % U64(SLOTS)).astype(np.int64)]
                    kept.append(own[np.lexsort((own, often))[:most]])
                    few.append(np.arange(most) <= n - -(-2 * percent * n // (100 + percent)))
                at = np.repeat(np.arange(len(sets)), [len(x) for x in kept])
                row = pa.array(at + low)
                sizes = np.array([len(x) for x in sets])[at] if len(sets) else at
                columns = [batch.column("doc_id").take(row), batch.column("component").take(row), pa.array(sizes.astype(np.int32)), pa.array(signed(np.concatenate(kept))), pa.array(np.concatenate(few))]
                yield pa.RecordBatch.from_arrays(columns, ["doc", "component", "n", "shingle", "few"])

    return run


def _meeting(ws: Workspace, docs: DataFrame, rows: DataFrame, k: int, percent: int) -> DataFrame:
    """(x, other): documents of large regions (doc, component) that share one of their rarest shingles with a component of a greater number, or the shingle's largest."""
    ids = rows.select(F.col("doc").alias("doc_id"), "component").distinct()
    ids = ws.save(ids, "region-ids")
    texts = docs.join(F.broadcast(ids) if fits_broadcast(ids, ids.count()) else ids, "doc_id")
    found = texts.mapInArrow(_frequencies(k), "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(SLOTS, np.uint32)  # of a fixed size, whatever the documents
    counts[found["slot"].to_numpy()] = np.minimum(found["n"].to_numpy(), 2**32 - 1)
    shared = ws.spark.sparkContext.broadcast(counts)
    rare = ws.save(texts.mapInArrow(_rarest(k, percent, shared), "doc long, component long, n int, shingle long, few boolean"), "rarest")
    both = rare.groupBy("shingle").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.bool_or("few").alias("few"))
    both = ws.save(both.filter("low <> high and few").select("shingle"), "met")
    rare = ws.save(rare.join(both, "shingle"), "rare-met")
    parts = rare.groupBy("shingle", "component").agg(F.count("*").alias("docs"), F.max("n").alias("largest"), F.min(F.when(F.col("few"), F.col("n"))).alias("least"))
    parts = ws.save(parts, "rare-parts")
    main = parts.groupBy("shingle").agg(F.max(F.struct("docs", "component"))["component"].alias("main"))
    others = ws.save(parts.join(main, "shingle").select("shingle", F.col("component").alias("other"), "main", "largest", "least"), "others")
    pairs = rare.join(others, "shingle").filter("component <> other and component <> main and (other = main or other > component)")
    # the smaller of two documents has the shingle among its few
    pairs = pairs.filter(f"(few and largest >= n) or (least <= n and 100 * largest >= {percent} * n)")
    return ws.save(pairs.select(F.col("doc").alias("x"), "other").distinct(), "meeting")


def _region_suspects(ws: Workspace, docs: DataFrame, large: DataFrame, first: DataFrame, k: int, percent: int) -> DataFrame:
    """(x, component): documents of large regions that may be linked with a component which they are not in."""
    labels = first.select(F.col("node").alias("doc"), "component")
    rows = large.join(labels, "doc", "left").withColumn("component", F.coalesce("component", "doc"))
    rows = ws.save(rows, "regions")
    open_keys = ws.save(rows.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high").select("key"), "open")
    rows = ws.save(rows.join(open_keys, "key").select("doc", "component", "n").distinct(), "rows")
    meeting = _meeting(ws, docs, rows, k, percent)
    # the documents that met a component against its documents, block by block
    left = meeting.join(rows.select(F.col("doc").alias("x"), "component", "n"), "x").select(F.col("other").alias("key"), F.col("x").alias("doc"), "component", "n")
    left = ws.save(left, "left-docs")
    right = ws.save(rows.join(left.select(F.col("key").alias("component")).distinct(), "component", "left_semi").withColumn("key", F.col("component")), "right-docs")
    ids = ws.save(left.select(F.col("doc").alias("doc_id")).union(right.select("doc")).distinct(), "sketch-ids")
    sketches = ws.save(ids_only(docs, ids, "doc_id", ids.count()).mapInArrow(_sketches(k), "doc long, sketch binary"), "sketches")
    left, right = _in_blocks(ws, left, "key", "doc"), _in_blocks(ws, right, "key", "doc")
    left, right = ws.save(left.withColumnsRenamed({"doc_blocks": "own_blocks", "doc_block": "out_block"}), "left-blocks"), ws.save(right.withColumnsRenamed({"doc_blocks": "own_blocks", "doc_block": "block"}), "right-blocks")
    times = lambda df: ws.save(df.groupBy("key").agg(F.max("own_blocks").alias("times")), "times")
    spread = lambda df, other, name: df.join(times(other), "key").withColumn(name, F.explode(F.sequence(F.lit(0), F.col("times") - 1)))
    columns = ["key", "out_block", "block", "doc", "component", "n", "sketch"]
    side = lambda df, mark: df.join(sketches, "doc").select(*[F.col(c).alias(f"{mark}_{c}") for c in columns])
    left, right = side(spread(left, right, "block"), "l"), side(spread(right, left, "out_block"), "r")
    both = left.groupBy(*left.columns[:3]).cogroup(right.groupBy(*right.columns[:3]))
    return ws.save(both.applyInArrow(_suspects(percent), "x long, component long").distinct(), "suspects")


def _closing_links(ws: Workspace, docs: DataFrame, large: DataFrame, first: DataFrame, k: int, percent: int) -> DataFrame | None:
    """Links that join components which meet in large regions, None if no two may be similar."""
    suspects = _region_suspects(ws, docs, large, first, k, percent)
    if suspects.isEmpty():
        return None
    targets = suspects.select("component").distinct()
    inside = first.select(F.col("node").alias("y"), "component").join(targets, "component", "left_semi")
    members = ws.save(inside.union(targets.select(F.col("component").alias("y"), "component")).distinct(), "members")
    ids = ws.save(members.select(F.col("y").alias("doc_id")).union(suspects.select("x")).distinct(), "closing-ids")
    sets = ws.save(ids_only(docs, ids, "doc_id", ids.count()).mapInArrow(_set_rows(k), "doc_id long, shingles array<long>").filter(F.size("shingles") > 0), "closing-sets")
    left, right = _in_blocks(ws, suspects, "component", "x"), _in_blocks(ws, members, "component", "y")
    left, right = ws.save(left, "left"), ws.save(right, "right")
    sizes = lambda df, name: ws.save(df.groupBy("component").agg(F.max(f"{name}_blocks").alias("times")), "times")
    spread = lambda df, other, name, key: df.join(sizes(other, name), "component").withColumn(key, F.explode(F.sequence(F.lit(0), F.col("times") - 1)))
    xs = spread(left, right, "y", "y_block").join(sets.select(F.col("doc_id").alias("x"), F.col("shingles").alias("own")), "x")
    ys = spread(right, left, "x", "x_block").join(sets.select(F.col("doc_id").alias("y"), F.col("shingles").alias("theirs")), "y")
    xs = xs.toDF(*xs.columns).select(*[F.col(c).alias(f"l_{c}") for c in ("component", "x_block", "y_block")], "x", "own")
    ys = ys.toDF(*ys.columns).select(*[F.col(c).alias(f"r_{c}") for c in ("component", "x_block", "y_block")], "y", "theirs")
    left_keys, right_keys = (xs.columns[:3], ys.columns[:3])
    return ws.save(xs.groupBy(*left_keys).cogroup(ys.groupBy(*right_keys)).applyInArrow(_first_links(percent), "a long, b long"), "closing")


def _set_rows(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, sets, _ in _sets(batch, k):
                offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                hashes = np.concatenate(sets) if sets else np.zeros(0, U64)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(low, len(sets)), pa.ListArray.from_arrays(offsets, signed(hashes))], ["doc_id", "shingles"])

    return run


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs whose full sets have the similarity."""
    left = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    joined = pairs.select("a", "b").join(left, "a").join(right, "b")
    joined = joined.select("a", "b", both.alias("both"), (F.size("sa") + F.size("sb")).alias("all"))
    return joined.filter(F.col("both") * 100 >= (F.col("all") - F.col("both")) * percent).select("a", "b")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Near-duplicate components of whole texts: (doc_id, n_shingles, component_id, kept), a row per input row.

    Words are runs of bytes outside 09-0D and 20, A-Z lower-cased. A document's set holds its
    distinct k-word shingles, or its whole word sequence if that is shorter. Documents are linked
    when 100 * intersection >= percent * union. ``component_id`` is the smallest doc_id reachable,
    ``kept`` marks the row whose doc_id it is.

    Null and empty texts have an empty set and are linked with nothing. Rows that repeat a doc_id
    count as one document: they share a component. A row with a null doc_id is returned unlinked,
    with a null component, and kept. Other columns are ignored. An empty table gives no rows. Very long
    texts are taken whole; a task holds some 50 bytes a word of one.
    """
    spark: SparkSession = docs.sparkSession
    ws = Workspace(spark, "near")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    signed_rows = ws.save(docs.mapInArrow(_signatures(k), "doc_id long, n long, d1 long, d2 long, base array<long>, deep array<long>"), "signatures")
    # equal word sequences: one stands for all
    classes = signed_rows.filter("n > 0 and doc_id is not null").groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    classes = ws.save(classes, "classes")
    repeated = classes.filter("copies > 1").select("d1", "d2", "rep")
    copies = signed_rows.filter("n > 0 and doc_id is not null").select("d1", "d2", "doc_id").join(repeated, ["d1", "d2"]).filter("doc_id > rep")
    copies = ws.save(copies, "copies")
    lone = ids_only(signed_rows.filter("doc_id is not null"), copies.select("doc_id", "d1", "d2"), ["doc_id", "d1", "d2"], copies.count(), keep=False)
    pairs, large = _candidates(ws, lone, percent)

    ids = ws.save(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct(), "ids")
    some = ids_only(docs, ids, "doc_id", ids.count())
    sets = ws.save(some.mapInArrow(_set_rows(k), "doc_id long, shingles array<long>").filter(F.size("shingles") > 0), "sets")

    # each document's best candidates first; then every candidate that is not yet in one component
    ends = pairs.select(F.col("a").alias("x"), "a", "b", "weight").union(pairs.select(F.col("b").alias("x"), "a", "b", "weight"))
    best = ends.groupBy("x").agg(F.expr(f"slice(reverse(array_sort(collect_list(struct(weight, -b as nb, a, b)))), 1, {FIRST_LINKS})").alias("top"))
    best = best.select(F.explode("top").alias("t")).select("t.a", "t.b").distinct()
    links = ws.save(_confirmed(best, sets, percent), "links")
    first = connected_components(ws, links)
    at = lambda c: first.select(F.col("node").alias(c), F.col("component").alias(f"c{c}"))
    open_pairs = pairs.join(at("a"), "a", "left").join(at("b"), "b", "left").filter("not coalesce(ca = cb, false)")
    more = ws.save(_confirmed(open_pairs, sets, percent), "more")
    ws.drop(sets, pairs)
    labels = merged_components(ws, first, more)
    closing = _closing_links(ws, docs, large, labels, k, percent)
    if closing is not None:
        labels = merged_components(ws, labels, closing)

    # a copy has its representative's component; a doc_id with several texts joins those of all of them
    pairs = copies.select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    twice = signed_rows.filter("n > 0").groupBy("doc_id").agg(*[f(c).alias(f"{c}{i}") for c in ("d1", "d2") for i, f in enumerate((F.min, F.max))])
    twice = ws.save(twice.filter("d10 <> d11 or d20 <> d21").select(F.col("doc_id").alias("b")), "twice")
    if not twice.isEmpty():
        labels = merged_components(ws, labels, pairs.join(twice, "b", "left_semi"))
    of_copies = pairs.join(labels, F.col("a") == F.col("node"), "left").groupBy(F.col("b").alias("node")).agg(F.min(F.coalesce("component", "a")).alias("component"))
    components = labels.union(of_copies.join(labels.select("node"), "node", "left_anti").select("node", "component"))
    components = ws.save(components, "components")

    rows = signed_rows.select("doc_id", F.col("n").alias("n_shingles"))
    out = rows.join(components, rows.doc_id == components.node, "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
