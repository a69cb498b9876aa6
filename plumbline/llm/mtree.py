"""Exact top-k inner products by best-first search in an M-tree.

Vectors are lifted to equal length M, (x, sqrt(M^2 - |x|^2)), where Euclidean distance to a query
(q, 0) falls as the inner product rises: q.x = (|q|^2 + M^2 - d^2) / 2. In this metric space the
vectors form a tree. A node of too many rows is split among routing objects drawn from its own
rows, each row going to the nearest, level by level; each node has its routing object, a covering
radius, and its distance to the parent's routing object. Leaves are pages of up to PAGE rows with every
member's distance to the page's routing object (its parent distance).

A query first searches the pages next to its own row, which gives a k-th score. It then goes down
the tree and leaves out every node that cannot hold a better row: by the parent distances, without
a computation, or by the covering radius. Only what is left is searched, best bound first, and within a
page only rows are computed that the parent distances do not rule out. The best rows of a query's
tasks are merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import BROADCAST_BYTES
from plumbline.session import Workspace

#: Rows of a page, most children of a node, pages of a search task, queries of a block.
PAGE, FANOUT, PAGES, QUERIES = 512, 32, 24, 1024
#: Rows of a node from which on a query asks for its parts: less for small tables, more for large ones, so that the nodes above fit every task.
UNIT = 12_288
#: Rows of a node that one task splits at a time.
SPLIT_ROWS = 8_192


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _lift(x: np.ndarray, top: float) -> np.ndarray:
    """Double coordinates with the one that makes all rows of length sqrt(top)."""
    x = x.astype(np.float64)
    rest = np.sqrt(np.maximum(top - (x * x).sum(axis=1), 0.0))
    return np.column_stack([x, rest])


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    square = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2.0 * (a @ b.T)
    return np.sqrt(np.maximum(square, 0.0))


def _products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer inner products, through doubles where they are exact."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * q.shape[1]
    if most < 2**52:
        return (q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    return q @ x.T


def _merge_best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -scores))[:k]
    return scores[order], ids[order]


def search_pages(q: np.ndarray, q_ids: np.ndarray, pages: list[tuple], top: float, k: int, least_score: np.ndarray | None = None) -> tuple[list[tuple[np.ndarray, np.ndarray]], int]:
    """Best (scores, ids) of every query over the pages, and the number of inner products computed; none below ``least_score``.

    A page is (routing, radius, ids, parent distances, vectors). Bounds get half a unit of slack, as
    scores are whole numbers, so rounding rules out no row, and rows that tie with the last are met.
    """
    lifted = np.column_stack([q.astype(np.float64), np.zeros(len(q))])
    square = (lifted * lifted).sum(axis=1) + top
    near = _distance(lifted, _lift(np.stack([p[0] for p in pages]), top))
    slack = 0.5 + 1e-9 * square
    least = np.maximum(near - np.array([p[1] for p in pages]), 0.0)
    bound = (square[:, None] - least**2) / 2 + slack[:, None]
    order = np.argsort(-bound, axis=1, kind="stable")
    best = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(q)
    kth = np.full(len(q), -np.inf) if least_score is None else least_score.astype(np.float64).copy()
    live, computed = np.arange(len(q)), 0
    for step in range(len(pages)):
        page_of = order[live, step]
        go = bound[live, page_of] >= kth[live]
        live, page_of = live[go], page_of[go]
        if not len(live):
            break
        for p in np.unique(page_of):
            rows = live[page_of == p]
            _, _, ids, parent, x = pages[p]
            gap = np.abs(near[rows, p][:, None] - parent[None, :])
            may = (square[rows, None] - gap**2) / 2 + slack[rows, None] >= kth[rows, None]
            cols = np.flatnonzero(may.any(axis=0))
            if not len(cols):
                continue
            product = _products(q[rows], x[cols])
            computed += product.size
            may = may[:, cols] & (ids[cols][None, :] != q_ids[rows][:, None]) & (product >= kth[rows, None])
            for i, r in enumerate(rows):
                c = np.flatnonzero(may[i])
                if len(c) > k:  # rows below the page's own k-th cannot be among the best
                    c = c[product[i, c] >= np.partition(product[i, c], len(c) - k)[len(c) - k]]
                if len(c):
                    best[r] = _merge_best(np.concatenate([best[r][0], product[i, c]]), np.concatenate([best[r][1], ids[cols[c]]]), k)
                    if len(best[r][0]) == k:
                        kth[r] = max(kth[r], best[r][0][-1])
    return best, computed


def _split(top: float):
    """Rows of a node with the nearest of its routing objects (child) and the distance to it."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {"vec_id": left.column("vec_id"), "v": left.column("v"), "dim": left.column("dim"), "unit": left.column("unit")}
        node = left.column("node")[0].as_py()
        dim = left.column("dim")[0].as_py()
        x = _lift(_matrix(left.column("v").combine_chunks(), dim), top)
        # equal routing objects are one child; all tasks of the node see the same list
        routing = np.array(list(dict.fromkeys(tuple(v) for _, v in sorted(zip(right.column("place").to_pylist(), right.column("rv").to_pylist(), strict=True)))), np.int64).reshape(-1, dim)
        lifted = _lift(routing, top)
        child, far = np.zeros(len(x), np.int64), np.zeros(len(x))
        for a in range(0, len(x), 2_000):
            d = _distance(x[a : a + 2_000], lifted)
            child[a : a + 2_000] = d.argmin(axis=1)
            far[a : a + 2_000] = np.linalg.norm(x[a : a + 2_000] - lifted[child[a : a + 2_000]], axis=1)
        out["node"] = pa.array([f"{node}.{i}" for i in child])
        out["d"] = pa.array(far)
        return pa.table(out).select(["vec_id", "v", "dim", "unit", "node", "d"])

    return run


_ROWS = "vec_id long, v array<long>, dim int, unit string, node string, d double"


def build_tree(ws: Workspace, rows: DataFrame, top: float, unit_rows: int) -> tuple[DataFrame, DataFrame]:
    """Leaf rows (vec_id, v, dim, unit, node, d) and nodes (node, dim, routing, radius, unit) of the tree.

    A level splits all nodes of more than PAGE rows. Nodes whose rows all are one vector stay whole.
    """
    level = rows.select("vec_id", "v", "dim", F.lit(None).cast("string").alias("unit"), F.concat(F.lit("r"), F.col("dim").cast("string")).alias("node"), F.lit(None).cast("double").alias("d"))
    done, nodes = None, None
    while True:
        level = ws.save(level, "level")
        facts = level.groupBy("node").agg(F.count("*").alias("rows"), F.max("d").alias("radius"), F.min("v").alias("low"), F.max("v").alias("high"), F.first("dim").alias("dim"), F.first("unit").alias("up"), F.min(F.when(F.col("d") == 0, F.col("v"))).alias("routing"))
        facts = ws.save(facts.withColumn("open", (F.col("rows") > PAGE) & (F.col("low") != F.col("high"))).withColumn("own", F.coalesce("up", F.when(~F.col("open") | (F.col("rows") <= unit_rows), F.col("node")))).drop("up"), "facts")
        level = level.drop("unit").join(facts.select("node", "rows", "open", F.col("own").alias("unit")), "node")
        # a child's routing object is one of its rows, at distance 0; the root has none
        found = facts.select("node", "dim", "routing", "radius", F.col("own").alias("unit"))
        nodes = found if nodes is None else nodes.unionByName(found)
        leaves = level.filter(~F.col("open")).select("vec_id", "v", "dim", "unit", "node", "d")
        done = leaves if done is None else done.unionByName(leaves)
        wide = level.filter("open")
        if wide.isEmpty():
            return ws.save(done, "leaves"), ws.save(nodes, "nodes")
        # routing objects: different vectors by hash, of a share of the rows; the least and greatest vector make sure that any node parts
        fanout = F.least(F.lit(FANOUT), F.ceil(2 * F.col("rows") / PAGE) + 1)
        share = F.greatest(F.lit(1), F.floor(F.col("rows") / (8 * FANOUT)))
        drawn = wide.withColumn("h", F.xxhash64("v")).filter(F.pmod("h", share) == 0).groupBy("node", "rows", "h").agg(F.min("v").alias("rv"))
        drawn = drawn.withColumn("place", F.row_number().over(Window.partitionBy("node").orderBy("h"))).filter((F.col("place") <= FANOUT) & (F.col("place") <= fanout))
        ends = facts.filter("open").select("node", "rows", F.explode(F.array(F.struct(F.lit(0).alias("place"), F.col("low").alias("rv")), F.struct(F.lit(-1).alias("place"), F.col("high").alias("rv")))).alias("e")).select("node", "rows", "e.*")
        routing = drawn.select("node", "rows", "place", "rv").unionByName(ends)
        salts = F.ceil(F.col("rows") / SPLIT_ROWS).cast("int")
        routing = routing.withColumn("r_salt", F.explode(F.sequence(F.lit(0), salts - 1))).select(F.col("node").alias("r_node"), "r_salt", "place", "rv")
        wide = wide.withColumn("salt", F.pmod(F.xxhash64("vec_id"), salts).cast("int")).select("vec_id", "v", "dim", "unit", "node", "salt")
        level = wide.groupBy("node", "salt").cogroup(routing.groupBy("r_node", "r_salt")).applyInArrow(_split(top), _ROWS)


_PAGE_SCHEMA = "dim int, unit string, part int, page string, n int, routing array<long>, radius double, ids array<long>, parent array<double>, v array<long>"


def _build_page(top: float):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        unit, node, salt = key
        dim = int(pdf["dim"].iloc[0])
        x = np.stack(pdf["v"].to_numpy()).astype(np.int64) if dim else np.zeros((len(pdf), 0), np.int64)
        lifted = _lift(x, top)
        center = int(((lifted - lifted.mean(axis=0)) ** 2).sum(axis=1).argmin())
        parent = _distance(lifted[[center]], lifted)[0]
        order = np.argsort(parent, kind="stable")
        return pd.DataFrame(
            {
                "dim": [dim],
                "unit": [unit],
                "part": [int(pdf["part"].iloc[0])],
                "page": [f"{node}-{salt}"],
                "n": [len(pdf)],
                "routing": [x[center]],
                "radius": [float(parent.max())],
                "ids": [pdf["vec_id"].to_numpy()[order]],
                "parent": [parent[order]],
                "v": [x[order].ravel()],
            }
        )

    return run


def _search(top: float, k: int):
    """Best rows of a block of queries (with the least score that counts) in a part's pages."""

    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = {"query_id": [], "mark": [], "vec_id": [], "score": []}
        if len(left) and len(right):
            dim = int(right["dim"].iloc[0])
            q = np.stack(left["v"].to_numpy()).astype(np.int64).reshape(len(left), dim)
            pages = [(np.asarray(r.routing, np.int64), r.radius, np.asarray(r.ids), np.asarray(r.parent), np.asarray(r.v, np.int64).reshape(r.n, dim)) for r in right.itertuples()]
            best, _ = search_pages(q, left["vec_id"].to_numpy(), pages, top, k, left["least"].to_numpy(np.float64, na_value=-np.inf))
            for (scores, ids), query, mark in zip(best, left["vec_id"], left["mark"], strict=True):
                out["query_id"] += [query] * len(ids)
                out["mark"] += [mark] * len(ids)
                out["vec_id"] += ids.tolist()
                out["score"] += scores.tolist()
        return pd.DataFrame(out).astype("int64")

    return run


_FOUND = "query_id long, mark long, vec_id long, score long"


def units_to_search(q: np.ndarray, least: np.ndarray, tree: list[tuple], top: float) -> tuple[list[np.ndarray], int]:
    """For each query the units (numbers of ``tree``) that may hold a score of ``least`` or more, and the distances computed.

    ``tree`` lists nodes after their parents: (parent's number or -1, routing, radius, distance to the
    parent's routing object, whether it is a unit).
    """
    lifted = np.column_stack([q.astype(np.float64), np.zeros(len(q))])
    square = (lifted * lifted).sum(axis=1) + top
    slack = 0.5 + 1e-9 * square
    # the distance within which a row must lie to reach the score
    reach = np.sqrt(np.maximum(square + 2 * slack - 2 * least, 0.0))
    reach[2 * (least - slack) > square] = -1.0
    alive: list[np.ndarray] = []
    far: list[np.ndarray] = []
    units: list[list[int]] = [[] for _ in q]
    computed = 0
    for i, (parent, routing, radius, parent_d, is_unit) in enumerate(tree):
        open_ = alive[parent].copy() if parent >= 0 else np.ones(len(q), bool)
        if parent >= 0 and parent_d is not None:
            open_ &= np.abs(far[parent] - parent_d) - radius <= reach + 1e-6
        d = np.full(len(q), np.nan)
        at = np.flatnonzero(open_)
        if len(at):
            if routing is not None:
                d[at] = _distance(lifted[at], _lift(routing[None, :], top))[:, 0]
                computed += len(at)
                open_[at] = d[at] - radius <= reach[at] + 1e-6
            if is_unit:
                for r in np.flatnonzero(open_):
                    units[r].append(i)
        alive.append(open_)
        far.append(np.where(np.isnan(d), 0.0, d))
    return [np.array(u, int) for u in units], computed


def _units(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees, names, top = shared.value
        for batch in batches:
            dims = batch.column("dim").to_numpy(zero_copy_only=False)
            least = batch.column("least").to_numpy(zero_copy_only=False).astype(np.float64)
            least = np.where(np.isnan(least), -np.inf, least)
            rows, units = [], []
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                q = _matrix(batch.column("v").take(pa.array(at)), int(dim))
                known = np.isfinite(least[at])
                found, _ = units_to_search(q, np.where(known, least[at], -1e300), trees[int(dim)], top)
                for r, u in zip(at, found, strict=True):
                    rows += [int(r)] * len(u)
                    units += [names[int(dim)][i] for i in u]
            yield pa.RecordBatch.from_arrays([*[batch.column(c).take(pa.array(rows, pa.int64())) for c in batch.schema.names], pa.array(units, pa.string())], [*batch.schema.names, "to_unit"])

    return run


def quantised(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64) -> DataFrame:
    """(vec_id, v, dim): floor(scale * x) of every component; vectors null or with null or non-finite components go."""
    x = F.col(vector_col).cast("array<double>")
    good = x.isNotNull() & F.col(id_col).isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = vectors.filter(F.coalesce(good, F.lit(False)))
    return rows.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c * scale)).alias("v"), F.size(x).alias("dim"))


def _tree_lists(nodes: list, top: float) -> tuple[dict[int, list[tuple]], dict[int, list[str]]]:
    """Nodes down to the units as lists per dimension, parents first."""
    trees: dict[int, list[tuple]] = {}
    names: dict[int, list[str]] = {}
    place: dict[str, int] = {}
    for n in sorted(nodes, key=lambda n: (n.node.count("."), n.node)):
        own, named = trees.setdefault(n.dim, []), names.setdefault(n.dim, [])
        parent = place[n.node.rpartition(".")[0]] if "." in n.node else -1
        place[n.node] = len(own)
        vector = np.array(n.routing, np.int64) if n.routing is not None else None
        up = own[parent][1] if parent >= 0 else None
        apart = float(_distance(_lift(vector[None, :], top), _lift(up[None, :], top))[0, 0]) if vector is not None and up is not None else None
        own.append((parent, vector, np.inf if n.radius is None else float(n.radius), apart, n.unit == n.node))
        named.append(n.node)
    return trees, names


def mtree_top_k(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64) -> DataFrame:
    """The k highest integer inner products of every query with the other rows: (query_id, rank, vec_id, score).

    ``is_query`` is a condition over ``vec_id``. Ties go to the smaller vec_id; fewer than k rows are
    all returned. Vectors and ids that are null, and vectors with null or non-finite components, take
    no part; vectors of different length are not compared. Rows with the query's own vec_id are no
    candidates; repeated query rows with different vectors get their own ranks, equal ones are one.
    Scores must fit a long. Other columns are ignored. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    ws = Workspace(spark, "mtree")
    rows = ws.save(quantised(vectors, id_col, vector_col, scale), "rows")
    dot = F.aggregate("v", F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double"))
    facts = rows.agg(F.count("*").alias("n"), F.max(dot).alias("top"), F.max("dim").alias("dim")).first()
    n, top = facts.n, facts.top or 0.0
    # the nodes above the units go to every task: so many rows make a unit that they fit
    unit_rows = max(UNIT, 4 * n * 8 * ((facts.dim or 0) + 8) // BROADCAST_BYTES)
    leaves, nodes = build_tree(ws, rows, top, unit_rows)

    # pages: a leaf is one, or several of equal vectors; parts of a unit: pages that one task searches
    sizes = ws.save(leaves.groupBy("unit", "node").agg(F.count("*").alias("rows")), "sizes")
    within = Window.partitionBy("unit").orderBy("node").rowsBetween(Window.unboundedPreceding, -1)
    splits = F.ceil(F.col("rows") / PAGE).cast("int")
    sizes = ws.save(sizes.select("unit", "node", splits.alias("split"), F.coalesce(F.sum(splits).over(within), F.lit(0)).alias("before")), "splits")
    placed = leaves.join(sizes, ["unit", "node"]).withColumn("salt", F.pmod(F.xxhash64("vec_id", "v"), F.col("split")).cast("int"))
    placed = ws.save(placed.withColumn("part", F.floor((F.col("before") + F.col("salt")) / PAGES).cast("int")).drop("split", "before", "d"), "placed")
    pages = ws.save(placed.groupBy("unit", "node", "salt").applyInPandas(_build_page(top), _PAGE_SCHEMA), "pages")

    mark = F.xxhash64("v")
    queries = ws.save(placed.filter(is_query).select("vec_id", "dim", "v", "unit", "part", mark.alias("mark")).dropDuplicates(["vec_id", "dim", "v"]), "queries")

    def searched(asked: DataFrame, name: str) -> DataFrame:
        """Results of queries (with unit, part and least) in those parts, in blocks of queries."""
        keys = ["unit", "part", "block"]
        blocks = ws.save(asked.groupBy("unit", "part").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("blocks")), "blocks")
        left = asked.join(blocks, ["unit", "part"]).withColumn("block", F.pmod(F.xxhash64("vec_id", "mark"), "blocks").cast("int")).drop("blocks")
        right = pages.join(blocks, ["unit", "part"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
        return ws.save(left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(_search(top, k), _FOUND), name)

    near = searched(queries.withColumn("least", F.lit(None).cast("double")), "near")
    full = near.groupBy("query_id", "mark").agg(F.count("*").alias("n"), F.min("score").alias("least"))
    asked = queries.join(full, (F.col("vec_id") == F.col("query_id")) & (full["mark"] == queries["mark"]), "left")
    asked = asked.select("vec_id", "dim", "v", queries["mark"], "unit", "part", F.when(F.col("n") >= k, F.col("least").cast("double")).alias("least"))

    upper = nodes.filter("unit is null or unit = node").collect()
    shared = spark.sparkContext.broadcast((*_tree_lists(upper, top), top))
    pairs = ws.save(asked.mapInArrow(_units(shared), "vec_id long, dim int, v array<long>, mark long, unit string, part int, least double, to_unit string"), "pairs")
    parts = ws.save(pages.select(F.col("unit").alias("to_unit"), F.col("part").alias("to_part")).distinct(), "parts")
    far = pairs.join(parts, "to_unit").filter("not (to_unit = unit and to_part = part)")
    far = searched(ws.save(far.select("vec_id", "dim", "v", "mark", F.col("to_unit").alias("unit"), F.col("to_part").alias("part"), "least"), "far-asked"), "far")
    by = Window.partitionBy("query_id", "mark").orderBy(F.desc("score"), "vec_id")
    return near.unionByName(far).withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
