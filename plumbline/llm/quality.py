"""Quality by compression: two Zstandard dictionaries, one of good and one of bad labelled texts.

A text is compressed in blocks of BLOCK bytes, each against either dictionary; every block is
scored by the normalised difference of the two sizes, (bad - good) / (bad + good). The text's mean
difference, that of its worst blocks, and how far its blocks shrink at all become a score by a
logistic fit on further labelled texts (Platt scaling). Dictionaries and fit use a bounded sample of the labelled rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.session import Workspace, bounded_batches

#: Labelled rows of each class that the dictionaries, and that the calibration, may use, and the bytes of their whole
#: texts that the driver takes; a text that would go over the bytes is passed over.
FIT_ROWS, FIT_BYTES = 1_500, 4_000_000
DICTIONARY, BLOCK, LEVEL = 110 * 1024, 400, 3
THRESHOLD = 0.3


@lru_cache(2)
def _compressors(good: bytes, bad: bytes):
    import zstandard

    out = []
    for data in (good, bad):
        d = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_AUTO)
        d.precompute_compress(level=LEVEL)
        out.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))
    return out


def differences(text: bytes, good: bytes, bad: bytes) -> tuple[np.ndarray, np.ndarray]:
    """For every block of a text the normalised size difference (above 0: nearer to the good texts), and size to length."""
    by_good, by_bad = _compressors(good, bad)
    n = max(1, round(len(text) / BLOCK))
    cut = [len(text) * i // n for i in range(n + 1)]
    x, y = np.empty(n), np.empty(n)
    for i in range(n):
        block = text[cut[i] : cut[i + 1]]
        x[i], y[i] = len(by_good.compress(block)), len(by_bad.compress(block))
    return (y - x) / (x + y), np.minimum(x, y) / (np.diff(cut) + 8.0)


def features(text: bytes, good: bytes, bad: bytes) -> np.ndarray:
    """Mean, lower quartile and least difference, least relative size (logarithm), and the length's part in them."""
    d, size = differences(text, good, bad)
    short = 1.0 / (1.0 + len(text) / 100.0)
    shrunk = np.log(size.min())
    return np.array([1.0, 10 * d.mean(), 10 * np.quantile(d, 0.25), 10 * d.min(), shrunk, shrunk * shrunk, short, short * 10 * d.mean(), short * shrunk])


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Coefficients by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) / len(y) + ridge * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x / len(y) + ridge * np.eye(len(w)), grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _dictionary(texts: list[bytes]) -> bytes:
    """A dictionary trained on all blocks of the sample's texts; the texts themselves if they are too few to train on."""
    import zstandard

    blocks = [t[a : a + BLOCK] for t in texts for a in range(0, len(t), BLOCK)]
    try:
        return zstandard.train_dictionary(DICTIONARY, blocks).as_bytes()
    except zstandard.ZstdError:
        return b"\n".join(texts)[-DICTIONARY:] or b"\n"


def _sampled(docs: DataFrame, labelled: DataFrame, rows: int, size: int) -> dict[tuple[str, int], list[bytes]]:
    """Texts by (purpose, label): up to ``rows`` rows and ``size`` bytes of each, in the order of a salted hash of their ids.

    ``labelled`` is (doc_id, label, size, purpose). Ids and sizes are chosen first, then the chosen texts fetched.
    """
    drawn = F.xxhash64("purpose", "doc_id")
    sizes = labelled.groupBy("purpose", "label").agg(F.count("*").alias("n")).collect()
    order = Window.partitionBy("purpose", "label").orderBy(drawn, "doc_id")
    for share in (4 * rows, None):  # the least hashes, some four times as many as wanted; all, should they ever be too few
        near = labelled
        if share is not None:
            least = F.lit(False)
            for r in sizes:
                below = F.lit(True) if r.n <= share else drawn <= -(2**63) + share * 2**64 // r.n
                least = least | ((F.col("purpose") == r.purpose) & (F.col("label") == r.label) & below)
            near = labelled.filter(least)
        first = near.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= rows).orderBy("purpose", "label", "place").collect()
        if len(first) == sum(min(r.n, rows) for r in sizes):
            break
    keep: dict[tuple[str, int], list[int]] = {}
    total: dict[tuple[str, int], int] = {}
    for r in first:
        key = r.purpose, r.label
        if total.get(key, 0) + r.size <= size:
            keep.setdefault(key, []).append(r.doc_id)
            total[key] = total.get(key, 0) + r.size
    ids = sorted({i for x in keep.values() for i in x})
    texts = {r.doc_id: r.text for r in docs.filter(F.col("doc_id").isin(ids)).groupBy("doc_id").agg(F.min("text").alias("text")).collect()} if ids else {}
    return {key: [texts[i].encode() for i in x if texts.get(i)] for key, x in keep.items()}


class QualityModel:
    """Two dictionaries and the weights of the calibration."""

    def __init__(self, good: bytes, bad: bytes, weights: np.ndarray):
        self.good, self.bad, self.weights = good, bad, weights

    def score(self, text: bytes) -> float:
        z = float(features(text, self.good, self.bad) @ self.weights)
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def fit_quality(
    docs: DataFrame, labels: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = FIT_ROWS, size: int = FIT_BYTES
) -> QualityModel:
    """Fit on labelled rows for which ``train`` (over doc_id) holds; half of them make dictionaries, half the calibration.

    Of each class and half a sample is used: up to ``rows`` rows and ``size`` bytes of whole texts, in
    the order of a hash; a text that would go over ``size`` is passed over. The share of good labels is
    that of all labelled rows. Rows without a label of 0 or 1, and without text, are not used; a
    document with both labels counts as either; of rows that repeat a doc_id the least text is taken.
    Other columns are ignored. With one class or none the score is the share of good labels (1 without any label).
    """
    ws = Workspace(docs.sparkSession, "quality")
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).filter("text is not null and doc_id is not null")
    labelled = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label")).filter("label in (0, 1) and doc_id is not null").filter(train).distinct()
    sizes = docs.select("doc_id", F.octet_length("text").alias("size"))
    purpose = F.when(F.xxhash64(F.lit("half"), F.col("doc_id")) % 2 == 0, "dictionary").otherwise("calibration")
    labelled = ws.save(sizes.join(labelled, "doc_id").groupBy("doc_id", "label").agg(F.max("size").alias("size")).withColumn("purpose", purpose), "labelled")
    share = labelled.agg(F.avg("label").alias("share")).first().share
    base = 1.0 if share is None else min(max(float(share), 1e-3), 1 - 1e-3)
    flat = QualityModel(b"\n", b"\n", np.array([np.log(base / (1 - base)) if share is not None else 30.0] + [0.0] * 8))
    found = _sampled(docs, labelled, rows, size)
    if any(not found.get((p, label)) for p in ("dictionary", "calibration") for label in (0, 1)):
        return flat
    good, bad = (_dictionary(found["dictionary", label]) for label in (1, 0))
    x = np.array([features(t, good, bad) for label in (0, 1) for t in found["calibration", label]])
    y = np.array([label for label in (0, 1) for _ in found["calibration", label]], float)
    weights = fit_logistic(x, y)
    # the sample holds as many rows of either class as there are; the prior of all labels comes back
    rate = y.mean()
    weights[0] += np.log(base / (1 - base)) - np.log(rate / (1 - rate))
    return QualityModel(good, bad, weights)


def _score(shared, threshold: float, with_held: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = QualityModel(*shared.value)
        for batch in batches:
            texts = batch.column("text").cast(pa.large_binary())
            scores = np.array([model.score(x.as_py() or b"") for x in texts], float)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(scores, pa.float64()), pa.array((scores >= threshold).astype(np.int32))],
                ["doc_id", "held_out", "score", "predicted"],
            )

    return run


def score_quality(docs: DataFrame, model: QualityModel, held_out: Column | None = None, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of whole texts, a row per input row; ``held_out`` is passed through.

    Null and empty texts are scored as empty, texts of any length by all their blocks. Repeated rows and
    null ids are returned as they come; other columns are ignored. An empty table gives no rows. There is no shuffle.
    """
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((model.good, model.bad, model.weights))
    held = F.lit(False) if held_out is None else held_out
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), held.alias("held_out"))
    return docs.mapInArrow(_score(shared, threshold, True), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int")


def quality_mask(model: QualityModel, threshold: float = THRESHOLD):
    """A filter for ``mapInArrow`` that keeps the rows whose ``text`` is predicted good, all columns as they are.

    Each row is judged alone, repeated ones alike; null and empty texts are judged as empty.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).cast(pa.large_binary())
            yield batch.filter(pa.array([model.score(x.as_py() or b"") >= threshold for x in texts], pa.bool_()))

    return run
