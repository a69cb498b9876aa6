"""Canonical exact fingerprints, with DataFrame and SQL functions only.

A text's canonical form is its NFKC composition, case-folded, every run of white space one blank,
trimmed. The fingerprint is a wide (two-lane) xxhash of that form. Inside a bucket of equal digests
the canonical bytes are compared; should different texts ever meet in one, their fingerprints get
an ordinal, so equal fingerprints mean equal canonical texts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import ids_only
from plumbline.session import Workspace

#: Documents of a block of neighbouring ids, and blocks of a group of blocks.
BLOCK, BLOCKS = 256, 1024
#: Pieces of about as many ids each, in which blocks are cut evenly: ids may be dense, hashed or far apart. A power of two.
PIECES = 256
_ICU = "com.ibm.icu"


def canonical(text: Column) -> Column:
    """NFKC composition, case folding and white-space folding. Pure ASCII needs no Unicode tables."""
    plain = F.octet_length(text) == F.length(text)
    composed = F.call_function("reflect", F.lit(f"{_ICU}.text.Normalizer"), F.lit("compose"), text, F.lit(True))
    folded = F.call_function("reflect", F.lit(f"{_ICU}.lang.UCharacter"), F.lit("foldCase"), composed, F.lit(True))
    again = F.call_function("reflect", F.lit(f"{_ICU}.text.Normalizer"), F.lit("compose"), folded, F.lit(True))
    out = F.when(plain, F.lower(text)).otherwise(again)
    return F.trim(F.regexp_replace(out, r"[\s\p{Z}\x{85}]+", " "))


def wide_hash(text: Column) -> Column:
    """128 bits of xxhash as 32 hexadecimal digits: two lanes, the second with another seed."""
    lane = lambda *c: F.lpad(F.lower(F.hex(F.xxhash64(*c))), 16, "0")
    return F.concat(lane(text), lane(F.lit("second lane"), text))


def _dense(docs: DataFrame) -> bool:
    """Whether ids are so close that equal ranges of them hold enough rows. It sets only how rows are dealt, not what comes out."""
    low, high, n = docs.agg(F.min("doc_id"), F.max("doc_id"), F.count("doc_id")).first()
    return n == 0 or high - low < 4 * n


def _blocks(docs: DataFrame) -> Column:
    """A number of about BLOCK neighbouring ids that rises with doc_id: the piece between quantiles, and an even part of it.

    Only quantiles come to the driver. They are found by a search tree of comparisons, so nothing is joined.
    """
    found = docs.stat.approxQuantile("doc_id", [i / PIECES for i in range(PIECES + 1)], 0.2 / PIECES)
    n = docs.count()
    cuts = sorted(set(found)) or [0.0]
    each = max(1, -(-n // (PIECES * BLOCK)))  # blocks of a piece

    def piece(low: int, high: int) -> Column:
        if low == high:
            wide = (cuts[low + 1] if low + 1 < len(cuts) else cuts[low] + 1) - cuts[low]
            part = F.floor((F.col("doc_id").cast("double") - F.lit(cuts[low])) / F.lit(max(wide / each, 1.0)))
            return F.lit(low * (each + 1)) + F.greatest(F.lit(0), F.least(F.lit(each), part))
        middle = (low + high + 1) // 2
        return F.when(F.col("doc_id").cast("double") < F.lit(cuts[middle]), piece(low, middle - 1)).otherwise(piece(middle, high))

    return piece(0, len(cuts) - 1).cast("long")


def _heads(ws: Workspace, docs: DataFrame) -> DataFrame:
    """(block, doc_id, text): for every block of ids the document that follows its last, in descending order.

    Blocks are ordered within groups of BLOCKS, and the groups over all: only a row for each group,
    some 262,144th of the documents, meets in one task.
    """
    blocks = docs.groupBy("block").agg(F.max("doc_id").alias("head"))
    blocks = ws.save(blocks.withColumn("group", F.floor(F.col("block") / BLOCKS)), "blocks")
    within = Window.partitionBy("group").orderBy("block")
    groups = blocks.groupBy("group").agg(F.max(F.struct("block", "head")).alias("top"))
    over = Window.orderBy("group")
    groups = groups.withColumn("below", F.lag("top").over(over))
    whole = F.max(F.struct("group", "top")).over(Window.partitionBy())
    groups = groups.select("group", F.coalesce("below.head", whole["top"]["head"]).alias("below_head"))
    following = blocks.withColumn("lower", F.lag("head").over(within)).join(groups, "group")
    following = ws.save(following.select("block", F.coalesce("lower", "below_head").alias("doc_id")), "following")
    ids = following.select("doc_id").distinct()
    texts = ids_only(docs.select("doc_id", "text"), ids, "doc_id", following.count()).groupBy("doc_id").agg(F.min("text").alias("text"))
    return ws.save(following.join(texts, "doc_id").select("block", "doc_id", "text"), "heads")


def with_next(ws: Workspace, docs: DataFrame, dense: bool) -> DataFrame:
    """(doc_id, text, canon, next_id, next_text, next_canon) of rows with a doc_id, in the order doc_id descending, text.

    The row after the last is the first. Rows are dealt by blocks of ids, and each block gets the
    head of the following one, so no task orders all rows.
    """
    docs = docs.filter("doc_id is not null").select("doc_id", "text")
    docs = docs.withColumn("block", F.floor(F.col("doc_id") / BLOCK) if dense else _blocks(docs.select("doc_id")))
    heads = _heads(ws, docs)
    rows = docs.withColumn("extra", F.lit(False)).unionByName(heads.withColumn("extra", F.lit(True)))
    rows = rows.repartition("block").withColumn("canon", canonical(F.col("text")))
    order = Window.partitionBy("block").orderBy("extra", F.desc("doc_id"), "text")
    for c, to in (("doc_id", "next_id"), ("text", "next_text"), ("canon", "next_canon")):
        rows = rows.withColumn(to, F.lead(c).over(order))
    return rows.filter(~F.col("extra")).drop("extra", "block")


def _edited(rows: DataFrame) -> DataFrame:
    """With n_chars and the edited text."""
    rows = rows.withColumn("n_chars", F.length("text").cast("long")).withColumn("take", F.floor(F.length("text") / 3).cast("int"))
    kept = F.substring(F.col("text"), F.lit(1), F.length("text") - F.col("take"))
    tail = F.coalesce(F.substring(F.col("next_text"), F.lit(1), F.col("take")), F.lit(""))
    return rows.withColumn("edited", F.concat(kept, tail)).drop("take")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = wide_hash) -> DataFrame:
    """Fingerprints of whole texts and of their edited texts, a row per input row.

    Columns: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.
    The edited text has its last floor(n_chars / 3) code points replaced by the first as many of the
    next row's text; the order is doc_id descending, then text, and the first follows the last. The
    likeness of exact fingerprints is 1 for equal canonical texts (by bytes), else 0.

    Null texts count as empty. Repeated rows are neighbours of each other. A row with a null doc_id
    has no next: its edited text ends early and near_next is 0. Other columns are ignored. Very long
    texts are taken whole (each is a value of a row, as is its edited text). An empty table gives no rows. Rows are shuffled once with their texts, by blocks of ids.
    """
    ws = Workspace(docs.sparkSession, "fingerprints")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    lost = docs.filter("doc_id is null").withColumn("canon", canonical(F.col("text")))
    lost = lost.select("*", F.lit(None).cast("long").alias("next_id"), F.lit(None).cast("string").alias("next_text"), F.lit(None).cast("string").alias("next_canon"))
    dense = _dense(docs)
    table = ws.save(_printed(_edited(with_next(ws, docs, dense).unionByName(lost)), digest), "prints")

    # buckets with more than one text: compare the bytes
    both = table.select(F.col("fingerprint").alias("bucket")).union(table.select("edited_fingerprint"))
    shared = ws.save(both.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1").select("bucket"), "shared")
    n = shared.count()
    canon = docs.withColumn("canon", canonical(F.col("text"))).select("doc_id", digest(F.col("canon")).alias("bucket"), "canon")
    members = ids_only(canon, shared, "bucket", n)
    again = ids_only(table.filter("near_edited = 0 and doc_id is not null").select("doc_id", "next_id", F.col("edited_fingerprint").alias("bucket")), shared, "bucket", n)
    again = ws.save(again.select("doc_id", "next_id"), "again")
    n_again = again.count()
    if n_again:
        ids = again.select("doc_id").union(again.select("next_id")).distinct()
        some = _edited(with_next(ws, ids_only(docs, ids, "doc_id", 2 * n_again), dense))
        some = some.select("doc_id", canonical(F.col("edited")).alias("canon")).select("doc_id", digest(F.col("canon")).alias("bucket"), "canon")
        members = members.unionByName(ids_only(some, shared, "bucket", n))
    mixed = ws.save(members.groupBy("bucket").agg(F.min("canon").alias("a"), F.max("canon").alias("b")).filter("a <> b").select("bucket"), "mixed")
    n_mixed = mixed.count()
    if not n_mixed:
        return table.drop("next_id", "canon_sha", "edited_canon_sha")
    forms = ids_only(members, mixed, "bucket", n_mixed).select("bucket", "canon").distinct()
    place = F.dense_rank().over(Window.partitionBy("bucket").orderBy("canon"))
    forms = ws.save(forms.select("bucket", F.sha2("canon", 256).alias("sha"), place.alias("place")), "forms")
    for kind in ("", "edited_"):
        to = forms.select(F.col("bucket").alias(f"{kind}fingerprint"), F.col("sha").alias(f"{kind}canon_sha"), F.col("place").alias("place"))
        table = table.join(to, [f"{kind}fingerprint", f"{kind}canon_sha"], "left")
        table = table.withColumn(f"{kind}fingerprint", F.concat_ws("-", f"{kind}fingerprint", F.col("place").cast("string"))).drop("place")
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    return table.select(*names)


def _printed(rows: DataFrame, digest: Callable[[Column], Column]) -> DataFrame:
    rows = rows.withColumn("edited_canon", canonical(F.col("edited")))
    like = lambda a: F.coalesce((F.col("canon") == F.col(a)).cast("double"), F.lit(0.0))
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        digest(F.col("canon")).alias("fingerprint"),
        digest(F.col("edited_canon")).alias("edited_fingerprint"),
        like("edited_canon").alias("near_edited"),
        like("next_canon").alias("near_next"),
        "next_id",
        F.sha2("canon", 256).alias("canon_sha"),
        F.sha2("edited_canon", 256).alias("edited_canon_sha"),
    )
