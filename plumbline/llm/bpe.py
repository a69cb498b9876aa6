"""Byte-level BPE encoding and decoding with a segment tree over adjacent pair ranks.

Texts are cut at single spaces between non-space characters, where a pre-token always begins, and
the pieces into pre-tokens by the tokenizer's pattern. Each pre-token's bytes are merged by a
segment tree whose leaves are the ranks of adjacent pairs: the root yields the leftmost pair of
lowest rank, a merge updates three leaves and the nodes above them, until no pair can merge. Many
pre-tokens of like length are merged together, one row of a matrix each; a few, among them very
long ones, are merged one by one, where a merge costs microseconds. A worker keeps the pieces
that it has encoded up to a bound.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import text_slices
from plumbline.session import bounded_batches

#: The pre-token pattern of byte-level BPE vocabularies (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bytes of pieces and their ids that a Python worker remembers, at most twice as many for a while, and what an entry adds to its text.
CACHE_BYTES, ENTRY_BYTES = 50 << 20, 170
#: Pre-tokens of one length up to which each is merged on its own.
FEW = 12
#: White space, ASCII first; next to a blank it moves the place where a pre-token begins.
_ASCII_SPACE = " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f"
_SPACE = _ASCII_SPACE + "\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
_ASCII_PAIRS, _PAIRS = (list(dict.fromkeys([" " + c for c in cs] + [c + " " for c in cs])) for cs in (_ASCII_SPACE, _SPACE))
#: Symbols of a matrix of pre-tokens, so that it stays in the processor's cache.
BLOCK = 1 << 16


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class SegmentTreeBPE:
    """Encoder and decoder of one vocabulary file (the tokenizers library's JSON)."""

    def __init__(self, source: str):
        import regex

        spec = json.loads(source)
        vocab, symbols = spec["model"]["vocab"], byte_symbols()
        self.pattern = regex.compile(PATTERN)
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.special_at = regex.compile("|".join(regex.escape(x) for x in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.byte_id = np.array([vocab[c] for c in symbols], np.int64)
        self.byte_ids = self.byte_id.tolist()
        pairs = [x if isinstance(x, list) else x.split(" ") for x in spec["model"]["merges"]]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.rank_of = {key: rank for rank, key in reversed(list(enumerate(keys.tolist())))}
        self.new_id = self.made.tolist()
        back = {c: b for b, c in enumerate(symbols)}
        self.token_bytes = {str(i): bytes(back[c] for c in t) for t, i in vocab.items() if all(c in back for c in t)}
        self.token_bytes |= {str(i): t.encode() for t, i in self.special.items()}
        self.cache: dict[str, str] = {}  # pieces after a space
        self.older: dict[str, str] = {}
        self.cached = 0  # bytes
        self.boundary = regex.compile(r"(?<=\S) (?=\S)")

    def _leaf(self, left: np.ndarray, right: np.ndarray, place: np.ndarray, bits: int, none: int) -> np.ndarray:
        """Rank and place (of so many bits) of the pair as one number, or ``none`` if it never merges."""
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        found = (self.keys[at] == key) & (left >= 0) & (right >= 0)
        return np.where(found, self.ranks[at] << bits | place, none)

    def merge(self, words: list[bytes]) -> list[list[int]]:
        """Token ids of each pre-token."""
        out: list[list[int]] = [[] for _ in words]
        sizes = np.array([len(w) for w in words])
        width = np.where(sizes > 1, 1 << np.ceil(np.log2(np.maximum(sizes, 2))).astype(int), 1)
        for w in np.unique(width):
            rows = np.flatnonzero((width == w) & (sizes > 0))
            if len(rows) <= FEW:
                for i in rows:
                    out[i] = self._merge_one(words[i])
                continue
            for a in range(0, len(rows), max(1, BLOCK // int(w))):
                self._merge_alike([words[i] for i in rows[a : a + max(1, BLOCK // int(w))]], int(w), rows[a:], out)
        return out

    def _merge_one(self, word: bytes) -> list[int]:
        """Token ids of one pre-token. A point update stops where a node's least does not change."""
        ids, rank_of = [self.byte_ids[b] for b in word], self.rank_of
        n = len(ids)
        width = 1 << max(1, (n - 1).bit_length())
        bits = width.bit_length()
        mask, none = (1 << bits) - 1, 1 << 62
        tree = [none] * (2 * width)
        for i in range(n - 1):
            rank = rank_of.get(ids[i] << 32 | ids[i + 1])
            if rank is not None:
                tree[width + i] = rank << bits | i
        for i in range(width - 1, 0, -1):
            tree[i] = min(tree[2 * i], tree[2 * i + 1])
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while tree[1] < none:
            root = tree[1]
            place = root & mask
            gone = after[place]
            follow, prior = after[gone], before[place]
            new = ids[place] = self.new_id[root >> bits]
            ids[gone] = -1
            after[place] = follow
            updates = [(gone, none)]
            if follow < n:
                before[follow] = place
                rank = rank_of.get(new << 32 | ids[follow])
                updates.append((place, none if rank is None else rank << bits | place))
            else:
                updates.append((place, none))
            if prior >= 0:
                rank = rank_of.get(ids[prior] << 32 | new)
                updates.append((prior, none if rank is None else rank << bits | prior))
            for leaf, value in updates:
                node = width + leaf
                tree[node] = value
                node >>= 1
                while node:
                    left, right = tree[2 * node], tree[2 * node + 1]
                    least = left if left < right else right
                    if tree[node] == least:
                        break
                    tree[node] = least
                    node >>= 1
        return [x for x in ids if x >= 0]

    def _merge_alike(self, words: list[bytes], width: int, at: np.ndarray, out: list[list[int]]) -> None:
        n = len(words)
        ids = np.full((n, width + 1), -1, np.int32)  # the last column stays empty
        sizes = np.array([len(w) for w in words])
        inside = np.arange(width) < sizes[:, None]
        ids[:, :width][inside] = self.byte_id[np.frombuffer(b"".join(words), np.uint8)]
        if width > 1:
            bits = width.bit_length()
            kind = np.int32 if len(self.made) << bits < 2**31 else np.int64
            none = np.iinfo(kind).max
            after = np.broadcast_to(np.minimum(np.arange(1, width + 2), width), (n, width + 1)).copy()
            before = np.broadcast_to(np.arange(-1, width), (n, width + 1)).copy()
            after[:, :width] = np.where(np.arange(1, width + 1) < sizes[:, None], after[:, :width], width)
            tree = np.full((n, 2 * width), none, kind)
            tree[:, width : 2 * width] = self._leaf(ids[:, :width], ids[:, 1:], np.arange(width), bits, none)
            level = width
            while level > 1:
                tree[:, level // 2 : level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
                level //= 2
            live = np.flatnonzero(tree[:, 1] < none)
            while len(live):
                root = tree[live, 1]
                place = root & ((1 << bits) - 1)
                gone = after[live, place]
                follow = after[live, gone]
                ids[live, place] = self.made[root >> bits]
                ids[live, gone] = -1
                after[live, place] = follow
                before[live, follow] = place
                prior = before[live, place]
                tree[live, width + place] = self._leaf(ids[live, place], np.where(follow < width, ids[live, follow], -1), place, bits, none)
                tree[live, width + gone] = none
                has = prior >= 0
                tree[live[has], width + prior[has]] = self._leaf(ids[live[has], prior[has]], ids[live[has], place[has]], prior[has], bits, none)
                for leaf, rows in ((place, live), (gone, live), (prior[has], live[has])):
                    node = (leaf + width) >> 1
                    for _ in range(width.bit_length() - 1):
                        tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])
                        node >>= 1
                live = live[tree[live, 1] < none]
        for i in range(n):
            row = ids[i, :width]
            out[at[i]] = row[row >= 0].tolist()

    def encode_pieces(self, pieces: list[str]) -> list[str]:
        """Ids of each piece, all of its pre-tokens merged at once."""
        tokens = [self.pattern.findall(p) for p in pieces]
        unique = list({t for ts in tokens for t in ts})
        ids = dict(zip(unique, (",".join(map(str, x)) for x in self.merge([t.encode() for t in unique])), strict=True))
        return [",".join([ids[t] for t in ts]) for ts in tokens]

    def pieces(self, text: str) -> list[str]:
        """Parts of the text whose tokens do not depend on each other; all but the first have lost a leading space."""
        irregular = any(x in text for x in (_ASCII_PAIRS if text.isascii() else _PAIRS))
        return self.boundary.split(text) if irregular else text.split(" ")

    def encode_many(self, texts: list[str]) -> list[str]:
        """Decimal ids of each text, joined by commas. A piece after the first is stored with its space."""
        parts = []
        for text in texts:
            runs = [("", text)]
            if self.special_at is not None and any(s in text for s in self.special):
                runs, at = [], 0
                for m in self.special_at.finditer(text):
                    runs += [("", text[at : m.start()]), (m[0], "")]
                    at = m.end()
                runs.append(("", text[at:]))
            parts.append([str(self.special[s]) if s else self.pieces(t) for s, t in runs if s or t])
        firsts = list({run[0] for runs in parts for run in runs if not isinstance(run, str)})
        first = dict(zip(firsts, self.encode_pieces(firsts), strict=True))
        later: set[str] = set()
        for runs in parts:
            for run in runs:
                if not isinstance(run, str):
                    later.update(run[1:])
        if self.cached > CACHE_BYTES:
            self.cache, self.older, self.cached = {}, self.cache, 0
        unseen = [p for p in later if p not in self.cache]
        self.cache.update((p, self.older[p]) for p in unseen if p in self.older)
        new = [p for p in unseen if p not in self.older]
        fresh = self.encode_pieces([" " + p for p in new])
        self.cache.update(zip(new, fresh, strict=True))
        self.cached += sum(map(len, new)) + sum(map(len, fresh)) + ENTRY_BYTES * len(unseen)
        look = self.cache.__getitem__
        out = []
        for runs in parts:
            ids = []
            for run in runs:
                if isinstance(run, str):
                    ids.append(run)
                else:
                    ids.append(first[run[0]])
                    ids.extend(map(look, run[1:]))
            out.append(",".join([x for x in ids if x]))
        return out

    def decode(self, ids: str) -> str:
        """Text of decimal ids joined by commas; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.token_bytes.__getitem__, ids.split(","))).decode("utf-8", "replace") if ids else ""


@lru_cache(1)
def _loaded(source: str) -> SegmentTreeBPE:
    return SegmentTreeBPE(source)


def _digests(shared, carry: Sequence[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _loaded(shared.value)
        for batch in batches:
            for low, high, raw, offsets in text_slices(batch.column("text")):
                body = raw.tobytes()
                texts = [body[a:b].decode("utf-8", "replace") for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                encoded = coder.encode_many(texts)
                counts = [x.count(",") + 1 if x else 0 for x in encoded]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(low, high - low),
                        pa.array(counts, pa.int64()),
                        pa.array([hashlib.sha256(x.encode()).hexdigest() for x in encoded]),
                        pa.array([hashlib.sha256(coder.decode(x).encode()).hexdigest() for x in encoded]),
                        *[batch.column(c).slice(low, high - low) for c in carry],
                    ],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *carry],
                )

    return run


def _token_ids(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _loaded(shared.value)
        for batch in batches:
            for low, high, raw, offsets in text_slices(batch.column("text")):
                body = raw.tobytes()
                texts = [body[a:b].decode("utf-8", "replace") for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                ids = [np.fromstring(x, np.int32, sep=",") if x else np.zeros(0, np.int32) for x in coder.encode_many(texts)]
                ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(low, high - low), pa.ListArray.from_arrays(ends, np.concatenate(ids))], ["doc_id", "ids"])

    return run


def _texts(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _loaded(shared.value)
        for batch in batches:
            texts = [coder.decode(",".join(map(str, x or []))) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return run


def default_vocabulary() -> str:
    """Place of the 50k byte-level vocabulary that is installed with the public tokenizer files."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _shared(df: DataFrame, vocabulary: str | None):
    """The vocabulary file (a few MB, fixed) for all executors; it is read on the driver only."""
    bounded_batches(df.sparkSession)
    with open(vocabulary or default_vocabulary(), encoding="utf-8") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def _id_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def bpe_encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """(doc_id, ids array<int>) of whole texts, a row per input row. Null and empty texts have no ids.

    Texts and unbroken words of any length are encoded whole. Repeated rows and null ids are returned as they come; other
    columns are ignored. An empty table gives no rows. There is no shuffle.
    """
    docs = _id_text(docs, id_col, text_col)
    return docs.mapInArrow(_token_ids(_shared(docs, vocabulary)), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def bpe_decode(tokens: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", vocabulary: str | None = None) -> DataFrame:
    """(doc_id, text) of token ids, special tokens included, a row per input row. Null and empty lists give empty texts.

    Bytes that are no UTF-8 become U+FFFD. Repeated rows and null ids are returned as they come; other columns are
    ignored. An empty table gives no rows.
    """
    tokens = tokens.select(F.col(id_col).alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids"))
    return tokens.mapInArrow(_texts(_shared(tokens, vocabulary)), f"doc_id {tokens.schema['doc_id'].dataType.simpleString()}, text string")


def bpe_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, carry: Sequence[str] = ()) -> DataFrame:
    """Encode whole texts and decode the ids: (doc_id, n_tokens, ids_sha256, decoded_sha256), a row per input row.

    The strings of special tokens in a text become their ids; none are added. Null texts count as
    empty: no tokens, digests of the empty string. Repeated rows and null ids are returned as they
    come with the columns named in ``carry``, other columns are ignored. Very long texts and unbroken
    words are encoded whole. An empty table gives no rows. There is no shuffle.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), *carry)
    kinds = {c: docs.schema[c].dataType.simpleString() for c in ("doc_id", *carry)}
    schema = ", ".join([f"doc_id {kinds['doc_id']}, n_tokens long, ids_sha256 string, decoded_sha256 string", *[f"`{c}` {kinds[c]}" for c in carry]])
    return docs.mapInArrow(_digests(_shared(docs, vocabulary), carry), schema)
