"""Corpus operators against brute force, SQL and round trips, with nulls, empty, long, tied and repeated input."""

from __future__ import annotations

import hashlib
import random
import re
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
import pytest
from conftest import same_rows
from pyspark.sql import functions as F

import corpus_pipeline
from plumbline.llm import bpe, chat, common, fingerprints, langid, mixing, mtree, near_dedup, quality, substring_dedup, warc
from plumbline.llm.queries import oracle_sql, queries
from plumbline.session import Workspace

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n string, a string, anchor string"
WORDS = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua".split()


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + str(rng.randrange(50)) for _ in range(n))


def odd_texts() -> list[tuple[int | None, str | None]]:
    """Texts with all the edges that the operators name."""
    base, shared = prose(1, 120), prose(2, 70)
    near = base.split()
    near[60] = "changed"
    return [
        (1, base),
        (2, base),
        (3, " ".join(near)),
        (4, base.upper()),
        (5, None),
        (6, ""),
        (7, "one two"),
        (8, "ONE\ttwo"),
        (9, "\n \x0b"),
        (10, f"{prose(3, 20)}\n{shared}\n{prose(4, 20)}"),
        (11, f"{prose(5, 30)} {shared}"),
        (12, prose(6, 12_000)),
        (13, "x" * 50_000),
        (14, "same " * 300),
        (15, "same " * 200),
        (16, "Élan vital é ﬁn <|endoftext|> 漢字 🙂"),
        (7, "one two"),
        (7, shared),
        (None, base),
        (None, None),
    ]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, None if k % 5 == 0 else "en", None if k % 4 == 0 else f"s{k % 3}", None if t is None else len(t), "n", "a", "z") for k, (i, t) in enumerate(odd_texts())]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def test_sql_for_what_sql_can_express(spark, sf, duck):
    for name in ("op6_warc", "op7_chat", "op10_top_k", "op9_substring_dedup", "op3_near_duplicates"):
        same_rows(queries()[name](spark, sf), duck, oracle_sql()[name])


# --- op1 ------------------------------------------------------------------------------------


def test_bpe_equals_the_library(spark, odd, sf):
    from tokenizers import Tokenizer

    reference = Tokenizer.from_file(bpe.default_vocabulary())
    docs = odd.unionByName(spark.read.parquet(f"{sf}/documents.parquet").filter("doc_id % 5 = 0").select("doc_id", "text"), allowMissingColumns=True)
    for r in bpe.bpe_encode(docs, id_col="text").collect():  # the text itself names the row
        assert r.ids == reference.encode(r.doc_id or "", add_special_tokens=False).ids
    decoded = bpe.bpe_decode(spark.createDataFrame([(1, [464, 3290]), (2, None), (3, []), (4, [50256, 171])], "doc_id int, ids array<int>")).collect()
    assert [r.text for r in decoded] == ["The dog", "", "", "<|endoftext|>�"]


def test_bpe_fuzz():
    from tokenizers import Tokenizer

    coder, reference = bpe.SegmentTreeBPE(open(bpe.default_vocabulary()).read()), Tokenizer.from_file(bpe.default_vocabulary())
    rng = random.Random(3)
    parts = ["a", "b", " ", "  ", "\n", "\t", "'s", "'ll", "1", "²", "é", "é", " ", "　", "\x1c", "\x85", "🙂", "<|endoftext|>", "!!", "the", "\r\n", "汉", " '", "\x00", "ſ"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(14))) for _ in range(3000)] + ["ab" * 2000, " " * 3000 + "x"]
    got = coder.encode_many(texts)
    want = [",".join(map(str, e.ids)) for e in reference.encode_batch(texts, add_special_tokens=False)]
    assert got == want
    assert [coder.decode(x) for x in got] == texts


def test_bpe_of_very_long_words():
    import time

    from tokenizers import Tokenizer

    coder, reference = bpe.SegmentTreeBPE(open(bpe.default_vocabulary()).read()), Tokenizer.from_file(bpe.default_vocabulary())
    rng = random.Random(1)
    for n in (2, 3, 64, 1023, 50_000):
        for letters in ("acgt", "abcdefghijklmnopqrstuvwxyz", "é漢"):
            text = "".join(rng.choice(letters) for _ in range(n))
            assert coder.encode_many([text]) == [",".join(map(str, reference.encode(text, add_special_tokens=False).ids))]
    began = time.process_time()
    coder.encode_many(["".join(rng.choices("acgt", k=1_000_000))])
    assert time.process_time() - began < 30


def test_bpe_remembers_a_bounded_number_of_bytes(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_BYTES", 20_000)
    coder = bpe.SegmentTreeBPE(open(bpe.default_vocabulary()).read())
    for i in range(60):
        coder.encode_many([prose(i, 40)])
        assert sum(map(len, coder.cache)) + sum(map(len, coder.older)) < 60_000


def test_bpe_digests_of_edges(odd):
    rows = bpe.bpe_digests(odd).collect()
    assert len(rows) == odd.count()
    empty = hashlib.sha256(b"").hexdigest()
    assert [(r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows if r.doc_id in (5, 6)] == [(0, empty, empty)] * 2
    assert bpe.bpe_digests(odd.limit(0)).count() == 0


# --- op2 ------------------------------------------------------------------------------------


def test_language_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = queries()["op2_language_id"](spark, sf).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in out) / len(out) > 0.98
    assert all(0 <= r.score <= 1 for r in out)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in out)


def test_language_edges(spark, odd):
    train = spark.createDataFrame([("en", "the cat and the dog"), ("de", "der hund und die katze"), (None, "x"), ("fr", None)], "lang string, text string")
    profiles = langid.learn_profiles(train)
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict_language(odd.filter("doc_id in (5, 6, 9, 16)"), profiles).collect()}
    assert got[5] == got[6] == got[9] == ("und", 0.0) and got[16][0] in ("de", "en")
    few = spark.createDataFrame([(1, "the dog and cat"), (2, "die katze und hund"), (3, "123 !!"), (1, "the dog and cat")], "doc_id int, text string")
    assert [r.lang_pred for r in langid.predict_language(few, profiles).orderBy("doc_id").collect()] == ["en", "en", "de", "und"]
    assert {r.lang_pred for r in langid.predict_language(few, profiles.limit(0)).collect()} == {"und"}
    assert langid.predict_language(few.limit(0), profiles).count() == 0


def brute_grams(text: str) -> list[str]:
    """N-grams of a text by falling count, then code points."""
    count: dict[str, int] = {}
    for word in re.findall(r"[^\W\d_]+", "".join(c.lower() if len(c.lower()) == 1 else c for c in text)):
        padded = f"\x01{word}\x01"
        for n in (1, 2, 3):
            for i in range(len(padded) - n + 1):
                if (g := padded[i : i + n]) != "\x01":
                    count[g] = count.get(g, 0) + 1
    code = lambda g: tuple(map(ord, g))
    return sorted(count, key=lambda g: (-count[g], len(g), code(g)))


@pytest.mark.parametrize("at_a_time", [2_000, 2])
def test_predictions_equal_brute_force(spark, sf, at_a_time, monkeypatch):
    monkeypatch.setattr(langid, "MOST_LANGUAGES", at_a_time)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    han = spark.createDataFrame([(10**6, chr(0x30010) * 3 + " " + chr(0x31360), "hx"), (10**6 + 1, chr(0x30010), None), (10**6 + 2, "𝐀𝐁 ə", "mx"), (10**6 + 3, "12 !", None), (10**6 + 4, chr(0x10FFFD) + chr(0xE0041), None)], "doc_id long, text string, lang string")
    docs = docs.filter("doc_id % 4 = 0").unionByName(han)
    train: dict[str, list[str]] = {}
    for r in docs.collect():
        if r.lang is not None:
            train.setdefault(r.lang, []).append(r.text or "")
    ranks = {lang: {g: i for i, g in enumerate(brute_grams("\n".join(texts))[:300], 1)} for lang, texts in train.items()}
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict_language(docs, langid.learn_profiles(docs)).collect()}
    for r in docs.collect():
        top = brute_grams(r.text or "")[:300]
        far = {lang: sum(min(abs(i - rank[g]), 300) if g in rank else 300 for i, g in enumerate(top, 1)) for lang, rank in sorted(ranks.items())}
        lang = min(far, key=far.get) if top else "und"
        assert got[r.doc_id] == (lang, pytest.approx(1 - far[lang] / (300 * len(top)) if top else 0.0))
    assert got[10**6 + 1][0] == "hx" and got[10**6 + 3] == got[10**6 + 4] == ("und", 0.0)


def test_profile_counts_equal_brute_force(spark):
    text = "Ab, ab cÉ"
    want: dict[str, int] = {}
    for word in re.findall(r"[^\W\d_]+", text.lower()):
        padded = f"_{word}_"
        for n in (1, 2, 3):
            for i in range(len(padded) - n + 1):
                g = padded[i : i + n]
                if g != "_":
                    want[g] = want.get(g, 0) + 1
    grams, counts = langid._grams(text, 3)
    read = lambda g: "".join("_" if c == 1 else chr(c) for c in ((int(g) >> s) & 0x1FFFFF for s in (42, 21, 0)) if c)
    assert {read(g): int(c) for g, c in zip(grams, counts, strict=True)} == want


# --- op3 ------------------------------------------------------------------------------------


def shingle_set(text: str | None) -> frozenset:
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)])


def brute_components(rows: list[tuple[int, str | None]]) -> dict[int, int]:
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = [(i, shingle_set(t)) for i, t in rows]
    for k, (i, s) in enumerate(sets):
        for j, o in sets[:k]:
            if s and o and 100 * len(s & o) >= 75 * len(s | o):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i: find(i) for i in parent}


def test_near_duplicates_edges(odd):
    rows = odd_texts()
    got = near_dedup.near_duplicates(odd).collect()
    assert len(got) == len(rows)
    want = brute_components([r for r in rows if r[0] is not None])
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == want
    assert want[3] == 1 and want[4] == 1 and want[8] == 7 and want[15] == 14
    assert all(r.kept and r.component_id is None for r in got if r.doc_id is None)
    assert {r.doc_id: r.n_shingles for r in got if r.doc_id in (5, 6, 9, 13, 14)} == {5: 0, 6: 0, 9: 0, 13: 1, 14: 1}
    assert near_dedup.near_duplicates(odd.limit(0)).count() == 0


def test_a_doc_id_with_several_texts_joins_them(spark):
    rows = [(1, "a b c"), (5, "a b c"), (5, "x y z"), (2, "x y z"), (7, "x y z"), (8, "p q r")]
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 5: 1, 2: 1, 7: 1, 8: 8}


def test_near_duplicates_of_a_large_group(spark):
    """Hundreds of near copies of one text, some at the threshold: the dense regions' way."""
    rng = random.Random(5)
    base = prose(9, 150).split()
    rows = []
    for i in range(400):
        words = list(base)
        for _ in range(rng.randrange(6)):
            words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
        rows.append((i + 1, " ".join(words)))
    rows += [(1000 + i, prose(100 + i, 60)) for i in range(60)]
    rng.shuffle(rows)
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    assert got == brute_components(rows)


def test_components_of_long_paths(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (102, 100), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in common.connected_components(Workspace(spark, "t"), edges).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100, 7: 0}


def test_components_take_rounds_by_the_logarithm(spark, monkeypatch):
    """An ordered path of 100,000 nodes, the worst case of hooking to the least neighbour."""
    rounds = []
    drop = Workspace.save
    monkeypatch.setattr(Workspace, "save", lambda self, df, name: rounds.append(name) or drop(self, df, name))
    monkeypatch.setattr(common, "SMALL_GRAPH", 100)
    n = 100_000
    got = common.connected_components(Workspace(spark, "t"), spark.range(n).selectExpr("id AS a", "id + 1 AS b"))
    assert got.groupBy("component").count().collect() == [(0, n + 1)]
    assert rounds.count("hooks") < 25


def test_components_of_larger_graphs_and_merges(spark, monkeypatch):
    monkeypatch.setattr(common, "SMALL_GRAPH", 0)
    ws = Workspace(spark, "t")
    labels = ws.save(common.connected_components(ws, spark.createDataFrame([(1, 2), (3, 4), (5, 6)], "a long, b long")), "l")
    assert {r.node: r.component for r in labels.collect()} == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5, 6: 5}
    more = common.merged_components(ws, labels, spark.createDataFrame([(4, 6), (9, 5), (1, 2), (10, 11)], "a long, b long"))
    assert {r.node: r.component for r in more.collect()} == {1: 1, 2: 1, 3: 3, 4: 3, 5: 3, 6: 3, 9: 3, 10: 10, 11: 10}


@pytest.mark.parametrize("equal, found", [(321, True), (400, True), (320, False)])
def test_pairs_of_large_regions_are_checked_from_the_stated_equal_values(equal, found):
    sketch = np.zeros((2, near_dedup.WIDE), np.uint8)
    sketch[1, equal:] = 1
    side = lambda mark, i, out: pa.table({f"{mark}_doc": [i + 1], f"{mark}_component": [i + 1], f"{mark}_n": [100], f"{mark}_outside": [out], f"{mark}_sketch": pa.array([sketch[i].tobytes()], pa.binary())})
    assert near_dedup._suspects(75)(side("l", 0, True), side("r", 1, False)).to_pylist() == [{"x": 1, "component": 2}] * found


def test_chance_to_miss_a_true_link():
    from math import comb

    below = lambda n, k: sum(comb(n, i) * 0.75**i * 0.25 ** (n - i) for i in range(k))
    assert below(near_dedup.SIGNATURE, near_dedup.CLOSE[0]) < 4e-10 and below(near_dedup.WIDE, near_dedup.CLOSE[1]) < 4e-10


def thue_morse(n: int, swap: bool) -> str:
    return "".join("ab"[(bin(i).count("1") + swap) % 2] for i in range(n))


def test_words_of_one_pattern_are_told_apart(spark):
    """Words whose polynomial hashes modulo 2**64 are equal whatever the step."""
    one, two = thue_morse(1024, False), thue_morse(1024, True)
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(spark.createDataFrame([(1, one), (2, two)], "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 2}
    words = prose(77, 60).split()
    texts = [" ".join([*words[:30], w, *words[31:]]) for w in (one, two)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in substring_dedup.remove_repeats(rows).collect()} == {0: 0, 1: 0}
    letters = [thue_morse(2048, swap) for swap in (False, True)]
    texts = [" ".join("first" if c == "a" else "second" for c in x) for x in letters]
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {r: c for r, c in brute_components(list(enumerate(texts))).items()}


def test_word_hashes_are_those_of_the_bytes():
    rng = random.Random(2)
    words = [rng.randbytes(rng.choice([1, 3, 7, 8, 9, 15, 16, 17, 63, 64, 65, 200])).hex().encode()[: rng.randrange(1, 300)] for _ in range(400)]
    words += [w[:-1] + b"z" for w in words if len(w) > 1]
    lanes, start, stop = common.word_hashes(np.frombuffer(b" ".join(words), np.uint8), lanes=2)
    assert len(start) == len(words)
    for lane in lanes:
        assert len(dict(zip(words, lane.tolist(), strict=True))) == len(set(lane.tolist())) == len(set(words))


# --- op4 ------------------------------------------------------------------------------------


def canonical(text: str) -> str:
    text = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    return re.sub(r"\s+", " ", text).strip()


@pytest.mark.parametrize("dense", [True, False])
def test_fingerprints_against_brute_force(odd, dense, monkeypatch):
    monkeypatch.setattr(fingerprints, "_dense", lambda docs: dense)
    rows = sorted([(i, t or "") for i, t in odd_texts() if i is not None], key=lambda r: (-r[0], r[1].encode()))
    want = []
    for k, (i, t) in enumerate(rows):
        following, cut = rows[(k + 1) % len(rows)][1], len(t) // 3
        edited = t[: len(t) - cut] + following[:cut]
        want.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), float(canonical(t) == canonical(edited)), float(canonical(t) == canonical(following))))
    got = fingerprints.fingerprints(odd).collect()
    assert sorted((r.doc_id, r.n_chars, r.edited_sha256, r.near_edited, r.near_next) for r in got if r.doc_id is not None) == sorted(want)
    prints = {}
    for r in got:
        prints.setdefault(r.doc_id, set()).add(r.fingerprint)
    assert prints[1] == prints[2] == prints[4] and prints[1] != prints[3] and prints[5] == prints[6] == prints[9] and prints[7] >= prints[8]
    assert [r.near_next for r in got if r.doc_id is None] == [0.0, 0.0]


def test_equal_digests_of_different_texts_are_told_apart(odd):
    weak = lambda c: F.substring(F.sha2(c, 256), 1, 1)
    got = fingerprints.fingerprints(odd.filter("doc_id is not null"), digest=weak).collect()
    texts = [(i, canonical(t or "")) for i, t in odd_texts() if i is not None]
    assert len({r.fingerprint for r in got}) == len({t for _, t in texts})
    assert fingerprints.fingerprints(odd.limit(0)).count() == 0


def test_fingerprints_stay_native(spark, sf):
    plan = queries()["op4_fingerprints"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("ids", ["dense", "hashed", "far", "clustered", "one"])
def test_blocks_of_ids_are_even_and_in_order(spark, ids):
    """However ids lie, blocks rise with them and hold few rows; repeated ids share one."""
    n = 60_000
    how = {"dense": "id", "hashed": "xxhash64(id)", "far": "id * 70000000000000 - 2000000000000000000", "clustered": "if(id < 30000, id, 4611686018427387904 + id * 3)", "one": "7L"}
    docs = spark.range(n).selectExpr(f"{how[ids]} AS doc_id")
    rows = docs.withColumn("block", fingerprints._blocks(docs)).groupBy("block").agg(F.count("*").alias("n"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).orderBy("block").collect()
    assert all(a.high < b.low for a, b in zip(rows, rows[1:], strict=False))
    if ids == "one":
        assert len(rows) == 1
    else:
        assert max(r.n for r in rows) <= 4 * fingerprints.BLOCK and len(rows) >= n // fingerprints.BLOCK // 4


# --- op5 ------------------------------------------------------------------------------------


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality")
    rows = queries()["op5_quality"](spark, sf).join(labels, "doc_id").filter("held_out").collect()
    good = [r for r in rows if r.quality == 1]
    assert sum(r.predicted for r in good) / len(good) > 0.97
    assert np.mean([r.score for r in good]) > np.mean([r.score for r in rows if r.quality == 0]) + 0.3
    assert all(r.predicted == int(r.score >= 0.3) for r in rows)


def test_scores_equal_brute_force(spark, sf):
    """Sample, dictionaries, fit and scores of the query, worked out again without Spark and from the definitions."""
    import zstandard

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    train = {(r.doc_id, r.quality) for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r.quality in (0, 1) and zlib.crc32(str(r.doc_id).encode()) % 5 and docs.get(r.doc_id) is not None}
    ids = spark.createDataFrame([(i, x) for i, x in train], "doc_id long, label int")
    at = {r.doc_id: r for r in ids.select("doc_id", (F.xxhash64(F.lit("half"), "doc_id") % 2).alias("half"), *[F.xxhash64(F.lit(p), "doc_id").alias(p) for p in ("dictionary", "calibration")]).collect()}
    chosen = {}
    for purpose in ("dictionary", "calibration"):
        for label in (0, 1):
            own = sorted((at[i][purpose], i) for i, x in train if x == label and (at[i].half == 0) == (purpose == "dictionary"))[: quality.FIT_ROWS]
            chosen[purpose, label], total = [], 0
            for _, i in own:
                text = docs[i].encode()
                if total + len(text) <= quality.FIT_BYTES:
                    total += len(text)
                    chosen[purpose, label] += [text] if text else []
    coders = []
    for label in (1, 0):
        raw = quality._dictionary(chosen["dictionary", label])
        coders.append(zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(raw), write_content_size=False, write_checksum=False, write_dict_id=False))

    def brute_features(text: bytes) -> list[float]:
        n = max(1, round(len(text) / 400))
        d, least = [], []
        for i in range(n):
            block = text[len(text) * i // n : len(text) * (i + 1) // n]
            good, bad = (len(c.compress(block)) for c in coders)
            d.append((bad - good) / (bad + good))
            least.append(min(good, bad) / (len(block) + 8))
        short, shrunk, mean = 1 / (1 + len(text) / 100), float(np.log(min(least))), 10 * sum(d) / n
        return [1.0, mean, 10 * float(np.percentile(d, 25)), 10 * min(d), shrunk, shrunk**2, short, short * mean, short * shrunk]

    x = np.array([brute_features(t) for label in (0, 1) for t in chosen["calibration", label]])
    y = np.array([label for label in (0, 1) for _ in chosen["calibration", label]], float)
    model = quality.fit_quality(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"), langid.fold("doc_id", 5) != 0)
    weights, share, rate = model.weights.copy(), np.mean([x for _, x in train]), y.mean()
    weights[0] -= np.log(share / (1 - share)) - np.log(rate / (1 - rate))
    slope = x.T @ (1 / (1 + np.exp(-(x @ weights))) - y) / len(y) + 1e-3 * weights  # of the penalised likelihood
    assert np.abs(slope).max() < 1e-6
    got = {r.doc_id: r.score for r in queries()["op5_quality"](spark, sf).collect()}
    assert set(got) == set(docs)
    for i, text in list(docs.items())[::3]:
        assert got[i] == pytest.approx(1 / (1 + np.exp(-float(np.array(brute_features((text or "").encode())) @ model.weights))), abs=1e-9)


def test_quality_learns_from_long_texts(spark, monkeypatch):
    rows = [(i, prose(i, 40) if i % 2 else f"buy {i} now!! " * 12) for i in range(60)] + [(100 + 2 * i, f"buy{i} now!! " * 12_000) for i in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, quality int")
    found: list[int] = []
    keep = quality._dictionary
    monkeypatch.setattr(quality, "_dictionary", lambda texts: found.extend(map(len, texts)) or keep(texts))
    quality.fit_quality(docs, labels, F.lit(True))
    assert max(found) > 100_000
    found.clear()
    quality.fit_quality(docs, labels, F.lit(True), size=100_000)
    assert found and sum(found) <= 200_000 and max(found) < 100_000


def test_quality_edges(spark, odd):
    labels = spark.createDataFrame([(1, 1), (2, 1), (14, 0), (15, 0), (99, 0), (3, None), (None, 1)], "doc_id long, quality int")
    model = quality.fit_quality(odd, labels, F.lit(True))
    got = quality.score_quality(odd, model).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
    flat = quality.fit_quality(odd, labels.limit(0), F.lit(True))
    assert {r.predicted for r in quality.score_quality(odd, flat).collect()} == {1}
    assert quality.score_quality(odd.limit(0), model).count() == 0


# --- op6 ------------------------------------------------------------------------------------


def test_warc_round_trip(spark):
    rows = [(5, "http://a/", "same"), (2, "http://b/\r\nX: y", "same"), (9, None, "same"), (3, "u", None), (4, "u", ""), (7, "u", "é\r\n\r\nWARC/1.1"), (None, "u", "same"), (8, "u", "big " * 600_000), (2, "http://b/", "same")]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, sha int").repartition(2)
    got = sorted(map(tuple, warc.archive_pages(pages).collect()), key=str)
    first = {}
    for i, _, html in rows:
        if i is not None:
            first[html or ""] = min(i, first.get(html or "", i))
    want = []
    for i, _, html in rows:
        body = (html or "").encode()
        revisit = i != first[html or ""]
        want.append((i, len(body), warc.base32_sha1(body), "revisit" if revisit else "response", first[html or ""] if revisit else None))
    assert got == sorted(want, key=str)
    assert warc.archive_pages(pages.limit(0)).count() == 0


def test_warc_small_payloads_and_random_access(spark):
    pages = spark.createDataFrame([(i, "u", "x" * (i % 3)) for i in range(9)], "page_id long, url string, html string")
    ws = Workspace(spark, "t")
    index = warc.write_warc(pages, ws, min_revisit_bytes=2)
    kinds = {r.page_id: r.record_type for r in warc.read_warc(index).collect()}
    assert sorted(k for k, v in kinds.items() if v == "revisit") == [5, 8]
    got = {r.page_id: warc.parse_record(bytes(r.record)) for r in warc.fetch_records(index, spark.createDataFrame([(4,), (2,), (77,)], "page_id long")).collect()}
    assert {k: v[2] for k, v in got.items()} == {4: b"x", 2: b"xx"}
    assert got[2][0]["warc-record-id"] == "<urn:page:2>"


def test_bundle_frames_are_independent(tmp_path):
    import zstandard

    writer = warc.BundleWriter(str(tmp_path))
    records = [warc.format_record(warc.record_name(i), "u", random.Random(i).randbytes(200_000).hex().encode(), "D", None, "2024") for i in range(12)]
    places = [writer.add(r) for r in records]
    writer.close()
    reader = warc.BundleReader(f"{tmp_path}/{writer.name}")
    assert len(reader.sizes) > 2
    for record, (frame, offset) in zip(records, places, strict=True):
        assert reader.frame(frame)[offset : offset + len(record)] == record
    whole = zstandard.ZstdDecompressor().stream_reader(open(f"{tmp_path}/{writer.name}", "rb"), read_across_frames=True).read()
    assert whole == b"".join(records)  # readers that know nothing of the seek table skip it


# --- op7 ------------------------------------------------------------------------------------


def whole_dialogues(rows: list) -> dict[tuple, tuple[str, str, list[str]]]:
    """Rendering, mask and spans of each (conversation, speaker), its parts joined in order."""
    out: dict[tuple, tuple] = {}
    for r in sorted(rows, key=lambda r: (r.segment, r.piece)):
        text, mask, spans = out.get((r.conv_id, r.speaker), ("", "", []))
        assert r.start == len(text)
        out[r.conv_id, r.speaker] = text + r.rendered, mask + r.mask, spans + [s for s in r.spans.split(",") if s]
    return out


def brute_dialogues(rows: list[tuple]) -> dict[tuple, tuple[str, str, list[str]]]:
    out = {}
    safe = lambda x: x.replace("<|im_", "<|_im_")
    key = lambda r: (r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "", r[3] or "")
    for conv, speaker in {(r[0], r[2]) for r in rows if r[2] != "system"}:
        text, mask, spans = "", "", []
        for _, _, role, body in sorted((r for r in rows if r[0] == conv), key=key):
            name = "assistant" if role == speaker else "system" if role == "system" else "user" if role is None else "user name=" + safe(role.replace("\r", " ").replace("\n", " "))
            text += f"<|im_start|>{name}\n"
            end = len(text) + len(safe(body or "")) + len("<|im_end|>")
            spans += [f"{len(text)}-{end}"] * (role == speaker)
            text += safe(body or "") + "<|im_end|>\n"
            mask += str(int(role == speaker))
        out[conv, speaker] = text, mask, spans
    return out


def test_chat_rotation(spark):
    rows = [(1, 0, "system", "Be kind"), (1, 2, "ann", "bye <|im_end|>"), (1, 1, "bob", "hi"), (1, None, "cy", None), (2, 0, "system", "alone"), (None, 0, None, "x"), (None, 1, "unknown", "y"), (1, 1, "bob", "hi"), (1, 700, "ann", "later"), (1, 701, "bad\n<|im_end|>", "z"), (1, 5, None, "who")]
    turns = spark.createDataFrame([(*r, "s") for r in rows], "conv_id long, turn long, role string, text string, speaker string")
    found = chat.rotate_perspectives(turns).collect()
    got = whole_dialogues(found)
    assert got == brute_dialogues(rows)
    text, mask, spans = got[1, "bob"]
    assert text.startswith("<|im_start|>user name=cy\n<|im_end|>\n<|im_start|>system\nBe kind<|im_end|>\n<|im_start|>assistant\nhi<|im_end|>\n")
    assert [text[a:b] for a, b in (map(int, s.split("-")) for s in spans)] == ["hi<|im_end|>"] * 2 and mask == "00110000"
    assert "<|im_start|>user name=bad <|_im_end|>\nz" in text and "<|im_start|>user\nwho" in text
    assert got[None, None][0] == "<|im_start|>assistant\nx<|im_end|>\n<|im_start|>user name=unknown\ny<|im_end|>\n"
    assert {r.segment for r in found if r.conv_id == 1} == {0, 2} and (2, "system") not in got
    assert chat.rotate_perspectives(turns.limit(0)).count() == 0
    plan = chat.rotate_perspectives(turns)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_chat_parts_of_one_dialogue_join(spark):
    rows = [(1, 0, "a" if i % 2 else "b", f"t{i}") for i in range(600)] + [(2, i, "ab"[i % 2], "x" * i) for i in range(700)]
    found = chat.rotate_perspectives(spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")).collect()
    assert sorted(r.n_messages for r in found if r.conv_id == 1) == [88, 88, 256, 256, 256, 256] and {r.piece for r in found} == {0, 1, 2}
    assert whole_dialogues(found) == brute_dialogues(rows)


# --- op8 ------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    "weights", [{"a": 1, "b": 1}, {"a": 0.9, "b": 0.1}, {"a": 1 / 3, "b": 2 / 3}, {"a": 5, "b": 3, "c": 1}, {f"s{i}": i * i + 1 for i in range(12)}, {"only": 2}, {None: 1, "x": 9}, {"big": 0.91} | {f"s{i}": 0.001 for i in range(90)}]
)
def test_pfair_schedule_stays_within_a_block(weights):
    """Over many periods every slot is given once, and every share is within a block of the given weight."""
    from fractions import Fraction

    names = sorted(weights, key=lambda s: (s is not None, s))
    exact = mixing.exact_parts(weights)
    parts, total = [exact[s] for s in names], sum(exact.values())
    near = lambda w: Fraction(w).limit_denominator(1000)
    assert all(Fraction(exact[s], total) == near(weights[s]) / sum(map(near, weights.values())) for s in names)
    slots, done = 20_000, [0] * len(names)
    for slot, (k, block, release, deadline, at) in zip(range(slots), mixing.schedule(parts, [10**9] * len(names)), strict=False):
        assert at == slot and release == block * total // parts[k] and deadline == -(-(block + 1) * total // parts[k])
        assert release <= slot < deadline and block == done[k]
        done[k] += 1
        if slot % 11 == 0:
            assert all(abs(n * total - (slot + 1) * p) < total for n, p in zip(done, parts, strict=True))


def edf_slots(parts: list[int], blocks: list[int], slots: int) -> list[tuple]:
    """Slot by slot: the released block of least deadline, then source; blocks past a source's last have no rows."""
    total, out, done = sum(parts), [], [0] * len(parts)
    for slot in range(slots):
        deadline, k = min((-(-(n + 1) * total // p), k) for k, (n, p) in enumerate(zip(done, parts, strict=True)) if n * total // p <= slot)
        if done[k] < blocks[k]:
            out.append((k, done[k], done[k] * total // parts[k], deadline, slot))
        done[k] += 1
    return out


def test_schedule_equals_earliest_deadline_first_slot_by_slot():
    rng = random.Random(8)
    for _ in range(30):
        parts = [rng.randrange(1, 40) for _ in range(rng.randrange(1, 8))]
        blocks = [rng.randrange(60) for _ in parts]
        assert list(mixing.schedule(parts, blocks)) == edf_slots(parts, blocks, 60 * sum(parts))


def default_parts(spark, sizes: dict) -> dict:
    rows = spark.createDataFrame([(s, n) for s, n in sizes.items()], "s string, n long")
    return {r.s: int(r.part) for r in mixing.default_parts(rows).collect()}


@pytest.mark.parametrize("most", [10**6, 1])
def test_mixing_equals_the_schedule(spark, most, monkeypatch):
    """One definition of slots: by a repeated period and by a walk over all slots, sources that run out among them."""
    monkeypatch.setattr(mixing, "MOST_SLOTS", most)
    docs = spark.createDataFrame([(i, f"s{(i * i) % 7 % 5}") for i in range(3_000)], "doc_id long, source string").repartition(5)
    sizes = {r.source: r["count"] for r in docs.groupBy("source").count().collect()}
    for weights in (None, {"s0": 0.5, "s1": 0.25, "s2": 0.125, "s4": 0.125}, {"s0": 0.02, "s2": 0.98, "unknown": 0.3}):
        exact = mixing.exact_parts(weights) if weights else default_parts(spark, sizes)
        names = sorted(sizes)
        parts = [exact.get(s, min(exact.values())) for s in names]
        blocks = [-(-sizes[s] // 16) for s in names]
        slots = max(-(-n * sum(parts) // p) for n, p in zip(blocks, parts, strict=True))
        want = {(names[k], *rest) for k, *rest in edf_slots(parts, blocks, slots)}
        rows = mixing.mix_sources(docs, weights, block=16).collect()
        assert {(r.source, r.mix_block, r.mix_release, r.mix_deadline, r.mix_slot) for r in rows} == want


@pytest.mark.parametrize("most", [10**6, 1])
def test_a_source_that_has_run_out_leaves_its_slots_empty(spark, most, monkeypatch):
    monkeypatch.setattr(mixing, "MOST_SLOTS", most)
    docs = spark.createDataFrame([(i, "a" if i < 2 else "b") for i in range(8)], "doc_id long, source string")
    rows = mixing.mix_sources(docs, {"a": 1, "b": 1}, block=2).collect()
    assert sorted({(r.source, r.mix_slot) for r in rows}) == [("a", 0), ("b", 1), ("b", 3), ("b", 5)]


def test_mixing_of_many_sources_stays_a_table(spark):
    """A source a row, more than any list of names would hold on a driver at scale: slots are still each given once."""
    docs = spark.range(40_000).selectExpr("id AS doc_id", "concat('s', id % 20000) AS source")
    out = mixing.mix_sources(docs, block=1)
    assert out.count() == 40_000 and out.select("mix_slot").distinct().count() == 40_000


def test_mixing_places_every_row(spark, odd):
    rows = mixing.mix_sources(odd, {"s0": 3.0, "s1": 1.0}, block=2).collect()
    assert len(rows) == odd.count()
    slots: dict[int, set] = {}
    for r in rows:
        slots.setdefault(r.mix_slot, set()).add((r.source, r.mix_block))
        assert r.mix_release <= r.mix_slot < r.mix_deadline
    assert all(len(x) == 1 for x in slots.values())
    sizes: dict[tuple, int] = {}
    for r in rows:
        sizes[r.source, r.mix_block] = sizes.get((r.source, r.mix_block), 0) + 1
    for (source, block), n in sizes.items():
        assert n == 2 or (source, block + 1) not in sizes
    for source in {r.source for r in rows}:  # blocks follow the ids, nulls first
        ids = [r.doc_id if r.doc_id is not None else -1 for r in sorted((r for r in rows if r.source == source), key=lambda r: (r.mix_block, r.doc_id or -1))]
        assert ids == sorted(ids)
    empty = mixing.mix_sources(odd.limit(0))
    assert empty.count() == 0 and empty.columns[-1] == "mix_slot"


def test_mixing_of_one_id_and_of_sources_that_run_out(spark):
    docs = spark.createDataFrame([(5, "a", "x")] * 500 + [(i * 10**12, "b", "y") for i in range(40)] + [(None, "c", "z")], "doc_id long, source string, s string").repartition(7)
    rows = mixing.mix_sources(docs, {"a": 0.1, "b": 0.8, "c": 0.1}, block=1).collect()
    assert len(rows) == 541 and len({r.mix_slot for r in rows}) == 541
    assert {r.s for r in rows} == {"x", "y", "z"} and sorted(r.mix_block for r in rows if r.source == "a") == list(range(500))
    assert max(r.mix_slot for r in rows) >= 4990


# --- op9 ------------------------------------------------------------------------------------


def brute_removed(rows: list[tuple[int | None, str | None]], window: int = 50) -> list[tuple]:
    words = [(i, re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())) for i, t in rows]
    low: dict[tuple, int] = {}
    for i, w in words:
        if i is not None:
            for k in range(len(w) - window + 1):
                key = tuple(w[k : k + window])
                low[key] = min(i, low.get(key, i))
    out = []
    for i, w in words:
        gone = [False] * len(w)
        if i is not None:
            for k in range(len(w) - window + 1):
                if low[tuple(w[k : k + window])] < i:
                    gone[k : k + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def test_substring_dedup_edges(odd):
    got = sorted(map(tuple, substring_dedup.remove_repeats(odd).collect()), key=str)
    assert got == brute_removed(odd_texts())
    assert any(r[2] for r in got)
    assert substring_dedup.remove_repeats(odd.limit(0)).count() == 0


def test_substring_dedup_of_overlapping_repeats(spark):
    """Spliced pieces of a few sources: anchors with several reaches, repeats within a document."""
    rng = random.Random(11)
    sources = [prose(50 + i, 160).split() for i in range(4)]
    rows = []
    for i in range(60):
        words: list[str] = []
        for _ in range(rng.randrange(1, 5)):
            s = rng.choice(sources)
            a = rng.randrange(100)
            words += s[a : a + rng.randrange(30, 90)]
            words += [f"u{rng.randrange(10**6)}"] * rng.randrange(2)
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert sorted(map(tuple, substring_dedup.remove_repeats(df).collect()), key=str) == brute_removed(rows)


def test_substring_dedup_of_periodic_texts(spark):
    """Texts that repeat a few words for long, with other words around, of several periods and lengths."""
    rng = random.Random(12)
    rows = []
    for i in range(70):
        words = [f"u{rng.randrange(10**6)}" for _ in range(rng.randrange(3, 30))]
        for _ in range(rng.randrange(1, 3)):
            period = [["Is", "onhe."], ["a"], ["x", "y", "z"], [f"p{k}" for k in range(23)], [f"q{k}" for k in range(60)]][rng.randrange(5)]
            words += (period * 200)[rng.randrange(3) : rng.randrange(40, 400)]
            words += [f"u{rng.randrange(10**6)}"] * rng.randrange(3)
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(map(tuple, substring_dedup.remove_repeats(df).collect()), key=str) == brute_removed(rows)


def test_texts_lose_exactly_the_repeats(odd):
    cut = substring_dedup.with_repeats_cut(odd)
    assert cut.columns == odd.columns
    rows = cut.collect()
    want = {(r[0], r[3]) for r in brute_removed(odd_texts())}
    assert {(r.doc_id, hashlib.sha256(b" ".join((r.text or "").encode().split())).hexdigest()) for r in rows} == want
    assert [r.text for r in rows if r.doc_id == 8] == ["ONE\ttwo"]


# --- op10 -----------------------------------------------------------------------------------


def test_top_k_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(mtree, "PAGE", 16)
    monkeypatch.setattr(mtree, "PAGES", 3)
    rng = np.random.default_rng(4)
    centers = rng.normal(size=(6, 8))
    rows = [(i, [float(x) for x in centers[i % 6] + rng.normal(size=8) * 0.1]) for i in range(300)]
    rows += [(400 + i, rows[0][1]) for i in range(90)]  # one common vector
    rows += [(500, None), (501, [1.0, None] + [0.0] * 6), (502, [float("nan")] * 8), (503, [float("inf")] * 8), (520, [1.0, 2.0]), (521, [2.0, 1.0]), (None, rows[1][1])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, dim int")
    got = sorted(map(tuple, mtree.mtree_top_k(df, F.col("vec_id") % 20 == 0).collect()))
    good = [(i, np.floor(np.array(v, float) * 64).astype(int)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for i, q in good:
        if i % 20 == 0:
            scored = sorted((-int(q @ x), j) for j, x in good if j != i and len(x) == len(q))[:20]
            want += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scored)]
    assert got == sorted(want)
    assert mtree.mtree_top_k(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_bounds_avoid_computations():
    rng = np.random.default_rng(1)
    centers = rng.normal(size=(20, 8)) * 100
    pages, top = [], 0.0
    data = [(centers[i] + rng.normal(size=(100, 8))).astype(np.int64) for i in range(20)]
    top = float(max((x * x).sum(axis=1).max() for x in data))
    for i, x in enumerate(data):
        lifted = mtree._lift(x, top)
        parent = mtree._distance(lifted[[0]], lifted)[0]
        order = np.argsort(parent)
        pages.append((x[0], parent.max(), np.arange(100)[order] + i * 100, parent[order], x[order]))
    q = data[3][:5]
    best, computed = mtree.search_pages(q, np.arange(5) + 10**6, pages, top, 10)
    every = np.concatenate(data)
    for i in range(5):
        assert sorted(best[i][0], reverse=True) == sorted(q[i] @ every.T, reverse=True)[:10]
    assert computed < 0.5 * 5 * len(every)


def test_the_tree_leaves_out_most_of_clustered_vectors(spark, monkeypatch):
    monkeypatch.setattr(mtree, "PAGE", 32)
    rng = np.random.default_rng(9)
    centers = rng.normal(size=(25, 6)) * 600
    data = np.concatenate([centers[i] + rng.normal(size=(60, 6)) * 10 for i in range(25)]).astype(np.int64)
    top = float((data * data).sum(axis=1).max())
    rows = spark.createDataFrame([(i, [int(c) for c in v], 6) for i, v in enumerate(data)], "vec_id long, v array<long>, dim int")
    leaves, nodes = mtree.build_tree(Workspace(spark, "t"), rows, top, 64)
    kept = nodes.collect()
    unit_of = {r.vec_id: r.unit for r in leaves.collect()}
    assert len(unit_of) == len(data) and max(n.node.count(".") for n in kept) >= 2
    below = {n.node: [i for i, u in unit_of.items() if u == n.node or (u or "").startswith(n.node + ".")] for n in kept}
    for n in kept:  # covering radii hold all rows below
        if n.routing is not None and below[n.node]:
            far = mtree._distance(mtree._lift(np.array([n.routing]), top), mtree._lift(data[below[n.node]], top)).max()
            assert far <= n.radius + 1e-6 or n.unit != n.node
    trees, names = mtree._tree_lists([n for n in kept if n.unit is None or n.unit == n.node], top)
    q = data[::97]
    scores = q @ data.T
    least = np.sort(scores, axis=1)[:, -10]
    found, computed = mtree.units_to_search(q, least.astype(float), trees[6], top)
    units = [n for n in kept if n.unit == n.node]
    for i, own in enumerate(found):
        near = {names[6][u] for u in own}
        assert {unit_of[j] for j in np.flatnonzero(scores[i] >= least[i])} <= near
    assert sum(map(len, found)) < 0.5 * len(q) * len(units) and computed < len(q) * len(trees[6])


@pytest.mark.parametrize("weights", [{"big": 0.91} | {f"s{i}": 0.01 for i in range(9)}, {f"s{i:03d}": 1.0 + i % 7 for i in range(300)}])
def test_mixing_keeps_exact_weights_over_many_periods(spark, weights):
    total = sum(weights.values())
    sizes = {s: int(24_000 * w / total) for s, w in weights.items()}
    docs = spark.createDataFrame([(i, s) for s, n in sizes.items() for i in range(n)], "doc_id long, source string")
    done = dict.fromkeys(weights, 0)
    rows = sorted(mixing.mix_sources(docs, weights, block=1).collect(), key=lambda r: r.mix_slot)
    assert len(rows) == sum(sizes.values())
    for n, r in enumerate(rows, 1):
        assert r.mix_slot == n - 1 and r.mix_release <= r.mix_slot < r.mix_deadline
        done[r.source] += 1
        if n % 97 == 0 or n > 23_000:
            assert all(abs(done[s] - n * w / total) < 1 for s, w in weights.items())
        if any(done[s] == sizes[s] for s in sizes):
            break
    assert n > 20_000


# --- pipeline -------------------------------------------------------------------------------


def test_stages_take_effect(spark, odd, sf):
    docs = odd.filter("doc_id is not null")
    near = corpus_pipeline.near_dedup(spark, docs, sf)
    components = brute_components([r for r in odd_texts() if r[0] is not None])
    assert sorted({r.doc_id for r in near.collect()}) == sorted({i for i, c in components.items() if i == c})
    cut = corpus_pipeline.substring_dedup(spark, docs, sf)
    assert all(r.n_chars == len(r.text) for r in cut.collect() if r.text is not None)
    mixed = corpus_pipeline.mixing(spark, docs, sf)
    assert mixed.columns == docs.columns and mixed.count() == docs.count()
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd.limit(0), sf).count() == 0
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, odd, sf).columns == odd.columns, name


def test_pipeline_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = quality.fit_quality(docs, spark.read.parquet(f"{sf}/labels.parquet"), langid.fold("doc_id", 5) != 0)
    rows = [(r.doc_id, r.text) for r in docs.collect() if model.score(r.text.encode()) >= 0.3]
    components = brute_components(rows)
    rows = [(i, t) for i, t in rows if components[i] == i]
    want = {r[0]: r[3] for r in brute_removed(rows)}
    cut = corpus_pipeline.substring_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), sf)
    texts = {r.doc_id: r.text for r in cut.collect()}
    assert {i: hashlib.sha256(b" ".join(t.encode().split())).hexdigest() for i, t in texts.items()} == want
    got = {r.doc_id: r.decoded_sha256 for r in corpus_pipeline.run(spark, sf).collect()}
    assert got == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in texts.items()}


def test_pipeline_rows_carry_the_order_of_the_mixture(spark, sf, tmp_path):
    docs = spark.createDataFrame([(i, f"text {i}", "big" if i % 4 else "small") for i in range(3_000)], "doc_id long, text string, source string")
    corpus_pipeline.mixing(spark, docs, sf).write.parquet(str(tmp_path / "mixed"))
    want = [r.doc_id for r in mixing.mix_sources(docs).sort("mix_slot", "mix_block", "doc_id").collect()]
    assert want != sorted(want)
    # files of very different sizes, which Spark would read in another order
    rows = spark.createDataFrame([(k, i) for k, i in enumerate(want)], "place long, doc_id long").join(docs, "doc_id")
    sized = rows.repartitionByRange(5, F.expr("int(sqrt(place))")).sortWithinPartitions("place").drop("place")
    sized.write.parquet(str(tmp_path / "sized"))
    for name in ("mixed", "sized"):
        found = corpus_pipeline.bpe(spark, spark.read.parquet(str(tmp_path / name)), sf).collect()
        assert [r.doc_id for r in sorted(found, key=lambda r: r.place)] == want, name
        assert sorted(r.place for r in found) == list(range(len(want)))


def test_pipeline_result_follows_the_weights(spark, sf, monkeypatch):
    sources = sorted(r.source for r in spark.read.parquet(f"{sf}/documents.parquet").select("source").distinct().collect())
    weights = {s: 2.0**k for k, s in enumerate(sources)}
    mix = lambda docs: mixing.mix_sources(docs, weights, block=2)
    monkeypatch.setattr(corpus_pipeline, "mix_sources", mix)
    got = [r.doc_id for r in sorted(corpus_pipeline.run(spark, sf).collect(), key=lambda r: r.place)]
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source").filter(F.col("doc_id").isin(got))
    order = lambda df: [r.doc_id for r in df.sort("mix_slot", "mix_block", "doc_id").collect()]
    assert got == order(mix(docs)) != order(mixing.mix_sources(docs))


def test_pipeline_keeps_columns_of_any_name(spark, sf, tmp_path):
    """Columns named like those that the stages work with keep their values, and the place still follows the mixture."""
    names = ["_file", "_row", "_start", "_metadata", "mix_slot", "mix_block", "mix_release", "mix_deadline", "place", "file", "row", "start", "n", "s", "k", "h", "m", "at", "block", "part", "round", "own", "dotted.name"]
    more = [F.lit(77 + k).alias(c) for k, c in enumerate(names)]
    docs = spark.createDataFrame([(i, f"text {i} " + prose(i, 8), "big" if i % 4 else None) for i in range(700)], "doc_id long, text string, source string").select("*", *more)
    docs.write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    for stage in (corpus_pipeline.near_dedup, corpus_pipeline.substring_dedup, corpus_pipeline.mixing):
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns
        assert [tuple(r) for r in out.select(*[f"`{c}`" for c in names]).distinct().collect()] == [tuple(range(77, 77 + len(names)))]
    corpus_pipeline.mixing(spark, docs, sf).write.parquet(str(tmp_path / "mixed"))
    found = corpus_pipeline.bpe(spark, spark.read.parquet(str(tmp_path / "mixed")), sf).collect()
    want = [r.doc_id for r in mixing.mix_sources(docs.select("doc_id", "source")).sort("mix_slot", "mix_block", "doc_id").collect()]
    assert [r.doc_id for r in sorted(found, key=lambda r: r.place)] == want


def test_place_follows_the_numbers_of_files(spark, tmp_path):
    """part-100000 comes after part-99999, though its name sorts before it."""
    for k, number in enumerate(["00007", "99999", "100000"]):
        spark.createDataFrame([(k, "x")], "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / number))
        (made,) = (tmp_path / number).glob("part-*.parquet")
        (tmp_path / "all").mkdir(exist_ok=True)
        made.rename(tmp_path / "all" / made.name.replace("part-00000", f"part-{number}"))
    rows = corpus_pipeline.with_place(spark.read.parquet(str(tmp_path / "all"))).collect()
    assert [r.place for r in sorted(rows, key=lambda r: r.doc_id)] == [0, 1, 2]
