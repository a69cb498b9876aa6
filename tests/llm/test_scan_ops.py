"""License scans, periodic runs and conversation repair against brute force, SQL and literal rows."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from conftest import same_rows
from pyspark.sql import functions as F

from plumbline.llm import licenses, periods, repair
from plumbline.llm.queries import oracle_sql, queries

EXTRA = "doc_id long, text string, n_words string, word string, df string, start string, period string"


def with_clashes(spark, rows):
    return spark.createDataFrame([(i, t, "a", "b", "c", "d", "e") for i, t in rows], EXTRA).repartition(3)


@pytest.mark.parametrize("name", ["op11_licenses", "op13_conversation_repair"])
def test_sql_for_what_sql_can_express(spark, sf, duck, name):
    same_rows(queries()[name](spark, sf), duck, oracle_sql()[name])


# --- op11 -----------------------------------------------------------------------------------


def license_words(text: str | None) -> list[str]:
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def brute_licenses(rows, templates=licenses.TEMPLATES, base=licenses.BASE) -> list[tuple]:
    """Every alignment of every template, every place of every phrase."""
    docs = [(i, license_words(t)) for i, t in rows]
    df: dict[str, int] = {}
    for _, words in docs:
        for w in set(words):
            df[w] = df.get(w, 0) + 1
    weigh = lambda w: max(1, round(1000 * math.log(1 + len(docs) / (1 + df.get(w, 0)))))
    out = []
    for i, words in docs:
        places = lambda p, words=words: [k for k in range(len(words) - len(p.split()) + 1) if words[k : k + len(p.split())] == p.split()]
        starts = sorted(k for p in base for k in places(p))
        base_labels = {label for p, label in base.items() if places(p)}
        own, score = set(), 1.0 if starts else 0.0
        for t in templates:
            text = t.text.split()
            total = sum(map(weigh, text))
            for d in range(-len(text) - 2, len(words) + 3):
                at = lambda k, words=words: words[k] if 0 <= k < len(words) else None
                share = sum(weigh(w) for q, w in enumerate(text) if w in {at(d + q + e) for e in range(-licenses.SLACK, licenses.SLACK + 1)})
                if 100 * share >= licenses.SHARE * total and all(any(k >= d - licenses.SLACK and k + len(p.split()) <= d + len(text) + licenses.SLACK for k in places(p)) for p in t.must):
                    own.add(t.label)
                    score = max(score, share / total)
        out.append((i, len(words), len(starts), starts[0] if starts else None, starts[-1] if starts else None, ",".join(sorted(base_labels)), ",".join(sorted(base_labels | own)), round(score, 9)))
    return sorted(out, key=str)


def license_rows() -> list[tuple[int | None, str | None]]:
    rng = random.Random(2)
    filler = lambda n: " ".join(rng.choice(["lorem", "ipsum", "the", "of", "license", "under", "software", "é漢"]) for _ in range(n))
    rows: list[tuple[int | None, str | None]] = [(1, None), (2, ""), (3, "..."), (None, "MIT License"), (None, None), (4, "MIT\nLicense. mit-license mit licensed"), (4, "MIT\nLicense. mit-license mit licensed")]
    rows += [(5, "Licensed under CC BY-NC 4.0."), (6, "under the GNU General Public Licence, GNU General"), (7, "x" * 70_000 + " apache license"), (8, "license " * 3_000), (9, "cc"), (10, "by cc by")]
    rows.append((11, filler(40_000) + " Licensed under the Apache License, Version 2.0. " + filler(40_000)))
    rows += [(100 + k, f"{filler(9)}. {t.text.capitalize()}!") for k, t in enumerate(licenses.TEMPLATES)]
    for k in range(60):
        words = rng.choice(licenses.TEMPLATES).text.split()
        for _ in range(rng.randrange(4)):  # words lost, added and changed
            at = rng.randrange(len(words))
            words[at : at + rng.randrange(2)] = [rng.choice(["the", "our", "x1"])] * rng.randrange(3)
        rows.append((20 + k, filler(rng.randrange(30)) + ", " + rng.choice([" ", "-", "\n"]).join(words).title() + " " + filler(rng.randrange(30))))
    return rows


def test_licenses_against_brute_force(spark):
    rows = [r for r in license_rows() if r[0] != 11]
    got = [(*r[:7], round(r.score, 9)) for r in licenses.scan_licenses(with_clashes(spark, rows)).collect()]
    want = brute_licenses(rows)
    assert sorted(got, key=str) == want
    assert {t.label for t in licenses.TEMPLATES} <= {x for r in want for x in r[6].split(",")}
    assert any(0.75 <= r[7] < 1 for r in want)


def test_licenses_in_long_texts_and_empty_tables(spark):
    rows = [r for r in license_rows() if r[0] in (7, 11)]
    got = {r.doc_id: r for r in licenses.scan_licenses(with_clashes(spark, rows)).collect()}
    assert (got[7].n_words, got[7].n_base, got[7].first_word, got[7].labels) == (3, 1, 1, "apache")
    assert got[11].first_word == 40_003 and got[11].labels == "apache,apache-2.0" and got[11].score == 1.0
    assert licenses.scan_licenses(with_clashes(spark, rows).limit(0)).count() == 0


def test_a_template_of_the_caller(spark):
    mine = (licenses.Template("house", "internal use only by order of the board", ("internal use",)),)
    got = licenses.scan_licenses(with_clashes(spark, [(1, "For INTERNAL use only, by order of the Board!"), (2, "use only by order of the board")]), mine, {}).collect()
    assert {r.doc_id: (r.labels, r.n_base) for r in got} == {1: ("house", 0), 2: ("", 0)}


def test_every_match_holds_one_of_the_rarest_words():
    words = licenses.vocabulary(licenses.TEMPLATES, licenses.BASE)
    rng = random.Random(4)
    index = licenses.LicenseIndex({w: rng.randrange(1, 9_000) for w in words})
    for _, ids, weight, rarest, _ in index.templates:
        assert 100 * (weight.sum() - weight[rarest].sum()) < licenses.SHARE * weight.sum()
        assert len(rarest) < len(ids)


# --- op12 -----------------------------------------------------------------------------------


def brute_runs(words: list, least: int = 6, times: int = 4) -> list[tuple[int, int, int]]:
    found: dict[tuple[int, int], int] = {}
    for q in range(1, len(words) // times + 1):
        x = 0
        while x + q < len(words):
            start = x
            while x + q < len(words) and words[x] == words[x + q]:
                x += 1
            if x + q - start >= max(least, times * q):
                found.setdefault((start, x + q - start), q)
            x += x == start
    return sorted((s, n, q) for (s, n), q in found.items())


def brute_row(i: int | None, text: str | None, plant: bool) -> tuple:
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
    n = len(words)
    if plant and n and i is not None and zlib.crc32(str(i).encode()) % 10 == 0:
        g = zlib.crc32(str(i).encode()) // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[k] if k < a else words[a + (k - a) % p] for k in range(n)]
    runs = brute_runs(words)
    gone = {k for s, m, q in runs for k in range(s + q, s + m)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else None
    kept = b" ".join(w for k, w in enumerate(words) if k not in gone)
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (i, len(runs), *top, hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def periodic_rows() -> list[tuple[int | None, str | None]]:
    rng = random.Random(6)
    rows: list[tuple[int | None, str | None]] = [(1, None), (2, ""), (3, " \n\x0b"), (4, "a"), (5, "a a a a a"), (6, "a a a a a a"), (6, "a a a a a a"), (None, "x y " * 5), (None, None), (7, "é\té\né\x0cé é é 漢"), (8, "w" * 90_000 + " v v v v v v")]
    rows.append((9, " ".join(f"w{k % 700}" for k in range(30_000))))
    for k in range(300):
        words: list[str] = []
        for _ in range(rng.randrange(1, 6)):
            root = [f"r{rng.randrange(rng.choice([2, 4, 100]))}" for _ in range(rng.randrange(1, 12))]
            words += (root * 9)[: rng.randrange(1, 9 * len(root))]
            words += [f"u{rng.randrange(3)}" for _ in range(rng.randrange(9))]
        rows.append((100 + k, rng.choice([" ", "\n", "  "]).join(words)))
    return rows


def test_runs_against_brute_force(spark):
    rows = periodic_rows()
    small = [r for r in rows if r[0] != 9]
    docs = with_clashes(spark, small)
    for plant in (False, True):
        text = periods.planted(F.col("doc_id"), F.col("text")) if plant else F.col("text")
        got = sorted((tuple(r) for r in periods.run_digests(docs.withColumn("text", text)).collect()), key=str)
        assert got == sorted((brute_row(i, t, plant) for i, t in small), key=str)
    listed = sorted(((r.doc_id, r.start, r.length, r.period) for r in periods.periodic_runs(docs).collect()), key=str)
    assert listed == sorted(((i, *run) for i, t in small for run in brute_runs(re.findall(r"[^\x20\x09-\x0D]+", t or ""))), key=str)
    texts = {r.doc_id: r.text for r in periods.collapse_runs(docs).filter("doc_id < 9").collect()}
    assert texts == {1: "", 2: "", 3: "", 4: "a", 5: "a a a a a", 6: "a", 7: "é 漢", 8: "w" * 90_000 + " v"}


def test_runs_of_long_texts_and_empty_tables(spark):
    (row,) = periods.run_digests(with_clashes(spark, [r for r in periodic_rows() if r[0] == 9])).collect()
    assert (row.n_runs, row.start, row.length, row.period, row.exponent_milli) == (1, 0, 30_000, 700, 42_857)
    empty = with_clashes(spark, periodic_rows()).limit(0)
    assert periods.run_digests(empty).count() == periods.periodic_runs(empty).count() == periods.collapse_runs(empty).count() == 0


def test_runs_query_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = sorted(map(tuple, queries()["op12_periodic_runs"](spark, sf).collect()))
    small = {r.doc_id for r in docs if len(r.text or "") < 20_000}
    assert [r for r in got if r[0] in small] == sorted(brute_row(r.doc_id, r.text, True) for r in docs if r.doc_id in small)
    assert len(got) == len(docs) and sum(r[1] for r in got) > 10


def test_other_thresholds_of_runs():
    rng = random.Random(9)
    for least, times in ((2, 4), (6, 4), (9, 5), (1, 7)):
        for _ in range(60):
            words = [rng.randrange(2) for _ in range(rng.randrange(60))]
            row, *runs = periods.runs_of(np.array(words, np.int64), np.array([0, len(words)]), least, times)
            assert list(zip(*[x.tolist() for x in runs], strict=True)) == brute_runs(words, least, times)


# --- op13 -----------------------------------------------------------------------------------


def damage(rows: list[tuple]) -> list[tuple]:
    out = []
    for c, t, r, x in rows:
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = " " if r is None else r, " " if x is None else x
        x = "" if k == 1 else re.sub("[.!?]", "", x) if k == 2 else x
        out += [(c, t, "user" if k == 4 else r, x)] * (0 if k == 0 else 2 if k == 3 else 1)
    return out


def brute_repair(rows: list[tuple], every: set) -> list[tuple]:
    """Every state after every row by the cheapest edits, with all insertions tried; audits compared as wholes."""
    out = []
    for c in every:
        turns = sorted((r for r in rows if r[0] == c), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or " ", hashlib.sha256((r[3] or " ").encode()).hexdigest()))
        turns = [(t, " " if r is None else r, " " if x is None else x) for _, t, r, x in turns]
        seen, faults, counts = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0, None: 0}
        for _, r, x in turns:
            body = x.strip(" \t\n\x0b\x0c\r")
            faults.append("blank" if not body else "duplicate" if (r, x) in seen else "truncated" if body[-1] not in ".!?" else None)
            seen.add((r, x))
            counts[faults[-1]] += 1
        best = {"n": (0, "", ())}

        def inserted(b: dict) -> dict:
            b = dict(b)
            for _ in range(3):
                for s, (k, a, lines) in list(b.items()):
                    to = "a" if s == "u" else "u"
                    new = (k + 2, a + "I", (*lines, ("assistant:" if to == "a" else "user:")))
                    if to not in b or new[:2] < b[to][:2]:
                        b[to] = new
            return b

        for (_, r, x), fault in zip(turns, faults, strict=True):
            after: dict[str, tuple] = {}
            for s, (k, a, lines) in inserted(best).items():
                to = "a" if s == "u" else "u"
                tried = [(s, (k + 3, a + "D", lines))]
                if fault not in ("blank", "duplicate"):
                    k += fault == "truncated"
                    tried.append((to, (k + 2, a + "R", (*lines, ("assistant:" if to == "a" else "user:") + x))))
                    if r[:1] == to or (r[:1] == "s" and s == "n"):
                        tried.append((r[:1], (k, a + "K", (*lines, f"{r}:{x}"))))
                for state, new in tried:
                    if state not in after or new[:2] < after[state][:2]:
                        after[state] = new
            best = after
        cost, audit, lines = min(v for s, v in inserted(best).items() if s in "na")
        known = {t for t, _, _ in turns if t is not None}
        gaps = max(known) - min(known) + 1 - len(known) if known else 0
        illegal = sum(x[1][:1] + y[1][:1] not in ("su", "ua", "au") for x, y in zip(turns, turns[1:], strict=False))
        out.append((c, gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


def odd_conversations() -> list[tuple]:
    rng = random.Random(13)
    rows: list[tuple] = [(None, None, None, None), (None, 1, "user", "Hi."), (None, 1, "user", "Hi."), (1, 0, "user", ""), (2, 5, "", "x."), (2, 5, "", "x."), (2, None, "tool", "y"), (3, 10**12, "system", "s."), (4, 0, "système", "s."), (4, 1, "ugh", "q?"), (4, 2, "a", "\n ok! \t"), (5, 3, "assistant", "a" * 100_000 + ".")]
    for c in range(10, 80):
        turn = 0
        for _ in range(rng.randrange(1, 14)):
            turn += rng.choice([1, 1, 1, 0, 2])
            rows.append((c, rng.choice([turn] * 9 + [None]), rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None]), rng.choice(["Yes.", "No!", "Well", " ", None, f"t{rng.randrange(99)}?", "é漢."])))
    return rows


CONVERSATIONS = "conv_id long, turn long, role string, text string, at string, kind string, seq string, fault string, c string"


@pytest.mark.parametrize("segment", [512, 3])
def test_repair_against_brute_force(spark, segment, monkeypatch):
    """Whole conversations in a segment, and many segments a conversation; with and without damage."""
    monkeypatch.setattr(repair, "SEGMENT", segment)
    rows = odd_conversations()
    turns = spark.createDataFrame([(*r, "a", "b", "c", "d", "e") for r in rows], CONVERSATIONS).repartition(3)
    every = {r[0] for r in rows}
    assert sorted((tuple(r) for r in repair.repair_digests(turns).collect()), key=str) == brute_repair(rows, every)
    got = sorted((tuple(r) for r in repair.repair_digests(repair.damaged(turns), turns).collect()), key=str)
    assert got == brute_repair(damage(rows), every)


def test_repaired_rows_are_legal(spark):
    rows = odd_conversations()
    edited = repair.edited_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    convs: dict = {}
    for r in sorted(edited.collect(), key=lambda r: (str(r.conv_id), r.place)):
        convs.setdefault(r.conv_id, []).append(r)
    assert sum(r.edit != "I" for rs in convs.values() for r in rs) == len(rows)
    for rs in convs.values():
        assert [r.place for r in rs] == list(range(len(rs)))
        assert re.fullmatch("(s?(ua)+)?", "".join(r.new_role[0] for r in rs if r.edit != "D"))
        assert all(r.new_role == r.role for r in rs if r.edit == "K")


def test_repair_of_an_empty_table(spark):
    turns = spark.createDataFrame(odd_conversations(), "conv_id long, turn long, role string, text string")
    assert repair.repair_digests(turns.limit(0)).count() == 0
    rows = repair.repair_digests(turns.limit(0), turns.select("conv_id")).collect()
    assert len(rows) == len({r[0] for r in odd_conversations()}) and {tuple(r[1:]) for r in rows} == {(0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_re_pair_leaves_no_pair_twice_and_keeps_the_texts():
    rng = random.Random(1)
    for _ in range(40):
        texts = [[rng.randrange(3) for _ in range(rng.randrange(1, 30))] for _ in range(rng.randrange(1, 20))]
        texts += [[0] * rng.randrange(1, 20)] * 2
        rules, out = repair.re_pair(texts, 3)

        def spelled(x: int, rules=rules) -> list[int]:
            return [x] if x < 3 else [y for z in rules[x - 3] for y in spelled(z)]

        assert [[y for x in seq for y in spelled(x)] for seq in out] == texts
        pairs: dict[tuple, int] = {}
        for seq in out:
            last = -1
            for i, pair in enumerate(zip(seq, seq[1:], strict=False)):
                if pair[0] != pair[1] or last != i - 1:  # of aaa one pair counts
                    pairs[pair] = pairs.get(pair, 0) + 1
                    last = i if pair[0] == pair[1] else last
        assert all(n == 1 for n in pairs.values())


def test_matrices_of_a_grammar_equal_those_of_rows():
    rng = random.Random(3)
    texts = ["".join(rng.choice("uaUAuasxSXd") for _ in range(rng.randrange(1, 40))) for _ in range(200)]
    for text, found in zip(texts, repair.solve(texts), strict=True):
        whole = repair.terminal(text[0])
        for symbol in text[1:]:
            whole = repair.product(whole, repair.terminal(symbol))
        assert {k: (c, repair.flat(r)) for k, (c, r) in found.items()} == {k: (c, repair.flat(r)) for k, (c, r) in whole.items()}


# --- op3's large regions --------------------------------------------------------------------


def test_pages_of_a_template_never_meet_and_near_copies_among_them_do(spark, monkeypatch):
    """Many pages that share 60 % of their shingles and link nothing: what is compared does not grow with their pairs."""
    from plumbline.llm import near_dedup
    from plumbline.session import Workspace

    rng = random.Random(21)
    template = [f"t{i}" for i in range(190)]
    pages = 3_000
    rows = [(i, " ".join(template + [f"u{i}x{k}" for k in range(62)])) for i in range(pages)]
    near = rows[7][1].split()
    near[rng.randrange(200, 250)] = "edited"
    rows.append((pages, " ".join(near)))
    met = []
    whole = near_dedup._meeting
    monkeypatch.setattr(near_dedup, "_meeting", lambda *a: met.append(whole(*a)) or met[-1])
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert got == {i: i for i in range(pages)} | {pages: 7}
    assert len(met) == 1 and met[0].count() <= 2 * pages // 100
    # the rarest shingles alone find a link that the trees and the components did not
    ws = Workspace(spark, "t")
    docs = spark.createDataFrame([rows[7], rows[8], rows[pages]], "doc_id long, text string")
    alone = ws.save(spark.createDataFrame([(i, i, 248) for i in (7, 8, pages)], "doc long, component long, n int"), "rows")
    assert sorted(map(tuple, whole(ws, docs, alone, 5, 75).collect())) == [(7, pages)]
