"""Repair of conversations' structure by dynamic programming over a grammar of their role and fault sequences.

A row is one symbol: its role's initial and its fault. A conversation's symbols, cut into segments,
are compressed by Re-Pair: the most frequent adjacent pair becomes a rule until none occurs twice.
Every symbol has a min-plus matrix over the states of what was written so far (nothing, system,
user, assistant) with the cheapest edits' audit as a rope in each entry; a rule's matrix is the
product of its two. Matrices are made bottom-up, once a rule, and equal segments, of whatever
conversation, are solved once. Of audits of equal cost the least in ASCII stays; an audit of given
rows ends in a row's letter and has one letter a row besides insertions, so none is another's
beginning, and the least of a whole is made of the least of its parts.

Order within a conversation: turn (nulls first), role, SHA-256 of the text.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import BROADCAST_BYTES
from plumbline.session import Workspace

#: Rows of a segment at most.
SEGMENT = 512
#: Symbols that one grammar compresses at most (or one segment).
BLOCK = 200_000
#: Cost of each edit; a truncated row that stays adds TRUNCATED.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
#: Insertions that end a conversation well, by the state that it is in.
ENDING = {NOTHING: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}
#: Symbols: initials (x: any other) of whole rows, in capitals of truncated ones, and what has to go.
SYMBOLS = "suaxSUAXd"
_NAMES = {USER: "user", ASSISTANT: "assistant"}

Rope = str | tuple
Matrix = dict[tuple[int, int], tuple[int, Rope]]


def flat(rope: Rope) -> str:
    """The text of a rope."""
    out, left = [], [rope]
    while left:
        x = left.pop()
        if isinstance(x, str):
            out.append(x)
        else:
            left += [x[1], x[0]]
    return "".join(out)


def _put(matrix: Matrix, at: tuple[int, int], cost: int, rope: Rope) -> None:
    old = matrix.get(at)
    if old is None or cost < old[0] or (cost == old[0] and flat(rope) < flat(old[1])):
        matrix[at] = (cost, rope)


def _after(state: int) -> int:
    """The only state that a user's or an assistant's turn leads to."""
    return ASSISTANT if state == USER else USER


def terminal(symbol: str) -> Matrix:
    """Costs and audits of one row's edits, from state to state. Insertions stand before the row that needs them."""
    out: Matrix = {}
    for state in range(4):
        _put(out, (state, state), DELETE, "D")
        if symbol == "d":
            continue
        more = TRUNCATED if symbol.isupper() else 0
        for before, cost, letters in ((state, 0, ""), (_after(state), INSERT, "I")):
            to = _after(before)
            _put(out, (state, to), cost + more + REROLE, letters + "R")
            if _NAMES[to][0] == symbol.lower():
                _put(out, (state, to), cost + more + KEEP, letters + "K")
        if symbol.lower() == "s" and state == NOTHING:
            _put(out, (state, SYSTEM), more + KEEP, "K")
    return out


def product(x: Matrix, y: Matrix) -> Matrix:
    """Min-plus product; the rope of a sum is the pair of ropes."""
    out: Matrix = {}
    for (s, m), (cost, rope) in x.items():
        for t in range(4):
            if (m, t) in y:
                more, tail = y[m, t]
                _put(out, (s, t), cost + more, (rope, tail))
    return out


def re_pair(sequences: list[list[int]], first: int) -> tuple[list[tuple[int, int]], list[list[int]]]:
    """Rules (pairs of symbols; rule k makes symbol first + k) and the sequences rewritten with them: no pair occurs twice.

    The most frequent pair is replaced first (ties: the least pair). Pairs are counted within sequences.
    """
    sym: list[int] = [-1]
    for seq in sequences:
        sym += [*seq, -1]
    nxt, prv = list(range(1, len(sym) + 1)), list(range(-1, len(sym) - 1))
    places: dict[tuple[int, int], list[int]] = {}
    for i in range(len(sym) - 1):
        if sym[i] >= 0 and sym[i + 1] >= 0:
            places.setdefault((sym[i], sym[i + 1]), []).append(i)
    heap = [(-len(at), pair) for pair, at in places.items() if len(at) > 1]
    heapq.heapify(heap)
    rules: list[tuple[int, int]] = []
    while heap:
        claimed, pair = heapq.heappop(heap)
        a, b = pair
        valid = [i for i in sorted(set(places.get(pair, ()))) if sym[i] == a and sym[nxt[i]] == b]
        live, taken = [], -1
        for i in valid:
            if i != taken:  # of overlapping pairs every other one
                live.append(i)
                taken = nxt[i]
        if len(live) < -claimed:
            places[pair] = valid
            if len(live) > 1:
                heapq.heappush(heap, (-len(live), pair))
            continue
        new = first + len(rules)
        rules.append(pair)
        del places[pair]
        fresh: dict[tuple[int, int], None] = {}
        for i in live:
            j = nxt[i]
            sym[i], sym[j] = new, -2
            nxt[i] = nxt[j]
            prv[nxt[i]] = i
            for at in (prv[i], i):
                made = (sym[at], sym[nxt[at]])
                if min(made) >= 0:
                    places.setdefault(made, []).append(at)
                    fresh[made] = None
        for made in fresh:
            if len(places[made]) > 1:
                heapq.heappush(heap, (-len(places[made]), made))
    out, i = [], 0
    for seq in sequences:
        row, i = [], nxt[i]
        while sym[i] != -1:
            row.append(sym[i])
            i = nxt[i]
        out.append(row)
    return rules, out


_TERMINALS = [terminal(s) for s in SYMBOLS]


def solve(texts: list[str]) -> list[Matrix]:
    """The transfer matrix of every sequence of SYMBOLS (not empty), through one grammar of them all."""
    rules, rewritten = re_pair([[SYMBOLS.index(c) for c in t] for t in texts], len(SYMBOLS))
    matrices = list(_TERMINALS)
    for left, right in rules:
        matrices.append(product(matrices[left], matrices[right]))
    out = []
    for seq in rewritten:
        whole = matrices[seq[0]]
        for k in seq[1:]:
            whole = product(whole, matrices[k])
        out.append(whole)
    return out


_ENTRIES_SQL = "array<struct<s:int,t:int,cost:long,audit:string>>"
_ENTRIES = pa.list_(pa.struct([("s", pa.int32()), ("t", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))


def _solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(seq, entries): each distinct sequence's matrix, a grammar for BLOCK symbols."""

    def done(texts: list[str]) -> pa.RecordBatch:
        rows = [[{"s": s, "t": t, "cost": cost, "audit": flat(rope)} for (s, t), (cost, rope) in sorted(m.items())] for m in solve(texts)]
        return pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), pa.array(rows, _ENTRIES)], ["seq", "entries"])

    texts, size = [], 0
    for batch in batches:
        for text in batch.column("seq").to_pylist():
            texts.append(text)
            size += len(text)
            if size >= BLOCK:
                yield done(texts)
                texts, size = [], 0
    if texts:
        yield done(texts)


_END = [INSERT * len(ENDING[s]) for s in range(4)]


def _rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each segment's rest: the least cost of all that comes after it, by the state it ends in. Segments come last one first."""
    conv: object = object()
    for batch in batches:
        rests = []
        for name, entries in zip(batch.column("conv_id").to_pylist(), batch.column("entries").to_pylist(), strict=True):
            if name != conv:
                conv, rest = name, _END
            rests.append(rest)
            rest = [min(e["cost"] + rest[e["t"]] for e in entries if e["s"] == s) for s in range(4)]
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("conv_id", "first", "entries")], pa.array(rests, pa.list_(pa.int64()))], ["conv_id", "first", "entries", "rest"])


def _edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows with their edits. A conversation streams in order: before a segment's first row its matrix, before a row its fault."""
    names = ["conv_id", "place", "turn", "role", "text", "fault", "edit", "new_role"]
    conv: object = object()
    kind = pa.int64()
    state, through, place, letters, fault = NOTHING, NOTHING, 0, iter(""), None
    out: list[tuple] = []

    def insert() -> None:
        nonlocal state, place
        state = _after(state)
        out.append((conv, place, None, None, "", None, "I", _NAMES[state]))
        place += 1

    def written() -> Iterator[pa.RecordBatch]:
        nonlocal out
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), [kind, pa.int64(), pa.int64(), *[pa.string()] * 5], strict=True)], names)
            out = []

    for batch in batches:
        kind = batch.schema.field("conv_id").type
        columns = [batch.column(c).to_pylist() for c in ("conv_id", "kind", "turn", "role", "text", "fault", "entries", "rest")]
        for name, what, turn, role, text, found, entries, rest in zip(*columns, strict=True):
            if name != conv:
                for _ in ENDING[state]:
                    insert()
                conv, state, through, place = name, NOTHING, NOTHING, 0
            if what == 0:
                _, audit, through = min((e["cost"] + rest[e["t"]], e["audit"], e["t"]) for e in entries if e["s"] == through)
                letters = iter(audit)
            elif what == 1:
                fault = found
            else:
                letter = next(letters)
                while letter == "I":
                    insert()
                    letter = next(letters)
                new = None
                if letter == "K":
                    new, state = role, "?sua".index(role[:1])
                elif letter == "R":
                    state = _after(state)
                    new = _NAMES[state]
                out.append((conv, place, turn, role, text, fault, letter, new))
                place += 1
        yield from written()
    for _ in ENDING[state]:
        insert()
    yield from written()


_COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row a conversation from its edited rows in order, which stream by."""
    legal, price = {"su", "ua", "au"}, {"K": KEEP, "R": REROLE, "D": DELETE, "I": INSERT}
    conv, n, kind, out = None, None, pa.int64(), []

    def close() -> None:
        if n is not None:
            n["gaps"] = last - low + 1 - turns if turns else 0
            out.append((conv, *[n[c] for c in _COUNTS], "".join(audit), sha.hexdigest()))

    def written() -> Iterator[pa.RecordBatch]:
        nonlocal out
        if out:
            kinds = [kind, *[pa.int64()] * len(_COUNTS), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], ["conv_id", *_COUNTS, "audit", "repaired_sha256"])
            out = []

    for batch in batches:
        kind = batch.schema.field("conv_id").type
        columns = [batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "fault", "edit", "new_role")]
        for name, turn, role, text, fault, edit, new_role in zip(*columns, strict=True):
            if n is None or name != conv:
                close()
                conv, n, audit, sha, begun = name, dict.fromkeys(_COUNTS, 0), [], hashlib.sha256(), False
                low = last = initial = None
                turns = 0
            audit.append(edit)
            if edit != "I":
                if fault:
                    n[fault] += 1
                if turn is not None and turn != last:
                    low, last, turns = turn if low is None else low, turn, turns + 1
                n["illegal"] += initial is not None and initial + role[:1] not in legal
                initial = role[:1]
            n["cost"] += price[edit] + (TRUNCATED if fault == "truncated" and edit != "D" else 0)
            if edit != "D":
                sha.update((("\n" if begun else "") + f"{new_role}:{text}").encode())
                begun = True
        yield from written()
    close()
    yield from written()


def _symbol() -> Column:
    """A row's symbol from its role and fault."""
    initial = F.lower(F.when(F.substring("role", 1, 1).isin("s", "u", "a"), F.substring("role", 1, 1)).otherwise("x"))
    return F.when(F.col("fault").isin("blank", "duplicate"), "d").when(F.col("fault") == "truncated", F.upper(initial)).otherwise(initial)


def edited_conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, place, turn, role, text, fault, edit, new_role): every row in order with its cheapest edit, and what is inserted.

    ``edit`` is K (keep), R (new role), D (delete) or I (insert an empty text), ``place`` counts a
    conversation's edits. What isn't deleted has ``new_role`` and makes roles system? (user assistant)+,
    or nothing. A row's fault is its first of blank, duplicate (role and text seen earlier in the
    conversation) and truncated (the last character is none of ``.!?``).

    Null roles and texts are one blank, null turns come first, null ids make one conversation. Very long texts pass through;
    memory is bounded by batches. Repeated rows are duplicates. Rows that tie in turn, role and text are alike. An
    empty table gives no rows. Other columns, whatever their names, are ignored. A conversation's rows stream through one task in order,
    its matrices are made in segments all over the cluster.
    """
    spark = turns.sparkSession
    ws = Workspace(spark, "repair")
    blank = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    rows = turns.select(F.col(f"`{conv_col}`").alias("conv_id"), F.col(f"`{turn_col}`").cast("long").alias("turn"), blank(role_col).alias("role"), blank(text_col).alias("text"))
    rows = rows.withColumns({"digest": F.sha2("text", 256), "m": F.monotonically_increasing_id()})
    order = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), F.asc("role"), F.asc("digest"), F.asc("m")]
    # ranges of rows: a conversation of any length is many ranges
    rows = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    rows = ws.save(rows.select("conv_id", "turn", "role", "text", "digest", F.monotonically_increasing_id().alias("at")), "rows")
    end = F.right(F.rtrim("text", F.lit(" \t\n\x0b\x0c\r")), F.lit(1))
    judged = rows.select("conv_id", "turn", "role", "text", "digest", "at", (~F.col("text").rlike(r"[^\x20\x09-\x0D]")).alias("blank"), (~end.isin(".", "!", "?")).alias("cut"))
    firsts = judged.filter(~F.col("blank")).groupBy("conv_id", "role", "digest").agg(F.min("at").alias("seen"))
    firsts = ws.save(firsts.select("seen"), "firsts")
    fault = F.when(F.col("blank"), "blank").when(F.col("seen").isNull(), "duplicate").when(F.col("cut"), "truncated")
    faults = judged.select("conv_id", "role", "at", "blank", "cut").join(firsts, F.col("at") == F.col("seen"), "left")
    faults = ws.save(faults.select("conv_id", "role", "at", fault.alias("fault")).select("conv_id", "at", "fault", _symbol().alias("symbol")), "faults")

    low = F.col("at").bitwiseAND((1 << 33) - 1)  # a row's number in its range
    segments = faults.groupBy("conv_id", F.shiftright("at", 33).alias("range"), F.floor(low / SEGMENT).alias("part"))
    segments = segments.agg(F.min("at").alias("first"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "symbol"))), lambda x: x["symbol"]), "").alias("seq"))
    segments = ws.save(segments.select("conv_id", "first", "seq"), "segments")
    solved = ws.save(segments.select("seq").distinct().mapInArrow(_solved, f"seq string, entries {_ENTRIES_SQL}"), "solved")
    held = solved.agg(F.count("*") * 1_000 + F.sum(F.length("seq")) * 20).first()[0] or 0
    segments = ws.save(segments.join(F.broadcast(solved) if held <= BROADCAST_BYTES else solved, "seq").select("conv_id", "first", "entries"), "matrices")
    kind = segments.schema["conv_id"].dataType.simpleString()
    back = segments.repartition("conv_id").sortWithinPartitions("conv_id", F.desc("first"))
    segments = ws.save(back.mapInArrow(_rest, f"conv_id {kind}, first long, entries {_ENTRIES_SQL}, rest array<long>"), "rests")

    parts = [
        segments.select("conv_id", F.col("first").alias("at"), F.lit(0).alias("kind"), "entries", "rest"),
        faults.select("conv_id", "at", F.lit(1).alias("kind"), "fault"),
        rows.select("conv_id", "at", F.lit(2).alias("kind"), "turn", "role", "text"),
    ]
    whole = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), parts)
    whole = whole.repartition("conv_id").sortWithinPartitions("conv_id", "at", "kind")
    return whole.mapInArrow(_edit, f"conv_id {kind}, place long, turn long, role string, text string, fault string, edit string, new_role string")


def repair_digests(turns: DataFrame, conversations: DataFrame | None = None, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256), a row per conversation.

    ``gaps`` counts the turn numbers that lack between the least and the greatest, ``illegal`` the
    neighbours whose role initials are none of su, ua and au; ``audit`` has the edits' letters, and the
    digest is of the repaired lines ``role:text``. Conversations of the table ``conversations`` (conv_id)
    that have no rows get zeros, an empty audit and the digest of the empty string. Edges as in
    ``edited_conversations``; an audit is one value, of a letter a row.
    """
    edited = edited_conversations(turns, conv_col, turn_col, role_col, text_col)
    kind = edited.schema["conv_id"].dataType.simpleString()
    # the rows stay as they are dealt and ordered
    found = edited.mapInArrow(_digest, f"conv_id {kind}, {', '.join(f'{c} long' for c in _COUNTS)}, audit string, repaired_sha256 string")
    if conversations is None:
        return found
    every = conversations.select(F.col(f"`{conv_col}`").alias("c")).distinct()
    found = every.join(found, F.col("c").eqNullSafe(F.col("conv_id")), "left")
    empty = {"audit": "", "repaired_sha256": hashlib.sha256(b"").hexdigest()}
    return found.select(F.col("c").alias("conv_id"), *[F.coalesce(c, F.lit(0)).alias(c) for c in _COUNTS], *[F.coalesce(c, F.lit(x)).alias(c) for c, x in empty.items()])


def damaged(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) of conversations that are damaged by the CRC-32 of ``conv_id:turn``; nulls are one blank there.

    Modulo 20: 0 drops the row, 1 empties its text, 2 takes its ``.!?`` out, 3 repeats it, 4 makes its role user.
    """
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = turns.select("conv_id", "turn", name("role").alias("role"), name("text").alias("text"), (F.crc32(F.concat(name("conv_id"), F.lit(":"), name("turn"))) % 20).alias("k")).filter("k <> 0")
    text = F.when(F.col("k") == 1, "").when(F.col("k") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("k") == 4, "user").otherwise(F.col("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.when(F.col("k") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")).drop("copy")
