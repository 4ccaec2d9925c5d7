"""Repair of damaged conversations by weighted CYK parsing over intervals of turns.

A conversation should read ``(s?(ua)+)?`` in the initials of its roles.  The
repair grammar is in Chomsky normal form: its nonterminals are pairs of places
in that pattern, and X(p,q) derives any run of damaged turns whose edits lead
from place p to place q.

    X(p,q) -> X(p,r) X(r,q)      two spans side by side
    X(p,q) -> turn               keep, rerole or delete it
    X(p,q) -> X(p,r) insert      the insertion closure, on both sides

A cell of the chart has the least (cost, audit) of every nonterminal over a
span; charts are filled bottom-up by span length, over all splits.  A chart
covers at most ``SPAN`` items.  Longer conversations are cut into runs of
SPAN turns, whose topmost cells are the items of the next level's chart, and so
on; X(p,q) allows every split, so no parse is lost.  No task holds more than
SPAN items of a conversation, and the chart of each sequence of turn kinds is
kept in the worker for the next conversation like it.

Ties of cost go to the least audit.  Two audits of one span and one cost are
never prefixes of each other (the longer one would hold further insertions,
which cost), so the least audit of a span is made of least audits of its parts.

Defined results: a null conversation id is a conversation of its own; null
roles and texts are one space, null turns come first; equal turns are ordered
by role, then text; roles that begin with none of s, u and a can't be kept; a
conversation without turns has costs of 0, an empty audit and no repaired
turns; an empty table gives an empty result; further columns are ignored.
The digest of a conversation reads its repaired turns one after another, in one
task, batch by batch: SHA-256 has no other way.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scorewise.llm.common import staged, table
from scorewise.llm.turns import numbered

#: Items of one chart.
SPAN = 8
BLANKS = " \t\n\x0b\x0c\r"
#: Costs of the edits, and of a turn that stays although it is cut short.
REROLE, DELETE, INSERT, SHORT = 1, 2, 5, 5
#: Places of the pattern: nothing yet, after the system's turn, after a user's, after an assistant's.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
STEPS = {"s": [(NOTHING, SYSTEM)], "u": [(NOTHING, USER), (SYSTEM, USER), (ASSISTANT, USER)], "a": [(USER, ASSISTANT)]}
ROLE = {USER: "user", ASSISTANT: "assistant"}

Cell = dict[tuple[int, int], tuple[int, str]]


def _take(cell: Cell, at: tuple[int, int], found: tuple[int, str]) -> None:
    if at not in cell or found < cell[at]:
        cell[at] = found


def _join(left: Cell, right: Cell, into: Cell) -> None:
    for (p, r), (cost, audit) in left.items():
        for q in range(4):
            other = right.get((r, q))
            if other is not None:
                _take(into, (p, q), (cost + other[0], audit + other[1]))


@functools.cache
def insertions() -> Cell:
    """The insertion closure of the empty span."""
    cell: Cell = {(p, p): (0, "") for p in range(4)}
    step: Cell = {at: (INSERT, "I") for kind in "ua" for at in STEPS[kind]}
    for _ in range(4):  # a shortest way through the four places has three steps at most
        _join(dict(cell), step, cell)
    return cell


@functools.cache
def leaf(kind: str) -> Cell:
    """The cell of one turn: ``kind`` is its role's initial, upper case if it is cut short; x must be deleted, o is any other role."""
    cell: Cell = {(p, p): (DELETE, "D") for p in range(4)}
    if kind != "x":
        extra = SHORT if kind.isupper() else 0
        for role, steps in STEPS.items():
            for at in steps:
                if role == kind.lower():
                    _take(cell, at, (extra, "K"))
                if role != "s":
                    _take(cell, at, (extra + REROLE, "R"))
    closed: Cell = {}
    _join(insertions(), cell, closed)
    out: Cell = {}
    _join(closed, insertions(), out)
    return out


def chart(items: list[Cell]) -> Cell:
    """The topmost cell of the chart over ``items``: all spans by length, all splits."""
    n = len(items)
    cells = {(i, i + 1): items[i] for i in range(n)}
    for length in range(2, n + 1):
        for i in range(n - length + 1):
            cell: Cell = {}
            for k in range(i + 1, i + length):
                _join(cells[i, k], cells[k, i + length], cell)
            cells[i, i + length] = cell
    return cells[0, n]


#: Cells of spans of equal turn kinds, shared by all charts of a worker.
_KNOWN_SPANS = 200_000
_known: dict[str, Cell] = {}


def parsed(kinds: str) -> Cell:
    """As ``chart``, of turns; cells of spans seen before are taken from the worker's table."""
    n = len(kinds)
    if len(_known) > _KNOWN_SPANS:
        _known.clear()
    for length in range(1, n + 1):
        for i in range(n - length + 1):
            span = kinds[i : i + length]
            if span not in _known:
                cell: Cell = {} if length > 1 else leaf(span)
                for k in range(1, length):
                    _join(_known[span[:k]], _known[span[k:]], cell)
                _known[span] = cell
    return _known[kinds]


#: A cell as two lists of 16: place p * 4 + q has the cost and audit of X(p,q), null if there is none.
CELL = "costs array<long>, audits array<string>"


def _lists(cells: list[Cell]) -> list[pa.Array]:
    found = [[cell.get((p, q), (None, None)) for p in range(4) for q in range(4)] for cell in cells]
    return [pa.array([[x[k] for x in row] for row in found], kind) for k, kind in ((0, pa.list_(pa.int64())), (1, pa.list_(pa.string())))]


def _cell(costs: list, audits: list) -> Cell:
    return {(i >> 2, i & 3): (costs[i], audits[i]) for i in range(16) if costs[i] is not None}


def _leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, 1024):
            batch = whole.slice(at, 1024)
            cells = [parsed(k) for k in batch.column("kinds").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("run"), *_lists(cells)], ["conv_id", "run", "costs", "audits"])


def _levels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, 256):
            batch = whole.slice(at, 256)
            tops = [chart([_cell(x["costs"], x["audits"]) for x in row]) for row in batch.column("items").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("run"), *_lists(tops)], ["conv_id", "run", "costs", "audits"])


def cheapest(kinds: DataFrame, span: int = SPAN) -> DataFrame:
    """(conv_id, cost, audit) of the cheapest repair; ``kinds`` has conv_id, place (from 0) and kind of every turn."""
    last = kinds.agg(F.max("place")).first()[0]
    if last is None:
        last = 0
    run = (F.col("place") / F.lit(span)).cast("long")
    ordered = F.array_sort(F.collect_list(F.struct("place", "kind")))
    runs = kinds.groupBy("conv_id", run.alias("run")).agg(F.array_join(F.transform(ordered, lambda x: x["kind"]), "").alias("kinds"))
    schema = f"conv_id {dict(kinds.dtypes)['conv_id']}, run long, {CELL}"
    tops, count = runs.select("conv_id", "run", "kinds").mapInArrow(_leaves, schema), last // span + 1
    while count > 1:
        items = F.array_sort(F.collect_list(F.struct("run", "costs", "audits")))
        tops = tops.groupBy("conv_id", (F.col("run") / F.lit(span)).cast("long").alias("run")).agg(items.alias("items")).mapInArrow(_levels, schema)
        count = -(-count // span)
    # the whole conversation leads from the start of the pattern to its start or behind an assistant's turn
    best = F.least(*(F.struct(F.get("costs", F.lit(q)).alias("cost"), F.get("audits", F.lit(q)).alias("audit")) for q in (NOTHING, ASSISTANT)))
    return tops.select("conv_id", best.alias("best")).select("conv_id", "best.cost", "best.audit")


def faults(turns: DataFrame) -> DataFrame:
    """(conv_id, place, turn, kind, blank, duplicate, truncated, illegal) of every turn of ``turns`` (conv_id, place, turn, role, text)."""
    body = F.rtrim(F.col("text"), F.lit(BLANKS))
    initial = F.substring("role", 1, 1)
    own = turns.select("conv_id", "place", "turn", initial.alias("initial"), (body == "").alias("blank"), (~F.substring(body, -1, 1).isin(".", "!", "?")).alias("short"))
    before = turns.select("conv_id", (F.col("place") + 1).alias("place"), initial.alias("prior"))
    first = turns.groupBy("conv_id", "role", F.sha2(F.col("text").cast("binary"), 256)).agg(F.min("place").alias("place")).select("conv_id", "place", F.lit(True).alias("first"))
    # places are unique in a conversation, so this deals the turns of a long one to all tasks
    both = own.unionByName(before, True).unionByName(first, True).groupBy("conv_id", "place")
    met = both.agg(*(F.max(c).alias(c) for c in ("turn", "initial", "blank", "short", "prior", "first"))).filter("blank is not null")
    copy = ~F.col("blank") & F.col("first").isNull()
    cut = ~F.col("blank") & ~copy & F.col("short")
    known = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("o")
    kind = F.when(F.col("blank") | copy, "x").when(cut, F.upper(known)).otherwise(known)
    pair = F.concat("prior", "initial")
    return met.select(
        "conv_id", "place", "turn", kind.alias("kind"), F.col("blank").cast("long").alias("blank"), copy.cast("long").alias("duplicate"), cut.cast("long").alias("truncated"),
        F.coalesce(~pair.isin("su", "ua", "au"), F.lit(False)).cast("long").alias("illegal"),
    )


def repaired(turns: DataFrame, audits: DataFrame) -> DataFrame:
    """(conv_id, place, role, text): the turns that ``audits`` (conv_id, audit) make of ``turns`` (conv_id, place, role, text).

    The conversations come whole and in order within the partitions of the result.
    """
    heads = audits.select("conv_id", F.lit(-1).cast("long").alias("place"), F.col("audit").alias("role"), F.lit(None).cast("string").alias("text"))
    rows = turns.select("conv_id", "place", "role", "text").unionByName(heads)
    rows = rows.repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "place")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        audit, at, now, n, conv, schema = "", 0, NOTHING, 0, None, None
        out: list[tuple] = []

        def inserted() -> None:
            nonlocal at, now, n
            while at < len(audit) and audit[at] == "I":
                now = ASSISTANT if now == USER else USER
                out.append((conv, n, ROLE[now], ""))
                at, n = at + 1, n + 1

        for batch in batches:
            schema = batch.schema
            for c, place, role, text in zip(*(batch.column(k).to_pylist() for k in ("conv_id", "place", "role", "text"))):
                if place < 0:
                    inserted()
                    conv, audit, at, now, n = c, role, 0, NOTHING, 0
                    continue
                inserted()
                edit = audit[at]
                at += 1
                if edit == "D":
                    continue
                if edit == "K" and now == NOTHING and role[:1] == "s":
                    now = SYSTEM
                else:
                    now = ASSISTANT if now == USER else USER
                out.append((conv, n, ROLE[now] if edit == "R" else role, text))
                n += 1
            yield _turn_batch(out, schema)
            out.clear()
        inserted()
        if out:
            yield _turn_batch(out, schema)

    return rows.mapInArrow(run, rows.schema)


def _turn_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def digests(turns: DataFrame) -> DataFrame:
    """(conv_id, sha256) of the lines ``role:text``; ``turns`` come as ``repaired`` returns them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state, kind = None, None, None
        for batch in batches:
            kind, out = batch.schema.field("conv_id").type, []
            for c, place, role, text in zip(*(batch.column(k).to_pylist() for k in ("conv_id", "place", "role", "text"))):
                if place == 0:
                    if state is not None:
                        out.append((conv, state.hexdigest()))
                    conv, state = c, hashlib.sha256()
                else:
                    state.update(b"\n")
                state.update(f"{role}:{text}".encode())
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], kind), pa.array([x[1] for x in out], pa.string())], ["conv_id", "sha256"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([conv], kind), pa.array([state.hexdigest()])], ["conv_id", "sha256"])

    return turns.mapInArrow(run, f"conv_id {dict(turns.dtypes)['conv_id']}, sha256 string")


def damaged(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) after the damage: by crc32('conv_id:turn') mod 20 a turn is dropped, emptied, loses its stops, is doubled or becomes a user's."""

    def plain(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    hit = F.crc32(F.concat(plain("conv_id"), F.lit(":"), plain("turn")).cast("binary")) % 20
    text = F.when(hit == 1, "").when(hit == 2, F.translate(plain("text"), ".!?", "")).otherwise(plain("text"))
    role = F.when(hit == 4, "user").otherwise(plain("role"))
    copies = F.explode(F.when(hit == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return turns.filter(hit != 0).select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("_copy")).drop("_copy")


def repair(turns: DataFrame, span: int = SPAN) -> tuple[DataFrame, DataFrame]:
    """Per conversation (conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit), and the repaired turns.

    ``turns`` has conv_id, turn, role and text; they are ordered by turn (nulls first), role and text.
    """
    placed = numbered(turns, "conv_id", [F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("text").asc()], ["conv_id", "turn", "role", "text"])
    found = staged(faults(placed), "faults")
    audits = staged(cheapest(found.select("conv_id", "place", "kind"), span), "audits")
    counts = ["blank", "duplicate", "truncated", "illegal"]
    by_turn = found.groupBy("conv_id", "turn").agg(*(F.sum(c).alias(c) for c in counts))
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0))
    stats = by_turn.groupBy("conv_id").agg(gaps.cast("long").alias("gaps"), *(F.sum(c).alias(c) for c in counts))
    each = stats.unionByName(audits, True).groupBy("conv_id").agg(*(F.max(c).alias(c) for c in ("gaps", *counts, "cost", "audit")))
    return each, repaired(placed, audits)


def op12_cyk_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    each, after = repair(damaged(turns))
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    rows = turns.select("conv_id").distinct().unionByName(each, True).unionByName(digests(after), True)
    out = rows.groupBy("conv_id").agg(*(F.max(c).alias(c) for c in (*numbers, "audit", "sha256")))
    return out.select(
        "conv_id", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in numbers),
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"),
    )


#: crc32 of a text of ASCII characters; "tab" is the table of its bytes.
CRC_TABLE = """crc AS (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS tab
  FROM (SELECT CAST(range AS BIGINT) AS i FROM range(256)))"""


def crc_sql(text: str) -> str:
    start = f"list_concat([4294967295], list_transform(string_split({text}, ''), lambda ch: CAST(ascii(ch) AS BIGINT)))"
    return f"xor(list_reduce({start}, lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295)"


def _sql() -> str:
    """Turn by turn, the least (cost, audit) that ends at each place of the pattern, with the turns it makes."""

    def after(place: int, cost: str, edit: str, line: str = "''") -> str:
        s = f"s{place}"
        return f"CASE WHEN {s} IS NOT NULL THEN {{'k': lpad(CAST(CAST({s}.k[1:9] AS BIGINT) + {cost} AS VARCHAR), 9, '0') || {s}.k[10:] || '{edit}', 't': {s}.t || {line}}} END"

    def least(*found: str) -> str:
        return f"list_sort([{', '.join(found)}], 'ASC', 'NULLS LAST')[1]"

    def when(test: str, what: str) -> str:
        return f"CASE WHEN {test} THEN {what} END"

    kept = "role || ':' || text || chr(10)"
    moved = {q: [after(q, "2", "D")] for q in range(4)}
    for kind, steps in STEPS.items():
        for p, q in steps:
            moved[q].append(when(f"kind = '{kind}'", after(p, "extra", "K", kept)))
            if kind != "s":
                moved[q].append(when("kind <> 'x'", after(p, "extra + 1", "R", f"'{ROLE[q]}:' || text || chr(10)")))
    user = least("s2", *(after(p, "5", "I", "'user:' || chr(10)") for p in (0, 1, 3)))
    assistant = least("s3", after(2, "5", "I", "'assistant:' || chr(10)"))

    def closed(rows: str) -> str:
        return f"SELECT conv_id, place, s0, s1, s2, {assistant} AS s3 FROM (SELECT conv_id, place, s0, s1, {user} AS s2, s3 FROM ({rows}))"

    none = "CAST(NULL AS STRUCT(k VARCHAR, t VARCHAR))"
    begin = f"SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS place, {{'k': '000000000', 't': ''}} AS s0, {none} AS s1, {none} AS s2, {none} AS s3 FROM flags"
    step = "SELECT d.conv_id, f.place, " + ", ".join(f"{least(*moved[q])} AS s{q}" for q in range(4)) + " FROM dp d JOIN flags f ON f.conv_id IS NOT DISTINCT FROM d.conv_id AND f.place = d.place + 1"
    return f"""
WITH RECURSIVE {CRC_TABLE},
hit AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {crc_sql("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS hit
  FROM conversations, crc
), damaged AS (
  SELECT conv_id, turn, CASE WHEN hit = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN hit = 1 THEN '' WHEN hit = 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM hit, (VALUES (1), (2)) AS copies(c) WHERE hit <> 0 AND (c = 1 OR hit = 3)
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place,
    rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body FROM damaged
), seen AS (
  SELECT *, left(role, 1) AS initial, body = '' AS blank,
    body <> '' AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY place) > 1 AS duplicate,
    lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY place) AS prior FROM placed
), flags AS (
  SELECT *, NOT blank AND NOT duplicate AND right(body, 1) NOT IN ('.', '!', '?') AS truncated,
    CASE WHEN blank OR duplicate THEN 'x' ELSE initial END AS kind,
    CASE WHEN NOT blank AND NOT duplicate AND right(body, 1) NOT IN ('.', '!', '?') THEN 5 ELSE 0 END AS extra FROM seen
), dp(conv_id, place, s0, s1, s2, s3) AS (
  {closed(begin)} UNION ALL {closed(step)}
), best AS (
  SELECT conv_id, {least("s0", "s3")} AS s FROM dp QUALIFY place = max(place) OVER (PARTITION BY conv_id)
), stats AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank,
    count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (truncated) AS truncated,
    count(*) FILTER (prior || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM flags GROUP BY conv_id
), ids AS (SELECT DISTINCT conv_id FROM conversations)
SELECT i.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(CAST(s.k[1:9] AS BIGINT), 0) AS cost,
  coalesce(s.k[10:], '') AS audit, sha256(coalesce(left(s.t, greatest(length(s.t) - 1, 0)), '')) AS repaired_sha256
FROM ids i LEFT JOIN stats s2 ON s2.conv_id IS NOT DISTINCT FROM i.conv_id LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM i.conv_id
"""


OP12_SQL = _sql()
