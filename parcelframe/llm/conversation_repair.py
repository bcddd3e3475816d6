"""Repair of conversations' turn structure by Four-Russians block tables.

The least-cost edits that turn a conversation's rows into role initials of the
form ``(s?(ua)+)?`` are a shortest path through four automaton states (nothing
yet, after s, after u, after a): keep a row, rerole it, delete it, insert a turn.
A row is one of nine symbols (initial s/u/a/other, truncated or not, or must be
deleted).

* Tables: the costs of the four states, less their least, are a normalised cost
  vector. States more than ``SPAN`` above the least can't lie on a cheapest path
  (from the least state everything another state can do costs at most ``SPAN``
  more), so there are only some dozen vectors. The transition of each of them
  over each block of ``BLOCK`` symbols is computed once per process.
* Blocks: a conversation's symbols are processed a block at a time by lookup;
  only the vectors at block borders are kept.
* Tracing: blocks are expanded backward, last to first, which gives at each
  border the states that lie on some cheapest path. Walking forward through those
  cells, each state has at most one edge for each edit, so taking the smallest
  letter each time gives the ASCII-least of all cheapest edits. Expansions are
  remembered by (vector, block, states), so they're lookups too.

Spark does the rest. Faults are found in narrow rows (digests, no texts):
equal rows are counted before they're shuffled, then one shuffle by
conversation serves the window that finds earlier equal rows, the sort and the
pass that builds symbols. The edits then meet the full rows in a second pass,
sorted so that a conversation's edits come before its rows: rows stream through,
none is held. What a task holds of a conversation is one byte a row, as the audit
it returns has too.

Defined results: nulls in any column count as one space; rows go by turn, nulls
first, then by role and the text's md5; repeated rows are duplicates of the first;
texts may be of any length; an empty role has no initial; an empty table gives
an empty result; other columns are ignored. Ties between edits go to the
ASCII-least audit.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPAN, BLOCK = 7, 3
INF = 99
NONE, S, U, A = range(4)
EMIT = (U, U, A, U)  # the state after the next u or a
KEEP = {0: (NONE, S), 1: (NONE, U), 2: (U, A)}  # initial: (a state that may take it, the state after it)
ROLE = {U: "user", A: "assistant"}
#: Symbols: initial (0 s, 1 u, 2 a, 3 other), + 4 if truncated; MUST is a row that must go, PAD no row.
MUST, PAD = 8, 9
BLANKS = " \t\n\x0b\x0c\r"


def taken(symbol: int, state: int) -> int | None:
    """The state after keeping a row in ``state``; None if it can't be kept there."""
    if symbol == MUST:
        return None
    kind = symbol % 4
    if kind == 0:
        return S if state == NONE else None
    if kind == 1:
        return U if state != U else None
    return A if kind == 2 and state == U else None


def closed(costs: list[int]) -> tuple[int, ...]:
    """Costs with insertions."""
    c = list(costs)
    for _ in range(3):
        for s in range(4):
            c[EMIT[s]] = min(c[EMIT[s]], c[s] + 2)
    return tuple(c)


def row_edges(symbol: int, state: int) -> list[tuple[str, int, int]]:
    """(edit, cost, state after) of the edits that use up a row."""
    more = 1 if 4 <= symbol < MUST else 0
    out = [("D", 3, state)]
    if symbol != MUST:
        if (to := taken(symbol, state)) is not None:
            out.append(("K", more, to))
        out.append(("R", 2 + more, EMIT[state]))
    return out


def capped(costs: tuple[int, ...]) -> tuple[tuple[int, ...], int]:
    """(normalised vector, what was taken off)."""
    low = min(costs)
    return tuple(c - low if c - low <= SPAN else INF for c in costs), low


@lru_cache(maxsize=None)
def stepped(vector: tuple[int, ...], symbol: int) -> tuple[int, ...]:
    """Costs after a row, relative to those before it."""
    if symbol == PAD:
        return vector
    costs = [INF] * 4
    for s, c in enumerate(vector):
        if c < INF:
            for _, cost, to in row_edges(symbol, s):
                costs[to] = min(costs[to], c + cost)
    return closed(costs)


START = capped(closed([0, INF, INF, INF]))[0]


class Tables:
    """All normalised vectors, and the transition of each over every block."""

    def __init__(self):
        self.vectors, self.number = [START], {START: 0}
        one: list[list[tuple[int, int]]] = []
        while len(one) < len(self.vectors):  # every vector that any symbols lead to
            own = []
            for symbol in range(PAD + 1):
                vector, off = capped(stepped(self.vectors[len(one)], symbol))
                if vector not in self.number:
                    self.number[vector] = len(self.vectors)
                    self.vectors.append(vector)
                own.append((self.number[vector], off))
            one.append(own)
        base = PAD + 1
        self.block: list[list[tuple[int, int]]] = [[(v, 0)] for v in range(len(self.vectors))]
        for _ in range(BLOCK):  # blocks one symbol longer, from those before
            self.block = [[(one[v][s][0], off + one[v][s][1]) for v, off in row for s in range(base)] for row in self.block]


@lru_cache(maxsize=None)
def tables() -> Tables:
    return Tables()


def block_number(symbols: bytes) -> int:
    n = 0
    for k in range(BLOCK):
        n = n * (PAD + 1) + (symbols[k] if k < len(symbols) else PAD)
    return n


def _layers(vector: tuple[int, ...], symbols: bytes) -> list[tuple[int, ...]]:
    out = [vector]
    for s in symbols:
        vector, off = capped(out[-1])
        out.append(tuple(c + off for c in stepped(vector, s)))
    return out


def _with_inserts(costs: tuple[int, ...], mask: int) -> int:
    """The states of a layer from which insertions lead to those of ``mask`` at their cost."""
    while True:
        more = mask
        for s in range(4):
            if mask >> EMIT[s] & 1 and costs[s] < INF and costs[s] + 2 == costs[EMIT[s]]:
                more |= 1 << s
        if more == mask:
            return mask
        mask = more


@lru_cache(maxsize=1 << 16)
def expanded(vector: tuple[int, ...], symbols: bytes, mask: int) -> tuple[tuple[tuple[int, ...], ...], tuple[int, ...]]:
    """(costs, states on a cheapest path) of every layer of a block whose last layer has the states ``mask``."""
    layers = _layers(vector, symbols)
    masks = [mask]
    for k in range(len(symbols) - 1, -1, -1):
        own = 0
        for s, c in enumerate(layers[k]):
            if c < INF and any(masks[0] >> to & 1 and c + cost == layers[k + 1][to] for _, cost, to in row_edges(symbols[k], s)):
                own |= 1 << s
        masks.insert(0, _with_inserts(layers[k], own))
    return tuple(layers), tuple(masks)


def _inserted(costs: tuple[int, ...], mask: int, state: int) -> bool:
    return bool(mask >> EMIT[state] & 1) and costs[state] + 2 == costs[EMIT[state]]


@lru_cache(maxsize=1 << 16)
def walked(vector: tuple[int, ...], symbols: bytes, mask: int, state: int) -> tuple[str, int]:
    """(edits, state after) of the ASCII-least way through a block."""
    layers, masks = expanded(vector, symbols, mask)
    out = []
    for k, symbol in enumerate(symbols):
        while True:
            edges = [(e, to) for e, cost, to in row_edges(symbol, state) if masks[k + 1] >> to & 1 and layers[k][state] + cost == layers[k + 1][to]]
            if _inserted(layers[k], masks[k], state):
                edges.append(("I", EMIT[state]))
            edit, state = min(edges)
            out.append(edit)
            if edit != "I":
                break
    return "".join(out), state


def cheapest(symbols: bytes) -> tuple[int, str]:
    """(cost, ASCII-least cheapest edits) of a conversation."""
    t = tables()
    blocks = [symbols[k:k + BLOCK] for k in range(0, len(symbols), BLOCK)]
    border, cost = [0], 0
    for b in blocks:
        v, off = t.block[border[-1]][block_number(b)]
        border.append(v)
        cost += off
    last = t.vectors[border[-1]]
    least = min(last[NONE], last[A])
    masks = [_with_inserts(last, sum(1 << s for s in (NONE, A) if last[s] == least))]
    for v, b in zip(border[-2::-1], blocks[::-1]):
        masks.append(expanded(t.vectors[v], b, masks[-1])[1][0])
    masks.reverse()
    out, state = [], NONE
    for k, b in enumerate(blocks):
        letters, state = walked(t.vectors[border[k]], b, masks[k + 1], state)
        out.append(letters)
    while _inserted(last, masks[-1], state):
        out.append("I")
        state = EMIT[state]
    return cost + least, "".join(out)


# Spark

def filled(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text), role and text without nulls."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    return rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text("role").alias("role"), text("text").alias("text"))


def damaged(rows: DataFrame) -> DataFrame:
    """Rows after the damage that crc32(``conv_id:turn``) % 20 asks for."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.pmod(F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")), F.lit(20))
    rows = filled(rows).withColumn("_kind", kind).where("_kind != 0")
    text = F.when(F.col("_kind") == 1, F.lit("")).when(F.col("_kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("_kind") == 4, F.lit("user")).otherwise(F.col("role"))
    times = F.when(F.col("_kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(times).alias("_copy")).drop("_copy")


def _sort_keys(text: Column) -> list[Column]:
    return [F.col("turn").asc_nulls_first(), F.col("role"), F.md5(text.cast("binary"))]


def audits(rows: DataFrame) -> DataFrame:
    """conv_id, n_rows, gaps, blank, duplicate, truncated, illegal, cost and audit of each conversation."""
    last = F.right(F.rtrim(F.col("text"), F.lit(BLANKS)), F.lit(1))
    narrow = filled(rows).select("conv_id", "turn", "role", F.md5(F.col("text").cast("binary")).alias("digest"),
                                 (last == "").alias("empty"), last.isin(".", "!", "?").alias("ended"))
    same = narrow.groupBy("conv_id", "turn", "role", "digest", "empty", "ended").agg(F.count("*").alias("n")).repartition("conv_id")
    earlier = F.row_number().over(Window.partitionBy("conv_id", "role", "digest").orderBy(F.col("turn").asc_nulls_first())) > 1
    ordered = (same.withColumn("seen", earlier)
               .sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "digest")
               .select("conv_id", "turn", F.substring("role", 1, 1).alias("initial"), "empty", "ended", "seen", "n"))
    schema = "conv_id long, n_rows long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
    names = [f.split()[0] for f in schema.split(", ")]
    kinds = [pa.int64()] * 8 + [pa.string()]

    class One:
        """What is known of a conversation so far: a byte a row."""

        def __init__(self, conv_id):
            self.id, self.symbols, self.last, self.turn = conv_id, bytearray(), None, None
            self.low = self.high = None
            self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0

        def add(self, turn, initial, empty, ended, seen, n):
            if turn is not None and turn != self.high:
                self.turns += 1
                self.low, self.high = (turn if self.low is None else self.low), turn
            if self.last is not None and self.last + initial not in ("su", "ua", "au"):
                self.illegal += 1
            self.illegal += (n - 1) * (initial + initial not in ("su", "ua", "au"))
            self.last = initial
            kind = "sua".find(initial) if initial else 3
            kind = 3 if kind < 0 else kind
            if empty:
                self.blank += n
                self.symbols += bytes([MUST]) * n
            else:
                fresh = 0 if seen else 1
                self.duplicate += n - fresh
                self.truncated += fresh and not ended
                self.symbols += bytes([kind + (0 if ended else 4)]) * fresh + bytes([MUST]) * (n - fresh)

        def row(self):
            cost, audit = cheapest(bytes(self.symbols))
            gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
            return self.id, len(self.symbols), gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, audit

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: One | None = None

        def record(out: list[tuple]) -> pa.RecordBatch:
            return pa.record_batch([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names)

        for b in batches:
            out = []
            for conv_id, *row in zip(*[c.to_pylist() for c in b.columns]):
                if held is None or held.id != conv_id:
                    out += [held.row()] if held else []
                    held = One(conv_id)
                held.add(*row)
            yield record(out)
        yield record([held.row()] if held else [])

    return ordered.mapInArrow(run, schema)


def _streams(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """Rows by conversation, in order, each conversation's edits before its rows."""
    own = filled(rows).select("conv_id", F.lit(1).alias("kind"), "turn", "role", "text")
    first = edits.select("conv_id", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.col("audit").alias("text"))
    return own.unionByName(first).repartition("conv_id").sortWithinPartitions("conv_id", "kind", *_sort_keys(F.col("text")))


class _Edits:
    """The edits of one conversation, applied row by row."""

    def __init__(self, conv_id, audit: str):
        self.id, self.audit, self.at, self.state = conv_id, audit, 0, NONE

    def inserts(self) -> Iterator[tuple[str, str]]:
        """(edit, role) of the insertions before the next row."""
        while self.audit[self.at:self.at + 1] == "I":
            self.at, self.state = self.at + 1, EMIT[self.state]
            yield "I", ROLE[self.state]

    def row(self, role: str) -> tuple[str, str]:
        """(edit, role after it) of the next row."""
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self.state = {"s": S, "u": U, "a": A}[role[0]]
        elif edit == "R":
            self.state = EMIT[self.state]
            role = ROLE[self.state]
        return edit, role


def repaired(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """conv_id, step, edit, turn, role, text: each edit of each conversation in order, with the row it leaves
    (a deleted row has its own role and text; an inserted one an empty text and no turn)."""
    schema = "conv_id long, step long, edit string, turn long, role string, text string"
    fields = pa.schema([("conv_id", pa.int64()), ("step", pa.int64()), ("edit", pa.string()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _Edits | None = None

        def rest() -> list[tuple]:
            return [(now.id, now.at, e, None, r, "") for e, r in now.inserts()] if now else []

        for b in batches:
            out = []
            for conv_id, kind, turn, role, text in zip(*[c.to_pylist() for c in b.columns]):
                if kind == 0:
                    out += rest()
                    now = _Edits(conv_id, text)
                else:
                    out += rest()
                    edit, role = now.row(role)
                    out.append((conv_id, now.at, edit, turn, role, text))
            yield pa.record_batch([pa.array([r[k] for r in out], f.type) for k, f in enumerate(fields)], schema=fields)
        out = rest()
        yield pa.record_batch([pa.array([r[k] for r in out], f.type) for k, f in enumerate(fields)], schema=fields)

    return _streams(rows, edits).mapInArrow(run, schema)


def digests(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """conv_id, repaired_sha256: the hash of each repaired conversation's ``role:text`` lines, taken as they stream by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sha, lines = None, None, 0

        def line(role: str, text: str) -> None:
            nonlocal lines
            sha.update((("\n" if lines else "") + role + ":" + text).encode())
            lines += 1

        def record(out: list[tuple]) -> pa.RecordBatch:
            return pa.record_batch([pa.array([i for i, _ in out], pa.int64()), pa.array([h for _, h in out], pa.string())], ["conv_id", "repaired_sha256"])

        def ended() -> list[tuple]:
            if now is None:
                return []
            for _, role in now.inserts():
                line(role, "")
            return [(now.id, sha.hexdigest())]

        for b in batches:
            out = []
            for conv_id, kind, _, role, text in zip(*[c.to_pylist() for c in b.columns]):
                if kind == 0:
                    out += ended()
                    now, sha, lines = _Edits(conv_id, text), hashlib.sha256(), 0
                    continue
                for _, new in now.inserts():
                    line(new, "")
                edit, role = now.row(role)
                if edit != "D":
                    line(role, text)
            yield record(out)
        yield record(ended())

    return _streams(rows, edits).mapInArrow(run, "conv_id long, repaired_sha256 string")


def repair_report(rows: DataFrame, conversations: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conv_id of ``conversations``."""
    from .common import stored

    found = stored(audits(rows), "audits")
    hashes = digests(rows, found).withColumnRenamed("conv_id", "_hashed")
    both = found.join(hashes, F.col("conv_id").eqNullSafe(F.col("_hashed"))).drop("_hashed", "n_rows").withColumnRenamed("conv_id", "_found")
    ids = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    out = ids.join(both, F.col("conv_id").eqNullSafe(F.col("_found")), "left").drop("_found")
    zero = {c: 0 for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    return out.fillna(zero | {"audit": "", "repaired_sha256": hashlib.sha256(b"").hexdigest()})


ORACLE = r"""
WITH RECURSIVE given AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name FROM conversations),
kinds AS (SELECT *, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT),
        flatten(list_transform(string_split(name, ''), lambda x: [CAST(ascii(x) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
        lambda c, o: CASE WHEN o >= 0 THEN xor(c, o) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END), 4294967295) % 20 AS kind FROM given),
hurt AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
    FROM kinds, (VALUES (0), (1)) AS c(copy) WHERE kind != 0 AND (copy = 0 OR kind = 3)),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) AS i FROM hurt),
seq AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS seen,
    left(lag(role) OVER w, 1) || left(role, 1) AS meet, lag(role) OVER w IS NOT NULL AS met, right(regexp_replace(text, '[\x20\x09-\x0D]+$', ''), 1) AS tail
    FROM placed WINDOW w AS (PARTITION BY conv_id ORDER BY i)),
marked AS (SELECT *, CASE WHEN tail = '' THEN 'b' WHEN seen > 1 THEN 'd' WHEN tail NOT IN ('.', '!', '?') THEN 't' ELSE 'k' END AS fault, left(role, 1) AS c FROM seq),
sums AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'b') AS blank,
    count(*) FILTER (WHERE fault = 'd') AS duplicate, count(*) FILTER (WHERE fault = 't') AS truncated,
    count(*) FILTER (WHERE met AND meet NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n FROM marked GROUP BY conv_id),
-- cheapest edits from row i on, from each state (0 nothing yet, 1 after s, 2 after u, 3 after a), as cost and letters
go(conv_id, i, f0, f1, f2, f3) AS (
    SELECT conv_id, n + 1, '000000', '000004II', '000002I', '000000' FROM sums
    UNION ALL
    SELECT conv_id, i, least(g0, plus(g2, 2, 'I'), plus(g3, 4, 'II')), least(g1, plus(g2, 2, 'I'), plus(g3, 4, 'II')), least(g2, plus(g3, 2, 'I')), least(g3, plus(g2, 2, 'I')) FROM (
        SELECT m.conv_id, m.i,
            least(plus(f0, 3, 'D'), CASE WHEN must THEN 'z' ELSE least(plus(f2, 2 + t, 'R'), CASE c WHEN 's' THEN plus(f1, t, 'K') WHEN 'u' THEN plus(f2, t, 'K') ELSE 'z' END) END) AS g0,
            least(plus(f1, 3, 'D'), CASE WHEN must THEN 'z' ELSE least(plus(f2, 2 + t, 'R'), CASE c WHEN 'u' THEN plus(f2, t, 'K') ELSE 'z' END) END) AS g1,
            least(plus(f2, 3, 'D'), CASE WHEN must THEN 'z' ELSE least(plus(f3, 2 + t, 'R'), CASE c WHEN 'a' THEN plus(f3, t, 'K') ELSE 'z' END) END) AS g2,
            least(plus(f3, 3, 'D'), CASE WHEN must THEN 'z' ELSE least(plus(f2, 2 + t, 'R'), CASE c WHEN 'u' THEN plus(f2, t, 'K') ELSE 'z' END) END) AS g3
        FROM go JOIN (SELECT *, fault IN ('b', 'd') AS must, CASE fault WHEN 't' THEN 1 ELSE 0 END AS t FROM marked) m
            ON m.conv_id IS NOT DISTINCT FROM go.conv_id AND m.i = go.i - 1)),
plan AS (SELECT conv_id, CAST(f0[1:6] AS BIGINT) AS cost, f0[7:] AS audit FROM go WHERE i = 1),
-- the edits again, forward: state and row number
walk(conv_id, audit, k, row_no, state, line) AS (
    SELECT conv_id, audit, 0, CAST(0 AS BIGINT), 0, CAST(NULL AS VARCHAR) FROM plan
    UNION ALL
    SELECT w.conv_id, w.audit, k + 1, CASE WHEN e = 'I' THEN row_no ELSE row_no + 1 END,
        CASE WHEN e = 'D' THEN state WHEN e = 'K' AND m.c = 's' THEN 1 WHEN state = 2 THEN 3 ELSE 2 END,
        CASE WHEN e = 'D' THEN NULL WHEN e = 'K' THEN m.role || ':' || m.text ELSE
            (CASE WHEN state = 2 THEN 'assistant:' ELSE 'user:' END) || CASE WHEN e = 'I' THEN '' ELSE m.text END END
    FROM (SELECT *, audit[k + 1] AS e FROM walk WHERE k < length(audit)) w LEFT JOIN marked m
        ON m.conv_id IS NOT DISTINCT FROM w.conv_id AND m.i = w.row_no + 1),
lines AS (SELECT conv_id, sha256(coalesce(string_agg(line, chr(10) ORDER BY k), '')) AS sha FROM walk GROUP BY conv_id)
SELECT ids.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
    coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, coalesce(sha, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) ids LEFT JOIN sums ON sums.conv_id IS NOT DISTINCT FROM ids.conv_id
LEFT JOIN plan ON plan.conv_id IS NOT DISTINCT FROM ids.conv_id LEFT JOIN lines ON lines.conv_id IS NOT DISTINCT FROM ids.conv_id
"""


def _written(sql: str) -> str:
    """``plus(f, cost, letters)`` written out: a way's cost (six digits) raised and its letters prefixed."""
    import re

    return re.sub(r"plus\((\w+), ([\w +]+), ('\w+')\)", r"(printf('%06d', CAST(\1[1:6] AS INTEGER) + \2) || \3 || \1[7:])", sql)


ORACLE = _written(ORACLE)
