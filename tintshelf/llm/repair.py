"""Conversation structure repair by a run-length DP over role and fault symbols.

Each row becomes one symbol: what its role starts with (s, u, a, other) and its fault. A symbol has a min-plus transition
between four states (nothing yet, after system, after user, after assistant) that holds the cheapest way to keep, rerole or
delete the row, with insertions before it. Equal symbols in a row are one run; a run of m rows advances the cost vector
through the cached binary powers of its transition, so its cost takes log m steps. Costs run from the end of a conversation
to its front; the audit is then unrolled from the front, taking at every row the ASCII-least edit that is still optimal.
The vector inside a run comes from the same powers, so no vectors are kept.

On Spark: one exchange by conversation; faults by a window on it; rows sorted backwards stream through the first pass, which
notes each run's length and end vector at its first row; sorted forwards they stream through the second, which edits.
Both hold one row and one vector at a time, whatever a conversation's length. The digest of a repaired conversation is one
sequential hash, so its rows pass through one task in order; they are not gathered there. Only the audit (a letter a row)
grows with a conversation, as the result itself does.

Defined cases: null role or text is one space; null ``conv_id`` is a conversation of its own, and null ids and turns count as
one space in the hash; rows go by turn (nulls first), role, text; a role counts by its first character, as it is written;
a conversation with no rows left has zeros, an empty audit and the hash of the empty string; an empty table gives no rows;
further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLANKS = " \t\n\x0b\x0c\r"
#: Costs of the edits, and of a truncated row that stays.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
ROLES = {"u": "user", "a": "assistant"}
#: States: nothing yet, after system, user, assistant; the initials each may be followed by; what an edit puts next.
NEXT = [{"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2}]
FORCED = ["u", "u", "a", "u"]
ENDS = (0, 3)
FAR = 1 << 60
_STATES = range(4)


def damage(conversations: DataFrame) -> DataFrame:
    """The rows (conv_id, turn, role, text, gone) after damage by hash; a dropped row stays as a mark."""
    blank = F.lit(" ")
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    role, text = F.coalesce("role", blank), F.coalesce("text", blank)
    rows = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.crc32(name.cast("binary")) % 20).alias("h"))
    body = F.when(F.col("h") <= 1, F.lit("")).when(F.col("h") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    times = F.array_repeat(F.lit(0), F.when(F.col("h") == 3, 2).otherwise(1))
    out = rows.select("conv_id", "turn", F.when(F.col("h") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"), body.alias("text"), (F.col("h") == 0).alias("gone"), F.explode(times).alias("_"))
    return out.drop("_")


def fault(role: Column, text: Column, again: Column) -> Column:
    """b, d, t: the first of blank, duplicate, truncated that holds; else empty."""
    end = F.rtrim(text, F.lit(BLANKS))
    return F.when(end == "", "b").when(again, "d").when(~F.right(end, F.lit(1)).isin(".", "!", "?"), "t").otherwise("")


def product(a: list[list[int]], b: list[list[int]]) -> list[list[int]]:
    """Min-plus product."""
    return [[min(min(a[i][k] + b[k][j] for k in _STATES), FAR) for j in _STATES] for i in _STATES]


def apply(a: list[list[int]], v: tuple[int, ...]) -> tuple[int, ...]:
    return tuple(min(min(a[i][k] + v[k] for k in _STATES), FAR) for i in _STATES)


@cache
def insertions() -> list[list[int]]:
    """Cheapest way from state to state by inserted rows alone."""
    cost = [[0 if i == j else FAR for j in _STATES] for i in _STATES]
    step = [[INSERT if NEXT[i].get(FORCED[i]) == j else FAR for j in _STATES] for i in _STATES]
    for _ in _STATES:
        more = product(cost, step)
        cost = [[min(cost[i][j], more[i][j]) for j in _STATES] for i in _STATES]
    return cost


@cache
def edits(symbol: str, state: int) -> tuple[tuple[str, int, int], ...]:
    """(letter, cost, next state) of the edits of one row, in ASCII order; the symbol is an initial and a fault."""
    initial, wrong = symbol[0], symbol[1:]
    out = [("D", DELETE, state)]
    if wrong not in ("b", "d"):
        more = TRUNCATED if wrong == "t" else 0
        if initial in NEXT[state]:
            out.append(("K", more, NEXT[state][initial]))
        out.append(("R", REROLE + more, NEXT[state][FORCED[state]]))
    return tuple(out)


@cache
def power(symbol: str, k: int) -> list[list[int]]:
    """Transition of 2**k rows of a symbol, insertions before each."""
    if k:
        half = power(symbol, k - 1)
        return product(half, half)
    step = [[FAR] * 4 for _ in _STATES]
    for i in _STATES:
        for _, cost, j in edits(symbol, i):
            step[i][j] = min(step[i][j], cost)
    return product(insertions(), step)


def advance(symbol: str, m: int, v: tuple[int, ...]) -> tuple[int, ...]:
    """Cost vector before m rows of a symbol, from the one after them."""
    k = 0
    while m:
        if m & 1:
            v = apply(power(symbol, k), v)
        m >>= 1
        k += 1
    return v


def at_end() -> tuple[int, ...]:
    """Cost vector behind the last row: insertions until a state in which a conversation may end."""
    return apply(insertions(), tuple(0 if s in ENDS else FAR for s in _STATES))


def symbol_of(role: str, wrong: str) -> str:
    """Initial and fault; the initial of a row that must go does not matter."""
    return "-" + wrong[:1].replace("b", "d") if wrong in ("b", "d") else (role[:1] if role[:1] in ("s", "u", "a") else "o") + wrong


_KEYS = ("conv_id", "turn", "role", "text", "gone", "wrong")


def _mark_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Backwards: notes at the first row of each run its length and the cost vector behind it.

    The row that ends a run (its first one in reading order) is known when the next row is seen, so rows are one late.
    """
    conv, held, symbol, m, v, begun = None, None, "", 0, (), False
    for batch in batches:
        columns = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
        rows, marks = [], []
        for row in zip(*columns, strict=True):
            new_conv = not begun or row[0] != conv
            here = "" if row[4] else symbol_of(row[2], row[5])
            if held is not None:
                last = new_conv or here != symbol
                rows.append(held)
                marks.append((m, list(v)) if last and symbol else (None, None))
                if last and symbol and not new_conv:
                    v = advance(symbol, m, v)
            if new_conv:
                conv, begun, v, m = row[0], True, at_end(), 0
            elif here != symbol:
                m = 0
            symbol, held, m = here, row, m + 1
        if rows:
            yield _marked(batch.schema, rows, marks)
        schema = batch.schema
    if held is not None:
        yield _marked(schema, [held], [(m, list(v)) if symbol else (None, None)])


def _marked(schema: pa.Schema, rows: list[tuple], marks: list[tuple]) -> pa.RecordBatch:
    arrays = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)]
    lengths, vectors = zip(*marks, strict=True)
    return pa.RecordBatch.from_arrays([*arrays, pa.array(lengths, pa.int64()), pa.array(vectors, pa.list_(pa.int64()))], names=[*schema.names, "run", "behind"])


class Repair:
    """One conversation while its rows pass by."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.state, self.cost, self.n = conv_id, 0, 0, 0
        self.audit, self.hash = [], hashlib.sha256()
        self.some, self.before, self.illegal = False, None, 0
        self.counts = {"b": 0, "d": 0, "t": 0}
        self.low = self.high = None
        self.turns = 0
        self.left, self.symbol, self.behind = 0, "", at_end()

    def _write(self, role: str, text: str) -> None:
        self.hash.update(f"{chr(10) if self.some else ''}{role}:{text}".encode("utf-8", "replace"))
        self.some = True

    def _insert(self) -> None:
        role = FORCED[self.state]
        self._write(ROLES[role], "")
        self.audit.append("I")
        self.cost += INSERT
        self.state = NEXT[self.state][role]

    def row(self, turn: int | None, role: str, text: str, wrong: str, run: int | None, behind: list[int] | None) -> None:
        self.n += 1
        if wrong:
            self.counts[wrong] += 1
        if self.before is not None and self.before + role[:1] not in ("su", "ua", "au"):
            self.illegal += 1
        self.before = role[:1]
        if turn is not None and turn != self.high:
            self.low, self.high, self.turns = turn if self.low is None else self.low, turn, self.turns + 1
        if self.left == 0:
            self.left, self.symbol, self.behind = run, symbol_of(role, wrong), tuple(behind)
        self.left -= 1
        after = advance(self.symbol, self.left, self.behind)
        before = apply(power(self.symbol, 0), after)
        while True:  # D before I before K before R: the ASCII-least edit among the cheapest
            best = before[self.state]
            choices = {letter: (cost, to) for letter, cost, to in edits(self.symbol, self.state) if cost + after[to] == best}
            if "D" not in choices and INSERT + before[NEXT[self.state][FORCED[self.state]]] == best:
                self._insert()
                continue
            letter = min(choices)
            cost, to = choices[letter]
            break
        if letter == "K":
            self._write(role, text)
        elif letter == "R":
            self._write(ROLES[FORCED[self.state]], text)
        self.audit.append(letter)
        self.cost += cost
        self.state = to

    def result(self) -> tuple:
        if self.n:
            while self.state not in ENDS:
                self._insert()
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return (self.conv_id, gaps, self.counts["b"], self.counts["d"], self.counts["t"], self.illegal, self.cost, "".join(self.audit), self.hash.hexdigest())


_RESULT = "conv_id {}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
#: Conversations written at a time.
FLUSH = 5_000


def _edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Forwards: edits every row and closes conversations."""
    one, done, id_type = None, [], pa.int64()

    def flush() -> pa.RecordBatch:
        names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
        types = [id_type, *[pa.int64()] * 6, pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), types, strict=True)], names=names)

    for batch in batches:
        id_type = batch.schema.types[0]
        for conv, turn, role, text, gone, wrong, run, behind in zip(*[batch.column(i).to_pylist() for i in range(8)], strict=True):
            if one is None or one.conv_id != conv:
                if one is not None:
                    done.append(one.result())
                one = Repair(conv)
                if len(done) >= FLUSH:
                    yield flush()
                    done = []
            if not gone:
                one.row(turn, role, text, wrong, run, behind)
    if one is not None:
        done.append(one.result())
    if done:
        yield flush()


def repair(rows: DataFrame) -> DataFrame:
    """One row per conversation of (conv_id, turn, role, text, gone): faults, cost, audit and digest of the repaired rows."""
    # role and text are told apart by their own digest, so that no long string is a sort key of the window
    what = F.sha2(F.concat(F.char_length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    given = rows.select("conv_id", "turn", "role", "text", "gone").repartition("conv_id").withColumn("what", F.unhex(what))
    again = F.row_number().over(Window.partitionBy("conv_id", "what").orderBy("gone", F.asc_nulls_first("turn"))) > 1
    judged = given.withColumn("wrong", fault(F.col("role"), F.col("text"), again)).select(*_KEYS)
    # of rows alike in all else the first copy goes before its repeats, and of those the one that holds their run's mark
    keys = ["gone", "turn", "role", "text", F.col("wrong") == "d"]
    marked = T.StructType([*judged.schema.fields, T.StructField("run", T.LongType()), T.StructField("behind", T.ArrayType(T.LongType()))])
    backwards = judged.sortWithinPartitions("conv_id", *[F.desc_nulls_last(k) for k in keys]).mapInArrow(_mark_runs, marked)
    forwards = backwards.sortWithinPartitions("conv_id", *[F.asc_nulls_first(k) for k in keys], F.desc_nulls_last("run"))
    return forwards.mapInArrow(_edit, _RESULT.format(dict(rows.dtypes)["conv_id"]))
