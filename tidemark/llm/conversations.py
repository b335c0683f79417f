"""Cheapest repair of conversations as a min-plus matrix scan.

A legal conversation is empty or an optional system turn and then pairs of a user's and an assistant's turn, which is an
automaton of four states.  Each turn is a 4 x 4 matrix over (cost, audit): what it costs, by which edits, to go from one
state to another over that turn, with insertions allowed before it.  The product is associative, so turns are multiplied
in blocks within a task, tasks' pieces of a conversation in a tree of groups, and no task needs a whole conversation.

Turns are dealt by range of (conversation, turn), so a conversation of any length spreads over tasks.  Equal rows travel
once with their number.  (cost, audit) is ordered by cost, then audit in ASCII order; two audits of the same turns and
the same cost never begin one with the other, so the order survives appending and the least product is the least repair.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache, lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.durable import saved
from tidemark.llm.rows import named

Cell = tuple[int, str] | None
Matrix = tuple[tuple[Cell, ...], ...]
START, SYSTEM, USER, ASSISTANT = range(4)
STEPS = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
BLOCK, FAN = 8, 8
WORD, CLOSED = r"[^\x20\x09-\x0D]", r"[.!?][\x20\x09-\x0D]*\z"


def less(a: Cell, b: Cell) -> Cell:
    return b if a is None or (b is not None and b < a) else a


def times(a: Matrix, b: Matrix) -> Matrix:
    return tuple(
        tuple(reduce(less, ((x[0] + y[0], x[1] + y[1]) for x, y in zip(row, column, strict=True) if x is not None and y is not None), None) for column in zip(*b, strict=True)) for row in a
    )


def matrix(cells: dict[tuple[int, int], tuple[int, str]]) -> Matrix:
    return tuple(tuple(cells.get((i, j)) for j in range(4)) for i in range(4))


IDENTITY = matrix({(i, i): (0, "") for i in range(4)})
#: Any number of insertions: one or two turns reach every state that can be reached.
INSERTIONS = times(*[matrix({(i, i): (0, "") for i in range(4)} | {(i, j): (INSERT, "I") for steps in (STEPS["u"], STEPS["a"]) for i, j in steps.items()})] * 2)


@cache
def turn(kind: str) -> Matrix:
    """Matrix of a turn: its role's initial (s, u, a or -), then `d` must go, `t` truncated or `k` sound.

    A kept system turn is written L here, which sorts like K among what else can happen to that turn, so that the audit
    alone tells the roles; `audit_of` writes it K.
    """
    role, fault = kind
    cells: dict[tuple[int, int], Cell] = {(i, i): (DELETE, "D") for i in range(4)}
    extra = TRUNCATED if fault == "t" else 0
    if fault != "d":
        for cost, letter, roles in ((0, "L" if role == "s" else "K", role), (REROLE, "R", "ua")):
            for r in roles:
                for i, j in STEPS.get(r, {}).items():
                    cells[i, j] = less(cells.get((i, j)), (cost + extra, letter))
    return times(INSERTIONS, matrix(cells))


def power(base: Matrix, n: int) -> Matrix:
    out = IDENTITY
    while n:
        out, base, n = times(out, base) if n & 1 else out, times(base, base) if n > 1 else base, n >> 1
    return out


@lru_cache(1 << 16)
def block(kinds: tuple[str, ...]) -> Matrix:
    return reduce(times, map(turn, kinds), IDENTITY)


class Product:
    """Product of turns as they come: blocks of a few turns, multiplied like the digits of a binary counter."""

    def __init__(self) -> None:
        self.kinds: list[str] = []
        self.digits: list[tuple[int, Matrix]] = []

    def add(self, kind: str, again: int) -> None:
        """A turn and `again` more copies of it, which are duplicates."""
        self.kinds.append(kind)
        if len(self.kinds) == BLOCK or again:
            self._carry(block(tuple(self.kinds)) if len(self.kinds) > 1 else turn(kind))
            self.kinds = []
        if again:
            self._carry(power(turn(kind[0] + "d"), again))

    def _carry(self, value: Matrix) -> None:
        size = 1
        while self.digits and self.digits[-1][0] <= size:
            n, left = self.digits.pop()
            value, size = times(left, value), size + n
        self.digits.append((size, value))

    def total(self) -> Matrix:
        rest = block(tuple(self.kinds))
        return times(reduce(times, (m for _, m in self.digits)), rest) if self.digits else rest


def best(total: Matrix) -> tuple[int, str]:
    closed = times(total, INSERTIONS)
    return less(closed[START][START], closed[START][ASSISTANT])


SUM = "n long, blank long, duplicate long, truncated long, illegal long, least long, most long, turns long, first_turn long, last_turn long, first_role string, last_role string, costs array<long>, audits array<string>"
SUMS = [x.split()[0] for x in SUM.split(", ")]
PIECE = f"piece long, {SUM}"
_LEGAL = ("su", "ua", "au")


def joined(a: dict, b: dict) -> dict:
    """Sum of two neighbouring pieces of one conversation."""
    out = {k: a[k] + b[k] for k in ("n", "blank", "duplicate", "truncated")}
    out["illegal"] = a["illegal"] + b["illegal"] + (a["last_role"] + b["first_role"] not in _LEGAL)
    known = [x for x in (a, b) if x["turns"]]
    out["least"], out["most"] = (f((x[k] for x in known), default=None) for f, k in ((min, "least"), (max, "most")))
    out["turns"] = a["turns"] + b["turns"] - (a["turns"] > 0 and b["turns"] > 0 and a["last_turn"] == b["first_turn"])
    out |= {"first_turn": known[0]["first_turn"] if known else None, "last_turn": known[-1]["last_turn"] if known else None, "first_role": a["first_role"], "last_role": b["last_role"]}
    m = times(*(_matrix_of(x) for x in (a, b)))
    return out | _flat(m)


def _flat(m: Matrix) -> dict:
    cells = [c for row in m for c in row]
    return {"costs": [None if c is None else c[0] for c in cells], "audits": [None if c is None else c[1] for c in cells]}


def _matrix_of(x: dict) -> Matrix:
    cells = [None if a is None else (int(c), a) for c, a in zip(x["costs"], x["audits"], strict=True)]
    return tuple(tuple(cells[4 * i : 4 * i + 4]) for i in range(4))


class _Piece:
    """What a task knows of the conversation that it is reading."""

    def __init__(self) -> None:
        self.product, self.sum = Product(), dict.fromkeys(SUMS[:5], 0) | {"turns": 0, "least": None, "most": None, "first_turn": None, "last_turn": None, "first_role": None, "last_role": None}

    def add(self, number: int | None, role: str, fault: str, times_here: int) -> None:
        s, initial = self.sum, role[:1]
        if s["first_role"] is None:
            s["first_role"] = initial
        else:
            s["illegal"] += s["last_role"] + initial not in _LEGAL
        s["illegal"] += (times_here - 1) * (initial * 2 not in _LEGAL)
        s["last_role"] = initial
        s["n"] += times_here
        s["blank"] += times_here * (fault == "blank")
        s["duplicate"] += times_here * (fault == "duplicate") + (times_here - 1) * (fault not in ("blank", "duplicate"))
        s["truncated"] += fault == "truncated"
        if number is not None:
            if s["turns"] == 0:
                s["first_turn"] = s["least"] = number
            s["turns"] += s["turns"] == 0 or s["last_turn"] != number
            s["last_turn"] = s["most"] = number
        kind = {"blank": "d", "duplicate": "d", "truncated": "t"}.get(fault, "k")
        self.product.add((initial if initial in STEPS else "-") + kind, times_here - 1)

    def row(self) -> dict:
        return self.sum | _flat(self.product.total())


def _piece_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (conv, turn, role, fault, times, body) in order, with their piece and place; the last of a piece carries its sum.

    `edge` marks the first and last conversation of a task, the only ones that other tasks may have a part of.
    """
    piece, here, conv, seen, waiting = TaskContext.get().partitionId(), _Piece(), None, 0, None

    def given(batch: pa.RecordBatch, places: list[int], sums: list[dict | None]) -> pa.RecordBatch:
        n = batch.num_rows
        extra = [pa.array([piece] * n, pa.int64()), pa.array(places, pa.int64()), pa.array(sums, SUM_TYPE)]
        return pa.RecordBatch.from_arrays([*batch.columns, *extra], names=[*batch.schema.names, "piece", "place", "sum"])

    for batch in batches:
        if not batch.num_rows:
            continue
        places, sums = [], [None] * batch.num_rows
        convs = batch.column(0).to_pylist()
        for i, (c, number, role, fault, n) in enumerate(zip(convs, *(batch.column(k).to_pylist() for k in range(1, 5)), strict=True)):
            if seen and c != conv:
                done = here.row() | {"edge": seen == 1}
                if i:
                    sums[i - 1] = done
                else:
                    waiting[2][-1] = done
                here = _Piece()
            if not seen or c != conv:
                conv, seen = c, seen + 1
            places.append(here.sum["n"])
            here.add(number, role, fault, n)
        if waiting:
            yield given(*waiting)
        waiting = (batch, places, sums)
    if waiting:
        waiting[2][-1] = here.row() | {"edge": True}
        yield given(*waiting)


SUM_TYPE = pa.struct(
    [(k, pa.int64()) for k in SUMS[:10]] + [("first_role", pa.string()), ("last_role", pa.string()), ("costs", pa.list_(pa.int64())), ("audits", pa.list_(pa.string())), ("edge", pa.bool_())],
)


def _join_group(pieces: pa.Table) -> pa.Table:
    """Neighbouring pieces of one conversation as one."""
    pieces = pieces.sort_by("piece")
    total = reduce(joined, pieces.to_pylist())
    return pa.table([pieces.column("conv").slice(0, 1), pieces.column("piece").slice(0, 1), *(pa.array([total[c]], SUM_TYPE.field(c).type) for c in SUMS)], names=["conv", "piece", *SUMS])


def _tree(pieces: DataFrame, last: int, kind: str) -> DataFrame:
    """One row a conversation from its pieces (numbered to `last`): each round joins FAN neighbours."""
    width = 1
    while width <= last:
        width *= FAN
        pieces = pieces.groupBy("conv", F.floor(F.col("piece") / width).alias("group")).applyInArrow(_join_group, f"conv {kind}, {PIECE}")
    return pieces


def _best_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The cheapest way through each conversation, in place of its matrix."""
    for batch in batches:
        found = [best(_matrix_of({"costs": c, "audits": a})) for c, a in zip(batch["costs"].to_pylist(), batch["audits"].to_pylist(), strict=True)]
        rest = batch.drop_columns(["costs", "audits"])
        yield pa.RecordBatch.from_arrays([*rest.columns, pa.array([c for c, _ in found], pa.int64()), pa.array([a for _, a in found], pa.string())], names=[*rest.schema.names, "cost", "audit"])


def _slice_task(total: pa.Table, pieces: pa.Table) -> pa.Table:
    """Each piece's part of a conversation's audit, with how many turns are given out before it and whether a system turn leads."""
    pieces = pieces.sort_by("piece")
    audit = np.frombuffer(total.column("audit")[0].as_py().encode(), np.uint8)
    cut = np.concatenate(([0], np.flatnonzero(audit != ord("I"))[np.cumsum(pieces.column("n").to_numpy()) - 1] + 1))
    cut[-1] = len(audit)
    out = np.concatenate(([0], np.cumsum(audit != ord("D"))))
    parts = [audit[a:b].tobytes().decode() for a, b in zip(cut[:-1], cut[1:], strict=True)]
    leads = pa.array([bool((audit == ord("L")).any())] * len(parts))
    return pa.table([pieces.column("conv"), pieces.column("piece"), pa.array(parts, pa.string()), pa.array(out[cut[:-1]], pa.int64()), leads], names=["conv", "piece", "part", "before", "leads"])


def _given_turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each turn that a part of an audit gives out: its place in the repair, edit, role if set anew, and source row."""
    for batch in batches:
        for i, (piece, part, before, leads) in enumerate(zip(*(batch.column(k).to_pylist() for k in range(1, 5)), strict=True)):
            letters = np.frombuffer(part.encode(), np.uint8)
            turn_at = np.cumsum(letters != ord("I")) - 1
            stay = np.flatnonzero(letters != ord("D"))
            if not len(stay):
                continue
            slot = before + np.arange(len(stay))
            role = np.where((slot - leads) % 2 == 0, "user", "assistant")
            kept = np.isin(letters[stay], np.frombuffer(b"KL", np.uint8))
            source = np.where(letters[stay] == ord("I"), -1, turn_at[stay])
            edit = [chr(c) for c in np.where(letters[stay] == ord("L"), ord("K"), letters[stay])]
            n = len(stay)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array([i] * n)), pa.array([piece] * n, pa.int64()), pa.array(source, pa.int64()), pa.array(slot, pa.int64()), pa.array(edit), pa.array(role.astype(object), pa.string(), mask=kept)],
                names=["conv", "piece", "place", "slot", "edit", "set_role"],
            )


def repair(rows: DataFrame, conv: str = "conv_id", turn_number: str = "turn", role: str = "role", text: str = "text", times_given: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The cheapest repair of every conversation: (summaries, turns).

    A turn is blank (no word), a duplicate (its role and text stand earlier) or truncated (its last word does not end in
    `.`, `!` or `?`); the first that holds counts.  Keeping costs 0, a role set anew (user or assistant) 1, deleting 2
    (the only way for blank and duplicate turns), an empty turn put in 5, a truncated turn left 5 more.  The result's
    role initials are `(s?(ua)+)?`.

    Summaries, a row a conversation with a row left: conv, gaps (missing turn numbers), blank, duplicate, truncated,
    illegal (neighbours that may not follow one another), cost and audit (initials of the cheapest edits, the ASCII-least
    of equal cost).  Turns: conv, slot (from 0), edit, role, text.  Turns go by number, null numbers first, ties by role
    and the text's digest; a null role or text is one space; a null conversation is one of its own; an empty table gives empty ones;
    other columns are left out.  `times_given` names a column that says how often each row stands (null: once).
    """
    space = F.lit(" ")
    base = rows.select(
        named(conv).alias("conv"),
        named(turn_number).cast("long").alias("turn"),
        *(F.coalesce(named(c).cast("string"), space).alias(a) for c, a in ((role, "role"), (text, "body"))),
        (F.coalesce(named(times_given).cast("long"), F.lit(1)) if times_given else F.lit(1).cast("long")).alias("times"),
    ).withColumn("key", F.sha2("body", 256))
    same = base.groupBy("conv", "turn", "role", "key").agg(F.first("body").alias("body"), F.sum("times").alias("times"))
    # the first place of each role and text: joined by all that makes a row, so that no key has many
    at = F.min(F.struct(F.col("turn").isNotNull().alias("known"), "turn")).alias("at")
    first = base.groupBy("conv", "role", "key").agg(at).select(F.col("conv").alias("c"), F.col("at.turn").alias("t"), F.col("role").alias("r"), F.col("key").alias("k"), F.lit(True).alias("leads"))
    met = F.col("conv").eqNullSafe(F.col("c")) & F.col("turn").eqNullSafe(F.col("t")) & (F.col("role") == F.col("r")) & (F.col("key") == F.col("k"))
    fault = F.when(~F.col("body").rlike(WORD), "blank").when(F.col("leads").isNull(), "duplicate").when(~F.col("body").rlike(CLOSED), "truncated").otherwise("none")
    marked = same.join(first, met, "left").select("conv", "turn", "role", fault.alias("fault"), "times", "body", "key")
    order = ["conv", "turn", "role", "key"]
    dealt = marked.repartitionByRange(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order).drop("key")
    kind = dealt.schema["conv"].dataType.simpleString()
    whole_sum = ", ".join(": ".join(x.split(" ", 1)) for x in SUM.split(", "))
    table = saved(dealt.mapInArrow(_piece_task, f"conv {kind}, turn long, role string, fault string, times long, body string, piece long, place long, sum struct<{whole_sum}, edge: boolean>"), "turns")
    sums = table.where("sum IS NOT NULL").select("conv", "piece", "sum.*")
    last = table.agg(F.max("piece")).first()[0] or 0
    whole = _tree(sums.where("edge").drop("edge"), last, kind).unionByName(sums.where("NOT edge").drop("edge"))
    counts = ["blank", "duplicate", "truncated", "illegal", "least", "most", "turns"]
    totals = saved(whole.select("conv", *counts, "costs", "audits").mapInArrow(_best_task, f"conv {kind}, " + "".join(f"{c} long, " for c in counts) + "cost long, audit string"), "repairs")
    gaps = F.coalesce(F.col("most") - F.col("least") + 1 - F.col("turns"), F.lit(0)).alias("gaps")
    summaries = totals.select(F.col("conv").alias(conv), gaps, *counts[:4], "cost", F.translate("audit", "L", "K").alias("audit"))
    slices = totals.select("conv", "audit").groupBy("conv").cogroup(sums.select("conv", "piece", "n").groupBy("conv")).applyInArrow(_slice_task, f"conv {kind}, piece long, part string, before long, leads boolean")
    given = slices.mapInArrow(_given_turns, f"conv {kind}, piece long, place long, slot long, edit string, set_role string")
    source = table.select(F.col("conv").alias("c"), F.col("piece").alias("p"), F.col("place").alias("l"), F.col("role").alias("r"), "body")
    here = F.col("conv").eqNullSafe(F.col("c")) & (F.col("piece") == F.col("p")) & (F.col("place") == F.col("l"))
    turns = given.join(source, here, "left").select(F.col("conv").alias(conv), "slot", "edit", F.coalesce("set_role", "r").alias(role), F.coalesce("body", F.lit("")).alias(text))
    return summaries, turns


def damaged(rows: DataFrame, conv: str = "conv_id", turn_number: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The five faults that a checksum of conversation and turn plants: dropped, emptied, unpunctuated, repeated, given to the user.

    Nulls count as one space in the checksum, and a null role or text becomes one; `times` is how often a row stands.
    """
    space = F.lit(" ")
    key = F.concat_ws(":", *(F.coalesce(named(c).cast("string"), space) for c in (conv, turn_number)))
    fault = F.col("_fault")
    body = F.coalesce(named(text), space)
    out = rows.withColumn("_fault", F.crc32(key) % 20).where(fault != 0)
    return out.select(
        named(conv),
        named(turn_number),
        F.when(fault == 4, "user").otherwise(F.coalesce(named(role), space)).alias(role),
        F.when(fault == 1, "").when(fault == 2, F.regexp_replace(body, "[.!?]", "")).otherwise(body).alias(text),
        F.when(fault == 3, 2).otherwise(1).alias("times"),
    )


def _digest_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each conversation's lines, which come in order; only the digest under way is held."""
    conv, digest = None, None
    for batch in batches:
        out = []
        for i, (slot, line) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
            if slot == 0:
                if digest:
                    out.append((conv, digest))
                conv, digest = batch.column(0).slice(i, 1), hashlib.sha256()
            else:
                digest.update(b"\n")
            digest.update(line.encode())
        if out:
            yield _digest_batch(out)
    if digest:
        yield _digest_batch([(conv, digest)])


def _digest_batch(done: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.concat_arrays([c for c, _ in done]), pa.array([d.hexdigest() for _, d in done])], names=["conv", "digest"])


def digests(turns: DataFrame, conv: str = "conv_id", role: str = "role", text: str = "text") -> DataFrame:
    """conv and repaired_sha256 of a table of turns: `role:text` lines joined by newlines, one digest a conversation.

    A digest runs over its lines in order, so each conversation's lines pass through one task, streamed, never held.
    """
    lines = turns.select(named(conv).alias("conv"), "slot", F.concat(named(role), F.lit(":"), named(text)).alias("line"))
    kind = lines.schema["conv"].dataType.simpleString()
    out = lines.repartition("conv").sortWithinPartitions("conv", "slot").mapInArrow(_digest_task, f"conv {kind}, digest string")
    return out.select(F.col("conv").alias(conv), F.col("digest").alias("repaired_sha256"))
