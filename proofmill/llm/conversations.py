"""Conversation structure repair by signatures.

What the cheapest edits are depends on a conversation's roles and faults alone. A conversation becomes a signature of one
character a row; each different signature is solved once; the audits are joined back and replayed over the rows.

Solving is a memoised recursion on halves: what a piece of a signature does to the costs of what follows it is looked up
by the piece and those costs, and its edits by the piece, the state that it starts in and those costs. Pieces recur in
many signatures, and the depth is the logarithm of the length.

A row's place and faults depend on all earlier rows of its conversation, and so does the digest of the repaired text, so
the rows of one conversation are sorted and read by one task, with spill; a task holds one batch of them and the audit,
which is a value of the result. Signatures are put together from pieces of ``PIECE`` rows, made before the shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from proofmill.llm.common import map_batches, prepare, stage, staging

PIECE = 4096
#: Pieces of signatures up to this length are remembered, and so many of them at most.
MEMO_LENGTH, MEMO_LIMIT = 64, 200_000
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
BLANKS = " \t\n\x0b\x0c\r"

# States: nothing kept yet, the last was system, user, assistant. NEXT is the state after the role that must follow.
NONE, SYSTEM, USER, ASSISTANT = range(4)
NEXT = (USER, USER, ASSISTANT, USER)
ROLES = {USER: "user", ASSISTANT: "assistant"}
#: Cost of what must be inserted at the end, by state.
AT_END = (0, 2 * INSERT, INSERT, 0)
Costs = tuple[int, int, int, int]


def damage(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies): the rows as the damage leaves them; no copies means that a row is dropped."""
    shown = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    kind = F.crc32(F.encode(F.concat(shown[0], F.lit(":"), shown[1]), "UTF-8")) % 20
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    rows = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("kind") == 0, 0).when(F.col("kind") == 3, 2).otherwise(1)
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copies"))


def diagnose(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) to the same with pos, from 1, and each row's faults.

    blank, duplicate and truncated exclude each other in this order; illegal says that its role can't follow the one
    before. new_turn marks the first row of each turn, code is the row's character of the signature.
    """
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")
    rows = rows.withColumns({"pos": F.row_number().over(order), "last_turn": F.lag("turn").over(order), "last_role": F.lag("role").over(order)})
    seen = F.row_number().over(Window.partitionBy("conv_id", "role", "text").orderBy("pos")) > 1
    rows = rows.withColumns({"seen": seen, "trimmed": F.rtrim(F.col("text"), F.lit(BLANKS)), "initial": F.left("role", F.lit(1))})
    rows = rows.withColumn("blank", F.col("trimmed") == "").withColumn("duplicate", ~F.col("blank") & F.col("seen"))
    rows = rows.withColumn("truncated", ~F.col("blank") & ~F.col("duplicate") & ~F.right("trimmed", F.lit(1)).isin(".", "!", "?"))
    letter = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("o")
    code = F.when(F.col("blank") | F.col("duplicate"), "-").when(F.col("truncated"), F.upper(letter)).otherwise(letter)
    illegal = F.col("last_role").isNotNull() & ~F.concat(F.left("last_role", F.lit(1)), F.col("initial")).isin("su", "ua", "au")
    new_turn = F.col("turn").isNotNull() & ~F.col("turn").eqNullSafe(F.col("last_turn"))
    return rows.select("conv_id", "turn", "pos", "role", "text", "blank", "duplicate", "truncated", illegal.alias("illegal"), new_turn.alias("new_turn"), code.alias("code"))


def signatures(rows: DataFrame) -> DataFrame:
    """A row per conversation: conv_id, signature and the sums of its rows' faults."""
    sums = ["blank", "duplicate", "truncated", "illegal", "new_turn"]
    joined = lambda at, what: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(at, what))), lambda x: x[what]), "")
    parts = rows.groupBy("conv_id", F.expr(f"(pos - 1) div {PIECE}").alias("part")).agg(joined("pos", "code").alias("piece"), *[F.count_if(c).alias(c) for c in sums], F.min("turn").alias("first"), F.max("turn").alias("last"))
    whole = parts.groupBy("conv_id").agg(joined("part", "piece").alias("signature"), *[F.sum(c).alias(c) for c in sums], F.min("first").alias("first"), F.max("last").alias("last"))
    return whole.withColumn("gaps", F.coalesce(F.col("last").cast("long") - F.col("first").cast("long") + 1 - F.col("new_turn"), F.lit(0).cast("long"))).drop("first", "last", "new_turn")


class Solver:
    """Cheapest edits of signatures, by recursion on halves with a bounded memory."""

    def __init__(self) -> None:
        self._after: dict[tuple[str, Costs], tuple[Costs, int]] = {}
        self._edits: dict[tuple[str, int, Costs], tuple[str, int]] = {}

    @staticmethod
    def moves(row: str, state: int, after: Costs) -> list[tuple[str, int, int]]:
        """(edit, cost with what follows, state after) of the edits that use the row up, in ASCII order."""
        out, role, more = [("D", DELETE + after[state], state)], row.lower(), TRUNCATED * row.isupper()
        if row != "-":
            to = SYSTEM if role == "s" and state == NONE else NEXT[state] if role == "--ua"[NEXT[state]] else None
            if to is not None:
                out.append(("K", KEEP + more + after[to], to))
            out.append(("R", REROLE + more + after[NEXT[state]], NEXT[state]))
        return out

    @classmethod
    def before(cls, row: str, after: Costs) -> Costs:
        """The least cost from each state on, with inserts before the row."""
        here = [min(cost for _, cost, _ in cls.moves(row, state, after)) for state in range(4)]
        return tuple(min(here[s], INSERT + here[NEXT[s]], 2 * INSERT + here[NEXT[NEXT[s]]]) for s in range(4))

    def after(self, piece: str, costs: Costs) -> tuple[Costs, int]:
        """The costs from each state at the start of a piece, given those at its end: what is over the least, and the least."""
        known = self._after.get((piece, costs))
        if known:
            return known
        if len(piece) == 1:
            found = self.before(piece, costs)
            least = min(found)
        else:
            left, right = self.halves(piece)
            middle, one = self.after(right, costs)
            found, two = self.after(left, middle)
            least = one + two + min(found)
        low = min(found)
        return self._remember(self._after, piece, (piece, costs), (tuple(c - low for c in found), least))

    def edits(self, piece: str, state: int, costs: Costs) -> tuple[str, int]:
        """The ASCII-least of the cheapest edits from a state on, given the costs at the piece's end, and the state there."""
        known = self._edits.get((piece, state, costs))
        if known:
            return known
        if len(piece) == 1:
            out, total = "", self.before(piece, costs)
            at = state
            while True:
                options = self.moves(piece, at, costs)
                options.insert(1, ("I", INSERT + total[NEXT[at]], NEXT[at]))
                edit, at = next((name, to) for name, cost, to in options if cost == total[at])
                out += edit
                if edit != "I":
                    break
            found = out, at
        else:
            left, right = self.halves(piece)
            one, at = self.edits(left, state, self.after(right, costs)[0])
            two, at = self.edits(right, at, costs)
            found = one + two, at
        return self._remember(self._edits, piece, (piece, state, costs), found)

    def solve(self, signature: str) -> tuple[str, int]:
        """(audit, cost)."""
        if not signature:
            return "", 0
        over, least = self.after(signature, AT_END)
        audit, state = self.edits(signature, NONE, AT_END)
        return audit + "I" * (AT_END[state] // INSERT), least + over[NONE]

    @staticmethod
    def halves(piece: str) -> tuple[str, str]:
        half = 1 << (len(piece) - 1).bit_length() - 1
        return piece[:half], piece[half:]

    @staticmethod
    def _remember(memo: dict, piece: str, key: tuple, value: tuple) -> tuple:
        if len(piece) <= MEMO_LENGTH:
            if len(memo) >= MEMO_LIMIT:
                memo.clear()
            memo[key] = value
        return value


def audits(known: DataFrame) -> DataFrame:
    """(signature) to (signature, audit, cost)."""
    solver = Solver()

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [solver.solve(x) for x in batch.column(0).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([a for a, _ in found], pa.string()), pa.array([c for _, c in found], pa.int64())], ["signature", "audit", "cost"])

    return map_batches(known.select("signature"), one, "signature string, audit string, cost long")


class Replay:
    """One conversation's audit, played over its rows in order."""

    def __init__(self, audit: str) -> None:
        self.audit, self.at, self.state, self.hash, self.first = audit, 0, NONE, hashlib.sha256(), True

    def _add(self, role: str, text: str) -> None:
        self.hash.update(f"{'' if self.first else '\n'}{role}:{text}".encode())
        self.first = False

    def _inserts(self) -> None:
        while self.audit[self.at : self.at + 1] == "I":
            self.state = NEXT[self.state]
            self._add(ROLES[self.state], "")
            self.at += 1

    def row(self, role: str, text: str) -> None:
        self._inserts()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "D":
            return
        self.state = SYSTEM if edit == "K" and role[:1] == "s" else NEXT[self.state]
        self._add(role if edit == "K" else ROLES[self.state], text)

    def digest(self) -> str:
        self._inserts()
        return self.hash.hexdigest()


def replay(heads: DataFrame, rows: DataFrame) -> DataFrame:
    """Each conversation's head (conv_id, audit and more) with repaired_sha256."""
    names = heads.columns
    both = heads.withColumn("pos", F.lit(0)).unionByName(rows.select("conv_id", "pos", "role", "text"), allowMissingColumns=True)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in heads.schema) + ", repaired_sha256 string"

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, head = None, None
        for batch in batches:
            starts = {i for i, pos in enumerate(batch.column("pos").to_pylist()) if pos == 0}
            cuts = sorted({0, *starts})
            for at, end in zip(cuts, [*cuts[1:], batch.num_rows], strict=True):
                if at in starts:
                    if now:
                        yield with_digest(head, now)
                    head = batch.slice(at, 1)
                    now = Replay(head.column("audit")[0].as_py())
                    at += 1
                for role, text in zip(batch.column("role").slice(at, end - at).to_pylist(), batch.column("text").slice(at, end - at).to_pylist(), strict=True):
                    now.row(role, text)
        if now:
            yield with_digest(head, now)
        pa.default_memory_pool().release_unused()

    def with_digest(head: pa.RecordBatch, now: Replay) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*(head.column(c) for c in names), pa.array([now.digest()])], [*names, "repaired_sha256"])

    prepare(heads.sparkSession)
    return both.repartition("conv_id").sortWithinPartitions("conv_id", "pos").mapInArrow(over, schema)


def repair(conversations: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256), a row per conv_id.

    The rows of (conv_id, turn, role, text) are damaged, put in order of turn, nulls first, diagnosed and repaired. Null
    roles and texts count as one space; rows without a conv_id are one conversation. Rows of one turn are ordered by role
    and text, so equal rows stand together and all but the first are duplicates. An empty role has no initial and can
    neither be kept nor follow another. Conversations of which the damage leaves nothing have zeros, an empty audit and
    the digest of nothing. Other columns are ignored; an empty table gives no rows.
    """
    with staging(conversations.sparkSession):
        damaged = damage(conversations)
        rows = damaged.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), "copies")))
        rows = stage(diagnose(rows.select("conv_id", "turn", "role", "text")), "rows")
        zeros = {"signature": F.lit(""), **{c: F.lit(0).cast("long") for c in ("blank", "duplicate", "truncated", "illegal", "gaps")}}
        every = signatures(rows).unionByName(conversations.select("conv_id").distinct().withColumns(zeros))
        convs = every.groupBy("conv_id").agg(F.max("signature").alias("signature"), *[F.sum(c).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal")])
        convs = stage(convs, "conversations")
        solved = stage(audits(convs.select("signature").distinct()), "audits")
        heads = convs.join(solved, "signature").select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")
        return stage(replay(heads, rows), "repaired", keep=True)
