"""Conversation repair against a plain version that tries all edits, on the given table and on awkward rows."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib

import pytest

from proofmill.llm import conversations, queries
from tests.conftest import DATA

ACCEPTED = re.compile(r"(s?(ua)+)?")
SCHEMA = "conv_id long, turn long, role string, text string, pos long, code string, copies string, signature long, audit int, cost string"


def by_trial(signature: str) -> tuple[int, str]:
    """The cheapest (cost, audit) among all edits with up to two inserts before each row and at the end."""
    best = None
    edits = ["D" if c == "-" else "DKR" for c in signature]
    gaps = list(itertools.product(range(3), repeat=len(signature) + 1))
    for chosen in itertools.product(*edits):
        for inserts in gaps:
            audit, roles, cost = "", "", 0
            for n, edit, row in itertools.zip_longest(inserts, chosen, signature):
                for _ in range(n):
                    roles += "a" if roles[-1:] == "u" else "u"
                audit, cost = audit + "I" * n + (edit or ""), cost + 3 * n
                if edit == "K":
                    roles += row.lower()
                elif edit == "R":
                    roles += "a" if roles[-1:] == "u" else "u"
                cost += {"D": 4, "R": 3}.get(edit, 0) + (3 if edit in ("K", "R") and row.isupper() else 0)
            if ACCEPTED.fullmatch(roles) and (best is None or (cost, audit) < best):
                best = cost, audit
    return best


def in_order(signature: str) -> tuple[int, str]:
    """The same for any length, row by row: the best (cost, audit) by the last role."""
    best = {"": (0, "")}

    def inserted(best: dict) -> dict:
        for _ in range(3):
            for last, (cost, audit) in list(best.items()):
                to, new = "a" if last == "u" else "u", (cost + 3, audit + "I")
                best[to] = min(best.get(to, new), new)
        return best

    for row in signature:
        after: dict = {}
        for last, (cost, audit) in inserted(best).items():
            follow, more = "a" if last == "u" else "u", 3 * row.isupper()
            moves = [("D", 4, last)] + ([("R", 3 + more, follow)] if row != "-" else [])
            if row.lower() == follow or row.lower() == "s" and last == "":
                moves.append(("K", more, row.lower()))
            for edit, price, to in moves:
                new = (cost + price, audit + edit)
                after[to] = min(after.get(to, new), new)
        best = after
    return min(v for k, v in inserted(best).items() if k in ("", "a"))


def plain(rows: list[tuple]) -> dict:
    """The contract row by row, with ``in_order`` for the edits."""
    by_conv: dict = {}
    for conv, turn, role, text in rows:
        kept = by_conv.setdefault(conv, [])
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        kept += [(turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    out = {}
    for conv, kept in by_conv.items():
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        signature, faults, seen = "", [0, 0, 0], set()
        for _, role, text in kept:
            letter = role[0] if role[:1] in ("s", "u", "a") and role else "o"
            body = text.rstrip(" \t\n\x0b\x0c\r")
            fault = 0 if not body else 1 if (role, text) in seen else 2 if body[-1] not in ".!?" else None
            seen.add((role, text))
            if fault is not None:
                faults[fault] += 1
            signature += "-" if fault in (0, 1) else letter.upper() if fault == 2 else letter
        turns = [t for t, _, _ in kept if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(kept))
        cost, audit = in_order(signature)
        lines, left, last = [], iter(kept), ""
        for edit in audit:
            follow = "a" if last == "u" else "u"
            _, role, text = (None, "", "") if edit == "I" else next(left)
            if edit != "D":
                last = role[:1] if edit == "K" else follow
                lines.append(f"{role if edit == 'K' else {'u': 'user', 'a': 'assistant'}[follow]}:{text}")
        out[conv] = (gaps, *faults, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def found(df) -> dict:  # noqa: ANN001
    rows = [tuple(r) for r in df.collect()]
    assert len({r[0] for r in rows}) == len(rows)
    return {r[0]: r[1:] for r in rows}


def test_solver_against_all_edits():  # noqa: ANN201
    solver, rng = conversations.Solver(), random.Random(4)
    short = ["".join(x) for n in (1, 2) for x in itertools.product("-suaoSUAO", repeat=n)]
    for signature in ["", *short, *("".join(rng.choices("-suaoSUAO", k=k)) for k in (3,) * 60 + (4,) * 12)]:
        audit, cost = solver.solve(signature)
        assert (cost, audit) == by_trial(signature) == in_order(signature), signature


def test_solver_on_long_signatures():  # noqa: ANN201
    rng = random.Random(9)
    for k in (63, 64, 65, 700, 5000):
        signature = "".join(rng.choices("-suaoSUAO", [2, 1, 9, 9, 1, 1, 2, 2, 1], k=k))
        audit, cost = conversations.Solver().solve(signature)
        assert (cost, audit) == in_order(signature)
    audit, cost = conversations.Solver().solve("ua" * 200_000)
    assert cost == 0 and audit == "K" * 400_000


def test_given_conversations(spark):  # noqa: ANN001, ANN201
    table = spark.read.parquet(f"{DATA}/conversations.parquet").select("conv_id", "turn", "role", "text")
    got = queries.QUERIES["op11_conversation_repair"](spark, DATA)
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert found(got) == plain([tuple(r) for r in table.collect()])


@pytest.mark.parametrize("piece", [4096, 3])
def test_awkward_conversations(spark, monkeypatch, piece):  # noqa: ANN001, ANN201
    monkeypatch.setattr(conversations, "PIECE", piece)
    rng = random.Random(2)
    texts = ["Yes.", "No", "", " \t\n", None, "What?!", "ends. \n", "ünïcode 漢字。", "x" * 300_000 + ".", "a\nb."]
    roles = ["user", "assistant", "system", "user", "assistant", None, "", "tool", "USER", "Ünknown"]
    rows = [(c, rng.choice([None, *range(-2, 9)]), rng.choice(roles), rng.choice(texts)) for c in [None, *range(40)] for _ in range(rng.randrange(1, 12))]
    rows += [(50, None, "user", "Only nulls."), (50, None, "assistant", "Fine.")] + [(51, 7, "user", "Same.")] * 5
    rows += [(52, t, "user" if t % 2 else "assistant", f"Turn {t}.") for t in range(1, 900)]
    rows += [(c, 0, "user", "Goes.") for c in range(100, 160)]  # some of these lose all rows
    want = plain(rows)
    assert any(v[6] == "" and v[7] == hashlib.sha256(b"").hexdigest() for v in want.values())
    df = spark.createDataFrame([(*r, 1, "k", "c", 2, 3, "s") for r in rows], SCHEMA)
    assert found(conversations.repair(df)) == want
    assert found(conversations.repair(df.limit(0))) == {}
