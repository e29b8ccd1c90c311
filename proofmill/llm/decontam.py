"""Benchmark decontamination by pigeonhole edit matching.

An item of n characters may be found with k = n * rate edits. It is cut into k + 1 pieces: in any text within k edits
one piece at least is untouched. An Aho-Corasick automaton finds the pieces' exact hits, hits on nearby diagonals
share a window, the q-gram lemma drops windows that cannot be within k edits, and Myers' bit-parallel distance decides.
Texts and items are compared lower-cased, with runs of ASCII punctuation and white space as one space.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofmill.llm.common import map_batches

RATE_PERCENT = 8
#: Bytes of items whose automaton is broadcast at once; a larger benchmark takes several passes over the documents.
BLOCK_BYTES = 4_000_000
Q = 4
_SPACED = bytes(c if chr(c).isalnum() or c >= 128 else 32 for c in range(256))


def normal(text: str | None) -> bytes:
    """Lower case, punctuation as spaces, one space at each end. Empty if nothing is left."""
    words = (text or "").lower().encode("utf-8", "surrogatepass").translate(_SPACED).split()
    return b" " + b" ".join(words) + b" " if words else b""


def myers(pattern: bytes, text: bytes) -> tuple[int, int]:
    """The least edit distance of the pattern to any substring of the text, and where the first such one ends."""
    m = len(pattern)
    eq: dict[int, int] = {}
    for i, c in enumerate(pattern):
        eq[c] = eq.get(c, 0) | 1 << i
    full, high = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best = full, 0, m, (m, 0)
    for j, c in enumerate(text, 1):
        e = eq.get(c, 0)
        xv = e | mv
        xh = (((e & pv) + pv) ^ pv) | e
        ph, mh = mv | (full & ~(xh | pv)), pv & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
            if score < best[0]:
                best = score, j
        ph, mh = ph << 1 & full, mh << 1 & full
        pv, mv = mh | (full & ~(xv | ph)), ph & xv
    return best


class Items:
    """Items of one block, ready for search."""

    def __init__(self, rows: list[tuple[int, str | None]], rate_percent: int) -> None:
        self.items = [(i, p, len(p) * rate_percent // 100, [p[x : x + Q] for x in range(0, len(p) - Q + 1, Q)]) for i, t in rows if (p := normal(t))]
        pieces: dict[str, list[tuple[int, int]]] = {}
        for at, (_, p, k, _) in enumerate(self.items):
            ends = [len(p) * x // (k + 1) for x in range(k + 2)]
            for a, b in zip(ends, ends[1:], strict=False):
                pieces.setdefault(p[a:b].decode("latin-1"), []).append((at, b - 1))
        self.automaton = ahocorasick.Automaton()
        for piece, where in pieces.items():
            self.automaton.add_word(piece, where)
        self.automaton.make_automaton()

    def find(self, text: str | None) -> Iterator[tuple[int, int, int, int]]:
        """(item id, distance, budget, end) of each item within its budget in the text."""
        body = normal(text)
        if not body or not self.items:
            return
        starts: dict[int, list[int]] = {}
        for end, where in self.automaton.iter(body.decode("latin-1")):
            for at, offset in where:
                starts.setdefault(at, []).append(end - offset)
        for at, diagonals in starts.items():
            item, p, k, grams = self.items[at]
            best = (k + 1, 0)
            diagonals.sort()
            lo = hi = diagonals[0]
            for d in [*diagonals[1:], None]:
                if d is not None and d - hi <= 2 * k:
                    hi = d
                    continue
                a, b = max(0, lo - k), hi + len(p) + k
                window = body[a:b]
                # The grams don't overlap, so k edits spoil k of them at most.
                if sum(map(window.__contains__, grams)) >= len(grams) - k:
                    got, end = myers(p, window)
                    best = min(best, (got, a + end))
                lo = hi = d
            if best[0] <= k:
                yield item, best[0], k, best[1]


def _blocks(benchmark: DataFrame, item_id: str, item_text: str) -> Iterator[Broadcast]:
    """The items in broadcast blocks of about ``BLOCK_BYTES``."""
    items = benchmark.select(F.col(item_id).cast("long").alias("id"), F.col(item_text).alias("text")).where(F.octet_length("text") > 0)
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // BLOCK_BYTES))
    for block in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == block)
        yield benchmark.sparkSession.sparkContext.broadcast([(r.id, r.text) for r in part.collect()])  # about BLOCK_BYTES


def _searcher(rows: Broadcast, rate_percent: int, least: int) -> Callable[[], Items]:
    """The items of a block, made ready once in a worker."""
    made: list[Items] = []

    def items() -> Items:
        if not made:
            made.append(Items([(i, t) for i, t in rows.value if len(normal(t)) >= least], rate_percent))
        return made[0]

    return items


def contaminated(docs: DataFrame, benchmark: DataFrame, rate_percent: int = RATE_PERCENT, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", least: int = 0) -> DataFrame:
    """(doc_id, item_id, distance, budget, match_end) for each document and item found in it within the budget.

    A match needs the item's outer spaces, so it begins and ends at words but for edits. Null, empty and
    punctuation-only texts and items match nothing, nor do items of under ``least`` bytes of normalised text,
    if a caller asks for that: an item of under 13 bytes has no budget, so it matches as whole words only. An empty table on either side
    gives no rows. Repeated rows each give their own. ``match_end`` is a byte offset in the normalised text. Other columns
    are ignored. A benchmark of several blocks takes a pass over the documents for each.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    found = []
    for rows in _blocks(benchmark, item_id, item_text):
        items = _searcher(rows, rate_percent, least)

        def one(batch: pa.RecordBatch, items=items) -> pa.RecordBatch:
            hits = [(d, *hit) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for hit in items().find(t)]
            columns = list(zip(*hits, strict=True)) or [()] * 5
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "item_id", "distance", "budget", "match_end"])

        found.append(map_batches(texts, one, "doc_id long, item_id long, distance long, budget long, match_end long"))
    return reduce(DataFrame.unionAll, found)


def clean(docs: DataFrame, benchmark: DataFrame, rate_percent: int = RATE_PERCENT, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", least: int = 0) -> DataFrame:
    """The rows of ``docs`` in which no item is found, with all their columns. Each row is judged by its own text, whatever
    its id, on its way through: nothing is joined or shuffled."""
    for rows in _blocks(benchmark, item_id, item_text):
        items, at = _searcher(rows, rate_percent, least), docs.columns.index(text_col)

        def one(batch: pa.RecordBatch, items=items, at=at) -> pa.RecordBatch:
            return batch.filter(pa.array([next(items().find(t), None) is None for t in batch.column(at).to_pylist()], pa.bool_()))

        docs = map_batches(docs, one, docs.schema)
    return docs
