"""Repeated passages: paragraph MinHash banding, exact verification, components.

A paragraph is a line of ``PARAGRAPH_WORDS`` words or more. Paragraphs with the same words are one unit; units are
banded with 12 bands of 3 minima, which lose a pair at the threshold with probability 2e-4, and colliding ones are
verified by the exact Jaccard similarity of their sets of five-word shingles. Components of the links are the clusters.
A passage that sits inside a longer paragraph, or takes several short ones, does not show there. So every window of
``RUN_WORDS`` words that stands word for word in two documents is found too, wherever it begins or ends: windows go
under the least hash of their ``GRAM_WORDS`` words in a row, those of one such gram in a row as one stretch, and where
stretches of a gram differ the windows are compared one by one. Windows that overlap or touch are joined into runs. Of
each cluster the smallest document keeps its passage; in runs this is decided for each window by itself.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofmill.llm.common import _ADD, _MULTIPLIERS, _ODD, BATCH_ROWS, _mix, map_batches, stage, staging, utf8
from proofmill.llm.common import _words as _memo
from proofmill.llm.near_dup import link

WIDTH, PERCENT, BANDS, ROWS = 5, 80, 12, 3
PARAGRAPH_WORDS, RUN_WORDS, GRAM_WORDS = 45, 40, 10
#: A shared run takes fewer words than this of a line only if they are all of it.
LINE_WORDS = 4
_SPACE = np.isin(np.arange(256), list(b" \t\n\x0b\f\r")).astype(np.int8)
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
#: Shingles hashed at once; the block of their hashes stays in the processor's cache.
_BLOCK = 4096


class _Words:
    """The words of some texts in a row: hash, text they stand in, start and end, and where lines begin."""

    def __init__(self, texts: list[bytes]) -> None:
        whole = b"".join(t + b"\n" for t in texts).lower()
        raw = np.frombuffer(whole, np.uint8)
        edge = np.diff(_SPACE[raw], prepend=np.int8(1))
        first, last = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        self.hashes = np.fromiter(map(_memo.__getitem__, whole.split()), np.uint64, len(first))
        begins = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
        inner = np.flatnonzero((raw & 0xC0) == 0x80)
        points = (lambda x: x - np.searchsorted(inner, x)) if len(inner) else (lambda x: x)
        self.row = np.searchsorted(begins, first, side="right") - 1
        base = points(begins)[self.row]
        self.start, self.end = points(first) - base, points(last) - base
        #: The first word of each text.
        self.before = np.searchsorted(self.row, np.arange(len(texts)))
        fresh = np.zeros(len(first) + 1, bool)
        fresh[0] = True
        fresh[np.searchsorted(first, np.flatnonzero(raw == 10))] = True
        self.lines = np.flatnonzero(fresh[:-1])
        self._sums: list[tuple[np.ndarray, np.ndarray]] = []

    def hash_of(self, at: np.ndarray, n: np.ndarray | int, which: int = 0) -> np.ndarray:
        """Hashes of ``n`` words from each place on, of one of two families."""
        while len(self._sums) <= which:
            base = _BASES[len(self._sums)]
            power = np.multiply.accumulate(np.full(len(self.hashes), base, np.uint64))
            back = np.multiply.accumulate(np.full(len(self.hashes), pow(base, -1, 1 << 64), np.uint64))
            self._sums.append((np.concatenate((np.zeros(1, np.uint64), np.cumsum(self.hashes * power, dtype=np.uint64))), back))
        sums, back = self._sums[which]
        return _mix((sums[at + n] - sums[at]) * back[at])

    def paragraphs(self, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First word, word after the last one, and rank in its text of each line of ``least`` words or more."""
        to = np.append(self.lines[1:], len(self.hashes))[: len(self.lines)]
        long_ = to - self.lines >= least
        a, r = self.lines[long_], self.row[self.lines[long_]]
        return a, to[long_], np.arange(len(a)) - np.searchsorted(r, r)

    def keys(self, a: np.ndarray, b: np.ndarray) -> list[bytes]:
        """128 bits that name the words from a to b."""
        both = np.stack([self.hash_of(a, b - a), self.hash_of(a, b - a, 1) + (b - a).astype(np.uint64)], axis=1)
        return [x.tobytes() for x in both]

    def shingles(self, width: int) -> np.ndarray:
        """Of each place the hash of ``width`` words from there on."""
        n = max(0, len(self.hashes) - width + 1)
        total = np.zeros(n, np.uint64)
        for i in range(width):
            total += self.hashes[i : i + n] * _MULTIPLIERS[i]
        return _mix(total)


def _minima(shingles: np.ndarray, a: np.ndarray, b: np.ndarray, hashes: int) -> np.ndarray:
    """MinHash of the shingles from a to b, a row per pair. Pieces of a block are reduced at once."""
    out = np.full((len(a), hashes), 0xFFFFFFFF, np.uint32)
    if not len(a):
        return out
    # Cut into pieces that do not cross the border of a block.
    size = b - a
    at = np.repeat(a - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())
    owner = np.repeat(np.arange(len(a)), size)
    high = (shingles[at] >> np.uint64(32)).astype(np.uint32)
    for lo in range(0, len(high), _BLOCK):
        own = owner[lo : lo + _BLOCK]
        heads = np.flatnonzero(np.diff(own, prepend=-1))
        hashed = high[lo : lo + _BLOCK] * _ODD[:hashes]
        hashed += _ADD[:hashes]
        least = np.minimum.reduceat(hashed, heads, axis=1).T
        out[own[heads]] = np.minimum(out[own[heads]], least)
    return out


def _paragraphs(docs: DataFrame, least: int) -> DataFrame:
    """A row per paragraph: doc_id, ord (its rank), start, end, words, key, sig."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        w = _Words(utf8(batch.column(1)))
        a, b, rank = w.paragraphs(least)
        sig = _minima(w.shingles(WIDTH), a, b - WIDTH + 1, BANDS * ROWS).astype("<u4")
        places = [pa.array(x.astype(np.int32)) for x in (rank, w.start[a], w.end[b - 1], b - a)]
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(w.row[a])), *places, pa.array(w.keys(a, b), pa.binary()), pa.array([x.tobytes() for x in sig], pa.binary())], ["doc_id", "ord", "start", "end", "words", "key", "sig"])

    return map_batches(docs, one, "doc_id long, ord int, start int, end int, words int, key binary, sig binary", rows=BATCH_ROWS // 4)


def _sets(docs: DataFrame, least: int) -> DataFrame:
    """(doc_id, text, wanted: [(ord, uid, key)]) to (uid, grams) for the paragraphs wanted."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        w = _Words(utf8(batch.column(1)))
        a, b, rank = w.paragraphs(least)
        row, keys, all_ = w.row[a], w.keys(a, b), w.shingles(WIDTH)
        place = {(r, k): i for i, (r, k) in enumerate(zip(row.tolist(), rank.tolist(), strict=True))}
        uids, grams = [], []
        for r, wanted in enumerate(batch.column(2).to_pylist()):
            for x in wanted:
                i = place.get((r, x["ord"]))
                if i is not None and keys[i] == x["key"]:
                    uids.append(x["uid"]), grams.append(np.unique(all_[a[i] : b[i] - WIDTH + 1]).tobytes())
        return pa.RecordBatch.from_arrays([pa.array(uids, pa.int64()), pa.array(grams, pa.binary())], ["uid", "grams"])

    return map_batches(docs.select("doc_id", "text", "wanted"), one, "uid long, grams binary", rows=BATCH_ROWS // 4)


def paragraph_clusters(docs: DataFrame, least: int = PARAGRAPH_WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, start, end, words, component_id, kept) for paragraphs whose cluster has two documents or more, from the
    first word to the last. Null and empty texts have none; rows that repeat an id are one document."""
    with staging(docs.sparkSession):
        found = stage(_paragraphs(docs, least), "paragraphs")
        per_key = found.groupBy("key").agg(F.min(F.struct("doc_id", "ord")).alias("first"), F.max("doc_id").alias("hi"), F.first("words").alias("n"), F.first("sig").alias("sig"))
        reps = stage(per_key.select(F.monotonically_increasing_id().alias("uid"), "key", "n", "sig", F.col("first.doc_id").alias("doc_id"), F.col("first.ord").alias("ord"), "hi"), "units")

        def sets_of(uids: DataFrame) -> DataFrame:
            wanted = reps.join(uids, "uid", "left_semi").groupBy("doc_id").agg(F.collect_list(F.struct("ord", "uid", "key")).alias("wanted"))
            return _sets(docs.join(wanted, "doc_id"), least).dropDuplicates(["uid"])

        labels = link(reps.select("uid", "n", "sig"), sets_of, percent, BANDS, ROWS, sequential=False)
        of_key = stage(reps.join(labels, "uid", "left").select("key", F.coalesce("label", "uid").alias("label"), "doc_id", "hi"), "of_key")
        clusters = of_key.groupBy("label").agg(F.min("doc_id").alias("lo"), F.max("hi").alias("hi")).where("lo < hi")
        repeated = of_key.select("key", "label").join(clusters, "label").select("key", "lo")
        rows = found.select("doc_id", "start", "end", "words", "key").join(repeated, "key")
        places = [F.col(c).cast("long").alias(c) for c in ("start", "end", "words")]
        rows = rows.select("doc_id", *places, F.col("lo").alias("component_id"), (F.col("doc_id") == F.col("lo")).alias("kept"))
        return stage(rows, "clusters", keep=True)


class _Windows:
    """The windows of ``width`` words of some texts, cut into stretches whose windows have the same rarest gram.

    The rarest gram is the one of least hash of all the ``gram`` words in a row that a window has, so equal windows have
    the same one wherever they stand. A window's number is that of its first word.
    """

    def __init__(self, words: _Words, width: int, gram: int) -> None:
        row, n = words.row, len(words.hashes)
        empty = np.empty(0, np.int64)
        self.head, self.tail, self.low = empty, empty, np.empty(0, np.uint64)
        if n < width:
            return
        low, step, span = words.hash_of(np.arange(n - gram + 1), gram), 1, width - gram + 1
        while 2 * step <= span:
            low, step = np.minimum(low[:-step], low[step:]), 2 * step
        if step < span:
            low = np.minimum(low[: step - span], low[span - step :])
        whole = row[: n - width + 1] == row[width - 1 :]
        joined = whole[1:] & whole[:-1] & (low[1:] == low[:-1])
        self.head = np.flatnonzero(whole & np.concatenate(([True], ~joined)))
        self.tail = np.flatnonzero(whole & np.concatenate((~joined, [True])))
        self.low = low[self.head]


def _stretches(docs: DataFrame, run_words: int, gram: int) -> DataFrame:
    """A row per stretch of windows: doc_id, the words from a to b, start, end, key and content. Stretches with equal
    windows have equal keys; the content tells a stretch from others of its key."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        w = _Words(utf8(batch.column(1)))
        x = _Windows(w, run_words, gram)
        a, b = x.head, x.tail + run_words
        places = [pa.array(c.astype(np.int32)) for c in (a - w.before[w.row[a]], b - w.before[w.row[a]], w.start[a], w.end[b - 1])]
        content = w.hash_of(a, b - a).astype(np.uint32).view(np.int32)
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(w.row[a])), *places, pa.array(x.low.view(np.int64)), pa.array(content)], ["doc_id", "a", "b", "start", "end", "key", "content"])

    return map_batches(docs, one, "doc_id long, a int, b int, start int, end int, key long, content int", rows=BATCH_ROWS // 4)


def _single_windows(docs: DataFrame, run_words: int, gram: int) -> DataFrame:
    """(doc_id, text, at) to (doc_id, a, start, end, key): the windows of the stretches that begin at the words ``at``."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        w = _Words(utf8(batch.column(1)))
        x = _Windows(w, run_words, gram)
        column = batch.column(2)
        wanted = np.asarray(column.flatten()) + np.repeat(w.before, np.asarray(column.value_lengths()))
        open_ = np.isin(x.head, wanted)
        head, size = x.head[open_], (x.tail - x.head + 1)[open_]
        if not len(head):
            return None
        at = np.repeat(head - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())
        r = w.row[at]
        columns = [batch.column(0).take(pa.array(r)), *[pa.array(c.astype(np.int32)) for c in (at - w.before[r], w.start[at], w.end[at + run_words - 1])], pa.array(w.hash_of(at, run_words).view(np.int64))]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "a", "start", "end", "key"])

    return map_batches(docs.select("doc_id", "text", "at"), one, "doc_id long, a int, start int, end int, key long", rows=BATCH_ROWS // 4)


def _islands(a: np.ndarray, b: np.ndarray, start: np.ndarray, end: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, ...]:
    """Spans that overlap or touch as one, in order; lo is the smallest."""
    order = np.argsort(a, kind="stable")
    a, b, start, end, lo = (x[order] for x in (a, b, start, end, lo))
    if not len(a):
        return a, b, start, end, lo
    heads = np.flatnonzero(np.concatenate(([True], a[1:] > np.maximum.accumulate(b)[:-1])))
    return a[heads], np.maximum.reduceat(b, heads), np.minimum.reduceat(start, heads), np.maximum.reduceat(end, heads), np.minimum.reduceat(lo, heads)


def runs_of(doc: np.ndarray, a: np.ndarray, b: np.ndarray, start: np.ndarray, end: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, ...]:
    """(doc, start, end, words, component_id, kept): what earlier documents hold as runs to go, and the rest of what is
    shared as runs that stay. Documents are told apart by an offset that no place reaches."""
    ids, at = np.unique(doc, return_inverse=True)
    room = int(max(b.max(), end.max())) + 2
    a, b, start, end = (x.astype(np.int64) + at * room for x in (a, b, start, end))
    earlier = lo < doc
    ga, gb, gs, ge, gl = _islands(*(x[earlier] for x in (a, b, start, end, lo)))
    ka, kb, ks, ke, _ = _islands(*(x[~earlier] for x in (a, b, start, end, lo)))

    def in_spans(x: np.ndarray, from_: np.ndarray, to: np.ndarray, open_: bool) -> np.ndarray:
        """Whether each x is past the begin of a span and before its end; at its begin only if not ``open_``."""
        i = np.searchsorted(from_, x, side="left" if open_ else "right") - 1
        return (i >= 0) & (x < np.append(to, 0)[i])

    # What is kept is cut where runs to go begin and goes on where they end.
    free = ~in_spans(ka, ga, gb, False)
    resumed = in_spans(gb, ka, kb, True)
    head, head_at = np.concatenate((ka[free], gb[resumed])), np.concatenate((ks[free], ge[resumed]))
    i = np.searchsorted(ga, kb, side="left") - 1
    whole = ~((i >= 0) & (kb <= np.append(gb, 0)[i]))
    cut = in_spans(ga, ka, kb, True)
    tail, tail_at = np.concatenate((kb[whole], ga[cut])), np.concatenate((ke[whole], gs[cut]))
    x, y = np.argsort(head), np.argsort(tail)
    head, head_at, tail, tail_at = head[x], head_at[x], tail[y], tail_at[y]
    good = tail_at > head_at
    head, head_at, tail, tail_at = (v[good] for v in (head, head_at, tail, tail_at))
    of = np.concatenate((ga, head)) // room
    gone = np.arange(len(of)) < len(ga)
    own = ids[of]
    return own, np.concatenate((gs, head_at)) - of * room, np.concatenate((ge, tail_at)) - of * room, np.concatenate((gb - ga, tail - head)), np.where(gone, np.concatenate((gl, own[len(ga) :])), own), ~gone


def passage_runs(docs: DataFrame, run_words: int = RUN_WORDS, gram: int = GRAM_WORDS) -> DataFrame:
    """(doc_id, start, end, words, component_id, kept) for windows of ``run_words`` that other documents have as well."""
    with staging(docs.sparkSession):
        with staging(docs.sparkSession):
            found = stage(_stretches(docs, run_words, gram), "stretches")
            per_key = found.groupBy("key").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), (F.min("content") < F.max("content")).alias("mixed")).where("lo < hi")
            per_key = stage(per_key.select("key", "lo", "mixed"), "keys")
            hits = stage(found.join(per_key, "key").select("doc_id", "a", "b", "start", "end", "lo", "mixed"), "hits", keep=True)
        # Stretches of one key that differ share some windows and not others, so these are told apart one by one.
        mixed = hits.where("mixed").groupBy("doc_id").agg(F.collect_set("a").alias("at"))
        each = stage(_single_windows(docs.join(mixed, "doc_id"), run_words, gram), "windows")
        common = stage(each.groupBy("key").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("key", "lo"), "common")
        singles = each.join(common, "key").select("doc_id", "a", (F.col("a") + run_words).alias("b"), "start", "end", "lo")
        spans = hits.where("not mixed").drop("mixed").unionByName(singles)
        per_doc = spans.groupBy("doc_id").agg(F.collect_list(F.struct("a", "b", "start", "end", "lo")).alias("spans"))

        def one(batch: pa.RecordBatch) -> pa.RecordBatch | None:
            found = batch.column(1).flatten()
            if not len(found):
                return None
            doc = np.repeat(np.asarray(batch.column(0)), np.asarray(batch.column(1).value_lengths()))
            a, b, start, end, lo = (np.asarray(found.field(i)) for i in range(5))
            return pa.RecordBatch.from_arrays([pa.array(x) for x in runs_of(doc, a, b, start, end, lo)], ["doc_id", "start", "end", "words", "component_id", "kept"])

        return stage(map_batches(per_doc, one, "doc_id long, start long, end long, words long, component_id long, kept boolean"), "runs", keep=True)


def _passages(rows: DataFrame) -> DataFrame:
    """The passages of (doc_id, text), with ``of`` where an id has several texts: the hash of the one that is meant."""
    keys = rows.select("doc_id", F.xxhash64("text").alias("of"))
    several = keys.groupBy("doc_id").agg(F.min("of").alias("lo"), F.max("of").alias("hi")).where("lo < hi")
    numbered = None
    if not several.isEmpty():  # number the texts in order of their ids: each is a document of its own
        numbered = stage(keys.distinct().repartitionByRange("doc_id", "of").sortWithinPartitions("doc_id", "of").withColumn("uid", F.monotonically_increasing_id()), "texts")
        rows = rows.withColumn("of", F.xxhash64("text")).join(numbered, ["doc_id", "of"]).select(F.col("uid").alias("doc_id"), "text")
    one, two = paragraph_clusters(rows), passage_runs(rows)
    found = one.withColumn("kind", F.lit("paragraph")).unionByName(two.withColumn("kind", F.lit("run"))).select("doc_id", "kind", "start", "end", "words", "component_id", "kept")
    if numbered is None:
        return found.withColumn("of", F.lit(None).cast("long"))
    own = found.withColumnRenamed("doc_id", "uid").join(numbered, "uid").drop("uid").withColumnRenamed("component_id", "uid")
    return own.join(numbered.select("uid", F.col("doc_id").alias("component_id")), "uid").select(*found.columns, "of")


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, kind, start, end, words, component_id, kept), a row per passage that two documents or more have.

    kind: paragraph or run. Places are code points of the text, end exclusive. component_id is the smallest document of
    the cluster; its passages are kept, all others can go. Words of a run that earlier documents hold go, and the rest of
    it is a row of its own that is kept. Repeats within one document only are not reported. Null and empty texts and rows
    without an id have none. Rows that repeat an id and its text are one document, those with another text one of its own.
    Other columns are ignored.
    """
    return _passages(_texts(docs, id_col, text_col)).drop("of")


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).where("doc_id is not null")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", line_words: int = LINE_WORDS) -> DataFrame:
    """The rows of ``docs`` without the passages that their clusters' smallest documents keep; all columns stay.

    Fewer than ``line_words`` words of a line that a run begins or ends with stay with the rest of their line; with 0 all go.
    Null and empty texts and rows without an id stay as they are; each row loses passages of its own text only.
    """
    gone = _passages(_texts(docs, id_col, text_col)).where("not kept").groupBy(F.col("doc_id").alias("_id"), "of").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("_cut"))
    # A run may take the first or last words of a line by chance; fewer than line_words don't leave their line.
    few = f"regexp_count({{0}}, '[^\\\\s]+') < {line_words} and length({{0}}) < x.end - x.start"
    head, tail = (f"substring_index(substring(_t, cast(x.start as int) + 1, cast(x.end - x.start as int)), '\\n', {i})" for i in (1, -1))
    start = f"if(x.start > 0 and substring(_t, cast(x.start as int), 1) <> '\\n' and {few.format(head)}, x.start + length({head}), x.start)"
    end = f"if(substring(_t, cast(x.end as int) + 1, 1) not in ('', '\\n') and {few.format(tail)}, x.end - length({tail}), x.end)"
    cuts = f"array_sort(transform(_cut, x -> named_struct('start', {start}, 'end', {end})))"
    step = "named_struct('at', greatest(a.at, cast(x.end as int)), 'out', if(x.start > a.at, concat(a.out, substring(_t, a.at + 1, cast(x.start as int) - a.at)), a.out))"
    rest = f"aggregate({cuts}, named_struct('at', 0, 'out', ''), (a, x) -> {step}, a -> concat(a.out, substring(_t, a.at + 1)))"
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(f"`{id_col}`").cast("long").alias("_doc"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("_t"))
    joined = rows.join(gone, (F.col("_doc") == F.col("_id")) & (F.coalesce("of", F.xxhash64("_t")) == F.xxhash64("_t")), "left")
    text = F.when(F.col("_cut").isNull(), F.col(f"_row.`{text_col}`")).otherwise(F.expr(rest))
    return joined.select(*[(text if c == text_col else F.col(f"_row.`{c}`")).alias(c) for c in docs.columns])
