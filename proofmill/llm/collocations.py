"""Phrase collocations from depth-limited count tries.

Each task builds count tries of its shard, a level of arrays for each depth, and gives them out in order of their phrases.
These runs are dealt by ranges of the phrases' beginnings, sorted together and summed as they stream by: a merge of all
shards' runs. Ranges are cut where the words' counts say, inside a common word at the word that follows.

A phrase occurs no more often than its parts, so tries grow in three passes: words; pairs of words that are frequent; and
up to four words all of whose pairs are. What is frequent is passed on as a bitmap of hashes of at most ``MOST_BITS``: a
phrase that is in it by chance is counted for nothing and drops out by its count, none is lost.

The frequent phrases, sorted, are one trie: walking it in order gives each phrase the counts of its beginnings. A suffix
link leads from a phrase to what is left without its first word; that node has the counts of its own ends in turn.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from proofmill.llm.common import _MULTIPLIERS, _mix, map_batches, prepare, stage, staging, utf8

DEPTH = 4
#: Tokens that a task holds at once, and words, counted anew in each part; beyond them it writes its tries out and starts anew.
SHARD_TOKENS, SHARD_WORDS = 6_000_000, 2_000_000
#: Bytes of text split at once.
PART = 1 << 22
LEAST_BITS, MOST_BITS = 1 << 16, 1 << 28
#: Ranges of phrases for each of the session's shuffle partitions, and all of them at most.
RANGES, MOST_RANGES = 16, 20_000
#: Every lang's best are found in so many parts first.
SALTS = 64
_SPLIT = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t,;:!?\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz .........")
_END = b"."
RUN = "lang string, phrase binary, n long, part int"


def split_parts(text: bytes, size: int) -> Iterator[bytes]:
    """A text in parts of about ``size`` bytes that follow each other: words between blanks, full stops where pieces end."""
    text, at = text.translate(_SPLIT), 0
    while at < len(text):
        cut = text.find(b" ", at + size)
        cut = len(text) if cut < 0 else cut
        yield text[at:cut].replace(_END, b" . ")
        at = cut
    yield b" . "


class _Bitmap:
    """Which phrases may be frequent, by a hash of their words' hashes."""

    def __init__(self, words: np.ndarray) -> None:
        self.words, self.mask = words, len(words) * 64 - 1

    def has(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes & np.uint64(self.mask)
        return (self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) > 0


def _word_hash(lang: bytes, word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word, xxhash.xxh3_64_intdigest(lang))


def _phrase_hash(words: list[np.ndarray]) -> np.ndarray:
    if len(words) == 1:
        return words[0]
    total = np.zeros(len(words[0]), np.uint64)
    for m, h in zip(_MULTIPLIERS, words, strict=False):
        total += h * m
    return _mix(total)


class _Trie:
    """Tries of one lang in one task; until they are written out, its words as a dictionary and numbers for each part."""

    def __init__(self, lang: bytes) -> None:
        self.lang, self.waiting, self.bytes, self.coded = lang, [], 0, []

    def add(self, part: bytes, size: int) -> tuple[int, int]:
        """Tokens and words that have come in by it."""
        self.waiting.append(part)
        self.bytes += len(part)
        return self.read() if self.bytes >= size else (0, 0)

    def read(self) -> tuple[int, int]:
        new = pc.split_pattern(pa.array([b"".join(self.waiting)], pa.binary()), " ").values.dictionary_encode()
        self.waiting, self.bytes = [], 0
        self.coded.append(new)
        return len(new), len(new.dictionary)

    def words(self) -> tuple[pa.Array, np.ndarray]:
        """The different words, in order, and the number of each token's, without those between two blanks."""
        self.read()
        coded = pa.chunked_array(self.coded).unify_dictionaries()
        words = coded.chunk(0).dictionary
        order = pc.sort_indices(words).to_numpy()
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        at = rank[np.concatenate([c.indices.to_numpy() for c in coded.chunks])]
        words = words.take(pa.array(order))
        return (words.slice(1), at[at > 0] - 1) if len(words) and words[0].as_py() == b"" else (words, at)

    def _run(self, phrases: pa.Array, counts: np.ndarray, parts: np.ndarray) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(counts), 50_000):
            some = phrases.slice(at, 50_000).cast(pa.binary())
            langs = pa.repeat(pa.scalar(self.lang.decode()), len(some))
            yield pa.RecordBatch.from_arrays([langs, some, pa.array(counts[at : at + 50_000], pa.int64()), pa.array(parts[at : at + 50_000], pa.int32())], ["lang", "phrase", "n", "part"])


class _WordTrie(_Trie):
    """Depth 1."""

    def runs(self) -> Iterator[pa.RecordBatch]:
        words, at = self.words()
        counts = np.bincount(at, minlength=len(words))
        keep = pa.array(pc.not_equal(words, _END).to_numpy(zero_copy_only=False).nonzero()[0])
        yield from self._run(words.take(keep), counts[keep.to_numpy()], np.zeros(len(keep), np.int32))


class _PhraseTrie(_Trie):
    """Depth 2, or 3 and 4, of words that may be frequent."""

    def __init__(self, lang: bytes, words: _Bitmap, pairs: _Bitmap | None, borders: list[tuple[bytes, bytes]], first_part: int) -> None:
        super().__init__(lang)
        self.frequent, self.pairs, self.borders, self.first_part = words, pairs, borders, first_part

    def runs(self) -> Iterator[pa.RecordBatch]:
        words, at = self.words()
        seed = xxhash.xxh3_64_intdigest(self.lang)
        every = np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in words.to_pylist()), np.uint64, len(words))
        kept = np.flatnonzero(self.frequent.has(every) & pc.not_equal(words, _END).to_numpy(zero_copy_only=False))
        number = np.full(len(words), -1, np.int64)
        number[kept] = np.arange(len(kept))
        ids, texts, hashes, size = number[at], words.take(pa.array(kept)), every[kept], len(kept)
        names = texts.to_pylist()
        starts = np.flatnonzero((ids[:-1] >= 0) & (ids[1:] >= 0))
        if not len(starts):
            return
        # A node is its parent's number and its last word; numbers follow the order of the phrases.
        keys = ids[starts] * size + ids[starts + 1]
        if self.pairs is None:
            nodes, counts = np.unique(keys, return_counts=True)
            yield from self._run(self._join([texts.take(pa.array(nodes // size)), texts.take(pa.array(nodes % size))]), counts, self._parts(nodes, names))
            return
        nodes, inverse = np.unique(keys, return_inverse=True)
        good = self.pairs.has(_phrase_hash([hashes[nodes // size], hashes[nodes % size]]))
        pair_at = np.full(len(ids), -1, np.int64)
        pair_at[starts[good[inverse]]] = inverse[good[inverse]]
        node_at, parts = pair_at, self._parts(nodes, names)
        columns = [texts.take(pa.array(nodes // size)), texts.take(pa.array(nodes % size))]
        for depth in range(3, DEPTH + 1):
            # A phrase goes on where the one that is a word shorter does and the pair at its end is frequent.
            starts = np.flatnonzero((node_at[: -(depth - 2)] >= 0) & (pair_at[depth - 2 :] >= 0))
            nodes, inverse, counts = np.unique(node_at[starts] * size + ids[starts + depth - 1], return_inverse=True, return_counts=True)
            parts = parts[nodes // size]
            columns = [*(c.take(pa.array(nodes // size)) for c in columns), texts.take(pa.array(nodes % size))]
            yield from self._run(self._join(columns), counts, parts)
            node_at = np.full(len(ids), -1, np.int64)
            node_at[starts] = inverse

    def _join(self, columns: list[pa.Array]) -> pa.Array:
        return pc.binary_join_element_wise(*columns, b" ")

    def _parts(self, pairs: np.ndarray, names: list[bytes]) -> np.ndarray:
        """The range that each pair of words, numbered in order, falls into; the same in all tasks."""
        cuts = []
        for first, second in self.borders:
            at = bisect_left(names, first)
            there = at < len(names) and names[at] == first
            cuts.append(at * len(names) + (bisect_left(names, second) if there else 0))
        return self.first_part + np.searchsorted(np.array(cuts, np.int64), pairs, "right")


def _tries(docs: DataFrame, new: Callable[[bytes], _Trie]) -> DataFrame:
    """The runs (lang, phrase, n, part) of the tries of each task."""
    most, size = (SHARD_TOKENS, SHARD_WORDS), PART

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tries: dict[bytes, _Trie] = {}
        held = [0, 0]
        for batch in batches:
            for lang, text in zip(utf8(batch.column(0)), batch.column(1).cast(pa.binary()), strict=True):
                trie = tries.get(lang) or tries.setdefault(lang, new(lang))
                for part in split_parts(text.as_py() or b"", size):
                    held = [x + new for x, new in zip(held, trie.add(part, size), strict=True)]
                if held[0] >= most[0] or held[1] >= most[1]:
                    for t in tries.values():
                        yield from t.runs()
                    tries, held = {}, [0, 0]
        for t in tries.values():
            yield from t.runs()
        pa.default_memory_pool().release_unused()

    prepare(docs.sparkSession)
    return docs.select("lang", "text").mapInArrow(over, RUN)


def _borders(words: DataFrame, ranges: int) -> dict[bytes, tuple[int, list[tuple[bytes, bytes]]]]:
    """By lang the number of its first range and the (word, next word) that its other ranges begin with.

    From a bounded sample of the frequent words, drawn by their counts: those that fill a range are all in it. Where the
    borders are decides how even the ranges are and nothing else.
    """
    total = words.agg(F.sum("n")).first()[0] or 0
    drawn = F.expr("-ln((pmod(xxhash64(lang, phrase), 1000003) + 1) / 1000004.0) / n")
    sample = sorted((r.lang.encode(), bytes(r.phrase), r.n) for r in words.orderBy(drawn, "lang", "phrase").limit(4 * ranges).collect())
    large = [x for x in sample if x[2] * ranges >= total]
    rest = (total - sum(n for *_, n in large)) / max(1, len(sample) - len(large))
    out: dict[bytes, tuple[int, list[tuple[bytes, bytes]]]] = {}
    number = 0
    for lang in dict.fromkeys(lang for lang, *_ in sample):
        mine = [(w, n if n * ranges >= total else rest) for x, w, n in sample if x == lang]
        sums = np.cumsum([n for _, n in mine])
        out[lang] = number, []
        filled = 0.0
        for word, n in mine:
            if n * ranges >= total:  # a common word: cut it at the words that may follow
                cuts = int(n * ranges // total)
                follow = [mine[int(np.searchsorted(sums, sums[-1] * k / (cuts + 1)))][0] for k in range(1, cuts + 1)]
                out[lang][1].extend([(word, b""), *((word, f) for f in dict.fromkeys(follow))])
                filled = total / ranges
                continue
            if filled >= total / ranges:
                out[lang][1].append((word, b""))
                filled = 0.0
            filled += n
        number += len(out[lang][1]) + 1
    return out


def _merged(runs: DataFrame, least: int) -> DataFrame:
    """The runs of all shards, merged range by range: (lang, phrase, n) of at least ``least``."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple | None = None

        def done() -> Iterator[pa.RecordBatch]:
            if last and last[2] >= least:
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(last, (pa.string(), pa.binary(), pa.int64()), strict=True)], ["lang", "phrase", "n"])

        for batch in batches:
            if not batch.num_rows:
                continue
            langs, phrases, n = batch.column(0), batch.column(1), batch.column(2).to_numpy()
            same = pc.and_(pc.equal(langs.slice(1), langs.slice(0, len(langs) - 1)), pc.equal(phrases.slice(1), phrases.slice(0, len(phrases) - 1)))
            starts = np.concatenate([[0], np.flatnonzero(~same.to_numpy(zero_copy_only=False)) + 1]).astype(np.int64)
            totals = np.add.reduceat(n, starts)
            if last and last[:2] == (langs[0].as_py(), phrases[0].as_py()):
                totals[0] += last[2]
            else:
                yield from done()
            keep = np.flatnonzero(totals[:-1] >= least)
            if len(keep):
                at = pa.array(starts[keep])
                yield pa.RecordBatch.from_arrays([langs.take(at), phrases.take(at), pa.array(totals[keep], pa.int64())], ["lang", "phrase", "n"])
            last = langs[int(starts[-1])].as_py(), phrases[int(starts[-1])].as_py(), int(totals[-1])
        yield from done()

    # Phrases first: the beginning of the sort key then tells most of them apart.
    dealt = runs.repartition("part").select("lang", "phrase", "n").sortWithinPartitions("phrase", "lang")
    return dealt.mapInArrow(over, "lang string, phrase binary, n long")


def _bitmap(phrases: DataFrame) -> _Bitmap:
    """Of the (lang, phrase) of a staged table; 32 bits a phrase as long as ``MOST_BITS`` suffice for that."""
    bits = min(max(LEAST_BITS, 1 << (32 * phrases.count()).bit_length()), MOST_BITS)

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        words = [[_word_hash(lang, w) for w in p.split(b" ")] for lang, p in zip(utf8(batch.column(0)), batch.column(1).to_pylist(), strict=True)]
        at = _phrase_hash([np.array(h, np.uint64) for h in zip(*words, strict=True)]) & np.uint64(bits - 1)
        return pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).astype(np.int64)), pa.array((np.uint64(1) << (at & np.uint64(63))).view(np.int64))], ["i", "bit"])

    found = map_batches(phrases.select("lang", "phrase"), one, "i long, bit long").groupBy("i").agg(F.bit_or("bit").alias("bits")).toArrow()
    words = np.zeros(bits // 64, np.uint64)
    words[found["i"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return _Bitmap(words)


def count_phrases(docs: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """((lang, phrase, n) of up to four words and of at least ``least`` occurrences, (lang, n) with the words of each lang)."""
    spark = docs.sparkSession
    with staging(spark):
        runs = stage(_tries(docs, _WordTrie).drop("part"), "words")
        totals = stage(runs.groupBy("lang").agg(F.sum("n").alias("n")), "totals", keep=True)
        found = [stage(runs.groupBy("lang", "phrase").agg(F.sum("n").alias("n")).where(F.col("n") >= least), "frequent", keep=True)]
        borders = _borders(found[0], min(RANGES * int(spark.conf.get("spark.sql.shuffle.partitions")), MOST_RANGES))
        words = spark.sparkContext.broadcast((_bitmap(found[0]), borders))
        first = lambda lang: words.value[1].get(lang, (0, []))
        found.append(stage(_merged(_tries(docs, lambda lang: _PhraseTrie(lang, words.value[0], None, first(lang)[1], first(lang)[0])), least), "frequent", keep=True))
        pairs = spark.sparkContext.broadcast(_bitmap(found[1]))
        found.append(stage(_merged(_tries(docs, lambda lang: _PhraseTrie(lang, words.value[0], pairs.value, first(lang)[1], first(lang)[0])), least), "frequent", keep=True))
        words.destroy(), pairs.destroy()
        return found[0].unionAll(found[1]).unionAll(found[2]), totals


def _walk(nodes: DataFrame) -> DataFrame:
    """(lang, words, a) with lefts: the counts of the first 1, 2, ... words, -1 where that node is in an earlier range."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path: list[tuple[str, int]] = []
        of = None
        for batch in batches:
            lefts = []
            for lang, words, a in zip(*(batch.column(c).to_pylist() for c in ("lang", "words", "a")), strict=True):
                if lang != of:
                    path, of = [], lang
                k = 0
                while k < min(len(path), len(words) - 1) and path[k][0] == words[k]:
                    k += 1
                path = path[:k] + [(w, -1) for w in words[k:-1]] + [(words[-1], a)]
                lefts.append([n for _, n in path[:-1]])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("lang", "words", "a")), pa.array(lefts, pa.list_(pa.int64()))], ["lang", "words", "a", "lefts"])

    prepare(nodes.sparkSession)
    ranged = nodes.select("lang", "words", "a").repartitionByRange("lang", "words").sortWithinPartitions("lang", "words")
    return ranged.mapInArrow(over, "lang string, words array<string>, a long, lefts array<long>")


def _joined(at: str, n: str) -> F.Column:
    return F.expr(f"array_join(slice(words, {at}, {n}), ' ')")


def _with_parts(counted: DataFrame) -> DataFrame:
    """(lang, phrase, n) to (lang, phrase, size, a, lefts, rights); rights are the counts without the first 1, 2, ... words."""
    nodes = counted.select("lang", F.split(F.col("phrase").cast("string"), " ").alias("words"), F.col("n").alias("a"))
    nodes = stage(nodes, "nodes")
    walked = stage(_walk(nodes).withColumn("size", F.size("words")), "walked")
    # Where a range starts below a node, that node is in an earlier one: three at most for each range.
    gaps = walked.where("exists(lefts, x -> x < 0)").select("lang", F.explode(F.expr("filter(transform(lefts, (x, i) -> if(x < 0, slice(words, 1, i + 1), null)), x -> x is not null)")).alias("words")).distinct()
    gaps = stage(nodes.join(F.broadcast(stage(gaps, "gaps")), ["lang", "words"]).select("lang", _joined("1", "size(words)").alias("first"), F.col("a").alias("known")), "known")
    for k in range(1, DEPTH):
        own = F.when(F.get("lefts", F.lit(k - 1)) < 0, _joined("1", str(k)))
        walked = walked.withColumn("first", own).join(F.broadcast(gaps), ["lang", "first"], "left")
        walked = walked.withColumn("lefts", F.when(F.col("known").isNotNull(), F.expr(f"transform(lefts, (x, i) -> if(i = {k - 1}, known, x))")).otherwise(F.col("lefts"))).drop("first", "known")
    nodes = stage(walked.select("lang", _joined("1", "size").alias("phrase"), _joined("2", "size").alias("suffix"), _joined("1", "greatest(size - 1, 0)").alias("prefix"), "size", "a", "lefts"), "linked")
    levels = [nodes.where("size = 1").withColumn("rights", F.array().cast("array<long>"))]
    for size in range(2, DEPTH + 1):
        ends = levels[-1].select("lang", F.col("phrase").alias("suffix"), F.concat(F.array("a"), "rights").alias("rights"))
        levels.append(stage(nodes.where(F.col("size") == size).join(ends, ["lang", "suffix"]), "level"))
    out = levels[1]
    for level in levels[2:]:
        out = out.unionByName(level)
    return out


def collocations(docs: DataFrame, least: int = 30, share: int = 80, top: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each lang's best phrases of two to four words.

    Texts, A-Z in lower case, are cut into pieces at ``[.,;:!?\\x0A-\\x0D]`` and pieces into words at blanks and tabs. a is
    how often a phrase occurs, at least ``least`` times; n are all words of the lang. A phrase's cut into two parts, of
    counts l and r, with the lowest score 2000000 * a / (l + r), rounded down, counts, of equal ones the earliest. Phrases
    with a longer one around them that has at least ``share`` percent of their occurrences are left out. Ranks go by score,
    a, both downwards, and phrase.

    Null langs are ``und``, null and empty texts have no words, rows that repeat an id or a text all count; other columns
    are ignored. An empty table gives no rows.
    """
    with staging(docs.sparkSession):
        counted, totals = count_phrases(docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text"), least)
        candidates = stage(_with_parts(counted), "candidates")
        around = candidates.where("size > 2").select("lang", F.explode(F.array("prefix", "suffix")).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
        wide = "cast({} as decimal(20, 0))"
        alone = candidates.join(around, ["lang", "phrase"], "left").where(f"coalesce(cast(100 as decimal(3, 0)) * {wide.format('longer')} < cast({share} as decimal(3, 0)) * {wide.format('a')}, true)")
        cut = f"struct((cast(2000000 as decimal(7, 0)) * {wide.format('a')}) div {wide.format('(l + rights[i])')} as score, i + 1 as k, l as l, rights[i] as r)"
        best = F.expr(f"array_min(transform(lefts, (l, i) -> {cut}))")
        scored = alone.withColumn("best", best).select("lang", "phrase", "a", "best.l", "best.r", "best.score")
        order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
        parts = Window.partitionBy("lang", F.expr(f"pmod(xxhash64(phrase), {SALTS})")).orderBy(*order)
        first = scored.withColumn("rank", F.row_number().over(parts)).where(F.col("rank") <= top)
        ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
        return stage(ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score"), "collocations", keep=True)
