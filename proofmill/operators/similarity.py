"""Exact character 5-gram similarity of documents with a corpus, best passages, covered spans, and writing risk.

Pairs never come from a product of the tables. With n grams and a threshold t, a unit that is similar to another shares at
least ceil(t n) grams with it; so of the grams that the corpus has at all, in any order that both sides agree on, it shares
one of all but the last ceil(t n) - 1. The order puts the corpus' rarest grams first, and a unit that has too few of its
grams is dropped before anything is looked up.

A corpus of a checked size becomes an index that every task has: units in order of their sizes, so that those that can fit
are a range, and postings by gram. Nothing is exploded or shuffled then. Of a larger corpus tasks only have a table of
bounded size that tells how rare a gram is; both sides are cut by it and joined on what is left. Either way the pairs that
can still reach the threshold are counted exactly, on the grams themselves; to find them 64 bits of each will do. Pairs
without a common gram have similarity 0 and only matter at a threshold of 0, which is refused.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proofmill.functions.text import let, normalized, phrase_hits, scan, sentences, strip, strip_left
from proofmill.operators.gram_index import GramIndex, Rarity, gram_set, hashes, jaccard_of, rounded
from proofmill.sources.session import checkpointed

THRESHOLD = 0.65
#: A corpus of so many characters at most, thus of no more grams, becomes an index of some 30 bytes each in every task.
BROADCAST_CHARS = 2_000_000
#: Weights of the risk's factors and the phrases that it counts (fixed values).
RISK_WEIGHTS = {"paragraph_duplication_rate": 0.35, "sentence_length_low_variation": 0.25, "template_connector_density": 0.2, "vague_phrase_density": 0.2}
TEMPLATE_CONNECTORS = ["首先", "其次", "再次", "最后", "因此", "综上所述", "总之", "与此同时", "however", "therefore", "moreover", "firstly", "secondly"]
VAGUE_PHRASES = ["相关问题", "相关方面", "相关单位", "具有重要意义", "应予以重视", "进一步完善", "提升协同", "一定程度", "somewhat", "various", "important"]


def clamp_threshold(value: object) -> float:
    """None and '' are 0, what is no number is the default, all else is held to 0..1."""
    if value is None or value == "":
        return 0.0
    try:
        return min(1.0, max(0.0, float(value)))  # type: ignore[arg-type]
    except (TypeError, ValueError):
        return THRESHOLD


def _lines(text: Column) -> Column:
    """Array of (ord, text, start, end): trimmed lines that aren't blank."""

    def step(acc: Column, raw: Column) -> Column:
        at = acc["s"]["at"]
        lead = strip_left(raw)
        body = strip(raw)
        start = at + F.length(raw) - F.length(lead)
        line = F.struct(acc["s"]["ord"].alias("ord"), body.alias("text"), start.alias("start"), (start + F.length(body)).alias("end"))
        state = F.struct((acc["s"]["ord"] + 1).alias("ord"), (at + F.length(raw) + 1).alias("at"))
        return F.struct(state.alias("s"), F.when(F.length(body) > 0, F.concat(acc["out"], F.array(line))).otherwise(acc["out"]).alias("out"))

    return scan(F.split(text, "\n"), F.struct(F.lit(0).alias("ord"), F.lit(0).cast("long").alias("at")), step, "struct<ord:int,text:string,start:bigint,end:bigint>")


def paragraphs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ord, text, start, end): trimmed lines that aren't blank, with their places. Places are counted inside the row."""
    return docs.select(F.col(id_col).alias("id"), F.explode_outer(_lines(F.col(text_col))).alias("x")).where("x is not null").select("id", "x.*")


def _numbered(units: DataFrame) -> DataFrame:
    """The units with their normalized texts as _t, numbered by _s."""
    return checkpointed(units.withColumns({"_t": normalized(F.col("text")), "_s": F.monotonically_increasing_id()}).drop("text"))


def _small(units: DataFrame) -> bool:
    return (units.agg(F.sum(F.length("_t") + 16)).first()[0] or 0) <= BROADCAST_CHARS


def _index(units: DataFrame) -> GramIndex:
    """The index of a corpus of checked size."""
    found = units.select("_s", "_t").toArrow()
    return GramIndex(found["_s"].to_pylist(), [t or "" for t in found["_t"].to_pylist()])


def _described(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def pair_scores(left: DataFrame, right: DataFrame, left_keys: list[str], right_keys: list[str], at_least: float) -> DataFrame:
    """Both sides' columns but the texts, and score, of the pairs that reach ``at_least``, from two frames of units with a
    text, which their keys name. The right side is the corpus; its size is looked at first."""
    t, right = at_least - 5e-7, _numbered(right)
    left = left.withColumn("_t", normalized(F.col("text"))).drop("text")
    if not _small(right):
        return _joined_scores(left, right, left_keys, t)
    index, spark, names = _index(right), left.sparkSession, [c for c in left.columns if c != "_t"]
    shared = spark.sparkContext.broadcast(index)

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            rows, units, scores = [], [], []
            for row, found in enumerate(index.matches_of([text or "" for text in batch.column("_t").to_pylist()], t)):
                for unit, score, _ in found:
                    rows.append(row), units.append(unit), scores.append(score)
            if rows:
                mine = batch.select(names).take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([*mine.columns, pa.array(units, pa.int64()), pa.array(scores, pa.float64())], [*names, "_s", "score"])

    found = left.select(*names, "_t").mapInArrow(over, f"{_described(left.drop('_t'))}, _s long, score double")
    return found.join(F.broadcast(right.drop("_t")), "_s").drop("_s")


def _rarity(grams: DataFrame) -> Rarity:
    """How often the corpus has a gram, in steps, by cells of a table of bounded size; 0 means never."""
    cells = Rarity.cells_for(grams.agg(F.sum(F.size("h"))).first()[0] or 0)
    found = grams.select(F.explode("h").alias("h")).groupBy(F.expr(f"h & {cells - 1}").alias("cell")).count().toArrow()
    return Rarity(cells, found["cell"].to_numpy(), found["count"].to_numpy())


def _cut(units: DataFrame, names: list[str], rarity: object, t: float) -> DataFrame:
    """(names, n, rest, h): the grams of each unit by one of which it must meet a similar one, and how many others are left."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rare = rarity.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some, rows, ns, rests, cuts = batch.slice(at, 256), [], [], [], []
                for row, text in enumerate(some.column("_t").to_pylist()):
                    n, there = rare.in_order(hashes(text or ""))
                    need = max(1, ceil(n * t))
                    if n and len(there) >= need:
                        mine = there[: len(there) - need + 1]
                        rows.append(np.full(len(mine), row)), ns.append(np.full(len(mine), n)), rests.append(np.full(len(mine), need - 1)), cuts.append(mine)
                if rows:
                    kept = some.select(names).take(pa.array(np.concatenate(rows)))
                    yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(np.concatenate(ns), pa.int64()), pa.array(np.concatenate(rests), pa.int64()), pa.array(np.concatenate(cuts).view(np.int64))], [*names, "n", "rest", "h"])

    return units.select(*names, "_t").mapInArrow(over, f"{_described(units.select(*names))}, n long, rest long, h long")


def _joined_scores(left: DataFrame, right: DataFrame, left_keys: list[str], t: float) -> DataFrame:
    """``pair_scores`` for a corpus that is too large for an index: both sides' cut grams are joined by a shuffle."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([hashes(x or "").view(np.int64) for x in batch.column(0).to_pylist()], pa.list_(pa.int64()))], ["h"])

    rarity = left.sparkSession.sparkContext.broadcast(_rarity(right.select("_t").mapInArrow(sets, "h array<long>")))
    corpus = _cut(right, ["_s"], rarity, t).withColumnsRenamed({"n": "m", "rest": "rest_m"})
    met = _cut(left, left_keys, rarity, t).join(corpus.hint("shuffle_merge"), "h").where(F.least("n", "m") >= F.greatest("n", "m") * F.lit(t))
    # Up to where the first of the two cuts ends, both have all that is common; beyond it that side has its rest.
    counted = met.groupBy(*left_keys, "_s", "n", "m").agg((F.count(F.lit(1)) + F.greatest(F.first("rest"), F.first("rest_m"))).alias("most"))
    pairs = counted.where(F.col("most") >= (F.col("n") + F.col("m")) * F.lit(t / (1 + t))).select(*left_keys, "_s")
    both = pairs.join(left.withColumnRenamed("_t", "_a"), left_keys).join(right.withColumnRenamed("_t", "_b"), "_s").drop("_s")
    names = [c for c in both.columns if c not in ("_a", "_b")]

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = np.array([jaccard_of(gram_set(a), gram_set(b)) for a, b in zip(batch.column("_a").to_pylist(), batch.column("_b").to_pylist(), strict=True)], np.float64)
            keep = pa.array(np.flatnonzero(score >= t))
            yield pa.RecordBatch.from_arrays([*batch.select(names).take(keep).columns, pa.array(score).take(keep)], [*names, "score"])

    return both.mapInArrow(over, f"{_described(both.select(*names))}, score double")


def best_paragraphs(sources: DataFrame, samples: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """For each source paragraph and sample its best paragraph that reaches the threshold; the earlier one on ties.

    sources, samples: what ``paragraphs`` gives. (doc_id, ord, sample_id, start, end, sample_start, sample_end, score)
    """
    if threshold <= 0:
        raise ValueError("a threshold of 0 matches everything")
    left = sources.withColumnRenamed("id", "doc_id")
    right = samples.select(F.col("id").alias("sample_id"), F.col("ord").alias("sample_ord"), F.col("start").alias("sample_start"), F.col("end").alias("sample_end"), "text")
    scored = pair_scores(left, right, ["doc_id", "ord"], ["sample_id", "sample_ord"], threshold).where(F.col("score") >= threshold)
    best = Window.partitionBy("doc_id", "ord", "sample_id").orderBy(F.desc("score"), "sample_ord")
    return scored.withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n", "sample_ord")


def _scored(docs: DataFrame, corpus: DataFrame, threshold: float, corpus_id: str) -> DataFrame:
    """(doc_id, sample_id, jaccard_score, spans): the higher of the whole texts' similarity and the best passage's, to 6
    places, and where the passages stand."""
    whole = pair_scores(docs.select("doc_id", "text"), corpus.select(F.col(corpus_id).alias("sample_id"), "text"), ["doc_id"], ["sample_id"], threshold)
    passages = best_paragraphs(paragraphs(docs), paragraphs(corpus, corpus_id), threshold)
    both = whole.unionByName(passages.select("doc_id", "sample_id", "score", F.struct("start", "end").alias("span")), allowMissingColumns=True)
    out = both.groupBy("doc_id", "sample_id").agg(F.round(F.max("score"), 6).alias("jaccard_score"), F.collect_list("span").alias("spans"))
    return out.where(F.col("jaccard_score") >= threshold)


def document_pairs(docs: DataFrame, corpus: DataFrame, threshold: float = THRESHOLD, corpus_id: str = "item_id") -> DataFrame:
    """(doc_id, sample_id, jaccard_score): the higher of the whole texts' similarity and the best passage's, to 6 places."""
    return _scored(docs, corpus, threshold, corpus_id).drop("spans")


def top_matches(pairs: DataFrame, most: int = 5) -> DataFrame:
    """The ``most`` best samples of each document; ties by sample."""
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("jaccard_score"), "sample_id"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= most)


def merged_spans(spans: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, start, end): spans that overlap or touch are one."""
    order = Window.partitionBy(*keys).orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    cut = spans.where(F.col("end") > F.col("start")).withColumn("_new", F.when(reach.isNull() | (F.col("start") > reach), 1).otherwise(0))
    island = cut.withColumn("_i", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy(*keys, "_i").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_i")


def covered(spans: DataFrame, keys: list[str], name: str = "matched_characters") -> DataFrame:
    return merged_spans(spans, keys).groupBy(*keys).agg(F.sum(F.col("end") - F.col("start")).alias(name))


def best_matches(docs: DataFrame, corpus: DataFrame, threshold: float = THRESHOLD, corpus_id: str = "item_id", most: int = 5) -> DataFrame:
    """(doc_id, sample_id, jaccard_score, rank, spans): the ``most`` best samples of each document, with the places of the
    passages that reach the threshold with one of the sample's.

    With an index, a document's candidates are counted from the highest bound downwards, and the threshold rises to its
    own last best score: the others need not be counted.
    """
    if threshold <= 0:
        raise ValueError("a threshold of 0 matches everything")
    whole = _numbered(corpus.select(F.col(corpus_id).alias("sample_id"), "text"))
    passages = _numbered(paragraphs(corpus, corpus_id).withColumnRenamed("id", "sample_id"))
    if not (_small(whole) and _small(passages)):
        return top_matches(_scored(docs, corpus, threshold, corpus_id), most)
    sides, kind = [], whole.schema["sample_id"].dataType.simpleString()
    for units in (whole, passages):
        sides.append((_index(units), {r["_s"]: r["sample_id"] for r in units.select("_s", "sample_id").collect()}))
    shared = docs.sparkSession.sparkContext.broadcast(sides)
    t = threshold - 5e-7
    rows = docs.select("doc_id", normalized(F.col("text")).alias("_t"), F.transform(_lines(F.col("text")), lambda x: F.struct(normalized(x["text"]).alias("t"), x["start"].alias("start"), x["end"].alias("end"))).alias("lines"))

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, out = [], []
            texts, each = [text or "" for text in batch.column("_t").to_pylist()], [lines or [] for lines in batch.column("lines").to_pylist()]
            whole, passages = (side[0] for side in shared.value)
            of_text, of_line = whole.candidates_of(texts, t), iter(passages.candidates_of([x["t"] for lines in each for x in lines], t))
            for row, (text, lines) in enumerate(zip(texts, each, strict=True)):
                found = [of_text[row], *islice(of_line, len(lines))]
                best, _ = _best_of(shared.value, [text], [x["t"] for x in lines], found, threshold, most)
                for rank, (sample, score, hits) in enumerate(best, 1):
                    ids.append(row)
                    out.append((sample, score, rank, [{"start": lines[i]["start"], "end": lines[i]["end"]} for i in hits]))
            if ids:
                columns = list(zip(*out, strict=True))
                types = [samples, pa.float64(), pa.int32(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(ids)), *(pa.array(c, k) for c, k in zip(columns, types, strict=True))], ["doc_id", "sample_id", "jaccard_score", "rank", "spans"])

    samples = whole.select("sample_id").limit(0).toArrow().schema.field(0).type
    return rows.mapInArrow(over, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, sample_id {kind}, jaccard_score double, rank int, spans array<struct<start:long,end:long>>")


def best_samples(sides: list[tuple[GramIndex, dict]], whole: list[str], lines: list[str], t: float, threshold: float, most: int) -> tuple[list[tuple], int]:
    """([(sample, score, lines that match one of its lines)] best first, pairs counted) of one document."""
    return _best_of(sides, whole, lines, sides[0][0].candidates_of(whole, t) + sides[1][0].candidates_of(lines, t), threshold, most)


def _best_of(sides: list[tuple[GramIndex, dict]], whole: list[str], lines: list[str], found: list[list[tuple[int, float]]], threshold: float, most: int) -> tuple[list[tuple], int]:
    """``best_samples`` from the candidates of the whole texts and the lines."""
    units = [(0, text) for text in whole] + [(1, text) for text in lines]
    waiting = []
    for i, (side, _) in enumerate(units):
        index, owner = sides[side]
        waiting += [(-bound, owner[index.ids[unit]], i, unit) for unit, bound in found[i]]
    waiting.sort()
    best: dict = {}
    counted: dict = {}

    def count(i: int, unit: int) -> float:
        if (i, unit) not in counted:
            side, text = units[i]
            counted[i, unit] = sides[side][0].score(text, unit)
        return counted[i, unit]

    for bound, sample, i, unit in waiting:
        last = sorted(best.values())[-most] if len(best) >= most else 0.0
        if rounded(-bound) < last:
            break
        score = rounded(count(i, unit))
        if score >= threshold and score > best.get(sample, 0.0):
            best[sample] = score
    chosen = sorted(best.items(), key=lambda x: (-x[1], x[0]))[:most]
    hits: dict = {sample: set() for sample, _ in chosen}
    for _, sample, i, unit in waiting:
        line = i - len(whole)
        if line >= 0 and sample in hits and line not in hits[sample] and count(i, unit) >= threshold:
            hits[sample].add(line)
    return [(sample, score, sorted(hits[sample])) for sample, score in chosen], len(counted)


def similarity_rate(docs: DataFrame, corpus: DataFrame, threshold: float = THRESHOLD, corpus_id: str = "item_id") -> DataFrame:
    """(doc_id, effective_characters, matched_characters, total_similarity_rate), a row per document: what the passages
    of its five best samples cover, over the characters of its normalized text, at most 1."""
    top = best_matches(docs, corpus, threshold, corpus_id)
    hit = covered(top.select("doc_id", F.explode("spans").alias("x")).select("doc_id", "x.*"), ["doc_id"])
    size = docs.select("doc_id", F.length(normalized(F.col("text"))).cast("long").alias("effective_characters"))
    matched = F.coalesce("matched_characters", F.lit(0)).cast("long")
    rate = F.when(F.col("effective_characters") > 0, F.round(F.least(F.lit(1.0), matched / F.col("effective_characters")), 6)).otherwise(0.0)
    return size.join(hit, "doc_id", "left").select("doc_id", "effective_characters", matched.alias("matched_characters"), rate.alias("total_similarity_rate"))


def risk_factors(text: Column, rate: Column) -> dict[str, Column]:
    """The four factors, to 5 places; native functions in one projection."""
    parts = F.filter(F.transform(F.split(text, "\n"), normalized), lambda x: F.length(x) > 0)
    repeated = let(parts, lambda p: F.when(F.size(p) > 0, (F.size(p) - F.size(F.array_distinct(p))) / F.size(p) * 100).otherwise(0.0))
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)

    def variation(lengths: Column) -> Column:
        n = F.size(lengths)

        def of(mean: Column) -> Column:
            spread = total(F.transform(lengths, lambda x: (x - mean) * (x - mean))) / n
            coefficient = F.when(mean > 0, F.sqrt(spread) / mean).otherwise(1.0)
            return F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), (1 - coefficient) * 100)), 5)

        return F.when(n > 1, let(total(lengths) / n, of)).otherwise(0.0)

    size = F.greatest(F.length(normalized(text)), F.lit(1))
    hundred = lambda x: F.round(F.least(F.lit(100.0), x), 5)
    return {
        "paragraph_duplication_rate": hundred(rate * 100 + repeated),
        "sentence_length_low_variation": let(F.transform(sentences(text), lambda s: F.length(s).cast("double")), variation),
        "template_connector_density": hundred(phrase_hits(text, TEMPLATE_CONNECTORS) / size * 900),
        "vague_phrase_density": hundred(phrase_hits(text, VAGUE_PHRASES) / size * 1200),
    }


def writing_risk(docs: DataFrame, rates: DataFrame | None = None) -> DataFrame:
    """(doc_id, four factors, risk_score); rates: (doc_id, total_similarity_rate), 0 where there is none."""
    rows = docs.select("doc_id", "text", F.lit(0.0).alias("rate")) if rates is None else docs.join(rates, "doc_id", "left").select("doc_id", "text", F.coalesce("total_similarity_rate", F.lit(0.0)).alias("rate"))
    rows = rows.select("doc_id", *[c.alias(n) for n, c in risk_factors(F.col("text"), F.col("rate")).items()])
    score = sum((F.col(n) * w for n, w in RISK_WEIGHTS.items()), F.lit(0.0))
    return rows.withColumn("risk_score", F.round(score, 5))


def report_status(detection_type: str, samples: DataFrame) -> str:
    """completed, or no_samples for a comparison with an empty corpus."""
    return "no_samples" if detection_type == "campus_corpus" and samples.isEmpty() else "completed"
