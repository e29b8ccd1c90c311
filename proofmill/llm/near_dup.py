"""MinHash near-duplicate detection with sequential Bayesian verification.

Sets of word shingles are signed with 96 minima. 24 bands of 4 propose candidates; a pair at the threshold of 0.8
shares none with probability 3e-6. Candidates are compared 16 minima at a time and dropped as soon as the posterior
probability of a similarity of 0.8 or more, from a uniform prior, is under ``MISS``. What is left is verified on the
full sets, so links are exact; only misses are left to chance.

A bucket of m documents is not expanded into m^2 pairs. The member that collides most often is the bucket's hub and
all others are compared with it. Buckets whose members then are in one component are done; in what is left open members
of other components meet ``HUBS`` more hubs each. For the rest an exact way follows: put the shingles of each set in one
order, the rarest first. If the first common one of two sets stands at place p of n and q of m, they share min(n - p,
m - q) at most, and a link needs percent * (n + m) / (100 + percent). So of two sets of about one size only the first
ninth counts (at 0.8), and a copy with more shingles of its own than that meets no one. Members of one component aren't
compared with each other: for each shingle, only those outside its commonest component meet all. What stays quadratic is
members outside of it that come as near to a link with it as the bound can tell, without having one with any hub.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from math import comb, log

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from proofmill.llm.common import N_HASHES, map_batches, shingle_set, signature, stage, staging, utf8
from proofmill.llm.graph import connected_components

BANDS, ROWS, STEP, MISS, HUBS = 24, 4, 16, 1e-6, 3
#: Sizes within this ratio are one class of the exact join.
RATIO = 1.05


def fewest_matches(percent: int, miss: float = MISS) -> list[tuple[int, int]]:
    """(minima compared, matches needed): with fewer matches P(similarity >= percent/100) is under ``miss``.

    After m matches in n the posterior from a uniform prior is Beta(m + 1, n - m + 1), whose upper tail at t equals
    the binomial probability of at most m successes in n + 1 trials.
    """
    t, out = percent / 100, []
    for n in range(STEP, N_HASHES + 1, STEP):
        tail, m = 0.0, 0
        while (tail := tail + comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)) < miss:
            m += 1
        out.append((n, m))
    return out


def sign(units: DataFrame, width: int, extra: str = "") -> DataFrame:
    """(doc_id, text) to (doc_id, key, n, sig): key names the word sequence, n is the size of the shingle set."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys, ns, sigs, seen = [], [], [], {}
        for text in utf8(batch.column(1)):
            words = text.lower().split()
            if not words:
                keys.append(None), ns.append(0), sigs.append(None)
                continue
            key = xxhash.xxh3_128_digest(b" ".join(words))
            if key not in seen:
                grams = shingle_set(words, width)
                seen[key] = (len(grams), signature(grams))
            keys.append(key), ns.append(seen[key][0]), sigs.append(seen[key][1])
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), pa.array(ns, pa.int64()), pa.array(sigs, pa.binary())], ["doc_id", "key", "n", "sig"])

    return map_batches(units, one, "doc_id long, key binary, n long, sig binary")


def shingles(units: DataFrame, width: int) -> DataFrame:
    """(uid, key, text) to (uid, grams): the sorted shingle hashes as bytes, of texts that have the key."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        uids, grams = [], []
        for uid, key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), utf8(batch.column(2)), strict=True):
            words = text.lower().split()
            if xxhash.xxh3_128_digest(b" ".join(words)) == key:
                uids.append(uid), grams.append(shingle_set(words, width).tobytes())
        return pa.RecordBatch.from_arrays([pa.array(uids, pa.int64()), pa.array(grams, pa.binary())], ["uid", "grams"])

    return map_batches(units.select("uid", "key", "text"), one, "uid long, grams binary")


def buckets(reps: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(uid, sig) to (bucket, uid, size) for bands that more than one unit falls into."""
    hashed = [F.xxhash64(F.lit(i), F.expr(f"substring(sig, {1 + 4 * rows * i}, {4 * rows})")) for i in range(bands)]
    banded = reps.select("uid", F.explode(F.array(*hashed)).alias("bucket"))
    sizes = banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    # What is known of buckets is staged before members join it: both sides are plain exchanges then, so Spark can split
    # a bucket that holds a large part of all members over several tasks.
    return banded.join(stage(sizes, "sizes"), "bucket")


def _prune(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that survive the sequential comparison of their signatures."""
    needed = fewest_matches(percent)
    sig = reps.select("uid", "sig", "n")
    rows = pairs.join(sig.select(F.col("uid").alias("a"), F.col("sig").alias("sa"), F.col("n").alias("na")), "a").join(sig.select(F.col("uid").alias("b"), F.col("sig").alias("sb"), F.col("n").alias("nb")), "b")
    # The sizes bound the similarity, whatever the signatures say.
    rows = rows.where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent).select("a", "b", "sa", "sb")

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), "<u4").reshape(-1, N_HASHES) for i in (2, 3))
        alive, matched = np.arange(len(a)), np.zeros(len(a), np.int64)
        for n, least in needed:
            matched[alive] += (a[alive, n - STEP : n] == b[alive, n - STEP : n]).sum(axis=1)
            alive = alive[matched[alive] >= least]
        return batch.select([0, 1]).take(pa.array(alive))

    return map_batches(rows, one, "a long, b long")


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs whose full sets have 100 * intersection >= percent * union."""
    rows = pairs.join(sets.select(F.col("uid").alias("a"), F.col("grams").alias("ga")), "a").join(sets.select(F.col("uid").alias("b"), F.col("grams").alias("gb")), "b").select("a", "b", "ga", "gb")

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        keep = []
        for ga, gb in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            x, y = np.frombuffer(ga, np.uint64), np.frombuffer(gb, np.uint64)
            common = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(common > 0 and 100 * common >= percent * (len(x) + len(y) - common))
        return batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return map_batches(rows, one, "a long, b long")


def prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """(uid, grams, label) to (uid, label, n, gram, p): the rarest n - ceil(n * percent / 100) + 1 shingles of each set with
    their places in it, without those that no other set has."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        grams = [np.frombuffer(g, np.int64) for g in batch.column(1).to_pylist()]
        sizes = np.array([len(g) for g in grams])
        columns = [np.repeat(batch.column(0).to_numpy(), sizes), np.repeat(batch.column(2).to_numpy(), sizes), np.repeat(sizes, sizes), np.concatenate(grams)]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["uid", "label", "n", "gram"])

    each = map_batches(sets.select("uid", "grams", "label"), one, "uid long, label long, n long, gram long", rows=64)
    shared = each.groupBy("gram").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    own = Window.partitionBy("uid")
    ranked = each.join(shared, "gram").withColumns({"r": F.row_number().over(own.orderBy("df", "gram")), "k": F.count(F.lit(1)).over(own)})
    return ranked.withColumn("p", F.expr("n - k + r - 1")).where(f"p <= n - (n * {percent} + 99) div 100").select("uid", "label", "n", "gram", "p")


def _met(rare: DataFrame, percent: int) -> DataFrame:
    """(uid, other): of the prefixes, those of different labels whose sizes and places leave room for a link."""
    need = f"(({{0}} + {{1}}) * {percent} + {99 + percent}) div {100 + percent}"
    of_gram = rare.groupBy("gram", "label").agg(F.count(F.lit(1)).alias("k")).groupBy("gram").agg(F.max_by("label", F.struct("k", "label")).alias("major"), F.count(F.lit(1)).alias("labels"))
    mixed = rare.join(of_gram.where("labels > 1"), "gram").withColumn("minor", F.col("label") != F.col("major"))
    # The smaller set stands in the class of its size, the larger one looks into those of all sizes that its place allows.
    size_class = f"cast(floor(ln({{0}}) / {log(RATIO)}) as int)"
    small = mixed.where(f"n - p >= {need.format('n', 'n')}").withColumn("to_major", F.explode(F.expr("if(minor, array(false, true), array(false))")))
    small = small.select("gram", F.expr(size_class.format("n")).alias("size_class"), "to_major", F.col("uid").alias("other"), F.col("label").alias("other_label"), F.col("n").alias("m"), F.col("p").alias("q"))
    reach = f"least(n, (n - p) * {100 + percent} div {percent} - n)"
    large = mixed.withColumns({"lo": F.expr(f"(n * {percent} + 99) div 100"), "hi": F.expr(reach)}).where("lo <= hi")
    large = large.withColumn("size_class", F.explode(F.expr(f"sequence({size_class.format('lo')}, {size_class.format('hi')})"))).withColumn("to_major", ~F.col("minor"))
    fits = F.expr(f"label <> other_label and (m < n or m = n and other < uid) and least(n - p, m - q) >= {need.format('n', 'm')}")
    return large.join(small, ["gram", "size_class", "to_major"]).where(fits).select("uid", "other")


def link(reps: DataFrame, sets_of: Callable[[DataFrame], DataFrame], percent: int = 80, bands: int = BANDS, rows: int = ROWS, sequential: bool = True) -> DataFrame:
    """(uid, label) for every unit with a link: label is the smallest uid of its component.

    reps: (uid, n, sig), one row per different set. sets_of: from a frame of uids to their (uid, grams). Without
    ``sequential`` candidates go straight to the exact verification.
    """
    with staging(reps.sparkSession):
        members = stage(buckets(reps, bands, rows), "buckets")
        weight = members.groupBy("uid").agg(F.sum("size").alias("weight"))
        sets = stage(sets_of(weight.select("uid")), "sets")
        members = stage(members.join(weight, "uid").select("bucket", "uid", "weight"), "members")
        rest = members.withColumn("label", F.col("uid"))
        found: list[DataFrame] = []

        def compare(pairs: DataFrame) -> DataFrame:
            with staging(reps.sparkSession):
                pairs = stage(pairs.select(F.least("uid", "other").alias("a"), F.greatest("uid", "other").alias("b")).distinct(), "pairs")
                survivors = stage(_prune(pairs, reps, percent), "survivors") if sequential else pairs
                found.append(stage(_confirm(survivors, sets, percent), "links", keep=True))
            return connected_components(reduce(DataFrame.unionAll, found))

        # First the member that collides most often; then, of those that do about as often, others for each bucket.
        for orders in (["weight"], [f"weight * (1 + pmod(xxhash64({i}, uid), 1000) / 2000)" for i in range(HUBS)]):
            best = [F.max_by(F.struct(F.col("uid").alias("other"), F.col("label").alias("other_label")), F.struct(F.expr(order), -F.col("uid"))) for order in orders]
            hubs = rest.groupBy("bucket").agg(F.array_distinct(F.array(*best)).alias("h")).select("bucket", F.inline("h"))
            labels = compare(rest.join(stage(hubs, "hubs"), "bucket").where("label <> other_label"))
            rest = members.join(labels.withColumnRenamed("node", "uid"), "uid", "left").withColumn("label", F.coalesce("label", "uid"))
            still = rest.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("bucket")
            rest = stage(rest.join(stage(still, "open"), "bucket").select("bucket", "uid", "weight", "label"), "rest")
            if rest.isEmpty():
                break
        else:
            open_ = rest.groupBy("uid").agg(F.first("label").alias("label"))
            rare = stage(prefixes(sets.join(open_, "uid"), percent), "prefixes")
            labels = compare(_met(rare, percent))
        return stage(labels.select(F.col("node").alias("uid"), "label"), "labels", keep=True)


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), a row per row of ``docs``; other columns of ``docs`` are ignored.

    Words are runs of anything but ASCII white space, A-Z in lower case. Null, empty and blank texts have no shingles
    and are their own component. Rows that repeat an id count as one document: what is linked with any of their texts
    is linked with all. A null id has a null component and is kept. An empty table gives no rows.
    """
    units = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    with staging(docs.sparkSession):
        signed = stage(sign(units, width), "signed")
        per_key = signed.where("n > 0 and doc_id is not null").groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("sig").alias("sig"))
        reps = stage(per_key.withColumn("uid", F.monotonically_increasing_id()), "reps")

        def sets_of(uids: DataFrame) -> DataFrame:
            wanted = reps.join(uids, "uid", "left_semi").select("doc_id", "uid", "key")
            return shingles(units.join(wanted, "doc_id"), width).dropDuplicates(["uid"])

        labels = link(reps.select("uid", "n", "sig"), sets_of, percent)
        of_key = stage(reps.join(labels, "uid", "left").select("key", "doc_id", F.coalesce("label", "uid").alias("label")), "of_key")
        texts = signed.where("doc_id is not null").select("doc_id", "key").join(of_key.select("key", "label"), "key")
        several = stage(texts.groupBy("doc_id").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi"), "several")
        if not several.isEmpty():  # texts of one id are one document
            ties = connected_components(texts.join(several.select("doc_id", "lo"), "doc_id").select(F.col("lo").alias("a"), F.col("label").alias("b")))
            of_key = of_key.join(ties.select(F.col("node").alias("label"), F.col("label").alias("to")), "label", "left").select("key", "doc_id", F.coalesce("to", "label").alias("label"))
        roots = of_key.groupBy("label").agg(F.min("doc_id").alias("component_id"))
        of_text = of_key.join(roots, "label").select("key", "component_id")
        rows = signed.select("doc_id", "key", F.col("n").alias("n_shingles")).join(of_text, "key", "left")
        rows = rows.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))
        return stage(rows.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))), "near_duplicates", keep=True)
