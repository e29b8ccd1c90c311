"""Near-duplicate embeddings by Euclidean p-stable hashing, with exact cosine checks.

Unit vectors at a cosine of s are sqrt(2 - 2 s) apart. A projection on a Gaussian direction, shifted and cut into steps of
``RATIO`` times that distance, puts two such vectors into one step with a probability that is known in closed form; K
projections make a bucket of a table. K follows from the number of vectors that share a label: unrelated vectors, at right
angles, then meet in a table once in ``STRAYS`` vectors. The number of tables follows from K: a pair at the threshold
shares no bucket of any table with probability ``MISS``, nearer pairs far less often.

Equal vectors are one unit with a multiplicity. Only the members of buckets with more than one unit are fetched; those of
a large bucket are dealt into blocks, and pairs of blocks are compared in tasks of their own, so no task holds a bucket and
no pair becomes a row: a task returns counts and one edge for each member. A pair counts in the first table that it meets
in, which the members' bucket numbers tell, so counts are exact for all pairs found.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, erf, exp, log, pi, sqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofmill.llm.common import map_batches, prepare, stage, staging
from proofmill.llm.graph import connected_components

RATIO, MISS, STRAYS = 8.0, 1e-6, 4
#: Members of a block of a bucket; buckets of more than 8 small blocks get 8 larger ones, up to the second number.
BLOCK, LARGE_BLOCK = 256, 4096
_GROUP = ["label", "dim", "t", "h"]


def same_step(ratio: float) -> float:
    """P(two points fall into one step) of a random shifted projection, for steps of ``ratio`` times their distance."""
    return erf(ratio / sqrt(2)) - sqrt(2 / pi) / ratio * (1 - exp(-ratio * ratio / 2))


def tables_for(vectors: int, cosine: float, miss: float = MISS) -> tuple[int, int, float]:
    """(projections of a table, tables, width of a step) for so many vectors with one label."""
    width = RATIO * sqrt(2 - 2 * cosine)
    near, far = same_step(RATIO), same_step(width / sqrt(2))
    k = max(1, ceil(log(STRAYS * max(vectors, 2)) / -log(far)))
    return k, ceil(log(miss) / log(1 - near**k)), width


def _units(vectors: list[np.ndarray]) -> np.ndarray:
    """Vectors of one length, scaled to unit length in double precision."""
    v = np.array(vectors, np.float64)
    v /= np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def _read(batch: pa.RecordBatch) -> pa.RecordBatch:
    """(vec_id, label, embedding) to (vec_id, label, key, dim, vec): the doubles as bytes, null where nothing can be linked."""
    keys, dims, vecs = [], [], []
    ok = pc.and_(batch.column(0).is_valid(), batch.column(1).is_valid())
    for usable, values in zip(ok.to_pylist(), batch.column(2), strict=True):
        v = None
        if usable and values.is_valid and len(values.values) and not values.values.null_count:
            v = values.values.to_numpy(zero_copy_only=False).astype(np.float64)
            v = v if np.isfinite(v).all() and v.any() else None
        data = None if v is None else v.tobytes()
        keys.append(None if v is None else xxhash.xxh3_128_digest(data)), dims.append(0 if v is None else len(v)), vecs.append(data)
    columns = [batch.column(0), batch.column(1), pa.array(keys, pa.binary()), pa.array(dims, pa.int32()), pa.array(vecs, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, ["vec_id", "label", "key", "dim", "vec"])


def _buckets(units: DataFrame, k: int, tables: int, width: float) -> DataFrame:
    """(uid, dim, vec) with hs: the number of the vector's bucket in each table."""
    projections: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def of(dim: int) -> tuple[np.ndarray, np.ndarray]:
        if dim not in projections:
            rng = np.random.default_rng([20250301, dim])
            projections[dim] = rng.standard_normal((dim, tables * k)), rng.uniform(0, width, tables * k)
        return projections[dim]

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        dims, vecs = batch.column(1).to_numpy(), batch.column(2).to_pylist()
        hs = np.empty((len(vecs), tables), np.int64)
        for dim in np.unique(dims):
            rows = np.flatnonzero(dims == dim)
            a, b = of(int(dim))
            steps = np.floor((_units([np.frombuffer(vecs[i]) for i in rows]) @ a + b) / width).astype("<i4").reshape(len(rows), tables, k)
            for row, mine in zip(rows, steps, strict=True):
                hs[row] = [xxhash.xxh3_64_intdigest(x.tobytes()) - 2**63 for x in mine]
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(vecs) + 1) * tables, pa.int32()), pa.array(hs.ravel()))
        return pa.RecordBatch.from_arrays([batch.column(0), lists], ["uid", "hs"])

    return map_batches(units.select("uid", "dim", "vec"), one, "uid long, hs array<long>")


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index that each of n nodes reaches by the edges (a, b)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == before).all():
            return label


def _compare(t: int, side: np.ndarray, uids: np.ndarray, copies: np.ndarray, vecs: list[bytes], hs: np.ndarray, cosine: float) -> pa.RecordBatch | None:
    """(uid, links, root) of one pair of blocks: rows of side 0 with each other if there are no others, else with side 1."""
    first, second = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    within = not len(second) or not len(first)
    if within:
        first = second = np.arange(len(uids))
    unit = _units([np.frombuffer(v) for v in vecs])
    links, ends = np.zeros(len(uids), np.int64), []
    for at in range(0, len(first), 512):
        mine = first[at : at + 512]
        x, y = np.nonzero(unit[mine] @ unit[second].T >= cosine)
        x, y = mine[x], second[y]
        if within:
            x, y = x[x < y], y[x < y]
        for table in range(t):  # pairs that met in an earlier table were counted there
            new = hs[x, table] != hs[y, table]
            x, y = x[new], y[new]
        links += np.bincount(x, copies[y], len(uids)).astype(np.int64) + np.bincount(y, copies[x], len(uids)).astype(np.int64)
        if len(x):
            root = _roots(len(uids), x, y)
            ends.append((np.arange(len(uids))[root != np.arange(len(uids))], root[root != np.arange(len(uids))]))
    if not ends:
        return None
    root = _roots(len(uids), np.concatenate([a for a, _ in ends]), np.concatenate([b for _, b in ends]))
    linked = np.flatnonzero(links)
    return pa.RecordBatch.from_arrays([pa.array(uids[linked]), pa.array(links[linked]), pa.array(uids[root[linked]])], ["uid", "links", "root"])


def _links(members: DataFrame, cosine: float) -> DataFrame:
    """(uid, links, root) of the members of each pair of blocks."""
    keys = [*_GROUP, "lo", "hi"]

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        of_held = None

        def done() -> Iterator[pa.RecordBatch]:
            rows = pa.Table.from_batches(held).combine_chunks()
            if rows.num_rows > 1:
                hs = rows["hs"].combine_chunks().flatten().to_numpy().reshape(rows.num_rows, -1)
                side = (rows["block"].to_numpy() != rows["lo"].to_numpy()).astype(np.int8)
                if of_held[4] == of_held[5] or 0 < side.sum() < len(side):  # else one of two blocks is empty
                    out = _compare(of_held[2], side, rows["uid"].to_numpy(), rows["copies"].to_numpy(), rows["vec"].to_pylist(), hs, cosine)
                    if out is not None:
                        yield out

        for batch in batches:
            marks = list(zip(*(batch.column(k).to_pylist() for k in keys), strict=True))
            at = 0
            for i in range(len(marks) + 1):
                if i == len(marks) or marks[i] != marks[at]:
                    if at < i:
                        if of_held != marks[at]:
                            if held:
                                yield from done()
                            held, of_held = [], marks[at]
                        held.append(batch.slice(at, i - at))
                    at = i
        if held:
            yield from done()
        pa.default_memory_pool().release_unused()

    prepare(members.sparkSession)
    dealt = members.repartition(*keys).sortWithinPartitions(*keys)
    return dealt.select(*keys, "block", "uid", "copies", "vec", "hs").mapInArrow(over, "uid long, links long, root long")


def near_duplicate_vectors(vectors: DataFrame, cosine: float = 0.98, miss: float = MISS) -> DataFrame:
    """(vec_id, n_links, component_id, kept), a row per row of (vec_id, embedding, label); other columns are ignored.

    Rows are linked if their labels are equal and their cosine, in double precision, is at least ``cosine``. Rows without
    a vec_id, label or vector, and vectors that are empty, zero or hold a null, NaN or infinite component are linked with
    nothing, as are vectors of different lengths. n_links counts other rows; rows that repeat an id are judged each by its
    own vector, so equal ones are linked with each other. A null id has a null component and is kept. An empty table gives
    no rows.
    """
    types = {f.name: f.dataType.simpleString() for f in vectors.schema}
    with staging(vectors.sparkSession):
        rows = map_batches(vectors.select("vec_id", "label", "embedding"), _read, f"vec_id {types['vec_id']}, label {types['label']}, key binary, dim int, vec binary")
        rows = stage(rows, "vectors")
        units = rows.where("key is not null").groupBy("label", "dim", "key").agg(F.first("vec").alias("vec"), F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("least_id"))
        units = stage(units.withColumn("uid", F.monotonically_increasing_id()), "units")
        most = units.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
        hashed = stage(_buckets(units, *tables_for(most, cosine, miss)), "hashed")
        placed = units.select("uid", "label", "dim").join(hashed, "uid").select("uid", "label", "dim", F.posexplode("hs").alias("t", "h"))
        placed = stage(placed, "placed")
        sizes = stage(placed.groupBy(*_GROUP).agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "sizes")
        members = placed.join(sizes, _GROUP).withColumn("blocks", F.expr(f"greatest(least(ceil(size / {BLOCK}), 8), ceil(size / {LARGE_BLOCK}))"))
        members = members.withColumn("block", F.expr("pmod(xxhash64(uid), blocks)")).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
        members = members.withColumns({"lo": F.least("block", "other"), "hi": F.greatest("block", "other")})
        members = members.join(units.select("uid", "vec", "copies"), "uid").join(hashed, "uid")
        linked = stage(_links(members, cosine), "linked")
        counts = linked.groupBy("uid").agg(F.sum("links").alias("links"))
        labels = connected_components(linked, "uid", "root").select(F.col("node").alias("uid"), F.col("label").alias("top"))
        of_unit = stage(units.select("uid", "label", "key", "copies", "least_id").join(counts, "uid", "left").join(labels, "uid", "left"), "of_unit")
        roots = of_unit.where("top is not null").groupBy("top").agg(F.min("least_id").alias("root_id"))
        of_unit = of_unit.join(roots, "top", "left").select("label", "key", F.expr("copies - 1 + coalesce(links, 0)").alias("n_links"), F.coalesce("root_id", "least_id").alias("component_id"))
        out = rows.select("vec_id", "label", "key").join(of_unit, ["label", "key"], "left")
        out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").cast("long").alias("component_id"))
        return stage(out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True))), "near_vectors", keep=True)
