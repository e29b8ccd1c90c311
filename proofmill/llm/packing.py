"""Concatenate and cut: all documents in one stream of tokens, cut at every ``size``.

The first pass tokenizes and stores each document's ids with its offset inside its partition, and each partition's
total. Prefix sums over the totals, in two levels, give every document its place in the stream. The second pass cuts:
a document gives one piece for each sequence that it lies in, so a boundary in it gives two boundary records.
"""

from __future__ import annotations

import json
import re
import sys
import zlib
from array import array
from collections.abc import Iterator
from functools import cache, cached_property
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from proofmill.llm.common import BATCH_ROWS, map_batches, prepare, stage

SIZE = 1024
#: How a byte-level BPE of this kind splits its pre-tokens (a fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


#: A character whose class depends on the version of Unicode that a tokenizer knows; the classes up to Latin Extended-B
#: will not change.
_UNSETTLED = re.compile("[\u0250-\U0010ffff]")
#: White space that runs on for long overflows the stack of the split by rank; only texts of ``_LONG`` can hold so much.
_RUN, _LONG = re.compile(r"\s{200}"), 20_000


def _spec(tokenizer_file: str) -> dict:
    return json.loads(Path(tokenizer_file).read_text())


def splits_plainly(spec: dict) -> bool:
    """Whether texts are split by ``PATTERN`` alone: no normalizer, no space put in front, no other pre-tokenizer."""
    pre = spec.get("pre_tokenizer") or {}
    return not spec.get("normalizer") and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)


def ranks_of(spec: dict) -> dict[bytes, int] | None:
    """The vocabulary as byte strings by rank, if every id is one byte or the product of the merge of that rank; else None.

    Then taking the mergeable pair of the lowest id and taking the first mergeable pair of the merge list are the same,
    so the ranks give the library's ids.
    """
    model = spec["model"]
    if model["type"] != "BPE" or any(model.get(x) for x in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
        return None
    vocab, merges = model["vocab"], [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shown = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in printable)}
    ordered = all(vocab.get(a + b) == len(shown) + i for i, (a, b) in enumerate(merges))
    if not ordered or {vocab[c] for c in shown} != set(range(256)) or len(merges) + 256 > len(vocab) + 1:
        return None
    return {bytes(shown[c] for c in piece): i for piece, i in vocab.items() if all(c in shown for c in piece)}


def _bytes(ids: list[int]) -> bytes:
    found = array("I", ids)
    if sys.byteorder == "big":
        found.byteswap()
    return found.tobytes()


def _by_rank(spec: dict):  # noqa: ANN202
    import tiktoken

    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks_of(spec), special_tokens={})


@cache
def merges_by_rank(tokenizer_file: str) -> bool:
    """Whether merging by rank gives the library's ids: every piece of settled characters that is one id by rank must be
    one id to the library too, or no merges reach it and only the library knows."""
    from tokenizers import Tokenizer

    spec = _spec(tokenizer_file)
    if not splits_plainly(spec) or not (ranks := ranks_of(spec)):
        return False
    encoding, library = _by_rank(spec), Tokenizer.from_file(tokenizer_file)
    alone = [p for p in (b.decode("utf-8", "ignore") for b in ranks) if p and not _UNSETTLED.search(p) and len(encoding.encode_ordinary(p)) == 1]
    parts = (library.encode_batch_fast(alone[i : i + 1000], add_special_tokens=False) for i in range(0, len(alone), 1000))
    return all(len(e.ids) == 1 for part in parts for e in part)


class Ids(dict):
    """The library's ids of texts, as little-endian 32-bit bytes.

    A text of settled characters is merged by rank as a whole, where ``merges_by_rank`` has found that this is the same.
    Other texts are cut before single spaces, each of which begins a pre-token there, and the chunks encoded by the
    library, which is only loaded for them; the dictionary is a bounded memo. Chunks with white space at an end never get
    into it: their texts go to the library whole, as do texts with special strings, and all texts where the file splits
    them in another way.
    """

    LIMIT = 100_000

    def __init__(self, tokenizer_file: str, by_rank: bool) -> None:
        spec = _spec(tokenizer_file)
        self.file = tokenizer_file
        self.special = [t["content"] for t in spec.get("added_tokens") or ()]
        self.plain = splits_plainly(spec)
        self.by_rank = _by_rank(spec) if by_rank else None

    @cached_property
    def tokenizer(self):  # noqa: ANN201
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.file)

    def encode(self, texts: list[str]) -> list[bytes]:
        return [] if not texts else [_bytes(e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def documents(self, texts: list[str]) -> list[bytes]:
        """The ids of each text."""
        if len(self) > self.LIMIT:
            self.clear()
        out: list[bytes] = [b""] * len(texts)
        cut: dict[int, list[str]] = {}
        whole = []
        for i, text in enumerate(texts):
            if not self.plain or any(s in text for s in self.special):
                whole.append(i)
            elif self.by_rank and not _UNSETTLED.search(text) and (len(text) < _LONG or not _RUN.search(text)):
                out[i] = _bytes(self.by_rank.encode_ordinary(text))
            elif "\0" in text:
                whole.append(i)
            else:
                chunks = text.replace(" ", "\0 ").split("\0")
                cut[i] = chunks if chunks[0] else chunks[1:]
        missing = [c for c in set().union(*cut.values()) if c not in self]
        good = [c for c in missing if (word := c.removeprefix(" ")) and not word[0].isspace() and not word[-1].isspace()]
        self.update(zip(good, self.encode(good), strict=True))
        bad = set(missing).difference(good)
        for i, chunks in cut.items():
            if bad and not bad.isdisjoint(chunks):
                whole.append(i)
            else:
                out[i] = b"".join(map(self.__getitem__, chunks))
        for i, ids in zip(whole, self.encode([texts[i] for i in whole]), strict=True):
            out[i] = ids
        return out


_memo: dict[str, Ids] = {}


def tokenize(docs: DataFrame, tokenizer_file: str, end_id: int = 0) -> DataFrame:
    """(doc_id, text) to (doc_id, part, local, ids): ids as bytes with ``end_id`` last, ``local`` the ids before it in its partition."""

    by_rank = merges_by_rank(tokenizer_file)

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer_file not in _memo:
            _memo[tokenizer_file] = Ids(tokenizer_file, by_rank)
        memo = _memo[tokenizer_file]
        part, local, end = TaskContext.get().partitionId(), 0, np.array([end_id], "<u4").tobytes()
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH_ROWS):
                batch = whole.slice(at, BATCH_ROWS)
                ids = [x + end for x in memo.documents([t or "" for t in batch.column(1).to_pylist()])]
                before = local + np.cumsum([0, *[len(x) // 4 for x in ids]])
                local = int(before[-1])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([part] * len(ids), pa.int64()), pa.array(before[:-1], pa.int64()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "part", "local", "n", "ids"])

    prepare(docs.sparkSession)
    return docs.mapInArrow(over, "doc_id long, part long, local long, n long, ids binary")


def offsets(stored: DataFrame) -> DataFrame:
    """(part, before): the ids in all partitions before it. A thousand partitions make a block; blocks are summed first."""
    totals = stored.groupBy("part").agg(F.sum("n").alias("n")).withColumn("block", F.expr("part div 1000"))
    in_block = totals.withColumn("a", F.sum("n").over(Window.partitionBy("block").orderBy("part")) - F.col("n"))
    blocks = totals.groupBy("block").agg(F.sum("n").alias("n"))
    of_block = blocks.withColumn("b", F.sum("n").over(Window.orderBy("block")) - F.col("n")).select("block", "b")
    return in_block.join(of_block, "block").select("part", (F.col("a") + F.col("b")).alias("before"))


def pack(docs: DataFrame, tokenizer_file: str, size: int = SIZE, end_id: int = 0, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids]), a row per piece.

    Every sequence but the last is full. Null and empty texts are their end id alone. Rows that repeat an id or have
    none are packed each for itself. No rows give no pieces. Other columns are ignored.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    stored = stage(tokenize(texts, tokenizer_file, end_id), "ids")
    placed = stored.join(stage(offsets(stored.select("part", "n")), "offsets"), "part").select("doc_id", (F.col("before") + F.col("local")).alias("at"), "ids")

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for doc, at, ids in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            n, start = len(ids) // 4, 0
            while start < n:
                offset = (at + start) % size
                length = min(n - start, size - offset)
                piece = ids[4 * start : 4 * (start + length)]
                rows.append((doc, start, length, zlib.crc32(piece), n, (at + start) // size, offset, piece))
                start += length
        columns = list(zip(*rows, strict=True)) or [()] * 8
        arrays = [pa.array(c, pa.int64()) for c in columns[:7]] + [pa.array(columns[7], pa.binary())] * with_ids
        return pa.RecordBatch.from_arrays(arrays, names)

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids
    return map_batches(placed, one, ", ".join(f"{x} {'binary' if x == 'ids' else 'long'}" for x in names))
