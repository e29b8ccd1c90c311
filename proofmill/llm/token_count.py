"""Token counts with a whole-token shortcut for a BPE model whose pieces keep to words.

Two facts are proved on the vocabulary before any text is counted: no piece has a space mark after another character,
so no merge crosses a word's start; and no piece but the bytes' own holds a line feed, so none crosses one either. Each
vocabulary string is then encoded alone: those that come back as one token make the shortcut table. Texts are cut into
pre-tokens; what the table has counts one, the rest is encoded by the library, each once while it stays in the memo.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofmill.llm.common import map_batches

MARK = "▁"
_PRETOKEN = re.compile("\n| +[^ \n]*|[^ \n]+")


def whole_tokens(model_file: str) -> frozenset[str]:
    """Words (without their space mark) that encode alone as one token. Raises if the vocabulary does not allow the cuts."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
    pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
    crossing = [p for p in pieces if re.search(f"[^{MARK}]{MARK}", p) or "\n" in p]
    if crossing or sp.encode("\n\n") != [*sp.encode("\n"), sp.encode("\n")[-1]] or sp.encode(" a", out_type=str)[0][:1] != MARK:
        raise ValueError(f"this vocabulary merges across words: {crossing[:5]}")
    words = [p[1:] for p in pieces if p.startswith(MARK) and len(p) > 1 and MARK not in p[1:]]
    return frozenset(w for w, ids in zip(words, sp.encode(words), strict=True) if len(ids) == 1)


class Counter(dict):
    """Tokens of what stands after a space, a word or more; a bounded memo over the shortcut table."""

    LIMIT = 300_000

    def __init__(self, model_file: str, known: frozenset[str]) -> None:
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.known = known
        self.feed = len(self.sp.encode("\n"))
        self.after_feed: dict[str, int] = {}
        self.clear()

    def clear(self) -> None:
        super().clear()
        self.after_feed.clear()
        self.update(dict.fromkeys(self.known, 1))

    def __missing__(self, word: str) -> int:
        if len(self) + len(self.after_feed) > self.LIMIT + len(self.known):
            self.clear()
        # The model puts the mark of the space before a text itself.
        n = self[word] = self.parts(" " + word) if "\n" in word else len(self.sp.encode(word))
        return n

    def parts(self, text: str) -> int:
        """Tokens of a text whose first space is the mark that the model puts there."""
        total = 0
        for p in _PRETOKEN.findall(text):
            if p == "\n" or p == " ":
                total += 1
            elif p[0] == " ":
                total += self[p[1:]]
            else:
                if p not in self.after_feed:
                    self.after_feed[p] = len(self.sp.encode("\n" + p)) - self.feed
                total += self.after_feed[p]
        return total

    def count(self, text: str) -> int:
        if not text:
            return 0
        text = text.replace(MARK, " ")
        if "  " in text or text[0] == " " or text[-1] == " ":
            return self.parts(" " + text)
        return sum(map(self.__getitem__, text.split(" ")))


_memo: dict[str, Counter] = {}


def count_tokens(docs: DataFrame, model_file: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit), a row per row of ``docs``. Null is an empty text of no bytes and no tokens."""
    spark = docs.sparkSession
    known = spark.sparkContext.broadcast(whole_tokens(model_file))

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        counter = _memo.get(model_file) or _memo.setdefault(model_file, Counter(model_file, known.value))
        counts = [counter.count(t or "") for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(counts, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"))
    return map_batches(texts, one, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
