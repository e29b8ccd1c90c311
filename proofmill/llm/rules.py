"""Quality rules as a bitmask ledger, in DataFrame functions only.

``evaluate`` measures every rule once and keeps the measurements and one failure bit per rule. A policy is a version,
a mask of the rules that count and the number of failures that reject; it is applied to the ledger later, without the
texts. ``ablate`` counts, for each rule of a policy, what it rejects and what it alone rejects, from the bits.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: ASCII white space and the characters that count as symbols.
SPACES = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
_WORD = "[^\\x20\\x09-\\x0D]"

#: Bit numbers of the rules, in the order of the ledger. A rule's bit is set if it fails.
RULES = {
    "too_few_words": "n_words < 50",
    "repeated_words": "100 * n_repeat_words > 50 * n_words",
    "many_symbols": "n_symbols > 0.3 * n_words",
    "repeated_lines": "10 * n_dup_lines > 5 * n_lines",
    "word_length": "word_chars < 2 * n_words or word_chars > 15 * n_words",
    "shouting": "n_upper > 0.5 * n_letters and n_letters > 0",
    "few_letters": "n_letters < 0.4 * word_chars",
}


@dataclass(frozen=True)
class Policy:
    """Which rules count: bits of ``mask``. ``always`` reject alone; of the others ``failures`` are needed."""

    version: str
    mask: int
    always: int
    failures: int = 1


def mask_of(*names: str) -> int:
    order = list(RULES)
    return sum(1 << order.index(x) for x in names)


BASE = mask_of("too_few_words", "repeated_words")
POLICY = Policy("1", mask_of(*RULES), BASE)


def _without(text: Column, characters: str) -> Column:
    for c in characters:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


#: Up to so many words a window's place fits into the low bits of its hash.
PACKED_WORDS = 1 << 24


def _repeat_words(words: str) -> str:
    """Words in windows of 3 that occur twice: windows are sorted by hash and place, and neighbours compared. A place is
    packed into the low bits of its hash, with the full hash looked up; in longer texts both are sorted as a pair."""
    hashes = f"transform({words}, w -> xxhash64(w))"
    windows = "transform(slice(h, 1, size(h) - 2), (x, i) -> xxhash64(x, h[i + 1], h[i + 2]))"
    packed = "array_sort(transform(w, (x, i) -> (x & -16777216L) | cast(i as bigint)))".replace("array_sort", "sort_array")
    at = "cast({} & 16777215L as int)"
    same = f"w[{at.format('s[i]')}] = w[{at.format('s[{}]')}]"
    hit = f"(i > 0 and {same.format('i - 1')}) or (i + 1 < size(s) and {same.format('i + 1')})"
    found = f"sort_array(transform(filter(transform(s, (x, i) -> if({hit}, x & 16777215L, null)), x -> x is not null), x -> cast(x as int)))"
    pairs = "sort_array(transform(w, (x, i) -> named_struct('h', x, 'p', i)))"
    paired = "sort_array(transform(filter(s, (x, i) -> (i > 0 and x.h = s[i - 1].h) or (i + 1 < size(s) and x.h = s[i + 1].h)), x -> x.p))"
    covered = "aggregate(p, named_struct('n', 0L, 'end', -1), (a, x) -> named_struct('n', a.n + x + 3 - greatest(x, a.end), 'end', x + 3), a -> a.n)"
    let = lambda name, value, body: f"element_at(transform(array({value}), {name} -> {body}), 1)"
    short, long_ = let("s", packed, let("p", found, covered)), let("s", pairs, let("p", paired, covered))
    inner = let("h", hashes, let("w", windows, f"if(size(array_distinct(w)) = size(w), 0L, if(size(w) <= {PACKED_WORDS}, {short}, {long_}))"))
    return f"if(size({words}) < 4, 0L, {inner})"


def evaluate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The ledger: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_upper, n_letters, fail_bits.

    One row per row of ``docs``. Null is an empty text: no words, so it fails ``too_few_words``. Texts may be of any length.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).alias("doc_id"), text.alias("_t"))
    split = base.select("doc_id", "_t", F.filter(F.split("_t", "[\\x20\\x09-\\x0D]+"), lambda x: x != "").alias("_w"), F.filter(F.split("_t", "\n"), lambda x: F.length(F.btrim(x, F.lit(SPACES))) > 0).alias("_l"))
    letters = F.regexp_replace("_t", "[^\\p{L}]+", "")
    measured = split.select(
        "doc_id",
        F.size("_w").cast("long").alias("n_words"),
        F.length(_without(F.col("_t"), SPACES)).cast("long").alias("word_chars"),
        (F.length("_t") - F.length(_without(F.col("_t"), SYMBOLS))).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.expr(_repeat_words("_w")).alias("n_repeat_words"),
        F.size("_l").cast("long").alias("n_lines"),
        F.length(F.regexp_replace("_t", "[^\\p{Lu}]+", "")).cast("long").alias("n_upper"),
        F.length(letters).cast("long").alias("n_letters"),
    )
    bits = F.expr(" | ".join(f"if({rule}, {1 << i}L, 0L)" for i, rule in enumerate(RULES.values())))
    return measured.withColumn("fail_bits", bits)


def decide(ledger: DataFrame, policy: Policy = POLICY) -> DataFrame:
    """The ledger with base_failed, kept and the policy's version."""
    bits = F.col("fail_bits")
    other = F.bit_count(bits.bitwiseAND(F.lit(policy.mask & ~policy.always)))
    return ledger.withColumns(
        {
            "base_failed": bits.bitwiseAND(F.lit(BASE)) != 0,
            "kept": (bits.bitwiseAND(F.lit(policy.mask & policy.always)) == 0) & (bits.bitwiseAND(F.lit(BASE)) == 0) & (other < policy.failures),
            "policy": F.lit(policy.version),
        }
    )


def ablate(ledger: DataFrame, policy: Policy = POLICY) -> DataFrame:
    """(rule, failed, alone, together) per rule of the policy: rows that fail it, that fail it only, and all that fail any."""
    counted = F.col("fail_bits").bitwiseAND(F.lit(policy.mask))
    per_bits = ledger.select(counted.alias("bits")).groupBy("bits").agg(F.count(F.lit(1)).alias("k"))
    rules = [(name, 1 << i) for i, name in enumerate(RULES) if policy.mask >> i & 1]
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(b).cast("long").alias("bit")) for n, b in rules])).alias("r")
    total = F.sum("k")
    return (
        per_bits.select("bits", "k", rows)
        .groupBy(F.col("r.rule").alias("rule"))
        .agg(
            F.coalesce(F.sum(F.expr("if(bits & r.bit != 0, k, 0)")), F.lit(0)).alias("failed"),
            F.coalesce(F.sum(F.expr("if(bits = r.bit, k, 0)")), F.lit(0)).alias("alone"),
            F.coalesce(F.sum(F.expr("if(bits != 0, k, 0)")), F.lit(0)).alias("together"),
            total.alias("rows"),
        )
    )


def keep_good(docs: DataFrame, policy: Policy = POLICY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the policy keeps, with their columns. The verdict is computed in the scan: no join, no shuffle."""
    columns = [F.col(f"_row.`{c}`").alias(c) for c in docs.columns]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    ledger = decide(evaluate(rows.withColumn("_text", F.col(f"_row.`{text_col}`")), "_row", "_text"), policy)
    return ledger.where("kept").select(*[c for c in [F.col(f"doc_id.`{x}`").alias(x) for x in docs.columns]]) if columns else docs
