"""Secret scans in DataFrame functions only: fixed patterns, and a battery of randomness tests for other strings.

A candidate is a run of 16 or more characters of base64 or of its form for addresses. Its encoding is the smallest
alphabet that holds it. Three tests look at its places in that alphabet: chi-squared for uniformity, Wald and
Wolfowitz's runs above and below the middle, and serial correlation at lag 1. Words and structured strings repeat
letters more than chance: for each encoding a fixed excess makes the chi-squared statistic noncentral, and how far the
observed one lies under that gives a p-value against "this is text". Benjamini and Hochberg's rule is applied to the
p-values of each encoding and power of two of the length by itself, for short strings can't show as much as long ones.
What is rejected as text and passes all three tests as random is a secret. Digits alone (numbers of cards, phones, orders) are
tested but never reported.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proofmill.functions.text import matches
from proofmill.llm.common import stage

#: The patterns of the base scan, in the order of the kinds (fixed values).
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"  # a run of fewer holds no longer run
HEX = r"[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "random")
CANDIDATE = "[A-Za-z0-9+/_-]{16,}"

_UPPER, _LOWER, _DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
#: Encoding, pattern, alphabet, and how much more often than by chance two characters of text in it are the same.
ENCODINGS = (
    ("decimal", "^[0-9]+$", _DIGITS, 1.0),
    ("hex", "^[0-9a-f]+$", _DIGITS + "abcdef", 1.0),
    ("HEX", "^[0-9A-F]+$", _DIGITS + "ABCDEF", 1.0),
    ("lower", "^[a-z]+$", _LOWER, 0.7),
    ("base32", "^[A-Z2-7]+$", _UPPER + "234567", 1.1),
    ("upper", "^[A-Z0-9]+$", _UPPER + _DIGITS, 1.4),
    ("base64", "", _UPPER + _LOWER + _DIGITS + "+/", 2.8),
)
Q, Z, BIN = 0.05, 3.3, 0.05


def _spans(text: Column, pattern: str, kind: int) -> Column:
    """Array of (start, kind, end, s) of all matches."""
    span = lambda m: F.struct(m["start"].alias("start"), F.lit(kind).alias("kind"), (m["start"] + F.length(m["value"])).alias("end"), m["value"].alias("s"))
    return F.transform(matches(text, pattern), span)


def _joined(spans: Column) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", F.get(kinds, x["kind"]), x["start"], x["end"])), ",")


#: Of the normal tail between 0 and 2, by Abramowitz and Stegun's 26.2.17: the argument's factor and the coefficients.
_TAIL = (0.2316419, (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429))


def _normal_tail(z: Column) -> Column:
    """P(Z <= z) with a small relative error in the lower tail, which the false-discovery rule works in: beyond 2 the
    continued fraction of Mills' ratio. Least is 1e-300 or so, at -37."""
    w = F.least(F.abs(z), F.lit(37.0))
    density = F.exp(-w * w / 2) / math.sqrt(2 * math.pi)
    t = 1 / (1 + _TAIL[0] * w)
    near = F.lit(0.0)
    for c in reversed(_TAIL[1]):
        near = (near + c) * t
    ratio = w + 40.0 / w
    for k in range(39, 0, -1):
        ratio = w + k / ratio
    lower = density * F.when(w <= 2, near).otherwise(1 / ratio)
    return F.when(z <= 0, lower).otherwise(1 - lower)


def battery(candidates: DataFrame) -> DataFrame:
    """Adds encoding, p_text and random to rows with a string column ``s``."""
    name, letters, excess = F.lit(ENCODINGS[-1][0]), F.lit(ENCODINGS[-1][2]), F.lit(ENCODINGS[-1][3])
    for e, pattern, alphabet, more in reversed(ENCODINGS[:-1]):
        fits = F.col("s").rlike(pattern)
        name, letters, excess = F.when(fits, e).otherwise(name), F.when(fits, alphabet).otherwise(letters), F.when(fits, more).otherwise(excess)
    rows = candidates.withColumns({"encoding": name, "_letters": letters, "_excess": excess})
    codes = F.transform(F.split(F.translate("s", "-_", "+/"), ""), lambda c: F.instr(F.col("_letters"), c).cast("double"))
    rows = rows.withColumn("_c", F.filter(codes, lambda x: x > 0))
    n, size = F.size("_c").cast("double"), F.length("_letters").cast("double")
    squares = F.aggregate(
        F.sort_array("_c"),
        F.struct(F.lit(-1.0).alias("last"), F.lit(0.0).alias("k"), F.lit(0.0).alias("sum")),
        lambda a, x: F.struct(x.alias("last"), F.when(x == a["last"], a["k"] + 1).otherwise(1.0).alias("k"), (a["sum"] + F.when(x == a["last"], 2 * a["k"] + 1).otherwise(1.0)).alias("sum")),
        lambda a: a["sum"],
    )
    high = F.expr("cast(size(filter(_c, x -> 2 * x > length(_letters))) as double)")
    runs = F.expr("cast(1 + size(filter(_c, (x, i) -> i > 0 and (2 * x > length(_letters)) <> (2 * _c[greatest(i - 1, 0)] > length(_letters)))) as double)")
    sums = F.expr(
        "aggregate(_c, named_struct('p', cast(0 as double), 's', cast(0 as double), 'q', cast(0 as double), 'l', cast(0 as double)), "
        "(a, x) -> named_struct('p', x, 's', a.s + x, 'q', a.q + x * x, 'l', a.l + a.p * x))"
    )
    rows = rows.withColumns({"_n": n, "_a": size, "_x2": squares * size / n - n, "_high": high, "_runs": runs, "_m": sums})
    two = 2 * F.col("_high") * (F.col("_n") - F.col("_high"))
    run_var = two * (two - F.col("_n")) / (F.col("_n") * F.col("_n") * (F.col("_n") - 1))
    mean = F.col("_m.s") / F.col("_n")
    spread = F.col("_m.q") - F.col("_n") * mean * mean
    more = F.col("_n") * F.col("_excess")
    free = F.col("_a") - 1
    ok_runs = F.when(run_var > 0, F.abs(F.col("_runs") - two / F.col("_n") - 1) <= Z * F.sqrt(run_var)).otherwise(False)
    ok_serial = F.when(spread > 0, F.abs((F.col("_m.l") - F.col("_n") * mean * mean) / F.when(spread > 0, spread)) * F.sqrt("_n") <= Z).otherwise(False)
    ok_chi = F.col("_x2") <= free + Z * F.sqrt(2 * free)
    p = _normal_tail((F.col("_x2") - free - more) / F.sqrt(2 * (free + 2 * more)))
    rows = rows.withColumns({"p_text": p, "random": ok_runs & ok_serial & ok_chi & (F.col("encoding") != "decimal"), "bucket": F.floor(F.log2("_n"))})
    return rows.drop("_letters", "_excess", "_c", "_n", "_a", "_x2", "_high", "_runs", "_m")


def thresholds(tested: DataFrame, q: float = Q) -> DataFrame:
    """(encoding, bucket, least): the least bin of -log10 p that Benjamini and Hochberg's rule rejects; a few hundred rows."""
    bins = tested.groupBy("encoding", "bucket", F.floor(-F.log10("p_text") / BIN).alias("bin")).agg(F.count(F.lit(1)).alias("k"))
    stratum = Window.partitionBy("encoding", "bucket")
    ranked = bins.withColumns({"m": F.sum("k").over(stratum), "below": F.sum("k").over(stratum.orderBy(F.desc("bin")))})
    return ranked.where(F.col("m") * F.pow(F.lit(10.0), -F.col("bin") * BIN) <= q * F.col("below")).groupBy("encoding", "bucket").agg(F.min("bin").alias("least"))


def scan(docs: DataFrame, q: float = Q, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans), a row per row of ``docs``.

    Spans are kind:start:end in code points, end exclusive, ordered by start and then kind. Null and empty texts have
    none. A random span that overlaps one of the base scan is not listed again. Rows that repeat an id are scanned each
    for itself. An empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("t"))
    t = F.col("t")
    long_value = F.regexp_extract_all(t, F.lit(ASSIGN), F.lit(2))
    assign = F.filter(F.arrays_zip(_spans(t, ASSIGN, 0).alias("x"), F.when(t.rlike(ASSIGN), long_value).otherwise(F.array().cast("array<string>")).alias("v")), lambda z: F.length(z["v"]) >= 8)
    found = rows.select("doc_id", F.transform(assign, lambda z: z["x"]).alias("a"), _spans(t, ACCESS, 1).alias("k"), _spans(t, HEX, 2).alias("h"), _spans(t, CANDIDATE, 3).alias("c"))
    found = found.select("doc_id", F.concat("a", "k", "h").alias("base"), F.col("c"))
    free = F.filter("c", lambda x: ~F.exists("base", lambda y: (x["start"] < y["end"]) & (y["start"] < x["end"])))
    found = stage(found.select(F.monotonically_increasing_id().alias("row"), "doc_id", "base", free.alias("c")), "spans")
    tested = stage(battery(found.select("row", F.explode("c").alias("x")).select("row", "x", F.col("x.s").alias("s"))), "tested")
    limits = F.broadcast(thresholds(tested, q))  # a row per encoding and power of two
    secret = tested.where("random").join(limits, ["encoding", "bucket"]).where(F.floor(-F.log10("p_text") / BIN) >= F.col("least"))
    extra = secret.groupBy("row").agg(F.collect_list("x").alias("extra"))
    out = found.join(extra, "row", "left").withColumn("extra", F.coalesce("extra", F.array()))
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long")
    return out.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.size("extra").cast("long").alias("n_random"),
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(F.concat("base", "extra")).alias("spans"),
    )
