"""Column functions over texts. Places are code points: spans count from 0, end exclusive; lines and columns from 1."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalized(text: Column) -> Column:
    """Lower case, white space as one space, no punctuation or symbols, trimmed. In this order: a mark between two spaces leaves both."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), "(?U)\\s+", " "), "[\\p{P}\\p{S}]", ""))


#: The characters that Unicode calls white space (fixed values).
WHITE_SPACE = "".join(map(chr, [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def strip(text: Column) -> Column:
    """Without any Unicode white space at the ends."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def strip_left(text: Column) -> Column:
    return F.ltrim(text, F.lit(WHITE_SPACE))


def others(marks: str) -> str:
    """A pattern's class of all characters but these, as ranges. Java takes many times longer over a negated class of
    characters in and beyond Latin-1."""
    codes = sorted({ord(c) for c in marks})
    ranges = [(a + 1, b - 1) for a, b in zip([-1, *codes], [*codes, 0x110000], strict=True) if a + 1 < b]
    return "[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in ranges) + "]"


def compact(text: Column) -> Column:
    """Without white space, in lower case."""
    return F.lower(F.regexp_replace(text, "(?U)\\s+", ""))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once. What a lambda refers to by its expression is computed for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def char_ngrams(text: Column, size: int = 5) -> Column:
    """The set of character n-grams; a text of ``size`` characters or fewer is its own only one; an empty text has none."""
    # What is looked ahead to is taken, and one character is used up.
    windows = lambda t: F.array_distinct(F.regexp_extract_all(t, F.lit(f"(?s)(?=(.{{{size}}}))."), F.lit(1)))
    return let(text, lambda t: F.when(F.length(t) == 0, F.array().cast("array<string>")).when(F.length(t) <= size, F.array(t)).otherwise(windows(t)))


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets: 1 if both are empty, 0 if one is."""
    common = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - common
    return F.when(union == 0, 1.0).otherwise(common / union)


def fill(template: str, **values: Column) -> Column:
    """A text with columns in place of its {names}."""
    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*[values[p].cast("string") if i % 2 else F.lit(p) for i, p in enumerate(parts) if i % 2 or p])


def scan(items: Column, start: Column, step: Callable[[Column, Column], Column], kind: str, block: int = 256) -> Column:
    """Array of ``kind``: what ``step`` gives over the items in order. ``step`` goes from (s, out) and an item to the next
    (s, out). A fold copies what it has gathered at each item, so long arrays are folded in blocks."""
    none, nested = F.array().cast(f"array<{kind}>"), F.array().cast(f"array<array<{kind}>>")
    part = lambda s, xs: F.aggregate(xs, F.struct(s.alias("s"), none.alias("out")), step)

    def in_blocks(xs: Column) -> Column:
        cut = F.transform(F.sequence(F.lit(0), F.ceil(F.size(xs) / block).cast("int") - 1), lambda k: F.slice(xs, k * block + 1, F.lit(block)))
        one = lambda a, x: let(part(a["s"], x), lambda r: F.struct(r["s"].alias("s"), F.concat(a["out"], F.array(r["out"])).alias("out")))
        return F.flatten(F.aggregate(cut, F.struct(start.alias("s"), nested.alias("out")), one, lambda a: a["out"]))

    return let(items, lambda xs: F.when(F.size(xs) <= block, part(start, xs)["out"]).otherwise(in_blocks(xs)))


def matches(text: Column, pattern: str) -> Column:
    """Array of (start, value) of all matches of a pattern, without a UDF: the lengths of what split() leaves and of the matches add up."""
    def step(acc: Column, x: Column) -> Column:
        start = acc["s"] + F.length(x["gap"])
        return F.struct((start + F.length(x["value"])).alias("s"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), x["value"].alias("value")))).alias("out"))

    def placed(found: Column) -> Column:
        pairs = F.arrays_zip(F.slice(F.split(text, pattern), 1, F.size(found)).alias("gap"), found.alias("value"))
        return F.when(F.size(found) == 0, none).otherwise(scan(pairs, F.lit(0), step, "struct<start:int,value:string>"))

    # A text is gone through once, and once more only if there are matches to place.
    none = F.array().cast("array<struct<start:int,value:string>>")
    return let(F.coalesce(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.array().cast("array<string>")), placed)


def phrase_hits(text: Column, phrases: list[str]) -> Column:
    """Occurrences of all phrases in the lower-cased text, each phrase without overlaps."""
    low, total = F.lower(text), F.lit(0)
    for p in phrases:
        total = total + ((F.length(low) - F.length(F.replace(low, F.lit(p), F.lit("")))) / len(p)).cast("int")
    return total


def sentences(text: Column) -> Column:
    """Normalized sentences that aren't empty."""
    return F.filter(F.transform(F.split(text, "[。！？.!?；;\n]+"), normalized), lambda s: F.length(s) > 0)


def line_column(text: Column, start: Column) -> Column:
    """(line, column) of a place; a line ends with a line feed, with or without a carriage return."""
    before = F.substring(text, F.lit(1), start)
    return F.struct((F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1).alias("line"), (F.length(F.regexp_replace(before, "(?s)^.*\n", "")) + 1).alias("column"))


def excerpt(text: Column, most: int = 40) -> Column:
    """At most 40 characters, the last one an ellipsis if some are left out."""
    one = F.regexp_replace(text, "\r?\n", " ")
    return F.when(F.length(one) > most, F.concat(F.substring(one, 1, most - 3), F.lit("…"))).otherwise(one)


def utf8_length(text: Column) -> Column:
    return F.octet_length(text)


def extension(name: Column) -> Column:
    """The file name's part from its last dot, in lower case; empty without a dot."""
    return F.lower(F.regexp_extract(name, "(\\.[^.]*)$", 1))


def page_label(pages: Column) -> Column:
    """The page numbers from 1 on, in order, joined; null without any."""
    known = F.array_sort(F.array_distinct(F.filter(pages, lambda p: p >= 1)))
    return F.when(F.size(known) > 0, F.array_join(F.transform(known, lambda p: p.cast("string")), "、"))
