"""Cases at the edges of the dealt operators: odd strings, awkward rows, tails and limits."""

from __future__ import annotations

import math
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from proofmill.llm import decontam, html_text, line_dedup, packing, quality_model, rules, secrets, substring_dedup
from tests.llm.test_operators import DATA, SCHEMA, TEXTS

BPE = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def docs(spark):  # noqa: ANN001, ANN201
    return spark.createDataFrame([(i, t, None, None, None if t is None else len(t), "k", *[1] * 10) for i, t in TEXTS], SCHEMA)


# Packing


def odd_strings(n: int = 4000) -> list[str]:
    rng = random.Random(3)
    settled = [chr(c) for c in range(0x250)] * 2 + list(" \n\t\r'\x85\xa0 sdtmrevl09") * 30
    odd = [" ", " ", "　", "漢", "字", "🙂", "‍", "٣", "Ω", "퟿", " "] * 20
    made = ["".join(rng.choice(settled if k % 2 else settled + odd) for _ in range(rng.randrange(60))) for k in range(n)]
    made += [w + " " * k + "z" for w in ("a", "\n", "é") for k in (1, 2, 3, 199, 200, 201, 30_000)]
    return [*made, "<|endoftext|>x", " " * 300_000 + "a", "\n" * 300 + "b", "a" * 100_000, "\0 \0", " \n \n  \n x" * 500]


def test_ids_are_the_librarys_whatever_the_text():  # noqa: ANN201
    assert packing.merges_by_rank(BPE)
    ids, texts = packing.Ids(BPE, True), odd_strings()
    assert ids.by_rank is not None and ids.documents(texts) == ids.encode(texts)


def test_a_file_that_splits_otherwise_goes_to_the_library_whole():  # noqa: ANN201
    spec = packing._spec(BPE)
    assert packing.splits_plainly(spec) and packing.ranks_of(spec)
    pre = spec["pre_tokenizer"]
    for other in ({"normalizer": {"type": "Lowercase"}}, {"pre_tokenizer": pre | {"add_prefix_space": True}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"pre_tokenizer": None}):
        assert not packing.splits_plainly(spec | other)
    assert packing.ranks_of(spec | {"model": spec["model"] | {"dropout": 0.1}}) is None
    whole = packing.Ids(BPE, False)
    whole.plain = False
    texts = ["one two", "", "漢字 x"]
    assert whole.documents(texts) == whole.encode(texts) and not whole


def test_packing_of_awkward_rows(docs):  # noqa: ANN001, ANN201
    """Null and repeated ids are packed each for itself, and no column of the table gets in the way."""
    pieces = packing.pack(docs, BPE).collect()
    assert sorted(p.doc_id for p in pieces if p.start == 0 and p.doc_id is not None) == sorted(i for i, _ in TEXTS if i is not None)
    assert sum(p.doc_id is None and p.start == 0 for p in pieces) == 2
    by_sequence: dict[int, list] = {}
    for p in pieces:
        by_sequence.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for i, spans in by_sequence.items():
        spans.sort()
        assert [o for o, _ in spans] == [0, *np.cumsum([n for _, n in spans])[:-1]] and (i == max(by_sequence) or sum(n for _, n in spans) == 1024)
    assert [p.doc_tokens for p in pieces if p.doc_id in (1, 2)] == [1, 1]


# Secrets


def test_normal_tail_is_right_far_out(spark):  # noqa: ANN001, ANN201
    rows = spark.createDataFrame([(z,) for z in (-36.0, -20.0, -8.0, -6.0, -5.0, -3.0, -2.01, -2.0, -1.99, -1.0, -0.3, 0.0, 0.5, 2.0, 4.0)], "z double")
    for r in rows.select("z", secrets._normal_tail(F.col("z")).alias("p")).collect():
        assert r.p == pytest.approx(0.5 * math.erfc(-r.z / math.sqrt(2)), rel=1e-5)


def battery_of(s: str) -> tuple[str, int, float, bool]:
    """Encoding, stratum, p of 'this is text' and whether it passes as random, in plain Python."""
    plain = s.translate(str.maketrans("-_", "+/"))
    for name, _, alphabet, more in secrets.ENCODINGS:
        if set(s) <= set(alphabet) or name == "base64":
            break
    c = [alphabet.index(x) + 1 for x in plain]
    n, a = len(c), len(alphabet)
    x2 = sum(c.count(v) ** 2 for v in set(c)) * a / n - n
    sides = [2 * v > a for v in c]
    high, runs = sum(sides), 1 + sum(p != q for p, q in zip(sides, sides[1:], strict=False))
    two = 2 * high * (n - high)
    var = two * (two - n) / (n * n * (n - 1))
    mean = sum(c) / n
    spread = sum(v * v for v in c) - n * mean * mean
    serial = sum(p * q for p, q in zip(c, c[1:], strict=False)) - n * mean * mean
    random_ = x2 <= a - 1 + secrets.Z * math.sqrt(2 * (a - 1)) and var > 0 and abs(runs - two / n - 1) <= secrets.Z * math.sqrt(var) and spread > 0 and abs(serial / spread) * math.sqrt(n) <= secrets.Z
    z = (x2 - (a - 1) - more * n) / math.sqrt(2 * (a - 1 + 2 * more * n))
    return name, int(math.log2(n)), 0.5 * math.erfc(-z / math.sqrt(2)), random_ and name != "decimal"


def test_random_spans_against_plain_python(spark):  # noqa: ANN001, ANN201
    rng = random.Random(8)
    letters = secrets.ENCODINGS[-1][2]
    made = ["".join(rng.choice(letters) for _ in range(rng.choice([16, 20, 33, 64]))) for _ in range(40)]
    made += ["".join(rng.choice("0123456789ABCDEF") for _ in range(32)) for _ in range(10)] + ["".join(rng.choice("0123456789") for _ in range(20)) for _ in range(10)]
    made += ["_".join(rng.choice(["internal", "documentation", "register", "of", "long", "names"]) for _ in range(4)) for _ in range(60)]
    made = [s for s in made if len(s) >= 16]
    got = {r.doc_id for r in secrets.scan(spark.createDataFrame(list(enumerate(made)), "doc_id long, text string")).where("n_random > 0").collect()}
    strata: dict[tuple, list] = {}
    for i, s in enumerate(made):
        encoding, size, p, random_ = battery_of(s)
        strata.setdefault((encoding, size), []).append((math.floor(-math.log10(p) / secrets.BIN), i, random_))
    expected = set()
    for rows in strata.values():
        cut = [b for b, *_ in rows if len(rows) * 10 ** (-b * secrets.BIN) <= secrets.Q * sum(x >= b for x, *_ in rows)]
        expected |= {i for b, i, random_ in rows if cut and b >= min(cut) and random_}
    assert got == expected and len(got) > 30


def test_many_spans_in_one_text(spark):  # noqa: ANN001, ANN201
    text = "AKIA" + "A" * 12 + " "
    r = secrets.scan(spark.createDataFrame([(1, text * 3000)], "doc_id long, text string")).first()
    assert r.n_access == 3000 and r.spans.split(",")[-1].endswith(f"access:{17 * 2999}:{17 * 2999 + 16}")


# Decontamination


def test_short_items_can_be_left_out_and_rows_are_judged_by_their_text(spark):  # noqa: ANN001, ANN201
    item = "the exact wording of a question that a benchmark asks"
    bench = spark.createDataFrame([(1, item), (2, "yes"), (3, None), (4, "...")], "item_id long, text string")
    rows = [(None, f"it said {item} here"), (1, f"and {item}"), (1, "yes it is clean"), (None, None), (2, "")]
    frame = spark.createDataFrame([(*r, [1], {"a": 2.0}) for r in rows], "doc_id long, text string, _hit array<int>, item_id map<string,double>")
    assert sorted((r.doc_id or 0, r.item_id) for r in decontam.contaminated(frame, bench, least=24).collect()) == [(0, 1), (1, 1)]
    kept = decontam.clean(frame, bench, least=24)
    assert kept.schema == frame.schema and [(r.doc_id, r.text) for r in kept.collect()] == [(1, "yes it is clean"), (None, None), (2, "")]
    assert {r.item_id for r in decontam.contaminated(frame, bench).collect()} == {1, 2}
    assert [(r.doc_id, r.text) for r in decontam.clean(frame, bench).collect()] == [(None, None), (2, "")]


def test_a_benchmark_of_several_blocks(spark, monkeypatch):  # noqa: ANN001, ANN201
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 120)
    items = [(i, f"question number {i} has quite a particular wording {i * 7919}") for i in range(12)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    frame = spark.createDataFrame([(i, f"before {t} after") for i, t in items] + [(99, "clean")], "doc_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontam.contaminated(frame, bench).collect()} >= {(i, i) for i, _ in items}
    assert [r.doc_id for r in decontam.clean(frame, bench).collect()] == [99]


# Quality rules


def test_places_of_windows_in_very_long_texts(spark, monkeypatch):  # noqa: ANN001, ANN201
    """The way for texts whose places don't fit beside a hash counts the same."""
    table = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = table.select("doc_id", "text").unionByName(spark.createDataFrame([(-1, "a b c a b c a b"), (-2, "x " * 500), (-3, None)], "doc_id long, text string"))
    short = sorted(map(tuple, rules.evaluate(rows).collect()))
    monkeypatch.setattr(rules, "PACKED_WORDS", 0)
    assert sorted(map(tuple, rules.evaluate(rows).collect())) == short


# Line dedup


def test_runs_are_saved_and_opened_again(spark, tmp_path):  # noqa: ANN001, ANN201
    batch = lambda top: spark.createDataFrame([(top, 1, 1), (top - 1, 1, 1), (top, top, 0)], "doc_id long, h1 long, h2 long")
    one, two = line_dedup.LineRuns(fanout=2), line_dedup.LineRuns(fanout=2)
    for top in (40, 30, 20):
        one.add(batch(top)), two.add(batch(top))
    two.save(str(tmp_path / "runs"))
    two = line_dedup.LineRuns.load(spark, str(tmp_path / "runs"), fanout=2)
    assert [len(x) for x in two.levels] == [1, 1]
    one.add(batch(10)), two.add(batch(10))
    assert sorted(map(tuple, one.counts().collect())) == sorted(map(tuple, two.counts().collect())) and [len(x) for x in two.levels] == [len(x) for x in one.levels]


# Substring dedup


def test_sentences_with_a_partner_each_are_no_passage(spark):  # noqa: ANN001, ANN201
    """Four sentences that stand one each in four other documents make no run together."""
    own = [f"Sentence number {i} says {' '.join(f's{i}w{j}' for j in range(12))}." for i in range(4)]
    texts = [(10, " ".join(own))] + [(i, f"Other text {i} here. {s} And more of {i}.") for i, s in enumerate(own)]
    frame = spark.createDataFrame(texts, "doc_id long, text string")
    assert substring_dedup.repeated_passages(frame).collect() == []
    assert {r.doc_id: r.text for r in substring_dedup.remove_repeats(frame).collect()} == dict(texts)


def test_equal_words_inside_different_lines(spark):  # noqa: ANN001, ANN201
    passage = " ".join(f"shared{i}" for i in range(60))
    texts = {i: f"{' '.join(f'a{i}x{j}' for j in range(20))} {passage.upper() if i else passage} {' '.join(f'b{i}x{j}' for j in range(20))}" for i in range(3)}
    rows = substring_dedup.repeated_passages(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).where("kind = 'run'").collect()
    assert sorted((r.doc_id, texts[r.doc_id][r.start : r.end].lower(), r.component_id, r.kept, r.words) for r in rows) == [(i, passage, 0, i == 0, 60) for i in range(3)]


def test_passages_of_awkward_rows(spark, docs):  # noqa: ANN001, ANN201
    rows = substring_dedup.repeated_passages(docs).collect()
    texts: dict[int, list[str]] = {}
    for i, t in TEXTS:
        texts.setdefault(i, []).append(t or "")
    # Documents 7 and 8 share all of a very long text, and 8 has one word more.
    long = [r for r in rows if r.doc_id in (7, 8) and r.kind == "run"]
    assert sorted((r.doc_id, r.start, r.end, r.kept) for r in long) == [(7, 0, len(texts[7][0]), True), (8, 0, len(texts[7][0]), False)]
    assert all(r.doc_id is not None and r.component_id <= r.doc_id and 0 <= r.start < r.end for r in rows)


# Classifier


def test_scores_without_any_labels(spark, docs):  # noqa: ANN001, ANN201
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for labels in (none, spark.createDataFrame([(4, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")):
        got = quality_model.score_quality(docs, labels).collect()
        assert len(got) == len(TEXTS) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)


# Pages


def test_pages_of_awkward_rows(spark):  # noqa: ANN001, ANN201
    schema = "page_id long, url string, html string, text string, n_chars long, words long"
    paragraph = " ".join(f"word{i}" for i in range(60))
    page = f"<body><article><p>{paragraph}</p></article></body>"
    long = f"<body><article>{'<p>' + paragraph + '</p>'}" + f"<p>{paragraph}</p>" * 3000 + "</article></body>"
    rows = [(1, "u", page, "x", 5, 1), (1, "u", page, "x", 5, 1), (None, None, None, None, None, None), (2, "v", "", "y", 1, 1), (3, "w", long, "", 0, 0), (4, "t", "no markup at all", "", 0, 0)]
    got = html_text.extract(spark.createDataFrame(rows, schema)).collect()
    assert [(r.page_id, r.url, r.n_chars) for r in got][:4] == [(1, "u", len(paragraph)), (1, "u", len(paragraph)), (None, None, 0), (2, "v", 0)]
    assert got[4].text == "\n\n".join([paragraph] * 3001) and all(r.n_chars == len(r.text) for r in got) and got[0].text == paragraph
    assert html_text.extract(spark.createDataFrame([], schema)).collect() == []
