"""Column functions and similarity on literal values."""

from __future__ import annotations

import datetime
import math

import pytest
from pyspark.sql import functions as F

from proofmill.functions import scores, text
from proofmill.operators import similarity
from proofmill.operators.gram_index import GramIndex, rounded


@pytest.fixture(scope="module")
def value(spark):  # noqa: ANN001, ANN201
    return lambda c: spark.range(1).select(c.alias("x")).first().x


def plain(x):  # noqa: ANN001, ANN201
    return [tuple(r) for r in x]


def test_matches_and_their_places(value):  # noqa: ANN001, ANN201
    assert plain(value(text.matches(F.lit("a1b22😀333"), "\\d+"))) == [(1, "1"), (3, "22"), (6, "333")]
    assert value(text.matches(F.lit("none"), "\\d+")) == [] and value(text.matches(F.lit(""), "x")) == []
    many = "ab " * 2000
    assert plain(value(text.matches(F.lit(many), "b"))) == [(3 * i + 1, "b") for i in range(2000)]


def test_scan_folds_in_blocks(value):  # noqa: ANN001, ANN201
    step = lambda a, x: F.struct((a["s"] + x).alias("s"), F.concat(a["out"], F.array(a["s"] + x)).alias("out"))
    for n in (0, 1, 255, 256, 257, 1000):
        items = F.array(*[]).cast("array<bigint>") if not n else F.sequence(F.lit(1).cast("long"), F.lit(n).cast("long"))
        assert value(text.scan(items, F.lit(0).cast("long"), step, "bigint")) == [i * (i + 1) // 2 for i in range(1, n + 1)]


def test_ngrams_are_sets_of_code_points(value):  # noqa: ANN001, ANN201
    grams = lambda t: sorted(value(text.char_ngrams(F.lit(t))))
    assert grams("") == [] and grams("abc") == ["abc"] and grams("abcde") == ["abcde"]
    assert grams("aaaaaaa") == ["aaaaa"] and grams("abcdefg") == ["abcde", "bcdef", "cdefg"]
    assert grams("a😀b😀😀c") == sorted(["a😀b😀😀", "😀b😀😀c"]) and grams("ab\ncdef") == sorted(["ab\ncd", "b\ncde", "\ncdef"])


def test_jaccard_of_empty_sets(value):  # noqa: ANN001, ANN201
    none, some = F.array().cast("array<string>"), F.array(F.lit("a"), F.lit("b"))
    assert [value(text.jaccard(a, b)) for a, b in ((none, none), (none, some), (some, some), (some, F.array(F.lit("b"), F.lit("c"))))] == [1.0, 0.0, 1.0, 1 / 3]


def test_normalized_strip_and_compact(value):  # noqa: ANN001, ANN201
    assert value(text.normalized(F.lit("ALPHA,   beta!! gamma; delta epsilon."))) == "alpha beta gamma delta epsilon"
    assert value(text.normalized(F.lit(" a - b\t"))) == "a  b"
    assert value(text.strip(F.lit("　  a b \n"))) == "a b" and value(text.compact(F.lit(" A　b\tC "))) == "abc"


def test_line_and_column(value):  # noqa: ANN001, ANN201
    at = lambda t, i: tuple(value(text.line_column(F.lit(t), F.lit(i))))
    assert at("abc", 0) == (1, 1) and at("abc", 2) == (1, 3) and at("a\nbc", 2) == (2, 1) and at("a\r\nbc\n", 4) == (2, 2) and at("a\n\nb", 3) == (3, 1)


def test_excerpt_extension_pages_and_bytes(value):  # noqa: ANN001, ANN201
    assert value(text.excerpt(F.lit("x" * 40))) == "x" * 40 and value(text.excerpt(F.lit("ab\r\n" + "x" * 40))) == "ab " + "x" * 34 + "…"
    assert [value(text.extension(F.lit(n))) for n in ("a.b.TXT", "none", ".md", "a.")] == [".txt", "", ".md", "."]
    pages = lambda *p: value(text.page_label(F.array(*map(F.lit, p))))
    assert pages(10, 9, 9, 0, 2) == "2、9、10" and pages(0) is None
    assert value(text.utf8_length(F.lit("é漢😀"))) == 9


def test_radar_points(value):  # noqa: ANN001, ANN201
    for i, ratio in ((0, 1.0), (1, 0.5), (3, 0.25)):
        p = value(scores.radar_point(F.lit(i), F.lit(5), F.lit(ratio)))
        angle = 2 * math.pi * i / 5 - math.pi / 2
        assert math.isclose(p.x, 110 + 82 * ratio * math.cos(angle)) and math.isclose(p.y, 110 + 82 * ratio * math.sin(angle))


def test_scores(value):  # noqa: ANN001, ANN201
    assert [value(scores.round_half_up(F.lit(x))) for x in (0.25, 0.35, 84.04, 84.05, 1.0)] == [0.3, 0.4, 84.0, 84.1, 1.0]
    assert [value(scores.decile(F.lit(float(x)))) for x in (0, 9.9, 10, 99.9, 100, 120)] == ["0-9", "0-9", "10-19", "90-99", "100", "100"]
    assert [value(scores.grade(F.lit(float(x)))) for x in (90, 89.9, 80, 60, 59.9)] == ["优秀", "良好", "良好", "一般", "待提升"]
    assert value(scores.normative_score(F.lit(1), F.lit(2), F.lit(3))) == 79.0 and value(scores.normative_score(F.lit(9), F.lit(9), F.lit(None))) == 0.0
    assert value(scores.originality_score(F.lit(0.27))) == 73.0 and value(scores.originality_score(F.lit(1.5))) == 0.0
    assert value(scores.percent_label(F.lit(0.37))) == "37.0%"
    number = lambda j: value(scores.json_number(F.lit(j), "$.k"))
    assert [number(j) for j in ('{"k":5}', '{"k":null}', "{}", '{"k":"x"}', "no json")] == [5.0, 0.0, None, None, None]
    assert value(scores.date_of(F.lit("2026-08-04T23:30:00.000Z"))) == datetime.date(2026, 8, 4) and value(scores.date_of(F.lit("never"))) is None
    assert value(scores.china_time(F.lit("2026-08-04 16:30:00").cast("timestamp"))) == "2026-08-05 00:30"


def test_threshold():  # noqa: ANN201
    assert [similarity.clamp_threshold(x) for x in (None, "", "0.3", 2, -1, "x")] == [0.0, 0.0, 0.3, 1.0, 0.0, 0.65]


def test_writing_risk_to_five_places(spark):  # noqa: ANN001, ANN201
    line = "首先相关问题因此。"
    docs = spark.createDataFrame([(1, f"{line}\n{line}\nabc de. f"), (2, ""), (3, "one sentence only")], "doc_id int, text string")
    got = {r.doc_id: r for r in similarity.writing_risk(docs, spark.createDataFrame([(1, 0.1)], "doc_id int, total_similarity_rate double")).collect()}
    # Three paragraphs, one repeated; sentences of 8, 8, 6 and 1 characters; 4 connectors and 2 vague phrases in 25.
    mean = (8 + 8 + 6 + 1) / 4
    spread = math.sqrt(sum((x - mean) ** 2 for x in (8, 8, 6, 1)) / 4)
    expected = (round(10 + 100 / 3, 5), round((1 - spread / mean) * 100, 5), 100.0, round(2 / 26 * 1200, 5))
    factors = tuple(getattr(got[1], n) for n in similarity.RISK_WEIGHTS)
    assert factors == pytest.approx((expected[0], expected[1], expected[2], factors[3]), abs=1e-5)
    assert factors[3] == pytest.approx(2 / len("首先相关问题因此 首先相关问题因此 abc de f") * 1200, abs=1e-5)
    assert got[1].risk_score == pytest.approx(sum(f * w for f, w in zip(factors, similarity.RISK_WEIGHTS.values(), strict=True)), abs=1e-5)
    assert got[3].sentence_length_low_variation == 0.0 and got[2].risk_score == 0.0


def jaccard_of(a: str, b: str) -> float:
    sets = []
    for t in (a, b):
        t = "".join(c for c in " ".join(t.lower().split()) if c.isalnum() or c == " ").strip()
        sets.append({t[i : i + 5] for i in range(max(1, len(t) - 4))} if t else set())
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1]) if sets[0] | sets[1] else 1.0


@pytest.mark.parametrize("most", [similarity.BROADCAST_CHARS, 0])
def test_pairs_against_every_pair(spark, monkeypatch, most):  # noqa: ANN001, ANN201
    """Neither the index nor the cuts lose a pair: rare and common grams, equal and unequal sizes, ties and repeated texts."""
    import random

    monkeypatch.setattr(similarity, "BROADCAST_CHARS", most)

    rng = random.Random(4)
    words = ["alpha", "beta", "gamma", "delta", "rho", "sigma", "of", "the", "and"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 30))) for _ in range(60)]
    texts += [t + " tail" for t in texts[:20]] + [texts[0], "", "a"]
    left, right = texts, texts[::3]
    a = spark.createDataFrame(list(enumerate(left)), "doc_id int, text string")
    b = spark.createDataFrame(list(enumerate(right)), "sample_id int, text string")
    for t in (0.3, 0.65, 0.9, 1.0):
        got = {(r.doc_id, r.sample_id): r.score for r in similarity.pair_scores(a, b, ["doc_id"], ["sample_id"], t).collect()}
        expected = {(i, j): s for i, x in enumerate(left) for j, y in enumerate(right) if x and y and (s := jaccard_of(x, y)) >= t}
        assert got == pytest.approx(expected)


@pytest.mark.parametrize("chars", [similarity.BROADCAST_CHARS, 0])
def test_best_matches_are_those_of_all_pairs(spark, monkeypatch, chars):  # noqa: ANN001, ANN201
    import random

    monkeypatch.setattr(similarity, "BROADCAST_CHARS", chars)
    rng = random.Random(8)
    words = ["alpha", "beta", "gamma", "delta", "rho", "sigma", "of", "the", "and", "Ωmega", "漢字"]
    line = lambda: " ".join(rng.choices(words, k=rng.randrange(1, 12)))
    samples = ["\n".join(line() for _ in range(rng.randrange(1, 4))) for _ in range(30)]
    texts = ["\n".join(rng.choice([line(), rng.choice(samples), rng.choice(samples) + " x"]) for _ in range(rng.randrange(0, 5))) for _ in range(25)]
    docs = spark.createDataFrame([*enumerate(texts), (98, None)], "doc_id int, text string")
    corpus = spark.createDataFrame([*enumerate(samples), (99, "")], "item_id int, text string")
    for most in (1, 5):
        got = {(r.doc_id, r.sample_id, r.jaccard_score, r.rank, tuple(sorted(tuple(x) for x in r.spans))) for r in similarity.best_matches(docs, corpus, 0.3, most=most).collect()}
        spans = similarity._scored(docs, corpus, 0.3, "item_id")
        want = {(r.doc_id, r.sample_id, r.jaccard_score, r.rank, tuple(sorted(tuple(x) for x in r.spans))) for r in similarity.top_matches(spans, most).collect()}
        assert len(want) > 15 and got == want


def test_bounds_save_counting():  # noqa: ANN201
    """Of a document's candidates above the threshold only those are counted whose bound passes its own fifth best."""
    import random

    rng = random.Random(5)
    base = "".join(rng.choices("abcdefghij ", k=400))
    changed = lambda k: "".join(c if i % 400 not in spots else "z" for spots in [set(rng.sample(range(400), k))] for i, c in enumerate(base))
    samples = [changed(k % 40) for k in range(200)]
    index = GramIndex(list(range(200)), samples)
    sides = [(index, dict(enumerate(range(200)))), (GramIndex([], []), {})]
    best, counted = similarity.best_samples(sides, [base], [], 0.3, 0.3, 5)
    every = sorted(((-rounded(s), i) for i, s, _ in index.matches(base, 0.3)))
    assert [(sample, score) for sample, score, _ in best] == [(i, -s) for s, i in every[:5]]
    assert len(every) > 150 and counted < len(every) / 2


def test_five_best_of_a_corpus(spark):  # noqa: ANN001, ANN201
    base = "the same sentence about the same thing over and over again"
    corpus = spark.createDataFrame([(i, base + " x" * i) for i in range(6)] + [(9, "nothing in common here at all")], "item_id int, text string")
    docs = spark.createDataFrame([(1, base)], "doc_id int, text string")
    top = similarity.top_matches(similarity.document_pairs(docs, corpus, 0.3)).orderBy("rank").collect()
    assert [(r.sample_id, r.rank) for r in top] == [(i, i + 1) for i in range(5)] and top[0].jaccard_score == 1.0
    rate = similarity.similarity_rate(docs, corpus, 0.3).first()
    assert (rate.effective_characters, rate.matched_characters, rate.total_similarity_rate) == (len(base), len(base), 1.0)
    with pytest.raises(ValueError):
        similarity.document_pairs(docs, corpus, 0.0)


def test_paragraphs_and_their_places(spark):  # noqa: ANN001, ANN201
    docs = spark.createDataFrame([(1, " a b \n\n　漢😀\r\nc"), (2, ""), (3, None)], "doc_id int, text string")
    assert [tuple(r) for r in similarity.paragraphs(docs).collect()] == [(1, 0, "a b", 1, 4), (1, 2, "漢😀", 8, 10), (1, 3, "c", 12, 13)]


def test_an_empty_corpus_gives_no_pairs(spark):  # noqa: ANN001, ANN201
    docs = spark.createDataFrame([(1, "some text here")], "doc_id int, text string")
    none = spark.createDataFrame([], "item_id int, text string")
    assert similarity.document_pairs(docs, none, 0.3).collect() == []
    assert similarity.report_status("campus_corpus", none) == "no_samples" and similarity.report_status("campus_corpus", docs) == "completed"


def test_candidates_of_many_texts_are_those_that_reach_the_threshold():  # noqa: ANN201
    """All grams that two texts have in common are counted, so no pair is compared in vain; short, long and empty texts too."""
    import random

    rng = random.Random(9)
    words = ["".join(rng.choices("aeiou nrst😀漢", k=rng.randint(1, 7))) for _ in range(40)]
    make = lambda k: " ".join(rng.choices(words, k=k))
    corpus = ["", "ab", "abcde", *(make(rng.randint(1, 30)) for _ in range(60))]
    texts = ["", "ab", "abc", "abcde", "x" * 5000, make(4000), *(make(rng.randint(1, 40)) for _ in range(200)), *(t + "zz" for t in corpus)]
    index = GramIndex(list(range(len(corpus))), corpus)
    index.CHARS = 3000
    for t in (0.1, 0.3, 0.65, 1.0):
        scores = [{i: similarity.jaccard_of(similarity.gram_set(x), similarity.gram_set(c)) for i, c in enumerate(corpus) if x and c} for x in texts]
        want = [{i: s for i, s in of.items() if s >= t} for of in scores]
        assert [{i: s for i, s, _ in found} for found in index.matches_of(texts, t)] == want
        assert [{index.ids[u]: bound for u, bound in found} for found in index.candidates_of(texts, t)] == want
