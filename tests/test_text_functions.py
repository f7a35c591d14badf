import pytest
from pyspark.sql import functions as F

from lodestep.functions import text as T


def value(spark, column, **given):
    df = spark.range(1)
    for k, v in given.items():
        df = df.withColumn(k, F.lit(v).cast("string"))
    return df.select(column.alias("x")).first().x


@pytest.mark.parametrize("text,think,response", [
    ("<think>a b</think> c", "a b", "c"), ("[THINKING]t[/THINKING][RESPONSE]r", "t", "r"), ("<think>cut off", "cut off", ""), ("[RESPONSE]only", "", "only"), (None, "", ""), ("", "", ""),
])
def test_split_think(spark, text, think, response):
    got = value(spark, T.split_think(F.col("t")), t=text)
    assert (got.think, got.response) == (think, response)


def test_assemble_inverts_split(spark):
    full = "[THINKING]one two[/THINKING][RESPONSE]three"
    assert value(spark, T.assemble(T.split_think(F.col("t"))["think"], T.split_think(F.col("t"))["response"]), t=full) == full


@pytest.mark.parametrize("text,answer,method", [
    (r"so \boxed{1} and \boxed{\frac{1}{2}}", r"\frac{1}{2}", "boxed"), (r"open \boxed{3 + 4", "3 + 4", "boxed"), ("The answer is 42.", "42.", "answer_is"), ("The answer: $7,000 now", "7,000", "answer_is"),
    ("1\n2\n3 apples\n4 pears\n5", "5", "last_number"), ("none", None, "none"), (None, None, "none"), ("99\na\nb\nc", None, "none"),
])
def test_extract_answer(spark, text, answer, method):
    got = value(spark, T.extract_answer(F.col("t")), t=text)
    assert (got.answer, got.method) == (answer, method)


@pytest.mark.parametrize("text,want", [("$1,000$", "1000"), ("5.0", "5"), (" 12% ", "12"), ("1d", "1d"), ("1e3", "1000"), (None, ""), ("x=2", "x=2"), ("2.50", "2.5"), ("-3.", "-3")])
def test_normalise(spark, text, want):
    assert value(spark, T.normalise_answer(F.col("t")), t=text) == want


@pytest.mark.parametrize("a,b,method", [("C = 506", "506", "normalised"), ("506", "506", "exact"), ("", "", "none"), (None, None, "none"), ("1.0004", "1", "float"), ("1,000", "1000", "normalised"), ("2", "3", "none")])
def test_answers_match(spark, a, b, method):
    got = value(spark, T.answers_match(F.col("a"), F.col("b")), a=a, b=b)
    assert (got.matches, got.method) == (method != "none", method)


@pytest.mark.parametrize("text,want", [
    ("1. a b\n2. c\n3. d", ["1. a b", "2. c", "3. d"]), ("pre\nStep 1: x y\nStep 2: z", ["pre", "Step 1: x y", "Step 2: z"]), ("p\n\nq\n\n\nr", ["p", "q", "r"]), ("a\nb\n", ["a", "b"]),
    ("One is. Two is! three. Four", ["One is.", "Two is! three.", "Four"]), ("", []), (None, []), ("only", ["only"]),
])
def test_segment(spark, text, want):
    assert value(spark, T.segment_steps(F.col("t")), t=text) == want


def test_approach_subject_and_flags(spark):
    assert value(spark, T.classify_approach(F.col("t"))["label"], t="The AREA of it") == "geometric"
    assert value(spark, T.classify_approach(F.col("t"))["label"], t="area and prime") == "mixed"
    assert value(spark, T.classify_approach(F.col("t"))["label"], t=None) == "unknown"
    assert value(spark, T.infer_subject(F.col("t")), t="a prime divisor and a triangle") == "number_theory"
    assert value(spark, T.infer_subject(F.col("t")), t="") == "other"
    assert value(spark, T.has_repeated_ngram(F.col("t"), 2, 3), t="a b " * 5) is True
    assert value(spark, T.has_repeated_ngram(F.col("t"), 2, 3), t="a b c d e f g") is False
    assert value(spark, T.has_repeated_ngram(F.col("t")), t=None) is False
    assert value(spark, T.is_incomplete(F.col("t")), t="It ends well here.") is False
    assert value(spark, T.is_incomplete(F.col("t")), t="it was cut") is True
    assert value(spark, T.has_han(F.col("t")), t="x 一") is True


def test_settled_region(spark):
    text = "First I count. Actually, let x be the unknown and solve for it now"
    assert value(spark, T.settled_region(F.col("t")), t=text) == ", let x be the unknown and solve for it now"
    assert value(spark, T.settled_region(F.col("t")), t="w " * 100) == " ".join(["w"] * 25)
    assert value(spark, T.thinking_switch(F.col("t")), t="hm, actually, let me use sums") == "actually, let me use"


def test_labels_and_replies(spark):
    assert value(spark, T.mechanism_label(F.col("t")), t="maybe spurious. LABEL: sound_canonical") == "sound_canonical"
    assert value(spark, T.mechanism_label(F.col("t")), t="unfaithful then flawed_lucky") == "flawed_lucky"
    assert value(spark, T.mechanism_label(F.col("t")), t="?") is None
    got = value(spark, T.channels(F.col("t")), t="<|channel|>analysis<|message|>thought<|end|><|start|>assistant<|channel|>final<|message|>done<|return|>")
    assert (got.analysis, got.final) == ("thought", "done")
    assert value(spark, T.problem_id(F.col("t")), t="p12_c3") == "p12"
    assert value(spark, T.long_steps(F.col("t")), t="a</think>long one\nxx\nlong two") == ["long one", "long two"]
    assert value(spark, T.inflate(F.array(F.lit("has 3 parts"), F.lit("end 4")), 2)) == ["has $3$ parts", *[T.P.INERT_STEPS[i] for i in (0, 1)], "end 4"]


def test_ngrams_count_like_plain_python_at_any_size(spark):
    from collections import Counter

    def plain(t, n):
        w = (t or "").split()
        c = Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
        return max(c.values(), default=0), len(c)

    texts = ["a b c d e f " * 9, "a a a a a a a", "x \t y\n z", "", None, "é ü é ü é ü é ü", " ".join(str(i % 7 + i // 40) for i in range(300))]
    for n in (1, 2, 3, 5, 20):
        got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", T.ngram_counts(F.col("t"), n).alias("c")).collect()
        assert {r.i: (r.c.most, r.c.distinct) for r in got} == {i: plain(t, n) for i, t in enumerate(texts)}


def test_a_long_text_takes_time_in_proportion(spark):
    """Slices of the words for each n-gram, or a lookup of each word in a list of those hit, took minutes."""
    import time

    from lodestep.operators import corrupt as X

    t = " ".join(map(str, range(120_000)))
    began = time.perf_counter()
    assert value(spark, T.has_repeated_ngram(F.col("t")), t=t) is False
    assert value(spark, F.size(F.split(X.diffuse_mask(F.col("t"), F.lit(1), 0.5), r"\[MASK\]")), t=t) == 60_001
    assert time.perf_counter() - began < 40


def test_fewer_words_is_the_count(spark):
    for t in (None, "", " a", "a b ", " a b c", "a b c d\n", "\t a b c d e"):
        assert value(spark, T.fewer_words(F.col("t"), 3), t=t) is (len((t or "").split()) < 3)


def test_hashes_are_those_of_single_indexes(spark):
    from lodestep.functions.rand import h, hashes

    for key in ("5", "k" * 60, ""):
        both = F.struct(hashes(F.lit(1203), 3, F.col("t"), 1).alias("a"), F.transform(F.sequence(F.lit(1), F.lit(1203)), lambda i: h(3, F.col("t"), i)).alias("b"))
        got = value(spark, both, t=key)
        assert got.a == got.b and len(got.a) == 1203
    assert value(spark, hashes(F.lit(-1), 3, F.col("t")), t="5") == []
