import random
import re

from lodestep.llm import queries, repeats

SCHEMA = "doc_id long, text string"


def found(spark, rows, **how):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return sorted(map(tuple, repeats.repeats(df, **how).collect()))


def fresh(rng, n):
    return " ".join("".join(rng.choices("abcdefghijklmno", k=7)) for _ in range(n))


def test_passage_cut_inside_its_sentences_is_joined_to_the_word(spark):
    rng = random.Random(5)
    sentences = [fresh(rng, 12) + "." for _ in range(4)]
    passage = " ".join(sentences)
    words = passage.split()
    piece = " ".join(words[5:-5])  # two whole sentences, and parts of two others
    a = f"{fresh(rng, 30)}. {passage} {fresh(rng, 20)}."
    lead = fresh(rng, 6)
    b = f"{lead} {piece.upper()} {fresh(rng, 8)}."
    assert [(b[r[1] : r[2]], *r[3:]) for r in found(spark, [(1, a), (2, b)])] == [(piece.upper(), 38, 2, 1)]


def test_long_match_beyond_an_end_is_followed_to_its_last_word(spark):
    rng = random.Random(6)
    unit, tail = fresh(rng, 9) + ".", fresh(rng, 900)
    a, b = f"{fresh(rng, 4)} . {unit} {tail} {fresh(rng, 3)}.", f"{unit}\n{tail.replace(' ', '  ')} {fresh(rng, 3)}."
    assert [(r[0], r[1], r[3], r[4]) for r in found(spark, [(1, a), (2, b)])] == [(2, 0, 909, 1)]


def test_short_repeated_lines_are_reported(spark):
    rng = random.Random(7)
    rows = [(i, f"{fresh(rng, 9)}\nles.\n{fresh(rng, 9)}\nnine words of a line that all share here\n{fresh(rng, 7)}") for i in range(20)]
    got = found(spark, rows + [(None, rows[0][1]), (90, None), (91, "")])
    texts = dict(rows)
    assert {r[0] for r in got} == set(range(1, 20)) and all(r[5] == 0 for r in got)
    assert sorted(texts[r[0]][r[1] : r[2]] for r in got) == ["les."] * 19 + ["nine words of a line that all share here"] * 19
    assert found(spark, rows, least_words=5) == [r for r in got if r[3] >= 5]


def test_every_reported_passage_occurs_before_and_every_repeated_line_is_in_one(spark):
    rng = random.Random(8)
    pool = [fresh(rng, rng.randint(1, 12)) + rng.choice(["", "."]) for _ in range(12)]
    rows = [(i, "\n".join(rng.choice(pool) if rng.random() < 0.5 else fresh(rng, 8) for _ in range(8))) for i in range(40)]
    got = found(spark, rows + [rows[3]])
    seen = set()
    for i, text in rows:
        at, spans = 0, [(r[1], r[2]) for r in got if r[0] == i]
        assert all(b <= c for (_, b), (c, _) in zip(spans, spans[1:]))
        assert all(len(re.findall(r"\S+", text[r[1] : r[2]])) == r[3] for r in got if r[0] == i)
        for line in text.split("\n"):
            inside = any(a <= at and at + len(line) <= b for a, b in spans)
            assert inside == (line in seen)
            seen.add(line)
            at += len(line) + 1


def test_query_reports_below_thirty_words(spark, tmp_path):
    rows = [(i, f"own {i} words {i * 7} here {i * 31} stand\nthis line of nine words is in every document") for i in range(5)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    assert sorted(r.doc_id for r in queries.op4_repeats(spark, str(tmp_path)).collect()) == [1, 2, 3, 4]
