import random

import corpus_pipeline
from lodestep.llm import fuzzy_lines, queries
from tests.llm.test_lines_and_passages import brute_lines

SCHEMA = "doc_id long, text string"


def corpus():
    rng = random.Random(4)
    short = ["les.", "and ornd.", "wh the.", "x", "é", "abcdefgh", "abcdefghi", "abcdefghijk", "abcdefghijkl", "zbcdefghijkl"]
    rows = [(i, "\n".join(["les.", "", *(rng.choice(short) for _ in range(5)), f"a line of its own with number {i * 7919}", " "])) for i in range(40)]
    return rows + [(90, "ORND.  \nAnd  ornd."), (91, None), (92, ""), (None, "les.")]


def test_short_lines_match_brute_force(spark):
    rows = corpus()
    groups = {}
    for r in fuzzy_lines.line_groups(spark.createDataFrame(rows, SCHEMA).repartition(3), least_chars=1).collect():
        groups.setdefault(r.component, []).append(((r.doc_id, r.line), r.kept))
    got = {frozenset(p for p, _ in g): [p for p, kept in g if kept] for g in groups.values()}
    assert got == {g: [keep] for g, keep in brute_lines(rows, 1).items()}


def test_query_and_stage_judge_short_lines(spark, tmp_path):
    rows = [(1, "les.\n\nfirst own line"), (2, "second line of its own\nLES.\n"), (3, "x")]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    assert sorted((r.doc_id, r.line, r.kept) for r in queries.op6_fuzzy_lines(spark, str(tmp_path)).collect()) == [(1, 0, True), (2, 1, False)]
    left = dict(corpus_pipeline.STAGES)["line_dedup"](spark, spark.createDataFrame(rows, SCHEMA), str(tmp_path))
    assert sorted(map(tuple, left.collect())) == [(1, rows[0][1]), (2, "second line of its own\n"), (3, "x")]
