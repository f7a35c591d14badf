"""Cases that once failed: no labels, clashing names, rows that share a doc_id."""

from pyspark.sql import functions as F

from lodestep.llm import _labels, repeats, url_filter


def test_url_verdicts_without_labels_or_with_one_class(spark):
    pages = spark.createDataFrame([(1, "http://a.example.com/x"), (2, None), (3, "http://b.org/" + "y" * 50_000)], "page_id long, url string")
    none = spark.createDataFrame([(None, 1.0), ("http://x.com/", 7.0)], "url string, label double")
    got = {r.page_id: (r.rule, r.verdict, r.score) for r in url_filter.verdicts(pages, [("block", "org/")], none).collect()}
    assert got == {1: (None, "allow", None), 2: (None, "allow", None), 3: ("org/", "block", None)}
    for label, verdict in ((0.0, "allow"), (1.0, "block")):
        one = spark.createDataFrame([("http://x.com/", label)], "url string, label double")
        assert {r.verdict for r in url_filter.verdicts(pages, [], one).collect()} == {verdict}


def test_passages_are_cut_from_the_text_they_were_found_in(spark):
    said = "These seven words stand in both texts. "
    rows = [(1, said + "First of all."), (2, "Some other words here. " + said), (2, "An unlike text that has the same id and a length of its own."), (3, None)]
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, spans int, Span_Doc int")
    left = repeats.remove_passages(docs, repeats.repeats(docs, with_hash=True))
    assert left.columns == docs.columns
    texts = [r.text for r in left.collect()]
    assert rows[0][1] in texts and rows[2][1] in texts and None in texts
    assert any(t is not None and t.startswith("Some other words here.") and "seven" not in t for t in texts)


def test_ids_with_both_labels_train_nothing(spark):
    ids = [i for i in range(60)]
    docs = spark.createDataFrame([(i, f"text {i}") for i in ids], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in ids] + [(0, 1), (7, 0), (9, 1)], "doc_id long, y int")
    held = {r.doc_id for r in docs.where(_labels.held_out(F.col("doc_id"))).collect()}
    texts, ys, share = _labels.sample(docs, labels, "y", 100, 100)
    want = {f"text {i}": i % 2 for i in ids if i not in held and i not in (0, 7)}
    assert dict(zip(texts, ys)) == want and len(texts) == len(want)
    assert share == sum(want.values()) / len(want)


def test_a_long_text_that_repeats_in_every_other_sentence_costs_its_length(spark):
    import time

    from lodestep.llm.repeats import remove_passages, repeats as found

    def run(n):
        shared = [f"The shared sentence of number {i} stands in both texts here. " for i in range(n)]
        texts = ["".join(s + f"Own words {i * k} of text {k} that nothing repeats at all {i + 7 * k}. " for i, s in enumerate(shared)) for k in (3, 11)]
        docs = spark.createDataFrame([(1, texts[0]), (2, texts[1]), (3, None)], "doc_id long, text string")
        began = time.perf_counter()
        spans = found(docs, with_hash=True)
        rows = spans.collect()
        took = time.perf_counter() - began
        left = {r.doc_id: r.text for r in remove_passages(docs, spans).collect()}
        return took, rows, texts, left

    run(50)
    small, _, _, _ = run(500)
    large, rows, texts, left = run(4000)
    assert {r.doc_id for r in rows} == {2} and len(rows) == 4000 and large < 8 * small + 10
    cut, at = [], 0
    for r in sorted(rows, key=lambda r: r.first_char):
        cut.append(texts[1][at : r.first_char])
        at = r.end_char
    assert left == {1: texts[0], 2: "".join(cut) + texts[1][at:], 3: None} and "number" not in left[2]
