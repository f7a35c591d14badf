import random

import corpus_pipeline
import __spark_entry__
from lodestep.llm import toxicity
from tests.llm.test_near_dup import brute


def tables(spark, folder):
    rng = random.Random(8)
    vocabulary = [f"{a}{b}{c}" for a in "bdfgklm" for b in "aeiou" for c in ("n", "r", "st", "lo")]
    text = lambda k: "\n".join(" ".join(rng.choices(vocabulary, k=12)) for _ in range(k))
    docs = [(i, text(rng.randint(2, 6))) for i in range(300)]
    item = " ".join(rng.choices(vocabulary, k=14))
    docs += [(400, docs[7][1] + " " + item), (401, docs[9][1]), (402, docs[9][1].replace("a", "o", 1)), (403, None), (404, "")]
    toxic = {i for i, _ in docs[:300] if i % 6 == 0}
    docs = [(i, t + "\nyou idiot and moron " + vocabulary[i % 90] if i in toxic else t) for i, t in docs]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i in toxic)) for i, _ in docs[:300]], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return docs, toxic


def test_stages_take_effect(spark, tmp_path):
    folder = f"file://{tmp_path}"
    docs, toxic = tables(spark, folder)
    df = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {}
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, df, folder)
        assert out.columns == df.columns, name
        out.write.parquet(f"{folder}/out{n}")
        df = spark.read.parquet(f"{folder}/out{n}")
        kept[name] = {r.doc_id: r.text for r in df.collect()}
    caught = toxic - set(kept["toxicity"])
    assert len(caught) >= 0.9 * len(toxic) and len(set(dict(docs)) - toxic - set(kept["toxicity"])) <= 6
    emptied = set(kept["toxicity"]) - set(kept["line_dedup"])
    assert emptied == {401}  # the exact copy: every line of it stays in document 9, and only there
    assert {403, 404} <= set(kept["line_dedup"]) and set(dict(docs)[401].split("\n")) <= set(kept["line_dedup"][9].split("\n"))
    want = {i for i, (_, _, keep) in brute(list(kept["line_dedup"].items()), 5, 80).items() if keep}
    assert set(kept["near_dedup"]) == want
    assert set(kept["near_dedup"]) - set(kept["decontamination"]) == ({400} & set(kept["near_dedup"]))
    packed = corpus_pipeline.STAGES[-1][1](spark, df, folder)
    assert {r.doc_id for r in packed.collect()} == set(kept["decontamination"])
    whole = __spark_entry__.queries()["pipeline"](spark, folder)
    assert {(r.doc_id, r.start, r.ids_crc32) for r in whole.collect()} == {(r.doc_id, r.start, r.ids_crc32) for r in packed.collect()}
    assert toxicity.remove_toxic(df.where("doc_id < 0"), spark.read.parquet(f"{folder}/labels.parquet")).count() == 0
