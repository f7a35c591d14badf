"""Dictionaries that hold something of every text, scores by hand, and ids that are text."""


import numpy as np
import zstandard as z

from lodestep.llm import near_dup, quality


def test_every_text_is_in_the_dictionary_from_a_hashed_place():
    texts = [f"[head of {i}]".encode() + f"<{i}>".encode() * 700 for i in range(300)]
    made = quality.build_dictionary(texts, 1 << 17)
    assert len(made) == 1 << 17 and all(f"<{i}>".encode() in made or f"{i}><{i}".encode() in made for i in range(300))
    firsts = sum(f"[head of {i}]".encode() in made for i in range(300))
    assert firsts < 60  # not the beginnings alone
    few = [b"abc" * 50, b"", b"xyz" * 400]
    assert sorted(quality.build_dictionary(few, 1 << 17)) == sorted(b"".join(few))
    assert quality.build_dictionary([], 100) == b"" and len(quality.build_dictionary([b"q" * 1000] * 50, 640)) == 640


def test_scores_are_those_of_plain_compression():
    good = [f"the quiet garden number {i} grows in the rain and the sun".encode() * 3 for i in range(40)]
    bad = [f"BUY!!! now$$$ {i} click%%% here".encode() * 5 for i in range(40)]
    model = quality.train([t.decode() for t in good + bad], [1] * 40 + [0] * 40, 0.5)

    def size(data, content):
        total = 0
        for i in range(0, len(data), 2048):
            how = {"dict_data": z.ZstdCompressionDict(content, dict_type=z.DICT_TYPE_RAWCONTENT)} if content else {}
            total += len(z.ZstdCompressor(level=3, write_content_size=False, **({**how, "write_dict_id": False} if content else {})).compress(data[i : i + 2048]))
        return total

    texts = ["", "the quiet garden grows", "BUY!!! now$$$", "x" * 9000, "é " * 3000]
    for text, score in zip(texts, quality.scores(texts, model, quality.Scorer(model.good, model.bad))):
        data = text.encode()
        g, b, p, n = size(data, model.good), size(data, model.bad), size(data, b""), len(data) + 40
        x = (np.array([(b - g) / n, p / n, (p / n) ** 2, np.log(n), (b - g) / n * np.log(n), g / n]) - model.mean) / model.scale
        assert abs(score - 1 / (1 + np.exp(-np.clip(x @ model.weights[:-1] + model.weights[-1], -30, 30)))) < 1e-9


def test_the_size_difference_alone_tells_most(spark):
    rng = np.random.default_rng(1)
    words = [["stone", "river", "quiet", "garden", "winter", "letter"], ["win", "cash", "click", "offer", "free", "prize"]]
    texts = [" ".join(rng.choice(words[1 - y], 40)) for y in (i % 2 for i in range(400))]
    y = np.arange(400) % 2
    model = quality.train(texts[:300], y[:300].tolist(), 0.5)
    scorer = quality.Scorer(model.good, model.bad)
    difference = np.array([scorer.features(t.encode())[0] for t in texts[300:]])
    assert ((difference > 0) == (y[300:] == 1)).mean() > 0.95


def test_text_ids_count_as_numbers_or_as_none(spark):
    text = "one two three four five six seven eight nine ten"
    df = spark.createDataFrame([("7", text, 1), ("12", text, 2), ("x", text, 3), (None, text, 4), ("9", "other words stand here and they are not the same at all", 5)], "doc_id string, text string, k int")
    got = {(r.doc_id, r.component_id, r.kept) for r in near_dup.near_duplicates(df).collect()}
    assert got == {(7, 7, True), (12, 7, False), (9, 9, True), (None, None, True)}
    assert sorted(r.k for r in near_dup.keep_one(df).collect()) == [1, 3, 4, 5]
