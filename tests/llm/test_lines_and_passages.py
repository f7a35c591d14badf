import random

import pytest
from pyspark.sql import functions as F

from lodestep.llm import fuzzy_lines, repeats


def shingles(line, n=8):
    return {line[i : i + n] for i in range(len(line) - n + 1)} or {line}


def brute_lines(rows, least=12):
    lines = {}
    for i, text in rows:
        if i is None:
            continue
        for n, line in enumerate((text or "").split("\n")):
            plain = " ".join(line.lower().split())
            if len(plain) >= least:
                lines.setdefault(plain, []).append((i, n))
    keys = list(lines)
    parent = list(range(len(keys)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = [shingles(k) for k in keys]
    for a in range(len(keys)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                parent[find(a)] = find(b)
    groups = {}
    for k in range(len(keys)):
        groups.setdefault(find(k), []).extend(lines[keys[k]])
    return {frozenset(g): min(g) for g in groups.values() if len(g) > 1}


def corpus():
    rng = random.Random(11)
    letters = "abcdefghij klmnop qrstuvwxyz"
    base = ["".join(rng.choices(letters, k=160)).strip() for _ in range(25)]
    rows = []
    for i in range(120):
        out = []
        for _ in range(rng.randrange(6)):
            line = list(rng.choice(base))
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                line[rng.randrange(len(line))] = rng.choice("XYZ")
            out.append("".join(line))
        out.append("".join(rng.choices(letters, k=90)))
        rows.append((500 - i, "\n".join(out)))
    return rows + [(900, None), (901, ""), (902, "\n\n \n"), (903, "short"), (904, "short"), (None, base[0]), (906, "Ünïcode line that is long  enough\nünïcode LINE that is long enough"), (907, "z" * 40000)]


@pytest.mark.parametrize("least", [1, 12])
def test_fuzzy_lines_match_brute_force(spark, least):
    rows = corpus()
    df = spark.createDataFrame([(*r, 5, "x") for r in rows], "doc_id long, text string, n_chars long, line string").repartition(3)
    found = fuzzy_lines.line_groups(df, least_chars=least).collect()
    groups = {}
    for r in found:
        groups.setdefault(r.component, []).append(((r.doc_id, r.line), r.kept))
    got = {frozenset(p for p, _ in g): [p for p, kept in g if kept] for g in groups.values()}
    assert got == {g: [keep] for g, keep in brute_lines(rows, least).items()}
    texts = {r[0]: r[1] for r in rows}
    for r in found:
        assert "\n".join(texts[r.doc_id].split("\n")[r.line : r.line + 1]) == texts[r.doc_id][r.first_char : r.end_char]
    left = fuzzy_lines.remove_lines(df, least_chars=least)
    assert left.columns == df.columns and left.count() == len(rows)
    gone = {(r.doc_id, r.line) for r in found if not r.kept}
    for r in left.where("doc_id is not null").collect():
        want = texts[r.doc_id]
        if any((r.doc_id, n) in gone for n in range((want or "").count("\n") + 1)):
            want = "\n".join(x for n, x in enumerate(want.split("\n")) if (r.doc_id, n) not in gone)
            assert r.n_chars == len(want)
        assert r.text == want


def test_fuzzy_lines_empty_and_repeated_rows(spark):
    schema = "doc_id long, text string"
    assert fuzzy_lines.line_groups(spark.createDataFrame([], schema)).count() == 0
    twice = spark.createDataFrame([(1, "one line of some length")] * 2 + [(2, "one  line OF some length")], schema)
    assert [(r.doc_id, r.kept) for r in sorted(fuzzy_lines.line_groups(twice).collect())] == [(1, True), (2, False)]
    assert sorted(r.text for r in fuzzy_lines.remove_lines(twice).collect()) == ["", "one line of some length", "one line of some length"]


def test_documents_emptied_by_line_removal_may_go(spark):
    rows = [(1, "one line of some length\nand another"), (2, "And  another\n\n"), (3, "and another\nand more of it"), (4, " \n"), (5, None), (None, "and another")]
    docs = spark.createDataFrame([(i, t, "a", 1, "b") for i, t in rows], "doc_id long, text string, gone_doc string, Gone_Hash int, gone_lines string")
    left = fuzzy_lines.remove_lines(docs, drop_emptied=True)
    assert left.columns == docs.columns
    assert {(r.doc_id, r.text) for r in left.collect()} == {rows[0], (3, "and more of it"), rows[3], rows[4], rows[5]}
    assert {(r.doc_id, r.text) for r in fuzzy_lines.remove_lines(docs).collect()} >= {(2, "\n")}


def test_lines_whose_digests_share_a_half_stay_apart(spark, monkeypatch):
    rows = [(1, "the first line of some length"), (2, "an unlike line, of other words"), (3, "the first line of some length"), (4, "a third one that repeats nothing")]
    real = fuzzy_lines._told_apart
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    calls = []
    monkeypatch.setattr(fuzzy_lines, "_told_apart", lambda *a: calls.append(1) or real(*a))
    lines = fuzzy_lines.lines
    monkeypatch.setattr(fuzzy_lines, "lines", lambda *a: lines(*a).withColumn("node", F.lit(0).cast("long")))
    assert sorted((r.doc_id, r.kept) for r in fuzzy_lines.line_groups(docs).collect()) == [(1, True), (3, False)]
    assert calls


def brute_units(text):
    out, unit, previous = [], None, None
    at = 0
    for number, line in enumerate((text or "").split("\n")):
        pos = 0
        for w in line.split(" "):
            if w:
                s = at + pos
                new = unit is None or unit["line"] != number or (unit["words"][-1][-1] in ".!?" and not (len(unit["words"][-1]) > 1 and unit["words"][-1][-2] in ".!?"))
                if new:
                    unit = {"line": number, "words": [], "start": s}
                    out.append(unit)
                unit["words"].append(w)
                unit["end"] = s + len(w)
            pos += len(w) + 1
        at += len(line) + 1
    for u in out:
        own = tuple(w.lower() for w in u["words"])
        u["raw"] = own
        u["key"] = (own,) if len(own) >= repeats.SHORT or previous is None else (own, previous)
        previous = own
    return out


def brute_passages(rows, least):
    seen = {}
    docs = {i: brute_units(t) for i, t in rows if i is not None}
    for i in sorted(docs):
        for n, u in enumerate(docs[i]):
            seen.setdefault(u["key"], (i, n))
    count = {}
    for d in docs.values():
        for u in d:
            count[u["key"]] = count.get(u["key"], 0) + 1
    out = []
    for i, d in docs.items():
        run = []
        for n in range(len(d) + 1):
            if n < len(d) and count[d[n]["key"]] > 1 and seen[d[n]["key"]] != (i, n):
                run.append(d[n])
                continue
            if run and sum(len(u["words"]) for u in run) >= least:
                out.append((i, run[0]["start"], run[-1]["end"], sum(len(u["words"]) for u in run), len(run), min(seen[u["key"]][0] for u in run)))
            run = []
    return sorted(out)


def test_repeated_passages_match_brute_force(spark):
    rng = random.Random(2)
    sentence = lambda k: " ".join(rng.choices(["alpha", "beta", "gamma", "délta", "eps"], k=k)) + rng.choice([".", "!", "?", "!!", ","])
    shared = [" ".join(sentence(rng.randint(3, 12)) for _ in range(6)) for _ in range(5)]
    rows = []
    for i in range(80):
        parts = [sentence(rng.randint(6, 20)) for _ in range(4)]
        if rng.random() < 0.5:
            parts.insert(rng.randrange(4), rng.choice(shared).replace("alpha", rng.choice(["alpha", "ALPHA"])))
        rows.append((i * 2, rng.choice([" ", "\n", "  "]).join(parts)))
    rows += [(500, None), (501, ""), (502, rows[3][1]), (None, rows[3][1]), (503, "a." * 5), (504, "one two. " * 400)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, unit int, first_char int").repartition(3)
    for least in (10, 30):
        found = repeats.repeated_passages(df, least_words=least)
        assert sorted(map(tuple, found.collect())) == brute_passages(rows, least)
    texts = dict(rows)
    cut = {}
    for i, a, b, *_ in sorted(brute_passages(rows, 30), reverse=True):
        cut[i] = cut.get(i, texts[i])[:a] + cut.get(i, texts[i])[b:]
    left = repeats.remove_passages(df, found)
    assert left.columns == df.columns
    assert all(r.text == cut.get(r.doc_id, texts[r.doc_id]) for r in left.where("doc_id is not null").collect())
    assert repeats.repeated_passages(df.where("doc_id < 0")).count() == 0
