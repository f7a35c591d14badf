import zlib

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from lodestep.llm import packing, token_files, tokens  # noqa: E402

FILES = [("byte_bpe_50k.json", "leading"), ("word_bpe_49k.json", "dropped")]
ODD = [
    "a  b", "  x", " \n y", "a \n b", "é è", "it's  '  's 'll", "  x", "x <|endoftext|> y", "a\x1cb \x1d c", "Σας ΟΔΥΣΣΕΥΣ.", "é ́x", "1234 5,6", "  ", "\n", "a ", "a \n",
    "don't stop", "日本 語", "x\u0085 y", "  z ", "A\tB\r\nC", "", None, "The end, of. It!!", "naïve Ærø straße İstanbul", "x" * 5000, "a " * 3000,
]
SCHEMA = "doc_id long, text string, start string, length int"


def plain(path, texts):
    from tokenizers import Tokenizer

    tool = Tokenizer.from_file(path)
    tool.encode_special_tokens = True
    return [np.array(e.ids, "<u4") for e in tool.encode_batch([t or "" for t in texts], add_special_tokens=False)]


@pytest.mark.parametrize("name,spaces", FILES)
def test_units_give_the_whole_text_ids(name, spaces):
    path = public_tokenizers.path(name)
    tool = tokens.Encoder(path, spaces, most_units=10)
    for _ in range(2):
        assert tool.encode(ODD) == [x.tobytes() for x in plain(path, ODD)]


def rows():
    words = [f"word{i % 97} und {i}" for i in range(400)]
    texts = ODD + [" ".join(words[i % 50 : i % 50 + (i * 37) % 390]) for i in range(120)]
    return [(i * 3, t, "s", None) for i, t in enumerate(texts)] + [(6, "again six", None, 1), (None, "no id", None, 1)]


def test_packing_covers_every_id_once(spark):
    path, data = public_tokenizers.path(FILES[0][0]), rows()
    df = spark.createDataFrame(data, SCHEMA).repartition(3)
    got = packing.pack(df, path, "leading", end_id=1, size=256, with_ids=True).collect()
    want = sorted((-1 if i is None else i, *x.tolist(), 1) for (i, *_), x in zip(data, plain(path, [r[1] for r in data])))
    docs, sequences = {}, {}
    for r in got:
        assert len(r.ids) == r.length and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
        docs.setdefault((-1 if r.doc_id is None else r.doc_id, r.doc_tokens), []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    found = []
    for (i, total), pieces in docs.items():
        for r in sorted(pieces, key=lambda r: r.start):
            found.append((i, r.start, r.ids, total))
    assert sum(len(x[2]) for x in found) == sum(len(w) - 1 for w in want)
    whole = {}
    for i, start, ids, total in found:
        whole.setdefault((i, total), {}).setdefault(start, []).extend(ids)
    singles = [w for w in want if sum(v[0] == w[0] and len(v) == len(w) for v in want) == 1]
    for w in singles:
        at = whole[w[0], len(w) - 1]
        assert [x for s in sorted(at) for x in at[s]] == list(w[1:])
    for pieces in sequences.values():
        offset = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == offset
            offset += r.length
        assert offset == 256 or (offset < 256 and offset & (offset - 1) == 0)
    assert packing.pack(spark.createDataFrame([], SCHEMA), path, "leading", 1).count() == 0


def test_sum_of_squares_minimises_the_change():
    rng = np.random.default_rng(3)
    box = packing.SumOfSquares(32)
    for length in rng.integers(1, 32, 2000):
        level = box.level_for(int(length))

        def cost(at):
            n = box.counts.copy()
            if at:
                n[at] -= 1
            if at + length < 32:
                n[at + length] += 1
            return int((n[1:32] ** 2).sum())

        options = [0, *[h for h in range(1, 33 - length) if box.counts[h]]]
        assert cost(level) == min(map(cost, options))
        list(box.add(packing.Piece(0, 0, np.zeros(length, "<u4"), int(length))))


def test_files_round_trip_and_random_reads(spark, tmp_path):
    path, data = public_tokenizers.path(FILES[1][0]), rows()
    df = spark.createDataFrame(data, SCHEMA).repartition(3)
    got = token_files.round_trip(df, path, "dropped", end_id=1).collect()
    ids = [np.append(x, 1).astype("<u4") for x in plain(path, [r[1] for r in data])]
    want, start = [], 0
    for (i, t, *_), x in sorted(zip(data, ids), key=lambda p: (p[0][0] is not None, p[0][0] or 0, p[0][1] is not None, (p[0][1] or "").encode())):
        want.append((i, start, len(x), zlib.crc32(x.tobytes())))
        start += len(x)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    manifest = token_files.write_tokens(df, f"file://{tmp_path}/t", path, "dropped", 1).collect()
    found = {i: x for m in manifest for i, x in token_files.read_documents(m.path, {9, 60, 301})}
    assert set(found) == {9, 60, 300} - {300} | ({301} & {r[0] for r in data})
    assert found[60].tolist() == ids[20].tolist()
    import zstandard

    raw = open(manifest[0].path.removeprefix("file://"), "rb").read()
    assert sum(len(x) for x in zstandard.ZstdDecompressor().read_to_iter(raw, read_size=1 << 20)) >= 0
    damaged = bytearray(raw)
    damaged[12] ^= 255
    (tmp_path / "bad.zst").write_bytes(damaged)
    with pytest.raises(Exception):
        list(token_files.read_documents(f"file://{tmp_path}/bad.zst"))
    assert token_files.round_trip(spark.createDataFrame([], SCHEMA), path, "dropped", 1).count() == 0
