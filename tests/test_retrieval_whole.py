import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from lodestep.operators import metrics
from lodestep.plans import vector_queries


def brute(rows):
    vectors = {i: v for i, v in rows if i is not None and v is not None}
    cosine = lambda a, b: round(sum(x * y for x, y in zip(a, b)) / (math.hypot(*a) * math.hypot(*b)), 9)
    out = {}
    for q in vectors:
        if q % 100 == 0 and q + 1 in vectors:
            own = cosine(vectors[q], vectors[q + 1])
            out[q] = 1 + sum(cosine(vectors[q], v) > own for i, v in vectors.items() if i not in (q, q + 1))
    return out


def test_targets_are_ranked_among_every_other_row(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(701)]
    rows = [(i, rows[i - 1][1] if i == 301 else v) for i, v in rows] + [(None, rows[0][1]), (2000, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    df.write.parquet(str(tmp_path / "embeddings.parquet"))
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    want = brute(rows)
    assert len(want) == 7 and max(want.values()) > 70
    for sizes in ({}, {"block_rows": 50, "query_rows": 3}):
        assert {r.q_id: r["rank"] for r in metrics.retrieval_ranks(df, F.col("vec_id") % 100 == 0, **sizes).collect()} == want
    got = vector_queries.retrieval_whole(spark, str(tmp_path)).first()
    assert got.median_rank == statistics.median(want.values())
    assert got.mrr == pytest.approx(sum(1 / r for r in want.values()) / 7, abs=1e-6)
