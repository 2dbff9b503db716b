"""Scores of all pairs against sums in plain Python."""

from __future__ import annotations

import math

from quillspark.functions import scoring


def test_pair_scores_of_blocks(spark):
    """More vectors than a block holds, of unlike lengths, null, with nulls and with odd numbers."""
    vectors = [[(i * 7 + k * 3) % 11 - 5 + 0.25 for k in range(3 + i % 2)] for i in range(9)]
    vectors += [None, [], [None, 1.0, 2.0], [1.0, 2.0, 3.0, None], [float("nan"), 1.0, 1.0], [float("inf"), 1.0, 1.0]]
    notes = [(f"n{i}", v) for i, v in enumerate(vectors)]
    queries = [(10 * i, v) for i, v in enumerate(vectors) if i % 2 == 0 or i > 8]
    table = lambda rows, key: spark.createDataFrame(rows, f"{key}, embedding array<float>").repartition(2)
    got = {(r["query_id"], r["note_id"]): r["score"] for r in scoring.pair_scores(table(notes, "note_id string"), table(queries, "query_id long"), block=3).collect()}

    def want(a, b):
        pairs = list(zip(a or [], b or [], strict=False))
        if a is None or b is None or any(x is None or y is None for x, y in pairs):
            return 0.0
        total = 0.0
        for x, y in pairs:
            total += x * y
        return total if math.isnan(total) else max(0.0, total)

    assert len(got) == len(notes) * len(queries)
    for i, q in queries:
        for j, v in notes:
            w = want(q, v)
            assert got[i, j] == w or (math.isnan(w) and math.isnan(got[i, j])), (i, j)


def test_pairs_are_multiplied_in_blocks(spark):
    """What lies between notes and queries is one row for each pair of blocks, not an expression for each note."""
    rows = [(str(i), [float(i), 1.0]) for i in range(40)]
    notes = spark.createDataFrame(rows, "note_id string, embedding array<double>").coalesce(1)
    plan = scoring.pair_scores(notes, notes.withColumnRenamed("note_id", "query_id"), block=10)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "MapInArrow" in plan and "aggregate(" not in plan
