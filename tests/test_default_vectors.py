"""Default vectors of texts, row by row."""

from __future__ import annotations

import re
from hashlib import md5

from quillspark.operators import embedding


def test_vectors_are_made_without_a_shuffle(spark):
    texts = [None, "", "!!", "Uno dos, dos TRES", "ñandú 42 ñandú", "a " * 20000 + "b", "x"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(2).localCheckpoint()
    out = embedding.default_vectors(docs, size=16)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    got = {r["id"]: r["embedding"] for r in out.collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        sums = [0] * 16
        for token in re.findall(r"[^\W_]+", (text or "")[:28000].lower()):
            digest = md5(token.encode()).hexdigest()
            sums[int(digest[:8], 16) % 16] += 1 if int(digest[8], 16) % 2 == 0 else -1
        norm = sum(s * s for s in sums) ** 0.5
        assert got[i] == [s / norm if norm else 0.0 for s in sums]
