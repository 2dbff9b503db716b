"""The pipeline against a chain of brute-force stages."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from test_near_dedup import near_corpus
from test_operators import SCHEMA, brute_quality, corpus, ids_of, low, words

import corpus_pipeline
from quillspark.llm import quality_rules


def rows():
    """The odd corpus, near copies, rows that repeat a doc_id (with the same text and another), and some without one."""
    out = corpus()
    start = len(out)
    near = [(None if d is None else d + start, t, lang, s, n, 1, "x", 2) for d, t, lang, s, n in near_corpus()]
    out += near
    long = [r for r in near if r[1] and len(r[1].split()) > 80]
    out += [long[0], long[1], (long[2][0], long[3][1][::-1], "en", "b", 0, 1, "x", 2)]
    extra = random.Random(9)
    out.append((None, " ".join(f"z{extra.randrange(999)}" for _ in range(90)), None, None, 0, 1, "x", 2))
    return out


def brute_run(rows):
    limits = quality_rules.Limits()

    def good(text):
        m = brute_quality(text)
        bad = m[5] > limits.line_share * m[1] or m[2] > limits.symbols_per_word * m[0]
        bad = bad or any(c > limits.ngram_share[n] * m[1] for n, c in zip((5, 6, 7, 8, 9, 10), m[6], strict=True))
        return not (m[0] < 50 or 100 * m[4] > 50 * m[0] or bad)

    key = lambda r: -1 if r[0] is None else r[0]
    kept = [r for r in rows if good(r[1])]
    groups = {}
    for r in kept:
        groups[low(r[1])] = max(groups.get(low(r[1]), r), r, key=key)
    kept = list(groups.values())

    sets = []
    for r in kept:
        w = words(low(r[1]))
        sets.append({" ".join(w[i : i + 5]) for i in range(len(w) - 4)})
    root = list(range(len(kept)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, x in enumerate(sets):
        for j in range(i):
            if len(x & sets[j]) >= 0.8 * len(x | sets[j]) - 1e-9:
                root[find(i)] = find(j)
    heads = {}
    for i, r in enumerate(kept):
        heads[find(i)] = min(heads.get(find(i), r), r, key=key)
    assert len(heads) < len(kept)
    kept = list(heads.values())

    size = {id(r): len(words(r[1])) for r in kept}
    of = defaultdict(list)
    for r in kept:
        of[r[3]].append(r)
    names = sorted(of, key=lambda s: (s is None, s or ""))
    total = {s: sum(size[id(r)] for r in of[s]) for s in names}
    left, open_, target = sum(total.values()), {s: i % 3 + 1 for i, s in enumerate(names)}, {}
    while above := [s for s, w in open_.items() if w * left > 3 * total[s] * sum(open_.values())]:
        for s in above:
            target[s] = float(3 * total[s])
            left -= 3 * total[s]
            del open_[s]
    target |= {s: w * (left / sum(open_.values())) for s, w in open_.items()}
    queue = []
    for s in names:
        so_far = 0
        turn = lambda r: hashlib.md5((("" if r[0] is None else str(r[0])) + "|mix").encode()).hexdigest()
        for r in sorted(of[s], key=lambda r: (turn(r), key(r))):
            so_far += size[id(r)]
            queue += [((so_far + k * total[s]) / target[s], turn(r), key(r), k, r) for k in range(3)]
    played, mixed = 0, []
    for *_, r in sorted(queue, key=lambda q: q[:4]):
        played += size[id(r)]
        if played > sum(total.values()):
            break
        mixed.append(r)

    pieces = Counter()
    for r in mixed:
        ids = ids_of("word_bpe_49k.json", r[1], 1)
        for i in range(0, len(ids), 4096):
            pieces[(key(r), i // 4096, i, len(ids[i : i + 4096]), zlib.crc32(ids[i : i + 4096].tobytes()))] += 1
    return pieces


def test_pipeline_is_the_chain_of_its_stages(spark, tmp_path):
    table = rows()
    spark.createDataFrame(table, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    got["doc_id"] = got["doc_id"].fillna(-1).astype(int)
    want = brute_run(table)
    assert len(want) > 30
    assert Counter(map(tuple, got[["doc_id", "piece", "start", "length", "ids_crc32"]].to_numpy().tolist())) == want
    for _, group in got.groupby("sequence_id"):
        group = group.sort_values("offset")
        assert group["offset"].tolist() == [0, *np.cumsum(group["length"])[:-1]] and group["length"].sum() <= 4096


def test_stages_keep_the_columns_of_documents_and_take_nothing(spark):
    empty = spark.createDataFrame([], SCHEMA)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, empty, "")
        assert out.count() == 0
        assert name == "best-fit packing" or out.columns == empty.columns


@pytest.mark.parametrize("text", [None, ""])
def test_stages_take_rows_without_text_or_id(spark, text):
    rows = spark.createDataFrame([(None, text, None, None, None, None, None, None)] * 2 + [(1, text, "en", "a", 0, 1, "x", 2)], SCHEMA)
    kept = {name: stage(spark, rows, "").count() for name, stage in corpus_pipeline.STAGES}
    assert kept == {"quality rules": 0, "exact dedup": 1, "near dedup": 1, "mixing": 0, "best-fit packing": 3}
