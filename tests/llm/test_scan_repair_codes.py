"""License scans, conversation repair and vector codes against brute force on small tables with odd rows."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest

from quillspark.llm import conversation_repair, license_scan, registry, vector_codes

# 11 license scans -----------------------------------------------------------

TEMPLATES = [
    ("x", "red fox over the lazy dog and the hill"),
    ("y", "red fox"),
    ("x", "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi"),
    ("z", "été ñandú 42"),
    ("none", " ., "),
]


def license_rows():
    r = random.Random(3)
    pool = "red fox over the lazy dog and hill alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi été ñandú 42 a b c d".split()
    texts = [None, "", " \n", "...", "RED-FOX", "CC BY cc by cc-by", "General Public\nLicense; all rights reserved", "x cc by" + " w" * 500 + " ALL RIGHTS reserved", "cc" * 4000, "ccby cc byte", "ÉTÉ été ñandú 42"]
    texts += [" ".join(r.choice(pool) for _ in range(n)) for n in (3, 10, 30, 60, 200, 3000) for _ in range(4)]
    texts += [("pad " * n) + "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu " + "pad " * (9 - n) for n in range(9)]
    texts += [" ".join(["red", *["pad"] * n, "fox"]) for n in range(5, 18)]
    return [(i if i != 4 else None, t, "clash", i) for i, t in enumerate(texts)] + [(7, texts[7], "clash", 1)] * 2


def brute_license(text, templates=TEMPLATES, share=license_scan.CONTAINMENT):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places = [(i, label) for phrase, label in license_scan.PHRASES for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    found, best = set(), 0.0
    for label, notice in templates:
        ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", notice.lower())
        if not ws:
            continue
        size = 8 * 2 ** max(0, math.ceil(math.log2(len(ws) / 8)))
        for at in range(0, len(words), size):
            part = len(set(ws) & set(words[at : at + 2 * size])) / len(set(ws))
            if part >= share - 1e-12:
                found.add(label)
                best = max(best, part)
    base = sorted({label for _, label in places})
    at = [i for i, _ in places]
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(base), ",".join(sorted({*base, *found})), 1.0 if at else best


@pytest.mark.parametrize("per_pass", [2, 100])
def test_license_scan(spark, per_pass):
    rows = license_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string, token string, row int").repartition(3)
    got = license_scan.license_scan(docs, TEMPLATES, templates_per_pass=per_pass).collect()
    key = lambda r: tuple((x is not None, x or 0) if not isinstance(x, str) else x for x in r)
    assert sorted(map(key, got)) == sorted(key((d, *brute_license(t))) for d, t, *_ in rows)
    assert sum(r["labels"] != r["base_labels"] for r in got) > 10


def test_license_scan_of_nothing(spark):
    assert license_scan.license_scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    docs = spark.createDataFrame([(1, "all rights reserved")], "doc_id long, text string")
    assert tuple(license_scan.license_scan(docs, []).first()) == (1, 3, 1, 0, 0, "reserved", "reserved", 1.0)


def test_license_notices_have_their_own_label(spark):
    notices = license_scan.default_templates()
    r = random.Random(1)
    filler = lambda n: " ".join(r.choice(["of", "the", "in", "and", "ndtion", "ouerst", "to", "is"]) for _ in range(n))
    docs = spark.createDataFrame([(i, f"{filler(r.randrange(200))} {text.upper()} {filler(r.randrange(200))}") for i, (_, text) in enumerate(notices)] + [(99, filler(2000))], "doc_id long, text string")
    got = {row["doc_id"]: row["labels"].split(",") for row in license_scan.license_scan(docs).collect()}
    assert all(label in got[i] for i, (label, _) in enumerate(notices)) and got[99] == [""]


# 12 conversation repair -----------------------------------------------------


def brute_faults(turns):
    seen, out = set(), []
    for role, text in turns:
        bare = text.strip(" \t\n\x0b\x0c\r")
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def brute_repair(turns):
    """The cheapest (cost, audit, lines) by trying every edit of every turn with up to two inserts before it and at the end."""
    best = None
    choices = []
    for (role, text), fault in zip(turns, brute_faults(turns), strict=True):
        own = [("D", 3, None)]
        if fault not in ("blank", "duplicate"):
            left = 1 if fault == "truncated" else 0
            own += [("K", left, (role, text)), ("R", 2 + left, ("user", text)), ("R", 2 + left, ("assistant", text))]
        choices.append(own)
    new = [[], ["user"], ["assistant"], ["user", "assistant"], ["assistant", "user"]]
    for inserts in itertools.product(new, repeat=len(turns) + 1):
        cost = 2 * sum(map(len, inserts))
        if best is not None and cost > best[0]:
            continue
        for edits in itertools.product(*choices):
            lines, audit, total = [], "", cost
            for some, edit in itertools.zip_longest(inserts, edits):
                lines += [(r, "") for r in some]
                audit += "I" * len(some)
                if edit:
                    audit += edit[0]
                    total += edit[1]
                    if edit[2]:
                        lines.append(edit[2])
            if re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _ in lines)):
                found = (total, audit, "\n".join(f"{r}:{t}" for r, t in lines))
                if best is None or found < best:
                    best = found
    return best


def conversations():
    """(conv_id, turn, role, text): random ones of up to four turns, a long one, odd ids, turns and texts."""
    r = random.Random(8)
    rows = []
    for conv in range(60):
        for _ in range(r.randrange(5)):
            rows.append((conv, r.choice([None, 0, 1, 2, 3, 9]), r.choice(["user", "assistant", "system", "user", "assistant", "tool"]), r.choice(["Yes.", "No!", "so", " ", "Well?\n", "a. b"])))
    rows += [(-5, None, None, None), (-5, 1, "user", "hm."), (None, 4, "user", "Who?"), (None, None, "assistant", "I."), (None, 7, "assistant", "It is é 😀.")]
    return rows


def expected(rows):
    groups = defaultdict(list)
    for conv, turn, role, text in rows:
        groups[conv].append((turn is not None, turn or 0, " " if role is None else role, " " if text is None else text))
    out = {}
    for conv, all_ in groups.items():
        all_.sort()
        turns = [(role, text) for _, _, role, text in all_]
        numbers = [t for known, t, *_ in all_ if known]
        faults = brute_faults(turns)
        initials = [role[:1] for role, _ in turns]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
        cost, audit, text = brute_repair(turns)
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        out[conv] = (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return out


@pytest.mark.parametrize("segment", [1, 2, 1024])
def test_repair_is_the_cheapest(spark, segment):
    rows = conversations()
    df = spark.createDataFrame([(*r, False) for r in rows] + [(77, 1, "user", "x", True)], "conv_id long, turn long, role string, text string, dropped boolean").repartition(3).na.fill(" ", ["role", "text"])
    got = {r["conv_id"]: tuple(r)[1:] for r in conversation_repair.repair(df, segment).collect()}
    want = expected(rows)
    want[77] = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert got == want


def test_long_conversations_by_any_segment(spark):
    r = random.Random(2)
    rows = [(conv, turn, r.choice(["user", "assistant", "system"]), f"{r.randrange(300)}{r.choice(['.', ''])}", False) for conv, n in ((1, 700), (2, 65), (3, 1)) for turn in range(n)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, dropped boolean").repartition(3)
    want = sorted(map(tuple, conversation_repair.repair(df).collect()))
    for segment in (3, 64):
        assert sorted(map(tuple, conversation_repair.repair(df, segment).collect())) == want


def test_damage(spark):
    rows = [(c, t, "assistant", f"a.b!c? {c}") for c in range(30) for t in range(8)] + [(None, None, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    want = []
    for c, t, role, text in rows:
        draw = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = role or " ", " " if text is None else text
        row = (c, t, "user" if draw == 4 else role, "" if draw == 1 else re.sub("[.!?]", "", text) if draw == 2 else text, draw == 0)
        want += [row] * (2 if draw == 3 else 1)
    got = [tuple(r) for r in conversation_repair.damaged(df).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert conversation_repair.conversation_repair(empty).count() == 0


# 13 vector codes ------------------------------------------------------------


def brute_codes(rows, parts=8, entries=16, rounds=6):
    kept = [(v, label, [math.floor(4096 * x) for x in e]) for v, e, label in rows if e is not None and all(x is not None and math.isfinite(x) for x in e)]
    kept.sort(key=lambda k: (k[0] is None, k[0] or 0, k[2]))
    width = len(kept[0][2]) // parts
    of = lambda ints, p: ints[p * width : (p + 1) * width]
    books = [[of(k[2], p) for k in kept[:entries]] for p in range(parts)]
    near = lambda part, book: min((sum((a - b) ** 2 for a, b in zip(part, entry, strict=True)), e) for e, entry in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            groups = defaultdict(list)
            for k in kept:
                groups[near(of(k[2], p), books[p])[1]].append(of(k[2], p))
            for e, some in groups.items():
                books[p][e] = [sum(x) // len(some) for x in zip(*some, strict=True)]
    coded = [(v, label, [near(of(ints, p), books[p]) for p in range(parts)]) for v, label, ints in kept]
    by_label = defaultdict(int)
    for _, label, found in coded:
        by_label[label] += sum(d for d, _ in found)
    sha = hashlib.sha256(",".join(str(x) for book in books for entry in book for x in entry).encode()).hexdigest()
    return [(v, "".join(f"{e:02x}" for _, e in found), sum(d for d, _ in found), by_label[label], sha) for v, label, found in coded]


VECTORS = "vec_id long, embedding array<float>, label int, code string, error long"


def vector_rows(n):
    r = np.random.default_rng(n)
    spread = lambda x: [float(np.float32(v)) for v in x]
    rows = [(i, spread(r.normal(size=16) * (0.01 if i % 3 else 1)), int(r.integers(3)) if i % 5 else None) for i in range(n)]
    rows += [(3, spread(r.normal(size=16)), 1), (3, rows[3][1], 1), (None, spread(r.normal(size=16)), None), (1000, [0.0] * 16, 2), (1001, [0.0] * 16, 2), (1002, [-1.0] * 16, None)]
    odd = [(-1, None, 1), (-2, [1.0] * 15 + [None], 1), (-3, [1.0] * 15 + [float("nan")], 1), (-4, [float("-inf")] * 16, 1)]
    return [(*row, "clash", 1) for row in [*rows, *odd]]


@pytest.mark.parametrize("n", [0, 9, 150])
def test_vector_codes(spark, n):
    rows = vector_rows(n) if n else vector_rows(4)[:3]
    got = vector_codes.vector_codes(spark.createDataFrame(rows, VECTORS).repartition(3)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, brute_codes([r[:3] for r in rows])))


def test_vector_codes_of_nothing(spark):
    assert vector_codes.vector_codes(spark.createDataFrame([], VECTORS)).count() == 0
    only = spark.createDataFrame([(1, None, 1, "", 1), (2, [], 1, "", 1), (3, [1.0, 2.0], 1, "", 1)], VECTORS)
    assert vector_codes.vector_codes(only).count() == 0


def test_partial_distance_search_is_the_nearest():
    r = np.random.default_rng(1)
    for scale in (1, 3, 4000):  # small ones tie often
        part, book = r.integers(-scale, scale + 1, (500, 6)), r.integers(-scale, scale + 1, (16, 6))
        all_ = ((part[:, None] - book[None]) ** 2).sum(axis=2)
        index, best = vector_codes.nearest(part, book)
        assert (index == all_.argmin(axis=1)).all() and (best == all_.min(axis=1)).all()


def test_decoded_vectors_are_the_entries(spark):
    ints = vector_codes.usable(spark.createDataFrame(vector_rows(60), VECTORS))
    books = vector_codes.fit(ints)
    for row in vector_codes.decoded(vector_codes.encode(ints, books), books).limit(5).collect():
        want = np.concatenate([books[p][int(row["code"][2 * p : 2 * p + 2], 16)] for p in range(8)]) / 4096
        assert row["approximate"] == want.tolist()


# SQL ------------------------------------------------------------------------


@pytest.mark.parametrize("name", ["op11_license_scan", "op12_conversation_repair", "op13_vector_codes"])
def test_queries_equal_their_sql(spark, name):
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "conversations", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    want = con.sql(registry.SQL[name])
    got = registry.QUERIES[name](spark, folder).select(*want.columns).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want.fetchall()))
