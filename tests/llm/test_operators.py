"""The ten operators against brute force on small tables with odd rows."""

from __future__ import annotations

import hashlib
import io
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models

from quillspark.llm import (
    countmin_dedup,
    exact_dedup,
    language_id,
    mixing,
    near_dedup,
    packing,
    quality_rules,
    simhash,
    suffix_dedup,
    token_files,
    tokens,
    url_filter,
)
from quillspark.llm.components import connected_components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rank int, _turn string, length int"
SPACES = " \t\n\x0b\x0c\r"


def words(text):
    out, now = [], ""
    for c in text or "":
        if c in SPACES:
            out.append(now)
            now = ""
        else:
            now += c
    return [w for w in [*out, now] if w]


def prose(r, n):
    vocabulary = ["the", "of", "and", "tion", "erin", "onth", "Hand", "ést", "word,", "stop."]
    return " ".join(r.choice(vocabulary) + r.choice(["", "a", "b", "ing"]) for _ in range(n))


def corpus():
    """Copies, near copies, shared passages, nulls, empty and very long texts, odd spaces; clashing column names."""
    r = random.Random(5)
    passage, long = prose(r, 90), prose(r, 9000)
    rows = []
    add = lambda text, lang="en", source="a": rows.append((len(rows), text, lang, source, len(text or ""), 1, "x", 2))
    for i in range(25):
        add(prose(r, 30 + 5 * i), source=r.choice(["a", "b", "ç", None]))
    for i in range(6):
        add(prose(r, 20) + " " + passage + " " + prose(r, 15 + i))
    copy = prose(r, 80)
    for i in range(7):
        add(copy.upper() if i % 2 else copy)
    for i in range(5):
        changed = copy.split()
        changed[7 * i] = "other"
        add(" ".join(changed))
    for text in (None, "", None, "", " \n\t ", "one", "two words", "\u00a0", "line\nline\nline\n" + prose(r, 60), "ha " * 300, "x" * 3000, "aé\u2028b ÀB 😀 " * 40, "### " * 60 + prose(r, 50)):
        add(text, lang=None, source=None)
    add(long)
    add(long[:20000] + " tail")
    rows.append((None, "no id", None, None, 0, 1, "x", 2))
    return rows


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    spark.createDataFrame(corpus(), SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def texts():
    return [(row[0], row[1]) for row in corpus()]


# 1 packing ------------------------------------------------------------------


def ids_of(file, text, end):
    return np.array([*Tokenizer.from_file(tokens.vocabulary(file)).encode(text or "", add_special_tokens=False).ids, end], "<u4")


def test_packing(docs):
    got = packing.best_fit_packing(docs, sequence_tokens=64).toPandas()
    want = Counter()
    for doc, text in texts():
        ids = ids_of("word_bpe_49k.json", text, 1)
        for i in range(0, len(ids), 64):
            want[(-1 if doc is None else doc, i // 64, i, len(ids[i : i + 64]), zlib.crc32(ids[i : i + 64].tobytes()))] += 1
    got["doc_id"] = got["doc_id"].fillna(-1).astype(int)
    assert Counter(map(tuple, got[["doc_id", "piece", "start", "length", "ids_crc32"]].to_numpy().tolist())) == want
    for _, group in got.groupby("sequence_id"):
        group = group.sort_values("offset")
        assert group["offset"].tolist() == [0, *np.cumsum(group["length"])[:-1]]
        assert group["length"].sum() <= 64
    assert got["sequence_id"].nunique() <= 1.1 * got["length"].sum() / 64 + 2


def test_best_fit_takes_the_tightest_bin_and_closes_the_fullest():
    bins = packing.BestFit(10, open_bins=2)
    assert bins.place(6) == (0, 0)  # 4 free
    assert bins.place(7) == (1, 0)  # 3 free
    assert bins.place(3) == (1, 7)  # the tighter one, now full
    assert bins.place(8) == (2, 0)  # 2 free
    assert bins.place(9) == (3, 0)  # 1 free: a third open bin, so the fullest closes, itself
    assert bins.place(1) == (2, 8)


def test_packing_of_repeats_and_nothing(docs, empty):
    assert packing.best_fit_packing(empty).count() == 0
    some = docs.filter("doc_id < 5")
    assert packing.best_fit_packing(some.union(some)).count() == 2 * packing.best_fit_packing(some).count()


@pytest.mark.parametrize(("file", "spaces"), [("word_bpe_49k.json", "drop"), ("byte_bpe_50k.json", "keep")])
def test_piece_encoder_is_the_tokenizer(file, spaces):
    odd = ["a  b", "  x", " lead", "t\t x\n y", "it's, o'k 's ''s", "a) , b.", "<|endoftext|> a", "<|STARTOFTEXT|>", "a <|ENDOFTEXT|> b", "É <|EndOfText|>", "b<|startoftext|>", "é́ x", "ΑΣ ΣΑΣ", "a\u00a0 b", "", " ", "\n", "a\x1c b", "ha " * 50, "😀 a😀 b", "İ İx", "é, x. b'. ,. 中, Ⅷ, aʰ,"]
    odd += [t or "" for _, t in texts()]
    plain = Tokenizer.from_file(tokens.vocabulary(file))
    odd += ["\nlead", "x\n", "a\n\nb", "a \nb", "a\n b", "a\nb,\nC.\nd", "a\u00a0b\nc d", "\u00a0a b", "é\nÉté, ß.", "\n", "\n\n", "a\n", ",", "a\n,b"]
    want = [e.ids for e in plain.encode_batch(odd, add_special_tokens=False)]
    for width in (2, 4):
        enc = tokens.PieceEncoder(tokens.vocabulary(file), spaces, width)
        assert [ids.tolist() for ids in enc.encode(odd)] == want
        assert [ids.tolist() for ids in enc.encode(odd[::-1])] == want[::-1]  # from the cache


def test_piece_encoder_refuses_other_kinds_and_widths(tmp_path):
    path = str(tmp_path / "words.json")
    tiny = Tokenizer(models.WordLevel({"ab, cd. ef": 0, "[UNK]": 1}, unk_token="[UNK]"))
    tiny.save(path)
    with pytest.raises(ValueError, match="cut words"):
        tokens.PieceEncoder(path, "drop")
    wide = str(tmp_path / "wide.json")
    Tokenizer(models.WordLevel({f"w{i}": i for i in range(70_000)}, unk_token="w0")).save(wide)
    with pytest.raises(ValueError, match="do not fit"):
        tokens.PieceEncoder(wide, "drop", 2)
    assert token_files.id_width(wide) == 4 and token_files.id_width(path) == 2 and token_files.id_width(path, 1 << 16) == 4


# 2 quality ------------------------------------------------------------------


def brute_quality(text):
    w, lines, seen, dup, dup_chars = words(text), (text or "").split("\n"), set(), 0, 0
    for line in lines:
        if words(line):
            if line in seen:
                dup += 1
                dup_chars += sum(map(len, words(line)))
            seen.add(line)
    chars = {}
    for n in (3, 5, 6, 7, 8, 9, 10):
        grams = Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
        inside = {j for i in range(len(w) - n + 1) if grams[tuple(w[i : i + n])] > 1 for j in range(i, i + n)}
        chars[n] = len(inside) if n == 3 else sum(len(w[j]) for j in inside)
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), dup, chars.pop(3), dup_chars, list(chars.values()))


def test_quality(docs, empty):
    got = quality_rules.quality_rules(docs).collect()
    limits = quality_rules.Limits()
    want = {}
    for doc, text in texts():
        m = brute_quality(text)
        failed = m[0] < 50 or 100 * m[4] > 50 * m[0]
        bad = m[5] > limits.line_share * m[1] or m[2] > limits.symbols_per_word * m[0] or any(c > limits.ngram_share[n] * m[1] for n, c in zip((5, 6, 7, 8, 9, 10), m[6], strict=True))
        want[doc] = (*m, failed, not failed and not bad)
    have = {r["doc_id"]: (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["dup_line_chars"], list(r["dup_ngram_chars"]), r["base_failed"], r["kept"]) for r in got}
    assert have == want
    assert {r["doc_id"] for r in quality_rules.keep_quality(docs).collect()} == {d for d, m in want.items() if m[-1]}
    assert quality_rules.keep_quality(docs).columns == docs.columns
    assert quality_rules.quality_rules(empty).count() == 0


# 3 mixing -------------------------------------------------------------------


def test_mixing(docs, empty):
    got = mixing.mix(docs).toPandas()
    again = mixing.mix(docs.repartition(5)).toPandas()
    key = lambda df: sorted(map(str, df.drop(columns="text_hash").itertuples(index=False)))
    assert key(got) == key(again)
    sizes = {d: len(words(t)) for d, t in texts()}
    by_source = defaultdict(int)
    for row in corpus():
        by_source[row[3]] += sizes[row[0]]
    order = sorted(by_source, key=lambda s: (s is None, s or ""))
    left, target = sum(by_source.values()), {}
    open_ = {s: i % 3 + 1 for i, s in enumerate(order)}
    while True:
        rate = left / sum(open_.values())
        above = [s for s, w in open_.items() if w * rate > 3 * by_source[s]]
        if not above:
            break
        for s in above:
            target[s] = float(3 * by_source[s])
            left -= 3 * by_source[s]
            del open_[s]
    target |= {s: w * rate for s, w in open_.items()}
    source = {row[0]: row[3] for row in corpus()}
    taken = defaultdict(int)
    for row in got.itertuples():
        doc = None if np.isnan(row.doc_id) else int(row.doc_id)
        assert row.size == sizes[doc] and row.source_size == by_source[source[doc]]
        assert row.target == pytest.approx(target[source[doc]])
        assert 0 <= row.taken <= 3 * row.size and (row.size == 0 or row.taken % row.size == 0)
        taken[source[doc]] += row.taken
    assert sum(taken.values()) <= sum(by_source.values())
    for s in order:
        assert taken[s] == pytest.approx(target[s], abs=max(sizes.values()))
    assert mixing.mix(empty).count() == 0 and mixing.play(empty).count() == 0


def test_mixing_plays_rows_as_often_as_taken(docs):
    some = docs.filter("doc_id is not null")
    doubled = some.unionByName(some.filter("doc_id < 3"))
    want = Counter({r["doc_id"]: r["n"] for r in mixing.mix(doubled).filter("taken > 0").groupBy("doc_id").agg(F.sum(F.col("taken") / F.col("size")).cast("int").alias("n")).collect()})
    played = mixing.play(doubled)
    assert played.columns == docs.columns
    assert Counter(r["doc_id"] for r in played.select("doc_id").collect()) == want


def test_playing_keeps_clashing_columns_and_deals_turns_alike(spark):
    text = prose(random.Random(4), 40)
    rows = [(1, text, "a", 10 * i, i, "x") for i in range(5)] + [(2, text + " b", "b", 7, 7, "y"), (None, text, "a", 8, 8, "z"), (None, text, "a", 8, 8, "z"), (3, None, "c", 9, 9, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, _id int, _times int, _row string")
    first = Counter(map(tuple, mixing.play(df.repartition(3)).collect()))
    assert set(first) <= {tuple(r) for r in rows}
    assert first == Counter(map(tuple, mixing.play(df.repartition(2)).collect()))
    taken = {r["doc_id"]: r["n"] for r in mixing.mix(df).filter("size > 0").groupBy("doc_id").agg((F.sum("taken") / F.first("size")).cast("int").alias("n")).collect()}
    played = Counter()
    for row, n in first.items():
        played[row[0]] += n
    assert played == Counter({d: n for d, n in taken.items() if n})
    of_one = [first[r] for r in rows[:5]]
    assert max(of_one) - min(of_one) <= 1


# 4 exact dedup --------------------------------------------------------------


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


@pytest.mark.parametrize("collide", [False, True])
@pytest.mark.parametrize("block", [7, 4096])
def test_exact_dedup(docs, block, collide):
    if block == 7:
        docs = docs.filter("length(text) < 1500 or text is null")
    key = (lambda b: F.crc32(b) % 5) if collide else None  # different blocks share keys
    got = exact_dedup.exact_dedup(docs, block, key).collect()
    rows = [(d, low(t)) for d, t in texts() if block == 4096 or t is None or len(t) < 1500]
    groups = defaultdict(list)
    for d, t in rows:
        groups[t].append(d)
    have = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in got}
    top = lambda ds: max(ds, key=lambda d: -1 if d is None else d)
    assert have == {d: (top(groups[t]), len(groups[t]), d == top(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for d, t in rows}
    assert len(got) == len(rows)


def test_exact_dedup_edges(docs, empty):
    assert exact_dedup.exact_dedup(empty).count() == 0
    some = docs.filter("doc_id < 4")
    twice = exact_dedup.exact_dedup(some.union(some)).collect()  # each row counts, one of the repeats stays
    assert len(twice) == 8 and {r["group_size"] for r in twice} == {2} and sum(r["kept"] for r in twice) == 4
    assert exact_dedup.keep_exact(empty).count() == 0


def test_many_copies_of_a_row_are_spread(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "COPIES_PER_ROW", 4)
    rows = [(None, "")] * 11 + [(1, "a")] * 4 + [(2, "A")] * 5 + [(3, None)]
    got = exact_dedup.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"]) for r in got) == {(None, 3, 12): 11, (3, 3, 12): 1, (1, 2, 9): 4, (2, 2, 9): 5}
    assert sorted(r["doc_id"] for r in got if r["kept"]) == [2, 3]


KEEPERS = {"exact": exact_dedup.keep_exact, "simhash": simhash.keep_one_of_each, "near": near_dedup.keep_one_of_each}


@pytest.mark.parametrize("name", KEEPERS)
def test_one_row_of_each_group_stays(spark, name):
    """Rows that repeat a doc_id, with the same text or another."""
    a, b, c = (prose(random.Random(i), 80).replace("é", "e") for i in (1, 2, 3))
    rows = [(1, a), (1, a), (5, b), (5, c), (9, b.upper()), (7, ""), (7, None), (None, c)]
    df = spark.createDataFrame([(*r, "copies", i) for i, r in enumerate(rows)], "doc_id long, text string, _key string, copies int").repartition(3)
    kept = KEEPERS[name](df)
    assert kept.columns == df.columns
    low_first = name != "exact"
    want = {(1, a), (5, b) if low_first else (9, b.upper()), (None, c) if low_first else (5, c)}
    got = sorted((r["doc_id"] or 0, (r["text"] or "").lower()) for r in kept.collect())
    assert got == sorted([*((d or 0, t.lower()) for d, t in want), (7, "")])


@pytest.mark.parametrize("name", [*KEEPERS, "play"])
def test_columns_of_any_name_and_type_come_through(spark, name):
    """Dots, clashes and maps; rows that repeat doc_id and text."""
    texts = [prose(random.Random(i), 70) for i in range(3)]
    rows = [(i % 3, texts[i % 3], "s", {"k": str(i), "a": "b"}, 1.5, i, [b"x"]) for i in range(6)] + [(9, None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, `a map` map<string,string>, `b.c` double, _id int, _key array<binary>").repartition(3)
    out = (mixing.play if name == "play" else KEEPERS[name])(df)
    assert out.columns == df.columns and out.dtypes == df.dtypes
    got = [str(r) for r in out.collect()]
    assert set(got) <= {str(r) for r in df.collect()}
    if name != "play":
        assert len(got) == 4 and str(df.filter("_id = 5").first()) in got  # of repeats, the largest as JSON


def test_keep_exact_against_brute_force(docs):
    groups = defaultdict(list)
    for d, t in texts():
        groups[low(t)].append(-1 if d is None else d)
    got = sorted(-1 if r["doc_id"] is None else r["doc_id"] for r in exact_dedup.keep_exact(docs).collect())
    assert got == sorted(map(max, groups.values()))


# 5 token files --------------------------------------------------------------


def test_token_files(docs, empty, tmp_path):
    got = sorted(token_files.token_files(docs, str(tmp_path / "t")).collect(), key=lambda r: r["start"])
    start = 0
    for (doc, text), row in zip(sorted(texts(), key=lambda x: (x[0] is not None, x[0])), got, strict=True):
        ids = ids_of("byte_bpe_50k.json", text, 0)
        assert tuple(row) == (doc, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert token_files.token_files(empty).count() == 0


def test_token_file_reads_only_what_is_asked_and_checks_it(tmp_path):
    import pyarrow.fs
    import zstandard

    path = str(tmp_path / "x.tok.zst")
    parts = {7: np.arange(5), 9: np.array([0]), 12: np.arange(1000) % 7}
    with open(path, "wb") as out:
        writer = token_files.FileWriter(out, 2)
        for doc, ids in parts.items():
            writer.add(doc, ids)
        writer.close()
    with pyarrow.fs.LocalFileSystem().open_input_file(path) as source:
        found = token_files.FileReader(source).find([12, 5])
    assert list(found) == [12] and found[12].tolist() == parts[12].tolist()
    with open(path, "rb") as file:  # any zstandard reader takes it
        raw = zstandard.ZstdDecompressor().stream_reader(file, read_across_frames=True).read()
    assert np.frombuffer(raw, "<u2").tolist() == [x for ids in parts.values() for x in ids]
    data = bytearray(open(path, "rb").read())
    frame = zstandard.ZstdCompressor(level=3).compress(np.arange(5, dtype="<u2").tobytes())
    data[len(frame) // 2 + 4] ^= 1
    open(path, "wb").write(data)
    with pyarrow.fs.LocalFileSystem().open_input_file(path) as source, pytest.raises((ValueError, zstandard.ZstdError)):
        token_files.FileReader(source).ids(0)


def test_token_ids_that_do_not_fit_are_refused():
    writer = token_files.FileWriter(io.BytesIO(), 2)
    with pytest.raises(ValueError, match="65536"):
        writer.add(1, np.array([1, 65536], "<u4"))
    token_files.FileWriter(io.BytesIO(), 4).add(1, np.array([1, 65536], "<u4"))


# 6 and 8 substring dedup ----------------------------------------------------


def brute_removed(units, window):
    key = lambda u, i: u[i : i + window] if isinstance(u, bytes) else tuple(u[i : i + window])
    counts = Counter(key(u, i) for u in units for i in range(len(u) - window + 1))
    out = []
    for u in units:
        gone = np.zeros(len(u), bool)
        for i in range(len(u) - window + 1):
            if counts[key(u, i)] > 1:
                gone[i : i + window] = True
        out.append(gone)
    return out


@pytest.mark.parametrize("bits", [None, 6])
def test_countmin(docs, bits):
    if bits:  # far too small a sketch loses nothing
        bits = countmin_dedup.BLOCK_BITS
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], bytes(r["kept"])) for r in countmin_dedup.remove_repeated_words(docs, bits=bits).collect()}
    rows = [(d, [w.encode() for w in words(t)]) for d, t in texts()]
    want = {}
    for (d, w), gone in zip(rows, brute_removed([w for _, w in rows], 35), strict=True):
        want[d] = (len(w), int(gone.sum()), b" ".join(x for x, g in zip(w, gone, strict=True) if not g))
    assert got == want
    assert sum(v[1] for v in want.values()) > 500


@pytest.mark.parametrize("window", [60, 400])
def test_suffixes(docs, window):
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in suffix_dedup.remove_substrings(docs, window).collect()}
    rows = [(d, (t or "").encode()) for d, t in texts()]
    want = {}
    for (d, b), gone in zip(rows, brute_removed([b for _, b in rows], window), strict=True):
        runs = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        want[d] = (len(b), int(gone.sum()), runs, bytes(np.frombuffer(b, np.uint8)[~gone]))
    assert got == want


def test_substrings_edges(docs, empty):
    assert countmin_dedup.remove_repeated_words(empty).count() == 0
    assert suffix_dedup.remove_substrings(empty).count() == 0
    one = docs.filter("doc_id = 20")
    assert {r["n_removed"] for r in suffix_dedup.remove_substrings(one).collect()} == {0}
    twice = suffix_dedup.remove_substrings(one.union(one)).collect()  # repeated rows are copies of each other
    assert len(twice) == 2 and all(r["n_removed"] == r["n_bytes"] for r in twice)


def test_multikey_quicksort():
    from quillspark.llm.repeats import multikey_quicksort

    r = np.random.default_rng(1)
    columns = [r.integers(-3, 3, 500), r.integers(-2, 2, 500), r.integers(0, 50, 500)]
    order = multikey_quicksort(columns)
    assert [tuple(c[i] for c in columns) for i in order] == sorted(zip(*columns, strict=True))


# 7 simhash ------------------------------------------------------------------


def brute_fingerprint(text):
    w = words(low(text))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(pairs, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_simhash(docs, empty):
    some = docs.filter("doc_id is not null")
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(some).collect()}
    prints = {d: brute_fingerprint(t) for d, t in texts() if d is not None}
    ids = sorted(prints)
    groups = components([(a, b) for a in ids for b in ids if a < b and (prints[a] ^ prints[b]).bit_count() <= 2], ids)
    assert got == {d: (f"{prints[d]:016x}", groups[d]) for d in ids}
    assert simhash.near_duplicates(empty).count() == 0
    null = [r for r in simhash.near_duplicates(docs).collect() if r["doc_id"] is None]
    assert len(null) == 1 and null[0]["component_id"] is None
    kept = sorted(r["doc_id"] for r in simhash.keep_one_of_each(some).collect())
    assert kept == sorted(set(groups.values()))


@pytest.mark.parametrize("heavy", [3, 10**6])
def test_simhash_links(spark, heavy):
    r = random.Random(3)
    seeds = [r.getrandbits(64) for _ in range(6)]
    prints = set(seeds)
    for _ in range(600):
        prints.add(r.choice(seeds) ^ sum(1 << r.randrange(64) for _ in range(r.randint(1, 3))))
    for _ in range(200):  # all alike in half the bytes
        prints.add((seeds[0] >> 32 << 32) | r.getrandbits(32))
    prints = {p & (2**64 - 1) for p in prints}
    signed = lambda p: p - 2**64 if p >= 2**63 else p
    df = spark.createDataFrame([(signed(p),) for p in prints], "fp long")
    got = Counter((min(a, b), max(a, b)) for a, b in simhash.links(df, heavy).collect())
    every = sorted(map(signed, prints))
    want = {(a, b) for i, a in enumerate(every) for b in every[i + 1 :] if ((a ^ b) & (2**64 - 1)).bit_count() <= 2}
    assert set(got) == want and set(got.values()) == {1}


def test_simhash_tally_rejects_pairs(spark):
    """Pairs that a list brings together but that share too few positional bytes, before any distance is taken."""
    a = 0x0123456789ABCDEF
    others = {a ^ 1: 7, a ^ (1 | 1 << 63): 6, a ^ 0x30000: 7, a ^ 0x010100000001: 5, a ^ 0x0101010101010100: 1}
    signed = lambda p: p - 2**64 if p >= 2**63 else p
    pairs = spark.createDataFrame([(a, signed(b)) for b in others], "a long, b long")
    kept = {r["b"]: r["shared"] for r in simhash.tallied(pairs).collect()}
    assert kept == {signed(b): n for b, n in others.items() if n >= 6}
    assert simhash.verified(simhash.tallied(pairs)).count() == 3


def test_simhash_wider(spark):
    r = random.Random(8)
    seeds = [r.getrandbits(63) for _ in range(3)]
    prints = sorted({s ^ sum(1 << r.randrange(63) for _ in range(r.randint(0, 3))) for s in seeds for _ in range(60)})
    got = Counter((x["a"], x["b"]) for x in simhash.links(spark.createDataFrame([(p,) for p in prints], "fp long"), 64, 3).collect())
    assert set(got.values()) == {1}
    assert set(got) == {(a, b) for i, a in enumerate(prints) for b in prints[i + 1 :] if (a ^ b).bit_count() <= 3}
    with pytest.raises(ValueError, match="max_bits"):
        simhash.links(spark.createDataFrame([(p,) for p in prints], "fp long"), 64, 4)


def test_components(spark):
    r = random.Random(1)
    pairs = [(r.randrange(300), r.randrange(300)) for _ in range(170)] + [(i, i + 1) for i in range(400, 460)]
    got = {a["node"]: a["root"] for a in connected_components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    want = components(pairs, {x for p in pairs for x in p})
    assert {n: got.get(n, n) for n in want} == want


# 9 url filter ---------------------------------------------------------------


def test_url_filter(spark):
    urls = [
        None, "", "no scheme", "http://", "http://a.net", "http://a.net/", "HTTP://A.NET/x?y", "x://example.net/en/1", "x://www.example.net/en/",
        "x://www.example.net/en", "x://notexample.net/en/", "http://example.com/de/a#b", "http://b.example.com/DE/", "http://q.org/fr/x", "http://org/fr/",
        "http://spam-farm.example.org/fr/1", "http://spam-farm.example.org/de/1", "http://www.casino-win.example.com", "http://e.com:80/de/",
        "a://b://c/d", "http://x.net?q", "http://x.net#/", "http://" + "a." * 3000 + "net/z", "http://n\new.net/\n",
    ]
    rows = [(i, u, "h", "clash") for i, u in enumerate(urls)] + [(5, urls[5], "h", "clash")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    got = url_filter.url_filter(pages).collect()
    listed = url_filter.BLOCKED_HOSTS_FILE.read_text().split()
    rules = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}
    for r in got:
        url = urls[r["page_id"]] or ""
        rest = url.split("://", 1)[1] if "://" in url else ""
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, path = low(rest[:cut]), rest[cut:].split("?")[0].split("#")[0]
        fits = [k for k in rules if (host == k.split("/", 1)[0] or host.endswith("." + k.split("/", 1)[0])) and path.startswith("/" + k.split("/", 1)[1])]
        rule = max(fits, key=len, default=None)
        bad = any(host == h or host.endswith("." + h) for h in listed)
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == (rules[rule] if rule else "block" if bad else "allow")
    assert len(got) == len(rows)
    assert url_filter.url_filter(spark.createDataFrame([], "page_id long, url string")).count() == 0
    # a list from a table, and one too long for a level: the same verdicts by a join
    table = spark.createDataFrame([(h.upper(), 1) for h in listed] + [(None, 1), ("", 1)], "host string, key int")
    for bits in (url_filter.MAX_LEVEL_BITS, 64):
        assert sorted(map(str, url_filter.url_filter(pages, blocked_hosts=table, max_level_bits=bits).collect())) == sorted(map(str, got))
    none = url_filter.url_filter(pages, blocked_hosts=table.filter("host = ''")).filter("rule is null")
    assert {r["verdict"] for r in none.collect()} == {"allow"}


def test_cascade_is_exact(spark):
    universe = spark.range(4000).select(F.concat(F.lit("k"), "id").alias("key"))
    listed = universe.filter(F.crc32(F.col("key").cast("binary")) % 7 == 0)
    cascade = url_filter.build_cascade(listed, universe, 1, first_rate=0.3)
    assert len(cascade.levels) > 2
    found = universe.filter(cascade.contains(F.col("key")))
    assert found.exceptAll(listed).count() == 0 and listed.exceptAll(found).count() == 0
    with pytest.raises(url_filter.TooManyKeys, match="bits"):
        url_filter.build_cascade(listed, universe, 1, max_level_bits=1024)


# 10 language ----------------------------------------------------------------


def test_language_id(spark, docs, empty):
    r = random.Random(2)
    parts = {"aa": ["tion", "er", "the", "ing"], "bb": ["ich", "sch", "und", "ä"], "cc": ["oix", "eau", "é", "les"]}
    rows = [(i, " ".join("".join(r.choices(parts[lang], k=3)) for _ in range(60)), lang) for i in range(400) for lang in [r.choice(sorted(parts))]]
    rows += [(1000, None, "aa"), (1001, "123 !!!", "aa"), (1002, "", None), (None, rows[0][1], "bb")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in language_id.identify(df, docs_per_language=60, steps=150).collect()}
    for doc, _, lang in rows[:400]:
        assert got[doc]["held_out"] == (zlib.crc32(str(doc).encode()) % 4 == 2)
    held = [(doc, lang) for doc, _, lang in rows[:400] if got[doc]["held_out"]]
    assert sum(got[d]["lang_pred"] == lang for d, lang in held) >= 0.95 * len(held)
    assert all(0 <= x["score"] <= 1 for x in got.values())
    assert [got[d]["lang_pred"] for d in (1000, 1001, 1002)] == ["und"] * 3
    assert got[None]["held_out"] is False
    assert language_id.identify(empty).count() == 0
    unlabelled = language_id.identify(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r["lang_pred"] for r in unlabelled.collect()} == {"und"}


def test_gradients():
    r = np.random.default_rng(0)
    model = language_id.ByteCNN.fresh(["x", "y"], widths=(2, 3), dims=4, n_filters=3)
    for a in model.parameters():
        a += r.standard_normal(a.shape).astype(np.float32) * 0.1
    windows, labels = r.integers(0, 256, (5, language_id.WINDOW)).astype(np.uint8), np.array([0, 1, 0, 1, 1])
    loss = lambda: -np.log(model.probabilities(windows)[np.arange(5), labels]).mean()
    for p, g in zip(model.parameters(), model.gradients(windows, labels), strict=True):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        old, step = p[at], 1e-2
        p[at] = old + step
        up = loss()
        p[at] = old - step
        down = loss()
        p[at] = old
        assert (up - down) / (2 * step) == pytest.approx(float(g[at]), rel=0.1, abs=1e-3)


def brute_probabilities(model, windows):
    out = []
    for window in windows.tolist():
        pooled = []
        for width, filters in model.filters.items():
            for f in range(filters.shape[2]):
                best = max(
                    sum(float(model.embed[window[at + j], d]) * float(filters[j, d, f]) for j in range(width) for d in range(filters.shape[1]))
                    for at in range(len(window) - width + 1)
                )
                pooled.append(max(0.0, best + float(model.bias[width][f])))
        scores = [sum(p * float(model.out[i, k]) for i, p in enumerate(pooled)) + float(model.out_bias[k]) for k in range(len(model.languages))]
        powers = [math.exp(s - max(scores)) for s in scores]
        out.append([p / sum(powers) for p in powers])
    return np.array(out)


def test_forward_pass_is_plain_loops():
    r = np.random.default_rng(3)
    model = language_id.ByteCNN.fresh(["x", "y", "z"], widths=(2, 3), dims=4, n_filters=5)
    for a in model.parameters():
        a += r.standard_normal(a.shape).astype(np.float32)
    windows = r.integers(0, 256, (3, language_id.WINDOW)).astype(np.uint8)
    want = brute_probabilities(model, windows)
    assert np.allclose(model.probabilities(windows), want, atol=1e-4)
