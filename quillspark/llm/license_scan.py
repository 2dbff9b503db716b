"""License scans by an exact set-similarity join of text blocks and templates.

A template is a set of words; a block is a window of a text.  They join where
the block holds the ``containment`` share of the template's words.  Words are
ordered by how often they occur in the corpus, rarest first:

* prefix filter: a template of n words of which ``need`` must be found has one of
  its n - need + 1 rarest words in every block that it joins with, so only blocks
  with such a word are looked at;
* length filter: the block must have ``need`` words that templates use at all;
* positional filter: from the places of the rarest shared word in both orders, the
  words left on either side must suffice.

What is left is counted word by word.  The first pass over the texts counts the
templates' words, the second gives base places and the blocks that a prefix word
points to, both in Python batches next to the scan, so no text is ever shuffled;
the join itself is one of narrow rows.

Windows: templates are of a class by length (8, 16, 32, ... words); the blocks of
class c are 2c words long and begin at every c-th word, so every run of c words lies
in one whole.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shipping import ship
from .common import cut

#: Share of a template's distinct words that a block must hold.
CONTAINMENT = 0.9
SMALLEST_CLASS = 8
#: Templates whose words go out to the tasks at once; more are joined in as many passes as needed.
TEMPLATES_PER_PASS = 20_000
# The base phrases and their labels.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

#: A-Z become a-z; every other byte below 0x80 that is no digit and no letter ends a word.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """The words of a text, as UTF-8: runs of digits, letters and anything beyond ASCII; A-Z count as a-z."""
    return (text or "").encode().translate(_TABLE).split()


def default_templates() -> list[tuple[str, str]]:
    """(label, text) of the file beside this module."""
    lines = (Path(__file__).parent / "license_templates.txt").read_text("utf-8").splitlines()
    return [tuple(line.split(": ", 1)) for line in lines if line and not line.startswith("#")]


def _needed(n: int, containment: float) -> int:
    return max(1, -int(-(n * containment - 1e-9) // 1))


def _class_of(words: int) -> int:
    size = SMALLEST_CLASS
    while size < words:
        size *= 2
    return size


def _base(words: list[bytes], phrases: Iterable[tuple[bytes, str]]) -> tuple[int, int | None, int | None, list[str]]:
    """Places of all phrases, the smallest and the largest start, and the labels."""
    flat = b" " + b" ".join(words) + b" "
    starts, labels, places = [], [], 0
    for phrase, label in phrases:
        at = flat.find(phrase)
        if at < 0:
            continue
        labels.append(label)
        starts.append(at)
        while at >= 0:
            places, last = places + 1, at
            at = flat.find(phrase, at + 1)
        starts.append(last)
    if not places:
        return 0, None, None, []
    # the spaces before a word are as many as the words before it
    return places, flat.count(b" ", 0, min(starts)), flat.count(b" ", 0, max(starts)), sorted(labels)


def word_counts(docs: DataFrame, words: set[bytes]) -> DataFrame:
    """(token, n): how often each of ``words`` occurs in all texts."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: Counter[bytes] = Counter()
        for batch in batches:
            for text in batch["text"]:
                found.update(filter(words.__contains__, words_of(text)))
        if found:
            yield pd.DataFrame({"token": [w.decode() for w in found], "n": list(found.values())})

    return docs.select("text").mapInPandas(count, "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))


def _scan(docs: DataFrame, prefixes: dict[bytes, tuple[int, ...]], words: set[bytes], phrases: tuple[tuple[str, str], ...]) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base, blocks.

    ``blocks`` are those of a class in which a prefix word of that class stands:
    (class, block, tokens), with the distinct words that any template uses.
    """
    wanted = [(b" " + p.encode() + b" ", label) for p, label in phrases]

    @F.pandas_udf("n_words long, n_base long, first_word long, last_word long, base array<string>, blocks array<struct<size:int,block:long,tokens:array<string>>>")
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        rare = prefixes.keys()
        for batch in batches:
            rows = []
            for text in batch:
                found = words_of(text)
                blocks = []
                if not rare.isdisjoint(found):
                    at = {(size, i // size - back) for i, w in enumerate(found) if w in prefixes for size in prefixes[w] for back in (0, 1)}
                    for size, block in sorted(at):
                        if block >= 0:
                            own = words.intersection(found[block * size : (block + 2) * size])
                            blocks.append((size, block, [w.decode() for w in own]))
                rows.append((len(found), *_base(found, wanted), blocks))
            # integers with nulls stay integers
            yield pd.DataFrame(rows, columns=["n_words", "n_base", "first_word", "last_word", "base", "blocks"]).astype({"first_word": "Int64", "last_word": "Int64"})

    return docs.select("doc_id", scan("text").alias("s")).select("doc_id", "s.*")


def _matches(scanned: DataFrame, templates: DataFrame, order: DataFrame) -> DataFrame:
    """(row, label, score) for every block and template that join.

    ``templates``: template, label, token, n, need, place (in the order), size.
    ``order``: token, n for every template word.
    """
    blocks = scanned.select("row", F.explode("blocks").alias("b")).select("row", F.col("b.size").alias("size"), F.col("b.block").alias("block"), F.explode("b.tokens").alias("token"))
    block = ["row", "size", "block"]
    # at most two classes' worth of words in a group
    rank = Window.partitionBy(*block).orderBy("n", "token")
    held = blocks.join(order, "token").withColumn("at", F.row_number().over(rank)).withColumn("held", F.count(F.lit(1)).over(Window.partitionBy(*block)))
    held = cut(held.select(*block, "token", "at", "held"), "license-blocks")
    short = templates.filter(F.col("place") <= F.col("n") - F.col("need") + 1)
    probes = held.join(short, ["token", "size"])
    # places are numbered from one: this word and those after it on both sides
    left = F.least(F.col("n") - F.col("place"), F.col("held") - F.col("at")) + 1
    pairs = probes.filter((F.col("held") >= F.col("need")) & (left >= F.col("need"))).select(*block, "template").distinct()
    candidates = cut(pairs, "license-candidates")
    whole = candidates.join(held.drop("held", "at"), block).join(templates.select("template", "token", "label", "n", "need"), ["template", "token"])
    counted = whole.groupBy(*block, "template").agg(F.count(F.lit(1)).alias("shared"), F.first("label").alias("label"), F.first("n").alias("n"), F.first("need").alias("need"))
    return counted.filter(F.col("shared") >= F.col("need")).select("row", "label", (F.col("shared") / F.col("n")).alias("score"))


def _prepared(docs: DataFrame, templates: list[tuple[str, str]], containment: float) -> tuple[DataFrame, DataFrame, dict[bytes, tuple[int, ...]], set[bytes]]:
    """The templates' words in order (see :func:`_matches`), every word's count, the prefix words with their classes, and all words."""
    spark = docs.sparkSession
    sets = [(label, len(ws := words_of(text)), sorted({w.decode() for w in ws})) for label, text in templates]
    rows = [(i, label, _class_of(length), len(own), _needed(len(own), containment), w) for i, (label, length, own) in enumerate(sets) for w in own]
    words = {w.encode() for *_, w in rows}
    flat = spark.createDataFrame(rows, "template int, label string, size int, n int, need int, token string")
    counts = word_counts(docs, words)
    order = cut(flat.select("token").distinct().join(counts, "token", "left").select("token", F.coalesce("n", F.lit(0)).alias("n")), "license-word-counts")
    place = F.row_number().over(Window.partitionBy("template").orderBy("count", "token"))
    ranked = cut(flat.join(order.withColumnRenamed("n", "count"), "token").withColumn("place", place).drop("count"), "license-templates")
    rare = ranked.filter(F.col("place") <= F.col("n") - F.col("need") + 1).groupBy("token").agg(F.collect_set("size").alias("sizes")).collect()
    return ranked, order, {r["token"].encode(): tuple(r["sizes"]) for r in rare}, words


def license_scan(
    docs: DataFrame,
    templates: list[tuple[str, str]] | None = None,
    phrases: tuple[tuple[str, str], ...] = PHRASES,
    containment: float = CONTAINMENT,
    templates_per_pass: int = TEMPLATES_PER_PASS,
) -> DataFrame:
    """One row for each row of ``docs``.

    doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.
    ``templates`` are (label, text), by default a list of common notices.  Base
    places are those where a phrase's words stand one after another; ``labels``
    adds those of the templates of which a block of the text holds the
    ``containment`` share of the distinct words; ``score`` is 1 for a text with a base
    place, else the largest share found, else 0.  Labels are distinct, sorted and
    comma-joined.  Null and empty texts have no words and no labels; rows that
    repeat a doc_id are judged each on its own; an empty table gives no rows;
    other columns are ignored.
    """
    ship(docs.sparkSession)
    templates = [t for t in (default_templates() if templates is None else templates) if words_of(t[1])]
    out = None
    if len(templates) > templates_per_pass:  # the passes must agree on the rows' numbers
        docs = cut(docs.select("doc_id", "text"), "license-texts")
    for at in range(0, max(1, len(templates)), templates_per_pass):
        ranked, order, prefixes, words = _prepared(docs, templates[at : at + templates_per_pass], containment)
        scanned = cut(_scan(docs, prefixes, words, phrases).withColumn("row", F.monotonically_increasing_id()), "license-scan")
        found = _matches(scanned, ranked, order).groupBy("row").agg(F.collect_set("label").alias("found"), F.max("score").alias("best"))
        if out is None:
            out = scanned.drop("blocks").join(found, "row", "left")
        else:
            out = out.join(found.select("row", F.col("found").alias("more"), F.col("best").alias("above")), "row", "left")
            out = out.withColumn("found", F.coalesce(F.array_union("found", "more"), "found", "more")).withColumn("best", F.greatest("best", "above")).drop("more", "above")
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    none = F.array().cast("array<string>")
    return out.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", joined("base").alias("base_labels"),
        joined(F.concat("base", F.coalesce("found", none))).alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )
