"""Quality rules on repetition coverage.

Rolling hashes of several n-gram lengths, in numpy over many texts at once,
measure how many characters of a text lie inside n-grams or lines that the text
repeats.  A text is judged on its own, so the work is one pass without shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from .textops import Texts, chunked, repeated, rolled, salted

SYMBOLS = b"#*$%&|<>"
_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(SYMBOLS)] = True


@dataclass(frozen=True)
class Limits:
    """What a kept text may show at most; shares are of the characters in words."""

    min_words: int = 50
    #: Percent of words inside 3-word windows that occur twice or more.
    repeat_percent: int = 50
    #: Share of characters inside repeated n-grams, by n.
    ngram_share: dict[int, float] = field(default_factory=lambda: {5: 0.45, 6: 0.43, 7: 0.41, 8: 0.39, 9: 0.37, 10: 0.35})
    #: Share of characters inside lines that equal an earlier line.
    line_share: float = 0.30
    #: Symbols ``#*$%&|<>`` for each word.
    symbols_per_word: float = 0.5


FIELDS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, dup_line_chars long, dup_ngram_chars array<long>"


def measure(texts: list[bytes], lengths: list[int]) -> pd.DataFrame:
    """One row of counts for each text; ``dup_ngram_chars`` has one count for each of ``lengths`` (4 or more)."""
    t = Texts(texts)
    heads = t.heads()
    chars = heads[t.ends] - heads[t.starts]
    word = t.hashes(t.starts, t.ends)

    # lines: each text ends with its own newline
    nl = np.flatnonzero(t.buf == 10)
    line_starts = np.concatenate([[0], nl[:-1] + 1])
    words_before = np.searchsorted(t.starts, np.concatenate([line_starts, [len(t.buf)]]))
    wordy = np.flatnonzero(np.diff(words_before) > 0)
    text_of_line = np.searchsorted(t.bounds, line_starts[wordy], side="right") - 1
    keys = salted(t.hashes(line_starts[wordy], nl[wordy]), text_of_line)
    again = np.ones(len(wordy), bool)
    again[np.unique(keys, return_index=True)[1]] = False
    char_sums = np.concatenate([[0], np.cumsum(chars)])
    line_chars = char_sums[words_before[wordy + 1]] - char_sums[words_before[wordy]]

    counts = {
        "n_words": t.n_words,
        "word_chars": t.per_text_words(chars),
        "n_symbols": t.per_text(_IS_SYMBOL[t.buf]),
        "n_dup_lines": np.bincount(text_of_line[again], minlength=t.n),
        "dup_line_chars": np.bincount(text_of_line[again], weights=line_chars[again], minlength=t.n).astype(np.int64),
    }

    # windows: an n-gram can be repeated only where its first three words are
    n_words, covered, at, keys = len(word), {}, np.arange(len(word)), word
    for n in range(2, max([3, *lengths]) + 1):
        room = at + n - 1 < n_words
        at, keys = at[room], keys[room]
        keys = rolled(keys, word[at + n - 1])
        if n == 3 or n in lengths:
            inside = t.text_of_word[at] == t.text_of_word[at + n - 1]
            at, keys = at[inside], keys[inside]
            twice = repeated(salted(keys, t.text_of_word[at]))
            at, keys = at[twice], keys[twice]
            steps = np.zeros(n_words + 1, np.int64)
            np.add.at(steps, at, 1)
            np.add.at(steps, at + n, -1)
            covered[n] = np.cumsum(steps[:-1]) > 0
    counts["n_repeat_words"] = t.per_text_words(covered[3])
    shares = [t.per_text_words(np.where(covered[n], chars, 0)) for n in lengths]
    counts["dup_ngram_chars"] = list(np.stack(shares, axis=1)) if shares else [[]] * t.n
    return pd.DataFrame(counts)


def quality_rules(docs: DataFrame, limits: Limits | None = None) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept and the method's own counts.

    ``base_failed``: fewer than ``min_words`` words, or too many words inside
    repeated 3-word windows.  ``kept`` is false for those and for texts with too
    large a share of characters in repeated n-grams or lines, or too many symbols.  A null or empty
    text has no words and is not kept.  Repeated rows are judged each on its
    own; an empty table gives no rows; other columns are ignored.
    """
    ship(docs.sparkSession)
    limits = limits or Limits()
    lengths = sorted(limits.ngram_share)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [b"" if t is None else bytes(t) for t in batch["_bytes"]]
            for first, run in chunked(texts):
                out = measure(run, lengths)
                out.insert(0, "doc_id", batch["doc_id"].iloc[first : first + len(run)].array)
                yield out

    id_type = docs.schema["doc_id"].dataType.simpleString()
    counted = docs.select("doc_id", F.col("text").cast("binary").alias("_bytes")).mapInPandas(count, f"doc_id {id_type}, {FIELDS}")
    failed = (F.col("n_words") < limits.min_words) | (100 * F.col("n_repeat_words") > limits.repeat_percent * F.col("n_words"))
    bad = (F.col("dup_line_chars") > limits.line_share * F.col("word_chars")) | (F.col("n_symbols") > limits.symbols_per_word * F.col("n_words"))
    for i, n in enumerate(lengths):
        bad = bad | (F.col("dup_ngram_chars")[i] > limits.ngram_share[n] * F.col("word_chars"))
    base = counted.withColumn("base_failed", failed)
    return base.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & ~bad).alias("kept"), "dup_line_chars", "dup_ngram_chars",
    )


def keep_quality(docs: DataFrame, limits: Limits | None = None) -> DataFrame:
    """``docs`` without the texts that :func:`quality_rules` rejects; all columns as they were.

    The verdict is taken in the pass that reads the text, so nothing is joined.
    """
    ship(docs.sparkSession)
    limits = limits or Limits()
    lengths = sorted(limits.ngram_share)
    line_share, shares = limits.line_share, [limits.ngram_share[n] for n in lengths]

    @F.pandas_udf("boolean")
    def kept(texts: pd.Series) -> pd.Series:
        found = []
        for _, run in chunked([b"" if t is None else bytes(t) for t in texts]):
            m = measure(run, lengths)
            ok = (m.n_words >= limits.min_words) & (100 * m.n_repeat_words <= limits.repeat_percent * m.n_words)
            ok &= (m.dup_line_chars <= line_share * m.word_chars) & (m.n_symbols <= limits.symbols_per_word * m.n_words)
            for i, share in enumerate(shares):
                ok &= np.array([x[i] for x in m.dup_ngram_chars]) <= share * m.word_chars
            found.append(ok)
        return pd.concat(found, ignore_index=True) if found else pd.Series([], dtype=bool)

    return docs.filter(kept(F.col("text").cast("binary")))
