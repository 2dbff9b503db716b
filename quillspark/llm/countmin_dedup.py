"""Substring deduplication over words with a count-min prefilter.

A first pass makes a count-min sketch of each partition; merged, they
overestimate how often the windows of an owner (see ``repeats``) occur, for a
window occurs no more often than its owner's core.  A second pass takes only the
owners estimated at two or more and groups their windows exactly.  An estimate
is never too low, so no repeated window is lost; a sketch too small for its
corpus costs time, not results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import repeats
from .textops import Texts, chunked, mix

WINDOW_WORDS = 35
REACH = 16
GRAM = 3
#: Rows of the sketch, cells for each owner expected, and bounds on a row's cells (a power of two).
SKETCH_ROWS = 2
CELLS_PER_OWNER = 4
MIN_CELL_BITS, MAX_CELL_BITS = 16, 28
BLOCK_BITS = 16
_ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def _reach(window: int) -> int:
    reach = 1
    while 2 * reach <= min(REACH, window - GRAM + 1):
        reach *= 2
    return reach


def _canonical(texts: list[bytes]) -> list[bytes]:
    """Words as they are, joined by one space."""
    return [b" ".join(t.split()) for t in texts]


def _word_units(text: Texts) -> tuple[np.ndarray, np.ndarray]:
    return text.starts, text.ends


def _owners(text: Texts, window: int, reach: int):
    """Owners of the windows of a run of texts, with core and span."""
    word = text.hashes(text.starts, text.ends)
    n = len(word)
    gram = word.copy()
    for j in range(1, GRAM):
        gram[: n - j] = mix(gram[: n - j]) + word[j:] if n > j else gram[: n - j]
    valid = np.zeros(n, bool)
    for start, size in zip(text.first_word[:-1][text.n_words >= window], text.n_words[text.n_words >= window], strict=True):
        valid[start : start + size - window + 1] = True
    owner, lo, hi = repeats.owners(mix(gram), valid, reach)
    core, span = repeats.span_hashes(text, text.starts, text.ends, owner, lo, hi, window, reach)
    return owner, lo, hi, core, span


def _cells(core: np.ndarray, row: int, bits: int) -> np.ndarray:
    return (core * _ODD[row]) >> np.uint64(64 - bits)


def sketch(docs: DataFrame, window: int, bits: int) -> list[np.ndarray]:
    """For each row of the merged sketch a bit map of the cells that count two or more.

    A partition's sketch leaves it as (row, block of cells, the cells that are
    not zero, their counts), counts held at two; blocks are merged by adding up.
    What comes to the driver is ``SKETCH_ROWS`` maps of at most 2 ** bits bits.
    """
    reach = _reach(window)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0

        def flush() -> Iterator[pd.DataFrame]:
            cores = np.concatenate(held) if held else np.zeros(0, np.uint64)
            for row in range(SKETCH_ROWS):
                cells, counts = np.unique(_cells(cores, row, bits), return_counts=True)
                blocks = (cells >> np.uint64(BLOCK_BITS)).astype(np.int64)
                bounds = np.flatnonzero(np.diff(blocks, prepend=-1))
                low = (cells & np.uint64((1 << BLOCK_BITS) - 1)).astype("<u2")
                counts = np.minimum(counts, 2).astype(np.uint8)
                yield pd.DataFrame({
                    "row": row, "block": blocks[bounds],
                    "cells": [x.tobytes() for x in np.split(low, bounds[1:])] if len(bounds) else [],
                    "counts": [x.tobytes() for x in np.split(counts, bounds[1:])] if len(bounds) else [],
                })

        for batch in batches:
            for _, run in chunked([bytes(b) for b in batch["_bytes"]]):
                core = _owners(Texts(_canonical(run)), window, reach)[3]
                held.append(core)
                size += len(core)
                if size > 2_000_000:
                    yield from flush()
                    held, size = [], 0
        yield from flush()

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for row, block, cells, counts in batch.itertuples(index=False):
                total = sums.setdefault((row, block), np.zeros(1 << BLOCK_BITS, np.uint8))
                at = np.frombuffer(cells, "<u2")
                total[at] = np.minimum(total[at] + np.frombuffer(counts, np.uint8), 2)
        for (row, block), total in sums.items():
            yield pd.DataFrame({"row": [row], "block": [block], "bits": [np.packbits(total >= 2).tobytes()]})

    partial = docs.select("_bytes").mapInPandas(count, "row int, block long, cells binary, counts binary")
    merged = partial.repartition("row", "block").mapInPandas(merge, "row int, block long, bits binary")
    maps = [np.zeros(1 << (bits - 3), np.uint8) for _ in range(SKETCH_ROWS)]
    width = 1 << (BLOCK_BITS - 3)
    for r in merged.toLocalIterator():
        maps[r["row"]][r["block"] * width : (r["block"] + 1) * width] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return maps


def _estimated_repeated(core: np.ndarray, maps: list[np.ndarray], bits: int) -> np.ndarray:
    out = np.ones(len(core), bool)
    for row, bitmap in enumerate(maps):
        cell = _cells(core, row, bits)
        out &= (bitmap[(cell >> np.uint64(3)).astype(np.int64)] >> (np.uint8(7) - (cell & np.uint64(7)).astype(np.uint8))) & 1 == 1
    return out


def cell_bits(docs: DataFrame) -> int:
    """Bits that number the cells of a row, from the size of all texts (about six bytes a word)."""
    size = docs.agg(F.sum(F.octet_length("_bytes"))).first()[0] or 0
    wanted = max(1, CELLS_PER_OWNER * size * 2 / (6 * (REACH + 1)))
    return int(min(MAX_CELL_BITS, max(MIN_CELL_BITS, np.ceil(np.log2(wanted)))))


def candidates(docs: DataFrame, window: int, maps: list[np.ndarray], bits: int) -> DataFrame:
    """One row for each owner of windows that the sketch estimates at two or more."""
    reach, shared = _reach(window), docs.sparkSession.sparkContext.broadcast(maps)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            d, t = batch["d"].to_numpy(), batch["t"].to_numpy()
            for first, run in chunked([bytes(b) for b in batch["_bytes"]]):
                text = Texts(_canonical(run))
                _, lo, hi, core, span = _owners(text, window, reach)
                keep = _estimated_repeated(core, shared.value, bits)
                lo, hi = lo[keep], hi[keep]
                doc = text.text_of_word[lo]
                yield pd.DataFrame({
                    "lead": np.int64(0), "core": core[keep].view(np.int64), "span": span[keep].view(np.int64),
                    "d": d[first + doc], "t": t[first + doc],
                    "lo": (lo - text.first_word[doc]).astype(np.int32), "hi": (hi - text.first_word[doc]).astype(np.int32),
                })

    return docs.select("d", "t", "_bytes").mapInPandas(scan, repeats.ROW)


def remove_repeated_words(docs: DataFrame, window: int = WINDOW_WORDS, bits: int | None = None) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the remaining words, joined by one space) for each row of ``docs``.

    Each word that a window of ``window`` words covers whose words also start
    anywhere else, in the same document too, is removed; windows never cross
    documents.  Null and empty texts have no words; shorter texts keep all.
    Rows that repeat a text are repeats of each other, whatever their doc_id; an
    empty table gives no rows; other columns are ignored.
    """
    repeats.prepare_session(docs.sparkSession)
    rows = repeats.keyed(docs)
    bits = bits or cell_bits(rows)
    found = candidates(rows, window, sketch(rows, window, bits), bits)
    windows = repeats.repeated_windows(rows, found, _canonical, _word_units, window, "countmin")

    def drop(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for raw, ranges in zip(batch["_bytes"], batch["ranges"], strict=True):
                words = bytes(raw).split()
                gone = repeats.removed_units(ranges, len(words), window)
                kept = [w for w, g in zip(words, gone.tolist(), strict=True) if not g] if gone.any() else words
                out.append((len(words), int(gone.sum()), b" ".join(kept)))
            frame = pd.DataFrame(out, columns=["n_words", "n_removed", "kept"])
            frame.insert(0, "doc_id", batch["doc_id"].array)
            yield frame

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return repeats.with_ranges(rows, windows).mapInPandas(drop, f"doc_id {id_type}, n_words long, n_removed long, kept binary")
