"""Substring deduplication over bytes by a sparse suffix array.

The suffixes that stand for all windows (see ``repeats``) are range-partitioned
by their leading bytes, between splitters sampled from the corpus; each bucket
sorts its suffixes by multikey quicksort, and neighbours are compared, across
the buckets' boundaries too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from . import repeats
from .textops import Texts, chunked, mix

WINDOW_BYTES = 400
#: Of a window's first so many positions one owns it; about 2 / (REACH + 1) of all positions own windows.
REACH = 128
LEAD = 8
#: Bytes of text hashed at once: a window's owner takes some ten 8-byte numbers for each byte.
CHUNK = 1 << 20


def _reach(window: int) -> int:
    """The largest power of two that leaves the owner's gram inside the window, at most ``REACH``."""
    reach = 1
    while 2 * reach <= min(REACH, window - LEAD + 1):
        reach *= 2
    return reach


def _byte_units(text: Texts) -> tuple[np.ndarray, np.ndarray]:
    at = np.arange(len(text.buf))
    return at, at + 1


def suffixes(docs: DataFrame, window: int) -> DataFrame:
    """One row for each owner of windows: its leading bytes, core and span."""
    reach = _reach(window)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            d, t = batch["d"].to_numpy(), batch["t"].to_numpy()
            for first, run in chunked([bytes(b) for b in batch["_bytes"]], CHUNK):
                text = Texts(run)
                n = len(text.buf)
                padded = np.concatenate([text.buf, np.zeros(LEAD, np.uint8)])
                grams = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, LEAD)[:n])
                sizes = np.diff(text.bounds) - 1
                valid = np.zeros(n, bool)
                for start, size in zip(text.bounds[:-1][sizes >= window], sizes[sizes >= window], strict=True):
                    valid[start : start + size - window + 1] = True
                owner, lo, hi = repeats.owners(mix(grams.view("<u8").ravel().astype(np.uint64)), valid, reach)
                starts, ends = _byte_units(text)
                core, span = repeats.span_hashes(text, starts, ends, owner, lo, hi, window, reach)
                doc = np.searchsorted(text.bounds, lo, side="right") - 1
                yield pd.DataFrame({
                    "lead": grams[owner].view(">i8").ravel().astype(np.int64), "core": core.view(np.int64), "span": span.view(np.int64),
                    "d": d[first + doc], "t": t[first + doc],
                    "lo": (lo - text.bounds[doc]).astype(np.int32), "hi": (hi - text.bounds[doc]).astype(np.int32),
                })

    return docs.select("d", "t", "_bytes").mapInPandas(scan, repeats.ROW)


def remove_substrings(docs: DataFrame, window: int = WINDOW_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes) for each row of ``docs``.

    Each byte that a ``window``-byte string covers which also starts anywhere
    else, in the same document too, is removed; strings never cross documents.
    Null counts as empty; shorter texts keep everything.  Rows that repeat a
    text are repeats of each other, whatever their doc_id; an empty table gives
    no rows; other columns are ignored.
    """
    repeats.prepare_session(docs.sparkSession)
    rows = repeats.keyed(docs)
    windows = repeats.repeated_windows(rows, suffixes(rows, window), lambda texts: texts, _byte_units, window, "suffix")

    def drop(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for raw, ranges in zip(batch["_bytes"], batch["ranges"], strict=True):
                raw = bytes(raw)
                gone = repeats.removed_units(ranges, len(raw), window)
                kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
                out.append((len(raw), int(gone.sum()), int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum()), kept))
            frame = pd.DataFrame(out, columns=["n_bytes", "n_removed", "n_spans", "kept"])
            frame.insert(0, "doc_id", batch["doc_id"].array)
            yield frame

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return repeats.with_ranges(rows, windows).mapInPandas(drop, f"doc_id {id_type}, n_bytes long, n_removed long, n_spans long, kept binary")
