"""Packing documents into sequences by bounded-space online best-fit.

Each task holds a fixed number of open bins in a bitset keyed by free space: the
lowest set bit at or above a piece's length is the tightest bin that takes it.
When there are too many open bins, the fullest closes first.

Token ids never move: a first pass over the texts leaves one narrow row for each
piece; these are dealt out by hash, so hot documents or sources don't matter, to
tasks of about ``PIECES_PER_TASK`` pieces, and packed there in one stream.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from .common import cut
from .tokens import encoder, vocabulary

SEQUENCE_TOKENS = 4096
END_ID = 1
#: Open bins that a task holds.
OPEN_BINS = 2048
#: Pieces for each packing task; the bins left open at its end are few against it.
PIECES_PER_TASK = 100_000
#: Pieces that a worker's cache of ids holds; some 500 bytes each with all that belongs to them.
CACHE_PIECES = 500_000


class BestFit:
    """Places lengths online; ``place`` gives the bin's number and the offset in it."""

    def __init__(self, capacity: int, open_bins: int):
        self.capacity, self.limit = capacity, open_bins
        self.free_spaces = 0  # bit f is set while a bin with f free is open
        self.bins: dict[int, list[int]] = {}
        self.n_open = self.opened = 0

    def _take(self, free: int) -> int:
        stack = self.bins[free]
        number = stack.pop()
        if not stack:
            del self.bins[free]
            self.free_spaces &= ~(1 << free)
        self.n_open -= 1
        return number

    def place(self, length: int) -> tuple[int, int]:
        fitting = self.free_spaces >> length
        if fitting:
            free = length + ((fitting & -fitting).bit_length() - 1)
            number = self._take(free)
        else:
            free, number = self.capacity, self.opened
            self.opened += 1
        left = free - length
        if left:
            self.bins.setdefault(left, []).append(number)
            self.free_spaces |= 1 << left
            self.n_open += 1
            if self.n_open > self.limit:
                fullest = (self.free_spaces & -self.free_spaces).bit_length() - 1
                self._take(fullest)
        return number, self.capacity - free


def pieces(docs: DataFrame, tokenizer: str, spaces: str, sequence_tokens: int = SEQUENCE_TOKENS, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: the pieces of each row's ids and its end id."""
    ship(docs.sparkSession)
    end = np.array([end_id], np.uint32)

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(tokenizer, spaces, cache_pieces=CACHE_PIECES)
        for batch in batches:
            rows = []
            for doc, ids in zip(batch["doc_id"].array, enc.encode("" if t is None else t for t in batch["text"]), strict=True):
                if len(ids) < sequence_tokens:
                    rows.append((doc, 0, 0, len(ids) + 1, zlib.crc32(end, zlib.crc32(ids))))
                    continue
                ids = np.append(ids, end)
                for piece, at in enumerate(range(0, len(ids), sequence_tokens)):
                    part = ids[at : at + sequence_tokens]
                    rows.append((doc, piece, at, len(part), zlib.crc32(part)))
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInPandas(split, f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long")


def pack(rows: DataFrame, sequence_tokens: int = SEQUENCE_TOKENS, open_bins: int = OPEN_BINS, pieces_per_task: int = PIECES_PER_TASK) -> DataFrame:
    """Add sequence_id and offset to rows that have a ``length`` (1 to ``sequence_tokens``).

    A sequence_id is the task's number in the upper bits and the bin's in the lower.
    """
    ship(rows.sparkSession)
    keys = [c for c in ("doc_id", "piece", "ids_crc32") if c in rows.columns]
    whole = F.col("length") == sequence_tokens
    tasks = max(1, -(-rows.filter(~whole).count() // pieces_per_task))

    def fill(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        context = TaskContext.get()
        base = (context.partitionId() if context else 0) << 40
        bins = BestFit(sequence_tokens, open_bins)
        for batch in batches:
            placed = [bins.place(n) for n in batch["length"].tolist()]
            yield batch.assign(sequence_id=[base + n for n, _ in placed], offset=[o for _, o in placed])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", sequence_id long, offset long"
    # rows that repeat another in all of these are dealt apart by their arrival
    turn = F.xxhash64(*keys, "length", F.monotonically_increasing_id())
    # the order within a task is a hash's, not the corpus's: a run of long documents would crowd out the open bins
    dealt = rows.withColumn("_turn", turn).repartition(tasks, "_turn").sortWithinPartitions("_turn", *keys).drop("_turn")
    return dealt.mapInPandas(fill, schema)


def best_fit_packing(
    docs: DataFrame,
    tokenizer: str | None = None,
    spaces: str = "drop",
    sequence_tokens: int = SEQUENCE_TOKENS,
    end_id: int = END_ID,
    open_bins: int = OPEN_BINS,
    pieces_per_task: int = PIECES_PER_TASK,
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document's ids and ``end_id``; only one longer than a sequence is cut, into
    full pieces and a rest.  A null or empty text is one piece, the end id alone.
    Rows that repeat a doc_id are packed each on its own; a null doc_id is
    carried along; an empty table gives no rows; other columns are ignored.
    """
    rows = cut(pieces(docs, tokenizer or vocabulary("word_bpe_49k.json"), spaces, sequence_tokens, end_id), "pieces")
    return pack(rows, sequence_tokens, open_bins, pieces_per_task)
