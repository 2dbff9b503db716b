"""Finding windows of a fixed length that occur more than once in a corpus.

Shared by the substring operators over words and over bytes.  Moving every
window would cost many times the corpus, so windows are dealt with in groups:

* The *owner* of a window is the position of the smallest hash among its first
  ``reach`` positions.  Equal windows have their owner at the same place, and
  neighbouring windows mostly share one, so there is one row for each owner, not
  for each window.  A row carries the hash of its *core* (what all its windows
  have in common from the owner on) and of its *span* (all that its windows
  cover).
* Rows are sorted and compared with their neighbours.  Equal core and span: all
  windows of the row occur again.  A core of its own: none does.  Equal core but
  different spans (the ends of a shared passage): the windows are looked at one
  by one, by two 64-bit hashes of their whole content, in the same way.

Sorting is by sampled ranges with the document as the last key, so a passage
that a third of all documents hold is split over tasks; partitions compare their
first and last row across the boundary.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship
from .common import cut, id_key, shuffle_width
from .textops import Texts, mix

ROW = "lead long, core long, span long, d long, t long, lo int, hi int"
KEYS = ["lead", "core", "span", "d", "t", "lo"]
_PLACE = np.uint64(0xA24BAED4963EE407)


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, d and t (together the document's key: rows that repeat doc_id and text share it), _bytes."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", id_key(F.col("doc_id")).alias("d"), F.xxhash64(text).alias("t"), text.cast("binary").alias("_bytes"))


def owners(hashes: np.ndarray, valid: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the window starts flagged ``valid``: each owner with its first and last window.

    ``hashes`` has a hash for each position; ``reach`` is a power of two.  Runs
    of one owner are cut where ``valid`` has a gap.
    """
    if len(hashes) < reach or not valid.any():
        none = np.zeros(0, np.int64)
        return none, none, none
    low = (hashes & ~np.uint64(0xFFFFFFFF)) | np.arange(len(hashes), dtype=np.uint64)
    size = 1
    while size < reach:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    starts = np.flatnonzero(valid[: len(low)])
    owner = (low[starts] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.flatnonzero((np.diff(owner, prepend=-1) != 0) | (np.diff(starts, prepend=-2) != 1))
    last = np.append(new[1:], len(starts)) - 1
    return owner[new], starts[new], starts[last]


def multikey_quicksort(columns: list[np.ndarray]) -> np.ndarray:
    """The order of rows by several keys: each key is sorted only within the runs that tie on all keys before it."""
    n = len(columns[0])
    order = np.argsort(columns[0], kind="quicksort")
    tied = np.zeros(n, np.int64)  # number of the run that a place in the order belongs to
    before = columns[0]
    for column in columns[1:]:
        keys = before[order]
        tied = np.cumsum(np.concatenate([[False], (keys[1:] != keys[:-1]) | (tied[1:] != tied[:-1])]))
        sizes = np.bincount(tied, minlength=1)
        places = np.flatnonzero(sizes[tied] > 1)
        if not len(places):
            break
        rows = order[places]
        order[places] = rows[np.lexsort((column[rows], tied[places]))]
        before = column
    return order


def compare_neighbours(rows: DataFrame, label: str) -> DataFrame:
    """(d, t, lo, hi, again, mixed) of the rows that are one or both.

    ``again``: another row has the same lead, core and span.  ``mixed``: the row
    stands, in sorted order, beside one of the same lead and core whose span
    differs; each distinct span of such a core has a row that is.
    """
    spark = rows.sparkSession

    def sort(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [b for b in batches if len(b)]
        if not parts:
            return
        frame = pd.concat(parts, ignore_index=True)
        columns = [frame[c].to_numpy() for c in ("lead", "core", "span")]
        order = multikey_quicksort(columns)
        lead, core, span = (c[order] for c in columns)
        same_core = (lead[1:] == lead[:-1]) & (core[1:] == core[:-1])
        same_span = same_core & (span[1:] == span[:-1])
        again, mixed = np.zeros(len(order), bool), np.zeros(len(order), bool)
        again[1:] |= same_span
        again[:-1] |= same_span
        mixed[1:] |= same_core & ~same_span
        mixed[:-1] |= same_core & ~same_span
        edge = np.zeros(len(order), np.int32)
        edge[0] += 1
        edge[-1] += 2
        told = np.flatnonzero(again | mixed | (edge > 0))
        out = frame.iloc[order[told]]
        yield out.assign(again=again[told], mixed=mixed[told], edge=edge[told], part=TaskContext.get().partitionId())

    ranged = rows.repartitionByRange(shuffle_width(spark), *KEYS)
    told = cut(ranged.mapInPandas(sort, f"{ROW}, again boolean, mixed boolean, edge int, part int"), label)
    # the first and last row of each partition, compared across boundaries: two small rows a partition
    edges = sorted(told.filter("edge > 0").collect(), key=lambda r: (r["part"], r["edge"] == 2))
    fixed = []
    for a, b in zip(edges, edges[1:], strict=False):
        if a["part"] < b["part"] and (a["lead"], a["core"]) == (b["lead"], b["core"]):
            same = a["span"] == b["span"]
            fixed += [(r["d"], r["t"], r["lo"], r["hi"], same, not same) for r in (a, b)]
    columns = ["d", "t", "lo", "hi", "again", "mixed"]
    more = spark.createDataFrame(fixed, "d long, t long, lo int, hi int, again boolean, mixed boolean")
    return told.filter("again or mixed").select(*columns).unionByName(more)


def repeated_windows(
    docs: DataFrame,
    rows: DataFrame,
    prepare: Callable[[list[bytes]], list[bytes]],
    units: Callable[[Texts], tuple[np.ndarray, np.ndarray]],
    window: int,
    label: str,
) -> DataFrame:
    """(d, t, lo, hi): ranges of window starts, in units, whose windows occur again anywhere.

    ``docs`` as of ``keyed``; ``rows`` one row for each owner.  ``prepare`` gives
    the text that is compared; ``units`` the bounds of its units in ``Texts``.
    """
    found = compare_neighbours(rows, f"{label}-owners")
    whole = found.filter("again").select("d", "t", "lo", "hi")
    doubtful = found.filter("mixed").groupBy("d", "t").agg(F.collect_set(F.struct("lo", "hi")).alias("ranges"))

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for d, t, raw, ranges in zip(batch["d"], batch["t"], batch["_bytes"], batch["ranges"], strict=True):
                text = Texts(prepare([bytes(raw)]))
                starts, ends = units(text)
                at = np.unique(np.concatenate([np.arange(r["lo"], r["hi"] + 1) for r in ranges]))
                a, b = starts[at], ends[at + window - 1]
                view = text.buf.tobytes()
                other = np.fromiter((xxhash.xxh3_64_intdigest(view[i:j]) for i, j in zip(a.tolist(), b.tolist(), strict=True)), np.uint64, len(at))
                yield pd.DataFrame({
                    "lead": text.hashes(a, b).view(np.int64), "core": other.view(np.int64), "span": 0,
                    "d": d, "t": t, "lo": at.astype(np.int32), "hi": at.astype(np.int32),
                })

    single = docs.join(doubtful, ["d", "t"]).select("d", "t", "_bytes", "ranges").mapInPandas(each, ROW)
    more = compare_neighbours(single, f"{label}-windows").filter("again").select("d", "t", "lo", "hi")
    return whole.unionByName(more)


def removed_units(ranges, n: int, window: int) -> np.ndarray:
    """True for each of ``n`` units that a window starting in one of the ranges covers."""
    steps = np.zeros(n + 1, np.int64)
    if ranges is not None and len(ranges):
        lo = np.array([r["lo"] for r in ranges])
        hi = np.array([r["hi"] for r in ranges])
        np.add.at(steps, lo, 1)
        np.add.at(steps, np.minimum(hi + window, n), -1)
    return np.cumsum(steps[:-1]) > 0


def with_ranges(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """doc_id, _bytes, ranges (null where nothing occurs again)."""
    lists = windows.groupBy("d", "t").agg(F.collect_set(F.struct("lo", "hi")).alias("ranges"))
    return docs.join(lists, ["d", "t"], "left").select("doc_id", "_bytes", "ranges")


def span_hashes(text: Texts, starts: np.ndarray, ends: np.ndarray, owner, lo, hi, window: int, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Core and span hashes of owners, in units bounded by ``starts`` and ``ends``."""
    core = text.hashes(starts[owner], ends[owner + window - reach])
    span = mix(text.hashes(starts[lo], ends[hi + window - 1]) + (owner - lo).astype(np.uint64) * _PLACE)
    return core, span


def prepare_session(spark: SparkSession) -> None:
    ship(spark)
