"""Product-quantisation codes of vectors, in integers throughout.

Every component becomes floor(scale * x); a vector is cut into equal parts, and
each part position has a codebook of its own that a fixed number of rounds fits to
all vectors.  The nearest entry is found by partial-distance search: dimensions
are taken in descending order of the codebook's variance, and a mask drops a
vector from an entry as soon as its distance so far is above the best complete
distance that the vector has.

The codebooks (parts x entries x width integers, whatever the table's size) go out
with each round's tasks; sums and counts of each batch come back as narrow rows,
are added up by Spark, and only the new codebooks reach the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from .common import cut

PARTS = 8
ENTRIES = 16
ROUNDS = 6
SCALE = 4096
#: Scaled components beyond this are refused, as sums of squares would not fit in 64 bits.
LARGEST = 1 << 27
#: Vectors that are compared at once.
CHUNK = 4096


def usable(vectors: DataFrame, scale: int = SCALE, parts: int = PARTS) -> DataFrame:
    """vec_id, label, ints: rows whose vector is whole and finite and can be cut into ``parts`` equal parts."""
    found = vectors.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("_v"))
    whole = F.col("_v").isNotNull() & (F.size("_v") > 0) & (F.size("_v") % parts == 0)
    finite = F.forall("_v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return found.filter(whole & F.coalesce(finite, F.lit(False))).select("vec_id", "label", F.transform("_v", lambda x: F.floor(x * scale)).alias("ints"))


def nearest(part: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The index of the nearest entry of ``book`` for each row of ``part``, the lower of equals, and its squared distance."""
    order = np.argsort(-book.astype(np.float64).var(axis=0), kind="stable")
    columns = np.ascontiguousarray(part.T[order])
    book = book[:, order]
    index = np.zeros(len(part), np.int64)
    best = ((columns - book[0][:, None]) ** 2).sum(axis=0)
    for entry in range(1, len(book)):
        rows = np.arange(len(part))
        so_far = np.zeros(len(part), np.int64)
        for values, x in zip(columns, book[entry], strict=True):
            so_far = so_far + (values[rows] - x) ** 2
            still = so_far <= best[rows]  # what is strictly above can't win any more
            if not still.all():
                rows, so_far = rows[still], so_far[still]
                if not len(rows):
                    break
        closer = so_far < best[rows]
        index[rows[closer]] = entry
        best[rows[closer]] = so_far[closer]
    return index, best


def _blocks(batch: pd.Series) -> Iterator[np.ndarray]:
    for at in range(0, len(batch), CHUNK):
        ints = np.stack(batch.iloc[at : at + CHUNK].to_numpy()).astype(np.int64)
        if np.abs(ints).max() > LARGEST:
            raise ValueError(f"a scaled component is beyond {LARGEST}")
        yield ints


def first_books(ints: DataFrame, parts: int = PARTS, entries: int = ENTRIES) -> np.ndarray:
    """The codebooks to begin with: the parts of the vectors of the smallest vec_ids (null last; of equal ids the smaller vector first)."""
    rows = ints.orderBy(F.col("vec_id").asc_nulls_last(), "ints").limit(entries).collect()
    return np.array([r["ints"] for r in rows], np.int64).reshape(len(rows), parts, -1).transpose(1, 0, 2)


def next_books(ints: DataFrame, books: np.ndarray) -> np.ndarray:
    """One round: every entry becomes the floor of the mean of the parts nearest to it; an unused one stays."""
    parts, entries, width = books.shape

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((parts, entries, width + 1), np.int64)
        for batch in batches:
            for block in _blocks(batch["ints"]):
                for p in range(parts):
                    part = block[:, p * width : (p + 1) * width]
                    index, _ = nearest(part, books[p])
                    np.add.at(total[p, :, :width], index, part)
                    total[p, :, width] += np.bincount(index, minlength=entries)
        p, e = np.nonzero(total[:, :, width])
        if len(p):
            yield pd.DataFrame({"part": p, "entry": e, "sums": list(total[p, e, :width]), "n": total[p, e, width]})

    partial = ints.select("ints").mapInPandas(sums, "part int, entry int, sums array<long>, n long")
    added = partial.select("part", "entry", "n", F.posexplode("sums").alias("at", "value")).groupBy("part", "entry", "at").agg(F.sum("value").alias("value"), F.sum("n").alias("n"))
    out = books.copy()
    for row in added.collect():  # parts * entries * width rows at most
        out[row["part"], row["entry"], row["at"]] = row["value"] // row["n"]
    return out


def fit(ints: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """The codebooks (parts, entries, width) after all rounds."""
    books = first_books(ints, parts, entries)
    for _ in range(rounds):
        books = next_books(ints, books)
    return books


def encode(ints: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id, label, code, error."""
    parts, _, width = books.shape

    @F.pandas_udf("code string, error long")
    def code(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts, errors = [], []
            for block in _blocks(batch):
                found = [nearest(block[:, p * width : (p + 1) * width], books[p]) for p in range(parts)]
                texts += [c.tobytes().hex() for c in np.stack([index for index, _ in found], axis=1).astype(np.uint8)]
                errors.append(sum(distance for _, distance in found))
            yield pd.DataFrame({"code": texts, "error": np.concatenate(errors) if errors else np.zeros(0, np.int64)})

    return ints.select("vec_id", "label", code("ints").alias("c")).select("vec_id", "label", "c.*")


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def decoded(codes: DataFrame, books: np.ndarray, scale: int = SCALE) -> DataFrame:
    """``codes`` with ``approximate``: the vector that each code stands for."""
    tables = [F.array(*[F.array(*[F.lit(x / scale) for x in entry]) for entry in book.tolist()]) for book in books]
    number = lambda p: F.conv(F.substring("code", 2 * p + 1, 2), 16, 10).cast("int") + 1
    return codes.withColumn("approximate", F.concat(*[F.element_at(t, number(p)) for p, t in enumerate(tables)]))


def vector_codes(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """One row for each usable row of ``vectors``: vec_id, code, error, label_error, codebooks_sha256.

    A vector that is null, empty, not to be cut into ``parts`` equal parts, or
    holds a null or a non-finite component is left out, and so is one of another
    length than that of the smallest vec_id's.  ``code`` has two hex digits for each part, ``error`` the squared
    distance in scaled integers, ``label_error`` its sum over the rows of a label
    (null labels are one).  Rows that repeat a vec_id are coded each on its own,
    and a null vec_id is the largest.  With fewer than ``entries`` rows there are
    fewer entries; an empty table gives no rows.  Other columns are ignored.
    """
    if not 1 <= entries <= 256:
        raise ValueError("an index has two hex digits")
    ship(vectors.sparkSession)
    ints = cut(usable(vectors, scale, parts), "integer-vectors")
    smallest = ints.orderBy(F.col("vec_id").asc_nulls_last(), "ints").select(F.size("ints")).first()
    if smallest is None:
        return ints.select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    ints = ints.filter(F.size("ints") == smallest[0])
    books = fit(ints, parts, entries, rounds)
    coded = cut(encode(ints, books), "vector-codes")
    # one row for each label, written, so that adaptive execution can split a label that many rows have
    sums = cut(coded.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error")), "label-errors")
    both = coded.join(sums, F.col("label").eqNullSafe(F.col("_label")))
    return both.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
