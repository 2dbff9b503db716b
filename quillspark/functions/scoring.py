"""Scores of hybrid retrieval, as column expressions."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import RECENT_BONUS, RECENT_SCORE, STOP_WORDS, Profile
from ..shipping import ship
from ..storage import cut
from .text import millis


def dot(a: Column, b: Column) -> Column:
    """Inner product over the shorter length, in doubles."""
    n = F.least(F.size(a), F.size(b))
    pairs = F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda total, x: total + x)


def vector(values: Sequence[float]) -> Column:
    """A literal vector; one constant, not one expression for each element."""
    return F.split(F.lit(",".join(repr(float(v)) for v in values)), ",").cast("array<double>")


def l2_normalise(v: Column) -> Column:
    """A zero vector stays as it is."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda t, x: t + x.cast("double") * x.cast("double")))
    return F.transform(v, lambda x: F.when(norm == 0, x.cast("double")).otherwise(x.cast("double") / F.when(norm != 0, norm)))


def similarity(embedding: Column, queries: Sequence[Sequence[float]]) -> Column:
    """The largest of the queries' products, none below zero; 0 without queries.

    Queries are constants of the expression, so notes are scored where they are.
    """
    each = [F.greatest(F.lit(0.0), dot(vector(q), embedding)) for q in queries]
    return F.array_max(F.array(*each)) if each else F.lit(0.0)


def recency(ts: Column, now_ms: int, profile: Profile) -> Column:
    """1 / (1 + age / half life), more within the recent window; 0 for no time."""
    days = F.greatest(F.lit(0), F.lit(now_ms) - millis(ts)) / F.lit(86400000.0)
    base = 1 / (1 + days / F.lit(float(profile.half_life_days)))
    boosted = F.when(days <= profile.recent_window_days, F.least(F.lit(1.0), base + RECENT_BONUS)).otherwise(base)
    return F.when(ts.isNotNull(), boosted).otherwise(F.lit(0.0))  # greatest() passes over null


def is_recent(score: Column) -> Column:
    return score > RECENT_SCORE


def density_bonus(length: Column, profile: Profile) -> Column:
    """Short notes cost little: full boost at length 0, none from ``short_max`` on."""
    return F.when((length > 0) & (length < profile.short_max), profile.short_boost * (1 - length / profile.short_max)).otherwise(F.lit(0.0))


def combined(sim: Column, rec: Column, key: Column, bonus: Column, profile: Profile) -> Column:
    return sim * profile.similarity + rec * profile.recency + key * profile.keyword + bonus


def query_terms(text: Column) -> Column:
    """Distinct terms of three or more characters, without stop words."""
    found = F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9][a-z0-9-]{2,})"), 1)
    return F.array_except(F.array_distinct(found), F.array(*map(F.lit, STOP_WORDS)))


def keyword_score(content: Column, terms: Sequence[str]) -> Column:
    """Share of the terms that the content contains; 0 without terms."""
    if not terms:
        return F.lit(0.0)
    low = F.lower(content)
    return sum((F.when(F.contains(low, F.lit(t)), 1).otherwise(0) for t in terms), F.lit(0)) / F.lit(len(terms))


def _blocks(rows: DataFrame, key: str, block: int) -> DataFrame:
    """(``key``s, n, nulls, vs): rows of one task and of equally long vectors, ``block`` at a time; ``vs`` has their numbers one after another.

    ``n`` is the length of each; ``nulls`` the place of a vector's first null, or of its end.
    """
    kind = rows.schema[key].dataType.simpleString()

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(n: int, held: list) -> pa.RecordBatch:
            lists = [pa.array([x], t) for x, t in (([i for i, *_ in held], pa.list_(key_type)), ([at for _, at, _ in held], pa.list_(pa.int32())), (np.concatenate([v for *_, v in held]), pa.list_(pa.float64())))]
            return pa.RecordBatch.from_arrays([lists[0], pa.array([n], pa.int32()), *lists[1:]], names=["keys", "n", "nulls", "vs"])

        open_: dict[int, list] = {}
        key_type = None
        for batch in batches:
            key_type = batch.column(0).type
            for i, vector in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                v = vector.values
                x = np.empty(0) if v is None else v.cast(pa.float64(), safe=False).to_numpy(zero_copy_only=False)
                # a vector that is null is as one whose first number is
                none = -1 if v is None else len(x) if not v.null_count else int(np.flatnonzero(v.is_null().to_numpy(zero_copy_only=False))[0])
                held = open_.setdefault(len(x), [])
                held.append((i, none, x))
                if len(held) == block:
                    yield made(len(x), open_.pop(len(x)))
        for n, held in open_.items():
            yield made(n, held)

    return cut(rows.select(key, "embedding").mapInArrow(gather, f"keys array<{kind}>, n int, nulls array<int>, vs array<double>"), "vector-blocks")


def pair_scores(notes: DataFrame, queries: DataFrame, block: int = 256) -> DataFrame:
    """query_id, note_id, score (at least 0) of every note and query (query_id, embedding); a vector that is null or has a null scores 0.

    Notes and queries meet in blocks of at most ``block`` vectors, so what lies
    between the two is one row for each pair of blocks, and a task holds a few
    of these.  Products are added in the order of the vectors, as ``dot`` does.
    """

    ship(notes.sparkSession)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            get = {c: batch.column(i) for i, c in enumerate(batch.schema.names)}
            for r in range(batch.num_rows):
                notes_, queries_ = get["keys"][r].values, get["q_keys"][r].values
                x, y = (get[p + "vs"][r].values.to_numpy().reshape(len(k), get[p + "n"][r].as_py()) for p, k in (("", notes_), ("q_", queries_)))
                total, n = np.zeros((len(y), len(x))), min(x.shape[1], y.shape[1])
                with np.errstate(all="ignore"):
                    for k in range(n):
                        total += y[:, k, None] * x[None, :, k]
                    score = np.maximum(total, 0.0)
                none = [get[p + "nulls"][r].values.to_numpy() < n for p in ("q_", "")]
                score[none[0][:, None] | none[1][None, :]] = 0.0
                at = np.indices(score.shape)
                yield pa.RecordBatch.from_arrays([queries_.take(pa.array(at[0].ravel())), notes_.take(pa.array(at[1].ravel())), pa.array(score.ravel())], names=["query_id", "note_id", "score"])

    q = _blocks(queries, "query_id", block)
    pairs = _blocks(notes, "note_id", block).hint("shuffle_replicate_nl").crossJoin(q.select(*[F.col(c).alias(f"q_{c}") for c in q.columns]))
    kinds = [df.schema[c].dataType.simpleString() for df, c in ((queries, "query_id"), (notes, "note_id"))]
    return pairs.mapInArrow(products, f"query_id {kinds[0]}, note_id {kinds[1]}, score double")
