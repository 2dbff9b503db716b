"""Vectors of texts: batches for a provider, and a default that needs none."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache
from hashlib import md5

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import EMBEDDING_BATCH, EMBEDDING_CHARS, EMBEDDING_DIMENSIONS, EMBEDDING_MODEL
from ..functions.text import js_trim, utf16_prefix
from ..shipping import ship

#: Tasks in which a title belongs to the text.
TITLED = "RETRIEVAL_DOCUMENT"


def model_name(name: Column, fallback: str = EMBEDDING_MODEL) -> Column:
    """The name with its ``models/`` before it."""
    candidate = js_trim(F.coalesce(name, F.lit(fallback)))
    return F.when(candidate.startswith("models/"), candidate).otherwise(F.concat(F.lit("models/"), candidate))


def dimensions(value: Column, fallback: int = EMBEDDING_DIMENSIONS) -> Column:
    """A positive finite number, else the default."""
    number = js_trim(value).try_cast("double")
    return F.when((number > 0) & (number != float("inf")) & ~F.isnan(number), number).otherwise(F.lit(float(fallback)))


def _tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def default_vectors(inputs: DataFrame, key: str = "id", size: int = EMBEDDING_DIMENSIONS, task: str = TITLED) -> DataFrame:
    """``key``, embedding: signed feature hashing of a text's tokens, of unit length.

    ``inputs``: ``key`` (unique), text and perhaps title.  Of a text the first
    28,000 UTF-16 units count, which bounds a text's tokens.  A token's md5 says
    where it adds 1 or -1.  A text without tokens has a vector of zeros.  A row
    is a vector where it is; nothing is shuffled.
    """
    ship(inputs.sparkSession)
    text = utf16_prefix(F.coalesce("text", F.lit("")), EMBEDDING_CHARS)
    if task == TITLED and "title" in inputs.columns:
        text = F.concat_ws(" ", "title", text)

    @F.pandas_udf("array<double>")
    def vector(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        @lru_cache(1 << 16)
        def adds(token: str) -> tuple[int, int]:
            digest = md5(token.encode()).hexdigest()
            return int(digest[:8], 16) % size, 1 if int(digest[8], 16) % 2 == 0 else -1

        def of(tokens) -> np.ndarray:
            sums = np.zeros(size)
            # equal tokens of a text are counted before they are hashed
            for token, n in Counter(tokens).items():
                place, sign = adds(token)
                sums[place] += sign * n
            norm = np.sqrt(np.dot(sums, sums))
            return sums / norm if norm > 0 else sums

        for series in batches:
            yield pd.Series([of(tokens) for tokens in series], dtype=object)

    return inputs.select(key, vector(_tokens(text)).alias("embedding"))


def provider_vectors(inputs: DataFrame, provider: Callable[[list[str]], list[list[float]]], key: str = "id", batch: int = EMBEDDING_BATCH) -> DataFrame:
    """``key``, embedding (of unit length), error: texts sent to a provider, ``batch`` at a time.

    A batch that fails, or is answered with another number of vectors or an empty
    one, is rows with the error and no vector, so that they can be sent again.
    """
    ship(inputs.sparkSession)

    def answers(texts: list[str]) -> list[tuple[list[float] | None, str | None]]:
        try:
            got = provider(texts)
            if len(got) != len(texts):
                raise ValueError(f"{len(got)} embeddings for {len(texts)} inputs")
            if not all(len(v) for v in got):
                raise ValueError("no embedding values")
        except Exception as error:  # a row's fate, not the job's
            return [(None, str(error)[:500])] * len(texts)
        out = []
        for v in got:
            norm = sum(x * x for x in v) ** 0.5
            out.append(([float(x) / norm for x in v] if norm else [float(x) for x in v], None))
        return out

    @F.pandas_udf("embedding array<double>, error string")
    def call(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for series in batches:
            texts, rows = series.tolist(), []
            for at in range(0, len(texts), batch):
                rows += answers(texts[at : at + batch])
            yield pd.DataFrame(rows, columns=["embedding", "error"])

    text = utf16_prefix(F.coalesce("text", F.lit("")), EMBEDDING_CHARS)
    return inputs.select(key, call(text).alias("a")).select(key, "a.*")
