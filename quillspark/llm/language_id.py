"""Language identification by a byte convolutional network, trained in numpy.

Bytes are embedded; filters of several widths slide over a window of fixed
length; their largest responses over the window go to a softmax.  A text is
judged by all its windows, end to end, and gets the language with the largest
mean probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from .textops import chunked

WINDOW = 256
WIDTHS = (2, 3, 4)
#: About so many labelled documents of each language are read to learn from, and so many windows of each.
DOCS_PER_LANGUAGE = 1000
WINDOWS_PER_DOC = 3
UNKNOWN = "und"


@dataclass
class ByteCNN:
    languages: list[str]
    embed: np.ndarray  # 256 x D
    filters: dict[int, np.ndarray]  # width -> width x D x F
    bias: dict[int, np.ndarray]
    out: np.ndarray  # F * widths x languages
    out_bias: np.ndarray

    @classmethod
    def fresh(cls, languages: list[str], widths=WIDTHS, dims: int = 8, n_filters: int = 16, seed: int = 7) -> ByteCNN:
        r = np.random.default_rng(seed)
        draw = lambda *s, by: (r.standard_normal(s) / np.sqrt(by)).astype(np.float32)
        return cls(
            languages,
            draw(256, dims, by=2),
            {w: draw(w, dims, n_filters, by=w * dims) for w in widths},
            {w: np.zeros(n_filters, np.float32) for w in widths},
            draw(n_filters * len(widths), len(languages), by=n_filters * len(widths)),
            np.zeros(len(languages), np.float32),
        )

    def parameters(self) -> list[np.ndarray]:
        return [self.embed, *self.filters.values(), *self.bias.values(), self.out, self.out_bias]

    def responses(self, windows: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """For each width the filters' responses, n x positions x F."""
        for w, filters in self.filters.items():
            found = None
            for j in range(w):
                # embedding and filter as one table of a row for each byte
                part = np.take(self.embed @ filters[j], windows[:, j : WINDOW - w + 1 + j], axis=0)
                if found is None:
                    found = part
                else:
                    found += part
            yield w, found

    def pooled(self, windows: np.ndarray) -> np.ndarray:
        return np.concatenate([np.maximum(r.max(axis=1) + self.bias[w], 0) for w, r in self.responses(windows)], axis=1)

    def probabilities(self, windows: np.ndarray, batch: int = 64) -> np.ndarray:
        parts = [self.pooled(windows[i : i + batch]) for i in range(0, len(windows), batch)]
        return _softmax(np.concatenate(parts) @ self.out + self.out_bias)

    def gradients(self, windows: np.ndarray, labels: np.ndarray) -> list[np.ndarray]:
        """Of the mean cross entropy, in the order of ``parameters``."""
        n = np.arange(len(windows))
        tops, pools = {}, []
        for w, r in self.responses(windows):
            top = r.argmax(axis=1)  # n x F
            pools.append(np.take_along_axis(r, top[:, None], axis=1)[:, 0] + self.bias[w])
            tops[w] = top
        pooled = np.maximum(np.concatenate(pools, axis=1), 0)
        error = _softmax(pooled @ self.out + self.out_bias)
        error[n, labels] -= 1
        error /= len(windows)
        back = (error @ self.out.T) * (pooled > 0)
        d_embed, d_filters, d_bias, at = np.zeros_like(self.embed), [], [], 0
        for w, filters in self.filters.items():
            g = back[:, at : at + filters.shape[2]]
            at += filters.shape[2]
            d_bias.append(g.sum(axis=0))
            d = np.empty_like(filters)
            for j in range(w):
                byte = windows[n[:, None], tops[w] + j]  # n x F
                d[j] = np.einsum("nfd,nf->df", self.embed[byte], g)
                np.add.at(d_embed, byte.ravel(), (g[:, :, None] * filters[j].T[None]).reshape(-1, filters.shape[1]))
            d_filters.append(d)
        return [d_embed, *d_filters, *d_bias, pooled.T @ error, error.sum(axis=0)]


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=1, keepdims=True))
    return x / x.sum(axis=1, keepdims=True)


def windows_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All windows of all texts, the last of each filled up with zero bytes, and the number of windows of each text."""
    counts = np.array([-(-len(t) // WINDOW) for t in texts], np.int64)
    joined = b"".join(t.ljust(int(c) * WINDOW, b"\0") for t, c in zip(texts, counts, strict=True))
    return np.frombuffer(joined, np.uint8).reshape(-1, WINDOW), counts


def train(windows: np.ndarray, labels: np.ndarray, languages: list[str], steps: int = 900, batch: int = 64, rate: float = 0.01, seed: int = 7) -> ByteCNN:
    """Adam on batches that draw every language equally often."""
    model, r = ByteCNN.fresh(languages, seed=seed), np.random.default_rng(seed)
    params = model.parameters()
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    rows = [np.flatnonzero(labels == i) for i in range(len(languages))]
    for step in range(1, steps + 1):
        drawn = r.integers(0, len(languages), batch)
        pick = np.array([rows[i][r.integers(len(rows[i]))] for i in drawn])
        now = rate * min(1, 2 * (1 - step / (steps + 1)))
        for p, g, m, v in zip(params, model.gradients(windows[pick], labels[pick]), first, second, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= (now * m / (1 - 0.9**step) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return model


def held_out(doc_id) -> F.Column:
    """Documents kept from learning: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, docs_per_language: int = DOCS_PER_LANGUAGE, **options) -> ByteCNN | None:
    """Learn from about ``docs_per_language`` labelled documents of each language, picked by a hash of doc_id.

    This bounded sample, ``WINDOWS_PER_DOC`` windows of each document, is all
    that the driver holds.  None if no document is labelled.
    """
    labelled = docs.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (F.length("text") > 0) & ~held_out(F.col("doc_id")))
    counts = {row["lang"]: row["n"] for row in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return None
    share = F.lit(0.0)
    for lang, n in sorted(counts.items()):
        share = F.when(F.col("lang") == lang, min(1.0, docs_per_language / n)).otherwise(share)
    turn = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(11)), F.lit(1 << 20)) / (1 << 20)
    raw = F.col("text").cast("binary")
    spread = F.transform(
        F.sequence(F.lit(0), F.lit(WINDOWS_PER_DOC - 1)),
        lambda i: F.substring(raw, (i * F.greatest(F.lit(0), F.octet_length("text") - WINDOW) / (WINDOWS_PER_DOC - 1)).cast("int") + 1, F.lit(WINDOW)),
    )
    rows = labelled.filter(turn < share).select("doc_id", "lang", F.array_distinct(spread).alias("parts")).collect()
    rows.sort(key=lambda row: (row["doc_id"], row["lang"], [bytes(p) for p in row["parts"]]))
    languages = sorted({row["lang"] for row in rows})
    if not languages:  # very few documents, none of them picked
        return fit(docs, docs_per_language * 1000, **options) if docs_per_language < 10**9 else None
    cuts = [(bytes(p), row["lang"]) for row in rows for p in row["parts"]]
    windows, _ = windows_of([p.ljust(WINDOW, b"\0") for p, _ in cuts])
    return train(windows, np.array([languages.index(lang) for _, lang in cuts]), languages, **options)


def predict(docs: DataFrame, model: ByteCNN | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score; the language is ``und``, with score 0, for texts without a letter and null."""
    ship(docs.sparkSession)

    @F.pandas_udf("lang_pred string, score double")
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = ["" if t is None else t for t in batch]
            raw = [t.encode() if model is not None and any(map(str.isalpha, t)) else b"" for t in texts]
            langs, scores = np.full(len(raw), UNKNOWN, object), np.zeros(len(raw))
            for first, run in chunked(raw):
                windows, counts = windows_of(run)
                some = np.flatnonzero(counts)
                if len(some):
                    starts = (np.cumsum(counts) - counts)[some]
                    means = np.add.reduceat(model.probabilities(windows), starts, axis=0) / counts[some, None]
                    best = means.argmax(axis=1)
                    langs[first + some] = np.array(model.languages, object)[best]
                    scores[first + some] = means[np.arange(len(some)), best]
            yield pd.DataFrame({"lang_pred": langs, "score": np.clip(scores, 0, 1)})

    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), judge("text").alias("_j")).select("doc_id", "held_out", "_j.lang_pred", "_j.score")


def identify(docs: DataFrame, docs_per_language: int = DOCS_PER_LANGUAGE, **options) -> DataFrame:
    """Learn from ``docs`` and judge every row of it: doc_id, held_out, lang_pred, score.

    Only ``text`` enters a prediction.  Repeated rows are judged alike, each on
    its own; a null doc_id is neither held out nor learned from; where nothing
    is labelled all is ``und``; an empty table gives no rows; other columns are
    ignored.
    """
    return predict(docs, fit(docs, docs_per_language, **options))
