"""SimHash near-duplicates by a byte-position inverted index with count filtering.

A fingerprint has eight positional bytes.  Two fingerprints that differ in at
most k bits differ in at most k of them, so they share at least 8 - k: the
guaranteed minimum.  The index posts each distinct fingerprint under (position,
byte); the pairs of a list are tallied for all the positional bytes that they
share, those below the minimum are dropped, and the bit distance of the rest is
verified.

A pair that may miss k positions shares one of any k + 1, so k + 1 positions are
posted.  A list of one positional byte holds a 256th of the corpus; a list with
more than ``HEAVY`` postings is refined by the next k + 1 positions in the same
way, as often as needed.  A pair is formed only in the list of the first
positions that it shares: positions passed over on the way must differ, and at
most k can be.  No list is capped.  A list still heavy when all 8 - k positions
are fixed is joined to the neighbours of its members within k bits of the other
bytes, which is linear in its length.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from .common import cut, heads_of, id_key, text_key
from .components import connected_components

BITS = 64
POSITIONS = 8
MAX_BITS = 2
SHINGLE_WORDS = 3
SEED = 42
#: Postings of a list beyond which it is refined.
HEAVY = 128


def fingerprint(text: bytes, shingle_words: int = SHINGLE_WORDS) -> int:
    """A bit is 1 if it is set in over half of the shingles' hashes (repeats count)."""
    words = text.lower().split()  # on bytes: A-Z only, and the six ASCII white-space characters
    if not words:
        return 0
    if len(words) < shingle_words:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(shingle_words)), strict=False))
    hashes = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), np.uint64)
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 15):  # bounded memory for very long texts
        part = hashes[at : at + (1 << 15)].astype("<u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = 2 * counts > len(hashes)
    return int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, text_key, fp) with ``fp`` the fingerprint as a signed long."""
    ship(docs.sparkSession)

    @F.pandas_udf("long")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            found = np.fromiter((fingerprint(b"" if t is None else bytes(t), shingle_words) for t in batch), np.uint64, len(batch))
            yield pd.Series(found.view(np.int64))

    return docs.select("doc_id", text_key().alias("text_key"), of(F.col("text").cast("binary")).alias("fp"))


def _byte(fp: Column, position: int) -> Column:
    return F.shiftright(fp, 8 * position).bitwiseAND(F.lit(255))


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def _mask(positions) -> int:
    return _signed(sum(255 << (8 * p) for p in positions))


def shared_bytes(a: Column, b: Column) -> Column:
    """The tally: positions at which both have the same byte."""
    return sum((F.when(_byte(a, p) == _byte(b, p), 1).otherwise(0) for p in range(1, POSITIONS)), F.when(_byte(a, 0) == _byte(b, 0), 1).otherwise(0))


def _next_postings(lists: DataFrame, max_bits: int) -> DataFrame:
    """Rows (fp, at, missed, used) posted under one more position each: (fp, at, missed, used, key).

    ``used`` masks the bytes that a list fixes, ``at`` is the position after the
    last of them, ``missed`` the number of positions passed over.
    """
    steps = F.filter(
        F.array(*[F.struct((F.col("at") + s).alias("p"), (F.col("missed") + s).alias("missed")) for s in range(max_bits + 1)]),
        lambda t: (t["p"] < POSITIONS) & (t["missed"] <= max_bits),
    )
    byte_masks = F.array(*[F.lit(_mask([p])) for p in range(POSITIONS)])
    posted = lists.select("fp", "used", F.explode(steps).alias("t"))
    posted = posted.select("fp", (F.col("t.p") + 1).alias("at"), F.col("t.missed").alias("missed"), F.col("used").bitwiseOR(F.element_at(byte_masks, F.col("t.p") + 1)).alias("used"))
    return posted.withColumn("key", F.col("fp").bitwiseAND(F.col("used")))


def _first_list(used: Column, at: Column, differ: Column) -> Column:
    """Whether the pair shares none of the positions that its list passed over."""
    out = F.lit(True)
    for p in range(POSITIONS):
        mask = F.lit(_mask([p]))
        out = out & ((at <= p) | (used.bitwiseAND(mask) != 0) | (differ.bitwiseAND(mask) != 0))
    return out


def tallied(pairs: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """The pairs (a, b) that share the guaranteed minimum of positional bytes."""
    return pairs.withColumn("shared", shared_bytes(F.col("a"), F.col("b"))).filter(F.col("shared") >= POSITIONS - max_bits)


def verified(pairs: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    return pairs.filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits)


def _neighbours(heavy: DataFrame, max_bits: int) -> DataFrame:
    """(a, b, used, at): pairs of the same list within ``max_bits`` bits, by a join with each member's neighbours."""
    rows = []
    for fixed in combinations(range(POSITIONS), POSITIONS - max_bits):
        bits = [b for b in range(BITS) if b // 8 not in fixed]
        rows += [(_mask(fixed), _signed(sum(1 << b for b in some))) for n in range(1, max_bits + 1) for some in combinations(bits, n)]
    # of a size that max_bits alone sets: 3,808 rows for 2 bits
    masks = heavy.sparkSession.createDataFrame(pa.table({"used": [u for u, _ in rows], "m": [m for _, m in rows]}))
    one = heavy.select("fp", "at", "used")
    near = one.join(F.broadcast(masks), "used").select("used", F.col("fp").alias("a"), F.col("fp").bitwiseXOR(F.col("m")).alias("b"))
    return near.filter("a < b").join(one.withColumnRenamed("fp", "b"), ["used", "b"]).select("a", "b", "used", "at")


def links(fps: DataFrame, heavy: int = HEAVY, max_bits: int = MAX_BITS) -> DataFrame:
    """(a, b), a < b: pairs of distinct fingerprints at ``max_bits`` (1 to 3) or fewer differing bits, each once."""
    if not 1 <= max_bits <= 3:
        raise ValueError(f"max_bits is {max_bits}; a member of a heavy list has too many neighbours beyond 3 bits")
    lists = fps.select("fp", F.lit(0).alias("at"), F.lit(0).alias("missed"), F.lit(0).cast("long").alias("used"))
    out = None
    for fixed in range(1, POSITIONS - max_bits + 1):
        posted = cut(_next_postings(lists, max_bits), "postings")
        # written first, so that the join reads plain exchanges, which adaptive execution can split at a hot key
        sizes = cut(posted.groupBy("used", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "list-sizes")
        shared = cut(posted.join(sizes, ["used", "key"]), "lists")
        light = shared.filter(F.col("n") <= heavy)
        pairs = light.select("used", "key", "at", F.col("fp").alias("a")).join(light.select("used", "key", F.col("fp").alias("b")), ["used", "key"]).filter("a < b").select("a", "b", "used", "at")
        lists = shared.filter(F.col("n") > heavy).select("fp", "at", "missed", "used")
        last = lists.isEmpty()
        if not last and fixed == POSITIONS - max_bits:
            pairs = pairs.unionByName(_neighbours(lists, max_bits))
        own = pairs.filter(_first_list(F.col("used"), F.col("at"), F.col("a").bitwiseXOR(F.col("b"))))
        found = verified(tallied(own, max_bits), max_bits).select("a", "b")
        out = found if out is None else out.unionByName(found)
        if last:
            break
    return out


def _components(docs: DataFrame, shingle_words: int, heavy: int, max_bits: int) -> DataFrame:
    """(doc_id, text_key, fp, root): ``root`` is the smallest doc_id (``id_key``) of the row's component."""
    prints = cut(fingerprints(docs, shingle_words), "fingerprints")
    # one node for each distinct fingerprint, named by the smallest document that has it
    nodes = cut(prints.groupBy("fp").agg(F.min(id_key(F.col("doc_id"))).alias("node")), "nodes")
    pairs = links(nodes.select("fp"), heavy, max_bits)
    ids = nodes.select(F.col("fp").alias("_fp"), F.col("node").alias("_node"))
    edges = pairs.join(ids, F.col("a") == F.col("_fp")).select("b", F.col("_node").alias("u")).join(ids, F.col("b") == F.col("_fp")).select("u", F.col("_node").alias("v"))
    roots = connected_components(edges)
    named = cut(nodes.join(roots, "node", "left").select("fp", F.coalesce("root", "node").alias("root")), "named-prints")
    return prints.join(named, "fp")


def near_duplicates(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, heavy: int = HEAVY, max_bits: int = MAX_BITS) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id.

    ``component_id`` is the smallest doc_id reachable over links, itself
    included.  A null or empty text has the fingerprint zero, which links like
    any other.  Rows that repeat a text have one fingerprint and so one
    component; a null doc_id counts as the smallest and comes back as null.  An
    empty table gives no rows; other columns are ignored.
    """
    return _components(docs, shingle_words, heavy, max_bits).select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.when(F.col("root") != -(2**63), F.col("root")).alias("component_id"),
    )


def keep_one_of_each(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, heavy: int = HEAVY, max_bits: int = MAX_BITS) -> DataFrame:
    """``docs`` with one row of each component only, that of the smallest doc_id (see ``heads_of``); all columns as they were."""
    return heads_of(docs, _components(docs, shingle_words, heavy, max_bits))
