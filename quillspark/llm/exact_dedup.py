"""Exact deduplication by deterministic block naming (DataFrame functions only).

The normalised text is cut into blocks of a fixed number of bytes.  Distinct
blocks are sorted and numbered; then adjacent names of a document are paired,
distinct pairs are sorted and numbered, and so on until each document is left
with one name.  A name stands for one byte string only, so two documents share
their last (level, name) exactly when their texts are equal.

Hot groups: every numbering first reduces to distinct keys with a map-side
aggregation, and every join back is an inner sort-merge join that adaptive
execution can split, so a block or a document held by a third of all rows never
meets in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, cut, id_key, rows_of

#: Bytes in a block; most documents are one block long.
BLOCK_BYTES = 4096
#: Rows that one row of counts is spread into at once.
COPIES_PER_ROW = 10_000


def _blocks(docs: DataFrame, block_bytes: int, key) -> DataFrame:
    """One row for each block: doc_id, sha (of the whole text), i (position), n (blocks of the document), block, h."""
    text = docs.select("doc_id", ascii_lower(F.coalesce("text", F.lit(""))).alias("_norm"))
    whole = text.select(
        "doc_id",
        F.unhex(F.sha2(F.col("_norm").cast("binary"), 256)).alias("sha"),
        F.col("_norm").cast("binary").alias("_bytes"),
    ).withColumn("n", F.greatest(F.lit(1), F.ceil(F.octet_length("_bytes") / F.lit(block_bytes))).cast("int"))
    cut_up = F.transform(
        F.sequence(F.lit(0), F.col("n") - 1),
        lambda i: F.substring(F.col("_bytes"), i * block_bytes + 1, F.lit(block_bytes)),
    )
    return whole.select("doc_id", "sha", "n", F.posexplode(cut_up).alias("i", "block")).withColumn("h", key(F.col("block")))


def _numbered(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct ``keys``, sorted, each with an integer ``name`` of its own.

    Every distinct key sits in one partition, by hash; there it is sorted, and
    its name is the partition's number in the upper bits and its rank in the
    lower bits, so the names of a run follow from its data.
    """
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).sortWithinPartitions(*keys).withColumn("name", F.monotonically_increasing_id()).drop("_n")


def _name_blocks(docs: DataFrame, block_bytes: int, key) -> DataFrame:
    """Rows (doc_id, sha, n, i, name) for each block.

    Blocks are sorted and numbered whole.  Joining the names back moves only an
    8-byte key ``h`` of each block; blocks whose key is shared by different
    blocks (about none) are joined on the block itself.
    """
    spark = docs.sparkSession
    names = cut(_numbered(_blocks(docs, block_bytes, key).select("h", "block"), ["h", "block"]).select("h", "name"), "block-names")
    # written, so that the join below reads plain exchanges, which adaptive execution can split at a hot key
    by_key = cut(names.groupBy("h").agg(F.min("name").alias("name"), F.count(F.lit(1)).alias("blocks")), "names-by-key")
    rows = _blocks(docs, block_bytes, key)
    out = rows.drop("block").join(by_key.filter("blocks = 1").select("h", "name"), "h").drop("h")
    shared = by_key.filter("blocks > 1").select("h")
    if not shared.isEmpty():
        mixed = rows.join(shared, "h", "left_semi")
        own = cut(_numbered(mixed.select("h", "block"), ["h", "block"]), "mixed-names")
        exact = mixed.join(own, ["h", "block"]).drop("block", "h")
        out = out.unionByName(exact.withColumn("name", -1 - F.col("name")))
    return cut(out, "named-blocks")


def document_names(docs: DataFrame, block_bytes: int = BLOCK_BYTES, key=None) -> DataFrame:
    """(doc_id, sha, level, name, copies); equal (level, name) means equal normalised text.

    Rows of ``docs`` that repeat doc_id and text are one row here, with their number in ``copies``.
    """
    key = key or (lambda block: F.xxhash64(block))
    named = _name_blocks(docs, block_bytes, key).withColumn("copies", F.lit(1).cast("long"))
    level, done = 0, []
    while True:
        done.append(named.filter("n = 1").select("doc_id", "sha", F.lit(level).alias("level"), "name", "copies"))
        left = named.filter("n > 1")
        if left.isEmpty():
            break
        level += 1
        even = F.col("i") % 2 == 0
        pairs = cut(
            left.groupBy("doc_id", "sha", "n", F.expr("i div 2").cast("int").alias("i")).agg(
                F.min(F.when(even, F.col("name"))).alias("a"),
                F.min(F.when(~even, F.col("name"))).alias("b"),
                F.sum(F.when(even, F.col("copies"))).alias("copies"),
            ),
            "pairs",
        ).withColumn("single", F.col("b").isNull()).withColumn("b", F.coalesce("b", F.lit(0)))
        names = cut(_numbered(pairs, ["a", "b", "single"]), "pair-names")
        named = cut(
            pairs.join(names, ["a", "b", "single"]).select("doc_id", "sha", F.ceil(F.col("n") / 2).cast("int").alias("n"), "i", "name", "copies"),
            "named-pairs",
        )
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.groupBy("doc_id", "sha", "level", "name").agg(F.sum("copies").alias("copies"))


def _judged(docs: DataFrame, block_bytes: int, key) -> tuple[DataFrame, DataFrame]:
    """(doc_id, sha, level, name, copies) for each distinct doc_id and text, and (level, name, keep_id, group_size)."""
    names = cut(document_names(docs, block_bytes, key), "document-names")
    return names, cut(names.groupBy("level", "name").agg(F.max("doc_id").alias("keep_id"), F.sum("copies").alias("group_size")), "groups")


def exact_dedup(docs: DataFrame, block_bytes: int = BLOCK_BYTES, key=None) -> DataFrame:
    """One row for each row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; null counts as empty.
    Of equal texts the row with the largest doc_id stays; where rows repeat that
    doc_id and the text, one of them stays, and all of them count.  A null doc_id
    is the smallest.  An empty table gives no rows; other columns are ignored.
    """
    names, groups = _judged(docs, block_bytes, key)

    def rows(some: DataFrame) -> DataFrame:
        return some.join(groups, ["level", "name"]).select("doc_id", "sha", "keep_id", "group_size", "copies", F.lit(0).cast("long").alias("first"))

    every = rows(names.filter(F.col("copies") <= COPIES_PER_ROW))
    many = names.filter(F.col("copies") > COPIES_PER_ROW)
    if not many.isEmpty():
        # runs of a bounded length, dealt out to all tasks
        runs = rows(many).withColumn("first", F.explode(F.expr(f"sequence(0, copies - 1, {COPIES_PER_ROW}L)"))).repartition("doc_id", "sha", "first")
        every = every.unionByName(runs.withColumn("copies", F.least(F.col("copies") - F.col("first"), F.lit(COPIES_PER_ROW).cast("long"))))
    every = every.select("*", F.posexplode(F.array_repeat(F.lit(True), F.col("copies").cast("int"))).alias("_copy", "_"))
    return every.select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("_copy") == 0) & (F.col("first") == 0)).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def keep_exact(docs: DataFrame, block_bytes: int = BLOCK_BYTES, key=None) -> DataFrame:
    """``docs`` without the rows that :func:`exact_dedup` drops; all columns as they were.

    Of rows that repeat the doc_id and the text that stay, the one whose columns
    are the largest as JSON stays.
    """
    names, groups = _judged(docs, block_bytes, key)
    stays = names.join(groups, ["level", "name"]).filter(F.col("doc_id").eqNullSafe(F.col("keep_id")))
    kept = cut(stays.select(id_key(F.col("doc_id")).alias("_id"), F.col("sha").alias("_key"), "copies"), "kept")
    sha = F.unhex(F.sha2(ascii_lower(F.coalesce("text", F.lit(""))).cast("binary"), 256))
    return rows_of(docs, kept, sha)
