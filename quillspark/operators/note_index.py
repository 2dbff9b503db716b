"""Notes and the incremental maintenance of their index by content hash."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import iso, js_trim, utf16_length
from ..storage import cut


def project_notes(messages: DataFrame, *more: str) -> DataFrame:
    """note_id, content, content_hash, note_ts, content_length (and ``more`` columns) of the notes that aren't blank."""
    content = js_trim(F.col("content"))
    own_id = F.when(js_trim(F.coalesce("id", F.lit(""))) != "", F.col("id"))
    return messages.filter((F.col("type") == "note") & (content != "")).select(
        F.coalesce(own_id, F.sha1(F.concat(iso(F.col("ts")), F.lit(":"), content))).alias("note_id"),
        content.alias("content"),
        F.sha1(content).alias("content_hash"),
        F.col("ts").alias("note_ts"),
        utf16_length(content).alias("content_length"),
        *more,
    )


def embedding_metadata(index: DataFrame) -> DataFrame:
    """Without content, and without rows that have no vector."""
    return index.filter(F.size("embedding") > 0).select("note_id", "content_hash", F.size("embedding").alias("dims"), "label")


def hashes(index: DataFrame) -> DataFrame:
    return index.select("note_id", "content_hash")


def fetch_contents(notes: DataFrame, ids: DataFrame) -> DataFrame:
    """note_id, content of the ids asked for; missing ones are dropped."""
    return notes.join(ids.select("note_id").distinct(), "note_id", "left_semi").select("note_id", "content")


def orphans(index: DataFrame, notes: DataFrame) -> DataFrame:
    return index.select("note_id").join(notes.select("note_id"), "note_id", "left_anti")


def to_index(notes: DataFrame, index: DataFrame) -> DataFrame:
    """Notes that are new or whose hash differs."""
    old = index.select(F.col("note_id").alias("_id"), F.col("content_hash").alias("_old"))
    joined = notes.join(old, F.col("note_id") == F.col("_id"), "left")
    return joined.filter(F.col("_id").isNull() | ~F.col("content_hash").eqNullSafe(F.col("_old"))).drop("_id", "_old")


def diff(notes: DataFrame, index: DataFrame) -> DataFrame:
    """note_id and action (add, update, delete, keep) over both sides."""
    a = notes.select(F.col("note_id").alias("a_id"), F.col("content_hash").alias("a_hash"))
    b = index.select(F.col("note_id").alias("b_id"), F.col("content_hash").alias("b_hash"))
    action = (
        F.when(F.col("b_id").isNull(), "add")
        .when(F.col("a_id").isNull(), "delete")
        .when(F.col("a_hash").eqNullSafe(F.col("b_hash")), "keep")
        .otherwise("update")
    )
    return a.join(b, F.col("a_id") == F.col("b_id"), "full_outer").select(F.coalesce("a_id", "b_id").alias("note_id"), action.alias("action"))


def diff_counts(notes: DataFrame, index: DataFrame) -> DataFrame:
    return diff(notes, index).groupBy("action").agg(F.count(F.lit(1)).alias("n"))


def upsert(table: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of ``new`` replace those of their key."""
    return table.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def delete(table: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return table.join(ids.select(key).distinct(), key, "left_anti")


def fingerprint(notes: DataFrame) -> DataFrame:
    """One row, ``fingerprint``: the same for any order of the same ids and hashes.

    A sum and count of hash parts instead of one text of all entries, so it is
    combined before the shuffle and needs no task that holds all notes.
    """
    entry = F.sha1(F.concat("note_id", F.lit(":"), "content_hash"))
    parts = [F.sum(F.conv(F.substring(entry, 1 + 8 * i, 8), 16, 10).cast("long")).alias(f"s{i}") for i in range(5)]
    sums = notes.agg(F.count(F.lit(1)).alias("n"), *parts)
    text = F.concat_ws("|", F.col("n").cast("string"), *[F.coalesce(F.col(f"s{i}"), F.lit(0)).cast("string") for i in range(5)])
    return sums.select(F.sha1(text).alias("fingerprint"))


def sync_gate(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row, ``needs_sync``: whether the notes' fingerprint changed."""
    a, b = fingerprint(before).withColumnRenamed("fingerprint", "old"), fingerprint(after).withColumnRenamed("fingerprint", "new")
    return a.crossJoin(b).select("old", "new", (F.col("old") != F.col("new")).alias("needs_sync"))


def validated_ids(proposed: DataFrame, candidates: DataFrame, limit: int) -> DataFrame:
    """pos, note_id of a reranked list that are candidates: the first of each, at most ``limit``."""
    first = proposed.join(candidates.select("note_id"), "note_id", "left_semi").groupBy("note_id").agg(F.min("pos").alias("pos"))
    return first.orderBy("pos").limit(limit)


# --- a tree of digests over ranges of ids: which notes differ is found in the ranges that do

#: Children of a node, and levels: FANOUT ** LEVELS leaves.
FANOUT = 16
LEVELS = 2


def with_leaf(notes: DataFrame, levels: int = LEVELS) -> DataFrame:
    """``notes`` with ``leaf``, the range of hashed ids that each falls in."""
    return notes.withColumn("leaf", F.conv(F.substring(F.md5("note_id"), 1, levels), 16, 10).cast("int"))


def tree(notes: DataFrame, levels: int = LEVELS) -> DataFrame:
    """level, node, n, digest of the ranges that have notes; level 0 is the root.

    A leaf's digest is the SHA-1 of its sorted ``id:hash`` joined by ``|``, a
    node's that of its children's ``node:digest``.  So the root says, whatever the
    order of the notes, whether two indexes are equal; with more levels no leaf
    grows beyond what one task can sort.
    """
    entry = F.concat("note_id", F.lit(":"), "content_hash")
    leaves = with_leaf(notes.select("note_id", "content_hash"), levels).groupBy(F.col("leaf").alias("node"))
    now = leaves.agg(F.count(F.lit(1)).alias("n"), F.sha1(F.array_join(F.array_sort(F.collect_list(entry)), "|")).alias("digest"))
    now = cut(now.select(F.lit(levels).alias("level"), "node", "n", "digest"), "leaves")
    out = now
    for level in range(levels - 1, -1, -1):
        child = F.struct("node", F.concat(F.col("node").cast("string"), F.lit(":"), "digest").alias("d"))
        parents = now.groupBy(F.expr(f"node div {FANOUT}").cast("int").alias("_p"))
        now = parents.agg(F.sum("n").alias("n"), F.sha1(F.array_join(F.transform(F.array_sort(F.collect_list(child)), lambda c: c["d"]), "|")).alias("digest"))
        now = now.select(F.lit(level).alias("level"), F.col("_p").alias("node"), "n", "digest")
        out = out.unionByName(now)
    return out


def write_index(notes: DataFrame, path: str, levels: int = LEVELS) -> None:
    """An index (note_id, content_hash) and its tree, stored so that one range can be read without the others."""
    with_leaf(notes.select("note_id", "content_hash"), levels).repartition("leaf").write.partitionBy("leaf").parquet(f"{path}/entries")
    tree(notes, levels).write.parquet(f"{path}/tree")


def differing_leaves(old: DataFrame, new: DataFrame) -> DataFrame:
    """The leaves whose digests differ, from two trees."""
    deepest = old.unionByName(new).agg(F.max("level")).first()[0]
    a, b = (t.filter(F.col("level") == deepest).select(F.col("node").alias(f"{n}_node"), F.col("digest").alias(f"{n}_digest")) for n, t in (("a", old), ("b", new)))
    joined = a.join(b, F.col("a_node") == F.col("b_node"), "full_outer").filter(~F.col("a_digest").eqNullSafe(F.col("b_digest")))
    return joined.select(F.coalesce("a_node", "b_node").alias("leaf"))


def changed_entries(spark: SparkSession, old: str, new: str) -> DataFrame:
    """note_id, action (add, update, delete) between two stored indexes; equal roots are not looked into, equal ranges not read."""
    trees = [spark.read.schema("level int, node int, n long, digest string").parquet(f"{p}/tree") for p in (old, new)]
    roots = [r["digest"] if (r := t.filter("level = 0").first()) else None for t in trees]
    leaves = [] if roots[0] == roots[1] else [r["leaf"] for r in differing_leaves(*trees).collect()]  # at most FANOUT ** LEVELS numbers
    entries = [spark.read.schema("note_id string, content_hash string, leaf int").parquet(f"{p}/entries").filter(F.col("leaf").isin(leaves)) for p in (old, new)]
    return diff(entries[1], entries[0]).filter("action <> 'keep'")
