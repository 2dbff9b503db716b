"""The message log and its note index as stored tables: overwrite, post, patch and read.

Both tables change in one commit.  A commit's stamps say when the log was last
updated, how many messages it has and the fingerprint of its notes, so a post is
checked against the number without counting, and the index is left alone where the
notes are as they were.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.store import Commit, Snapshot, TableStore
from ..storage import Scratch, cut
from . import message_log, note_index

#: The tables and the column by which rows of each are replaced.
TABLES = {"messages": "message_key", "note_index": "note_id"}
MESSAGES = "message_key string, id string, content string, type string, ts timestamp, source string, ord long"
INDEX = "note_id string, content_hash string"


@dataclass(frozen=True)
class Saved:
    """What a handler answers."""

    success: bool
    total_messages: int
    retrieval_synced: bool = False
    error: str | None = None


def _typed(messages: DataFrame) -> DataFrame:
    """Messages with their key, in the columns of the table; what is missing is null, and ``ord`` 0."""
    have = set(messages.columns)
    kinds = dict(f.strip().split() for f in MESSAGES.split(","))
    named = messages.withColumns({c: F.lit(0 if c == "ord" else None).cast(kind) for c, kind in kinds.items() if c not in have and c != "message_key"})
    typed = named.withColumns({c: F.col(c).cast(kind) for c, kind in kinds.items() if c != "message_key"})
    return typed.withColumn("message_key", message_log.message_key()).select(*kinds)


def _merged(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    return message_log.upsert_merge(existing.drop("message_key"), incoming.drop("message_key")).withColumn("ord", F.col("first_ord")).select(*[f.split()[0] for f in MESSAGES.split(", ")])


def _stamp(commit: Commit, total: int, clock: str, **more: Any) -> None:
    commit.stamp(last_updated=more.pop("last_updated", None) or clock, total_messages=total, updated_at=clock, **more)


def _index_if_changed(commit: Commit, messages: DataFrame) -> bool:
    """Bring the note index in step, unless the notes' fingerprint is that of the last commit."""
    return _index_of(commit, note_index.project_notes(messages))


def _index_of(commit: Commit, notes: DataFrame) -> bool:
    """The same, of the log's notes (note_id, content_hash)."""
    print_ = note_index.fingerprint(notes).first()["fingerprint"]
    same = print_ == commit.stamps.get("note_index_fingerprint")
    if not same:
        if commit.exists("note_index"):
            index = commit.read("note_index")
            new = cut(note_index.to_index(notes, index).select("note_id", "content_hash"), "to-index")
            commit.change("note_index", new, note_index.orphans(index, notes).unionByName(new.select("note_id")))
        else:
            commit.replace("note_index", notes.select("note_id", "content_hash"))
        commit.stamp(note_index_fingerprint=print_)
    return not same


def overwrite(store: TableStore, messages: DataFrame, clock: str, last_updated: str | None = None) -> Snapshot:
    """The log is ``messages`` and nothing else; the index is not touched."""
    return store.update(lambda c: _stamp(c, c.replace("messages", _typed(messages)), clock, last_updated=last_updated))


def clear(store: TableStore, clock: str) -> Snapshot:
    return overwrite(store, store.spark.createDataFrame([], MESSAGES), clock)


def post(store: TableStore, messages: DataFrame, clock: str, force: bool = False) -> Saved:
    """Merge a whole log into the stored one, or put it in its place with ``force``.

    Without ``force`` one of less than half as many messages is refused.
    """
    out: list[Saved] = []
    posted: list[tuple[DataFrame, int]] = []

    def change(commit: Commit) -> None:
        old = commit.stamps.get("total_messages", 0)
        if force or not commit.exists("messages"):
            # nothing to compare or merge with: what is posted is written as the table, and nowhere else
            total = commit.replace("messages", _typed(messages))
            merged = commit.after("messages")
        else:
            if not posted:
                incoming = cut(_typed(messages), "posted")
                posted.append((incoming, incoming.count()))
            incoming, n = posted[0]
            if old > 0 and n < 0.5 * old:
                raise Refused(f"Save blocked: would reduce messages from {old} to {n}. Use force to override.", old)
            merged = cut(_merged(commit.read("messages"), incoming), "merged")
            total = commit.replace("messages", merged)
        _stamp(commit, total, clock)
        out[:] = [Saved(True, total, _index_if_changed(commit, merged))]

    try:
        store.update(change)
    except Refused as no:
        return Saved(False, no.total, error=str(no))
    return out[0]


class Refused(Exception):
    def __init__(self, text: str, total: int):
        super().__init__(text)
        self.total = total


def patch(store: TableStore, messages: DataFrame, clock: str, mode: str = "append") -> Saved:
    """Append a few messages, or upsert them by key; only these and what they replace are written.

    The index is looked at only where there are notes among them.
    """
    out: list[Saved] = []
    incoming = cut(_typed(messages), "patched")
    seen = incoming.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("type") == "note", 1)).alias("notes")).first()
    if not seen["n"]:
        return Saved(False, store.snapshot().stamps.get("total_messages", 0), error="messages must be a non-empty array")

    def change(commit: Commit) -> None:
        old = commit.stamps.get("total_messages", 0)
        if not commit.exists("messages"):
            commit.replace("messages", store.spark.createDataFrame([], MESSAGES))
            existing = store.spark.createDataFrame([], MESSAGES)
        else:
            existing = commit.read("messages")
        if mode == "upsert":
            replaced = cut(existing.join(incoming.select("message_key").distinct(), "message_key", "left_semi"), "replaced")
            added = cut(_merged(replaced, incoming), "upserted")
            total = old - replaced.count() + commit.upsert("messages", added)
            after = existing.join(incoming.select("message_key").distinct(), "message_key", "left_anti").unionByName(added)
        else:
            total = old + commit.change("messages", incoming)[0]
            after = existing.unionByName(incoming)
        _stamp(commit, total, clock)
        out[:] = [Saved(True, total, _index_if_changed(commit, after) if seen["notes"] else False)]

    store.update(change)
    return out[0]


@dataclass(frozen=True)
class Imported:
    parsed: int
    added: int
    total: int


def import_notes(store: TableStore, notes: DataFrame, clock: str, source: str = "import", read: Callable[[], None] = lambda: None) -> Imported:
    """Add notes that were read back (id, content, type, ts, note_no) to the log.

    Of messages of one type and equal first 200 units one stays, a stored one
    before an imported one, then the first.  The stored log is compared by these
    keys, and only what is new, and what stays of stored messages that are there twice,
    is written.  The note index follows in the same commit, which says what was
    imported and when.  ``read`` is called when ``notes`` is not needed any more.
    """
    out: list[Imported] = []
    scratch = Scratch(store.spark)
    with scratch:
        incoming = cut(_typed(notes.withColumn("source", F.lit(source)).withColumn("ord", F.col("note_no"))), "imported")
    parsed = incoming.count()
    read()

    def change(commit: Commit) -> None:
        if not commit.exists("messages"):
            commit.replace("messages", store.spark.createDataFrame([], MESSAGES))
        existing, of_key = commit.after("messages"), message_log.prefix_key().alias("dedupe_key")
        keyed = existing.select("message_key", of_key)
        doubled = keyed.groupBy("dedupe_key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("dedupe_key")
        # rows are replaced by key, so all of a key are taken up where one is there twice
        drops = cut(keyed.join(doubled, "dedupe_key", "left_semi").select("message_key").distinct(), "import-doubled")
        before = keyed.select("message_key").join(drops, "message_key", "left_semi").count()
        kept = cut(_typed(message_log.prefix_dedupe(existing.join(drops, "message_key", "left_semi").drop("message_key"))), "import-kept")
        fresh = incoming.select("*", of_key).join(keyed.select("dedupe_key").distinct(), "dedupe_key", "left_anti")
        added = _typed(message_log.prefix_dedupe(fresh.drop("message_key", "dedupe_key")))
        total, n_kept = existing.count(), kept.count()
        told = lambda df: note_index.project_notes(df, "message_key").select("message_key", "note_id", "content_hash")
        left = told(existing).join(drops, "message_key", "left_anti")
        n, _ = commit.change("messages", kept.unionByName(added), drops if before else None)
        total += n - before
        _stamp(commit, total, clock, imported_from=source, imported_at=clock)
        _index_of(commit, cut(left.unionByName(told(commit.newest("messages"))).drop("message_key"), "import-notes"))
        out[:] = [Imported(parsed, n - n_kept, total)]

    with scratch:
        store.update(change)
    scratch.clear()
    return out[0]


def load(store: TableStore) -> DataFrame:
    """The log; one that was never written is empty."""
    now = store.snapshot()
    return store.read("messages", now) if "messages" in now.tables else store.spark.createDataFrame([], MESSAGES)


# --- a whole log as one document


def normalise_roots(raw: DataFrame, text: str = "text", keys: Sequence[str] = ()) -> DataFrame:
    """Log documents of unknown shape, as JSON text: ``keys``, messages, n_messages, total_messages, last_updated, corrupt.

    A text that isn't an object, or can't be read, is an empty log (``corrupt``
    says which could not be read).  ``messages`` keeps the entries that are
    objects, in order; another kind of value there counts as none.  A total that
    isn't a number is the number of messages.
    """
    value = F.try_parse_json(F.col(text))
    is_object = F.schema_of_variant(value).startswith("OBJECT")
    at = lambda path, kind: F.try_variant_get(value, path, kind)
    held = F.when(is_object, at("$.messages", "array<variant>"))
    objects = F.filter(held, lambda m: F.coalesce(F.schema_of_variant(m).startswith("OBJECT"), F.lit(False)))
    field = lambda m, c: F.when(F.schema_of_variant(F.try_variant_get(m, f"$.{c}", "variant")) == "STRING", F.try_variant_get(m, f"$.{c}", "string"))
    names = {"id": "id", "content": "content", "type": "type", "timestamp": "ts", "source": "source"}
    messages = F.coalesce(F.transform(objects, lambda m: F.struct(*[field(m, c).alias(as_) for c, as_ in names.items()])), F.array().cast("array<struct<id:string,content:string,type:string,ts:string,source:string>>"))
    total = F.when(is_object & F.schema_of_variant(F.try_variant_get(value, "$.totalMessages", "variant")).rlike("^(BIGINT|DOUBLE|DECIMAL|FLOAT)"), at("$.totalMessages", "double"))
    updated = F.when(is_object & (F.schema_of_variant(F.try_variant_get(value, "$.lastUpdated", "variant")) == "STRING"), at("$.lastUpdated", "string"))
    return raw.select(*keys, messages.alias("messages"), total.alias("_total"), updated.alias("last_updated"), (F.col(text).isNotNull() & value.isNull()).alias("corrupt")).select(
        *keys, "messages", F.size("messages").alias("n_messages"), F.coalesce("_total", F.size("messages").cast("double")).alias("total_messages"), "last_updated", "corrupt"
    )


def read_root(spark: SparkSession, path: str) -> DataFrame:
    """The messages of log documents in files, a whole file each; ``file`` names it."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("text"))
    log = normalise_roots(raw, "text", ["file"])
    return log.select("file", F.posexplode("messages").alias("ord", "m")).select("file", F.col("ord").cast("long").alias("ord"), "m.*")
