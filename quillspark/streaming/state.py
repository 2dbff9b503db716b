"""The current state of facts kept up as notes are extracted again, and activity windows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..config import STATE_POLARITIES
from ..operators import ledger
from ..operators.fact_sync import _FACT, _beats, _from_history, state_after
from ..shipping import ship
from ..sources.store import Commit, TableStore
from ..storage import cut

_KINDS = {"value_num": "double", "as_of": "long", "confidence": "double"}
FACT = ", ".join(f"{c} {_KINDS.get(c, 'string')}" for c in _FACT)
PREVIOUS = ("value_text", "claim", "as_of", "source_note_id")
#: What is held of a key: the fact that is its state, and what that superseded; times as microseconds.
STATE = FACT + ", " + ", ".join(f"previous_{c} {_KINDS.get(c, 'string')}" for c in PREVIOUS)
FACTS = "array<struct<" + ",".join(f"{c}:{_KINDS.get(c, 'string')}" for c in _FACT) + ">>"
_FIELDS = [f.split()[0] for f in STATE.split(", ")]
#: Notes that may come to a log, beyond as many as were in it, before it is written anew.
SHORT_LOG = 64
OUT = f"state_key string, gone boolean, {STATE}"


#: With a state: how many notes were in the key's log when that was last written, and how many came since.
HELD = f"live int, since int, {STATE}"
#: An entry of a key's log: notes of a batch, and the facts that each now has of the key (none: it no longer speaks of it).
ENTRY = f"said array<struct<note_id:string,facts:{FACTS}>>"
#: Notes in an entry.
ENTRY_NOTES = 256


class KeyState(StatefulProcessor):
    """Folds the notes that touch a key in their order of arrival.

    The owner of a state may replace it by an older fact, so the fold is no
    maximum.  What the notes say is a log beside the state, to which a batch
    appends once for each key: where the owner no longer speaks of the key, the
    best of what the others say takes over.  The log is read only then, or to be
    written anew without what was replaced, when as much came as there was.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", HELD)
        self.log = handle.getListState("log", ENTRY)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        had = self.state.get()
        held = dict(zip(_FIELDS, had[2:], strict=True)) if had else None
        before, now, others = held, {}, None
        for row in sorted(rows, key=lambda r: (r["seq"], r["note_id"])):
            note, facts = row["note_id"], [f for f in (row["best"], row["then"]) if f is not None]
            now[note] = facts
            if facts:
                best = row["own"] or facts[0]
                if held is None or held["source_note_id"] == note or _beats(best, held):
                    held = state_after(best, held)
            elif held is not None and held["source_note_id"] == note:
                if others is None:
                    others = self._logged() if had else {}
                held = _from_history([f for some in (others | now).values() for f in some], held)
        if held is not None:
            live, since = self._append(now, had, others)
            self.state.update((live, since, *(held[c] for c in _FIELDS)))
        elif had:  # no note says anything any more
            self.state.clear()
            self.log.clear()
        if held != before:
            yield Row(state_key=key[0], gone=held is None, **{c: None if held is None else held[c] for c in _FIELDS})

    def _logged(self) -> dict[str, list[Row]]:
        """What each note says, by the newest of its entries."""
        return {note: [Row(*_FACT)(*f) for f in facts] for (said,) in self.log.get() for note, facts in said}

    def _append(self, now: dict[str, list[Row]], had: tuple | None, others: dict[str, list[Row]] | None) -> tuple[int, int]:
        """Log what the notes ``now`` say; gives how many notes were in the log when that was last written, and how many came since."""
        if had and had[1] + len(now) <= had[0] + SHORT_LOG:
            self.log.appendList(self._entries(now))
            return had[0], had[1] + len(now)
        if had and others is None:
            others = self._logged()
        said = {note: facts for note, facts in ((others or {}) | now).items() if facts}
        self.log.put(self._entries(said))
        return len(said), 0

    @staticmethod
    def _entries(said: dict[str, list[Row]]) -> list[tuple]:
        packed = [(note, [tuple(f[c] for c in _FACT) for f in facts]) for note, facts in said.items()]
        return [(packed[i : i + ENTRY_NOTES],) for i in range(0, len(packed), ENTRY_NOTES)]

    def close(self) -> None:
        pass


def telling(facts: Column) -> Column:
    """Of all the facts that a note has of a key, those that a state can be made of: (own, best, then).

    ``best`` is the first by time, polarity, confidence and id, ``then`` the first that
    differs from it in value or time: of any notes' facts together, both of these
    are among those of each.  ``own`` is the first by place instead of by id, null if the same.
    One pass, so a note may have any number of facts.
    """
    rank = lambda f: F.struct(f["as_of"], ledger.winner_rank(f["polarity"]), f["confidence"])
    apart = lambda a, b: ~(a["value_text"].eqNullSafe(b["value_text"]) & a["as_of"].eqNullSafe(b["as_of"]))
    beats = lambda a, b: b.isNull() | (rank(a) > rank(b)) | ((rank(a) == rank(b)) & (a["fact_id"] < b["fact_id"]))

    def merge(told: Column, f: Column) -> Column:
        own, best, then = told["own"], told["best"], told["then"]
        wins, differs = beats(f, best), best.isNotNull() & apart(f, best)
        second = F.when(wins & differs, best).when(~wins & differs & beats(f, then), f).otherwise(then)
        return F.struct(F.when(own.isNull() | (rank(f) > rank(own)), f).otherwise(own).alias("own"), F.when(wins, f).otherwise(best).alias("best"), second.alias("then"))

    none = F.lit(None).cast(FACTS[len("array<") : -1])
    finish = lambda t: F.struct(F.when(t["own"] != t["best"], t["own"]).alias("own"), t["best"].alias("best"), t["then"].alias("then"))
    return F.aggregate(F.coalesce(facts, F.array().cast(FACTS)), F.struct(none.alias("own"), none.alias("best"), none.alias("then")), merge, finish)


def facts_struct(facts: DataFrame) -> DataFrame:
    """``facts`` with ``fact``, the struct that the state is made of; missing columns are null."""
    have = set(facts.columns)
    values = {c: F.unix_micros(F.col(c).cast("timestamp")) if c == "as_of" else F.col(c) if c in have else F.lit(None) for c in _FACT}
    return facts.withColumn("fact", F.struct(*[values[c].cast(_KINDS.get(c, "string")).alias(c) for c in _FACT]))


def note_state(extracts: DataFrame) -> DataFrame:
    """A row for each key that an arriving batch changes: state_key, gone, and the state in typed columns.

    ``extracts`` (a stream): state_key, note_id, seq and facts, all the facts
    that a note now has of the key (none: it no longer speaks of it), in the
    order of ``seq``; at most three of them leave their row.  A batch's rows of one key are held by one task, so the
    size of a batch (``maxFilesPerTrigger``) bounds it.  Needs the RocksDB state
    store (see :func:`with_rocksdb`).
    """
    ship(extracts.sparkSession)
    typed = extracts.select("state_key", F.col("note_id").cast("string").alias("note_id"), F.col("seq").cast("long").alias("seq"), telling(F.col("facts").cast(FACTS)).alias("t"))
    out = typed.select("state_key", "note_id", "seq", "t.*").groupBy("state_key").transformWithState(KeyState(), OUT, "Update", "None")
    times = {c: F.timestamp_micros(c) for c in ("as_of", "previous_as_of")}
    return out.withColumns(times)


def keep_state(store: TableStore, table: str = "current_state") -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that commits the keys that a batch of :func:`note_state` changes; a batch that runs again changes the same."""

    def commit(batch: DataFrame, number: int) -> None:
        changed = cut(batch, "state-batch")
        rows = changed.filter("not gone").withColumnRenamed("fact_id", "source_fact_id")

        def change(c: Commit) -> None:
            have = set(rows.columns)
            schema = c.read(table).schema
            c.change(table, rows.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema]), changed.select("state_key"))
            c.stamp(batch=number)

        store.update(change)

    return commit


def incremental_state(facts: DataFrame) -> DataFrame:
    """The state kept up event by event, those of a batch by their time; each event is all that its note has of its key."""
    one = facts_struct(facts.filter(F.col("polarity").isin(*STATE_POLARITIES)))
    return note_state(one.select("state_key", F.col("source_note_id").alias("note_id"), F.unix_micros(F.col("as_of").cast("timestamp")).alias("seq"), F.array("fact").alias("facts")))


def with_rocksdb(spark) -> None:
    """Have streaming queries of the session that start from now on keep their state in RocksDB."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def activity(events: DataFrame, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Events and their mean value for each window and type; late ones count within ``late``.  (An extension.)"""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    counted = timed.groupBy(F.window("ts", window), "event_type").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"))
    return counted.select(F.col("window.start").alias("start"), "event_type", "n", "mean")
