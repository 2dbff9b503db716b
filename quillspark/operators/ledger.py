"""The temporal fact ledger: deduplication, latest state with its predecessor, status."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DISPLAY_RANK, EXTRACTOR_VERSION, MAX_ATTEMPTS, MAX_FACTS_PER_NOTE, SAMPLE_LIMIT, STATE_POLARITIES, WINNER_RANK
from ..functions.coercion import finite_or_null, polarity
from ..functions.text import document_id, join_nonempty, or_null

STATE = ("entity", "attribute", "claim", "value_text", "value_num", "polarity", "as_of", "confidence", "source_note_id", "fact_id")


#: Keys that a point read puts into its filter.
POINT_KEYS = 1000
#: Parts in which a note's facts are cut to the number that it keeps.
SALTS = 64


def _rank(ranks: dict[str, int], other: int, polarity: Column | None = None) -> Column:
    out, polarity = F.lit(other), F.col("polarity") if polarity is None else polarity
    for name, rank in ranks.items():
        out = F.when(polarity == name, rank).otherwise(out)
    return out


def winner_rank(polarity: Column | None = None) -> Column:
    return _rank(WINNER_RANK, 0, polarity)


def display_rank() -> Column:
    return _rank(DISPLAY_RANK, 9)


def eligible(facts: DataFrame) -> DataFrame:
    """Facts that can be a state: all but hypotheses."""
    return facts.filter(F.col("polarity").isin(*STATE_POLARITIES))


def is_dirty() -> Column:
    """For a note joined with its index row (``i_`` columns, all null where there is none)."""
    return (
        F.col("i_note_id").isNull()
        | ~F.col("i_content_hash").eqNullSafe(F.col("content_hash"))
        | ~F.col("i_extractor_version").eqNullSafe(F.lit(EXTRACTOR_VERSION))
        | F.coalesce((F.col("i_status") == "failed") & (F.col("i_attempts") < MAX_ATTEMPTS), F.lit(False))
        | F.col("i_status").eqNullSafe(F.lit("pending"))
    )


def with_index(notes: DataFrame, index: DataFrame) -> DataFrame:
    own = index.select(*[F.col(c).alias(f"i_{c}") for c in index.columns])
    return notes.join(own, F.col("note_id") == F.col("i_note_id"), "left").withColumn("dirty", is_dirty())


def dirty_queue(notes: DataFrame, index: DataFrame, n: int) -> DataFrame:
    """The newest ``n`` notes that need extraction (a work list)."""
    return with_index(notes, index).filter("dirty").orderBy(F.col("note_ts").desc(), "note_id").limit(n).select("note_id", "note_ts")


def ledger_status(notes: DataFrame, index: DataFrame) -> DataFrame:
    """Totals, what remains, percent done (half up) and a count for each status: one row."""
    joined = with_index(notes, index)
    count = lambda c: F.count(F.when(c, 1))
    out = joined.agg(
        F.count(F.lit(1)).alias("total"),
        count(F.col("dirty")).alias("remaining"),
        *[count(F.col("i_status") == s).alias(f"n_{s}") for s in ("done", "skipped", "failed", "pending")],
        count(F.col("i_note_id").isNotNull() & ~F.col("i_extractor_version").eqNullSafe(F.lit(EXTRACTOR_VERSION))).alias("stale_version"),
    )
    done = F.greatest(F.lit(0), F.col("total") - F.col("remaining"))
    percent = F.when(F.col("total") == 0, F.lit(100)).otherwise(F.floor(100 * F.try_divide(done, F.col("total")) + 0.5))
    return out.withColumn("processed", done).withColumn("percent", percent.cast("long"))


def dedupe_facts(facts: DataFrame, order: str = "fact_id", per_note: int = MAX_FACTS_PER_NOTE) -> DataFrame:
    """Of a note's equal facts (key, value, polarity, day) the most confident, the first among ties.

    A kept fact stands where the first of its equals stood; a note keeps at most
    ``per_note`` facts, by that position.  Minima and maxima only, before the
    first ``per_note`` of each of a note's ``SALTS`` parts are put in order, and
    then those of the note: however many facts it has, few meet in one task.
    """
    columns = [c for c in facts.columns if c not in ("source_note_id",)]
    key = [F.col("source_note_id"), F.col("state_key"), F.lower("value_text").alias("_value"), F.col("polarity").alias("_polarity"), F.date_format("as_of", "yyyy-MM-dd").alias("_day")]
    best = F.min(F.struct(-F.col("confidence"), F.col(order), F.struct(*[c for c in columns if c != "state_key"]).alias("f")))
    kept = facts.groupBy(*key).agg(best["f"].alias("f"), F.min(order).alias("position"))
    salted = kept.withColumn("_salt", F.pmod(F.xxhash64("position"), F.lit(SALTS)))
    part = Window.partitionBy("source_note_id", "_salt").orderBy("position")
    w = Window.partitionBy("source_note_id").orderBy("position")
    return (
        salted.withColumn("_m", F.row_number().over(part))
        .filter(F.col("_m") <= per_note)
        .withColumn("_n", F.row_number().over(w))
        .filter(F.col("_n") <= per_note)
        .select("source_note_id", "state_key", "position", *[F.col(f"f.{c}").alias(c) for c in columns if c != "state_key"])
    )


def winners(facts: DataFrame) -> DataFrame:
    """The current fact of each state key: newest, then by polarity, confidence, id.

    One aggregate for each key, combined before the shuffle, so that a key with
    very many events costs its task no more than others.
    """
    best = F.max(F.struct("as_of", winner_rank().alias("_rank"), "confidence", _inverted("fact_id").alias("_id"), F.struct(*STATE).alias("f")))
    return eligible(facts).groupBy("state_key").agg(best["f"].alias("f")).select("state_key", *[F.col(f"f.{c}").alias(c) for c in STATE])


def _inverted(hexadecimal: str) -> Column:
    """Hex text whose order is turned round, so that the smallest id is the largest value."""
    return F.translate(F.lower(hexadecimal), "0123456789abcdef", "fedcba9876543210")


def two_best(facts: DataFrame, value: Column, keys: Sequence[str] = ("state_key",)) -> DataFrame:
    """state_key (or other ``keys``), place (1, 2), best: ``value`` of the best fact of a key, and of the best that differs from it in value or time.

    Facts of one value and time are reduced to their best before the shuffle, and
    of what is left each task passes on two rows a key (a limit that Spark puts
    before the window's exchange), so a key with very many events is no burden.
    """
    rank = F.struct("as_of", winner_rank().alias("rank"), "confidence", _inverted("fact_id").alias("id"), value.alias("f"))
    apart = facts.groupBy(*keys, "value_text", F.col("as_of").alias("_time")).agg(F.max(rank).alias("r"))
    order = Window.partitionBy(*keys).orderBy(F.col("r").desc())
    return apart.withColumn("place", F.row_number().over(order)).filter("place <= 2").select(*keys, "place", F.col("r.f").alias("best"))


def current_state(facts: DataFrame) -> DataFrame:
    """State rows with what they supersede: the best fact that differs in value or time."""
    top = two_best(eligible(facts), F.struct(*STATE))
    place = lambda n: F.max(F.when(F.col("place") == n, F.col("best")))
    both = top.groupBy("state_key").agg(place(1).alias("f"), place(2).alias("p"))
    return both.select(
        "state_key", *[F.col(f"f.{c}").alias("source_fact_id" if c == "fact_id" else c) for c in STATE],
        F.col("p.value_text").alias("previous_value_text"), F.col("p.claim").alias("previous_claim"),
        F.col("p.as_of").alias("previous_as_of"), F.col("p.source_note_id").alias("previous_source_note_id"),
    )


def recompute(facts: DataFrame, state: DataFrame, keys: DataFrame) -> DataFrame:
    """The state after the keys in ``keys`` are computed anew; a key without facts goes."""
    touched = keys.select("state_key").distinct()
    return state.join(touched, "state_key", "left_anti").unionByName(current_state(facts.join(touched, "state_key", "left_semi")))


def event_beats_state(event: str, state: str) -> Column:
    """Later time, then polarity, then at least the confidence."""

    def rank(prefix: str) -> Column:
        out = F.lit(0)
        for name, value in WINNER_RANK.items():
            out = F.when(F.col(f"{prefix}polarity") == name, value).otherwise(out)
        return out

    e, s = F.col(f"{event}as_of"), F.col(f"{state}as_of")
    return F.when(e != s, e > s).when(rank(event) != rank(state), rank(event) > rank(state)).otherwise(F.col(f"{event}confidence") >= F.col(f"{state}confidence"))


def replace_facts(facts: DataFrame, new: DataFrame, note_ids: DataFrame) -> DataFrame:
    """Facts of the notes in ``note_ids`` are replaced by ``new``."""
    return facts.join(note_ids.select(F.col("note_id").alias("source_note_id")).distinct(), "source_note_id", "left_anti").unionByName(new)


def touched_keys(facts: DataFrame, new: DataFrame, note_ids: DataFrame) -> DataFrame:
    """State keys of what is deleted and of what is new."""
    gone = facts.join(note_ids.select(F.col("note_id").alias("source_note_id")).distinct(), "source_note_id", "left_semi")
    return gone.select("state_key").union(new.select("state_key")).distinct()


def point_get(table: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """For each distinct value of ``key`` in ``wanted`` the row of ``table``, with ``found``; the others are null.

    A few values reach the reader as a filter, so row groups without them are
    not read; many are joined.
    """
    keys = wanted.select(key).distinct()
    few = keys.limit(POINT_KEYS + 1).collect()
    rows = table.filter(F.col(key).isin([r[0] for r in few])) if len(few) <= POINT_KEYS else table
    held = rows.withColumn("found", F.lit(True)).withColumnRenamed(key, "_key")
    return keys.join(held, F.col(key) == F.col("_key"), "left").drop("_key").withColumn("found", F.coalesce("found", F.lit(False)))


def mapped_facts(rows: DataFrame) -> DataFrame:
    """Stored facts as they are read: a missing claim is put together from entity, attribute, value and unit; blanks become defaults."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    made = join_nonempty([text("entity"), text("attribute"), text("value_text"), text("unit")], " · ")
    return rows.withColumns({
        "claim": F.coalesce(or_null(text("claim")), made), "value_num": finite_or_null(F.col("value_num")), "polarity": polarity(F.col("polarity")),
        "confidence": F.coalesce("confidence", F.lit(0.5)), "as_of": F.coalesce(F.col("as_of").cast("timestamp"), F.timestamp_seconds(F.lit(0))),
    })


def facts_by_key(facts: DataFrame) -> DataFrame:
    return facts.groupBy("state_key").agg(F.count(F.lit(1)).alias("n"), F.min("as_of").alias("first_as_of"), F.max("as_of").alias("last_as_of"))


def state_sample(state: DataFrame, n: float = 40) -> DataFrame:
    """A sample of the state by document id; ``n`` is held between 1 and 100."""
    limit = min(SAMPLE_LIMIT, max(1, int(n // 1)))
    return state.withColumn("document_id", document_id(F.col("state_key"))).orderBy("document_id").limit(limit)


def display_order() -> list[Column]:
    return [display_rank(), F.col("as_of").desc(), F.col("state_key")]


def supersessions(state: DataFrame, n: int = 25) -> DataFrame:
    """State rows that replaced something, newest first (a top-k report)."""
    return state.filter((F.col("previous_value_text") != "") & F.col("previous_as_of").isNotNull()).orderBy(F.col("as_of").desc(), "state_key").limit(n)
