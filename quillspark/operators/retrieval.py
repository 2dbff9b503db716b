"""Hybrid ranked retrieval: score, top-k, recent coverage, budget packing."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Profile
from ..functions.scoring import combined, density_bonus, is_recent, keyword_score, recency, similarity
from ..functions.text import millis, stamp, utf16_length
from ..storage import cut


def score(notes: DataFrame, index: DataFrame, queries: Sequence[Sequence[float]], now_ms: int, profile: Profile, terms: Sequence[str] = (), style: str | None = None) -> DataFrame:
    """Scores of every indexed note: note_id, note_ts, content_length, similarity, recency, keyword, score.

    With ``style`` also line_length, that of its line in a prompt (null without content).

    The keyword part is 0 unless ``terms`` are given, as index rows carry no
    content.  Only narrow columns are joined; contents come later, for the few
    notes that are picked.
    """
    line = F.when(content_units(notes) > 0, line_length(notes, style)).alias("line_length") if style else None
    narrow = ["note_id", "note_ts", "content_length", *(["content"] if terms else []), *([line] if style else [])]
    scored = notes.select(*narrow).join(index.filter(F.size("embedding") > 0).select("note_id", "embedding"), "note_id")
    parts = scored.select(
        "note_id",
        "note_ts",
        "content_length",
        similarity(F.col("embedding"), queries).alias("similarity"),
        recency(F.col("note_ts"), now_ms, profile).alias("recency"),
        (keyword_score(F.col("content"), terms) if terms else F.lit(0.0)).alias("keyword"),
        density_bonus(F.col("content_length"), profile).alias("bonus"),
        *(["line_length"] if style else []),
    )
    total = combined(F.col("similarity"), F.col("recency"), F.col("keyword"), F.col("bonus"), profile)
    return parts.withColumn("score", total).drop("bonus")


def rank_order() -> list[Column]:
    """Best first; ties by time, newest first, then by id."""
    return [F.col("score").desc(), F.col("note_ts").desc(), F.col("note_id").asc()]


def rank_place() -> list[Column]:
    """The same order as ascending values."""
    return [-F.col("score"), -millis(F.col("note_ts")), F.col("note_id")]


def top_candidates(scored: DataFrame, profile: Profile) -> DataFrame:
    """The best ``candidate_limit``.

    Adding the newest notes and cutting at the limit again gives the same rows,
    so nothing is added (a test shows the two forms equal).
    """
    return scored.orderBy(*rank_order()).limit(profile.candidate_limit)


def union_recent(scored: DataFrame, profile: Profile) -> DataFrame:
    """The literal form: best candidates and newest recent notes, sorted and cut again."""
    best = scored.orderBy(*rank_order()).limit(profile.candidate_limit)
    newest = scored.filter(is_recent(F.col("recency"))).orderBy(F.col("note_ts").desc(), "note_id").limit(profile.guaranteed_recent)
    return best.unionByName(newest).dropDuplicates(["note_id"]).orderBy(*rank_order()).limit(profile.candidate_limit)


def selection(candidates: DataFrame, profile: Profile) -> DataFrame:
    """The best ``selection_limit``; where the profile asks for it and none is recent, the last gives way to the best recent one."""
    w = Window.orderBy(*rank_order())
    ranked = candidates.withColumn("rank", F.row_number().over(w))  # candidates are few by the profile's limit
    if not profile.force_recent:
        return ranked.filter(F.col("rank") <= profile.selection_limit)
    recent = is_recent(F.col("recency"))
    everything = Window.partitionBy()
    first_recent = F.min(F.when(recent, F.col("rank"))).over(everything)
    n = F.least(F.lit(profile.selection_limit), F.count(F.lit(1)).over(everything))
    known = ranked.withColumn("_first", first_recent).withColumn("_n", n)
    swap = F.col("_first") > F.col("_n")
    inside = (F.col("rank") < F.col("_n")) | ((F.col("rank") == F.col("_n")) & ~F.coalesce(swap, F.lit(False)))
    return known.filter(inside | (swap & (F.col("rank") == F.col("_first")))).drop("_first", "_n")


def hydrate(candidates: DataFrame, notes: DataFrame) -> DataFrame:
    """Add the content; notes without any drop out."""
    full = notes.filter(F.col("content") != "").select("note_id", "content")
    return candidates.drop("content_length").join(full, "note_id").withColumn("content_length", utf16_length(F.col("content")))


def prompt_line(style: str, zone: str = "UTC") -> Column:
    return F.concat(F.lit("["), stamp(F.col("note_ts"), style, zone), F.lit("] "), F.col("content"))


def content_units(notes: DataFrame) -> Column:
    """UTF-16 units of a note's content: its column ``content_units``, where the table has one, so that contents need not be moved."""
    return F.col("content_units") if "content_units" in notes.columns else utf16_length(F.col("content"))


def line_length(notes: DataFrame, style: str, zone: str = "UTC") -> Column:
    """The length of :func:`prompt_line`."""
    return utf16_length(F.concat(F.lit("["), stamp(F.col("note_ts"), style, zone), F.lit("] "))) + content_units(notes)


#: "[", a date of eight characters at least, "] ", one character of content and a newline.
SHORTEST_LINE = 13


#: What a packing picks: the note, its turn, the length of its line, and the characters that a cut content keeps (else None).
Pick = tuple[str, int, int, int | None]


def greedy_picks(sized: DataFrame, place: list[Column], budget: int, content_of: Callable[[str], str] | None = None) -> list[Pick]:
    """Fill ``budget`` UTF-16 units with lines in ascending order of ``place``; one that doesn't fit is skipped, not the end.

    ``sized`` has note_id and line_length.  With ``content_of`` a first note
    beyond the whole budget is cut to max(120, budget - 32) units, so there is
    always one.

    Each pass takes the first ``budget / SHORTEST_LINE`` notes in order that
    still fit the space left, as many as could ever be picked, and folds them;
    the next goes on behind them.  So what reaches the driver is bounded by the
    budget, while all notes count.
    """
    picked: list[Pick] = []
    total = 0
    at_most = max(1, budget // SHORTEST_LINE + 1)
    names = [f"_p{i}" for i in range(len(place))]
    rest = sized.select("note_id", "line_length", *[c.alias(n) for c, n in zip(place, names, strict=True)])
    if content_of is not None:
        head = rest.orderBy(*names).limit(1).collect()
        if head and head[0]["line_length"] > budget:
            room = max(120, budget - 32)
            whole = content_of(head[0]["note_id"])
            content = whole.encode("utf-16-le", "surrogatepass")[: 2 * room].decode("utf-16-le", "ignore").rstrip()
            units = lambda text: len(text.encode("utf-16-le", "surrogatepass")) // 2
            length = head[0]["line_length"] - units(whole) + units(content)
            picked.append((head[0]["note_id"], 1, length, len(content)))
            total = length + 2  # with the ellipsis and the newline
            rest = rest.filter(F.col("note_id") != head[0]["note_id"])
    while total < budget:
        rows = rest.filter(F.col("line_length") <= budget - total).orderBy(*names).limit(at_most).collect()
        for row in rows:
            if total < budget and total + row["line_length"] <= budget:
                picked.append((row["note_id"], len(picked) + 1, row["line_length"], None))
                total += row["line_length"] + 1
        if len(rows) < at_most:
            break
        # what was passed over here doesn't fit later either: go on behind the last row
        rest = rest.filter(F.struct(*names) > F.struct(*[F.lit(rows[-1][n]).alias(n) for n in names]))
    return picked


def picked_notes(notes: DataFrame, picked: Sequence[Pick]) -> DataFrame:
    """The rows of ``notes`` that were picked, with pick, line_length and cut_to; at most a budget's worth of lines."""
    chosen = notes.sparkSession.createDataFrame(list(picked), "note_id string, pick int, line_length int, cut_to int")
    # a filter too, as it goes down to where the contents are read: theirs only are moved
    return notes.filter(F.col("note_id").isin([note_id for note_id, *_ in picked])).join(F.broadcast(chosen), "note_id")


def content_of(notes: DataFrame) -> Callable[[str], str]:
    return lambda note_id: notes.filter(F.col("note_id") == note_id).select("content").first()["content"]


def greedy_pack(notes: DataFrame, place: list[Column], budget: int, style: str, truncate_first: bool = True, zone: str = "UTC") -> DataFrame:
    """:func:`greedy_picks` of whole notes; adds pick, line_length and cut_to.

    Lengths and places are narrow rows, written once for all passes.
    """
    names = [f"_o{i}" for i in range(len(place))]
    sized = cut(notes.select("note_id", line_length(notes, style, zone).alias("line_length"), *[c.alias(n) for c, n in zip(place, names, strict=True)]), "sized")
    return picked_notes(notes, greedy_picks(sized, [F.col(n) for n in names], budget, content_of(notes) if truncate_first else None))


def sweep_pack(candidates: DataFrame, budget: int, style: str, zone: str = "UTC") -> DataFrame:
    """Short notes in rank order while each fits what is left, newline included."""
    return greedy_pack(candidates, rank_place(), budget - 1, style, truncate_first=False, zone=zone) if budget > 1 else candidates.limit(0)
