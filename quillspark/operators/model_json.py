"""JSON that a model wrote: finding, repairing and normalising it."""

from __future__ import annotations

import json
import re
from itertools import chain

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.coercion import score, trimmed
from ..functions.text import js_trim
from ..shipping import ship

_FENCE = re.compile(r"```(?:json)?\s*(.*?)```", re.S | re.I)
_CLOSE = {"{": "}", "[": "]"}


def _scan(text: str, start: int) -> tuple[int | None, list[str], bool]:
    """Walk from an opening bracket: where its value ends (None if it doesn't), the brackets still open, and whether inside a string."""
    open_, quoted, i = [], False, start
    while i < len(text):
        c = text[i]
        if quoted:
            if c == "\\":
                i += 1
            elif c == '"':
                quoted = False
        elif c == '"':
            quoted = True
        elif c in _CLOSE:
            open_.append(_CLOSE[c])
        elif c in "}]":
            if not open_ or open_.pop() != c:
                return None, [], False
            if not open_:
                return i + 1, [], False
        i += 1
    return None, open_, quoted


def _loads(text: str):
    try:
        return json.loads(text)
    except ValueError:
        return None


def _repaired(text: str) -> str | None:
    """A cut-off value with its string and brackets closed; only for a text that begins with one."""
    if text[:1] not in ("{", "["):
        return None
    end, open_, quoted = _scan(text, 0)
    if end is not None or not open_:
        return None
    return (text + '"' * quoted).rstrip(",: \t\r\n") + "".join(reversed(open_))


def recover(text: str | None) -> str | None:
    """The JSON in a text: the whole, what is fenced, or the first balanced value that parses; else a repaired one; else null.

    A value nested in a cut-off one comes before the repair of the whole.
    """
    if text is None:
        return None
    whole = text.strip()
    given = [whole, *(m.strip() for m in _FENCE.findall(whole))]
    balanced = ((m.start(), _scan(whole, m.start())[0]) for m in re.finditer(r"[{\[]", whole))
    inner = (whole[start:end] for start, end in balanced if end is not None)
    fixed = (r for r in map(_repaired, given) if r is not None)
    return next((c for c in chain(given, inner, fixed) if _loads(c) is not None), None)


@F.pandas_udf(StringType())
def recovered(texts: pd.Series) -> pd.Series:
    return texts.map(recover)


def recover_json(df: DataFrame, column: str) -> DataFrame:
    """Add ``recovered``: the JSON text found, null where there is none."""
    ship(df.sparkSession)
    return df.withColumn("recovered", recovered(F.col(column)))


def loose_object(text: Column) -> Column:
    """From the first ``{`` to the last ``}``, inside a fence if there is one; null if there is none."""
    trimmed_text = js_trim(text)
    fenced = F.regexp_extract(trimmed_text, r"(?is)```(?:json)?\s*(.*?)```", 1)
    found = F.regexp_extract(F.when(fenced != "", fenced).otherwise(trimmed_text), r"(?s)(\{.*\})", 1)
    return F.when(found != "", found)


# --- the explore document, from VARIANT


def _strings(value: Column, path: str, limit: int = 8) -> Column:
    items = F.try_variant_get(value, path, "array<variant>")
    return F.coalesce(F.slice(F.filter(F.transform(items, lambda x: trimmed(x)), lambda x: x.isNotNull()), 1, limit), F.array().cast("array<string>"))


def _field(value: Column, path: str) -> Column:
    return F.try_variant_get(value, path, "variant")


def _existing(value: Column) -> Column:
    items = F.try_variant_get(value, "$.alreadyThought", "array<variant>")
    known = lambda s: F.when(s.isin("already yours", "partially explored", "tested"), s).otherwise(F.lit("already yours"))
    rows = F.transform(
        items,
        lambda x: F.struct(trimmed(x, "$.idea").alias("idea"), known(F.coalesce(trimmed(x, "$.status"), F.lit(""))).alias("status"), trimmed(x, "$.evidence").alias("evidence")),
    )
    return F.slice(F.filter(rows, lambda r: r["idea"].isNotNull() & r["evidence"].isNotNull()), 1, 8)


def _ideas(value: Column, path: str) -> Column:
    items = F.try_variant_get(value, path, "array<variant>")

    def idea(x: Column) -> Column:
        return F.struct(
            trimmed(x, "$.title").alias("title"), trimmed(x, "$.mechanism").alias("mechanism"), trimmed(x, "$.whyNew").alias("why_new"),
            trimmed(x, "$.whyItCouldWorkHere").alias("why_here"), trimmed(x, "$.differsFromYourNotes").alias("differs"),
            _strings(x, "$.risks", 6).alias("risks"),
            score(_field(x, "$.noveltyScore")).alias("novelty"), score(_field(x, "$.fitScore")).alias("fit"),
            score(_field(x, "$.upsideScore")).alias("upside"), score(_field(x, "$.speedScore")).alias("speed"),
            F.struct(
                trimmed(x, "$.experiment.name").alias("name"), _strings(x, "$.experiment.steps", 6).alias("steps"),
                trimmed(x, "$.experiment.successMetric").alias("metric"), trimmed(x, "$.experiment.successSignal").alias("signal"),
            ).alias("experiment"),
        )

    def whole(r: Column) -> Column:
        out = (F.size(r["risks"]) > 0) & (F.size(r["experiment"]["steps"]) > 0)
        for c in ("title", "mechanism", "why_new", "why_here", "differs"):
            out = out & r[c].isNotNull()
        for c in ("name", "metric", "signal"):
            out = out & r["experiment"][c].isNotNull()
        return out

    return F.slice(F.filter(F.transform(items, idea), whole), 1, 6)


def normalise_explore(df: DataFrame, json_column: str, fallback_objective: Column) -> DataFrame:
    """Add ``explore``: the document with defaults, invalid ideas dropped, lists cut, scores held to 1 ... 10."""
    v = F.try_parse_json(F.col(json_column))
    doc = F.struct(
        F.coalesce(trimmed(v, "$.objective"), fallback_objective).alias("objective"),
        F.coalesce(trimmed(v, "$.summary"), F.lit("No summary generated.")).alias("summary"),
        F.struct(*[_strings(v, f"$.realityMap.{a}").alias(b) for a, b in (("currentState", "current_state"), ("constraints", "constraints"), ("alreadyWorking", "already_working"), ("underusedAssets", "underused_assets"))]).alias("reality_map"),
        _strings(v, "$.opportunitySpaces").alias("opportunity_spaces"),
        _existing(v).alias("already_thought"),
        _ideas(v, "$.adjacentIdeas").alias("adjacent_ideas"),
        _ideas(v, "$.newIdeas").alias("new_ideas"),
        _strings(v, "$.questions").alias("questions"),
    )
    return df.withColumn("explore", doc)


def _bullets(title: str, items: Column) -> Column:
    listed = F.array_join(F.transform(items, lambda x: F.concat(F.lit("- "), x)), "\n")
    return F.concat(F.lit(title + "\n"), F.when(F.size(items) > 0, listed).otherwise(F.lit("- None")))


def _idea_blocks(label: str, ideas: Column) -> Column:
    def block(x: Column, i: Column) -> Column:
        scores = F.concat(*[F.concat(F.lit(f"{n} "), x[c].cast("string"), F.lit("/10" + end)) for n, c, end in (("Novelty", "novelty", " | "), ("Fit", "fit", " | "), ("Upside", "upside", " | "), ("Speed", "speed", ""))])
        e = x["experiment"]
        return F.concat_ws(
            "\n",
            F.concat(F.lit(label + " "), (i + 1).cast("string"), F.lit(": "), x["title"]),
            F.concat(F.lit("Mechanism: "), x["mechanism"]),
            F.concat(F.lit("Why new: "), x["why_new"]),
            F.concat(F.lit("Why it could work here: "), x["why_here"]),
            F.concat(F.lit("Differs from notes: "), x["differs"]),
            _bullets("Risks", x["risks"]),
            scores,
            F.concat(F.lit("Experiment: "), e["name"]),
            _bullets("Steps", e["steps"]),
            F.concat(F.lit("Success metric: "), e["metric"]),
            F.concat(F.lit("Success signal: "), e["signal"]),
            F.lit(""),
        )

    return F.when(F.size(ideas) > 0, F.array_join(F.transform(ideas, block), "\n")).otherwise(F.lit("- None\n"))


def explore_text(doc: Column) -> Column:
    """The document as a text report."""
    m, known = doc["reality_map"], doc["already_thought"]
    thought = F.array_join(F.transform(known, lambda x: F.concat(F.lit("- "), x["idea"], F.lit(" ["), x["status"], F.lit("] | "), x["evidence"])), "\n")
    return js_trim(
        F.concat_ws(
            "\n",
            F.concat(F.lit("Objective: "), doc["objective"]), F.lit(""), doc["summary"], F.lit(""),
            _bullets("Current state", m["current_state"]), F.lit(""), _bullets("Constraints", m["constraints"]), F.lit(""),
            _bullets("Already working", m["already_working"]), F.lit(""), _bullets("Underused assets", m["underused_assets"]), F.lit(""),
            _bullets("Opportunity spaces", doc["opportunity_spaces"]), F.lit(""),
            F.lit("Already thought"), F.when(F.size(known) > 0, thought).otherwise(F.lit("- None")), F.lit(""),
            F.lit("Adjacent ideas"), _idea_blocks("Adjacent", doc["adjacent_ideas"]),
            F.lit("Actually new ideas"), _idea_blocks("New", doc["new_ideas"]),
            _bullets("Unlock questions", doc["questions"]),
        )
    )


def message_content(value: Column) -> Column:
    """The text of a message: a string, or the joined texts of its parts."""
    parts = F.try_variant_get(value, "$", "array<variant>")
    text = lambda x: F.when(F.schema_of_variant(F.try_variant_get(x, "$.text", "variant")) == "STRING", F.try_variant_get(x, "$.text", "string")).otherwise(F.lit(""))
    is_text = F.schema_of_variant(value) == "STRING"
    return F.coalesce(F.when(is_text, F.try_variant_get(value, "$", "string")), F.array_join(F.transform(parts, text), ""), F.lit(""))


def candidate_text(payload: Column) -> Column:
    """The joined texts of the first candidate's parts, trimmed; empty where there are none."""
    value = F.try_parse_json(payload)
    parts = F.try_variant_get(value, "$.candidates[0].content.parts", "array<variant>")
    return js_trim(F.coalesce(F.array_join(F.transform(parts, lambda p: F.coalesce(F.try_variant_get(p, "$.text", "string"), F.lit(""))), ""), F.lit("")))


def transcript_text(text: Column, raw_text: Column, segments: Column) -> Column:
    """The first that isn't blank: text, raw text, the joined segments."""
    some = lambda c: F.when(js_trim(c) != "", js_trim(c))
    joined = F.array_join(F.filter(F.transform(segments, lambda s: js_trim(s["text"])), lambda s: s.isNotNull() & (s != "")), " ")
    return F.coalesce(some(text), some(raw_text), some(joined), F.lit(""))


def error_message(payload: Column) -> Column:
    """What an error payload says, by its shape."""
    inner = F.get_json_object(payload, "$.error.message")
    return F.coalesce(inner, F.get_json_object(payload, "$.message"), F.get_json_object(payload, "$.error"), F.substring(payload, 1, 200))


def fold_events(events: DataFrame) -> DataFrame:
    """stream_id, text, thoughts, codes, error: the events of a stream put together in order of seq.

    A stream is one answer, so its events are few.
    """
    ordered = F.array_sort(F.collect_list(F.struct("seq", "type", "content")))
    pick = lambda kind: F.transform(F.filter(ordered, lambda e: e["type"] == kind), lambda e: e["content"])
    return events.groupBy("stream_id").agg(
        F.array_join(pick("text"), "").alias("text"),
        pick("thought").alias("thoughts"),
        pick("code").alias("codes"),
        F.element_at(F.reverse(F.concat(F.array(F.lit(None).cast("string")), pick("error"))), 1).alias("error"),
    )


def split_frames(buffer: Column) -> Column:
    """The data payloads of a server-sent event text, without the end mark."""
    frames = F.transform(F.split(buffer, "\n\n"), lambda f: js_trim(f))
    data = F.filter(frames, lambda f: F.startswith(f, F.lit("data:")))
    payloads = F.transform(data, lambda f: js_trim(F.substring(f, 6, 2**30)))
    return F.filter(payloads, lambda p: (p != "[DONE]") & (p != ""))
