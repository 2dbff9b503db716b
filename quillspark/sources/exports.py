"""Reading notes back from exported text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import js_trim
from ..storage import cut

#: A note begins with ``[M/D/YY, H:MM AM] text``; a narrow no-break space may stand before AM.
NOTE_HEAD = r"^\[(\d{1,2}/\d{1,2}/\d{2,4},\s*\d{1,2}:\d{2}[\s\x{202F}]*(?:AM|PM|am|pm))\]\s*(.*)$"
#: Lines of an export that belong to no note.
EXPORT_HEADS = ("===", "Total messages", "Notes found", "Exported")


def read_lines(spark: SparkSession, path: str, folder_is_one: bool = False) -> DataFrame:
    """file, block, at, line: the lines of text files, read in as many splits as they have.

    ``block`` is the split's first byte and ``at`` rises within it, so (block,
    at) is the order of a file's lines.  With ``folder_is_one`` the files are
    parts of one export, in the order of their names: ``file`` is the folder, and
    ``block`` begins with the part's name.
    """
    text = spark.read.option("lineSep", "\n").text(path)
    place = F.lpad(F.col("_metadata.file_block_start").cast("string"), 19, "0")
    name = F.col("_metadata.file_path")
    folder = F.regexp_extract(name, r"^(.*)/[^/]*$", 1)
    file, block = (folder, F.concat_ws("/", F.col("_metadata.file_name"), place)) if folder_is_one else (name, place)
    return text.select(file.alias("file"), block.alias("block"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("line"))


def numbered_notes(rows: DataFrame) -> DataFrame:
    """Add ``note_no`` (heads up to this line) and ``line_no`` (lines before it) to rows (file, block, at, _head, ...).

    Each split counts its own lines and heads; what stands before a split is a
    sum over the splits before it, one narrow row for each.  So a line before
    the first head of its split belongs to the note that is open where the split
    begins, and no file is one row or one window.  Rows without ``block`` are of
    files of one split each, such as texts that are rows: nothing stands before it.
    """
    parts = [c for c in ("file", "block") if c in rows.columns]
    own = Window.partitionBy(*parts).orderBy("at")
    counted = rows.withColumn("_heads", F.sum(F.col("_head").cast("long")).over(own)).withColumn("_line", F.row_number().over(own) - 1)
    if "block" not in parts:
        return counted.withColumnsRenamed({"_heads": "note_no", "_line": "line_no"}).drop("at")
    counted = cut(counted, "import-lines")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    splits = counted.groupBy("file", "block").agg(F.max("_heads").alias("_h"), F.count(F.lit(1)).alias("_l"))
    splits = splits.select("file", "block", F.coalesce(F.sum("_h").over(before), F.lit(0)).alias("_h"), F.coalesce(F.sum("_l").over(before), F.lit(0)).alias("_l"))
    # one narrow row for each split of the files
    placed = counted.join(F.broadcast(cut(splits, "import-splits")), ["file", "block"])
    return placed.withColumn("note_no", F.col("_heads") + F.col("_h")).withColumn("line_no", F.col("_line") + F.col("_l")).drop("_heads", "_line", "_h", "_l", "block", "at")


def _time(stamp: Column) -> Column:
    parts = F.regexp_replace(F.upper(stamp), r"[\s\x{202F}]+", " ")
    year = F.regexp_extract(parts, r"^\d+/\d+/(\d+),", 1)
    full = F.concat(
        F.regexp_extract(parts, r"^(\d+/\d+/)", 1),
        F.when(F.length(year) <= 2, F.concat(F.lit("20"), F.lpad(year, 2, "0"))).otherwise(year),
        F.regexp_extract(parts, r"^\d+/\d+/\d+(,.*)$", 1),
    )
    return F.coalesce(F.try_to_timestamp(full, F.lit("M/d/yyyy, h:mm a")), F.try_to_timestamp(full, F.lit("M/d/yyyy,h:mm a")))


def parse_export(lines: DataFrame, long_dates: bool = False, id_style: str = "content") -> DataFrame:
    """file, note_no, id, content, type, ts of the notes in exported lines (file, block, at, line; no block: see :func:`numbered_notes`).

    A head line begins a note; the lines after it, trimmed and without blank
    ones, go on with it.  Lines that look like the export's own head are left
    out, as are lines before the first note.  ``long_dates``: any line that
    begins with ``[`` and has a ``]`` is a head, with a date such as
    ``Jun 28, 2025, 02:51 PM``, and no line is left out.  ``id_style``:
    "content" (hash of time and first line) or "position".
    """
    text = js_trim(F.col("line"))
    rows = lines.withColumn("_text", text).drop("line").filter(F.col("_text") != "")
    if long_dates:
        is_head = F.startswith(F.col("_text"), F.lit("[")) & F.contains(F.col("_text"), F.lit("]"))
        stamp, body = F.regexp_extract("_text", r"^\[(.*?)\]", 1), F.regexp_extract("_text", r"^\[.*?\](.*)$", 1)
        ts = F.try_to_timestamp(F.regexp_replace(stamp, r"[\x{202F}]", " "), F.lit("MMM d, yyyy, hh:mm a"))
    else:
        heading = F.lit(False)
        for head in EXPORT_HEADS:
            heading = heading | F.startswith(F.col("_text"), F.lit(head))
        rows = rows.filter(~heading)
        is_head = F.col("_text").rlike(NOTE_HEAD)
        stamp, body = F.regexp_extract("_text", NOTE_HEAD, 1), F.regexp_extract("_text", NOTE_HEAD, 2)
        ts = _time(stamp)
    numbered = numbered_notes(rows.withColumn("_head", is_head))
    pieces = numbered.filter("note_no > 0").select(
        "file", "note_no", "line_no", F.when(F.col("_head"), js_trim(body)).otherwise(F.col("_text")).alias("piece"), F.when(F.col("_head"), ts).alias("ts"), "_head"
    )
    notes = pieces.groupBy("file", "note_no").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "piece"))), lambda p: p["piece"]), "\n").alias("content"),
        F.max("ts").alias("ts"),
        F.max(F.when(F.col("_head"), F.col("piece"))).alias("_first"),
    )
    when = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    own = F.concat(F.lit("migrated-"), F.substring(F.sha1(F.concat(F.lit("note:"), when, F.lit(":"), F.col("_first"))), 1, 20))
    ident = own if id_style == "content" else F.concat(F.lit("restored-note-"), (F.col("note_no") - 1).cast("string"))
    return notes.select("file", "note_no", ident.alias("id"), "content", F.lit("note").alias("type"), "ts")
