"""What the importer writes between its passes."""

from __future__ import annotations

from quillspark.sources import exports


def test_import_keeps_each_line_once(spark, monkeypatch):
    """The trimmed text only is written, and the splits' sums are joined without moving lines."""
    written, cut = {}, exports.cut

    def kept(df, label):
        written[label] = df.columns
        return cut(df, label)

    monkeypatch.setattr(exports, "cut", kept)
    rows = [("f", "a", 0, "[1/2/24, 3:04 PM]  one "), ("f", "a", 1, "  more"), ("f", "b", 2, "and more"), ("f", "b", 3, "[1/3/24, 3:04 PM] two")]
    back = exports.parse_export(spark.createDataFrame(rows, "file string, block string, at long, line string"), id_style="position")
    assert sorted((r["note_no"], r["content"]) for r in back.collect()) == [(1, "one\nmore\nand more"), (2, "two")]
    assert "line" not in written["import-lines"]
