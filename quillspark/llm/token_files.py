"""Token-id files: independent zstandard frames with a trailing seek table.

A file is a run of zstandard frames, one for each document, then two skippable
frames, so any zstandard reader can decompress it whole:

* the document index (skippable magic 0x184D2A50): for each document its doc_id
  and number of ids, as little-endian 64-bit integers, after one byte for the
  ids' width in the frames (2 or 4) and seven of zero;
* the seek table of the public zstandard seekable format (skippable magic
  0x184D2A5E): for each frame its compressed and decompressed size and the lower
  32 bits of the XXH64 of its decompressed bytes, then the number of frames, a
  descriptor with the checksum bit set, and the magic 0x8F92EAB1.

A reader finds both tables from the end of the file, and then reads and
decompresses only the frames of the documents it is asked for.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow.fs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ..shipping import ship
from .common import cut, id_key, new_path, shuffle_width
from .tokens import encoder, vocabulary

# Fixed values of the zstandard seekable format.
SEEK_FRAME_MAGIC = 0x184D2A5E
SEEK_MAGIC = 0x8F92EAB1
CHECKSUM_FLAG = 0x80
INDEX_FRAME_MAGIC = 0x184D2A50

END_ID = 0
LEVEL = 1


def open_store(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system and path of a uri or a plain path."""
    return pyarrow.fs.FileSystem.from_uri(uri) if ":" in uri.split("/")[0] else (pyarrow.fs.LocalFileSystem(), uri)


class FileWriter:
    """Writes documents' ids, one frame each; ``close`` adds the tables."""

    def __init__(self, out, width: int, level: int = LEVEL):
        self.out, self.width = out, width
        self.compressor = zstandard.ZstdCompressor(level=level, write_checksum=False, write_content_size=True)
        self.seek = array("I")
        self.index = array("q")

    def add(self, doc_id: int, ids: np.ndarray) -> None:
        if ids.dtype.itemsize > self.width and len(ids) and int(ids.max()) >= 1 << 8 * self.width:
            raise ValueError(f"token id {ids.max()} does not fit in {self.width} bytes")
        raw = ids.astype(f"<u{self.width}", copy=False).tobytes()
        frame = self.compressor.compress(raw)
        self.out.write(frame)
        self.seek.extend((len(frame), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self.index.extend((doc_id, len(ids)))

    def close(self) -> None:
        index = struct.pack("<B7x", self.width) + np.frombuffer(self.index, np.int64).astype("<i8").tobytes()
        self.out.write(struct.pack("<II", INDEX_FRAME_MAGIC, len(index)) + index)
        table = np.frombuffer(self.seek, np.uint32).astype("<u4").tobytes() + struct.pack("<IBI", len(self.seek) // 3, CHECKSUM_FLAG, SEEK_MAGIC)
        self.out.write(struct.pack("<II", SEEK_FRAME_MAGIC, len(table)) + table)


@dataclass
class FileReader:
    """Reads the tables of a file, then any of its documents."""

    source: pyarrow.NativeFile

    def __post_init__(self):
        size = self.source.size()
        n, flags, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEK_MAGIC or flags != CHECKSUM_FLAG:
            raise ValueError("not a token-id file: no seek table at its end")
        table = size - 9 - 12 * n - 8
        self.frames = np.frombuffer(self._at(table + 8, 12 * n), "<u4").reshape(n, 3)
        head = table - 16 * n - 16
        (kind, length) = struct.unpack("<II", self._at(head, 8))
        if kind != INDEX_FRAME_MAGIC or length != 16 * n + 8:
            raise ValueError("not a token-id file: no document index")
        self.width = self._at(head + 8, 1)[0]
        self.index = np.frombuffer(self._at(head + 16, 16 * n), "<i8").reshape(n, 2)
        self.decompressor = zstandard.ZstdDecompressor()
        self.places = np.concatenate([[0], np.cumsum(self.frames[:, 0], dtype=np.int64)])

    def _at(self, place: int, size: int) -> bytes:
        self.source.seek(place)
        return self.source.read(size)

    def ids(self, i: int) -> np.ndarray:
        """The ids of the file's document ``i``; its frame is checked."""
        size, raw_size, check = map(int, self.frames[i])
        raw = self.decompressor.decompress(self._at(int(self.places[i]), size), max_output_size=raw_size)
        if len(raw) != raw_size or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != check:
            raise ValueError(f"frame {i} is damaged")
        return np.frombuffer(raw, f"<u{self.width}")

    def find(self, doc_ids: Iterable[int]) -> dict[int, np.ndarray]:
        """The ids of the documents asked for, if here; only their frames are read."""
        wanted = set(doc_ids)
        return {int(d): self.ids(i) for i, d in enumerate(self.index[:, 0].tolist()) if d in wanted}


def id_width(tokenizer: str, end_id: int = END_ID) -> int:
    """Bytes that hold every id of a tokenizers file, and the end id: 2 or 4."""
    return 2 if max(Tokenizer.from_file(tokenizer).get_vocab_size() - 1, end_id) < 1 << 16 else 4


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, spaces: str, end_id: int = END_ID, width: int | None = None) -> DataFrame:
    """Write all documents in ascending doc_id order; gives the manifest (part, path, n_docs, n_tokens).

    Ranges of doc_id are sorted and written by a task each, ``part`` in order.
    A file gets a name of its own for each attempt, and only the manifest, which
    is written after, says which count: a lost or repeated task leaves at most a
    file that nothing reads.  Ids are as wide (``width``) as the tokenizer's
    largest needs.  ``folder`` may be any store that pyarrow opens.
    """
    spark = docs.sparkSession
    ship(spark)
    width = width or id_width(tokenizer, end_id)

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc, part = encoder(tokenizer, spaces, width), TaskContext.get().partitionId()
        fs, place = open_store(folder)
        fs.create_dir(place, recursive=True)
        path = f"{place}/part-{part:06d}-{uuid.uuid4().hex}.tok.zst"
        n_docs = n_tokens = 0
        end = np.array([end_id], f"<u{width}")
        with fs.open_output_stream(path, compression=None) as out:
            writer = FileWriter(out, width)
            for batch in batches:
                for doc, ids in zip(batch["_id"].tolist(), enc.encode(batch["text"]), strict=True):
                    writer.add(doc, np.append(ids, end))
                    n_docs, n_tokens = n_docs + 1, n_tokens + len(ids) + 1
            writer.close()
        if n_docs:
            yield pd.DataFrame({"part": [part], "path": [path.rsplit("/", 1)[1]], "n_docs": [n_docs], "n_tokens": [n_tokens]})
        else:
            fs.delete_file(path)

    rows = docs.select(id_key(F.col("doc_id")).alias("_id"), F.coalesce("text", F.lit("")).alias("text"))
    order = ["_id", F.xxhash64("text")]  # the hash splits many rows of one id
    ranged = rows.repartitionByRange(shuffle_width(spark), *order).sortWithinPartitions(*order)
    return cut(ranged.mapInPandas(write, "part int, path string, n_docs long, n_tokens long"), "manifest")


def read_token_files(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 of every document in the files."""
    ship(spark)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, place = open_store(folder)
        for batch in batches:
            for path, first in zip(batch["path"], batch["first"], strict=True):
                with fs.open_input_file(f"{place}/{path}") as source:
                    file = FileReader(source)
                    crcs = [zlib.crc32(file.ids(i).astype("<u4")) for i in range(len(file.index))]
                    sizes = file.index[:, 1]
                    yield pd.DataFrame({"_id": file.index[:, 0], "start": first + np.cumsum(sizes) - sizes, "n_tokens": sizes, "ids_crc32": crcs})

    # one small row for each file: what stands before it
    files = manifest.select("part", "path", "n_tokens").orderBy("part").toPandas()
    files["first"] = files["n_tokens"].cumsum() - files["n_tokens"]
    if files.empty:
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    listed = spark.createDataFrame(files[["path", "first"]], "path string, first long").repartition(len(files))
    found = listed.mapInPandas(read, "_id long, start long, n_tokens long, ids_crc32 long")
    return found.select(F.when(F.col("_id") != -(2**63), F.col("_id")).alias("doc_id"), "start", "n_tokens", "ids_crc32")


def token_files(docs: DataFrame, folder: str | None = None, tokenizer: str | None = None, spaces: str = "keep", end_id: int = END_ID) -> DataFrame:
    """Write the ids of every document to files and read them back.

    doc_id, start, n_tokens (with the end id), ids_crc32.  A null or empty text
    is the end id alone.  Rows that repeat a doc_id are written each, in the
    order of a hash of their texts; a null doc_id comes first and comes back as
    null.  An empty table gives no files and no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    folder = folder or new_path(spark, "token-files")
    manifest = write_token_files(docs, folder, tokenizer or vocabulary("byte_bpe_50k.json"), spaces, end_id)
    return read_token_files(spark, folder, manifest)
