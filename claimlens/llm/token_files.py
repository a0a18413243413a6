"""Token ids in files of independent zstandard frames with a trailing seek table.

A file is: frames, each an independent zstandard frame of little-endian unsigned
token ids (4 bytes each) of whole documents; a skippable frame with the document
index (doc_id, frame, first id in the frame, number of ids); and a seek table as
the public zstandard seekable format has it (compressed size, decompressed size
and the low 32 bits of XXH64 of every frame, number of frames, a flag byte for
checksums, magic). Any zstandard decoder reads the whole file as one stream of
ids; a reader of some documents fetches the table and the index from the end and
decompresses only the frames it needs.

Documents are range-partitioned by doc_id, sorted, and written by the tasks
through pyarrow.fs to the shared folder, under a name of the attempt first, then
moved into place, so a repeated or speculative attempt replaces equal bytes.

Defined cases: null text is an empty one, of which only the end id is written; a
document longer than a frame is a frame of its own;
null doc_id sorts first; repeated rows are each written, in the order of their
text's digest; an empty table gives no files and an empty result.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimlens.llm.batches import pieces
from claimlens.llm.units import UnitEncoder, id_bytes, id_type, rank_bytes, tokenizer
from claimlens.session import new_path

#: Ids after which a frame ends, and the zstandard level.
FRAME_IDS, LEVEL = 1 << 16, 3
#: Bytes of text for a token file; the driver holds one row for each file.
FILE_BYTES = 512 << 20
#: Fixed values of the format: magics of the skippable frames of index and table, of the footer, and the flag for checksums.
INDEX, TABLE, FOOTER, CHECKED = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1, 0x80
#: White space other than spaces and line ends.
_ODD = re.compile(r"[^\S \n]")
_INDEX = np.dtype([("doc_id", "<i8"), ("known", "u1"), ("frame", "<u4"), ("first", "<u4"), ("n", "<u4")])
_FRAME = np.dtype([("packed", "<u4"), ("size", "<u4"), ("check", "<u4")])


def _check(data: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(data) & 0xFFFFFFFF


def open_store(uri: str):
    """File system and path of a URI; plain paths are local."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


class Writer:
    def __init__(self, sink):
        import zstandard

        self.sink, self.packer = sink, zstandard.ZstdCompressor(level=LEVEL, write_content_size=True)
        self.frames, self.index, self.held, self.n = [], [], [], 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.index.append((doc_id or 0, doc_id is not None, len(self.frames), self.n, len(ids)))
        self.held.append(ids)
        self.n += len(ids)
        if self.n >= FRAME_IDS:
            self.flush()

    def flush(self) -> None:
        if self.held:
            data = np.concatenate(self.held).astype("<u4").tobytes()
            packed = self.packer.compress(data)
            self.sink.write(packed)
            self.frames.append((len(packed), len(data), _check(data)))
            self.held, self.n = [], 0

    def close(self) -> None:
        self.flush()
        index = np.array(self.index, _INDEX).tobytes()
        table = np.array(self.frames, _FRAME).tobytes() + struct.pack("<IBI", len(self.frames), CHECKED, FOOTER)
        for magic, part in ((INDEX, index), (TABLE, table)):
            self.sink.write(struct.pack("<II", magic, len(part)) + part)


class Reader:
    """Reads the index at once, and frames as documents ask for them."""

    def __init__(self, source, size: int):
        import zstandard

        self.source, self.unpacker = source, zstandard.ZstdDecompressor()
        n_frames, flags, magic = struct.unpack("<IBI", self.at(size - 9, 9))
        if magic != FOOTER or flags != CHECKED:
            raise ValueError("no seek table at the end")
        table = n_frames * _FRAME.itemsize
        self.frames = np.frombuffer(self.at(size - 9 - table, table), _FRAME)
        self.starts = np.concatenate([[0], np.cumsum(self.frames["packed"], dtype=np.int64)])
        at = int(self.starts[-1])
        magic, index = struct.unpack("<II", self.at(at, 8))
        if magic != INDEX:
            raise ValueError("no index of documents")
        self.index = np.frombuffer(self.at(at + 8, index), _INDEX)
        self.last: tuple = (None, None)

    def at(self, offset: int, n: int) -> bytes:
        self.source.seek(offset)
        return self.source.read(n)

    def frame(self, i: int) -> np.ndarray:
        if self.last[0] != i:
            f = self.frames[i]
            data = self.unpacker.decompress(self.at(int(self.starts[i]), int(f["packed"])), max_output_size=int(f["size"]))
            if len(data) != f["size"] or _check(data) != f["check"]:
                raise ValueError(f"frame {i} is damaged")
            self.last = (i, np.frombuffer(data, "<u4"))
        return self.last[1]

    def documents(self, wanted=None) -> Iterator[tuple[int | None, np.ndarray]]:
        """(doc_id, ids) of all documents or of those wanted, in the file's order."""
        for row in self.index:
            doc_id = int(row["doc_id"]) if row["known"] else None
            if wanted is None or doc_id in wanted:
                yield doc_id, self.frame(int(row["frame"]))[int(row["first"]) : int(row["first"]) + int(row["n"])]


class ByteEncoder:
    """ids by units: white space always begins a pre-token of a byte-level vocabulary.

    In texts whose white space is single spaces and single line ends, a word stands
    for a space and the word, and a word after a line end carries it; the first word,
    and all of other texts, are cut out as they are (white space with the text after it).
    """

    def __init__(self, path: str):
        import regex

        encode = rank_bytes(path) or id_bytes(path)
        self.plain = UnitEncoder(lambda us: encode([u if u[0] == "\n" else " " + u for u in us]))
        self.other = UnitEncoder(encode, kept=100_000)
        self.cut, self.kind = regex.compile(r"\s*\S+|\s+"), id_type(path)

    def ids(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, self.kind)
        us = text.replace("\n", " \n").split(" ")
        if "" not in us and "\n" not in us and us[0][0] != "\n" and not _ODD.search(text):
            got = self.other.values(us[:1]) + self.plain.values(us[1:])
        else:
            got = self.other.values(self.cut.findall(text))
        return np.frombuffer(b"".join(got), self.kind)


_ENCODERS: dict[str, ByteEncoder] = {}


def byte_encoder(path: str) -> ByteEncoder:
    if path not in _ENCODERS:
        tokenizer(path)
        _ENCODERS[path] = ByteEncoder(path)
    return _ENCODERS[path]


def _write(path: str, folder: str, end_id: int | None):
    def write(batches):
        from pyspark import TaskContext

        part, writer, sink = TaskContext.get().partitionId(), None, None
        enc, total, docs = byte_encoder(path), 0, 0
        store, root = open_store(folder)
        name = f"{root}/part-{part:06d}"
        attempt = f"{name}.{uuid.uuid4().hex}.attempt"
        tail = np.array([] if end_id is None else [end_id], "<u4")
        for b in pieces(batches):
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if writer is None:
                    store.create_dir(root, recursive=True)
                    sink = store.open_output_stream(attempt)
                    writer = Writer(sink)
                ids = np.concatenate([enc.ids(text or "").astype("<u4"), tail])
                writer.add(doc_id, ids)
                total, docs = total + len(ids), docs + 1
        if writer is not None:
            writer.close()
            sink.close()
            store.move(attempt, name)
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "file": [f"{folder}/part-{part:06d}"], "n_docs": pa.array([docs], pa.int64()), "n_ids": pa.array([total], pa.int64())})

    return write


def files_for(docs: DataFrame, file_bytes: int = FILE_BYTES) -> int:
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // file_bytes))


def write_tokens(docs: DataFrame, path: str, folder: str, end_id: int | None = None, files: int | None = None) -> list:
    """Writes docs (doc_id, text) as token files in ascending doc_id order; gives a row for each file.

    By default there is a file for each FILE_BYTES of text, but no fewer than the session has shuffle partitions.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    n = files or files_for(docs)
    order = ["doc_id", "_tie"]
    ranged = docs.withColumn("_tie", F.xxhash64("text")).repartitionByRange(n, *order).sortWithinPartitions(*order)
    rows = ranged.select("doc_id", "text").mapInArrow(_write(path, folder, end_id), "part int, file string, n_docs long, n_ids long")
    return sorted(rows.collect())  # one row for each file


def _read(batches):
    for b in batches:
        for file, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            store, name = open_store(file)
            out = []
            with store.open_input_file(name) as source:
                for doc_id, ids in Reader(source, source.size()).documents():
                    out.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
                    start += len(ids)
                    if len(out) >= 10_000:
                        yield _rows(out)
                        out = []
            yield _rows(out)


def _rows(out: list) -> pa.RecordBatch:
    columns = list(zip(*out)) or [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read_tokens(spark, files: list) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document of the files, a task for each file."""
    rows, start = [], 0
    for f in files:
        rows.append((f["file"], start))
        start += f["n_ids"]
    names = spark.createDataFrame(rows, "file string, start long").repartition(max(1, len(rows)))
    return names.mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op7_token_files(docs: DataFrame, path: str, end_id: int | None = 2) -> DataFrame:
    """Writes every row of docs (doc_id, text) as token files in the shared folder and reads them back."""
    spark = docs.sparkSession
    return read_tokens(spark, write_tokens(docs, path, new_path(spark, "tokens"), end_id))
