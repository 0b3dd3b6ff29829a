"""Token ids in files of independent zstandard frames with a trailing seek table.

A file holds the ids of consecutive documents as one stream of little-endian
unsigned 32-bit integers:

* data frames, each an independent zstandard frame of ``FRAME_BYTES`` of the
  stream (the last one shorter);
* one skippable frame with the document index: compressed arrays of ids, of
  null marks and of token counts, and the checksum of what they decompress to;
* one skippable frame with the seek table of the public seekable format: for
  each frame its compressed size, its size and the low half of its XXH64.

A plain zstandard reader thus sees the ids alone, and a reader of a few
documents decompresses only the frames that their bytes lie in.

Nulls and edge cases: a null text counts as empty and yields the end id alone;
rows with a null or repeated document id are kept, nulls first, equal ids in
input order; an empty table yields no file and no row; other columns are not
read.
"""

import struct
import uuid
import zlib

import numpy as np
import pyarrow.fs
import xxhash
import zstandard
from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerlark.llm.common import arrow_schema, batch, lists
from ledgerlark.llm.tokens import encoder, end_bytes
from ledgerlark.plans import lineage

#: Bytes of ids in a frame.
FRAME_BYTES = 1 << 18
#: Fixed values of the public zstandard seekable format.
INDEX_MAGIC, TABLE_MAGIC, FOOTER_MAGIC = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
CHECKSUMS = 0x80

MANIFEST = "file string, n_docs long, n_tokens long, first_id long, first_row long"
DOCUMENT = "doc_id long, start long, n_tokens long, ids_crc32 long"


def _open(path):
    """The store that holds ``path``: a shared folder or an object store."""
    return pyarrow.fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))


def _checksum(data):
    return xxhash.xxh64_intdigest(data) & 0xFFFFFFFF


class TokenFile:
    """Writes one file: add() takes a document's ids, close() ends the file."""

    def __init__(self, path, level=3):
        store, inner = _open(path)
        self.out = store.open_output_stream(inner, compression=None)
        self.compress = zstandard.ZstdCompressor(level=level).compress
        self.buffer, self.entries = bytearray(), []
        self.keys, self.counts = [], []

    def add(self, key, ids):
        self.keys.append(key)
        self.counts.append(len(ids) // 4)
        self.buffer += ids
        whole = len(self.buffer) // FRAME_BYTES * FRAME_BYTES
        for at in range(0, whole, FRAME_BYTES):
            self._frame(bytes(self.buffer[at : at + FRAME_BYTES]))
        del self.buffer[:whole]

    def _frame(self, data):
        packed = self.compress(data)
        self.out.write(packed)
        self.entries.append((len(packed), len(data), _checksum(data)))

    def close(self):
        if self.buffer:
            self._frame(bytes(self.buffer))
        missing = np.array([key is None for key in self.keys], dtype="u1")
        keys = np.array([0 if key is None else key for key in self.keys], dtype="<i8")
        index = keys.tobytes() + missing.tobytes() + np.array(self.counts, dtype="<u8").tobytes()
        packed = struct.pack("<QI", len(keys), _checksum(index)) + self.compress(index)
        self.out.write(struct.pack("<II", INDEX_MAGIC, len(packed)) + packed)
        self.entries.append((len(packed) + 8, 0, _checksum(b"")))
        table = b"".join(struct.pack("<III", *entry) for entry in self.entries)
        footer = struct.pack("<IBI", len(self.entries), CHECKSUMS, FOOTER_MAGIC)
        self.out.write(struct.pack("<II", TABLE_MAGIC, len(table) + len(footer)) + table + footer)
        self.out.close()


class TokenReader:
    """Reads one file through its seek table."""

    def __init__(self, path):
        store, inner = _open(path)
        self.source = store.open_input_file(inner)
        size = self.source.size()
        count, flags, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != FOOTER_MAGIC or not flags & CHECKSUMS:
            raise ValueError(f"{path}: no seek table with checksums")
        table = self._at(size - 9 - 12 * count, 12 * count)
        self.entries = [struct.unpack_from("<III", table, 12 * k) for k in range(count)]
        self.places = np.concatenate([[0], np.cumsum([entry[0] for entry in self.entries])]).tolist()
        packed = self._at(self.places[-2] + 8, self.entries[-1][0] - 8)
        n, checksum = struct.unpack_from("<QI", packed)
        index = zstandard.ZstdDecompressor().decompress(packed[12:])
        if _checksum(index) != checksum:
            raise ValueError(f"{path}: document index is damaged")
        keys, missing = np.frombuffer(index, "<i8", n), np.frombuffer(index, "u1", n, 8 * n)
        self.keys = [None if gone else int(key) for key, gone in zip(keys, missing)]
        self.counts = np.frombuffer(index, "<u8", n, 9 * n).astype("i8")
        self.starts = np.concatenate([[0], np.cumsum(self.counts)])
        self.held = (None, b"")

    def _at(self, offset, length):
        self.source.seek(offset)
        return self.source.read(length)

    def frame(self, k):
        if self.held[0] != k:
            data = zstandard.ZstdDecompressor().decompress(self._at(self.places[k], self.entries[k][0]))
            if len(data) != self.entries[k][1] or _checksum(data) != self.entries[k][2]:
                raise ValueError(f"frame {k} is damaged")
            self.held = (k, data)
        return self.held[1]

    def pieces(self, k):
        """The bytes of document number k, frame by frame."""
        at, stop = 4 * int(self.starts[k]), 4 * int(self.starts[k + 1])
        while at < stop:
            number = at // FRAME_BYTES
            upto = min(stop, (number + 1) * FRAME_BYTES)
            yield self.frame(number)[at - number * FRAME_BYTES : upto - number * FRAME_BYTES]
            at = upto

    def document(self, key):
        """The ids of the first document with this id."""
        return np.frombuffer(b"".join(self.pieces(self.keys.index(key))), "<u4")


def write_tokens(docs, folder, vocabulary, end_id=1):
    """Encode ``docs`` (doc_id, text) into files below ``folder`` in ascending
    doc_id order; returns the manifest, one row a file. Files of lost attempts
    are not in the manifest. Rows with one doc_id spread over range partitions."""
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce("text", F.lit("")).alias("text"),
        F.monotonically_increasing_id().alias("row"),
    )

    def write(batches):
        encode, end, out, first = encoder(vocabulary).ids, end_bytes(end_id), None, None
        for records in batches:
            for key, text, row in zip(*lists(records, "doc_id", "text", "row")):
                if out is None:
                    path = f"{folder}/{uuid.uuid4().hex}.ids.zst"
                    store, inner = _open(path)
                    store.create_dir(inner.rpartition("/")[0], recursive=True)
                    out, first = TokenFile(path), (key, row)
                out.add(key, encode(text) + end)
        if out is not None:
            out.close()
            yield batch(arrow_schema(MANIFEST), [path], [len(out.keys)], [sum(out.counts)], [first[0]], [first[1]])

    ordered = rows.repartitionByRange("doc_id", "row").sortWithinPartitions("doc_id", "row")
    return lineage.cut(ordered.mapInArrow(write, MANIFEST), "manifest")


def read_tokens(manifest):
    """One row a document, from the files: doc_id, start, n_tokens, ids_crc32.
    Only the manifest, one row a file, is ordered as a whole."""
    before = Window.orderBy(F.col("first_id").asc_nulls_first(), "first_row").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.withColumn("before", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    tasks = 4 * manifest.sparkSession.sparkContext.defaultParallelism

    def read(batches):
        for records in batches:
            for path, start in zip(*lists(records, "file", "before")):
                reader, crcs = TokenReader(path), []
                for k in range(len(reader.keys)):
                    crc = 0
                    for piece in reader.pieces(k):
                        crc = zlib.crc32(piece, crc)
                    crcs.append(crc)
                yield batch(arrow_schema(DOCUMENT), reader.keys, reader.starts[:-1] + start, reader.counts, crcs)

    return placed.select("file", "before").repartition(tasks).mapInArrow(read, DOCUMENT)


def read_documents(manifest, wanted):
    """The ids of the documents in ``wanted`` (doc_id), decompressing their frames alone.
    ``wanted`` is a request list that fits a task; each file is asked for it."""
    asked = {row[0] for row in wanted.select(F.col("doc_id").cast("long")).distinct().collect()}
    result = "doc_id long, ids array<long>"

    def read(batches):
        for records in batches:
            for path in lists(records, "file")[0]:
                reader = TokenReader(path)
                found = [k for k, key in enumerate(reader.keys) if key in asked]
                ids = [np.frombuffer(b"".join(reader.pieces(k)), "<u4").astype("i8") for k in found]
                yield batch(arrow_schema(result), [reader.keys[k] for k in found], ids)

    return manifest.select("file").mapInArrow(read, result)
