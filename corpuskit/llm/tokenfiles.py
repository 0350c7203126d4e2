"""Token ids in files of independent zstandard frames with a trailing seek
table.

A file holds one frame per document, in ascending ``doc_id`` order (null
first; equal ids by their text), then a skippable frame with the index (an
Arrow stream: doc_id, n_tokens), then the seek table of the public seekable
format: compressed size, plain size and the low half of XXH64 of the plain
bytes for every frame.  A reader fetches the tail, the index, and only the
frames it wants, and checks each against its checksum.

Files are written by tasks under a temporary name and moved to a name that
depends only on the partition, so a retried task replaces its own file.
Null text: an empty one (only the end id).  No document: no row.
"""

from __future__ import annotations

import functools
import struct

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuskit.llm.common import in_slices, partitions
from corpuskit.llm.encoding import ENCODE_BYTES, encoder
from corpuskit.session import materialize

# Fixed values of the public zstandard seekable format.
SKIPPABLE, SEEK_MAGIC, CHECKSUM_FLAG = 0x184D2A5E, 0x8F92EAB1, 0x80
TAIL = struct.Struct("<IBI")  # frames, descriptor, magic
HEAD = struct.Struct("<II")   # skippable magic, size
READ_BYTES = 4 << 20

MANIFEST = "part int, file string, docs long, tokens long, bytes long"
ENTRY = np.dtype([("packed", "<u4"), ("plain", "<u4"), ("sum", "<u4")])


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _checksum(data: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(data) & 0xFFFFFFFF


def _write(batches, out: str, tokenizer: str, end_id: int, level: int):
    import zstandard

    encode, compress = encoder(tokenizer).encode, zstandard.ZstdCompressor(level=level).compress
    task = TaskContext.get()
    fs, root = _open(out)
    name, draft = f"{root}/part-{task.partitionId():06d}.zst", f"{root}/draft-{task.partitionId():06d}-{task.taskAttemptId()}"
    fs.create_dir(root, recursive=True)
    doc_ids, counts, entries = [], [], []
    sink = None
    for batch in in_slices(batches, "text", ENCODE_BYTES):
        sink = sink or fs.open_output_stream(draft)
        ids, off = encode(batch.column("text"))
        plain = np.insert(ids, off[1:], np.uint32(end_id)).astype("<u4").tobytes()
        ends = ((off + np.arange(len(off))) * 4).tolist()
        for lo, hi in zip(ends, ends[1:]):
            frame = compress(plain[lo:hi])
            sink.write(frame)
            entries.append((len(frame), hi - lo, _checksum(plain[lo:hi])))
        doc_ids.append(batch.column("doc_id"))
        counts.append(np.diff(off) + 1)
    if sink is None:
        return
    index = pa.table({"doc_id": pa.chunked_array(doc_ids), "n_tokens": np.concatenate(counts).astype(np.int64)})
    buffer = pa.BufferOutputStream()
    with pa.ipc.new_stream(buffer, index.schema) as stream:
        stream.write_table(index)
    blob = buffer.getvalue().to_pybytes()
    sink.write(HEAD.pack(SKIPPABLE, len(blob)) + blob)
    entries.append((HEAD.size + len(blob), 0, _checksum(b"")))
    table = np.array(entries, ENTRY).tobytes()
    sink.write(HEAD.pack(SKIPPABLE, len(table) + TAIL.size) + table + TAIL.pack(len(entries), CHECKSUM_FLAG, SEEK_MAGIC))
    size = sink.tell()
    sink.close()
    if fs.get_file_info(name).type.name != "NotFound":
        fs.delete_file(name)
    fs.move(draft, name)
    scheme = out.split("://")[0] + "://" if "://" in out else ""
    host = out[len(scheme):len(out) - len(root)] if scheme and out.endswith(root) else ""
    yield pa.record_batch([pa.array([task.partitionId()], pa.int32()), pa.array([f"{scheme}{host}{name}"]), pa.array([len(entries) - 1]), pa.array([int(index["n_tokens"].to_numpy().sum())]), pa.array([size])],
                          names=["part", "file", "docs", "tokens", "bytes"])


def write_token_files(docs: DataFrame, out: str, tokenizer: str, end_id: int = 2, level: int = 3) -> DataFrame:
    """Write the files under ``out`` (a folder that all executors share) and
    return the manifest: part (ascending with doc_id), file, docs, tokens,
    bytes."""
    spark = docs.sparkSession
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("tie"))
    ordered = keyed.repartitionByRange(partitions(spark), "doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text")
    write = functools.partial(_write, out=out.rstrip("/"), tokenizer=tokenizer, end_id=end_id, level=level)
    return materialize(ordered.mapInArrow(write, MANIFEST), "token-manifest")


def read_index(file) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    """(index, seek table of the documents, frame starts) of an open file."""
    size = file.size()
    frames, descriptor, magic = TAIL.unpack(file.read_at(TAIL.size, size - TAIL.size))
    if magic != SEEK_MAGIC or not descriptor & CHECKSUM_FLAG:
        raise ValueError("no seek table with checksums at the end of the file")
    table = np.frombuffer(file.read_at(frames * ENTRY.itemsize, size - TAIL.size - frames * ENTRY.itemsize), ENTRY)
    starts = np.concatenate([[0], np.cumsum(table["packed"], dtype=np.int64)])
    blob = file.read_at(int(table["packed"][-1]), int(starts[frames - 1]))
    return pa.ipc.open_stream(blob[HEAD.size:]).read_all(), table[:-1], starts[:-1]


def _read(batches, wanted: frozenset | None):
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        for name, base in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist()):
            fs, path = _open(name)
            with fs.open_input_file(path) as file:
                index, table, starts = read_index(file)
                n = index["n_tokens"].to_numpy()
                first = base + np.cumsum(n) - n
                doc_ids = index["doc_id"].combine_chunks()
                pick = np.arange(len(n)) if wanted is None else np.array([k for k, d in enumerate(doc_ids.to_pylist()) if d in wanted], np.int64)
                at = 0
                while at < len(pick):
                    # neighbouring frames are fetched together, up to READ_BYTES
                    upto = at + 1
                    while upto < len(pick) and pick[upto] == pick[upto - 1] + 1 and table["plain"][pick[at]:pick[upto] + 1].sum() <= READ_BYTES:
                        upto += 1
                    lo, hi = int(starts[pick[at]]), int(starts[pick[upto - 1]] + table["packed"][pick[upto - 1]])
                    raw, plain = file.read_at(hi - lo, lo), []
                    for k in pick[at:upto]:
                        begin = int(starts[k]) - lo
                        data = unpack(raw[begin:begin + int(table["packed"][k])], max_output_size=int(table["plain"][k]))
                        if _checksum(data) != table["sum"][k]:
                            raise ValueError(f"checksum of frame {k} of {name} does not match")
                        plain.append(data)
                    rows = pick[at:upto]
                    yield pa.record_batch([doc_ids.take(pa.array(rows)), pa.array(first[rows]), pa.array(n[rows]), pa.array(plain, pa.binary())], names=["doc_id", "start", "n_tokens", "ids"])
                    at = upto


def read_token_files(manifest: DataFrame, doc_ids: list[int] | None = None) -> DataFrame:
    """Documents of the files: doc_id, start (ids of all documents before it),
    n_tokens, ids (little-endian unsigned 32-bit).  With ``doc_ids``, only
    their frames are fetched and decompressed."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    files = manifest.select("file", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("start"))
    files = files.repartition(partitions(manifest.sparkSession), "file")
    read = functools.partial(_read, wanted=None if doc_ids is None else frozenset(doc_ids))
    return files.mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")
