"""Token ids in Arrow stream files of fixed-size-list batches.

Documents are dealt out by ranges of their id, so files follow each other in
ascending order; rows of one id, and all rows without an id, are in one file.  Each task writes
one Arrow IPC file: record batches of equal-length sequences
(``fixed_size_list<uint16 or uint32>[L]``) with a bit mask of the same shape,
false on the padding of the last sequence, and the ids and starts of the
documents that begin in each sequence.  Ids are not compressed, so a reader
maps the file and takes any sequence without a copy.  A file is written under
a name of its attempt and then renamed, so a repeated task replaces it whole.

Defined results: a null text counts as empty and has the end id alone; null ids
come first; repeated ids stay rows of their own, ordered by text; an empty
table writes no file; columns beyond id and text are not read.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batch, cut, trim
from .tokens import encoder, text_blocks, with_ends

SEQUENCE, ROWS = 2048, 128
MANIFEST = "part long, file string, n_docs long, n_tokens long"
READ = "part long, doc_id long, local_start long, n_tokens long, ids_crc32 long"


def schema(length: int, wide: bool) -> pa.Schema:
    kind = pa.uint32() if wide else pa.uint16()
    return pa.schema([("input_ids", pa.list_(kind, length)), ("attention_mask", pa.list_(pa.bool_(), length)), ("doc_id", pa.list_(pa.int64())), ("doc_start", pa.list_(pa.int64()))])


class Writer:
    """Sequences of one file, from documents in order."""

    def __init__(self, sink, length: int, wide: bool):
        self.length, self.kind = length, np.uint32 if wide else np.uint16
        self.schema = schema(length, wide)
        self.out = pa.ipc.new_file(sink, self.schema)
        self.ids: list[np.ndarray] = []
        self.docs: list[np.ndarray] = []
        self.nulls: list[np.ndarray] = []
        self.starts: list[np.ndarray] = []
        self.done = self.held = 0

    def add(self, doc_ids: np.ndarray, nulls: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        self.starts.append(self.done + self.held + np.cumsum(sizes) - sizes)
        self.docs.append(doc_ids)
        self.nulls.append(nulls)
        self.ids.append(ids.astype(self.kind, copy=False))
        self.held += len(ids)
        if self.held >= ROWS * self.length:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids, docs, nulls, starts = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (self.ids, self.docs, self.nulls, self.starts))
        nulls = nulls.astype(bool)
        for_now = len(ids) if last else len(ids) // (ROWS * self.length) * ROWS * self.length
        for at in range(0, for_now, ROWS * self.length):
            part = ids[at : min(at + ROWS * self.length, for_now)].astype(self.kind)
            n = len(part)
            rows = -(-n // self.length)
            full = np.zeros(rows * self.length, self.kind)
            full[:n] = part
            lead = self.done + at + np.arange(rows + 1) * self.length
            bounds = np.searchsorted(starts, lead)
            bounds[-1] = np.searchsorted(starts, self.done + at + n) if last and at + n == for_now else bounds[-1]
            own = slice(bounds[0], bounds[-1])
            lists = [pa.ListArray.from_arrays(pa.array(bounds - bounds[0], pa.int32()), x) for x in (pa.array(docs[own], pa.int64(), mask=nulls[own]), pa.array(starts[own], pa.int64()))]
            mask = pa.array(np.arange(rows * self.length) < n)
            self.out.write_batch(pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(pa.array(full), self.length), pa.FixedSizeListArray.from_arrays(mask, self.length), *lists], schema=self.schema))
        self.ids, self.held = [ids[for_now:]], len(ids) - for_now
        self.done += for_now
        kept = starts >= self.done
        self.docs, self.nulls, self.starts = [docs[kept]], [nulls[kept]], [starts[kept]]

    def close(self) -> int:
        self._flush(True)
        self.out.close()
        return self.done


def write_tokens(docs: DataFrame, out_dir: str, tokenizer: str, end_id: int = 0, length: int = SEQUENCE, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Write docs as token files under out_dir (a path or URI that all executors reach) and return the manifest."""

    def run(batches):
        from pyarrow import fs

        writer, n_docs = None, 0
        part = TaskContext.get().partitionId()
        where = out_dir if "://" in out_dir or out_dir.startswith("file:") else "file://" + out_dir
        store, root = fs.FileSystem.from_uri(where)
        name = f"{root}/part-{part:06d}.arrow"
        for b in batches:
            if not b.num_rows:
                continue
            if writer is None:
                encode = encoder(tokenizer)
                store.create_dir(root, recursive=True)
                draft = f"{name}.{uuid.uuid4().hex}"
                sink = store.open_output_stream(draft)
                writer = Writer(sink, length, encode.tokenizer.get_vocab_size() > 1 << 16)
            for rows, col in text_blocks(b):
                known = rows.column(0)
                ids, sizes = encode(col)
                writer.add(known.fill_null(0).to_numpy(zero_copy_only=False), known.is_null().to_numpy(zero_copy_only=False), with_ends(ids, np.cumsum(sizes), end_id), sizes + 1)
            n_docs += b.num_rows
            b = rows = col = known = ids = None  # before the next batch comes
            trim()
        if writer is not None:
            total = writer.close()
            sink.close()
            store.move(draft, name)
            yield batch({"part": [part], "file": [f"{out_dir}/part-{part:06d}.arrow"], "n_docs": [n_docs], "n_tokens": [total]})

    rows = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return cut(rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(run, MANIFEST), "token-files")


def open_tokens(file: str) -> pa.ipc.RecordBatchFileReader:
    """Reader of one token file; local files are mapped, not copied."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(file if "://" in file or file.startswith("file:") else "file://" + file)
    return pa.ipc.open_file(pa.memory_map(path) if isinstance(store, fs.LocalFileSystem) else store.open_input_file(path))


def read_documents(file: str):
    """(doc_id, start, ids as pieces) of each document of a token file, in order; a batch at a time."""
    reader = open_tokens(file)
    at, doc, start, pieces = 0, None, None, []
    for k in range(reader.num_record_batches):
        b = reader.get_batch(k)
        length = b.schema.field(0).type.list_size
        ids = b.column(0).values.to_numpy()
        real = int(b.column(1).values.true_count)
        assert len(ids) == b.num_rows * length
        docs, starts = b.column(2).flatten().to_pylist(), b.column(3).flatten().to_pylist()
        edges = [s - at for s in starts] + [real]
        lead = edges[0] if starts else real
        if start is not None:
            pieces.append(ids[:lead])
        for d, s, i, j in zip(docs, starts, edges, edges[1:]):
            if start is not None:
                yield doc, start, pieces
            doc, start, pieces = d, s, [ids[i:j]]
        at += real
    if start is not None:
        yield doc, start, pieces


def digest(manifest: DataFrame) -> DataFrame:
    """Per document, from the files of a manifest: doc_id, start, n_tokens, ids_crc32."""

    def run(batches):
        for b in batches:
            for part, file in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                rows: list[tuple] = []
                for doc, start, pieces in read_documents(file):
                    crc = 0
                    for p in pieces:
                        crc = zlib.crc32(p.astype("<u4").tobytes(), crc)
                    rows.append((part, doc, start, sum(map(len, pieces)), crc))
                    if len(rows) == 10_000:
                        yield batch(dict(zip(("part", "doc_id", "local_start", "n_tokens", "ids_crc32"), map(list, zip(*rows)))))
                        rows = []
                if rows:
                    yield batch(dict(zip(("part", "doc_id", "local_start", "n_tokens", "ids_crc32"), map(list, zip(*rows)))))

    files = manifest.count()
    # one row a file: the window below sees files, not documents
    before = manifest.select("part", (F.sum("n_tokens").over(Window.orderBy("part")) - F.col("n_tokens")).alias("before"))
    read = manifest.select("part", "file").repartitionByRange(max(1, files), "part").mapInArrow(run, READ)
    return read.join(before, "part").select("doc_id", (F.col("before") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")
