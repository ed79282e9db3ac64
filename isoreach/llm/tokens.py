"""Token counts of documents from flat token files without an index.

A file is little-endian 16-bit ids; a document ends at each end-of-document id.
It is read in blocks of a fixed number of ids. In each block the separators
are found in one vectorised search; what lies before the first and after the
last is stitched to the neighbours by a prefix scan over the blocks.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from isoreach.llm.common import map_arrow, map_batches, materialize, shared_dir

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The end-of-document id; the vocabulary has 50,256 ids below it.
EOD = 50_256
#: Ids of a block, and of a file at most.
BLOCK, FILE = 1 << 16, 1 << 22
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_encodings: dict = {}


def encoding(path: str = RANKS):
    """The tokenizer, loaded once in each worker."""
    if path not in _encodings:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encodings[path] = tiktoken.Encoding("flat", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path]


def pack(docs: DataFrame, path: str = RANKS, file: int = FILE, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Tokenise documents into flat files in the shared folder; (file, size) of these, and the order of documents in them (file, ordinal, doc_id).

    A file holds ids and separators only. It has about ``file`` ids; one
    document is never dealt to two. Each attempt of a task writes files of its
    own names, and only those of the one that succeeds are named in the result.
    Null and empty texts have no ids but the separator; repeated ids keep a
    place each.
    """
    idt = docs.schema[id_col].dataType.simpleString()
    folder = f"{shared_dir(docs.sparkSession)}/flat-{uuid.uuid4().hex}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path)
        fs, root = FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        out, name, ordinal, total = None, "", 0, 0

        def rows(ids: pa.Array, ordinals: list[int] | None, size: int | None) -> pa.RecordBatch:
            n = len(ids)
            return pa.RecordBatch.from_arrays([pa.array([name] * n), pa.array([size] * n, pa.int64()), ids, pa.array(ordinals or [None] * n, pa.int64())], ["file", "size", "doc_id", "ordinal"])

        for b in batches:
            texts = b.column(1).to_pylist()
            for i in range(0, len(texts), 128):
                if out is None:
                    name, ordinal, total = f"{uuid.uuid4().hex}.bin", 0, 0
                    out = fs.open_output_stream(f"{root}/{name}")
                part = texts[i : i + 128]
                for t in part:
                    ids = np.array([*(enc.encode_ordinary(t) if t else ()), EOD], "<u2")
                    out.write(ids.tobytes())
                    total += len(ids)
                yield rows(b.column(0).slice(i, len(part)), list(range(ordinal, ordinal + len(part))), None)
                ordinal += len(part)
                if total >= file:
                    out.close()
                    out = None
                    yield rows(pa.nulls(1, b.column(0).type), None, 2 * total)
        if out is not None:
            out.close()
            yield rows(pa.nulls(1, b.column(0).type), None, 2 * total)

    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    out = materialize(map_batches(d, run, f"file string, size long, doc_id {idt}, ordinal long"), "tokens")
    return out.filter("size IS NOT NULL").select(F.concat(F.lit(f"{folder}/"), "file").alias("file"), "size"), out.filter("size IS NULL").select(F.concat(F.lit(f"{folder}/"), "file").alias("file"), "ordinal", "doc_id")


def read_flat(files: DataFrame, block: int = BLOCK) -> DataFrame:
    """(file, block, ids) of flat files (file, size in bytes): each task seeks to its blocks and reads these bytes alone.

    file is an address that pyarrow.fs can open from all executors. A file may
    be of any size; what a task reads doesn't depend on where files end.
    """
    n = files.agg(F.sum("size")).first()[0] or 0
    tasks = max(1, -(-n // (64 * 2 * block)))
    parts = F.sequence(F.lit(0), (F.ceil(F.col("size") / (2 * block)) - 1).cast("int"))
    plan = files.filter("size > 0").select("file", F.explode(parts).alias("block")).repartition(tasks, "file", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p, k in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                fs, at = FileSystem.from_uri(p)
                with fs.open_input_file(at) as f:
                    f.seek(2 * block * k)
                    yield pa.RecordBatch.from_arrays([pa.array([p]), pa.array([k], pa.int32()), pa.array([f.read(2 * block)], pa.binary())], ["file", "block", "ids"])

    return map_batches(plan, run, "file string, block int, ids binary")


def count(blocks: DataFrame, eod: int = EOD) -> DataFrame:
    """(file, ordinal, n_tokens) of each document, without its separator; ids after a file's last separator are a document of their own.

    From each block: where its separators are. The scan over a file's blocks
    (a file is bounded, so are its blocks) says how many documents ended before
    a block and how many ids of an open one stand before it.
    """

    def run(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ends = [np.flatnonzero(np.frombuffer(x, "<u2") == eod) for x in b.column(2).to_pylist()]
        size = [len(x) // 2 for x in b.column(2).to_pylist()]
        head = [int(e[0]) if len(e) else n for e, n in zip(ends, size, strict=True)]
        tail = [n - 1 - int(e[-1]) if len(e) else n for e, n in zip(ends, size, strict=True)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([len(e) for e in ends], pa.int64()), pa.array(head, pa.int64()), pa.array(tail, pa.int64()), pa.array([np.diff(e) - 1 for e in ends], pa.list_(pa.int64()))], ["file", "block", "ends", "head", "tail", "inner"])

    s = map_arrow(blocks.select("file", "block", "ids"), run, "file string, block int, ends long, head long, tail long, inner array<long>")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("file").orderBy("block")
    # blocks without a separator belong to the run that the last one with a separator opened
    s = s.withColumn("done", F.coalesce(F.sum("ends").over(before), F.lit(0)))
    run_of = Window.partitionBy("file", "done").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("last", F.lead("block").over(upto).isNull())
    opened = F.coalesce(F.last(F.when(F.col("ends") > 0, F.col("tail")), ignorenulls=True).over(before), F.lit(0))
    s = s.withColumn("carry", opened + F.coalesce(F.sum(F.when(F.col("ends") == 0, F.col("tail"))).over(run_of), F.lit(0)))
    first = F.when(F.col("ends") > 0, F.array(F.col("carry") + F.col("head"))).otherwise(F.array().cast("array<long>"))
    rest = F.when(F.col("last") & (F.when(F.col("ends") > 0, F.col("tail")).otherwise(F.col("carry") + F.col("tail")) > 0), F.array(F.when(F.col("ends") > 0, F.col("tail")).otherwise(F.col("carry") + F.col("tail")))).otherwise(F.array().cast("array<long>"))
    inner = F.when(F.col("ends") > 0, F.col("inner")).otherwise(F.array().cast("array<long>"))
    return s.select("file", "done", F.posexplode(F.concat(first, inner, rest)).alias("pos", "n_tokens")).select("file", (F.col("done") + F.col("pos")).alias("ordinal"), "n_tokens")


def token_counts(docs: DataFrame, path: str = RANKS, block: int = BLOCK, file: int = FILE) -> DataFrame:
    """(doc_id, n_tokens) of every row: packed into flat files, then counted from these alone; the order of documents gives the ids back. Null and empty texts have 0; repeated rows one count each; a text may be longer than a block or a file."""
    files, order = pack(docs, path, file)
    return order.join(count(read_flat(files, block)), ["file", "ordinal"]).select("doc_id", "n_tokens")
