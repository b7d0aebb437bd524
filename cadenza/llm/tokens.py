"""Token counts by a separator scan of flat token files.

A flat file is token identifiers of WIDTH bytes and nothing else; an end-of-document
identifier closes each document. The scan reads blocks of a file, wherever they begin,
finds the separators of a block in one vectorised search and gives back the lengths
between them. What a document has in several blocks is stitched by a prefix scan over
the blocks of its file: separators so far number the documents, and tokens since the last
separator are carried into the next.
"""

from __future__ import annotations

import base64
import importlib.util
import os
import uuid
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadenza.llm.store import keep, shared_folder

#: Identifiers fit two bytes; the ranks file leaves END free.
WIDTH, DTYPE, END = 2, np.dtype("<u2"), 50256
RANKS = "byte_bpe_multi_50k.tiktoken"
BLOCK_BYTES = 4 << 20
#: Blocks of a task, and most tasks; beyond them tasks get more blocks.
BLOCKS_PER_TASK, TASKS = 8, 20_000
FILE_BYTES = 128 << 20


def tokenizer_path(name: str = RANKS) -> str:
    """A vocabulary file: in the folder that TOKENIZERS names, else of the installed package."""
    folder = os.environ.get("TOKENIZERS") or os.path.dirname(importlib.util.find_spec("public_tokenizers").origin)
    return f"{folder}/{name}"


@cache
def encoder(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(os.path.basename(path), pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def write_flat(documents: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(file, ordinal, doc_id): flat files of the tokens of the texts, null as empty, and which document is which."""
    path = path or tokenizer_path()
    kind = documents.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode_ordinary
        name, stream, size, ordinal = "", None, 0, 0
        for batch in batches:
            files, ordinals = [], []
            for text in batch.column(1):
                if stream is None:
                    name, size, ordinal = f"{folder}/{uuid.uuid4().hex}.bin", 0, 0
                    system, at = fs.FileSystem.from_uri(name)
                    system.create_dir(at.rpartition("/")[0], recursive=True)
                    stream = system.open_output_stream(at)
                data = np.array([*encode(text.as_py() or ""), END], DTYPE).tobytes()
                stream.write(data)
                files.append(name)
                ordinals.append(ordinal)
                size, ordinal = size + len(data), ordinal + 1
                if size >= FILE_BYTES:
                    stream.close()
                    stream = None
            yield pa.RecordBatch.from_arrays([pa.array(files, pa.string()), pa.array(ordinals, pa.int64()), batch.column(0)], names=["file", "ordinal", "doc_id"])
        if stream is not None:
            stream.close()

    return keep(documents.select(id_col, text_col).mapInArrow(run, f"file string, ordinal long, doc_id {kind}"), folder)


def _blocks(files: DataFrame, block_bytes: int) -> DataFrame:
    """(file, block, size) of each block of each file."""

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for uri in batch.column(0).to_pylist():
                system, at = fs.FileSystem.from_uri(uri)
                out.append(system.get_file_info(at).size)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.int64())], names=["file", "size"])

    sized = files.select("file").mapInArrow(sizes, "file string, size long").where("size > 0")
    return sized.select("file", F.explode(F.sequence(F.lit(0), F.floor((F.col("size") - 1) / block_bytes))).alias("block"), "size")


def separator_scan(files: DataFrame, end: int = END, dtype: np.dtype = DTYPE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(file, ordinal, n_tokens, closed) of the documents in flat token files; input (file).

    A document's count leaves out its separator. Two separators in a row close an empty
    document. Tokens after a file's last separator make a last document that is not
    closed. A file that holds part of an identifier at its end is an error; an empty file
    has no documents.
    """
    dtype = np.dtype(dtype)
    if block_bytes % dtype.itemsize:
        raise ValueError("blocks must hold whole identifiers")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[], [], [], [], []]
            for uri, block, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size % dtype.itemsize:
                    raise ValueError(f"{uri} ends inside an identifier")
                system, at = fs.FileSystem.from_uri(uri)
                with system.open_input_file(at) as f:
                    data = f.read_at(min(block_bytes, size - block * block_bytes), block * block_bytes)
                ids = np.frombuffer(data, dtype)
                cut = np.flatnonzero(ids == end)
                inner = np.diff(cut, prepend=-1) - 1
                tail = len(ids) - (int(cut[-1]) + 1 if len(cut) else 0)
                for c, x in zip(cols, (uri, block, len(cut), tail, inner), strict=True):
                    c.append(x)
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.string()), *(pa.array(c, pa.int64()) for c in cols[1:4]), pa.array(cols[4], pa.list_(pa.int64()))], names=["file", "block", "seps", "tail", "lengths"]
            )

    blocks = keep(_blocks(files, block_bytes))
    # rows of a few bytes stand for blocks: Spark can't tell the work by their size
    tasks = min(TASKS, max(1, -(-blocks.count() // BLOCKS_PER_TASK)))
    found = keep(blocks.repartition(tasks).mapInArrow(run, "file string, block long, seps long, tail long, lengths array<long>"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    # the scan carries one small row for each block; lengths are joined after it
    sums = found.select("file", "block", "seps", "tail").withColumn("first", F.coalesce(F.sum("seps").over(before), F.lit(0))).withColumn("ahead", F.coalesce(F.sum("tail").over(before), F.lit(0)))
    dropped = F.coalesce(F.max(F.when(F.col("seps") > 0, F.col("ahead"))).over(before), F.lit(0))
    sums = sums.withColumn("carry", F.col("ahead") - dropped)
    last = F.max("block").over(Window.partitionBy("file"))
    sums = sums.withColumn("last", last == F.col("block"))
    rows = found.select("file", "block", "lengths").join(sums, ["file", "block"])
    closed = rows.select("file", "first", "carry", F.posexplode("lengths").alias("i", "n")).select(
        "file", (F.col("first") + F.col("i")).alias("ordinal"), (F.col("n") + F.when(F.col("i") == 0, F.col("carry")).otherwise(0)).alias("n_tokens"), F.lit(True).alias("closed")
    )
    rest = F.col("tail") + F.when(F.col("seps") == 0, F.col("carry")).otherwise(0)
    loose = sums.where(F.col("last") & (rest > 0)).select("file", (F.col("first") + F.col("seps")).alias("ordinal"), rest.alias("n_tokens"), F.lit(False).alias("closed"))
    return closed.unionByName(loose)


def token_counts(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """Per row: doc_id, n_tokens, by a scan of the flat files that the texts were written to.

    A null or empty text counts 0, and of texts of any length all tokens are counted; one
    text's tokens must fit a task. Repeated rows and ids are counted each by itself; an
    empty table makes no files and gives no rows; other columns are ignored.
    """
    folder = shared_folder(documents.sparkSession)
    written = write_flat(documents, folder, id_col, text_col, path)
    counts = separator_scan(written.select("file").distinct())
    return written.join(counts, ["file", "ordinal"]).select("doc_id", "n_tokens")
