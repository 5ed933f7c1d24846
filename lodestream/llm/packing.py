"""Packing documents into fixed windows of tokens: concatenate and cut.

Pass one encodes every document once and writes its ids beside its place within its task.
The tasks' token totals (one row per task) give each task its global offset by a prefix sum,
so pass two knows every document's offset without moving a document: it cuts at the window
borders and returns one record per piece.

Defined results: a null or empty text is the end id alone; documents with equal ids or texts are
packed once per row; rows without an id too; the order of the corpus is that of the input's parts and
rows, so ties need none; a very long text is one row of ids and many pieces; an empty table gives no
pieces; other columns of the input are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .tokens import encoder, vocabulary


def tokenise(df: DataFrame, tokenizer: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, task, task_start (the task's ids before the document), doc_tokens, ids (little-endian, width bytes each)."""
    width = "<u2" if encoder(tokenizer).lib.get_vocab_size() <= 1 << 16 and end_id < 1 << 16 else "<u4"

    def run(batches):
        task, at, enc = TaskContext.get().partitionId(), 0, encoder(tokenizer)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for a, b in common.chunks(texts):
                flat, bounds = common.with_end(*enc.encode_batch(texts.slice(a, b - a)), end_id)
                n = np.diff(bounds)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(a, b - a), pa.array(np.full(b - a, task, np.int64)), pa.array(at + bounds[:-1]), pa.array(n), common.slices_of(flat.astype(width), bounds)],
                    ["doc_id", "task", "task_start", "doc_tokens", "ids"],
                )
                at += int(bounds[-1])

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return common.map_arrow(rows, run, f"doc_id {kind}, task long, task_start long, doc_tokens long, ids binary")


def cut(tokens: DataFrame, length: int = 2048) -> DataFrame:
    """Pieces of at most `length` ids that never cross a multiple of `length` in the joined corpus."""
    bases = common.partition_bases(tokens, "task", "doc_tokens", "base")
    placed = tokens.join(F.broadcast(bases), "task").select("doc_id", (F.col("base") + F.col("task_start")).alias("at"), "doc_tokens", "ids")

    def run(batches):
        for whole in batches:
            for batch in common.small_batches([whole], 2000):
                at, n = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))
                blobs = batch.column(3)
                raw = b"".join(blobs.to_pylist())
                flat = np.frombuffer(raw, "<u2" if len(raw) == 2 * int(n.sum()) else "<u4").astype("<u4")
                first = np.cumsum(n) - n
                pieces = (at + n - 1) // length - at // length + 1
                doc = np.repeat(np.arange(len(n)), pieces)
                nth = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                window = at[doc] // length + nth
                begin = np.maximum(at[doc], window * length)
                size = np.minimum((at + n)[doc], (window + 1) * length) - begin
                start = begin - at[doc]
                bounds = np.concatenate([first[doc] + start, [len(flat)]]) if len(doc) else np.zeros(1, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(doc)), *map(pa.array, (start, size, n[doc], window, begin - window * length)), common.slices_of(flat, bounds)],
                    ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"],
                )

    kind = tokens.schema["doc_id"].dataType.simpleString()
    return common.map_arrow(placed, run, f"doc_id {kind}, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")


def pack(df: DataFrame, tokenizer: str | None = None, length: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: its document, place there, length, window, offset in the window, and ids as unsigned 32-bit."""
    tokens = tokenise(df, tokenizer or vocabulary(), end_id, id_col, text_col)
    return cut(common.materialise(tokens, "pack"), length)


def op1_packing(spark, sf_dir: str) -> DataFrame:
    pieces = pack(common.table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
