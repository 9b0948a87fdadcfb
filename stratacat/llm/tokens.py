"""Operator 5: token counts of the documents of flat token files, by a scan for separators."""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratacat.llm.common import checkpoint_dir, cut, table

#: The vocabulary file of op5; of the operators it is a parameter.
VOCABULARY = os.environ.get("TOKENIZERS", "/opt/tokenizers") + "/byte_bpe_50k.tiktoken"
#: How the vocabulary's makers cut a text before they merge.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BLOCK = 1 << 18
_BLOCKS = "file string, block long, data binary, labels array<long>"
_LABELS = "file string, ordinal long, label long"
_FOUND = "file string, block long, n long, head long, gaps array<long>, tail long"
#: What a task does to its batches.
Step = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def _in_turn(first: Step, second: Step) -> Step:
    """Both in one Python process: what passes between them, a block at a time, doesn't go through the JVM."""
    return lambda batches: second(first(batches))


def _encoding(ranks: bytes):  # noqa: ANN202
    import tiktoken

    merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("given", pat_str=PATTERN, mergeable_ranks=merges, special_tokens={})


def _cutting(vocabulary: str, eod: int, block_ids: int) -> Step:
    with open(vocabulary, "rb") as f:
        ranks = f.read()
    size = 2 * block_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        name, block = f"part-{TaskContext.get().partitionId():06d}", 0
        held, labels = bytearray(), []
        tokenizer = _encoding(ranks)

        def row(data: bytes, ids: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([block], pa.int64()), pa.array([data], pa.binary()), pa.array([ids], pa.list_(pa.int64()))], names=["file", "block", "data", "labels"])

        for b in batches:
            for doc_id, text in zip(b.column(0), b.column(1), strict=True):
                held += np.array(tokenizer.encode_ordinary(text.as_py() or ""), dtype="<u2").tobytes() + eod.to_bytes(2, "little")
                while len(held) > size:  # the document ends beyond this block
                    yield row(bytes(held[:size]), labels)
                    del held[:size]
                    labels, block = [], block + 1
                labels.append(doc_id.as_py())
        if held:
            yield row(bytes(held), labels)

    return run


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))


def flat_blocks(docs: DataFrame, vocabulary: str = VOCABULARY, eod: int = 50256, block_ids: int = BLOCK) -> DataFrame:
    """The flat token files that docs make, one a partition, as rows of file, block (from 0), data (16-bit little-endian ids, block_ids of them but for the last) and labels.

    Each text's ids and then eod; a null or empty text is a bare eod. A document runs over as many blocks as it needs. labels are the doc_ids whose eod stands in the block, in order.
    vocabulary: a file of ranks of fewer than 65536 ids, read here and sent along, so executors needn't have it. A partition's rows come in the order of its input,
    so a task that runs again makes the same file.
    """
    return _texts(docs).mapInArrow(_cutting(vocabulary, eod, block_ids), _BLOCKS)


def _store(uri: str):  # noqa: ANN202
    """The file system of a path and the path there, for tasks. file, hdfs, s3 and others that pyarrow knows."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri) if re.match(r"[a-z][a-z0-9+.-]*:", uri) else f"file://{uri}")


def _writing(path: str) -> Step:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from uuid import uuid4

        out = name = store = top = None
        ordinal, part = 0, f".{uuid4().hex}"
        for b in batches:
            for i in range(b.num_rows):
                if out is None:
                    name, (store, top) = b.column(0)[i].as_py(), _store(path)
                    store.create_dir(top, recursive=True)
                    out = store.open_output_stream(f"{top}/{part}")
                out.write(b.column(2)[i].as_buffer())
                labels = b.column(3)[i].values
                n = len(labels)
                yield pa.RecordBatch.from_arrays([pa.array([name] * n, pa.string()), pa.array(range(ordinal, ordinal + n), pa.int64()), labels], names=["file", "ordinal", "label"])
                ordinal += n
        if out is not None:
            out.close()
            store.move(f"{top}/{part}", f"{top}/{name}")

    return run


def write_token_files(blocks: DataFrame, path: str) -> DataFrame:
    """Writes the blocks of flat_blocks as flat files under path, one a partition and nothing but ids in them; gives file (its name), ordinal and label of each document.

    A task writes beside its file and renames at the end, so one that runs again leaves the same file. Take an action on the result before the files are read.
    """
    return blocks.select("file", "block", "data", "labels").mapInArrow(_writing(path), _LABELS)


def make_token_files(docs: DataFrame, path: str, vocabulary: str = VOCABULARY, eod: int = 50256, block_ids: int = BLOCK) -> DataFrame:
    """write_token_files of flat_blocks, in one Python process a task: no block is a row."""
    return _texts(docs).mapInArrow(_in_turn(_cutting(vocabulary, eod, block_ids), _writing(path)), _LABELS)


def _ranges(spark: SparkSession, path: str, size: int, bytes_a_task: int) -> DataFrame:
    """file, length and block of each range of size bytes, dealt out."""
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "length").where("length > 0")
    total = files.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    ranges = files.select("file", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("length") - 1) / size))).alias("block"))
    return ranges.repartition(max(1, -(-total // bytes_a_task)), "file", "block").sortWithinPartitions("file", "block")


def _reading(size: int) -> Step:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = source = None
        for b in batches:
            for name, length, block in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if name != now:
                    store, at = _store(name)
                    now, source = name, store.open_input_file(at)
                data = source.read_at(min(size, length - block * size), block * size)
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([block], pa.int64()), pa.array([data], pa.binary())], names=["file", "block", "data"])

    return run


def read_token_files(spark: SparkSession, path: str, width: int = 2, block_ids: int = BLOCK, bytes_a_task: int = 64 << 20) -> DataFrame:
    """Flat token files under path as blocks: file (its path), block, data. Spark lists paths and lengths; tasks read ranges of block_ids ids, so a file may be larger than a task's memory.

    Names that start with . or _ are no token files. The tasks open the files themselves (see _store).
    """
    size = width * block_ids
    return _ranges(spark, path, size, bytes_a_task).mapInArrow(_reading(size), "file string, block long, data binary")


def _searching(eod: int, width: int) -> Step:
    kind = {2: "<u2", 4: "<u4"}[width]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                ids = np.frombuffer(b.column(2)[i].as_buffer() or b"", dtype=kind)
                at = np.flatnonzero(ids == eod)
                gaps = np.diff(at) - 1
                head, tail = (int(at[0]), len(ids) - 1 - int(at[-1])) if len(at) else (len(ids), 0)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, 1), b.column(1).slice(i, 1), pa.array([len(at)], pa.int64()), pa.array([head], pa.int64()), pa.array([gaps], pa.list_(pa.int64())), pa.array([tail], pa.int64())],
                    names=["file", "block", "n", "head", "gaps", "tail"],
                )

    return run


def separator_scan(blocks: DataFrame, eod: int = 50256, width: int = 2) -> DataFrame:
    """file, ordinal (from 0) and n_tokens of each document of the files: the ids before each separator, which isn't counted; ids after the last are a document of their own.

    Each block is searched at once, knowing nothing of the others: its separators, the ids before the first, between them and after the last. A prefix scan over the blocks'
    few numbers, in the order of a file's blocks, then gives each the separators before it and the ids that are open where it starts. Blocks are searched
    wherever they lie; only three numbers a block are brought together by file. A block may hold no separator, or nothing but separators. Empty files and null data have no documents.
    """
    return _stitch(cut(blocks.select("file", "block", "data").mapInArrow(_searching(eod, width), _FOUND)))


def scan_token_files(spark: SparkSession, path: str, eod: int = 50256, width: int = 2, block_ids: int = BLOCK, bytes_a_task: int = 64 << 20) -> DataFrame:
    """separator_scan of read_token_files, a range read and searched in one Python process: no block is a row."""
    size = width * block_ids
    return _stitch(cut(_ranges(spark, path, size, bytes_a_task).mapInArrow(_in_turn(_reading(size), _searching(eod, width)), _FOUND)))


def _stitch(found: DataFrame) -> DataFrame:
    """The prefix scan of separator_scan over what the search of each block gave."""
    order = Window.partitionBy("file").orderBy("block")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    few = found.select("file", "block", "n", "head", "tail")
    # A block with a separator and those up to the next such one form a run: its tail and the heads after it are open together. All is in one order, so a file's blocks are sorted once.
    summed = few.withColumn("sum", F.sum(F.when(F.col("n") > 0, F.col("tail")).otherwise(F.col("head"))).over(so_far))
    runs = summed.withColumn("open", F.col("sum") - F.coalesce(F.last(F.when(F.col("n") > 0, F.col("sum") - F.col("tail")), ignorenulls=True).over(so_far), F.lit(0)))
    stitched = (
        runs.withColumn("carried", F.coalesce(F.lag("open").over(order), F.lit(0)))
        .withColumn("before", F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("last", F.lead("block").over(order).isNull())
        .select("file", "block", "carried", "before", F.when(F.col("last"), F.col("open")).otherwise(0).alias("left"))
    )
    closed = F.when(F.col("n") > 0, F.concat(F.array(F.col("carried") + F.col("head")), F.col("gaps"))).otherwise(F.array().cast("array<long>"))
    counts = F.concat(closed, F.when(F.col("left") > 0, F.array("left")).otherwise(F.array().cast("array<long>")))
    return found.join(stitched, ["file", "block"]).select("file", "before", F.posexplode(counts).alias("k", "n_tokens")).select("file", (F.col("before") + F.col("k")).alias("ordinal"), "n_tokens")


def op5(spark, sf_dir: str) -> DataFrame:
    """The token count of each document, found in the flat files that the documents' tokens make in the shared folder. A null or empty text has none; rows that repeat a doc_id give a row each."""
    from uuid import uuid4

    folder = f"{checkpoint_dir(spark)}/tokens-{uuid4().hex}"
    labels = cut(make_token_files(table(spark, sf_dir, "documents"), folder))
    if not labels.take(1):
        return labels.select(F.col("label").alias("doc_id"), F.lit(0).cast("long").alias("n_tokens"))
    found = scan_token_files(spark, folder).withColumn("file", F.substring_index("file", "/", -1))
    return found.join(labels, ["file", "ordinal"]).select(F.col("label").alias("doc_id"), "n_tokens")
