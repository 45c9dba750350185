"""Documents as files of token ids, written and read by Spark as the data source ``token_blocks``.

Documents are sorted by range in ascending doc_id order; each task encodes its range
(`word_ids`) and writes it as files of about `FILE_IDS` ids in the format of `patched`,
whole documents in each.  When all tasks are done a manifest names the files in
order with the number of ids before each, so what a failed or repeated task left behind is
never read.  Reading takes one task for each file; a document's start is its place in the
file and the ids before the file.

Null and empty texts are documents with the end id alone.  A null doc_id stays null and
comes last; rows that repeat a doc_id stay rows of their own, in the order of a hash of
their text; rows alike in both keep the order in which they were read.  Texts are taken whole,
however long: a document is never cut over files.  Only the named columns are read, so
others may have any names.  An empty table gives a manifest without files and an empty result.

Paths may have any scheme that pyarrow's file systems know; each executor must reach them.
"""

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from datakiln.jobs.scratch import located
from datakiln.llm import patched, word_ids

#: Ids of a file at least, but for the last of a task; bytes of texts that a range of the sort holds about, and of ids that a batch of the reader holds.
FILE_IDS, RANGE_BYTES, BATCH_BYTES = 4 << 20, 64 << 20, 8 << 20
MANIFEST = "manifest.json"
SCHEMA = "doc_id long, start long, ids binary"


@dataclass
class Written(WriterCommitMessage):
    """The files of one task in order, with their ids and documents."""

    task: int
    files: list[tuple[str, int, int]]


class BlockWriter(DataSourceArrowWriter):
    """Rows (doc_id, text) of one sorted range to files; the manifest when all ranges are written.

    A text is encoded where it is written, so its ids never leave the worker but as blocks.
    """

    def __init__(self, path: str, model_path: str, end: int) -> None:
        self.path, self.end = path, end
        self.prepared = word_ids.prepared(model_path, end)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, root = located(self.path)
        system.create_dir(root, recursive=True)
        task, files, encoder = TaskContext.get().partitionId(), [], word_ids.encoder(*self.prepared)
        kind = encoder.kind
        last = np.array([self.end], kind).tobytes()
        doc_ids: list[int | None] = []
        held: list[bytes] = []
        size = 0

        def flush() -> None:
            nonlocal doc_ids, held, size
            ids = np.frombuffer(b"".join(held), kind)
            starts = np.concatenate([[0], np.cumsum([len(x) for x in held])]) // kind.itemsize
            content = patched.encode_file(ids, np.array([d or 0 for d in doc_ids]), np.array([d is not None for d in doc_ids]), starts)
            name = f"ids-{task:06d}-{len(files):05d}-{uuid.uuid4().hex}.pfor"
            with system.open_output_stream(f"{root}/{name}") as out:
                out.write(content)
            files.append((name, len(ids), len(doc_ids)))
            doc_ids, held, size = [], [], 0

        for batch in iterator:
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoder(text.as_py() or "" for text in batch.column(1)), strict=True):
                doc_ids.append(doc_id)
                held.append(ids + last)
                size += len(held[-1])
                if size >= FILE_IDS * kind.itemsize:
                    flush()
        if held:
            flush()
        return Written(task, files)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        system, root = located(self.path)
        listed, before = [], 0
        for message in sorted(filter(None, messages), key=lambda m: m.task):
            for name, ids, docs in message.files:
                listed.append({"file": name, "before": before, "ids": ids, "documents": docs})
                before += ids
        system.create_dir(root, recursive=True)
        with system.open_output_stream(f"{root}/{MANIFEST}") as out:
            out.write(json.dumps({"ids": before, "files": listed}).encode())

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        system, root = located(self.path)
        for message in filter(None, messages):
            for name, _, _ in message.files:
                system.delete_file(f"{root}/{name}")


@dataclass
class OneFile(InputPartition):
    name: str
    before: int


class BlockReader(DataSourceReader):
    """(doc_id, start, ids as little-endian uint32) of the files that the manifest names."""

    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self) -> list[InputPartition]:
        system, root = located(self.path)
        with system.open_input_stream(f"{root}/{MANIFEST}") as file:
            found = json.loads(file.read())["files"]
        return [OneFile(x["file"], x["before"]) for x in found] or [OneFile("", 0)]

    def read(self, partition: OneFile) -> Iterator[pa.RecordBatch]:
        if not partition.name:
            return
        system, root = located(self.path)
        with system.open_input_stream(f"{root}/{partition.name}") as file:
            held = patched.open_file(file.read())
        starts, docs = held.starts, len(held.doc_ids)
        at = 0
        while at < docs:
            upto = max(at + 1, int(np.searchsorted(starts, starts[at] + BATCH_BYTES // 4, "right")) - 1)
            ids = held.ids(int(starts[at]), int(starts[upto])).astype("<u4").tobytes()
            cuts = ((starts[at : upto + 1] - starts[at]) * 4).tolist()
            doc_ids = pa.array(held.doc_ids[at:upto], pa.int64(), mask=held.known[at:upto] == 0)
            bodies = pa.array([ids[a:b] for a, b in zip(cuts, cuts[1:], strict=False)], pa.binary())
            begun = pa.array((starts[at:upto] + partition.before).astype(np.int64))
            yield pa.RecordBatch.from_arrays([doc_ids, begun, bodies], ["doc_id", "start", "ids"])
            at = upto


class TokenBlocks(DataSource):
    """The data source ``token_blocks``; options: path, and for writing model (a local path of the driver) and end (an id)."""

    @classmethod
    def name(cls) -> str:
        return "token_blocks"

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema, overwrite: bool) -> BlockWriter:  # noqa: ARG002
        return BlockWriter(self.options["path"], self.options["model"], int(self.options["end"]))

    def reader(self, schema) -> BlockReader:  # noqa: ARG002
        return BlockReader(self.options["path"])


def write(docs: DataFrame, path: str, model_path: str, end: int, text: str = "text", key: str = "doc_id") -> None:
    """The ids of each document and ``end`` behind them as files at ``path``, in ascending order of the key."""
    spark = docs.sparkSession
    spark.dataSource.register(TokenBlocks)
    held = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-held // RANGE_BYTES))
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(text).alias("tie"), F.monotonically_increasing_id().alias("row"), F.col(text).alias("text"))
    order = [F.col("doc_id").asc_nulls_last(), F.col("tie"), F.col("row")]
    dealt = rows.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    dealt.select("doc_id", "text").write.format("token_blocks").option("model", model_path).option("end", end).mode("append").save(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, ids) of the files at ``path``; ids as little-endian unsigned 32-bit integers."""
    spark.dataSource.register(TokenBlocks)
    return spark.read.format("token_blocks").load(path)


def report(found: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of what `read` gives."""
    return found.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
