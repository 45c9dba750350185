"""Every asking row against every row, in blocks, without a pair ever being a Spark row.

Rows are dealt to blocks of bounded bytes and stay in one block each.  Asking rows are sent
to every block that they ask and stream past it in Arrow batches, so a task holds one block
and one batch.  What is shuffled is each row once and each asking row once for each block:
blocks are large (`BLOCK_BYTES` as doubles, a fraction of that on the way) so that there
are few.
"""

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of vectors that a block holds as doubles.
BLOCK_BYTES = 32 << 20


def smallest_ints(largest: int) -> str:
    """The narrowest array type for whole numbers up to ``largest`` in size."""
    return "array<smallint>" if largest < 1 << 15 else "array<int>" if largest < 1 << 31 else "array<bigint>"


def blocks_for(n: int, dim: int, cores: int) -> int:
    """Blocks for ``n`` rows: as many as their bytes need, or enough for all cores where rows are few."""
    return max(1, -(-n * 8 * max(dim, 1) // BLOCK_BYTES), min(-(-n // 64), 2 * cores))


def meet(rows: DataFrame, askers: DataFrame, prepare: Callable[[pa.Table], object], ask: Callable[[object, pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """What ``ask`` gives for each block of ``rows`` (block, …) and each batch of ``askers`` (block, …) of that block.

    ``prepare`` turns the rows of a block into what ``ask`` is given of them.
    """
    both = rows.withColumn("asks", F.lit(False)).unionByName(askers.withColumn("asks", F.lit(True)), allowMissingColumns=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts, block = None, [], None
        for batch in batches:
            keys, asks = batch.column("block").to_numpy(), batch.column("asks").to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((keys[1:] != keys[:-1]) | (asks[1:] != asks[:-1])) + 1
            for start, stop in zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)], strict=True):
                if start == stop:
                    continue
                some = batch.slice(start, stop - start)
                if keys[start] != at:
                    at, parts, block = keys[start], [], None
                if not asks[start]:
                    parts.append(some)
                elif parts or block is not None:
                    if block is None:
                        block, parts = prepare(pa.Table.from_batches(parts)), []
                    yield from ask(block, some)

    return both.repartition("block").sortWithinPartitions("block", "asks").mapInArrow(run, schema)
