"""SimHash near-duplicates through covering locality-sensitive hashing.

Every bit position gets a vector of radius + 1 bits; table v keeps the positions whose
vector has an odd product with v.  The at most ``radius`` positions in which a pair
differs cannot span all radius + 1 dimensions, so some v is orthogonal to all of them and
the pair agrees on the whole mask of that table: no pair within the radius is lost.

Copies fold into one fingerprint first.  A bucket's fingerprints are linked by a search
that takes each from the unvisited set once, so near copies in thousands cost one pass and
never become pairs; a bucket above `BUCKET` is cut into blocks and each pair of blocks is
searched on its own, which keeps every link and bounds each task.

Null and empty texts, and texts of white space, have fingerprint zero and link like any
other.  Texts are hashed whole; bits are counted some shingles at a time, so very long ones
take bounded memory beside their words.  Repeated rows are repeated in the result.  A null
doc_id takes part but is never a component's name unless the component has no other.  A
fingerprint of very many rows, and a bucket of very many fingerprints, is cut over tasks.
Only the named columns are read, so other columns may have any names.  An empty table gives
an empty result.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from datakiln.jobs import scratch
from datakiln.llm.components import components, joined_names

BITS, SEED = 64, 42
#: Fingerprints that one search holds; larger buckets are searched block by block.
BUCKET = 8192
#: Shingles whose bits are counted at once.
SHINGLES_AT_ONCE = 1 << 16
#: Shingles whose bits are counted in one byte, and what tells the words of a wide fingerprint apart.
SHINGLES_A_BYTE, TURNS = 255, np.random.default_rng(SEED).integers(0, 2**64, 1024, dtype=np.uint64)


def shingle_hashes(text: bytes | None, words_each: int) -> np.ndarray:
    """XXH64 of each shingle of the lower-cased words (ASCII letters, ASCII white space), repeats included."""
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= words_each:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: 1 - words_each].tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[words_each - 1 :].tolist(), strict=True)], np.uint64)


def fingerprint(text: bytes | None, words_each: int = 4) -> int:
    """Bit i is set if it is set in more than half of the hashes; zero for a text without words."""
    hashes = shingle_hashes(text, words_each)
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), SHINGLES_AT_ONCE):
        part = hashes[at : at + SHINGLES_AT_ONCE]
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.uint32)
    return sum(1 << i for i in np.flatnonzero(2 * counts > len(hashes)).tolist())


def fingerprint_column(text: Column, words_each: int = 4) -> Column:
    """The fingerprint of a text column as a signed long with the same bits."""

    @F.arrow_udf("long")
    def prints(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            values = np.fromiter((fingerprint(text.as_py(), words_each) for text in batch), np.uint64, len(batch))
            yield pa.array(values.view(np.int64))

    return prints(text.cast("binary"))


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit numbers of which every bit depends on every bit of ``x``."""
    for times in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        x = (x ^ (x >> np.uint64(33))) * np.uint64(times)
    return x ^ (x >> np.uint64(33))


def wide_fingerprint(hashes: np.ndarray, words: int) -> np.ndarray:
    """The bits of a fingerprint of ``words`` times 64, each set if set in more than half of the hashes, turned anew for each word."""
    counts = np.zeros(words * BITS, np.int64)
    for at in range(0, len(hashes), SHINGLES_A_BYTE):
        turned = mixed(hashes[at : at + SHINGLES_A_BYTE, None] ^ TURNS[:words])
        counts += np.unpackbits(turned.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    return 2 * counts > len(hashes)


def covering_masks(radius: int, bits: int = BITS) -> list[int]:
    """2 ** (radius + 1) - 1 masks (as signed longs); any two fingerprints within the radius agree on one."""
    size = 2 ** (radius + 1)
    vectors = [i % size for i in range(bits)]
    masks = [sum(1 << i for i, x in enumerate(vectors) if (x & v).bit_count() % 2) for v in range(1, size)]
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in masks]


def links_within(prints: np.ndarray, radius: int) -> tuple[list[int], list[int]]:
    """Edges that connect exactly what links of at most ``radius`` bits connect among distinct fingerprints."""
    if len(prints) == 2:
        a, b = prints.tolist()
        return ([a], [b]) if ((a ^ b) & (2**64 - 1)).bit_count() <= radius else ([], [])
    left, right, open_ = [], [], np.sort(prints)
    while len(open_):
        root, open_ = int(open_[0]), open_[1:]
        waiting = [root]
        while waiting and len(open_):
            differing = (open_ ^ np.int64(waiting.pop())).view(np.uint64)  # bits of signed numbers are counted in their magnitude
            near = np.bitwise_count(differing) <= radius
            if near.any():
                found = open_[near].tolist()
                open_ = open_[~near]
                waiting += found
                left += found
                right += [root] * len(found)
    return left, right


def bucket_links(radius: int):
    """For mapInArrow over rows (k, fp) sorted by k: the edges (a, b) of each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        held_key = None

        def edges(groups: list[np.ndarray]) -> pa.RecordBatch:
            a: list[int] = []
            b: list[int] = []
            for group in groups:
                if len(group) > 1:
                    x, y = links_within(group, radius)
                    a += x
                    b += y
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys, prints = (batch.column(n).to_numpy() for n in ("k", "fp"))
            cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
            full = []
            for start, end in zip(cuts, cuts[1:], strict=False):
                if keys[start] != held_key:
                    if held:
                        full.append(np.concatenate(held))
                    held, held_key = [], keys[start]
                held.append(prints[start:end])
            yield edges(full)
        if held:
            yield edges([np.concatenate(held)])

    return run


def fingerprint_links(prints: DataFrame, radius: int) -> DataFrame:
    """Distinct fingerprints (fp) to edges (a, b) that connect all that lies within the radius."""
    masks = F.array(*[F.xxhash64(F.lit(t), F.col("fp").bitwiseAND(F.lit(m))) for t, m in enumerate(covering_masks(radius))])
    bucketed = prints.select("fp", F.explode(masks).alias("k"))
    sizes = bucketed.groupBy("k").agg(F.count("*").alias("n")).filter("n > 1")
    shared = scratch.save(bucketed.join(scratch.save(sizes, "sizes"), "k"), "buckets")
    searched = shared.filter(F.col("n") <= BUCKET).select("k", "fp")
    blocks = F.ceil(F.col("n") / BUCKET).cast("int")
    block = F.pmod(F.xxhash64(F.col("fp"), F.lit(1)), blocks).cast("int")
    paired = (
        shared.filter(F.col("n") > BUCKET)
        .withColumn("mine", block)
        .withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        .select(F.xxhash64("k", F.least("mine", "other"), F.greatest("mine", "other")).alias("k"), "fp")
    )
    spread = searched.union(paired).repartition("k").sortWithinPartitions("k")
    return spread.mapInArrow(bucket_links(radius), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", words_each: int = 4, radius: int = 4) -> DataFrame:
    """(doc_id, fp, component_id) for each row; component_id is the least doc_id reachable over links."""
    printed = docs.select(F.col(doc_id).alias("doc_id"), fingerprint_column(F.col(text), words_each).alias("fp"))
    printed = scratch.save(printed, "fingerprints")
    with scratch.cleared(docs.sparkSession):
        least = scratch.save(printed.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("held")), "least")
        roots = scratch.save(components(fingerprint_links(least.select("fp"), radius)), "roots")
        grouped = roots.join(least, roots.node == least.fp).select("node", "root", "least")
        named = grouped.groupBy("root").agg(F.min("least").alias("joint"))
        joint = grouped.join(named, "root").select(F.col("node").alias("fp"), "joint")
        names = least.join(joint, "fp", "left").select("fp", "held", F.coalesce("joint", "least").alias("component_id"))
        names = scratch.save(names, "names", outlives=True)
    return joined_names(printed, names, "fp").select("doc_id", "fp", "component_id")


def hex16(fp: Column) -> Column:
    """A fingerprint as 16 lowercase hexadecimal digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
