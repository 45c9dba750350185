"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

A rank file names each token's bytes and rank.  The merge list that the library needs is
derived from it: a token's two parts are what the merges of lower rank leave of its bytes.
Texts are split by a pattern, each match becomes byte characters (one printable character
for each byte), the library's model turns those into tokens with offsets, and decoding
reverses the byte table.  A token may hold part of a character: `decode_bytes` is exact,
`decode_text` puts the pieces together before it reads UTF-8.

Nulls encode as empty texts (no ids); a null list of ids decodes to null; whole texts are
processed whatever their length; repeated rows give repeated results and an empty table an
empty one.  `round_trip` replaces columns named ids and decoded, `digests` n_tokens, ids_sha256
and decoded_sha256; others may have any names and pass through untouched.
"""

import base64
import functools
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import models

from datakiln.llm import pretokens
from datakiln.operators.headers import unused

#: Pieces that a worker remembers before it starts afresh.
REMEMBERED = 300_000


@functools.lru_cache(maxsize=4)
def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank from a rank file (base64 and rank on each line)."""
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


def parts_of(token: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """What is left of a token's bytes when only merges of lower rank are made."""
    parts, most = [token[i : i + 1] for i in range(len(token))], ranks[token]
    while len(parts) > 2:
        rank, at = min((ranks.get(parts[i] + parts[i + 1], most), i) for i in range(len(parts) - 1))
        if rank >= most:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


@functools.lru_cache(maxsize=4)
def merges_of(path: str) -> tuple[dict[str, int], list[tuple[str, str]]]:
    """Vocabulary and merge list, in byte characters, that give what the rank file gives."""
    ranks = read_ranks(path)
    merges = []
    for token in sorted((t for t in ranks if len(t) > 1), key=ranks.get):
        parts = parts_of(token, ranks)
        if len(parts) == 2:
            merges.append((pretokens.to_chars(parts[0]), pretokens.to_chars(parts[1])))
    return {pretokens.to_chars(token): rank for token, rank in ranks.items()}, merges


class Encoder:
    """Texts to ids: pieces already seen by look-up, all new ones of a group by one call of the library."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], pattern: str, suspects: str) -> None:
        self.model = models.BPE(vocab=vocab, merges=merges, ignore_merges=True)
        self.split = pretokens.Splitter(pattern, suspects)
        self.merge = pretokens.words_merger(self.model)
        self.known: dict[str, bytes] = {}

    def __call__(self, texts: Iterator[str]) -> Iterator[bytes]:
        """The ids of each text as bytes of int32."""
        for group in pretokens.groups(texts):
            split = [self.split(text) for text in group]
            if missing := {piece for pieces in split for piece in pieces if piece not in self.known}:
                if len(self.known) + len(missing) > REMEMBERED:
                    self.known, missing = {}, {piece for pieces in split for piece in pieces}
                self.known |= {piece: array("i", ids).tobytes() for piece, ids in self.merge(list(missing))}
            for pieces in split:
                yield b"".join(map(self.known.__getitem__, pieces))

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        """(id, start, end) of each token in characters; a token with part of a character spans it whole."""
        found, at = [], 0
        for piece in self.split(text):
            at = text.index(piece, at)
            owner = [i for i, c in enumerate(piece) for _ in c.encode()]
            a = 0
            for t in self.model.tokenize(pretokens.to_chars(piece.encode())):
                b = a + len(t.value)  # one character for each byte
                found.append((t.id, at + owner[a], at + owner[b - 1] + 1))
                a = b
            at += len(piece)
        return found


def as_lists(rows: Iterable[bytes]) -> pa.ListArray:
    """Rows of int32 bytes as an Arrow list array."""
    rows = list(rows)
    ends = np.cumsum([0, *map(len, rows)], dtype=np.int64) // 4
    return pa.ListArray.from_arrays(ends.astype(np.int32), np.frombuffer(b"".join(rows), np.int32))


def byte_table(vocab: dict[str, int]) -> dict[int, bytes]:
    """Id to bytes: the byte table reversed."""
    return {number: pretokens.from_chars(piece) for piece, number in vocab.items()}


def bytes_of(ids: pa.ListArray, table: dict[int, bytes]) -> pa.Array:
    """The bytes that each list of ids stands for."""
    return pa.array([None if not row.is_valid else b"".join(map(table.__getitem__, row.values.to_numpy().tolist())) for row in ids], pa.binary())


def encode(spark: SparkSession, text: Column, path: str, pattern: str) -> Column:
    """A column ``array<int>`` with the ids of ``text``; broadcast is the vocabulary alone."""
    shipped = spark.sparkContext.broadcast((*merges_of(path), pattern, pretokens.differing_code_points()))

    @F.arrow_udf("array<int>")
    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = Encoder(*shipped.value)
        for batch in batches:
            yield as_lists(encoder(text.as_py() or "" for text in batch))

    return ids(text)


def encode_with_offsets(spark: SparkSession, text: Column, path: str, pattern: str) -> Column:
    """As `encode`, but ``array<struct<id, start, end>>`` with offsets in code points, end exclusive."""
    shipped = spark.sparkContext.broadcast((*merges_of(path), pattern, pretokens.differing_code_points()))
    kind = pa.list_(pa.struct([("id", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))

    @F.arrow_udf("array<struct<id:int,start:int,end:int>>")
    def spans(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = Encoder(*shipped.value)
        for batch in batches:
            rows = [[{"id": i, "start": a, "end": b} for i, a, b in encoder.spans(text.as_py() or "")] for text in batch]
            yield pa.array(rows, kind)

    return spans(text)


def decode_bytes(spark: SparkSession, ids: Column, path: str) -> Column:
    """The bytes that ``ids`` stand for: exact, also where tokens split characters."""
    shipped = spark.sparkContext.broadcast(merges_of(path)[0])

    @F.arrow_udf("binary")
    def joined(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        table = byte_table(shipped.value)
        for batch in batches:
            yield bytes_of(batch, table)

    return joined(ids)


def decode_text(spark: SparkSession, ids: Column, path: str) -> Column:
    """The text that ``ids`` stand for; bytes that are not UTF-8 become U+FFFD."""
    return F.decode(decode_bytes(spark, ids, path), "UTF-8")


def round_trip(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """``docs`` with ids (``array<int>``) of the text and decoded (``binary``) of the ids; one row for each row.

    Both directions run in one worker, which halves the Python memory of a task.
    """
    shipped = docs.sparkSession.sparkContext.broadcast((*merges_of(path), pattern, pretokens.differing_code_points()))

    @F.arrow_udf("struct<ids:array<int>,decoded:binary>")
    def coded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = Encoder(*shipped.value)
        table = byte_table(shipped.value[0])
        for batch in batches:
            ids = as_lists(encoder(text.as_py() or "" for text in batch))
            yield pa.StructArray.from_arrays([ids, bytes_of(ids, table)], ["ids", "decoded"])

    both = unused("_bpe_coded", [*docs.columns, "ids", "decoded"])
    made = docs.withColumn(both, coded(F.col(text)))
    return made.withColumns({"ids": F.col(f"{both}.ids"), "decoded": F.col(f"{both}.decoded")}).drop(both)


def digests(coded: DataFrame) -> DataFrame:
    """n_tokens, ids_sha256 and decoded_sha256 of what `round_trip` gives."""
    return coded.withColumns(
        {
            "n_tokens": F.size("ids").cast("long"),
            "ids_sha256": F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256),
            "decoded_sha256": F.sha2(F.col("decoded"), 256),
        }
    )
