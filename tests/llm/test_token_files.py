"""Token files against the tokenizers library, byte for byte, and their format against plain packing."""

import random
import zlib

import numpy as np
import pytest
import tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from datakiln.llm import bitpack, patched, pretokens, queries, token_files  # noqa: E402
from tests.llm.test_text_operators import ODD  # noqa: E402

MODEL = public_tokenizers.path("word_bpe_49k.json")
SF = "/root/testdata/sf0.001"


LIBRARY = tokenizers.Tokenizer.from_file(MODEL)


def library_ids(text):
    return [*LIBRARY.encode(text or "", add_special_tokens=False).ids, 2]


def plain_rows(rows):
    """What the files hold of (doc_id, text) rows with distinct ids, null last."""
    out, at = [], 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        ids = library_ids(text)
        out.append((doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


@given(st.lists(st.integers(0, 2**32 - 1), max_size=400), st.integers(0, 400), st.integers(0, 400))
@settings(max_examples=60, deadline=None)
def test_any_ids_come_back_whole_and_in_part(ids, start, stop):
    made = np.array(ids, np.uint32)
    held = patched.open_file(patched.encode_file(made, np.array([7]), np.array([1]), np.array([0, len(ids)])))
    stop = min(stop, len(ids))
    assert held.ids(0, len(ids)).tolist() == ids and held.ids(start, stop).tolist() == ids[start:stop]


def test_outliers_leave_a_block_narrow():
    rng = random.Random(3)
    ids = [1000 + rng.randrange(16) for _ in range(patched.BLOCK)]
    ids[5], ids[77] = 49_407, 2**31
    (block,) = patched.encode_blocks(np.array(ids, np.uint32))
    assert block[4:6] == bytes([4, 2])  # four bits and two exceptions
    assert len(block) == 6 + patched.BLOCK * 4 // 8 + 2 * 5 and block[-10:-8] == bytes([5, 77])
    assert patched.decode_blocks(np.frombuffer(block, np.uint8), np.array([0])).tolist() == ids


def test_numbers_are_packed_low_bit_first():
    assert bitpack.pack(np.array([[1, 2, 3]]), 3).tolist() == [[0b11010001, 0]]
    assert bitpack.bit_length(np.array([0, 1, 2, 255, 256, 2**32 - 1])).tolist() == [0, 1, 2, 8, 9, 32]


def test_a_cut_file_is_an_error():
    made = patched.encode_file(np.arange(300, dtype=np.uint32), np.array([1]), np.array([1]), np.array([0, 300]))
    for broken in (b"", made[:-1], made[: len(made) // 2], b"x" + made[1:]):
        with pytest.raises(ValueError, match="not a whole file"):
            patched.open_file(broken)


@pytest.mark.parametrize("file_ids", [4 << 20, 900])
def test_files_hold_what_the_library_gives(spark, tmp_path, monkeypatch, file_ids):
    monkeypatch.setattr(token_files, "FILE_IDS", file_ids)
    real = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    rows = [*((10**6 + i, t) for i, t in enumerate(ODD)), (None, "no id at all"), (-5, "it's 3 o'clock\x1fnow\x1d x"), *real]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumns({"ids": F.lit("clash"), "start": F.lit(1), "tie": F.lit(None).cast("int"), "row": F.lit(2)})
    path = str(tmp_path / "files")
    token_files.write(frame, path, MODEL, 2)
    found = token_files.read(spark, path)
    got = sorted((tuple(r) for r in token_files.report(found).collect()), key=lambda r: (r[0] is None, r[0]))
    assert got == plain_rows(rows)
    whole = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in found.collect()}
    assert whole[None] == library_ids("no id at all") and whole[-5] == library_ids("it's 3 o'clock\x1fnow\x1d x")


def test_repeated_ids_keep_a_place_each(spark, tmp_path):
    rows = [(4, "one text"), (4, "one text"), (4, "another text here"), (4, None), (1, ""), (9, "last")]
    token_files.write(spark.createDataFrame(rows, "doc_id long, text string"), str(tmp_path / "f"), MODEL, 2)
    got = sorted(token_files.report(token_files.read(spark, str(tmp_path / "f"))).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [1, 4, 4, 4, 4, 9]
    assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got)])[:-1].tolist()
    assert sorted(r.n_tokens for r in got) == sorted(len(library_ids(t)) for _, t in rows)


def test_what_a_lost_task_left_is_not_read(spark, tmp_path):
    path = tmp_path / "f"
    token_files.write(spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id long, text string"), str(path), MODEL, 2)
    (path / "ids-000000-00000-left.pfor").write_bytes(b"half a file")
    assert [r.doc_id for r in token_files.read(spark, str(path)).orderBy("doc_id").collect()] == [1, 2]


def test_an_empty_table_gives_no_rows(spark, tmp_path):
    token_files.write(spark.createDataFrame([], "doc_id long, text string"), str(tmp_path / "f"), MODEL, 2)
    assert token_files.report(token_files.read(spark, str(tmp_path / "f"))).collect() == []


def test_added_tokens_of_another_kind_are_an_error():
    with pytest.raises(ValueError, match="added tokens"):
        pretokens.added_tokens({"added_tokens": [{"content": "[A]", "normalized": True, "single_word": False}]})
    assert pretokens.added_tokens({"added_tokens": []})("anything") is None


def test_the_query_says_what_the_library_says(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.op13_token_files(spark, SF).select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    assert sorted(map(tuple, got)) == plain_rows(docs)
