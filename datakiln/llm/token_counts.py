"""Token counts with the whole-token shortcut.

Offline, on the driver, each vocabulary entry that ends a word is put through the
tokenizer's own normaliser, splitter and merges; those that come back as exactly one
token form the proved table.  In the tasks a text is normalised and split, pre-tokens in
the table count 1 by look-up, and only the rest go through the merges (and are then
remembered, up to a fixed number of entries).

Nulls count as empty texts (0 tokens), whole texts are processed whatever their length,
repeated rows give repeated results and an empty table an empty one.  Columns named n_bytes,
n_tokens or over_limit are replaced; others may have any names and pass through untouched.
"""

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from datakiln.llm import pretokens
from datakiln.llm.pretokens import words_merger

#: Entries that a worker remembers beside the proved table before it starts afresh.
REMEMBERED = 800_000


def split_pattern(spec: dict) -> str:
    """The splitter's pattern of a tokenizer file of the word-end kind."""
    steps = spec["pre_tokenizer"]["pretokenizers"]
    split, byte_level = steps
    kinds = [x["type"] for x in spec["normalizer"]["normalizers"]]
    if (split["behavior"], split["invert"], byte_level["use_regex"], kinds) != ("Removed", True, False, ["NFC", "Replace", "Lowercase"]):
        raise ValueError("the whole-token shortcut is written for lower-casing word-end vocabularies")
    return split["pattern"]["Regex"]


def prove_whole_tokens(text_of_model: str) -> list[str]:
    """The words that the tokenizer alone turns into one token, each put to the test."""
    tok, spec = Tokenizer.from_str(text_of_model), json.loads(text_of_model)
    end, proved = spec["model"]["end_of_word_suffix"], []
    for piece, number in tok.get_vocab(with_added_tokens=False).items():
        if not piece.endswith(end):
            continue
        try:
            word = pretokens.from_chars(piece[: -len(end)]).decode("utf-8")
        except (KeyError, UnicodeDecodeError):
            continue
        if tok.normalizer.normalize_str(word) == word and tok.encode(word, add_special_tokens=False).ids == [number]:
            proved.append(word)
    return sorted(proved)


class TokenCounter:
    """Counts the tokens of texts as the library does, special strings included."""

    def __init__(self, text_of_model: str, proved: list[str], suspects: str) -> None:
        spec = json.loads(text_of_model)
        self.tok = Tokenizer.from_str(text_of_model)
        self.proved, self.known = proved, dict.fromkeys(proved, 1)
        self.split = pretokens.Splitter(split_pattern(spec), suspects)
        self.special = pretokens.added_tokens(spec)
        self.merge = words_merger(self.tok.model)

    def pieces(self, text: str) -> list[str]:
        """Normalised pre-tokens; below `pretokens.PLAIN_BELOW` texts are composed and lower-case by code point."""
        plain = text.isascii() or not self.split.beyond(text)
        return self.split(text.lower() if plain else self.tok.normalizer.normalize_str(text))

    def __call__(self, texts: Iterator[str]) -> Iterator[int]:
        for group in pretokens.groups(texts):
            split = [self.pieces(text) for text in group]
            if missing := {piece for pieces in split for piece in pieces if piece not in self.known}:
                if len(self.known) + len(missing) > len(self.proved) + REMEMBERED:
                    self.known = dict.fromkeys(self.proved, 1)
                    missing = {piece for pieces in split for piece in pieces if piece not in self.known}
                self.known |= {piece: len(ids) for piece, ids in self.merge(list(missing))}
            for text, pieces in zip(group, split, strict=True):
                if self.special(text):
                    yield len(self.tok.encode(text, add_special_tokens=False).ids)
                else:
                    yield sum(map(self.known.__getitem__, pieces))


def token_count(spark: SparkSession, text: Column, model_path: str) -> Column:
    """A column with the number of tokens of ``text``; null and empty texts have 0.

    What is broadcast is the model file and its proved words: bounded by the vocabulary.
    """
    with open(model_path, encoding="utf-8") as file:
        model = file.read()
    shipped = spark.sparkContext.broadcast((model, prove_whole_tokens(model), pretokens.differing_code_points()))

    @F.arrow_udf("long")
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        counter = TokenCounter(*shipped.value)
        for batch in batches:
            yield pa.array(counter(text.as_py() or "" for text in batch), pa.int64())

    return count(text)


def count_tokens(docs: DataFrame, model_path: str, text: str = "text", limit: int = 2048) -> DataFrame:
    """``docs`` with n_bytes, n_tokens and over_limit (more than ``limit`` tokens); one row for each row."""
    whole = F.coalesce(F.col(text), F.lit(""))
    return docs.withColumns(
        {"n_bytes": F.octet_length(whole).cast("long"), "n_tokens": token_count(docs.sparkSession, whole, model_path)}
    ).withColumn("over_limit", F.col("n_tokens") > limit)
