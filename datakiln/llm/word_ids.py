"""Token ids of texts under a lower-casing word-end vocabulary, as the tokenizers library gives them.

No match of the splitter spans white space, so a text's ids are those of its chunks between
white space, one after the other.  Chunks are looked up in what the worker remembers; those
of a group of texts that are new are split, and their new pieces merged by one call of the
library.  Texts that name an added token go through the library as they are.
"""

import functools
import json
import re
from collections.abc import Iterator

import numpy as np
from tokenizers import Tokenizer, pre_tokenizers

from datakiln.llm import pretokens
from datakiln.llm.token_counts import split_pattern

#: Chunks and pieces of chunks that a worker remembers before it starts afresh: some 200 bytes each.
REMEMBERED = 800_000
#: What ``str.split`` takes for white space and the library does not.
NOT_SPACE = re.compile("[\x1c-\x1f]").search


class WordEncoder:
    """Texts to the bytes of their ids, little-endian, in ``kind`` ("<u2" or "<u4")."""

    def __init__(self, text_of_model: str, suspects: str, kind: str) -> None:
        spec = json.loads(text_of_model)
        self.tok = Tokenizer.from_str(text_of_model)
        self.split = pretokens.Splitter(split_pattern(spec), suspects)
        self.added = pretokens.added_tokens(spec)
        self.words = Tokenizer(self.tok.model)
        self.words.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.kind = np.dtype(kind)
        #: The ids of chunks and of the pieces that chunks split into: a piece, taken as a chunk, splits into itself.
        self.known: dict[str, bytes] = {}

    def between_spaces(self, text: str) -> list[str]:
        """Normalised chunks; below `pretokens.PLAIN_BELOW` texts are composed and lower-case by code point."""
        if text.isascii() or not self.split.beyond(text):
            return text.lower().split() if not NOT_SPACE(text) else re.split(r"[\t-\r \x85\xa0]+", text.lower())
        return self.tok.normalizer.normalize_str(text).split(" ")

    def merged(self, pieces: list[str]) -> Iterator[bytes]:
        """The ids of each piece, from one call of the library."""
        coded = self.words.encode(pieces, is_pretokenized=True, add_special_tokens=False)
        ids = np.array(coded.ids, self.kind).tobytes()
        ends = np.cumsum(np.bincount(np.array(coded.word_ids, np.int64), minlength=len(pieces))) * self.kind.itemsize
        at = 0
        for end in ends.tolist():
            yield ids[at:end]
            at = end

    def learn(self, missing: set[str]) -> None:
        """Remember the ids of some chunks; those of ASCII letters alone are one piece each."""
        plain, split = [], {}
        for chunk in missing:
            if chunk.isascii() and chunk.isalpha():
                plain.append(chunk)
            else:
                split[chunk] = self.split(chunk)
        inside = set().union(*split.values())
        inside = {piece for piece in inside.difference(plain) if piece not in self.known}
        new = [*plain, *inside]
        self.known.update(zip(new, self.merged(new), strict=True))
        find = self.known.__getitem__
        self.known.update({chunk: b"".join(map(find, pieces)) for chunk, pieces in split.items()})

    def __call__(self, texts: Iterator[str]) -> Iterator[bytes]:
        for group in pretokens.groups(texts):
            find = self.known.get
            split = [[] if self.added(text) else self.between_spaces(text) for text in group]
            found: list[list[bytes | None]] = [list(map(find, chunks)) for chunks in split]
            open_ = [i for i, ids in enumerate(found) if None in ids]
            missing = {chunk for i in open_ for chunk, ids in zip(split[i], found[i], strict=True) if ids is None}
            if len(self.known) + 2 * len(missing) > REMEMBERED:
                self.known = {}  # what is found stays at hand until the group is done
            if missing:
                self.learn(missing)
            find = self.known.get
            for i in open_:
                found[i] = [find(chunk) if ids is None else ids for chunk, ids in zip(split[i], found[i], strict=True)]
            for text, chunks, ids in zip(group, split, found, strict=True):
                yield b"".join(ids) if chunks else self.packed(text)

    def packed(self, text: str) -> bytes:
        """The ids of a text without chunks, or with added tokens, by the library itself."""
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, self.kind).tobytes()


@functools.lru_cache(maxsize=1)
def encoder(text_of_model: str, suspects: str, kind: str) -> WordEncoder:
    """One encoder for each worker, which keeps what it remembers from task to task."""
    return WordEncoder(text_of_model, suspects, kind)


def prepared(model_path: str, end: int | None = None) -> tuple[str, str, str]:
    """What `encoder` needs, made once on the driver: the model file, suspect code points, and the bytes that an id takes."""
    with open(model_path, encoding="utf-8") as file:
        model = file.read()
    most = max([*Tokenizer.from_str(model).get_vocab(with_added_tokens=True).values(), end or 0])
    return model, pretokens.differing_code_points(), "<u2" if most < 1 << 16 else "<u4"
