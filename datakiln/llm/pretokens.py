"""Pre-token patterns in Python, proved equal to the tokenizer libraries' own splitting.

The ``regex`` module knows newer Unicode tables than the libraries' pattern engine.
`differing_code_points` finds every code point that the two put into different classes;
texts without such a code point may be split by ``regex``, the rest by the library.
"""

import functools
import re
from collections.abc import Callable, Iterable, Iterator

import regex
from tokenizers import Regex, Tokenizer, models, pre_tokenizers

CLASSES = (r"\p{L}", r"\p{N}", r"\s")


@functools.lru_cache(maxsize=1)
def differing_code_points() -> str:
    """A character class of the code points on which ``regex`` and the library differ; '' if none."""
    space = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    odd: set[str] = set()
    for kind in CLASSES:
        split = pre_tokenizers.Split(Regex(kind), "removed", invert=True)
        theirs = set("".join(piece for piece, _ in split.pre_tokenize_str(space)))
        odd |= theirs ^ set(regex.findall(kind, space))
    codes, runs = sorted(map(ord, odd)), []
    for code in codes:
        if runs and code == runs[-1][1] + 1:
            runs[-1][1] = code
        else:
            runs.append([code, code])
    return "[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in runs) + "]" if runs else ""


#: Code points below this are split by ``re`` with the classes written out, which is faster still.
PLAIN_BELOW = 0x300


def written_out(pattern: str) -> str:
    """A splitter's pattern with its Unicode classes written as the ranges below `PLAIN_BELOW`."""
    ranges = {r"\s": r"\t-\r \x85\xa0"}
    for kind in (r"\p{L}", r"\p{N}"):
        codes = [c for c in range(PLAIN_BELOW) if regex.match(kind, chr(c))]
        ranges[kind] = "".join(f"\\u{c:04x}" for c in codes)
    out, inside = [], False
    for part in re.findall(r"\\p\{\w\}|\\.|.", pattern, re.DOTALL):
        if part in ranges:
            part = ranges[part] if inside else f"[{ranges[part]}]"
        elif part == r"\S":
            part = f"[^{ranges[r'\s']}]"
        elif part in "[]":
            inside = part == "["
        out.append(part)
    return "".join(out)


class Splitter:
    """The pieces of a text that match ``pattern``, as the library's pattern engine finds them."""

    def __init__(self, pattern: str, suspects: str) -> None:
        self.plain: Callable[[str], list[str]] = re.compile(written_out(pattern)).findall
        self.find: Callable[[str], list[str]] = regex.compile(pattern).findall
        self.beyond = re.compile(f"[^\x00-{chr(PLAIN_BELOW - 1)}]").search
        self.suspect = regex.compile(suspects).search if suspects else lambda text: None
        self.split = pre_tokenizers.Split(Regex(pattern), "removed", invert=True)

    def __call__(self, text: str) -> list[str]:
        if text.isascii() or not self.beyond(text):
            return self.plain(text)
        if self.suspect(text):
            return [piece for piece, _ in self.split.pre_tokenize_str(text)]
        return self.find(text)


@functools.lru_cache(maxsize=1)
def byte_chars() -> dict[int, str]:
    """Byte value to the printable character that byte-level vocabularies write for it.

    Printable Latin-1 bytes stand for themselves, the others take the characters from
    U+0100 on in order.
    """
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


def to_chars(data: bytes) -> str:
    """Bytes as the characters of a byte-level vocabulary."""
    return data.decode("latin-1").translate(byte_chars())


@functools.lru_cache(maxsize=1)
def char_bytes() -> dict[str, int]:
    """`byte_chars` reversed."""
    return {c: b for b, c in byte_chars().items()}


def from_chars(piece: str) -> bytes:
    """The reverse of `to_chars`; a KeyError for a character that stands for no byte."""
    return bytes(map(char_bytes().__getitem__, piece))


def added_tokens(spec: dict) -> Callable[[str], object]:
    """A search for the strings that the model looks for in raw text before all else."""
    added = spec["added_tokens"]
    if any(t["normalized"] or t["single_word"] for t in added):
        raise ValueError("added tokens that match other than their very string are not supported")
    return re.compile("|".join(re.escape(t["content"]) for t in added)).search if added else lambda text: None


#: Characters of text that are split together before their unknown pieces are merged.
GROUP_CHARS = 1_000_000


def groups(texts: Iterable[str]) -> Iterator[list[str]]:
    """Texts in lists of about `GROUP_CHARS` characters, so that memory does not follow the batch size."""
    group, size = [], 0
    for text in texts:
        group.append(text)
        size += len(text)
        if size >= GROUP_CHARS:
            yield group
            group, size = [], 0
    if group:
        yield group


def words_merger(model: models.BPE) -> Callable[[list[str]], Iterator[tuple[str, list[int]]]]:
    """A function from pieces of text to (piece, ids): one call of the library for all of them."""
    tok = Tokenizer(model)
    tok.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)

    def merge(pieces: list[str]) -> Iterator[tuple[str, list[int]]]:
        coded = tok.encode(pieces, is_pretokenized=True, add_special_tokens=False)
        ids, owners, start = coded.ids, coded.word_ids, 0
        for end in range(1, len(ids) + 1):
            if end == len(ids) or owners[end] != owners[start]:
                yield pieces[owners[start]], ids[start:end]
                start = end

    return merge
