"""Vocabulary files of public tokenizers, as parameters: read on the driver, sent to workers once."""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import islice

from pyspark.sql import SparkSession

#: Texts longer than this are cut into pre-tokens lazily, so memory doesn't grow with them.
LAZY_CHARS = 1_000_000
LAZY_PIECES = 100_000


def read_file(path: str) -> bytes:
    """A vocabulary file's content (about 1 MB, whatever the corpus)."""
    with open(path, "rb") as f:
        return f.read()


def broadcast_file(spark: SparkSession, path: str):
    return spark.sparkContext.broadcast(read_file(path))


@lru_cache(maxsize=4)
def ranks_of(content: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in content.splitlines() if line)}


@lru_cache(maxsize=1)
def unlike_letters() -> str:
    """A character class of what ``regex`` takes for letters or digits and tiktoken does not.

    Both follow the Unicode data they were built with; asking each about every code point (a second
    on the driver) tells where those differ.
    """
    import regex
    import tiktoken

    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    single, unlike = {bytes([b]): b for b in range(256)}, set()
    for kind in (r"\p{L}", r"\p{N}"):
        kept = tiktoken.Encoding("one", pat_str=kind, mergeable_ranks=single, special_tokens={}).encode_ordinary(every)
        unlike |= set(regex.findall(kind, every)) - set(bytes(kept).decode())
    runs: list[list[int]] = []
    for c in sorted(map(ord, unlike)):
        if runs and runs[-1][1] == c - 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in runs)


@lru_cache(maxsize=4)
def splitter(pattern: str, unlike: str = "") -> Callable[[str], Iterator[list[str]]]:
    """text -> lists of its pre-tokens in order; one list unless the text is very long.

    Characters of the class ``unlike`` count as neither letters, digits nor white space.
    """
    import re

    import regex

    compiled = regex.compile(pattern)
    other = re.compile(f"[{unlike}]") if unlike else None

    def split(text: str) -> Iterator[list[str]]:
        if other and not text.isascii() and other.search(text):
            # a noncharacter stands in for each while the text is cut
            found = (text[m.start() : m.end()] for m in compiled.finditer(other.sub("\uffff", text)))
        elif len(text) <= LAZY_CHARS:
            yield compiled.findall(text)
            return
        else:
            found = (m.group() for m in compiled.finditer(text))
        while part := list(islice(found, LAZY_PIECES)):
            yield part

    return split


def release() -> None:
    """Gives memory back to the system, as a worker outlives its task and serves other operators."""
    import ctypes
    import gc

    ranks_of.cache_clear()
    gc.collect()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


class Memo(dict):
    """A cache bounded by bytes: two generations, the older one is dropped when the younger is full."""

    #: Bytes that an entry takes besides its key and value: two object heads, a slot and its share of free slots.
    ENTRY = 150

    def __init__(self, compute: Callable, most: int = 24 << 20, longest: int = 64):
        super().__init__()
        self.compute, self.most, self.longest, self.old, self.room = compute, most, longest, {}, most

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
            if len(key) > self.longest:
                return value
        if self.room <= 0:
            self.old = {}
            self.old.update(self)
            self.clear()
            self.room = self.most
        self.room -= self.ENTRY + len(key) + (len(value) if isinstance(value, bytes) else 0)
        self[key] = value
        return value
