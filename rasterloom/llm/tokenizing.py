"""Whole-text token ids from a public tokenizer file, with a bounded memo of word chunks.

A text whose characters are plain (see PLAIN) is cut at white space into chunks that the file's
pre-tokenizer never joins; a chunk's ids are computed by the library once and then looked up. New
chunks go to the library many in a text, with marks between them by which the ids are told apart. Any
other text, and any text that holds a special token's string, goes to the library whole. All
ways give the ids of Tokenizer.encode(text, add_special_tokens=False).
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np

from .common import only_memo, single_threaded

#: Characters on whose class (letter, digit, space, other) and lower case all Unicode versions agree.
PLAIN = re.compile(r"[\t\n\r\x20-\x7e\xa1-\xa9\xab\xac\xae-\xb1\xb4\xb6-\xb8\xbb\xbf-\xff]*\Z")
#: Pairs that may be part of a run of white space in which a space is neither first nor last.
RUNS = ("  ", "\n ", "\t ", "\r ")
#: Plain characters that are neither white space nor letters nor digits.
TAIL = "".join(c for c in map(chr, range(33, 256)) if PLAIN.match(c) and not c.isalnum())
CHUNKS = re.compile(r"\s+(?!\S)|\s?\S+")
#: Bytes, as estimated, in a generation of the memo, of which a Python worker holds two.
MEMO_BYTES = 64 << 20
#: Characters that the library encodes at once: what it returns of each text is many times the ids.
ENCODED = 200_000
#: Chunks that are one text to the library, as a text costs it more than the ids of a chunk.
JOINED = 256
#: What stands before each of them. Byte-level files: the space that is a chunk's own. Word files: a number that
#: is not plain, as their pre-tokenizers keep every digit apart.
SPACE, NUMBER = " ", "\xb2"


def tokenizer_path(name: str) -> str:
    """The place of a public tokenizer file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


class Memo(dict):
    """The ids of chunks; those asked for and not there are given as None and gathered."""

    def __init__(self):
        super().__init__()
        self.new: set[str] = set()

    def __missing__(self, chunk: str) -> None:
        self.new.add(chunk)


class ChunkTokenizer:
    """ids(texts) for byte-level files that keep white space and for word files that drop it."""

    def __init__(self, name: str):
        single_threaded()
        from tokenizers import Tokenizer

        path = tokenizer_path(name)
        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        self.special = [t["content"] for t in told["added_tokens"]]
        self.words = told["model"].get("end_of_word_suffix") is not None
        self.mark = NUMBER if self.words else SPACE
        #: By id: whether a chunk begins there. Empty where chunks can't be told apart.
        self.marks = np.zeros(self.library.get_vocab_size(), bool)
        if self.words:
            self.marks[self.library.encode(NUMBER, add_special_tokens=False).ids] = True
        else:
            self.marks[[i for token, i in told["model"]["vocab"].items() if token.startswith("\u0120")]] = True  # the byte of a space
        if any(self.mark in s for s in self.special) or self.words and self.marks.sum() != 1:
            self.marks = self.marks[:0]
        self.forget()

    def forget(self) -> None:
        self.inner, self.first = Memo(), Memo()
        self.old: tuple[dict[str, bytes], dict[str, bytes]] = ({}, {})
        self.held = 0

    def _encode(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for start, end in batches(texts, ENCODED):
            out += [np.array(e.ids, "<u4").tobytes() for e in self.library.encode_batch_fast(texts[start:end], add_special_tokens=False)]
        return out

    def _encode_inner(self, chunks: list[str]) -> dict[str, bytes]:
        """The ids of chunks that stand after white space."""
        prefix = "" if self.words else SPACE
        alone = chunks
        out: dict[str, bytes] = {}
        if len(self.marks):
            # White space at a chunk's ends would meet the next one's space.
            alone = [c for c in chunks if not c or c.strip() != c]
            joined = [c for c in chunks if c and c.strip() == c] if alone else chunks
            groups = [joined[i : i + JOINED] for i in range(0, len(joined), JOINED)]
            for group, raw in zip(groups, self._encode([self.mark + self.mark.join(g) for g in groups])):
                at = 4 * np.flatnonzero(self.marks[np.frombuffer(raw, "<u4")])
                if len(at) != len(group):
                    alone = alone + group
                    continue
                edges = [*at.tolist(), len(raw)]
                own = 4 if self.words else 0  # a number is no part of the chunk, a space is
                out.update((c, raw[a + own : b]) for c, a, b in zip(group, edges, edges[1:]))
        out.update(zip(alone, self._encode([prefix + c for c in alone])))
        return out

    def _keep(self, memo: Memo, learned: dict[str, bytes]) -> None:
        self.held += 130 * len(learned) + 5 * sum(map(len, learned))  # a key, an entry, and ids of four bytes
        memo.update(learned)

    def _learn(self) -> dict[str, bytes]:
        """Keep the ids of the chunks that were asked for and not there; those of the inner ones are returned."""
        inner, first, (old, old_first) = self.inner, self.first, self.old
        new, inner.new = inner.new, set()
        fresh = {c: old[c] for c in new if c in old}
        new.difference_update(fresh)
        # What stands behind the last letter or digit is apart to the pre-tokenizers, so it is a chunk of its own.
        cut = [(c, stem, c[len(stem) :]) for c in new if (stem := c.rstrip(TAIL)) != c and stem[-1:].isalnum()]
        new.difference_update([c for c, _, _ in cut])
        stems = {}
        for _, stem, tail in cut:
            first[tail]
            if stem not in new and stem not in fresh and stem not in stems:
                if (known := inner.get(stem) or old.get(stem)) is None:
                    new.add(stem)
                else:
                    stems[stem] = known
        asked, first.new = first.new, set()
        back = {c: old_first[c] for c in asked if c in old_first}
        asked = [c for c in asked if c not in back]
        self._keep(first, back | dict(zip(asked, self._encode(asked))))
        fresh.update(self._encode_inner(list(new)))
        fresh.update([(c, (fresh.get(stem) or stems[stem]) + first[tail]) for c, stem, tail in cut])
        self._keep(inner, fresh)
        return fresh

    def _chunks(self, text: str) -> tuple[Memo, list[str]] | None:
        """The chunks of a plain text without special tokens, where they are looked up; the first of a byte-level text is no inner one."""
        if not PLAIN.match(text) or any(s in text for s in self.special):
            return None
        if self.words:
            text = text.lower()
            # A chunk is lower-cased before the library looks for special tokens, a text is not.
            return None if any(s in text for s in self.special) else (self.inner, text.split())
        if any(r in text for r in RUNS):
            return self.first, CHUNKS.findall(text)
        return self.inner, text.split(SPACE)

    def ids(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        if self.held > MEMO_BYTES:
            self.old, self.inner, self.first, self.held = (self.inner, self.first), Memo(), Memo(), 0  # what comes back stays
        out: list = []
        open_: list[tuple[int, Memo, list[str], list]] = []  # texts that wait for chunks
        whole: list[int] = []
        for i, text in enumerate(texts):
            if (cut := self._chunks(text)) is None:
                whole.append(i)
                out.append(None)
                continue
            memo, chunks = cut
            found = list(map(memo.__getitem__, chunks))
            if memo is self.inner and not self.words:
                found[0] = self.first[chunks[0]]
            if None in found:
                open_.append((i, memo, chunks, found))
                out.append(None)
            else:
                out.append(b"".join(found))
        fresh = self._learn()
        for i, memo, chunks, found in open_:
            if found[0] is None and not self.words:
                found[0] = self.first[chunks[0]]
            learned = fresh if memo is self.inner else memo
            for k in [k for k, b in enumerate(found) if b is None]:
                found[k] = learned[chunks[k]]
            out[i] = b"".join(found)
        for i, coded in zip(whole, self._encode([texts[i] for i in whole])):
            out[i] = coded
        return out


@lru_cache(maxsize=4)
def chunk_tokenizer(name: str) -> ChunkTokenizer:
    """One a worker and file."""
    return ChunkTokenizer(name)


def coder_for(name: str) -> ChunkTokenizer:
    """The worker's tokenizer at the start of a task; it lives, with its memo, until another operator's task."""
    only_memo("tokens-" + name, chunk_tokenizer.cache_clear)
    return chunk_tokenizer(name)


def batches(texts: list[str], most: int = 4_000_000):
    """Runs of texts of about most characters, as (start, end)."""
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield start, i
            start, size = i, 0
        size += len(t)
    if texts:
        yield start, len(texts)
