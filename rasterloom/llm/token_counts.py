"""Exact token counts at every prefix, by dynamic programming over the merges of a byte-level BPE file.

In such a vocabulary the encoding of a byte string is the one sequence of tokens whose neighbours
are all compatible, that is, encode to themselves as a pair. So the last token of a prefix of
length i is the one token t that ends there and is compatible with the last token of the prefix of
length i - len(t), and count[i] = count[i - len(t)] + 1. One pass gives the count of every prefix. The
table is stored as the steps from prefix to prefix, which are small numbers, in rows of a bounded number of prefixes
with the count before the first and at the last; totals, truncation and budget questions read it and encode nothing.

The pre-tokenizer's pieces are independent, so tables are made per piece; the steps of a run of white space with what
follows it depend on nothing before, so they are kept in a bounded memo and strung together. Where a prefix changes the pieces themselves (inside a run of white space, a cut
contraction, a cut special token), the count at that prefix is that of the pieces it then has.

Defined results: a null text counts as empty; an empty text has 0 tokens; special strings inside a
text are single tokens, as the library takes them by default; repeated rows are counted each.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, only_memo, text_of
from .tokenizing import PLAIN, RUNS, batches, tokenizer_path

DEFAULT_FILE = "byte_bpe_50k.json"
#: Units remembered in one Python worker (and a fifth as many pieces), and the longest remembered.
MEMO, LONGEST = 500_000, 64
#: White space with what follows it.
UNITS = re.compile(r"\s*\S+|\s+")
#: Prefixes of a stored row.
ROW = 65_536
TABLE = "n_bytes bigint, start bigint, before bigint, last bigint, final boolean, kind string, steps binary"
#: The split of a plain text into pieces: the file's pattern, with the classes of PLAIN written out.
LETTER = "A-Za-zªµºÀ-ÖØ-öø-ÿ"
PIECES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTER}]+| ?[0-9]+| ?[^\s{LETTER}0-9]+|\s+(?!\S)|\s+")


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in byte-level files, as letter -> byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class PrefixCounter:
    """Token counts of all prefixes for one byte-level BPE file."""

    def __init__(self, name: str = DEFAULT_FILE):
        import ahocorasick
        from tokenizers import Tokenizer

        path = tokenizer_path(name)
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        self.library = Tokenizer.from_file(path)
        self.special = [t["content"] for t in told["added_tokens"]]
        self.at_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.letters = byte_letters()
        raw = lambda t: bytes(self.letters[c] for c in t)
        # A token's number is the order in which merging makes it; single bytes come first.
        self.token: dict[bytes, int] = {bytes([b]): b for b in range(256)}
        self.parts: list[tuple[int, int]] = [(b, b) for b in range(256)]
        self.merged: dict[tuple[int, int], int] = {}
        for merge in told["model"]["merges"]:
            a, b = (raw(x) for x in (merge.split(" ") if isinstance(merge, str) else merge))
            pair = (self.token[a], self.token[b])
            n = self.token.setdefault(a + b, len(self.parts))
            if n == len(self.parts):
                self.parts.append(pair)
            self.merged.setdefault(pair, n)
        self.alone: dict[int, bool] = dict.fromkeys(range(256), True)
        self.finder = ahocorasick.Automaton()
        for token, t in self.token.items():
            self.finder.add_word(token.decode("latin-1"), (t, len(token)))
        self.finder.make_automaton()
        self.forget()

    def forget(self) -> None:
        self.fits: dict[int, bool] = {}
        self.tables: dict[bytes, tuple[int, ...]] = {}
        self.units: dict[str, bytes] = {}

    def compatible(self, a: int, b: int) -> bool:
        """Whether the bytes of a and b together encode to a, b: no merge across the seam comes first."""
        key = a << 20 | b
        if (known := self.fits.get(key)) is None:
            if len(self.fits) > MEMO * 4:
                self.fits.clear()
            known = self.fits[key] = self._seam(a, b, len(self.parts))
        return known

    def _seam(self, left: int, right: int, before: int) -> bool:
        """Undo the merges on both sides of the seam from the last made to the first; in each state a
        merge across the seam that is made earlier than the one undone last would have come before it."""
        while True:
            across = self.merged.get((left, right))
            if across is not None and across < before:
                return False
            if left < 256 and right < 256:
                return True
            # Equal numbers: the left one is merged first, so the right one is undone first.
            if left >= 256 and (right < 256 or left > right):
                before, left = left, self.parts[left][1]
            else:
                before, right = right + 1, self.parts[right][0]

    def whole(self, t: int) -> bool:
        """Whether the token's own bytes encode to it alone."""
        if (known := self.alone.get(t)) is None:
            a, b = self.parts[t]
            known = self.alone[t] = self.whole(a) and self.whole(b) and self._seam(a, b, t)
        return known

    def table(self, piece: bytes) -> tuple[int, ...]:
        """Token counts of piece[:0], piece[:1], ... for one pre-tokenizer piece; the automaton tells the tokens that end
        at each byte, so no other bytes are tried, however long the piece."""
        if (known := self.tables.get(piece)) is not None:
            return known
        n = len(piece)
        last, count = [-1] * (n + 1), [0] * (n + 1)
        fits, alone = self.fits, self.alone
        for end, (t, length) in self.finder.iter(piece.decode("latin-1")):
            i = end + 1
            if last[i] >= 0:
                continue
            start = i - length
            if start:
                if (good := fits.get(last[start] << 20 | t)) is None:
                    good = self.compatible(last[start], t)
            elif (good := alone.get(t)) is None:
                good = self.whole(t)
            if good:
                last[i], count[i] = t, count[start] + 1
        if n <= LONGEST:
            if len(self.tables) > MEMO // 5:
                self.tables.clear()
            self.tables[piece] = tuple(count)
        return tuple(count)

    def pieces(self, text: str) -> list[str]:
        """The pre-tokenizer's pieces of a text without special strings."""
        if PLAIN.match(text):
            return PIECES.findall(text)
        return [text[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def _segments(self, text: str) -> list[str]:
        return self.at_special.split(text) if self.at_special else [text]

    def steps(self, text: str) -> np.ndarray:
        """The differences of prefixes(text), as one byte each if they fit."""
        if not PLAIN.match(text) or any(s in text for s in self.special):
            return narrow(np.diff(self.prefixes(text)))
        if any(r in text for r in RUNS):
            units = UNITS.findall(text)
        else:  # the spaces are single: the same units by a plain split
            head, *rest = text.split(" ")
            units = [head, *(" " + c for c in rest)]
        known = self.units
        try:
            return np.frombuffer(b"".join(map(known.__getitem__, units)), "i1")
        except KeyError:
            if len(known) > MEMO:
                known.clear()
            once: dict[str, np.ndarray] = {}
            for u in units:
                if u not in known and u not in once:
                    made = self._unit_steps(u)
                    if len(u) <= LONGEST and isinstance(made, bytes):
                        known[u] = made
                    else:
                        once[u] = np.frombuffer(made, "i1") if isinstance(made, bytes) else made
            if not once:
                return np.frombuffer(b"".join(map(known.__getitem__, units)), "i1")
            return np.concatenate([once[u] if u in once else np.frombuffer(known[u], "i1") for u in units])

    def _unit_steps(self, unit: str) -> bytes | np.ndarray:
        """The steps of a unit: bytes where each is below 128, else numbers."""
        if not unit[:2].isspace() and "'" not in unit and len(unit) <= LONGEST:
            out = bytearray()  # pieces of letters, digits or signs, none of which a cut prefix splits anew
            for piece in PIECES.findall(unit):
                table = self.table(piece.encode())
                if not piece.isascii():  # a plain sign beyond ASCII has two bytes
                    ends, at = [0], 0
                    for c in piece:
                        at += 1 if c < "\x80" else 2
                        ends.append(at)
                    table = [table[at] for at in ends]
                out += bytes([b - a & 255 for a, b in zip(table, table[1:])])
            return bytes(out)
        made = narrow(np.diff(self.prefixes(unit)))
        return made.tobytes() if made.dtype == np.int8 else made

    def count(self, text: str) -> int:
        """Tokens of the whole text."""
        return int(self.steps(text).sum(dtype="i8"))

    def prefixes(self, text: str) -> np.ndarray:
        """Token counts of text[:0] ... text[:len(text)], each as the library would count that prefix."""
        out, done = [0], 0
        previous = ""  # the piece before, which a cut special token's first signs may join
        before_previous = 0
        for segment in self._segments(text):
            if segment in self.special:
                for cut in range(1, len(segment)):
                    tail = self.pieces(previous + segment[:cut])
                    out.append(before_previous + sum(self.table(p.encode())[-1] for p in tail))
                done += 1
                out.append(done)
                previous, before_previous = "", done
                continue
            run = ""  # the white-space piece just before
            for piece in self.pieces(segment):
                table = self.table(piece.encode())
                at = 0
                for k, c in enumerate(piece):
                    at += len(c.encode())
                    out.append(done + table[at])
                    if k == 0 and run and c.isspace():  # this prefix ends in white space: the run is one piece
                        out[-1] = before_previous + self.table((run + c).encode())[-1]
                    elif k == 1 and len(piece) == 3 and piece in ("'re", "'ve", "'ll"):
                        out[-1] = done + 2
                previous, before_previous = (piece, done) if not (run and piece.isspace()) else (run + piece, before_previous)
                done += table[-1]
                run = previous if previous.isspace() else ""
        return np.array(out, "int32")


def narrow(steps: np.ndarray) -> np.ndarray:
    return steps.astype("i1" if not len(steps) or np.abs(steps).max() < 128 else "<i4")


@lru_cache(maxsize=2)
def prefix_counter(name: str) -> PrefixCounter:
    return PrefixCounter(name)


def prefix_tables(df: DataFrame, name: str = DEFAULT_FILE, row: int = ROW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The stored table: id and, for each row of prefixes, n_bytes of the text, start (code points of the prefix before
    the first), before (its tokens), last (tokens of the row's last prefix), final (whether that is the text) and the steps.

    A long text has several rows of at most `row` prefixes, so no row grows without bound.
    """

    def tabulate(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = prefix_counter(name)
        only_memo("prefixes-" + name, counter.forget)
        for part in parts:
            ids, texts, sizes = (part.column(i).to_pylist() for i in range(3))
            for a, b in batches(texts, 4_000_000):
                rows = []
                for i, t, n in zip(ids[a:b], texts[a:b], sizes[a:b]):
                    steps, before = counter.steps(t), 0
                    for start in range(0, max(len(steps), 1), row):
                        some = steps[start : start + row]
                        last = before + int(some.sum(dtype="i8"))
                        rows.append((i, n, start, before, last, start + row >= len(steps), some.dtype.str, zlib.compress(some.tobytes(), 1)))
                        before = last
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[id_col, "n_bytes", "start", "before", "last", "final", "kind", "steps"])

    narrowed = df.select(F.col(id_col).cast("bigint").alias(id_col), text_of(text_col).alias("text"), F.octet_length(text_of(text_col)).cast("bigint").alias("n_bytes"))
    return narrowed.mapInArrow(tabulate, f"{id_col} bigint, {TABLE}")


def _counts(before: int, kind: str, steps: bytes) -> np.ndarray:
    """Tokens of a stored row's prefixes, that before the first included."""
    return before + np.concatenate([[0], np.cumsum(np.frombuffer(zlib.decompress(steps), kind), dtype="i8")])


def token_counts(df: DataFrame, name: str = DEFAULT_FILE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, n_tokens of every row of df, whole texts, read from the stored table."""
    return totals(materialise(prefix_tables(df, name, id_col=id_col, text_col=text_col), "prefix-tables"), id_col)


def totals(tables: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id, n_bytes, n_tokens of every text; the steps are not read."""
    return tables.where("final").select(id_col, "n_bytes", F.col("last").alias("n_tokens"))


def fit_budget(tables: DataFrame, budget: int, id_col: str = "doc_id") -> DataFrame:
    """id, fits: the most code points of each text whose prefix has at most budget tokens; reads the table alone."""

    def fit(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            best = []
            for start, *stored in zip(*(part.column(i).to_pylist() for i in range(1, 5))):
                within = np.flatnonzero(_counts(*stored) <= budget)
                best.append(start + int(within[-1]) if len(within) else None)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(best, pa.int64())], names=[id_col, "fits"])

    return tables.select(id_col, "start", "before", "kind", "steps").mapInArrow(fit, f"{id_col} bigint, fits bigint").groupBy(id_col).agg(F.max("fits").alias("fits"))


def tokens_at(tables: DataFrame, asked: DataFrame, row: int = ROW, id_col: str = "doc_id") -> DataFrame:
    """asked (id, length) with n_tokens, the tokens of that prefix, which is no longer than the text; one equi-join, no encoding."""

    def look(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            found = [int(_counts(*stored)[length - start]) for length, start, *stored in zip(*(part.column(i).to_pylist() for i in range(1, 6)))]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(found, pa.int64())], names=[id_col, "length", "n_tokens"])

    # The last prefix of a row is also the one before the next: the row that ends with it tells it.
    at = asked.select(F.col(id_col), F.col("length").cast("bigint").alias("length"), (F.floor(F.greatest(F.col("length") - 1, F.lit(0)) / row) * row).alias("start"))
    return at.join(tables, [id_col, "start"]).select(id_col, "length", "start", "before", "kind", "steps").mapInArrow(look, f"{id_col} bigint, length bigint, n_tokens bigint")
