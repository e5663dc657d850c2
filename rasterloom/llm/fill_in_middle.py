"""Fill-in-middle: texts cut at two token edges and rearranged, by counting edges in chunks.

A token is `[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+`, matched from left to right. So a token
ends exactly where a character that is no white space meets one that is: whether a place is an edge
depends on two neighbours alone. Each text is cut into chunks of CHUNK bytes that overlap by the byte
before them, the edges of all chunks are counted at once, the counts' prefix sums say which chunk owns
a cut, and that chunk alone is scanned again for the place. White space is ASCII, so bytes serve as
characters do. Texts never move: one map over Arrow batches, in which no text is split into tokens.

The two cuts, the form and its order come from the sha256 of the seed and the id, in DataFrame
functions. restored() is the inverse: a text that is not plain contains no marker, and a marker can't
arise across a seam, as each ends with the only `>` it has; so the markers cut the output into its parts.

Defined results: a null text counts as empty and is plain with no tokens; a text that contains a
marker is plain; a null id is hashed as no digits; rows that repeat an id are cut by the same numbers,
each for its own text; white space alone is one token; no rows give no rows; other columns are carried,
whatever their names (those added begin with `fim_`).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITESPACE, only_memo, text_of

#: What marks prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Bytes of a chunk.
CHUNK = 2048
#: Of 100 texts, so many are rearranged, and of 100 of those so many have the suffix first.
RATE, SUFFIX_FIRST = 50, 80
SEED = 42

ADDED = "fim_n long, fim_prefix_chars long, fim_middle_chars long, fim_output string"


class Chunks:
    """The chunks of the texts that lie in raw between edges, and the number of token edges in each."""

    def __init__(self, raw: np.ndarray, edges: np.ndarray, size: int = CHUNK):
        self.raw, self.edges = raw, edges
        self.space = np.zeros(256, bool)
        self.space[[ord(c) for c in WHITESPACE]] = True
        length = np.diff(edges)
        many = -(-length // size)  # chunks of each text
        self.first = np.concatenate([[0], np.cumsum(many)])
        text = np.repeat(np.arange(len(length)), many)
        self.begin = edges[text] + size * (np.arange(len(text)) - self.first[text])
        self.end = np.minimum(self.begin + size, edges[text + 1])
        self.fresh = self.begin == edges[text]  # no byte of the text lies before
        self.total = np.zeros(len(text) + 1, "i8")
        if len(text):
            blank = self.space[raw]
            edge = np.zeros(len(raw), "u1")
            np.logical_and(~blank[:-1], blank[1:], out=edge[1:].view(bool))
            edge[self.begin[self.fresh]] = 0
            spans = np.ravel(np.column_stack([self.begin, self.end]))
            spans = spans[:-1] if spans[-1] == len(raw) else spans
            np.cumsum(np.add.reduceat(edge, spans, dtype="i8")[::2], out=self.total[1:])

    def tokens(self) -> np.ndarray:
        """Tokens of each text: its edges and one, none in an empty text."""
        return self.total[self.first[1:]] - self.total[self.first[:-1]] + (np.diff(self.edges) > 0)

    def places(self, text: np.ndarray, rank: np.ndarray, tokens: np.ndarray) -> np.ndarray:
        """Where in raw the first rank tokens of each text end."""
        out = np.where(rank == 0, self.edges[text], self.edges[text + 1])
        inner = np.flatnonzero((rank > 0) & (rank < tokens[text]))
        wanted = self.total[self.first[text[inner]]] + rank[inner]
        owner = np.searchsorted(self.total, wanted, "left") - 1
        for i, chunk, left in zip(inner, owner, wanted - self.total[owner]):
            out[i] = self.scan(chunk)[left - 1]
        return out

    def scan(self, chunk: int) -> np.ndarray:
        """The edges of one chunk, found again, with the byte before it in view."""
        from_ = self.begin[chunk] - (0 if self.fresh[chunk] else 1)
        blank = self.space[self.raw[from_ : self.end[chunk]]]
        return from_ + 1 + np.flatnonzero(~blank[:-1] & blank[1:])


def rearrange(text: pa.Array, first: np.ndarray, second: np.ndarray, form: list[str], size: int = CHUNK) -> tuple[np.ndarray, list, list, list]:
    """(tokens, prefix and middle in characters, output) of every text; first and second are reduced to its number of tokens."""
    text = text.cast(pa.large_string())
    buffers = text.buffers()
    edges = np.frombuffer(buffers[1], "i8")[text.offset : text.offset + len(text) + 1]
    raw = (np.frombuffer(buffers[2], "u1") if buffers[2] is not None else np.zeros(0, "u1"))[edges[0] : edges[-1]]
    edges = edges - edges[0]
    chunks = Chunks(raw, edges, size)
    n = chunks.tokens()
    moved = np.flatnonzero([f != "plain" for f in form])
    a, b = first[moved] % (n[moved] + 1), second[moved] % (n[moved] + 1)
    cut = [chunks.places(moved, k, n) for k in (np.minimum(a, b), np.maximum(a, b))]
    whole = memoryview(raw)
    chars = lambda x, y: int(np.count_nonzero((raw[x:y] & 0xC0) != 0x80))  # noqa: E731  bytes that begin a character
    prefix, middle, output = [None] * len(text), [None] * len(text), [None] * len(text)
    for i in np.flatnonzero([f == "plain" for f in form]):
        output[i] = whole[edges[i] : edges[i + 1]].tobytes()
    for i, x, y in zip(moved, *cut):
        p, m, s = whole[edges[i] : x], whole[x:y], whole[y : edges[i + 1]]
        parts = (PREFIX.encode(), p, SUFFIX.encode(), s) if form[i] == "psm" else (SUFFIX.encode(), s, PREFIX.encode(), p)
        output[i] = b"".join((*parts, MIDDLE.encode(), m))
        prefix[i], middle[i] = chars(edges[i], x), chars(x, y)
    return n, prefix, middle, output


def drawn(id_col: str, seed: int = SEED) -> list[Column]:
    """Four unsigned numbers from the sha256 of the seed and the id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def fill_in_middle(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """df's columns with fim_form, fim_n, fim_prefix_chars, fim_middle_chars and fim_output, the rearranged text."""
    h1, h2, h3, h4 = drawn(id_col, seed)
    text = text_of(text_col)
    plain = (text == "") | F.contains(text, F.lit(PREFIX)) | F.contains(text, F.lit(SUFFIX)) | F.contains(text, F.lit(MIDDLE)) | (h3 % 100 >= rate)
    form = F.when(plain, "plain").when(h4 % 100 < suffix_first, "spm").otherwise("psm")
    ready = df.select(*df.columns, form.alias("fim_form"), text.alias("__text"), h1.alias("__h1"), h2.alias("__h2"))
    kept = [*df.columns, "fim_form"]

    def cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only_memo("fill-in-middle")
        for part in parts:
            if part.num_rows:
                n, prefix, middle, output = rearrange(part.column("__text"), part.column("__h1").to_numpy(), part.column("__h2").to_numpy(), part.column("fim_form").to_pylist())
                added = [pa.array(n), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.string())]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(kept)], *added], names=[*kept, *(a.split()[0] for a in ADDED.split(", "))])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ready.select(*kept).schema)
    return ready.mapInArrow(cut, f"{schema}, {ADDED}")


def restored(output: Column, form: Column) -> Column:
    """The text of which output was made."""
    part = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    return F.when(form == "plain", output).when(form == "psm", F.concat(part[1], part[3], part[2])).otherwise(F.concat(part[2], part[3], part[1]))
