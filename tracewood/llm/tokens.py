"""Encoding of whole texts with a public byte-pair vocabulary.

Forced-boundary splitting: a pair of bytes that occurs inside no vocabulary token can never be merged, so the place between
them is a certain cut. Every text is cut at all its certain places (nearly every word is a fragment), found over the bytes of
a whole batch at once with a table of 256 x 256 pairs. Equal fragments are encoded once, and the ids of all fragments are
gathered back in order, so the result equals that of the whole text. A stretch without a certain place, such as a long run of one
letter, is one fragment; merging it takes n log n steps.

The pattern that splits text before the merges looks at characters around a place, so a cut is only taken where it sees
the same on both sides: after a character that is no white space (white space looks ahead) and not before an apostrophe
(which could begin a contraction that it didn't begin in the whole text).
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pattern published with the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
WINDOW = 16 << 20  # bytes of text that are worked on at once (a longer text is taken whole)
REMEMBERED = 500_000  # fragments whose ids a process keeps; only a cache
# White space of more than one byte in UTF-8.
_WIDE_SPACES = np.array([int.from_bytes(c.encode()) for c in "\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B)))], dtype=np.uint32)

_coders: dict[str, Coder] = {}


class Coder:
    """A vocabulary with its certain cuts. One per worker process and vocabulary file."""

    def __init__(self, vocabulary: str) -> None:
        import tiktoken

        with open(vocabulary, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.coding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        joined = np.zeros((256, 256), dtype=bool)  # pairs that may be merged or that the pattern looks across
        for token in ranks:
            for a, b in zip(token, token[1:], strict=False):
                joined[a, b] = True
        joined[[*range(9, 14), *range(28, 33)], :] = True
        joined[:, ord("'")] = True
        joined[:, 0x80:0xC0] = True  # inside a character
        self.free = ~joined.ravel()
        self.known: dict[bytes, np.ndarray] = {}

    def cuts(self, data: np.ndarray) -> np.ndarray:
        """Certain places in a run of UTF-8 bytes: the offsets of the bytes before which it may be cut."""
        pair = data[:-1].astype(np.uint16)
        pair <<= 8
        pair |= data[1:]
        places = np.flatnonzero(self.free[pair]) + 1
        wide = np.flatnonzero(data[places - 1] >= 0x80)
        if len(wide):  # white space of several bytes looks ahead as well
            at = places[wide]
            last = np.stack([data[np.maximum(at - k, 0)] for k in (3, 2, 1)], axis=1).astype(np.uint32) @ np.array([65536, 256, 1], dtype=np.uint32)
            space = np.isin(last, _WIDE_SPACES) | np.isin(last & 0xFFFF, _WIDE_SPACES)
            places = np.delete(places, wide[space])
        return places

    def fragments(self, text: str) -> list[str]:
        """The text in pieces, cut at every certain place."""
        data = np.frombuffer(text.encode(), dtype=np.uint8)
        places = [0, *self.cuts(data), len(data)] if len(data) else [0]
        return [data[a:b].tobytes().decode() for a, b in zip(places, places[1:], strict=False)]

    def _window(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of some texts end to end and the number of ids of each."""
        bounds = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        raw = texts.buffers()[2]
        if raw is None or bounds[0] == bounds[-1]:
            return np.zeros(0, dtype=np.int32), np.zeros(len(texts), dtype=np.int64)
        data = np.frombuffer(raw, dtype=np.uint8)[bounds[0] : bounds[-1]]
        bounds = bounds - bounds[0]
        mark = np.zeros(len(data) + 1, dtype=bool)
        mark[self.cuts(data)] = True
        mark[bounds] = True  # every text begins a fragment
        starts = np.flatnonzero(mark)
        offsets = pa.py_buffer(starts.astype(np.int32))
        pieces = pa.Array.from_buffers(pa.binary(), len(starts) - 1, [None, offsets, pa.py_buffer(data)]).dictionary_encode()
        if len(self.known) > REMEMBERED:
            self.known.clear()
        known, ids = self.known, []
        for piece in pieces.dictionary.to_pylist():
            got = known.get(piece)
            if got is None:
                known[piece] = got = np.asarray(self.coding.encode_ordinary(piece.decode("utf-8", "replace")), dtype=np.int32)
            ids.append(got)
        sizes = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
        index = pieces.indices.to_numpy()
        counts = sizes[index]
        ends = np.cumsum(counts)
        first = (np.cumsum(sizes) - sizes)[index]
        flat = np.concatenate(ids)[np.repeat(first - (ends - counts), counts) + np.arange(ends[-1])]
        upto = np.concatenate([[0], ends])[np.searchsorted(starts, bounds)]
        return flat, np.diff(upto)

    def encode(self, texts: pa.Array | list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and the offsets of each; null and empty texts have none."""
        texts = pa.array(texts, pa.string()) if isinstance(texts, list) else texts.cast(pa.string())
        if texts.null_count:
            texts = texts.fill_null("")
        if not len(texts):
            return np.zeros(0, dtype=np.int32), np.zeros(1, dtype=np.int64)
        bounds = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1]
        parts, at = [], 0
        while at < len(texts):
            end = max(at + 1, int(np.searchsorted(bounds, bounds[at] + WINDOW, side="right")) - 1)
            parts.append(self._window(texts.slice(at, end - at)))
            at = end
        return np.concatenate([p[0] for p in parts]), np.concatenate([[0], np.cumsum(np.concatenate([p[1] for p in parts]))])


def coder(vocabulary: str = VOCABULARY) -> Coder:
    if vocabulary not in _coders:
        _coders[vocabulary] = Coder(vocabulary)
    return _coders[vocabulary]


def encode_texts(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, ids) of every row: the ids of its text without special tokens; strings that look like markers of a tokenizer
    are ordinary text. Null and empty texts give an empty list, rows with a null key keep it, and no rows give no rows.
    The vocabulary file must be readable at the same path on all executors."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with_vocabulary = coder(vocabulary)
        for batch in batches:
            ids, offsets = with_vocabulary.encode(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))], names=[key, "ids"])

    return docs.select(F.col(key), F.col(text)).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def count_tokens(docs: DataFrame, keep: list[str], text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """The ``keep`` columns and n_tokens (0 for a null or empty text) of every row."""
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with_vocabulary = coder(vocabulary)
        for batch in batches:
            _, offsets = with_vocabulary.encode(batch.column(len(keep)))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(np.diff(offsets), pa.int64())], names=[*keep, "n_tokens"])

    return docs.select(*keep, F.col(text)).mapInArrow(run, f"{schema}, n_tokens bigint")
