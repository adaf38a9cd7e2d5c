"""Problem 7: token ids of a whole corpus by forced-boundary splitting.

A byte pair that occurs inside no vocabulary token can never be merged across, so
between its bytes a cut is certain.  Texts are cut there (one table lookup per byte over
a whole batch), every distinct fragment of a batch is encoded once, independently of the
rest, and the fragments' ids are concatenated.

Two cuts are left out because the pre-tokenizer looks across them: after white space
(its last blank may belong to the next word) and before an apostrophe (which would then
start a contraction).
"""
from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

EMPTY_IDS: list[int] = []  # ids of an empty text
NULL_IDS: list[int] = []  # ids of a null text


def vocabulary_file(name: str = "byte_bpe_50k.tiktoken", folder: str | None = None) -> str:
    """Path of a public vocabulary file; the folder is a parameter or OPWEAVE_TOKENIZERS."""
    return os.path.join(folder or os.environ.get("OPWEAVE_TOKENIZERS", "/opt/tokenizers"), name)


class ForcedBoundaryEncoder:
    """Byte-level BPE over forced fragments."""

    def __init__(self, path: str, pattern: str | None = None, cache: int = 200_000) -> None:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        if pattern is None:
            # fixed value: the public pre-tokenizer pattern of this vocabulary
            pattern = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
        self.bpe = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        inside = np.zeros(1 << 16, bool)
        for token in ranks:
            t = np.frombuffer(token, np.uint8).astype(np.uint32)
            inside[(t[:-1] << 8) | t[1:]] = True
        cut = ~inside
        pairs = np.arange(1 << 16)
        cut[np.isin(pairs >> 8, [9, 10, 11, 12, 13, 28, 29, 30, 31, 32]) | ((pairs & 255) == 39)] = False
        cut[((pairs & 255) & 0xC0) == 0x80] = False  # never inside a character
        self.cut = cut
        self.cache: dict[bytes, np.ndarray] = {}
        self.cache_size = cache

    def fragments(self, data: np.ndarray) -> np.ndarray:
        """Offsets (excluding 0 and the end) at which ``data`` is cut."""
        if len(data) < 2:
            return np.zeros(0, np.int64)
        d = data.astype(np.uint16)
        at = np.flatnonzero(self.cut[(d[:-1] << 8) | d[1:]]) + 1
        # white space beyond ASCII ends in these bytes: U+0085, U+00A0, U+1680, U+2000..., U+202F, U+205F, U+3000
        prev = data[at - 1]
        lead = data[np.maximum(at - 2, 0)]
        lead2 = data[np.maximum(at - 3, 0)]
        blank = ((lead == 0xC2) & ((prev == 0x85) | (prev == 0xA0))) | ((lead2 == 0xE1) & (lead == 0x9A) & (prev == 0x80)) | ((lead2 == 0xE2) & (((lead == 0x80) & ((prev <= 0x8A) | (prev == 0xA8) | (prev == 0xA9) | (prev == 0xAF))) | ((lead == 0x81) & (prev == 0x9F)))) | ((lead2 == 0xE3) & (lead == 0x80) & (prev == 0x80))
        return at[~blank]

    def encode_batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, end of each text's ids); null texts are empty here."""
        raw = texts.fill_null("").cast(pa.large_string())
        ends = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
        data = np.frombuffer(raw.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
        ends = ends - ends[0]
        cuts = np.union1d(self.fragments(data), ends)  # a text's end always cuts
        body = data.tobytes()
        bounds = cuts.tolist()
        index: dict[bytes, int] = {}
        which = np.fromiter((index.setdefault(body[a:b], len(index)) for a, b in zip(bounds, bounds[1:])), np.int64, max(0, len(bounds) - 1))
        fresh = [f for f in index if f not in self.cache]
        if len(self.cache) + len(fresh) > self.cache_size:
            self.cache.clear()
            fresh = list(index)
        for f, ids in zip(fresh, self.bpe.encode_ordinary_batch([f.decode("utf-8", "surrogatepass") for f in fresh], num_threads=1)):
            self.cache[f] = np.array(ids, np.int32)
        parts = [self.cache[f] for f in index]
        size = np.fromiter(map(len, parts), np.int64, len(parts))
        total = np.concatenate([[0], np.cumsum(size[which])])
        flat = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        first = np.concatenate([[0], np.cumsum(size)])[which]
        out = flat[np.repeat(first - total[:-1], size[which]) + np.arange(total[-1])] if len(which) else flat
        return out, total[np.searchsorted(cuts, ends)] if len(cuts) else np.zeros(len(ends), np.int64)


@lru_cache(2)
def _encoder(path: str) -> ForcedBoundaryEncoder:
    return ForcedBoundaryEncoder(path)


def _blocks(texts: pa.Array, limit: int) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes (a longer text alone)."""
    size = np.nan_to_num(np.asarray(pc.binary_length(texts).to_pandas(), float)).cumsum()
    i = 0
    while i < len(size):
        j = max(i + 1, int(np.searchsorted(size, (size[i - 1] if i else 0) + limit, "right")))
        yield i, j
        i = j


def token_ids(df: DataFrame, key: str, text: str, path: str | None = None, block: int = 4_000_000) -> DataFrame:
    """(key, ids array<int>): ids without special tokens; [] for a null or empty text.

    Special tokens' strings inside a text are ordinary text.  One row per input row."""
    path = path or vocabulary_file()
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(path)
        for b in batches:
            for i, j in _blocks(b.column(1), block):
                ids, ends = enc.encode_batch(b.column(1).slice(i, j - i))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids))], names=["k", "ids"])

    return df.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t")).mapInArrow(run, f"k {kind}, ids array<int>").withColumnRenamed("k", key)


def token_counts(df: DataFrame, keep: list[str], text: str, path: str | None = None, out: str = "n_tokens", block: int = 4_000_000) -> DataFrame:
    """``keep`` columns and the number of tokens of ``text`` (0 for null and empty)."""
    path = path or vocabulary_file()
    fields = df.select(*keep).schema
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(path)
        for b in batches:
            for i, j in _blocks(b.column(b.num_columns - 1), block):
                _, ends = enc.encode_batch(b.column(b.num_columns - 1).slice(i, j - i))
                yield pa.RecordBatch.from_arrays([*(c.slice(i, j - i) for c in b.columns[:-1]), pa.array(np.diff(ends))], names=[*keep, out])

    return df.select(*keep, F.col(text).cast("string").alias("__t")).mapInArrow(run, f"{ddl}, `{out}` bigint")
