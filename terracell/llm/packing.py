"""Packing documents into fixed-length sequences by harmonic classes.

A document's tokens (its ids and an end id) are cut into pieces: whole sequences
first, then the largest powers of two down to ``SMALLEST``, then a tail. Pieces
fall into reciprocal-capacity classes: class j holds lengths in (C/(j+1), C/j]
and fills each of its sequences with exactly j pieces. No class looks at another
and no worker at another, so a partition is packed as it streams by, holding only
the pieces of its unfilled sequences. Powers of two fill sequences without
padding; a class of tails wastes at most 1/(j+1) with j >= C/SMALLEST.

At the end of a partition the unfilled sequences of powers of two are closed as
sequences whose length is a power of two, and the pending tails are laid end to
end and cut into whole sequences and powers of two.

Token ids are those of the given ``tokenizers`` file as that library gives them
with ``add_special_tokens=False``: the string of an added token inside a text is
that token's id.

Edge cases: a null or empty text is its end id alone. Rows that share a doc_id
are packed apart, each with its own piece numbering. Rows with a null doc_id are
packed with a null id. Extra columns are ignored; empty input gives no pieces.
"""

from __future__ import annotations

import functools
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terracell.llm.shared import tidy

CAPACITY = 2048
SMALLEST = 64
END_ID = 1
# Fixed value: how a byte-level BPE file splits text before it merges.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_ROW = "doc_id bigint, start bigint, length bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids binary"
_FLUSH = 8 << 20  # bytes of ids in an output batch


class Encoder:
    """Text -> little-endian uint32 ids as bytes, equal to the ``tokenizers`` file's.

    If the file is a plain byte-level BPE whose merged ids ascend in merge order,
    and its added tokens are matched as they stand, its vocabulary is handed to
    tiktoken, which gives the same ids several times faster; any other file is run
    by ``tokenizers`` itself.
    """

    def __init__(self, path: str | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("byte_bpe_50k.json")
        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        ranks, added = byte_ranks(spec), added_ids(spec)
        if ranks is None or added is None:
            self.encode = self.reference
        else:
            import tiktoken

            self.fast = tiktoken.Encoding("terracell", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=added)
            self.encode = self._fast

    def _fast(self, text: str) -> bytes:
        return self.fast.encode_to_numpy(text, allowed_special="all").astype("<u4").tobytes()

    @functools.cached_property
    def tokenizer(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def reference(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


def added_ids(spec: dict) -> dict[str, int] | None:
    """content -> id of the added tokens; None if one asks for more than its own string, or begins with another's."""
    added = spec.get("added_tokens") or ()
    ids = {t["content"]: t["id"] for t in added}
    asks = any(t.get(k) for t in added for k in ("single_word", "lstrip", "rstrip"))
    return None if asks or any(a != b and b.startswith(a) for a in ids for b in ids) else ids


def byte_ranks(spec: dict) -> dict[bytes, int] | None:
    """bytes -> id of a byte-level BPE file; None if its form asks for more than ranks."""
    model, pre = spec.get("model") or {}, spec.get("pre_tokenizer") or {}
    plain = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
    if not plain or spec.get("normalizer") or model.get("type") != "BPE" or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
        return None
    # printable bytes stand for themselves, the others for code points from 256 on
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(shown)))}
    special = {t["content"] for t in spec.get("added_tokens") or ()}
    vocab = model["vocab"]
    merged = [vocab.get("".join(m.split(" ") if isinstance(m, str) else m)) for m in model["merges"]]
    if None in merged or any(a >= b for a, b in zip(merged, merged[1:], strict=False)):
        return None
    if not all(c in byte_of for t in vocab if t not in special for c in t):
        return None
    return {bytes(byte_of[c] for c in t): i for t, i in vocab.items() if t not in special}


def cuts(tokens: int, capacity: int = CAPACITY, smallest: int = SMALLEST) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces."""
    out = [(a, capacity) for a in range(0, tokens - capacity + 1, capacity)]
    at, size = len(out) * capacity, capacity // 2
    while size >= smallest:
        if tokens - at >= size:
            out.append((at, size))
            at += size
        size //= 2
    if at < tokens:
        out.append((at, tokens - at))
    return out


class Packer:
    """Assigns pieces to sequences; ``place`` and ``close`` return finished rows.

    A piece is (doc_id, start, length, doc_tokens, ids); a row adds the sequence
    and the offset before the ids.
    """

    def __init__(self, partition: int, capacity: int = CAPACITY):
        self.capacity = capacity
        self.next = partition << 40
        self.open: dict[int, list[tuple]] = {}

    def _sequence(self, pieces: list[tuple]) -> Iterator[tuple]:
        at = 0
        for doc, start, length, tokens, ids in pieces:
            yield doc, start, length, tokens, self.next, at, ids
            at += length
        self.next += 1

    def place(self, piece: tuple) -> Iterator[tuple]:
        j = self.capacity // piece[2]
        if j == 1:
            yield from self._sequence([piece])
            return
        pending = self.open.setdefault(j, [])
        pending.append(piece)
        if len(pending) == j:
            yield from self._sequence(self.open.pop(j))

    def close(self) -> Iterator[tuple]:
        loose: list[tuple] = []
        for j in sorted(self.open):
            pending = self.open[j]
            size = self.capacity // j
            if size & (size - 1) or any(p[2] != size for p in pending):
                loose += pending
                continue
            while pending:  # as many as make a power of two
                k = 1 << (len(pending).bit_length() - 1)
                yield from self._sequence(pending[:k])
                pending = pending[k:]
        self.open = {}
        left = sum(p[2] for p in loose)
        while loose:
            room = size = min(self.capacity, 1 << (left.bit_length() - 1))
            left -= size
            now = []
            while room:
                doc, start, length, tokens, ids = loose.pop(0)
                take = min(room, length)
                now.append((doc, start, take, tokens, ids[: 4 * take]))
                if take < length:
                    loose.insert(0, (doc, start + take, length - take, tokens, ids[4 * take :]))
                room -= take
            yield from self._sequence(now)


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str | None = None, capacity: int = CAPACITY, smallest: int = SMALLEST, end_id: int = END_ID) -> DataFrame:
    """One row per piece, with its ids as little-endian unsigned 32-bit numbers."""
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches):
        encoder = Encoder(tokenizer)
        packer = Packer(TaskContext.get().partitionId(), capacity)
        rows, size = [], 0

        def batch_of(rows):
            kinds = [pa.int64()] * 6 + [pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])

        for batch in batches:
            for doc, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                t = t.as_py()
                ids = (encoder.encode(t) if t else b"") + end
                tokens = len(ids) // 4
                for start, length in cuts(tokens, capacity, smallest):
                    for row in packer.place((doc, start, length, tokens, ids[4 * start : 4 * (start + length)])):
                        rows.append(row)
                        size += 4 * row[2]
                if size >= _FLUSH:
                    yield batch_of(rows)
                    rows, size = [], 0
        rows += packer.close()
        if rows:
            yield batch_of(rows)

    return docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).mapInArrow(tidy(run), _ROW)


def report(docs: DataFrame) -> DataFrame:
    """The pieces, with the checksum of their ids in place of the ids."""
    return pack(docs).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
