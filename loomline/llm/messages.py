"""Packed messages between tasks: many small values in one compressed row.

Values for a document travel to the part its key belongs to, so that no row is spent on
each of them. A key is (id, 64-bit hash of the text): rows equal in both are one document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from loomline.llm.bytewords import mix

KEY = [("id", np.int64), ("h", np.int64)]
#: Rows of messages, and of what a document has got.
MESSAGE, MARKED = "key bigint, message binary", "k_id bigint, k_h bigint, value binary"


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed message."""
    raw = b"".join([np.array([len(a.dtype.str), a.nbytes], "<i8").tobytes() + a.dtype.str.encode() + a.tobytes() for a in arrays])
    return np.array([len(raw)], "<i8").tobytes() + pa.compress(raw, "zstd", asbytes=True)


def unpack(message: bytes) -> list[np.ndarray]:
    raw = memoryview(pa.decompress(message[8:], int(np.frombuffer(message[:8], "<i8")[0]), "zstd", asbytes=True))
    out, at = [], 0
    while at < len(raw):
        n, size = np.frombuffer(raw[at : at + 16], "<i8").tolist()
        out.append(np.frombuffer(raw[at + 16 + n : at + 16 + n + size], bytes(raw[at + 16 : at + 16 + n]).decode()))
        at += 16 + n + size
    return out


def by_key(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[bytes]]]:
    """(key, messages) of sorted rows (key, message)."""
    key, held = None, []
    for batch in batches:
        for k, m in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if held and k != key:
                yield key, held
                held = []
            key = k
            held.append(m)
    if held:
        yield key, held


def rows(keys: list[int], messages: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(messages, pa.binary())], ["key", "message"])


def split(by: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(value, places) of each value of a small range, places ascending."""
    order = np.argsort(by.astype(np.uint32), kind="stable")
    cut = np.flatnonzero(np.r_[True, by[order][1:] != by[order][:-1]]) if len(by) else []
    for lo, hi in zip(cut, [*cut[1:], len(by)], strict=True):
        yield int(by[order[lo]]), order[lo:hi]


def to_documents(keys: np.ndarray, doc: np.ndarray, parts: int, *values: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """Messages to the document parts: the documents, how many values each has, and the values in the order of doc."""
    order = np.argsort(doc, kind="stable")
    doc = doc[order]
    used, first = np.unique(doc, return_index=True)
    count = np.diff(np.append(first, len(doc)))
    where = (mix(keys["id"][used].astype(np.uint64) ^ keys["h"][used].astype(np.uint64)) % np.uint64(parts)).astype(np.int64)
    for part, at in split(where):
        take = np.repeat(first[at] - np.cumsum(count[at]) + count[at], count[at]) + np.arange(count[at].sum())
        yield part, pack(keys[used[at]].view(np.int64), count[at].astype(np.uint32), *[v[order][take] for v in values])


def merge_documents(messages: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(keys, offsets, values) of all messages to one part, by document."""
    got = [unpack(m) for m in messages]
    keys = np.concatenate([g[0] for g in got]).view(KEY)
    count = np.concatenate([g[1] for g in got]).astype(np.int64)
    every, number = np.unique(keys, return_inverse=True)
    doc = np.repeat(number, count)
    values = [np.concatenate(x) for x in zip(*[g[2:] for g in got], strict=True)]
    order = np.lexsort((values[0], doc))
    return every, np.searchsorted(doc[order], np.arange(len(every) + 1)), [v[order] for v in values]


def by_document(finish):
    """One row a document with what `finish` makes of its values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, messages in by_key(batches):
            keys, off, values = merge_documents(messages)
            for lo in range(0, len(keys), 4096):
                hi = min(lo + 4096, len(keys))
                raw = [finish(*[v[off[i] : off[i + 1]] for v in values]) for i in range(lo, hi)]
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(keys["id"][lo:hi])), pa.array(np.ascontiguousarray(keys["h"][lo:hi])), pa.array(raw, pa.binary())], ["k_id", "k_h", "value"])

    return run
