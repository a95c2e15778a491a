"""Exact substring dedup with suffix arrays sorted by external induced sorting.

Every string of `length` bytes that also starts in a document with a smaller id is a
repeat; the bytes that repeats cover are removed. The corpus is cut into shards by
content: of the k-grams in a string the one with the least hash, its anchor, says which
shard the string goes to, so equal strings meet, whatever documents they are in, and
neighbouring strings with the same anchor travel as one stretch of text. An anchor that
only one document has can't begin a repeat; a first exchange of anchor hashes finds
those, and their stretches are not sent. Each shard then sorts the suffixes of its
distinct stretches (see `induced`), common-prefix values of `length` or more tell which
strings are equal, and the least document of each group keeps its copy.

Text moves twice (to the marks of its anchors, and to its cuts), packed stretches of
repeated text once. No task gathers a document's copies: a copied document's anchors are
spread over all shards, and equal stretches are sorted once, however many have them.

Defined results: null and empty texts have no bytes; texts shorter than `length` lose
nothing. Matches never cross documents, repeats inside one document are kept, and so are
rows that repeat an id (an equal id is not a smaller one). Rows equal in id and text get
equal results. Rows without an id keep their text and take none from others. Ids are
integers; other columns are not read. Stretches are told apart by
length and a 64-bit hash, equal strings by the suffix array.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.llm import induced
from loomline.llm.bytewords import mix, pieces, prefix_sums, span_hash, text_bytes
from loomline.llm.messages import KEY, MARKED, MESSAGE, by_document, by_key, pack, rows, split, to_documents, unpack
from loomline.llm.spool import Spool

LENGTH, GRAM = 50, 24
#: Bytes of text for each shard, and of text whose anchors one message holds.
SHARD_BYTES, MESSAGE_BYTES = 4_000_000, 16_000_000


# -- anchors -----------------------------------------------------------------------------------


def _long(buf: np.ndarray, off: np.ndarray, length: int, size: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first document, byte of it, bytes, offsets) in pieces; documents beyond `size` come in stretches that overlap by length - 1."""
    for lo, hi, b, o in pieces(buf, off, size):
        if hi - lo > 1 or len(b) <= size + length:
            yield lo, 0, b, o
        else:
            for at in range(0, len(b) - length + 1, size):
                part = b[at : at + size + length - 1]
                yield lo, at, part, np.array([0, len(part)])


def anchors(buf: np.ndarray, off: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Stretches of strings with one anchor, in the order of the text: (document, first byte in it, strings, anchor hash)."""
    out: list[tuple[np.ndarray, ...]] = []
    width = length - gram + 1
    for first, base, b, o in _long(buf, off, length):
        if len(b) < length:
            continue
        sums = prefix_sums(b)
        n = len(b) - gram + 1
        at = np.arange(n)
        h = mix(span_hash(sums, at, at + gram))
        # the 42 leading bits of the hash, then the place: the leftmost of the least grams
        least = (h & ~np.uint64((1 << 22) - 1)) | at.astype(np.uint64)
        w = 1
        while 2 * w <= width:
            least = np.minimum(least[:-w], least[w:])
            w *= 2
        if w < width:
            least = np.minimum(least[: len(least) - (width - w)], least[width - w :])
        size = np.diff(o)
        strings = np.maximum(size - length + 1, 0)
        start = np.repeat(o[:-1] - np.cumsum(strings) + strings, strings) + np.arange(strings.sum())
        doc = np.repeat(np.arange(len(size)), strings)
        where = least[start] & np.uint64((1 << 22) - 1)
        new = np.flatnonzero(np.r_[True, (where[1:] != where[:-1]) | (doc[1:] != doc[:-1])]) if len(start) else np.empty(0, np.int64)
        d = doc[new]
        out.append((d + first, start[new] - o[d] + base, np.diff(np.append(new, len(start))), mix(h[where[new].astype(np.int64)] + np.uint64(1))))
    if not out:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _shard(h: np.ndarray, shards: int) -> np.ndarray:
    return ((h >> np.uint64(32)) % np.uint64(shards)).astype(np.int64)


# -- the four steps ----------------------------------------------------------------------------


def _send_anchors(length: int, gram: int, shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            keys = np.concatenate([k for k, *_ in held])
            base = np.cumsum([0, *[len(k) for k, *_ in held]])
            doc = np.concatenate([d + b for (_, d, _, _), b in zip(held, base, strict=False)])
            place, h = np.concatenate([p for *_, p, _ in held]), np.concatenate([x for *_, x in held])
            out = []
            for shard, at in split(_shard(h, shards)):
                used, first = np.unique(doc[at], return_index=True)
                count = np.diff(np.append(first, len(at)))
                step = np.diff(place[at], prepend=0)
                step[first] = place[at][first]
                low = h[at] & np.uint64(0xFFFFFFFF)
                high = (h[at] >> np.uint64(48)).astype(np.uint16)
                out.append((shard, pack(keys[used].view(np.int64), count.astype(np.uint32), step.astype(np.uint32), low.astype(np.uint32), high)))
            return rows([k for k, _ in out], [m for _, m in out])

        for batch in batches:
            buf, off = text_bytes(batch.column(2))
            keys = np.empty(len(batch), KEY)
            keys["id"], keys["h"] = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            lo = 0
            while lo < len(batch):
                hi = max(lo + 1, int(np.searchsorted(off, off[lo] + MESSAGE_BYTES, "right")) - 1)
                doc, _, _, h = anchors(buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], length, gram)
                place = np.arange(len(doc)) - np.searchsorted(doc, doc)
                held.append((keys[lo:hi], doc, place, h))
                size += int(off[hi] - off[lo])
                if size >= MESSAGE_BYTES:
                    yield flush()
                    held, size = [], 0
                lo = hi
        if held and any(len(d) for _, d, _, _ in held):
            yield flush()

    return run


def _mark_shared(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, messages in by_key(batches):
            got = [unpack(m) for m in messages]
            keys = np.concatenate([g[0].view(KEY) for g in got])
            count = np.concatenate([g[1] for g in got]).astype(np.int64)
            doc = np.repeat(np.arange(len(keys)), count)
            step = np.concatenate([g[2] for g in got]).astype(np.int64)
            total = np.cumsum(step)
            first = np.cumsum(count) - count
            place = total - np.repeat(total[first] - step[first], count)
            h = np.concatenate([g[3] for g in got]).astype(np.uint64) | np.concatenate([g[4] for g in got]).astype(np.uint64) << np.uint64(32)
            order = np.argsort(h, kind="stable")
            ids = keys["id"][doc[order]]
            start = np.flatnonzero(np.r_[True, h[order][1:] != h[order][:-1]])
            shared = np.minimum.reduceat(ids, start) != np.maximum.reduceat(ids, start)
            at = order[np.repeat(shared, np.diff(np.append(start, len(order))))]
            if len(at):
                out = list(to_documents(keys, doc[at], parts, place[at].astype(np.uint32)))
                yield rows([k for k, _ in out], [m for _, m in out])

    return run


def _send_stretches(length: int, gram: int, shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf_all, off_all = text_bytes(batch.column(2))
            lo = 0
            while lo < len(batch):
                hi = max(lo + 1, int(np.searchsorted(off_all, off_all[lo] + MESSAGE_BYTES, "right")) - 1)
                buf, off = buf_all[off_all[lo] : off_all[hi]], off_all[lo : hi + 1] - off_all[lo]
                keys = np.empty(hi - lo, KEY)
                keys["id"], keys["h"] = batch.column(0).slice(lo, hi - lo).to_numpy(), batch.column(1).slice(lo, hi - lo).to_numpy()
                doc, start, strings, h = anchors(buf, off, length, gram)
                begin = np.searchsorted(doc, np.arange(hi - lo))
                at = np.concatenate([begin[i] + np.frombuffer(m, np.uint32).astype(np.int64) for i, m in enumerate(batch.column(3).slice(lo, hi - lo).to_pylist())])
                doc, start, strings, h = doc[at], start[at], strings[at], h[at]
                out = []
                for shard, own in split(_shard(h, shards)):
                    size = strings[own] + length - 1
                    take = np.repeat(off[doc[own]] + start[own] - np.cumsum(size) + size, size) + np.arange(size.sum())
                    used, first = np.unique(doc[own], return_index=True)
                    out.append((shard, pack(keys[used].view(np.int64), np.diff(np.append(first, len(own))).astype(np.uint32), start[own].astype(np.uint32), strings[own].astype(np.uint8), buf[take])))
                if out:
                    yield rows([k for k, _ in out], [m for _, m in out])
                lo = hi

    return run


def shard_repeats(ids: np.ndarray, start: np.ndarray, strings: np.ndarray, text: np.ndarray, length: int, in_memory: int = induced.IN_MEMORY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(stretch, first repeated string in its document, how many in a row) of all repeats in a shard.

    ids, start, strings: document id, first byte and number of strings of each stretch; text: their bytes one after the other.
    """
    size = strings + length - 1
    off = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=off[1:])
    # equal stretches are sorted once
    sums = np.concatenate([span_hash(prefix_sums(text[off[lo] : off[hi]]), off[lo:hi] - off[lo], off[lo + 1 : hi + 1] - off[lo]) for lo, hi in ((i, min(i + 16384, len(size))) for i in range(0, len(size), 16384))]) if len(size) else np.empty(0, np.uint64)
    _, first, kind = np.unique(mix(sums + size.astype(np.uint64)), return_index=True, return_inverse=True)
    least = np.full(len(first), np.iinfo(np.int64).max)
    np.minimum.at(least, kind, ids)
    k_size, k_strings = size[first], strings[first]
    k_off = np.cumsum(k_size + 1) - k_size - 1
    sequence = np.zeros(int((k_size + 1).sum()), np.uint16)  # bytes from 1; 0 ends a stretch
    whole = np.zeros(len(sequence), bool)  # where a whole string begins
    for lo in range(0, len(first), 8192):
        some = slice(lo, lo + 8192)
        n, at = k_size[some], k_off[some]
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        sequence[np.repeat(at, n) + step] = text[np.repeat(off[first[some]], n) + step].astype(np.uint16) + 1
        n = k_strings[some]
        whole[np.repeat(at, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)] = True
    # the least document of each group of equal strings, where that is another stretch's
    owner = np.repeat(np.arange(len(first), dtype=np.int32), k_size + 1)
    earlier = np.zeros(len(sequence), bool)
    for position, common in induced.suffix_blocks(sequence, length, in_memory):
        ok = whole[position]
        new = common < length
        group = np.cumsum(new)[ok]  # a string that isn't whole shares less than `length` with its neighbours
        position = position[ok]
        if not len(position):
            continue
        begin = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        doc = least[owner[position]]
        low = np.repeat(np.minimum.reduceat(doc, begin), np.diff(np.append(begin, len(doc))))
        earlier[position[low < doc]] = True
    # copies beyond a stretch's least document repeat all its strings; the least repeats those that are in an earlier one
    later = ids > least[kind]
    a = np.flatnonzero(later)
    edge = np.flatnonzero(np.diff(np.r_[False, earlier, False].astype(np.int8)))
    run_at, run_n = edge[::2], edge[1::2] - edge[::2]
    run_kind = owner[run_at]
    runs = np.searchsorted(run_kind, np.arange(len(first) + 1))
    b = np.flatnonzero(~later)
    n = (runs[1:] - runs[:-1])[kind[b]]
    which = np.repeat(runs[:-1][kind[b]] - np.cumsum(n) + n, n) + np.arange(n.sum())
    b = np.repeat(b, n)
    return np.concatenate([a, b]), np.concatenate([start[a], start[b] + run_at[which] - k_off[run_kind[which]]]), np.concatenate([strings[a], run_n[which]])


def _sort_shards(length: int, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, messages in by_key(batches):
            got = [unpack(m) for m in messages]
            messages.clear()
            keys = np.concatenate([g[0].view(KEY) for g in got])
            doc = np.repeat(np.arange(len(keys)), np.concatenate([g[1] for g in got]).astype(np.int64))
            start, strings, text = (np.concatenate([g[i] for g in got]) for i in (2, 3, 4))
            del got
            which, at, n = shard_repeats(keys["id"][doc], start.astype(np.int64), strings.astype(np.int64), text, length)
            if len(which):
                out = list(to_documents(keys, doc[which], parts, at.astype(np.uint32), n.astype(np.uint32)))
                yield rows([k for k, _ in out], [m for _, m in out])

    return run


def _spans(length: int):
    def finish(start: np.ndarray, strings: np.ndarray) -> bytes:
        """Maximal covered runs, as (first byte, one beyond the last)."""
        start = start.astype(np.int64)
        end = np.maximum.accumulate(start + strings + length - 1)
        new = np.r_[True, start[1:] > end[:-1]]
        return np.stack([start[new], end[np.append(np.flatnonzero(new)[1:], len(end)) - 1]], 1).astype("<u4").tobytes()

    return finish


def _cut(batches: Iterator[pa.RecordBatch], as_text: bool = False) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        buf, off = text_bytes(batch.column(1))
        lo = 0
        while lo < len(batch):
            hi = max(lo + 1, int(np.searchsorted(off, off[lo] + (8 << 20), "right")) - 1)
            kept, removed, spans = [], [], []
            for i, m in zip(range(lo, hi), batch.column(2).slice(lo, hi - lo).to_pylist(), strict=True):
                raw, at = bytes(buf[off[i] : off[i + 1]]), 0
                runs = np.frombuffer(m or b"", "<u4").reshape(-1, 2).tolist()
                parts = []
                for s, e in runs:
                    parts.append(raw[at:s])
                    at = e
                parts.append(raw[at:])
                kept.append(b"".join(parts))
                removed.append(len(raw) - len(kept[-1]))
                spans.append([{"start": s, "end": e} for s, e in runs])
            size = pa.array(np.diff(off[lo : hi + 1]))
            left = pa.array([x.decode("utf-8", "ignore") for x in kept], pa.string()) if as_text else pa.array(kept, pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), size, pa.array(removed, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), left], ["id", "n_bytes", "n_removed", "spans", "kept"])
            lo = hi


def dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(id, n_bytes, n_removed, spans, kept bytes) of every row."""
    out = _kept(docs, id_col, text_col, length, gram, [], False)
    return out.select(F.col("id").cast(docs.schema[id_col].dataType).alias(id_col), "n_bytes", "n_removed", "spans", "kept")


def without_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """docs with the kept text in place of the text; parts of characters at the edges of a cut go as well."""
    others = [c for c in docs.columns if c not in (id_col, text_col)]
    out = _kept(docs, id_col, text_col, length, gram, others, True)
    back = {id_col: F.col("id").cast(docs.schema[id_col].dataType), text_col: F.col("kept")} | {c: F.col("carried")[c] for c in others}
    return out.select(*[back[c].alias(c) for c in docs.columns])


def _kept(docs: DataFrame, id_col: str, text_col: str, length: int, gram: int, carry: list[str], as_text: bool) -> DataFrame:
    spark = docs.sparkSession
    spool = Spool(spark, "suffix-dedup")
    text: Column = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    own = docs.select(docs[id_col].cast("long").alias("id"), F.xxhash64(text).alias("h"), text.alias("text"))
    total = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = int(max(16, min(-(-total // SHARD_BYTES), 1 << 20)))
    long_enough = own.where((F.octet_length("text") >= length) & F.col("id").isNotNull())
    arranged = lambda df: df.repartition(shards, "key").sortWithinPartitions("key")

    sent = long_enough.mapInArrow(_send_anchors(length, gram, shards), MESSAGE)
    found = arranged(sent).mapInArrow(_mark_shared(shards), MESSAGE)
    marks = spool.table("marks", arranged(found).mapInArrow(by_document(lambda place: np.sort(place).astype("<u4").tobytes()), MARKED))

    both = long_enough.join(marks, (F.col("id") == F.col("k_id")) & (F.col("h") == F.col("k_h"))).select("id", "h", "text", "value")
    stretches = arranged(both.mapInArrow(_send_stretches(length, gram, shards), MESSAGE))
    repeats = stretches.mapInArrow(_sort_shards(length, shards), MESSAGE)
    cuts = spool.table("cuts", arranged(repeats).mapInArrow(by_document(_spans(length)), MARKED))

    carried = F.struct(F.lit(0).alias("_"), *[docs[c] for c in carry]).alias("carried")
    rows = docs.select(docs[id_col].cast("long").alias("id"), F.xxhash64(text).alias("h"), text.alias("text"), carried)
    rows = rows.join(cuts, (F.col("id") == F.col("k_id")) & (F.col("h") == F.col("k_h")), "left").select("id", "text", "value", "carried")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for got in _cut(iter([batch]), as_text):
                yield pa.RecordBatch.from_arrays([*got.columns, batch.column(3).slice(at, len(got))], [*got.schema.names, "carried"])
                at += len(got)

    kept = "string" if as_text else "binary"
    return rows.mapInArrow(run, f"id bigint, n_bytes bigint, n_removed bigint, spans array<struct<start:bigint,end:bigint>>, kept {kept}, carried {rows.schema['carried'].dataType.simpleString()}")
