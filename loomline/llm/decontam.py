"""Benchmark decontamination with training suffix arrays.

Each shard of documents becomes one sequence of word numbers over the test words, and
its suffixes are sorted into a suffix array. Every test suffix is binary-searched in it;
the suffixes found are extended to the longest verbatim matches. Suffixes of a shard
whose first two words stand next to each other nowhere in the test set can't begin a
window and are not sorted in.

Defined results: null and empty texts have no words and no hits; an item without words
matches nothing; items that repeat an id are one item for the counts, and a null id is
the item 'null'. Words of other scripts count by their UTF-8 bytes. An empty test set
gives every document zero hits. Repeated document rows each get their own result. Only
the named columns are read. Words are told apart by a 64-bit hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.llm.bytewords import Words, lean, pieces, release, text_bytes
from loomline.llm.spool import Spool, small_batches

WINDOW = 13
#: Bytes of test text that one scan of the documents is held against.
BLOCK_BYTES = 4_000_000


class TestSet:
    """One block of the test items as word numbers, and the windows to be found."""

    __test__ = False

    def __init__(self, ids: list[str], texts: list[str | None], window: int = WINDOW):
        buf, off = text_bytes(pa.array(texts, pa.large_string()))
        words = Words(buf, off)
        self.ids, self.window = ids, window
        self.vocab, number = np.unique(words.hashes(), return_inverse=True)
        self.number = number.astype(np.int64) + 1
        self.item = np.repeat(np.arange(len(ids)), np.diff(words.off))
        size = np.diff(words.off)
        self.stop = np.repeat(words.off[1:], size)
        length = np.minimum(window, size)[self.item] if len(self.item) else np.empty(0, np.int64)
        self.query = np.flatnonzero(np.arange(len(self.item)) + length <= self.stop)
        self.length = length[self.query]
        bits = int(len(self.vocab) + 1).bit_length()
        self.bits, self.per_key = bits, 62 // bits
        after = np.append(self.number[1:], 0)[: len(self.number)]
        pair = self.number * (len(self.vocab) + 1) + after
        self.pairs = np.unique(pair[self.query[self.length > 1]])
        self.singles = np.unique(self.number[self.query[self.length == 1]])
        self.may = np.zeros(1 << 16, bool)
        self.may[self.vocab >> np.uint64(48)] = True

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Word numbers; 0 for words of no item."""
        out = np.zeros(len(hashes), np.int64)
        at = np.flatnonzero(self.may[hashes >> np.uint64(48)])
        k = np.searchsorted(self.vocab, hashes[at])
        k[k == len(self.vocab)] = 0
        out[at] = np.where(self.vocab[k] == hashes[at], k + 1, 0)
        return out

    def keys(self, number: np.ndarray, at: np.ndarray, length: np.ndarray, rest: int = 0) -> np.ndarray:
        """The next words of each place packed into a few integers, most significant first; `rest` beyond length."""
        cols = []
        for lo in range(0, self.window, self.per_key):
            col = np.zeros(len(at), np.int64)
            for j in range(lo, min(lo + self.per_key, self.window)):
                inside = j < length
                word = number[np.where(inside, at + j, 0)] if len(number) else np.zeros(len(at), np.int64)
                col = (col << self.bits) | np.where(inside, word, rest)
            cols.append(col)
        return np.stack(cols)


def _search(array: np.ndarray, keys: np.ndarray, right: bool) -> np.ndarray:
    """Where each key (a column) goes in the sorted columns of array."""
    n = array.shape[1]
    lo, hi = np.zeros(keys.shape[1], np.int64), np.full(keys.shape[1], n, np.int64)
    while (open_ := lo < hi).any():
        mid = np.minimum((lo + hi) // 2, n - 1)
        less, same = np.zeros(len(lo), bool), np.ones(len(lo), bool)
        for a, k in zip(array, keys, strict=True):
            less |= same & (a[mid] < k)
            same &= a[mid] == k
        go = (less | same) if right else less
        lo, hi = np.where(open_ & go, mid + 1, lo), np.where(open_ & ~go, mid, hi)
    return lo


def find(test: TestSet, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Longest verbatim matches that hold a window: (word in the shard, word in the test set, words)."""
    none = (np.empty(0, np.int64),) * 3
    if not len(words) or not len(test.query):
        return none
    number = test.numbers(words.hashes())
    stop = np.repeat(words.off[1:], np.diff(words.off))
    after = np.zeros(len(number), np.int64)
    after[:-1] = number[1:]
    after[stop == np.arange(len(number)) + 1] = 0
    pair = number * (len(test.vocab) + 1) + after
    starts = np.flatnonzero((number > 0) & (after > 0))
    if len(test.pairs):
        k = np.searchsorted(test.pairs, pair[starts])
        k[k == len(test.pairs)] = 0
        starts = starts[test.pairs[k] == pair[starts]]
    else:
        starts = starts[:0]
    if len(test.singles):
        starts = np.union1d(starts, np.flatnonzero(np.isin(number, test.singles)))
    if not len(starts):
        return none
    keys = test.keys(number, starts, stop[starts] - starts)
    order = np.lexsort(keys[::-1])
    suffixes, keys = starts[order], keys[:, order]
    first = _search(keys, test.keys(test.number, test.query, test.length), False)
    last = _search(keys, test.keys(test.number, test.query, test.length, (1 << test.bits) - 1), True)
    size = last - first
    q = np.repeat(test.query, size)
    p = suffixes[np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())]
    # from here (p, q) are places of windows; each match is kept once, at its first word, and extended
    p_first, q_first = np.repeat(words.off[:-1], np.diff(words.off)), np.repeat(np.flatnonzero(np.r_[True, test.item[1:] != test.item[:-1]]), np.bincount(test.item)[np.unique(test.item)])
    left = (p > p_first[p]) & (q > q_first[q])
    left[left] = number[p[left] - 1] == test.number[q[left] - 1]
    p, q = p[~left], q[~left]
    n = np.minimum(test.window, test.stop[q] - q)
    most = np.minimum(stop[p] - p, test.stop[q] - q)
    open_ = np.flatnonzero(n < most)
    while len(open_):
        open_ = open_[number[p[open_] + n[open_]] == test.number[q[open_] + n[open_]]]
        n[open_] += 1
        open_ = open_[n[open_] < most[open_]]
    return p, q, n


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, window: int) -> Iterator[TestSet]:
    """The test items in blocks of bounded size; the driver holds one of them, and the rows of one partition, at a time."""
    ids, texts, size = [], [], 0
    for r in benchmark.select(F.col(id_col).cast("string"), F.col(text_col).cast("string")).toLocalIterator():
        if size > BLOCK_BYTES:
            yield TestSet(ids, texts, window)
            ids, texts, size = [], [], 0
        ids.append("null" if r[0] is None else r[0])
        texts.append(r[1])
        size += len(r[1] or "")
    yield TestSet(ids, texts, window)


def _union(start: np.ndarray, end: np.ndarray) -> list[tuple[int, int]]:
    order = np.lexsort((end, start))
    out: list[tuple[int, int]] = []
    for s, e in zip(start[order].tolist(), end[order].tolist(), strict=True):
        if out and s <= out[-1][1]:
            out[-1] = out[-1][0], max(e, out[-1][1])
        else:
            out.append((s, e))
    return out


def _scan(test: TestSet, key_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, b, o in pieces(*text_bytes(batch.column(1)), 1 << 22):
                words = Words(b, o)
                p, q, n = find(test, words)
                doc = np.searchsorted(words.off, p, "right") - 1
                order = np.argsort(doc, kind="stable")
                cut = np.searchsorted(doc[order], np.arange(hi - lo + 1))
                rows = []
                for d in range(hi - lo):
                    at = order[cut[d] : cut[d + 1]]
                    base = int(words.off[d])
                    found = [{"start": s, "end": e} for s, e in _union(p[at] - base, p[at] + n[at] - base)] if len(at) else []
                    best = sorted({(test.ids[test.item[q[i]]], int(p[i]) - base, int(n[i])) for i in at.tolist()})
                    rows.append((int(words.off[d + 1]) - base, found, [{"item_id": i, "start": s, "n_words": w} for i, s, w in best]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array([r[2] for r in rows], pa.list_(pa.struct([("item_id", pa.string()), ("start", pa.int64()), ("n_words", pa.int64())])))],
                    ["id", "n_words", "spans", "matches"],
                )

    return lean(run)


def scan(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """One row a document row: id, n_words, n_hit, spans of hit words, longest matches, items, contaminated.

    The test set is the stated query set: it is taken in blocks of bounded size, each sent
    to all documents. One block needs no shuffle; of several, the results meet by row.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, n_words bigint, spans array<struct<start:bigint,end:bigint>>, matches array<struct<item_id:string,start:bigint,n_words:bigint>>"
    shown = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    small_batches(docs.sparkSession)
    blocks = _blocks(benchmark, item_col, item_text_col, window)
    test, more = next(blocks), next(blocks, None)
    if more is None:
        found = shown.mapInArrow(_scan(test, None), schema)
    else:
        spool = Spool(docs.sparkSession, "decontam")
        shown = spool.table("rows", shown.withColumn("row", F.monotonically_increasing_id()))
        keyed = shown.select(F.struct("id", "row").alias("id"), "text")
        one = lambda test, n: spool.table(f"block{n}", keyed.mapInArrow(_scan(test, None), schema.replace(f"id {kind}", f"id struct<id:{kind},row:bigint>")))
        found, n = one(test, 0), 0
        while more is not None:  # of every other block only rows that it hits are kept
            n += 1
            found, more = found.unionByName(one(more, n).where(F.size("matches") > 0)), next(blocks, None)
        found = found.groupBy("id").agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.flatten(F.collect_list("matches"))).alias("matches"))
        merged = F.aggregate(
            F.array_sort("spans"), F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)"),
            lambda acc, s: F.when((F.size(acc) > 0) & (F.element_at(acc, -1)["end"] >= s["start"]), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["end"], s["end"]).alias("end"))))).otherwise(F.concat(acc, F.array(s))),
        )
        found = found.select(F.col("id.id").alias("id"), "n_words", merged.alias("spans"), "matches")
    hits = F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, s: a + s["end"] - s["start"])
    found = found.withColumn("n_hit", hits).withColumn("items", F.array_sort(F.array_distinct(F.col("matches.item_id"))))
    return found.select(F.col("id").alias(id_col), "n_words", "n_hit", "spans", "matches", "items", ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"))


def without_contaminated(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """The rows of docs that aren't contaminated, with all their columns; every row is judged by its own text.

    Against one block of test text the rows are judged where they are read; against more,
    they are written with a number of their own, by which the judgement of all blocks comes back.
    """
    small_batches(docs.sparkSession)
    blocks = _blocks(benchmark, item_col, item_text_col, window)
    test = next(blocks)
    if next(blocks, None) is not None:
        row = "_".join(["row", *docs.columns])  # the name of no column
        numbered = Spool(docs.sparkSession, "decontam").table("docs", docs.withColumn(row, F.monotonically_increasing_id()))
        found = scan(numbered, benchmark, id_col=row, text_col=text_col, item_col=item_col, item_text_col=item_text_col, window=window)
        return numbered.join(found.where("contaminated").select(row), row, "left_anti").select(*[numbered[c] for c in docs.columns])

    @F.arrow_udf("boolean")
    def clean(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for text in texts:
            keep = np.ones(len(text), bool)
            for lo, _, b, o in pieces(*text_bytes(text), 1 << 22):
                words = Words(b, o)
                p, _, n = find(test, words)
                doc = np.searchsorted(words.off, p, "right") - 1
                for d in np.unique(doc).tolist():
                    hit = sum(e - s for s, e in _union(p[doc == d], p[doc == d] + n[doc == d]))
                    keep[lo + d] = 20 * hit < words.off[d + 1] - words.off[d]
            yield pa.array(keep)
        release()

    return docs.where(clean(docs[text_col].cast("string")))
