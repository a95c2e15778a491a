"""Near-duplicate classes by improved consistent weighted sampling over TF-IDF shingles.

A text's shingles are its runs of five words (all its words, if it has one to four), with
weight tf * idf. Document frequencies are counted over all documents: exactly for every
shingle that at least one document in FREQUENT has, while rarer ones count as if they had
just that share and all get the greatest idf. So an idf depends on a shingle's share of
the documents, not on their number, and the table of counts that tasks get has a proven
bound. ICWS draws samples whose collision probability is the weighted Jaccard similarity;
they are banded, texts that share a band are candidates, and a pair is linked if its
weighted Jaccard similarity, measured on the whole texts, is at least the threshold.
Classes are connected components of the links, named by their least id.

No bucket is expanded into all its pairs: each member is held against the bucket's first
LEADERS members in the order of a hash, which settles buckets that small and connects the
members of large groups of near copies. What is left are larger buckets whose members are
still in different components, mostly texts that only share a heavy common line. For these
documents candidates are found in another, exact way: two texts that are similar enough
must share one of the rarest shingles that make up a fifth of each one's weight (prefix
filtering, rarity by the counted frequencies, below those by the cells of the first count,
then by hash), so that every pair of them still gets its measurement.

Defined results: equal word sequences are one class without a measurement; texts without
words, null and empty ones are linked to texts that equal them (null counts as empty).
Repeated rows are members of the same class; rows without an id have one only if a text with
an id equals theirs. Ties need no rule: similarity is symmetric and
classes are named by the least id. An empty table gives no rows. Only the named columns are
read; ids are integers.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomline.llm.bytewords import Words, lean, mix, pieces, text_bytes
from loomline.llm.components import components
from loomline.llm.spool import Spool

SHINGLE, THRESHOLD = 5, 0.8
#: A pair of similarity 0.8 shares no band of 16 by 3 samples with a chance of 1 in 100,000.
BANDS, ROWS = 16, 3
#: A shingle in one document of so many has its frequency counted; MOST_COUNTED such shingles at most (8 MB).
FREQUENT, MOST_COUNTED = 1000, 1 << 19
SKETCH_BITS = 20
#: Members of a bucket that all others are held against.
LEADERS = 8
#: Pairs that one turn over the documents left may look at, for each of their shingles; most fail the bound in the join.
PAIRS = 256
#: Of the 48 samples, so many must agree before two texts are measured (at similarity 0.8 fewer do with a chance of 1 in a million).
AGREE = 24

_rng = np.random.default_rng(11)
_uniform = lambda: 1 - _rng.random(1 << 16)
_R = -np.log(_uniform() * _uniform())
_LC = np.log(-np.log(_uniform() * _uniform()))
_BETA = _rng.random(1 << 16)
_ODD = _rng.integers(1, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def profiles(words: Words, n_docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(offsets, shingle hash, how often) of each document, hashes ascending within it."""
    h = words.hashes()
    at, g = words.grams(SHINGLE, h)
    doc = np.searchsorted(words.off, at, "right") - 1
    size = np.diff(words.off)
    few = np.flatnonzero((size > 0) & (size < SHINGLE))
    if len(few):
        own = [int(mix(np.array([sum(int(x) * 0xD1342543DE82EF95**j for j, x in enumerate(h[words.off[d] : words.off[d + 1]])) % 2**64 ^ int(size[d])], np.uint64))[0]) for d in few]
        doc, g = np.concatenate([doc, few]), np.concatenate([g, np.array(own, np.uint64)])
    order = np.lexsort((g, doc))
    doc, g = doc[order], g[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    return np.searchsorted(doc[first], np.arange(n_docs + 1)), g[first], np.diff(np.append(first, len(g)))


def bucket(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


@dataclass
class Frequencies:
    """Documents, the least frequency that is counted, the shingles that have it (ascending) with their frequencies, and documents a cell, up to the floor."""

    documents: int
    floor: int
    shingles: np.ndarray
    counts: np.ndarray
    cells: np.ndarray

    def of(self, h: np.ndarray) -> np.ndarray:
        """Frequency of each shingle, the floor if it is lower."""
        out = np.full(len(h), self.floor, np.int64)
        if len(self.shingles):
            k = np.searchsorted(self.shingles, h)
            k[k == len(self.shingles)] = 0
            same = self.shingles[k] == h
            out[same] = self.counts[k[same]]
        return out

    def rarity(self, h: np.ndarray, df: np.ndarray) -> np.ndarray:
        """What shingles are ordered by: a cell holds no fewer documents than each of its shingles, so it tells those under the floor apart that `of` can't."""
        return np.where(df > self.floor, df, self.cells[bucket(h)])

    def idf(self, df: np.ndarray) -> np.ndarray:
        """Between 1 and 1.5: what thousands of near copies share must not weigh so little that their few edits part them."""
        most = np.log(max(self.documents / self.floor, np.e))
        return 1 + 0.5 * np.clip(np.log(max(self.documents, 1) / df) / most, 0, 1)


def _cells(docs: DataFrame, text_col: str) -> tuple[np.ndarray, int]:
    """Documents a shingle cell, and documents; the partitions' counts are added up in parts before they come here."""
    parts = 16
    width = (1 << SKETCH_BITS) // parts

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = np.zeros(1 << SKETCH_BITS, np.int32), 0
        for batch in batches:
            n += len(batch)
            for lo, hi, b, o in pieces(*text_bytes(batch.column(0))):
                seen += np.bincount(bucket(profiles(Words(b, o), hi - lo)[1]), minlength=len(seen)).astype(np.int32)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(parts), pa.int32()), pa.array([seen[i * width : (i + 1) * width].tobytes() for i in range(parts)], pa.binary()), pa.array([n if i == 0 else 0 for i in range(parts)], pa.int64())], ["part", "seen", "n"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        n: dict[int, int] = {}
        for batch in batches:
            for p, raw, k in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                total[p] = total.get(p, 0) + np.frombuffer(raw, np.int32).astype(np.int64)
                n[p] = n.get(p, 0) + k
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary()), pa.array([n[p] for p in total], pa.int64())], ["part", "seen", "n"])

    counted = docs.select(docs[text_col].cast("string")).mapInArrow(lean(count), "part int, seen binary, n bigint")
    out, docs_seen = np.zeros(1 << SKETCH_BITS, np.int64), 0
    for r in counted.repartition(parts, "part").mapInArrow(lean(add), "part int, seen binary, n bigint").toLocalIterator():
        out[r.part * width : (r.part + 1) * width] = np.frombuffer(r.seen, np.int64)
        docs_seen += r.n
    return out, docs_seen


def document_frequencies(docs: DataFrame, text_col: str = "text") -> Frequencies:
    """Exact frequencies of all frequent shingles, in two passes over all texts.

    The first counts cells of shingles; only those in cells that hold as many documents as a
    frequent shingle has are counted one by one in the second. Documents hold S shingles in
    all, so no more than S / floor of them can have the frequency `floor`: that bounds the table.
    """
    cells, n = _cells(docs, text_col)
    floor = max(-(-n // FREQUENT), -(-int(cells.sum()) // MOST_COUNTED), 1)
    loud = cells >= max(floor, 2)
    held_cells = np.minimum(cells, floor).astype(np.int32)
    if not loud.any():
        return Frequencies(n, floor, np.empty(0, np.uint64), np.empty(0, np.int64), held_cells)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def summed() -> tuple[np.ndarray, np.ndarray]:
            h, at = np.unique(np.concatenate([x for x, _ in held]), return_inverse=True)
            return h, np.bincount(at, np.concatenate([c for _, c in held]), len(h)).astype(np.int64)

        for batch in batches:
            for lo, hi, b, o in pieces(*text_bytes(batch.column(0))):
                h = profiles(Words(b, o), hi - lo)[1]
                h = h[loud[bucket(h)]]
                held.append((h, np.ones(len(h), np.int64)))
                size += len(h)
                if size > 1 << 20:
                    held = [summed()]
                    if len(held[0][0]) > 1 << 19:
                        yield told(*held.pop())
                    size = sum(len(x) for x, _ in held)
        if held:
            yield told(*summed())

    def told(h: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c)], ["h", "n"])

    counted = docs.select(docs[text_col].cast("string")).mapInArrow(lean(count), "h bigint, n bigint")
    found = counted.groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= max(floor, 2)).toArrow()
    h, c = (found.column(i).to_numpy() for i in (0, 1))
    order = np.argsort(h.view(np.uint64))
    return Frequencies(n, floor, h.view(np.uint64)[order], c[order], held_cells)


def samples(off: np.ndarray, h: np.ndarray, log_weight: np.ndarray) -> np.ndarray:
    """ICWS samples, one row a document with shingles and one column a sample."""
    full = np.flatnonzero(np.diff(off) > 0)
    starts, size = off[:-1][full], np.diff(off)[full]
    out = np.zeros((len(full), len(_ODD)), np.uint64)
    row = np.repeat(np.arange(len(full)), size)
    for k, odd in enumerate(_ODD):
        x = h * odd
        r, beta = _R[x >> np.uint64(48)], _BETA[(x >> np.uint64(32)) & np.uint64(0xFFFF)]
        t = np.floor(log_weight / r + beta)
        a = _LC[(x >> np.uint64(16)) & np.uint64(0xFFFF)] - r * (t - beta + 1)
        at = np.flatnonzero(a == np.minimum.reduceat(a, starts)[row])
        at = at[np.unique(row[at], return_index=True)[1]]
        out[:, k] = mix(h[at] ^ (t[at].astype(np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    return out


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Of two profiles (hashes ascending, weights)."""
    if not len(a[0]) or not len(b[0]):
        return 0.0
    k = np.searchsorted(b[0], a[0])
    k[k == len(b[0])] = 0
    same = b[0][k] == a[0]
    least = np.minimum(a[1][same], b[1][k[same]]).sum()
    return float(least / (a[1].sum() + b[1].sum() - least))


def band_keys(sig: np.ndarray, weight: np.ndarray, threshold: float) -> np.ndarray:
    """Keys of each document's bands, for its own class of total weight and for the next one.

    Similar documents' weights differ by no more than 1 / threshold, so they share a class;
    documents that only share a heavy common line mostly don't, and stay out of each other's
    buckets.
    """
    key = np.zeros((len(sig), BANDS), np.uint64)
    for r in range(ROWS):
        key = mix((key * np.uint64(0x9E3779B97F4A7C15) + sig[:, r::ROWS]).ravel()).reshape(key.shape)
    key += np.arange(BANDS, dtype=np.uint64)
    size = np.floor(np.log(weight) / -np.log(threshold) + 1e-9).astype(np.int64)
    both = [mix((key ^ ((size + k).astype(np.uint64) * np.uint64(0xD1342543DE82EF95))[:, None]).ravel()).reshape(key.shape) for k in (0, 1)]
    return np.concatenate(both, 1).view(np.int64)


def prefixes(off: np.ndarray, h: np.ndarray, weight: np.ndarray, rarity: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(offsets, shingles, weight from there on) of each document's rarest shingles, up to more than 1 - threshold of its weight.

    Two documents that share none of these differ in more than that share of one's weight.
    Shingles of equal rarity go by their hash, so that all documents have one order.
    """
    doc = np.repeat(np.arange(len(off) - 1), np.diff(off))
    order = np.lexsort((h, rarity, doc))
    h, weight = h[order], weight[order]
    before = np.cumsum(weight) - weight
    full = np.diff(off) > 0
    start, total = np.zeros(len(off) - 1), np.ones(len(off) - 1)
    start[full] = before[off[:-1][full]]
    total[full] = np.add.reduceat(weight, off[:-1][full])
    keep = before - start[doc] <= (1 - threshold) * total[doc] * (1 + 1e-9)
    return np.searchsorted(doc[keep], np.arange(len(off))), h[keep], (total[doc] - before + start[doc])[keep]


def _signer(known: Frequencies, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, b, o in pieces(*text_bytes(batch.column(1))):
                words = Words(b, o)
                off, h, tf = profiles(words, hi - lo)
                df = known.of(h)
                weight = tf * known.idf(df)
                full = np.flatnonzero(np.diff(off) > 0)
                keys, total, sketch = [None] * (hi - lo), [None] * (hi - lo), [None] * (hi - lo)
                rare_off, rare, rest = np.zeros(hi - lo + 1, np.int64), np.empty(0, np.uint64), np.empty(0)
                if len(full):
                    rare_off, rare, rest = prefixes(off, h, weight, known.rarity(h, df), threshold)
                    sig, sums = samples(off, h, np.log(weight)), np.add.reduceat(weight, off[:-1][full])
                    few = (sig >> np.uint64(56)).astype(np.uint8)
                    for i, k, w, s in zip(full.tolist(), band_keys(sig, sums, threshold), sums.tolist(), few, strict=True):
                        keys[i], total[i], sketch[i] = k, w, s.tobytes()
                raw = words.hashes().astype("<u8").tobytes() if len(words) else b""
                cut_at = (words.off * 8).tolist()
                digest = [blake2b(raw[s:e] if e > s else b"=" + bytes(b[x:y]), digest_size=16).digest() for s, e, x, y in zip(cut_at, cut_at[1:], o, o[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(digest, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(total, pa.float64()), pa.array(sketch, pa.binary()), pa.ListArray.from_arrays(pa.array(rare_off, pa.int32()), pa.StructArray.from_arrays([pa.array((rare >> np.uint64(32)).astype(np.uint32).view(np.int32)), pa.array(rest.astype(np.float32) * np.float32(1 + 1e-6))], ["key", "rest"]))], ["id", "digest", "keys", "weight", "sketch", "rare"])

    return lean(run)


def _agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs whose samples agree often enough."""
    for batch in batches:
        a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, BANDS * ROWS) for c in (2, 3))
        ok = pa.array((a == b).sum(1) >= AGREE)
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(ok), batch.column(1).filter(ok)], ["u", "v"])


def _measure(known: Frequencies, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: OrderedDict = OrderedDict()

        def profile(key: int, text: str | None):
            if key not in kept:
                b, o = text_bytes(pa.array([text], pa.large_string()))
                _, h, tf = profiles(Words(b, o), 1)
                kept[key] = h, tf * known.idf(known.of(h))
                if len(kept) > 64:
                    kept.popitem(last=False)
            kept.move_to_end(key)
            return kept[key]

        for batch in batches:
            u, v, s = [], [], []
            for a, b, x, y in zip(*[batch.column(c) for c in range(4)], strict=True):
                sim = weighted_jaccard(profile(a.as_py(), x.as_py()), profile(b.as_py(), y.as_py()))
                if sim >= threshold:
                    u.append(a.as_py())
                    v.append(b.as_py())
                    s.append(sim)
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array(s, pa.float64())], ["u", "v", "similarity"])

    return lean(run)


def classes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(id, class_id) of every row, class_id being the least id of the class."""
    spark = docs.sparkSession
    spool = Spool(spark, "near-dup")
    texts = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text"))
    known = document_frequencies(docs, text_col)
    signed = spool.table("signed", texts.mapInArrow(_signer(known, threshold), "id bigint, digest binary, keys array<bigint>, weight double, sketch binary, rare array<struct<key:int,rest:float>>"))
    reps = spool.table("reps", signed.groupBy("digest").agg(F.min("id").alias("rep"), *[F.first(c, ignorenulls=True).alias(c) for c in ("keys", "weight", "sketch", "rare")]))
    bands = reps.where("keys is not null").select(F.explode("keys").alias("key"), "rep")
    shared = bands.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    bands = spool.table("bands", bands.join(shared, "key").join(reps.select("rep", "weight", "sketch"), "rep"))
    first = Window.partitionBy("key").orderBy(F.xxhash64("rep"), "rep")
    leaders = bands.withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= LEADERS).select("key", F.col("rep").alias("v"), F.col("weight").alias("v_weight"), F.col("sketch").alias("v_sketch"))

    def linked(met: DataFrame, name: str) -> DataFrame:
        """The links among the met (rep, v) of a bucket: by weight, by samples, then by the whole texts."""
        near = (F.least("weight", "v_weight") >= threshold * (1 - 1e-9) * F.greatest("weight", "v_weight")) & (F.col("rep") != F.col("v"))
        pairs = met.where(near).select(F.greatest("rep", "v").alias("u"), F.least("rep", "v").alias("v"), "sketch", "v_sketch")
        pairs = spool.table(f"pairs_{name}", pairs.mapInArrow(_agree, "u bigint, v bigint").distinct())
        x, y = (texts.select(F.col("id").alias(c), F.col("text").alias(f"{c}_text")) for c in "uv")
        both = pairs.join(x, "u").join(y, "v").select("u", "v", "u_text", "v_text")
        return spool.table(f"links_{name}", both.mapInArrow(_measure(known, threshold), "u bigint, v bigint, similarity double"))

    links = linked(bands.join(leaders, "key"), "0")
    roots = components(links.select("u", "v"))
    # larger buckets that still hold more than one component: their members meet by rare shingles, in so many turns that
    # each turn's pairs stay within PAIRS times these documents' shingles
    at = bands.join(roots, bands.rep == roots.node, "left").select("key", "rep", F.coalesce("root", "rep").alias("root"))
    mixed = at.groupBy("key").agg(F.min("root").alias("least"), F.max("root").alias("most"), F.count("*").alias("n")).where((F.col("n") > LEADERS) & (F.col("least") != F.col("most")))
    left = at.join(mixed.select("key"), "key").select("rep", "root").distinct()
    left = spool.table("left", left.join(reps.select("rep", "weight", "sketch", "rare"), "rep").select("rep", "root", "weight", "sketch", F.inline("rare")))
    shared = left.groupBy("key").agg(F.min("root").alias("least"), F.max("root").alias("most"), F.count("*").alias("n")).where("least <> most")
    left = spool.table("rare", left.join(shared.select("key", "least", "n"), "key"))
    pairs, members = left.agg(F.sum(F.when(F.col("root") != F.col("least"), F.col("n"))), F.count("*")).first()
    turns, more = -(-(pairs or 0) // (PAIRS * max(members, 1))), False
    for turn in range(turns):
        # of two members in different components at least one is outside the least: it is the one that is held against the others
        lead = left.where((F.col("root") != F.col("least")) & (F.pmod(F.xxhash64("rep"), F.lit(turns)) == turn)).select("key", F.col("rep").alias("v"), F.col("root").alias("v_root"), F.col("weight").alias("v_weight"), F.col("sketch").alias("v_sketch"), F.col("rest").alias("v_rest"))
        # what two documents share can't weigh more than either has from their first common shingle on
        enough = F.least("rest", "v_rest") >= threshold / (1 + threshold) * (F.col("weight") + F.col("v_weight"))
        new = linked(left.drop("least", "n").join(lead, "key").where((F.col("root") != F.col("v_root")) & enough), str(turn + 1))
        if not new.isEmpty():
            links, more = links.unionByName(new), True
    if more:
        roots = components(links.select("u", "v"))
    spool.drop("bands", "left", "rare", *(f"{what}_{k}" for what in ("pairs", "links") for k in range(turns + 1)))
    roots = roots.select(F.col("node").alias("rep"), "root")
    named_class = reps.join(roots, "rep", "left").select("digest", F.coalesce("root", "rep").alias("class_id"))
    return signed.select("id", "digest").join(named_class, "digest").select(F.col("id").alias(id_col), "class_id")
