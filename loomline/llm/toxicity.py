"""Toxicity by non-negative positive-unlabelled learning.

A numpy logistic model over the presence of words and word beginnings is trained with
the class-prior-corrected risk  prior * R_p(+) + max(0, R_u(-) - prior * R_p(-)),
where confirmed toxic rows are the positives and the unlabelled texts are drawn from the
rows that `labels` covers, whatever it says of them: a label of 0 is never used as a
negative. (Drawn from all documents they reject clean ones, see the README: the prior
must be that of the sample.) The prior is the share of toxic rows among the labelled ones, unless it is
given. The fit takes a bounded sample (`max_rows`, a third of it positives, chosen by a
hash of the id); everything it then scores, it scores whole.

Defined results: null and empty texts have no features and get the model's score for
that; without any positive training row every score is 0; labels that are null or for
unknown documents are left out, and repeated rows of an id count once, with their least
text and greatest label. Scores depend on
the text alone, so equal texts score alike. Only the named columns are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.llm.bytewords import Words, lean, pieces, release, text_bytes
from loomline.llm.spool import small_batches

#: Bytes of word beginnings that are features beside the whole words.
PREFIXES = (4, 5, 6, 7, 8, 9)
BUCKETS = 1 << 18
THRESHOLD = 0.7


@dataclass
class Model:
    features: np.ndarray  # sorted 64-bit fingerprints
    weights: np.ndarray
    bias: float

    def scores(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        """One score a text, over all its words."""
        out = np.full(len(off) - 1, self.bias)
        if len(self.features):
            may = np.zeros(1 << 20, bool)
            may[self.features >> np.uint64(44)] = True
            for lo, hi, b, o in pieces(buf, off):
                words = Words(b, o)
                if not len(words):
                    continue
                hit, doc = [], []
                doc_of = np.repeat(np.arange(hi - lo), np.diff(words.off))
                for h in fingerprints(words):
                    at = np.flatnonzero(may[h >> np.uint64(44)])
                    k = np.searchsorted(self.features, h[at])
                    k[k == len(self.features)] = 0
                    ok = self.features[k] == h[at]
                    hit.append(k[ok])
                    doc.append(doc_of[at[ok]])
                pair = np.unique(np.concatenate(doc) * len(self.features) + np.concatenate(hit))
                np.add.at(out, lo + pair // len(self.features), self.weights[pair % len(self.features)])
        return 1 / (1 + np.exp(-np.clip(out, -50, 50)))


def fingerprints(words: Words) -> Iterator[np.ndarray]:
    """Whole words, then beginnings; 0 where a word is too short for one."""
    yield words.hashes()
    for n in PREFIXES:
        yield words.prefix_hashes(n)


def _documents_of(buf: np.ndarray, off: np.ndarray) -> Iterator[np.ndarray]:
    """The distinct fingerprints of each text."""
    for lo, hi, b, o in pieces(buf, off):
        words = Words(b, o)
        all_h = np.stack(list(fingerprints(words))) if len(words) else np.empty((1, 0), np.uint64)
        for d in range(hi - lo):
            h = np.unique(all_h[:, words.off[d] : words.off[d + 1]])
            yield h[h != 0]


def nnpu_fit(rows: list[np.ndarray], positive: np.ndarray, unlabelled: np.ndarray, n_features: int, prior: float, *, epochs: int = 400, rate: float = 0.3, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias that lower the non-negative risk, by Adam over the whole sample.

    A row may be in both samples, the confirmed positives and the unlabelled.
    Where the corrected negative risk falls under zero, the step goes against it, as the
    estimator asks for, so that positives hidden among the unlabelled aren't fitted as negatives.
    """
    col = np.concatenate(rows) if rows else np.empty(0, np.int64)
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    is_p, is_u = positive.astype(bool), unlabelled.astype(bool)
    n_p, n_u = int(is_p.sum()), int(is_u.sum())
    w, b = np.zeros(n_features), 0.0
    m, v = np.zeros(n_features + 1), np.zeros(n_features + 1)
    for t in range(1, epochs + 1):
        z = b + np.bincount(row, w[col], minlength=len(rows))
        up = 1 / (1 + np.exp(-np.clip(z, -50, 50)))
        # logistic loss: l(z, +) = log(1 + e^-z), l(z, -) = log(1 + e^z); dl(+) = up - 1, dl(-) = up
        neg_u, neg_p = np.logaddexp(0, z[is_u]).mean(), np.logaddexp(0, z[is_p]).mean()
        grad = np.zeros(len(rows))
        if neg_u - prior * neg_p >= 0:
            grad[is_p] += prior * (up[is_p] - 1) / n_p
            grad[is_u] += up[is_u] / n_u
            grad[is_p] -= prior * up[is_p] / n_p
        else:
            grad[is_u] -= up[is_u] / n_u
            grad[is_p] += prior * up[is_p] / n_p
        g = np.r_[np.bincount(col, grad[row], minlength=n_features) + decay * w, grad.sum()]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return w, float(b)


def held_out(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 3 == 1


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_rows: int = 12_000, max_features: int = 4096, min_support: int = 3, workers: int = 12, prior: float | None = None) -> Model:
    """Fit on at most `max_rows` rows with crc32(id) mod 3 other than 1.

    The driver gets counts of fixed size per worker, then of each sample row only the
    numbers of at most `max_features` chosen features.
    """
    learns = lambda c: c.isNotNull() & (F.crc32(c.cast("string").cast("binary")) % 3 != 1)
    known = labels.where(F.col(label_col).isNotNull() & learns(F.col(id_col)))
    known = known.groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("y"))
    rate = known.agg(F.avg("y"), F.count("*")).first()
    if not rate[1] or not rate[0]:
        return Model(np.empty(0, np.uint64), np.empty(0), -50.0)
    # the positives, and apart from them rows whose label isn't looked at; both in the order of a hash
    texts = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    first = lambda rows, n, name: rows.orderBy(F.xxhash64("id"), "id").limit(n).distinct().select("id", F.lit(1).alias(name))
    positives = first(known.where("y = 1").select("id"), max_rows // 3, "p")
    chosen = positives.join(first(known.select("id"), max_rows - max_rows // 3, "u"), "id", "full").na.fill(0, ["p", "u"])
    sample = texts.join(F.broadcast(chosen), "id").groupBy("id").agg(F.min("text").alias("text"), F.max("p").alias("p"), F.max("u").alias("u")).repartition(workers, "id").select("text", "p", "u")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, BUCKETS), np.int32)
        n = np.zeros(2, np.int64)
        for batch in batches:
            flags = zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)
            for (p, u), h in zip(flags, _documents_of(*text_bytes(batch.column(0))), strict=True):
                at = np.unique(h >> np.uint64(46))
                for k, in_it in enumerate((p, u)):
                    if in_it:
                        seen[k, at] += 1
                        n[k] += 1
        yield pa.RecordBatch.from_arrays([pa.array([seen.tobytes()], pa.binary()), pa.array([int(n[0])]), pa.array([int(n[1])])], ["seen", "n_p", "n_u"])

    seen, n = np.zeros((2, BUCKETS), np.int64), np.zeros(2, np.int64)
    for r in sample.mapInArrow(lean(count), "seen binary, n_p bigint, n_u bigint").toLocalIterator():
        seen += np.frombuffer(r.seen, np.int32).reshape(2, BUCKETS)
        n += (r.n_p, r.n_u)
    if not n.all():
        return Model(np.empty(0, np.uint64), np.empty(0), -50.0)
    # buckets that stand out among the positives; the fingerprints in them are told apart next
    lift = (seen[0] + 0.1) / (n[0] + 1) / ((seen[1] + 1) / (n[1] + 1))
    loud = np.flatnonzero((seen[0] >= min_support) & (lift > 1.5))
    loud = loud[np.argsort(-(seen[0] * np.log(lift))[loud], kind="stable")][: 2 * max_features]
    may = np.zeros(BUCKETS, bool)
    may[loud] = True

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [h[may[h >> np.uint64(46)]].astype("<u8").tobytes() for h in _documents_of(*text_bytes(batch.column(0)))]
            yield pa.RecordBatch.from_arrays([pa.array(got, pa.binary()), batch.column(1), batch.column(2)], ["h", "p", "u"])

    flags, found = [], []
    for r in sample.mapInArrow(lean(pick), "h binary, p int, u int").toLocalIterator():
        found.append(np.frombuffer(r.h, "<u8"))
        flags.append((r.p, r.u))
    positive, unlabelled = np.array(flags).T
    every, at = np.unique(np.concatenate(found), return_inverse=True)
    size = [len(x) for x in found]
    p, u = (np.bincount(at, np.repeat(x, size), len(every)) for x in (positive, unlabelled))
    lift = (p + 0.1) / (n[0] + 1) / ((u + 1) / (n[1] + 1))
    keep = np.flatnonzero((p >= min_support) & (lift > 1.5))
    keep = np.sort(keep[np.argsort(-(p * np.log(lift))[keep], kind="stable")][:max_features])
    number = np.full(len(every), -1)
    number[keep] = np.arange(len(keep))
    rows, stop = [], np.r_[0, np.cumsum(size)]
    for lo, hi in zip(stop, stop[1:], strict=False):
        k = number[at[lo:hi]]
        rows.append(k[k >= 0])
    order = sorted(range(len(rows)), key=lambda i: (flags[i], rows[i].tolist()))  # the same model whatever order rows arrive in
    w, b = nnpu_fit([rows[i] for i in order], positive[order], unlabelled[order], len(keep), float(rate[0]) if prior is None else prior)
    return Model(every[keep], w, b)


def score(docs: DataFrame, model: Model, *, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """All columns of docs and `score_col`, which replaces a column of that name; no shuffle. Only the text goes through Python."""
    small_batches(docs.sparkSession)

    @F.arrow_udf("double")
    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for text in texts:
            yield pa.array(model.scores(*text_bytes(text)))
        release()

    others = [docs[c] for c in docs.columns if c != score_col]
    return docs.select(*others, run(docs[text_col].cast("string")).alias(score_col))
