"""Operators that compare rows, against brute force on small fixtures."""

import math
import re
from itertools import chain

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomline.llm import ann, induced, near_dup, passage_chain, suffix_dedup, transcripts
from loomline.llm.components import components

DOCS = "doc_id bigint, text string, key string, h string, rep string, id string"
rng = np.random.default_rng(3)
VOCABULARY = ["".join(rng.choice(list("abcdefghij"), 5)) for _ in range(2000)]


def words(n, r=rng):
    return [str(x) for x in r.choice(VOCABULARY, n)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "k", "h", "r", "i") for i, t in rows], DOCS)


# -- suffix arrays -----------------------------------------------------------------------------


def test_induced_sorting():
    r = np.random.default_rng(1)
    for case in range(300):
        t = r.integers(0, int(r.integers(1, 5)), int(r.integers(0, 60))).astype(np.uint16)
        depth = int(r.integers(2, 12))
        seen, text = [], t.tolist()
        for position, common in induced.suffix_blocks(t, depth, int(r.choice([2, 10, 1000]))):
            seen += position.tolist()
            for k in range(1, len(position)):
                a, b = text[position[k - 1] :][:depth], text[position[k] :][:depth]
                same = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
                assert a <= b and common[k] == same, case
        assert sorted(seen) == list(range(len(t)))


def brute_kept(rows, length):
    least = {}
    for i, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - length + 1):
            least[b[k : k + length]] = min(i, least.get(b[k : k + length], i))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 2, bool)
        for k in range(len(b) - length + 1):
            if least[b[k : k + length]] < i:
                gone[1 + k : 1 + k + length] = True
        runs = int((gone[1:] & ~gone[:-1]).sum())
        out.append((i, len(b), int(gone.sum()), runs, bytes(np.frombuffer(b, np.uint8)[~gone[1:-1]])))
    return sorted(out)


def test_suffix_dedup(spark):
    shared, line = " ".join(words(30)), " ".join(words(9)) + " é"
    rows = [(i, " ".join(words(40)) + line + " ".join(words(20))) for i in range(12)]
    rows += [(20, shared), (21, "x" + shared + "y"), (22, shared[10:90] + shared[60:]), (23, shared), (23, "other row " + shared), (24, None), (25, ""), (26, "short"), (27, "For " * 80), (28, "so For " + "For " * 40), (29, "é" * 60), (30, "a" + "é" * 50), (31, "-" * 200), (32, "-" * 60 + "z"), (33, rows[0][1] * 200)]
    rows += [(20, shared)]
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) for r in suffix_dedup.dedup(frame(spark, rows)).collect())
    assert got == brute_kept(rows, 50)
    whole = suffix_dedup.without_repeats(frame(spark, rows))
    assert whole.columns == [c.split()[0] for c in DOCS.split(", ")] and whole.where("key <> 'k'").count() == 0
    assert suffix_dedup.dedup(frame(spark, [])).count() == 0


def test_long_documents_are_cut_into_stretches():
    b = np.frombuffer(" ".join(words(600)).encode(), np.uint8)
    off = np.array([0, len(b)])
    parts = list(suffix_dedup._long(b, off, 50, 500))
    assert len(parts) > 3 and sum(len(x) - 49 for _, _, x, _ in parts) == len(b) - 49
    _, start, n, _ = suffix_dedup.anchors(b, off)
    assert n.sum() == len(b) - 49 and (start[1:] == start[:-1] + n[:-1]).all()


# -- near duplicates ---------------------------------------------------------------------------


def test_components(spark):
    links = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 9), (20, 21)] + [(100 + i, 101 + i) for i in range(40)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {2: 1, 3: 1, 9: 7, 8: 7, 21: 20} | {101 + i: 100 for i in range(40)}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def brute_classes(rows):
    """Classes by counted frequencies: tf * (1 + 0.5 * log(n / df) / log(n / floor)) over Jaccard pairs, all of them."""
    from collections import Counter

    tf = []
    for _, t in rows:
        w = re.findall(r"[0-9a-z]+", (t or "").lower())
        tf.append(Counter(tuple(w[k : k + 5]) for k in range(max(len(w) - 4, min(len(w), 1)))))
    df, n = Counter(g for c in tf for g in c), len(rows)
    floor = max(-(-n // near_dup.FREQUENT), -(-sum(map(len, tf)) // near_dup.MOST_COUNTED))
    idf = {g: 1 + 0.5 * math.log(n / max(d, floor)) / math.log(n / floor) for g, d in df.items()}
    weighed = [{g: k * idf[g] for g, k in c.items()} for c in tf]

    def similarity(a, b):
        least = sum(min(x, b[g]) for g, x in a.items() if g in b)
        return least / (sum(a.values()) + sum(b.values()) - least) if a and b else 0

    root = list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in range(len(rows)):
        for b in range(a):
            same = (rows[a][1] or "") == (rows[b][1] or "") or similarity(weighed[a], weighed[b]) >= near_dup.THRESHOLD
            if same and find(a) != find(b):
                root[find(a)] = find(b)
    least = {}
    for a in range(len(rows)):
        least[find(a)] = min(rows[a][0], least.get(find(a), rows[a][0]))
    return sorted((rows[a][0], least[find(a)]) for a in range(len(rows)))


def edited(text, n, r):
    out = list(text)
    for _ in range(n):
        out[int(r.integers(0, len(out)))] = str(r.choice(VOCABULARY))
    return out


def test_near_duplicates(spark):
    r = np.random.default_rng(5)
    line = words(10, r)
    base = words(200, r)
    rows = [(100 + i, " ".join(edited(base, int(r.integers(0, 6)), r))) for i in range(30)]
    rows += [(200 + i, " ".join(words(60, r) + line)) for i in range(20)]
    rows += [(1, None), (2, ""), (3, "!!"), (4, "!!"), (5, "a b"), (6, "A, b!"), (7, "a c"), (8, " ".join(base)), (8, " ".join(base)), (9, "For " * 500), (10, "For " * 480)]
    got = sorted((x.doc_id, x.class_id) for x in near_dup.classes(frame(spark, rows)).collect())
    assert got == brute_classes(rows)
    assert near_dup.classes(frame(spark, [])).count() == 0


def test_frequencies_are_counted(spark, monkeypatch):
    """Frequent shingles get their true document frequency, the rest get the floor."""
    from loomline.llm.bytewords import Words, text_bytes
    import pyarrow as pa

    monkeypatch.setattr(near_dup, "FREQUENT", 20)
    r = np.random.default_rng(12)
    lines = [" ".join(words(7, r)) for _ in range(4)]
    texts = [" ".join(words(12, r)) + " " + " ".join(lines[k] for k in range(4) if i % (k + 2) == 0) for i in range(200)] + [None, lines[0] + " " + lines[0]]
    got = near_dup.document_frequencies(frame(spark, list(enumerate(texts))))
    profiles = [near_dup.profiles(Words(*text_bytes(pa.array([t], pa.string()))), 1)[1] for t in texts]
    h, true = np.unique(np.concatenate(profiles), return_counts=True)
    assert got.documents == 202 and got.floor == 11
    assert (got.of(h) == np.maximum(true, 11)).all() and len(got.shingles) == (true >= 11).sum()
    assert got.idf(np.array([11, 202])).tolist() == [1.5, 1.0]


def test_icws_estimates_similarity():
    h = np.sort(rng.integers(0, 2**63, 400, dtype=np.uint64))
    w = rng.random(400) + 0.5
    a, b = (h[:300], w[:300]), (h[60:360], w[60:360])
    true = near_dup.weighted_jaccard(a, b)
    sig = [near_dup.samples(np.array([0, 300]), x, np.log(y))[0] for x, y in (a, b)]
    assert abs((sig[0] == sig[1]).mean() - true) < 0.25
    assert near_dup.weighted_jaccard(a, a) == pytest.approx(1.0) and near_dup.weighted_jaccard(a, (h[:0], w[:0])) == 0


# -- passages ----------------------------------------------------------------------------------


def brute_chain(seg, cost):
    n = len(seg)
    order = sorted(range(n), key=lambda i: (seg[i][0], seg[i][1]))
    best = {}
    for j in order:
        best[j] = float(seg[j][2])
        for i in order:
            if i in best and i != j and seg[i][0] + seg[i][2] <= seg[j][0] and seg[i][1] + seg[i][2] <= seg[j][1]:
                gap = seg[j][0] - seg[i][0] - seg[i][2] + seg[j][1] - seg[i][1] - seg[i][2]
                best[j] = max(best[j], seg[j][2] + best[i] - cost * gap)
    return max(best.values())


def test_chaining_finds_the_best_chain():
    r = np.random.default_rng(2)
    for _ in range(200):
        seg = np.unique(np.stack([r.integers(0, 80, 12), r.integers(0, 80, 12), r.integers(1, 12, 12)], 1), axis=0)
        best = passage_chain.chains(seg)[0]
        got = float(seg[best[0]][2])
        for i, j in zip(best, best[1:], strict=False):
            a, b = seg[i], seg[j]
            assert a[0] + a[2] <= b[0] and a[1] + a[2] <= b[1]
            got += b[2] - 0.25 * (b[0] - a[0] - a[2] + b[1] - a[1] - a[2])
        assert got == pytest.approx(brute_chain(seg.tolist(), 0.25))


def test_passages(spark):
    r = np.random.default_rng(7)
    a, b, c = words(60, r), words(120, r), words(40, r)
    changed = edited(b, 9, r)
    docs = [(1, words(100, r) + a + words(50, r)), (2, words(30, r) + a + words(80, r)), (3, words(70, r) + b), (4, changed + words(20, r)), (5, c + words(100, r)), (6, words(40, r) + c), (7, words(3000, r)), (8, a[:51] + words(99, r)), (9, words(10, r) + a[5:55])]
    rows = [(i, " ".join(w)) for i, w in docs] + [(10, None), (11, ""), (12, "a b"), (13, "For " * 400), (13, "For " * 300), (2, " ".join(docs[1][1]))]
    got = passage_chain.passages(frame(spark, rows)).collect()
    by = {x.doc_id: x for x in got}
    assert len(got) == len(rows) and {i for i, x in by.items() if x.n_passages} == {2, 4, 8, 9}
    assert [(p.start, p.end, p.other, p.other_start) for p in by[2].passages] == [(30, 90, 1, 100)] and by[2].n_repeated == 60
    assert by[4].passages[0].other == 3 and by[4].n_repeated >= 100 and 0.85 < by[4].passages[0].identity < 1
    assert passage_chain.passages(frame(spark, [])).count() == 0
    assert passage_chain.common_length([1, 2, 3, 4], [2, 9, 4, 1]) == 2


def test_passages_with_every_document(spark):
    """Halves of a passage in other documents don't hide the document that has the whole; equal texts and hot passages name all of theirs."""
    r = np.random.default_rng(8)
    p, hot = words(60, r), words(60, r)
    docs = [(i, words(40, r) + part + words(40, r)) for i, part in ((1, p[:30]), (2, p[30:]), (3, p), (7, p[:30]), (8, p[30:]), (9, p))]
    docs += [(20 + i, words(30, r) + hot + words(30, r)) for i in range(25)]
    docs += [(60, docs[6][1]), (10, docs[6][1])]
    by = {x.doc_id: x for x in passage_chain.passages(frame(spark, [(i, " ".join(w)) for i, w in docs])).collect()}
    assert [(q.start, q.end, q.other, q.other_start) for q in by[9].passages] == [(40, 100, 3, 40)] and by[9].n_repeated == 60
    assert not any(by[i].n_passages for i in (1, 2, 3, 7, 8, 10))
    assert all(sorted(q.other for q in by[20 + i].passages) == [10, *range(20, 20 + i)] for i in range(25))
    assert sorted(q.other for q in by[60].passages) == [10, *range(20, 45)] and by[60].n_repeated == 120


def test_whole_passages_behind_hot_halves(spark):
    """Sixty documents hold the first half, sixty the second, two the whole: the later of these is held against the other one."""
    r = np.random.default_rng(14)
    p, line = words(90, r), words(12, r)
    part = {i: p[:40] if i <= 60 else p[50:] if i <= 120 else p for i in range(1, 123)}
    docs = [(i, words(20, r) + line + words(20, r) + x + words(20, r)) for i, x in part.items()]
    by = {x.doc_id: x for x in passage_chain.passages(frame(spark, [(i, " ".join(w)) for i, w in docs]), all_meet=8, every_copy=False).collect()}
    assert [(q.start, q.end, q.other, q.other_start) for q in by[122].passages] == [(52, 142, 121, 52)] and by[122].n_repeated == 90
    assert all(by[i].n_repeated == 0 for i in range(1, 122))
    near = words(200, r)
    docs = [(i, edited(near, 6, r)) for i in range(100)]
    by = {x.doc_id: x for x in passage_chain.passages(frame(spark, [(i, " ".join(w)) for i, w in docs]), all_meet=8, every_copy=False).collect()}
    assert by[0].n_repeated == 0 and all(by[i].n_repeated >= 180 for i in range(1, 100))
    turns = [(i, ["again"] * (400 + 50 * i)) for i in range(20)]
    by = {x.doc_id: x for x in passage_chain.passages(frame(spark, [(i, " ".join(w)) for i, w in turns]), all_meet=8, every_copy=False).collect()}
    assert by[0].n_repeated == 0 and all(by[i].n_repeated >= 400 for i in range(1, 20)) and sum(x.n_passages for x in by.values()) < 1000


def linked(by, x, y, min_words=50, identity=0.8):
    """Whether a passage of both is told, or follows from their passages with a third document."""
    x, y = max(x, y), min(x, y)
    if any(q.other == y for q in by[x].passages):
        return True
    for p in by[x].passages:
        for q in (q for q in by[y].passages if q.other == p.other):
            common = min(p.other_end, q.other_end) - max(p.other_start, q.other_start)
            lacks, longest = [], [common]
            for z in (p, q):
                theirs, own = z.other_end - z.other_start, z.end - z.start
                lacks.append(theirs - round(z.identity * max(theirs, own)))
                longest.append(own - (theirs - common) + min(lacks[-1], theirs - common))
            if common - max(lacks) >= min_words and common - sum(lacks) >= identity * max(longest):
                return True
    return False


def test_fuzzy_passages_of_hot_seeds(spark):
    """Two texts with a passage, each edited in its own way, whose parts many smaller texts have: as if all texts of a seed met."""
    r = np.random.default_rng(21)
    docs = []
    for case in range(6):
        p = words(90, r)
        parts = [p[k : k + 24] for k in range(0, 90, 22)] * 12
        docs += [words(20, r) + x + words(20, r) for x in parts]
        docs += [words(20, r) + edited(p, 6, r) + words(20, r) for _ in range(2)]
    near = words(160, r)
    docs += [edited(near, 8, r) for _ in range(90)] + [words(30, r) + edited(near[50:120], 6, r) + words(10, r) for _ in range(6)]
    table = frame(spark, [(i, " ".join(w)) for i, w in enumerate(docs)])
    by, full = ({x.doc_id: x for x in passage_chain.passages(table, all_meet=n, every_copy=False).collect()} for n in (8, 10**9))
    links = {(i, q.other) for i, x in full.items() for q in x.passages}
    assert len(links) > 4000 and all(linked(by, *pair) for pair in links)
    assert sum(len({q.other for q in x.passages}) for x in by.values()) < len(links) / 2
    covered = lambda x: {k for q in x.passages for k in range(q.start, q.end)}
    assert all(len(covered(full[i]) - covered(by[i])) <= 16 for i in by)
    assert all(by[61 + 62 * case].n_repeated > 50 for case in range(6) if full[61 + 62 * case].n_passages)


def test_runs_of_one_word(spark):
    """Junk of repeated words: links are told or proved, without telling each pair of texts; a run too short for a passage counts with what stands beside it."""
    r = np.random.default_rng(33)
    docs = [list(chain.from_iterable([w] * int(r.integers(20, 76)) for w in r.choice(VOCABULARY[:12], 6))) for _ in range(120)]
    beside = words(14, r)
    for k in range(4):  # runs of 40 words and 14 words beside them of which one is changed: no other seed need be shared
        docs.append(words(30, r) + [VOCABULARY[0]] * 40 + [*beside[: 4 + k], f"x{k}", *beside[5 + k :]] + words(30, r))
    docs.append(words(30, r) + ([VOCABULARY[1]] * 9 + ["y"]) * 12 + words(30, r))
    table = frame(spark, [(i, " ".join(w)) for i, w in enumerate(docs)])
    by, full = ({x.doc_id: x for x in passage_chain.passages(table, all_meet=n, every_copy=False).collect()} for n in (8, 10**9))
    links = {(i, q.other) for i, x in full.items() for q in x.passages}
    assert len(links) > 1500 and [pair for pair in links if not linked(by, *pair)] == []
    assert {(121, 120), (122, 121), (123, 122)} <= links and by[124].n_repeated > 100
    assert sum(len({q.other for q in x.passages}) for x in by.values()) < 0.75 * len(links)
    covered = lambda x: {k for q in x.passages for k in range(q.start, q.end)}
    assert all(len(covered(full[i]) - covered(by[i])) <= 32 for i in by)


def test_parts_of_a_chain(spark):
    """Two runs with more unequal words between them than a passage may have are two passages, not none."""
    a, b, c, d, e, f = VOCABULARY[20:26]
    docs = [(1, [a] * 52 + [b] * 52 + [c] * 52), (2, [a] * 72 + [d] * 72 + [c] * 72), (3, [e] * 60 + [f] * 60)]
    by = {x.doc_id: x for x in passage_chain.passages(frame(spark, [(i, " ".join(w)) for i, w in docs])).collect()}
    assert [(q.start, q.end, q.other, q.other_start) for q in by[2].passages if q.start in (0, 144)] == [(0, 52, 1, 0), (144, 196, 1, 104)]
    assert by[1].n_passages == by[3].n_passages == 0


def test_ends_grow_over_edits(spark):
    """55 words whose 3rd and 52nd are changed are a passage; words beyond it that differ aren't."""
    r = np.random.default_rng(10)
    p = words(55, r)
    q = [*p]
    q[3], q[52] = "zzzzz", "yyyyy"
    by = {x.doc_id: x for x in passage_chain.passages(frame(spark, [(1, " ".join(words(40, r) + p + words(40, r))), (2, " ".join(words(30, r) + q + words(30, r)))])).collect()}
    assert [(x.start, x.end, x.other, x.other_start, x.other_end) for x in by[2].passages] == [(30, 85, 1, 40, 95)]
    assert by[2].passages[0].identity == pytest.approx(53 / 55, abs=1e-6)
    assert passage_chain.grow([1, 2, 3, 9, 5], [1, 2, 3, 7, 8], 0.8) == (3, 3, 3) and passage_chain.grow([9, 1, 2, 3, 4, 5, 6], [8, 1, 2, 3, 4, 5, 6], 0.8) == (7, 7, 6)


# -- neighbours --------------------------------------------------------------------------------


def test_neighbours(spark):
    r = np.random.default_rng(4)
    x = r.standard_normal((3000, 16)).astype(np.float32)
    x[1000:1800] = x[1000]
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    rows += [(3100, None, 1), (3200, [0.0] * 16, 1), (3300, [float("nan")] * 16, 1), (3400, [1.0, None] * 8, 1), (3500, [1.0], 1), (3600, [float("inf")] * 16, 1), (1200, x[1200].tolist(), 2), (None, x[0].tolist(), 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, list int")
    got = {}
    for q in ann.search(df, F.col("vec_id") % 100 == 0, sample_rows=500).collect():
        got.setdefault(q.query_id, []).append((q.rank, q.vec_id, q.score))
    assert sorted(got) == list(range(0, 3000, 100))
    hit = 0
    y = x.astype(np.float64)
    for q, found in got.items():
        d = np.sqrt(((y - y[q]) ** 2).sum(1))
        true = [i for i in np.lexsort((np.arange(3000), d)) if i != q][:10]
        found.sort()
        assert [f[0] for f in found] == list(range(1, 11)) and all(s == pytest.approx(d[i], abs=1e-12) for _, i, s in found)
        assert [(s, i) for _, i, s in found] == sorted((s, i) for _, i, s in found)
        hit += len(set(true) & {f[1] for f in found})
    assert hit / 300 >= 0.9
    assert ann.search(df.limit(0), F.lit(True)).count() == 0
    assert ann.search(df.where("vec_id < 3"), F.lit(True)).count() == 6


@pytest.mark.parametrize("sample_rows", [60, 200])
def test_recall_with_a_small_sample(spark, sample_rows):
    """The index is fitted on a few of the table's 2,000 vectors, and recall measured against all of them."""
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    ids, vectors = zip(*[(r.vec_id, r.embedding) for r in table.collect()], strict=True)
    x, ids = np.array(vectors, np.float64), np.array(ids)
    hit = n = 0
    got = {}
    for r in ann.search(table, F.col("vec_id") % 100 == 0, sample_rows=sample_rows).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    for q in np.flatnonzero(ids % 100 == 0):
        d = ((x - x[q]) ** 2).sum(1)
        d[q] = np.inf
        hit, n = hit + len(set(ids[np.lexsort((ids, d))[:10]].tolist()) & got[int(ids[q])]), n + 10
        assert len(got[int(ids[q])]) == 10
    print(f"sample of {sample_rows}: recall {hit / n:.4f}")
    assert hit / n >= 0.9


@pytest.mark.parametrize("times", [2, 10])
def test_neighbours_with_repeated_rows(spark, times):
    r = np.random.default_rng(9)
    x = r.standard_normal((600, 16)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x) for _ in range(times)], "vec_id long, embedding array<float>")
    got = {}
    for q in ann.search(df, F.col("vec_id") % 20 == 0, sample_rows=200 * times, least_probes=100).collect():
        got.setdefault(q.query_id, []).append((q.rank, q.vec_id))
    y = x.astype(np.float64)
    hit = 0
    for q in range(0, 600, 20):
        d = ((y - y[q]) ** 2).sum(1)
        true = [i for i in np.argsort(d, kind="stable") if i != q][:10]
        assert sorted(k for k, _ in got[q]) == list(range(1, 11))
        hit += len(set(true) & {i for _, i in got[q]})
    assert hit / 300 >= 0.99
    # within one list: more rows than 4 k, no bound
    ids = np.repeat(np.arange(600), times)
    (found, _), = ann.adaptive_scan(y[:1], np.array([np.inf]), np.array([0]), np.repeat(y, times, 0), ids, ann.rotation(16), 10)
    assert found.tolist() == [i for i in np.argsort(((y - y[0]) ** 2).sum(1), kind="stable") if i][:10]


# -- transcripts -------------------------------------------------------------------------------

TALK = "conv_id long, turn long, role string, text string, block string"


def test_transcripts(spark):
    rows = [(c, t, ("user", "assistant")[t % 2], ("what is it? " if t % 2 == 0 else "it is so. ") * (1 + 9 * (t % 2)), "x") for c in range(20) for t in range(6)]
    talks = spark.createDataFrame(rows, TALK)
    hmm = transcripts.fit(talks)
    masked = talks.withColumn("role", F.when((F.col("turn") + F.col("conv_id")) % 3 != 0, F.col("role")))
    got = transcripts.parse(masked, hmm).join(talks.select("conv_id", "turn", F.col("role").alias("said")), ["conv_id", "turn"])
    assert got.count() == 120 and got.where("role <> said").count() == 0
    raw = [(1, 0, None, "System: be brief\nUser: hello?\nmore of it\nAssistant: hi", "x"), (1, 1, "human", None, "x"), (None, None, "gpt", "", "x"), (None, None, "gpt", "", "x"), (2, 5, "bot", f"a{transcripts.CLOSE}b {transcripts.OPEN}", "x")]
    got = transcripts.parse(spark.createDataFrame(raw, TALK), hmm).collect()
    first = sorted((r.turn, r.part, r.role, r.text) for r in got if r.conv_id == 1)
    assert first == [(0, 0, "system", "be brief"), (0, 1, "user", "hello?\nmore of it"), (0, 2, "assistant", "hi"), (1, 0, "user", "")]
    assert sum(r.conv_id is None for r in got) == 2 and next(r.rendered for r in got if r.conv_id == 2) == "<|im_start|>assistant\nab <| im_start|><|im_end|>\n"
    assert transcripts.parse(talks.limit(0), transcripts.fit(talks.limit(0))).count() == 0


def test_blocks_decode_like_the_whole(spark, monkeypatch):
    """A conversation cut into blocks gets the path of one Viterbi run over all of it."""
    r = np.random.default_rng(6)
    rows = [(1, t, (None, "user", "assistant")[int(r.integers(0, 3))], "a?" if r.random() < 0.4 else "b " * int(r.integers(1, 200)), "x") for t in range(150)]
    talks = spark.createDataFrame(rows, TALK)
    hmm = transcripts.fit(talks)
    whole = [x.role for x in transcripts.parse(talks, hmm).orderBy("turn").collect()]
    monkeypatch.setattr(transcripts, "BLOCK", 7)
    assert [x.role for x in transcripts.parse(talks, hmm).orderBy("turn").collect()] == whole
    moves, says, lines = transcripts.steps_of(hmm, [(x[2], x[3]) for x in rows])
    end = int(transcripts.fold(moves, says, hmm.start)[0].argmax())
    assert [transcripts.ROLES[s] for s in transcripts.decode(moves, says, hmm.start, None, end)] == whole


def test_decoding_is_the_best_of_all_paths():
    """Viterbi against every path of short conversations, by their whole probability."""
    from itertools import product

    r = np.random.default_rng(15)
    n = len(transcripts.ROLES)
    for _ in range(25):
        p = [np.log(x / x.sum(-1, keepdims=True)) for x in (r.random(n), r.random((n, n)), r.random((n, 10)), r.random((n, 8)))]
        hmm = transcripts.Hmm(*p)
        rows = [(None, str(r.choice(["a?", "b " * 50, "x\nUser: y?", "Assistant: ok\nmore of it", ""]))) for _ in range(3)]
        moves, says, _ = transcripts.steps_of(hmm, rows)
        total = lambda path: hmm.start[path[0]] + says[0][path[0]] + sum(moves[k][path[k - 1], path[k]] + says[k][path[k]] for k in range(1, len(path)))
        best = max(total(path) for path in product(range(n), repeat=len(says)))
        end = int(transcripts.fold(moves, says, hmm.start)[0].argmax())
        assert total(transcripts.decode(moves, says, hmm.start, None, end)) == pytest.approx(best)


def test_roles_are_recovered_without_the_column(spark):
    talks = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    got = transcripts.parse(talks, transcripts.fit(talks), role_marks=False).join(talks.select("conv_id", "turn", F.col("role").alias("said")), ["conv_id", "turn"])
    n, right = got.selectExpr("count(*)", "count_if(role = said)").first()
    assert n == talks.count() and right / n > 0.95


def test_equal_and_null_turns_are_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(transcripts, "BLOCK", 8)
    rows = [(1, None, None, f"line {i % 3}", "x") for i in range(60)] + [(None, 7, "user", "same", "x")] * 40 + [(2, 0, None, "word " * 60000, "x")]
    talks = spark.createDataFrame(rows, TALK)
    got = transcripts.parse(talks, transcripts.fit(talks)).collect()
    assert len(got) == 101 and sum(r.conv_id is None for r in got) == 40 and max(len(r.text) for r in got) == 299999
