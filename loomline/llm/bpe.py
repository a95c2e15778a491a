"""BPE encoding and decoding through a pair occurrence index.

A partition's texts are taken in pieces of a few MB and cut into chunks at white space.
The distinct word pieces that the task has not met yet become one long symbol sequence; an
index maps each merge rank to all positions of its pair, a heap holds the active ranks, and
the ranks are applied in ascending order, each at all its positions at once, which adds the
neighbouring pairs that arise to the index. Merges never cross word pieces, so a word piece
that stands in many texts is in the index once.

Defined results: null and empty texts have no ids and decode to ''. Texts of any
length are encoded whole. Rows are independent, so repeated rows, ties and empty
tables need no rule; only the two named columns are read, others never clash.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from loomline.llm.bytewords import lean
from loomline.llm.spool import small_batches

DEFAULT_TOKENIZER = "word_bpe_49k.json"
#: Word pieces that a worker remembers; beyond this it forgets all and goes on.
REMEMBERED = 200_000
_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
_SPACE = regex.compile(r"[\t-\r \x85\xa0  -     　]+")
_OTHER_SPACE = regex.compile(r"[\x1c-\x1f]")
_NONE = np.iinfo(np.int64).max


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    extra = iter(range(256))
    return [chr(b) if b in shown else chr(256 + next(extra)) for b in range(256)]


class Ragged:
    """Rows of different length: row i is data[off[i]:off[i + 1]]."""

    def __init__(self, data: np.ndarray, off: np.ndarray):
        self.data, self.off = data, off

    def take(self, rows: np.ndarray) -> Ragged:
        size = self.off[rows + 1] - self.off[rows]
        off = np.zeros(len(rows) + 1, np.int64)
        np.cumsum(size, out=off[1:])
        return Ragged(self.data[np.repeat(self.off[rows] - off[:-1], size) + np.arange(off[-1])], off)

    def insert(self, row: int, value: int) -> Ragged:
        """The empty row gets one value."""
        off = self.off.copy()
        off[row + 1 :] += 1
        return Ragged(np.insert(self.data, self.off[row], value), off)


class WordBpe:
    """A BPE with an end-of-word suffix over byte-level symbols, read from a tokenizers file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"]
        self.token = {i: t for t, i in vocab.items()} | {a["id"]: a["content"] for a in spec["added_tokens"]}
        self.added = {a["content"]: a["id"] for a in spec["added_tokens"]}
        self._added_split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")")
        chars = byte_alphabet()
        self.inner = np.array([vocab[c] for c in chars], np.int32)
        self.final = np.array([vocab[c + suffix] for c in chars], np.int32)
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.left = np.array([vocab[a] for a, _ in merges], np.int32)
        self.right = np.array([vocab[b] for _, b in merges], np.int32)
        self.merged = np.array([vocab[a + b] for a, b in merges], np.int32)
        made = {int(m): r for r, m in reversed(list(enumerate(self.merged)))}
        for r, (a, b) in enumerate(zip(self.left.tolist(), self.right.tolist(), strict=True)):
            if made.get(a, -1) >= r or made.get(b, -1) >= r:
                raise ValueError("a merge uses a symbol that a later merge makes; ranks cannot be applied in order")
        key = (self.left.astype(np.int64) << 32) | self.right
        order = np.argsort(key, kind="stable")
        self._keys, self._ranks = key[order], order.astype(np.int64)
        self._forget()

    # -- the pair occurrence index ---------------------------------------------------------

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = (a.astype(np.int64) << 32) | b
        at = np.searchsorted(self._keys, key)
        at[at == len(self._keys)] = 0
        return np.where(self._keys[at] == key, self._ranks[at], _NONE)

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in a row, and len(words) + 1 offsets. No word is empty."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        off = np.zeros(len(words) + 1, np.int64)
        np.cumsum(size, out=off[1:])
        raw = np.frombuffer(b"".join(words), np.uint8)
        n = len(raw)
        sym = self.inner[raw]
        sym[off[1:] - 1] = self.final[raw[off[1:] - 1]]
        nxt = np.arange(1, n + 1)
        nxt[off[1:] - 1] = -1
        prv = np.arange(-1, n - 1)
        prv[off[:-1]] = -1
        alive = np.ones(n, bool)
        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def add(at: np.ndarray) -> None:
            rank = self._rank(sym[at], sym[nxt[at]])
            keep = rank != _NONE
            at, rank = at[keep], rank[keep]
            if not len(at):
                return
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
            first = np.flatnonzero(np.r_[True, rank[1:] != rank[:-1]])
            stop = np.r_[first[1:], len(at)]
            for r, lo, hi in zip(rank[first].tolist(), first.tolist(), stop.tolist(), strict=True):
                if r in index:
                    index[r].append(at[lo:hi])
                else:
                    index[r] = [at[lo:hi]]
                    heapq.heappush(active, r)

        add(np.flatnonzero(nxt >= 0))
        while active:
            r = heapq.heappop(active)
            lists = index.pop(r)
            a, b = self.left[r], self.right[r]
            at = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
            at = at[alive[at] & (sym[at] == a) & (nxt[at] >= 0)]
            at = at[sym[nxt[at]] == b]
            if a == b and len(at) > 1:  # in a run of equal symbols the leftmost pair goes first
                taken, kept = -1, []
                for i in np.sort(at).tolist():
                    if i != taken:
                        kept.append(i)
                        taken = int(nxt[i])
                at = np.array(kept, np.int64)
            if not len(at):
                continue
            gone = nxt[at]
            after = nxt[gone]
            sym[at] = self.merged[r]
            alive[gone] = False
            nxt[at] = after
            inside = after >= 0
            prv[after[inside]] = at[inside]
            before = prv[at]
            add(np.concatenate([before[before >= 0], at[inside]]))
        counts = np.add.reduceat(alive.astype(np.int64), off[:-1]) if len(words) else np.empty(0, np.int64)
        out = np.zeros(len(words) + 1, np.int64)
        np.cumsum(counts, out=out[1:])
        return sym[alive], out

    # -- texts -----------------------------------------------------------------------------

    def _forget(self) -> None:
        self._known: dict[str, int] = {}
        self._said: list[str] = []
        self._ids = Ragged(np.empty(0, np.int32), np.zeros(1, np.int64))

    def _rows(self, pieces: list[str]) -> np.ndarray:
        """Row of each piece in the remembered table; pieces not met before are encoded first."""
        known = self._known
        new = list({p for p in pieces if p not in known})
        if len(known) + len(new) > REMEMBERED and known:
            self._forget()
            return self._rows(pieces)
        if new:
            ids, off = self.encode_words([p.encode() for p in new])
            said, stops, token = [self.token[i] for i in ids.tolist()], off.tolist(), self._said
            for lo, hi in zip(stops, stops[1:], strict=False):
                token.append(" ".join(said[lo:hi]))
            known.update(zip(new, range(len(known), len(known) + len(new)), strict=True))
            self._ids = Ragged(np.concatenate([self._ids.data, ids]), np.concatenate([self._ids.off, off[1:] + self._ids.off[-1]]))
        return np.fromiter(map(known.__getitem__, pieces), np.int64, len(pieces))

    def _chunks(self, text: str) -> list[str]:
        """The text in lower case, cut at white space and around added tokens."""
        out: list[str] = []
        for piece in self._added_split.split(text) if "<|" in text else [text]:
            if piece in self.added:
                out.append(piece)
                continue
            if not piece.isascii():
                if not unicodedata.is_normalized("NFC", piece):
                    piece = unicodedata.normalize("NFC", piece)
                piece = piece.replace("Σ", "σ")  # lower case goes by single characters here
            piece = piece.lower()
            if _OTHER_SPACE.search(piece):
                out += [x for x in _SPACE.split(piece) if x]
            else:
                out += piece.split()
        return out

    def encode_batch(self, texts: Iterable[str | None]) -> tuple[pa.Array, pa.Array]:
        """Ids as little-endian unsigned 32-bit integers, and decoded text, of each text."""
        flat: list[str] = []
        stops = [0]
        for text in texts:
            if text:
                flat += self._chunks(text)
            stops.append(len(flat))
        coded = pa.array(flat, pa.string()).dictionary_encode()
        chunks = coded.dictionary.to_pylist()
        pieces: list[str] = []
        cuts = [0]
        added: list[tuple[int, int]] = []
        for k, c in enumerate(chunks):
            if c.isalpha():
                pieces.append(c)
            elif c[-1] in ".," and c[:-1].isalpha():
                pieces += (c[:-1], c[-1])
            elif c in self.added:
                added.append((k, self.added[c]))
            else:
                pieces += _PIECES.findall(c)
            cuts.append(len(pieces))
        rows = self._rows(pieces)
        own, cut = self._ids.take(rows), np.array(cuts)
        ids = Ragged(own.data, own.off[cut])
        names = [self._said[r] for r in rows.tolist()]
        said = [names[lo] if hi == lo + 1 else " ".join(names[lo:hi]) for lo, hi in zip(cuts, cuts[1:], strict=False)]
        for k, i in added[::-1]:
            ids = ids.insert(k, i)
            said[k] = chunks[k]
        at = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        stop = np.array(stops)
        got = ids.take(at)
        raw = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(stops) - 1, [None, pa.py_buffer(np.ascontiguousarray(got.off[stop] * 4)), pa.py_buffer(got.data.astype("<u4"))])
        words = pa.array(said, pa.large_string()).take(coded.indices)
        text = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(stop, pa.int64()), words), pa.scalar(" ", pa.large_string()))
        return raw.cast(pa.binary()), text.cast(pa.string())

    def decode(self, ids: bytes) -> str:
        """Text of little-endian ids; special tokens are kept."""
        return " ".join([self.token[i] for i in np.frombuffer(ids, "<u4").tolist()])


_loaded: dict[str, WordBpe] = {}


def tokenizer(path: str) -> WordBpe:
    if path not in _loaded:
        _loaded[path] = WordBpe(path)
    return _loaded[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(DEFAULT_TOKENIZER)


def encode(docs: DataFrame, *, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", piece_bytes: int = 4_000_000) -> DataFrame:
    """(id, ids binary, decoded string) of every row; no shuffle. `path` must exist on the executors."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        bpe._forget()  # what an earlier task of this worker has met
        for batch in batches:
            key, texts = batch.column(0), batch.column(1)
            lo, size = 0, 0
            lengths = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
            for i in range(len(batch) + 1):
                if i == len(batch) or size > piece_bytes:
                    if i > lo:
                        yield pa.RecordBatch.from_arrays([key.slice(lo, i - lo), *bpe.encode_batch(texts.slice(lo, i - lo).to_pylist())], ["id", "ids", "decoded"])
                    lo, size = i, 0
                if i < len(batch):
                    size += lengths[i]

        bpe._forget()

    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text")).mapInArrow(lean(run), f"id {kind}, ids binary, decoded string").withColumnRenamed("id", id_col)
