"""Packing by vector bin packing with the dot-product heuristic.

A sequence has room for a number of tokens, of segments and of loss-bearing tokens at once. From a bounded pool of
waiting pieces, the open sequence takes the one that fits and whose demand vector has the largest dot product with the
room left (both as shares of the limits); ties go to the piece that came first. When none fits and tokens are left, a
piece is cut so that its first part fills the room. Full windows of a long document are sequences of their own at once.
Each task packs the rows that it reads, in one pass, with a pool of POOL pieces: no shuffle, and no state that grows. So a
task leaves one sequence or a few that are not full.

A piece's loss-bearing tokens are those past its document's first ``prompt_tokens`` ones (a column that may be absent:
0), without the piece's first token, which nothing precedes.

Defined cases: a null text is empty and has only the end token. A null id is kept. Rows that repeat are packed each.
"""

from __future__ import annotations

import json
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, ship, slices, span_hashes, trimmed, utf8, word_spans

MAX_TOKENS, MAX_SEGMENTS, MAX_LOSS = 2048, 128, 2047
POOL = 512
#: Bits of a place in the table of known words, most token ids that it refers to, and most pieces of words kept.
_CACHE_BITS, _FLAT, _PIECES = 20, 1 << 22, 300_000
_PLACE = np.uint64((1 << _CACHE_BITS) - 1)
#: What this tokenizer takes as one word before it merges bytes, after lower-casing.
_WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: Texts with these, or with special tokens, go the long way.
_ODD = "\x1c\x1d\x1e\x1f\u180e\u200b\ufeff"


class WordTokenizer:
    """The ids of a lower-casing tokenizer that drops white space, with a cache, by 64-bit hash, of what stands between spaces.

    Gives the ids that the tokenizer's own ``encode`` gives; that is tested on whole texts. The cache is a table of
    fixed size: a word stands in one of two places that its hash names, and what finds both taken replaces the second.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        spec["normalizer"] = None
        spec["pre_tokenizer"] = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
        spec["added_tokens"] = []
        self.words = Tokenizer.from_str(json.dumps(spec))
        self._reset()

    def _reset(self) -> None:
        self.piece: dict[str, bytes] = {}
        size = 1 << _CACHE_BITS
        self.key = np.zeros(size, np.uint64)
        self.start = np.zeros(size, np.int32)
        self.length = np.zeros(size, np.int32)  # 0: the place is free
        self.flat = np.zeros(1 << 16, np.uint32)
        self.used = 0

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """Each hash's place in the table, or -1."""
        one, two = (hashes & _PLACE).astype(np.int64), (hashes >> np.uint64(32) & _PLACE).astype(np.int64)
        at = np.where((self.key[one] == hashes) & (self.length[one] > 0), one, two)
        at[(self.key[at] != hashes) | (self.length[at] == 0)] = -1
        return at

    def _encoded(self, new: list[str]) -> list[bytes]:
        """The ids of what stands between spaces, as bytes."""
        split = [_WORD.findall(w) for w in new]
        known = self.piece
        pieces = [p for p in {p for ws in split for p in ws} if p not in known]
        if pieces:
            e = self.words.encode(pieces, is_pretokenized=True, add_special_tokens=False)
            data = np.array(e.ids, np.uint32).tobytes()
            cuts = (4 * np.searchsorted(np.array(e.word_ids), np.arange(len(pieces) + 1))).tolist()
            known.update((p, data[a:b]) for p, a, b in zip(pieces, cuts, cuts[1:]))
        rows = [known[ws[0]] if len(ws) == 1 else b"".join([known[p] for p in ws]) for ws in split]
        if len(known) > _PIECES:
            known.clear()
        return rows

    def _learn(self, hashes: np.ndarray, rows: list[bytes]) -> tuple[np.ndarray, np.ndarray, bool]:
        """Put words into the table; returns where their ids start, how many they are, and whether the table was emptied first."""
        sizes = np.fromiter(map(len, rows), np.int64, len(rows)) // 4
        total = int(sizes.sum())
        if emptied := self.used + total > _FLAT:
            self._reset()
        while self.used + total > len(self.flat):
            self.flat = np.concatenate((self.flat, np.zeros_like(self.flat)))
        starts = self.used + np.cumsum(sizes) - sizes
        self.flat[self.used : self.used + total] = np.frombuffer(b"".join(rows), np.uint32)
        self.used += total
        one, two = (hashes & _PLACE).astype(np.int64), (hashes >> np.uint64(32) & _PLACE).astype(np.int64)
        at = np.where(self.length[one] == 0, one, two)
        fits = sizes > 0
        # Of words that get the same place the last one stays, in all three columns.
        last = np.unique(at[fits][::-1], return_index=True)[1]
        keep = np.flatnonzero(fits)[::-1][last]
        self.key[at[keep]], self.start[at[keep]], self.length[at[keep]] = hashes[keep], starts[keep], sizes[keep]
        return starts, sizes, emptied

    def ids(self, text: str) -> np.ndarray:
        return self.batch([text])[0]

    def batch(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        whole: dict[int, np.ndarray] = {}
        plain = []
        for i, text in enumerate(texts):
            if _odd(text):
                whole[i] = np.array(self.whole.encode(text, add_special_tokens=False).ids, np.uint32)
                text = ""
            elif not text.isascii():
                if not unicodedata.is_normalized("NFC", text):
                    text = unicodedata.normalize("NFC", text)
                if "Σ" in text:
                    text = text.replace("Σ", "σ")
            plain.append(text.lower())
        raw, off = utf8(pa.array(plain, pa.large_string()))
        out: list[np.ndarray] = []
        for a, b in chunks(off):
            out += self._ids(raw[off[a] : off[b]], off[a : b + 1] - off[a])
        return [whole.get(i, x) for i, x in enumerate(out)]

    def _ids(self, raw: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
        starts, ends, first = word_spans(raw, off)
        if not len(starts):
            return [np.zeros(0, np.uint32)] * (len(off) - 1)
        hashes = span_hashes(raw, starts, ends)
        at = self._find(hashes)
        begin, length = self.start[at].astype(np.int64), self.length[at].astype(np.int64)
        new = np.flatnonzero(at < 0)
        flat = self.flat
        if len(new):
            unknown, one, which = np.unique(hashes[new], return_index=True, return_inverse=True)
            data, s, e = raw.tobytes(), starts[new[one]].tolist(), ends[new[one]].tolist()
            rows = self._encoded([data[i:j].decode() for i, j in zip(s, e)])
            b, n, emptied = self._learn(unknown, rows)
            if emptied:  # words that were known still point into the old ids
                b, flat = b + len(flat), np.concatenate((flat, self.flat))
            else:
                flat = self.flat
            begin[new], length[new] = b[which], n[which]
        end = np.cumsum(length)
        ids = flat[np.repeat(begin - (end - length), length) + np.arange(end[-1])]
        return np.split(ids, np.r_[0, end][first[1:-1]])


def _odd(text: str) -> bool:
    """Special tokens, and characters on which the libraries' notions of space differ."""
    return "<|" in text or any(c in text for c in _ODD)


_tokenizers: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    """One for each worker process."""
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


class Packer:
    """Packs pieces as they come; ``done`` collects rows (document, start, length, crc, document's tokens, sequence, offset)."""

    def __init__(self, max_tokens: int, max_segments: int, max_loss: int, pool: int = POOL):
        self.limits = np.array([max_tokens, max_segments, max_loss], float)
        self.room = (max_tokens, max_segments, max_loss)
        self.pool = pool
        self.items: list[tuple] = []
        self.demand = np.zeros((0, 3))
        self.sequence = 0
        self.done: list[tuple] = []

    def _loss(self, start: int, length: int, prompt: int) -> int:
        return max(0, start + length - max(start + 1, prompt))

    def _put(self, item: tuple, length: int, offset: int) -> None:
        doc, ids, start, prompt = item
        part = np.ascontiguousarray(ids[start : start + length], "<u4")
        self.done.append((doc, start, length, zlib.crc32(part.tobytes()), len(ids), self.sequence, offset))

    def _cut(self, item: tuple, tokens: int, loss: int) -> int:
        """The longest first part within the room."""
        _, ids, start, prompt = item
        return min(len(ids) - start, tokens, max(start + 1, prompt) + loss - start)

    def add(self, doc, ids: np.ndarray, prompt: int = 0) -> None:
        tokens, _, loss = self.room
        start = 0
        while len(ids) - start >= tokens and self._cut((doc, ids, start, prompt), tokens, loss) == tokens:
            self._put((doc, ids, start, prompt), tokens, 0)
            self.sequence += 1
            start += tokens
        if start < len(ids):
            self.items.append((doc, ids, start, prompt))
        if len(self.items) >= 2 * self.pool:
            self.fill(self.pool)

    def fill(self, until: int = 0) -> None:
        """Close sequences until at most so many pieces wait."""
        items = self.items
        demand = np.array([(len(i[1]) - i[2], 1, self._loss(i[2], len(i[1]) - i[2], i[3])) for i in items], float).reshape(-1, 3)
        alive = np.ones(len(items), bool)
        waiting = len(items)
        while waiting > until:
            left, offset = self.limits.copy(), 0
            while waiting and left[0] > 0 and left[1] > 0:
                fit = alive & (demand <= left).all(axis=1)
                if not fit.any():
                    break
                i = int(np.argmax(np.where(fit, demand @ (left / self.limits**2), -1)))
                self._put(items[i], int(demand[i, 0]), offset)
                offset += int(demand[i, 0])
                left -= demand[i]
                alive[i] = False
                waiting -= 1
            if waiting and left[0] > 0 and left[1] > 0:
                i = int(np.argmax(np.where(alive, demand[:, 0], -1)))
                doc, ids, start, prompt = items[i]
                part = self._cut(items[i], int(left[0]), int(left[2]))
                if part > 0:
                    self._put(items[i], part, offset)
                    offset += part
                    items[i] = (doc, ids, start + part, prompt)
                    rest = len(ids) - start - part
                    demand[i] = rest, 1, self._loss(start + part, rest, prompt)
                    if not rest:
                        alive[i] = False
                        waiting -= 1
            if not offset:
                raise ValueError("a limit leaves no room for any token")
            self.sequence += 1
        self.items = [i for i, a in zip(items, alive) if a]


_OUT = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack_documents(documents: DataFrame, tokenizer_path: str, end_id: int = 1, max_tokens: int = MAX_TOKENS, max_segments: int = MAX_SEGMENTS, max_loss: int = MAX_LOSS, pool: int = POOL) -> DataFrame:
    """(doc_id, text[, prompt_tokens]) to one row per piece; see the module."""
    if min(max_tokens, max_segments, max_loss) < 1:
        raise ValueError("limits are at least 1")
    ship(documents.sparkSession)
    prompt = F.coalesce(F.col("prompt_tokens"), F.lit(0)).cast("int") if "prompt_tokens" in documents.columns else F.lit(0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(tokenizer_path)
        packer = Packer(max_tokens, max_segments, max_loss, pool)
        base = TaskContext.get().partitionId() << 32

        def rows() -> pa.RecordBatch:
            cols = list(zip(*packer.done)) or [()] * 7
            packer.done.clear()
            out = [pa.array(c, pa.int64()) for c in cols]
            out[5] = pa.array([base + s for s in cols[5]], pa.int64())
            return pa.RecordBatch.from_arrays(out, names=[x.split()[0] for x in _OUT.split(", ")])

        for batch in slices(batches, 256):
            docs, texts, firsts = (batch.column(i).to_pylist() for i in range(3))
            for doc, ids, first in zip(docs, tok.batch([t or "" for t in texts]), firsts):
                packer.add(doc, np.append(ids, np.uint32(end_id)), first)
            yield rows()
        packer.fill()
        yield rows()

    return documents.select(F.col("doc_id").cast("long"), "text", prompt.alias("prompt")).mapInArrow(trimmed(run), _OUT)


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_path())
