"""Line dedup by pairwise alignment.

Prose has few newlines, so that a line here ends at a newline or after a full stop, question or exclamation mark that a
space follows. Lines are compared without surrounding white space and without case. An anchor is a run of neighbouring
lines that just reaches BLOCK_WORDS words: from each line forwards and from each line backwards the shortest one, within
the document. So each line of a common block of that many words, whatever its lines are and however many documents have
it, lies in an anchor within the block. The first document (smallest id) that has an anchor owns it, and each later
document that has it, too, is aligned with the owner: one pair for each later document, not all pairs.

A pair is aligned by patience diff: lines that are unique in both documents, in the longest order-preserving
selection, split the pair into stretches that are aligned in turn, down to equal lines at their ends. Runs of aligned
neighbouring lines are common blocks. A block with at least BLOCK_WORDS words is deleted from the later document; the
earlier document keeps it.

Blank lines have no words and are no part of an anchor; they go with a block that has aligned ones inside.

Defined cases: a null text stays null, an empty one empty; rows without id are kept as they are. Rows that repeat an id
with another text are aligned each with owners of a smaller id and lose only what they repeat themselves; they are not
compared with each other, and as owners all of them count. Rows that repeat id and text are treated alike. A document
whose every line is deleted has an empty text. What is kept stays as it is, separators included.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, free, lowered, mix64, ship, slices, span_hashes, stash, trimmed, utf8, word_spans

BLOCK_WORDS = 20
#: Bytes of text whose lines are hashed at once: small, as a worker shares its executor's memory; results do not depend on it.
HASHED_BYTES = 1 << 19


def lines(text: Column) -> Column:
    """The lines with what separates them: joined, they are the text."""
    return F.split(text, r"(?<=\n)|(?<=[.!?]\x20)", -1)


_END = np.zeros(256, bool)
_END[[0x21, 0x2E, 0x3F]] = True


def _spans(raw: np.ndarray, off: np.ndarray, sentences: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the lines of each row, as ``lines`` splits them (or at newlines only), and each row's first line."""
    n = len(raw)
    after = raw == 10
    if sentences:
        after[1:] |= (raw[1:] == 0x20) & _END[raw[:-1]]
        first = off[:-1][off[:-1] < n]
        after[first] = raw[first] == 10
    inner = np.flatnonzero(after) + 1
    row = np.searchsorted(off, inner - 1, "right") - 1
    starts = np.concatenate((off[:-1], inner))
    rows = np.concatenate((np.arange(len(off) - 1), row))
    order = np.lexsort((starts, rows))
    starts, rows = starts[order], rows[order]
    last = np.r_[rows[1:] != rows[:-1], True] if len(rows) else np.zeros(0, bool)
    ends = np.where(last, off[rows + 1], np.r_[starts[1:], n])
    return starts, ends, np.searchsorted(rows, np.arange(len(off)))


def _measured(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash (without case and surrounding space) and word count of each line, and each row's first line."""
    starts, ends, first = _spans(raw, off)
    w0, w1, _ = word_spans(raw, np.unique(np.concatenate((starts, [len(raw)]))))
    a, b = np.searchsorted(w0, starts), np.searchsorted(w0, ends)
    some = b > a
    s, e = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
    s[some], e[some] = w0[a[some]], w1[b[some] - 1]
    return span_hashes(lowered(raw), s, e).view(np.int64), (b - a).astype(np.int32), first


def _runs(h: np.ndarray, w: np.ndarray, first: np.ndarray, block_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row's shortest runs of lines with ``block_words`` words, from and to each line, each once; and each row's first one."""
    some = np.flatnonzero(w > 0)
    h, w, first = h[some], w[some], np.searchsorted(some, first)
    n, rows = len(h), np.repeat(np.arange(len(first) - 1), np.diff(first))
    words, at = np.r_[0, np.cumsum(w, dtype=np.int64)], np.arange(n)
    to = np.searchsorted(words, words[:-1] + block_words)
    since = np.searchsorted(words, words[1:] - block_words, "right") - 1
    ahead, behind = to <= first[rows + 1], since >= first[rows]
    starts, ends = np.concatenate((at[ahead], since[behind])), np.concatenate((to[ahead], at[behind] + 1))
    length, row = ends - starts, rows[starts]
    found = length.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for i in range(int(length.max(initial=0))):  # no run has more lines than words
        more = np.flatnonzero(length > i)
        found[more] = mix64(found[more] ^ h[starts[more] + i].view(np.uint64))
    found = found.view(np.int64)
    order = np.lexsort((found, row))
    found, row = found[order], row[order]
    new = np.ones(len(found), bool)
    new[1:] = (found[1:] != found[:-1]) | (row[1:] != row[:-1])
    return found[new], np.searchsorted(row[new], np.arange(len(first)))


_HASHED = "doc_id long, key long, h array<long>, w array<int>, anchors array<long>"


def _hash_lines(block_words: int):
    def lists(values: np.ndarray, first: np.ndarray, kind: pa.DataType) -> pa.ListArray:
        return pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(values, kind))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in _HASHED.split(", ")]
        for batch in slices(batches):
            raw, off = utf8(batch.column(2))
            for i, j in chunks(off, HASHED_BYTES):
                h, w, first = _measured(raw[off[i] : off[j]], off[i : j + 1] - off[i])
                anchors, afirst = _runs(h, w, first, block_words)
                ids = [batch.column(c).slice(i, j - i) for c in range(2)]
                out = pa.RecordBatch.from_arrays([*ids, lists(h, first, pa.int64()), lists(w, first, pa.int32()), lists(anchors, afirst, pa.int64())], names=names)
                yield out.filter(pa.array(np.diff(afirst) > 0))

    return run


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest selection of pairs, sorted by first place, whose second places increase (patience sorting)."""
    tops: list[int] = []
    piles: list[int] = []
    back: list[int] = []
    for i, (_, y) in enumerate(pairs):
        p = bisect_left(tops, y)
        back.append(piles[p - 1] if p else -1)
        if p == len(tops):
            tops.append(y)
            piles.append(i)
        else:
            tops[p] = y
            piles[p] = i
    out, i = [], piles[-1] if piles else -1
    while i >= 0:
        out.append(pairs[i])
        i = back[i]
    return out[::-1]


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned places (in a, in b) of equal items, in order."""
    found: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            found.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            found.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        at: dict[int, list] = {}
        for i in range(a0, a1):
            at.setdefault(a[i], [0, 0, i, -1])[0] += 1
        for j in range(b0, b1):
            if b[j] in at:
                at[b[j]][1] += 1
                at[b[j]][3] = j
        unique = sorted((x[2], x[3]) for x in at.values() if x[0] == x[1] == 1)
        chain = _increasing(unique)
        last_a, last_b = a0, b0
        for i, j in chain:
            found.append((i, j))
            todo.append((last_a, i, last_b, j))
            last_a, last_b = i + 1, j + 1
        if chain:
            todo.append((last_a, a1, last_b, b1))
    return sorted(found)


def blocks(a: list[int], b: list[int]) -> Iterator[tuple[int, int, int]]:
    """Runs of aligned neighbours: first place in a, in b, length."""
    run = None
    for i, j in patience(a, b):
        if run and i == run[0] + run[2] and j == run[1] + run[2]:
            run = (run[0], run[1], run[2] + 1)
            continue
        if run:
            yield run
        run = (i, j, 1)
    if run:
        yield run


def _align(block_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 64):
            at, places = [], []
            for i, (a, b, words) in enumerate(zip(*(batch.column(c).to_pylist() for c in (2, 3, 4)))):
                cut = [k for _, j, n in blocks(a, b) if sum(words[j : j + n]) >= block_words for k in range(j, j + n)]
                if cut:
                    at.append(i)
                    places.append(cut)
            ids = [batch.column(c).take(pa.array(at, pa.int64())) for c in range(2)]
            yield pa.RecordBatch.from_arrays([*ids, pa.array(places, pa.list_(pa.int32()))], names=["doc_id", "key", "places"])

    return run


def _texts(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("key"), F.col("text").cast("string").alias("text"))


def deletions(documents: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, text) to doc_id, key (hash of the text), places: the line numbers from 0 that go; only rows that lose any."""
    ship(documents.sparkSession)
    texts = _texts(documents.where("doc_id is not null and text is not null"))
    hashed = stash(texts.mapInArrow(trimmed(_hash_lines(block_words)), _HASHED))
    anchors = hashed.select("doc_id", "key", F.explode("anchors").alias("anchor"))
    owned = stash(anchors.groupBy("anchor").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("last")).where("owner < last").select("anchor", "owner"))
    pairs = anchors.join(owned, "anchor").where("doc_id <> owner").select("doc_id", "key", "owner").distinct()
    side = hashed.dropDuplicates(["doc_id", "key"])
    met = stash(pairs).join(side.select(F.col("doc_id").alias("owner"), F.col("h").alias("a")), "owner").join(side.select("doc_id", "key", F.col("h").alias("b"), "w"), ["doc_id", "key"])
    cut = met.select("doc_id", "key", "a", "b", "w").mapInArrow(trimmed(_align(block_words)), "doc_id long, key long, places array<int>")
    return cut.select("doc_id", "key", F.explode("places").alias("place")).distinct().groupBy("doc_id", "key").agg(F.sort_array(F.collect_list("place")).alias("places"))


def _flags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted line numbers as flags by line, so that one look tells whether a line goes."""
    for batch in slices(batches, 256):
        flags = []
        for places in batch.column(2).to_pylist():
            own = np.zeros(places[-1] + 1, bool)
            own[places] = True
            flags.append(own)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(flags, pa.list_(pa.bool_()))], names=["doc_id", "key", "gone"])


def without_repeats(documents: DataFrame, **how) -> DataFrame:
    """``documents`` with the common blocks deleted from the texts of later documents, and the column ``removed_lines`` (in place of any of that name)."""
    cut = stash(deletions(documents, **how).mapInArrow(_flags, "doc_id long, key long, gone array<boolean>"), rows=128)
    cut_id, cut_key, gone = (free(x, documents.columns) for x in ("_cut_id", "_cut_key", "_gone"))
    cut = cut.toDF(cut_id, cut_key, gone).hint("merge")
    same = (F.col("doc_id").cast("long") == F.col(cut_id)) & (F.xxhash64(F.col("text").cast("string")) == F.col(cut_key))
    joined = documents.join(cut, same, "left")
    left = F.filter(lines(F.col("text")), lambda _, i: ~F.coalesce(F.get(gone, i), F.lit(False)))
    text = F.when(F.col(gone).isNull(), F.col("text")).otherwise(F.array_join(left, ""))
    if "n_chars" in documents.columns:
        joined = joined.withColumn("n_chars", F.when(F.col(gone).isNull(), F.col("n_chars")).otherwise(F.length(text).cast("long")))
    removed = F.coalesce(F.size(F.filter(gone, lambda x: x)), F.lit(0)).cast("int")
    return joined.withColumn("text", text).withColumn("removed_lines", F.when(F.col(gone).isNull(), 0).otherwise(removed)).select(*(c for c in documents.columns if c != "removed_lines"), "removed_lines")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return without_repeats(documents.select("doc_id", "text"))
