"""N-gram Jaccard join by multiple-global-order filtering.

A document is the set of its distinct 5-word shingles. Two documents link when their Jaccard similarity reaches the
threshold t. Under any total order of tokens, two linked sets share a token among the first |x| - ceil(t |x|) + 1 of
each (their prefixes). Here there are several orders. All put rare tokens first, by the magnitude of a count that a
sketch over the whole corpus gives (never below the true document frequency); each order breaks ties by a hash of its
own. Candidates come from the postings of the prefixes under the first order. Those that do not share a prefix token
under each further order as well, or whose parity bitmaps differ in more places than a link allows, go before any text
moves; the others are verified by exact overlap.

A pair is a candidate of a token only if this can be their first common one: with i and j tokens before it in the
first order, the sizes less i and j must both reach the overlap that the threshold asks of these sizes.

No long posting list is expanded into all of its pairs. A list with few candidate pairs for its length gives these.
Another gives stars around its most typical documents (highest mean token count; three ways to break ties). After the
stars are verified and their components known, only lists whose members still lie in different components go on. As long
as these have more crossing pairs than CROSSING_EACH for each member of a longer list, all in all, further stars follow, around other members
(and all crossing pairs of a list that has few for its own length), if the last ones found links, ROUNDS times at most.
Then all crossing pairs that are left are met in cells of PAIR_BLOCK members each way and verified where size, place and
bitmap allow a link. So no component is missed; the last step alone
can take more than linear work, where long lists join documents that do not link but nearly do.

The sketch only orders tokens and never changes a result. It has 2 ** 16 to 2 ** 24 counts, by the bytes of text; lists
of tokens that stand out of it are dealt by document instead of gathered, and so is a bucket of lists that is too long.

Defined cases: an empty or null text, or one without words, has an empty set and links with nothing; one with fewer
than k words is one shingle. Rows with equal sets form a class, represented by its smallest id. Rows that repeat an id,
with equal or other texts, are one document, which links with whatever one of its texts links with. A row without id
keeps its size and has no component. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column_shingles, free, mix64, ship, shuffle_width, slices, stash, trimmed
from .graph import connected_components

#: Bits of the sketch's width, least and most; with 24, 16 MB of magnitudes are broadcast.
SKETCH_BITS = (16, 24)
_PIECES = 64
#: Lists with up to so many candidate pairs for each of their documents give them at once.
PAIRS_EACH = 4
#: With up to so many crossing pairs for each member of a longer list, all in all, these are met in cells at once.
CROSSING_EACH = 64
#: Pairs of longer lists are not enumerated to count them.
COUNTED = 64
#: Members on each side of a cell of a longer list.
PAIR_BLOCK = 256
#: Further rounds of stars at most.
ROUNDS = 4
#: Partners that meet one copy of a text in verification.
PARTNERS = 512
#: Tokens with sketch counts from 2 ** HEAVY_CLASS on that are 8 times the mean count are dealt by document.
HEAVY_CLASS = 10
#: Hashes of the orders; the first one makes the postings.
ORDER_SEEDS = (0x1F83D9ABFB41BD6B, 0x5BE0CD19137E2179, 0x3C6EF372FE94F82B)
#: Postings that a map task holds before it hands them on, and that are gathered at once.
_FLUSH, _HELD = 200_000, 500_000
#: Buckets of postings in a partition.
_FINER = 16
_FILTER_BITS = 1 << 23
#: 64-bit words of a parity bitmap.
_WORDS = 8

_SIGNATURES = "doc_id long, n_shingles long, k1 long, k2 long, piece int, counts binary"
_POSTINGS = "bucket int, heavy boolean, data binary"
_LISTS = "run_id long, a long, b long, score int, skip int"
_BITS = [f"b{i}" for i in range(_WORDS)]
_KNOWN = "id long, n long, p2 array<int>, p3 array<int>, " + ", ".join(f"{b} long" for b in _BITS)
#: A posting: hashed token, document, its size, its typicality, and the share of its tokens before this one (in 255ths, rounded down).
_POSTING = np.dtype([("token", "<u4"), ("doc", "<i8"), ("n", "<u4"), ("score", "u1"), ("skip", "u1")])


def sketch_bits(text_bytes: int) -> int:
    """The sketch's width for a corpus of so many bytes: a count for 64 bytes, about ten shingles."""
    low, high = SKETCH_BITS
    return min(high, max(low, int(text_bytes).bit_length() - 6))


def _signatures(k: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << bits, np.uint32)
        shift = np.uint64(64 - bits)
        names = [x.split()[0] for x in _SIGNATURES.split(", ")]
        for batch in slices(batches):
            rows = []
            for s in column_shingles(batch.column(1), k):
                np.add.at(counts, s >> shift, np.uint32(1))
                rows.append((len(s), int(np.sum(mix64(s), dtype=np.uint64)), int(np.sum(mix64(s ^ np.uint64(ORDER_SEEDS[0])), dtype=np.uint64))))
            n, k1, k2 = (np.array(x, np.uint64).view(np.int64) for x in zip(*rows)) if rows else [np.zeros(0, np.int64)] * 3
            none = pa.nulls(len(n), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(n), pa.array(k1), pa.array(k2), none, pa.nulls(len(n), pa.binary())], names=names)
        for i, part in enumerate(np.split(counts, _PIECES)):
            if part.any():
                none = pa.nulls(1, pa.int64())
                yield pa.RecordBatch.from_arrays([none, none, none, none, pa.array([i], pa.int32()), pa.array([zlib.compress(part.tobytes(), 1)], pa.binary())], names=names)

    return run


def _magnitudes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Binary logarithms of the summed counts of each piece, and their sum."""
    total: dict[int, np.ndarray] = {}
    for batch in slices(batches, 1):
        for i, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            part = np.frombuffer(zlib.decompress(data), np.uint32).astype(np.int64)
            total[i] = total[i] + part if i in total else part
    logs = [np.log2(np.maximum(x, 1)).astype(np.uint8).tobytes() for x in total.values()]
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(logs, pa.binary()), pa.array([int(x.sum()) for x in total.values()], pa.int64())], names=["piece", "counts", "occurrences"])


def order_keys(tokens: np.ndarray, classes: np.ndarray, order: int) -> np.ndarray:
    """Keys that sort tokens in one of the global orders: magnitude of the count, then the order's own hash."""
    shift = np.uint64(65 - len(classes).bit_length())
    magnitude = classes[tokens >> shift].astype(np.uint64) << np.uint64(58)
    return magnitude | (mix64(tokens ^ np.uint64(ORDER_SEEDS[order])) >> np.uint64(6))


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def prefix(keys: np.ndarray, percent: int) -> np.ndarray:
    p = prefix_length(len(keys), percent)
    return np.partition(keys, p - 1)[:p] if p < len(keys) else keys


def _postings(classes_var, k: int, percent: int, buckets: int, heavy_class: int):
    def packed(held: list[tuple]) -> pa.RecordBatch:
        keys, docs, sizes, scores = zip(*held)
        lengths = [len(x) for x in keys]
        key = np.concatenate(keys)
        rows = np.empty(len(key), _POSTING)
        rows["doc"], rows["n"], rows["score"] = (np.repeat(np.array(x, t), lengths) for x, t in ((docs, np.int64), (sizes, np.uint32), (scores, np.uint8)))
        before = np.arange(len(key)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        rows["skip"] = 255 * before // rows["n"]
        token = key & np.uint64((1 << 58) - 1)
        rows["token"] = token.astype(np.uint32)
        heavy = (key >> np.uint64(58)) >= heavy_class
        out = []
        light = np.flatnonzero(~heavy)
        bucket = (token[light] >> np.uint64(32)) % np.uint64(buckets)
        order = np.argsort(bucket, kind="stable")
        light, bucket = light[order], bucket[order]
        for part in np.split(np.arange(len(light)), np.flatnonzero(np.diff(bucket)) + 1) if len(light) else []:
            out.append((int(bucket[part[0]]), False, rows[light[part]].tobytes()))
        # The lists of heavy tokens are unbounded: they are dealt as they come, in pieces, with whole tokens.
        thick = np.flatnonzero(heavy)
        for part in np.array_split(thick, -(-len(thick) // 10_000)) if len(thick) else []:
            spread = int(mix64(token[part[:1]] ^ key[part[-1:]])[0] % np.uint64(buckets))
            out.append((spread, True, token[part].tobytes() + rows[part].tobytes()))
        b, h, d = zip(*out)
        return pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array(h), pa.array(d, pa.binary())], names=["bucket", "heavy", "data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = np.frombuffer(classes_var.value, np.uint8)
        seen: set[bytes] = set()
        held: list[tuple] = []
        count = 0
        for batch in slices(batches):
            for doc_id, s in zip(batch.column(0).to_pylist(), column_shingles(batch.column(1), k)):
                if doc_id is None or not len(s):
                    continue
                digest = np.array([np.sum(mix64(s), dtype=np.uint64), np.sum(mix64(s ^ np.uint64(ORDER_SEEDS[0])), dtype=np.uint64)]).tobytes()
                if digest in seen:
                    continue
                seen.add(digest)
                key = order_keys(s, classes, 0)
                own = np.sort(prefix(key, percent))
                held.append((own, doc_id, len(s), min(255, int(np.mean(key >> np.uint64(58)) * 8))))
                count += len(own)
                if count > _FLUSH:
                    yield packed(held)
                    held.clear()
                    count = 0
        if held:
            yield packed(held)

    return run


def _emit(run_id, a, b, score, skip) -> pa.RecordBatch:
    n = len(a)
    cols = [pa.nulls(n, t) if x is None else pa.array(x, t) for x, t in ((run_id, pa.int64()), (a, pa.int64()), (b, pa.int64()), (score, pa.int32()), (skip, pa.int32()))]
    return pa.RecordBatch.from_arrays(cols, names=["run_id", "a", "b", "score", "skip"])


def _may_link(x: np.ndarray, y: np.ndarray, percent: int) -> np.ndarray:
    """Whether two postings of a token allow for a link with this token as the first common one."""
    n, m = x["n"].astype(np.int64), y["n"].astype(np.int64)
    least = percent * (n + m)  # overlap * (100 + percent) must reach this
    return ((100 + percent) * (n - x["skip"] * n // 255) >= least) & ((100 + percent) * (m - y["skip"] * m // 255) >= least)


def _lists_of(rows: np.ndarray, percent: int) -> Iterator[pa.RecordBatch]:
    """Candidate pairs of the lists with few of them and members of the other lists, each set of documents once."""
    rows = rows[np.lexsort((rows["doc"], rows["token"]))]
    rows = rows[np.r_[True, (rows["token"][1:] != rows["token"][:-1]) | (rows["doc"][1:] != rows["doc"][:-1])]]
    start = np.flatnonzero(np.r_[True, rows["token"][1:] != rows["token"][:-1]])
    size = np.diff(np.r_[start, len(rows)])
    pairs = []
    for m in range(2, 5):
        at = start[size == m]
        for i in range(m):
            for j in range(i + 1, m):
                x, y = rows[at + i], rows[at + j]
                ok = _may_link(x, y, percent)
                pairs.append(np.stack((x["doc"][ok], y["doc"][ok]), 1))
    runs: dict[int, np.ndarray] = {}
    for at, m in zip(start[size > 4].tolist(), size[size > 4].tolist()):
        own = rows[at : at + m]
        run = int(np.sum(mix64(own["doc"].astype(np.uint64)), dtype=np.uint64)) >> 1
        if run in runs:
            np.minimum(runs[run]["skip"], own["skip"], out=runs[run]["skip"])
            continue
        if m <= COUNTED:
            i, j = np.triu_indices(m, 1)
            ok = _may_link(own[i], own[j], percent)
            if ok.sum() <= PAIRS_EACH * m:
                pairs.append(np.stack((own["doc"][i[ok]], own["doc"][j[ok]]), 1))
                continue
        runs[run] = own.copy()
    if pairs and len(both := np.concatenate(pairs)):
        both = both[np.lexsort((both[:, 1], both[:, 0]))]
        both = both[np.r_[True, np.any(both[1:] != both[:-1], axis=1)]]
        yield _emit(None, both[:, 0], both[:, 1], None, None)
    if runs:
        own = np.concatenate(list(runs.values()))
        yield _emit(np.repeat(np.array(list(runs), np.int64), [len(x) for x in runs.values()]), own["doc"], None, own["score"].astype(np.int32), own["skip"].astype(np.int32))


def _dealt(tokens: np.ndarray, rows: np.ndarray) -> pa.RecordBatch:
    """Postings as members of the lists of their tokens, one row each."""
    return _emit(mix64(tokens).view(np.int64) | np.int64(-(1 << 63)), rows["doc"], None, rows["score"].astype(np.int32), rows["skip"].astype(np.int32))


def _gather(percent: int):
    width = _POSTING.itemsize

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        at, count, long = None, 0, False

        def light(rows: np.ndarray, bucket: int) -> pa.RecordBatch:
            # The token's upper half is the bucket's: together they tell tokens of different buckets apart.
            return _dealt(rows["token"].astype(np.uint64) | np.uint64((bucket + 1) << 32), rows)

        for batch in slices(batches, 64):
            for bucket, heavy, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if heavy:
                    n = len(data) // (width + 8)
                    yield _dealt(np.frombuffer(data, np.uint64, n), np.frombuffer(data, _POSTING, n, 8 * n))
                    continue
                if bucket != at:
                    if held:
                        yield from _lists_of(np.concatenate(held), percent)
                    held, at, count, long = [], bucket, 0, False
                rows = np.frombuffer(data, _POSTING)
                count += len(rows)
                if not long and count > _HELD:
                    long = True
                    for part in held:
                        yield light(part, bucket)
                    held = []
                if long:
                    yield light(rows, bucket)
                else:
                    held.append(rows)
        if held:
            yield from _lists_of(np.concatenate(held), percent)

    return run


def _known(classes_var, k: int, percent: int):
    """Size, prefixes under the further orders and parity bitmap of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = np.frombuffer(classes_var.value, np.uint8)
        names = [x.split()[0] for x in _KNOWN.split(", ")]
        for batch in slices(batches, 256):
            sizes, parity, prefixes = [], [], ([], [])
            for s in column_shingles(batch.column(1), k):
                sizes.append(len(s))
                parity.append(np.packbits(np.bincount((s & np.uint64(64 * _WORDS - 1)).astype(np.int64), minlength=64 * _WORDS).astype(np.uint8) & 1).view("<i8"))
                for o, out in enumerate(prefixes, 1):
                    out.append(prefix(order_keys(s, classes, o), percent).astype(np.uint32).view(np.int32) if len(s) else np.zeros(0, np.int32))
            bits = np.array(parity, np.int64).reshape(-1, _WORDS)
            lists = [pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(x) for x in p])].astype(np.int32)), pa.array(np.concatenate([*p, np.zeros(0, np.int32)]), pa.int32())) for p in prefixes]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), *lists, *(pa.array(bits[:, i]) for i in range(_WORDS))], names=names)

    return run


def _verify(k: int, percent: int):
    """Rows (a, salt, b, text), those without b first: the texts of a document, followed by those of its partners."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, hubs = None, []
        for batch in slices(batches, 256):
            a, salt, b = (batch.column(i).to_pylist() for i in range(3))
            keep = []
            for i, other in enumerate(column_shingles(batch.column(3), k)):
                if (a[i], salt[i]) != at:
                    at, hubs = (a[i], salt[i]), []
                if b[i] is None:
                    hubs.append(other)
                    continue
                for hub in hubs:
                    small, large = sorted((len(hub), len(other)))
                    if small and 100 * small >= percent * large:
                        both = len(np.intersect1d(hub, other, assume_unique=True))
                        if 100 * both >= percent * (small + large - both):
                            keep.append(i)
                            break
            yield pa.RecordBatch.from_arrays([pa.array([a[i] for i in keep], pa.int64()), pa.array([b[i] for i in keep], pa.int64())], names=["a", "b"])

    return run


def _could_link(percent: int, m: str, n: str, can_m: str, can_n: str) -> str:
    """For sets of sizes m and n that can share can_m and can_n at most."""
    return f"{100 + percent} * least({can_m}, {can_n}) >= {percent} * ({m} + {n})"


def _bitmaps_allow(percent: int, one: str, other: str) -> Column:
    """Parity bitmaps differ in at most as many places as the sets do: a link leaves few. Columns or fields by prefix."""
    apart = reduce(add, (F.bit_count(F.col(f"{one}{b}").bitwiseXOR(F.col(f"{other}{b}"))) for b in _BITS))
    return apart * (100 + percent) <= (F.col(f"{one}n") + F.col(f"{other}n")) * (100 - percent)


class _Join:
    """What the steps of a join share: the texts, the classes of tokens, and what is known of the documents in question."""

    def __init__(self, documents: DataFrame, k: int, percent: int):
        self.spark, self.k, self.percent = documents.sparkSession, k, percent
        ship(self.spark)
        self.width = shuffle_width(self.spark)
        self.docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        self._order()
        self._candidates()

    def _order(self) -> None:
        """Sizes and classes of equal sets, and the sketch."""
        size = self.docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
        bits = sketch_bits(size)
        signed = stash(self.docs.mapInArrow(trimmed(_signatures(self.k, bits)), _SIGNATURES))
        pieces = signed.where("piece is not null").select("piece", "counts").repartition(_PIECES, "piece").mapInArrow(_magnitudes, "piece int, counts binary, occurrences long").collect()
        classes = np.zeros((_PIECES, (1 << bits) // _PIECES), np.uint8)
        for p in pieces:
            classes[p.piece] = np.frombuffer(p.counts, np.uint8)
        self.classes = self.spark.sparkContext.broadcast(classes.tobytes())  # 2 ** bits bytes, 16 MB at most
        mean = sum(p.occurrences for p in pieces) >> bits
        self.heavy_class = max(HEAVY_CLASS, (8 * mean).bit_length())
        rows = signed.where("piece is null").select("doc_id", "n_shingles", "k1", "k2")
        reps = rows.where("n_shingles > 0 and doc_id is not null").groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"))
        self.sized = stash(rows.join(reps, ["k1", "k2"], "left").select("doc_id", "n_shingles", F.coalesce("rep", "doc_id").alias("rep")))
        # An id with several texts can have several representatives: it ties them together.
        several = self.sized.groupBy("doc_id").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo < hi").select("doc_id")
        self.ties = self.sized.join(several, "doc_id").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))

    def _candidates(self) -> None:
        """Candidate pairs, and the members of longer lists, by representatives; and what is known of these."""
        percent, buckets = self.percent, _FINER * self.width
        posted = self.docs.mapInArrow(trimmed(_postings(self.classes, self.k, percent, buckets, self.heavy_class)), _POSTINGS)
        lists = stash(posted.repartition(self.width, "bucket").sortWithinPartitions("heavy", "bucket").mapInArrow(trimmed(_gather(percent)), _LISTS), rows=64)
        info = self.sized.where("doc_id is not null and n_shingles > 0").select("doc_id", "rep", "n_shingles").distinct()
        fits = f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)"
        pairs = lists.where("run_id is null").select("a", "b").distinct().join(info.toDF("a", "rep_a", "n_a"), "a").join(info.toDF("b", "rep_b", "n_b"), "b")
        pairs = pairs.where("rep_a <> rep_b").where(fits).select(F.least("rep_a", "rep_b").alias("a"), F.greatest("rep_a", "rep_b").alias("b"))
        self.pairs = stash(pairs.distinct())
        runs = lists.where("run_id is not null").select("run_id", "a", "score", "skip").join(info.toDF("a", "rep", "n"), "a")
        runs = runs.groupBy("run_id", "rep", "n").agg(F.max("score").alias("score"), F.min("skip").alias("skip"))
        runs = runs.withColumn("can", F.col("n") - F.expr("skip * n div 255")).drop("skip")  # the most that it can share
        runs = stash(runs)
        self.filter = self._needed(self.pairs.select(F.explode(F.array("a", "b")).alias("id")).union(runs.select("rep")).distinct())
        self.known = stash(self._texts().mapInArrow(trimmed(_known(self.classes, self.k, percent)), _KNOWN))
        self.runs = runs

    def _needed(self, ids: DataFrame) -> DataFrame:
        """Bits by hash of the ids in use, 1 MB at most: they only spare the other texts' shuffle."""
        place = ids.select((F.pmod(F.xxhash64("id"), F.lit(_FILTER_BITS)) + 1).alias("h"))
        return stash(place.groupBy(F.bitmap_bucket_number("h").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("h")).alias("bits")))

    def _texts(self) -> DataFrame:
        """(id, text) of the documents whose id the filter has."""
        place = F.pmod(F.xxhash64("doc_id"), F.lit(_FILTER_BITS)) + 1
        docs = self.docs.where("doc_id is not null and text is not null").withColumn("bucket", F.bitmap_bucket_number(place)).withColumn("position", F.bitmap_bit_position(place))
        byte = F.conv(F.hex(F.substring("bits", (F.expr("position div 8") + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        found = docs.join(F.broadcast(self.filter), "bucket").where(F.getbit(byte, (F.col("position") % 8).cast("int")) == 1)
        return found.select(F.col("doc_id").alias("id"), "text")

    def links(self, edges: DataFrame) -> DataFrame:
        """Of candidate pairs (a, b), those that link.

        The text of the side with more pairs goes to its partners' once for PARTNERS of them.
        """
        percent = self.percent
        side = lambda x, *columns: self.known.select(F.col("id").alias(x), *(F.col(c).alias(f"{x}_{c}") for c in columns))
        met = edges.select("a", "b").join(side("a", "n", *_BITS), "a").join(side("b", "n", *_BITS), "b").where(f"100 * least(a_n, b_n) >= {percent} * greatest(a_n, b_n)")
        met = met.where(_bitmaps_allow(percent, "a_", "b_")).select("a", "b").distinct()
        met = met.join(side("a", "p2", "p3"), "a").join(side("b", "p2", "p3"), "b").where(F.arrays_overlap("a_p2", "b_p2") & F.arrays_overlap("a_p3", "b_p3"))
        checked = stash(met.select("a", "b").distinct())
        degree = checked.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("d"))
        both = checked.join(degree.toDF("a", "da"), "a").join(degree.toDF("b", "db"), "b")
        turned = F.col("da") < F.col("db")
        dealt = both.select(F.when(turned, F.col("b")).otherwise(F.col("a")).alias("a"), F.when(turned, F.col("a")).otherwise(F.col("b")).alias("b"), F.greatest("da", "db").alias("d"))
        dealt = stash(dealt.select("a", F.pmod(F.xxhash64("b"), F.ceil(F.col("d") / PARTNERS).cast("long")).alias("salt"), "b"))
        texts = self._texts()
        partners = dealt.join(texts.toDF("b", "text"), "b").select("a", "salt", "b", "text")
        hubs = dealt.select("a", "salt").distinct().join(texts.toDF("a", "text"), "a").select("a", "salt", F.lit(None).cast("long").alias("b"), "text")
        rows = hubs.unionByName(partners).repartition(self.width, "a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
        return stash(rows.mapInArrow(trimmed(_verify(self.k, percent)), "a long, b long").distinct(), rows=256)

    def cells(self, runs: DataFrame, apart: str = "true") -> DataFrame:
        """The pairs of each list that can link, met in cells of about PAIR_BLOCK members each way: a < b."""
        runs = runs.join(self.known.select(F.col("id").alias("rep"), "n", *_BITS), ["rep", "n"])
        blocks = runs.groupBy("run_id").agg(F.ceil(F.count("*") / PAIR_BLOCK).cast("long").alias("blocks"))
        dealt = runs.join(blocks, "run_id").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")))
        one = dealt.withColumn("i", F.col("block")).withColumn("j", F.expr("explode(sequence(block, blocks - 1))"))
        kept = [c for c in runs.columns if c != "run_id"]
        other = dealt.select("run_id", F.expr("explode(sequence(0L, block))").alias("i"), F.col("block").alias("j"), *(F.col(c).alias(f"{c}2") for c in kept))
        other = other.withColumnsRenamed({f"{c}2": f"o_{c}" for c in (*_BITS, "n")})
        met = one.join(other, ["run_id", "i", "j"]).where("i < j or rep < rep2").where(f"rep <> rep2 and ({apart})")
        renamed = met.withColumnsRenamed({c: f"m_{c}" for c in (*_BITS, "n")})
        met = renamed.where(_could_link(self.percent, "m_n", "o_n", "can", "can2")).where(_bitmaps_allow(self.percent, "m_", "o_"))
        return met.select(F.least("rep", "rep2").alias("a"), F.greatest("rep", "rep2").alias("b"))

    def stars(self, runs: DataFrame, by: list[Column], apart: str = "true") -> DataFrame:
        """Pairs of each list's members with a few of them: those that are largest by each of some columns."""
        fields = [c for c in runs.columns if c in ("rep", "n", "can", "label")]
        best = runs.groupBy("run_id").agg(*(F.max_by(F.struct(*fields), key).alias(f"hub{i}") for i, key in enumerate(by)))
        hubs = best.select("run_id", F.explode(F.array_distinct(F.array(*(f"hub{i}" for i in range(len(by)))))).alias("hub"))
        met = runs.join(hubs, "run_id").where("rep <> hub.rep").where(apart).where(_could_link(self.percent, "n", "hub.n", "can", "hub.can"))
        return met.select(F.col("hub.rep").alias("a"), F.col("rep").alias("b"))


def shingle_links(documents: DataFrame, k: int = 5, percent: int = 75) -> DataFrame:
    """(doc_id, text) to a, b: all links (a < b) between representatives, the smallest ids of equal sets, each once.

    Documents with equal sets are linked, too, and share the links of their representative. All pairs of a longer list
    that size, place and bitmap allow are verified, met in cells, so that no task meets a whole list.
    """
    join = _Join(documents, k, percent)
    return join.links(stash(join.pairs.union(join.cells(join.runs)).distinct()))


def shingle_components(documents: DataFrame, k: int = 5, percent: int = 75) -> DataFrame:
    """(doc_id, text) to doc_id, n_shingles, component_id: the smallest id linked with it by any chain, or its own.

    100 * intersection >= percent * union links two sets. See the module for the method and the defined cases.
    """
    join = _Join(documents, k, percent)
    ties = [F.struct("score", t) for t in (-F.col("rep"), F.xxhash64("rep"), F.xxhash64("rep", "n"))]
    tried = stash(_sorted(join.pairs.union(join.stars(join.runs, ties))))
    links = join.links(tried)
    edges = links.union(join.ties)
    label, runs, turn = connected_components(edges), join.runs.drop("score"), 0
    allowed = CROSSING_EACH * runs.count()
    while True:
        marked = runs.join(label.toDF("rep", "label"), "rep", "left").withColumn("label", F.coalesce("label", "rep"))
        shares = marked.groupBy("run_id", "label").agg(F.count("*").alias("c")).groupBy("run_id").agg(F.sum("c").alias("members"), F.sum(F.col("c") * F.col("c")).alias("same"))
        crossing = (F.col("members") * F.col("members") - F.col("same")) / 2
        ahead = shares.select("run_id", crossing.alias("crossing"), (crossing <= PAIRS_EACH * F.col("members")).alias("few")).where("crossing > 0")
        left = stash(marked.join(ahead, "run_id"))
        if left.isEmpty():
            break
        # As many pairs as this in all are linear work, however they are dealt among the lists.
        last = turn >= ROUNDS or left.select("run_id", "crossing").distinct().agg(F.sum("crossing")).first()[0] <= allowed
        left = left.drop("crossing")
        now, rest = join.cells((left if last else left.where("few")).drop("few"), "label <> label2"), left.where("not few").drop("few")
        if not last:
            keys = [F.xxhash64(F.lit(turn), "rep"), F.struct(F.xxhash64(F.lit(turn), "label"), F.xxhash64("rep"))]
            now = now.union(join.stars(rest, keys, "label <> hub.label"))
        fresh = stash(_sorted(now).join(tried, ["a", "b"], "left_anti"))
        found = join.links(fresh)
        nothing = found.isEmpty()
        if not nothing:
            label = connected_components(found.union(label.select("node", "label")))
        if last:
            break
        # Stars that find nothing more end the rounds: what is left is met in cells.
        turn = ROUNDS if nothing else turn + 1
        tried, runs = tried.union(fresh), rest.drop("label")
    return join.sized.join(label.toDF("rep", "label"), "rep", "left").select("doc_id", "n_shingles", F.coalesce("label", "rep").alias("component_id"))


def _sorted(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def one_of_each(documents: DataFrame, k: int = 5, percent: int = 75) -> DataFrame:
    """``documents`` without those that a chain of links ties to a smaller id; rows without id stay."""
    drop = free("_drop", documents.columns)
    found = shingle_components(documents, k, percent).where("doc_id <> component_id").select(F.col("doc_id").alias(drop)).distinct()
    return documents.join(stash(found).hint("merge"), F.col("doc_id").cast("long") == F.col(drop), "left_anti")


def brute_components(rows: list[tuple[int, str | None]], k: int = 5, percent: int = 75) -> dict[int, tuple[int, int]]:
    """Plain version for tests: id to (set size, component)."""
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = {}
    for i, t in rows:
        words = (t or "").translate(low).encode().split()
        sets[i] = {tuple(words[j : j + k]) for j in range(max(1, len(words) - k + 1))} if words else set()
    root = {i: i for i in sets}

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, x in enumerate(ids):
        for y in ids[i + 1 :]:
            if sets[x] and sets[y] and 100 * len(sets[x] & sets[y]) >= percent * len(sets[x] | sets[y]):
                p, q = sorted((find(x), find(y)))
                root[q] = p
    return {i: (len(sets[i]), find(i)) for i in ids}


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shingle_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents
), s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' '))
    WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS sh
  FROM w
), n AS (
  SELECT doc_id, len(sh) AS n FROM s
), e AS (
  SELECT doc_id, unnest(sh) AS g FROM s
), c AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM e x JOIN e y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL
), l AS (
  SELECT a, b FROM c JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * k >= 75 * (p.n + q.n - k)
), u AS (
  SELECT a, b FROM l UNION ALL SELECT b, a FROM l
), r AS (
  SELECT doc_id, doc_id AS root FROM n
  UNION
  SELECT u.b, r.root FROM r JOIN u ON u.a = r.doc_id
)
SELECT n.doc_id, n.n AS n_shingles, min(r.root) AS component_id FROM n JOIN r USING (doc_id) GROUP BY ALL
"""
