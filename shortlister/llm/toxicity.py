"""Toxicity by weak supervision.

Voters look at a document. Fixed ones: lexicons of insults by theme, and typographic and grammatical patterns. Mined
ones, from labelled rows: a word, a word beginning that occurs, or a word beginning that two to four
different words of the document share; each is a cue only if so many of the rows that have it are toxic that chance would give less than
MINED_BY_CHANCE such cues among all that occur as often, and MINED_PRECISION of them at least. The cues that together cover the toxic rows best become voters.

A generative model with two latent classes, the second one a mixture, explains the votes of labelled and unlabelled rows
without looking at any label: within a component each voter depends on one other voter (a tree of the strongest
conditional mutual information, found anew in each round), so that it estimates, by expectation maximisation, how often
each voter fires and how voters go together, and voters that repeat each other do not count twice. Its posteriors label
the rows, and a
linear (logistic) classifier over all cues and fixed words is trained on them. It then scores every whole text. Labels
serve only to mine cues, and only from rows outside the held-out fold; labels, languages, sources and ids are never
inputs of a score.

Bounds, as parameters: SAMPLE_ROWS labelled and as many unlabelled rows, both outside the held-out fold and the first in
an order of hashes; CUES cues, the most frequent ones; MINED_VOTERS mined voters. Words are counted in tasks and by
Spark; the driver collects the cues, and of each sample row only which cues it has.

Defined cases: a null or empty text has no features and gets the score of the bias alone. Of labels that repeat for an
id the largest counts; null labels are ignored. Rows that repeat an id are sample rows each, the first ones in order of
a hash of the text, within the bound. Without any labelled row, or none of one of the classes, the fixed lexicons alone
are the classifier, with fixed weights. Rows that repeat are scored each; other columns of ``documents`` are kept by
``keep_clean``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from math import lgamma, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words64, chunks, free, lowered, mix64, ship, slices, span_hashes, stash, trimmed, utf8, word_spans

#: Fixed lexicons by theme; each is a voter.
LEXICONS = {
    "stupidity": ("idiot", "idiots", "moron", "morons", "stupid", "imbecile", "dumbass", "idiota", "dummkopf", "crétin"),
    "worthlessness": ("worthless", "trash", "wertlos", "inútil"),
    "filth": ("scum", "vermin", "abschaum", "ordure", "escoria"),
    "failure": ("loser", "losers", "pathetic", "versager", "minable", "perdedor"),
    "ridicule": ("clown", "clowns", "payaso", "bouffon", "witzfigur"),
    "disgust": ("disgusting", "repulsive", "widerlich", "dégoûtant", "asqueroso"),
    "abuse": ("bastard", "bitch", "asshole", "arschloch", "connard", "cabrón", "fuck", "shit", "scheisse", "merde", "mierda"),
}
PATTERNS = ("mostly capitals", "runs of exclamation or question marks", "masked words", "a letter three times")
SAMPLE_ROWS = 12_000
CUES, MINED_VOTERS = 4096, 40
#: Cues that chance would give among all features of the same frequency, at most.
MINED_BY_CHANCE = 0.05
#: The share of toxic rows among those that have a cue, at least.
MINED_PRECISION = 0.9
#: How many mined voters a toxic row should have.
COVER = 3
FOLDS = 5
#: Lengths in bytes of the word beginnings.
STEMS = (4, 5, 6, 7, 8)
_SEPARATOR = bytes(int(i < 128 and not chr(i).isalpha()) for i in range(256))
_UPPER, _LETTER, _BANG, _MASK = (np.array([i in x for i in range(256)]) for x in (range(65, 91), [*range(65, 91), *range(97, 123)], b"!?", b"*@$#"))


def _salt(i: int) -> np.uint64:
    return np.uint64(0x9E3779B97F4A7C15 * (i + 1) & (1 << 64) - 1)


#: For a beginning that two, three or four different words share.
_AGAIN = (_salt(100), _salt(101), _salt(102))


class Wanted:
    """A set of features, prepared for look-up."""

    def __init__(self, features: np.ndarray):
        self.features = np.sort(features.astype(np.uint64))
        self.table = np.zeros(1 << 18, bool)
        self.table[(self.features & np.uint64((1 << 18) - 1)).astype(np.int64)] = True

    def has(self, h: np.ndarray) -> np.ndarray:
        out = self.table[(h & np.uint64((1 << 18) - 1)).astype(np.int64)]
        at = np.flatnonzero(out)
        if len(at):
            place = np.minimum(np.searchsorted(self.features, h[at]), len(self.features) - 1)
            out[at] = self.features[place] == h[at]
        return out


def features(raw: np.ndarray, off: np.ndarray, wanted: Wanted | None = None) -> Iterator[np.ndarray]:
    """Each row's distinct features, sorted: words, word beginnings, and beginnings that two to four different words share; of those wanted only, if given."""
    starts, ends, first = word_spans(raw, off, _SEPARATOR)
    row, length = np.repeat(np.arange(len(off) - 1), np.diff(first)), ends - starts
    text = Words64(lowered(raw))
    word = mix64(span_hashes(text, starts, ends) ^ _salt(0))
    keep = slice(None) if wanted is None else wanted.has(word)
    found, rows = [word[keep]], [row[keep]]
    for n in STEMS:
        use = np.flatnonzero(length > n)
        h = mix64(text.heads(starts[use], n) ^ _salt(n))
        if wanted is not None:
            hit = wanted.has(h)
            for again in _AGAIN:
                hit |= wanted.has(mix64(h ^ again))
            use, h = use[hit], h[hit]
        if not len(use):
            continue
        order = np.lexsort((word[use], h, row[use]))
        h, r, w = h[order], row[use][order], word[use][order]
        stem = np.r_[True, (h[1:] != h[:-1]) | (r[1:] != r[:-1])]
        new = stem | np.r_[True, w[1:] != w[:-1]]
        h, r, stem = h[new], r[new], stem[new]
        start = np.flatnonzero(stem)
        words = np.diff(np.r_[start, len(h)])
        h, r = h[start], r[start]
        for least, x in ((1, h), *((i, mix64(h ^ again)) for i, again in enumerate(_AGAIN, 2))):
            part = words >= least if wanted is None else (words >= least) & wanted.has(x)
            found.append(x[part])
            rows.append(r[part])
    h, r = np.concatenate(found), np.concatenate(rows)
    order = np.argsort(r, kind="stable")
    cuts = np.searchsorted(r[order], np.arange(1, len(off) - 1))
    for part in np.split(h[order], cuts):
        yield np.unique(part)


def patterns(raw: np.ndarray, off: np.ndarray) -> Iterator[int]:
    """A bit for each of PATTERNS."""
    for a, b in zip(off[:-1].tolist(), off[1:].tolist()):
        t = raw[a:b]
        letter, upper, bang, mask = _LETTER[t], _UPPER[t], _BANG[t], _MASK[t]
        up, low = int(upper.sum()), int((letter & ~upper).sum())
        bits = int(up > 20 and up > low)
        if b - a > 2:
            bits |= 2 * bool((bang[:-2] & bang[1:-1] & bang[2:]).any())
            bits |= 4 * bool((letter[:-2] & mask[1:-1] & (letter | mask)[2:]).any())
            same = (t[:-2] == t[1:-1]) & (t[1:-1] == t[2:]) & letter[:-2]
            bits |= 8 * bool(same.any())
        yield bits


def word_feature(word: str) -> int:
    raw = np.frombuffer(word.encode(), np.uint8)
    return int(mix64(span_hashes(lowered(raw), np.array([0]), np.array([len(raw)])) ^ _salt(0))[0])


@dataclass
class Model:
    """Weights by sorted feature, the bias, and what the label model found out about the voters."""

    features: np.ndarray
    weights: np.ndarray
    bias: float
    voters: list[str] = field(default_factory=list)
    rates: np.ndarray = field(default_factory=lambda: np.zeros((0, 2)))
    correlations: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    wanted: Wanted | None = None

    def scores(self, raw: np.ndarray, off: np.ndarray) -> Iterator[float]:
        if self.wanted is None:
            self.wanted = Wanted(self.features)
        for f in features(raw, off, self.wanted):
            z = self.bias + float(self.weights[np.searchsorted(self.features, f)].sum())
            yield 1 / (1 + np.exp(-min(50.0, max(-50.0, z))))


def _tree(information: np.ndarray) -> list[int]:
    """Each node's parent in the heaviest spanning tree (-1: the root, or nothing to gain), by growing it from node 0."""
    m = len(information)
    parent, best, source = [-1] * m, information[0].copy() if m else np.zeros(0), np.zeros(m, int)
    inside = np.zeros(m, bool)
    inside[:1] = True
    for _ in range(m - 1):
        node = int(np.argmax(np.where(inside, -1.0, best)))
        parent[node] = int(source[node]) if best[node] > 0 else -1
        inside[node] = True
        closer = information[node] > best
        best[closer], source[closer] = information[node][closer], node
    return parent


def _families(votes: np.ndarray, sure: np.ndarray, most: int) -> list[np.ndarray]:
    """Groups of sure voters that fire together, the most frequent ones: each begins a component of class 1."""
    rate = votes.mean(axis=0)
    scale = np.sqrt(rate * (1 - rate)) + 1e-9
    together = (votes.T @ votes / len(votes) - np.outer(rate, rate)) / np.outer(scale, scale) > 0.2
    left, out = [j for j in sure.tolist() if rate[j] > 0], []
    while left:
        group, todo = set(), [left[0]]
        while todo:
            if (j := todo.pop()) not in group:
                group.add(j)
                todo += [i for i in left if together[i, j] and i not in group]
        left = [j for j in left if j not in group]
        out.append(np.array(sorted(group)))
    return sorted(out, key=lambda g: -votes[:, g].any(axis=1).sum())[:most]


def label_model(votes: np.ndarray, sure: np.ndarray | None = None, components: int = 8, alone: int = 1, rounds: int = 40) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Votes (rows by voters, 0/1) to posteriors of class 1, rates of voters in classes 0 and 1, and correlations within class 0.

    Class 0 has one component, class 1 one for each family of sure voters that fire together (so that insults of one
    language do not speak against those of another). Given the component, a voter depends on its parent in a tree of the
    voters that have most to say about each other; the first rounds, ``alone``, look at sure voters only and take them
    for independent, so that the components are found before what is left is explained by the tree.
    """
    n, m = votes.shape
    if not n or not m:
        return np.zeros(n), np.zeros((m, 2)), np.zeros((m, m))
    votes = votes.astype(np.float64)
    sure = np.arange(m) if sure is None else sure
    families = _families(votes, sure, components)
    p = np.stack([np.full(n, 0.05), *(votes[:, g].sum(axis=1) for g in families)], axis=1)
    p[p[:, 1:].sum(axis=1) == 0, 0] = 1
    p /= p.sum(axis=1, keepdims=True)
    for turn in range(rounds):
        prior, rates, pairs, information = [], [], [], np.zeros((m, m))
        for weight in p.T:
            total = weight.sum() + 1
            rate = (weight @ votes + 0.5) / (total + 1)
            both = (votes.T * weight) @ votes
            # Shrunk towards independence, by a few rows' weight.
            joint = (both + 4 * np.outer(rate, rate)) / (total + 4)
            joint = np.clip(joint, 1e-9, np.minimum(rate[:, None], rate[None, :]) - 1e-12)
            cells = [joint, rate[:, None] - joint, rate[None, :] - joint, 1 - rate[:, None] - rate[None, :] + joint]
            apart = [np.outer(rate, rate), np.outer(rate, 1 - rate), np.outer(1 - rate, rate), np.outer(1 - rate, 1 - rate)]
            information += total / (n + len(p.T)) * sum(np.clip(c, 1e-12, 1) * np.log(np.clip(c, 1e-12, 1) / x) for c, x in zip(cells, apart))
            prior.append(total / (n + len(p.T)))
            rates.append(rate)
            pairs.append(joint)
        np.fill_diagonal(information, 0)
        information[information < log(n + 1) / n] = 0  # what a parameter more has to explain
        parent = _tree(information) if turn >= alone else [-1] * m
        z = np.zeros((n, len(prior)))
        for c, (rate, joint, share) in enumerate(zip(rates, pairs, prior)):
            z[:, c] = log(share)
            for j in sure.tolist() if turn < alone else range(m):
                chance, q = np.full(n, rate[j]), parent[j]
                if q >= 0:
                    with_parent, without = joint[j, q] / rate[q], (rate[j] - joint[j, q]) / (1 - rate[q])
                    chance = np.clip(np.where(votes[:, q] > 0, with_parent, without), 1e-9, 1 - 1e-9)
                z[:, c] += np.log(np.where(votes[:, j] > 0, chance, 1 - chance))
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
    scale = np.sqrt(rates[0] * (1 - rates[0]))
    correlations = (pairs[0] - np.outer(rates[0], rates[0])) / np.outer(scale, scale)
    np.fill_diagonal(correlations, 1)
    toxic = sum((w * r for w, r in zip(prior[1:], rates[1:])), np.zeros(m)) / max(sum(prior[1:]), 1e-9)
    return 1 - p[:, 0], np.stack((rates[0], toxic), 1), correlations


def _logistic(columns: list[np.ndarray], m: int, y: np.ndarray, ridge: float = 0.3, rounds: int = 300) -> tuple[np.ndarray, float]:
    """Weights and bias by accelerated gradient steps over rows given as the numbers of their ones; the bias isn't penalised."""
    n = len(columns)
    sizes = np.array([len(c) for c in columns], np.int64)
    col, row = np.concatenate([*columns, np.zeros(0, np.int64)]).astype(np.int64), np.repeat(np.arange(n), sizes)
    w, b, vw, vb = np.zeros(m), -2.0, np.zeros(m), 0.0
    step = 4.0 / ((float(sizes.max(initial=0)) + 1) * max(1.0, n / 50))
    for i in range(rounds):
        z = np.bincount(row, w[col], n) + b
        e = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
        gw, gb = np.bincount(col, e[row], m) + ridge * w, float(e.sum())
        momentum = i / (i + 3)
        vw, vb = momentum * vw - step * gw, momentum * vb - step * gb
        w, b = w + vw, b + vb
    return w, b


def _lexicon() -> list[tuple[str, np.ndarray]]:
    return [(f"lexicon of {name}", np.array(sorted(word_feature(w) for w in words), np.uint64)) for name, words in LEXICONS.items()]


def fixed_model() -> Model:
    known = np.sort(np.concatenate([x for _, x in _lexicon()]))
    return Model(known, np.full(len(known), 6.0), -4.0)


def fit(cues: np.ndarray, rows: list[tuple[np.ndarray, int, int | None]], mined_voters: int = MINED_VOTERS) -> Model:
    """From mined cues and, for each sample row, the features it has of cues and lexicons, pattern bits, and label or None."""
    fixed = _lexicon()
    columns = np.unique(np.concatenate([cues, *(x for _, x in fixed)]))
    own = [np.searchsorted(columns, f) for f, _, _ in rows]
    # Mined voters: greedily those that cover toxic rows not yet covered COVER times.
    mined = np.searchsorted(columns, cues)
    known = [set(np.searchsorted(columns, x).tolist()) for _, x in fixed]
    toxic = [set(c.tolist()) for c, (_, _, y) in zip(own, rows) if y == 1]
    need, voters = np.array([COVER - sum(bool(t & g) for g in known) for t in toxic], np.int64), []
    mined = mined[~np.isin(mined, np.concatenate([np.fromiter(g, np.int64) for g in known]))]
    has = np.array([[int(c in t) for c in mined.tolist()] for t in toxic], np.int8).reshape(len(toxic), len(mined))
    while len(voters) < min(mined_voters, len(mined)):
        gain = (need > 0).astype(np.int64) @ has
        gain[voters] = 0
        best = int(np.argmax(gain)) if len(gain) else 0
        if not len(gain) or gain[best] < 1:
            break
        voters.append(best)
        need = need - has[:, best]
    groups = [np.searchsorted(columns, x) for _, x in fixed] + [mined[[v]] for v in voters]
    names = [n for n, _ in fixed] + [f"mined cue {columns[mined[v]]:016x}" for v in voters] + list(PATTERNS)
    votes = np.zeros((len(rows), len(names)), bool)
    member = np.zeros((len(columns), len(groups)), bool)
    for j, g in enumerate(groups):
        member[g, j] = True
    for i, c in enumerate(own):
        votes[i, : len(groups)] = member[c].any(axis=0)
    for j in range(len(PATTERNS)):
        votes[:, len(groups) + j] = [p >> j & 1 for _, p, _ in rows]
    posterior, rates, corr = label_model(votes, np.arange(len(groups)))
    w, b = _logistic(own, len(columns), posterior)
    return Model(columns, w, b, names, rates, corr)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def _tail(hits: int, rows: int, rate: float) -> float:
    """The chance of at least so many hits among rows that each hit at the rate."""
    one = lambda k: lgamma(rows + 1) - lgamma(k + 1) - lgamma(rows - k + 1) + k * log(rate) + (rows - k) * log(1 - rate)
    return float(np.exp([one(k) for k in range(hits, min(rows, hits + 200) + 1)]).sum())


def _least_hits(frequencies: dict[int, int], rate: float) -> dict[int, int]:
    """For each number of rows that a feature occurs in, how many of them have to be toxic."""
    out, above = {}, sum(frequencies.values())
    for rows in sorted(frequencies):
        low, high = 1, rows + 1
        while low < high:
            mid = (low + high) // 2
            low, high = (low, mid) if _tail(mid, rows, rate) * above <= MINED_BY_CHANCE else (mid + 1, high)
        if low <= rows:
            out[rows] = low
        above -= frequencies[rows]
    return out


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, toxic) to feature, hits, rows, added up for some rows at a time."""
    for batch in slices(batches, 128):
        raw, off = utf8(batch.column(0))
        parts = [f for a, b in chunks(off) for f in features(raw[off[a] : off[b]], off[a : b + 1] - off[a])]
        toxic = np.repeat(batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64), [len(f) for f in parts])
        found, at = np.unique(np.concatenate([*parts, np.zeros(0, np.uint64)]), return_inverse=True)
        yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(np.bincount(at, toxic, len(found)).astype(np.int64)), pa.array(np.bincount(at, minlength=len(found)).astype(np.int64))], names=["feature", "hits", "rows"])


def _sample(documents: DataFrame, labels: DataFrame, sample_rows: int) -> DataFrame:
    """text, toxic (null: unlabelled) of at most ``sample_rows`` labelled and as many other rows outside the held-out fold."""
    ids = documents.select(F.col("doc_id").cast("long").alias("id")).where("id is not null").where(~held_out(F.col("id")))
    known = labels.where("toxic is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max("toxic").cast("int").alias("toxic")).where(~held_out(F.col("id")))
    first = lambda rows: rows.orderBy(F.xxhash64("id"), "id").limit(sample_rows)
    chosen = F.broadcast(stash(first(known).union(first(ids.join(known, "id", "left_anti").distinct().withColumn("toxic", F.lit(None).cast("int"))))))  # two numbers each of 2 * sample_rows rows
    rows = documents.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).join(chosen, "id")
    # Ids that repeat could bring more rows than the bound.
    ranked = rows.select("id", "toxic", F.xxhash64("text").alias("key")).orderBy(F.col("toxic").isNull(), F.xxhash64("id"), "id", "key").limit(2 * sample_rows)
    return stash(rows.withColumn("key", F.xxhash64("text")).join(F.broadcast(ranked.select("id", "key").distinct()), ["id", "key"], "left_semi").select("text", "toxic"))


def train(documents: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, cues: int = CUES) -> Model:
    """Fit on a bounded sample outside the held-out fold, chosen by a hash of the id; see the module."""
    ship(documents.sparkSession)
    sample = _sample(documents, labels, sample_rows)
    known = sample.where("toxic is not null")
    total = known.agg(F.count("*").alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic")).first()
    if not 0 < total.toxic < total.n:
        return fixed_model()
    counts = stash(known.mapInArrow(trimmed(_counted), "feature long, hits long, rows long").groupBy("feature").agg(F.sum("hits").alias("hits"), F.sum("rows").alias("rows")).where("rows > 1"))
    least = _least_hits({r.rows: r.n for r in counts.groupBy("rows").agg(F.count("*").alias("n")).collect()}, total.toxic / total.n)
    if least:
        table = documents.sparkSession.createDataFrame(list(least.items()), "rows long, least long")
        found = counts.join(F.broadcast(table), "rows").where("hits >= least").where(F.col("hits") >= MINED_PRECISION * F.col("rows")).orderBy(F.desc("hits"), "rows", "feature").limit(cues).collect()  # a row for each frequency in a bounded sample
    mined = np.sort(np.array([r.feature for r in found] if least else [], np.int64).view(np.uint64))
    wanted = Wanted(np.unique(np.concatenate([mined, *(x for _, x in _lexicon())])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            raw, off = utf8(batch.column(0))
            own, bits = [], []
            for a, b in chunks(off):
                part, o = raw[off[a] : off[b]], off[a : b + 1] - off[a]
                own += [f.tobytes() for f in features(part, o, wanted)]
                bits += patterns(part, o)
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.binary()), pa.array(bits, pa.int32()), batch.column(1)], names=["f", "bits", "toxic"])

    rows = sample.mapInArrow(trimmed(run), "f binary, bits int, toxic int").collect()  # a few features of a bounded number of rows
    rows.sort(key=lambda r: (bytes(r.f), r.bits, -1 if r.toxic is None else r.toxic))
    return fit(mined, [(np.frombuffer(r.f, np.uint64), r.bits, r.toxic) for r in rows])


def scored(documents: DataFrame, model: Model, name: str = "toxic_score") -> DataFrame:
    """``documents`` with a double column of scores."""
    spark = documents.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)  # CUES weights at most, and the lexicons'

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        raw, off = utf8(texts)
        out: list[float] = []
        for a, b in chunks(off):
            out += shared.value.scores(raw[off[a] : off[b]], off[a : b + 1] - off[a])
        return pa.array(out, pa.float64())

    return documents.withColumn(name, score(F.col("text").cast("string")))


def keep_clean(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``documents`` with a score under 0.5, as they are."""
    model = train(documents, labels)
    name = free("toxic_score", documents.columns)
    return scored(documents, model, name).where(F.col(name) < 0.5).select(*(f"`{c}`" for c in documents.columns))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = train(documents, labels)
    out = scored(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("toxic_score").alias("score"), (F.col("toxic_score") >= 0.5).cast("int").alias("predicted"))
