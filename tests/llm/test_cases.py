"""Defined cases and brute-force versions: built-in collisions, repeated ids, long lists, long components, nested archives."""

import gzip
import io
import random
import re
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from shortlister.llm import chat, common, feistel, jaccard, linedup, mix, pack, topk, toxicity, warc, winnow

WORDS = [f"w{i}" for i in range(400)]


def complements(n):
    """Two texts of n letters a and b that every polynomial modulo 2 ** 64 with an odd base takes for equal from 1,024 letters on."""
    s = "a"
    while len(s) < n:
        s += s.translate(str.maketrans("ab", "ba"))
    return s, s.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("n", [8, 1024, 2048, 4096])
def test_hashes_have_no_collisions_by_construction(n):
    one, other = complements(n)
    raw = np.frombuffer((one + other).encode(), np.uint8)
    h = common.span_hashes(raw, np.array([0, n, 0]), np.array([n, 2 * n, n]))
    assert h[0] != h[1] and h[0] == h[2]
    a, b = common.shingle_sets(*common.utf8(pa.array([one, other])))
    assert a.tolist() != b.tolist()
    assert len(set(linedup._measured(raw, np.array([0, n, 2 * n]))[0].tolist())) == 2
    tok = pack.tokenizer(pack.tokenizer_path())
    for text, ids in zip((one, other), tok.batch([one, other])):
        assert ids.tolist() == tok.whole.encode(text, add_special_tokens=False).ids


def test_hashes_of_spans_are_those_of_their_bytes():
    r = random.Random(1)
    raw = np.frombuffer(bytes(r.choice(b"ab ") for _ in range(3000)), np.uint8)
    starts = np.array([r.randrange(2000) for _ in range(400)])
    ends = starts + np.array([r.randrange(0, 600) for _ in starts])
    h = common.span_hashes(raw, starts, ends)
    by = {}
    for a, b, x in zip(starts, ends, h.tolist()):
        assert by.setdefault(raw[a:b].tobytes(), x) == x
        assert common.span_hashes(raw[a:b].copy(), np.array([0]), np.array([b - a]))[0] == x
    assert len(set(by.values())) == len(by)


def test_session_settings_stay(spark):
    keys = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch")
    before = [spark.conf.get(k, None) for k in keys]
    df = spark.createDataFrame([(i, "a b c d e f g " * 3, "s") for i in range(5)], "doc_id long, text string, source string")
    for f in (jaccard.shingle_components, linedup.without_repeats, winnow.edited_likeness, lambda d: pack.pack_documents(d, pack.tokenizer_path())):
        f(df).collect()
    assert [spark.conf.get(k, None) for k in keys] == before


def templated(n, seed=1):
    r = random.Random(seed)
    fixed = [" ".join(f"t{i}_{k}" for k in range(6)) for i in range(21)]
    either = [[" ".join(f"v{i}_{x}_{k}" for k in range(3)) for x in range(2)] for i in range(20)]
    return [(d, " ".join([fixed[0], *(f"{either[i][r.randint(0, 1)]} {fixed[i + 1]}" for i in range(20))])) for d in range(n)]


def test_templated_pages_in_rounds_of_stars(spark):
    rows = templated(150)
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard.shingle_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == jaccard.brute_components(rows) and len({c for _, c in got.values()}) > 1


@pytest.mark.parametrize("held", [500_000, 50])
def test_heavy_lists_of_more_than_1100_documents(spark, monkeypatch, held):
    """A passage that all documents share makes tokens heavy; copies with a changed word lie among them."""
    monkeypatch.setattr(jaccard, "_HELD", held)
    r = random.Random(4)
    shared = " ".join(r.choice(WORDS) for _ in range(60))
    rows = [(i, f"{shared} " + " ".join(r.choice(WORDS) for _ in range(r.choice((1, 2, 14, 80))))) for i in range(1200)]
    plain = {i: jaccard_set(t) for i, t in rows}
    size = {}
    for x in {frozenset(x) for x in plain.values()}:
        size[x] = len(x)
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard.shingle_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == numpy_components(plain)


def jaccard_set(text):
    w = text.split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def numpy_components(sets):
    ids, tokens = sorted(sets), {t: i for i, t in enumerate({t for s in sets.values() for t in s})}
    m = np.zeros((len(ids), len(tokens)), np.float32)
    for i, d in enumerate(ids):
        m[i, [tokens[t] for t in sets[d]]] = 1
    both, n = m @ m.T, m.sum(axis=1)
    link = 100 * both >= 75 * (n[:, None] + n[None, :] - both)
    label = np.arange(len(ids))
    while True:
        new = np.where(link, label[None, :], len(ids)).min(axis=1)
        if (new == label).all():
            return {d: (int(n[i]), ids[label[i]]) for i, d in enumerate(ids)}
        label = new


def test_jaccard_of_ids_with_several_texts(spark):
    r = random.Random(2)
    x, y = (" ".join(r.choice(WORDS) for _ in range(30)) for _ in range(2))
    rows = [(5, x), (5, y), (5, ""), (3, x), (9, y), (7, "other words that are alone here"), (4, None), (4, "")]
    got = sorted((t.doc_id, t.component_id) for t in jaccard.shingle_components(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(3, 3), (4, 4), (4, 4), (5, 3), (5, 3), (5, 3), (7, 7), (9, 3)]


PASSAGE = "This passage has a good many words in it so that it surely counts. And it goes on with one more line of words. "


def test_line_dedup_tells_rows_of_one_id_apart(spark):
    rows = [(1, f"First. {PASSAGE}"), (2, f"{PASSAGE}tail a"), (2, "Keep me, I am unique. Another line."), (2, f"{PASSAGE}tail a"), (2, f"Third one. {PASSAGE}end"), (3, f"{PASSAGE}x")]
    df = spark.createDataFrame([(i, t, 1, 2, "k") for i, t in rows], "doc_id long, text string, _gone int, removed_lines int, _cut_id string")
    got = sorted((r.doc_id, r.text, r.removed_lines) for r in linedup.without_repeats(df).collect())
    assert got == sorted([(1, rows[0][1], 0), (2, "tail a", 2), (2, rows[2][1], 0), (2, "tail a", 2), (2, "Third one. end", 2), (3, "x", 2)])


@pytest.mark.parametrize("n", [20, 21, 2000])
def test_line_dedup_is_the_same_at_any_number_of_documents(spark, n):
    lines = ["ten words stand on this one of the three lines.", "and ten more of them are standing on the second.", "the third has as many of them as the others."]
    rows = [(i, f"own words of number {i}\n" + "\n".join(lines) + f"\nend {i}") for i in range(n)]
    out = {r.doc_id: r for r in linedup.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[0].text == rows[0][1] and all(out[i].text == f"own words of number {i}\nend {i}" for i in range(1, n))


def test_line_dedup_of_a_very_long_text(spark):
    r = random.Random(3)
    long = "".join(" ".join(r.choice(WORDS) for _ in range(8)) + ". " for _ in range(30_000))
    out = {x.doc_id: x for x in linedup.without_repeats(spark.createDataFrame([(1, long), (2, "Own line. " + long + "Tail.")], "doc_id long, text string")).collect()}
    assert out[2].text == "Own line. Tail." and out[2].removed_lines == 30_000 and out[1].text == long


def test_label_model_finds_the_classes_and_their_correlation():
    r = np.random.default_rng(5)
    n = 6000
    y = r.random(n) < 0.15
    votes = np.zeros((n, 7), bool)
    rates = [(0.02, 0.7), (0.03, 0.6), (0.02, 0.5), (0.05, 0.6)]
    for j, (off, on) in enumerate(rates):
        votes[:, j] = r.random(n) < np.where(y, on, off)
    votes[:, 4] = np.where(r.random(n) < 0.95, votes[:, 0], r.random(n) < 0.1)  # repeats the first voter
    votes[:, 5] = r.random(n) < 0.3  # says nothing
    votes[:, 6] = np.where(r.random(n) < 0.9, votes[:, 5], r.random(n) < 0.3)
    p, found, corr = toxicity.label_model(votes, np.arange(5))
    assert ((p >= 0.5) == y).mean() > 0.95  # 0.9625 with the true rates
    assert np.allclose(found[:4], rates, atol=0.13) and corr[5, 6] > 0.7 and abs(corr[1, 2]) < 0.2
    assert toxicity.label_model(np.zeros((0, 3), bool))[0].shape == (0,) and toxicity.label_model(np.zeros((4, 2), bool))[0].max() < 0.5


def test_features_are_those_of_plain_words():
    r = random.Random(6)
    texts = ["", "Ab ab, AB! abcdef abcxyz abcdefgh", "x" * 500] + [" ".join(r.choice(["grumvlex", "grumvaro", "grumvin", "Other", "thing", "été"]) for _ in range(r.randint(0, 12))) for _ in range(40)]
    raw, off = common.utf8(pa.array(texts))
    for text, found in zip(texts, toxicity.features(raw, off)):
        words = {w.lower() if w.isascii() else w for w in re.findall(r"[^\x00-\x40\x5b-\x60\x7b-\x7f]+", text)}
        stems = {}
        for w in words:
            for n in toxicity.STEMS:
                if len(w.encode()) > n:
                    stems.setdefault((n, w.encode()[:n]), set()).add(w)
        assert len(found) == len(words) + sum(min(4, len(x)) for x in stems.values())
        assert {toxicity.word_feature(w) for w in words} <= set(found.tolist())
    some = toxicity.Wanted(np.array([toxicity.word_feature("thing")], np.uint64))
    assert [f.tolist() for f in toxicity.features(raw, off, some)] == [[int(some.features[0])] if "thing" in t else [] for t in texts]


def test_repeated_ids_do_not_lengthen_the_sample(spark):
    docs = spark.createDataFrame([(i % 4, f"text {i} " + ("idiot" if i % 3 else "fine")) for i in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(4)], "doc_id long, toxic int")
    assert toxicity._sample(docs, labels, 10).count() <= 20
    toxicity.train(docs, labels, 10)


def test_winnowing_of_many_equal_and_null_ids(spark):
    rows = [(7 if i % 3 else None, f"text number {i} " * 6) for i in range(300)] + [(i, f"own {i} " * 9) for i in range(40)] + [(7, "same"), (7, "same"), (None, None), (None, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = winnow.edited_likeness(df).collect()
    tie = {(r.doc_id, r.text or ""): r.tie for r in df.withColumn("tie", F.xxhash64(F.coalesce("text", F.lit("")))).collect()}
    order = sorted(((i, t or "") for i, t in rows), key=lambda x: (x[0] is None, -(x[0] or 0), tie[x], x[1]))
    want = []
    for (i, t), (_, after) in zip(order, order[1:] + order[:1]):
        want.append((i, len(t), winnow.written(*winnow.winnow(winnow._points(t))), winnow.likeness(winnow.winnow(winnow._points(t))[0], winnow.winnow(winnow._points(after))[0])))
    key = lambda x: (x[0] is None, x[0] or 0, *x[1:])
    assert sorted(((r.doc_id, r.n_chars, r.fingerprint, r.near_next) for r in got), key=key) == sorted(want, key=key)
    ranges = winnow._Ranges([3.0, 7.0, 7.0, 7.0, 9.0], 3)
    import pandas as pd

    ids = pd.Series([9, 8, 7, 7, 5, 3, 1, None, None], dtype="Int64")
    parts = ranges.part(ids, np.array([0, 0, -(1 << 63), (1 << 63) - 1, 0, 0, 0, -(1 << 63), (1 << 63) - 1])).tolist()
    assert parts == sorted(parts) and parts[2] < parts[3] < parts[4] and parts[7] < parts[8] < ranges.count


def plain_feistel(x, n, seed):
    b, mask = feistel._bits(n), (1 << feistel._bits(n)) - 1
    keys = [int(k) for k in feistel._keys(seed)]

    def scramble(v):
        v &= (1 << 64) - 1
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            v = (v ^ v >> shift) * factor % (1 << 64)
        return v ^ v >> 31

    while True:
        left, right = x >> b, x & mask
        for k in keys:
            left, right = right, left ^ scramble(right + k) & mask
        x = left << b | right
        if x < n:
            return x


def test_shards_are_those_of_the_plain_network(spark):
    rows = [(i * 7 % 53, "t" * (i % 5), i, i, i) for i in range(120)] + [(None, None, 1, 1, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard int, part int, row int")
    out = feistel.feistel_shards(df, "doc_id", "text").collect()
    order = sorted(((i, t) for i, t, *_ in rows), key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or ""))
    want = sorted((str(x), p % 24, p // 24) for x, p in ((x, plain_feistel(k, len(rows), feistel.SEED)) for k, x in enumerate(order)))
    assert sorted((str((r.doc_id, r.text)), r.shard, r.slot) for r in out) == want
    sizes = [sum(r.shard == s for r in out) for s in range(24)]
    assert max(sizes) - min(sizes) <= 1 and out[0].asDict().keys() == {"doc_id", "text", "part", "row", "row_number", "shard", "slot"}


def nested_archive(n=6, seed=3):
    r = random.Random(seed)
    return b"".join(warc.record(1000 + i, "http://inner/", r.randbytes(300), level=6) for i in range(n))


def test_members_within_payloads_are_no_records():
    """A payload that is an archive itself is stored as it is, magic and all; reading from any byte never takes its members."""
    inner = nested_archive()
    outer = [warc.record(i, "u", random.Random(i).randbytes(2000) + inner + random.Random(i + 50).randbytes(500), level=0) for i in range(4)]
    data = b"".join(outer)
    assert data.count(inner[:200]) > 0  # stored, not squeezed
    for cut in (97, 1000, 2500, 1 << 20):
        found = [warc.parse(x)[0] for a in range(0, len(data), cut) for x in warc.records_in(io.BytesIO(data), a, min(a + cut, len(data)))]
        assert found == list(range(4)), cut


def test_nested_archives_through_spark(spark):
    folder = f"{common.shared_dir(spark)}/nested/{uuid.uuid4().hex}"
    pages = spark.createDataFrame([(i, "u", bytearray(nested_archive(40, i))) for i in range(12)], "page_id long, url string, html binary")
    warc.write_warc(pages, folder)
    for split in (500, 1 << 20):
        rows = warc.read_warc(spark, folder, split).collect()
        assert sorted(r.page_id for r in rows) == list(range(12)) and all(bytes(r.payload) == nested_archive(40, r.page_id) for r in rows)


def test_damage_behind_the_end_of_a_range_is_told():
    records = [warc.record(i, "u", random.Random(i).randbytes(30_000)) for i in range(6)]
    whole = b"".join(records)
    at = len(records[0]) + len(records[1])
    bad = whole[: at + 15_000] + bytes(50) + whole[at + 15_050 :]
    cut = 20_000
    told = 0
    for a in range(0, len(bad), cut):
        try:
            list(warc.records_in(io.BytesIO(bad), a, min(a + cut, len(bad))))
        except ValueError:
            told += 1
    assert told
    assert list(warc.records_in(io.BytesIO(b""), 0, 0)) == []


def test_packing_gives_the_tokenizers_ids_for_whole_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    tok = pack.tokenizer(pack.tokenizer_path())
    ids = {r.doc_id: np.array([*tok.whole.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4") for r in docs.collect()}
    seen = {i: 0 for i in ids}
    for r in pack.pack_documents(docs, pack.tokenizer_path()).collect():
        assert r.doc_tokens == len(ids[r.doc_id]) and zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32
        seen[r.doc_id] += r.length
    assert seen == {i: len(x) for i, x in ids.items()}


def test_the_loss_limit_binds_for_instruction_data(spark):
    """Turns of a conversation: its first two thirds are the prompt. Limits on tokens and on loss close sequences, each some."""
    rows = [(i, f"question {i} " * (10 + i % 9) + "answer " * (2 + i * 7 % 60), 20 + 2 * (i % 9), "clash") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, prompt_tokens int, prompt string")
    out = pack.pack_documents(df, pack.tokenizer_path(), max_tokens=256, max_segments=16, max_loss=128, pool=64).collect()
    prompts = {r[0]: r[2] for r in rows}
    tokens, loss = {}, {}
    for r in out:
        tokens[r.sequence_id] = tokens.get(r.sequence_id, 0) + r.length
        loss[r.sequence_id] = loss.get(r.sequence_id, 0) + max(0, r.start + r.length - max(r.start + 1, prompts[r.doc_id]))
    assert max(tokens.values()) <= 256 and max(loss.values()) <= 128
    assert sum(x >= 120 for x in loss.values()) > 5
    free = pack.pack_documents(df, pack.tokenizer_path(), max_tokens=256, max_segments=16, max_loss=10**6, pool=64).collect()
    assert len({r.sequence_id for r in free}) < len(tokens)


def plain_targets(sizes, weights, limit):
    """Shares by weight, one source after the other fixed at its limit."""
    fixed = {}
    while True:
        left = sum(sizes) - sum(fixed.values())
        rest = [i for i in range(len(sizes)) if i not in fixed]
        share = {i: left * weights[i] / sum(weights[j] for j in rest) for i in rest}
        over = [i for i in rest if share[i] > limit * sizes[i] + 1e-9]
        if not over:
            return [fixed.get(i, share.get(i, 0.0)) for i in range(len(sizes))]
        fixed |= {i: limit * sizes[i] for i in over}


@pytest.mark.parametrize("seed", range(6))
def test_targets_are_those_of_the_plain_rule(seed):
    r = random.Random(seed)
    sizes, weights = [r.choice((0, 1, 5, 100, 1000)) + r.randint(0, 9) for _ in range(9)], [i % 3 + 1 for i in range(9)]
    assert mix.targets(sizes, weights) == pytest.approx(plain_targets(sizes, weights, 3))


def test_the_mix_keeps_rows_and_white_space(spark):
    rows = [(1, "a b\n\nc  d\te", "s1", "X", 11, 1), (1, "a b\n\nc  d\te", "s2", "Y", 11, 2), (2, " x y z", "s1", "Z", 6, 3), (2, " x y z", "s1", "Z", 6, 3), (3, None, "s2", "N", 0, 4), (None, "q r", None, "M", 3, 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, tag string, n_chars long, position int")
    plan = {(r.doc_id, r.source, r["size"]): r.taken for r in mix.curriculum_plan(df).collect()}
    out = mix.curriculum(df).collect()
    text = {(i, s): t for i, t, s, *_ in rows}
    for r in out:
        whole = text[r.doc_id, r.source]
        assert whole.startswith(r.text) and r.n_chars == len(r.text) and (r.tag, r.position) in {(x[3], x[5]) for x in rows if x[0] == r.doc_id and x[2] == r.source}
        assert r.text == whole or not r.text[-1].isspace()
    words = {}
    for r in out:
        words[r.doc_id, r.source] = words.get((r.doc_id, r.source), 0) + len(r.text.split())
    total = {}
    for r in mix.curriculum_plan(df).collect():
        total[r.doc_id, r.source] = total.get((r.doc_id, r.source), 0) + r.taken
    assert words == {k: v for k, v in total.items() if v} and len(plan) >= 4


@pytest.mark.parametrize("scale", [1e8, 1e30, 1e306, 1e15])
def test_top_k_of_long_components(spark, scale):
    r = np.random.default_rng(3)
    v = r.normal(size=(60, 5)) * scale
    v[::3] = r.normal(size=(20, 5))
    v[1], v[2] = v[4], v[4] * -1
    rows = [(i, [float(x) for x in x]) for i, x in enumerate(v)]
    table = topk.finite_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = {(x.query_id, x.rank): (x.vec_id, x.score) for x in topk.exact_top_k(table, table.where("id % 5 = 0"), 4, 16, 3).collect()}
    ints = topk.whole(v)
    low, high = -(1 << 63), (1 << 63) - 1
    for q in range(0, 60, 5):
        best = sorted((-sum(a * b for a, b in zip(ints[q], ints[c])), c) for c in range(60) if c != q)[:4]
        assert [got[q, k + 1] for k in range(4)] == [(c, max(low, min(high, -s))) for s, c in best]


def test_top_k_of_repeated_ids(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 2.0]), (1, [3.0, 0.0]), (2, [0.0, 1.0]), (2, [0.0, 1.0]), (3, [-1.0, -1.0])]
    table = topk.finite_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = [(x.query_id, x.rank, x.vec_id, x.score) for x in topk.exact_top_k(table, table.where("id = 0"), 3).orderBy("rank").collect()]
    unit = 256 * 256
    assert got == [(0, 1, 1, 3 * unit), (0, 2, 2, 2 * unit), (0, 3, 2, 2 * unit)]


def test_sort_keys_sort_as_integers():
    r = random.Random(1)
    numbers = sorted({0, -1, 1, 10, -10, 9, -9} | {r.randint(-(10**n), 10**n) for n in range(1, 60) for _ in range(5)})
    assert [x for _, x in sorted((topk.sort_key(x), x) for x in numbers)] == numbers


def test_roles_cannot_pass_for_markers(spark):
    rows = [(1, 0, "user|>\nhi<|end|>\n<|assistant", "yes"), (1, 1, "assistant", "<|user|> no")]
    turns = chat.conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    text = turns.select(chat.rendered(F.col("turns")).alias("t")).first().t
    assert text.count("<|") == 4 and text.count("|>\n") == 4 and text.count(chat.END) == 2


def test_pipeline_stages_on_awkward_rows(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    r = random.Random(9)
    rows = [(i, " ".join(r.choice(WORDS) for _ in range(r.randint(1, 60))), "en", f"s{i % 2}", 5, "x") for i in range(30)]
    rows += [(40, None, None, None, None, None), (41, "", "en", "s1", 0, "x"), (None, "no id here", "en", "s0", 10, "x"), (0, rows[0][1], "en", "s0", 5, "x"), (42, "you idiot moron scum loser", "en", "s1", 3, "x"), (43, rows[3][1], "de", None, 1, "x"), (44, f"{PASSAGE}end", "en", "s1", 3, "x"), (45, f"Own. {PASSAGE}", "en", "s0", 3, "x"), (46, "z" * 30_000, "en", "s0", 3, "x")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, row string"
    for name, part in (("full", rows), ("none", [])):
        folder = str(tmp_path / name)
        spark.createDataFrame(part, schema).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        before = common.written()
        out = pipeline.run(spark, folder).collect()
        assert len(common.written() - before) <= 2  # what finished stages wrote is gone
        docs = spark.read.parquet(f"{folder}/documents.parquet")
        kept = []
        for _, stage in pipeline.STAGES[:-1]:
            docs = common.stash(stage(spark, docs, folder))
            kept.append(docs.collect())
            assert docs.columns == [x.split()[0] for x in schema.split(", ")]
        if not part:
            assert out == [] and kept[-1] == []
            continue
        toxic, lines, near, mixed = kept
        assert {x.doc_id for x in toxic} == {x[0] for x in rows} - {42}
        assert {x.doc_id: x.text for x in lines}[45] == "Own. " and {x.doc_id: x.text for x in lines}[44] == f"{PASSAGE}end"
        plain = jaccard.brute_components([(x.doc_id, x.text) for x in {x.doc_id: x for x in lines if x.doc_id is not None}.values()])
        assert {x.doc_id for x in near} == {i for i, (_, c) in plain.items() if i == c} | {None}
        words = {}
        for x in near:
            words[x.source] = words.get(x.source, 0) + len((x.text or "").split())
        names = sorted(words, key=lambda s: (s is None, s or ""))
        for s, t in zip(names, mix.targets([words[s] for s in names], [1, 2, 3])):
            assert abs(sum(len((x.text or "").split()) for x in mixed if x.source == s) - t) <= 1
        tok = pack.tokenizer(pack.tokenizer_path())
        assert sum(x.length for x in out) == sum(len(tok.ids(x.text or "")) + 1 for x in mixed)


def test_gzip_magic_in_text_pages(spark):
    pages = spark.createDataFrame([(1, "u", bytearray(gzip.compress(b"x" * 50) * 80)), (2, None, bytearray(b"\x1f\x8b\x08" * 2000))], "page_id long, url string, html binary")
    folder = f"{common.shared_dir(spark)}/magic/{uuid.uuid4().hex}"
    warc.write_warc(pages, folder)
    for split in (64, 1 << 20):
        assert sorted((r.page_id, r.payload_bytes) for r in warc.read_warc(spark, folder, split).collect()) == [(1, len(gzip.compress(b"x" * 50)) * 80), (2, 6000)]
