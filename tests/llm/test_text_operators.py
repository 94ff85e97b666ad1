"""Corpus operators on small tables with nulls, empty and long texts, ties, repeats, and other columns."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shortlister.llm import feistel, jaccard, linedup, mix, pack, toxicity, winnow
from shortlister.llm.common import shingle_sets, utf8

DOCS = "doc_id long, text string, lang string, source string, n_chars long, rep string, h long, key string"
WORDS = [f"w{i}" for i in range(400)]


def corpus():
    r = random.Random(5)
    base = [r.choice(WORDS) for _ in range(120)]
    rows = [(0, " ".join(base)), (1, " ".join(base)), (2, " ".join(base[:60] + ["new"] + base[61:]).upper())]
    rows += [(10 + i, " ".join(base[:k] + [f"x{i}"] + base[k + 1 :])) for i, k in enumerate(range(3, 110, 9))]
    rows += [(40 + i, " ".join(r.choice(WORDS) for _ in range(r.randint(1, 90)))) for i in range(20)]
    rows += [(70, None), (71, ""), (72, " \n\t "), (73, "one two"), (74, "one  two"), (75, "a b c d e"), (76, "A B C D E"), (77, "é É"), (78, "z" * 5000), (79, " ".join(base * 60))]
    return [(i, t, "en", f"s{i % 3}" if i % 7 else None, len(t or ""), "clash", 1, "k") for i, t in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS)


def brute_links(rows):
    sets = {i: x for (i, _), x in zip(rows, (set(s.tolist()) for s in shingle_sets(*utf8(__import__("pyarrow").array([t or "" for _, t in rows]))))) if x}
    reps = {}
    for i in sorted(sets):
        reps.setdefault(frozenset(sets[i]), i)
    ids = sorted(reps.values())
    return {(x, y) for i, x in enumerate(ids) for y in ids[i + 1 :] if 100 * len(sets[x] & sets[y]) >= 75 * len(sets[x] | sets[y])}


def test_links_are_all_pairs(spark, docs, monkeypatch):
    r = random.Random(6)
    base = [r.choice(WORDS) for _ in range(150)]
    rows = [(i, " ".join(base[:k] + [f"y{i}"] + base[k + 1 :])) for i, k in enumerate(r.sample(range(5, 145), 60))]
    for block in (7, 256):
        monkeypatch.setattr(jaccard, "PAIR_BLOCK", block)
        for df, plain in ((docs, [x[:2] for x in corpus()]), (spark.createDataFrame(rows, "doc_id long, text string"), rows)):
            found = [tuple(x) for x in jaccard.shingle_links(df).select(F.least("a", "b"), F.greatest("a", "b")).collect()]
            assert len(found) == len(set(found)) and set(found) == brute_links(plain)
    assert len(brute_links(rows)) > 1000
    assert jaccard.shingle_links(docs.limit(0)).collect() == []


def test_shingle_sets_are_those_of_plain_words():
    texts = ["A b\x0bc d e f", "", "x", "x y z", "a  b\n c d e f", "é É é É é É", " b c"]
    raw, off = utf8(__import__("pyarrow").array(texts))
    sizes = [len(s) for s in shingle_sets(raw, off)]
    assert sizes == [2, 0, 1, 1, 2, 2, 1]
    low, high = (shingle_sets(*utf8(__import__("pyarrow").array([t])))[0] for t in ("Some Words Of Text Here now", "some words of text here NOW"))
    assert low.tolist() == high.tolist()


def test_jaccard_components(spark, docs):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.shingle_components(docs).collect()}
    assert got == jaccard.brute_components([(r[0], r[1]) for r in corpus()])
    assert got[70] == (0, 70) and got[73][1] == got[74][1] == 73


def test_jaccard_repeated_null_and_empty(spark, docs):
    more = docs.union(docs.where("doc_id = 0")).union(spark.createDataFrame([(None, "a b c d e", "en", "s", 1, "c", 1, "k")], DOCS))
    rows = jaccard.shingle_components(more).collect()
    assert len(rows) == len(corpus()) + 2 and sum(r.doc_id == 0 for r in rows) == 2
    assert [r.component_id for r in rows if r.doc_id is None] in ([None], [75])
    assert jaccard.shingle_components(docs.limit(0)).collect() == []
    kept = {r.doc_id for r in jaccard.one_of_each(docs).collect()}
    assert kept == {i for i, (_, c) in jaccard.brute_components([(r[0], r[1]) for r in corpus()]).items() if i == c}


def test_large_near_copy_group_stays_whole(spark):
    r = random.Random(1)
    base = [r.choice(WORDS) for _ in range(100)]
    rows = []
    for i in range(150):
        t = list(base)
        for k in r.sample(range(100), r.randint(0, 4)):
            t[k] = f"e{i}x{k}"
        rows.append((i, " ".join(t)))
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard.shingle_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == jaccard.brute_components(rows)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 6), max_size=25), st.lists(st.integers(0, 6), max_size=25))
def test_patience_aligns_equal_items_in_order(a, b):
    pairs = linedup.patience(a, b)
    assert all(a[i] == b[j] for i, j in pairs)
    assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(pairs, pairs[1:]))
    assert linedup.patience(a, a) == [(i, i) for i in range(len(a))]


def test_line_dedup(spark):
    passage = "This passage has a good many words in it so that it surely counts as an anchor line of its own for all later documents.\nAnd it goes on with one more line of words."
    rows = [(1, f"First own line.\n{passage}\nTail one."), (2, f"Something else here.\n{passage}\nTail two."), (3, "Clean text.\nAll rights reserved."), (4, "Other text.\nAll rights reserved."), (5, None), (6, ""), (None, passage), (7, passage)]
    df = spark.createDataFrame([(i, t, "x", 3) for i, t in rows], "doc_id long, text string, places string, n_chars long")
    out = {r.doc_id: r for r in linedup.without_repeats(df).collect()}
    assert out[1].text == rows[0][1] and out[1].removed_lines == 0
    assert out[2].text == "Something else here.\nTail two." and out[2].n_chars == len(out[2].text)
    assert out[3].text == rows[2][1] and out[4].text == rows[3][1] and out[5].text is None and out[6].text == ""
    assert out[7].text == "" and out[None].text == passage and out[2].places == "x"
    assert linedup.without_repeats(df.limit(0)).collect() == []


def sentence(r, words):
    return " ".join(r.choice(WORDS) for _ in range(words)).capitalize() + ". "


def test_line_dedup_of_a_frequent_passage_of_short_sentences(spark):
    r = random.Random(8)
    passage = "".join(sentence(r, 11) for _ in range(5))
    rows = [(i, sentence(r, 12) + passage + sentence(r, 9)) for i in range(40)]
    out = {x.doc_id: x for x in linedup.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[0].text == rows[0][1]
    assert all(out[i].text == t.replace(passage, "") and out[i].removed_lines == 5 for i, t in rows[1:])


def test_line_dedup_of_a_block_of_short_lines(spark):
    r = random.Random(9)
    block = "".join(sentence(r, 3) for _ in range(9))
    rows = [(1, sentence(r, 9) + block + sentence(r, 9)), (2, sentence(r, 5) + block + sentence(r, 6)), (3, block[: block.index(". ") + 2] + sentence(r, 30))]
    out = {x.doc_id: x for x in linedup.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[1].text == rows[0][1] and out[2].text == rows[1][1].replace(block, "") and out[3].text == rows[2][1]


def plain_line_dedup(texts, words=20):
    """Id to what is left of the text: every document aligned with every earlier one."""
    split = {i: re.split(r"(?<=\n)|(?<=[.!?] )", t) for i, t in texts.items()}
    key = {i: [x.strip().lower() for x in ls] for i, ls in split.items()}
    gone = {i: set() for i in texts}
    for i in texts:
        for j in texts:
            if j < i:
                for _, at, n in linedup.blocks(key[j], key[i]):
                    if sum(len(x.split()) for x in split[i][at : at + n]) >= words:
                        gone[i].update(range(at, at + n))
    return {i: "".join(x for k, x in enumerate(ls) if k not in gone[i]) for i, ls in split.items()}


def test_line_dedup_is_that_of_all_pairs(spark):
    r = random.Random(10)
    shared = [[sentence(r, r.randint(2, 14)) for _ in range(r.randint(1, 8))] for _ in range(8)]
    texts = {}
    for i in range(60):
        parts = [[sentence(r, r.randint(1, 15))] + (b[r.randint(0, 1) :] if r.random() < 0.5 else [sentence(r, 9)]) for b in shared]
        texts[i] = "".join(x for p in parts for x in p)
    want = plain_line_dedup(texts)
    got = {x.doc_id: x.text for x in linedup.without_repeats(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got == want and sum(want[i] != texts[i] for i in texts) > 30


def test_numpy_lines_are_those_of_the_split(spark):
    texts = ["a\n", "", "x. y! z?\n\nq.", "\n\n", " . a. b", "ab. \ncd", "é. ü! ", "...  a"]
    raw, off = utf8(__import__("pyarrow").array(texts))
    starts, ends, first = linedup._spans(raw, off, True)
    want = [r[0] for r in spark.createDataFrame(list(enumerate(texts)), "i int, t string").orderBy("i").select(linedup.lines(F.col("t"))).collect()]
    assert [[bytes(raw[a:b]).decode() for a, b in zip(starts[i:j], ends[i:j])] for i, j in zip(first, first[1:])] == want


def test_toxicity_learns_from_the_open_folds_only(spark):
    r = random.Random(2)
    rows, labels = [], []
    for i in range(600):
        words = [r.choice(WORDS) for _ in range(40)]
        bad = i % 6 == 0
        if bad:
            words[r.randrange(40)] = r.choice(["idiot", "scum", "loser", "Stupid."])
            words[r.randrange(40)] = r.choice(["grumvlex", "grumvaro", "grumvin"])
        rows.append((i, " ".join(words), "en"))
        labels.append((i, 1, int(bad)))
    rows += [(900, None, "en"), (901, "", "en"), (902, "you grumvoid thing", "en"), (903, "a b " * 20000, "en"), (0, rows[0][1], "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic_score string").drop("toxic_score")
    table = spark.createDataFrame(labels + [(5, 1, None), (6, 1, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, table)
    assert model.correlations.shape == (len(model.voters),) * 2 and (model.rates[:4, 1] > model.rates[:4, 0]).all()
    out = {r.doc_id: r for r in toxicity.scored(docs, model).collect()}
    fold = [i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0]
    right = sum((out[i].toxic_score >= 0.5) == (i % 6 == 0) for i in fold)
    assert right / len(fold) > 0.97
    assert out[900].toxic_score == out[901].toxic_score < 0.5 and out[902].toxic_score > 0.5 and out[903].toxic_score < 0.5
    flipped = table.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = toxicity.train(docs, flipped)
    assert np.array_equal(model.weights, again.weights)
    none = toxicity.train(docs, table.limit(0))
    assert {r.doc_id: r.toxic_score for r in toxicity.scored(docs, none).collect()}[0] > 0.5
    assert toxicity.keep_clean(docs.limit(0), table).collect() == []


@settings(max_examples=40, deadline=None)
@given(st.text(alphabet="abé ", max_size=160))
def test_winnowing_is_that_of_the_definition(text):
    h, p = winnow.winnow(winnow._points(text), 4, 6)
    assert p.tolist() == winnow.brute_winnow(text, 4, 6)


def test_winnowing_guarantee_and_ties():
    shared = "".join(random.Random(3).choice("abcdefgh") for _ in range(winnow.GRAM + winnow.WINDOW))
    a, b = (winnow.winnow(winnow._points(x + shared + y))[0] for x, y in (("12" * 40, "zz"), ("yy" * 9, "34" * 50)))
    assert set(a.tolist()) & set(b.tolist())
    same = winnow.winnow(winnow._points("a" * 200), 4, 6)[1]
    assert same.tolist() == list(range(5, 197))  # rightmost of equal ones


def test_short_texts_keep_a_likeness_to_their_edits():
    r = random.Random(12)
    text = lambda n: np.array([r.randrange(97, 123) for _ in range(n)], np.uint32)
    for n in [*range(40, 160, 3), 640, 2000]:
        own, other = text(n), text(n)
        edited = np.concatenate((own[: n - n // 3], other[: n // 3]))
        assert 0 < winnow.likeness(winnow.winnow(own)[0], winnow.winnow(edited)[0]) < 1
        narrow, wide = winnow.winnow(own)[1].tolist(), winnow.winnow(own, w=winnow.WINDOW)[1].tolist()
        assert set(wide) <= set(narrow) and (n < 640 or wide == narrow)


def test_edited_likeness(spark):
    rows = [(3, "abcdefghi" * 30, "x"), (1, "0123456789" * 30, "x"), (2, None, "x"), (7, "", "x"), (5, "éa" * 100, "x"), (9, "short", "x")]
    out = {r.doc_id: r for r in winnow.edited_likeness(spark.createDataFrame(rows, "doc_id long, text string, part string")).collect()}
    texts = {i: t or "" for i, t, _ in rows}
    ids = sorted(texts, reverse=True)
    for i, nxt in zip(ids, ids[1:] + ids[:1]):
        t, m = texts[i], len(texts[i]) // 3
        edited = t[: len(t) - m] + texts[nxt][:m]
        assert out[i].n_chars == len(t) and out[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        own, other, after = (winnow.winnow(winnow._points(x)) for x in (t, edited, texts[nxt]))
        assert out[i].fingerprint == winnow.written(*own) and out[i].edited_fingerprint == winnow.written(*other)
        assert out[i].near_edited == winnow.likeness(own[0], other[0]) and out[i].near_next == winnow.likeness(own[0], after[0])
    one = winnow.edited_likeness(spark.createDataFrame([(1, "abcdef")], "doc_id long, text string")).collect()
    assert len(one) == 1 and one[0].edited_sha256 == hashlib.sha256(b"abcdab").hexdigest()
    assert winnow.edited_likeness(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    many = [(i // 2, f"text number {i}" * 5) for i in range(60)] + [(None, "none"), (4, "text number 8" * 5)]
    assert len(winnow.edited_likeness(spark.createDataFrame(many, "doc_id long, text string")).collect()) == 62


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 3000), st.integers(0, 1 << 30))
def test_feistel_is_a_permutation_with_an_inverse(n, seed):
    p = feistel.permute(np.arange(n), n, seed)
    assert sorted(p.tolist()) == list(range(n)) and feistel.row_at(p, n, seed).tolist() == list(range(n))


def test_shards(spark, docs):
    rows = docs.union(docs.where("doc_id < 2")).select("doc_id", F.length(F.coalesce("text", F.lit(""))).alias("size"), F.lit(0).alias("shard_"))
    out = feistel.feistel_shards(rows, "doc_id", "size").collect()
    n = len(out)
    assert sorted(r.row_number for r in out) == list(range(n))
    position = feistel.permute([r.row_number for r in out], n)
    assert [(r.shard, r.slot) for r in out] == [(p % 24, p // 24) for p in position.tolist()]
    again = feistel.feistel_shards(rows.repartition(3), "doc_id", "size").collect()
    key = lambda rs: sorted((r.doc_id, r.size, r.shard, r.slot) for r in rs)
    assert key(out) == key(again)
    assert feistel.feistel_shards(rows.limit(0), "doc_id", "size").collect() == []


def test_targets():
    assert mix.targets([100, 100, 100], [1, 2, 3]) == pytest.approx([50, 100, 150])
    assert mix.targets([10, 100, 100], [5, 1, 1]) == pytest.approx([30, 90, 90])
    assert mix.targets([0, 10], [1, 1]) == pytest.approx([0, 10]) and mix.targets([0, 0], [1, 1]) == [0, 0]


def test_mix(spark, docs):
    rows = docs.union(docs.where("doc_id = 45"))
    plan = mix.curriculum_plan(rows).collect()
    assert len(plan) == rows.count()
    by: dict = {}
    for r in plan:
        by.setdefault(r.source, []).append(r)
        assert 0 <= r.taken <= 3 * r.size and all(0 <= p <= 1 for p in r.positions)
    names = sorted(by, key=lambda s: (s is None, s or ""))
    want = mix.targets([sum(r.size for r in by[s]) for s in names], [i % 3 + 1 for i in range(len(names))])
    for s, t in zip(names, want):
        assert by[s][0].target == pytest.approx(t) and abs(sum(r.taken for r in by[s]) - t) <= 1
    mixed = mix.curriculum(rows)
    assert mixed.columns == rows.columns
    got = mixed.select(mix.word_count(F.col("text")).alias("n")).agg(F.sum("n")).first()[0]
    assert got == sum(r.taken for r in plan)
    assert sorted(map(tuple, mix.curriculum_plan(rows.repartition(3)).select("doc_id", "taken").collect())) == sorted((r.doc_id, r.taken) for r in plan)
    assert mix.curriculum(docs.limit(0)).collect() == [] and mix.curriculum(docs.where("doc_id in (70, 71)")).collect() == []


def test_positions_follow_the_schedule(spark):
    df = spark.createDataFrame([(i, "w " * 10, "ab"[i % 2]) for i in range(400)], "doc_id long, text string, source string")
    p = mix.curriculum_plan(df, weight=lambda i: 1, slope=lambda i: (-1.0, 1.0)[i]).collect()
    early = {s: sum(x < 0.5 for r in p if r.source == s for x in r.positions) / 200 for s in "ab"}
    assert early["a"] == pytest.approx(0.75, abs=0.02) and early["b"] == pytest.approx(0.25, abs=0.02)


def test_word_tokenizer_gives_the_tokenizers_ids():
    tok = pack.WordTokenizer(pack.tokenizer_path())
    texts = ["Hello, World! don't WE'LL 12 ab12", "a\x1cb<|endoftext|>c", "ΑΣ ΟΔΟΣ İstanbul é é ", "x　y ...!?  z", "̀abc", "ﬁ ǅ ẞ ß", "👍🏽 नमस्ते 한국어", "", " ", "z" * 3000]
    for t, ids in zip(texts, tok.batch(texts)):
        assert ids.tolist() == tok.whole.encode(t, add_special_tokens=False).ids, t


@pytest.mark.parametrize("limits", [(2048, 128, 2047), (64, 4, 63), (50, 3, 20)])
def test_packing(spark, docs, limits):
    tok = pack.tokenizer(pack.tokenizer_path())
    rows = docs.withColumn("prompt_tokens", F.lit(3)) if limits[0] == 50 else docs
    out = pack.pack_documents(rows, pack.tokenizer_path(), 1, *limits, pool=8).collect()
    ids = {i: np.append(tok.ids(t or ""), np.uint32(1)) for i, t, *_ in corpus()}
    by_doc, by_seq = {}, {}
    for r in out:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert r.length > 0 and len(part) == r.length and r.doc_tokens == len(ids[r.doc_id]) and zlib.crc32(part.astype("<u4").tobytes()) == r.ids_crc32
        by_doc.setdefault(r.doc_id, []).append((r.start, r.length))
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length, r.start))
    assert by_doc.keys() == ids.keys()
    for i, parts in by_doc.items():
        at = 0
        for start, length in sorted(parts):
            assert start == at
            at += length
        assert at == len(ids[i])
    prompt = 3 if limits[0] == 50 else 0
    for parts in by_seq.values():
        at = 0
        for offset, length, _ in sorted(parts):
            assert offset == at
            at += length
        assert at <= limits[0] and len(parts) <= limits[1]
        assert sum(max(0, s + n - max(s + 1, prompt)) for _, n, s in parts) <= limits[2]
    assert pack.pack_documents(docs.limit(0), pack.tokenizer_path()).collect() == []
