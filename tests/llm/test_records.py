"""WARC, top-k and chat operators, the registry and the pipeline."""

import gzip
import hashlib
import io
import random
import uuid

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from shortlister.llm import chat, registry, topk, warc
from shortlister.llm.common import shared_dir
from shortlister.llm.graph import connected_components


def test_components(spark):
    r = random.Random(4)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, i) for i in range(2001, 2100)] + [(7, 7)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        p, q = sorted((find(a), find(b)))
        root[q] = p
    got = {x.node: x.label for x in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root if any(x in e and e[0] != e[1] for e in edges)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def pages():
    big, other = "<p>é" + "x" * 1500, "y" * 3000
    rows = [(1, "http://a/1", big), (2, "http://a/2\n", big), (3, None, big), (4, "u", "small"), (5, "u", "small"), (6, "u", None), (7, "u", ""), (8, "u", other), (8, "u", other), (9, "u", "\x1f\x8b\x08WARC/1.1" * 200), (None, "u", big), (10, "u", "z" * 300_000)]
    return [(*r, "extra") for r in rows]


def test_warc_round_trip(spark):
    df = spark.createDataFrame(pages(), "page_id long, url string, html string, kept string")
    folder = f"{shared_dir(spark)}/warc-test/{uuid.uuid4().hex}"
    written = warc.write_warc(df, folder).collect()
    assert sum(w.records for w in written) == len(pages())
    for split in (64, 1000, 1 << 22):
        got = warc.read_warc(spark, folder, split).collect()
        assert len(got) == len(pages())
        for r in got:
            html = next((h or "").encode() for i, _, h, _ in pages() if i == r.page_id)
            assert r.payload_bytes == len(html) and r.payload_digest == hashlib.sha1(html).hexdigest()
            assert r.payload is None if r.record_type == "revisit" else bytes(r.payload) == html
        kinds = {r.page_id: (r.record_type, r.refers_to) for r in got}
        assert kinds[3] == ("response", None) and kinds[1] == kinds[2] == kinds[None] == ("revisit", 3)
        assert kinds[4] == kinds[5] == kinds[8] == ("response", None)
    assert warc.write_warc(df.limit(0), f"{folder}-none").collect() == []


def test_ranges_own_each_record_once():
    data = b"".join(warc.record(i, "u", bytes(random.Random(i).randrange(256) for _ in range(i * 37))) for i in range(40))
    assert gzip.decompress(data).count(b"WARC/1.1") == 40
    for cut in (1, 7, 100, 5000):
        found = [warc.parse(x)[0] for a in range(0, len(data), cut) for x in warc.records_in(io.BytesIO(data), a, min(a + cut, len(data)))]
        assert found == list(range(40))
    with pytest.raises(ValueError):
        head = gzip.decompress(warc.record(1, "u", b"abc"))
        warc.parse(head.replace(b"abc", b"abd"))


def member(kind, block, *head):
    return gzip.compress("\r\n".join(["WARC/1.0", f"WARC-Type: {kind}", *head, f"Content-Length: {len(block)}"]).encode() + b"\r\n\r\n" + block + b"\r\n\r\n")


def test_archives_of_other_writers():
    sha1 = lambda x: hashlib.sha1(x).hexdigest()
    http = b"HTTP/1.1 200 OK\r\n\r\n"
    data = member("warcinfo", b"software: x\r\n") + member("request", b"GET / HTTP/1.1\r\n\r\n", "WARC-Target-URI: http://a/") + member("response", http + b"page", "warc-target-uri:http://a/", "WARC-Payload-Digest: sha256:00") + member("response", b"plain") + member("metadata", b"") + member("revisit", http)
    rows = [warc.parse(x) for x in warc.records_in(io.BytesIO(data), 0, len(data))]
    assert [r[2] for r in rows] == ["warcinfo", "request", "response", "response", "metadata", "revisit"]
    assert rows[2] == (None, "http://a/", "response", None, 4, sha1(b"page"), b"page") and rows[3][6] == b"plain"
    assert rows[0][4:] == (13, sha1(b"software: x\r\n"), b"software: x\r\n") and rows[5][4:] == (None, None, None)


def test_damaged_members_are_not_skipped():
    data = warc.record(1, "u", random.Random(1).randbytes(20_000))
    for bad in (data[:-4], data[:3000], data[:9000] + bytes(200) + data[9200:], data[:-8] + bytes(8)):
        with pytest.raises(ValueError):
            list(warc.records_in(io.BytesIO(bad), 0, len(bad)))
    small = warc.record(2, "u", b"abc")
    with pytest.raises(ValueError):
        list(warc.records_in(io.BytesIO(small[:-8] + bytes(8)), 0, len(small)))
    other = b"\x1f\x8b\x08 no member" + gzip.compress(b"x" * 99) + small
    assert [warc.parse(x)[0] for x in warc.records_in(io.BytesIO(other), 0, len(other))] == [2]


@pytest.mark.parametrize("seed", range(4))
def test_top_k_is_exact(spark, seed):
    r = np.random.default_rng(seed)
    v = r.normal(size=(90, 12)) * (1 if seed % 2 else 0.01)
    v[10:25] = v[10]
    rows = [(i, [float(x) for x in x], "c") for i, x in enumerate(v)]
    rows += [(200, None, "c"), (201, [1.0, None], "c"), (202, [float("nan")] * 12, "c"), (203, [float("inf")] * 12, "c"), (204, [], "c"), (None, [1.0] * 12, "c"), (205, [1.0, 2.0], "c"), (210, [1.0, 3.0], "c")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, block string")
    vectors = topk.finite_vectors(df)
    got = {(x.query_id, x.rank): (x.vec_id, x.score) for x in topk.exact_top_k(vectors, vectors.where("id % 5 = 0"), 5, 32, 4).collect()}
    ints = {i: np.floor(256 * np.array(x)).astype(int) for i, x, _ in rows if i is not None and x and all(y is not None and np.isfinite(y) for y in x)}
    want = {}
    for q in ints:
        if q % 5 == 0:
            best = sorted((-int(ints[q] @ ints[c]), c) for c in ints if c != q and len(ints[c]) == len(ints[q]))[:5]
            want |= {(q, k + 1): (c, -s) for k, (s, c) in enumerate(best)}
    assert got == want
    assert topk.exact_top_k(vectors.limit(0), vectors.limit(0)).collect() == []


def turns():
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "hello <|end|> there"), (1, 2, "user", "bye"), (2, 0, "user", "hi"), (2, 1, "assistant", "hello"), (3, 0, None, None), (3, 0, None, None), (4, None, "system", "é"), (4, 1, "assistant", ""), (None, 0, "user", "lost"), (5, 0, "user", "x" * 50_000), (5, 1, "assistant", "y")]
    return [(*r, "extra") for r in rows]


def test_preference_format(spark):
    df = spark.createDataFrame(turns(), "conv_id long, turn long, role string, text string, prompt string")
    c = {r.conv_id: r.turns for r in chat.conversations(df).collect()}
    assert [tuple(t) for t in c[3]] == [("unknown", "")] and [t.role for t in c[4]] == ["system", "assistant"] and None not in c
    pairs = spark.createDataFrame([("p", [("user", "hi"), ("assistant", "yes")], [("user", "hi"), ("assistant", "no"), ("user", "ok")]), ("same", [("user", "a")], [("user", "a")]), ("none", None, [("assistant", "b")])], "id string, chosen array<struct<role:string,text:string>>, rejected array<struct<role:string,text:string>>")
    out = {r.id: r for r in chat.preference_format(pairs).collect()}
    assert out["p"].common_turns == 1 and out["p"].prompt == "<|user|>\nhi<|end|>\n"
    assert out["p"].chosen_completion == "<|assistant|>\nyes<|end|>\n" and out["p"].chosen_loss == f"14-{len(out['p'].chosen_completion)}"
    a, b = map(int, out["p"].rejected_loss.split("-"))
    assert out["p"].rejected_completion[a:b] == "no<|end|>\n"
    assert out["same"].common_turns == 1 and out["same"].chosen_completion == out["same"].rejected_loss == ""
    assert out["none"].common_turns == 0 and out["none"].chosen_completion == "" and out["none"].rejected_completion.endswith("b<|end|>\n")
    got = {r.conv_id: r for r in chat.preference_format(chat.neighbour_pairs(df)).collect()}
    assert got.keys() == {1, 2, 3, 4, 5} and got[1].common_turns == 2 and "< |end|>" in got[1].prompt
    assert chat.preference_format(chat.neighbour_pairs(df.limit(0))).collect() == []


def test_chat_runs_no_python(spark):
    df = spark.createDataFrame(turns(), "conv_id long, turn long, role string, text string, prompt string")
    plan = chat.preference_format(chat.neighbour_pairs(df))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_against_sql(spark, name):
    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "conversations"):
        con.execute(f"create view {t} as select * from '{d}/{t}.parquet'")
    df = registry.queries()[name](spark, d)
    cols = sorted(df.columns)
    want = con.sql(registry.oracle_sql()[name]).fetchall()
    names = [x[0] for x in con.sql(registry.oracle_sql()[name]).description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    order = lambda rows: sorted(rows, key=str)
    assert order([tuple(r[c] for c in cols) for r in df.collect()]) == order([tuple(r[i] for i in at) for r in want])


def test_pipeline(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    names = docs.columns
    for i, (_, stage) in enumerate(pipeline.STAGES):
        docs = stage(spark, docs, d)
        if i < len(pipeline.STAGES) - 1:
            assert docs.columns == names
    out = docs.agg(F.count("*"), F.sum("length")).first()
    assert out[0] > 100 and out[1] > 10_000
