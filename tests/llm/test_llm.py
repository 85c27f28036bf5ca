"""Each operator on small tables: nulls, empty and long texts, ties, repeated rows, clashing columns, empty tables, and brute force."""

import base64
import functools
import gzip
import hashlib
import random
import re
import time
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from taxloom.llm import chat, chroma, forest, packing, quality, queries, shards, warc
from taxloom.llm.components import components
from taxloom.llm.families import posterior_floors
from taxloom.llm.line_dedup import drop_repeated_lines, repeated_lines
from taxloom.llm.ngram_join import drop_near_copies, ngram_join
from taxloom.llm.pieces import Encoder, encode_pieces, piece_digests

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, node long, root long, key string"


def words(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(n))


def docs(spark, texts, ids=None):
    rows = [(i, t, "en", f"s{k % 3}", len(t or ""), 1, 1, "x") for k, (i, t) in enumerate(zip(ids or range(len(texts)), texts, strict=True))]
    return spark.createDataFrame(rows, DOCS)


ODD = [None, "", "one", words(1, 60), words(1, 60), words(1, 60) + " end", " ".join([words(2, 40)] * 500), "a\nb\n\n" + words(3, 30), "\n", words(3, 30)]


@pytest.fixture
def odd(spark):
    return docs(spark, ODD, [0, 1, 2, 3, 4, 5, 6, 7, 8, None])


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (9, 8), (5, 5), (None, 1), (10, 4)], "a long, b long")
    assert {r.node: r.root for r in components(edges).collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 10: 1, 8: 8, 9: 8}
    assert components(edges.limit(0)).count() == 0
    chain = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert components(chain.repartition(7)).select("root").distinct().count() == 1


def test_components_over_tasks(spark, monkeypatch):
    """Edges of several tasks, hubs among them, meet in star steps."""
    from taxloom.llm import components as module
    from taxloom.llm import scratch

    monkeypatch.setattr(module, "EDGES", 60)
    r = random.Random(3)
    edges = [(r.randrange(1000), r.randrange(1000)) for _ in range(380)] + [(5000, 6000 + i) for i in range(60)] + [(6030, 5)]
    monkeypatch.setattr(scratch.hub_join, "__defaults__", (None, 8, 100_000))
    label = {x: x for e in edges for x in e if e[0] != e[1]}
    for _ in range(1000):
        before = dict(label)
        for a, b in edges:
            if a != b:
                label[a] = label[b] = min(label[a], label[b])
        if label == before:
            break
    got = components(spark.createDataFrame(edges, "a long, b long").repartition(9))
    assert {x.node: x.root for x in got.collect()} == label


def test_ngram_join_against_brute_force(spark):
    texts = [words(i // 3, 80).split() for i in range(60)]
    r = random.Random(5)
    for t in texts:
        for _ in range(r.randint(0, 6)):
            t[r.randrange(len(t))] = "zz"
    texts = [" ".join(t) for t in texts]
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (re.findall(r"\w+", t.lower()) for t in texts)]
    distinct = {t: s for t, s in zip(texts, sets, strict=True)}
    want = {t: sum(u != t and len(s & v) >= 0.8 * len(s | v) for u, v in distinct.items()) for t, s in distinct.items()}
    got = {r.doc_id: r.n_links for r in ngram_join(docs(spark, texts)).collect()}
    assert got == {i: want[t] for i, t in enumerate(texts)}


def test_ngram_join_odd(spark, odd):
    got = {r.doc_id: (r.class_id, r.n_links, r.n_copies) for r in ngram_join(odd).collect()}
    assert len(got) == 10
    assert got[3] == got[4] == (3, 1, 2) and got[5] == (3, 1, 1) and got[0] == got[1] == (0, 0, 2) and got[2] == (2, 0, 1)
    kept = drop_near_copies(odd)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} == {0, 2, 3, 6, 7, 8, None}
    assert drop_near_copies(odd.limit(0)).count() == 0
    twice = docs(spark, [words(4, 30)] * 2, [7, 7])
    assert drop_near_copies(twice).count() == 1


def test_large_family_spans_blocks(spark):
    base = words(9, 100).split()
    texts = [" ".join([*base, f"tail{i}"]) for i in range(700)]
    got = ngram_join(docs(spark, texts)).agg(F.count_distinct("class_id").alias("c"), F.min("n_links").alias("lo"), F.max("n_links").alias("hi")).first()
    assert (got.c, got.lo, got.hi) == (1, 699, 699)


def test_posterior_floors():
    floors = dict(posterior_floors(0.8, 1e-5, 64, 16))
    assert list(floors) == [16, 32, 48, 64] and all(0 < m < 0.8 * n for n, m in floors.items())


def test_line_dedup(spark, odd):
    long = "the quick brown fox jumps over the lazy dog and runs away home"
    df = docs(spark, [f"{long}\nshort\n{words(5, 20)}", f"{words(6, 20)}\nshort\n{long}!", f"{long}\n{long}", None, "", long.upper()])
    lost = {r.doc_id: r.dropped for r in repeated_lines(df).collect()}
    assert lost == {1: [1, 2], 2: [0, 1]}
    out = {r.doc_id: r for r in drop_repeated_lines(df).collect()}
    assert set(out) == {0, 1, 3, 4, 5} and out[1].text == words(6, 20) and out[1].n_chars == len(out[1].text) and out[3].text is None
    assert drop_repeated_lines(odd).columns == odd.columns
    assert drop_repeated_lines(odd.limit(0)).count() == 0


def brute_lines(texts):
    """Numbers of the lines that each (doc_id, text) loses, by comparing all pairs of different lines."""
    at = {}
    for doc in sorted(set(texts), key=lambda d: (d[0], d[2])):
        for i, x in enumerate(doc[1].split("\n")):
            if x.strip(" \t\r"):
                at.setdefault(x.strip(" \t\r"), []).append((doc[0], doc[2], i))
    lines = list(at)
    sets = [{x[i : i + 8] for i in range(max(1, len(x) - 7))} for x in lines]
    label = list(range(len(lines)))
    for a in range(len(lines)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                old, new = label[a], label[b]
                label = [new if y == old else y for y in label]
    lost = {}
    for k in set(label):
        places = sorted(p for x, y in zip(lines, label, strict=True) if y == k for p in at[x])
        for doc, h, i in places[1:]:
            lost.setdefault((doc, h), []).append(i)
    return {k: sorted(v) for k, v in lost.items()}


def test_line_dedup_against_brute_force(spark):
    r = random.Random(8)
    lines = [words(100 + i, r.randint(1, 12)) for i in range(40)] + ["}", "}", "a b", "total: 12", "total: 13"]
    texts = []
    for d in range(60):
        own = [r.choice(lines) for _ in range(r.randint(1, 6))]
        own = [x if r.random() < 0.5 else x[: r.randrange(len(x) + 1)] + r.choice("xyz ") + x[r.randrange(len(x)) :] if r.random() < 0.3 else x + " " + r.choice("pq") for x in own]
        texts.append((d % 50, "\n".join(own)))  # ten doc_ids stand twice, with different texts
    df = spark.createDataFrame([*texts, texts[3]], "doc_id long, text string")
    hashes = {(x.doc_id, x.text): x.h for x in df.select("*", F.xxhash64("text").alias("h")).collect()}
    got = {(x.doc_id, x.text_hash): x.dropped for x in repeated_lines(df).collect()}
    assert got == brute_lines([(*t, hashes[t]) for t in texts])


def test_repeated_ids_lose_nothing(spark):
    line, other = words(1, 12), words(2, 12)
    df = spark.createDataFrame([(1, line), (7, f"{line}\n{words(3, 9)}"), (7, f"{words(4, 9)}\n{other}")], "doc_id long, text string")
    assert sorted(x.text for x in drop_repeated_lines(df).collect()) == sorted([line, words(3, 9), f"{words(4, 9)}\n{other}"])
    unlike = docs(spark, [words(5, 30), words(6, 30), words(7, 30)], [7, 7, 9])
    assert drop_near_copies(unlike).count() == 3
    one_like = docs(spark, [words(5, 30), words(6, 30), words(6, 30) + " end"], [7, 7, 9])
    assert {x.text for x in drop_near_copies(one_like).collect()} == {words(5, 30), words(6, 30)}
    same = docs(spark, [words(6, 30)] * 3, [7, 7, 9]).withColumn("source", F.expr("string(monotonically_increasing_id())"))
    assert [x.doc_id for x in drop_near_copies(same).collect()] == [7]


def test_families_of_several_blocks(spark):
    """A chain of texts, each near the next only, and a family that its first text connects, in blocks of 4."""
    from taxloom.llm import families, shingles

    base = words(11, 400).split()
    chain = [" ".join(base[i * 6 : i * 6 + 100]) for i in range(40)]
    star = [" ".join([*words(12, 100).split(), f"tail{i}"]) for i in range(30)]
    df = docs(spark, chain + star).select(F.xxhash64("text").alias("node"), "text", "doc_id")
    shingle = lambda t: shingles.word_shingles(t, 5)
    sigs = df.select("node", "text").mapInArrow(shingles.signer(shingle, 64), "node long, sig binary")
    floors = posterior_floors(0.8, 1e-5, 64, 16)
    parts = {}
    for counting in (True, False):
        got = families.classes(df.select("node", "text"), sigs, shingle, 64, 4, floors, 0.8, block=4, counting=counting).join(df, "node").collect()
        parts[counting] = sorted(sorted(x.doc_id for x in got if x.root == root) for root in {x.root for x in got})
    assert parts[True] == parts[False] == [list(range(40)), list(range(40, 70))]


def test_word_shingles():
    from taxloom.llm import shingles

    r = random.Random(1)
    for size in (1, 3):
        texts = ["".join(r.choice("abcÀé ß_9\n\tİ.-🙂中𠀀ab  x") for _ in range(r.randrange(60))) for _ in range(200)]
        values, at = shingles.word_shingles(texts, size)
        for i, text in enumerate(texts):
            w = re.findall(r"\w+", text.lower())
            assert len(set(values[at[i] : at[i + 1]].tolist())) == (len({tuple(w[j : j + size]) for j in range(max(1, len(w) - size + 1))}) if w else 0)
    long = ["x" * 300_000 + " " + words(1, 50_000)]
    assert len(shingles.word_shingles(long, 5)[0]) == 50_001 - 4


def test_quality(spark, odd):
    d, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = quality.quality_scores(d, labels).join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in got]) >= 0.95
    assert quality.quality_scores(odd, labels).count() == 10 and all(0 <= r.score <= 1 for r in quality.quality_scores(odd, labels.limit(0)).collect())
    assert quality.keep_good(odd, labels.limit(0)).count() == 10 and quality.quality_scores(odd.limit(0), labels).count() == 0


def brute_quality(texts, labelled):
    """Scores of the texts by a discriminant worked out with inverses and determinants; labelled: (text, label)."""
    x, y = quality.statistics([t for t, _ in labelled]), np.array([k for _, k in labelled])
    each = [x[y == k] for k in (0, 1)]
    pooled = sum(np.cov(e.T, bias=True) * len(e) for e in each) / len(x)
    log = []
    for e in each:
        s = 0.9 * np.cov(e.T, bias=True) + 0.1 * pooled
        s = 0.95 * s + 0.05 * np.diag(np.diag(s)) + 1e-4 * np.eye(len(s))
        d = quality.statistics(texts) - e.mean(0)
        log.append(np.log(len(e) / len(x)) - 0.5 * np.linalg.slogdet(s)[1] - 0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(s), d))
    return 1 / (1 + np.exp(np.clip(log[0] - log[1], -700, 700)))


def known_labels(rows, labels):
    """(text, label) of each of rows (doc_id, text) that is learned from."""
    label = {x.doc_id: x.quality for x in labels.collect() if zlib.crc32(str(x.doc_id).encode()) % 4 != 2}
    return [(text, label[i]) for i, text in rows if i in label]


def test_quality_against_brute_force(spark):
    d, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    rows = d.collect()
    rows = [*rows, *rows[:3]]
    repeated = spark.createDataFrame(rows, d.schema).withColumn("score", F.lit("clash"))
    got = sorted((x.doc_id, round(x.score, 6), x.held_out, x.predicted) for x in quality.quality_scores(repeated, labels).collect())
    want = brute_quality([x.text for x in rows], known_labels([(x.doc_id, x.text) for x in rows], labels))
    assert got == sorted((x.doc_id, round(float(w), 6), zlib.crc32(str(x.doc_id).encode()) % 4 == 2, int(w >= 0.7)) for x, w in zip(rows, want, strict=True))


def test_packing(spark, odd):
    r = random.Random(1)
    lengths = sorted((r.randint(1, 90) for _ in range(300)), reverse=True)
    sources, clusters = [r.choice("abcdefgh") for _ in lengths], [r.randrange(40) for _ in lengths]
    bins: list[list] = []
    for n, s, c in zip(lengths, sources, clusters, strict=True):  # plain best fit: among all that fit, the fullest, then the oldest
        fits = [(100 - sum(x[0] for x in b), i) for i, b in enumerate(bins) if sum(x[0] for x in b) + n <= 100 and all(x[1] != s and x[2] != c for x in b)]
        i = min(fits)[1] if fits else len(bins)
        bins[i:] = bins[i:] or [[]]
        bins[i].append((n, s, c))
    assert sorted(map(sorted, bins)) == sorted(sorted((n, s, c) for n, s, c, b in zip(lengths, sources, clusters, packing.best_fit(lengths, sources, clusters, 100), strict=True) if b == k) for k in range(len(bins)))
    got = packing.pack(odd, capacity=100).collect()
    for i, t in enumerate(ODD[:9]):
        own = sorted((x.start, x.length) for x in got if x.doc_id == i)
        assert sum(n for _, n in own) == len(t or "") and own[0][0] == 0
    fill = {}
    for x in got:
        if x.bin_id is not None:
            fill[x.bin_id] = fill.get(x.bin_id, 0) + x.length
    assert max(fill.values()) <= 100 and packing.pack(odd.limit(0)).count() == 0


def test_packing_near_copies(spark, tmp_path):
    base = words(1, 80)
    texts = [base, base + " one", base + " two", base, words(2, 30), words(3, 30)]
    docs(spark, texts, [1, 2, None, 3, 4, 4]).withColumn("source", F.expr("uuid()")).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.QUERIES["op7_packing"](spark, str(tmp_path)).collect()
    family = [x.bin_id for x in got if x.doc_id in (None, 1, 2, 3)]
    assert len(got) == 6 and len(family) == len(set(family)) == 4


def test_pieces(spark, odd):
    P = pytest.importorskip("public_tokenizers")
    path = P.path("piece_bpe_32k.model")
    e, r = Encoder(path, most=50), random.Random(2)
    for _ in range(3000):
        t = "".join(r.choice("aàbe tht ionéß\n\t  ▁<>/0x1A中文🙂ñ§._-=") for _ in range(r.randrange(50)))
        assert e.encode(t) == e.model.encode(t)
    for t in (" " * 500, "a" * 3000, "=" * 777, "\n" * 50, "the " * 999):
        assert e.encode(t) == e.model.encode(t)
    got = piece_digests(odd, path).collect()
    for x in got[:9]:
        ids = e.model.encode(ODD[x.doc_id] or "")
        assert (x.n_tokens, x.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
    assert [x.decoded for x in encode_pieces(odd, path).collect()] == [t or "" for t in ODD]
    assert piece_digests(odd.limit(0), path).count() == 0


def test_chat(spark):
    hard = ["### User: </turn>", "\\h \\b \\t", "", "####", "</turn", ": ", "<chat escaped>\n", "a### b"]
    rows = [(1, i, r, t, "x") for i, (r, t) in enumerate(zip(["user", "assistant", None, "a: b", "assistant", "system", "user", "### x"], hard, strict=True))]
    rows += [(2, 0, "user", "\\bx plain", "x"), (2, 0, "user", "\\bx plain", "x"), (None, 1, "user", None, "x"), (3, None, "assistant", "é🙂" * 9000, "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, turns string")
    out = {r.conv_id: r for r in chat.with_loss_spans(chat.format_chats(df)).collect()}
    assert [(t.role, t.text) for t in out[1].turns] == [(r or "", t) for r, t in zip(["user", "assistant", None, "a: b", "assistant", "system", "user", "### x"], hard, strict=True)]
    assert out[1].formatted.startswith("<chat escaped>") and out[2].formatted.startswith("<chat raw>") and len(out[2].turns) == 2
    for r in out.values():
        for s in r.spans:
            assert r.formatted[s.at + s.size :].startswith("</turn>")
    d = {r.conv_id: r for r in chat.chat_digests(chat.format_chats(df)).collect()}
    assert d[3].loss_chars == 18000 and d[1].loss_sha256 == hashlib.sha256("\\h \\b \\t</turn".encode()).hexdigest()
    assert chat.format_chats(df.limit(0)).count() == 0
    assert "Python" not in chat.chat_digests(chat.format_chats(df))._jdf.queryExecution().toString()


def test_warc(spark):
    rows = [(1, "http://B.example.com/x?q=1", "same"), (2, "http://a.example.com/", "same"), (3, None, None), (4, "https://www.a.example.com:80/z y", ""), (5, "http://a.example.com/", "é" * 100_000), (5, "http://a.example.com/", "other"), (None, "x", "lone")]
    found = sorted(warc.archive_index(spark.createDataFrame(rows, "page_id long, url string, html string"), chunk_bytes=1, file_chunks=2).collect(), key=lambda r: r.position)
    assert [r.position for r in found] == list(range(7)) and [r.url_key for r in found] == sorted(r.url_key for r in found)
    got = {(r.page_id, r.url_key): r for r in found}
    one, two = got[1, "com,example,b)/x?q=1"], got[2, "com,example,a)/"]
    assert (one.record_type, one.refers_to, one.payload_bytes) == ("revisit", 2, 4) and (two.record_type, two.refers_to) == ("response", None)
    assert got[3, ""].record_type == "revisit" and got[3, ""].refers_to == 4
    assert warc.archive_index(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_warc_against_brute_force(spark):
    r = random.Random(4)
    pages = [(p.page_id, p.url, p.html) for p in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    pages += [(10_000 + i, r.choice([None, "http://u:p@h.example:8080/a#b", "h.example:80/x", "//[::1]:9/q?"]), r.choice([None, "", "same", "other"])) for i in range(60)]
    payloads = {}
    for page_id, _, html in pages:
        payloads.setdefault(html or "", []).append(page_id)
    want = {}
    for page_id, _, html in pages:
        data, last = (html or "").encode(), max(payloads[html or ""])
        want[page_id] = (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if page_id == last else "revisit", None if page_id == last else last)
    df = spark.createDataFrame([(*p, "x", 1) for p in pages], "page_id long, url string, html string, sha1 string, position int")
    got = warc.archive_index(df, chunk_bytes=20_000, file_chunks=3).collect()
    assert {x.page_id: (x.payload_bytes, x.payload_digest, x.record_type, x.refers_to) for x in got} == want and len(got) == len(pages)
    order = sorted(got, key=lambda x: x.position)
    assert [x.position for x in order] == list(range(len(pages))) and [(x.url_key, x.captured, x.page_id) for x in order] == sorted((x.url_key, x.captured, x.page_id) for x in order)


@pytest.mark.parametrize(("url", "key"), [("http://www.a.b.com:80/x?Y#z", "com,b,a)/x?y"), ("example.com:80/x", "com,example)/x"), ("https://u:p@h.org", "org,h)/"), ("//h.org/p", "org,h)/p"), ("http://[::1]:9/q", "[::1])/q"), (None, ""), ("", "")])
def test_url_key(url, key):
    assert warc.url_key(url) == key


def test_archives_are_read_in_linear_time():
    head = "WARC/1.0\r\nWARC-Type: response\r\nContent-Length: {}\r\n\r\n"
    body = b"HTTP/1.1 200 OK\r\nContent-Length: 40\r\n\r\n" + b"x" * 40
    record = gzip.compress(head.format(len(body)).encode() + body + b"\r\n\r\n")
    began = time.process_time()
    found = list(warc._parsed(record * 40_000))
    assert time.process_time() - began < 10 and len(found) == 40_000
    assert [f[:2] for f in found[:3]] == [(i * len(record), len(record)) for i in range(3)] and found[-1][4] == b"x" * 40
    long = b"HTTP/1.1 200 OK\r\n\r\n" + random.Random(1).randbytes(200_000)
    large = gzip.compress(head.format(len(long)).encode() + long + b"\r\n\r\n")
    assert [len(f[4]) for f in warc._parsed(large + record + large)] == [200_000, 40, 200_000]


def test_pair_tables_are_bounded():
    import public_tokenizers

    model = public_tokenizers.path("piece_bpe_32k.model")
    small, free = Encoder(model, most=4, most_pairs=50), Encoder(model)
    for i in range(40):
        text = words(i, 30)
        assert small.encode(text) == free.encode(text) == free.model.encode(text)
        assert small.pairs <= 50 and sum(len(t) - 1 for t in small.filled) == small.pairs


def test_warc_members():
    record = b"WARC/1.1\r\nContent-Length: 40000004\r\n\r\n" + b"\r\n\r\n" + bytes(40_000_000) + b"\r\n\r\n"
    data = warc._members(record)
    assert data[-1] == 0 and len(next(warc._parsed(data * 1))[4]) == 40_000_000


def test_loser_tree():
    r = random.Random(3)
    for k in range(0, 9):
        runs = [sorted(r.randrange(50) for _ in range(r.randrange(20))) for _ in range(k)]
        assert list(warc.LoserTree([iter(x) for x in runs], lambda x: x)) == sorted(x for run in runs for x in run)


def test_shards(spark, odd):
    d = docs(spark, [words(i % 1000, 30) for i in range(3000)])
    got = shards.kd_shards(d, shards=7).collect()
    size, groups, slots = {}, {}, {}
    for r in got:
        size[r.shard] = size.get(r.shard, 0) + r.size
        groups.setdefault(r.text_crc32, set()).add(r.shard)
        slots.setdefault(r.shard, []).append(r.slot)
    assert len(size) == 7 and max(size.values()) < 1.15 * min(size.values())
    assert all(len(s) == 1 for s in groups.values()) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sorted(r.size for r in shards.kd_shards(odd).collect()) == sorted(len((t or "").encode()) + 8 for t in ODD)
    assert shards.kd_shards(odd.limit(0)).count() == 0
    copies = docs(spark, [words(1, 30)] * 480)
    assert {r["count"] for r in shards.kd_shards(copies, shards=24).groupBy("shard").count().collect()} <= set(range(15, 26))


def test_shards_against_brute_force(spark):
    """Sizes, checksums, whole groups and slots of a real table with repeats, by plain Python; bytes as near equal as the largest group allows."""
    rows = [(x.doc_id, x.text, x.lang, x.source) for x in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows += [(None, None, None, None), (7, "", None, "s"), *rows[:2]]
    got = shards.kd_shards(spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, lang string, source string, h string, node int"), shards=5).collect()
    raw = [(r[0], (r[1] or "").encode()) for r in rows]
    assert sorted((x.doc_id or -1, x.size, x.text_crc32) for x in got) == sorted((i or -1, len(t) + 8, zlib.crc32(t)) for i, t in raw)
    held, slots, size, groups = {}, {}, [0] * 5, {}
    for x in got:
        held.setdefault((x.size, x.text_crc32), set()).add(x.shard)
        groups[x.size, x.text_crc32] = groups.get((x.size, x.text_crc32), 0) + x.size
        slots.setdefault(x.shard, []).append(x.slot)
        size[x.shard] += x.size
    assert all(len(s) == 1 for s in held.values()) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(size) - min(size) <= 2 * max(groups.values()) and {x.law for x in got} == {"bytes"} and {x.grown_shard for x in got} == {None}


def test_shards_keep_groups(spark):
    texts = [words(i, 30) for i in range(600)] + [words(1000, 30)] * 40 + [words(1001, 30)] * 70 + [words(1002, 500)] * 2 + [words(1003, 30)] * 300
    got = shards.kd_shards(docs(spark, texts), shards=8).collect()
    size, held = {}, {}
    for r in got:
        size[r.shard] = size.get(r.shard, 0) + r.size
        held.setdefault(r.doc_id, r.shard)
    assert all(len({held[i] for i in range(a, b)}) == 1 for a, b in ((600, 640), (640, 710), (710, 712))) and len(got) == len(texts)
    assert len({held[i] for i in range(712, 1012)}) > 1 and len(size) == 8 and max(size.values()) < 1.1 * min(size.values())  # no shard holds the last group


def test_forest(spark):
    r = np.random.default_rng(1)
    rows = [(i, r.standard_normal(16).tolist(), "x") for i in range(500)]
    rows += [(500, None, "x"), (501, [0.0] * 16, "x"), (502, [float("nan")] * 16, "x"), (503, [None] * 16, "x"), (504, [1.0], "x"), (505, rows[7][1], "x"), (506, rows[7][1], "x"), (None, rows[1][1], "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank string")
    got = forest.nearest(df, F.col("vec_id") % 20 == 0, k=5, row_block=200, query_block=10).collect()
    x = np.array([row[1] for row in rows[:500]] + [rows[7][1]] * 2)
    ids = np.array([*range(500), 505, 506])
    hits = 0
    for q in range(0, 500, 20):
        score = x @ x[q]
        score[q] = -np.inf
        want = ids[np.lexsort((ids, -score))[:5]]
        hits += len({g.vec_id for g in got if g.query_id == q} & set(want.tolist()))
    assert hits >= 0.9 * 125 and len(got) == 125
    few = forest.nearest(df.where("vec_id < 4"), F.col("vec_id") == 0, k=20).collect()
    assert {g.vec_id for g in few} == {1, 2, 3} and forest.nearest(df.limit(0), F.lit(True)).count() == 0


def test_chroma(spark):
    r, rate = np.random.default_rng(4), 11_025

    def tune(seed, seconds):
        notes = np.random.default_rng(seed).choice(220 * 2 ** (np.arange(24) / 12), int(seconds * 4))
        return np.concatenate([np.sin(2 * np.pi * f * np.arange(rate // 4) / rate) for f in notes])

    one = tune(1, 12)
    noisy = one + 0.02 * r.standard_normal(len(one))
    late = np.concatenate([tune(3, 3), one])
    pcm = lambda s: bytearray((np.clip(s, -1, 1) * 120 + 128).astype(np.uint8).tobytes())
    media = spark.createDataFrame([(0, pcm(one)), (1, pcm(one)), (2, pcm(noisy)), (3, pcm(late)), (4, pcm(tune(8, 12))), (5, None), (6, bytearray(b"x")), (None, pcm(one))], "media_id long, audio binary")
    got = {x.media_id: x for x in chroma.aligned(chroma.fingerprints(media), F.col("media_id").isin(0, 5), most_error=0.2).collect()}
    assert got[0].n_same == 1 and {b.media_id for b in got[0].best} == {2, 3} and got[5].n_aligned == 0
    shift = next(b for b in got[0].best if b.media_id == 3)
    assert abs(shift.offset * 1024 / rate - 3) < 0.2
    assert chroma.aligned(chroma.fingerprints(media.limit(0)), F.lit(True)).count() == 0


def test_chroma_align_against_brute_force(monkeypatch):
    r = np.random.default_rng(0)

    def brute(q, x, least_votes, most_error):
        votes = {}
        for i, a in enumerate(q):
            for j, b in enumerate(x):
                if a == b:
                    votes[j - i] = votes.get(j - i, 0) + 1
        best = min(votes, key=lambda d: (-votes[d], d), default=None)
        if best is None or votes[best] < least_votes:
            return None
        a, b = max(0, -best), min(len(q), len(x) - best)
        error = sum(int(q[k] ^ x[k + best]).bit_count() for k in range(a, b)) / (32 * (b - a))
        return (best, votes[best], round(error, 9)) if error <= most_error else None

    def some():
        if r.random() < 0.7:  # with runs
            return np.repeat(r.integers(0, 4, 6).astype(np.uint32) * np.uint32(0x11111111), r.integers(0, 5, 6))
        return r.integers(0, 3, r.integers(0, 12)).astype(np.uint32)

    for _ in range(60):
        monkeypatch.setattr(chroma, "VOTES", int(r.choice([1, 7, 1 << 18])))
        monkeypatch.setattr(chroma, "BATCH", int(r.choice([1, 20, 1 << 18])))
        monkeypatch.setattr(chroma, "SHORT", int(r.choice([1, 2, 8])))
        queries, rows, least, most = [some() for _ in range(6)], [some() for _ in range(8)], int(r.integers(1, 4)), float(r.choice([0.02, 0.1, 1]))
        got = {}
        for piece in chroma.align(chroma.Recordings([x.tobytes() for x in queries]), chroma.Recordings([x.tobytes() for x in rows]), least, most):
            for i, j, offset, votes, error in zip(*(x.tolist() for x in piece), strict=True):
                got[i, j] = (offset, votes, round(error, 9))
        assert got == {(i, j): w for i, q in enumerate(queries) for j, x in enumerate(rows) if (w := brute(q, x, least, most))}


def test_chroma_items_depend_on_the_audio_alone():
    audios = [bytes(np.random.default_rng(i).integers(0, 256, n, np.uint8)) for i, n in enumerate((5000, 300, 90, 0, 64, 9000, 300))]
    whole = chroma.fingerprint([*audios, None], 2756, 64)
    assert [len(x) for x in whole] == [max(0, (max(64, len(a or b"")) - 64) // 16 + 2 - chroma.SPAN) for a in [*audios, None]]
    for a, x in zip(audios, whole, strict=False):
        assert (chroma.fingerprint([a], 2756, 64)[0] == x).all()


def test_chroma_silence(spark):
    """Long silence is one run: its items aren't met in pairs."""
    rows = [(i, bytearray([128]) * (60 * 11_025 + i)) for i in range(12)] + [(20, bytearray(b"x" * 30_000)), (21, None), (None, bytearray([128]) * 60_000)]
    media = spark.createDataFrame([(*r, 1, "x") for r in rows], "media_id long, audio binary, recording int, items string").select("media_id", "audio")
    got = {x.media_id: x for x in chroma.aligned(chroma.fingerprints(media), F.col("media_id") == 0).collect()}
    same = got[0].n_same  # one frame more or less makes another recording
    assert list(got) == [0] and got[0].n_aligned + same >= 1 and all(b.bit_error == 0 and b.offset <= 0 for b in got[0].best)


def test_chroma_short(spark, tmp_path):
    texts = [words(1, 60)[:200], words(1, 60)[:200], words(2, 60)[:300], words(2, 60)[:300] + " end", "ab", "ab", "", None, "cd"]
    docs(spark, texts, [0, 1, 50, 51, 100, 101, 150, 151, 200]).write.parquet(f"{tmp_path}/documents.parquet")
    got = {x.doc_id: x for x in queries.QUERIES["op1_chroma"](spark, str(tmp_path)).where("doc_id is not null").collect()}
    assert {i: got[i].n_same for i in (0, 50, 100, 150, 200)} == {0: 1, 50: 0, 100: 1, 150: 1, 200: 0}
    assert {i: got[i].n_aligned for i in (0, 50, 100, 150, 200)} == {0: 0, 50: 1, 100: 0, 150: 0, 200: 0} and got[0].n_items > 1 and got[100].n_items == 0


def test_chroma_pairs(spark, tmp_path):
    base = words(1, 120)
    texts = [base, base, *[base + " " + words(100 + i, 10) for i in range(30)], words(2, 120)]
    docs(spark, texts, [0, *range(51, 83)]).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.QUERIES["op1_chroma"](spark, str(tmp_path)).collect()
    kind = {x.doc_id: x.recording for x in got if x.doc_id is not None}
    pairs = [x for x in got if x.doc_id is None]
    assert len(kind) == 33 and kind[0] == kind[51] and {x.recording for x in pairs} == {kind[0]}
    assert sorted(x.partner for x in pairs) == sorted({kind[i] for i in range(52, 82)}) and len(pairs) > 20
    assert next(x.n_aligned for x in got if x.doc_id == 0) == len(pairs) and all(x.offset == 0 and x.votes > 1 and x.bit_error <= 0.15 for x in pairs)


def test_chroma_blocks_are_not_shuffled(spark, tmp_path, monkeypatch):
    """Many blocks find what one does, and items are shuffled once however many there are."""
    base = [words(i, 400) for i in range(40)]
    texts = [*base, *[t + " " + words(100 + i, 20) for i, t in enumerate(base)], base[0], "ab", None]
    docs(spark, texts, [*range(0, 2000, 50), *range(1, 44)]).write.parquet(f"{tmp_path}/documents.parquet")
    context = spark._jsc.sc()

    def run(**parameters):
        def shuffled():
            context.listenerBus().waitUntilEmpty(30_000)
            return context.statusStore().executorList(True).apply(0).totalShuffleWrite()

        monkeypatch.setattr(queries, "alignments", functools.partial(chroma.alignments, **parameters))
        before = shuffled()
        rows = queries.QUERIES["op1_chroma"](spark, str(tmp_path)).collect()
        return sorted(map(tuple, rows), key=repr), shuffled() - before, sum(4 * x.n_items for x in rows if x.doc_id is not None), sum(x.doc_id is None for x in rows)

    (one, _, items, pairs), (many, shuffled, *_) = run(), run(row_items=4_000, query_items=2_000)
    assert one == many and len(one) == 83 + pairs and pairs >= 40
    assert shuffled < 1.5 * items


def test_chroma_items_are_kept_compressed(spark):
    media = spark.createDataFrame([(i, bytearray(words(i, 400).encode())) for i in range(40)], "media_id long, audio binary")
    recordings = chroma.catalogue(chroma.fingerprints(media, rate=2_756, frame=64), F.lit(True))[1]
    assert {pq.ParquetFile(f.removeprefix("file://")).metadata.row_group(0).column(0).compression for f in recordings.inputFiles()} == {"ZSTD"}


def test_pipeline_against_brute_force(spark, tmp_path):
    """Each stage on what the one before kept, odd and repeated rows included."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    d, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    rows = [x for x in d.collect() if len(x.text or "") < 4000]
    made = [x.asDict() for x in rows[:70]]
    lines = [x["text"].split("\n")[0] for x in made if x["text"]]
    made += [{**made[0]}, {**made[1], "text": made[2]["text"]}, {**made[3], "doc_id": 9001, "text": None}, {**made[3], "doc_id": 9002, "text": ""}, {**made[4], "doc_id": None}, {**made[5], "doc_id": 9003, "text": f"{lines[6]}\n{lines[7]}!\n{words(77, 60)}"}, {**made[5], "doc_id": 9004, "text": words(77, 60) + " more"}]
    docs = spark.createDataFrame([tuple(x[c] for c in d.columns) for x in made], d.schema)
    sf = str(tmp_path)
    labels.write.parquet(f"{sf}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    row = lambda x: (x["doc_id"], x["text"])
    some = lambda df: sorted((row(x) for x in df.collect()), key=repr)

    kept = stages["quality"](spark, docs, sf)
    scores = brute_quality([x["text"] for x in made], known_labels([row(x) for x in made], labels))
    assert some(kept) == sorted((row(x) for x, s in zip(made, scores, strict=True) if s >= 0.5), key=repr) and kept.count() < len(made)

    lined = stages["lines"](spark, kept, sf)
    hashed = kept.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()
    lost = brute_lines([(x.doc_id, x.text, x.h) for x in hashed if x.text and x.doc_id is not None])
    want = []
    for x in hashed:
        gone = lost.get((x.doc_id, x.h))
        text = "\n".join(t for i, t in enumerate(x.text.split("\n")) if i not in gone) if gone else x.text
        if not gone or text.strip():
            want.append((x.doc_id, text))
    assert some(lined) == sorted(want, key=repr) and lost

    once = stages["near_copies"](spark, lined, sf)
    known = sorted({(x.doc_id, x.text or "", x.h) for x in lined.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect() if x.doc_id is not None}, key=lambda x: (x[0], x[2]))
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else None for w in (re.findall(r"\w+", t.lower()) for _, t, _ in known)]
    label = list(range(len(known)))
    for a in range(len(known)):
        for b in range(a):
            if known[a][1] == known[b][1] or (sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])):
                label = [label[b] if y == label[a] else y for y in label]
    first = {k: known[min(i for i, y in enumerate(label) if y == k)] for k in set(label)}
    assert sorted((x.doc_id, x.text or "") for x in once.where("doc_id is not null").collect()) == sorted(x[:2] for x in first.values())
    assert once.where("doc_id is null").count() == lined.where("doc_id is null").count()

    packed = stages["packing"](spark, once, sf).collect()
    chars, bins = {}, {}
    for x in packed:
        chars[x.doc_id] = chars.get(x.doc_id, 0) + x.length
        if x.bin_id is not None:
            bins.setdefault(x.bin_id, []).append(x)
    source = {x.doc_id: x.source for x in once.collect()}
    assert sum(chars.values()) == sum(len(x.text or "") for x in once.collect())
    assert all(sum(x.length for x in b) <= 8192 and len({source[x.doc_id] for x in b}) == len(b) for b in bins.values())
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, sf)
    assert empty.count() == 0


def test_pipeline(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    got = corpus_pipeline.run(spark, SF)
    assert got.count() > 0 and [n for n, _ in corpus_pipeline.STAGES] == ["quality", "lines", "near_copies", "packing"]
