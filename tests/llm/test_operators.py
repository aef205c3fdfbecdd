"""Corpus operators against brute force, round trips and edge cases."""

import gzip
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from kindred.llm import html_extract as H
from kindred.llm import language_id as L
from kindred.llm import line_dedup as D
from kindred.llm import minhash as M
from kindred.llm import mixing as X
from kindred.llm import packing as K
from kindred.llm import pii as P
from kindred.llm import quality_rules as Q
from kindred.llm import vector_search as V
from kindred.llm import warc as W
from kindred.llm.common import min_label_components

from .brute import DOCS, SPANS, WORD, brute_components, brute_kept, corpus, greedy, prose, repeat_words, sure


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS).repartition(5).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def test_quality_statistics(docs, none):
    for r in Q.statistics(docs).join(docs.dropDuplicates(["doc_id"]).select("doc_id", "text"), "doc_id").collect():
        t = r.text or ""
        w = WORD.findall(t)
        lines = [x for x in t.split("\n") if WORD.search(x)]
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), repeat_words(w))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, r.doc_id
    out = Q.quality_rules(docs, docs.sparkSession.createDataFrame([], "doc_id long, quality int"))
    assert out.count() == docs.count() and out.filter("kept AND base_failed").count() == 0
    assert Q.quality_rules(none, docs.sparkSession.createDataFrame([], "doc_id long, quality int")).count() == 0


def test_decision_list_learns():
    rng = random.Random(1)
    rows = []
    for i in range(600):
        low = i % 5 == 0
        f = {n: rng.random() for n in Q.FEATURES}
        f["symbol_ratio"] = rng.uniform(0.5, 1) if low else rng.uniform(0, 0.3)
        rows.append((i, *[f[n] for n in Q.FEATURES], low))
    rules = Q.learn(rows).rules
    assert rules and rules[0].terms[0][0] == "symbol_ratio" and 0.3 <= rules[0].terms[0][2] <= 0.5
    assert Q.learn([]).rules == () == Q.learn([r for r in rows if r[-1]]).rules


def test_cross_parsing(docs, none, spark):
    refs = {"aa": "the cat sat on the mat and the dog sat", "bb": "der hund und die katze sind im haus der"}
    p = L.Parser(refs, 61)
    texts = ["the dog and the cat", "die katze und der hund", "xyz qqq the"]
    got, sizes, _ = p.phrases(texts)
    assert [[greedy(t, refs[k]) for t in texts] for k in p.langs] == got.tolist()
    assert sizes.tolist() == [len(t) for t in texts]
    assert p.predict([None, "", "123 !!", *texts[:2]])[0] == ["und", "und", "und", "aa", "bb"]
    out = L.identify(docs, refs).collect()
    assert len(out) == docs.count() and all(0 <= r.score <= 1 for r in out)
    assert {r.lang_pred for r in out if not r.text or not r.text.strip()} == {"und"}
    assert L.identify(none, {}).count() == 0 and L.reference_texts(none) == {}


@pytest.mark.parametrize("block", [1024, 4])
def test_near_duplicates(docs, none, block):
    sets, label = brute_components(corpus(), 85)
    out = M.near_duplicates(docs, M.NearParams(percent=85, block=block)).collect()
    assert len(out) == docs.count()
    for r in out:
        if r.doc_id is not None:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), label[r.doc_id], label[r.doc_id] == r.doc_id), r
    assert M.near_duplicates(none).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 30)] + [(50, 40), (41, 50), (60, 60)]
    got = {r.node: r.label for r in min_label_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(31)}, 40: 40, 41: 40, 50: 40}


def test_components_long_path(spark):
    """Paths of shuffled ids, alone and with links to the three nearest: no bound on the rounds, one label each."""
    rng = random.Random(5)
    ids = rng.sample(range(10000), 3000)
    edges = list(zip(ids, ids[1:]))
    chain = rng.sample(range(20000, 30000), 1500)
    edges += [(x, y) for d in (1, 2, 3) for x, y in zip(chain, chain[d:])]
    got = {r.node: r.label for r in min_label_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(ids, min(ids)), **dict.fromkeys(chain, min(chain))}


def test_top_k(spark):
    rng = np.random.RandomState(0)
    rows = [(i, [float(x) for x in rng.randn(6)]) for i in range(300)]
    rows += [(300 + i, rows[0][1]) for i in range(40)] + [(900, None), (901, [float("nan")] * 6), (902, [1.0, None] + [0.0] * 4), (903, [1.0, 2.0]), (904, []), (None, [0.0] * 6), rows[7]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = [tuple(r) for r in V.top_k(df, df.filter("vec_id % 20 = 0"), V.SearchParams(shard_rows=64, block_queries=5, leaf=8)).orderBy("query_id", "rank").collect()]
    ints = {i: np.floor(1024 * np.array(v, np.float32).astype(float)).astype(int) for i, v in rows if i is not None and i < 400}
    want = []
    for q in sorted(ints):
        if q % 20 == 0:
            best = sorted((-int(ints[q] @ v), i) for i, v in ints.items() if i != q)[:10]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert got == want
    empty = df.limit(0)
    assert V.top_k(empty, empty).count() == 0


def test_warc_round_trip_and_salvage(spark, tmp_path):
    pages = [(1, "http://a/x", "<p>é</p>", "z"), (2, "http://a/y", "<p>é</p>", "z"), (3, None, None, "z"), (4, "http://b", "", "z"), (5, "u", "WARC/1.1\r\n\r\n\r\n" * 3, "z"), (5, "u", "WARC/1.1\r\n\r\n\r\n" * 3, "z"), (6, "u", "x" * 70000, None)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, payload string")
    got = {r.page_id: r for r in W.round_trip(df, str(tmp_path / "w")).collect()}
    assert W.round_trip(df).count() == len(pages)
    for i, _, h, _ in pages:
        d = hashlib.sha1((h or "").encode()).digest()
        assert (got[i].payload_bytes, got[i].payload_digest) == (len((h or "").encode()), __import__("base64").b32encode(d).decode())
    assert {i: (got[i].record_type, got[i].refers_to) for i in (1, 2, 3, 4)} == {1: ("revisit", 2), 2: ("response", None), 3: ("revisit", 4), 4: ("response", None)}
    assert W.round_trip(df.limit(0)).count() == 0
    # whole, then damaged archives
    texts = [r.value for r in W.classified(df.limit(4)).orderBy("page_id").select(W.record().alias("value")).collect()]
    recs = [(t + W.END).encode() for t in texts]
    kinds = lambda data: [(k, lo, hi) for k, _, _, lo, hi in W.salvage(data)]
    data = b"".join(recs)
    assert [k for k, *_ in kinds(data)] == ["record"] * 4
    bad = recs[0] + recs[1].replace(b"Content-Length", b"Content-Lungth") + recs[2] + recs[3]
    assert [k for k, *_ in kinds(bad)] == ["record", "gap", "record", "record"]
    a = len(recs[0])
    assert kinds(bad)[1] == ("gap", a, a + len(recs[1]))
    members = [gzip.compress(r) for r in recs]
    broken = bytearray(members[1])
    broken[len(broken) // 2] ^= 0xFF
    zipped = members[0] + bytes(broken) + members[2] + members[3]
    got = [(k, h and h["warc-record-id"]) for k, h, *_ in W.salvage(zipped)]
    ids = [i for k, i in got if k == "record"]
    assert "gap" in [k for k, _ in got] and [f"<urn:page:{i}>" for i in (1, 3, 4)] == [i for i in ids if i != "<urn:page:2>"]
    assert kinds(b"") == [] and kinds(b"junk") == [("gap", 0, 4)] and kinds(data[:-9])[-1][0] == "gap"


def test_line_dedup(spark, docs, none):
    rng = random.Random(8)
    passage = [prose(rng, 14) + "." for _ in range(4)]
    own = lambda: prose(rng, 11) + "."
    rows = []
    for i in range(12):
        lines = [own(), own()] + (passage if i % 2 else []) + [own()]
        rows.append((i, "\n".join(lines) if i % 4 < 2 else " ".join(lines), None, None, 3, 7, "r"))
    rows.append((99, "Of.\nOf.\nOf.", None, None, 3, 7, "r"))
    got = {r.doc_id: r for r in D.dedup_lines(spark.createDataFrame(rows, DOCS)).collect()}
    for i, t, *_ in rows[:-1]:
        has = all(p in got[i].text for p in passage)
        assert has == (i == 1), i
        if i % 2 == 0:
            assert got[i].text == t and got[i].n_chars == 3  # clean documents stay as they are
        elif i > 1:
            assert not any(p in got[i].text for p in passage) and got[i].n_chars == len(got[i].text) and len(WORD.findall(got[i].text)) == 33
    assert got[99].text == "Of.\nOf.\nOf."
    out = D.dedup_lines(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    assert out.filter("text IS NULL").count() == docs.filter("text IS NULL").count()
    assert D.dedup_lines(none).count() == 0


def test_line_dedup_one_line(spark):
    """A single long line between unrelated lines, longer or shorter than a fingerprint's window."""
    rng = random.Random(9)
    line = prose(rng, 60) + "."
    rows = [(i, "\n".join([prose(rng, 12) + ".", line, prose(rng, 12) + "."]), None, None, 3, 7, "r") for i in range(40)]
    got = D.dedup_lines(spark.createDataFrame(rows, DOCS)).collect()
    assert [r.doc_id for r in got if line in r.text] == [0]
    assert all(len(WORD.findall(r.text)) == 24 for r in got if r.doc_id)


def test_line_dedup_brute(spark):
    """Runs of short and long lines over a small stock, so first positions of parts lie in unrelated documents."""
    rng = random.Random(11)
    stock = [prose(rng, rng.choice([1, 1, 2, 3, 5, 9, 10, 25])) + "." for _ in range(60)]
    texts = [rng.choice(["\n", " "]).join(rng.choice(stock) if rng.random() < 0.5 else prose(rng, rng.randrange(1, 14)) + "." for _ in range(rng.randrange(1, 12))) for _ in range(60)]
    texts += ["In. " + prose(rng, 12) + ".", *("\n".join([prose(rng, 12) + ".", "In.", texts[0], "So. So.", stock[3], "In."]) for _ in range(3)), *["So.\n" * 30] * 2]
    texts += texts[20:24]
    rows = [(i, t, None, None, 3, 7, "r") for i, t in enumerate(texts)]
    got = {r.doc_id: r.text for r in D.dedup_lines(spark.createDataFrame(rows, DOCS).repartition(3)).collect()}
    squeeze = lambda t: re.sub(r"\s+", " ", t).strip()
    assert [squeeze(got[i]) for i in range(len(texts))] == [squeeze(t) for t in brute_kept(texts, 10)]
    assert {got[i] for i in range(len(texts) - 4, len(texts)) if len(WORD.findall(texts[i])) >= 10} == {""}


def test_pii(spark, docs, none):
    rng = random.Random(4)
    parts = ["a.b@c.de", "x@y", "a@b.c_d@e.f", "@a.b@c.d", "1.2.3.4", "256.1.1.1", "1.2.3.4.5", "001.2.3.255", "4539 1488 0343 6467", "4539148803436468", "+1 (415) 555-0000", "+12", "++49 30 1234567", "é", " ", "-", "7", "..", "tel: ", 'token = "0a1b2c3d4e5f60718293a4b5c6d7e8f901234567"']
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 12))) for _ in range(300)] + ["1" * 5000, "a" * 20000 + "@", "1-" * 4000, None, ""]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, spans int")
    for r in P.report(df).collect():
        t = texts[r.doc_id] or ""
        base = {k: [m for m in re.finditer(p, t) if sure(k, m[0])] for k, p in SPANS.items()}
        want = ",".join(f"{k}:{m.start()}:{m.end()}" for k, ms in base.items() for m in ms)
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest(), (t, want, r.spans)
        assert [r[f"n_{k}"] for k in SPANS] == [len(ms) for ms in base.values()]
        assert set(filter(None, want.split(","))) <= set(r.spans.split(","))
    assert P.report(none).count() == 0 and P.report(docs).count() == docs.count()
    red = P.redact(spark.createDataFrame([(1, "mail a.b@c.de or +1 (415) 555-0000!")], "doc_id long, text string"), P.Booster()).first()
    assert red.text == "mail [EMAIL] or [PHONE]!"


def test_html(spark):
    nav = '<nav><a href="/">Home</a></nav>'
    page = lambda body, extra="": f"<html><head><title>t</title><script>var a='</p>';</script></head><body>{nav}{body}<footer>&copy; x</footer>{extra}</body></html>"
    assert H.extract(page("<article><h1>A &amp; B</h1><p><b>Bold\n text<br>more<p>Two<div class='comments'><p>hi</p></div></article>"), set()) == "A & B\nBold text more\nTwo"
    assert H.extract(None, set()) == "" == H.extract("<p", set()).replace("<p", "")
    rows = [(i, f"http://h.example/{i}", page(f"<div><p>Welcome to the site</p><p>Story number {i} is here</p></div>"), 1) for i in range(6)] + [(7, None, None, 1), (8, "http://one/", page("<p>Only</p>"), 1)]
    rows += [rows[0]] * 4
    out = {r.page_id: r for r in H.main_text(spark.createDataFrame(rows, "page_id long, url string, html string, text int")).collect()}
    assert out[3].text == "Story number 3 is here" and out[3].n_chars == 22  # the shared line is template
    assert out[7].text == "" and out[8].text == "Only"


def test_html_template_in_article(spark):
    """Template text inside an article goes, content outside it stays, near copies keep what they share."""
    page = lambda i: f"<body><div class=menu>Menu</div><article><h2>Teaser {i}</h2><p>Story {i} told at length</p><p>Read it all here</p></article><div><p>Long read {i} outside</p></div></body>"
    copy = lambda i: f"<body><article><p>The very same long story told again</p><p>It goes on</p><p>Edit {i}</p></article></body>"
    rows = [(i, "http://a.org/x", page(i)) for i in range(6)] + [(10 + i, "http://b.org/x", copy(i)) for i in range(6)]
    out = {r.page_id: r.text for r in H.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(6):
        assert out[i] == f"Teaser {i}\nStory {i} told at length\nLong read {i} outside"
        assert out[10 + i] == f"The very same long story told again\nIt goes on\nEdit {i}"


def test_packing(spark, docs, none):
    from kindred.llm.queries import tokenizer_path
    from tokenizers import Tokenizer

    path, tok = tokenizer_path(), Tokenizer.from_file(tokenizer_path())
    cap = 128
    out = K.pack(docs, path, cap, 1).collect()
    ids = {}
    for i, t, *_ in corpus():
        ids.setdefault(i, tok.encode(t or "", add_special_tokens=False).ids + [1])
    want = sorted((str(i), k, s, len(x[s : s + cap]), zlib.crc32(np.array(x[s : s + cap], "<u4").tobytes())) for i, t, *_ in corpus() for x in [ids[i]] for k, s in enumerate(range(0, len(x), cap)))
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in out) == want
    bins = {}
    for r in out:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for o, n in sorted(b):
            assert o == at
            at += n
        assert at <= cap
    assert len(bins) <= sum(r.length for r in out) / cap + 3
    assert K.pack(none, path, cap, 1).count() == 0


def test_two_fit_uses_every_piece():
    rng = np.random.RandomState(2)
    counts = np.zeros(65, np.int64)
    for n in rng.randint(1, 65, 500):
        counts[n] += 1
    bins = K.plan(counts, 64)
    used = np.zeros(65, np.int64)
    for lengths, times in bins:
        assert sum(lengths) <= 64
        for n in lengths:
            used[n] += times
    assert (used == counts).all()


def test_mixing(spark, docs, none):
    cells = [(s, "en" if k else "fr", 100 * (1 + k) + 10 * len(s)) for s in ("a", "bb", "ccc") for k in (0, 1)]
    rows = [(i, " ".join(["w"] * n), l, s, 0, 7, "r") for i, (s, l, n) in enumerate(cells * 3)]
    df = spark.createDataFrame(rows, DOCS)
    out = X.mix_sources(df, X.MixParams(targets={"lang": {"en": 0.5, "fr": 0.5}}))
    share = {r.lang: r.w for r in out.groupBy("lang").agg(F.sum(F.col("cell.tokens") * F.col("cell.weight")).alias("w")).collect()}
    assert abs(share["en"] / sum(share.values()) - 0.5) < 0.001
    kept, total = out.agg(F.sum(F.col("cell.tokens") * F.col("cell.prob")), F.sum("cell.tokens")).first()
    assert abs(kept / total - 0.8) < 0.01
    full = X.mix_sources(docs)
    assert full.count() == docs.count() and full.filter("cell.prob < 0 OR cell.prob > 1 OR cell.prob IS NULL").count() == 0
    assert X.mix_sources(none).count() == 0


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as C

    rows = [r for r in corpus() if r[0] is not None]
    spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = [docs]
    for name, stage in C.STAGES:
        seen.append(stage(spark, seen[-1], str(tmp_path)))
        if len(seen) <= 5:
            assert seen[-1].columns == docs.columns
            assert seen[-1].join(seen[-2], "doc_id", "left_anti").count() == 0
    assert seen[1].filter("text IS NULL").count() == 0
    near = seen[3].dropDuplicates(["doc_id"])  # rows that repeat an id stay or go together
    assert near.count() == near.select("text").distinct().count()
    assert {r.doc_id for r in seen[5].collect()} == {r.doc_id for r in seen[4].collect()}
