"""Corpus operators beyond their plain cases: brute force on long and planted data, damaged archives, other tokenizers."""

import hashlib
import math
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as C
from kindred.llm import html_extract as H
from kindred.llm import language_id as L
from kindred.llm import minhash as M
from kindred.llm import mixing as X
from kindred.llm import packing as K
from kindred.llm import pii as P
from kindred.llm import quality_rules as Q
from kindred.llm import vector_search as V
from kindred.llm import warc as W

from .brute import DOCS, SPANS, WORD, corpus, greedy, prose, repeat_words, sure


def test_all_code_points_equal_the_tokenizer():
    from kindred.llm.queries import tokenizer_path

    t = K.CachedTokenizer(tokenizer_path())
    assert t.known
    points = [chr(c) for c in range(0x10000) if not 0xD800 <= c <= 0xDFFF]
    for texts in (points, [f"a{c}b 1{c}'s {c}{c} x'{c}" for c in points]):
        assert [x for x, e in zip(texts, t.encode(texts)) if e != t.whole(x)] == []


def test_other_tokenizer_file(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    texts = ["Plain words, don't  split", "Əli kitab oxuyur", " lead\n\nand trail ", "", None]
    out = K.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path, 64, 7).collect()
    assert {r.doc_id: r.ids_crc32 for r in out} == {i: zlib.crc32(np.array(tok.encode(t or "", add_special_tokens=False).ids + [7], "<u4").tobytes()) for i, t in enumerate(texts)}


def test_written_archive_with_a_flipped_byte(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i, f"http://h/{i}", prose(rng, 40) if i % 5 else "same page") for i in range(60)]
    W.write(W.classified(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)), str(tmp_path / "w"))
    (file,) = (tmp_path / "w").glob("part-*")
    data = file.read_bytes()
    whole = [(h["warc-record-id"], lo, hi) for _, h, _, lo, hi in W.salvage(data)]
    assert len(whole) == 60 and whole[0][1] == 0 and whole[-1][2] == len(data)
    for _ in range(40):
        at = rng.randrange(len(data))
        bad = bytearray(data)
        bad[at] ^= 1 << rng.randrange(8)
        got = list(W.salvage(bytes(bad)))
        back = [(h["warc-record-id"], lo, hi) for k, h, _, lo, hi in got if k == "record"]
        lost = [w for w in whole if w not in back]
        assert len(lost) <= 1 and set(back) <= set(whole)
        for _, lo, hi in lost:  # what is left of the member is a gap or a record out of a failed member
            rest = [(x, y) for k, _, _, x, y in got if k != "record"]
            assert lo <= at < hi and rest[0][0] == lo and rest[-1][1] == hi and all(p[1] == q[0] for p, q in zip(rest, rest[1:]))
    # cut in the middle, junk before and between, an oversized member
    assert [k for k, *_ in W.salvage(data[: whole[30][1] + 40])] == ["record"] * 30 + ["gap"]
    assert [k for k, *_ in W.salvage(data[: whole[1][2]] + b"\x1f\x8bjunk" + data[whole[1][2] : whole[3][2]])] == ["record", "record", "gap", "record", "record"]
    big = W.member(b"x" * (1 << 24)) + b"\x00"
    assert zlib.decompressobj(31).decompress(big) == b"x" * (1 << 24) and big.endswith(W._EMPTY)


def test_round_trip_raises_for_a_lost_page(spark, monkeypatch):
    pages = spark.createDataFrame([(1, "u", "a"), (2, "u", "b")], "page_id long, url string, html string")
    monkeypatch.setattr(W, "read", lambda s, p, real=W.read: real(s, p).filter("page <> '2'"))
    with pytest.raises(RuntimeError):
        W.round_trip(pages)


@pytest.mark.parametrize("block", [8, 64, 1024])
def test_phrases_over_block_ends(monkeypatch, block):
    monkeypatch.setattr(L, "BLOCK", block)
    rng = random.Random(1)
    text = lambda n, letters: "".join(rng.choice(letters) for _ in range(n))
    refs = {"aa": text(400, "ab c"), "bb": text(300, "abcd  e"), "cc": "ab" * 200}
    p = L.Parser(refs, 61)
    fold = lambda s: "".join(chr(c) for c in L._fold(s))
    texts = [text(rng.randrange(0, 3000), rng.choice(["ab c", "abcd e", "abzq ", "a", "ab"])) for _ in range(30)] + ["ab" * 2000, refs["aa"] * 3, ""]
    assert p.phrases(texts)[0].tolist() == [[greedy(fold(t), fold(refs[k])) for t in texts] for k in p.langs]


def test_reference_takes_a_share_of_every_document(spark):
    rows = [(i, f"{chr(97 + i)}" * 5000, "en") for i in range(10)] + [(20, "zz", "en")]
    (text,) = L.reference_texts(spark.createDataFrame(rows, "doc_id long, text string, lang string"), L.LangParams(chars_per_language=1000)).values()
    assert {c: text.count(c) for c in "abcdefghij"} == dict.fromkeys("abcdefghij", 99) and "zz" in text


def test_held_out_language(spark):
    """Accuracy on documents that were not learnt from."""
    rng = random.Random(6)
    stock = {k: [("".join(rng.choice(a) for _ in range(rng.randrange(2, 9)))) for _ in range(80)] for k, a in {"aa": "aeioubcdst", "bb": "aeiouxyzqk", "cc": "äöüßtrnesa"}.items()}
    rows = [(i, " ".join(rng.choice(stock[k]) for _ in range(rng.randrange(5, 400))), k) for i in range(240) for k in [["aa", "bb", "cc"][i % 3]]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = L.identify(df, L.reference_texts(df, training=~L.held_out())).withColumn("held", L.held_out()).filter("held").collect()
    assert len(out) > 30 and sum(r.lang == r.lang_pred for r in out) >= 0.95 * len(out)


def phrases_by_hand(rows, longest, one_in):
    """Per language the phrases that start at one in ``one_in`` of the positions of all its texts."""
    out = {}
    for lang in {k for _, t, k in rows if k is not None}:
        count, total = {}, 0
        for _, t, k in rows:
            folded = re.sub(r"[\W\d_]+", " ", (t or "").lower())
            if k == lang and folded.strip():
                total += len(folded)
                for i in range(len(folded)):
                    for n in range(1, min(longest, len(folded) - i) + 1):
                        count[folded[i : i + n]] = count.get(folded[i : i + n], 0) + 1
        out[lang] = {g for g, n in count.items() if n * one_in >= total}
    return {k: v for k, v in out.items() if v}


def held_phrases(learnt):
    letters = " " + "".join(map(chr, learnt.letters))
    codes = lambda key: [key >> L.BITS * (learnt.longest - 1 - j) & 63 for j in range(learnt.longest)]
    return {k: {"".join(letters[c - 1] for c in codes(key) if c) for key in np.frombuffer(b, np.int64).tolist()} for k, b in learnt.phrases}


@pytest.mark.parametrize(("longest", "one_in", "chunk"), [(6, 20_000, 1 << 20), (6, 300, 512), (3, 40, 64)])
def test_phrases_of_all_texts_by_hand(spark, monkeypatch, longest, one_in, chunk):
    monkeypatch.setattr(L, "CHUNK", chunk)
    monkeypatch.setattr(L, "HELD", chunk)
    rng = random.Random(8)
    rows = [(i if i % 9 else None, prose(rng, rng.randrange(1, 60)) + rng.choice(["", ".", " 7 x", "\n"]), rng.choice(["aa", "bb", None])) for i in range(300)]
    rows += [(1000, None, "aa"), (1001, "12 !", "cc"), (1002, "", "aa"), (1003, "z", "dd"), (1004, prose(rng, 900), "bb")]
    learnt = L.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3), L.LangParams(longest=longest, one_in=one_in))
    assert held_phrases(learnt) == phrases_by_hand(rows, longest, one_in)
    p = L.Parser(learnt, 61)
    for k, lang in enumerate(p.langs):
        has, texts = held_phrases(learnt)[lang], ["zq" + t[:200] for _, t, _ in rows[:20]]
        want = []
        for t in texts:
            f, at, n = re.sub(r"[\W\d_]+", " ", t.lower()), 0, 0
            while at < len(f):
                at += next((d for d in range(longest, 0, -1) if len(f) - at >= d and f[at : at + d] in has), 1)
                n += 1
            want.append(n)
        assert p.phrases(texts)[0][k].tolist() == want


def test_every_labelled_row_is_learnt_from(spark, tmp_path):
    """A word of its own per document: unlabelled copies get its language only if that document was learnt from."""
    rng = random.Random(9)
    own = ["".join(rng.choice("abcdefghijklmnop") for _ in range(30)) for _ in range(400)]
    rows = [(i, w, ["aa", "bb"][i % 2], "s", 30) for i, w in enumerate(own)] + [(1000 + i, w, None, "s", 30) for i, w in enumerate(own)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r.lang for r in C.language_stage(spark, docs, str(tmp_path)).collect()}
    assert got == {i + k: ["aa", "bb"][i % 2] for i in range(400) for k in (0, 1000)}


def test_a_label_on_little_text_takes_no_other(spark):
    rng = random.Random(10)
    rows = [(i, prose(rng, 80), "aa") for i in range(30)] + [(90, "zz", "bb"), (91, "1 2 3", "cc")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in L.identify(df, L.learn(df)).collect()}
    assert got == {i: "aa" for i in range(30)} | {90: "bb", 91: "und"}


def test_repeats_with_colliding_hashes(spark):
    """Few hash bits, so nearly all windows collide: counts stay exact."""
    texts = dict(enumerate(r[1] for r in corpus() if r[1]))
    for bits in (4, 59):
        for r in Q.statistics(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), min_position_bits=bits).collect():
            assert r.n_repeat_words == repeat_words(WORD.findall(texts[r.doc_id])), (bits, r.doc_id)


def test_verdict_by_hand(spark):
    """The learnt list applied by Python to the statistics gives the query's verdicts."""
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(400):
        low = i % 4 == 0
        w = prose(rng, rng.randrange(12, 60)).split()
        rows.append((i, " ".join(x + ("***" if low and rng.random() < 0.7 else "") for x in w)))
        labels.append((i, 0 if low else 1))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")
    rules = Q.learn(Q.labelled_sample(docs, marks, Q.RuleParams()))
    assert rules.rules
    stats = {r.doc_id: r for r in Q.statistics(docs).collect()}

    def verdict(s):
        if s.n_words < 10 or 100 * s.n_repeat_words > 20 * s.n_words:
            return False
        for rule in rules.rules:
            if all(s[f] <= t if op == "<=" else s[f] > t for f, op, t in rule.terms):
                return rule.keep
        return rules.default

    got = {r.doc_id: r.kept for r in Q.quality_rules(docs, marks).collect()}
    assert got == {i: verdict(s) for i, s in stats.items()}
    assert sum(got[i] == bool(q) for i, q in labels) >= 390


def raked(rows, found, params):
    """(topic, tokens, prob, weight) by document position: plain loops over dictionaries."""
    of, cells, keys = {w: (t, x) for w, t, x in found}, {}, []
    for _, text, lang, source, *_ in rows:
        words = WORD.findall(text or "")
        sums = {}
        for w in words:
            if w.lower() in of:
                t, x = of[w.lower()]
                sums[t] = sums.get(t, 0.0) + x
        topic = f"topic{max(sorted(sums), key=lambda t: (sums[t], -t))}" if sums else "other"
        k = (X.NONE if source is None else source, X.NONE if lang is None else lang, topic)
        keys.append((k, len(words)))
        cells[k] = cells.get(k, 0) + len(words)
    w, goals = {k: float(n) for k, n in cells.items()}, []
    for d, dim in enumerate(X.DIMS):
        by = {}
        for k, n in cells.items():
            by[k[d]] = by.get(k[d], 0) + n
        given = params.targets.get(dim)
        if given:
            rest = sum(n for v, n in by.items() if v not in given)
            raw = {v: (given[v] if n else 0.0) if v in given else max(0.0, 1 - sum(given.values())) * n / rest if rest else 0.0 for v, n in by.items()}
        else:
            raw = {v: n**params.temperature for v, n in by.items()}
        goals.append({v: g / sum(raw.values()) for v, g in raw.items()})
    for _ in range(200):
        for d in range(3):
            s = {}
            for k, x in w.items():
                s[k[d]] = s.get(k[d], 0.0) + x
            w = {k: x * goals[d][k[d]] / s[k[d]] if s[k[d]] else 0.0 for k, x in w.items()}
    total = sum(cells.values())
    lo, hi = 0.0, 1e12
    for _ in range(200):
        c = (lo + hi) / 2
        lo, hi = (c, hi) if sum(min(n, c * w[k]) for k, n in cells.items()) < params.budget_share * total else (lo, c)
    prob = {k: min(1.0, lo * w[k] / n) if n else params.budget_share for k, n in cells.items()}
    weight = {k: w[k] * total / n if n else 1.0 for k, n in cells.items()}
    return [(k[2], n, prob[k], weight[k]) for k, n in keys]


def drawn(doc_id, seed):
    return int(hashlib.md5(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:13], 16) / 16**13


def mixable():
    rng = random.Random(12)
    words = {k: [f"{k}{''.join(rng.choice('bcdfgaeiou') for _ in range(5))}" for _ in range(40)] for k in ("en", "de", "fr")}
    rows = []
    for i in range(240):
        lang = rng.choice(["en", "en", "de", "fr"])
        some = rng.sample(words[lang], 8)
        rows.append((i, " ".join(rng.choice(some) for _ in range(rng.randrange(1, 80))), lang, rng.choice(["s0", "s0", "s1", None]), 0, 7, "r"))
    return rows + [(900, None, "en", "s0", 0, 7, "r"), (901, "", None, None, 0, 7, "r")]


@pytest.mark.parametrize("targets", [{}, {"lang": {"en": 0.4, "de": 0.3}}])
def test_mixing_by_hand(spark, targets):
    rows = mixable()
    params = X.MixParams(targets=targets, topics=2, topic_words=3, tolerance=1e-10)
    docs = spark.createDataFrame(rows, DOCS)
    found = X.anchors(docs, params)
    assert len(found) >= 12
    got = {r.doc_id: r for r in X.mix_report(docs, params).collect()}
    for (i, *_), (topic, n, prob, weight) in zip(rows, raked(rows, found, params)):
        r = got[i]
        assert (r.topic, r.tokens) == (topic, n) and abs(r.prob - prob) < 1e-6 and abs(r.weight - weight) < 1e-6 * max(1, weight), (i, r, prob, weight)
        assert r.selected == (drawn(i, params.seed) < r.prob)
    assert max(r.off for r in got.values()) < 1e-9


def test_anchors_count_every_document(spark):
    """Document counts, bounds and weights are those of the whole table, which is larger than any sample."""
    rng = random.Random(31)
    words = {k: [k + "".join(rng.choice("bcdfgaeiou") for _ in range(4)) for _ in range(60)] for k in ("en", "de")}
    rows = []
    for i in range(5000):
        lang = rng.choice(["en", "en", "de", None])
        text = " ".join(rng.choice(words[lang or "de"]) for _ in range(rng.randrange(0, 9))) + rng.choice(["", " x1", " Shared\n"])
        rows.append((i if i % 50 else None, rng.choice([text, text.upper()]) if i % 70 else None, lang, "s0", 0, 7, "r"))
    params = X.MixParams()
    n, df = {}, {}
    for _, text, lang, *_ in rows:
        if text is not None:
            lang = X.NONE if lang is None else lang
            n[lang] = n.get(lang, 0) + 1
            for w in {w for w in WORD.findall(text.lower()) if re.fullmatch("[a-z]{3,}", w)}:
                df[lang, w] = df.get((lang, w), 0) + 1
    want = {}
    for lang in sorted(n):
        good = sorted((-c, w) for (k, w), c in df.items() if k == lang and max(2, 0.02 * n[lang]) <= c <= 0.2 * n[lang])
        for k, (c, w) in enumerate(good[: params.topics * params.topic_words]):
            want.setdefault(w, (k % params.topics, round(math.log(n[lang] / -c), 12)))
    found = X.anchors(spark.createDataFrame(rows, DOCS).repartition(5), params)
    assert {w: (t, round(x, 12)) for w, t, x in found} == want and len(want) >= 48


def test_targets_that_cannot_be_met(spark):
    rows = [(1, "a b c", "en", "s0", 0, 7, "r"), (2, "d e", "de", "s1", 0, 7, "r")]
    with pytest.warns(UserWarning, match="not met"):
        out = X.mix_report(spark.createDataFrame(rows, DOCS), X.MixParams(targets={"source": {"s0": 0.9, "s1": 0.1}, "lang": {"en": 0.1, "de": 0.9}})).collect()
    assert all(r.off > 0.1 for r in out)


def shape_of(kind, m, before, after):
    """The features of a candidate, by Python's patterns."""
    n = len(m)
    share = lambda p: len(re.findall(p, m)) / n
    b = lambda p, t=before: float(bool(re.search(p, t, re.A)))
    return {
        "kind": float(P.ORDER.index(kind)), "chars": n, "digit_share": share("[0-9]"), "upper_share": share("[A-Z]"), "vowel_share": share("[aeiouAEIOU]"),
        "distinct_share": len(set(m[:64])) / min(n, 64), "switches": share("[A-Za-z]+"), "groups": len(re.split("[^0-9A-Za-z]+", m)), "dots": m.count("."), "dashes": len(re.findall("[-_/+]", m)),
        "at": float("@" in m), "parens": float(bool(re.search(r"[(\[]", m))), "cue": b(P.CUE), "named": b(P.LABEL), "assigned": b("[=:]\\s*[\"']?$"), "quote_before": b("[\"']$"), "quote_after": b("^[\"']", after),
        "bracket_before": b(r"[(\[{<]$"), "space_before": float(before == "" or bool(re.search(r"\s$", before, re.A))), "letter_before": b(r"[A-Za-z],?\s+$"),
        "end_after": float(after == "" or bool(re.search(r"^[.!?]?(\s|$)", after, re.A))), "letter_after": b(r"^\s+[A-Za-z]", after),
    }


def spans_by_hand(t, model):
    base = [(k, m.start(), m.end()) for k, p in SPANS.items() for m in re.finditer(p, t) if sure(k, m[0])]
    good = []
    for kind, pattern in P.LOOSE.items():
        at = [0, *[x for m in re.finditer(pattern, t) for x in m.span()], len(t)]
        for i, m in enumerate(re.finditer(pattern, t)):
            f = shape_of(kind, m[0], t[at[2 * i] : m.start()][-24:], t[m.end() : at[2 * i + 3]][:8])
            s = sum((a if f[P.FEATURES[li]] <= lc else b) if f[P.FEATURES[j]] <= c else (d if f[P.FEATURES[ri]] <= rc else e) for (j, c), (li, lc, a, b), (ri, rc, d, e) in model.trees)
            if s >= model.threshold and not any(x < m.end() and m.start() < y for _, x, y in base):
                good.append((m.start(), m.end(), -s, P.ORDER.index(kind)))
    added = []
    for s, e, r, k in sorted(good):
        if added and s < added[-1][1]:
            added[-1][1] = max(added[-1][1], e)
            added[-1][2] = min(added[-1][2], (r, k))
        else:
            added.append([s, e, (r, k)])
    return sorted([(P.ORDER.index(k), s, e) for k, s, e in base] + [(k, s, e) for s, e, (_, k) in added])


def planted(seed, n):
    """Texts with secrets after a name and in plain prose, long plain words and numbers; and the planted secrets."""
    rng = random.Random(seed)
    syllables = "ver hand stra ung lich ter ion ment ness able pre con dis for mer".split()
    long = lambda: "".join(rng.choice(syllables) for _ in range(rng.randrange(4, 9)))
    words = ["river", "of", "and", "stone-and-river-and-tree", "lantern", "over", *(long() for _ in range(40))]
    texts, secrets = [], []
    for _ in range(n):
        w = [rng.choice(words) for _ in range(rng.randrange(8, 60))]
        mine = []
        if rng.random() < 0.5:
            s = hashlib.sha1(str(rng.random()).encode()).hexdigest()[: rng.choice([32, 40])]
            mine.append(s)
            w.insert(rng.randrange(len(w)), rng.choice([f'token = "{s}"', f"api_key: {s}", f'secret="{s}"']))
        if rng.random() < 0.3:
            w.insert(rng.randrange(len(w)), rng.choice(["+1 (415) 555-0000", "a.b@c.de", "10.0.0.1", "4539148803436467", "call 555 0100 2200", "12.50 33.10 47.90"]))
        texts.append(" ".join(w) + ".")
        secrets.append(mine)
    return texts, secrets


def test_added_spans(spark):
    """Learnt spans equal those found by hand; secrets of unseen texts are found, plain long words are not."""
    frame = lambda ts: spark.createDataFrame(list(enumerate(ts)), "doc_id long, text string")
    train, _ = planted(1, 600)
    rows = P.training_rows(frame(train), P.PiiParams())
    model = P.fit(rows)
    used = {P.FEATURES[t[0][0]] for t in model.trees}
    assert used & set(P.FORMAT) and used & set(P.CONTEXT)
    texts, secrets = planted(2, 300)
    texts += ["x " + "0a1b2c3d4e5f60718293a4b5c6d7e8f9" * 3, "", 'token = "' + "ab12" * 50 + '"' * 3]
    out = {r.doc_id: r for r in P.find(frame(texts), model).collect()}
    hit = wrong = 0
    for i, t in enumerate(texts):
        got = sorted((s.k, s.s, s.e) for s in [*out[i].base, *out[i].added])
        assert got == spans_by_hand(t, model), (t, got)
        if i < len(secrets):
            found = {t[s.s : s.e] for s in out[i].added if P.ORDER[s.k] == "secret"}
            hit += len(found & set(secrets[i]))
            wrong += len(found - set(secrets[i]))
    total = sum(map(len, secrets))
    assert hit >= 0.95 * total and wrong <= 0.05 * total, (hit, wrong, total)


def test_one_text_with_many_addresses(spark):
    one = lambda n: "".join(f'write to user{i}.name@mail{i % 9}.example.com or token = "{hashlib.md5(str(i).encode()).hexdigest()}" now. ' for i in range(n))
    model = P.fit(P.training_rows(spark.createDataFrame(list(enumerate(planted(1, 600)[0])), "doc_id long, text string"), P.PiiParams()))
    text, took = one(20000), time.time()
    r = P.find(spark.createDataFrame([(1, text)], "doc_id long, text string"), model).select("n_email", F.size("added").alias("n")).first()
    assert r.n_email == 20000 and r.n >= 19000 and time.time() - took < 90


def pages_of(hosts):
    """Pages whose markup names say nothing: the frame is div elements without classes."""
    rng = random.Random(3)
    rows, want = [], {}
    for h in range(hosts):
        for i in range(8):
            own = [prose(rng, rng.randrange(12, 40)) for _ in range(rng.randrange(2, 6))]
            links = "".join(f"<li><a href=/{rng.randrange(99)}>{prose(rng, 2)}</a></li>" for _ in range(5))
            body = "".join(f"<p>{p}</p>" for p in own)
            rows.append((100 * h + i, f"http://h{h}.org/{i}", f"<html><body><div><div><ul>{links}</ul></div><div><h1>Title {h} {i}</h1>{body}</div><div><div>{prose(rng, 3)}</div><div>All rights</div></div></div></body></html>"))
            want[100 * h + i] = "\n".join([f"Title {h} {i}", *own])
    return rows, want


def test_template_without_names(spark):
    """Nothing in the markup names an article or a menu; tag paths repeat, so classes stand on counts."""
    rows, _ = pages_of(3)
    marked = [(i, u, h.replace("<div><h1>", "<div id=z7><h1>").replace("<div><ul>", "<div id=q><ul>").replace("<div><div>", "<div id=k><div>", 2)) for i, u, h in rows]
    _, want = pages_of(3)
    out = {r.page_id: r.text for r in H.main_text(spark.createDataFrame(marked, "page_id long, url string, html string")).collect()}
    assert out == want


def test_classes_by_hand(spark):
    """Occurrence vectors compared page by page give the same classes."""
    rows, _ = pages_of(3)
    rows += [(900 + i, "http://h0.org/x", rows[0][2]) for i in range(3)] + [(990, "http://few.org/", "<p>a</p>"), (991, None, None)]
    got = sorted((r.host, tuple(r.toks)) for r in H.classes(spark.createDataFrame(rows, "page_id long, url string, html string")).collect())
    want, hosts = [], {}
    for _, url, html in rows:
        hosts.setdefault(H.host_of(url), set()).add(html or "")
    for host, pages in hosts.items():
        pages = sorted(pages)
        if len(pages) < 3:
            continue
        counts = [H.tokens(p)[0] for p in pages]
        vectors = {}
        for tok in set().union(*counts):
            v = tuple(c.get(tok, 0) for c in counts)
            if sum(x > 0 for x in v) >= math.ceil(0.9 * len(pages)):
                vectors.setdefault(v, []).append(tok)
        want += [(host, tuple(sorted(t))) for t in vectors.values() if len(t) >= 2]
    assert got == sorted(want) and {h for h, _ in got} == {"h0.org", "h1.org", "h2.org"}


def test_near_duplicates_of_odd_ids(spark):
    """String ids; an id with two texts is linked by both, through either."""
    rng = random.Random(5)
    x, y, z = (prose(rng, 60) for _ in range(3))
    near = lambda t: t + " tail"
    rows = [("b1", x), ("b1", y), ("c2", near(x)), ("d3", near(y)), ("e4", z), ("a0", y + " "), ("f5", prose(rng, 60)), (None, x)]
    got = {r.doc_id: (r.component_id, r.kept) for r in M.near_duplicates(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    assert got == {"a0": ("a0", True), "b1": ("a0", False), "c2": ("a0", False), "d3": ("a0", False), "e4": ("e4", True), "f5": ("f5", True), None: (None, True)}


def test_large_scores(spark):
    rng = np.random.RandomState(1)
    rows = [(i, [float(x) * 3e5 for x in rng.randn(4)]) for i in range(100)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [tuple(r) for r in V.top_k(df, df.filter("vec_id % 20 = 0"), V.SearchParams(shard_rows=16, block_queries=2, leaf=4)).orderBy("query_id", "rank").collect()]
    ints, want = {i: [math.floor(1024 * x) for x in v] for i, v in rows}, []
    for q in range(0, 100, 20):
        best = sorted((-sum(a * b for a, b in zip(ints[q], v)), i) for i, v in ints.items() if i != q)[:10]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert got == want and max(w[3] for w in want) > 2**53
    for big in (1e13, 1e20):
        far = spark.createDataFrame([(i, [big, float(i)]) for i in range(20)], "vec_id long, embedding array<double>")
        with pytest.raises(Exception, match="does not fit a long"):
            V.top_k(far, far).count()
