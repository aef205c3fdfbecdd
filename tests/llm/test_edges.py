"""Every corpus operator and pipeline stage on awkward tables: clashing extra columns, empty tables, nulls in any column, repeated rows."""

import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as C
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
from kindred.llm.queries import mix_params, tokenizer_path

from .brute import DOCS, WORD, brute_components, brute_kept, corpus, prose
from .test_exactness import drawn, raked

#: Names that operators use inside or give to results.
NAMES = (
    "_v _d _w _gone _runs _key key cell _cell _source _lang _topic _tokens _prob _s _k _t _l _h _p _c _base _b_email _c_secret _found _found_score "
    "rep c g m n k tv fp fp1 fp2 sig bands nb mine bi bj label node near low v h first last gone f task nth piece start length ids_crc32 base spans added "
    "host page tok tags template main payload refers_to payload_digest value kind query_id rank vec dim shard home block floor weight prob off selected "
    "lang_pred score kept base_failed n_words n_shingles component_id n_email topic tokens source_ lang_ text_"
).split()


def widened(df):
    return df.select("*", *[F.lit(f"x-{n}").alias(n) for n in NAMES if n not in df.columns])


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS).repartition(3).cache()


def rows_of(df, *drop):
    return sorted(map(str, df.drop(*drop).collect()))


OPERATORS = {
    "statistics": Q.statistics,
    "quality": lambda d: Q.quality_rules(d, d.sparkSession.createDataFrame([], "doc_id long, quality int")),
    "lines": D.line_report,
    "near": M.near_duplicates,
    "mix": lambda d: X.mix_report(d, mix_params()),
    "pii": P.report,
    "pack": lambda d: K.pack(d, tokenizer_path(), 256, 1).groupBy("doc_id", "piece", "length", "ids_crc32").count(),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_extra_columns_change_nothing(docs, name):
    run = OPERATORS[name]
    assert rows_of(run(widened(docs))) == rows_of(run(docs.select("doc_id", "text", "lang", "source")))


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(docs, name):
    assert OPERATORS[name](docs.limit(0)).count() == 0
    nulls = docs.limit(3).select(*[F.lit(None).cast(t).alias(c) for c, t in docs.dtypes])
    assert OPERATORS[name](nulls).count() in (1, 3)  # rows are grouped for packing


@pytest.mark.parametrize("name", [n for n, _ in C.STAGES])
def test_stages_keep_columns(spark, docs, name, tmp_path):
    stage = dict(C.STAGES)[name]
    wide = widened(docs)
    out = stage(spark, wide, str(tmp_path))
    if name != "packing":
        assert out.columns == wide.columns
        plain = stage(spark, docs, str(tmp_path))
        assert rows_of(out.select(*docs.columns)) == rows_of(plain)
        for n in NAMES:
            assert out.select(n).distinct().count() <= 1 and (out.count() == 0 or n in docs.columns or out.select(n).first()[0] == f"x-{n}") if n in ("_v", "cell", "_key", "_found") else True
    assert stage(spark, wide.limit(0), str(tmp_path)).count() == 0
    nulls = docs.limit(3).select(*[F.lit(None).cast(t).alias(c) for c, t in docs.dtypes])
    assert stage(spark, nulls, str(tmp_path)).count() in ({"language_id": (0,), "line_dedup": (0,)}.get(name, (0, 1, 2, 3)))


def test_workers_keep_one_operator_at_a_time(spark):
    """A worker that parsed languages and packed holds no automata while it packs, and neither while it cuts lines."""
    docs = spark.createDataFrame(corpus(), DOCS).filter("doc_id IS NOT NULL").coalesce(1)
    texts = L.reference_texts(docs)

    def held(batches):
        import gc
        import os

        import pandas as pd

        for _ in batches:
            pass
        kinds = [type(x).__name__ for x in gc.get_objects()]
        yield pd.DataFrame({"pid": [os.getpid()], "parsers": [kinds.count("Parser")], "tokenizers": [kinds.count("CachedTokenizer")]})

    def now():
        r = spark.range(1).coalesce(1).mapInPandas(held, "pid long, parsers long, tokenizers long").first()
        return r.parsers, r.tokenizers

    L.identify(docs, texts).count()
    L.identify(docs, texts).collect()
    K.tokenised(docs, tokenizer_path(), 256, 1).collect()
    parsers, tokenizers = now()
    assert parsers == 0 and tokenizers <= 1
    D._fingerprints(D._lines(docs), D.LineParams()).collect()
    assert now() == (0, 0)


def test_language_stage_fills_labels(spark):
    rng = random.Random(3)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(6))
    text = lambda letters: " ".join(word(letters) for _ in range(60))
    rows = [(i, text("abcde" if i % 2 else "vwxyz"), None if i > 30 else ["ff", "aa"][i % 2], None, 0, 7, "r") for i in range(40)] + [(90, "123", "aa", None, 0, 7, "r")]
    got = {r.doc_id: r.lang for r in C.language_stage(spark, spark.createDataFrame(rows, DOCS), "").collect()}
    assert got == {i: ["ff", "aa"][i % 2] for i in range(40)}
    bare = spark.createDataFrame([(*r[:2], None, *r[3:]) for r in rows], DOCS)
    assert C.language_stage(spark, bare, "").count() == 40


def test_pages_and_vectors(spark):
    pages = spark.createDataFrame([(1, "http://a/x", "<p>One</p>"), (1, "http://a/x", "<p>One</p>"), (2, None, None), (None, "u", "<p>Two</p>")], "page_id long, url string, html string")
    for run in (H.main_text, W.round_trip):
        assert rows_of(run(widened(pages))) == rows_of(run(pages)) and run(pages).count() == 4 and run(pages.limit(0)).count() == 0
        assert run(pages.limit(2).select(*[F.lit(None).cast(t).alias(c) for c, t in pages.dtypes])).count() == 2
    vectors = spark.createDataFrame([(i, [float(i % 3), 1.0]) for i in [*range(12), 3, 3]] + [(50, None)], "vec_id long, embedding array<float>")
    assert rows_of(V.top_k(widened(vectors), widened(vectors))) == rows_of(V.top_k(vectors, vectors)) and V.top_k(vectors, vectors).count() == 120
    assert V.top_k(vectors.limit(0), vectors.limit(0)).count() == 0


def test_identify_keeps_columns(docs):
    refs = {"aa": "stone river light", "bb": "der hund und die katze"}
    wide = widened(docs)
    out = L.identify(wide, refs)
    assert set(wide.columns) <= set(out.columns) and out.count() == wide.count()
    assert L.identify(wide.limit(0), refs).count() == 0


def test_pipeline_by_hand(spark, tmp_path):
    """All five stages against plain Python: letters, repeated runs, links of 80 %, calibrated draws, token ids."""
    from tokenizers import Tokenizer

    rng = random.Random(21)
    passages = [prose(rng, 14) + ". " + prose(rng, 20) + "." for _ in range(4)]
    rows = []
    for i in range(90):
        lang = rng.choice(["en", "de"])
        words = [lang + w for w in prose(rng, rng.randrange(20, 90)).split()]
        text = " ".join(words) + "."
        if i % 6 == 0:
            text += " " + passages[i % 4] + " " + " ".join(lang + w for w in prose(rng, 12).split()) + "."
        rows.append((i, text, lang, f"s{i % 3}", len(text), 7, "r"))
    for k in range(8):  # near copies by an edited word inside a single sentence
        w = rows[k][1].split()
        w[len(w) // 2] = "edited"
        rows.append((100 + k, " ".join(w), rows[k][2], "s1", 0, 7, "r"))
    rows += [(200 + k, rows[k][1], "en", "s2", 0, 7, "r") for k in (1, 2)] + [(300, None, "en", None, None, 7, "r"), (301, "1 2 3", "en", "s0", 5, 7, "r"), (302, " ", None, "s0", 1, 7, "r"), (303, "lone words here", None, "s0", 15, 7, "r")]
    spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    out = C.run(spark, str(tmp_path)).collect()

    texts = L.reference_texts(spark.createDataFrame(rows, DOCS))
    predict = L.Parser(texts, 61).predict
    kept = [(i, t, lang if lang is not None else predict([t])[0][0], *rest) for i, t, lang, *rest in rows if t and re.search(r"[^\W\d_]", t)]
    cut = brute_kept([r[1] for r in kept], 10)
    kept = [(r[0], t, *r[2:]) for r, t in zip(kept, cut) if WORD.search(t)]
    _, label = brute_components(kept, 80)
    kept = [r for r in kept if label[r[0]] == r[0]]
    params = mix_params()
    found = X.anchors(spark.createDataFrame(kept, DOCS), params)
    kept = [r for r, (_, _, prob, _) in zip(kept, raked(kept, found, params)) if drawn(r[0], params.seed) < prob]
    tok = Tokenizer.from_file(tokenizer_path())
    want = sorted((r[0], len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for r in kept for ids in [tok.encode(r[1], add_special_tokens=False).ids + [1]])
    assert sorted((r.doc_id, r.length, r.ids_crc32) for r in out) == want
    assert 40 < len(want) < len(rows)
