"""Columns against the recorded vectors and against the list forms."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from kindred.functions import kernels as K
from kindred.functions import phonetic as P
from kindred.functions import scores as S
from kindred.functions import similarity as sim
from kindred.functions import text as X
from kindred.functions.errors import InvalidAlgoID, InvalidInnerAlgo, InvalidQGramSize, InvalidSWGParam, InvalidTverskyParam
from kindred.operators.scan import ScanConfig, check, check_items, repeated_keys
from kindred.operators.scorer import ScorerBuilder, default_scorer, default_scorer_builder
from kindred.operators.validate import validate
from kindred.sources import items_from

DATA = os.path.join(os.path.dirname(os.path.abspath(__file__)), "data")


def load(name):
    with open(os.path.join(DATA, f"{name}.json"), encoding="utf-8") as f:
        return json.load(f)["rows"]


# fixed values: parameters that the recorded rows leave out
FOUR_GRAM = {("abc", "abcd"): 2, ("abcdefgh", "abcdefgi"): 3, ("abcde", "abcdf"): 4, ("héllo", "hello"): 3}
RUNES = {("café", "cafe"), ("héllo", "hello")}


def params_of(k, a, b, score):
    p, runes, pair = {}, False, (a, b)
    if k in ("QGramJaccard", "SorensenDice", "Cosine", "Tversky"):
        runes = pair in RUNES
        p["n"] = {"QGramJaccard": {("ab", "abc"): 5}, "SorensenDice": {("abcdef", "abcXef"): 3}, "Cosine": FOUR_GRAM, "Tversky": {}}[k].get(pair, 2)
    if k == "Tversky":
        special = {("abcd", "abcdef"): (0.8, 0.2), ("abcdef", "abcd"): (0.8, 0.2), ("hello", "hello"): (0.8, 0.2)}
        p["alpha"], p["beta"] = special.get(pair, (0.5, 0.5))
        if pair == ("abcd", "abce") and score == 0.5:
            p["alpha"] = p["beta"] = 1.0
    return p, runes


def test_recorded_scores(spark):
    for name in S.NAMES:
        rows = [(r, *params_of(*r)) for r in load("scores") if r[0] == name]
        assert rows
        for key in {(tuple(sorted(p.items())), r) for _, p, r in rows}:
            mine = [r for r, p, runes in rows if (tuple(sorted(p.items())), runes) == key]
            kw = dict(key[0]) | ({"runes": True} if key[1] else {})
            df = spark.createDataFrame([(a, b, float(x)) for _, a, b, x in mine], "a string, b string, want double")
            bad = df.withColumn("got", sim.SCORES[name]("a", "b", **kw)).filter("got IS NULL OR got <> want").collect()
            assert not bad, (name, kw, bad)
            assert S.score(name, [r[1] for r in mine], [r[2] for r in mine], key[1], **dict(key[0])).tolist() == [r[3] for r in mine]


def test_phonetic_codes(spark):
    rows = load("codes")
    for k, word, code in rows:
        got = {"NYSIIS": P.nysiis, "MRA": P.py_mra, "Soundex": S.py_soundex, "DoubleMetaphone": P.double_metaphone}[k](word)
        assert got == (tuple(code) if k == "DoubleMetaphone" else code), (k, word)
    words = [r[1] for r in rows] + ["", "1abc", "ça va", "O'Hara"]
    df = spark.createDataFrame([(w,) for w in words], "w string").select("w", sim.soundex_code("w").alias("s"), sim.mra_code("w").alias("m"), sim.nysiis_code("w").alias("n"), sim.double_metaphone_keys("w").alias("d"))
    for r in df.collect():
        assert (r.s, r.m, r.n, tuple(r.d)) == (S.py_soundex(r.w), P.py_mra(r.w), P.nysiis(r.w), P.double_metaphone(r.w)), r


def test_other_oracles():
    close = lambda x, y, by=1e-9: abs(x - y) < by
    one = lambda name, a, b, *runes, **kw: S.score(name, [a], [b], *runes, **kw)[0]
    for a, b, lev, dam, jaro, winkler in load("characters"):
        assert K.full_distance([a], [b])[0] == dam and K.levenshtein_distance([a], [b])[0] == lev
        assert close(one("Jaro", a, b), jaro) and close(one("JaroWinkler", a, b), winkler), (a, b)
    for a, b, n, *want in load("grams"):
        for name, x in zip(("QGramJaccard", "SorensenDice", "Cosine", "Tversky"), want):
            assert close(one(name, a, b, True, n=n, **({"alpha": 0.5, "beta": 0.5} if name == "Tversky" else {})), x), (a, b, n, name)
    for a, b, *want in load("monge_elkan"):  # recorded in single precision
        for inner, (way, both) in (("JaroWinkler", want[:2]), ("Levenshtein", want[2:])):
            assert close(S.monge_elkan_one_way([a], [b], inner)[0], way, 1e-6) and close(one("MongeElkan", a, b, inner=inner), both, 1e-6), (a, b)
    for a, b, *params, raw in load("alignments"):
        assert close(S.swg_raw([a], [b], S.SWGParams(*params))[0], raw), (a, b)
    for a, b, *want in load("ratios"):
        for name, x in zip(("TokenSortRatio", "TokenSetRatio", "PartialRatio"), want):
            assert x is None or close(one(name, a, b), x), (a, b, name)
    for a, b, x in load("gestalt"):
        assert close(one("RatcliffObershelp", a, b), x), (a, b)


def test_normalisation(spark):
    for text, o, want in load("normalised"):
        opts = X.NormalisationOptions(o["Lowercase"], o["StripSeparators"], o["SeparatorChars"], o["SplitCamelCase"], o["NFC"], o["StripDiacritics"])
        got = spark.createDataFrame([(text,)], "s string").select(X.normalise(F.col("s"), opts).alias("o")).first().o
        assert got == want == X.py_normalise(text, opts), text


def test_tokens(spark):
    cases = {"XMLParser": ["xml", "parser"], "v2Beta": ["v2", "beta"], "__a--B": ["a", "b"], "": [], "getHTTPResponseCode": ["get", "http", "response", "code"], "user_id": ["user", "id"], "ÉtéFini": ["été", "fini"]}
    df = spark.createDataFrame([(k,) for k in cases], "s string").select("s", X.tokenise(F.col("s")).alias("t"))
    assert {r.s: r.t for r in df.collect()} == cases == {k: X.py_tokenise(k) for k in cases}


def random_pairs(n, seed=5):
    rng = random.Random(seed)
    alphabets = ["ab", "abcdeABC_- 12", "aéßñ ü", "abcdefghijklmnopqrstuvwxyz"]
    word = lambda: "".join(rng.choice(rng.choice(alphabets)) for _ in range(rng.choice([0, 1, 2, 5, 9, 24])))
    out = []
    for _ in range(n):
        a = word()
        b = a if rng.random() < 0.1 else "".join(c for c in a if rng.random() > 0.2) if rng.random() < 0.5 else word()
        out.append((a, b))
    return out


def test_native_equals_list_form(spark):
    pairs = random_pairs(150)
    df = spark.createDataFrame(pairs, "a string, b string")
    for name in sim.NATIVE:
        got = [r.s for r in df.select(sim.SCORES[name]("a", "b").alias("s")).collect()]
        assert got == S.score(name, [p[0] for p in pairs], [p[1] for p in pairs]).tolist(), name


def test_properties():
    pairs = random_pairs(300, 9)
    a, b = [p[0] for p in pairs], [p[1] for p in pairs]
    for name in S.NAMES:
        s = S.score(name, a, b)
        assert ((s >= 0) & (s <= 1)).all(), name
        same = S.score(name, a, a)
        assert all(x == 1.0 or (name == "TokenSetRatio" and not t) for x, t in zip(same, a)), name
        if name != "RatcliffObershelp":
            assert abs(s - S.score(name, b, a)).max() < 1e-12, name
    assert (S.score("JaroWinkler", a, b) >= S.score("Jaro", a, b)).all()
    assert (S.score("Tversky", a, b) == S.score("QGramJaccard", a, b)).all()
    assert (K.osa_distance(a, b) >= K.full_distance(a, b)).all()
    # batches and single pairs agree
    for f in (K.osa_distance, K.levenshtein_distance, K.lcs_length, K.jaro):
        assert [f([x], [y])[0] for x, y in pairs[:60]] == f(a, b)[:60].tolist()


def test_nulls_give_null(spark):
    df = spark.createDataFrame([(None, "x"), ("x", None), (None, None)], "a string, b string")
    for name, f in sim.SCORES.items():
        assert [r.s for r in df.select(f("a", "b").alias("s")).collect()] == [None] * 3, name


def test_distances_and_substrings(spark):
    df = spark.createDataFrame([("ca", "abc"), ("café", "cafe"), ("", "ab"), ("karolin", "kathrin")], "a string, b string")
    r = df.select(*[f("a", "b").alias(f.__name__) for f in (sim.levenshtein_distance, sim.osa_distance, sim.damerau_distance, sim.hamming_distance, sim.longest_common_substring)], sim.levenshtein_distance("a", "b", runes=True).alias("runes")).collect()
    assert [tuple(x)[:4] for x in r] == [(3, 3, 2, 3), (2, 2, 2, 5), (2, 2, 2, 2), (3, 3, 3, 3)]
    assert [x.longest_common_substring for x in r] == ["c", "caf", "", "ka"]
    assert [x.runes for x in r] == [3, 1, 2, 3]
    m = df.select(sim.mra_compare("a", "b").alias("m")).collect()
    assert [tuple(x.m) for x in m] == [P.mra_compare(x.a, x.b) for x in df.collect()]


def test_bad_parameters():
    with pytest.raises(InvalidQGramSize):
        sim.cosine_score("a", "b", 0)
    with pytest.raises(InvalidTverskyParam):
        sim.tversky_score("a", "b", 2, -1.0, 0.5)
    with pytest.raises(InvalidInnerAlgo):
        sim.monge_elkan_score("a", "b", "TokenJaccard")
    with pytest.raises(InvalidAlgoID):
        S.algo_name(23)
    with pytest.raises(InvalidSWGParam):
        S.SWGParams(match=float("nan")).validate()


def test_scorer(spark):
    b = ScorerBuilder().with_threshold(0.5)
    scorers = {
        "DefaultScorer": default_scorer(),
        "DefaultScorer-WithoutNormalisation": default_scorer_builder().without_normalisation().build(),
        "DefaultScorer-MinusDoubleMetaphone": default_scorer_builder().without_algorithm("DoubleMetaphone").build(),
        "Levenshtein-Only-Threshold-0.5": b.with_algorithm("Levenshtein", 1).build(),
        "Raw-Weights-Lev-1-JW-3-NoNorm": b.with_algorithm("Levenshtein", 1).with_algorithm("JaroWinkler", 3).with_normalised_weights(False).build(),
    }
    for key, s in scorers.items():
        mine = [r for r in load("scorers") if r[0] == key]
        assert mine
        df = spark.createDataFrame([(a, b) for _, a, b, *_ in mine], "a string, b string").withColumn("s", s.score_and_all("a", "b"))
        for r, (_, a, b, score, match, each) in zip(df.collect(), mine):
            assert (r.s.score, r.s.scores) == (score, each), (key, a, b)
            assert (r.s.score >= s.threshold) == match


def test_scan(spark):
    base = ScanConfig.default()
    configs = {
        "DefaultConfig": base,
        "DefaultConfig_CrossEnabled": ScanConfig(base.scorer, True),
        "DefaultConfig_CrossEnabled_AllowIdentical": ScanConfig(base.scorer, True, compare_identical_across_groups=True),
        "DefaultConfig_WithSuppressedPair": ScanConfig(base.scorer, suppressed_pairs=(("user_id", "userId"),)),
        "DefaultConfig_WithSilenceLint": base,
        "DefaultConfig_BucketDispatch_60Items": base,
    }
    for config, rows, warnings in load("scans"):
        items = items_from(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i long, n string, g string, s boolean"), "n", "g", "s", order="i")
        out = check(items, configs[config])
        assert [[r.kind, r.name_a, r.name_b, r.group_a, r.group_b, r.score, r.scores] for r in out.collect()] == warnings, config
        assert repeated_keys(out).count() == 0


def test_scan_refuses_bad_items(spark):
    from kindred.functions.errors import InvalidItem

    items = items_from(spark.createDataFrame([(0, "a", "g"), (1, "a", "g"), (2, "", "g")], "i long, n string, g string"), "n", "g", order="i")
    with pytest.raises(InvalidItem, match=r"\[2\]"):
        check_items(items)


def test_validate(spark):
    df = spark.createDataFrame([("", ""), ("abc", "abcd"), ("___", "a"), ("日本", "ab"), ("a", "b")], "a string, b string")
    got = [[(w.algorithm, w.kind) for w in r.w] for r in df.select(validate("a", "b").alias("w")).collect()]
    tier = [(i, 3) for i in range(13, 18)]
    assert got[0] == [(-2, 1)] and got[1] == [(3, 2)] and got[4] == []
    assert got[2] == [(3, 2), *tier]
    assert got[3] == [(3, 2), (6, 4), (18, 4), (19, 4), (20, 4), (21, 4)]


def test_stream_and_sql(spark, tmp_path):
    from kindred.sql import register
    from kindred.streaming import match_stream

    spark.createDataFrame([("user_ids",), ("other thing",)], "n string").write.parquet(str(tmp_path / "in"))
    known = spark.createDataFrame([("userIds",), ("profile",)], "k string")
    stream = spark.readStream.schema("n string").parquet(str(tmp_path / "in"))
    q = match_stream(stream, "n", known, "k", default_scorer()).writeStream.format("memory").queryName("hits").start()
    q.processAllAvailable()
    q.stop()
    assert [(r.new_name, r.known_name) for r in spark.table("hits").collect()] == [("user_ids", "userIds")]


def test_sql_functions(spark):
    """Every registered function gives what the columns and list forms give, native ones without Python."""
    from kindred.operators.validate import py_validate
    from kindred.sql import NATIVE, register

    names = register(spark)
    pairs = [(a, b) for a, b in random_pairs(60, 3)] + [("", ""), ("", "a"), ("café", "cafe"), ("1abc", "abc"), ("日本", "ab"), ("__", "x")]
    spark.createDataFrame([*pairs, (None, "x")], "a string, b string").createOrReplaceTempView("pairs_of_names")
    a, b = [p[0] for p in pairs], [p[1] for p in pairs]
    for n in S.NAMES:
        assert f"fm_{n.lower()}_score" in names
        got = [r.s for r in spark.sql(f"SELECT fm_{n.lower()}_score(a, b) AS s FROM pairs_of_names").collect()]
        assert got == [*S.score(n, a, b).tolist(), None], n
    view = lambda v: [S.view(x) for x in v]
    want = {"levenshtein_distance": K.levenshtein_distance, "osa_distance": K.osa_distance, "damerau_distance": K.full_distance, "hamming_distance": S.hamming_distance}
    for n, f in want.items():
        assert [r.s for r in spark.sql(f"SELECT fm_{n}(a, b) AS s FROM pairs_of_names").collect()] == [*f(view(a), view(b)).tolist(), None], n
    one = {"soundex_code": S.py_soundex, "mra_code": P.py_mra, "nysiis_code": P.nysiis, "tokenise": X.py_tokenise, "normalise": lambda s: X.py_normalise(s, X.NormalisationOptions()), "double_metaphone_keys": P.double_metaphone}
    for n, f in one.items():
        got = [r.s for r in spark.sql(f"SELECT fm_{n}(a) AS s FROM pairs_of_names").collect()][:-1]
        assert [tuple(g) if n == "double_metaphone_keys" else g for g in got] == [f(x) for x in a], n
    for r in spark.sql("SELECT a, b, fm_validate(a, b) AS w FROM pairs_of_names WHERE a IS NOT NULL").withColumn("v", validate("a", "b")).collect():
        assert r.w == r.v and [tuple(x) for x in r.w] == py_validate(r.a, r.b), (r.a, r.b)
    for n in NATIVE:
        assert "Arrow" not in spark.sql(f"SELECT fm_{n}(a, b) AS s FROM pairs_of_names")._jdf.queryExecution().executedPlan().toString(), n
