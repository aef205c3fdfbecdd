"""Similarity measures as columns.

Measures with a Spark expression stay in the JVM; the others go through Arrow, where
each distinct pair of a batch is computed once. A null on either side gives null. Plain names
compare UTF-8 bytes, ``runes=True`` code points.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels as K
from . import phonetic as P
from . import scores as S
from .text import byte_view, grams, tokenise

NATIVE = ("Levenshtein", "Hamming", "QGramJaccard", "SorensenDice", "Cosine", "Tversky", "TokenJaccard", "Soundex")


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _both(a, b, runes: bool) -> tuple[Column, Column]:
    a, b = _col(a), _col(b)
    return (a, b) if runes else (byte_view(a), byte_view(b))


def _known(a: Column, b: Column, out: Column) -> Column:
    return F.when(a.isNotNull() & b.isNotNull(), out)


def pair_udf(compute, kind: T.DataType):
    """Arrow function of two text columns; ``compute(list, list)`` sees each distinct pair of a batch once."""

    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        keys: dict = {}
        at = [keys.setdefault((x, y), len(keys)) if x is not None and y is not None else -1 for x, y in zip(a, b)]
        got = list(compute([k[0] for k in keys], [k[1] for k in keys])) if keys else []
        return pd.Series([None if i < 0 else got[i] for i in at], dtype="object")

    return F.pandas_udf(run, kind)


def _scored(name: str, a, b, runes: bool = False, **p) -> Column:
    return pair_udf(lambda x, y: S.score(name, x, y, runes, **p).tolist(), T.DoubleType())(_col(a), _col(b))


def _viewed(fn, kind, a, b, runes: bool) -> Column:
    see = (lambda v: v) if runes else (lambda v: [S.view(x) for x in v])
    return pair_udf(lambda x, y: fn(see(x), see(y)), kind)(_col(a), _col(b))


def _ratio(d: Column, a: Column, b: Column) -> Column:
    top = F.greatest(F.length(a), F.length(b))
    return _known(a, b, F.when(top == 0, F.lit(1.0)).otherwise(1.0 - d / top))


# --- characters ---------------------------------------------------------------


def levenshtein_distance(a, b, runes: bool = False) -> Column:
    return F.levenshtein(*_both(a, b, runes))


def levenshtein_score(a, b, runes: bool = False) -> Column:
    x, y = _both(a, b, runes)
    return _ratio(F.levenshtein(x, y), x, y)


def _int_kernel(fn):
    return lambda x, y: [int(v) for v in fn(x, y)]


def osa_distance(a, b, runes: bool = False) -> Column:
    return _viewed(_int_kernel(K.osa_distance), T.IntegerType(), a, b, runes)


def osa_score(a, b, runes: bool = False) -> Column:
    return _scored("DamerauLevenshteinOSA", a, b, runes)


def damerau_distance(a, b, runes: bool = False) -> Column:
    return _viewed(_int_kernel(K.full_distance), T.IntegerType(), a, b, runes)


def damerau_score(a, b, runes: bool = False) -> Column:
    return _scored("DamerauLevenshteinFull", a, b, runes)


def hamming_distance(a, b, runes: bool = False) -> Column:
    """Differing places; for unlike lengths the longer length."""
    x, y = _both(a, b, runes)
    n = F.length(x)
    places = F.filter(F.sequence(F.lit(1), F.greatest(F.lit(1), n)), lambda i: F.substr(x, i, F.lit(1)) != F.substr(y, i, F.lit(1)))
    return _known(x, y, F.when(n == F.length(y), F.when(n == 0, F.lit(0)).otherwise(F.size(places))).otherwise(F.greatest(n, F.length(y))))


def hamming_score(a, b, runes: bool = False) -> Column:
    x, y = _both(a, b, runes)
    n = F.length(x)
    return _known(x, y, F.when(x == y, F.lit(1.0)).when(n != F.length(y), F.lit(0.0)).otherwise(1.0 - hamming_distance(a, b, runes) / n))


def jaro_score(a, b, runes: bool = False) -> Column:
    return _scored("Jaro", a, b, runes)


def jaro_winkler_score(a, b, runes: bool = False) -> Column:
    return _scored("JaroWinkler", a, b, runes)


def strcmp95_score(a, b) -> Column:
    return _scored("Strcmp95", a, b)


def smith_waterman_gotoh_score(a, b, params: S.SWGParams = S.SWGParams(), runes: bool = False) -> Column:
    return _scored("SmithWatermanGotoh", a, b, runes, params=params)


def smith_waterman_gotoh_raw_score(a, b, params: S.SWGParams = S.SWGParams(), runes: bool = False) -> Column:
    return _viewed(lambda x, y: S.swg_raw(x, y, params).tolist(), T.DoubleType(), a, b, runes)


def longest_common_substring(a, b, runes: bool = False) -> Column:
    """The first longest run of ``a`` that ``b`` holds; on the byte path what is no whole text becomes U+FFFD."""

    def run(x, y):
        n, end = K.common_substrings(x, y)
        cut = [s[int(e) - int(k) : int(e)] for s, k, e in zip(x, n, end)]
        return cut if runes else [c.encode("latin-1").decode("utf-8", "replace") for c in cut]

    return _viewed(run, T.StringType(), a, b, runes)


def lcs_str_score(a, b, runes: bool = False) -> Column:
    return _scored("LCSStr", a, b, runes)


def ratcliff_obershelp_score(a, b, runes: bool = False) -> Column:
    return _scored("RatcliffObershelp", a, b, runes)


# --- grams --------------------------------------------------------------------


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _count(g: Column, t: Column) -> Column:
    return F.size(F.filter(g, lambda o: o == t))


def _gram_score(a, b, n: int, runes: bool, body) -> Column:
    """``body(p, q)`` over the gram arrays, after the rules for equal texts and missing grams."""
    x, y = _both(a, b, runes)

    def guarded(s: Column) -> Column:
        p, q = s["p"], s["q"]
        none, one = (F.size(p) == 0) & (F.size(q) == 0), (F.size(p) == 0) | (F.size(q) == 0)
        return F.when(none, F.lit(1.0)).when(one, F.lit(0.0)).otherwise(body(p, q))

    return _known(x, y, F.when(x == y, F.lit(1.0)).otherwise(_let(F.struct(grams(x, n).alias("p"), grams(y, n).alias("q")), guarded)))


def _unique(g: Column) -> Column:
    return F.size(F.array_distinct(g)) == F.size(g)


def _shared(p: Column, q: Column) -> Column:
    """Grams in common, repeats counted. Without repeats on one side that is the set intersection."""
    counted = F.aggregate(F.array_intersect(p, q), F.lit(0), lambda s, t: s + F.least(_count(p, t), _count(q, t)))
    return F.when(_unique(p) | _unique(q), F.size(F.array_intersect(p, q))).otherwise(counted)


#: Measures that need no more than the numbers of grams, on either side and in common.
COUNTED = {
    "QGramJaccard": lambda c, p: c["i"] / (c["na"] + c["nb"] - c["i"]),
    "SorensenDice": lambda c, p: 2.0 * c["i"] / (c["na"] + c["nb"]),
    "Tversky": lambda c, p: F.when(c["i"] == 0, F.lit(0.0)).otherwise(c["i"] / (c["i"] + F.lit(float(p["alpha"])) * (c["na"] - c["i"]) + F.lit(float(p["beta"])) * (c["nb"] - c["i"]))),
}


def gram_counts(a, b, n: int, runes: bool = False) -> Column:
    """struct(same, na, nb, i): whether the texts are equal, their numbers of grams, and those in common."""
    x, y = _both(a, b, runes)
    both = F.struct(grams(x, n).alias("p"), grams(y, n).alias("q"))
    counts = _let(both, lambda s: F.struct((x == y).alias("same"), F.size(s["p"]).alias("na"), F.size(s["q"]).alias("nb"), _shared(s["p"], s["q"]).alias("i")))
    return _known(x, y, counts)


def from_counts(name: str, c: Column, params: dict) -> Column:
    """The score of a measure of COUNTED from ``gram_counts``."""
    none, one = (c["na"] == 0) & (c["nb"] == 0), (c["na"] == 0) | (c["nb"] == 0)
    return F.when(c.isNotNull(), F.when(c["same"] | none, F.lit(1.0)).when(one, F.lit(0.0)).otherwise(COUNTED[name](c, params)))


def _counted(name: str, a, b, runes: bool, **params) -> Column:
    return _let(gram_counts(a, b, params["n"], runes), lambda c: from_counts(name, c, params))


def q_gram_jaccard_score(a, b, n: int = 3, runes: bool = False) -> Column:
    return _counted("QGramJaccard", a, b, runes, **S.check_params("QGramJaccard", {"n": n}))


def sorensen_dice_score(a, b, n: int = 3, runes: bool = False) -> Column:
    return _counted("SorensenDice", a, b, runes, **S.check_params("SorensenDice", {"n": n}))


def cosine_score(a, b, n: int = 3, runes: bool = False) -> Column:
    S.check_params("Cosine", {"n": n})

    def body(p: Column, q: Column) -> Column:
        counted = lambda g: F.aggregate(F.array_distinct(g), F.lit(0.0), lambda s, t: s + F.pow(_count(g, t).cast("double"), F.lit(2.0)))
        norm = lambda g: F.sqrt(F.when(_unique(g), F.size(g).cast("double")).otherwise(counted(g)))
        common = F.array_intersect(p, q)
        dot = F.when(_unique(p) & _unique(q), F.size(common).cast("double")).otherwise(F.aggregate(common, F.lit(0.0), lambda s, t: s + _count(p, t) * _count(q, t).cast("double")))
        return F.least(F.lit(1.0), F.greatest(F.lit(0.0), dot / (norm(p) * norm(q))))

    return _gram_score(a, b, n, runes, body)


def tversky_score(a, b, n: int = 3, alpha: float = 1.0, beta: float = 1.0, runes: bool = False) -> Column:
    return _counted("Tversky", a, b, runes, **S.check_params("Tversky", {"n": n, "alpha": alpha, "beta": beta}))


# --- tokens -------------------------------------------------------------------


def token_jaccard_score(a, b) -> Column:
    a, b = _col(a), _col(b)
    both = F.struct(tokenise(a).alias("p"), tokenise(b).alias("q"))

    def ratio(s: Column) -> Column:
        union = F.size(F.array_union(s["p"], s["q"]))
        return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(s["p"], s["q"])) / union)

    return _known(a, b, F.when(a == b, F.lit(1.0)).otherwise(_let(both, ratio)))


def token_sort_ratio_score(a, b) -> Column:
    return _scored("TokenSortRatio", a, b)


def token_set_ratio_score(a, b) -> Column:
    return _scored("TokenSetRatio", a, b)


def partial_ratio_score(a, b) -> Column:
    return _scored("PartialRatio", a, b)


def monge_elkan_score(a, b, inner: str = "JaroWinkler") -> Column:
    return _scored("MongeElkan", a, b, inner=S.check_params("MongeElkan", {"inner": inner})["inner"])


def monge_elkan_score_asymmetric(a, b, inner: str = "JaroWinkler") -> Column:
    one = S.check_params("MongeElkan", {"inner": inner})["inner"]
    return pair_udf(lambda x, y: S.monge_elkan_one_way(x, y, one).tolist(), T.DoubleType())(_col(a), _col(b))


# --- phonetic -----------------------------------------------------------------


def _one(fn, kind: T.DataType):
    def run(s: pd.Series) -> pd.Series:
        return s.map(fn, na_action="ignore")

    return F.pandas_udf(run, kind)


def soundex_code(a) -> Column:
    return P.soundex_code(_col(a))


def soundex_score(a, b) -> Column:
    a, b = _col(a), _col(b)
    p, q = P.soundex_code(a), P.soundex_code(b)
    return _known(a, b, F.when((a == b) | ((p == q) & (p != "")), F.lit(1.0)).otherwise(F.lit(0.0)))


def nysiis_code(a) -> Column:
    return _one(P.nysiis, T.StringType())(_col(a))


def nysiis_score(a, b) -> Column:
    return _scored("NYSIIS", a, b)


def mra_code(a) -> Column:
    return P.mra_code(_col(a))


def mra_compare(a, b) -> Column:
    """struct(matched, sim)."""

    def run(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        got = [P.mra_compare(x, y) if x is not None and y is not None else (None, None) for x, y in zip(a, b)]
        return pd.DataFrame(got, columns=["matched", "sim"], dtype="object")

    kind = T.StructType([T.StructField("matched", T.BooleanType()), T.StructField("sim", T.IntegerType())])
    return F.pandas_udf(run, kind)(_col(a), _col(b))


def mra_score(a, b) -> Column:
    return _scored("MRA", a, b)


def double_metaphone_keys(a) -> Column:
    """struct(primary, secondary)."""

    def run(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([P.double_metaphone(x) if x is not None else (None, None) for x in s], columns=["primary", "secondary"], dtype="object")

    kind = T.StructType([T.StructField("primary", T.StringType()), T.StructField("secondary", T.StringType())])
    return F.pandas_udf(run, kind)(_col(a))


def double_metaphone_score(a, b) -> Column:
    return _scored("DoubleMetaphone", a, b)


#: Column function of each measure, for code that goes by name.
SCORES = {
    "Levenshtein": levenshtein_score, "DamerauLevenshteinOSA": osa_score, "DamerauLevenshteinFull": damerau_score, "Hamming": hamming_score,
    "Jaro": jaro_score, "JaroWinkler": jaro_winkler_score, "Strcmp95": strcmp95_score, "SmithWatermanGotoh": smith_waterman_gotoh_score,
    "LCSStr": lcs_str_score, "QGramJaccard": q_gram_jaccard_score, "SorensenDice": sorensen_dice_score, "Cosine": cosine_score,
    "Tversky": tversky_score, "MongeElkan": monge_elkan_score, "TokenSortRatio": token_sort_ratio_score, "TokenSetRatio": token_set_ratio_score,
    "PartialRatio": partial_ratio_score, "TokenJaccard": token_jaccard_score, "Soundex": soundex_score, "DoubleMetaphone": double_metaphone_score,
    "NYSIIS": nysiis_score, "MRA": mra_score, "RatcliffObershelp": ratcliff_obershelp_score,
}
