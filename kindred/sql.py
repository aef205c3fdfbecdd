"""Measures and text functions under SQL names.

What Spark can express is registered as a SQL function, so its plans stay in the JVM; the
other measures are Arrow functions.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions import kernels as K
from .functions import phonetic as P
from .functions import scores as S
from .functions.text import NormalisationOptions, py_normalise, py_tokenise
from .operators.validate import py_validate

_X, _Y = "decode(encode(a, 'UTF-8'), 'ISO-8859-1')", "decode(encode(b, 'UTF-8'), 'ISO-8859-1')"
_TOP = f"greatest(length({_X}), length({_Y}))"
_HAMMING = f"CASE WHEN a = b THEN 0 WHEN length({_X}) = length({_Y}) THEN size(filter(sequence(1, length({_X})), i -> substr({_X}, i, 1) <> substr({_Y}, i, 1))) ELSE {_TOP} END"
_SOUNDEX = "(CASE WHEN NOT {0} RLIKE '[A-Za-z]' THEN '' ELSE soundex(regexp_replace(regexp_replace({0}, '[^\\\\x00-\\\\x7F]', ''), '^[^A-Za-z]+', '')) END)"
_MRA = "regexp_replace(regexp_replace(substring(upper(regexp_replace({0}, '[^A-Za-z]', '')), 1, 64), '(?<=.)[AEIOU]', ''), '(.)\\\\1+', '$1')"


def _grams(s: str) -> str:
    return f"CASE WHEN length({s}) >= 3 THEN transform(sequence(1, length({s}) - 2), i -> substr({s}, i, 3)) ELSE cast(array() AS array<string>) END"


def _gram_score(body: str) -> str:
    """``body`` over g.p, g.q and s, the number of grams in common; each array is made once."""
    shared = "aggregate(array_intersect(g.p, g.q), 0, (n, t) -> n + least(size(filter(g.p, o -> o = t)), size(filter(g.q, o -> o = t))))"
    live = f"transform(array(struct({_grams(_X)} AS p, {_grams(_Y)} AS q)), g -> CASE WHEN size(g.p) = 0 AND size(g.q) = 0 THEN 1D WHEN size(g.p) = 0 OR size(g.q) = 0 THEN 0D ELSE transform(array({shared}), s -> {body})[0] END)[0]"
    return f"CASE WHEN a = b THEN 1D ELSE {live} END"


#: Expressions over a and b; null where either is null.
NATIVE = {
    "levenshtein_distance": ("INT", f"levenshtein({_X}, {_Y})"),
    "levenshtein_score": ("DOUBLE", f"CASE WHEN a = b THEN 1D ELSE 1D - levenshtein({_X}, {_Y}) / {_TOP} END"),
    "hamming_distance": ("INT", _HAMMING),
    "hamming_score": ("DOUBLE", f"CASE WHEN a = b THEN 1D WHEN length({_X}) <> length({_Y}) THEN 0D ELSE 1D - ({_HAMMING}) / length({_X}) END"),
    "soundex_score": ("DOUBLE", f"CASE WHEN a = b OR ({_SOUNDEX.format('a')} = {_SOUNDEX.format('b')} AND {_SOUNDEX.format('a')} <> '') THEN 1D ELSE 0D END"),
    "qgramjaccard_score": ("DOUBLE", _gram_score("s / (size(g.p) + size(g.q) - s)")),
    "sorensendice_score": ("DOUBLE", _gram_score("2D * s / (size(g.p) + size(g.q))")),
    "tversky_score": ("DOUBLE", _gram_score("CASE WHEN s = 0 THEN 0D ELSE s / (s + 1D * (size(g.p) - s) + 1D * (size(g.q) - s)) END")),
}
NATIVE_ONE = {
    "soundex_code": _SOUNDEX.format("a"),
    "mra_code": f"CASE WHEN length({_MRA.format('a')}) > 6 THEN concat(left({_MRA.format('a')}, 3), right({_MRA.format('a')}, 3)) ELSE {_MRA.format('a')} END",
}


def register(spark: SparkSession, prefix: str = "fm_") -> list[str]:
    """Registers ``<prefix><measure>_score(a, b)`` for all measures, distances, codes, tokenise, normalise and validate."""
    done = []

    def add(name: str, fn) -> None:
        spark.udf.register(prefix + name, fn)
        done.append(prefix + name)

    def define(name: str, args: str, kind: str, body: str) -> None:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}({args}) RETURNS {kind} RETURN {body}")
        done.append(prefix + name)

    def paired(compute, kind):
        def run(a: pd.Series, b: pd.Series) -> pd.Series:
            live = a.notna() & b.notna()
            out = pd.Series([None] * len(a), dtype="object")
            if live.any():
                got = pd.Series(list(compute(a[live].tolist(), b[live].tolist())), index=a.index[live], dtype="object")
                out[live] = got
            return out

        return F.pandas_udf(run, kind)

    def unary(fn, kind):
        def run(a: pd.Series) -> pd.Series:
            return a.map(fn, na_action="ignore")

        return F.pandas_udf(run, kind)

    def scorer(measure: str):
        return paired(lambda a, b: S.score(measure, a, b).tolist(), T.DoubleType())

    def distance(kernel):
        return paired(lambda a, b: [int(v) for v in kernel([S.view(x) for x in a], [S.view(x) for x in b])], T.IntegerType())

    keys = T.StructType([T.StructField("primary", T.StringType()), T.StructField("secondary", T.StringType())])

    def metaphone(a: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([P.double_metaphone(x) if x is not None else (None, None) for x in a], columns=["primary", "secondary"], dtype="object")

    for n in S.NAMES:
        if f"{n.lower()}_score" not in NATIVE:
            add(n.lower() + "_score", scorer(n))
    for name, (kind, body) in NATIVE.items():
        define(name, "a STRING, b STRING", kind, f"CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN {body} END")
    for name, body in NATIVE_ONE.items():
        define(name, "a STRING", "STRING", f"CASE WHEN a IS NOT NULL THEN {body} END")
    add("osa_distance", distance(K.osa_distance))
    add("damerau_distance", distance(K.full_distance))
    add("mongeelkan_score_asymmetric", paired(lambda a, b: S.monge_elkan_one_way(a, b).tolist(), T.DoubleType()))
    add("tokenise", unary(py_tokenise, T.ArrayType(T.StringType())))
    add("normalise", unary(lambda s: py_normalise(s, NormalisationOptions()), T.StringType()))
    add("nysiis_code", unary(P.nysiis, T.StringType()))
    add("double_metaphone_keys", F.pandas_udf(metaphone, keys))
    warning = T.StructType([T.StructField("algorithm", T.IntegerType()), T.StructField("kind", T.IntegerType()), T.StructField("detail", T.StringType())])
    add("validate", paired(lambda a, b: [py_validate(x, y) for x, y in zip(a, b)], T.ArrayType(warning)))
    return done
