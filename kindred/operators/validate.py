"""Diagnostics of a pair: what makes its scores doubtful, as an array of structs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scores as S
from ..functions.text import py_tokenise, tokenise

ANY = -2
KINDS = {1: "WarnEmptyInput", 2: "WarnUnequalLength", 3: "WarnNoTokensAfterNormalise", 4: "WarnAllNonASCIIDropped", 5: "WarnPathologicallyLargeInput"}
LARGE = 65_536


def validate(a, b) -> Column:
    """array<struct<algorithm, kind, detail>> in order of algorithm and kind; null when either side is."""
    a, b = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    la, lb = F.octet_length(a), F.octet_length(b)
    na, nb = F.size(tokenise(a)), F.size(tokenise(b))
    beyond = lambda c: (c != "") & ~c.rlike(r"[\x00-\x7F]")
    text = lambda what, p, q: F.concat(F.lit(what + ": "), p.cast("string"), F.lit(" and "), q.cast("string"))
    rules = [
        ((a == "") | (b == ""), 1, [ANY], text("empty input, byte lengths", la, lb)),
        (F.greatest(la, lb) > LARGE, 5, [ANY], text(f"over {LARGE} bytes, byte lengths", la, lb)),
        (la != lb, 2, [S.IDS["Hamming"]], text("unequal byte lengths", la, lb)),
        (((na == 0) | (nb == 0)) & ((a != "") | (b != "")), 3, [S.IDS[n] for n in S.TOKEN_TIER], text("no tokens, counts", na, nb)),
        (beyond(a) | beyond(b), 4, [S.IDS[n] for n in S.ASCII_ONLY], text("no ASCII character", beyond(a), beyond(b))),
    ]
    rows = [F.when(cond, F.struct(F.lit(algo).alias("algorithm"), F.lit(kind).alias("kind"), detail.alias("detail"))) for cond, kind, algos, detail in rules for algo in algos]
    return F.when(a.isNotNull() & b.isNotNull(), F.array_sort(F.filter(F.array(*rows), lambda x: x.isNotNull())))


def py_validate(a: str, b: str) -> list[tuple[int, int, str]]:
    """``validate`` of two Python strings."""
    size = lambda s: len(s.encode("utf-8", "surrogatepass"))
    la, lb, na, nb = size(a), size(b), len(py_tokenise(a)), len(py_tokenise(b))
    beyond = lambda s: s != "" and not any(c.isascii() for c in s)
    flag = lambda x: str(x).lower()
    rules = [
        (not a or not b, 1, [ANY], f"empty input, byte lengths: {la} and {lb}"),
        (max(la, lb) > LARGE, 5, [ANY], f"over {LARGE} bytes, byte lengths: {la} and {lb}"),
        (la != lb, 2, [S.IDS["Hamming"]], f"unequal byte lengths: {la} and {lb}"),
        ((not na or not nb) and bool(a or b), 3, [S.IDS[n] for n in S.TOKEN_TIER], f"no tokens, counts: {na} and {nb}"),
        (beyond(a) or beyond(b), 4, [S.IDS[n] for n in S.ASCII_ONLY], f"no ASCII character: {flag(beyond(a))} and {flag(beyond(b))}"),
    ]
    return sorted((algo, kind, detail) for cond, kind, algos, detail in rules if cond for algo in algos)


def validate_rows(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row per warning beside the columns of ``df``."""
    return df.select("*", F.explode(validate(a, b)).alias("w")).select(*df.columns, "w.algorithm", "w.kind", "w.detail")


def kind_name(kind: Column) -> Column:
    return F.create_map(*[x for k, v in KINDS.items() for x in (F.lit(k), F.lit(v))])[kind]


def algorithm_name(algorithm: Column) -> Column:
    named = F.create_map(*[x for i, n in enumerate(S.NAMES) for x in (F.lit(i), F.lit(n))])
    return F.when(algorithm == ANY, F.lit("Any")).otherwise(F.coalesce(named[algorithm], F.concat(F.lit("AlgoID("), algorithm.cast("string"), F.lit(")"))))
