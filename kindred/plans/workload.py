"""Generated names for measurements: two or three of 58 words in one of four writings.

The shape of the published benchmark: items in groups of equal size. Names come from a hash
of the item's number, so any number of them is made where it is read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import similarity as sim
from ..operators import scan
from ..operators.scorer import default_scorer
from ..sources import items_from

WORDS = (
    "account address amount batch billing branch bucket budget buyer carrier catalog channel city client code contact country created currency customer "
    "date delivery device discount email event export factor first freight group image index invoice item label last ledger limit list market name number "
    "order parent payment phone price product quantity region report seller session state status total user"
).split()


def _word(i: Column, salt: int) -> Column:
    words = F.array(*[F.lit(w) for w in WORDS])
    return F.get(words, F.pmod(F.xxhash64(i, F.lit(salt)), F.lit(len(WORDS))).cast("int"))


def name(i: Column, salt: int = 0) -> Column:
    """Snake, camel, kebab or Pascal case, by the number."""
    parts = F.array(_word(i, salt), _word(i, salt + 1), F.when(F.pmod(F.xxhash64(i, F.lit(salt + 2)), F.lit(3)) == 0, _word(i, salt + 3)))
    parts = F.filter(parts, lambda w: w.isNotNull())
    cap = lambda p: F.array_join(F.transform(p, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2)))), "")
    camel = F.concat(F.get(parts, F.lit(0)), cap(F.slice(parts, 2, 2)))
    style = F.pmod(F.xxhash64(i, F.lit(salt + 4)), F.lit(4))
    return F.when(style == 0, F.array_join(parts, "_")).when(style == 1, camel).when(style == 2, F.array_join(parts, "-")).otherwise(cap(parts))


def items(spark: SparkSession, n: int, groups: int) -> DataFrame:
    """About ``n`` items (repeated names of a group once) in ``groups`` groups."""
    i = F.col("id")
    rows = spark.range(n).select(name(i).alias("name"), F.concat(F.lit("g"), (i % groups).cast("string")).alias("grp"), "id")
    return items_from(rows.groupBy("name", "grp").agg(F.min("id").alias("id")), "name", "grp", order="id")


def pairs(spark: SparkSession, n: int) -> DataFrame:
    """``n`` pairs of names that share their first word one time in four."""
    i = F.col("id")
    return spark.range(n).select(name(i).alias("a"), F.when(i % 4 == 0, name(i, 1)).otherwise(name(i, 9)).alias("b"))


def _scan(n: int, groups: int, across: bool = False):
    return lambda spark, sf_dir: scan.check(items(spark, n, groups), scan.ScanConfig(default_scorer(), compare_across_groups=across))


def _score(f, n: int):
    return lambda spark, sf_dir: pairs(spark, n).select("a", "b", f(F.col("a"), F.col("b")).alias("value"))


#: By name: what the published figures measure, and a million pairs of single measures.
WORKLOADS = {
    "names_10k_in_500": _scan(10_000, 500),
    "names_10k_in_50": _scan(10_000, 50),
    "names_2k_in_100_across": _scan(2_000, 100, True),
    "names_100k_in_5k": _scan(100_000, 5_000),
    "levenshtein_1m": _score(sim.levenshtein_score, 1_000_000),
    "q_gram_jaccard_1m": _score(sim.q_gram_jaccard_score, 1_000_000),
    "jaro_winkler_1m": _score(sim.jaro_winkler_score, 1_000_000),
    "damerau_full_200k": _score(sim.damerau_score, 200_000),
    "monge_elkan_200k": _score(sim.monge_elkan_score, 200_000),
    "default_score_200k": _score(lambda a, b: default_scorer().score(a, b), 200_000),
}
