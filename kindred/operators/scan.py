"""The collection scan: similar pairs of names inside groups and across them.

Candidates come from equi-joins: small groups join on the group, larger ones on group and
shared token, pairs across groups on a shared token. Cheap suppression runs before the
join or right after it, each distinct pair of normalised names is scored once, and the
measures in the JVM rule out what can no longer reach the threshold before Python is asked.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.errors import InvalidConfig, InvalidItem, NilScorer
from ..functions.text import TokeniseOptions, tokenise
from .scorer import Scorer, default_scorer

#: Groups (and, across groups, collections) up to this size are compared pair by pair.
SMALL = 50
KINDS = {1: "WithinGroup", 2: "AcrossGroups"}


@dataclass(frozen=True)
class ScanConfig:
    scorer: Scorer | None = None
    compare_across_groups: bool = False
    cross_group_threshold_boost: float = 0.05
    compare_identical_across_groups: bool = False
    suppressed_pairs: tuple = field(default=())  # pairs of names, or a DataFrame of two columns
    exact: bool = False  # also compare names that have no token at all in groups over SMALL

    @staticmethod
    def default(scorer: Scorer | None = None) -> "ScanConfig":
        return ScanConfig(scorer or default_scorer())


def check_config(cfg: ScanConfig) -> None:
    if cfg.scorer is None:
        raise NilScorer("a scan needs a scorer")
    b = cfg.cross_group_threshold_boost
    if not isinstance(b, (int, float)) or not math.isfinite(b) or not 0 <= b <= 1:
        raise InvalidConfig("the boost must lie in [0, 1]")


def check_pairs(cfg: ScanConfig) -> None:
    if not isinstance(cfg.suppressed_pairs, DataFrame):
        bad = [i for i, p in enumerate(cfg.suppressed_pairs) if len(p) != 2 or not p[0] or not p[1]]
        if bad:
            raise InvalidConfig(f"suppressed pairs {bad} have an empty side")


def check_items(items: DataFrame, show: int = 20) -> None:
    """Raises for empty names and repeated (name, group); the message has places only, never names."""
    empty = F.coalesce(F.col("name"), F.lit("")) == ""
    named = items.groupBy("name", "group").agg(F.min("idx").alias("first"), F.count(F.lit(1)).alias("n")).filter(empty | (F.col("n") > 1))
    if not named.limit(1).count():
        return
    lost = [r["idx"] for r in items.filter(empty).select("idx").orderBy("idx").limit(show).collect()]
    again = [(r["first"], r["n"]) for r in named.filter(~empty).select("first", "n").orderBy("first").limit(show).collect()]
    raise InvalidItem(f"empty names at {lost}; repeated items (first place, count): {again}")


def _prepared(items: DataFrame, scorer: Scorer) -> DataFrame:
    """Items with normalised name, distinct tokens and the size of their group, silenced ones included in it."""
    norm = items.withColumn("norm", scorer.prepared("name")).withColumn("tokens", F.array_distinct(tokenise(F.col("norm"), TokeniseOptions())))
    sizes = items.groupBy("group").agg(F.count(F.lit(1)).alias("gsize"))
    return norm.join(sizes, "group")


def _sides(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    cols = ("idx", "norm", "group")
    return tuple(df.select(*[F.col(c).alias(f"{c}_{s}") for c in cols], *[c for c in df.columns if c == "tok"]) for s in "ab")


def candidates(prepared: DataFrame, cfg: ScanConfig, total: int) -> DataFrame:
    """(kind, idx_a, norm_a, idx_b, norm_b) to score: within a group the earlier item first, across the lesser group."""
    live = prepared.filter(~F.col("silence_lint"))
    out = ["idx_a", "norm_a", "group_a", "idx_b", "norm_b", "group_b"]
    a, b = _sides(live.filter(F.col("gsize") <= SMALL))
    small = a.join(b, (F.col("group_a") == F.col("group_b")) & (F.col("idx_a") < F.col("idx_b"))).select(*out)
    word = live.select("idx", "norm", "group", "gsize", F.explode("tokens").alias("tok"))
    if cfg.exact:
        bare = live.filter(F.size("tokens") == 0).select("idx", "norm", "group", "gsize", F.lit("").alias("tok"))
        word = word.unionByName(bare)
    a, b = _sides(word.filter(F.col("gsize") > SMALL))
    b = b.withColumnRenamed("tok", "tok_b")
    large = a.join(b, (F.col("group_a") == F.col("group_b")) & (F.col("tok") == F.col("tok_b")) & (F.col("idx_a") < F.col("idx_b"))).select(*out).distinct()
    found = small.unionByName(large).withColumn("kind", F.lit(1))
    if cfg.compare_across_groups:
        if total <= SMALL:
            a, b = _sides(live)  # at most SMALL rows a side
            cross = a.join(b, F.col("group_a") < F.col("group_b")).select(*out)
        else:
            a, b = _sides(word)
            b = b.withColumnRenamed("tok", "tok_b")
            cross = a.join(b, (F.col("tok") == F.col("tok_b")) & (F.col("group_a") < F.col("group_b"))).select(*out).distinct()
        if not cfg.compare_identical_across_groups:
            cross = cross.filter(F.col("norm_a") != F.col("norm_b"))
        found = found.unionByName(cross.withColumn("kind", F.lit(2)))
    return _unsuppressed(found, cfg)


def _unsuppressed(found: DataFrame, cfg: ScanConfig) -> DataFrame:
    pairs = cfg.suppressed_pairs
    if not isinstance(pairs, DataFrame):
        if not pairs:
            return found
        pairs = found.sparkSession.createDataFrame([tuple(p) for p in pairs], "p string, q string")
    pairs = pairs.toDF("p", "q").select(cfg.scorer.prepared("p").alias("p"), cfg.scorer.prepared("q").alias("q"))
    pairs = pairs.select(F.least("p", "q").alias("p"), F.greatest("p", "q").alias("q")).distinct()
    return found.join(pairs, (F.least("norm_a", "norm_b") == F.col("p")) & (F.greatest("norm_a", "norm_b") == F.col("q")), "left_anti")


def scored(found: DataFrame, cfg: ScanConfig) -> DataFrame:
    """Candidates at or above their threshold, with score and scores; each distinct pair of names is scored once."""
    s = cfg.scorer
    low = s.threshold
    pairs = found.select("norm_a", "norm_b").distinct()
    a, b = F.col("norm_a"), F.col("norm_b")
    # generated rows: filters stay above them, so no measure is computed in a filter and again in its projection
    pairs = pairs.select(F.inline(F.array(s.native_row(a, b, norm_a=a, norm_b=b))))
    native = {n: F.col(f"n_{n}") for n in s.native(a, b)}
    if native:
        pairs = pairs.filter(s.bound(native) >= F.lit(low))
    kernel = s.kernel(a, b)
    pairs = pairs.withColumn("k", kernel if kernel is not None else F.lit(None))
    each = s.assembled(native, F.col("k"))
    row = F.struct("norm_a", "norm_b", s.fold(each).alias("score"), F.map_from_arrays(s.names(), F.array(*each)).alias("scores"))
    pairs = pairs.select(F.inline(F.array(row))).filter(F.col("score") >= F.lit(low))
    within, across = F.lit(s.threshold), F.lit(min(1.0, s.threshold + cfg.cross_group_threshold_boost))
    return found.join(pairs, ["norm_a", "norm_b"]).filter(F.col("score") >= F.when(F.col("kind") == 1, within).otherwise(across))


def check(items: DataFrame, cfg: ScanConfig, validate_items: bool = True, sort: bool = True) -> DataFrame:
    """Warnings: kind, name_a, name_b, group_a, group_b, tag_a, tag_b, score, scores.

    ``items`` has idx, name, group, silence_lint and tag (see ``sources.items_from``). Names of a pair
    are put in byte order after scoring; rows come sorted by kind, names and groups.
    """
    check_config(cfg)
    if validate_items:
        check_items(items)
    check_pairs(cfg)
    total = items.count() if cfg.compare_across_groups else 0
    found = scored(candidates(_prepared(items, cfg.scorer), cfg, total), cfg)
    facts = lambda s: items.select(F.col("idx").alias(f"idx_{s}"), F.col("name").alias(f"name_{s}"), F.col("tag").alias(f"tag_{s}"))
    both = found.join(facts("a"), "idx_a").join(facts("b"), "idx_b")
    swap = F.col("name_a") > F.col("name_b")
    pick = lambda c, s, o: F.when(swap, F.col(f"{c}_{o}")).otherwise(F.col(f"{c}_{s}")).alias(f"{c}_{s}")
    kinds = F.create_map(*[x for k, v in KINDS.items() for x in (F.lit(k), F.lit(v))])
    out = both.select(F.col("kind").alias("kind_id"), kinds[F.col("kind")].alias("kind"), *[pick(c, s, o) for c in ("name", "group", "tag") for s, o in ("ab", "ba")], "score", "scores")
    if sort:
        out = out.orderBy("kind_id", "name_a", "name_b", "group_a", "group_b")
    return out.drop("kind_id")


def repeated_keys(warnings: DataFrame) -> DataFrame:
    """Sort keys that occur twice; a sound scan has none."""
    return warnings.groupBy("kind", "name_a", "name_b", "group_a", "group_b").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
