"""Mixing sources to target weights by iterative proportional fitting.

Token weights of the cells (source, language, topic) are raked to target marginals
until all three are met; each cell then gets an inclusion probability, capped at one and
calibrated so the expected tokens meet the budget. Documents are drawn by a hash of their
id, so the draw is the same on every run and every cluster. All of it is DataFrame
operations on a table of cells, which grows with the distinct labels and not with the
documents.

Topics come from the data: words that are neither rare nor common among all of a language's
documents are its anchors, dealt to the topics in turn, so every topic has words in every
language; a text belongs to the topic it holds most anchors of.
"""

from __future__ import annotations

import math
import warnings
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import drop_staged, fresh, staged


@dataclass(frozen=True)
class MixParams:
    #: Target shares by dimension and value. Values that are not named share what is left of one in
    #: proportion to their tokens; a dimension without any is flattened to shares ** temperature.
    targets: dict = field(default_factory=dict)
    temperature: float = 0.7
    budget_share: float = 0.8  # expected tokens kept, of all
    tolerance: float = 1e-4  # largest difference of a marginal from its target that counts as met
    rounds: int = 25  # at most; targets not met then are reported, as some cannot be
    seed: str = "mix"
    topics: int = 6
    topic_words: int = 4  # anchors of a topic in each language
    topic_languages: int = 16  # the most frequent ones have anchors
    topic_share: tuple = (0.02, 0.2)  # share of a language's documents in it that hold an anchor


DIMS = ("source", "lang", "topic")
NONE = "\u0000none"
#: White space between words, one for one turned into plain spaces.
_WHITE, _PLAIN = "\t\n\x0b\x0c\r", "     "


def _words(text: Column) -> Column:
    """The words of a text in lower case, without patterns (null: none)."""
    return F.array_remove(F.split(F.translate(F.lower(F.coalesce(text, F.lit(""))), _WHITE, _PLAIN), " "), "")


def n_tokens(text: Column) -> Column:
    """Words of the whole text."""
    return F.size(_words(text)).cast("long")


def anchors(docs: DataFrame, params: MixParams = MixParams()) -> list[tuple[str, int, float]]:
    """(word, topic, weight) of the anchors: lower-case words of letters, each language's most frequent ones within the bounds.

    Document counts are those of the whole table, every row with a text one document; they are combined
    before the shuffle. Only the anchors themselves go to the driver. The weight is the log of the inverse
    document share. A word that two languages share is the first one's.
    """
    lang = F.coalesce(F.col("lang").cast("string"), F.lit(NONE)).alias("lang")
    each = F.concat(F.array(F.lit("")), F.array_distinct(_words(F.col("text"))))  # the empty word counts the documents
    held = docs.filter("text IS NOT NULL").select(lang, F.explode(each).alias("word")).filter((F.col("word") == "") | F.col("word").rlike(r"^\p{Ll}{3,}$"))
    counts = staged(held.groupBy("lang", "word").agg(F.count(F.lit(1)).alias("df")), "topic-words")
    size = counts.filter("word = ''").select("lang", F.col("df").alias("n")).orderBy(F.col("n").desc(), "lang").limit(params.topic_languages)
    df = counts.filter("word <> ''").join(F.broadcast(size), "lang")  # topic_languages rows
    low, high = params.topic_share
    order = Window.partitionBy("lang").orderBy(F.col("df").desc(), "word")
    good = df.filter((F.col("df") >= F.greatest(F.lit(2.0), F.lit(low) * F.col("n"))) & (F.col("df") <= F.lit(high) * F.col("n")))
    top = good.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= params.topics * params.topic_words).select("lang", "word", "k", F.log(F.col("n") / F.col("df")).alias("weight")).collect()
    drop_staged(counts)
    found: dict = {}
    for r in sorted(top):
        found.setdefault(r.word, ((r.k - 1) % params.topics, r.weight))
    return [(w, t, x) for w, (t, x) in sorted(found.items())]


def topic(words: Column, found: list[tuple[str, int, float]]) -> Column:
    """The topic with the greatest weight of anchors in the words, ties to the first; ``other`` without any."""
    if not found:
        return F.lit("other")
    names = [w for w, _, _ in found]
    of = F.create_map(*[v for w, t, x in found for v in (F.lit(w), F.struct(F.lit(t).alias("t"), F.lit(float(x)).alias("x")))])
    hits = F.transform(F.filter(words, lambda w: w.isin(names)), lambda w: of[w])
    total = lambda h, t: F.aggregate(h, F.lit(0.0), lambda a, v: a + F.when(v["t"] == t, v["x"]).otherwise(F.lit(0.0)))
    best = lambda h: F.array_max(F.array(*[F.struct(total(h, F.lit(t)).alias("x"), F.lit(-t).alias("t")) for t in sorted({t for _, t, _ in found})]))["t"]
    pick = F.get(F.transform(F.array(hits), lambda h: F.when(F.size(h) > 0, F.concat(F.lit("topic"), (-best(h)).cast("string")))), F.lit(0))
    return F.coalesce(pick, F.lit("other"))


def keys(docs: DataFrame, found: list[tuple[str, int, float]]) -> Column:
    """struct(source, lang, topic, tokens) of a document; the words are cut once."""
    label = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(NONE))
    both = F.get(F.transform(F.array(_words(F.col("text"))), lambda w: F.struct(F.size(w).cast("long").alias("tokens"), topic(w, found).alias("topic"))), F.lit(0))
    return F.get(F.transform(F.array(both), lambda b: F.struct(label("source").alias("source"), label("lang").alias("lang"), b["topic"].alias("topic"), b["tokens"].alias("tokens"))), F.lit(0))


def _goal(cells: DataFrame, dim: str, params: MixParams) -> DataFrame:
    """(dim, goal) shares that sum to one over the values present."""
    by = cells.groupBy(dim).agg(F.sum("tokens").cast("double").alias("t"))
    given = params.targets.get(dim)
    if given:
        named = F.col(dim).isin(list(given))
        want = F.create_map(*[x for k, v in given.items() for x in (F.lit(k), F.lit(float(v)))])[F.col(dim)]
        rest = by.agg(F.sum(F.when(~named, F.col("t")).otherwise(F.lit(0.0))).alias("rest"))
        left = F.lit(max(0.0, 1.0 - sum(given.values())))
        raw = by.join(F.broadcast(rest)).select(dim, F.when(named, want).when(F.col("rest") > 0, left * F.col("t") / F.col("rest")).otherwise(F.lit(0.0)).alias("goal"))  # one row broadcast
        raw = raw.join(by, dim).select(dim, F.when(F.col("t") > 0, F.col("goal")).otherwise(F.lit(0.0)).alias("goal"))
    else:
        raw = by.select(dim, F.pow(F.col("t"), F.lit(params.temperature)).alias("goal"))
    total = raw.agg(F.sum("goal").alias("all"))
    return raw.join(F.broadcast(total)).select(dim, F.when(F.col("all") > 0, F.col("goal") / F.col("all")).otherwise(F.lit(0.0)).alias("goal"))  # one row broadcast


def rake(cells: DataFrame, params: MixParams) -> tuple[DataFrame, float]:
    """Cells with ``w``, shares of tokens that meet the three target marginals, and the largest difference that is left.

    Each round scales by one marginal after the other; sums are grouped by map-side combining
    over cells. Targets that no weights can meet (a value without cells of its own) end at
    the round limit, with a warning.
    """
    now = staged(cells.withColumn("w", F.col("tokens").cast("double")), "cells")
    files = now.count() // 100_000 + 1
    goals = {d: staged(_goal(now, d, params), f"goal-{d}", files) for d in DIMS}
    off = 0.0
    for i in range(params.rounds):
        for d in DIMS:
            sums = now.groupBy(d).agg(F.sum("w").alias("s"))
            scale = sums.join(goals[d], d).select(d, F.when(F.col("s") > 0, F.col("goal") / F.col("s")).otherwise(F.lit(0.0)).alias("f"))
            prev, now = now, staged(now.join(scale, d).select(*DIMS, "tokens", "docs", (F.col("w") * F.col("f")).alias("w")), f"raked-{i}-{d}", files)
            drop_staged(prev)
        each = [now.groupBy(d).agg(F.sum("w").alias("s")).join(goals[d], d).select(F.abs(F.col("s") - F.col("goal")).alias("off")) for d in DIMS[:-1]]  # the last is met
        before, off = off, each[0].unionByName(each[1]).agg(F.max("off")).first()[0] or 0.0
        if off <= params.tolerance or (i > 3 and off > 0.98 * before):  # met, or as near as it gets
            break
    if off > params.tolerance:
        warnings.warn(f"target marginals are not met: the largest difference is {off:.3g} after {i + 1} rounds", stacklevel=2)
    drop_staged(*goals.values())
    return now, off


def probabilities(raked: DataFrame, params: MixParams) -> DataFrame:
    """Cells with ``prob``: min(1, c * w / tokens), c such that expected tokens meet the budget.

    c is exact: cells that it takes whole are set aside and c is taken again from the rest of the
    budget and of the weights, until no further cell is whole; each step is one aggregation.
    """
    ratio = F.when(F.col("tokens") > 0, F.col("w") / F.col("tokens")).otherwise(F.lit(0.0))
    r = raked.withColumn("r", ratio)
    budget = (r.agg(F.sum("tokens").cast("double")).first()[0] or 0.0) * params.budget_share
    c, whole = 0.0, -1
    while True:
        full = F.lit(c) * F.col("r") >= 1
        t, w, n = r.agg(F.sum(F.when(full, F.col("tokens")).otherwise(F.lit(0))).cast("double"), F.sum(F.when(full, F.lit(0.0)).otherwise(F.col("w"))), F.sum(full.cast("int"))).first()
        if (n or 0) == whole or not w or w <= 1e-15:
            break
        whole, c = n, max(c, (budget - t) / w)
    p = F.when(F.col("tokens") == 0, F.lit(params.budget_share)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.lit(c) * F.col("r"))))
    return r.withColumn("prob", p)


def draw(id_col: Column, seed: str) -> Column:
    """A number in [0, 1) from the id and the seed: 52 bits of MD5."""
    h = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(id_col.cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(h, 1, 13), 16, 10).cast("double") / F.lit(float(16**13))


def fitted(keyed: DataFrame, key: str, params: MixParams) -> DataFrame:
    """Cells of the key structs of documents with prob, weight (raked share over plain share) and what is left to the targets."""
    cells = keyed.groupBy(*[F.col(f"{key}.{d}").alias(d) for d in DIMS]).agg(F.sum(f"{key}.tokens").alias("tokens"), F.count(F.lit(1)).alias("docs"))
    raked, off = rake(cells, params)
    done = probabilities(raked, params)
    total = done.agg(F.sum("tokens").cast("double").alias("all_t"))
    weight = F.when(F.col("tokens") > 0, F.col("w") * F.col("all_t") / F.col("tokens")).otherwise(F.lit(1.0))
    out = staged(done.join(F.broadcast(total)).select(*DIMS, "prob", weight.alias("weight"), F.lit(float(off)).alias("off")), "fitted")  # one row broadcast
    drop_staged(raked)
    return out


def mixed(keyed: DataFrame, key: str, params: MixParams) -> DataFrame:
    """``keyed`` documents beside ``cell``, a struct of topic, tokens, weight, prob, off and selected."""
    (cell,) = fresh(keyed, "cell")
    s, t, u = fresh(keyed, "_source", "_lang", "_topic")
    cells = fitted(keyed, key, params).select(F.col("source").alias(s), F.col("lang").alias(t), F.col("topic").alias(u), F.struct("weight", "prob", "off").alias(cell))
    on = (F.col(f"{key}.source") == F.col(s)) & (F.col(f"{key}.lang") == F.col(t)) & (F.col(f"{key}.topic") == F.col(u))
    k, c = F.col(key), F.col(cell)
    full = F.struct(k["topic"].alias("topic"), k["tokens"].alias("tokens"), c["weight"].alias("weight"), c["prob"].alias("prob"), c["off"].alias("off"), (draw(F.col("doc_id"), params.seed) < c["prob"]).alias("selected"))
    return keyed.join(cells, on).withColumn(cell, full).drop(s, t, u, key).withColumnRenamed(cell, "cell" if "cell" not in keyed.columns else cell)


def mix_sources(docs: DataFrame, params: MixParams = MixParams()) -> DataFrame:
    """``docs`` with ``cell`` (underscores before it if they have such a column): struct of topic, tokens, weight, prob, off, selected.

    ``weight`` is the cell's raked share over its plain share, so weighting documents by it
    meets the targets; ``off`` is the largest difference that is left to a target. Null labels are
    a value of their own. Texts without words carry no tokens and are drawn at the budget's
    share. Rows that repeat an id are drawn alike. An empty table gives an empty one.
    """
    (key,) = fresh(docs, "_key")
    return mixed(docs.withColumn(key, keys(docs, anchors(docs, params))), key, params)


def mix_report(docs: DataFrame, params: MixParams = MixParams()) -> DataFrame:
    """One row per document without its text: doc_id and the fields of ``cell``. The words of every text are counted once."""
    slim = staged(docs.select("doc_id", keys(docs, anchors(docs, params)).alias("key")), "mix-keys")
    return mixed(slim, "key", params).select("doc_id", "cell.*")
