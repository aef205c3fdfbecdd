"""Quality rules: word and line statistics plus a learned decision list.

The statistics and the verdict are Spark expressions alone. The list is learned
by sequential covering on labelled statistics: grow a conjunction of thresholds
on two thirds of the rows, prune it on the rest, keep it while it is precise, take
what it covers away, repeat. It is applied as one ordered CASE expression.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE

#: Characters that count as symbols, as the output contract fixes them.
SYMBOLS = "#*$%&|<>"

#: Statistics the learner may put thresholds on, all per word or per line so that length alone decides nothing.
FEATURES = ("symbol_ratio", "mean_word_chars", "dup_line_ratio", "repeat_word_ratio", "upper_ratio", "bar_ratio", "distinct_word_ratio")


@dataclass(frozen=True)
class RuleParams:
    max_fit_rows: int = 20_000  # bound of the labelled sample that is fitted on the driver
    bins: int = 24  # candidate thresholds per statistic
    max_terms: int = 3  # thresholds in one rule
    max_rules: int = 12
    min_precision: float = 0.9  # of a rule, on rows it was not grown on
    min_cover: int = 4  # low-quality rows a rule must cover


@dataclass(frozen=True)
class Rule:
    terms: tuple[tuple[str, str, float], ...]  # (statistic, "<=" or ">", threshold)
    keep: bool

    def __str__(self) -> str:
        return " AND ".join(f"{f} {op} {t:.6g}" for f, op, t in self.terms) + f" -> {'keep' if self.keep else 'drop'}"


@dataclass(frozen=True)
class DecisionList:
    rules: tuple[Rule, ...] = field(default_factory=tuple)
    default: bool = True

    def column(self, features: dict[str, Column]) -> Column:
        """The list as an ordered conditional expression; the first rule that holds decides."""
        out = None
        for rule in self.rules:
            cond = None
            for f, op, t in rule.terms:
                one = features[f] <= F.lit(t) if op == "<=" else features[f] > F.lit(t)
                cond = one if cond is None else cond & one
            out = F.when(cond, F.lit(rule.keep)) if out is None else out.when(cond, F.lit(rule.keep))
        return F.lit(self.default) if out is None else out.otherwise(F.lit(self.default))


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_position_bits: int = 4) -> DataFrame:
    """``doc_id``, the base counts and the learner's statistics of every whole text.

    A null text counts as an empty one: all counts 0, ratios 0. ``n_repeat_words``
    counts words inside five-word windows that occur twice or more in the text: the
    window hashes are sorted with their positions in the low bits (as many as the text needs,
    ``min_position_bits`` at least), so a repeated window is one whose neighbour has the same high
    bits; covered words are gaps between positions, at most 5 each. Neighbours with the same
    high bits are compared word by word; where any two differ, the windows of that text
    are sorted as strings instead, so the count is exact.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).alias("doc_id"), text.alias("_t"))
    one = base.select(
        "doc_id",
        "_t",
        F.split(F.regexp_replace("_t", rf"^{SPACE}+|{SPACE}+$", ""), rf"{SPACE}+").alias("_w0"),
        F.filter(F.split("_t", "\n"), lambda s: s.rlike(r"[^\x20\x09-\x0D]")).alias("_l"),
        F.length(F.regexp_replace("_t", f"[^{SYMBOLS}]+", "")).cast("long").alias("n_symbols"),
        F.length(F.regexp_replace("_t", rf"{SPACE}+", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("_t", r"[^A-Z]+", "")).alias("_up"),
        F.length(F.regexp_replace("_t", r"[^|]+", "")).alias("_bar"),
    )
    # an all-blank text splits into one empty word
    two = one.select(
        "doc_id", "_w0", "n_symbols", "word_chars", "_up", "_bar",
        F.when(F.col("word_chars") == 0, F.lit(0)).otherwise(F.size("_w0")).alias("_n"),
        F.transform("_w0", lambda w: F.xxhash64(w)).alias("_h"),
        F.size("_l").alias("_nl"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
    )
    three = two.withColumn("_b", F.greatest(F.lit(min_position_bits), F.ceil(F.log2(F.col("_n") + 1)).cast("int")))
    # sorted (window hash, position), the position in the low _b bits
    packed = F.expr(
        "CASE WHEN _n >= 6 THEN sort_array(transform(sequence(0, _n - 5), i -> "
        "shiftleft(shiftright(xxhash64(_h[i], _h[i + 1], _h[i + 2], _h[i + 3], _h[i + 4]), _b), _b) | cast(i AS bigint))) "
        "ELSE cast(array() AS array<bigint>) END"
    )
    four = three.withColumn("_s", packed)
    place = "cast({0} & (shiftleft(1L, _b) - 1L) AS int)"
    same = " AND ".join(f"_w0[{place.format('_s[j]')} + {d}] = _w0[{place.format('_s[j - 1]')} + {d}]" for d in range(5))
    collide = f"size(_s) > 1 AND exists(sequence(1, greatest(1, size(_s) - 1)), j -> shiftright(_s[j], _b) = shiftright(_s[j - 1], _b) AND NOT ({same}))"
    five = four.withColumn("_c", F.expr(collide))
    hashed = (
        "sort_array(transform(filter(sequence(0, size(_s) - 1), j -> "
        "(j > 0 AND shiftright(_s[j], _b) = shiftright(_s[greatest(j - 1, 0)], _b)) OR "
        "(j < size(_s) - 1 AND shiftright(_s[j], _b) = shiftright(_s[least(j + 1, size(_s) - 1)], _b))), "
        "j -> _s[j] & (shiftleft(1L, _b) - 1L)))"
    )
    spelled = (
        "transform(array(sort_array(transform(sequence(0, _n - 5), i -> struct(concat_ws(' ', _w0[i], _w0[i + 1], _w0[i + 2], _w0[i + 3], _w0[i + 4]) AS g, cast(i AS bigint) AS i)))), v -> "
        "sort_array(transform(filter(sequence(0, size(v) - 1), j -> (j > 0 AND v[j].g = v[greatest(j - 1, 0)].g) OR (j < size(v) - 1 AND v[j].g = v[least(j + 1, size(v) - 1)].g)), j -> v[j].i)))[0]"
    )
    six = five.withColumn("_p", F.expr(f"CASE WHEN size(_s) < 2 THEN cast(array() AS array<bigint>) WHEN _c THEN {spelled} ELSE {hashed} END")).withColumn("_d", F.size(F.array_distinct("_h")))
    covered = F.expr(
        "CASE WHEN size(_p) = 0 THEN 0L ELSE 5L + aggregate(sequence(1, size(_p)), 0L, (a, j) -> "
        "a + CASE WHEN j < size(_p) THEN least(5L, _p[least(j, size(_p) - 1)] - _p[j - 1]) ELSE 0L END) END"
    )
    counts = F.struct(
        "doc_id", F.col("_n").cast("long").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", covered.alias("n_repeat_words"),
        F.col("_nl").alias("_nl"), F.col("_up").alias("_up"), F.col("_bar").alias("_bar"), F.col("_d").alias("_d"),
    )
    # a generated row: filters on the result stay above it and don't repeat the array expressions
    done = six.select(F.inline(F.array(counts)))
    n = F.col("n_words").cast("double")
    over = lambda a: F.when(F.col("n_words") > 0, a.cast("double") / n).otherwise(F.lit(0.0))
    chars = F.when(F.col("word_chars") > 0, F.col("word_chars").cast("double")).otherwise(F.lit(1.0))
    return done.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        over(F.col("n_symbols")).alias("symbol_ratio"),
        over(F.col("word_chars")).alias("mean_word_chars"),
        F.when(F.col("_nl") > 0, F.col("n_dup_lines").cast("double") / F.col("_nl")).otherwise(F.lit(0.0)).alias("dup_line_ratio"),
        over(F.col("n_repeat_words")).alias("repeat_word_ratio"),
        (F.col("_up").cast("double") / chars).alias("upper_ratio"),
        over(F.col("_bar")).alias("bar_ratio"),
        over(F.col("_d")).alias("distinct_word_ratio"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def labelled_sample(docs: DataFrame, labels: DataFrame, params: RuleParams) -> list[tuple]:
    """At most ``max_fit_rows`` labelled documents' statistics and label, chosen by hash of the id."""
    ids = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(params.max_fit_rows)
    few = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")  # bounded by max_fit_rows
    s = statistics(few).join(F.broadcast(ids), "doc_id")
    return [tuple(r) for r in s.filter(~base_failed()).select("doc_id", *FEATURES, (F.col("quality") <= 0).alias("low")).collect()]


def learn(rows: list[tuple], params: RuleParams = RuleParams()) -> DecisionList:
    """Sequential covering over ``(id, *FEATURES, low)`` rows; no rows or one class only: keep all."""
    rows = sorted(rows, key=lambda r: (str(r[0]),))
    if not rows or len({r[-1] for r in rows}) < 2:
        return DecisionList()
    values = {f: sorted({r[1 + i] for r in rows}) for i, f in enumerate(FEATURES)}
    cuts = {f: _cuts(v, params.bins) for f, v in values.items()}
    grow = [r for k, r in enumerate(rows) if k % 3 < 2]
    prune = [r for k, r in enumerate(rows) if k % 3 == 2]
    rules = []
    while len(rules) < params.max_rules and any(r[-1] for r in grow):
        terms, cover = [], grow
        while len(terms) < params.max_terms and any(not r[-1] for r in cover):
            best = _best_term(cover, cuts, params)
            if best is None:
                break
            terms.append(best)
            cover = [r for r in cover if _holds(r, best)]
        terms = _pruned(terms, prune)
        held = [r for r in prune if all(_holds(r, t) for t in terms)] if terms else []
        low = sum(r[-1] for r in held)
        grown = [r for r in grow if all(_holds(r, t) for t in terms)] if terms else []
        if not terms or sum(r[-1] for r in grown) < params.min_cover or low < params.min_precision * max(1, len(held)):
            break
        rules.append(Rule(tuple(terms), False))
        grow = [r for r in grow if not all(_holds(r, t) for t in terms)]
        prune = [r for r in prune if not all(_holds(r, t) for t in terms)]
    return DecisionList(tuple(rules), True)


def _cuts(v: list[float], bins: int) -> list[float]:
    """Midpoints between neighbouring quantiles of the distinct values."""
    if len(v) < 2:
        return []
    at = sorted({round(i * (len(v) - 1) / bins) for i in range(bins + 1)})
    q = [v[i] for i in at]
    return [(a + b) / 2 for a, b in zip(q, q[1:])]


def _holds(r: tuple, term: tuple[str, str, float]) -> bool:
    x = r[1 + FEATURES.index(term[0])]
    return x <= term[2] if term[1] == "<=" else x > term[2]


def _best_term(cover: list[tuple], cuts: dict, params: RuleParams):
    """The threshold with the largest information gain in FOIL's sense; None if none helps."""
    import math

    p, n = sum(r[-1] for r in cover), len(cover)
    base, best, gain = math.log2(p / n) if p else 0.0, None, 1e-9
    for i, f in enumerate(FEATURES):
        order = sorted((r[1 + i], r[-1]) for r in cover)
        k = low = 0
        for t in cuts[f]:
            while k < n and order[k][0] <= t:
                low += order[k][1]
                k += 1
            for op, pp, nn in (("<=", low, k), (">", p - low, n - k)):
                if pp >= params.min_cover and nn < n:
                    g = pp * (math.log2(pp / nn) - base)
                    if g > gain:
                        best, gain = (f, op, t), g
    return best


def _pruned(terms: list, rows: list[tuple]) -> list:
    """Drop trailing terms while precision on held-back rows does not fall."""
    def worth(ts):
        held = [r for r in rows if all(_holds(r, t) for t in ts)]
        p = sum(r[-1] for r in held)
        return (p - (len(held) - p)) / len(held) if held else -1.0

    while len(terms) > 1 and worth(terms[:-1]) >= worth(terms):
        terms = terms[:-1]
    return terms


def apply_rules(docs: DataFrame, rules: DecisionList) -> DataFrame:
    """One row per document: ids, base counts, ``base_failed`` and ``kept``.

    Null or empty texts have no words and so fail the base test. Repeated rows give repeated rows,
    an empty table none; other columns take no part.
    """
    s = statistics(docs)
    failed = base_failed()
    verdict = rules.column({f: F.col(f) for f in FEATURES})
    return s.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"),
        F.when(failed, F.lit(False)).otherwise(verdict).alias("kept"),
    )


def quality_rules(docs: DataFrame, labels: DataFrame, params: RuleParams = RuleParams()) -> DataFrame:
    """Learn the list on labelled rows, then judge every document.

    Labels that are null, of no document or of one class only teach nothing; of an id with several
    labels the largest counts.
    """
    return apply_rules(docs, learn(labelled_sample(docs, labels, params), params))
