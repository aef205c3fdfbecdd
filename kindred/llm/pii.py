"""Personal data by candidate gradient boosting, in Spark expressions.

Base patterns with checks give sure spans. Beside them, loose generators propose
overlapping candidates; boosted trees over format and context features score these, and
a calibrated threshold selects what is redacted besides. The trees are learnt in two views
on a bounded sample. Those over the format of a candidate learn from evidence outside it:
a checked base span that covers it (its sign, check digit or ranges are no features) or a
name and an equals sign before it. Those over its context learn what the first ones say.
Trees and features are Spark expressions, so scoring never leaves the JVM, and work is
linear in a text: places are running sums, overlaps are found in one sweep.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Base patterns by kind, in output order. Starts inside a run that a longer match would cover
#: are ruled out and loops are possessive: the same matches, in linear time and without recursion.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a pattern to be tried at all.
HINT = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){15}", "phone": r"\+[0-9]"}
#: Loose generators: recall first; the trees decide.
LOOSE = {
    "email": r"[A-Za-z0-9._%+-]{1,64}(?:\x20?[\[(](?:at|AT)[\])]\x20?|@)[A-Za-z0-9-]{1,63}(?:(?:\.|\x20?[\[(](?:dot|DOT)[\])]\x20?)[A-Za-z0-9-]{1,63})++",
    "phone": r"(?<![0-9A-Za-z])\(?[0-9]{2,4}\)?(?:[\x20.-][0-9]{2,4}){2,4}(?![0-9A-Za-z])",
    "secret": r"(?<![A-Za-z0-9_/+-])[A-Za-z0-9_/+-]{16,}+",
}
LOOSE_HINT = {"email": r"@|[\[(](?:at|AT)[\])]", "phone": r"[0-9]{2}\)?[\x20.-][0-9]{2}", "secret": r"[A-Za-z0-9_/+-]{16}"}
ORDER = ("email", "ip", "card", "phone", "secret")
FORMAT = ("kind", "chars", "digit_share", "upper_share", "vowel_share", "distinct_share", "switches", "groups", "dots", "dashes", "at", "parens")
CONTEXT = ("cue", "named", "assigned", "quote_before", "quote_after", "bracket_before", "space_before", "letter_before", "end_after", "letter_after")
FEATURES = FORMAT + CONTEXT
CUE = r"(?i)(mail|contact|write|tel|phone|call|fax|mobile|token|secret|passw|api|key|auth)"
LABEL = r"(?i)(token|secret|passw\w*|api_?key|key|auth\w*|tel\w*|phone|fax|mail)\s*[=:]\s*[\"']?$"
#: Ends of matches in a marked text, and what stands for the text's own ones.
_MARK, _OWN = "\u0001", "\u0002"


@dataclass(frozen=True)
class PiiParams:
    sample_docs: int = 3000  # bound of the sample the trees are fitted on
    max_rows: int = 12_000  # bound of its candidates of each kind, chosen by hash
    rounds: int = 24  # trees of each view
    rate: float = 0.3
    precision: float = 0.98  # the threshold is the lowest that keeps this on held-back rows


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once, however often and in whatever lambda the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _scan(values: Column, zero: Column, step: Callable, total: Callable | None = None) -> Column:
    """Running states of a fold over ``values``: step(state, x); ``total`` folds a whole block from a state, by steps if not given.

    Blocks of about the square root of the size are folded from the state they start with,
    so no array that grows by one element gets long.
    """
    total = total or (lambda a, c: F.aggregate(c, a, step))
    size = lambda v: F.greatest(F.lit(64), F.ceil(F.sqrt(F.size(v)))).cast("int")
    cut = lambda v, n: F.transform(F.sequence(F.lit(0), F.ceil(F.size(v) / n).cast("int") - 1), lambda i: F.slice(v, i * n + 1, n))

    def run(b: Column) -> Column:
        first = F.aggregate(b, F.array(zero), lambda a, c: F.array_append(a, total(F.element_at(a, -1), c)))
        inner = lambda c, z: F.aggregate(c, F.array(z), lambda a, x: F.array_append(a, step(F.element_at(a, -1), x)), lambda a: F.slice(a, 2, F.size(a) - 1))
        return F.flatten(F.zip_with(b, F.slice(first, 1, F.size(b)), inner))

    return _let(_let(values, lambda v: _let(size(v), lambda n: cut(v, n))), run)


def _located(pattern: str, hint: str, context: bool = False) -> Column:
    """Array of (s, e, m) of the leftmost non-overlapping matches in ``_t``, in code points; with context also (b, a), the text around.

    The matches are marked and the text is cut at the marks, so matches and the gaps between
    them alternate, and places are running sums of lengths.
    """
    t = F.col("_t")
    cut = F.split(F.regexp_replace(t, F.lit(pattern), F.lit(f"{_MARK}$0{_MARK}")), _MARK)

    def pair(p: Column) -> Callable:
        def one(k: Column) -> Column:
            gap, m = F.get(p, 2 * k), F.get(p, 2 * k + 1)
            around = [F.right(gap, F.lit(24)).alias("b"), F.left(F.get(p, 2 * k + 2), F.lit(8)).alias("a")] if context else []
            return F.struct((F.length(gap)).alias("s"), F.length(m).alias("e"), m.alias("m"), *around)

        return one

    fields = ("m", "b", "a") if context else ("m",)
    pairs = _let(cut, lambda p: F.transform(F.sequence(F.lit(0), F.floor((F.size(p) - 3) / 2).cast("int")), pair(p)))
    zero = F.struct(F.lit(0).alias("s"), F.lit(0).alias("e"), *[F.lit("").alias(f) for f in fields])
    place = lambda a, x: F.struct((a["e"] + x["s"]).alias("s"), (a["e"] + x["s"] + x["e"]).alias("e"), *[x[f].alias(f) for f in fields])
    total = lambda a, c: F.struct(F.lit(0).alias("s"), (a["e"] + F.aggregate(c, F.lit(0), lambda n, x: n + x["s"] + x["e"])).alias("e"), *[F.lit("").alias(f) for f in fields])
    empty = F.expr("cast(array() AS array<struct<s:int,e:int," + ",".join(f"{f}:string" for f in fields) + ">>)")
    found = _let(pairs, lambda v: _scan(v, zero, place, total))
    return F.when(t.rlike(hint) & t.rlike(pattern), found).otherwise(empty)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(m: Column) -> Column:
    d = F.reverse(_digits(m))
    each = F.transform(F.split(d, ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.when(c.cast("int") > 4, 2 * c.cast("int") - 9).otherwise(2 * c.cast("int"))))
    return F.aggregate(each, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def _valid(kind: str, m: Column) -> Column:
    n = F.length(_digits(m))
    if kind == "ip":
        part = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
        return m.rlike(rf"^{part}\.{part}\.{part}\.{part}$")
    if kind == "card":
        return F.when((n >= 16) & (n <= 19), _luhn(m)).otherwise(F.lit(False))
    if kind == "phone":
        return (n >= 8) & (n <= 15)
    return F.lit(True)


def _checked(kind: str):
    return lambda x: _valid(kind, x["m"])


def base_spans(docs: DataFrame) -> DataFrame:
    """doc_id, _t and one array of (s, e, m) per base kind."""
    t = F.coalesce("text", F.lit(""))
    out = docs.select("doc_id", F.when(t.contains(_MARK), F.translate(t, _MARK, _OWN)).otherwise(t).alias("_t"))
    return out.select("doc_id", "_t", *[F.filter(_located(p, HINT[k]), _checked(k)).alias(f"_b_{k}") for k, p in BASE.items()])


def _features(kind: str, x: Column) -> Column:
    """Array of numbers, in the order of FEATURES, about a candidate and the text around it."""
    m, before, after = x["m"], x["b"], x["a"]
    n = F.length(m)
    left = lambda chars: F.length(F.regexp_replace(m, f"[^{chars}]", ""))
    num = lambda c: F.when(c, F.lit(1.0)).otherwise(F.lit(0.0))
    of = {
        "kind": F.lit(float(ORDER.index(kind))),
        "chars": n,
        "digit_share": left("0-9") / n,
        "upper_share": left("A-Z") / n,
        "vowel_share": left("aeiouAEIOU") / n,
        "distinct_share": F.size(F.array_distinct(F.split(F.left(m, F.lit(64)), ""))) / F.least(n, F.lit(64)),
        "switches": F.length(F.regexp_replace(F.regexp_replace(m, "[A-Za-z]+", "a"), "[^a]+", "")) / n,
        "groups": F.size(F.split(m, r"[^0-9A-Za-z]+")),
        "dots": left("."),
        "dashes": left("-_/+"),
        "at": num(m.contains("@")),
        "parens": num(m.rlike(r"[(\[]")),
        "cue": num(before.rlike(CUE)),
        "named": num(before.rlike(LABEL)),
        "assigned": num(before.rlike("[=:]\\s*[\"']?$")),
        "quote_before": num(before.rlike("[\"']$")),
        "quote_after": num(after.rlike("^[\"']")),
        "bracket_before": num(before.rlike(r"[(\[{<]$")),
        "space_before": num((before == "") | before.rlike(r"\s$")),
        "letter_before": num(before.rlike(r"[A-Za-z],?\s+$")),
        "end_after": num((after == "") | after.rlike(r"^[.!?]?(\s|$)")),
        "letter_after": num(after.rlike(r"^\s+[A-Za-z]")),
    }
    return F.array(*[of[f].cast("double") for f in FEATURES])


def _covered(spans: Column) -> Column:
    """``spans`` by place, each as struct(x, covered): whether it is a base span or overlaps one."""
    low, high = F.lit(-1), F.lit(2**31 - 1)
    ends = lambda v: _scan(v, low, lambda a, x: F.when(x["base"], F.greatest(a, x["e"])).otherwise(a))
    starts = lambda v: F.reverse(_scan(F.reverse(v), high, lambda a, x: F.when(x["base"], F.least(a, x["s"])).otherwise(a)))
    one = lambda v: F.zip_with(v, F.arrays_zip(ends(v).alias("far"), starts(v).alias("near")), lambda x, r: F.struct(x.alias("x"), (x["base"] | (r["far"] > x["s"]) | (r["near"] < x["e"])).alias("covered")))
    none = F.filter(F.transform(spans, lambda x: F.struct(x.alias("x"), F.lit(True).alias("covered"))), lambda x: F.lit(False))
    return _let(F.array_sort(spans), lambda v: F.when(F.size(v) > 0, one(v)).otherwise(none))


def _merged(spans: Column) -> Column:
    """(s, e, r, k) of the runs of overlapping spans, by place, with the least (r, k) of each."""
    shape = lambda s, e, best: F.struct(s.alias("s"), e.alias("e"), best["r"].alias("r"), best["k"].alias("k"))
    best = lambda x: F.struct(x["r"].alias("r"), x["k"].alias("k"))
    step = lambda a, x: F.when(x["s"] < a["e"], shape(a["s"], F.greatest(a["e"], x["e"]), F.least(best(a), best(x)))).otherwise(shape(x["s"], x["e"], best(x)))
    zero = F.expr("named_struct('s', -1, 'e', -1, 'r', 0D, 'k', 0)")
    last = lambda states, v: F.transform(F.filter(F.zip_with(states, F.slice(v, 2, F.size(v)), lambda a, n: F.struct(a.alias("a"), (n["s"].isNull() | (n["s"] >= a["e"])).alias("last"))), lambda x: x["last"]), lambda x: x["a"])
    none = F.expr("cast(array() AS array<struct<s:int,e:int,r:double,k:int>>)")
    return _let(F.array_sort(spans), lambda v: F.when(F.size(v) > 0, last(_scan(v, zero, step), v)).otherwise(none))


def training_rows(docs: DataFrame, params: PiiParams) -> list[tuple]:
    """(features..., covered by a checked base span, named by what stands before it, fold) of the candidates of a sample.

    Documents are chosen by hash of the id, candidates of each kind by hash of place and
    text; equal candidates share their fold.
    """
    ids = docs.filter("doc_id IS NOT NULL").select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(params.sample_docs).distinct()
    few = base_spans(docs.join(F.broadcast(ids), "doc_id"))  # bounded by sample_docs
    for k, p in LOOSE.items():
        few = few.withColumn(f"_c_{k}", _located(p, LOOSE_HINT[k], True))
    shape = lambda s, e, base, k, f, m: F.struct(s.alias("s"), e.alias("e"), base.alias("base"), k.alias("k"), f.alias("f"), m.alias("m"))
    plain = F.expr("cast(array() AS array<double>)")
    base = [F.transform(f"_b_{k}", lambda x: shape(x["s"], x["e"], F.lit(True), F.lit(-1), plain, F.lit(""))) for k in BASE]
    rate = lambda k: lambda x: shape(x["s"], x["e"], F.lit(False), F.lit(ORDER.index(k)), _features(k, x), x["m"])
    loose = [F.transform(f"_c_{k}", rate(k)) for k in LOOSE]
    rated = few.select("doc_id", F.flatten(F.array(*base, *loose)).alias("v"))
    told = F.transform(F.filter(_covered(F.col("v")), lambda y: ~y["x"]["base"]), lambda y: F.struct(y["x"]["s"].alias("s"), y["x"]["k"].alias("k"), y["x"]["f"].alias("f"), y["x"]["m"].alias("m"), y["covered"].alias("covered")))
    rows = rated.select("doc_id", F.explode(told).alias("x"))
    out = []
    for k in LOOSE:
        one = rows.filter(F.col("x.k") == ORDER.index(k)).orderBy(F.xxhash64("x.m", "doc_id", "x.s"), "doc_id", "x.s").limit(params.max_rows)
        out.append(one.select("x.f", "x.covered", (F.pmod(F.xxhash64("x.m"), F.lit(3))).alias("fold")))
    named = FEATURES.index("named")
    got = out[0].unionByName(out[1]).unionByName(out[2]).collect()  # at most max_rows of each kind
    return sorted((*r.f, r.covered, r.f[named] > 0, r.fold) for r in got)


@dataclass(frozen=True)
class Booster:
    """Trees of depth two as ((feature, cut), (feature, cut, low, high) left, the same right); ``threshold`` on the sum."""

    trees: tuple = ()
    threshold: float = math.inf

    def score(self, f: Column) -> Column:
        """The sum of the trees for an array of features."""
        out = F.lit(0.0)
        for (i, c), (li, lc, a, b), (ri, rc, d, e) in self.trees:
            left = F.when(F.get(f, F.lit(li)) <= lc, F.lit(a)).otherwise(F.lit(b))
            right = F.when(F.get(f, F.lit(ri)) <= rc, F.lit(d)).otherwise(F.lit(e))
            out = out + F.when(F.get(f, F.lit(i)) <= c, left).otherwise(right)
        return out


def _boosted(x, y, part, columns, params: PiiParams) -> tuple[list, object]:
    """Trees of gradient boosting with log loss on the rows of ``part``, over some columns; and the sums of all rows."""
    import numpy as np

    cuts = []
    for j in columns:
        v = np.unique(x[:, j])
        v = v[np.unique(np.linspace(0, len(v) - 1, min(len(v), 24)).astype(int))]
        cuts += [(j, (a + b) / 2) for a, b in zip(v[:-1], v[1:])]
    raw, trees = np.zeros(len(y)), []
    if not cuts or len(np.unique(y[part])) < 2:
        return trees, raw
    below = np.array([x[:, j] <= c for j, c in cuts])

    def split(mask, g, h):
        """The best cut among rows of ``mask`` and the two leaf values."""
        gl, hl = below[:, mask] @ g[mask], below[:, mask] @ h[mask]
        gt, ht = g[mask].sum(), h[mask].sum()
        gain = gl**2 / (hl + 1) + (gt - gl) ** 2 / (ht - hl + 1)
        k = int(gain.argmax())
        return k, float(params.rate * gl[k] / (hl[k] + 1)), float(params.rate * (gt - gl[k]) / (ht - hl[k] + 1))

    for _ in range(params.rounds):
        p = 1 / (1 + np.exp(-raw))
        g, h = y - p, p * (1 - p)
        k0 = split(part, g, h)[0]
        (lk, a, b), (rk, d, e) = (split(m, g, h) if m.any() else (k0, 0.0, 0.0) for m in (below[k0] & part, ~below[k0] & part))
        raw = raw + np.where(below[k0], np.where(below[lk], a, b), np.where(below[rk], d, e))
        trees.append(((cuts[k0][0], float(cuts[k0][1])), (cuts[lk][0], float(cuts[lk][1]), a, b), (cuts[rk][0], float(cuts[rk][1]), d, e)))
    return trees, raw


def fit(rows: list[tuple], params: PiiParams = PiiParams()) -> Booster:
    """Trees of both views on two folds of three, the threshold set on the third; nothing to learn from: no trees.

    Format trees learn the evidence outside the candidate, context trees the format trees'
    verdict (or a base span). The threshold counts candidates without such evidence as wrong, so
    the precision it keeps is a lower bound.
    """
    import numpy as np

    if not rows:
        return Booster()
    x = np.array([r[:-3] for r in rows], float)
    covered, named, fold = (np.array([r[k] for r in rows]) for k in (-3, -2, -1))
    y, part = (covered | named).astype(float), fold < 2
    if len(np.unique(y[part])) < 2 or part.all():
        return Booster()
    shape, first = _boosted(x, y, part, range(len(FORMAT)), params)
    place, second = _boosted(x, ((first > 0) | covered).astype(float), part, range(len(FORMAT), len(FEATURES)), params)
    # what is covered is found anyway: the threshold is for the others
    s, t = (first + second)[~part & ~covered], y[~part & ~covered]
    best, scores = math.inf, np.unique(s)[::-1]
    for i, c in enumerate(scores):
        if t[s >= c].mean() < params.precision:
            break
        best = float(c + scores[i + 1]) / 2 if i + 1 < len(scores) else float(c) - 1e-6  # between scores: sums may round otherwise in Spark
    return Booster((*shape, *place), best)


def find(docs: DataFrame, model: Booster) -> DataFrame:
    """doc_id, base: array of (k, s, e), added: selected candidates clear of base spans, those that overlap merged under the best one's kind."""
    c = base_spans(docs)
    shape = lambda s, e, base, r, k: F.struct(s.alias("s"), e.alias("e"), base.alias("base"), r.alias("r"), k.alias("k"))
    tag = lambda k: lambda x: shape(x["s"], x["e"], F.lit(True), F.lit(0.0), F.lit(ORDER.index(k)))
    rated = lambda k: lambda x: shape(x["s"], x["e"], F.lit(False), -_let(_features(k, x), model.score), F.lit(ORDER.index(k)))
    c = c.withColumn("_base", F.flatten(F.array(*[F.transform(f"_b_{k}", tag(k)) for k in BASE])))
    counts = [F.size(f"_b_{k}").cast("long").alias(f"n_{k}") for k in BASE]
    none = F.expr("cast(array() AS array<struct<k:int,s:int,e:int>>)")
    added = none
    if model.trees and model.threshold < math.inf:
        good = [F.filter(F.transform(_located(p, LOOSE_HINT[k], True), rated(k)), lambda x: -x["r"] >= F.lit(model.threshold)) for k, p in LOOSE.items()]
        clear = lambda a: F.transform(F.filter(_covered(F.concat("_base", a)), lambda y: ~y["covered"]), lambda y: y["x"])
        added = _let(F.flatten(F.array(*good)), lambda a: F.when(F.size(a) > 0, F.transform(_merged(clear(a)), lambda x: F.struct(x["k"].alias("k"), x["s"].alias("s"), x["e"].alias("e")))).otherwise(none))
    base = F.transform("_base", lambda x: F.struct(x["k"].alias("k"), x["s"].alias("s"), x["e"].alias("e")))
    return c.select("doc_id", *counts, base.alias("base"), added.alias("added"))


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in ORDER])
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def report(docs: DataFrame, params: PiiParams = PiiParams()) -> DataFrame:
    """Counts per base kind, a digest of the base spans, all spans, and counts of the added secrets and of all spans.

    A null text is empty; repeated rows repeat; an empty table gives no rows; other columns take no part.
    """
    model = fit(training_rows(docs.select("doc_id", "text"), params), params)
    found = find(docs.select("doc_id", "text"), model)
    secret = F.size(F.filter("added", lambda x: x["k"] == ORDER.index("secret"))).cast("long")
    return found.select(
        "doc_id", *[f"n_{k}" for k in BASE], F.sha2(_joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), _joined(F.concat("base", "added")).alias("spans"),
        secret.alias("n_secret"), (F.size("base") + F.size("added")).cast("long").alias("n_spans"),
    )


def redact(docs: DataFrame, model: Booster, mask: str = "[{}]") -> DataFrame:
    """doc_id and the text with every run of overlapping spans replaced by the kind of its first span."""
    keyed = docs.select(F.struct("doc_id", F.coalesce("text", F.lit("")).alias("text")).alias("doc_id"), "text")  # the text goes along as part of the id
    names = F.array(*[F.lit(mask.format(k.upper())) for k in ORDER])
    merged = _merged(F.transform(F.concat("base", "added"), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["s"].cast("double").alias("r"), x["k"].alias("k"))))
    t = F.col("doc_id")["text"]
    chars = F.regexp_extract_all(t, F.lit("(?s)."), F.lit(0))

    def cut(v: Column, c: Column) -> Column:
        lead = lambda x, i: F.concat(F.array_join(F.slice(c, F.when(i == 0, F.lit(0)).otherwise(F.get(v, i - 1)["e"]) + 1, x["s"] - F.when(i == 0, F.lit(0)).otherwise(F.get(v, i - 1)["e"])), ""), F.get(names, x["k"]))
        last = F.element_at(v, -1)["e"]
        return F.concat(F.array_join(F.transform(v, lead), ""), F.array_join(F.slice(c, last + 1, F.greatest(F.lit(0), F.size(c) - last)), ""))

    done = _let(merged, lambda v: F.when(F.size(v) > 0, _let(chars, lambda c: cut(v, c))).otherwise(t))
    return find(keyed, model).select(F.col("doc_id").alias("id"), done.alias("text")).select("id.doc_id", "text")
