"""The composite scorer: weighted measures over normalised text as one column."""

from __future__ import annotations

import math
from dataclasses import dataclass, field, replace

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scores as S
from ..functions import similarity as sim
from ..functions.errors import EmptyScorer, InvalidThreshold, InvalidWeight, MissingThreshold
from ..functions.text import NormalisationOptions, normalise, py_normalise


@dataclass(frozen=True)
class Entry:
    name: str
    weight: float
    params: dict = field(default_factory=dict, hash=False)


@dataclass(frozen=True)
class ScorerBuilder:
    """Each method gives a new builder; ``build`` checks the whole."""

    entries: tuple[Entry, ...] = ()
    limit: float | None = None
    options: NormalisationOptions | None = NormalisationOptions()
    normalise_weights: bool = True

    def with_algorithm(self, algo: int | str, weight: float, **params) -> "ScorerBuilder":
        """Adds a measure, or replaces an earlier one of the same name. Parameters: n, alpha, beta, inner, params."""
        name = S.algo_name(algo)
        if not isinstance(weight, (int, float)) or not math.isfinite(weight) or weight <= 0:
            raise InvalidWeight("a weight must be finite and above 0")
        kept = tuple(e for e in self.entries if e.name != name)
        return replace(self, entries=(*kept, Entry(name, float(weight), S.check_params(name, params))))

    def with_q_gram_jaccard(self, weight: float, n: int) -> "ScorerBuilder":
        return self.with_algorithm("QGramJaccard", weight, n=n)

    def with_sorensen_dice(self, weight: float, n: int) -> "ScorerBuilder":
        return self.with_algorithm("SorensenDice", weight, n=n)

    def with_cosine(self, weight: float, n: int) -> "ScorerBuilder":
        return self.with_algorithm("Cosine", weight, n=n)

    def with_tversky(self, weight: float, alpha: float, beta: float, n: int) -> "ScorerBuilder":
        return self.with_algorithm("Tversky", weight, alpha=alpha, beta=beta, n=n)

    def with_monge_elkan(self, weight: float, inner: int | str) -> "ScorerBuilder":
        return self.with_algorithm("MongeElkan", weight, inner=inner)

    def with_smith_waterman_gotoh(self, weight: float, params: S.SWGParams) -> "ScorerBuilder":
        return self.with_algorithm("SmithWatermanGotoh", weight, params=params.validate())

    def without_algorithm(self, algo: int | str) -> "ScorerBuilder":
        name = S.algo_name(algo)
        return replace(self, entries=tuple(e for e in self.entries if e.name != name))

    def with_normalisation(self, options: NormalisationOptions) -> "ScorerBuilder":
        return replace(self, options=options)

    def without_normalisation(self) -> "ScorerBuilder":
        return replace(self, options=None)

    def with_threshold(self, limit: float) -> "ScorerBuilder":
        if not isinstance(limit, (int, float)) or not math.isfinite(limit) or not 0 <= limit <= 1:
            raise InvalidThreshold("a threshold must lie in [0, 1]")
        return replace(self, limit=float(limit))

    def with_normalised_weights(self, on: bool) -> "ScorerBuilder":
        return replace(self, normalise_weights=bool(on))

    def build(self) -> "Scorer":
        if self.limit is None:
            raise MissingThreshold("a scorer needs a threshold")
        if not self.entries:
            raise EmptyScorer("a scorer needs a measure")
        entries = sorted(self.entries, key=lambda e: S.IDS[e.name])
        if self.normalise_weights:
            total = 0.0
            for e in entries:
                total += e.weight
            entries = [replace(e, weight=e.weight / total) for e in entries]
        return Scorer(tuple(entries), self.limit, self.options)


@dataclass(frozen=True)
class Scorer:
    """Immutable; gives columns. Scores are folded in catalogue order and not clamped."""

    entries: tuple[Entry, ...]
    threshold: float
    options: NormalisationOptions | None

    @property
    def algorithms(self) -> list[tuple[str, float]]:
        return [(e.name, e.weight) for e in self.entries]

    @property
    def normalisation_options(self) -> tuple[NormalisationOptions, bool]:
        return self.options or NormalisationOptions(), self.options is not None

    def prepared(self, c) -> Column:
        c = F.col(c) if isinstance(c, str) else c
        return normalise(c, self.options) if self.options else c

    def native(self, a: Column, b: Column, counts: dict | None = None) -> dict[str, Column]:
        """Columns of the measures that stay in the JVM, on prepared text; ``counts`` has gram counts by size."""
        out = {}
        for e in self.entries:
            if counts and e.name in sim.COUNTED:
                out[e.name] = sim.from_counts(e.name, counts[e.params["n"]], e.params)
            elif e.name in sim.NATIVE:
                out[e.name] = sim.SCORES[e.name](a, b, **e.params)
        return out

    def native_row(self, a: Column, b: Column, **others: Column) -> Column:
        """One struct of ``others`` and of the native measures as ``n_<name>``; grams of one size are counted once for all measures."""
        sizes = sorted({e.params["n"] for e in self.entries if e.name in sim.COUNTED})
        row = lambda counts: F.struct(*[c.alias(k) for k, c in others.items()], *[c.alias(f"n_{n}") for n, c in self.native(a, b, counts).items()])
        if not sizes:
            return row(None)
        held = F.struct(*[sim.gram_counts(a, b, n).alias(f"g{n}") for n in sizes])
        return F.get(F.transform(F.array(held), lambda h: row({n: h[f"g{n}"] for n in sizes})), F.lit(0))

    def kernel(self, a: Column, b: Column) -> Column | None:
        """One array of the other measures in catalogue order, each distinct pair of a batch once."""
        rest = [(e.name, e.params) for e in self.entries if e.name not in sim.NATIVE]
        if not rest:
            return None

        def run(a: pd.Series, b: pd.Series) -> pd.Series:
            keys: dict = {}
            at = [keys.setdefault((x, y), len(keys)) if x is not None and y is not None else -1 for x, y in zip(a, b)]
            p, q = [k[0] for k in keys], [k[1] for k in keys]
            cols = [S.score(n, p, q, **params).tolist() for n, params in rest] if keys else []
            rows = list(zip(*cols))
            return pd.Series([None if i < 0 else list(rows[i]) for i in at], dtype="object")

        return F.pandas_udf(run, T.ArrayType(T.DoubleType()))(a, b)

    def assembled(self, native: dict[str, Column], kernel: Column | None) -> list[Column]:
        """One column per measure, in catalogue order."""
        out, k = [], 0
        for e in self.entries:
            if e.name in native:
                out.append(native[e.name])
            else:
                out.append(kernel[k])
                k += 1
        return out

    def fold(self, each: list[Column]) -> Column:
        total = F.lit(0.0)
        for e, s in zip(self.entries, each):
            total = F.lit(e.weight) * s + total
        return total

    def names(self) -> Column:
        return F.array(*[F.lit(e.name) for e in self.entries])

    def _each(self, a, b) -> Column:
        """One Arrow array of (score, one score per measure) of raw text: columns of any shape, in a single pass.

        Higher-order functions cannot hold Python functions, so this form computes all in one; plans
        that prepare names first (the scan) keep the native measures in the JVM.
        """
        entries, options = self.entries, self.options

        def run(a: pd.Series, b: pd.Series) -> pd.Series:
            names = {x for s in (a, b) for x in s if x is not None}
            prep = {x: py_normalise(x, options) if options else x for x in names}
            keys: dict = {}
            at = [keys.setdefault((prep[x], prep[y]), len(keys)) if x is not None and y is not None else -1 for x, y in zip(a, b)]
            p, q = [k[0] for k in keys], [k[1] for k in keys]
            cols = [S.score(e.name, p, q, **e.params).tolist() for e in entries] if keys else []
            total = [0.0] * len(keys)
            for e, c in zip(entries, cols):
                total = [e.weight * x + t for x, t in zip(c, total)]
            rows = list(zip(total, *cols))
            return pd.Series([None if i < 0 else list(rows[i]) for i in at], dtype="object")

        a, b = (F.col(c) if isinstance(c, str) else c for c in (a, b))
        return F.pandas_udf(run, T.ArrayType(T.DoubleType()))(a, b)

    def score_and_all(self, a, b) -> Column:
        """struct(score, scores) of raw text; scores maps the measure's name to its score."""
        x = self._each(a, b)
        return F.struct(x[0].alias("score"), F.map_from_arrays(self.names(), F.slice(x, 2, len(self.entries))).alias("scores"))

    def score(self, a, b) -> Column:
        return self._each(a, b)[0]

    def match(self, a, b) -> Column:
        return self.score(a, b) >= F.lit(self.threshold)

    def score_all(self, a, b) -> Column:
        return F.map_from_arrays(self.names(), F.slice(self._each(a, b), 2, len(self.entries)))

    def bound(self, native: dict[str, Column]) -> Column:
        """The most the score can be once the native measures are known, with room for rounding."""
        return self.fold([native.get(e.name, F.lit(1.0)) for e in self.entries]) + F.lit(1e-9)


def default_scorer_builder() -> ScorerBuilder:
    b = ScorerBuilder().with_threshold(0.85)
    for name in ("DamerauLevenshteinOSA", "JaroWinkler", "TokenJaccard", "QGramJaccard", "SorensenDice", "DoubleMetaphone"):
        b = b.with_algorithm(name, 1.0)
    return b


def default_scorer() -> Scorer:
    """Six measures of equal weight, threshold 0.85."""
    return default_scorer_builder().build()
