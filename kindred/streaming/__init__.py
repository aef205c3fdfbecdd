"""Matching a stream of names against a catalogue: an extension beyond the batch scan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokenise
from ..operators.scorer import Scorer


def match_stream(stream: DataFrame, name: str, catalogue: DataFrame, catalogue_name: str, scorer: Scorer) -> DataFrame:
    """Rows (new_name, known_name, score) that share a token and reach the threshold.

    Stateless: works on a streaming or batch ``stream``. A pair that shares several tokens is kept
    for its first shared token only, so no deduplicating state is needed.
    """
    new = stream.select(F.col(name).alias("new_name"), scorer.prepared(name).alias("na")).withColumn("ta", F.array_distinct(tokenise(F.col("na"))))
    known = catalogue.select(F.col(catalogue_name).alias("known_name"), scorer.prepared(catalogue_name).alias("nb")).withColumn("tb", F.array_distinct(tokenise(F.col("nb"))))
    a, b = new.withColumn("tok", F.explode("ta")), known.withColumn("tok", F.explode("tb"))
    pairs = a.join(b, "tok").filter(F.col("tok") == F.array_min(F.array_intersect("ta", "tb")))
    native = scorer.native(F.col("na"), F.col("nb"))
    kernel = scorer.kernel(F.col("na"), F.col("nb"))
    each = scorer.assembled(native, kernel)
    return pairs.select("new_name", "known_name", scorer.fold(each).alias("score")).filter(F.col("score") >= F.lit(scorer.threshold))
