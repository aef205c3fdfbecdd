"""Line dedup by hashes of stretches of lines.

A text is cut into lines; a physical line is folded after sentence ends, so a passage
inside a paragraph has lines of its own. From every line on, and back from every line, the
shortest stretch of ``min_words`` words or more is a fingerprint: a long line by itself, a
short one together with its neighbours. Every line of a repeated run of ``min_words``
words is in such a stretch inside the run, so stretches whose fingerprint has an earlier
position are exactly what repeated runs cover, and nothing needs to be extended. They are
deleted, but for their first position in the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, drop_staged, fresh, keep_for, staged
from .minhash import mix

#: Between a line break, or a sentence end and its space, and what follows.
FOLD = r"(?<=\n)|(?<=[.!?] )"


@dataclass(frozen=True)
class LineParams:
    min_words: int = 10


_ODD, _GAP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _lines(docs: DataFrame) -> DataFrame:
    """doc_id, version of the text, line hashes (white space folded) and words per line."""
    pieces = F.split(F.col("text"), FOLD)
    one = docs.select("doc_id", "text").filter("text IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", F.xxhash64("text").alias("v"), F.transform(pieces, lambda s: F.trim(F.regexp_replace(s, rf"{SPACE}+", " "))).alias("p"))
    return one.select("doc_id", "v", F.transform("p", lambda s: F.xxhash64(s)).alias("h"), F.transform("p", lambda s: F.when(s == "", 0).otherwise(F.length(s) - F.length(F.replace(s, F.lit(" "))) + 1)).alias("w"))


def _stretches(hashes: np.ndarray, words: np.ndarray, owner: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(fp, start, end) of the shortest stretches of ``least`` words from and back from every line, as indexes of the lines with words.

    Blank lines count between two lines of a stretch, by their number.
    """
    at = np.flatnonzero(words > 0)
    own, n = owner[at], len(at)
    total = np.concatenate([[0], np.cumsum(words[at], dtype=np.int64)])
    i = np.arange(n)
    ahead = np.searchsorted(total, total[:-1] + least, "left")  # end of the stretch from i
    back = np.searchsorted(total, total[1:] - least, "right") - 1  # start of the stretch that ends with i
    ok = ahead <= n
    ok[ok] = own[ahead[ok] - 1] == own[ok]
    too = back >= 0
    too[too] = own[back[too]] == own[too]
    too[too] = ahead[back[too]] != i[too] + 1  # the same stretch once
    start, end = np.concatenate([i[ok], back[too]]), np.concatenate([ahead[ok], i[too] + 1])
    gap = np.diff(at, prepend=at[:1]).astype(np.uint64) * _GAP
    h = hashes[at].view(np.uint64)
    fp = mix(h[start])
    live, d = np.arange(len(start)), 1
    while True:  # as many rounds as the longest stretch has lines with words, min_words at most
        live = live[start[live] + d < end[live]]
        if not live.size:
            return fp.view(np.int64), start, end
        k = start[live] + d
        fp[live] = mix(fp[live] * _ODD + mix(h[k] + gap[k]))
        d += 1


def _fingerprints(lines: DataFrame, params: LineParams) -> DataFrame:
    """(fp, doc_id, v, first, last) of the stretches; blank lines go with the line before them, leading ones with the first."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        keep_for("line_dedup")
        for b in batches:
            ends = b.column(2).offsets.to_numpy().astype(np.int64)
            ends = ends - ends[0]
            owner = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
            words = b.column(3).flatten().to_numpy()
            fp, s, e = _stretches(b.column(2).flatten().to_numpy(), words, owner, params.min_words)
            at = np.flatnonzero(words > 0)
            lo = ends[owner[at]]
            up = np.minimum(np.append(at, len(words))[1:], ends[owner[at] + 1])  # the next line with words, or the end of the text
            down = at.copy()
            head = np.concatenate([[True], owner[at][1:] != owner[at][:-1]])[: len(at)]
            down[head] = lo[head]
            own = pa.array(owner[at][s])
            yield pa.RecordBatch.from_arrays(
                [pa.array(fp), b.column(0).take(own), b.column(1).take(own), pa.array((down[s] - lo[s]).astype(np.int32)), pa.array((up[e - 1] - lo[s]).astype(np.int32))],
                names=["fp", "doc_id", "v", "first", "last"],
            )

    kind = lines.schema["doc_id"].dataType.simpleString()
    return lines.select("doc_id", "v", "h", "w").mapInArrow(run, f"fp long, doc_id {kind}, v long, first int, last int")


def _merged(found: DataFrame) -> DataFrame:
    """(doc_id, v, gone): one flag a line up to the last that goes, from the stretches [first, last) of each text."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        keep_for("line_dedup")
        for b in batches:
            out = []
            for m in b.column(2):
                r = m.values
                first, last = r.field(0).to_numpy(), r.field(1).to_numpy()
                step = np.bincount(first, minlength=last.max() + 1) - np.bincount(last, minlength=last.max() + 1)
                out.append(np.cumsum(step)[:-1] > 0)
            at = np.cumsum([0, *map(len, out)]).astype(np.int32)
            flags = pa.array(np.concatenate(out) if out else np.zeros(0, bool))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.ListArray.from_arrays(pa.array(at), flags)], names=["doc_id", "v", "gone"])

    kind = found.schema["doc_id"].dataType.simpleString()
    return found.mapInArrow(run, f"doc_id {kind}, v long, gone array<boolean>")


def repeated_lines(docs: DataFrame, params: LineParams = LineParams()) -> DataFrame:
    """(doc_id, v, gone): for each version of a document with later repeats, which of its lines go."""
    fps = staged(_fingerprints(_lines(docs), params), "fingerprints")
    least = fps.groupBy("fp").agg(F.min(F.struct("doc_id", "v", "first")).alias("f"), F.count(F.lit(1)).alias("n"))
    first = staged(least.filter("n > 1").select("fp", F.col("f.doc_id").alias("c"), F.col("f.v").alias("cv"), F.col("f.first").alias("cfirst")), "first")
    later = fps.join(first, "fp").filter("NOT (doc_id = c AND v = cv AND first = cfirst)")
    # stretches of one document: at most two a line
    out = staged(_merged(later.groupBy("doc_id", "v").agg(F.collect_set(F.struct("first", "last")).alias("m"))), "gone")
    drop_staged(fps, first)
    return out


def dedup_lines(docs: DataFrame, params: LineParams = LineParams()) -> DataFrame:
    """``docs`` with later repeated runs cut out of ``text`` (and ``n_chars`` renewed where there is one).

    Null texts and rows without an id stay as they are. A document whose every line is a
    later repeat ends with an empty text. Rows that repeat an id and a text share their
    result; the first of equal positions is the least (doc_id, text hash, line). Other columns
    stay, whatever their names; an empty table gives an empty one.
    """
    gone = repeated_lines(docs, params)
    cols = docs.columns
    v, d, w, g = fresh(docs, "_v", "_d", "_w", "_gone")
    flags = gone.select(F.col("doc_id").alias(d), F.col("v").alias(w), F.col("gone").alias(g))
    hit = docs.withColumn(v, F.xxhash64("text")).join(flags, (F.col("doc_id") == F.col(d)) & (F.col(v) == F.col(w)), "left")
    kept = F.array_join(F.filter(F.split(F.col("text"), FOLD), lambda s, i: ~F.coalesce(F.get(g, i), F.lit(False))), "")
    out = hit.withColumn("text", F.when(F.col(g).isNull(), F.col("text")).otherwise(kept))
    if "n_chars" in cols:
        out = out.withColumn("n_chars", F.when(F.col(g).isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return out.select(*[F.col(f"`{c}`") for c in cols])


def line_report(docs: DataFrame, params: LineParams = LineParams()) -> DataFrame:
    """One row per row: doc_id, the text that is left, and its characters before and after (null for a null text); other columns take no part."""
    before = docs.select("doc_id", "text", F.length("text").alias("n_chars"))
    done = dedup_lines(before.withColumn("chars_before", F.col("n_chars")), params)
    return done.select("doc_id", "text", F.col("chars_before").cast("long").alias("chars_before"), F.length("text").cast("long").alias("chars_after"))
