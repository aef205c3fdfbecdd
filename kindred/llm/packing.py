"""Best-fit packing of tokenised documents into fixed-length sequences: best-two-fit.

A bin is filled greedily with the longest pieces that fit; then its smallest piece
gives way to two unpacked pieces that fill the widened gap more tightly. Bins are
planned on the histogram of piece lengths, which has at most ``capacity`` rows however
many documents there are: a pattern of lengths is used as often as the counts allow.
Pieces find their place by their rank among pieces of equal length, so no list of
documents ever reaches the driver or one task.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import keep_for, staged

#: The cut below is that of this normal form and these pieces; a tokenizer file that states others encodes all texts whole.
_KNOWN = (
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+",
)
#: Ranges of characters whose class is the same for all tools (no spaces beyond ASCII, no format characters, nothing unassigned).
_RANGES = ((0x00, 0x1B), (0x20, 0x7E), (0xA1, 0xAC), (0xAE, 0x24F), (0x2010, 0x2027), (0x2030, 0x205E))
_PIECES = r"[a-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f]+|'s|'t|'re|'ve|'m|'ll|'d|[0-9\xb2\xb3\xb9\xbc-\xbe]|[^\sa-z0-9\xaa\xb2\xb3\xb5\xb9\xba\xbc-\xbe\xc0-\xd6\xd8-\xf6\xf8-\u024f]+"


def plain_characters() -> str:
    """The characters of the ranges whose lower case is one character that lies in them too.

    Texts of these characters alone have their pieces found here; other texts go to the
    tokenizer whole.
    """
    own = {chr(c) for lo, hi in _RANGES for c in range(lo, hi + 1)}
    return "".join(sorted(c for c in own if c.lower() in own))


class CachedTokenizer:
    """Token ids of whole texts as little-endian uint32 bytes; each distinct word and piece is encoded once.

    The caches hold two generations of at most ``limit`` entries, so memory is bounded
    and frequent entries survive.
    """

    def __init__(self, path: str, limit: int = 250_000):
        import json
        import os
        import re

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tok, self.limit = Tokenizer.from_file(path), limit
        self.bare = Tokenizer.from_file(path)  # for pieces that are cut and folded already
        self.bare.normalizer = normalizers.Sequence([])
        self.bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        stated = json.loads(self.tok.to_str())
        cuts = [x.get("pattern", {}).get("Regex", "") for x in (stated.get("pre_tokenizer") or {}).get("pretokenizers", [])]
        self.known = stated.get("normalizer") == _KNOWN[0] and cuts == [_KNOWN[1], ""] and not (stated.get("post_processor") or {})
        self.plain, self.pieces = re.compile("[" + re.escape(plain_characters()) + "]*"), re.compile(_PIECES)
        self.words, self.old_words, self.ids, self.old_ids = {}, {}, {}, {}

    def whole(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn_pieces(self, new: list) -> None:
        ids = self.ids
        for lo in range(0, len(new), 4000):
            part = new[lo : lo + 4000]
            e = self.bare.encode(" ".join(part), add_special_tokens=False)
            at = np.array(e.word_ids)
            ends = np.searchsorted(at, np.arange(len(part)), "right").tolist()  # each piece is one word
            raw, a = np.array(e.ids, "<u4").tobytes(), 0
            for p, b in zip(part, ends):
                ids[p] = raw[4 * a : 4 * b]
                a = b

    def _learn_words(self, words: set) -> None:
        cut = {}
        for w in words:
            if w in self.old_words:
                self.words[w] = self.old_words[w]
            else:
                cut[w] = self.pieces.findall(w)
        if not cut:
            return
        if len(self.ids) > self.limit:
            self.ids, self.old_ids = {}, self.ids
        new = []
        for p in set().union(*cut.values()).difference(self.ids):
            if p in self.old_ids:
                self.ids[p] = self.old_ids[p]
            else:
                new.append(p)
        self._learn_pieces(new)
        get = self.ids.__getitem__
        for w, ps in cut.items():
            self.words[w] = get(ps[0]) if len(ps) == 1 else b"".join(map(get, ps))

    def encode(self, texts: list) -> list:
        import unicodedata

        cut, out = {}, [b""] * len(texts)
        for i, t in enumerate(texts):
            if t and self.known and self.plain.fullmatch(t) and "<|" not in t and unicodedata.is_normalized("NFC", t):
                cut[i] = t.lower().split()
            elif t:
                out[i] = self.whole(t)
        if len(self.words) > self.limit:
            self.words, self.old_words = {}, self.words
        if cut:
            self._learn_words(set().union(*cut.values()).difference(self.words))
        get = self.words.__getitem__
        for i, ws in cut.items():
            out[i] = b"".join(map(get, ws))
        return out


def _tokenizer(path: str) -> CachedTokenizer:
    return keep_for("packing", path, lambda: CachedTokenizer(path))


def tokenised(docs: DataFrame, tokenizer: str, capacity: int, end_id: int) -> DataFrame:
    """Pieces: doc_id, piece, start, length, ids_crc32, the task and the rank in it among equal lengths."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        tok, task, seen = _tokenizer(tokenizer), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        end = np.array([end_id], "<u4").tobytes()
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                ids, texts = b.column(0).slice(lo, 256), b.column(1).slice(lo, 256).to_pylist()
                rows = []
                for i, raw in enumerate(tok.encode(texts)):
                    raw += end
                    for piece, at in enumerate(range(0, len(raw), 4 * capacity)):
                        part = raw[at : at + 4 * capacity]
                        n = len(part) // 4
                        rows.append((i, piece, at // 4, n, zlib.crc32(part), int(seen[n])))
                        seen[n] += 1
                c = list(zip(*rows)) if rows else [[]] * 6
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(pa.array(c[0])), pa.array(c[1], pa.int32()), *[pa.array(x, pa.int64()) for x in c[2:5]], pa.array([task] * len(rows), pa.int32()), pa.array(c[5], pa.int64())],
                        names=["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth"],
                    )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, task int, nth long")


def plan(counts: np.ndarray, capacity: int) -> list[tuple[list[int], int]]:
    """Bins as (lengths, how often); ``counts[n]`` pieces have length n. Uses up all counts."""
    left, out = counts.astype(np.int64).copy(), []
    while True:
        live = np.flatnonzero(left)
        if not live.size:
            return out
        use, gap = [], capacity
        while gap > 0:
            fit = live[: np.searchsorted(live, gap, "right")]
            k = fit.size - 1
            while k >= 0 and left[fit[k]] <= use.count(int(fit[k])):
                k -= 1
            if k < 0:
                break
            use.append(int(fit[k]))
            gap -= use[-1]
        if gap and len(use) > 1:
            small = min(use)
            room = gap + small
            free = left[: room + 1].copy()
            for u in use:
                if u <= room and u != small:
                    free[u] -= 1
            for u in use:
                if u == small:
                    free[u] -= 1
            free[small] += 1  # it goes back among the unpacked
            for total in range(room, small, -1):
                x = np.arange(1, total // 2 + 1)
                ok = (free[x] > 0) & (free[total - x] > 0) & ((x * 2 != total) | (free[x] > 1))
                if ok.any():
                    a = int(x[ok][-1])
                    use.remove(small)
                    use += [a, total - a]
                    break
        times = min(int(left[u]) // use.count(u) for u in set(use))
        for u in use:
            left[u] -= times
        out.append((sorted(use, reverse=True), times))


def places(bins: list[tuple[list[int], int]], capacity: int) -> dict[str, np.ndarray]:
    """Per length, ranks in order: (length * 2**40 + first rank, first sequence, offset in it)."""
    used, rows, first = np.zeros(capacity + 1, np.int64), [], 0
    for lengths, times in bins:
        at = 0
        for n in lengths:
            rows.append((n, int(used[n]), first, at))
            used[n] += times
            at += n
        first += times
    rows.sort()
    a = np.array(rows, np.int64).reshape(-1, 4)
    return {"length": a[:, 0], "rank": a[:, 1], "sequence": a[:, 2], "offset": a[:, 3]}


def pack(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is the end id alone. Repeated rows are packed each for itself;
    equal lengths are told apart by task and order in the staged table, so ties are settled. An
    empty table gives no rows; other columns take no part.
    """
    pieces = staged(tokenised(docs, tokenizer, capacity, end_id), "pieces")
    per_task = pieces.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_task.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    counts = np.zeros(capacity + 1, np.int64)
    for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect():  # at most `capacity` rows
        counts[r["length"]] = r["n"]
    table = places(plan(counts, capacity), capacity)
    starts = np.searchsorted(table["length"], np.arange(capacity + 2))
    shared = pieces.sparkSession.sparkContext.broadcast((table, starts))  # grows with the capacity, not with the rows

    def run(batches: Iterator) -> Iterator:
        t, at = shared.value
        for pdf in batches:
            n, rank = pdf["length"].to_numpy(), (pdf["nth"] + pdf["base"]).to_numpy()
            row = np.zeros(len(pdf), np.int64)
            for v in np.unique(n):
                m = n == v
                lo, hi = at[v], at[v + 1]
                row[m] = lo + np.searchsorted(t["rank"][lo:hi], rank[m], "right") - 1
            pdf["sequence_id"] = t["sequence"][row] + rank - t["rank"][row]
            pdf["offset"] = t["offset"][row]
            yield pdf[["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]]

    kind = docs.schema["doc_id"].dataType.simpleString()
    placed = pieces.join(offsets, ["length", "task"])
    return placed.mapInPandas(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
