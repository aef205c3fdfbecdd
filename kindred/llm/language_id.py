"""Language identification by cross-parsing entropy.

``learn`` counts the phrases of all labelled text, up to ``longest`` characters, and keeps for each
language those that are frequent in it; a suffix automaton holds them. A text is parsed greedily into the
longest of them, and the language with the least ``phrases * log2(entries) / characters`` wins.
``reference_texts`` gives short reference texts instead, whose pieces of any length are phrases (entries: their
length); the query and the pipeline do not use it. Automata are dense
transition tables, walked for all blocks of a batch at once, so each step is a few
array operations. Long texts are cut into blocks of ``BLOCK`` characters that are
parsed side by side, each as if a phrase started with it; then each block is entered again
with the state its predecessor ended in, until a phrase starts where one started before: from there
both parses are one. The counts are those of one parse of the whole text.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import drop_staged, keep_for, staged

BLOCK = 1024
BITS = 6  # of a letter in a phrase's key: 0 the end, 1 space, then the letters
CHUNK, HELD = 1 << 20, 1 << 21  # characters counted at once and phrases held by a task before it hands them on


@dataclass(frozen=True)
class LangParams:
    docs_per_language: int = 64  # bound of the labelled sample, in documents ...
    chars_per_language: int = 20_000  # ... and in characters of each language's reference, an equal share of each document
    alphabet: int = 61  # most frequent letters; others share one class
    longest: int = 6  # characters of a phrase that is learnt, and ...
    one_in: int = 20_000  # ... the least share of the language's positions where it starts: one in so many


@dataclass(frozen=True)
class Learnt:
    """Letters in their order, and of each language the keys of its frequent phrases, ascending 64-bit integers."""

    letters: tuple = ()
    phrases: tuple = ()  # (language, bytes)
    longest: int = 0


def learn(docs: DataFrame, params: LangParams = LangParams(), training=None) -> Learnt:
    """The frequent phrases of each language, counted over every row with a label and a text.

    ``training`` limits the rows that may be learnt from; texts without a letter teach nothing. A phrase
    is a stretch of a folded text without rarer letters; it stays if it starts at one in ``one_in`` of the language's
    positions or more, so a table of any size keeps at most ``longest * one_in`` of them, and a small one all.
    Every part of a frequent phrase is frequent too. Counts are combined in tasks and summed after a shuffle. The driver
    gets the counts of letters and the frequent phrases.
    """
    if not (0 < params.alphabet <= 2**BITS - 2 and 2 <= params.longest <= 6):
        raise ValueError("at most 62 letters and phrases of 2 to 6 characters")
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    if training is not None:
        rows = rows.filter(training)
    rows = rows.select(F.col("lang").cast("string").alias("lang"), "text")
    letters = _letters(rows, params.alphabet)
    if not letters:
        return Learnt()
    counts = staged(_counted(rows, letters, params.longest).groupBy("lang", "key").agg(F.sum("n").alias("n")), "phrases")
    total = counts.groupBy("lang").agg(F.sum("n").alias("all"))
    key, heads = F.col("key"), []
    for d in range(params.longest):  # the key's first letters alone, where it has so many
        low = BITS * d
        heads.append(F.when(key.bitwiseAND(F.lit((2**BITS - 1) << low)) != 0, key.bitwiseAND(F.lit(-1 << low))))
    each = counts.select("lang", "n", F.explode(F.array(*heads)).alias("key")).filter("key IS NOT NULL").groupBy("lang", "key").agg(F.sum("n").alias("n"))
    often = each.join(F.broadcast(total), "lang").filter(F.col("n") * params.one_in >= F.col("all"))  # one row a language is broadcast
    found = often.groupBy("lang").agg(F.sort_array(F.collect_list("key")).alias("keys")).collect()  # at most longest * one_in keys each
    drop_staged(counts)
    return Learnt(tuple(letters), tuple((r["lang"], np.array(r["keys"], np.int64).tobytes()) for r in sorted(found, key=lambda r: r["lang"])), params.longest)


def _folded(batches: Iterator) -> Iterator:
    """Lists of (language, folded text) of the rows (lang, text) whose text has a letter."""
    keep_for("language_id")
    for b in batches:
        for lo in range(0, b.num_rows, 512):
            part = b.slice(lo, 512)
            both = ((k, _fold(t)) for k, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist()))
            yield [(k, f) for k, f in both if (f != 32).any()]


def _letters(rows: DataFrame, most: int) -> list[int]:
    """The letters with the greatest sum of their shares of each language's letters, ties to the smaller code point."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def out():
            for k, n in held.items():
                c = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array([k] * c.size, pa.string()), pa.array(c), pa.array(n[c])], names=["lang", "letter", "n"])
            held.clear()

        held: dict = {}
        for part in _folded(batches):
            for k, f in part:
                new, old = np.bincount(f), held.get(k)
                if old is None or old.size < new.size:
                    new, old = old, new
                if new is not None:
                    old[: new.size] += new
                held[k] = old
            if len(held) > 64:
                yield from out()
        yield from out()

    counts = rows.mapInArrow(run, "lang string, letter long, n long").groupBy("lang", "letter").agg(F.sum("n").alias("n")).filter("letter <> 32").collect()
    total: dict = {}
    for r in counts:
        total[r["lang"]] = total.get(r["lang"], 0) + r["n"]
    share: dict = {}
    for r in sorted(counts):
        share[r["letter"]] = share.get(r["letter"], 0.0) + r["n"] / total[r["lang"]]
    return sorted(share, key=lambda c: (-share[c], c))[:most]


def _coded(letters: list | tuple) -> np.ndarray:
    """The code of every code point in a key: 1 space, then the letters; 0 for other ones."""
    codes = np.zeros(0x110000, np.uint8)
    codes[[32, *letters]] = np.arange(1, len(letters) + 2)
    return codes


def _counted(rows: DataFrame, letters: list[int], longest: int) -> DataFrame:
    """(lang, key, n): how often each phrase of ``longest`` characters starts in the texts, shorter ones before a rare letter or the end."""

    def summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(keys, kind="stable")
        keys, n = keys[order], n[order]
        at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])[: keys.size])
        return keys[at], np.add.reduceat(n, at) if at.size else n

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        codes, names = _coded(letters), {}
        wait, size = [], 0  # (number of the language, codes and the end)
        new, held = [], (np.zeros(0, np.int64), np.zeros(0, np.int64))  # counts of keys under the language's number

        def count():
            nonlocal wait, size, held, new
            seq = np.concatenate([s for _, s in wait] + [np.zeros(longest, np.uint8)])
            own = np.repeat(np.array([k for k, _ in wait], np.int64), [s.size for _, s in wait])
            for lo in range(0, own.size, CHUNK):
                n = min(CHUNK, own.size - lo)
                key, live = own[lo : lo + n].copy(), np.ones(n, bool)
                for j in range(longest):
                    c = seq[lo + j : lo + j + n]
                    live &= c != 0
                    key <<= BITS
                    key |= np.where(live, c, 0)
                new.append(np.unique(key[seq[lo : lo + n] != 0], return_counts=True))
                if sum(k.size for k, _ in new) > HELD // 2:
                    held, new = summed(*map(np.concatenate, zip(held, *new))), []
            wait, size = [], 0

        def out():
            nonlocal held, new
            key, n = summed(*map(np.concatenate, zip(held, *new)))
            held, new = (key[:0], n[:0]), []
            labels, low = pa.array(list(names), pa.string()), BITS * longest
            for lo in range(0, key.size, 1 << 16):
                part = key[lo : lo + (1 << 16)]
                yield pa.RecordBatch.from_arrays([labels.take(pa.array(part >> low)), pa.array(part & ((1 << low) - 1)), pa.array(n[lo : lo + (1 << 16)])], names=["lang", "key", "n"])

        for part in _folded(batches):
            for k, f in part:
                wait.append((names.setdefault(k, len(names)), np.append(codes[f], np.uint8(0))))
                size += f.size + 1
                if size >= CHUNK:
                    count()
            if held[0].size > HELD:
                yield from out()
        if wait:
            count()
        yield from out()

    return rows.mapInArrow(run, "lang string, key long, n long")


def reference_texts(docs: DataFrame, params: LangParams = LangParams(), training=None) -> dict[str, str]:
    """A bounded sample of labelled text per language, chosen by hash of the id.

    ``training`` limits the rows that may be learnt from. Only ids and labels are read
    for the choice (at most ``docs_per_language`` per partition and language leave a
    task); texts are then fetched for the chosen ids alone.
    """
    rows = docs.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    if training is not None:
        rows = rows.filter(training)
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    ids = rows.select("doc_id", "lang").withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= params.docs_per_language)
    chosen = {r["doc_id"] for r in ids.select("doc_id").collect()}
    out: dict[str, list] = {}
    if chosen:
        for r in rows.filter(F.col("doc_id").isin(sorted(chosen))).select("doc_id", "lang", "text").collect():
            out.setdefault(r["lang"], []).append((r["doc_id"], r["text"]))
    return {k: "\n".join(_shares([t for _, t in sorted(v)], params.chars_per_language)) for k, v in sorted(out.items())}


def _shares(texts: list[str], most: int) -> list[str]:
    """Stretches of at most ``most`` characters in all: short texts whole, of the others equal stretches from their middle."""
    left, share = most, most
    for i, n in enumerate(sorted(map(len, texts))):
        share = left // (len(texts) - i)
        if n > share:
            break
        left -= n
    return [t[max(0, (len(t) - share) // 2) :][:share] for t in texts]


class Parser:
    """Dense automata of all languages; ``phrases(texts)`` counts phrases per text and language."""

    def __init__(self, texts: dict[str, str] | Learnt, alphabet: int):
        learnt = isinstance(texts, Learnt)
        if learnt:
            self.langs, letters = [k for k, _ in texts.phrases], texts.letters
        else:
            self.langs = sorted(texts)
            folded = [_fold(texts[k]) for k in self.langs]
            codes, counts = np.unique(np.concatenate(folded) if folded else np.zeros(0, np.uint32), return_counts=True)
            letters = [int(c) for _, c in sorted(zip(-counts, codes)) if c != 32][:alphabet]
        self.width = len(letters) + 3  # space, letters, other, padding
        self.other, self.pad = self.width - 2, self.width - 1
        self.classes = np.full(0x110000, self.other, np.uint8)
        self.classes[32] = 0
        for i, c in enumerate(letters):
            self.classes[c] = i + 1
        if learnt:
            keys = [np.frombuffer(b, np.int64) for _, b in texts.phrases]
            seqs = [self._joined(k, texts.longest) for k in keys]
            entries = [int((k & (((1 << BITS) - 1) << BITS * (texts.longest - 2)) != 0).sum()) + self.width for k in keys]  # longer ones, and each letter
        else:
            seqs, entries = [self.classes[f] for f in folded], [f.size for f in folded]
        tables, self.starts, at = [], [], 0
        for seq in seqs:
            t = self._table(seq, at)
            tables.append(t)
            at += t.size
            self.starts.append(at - self.width)
        self.table = np.concatenate(tables) if tables else np.zeros(0, np.int32)
        self.cost = np.array([math.log2(max(2, n)) for n in entries])

    def _joined(self, keys: np.ndarray, longest: int) -> np.ndarray:
        """The classes of the phrases that start no longer one, padding after each."""
        codes = np.stack([(keys >> BITS * (longest - 1 - j)) & ((1 << BITS) - 1) for j in range(longest)], 1) if keys.size else np.zeros((0, longest), np.int64)
        size = (codes != 0).sum(1)
        j = np.arange(longest)
        head = ((codes[1:] == codes[:-1]) | (j >= size[:-1, None])).all(1) if keys.size else np.zeros(0, bool)  # of the next, as keys ascend
        codes = codes[~np.append(head, np.zeros(min(1, keys.size), bool))]
        codes = np.concatenate([codes, np.zeros((len(codes), 1), np.int64)], 1)
        first = np.concatenate([np.ones((len(codes), 1), bool), codes[:, :-1] != 0], 1)  # the phrase and one end
        return np.where(codes > 0, codes - 1, self.pad)[first].astype(np.uint8)

    def _table(self, seq: np.ndarray, at: int) -> np.ndarray:
        """Suffix automaton of ``seq``, of all its parts between padding, as a flat table; entries are state offsets, a failed step ``~restart``."""
        nxt, link, length, last = [{}], [-1], [0], 0
        for c in seq.tolist():
            if c == self.pad:
                last = 0
                continue
            if c in nxt[last]:  # an earlier part goes on like this one
                q = nxt[last][c]
                if length[q] != length[last] + 1:
                    clone, p = len(nxt), last
                    nxt.append(dict(nxt[q]))
                    length.append(length[last] + 1)
                    link.append(link[q])
                    while p >= 0 and nxt[p].get(c) == q:
                        nxt[p][c] = clone
                        p = link[p]
                    link[q] = q = clone
                last = q
                continue
            cur = len(nxt)
            nxt.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in nxt[p]:
                nxt[p][c] = cur
                p = link[p]
            if p >= 0:
                q = nxt[p][c]
                if length[p] + 1 == length[q]:
                    link[cur] = q
                else:
                    clone = len(nxt)
                    nxt.append(dict(nxt[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and nxt[p].get(c) == q:
                        nxt[p][c] = clone
                        p = link[p]
                    link[q] = link[cur] = clone
            last = cur
        w = self.width
        # between phrases: whatever comes starts one; an unknown character is a phrase of its own
        between = at + len(nxt) * w
        root = np.full(w, between, np.int32)
        for c, s in nxt[0].items():
            root[c] = at + s * w
        t = np.repeat(~root[None, :], len(nxt) + 1, 0)
        for s, d in enumerate(nxt):
            for c, to in d.items():
                t[s, c] = at + to * w
        t[:, self.other] = ~between
        t[:, self.pad] = between
        return t.ravel()

    def phrases(self, texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(phrases per text and language, characters parsed, whether the text has a letter)."""
        folded = [_fold(t) for t in texts]
        sizes = np.array([f.size for f in folded])
        letters = np.array([bool((f != 32).any()) for f in folded])
        blocks = -(-sizes // BLOCK)
        owner = np.repeat(np.arange(len(texts)), blocks)
        out = np.zeros((len(self.langs), len(texts)), np.int64)
        flat = np.full(int(blocks.sum()) * BLOCK, self.pad, np.uint8)
        at = 0
        for f, b in zip(folded, blocks):
            flat[at : at + f.size] = self.classes[f]
            at += int(b) * BLOCK
        grid = flat.reshape(-1, BLOCK)
        inner = np.concatenate([np.zeros(1, bool), owner[1:] == owner[:-1]])[: len(grid)]  # blocks that go on with a text
        ends = np.empty((len(self.langs), len(grid)), np.int32)
        counts = np.empty_like(ends)
        for lo in range(0, len(grid), 4096):  # bounds the working set
            counts[:, lo : lo + 4096], ends[:, lo : lo + 4096] = self._walk(grid[lo : lo + 4096])
        # blocks to enter again, with the state their predecessor ends in
        again = [np.flatnonzero(inner)] * len(self.langs)
        first, fresh = counts.copy(), ends.copy()
        while any(a.size for a in again):
            for k in range(len(self.langs)):
                moved = []
                for lo in range(0, again[k].size, 4096):
                    at = again[k][lo : lo + 4096]
                    counts[k, at], last = self._enter(k, grid[at], ends[k, at - 1], first[k, at], fresh[k, at])
                    moved.append(at[last != ends[k, at]])
                    ends[k, at] = last
                after = np.concatenate(moved) + 1 if moved else np.zeros(0, int)
                again[k] = after[after < len(grid)][inner[after[after < len(grid)]]]
        for k in range(len(self.langs)):
            out[k] = np.bincount(owner, weights=counts[k], minlength=len(texts)).astype(np.int64)
        return out, sizes, letters

    def _walk(self, grid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(phrases, last state) per language and block, a phrase starting with each block."""
        lanes = np.ascontiguousarray(grid.T).astype(np.int32)
        state = np.repeat(np.array(self.starts, np.int32)[:, None], len(grid), 1)
        count, fail = np.zeros_like(state), np.empty_like(state)
        for c in lanes:
            state += c
            np.take(self.table, state, out=state, mode="clip")
            np.right_shift(state, 31, out=fail)
            count -= fail
            state ^= fail
        return count, state

    def _enter(self, k: int, grid: np.ndarray, states: np.ndarray, count: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(phrases, last state) of blocks entered with ``states`` in language k; ``count`` and ``last`` are those of a fresh start.

        Both parses are walked together; where a phrase starts in both at one character, or both are
        between phrases, the rest is the same.
        """
        n = len(grid)
        mine, fresh = states.copy(), np.full(n, self.starts[k], np.int32)
        more, less = np.zeros(n, np.int32), np.zeros(n, np.int32)  # phrases of both until they are one
        out, end, live = count.copy(), last.copy(), np.arange(n)
        for j in range(grid.shape[1]):
            c = grid[live, j].astype(np.int32)
            a, b = self.table[mine[live] + c], self.table[fresh[live] + c]
            more[live] += a < 0
            less[live] += b < 0
            a, b = np.where(a < 0, ~a, a), np.where(b < 0, ~b, b)
            mine[live], fresh[live] = a, b
            one = a == b
            done = live[one]
            out[done] = count[done] + more[done] - less[done]
            live = live[~one]
            if not live.size:
                return out, end
        out[live] = count[live] + more[live] - less[live]
        end[live] = mine[live]
        return out, end

    def predict(self, texts: list) -> tuple[list, np.ndarray]:
        n, sizes, letters = self.phrases(["" if t is None else t for t in texts])
        if not self.langs:
            return ["und"] * len(texts), np.zeros(len(texts))
        h = n * self.cost[:, None] / np.maximum(sizes, 1)
        best = h.argmin(0)  # ties: the first language in order
        inv = 1.0 / np.maximum(h, 1e-9)
        score = np.where(letters, inv.max(0) / inv.sum(0), 0.0)
        return [self.langs[b] if ok else "und" for b, ok in zip(best, letters)], np.clip(score, 0.0, 1.0)


_TABLE: list = []


def _fold(text: str) -> np.ndarray:
    """Code points, letters in lower case, every run of other characters one space."""
    if not _TABLE:
        low = np.full(0x110000, 32, np.uint32)
        for c in range(0x110000):
            ch = chr(c)
            if ch.isalpha():
                low[c] = ord(ch.lower()[0])
        _TABLE.append(low)
    x = _TABLE[0][np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    if not x.size:
        return x
    keep = x != 32
    keep[1:] |= x[:-1] != 32
    keep[0] = True
    return x[keep]


def _parser(key: tuple | Learnt, alphabet: int) -> Parser:
    return keep_for("language_id", (key, alphabet), lambda: Parser(key if isinstance(key, Learnt) else dict(key), alphabet))


def identify(docs: DataFrame, texts: dict[str, str] | Learnt, params: LangParams = LangParams(), out_lang: str = "lang_pred", out_score: str = "score") -> DataFrame:
    """``docs`` with the predicted language and a score in [0, 1] (its share of inverse entropies).

    ``texts`` is what ``learn`` gives, or reference texts by language. Null texts and texts without a letter are
    ``und`` with score 0; so are all where nothing was learnt. Ties go to the first language in order. All rows, repeated ones too, and all columns
    stay but for earlier ones of the two output names; an empty table gives an empty one. Tasks get the
    phrases or texts (bounded by the parameters) and build the tables once.
    """
    key, alphabet = texts if isinstance(texts, Learnt) else tuple(sorted(texts.items())), params.alphabet
    keep = [c for c in docs.columns if c not in (out_lang, out_score)]
    shape = docs.select(*[F.col(f"`{c}`") for c in keep])
    schema = shape.withColumns({out_lang: F.lit("").cast("string"), out_score: F.lit(0.0)}).schema

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        p = _parser(key, alphabet)
        for b in batches:
            for lo in range(0, max(1, b.num_rows), 512):
                part = b.slice(lo, 512)
                lang, score = p.predict(part.column(part.schema.get_field_index("text")).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=[*part.schema.names, out_lang, out_score])

    return shape.mapInArrow(run, schema)


def held_out():
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 == 2
