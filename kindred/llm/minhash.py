"""Near-duplicate detection by b-bit MinHash with band candidates and exact confirmation.

1. Each text becomes a set of five-word shingles (64-bit hashes), ``PERMS`` minima, their
   low ``BITS`` bits packed, and band keys over the full minima. Equal sets form one class,
   found by a fingerprint with map-side combining, so copies cost one row each.
2. Classes that share a band key are compared in blocks of ``BLOCK`` rows by the bit counts
   of their signatures, corrected for chance collisions. Each block gives a spanning
   forest of what may be similar, never all pairs.
3. The components of that forest are the candidate groups. Their sets are compared
   exactly, again in blocks, with sparse counting; blocks give spanning forests of true links.
4. Components of the links name every document's group.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_staged, keep_for, min_label_components, staged

MASK = np.uint64(0xFFFFFFFFFFFFFFFF)


@dataclass(frozen=True)
class NearParams:
    shingle: int = 5
    percent: int = 80  # link when 100 * intersection >= percent * union
    bands: int = 24
    rows: int = 4  # minima in a band; bands * rows minima in all
    bits: int = 8  # low bits kept of a minimum
    slack: float = 0.17  # an estimate this far below the threshold is still a candidate (over four sigma)
    block: int = 1024
    broadcast_rows: int = 500_000  # classes in candidate groups that may be broadcast to fetch their texts


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift-multiply)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_ODD = np.uint64(0x9E3779B97F4A7C15)
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _ODD)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_POWERS: list = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2**64."""
    if len(_POWERS[0]) < n:
        n = max(n, 1 << 20)
        inv = np.uint64(pow(int(_ODD), -1, 1 << 64))
        _POWERS[0] = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, _ODD, np.uint64)]), dtype=np.uint64)
        _POWERS[1] = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, inv, np.uint64)]), dtype=np.uint64)
    return _POWERS[0], _POWERS[1]


def shingle_sets(texts: list, size: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text; fewer words than ``size``: the whole sequence as one."""
    out = []
    for t in texts:
        raw = _LOWER[np.frombuffer((t or "").encode("utf-8", "surrogatepass"), np.uint8)]
        space = _SPACE[raw]
        if not raw.size or space.all():
            out.append(np.zeros(0, np.uint64))
            continue
        edge = np.diff(np.concatenate([[True], space, [True]]).astype(np.int8))
        lo, hi = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        up, down = _powers(raw.size + 1)
        sums = np.concatenate([[np.uint64(0)], np.cumsum(_BYTE[raw] * up[: raw.size], dtype=np.uint64)])
        w = mix((sums[hi] - sums[lo]) * down[lo] + (hi - lo).astype(np.uint64))
        n = len(w)
        k = min(size, n)
        h = np.full(n - k + 1, np.uint64(k))
        for j in range(k):
            h = mix(h * _ODD + w[j : n - k + 1 + j])
        out.append(np.unique(h))
    return out


def signatures(sets: list, params: NearParams) -> tuple[np.ndarray, np.ndarray]:
    """(packed low bits [n, bytes], band keys [n, bands]) of nonempty sets."""
    perms = params.bands * params.rows
    flat = np.concatenate(sets)
    starts = np.cumsum([0, *[len(s) for s in sets[:-1]]])
    rng = np.random.RandomState(7)
    a = (rng.randint(0, 2**62, perms).astype(np.uint64) << np.uint64(1)) | np.uint64(1)
    b = rng.randint(0, 2**62, perms).astype(np.uint64)
    low = np.empty((len(sets), perms), np.uint64)
    for k in range(perms):
        low[:, k] = np.minimum.reduceat((flat * a[k] + b[k]) ^ (flat >> np.uint64(29)), starts)
    low = mix(low)
    packed = (low & np.uint64((1 << params.bits) - 1)).astype(np.uint8)
    keys = np.empty((len(sets), params.bands), np.uint64)
    for band in range(params.bands):
        h = np.full(len(sets), np.uint64(band + 1))
        for r in range(params.rows):
            h = mix(h * _ODD + low[:, band * params.rows + r])
        keys[:, band] = h
    return packed, keys


def _signed(docs: DataFrame, params: NearParams) -> DataFrame:
    """doc_id, tv (a hash of the text), n, fp1, fp2 (a fingerprint of the set), sig, bands; one row per row."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        keep_for("minhash")
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                sets = shingle_sets(part.column(1).to_pylist(), params.shingle)
                n = np.array([len(s) for s in sets], np.int64)
                fp = np.zeros((len(sets), 2), np.int64)
                sig, bands = [None] * len(sets), [None] * len(sets)
                full = np.flatnonzero(n)
                if full.size:
                    own = [sets[i] for i in full]
                    at = np.cumsum([0, *n[full][:-1]])
                    flat = np.concatenate(own)
                    fp[full, 0] = np.add.reduceat(mix(flat), at).view(np.int64)
                    fp[full, 1] = np.bitwise_xor.reduceat(mix(flat * _ODD), at).view(np.int64)
                    packed, keys = signatures(own, params)
                    for j, i in enumerate(full):
                        sig[i], bands[i] = packed[j].tobytes(), keys[j].view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), pa.array(n), pa.array(fp[:, 0]), pa.array(fp[:, 1]), pa.array(sig, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                    names=["doc_id", "tv", "n", "fp1", "fp2", "sig", "bands"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", F.xxhash64("text").alias("tv")).mapInArrow(run, f"doc_id {kind}, tv long, n long, fp1 long, fp2 long, sig binary, bands array<long>")


def _blocked(rows: DataFrame, key: str, ident: str, block: int) -> DataFrame:
    """Rows of keys with two rows or more, with nb (blocks of the key) and mine (the row's block).

    Sizes come from a map-side combined count.
    """
    sizes = rows.groupBy(key).agg(F.count(F.lit(1)).alias("m")).filter("m > 1")
    split = rows.join(sizes, key).withColumn("nb", F.ceil(F.col("m") / block).cast("int")).drop("m")
    return split.withColumn("mine", F.pmod(F.xxhash64(ident), F.col("nb").cast("long")).cast("int"))


def _dealt(blocked: DataFrame) -> DataFrame:
    """Rows dealt to block pairs (bi <= bj) of at most about ``2 * block`` rows: a hot key's rows go to several tasks."""
    pairs = F.transform(F.sequence(F.lit(0), F.col("nb") - 1), lambda o: F.struct(F.least(F.col("mine"), o).alias("bi"), F.greatest(F.col("mine"), o).alias("bj")))
    return blocked.withColumn("p", F.explode(pairs)).withColumn("bi", F.col("p.bi")).withColumn("bj", F.col("p.bj")).drop("p", "nb", "mine")


def _groups(batches: Iterator, key: list[str]) -> Iterator:
    """Whole groups of rows sorted by ``key``, across Arrow batches; yields one pandas frame of complete groups."""
    import pandas as pd

    rest = None
    for pdf in batches:
        if rest is not None:
            pdf = pd.concat([rest, pdf], ignore_index=True)
        if not len(pdf):
            continue
        k = pdf[key].to_numpy()
        same = (k == k[-1]).all(1)
        cut = len(pdf) - int(same[::-1].argmin()) if not same.all() else 0
        rest = pdf.iloc[cut:].reset_index(drop=True)
        if cut:
            yield pdf.iloc[:cut].reset_index(drop=True)
    if rest is not None and len(rest):
        yield rest


def _bounds(pdf, key: list[str]) -> np.ndarray:
    k = pdf[key].to_numpy()
    return np.concatenate([[0], np.flatnonzero((k[1:] != k[:-1]).any(1)) + 1, [len(k)]])


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Root (least member) of each of n nodes under the edges (a, b)."""
    root = np.arange(n)
    while True:
        m = root.copy()
        np.minimum.at(m, a, root[b])
        np.minimum.at(m, b, root[a])
        m = m[m]
        np.minimum.at(m, root, m.copy())
        m = m[m]
        if (m == root).all():
            return root
        root = m


def _candidates(classes: DataFrame, params: NearParams) -> DataFrame:
    """Edges (a, b): spanning forests, per bucket block, of pairs whose estimate comes near the threshold.

    Band keys meet without signatures; only classes in a bucket of two or more fetch theirs.
    """
    perms, floor = params.bands * params.rows, params.percent / 100 - params.slack
    chance = 2.0**-params.bits  # two different minima agree in their low bits this often
    need = (floor * (1 - chance) + chance) * perms

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        keep_for("minhash")
        key = ["k", "bi", "bj"]
        for pdf in _groups(batches, key):
            at, ids = _bounds(pdf, key), pdf["rep"].to_numpy()
            sig = np.frombuffer(b"".join(pdf["sig"]), np.uint8).reshape(len(pdf), perms)
            size, out = np.diff(at), []
            few = size <= 16
            start, end = at[:-1][few], at[1:][few]
            for d in range(1, 16):  # small buckets of all keys at once
                i = np.concatenate([np.arange(s, e - d) for s, e in zip(start, end) if e - s > d] or [np.zeros(0, int)])
                if not i.size:
                    break
                ok = (sig[i] == sig[i + d]).sum(1) >= need
                out.append((ids[i[ok]], ids[i[ok] + d]))
            for s, e in zip(at[:-1][~few], at[1:][~few]):
                x = sig[s:e]
                a, b = [], []
                for r in range(0, e - s, 64):
                    hit = (x[r : r + 64, None, :] == x[None, :, :]).sum(2) >= need
                    p, q = np.nonzero(hit)
                    a.append(p + r)
                    b.append(q)
                root = _forest(np.concatenate(a), np.concatenate(b), e - s)
                m = root != np.arange(e - s)
                out.append((ids[s:e][m], ids[s:e][root[m]]))
            if out:
                yield pd.DataFrame({"a": np.concatenate([o[0] for o in out]), "b": np.concatenate([o[1] for o in out])})

    kind = classes.schema["rep"].dataType.simpleString()
    shared = _blocked(classes.select("c", F.explode("bands").alias("k")), "k", "c", params.block)
    dealt = _dealt(shared.join(classes.select("c", "rep", "sig"), "c")).select("k", "bi", "bj", "rep", "sig")
    return dealt.repartition("k", "bi", "bj").sortWithinPartitions("k", "bi", "bj").mapInPandas(run, f"a {kind}, b {kind}")


def exact_links(sets: list, percent: int) -> np.ndarray:
    """Root of each set's component under 100 * |x & y| >= percent * |x | y|, by counting shared elements."""
    n = len(sets)
    size = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(n), size)
    _, inv, freq = np.unique(flat, return_inverse=True, return_counts=True)
    common = freq[inv] > 1  # elements of one set alone take no part in any intersection
    owner, inv = owner[common], inv[common]
    a, b = [], []
    col = np.unique(inv, return_inverse=True)[1]
    width = int(col.max()) + 1 if col.size else 0
    share = np.zeros((n, n), np.float32)
    for lo in range(0, width, 4096):  # a slab of elements at a time bounds the memory
        m = (col >= lo) & (col < lo + 4096)
        x = np.zeros((n, min(4096, width - lo)), np.float32)
        x[owner[m], col[m] - lo] = 1
        share += x @ x.T
    share = share.astype(np.float64)  # a hundred times a large count would not be whole in single precision
    hit = 100 * share >= percent * (size[:, None] + size[None, :] - share)
    a, b = np.nonzero(hit)
    return _forest(a, b, n)


def _confirmed(members: DataFrame, docs: DataFrame, params: NearParams) -> DataFrame:
    """Edges (a, b) of true links: spanning forests per block pair of each candidate group.

    The text of a class is that of one of its rows, found by id and text hash; rows
    repeating both are the same set.
    """
    texts = docs.select(F.col("doc_id").alias("rep"), F.xxhash64("text").alias("tv"), "text")
    few = members.count() <= params.broadcast_rows  # checked: so many rows of six numbers; beyond it texts are shuffled
    text = _dealt(texts.join(F.broadcast(members) if few else members, ["rep", "tv"]))
    kind = members.schema["rep"].dataType.simpleString()

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        keep_for("minhash")
        key = ["g", "bi", "bj"]
        for pdf in _groups(batches, key):
            at, a, b = _bounds(pdf, key), [], []
            for s, e in zip(at[:-1], at[1:]):
                part = pdf.iloc[s:e].drop_duplicates("c")
                ids = part["rep"].to_numpy()
                root = exact_links(shingle_sets(part["text"].tolist(), params.shingle), params.percent)
                m = root != np.arange(len(ids))
                a.append(ids[m])
                b.append(ids[root[m]])
            yield pd.DataFrame({"a": np.concatenate(a), "b": np.concatenate(b)})

    return text.select("g", "bi", "bj", "c", "rep", "text").repartition("g", "bi", "bj").sortWithinPartitions("g", "bi", "bj").mapInPandas(run, f"a {kind}, b {kind}")


def near_duplicates(docs: DataFrame, params: NearParams = NearParams()) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    Null, empty and blank texts have no shingles and are linked with nothing. Documents
    are told apart by doc_id, of any type (a null id forms no link); rows that repeat an id are one
    document, which is linked by each of its texts. Ties go to the least id. An empty table
    gives an empty one; other columns take no part.
    """
    signed = staged(_signed(docs, params), "signed")
    full = signed.filter("n > 0 AND doc_id IS NOT NULL")
    first = F.min(F.struct("doc_id", "tv"))
    classes = full.groupBy("fp1", "fp2", "n").agg(first.alias("f"), F.first("sig").alias("sig"), F.first("bands").alias("bands"))
    classes = staged(classes.select("fp1", "fp2", "n", F.col("f.doc_id").alias("rep"), F.col("f.tv").alias("tv"), F.xxhash64("fp1", "fp2", "n").alias("c"), "sig", "bands"), "classes")
    edges = staged(_candidates(classes, params), "candidates")
    groups = min_label_components(edges, "groups")
    members = classes.select("c", "rep", "tv").join(groups.select(F.col("node").alias("rep"), F.col("label").alias("g")), "rep")
    members = staged(_blocked(members, "g", "c", params.block), "members")
    # one document with several texts joins their classes
    several = full.select("doc_id", "fp1", "fp2", "n").distinct().groupBy("doc_id").agg(F.count(F.lit(1)).alias("m")).filter("m > 1").select("doc_id")
    same = full.join(several, "doc_id", "left_semi").select("doc_id", "fp1", "fp2", "n").join(classes.select("fp1", "fp2", "n", "rep"), ["fp1", "fp2", "n"])
    links = staged(_confirmed(members, docs, params).unionByName(same.select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))), "links")
    labels = min_label_components(links, "components")
    named = classes.select("fp1", "fp2", "n", "rep").join(labels.select(F.col("node").alias("rep"), "label"), "rep", "left").select("fp1", "fp2", "n", F.coalesce("label", "rep").alias("c"))
    named = staged(named, "named")
    drop_staged(edges, groups, members, links, classes, labels)
    out = signed.select("doc_id", "n", "fp1", "fp2").join(named, ["fp1", "fp2", "n"], "left")
    comp = F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.coalesce("c", "doc_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), comp.alias("component_id"), F.coalesce(comp == F.col("doc_id"), F.lit(True)).alias("kept"))
