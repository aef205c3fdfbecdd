"""Helpers the corpus operators share: reading tables, staging, word patterns, components.

Words are maximal runs of characters other than the six ASCII white-space
characters, ``[^\\x20\\x09-\\x0D]+``, everywhere in this subpackage.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space between words, as a Java and Python character class.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor and the driver can reach.

    Only where none is named and all runs in this one process (tests) is a folder made; a
    cluster without one is an error, as each executor would write to its own disk.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="kindred-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the driver ends at the latest."""
    path = f"{shared_dir(spark)}/kindred/{name}-{uuid.uuid4().hex}"
    fs, p = _hadoop(spark, path)
    fs.deleteOnExit(p)
    return path


def _hadoop(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def staged(df: DataFrame, name: str, files: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    It cuts the lineage like a reliable checkpoint, survives lost executors and,
    being columnar, lets later readers prune columns. ``files`` bounds the number of files of a
    table whose size is known: rounds over a small table don't write hundreds each.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    (df.coalesce(files) if files else df).write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._kindred_path = path  # for drop_staged
    return out


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that no column of ``df`` has, in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        taken.add(n.lower())
        out.append(n)
    return out


def drop_staged(*frames: DataFrame) -> None:
    """Delete staged tables that no returned plan reads any more."""
    for df in frames:
        path = getattr(df, "_kindred_path", None)
        if path:
            drop_path(df.sparkSession, path)


def drop_path(spark: SparkSession, path: str) -> None:
    fs, p = _hadoop(spark, path)
    fs.delete(p, True)


def words(text: Column) -> Column:
    """Array of the words of ``text`` (null: none)."""
    cut = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), rf"^{SPACE}+", ""), rf"{SPACE}+")
    return F.filter(cut, lambda w: w != "")


_KEPT: dict = {}


def keep_for(owner: str, key=None, make=None):
    """What ``make`` gives, kept in this Python worker for later tasks of ``owner`` with the same ``key``.

    Workers serve one operator after the other. What another one kept (automata, tokenizers, word
    caches) is let go and its memory given back to the system, so a worker holds the tables of one operator
    at a time. Operators that keep nothing call it with their name alone.
    """
    if _KEPT.get("owner") != owner or (make is not None and _KEPT.get("key") != key):
        _KEPT.clear()
        gc.collect()
        with contextlib.suppress(ImportError):
            import pyarrow

            pyarrow.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # glibc alone has it
            ctypes.CDLL(None).malloc_trim(0)
        _KEPT["owner"] = owner
    if make is not None and "value" not in _KEPT:
        _KEPT.update(key=key, value=make())
    return _KEPT.get("value")


def min_label_components(edges: DataFrame, name: str = "cc") -> DataFrame:
    """Connected components of the undirected ``edges(a, b)``: ``(node, label)``, label the least node.

    Each round takes the least label among neighbours, hooks all nodes of one label to the
    least label any of them saw, then jumps to that label's own label; it ends when no
    label moves, as then no edge joins two labels. On paths and chains of shuffled ids the rounds
    grow with the logarithm of their length. Rounds are joins and map-side combined minima;
    no adjacency list is ever gathered and nothing but one count goes to the driver.
    """
    both = staged(
        edges.select("a", "b").filter("a <> b").distinct().select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.a", "e.b"),
        f"{name}-edges",
    )
    files = both.count() // 200_000 + 1
    labels = staged(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), f"{name}-0", files)
    moved, i = 1, 0
    while moved:
        i += 1
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        seen = staged(labels.join(near, "node").select("node", "label", "near"), f"{name}-seen-{i}", files)
        hook = seen.filter("near < label").groupBy("label").agg(F.min("near").alias("hook"))  # lower labels seen by any node of a label
        low = seen.join(hook, "label", "left").select("node", "label", F.least("label", "near", "hook").alias("low"))
        jump = labels.select(F.col("node").alias("low"), F.col("label").alias("far"))
        new = staged(low.join(jump, "low").select("node", F.least("low", "far").alias("new"), (F.least("low", "far") < F.col("label")).alias("moved")), f"{name}-{i}", files)
        moved = new.filter("moved").limit(1).count()
        drop_staged(labels, seen)
        labels = new.select("node", F.col("new").alias("label"))
        labels._kindred_path = new._kindred_path
    drop_staged(both)
    return labels
