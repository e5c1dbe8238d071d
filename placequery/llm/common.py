"""What several operators share: reading tables, bounded memos, files that Spark tasks write themselves."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterable
from itertools import filterfalse

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.shipping import ship_package
from ..functions.storage import scratch_path

MEMO_ENTRIES = 120_000
MEMO_KEY = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; Python workers can import this package afterwards."""
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole(text: str) -> Column:
    """Null texts count as empty."""
    return F.coalesce(F.col(text), F.lit(""))


def stored(df: DataFrame) -> DataFrame:
    """``df`` as a written table in the shared folder.

    Unlike a checkpoint it carries no constraints from plan to plan, which in loops of joins
    would grow with every round; readers take the columns they need.
    """
    path = scratch_path(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(table: DataFrame) -> None:
    """Delete a table that ``stored`` has written, once everything made from it is written itself."""
    files = table.inputFiles()
    if files:
        jvm, session = table.sparkSession._jvm, table.sparkSession._jsparkSession
        folder = jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        folder.getFileSystem(session.sessionState().newHadoopConf()).delete(folder, True)


_held: dict[tuple, list] = {}


def held(owner: str, key, make: Callable):
    """``make()``, kept by this Python worker under (owner, key) from batch to batch.

    Workers outlive stages. The first call in a new stage drops what other owners kept in earlier
    stages, so that a worker holds the models and memos of the operators at work and no others.
    """
    context = TaskContext.get()
    stage = context.stageId() if context else -1
    stale = [k for k, (at, _) in _held.items() if at != stage and k[0] != owner]
    if stale:
        for k in stale:
            del _held[k]
        gc.collect()
        pa.default_memory_pool().release_unused()
        libc = ctypes.CDLL(None)
        if hasattr(libc, "malloc_trim"):
            libc.malloc_trim(0)
    entry = _held.get((owner, key))
    if entry is None:
        entry = _held[owner, key] = [stage, make()]
    entry[0] = stage
    return entry[1]


def drop_held(owner: str) -> None:
    """Forget what ``owner`` keeps, before it keeps something else."""
    for k in [k for k in _held if k[0] == owner]:
        del _held[k]


class Memo(dict):
    """Bounded memo of a function: two generations, so frequent keys survive and memory stays fixed.

    A generation ends once it has ``entries`` keys; ``turns`` False leaves that to calls of
    ``turn``. Keys above MEMO_KEY characters are computed anew each time.
    """

    def __init__(self, compute: Callable, entries: int = MEMO_ENTRIES, turns: bool = True):
        super().__init__()
        self.compute, self.entries, self.turns, self.old = compute, entries, turns, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
        if self.turns:
            self.turn()
        if len(key) <= MEMO_KEY:
            self[key] = value
        return value

    def turn(self) -> None:
        if len(self) >= self.entries:
            self.old = dict(self)
            self.clear()

    def fresh(self, keys: Iterable) -> list:
        """Those of the distinct ``keys`` that are not kept; keys of the older generation are brought forward."""
        new = []
        for key in filterfalse(self.__contains__, keys):
            value = self.old.get(key)
            if value is None:
                new.append(key)
            else:
                self[key] = value
        return new

    def take(self, found: dict) -> None:
        """Keep what was computed elsewhere."""
        self.update((k, v) for k, v in found.items() if len(k) <= MEMO_KEY)

    def all(self, keys: list, compute: Callable[[list], list]) -> list:
        """Values of the distinct ``keys``; those that are not kept are computed together, once."""
        values, new = list(map(self.get, keys)), []
        for k in [k for k, value in enumerate(values) if value is None]:
            value = self.old.get(keys[k])
            if value is None:
                new.append(k)
            else:
                values[k] = self[keys[k]] = value
        for k, value in zip(new, compute([keys[k] for k in new]) if new else (), strict=True):
            values[k] = value
            if len(keys[k]) <= MEMO_KEY:
                self[keys[k]] = value
        return values


_WORD_BITS = 20


def with_maybe(df: DataFrame, key: Column, keys: DataFrame) -> DataFrame:
    """Add ``_maybe``: false only where ``key`` surely is not among the one column of ``keys``.

    A bit table of at most 2^20 rows is broadcast, however many keys there are. It spares rows a
    shuffle before an exact join; with very many keys it spares fewer.
    """

    def word(c: Column) -> Column:
        return F.pmod(F.shiftright(F.xxhash64(c), 6), F.lit(1 << _WORD_BITS))

    def bit(c: Column) -> Column:
        return F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(c), F.lit(64)).cast("int"))

    own = F.col(keys.columns[0])
    bits = keys.select(word(own).alias("_word"), bit(own).alias("_bit")).groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))
    marked = df.withColumn("_word", word(key)).join(F.broadcast(bits), "_word", "left")
    return marked.withColumn("_maybe", F.coalesce(F.col("_bits").bitwiseAND(bit(key)) != 0, F.lit(False))).drop("_word", "_bits")


def spread_files(manifest: DataFrame) -> DataFrame:
    """Manifest rows dealt out over the shuffle width; by number, as small rows would else be put in one task."""
    width = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.repartition(width, F.col("path"))


def file_system(uri: str):
    """(file system, path) of a URI or absolute path, for random access from Python tasks."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)
