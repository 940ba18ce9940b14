"""Helpers of the corpus operators: lineage cuts, sorted-run streaming, components."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import shutil
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

CHECKPOINT = "spark.checkpoint.dir"


def one_process(spark: SparkSession) -> bool:
    """Whether driver and tasks are one process (``local-cluster`` has executors of its own)."""
    return spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables: spark.checkpoint.dir, which all executors share.

    Only where that is unset (a local session) a temporary folder takes its place.
    """
    folder = spark.conf.get(CHECKPOINT, None)
    if not folder:
        folder = spark.sparkContext.getConf().get(CHECKPOINT, None)
    if not folder:
        if not one_process(spark):
            raise RuntimeError(f"{CHECKPOINT} must name a folder that all executors share")
        folder = getattr(spark.sparkContext, "_terracell_folder", None)
        if folder is None:
            made = tempfile.mkdtemp(prefix="terracell-")
            atexit.register(shutil.rmtree, made, ignore_errors=True)
            folder = spark.sparkContext._terracell_folder = f"file://{made}"
    return f"{folder.rstrip('/')}/terracell/{spark.sparkContext.applicationId}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here.

    A lost executor then costs a reread, not a recomputation. The tables go with
    ``drop_cuts``, at the end of a ``scratch`` block, or when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    if not any(p.startswith(shared_folder(spark)) for p in _CUTS):  # the first: all of the application's go with its JVM
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(folder)
    _CUTS.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: paths of the tables cut so far
_CUTS: list[str] = []


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """A block whose cut tables are removed at its end, but for those given to the yielded function.

    What the block returns must rest on kept tables only.
    """
    begin, kept = len(_CUTS), set()

    def keep(t: DataFrame) -> DataFrame:
        kept.update(f.rsplit("/", 2)[-2] for f in t.inputFiles())
        return t

    yield keep
    _delete(spark, {p for p in _CUTS[begin:] if p.rsplit("/", 1)[-1] not in kept})


def _delete(spark: SparkSession, paths: set[str]) -> None:
    for p in paths:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def drop_cuts(spark: SparkSession, *tables: DataFrame) -> None:
    """Remove these cut tables, or all of this application if none is named."""
    _delete(spark, {f.rsplit("/", 1)[0] for t in tables for f in t.inputFiles()} if tables else {shared_folder(spark)})


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def tidy(run: Callable) -> Callable:
    """An Arrow function that leaves no memory behind: freed pages go back to the system when a task ends.

    Batches are bounded by bytes, 8 MB instead of the session's default of 64 MB,
    as texts may be long; a bound that the user has set stays.
    """
    spark = SparkSession.getActiveSession()
    if spark is not None and spark.conf.get(ARROW_BYTES) in ("67108864b", "67108864", "64MB", "64m"):
        spark.conf.set(ARROW_BYTES, "8m")

    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if sys.platform == "linux":
                ctypes.CDLL(None).malloc_trim(0)

    return tidied


def fresh(df: DataFrame, *names: str) -> list[str]:
    """These names, with underscores before them where the table has them (in any case) already."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def smallest_of_each(df: DataFrame, key: str, order: str, most: int, spread: int = 64) -> DataFrame:
    """(key, order): the ``most`` smallest distinct values of ``order`` for each key.

    Every task keeps its own smallest first, a key is then ranked in ``spread``
    parts, and only their smallest meet: no task ranks a whole key, however many
    rows it has and however often a row repeats. ``order`` is a 64-bit integer.
    """

    def low(batches):
        best: dict = {}
        for batch in batches:
            t = pa.Table.from_batches([batch]).group_by([key, order]).aggregate([])
            keys, values = t.column(key).to_pylist(), t.column(order).to_numpy()
            at: dict = {}
            for i, k in enumerate(keys):
                at.setdefault(k, []).append(i)
            for k, rows in at.items():
                both = np.unique(np.concatenate((best.get(k, values[:0]), values[rows])))
                best[k] = both[:most]
        out = [(k, v) for k, vs in best.items() for v in vs.tolist()]
        kind = next((f.dataType for f in schema if f.name == key))
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], to_arrow_type(kind)), pa.array([v for _, v in out], pa.int64())], names=[key, order])

    rows = df.select(key, F.col(order).cast("bigint").alias(order))
    schema = rows.schema
    few = rows.mapInArrow(tidy(low), schema).distinct().withColumn("part", F.pmod(F.xxhash64(F.col(order)), F.lit(spread)))
    few = few.withColumn("n", F.row_number().over(Window.partitionBy(key, "part").orderBy(order))).where(F.col("n") <= most)
    few = few.withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy(order))).where(F.col("n") <= most)
    return few.select(key, order)


def gathered(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows of equal keys in one partition, sorted by keys and ``order``.

    The rows are dealt by a hash expression, not by the keys themselves: after a
    join on the same keys the planner would drop an equal repartitioning, and the
    adaptive planner may then turn that join into one that keeps no key together.
    """
    return df.repartition(F.xxhash64(*keys)).sortWithinPartitions(*keys, *order)


def bitmap_of(df: DataFrame, bits: int, column: str = "fp") -> bytes:
    """A map of 2**bits bits over the top bits of a 64-bit hash column.

    Its size is fixed, whatever the table's; at most 2**(bits - 5) rows reach the
    driver. It has false positives, never false negatives.
    """
    slots = df.select(F.shiftrightunsigned(column, 64 - bits).alias("slot"))
    rows = slots.groupBy(F.shiftright("slot", 5).alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(slot & 31 AS int)))").alias("b")).toPandas()
    words = np.zeros(1 << (bits - 5), dtype=np.uint32)
    words[rows["w"].to_numpy(dtype=np.int64)] = rows["b"].to_numpy(dtype=np.int64) & 0xFFFFFFFF
    return words.astype("<u4").tobytes()


def in_bitmap(bitmap: bytes, fp: np.ndarray, bits: int) -> np.ndarray:
    """Which hashes the map may hold."""
    table = np.frombuffer(bitmap, dtype=np.uint8)
    slot = fp.view(np.uint64) >> np.uint64(64 - bits)
    return (table[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1


def sorted_runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of whole key runs from batches sorted by ``keys``.

    Each yielded table holds complete runs only; a run is carried over batch ends.
    Bounding a run is the caller's duty (by a block number among the keys).
    """
    rest: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        last = int(run_starts(t, keys)[-1])
        if last == 0 and rest:  # one run: does it go on with the one before?
            last = len(run_starts(pa.concat_tables([rest[-1].slice(rest[-1].num_rows - 1), t.slice(0, 1)]), keys)) - 1
            if last:
                yield pa.concat_tables(rest)
                rest = []
            rest.append(t)
            continue
        if last:
            yield pa.concat_tables([*rest, t.slice(0, last)])
            rest = []
        rest.append(t.slice(last))
    if rest:
        yield pa.concat_tables(rest)


def first_of_equals(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """Of successive rows with equal keys the first only."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        new = np.zeros(batch.num_rows, dtype=bool)
        new[run_starts(pa.Table.from_batches([batch]), keys)] = True
        here = [batch.column(k)[0].as_py() for k in keys]
        new[0] = here != last
        last = [batch.column(k)[batch.num_rows - 1].as_py() for k in keys]
        yield batch if new.all() else batch.filter(pa.array(new))


def run_starts(t: pa.Table, keys: list[str]) -> np.ndarray:
    """Row numbers at which a new key begins (0 always)."""
    new = np.zeros(t.num_rows, dtype=bool)
    new[:1] = True
    for k in keys:
        v = t.column(k).combine_chunks()
        v = v.to_numpy(zero_copy_only=False)
        new[1:] |= v[1:] != v[:-1]
    return np.flatnonzero(new)


class Forest:
    """Union by smaller number over 0..n-1."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def labels(self) -> np.ndarray:
        """The root of every number."""
        up = np.array(self.up, dtype=np.int64)
        while (above := up[up]).tobytes() != up.tobytes():
            up = above
        self.up = up.tolist()
        return up

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component): the smallest node reachable, for every node of an edge.

    ``edges`` has two columns of one integer type. Alternating large and small
    stars: every round hangs nodes under the smallest neighbour they know, so
    paths shrink geometrically; a round is two grouped minima and joins, and is
    cut. Rounds go on until one changes nothing. A hub's rows meet its single
    minimum in a join that AQE can split.
    """
    a, b = edges.columns
    e = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a <> b").distinct()
    e, kept = cut(e, name), []
    before = _mark(e)
    while True:
        sym = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select("b", "a"))
        least = sym.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = sym.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(
            F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))).alias("e")
        )
        nxt = cut(small.select("e.a", "e.b").where("a <> b").distinct(), name)
        kept.append(e)
        e = nxt
        now = _mark(e)
        if now == before:
            break
        before = now
    drop_cuts(e.sparkSession, *kept)
    roots = e.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
