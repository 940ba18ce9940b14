"""File catalogues: name patterns, discovery, steps, and resolving inputs of operations."""

from __future__ import annotations

import re
import zlib
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Fields of a name pattern and what each matches.
FIELDS = {"Y": r"\d{4}", "m": r"\d{2}", "d": r"\d{2}", "H": r"\d{2}", "M": r"\d{2}", "S": r"\d{2}", "A": "[A-Za-z]+", "B": "[A-Za-z]+", "C": "[A-Za-z]+", "a": "[a-z]+", "b": "[a-z]+", "c": "[a-z]+"}
TIME_FIELDS = "YmdHMS"


def to_regex(pattern: str) -> tuple[str, list[str]]:
    """(regular expression, field of each group); ``?`` is any one character, other text stands for itself.

    A field seen again must repeat its value; a lower-case tag field (a, b, c)
    after its upper-case one is that value in lower case, checked by ``matches``.
    """
    out, groups, at = [], [], 0
    for m in re.finditer(r"%([A-Za-z])|\?", pattern):
        out.append(re.escape(pattern[at : m.start()]))
        at = m.end()
        if m[0] == "?":
            out.append(".")
            continue
        if m[1] not in FIELDS:
            raise ValueError(f"unknown field %{m[1]}")
        if m[1] in groups:
            out.append(f"\\{groups.index(m[1]) + 1}")
        else:
            groups.append(m[1])
            out.append(f"({FIELDS[m[1]]})")
    out.append(re.escape(pattern[at:]))
    return "^" + "".join(out) + "$", groups


def matches(files: DataFrame, pattern: str, name: str = "name") -> DataFrame:
    """Files that match, with time and tags (the values of %A, %B, %C)."""
    regex, groups = to_regex(pattern)
    part = {g: F.regexp_extract(name, regex, i + 1) for i, g in enumerate(groups)}
    rows = files.where(F.col(name).rlike(regex))
    for low, high in (("a", "A"), ("b", "B"), ("c", "C")):
        if low in part and high in part:
            rows = rows.where(part[low] == F.lower(part[high]))
    number = lambda f, default: part[f].cast("int") if f in part else F.lit(default)
    time = F.make_timestamp(number("Y", 1), number("m", 1), number("d", 1), number("H", 0), number("M", 0), number("S", 0)) if "Y" in part else F.lit(None).cast("timestamp")
    tags = F.array(*[part[t] for t in "ABC" if t in part]) if any(t in part for t in "ABC") else F.array().cast("array<string>")
    return rows.withColumn("time", time).withColumn("tags", tags)


def unmatched(files: DataFrame, patterns: list[str], name: str = "name") -> DataFrame:
    """Files that no pattern matches."""
    return files.where(~reduce(lambda a, b: a | b, [F.col(name).rlike(to_regex(p)[0]) for p in patterns]))


def format_name(time: Column, pattern: str) -> Column:
    """A file name generated from a time."""
    layout = {"Y": "yyyy", "m": "MM", "d": "dd", "H": "HH", "M": "mm", "S": "ss"}
    parts = [F.date_format(time, layout[p[1]]) if re.fullmatch(r"%[YmdHMS]", p) else F.lit(p) for p in re.split(r"(%[YmdHMS])", pattern) if p]
    return F.concat(*parts)


_REVERSED = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


def cksum(content: bytes) -> int:
    """The checksum that the POSIX command prints: its polynomial runs from the top bit, over the content and its length.

    zlib's runs from the lowest bit, so bits are mirrored before and after.
    """
    size = len(content)
    tail = size.to_bytes((size.bit_length() + 7) // 8, "little")
    mirrored = zlib.crc32(tail.translate(_REVERSED), zlib.crc32(content.translate(_REVERSED), 0xFFFFFFFF))
    return int(f"{mirrored:032b}"[::-1], 2)


def _with_checksums(files: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            sums = [cksum(c.as_buffer().to_pybytes()) for c in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sums, pa.int64())], names=["path", "length", "checksum"])

    return files.select("path", "length", "content").mapInArrow(run, "path string, length bigint, checksum bigint")


def discover(spark: SparkSession, path: str, dataset: str, patterns: list[str], checksum: bool = False) -> DataFrame:
    """Catalogue rows of the files below a folder. The listing is one scan; contents are read for checksums only."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    listed = _with_checksums(reader) if checksum else reader.select("path", "length", F.lit(None).cast("bigint").alias("checksum"))
    rows = listed.select("path", F.regexp_replace("path", "^.*/", "").alias("name"), F.col("length").alias("size"), "checksum")
    found = None
    for k, p in enumerate(patterns):
        part = matches(rows, p).withColumn("subset", F.lit(k))
        found = part if found is None else found.unionByName(part)
    order = Window.partitionBy("subset").orderBy("name")
    return found.select(F.lit(dataset).alias("dataset"), "subset", (F.row_number().over(order) - 1).alias("entry"), "path", "time", "tags", "checksum", "size")


def update(old: DataFrame, new: DataFrame) -> DataFrame:
    """A catalogue with the new files added after the old entries; files that are there stay as they are."""
    fresh = new.join(old.select("dataset", "path"), ["dataset", "path"], "left_anti")
    last = old.groupBy("dataset", "subset").agg(F.max("entry").alias("last"))
    order = Window.partitionBy("dataset", "subset").orderBy("path")
    fresh = fresh.join(last, ["dataset", "subset"], "left").withColumn("entry", (F.coalesce(F.col("last"), F.lit(-1)) + F.row_number().over(order)).cast("int")).drop("last")
    return old.unionByName(fresh.select(*old.columns))


def steps(spark: SparkSession, kind: str, start: str, end: str) -> DataFrame:
    """(step, time) of an operation's runs: once, daily, monthly (mid-month), annual."""
    rule = {"once": None, "daily": "INTERVAL 1 DAY", "monthly": "INTERVAL 1 MONTH", "annual": "INTERVAL 1 YEAR"}[kind]
    if rule is None:
        return spark.sql(f"SELECT 0 AS step, DATE'{start}' AS time")
    rows = spark.sql(f"SELECT posexplode(sequence(DATE'{start}', DATE'{end}', {rule})) AS (step, time)")
    if kind == "monthly":
        middle = F.date_add(F.trunc("time", "month"), F.floor(F.datediff(F.add_months(F.trunc("time", "month"), 1), F.trunc("time", "month")) / 2).cast("int"))
        rows = rows.withColumn("time", middle)
    return rows


def step_index(time: Column, start: str) -> Column:
    """Index of the daily step of a time."""
    return F.datediff(time, F.lit(start).cast("date"))


def resolve(step_rows: DataFrame, inputs: list[tuple[str, DataFrame, str]]) -> DataFrame:
    """Parameters of each operation: every input's files, steps without needed files skipped, runs numbered anew.

    inputs: (name, files with columns step and file, policy).
    """
    needed = step_rows.select("step")
    for _, files, policy in inputs:
        if policy == "skip":
            needed = needed.join(files.select("step").distinct(), "step", "left_semi")
    # the steps alone are numbered, before any list of files is made
    out = step_rows.join(needed.distinct().withColumn("operation", F.row_number().over(Window.orderBy("step")) - 1), "step")
    for name, files, policy in inputs:
        grouped = files.groupBy("step").agg(F.sort_array(F.collect_list("file")).alias(name))
        out = out.join(grouped, "step", "inner" if policy == "skip" else "left")
        if policy == "not_allowed":
            out = out.withColumn(name, F.coalesce(F.col(name), F.raise_error(F.lit(f"no {name} for a step")).cast(grouped.schema[name].dataType)))
    return out


def outputs(operations: DataFrame, pattern: str) -> DataFrame:
    """Output files of operations, one per name, numbered in the order of names."""
    names = operations.select(format_name(F.col("time"), pattern).alias("name")).distinct()
    return names.withColumn("entry", F.row_number().over(Window.orderBy("name")) - 1)


def annual_batches(files: DataFrame, calendar: DataFrame) -> DataFrame:
    """Per year the file index of each of its days in order, -1 where there is none."""
    days = calendar.select("day").distinct().join(files.select("day", "file"), "day", "left")
    entry = F.struct("day", F.coalesce("file", F.lit(-1)).alias("file"))
    rows = days.groupBy(F.year("day").alias("year")).agg(F.array_sort(F.collect_list(entry)).alias("d"))
    return rows.select("year", F.col("d")["file"].alias("files"))


REGISTRY: dict[str, object] = {}


def operation(name: str):
    """Register a function by name; catalogues run functions by this registry only, never by a path in data."""

    def add(f):
        REGISTRY[name] = f
        return f

    return add


def run(name: str, *args, **kwargs):
    if name not in REGISTRY:
        raise KeyError(f"no operation {name!r} is registered")
    return REGISTRY[name](*args, **kwargs)


def run_group(name: str, operations: DataFrame, size: int, index: int, just_list: bool = False):
    """Run one registered function on the parameters of a whole batch of operations, in their order.

    ``just_list`` gives the parameters without running anything.
    """
    if size < 1:
        raise ValueError("a batch has at least one operation")
    rows = [r.asDict(recursive=True) for r in batch(operations, size, index).orderBy("operation").collect()]  # at most ``size``
    return rows if just_list else run(name, rows)


def archive_members(spark: SparkSession, path: str) -> DataFrame:
    """(archive, name, size) of the members of tar and tar.gz files; an archive's index is read in one task."""
    import io
    import tarfile

    import pandas as pd

    def listing(frames):
        for frame in frames:
            rows = []
            for name, content in zip(frame["path"], frame["content"], strict=True):
                with tarfile.open(fileobj=io.BytesIO(content)) as tar:
                    rows += [(name, m.name, m.size) for m in tar.getmembers() if m.isfile()]
            yield pd.DataFrame(rows, columns=["archive", "name", "size"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{tar,tar.gz,tgz}").load(path).select("path", "content")
    return files.mapInPandas(listing, "archive string, name string, size bigint")


def write_snapshot(rows: DataFrame, path: str, toolchain: str) -> str:
    """Write a catalogue under a new identifier, with the code version that made it; gives the identifier."""
    import uuid

    key = str(uuid.uuid4())
    rows.withColumn("catalogue_id", F.lit(key)).withColumn("toolchain", F.lit(toolchain)).write.mode("overwrite").json(path)
    return key


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    from terracell.sources import schema

    return spark.read.schema(schema.CATALOGUE + ", catalogue_id string, toolchain string").json(path)


def check_toolchain(rows: DataFrame, toolchain: str) -> DataFrame:
    """Catalogue rows made by another code version (none: provenance agrees)."""
    return rows.where(F.col("toolchain") != toolchain)


def entry_path(rows: DataFrame, dataset: str, subset: int, entry: int) -> DataFrame:
    """The path of one entry; the three keys reach the scan as filters."""
    return rows.where((F.col("dataset") == dataset) & (F.col("subset") == subset) & (F.col("entry") == entry)).select("path")


def describe(name: str, kind: str, start: str, end: str, inputs: dict[str, tuple[str, str]], output: str) -> dict:
    """An operation's description from a template: steps, inputs (pattern, policy) and output pattern, checked."""
    if kind not in ("once", "daily", "monthly", "annual"):
        raise ValueError(f"unknown step {kind!r}")
    for pattern, policy in inputs.values():
        to_regex(pattern)
        if policy not in ("skip", "allowed", "not_allowed"):
            raise ValueError(f"unknown policy {policy!r}")
    to_regex(output)
    return {"operation": name, "step": {"kind": kind, "start": start, "end": end}, "inputs": {k: {"pattern": p, "missing": m} for k, (p, m) in inputs.items()}, "output": output}


def batch(operations: DataFrame, size: int, index: int) -> DataFrame:
    """The operations of one batch: size * index and the following."""
    return operations.where(F.col("operation").between(size * index, size * index + size - 1))
