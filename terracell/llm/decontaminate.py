"""Benchmark decontamination by winnowed fingerprints.

Training and benchmark texts are fingerprinted alike: of every ``w`` consecutive
k-gram hashes the smallest is kept, so two texts that share ``k + w - 1``
consecutive words share a kept k-gram. Fingerprints are joined, and every hit is
extended word by word inside the context that travels with it; only windows whose
words are equal count. Windows have 8 words (k=4, w=5). A benchmark item of n < 8
words is one window and gets its own fingerprints (k=n, w=1).

A bitmap of fixed size over the benchmark's fingerprints drops most training
fingerprints before the join; it has false positives only, the join is exact.

Edge cases: a null or empty text has no words and no hits; null or empty items
have no windows. A row is known by its doc_id and a hash of its text: rows that
share a doc_id, or have none, are documents of their own. Repeated rows each get
their row. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terracell.llm import bytewords as B
from terracell.llm.shared import bitmap_of, cut, in_bitmap, tidy

WINDOW = 8
GRAM = 4
BITS = 24  # the bitmap has 2**BITS bits: 2 MB
_HIT = pa.struct([("fp", pa.int64()), ("size", pa.int32()), ("pos", pa.int32()), ("left", pa.int32()), ("ctx", pa.string())])
_DOC = pa.schema([("n_words", pa.int64()), ("hits", pa.list_(_HIT))])
_DOC_DDL = "n_words bigint, hits array<struct<fp:bigint,size:int,pos:int,left:int,ctx:string>>"


def scheme(size: int, window: int = WINDOW, gram: int = GRAM) -> tuple[int, int]:
    """(k, w) with k + w - 1 = size, for windows of ``size`` words."""
    k = gram if size >= window else size
    return k, size - k + 1


def winnow(words: np.ndarray, bounds: np.ndarray, k: int, w: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of the kept k-grams; none spans two rows.

    Of each run of w k-grams every smallest one is kept, ties included, so the
    choice depends on the run alone.
    """
    g = B.gram_hashes(words, k)
    n = len(g)
    if not n:
        return np.zeros(0, np.int64), g
    inside = np.ones(n, dtype=bool)
    for j in range(1, k):
        cuts = bounds[1:-1] - j
        inside[cuts[(cuts >= 0) & (cuts < n)]] = False
    if w == 1:
        keep = inside
    else:
        keep = np.zeros(n, dtype=bool)
        m = n - w + 1
        if m > 0:
            low = g[:m].copy()
            for j in range(1, w):
                np.minimum(low, g[j : j + m], out=low)
            for j in range(w):
                keep[j : j + m] |= g[j : j + m] == low
        keep &= inside
    at = np.flatnonzero(keep)
    return at, g[at]


def _prints(texts: pa.Array, sizes: list[int], window: int, gram: int, bitmap: bytes | None, whole: bool) -> Iterator[tuple[int, list[dict]]]:
    """Per row: number of words, and its fingerprints (that the bitmap knows) with context.

    ``whole``: a row is fingerprinted only for the window size its length asks for.
    """
    data, offsets = B.utf8(texts)
    for i, j in B.chunks(offsets):
        lo = offsets[i]
        part = data[lo : offsets[j]]
        words, starts, ends, bounds = B.hash_words(part, offsets[i : j + 1] - lo, B.ALNUM)
        counts = np.diff(bounds)
        found: list[list[dict]] = [[] for _ in range(j - i)]
        for size in sizes:
            k, w = scheme(size, window, gram)
            at, fp = winnow(words, bounds, k, w)
            fp = B.mix(fp ^ np.uint64(size))
            if bitmap is not None and len(fp):
                hit = in_bitmap(bitmap, fp, BITS)
                at, fp = at[hit], fp[hit]
            rows = np.searchsorted(bounds, at, side="right") - 1
            for p, f, r in zip(at.tolist(), fp.view(np.int64).tolist(), rows.tolist(), strict=True):
                if counts[r] < size or whole and min(counts[r], window) != size:
                    continue
                a = max(bounds[r], p - (size - k))
                b = min(bounds[r + 1], p + size)
                found[r].append({"fp": f, "size": size, "pos": int(p - bounds[r]), "left": int(p - a), "ctx": " ".join(B.word_text(part, starts[a:b], ends[a:b]))})
        yield from zip(counts.tolist(), found, strict=True)


def _fingerprinted(df: DataFrame, key: str, text: str, sizes: list[int], window: int, gram: int, bitmap=None, whole: bool = False) -> DataFrame:
    """(key, text_hash, n_words, hits) per row."""

    def run(batches):
        bits = bitmap.value if bitmap is not None else None
        for batch in batches:
            got = list(_prints(batch.column(2), sizes, window, gram, bits, whole))
            columns = [batch.column(0), batch.column(1), pa.array([n for n, _ in got], pa.int64()), pa.array([h for _, h in got], pa.list_(_HIT))]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "text_hash", "n_words", "hits"])

    rows = df.select(F.col(key).cast("bigint").alias("key"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))
    return rows.mapInArrow(tidy(run), f"key bigint, text_hash bigint, {_DOC_DDL}")


def _extend(batches):
    """Join hits -> windows: the words around both k-grams, aligned, must be equal."""
    for batch in batches:
        out: dict[str, list] = {"key": [], "text_hash": [], "start": [], "size": [], "items": []}
        for r in batch.to_pylist():
            a, b, size, k = r["ctx"].split(" "), r["b_ctx"].split(" "), r["size"], r["k"]
            for j in range(size - k + 1):
                x, y = r["left"] - j, r["b_left"] - j
                if x >= 0 and y >= 0 and x + size <= len(a) and y + size <= len(b) and a[x : x + size] == b[y : y + size]:
                    out["key"].append(r["key"])
                    out["text_hash"].append(r["text_hash"])
                    out["start"].append(r["pos"] - j)
                    out["size"].append(size)
                    out["items"].append(r["items"])
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out.values(), kinds, strict=True)], names=list(out))


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    doc_id: str = "doc_id",
    doc_text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    gram: int = GRAM,
) -> tuple[DataFrame, DataFrame]:
    """(documents, windows).

    documents: (doc_id, text_hash, n_words) for every row; windows: (doc_id,
    text_hash, start, size, items), one row per fingerprint and window that occurs in
    a benchmark item.
    """
    spark = docs.sparkSession
    every = list(range(1, window + 1))
    bench = (
        _fingerprinted(benchmark, item_id, item_text, every, window, gram, whole=True)
        .select("key", F.explode("hits").alias("h"))
        .groupBy(F.col("h.fp").alias("fp"), F.col("h.size").alias("b_size"), F.col("h.left").alias("b_left"), F.col("h.ctx").alias("b_ctx"))
        .agg(F.array_sort(F.collect_set("key")).alias("items"))
    )
    bench = cut(bench, "benchmark")
    sizes = sorted(r[0] for r in bench.select("b_size").distinct().collect())  # at most `window` rows
    bits = spark.sparkContext.broadcast(bitmap_of(bench, BITS))
    base = cut(_fingerprinted(docs, doc_id, doc_text, sizes, window, gram, bitmap=bits), "fingerprints")
    k = F.when(F.col("size") >= window, F.lit(gram)).otherwise(F.col("size"))
    hits = base.select("key", "text_hash", F.explode("hits").alias("h")).select("key", "text_hash", "h.*").withColumn("k", k)
    joined = hits.join(bench, (hits.fp == bench.fp) & (hits["size"] == bench.b_size)).select("key", "text_hash", "size", "pos", "left", "ctx", "k", "b_left", "b_ctx", "items")
    windows = joined.mapInArrow(tidy(_extend), "key bigint, text_hash bigint, start int, size int, items array<bigint>")
    return base.select(F.col("key").alias(doc_id), "text_hash", "n_words"), windows.withColumnRenamed("key", doc_id)


def _digest(items: Column) -> Column:
    return F.sha2(F.array_join(F.array_sort(F.transform(items, lambda x: x.cast("string"))), ","), 256)


def report(docs: DataFrame, benchmark: DataFrame, at_least: int = 2) -> DataFrame:
    """Per document: words, words inside hit windows, items hit, and the verdict."""
    base, windows = contamination(docs, benchmark)
    per = windows.groupBy(F.col("doc_id").alias("hit_id"), F.col("text_hash").alias("hit_hash")).agg(
        F.size(F.array_distinct(F.flatten(F.collect_set(F.expr("sequence(start, start + size - 1)"))))).cast("bigint").alias("n_hit"),
        F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"),
    )
    none = F.array().cast("array<bigint>")
    out = base.join(per, base.doc_id.eqNullSafe(per.hit_id) & (base.text_hash == per.hit_hash), "left").withColumn("items", F.coalesce("items", none))
    return out.select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0).cast("bigint")).alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        _digest(F.col("items")).alias("items_sha256"),
        (F.size("items") >= at_least).alias("contaminated"),
    )
