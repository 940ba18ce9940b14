"""Near-duplicate vectors by cross-polytope hashing.

A vector, padded to a power of two and scaled to length 1, is rotated by three
rounds of random signs and a fast Hadamard transform; the largest coordinate in
absolute value, with its sign, is one hash symbol. K symbols make a bucket code,
T tables of codes make the index. Each vector enters the bucket of its own code
and, as a probe, those of the next likeliest codes. Inside a bucket, pairs of
which one is there by its own code are compared, blockwise, twice: first by
vectors rounded to one byte a component, with a bound on the rounding, which
leaves the vectors that may link at all; then those alone meet again and are
compared by cosine in double precision, so every reported link is verified.

K follows from the number of vectors in the largest label (buckets stay near a
constant size), as long as the collision rate at the threshold, measured on random
pairs of exactly that cosine, is at least ``RATE``; T follows from that rate, so
that the expected miss rate at the threshold is below ``miss``. ``plan`` returns
both with that expectation.

Links are counted, not listed: a pair counts only in the first table and bucket
where its two code lists meet, which both rows can tell, so counts add up and
per bucket only a spanning forest leaves the task. Identical vectors of a label
are compared once and counted by their number. A bucket of more than ``BLOCK`` rows is
split into pairs of blocks that grow with the root of its size, so a bucket of n
rows is copied sqrt(n)/``GROWTH`` times, and any task holds two blocks.

Edge cases: null labels, null vectors, zero vectors, and vectors with null or
non-finite components link with nothing. Vectors of different lengths are never
compared. Rows that share a vec_id are separate vectors with one id: each has its
own links, with each other too. Rows with a null vec_id link with nothing and have
a null component. Extra columns are ignored. Empty input gives empty output.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terracell.llm.shared import Forest, components, cut, drop_cuts, gathered, run_starts, scratch, sorted_runs, tidy

COSINE = 0.93
PROBES = 2
BUCKET = 64  # vectors that a bucket should hold on average
BLOCK = 1024  # rows of a bucket compared at once; larger buckets are split
GROWTH = 32  # a bucket of n rows is split into blocks of GROWTH * sqrt(n) rows,
MOST = 1 << 16  # but of no more than these
RATE = 0.02  # least collision rate of a table at the threshold
MISS = 1e-4
SEED = 20240229
_TRIALS = 4000


def hadamard(x: np.ndarray) -> np.ndarray:
    """Rows times the normalised Hadamard matrix, in d log d additions."""
    n, d = x.shape
    h = 1
    while h < d:
        x = x.reshape(n, d // (2 * h), 2, h)
        x = np.concatenate((x[:, :, :1] + x[:, :, 1:], x[:, :, :1] - x[:, :, 1:]), axis=2).reshape(n, d)
        h *= 2
    return x / math.sqrt(d)


def signs(dim: int, tables: int, symbols: int, seed: int = SEED) -> np.ndarray:
    """(tables, symbols, 3, dim) random signs."""
    return np.random.default_rng([seed, dim]).choice((-1.0, 1.0), size=(tables, symbols, 3, dim))


def padded(x: np.ndarray) -> np.ndarray:
    d = 1 << max(1, (x.shape[1] - 1).bit_length())
    return np.pad(x, ((0, 0), (0, d - x.shape[1]))) if d != x.shape[1] else x


def codes(x: np.ndarray, s: np.ndarray, probes: int) -> np.ndarray:
    """(rows, tables, 1 + probes) int64 bucket codes of unit rows; the first is the row's own.

    A probe swaps one symbol for that rotation's runner-up; the smallest gaps
    between the winner's and the runner-up's magnitude go first.
    """
    n, (tables, k, _, d) = len(x), s.shape
    probes = min(probes, k)
    out = np.empty((n, tables, 1 + probes), dtype=np.int64)
    rows = np.arange(n)
    radix = np.int64(2 * d)
    for t in range(tables):
        top, second, gap = (np.empty((n, k), dtype) for dtype in (np.int64, np.int64, np.float64))
        for j in range(k):
            y = x
            for r in range(3):
                y = hadamard(y * s[t, j, r])
            a = np.abs(y)
            i = a.argmax(axis=1)
            top[:, j] = 2 * i + (y[rows, i] < 0)
            best = a[rows, i].copy()
            a[rows, i] = -1
            i = a.argmax(axis=1)
            second[:, j] = 2 * i + (y[rows, i] < 0)
            gap[:, j] = best - a[rows, i]
        weight = radix ** np.arange(k, dtype=np.int64)
        own = (top * weight).sum(axis=1)
        out[:, t, 0] = own
        order = np.argsort(gap, axis=1)
        for p in range(probes):
            j = order[:, p]
            out[:, t, 1 + p] = own + (second[rows, j] - top[rows, j]) * weight[j]
    return out


def _meet(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Per row of two (n, 1 + probes) code lists: whether one's own code is in the other's list."""
    return (a == b[:, :1]).any(axis=1) | (b == a[:, :1]).any(axis=1)


def collision_rate(dim: int, symbols: int, cosine: float = COSINE, probes: int = PROBES) -> float:
    """How often two vectors of this cosine meet in one table, measured on random pairs."""
    d = 1 << max(1, (dim - 1).bit_length())
    g = np.random.default_rng([SEED, d, symbols])
    x = g.normal(size=(_TRIALS, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = g.normal(size=(_TRIALS, dim))
    z -= (z * x).sum(axis=1, keepdims=True) * x
    norm = np.linalg.norm(z, axis=1, keepdims=True)
    z = np.divide(z, norm, out=np.zeros_like(z), where=norm > 1e-12)
    y = cosine * x + math.sqrt(1 - cosine * cosine) * z
    s = signs(d, 1, symbols, SEED + 1)
    return float(_meet(codes(padded(x), s, probes)[:, 0], codes(padded(y), s, probes)[:, 0]).mean())


def plan(dim: int, largest: int, cosine: float = COSINE, probes: int = PROBES, miss: float = MISS, rate: float = RATE) -> tuple[int, int, float]:
    """(tables, symbols, expected misses at the threshold) for labels of up to ``largest`` vectors.

    Where the rate asks for it, buckets are made larger (fewer symbols) rather than
    links lost; with one symbol there are as many tables as the rate asks for.
    """
    d = 1 << max(1, (dim - 1).bit_length())
    k = max(1, min(62 // max(1, (2 * d - 1).bit_length()), math.ceil(math.log(max(largest, 1) / BUCKET + 1) / math.log(2 * d))))
    while (met := collision_rate(dim, k, cosine, probes)) < rate and k > 1:
        k -= 1
    met = min(max(met, 1 / _TRIALS), 0.999)
    tables = max(2, math.ceil(math.log(miss) / math.log(1 - met)))
    return tables, k, (1 - met) ** tables


def _clean(df: DataFrame, vec_id: str, vector: str, label: str) -> DataFrame:
    """(vec, key) of every row; key is (label, v, dim), or null if the row links with nothing."""
    wide = F.col(vector).cast("array<double>").alias("w")
    df = df.select(F.col(vec_id).cast("bigint").alias("vec"), F.col(label).alias("label"), F.col(vector).alias("v"), wide)
    bad = F.exists("w", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.exists("w", lambda x: x != 0)
    good = F.col("vec").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull()
    return df.select("vec", F.when(good & F.coalesce(~bad & some, F.lit(False)), F.struct("label", "v", F.size("v").alias("dim"))).alias("key"))


_BUCKET = ["label_key", "tbl", "code"]
_LIGHT = "label_key bigint, tbl int, code bigint, own boolean, vec bigint, q binary, scale float, err float"
_FULL = "label_key bigint, tbl int, code bigint, own boolean, vec bigint, n bigint, unit binary, codes binary"


def rounded(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(int8 rows, scale, length of the error): row / scale is the vector up to the error."""
    scale = 127 / np.abs(x).max(axis=1)
    q = np.rint(x * scale[:, None])
    err = np.linalg.norm(x - q / scale[:, None], axis=1)
    return q.astype(np.int8), scale.astype(np.float32), (err * 1.0001 + 1e-6).astype(np.float32)


def _indexed(distinct: DataFrame, dim: int, tables: int, symbols: int, probes: int, full: bool) -> DataFrame:
    """One row per vector, table and code, with the rounded vector or with all that a comparison needs."""

    def run(batches):
        s = signs(1 << max(1, (dim - 1).bit_length()), tables, symbols)
        for batch in batches:
            for lo in range(0, batch.num_rows, 2048):
                part = batch.slice(lo, 2048)
                if not part.num_rows:
                    continue
                flat = part.column(3).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(part.num_rows, dim)
                x = flat / np.abs(flat).max(axis=1, keepdims=True)
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                c = codes(padded(x), s, probes)
                n, t, p = c.shape
                at = pa.array(np.repeat(np.arange(n), t * p))
                own = np.zeros(c.shape, dtype=bool)
                own[:, :, 0] = True
                spread = lambda values, kind: pa.array(values, kind).take(at)
                columns = [part.column(0).take(at), pa.array(np.tile(np.repeat(np.arange(t, dtype=np.int32), p), n)), pa.array(c.reshape(-1)), pa.array(own.reshape(-1)), part.column(1).take(at)]
                if full:
                    columns += [part.column(2).take(at), spread([r.tobytes() for r in x], pa.binary()), spread([r.tobytes() for r in c], pa.binary())]
                else:
                    q, scale, err = rounded(x)
                    columns += [spread([r.tobytes() for r in q], pa.binary()), spread(scale, pa.float32()), spread(err, pa.float32())]
                yield pa.RecordBatch.from_arrays(columns, names=[f.split(" ")[0] for f in (_FULL if full else _LIGHT).split(", ")])

    return distinct.select("label_key", "vec", "n", "v").mapInArrow(tidy(run), _FULL if full else _LIGHT)


def _block_size(rows):
    """Rows of a block for buckets of so many rows (a column)."""
    return F.least(F.lit(MOST), F.greatest(F.lit(BLOCK), F.ceil(GROWTH * F.sqrt(rows))))


def _dealt(index: DataFrame) -> DataFrame:
    """Index rows by bucket, sorted; a large bucket becomes pairs of blocks (a, b), a row's side being 0 in a and 1 in b."""
    rest = [c for c in index.columns if c not in _BUCKET]
    n = F.col("count")
    big = index.groupBy(*_BUCKET).count().where(n > BLOCK).select(*_BUCKET, F.ceil(n / _block_size(n)).cast("int").alias("blocks"))
    big = cut(big.where("blocks > 1"), "large")
    if big.isEmpty():  # the join would only move the whole index once more
        plain = index.withColumns({"a": F.lit(0), "b": F.lit(0), "side": F.lit(0)})
        return gathered(plain, [*_BUCKET, "a", "b"], ["vec"])
    split = index.join(big, _BUCKET, "left").withColumn("many", F.coalesce("blocks", F.lit(1)))
    split = split.withColumn("block", F.pmod(F.xxhash64("vec"), F.col("many")).cast("int"))
    mine = F.col("block")
    pair = F.transform(F.sequence(F.lit(0), F.col("many") - 1), lambda o: F.struct(F.least(mine, o).alias("a"), F.greatest(mine, o).alias("b"), F.when(mine <= o, 0).otherwise(1).alias("side")))
    split = split.select(*_BUCKET, *rest, F.explode(pair).alias("p")).select(*_BUCKET, *rest, "p.*")
    return gathered(split, [*_BUCKET, "a", "b"], ["vec"])


def _matrix(column: pa.ChunkedArray, dtype, shape) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=dtype).reshape(shape)


def _tiles(same: bool, side: np.ndarray):
    """(left, right, whether they are the same rows): every pair of the two sides once, ``BLOCK`` by ``BLOCK``."""
    left = np.flatnonzero(side == 0)
    right = left if same else np.flatnonzero(side == 1)
    for i in range(0, len(left), BLOCK):
        for j in range(i if same else 0, len(right), BLOCK):
            yield left[i : i + BLOCK], right[j : j + BLOCK], same and i == j


def _shortlist(cosine: float, dim: int):
    """Sorted bucket blocks -> vec: the vectors whose rounded form may link with another's."""
    keys = [*_BUCKET, "a", "b"]

    def run(batches):
        for t in sorted_runs(batches, keys):
            begin = run_starts(t, keys)
            end = np.append(begin[1:], t.num_rows)
            vec, side = t.column("vec").to_numpy(), t.column("side").to_numpy()
            own = t.column("own").combine_chunks().to_numpy(zero_copy_only=False)
            scale, err = t.column("scale").to_numpy(), t.column("err").to_numpy()
            a_block, b_block = t.column("a").to_numpy(), t.column("b").to_numpy()
            alive = np.zeros(t.num_rows, dtype=bool)
            for lo, hi in zip(begin.tolist(), end.tolist(), strict=True):
                if hi - lo < 2:
                    continue
                x = _matrix(t.column("q").slice(lo, hi - lo), np.int8, (hi - lo, dim))
                e, me, by = err[lo:hi], own[lo:hi], scale[lo:hi, None]
                for left, right, same in _tiles(a_block[lo] == b_block[lo], side[lo:hi]):
                    room = e[left][:, None] + e[right][None, :] + 3 * e[left][:, None] * e[right][None, :] + np.float32(1e-4)
                    close = ((x[left] / by[left]) @ (x[right] / by[right]).T >= cosine - room) & (me[left][:, None] | me[right][None, :])
                    if same:
                        np.fill_diagonal(close, False)
                    alive[lo + left] |= close.any(axis=1)
                    alive[lo + right] |= close.any(axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(vec[alive]))], names=["vec"])

    return run


def _compare(cosine: float, tables: int, width: int, dim: int):
    """Sorted bucket blocks -> (vec, links, other): weighted link counts and forest edges."""
    keys = [*_BUCKET, "a", "b"]

    def run(batches):
        for t in sorted_runs(batches, keys):
            begin = run_starts(t, keys)
            end = np.append(begin[1:], t.num_rows)
            vec = t.column("vec").to_numpy()
            n, own, side = t.column("n").to_numpy(), t.column("own").combine_chunks().to_numpy(zero_copy_only=False), t.column("side").to_numpy()
            tbl, code = t.column("tbl").to_numpy(), t.column("code").to_numpy()
            a_block, b_block = t.column("a").to_numpy(), t.column("b").to_numpy()
            x = [[], [], []]
            for lo, hi in zip(begin.tolist(), end.tolist(), strict=True):
                if hi - lo < 2:
                    continue
                unit = _matrix(t.column("unit").slice(lo, hi - lo), np.float64, (hi - lo, dim))
                lists = _matrix(t.column("codes").slice(lo, hi - lo), np.int64, (hi - lo, tables, width))
                me, m, table, here = own[lo:hi], n[lo:hi], int(tbl[lo]), code[lo]
                count, forest = np.zeros(hi - lo, dtype=np.int64), Forest(hi - lo)
                for left, right, same in _tiles(a_block[lo] == b_block[lo], side[lo:hi]):
                    close = unit[left] @ unit[right].T >= cosine
                    close &= me[left][:, None] | me[right][None, :]
                    i, j = np.nonzero(np.triu(close, 1) if same else close)
                    i, j = left[i], right[j]
                    apart = vec[lo + i] != vec[lo + j]
                    i, j = i[apart], j[apart]
                    for at in range(0, len(i), 100_000):
                        p, q = i[at : at + 100_000], j[at : at + 100_000]
                        for before in range(table):
                            unmet = ~_meet(lists[p, before], lists[q, before])
                            p, q = p[unmet], q[unmet]
                        cp, cq = lists[p, table], lists[q, table]
                        in_p = (cq == cp[:, :1]).any(axis=1)  # they meet in p's own bucket
                        in_q = (cp == cq[:, :1]).any(axis=1)
                        first = np.where(in_p & in_q, np.minimum(cp[:, 0], cq[:, 0]), np.where(in_p, cp[:, 0], cq[:, 0]))
                        mine = first == here
                        p, q = p[mine], q[mine]
                        np.add.at(count, p, m[q])
                        np.add.at(count, q, m[p])
                        for some in range(0, len(p), 8192):
                            u, v = p[some : some + 8192], q[some : some + 8192]
                            label = forest.labels()
                            new = label[u] != label[v]
                            for a, b in zip(u[new].tolist(), v[new].tolist(), strict=True):
                                forest.join(a, b)
                # rows are sorted by vec, so a root has the smallest vec of its tree
                for r in np.flatnonzero(count).tolist():
                    x[0].append(int(vec[lo + r]))
                    x[1].append(int(count[r]))
                    x[2].append(int(vec[lo + forest.root(r)]))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in x], names=["vec", "links", "other"])

    return run


def near_duplicates(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", cosine: float = COSINE, probes: int = PROBES) -> DataFrame:
    """One row per vector: its id, n_links, component_id and kept."""
    spark = df.sparkSession
    rows = _clean(df, vec_id, vector, label)
    distinct = rows.where("key is not null").groupBy("key").agg(F.min("vec").alias("low"), F.count(F.lit(1)).alias("n"))
    # 64 hashed bits stand for the label: a million labels share one with a chance of 3e-8; vec numbers the distinct vectors
    distinct = distinct.select("key.*", "low", "n", F.xxhash64("key.label", "key.dim").alias("label_key"), F.monotonically_increasing_id().alias("vec"))
    with scratch(spark) as keep:
        distinct = keep(cut(distinct, "vectors"))
        found = _links(distinct, cosine, probes)
        links = keep(cut(found.groupBy("vec").agg(F.sum("links").alias("links")), "links"))
        comp = keep(components(found.select("vec", "other")))
    rep = (
        distinct.join(links, "vec", "left").join(comp.withColumnRenamed("node", "vec"), "vec", "left")
        .select("label", "dim", "v", "n", "low", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "vec").alias("component"))
    )
    least = rep.groupBy("component").agg(F.min("low").alias("least"))
    rep = rep.join(least, "component").select(F.struct("label", "v", "dim").alias("of"), (F.col("n") - 1 + F.col("links")).alias("links"), "least")
    out = rows.join(rep, F.col("key") == F.col("of"), "left").select("vec", F.coalesce("links", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("least", "vec").alias("component_id"))
    kept = F.coalesce(F.col("component_id") == F.col("vec"), F.lit(True))
    return out.select(F.col("vec").alias(vec_id), "n_links", "component_id", kept.alias("kept"))


def _links(distinct: DataFrame, cosine: float, probes: int) -> DataFrame:
    """(vec, links, other): weighted link counts and forest edges, in parts."""
    counts = distinct.groupBy("dim", "label_key").count().groupBy("dim").agg(F.max("count").alias("largest")).collect()
    found = distinct.select("vec", F.lit(0).cast("bigint").alias("links"), F.col("vec").alias("other")).where("false")
    for dim, largest in sorted((r["dim"], r["largest"]) for r in counts):  # one pass per vector length
        tables, symbols, _ = plan(dim, largest, cosine, probes)
        width = 1 + min(probes, symbols)
        some = distinct.where(F.col("dim") == dim)
        light = cut(_indexed(some, dim, tables, symbols, probes, full=False), "buckets")
        alive = cut(_dealt(light).mapInArrow(tidy(_shortlist(cosine, dim)), "vec bigint").distinct(), "alive")
        drop_cuts(distinct.sparkSession, light)
        index = cut(_indexed(some.join(alive, "vec", "left_semi").select(*some.columns), dim, tables, symbols, probes, full=True), "buckets")
        found = found.union(_dealt(index).mapInArrow(tidy(_compare(cosine, tables, width, dim)), "vec bigint, links bigint, other bigint"))
    return cut(found, "links")
