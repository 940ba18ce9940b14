"""Exact Jaccard self-join on word n-gram sets, by set relations.

Links are pairs with ``den * |A n B| >= num * |A u B|``. The join follows the idea
of using relations between sets at two levels.

Index level. Every set is ordered by one global order: hash order, with frequent
tokens last, rarest first. A linked pair shares a token in both prefixes of
``s - ceil(num * s / den) + 1`` tokens, so the inverted lists hold prefixes only,
as (size, position) entries in that order. A list is a sequence of blocks of
equal size: a block is skipped whole if its size, or the positions with it, rule
the overlap out, and left as soon as positions grow too large. Two prefixes of a
linked pair also share a least number of tokens, and histograms of whole sets
differ by no more than the sets may, which prunes pairs further.

Long lists. Lists of more than some ``SPLIT`` entries, found by counting the tokens
of one in ``SAMPLED`` sets, are split into blocks by a hash of set and token. Inside
each block the pairs that may link are joined. As every token deals its sets anew,
what belongs together mostly comes together across tokens. Then, of each split
list, the entries outside its largest component (all of them, in chunks) meet every
block, so no pair of entries is left out, and no task holds a whole list.

Answer level. What may link falls into candidate groups, mostly near copies of one
another. The sets of a group meet in one place, where the answers (overlaps with
all members) of one set are derived from those of a similar set already computed,
by walking only the lists of the tokens that differ. Members that have joined the
largest component need no answers of their own, unless another becomes the largest. A group of more than
``HOME_TOKENS`` tokens meets in blocks; then what is outside its main component
meets every block.

Frequent tokens: document frequencies of the tokens that can enter a prefix are
counted over all documents; the ``HEAVY`` commonest above ``COMMON`` are put
last. Order affects speed only; any order gives the same links.

Equal sets are one set throughout: a set is known by 64 hashed bits of its
tokens, themselves 64 hashed bits (n distinct sets collide with a chance of
n*n / 2**65). Within a task a set's prefix is emitted once, so a group of exact
copies puts one entry a task into a list.

Edge cases: null and empty texts, and texts without words, have the empty set,
n_shingles 0 and link with nothing. A text of fewer words than ``n`` has one
shingle, the whole sequence. Rows that share a doc_id are separate documents with
one id (``grouped`` tells them apart by a hash of the text). Rows with a null
doc_id take part in no links and keep a null component. Extra columns are ignored;
empty input gives empty output.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terracell.llm import bytewords as B
from terracell.llm.shared import Forest, bitmap_of, components, cut, first_of_equals, gathered, in_bitmap, run_starts, scratch, sorted_runs, tidy

N = 3
NUM, DEN = 90, 100
COMMON = 64  # prefix tokens in more sets than this may be put last
HEAVY = 1 << 19  # at most so many are: 6 MB to each task
SHORT = 16  # lists up to this length are compared pair by pair
SPLIT = 8192  # entries of a block of a long list: some 3 MB
SAMPLED = 16  # the lengths of lists are estimated from one set in so many
HOME_TOKENS = 1 << 21  # tokens of the sets that meet in one place: 16 MB, and some 150 MB of work
DELEGATES = 16  # sets of each block of a larger group that meet those of the others
MAP_BITS = 25  # the map of the documents that are read again: 4 MB
ANSWERS = 32  # computed overlap vectors kept in a home
CELLS = 32
SLACK = 1.6  # tokens counted, relative to a prefix


def least_overlap(a, b, num: int = NUM, den: int = DEN):
    """Smallest intersection of a linked pair of sizes a and b (arrays or ints)."""
    return -((-num * (a + b)) // (num + den))


def prefix_length(s, num: int = NUM, den: int = DEN):
    return s + (-num * s) // den + 1


def least_shared(a, b, num: int = NUM, den: int = DEN):
    """Smallest number of tokens that the prefixes of a linked pair share."""
    o = least_overlap(a, b, num, den)
    return np.maximum(1, np.minimum(prefix_length(a, num, den) + o - a, prefix_length(b, num, den) + o - b))


def shingle_sets(texts: pa.Array, n: int = N, table: np.ndarray = B.NONSPACE) -> Iterator[np.ndarray]:
    """The sorted distinct n-word shingle hashes of each text."""
    data, offsets = B.utf8(texts)
    for i, j in B.chunks(offsets):
        lo = offsets[i]
        words, _, _, bounds = B.hash_words(data[lo : offsets[j]], offsets[i : j + 1] - lo, table)
        grams = B.gram_hashes(words, n)
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if b - a >= n:
                yield np.unique(grams[a : b - n + 1])
            elif b > a:
                yield B.gram_hashes(words[a:b], b - a)
            else:
                yield np.zeros(0, np.uint64)


def _digest(s: np.ndarray) -> int:
    return int(np.array([xxhash.xxh3_64_intdigest(s.tobytes())], dtype=np.uint64).view(np.int64)[0])


def _signed(s: np.ndarray) -> pa.Array:
    return pa.array(s.view(np.int64))


def _lists_of(parts: list[np.ndarray | None]) -> pa.Array:
    """list<int64> from arrays; None becomes an empty list."""
    parts = [np.zeros(0, np.uint64) if p is None else p for p in parts]
    ends = np.cumsum([0, *(len(p) for p in parts)]).astype(np.int32)
    flat = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(ends), _signed(flat))


def frequent_tokens(texts: DataFrame, n: int, num: int, den: int, common: int = COMMON, heavy: int = HEAVY) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, rank) of the commonest tokens that can enter a prefix, sorted by token.

    ``texts`` has one column, text. At most ``heavy`` rows reach the driver.
    """

    def low(batches):
        seen: set[int] = set()
        for batch in batches:
            parts = []
            for s in shingle_sets(batch.column(0), n):
                if len(s) and (d := _digest(s)) not in seen:
                    seen.add(d)
                    parts.append(s[: int(SLACK * prefix_length(len(s), num, den)) + 2])
            yield pa.RecordBatch.from_arrays([_lists_of(parts)], names=["tokens"])

    counted = texts.mapInArrow(tidy(low), "tokens array<bigint>").select(F.explode("tokens").alias("token")).groupBy("token").count()
    top = counted.where(F.col("count") > common).orderBy(F.desc("count"), "token").limit(heavy).toPandas()
    tokens = top["token"].to_numpy(dtype=np.int64).view(np.uint64)
    rank = np.arange(len(tokens), 0, -1).astype(np.int32)  # the commonest last
    order = np.argsort(tokens)
    return tokens[order], rank[order]


def histogram(s: np.ndarray) -> np.ndarray:
    """How many tokens fall into each of ``CELLS`` hash ranges.

    Two sets differ in at least as many tokens as their histograms, so those
    refute most pairs that merely share a passage. Saturated counts only weaken that.
    """
    return np.minimum(np.bincount((s >> np.uint64(7)).astype(np.int64) % CELLS, minlength=CELLS), 32767).astype(np.int16)


def prefix(s: np.ndarray, tokens: np.ndarray, rank: np.ndarray, num: int, den: int) -> np.ndarray:
    """The first tokens of a set in the global order."""
    p = prefix_length(len(s), num, den)
    if not len(tokens):
        return s[:p]
    at = np.minimum(np.searchsorted(tokens, s), len(tokens) - 1)
    hot = tokens[at] == s
    rare = s[~hot][:p]
    if len(rare) == p:
        return rare
    late = s[hot][np.argsort(rank[at[hot]], kind="stable")]
    return np.concatenate((rare, late[: p - len(rare)]))


_LISTS = "kind int, token bigint, a bigint, b bigint, size_a int, size_b int, pos int, block int, blocks int"


def _split_lists(short: int, num: int, den: int):
    """Sorted entries -> kind 0: pairs of short lists (pos: whether this may be their first shared token); 1: entries of long ones; 2: (a, pos) in how many short lists a is."""

    def run(batches):
        for t in sorted_runs(first_of_equals(batches, ["token", "block", "digest"]), ["token", "block"]):
            token, digest, size, pos, block, blocks = (t.column(c).to_numpy() for c in ("token", "digest", "size", "pos", "block", "blocks"))
            size, pos = size.astype(np.int64), pos.astype(np.int64)
            new = np.ones(len(token), dtype=bool)
            new[1:] = (token[1:] != token[:-1]) | (block[1:] != block[:-1])
            run_of = np.cumsum(new) - 1
            length = np.bincount(run_of)[run_of]
            many = (length > short) | (blocks > 1)
            few = (length > 1) & ~many
            pairs = []
            for d in range(1, short):
                i = np.flatnonzero(few[: len(few) - d] & (run_of[: len(few) - d] == run_of[d:])) if len(few) > d else np.zeros(0, np.int64)
                if not len(i):
                    break
                j = i + d
                o = least_overlap(size[i], size[j], num, den)
                ok = size[i] >= o
                # the positions bear on a pair's first shared token only: later ones count without them
                first = (size[i] - pos[i] >= o) & (size[j] - pos[j] >= o)
                pairs.append((i[ok], j[ok], first[ok].astype(np.int64)))
            i, j, early = (np.concatenate(x) for x in zip(*pairs, strict=True)) if pairs else (np.zeros(0, np.int64),) * 3
            swap = digest[i] > digest[j]
            i, j = np.where(swap, j, i), np.where(swap, i, j)
            inside, times = np.unique(digest[few], return_counts=True)
            k = [len(i), int(many.sum()), len(inside)]
            none = [np.zeros(x, np.int64) for x in k]
            columns = [
                np.repeat([0, 1, 2], k).astype(np.int32),
                np.concatenate((none[0], token[many], none[2])),
                np.concatenate((digest[i], digest[many], inside)),
                np.concatenate((digest[j], none[1], none[2])),
                np.concatenate((size[i], size[many], none[2])).astype(np.int32),
                np.concatenate((size[j], none[1], none[2])).astype(np.int32),
                np.concatenate((early, pos[many], times)).astype(np.int32),
                np.concatenate((none[0], block[many], none[2])).astype(np.int32),
                np.concatenate((none[0], blocks[many], none[2])).astype(np.int32),
            ]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[f.split(" ")[0] for f in _LISTS.split(", ")])

    return run


def _candidates(num: int, den: int, keys: list[str]):
    """Sorted entries of long lists, or of blocks of them -> (a, b): spanning edges of the pairs that may link.

    A list is a sequence of runs of equal size, each sorted by position. Runs
    whose size rules a link out are skipped, and a run is left where positions
    grow too large for the overlap. Entries already joined (their column
    ``component`` is equal, or they have been joined here) are not looked at again,
    nor entries of one ``side``, unless that is 0.
    """

    def run(batches):
        for t in sorted_runs(batches, keys):
            begin = run_starts(t, keys)
            component, side = t.column("component").to_numpy(), t.column("side").to_numpy()
            digest, few, longs = t.column("digest").to_numpy(), t.column("few").to_numpy(), t.column("longs")
            size, pos = t.column("size").to_numpy().astype(np.int64), t.column("pos").to_numpy().astype(np.int64)
            cells = t.column("cells").combine_chunks().flatten().to_numpy().reshape(-1, CELLS)
            a, b = [], []
            for lo, hi in zip(begin.tolist(), [*begin[1:].tolist(), t.num_rows], strict=True):
                s, p, f, c = size[lo:hi], pos[lo:hi], few[lo:hi], cells[lo:hi].astype(np.int32)
                heads = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
                tails, block_size = np.append(heads[1:], hi - lo), s[heads]
                label = np.unique(component[lo:hi], return_inverse=True)[1]
                by_label = np.argsort(label, kind="stable")
                group = dict(enumerate(np.split(by_label, np.cumsum(np.bincount(label))[:-1])))
                joined: list[tuple[int, int]] = []
                if len(group) < 2:
                    continue
                at = side[lo:hi]
                sets = [set(x) for x in longs.slice(lo, hi - lo).to_pylist()]
                for x in range(hi - lo):
                    k = int(np.searchsorted(block_size, s[x]))  # later blocks only: a pair is seen from its smaller set
                    while k < len(heads) and den * s[x] >= num * block_size[k]:
                        o = int(least_overlap(s[x], block_size[k], num, den))
                        if s[x] - p[x] < o:
                            break  # no larger block can do either
                        first = max(int(heads[k]), x + 1)
                        last = int(heads[k]) + int(np.searchsorted(p[heads[k] : tails[k]], block_size[k] - o, side="right"))
                        y = np.arange(first, max(first, last))
                        y = y[(label[y] != label[x]) & ((at[y] != at[x]) | (at[x] == 0))]
                        y = y[np.abs(c[y] - c[x]).sum(axis=1) <= s[x] + block_size[k] - 2 * o]
                        least = int(least_shared(s[x], block_size[k], num, den))
                        for j in y.tolist():
                            if label[j] != label[x] and len(sets[x] & sets[j]) + min(f[x], f[j]) >= least:
                                one, two = int(label[x]), int(label[j])
                                mine, other = group.pop(one), group.pop(two)
                                if len(mine) < len(other):
                                    one, mine, other = two, other, mine
                                label[other] = one
                                group[one] = np.concatenate((mine, other))
                                joined.append((x, j))
                        k += 1
                a += [int(digest[lo + x]) for x, _ in joined]
                b += [int(digest[lo + j]) for _, j in joined]
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


class Home:
    """Sets that meet in one place; finds the components of their links."""

    def __init__(self, sets: list[np.ndarray], num: int, den: int):
        self.sizes = np.array([len(s) for s in sets], dtype=np.int64)
        flat = np.concatenate(sets)
        order = np.argsort(flat, kind="stable")
        flat = flat[order]
        new = np.append(True, flat[1:] != flat[:-1])
        del flat
        self.bounds = np.append(np.flatnonzero(new), len(new))
        number = np.cumsum(new, dtype=np.int32) - 1  # of the token, in sorted order
        ids = np.empty(len(order), dtype=np.int32)
        ids[order] = number
        del number, new
        owner = np.repeat(np.arange(len(sets), dtype=np.int32), self.sizes)
        self.members = owner[order]  # of each token, in order of the sets
        self.sets = np.split(ids, np.cumsum(self.sizes)[:-1])
        self.num, self.den = num, den
        self.answers: dict[int, np.ndarray] = {}

    def _count(self, tokens: np.ndarray) -> np.ndarray:
        """How many of the tokens each member holds."""
        if not len(tokens):
            return np.zeros(len(self.sizes), np.int64)
        where = np.concatenate([self.members[self.bounds[t] : self.bounds[t + 1]] for t in tokens.tolist()])
        return np.bincount(where, minlength=len(self.sizes))

    def overlaps(self, x: int) -> np.ndarray:
        """|x n y| for every member y: derived from the most similar answered set if that is less work."""
        mine = self.sets[x]
        near = max(self.answers, key=lambda q: (2 * self.answers[q][x] - self.sizes[q]), default=None)
        if near is not None and self.sizes[x] + self.sizes[near] - 2 * self.answers[near][x] < self.sizes[x]:
            other = self.sets[near]
            got = self.answers[near] + self._count(np.setdiff1d(mine, other, assume_unique=True)) - self._count(np.setdiff1d(other, mine, assume_unique=True))
        else:
            got = self._count(mine)
        if len(self.answers) >= ANSWERS:
            self.answers.pop(next(iter(self.answers)))
        self.answers[x] = got
        return got

    def forest(self) -> Forest:
        """Unions of all links, except between members of the largest component."""
        n = len(self.sizes)
        forest, group = Forest(n), np.ones(n, dtype=np.int64)
        by_token = np.diff(self.bounds)
        central = np.argsort([-int(by_token[s].sum()) / max(1, len(s)) for s in self.sets], kind="stable")
        main, queue, skipped = -1, deque(central.tolist()), []
        while queue:
            x = queue.popleft()
            if main >= 0 and forest.root(x) == forest.root(main):
                skipped.append(x)
                continue
            o = self.overlaps(x)
            for y in np.flatnonzero(o >= least_overlap(self.sizes[x], self.sizes, self.num, self.den)).tolist():
                a, b = forest.root(x), forest.root(y)
                if a != b:
                    forest.join(a, b)
                    group[min(a, b)] = group[a] + group[b]
            r = forest.root(x)
            if main < 0 or group[r] > group[forest.root(main)]:
                # what was skipped under another component is due again: it may link with what this one skips
                queue.extend(skipped)
                main, skipped = r, []
            if group[forest.root(main)] == n:
                break
        return forest


def _meet(num: int, den: int):
    """Sorted (place, block, digest, set) -> (a, b) forest edges of the links inside each block."""

    def run(batches):
        for t in sorted_runs(first_of_equals(batches, ["place", "block", "digest"]), ["place", "block"]):
            begin = run_starts(t, ["place", "block"])
            a, b = [], []
            for lo, hi in zip(begin.tolist(), [*begin[1:].tolist(), t.num_rows], strict=True):
                if hi - lo < 2:
                    continue
                digest = t.column("digest").slice(lo, hi - lo).to_pylist()
                home = Home([np.frombuffer(x.as_buffer(), dtype=np.uint64) for x in t.column("shingles").slice(lo, hi - lo)], num, den)
                forest = home.forest()
                for k, d in enumerate(digest):
                    if (r := forest.root(k)) != k:
                        a.append(d)
                        b.append(digest[r])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def _between(place: DataFrame, found: DataFrame, meet) -> DataFrame:
    """Links across the blocks of groups too large for one place.

    First a few sets of every block meet, so that the blocks' main components
    merge. Then the stragglers, the sets outside their group's main component,
    meet each block of their group, in chunks that keep a meeting within bounds.
    """
    rank = F.row_number().over(Window.partitionBy("place", "block").orderBy("digest"))
    few = place.withColumn("n", rank).where(F.col("n") <= DELEGATES).withColumn("block", F.floor(F.col("block") / DELEGATES).cast("int"))
    found = cut(found.union(meet(few)).union(meet(few.withColumn("block", F.col("n") - 1))), "found")
    label = components(found).withColumnRenamed("node", "digest")
    label = place.join(label, "digest", "left").withColumn("component", F.coalesce("component", "digest"))
    main = label.groupBy("place", "component").count().groupBy("place").agg(F.max_by("component", F.struct("count", "component")).alias("main"))
    rest = label.join(main, "place").where("component <> main").select("digest", "place", "blocks", "size")
    chunks = rest.groupBy("place").agg(F.ceil(F.sum("size") / HOME_TOKENS).cast("int").alias("chunks"))
    rest = rest.join(chunks, "place").withColumn("chunk", F.pmod(F.xxhash64("digest", F.lit(1)), F.col("chunks")).cast("int"))
    visit = rest.select("digest", "place", F.col("chunk").alias("c"), "chunks", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("b"))
    stay = place.select("digest", "place", F.col("block").alias("b")).join(chunks, "place")
    stay = stay.select("digest", "place", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("c"), "chunks", "b")
    cells = visit.select("digest", "place", "c", "chunks", "b").union(stay).distinct()
    return cut(found.union(meet(cells.withColumn("block", F.col("b") * F.col("chunks") + F.col("c")))), "found")


def _across(long: DataFrame, label: DataFrame) -> DataFrame:
    """Entries of split lists, dealt to cells (token, block, chunk) in which those that may not yet be joined meet.

    The entries outside a list's largest component visit all its blocks, in chunks
    of some ``SPLIT``; the entries of a block stay in it, once for each chunk.
    """
    rows = long.join(label.withColumnRenamed("node", "digest"), "digest", "left").withColumn("component", F.coalesce("component", "digest"))
    main = rows.groupBy("token", "component").count().groupBy("token").agg(F.max_by("component", F.struct("count", "component")).alias("main"))
    rest = rows.join(main, "token").where("component <> main").drop("main")
    chunks = rest.groupBy("token").agg(F.ceil(F.count(F.lit(1)) / SPLIT).cast("int").alias("chunks"))
    of = ["token", "digest", "size", "pos", "component"]
    visit = rest.join(chunks, "token").withColumn("chunk", F.pmod(F.xxhash64("digest", F.lit(3)), F.col("chunks")).cast("int"))
    visit = visit.select(*of, F.lit(1).alias("side"), "chunk", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    stay = rows.join(chunks, "token").select(*of, F.lit(2).alias("side"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), "block")
    return visit.union(stay)


def grouped(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = N, num: int = NUM, den: int = DEN) -> DataFrame:
    """Per row: doc, text_hash, n_shingles, component_id, and group, which tells components apart where ids repeat."""
    spark = docs.sparkSession
    docs = docs.select(F.col(doc_id).cast("bigint").alias("doc"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))
    heavy = spark.sparkContext.broadcast(frequent_tokens(docs.select("text"), n, num, den))

    def prefixes(batches):
        tokens, rank = heavy.value
        seen: set[int] = set()
        for batch in batches:
            sizes, digests, parts, cells = [], [], [], []
            for s in shingle_sets(batch.column(2), n):
                sizes.append(len(s))
                d = _digest(s) if len(s) else None
                digests.append(d)
                fresh = len(s) > 0 and d not in seen
                parts.append(prefix(s, tokens, rank, num, den) if fresh else None)
                cells.append(histogram(s) if fresh else None)
                seen.add(d)
            columns = [batch.column(0), batch.column(1), pa.array(sizes, pa.int32()), pa.array(digests, pa.int64()), _lists_of(parts), pa.array(cells, pa.list_(pa.int16()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc", "text_hash", "size", "digest", "tokens", "cells"])

    known = docs.where("doc is not null")
    member = cut(known.mapInArrow(tidy(prefixes), "doc bigint, text_hash bigint, size int, digest bigint, tokens array<bigint>, cells array<smallint>"), "prefixes")
    with scratch(spark) as keep:
        comp = keep(_linked(known, member, n, num, den))

    least = member.where("digest is not null").groupBy("digest").agg(F.min("doc").alias("rep"), F.count(F.lit(1)).alias("copies"))
    label = least.join(comp.withColumnRenamed("node", "digest"), "digest", "left").withColumn("component", F.coalesce("component", "digest"))
    smallest = label.join(comp.select("component").distinct(), "component", "left_semi").groupBy("component").agg(F.min("rep").alias("low"))
    label = label.join(smallest, "component", "left")
    label = label.where((F.col("copies") > 1) | F.col("low").isNotNull()).select(F.col("digest").alias("of"), F.coalesce("low", "rep").alias("label"), "component")
    out = member.select("doc", "text_hash", "size", "digest").join(label, F.col("digest") == F.col("of"), "left")
    out = out.select("doc", "text_hash", F.col("size").cast("bigint").alias("n_shingles"), F.coalesce("label", "doc").alias("component_id"), F.coalesce("component", "digest").alias("group"))

    def count_only(batches):
        for batch in batches:
            sizes = [len(s) for s in shingle_sets(batch.column(2), n)]
            none = pa.nulls(batch.num_rows, pa.int64())
            yield pa.RecordBatch.from_arrays([none, batch.column(1), pa.array(sizes, pa.int64()), none, none], names=["doc", "text_hash", "n_shingles", "component_id", "group"])

    return out.union(docs.where("doc is null").mapInArrow(tidy(count_only), out.schema))


def near_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = N, num: int = NUM, den: int = DEN) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id."""
    return grouped(docs, doc_id, text, n, num, den).select(F.col("doc").alias(doc_id), "n_shingles", "component_id")


def _linked(known: DataFrame, member: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """(node, component) of the sets with links."""
    spark = known.sparkSession
    cells = member.where("cells is not null").groupBy("digest").agg(F.first("cells").alias("cells"))
    entries = member.select("digest", "size", F.posexplode("tokens").alias("pos", "token"))
    sampled = entries.where(F.pmod(F.xxhash64("digest", F.lit(2)), F.lit(SAMPLED)) == 0).select("token", "digest").distinct()
    hot = sampled.groupBy("token").count().where(F.col("count") * SAMPLED >= SPLIT)
    hot = cut(hot.select("token", F.greatest(F.lit(2), F.ceil(F.col("count") * SAMPLED / SPLIT)).cast("int").alias("blocks")), "hot")
    any_hot = not hot.isEmpty()
    # the planner broadcasts the table of long lists only while it is small
    entries = entries.join(hot, "token", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))) if any_hot else entries.withColumn("blocks", F.lit(1))
    entries = entries.withColumn("block", F.pmod(F.xxhash64("digest", "token"), F.col("blocks")).cast("int"))
    entries = gathered(entries.select("token", "block", "digest", "size", "pos", "blocks"), ["token", "block"], ["size", "pos", "digest"])
    lists = cut(entries.mapInArrow(tidy(_split_lists(SHORT, num, den)), _LISTS), "lists")

    long = lists.where("kind = 1").select("token", "block", "blocks", F.col("a").alias("digest"), F.col("size_a").alias("size"), "pos")
    few = lists.where("kind = 2").groupBy(F.col("a").alias("digest")).agg(F.sum("pos").cast("int").alias("few"))
    place = long.groupBy("digest").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "token"))), lambda x: x["token"]).alias("longs"))
    place = place.join(few, "digest", "left").join(cells, "digest")
    place = cut(place.select("digest", "longs", F.coalesce("few", F.lit(0)).alias("few"), "cells"), "places")

    def spanning_of(rows: DataFrame, keys: list[str]) -> DataFrame:
        return gathered(rows.join(place, "digest"), keys, ["size", "pos", "digest"]).mapInArrow(tidy(_candidates(num, den, keys)), "a bigint, b bigint")

    spanning = spanning_of(long.withColumns({"component": F.col("digest"), "side": F.lit(0)}), ["token", "block"])
    if any_hot:
        spanning = cut(spanning, "spanning")
        spanning = spanning.union(spanning_of(_across(long.where("blocks > 1"), components(spanning)), ["token", "block", "chunk"]))

    # pairs of short lists: the tokens they share there, and could share in long lists, must suffice
    manies = place.select("digest", F.size("longs").alias("many"))
    shared = lists.where("kind = 0").groupBy("a", "b", "size_a", "size_b").agg(F.count(F.lit(1)).alias("times"), F.max("pos").alias("early")).where("early = 1")
    o = F.ceil(num * (F.col("size_a") + F.col("size_b")) / (num + den))
    length = lambda c: F.col(c) - F.ceil(num * F.col(c) / den) + 1
    need = F.greatest(F.lit(1), F.least(length("size_a") + o - F.col("size_a"), length("size_b") + o - F.col("size_b")))
    many = F.least(F.coalesce("many_a", F.lit(0)), F.coalesce("many_b", F.lit(0)))
    shared = (
        shared.withColumn("need", need)
        .join(manies.select(F.col("digest").alias("a"), F.col("many").alias("many_a")), "a", "left")
        .join(manies.select(F.col("digest").alias("b"), F.col("many").alias("many_b")), "b", "left")
        .where(F.col("times") + many >= F.col("need"))
        .select("a", "b", (F.col("size_a") + F.col("size_b") - 2 * o).alias("room"))
        .join(cells.select(F.col("digest").alias("a"), F.col("cells").alias("x")), "a")
        .join(cells.select(F.col("digest").alias("b"), F.col("cells").alias("y")), "b")
        .where(F.aggregate(F.zip_with("x", "y", lambda x, y: F.abs(x.cast("int") - y.cast("int"))), F.lit(0), lambda acc, d: acc + d) <= F.col("room"))
    )
    group = components(cut(spanning.union(shared.select("a", "b")), "candidates"))

    # each candidate group meets in one place, its sets made from one document each
    source = member.where("digest is not null").groupBy("digest").agg(F.min(F.struct("doc", "text_hash")).alias("from"), F.first("size").alias("size"))
    place = group.select(F.col("node").alias("digest"), F.col("component").alias("place")).join(source, "digest")
    blocks = place.groupBy("place").agg(F.ceil(F.sum("size") / HOME_TOKENS).cast("int").alias("blocks"))
    place = cut(place.join(blocks, "place").withColumn("block", F.pmod(F.xxhash64("digest"), F.col("blocks")).cast("int")), "meeting")
    wanted = spark.sparkContext.broadcast(bitmap_of(place.select(F.xxhash64("from.doc", "from.text_hash").alias("fp")), MAP_BITS))

    def whole(batches):
        seen: set[int] = set()
        for batch in batches:
            may = pa.array(in_bitmap(wanted.value, batch.column(0).to_numpy(), MAP_BITS))
            got = [(d, s.tobytes()) for s in shingle_sets(batch.column(1).filter(may), n) if len(s) and (d := _digest(s)) not in seen and not seen.add(d)]
            yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in got], pa.int64()), pa.array([x for _, x in got], pa.binary())], names=["digest", "shingles"])

    sets = known.select(F.xxhash64("doc", "text_hash").alias("fp"), "text").mapInArrow(tidy(whole), "digest bigint, shingles binary")

    def meet(where: DataFrame) -> DataFrame:
        at = gathered(where.select("digest", "place", "block").join(sets, "digest"), ["place", "block"], ["digest"])
        return at.mapInArrow(tidy(_meet(num, den)), "a bigint, b bigint")

    found = cut(meet(place), "found")
    if not place.where("blocks > 1").isEmpty():
        found = _between(place.where("blocks > 1"), found, meet)
    return components(found)
