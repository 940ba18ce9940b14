"""Text quality by nearest-neighbour voting in a latent-semantic space.

Training: from a bounded sample of labelled rows, hashed term counts (words, their
shapes, byte trigrams of the text's outline, and what repeats) are weighted by
log count and inverse document frequency, scaled to length 1, and reduced by a
truncated singular value decomposition. The sample's latent vectors and labels
are broadcast; their size is fixed by the parameters, not by the corpus.

Scoring: every document is projected and compared with all sample vectors in
blocks of documents (exact cosines by a matrix product in double precision); its
``NEIGHBOURS`` nearest vote for their labels with their cosine as weight (nothing
below 0), and the score is label 1's part of the votes. The sample holds up to
``SAMPLE`` documents of each label, so a rare label can be heard.

Edge cases: null and empty texts, and texts without terms, have the zero vector
and get the mean label of the sample as score. Without labelled rows every score
is 0.5. Null labels and null doc_ids are never learned from. Cosines that agree to
``DIGITS`` decimal places are ties, and the earlier sample row (in order of
doc_id) is nearer. Repeated rows each get their row. A doc_id is learned from
once: its largest label, and of several texts the one of smallest hash. Extra
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terracell.llm import bytewords as B
from terracell.llm.language_id import held_out
from terracell.llm.shared import smallest_of_each, tidy

SAMPLE = 1500  # training rows per label value: the documented bound of the fit
BUCKETS = 4096
RANK = 48
NEIGHBOURS = 15
BLOCK = 256  # documents per matrix product
DIGITS = 9  # of a cosine that count when neighbours are ranked
THRESHOLD = 0.3

#: outline of a byte: lower, upper, digit, beyond ASCII, space, line end; others stand for themselves
_OUTLINE = np.array([97 if 97 <= b <= 122 else 65 if 65 <= b <= 90 else 48 if 48 <= b <= 57 else 128 if b >= 128 else 32 if b in (9, 32) else 10 if b in (10, 13) else b for b in range(256)], dtype=np.uint64)
_SEEDS = B.mix(np.arange(1, 9, dtype=np.uint64))


def _slots(values: np.ndarray, kind: int) -> np.ndarray:
    return (B.mix(values ^ _SEEDS[kind]) >> np.uint64(64 - 12)).astype(np.int64)


def term_counts(texts: pa.Array) -> np.ndarray:
    """(rows, BUCKETS) float32 counts of hashed terms."""
    data, offsets = B.utf8(texts)
    out = np.zeros((len(offsets) - 1, BUCKETS), dtype=np.float32)
    for i, j in B.chunks(offsets):
        lo = offsets[i]
        part = data[lo : offsets[j]]
        local = offsets[i : j + 1] - lo
        words, _, _, bounds = B.hash_words(part, local, B.NONSPACE)
        outline = _OUTLINE[part]
        grams = outline[:-2] * np.uint64(65536) + outline[1:-1] * np.uint64(256) + outline[2:] if len(part) > 2 else np.zeros(0, np.uint64)
        gram_slot, word_slot = _slots(grams, 0), _slots(words, 1)
        for r in range(j - i):
            a, b = int(local[r]), int(local[r + 1])
            row = np.bincount(gram_slot[a : max(a, b - 2)], minlength=BUCKETS).astype(np.float32)
            w = words[bounds[r] : bounds[r + 1]]
            if len(w):
                row += np.bincount(word_slot[bounds[r] : bounds[r + 1]], minlength=BUCKETS)
                again = 1 - len(np.unique(w)) / len(w)
                same = float((w[1:] == w[:-1]).mean()) if len(w) > 1 else 0.0
                # what repeats, as pseudo-terms that grow with the share of it
                steps = np.array([64 + int(again * 8), 80 + int(same * 8), 96 + min(15, int(np.log2(len(w)))), 112 + min(15, (b - a) // len(w))], dtype=np.uint64)
                row[_slots(steps, 2)] += len(w) / 4
            out[i + r] = row
    return out


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(counts) * idf
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


class Model:
    """Projection, sample vectors and labels."""

    def __init__(self, counts: np.ndarray, labels: np.ndarray, rank: int = RANK):
        self.labels = labels.astype(np.float64)
        self.idf = np.log((1 + len(counts)) / (1 + (counts > 0).sum(axis=0))).astype(np.float32) + 1
        x = weighted(counts, self.idf)
        # the right singular vectors of x from the smaller Gram matrix
        gram = (x @ x.T).astype(np.float64)
        value, vector = np.linalg.eigh(gram)
        keep = np.argsort(value)[::-1][: min(rank, len(x))]
        keep = keep[value[keep] > 1e-9]
        self.project = x.T.astype(np.float64) @ (vector[:, keep] / np.sqrt(value[keep]))
        self.sample = self._unit(x.astype(np.float64) @ self.project)
        self.mean = float(self.labels.mean())

    @staticmethod
    def _unit(z: np.ndarray) -> np.ndarray:
        norm = np.linalg.norm(z, axis=1, keepdims=True)
        return np.divide(z, norm, out=np.zeros_like(z), where=norm > 0)

    def scores(self, counts: np.ndarray, neighbours: int = NEIGHBOURS) -> np.ndarray:
        z = self._unit(weighted(counts, self.idf).astype(np.float64) @ self.project)
        out = np.full(len(z), self.mean)
        n = len(self.sample)
        k = min(neighbours, n)
        for lo in range(0, len(z), BLOCK):
            cosine = z[lo : lo + BLOCK] @ self.sample.T
            # one integer for rank: the rounded cosine, then the earlier row
            rank = np.rint(cosine * 10**DIGITS).astype(np.int64) * n - np.arange(n)
            near = np.argpartition(-rank, k - 1, axis=1)[:, :k]
            vote = np.maximum(np.take_along_axis(cosine, near, axis=1), 0)
            total = vote.sum(axis=1)
            some = total > 0
            out[lo : lo + BLOCK][some] = (vote * self.labels[near]).sum(axis=1)[some] / total[some]
        return out


def sample_rows(labels: DataFrame, label: str, sample: int) -> DataFrame:
    """(doc_id, label): at most ``sample`` documents of smallest hash for each of 0 and 1."""
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max(label).cast("int").alias("label")).withColumn("h", F.xxhash64("doc_id"))
    few = smallest_of_each(known, "label", "h", sample)
    # at most 2 * sample rows, so this side may be broadcast
    return known.join(F.broadcast(few), ["label", "h"]).select("doc_id", "label")


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> Model | None:
    chosen = sample_rows(labels, label, sample)  # at most 2 * sample rows

    def counts(batches):
        for batch in batches:
            c = term_counts(batch.column(2))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([r.astype(np.uint16 if r.max() < 65536 else np.float32).tobytes() for r in c], pa.binary())], names=["doc_id", "label", "counts"])

    rows = (
        docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where(F.col("text").isNotNull()).join(F.broadcast(chosen), "doc_id")
        .groupBy("doc_id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("doc_id", "label", "text")
        .mapInArrow(tidy(counts), "doc_id bigint, label int, counts binary").collect()
    )
    if not rows:
        return None
    rows.sort(key=lambda r: r["doc_id"])
    x = np.stack([np.frombuffer(r["counts"], dtype=np.uint16 if len(r["counts"]) == 2 * BUCKETS else np.float32).astype(np.float32) for r in rows])
    return Model(x, np.array([r["label"] for r in rows]))


def score(docs: DataFrame, model: Model | None, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs with score and predicted; other columns as they are."""
    docs = docs.drop("score", "predicted")
    names = docs.columns
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for batch in batches:
            for lo in range(0, batch.num_rows, BLOCK):
                part = batch.slice(lo, BLOCK)
                s = m.scores(term_counts(part.column(names.index(text)))) if m else np.full(part.num_rows, 0.5)
                s = np.clip(s, 0.0, 1.0)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))], names=[*names, "score", "predicted"])

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(tidy(run), f"{ddl}, score double, predicted int")


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    out = score(docs.select("doc_id", "text"), train(docs, labels))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
