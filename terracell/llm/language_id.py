"""Language identification by compression.

For every language of the training rows a raw-content zstandard dictionary is
made of sample text. A text is cut into blocks, each block is compressed with
every dictionary, and the language with the fewest bytes in total wins: the
dictionary that already holds the text's words encodes it as references. The
margin is the runner-up's excess over the winner, per encoded byte; below
``margin`` the document is rejected.

Texts are compared without case, digits and punctuation, so that layout does not
drown the language; the whole text is encoded.

The fit reads the documents twice (a hash of every row that may be learned from,
then the texts of the chosen rows). Its bound: ``SAMPLE`` distinct rows (doc_id,
language and text together) of each language, those of smallest hash. A
dictionary holds an equal share of each, in ``PIECES`` pieces spread evenly over
the text. All dictionaries together have at most ``MODEL`` bytes, so with many
languages each is smaller.

Edge cases: a null text, or one without letters, is ``und`` with score 0 and is
rejected. Without any training row everything is ``und``. With one language
learned, that language is predicted with score 1. Equal sizes go to the first
language in name order, with score 1 / (number of tied) and are rejected.
Repeated rows each get their row and are learned from once; rows that share a
doc_id are learned from apart, each for its own language. Rows with a null doc_id,
language or text are never learned from. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terracell.llm.shared import cut, scratch, smallest_of_each, tidy

SAMPLE = 128  # training texts per language: the documented bound of the fit
PIECES = 4  # of a text that enter a dictionary
DICTIONARY = 64 * 1024  # bytes of a dictionary
MODEL = 32 << 20  # bytes of all dictionaries
CODERS = 256  # languages whose coders a task holds at once
BLOCK = 2048  # bytes encoded at once
#: short matches and a lazy search, so that the dictionary's syllables are found
PARAMETERS = {"min_match": 3, "strategy": zstandard.STRATEGY_LAZY, "search_log": 4}
LEVEL = 6
#: Ends every block. Without it the encoder stores a short text as it is, and all
#: dictionaries tie; a run of a byte that no dictionary holds costs each the same.
CARRIER = b"0" * 256
MARGIN = 0.0015
SHARPNESS = 60.0  # of the score: how fast it falls with excess bytes per byte

#: ASCII bytes that are no letters become spaces
_LETTERS = bytes(b if b >= 0x80 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def held_out(key: Column, folds: int = 5) -> Column:
    """Whether crc32 of the key as text leaves 0 modulo ``folds``; null: no."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % folds == 0, F.lit(False))


def plain(text: str) -> bytes:
    """Lower-case letters with single spaces; anything else is a gap."""
    return b" ".join(text.lower().encode("utf-8", "replace").translate(_LETTERS).split())


def _has_letter(text: str, raw: bytes) -> bool:
    if not raw:
        return False
    return not raw.isspace() and (any(97 <= b <= 122 for b in raw[:64]) or any(c.isalpha() for c in text))


def excerpt(raw: bytes, share: int, pieces: int = PIECES) -> bytes:
    """``share`` bytes of a text, in pieces spread evenly from its beginning to its end."""
    if len(raw) <= share:
        return raw
    size = max(1, (share - pieces) // pieces)
    step = (len(raw) - size) / (pieces - 1)
    return b" ".join(raw[round(i * step) : round(i * step) + size] for i in range(pieces))


def _excerpts(batches):
    for batch in batches:
        out = [excerpt(plain(t.as_py()), n.as_py()) for t, n in zip(batch.column(2), batch.column(3), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], names=["lang", "row", "excerpt"])


def _learnable(docs: DataFrame) -> DataFrame:
    """(lang, row, text) of the rows that may be learned from; ``row`` is a hash of the whole row."""
    rows = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    return rows.select("lang", F.xxhash64("doc_id", "lang", "text").alias("row"), "text")


def train(docs: DataFrame, sample: int = SAMPLE, dictionary: int = DICTIONARY, model: int = MODEL) -> dict[str, bytes]:
    """language -> dictionary, from ``sample`` distinct rows of each language (all of them if there are fewer)."""
    with scratch(docs.sparkSession):
        chosen = cut(smallest_of_each(_learnable(docs).select("lang", "row"), "lang", "row", sample), "languages")
        counts = chosen.groupBy("lang").count()
        each = min(dictionary, model // max(1, counts.count()))
        chosen = chosen.join(counts, "lang").select("lang", "row", (F.lit(each) / F.col("count") - 1).cast("int").alias("share"))
        # a row that repeats is learned from once; all excerpts together have at most `model` bytes
        texts = _learnable(docs).join(chosen, ["lang", "row"]).select("lang", "row", "text", "share")
        texts = texts.mapInArrow(tidy(_excerpts), "lang string, row bigint, excerpt binary").groupBy("lang", "row").agg(F.min("excerpt").alias("excerpt")).collect()
    got: dict[str, list[tuple[int, bytes]]] = {}
    for r in texts:
        if r["excerpt"]:
            got.setdefault(r["lang"], []).append((r["row"], bytes(r["excerpt"])))
    return {lang: b" ".join(x for _, x in sorted(parts)) for lang, parts in sorted(got.items())}


def blocks(raw: bytes) -> list[bytes]:
    """What is encoded at once: pieces of nearly equal size."""
    n = max(1, round(len(raw) / BLOCK))
    cuts = [len(raw) * i // n for i in range(n + 1)]
    return [raw[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


def coder(dictionary: bytes) -> zstandard.ZstdCompressor:
    d = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    params = zstandard.ZstdCompressionParameters.from_level(LEVEL, **PARAMETERS, write_content_size=False, write_checksum=False, write_dict_id=False)
    d.precompute_compress(compression_params=params)
    return zstandard.ZstdCompressor(dict_data=d, compression_params=params)


class Classifier:
    """Encodes with every dictionary; holds compressors, so it is made on the worker.

    Of more than ``CODERS`` languages the coders are made in groups, again for each batch.
    """

    def __init__(self, dictionaries: dict[str, bytes]):
        self.names = sorted(dictionaries)
        self.dictionaries = [dictionaries[n] for n in self.names]
        self.coders = [coder(d) for d in self.dictionaries] if len(self.names) <= CODERS else None

    def sizes(self, texts: list[bytes]) -> np.ndarray:
        """(texts, languages): encoded bytes in total."""
        cut = [blocks(raw) for raw in texts]
        out = np.zeros((len(texts), len(self.names)))
        for lo in range(0, len(self.names), CODERS):
            group = self.coders[lo : lo + CODERS] if self.coders else [coder(d) for d in self.dictionaries[lo : lo + CODERS]]
            for i, pieces in enumerate(cut):
                for k, c in enumerate(group):
                    out[i, lo + k] = sum(len(c.compress(b + CARRIER)) for b in pieces)
        return out

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, float]]:
        """(language, score, margin) of each text."""
        out = [("und", 0.0, 0.0)] * len(texts)
        raw = [plain(t) if t else b"" for t in texts]
        some = [i for i, (t, r) in enumerate(zip(texts, raw, strict=True)) if self.names and _has_letter(t or "", r)]
        for i, size in zip(some, self.sizes([raw[i] for i in some]), strict=True):
            size = size / len(raw[i])
            best = int(size.argmin())
            excess = size - size[best]
            others = np.delete(excess, best)
            score = 1.0 / float(np.exp(-SHARPNESS * excess).sum())
            out[i] = (self.names[best], score, float(others.min()) if len(others) else 1.0)
        return out


def identify(docs: DataFrame, dictionaries: dict[str, bytes], text: str = "text", margin: float = MARGIN, prefix: str = "") -> DataFrame:
    """docs with lang_pred, score, margin and rejected (names after ``prefix``; they replace columns of these names)."""
    shared = docs.sparkSession.sparkContext.broadcast(dictionaries)
    made = [prefix + c for c in ("lang_pred", "score", "margin", "rejected")]
    added = ", ".join(f"`{c}` {kind}" for c, kind in zip(made, ("string", "double", "double", "boolean"), strict=True))
    docs = docs.drop(*made)
    names = docs.columns

    def run(batches):
        model = Classifier(shared.value)
        for batch in batches:
            got = model.predict(batch.column(names.index(text)).to_pylist())
            pred, score, gap = ([g[i] for g in got] for i in range(3))
            refused = [p == "und" or g < margin for p, g in zip(pred, gap, strict=True)]
            extra = [pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(gap, pa.float64()), pa.array(refused, pa.bool_())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names=[*names, *made])

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + ", " + added
    return docs.mapInArrow(tidy(run), ddl)


def predictions(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score (and margin, rejected) of every row."""
    model = train(docs)
    out = identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "margin", "rejected")
