"""Corpus pipeline: from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept; all but the last return the columns of ``documents``. ``run`` writes every
stage's result to the shared folder as Parquet and reads it for the next one, so
a lost executor costs a reread.

1. language ID: documents whose language is rejected (no letters, or too narrow
   a margin) go.
2. line dedup: boilerplate lines go from all but the first document that has
   them; documents left without any line go.
3. n-gram Jaccard join: of each group of near copies (five-word shingles,
   similarity 0.8 or more) the document with the smallest id stays.
4. benchmark decontamination: documents that share a benchmark window of eight
   words go, and those that quote the whole of an item of four to seven words.
   Whole items of fewer words are common phrases: they tell nothing, however often
   they occur.
5. packing: what is left becomes pieces of fixed-length sequences.

Null texts are rejected by the first stage. Stages decide by row: rows that share a
doc_id are documents of their own (line dedup alone takes them for one document,
which keeps more), and of rows with equal doc_id and text one stays. Rows with a
null doc_id stay, except where their text alone decides: the first and the fourth
stage. Extra columns pass through until packing, whatever their names. A stage's
table and all it was made from go as soon as the next one is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terracell.llm import decontaminate, jaccard_join, language_id, line_dedup, packing
from terracell.llm.shared import cut, drop_cuts, fresh, scratch, table

SHINGLE, SIMILARITY = 5, (80, 100)


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prefix = "_"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix += "_"
    out = language_id.identify(docs, language_id.train(docs), prefix=prefix)
    return out.where(~F.col(prefix + "rejected")).select(docs.columns)


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    removed, left = fresh(docs, "removed", "left")
    out = line_dedup.remove_boilerplate(docs, removed=removed, left=left)
    out = out.where(F.coalesce(F.col(left), F.lit(1)) > 0)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(removed) > 0, F.length("text").cast("bigint")).otherwise(F.col("n_chars")))
    return out.select(docs.columns)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    groups = cut(jaccard_join.grouped(docs, n=SHINGLE, num=SIMILARITY[0], den=SIMILARITY[1]).where("doc is not null and n_shingles > 0"), "groups")
    key = F.struct("doc", "text_hash")
    heads = groups.groupBy("group").agg(F.min(key).alias("head"))  # the smallest id of each
    rows = groups.groupBy("doc", "text_hash", "group").agg(F.count(F.lit(1)).alias("copies")).join(heads, "group")
    others = rows.where(key != F.col("head")).select(F.col("doc").alias("k"), F.col("text_hash").alias("h"))
    same = lambda t: (docs["doc_id"] == t["k"]) & (F.xxhash64(docs["text"]) == t["h"])
    out = docs.join(others, same(others), "left_anti")
    again = cut(rows.where(key == F.col("head")).where("copies > 1").select(F.col("doc").alias("k"), F.col("text_hash").alias("h")), "repeated")
    if again.isEmpty():
        return out.select(docs.columns)
    # rows that repeat both doc_id and text: any one of them stays
    one = docs.join(again, same(again)).groupBy("k", "h").agg(F.first(F.struct(*[docs[c] for c in docs.columns])).alias("row")).select("row.*")
    return out.join(again, same(again), "left_anti").select(docs.columns).union(one)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _, windows = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"))
    leaks = windows.where(F.col("size") >= decontaminate.GRAM).select(F.col("doc_id").alias("k"), F.col("text_hash").alias("h")).distinct()
    return docs.join(leaks, docs["doc_id"].eqNullSafe(leaks["k"]) & (F.xxhash64(docs["text"]) == leaks["h"]), "left_anti").select(docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.report(docs)


STAGES = [
    ("language ID", keep_identified),
    ("line dedup", drop_boilerplate),
    ("n-gram Jaccard join", keep_one_of_each_group),
    ("benchmark decontamination", drop_contaminated),
    ("packing", pack_sequences),
]

#: Compression classification has no SQL counterpart; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES[:-1]:
        with scratch(spark) as keep:
            docs = keep(cut(stage(spark, docs, sf_dir), name.replace(" ", "-")))
        if before is not None:
            drop_cuts(spark, before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
