"""Line deduplication by distinct-site spread.

A line that many sites carry is boilerplate. Per line hash a HyperLogLog sketch
of the sites is aggregated (map-side first, so a line in a third of all rows
costs one row a task), together with the first document that has the line. Lines
whose estimate is far above the threshold are boilerplate, far below it not;
those near it are counted exactly. Boilerplate is removed everywhere but in the
first document (smallest doc_id) that has it, so each text survives once.

A line is compared without surrounding white space; blank lines are never
removed by themselves. Lines are identified by two independent 64-bit hashes.

Edge cases: null and empty texts stay as they are. A null site counts as no
site. Rows with a null doc_id are never first, and nothing is removed from them;
their sites count. Rows that repeat a doc_id are one document: what is kept in it
is kept in each. A document whose lines all go becomes ''. Extra columns pass
through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terracell.llm.shared import cut, fresh

SITES = 6  # distinct sites that make a line boilerplate
NEAR = 2.0  # estimates within this factor of the threshold are counted exactly
PRECISION = 12  # log2 of the sketch's registers
BLANKS = " \t\r\f\v"


def _split(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _key(line: Column) -> Column:
    """The two hashes of a line as one struct; null for blank lines."""
    bare = F.btrim(line, F.lit(BLANKS))
    return F.when(bare != "", F.struct(F.xxhash64(bare).alias("h"), F.xxhash64(F.lit(7), bare).alias("g")))


def line_keys(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", site: str = "source") -> DataFrame:
    """(doc, text_hash, site, i, h, g) of every line that is not blank; ``i`` is its place in the text."""
    lines = docs.select(F.col(doc_id).alias("doc"), F.xxhash64(text).alias("text_hash"), F.col(site).alias("site"), F.posexplode(F.transform(_split(F.col(text)), _key)).alias("i", "k"))
    return lines.where("k is not null").select("doc", "text_hash", "site", "i", "k.h", "k.g")


def boilerplate(lines: DataFrame, sites: int = SITES) -> DataFrame:
    """(h, g, first_doc) of every line on at least ``sites`` distinct sites."""
    spread = lines.groupBy("h", "g").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", PRECISION)).alias("est"), F.min("doc").alias("first_doc"))
    spread = cut(spread.where(F.col("est") >= sites / NEAR), "spread")
    near = spread.where(F.col("est") < sites * NEAR)
    exact = (
        lines.join(near.select("h", "g"), ["h", "g"], "left_semi")
        .where("site is not null")
        .select("h", "g", "site").distinct()
        .groupBy("h", "g").agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") >= sites)
    )
    sure = spread.where(F.col("est") >= sites * NEAR).select("h", "g", "first_doc")
    return sure.union(near.join(exact, ["h", "g"]).select("h", "g", "first_doc"))


def remove_boilerplate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", site: str = "source", sites: int = SITES, removed: str = "n_removed", left: str | None = None) -> DataFrame:
    """docs with ``text`` cleaned, and the number of lines taken out (column ``removed``, which replaces any of that name).

    ``left`` names a column for the number of lines that are not blank and stay (NULL
    where none is taken out). It is counted apart from the text, so a filter on it
    does not clean the text once more.
    """
    docs = docs.drop(removed, *([left] if left else []))
    lines = cut(line_keys(docs, doc_id, text, site), "lines")
    spread = cut(boilerplate(lines, sites), "boilerplate")
    of, of_text, gone, parts, kept = fresh(docs, "of", "of_text", "gone", "parts", "kept")
    away = (
        lines.select("doc", "text_hash", "i", "h", "g").join(spread, ["h", "g"]).where(F.col("doc") != F.col("first_doc"))
        .groupBy(F.col("doc").alias(of), F.col("text_hash").alias(of_text)).agg(F.collect_set("i").alias(gone))
    )
    joined = docs.join(away, (docs[doc_id] == away[of]) & (F.xxhash64(docs[text]) == away[of_text]), "left")
    joined = joined.withColumn(parts, F.when(F.col(gone).isNotNull(), _split(F.col(text))))
    # the places that stay, by a hash set: linear in the lines
    stay = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col(gone))
    joined = joined.withColumn(kept, F.when(F.col(parts).isNotNull(), F.transform(stay, lambda i: F.col(parts)[i])))
    text_now = F.when(F.col(kept).isNull(), F.col(text)).otherwise(F.array_join(kept, "\n"))
    count = F.when(F.col(kept).isNull(), F.lit(0)).otherwise(F.size(parts) - F.size(kept)).cast("bigint")
    full = F.size(F.filter(_split(F.col(text)), lambda x: F.btrim(x, F.lit(BLANKS)) != ""))
    more = [F.when(F.col(gone).isNotNull(), full - F.size(gone)).alias(left)] if left else []
    return joined.select(*[text_now.alias(c) if c == text else F.col(c) for c in docs.columns], count.alias(removed), *more)


def cleaned(docs: DataFrame) -> DataFrame:
    """doc_id, the cleaned text and the number of lines removed, for every row."""
    return remove_boilerplate(docs.select("doc_id", "text", "source")).select("doc_id", "text", "n_removed")
