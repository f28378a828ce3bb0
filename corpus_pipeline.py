"""From documents to training windows: the stages in order, each over all that its predecessor kept."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphlake.llm._scratch import materialize
from graphlake.llm.decontaminate import find_contamination
from graphlake.llm.exact_dedup import exact_duplicates
from graphlake.llm.jaccard_join import near_duplicates
from graphlake.llm.language_id import fit_languages, identify_languages
from graphlake.llm.packing import pack_documents

DOCUMENTS = ["doc_id", "text", "lang", "source", "n_chars"]


def _numbered(docs: DataFrame) -> DataFrame:
    """The documents with a unique ``row``: the number of their file and their place in it, which every reading of
    the files gives again. What isn't a reading of files is written first."""
    if docs._jdf.queryExecution().analyzed().nodeName() != "LogicalRelation":
        docs = materialize(docs.select(*DOCUMENTS), "documents")
    paths = docs.select(F.col("_metadata.file_path").alias("path")).distinct().orderBy("path").toArrow()
    if paths.num_rows > 1 << 23:
        raise ValueError("more files than a row's number has room for")
    files = docs.sparkSession.createDataFrame(paths.append_column("file", pa.array(range(paths.num_rows), pa.int64())))
    rows = docs.select(*DOCUMENTS, F.col("_metadata.file_path").alias("path"), F.col("_metadata.row_index").alias("at"))
    return rows.join(F.broadcast(files), "path").select(*DOCUMENTS, (F.shiftleft("file", 40) + F.col("at")).alias("row"))


def _without(docs: DataFrame, rows: DataFrame, name: str) -> DataFrame:
    """The numbered documents whose row is not among ``rows``, which are the few. Texts don't move while the rows
    are small enough to be broadcast by the session's own threshold."""
    return docs.join(materialize(rows.select("row"), name), "row", "left_anti").select(*DOCUMENTS)


def known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that language ID doesn't reject."""
    rows = _numbered(docs)
    return _without(rows, identify_languages(rows, fit_languages(docs), id_col="row").where("rejected"), "rejected")


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts; of rows that tie, repeated ones included, the first."""
    rows = _numbered(docs)
    return _without(rows, exact_duplicates(rows, tie_col="row").where("not kept"), "copies")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-duplicates: that of the smallest id, null last, then the first row."""
    rows = _numbered(docs)
    found = materialize(near_duplicates(rows, id_col="row").where("n_shingles > 0").select("row", "component_id"), "components")
    members = found.join(rows.select("row", F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row").alias("place")), "row")
    best = members.groupBy("component_id").agg(F.min("place")["row"].alias("keep"), F.count("*").alias("n")).where("n > 1")
    copies = found.join(best, "component_id").where("row <> keep")
    return _without(rows, copies, "near-copies")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a word inside any window of a benchmark item."""
    rows = _numbered(docs)
    found = find_contamination(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col="row")
    return _without(rows, found.where("size(spans) > 0"), "contaminated")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces in windows of at most 4096 ids."""
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language ID", known_languages),
    ("exact dedup", drop_exact_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("packing", pack),
]

#: A learned language model and a tokenizer's ids have no SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage keeps is written to the shared folder for the next one."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
