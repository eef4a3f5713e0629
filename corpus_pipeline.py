"""A corpus from raw documents to packed token sequences: toxicity, line dedup, near-dedup, decontamination, packing.

Each stage takes the whole table of the one before and works for empty tables, repeated rows, texts of any length and further
columns of any name. Null texts count as empty; they pass all stages but near-dedup, which they pass too since empty texts
are linked with nothing. Rows with a null doc_id cannot be compared with others: the toxicity stage judges them by their text, and
the others keep them as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textweir.llm.decontamination import decontaminate
from textweir.llm.linededup import dedup_passages
from textweir.llm.minhash import near_duplicates
from textweir.llm.packing import default_tokenizer, pack
from textweir.llm.shared import table
from textweir.llm.toxicity import fit, score
from textweir.sources.tables import dropped, scratch, shared_path


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score under 0.5; the field is fitted on the documents at hand and their labels. Of repeated rows all go or stay."""
    return score(docs, fit(docs, table(spark, sf_dir, "labels"))).where("score < 0.5").select("row.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without repeated runs of lines; n_chars follows the text. Rows of one id keep what the others keep."""
    out = dedup_passages(docs)
    new = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return out.select(*(new.get(c, F.col("row")[c]).alias(c) for c in docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The kept document of each group of near-duplicates, with all rows of its id; documents without an id stay."""
    others = near_duplicates(docs).where("doc_id is not null and not kept").select("doc_id").distinct()
    return docs.join(others, "doc_id", "left_anti").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window with a benchmark item; an id goes with all its rows if one of them does."""
    found = decontaminate(docs, table(spark, sf_dir, "benchmark")).where("contaminated").select("doc_id").distinct()
    return docs.join(found, "doc_id", "left_anti").select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of binary lengths with their token ids; each row is packed for itself."""
    return pack(docs, default_tokenizer())


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontamination", decontamination), ("packing", packing)]

#: The trained stage and the tokenizer are beyond SQL; the tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's table is written before the next begins; then what the stage needed, and the table it read, go."""
    given = docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = shared_path(spark, name)
        with scratch(spark):
            out = stage(spark, docs, sf_dir)
            out.write.option("compression", "zstd").parquet(path)
        if docs is not given:
            dropped(docs)
        docs = spark.read.schema(out.schema).parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
