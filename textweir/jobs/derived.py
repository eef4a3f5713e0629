"""Documents, keyword queries and a command log derived from the tables at hand."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textweir.functions.text import legal_words, normalize_text
from textweir.sources.tables import spread


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, seq, text) with normalized texts; arrival never ties with a query change."""
    d = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return d.select("doc_id", (F.col("doc_id") * 10 + 5).alias("seq"), normalize_text(F.col("text")).alias("text"))


def keyword_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, query_str, match_type, match_dist, start_seq, end_seq): chunks of five words of each benchmark item."""
    own = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", legal_words(normalize_text(F.col("text"))).alias("ws")).where("size(ws) > 0")
    c, i = F.col("c"), F.col("item_id")
    chunks = own.select("item_id", "ws", F.explode(F.sequence(F.lit(0), F.ceil(F.size("ws") / 5).cast("int") - 1)).alias("c"))
    kind = ((i + c) % 3).cast("int")
    q = chunks.select((i * 1000 + c).alias("query_id"), F.concat_ws(" ", F.slice("ws", 5 * c + 1, (1 + (i + c) % 5).cast("int"))).alias("query_str"), kind.alias("match_type"), F.when(kind == 0, 0).otherwise(1 + c % 3).cast("int").alias("match_dist"), (10 * ((i * 13 + c * 7) % 200) + 1).cast("long").alias("start_seq"))
    return q.withColumn("end_seq", F.when(F.col("query_id") % 4 != 0, F.col("start_seq") + 10 * (50 + F.col("query_id") % 100)))


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq, value): the starts, ends and documents above as lines of a command log; an end is later than a start of its seq."""
    q, d = keyword_queries(spark, sf_dir), documents(spark, sf_dir)
    text = lambda *cols: F.concat_ws(" ", *(c.cast("string") for c in cols))
    col = F.col
    n = F.size(F.split("query_str", " "))
    starts = q.select((col("start_seq") * 10).alias("seq"), text(F.lit("s"), col("query_id"), col("match_type"), col("match_dist"), n, col("query_str")).alias("value"))
    ends = q.where("end_seq is not null").select((col("end_seq") * 10 + 1).alias("seq"), text(F.lit("e"), col("query_id")).alias("value"))
    kept = legal_words(col("text"))
    docs = d.select((col("seq") * 10 + 2).alias("seq"), text(F.lit("m"), col("doc_id"), F.size(kept), F.concat_ws(" ", kept)).alias("value"))
    return starts.unionByName(ends).unionByName(docs)
