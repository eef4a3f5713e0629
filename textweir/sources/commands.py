"""Command logs: reading, parsing, checking; and writing results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textweir.functions.text import LONGEST, MOST_CHARS, MOST_DISTANCE, MOST_WORDS, SHORTEST, words
from textweir.sources.tables import stored


#: Blocks of files, some 200 bytes each, that are broadcast.
BROADCAST_BLOCKS = 500_000


def read_command_log(spark: SparkSession, path: str) -> DataFrame:
    """(seq, value): the lines of a log in one global order: by file, then block, then place in the block.

    The order key is the partition's number and the line's place in it; Spark deals larger files first, so the parts are
    ranked by (file, block start), one row a part, and the ranks are added to the lines. The parts are broadcast, so no line
    is shuffled, while they are at most BROADCAST_BLOCKS (counted): some 60 TB of files.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    parts = lines.groupBy("file", "block").agg(F.min("row").alias("lo"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each file block
    parts = stored(parts.withColumn("before", before).select("file", "block", (F.col("before") - F.col("lo") + 1).alias("shift")), "blocks")
    met = lines.join(F.broadcast(parts) if parts.count() <= BROADCAST_BLOCKS else parts, ["file", "block"])
    return met.select((F.col("row") + F.col("shift")).cast("long").alias("seq"), "value")


def log_stream(spark: SparkSession, folder: str, most_files: int | None = None) -> DataFrame:
    """(seq, value): the lines of a growing folder of log files as a stream; at most so many files a micro-batch.

    A line's place is that of its file, then its number in it: files are ordered by the number that the name of their own
    folder is (0 if it is none), then by the first number in their own names. So seq depends on nothing but the files, no line is
    joined or shuffled for it, and a restart finds the same. Files must be complete when they appear, appear in their order
    and hold some MB (100 at most, in executors that have ten times that for a task), since a file is one row until it is cut into lines. Lines of a file without a number have no seq.
    """
    reader = spark.readStream
    if most_files:
        reader = reader.option("maxFilesPerTrigger", most_files)
    path = F.col("_metadata.file_path")
    number = lambda pattern: F.regexp_extract(path, pattern, 1).try_cast("long")
    place = F.coalesce(number(r"/(\d+)/[^/]*$"), F.lit(0)) * (1 << 48) + number(r"/[^/\d]*(\d+)[^/]*$") * (1 << 32)
    files = reader.text(folder, wholetext=True, recursiveFileLookup=True).select(place.alias("place"), F.regexp_replace("value", r"\r?\n\z", "").alias("value")).where("value <> ''")
    lines = files.select("place", F.posexplode(F.split("value", r"\r?\n")).alias("nth", "value"))
    return lines.select((F.col("place") + F.col("nth") + 1).alias("seq"), "value")


def parse_commands(lines: DataFrame) -> DataFrame:
    """(seq, value) -> (seq, cmd, id, match_type, match_dist, n_declared, body, result_ids); fields that do not parse are null."""
    f = F.split(F.trim("value"), " +", 6)
    at = lambda i: F.get(f, F.lit(i))
    cmd = at(0)
    number = lambda c, t: c.try_cast(t)
    is_s, is_m, is_r = cmd == "s", cmd == "m", cmd == "r"
    rest = F.get(F.split(F.trim("value"), " +", 4), F.lit(3))
    ids = F.transform(words(rest), lambda x: x.try_cast("long"))
    return lines.select(
        "seq", cmd.alias("cmd"), number(at(1), "long").alias("id"), F.when(is_s, number(at(2), "int")).alias("match_type"), F.when(is_s, number(at(3), "int")).alias("match_dist"),
        F.when(is_s, number(at(4), "int")).when(is_m | is_r, number(at(2), "int")).alias("n_declared"), F.when(is_s, at(5)).when(is_m, rest).alias("body"), F.when(is_r, ids).alias("result_ids"))


def parse_starts(commands: DataFrame) -> DataFrame:
    return commands.where("cmd = 's'").select("seq", F.col("id").alias("query_id"), F.col("body").alias("query_str"), "match_type", "match_dist")


def parse_ends(commands: DataFrame) -> DataFrame:
    return commands.where("cmd = 'e'").select("seq", F.col("id").alias("query_id"))


def parse_documents(commands: DataFrame) -> DataFrame:
    return commands.where("cmd = 'm'").select("seq", F.col("id").alias("doc_id"), F.col("body").alias("text"))


def parse_expected(commands: DataFrame) -> DataFrame:
    return commands.where("cmd = 'r'").select("seq", F.col("id").alias("doc_id"), F.col("n_declared").alias("num_res"), F.col("result_ids").alias("query_ids"))


def first_by_seq(commands: DataFrame) -> DataFrame:
    """The earliest command of each kind and id."""
    return commands.withColumn("nth", F.row_number().over(Window.partitionBy("cmd", "id").orderBy("seq"))).where("nth = 1").drop("nth")


def unsound(empty_documents: bool = False, empty_queries: bool = False) -> Column:
    """Why a command is no sound one by itself, null for sound ones. empty_documents: `m` commands that declare 0 words and have none are
    sound; empty_queries: such `s` commands too."""
    c, own = F.col, words(F.col("body"))
    bodiless = lambda empty: c("body").isNull() & (~c("n_declared").eqNullSafe(0) if empty else F.lit(True))
    text = c("cmd").isin("s", "m")
    return (
        F.when(c("cmd").isNull() | ~c("cmd").isin("s", "e", "m", "r"), "unknown command")
        .when(c("id").isNull() | (c("id") < 0) | ((c("cmd") == "s") & (c("match_type").isNull() | c("match_dist").isNull() | bodiless(empty_queries))) | (c("cmd").isin("m", "r") & c("n_declared").isNull()) | ((c("cmd") == "m") & bodiless(empty_documents)), "too few fields")
        .when((c("cmd") == "s") & ~c("match_type").between(0, 2), "match type")
        .when((c("cmd") == "s") & (~c("match_dist").between(0, MOST_DISTANCE) | ((c("match_type") == 0) & (c("match_dist") != 0))), "distance")
        .when(text & (~c("body").rlike("[a-z]") | c("body").rlike("[^a-z ]")), "characters")
        .when((c("cmd") == "s") & (F.size(own) > MOST_WORDS), "too many words")
        .when((c("cmd") == "m") & (F.length("body") > MOST_CHARS), "too long")
        .when(text & F.exists(own, lambda w: ~F.length(w).between(SHORTEST, LONGEST)), "word length")
        .when((c("cmd") == "r") & ((F.size("result_ids") != c("n_declared")) | F.exists("result_ids", lambda x: x.isNull())), "result count"))


def with_reasons(commands: DataFrame, empty: bool = False) -> DataFrame:
    """commands with a column `reason`, null for good ones. The first of several commands of one kind and id is good, of those that
    also share their seq one. empty: documents and queries that declare 0 words and have none are sound."""
    c = F.col
    # Judged and numbered once, then read from files: what finds the first commands and what looks them up see the same numbers.
    judged = stored(commands.withColumn("reason", unsound(empty, empty)).withColumn("row", F.monotonically_increasing_id()), "judged")
    place = F.struct("seq", "row")
    # Only sound commands compete for an id; few ids have several, so a command is looked up among those.
    twice = judged.where(c("reason").isNull() & c("cmd").isin("s", "m", "r")).groupBy("cmd", "id").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    # Bad commands, many of them perhaps without an id, are spread over ids that no sound one has.
    judged = judged.withColumn("sound_id", F.when(c("reason").isNull(), c("id")).otherwise(-1 - F.pmod("seq", F.lit(1000))))
    later = judged.join(twice.withColumnRenamed("id", "sound_id"), ["cmd", "sound_id"], "left").withColumn("reason", F.coalesce("reason", F.when(place > c("first"), F.lit("id used before"))))
    return later.select(*commands.columns, "reason")


def validate_commands(commands: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good commands, bad commands with the reason)."""
    judged = with_reasons(commands)
    return judged.where("reason is null").drop("reason"), judged.where("reason is not null")


def _line() -> Column:
    """A result as an `r` line."""
    return F.concat_ws(" ", F.lit("r"), F.col("doc_id").cast("string"), F.col("num_res").cast("string"), F.transform("query_ids", lambda x: x.cast("string"))).alias("value")


def result_lines(results: DataFrame) -> DataFrame:
    """The `r` line of each result."""
    return results.select("doc_id", _line())


def write_results(results: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Parquet of (doc_id, num_res, query_ids), or text of `r` lines."""
    if fmt == "text":
        result_lines(results).select("value").write.text(path)
    else:
        results.write.format(fmt).save(path)


#: Rows of a file of write_in_order().
FILE_ROWS = 1_000_000


def write_in_order(results: DataFrame, path: str, rows: int = FILE_ROWS) -> None:
    """Writes the `r` lines of results (doc_id, seq, num_res, query_ids) in the order of seq, then doc_id.

    Files are ranges of seq of about `rows` lines each, sorted within and named in order, so that they read in arrival
    order one behind another; no task sees more than a range. Results without a seq come first.
    """
    keys = [F.col("seq").asc_nulls_first(), F.col("doc_id").asc_nulls_first()]
    files = max(1, -(-results.count() // rows))
    ranged = results.repartitionByRange(files, *keys).sortWithinPartitions(*keys)
    ranged.select(_line()).write.mode("overwrite").text(path)
