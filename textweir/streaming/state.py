"""Commands as keyed state: which came first of its kind and id, and from when to when a query lived."""

from __future__ import annotations

import os
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: What judged_stream() gives: the command with `start_seq`, which an end has of its query, and `reason`, null for good ones.
JUDGED = "seq long, cmd string, id long, match_type int, match_dist int, n_declared int, body string, result_ids array<long>, reason string, start_seq long"
_NAMES = [f.split()[0] for f in JUDGED.split(", ")]
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Keys that commands without a sound id are spread over; they have no state.
_LOOSE = 1000


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB, on disk; the session's own setting is put back at the end."""
    before = spark.conf.get(_PROVIDER, None)
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment  # the workers load the processor from this package
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (env.get("PYTHONPATH"), root) if x)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)


class Lives(StatefulProcessor):
    """One key's commands of a micro-batch, in order of seq, against when the id was first used and when its query ended.

    The first sound start, document or expected result of an id is good, a later one is not. The first end behind a start is put
    out with that start's seq; other ends change nothing and are left out. Per id two numbers are kept for good, since ids are not
    used again.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.life = handle.getValueState("life", "start_seq long, end_seq long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        if key[0] == "loose":
            yield from (self._out(r, r.reason, None) for r in rows)
            return
        begin, end = self.life.get() if self.life.exists() else (None, None)
        had = begin, end
        for r in sorted(rows, key=lambda r: r.seq):
            if r.cmd == "e":
                if begin is not None and end is None and r.seq > begin:
                    end = r.seq
                    yield self._out(r, None, begin)
            elif begin is None:
                begin = r.seq
                yield self._out(r, None, None)
            else:
                yield self._out(r, "id used before", None)
        if (begin, end) != had:
            self.life.update((begin, end))

    def close(self) -> None:
        pass

    @staticmethod
    def _out(r: Row, reason: str | None, start: int | None) -> Row:
        return Row(**{n: r[n] for n in _NAMES[:8]}, reason=reason, start_seq=start)


def judged_stream(commands: DataFrame, reason: Column) -> DataFrame:
    """A stream of commands -> JUDGED, by `reason` (null for commands that are sound by themselves) and the state of their ids.

    Within a micro-batch commands go by seq. Each micro-batch reads and writes the state of the ids in it and of no others.
    """
    sound = F.col("reason").isNull()
    kind = F.when(~sound, "loose").when(F.col("cmd").isin("s", "e"), "query").otherwise(F.col("cmd"))
    of = F.when(sound, F.col("id")).otherwise(F.pmod(F.coalesce("seq", F.lit(0)), F.lit(_LOOSE)))
    reason = F.coalesce(reason, F.when(F.col("seq").isNull(), "no place in the log"))
    keyed = commands.withColumn("reason", reason).select(*_NAMES[:9], kind.alias("kind"), of.alias("of"))
    return keyed.groupBy("kind", "of").transformWithState(Lives(), JUDGED, "Append", "None")
