"""Features of an event stream, exactly those of the whole history.

Each micro-batch is joined with the rows held back before. All but the newest timestamp is closed: its features are taken
from the state, and the state advances to the newest timestamp, whose rows are held back, as a later batch may bring more
of them. A row at or before a closed timestamp raises; it is never dropped. ``flush`` closes the rest.

A batch commits by renaming one folder that has what the state gains, the rows held back and the number of the batch; output
is written before it, in a folder of the batch that a repeat overwrites, so each event's features appear once. What the
state gains is the sums of the events that the batch closed; the state is the last whole one with the gains since. Every
``COMPACT`` commits a whole one is written, so a batch writes as much as it closes, and a load reads a bounded number of
folders.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.publish import Files, to_json, write_parquet
from ..state.checkpoints import EVENT, bridge_of
from ..state.tables import NAMES, OLD, State, advance, build, suffix_features

#: Commits from one whole state to the next.
COMPACT = 16
SCHEMA = "event_id long, user_id long, item_id long, rating double, event_us long"


class LateData(ValueError):
    """A row isn't after the closed timestamps."""


class StreamReplay:
    def __init__(self, spark: SparkSession, root: str, catalog: DataFrame):
        self.spark, self.root, self.catalog = spark, root, catalog
        self.files = Files(spark, root)

    def versions(self) -> list[str]:
        return [n for n in self.files.names(f"{self.root}/commits") if n.startswith("v")]

    def _load(self) -> tuple[State, DataFrame, int]:
        empty = self.spark.createDataFrame([], SCHEMA)
        if not (known := self.versions()):
            return build(empty, bridge_of(self.catalog), OLD), empty, -1
        side = json.loads(self.files.read(f"{self.root}/commits/{known[-1]}/commit.json"))
        since = [f"{self.root}/commits/{v}" for v in known[side["whole"] :]]
        # rows of gains are left as they are: features and sums of states count weighted events, summed up or not
        tables = [self.spark.read.parquet(*[f"{p}/{n}" for p in since]) for n in NAMES]
        state = State(side["cutoff_us"], side["count"], side["total"], *tables)
        return state, self.spark.read.schema(SCHEMA).parquet(f"{since[-1]}/held"), side["batch"]

    def _commit(self, state: State, closed: DataFrame, cutoff_us: int, held: DataFrame, batch: int) -> None:
        """Adds ``closed``, the events from the state's cutoff to the new one, to the state."""
        known = self.versions()
        number = len(known)
        whole = json.loads(self.files.read(f"{self.root}/commits/{known[-1]}/commit.json"))["whole"] if known else 0
        new = advance(state, closed, bridge_of(self.catalog), cutoff_us)
        if number - whole >= COMPACT or not known:
            whole, tables = number, new
        else:
            tables = build(closed, bridge_of(self.catalog), cutoff_us)
        stage, path = f"{self.root}/commits/.stage-{number:09d}", f"{self.root}/commits/v{number:09d}"
        self.files.delete(stage)
        for n in NAMES:
            write_parquet(getattr(tables, n), f"{stage}/{n}")
        write_parquet(held, f"{stage}/held")
        self.files.write(f"{stage}/commit.json", to_json({"cutoff_us": cutoff_us, "count": new.count, "total": new.total, "batch": batch, "whole": whole}))
        self.files.rename(stage, path)

    def process(self, rows: DataFrame, batch: int) -> None:
        """One micro-batch; a batch that is committed already changes nothing."""
        state, held, done = self._load()
        if batch <= done:
            return
        rows = rows.select(*EVENT)
        low, high = rows.agg(F.min("event_us"), F.max("event_us")).first()
        if high is None:
            return
        if low < state.cutoff_us:
            raise LateData(f"a row at {low} comes after {state.cutoff_us} was closed")
        waiting = held.unionByName(rows)
        if not waiting.groupBy("event_id").count().where("count > 1").isEmpty():
            raise ValueError("event ids repeat")
        cut = max(high, held.agg(F.max("event_us")).first()[0] or high)
        closed = waiting.where(F.col("event_us") < cut)
        self._emit(state, closed, f"b{batch:09d}")
        self._commit(state, closed, cut, waiting.where(F.col("event_us") >= cut), batch)

    def _emit(self, state: State, closed: DataFrame, name: str) -> None:
        write_parquet(suffix_features(state, closed, self.catalog), f"{self.root}/features/{name}", "overwrite", "zstd")

    def flush(self) -> None:
        """Closes the newest timestamp."""
        state, held, done = self._load()
        last = held.agg(F.max("event_us")).first()[0]
        if last is None:
            return
        self._emit(state, held, f"f{len(self.versions()):09d}")
        self._commit(state, held, last + 1, held.limit(0), done)

    def features(self) -> DataFrame:
        names = self.files.names(f"{self.root}/features")
        return self.spark.read.parquet(*[f"{self.root}/features/{n}" for n in names])

    def run(self, source: str, files_a_batch: int | None = 1, flush: bool = True) -> None:
        """Reads the Parquet files of ``source`` that are new to the stream until none is left, oldest first, then flushes.

        Without ``files_a_batch``, all that are there are one micro-batch.
        """
        stream = self.spark.readStream.schema(SCHEMA)
        if files_a_batch:
            stream = stream.option("maxFilesPerTrigger", files_a_batch)
        q = stream.parquet(source).writeStream.foreachBatch(self.process).option("checkpointLocation", f"{self.root}/stream").trigger(availableNow=True).start()
        q.awaitTermination()
        if flush:
            self.flush()
