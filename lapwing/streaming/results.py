"""A live feed of results with its state in the stream's state store.

Each participant of an event of a meet has one result in the store. A final row overrides any live one, else the newer row wins, ties to the larger number; so the state is the same whether batches
come late, twice or in another order. A micro-batch writes only what it changed, into a folder of its own that a batch that runs again writes anew; what is current is read from those.

Changed rows get their athlete: an entry of that meet and event with the same name, or with a name that holds it or is held by it; finals without one get the person whom ``fuzzy.match_people`` is
surer of than 0.8.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from lapwing.operators import fuzzy

C = F.col
KEYS = ["meet", "event", "participant"]
FIELDS = ["team", "mark", "place", "final", "at", "seq"]
STATE = "team string, mark string, place int, final boolean, at timestamp, seq long"
CHANGES = f"meet string, event string, participant string, {STATE}, change string"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SURE = 0.8
POLL_SECONDS, FAST_SECONDS, MOST_SECONDS = 30, 15, 4 * 3600


def _plain(x):
    """A pandas value as Python has it, None for missing."""
    if x is None or x is pd.NaT or x != x:
        return None
    return x.to_pydatetime() if isinstance(x, pd.Timestamp) else x.item() if hasattr(x, "item") else x


def newest(rows: Iterator[tuple]) -> tuple:
    """Of rows in the order of FIELDS: a final one before others, then the latest by at and seq; rows without a time are older than others."""
    def rank(r: tuple):
        return (bool(r[3]), r[4] is not None, r[4].timestamp() if r[4] is not None else 0.0, r[5] if r[5] is not None else -1)

    return max(rows, key=rank)


class Latest(StatefulProcessor):
    """Keeps the newest row of each key and tells what became of it: new, updated, unchanged (same mark, place and standing) or late (the state is newer)."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("newest", STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        old = tuple(self.held.get()) if self.held.exists() else None
        best = old
        for chunk in rows:
            each = (tuple(_plain(x) for x in r) for r in chunk[FIELDS].itertuples(index=False))
            top = newest(each)
            best = top if best is None else newest(iter((best, top)))
        if old is None:
            change = "new"
        elif best == old:
            change = "late"
        else:
            change = "unchanged" if old[1:4] == best[1:4] else "updated"
        if change != "late":
            self.held.update(best)
        yield pd.DataFrame([(*key, *best, change)], columns=[*KEYS, *FIELDS, "change"])

    def close(self) -> None:
        pass


def changes(feed: DataFrame) -> DataFrame:
    """CHANGES of a streaming feed of KEYS and FIELDS: a row for each key that a micro-batch holds. Rows without meet, event or participant are left out."""
    whole = feed.select(*[C(k).cast("string").alias(k) for k in KEYS], "team", "mark", C("place").cast("int").alias("place"), F.coalesce("final", F.lit(False)).alias("final"), "at", C("seq").cast("long").alias("seq")).dropna(subset=KEYS)
    return whole.groupBy(*KEYS).transformWithStateInPandas(Latest(), CHANGES, "Update", "None")


def with_athletes(rows: DataFrame, entries: DataFrame | None, people: DataFrame | None) -> DataFrame:
    """rows with entry_id and athlete_id. entries: meet, event, entry_id, athlete_id, name; people: person_id, full_name, school."""
    out = rows.withColumn("entry_id", F.lit(None).cast("long")).withColumn("athlete_id", F.lit(None).cast("long"))
    if entries is not None:
        known = entries.select(C("meet").cast("string").alias("meet"), C("event").cast("string").alias("event"), C("entry_id").alias("e"), C("athlete_id").alias("a"), fuzzy.name_key(C("name")).alias("known"))
        met = rows.select(*KEYS, fuzzy.name_key(C("participant")).alias("key")).join(known, ["meet", "event"]).where((C("key") == C("known")) | C("known").contains(C("key")) | C("key").contains(C("known")))
        first = met.groupBy(*KEYS).agg(F.min(F.struct("e", "a")).alias("m")).select(*KEYS, C("m.e").alias("entry_id"), C("m.a").alias("athlete_id"))
        out = rows.join(first, KEYS, "left")
    if people is not None:
        open_ = out.where("final AND athlete_id IS NULL").select(F.struct(*KEYS).alias("entry_id"), C("participant").alias("name"), "team")
        found = fuzzy.match_people(open_, people, accept=SURE).select(*[C(f"entry_id.{k}").alias(k) for k in KEYS], C("person_id").cast("long").alias("person_id"))
        out = out.join(found, KEYS, "left").withColumn("athlete_id", F.coalesce("athlete_id", "person_id")).drop("person_id")
    return out


def follow(feed: DataFrame, folder: str, *, entries: DataFrame | None = None, people: DataFrame | None = None, every: int | None = POLL_SECONDS) -> StreamingQuery:
    """Starts the stream. Every so many seconds it takes what has come in; with None it takes what is there now and stops. folder, shared by the cluster, holds its progress and changes."""
    feed.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)

    def write(batch: DataFrame, n: int) -> None:
        changed = batch.where(C("change").isin("new", "updated"))
        with_athletes(changed, entries, people).write.mode("overwrite").parquet(f"{folder}/changes/batch={n}")

    started = changes(feed).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{folder}/progress")
    return (started.trigger(availableNow=True) if every is None else started.trigger(processingTime=f"{every} seconds")).start()


def follow_for(feed: DataFrame, folder: str, *, most: float = MOST_SECONDS, **options) -> StreamingQuery:
    """follow, ended after so many seconds, four hours if not said otherwise. What came in and was not taken is taken when it is started again."""
    query = follow(feed, folder, **options)
    if not query.awaitTermination(most):
        query.stop()
    return query


def current(spark: SparkSession, folder: str) -> DataFrame:
    """The results as they stand: of each key the row of the last batch that changed it."""
    rows = spark.read.option("basePath", f"{folder}/changes").parquet(f"{folder}/changes/batch=*")
    fields = [c for c in rows.columns if c not in (*KEYS, "batch", "change")]
    return rows.groupBy(*KEYS).agg(F.max_by(F.struct(*fields), "batch").alias("r")).select(*KEYS, "r.*")
