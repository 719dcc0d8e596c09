"""Change feeds: file events to the index, retries with state, hand-over to an outside index, worker control."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.text import extension
from ..operators.index import DOCS, PAGE_CHARS, apply_changes, build, fixed_pages, pointer
from ..operators.ingest import MAX_ATTEMPTS

DONATION_LIMIT, LATENCY = 5000, "3 seconds"
EVENTS = "event_id long, path string, doc_id long, text string, full_rescan boolean"


def change_stream(spark: SparkSession, folder: str, schema: str = EVENTS) -> DataFrame:
    """File events as they arrive in a folder; the checkpoint keeps the place."""
    return spark.readStream.schema(schema).json(folder)


def index_changes(changes: DataFrame, folder: str, checkpoint: str, rescan: Callable[[SparkSession], None] | None = None, latency: str | None = LATENCY) -> StreamingQuery:
    """Brings each batch's documents into the index under folder, as a segment of their own.

    The last event of a document counts; one without a text removes the document. A batch may come twice: the index
    remembers the last one's number. An event that says that history was lost calls rescan. A folder without an index
    gets an empty one first.
    """

    def apply(batch: DataFrame, number: int) -> None:
        batch.persist()  # read from the source once
        try:
            bring(batch, number)
        finally:
            batch.unpersist()

    def bring(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if rescan is not None and not batch.where("full_rescan").isEmpty():
            rescan(spark)
        if pointer(spark, folder) is None:
            none = lambda schema: spark.createDataFrame([], schema)
            build(spark, folder, none(DOCS), none("doc_id long, page int, body string"), none("doc_id long, page int, src int, conf double"))
        last = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("event_id")))
        new = batch.where("doc_id is not null").withColumn("k", last).where("k = 1")
        there, path = new.where("text is not null"), F.col("path")
        docs = there.select(
            F.col("doc_id").alias("id"), path.alias("rel_path"), extension(path).alias("ext"), F.split(path, "/")[0].alias("top_folder"), F.octet_length("text").cast("long").alias("size"),
            F.greatest(F.lit(1), F.ceil(F.length("text") / PAGE_CHARS)).cast("int").alias("n_pages"), F.lit(1).alias("state"),
        )
        apply_changes(spark, folder, docs, fixed_pages(there), spark.createDataFrame([], "doc_id long, page int, src int, conf double"), new.where("text is null").select("doc_id"), number)

    stream = changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (stream.trigger(processingTime=latency) if latency else stream.trigger(availableNow=True)).start()


def retries(results: DataFrame) -> DataFrame:
    """(doc_id, page, attempts, status) of a stream of (doc_id, page, ok): done, retry, or dropped at the third failure."""

    def step(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        attempts = state.get[0] if state.exists else 0
        status = "retry"
        for batch in rows:
            for ok in batch["ok"]:
                if status == "done":
                    continue
                if ok:
                    status = "done"
                else:
                    attempts += 1
        if status != "done" and attempts >= MAX_ATTEMPTS:
            status = "dropped"
        if status == "retry":
            state.update((attempts,))
        elif state.exists:
            state.remove()
        yield pd.DataFrame([(*key, attempts, status)], columns=["doc_id", "page", "attempts", "status"])

    return results.groupBy("doc_id", "page").applyInPandasWithState(step, "doc_id long, page int, attempts int, status string", "attempts int", "update", GroupStateTimeout.NoTimeout)


def donation(docs: DataFrame, synced_at: float, limit: int = DONATION_LIMIT, after: int | None = None) -> DataFrame:
    """The next documents to hand over: indexed at the mark or later, oldest first, then by id. Mark 0 hands over all of
    them. after: of those indexed at the mark itself only the ids beyond this one."""
    later = F.col("indexed_at") >= synced_at if after is None else (F.col("indexed_at") > synced_at) | ((F.col("indexed_at") == synced_at) & (F.col("id") > after))
    return docs.where(later).orderBy("indexed_at", "id").limit(limit)


def next_mark(handed_over: DataFrame, now: float, limit: int = DONATION_LIMIT) -> tuple[float, int | None]:
    """(time, id) to go on from: now and none where the batch was the last, else those of the last document handed over."""
    seen = handed_over.agg(F.count("*").alias("n"), F.max(F.struct("indexed_at", "id")).alias("last")).first()
    return (now, None) if seen.n < limit else (seen.last.indexed_at, seen.last.id)


def workers(samples: DataFrame, machine: str, at: str, level: str, most: int = 4) -> DataFrame:
    """samples with `workers`: none after two samples below 50, two below 70, else all."""
    before = F.lag(level).over(Window.partitionBy(machine).orderBy(at))
    idle = (F.col(level) < 50) & (F.coalesce(before, F.lit(100)) < 50)
    return samples.withColumn("workers", F.when(idle, 0).when(F.col(level) < 70, 2).otherwise(most))


class StatusListener(StreamingQueryListener):
    """Keeps the last progress of each stream, and hands it to `tell`: a name, a time, rows in a batch, rows a second."""

    def __init__(self, tell: Callable[[dict], None] | None = None) -> None:
        self.tell, self.last = tell, {}

    def onQueryStarted(self, event) -> None:
        self._keep({"name": event.name or str(event.id), "state": "started", "rows": 0})

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self._keep({"name": p.name or str(p.id), "state": "running", "rows": p.numInputRows, "batch": p.batchId, "at": p.timestamp})

    def onQueryIdle(self, event) -> None:
        self._keep({"name": str(event.id), "state": "idle", "rows": 0, "at": event.timestamp})

    def onQueryTerminated(self, event) -> None:
        self._keep({"name": str(event.id), "state": "failed" if event.exception else "ended", "rows": 0})

    def _keep(self, status: dict) -> None:
        self.last[status["name"]] = status
        if self.tell is not None:
            self.tell(status)


def next_action(pending_roots: int, queued: int, blockers: list[str], now: float, last_poll: float, poll: float = 60.0) -> str:
    """What the agent does next: index pending roots, then read queued pages unless something blocks, else wait."""
    if pending_roots:
        return "index"
    if queued and not blockers:
        return "read"
    if queued:
        return "blocked:" + blockers[0]
    return "poll" if now - last_poll >= poll else "idle"


def windowed_counts(events: DataFrame, time: str = "ts", size: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """An extension: counts by window and type of an event stream, late events dropped."""
    return events.withWatermark(time, late).groupBy(F.window(time, size), "event_type").agg(F.count("*").alias("n"))
