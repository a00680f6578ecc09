"""Change feeds as Structured Streaming jobs.

States are logs of deltas: a batch writes the rows that it changed, whatever has been kept before, as one folder that a
batch run again writes again. From time to time a batch also folds the log into a new base; readers merge the last base
with the deltas after it. Rows keep the order of the change that they come from, and what was deleted stays as a row marked
`_gone` for a while, so that a change that comes late never undoes a newer one.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Batches after which the log is folded.
EVERY = 16
#: How long a deletion is remembered, by the time of the change.
REMEMBERED = "30 days"

Resolve = Callable[[DataFrame], DataFrame]


def read_events(spark, path: str) -> DataFrame:
    """The events table as a file stream; its times become instants, as watermarks need."""
    schema = spark.read.parquet(f"{path}/events.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{path}/events*.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def _parts(spark, path: str) -> tuple[int | None, list[int]]:
    """The last whole base of a log, and the deltas after it."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath() for s in fs.listStatus(hadoop)] if fs.exists(hadoop) else []
    whole = []
    for n in names:
        kind, eq, number = n.getName().partition("=")
        if eq and fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(n, "_SUCCESS")):
            whole.append((kind, eq, number))
    base = max((int(n) for kind, _, n in whole if kind == "base"), default=None)
    return base, sorted(int(n) for kind, _, n in whole if kind == "delta" and (base is None or int(n) > base))


def _log(spark, path: str, until: int | None = None) -> DataFrame | None:
    """All rows of the last base and the deltas after it, up to batch `until`; None where there is nothing."""
    base, deltas = _parts(spark, path)
    folders = [f"{path}/base={base}"] if base is not None else []
    folders += [f"{path}/delta={n}" for n in deltas if until is None or n <= until]
    out = None
    for f in folders:
        out = spark.read.parquet(f) if out is None else out.unionByName(spark.read.parquet(f))
    return out


def latest_state(spark, path: str, resolve: Resolve) -> DataFrame:
    """The state that a log says, without what was deleted."""
    rows = _log(spark, path)
    if rows is None:
        raise ValueError(f"no batch has been written below {path}")
    state = resolve(rows)
    return state.filter("not _gone").drop("_gone") if "_gone" in state.columns else state


def _drop(spark, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def _keep(stream: DataFrame, path: str, checkpoint: str, change: Resolve, resolve: Resolve, clock: str | None = None, every: int = EVERY, remembered: str = REMEMBERED) -> StreamingQuery:
    """A log below `path`: of each batch what change(batch) makes of it, already resolved within the batch. In every
    `every`th batch the log is folded; deletions whose `clock` is older than `remembered` before the newest are let go
    then, and the folders that the base before the last covers are removed."""

    def one(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        resolve(change(batch)).write.mode("overwrite").parquet(f"{path}/delta={n}")
        if n % every == every - 1:
            state = resolve(_log(spark, path, n))
            if clock and "_gone" in state.columns:
                newest = F.lit(state.agg(F.max(clock)).first()[0])
                state = state.filter(~F.col("_gone") | (F.col(clock) >= newest - F.expr(f"INTERVAL {remembered}")))
            state.write.mode("overwrite").parquet(f"{path}/base={n}")
            # A reader may still use the base before and the deltas after that.
            _drop(spark, f"{path}/base={n - 2 * every}")
            for old in range(max(0, n - 2 * every + 1), n - every + 1):
                _drop(spark, f"{path}/delta={old}")

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def newest(keys: list[str], order: list[str]) -> Resolve:
    """Of each key the row that is last by `order`."""

    def resolve(rows: DataFrame) -> DataFrame:
        last = F.max_by(F.struct(*rows.columns), F.struct(*order)).alias("r")
        return rows.groupBy(*(F.col(k).alias(f"_{k}") for k in keys)).agg(last).select("r.*")

    return resolve


def apply_change_feed(stream: DataFrame, path: str, checkpoint: str, keys: list[str], order: list[str], delete, columns: list[str], **options) -> StreamingQuery:
    """Keeps a keyed snapshot: of all changes of a key so far, whatever their batch, the last by `order` wins; where
    `delete` holds for it, the key goes. `order` begins with the time of the change and tells any two changes of a key
    apart; `columns` holds it and the keys. Read it by latest_state(spark, path, newest(keys, order))."""
    change = lambda batch: batch.withColumn("_gone", F.coalesce(delete, F.lit(False))).select(*columns, "_gone")
    return _keep(stream, path, checkpoint, change, newest(keys, order), order[0], **options)


_PLACE, _SIGN = ["document_id", "user_id"], ["ts", "event_id"]


def presence(stream: DataFrame, path: str, checkpoint: str, **options) -> StreamingQuery:
    """Who is where: the last sign of a user in each document, closed on leaving."""
    return apply_change_feed(stream, path, checkpoint, _PLACE, _SIGN, F.col("event_type") == "error", [*_PLACE, *_SIGN], **options)


def present(spark, path: str) -> DataFrame:
    return latest_state(spark, path, newest(_PLACE, _SIGN))


def still_present(state: DataFrame, now, ttl: str) -> DataFrame:
    """Rows of present() that gave a sign within `ttl` (an interval such as "30 seconds") before `now`."""
    return state.filter(F.col("ts") >= now - F.expr(f"INTERVAL {ttl}"))


def visits(stream: DataFrame, path: str, checkpoint: str, ttl_seconds: int = 1800, late: str = "1 minute") -> StreamingQuery:
    """A row for every visit of a user to a document, written once it has ended: by leaving, or by `ttl_seconds` without a
    sign, which needs no further event of that user. State ends with the visit. Signs later than `late` may be passed over."""
    ttl = ttl_seconds * 1000

    def follow(key, batches, state: GroupState):
        """The state is (first event, opened, last sign, signs) of the open visit."""
        visit = list(state.get) if state.exists else None
        done = []

        def close(why: str):
            nonlocal visit
            done.append((*key, visit[0], visit[3], why))
            visit = None

        if state.hasTimedOut:
            close("silence")
        else:
            for x in pd.concat(list(batches)).sort_values(["ms", "event_id"]).itertuples():
                if visit and x.ms > visit[2] + ttl:
                    close("silence")
                visit = [x.event_id, x.ms, x.ms, 1] if visit is None else [visit[0], visit[1], max(visit[2], x.ms), visit[3] + 1]
                if x.event_type == "error":
                    close("left")
            if visit and visit[2] + ttl <= state.getCurrentWatermarkMs():
                close("silence")
        if visit is None:
            if state.exists:
                state.remove()
        else:
            state.update(tuple(int(v) for v in visit))
            state.setTimeoutTimestamp(int(visit[2] + ttl))
        yield pd.DataFrame(done, columns=["document_id", "user_id", "event_id", "signs", "ended_by"])

    signs = stream.withWatermark("ts", late).select("document_id", "user_id", "event_id", "event_type", F.unix_millis("ts").alias("ms"), "ts")
    kinds = "document_id long, user_id long, event_id long, signs long, ended_by string"
    out = signs.groupBy("document_id", "user_id").applyInPandasWithState(follow, kinds, "event_id long, opened long, last long, signs long", "append", GroupStateTimeout.EventTimeTimeout)
    return _to_files(out, path, checkpoint)


def last_n(by: str, order: list[str], n: int) -> Resolve:
    """Of each `by` the n rows that are last by `order`, repeated ones once."""
    w = Window.partitionBy(by).orderBy(*(F.desc(o) for o in order))
    return lambda rows: rows.dropDuplicates([by, *order]).withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n).drop("_n")


def activity_stream(stream: DataFrame, path: str, checkpoint: str, n: int = 30, **options) -> StreamingQuery:
    """The latest n events of each document; read by recent(spark, path, n)."""
    change = lambda batch: batch.select("event_id", "user_id", "ts", "event_type")
    return _keep(stream, path, checkpoint, change, last_n("user_id", _SIGN, n), **options)


def recent(spark, path: str, n: int = 30) -> DataFrame:
    return latest_state(spark, path, last_n("user_id", _SIGN, n))


def _last_edit(rows: DataFrame) -> DataFrame:
    """The words of each section's last edit; an edit that is in the log twice has the same words."""
    last = rows.groupBy("section_id").agg(F.max(F.struct(*_SIGN)).alias("_last"))
    held = rows.join(last, "section_id").filter(F.struct(*_SIGN) == F.col("_last")).drop("_last")
    return held.dropDuplicates(["section_id", "term"])


def incremental_index(stream: DataFrame, path: str, checkpoint: str, **options) -> StreamingQuery:
    """An index that follows edits: a document's words are those of its last edit by time, whatever its batch. A document
    whose last edit has no word keeps one row marked `_gone`. Read by indexed(spark, path)."""

    def change(batch: DataFrame) -> DataFrame:
        last = batch.groupBy(F.col("user_id").alias("section_id")).agg(F.max(F.struct("ts", "event_id", "event_type", "props")).alias("x"))
        found = F.regexp_extract_all(F.concat_ws(" ", "x.event_type", "x.props"), F.lit("[a-z0-9]+"), 0)
        words = last.select("section_id", "x.ts", "x.event_id", F.explode_outer(found).alias("term"))
        return words.groupBy("section_id", "ts", "event_id", "term").agg(F.count("term").alias("tf")).withColumn("_gone", F.col("term").isNull())

    return _keep(stream, path, checkpoint, change, _last_edit, "ts", **options)


def indexed(spark, path: str) -> DataFrame:
    return latest_state(spark, path, _last_edit)


def _to_files(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def snapshot_plus_increments(stream: DataFrame, visible: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Each subscriber's changes: the stream joined with what the subscriber may see (subscriber, user_id)."""
    return _to_files(stream.join(visible, "user_id").select("subscriber", "user_id", "event_id", "event_type"), path, checkpoint)


def cache_invalidation_keys(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """The distinct tags that publishing touches: a global one and each document's."""
    tags = stream.filter("event_type = 'purchase'").select(F.explode(F.array(F.lit("published"), F.concat(F.lit("document-"), F.col("user_id").cast("string")))).alias("tag"))
    return _to_files(tags.dropDuplicates(["tag"]), path, checkpoint)


def debounce(stream: DataFrame, path: str, checkpoint: str, quiet: str = "10 minutes", late: str = "1 minute") -> StreamingQuery:
    """The last state of each run of edits, once it has been quiet for so long; events later than `late` are dropped."""
    s = stream.withWatermark("ts", late).groupBy(F.session_window("ts", quiet).alias("w"), "user_id")
    last = s.agg(F.max(F.struct("ts", "event_id")).alias("x"), F.count("*").alias("edits"))
    return _to_files(last.select("user_id", F.col("x.event_id").alias("event_id"), "edits"), path, checkpoint)


def fold_edits(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """What a room's edits write to the rows of their sections: (section_id, event_id, outcome, content).

    stream: (section_id, event_id, ts, moved, content). An event with `moved` says that somebody else gave the row this
    content at this time; the others are edits in the room. An edit that equals the row writes nothing. If the row is not
    at the time at which the room last saw it, the row wins: the outcome "row" returns its content to the room, which has
    seen it then. Otherwise the edit is written. What is older than the row's clock comes too late and changes nothing.
    State is one content, the row's clock and the clock last seen for each section; of one batch, a section's events are
    put in order in memory, so maxFilesPerTrigger bounds them."""

    def fold(key, batches, state: GroupState):
        content, at, seen = state.get if state.exists else (None, None, None)
        out = []
        for x in pd.concat(list(batches)).sort_values(["us", "event_id"]).itertuples():
            if at is not None and x.us < at:
                continue
            if x.moved:
                content, at = x.content, x.us
            elif x.content == content:
                seen = at
            elif seen != at:
                seen = at
                out.append((*key, x.event_id, "row", content))
            else:
                content, at, seen = x.content, x.us, x.us
                out.append((*key, x.event_id, "written", content))
        state.update((content, at, seen))
        yield pd.DataFrame(out, columns=["section_id", "event_id", "outcome", "content"])

    edits = stream.select("section_id", "event_id", "moved", "content", F.unix_micros("ts").alias("us")).groupBy("section_id")
    out = edits.applyInPandasWithState(fold, "section_id long, event_id long, outcome string, content string", "content string, at long, seen long", "append", GroupStateTimeout.NoTimeout)
    return _to_files(out, path, checkpoint)
