"""The same logic over growing logs, with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..functions.columns import is_hit, to_affinity
from ..operators.selection import history_tail
from ..operators.similarity import filter_novel
from ..operators.windows import top_per_key
from ..runtime import as_list, attach, fresh_dir, sort_names, with_field
from ..sources.files import molecules_of, parse_telemetry


def drain(stream: DataFrame, mode: str = "append", keys=(), path: str | None = None) -> DataFrame:
    """Run a stream over everything available and return its result as a table.

    Every micro-batch owns one folder, so a batch that is run again after a failure replaces itself.
    complete: the last batch counts. update: the last row per key counts. append: all rows count.
    """
    spark = stream.sparkSession
    root = path or fresh_dir(spark, "stream")

    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/out/batch={number}")

    (stream.writeStream.outputMode(mode).foreachBatch(store)
     .option("checkpointLocation", f"{root}/progress").trigger(availableNow=True).start().awaitTermination())
    rows = spark.read.schema(with_field(stream.schema, "batch", "long")).parquet(f"{root}/out")
    if mode == "complete":
        return rows.filter(F.col("batch") == rows.agg(F.max("batch")).first()[0]).drop("batch")
    if mode == "update":
        return top_per_key(rows, list(keys), ["batch desc"], 1).drop("batch")
    return rows.drop("batch")


def stream_history(events: DataFrame, ts: str, score: str, target: str, bucket: str = "5 minutes",
                   late: str = "2 hours") -> DataFrame:
    """Best score per time bucket (update mode), with the newest event in it.

    The state of a bucket goes once the watermark, `late` behind the newest event, has passed it; rows older than that are dropped.
    """
    best = F.max_by(F.struct(F.coalesce(target, F.lit("?")).alias("target"), F.col(score).alias("score")),
                    F.struct(F.col(score), -F.unix_micros(ts)))
    return (events.filter(F.col(score).isNotNull()).withWatermark(ts, late)
            .groupBy(F.window(ts, bucket)).agg(best.alias("b"), F.max(ts).alias("newest"))
            .select(F.col("window.start").alias("bucket"), F.col("b.target").alias("target"),
                    F.round("b.score", 4).alias("best_score"), "newest"))


def recent_history(rows: DataFrame, keep: str = "2 hours", n: int = 30) -> DataFrame:
    """What is shown of the table of `stream_history`: buckets that began at most `keep` before the newest event, the newest `n`."""
    now = rows.agg(F.max("newest").alias("now"))
    young = rows.join(F.broadcast(now), F.col("bucket") >= F.col("now") - F.expr(f"INTERVAL {keep}"))
    return history_tail(young.drop("now", "newest"), "bucket", n)


def stream_dedup(events: DataFrame, key: str, ts: str | None = None, late: str | None = None) -> DataFrame:
    """First arrival per key; with a watermark a key is forgotten `late` after it came, without one the state grows for ever."""
    if ts and late:
        return events.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])
    return events.dropDuplicates([key])


def stream_counters(events: DataFrame, by, passed, accepted) -> DataFrame:
    """Running attempts, passes and acceptances per key (update mode)."""
    return events.groupBy(by).agg(F.count(F.lit(1)).alias("attempts"), F.count(F.when(passed, 1)).alias("passes"),
                                  F.count(F.when(passed & accepted, 1)).alias("accepted"))


def liveness(events: DataFrame, key: str, seconds: str, now: float, gap: float = 300.0) -> DataFrame:
    """Whether each key was heard of within `gap` seconds (batch, or a stream in update mode)."""
    return (events.groupBy(key).agg(F.max(seconds).alias("last_seen"))
            .withColumn("alive", F.lit(now) - F.col("last_seen") <= gap))


def stream_hits(events: DataFrame, dim: DataFrame, on: str, score: str, threshold: str) -> DataFrame:
    """Enrich a stream from a static dimension and flag hits."""
    joined = events.join(dim, on, "left")
    return (joined.withColumn("affinity", to_affinity(score))
            .withColumn("hit", is_hit("affinity", threshold)))


def stream_telemetry(lines: DataFrame, ts: str, line: str = "value") -> DataFrame:
    """Latest reading per device (update mode)."""
    parsed = parse_telemetry(lines, line)
    reading = F.struct(*[c for c in parsed.columns if c != "name"])
    return parsed.groupBy("name").agg(F.max_by(reading, F.col(ts)).alias("r")).select("name", "r.*")


def ingest_fragments(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """Molecule files as a stream: each landed file is read once, wherever the last run stopped."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path)
    return molecules_of(lines).select("smiles")


# --- keyed state of the engine ---------------------------------------------------------------------

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run_stateful(stream: DataFrame, path: str | None = None, mode: str = "update", each: Callable[[DataFrame, int], None] | None = None) -> DataFrame:
    """Run a stream with keyed state over everything available; all rows it put out so far, with their `batch`.

    State and progress lie under `path` in the shared folder, as the engine's own checkpoint; a later call with the same path goes on.
    `each` is called with every micro-batch.
    """
    spark = stream.sparkSession
    root, before = path or fresh_dir(spark, "stateful"), spark.conf.get(STATE_STORE, None)
    spark.conf.set(STATE_STORE, ROCKSDB)

    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/out/batch={number}")
        if each is not None:
            each(spark.read.schema(stream.schema).parquet(f"{root}/out/batch={number}"), number)
    try:
        query = (stream.writeStream.outputMode(mode).foreachBatch(store).option("checkpointLocation", f"{root}/progress")
                 .trigger(availableNow=True).start())
        query.awaitTermination()
    finally:
        spark.conf.unset(STATE_STORE) if before is None else spark.conf.set(STATE_STORE, before)
    return spark.read.schema(with_field(stream.schema, "batch", "long")).parquet(f"{root}/out")


def newest_per_key(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The rows that the last batch which touched a key put out for it."""
    last = rows.groupBy(*keys).agg(F.max("batch").alias("__last"))
    return attach(rows, last, keys).filter("batch = __last").drop("batch", "__last")


def _first_rows(pdf: pd.DataFrame, keys: list[str], order: list[str], n: int) -> pd.DataFrame:
    """The first `n` rows per key in an order such as ["score desc", "id"]; nulls come last."""
    ranked = pdf.sort_values(sort_names(order), ascending=[not o.lower().endswith(" desc") for o in order], kind="stable", na_position="last")
    return (ranked.groupby(keys, dropna=False, sort=False).head(n) if keys else ranked.head(n)).reset_index(drop=True)


class FirstN(StatefulProcessor):
    """Per key the first `n` rows in `order` of all that came, as list state; with `ttl` (milliseconds) rows expire."""

    def __init__(self, columns: list[str], kinds: str, order: list[str], n: int, ttl: int | None):
        self.columns, self.kinds, self.order, self.n, self.ttl = columns, kinds, order, n, ttl

    def init(self, handle) -> None:
        self.rows = handle.getListState("rows", self.kinds, *([self.ttl] if self.ttl else []))

    def handleInputRows(self, key, rows, timers):
        parts = list(rows)
        held = [tuple(r) for r in self.rows.get()] if self.rows.exists() else []
        old = [pd.DataFrame(held, columns=self.columns).astype(parts[0].dtypes.to_dict())] if held else []
        best = _first_rows(pd.concat(old + parts), [], self.order, self.n)
        self.rows.put([tuple(None if pd.isna(x) else x for x in r) for r in best.astype(object).itertuples(index=False, name=None)])
        yield best

    def close(self) -> None:
        pass


def _first_n(events: DataFrame, key: str, order, n: int, ttl: int | None) -> DataFrame:
    names = {c: f"c{i}" for i, c in enumerate(events.columns)}  # state is kept under plain names
    order, key = [" ".join([names[o.split()[0]], *o.split()[1:]]) for o in as_list(order)], names[key]
    plain = events.toDF(*names.values())

    def trim(parts):  # a hot key sends at most n rows a part of its micro-batch
        for pdf in parts:
            yield _first_rows(pdf, [key], order, n)
    few, kinds = plain.mapInPandas(trim, plain.schema), ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in plain.schema)
    best = few.groupBy(key).transformWithStateInPandas(FirstN(plain.columns, kinds, order, n, ttl), plain.schema, "Update", "ProcessingTime" if ttl else "None")
    return best.toDF(*events.columns)


def stream_elite(events: DataFrame, score: str, tie, n: int = 50, path: str | None = None) -> DataFrame:
    """Bounded elite pool over a stream: the best `n` scores above 0 of all that came."""
    rows = events.filter(F.col(score) > 0).withColumn("__all", F.lit(0))
    out = run_stateful(_first_n(rows, "__all", [f"{score} desc", *as_list(tie)], n, None), path)
    return newest_per_key(out, ["__all"]).drop("__all")


def stream_last_n(events: DataFrame, key: str, newest_first, n: int, path: str | None = None, ttl: int | None = None) -> DataFrame:
    """Ring buffer per key over a stream: the newest `n` rows of every key; with `ttl` (milliseconds) they expire."""
    return newest_per_key(run_stateful(_first_n(events, key, newest_first, n, ttl), path), [key])


class LastReference(StatefulProcessor):
    """Per key the last reference affinity as value state; every row gets the one at or before it."""

    def init(self, handle) -> None:
        self.last = handle.getValueState("last", "affinity double")

    def handleInputRows(self, key, rows, timers):
        pdf = pd.concat(list(rows)).sort_values("seq", kind="stable")
        known = self.last.get()[0] if self.last.exists() else None
        ref = pdf["affinity"].where(pdf["ref"].eq(True)).ffill()
        pdf["last"] = ref if known is None else ref.fillna(known)
        if pdf["last"].notna().any():
            self.last.update((float(pdf["last"].iloc[-1]),))
        yield pdf.drop(columns=["ref"])

    def close(self) -> None:
        pass


def stream_threshold(events: DataFrame, key: str, seq: str, score: str, is_reference: str, own: float,
                     margin: float = 0.5, path: str | None = None) -> DataFrame:
    """Effective threshold of each event: its key's last reference affinity plus a margin, else `own`.

    `is_reference` names a boolean column. Events of a micro-batch are applied in order of `seq`; the last
    reference per key is state. A key's rows of one micro-batch meet in a task, so batches are bounded by the reader's options.
    """
    rows = events.select(F.col(key).alias("k"), F.col(seq).alias("seq"), to_affinity(score).alias("affinity"), F.col(is_reference).alias("ref"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    out = rows.groupBy("k").transformWithStateInPandas(
        LastReference(), f"k {kinds['k']}, seq {kinds['seq']}, affinity double, last double", "Append", "None")
    limit = F.coalesce(F.col("last") + margin, F.lit(own))
    return run_stateful(out, path, "append").select(F.col("k").alias(key), F.col("seq").alias(seq), "affinity", limit.alias("effective_threshold"),
                                                    is_hit("affinity", limit).alias("hit"))


class RefitState(StatefulProcessor):
    """Per target its rows, the rows of its last fit and its fits; a target is due when it was never fitted or gained `grown` rows."""

    def __init__(self, least: int, grown: int):
        self.least, self.grown = least, grown

    def init(self, handle) -> None:
        self.state = handle.getValueState("counts", "n long, trained_n long, fits long")

    def handleInputRows(self, key, rows, timers):
        n, trained, fits = tuple(self.state.get()) if self.state.exists() else (0, None, 0)
        n += sum(int(pdf["rows"].sum()) for pdf in rows)
        due = n >= self.least and (trained is None or n - trained >= self.grown)
        trained, fits = (n, fits + 1) if due else (trained, fits)
        self.state.update((n, trained, fits))
        yield pd.DataFrame({"t": [key[0]], "n": [n], "trained_n": pd.array([trained], "Int64"), "fits": [fits], "due": [due]})

    def close(self) -> None:
        pass


# --- growing tables --------------------------------------------------------------------------------

def append_state(stream: DataFrame, schema, select: Callable[[DataFrame, DataFrame], DataFrame],
                 path: str | None = None) -> DataFrame:
    """Growing table: each micro-batch adds select(table so far, batch) in its own folder."""
    spark = stream.sparkSession
    root = path or fresh_dir(spark, "grow")

    def step(batch: DataFrame, number: int) -> None:
        so_far = (spark.read.schema(schema).option("basePath", f"{root}/rows")
                  .parquet(*[f"{root}/rows/b={i}" for i in range(number)]) if number
                  else spark.createDataFrame([], schema))
        select(so_far, batch).write.mode("overwrite").parquet(f"{root}/rows/b={number}")

    (stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{root}/progress")
     .trigger(availableNow=True).start().awaitTermination())
    return spark.read.schema(schema).parquet(f"{root}/rows")


def stream_novel(events: DataFrame, ident: str, fp: str, order, t: float = 0.65, path: str | None = None, select=filter_novel) -> DataFrame:
    """Near-duplicate gate with a lasting memory: only rows unlike all accepted ones get in.

    `select` compares the columns `fp`: sets, or with `shingles.filter_novel` texts, of which the memory then holds no sets.
    """
    return append_state(events, events.schema, lambda memory, batch: select(batch, memory, ident, fp, order, t), path)


def stream_refit(events: DataFrame, target: str, train: Callable[[DataFrame, int], None], least: int = 30,
                 grown: int = 20, path: str | None = None) -> DataFrame:
    """Rows per target, the size it was last trained at and its fits; `train(due, batch)` is called for every micro-batch.

    `due` has the targets that are due in it. A batch that runs again after a failure is trained again under the same number.
    """
    def count(parts):
        for pdf in parts:
            yield pdf.groupby("t", dropna=False).size().rename("rows").reset_index()
    kind = events.schema[target].dataType.simpleString()
    counts = events.select(F.col(target).alias("t")).mapInPandas(count, f"t {kind}, rows long")
    out = counts.groupBy("t").transformWithStateInPandas(RefitState(least, grown), f"t {kind}, n long, trained_n long, fits long, due boolean", "Update", "None")
    out = out.withColumnRenamed("t", target)
    rows = run_stateful(out, path, each=lambda batch, number: train(batch.filter("due").select(target), number))
    return newest_per_key(rows, [target]).drop("due")
