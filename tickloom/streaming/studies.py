"""Any plan of the catalogue on live bars, from one micro-batch to the next.

What a plan needs of a symbol's past is little: the last rows that its windows look back on, with the columns that its
stages have given them, and on the newest of these the states of its folds. `advance` runs the stages of a plan over
new rows behind such kept rows; it is the same text and the same folds as in a batch, so stream and batch agree.

`LiveStudy` keeps the rows of all symbols in a folder that all executors share, by bucket of the symbol and by version: a
micro-batch reads the versions before its own number and writes its own, so a retry does the same again. The
latest bar of a symbol is a preview: it has outputs, but is kept apart as a bare bar and is put in again once a later bar
makes it final. Earlier versions stay for a while as checkpoints: a correction of a past bar goes on from the newest
one before it and reads no history from before that.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tickloom.operators.folds import Fold, checked, in_order, inputs, made
from tickloom.operators.indicators import Plan
from tickloom.operators.windows import RUNNING
from tickloom.plans.run import BARS, clean, combined
from tickloom.plans.stages import Bounded, Running, aggregate, staged
from tickloom.session import written
from tickloom.ship import by_group_in_arrow

#: Columns that tell rows apart: kept from before; final; the newest final row; the newest of the kept rows.
OLD, FINAL, MARK, LAST = "_old", "_final", "_mark", "_last"


def advance(rows: DataFrame, plan: Plan, kept: DataFrame | None = None, *others: str) -> DataFrame:
    """Kept rows and new ones, the latter with the columns of all stages, and with `others` of their own.

    rows: bars with the flag `_final`, all later than the kept rows of their symbol, a symbol's final ones before the
    others. kept: what `to_keep` gave for the rows before them.
    """
    kinds = {f.name: f.dataType.simpleString() for f in kept.schema.fields} if kept is not None else {}
    frame = clean(rows, FINAL, *others).withColumn(OLD, F.lit(False))
    if kept is not None:
        frame = kept.withColumn(OLD, F.lit(True)).withColumn(FINAL, F.lit(True)).unionByName(frame, allowMissingColumns=True)
    newest = F.max(F.when(F.col(FINAL), F.col("time"))).over(Window.partitionBy("symbol"))
    frame = frame.withColumn(MARK, F.col(FINAL) & (F.col("time") == newest))
    held = lambda name, text: F.expr(f"CASE WHEN {OLD} THEN {name} ELSE CAST(({text}) AS {kinds[name]}) END" if name in kinds else text)
    for k, stage in enumerate(staged(plan)):
        if isinstance(stage, Running):
            frame = frame.withColumns({name: held(name, _carried(name, *call) if name in kinds else aggregate(*call)) for name, call in stage.columns.items()})
        elif isinstance(stage, Bounded):
            frame = frame.withColumns({name: held(name, text) for name, text in stage.columns.items()})
        else:
            frame = _resumed(frame, stage, f"_state{k}", kept is not None)
    return frame


def _carried(name: str, function: str, argument: str) -> str:
    """A running aggregate that goes on from its value on the newest kept row."""
    if function == "row":
        return f"sum(CASE WHEN {LAST} THEN {name} + 1 WHEN {OLD} THEN 0 ELSE 1 END) OVER {RUNNING} - 1"
    if function == "sum":
        return f"sum(CASE WHEN {LAST} THEN {name} WHEN {OLD} THEN NULL ELSE {argument} END) OVER {RUNNING}"
    if function == "count":
        return f"sum(CASE WHEN {LAST} THEN {name} WHEN {OLD} THEN 0 WHEN ({argument}) IS NOT NULL THEN 1 ELSE 0 END) OVER {RUNNING}"
    # the kept rows have the values themselves: extremes and first and last values go on from these
    return aggregate(function, f"CASE WHEN {OLD} THEN {name} ELSE {argument} END")


def _resumed(frame: DataFrame, folds: list[Fold], state: str, going_on: bool) -> DataFrame:
    """The outputs of folds on new rows, from the state on the newest kept row; the newest final row gets the state after it."""
    outs = {name: T.DataType.fromDDL(kind) for f in folds for name, kind in f.outs.items()}
    plain = [f for f in frame.schema.fields if f.name not in outs and f.name != state]
    schema = T.StructType([*plain, *(T.StructField(name, kind) for name, kind in outs.items()), T.StructField(state, T.StringType())])
    kinds = {name: to_arrow_type(kind) for name, kind in outs.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states: list[dict] = [{} for _ in folds]
        for batch in checked(batches):
            old, mark = (batch.column(c).to_pylist() for c in (OLD, MARK))
            k = sum(old)  # kept rows come before all others
            if going_on:
                for at in range(k):
                    if batch.column(LAST)[at].as_py():
                        states = json.loads(batch.column(state)[at].as_py())
            seen: list = batch.column(state).slice(0, k).to_pylist() if going_on else []
            parts = {name: [batch.column(name).slice(0, k)] if going_on else [] for name in outs}
            ends = [mark.index(True, k) + 1] if True in mark[k:] else []
            for a, b in zip([k, *ends], [*ends, len(old)], strict=True):
                if a == b:
                    continue
                columns = inputs(batch.slice(a, b - a), folds)
                for f, own in zip(folds, states, strict=True):
                    for name, values in f.resume(own, columns).items():
                        parts[name].append(made(values, kinds[name]))
                # what comes after the newest final row is a preview; its changes to the state are seen by nobody
                seen += [None] * (b - a) if b not in ends else [None] * (b - a - 1) + [json.dumps(states)]
            made_ = {name: pa.concat_arrays([p.cast(kinds[name]) for p in some]) for name, some in parts.items()}
            yield pa.RecordBatch.from_arrays([made_[c] if c in made_ else pa.array(seen, pa.string()) if c == state else batch.column(c) for c in schema.names], names=schema.names)

    return by_group_in_arrow(in_order(frame, "symbol"), ["symbol"], run, schema)


def to_keep(frame: DataFrame, plan: Plan, *others: str) -> DataFrame:
    """The final rows of a frame that the next rows need: a few of each symbol, whatever its history."""
    back: dict[str, int] = {"": 1}
    for stage in staged(plan):
        if isinstance(stage, Bounded):
            back = {k: max(back.get(k, 0), stage.back.get(k, 0)) for k in {*back, *stage.back}}
    newest = lambda *keys: F.row_number().over(Window.partitionBy("symbol", *keys).orderBy(F.desc("time")))
    finals = frame.where(FINAL).withColumns({f"_rank_{flag}": newest(*([flag] if flag else [])) for flag in back})
    wanted = " OR ".join(f"`_rank_{flag}` <= {n}" for flag, n in back.items())
    return finals.where(wanted).drop(*(f"_rank_{flag}" for flag in back), OLD, FINAL, LAST, *others).withColumnRenamed(MARK, LAST)


def newest(rows: DataFrame, version: str = "version") -> DataFrame:
    """Of each symbol and time the row with the highest version."""
    cols = [c for c in rows.columns if c not in ("symbol", "time")]
    return rows.groupBy("symbol", "time").agg(F.max_by(F.struct(*cols), version).alias("_row")).select("symbol", "time", "_row.*")


class LiveStudy:
    """Indicators over a stream of bars (symbol, time, prices, volume, version), kept in a folder that all executors share.

    `run` is a foreachBatch function. A bar that comes again replaces the preview if its version is higher; bars before the
    preview are left to `correct`. Null and empty symbols are symbols like others. Every batch leaves a version
    of the buckets it touches, and `keep` of them stay.
    """

    def __init__(self, spark: SparkSession, folder: str, asked: dict[str, tuple[str, dict[str, float]]], buckets: int = 64, keep: int = 8):
        self.spark, self.folder, self.plan, self.buckets, self.keep = spark, folder, combined(asked), buckets, keep
        self.outputs = list(self.plan.outputs)
        self._files = spark._jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(spark._jsc.hadoopConfiguration())

    # folders: state/bucket=7/version=b000000000012-000, out/version=..., corrected/version=...

    def _path(self, text: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(text)

    def _named(self, folder: str, key: str) -> list[str]:
        """The values of the folders key=value under a folder, in order."""
        path = self._path(f"{self.folder}/{folder}")
        found = [s.getPath().getName() for s in self._files.listStatus(path)] if self._files.exists(path) else []
        return sorted(n.removeprefix(f"{key}=") for n in found if n.startswith(f"{key}="))

    def versions(self, bucket: int) -> list[str]:
        return self._named(f"state/bucket={bucket}", "version")

    def _state(self, wanted: dict[int, list[str]]) -> DataFrame | None:
        """The kept rows and previews of the given versions by bucket, with `version_name`; None where there are none."""
        paths = [f"{self.folder}/state/bucket={b}/version={v}" for b, vs in wanted.items() for v in vs]
        # the version of a bucket from which all rows have gone is an empty folder
        paths = [p for p in paths if any(s.getPath().getName().endswith(".parquet") for s in self._files.listStatus(self._path(p)))]
        if not paths:
            return None
        return self.spark.read.option("basePath", f"{self.folder}/state").parquet(*paths).withColumnRenamed("version", "version_name").withColumnRenamed("_version", "version").drop("bucket")

    def _bucket(self) -> F.Column:
        return F.pmod(F.xxhash64("symbol"), F.lit(self.buckets)).cast("int")

    def _touched(self, rows: DataFrame) -> list[int]:
        """The buckets that rows are of; at most `buckets` numbers."""
        return [r[0] for r in rows.select(self._bucket().alias("b")).distinct().collect()]

    def run(self, batch: DataFrame, number: int) -> None:
        """Take in a micro-batch. The same number with the same rows gives the same again."""
        name = f"b{number:012d}-000"
        fresh = newest(batch.select(*BARS, "version")).withColumn("_new", F.lit(True)).persist()
        touched = self._touched(fresh)
        before = {b: [v for v in self.versions(b) if v < name][-1:] for b in touched}
        state = self._state(before)
        kept, rows = None, fresh
        if state is not None:
            state = state.drop("version_name")
            kept = state.where(FINAL).drop("version", FINAL)
            rows = fresh.unionByName(state.where(f"NOT {FINAL}").select(*BARS, "version").withColumn("_new", F.lit(False)))
            # the preview is the earliest bar that may still change, the newest final bar never does
            floor = state.groupBy(F.col("symbol").alias("_symbol")).agg(F.max(F.struct("time", F.col(FINAL).alias("done"))).alias("_floor"))
            rows = rows.join(floor, F.col("symbol").eqNullSafe(F.col("_symbol")), "left")
            rows = rows.where("_floor IS NULL OR time > _floor.time OR (time = _floor.time AND NOT _floor.done)").drop("_symbol", "_floor")
            rows = newest(rows.withColumn("_by", F.struct("version", "_new")), "_by").drop("_by")
        if touched:
            self._put(rows, kept, name, "_seen")
        fresh.unpersist()

    def _put(self, rows: DataFrame, kept: DataFrame | None, name: str, shown: str, others: DataFrame | None = None) -> None:
        """Advance over rows and write outputs and the buckets' new version. rows: bars, version, _new."""
        by = Window.partitionBy("symbol")
        rows = rows.withColumns({FINAL: F.col("time") < F.max("time").over(by), "_seen": F.max("_new").over(by)}) if FINAL not in rows.columns else rows
        frame = advance(rows, self.plan, kept, "version", shown).persist()
        new = frame.where(f"NOT {OLD}")
        outputs = [F.col(v).alias(k) for k, v in self.plan.outputs.items()]
        new.where(shown).select("symbol", "time", *outputs, F.col(FINAL).alias("final")).write.mode("overwrite").parquet(f"{self.folder}/out/version={name}")
        previews = new.where(f"NOT {FINAL}").select(*BARS, F.col("version").alias("_version"), FINAL)
        state = to_keep(frame, self.plan, "version", shown).withColumn(FINAL, F.lit(True)).unionByName(previews, allowMissingColumns=True)
        if others is not None:
            state = state.unionByName(others.withColumnRenamed("version", "_version"), allowMissingColumns=True)
        self._write(state, name)
        frame.unpersist()

    def _write(self, state: DataFrame, name: str) -> None:
        placed = state.withColumns({"bucket": self._bucket(), "version": F.lit(name)})
        placed.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "version").parquet(f"{self.folder}/state")
        for bucket in map(int, self._named("state", "bucket")):
            for old in self.versions(bucket)[: -self.keep]:
                self._files.delete(self._path(f"{self.folder}/state/bucket={bucket}/version={old}"), True)

    def results(self) -> DataFrame:
        """symbol, time, outputs, final: of each bar what was given last."""
        out = self.spark.read.option("basePath", f"{self.folder}/out").parquet(f"{self.folder}/out")
        return newest(out).drop("version")

    def compact(self) -> None:
        """All outputs so far in one folder, of each bar the last ones."""
        names = self._named("out", "version")
        if len(names) > 1:
            written(self.results()).write.mode("overwrite").parquet(f"{self.folder}/out/version={names[-1]}")
            for name in names[:-1]:
                self._files.delete(self._path(f"{self.folder}/out/version={name}"), True)

    def _next(self) -> str:
        """A name after all versions there are, before those of later batches."""
        last = max((v for b in self._named("state", "bucket") for v in self.versions(int(b))), default="b000000000000-000")
        number, revision = last.split("-")
        return f"{number}-{int(revision) + 1:03d}"

    def _rewrite(self, keep: str) -> None:
        """A new version of all buckets with the rows of the newest that meet a condition."""
        newest_ = {int(b): self.versions(int(b))[-1:] for b in self._named("state", "bucket")}
        state = self._state(newest_)
        if state is not None:
            state = state.withColumn("_newest", F.max("time").over(Window.partitionBy("symbol")))
            name, left = self._next(), written(state.where(keep).drop("_newest", "version_name").withColumnRenamed("version", "_version"))
            for bucket in newest_:
                self._files.mkdirs(self._path(f"{self.folder}/state/bucket={bucket}/version={name}"))
            self._write(left, name)

    def discard(self) -> None:
        """Forget all previews; the next bar of a symbol may be any after its newest final one."""
        self._rewrite(FINAL)

    def expire(self, before: int) -> None:
        """Forget the symbols whose newest bar is earlier than `before`; a bar that comes later starts them anew."""
        self._rewrite(f"_newest >= {int(before)}")

    def correct(self, history: DataFrame, corrections: DataFrame) -> None:
        """Put in corrections (symbol, time, prices, volume, version) of final bars, and all outputs from the first of them on.

        history: all final bars, for instance the table that `upsert_into` keeps; a symbol is read from its newest
        checkpoint before the correction on, from its start only where there is none left.
        """
        same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
        touched = self._touched(corrections)
        all_ = self._state({b: self.versions(b) for b in touched})
        if all_ is None:
            return
        since = corrections.groupBy(F.col("symbol").alias("_s")).agg(F.min("time").alias("_since"))
        marks = all_.where(f"{FINAL} AND {LAST}").select("symbol", "version_name", F.col("time").alias("_done"))
        if self._named("corrected", "version"):
            # a version from before an earlier correction of its rows is none to go on from
            stale = self.spark.read.option("basePath", f"{self.folder}/corrected").parquet(f"{self.folder}/corrected")
            stale = stale.select(F.col("symbol").alias("_c"), F.col("since").alias("_from"), F.col("version").alias("_at"))
            marks = marks.join(stale, same("symbol", "_c") & (F.col("_at") > F.col("version_name")) & (F.col("_from") <= F.col("_done")), "left_anti")
        usable = marks.join(since, same("symbol", "_s")).where("_done < _since")
        chosen = written(usable.groupBy("symbol", "_since").agg(F.max(F.struct("version_name", "_done")).alias("c")).select(F.col("symbol").alias("_k"), "c.*"))
        newest_ = self._state({b: self.versions(b)[-1:] for b in touched}).drop("version_name")
        current = newest_.groupBy(F.col("symbol").alias("_n")).agg(F.max(F.when(F.col(FINAL), F.col("time"))).alias("_until"))
        concerned = since.join(current, same("_s", "_n")).join(chosen.select(F.col("_k").alias("_h"), F.col("_done").alias("_after")), same("_s", "_h"), "left").drop("_n", "_h")
        counts = concerned.agg(F.count("*").alias("n"), F.count("_after").alias("known"), F.min("_after").alias("least")).first()
        if counts["n"] == counts["known"] and counts["n"]:
            history = history.where(F.col("time") > counts["least"])  # one number, so that the scan can skip files
        bars = newest(history.select(*BARS, "version").unionByName(corrections.select(*BARS, "version")))
        finals = bars.join(concerned, same("symbol", "_s")).where("time > coalesce(_after, time - 1) AND time <= _until")
        previews = newest_.where(f"NOT {FINAL}").select(*BARS, "version").join(concerned, same("symbol", "_s"))
        rows = finals.withColumn(FINAL, F.lit(True)).unionByName(previews.withColumn(FINAL, F.lit(False))).withColumn("_shown_", F.col("time") >= F.col("_since"))
        rows = written(rows.select(*BARS, "version", FINAL, F.col("_shown_").alias("_seen")))
        from_ = chosen.select("_k", F.col("version_name").alias("_chosen"))
        kept = all_.where(FINAL).join(from_, same("symbol", "_k") & (F.col("version_name") == F.col("_chosen")))
        kept = written(kept.drop("_k", "_chosen", "version", FINAL, "version_name"))
        others = written(newest_.join(since, same("symbol", "_s"), "left_anti"))
        name = self._next()
        self._put(rows, kept, name, "_seen", others)
        since.select(F.col("_s").alias("symbol"), F.col("_since").alias("since")).write.mode("overwrite").parquet(f"{self.folder}/corrected/version={name}")
