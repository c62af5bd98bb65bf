"""The whole job: remote-write requests in, lines of estimates out, for all streams of a configuration.

A step takes the state that the last one left and the series that have come since, and gives the new state and the lines. The
state is one table: for each stream, generation and group a sketch (none if the group was rejected) and when it was first seen,
for the generation of the latest series and the one before it. So a step reads as much state as there are live groups, however
long the job runs. The state of each step is a folder of its own, named by the step; a step that is repeated after a failure
reads the same state and writes the same folder.

An exact job counts series themselves. Its state has a row for each series of a live group in place of the sketch, and for a
rejected group one row without a series; a step reads as much state as there are live series.

Time is the time of arrival, and runs forward: series older than the generation before the latest are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import exposition
from ..operators.estimate import assigned
from ..operators.generations import epoch_us
from ..operators.limit import admissions
from ..plans.spec import StreamSpec, projected
from ..sources import wire

STATE = "stream int, gen long, key array<string>, first_seen long, sketch binary"
EXACT_STATE = "stream int, gen long, key array<string>, first_seen long, fp long"
#: Counters of a step, as rows name and value.
COUNTERS = ("write_requests_total", "parser_rows_total", "parser_errors_total", "inserts_total", "rejected_groups")


def arrived(requests: DataFrame, specs: Sequence[StreamSpec], most: int = wire.MAX_UNPACKED) -> DataFrame:
    """labels, fp, ts, arrival, error of the requests (request, ts, body): a series arrives with its request, in the order of
    requests. It has its identity, and of its labels those that some stream groups by."""
    found = wire.read_requests(requests.select(F.struct("request", "ts").alias("request"), "body"), most=most, wanted=frozenset(projected(list(specs))))
    return found.select("labels", "fp", F.col("request.ts").alias("ts"), F.col("request.request").alias("arrival"), "error")


def _held(state: DataFrame) -> str:
    """The column that only admitted groups have."""
    return "fp" if "fp" in state.columns else "sketch"


def _latest(df: DataFrame) -> DataFrame:
    """_stream, _latest: the latest generation of each stream."""
    return df.groupBy("stream").agg(F.max("gen").alias("_latest")).select(F.col("stream").alias("_stream"), "_latest")


def _rows(series: DataFrame, specs: Sequence[StreamSpec]) -> DataFrame:
    half = F.create_map(*[x for i, s in enumerate(specs) for x in (F.lit(i), F.lit(s.half_us))])[F.col("stream")]
    return assigned(series, specs, "ts", "arrival").withColumn("gen", F.floor(epoch_us(F.col("ts")) / half).cast("long"))


def _not_frozen(groups: DataFrame, state: DataFrame) -> DataFrame:
    """What the generation before the latest rejected stays rejected, and takes no slot from what comes."""
    frozen = state.groupBy("stream").agg((F.max("gen") - 1).alias("_frozen")).select(F.col("stream").alias("_stream"), "_frozen")
    kept = state.where(F.col(_held(state)).isNotNull()).select("stream", "gen", "key", F.lit(True).alias("_kept")).distinct()
    groups = groups.join(F.broadcast(frozen), F.col("stream") == F.col("_stream"), "left").join(kept, ["stream", "gen", "key"], "left")
    return groups.where("_frozen is null or gen > _frozen or (gen = _frozen and _kept)")


def _limits(specs: Sequence[StreamSpec]) -> dict[int, int]:
    return {i: s.group_limit if s.group_by else 1 for i, s in enumerate(specs)}


def advance_exact(state: DataFrame | None, series: DataFrame, specs: Sequence[StreamSpec]) -> DataFrame:
    """The state of an exact job after ``series`` (labels, ts, arrival)."""
    found = _rows(series, specs).select("stream", "gen", "key", F.col("arrival").alias("first_seen"), "fp")
    if state is not None:
        found = state.select(*found.columns).unionAll(found)
    groups = found.groupBy("stream", "gen", "key").agg(F.min("first_seen").alias("first_seen"))
    if state is not None:
        groups = _not_frozen(groups, state)
    told = admissions(groups.select("stream", "gen", "key", "first_seen"), _limits(specs))
    told = told.join(F.broadcast(_latest(told)), F.col("stream") == F.col("_stream")).where("gen >= _latest - 1").select("stream", "gen", "key", "first_seen", "admitted")
    # Of two generations; no more groups are admitted than the limits say.
    live = F.broadcast(told.where("admitted").select("stream", "gen", "key"))
    kept = found.where("fp is not null").join(live, ["stream", "gen", "key"], "left_semi").groupBy("stream", "gen", "key", "fp").agg(F.min("first_seen").alias("first_seen"))
    dropped = told.where("not admitted").withColumn("fp", F.lit(None).cast("long"))
    return kept.select(*found.columns).unionAll(dropped.select(*found.columns))


def advance(state: DataFrame | None, series: DataFrame, specs: Sequence[StreamSpec]) -> DataFrame:
    """The state after ``series`` (labels, ts, arrival)."""
    rows = _rows(series, specs)
    parts = []
    for p in sorted({s.hll_precision for s in specs}):
        mine = rows.where(F.col("stream").isin([i for i, s in enumerate(specs) if s.hll_precision == p]))
        made = mine.groupBy("stream", "gen", "key").agg(F.min("arrival").alias("first_seen"), F.hll_sketch_agg("fp", p).alias("sketch"))
        old = state.where(F.col("stream").isin([i for i, s in enumerate(specs) if s.hll_precision == p])) if state is not None else None
        both = made if old is None else old.select(*made.columns).unionAll(made)
        parts.append(both.groupBy("stream", "gen", "key").agg(F.min("first_seen").alias("first_seen"), F.hll_union_agg("sketch").alias("sketch")))
    groups = parts[0]
    for other in parts[1:]:
        groups = groups.unionAll(other)
    if state is not None:
        groups = _not_frozen(groups, state)
    told = admissions(groups.select("stream", "gen", "key", "first_seen"), _limits(specs))
    now = groups.select("stream", "gen", "key", "sketch").join(told, ["stream", "gen", "key"]).join(F.broadcast(_latest(told)), F.col("stream") == F.col("_stream"))
    # A rejected group is known by its key alone: it has no sketch, so nothing of it is counted when it is admitted later.
    return now.where("gen >= _latest - 1").select("stream", "gen", "key", "first_seen", F.when(F.col("admitted"), F.col("sketch")).alias("sketch"))


def estimated(state: DataFrame) -> DataFrame:
    """stream, key, value of all live groups."""
    held = _held(state)
    count = F.count_distinct("fp") if held == "fp" else F.hll_sketch_estimate(F.hll_union_agg("sketch"))
    return state.where(F.col(held).isNotNull()).groupBy("stream", "key").agg(count.alias("value"))


def rejected(state: DataFrame) -> DataFrame:
    """stream, key: groups that the latest generation has rejected."""
    return state.where(F.col(_held(state)).isNull()).join(F.broadcast(_latest(state)), (F.col("stream") == F.col("_stream")) & (F.col("gen") == F.col("_latest"))).select("stream", "key")


def lines(state: DataFrame, specs: Sequence[StreamSpec], limit_metric: str = exposition.LIMIT_METRIC) -> DataFrame:
    """line: the estimates of all streams, with summaries and limits."""
    counts, dropped, out = estimated(state), rejected(state), None
    for i, spec in enumerate(specs):
        one = exposition.lines(counts.where(F.col("stream") == i).select("key", "value"), spec, dropped.where(F.col("stream") == i), limit_metric)
        out = one if out is None else out.unionAll(one)
    return out


def counters(series: DataFrame, requests: DataFrame, state: DataFrame, specs: Sequence[StreamSpec]) -> DataFrame:
    """name, value: what the job counts about itself; ``series`` as of ``arrived``, its errors included."""
    seen = series.agg(F.count_if(F.col("error").isNull()).alias("rows"), F.count_if(F.col("error").isNotNull()).alias("errors"))
    one = lambda df, name: df.select(F.lit(name).alias("name"), F.col(df.columns[0]).cast("long").alias("value"))
    out = one(requests.agg(F.count("*")), COUNTERS[0]).unionAll(one(seen.select("rows"), COUNTERS[1])).unionAll(one(seen.select("errors"), COUNTERS[2]))
    inserted = assigned(series.where("error is null"), specs).agg(F.count("*"))
    return out.unionAll(one(inserted, COUNTERS[3])).unionAll(one(rejected(state).agg(F.count("*")), COUNTERS[4]))


def _at(folder: str, step: int, exact: bool) -> str:
    """Folders of the two kinds of state differ in name, so neither is taken for the other."""
    return f"{folder}/{'exact' if exact else 'step'}={step}"


def _state(spark: SparkSession, folder: str, step: int, exact: bool) -> DataFrame | None:
    return spark.read.schema(EXACT_STATE if exact else STATE).parquet(_at(folder, step, exact)) if step >= 0 else None


def stepper(folder: str, specs: Sequence[StreamSpec], sink: Callable[[DataFrame, int], None], exact: bool = False) -> Callable[[DataFrame, int], None]:
    """What a stream of requests does with each batch: advance the state in ``folder`` and hand lines to ``sink``. A new folder is
    a reset. ``exact`` counts series themselves, not by sketches."""

    def step(requests: DataFrame, epoch: int) -> None:
        spark = requests.sparkSession
        series = arrived(requests, specs).where("error is null").drop("error")
        # Groups are judged before series are kept, which reads them several times: they are decoded once.
        series.write.mode("overwrite").parquet(f"{folder}/series")
        series = spark.read.schema(series.schema).parquet(f"{folder}/series")
        state = (advance_exact if exact else advance)(_state(spark, folder, epoch - 1, exact), series, specs)
        state.write.mode("overwrite").parquet(_at(folder, epoch, exact))
        sink(lines(_state(spark, folder, epoch, exact), specs), epoch)

    return step


def start(requests: DataFrame, specs: Sequence[StreamSpec], folder: str, sink: Callable[[DataFrame, int], None], once: bool = False, exact: bool = False) -> StreamingQuery:
    """Run the job over a stream of requests (request, ts, body). ``folder`` is shared by the driver and all executors."""
    writer = requests.writeStream.option("checkpointLocation", f"{folder}/checkpoint").foreachBatch(stepper(folder, specs, sink, exact))
    return (writer.trigger(availableNow=True) if once else writer).start()
