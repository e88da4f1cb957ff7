"""Stateful fold of observations into capability state, with carry-over, expiry and a throttled timeline.

One window per entity (probe, resolver address) in the order (time, stream, sequence)
carries every rule; a carried snapshot enters as a row before all others.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from probelake.functions import rules
from probelake.functions import schema as S
from probelake.functions.wire import parse_dns
from probelake.sources.sinks import checkpointed

KEY = ["prb_id", "addr"]
ORDER = ["time", "stream_ord", "seq"]
SNAPSHOT_STATES = [*S.ASSIGNED, "has_ta_19036", "has_ta_20326", *[f"{p}_{k}" for p in S.PAIRS for k in ("secure", "bogus", "result")]]
#: Initial values other than UNKNOWN: nothing known, or no masks.
_NONE = {"whoami_g", "whoami_a", "whoami_6"}


def stream_order(msm_id: Column) -> Column:
    """Rank of a measurement where names sort as text, which breaks ties in time."""
    ranked = sorted(S.KNOWN, key=str)
    return F.element_at(F.create_map(*[F.lit(x) for k, m in enumerate(ranked) for x in (m, k)]), msm_id)


def observed(observations: DataFrame) -> DataFrame:
    """Observations of known measurements, decoded, with what each assigns; errors assign nothing but advance the clock."""
    rows = observations.filter(F.col("msm_id").isin(*S.KNOWN)).withColumn("m", F.when(~F.col("is_error"), parse_dns("msg")))
    m, msm = F.col("m"), F.col("msm_id")
    answered = m.isNotNull()
    ok = rules.control_answer(m)
    said = lambda ids: F.when(answered & msm.isin(ids), F.when(ok, S.CAN).otherwise(S.CANNOT))
    pairs = {}
    for pair, secure, bogus in S.pair_measurements():
        pairs |= {f"{pair}_s": said([secure]), f"{pair}_b": said([bogus]), f"{pair}_r": F.lit(None).cast("int")}
    values = {k: F.when(answered, v) for k, v in rules.assignments(m, msm).items()}
    return rows.select(
        *KEY, F.col("time").cast("long").alias("time"), stream_order(msm).alias("stream_ord"), "seq",
        *[v.alias(k) for k, v in values.items()], *[v.alias(k) for k, v in pairs.items()],
        F.lit(None).cast("int").alias("carried_19036"), F.lit(None).cast("int").alias("carried_20326"),
        F.lit(None).cast("long").alias("carried_updated"), F.lit(None).cast("long").alias("carried_logged"),
    )


def carried(snapshot: DataFrame, start: Column, keep_days: int = S.KEEP_DAYS) -> DataFrame:
    """The rows of an earlier snapshot that are not older than ``keep_days`` before ``start``, as first rows of their entities."""
    fresh = snapshot.filter(F.col("updated") >= start.cast("timestamp").cast("long") - keep_days * 86_400)
    return fresh.select(
        *KEY, F.lit(-(1 << 40)).alias("time"), F.lit(-1).alias("stream_ord"), F.lit(-1).cast("long").alias("seq"), *S.ASSIGNED,
        *[c for p in S.PAIRS for c in (F.col(f"{p}_secure").alias(f"{p}_s"), F.col(f"{p}_bogus").alias(f"{p}_b"), F.col(f"{p}_result").alias(f"{p}_r"))],
        F.col("has_ta_19036").alias("carried_19036"), F.col("has_ta_20326").alias("carried_20326"),
        F.col("updated").alias("carried_updated"), F.col("logged").alias("carried_logged"),
    )


def as_of(rows: DataFrame) -> DataFrame:
    """The whole state as of each row. ``rows``: observed() and carried(), together."""
    order = Window.partitionBy(*KEY).orderBy(*ORDER)
    window = order.rowsBetween(Window.unboundedPreceding, 0)
    now_19036, now_20326 = F.col("not_ta_19036"), F.col("not_ta_20326")
    rows = rows.withColumns({"nth": F.row_number().over(order), "now_19036": F.when(F.col("carried_19036").isNull(), now_19036), "now_20326": F.when(F.col("carried_20326").isNull(), now_20326)})
    rows = rules.resolve_pairs(rows, window, S.PAIRS)
    rows = rules.resolve_anchors(rows, window, F.col("now_19036"), F.col("now_20326"), F.col(f"{S.RSASHA256}_result"), F.col("carried_19036"), F.col("carried_20326"))
    empty = F.array().cast("array<binary>")
    return rows.withColumns({n: rules.running(F.col(n), window, None if n in _NONE else empty if n == "hijacked" else 0) for n in S.ASSIGNED})


def throttle(rows: DataFrame, key: list[str], time: str = "time", nth: str = "nth", updated: str | None = None, logged: str | None = None) -> DataFrame:
    """Key, updated, logged, emitted (array of row number and the clock then): the throttle over an entity's rows by number.

    An event more than an hour before the latest is late and moves nothing. When the
    latest is over an hour after the last logged time, the state is emitted and the
    event's own time is logged. ``updated`` / ``logged`` name columns with carried clocks.

    Only an event later than all before it can emit: after each emission and at the start
    the latest is within an hour of the logged time. These records are found without the
    other events: the first row of each second, summed in the tasks, is one if no later
    second came before it. So what meets in a task is a row for each second of the day at
    most, however many events an entity has.
    """
    none = F.lit(None).cast("long")
    event = F.col(updated).isNull() if updated else F.lit(True)
    seconds = rows.groupBy(*key, F.col(time).alias("at")).agg(
        F.min(F.when(event, F.col(nth).cast("long"))).alias("first"), (F.max(updated) if updated else F.max(none)).alias("held_updated"), (F.max(logged) if logged else F.max(none)).alias("held_logged")
    )
    later = Window.partitionBy(*key).orderBy(F.desc("at")).rowsBetween(Window.unboundedPreceding, -1)
    marked = seconds.withColumn("record", F.col("first").isNotNull() & F.coalesce(F.col("first") < F.min("first").over(later), F.lit(True)))
    records = F.array_sort(F.collect_list(F.when(F.col("record"), F.struct("at", "first"))))
    entity = marked.groupBy(*key).agg(records.alias("records"), *[F.coalesce(F.max(c), F.lit(0)).cast("long").alias(c) for c in ("held_updated", "held_logged")])
    start = F.struct(F.col("held_updated").alias("updated"), F.col("held_logged").alias("logged"), F.array().cast("array<struct<nth:bigint,updated:bigint>>").alias("emitted"))

    def step(acc: Column, r: Column) -> Column:
        emits = (r["at"] > acc.updated) & (r["at"] - acc.logged > S.QUIET)
        return (
            F.when(acc.updated == 0, F.struct(r["at"].alias("updated"), r["at"].alias("logged"), acc.emitted.alias("emitted")))
            .otherwise(F.struct(
                F.greatest(acc.updated, r["at"]).alias("updated"), F.when(emits, r["at"]).otherwise(acc.logged).alias("logged"),
                F.when(emits, F.concat(acc.emitted, F.array(F.struct(r["first"].alias("nth"), r["at"].alias("updated"))))).otherwise(acc.emitted).alias("emitted"),
            ))
        )

    return entity.select(*key, F.aggregate("records", start, step).alias("c")).select(*key, "c.updated", "c.logged", "c.emitted")


def day_state(observations: DataFrame, previous: DataFrame | None = None, start: Column | None = None, hold: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """(snapshot, timeline) of a day: the last state of every entity, carried ones too, and the throttled emissions.

    Both come from one shuffle by entity: the clocks are joined on the entity alone. ``hold``
    writes the common rows somewhere and reads them back, so that messages are decoded once.
    """
    rows = observed(observations)
    if previous is not None:
        rows = rows.unionByName(carried(previous, start))
    states = as_of(rows)
    clocks = throttle(states, KEY, updated="carried_updated", logged="carried_logged")
    last = states.groupBy(*KEY).agg(F.max("nth").alias("last"))
    both = states.join(clocks.join(last, KEY), KEY)
    emitted = F.try_element_at(F.filter("emitted", lambda e: e.nth == F.col("nth")), F.lit(1))
    kept = both.withColumn("emitted", emitted).filter((F.col("nth") == F.col("last")) | F.col("emitted").isNotNull())
    kept = kept.select(*KEY, *SNAPSHOT_STATES, "updated", "logged", (F.col("nth") == F.col("last")).alias("is_last"), F.col("emitted.updated").alias("emitted"))
    if hold is not None:
        kept = hold(kept)
    snapshot = kept.filter("is_last").select(*KEY, *SNAPSHOT_STATES, "updated", "logged")
    timeline = kept.filter("emitted is not null").select(*KEY, F.col("emitted").alias("updated"), *SNAPSHOT_STATES)
    return snapshot, timeline


#: Bits of a number of monotonically_increasing_id() below the number of the partition (fixed).
_WITHIN = 33


def merge_order(rows: DataFrame, stream: str, time: str, tie: list[str]) -> DataFrame:
    """k-way merge of streams: rows numbered by time, ties to the stream that sorts first, then by ``tie``.

    The engine deals the rows out by ranges of the order and sorts each range. The result
    is checkpointed, since a second run might cut other ranges; rows are numbered within
    theirs as they lie, and the ranges' sizes, a row each, give what comes before.
    """
    columns = [time, stream, *tie]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = checkpointed(rows.repartitionByRange(parts, *columns).sortWithinPartitions(*columns).withColumn("merge_id", F.monotonically_increasing_id()))
    part = F.shiftright("merge_id", _WITHIN)
    before = F.coalesce(F.sum("n").over(Window.orderBy("merge_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = ranged.groupBy(part.alias("merge_part")).agg(F.count("*").alias("n")).withColumn("before", before).drop("n")  # a row for each range
    numbered = ranged.withColumn("merge_part", part).join(F.broadcast(offsets), "merge_part")
    return numbered.withColumn("merge_ord", F.col("merge_id").bitwiseAND(F.lit((1 << _WITHIN) - 1)) + 1 + F.col("before")).drop("merge_part", "merge_id", "before")
