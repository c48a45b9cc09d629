"""Histories of jobs: transitions of states, heartbeats that stop, and what follows from a job that ended.

A state machine is walked as an associative product. Every chunk of a job's history gives a map from each state it may
begin with to the state it ends with; the maps of a job's chunks are folded in order, which tells where each chunk begins,
and then chunks are walked on their own. A hot job spreads over as many tasks as it has chunks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.operators import readiness

INTERRUPTED, LATE, ILLEGAL = "Interrupted", "late", "illegal"


@dataclass(frozen=True)
class Machine:
    """States by number, and for each state where an update to another state leads; what is not listed is illegal."""

    states: tuple[str, ...]
    moves: dict[str, tuple[str, ...]]
    terminal: tuple[str, ...]

    def after(self, now: int, update: str | None) -> int:
        """The state after an update; it stays where the update is illegal."""
        return self.states.index(update) if self.legal(now, update) else now

    def legal(self, now: int, update: str | None) -> bool:
        return update is not None and update in self.moves.get(self.states[now], ())


#: States of a processing job; '' is a job without any update. Their names and order.
JOB = Machine(
    states=("", "Queued", "Running", "Completed", "Failed", "Cancelled", "Interrupted"),
    moves={
        "": ("Queued", "Running", "Completed", "Failed", "Cancelled", "Interrupted"),
        "Queued": ("Queued", "Running", "Completed", "Failed", "Cancelled", "Interrupted"),
        "Running": ("Running", "Completed", "Failed", "Cancelled", "Interrupted"),
    },
    terminal=("Completed", "Failed", "Cancelled", "Interrupted"),
)


def _code(machine: Machine, update: Column) -> Column:
    """The number of a state; one more than there are for null and unknown ones."""
    out = F.lit(len(machine.states))
    for i, name in enumerate(machine.states):
        out = F.when(update == name, F.lit(i)).otherwise(out)
    return out


def _maps(machine: Machine, code: Column) -> Column:
    """The map of an update by its number: for each state, the number of the state after it."""
    states = range(len(machine.states))
    return F.get(F.array(*[F.array(*[F.lit(machine.after(q, name)) for q in states]) for name in (*machine.states, None)]), code)


def _legal(machine: Machine, now: Column, code: Column) -> Column:
    known = [*machine.states, None]
    return F.get(F.array(*[F.lit(machine.legal(q, name)) for q in range(len(machine.states)) for name in known]), now * len(known) + code)


def _terminal(machine: Machine, code: Column) -> Column:
    return F.get(F.array(*[F.lit(name in machine.terminal) for name in (*machine.states, None)]), code)


def _open(machine: Machine) -> list[int]:
    return [q for q, name in enumerate(machine.states) if name not in machine.terminal]


def _late(updates: DataFrame, ts: str, gap: str) -> T.DataType:
    """The type of a time with the gap added, wide enough for times as they are."""
    return updates.select(F.coalesce(F.col(ts) + F.expr(f"INTERVAL {gap}"), F.col(ts))).schema[0].dataType


def chunk_maps(updates: DataFrame, order: list[str], state: str, machine: Machine = JOB, gap: str | None = None) -> DataFrame:
    """_at and product: the map of each chunk, the product of the maps of its updates in their order.

    updates come partitioned by _at, so that rows stay where they are. With a gap, whose time leads the order, product has
    for each state in which a job is open: now (the state after the chunk), first and last (times of its legal updates), end
    (ts, kind of the first ending in it that no earlier chunk has a part in); and _latest is the chunk's greatest time.
    """
    rows = updates.select("_at", F.col(order[0]).alias("_time"), F.struct(*order, _code(machine, F.col(state)).alias("_code")).alias("_x"))
    rows = rows.groupBy("_at").agg(F.array_sort(F.collect_list("_x")).alias("_xs"), F.max("_time").alias("_latest"))
    if gap is None:
        start = F.array(*[F.lit(q) for q in range(len(machine.states))])
        folded = F.aggregate("_xs", start, lambda a, x: F.transform(a, lambda q: F.get(_maps(machine, x["_code"]), q)))
        return rows.select("_at", folded.alias("product"))
    ts, pause = order[0], F.expr(f"INTERVAL {gap}")
    time = F.lit(None).cast(updates.schema[ts].dataType)
    end = lambda at, kind: F.struct(at.cast(_late(updates, ts, gap)).alias("ts"), kind.alias("kind"))

    def after(s: Column, x: Column) -> Column:
        legal = _legal(machine, s["now"], x["_code"])
        beat = F.when(legal, x[ts])
        stopped = ~_terminal(machine, s["now"]) & (x[ts] > s["last"] + pause)
        own = F.when(stopped, end(s["last"] + pause, F.lit(INTERRUPTED))).when(legal & _terminal(machine, x["_code"]), end(x[ts], x[state]))
        return F.struct(F.get(_maps(machine, x["_code"]), s["now"]).alias("now"), F.coalesce(s["first"], beat).alias("first"), F.coalesce(beat, s["last"]).alias("last"), F.coalesce(s["end"], own).alias("end"))

    no_end = F.when(F.lit(False), end(time, F.lit("")))
    start = F.array(*[F.struct(F.lit(q).alias("now"), time.alias("first"), time.alias("last"), no_end.alias("end")) for q in _open(machine)])
    folded = F.aggregate("_xs", start, lambda a, x: F.transform(a, lambda s: after(s, x)))
    return rows.select("_at", folded.alias("product"), "_latest")


def _passed(maps: DataFrame, by: list[str], machine: Machine, gap: str | None) -> DataFrame:
    """A row a job: its chunks _xs in order, and passed, with now (last and end too, with a gap) after all of them and seen:
    the same before each. One row a chunk of a job meets in a task."""
    steps = F.array_sort(F.collect_list(F.struct(F.col("_at")["_chunk"].alias("_chunk"), *maps.columns)))
    rows = maps.groupBy(*[F.col("_at")[c].alias(c) for c in by]).agg(steps.alias("_xs"))
    if gap is None:
        state = lambda a: F.struct(a["now"].alias("now"))
        start, next_ = [F.lit(0).alias("now")], lambda a, x: [F.get(x["product"], a["now"]).alias("now")]
    else:
        pause, kind = F.expr(f"INTERVAL {gap}"), maps.schema["product"].dataType.elementType
        state = lambda a: F.struct(a["now"].alias("now"), a["last"].alias("last"), a["end"].isNotNull().alias("ended"))
        start = [F.lit(0).alias("now"), *[F.lit(None).cast(kind[c].dataType).alias(c) for c in ("last", "end")]]

        def next_(a: Column, x: Column) -> list[Column]:
            place = {q: i for i, q in enumerate(_open(machine))}
            s = F.get(x["product"], F.get(F.array(*[F.lit(place.get(q)) for q in range(len(machine.states))]), a["now"]))  # null once the job is over
            # up to its first legal update a chunk stays in the state it begins with: the gap may be over by then
            stopped = ~_terminal(machine, a["now"]) & (F.coalesce(s["first"], x["_latest"]) > a["last"] + pause)
            own = F.when(stopped, F.struct((a["last"] + pause).cast(kind["end"].dataType["ts"].dataType).alias("ts"), F.lit(INTERRUPTED).alias("kind"))).otherwise(s["end"])
            return [F.coalesce(s["now"], a["now"]).alias("now"), F.coalesce(s["last"], a["last"]).alias("last"), F.coalesce(a["end"], own).alias("end")]

    first = F.struct(*start)
    seen = F.filter(F.array(state(first)), lambda s: F.lit(False))
    return rows.withColumn("passed", F.aggregate("_xs", F.struct(*start, seen.alias("seen")), lambda a, x: F.struct(*next_(a, x), F.concat(a["seen"], F.array(state(a))).alias("seen"))))


def _entries(passed: DataFrame) -> DataFrame:
    """_of and entry: what holds when each chunk begins."""
    return passed.select(F.inline(F.transform("_xs", lambda x, i: F.struct(x["_at"].alias("_of"), F.get("passed.seen", i).alias("entry")))))


def _own(*columns: str) -> list[str]:
    """Names of callers' columns while others stand beside them."""
    return [f"_x_{c}" for c in columns]


def _placed(updates: DataFrame, by: list[str], order: list[str], state: str, machine: Machine, chunk: Column | None, gap: str | None = None) -> tuple[DataFrame, DataFrame]:
    """updates by chunk under their own names, dealt out once for all that follows, and what _passed() says of their jobs."""
    at = F.struct(*by, (F.lit(0) if chunk is None else chunk).alias("_chunk")).alias("_at")
    needed = [*order, state]
    columns = [c for c in dict.fromkeys(needed if gap else updates.columns) if c not in by or c in needed]
    rows = updates.select(at, *[F.col(c).alias(*_own(c)) for c in columns]).repartition("_at")
    return rows, _passed(chunk_maps(rows, _own(*needed), *_own(state), machine, gap), by, machine, gap)


def _walked(rows: DataFrame, passed: DataFrame, order: list[str], state: str, machine: Machine, gap: str | None = None) -> DataFrame:
    """rows with _number in their chunk, before, legal and, with a gap, over: the job has ended before or at the row by the gap,
    or before it by a terminal update."""
    known = [*machine.states, None]
    legal = [[machine.legal(q, name) for name in known] for q in range(len(machine.states))]
    terminal = [name in machine.terminal for name in known]

    @F.arrow_udf("struct<now: int, over: boolean>")
    def walk(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        now, over, due = 0, False, None
        for numbers, entries, codes, *more in batches:
            whole = (c.cast(pa.int32() if pa.types.is_date32(c.type) else pa.int64()).to_pylist() for c in more[1:])
            ended, border, at, next_due = (more[0].to_pylist(), *whole) if more else (repeat(None) for _ in range(4))
            before, past = [], []
            for number, entry, code, e, b, t, d in zip(numbers.to_pylist(), entries.to_pylist(), codes.to_pylist(), ended, border, at, next_due):
                if number == 1:
                    now, over, due = entry, e, b  # another chunk begins
                over = over or (due is not None and t is not None and t > due and not terminal[now])
                before.append(now)
                past.append(over)
                if legal[now][code]:
                    now, over, due = code, over or terminal[code], due if d is None else d
            yield pa.StructArray.from_arrays([pa.array(before, pa.int32()), pa.array(past, pa.bool_())], ["now", "over"])

    number = F.row_number().over(Window.partitionBy("_at").orderBy(*order, state))
    rows = rows.withColumns({"_number": number, "_code": _code(machine, F.col(state))})
    # a struct is never null, and nulls in it are equal: rows stay where they are
    rows = rows.join(_entries(passed), F.col("_at") == F.col("_of")).drop("_of")
    # whole chunks side by side in a task, each in order: rows pass in batches, however many or long chunks are
    rows = rows.repartition("_at").sortWithinPartitions("_at", "_number")
    entry, more = F.col("entry"), []
    if gap:
        due = lambda t: t + F.expr(f"INTERVAL {gap}")
        kind = _late(rows, order[0], gap)
        more = [entry["ended"], *[t.cast(kind) for t in (due(entry["last"]), F.col(order[0]), due(F.col(order[0])))]]
    rows = rows.withColumn("_step", walk.asNondeterministic()("_number", entry["now"], "_code", *more))
    now = F.col("_step")["now"]
    return rows.withColumns({"before": F.get(F.array(*[F.lit(name) for name in machine.states]), now), "legal": _legal(machine, now, F.col("_code")), "over": F.col("_step")["over"]})


def walked(updates: DataFrame, by: list[str], order: list[str], state: str, machine: Machine = JOB, chunk: Column | None = None) -> DataFrame:
    """updates with before (the job's state when the update comes), legal, and place (chunk and number in it).

    An illegal update leaves the state as it is. Null jobs are one job, a null or unknown state is illegal, updates equal in
    order come by state name, repeated rows all count, and an empty table gives no rows. chunk is an expression that never
    falls along the order. Columns named before, legal and place are replaced; no column may be named _at, _x or _code.
    """
    updates = updates.drop("before", "legal", "place")
    placed, passed = _placed(updates, by, order, state, machine, chunk)
    rows = _walked(placed, passed, _own(*order), *_own(state), machine)
    place = F.struct(F.col("_at")["_chunk"].alias("chunk"), F.col("_number").alias("number")).alias("place")
    return rows.select(*[(F.col("_at")[c] if c in by else F.col(*_own(c))).alias(c) for c in updates.columns], "before", "legal", place)


def illegal_transitions(updates: DataFrame, by: list[str], order: list[str], state: str, machine: Machine = JOB, chunk: Column | None = None) -> DataFrame:
    """Updates that the machine forbids, with the state they met; rules as in walked()."""
    return walked(updates, by, order, state, machine, chunk).where(~F.col("legal")).drop("legal", "place")


def endings(updates: DataFrame, by: list[str], ts: str, order: list[str], state: str, gap: str, machine: Machine = JOB, chunk: Column | None = None, until: Column | None = None) -> DataFrame:
    """by, ts, kind: how each job ends, and every update that does not count.

    A job ends with its first terminal update, or Interrupted once gap after the last legal one if none comes until then
    (until, by default the greatest time of the table). Later updates of an ended job are late; updates before that which the
    machine forbids are illegal and no sign of life. ts leads the order; it must not be null. Other rules as in walked().
    """
    order = [ts, *order]
    placed, passed = _placed(updates, by, order, state, machine, chunk, gap)
    rows = _walked(placed, passed, _own(*order), *_own(state), machine, gap)
    pause = F.expr(f"INTERVAL {gap}")
    jobs = passed.select(F.struct(*by).alias("_job"), F.col("passed.end").alias("_end"), F.col("passed.last").alias("_last"))
    if until is None:
        latest = updates.agg(F.max(ts).alias("_until"))  # one row
        jobs = jobs.join(F.broadcast(latest))
    else:
        jobs = jobs.withColumn("_until", until)
    quiet = F.col("_end").isNull() & (F.col("_until") > F.col("_last") + pause)
    ended = jobs.where(F.col("_end").isNotNull() | quiet).select("_job", F.coalesce("_end.ts", F.col("_last") + pause).alias(ts), F.coalesce("_end.kind", F.lit(INTERRUPTED)).alias("kind"))
    kind = F.when(F.col("over"), F.lit(LATE)).when(~F.col("legal"), F.lit(ILLEGAL))
    rest = rows.select(F.struct(*[F.col("_at")[c].alias(c) for c in by]).alias("_job"), F.col(*_own(ts)).alias(ts), kind.alias("kind")).where("kind is not null")
    return ended.unionByName(rest).select("_job.*", ts, "kind")


def readiness_after(ended: DataFrame, selections: DataFrame, profile: str, media: Column, **columns: str) -> DataFrame:
    """profile, readiness of every profile with an ended job: a media job has it decided from the profile's active
    selections, others put it back to Draft; with both, the media job decides.

    selections and columns are those of readiness.rollup; profiles without any selection are Draft. Only selections of
    these profiles are read on. Null profiles are left out; repeated jobs count once.
    """
    profiles = ended.where(F.col(profile).isNotNull()).groupBy(F.col(profile).alias("_profile")).agg(F.bool_or(F.coalesce(media, F.lit(False))).alias("_media"))
    own = selections.join(profiles.where("_media").select(F.col("_profile").alias("_own")), F.col(profile) == F.col("_own"), "left_semi")
    decided = readiness.rollup(own, [profile], **columns).select(F.col(profile).alias("_decided"), readiness.decision().alias("_readiness"))
    rows = profiles.join(decided, F.col("_profile") == F.col("_decided"), "left")
    return rows.select(F.col("_profile").alias(profile), F.coalesce("_readiness", F.lit("Draft")).alias("readiness"))
