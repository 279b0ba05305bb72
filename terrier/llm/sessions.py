"""Sessions of event streams by gap, length and final events, with the streams of hot clients salted into time slices.

A client's timely events, by time and id, continue the session unless the event before is final, or ``gap`` earlier, or the
session's first event is over ``length`` earlier. The first two are *hard breaks*, seen between two neighbours; the third
hangs on where the session began.

A client with over 1/HOT_SHARE of the rows is cut at quantiles of its own times, so that a slice has about that share: at
most HOT_SHARE hot clients and 2 * HOT_SHARE slices at any size. The first shuffle deals (client, slice) and sorts; a task
streams each slice and finishes the sessions between its first and its last hard break. What is left are edge fragments:
the events before the first break, whose sessions hang on the session that runs into the slice, and the session that runs
out of it. The running session is passed over the slices as a small state: a slice with a hard break inside hands out a
constant, one without a map from the running session's start to the next (one entry for each event of its first
``length``); maps of neighbours are composed in rounds that double their reach, so even a stream without any break goes
through no single task. A second shuffle deals the events before the first breaks by slice, now with the session that runs
in, and the pieces of sessions that span slices are joined by session.

Memory of a task: a batch, the ids of one session, the events of one moment, one slice's map.

Cases: rows with a null id, client or time are left out; of rows with one id, the smallest (time, client, lateness, final, value)
stays; late events join no session and are counted in the one whose span holds their time, those before a client's first
session nowhere; a client with late events only has no session; a null arrival is in time; a null or not finite value is 0
and never final; a null kind is not final; equal times go by id, and late events at the very time of a session's first event
count there; negative and repeated values are added as they are; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import blocks
from . import spark_io as io

MINUTE = 60_000_000
HOT_SHARE = 1000
#: A client with fewer rows is never cut.
LEAST_ROWS = 1000
#: Bounds of a hot client are looked up in groups of so many.
GROUP = 32
SESSION, PIECE, EVENT, SLICE = range(4)
FOUND = "kind int, client_id long, slice int, session_id long, start_us long, end_us long, n_clicks long, n_late long, value_cents long, closed_by string, final boolean, text string, blob binary"
NAMES = [x.split()[0] for x in FOUND.split(", ")]
TYPES = [{"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary()}[x.split()[1]] for x in FOUND.split(", ")]
REASONS = np.array([None, "end", "gap", "length"], object)
STATE = "client_id long, pos int, lo int, settled boolean, at long, at_id long, blob binary"


def micros(df: DataFrame, name: str) -> Column:
    """Microseconds since 1970; a time without a zone counts as UTC, whatever the session's zone."""
    c = F.col(name)
    if dict(df.dtypes)[name] != "timestamp_ntz":
        return F.unix_micros(c.cast("timestamp"))
    return F.unix_date(c.cast("date")).cast("long") * (1440 * MINUTE) + F.hour(c).cast("long") * (60 * MINUTE) + F.minute(c).cast("long") * MINUTE + (F.extract(F.lit("SECOND"), c) * 1_000_000).cast("long")


class Rows:
    """Rows of FOUND, column by column, given out as batches."""

    def __init__(self):
        self.columns = [[] for _ in NAMES]

    def add(self, **values) -> None:
        for name, column in zip(NAMES, self.columns, strict=True):
            column.append(values.get(name))

    def many(self, n: int, **values) -> None:
        for name, column in zip(NAMES, self.columns, strict=True):
            v = values.get(name)
            column.extend(v if isinstance(v, list) else [v] * n)

    def take(self, least: int = 1) -> Iterator[pa.RecordBatch]:
        if len(self.columns[0]) >= least:
            columns, self.columns = self.columns, [[] for _ in NAMES]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, TYPES, strict=True)], NAMES)


class Walk:
    """One slice's events, fed in order. cut: the slice has neighbours, and the session that runs into it is not known yet.
    entry: (start, id) of that session, or None; before: (time, final) of the last timely event before the slice, or None.
    more: the events are those before the slice's first hard break, so a session still open at their end is closed there.
    """

    def __init__(self, out: Rows, client: int, slice_: int, gap: int, length: int, cut: bool, entry=None, before=None, piece: bool = False, more: bool = False):
        self.out, self.client, self.slice, self.gap, self.length = out, client, slice_, gap, length
        self.cut, self.piece, self.more = cut, piece, more
        self.waiting = cut
        self.open = None
        if entry is not None:
            self.begin(*entry)
        self.started_here = False
        self.last = before
        self.first, self.seen = None, 0
        self.thresholds, self.at, self.at_id, self.whole = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), False

    def begin(self, start: int, session: int) -> None:
        self.open, self.n, self.late, self.cents, self.ids, self.end = (start, session), 0, 0, 0, [], None

    def feed(self, us, ids, late, final, cents) -> None:
        on = np.flatnonzero(~late)
        if self.waiting:
            t = us[on]
            before = np.r_[self.last[0] if self.last else (t[0] if len(t) else 0), t[:-1]][: len(t)]
            ended = np.r_[bool(self.last and self.last[1]), final[on][:-1]][: len(t)]
            hard = ended | (t - before >= self.gap)
            stop = int(np.argmax(hard)) if hard.any() else len(t)
            edge = us < t[stop] if stop < len(t) else np.ones(len(us), bool)
            if stop:
                edge[on[:stop]] = True
            self.out.many(int(edge.sum()), kind=EVENT, client_id=self.client, slice=self.slice, session_id=ids[edge].tolist(), start_us=us[edge].tolist(), n_late=late[edge].astype(np.int64).tolist(), final=final[edge].tolist(), value_cents=cents[edge].tolist())
            self.follow(t[:stop], ids[on[:stop]])
            if stop:
                self.first, self.seen, self.last = (self.first if self.seen else int(t[0])), self.seen + stop, (int(t[stop - 1]), bool(final[on[stop - 1]]))
            if stop == len(t):
                return
            self.waiting = False
            us, ids, late, final, cents = (x[~edge] for x in (us, ids, late, final, cents))
            on = np.flatnonzero(~late)
        self.run(us[on], ids[on], final[on], cents[on], us[late])

    def follow(self, t: np.ndarray, ids: np.ndarray) -> None:
        """Carries every possible running session over further events without a hard break."""
        if not len(t):
            return
        if not self.whole:
            line = (self.thresholds[0] if len(self.thresholds) else t[0]) + self.length
            n = min(len(t), int(np.searchsorted(t, line, "right")) + 1)
            self.whole = bool(t[n - 1] > line)
            self.thresholds, self.at, self.at_id = np.r_[self.thresholds, t[:n]], np.r_[self.at, t[:n]], np.r_[self.at_id, ids[:n]]
        while True:
            to = np.searchsorted(t, self.at + self.length, "right")
            move = np.flatnonzero(to < len(t))
            if not len(move):
                return
            self.at[move], self.at_id[move] = t[to[move]], ids[to[move]]

    def run(self, t, ids, final, cents, late) -> None:
        if not len(t):
            if self.open:
                self.late += len(late)
            return
        why = np.zeros(len(t), np.int8)
        why[1:] = np.where(final[:-1], 1, np.where(np.diff(t) >= self.gap, 2, 0))
        if self.last:
            why[0] = 1 if self.last[1] else 2 if t[0] - self.last[0] >= self.gap else 0
        begins = np.flatnonzero(why)
        if not self.open:
            begins = begins if why[0] else np.r_[0, begins]
        edges = np.r_[0, begins] if not len(begins) or begins[0] else begins
        stops = np.r_[edges[1:], len(t)]
        since = t[edges].copy()
        if self.open and not why[0]:
            since[0] = self.open[0]
        more = []
        for k in np.flatnonzero(t[stops - 1] - since > self.length).tolist():
            low, stop, start = int(edges[k]), int(stops[k]), int(since[k])
            while (low := low + int(np.searchsorted(t[low:stop], start + self.length, "right"))) < stop:
                more.append(low)
                start = int(t[low])
        why[more] = 3
        starts = np.sort(np.r_[begins, np.array(more, np.int64)]).astype(np.int64)
        text = pa.array(ids).cast(pa.string())
        joined = lambda low, high: ",".join(text[low:high].to_pylist())
        ends = np.r_[starts, len(t)]
        lates = np.searchsorted(late, t[starts], "left")
        if self.open:
            self.grow(t, final, cents, joined, 0, int(ends[0]), int(lates[0]) if len(starts) else len(late))
        if len(starts):
            if self.open:
                self.close(REASONS[why[starts[0]]])
            if len(starts) > 1:
                lists = pa.ListArray.from_arrays(pa.array(starts.astype(np.int32) - int(starts[0])), text[int(starts[0]) : int(starts[-1])])
                digests = [hashlib.sha256(x.encode()).hexdigest() for x in pc.binary_join(lists, ",").to_pylist()]
                sums = np.add.reduceat(cents[: starts[-1]], starts[:-1])
                self.out.many(
                    len(starts) - 1, kind=SESSION, client_id=self.client, session_id=ids[starts[:-1]].tolist(), start_us=t[starts[:-1]].tolist(), end_us=t[starts[1:] - 1].tolist(), n_clicks=np.diff(starts).tolist(),
                    n_late=np.diff(lates).tolist(), value_cents=sums.tolist(), closed_by=REASONS[why[starts[1:]]].tolist(), text=digests,
                )
            self.begin(int(t[starts[-1]]), int(ids[starts[-1]]))
            self.started_here = True
            self.grow(t, final, cents, joined, int(starts[-1]), len(t), len(late) - int(lates[-1]))
        self.last = (int(t[-1]), bool(final[-1]))

    def grow(self, t, final, cents, joined, low: int, high: int, late: int) -> None:
        self.late += late
        if high > low:
            self.n, self.cents, self.end = self.n + high - low, self.cents + int(cents[low:high].sum()), (int(t[high - 1]), bool(final[high - 1]))
            self.ids.append(joined(low, high))

    def close(self, reason: str | None) -> None:
        """Gives out the open session: whole, or what this slice has of it."""
        start, session = self.open
        own = {"client_id": self.client, "session_id": session, "start_us": start, "end_us": self.end and self.end[0], "n_clicks": self.n, "n_late": self.late, "value_cents": self.cents, "closed_by": reason}
        if (self.piece and not self.started_here) or reason is None:
            self.out.add(kind=PIECE, slice=self.slice, final=self.end and self.end[1], text=",".join(self.ids), **own)
        else:
            self.out.add(kind=SESSION, text=hashlib.sha256(",".join(self.ids).encode()).hexdigest(), **own)

    def done(self) -> None:
        if self.cut:  # the state that this slice hands on; seen events, first and last time, and whether there is a hard break inside
            own = {"kind": SLICE, "client_id": self.client, "slice": self.slice, "n_clicks": self.seen, "start_us": self.first, "end_us": self.last and self.last[0], "final": self.last and self.last[1], "n_late": int(not self.waiting)}
            if self.waiting:
                self.out.add(blob=np.concatenate([self.thresholds, self.at, self.at_id]).tobytes(), **own)
            else:
                self.out.add(value_cents=self.open[0], session_id=self.open[1], **own)
        if self.open:
            if self.piece:
                self.close(("end" if self.last[1] else "gap") if self.more else None)
            elif self.cut:
                self.close(None)
            else:
                self.close("end" if self.end[1] else "none")


def _walked(make, columns: int):
    """Feeds batches (client, slice, time, id, late, final, cents, further) that come sorted to one walk a (client, slice); events of one
    moment are fed together.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, walk, key, held = Rows(), None, None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([held, table]) if held is not None else table
            client, part, us = (table.column(i).to_numpy() for i in range(3))
            new = np.flatnonzero(np.r_[True, (client[1:] != client[:-1]) | (part[1:] != part[:-1])])
            rest = int(np.searchsorted(us[new[-1] :], us[-1], "left")) + int(new[-1])
            cells = [table.column(i).to_numpy() for i in range(3, columns)]
            for low, high in zip(new.tolist(), [*new[1:].tolist(), rest], strict=True):
                if (client[low], part[low]) != key:
                    if walk:
                        walk.done()
                    key, walk = (client[low], part[low]), make(out, table, low)
                if high > low:
                    walk.feed(us[low:high], *(c[low:high] for c in cells))
            held = table.slice(rest)
            yield from out.take(5000)
        if walk:
            walk.feed(*(held.column(i).to_numpy() for i in range(2, columns)))
            walk.done()
        yield from out.take()

    return work


def _first_pass(gap: int, length: int):
    def make(out, table, low):
        client, part = table.column(0)[low].as_py(), table.column(1)[low].as_py()
        return Walk(out, client, max(part, 0), gap, length, part >= 0)

    return _walked(make, 7)


def _edges(gap: int, length: int):
    def make(out, table, low):
        client, part = table.column(0)[low].as_py(), table.column(1)[low].as_py()
        at, at_id, last, last_final, inside = (table.column(i)[low].as_py() for i in range(7, 12))
        return Walk(out, client, part, gap, length, False, None if at is None else (at, at_id), None if last is None else (last, last_final), True, inside)

    return _walked(make, 7)


def _open(blob: bytes | None) -> list[np.ndarray]:
    return list(np.frombuffer(blob or b"", np.int64).reshape(3, -1))


def _moved(state: tuple, slope: list[np.ndarray], length: int) -> tuple:
    """The running sessions (starts, ids) after a slice with this map; one that the slice has no event beyond stays."""
    at, at_id = state
    thresholds, to, to_id = slope
    k = np.searchsorted(thresholds, at + length, "right")
    stay = k == len(thresholds)
    k = np.where(stay, 0, k)
    return (at, at_id) if not len(thresholds) else (np.where(stay, at, to[k]), np.where(stay, at_id, to_id[k]))


def _compose(length: int):
    """Rows (client, pos, blob, lo, settled, at, at_id, blob of the slices before) to rows of STATE that reach to the earlier lo."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for client, pos, own, lo, settled, at, at_id, before in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                slope = _open(own)
                if settled:
                    if at is not None:
                        at, at_id = (int(x[0]) for x in _moved((np.array([at]), np.array([at_id])), slope, length))
                    made.append((client, pos, lo, True, at, at_id, None))
                    continue
                first = _open(before)
                to, to_id = _moved((first[1], first[2]), slope, length)
                both = [np.r_[first[0], slope[0]], np.r_[to, slope[1]], np.r_[to_id, slope[2]]]
                if len(both[0]):
                    n = int(np.searchsorted(both[0], both[0][0] + length, "right")) + 1
                    both = [x[:n] for x in both]
                made.append((client, pos, lo, False, None, None, np.concatenate(both).tobytes()))
            types = [pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made, strict=True), types, strict=True)] if made else [pa.array([], t) for t in types], [x.split()[0] for x in STATE.split(", ")])

    return work


def _settled(slices: DataFrame, gap: int, length: int) -> DataFrame:
    """(client_id, slice, at, at_id, last, last_final, inside): the session that runs into each slice, and the last timely event before it."""
    order = Window.partitionBy("client_id").orderBy("slice")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    own = slices.select(
        "client_id", "slice", "start_us", (F.col("n_late") == 1).alias("inside"), F.row_number().over(order).alias("pos"), F.last("end_us", True).over(before).alias("last"), F.last("final", True).over(before).alias("last_final"),
        F.col("value_cents").alias("at"), F.col("session_id").alias("at_id"), "blob",
    )
    own = io.stored(own, "slices")
    alone = F.col("start_us").isNotNull() & (F.col("last").isNull() | F.col("last_final") | (F.col("start_us") - F.col("last") >= gap))
    begun = own.select("client_id", "pos", F.col("pos").alias("lo"), (F.col("inside") | alone | (F.col("pos") == 1)).alias("settled"), "at", "at_id", F.when(~F.col("inside"), F.col("blob")).alias("blob"))
    state = io.stored(begun.mapInArrow(_first_entry, STATE), "state")
    while state.filter("not settled").take(1):
        goal = state.filter("not settled").select("client_id", "pos", F.col("blob").alias("own"), (F.col("lo") - 1).alias("to"))
        reach = state.select("client_id", F.col("pos").alias("to"), "lo", "settled", "at", "at_id", "blob")
        wider = goal.join(reach, ["client_id", "to"]).select("client_id", "pos", "own", "lo", "settled", "at", "at_id", "blob").mapInArrow(_compose(length), STATE)
        past, state = state, io.stored(state.filter("settled").unionByName(wider), "state")
        io.remove(past)
    out = own.select("client_id", "slice", "pos", "last", "last_final", "inside").join(state.select("client_id", (F.col("pos") + 1).alias("pos"), "at", "at_id"), ["client_id", "pos"], "left")
    out = io.stored(out.select("client_id", "slice", "at", "at_id", "last", "last_final", "inside"), "entries")
    io.remove(own, state)
    return out


def _first_entry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A settled slice without a break inside hands out the session that its own first event, a session's first, comes to."""
    for batch in batches:
        rows = []
        for client, pos, lo, settled, at, at_id, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if settled and blob:
                _, to, to_id = _open(blob)
                at, at_id, blob = int(to[0]), int(to_id[0]), None
            rows.append((client, pos, lo, settled, at, at_id, blob))
        if rows:
            types = [pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], batch.schema.names)


def _bounds(times: DataFrame, hot_share: int, least_rows: int) -> DataFrame | None:
    """(client_id, bounds) of the hot clients, the times at which their slices begin; None if there are none. At most hot_share rows."""
    counts = times.groupBy("client_id").agg(F.count("*").alias("n"))
    counts = io.stored(counts, "counts")
    total = counts.agg(F.sum("n")).first()[0] or 0
    line = max(least_rows, total // hot_share)
    hot = counts.filter(F.col("n") > line)
    if not hot.take(1):
        io.remove(counts)
        return None
    grid = [i / 1000 for i in range(1, 1000)]
    parts = F.least(F.ceil(F.col("n") / line), F.lit(1000)).cast("int")
    quantiles = times.join(F.broadcast(hot), "client_id").groupBy("client_id", "n").agg(F.percentile_approx("us", grid, 5000).alias("q"))
    picked = F.transform(F.sequence(F.lit(1), F.lit(999)), lambda i: F.when(F.floor(i * F.col("parts") / 1000) > F.floor((i - 1) * F.col("parts") / 1000), F.get(F.col("q"), i - 1)))
    bounds = quantiles.withColumn("parts", parts).select("client_id", F.array_sort(F.array_distinct(F.array_compact(picked))).alias("bounds"))
    out = io.stored(bounds, "bounds")
    io.remove(counts)
    return out


def sessions(
    events: DataFrame, id_col: str = "click_id", client_col: str = "client_id", time_col: str = "ts", arrival_col: str = "arrived_at", kind_col: str = "kind", value_col: str = "value", gap: int = 30 * MINUTE, length: int = 120 * MINUTE,
    late: int = 60 * MINUTE, final_kind: str = "purchase", final_value: float = 60.0, hot_share: int = HOT_SHARE, least_rows: int = LEAST_ROWS,
) -> DataFrame:
    """One row per session: client_id, session_id, start_us, end_us, n_clicks, n_late, value_cents, closed_by, path_sha256. Times are microseconds."""
    io.bound_batches(events.sparkSession)
    us, value = micros(events, time_col), F.col(value_col).cast("double")
    good = value.isNotNull() & ~F.isnan(value) & (F.abs(value) < 9e16)
    base = events.select(
        F.col(id_col).cast("long").alias("id"), F.col(client_col).cast("long").alias("client_id"), us.alias("us"), F.coalesce(micros(events, arrival_col) - us > late, F.lit(False)).alias("late"),
        F.coalesce((F.col(kind_col) == final_kind) & good & (value >= final_value), F.lit(False)).alias("final"), F.when(good, F.floor(value * 100 + 0.5)).otherwise(0).cast("long").alias("cents"),
    ).filter("id is not null and client_id is not null and us is not null")
    bounds = _bounds(base.select("client_id", "us"), hot_share, least_rows)
    once = base.groupBy("id").agg(F.min(F.struct("us", "client_id", "late", "final", "cents")).alias("e")).select("id", "e.*")
    if bounds is None:
        dealt = once.withColumn("slice", F.lit(-1))
    else:
        heads = bounds.select("client_id", "bounds", F.filter("bounds", lambda b, i: i % GROUP == 0).alias("heads"))
        low = F.greatest(F.size(F.filter("heads", lambda b: b <= F.col("us"))) - 1, F.lit(0)) * GROUP
        part = low + F.size(F.filter(F.slice("bounds", low + 1, F.lit(GROUP)), lambda b: b <= F.col("us")))
        dealt = once.join(F.broadcast(heads), "client_id", "left").withColumn("slice", F.when(F.col("bounds").isNull(), -1).otherwise(part)).drop("bounds", "heads")
    rows = dealt.select("client_id", "slice", "us", "id", "late", "final", "cents").repartition("client_id", "slice").sortWithinPartitions("client_id", "slice", "us", "id")
    found = io.stored(rows.mapInArrow(blocks.tidy(_first_pass(gap, length)), FOUND), "found")
    whole = ["client_id", "session_id", "start_us", "end_us", "n_clicks", "n_late", "value_cents", "closed_by", F.col("text").alias("path_sha256")]
    if bounds is None:
        return found.filter(F.col("kind") == SESSION).select(*whole)
    entries = _settled(found.filter(F.col("kind") == SLICE), gap, length)
    edge = found.filter(F.col("kind") == EVENT).select("client_id", "slice", F.col("start_us").alias("us"), F.col("session_id").alias("id"), (F.col("n_late") == 1).alias("late"), "final", F.col("value_cents").alias("cents"))
    edge = edge.join(F.broadcast(entries), ["client_id", "slice"]).select("client_id", "slice", "us", "id", "late", "final", "cents", "at", "at_id", "last", "last_final", "inside")
    mended = io.stored(edge.repartition("client_id", "slice").sortWithinPartitions("client_id", "slice", "us", "id").mapInArrow(blocks.tidy(_edges(gap, length)), FOUND), "mended")
    io.remove(entries, bounds)
    pieces = found.filter(F.col("kind") == PIECE).unionByName(mended.filter(F.col("kind") == PIECE))
    filled = F.filter(F.array_sort(F.collect_list(F.struct("slice", "text"))), lambda p: p["text"] != "")
    joined = pieces.groupBy("client_id", "session_id", "start_us").agg(
        F.max("end_us").alias("end_us"), F.sum("n_clicks").alias("n_clicks"), F.sum("n_late").alias("n_late"), F.sum("value_cents").alias("value_cents"), F.max("closed_by").alias("closed_by"),
        F.max_by("final", F.when(F.col("n_clicks") > 0, F.col("slice"))).alias("final"), F.sha2(F.array_join(F.transform(filled, lambda p: p["text"]), ","), 256).alias("path_sha256"),
    )
    joined = joined.withColumn("closed_by", F.coalesce("closed_by", F.when(F.col("final"), "end").otherwise("none")))
    done = found.filter(F.col("kind") == SESSION).unionByName(mended.filter(F.col("kind") == SESSION)).select(*whole)
    return done.unionByName(joined.select(*done.columns))


def op13_gap_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions(spark.read.parquet(f"{sf_dir}/clicks.parquet"))


SQL = """
WITH RECURSIVE once AS (
  SELECT DISTINCT ON (click_id) click_id AS id, client_id, epoch_us(ts) AS us, coalesce(epoch_us(arrived_at) - epoch_us(ts) > 3600000000, false) AS late,
         coalesce(kind = 'purchase' AND value >= 60, false) AS final, coalesce(floor(100 * value + 0.5), 0)::BIGINT AS cents
  FROM clicks WHERE click_id IS NOT NULL AND client_id IS NOT NULL AND ts IS NOT NULL ORDER BY click_id, ts, client_id
), broken AS (
  SELECT *, CASE WHEN lag(final) OVER w THEN 'end' WHEN us - lag(us) OVER w >= 1800000000 THEN 'gap' END AS why, lag(id) OVER w IS NULL AS first
  FROM once WHERE NOT late WINDOW w AS (PARTITION BY client_id ORDER BY us, id)
), runs AS (
  SELECT *, sum((first OR why IS NOT NULL)::INT) OVER (PARTITION BY client_id ORDER BY us, id ROWS UNBOUNDED PRECEDING) AS run FROM broken
), moments AS (
  SELECT client_id, run, us, min(id) AS id FROM runs GROUP BY ALL
), hops AS MATERIALIZED (
  SELECT client_id, run, us, min(us) OVER w AS next_us, arg_min(id, us) OVER w AS next_id FROM moments
  WINDOW w AS (PARTITION BY client_id, run ORDER BY us RANGE BETWEEN 7200000001 FOLLOWING AND UNBOUNDED FOLLOWING)
), starts AS (
  SELECT client_id, run, us, id, why FROM runs WHERE first OR why IS NOT NULL
  UNION ALL
  SELECT h.client_id, h.run, h.next_us, h.next_id, 'length' FROM starts s JOIN hops h ON s.client_id = h.client_id AND s.run = h.run AND s.us = h.us WHERE h.next_us IS NOT NULL
), spans AS (
  SELECT *, lead(us) OVER w AS until, lead(why) OVER w AS next_why, row_number() OVER w AS k FROM starts WINDOW w AS (PARTITION BY client_id ORDER BY us, id)
), placed AS (
  SELECT r.*, count(s.id) OVER (PARTITION BY r.client_id ORDER BY r.us, r.id ROWS UNBOUNDED PRECEDING) AS k
  FROM runs r LEFT JOIN starts s ON r.client_id = s.client_id AND r.id = s.id
), lates AS (
  SELECT s.client_id, s.k, count(*) AS n FROM once o JOIN spans s ON o.client_id = s.client_id AND o.us >= s.us AND (s.until IS NULL OR o.us < s.until) WHERE o.late GROUP BY ALL
), sums AS (
  SELECT client_id, k, max(us) AS end_us, count(*) AS n_clicks, sum(cents)::BIGINT AS value_cents, arg_max(final, struct_pack(us := us, id := id)) AS ended,
         sha256(string_agg(id::VARCHAR, ',' ORDER BY us, id)) AS path_sha256
  FROM placed GROUP BY ALL
)
SELECT s.client_id, s.id AS session_id, s.us AS start_us, m.end_us, m.n_clicks, coalesce(l.n, 0) AS n_late, m.value_cents,
       coalesce(s.next_why, CASE WHEN m.ended THEN 'end' ELSE 'none' END) AS closed_by, m.path_sha256
FROM spans s JOIN sums m USING (client_id, k) LEFT JOIN lates l USING (client_id, k)
"""
