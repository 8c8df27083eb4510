"""Life-cycle status kept current in a keyed state store.

The state of a listing is its events by id, the structural event that decides and the first observed one. A new event is folded
into these two once; one that comes again changes nothing, and one that comes again corrected (known later) makes the listing's
events be folded anew. Events that are not known or effective yet wait in the state with a timer and are folded when it fires. The
clock is the time at which rows are read, one per batch; it is also the watermark, so no event is ever too late, and a stream that
is run to its end stops (with timers on the processing time Spark would go on running empty batches).
What comes out is a row per change of a listing's status, numbered per listing, to be appended; nothing written is read or
rewritten, whatever the number of listings a batch touches.

A call from Python to the state store costs far more than the work on an event. Listings are therefore dealt to ``GROUPS`` groups by
hash; a group is a key of the store and holds its rows in sorted pages, so a call moves up to ``PAGE`` rows. A batch reads and writes
the pages of the listings and events it brings and no others, however many listings a group has or events a listing.

The order of arrival does not matter: the last structural event by (effective, available, id) decides, and the first observed one
counts only where there is none and the initial status is unknown, as in ``lifecycle.listing_status``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle

from chronoweave.functions.latest import last_per_key
from chronoweave.operators.lifecycle import TARGET_STATUS, TIMES
from chronoweave.functions.times import with_instants
from chronoweave.session import prepare, workers_find_library

UNKNOWN = "unknown"
CHANGES = "listing_id string, change long, lifecycle_status string, status_event_id string, since long"
#: Groups of listings; a checkpoint holds for this number only. More give more tasks at most, fewer give fuller pages.
GROUPS = 2048
#: Most rows of a page, and rows of a group that are worked on at once.
PAGE, BLOCK = 1024, 250_000
#: A place is the upper half of the listing's hash, then, for events, the lower half of the event's.
LISTING_PART = ~0xFFFFFFFF
NEVER, NO_TIME, LEAST = 2**63 - 1, -(2**63), -(2**63)
#: Times are microseconds since 1970 inside the state, so no worker's zone can shift them.
EVENTS = {"place": "int64", "listing_id": "string", "event_id": "string", "event_type": "string", "available": "int64", "effective": "int64", "folded": "bool"}
#: What decides and what was seen first have a status where there is such an event; shown is what came out with the last change.
RANKED = {"effective": "int64", "available": "int64", "event_id": "string", "status": "string"}
LISTINGS = {
    "place": "int64", "listing_id": "string", "initial": "string",
    **{f"decided_{name}": kind for name, kind in RANKED.items()}, **{f"seen_{name}": kind for name, kind in RANKED.items()},
    "change": "int64", "shown_status": "string", "shown_event_id": "string", "shown_since": "int64",
}
DIRECTORY = {"first": "int64", "page": "int64", "due": "int64"}

Rows = dict[str, np.ndarray]


def _schema(fields: dict[str, str]) -> pa.Schema:
    return pa.schema([(name, pa.type_for_alias(kind)) for name, kind in fields.items()])


def _encoded(rows: Rows, fields: dict[str, str]) -> bytes:
    schema = _schema(fields)
    return pa.record_batch([pa.array(rows[field.name], field.type) for field in schema], schema=schema).serialize().to_pybytes()


def _decoded(held: bytes, fields: dict[str, str]) -> Rows:
    batch = pa.ipc.read_record_batch(pa.py_buffer(bytes(held)), _schema(fields))
    return {name: batch.column(i).to_numpy(zero_copy_only=False) for i, name in enumerate(fields)}


def _blank(fields: dict[str, str], n: int) -> Rows:
    return {name: np.full(n, None, object) if kind == "string" else np.zeros(n, kind) for name, kind in fields.items()}


def _taken(rows: Rows, which: np.ndarray | slice) -> Rows:
    return {name: values[which] for name, values in rows.items()}


def _joined(parts: list[Rows], fields: dict[str, str]) -> Rows:
    if len(parts) == 1:
        return {name: parts[0][name] for name in fields}
    return {name: np.concatenate([part[name] for part in parts]) for name in fields} if parts else _blank(fields, 0)


def _codes(*ids: np.ndarray) -> np.ndarray:
    """A number per id, equal for equal ids (also for null ones), in the order in which they first come."""
    return pd.factorize(np.concatenate(ids), use_na_sentinel=False)[0]


def _due(rows: Rows) -> np.ndarray:
    return np.maximum(rows["available"], rows["effective"])


def _targets(kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The status that each event leads to, and whether it is an observed one."""
    codes, names = pd.factorize(kinds, use_na_sentinel=False)
    status, observed = np.empty(len(names), object), np.zeros(len(names), bool)
    for i, name in enumerate(names):
        status[i] = TARGET_STATUS.get(name)
        observed[i] = status[i] is not None and name.startswith("status_observed_")
    return status[codes], observed[codes]


def _outermost(codes: np.ndarray, ranked: Rows, *, last: bool) -> np.ndarray:
    """Per code the index of its last (or first) row by (effective, available, event_id)."""
    order = np.lexsort((ranked["available"], ranked["effective"], codes))
    if not last:
        order = order[::-1]
    if not len(order):
        return order
    code, effective, available = codes[order], ranked["effective"][order], ranked["available"][order]
    ends = np.flatnonzero(np.append(code[1:] != code[:-1], True))
    tied = np.append(False, (code[1:] == code[:-1]) & (effective[1:] == effective[:-1]) & (available[1:] == available[:-1]))
    picked = order[ends]
    best = max if last else min
    for i in np.flatnonzero(tied[ends]):
        start = end = ends[i]
        while tied[start]:
            start -= 1
        picked[i] = best(order[start:end + 1], key=lambda x: (ranked["event_id"][x] is not None, ranked["event_id"][x] or ""))
    return picked


class Pages:
    """Rows of a group, sorted by place and cut into pages; the directory holds the first place of each page.

    Pages are read when they are asked for and written by ``flush``. A page that grows beyond ``PAGE`` rows is cut, but never
    between rows of the same place. The directory also has the earliest time at which a row of the page is due.
    """

    def __init__(self, handle: StatefulProcessorHandle, name: str, fields: dict[str, str]):
        self.fields = fields
        self.directory = handle.getValueState(f"{name}_directory", "pages binary")
        self.pages = handle.getMapState(f"{name}_pages", "page long", "rows binary")

    def open(self) -> None:
        self.index = _decoded(self.directory.get()[0], DIRECTORY) if self.directory.exists() else _blank(DIRECTORY, 0)
        self.stored = self.index
        self.next = int(self.index["page"].max(initial=-1)) + 1
        self.loaded: dict[int, Rows] = {}
        self.changed: set[int] = set()

    def of(self, places: np.ndarray) -> np.ndarray:
        """Numbers of the pages, in their order, that these places belong to."""
        if not len(self.index["page"]):
            return np.zeros(0, int)
        return np.unique(np.searchsorted(self.index["first"], places, side="right") - 1)

    def between(self, low: int, high: int) -> range:
        """Numbers of the pages that may hold places from ``low`` to ``high``."""
        start, end = np.searchsorted(self.index["first"], [low, high], side="right") - 1
        return range(int(start), int(end) + 1)

    def get(self, numbers) -> Rows:
        parts = []
        for page in self.index["page"][np.asarray(numbers, int)].tolist():
            if page not in self.loaded:
                self.loaded[page] = _decoded(self.pages.getValue((page,))[0], self.fields)
            parts.append(self.loaded[page])
        return _joined(parts, self.fields)

    def put(self, numbers: np.ndarray, rows: Rows, waiting: np.ndarray | None = None) -> None:
        """These rows take the place of all rows of these pages; ``waiting`` has the times at which they are due."""
        if not len(rows["place"]):
            return
        order = np.argsort(rows["place"], kind="stable")
        rows = _taken(rows, order)
        waiting = np.full(len(order), NEVER) if waiting is None else waiting[order]
        place = rows["place"]
        firsts, pages = (self.index["first"][numbers], self.index["page"][numbers]) if len(numbers) else (np.array([LEAST]), np.array([-1]))
        cuts = np.append(np.searchsorted(place, firsts), len(place))
        made: list[tuple[int, int, int]] = []
        for first, page, start, end in zip(firsts.tolist(), pages.tolist(), cuts[:-1].tolist(), cuts[1:].tolist()):
            pieces = 1 if end - start <= PAGE else -(-(end - start) * 4 // (PAGE * 3))
            inner = {int(np.searchsorted(place, place[start + (end - start) * k // pieces])) for k in range(1, pieces)}
            bounds = [start, *sorted(x for x in inner if x > start), end]
            for a, b in zip(bounds[:-1], bounds[1:]):
                if a > start or page < 0:
                    first, page, self.next = int(place[a]) if a > start else first, self.next, self.next + 1
                self.loaded[page] = _taken(rows, slice(a, b))
                self.changed.add(page)
                made.append((first, page, int(waiting[a:b].min(initial=NEVER))))
        kept = np.ones(len(self.index["page"]), bool)
        kept[numbers] = False
        whole = {name: np.append(self.index[name][kept], np.array([x[i] for x in made], "int64")) for i, name in enumerate(DIRECTORY)}
        self.index = _taken(whole, np.argsort(whole["first"], kind="stable"))

    def flush(self) -> None:
        if self.changed:
            for page in sorted(self.changed):
                self.pages.updateValue((page,), (_encoded(self.loaded[page], self.fields),))
        if any(not np.array_equal(self.index[name], self.stored[name]) for name in DIRECTORY):
            self.directory.update((_encoded(self.index, DIRECTORY),))
            self.stored = self.index
        self.loaded, self.changed = {}, set()


def _blocks(frames) -> Iterator[Rows]:
    """Rows of data frames, in blocks of about ``BLOCK``."""
    held, n = [], 0
    for frame in frames:
        held.append({name: frame[name].to_numpy() for name in frame.columns})
        n += len(frame)
        if n >= BLOCK:
            yield _joined(held, held[0])
            held, n = [], 0
    if held:
        yield _joined(held, held[0])


class StatusKeeper(StatefulProcessor):
    """Folds the events of the listings of one group."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.events = Pages(handle, "events", EVENTS)
        self.listings = Pages(handle, "listings", LISTINGS)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        self._open()
        for given in _blocks([initialState]):
            pages, rows, at = self._listings(given["place"], given["listing_id"])
            rows["initial"][at] = given["initial_status"]
            self.listings.put(pages, rows)
        self._close()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        self._open()
        touched = [self._take(block, int(block["clock"].max())) for block in _blocks(rows)]
        changes = self._changes(touched)
        self._close()
        yield from changes

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        self._open()
        touched = [self._fold(ready, ready) for ready in self._ready(np.flatnonzero(self.events.index["due"] <= now), now)]
        changes = self._changes(touched)
        self._close()
        yield from changes

    def _open(self) -> None:
        self.events.open()
        self.listings.open()

    def _close(self) -> None:
        self.events.flush()
        self.listings.flush()
        due = int(self.events.index["due"].min(initial=NEVER))
        if due < NEVER:
            self.handle.registerTimer(-(-due // 1000))

    def _take(self, new: Rows, now: int) -> Rows:
        """Puts a block of events into the state and folds those that are due; the listings of the block."""
        pages = self.events.of(new["place"])
        held = self.events.get(pages)
        n = len(held["place"])
        rows = _joined([held, new | {"folded": _due(new) <= now}], EVENTS)
        listing, event = _codes(rows["listing_id"]), _codes(rows["event_id"])
        name = listing * (event.max() + 1) + event
        # Per event the version that was known last, among equals the one that came last.
        order = np.lexsort((rows["available"], name))
        ends = np.append(name[order][1:] != name[order][:-1], True)
        version, known = order[ends], np.full(ends.sum(), -1)
        number = np.cumsum(ends) - ends
        known[number[order < n]] = order[order < n]
        same = np.ones(len(known), bool)
        for field in ("event_type", "available", "effective"):
            same &= rows[field][version] == rows[field][known]
        version = np.where((known >= 0) & same, known, version)
        self._put_events(pages, _taken(rows, version))
        corrected = version[(known >= 0) & (version != known)]
        corrected = corrected[np.unique(listing[corrected], return_index=True)[1]]
        fresh = version[(version >= n) & rows["folded"][version] & ~np.isin(listing[version], listing[corrected])]
        due, anew = _taken(rows, fresh), _taken(rows, corrected)
        if len(corrected):
            due = _joined([due, *self._due_again(anew, now)], EVENTS)
        self.events.flush()
        return self._fold(due, new, anew["listing_id"])

    def _put_events(self, pages: np.ndarray, rows: Rows) -> None:
        self.events.put(pages, rows, np.where(rows["folded"], NEVER, _due(rows)))

    def _ready(self, pages: np.ndarray, now: int, of: np.ndarray | None = None) -> Iterator[Rows]:
        """Due events of these pages that were not folded yet, or else all due ones of the listings ``of``; they count as folded now."""
        step = max(1, BLOCK // PAGE)
        for end in range(len(pages), 0, -step):  # from the last, since cutting a page moves the later ones
            some = pages[max(0, end - step):end]
            rows = self.events.get(some)
            ready = _due(rows) <= now
            ready &= ~rows["folded"] if of is None else _codes(of, rows["listing_id"])[len(of):] < len(of)
            if not rows["folded"][ready].all():
                rows["folded"] = rows["folded"] | ready
                self._put_events(some, rows)
            yield _taken(rows, ready)
            self.events.flush()

    def _due_again(self, listings: Rows, now: int) -> Iterator[Rows]:
        """Of all due events of these listings those that may decide."""
        low = np.unique(listings["place"] & LISTING_PART).tolist()
        pages = np.unique(np.concatenate([self.events.between(x, x | ~LISTING_PART) for x in low]).astype(int))
        for rows in self._ready(pages, now, listings["listing_id"]):
            code, (status, observed) = _codes(rows["listing_id"]), _targets(rows["event_type"])
            for last, mine in ((True, ~observed), (False, observed)):
                mine = np.flatnonzero(mine & pd.notna(status))
                some = _taken(rows, mine)
                yield _taken(some, _outermost(code[mine], some, last=last))

    def _listings(self, places: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, Rows, np.ndarray]:
        """Pages of these listings, all rows of these pages with new ones for new listings, and the index of each listing's row."""
        places = places & LISTING_PART
        pages = self.listings.of(places)
        held = self.listings.get(pages)
        n = len(held["place"])
        at = _codes(held["listing_id"], ids)[n:]  # held ids come once each, so their codes are the numbers of their rows
        code, where = np.unique(at, return_index=True)
        where = where[code >= n]
        new = _blank(LISTINGS, len(where)) | {"place": places[where], "listing_id": ids[where]}
        return pages, _joined([held, new], LISTINGS), at

    def _fold(self, due: Rows, touched: Rows, anew: np.ndarray | tuple = ()) -> Rows:
        """Folds events; the listings ``anew`` forget first what decided. Returns the listings of ``touched`` once each."""
        n = len(touched["place"])
        pages, rows, at = self._listings(np.append(touched["place"], due["place"]), np.append(touched["listing_id"], due["listing_id"]))
        if len(anew):
            again = _codes(anew, rows["listing_id"])[len(anew):] < len(anew)
            rows["decided_status"][again] = rows["seen_status"][again] = None
        status, observed = _targets(due["event_type"])
        for kind, mine in (("decided", ~observed), ("seen", observed)):
            mine = mine & pd.notna(status)
            held = np.flatnonzero(pd.notna(rows[f"{kind}_status"]))
            code = np.append(held, at[n:][mine])
            ranked = {name: np.append(rows[f"{kind}_{name}"][held], (due | {"status": status})[name][mine]) for name in RANKED}
            best = _outermost(code, ranked, last=kind == "decided")
            for name in RANKED:
                rows[f"{kind}_{name}"][code[best]] = ranked[name][best]
        self.listings.put(pages, rows)
        return {name: rows[name][np.unique(at[:n])] for name in ("place", "listing_id")}

    def _changes(self, touched: list[Rows]) -> list[pd.DataFrame]:
        """A row for each of these listings whose status is not the one that came out last."""
        if not touched:
            return []
        some = _joined(touched, touched[0])
        pages, rows, at = self._listings(some["place"], some["listing_id"])
        at = np.unique(at)
        initial = np.where(pd.isna(rows["initial"][at]), UNKNOWN, rows["initial"][at])
        status, event_id, since = initial.copy(), np.full(len(at), None, object), np.full(len(at), NO_TIME)
        for kind, counts in (("seen", initial == UNKNOWN), ("decided", True)):
            won = counts & pd.notna(rows[f"{kind}_status"][at])
            for to, name in ((status, "status"), (event_id, "event_id"), (since, "effective")):
                to[won] = rows[f"{kind}_{name}"][at[won]]
        never = rows["change"][at] == 0
        shown = (np.where(never, initial, rows["shown_status"][at]), rows["shown_event_id"][at], np.where(never, NO_TIME, rows["shown_since"][at]))
        changed = (status != shown[0]) | (event_id != shown[1]) | (since != shown[2])
        at, status, event_id, since = at[changed], status[changed], event_id[changed], since[changed]
        if not len(at):
            return []
        rows["change"][at] += 1
        rows["shown_status"][at], rows["shown_event_id"][at], rows["shown_since"][at] = status, event_id, since
        self.listings.put(pages, rows)
        return [pd.DataFrame({"listing_id": rows["listing_id"][at], "change": rows["change"][at], "lifecycle_status": status, "status_event_id": event_id,
                              "since": np.where(since == NO_TIME, None, since.astype(object))})]


def _grouped(df: DataFrame, place: Column, *columns) -> DataFrame:
    return df.select(F.pmod(F.xxhash64("listing_id"), F.lit(GROUPS)).cast("int").alias("listing_group"), place.alias("place"), "listing_id", *columns)


def status_changes(events: DataFrame, listings: DataFrame | None = None) -> DataFrame:
    """Changes of status from a stream of life-cycle events. ``listings`` (a plain table) gives initial statuses.

    An event without a usable time is an error, as in the batch operator.
    """
    workers_find_library(prepare(events.sparkSession))
    typed = with_instants(events, TIMES)
    gap = F.col("event_time").isNull() | F.col("available_time").isNull() | F.col("effective_time").isNull()
    wrong = F.raise_error(F.concat(F.lit("life-cycle event times must be valid: "), F.coalesce("event_id", F.lit("?")))).cast("long")
    part = F.xxhash64("listing_id").bitwiseAND(F.lit(LISTING_PART))
    place = part.bitwiseOR(F.xxhash64("event_id").bitwiseAND(F.lit(~LISTING_PART)))
    rows = _grouped(typed, place, "event_id", "event_type", F.when(gap, wrong).otherwise(F.unix_micros("available_time")).alias("available"), F.unix_micros("effective_time").alias("effective"),
                    F.current_timestamp().alias("read_at")).withWatermark("read_at", "0 seconds").withColumn("clock", F.unix_micros("read_at"))
    given = None if listings is None else _grouped(listings.filter("initial_status IS NOT NULL"), part, "initial_status").groupBy("listing_group")
    changes = rows.groupBy("listing_group").transformWithStateInPandas(StatusKeeper(), CHANGES, "append", "EventTime", given)
    return changes.withColumn("status_effective_time", F.timestamp_micros("since")).drop("since")


def status_writer(events: DataFrame, listings: DataFrame, output: str, checkpoint: str) -> DataStreamWriter:
    """Appends the changes of status to the Parquet folder ``output``."""
    return status_changes(events, listings).writeStream.format("parquet").option("path", output).option("checkpointLocation", checkpoint).outputMode("append")


def current_status(listings: DataFrame, changes: DataFrame) -> DataFrame:
    """Listings with their status after the last change; without one, the initial status."""
    last = last_per_key(changes, ["listing_id"], [F.col("change")]).drop("change")
    status = F.coalesce("lifecycle_status", "initial_status", F.lit(UNKNOWN))
    return listings.join(last, "listing_id", "left").withColumn("lifecycle_status", status)
