"""The keeper of life-cycle status: what it does to its state, call by call, and odd rows through a stream."""

import datetime as dt
import random
import zlib

import pandas as pd
import pytest

from chronoweave.operators.lifecycle import TARGET_STATUS
from chronoweave.streaming import status

KINDS = [*TARGET_STATUS, "other", None]


class Store:
    """Stands in for the state store: values by group, and the number of calls."""

    def __init__(self):
        self.calls, self.key, self.held, self.timers = 0, None, {}, set()

    def getValueState(self, name, schema):
        return Value(self, name)

    def getMapState(self, name, key, value):
        return Value(self, name)

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add((self.key, at))


class Value:
    def __init__(self, store, name):
        self.store, self.name = store, name

    def at(self, key=None):
        self.store.calls += 1
        return (self.store.key, self.name, key)

    def exists(self):
        return self.at() in self.store.held

    def get(self):
        return self.store.held[self.at()]

    def update(self, value):
        self.store.held[self.at()] = value

    def getValue(self, key):
        return self.store.held.get(self.at(key))

    def updateValue(self, key, value):
        self.store.held[self.at(key)] = value


class Timers:
    def __init__(self, now):
        self.now = now

    def getCurrentWatermarkInMs(self):
        return self.now // 1000


def place(listing, event=None):
    """Few places, so that some listings share one."""
    return zlib.crc32(str(listing).encode()) % 1000 << 32 | (0 if event is None else zlib.crc32(str(event).encode()))


def frames(events, now, *, size=40):
    """Rows of one group as a stream brings them."""
    rows = [(place(e[0], e[1] or "-"), *e, now) for e in events]
    columns = ["place", "listing_id", "event_id", "event_type", "available", "effective", "clock"]
    return iter([pd.DataFrame(rows[i:i + size], columns=columns) for i in range(0, len(rows), size)])


def run(store, events, now):
    """Changes of one batch: timers that the clock has passed come after the rows."""
    keeper, out = status.StatusKeeper(), []
    keeper.init(store)
    store.key = 0
    if events:
        out += keeper.handleInputRows((0,), frames(events, now), Timers(now))
    return out + fire(store, now)


def fire(store, now):
    keeper, out = status.StatusKeeper(), []
    keeper.init(store)
    for timer in sorted(t for t in store.timers if t[1] * 1000 <= now):
        store.timers.remove(timer)
        out += keeper.handleExpiredTimer((0,), Timers(now), None)
    return out


def expected(events, initial, now):
    """Status, event and time of a listing from its events by id."""
    due = [(effective, available, name, kind) for name, (kind, available, effective) in events.items() if max(available, effective) <= now and kind in TARGET_STATUS]
    decided = [e for e in due if not e[3].startswith("status_observed_")]
    seen = [e for e in due if e[3].startswith("status_observed_")]
    by = lambda e: (e[0], e[1], e[2] is not None, e[2] or "")
    winner = max(decided, key=by) if decided else min(seen, key=by) if seen and initial == "unknown" else None
    return (initial, None, None) if winner is None else (TARGET_STATUS[winner[3]], winner[2], winner[0])


@pytest.mark.parametrize("seed", range(4))
def test_keeper_follows_a_plain_fold_through_replays_corrections_and_waiting_events(monkeypatch, seed):
    monkeypatch.setattr(status, "PAGE", 8)
    monkeypatch.setattr(status, "BLOCK", 60)
    random.seed(seed)
    store, model, shown, count = Store(), {}, {}, {}
    initial = {f"L{i}": random.choice(["active", "unknown", None]) for i in range(12)}
    keeper = status.StatusKeeper()
    keeper.init(store)
    store.key = 0
    given = [(place(x), x, s) for x, s in initial.items() if s is not None]
    keeper.handleInitialState((0,), pd.DataFrame(given, columns=["place", "listing_id", "initial_status"]), None)
    listings = [*initial, "late", None]
    first = {x: initial.get(x) or "unknown" for x in listings}
    now = 1_000_000
    for _ in range(25):
        now += random.randint(1, 400) * 1000
        batch = []
        for _ in range(random.choice([0, 1, 3, 50, 200])):
            listing = "L0" if random.random() < 0.4 else random.choice(listings)
            held = model.get(listing, {})
            name = random.choice([*held]) if held and random.random() < 0.3 else random.choice([None, f"e{random.randint(0, 10**6)}", f"e{random.randint(0, 10**6)}"])
            event = (random.choice(KINDS), random.randint(0, 30) * 50_000, random.randint(0, 30) * 50_000)
            if name in held and random.random() < 0.4:
                event = held[name]
            batch.append((listing, name, *event))
            if name not in held or event[1] >= held[name][1]:
                model.setdefault(listing, {})[name] = event
        out = run(store, batch, now)
        for frame in out:
            for row in frame.astype(object).where(frame.notna(), None).itertuples(index=False):
                count[row.listing_id] = count.get(row.listing_id, 0) + 1
                assert row.change == count[row.listing_id]
                assert shown.get(row.listing_id) != tuple(row)[2:]
                shown[row.listing_id] = tuple(row)[2:]
        # a timer fires at the full millisecond
        assert {x: shown.get(x, (first[x], None, None)) for x in model} == {x: expected(model[x], first[x], now) for x in model}


def test_a_batch_takes_few_calls_to_the_store_and_touches_its_own_pages_only():
    store = Store()
    events = [(f"L{i % 1000}", f"e{i}", KINDS[i % 7], i, i) for i in range(20_000)]
    run(store, events, 10**9)
    assert store.calls < 100  # before: several for each event
    assert max(len(held[0]) for held in store.held.values()) < 200 * status.PAGE
    store.calls, before = 0, dict(store.held)
    changes = run(store, [("L7", "new", "delisted", 30_000, 30_000)], 10**9 + 1)
    assert [tuple(x) for frame in changes for x in frame.itertuples(index=False)] == [("L7", 2, "delisted", "new", 30_000)]
    assert store.calls < 15 and sum(before[x] != store.held[x] for x in before) <= 4


def test_one_listing_of_very_many_events_is_cut_into_pages():
    store = Store()
    run(store, [("L", f"e{i}", "listed", i, i) for i in range(30_000)], 10**9)
    store.calls = 0
    out = run(store, [("L", "e29999", "other", 40_000, 29_999)], 10**9 + 1)  # the deciding event is corrected
    assert [tuple(x)[2:4] for x in out[0].itertuples(index=False)] == [("active", "e29998")]
    store.calls = 0
    run(store, [("L", "e5", "listed", 5, 5)], 10**9 + 2)  # a replay reads the one page
    assert store.calls < 12


LIFE = "event_id string, listing_id string, event_type string, event_time string, available_time string, effective_time string"


def test_odd_rows_through_a_stream(spark, tmp_path):
    listings = spark.createDataFrame([("A", "suspended"), ("B", None), ("C", None), ("Q", "active")], "listing_id string, initial_status string")
    day = lambda n: [f"2026-01-{n:02d}"] * 3
    batches = [
        [("1", "A", "listed", *day(1)), ("2", "A", "status_observed_delisted", *day(2)), ("3", "B", None, *day(1)), (None, "C", "listed", *day(1)), ("5", None, "listed", *day(1))],
        # A's one structural event turns out to be none; C's event without id comes again, later known, as another
        [("1", "A", "other", "2026-01-01", "2026-01-09", "2026-01-01"), (None, "C", "delisted", "2026-01-01", "2026-01-03", "2026-01-01"), ("6", "B", "status_observed_active", *day(4)), ("6", "B", "status_observed_active", *day(4))],
    ]
    for rows in batches:
        spark.createDataFrame(rows, LIFE).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        events = spark.readStream.schema(LIFE).parquet(str(tmp_path / "in"))
        status.status_writer(events, listings, str(tmp_path / "out"), str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    changes = spark.read.parquet(str(tmp_path / "out"))
    got = {(r["listing_id"], r["change"]): tuple(r)[2:] for r in changes.select("listing_id", "change", "lifecycle_status", "status_event_id", "status_effective_time").collect()}
    first = dt.datetime(2026, 1, 1)
    assert got == {
        ("A", 1): ("active", "1", first), ("A", 2): ("suspended", None, None), ("B", 1): ("observed_active_candidate", "6", dt.datetime(2026, 1, 4)),
        ("C", 1): ("active", None, first), ("C", 2): ("delisted", None, first), (None, 1): ("active", "5", first),
    }
    assert {r["listing_id"]: r["lifecycle_status"] for r in status.current_status(listings, changes).collect()} == {"A": "suspended", "B": "observed_active_candidate", "C": "delisted", "Q": "active"}
