"""Processors of keyed state call their store once for a key and micro-batch, not once for a row."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import Row

from lodestitch.streaming import state as S


class Store:
    """State and timers in memory; ``calls`` counts what would be a round trip."""

    def __init__(self) -> None:
        self.calls, self.value, self.map, self.timers = 0, None, {}, []

    def _of(self, kind: str):
        store = self

        class Held:
            def __getattr__(self, name):
                def call(*args):
                    store.calls += 1
                    if kind == "value":
                        if name == "update":
                            store.value = args[0]
                        return {"get": store.value, "exists": store.value is not None}.get(name)
                    if name == "updateValue":
                        store.map[args[0]] = args[1]
                    elif name == "removeKey":
                        store.map.pop(args[0], None)
                    elif name == "clear":
                        store.map.clear()
                    return {"getValue": store.map.get(args[0]) if args else None, "containsKey": bool(args) and args[0] in store.map, "iterator": iter(list(store.map.items()))}.get(name)

                return call

        return Held()

    def getValueState(self, *_):
        return self._of("value")

    def getMapState(self, *_):
        return self._of("map")

    def registerTimer(self, at):
        self.calls += 1
        self.timers.append(at)


def plain_hits(rows, ttl, most, sliding):
    held, turn = {}, 0
    for name, at in rows:
        entry = held.get(name)
        if entry and at - (entry[1] if sliding else entry[0]) <= ttl:
            held[name] = (entry[0], at, entry[2])
            yield True
            continue
        held.pop(name, None)
        if len(held) >= most:
            for gone in sorted(held, key=lambda k: held[k][2])[: max(1, most // 2)]:
                del held[gone]
        turn += 1
        held[name] = (at, at, turn)
        yield False


@pytest.mark.parametrize("most", [1, 5, 1000])
@pytest.mark.parametrize("sliding", [True, False])
def test_cache(most, sliding):
    rng = random.Random(most)
    rows = [(f"k{rng.randrange(12) if i < 300 else rng.randrange(60)}", i * 10 + rng.randrange(10)) for i in range(600)]
    store, cache, got = Store(), S.TtlCache(200, most, sliding), []
    cache.init(store)
    for at in range(0, 600, 100):
        before = store.calls
        batch = [Row(key=k, id=i, at=t) for i, (k, t) in enumerate(rows[at : at + 100])]
        got += [r["hit"] for r in cache.handleInputRows(("c", 0), iter(batch[::-1]), None)]
        if most == 1000:
            assert store.calls - before <= 2 * len({k for k, _ in rows[at : at + 100]}) + 4
    assert got == list(plain_hits(rows, 200, most, sliding))
    assert store.value[0] == len(store.map) <= most


def test_job_ended_in_a_batch_needs_no_timer():
    store, life = Store(), S.JobLife(6 * S.HOUR)
    life.init(store)
    rows = [Row(id=i, at=i, event=e) for i, e in enumerate(["submit", "start", "pause", "resume", "done"])]
    assert [r["state"] for r in life.handleInputRows(("j",), iter(rows), None)] == ["queued", "running", "paused", "running", "done"]
    assert store.calls == 2 and not store.timers
    other, life = Store(), S.JobLife(6 * S.HOUR)
    life.init(other)
    list(life.handleInputRows(("j",), iter(rows[:3]), None))
    assert other.timers == [6 * S.HOUR // 1000 + 1]
