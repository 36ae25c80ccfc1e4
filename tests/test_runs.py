"""Stored runs: seen by another session once published, whole or not at all, numbered once, removed when old."""

import glob
import os
from concurrent.futures import ThreadPoolExecutor

import pytest

from closebook.operators.access import Denied, NotFound, Principal
from closebook.plans import generator, runs


def test_runs_are_stored_read_and_removed(spark, tmp_path):
    store, chief = runs.RunStore(spark, f"file://{tmp_path}"), Principal("c", "controller")
    with pytest.raises(NotFound):
        store.open()
    for bad in (0, 50_001, -1):
        with pytest.raises(runs.BadSize):
            store.run(bad, chief)
    with pytest.raises(Denied):
        store.run(10, Principal("v", "viewer"))
    first = store.run(60, chief, seed=3)
    second = store.run(40, chief, seed=4)
    other = runs.RunStore(spark.newSession(), f"file://{tmp_path}")
    assert other.names() == [first.name, second.name] and other.open().name == second.name and other.open(first.name).about["events"] == 60
    seen = other.open(first.name)
    fresh = generator.run(spark, 60, 3)
    assert seen.summary.select("records", "matched", "exceptions", "at_risk").first() == first.summary.select("records", "matched", "exceptions", "at_risk").first()
    assert seen.summary.first().records == fresh.rows.count() and seen.table("exceptions").count() == fresh.found.count()
    cursor, walked = None, []
    while True:
        page = seen.page("exceptions", cursor, 4)
        walked += page.items
        if (cursor := page.next) is None:
            break
    assert len(walked) == fresh.found.count() and seen.exception(walked[0].subject_id).at_risk == walked[0].at_risk
    assert seen.page("audit", limit=1).items[0].run == first.name and seen.page("matches", tier="exact", limit=1).items[0].tier == "exact"
    assert all(r.source == "bank" for r in seen.page("transactions", source="bank", limit=9).items)
    # A run without its marker is not there.
    os.remove(glob.glob(f"{tmp_path}/{runs.MARKS}/*-{second.name}")[0])
    assert other.names() == [first.name] and list(other.unpublished()) == [second.name]
    with pytest.raises(NotFound):
        other.open(second.name)
    store.publish(second.name)
    assert store.retain(1) == [first.name] and other.names() == [second.name] and not os.path.exists(first.folder.removeprefix("file://"))


def test_no_number_is_given_twice(spark, tmp_path):
    store = runs.RunStore(spark, f"file://{tmp_path}")
    with ThreadPoolExecutor(8) as pool:
        list(pool.map(store.publish, [f"r{i}" for i in range(24)]))
    numbers = [m.split("-")[0] for m in store._marks()]
    assert len(set(numbers)) == 24 and sorted(store.names()) == sorted(f"r{i}" for i in range(24))
