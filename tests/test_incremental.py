"""The cohort that follows its reports, against the batch build, for any split of the events into micro-batches."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from medlark.operators import cohort as CO
from medlark.operators import risk as RI
from medlark.streaming.incremental import CaseState

SCHEMA = "caseid string, report string, caseversion long, report_date date, is_serious int, split string, dc_ids array<long>, deleted boolean"


def events(seed: int) -> list[tuple]:
    random.seed(seed)
    day = lambda: random.choice([None, *[dt.date(2023, 1, 1) + dt.timedelta(days=random.randrange(25))] * 6])
    out = []
    for k in range(260):
        case = random.choice([None, *[f"c{k % 90}"] * 30])
        drugs = random.choice([None, [], random.choices(range(9), k=random.randint(1, 5))])
        out.append((case, str(1000 + k), random.choice([None, 1, 2, 3]), day(), int(random.random() < 0.4), random.choice(["train", "train", "train", "test", None]), drugs, False))
    out += [(f"c{k}", None, None, None, None, None, None, True) for k in random.sample(range(95), 12)]
    return out + random.sample(out, 30)


def by_batch(spark, rows):
    """Latest versions of what isn't deleted, and the cells of strictly earlier days, from all events at once."""
    all_rows = spark.createDataFrame(rows, SCHEMA)
    gone = all_rows.where("deleted").select("caseid")
    latest = CO.latest_versions(CO.without_deleted(all_rows.where("not deleted"), gone), "caseid", CO.version_order(report="report"))
    train = latest.where("split = 'train'").select("report", "report_date", "is_serious", "split")
    exposures = latest.select("report", F.explode(F.array_distinct("dc_ids")).alias("dc_id"))
    return latest, RI.prior_cells(exposures, train, ["dc_id"])


def plain(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


@pytest.mark.parametrize(("seed", "parts"), [(1, 1), (2, 4), (3, 9)])
def test_any_split_ends_as_the_batch_build(spark, tmp_path, seed, parts):
    rows = events(seed)
    random.shuffle(rows)
    state = CaseState(spark, f"file://{tmp_path}/s", 7)
    for n in range(parts):
        part = spark.createDataFrame(rows[n::parts], SCHEMA)
        state.merge(part, n)
        state.merge(part, n)  # again, as after a failure of the driver
    latest, cells = by_batch(spark, rows)
    assert plain(state.cases(), "caseid", "report", "caseversion", "report_date") == plain(latest, "caseid", "report", "caseversion", "report_date")
    assert plain(state.history(), "dc_id", "report_date", "a", "b", "c", "d") == plain(cells, "dc_id", "report_date", "a", "b", "c", "d")
    assert state.committed() == list(range(parts))


def test_a_batch_that_failed_half_way_counts_once(spark, tmp_path, monkeypatch):
    rows = events(5)
    state = CaseState(spark, f"file://{tmp_path}/s", 3)
    state.merge(spark.createDataFrame(rows[:150], SCHEMA), 0)
    before = plain(state.facts(), "dc_id", "report_date", "a", "b")
    with monkeypatch.context() as m:
        m.setattr(CaseState, "_places", lambda self: (_ for _ in ()).throw(RuntimeError("lost")) if self._names("facts/batch=1") else {b: 0 for b in range(3)})
        with pytest.raises(RuntimeError):
            state.merge(spark.createDataFrame(rows[150:], SCHEMA), 1)
    assert state.committed() == [0] and plain(state.facts(), "dc_id", "report_date", "a", "b") == before
    state.merge(spark.createDataFrame(rows[150:], SCHEMA), 1)
    latest, cells = by_batch(spark, rows)
    assert plain(state.history(), "dc_id", "report_date", "a", "b", "c", "d") == plain(cells, "dc_id", "report_date", "a", "b", "c", "d")


def test_empty_state_and_empty_batch(spark, tmp_path):
    state = CaseState(spark, f"file://{tmp_path}/s")
    assert state.cases() is None and state.facts() is None and state.history() is None
    state.merge(spark.createDataFrame([], SCHEMA), 0)
    assert state.committed() == []
    state.merge(spark.createDataFrame([("c", "1", 1, None, 1, "train", [1], False), (None, "2", 1, dt.date(2023, 1, 1), 1, "train", [1], False)], SCHEMA), 1)
    assert state.cases().count() == 1 and state.facts().count() == 0
