"""Versioned stores, their merge, frozen holdouts, and sinks by id."""

import pytest

from hindsight.sources import sinks, store


def rows(df, *by):
    return sorted(tuple(-1 if v is None else v for v in r) for r in df.select(*by).collect())


def test_a_version_is_committed_once(spark, tmp_path):
    a = spark.createDataFrame([(1, "x")], "id long, v string")
    s = store.Store(spark, str(tmp_path / "s"))
    one = s.commit({"t": a})
    assert (one.version, rows(one.read("t"), "id", "v")) == (1, [(1, "x")])
    with pytest.raises(store.Conflict):  # it was opened before version 1
        s.commit({"t": a.limit(0)})
    two = one.commit({"u": a})
    assert two.version == 2 and rows(store.Store(spark, str(tmp_path / "s")).read("t"), "id") == [(1,)]
    assert store.Store(spark, str(tmp_path / "s"), 1).tables.keys() == {"t"}


def test_a_writer_that_dies_leaves_the_old_version(spark, tmp_path, monkeypatch):
    a = spark.createDataFrame([(1, "x")], "id long, v string")
    s = store.Store(spark, str(tmp_path / "s")).commit({"t": a})

    def dies(*_):
        raise RuntimeError("lost")

    monkeypatch.setattr(store, "commit_once", dies)
    with pytest.raises(RuntimeError):
        s.commit({"t": a.union(a)})
    now = store.Store(spark, str(tmp_path / "s"))
    assert now.version == 1 and now.read("t").count() == 1


def test_merge_of_different_columns_and_conflicts(spark, tmp_path):
    make = lambda n, data, schema: store.Store(spark, str(tmp_path / n)).commit({"t": spark.createDataFrame(data, schema), "other": spark.createDataFrame([(n,)], "n string")})
    home = make("home", [(1, "a", 1.0), (2, "b", 2.0), (3, "c", 3.0), (None, "n", 0.0)], "id long, name string, v double")
    one = make("one", [(2, 20.0), (4, 40.0), (4, 41.0), (None, 9.0)], "id long, v double")
    two = make("two", [(3, None, "new"), (4, "d", "x")], "id long, name string, extra string")
    got = store.merge_stores(home, [one, two], {"t": ["id"]})
    want = [(-1, "n", 0.0, -1), (-1, -1, 9.0, -1), (1, "a", 1.0, -1), (2, "b", 20.0, -1), (3, -1, 3.0, "new"), (4, "d", 40.0, "x")]
    assert sorted(map(str, got.read("t").select("id", "name", "v", "extra").fillna(-1).fillna("-1").collect())) == sorted(map(str, spark.createDataFrame([tuple("-1" if i in (1, 3) and v == -1 else v for i, v in enumerate(r)) for r in want], "id long, name string, v double, extra string").collect()))
    assert rows(got.read("other"), "n") == [("home",)] and got.version == 2
    bad = make("bad", [("1", 1.0)], "id string, v double")
    with pytest.raises(ValueError, match="column id"):
        store.merge_stores(got, [bad], {"t": ["id"]})


def test_a_holdout_stays_frozen(spark, tmp_path):
    x = spark.createDataFrame([(s, 1000 * k + i, i) for k, (s, n) in enumerate((("a", 150), ("b", 90))) for i in range(1, n + 1)], "sport string, match_id long, seq long")
    s = store.freeze(store.Store(spark, str(tmp_path / "h")), x)
    status = lambda s, x: {r.sport: (r.status, r.frozen, r.missing) for r in store.frozen_status(s, x).collect()}
    assert status(s, x) == {"a": ("OK", 33, 0), "b": ("DEFERRED", 0, 0)}
    more = x.unionByName(spark.createDataFrame([("a", 5000 + i, 150 + i) for i in range(1, 100)] + [("b", 6000 + i, 90 + i) for i in range(1, 60)], x.schema))
    t = store.freeze(s, more)
    held = {r.match_id for r in store.with_holdout(t, more).where("holdout AND sport = 'a'").collect()}
    assert held == set(range(118, 151)) and status(t, more)["b"][0] == "OK"
    assert store.freeze(t, more).version == t.version
    gone = more.where("match_id <> 130")
    assert status(t, gone)["a"] == ("INVALID", 33, 1)
    with pytest.raises(ValueError, match="a \\(1 of 33\\)"):
        store.with_holdout(t, gone)


def test_an_id_is_known_under_any_day(spark, tmp_path):
    path, schema = str(tmp_path / "ledger"), "id long, day string, v double"
    put = lambda *r: sinks.append_daily(spark.createDataFrame(list(r), schema), path, "id", "day")
    assert put() == 0
    assert put((1, "d1", 1.0), (1, "d2", 0.5), (None, "d1", 3.0)) == 2
    assert put((1, "d3", 9.0), (None, "d2", 4.0), (2, "d1", 2.0)) == 1
    assert rows(spark.read.parquet(path), "id", "day", "v") == [(-1, "d1", 3.0), (1, "d1", 1.0), (2, "d1", 2.0)]


def test_first_write_wins_and_conflicts_fail(spark, tmp_path):
    path, schema = str(tmp_path / "w"), "id long, v double"
    put = lambda n, *r: sinks.first_write(spark.createDataFrame(list(r), schema), path, ["id"], n)
    put(0, (1, 1.0), (2, None), (1, 1.0))
    put(0, (1, 1.0), (2, None), (1, 1.0))  # the batch again
    put(1, (2, None), (3, 3.0), (None, 5.0))
    assert rows(spark.read.parquet(path), "id", "v") == [(-1, 5.0), (1, 1.0), (2, -1), (3, 3.0)]
    for bad in ([(2, 2.0)], [(4, 1.0), (4, 2.0)], [(None, 6.0)]):
        with pytest.raises(sinks.ConflictingRows):
            put(2, *bad)
    assert spark.read.parquet(path).count() == 4
