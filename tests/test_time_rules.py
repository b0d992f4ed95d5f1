"""Temporal invariance, brute-force folds, fail-closed checks and the streams."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from hindsight.operators import nearest, pit, predicates, sequential, tables, windows
from hindsight.operators.evaluation import prediction_sets
from hindsight.sources import scans, sinks
from hindsight.sources.roles import DAY, HOUR, matches, observations, predictions, targets
from hindsight.streaming import streams

SF = "/root/testdata/sf0.001"


def test_later_values_change_no_earlier_feature(spark):
    """What becomes known after a cutoff leaves the features at that cutoff as they are."""
    o, x = observations(spark, SF), targets(spark, SF)
    cut = x.agg(F.percentile("cutoff", F.lit(0.5))).first()[0]
    changed = o.withColumn("value", F.when(F.greatest("t", "avail") > cut, F.col("value") * 100).otherwise(F.col("value")))
    early = x.where(F.col("cutoff") <= cut)
    a, b = ({tuple(r) for r in pit.bounded_history(early, d).collect()} for d in (o, changed))
    assert a and a == b


def test_rows_in_any_order_give_the_same_history(spark):
    o, x = observations(spark, SF), targets(spark, SF)
    a = {tuple(r) for r in pit.bounded_history(x, o).collect()}
    b = {tuple(r) for r in pit.bounded_history(x.orderBy(F.desc("t")), o.orderBy(F.rand(1))).collect()}
    assert a == b


OBS = "event_id long, pid long, stat string, value double, t long, avail long"
PROBE = "event_id long, pid long, t long, cutoff long"


def test_bounded_history_scans_past_values_that_come_late(spark):
    obs = spark.createDataFrame([(1, 1, "s", 5.0, 10, 10), (2, 1, "s", 7.0, 20, 90), (3, 1, "s", 9.0, 30, 30)], OBS)
    r = pit.bounded_history(spark.createDataFrame([(100, 1, 60, 50)], PROBE), obs).collect()
    assert [(x.n, x.mean, x["last"], x.trend) for x in r] == [(2, 7.0, 9.0, 4.0)]


def test_bounded_history_with_any_cutoff(spark):
    """Cutoffs before and after the event, values that come late, ties in time: the newest 20 by (t, event_id) before the event that were known."""
    r = random.Random(3)
    obs = [(i, r.randrange(3), "s", float(r.randrange(100)), (t := r.randrange(60)), t + r.choice([0, 0, 5, 40])) for i in range(200)]
    probes = [(1000 + i, r.randrange(3), r.randrange(70), r.randrange(110)) for i in range(80)]
    got = {x.event_id: (x.n, round(x.mean, 9), x["last"], round(x.trend, 9)) for x in pit.bounded_history(spark.createDataFrame(probes, PROBE), spark.createDataFrame(obs, OBS)).collect()}
    want = {}
    for i, pid, t, cut in probes:
        v = [x[3] for x in sorted((o for o in obs if o[1] == pid and o[4] < t and max(o[4], o[5]) <= cut), key=lambda o: (o[4], o[0]))][-20:]
        if v:
            want[i] = (len(v), round(sum(v) / len(v), 9), v[-1], round(v[-1] - v[0], 9) if len(v) > 1 else 0.0)
    assert got == want and any(c > t and n > 1 for (i, _, t, c), n in zip(probes, (want.get(p[0], (0,))[0] for p in probes)))


def test_asof_of_empty_and_tied_builds(spark):
    p = spark.createDataFrame([("a", 5), ("b", 5)], "k string, at long")
    b = spark.createDataFrame([("a", 5, 1.0), ("a", 5, 2.0), ("a", 6, 3.0)], "k string, t long, v double")
    got = {r.k: r.last_v for r in pit.asof_join(p, b, ["k"], "at", "t", ["v"]).collect()}
    assert got == {"a": 2.0, "b": None}
    assert pit.asof_join(p, b.limit(0), ["k"], "at", "t", ["v"]).where("last_v IS NULL").count() == 2


def admitted_before(m, x):
    """Decided matches of x's sport, in order, up to the first whose outcome wasn't realized at x's cutoff."""
    out = []
    for r in sorted((r for r in m if r.sport == x.sport and r.outcome != "DRAW" and r.a != r.b), key=lambda r: (r.t, r.match_id)):
        if r.t >= x.t or max(r.t + DAY, r.avail) > x.t - HOUR:
            break
        out.append(r)
    return out


def test_elo_is_the_plain_fold_of_admitted_results(spark):
    m = matches(spark, SF).collect()
    got = {r.match_id: (r.elo_a, r.elo_b) for r in sequential.elo(matches(spark, SF), ["sport"]).collect()}
    assert len(got) == len(m)
    for x in m:
        rating = {}
        for r in admitted_before(m, x):
            a, b = rating.get(r.a, 1500.0), rating.get(r.b, 1500.0)
            d = 24 * ((r.outcome == "A") - 1 / (1 + 10 ** ((b - a) / 400)))
            rating[r.a], rating[r.b] = a + d, b - d
        assert got[x.match_id] == pytest.approx((rating.get(x.a, 1500.0), rating.get(x.b, 1500.0)))


def test_running_sums_and_maxima_over_days(spark):
    from hindsight.sources.roles import running

    r = random.Random(5)
    rows = [(r.choice("xy"), r.randrange(5 * DAY), i, r.randrange(100)) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, t long, i long, v long")
    for kind, f in (("sum", sum), ("max", max)):
        got = {x.i: x.o for x in running(df, "k", "t", "i", F.col("v"), "o", kind).collect()}
        assert got == {i: f(v2 for k2, t2, i2, v2 in rows if k2 == k and (t2, i2) <= (t, i)) for k, t, i, _ in rows}


FEATURES = {
    "form": lambda m: windows.running_form(m).select("match_id", "side", "form5", "form20"),
    "streak": lambda m: windows.streaks(m).select("match_id", "side", "streak", "won"),
    "meetings": lambda m: windows.head_to_head(m).select("match_id", "n", "value"),
    "elo": lambda m: sequential.elo(m, ["sport"]).select("match_id", F.round("elo_a", 9), F.round("elo_b", 9)),
}


@pytest.mark.parametrize("name", FEATURES)
def test_results_not_yet_known_change_no_feature(spark, name):
    """Outcomes that were realized after a cutoff may be anything: features at that cutoff and before stay."""
    m = matches(spark, SF).cache()
    cut = m.agg(F.percentile("t", F.lit(0.6))).first()[0]
    other = F.when(F.col("outcome") == "A", "B").when(F.col("outcome") == "B", "A").otherwise("DRAW")
    changed = m.withColumn("outcome", F.when(F.greatest(F.col("t") + DAY, "avail") > cut, other).otherwise(F.col("outcome")))
    early = m.where(F.col("t") - HOUR <= cut).select("match_id")
    a, b = (sorted(map(str, FEATURES[name](x).join(early, "match_id").collect())) for x in (m, changed))
    assert a and a == b
    assert sorted(map(str, FEATURES[name](m).collect())) != sorted(map(str, FEATURES[name](changed).collect()))


LEARNERS = {
    "sets": lambda x: prediction_sets(x),
    "local": lambda x: sequential.local_sets(x),
    "experts": lambda x: sequential.online_experts(x.withColumn("sets", sequential.label_sets())),
    "frozen": lambda x: sequential.frozen_calibration(x.withColumn("n", F.lit(400)).withColumn("x", F.col("p1")).withColumn("right", F.col("y")), least=20),
}


@pytest.mark.parametrize("name", LEARNERS)
def test_labels_not_yet_mature_change_nothing(spark, name):
    """A label counts from the time at which it's mature, that time included, and never for a row of the same time."""
    x = sequential.maturing(predictions(spark, "/root/testdata/sf0.01")).where("sport = 'view'").withColumn("p", F.col("p1")).withColumn("x", F.array("p1", "p2", "p3")).cache()
    cut = x.agg(F.percentile("t", F.lit(0.6))).first()[0]
    changed = x.withColumn("y", F.when(F.col("mature") > cut, 1 - F.col("y")).otherwise(F.col("y")))
    early = x.where(F.col("t") <= cut).select("match_id")
    out = lambda d: sorted(map(str, LEARNERS[name](d).drop("t").join(early, "match_id").collect()))
    assert out(x) == out(changed)


def test_sets_take_labels_that_mature_at_the_row_s_time(spark):
    rows = [("s", i, i, i + 10, i % 2, 0.4) for i in range(60)]
    x = spark.createDataFrame(rows, "sport string, match_id long, t long, mature long, y int, p double")
    n = {r.match_id: r.n for r in prediction_sets(x).collect()}
    assert n[10] == 1 and n[59] == 50
    same = spark.createDataFrame([("s", i, 5, 5, 1, 0.5) for i in range(4)], x.schema)
    assert {r.n for r in prediction_sets(same).collect()} == {0}


def test_platt_is_at_its_minimum():
    g = np.random.default_rng(2)
    x, y = g.normal(size=(20, 60)), g.integers(0, 2, (20, 60)).astype(float)
    used = np.arange(60) < g.integers(30, 61, 20)[:, None]
    a, b = sequential.platt(x, y, used)
    e = np.where(used, 1 / (1 + np.exp(-(a[:, None] * x + b[:, None]))) - y, 0)
    assert np.abs((e * x).sum(1) + a).max() < 1e-6 and np.abs(e.sum(1)).max() < 1e-6


def test_trailing_windows_cut_into_parts_are_whole(spark):
    x = spark.createDataFrame([("s", i) for i in range(1, 101)] + [("u", i) for i in range(1, 8)], "sport string, seq int")
    p = sequential.overlapping(x, 20, 7).collect()
    assert sum(r.own for r in p) == 107
    for r in p:
        if r.own:
            assert {q.seq for q in p if (q.sport, q.part) == (r.sport, r.part) and q.seq < r.seq} >= set(range(max(1, r.seq - 7), r.seq))


def test_replicates_are_weighted_sums(spark):
    blocks = spark.createDataFrame([("k", i, float(i), 10) for i in range(50)], "key string, block long, s double, n long")
    r = [x.value for x in sequential.weighted_replicates(blocks, "key", F.lit(1.0), 400, 3).collect()]
    assert len(r) == 400 and abs(np.mean(r) - 2.45) < 0.05 and 0.1 < np.std(r) < 0.4
    again = [x.value for x in sequential.weighted_replicates(blocks.repartition(7), "key", F.lit(1.0), 400, 3).collect()]
    assert sorted(map(lambda v: round(v, 9), r)) == sorted(map(lambda v: round(v, 9), again))


def test_nearest_is_brute_force(spark):
    g = np.random.default_rng(4)
    v = g.integers(0, 4, (300, 3)).astype(float)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, x array<double>")
    got = {(r.query_id, r.rank): (r.row_id, r.distance) for r in nearest.nearest(df.where("id % 10 = 0"), df, 4, block_rows=7, shard_rows=64).collect()}
    for q in range(0, 300, 10):
        d = sorted((round(float(np.sqrt(((v[q] - v[j]) ** 2).mean())), 6), j) for j in range(300) if j != q)[:4]
        assert [got[q, k + 1] for k in range(4)] == [(j, x) for x, j in d]
    assert nearest.nearest(df.limit(0), df, 4).count() == 0


def test_conflicting_ledger_rows_fail(spark):
    rows = spark.createDataFrame([(1, 2.0), (1, 3.0)], "id long, v double")
    with pytest.raises(Exception, match="conflict at 1"):
        tables.append_only(rows, "id").collect()
    assert tables.append_only(rows.limit(1).union(rows.limit(1)), "id").count() == 1


def test_a_side_with_two_participants_fails(spark):
    rows = spark.createDataFrame([(1, "A", 5), (1, "A", 6), (1, "B", 7)], "match_id long, side string, pid long")
    with pytest.raises(Exception, match="sides of 1"):
        pit.one_per_side(rows).collect()


def test_probabilities_are_checked(spark):
    rows = spark.createDataFrame([([0.4, 0.6],), ([0.4, 0.7],), ([float("nan"), 1.0],), ([1.2, -0.2],), ([None, 1.0],), (None,)], "p array<double>")
    assert [r.ok for r in rows.select(predicates.valid_probabilities(F.col("p")).alias("ok")).collect()] == [True, False, False, False, False, False]


def test_parsers(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"id": 1}\n{"id": \n')
    assert sum(r._bad is not None for r in scans.json_lines(spark, str(tmp_path / "a.json"), "id long", strict=False).collect()) == 1
    with pytest.raises(Exception):
        scans.json_lines(spark, str(tmp_path / "a.json"), "id long").collect()
    (tmp_path / "b.csv").write_text("Player Name,Pts\nx,3\n")
    r = scans.csv_rows(spark, str(tmp_path / "b.csv"), {"name": ["name", "playername"], "points": ["pts"], "team": ["club"]}).first()
    assert (r.name, r.points, r.team) == ("x", "3", None)
    (tmp_path / "c.xml").write_text("<r><m><id>4</id></m><m><id>5</id></m></r>")
    assert {x.id for x in scans.xml_rows(spark, str(tmp_path / "c.xml"), "m", "id long").collect()} == {4, 5}
    page = '<script type="application/ld+json">{"@type": "SportsEvent", "name": "n", "homeTeam": {"name": "h"}}</script><meta property="article:published_time" content="2024-01-02T03:04:05Z"><p>Score</p><p>3</p>'
    d = spark.createDataFrame([(page,), (None,)], "html string")
    r = d.select(scans.json_ld_event(F.get(scans.json_ld(F.col("html")), F.lit(0))).alias("e"), scans.publication_time(F.col("html")).alias("t"), scans.label_value(scans.text_lines(F.col("html")), "score").alias("v")).collect()
    assert r[0].e.home == "h" and r[0].t is not None and r[0].v == "3" and r[1].e is None


def test_daily_ledger_grows_by_unknown_ids(spark, tmp_path):
    path = str(tmp_path / "ledger")
    rows = spark.createDataFrame([(1, "d1", 1.0), (2, "d1", 2.0), (2, "d1", 3.0), (3, "d2", 4.0)], "id long, day string, v double")
    assert sinks.append_daily(rows, path, "id", "day") == 3
    assert sinks.append_daily(rows, path, "id", "day") == 0
    assert sinks.append_daily(rows.union(spark.createDataFrame([(4, "d2", 9.0)], rows.schema)), path, "id", "day") == 1
    assert sorted((r.id, r.day, r.v) for r in spark.read.parquet(path).collect()) == [(1, "d1", 1.0), (2, "d1", 2.0), (3, "d2", 4.0), (4, "d2", 9.0)]
    assert sinks.append_daily(rows.limit(0), path, "id", "day") == 0


def test_reports_are_written_only_on_change(spark, tmp_path):
    path = str(tmp_path / "report")
    rows = lambda at, v: spark.createDataFrame([("a", at, v), ("b", at, None)], "name string, at long, v double")
    assert sinks.write_if_changed(rows(1, 0.5), path, ("at",))
    assert not sinks.write_if_changed(rows(2, 0.5).repartition(3), path, ("at",))
    assert sinks.write_if_changed(rows(3, 0.25), path, ("at",))
    assert len(sinks.versions(spark, path)) == 2 and sinks.latest(spark, path).agg(F.max("at")).first()[0] == 3


def test_checkpoints_keep_the_newest_state(spark, tmp_path):
    path = str(tmp_path / "state")
    kind = "sport string, scope string, at long, cursor string, completed boolean"
    sinks.save_state(spark.createDataFrame([("x", "a", 1, "p1", False), ("x", "b", 1, "p9", True)], kind), path)
    sinks.save_state(spark.createDataFrame([("x", "a", 2, "p2", True), ("x", "b", 1, "p8", False)], kind), path)
    assert sorted(map(tuple, sinks.read_state(spark, path).collect())) == [("x", "a", 2, "p2", True), ("x", "b", 1, "p9", True)]


def feed(spark, path, rows):
    spark.createDataFrame(pd.DataFrame(rows, columns=["event_id", "ts", "user_id", "event_type", "value", "props"]), streams.EVENTS).coalesce(1).write.mode("append").parquet(path)


def at(minute):
    return pd.Timestamp("2024-01-01") + pd.Timedelta(minutes=minute)


def drained(q):
    try:
        q.processAllAvailable()
    finally:
        q.stop()


def test_streams_match_batch(spark, tmp_path):
    e = spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    e.orderBy("ts").coalesce(1).write.parquet(str(tmp_path / "in"))
    source = lambda: streams.event_stream(spark, str(tmp_path / "in"))
    for name, df, mode in (("bins", streams.tumbling(source(), "1 hour"), "complete"), ("slides", streams.sliding(source(), "1 hour", "30 minutes"), "complete"), ("level", streams.running_rating(source()), "update"), ("uniq", streams.deduplicated(source()), "append"), ("met", streams.meetings(source()), "update"), ("gate", streams.gated(source(), 60), "append")):
        drained(df.writeStream.outputMode(mode).format("memory").queryName(name).start())
    window = lambda *x: e.groupBy(F.window("ts", *x)["start"].alias("start"), "event_type").agg(F.count("*").alias("n"))
    for name, want in (("bins", window("1 hour")), ("slides", window("1 hour", "30 minutes"))):
        assert spark.table(name).select("start", "event_type", "n").exceptAll(want).count() == 0 and spark.table(name).count() == want.count()
    assert spark.table("level").agg(F.sum("n")).first()[0] == e.count()
    assert spark.table("uniq").count() == e.count()
    assert spark.table("met").agg(F.sum("n")).first()[0] == e.groupBy("user_id", "event_type").agg(F.least(F.count("*"), F.lit(20)).alias("n")).agg(F.sum("n")).first()[0]
    assert spark.table("gate").count() == e.where(F.get_json_object("props", "$.k").cast("long") >= 60).count()


def test_late_rows_go_to_a_side_output(spark, tmp_path):
    src = str(tmp_path / "in")
    q = None
    for k, minutes in enumerate(([0, 60, 120], [5, 118, 130], [100, 125])):
        feed(spark, src, [(10 * k + i, at(m), 1, "view", 1.0, "{}") for i, m in enumerate(minutes)])
        q = streams.split_output(streams.marked_late(streams.event_stream(spark, src), "10 minutes"), str(tmp_path / "ok"), str(tmp_path / "late"), str(tmp_path / "cp"))
        drained(q)
    ids = lambda name: sorted(r.event_id for r in spark.read.parquet(str(tmp_path / name)).collect())
    assert ids("late") == [10, 20] and ids("ok") == [0, 1, 2, 11, 12, 21]


def test_pending_labels_settle_or_expire(spark, tmp_path):
    src = str(tmp_path / "in")
    batches = [[(1, 0, 1, "purchase"), (2, 0, 2, "purchase")], [(3, 90, 1, "view")], [(4, 5000, 3, "view")], [(5, 5100, 3, "view")]]
    for batch in batches:
        feed(spark, src, [(i, at(m), u, kind, 1.0, "{}") for i, m, u, kind in batch])
        q = streams.matured_labels(streams.event_stream(spark, src)).writeStream.outputMode("append").format("parquet").option("checkpointLocation", str(tmp_path / "cp")).start(str(tmp_path / "out"))
        drained(q)
    got = {r.event_id: (r.status, r.realized) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {1: ("SETTLED", at(90).to_pydatetime()), 2: ("EXPIRED", at(1440).to_pydatetime())}


def test_streams_start_again_from_their_checkpoint(spark, tmp_path):
    """Stopped after each file and started again, a stream gives what one batch gives, and a batch written twice counts once."""
    e = spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    for part in range(3):
        e.where(F.col("event_id") % 3 == part).coalesce(1).write.mode("append").parquet(src)
        sink = lambda batch, n: batch.write.mode("overwrite").parquet(f"{out}/batch={n}")
        drained(streams.restartable(streams.running_rating(streams.event_stream(spark, src, 1)), "update", str(tmp_path / "cp"), sink))
    last = spark.read.parquet(out).groupBy("user_id").agg(F.max("n").alias("n"))
    assert last.exceptAll(e.groupBy("user_id").agg(F.count("*").alias("n"))).count() == 0 and last.count() == e.select("user_id").distinct().count()
