"""Loads that count whole or not at all, assets that jobs agree on, refresh from changes, clustered and named views."""

import datetime as dt
import random
import threading

import pytest
from pyspark.sql import functions as F

from tidemark.functions.candle import candle_pattern, pattern_sql
from tidemark.operators import bars, jobs, named_views, views
from tidemark.sources import market_store
from tidemark.sources.adapters import md_events, md_orders
from tidemark.sources.bars_csv import read_bars_csv, read_bars_files
from tidemark.sources.commits import Commits
from tidemark.sources.market_store import MarketStore

SF = "/root/testdata/sf0.001"
HEAD = "Date,Time,Open,High,Low,Close,Volume\n"


def write(folder, name, text):
    (folder / name).parent.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text(text)
    return str(folder / name)


def test_one_job_gets_each_number(spark, tmp_path):
    tables = [Commits(spark, str(tmp_path / "t")) for _ in range(4)]
    threads = [threading.Thread(target=lambda k=k, t=t: [t.add(lambda _, k=k: {"by": k}) for _ in range(5)]) for k, t in enumerate(tables)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    got = tables[0].read()
    assert [c["number"] for c in got] == list(range(1, 21)) and sorted(c["by"] for c in got) == sorted([0, 1, 2, 3] * 5)
    assert [c["number"] for c in tables[0].read(18)] == [19, 20] and tables[0].add(lambda _: None) is None
    with pytest.raises(ValueError, match="isn't of"):
        tables[0].drop(str(tmp_path / "other"))


def test_a_load_counts_once_it_is_committed(spark, tmp_path, monkeypatch):
    store, md = MarketStore(spark, str(tmp_path / "s")), md_events(spark, SF)
    assert store.market_data().count() == 0 and store.days() == []

    def died(*_):
        raise RuntimeError("died")

    with monkeypatch.context() as m:
        m.setattr(Commits, "add", died)
        with pytest.raises(RuntimeError):
            store.append(md, "one")
    assert store.market_data().count() == 0  # files are there, but don't count
    bad = md.withColumn("close", F.when(F.col("seq") == 7, None).otherwise(F.col("close")))
    with pytest.raises(Exception, match="close is null"):
        store.append(bad, "one")
    assert store.market_data().count() == 0
    for _ in range(2):
        store.append(md, "one")
    assert store.market_data().count() == md.count()
    store.append(md, "two")
    assert store.market_data().count() == 2 * md.count()
    store.retract("two")
    store.retract("two")
    store.retract("never")
    assert store.market_data().count() == md.count() and len(store.loads.read()) == 3
    store.append(md, "two")  # its id was used up
    assert store.market_data().count() == md.count()
    store.append(md.limit(0), "none")
    assert "none" not in store.committed()


def test_two_jobs_agree_on_one_asset(spark, tmp_path):
    root = str(tmp_path / "s")
    MarketStore(spark, root).get_or_create(spark.createDataFrame([("OLD",)], "symbol string"), jobs.assets_get_or_create)
    meet, got = threading.Barrier(2), {}

    def make(existing, incoming):
        out = jobs.assets_get_or_create(existing, incoming)
        if threading.current_thread().name not in got:
            got[threading.current_thread().name] = None
            meet.wait(60)  # both have looked before either commits
        return out

    def run(name):
        found = MarketStore(spark, root).get_or_create(spark.createDataFrame([("NEW", name), ("OLD", name)], "symbol string, name string"), make)
        got[threading.current_thread().name] = {r.symbol: (r.id, r.name, r.first_listed_ts) for r in found.collect()}

    threads = [threading.Thread(target=run, args=(f"by {k}",), name=f"job {k}") for k in range(2)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    one, two = got.values()
    assert one == two and set(one) == {"NEW", "OLD"} and MarketStore(spark, root).all_assets().count() == 2


def test_many_files_of_several_layouts_in_one_load(spark, tmp_path):
    files = [
        {"path": write(tmp_path, "a b.csv", HEAD + "2024.01.05,13:45,1.5,2.5,0.5,2.0,10\n"), "symbol": "A", "currency": "USD"},
        {"path": write(tmp_path, "b/one.csv", "Time,Extra,Date,Close,Open,High,Low,Volume\n13:45,z,2024.01.06,2.0,1.5,2.5,0.5,10\n").rsplit("/", 1)[0], "symbol": "B"},
        {"path": write(tmp_path, "c.csv", HEAD), "symbol": "C"},
        {"path": write(tmp_path, "d.csv", ""), "symbol": "A"},
    ]
    write(tmp_path, "b/two.csv", HEAD + "2024.01.07,00:00,9,9,9,9,NaN\n")
    store = MarketStore(spark, str(tmp_path / "s"))
    jobs.ingest_files(store, files, load_id="x")
    jobs.ingest_files(store, files, load_id="x")
    rows = {(r.asset_id, str(r.ts)): (r.open, r.close) for r in store.market_data().collect()}
    assert rows == {("asset:A", "2024-01-05 13:45:00"): (1.5, 2.0), ("asset:B", "2024-01-06 13:45:00"): (1.5, 2.0), ("asset:B", "2024-01-07 00:00:00"): (9.0, 9.0)}
    assert {r.symbol: r.currency for r in store.all_assets().collect()} == {"A": "USD", "B": None, "C": None}
    bad = {"path": write(tmp_path, "e.csv", HEAD + "2024.01.05,13:45,x,2.5,0.5,2.0,10\n"), "symbol": "E"}
    with pytest.raises(Exception, match="bad Open"):
        jobs.ingest_files(store, [files[0], bad])
    assert store.market_data().count() == 3 and store.all_assets().count() == 4
    with pytest.raises(ValueError, match="no header"):
        read_bars_files(spark, [write(tmp_path, "f.csv", "Date,Time,Open\n2024.01.05,13:45,1\n"), files[0]["path"]])
    with pytest.raises(ValueError, match="not an attribute"):
        jobs.ingest_files(store, [files[0] | {"colour": "red"}])


def test_quarantine_says_why(spark, tmp_path):
    path = write(tmp_path, "a.csv", HEAD + "2024.01.05,13:45,1,2,0,2,1\n2024.13.05,13:45,x,2,,2,1\n2024.01.05,13:45,1\n2024.01.05,13:45,NaN,Infinity,0,2,1\n")
    got = [(r.bad, r.reason) for r in read_bars_csv(spark, path, "a", mode="quarantine").collect()]
    assert got == [(False, None), (True, "Date and Time, Open, Low"), (True, "High, Low, Close, Volume"), (False, None)]
    assert read_bars_csv(spark, path, "a", mode="quarantine").filter("isnan(open)").count() == 1


def test_latest_reads_the_newest_partitions_only(spark, tmp_path, monkeypatch):
    store, md = MarketStore(spark, str(tmp_path / "s")), md_events(spark, SF)
    store.append(md.filter("seq % 2 = 0"), "even")
    store.append(md.filter("seq % 2 <> 0"), "odd")
    asked = []
    read = MarketStore.market_data
    monkeypatch.setattr(MarketStore, "market_data", lambda self, days=None: asked.append(days) or read(self, days))
    plain = [(r.ts, r.seq) for r in md.filter("asset_id = 'click'").orderBy(F.desc("ts"), F.desc("seq")).limit(5).collect()]
    got = store.latest("click", 5)
    assert [(r.ts, r.seq) for r in got.collect()] == plain
    days = store.days()
    assert len(days) == 30 and asked[-1] == days[: len(asked[-1])] and len(asked[-1]) <= 3
    assert {f.split("trade_date=")[1][:10] for f in got.inputFiles()} == {str(d) for d in asked[-1]}
    assert store.latest("click", 10**6).count() == md.filter("asset_id = 'click'").count()
    assert store.latest("nobody", 3).count() == 0


def volumes(spark, path, key):
    return {r[key]: r.volume for r in spark.read.parquet(path).groupBy(key).agg(F.sum("volume").alias("volume")).collect()}


def test_refresh_finds_its_own_work_and_drops_what_went_empty(spark, tmp_path):
    store, out, md = MarketStore(spark, str(tmp_path / "s")), str(tmp_path / "v"), md_events(spark, SF)
    day = F.to_date("ts")
    last = [dt.date(2024, 1, 29), dt.date(2024, 1, 30)]
    store.append(md.filter(~day.isin(last)), "most")
    store.append(md.filter(day.isin(last)), "last")
    assert len(jobs.refresh_changed(store, out)) == 30 and jobs.refresh_changed(store, out) == []
    before = {n: volumes(spark, f"{out}/{n}", k) for n, k in jobs.STORED.items()}
    store.retract("last")
    assert jobs.refresh_changed(store, out) == last
    after = {n: volumes(spark, f"{out}/{n}", k) for n, k in jobs.STORED.items()}
    for name in ("session_agg", "daily_agg"):
        assert after[name] == {d: v for d, v in before[name].items() if d not in last}
    for name in ("weekday_agg", "weekly_agg"):
        assert after[name] == {w: v for w, v in before[name].items() if w != dt.date(2024, 1, 29)}
    assert after["monthly_agg"] == {dt.date(2024, 1, 1): sum(after["daily_agg"].values())}
    store.retract("most")
    jobs.refresh_changed(store, out)
    for name in jobs.STORED:
        assert spark.read.schema("volume double").parquet(f"{out}/{name}").count() == 0


def test_a_stale_day_goes_when_its_date_is_named(spark, tmp_path):
    out, md = str(tmp_path / "v"), md_events(spark, SF)
    jobs.refresh(md, out)
    gone = dt.date(2024, 1, 9)
    jobs.refresh(md.filter(F.to_date("ts") != F.lit(gone)), out, [gone])
    assert gone not in volumes(spark, f"{out}/session_agg", "trade_date")
    whole = md.filter(F.to_date("ts") != F.lit(gone)).agg(F.sum("volume")).first()[0]
    assert sum(volumes(spark, f"{out}/weekly_agg", "week_start").values()) == whole == sum(volumes(spark, f"{out}/monthly_agg", "month_start").values())


def test_a_read_of_one_asset_skips_row_groups(spark, tmp_path, monkeypatch):
    monkeypatch.setitem(market_store.CLUSTERED, "parquet.block.size", "4096")
    monkeypatch.setitem(market_store.CLUSTERED, "parquet.page.row.count.limit", "100")
    out = str(tmp_path / "v")
    md = md_orders(spark, SF).withColumn("asset_id", F.concat("asset_id", F.pmod("seq", F.lit(40)).cast("string")))
    jobs.refresh(md, out)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        one = spark.read.parquet(f"{out}/monthly_agg").filter("asset_id = '1-URGENT7'").select("asset_id", "volume")
        rows = one.collect()
        leaf = one._jdf.queryExecution().executedPlan().collectLeaves().apply(0)
        read = leaf.metrics().apply("numOutputRows").value()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert rows and read < spark.read.parquet(f"{out}/monthly_agg").count() / 2


def test_parents_of_session_bars_need_no_exchange(spark, tmp_path):
    path = str(tmp_path / "sessions")
    views.session_agg(md_events(spark, SF)).write.parquet(path)
    dealt = views.by_one_asset(spark.read.parquet(path))
    daily = views.daily_agg(dealt)
    for view in (daily, views.weekday_agg(daily), views.weekly_agg(daily), views.monthly_agg(daily)):
        plan = view._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and "REPARTITION_BY_COL" in plan


def test_named_views_are_there_for_other_sessions(spark):
    md = md_events(spark, SF)
    md.write.mode("overwrite").saveAsTable("named_rows")
    try:
        names = named_views.define(spark, "named_rows", "t_")
        assert names[0] == "t_session_agg" and names.index("t_daily_agg") < names.index("t_weekly_agg")
        other = spark.newSession()
        for name, view in views.define_views(md).items():
            assert sorted(map(str, other.table(f"t_{name}").select(*view.columns).collect())) == sorted(map(str, view.collect()))
        assert "session_agg" in str(other.sql("SHOW TBLPROPERTIES t_daily_agg").collect())
        named_views.drop(other, "t_")
        assert not spark.catalog.tableExists("t_weekly_agg")
    finally:
        spark.sql("DROP TABLE named_rows")


@pytest.mark.parametrize("values, want", [([1e16, 1.0, -1e16], 1.0), ([0.1] * 10, 1.0), ([None, 2.5], 2.5), ([None], None), ([2.0**59, 2.0**-30, -(2.0**59)], 2.0**-30), ([float("inf"), 1.0], float("inf"))])
def test_volumes_add_up_exactly(spark, values, want):
    rng, t = random.Random(4), dt.datetime(2024, 1, 1)
    for _ in range(3):
        rng.shuffle(values)
        rows = [("a", t + dt.timedelta(days=i % 9, hours=i), 1.0, 1.0, 1.0, 1.0, v, i) for i, v in enumerate(values)]
        md = spark.createDataFrame(rows, "asset_id string, ts timestamp, open double, high double, low double, close double, volume double, seq long").repartition(3)
        month = views.monthly_agg(views.daily_agg(views.session_agg(md))).first().volume
        base = bars.base_bars(md, ["asset_id"]).first().volume
        assert month == base == want


def test_roll_up_of_volumes_equals_base_bit_for_bit(spark):
    md = md_events(spark, SF).withColumn("volume", F.col("volume") / 7 + F.col("open") * 1e9)
    month = views.monthly_agg(views.daily_agg(views.session_agg(md))).select("asset_id", "volume").collect()
    base = bars.base_bars(md.repartition(5), ["asset_id", F.trunc("ts", "MM").alias("m")]).select("asset_id", "volume").collect()
    assert sorted(month) == sorted(base)


def test_both_forms_of_the_pattern_agree(spark):
    edges = [0.0, 1.0, 2.0, 3.0, 5.0, 7.0, 9.0, 10.0, 1e-9, float("nan"), None, 5.5]
    one = spark.createDataFrame([(x,) for x in edges], "x double")
    rows = one.selectExpr("x AS open").crossJoin(one.selectExpr("x AS high")).crossJoin(one.selectExpr("x AS low")).crossJoin(one.selectExpr("x AS close"))
    both = rows.select(candle_pattern(*[F.col(c) for c in ("open", "high", "low", "close")]).alias("a"), F.expr(pattern_sql()).alias("b"))
    assert both.filter("NOT (a <=> b)").count() == 0
