import pytest
from pyspark.sql import functions as F

from tidemark.operators import jobs
from tidemark.sources import schemas
from tidemark.sources.bars_csv import append_market_data, read_bars_csv

HEAD = "Date,Time,Open,High,Low,Close,Volume\n"
GOOD = "2024.01.05,13:45,1.5,2.5,0.5,2.0,10\n"


def write(tmp_path, text, name="a.csv"):
    p = tmp_path / name
    p.write_text(text)
    return str(p)


def test_good_reordered_and_extra(spark, tmp_path):
    one = read_bars_csv(spark, write(tmp_path, HEAD + GOOD), "a").collect()
    two = read_bars_csv(spark, write(tmp_path, "Time,Extra,Date,Close,Open,High,Low,Volume\n13:45,z,2024.01.05,2.0,1.5,2.5,0.5,10\n", "b.csv"), "a").collect()
    assert one == two and str(one[0].ts) == "2024-01-05 13:45:00" and one[0].seq == 0


@pytest.mark.parametrize("row", ["2024.01.05,13:45,x,2,0,2,1\n", "2024.01.05,13:45,,2,0,2,1\n", "2024.13.05,13:45,1,2,0,2,1\n", "2024.01.05,13:45,1\n"])
def test_one_bad_row_fails_the_load(spark, tmp_path, row):
    with pytest.raises(Exception):  # noqa: B017
        read_bars_csv(spark, write(tmp_path, HEAD + GOOD + row), "a").collect()
    kept = read_bars_csv(spark, write(tmp_path, HEAD + GOOD + row), "a", mode="quarantine").collect()
    assert [r.bad for r in kept] == [False, True]


def test_header_only_and_twice(spark, tmp_path):
    out = str(tmp_path / "md")
    assert read_bars_csv(spark, write(tmp_path, HEAD), "a").count() == 0
    for _ in range(2):
        append_market_data(read_bars_csv(spark, write(tmp_path, HEAD + GOOD, "g.csv"), "a"), out)
    assert spark.read.parquet(out).count() == 2


def test_asset_survives_a_bad_file(spark, tmp_path):
    bad = write(tmp_path, HEAD + "2024.01.05,13:45,x,2,0,2,1\n")
    assets, market = str(tmp_path / "assets"), str(tmp_path / "market")
    with pytest.raises(Exception):  # noqa: B017
        jobs.ingest_csv(spark, bad, "ABC", assets, market)
    assert [r.symbol for r in spark.read.parquet(assets).collect()] == ["ABC"]
    jobs.ingest_csv(spark, write(tmp_path, HEAD + GOOD, "g.csv"), "ABC", assets, market, name="ignored, as the asset is there")
    jobs.ingest_csv(spark, write(tmp_path, HEAD, "h.csv"), "NEW", assets, market, name="New", asset_class="index", currency="USD", exchange="X", timezone="UTC")
    new = spark.read.parquet(assets).filter("symbol = 'NEW'").first()
    assert (new.name, new.asset_class, new.currency, new.exchange, new.timezone, new.tick_size) == ("New", "index", "USD", "X", "UTC", 0.1)
    assert spark.read.parquet(assets).columns == [c for c, _, _ in schemas.columns("assets")]
    with pytest.raises(ValueError, match="not an attribute"):
        jobs.ingest_csv(spark, bad, "ABC", assets, market, colour="red")
    (tmp_path / "broken").mkdir()
    (tmp_path / "broken" / "part.parquet").write_text("no parquet")
    with pytest.raises(Exception, match="(?i)parquet"):
        jobs.ingest_csv(spark, bad, "ABC", str(tmp_path / "broken"), market)
    assert spark.read.parquet(assets).filter("symbol = 'ABC'").count() == 1
    assert spark.read.parquet(market).select("asset_id").first()[0] == "asset:ABC"


def test_conform(spark):
    ok = spark.createDataFrame([("a", "Buy", 1)], "asset_id string, side string, qty int")
    row = schemas.conform(ok, "orders").first()
    assert row.status == "Pending" and row.qty == 1.0
    for name in schemas.TABLES:
        assert schemas.conform(spark.createDataFrame([], "x int"), name).count() == 0
    with pytest.raises(Exception, match="not allowed"):
        schemas.conform(ok.withColumn("side", F.lit("Hold")), "orders").collect()
    with pytest.raises(Exception, match="asset_id is null"):
        schemas.conform(ok.withColumn("asset_id", F.lit(None).cast("string")), "orders").collect()
