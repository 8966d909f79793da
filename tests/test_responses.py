"""The provider's data source, its pushed filters, gaps between covered stretches, and the cache."""

import datetime as dt
import json
import random

import pytest

from loomframe.sources import responses

D = dt.date


@pytest.fixture
def provider(tmp_path):
    """Thirty days of two tickers, one of them with a character that paths escape; a broken answer, an empty one."""
    for name, lines in {"A%23": [json.dumps({"date": f"2024-01-{k:02d}", "open": k, "high": k, "low": k, "close": k}) for k in range(1, 31)], "B": ['{"date": "2024-01-02", "close": 5}'], "bad": ["{"], "empty": []}.items():
        (tmp_path / f"ticker={name}").mkdir()
        (tmp_path / f"ticker={name}" / "part.json").write_text("\n".join(lines))
        (tmp_path / f"ticker={name}" / "_SUCCESS").write_text("")
    return str(tmp_path)


def wanted(spark, *rows):
    return spark.createDataFrame(list(rows), "ticker string, lo date, hi date")


def test_filters_make_fewer_and_shorter_requests(spark, provider):
    requests = [("A#", D(2024, 1, 1), D(2024, 1, 31)), ("B", D(2024, 1, 1), D(2024, 1, 31)), ("none", D(2024, 1, 1), D(2024, 1, 2))]
    every = responses.ask(spark, provider, requests)
    assert every.where("error IS NULL").count() == 31 and [r.ticker for r in every.where("error IS NOT NULL").collect()] == ["none"]
    few = every.where("ticker IN ('A#', 'B') AND date > DATE '2024-01-09' AND date <= DATE '2024-01-12'")
    assert few.rdd.getNumPartitions() == 2 and {(r.lo, r.hi) for r in few.collect()} == {(D(2024, 1, 10), D(2024, 1, 12))}
    assert sorted(r.date.day for r in few.collect()) == [10, 11, 12]
    assert every.where("ticker = 'nobody'").count() == 0


def test_gaps(spark):
    """Against days counted one by one."""
    rng, day = random.Random(2), lambda k: D(2024, 1, 1) + dt.timedelta(k)
    span = lambda t: (t, day(a := rng.randint(0, 40)), day(a + rng.randint(0, 15)))
    want = [span(t) for t in "abcdef" for _ in range(2)] + [("none", day(3), day(5)), ("none", day(9), day(8))]
    have = [span(t) for t in "abcde" for _ in range(4)]
    ddl = "ticker string, lo date, hi date"
    got = responses.gaps().apply(spark, wanted=spark.createDataFrame(want, ddl), covered=spark.createDataFrame(have, ddl)).collect()
    days = lambda rows: {(r[0], r[1] + dt.timedelta(k)) for r in rows for k in range((r[2] - r[1]).days + 1)}
    assert days(got) == days(want) - days(have)
    assert all((r.ticker, r.hi + dt.timedelta(1)) not in days(want) - days(have) or any(w[0] == r.ticker and w[2] == r.hi for w in want) for r in got)


def test_only_gaps_are_asked_for_again(spark, provider, tmp_path):
    cache = responses.Cache(spark, str(tmp_path / "cache"))
    names = ("A#", "B", "bad", "empty")
    rows, failed, asked = cache.fetch(provider, wanted(spark, *[(t, D(2024, 1, 5), D(2024, 1, 10)) for t in names]))
    assert sorted((r.ticker, r.date.day) for r in rows.collect()) == [("A#", k) for k in range(5, 11)]
    assert [r.ticker for r in failed.collect()] == ["bad"] and asked.count() == 4
    rows, failed, asked = cache.fetch(provider, wanted(spark, *[(t, D(2024, 1, 1), D(2024, 1, 12)) for t in names]))
    assert sorted(map(tuple, asked.collect())) == sorted(
        [(t, *g) for t in ("A#", "B", "empty") for g in ((D(2024, 1, 1), D(2024, 1, 4)), (D(2024, 1, 11), D(2024, 1, 12)))] + [("bad", D(2024, 1, 1), D(2024, 1, 12))]
    )
    assert sorted((r.ticker, r.date.day) for r in rows.collect()) == [*[("A#", k) for k in range(1, 13)], ("B", 2)]
    rows, failed, asked = cache.fetch(provider, wanted(spark, ("A#", D(2024, 1, 2), D(2024, 1, 3))))
    assert asked.count() == 0 and rows.count() == 2 and failed.count() == 0


def test_a_fetch_cut_short_counts_for_nothing(spark, provider, tmp_path):
    """Bars without coverage are not read, and are asked for again; refreshed bars win."""
    cache = responses.Cache(spark, str(tmp_path / "cache"))
    ask = wanted(spark, ("A#", D(2024, 1, 5), D(2024, 1, 6)))
    spark.createDataFrame([("A#", D(2024, 1, 5), 9.0, 9.0, 9.0, 9.0, 9.0, "lost")], "ticker string, date date, open double, high double, low double, close double, volume double, fetch string").write.parquet(f"{cache.folder}/bars")
    assert cache.bars().count() == 0
    rows, _, asked = cache.fetch(provider, ask)
    assert asked.count() == 1 and sorted(r.close for r in rows.collect()) == [5.0, 6.0]
    (tmp_path / "ticker=A%23" / "part.json").write_text(json.dumps({"date": "2024-01-05", "close": 55}))
    rows, _, asked = cache.fetch(provider, ask, refresh=True)
    assert asked.count() == 1 and sorted(r.close for r in rows.collect()) == [6.0, 55.0]
