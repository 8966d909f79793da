import pytest

from loomframe.config import Settings


def test_round_trip_and_overrides(tmp_path, monkeypatch):
    Settings().to_yaml(str(tmp_path / "s.yaml"))
    assert Settings.from_yaml(str(tmp_path / "s.yaml")) == Settings()
    monkeypatch.setenv("LOOM_COSTS__TRADING_BPS", "0")
    assert Settings.from_dict({"labels": {"horizon_days": 0}}).costs.trading_bps == 0
    assert Settings.from_dict({"labels": {"horizon_days": 0}}).labels.horizon_days == 0
    with pytest.raises(ValueError):
        Settings.from_dict({"nothing": {}})


def test_groups_of_data_models_and_inference(monkeypatch):
    import datetime

    got = Settings.from_dict({"data": {"start_date": datetime.date(2010, 1, 4), "macro_tickers": ["A"]}, "inference": {"alert_days": 5}})
    assert got.data.start_date == datetime.date(2010, 1, 4) and got.data.macro_tickers == ("A",) and got.data.min_price == 5.0
    assert got.inference.alert_days == 5 and got.inference.ic_floor == 0.03 and got.models.stage_one_threshold == 0.65
    monkeypatch.setenv("LOOM_MODELS__KIND", "boosted")
    assert Settings.from_dict({}).models.kind == "boosted"
    with pytest.raises(TypeError):
        Settings.from_dict({"models": {"epochs": 3}})
