import datetime as dt

import pytest

from gridloom.operators import quality

COLUMNS = "timestamp timestamp, meter_id string, energy_consumption double, voltage double, current double, power_factor double"
NINE = dt.datetime(2023, 5, 2, 9)


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), COLUMNS)


def test_clean_rows_pass(spark):
    df = frame(spark, (NINE, "MTR-001", 1.5, 230.0, 6.0, 0.9), (NINE, "MTR-002", 2.5, 231.0, 7.0, 0.95))
    report = quality.require_quality(quality.quality_report(df, "bronze"))
    assert report["total_rows"] == 2 and report["passed"] and report["failures"] == ""


@pytest.mark.parametrize(
    "change, check, fails",
    [
        ({"meter_id": "MTR-12"}, "invalid_meter_id", True),
        ({"energy_consumption": 100.5}, "invalid_energy", True),
        ({"energy_consumption": None}, "null_energy_consumption", True),
        ({"timestamp": None}, "null_timestamp", True),
        ({"current": -0.1}, "invalid_current", False),
        ({"voltage": 179.9}, "invalid_voltage", False),
        ({"power_factor": 0.49}, "invalid_power_factor", False),
    ],
)
def test_one_fault_among_good_rows(spark, change, check, fails):
    good = {"timestamp": NINE, "meter_id": "MTR-700", "energy_consumption": 8.25, "voltage": 200.0, "current": 40.0, "power_factor": 0.7}
    others = [good | {"meter_id": f"MTR-{n}"} for n in range(701, 705)]
    df = frame(spark, *(tuple(row.values()) for row in [good | change, *others]))
    report = quality.quality_report(df, "bronze").first()
    assert report[check] == 1 and report["duplicate_rows"] == 0
    assert report["passed"] != fails and (check in report["failures"]) == fails


def test_a_key_sent_five_times_is_one_repeated_key(spark):
    rows = [(NINE, "MTR-801", float(k), 230.0, 6.0, 0.9) for k in range(5)]
    assert quality.quality_report(frame(spark, *rows), "bronze").first()["duplicate_rows"] == 1


def test_missing_values_are_neither_inside_nor_outside(spark):
    df = frame(spark, (None, None, None, None, None, None), (None, None, None, None, None, None))
    report = quality.quality_report(df, "bronze").first()
    assert report["null_timestamp"] == report["invalid_timestamp"] == report["null_meter_id"] == 2
    assert report["duplicate_rows"] == 1  # missing keys form one key
    assert report["invalid_meter_id"] == report["invalid_energy"] == report["invalid_voltage"] == 0


def test_strict_raises_and_rows_view(spark):
    report = quality.quality_report(frame(spark, (NINE, "MTR-001", None, 230.0, 6.0, 0.9)), "bronze")
    with pytest.raises(quality.QualityError):
        quality.require_quality(report)
    rows = {r["check_name"]: r["violations"] for r in quality.as_rows(report).collect()}
    assert list(rows) == list(quality.CHECKS) and rows["null_energy_consumption"] == 1


def test_empty_frame(spark):
    report = quality.quality_report(frame(spark), "bronze").first()
    assert report["total_rows"] == 0 and report["duplicate_rows"] == 0 and report["passed"]
