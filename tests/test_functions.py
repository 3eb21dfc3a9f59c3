import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from fluxloom.functions import dates, labels, metrics, scores, values


def one(spark, column, **inputs):
    types = {"str": "string", "int": "int", "float": "double", "date": "date", "NoneType": "double"}
    schema = ", ".join(f"{k} {types[type(v).__name__]}" for k, v in inputs.items()) or "x int"
    df = spark.createDataFrame([tuple(inputs.values()) or (1,)], schema)
    return df.select(column.alias("v")).first().v


@pytest.mark.parametrize(
    "text, expected",
    [
        ("6/12/1998", dt.date(1998, 6, 12)),
        ("06-12-1998", dt.date(1998, 6, 12)),
        ("1998-06-12", dt.date(1998, 6, 12)),
        ("1998/6/2", dt.date(1998, 6, 2)),
        ("13/12/1998", None),
        ("1998-06-12 10:00", None),
        ("1998-02-30", None),
        ("1998-06", None),
        ("junk", None),
    ],
)
def test_parse_mixed_date(spark, text, expected):
    assert one(spark, dates.parse_mixed_date(F.col("x")), x=text) == expected


def test_horizon_rounds_half_to_even(spark):
    # 61 days are two months of 30.5; 46 days are 1.508 and 45 days 1.475.
    lead = dates.horizon_months(F.col("a"), F.col("b"))
    base = dt.date(2020, 1, 1)
    assert [one(spark, lead, a=base, b=base + dt.timedelta(d)) for d in (61, 46, 45, 0)] == [2, 2, 1, 0]


def test_steps_to_issue(spark):
    steps = dates.steps_to_issue(F.col("a"), F.col("b"))
    assert one(spark, steps, a=dt.date(2019, 11, 1), b=dt.date(2020, 2, 1)) == 9


def test_pseudo_year_of_common_year_shifts_march(spark):
    assert one(spark, dates.pseudo_year_date(F.col("x")), x=dt.date(2023, 3, 1)) == dt.date(2024, 2, 29)


def test_text_to_number(spark):
    assert one(spark, values.to_double_or_null(F.col("x")), x="1.5e2") == 150.0
    assert one(spark, values.to_double_or_null(F.col("x")), x="NA") is None
    assert one(spark, values.to_double_or_null(F.col("x")), x="NaN") is None


def test_constant(spark):
    value = one(spark, values.constant([{"w": [0.5, -1e-7], "k": 3}]))
    assert [list(r.w) for r in value] == [[0.5, -1e-7]] and value[0].k == 3


def test_labels(spark):
    assert one(spark, labels.temperature_label(F.col("x")), x=0.0) == "''+0~degree~C"
    assert one(spark, labels.temperature_label(F.col("x")), x=5.1) == "''+5.1~degree~C"
    assert one(spark, labels.coefficient_base(F.col("x")), x="sar1") == "ar1"
    assert one(spark, labels.coefficient_type(F.col("x")), x="sma1") == "Seasonal"
    assert one(spark, labels.recode(F.col("x"), labels.MODEL_NAMES), x="unknown") is None
    assert one(spark, labels.paste(F.col("x"), F.col("y")), x="a", y=None) == "aNA"


def test_crps_at_the_mean(spark):
    value = one(spark, scores.crps_normal(F.lit(5.0), F.lit(2.0), F.lit(5.0)))
    assert value == pytest.approx(2 * (math.sqrt(2) - 1) / math.sqrt(math.pi), abs=1e-6)


def test_crps_against_integration(spark):
    import numpy as np

    mu, sigma, y = 1.0, 2.5, 4.0
    x = np.linspace(-40, 40, 80_001)
    cdf = np.array([0.5 * (1 + math.erf((v - mu) / sigma / math.sqrt(2))) for v in x])
    brute = np.sum((cdf - (x >= y)) ** 2) * (x[1] - x[0])
    assert one(spark, scores.crps_normal(F.lit(mu), F.lit(sigma), F.lit(y))) == pytest.approx(brute, abs=5e-3)


def test_scores_without_spread(spark):
    assert one(spark, scores.crps_normal(F.lit(1.0), F.lit(0.0), F.lit(3.0))) == 2.0
    assert one(spark, scores.log_score_normal(F.lit(1.0), F.lit(0.0), F.lit(3.0))) is None
    assert one(spark, scores.crps_normal(F.lit(1.0), F.col("x"), F.lit(3.0)), x=None) is None


def test_metrics_with_exact_hit_and_missing(spark):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 4.0)], "o double, f double")
    gap = spark.createDataFrame([(1.0, 3.0), (None, 4.0)], "o double, f double")
    g = metrics.geometric_rmse(F.col("o"), F.col("f")).alias("g")
    assert df.agg(g).first().g == 0.0
    assert gap.agg(g).first().g is None
    constant = spark.createDataFrame([(2.0, 1.0), (2.0, 3.0)], "o double, f double")
    assert constant.agg(metrics.r2_one_to_one(F.col("o"), F.col("f")).alias("r")).first().r is None
