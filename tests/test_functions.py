import math

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from matchlake.functions import numeric, patches, scoring, text, timeparts


@pytest.mark.parametrize(
    "patch, padded, expected",
    [
        ("15.20", True, "15.19"),
        ("15.01", True, "14.23"),
        ("1.01", True, None),
        ("15.10", True, "15.09"),
        ("1.00", True, None),
        ("15.10", False, "15.9"),
        ("15", True, None),
        ("15.101", True, "15.100"),
    ],
)
def test_previous_patch(one, patch, padded, expected):
    assert one(patches.previous_patch(F.lit(patch), padded)) == expected


def test_extract_patch(one):
    assert one(patches.extract_patch(F.lit("15.19.715.1836"))) == "15.19"
    assert one(patches.extract_patch(F.lit("15"))) == "15"


def test_filter_patch(spark):
    df = spark.createDataFrame([("15.1", "15.1.7"), ("15.10", "15.10.2")], "patch string, gameVersion string")
    assert patches.filter_patch(df, "15.1").count() == 1
    assert patches.filter_patch(df, "15.1", "prefix").count() == 1
    assert patches.filter_patch(df, "ALL").count() == 2
    with pytest.raises(ValueError):
        patches.filter_patch(df, "15.1", "other")


@pytest.mark.parametrize("value, digits, expected", [(1.234, 2, 1.23), (2.675, 1, 2.7), (-2.5, 0, -3.0), (-0.001, 2, 0.0)])
def test_rnd(one, value, digits, expected):
    got = one(numeric.rnd(F.lit(value), digits))
    assert got == expected and math.copysign(1, got) == math.copysign(1, expected)


@pytest.mark.parametrize("value, expected", [(14.32, "14.3"), (15.0, "15"), (100.04, "100"), (0.5, "0.5")])
def test_plain_number(one, value, expected):
    assert one(numeric.plain_number(F.lit(value))) == expected


def test_rates_without_a_denominator(one):
    assert one(numeric.per_minute(F.lit(100), F.lit(0))) is None
    assert one(numeric.percent(F.lit(1), F.lit(0))) == 0.0
    assert one(numeric.kda(F.lit(5), F.lit(0), F.lit(10))) == 15.0


def test_series_access(one):
    series = F.array(F.lit(1), F.lit(2))
    assert one(numeric.last_or_zero(series)) == 2
    assert one(numeric.last_or_zero(F.array().cast("array<int>"))) == 0
    assert one(numeric.at_or_zero(series, 15)) == 0


@settings(max_examples=5, deadline=None)
@given(st.lists(st.floats(0, 5000), min_size=1, max_size=30))
def test_micros_mean_is_order_free(spark, values):
    def mean(vs, parts):
        df = spark.createDataFrame([(i % parts, v) for i, v in enumerate(vs)], "k int, v double")
        sums = df.groupBy("k").agg(F.sum(numeric.micros("v")).alias("s"), F.count("*").alias("n"))
        return sums.agg(F.sum("s").alias("s"), F.sum("n").alias("n")).select(numeric.mean_of_micros("s", "n")).first()[0]

    a, b = mean(values, 1), mean(list(reversed(values)), 3)
    assert a == b and abs(a - sum(values) / len(values)) < 1e-6


def _metrics(*values):
    return dict(zip(scoring.METRICS, [F.lit(v) if v is not None else F.lit(None).cast("double") for v in values]))


NONE = [None] * 8
GOOD = [55.0, 15.0, 20.0, 3.0, 700.0, 450.0, 8.0, 100]


def _tier(one, now, before=NONE):
    n = _metrics(*now)
    score = scoring.champion_score(n, _metrics(*before))
    return one(scoring.tier(score, n["winRate"], n["banRate"])), one(score)


@pytest.mark.parametrize(
    "now, expected",
    [
        ([58.0, 25.0, 30.0, 4.5, 800.0, 500.0, 10.0, 150], "S+"),
        (GOOD, "S"),
        ([52.0, 12.0, 15.0, 2.5, 600.0, 400.0, 7.0, 100], "A"),
        ([48.0, 8.0, 10.0, 2.0, 500.0, 350.0, 6.0, 100], "B"),
        ([47.0, 5.0, 8.0, 1.8, 450.0, 350.0, 5.0, 100], "C"),
        ([43.0, 2.0, 5.0, 1.5, 350.0, 300.0, 4.0, 100], "D"),
    ],
)
def test_tiers(one, now, expected):
    assert _tier(one, now)[0] == expected


def _score(m):
    clamp = lambda v: max(0, min(100, v))
    wr, br, pr, kda, dpm, gpm, cspm, n = m
    base = (
        clamp((wr - 45) * 10) * 0.35 + clamp(br * 10) * 0.25 + clamp(pr) * 0.15 + min(100, kda / 3 * 100) * 0.1
        + clamp(dpm / 12) * 0.08 + clamp(gpm / 6) * 0.04 + clamp(cspm / 0.085) * 0.03
    )
    return base * (1 if n >= 500 else 0.97 if n >= 200 else 0.94 if n >= 100 else 0.9 if n >= 50 else 0)


@pytest.mark.parametrize(
    "now, before, extra",
    [
        (GOOD, [50.0, 10.0, 15.0, 2.5, 600.0, 400.0, 7.0, 100], 5),
        ([52.0, 12.0, 15.0, 2.5, 600.0, 400.0, 7.0, 100], [60.0, 20.0, 25.0, 4.0, 800.0, 500.0, 10.0, 100], -5),
        (GOOD, [54.0, 15.0, 15.0, 2.5, 600.0, 400.0, 7.0, 500], 0),
    ],
)
def test_score_mixes_the_patch_before(one, now, before, extra):
    assert _tier(one, now, before)[1] == pytest.approx(_score(now) * 0.7 + _score(before) * 0.3 + extra)


def test_few_games(one):
    assert _tier(one, GOOD[:7] + [30])[1] == 0.0
    before = GOOD[:7] + [49]
    assert _tier(one, GOOD, before)[1] == pytest.approx(_score(GOOD))


@pytest.mark.parametrize("games, factor", [(500, 1.0), (200, 0.97), (100, 0.94), (50, 0.9), (49, 0.0)])
def test_confidence(one, games, factor):
    assert one(scoring.confidence(F.lit(games))) == factor


def test_text(one):
    assert one(text.normalise_name(F.lit(" Miss  Fortune"))) == "missfortune"
    assert one(text.first_filled(F.lit(""), F.lit("TOP"))) == "TOP"
    assert one(text.first_filled(F.lit(None).cast("string"), F.lit(""))) == ""
    assert one(text.key_pseudonym(F.lit("abc"))) == "ba7816bf8f01cfea"
    assert one(text.key_pseudonym(F.lit(None).cast("string"))) == "default"
    assert text.role_alias("MID") == "MIDDLE" and text.role_alias("TOP") == "TOP"
    urls = one(text.image_urls(F.lit("Annie"), F.lit("15.1.1")))
    assert urls["square"].endswith("/15.1.1/img/champion/Annie.png") and urls["splash"].endswith("/splash/Annie_0.jpg")


def test_local_time_ignores_the_session_zone(spark, one):
    ms = 1704067200000 + 90 * 60 * 1000  # Monday 01:30 UTC, Sunday 22:30 local
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for z in ("UTC", "Asia/Tokyo"):
            spark.conf.set("spark.sql.session.timeZone", z)
            assert one(timeparts.local_dow(F.lit(ms))) == 0
            assert one(timeparts.local_hour(F.lit(ms))) == 22
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
