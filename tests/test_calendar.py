"""Sunsets and weekly pauses against plain Python."""

import datetime as dt
import math

from tidemark.operators import calendar

UTC = dt.timezone.utc


def plain_sunset(day, lat, lon):
    """Seconds since 1970, in radians and step by step."""
    t = (day + 2440588 - 2451545 - lon / 360) / 36525
    l0 = math.radians((280.46646 + t * (36000.76983 + t * 0.0003032)) % 360)
    m = math.radians(357.52911 + t * (35999.05029 - 0.0001537 * t))
    e = 0.016708634 - t * (0.000042037 + 0.0000001267 * t)
    c = math.sin(m) * (1.914602 - t * (0.004817 + 0.000014 * t)) + math.sin(2 * m) * (0.019993 - 0.000101 * t) + math.sin(3 * m) * 0.000289
    node = math.radians(125.04 - 1934.136 * t)
    place = l0 + math.radians(c - 0.00569 - 0.00478 * math.sin(node))
    tilt = math.radians(23 + (26 + (21.448 - t * (46.815 + t * (0.00059 - t * 0.001813))) / 60) / 60 + 0.00256 * math.cos(node))
    decl = math.asin(math.sin(tilt) * math.sin(place))
    y = math.tan(tilt / 2) ** 2
    eq = 4 * math.degrees(y * math.sin(2 * l0) - 2 * e * math.sin(m) + 4 * e * y * math.sin(m) * math.cos(2 * l0) - 0.5 * y * y * math.sin(4 * l0) - 1.25 * e * e * math.sin(2 * m))
    x = (math.cos(math.radians(90.833)) - math.sin(math.radians(lat)) * math.sin(decl)) / (math.cos(math.radians(lat)) * math.cos(decl))
    return None if abs(x) > 1 else day * 86400 + 60 * (720 - 4 * lon - eq + 4 * math.degrees(math.acos(x)))


def test_sunsets_of_a_year(spark):
    weeks = spark.createDataFrame([(d,) for d in range(19723, 19723 + 366)], "friday int")
    for lat, lon in ((-23.5505, -46.6333), (0.0, 0.0), (31.7683, 35.2137), (52.52, 13.405), (69.65, 18.96), (-33.87, 151.21)):
        for r in calendar.weekly_pauses(weeks, lat, lon, 18).collect():
            for got, day, early in ((r.pause, r.friday, 1080), (r.resume, r.friday + 1, 0), (r.next_pause, r.friday + 7, 1080)):
                want = plain_sunset(day, lat, lon)
                assert (got is None) == (want is None) and (want is None or abs(got - (want - early)) < 0.5)


def test_known_sunsets(spark):
    weeks = spark.createDataFrame([((dt.date(2024, 3, 20) - dt.date(1970, 1, 1)).days,), ((dt.date(2024, 12, 21) - dt.date(1970, 1, 1)).days,)], "friday int")
    got = sorted(r.pause for r in calendar.weekly_pauses(weeks, 51.4779, 0.0, 0).collect())
    # Greenwich: 18:14 at the equinox, 15:53 at the solstice.
    for seconds, (hour, minute) in zip(got, ((18, 14), (15, 53)), strict=True):
        t = dt.datetime.fromtimestamp(seconds, UTC)
        assert abs(t.hour * 60 + t.minute + t.second / 60 - hour * 60 - minute) < 1.5


def test_pauses_across_the_week(spark):
    lat, lon = 59.33, 18.07
    hours = [dt.datetime(2024, 6, 13) + dt.timedelta(minutes=20 * i) for i in range(3 * 24 * 8)]
    df = spark.createDataFrame([(i, t, "own") for i, t in enumerate(hours)] + [(-1, None, "own")], "event_id long, ts timestamp_ntz, pause string")
    got = {r.event_id: r for r in calendar.sabbath(df.drop("pause"), lat, lon, 18).collect()}
    assert got[-1].paused == 0 and got[-1].next_event is None
    fridays = [(dt.date(2024, 6, d) - dt.date(1970, 1, 1)).days for d in (7, 14, 21, 28)]
    spans = [(plain_sunset(f, lat, lon) - 1080, plain_sunset(f + 1, lat, lon)) for f in fridays]
    for i, t in enumerate(hours):
        s = t.replace(tzinfo=UTC).timestamp()
        inside = [b for a, b in spans if a <= s <= b]
        assert got[i].paused == int(bool(inside))
        assert abs(got[i].next_event - (inside[0] if inside else min(a for a, _ in spans if a > s))) < 0.5
    assert calendar.sabbath(df.drop("pause"), 89.0, 0.0).where("paused = 1").count() == 0
