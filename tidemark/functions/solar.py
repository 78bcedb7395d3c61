"""Sunset as an SQL expression, by the usual low-accuracy formulas of the sun's place."""

from __future__ import annotations


def sunset_seconds(day: str, latitude: float, longitude: float) -> str:
    """Seconds since 1970 of the sunset of a day, an SQL expression of ``day`` (days since 1970) that Spark and DuckDB share.

    Degrees north and east are positive.  It is good to about a minute, and null where the sun does
    not set.  The day is that of mean solar time at the place.
    """
    t = f"(({day}) + 2440588.0e0 - 2451545 - ({longitude!r}e0) / 360) / 36525"
    sin, cos, tan = [lambda x, f=f: f"{f}(radians({x}))" for f in ("sin", "cos", "tan")]
    # Fixed values of the formulas: mean longitude and anomaly, eccentricity, centre, node, obliquity, equation of time.
    mean = f"(280.46646e0 + ({t}) * (36000.76983e0 + ({t}) * 0.0003032e0))"
    anomaly = f"(357.52911e0 + ({t}) * (35999.05029e0 - 0.0001537e0 * ({t})))"
    eccentric = f"(0.016708634e0 - ({t}) * (0.000042037e0 + 0.0000001267e0 * ({t})))"
    center = f"({sin(anomaly)} * (1.914602e0 - ({t}) * (0.004817e0 + 0.000014e0 * ({t}))) + {sin(f'2 * {anomaly}')} * (0.019993e0 - 0.000101e0 * ({t})) + {sin(f'3 * {anomaly}')} * 0.000289e0)"
    node = f"(125.04e0 - 1934.136e0 * ({t}))"
    longitude_ = f"({mean} + {center} - 0.00569e0 - 0.00478e0 * {sin(node)})"
    obliquity = f"(23 + (26 + (21.448e0 - ({t}) * (46.815e0 + ({t}) * (0.00059e0 - ({t}) * 0.001813e0))) / 60) / 60 + 0.00256e0 * {cos(node)})"
    sine = f"({sin(obliquity)} * {sin(longitude_)})"
    y = f"({tan(f'{obliquity} / 2')} * {tan(f'{obliquity} / 2')})"
    equation = (
        f"(4 * degrees({y} * {sin(f'2 * {mean}')} - 2 * {eccentric} * {sin(anomaly)} + 4 * {eccentric} * {y} * {sin(anomaly)} * {cos(f'2 * {mean}')} - 0.5e0 * {y} * {y} * {sin(f'4 * {mean}')}"
        f" - 1.25e0 * {eccentric} * {eccentric} * {sin(f'2 * {anomaly}')}))"
    )
    ratio = f"((cos(radians(90.833e0)) - sin(radians({latitude!r}e0)) * {sine}) / (cos(radians({latitude!r}e0)) * sqrt(1 - {sine} * {sine})))"
    angle = f"(CASE WHEN abs({ratio}) <= 1 THEN degrees(acos({ratio})) END)"
    return f"(({day}) * 86400.0e0 + 60 * (720 - 4 * ({longitude!r}e0) - {equation} + 4 * {angle}))"
