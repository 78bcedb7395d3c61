"""Pauses of trading from Friday's to Saturday's sunset."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.solar import sunset_seconds

C = F.col
#: The place, degrees north and east, and the minutes before sunset at which a pause begins.
LATITUDE, LONGITUDE, BUFFER = -23.5505, -46.6333, 18


def weekly_pauses(weeks: DataFrame, latitude: float = LATITUDE, longitude: float = LONGITUDE, buffer: float = BUFFER) -> DataFrame:
    """Each Friday's pause: ``weeks`` has ``friday`` (days since 1970); returns friday, pause, resume and next_pause in seconds since 1970."""
    at = lambda day: F.expr(sunset_seconds(day, latitude, longitude))
    return weeks.select("friday", (at("friday") - 60 * buffer).alias("pause"), at("(friday + 1)").alias("resume"), (at("(friday + 7)") - 60 * buffer).alias("next_pause"))


def sabbath(events: DataFrame, latitude: float = LATITUDE, longitude: float = LONGITUDE, buffer: float = BUFFER) -> DataFrame:
    """Adds ``paused``, whether trading rests at an event's ``ts``, and ``next_event``, when that changes next.

    Each event belongs to the last Friday of its day in mean solar time, so a pause that runs past
    Saturday's midnight is its own still.  Sunsets are computed once for each week that has events,
    and joined by Friday.  Where the sun does not set on one of the two days there is no pause.
    """
    at = F.unix_micros(C("ts").cast("timestamp")) / 1e6
    day = F.floor((at + longitude * 240.0) / 86400)
    # The first day of 1970 was a Thursday.
    d = events.withColumn("friday", (day - F.pmod(day - 1, F.lit(7))).cast("int"))
    weeks = weekly_pauses(d.where("friday is not null").select("friday").distinct(), latitude, longitude, buffer).withColumnRenamed("friday", "_friday")
    j = d.join(weeks, C("friday") == C("_friday"), "left")
    paused = F.coalesce((at >= C("pause")) & (at <= C("resume")), F.lit(False))
    following = F.when(paused, C("resume")).when(at < C("pause"), C("pause")).otherwise(C("next_pause"))
    return j.select(*events.columns, paused.cast("int").alias("paused"), following.alias("next_event"))
