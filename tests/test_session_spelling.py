"""Sessions of feeds that write their times in other ways."""

import random

from emberlog.functions.times import event_time_ms
from emberlog.operators.aggregates import session_parts, sessions
from pyspark.sql import functions as F

ZONES = ("Z", "+02:00", "-05:30", "+0100", "")


def written(rng, ms):
    """One instant in some spelling."""
    import datetime as dt

    zone = rng.choice(ZONES)
    digits = zone.replace(":", "")
    shift = 0 if zone in ("Z", "") else int(digits[0] + "1") * (int(digits[1:3]) * 60 + int(digits[3:5]))
    at = dt.datetime(1970, 1, 1) + dt.timedelta(milliseconds=ms, minutes=shift)
    part = rng.choice(["", f".{ms % 1000:03d}", f".{ms % 1000:03d}{rng.randrange(1000):03d}", f".{ms % 1000 // 100}"])
    return at.strftime(f"%Y-%m-%d{rng.choice('T ')}%H:%M:%S") + part + zone


def brute(rows):
    best = {}
    for r in rows:
        key = (r.ts_ms or 0, r.ts is not None, r.ts or "")
        best[r.session_id] = max(best.get(r.session_id, key), key)
    return {s: (k[2] if k[1] else None, k[0]) for s, k in best.items()}


def test_the_latest_text_comes_back(spark):
    rng = random.Random(7)
    odd = ["soon", None, "2024-13-01", "2024-01-02", "2024-01-02T03:04Z", "1969-12-31T23:59:59.999999Z",
           "1969-12-31T23:59:59.999500+01:00", "0001-01-01T00:00:00Z", "2024-01-02T24:00:00Z", "  2024-01-02T03:04:05Z "]
    rows = [(f"s{rng.randrange(60)}", written(rng, 1_706_000_000_000 + rng.randrange(4000) * 250)) for _ in range(3000)]
    rows += [(f"t{i}", t) for i, t in enumerate(odd)] + [("mixed", t) for t in odd[:4]]
    df = spark.createDataFrame(rows, "session_id string, ts string").select(
        "*", event_time_ms(F.col("ts")).alias("ts_ms"), F.lit("error").alias("level")
    )
    found = {r.session_id: (r.last_ts, r.last_ms) for r in sessions(df).collect()}
    assert found == brute(df.collect())
    assert sum(r.event_count for r in sessions(df).collect()) == len(rows)


def test_other_spellings_do_not_make_groups_of_their_own(spark):
    """A feed that writes zones or microseconds has a few groups for a session, not one for each row."""
    df = spark.range(5000).select(
        F.lit("s").alias("session_id"), F.lit("info").alias("level"),
        F.concat(F.date_format(F.timestamp_micros(F.lit(1_706_000_000_000_000) + F.col("id") * 1_000_007), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"),
                 F.when(F.col("id") % 2 == 0, "+02:00").otherwise("Z")).alias("ts"),
    ).withColumn("ts_ms", event_time_ms(F.col("ts")))
    assert session_parts(df).count() == 2
    row = sessions(df).first()
    assert row.event_count == 5000 and row.last_ts == df.orderBy(F.desc("ts_ms")).first().ts
