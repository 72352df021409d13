"""Time functions: epoch seconds, minutes, windows in text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONTHS = "January February March April May June July August September October November December".split()


def minute_bucket(t: Column) -> Column:
    """The minute that holds epoch second t (also before 1970)."""
    return t - F.pmod(t, F.lit(60))


def seconds_from_any(value: Column) -> Column:
    """Epoch seconds of a number in seconds, or in milliseconds if it is over 1e10."""
    number = value.try_cast("double")
    return F.when(number > 1e10, number / 1000).otherwise(number)


def parse_time(text: Column) -> Column:
    """Epoch seconds (double) of a number or an ISO text; zone UTC if it names none; null if neither."""
    formats = ["yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS][XXX]", "yyyy-MM-dd HH:mm:ss[.SSSSSS][.SSS][XXX]", "yyyy/MM/dd HH:mm:ss", "yyyy-MM-dd", "dd/MM/yyyy HH:mm:ss"]
    zoned = F.concat(text, F.when(text.rlike(r"(Z|[+-]\d{2}:?\d{2})$"), "").otherwise("Z"))
    parsed = [F.try_to_timestamp(zoned, F.lit(f if "XXX" in f else f + "XXX")) for f in formats]
    return F.coalesce(seconds_from_any(text), *[F.unix_micros(p) / 1e6 for p in parsed])


def local_date_name(t: Column, offset: str = "+08:00") -> Column:
    """yyyy_MM_dd of an epoch second at a fixed offset; the instant itself isn't moved."""
    hours = int(offset[:3])
    return F.date_format(F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'") + F.make_dt_interval(F.lit(0), F.lit(hours), F.lit(0), t.cast("decimal(18,6)")), "yyyy_MM_dd")


def window_in_text(text: Column, offset_hours: int = 8) -> Column:
    """A struct (start, end) of epoch seconds: the first date and the first time or range of times in the
    text, at the offset; one time alone is both. Dates: 2021-03-04, March 4, 2021, 4 March 2021."""
    months = "|".join(MONTHS)
    iso, us, eu = r"(\d{4})-(\d{1,2})-(\d{1,2})", rf"({months}) (\d{{1,2}}),? (\d{{4}})", rf"(\d{{1,2}}) ({months}) (\d{{4}})"
    month = lambda name: F.array_position(F.array(*[F.lit(m) for m in MONTHS]), name).cast("int")
    part = lambda pattern, k: F.regexp_extract(text, pattern, k)
    day = lambda y, m, d: F.datediff(F.make_date(y, m, d), F.lit("1970-01-01").cast("date")).cast("long") * 86400
    date = (
        F.when(text.rlike(iso), day(part(iso, 1).try_cast("int"), part(iso, 2).try_cast("int"), part(iso, 3).try_cast("int")))
        .when(text.rlike(us), day(part(us, 3).try_cast("int"), month(part(us, 1)), part(us, 2).try_cast("int")))
        .when(text.rlike(eu), day(part(eu, 3).try_cast("int"), month(part(eu, 2)), part(eu, 1).try_cast("int")))
    )
    times = F.regexp_extract_all(text, F.lit(r"\b(\d{1,2}:\d{2}(?::\d{2})?)\b"), F.lit(1))
    piece = lambda x, k: F.coalesce(F.get(F.split(x, ":"), F.lit(k)).cast("int"), F.lit(0))
    at = lambda x: piece(x, 0) * 3600 + piece(x, 1) * 60 + piece(x, 2)
    start, end = F.get(times, F.lit(0)), F.coalesce(F.get(times, F.lit(1)), F.get(times, F.lit(0)))
    shift = offset_hours * 3600
    return F.when(
        date.isNotNull() & start.isNotNull(), F.struct((date + at(start) - shift).alias("start"), (date + at(end) - shift).alias("end"))
    )


def minutes_around(t: Column, reach: int = 150) -> Column:
    """The minutes that the window t - reach .. t + reach touches."""
    return F.sequence(minute_bucket(t - reach), minute_bucket(t + reach), F.lit(60).cast("long"))


def hours_between(a: Column, b: Column) -> Column:
    """Whole hours from date text a to date text b."""
    return F.floor((F.unix_micros(F.try_to_timestamp(b)) - F.unix_micros(F.try_to_timestamp(a))) / F.lit(3_600_000_000)).cast("long")


def time_in_path(path: Column) -> Column:
    """Epoch seconds of ``…/2021-03-04/14-31-00/…`` (or with underscores) in a path; null without."""
    p = r"(\d{4})[-_](\d{2})[-_](\d{2})[/_ T](\d{2})[-_:](\d{2})(?:[-_:](\d{2}))?"
    g = lambda k: F.regexp_extract(path, p, k).try_cast("int")
    days = F.datediff(F.make_date(g(1), g(2), g(3)), F.lit("1970-01-01").cast("date")).cast("long")
    return F.when(path.rlike(p), days * 86400 + g(4) * 3600 + g(5) * 60 + F.coalesce(g(6), F.lit(0)))
