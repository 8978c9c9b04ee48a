"""Instants, local calendar days and the temporal state of a bid.

Sessions run in UTC (``session.configure``); a local day is always derived with
an explicit zone. ``now`` is always a parameter.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from bidspan.session import LOCAL_ZONE

OPEN_STATUS = 1  # fixed value: published purchase


def local_to_utc(text: Column, zone: str = LOCAL_ZONE) -> Column:
    """Source text to an instant: an explicit offset is respected, otherwise it is local time."""
    has_offset = text.rlike(r"(?i)(Z|[+-]\d{2}:?\d{2})$")
    with_offset = F.regexp_replace(text, r"([+-]\d{2})(\d{2})$", "$1:$2").try_cast("timestamp")
    clock = F.regexp_extract(text, r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(?::\d{2})?", 0).try_cast("timestamp_ntz")
    return F.when(has_offset, with_offset).otherwise(F.to_utc_timestamp(clock.cast("timestamp"), zone))


def local_day(instant: Column, days: int = 0, zone: str = LOCAL_ZONE) -> Column:
    return F.date_add(F.to_date(F.from_utc_timestamp(instant, zone)), days)


def day_start(day: Column, days: int = 0, zone: str = LOCAL_ZONE) -> Column:
    """First instant of the local day ``day + days``; [day, day+n) is two of these."""
    return F.to_utc_timestamp(F.date_add(day.cast("date"), days).cast("timestamp"), zone)


def is_open(status_id: Column, opens_at: Column, closes_at: Column, now: Column) -> Column:
    """Start inclusive, end exclusive. A missing date is not open; a missing status is unknown."""
    dated = opens_at.isNotNull() & closes_at.isNotNull()
    return (status_id == OPEN_STATUS) & dated & F.coalesce((opens_at <= now) & (now < closes_at), F.lit(False))


def temporal_state(status_id: Column, opens_at: Column, closes_at: Column, now: Column) -> Column:
    """Six states in fixed order; doubt is kept, never turned into "closed"."""
    return (
        F.when(opens_at.isNull() | closes_at.isNull(), "indeterminada")
        .when(opens_at > closes_at, "inconsistente")
        .when(~F.coalesce(status_id == OPEN_STATUS, F.lit(False)), "nao_divulgada")
        .when(now < opens_at, "nao_iniciada")
        .when(now >= closes_at, "encerrada")
        .otherwise("aberta")
    )


def _micros(instant: Column) -> Column:
    return F.unix_micros(instant)


def days_left(instant: Column, now: Column) -> Column:
    return F.ceil((_micros(instant) - _micros(now)) / 86_400_000_000).cast("int")


def business_days_back(instant: Column, n: int = 3, hour: int = 18, zone: str = LOCAL_ZONE) -> Column:
    """``hour`` o'clock, local, on the n-th weekday before the instant's local day."""
    day = local_day(instant, 0, zone)
    span = n + 2 * (n // 5 + 1)
    back = F.sequence(F.date_add(day, -1), F.date_add(day, -span), F.expr("interval -1 day"))
    weekdays = F.filter(back, lambda d: F.weekday(d) < 5)
    at = F.element_at(weekdays, n).cast("timestamp") + F.make_dt_interval(hours=F.lit(hour))
    return F.to_utc_timestamp(at, zone)


def sync_fresh(status: Column, finished: Column, now: Column, hours: int = 6) -> Column:
    recent = _micros(now) - _micros(finished) <= hours * 3_600_000_000
    return F.coalesce((status == "concluido") & recent, F.lit(False))


def closable_date(from_day: Column, to_day: Column, today: Column) -> Column:
    """Last day a covered window may close; today never closes."""
    yesterday = F.date_sub(today, 1)
    return F.when(to_day < today, to_day).when(from_day <= yesterday, yesterday)


def parse_yyyymmdd(text: Column) -> Column:
    return F.when(text.rlike(r"^\d{8}$"), F.try_to_date(text, "yyyyMMdd"))


def validate_range(start: Column, end: Column, max_days: int = 365) -> Column:
    """NULL when the pair is a valid ordered range, otherwise the reason."""
    a, b = parse_yyyymmdd(start), parse_yyyymmdd(end)
    return (
        F.when(a.isNull(), "data inicial inválida")
        .when(b.isNull(), "data final inválida")
        .when(a > b, "datas fora de ordem")
        .when(F.datediff(b, a) > max_days, "intervalo maior que o permitido")
    )


def format_day(instant: Column, zone: str = LOCAL_ZONE) -> Column:
    shown = F.date_format(F.from_utc_timestamp(instant, zone), "dd/MM/yyyy")
    return F.coalesce(shown, F.lit("—"))


def format_day_time(instant: Column, zone: str = LOCAL_ZONE) -> Column:
    shown = F.date_format(F.from_utc_timestamp(instant, zone), "dd/MM/yyyy, HH:mm")
    return F.coalesce(shown, F.lit("—"))


def format_long(instant: Column, zone: str = LOCAL_ZONE) -> Column:
    local = F.from_utc_timestamp(instant, zone)
    shown = F.concat(F.date_format(local, "dd/MM/yyyy"), F.lit(" às "), F.date_format(local, "HH:mm"))
    return F.coalesce(shown, F.lit("—"))
