"""The run clock and the few settings that are not part of a rule set."""

from __future__ import annotations

import calendar
from dataclasses import dataclass
from datetime import date, datetime, timedelta, timezone
from zoneinfo import ZoneInfo

from pyspark.sql import Column
from pyspark.sql import functions as F

LOCAL_ZONE = "Asia/Kolkata"

# A month younger than this many days still audits the closes of the month before.
MONTH_CHANGEOVER_DAYS = 7


def shift_months(moment: datetime, months: int) -> datetime:
    """Move by whole months, clamping to the last day of a shorter month."""
    years, month0 = divmod(moment.month - 1 + months, 12)
    year, month = moment.year + years, month0 + 1
    day = min(moment.day, calendar.monthrange(year, month)[1])
    return moment.replace(year=year, month=month, day=day)


@dataclass(frozen=True)
class Clock:
    """The one instant a run is evaluated at. Nothing in the package reads the wall clock."""

    as_of: datetime

    def __post_init__(self) -> None:
        moment = self.as_of
        if moment.tzinfo is None:
            moment = moment.replace(tzinfo=timezone.utc)
        object.__setattr__(self, "as_of", moment.astimezone(timezone.utc))

    @property
    def today(self) -> date:
        return self.as_of.astimezone(ZoneInfo(LOCAL_ZONE)).date()

    @property
    def month_start(self) -> date:
        return self.today.replace(day=1)

    @property
    def close_from(self) -> date:
        """First local day whose closes are still audited."""
        start = self.month_start
        if (self.today - start).days < MONTH_CHANGEOVER_DAYS:
            return (start - timedelta(days=1)).replace(day=1)
        return start

    def months_ago(self, months: int) -> datetime:
        return shift_months(self.as_of, -months)

    def days_ago(self, days: int) -> datetime:
        return self.as_of - timedelta(days=days)

    def today_col(self) -> Column:
        return F.lit(self.today)

    def close_from_col(self) -> Column:
        return F.lit(self.close_from)

    def instant_col(self) -> Column:
        return instant(self.as_of)


def micros(moment: datetime) -> int:
    delta = moment - datetime(1970, 1, 1, tzinfo=timezone.utc)
    return (delta.days * 86_400 + delta.seconds) * 1_000_000 + delta.microseconds


def instant(moment: datetime) -> Column:
    """A timestamp literal that does not depend on the session time zone."""
    return F.timestamp_micros(F.lit(micros(moment)))


@dataclass(frozen=True)
class MailAlias:
    """A second mail domain whose addresses belong to the same people as the main one."""

    alias: str = "homes.example.com"
    main: str = "example.com"


DEFAULT_ALIAS = MailAlias()
