"""Run settings shared by the operators; checked before anything is planned."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

SYSLOG_FORMATS = ("rfc3164", "rfc5424")


@dataclass(frozen=True)
class Settings:
    run_id: str = "run-1"
    vendor: str = "Watchloom"
    syslog_format: str = "rfc3164"

    def __post_init__(self):
        if self.syslog_format not in SYSLOG_FORMATS:
            raise ValueError(f"unknown syslog format {self.syslog_format!r}; use one of {SYSLOG_FORMATS}")


@dataclass(frozen=True)
class TimingProfile:
    """The activity curve of a site: office hours, nights and, on request, weekends."""

    avg_delay_seconds: float = 1.0
    jitter: float = 0.2
    work_start: int = 9
    work_end: int = 17
    utc_offset_hours: float = 0.0
    after_hours_factor: float = 0.1
    weekend_factor: float = 0.15
    weekends: bool = False

    def __post_init__(self):
        if self.avg_delay_seconds <= 0 or not 0 < self.after_hours_factor or not 0 < self.weekend_factor:
            raise ValueError("delays and factors must be positive")
        if self.jitter < 0:
            raise ValueError("jitter must not be negative")


def check_window(start: datetime, end: datetime) -> None:
    if end <= start:
        raise ValueError("the window must end after it starts")


def check_days(days: float) -> None:
    if days <= 0:
        raise ValueError("the number of days must be positive")
