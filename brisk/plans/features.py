"""Logs to model features: one lazy plan from five logs to the panel with baselines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import daily
from ..operators.panel import dense_panel, rolling_baselines, stack_days
from ..sources import logs
from ..sources.settings import Settings

BY_LOG = {"logon": daily.logon_days, "device": daily.device_days, "http": daily.http_days, "email": daily.email_days, "file": daily.file_days}


def user_days(tables: dict[str, DataFrame], terms: daily.Terms) -> DataFrame:
    """Dense user-day counters from typed logs; logs that are missing leave their columns out."""
    parts = [make(tables[name], terms) for name, make in BY_LOG.items() if name in tables]
    hosted = lambda name: name in tables and any(c in tables[name].columns for c in daily.PC)
    if hosted("device") and hosted("file"):
        parts.append(daily.usb_file_days(tables["device"], tables["file"], terms))
    if hosted("file") and hosted("email"):
        parts.append(daily.email_after_file_days(tables["file"], tables["email"], terms))
    return dense_panel(stack_days(parts))


def build(spark: SparkSession, settings: Settings) -> tuple[DataFrame, DataFrame]:
    """(user-day features, features with baselines) of a data set."""
    root = settings.paths["dataset"]
    manifest = logs.inspect(spark, root)
    if not manifest.usable:
        raise ValueError(manifest.report())
    snaps = logs.snapshots(spark, f"{root}/LDAP")
    terms = daily.Terms(**{**settings.terms.__dict__, "domains": settings.terms.domains or logs.domain_table(snaps)})
    tables = {name: logs.events(spark, f"{root}/{name}.csv") for name in logs.LOGS}
    days = logs.attach_organisation(user_days(tables, terms), snaps, known=bool(manifest.snapshots))
    return days, rolling_baselines(days, settings.rolling_window_days, settings.min_history_days)
