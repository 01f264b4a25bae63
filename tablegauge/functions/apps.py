"""Recognising business-intelligence clients by their application name."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tablegauge.constants import BI_EXACT_NAMES, BI_NAME_FRAGMENTS


def application_name(client_environment: str = "client_environment") -> Column:
    """Application named in the client's JSON; NULL when it is absent or not JSON."""
    return F.get_json_object(client_environment, "$.APPLICATION")


def bi_flag(hosted: tuple[str, ...] = (), application: str = "application_name") -> Column:
    """1 for a BI tool or dashboard, NULL for anything else, so that count() counts them.

    ``hosted`` are whole names of the platform's own dashboards, in any letter case, with % and _
    as wildcards.
    """
    fragments = ", ".join(f"'%{fragment}%'" for fragment in BI_NAME_FRAGMENTS)
    name = F.col(application)
    known = F.expr(f"{application} ilike any ({fragments})") | name.isin(*BI_EXACT_NAMES)
    return F.when(reduce(Column.__or__, map(name.ilike, hosted), known), F.lit(1))
