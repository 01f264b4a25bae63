"""Parameters of a scan. Every time-dependent operator takes its "now" from here."""

from __future__ import annotations

from dataclasses import dataclass, replace
from datetime import date, datetime, timedelta

ALL_DATABASES = "All databases"


@dataclass(frozen=True)
class ScanParams:
    """What a scan looks at and which thresholds it applies.

    ``as_of`` is the single notion of "now" (``YYYY-MM-DD HH:MM:SS``, in the session
    time zone), so that running the same scan twice gives the same answer.
    """

    as_of: str
    window_days: int = 7
    freshness_days: int = 60
    lookback_days: int = 30
    fresh_hours: int = 168
    scope: str | None = None
    #: Percent of the queries looked at; None looks at all of them.
    sample_pct: int | None = None
    min_reads: int = 5
    min_total_reads: int = 10
    min_schema_reads: int = 10
    cr_threshold: float = 0.80
    healthy_threshold: float = 70.0
    pass_threshold: float = 0.50
    large_table_rows: int = 10_000
    #: ``full`` matches PII names as a whole string, ``search`` anywhere in the name.
    pii_match: str = "full"
    #: ``user_type`` under which the platform runs its own statements.
    service_user_type: str = "PLATFORM_SERVICE"
    #: (database, schema, table) of the tables this library writes itself.
    internal_tables: tuple[tuple[str, str, str], ...] = (
        ("TABLEGAUGE", "PUBLIC", "SCAN_RUNS"),
        ("TABLEGAUGE", "PUBLIC", "SCAN_IMPROVEMENT_ITEMS"),
    )
    #: Whole client names, in any letter case, under which the platform's own web application
    #: and command line run dashboards; % and _ are wildcards, a backslash makes them literal.
    #: They are BI clients beside the tools known by name. The names are the platform's, so the
    #: caller gives them; without any, such dashboards are not counted as BI reads.
    hosted_clients: tuple[str, ...] = ()
    #: Queries from which on a session is spread over several tasks.
    hot_queries: int = 10_000
    #: Items listed per scope, and places that the summary names. Lists are made in one task per
    #: scope, which from 1000 items on is given all of a scope's candidates.
    max_items: int = 10
    max_targets: int = 5
    account_name: str = "account"
    role_name: str = "role"

    @property
    def now(self) -> datetime:
        return datetime.fromisoformat(self.as_of)

    @property
    def today(self) -> date:
        return self.now.date()

    @property
    def window_start(self) -> date:
        """First calendar date of the reads window; the window holds window_days + 1 dates."""
        return (self.now - timedelta(days=self.window_days)).date()

    @property
    def window_end(self) -> date:
        """First calendar date after the reads window."""
        return self.today + timedelta(days=1)

    @property
    def single_scope(self) -> str | None:
        """The one database to look at, upper-cased, or None for the whole estate."""
        return None if self.scope in (None, ALL_DATABASES) else self.scope.upper()

    def days_ago(self, days: int) -> str:
        return str(self.now - timedelta(days=days))

    def with_(self, **changes) -> "ScanParams":
        return replace(self, **changes)
