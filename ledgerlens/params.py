"""Report parameters: the anchor date and the business roles of products.

The original reports hard-code one bank's product and entity names and read the
wall clock. Here both are arguments, so a report is reproducible for any date.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field


def month_start(d: dt.date) -> dt.date:
    return d.replace(day=1)


def add_months(d: dt.date, n: int) -> dt.date:
    """Calendar month shift that clamps the day, like Spark ``add_months``."""
    idx = d.year * 12 + (d.month - 1) + n
    y, m = divmod(idx, 12)
    m += 1
    nxt = dt.date(y + (m == 12), m % 12 + 1, 1)
    last = (nxt - dt.timedelta(days=1)).day
    return dt.date(y, m, min(d.day, last))


def prior_month_bounds(as_of: dt.date) -> tuple[dt.date, dt.date]:
    """Half-open ``[start, end)`` of the last full calendar month before ``as_of``."""
    end = month_start(as_of)
    return add_months(end, -1), end


@dataclass(frozen=True)
class ReportParams:
    """Anchor date, product roles and thresholds shared by the reports.

    Defaults are the roles used by the synthetic test star (see FIXTURES.md).
    """

    as_of: dt.date = dt.date(2001, 11, 4)
    home_subsidiary: str = "AFRICA"
    agency_product: str = "STANDARD"
    remit_product: str = "PROMO"
    flagship_product: str = "ECONOMY"
    control_channel: str = "5-LOW"
    treatment_channel: str = "1-URGENT"
    sla_pct: float = 95.0
    products: tuple[str, ...] = field(
        default=("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")
    )

    def replace(self, **kw) -> "ReportParams":
        from dataclasses import replace

        return replace(self, **kw)
