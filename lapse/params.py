"""Domain parameters.  They stay parameters: nothing below is hard-wired into
an operator, every operator receives the values it needs."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field, replace


@dataclass(frozen=True)
class Params:
    last_date: dt.date            # last day covered by transactions / logs
    fwd_window_days: int          # forward-revenue window (ref, ref + n]
    grace_days: int               # churn grace (ref, ref + n]
    engagement_days: int          # trailing log window [ref - (n-1), ref]
    recent_days: int              # recent sub-window [ref - (n-1), ref]
    guard_corrupted_expiry: bool = True
    require_paid_ref: bool = True         # only paid cycles set a ref_date
    renewal_requires_paid: bool = False   # feature pipeline counts $0 renewals
    split_fracs: tuple = (0.70, 0.15, 0.15)
    seed: int = 42
    extra: dict = field(default_factory=dict)

    @property
    def cutoff(self) -> dt.date:
        """Latest ref_date that still leaves a full forward window."""
        return self.last_date - dt.timedelta(days=self.fwd_window_days)

    @property
    def prior_days(self) -> int:
        return self.engagement_days - self.recent_days

    def with_(self, **kw) -> "Params":
        return replace(self, **kw)


# The reference's published configuration.
REFERENCE_PARAMS = Params(
    last_date=dt.date(2017, 2, 28),
    fwd_window_days=59,
    grace_days=30,
    engagement_days=30,
    recent_days=7,
)

# Parameters for the adapted driver tables (orders span 1995-01-01 .. 2001-08-01).
TEST_PARAMS = Params(
    last_date=dt.date(2001, 8, 1),
    fwd_window_days=177,
    grace_days=90,
    engagement_days=180,
    recent_days=42,
)
