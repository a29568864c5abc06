"""Settings that several operators share."""

from __future__ import annotations

DAY = 86_400
#: Rows up to which a side is broadcast; larger ones are joined by shuffle.
BROADCAST_ROWS = 200_000
#: Rows of a table for each task of a job that is dealt by its size.
ROWS_A_TASK = 500_000
