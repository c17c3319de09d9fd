"""Moment statistics of streams: tumbling or sliding event-time windows with late data bounded by a watermark.

The Column forms that are built on mergeable aggregates run unchanged in Structured Streaming; state is a handful of
numbers per window and key. Rank statistics need whole groups and have no streaming form.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def windowed(stream: DataFrame, ts: str, statistic: Column | dict[str, Column], window: str, *, slide: str | None = None, watermark: str = "10 minutes", by: Sequence[str] = ()) -> DataFrame:
    """window (start, end), the columns of ``by``, and each statistic, for every window that the watermark has closed.

    ``statistic`` is a Column such as ttest_1samp("value"), named ``r``, or several by name.
    """
    named = statistic if isinstance(statistic, dict) else {"r": statistic}
    grouped = stream.withWatermark(ts, watermark).groupBy(F.window(ts, window, slide) if slide else F.window(ts, window), *by)
    return grouped.agg(*[c.alias(n) for n, c in named.items()])
