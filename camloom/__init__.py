"""Analytics over camera signals on Spark: detection, rule cascades, tuning, clips, statistics and streams."""
