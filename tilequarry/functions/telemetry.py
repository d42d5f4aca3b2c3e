"""Device telemetry lines as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _number(line: Column, pattern: str, kind: str, group: int = 1) -> Column:
    text = F.regexp_extract(line, pattern, group)
    return F.when(text != "", text.cast(kind))


def _all(line: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(line, F.lit(pattern), F.lit(group))


def parse(lines: DataFrame, column: str = "raw") -> DataFrame:
    """lines with memory, load, temperature and power fields; what a line lacks is null.

    cpu_util_pct_mean is over the cores that are on; soc_temp_c is the hottest zone named after the chip; temps and rails
    hold all zones and rails (current and average milliwatts) under lower-case names.
    """
    line = F.col(column)
    cores = _all(F.regexp_extract(line, r"CPU\s+\[([^\]]*)\]", 1), r"(\d+)%@", 1)
    loads = F.transform(cores, lambda c: c.cast("double"))
    zones = F.transform(_all(line, r"([A-Za-z0-9_]+)@(-?[0-9.]+)C", 1), F.lower)
    degrees = F.transform(_all(line, r"([A-Za-z0-9_]+)@(-?[0-9.]+)C", 2), lambda c: c.cast("double"))
    rails = F.transform(_all(line, r"([A-Z0-9_]+)\s+(\d+)mW/(\d+)mW", 1), F.lower)
    now = F.transform(_all(line, r"([A-Z0-9_]+)\s+(\d+)mW/(\d+)mW", 2), lambda c: c.cast("double"))
    mean = F.transform(_all(line, r"([A-Z0-9_]+)\s+(\d+)mW/(\d+)mW", 3), lambda c: c.cast("double"))
    pairs = F.filter(F.arrays_zip(zones.alias("z"), degrees.alias("d")), lambda p: p["z"].rlike("soc|tj|cpu"))

    def as_map(k: Column, v: Column) -> Column:
        """Of a name that repeats the last value counts."""
        zipped = F.arrays_zip(k.alias("k"), v.alias("v"))
        keys = F.array_distinct(k)
        return F.map_from_arrays(keys, F.transform(keys, lambda name: F.element_at(F.filter(zipped, lambda p: p["k"] == name), -1)["v"]))

    return lines.withColumns({
        "ram_used_mb": _number(line, r"RAM\s+(\d+)/(\d+)MB", "int"),
        "ram_total_mb": _number(line, r"RAM\s+(\d+)/(\d+)MB", "int", 2),
        "gpu_util_pct": _number(line, r"GR3D_FREQ\s+(\d+)%", "int"),
        "cpu_util_pct_mean": F.when(F.size(loads) > 0, F.aggregate(loads, F.lit(0.0), lambda a, x: a + x) / F.size(loads)),
        "gpu_temp_c": _number(line, r"GPU@(-?[0-9.]+)C", "double"),
        "soc_temp_c": F.array_max(F.transform(pairs, lambda p: p["d"])),
        "power_total_mw": _number(line, r"VDD_IN\s+(\d+)mW", "double"),
        "temps": as_map(zones, degrees),
        "rails": as_map(rails, now),
        "rail_means": as_map(rails, mean),
    })


def align(samples: DataFrame, runs: DataFrame) -> DataFrame:
    """Samples (ts_epoch, ...) within the closed time span of each run (run_id, start, end)."""
    return samples.join(runs, (F.col("ts_epoch") >= F.col("start")) & (F.col("ts_epoch") <= F.col("end")))
