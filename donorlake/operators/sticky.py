"""Sticky ids: an id that lives a fixed time from its assignment and is not renewed by later requests.

When an id ends depends on when it was assigned, so the ids of a browser follow from one another. Requests are first
counted per browser and second (cookie life has second precision), which bounds a browser's rows by the clock. The
counts are then sorted within the partitions of their browser and scanned in batches; the scan keeps the end of the
current id only and never holds a browser as a whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from donorlake.fixed_values import MAX_TEST_ID, TEST_ID_SECONDS

ASSIGNMENTS = "browser_id string, assigned_second bigint, n_requests bigint"


def scan_assignments(life: int):
    """Scan over sorted (browser_id, second, n) batches; everything it needs travels with it to the workers."""
    import numpy as np
    import pandas as pd

    def owners(seconds, current):
        """For each sorted second, the second its id was assigned at, given the assignment that is running."""
        owner = np.empty(len(seconds), dtype=np.int64)
        at = 0
        if current is not None:
            at = int(np.searchsorted(seconds, current + life, side="left"))
            owner[:at] = current
        while at < len(seconds):
            start = int(seconds[at])
            end = int(np.searchsorted(seconds, start + life, side="left"))
            owner[at:end] = start
            at = end
        return owner

    def scan(batches):
        browser, current = None, None
        for pdf in batches:
            if pdf.empty:
                continue
            seconds, codes = pdf["second"].to_numpy(), pdf["browser_id"].to_numpy()
            starts = np.append(0, np.flatnonzero(codes[1:] != codes[:-1]) + 1)
            ends = np.append(starts[1:], len(pdf))
            # Nearly all browsers are done with one id, which begins with their first request.
            owner = np.repeat(seconds[starts], ends - starts)
            more = seconds[ends - 1] >= seconds[starts] + life
            more[0] |= codes[0] == browser
            for k in np.flatnonzero(more):
                running = current if k == 0 and codes[0] == browser else None
                owner[starts[k] : ends[k]] = owners(seconds[starts[k] : ends[k]], running)
            browser, current = codes[-1], int(owner[-1])
            yield pd.DataFrame({"browser_id": codes, "assigned_second": owner, "n_requests": pdf["n"].to_numpy()})

    return scan


def test_id(browser: Column, assigned_second: Column) -> Column:
    """Id in 0..9999, the same for the same assignment wherever and whenever it is computed."""
    digest = F.md5(F.concat_ws(":", browser, assigned_second.cast("string")))
    return F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint"), F.lit(MAX_TEST_ID)).cast("int")


def assignments(requests: DataFrame, browser: str, time: str, life: int = TEST_ID_SECONDS) -> DataFrame:
    """One row per assigned id: browser, when it was assigned, when it ends, how many requests it covers."""
    per_second = requests.groupBy(
        F.col(browser).cast("string").alias("browser_id"), F.unix_seconds(F.col(time)).alias("second")
    ).agg(F.count("*").alias("n"))
    ordered = per_second.repartition("browser_id").sortWithinPartitions("browser_id", "second")
    owned = ordered.mapInPandas(scan_assignments(life), ASSIGNMENTS)
    return finished(owned.groupBy("browser_id", "assigned_second").agg(F.sum("n_requests").alias("n_requests")), life)


def finished(assigned: DataFrame, life: int = TEST_ID_SECONDS) -> DataFrame:
    return assigned.withColumn("expires_second", F.col("assigned_second") + life).withColumn(
        "test_id", test_id(F.col("browser_id"), F.col("assigned_second"))
    )
