from __future__ import annotations

import random
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from barograph.streaming import changes, devices


def expected(batches, threshold):
    """Every change, device by device; the watermark of a batch is the newest time of the batches before it."""
    last, out = {}, set()
    for batch in batches:
        for ip in {ip for ip, _ in batch}:
            for t in sorted(t for i, t in batch if i == ip):
                if ip not in last or t - last[ip] > threshold:
                    if ip in last:
                        out.add((ip, "OFFLINE", last[ip] + threshold))
                    out.add((ip, "ONLINE", t))
                last[ip] = max(t, last.get(ip, t))
    end = max(t for b in batches for _, t in b)
    return out | {(ip, "OFFLINE", t + threshold) for ip, t in last.items() if t + threshold < end}


@pytest.mark.parametrize("slices", [1, 3])
def test_slices_of_devices_tell_what_each_device_does(spark, folder, slices):
    """Three batches, many devices in few slices, one without a name; a busy device's messages come in several frames."""
    rng, start = random.Random(3), 1_700_000_000
    batches = [[(rng.choice([None, "a", "b", "c", "d", "e"]), start + 5000 * b + rng.randrange(1, 5000)) for _ in range(40)] for b in range(3)]
    batches[1] += [("busy", start + 5000 + i) for i in range(1, 4000)]
    for batch in batches:
        rows = [(ip, datetime.fromtimestamp(t, timezone.utc)) for ip, t in batch]
        spark.createDataFrame(rows, "picow_local_ip string, read_datetime timestamp").coalesce(1).write.mode("append").parquet(f"{folder}/in")
    log = spark.readStream.schema("picow_local_ip string, read_datetime timestamp").option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 500)
    try:
        found = devices.status_changes(log, 600, slices=slices)
        writer = found.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/cp").outputMode("append")
        changes.run_available(writer)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    got = spark.read.schema(found.schema).parquet(f"{folder}/out").select("source_ip", "status", F.unix_seconds("at")).collect()
    assert len(got) == len(set(got))
    assert {tuple(r) for r in got} == expected(batches, 600)
