"""The stream of decisions against a loop over the requests in order."""

import datetime as dt
import random

import pytest

from pactline.streaming.admission import admit

START = dt.datetime(2024, 1, 1)


def sequential(requests, limit, seconds):
    """As one would write it for one process that sleeps."""
    out, spent, free = {}, {}, {}
    for tenant, name, at, tokens in sorted({r[:2]: r for r in requests}.values(), key=lambda r: (r[2], r[1])):
        now = max((at - START).total_seconds(), free.get(tenant, 0.0))
        while True:
            held = [(t, n) for t, n in spent.get(tenant, []) if now - t < seconds]
            if not held or sum(n for _, n in held) + tokens <= limit:
                break
            now += max(0.5, seconds - (now - min(t for t, _ in held)) + 0.5)
        spent[tenant], free[tenant] = [*held, (now, tokens)], now
        out[tenant, name] = now
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_stream_is_the_sequential_order(spark, tmp_path, seed):
    rng = random.Random(seed)
    requests = [(f"t{rng.randrange(3)}", f"r{i:03}", START + dt.timedelta(seconds=i * 4 + rng.randrange(4)), rng.choice([10, 30, 80, 250])) for i in range(90)]
    src, out, parts = tmp_path / "in", tmp_path / "out", []
    late = sorted(requests, key=lambda r: r[2] + dt.timedelta(seconds=rng.randrange(100)))  # out of order within the two minutes allowed
    parts = [late[k : k + 18] for k in range(0, 90, 18)]
    for k in range(1, len(parts)):
        parts[k] = parts[k] + rng.sample(parts[k - 1], 6)  # delivered again
    parts.append([("end", "end", START + dt.timedelta(days=1), 1)])
    parts.append([("end", "end2", START + dt.timedelta(days=2), 1)])
    for rows in parts:
        spark.createDataFrame(rows, "tenant string, id string, ts timestamp, tokens long").coalesce(1).write.mode("append").parquet(str(src))
        stream = spark.readStream.schema("tenant string, id string, ts timestamp, tokens long").parquet(str(src))
        decided = admit(stream, 200, 60, "2 minutes")  # started anew for each delivery, from its checkpoint
        decided.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).option("path", str(out)).trigger(availableNow=True).start().awaitTermination()
    got = [r for r in spark.read.parquet(str(out)).collect() if r.tenant != "end"]
    origin = int(START.replace(tzinfo=dt.timezone.utc).timestamp())
    assert len(got) == len(requests)
    assert {(r.tenant, r.id): r.booked_us / 1e6 - origin for r in got} == pytest.approx(sequential(requests, 200, 60))
    assert any(r.booked_us > r.asked_us for r in got)
