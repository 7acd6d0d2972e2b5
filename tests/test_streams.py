"""Streams that stop, go on and repeat a micro-batch: groups in parts, and tables of the latest row."""

import json
import os
from datetime import datetime, timezone

from pyspark.sql import functions as F

from verdata.streaming import logs as L
from verdata.streaming.upserts import latest, upsert

SCHEMA = "uid long, candidate_index long, accuracy double, arrival long, n_candidates long, time timestamp"


def write(folder, name, rows):
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/{name}.json", "w") as f:
        f.writelines(json.dumps(r) + "\n" for r in rows)


def uncommit(checkpoint):
    """As if the last micro-batch had been cut off before its end was noted."""
    last = max(int(n) for n in os.listdir(f"{checkpoint}/commits") if n.isdigit())
    for n in (str(last), f".{last}.crc"):
        if os.path.exists(f"{checkpoint}/commits/{n}"):
            os.remove(f"{checkpoint}/commits/{n}")
    return last


def test_groups_in_parts(spark, tmp_path):
    """Rows of a group in three micro-batches, a restart before each, a repeated micro-batch, and groups that never become complete."""
    at = f"file://{tmp_path}"
    when = lambda minutes: datetime.fromtimestamp(60 * minutes, timezone.utc).isoformat()
    row = lambda uid, k, minutes: {"uid": uid, "candidate_index": k, "accuracy": float(k == 0 and uid % 4 != 3), "arrival": uid, "n_candidates": 3 if uid % 5 else 1, "time": when(minutes)}

    def go():
        L.stream_fill_batches(spark, f"{at}/in", SCHEMA, 4, f"{at}/out", f"{at}/checkpoint", size="n_candidates", wait_ms=600_000).awaitTermination()
        return sorted((r["train_batch"], r["uid"], r["candidate_index"]) for r in spark.read.parquet(f"{at}/out/full").collect())
    for k in range(3):
        write(f"{tmp_path}/in", f"part{k}", [row(u, k, k + 1) for u in range(40) if (k == 0 or u % 5) and not (k == 2 and u in (6, 8))])
        done = go()
    # Groups of one have equal accuracies only, and every fourth group's are all 0; 6 and 8 still wait.
    good = [u for u in range(40) if u % 5 and u % 4 != 3 and u not in (6, 8)]
    assert done == [(i // 4, u, k) for i, u in enumerate(good[:len(good) // 4 * 4]) for k in range(3)]
    write(f"{tmp_path}/in", "late", [row(100 + u, k, 20) for u in (1, 2, 4) for k in range(3)] + [row(8, 2, 5)])
    after = go()
    assert set(done) <= set(after)
    uids = [u for b, u, k in after if k == 0]
    assert uids[:len(done) // 3] == [u for _, u, k in done if k == 0] and 8 in uids + [u for u in good] and 6 not in uids
    write(f"{tmp_path}/in", "end", [row(200 + u, k, 40) for u in (1, 2) for k in range(3)])
    last = go()
    assert {r["uid"] for r in spark.read.parquet(f"{at}/out/partial").collect()} == {6}
    uncommit(f"{tmp_path}/checkpoint")
    assert go() == last


def test_upserts(spark, tmp_path):
    """A micro-batch writes changed keys only; a repeated one changes nothing; compaction keeps the latest rows."""
    out, plain = f"file://{tmp_path}/table", {}
    assert latest(spark, out, "run") is None
    for b in range(11):
        part = {f"r{k}": b * 10 + k for k in range(b % 4, 7, 3)}
        plain |= part
        df = spark.createDataFrame(list(part.items()), "run string, best long").coalesce(1)
        for _ in range(2 if b in (2, 5, 7) else 1):
            upsert(df, b, out, "run", every=3)
        assert {r["run"]: r["best"] for r in latest(spark, out, "run").collect()} == plain
        assert spark.read.parquet(f"{out}/changes/batch={b:09d}").count() == len(part)
    assert sorted(os.listdir(f"{tmp_path}/table/base")) == ["batch=000000005", "batch=000000008"]
    assert min(os.listdir(f"{tmp_path}/table/changes")) == "batch=000000006"
    assert latest(spark, out, "run", upto=9).where("run = 'r3'").first()["best"] <= 93


def test_best_rows_over_restarts(spark, tmp_path):
    at, schema = f"file://{tmp_path}", "run string, step long, train_reward_v1 double"
    go = lambda: L.stream_best(spark, f"{at}/in", schema, f"{at}/out", f"{at}/checkpoint").awaitTermination()
    write(f"{tmp_path}/in", "a", [{"run": r, "step": s, "train_reward_v1": v} for r, s, v in [("x", 1, 0.1), ("x", 2, 0.3), ("y", 1, 0.5), ("y", 2, None)]])
    go()
    write(f"{tmp_path}/in", "b", [{"run": r, "step": s, "train_reward_v1": v} for r, s, v in [("x", 3, 0.3), ("z", 1, 0.2), ("x", 4, 0.4)]])
    go()
    read = lambda: sorted(tuple(r) for r in latest(spark, f"{at}/out", "run").select("run", "step", "train_reward_v1").collect())
    want = [("x", 4, 0.4), ("y", 1, 0.5), ("z", 1, 0.2)]
    assert read() == want
    last = uncommit(f"{tmp_path}/checkpoint")
    assert {r["run"] for r in spark.read.parquet(f"{at}/out/changes/batch={last:09d}").select(F.col("run")).collect()} <= {"x", "z"}
    go()
    assert read() == want


def test_rows_that_come_late_complete_their_group(spark, tmp_path):
    """A row older than all that came before it still counts while its group waits; what waits is kept for the last two micro-batches only."""
    at = f"file://{tmp_path}"
    row = lambda uid, k, minutes, n=2: {"uid": uid, "candidate_index": k, "accuracy": float(k), "arrival": uid, "n_candidates": n, "time": datetime.fromtimestamp(60 * minutes, timezone.utc).isoformat()}
    parts = [[row(1, 0, 10), row(2, 0, 50)], [row(1, 1, 5), row(3, 0, 51, None)], [row(2, 1, 40), row(4, 0, 60)], [row(5, 0, 200)]]
    for i, rows in enumerate(parts):
        write(f"{tmp_path}/in", f"part{i}", rows)
        L.stream_fill_batches(spark, f"{at}/in", SCHEMA, 1, f"{at}/out", f"{at}/checkpoint", size="n_candidates", wait_ms=3_600_000).awaitTermination()
    # 3 has a size of null, so it is whole with one row, but its accuracies are all equal.
    assert sorted((r["train_batch"], r["uid"], r["candidate_index"]) for r in spark.read.parquet(f"{at}/out/full").collect()) == [(0, 1, 0), (0, 1, 1), (1, 2, 0), (1, 2, 1)]
    assert [r["uid"] for r in spark.read.parquet(f"{at}/out/partial").collect()] == [4]
    assert sorted(os.listdir(f"{tmp_path}/out/waiting")) == ["batch=000000002", "batch=000000003"]
    assert [r["uid"] for r in spark.read.parquet(f"{at}/out/waiting/batch=000000003").collect()] == [5]
