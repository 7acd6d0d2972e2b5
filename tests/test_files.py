import json

from pyspark.sql import functions as F

from verdata.operators import evaluate as E
from verdata.sources import files as S


def test_jsonl(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_text('{"problem": "é", "answer": "1"}\n\n{"problem": broken\n{"problem": "b", "answer": null}\n')
    schema = "problem string, answer string"
    rows = S.read_jsonl(spark, f"file://{p}", schema, strict=False)
    assert sorted(r["problem"] for r in rows.collect()) == ["b", "é"]
    out = f"file://{tmp_path}/out"
    S.write_jsonl(rows, out)
    assert sorted(r["problem"] for r in S.read_jsonl(spark, out, schema).collect()) == ["b", "é"]


def test_runs_and_reports(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"v": 1}\n{"v": 2}\n')
    rows, counts = S.read_runs(spark, {"x": f"file://{tmp_path}/x.jsonl", "gone": f"file://{tmp_path}/gone.jsonl"}, "v long")
    assert rows.count() == 2 and {r["run"]: r["n"] for r in counts.collect()} == {"x": 2, "gone": 0}
    (tmp_path / "base_math12k_greedy_report.json").write_text(json.dumps({"n": 1, "accuracy": 0.5}, indent=1))
    (tmp_path / "bad_report.json").write_text("{")
    got = E.collect_reports(S.read_reports(spark, f"file://{tmp_path}/*_report.json", "n long, accuracy double")).collect()
    assert [(r["run"], r["metric_family"], r["accuracy"]) for r in got] == [("base", "greedy", 0.5)]


def test_row_ids(spark):
    df = spark.createDataFrame([(3,), (1,), (2,)], "k int")
    assert [(r["k"], r["row_id"]) for r in S.with_row_id(df, ["k"], "val").orderBy("k").collect()] == [(1, "val-000000"), (2, "val-000001"), (3, "val-000002")]


def test_split_column_filters(spark, tmp_path):
    p = f"file://{tmp_path}/t.parquet"
    spark.createDataFrame([("train", 1), ("test", 2)], "split string, v int").write.parquet(p)
    assert [r["v"] for r in S.load_examples(spark, f"{p}@test").collect()] == [2]
    assert [r["v"] for r in S.load_examples(spark, p, limit=5).select(F.col("v")).collect()] == [1]


def test_row_ids_in_file_order(spark, tmp_path):
    """JSON lines of several files get the numbers of a plain reader, however they are split."""
    want, n = {}, 0
    for name in ("b.json", "a.json", "c.json", "empty.json"):
        lines = [{"k": f"{name}-{i}", "pad": "x" * (i * 7 % 50)} for i in range({"b.json": 700, "a.json": 3, "c.json": 150, "empty.json": 0}[name])]
        (tmp_path / name).write_text("".join(json.dumps(x) + "\n" for x in lines))
    for f in sorted(tmp_path.iterdir()):
        for line in f.read_text().splitlines():
            want[json.loads(line)["k"]] = (n, f"val-{n:06d}")
            n += 1
    conf, old = spark.conf, spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("1500", "20000", old):
            conf.set("spark.sql.files.maxPartitionBytes", size)
            df = spark.read.schema("k string, pad string").json(f"file://{tmp_path}")
            out = S.with_file_row_id(df, "val")
            assert {r["k"]: (r["row_index"], r["row_id"]) for r in out.collect()} == want
            kept = {r["k"]: r["row_index"] for r in S.with_file_row_id(df.where("length(pad) > 20"), "val").collect()}
            assert [k for k, _ in sorted(kept.items(), key=lambda x: x[1])] == [k for k, (i, _) in sorted(want.items(), key=lambda x: x[1]) if k in kept] and sorted(kept.values()) == list(range(len(kept)))
    finally:
        conf.set("spark.sql.files.maxPartitionBytes", old)
    assert S.with_file_row_id(spark.read.schema("k string").json(f"file://{tmp_path}/empty.json"), "val").count() == 0
