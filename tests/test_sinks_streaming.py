"""Round trips of the sinks and the streaming step-log rollup."""

import os

from pyspark.sql import functions as F

from paths import SF001
from tessera.operators import metrics as E
from tessera.sources import sinks as S
from tessera.sources import views as V
from tessera.streaming.step_log import run_epoch_rollup

LEDGER = """timestamp,experiment_id,project_name,duration,emissions,energy_consumed,country_name,country_iso_code,region,on_cloud,cloud_provider,cloud_region
2022-02-11T14:07:00,e1,test,82.33,0.001158,0.001707,X,XXX,r,N,,
2022-02-11T14:11:00,e2,test,16.51,0.000248,0.000366,X,XXX,r,N,,
"""


def test_ledger_rollup(spark, tmp_out):
    p = os.path.join(tmp_out, "emissions.csv")
    with open(p, "w") as f:
        f.write(LEDGER)
    r = S.ledger_rollup(S.read_ledger(spark, p)).collect()[0]
    assert r["n_runs"] == 2 and abs(r["duration"] - 98.84) < 1e-9


def test_vocab_round_trip(spark, tmp_out):
    v = spark.createDataFrame([(0, "<UNK>", False), (1, "a", False)], "token_id int, token string, special boolean")
    S.save_vocab(v, tmp_out)
    back, merges = S.load_vocab(spark, tmp_out)
    assert sorted(back.collect()) == sorted(v.collect()) and merges is None


def test_results_csv_and_metrics_json(spark, tmp_out):
    pr = V.pred_ref(spark, SF001).withColumn("length", F.lit("short"))
    rows = E.result_rows(pr, ["conv_id", "turn"], F.lit("7"), F.col("length"))
    S.write_results_csv(rows, os.path.join(tmp_out, "results"))
    back = S.read_results_csv(spark, os.path.join(tmp_out, "results"))
    assert back.count() == rows.count() and back.columns == rows.columns
    loss = V.pair_loss(spark, SF001)
    suite = E.metric_suite(pr, ["conv_id", "turn"], "length", loss)
    S.write_metrics_json(suite, os.path.join(tmp_out, "metrics"))
    js = spark.read.json(os.path.join(tmp_out, "metrics"))
    assert len(js.columns) >= 7
    assert set(js.columns) >= {f"{m}_short" for m in E.SUITE_METRICS}


def test_append_samples(spark, tmp_out):
    p = os.path.join(tmp_out, "samples")
    for step in (1, 2):
        S.append_samples(spark.createDataFrame([("in", "out", step)], "input string, completion string, step long"), p)
    assert sorted(r["step"] for r in spark.read.parquet(p).collect()) == [1, 2]


def test_streaming_rollup_equals_batch(spark):
    stream = run_epoch_rollup(spark, os.path.join(SF001, "events.parquet"))
    batch = E.epoch_rollup(V.step_log(spark, SF001))
    key = ["run", "epoch", "metric"]
    a = {tuple(r[k] for k in key): (round(r["epoch_value"], 9), r["n_steps"], r["last_value"]) for r in stream.collect()}
    b = {tuple(r[k] for k in key): (round(r["epoch_value"], 9), r["n_steps"], r["last_value"]) for r in batch.collect()}
    assert a == b


def _copied(rollup):
    return sorted((r["run"], r["epoch"], r["metric"], round(r["epoch_value"], 6), r["n_steps"], r["last_value"]) for r in rollup.collect())


def test_stream_stops_and_resumes(spark, tmp_out):
    """Two files, a stop, two more files, a batch that runs again: every step
    counts once, and the job goes on from its own checkpoint."""
    from tessera.streaming import step_log as S
    events = spark.read.parquet(os.path.join(SF001, "events.parquet"))
    feed = f"{tmp_out}/feed"

    def put(part):
        events.where(F.pmod("event_id", F.lit(4)) == part).coalesce(1).write.mode("append").parquet(feed)

    def exact():
        ev = spark.read.parquet(feed)
        log = ev.select((F.col("user_id") % 4).alias("run"), F.dayofmonth("ts").alias("epoch"), F.col("event_id").alias("step"),
                        F.col("event_type").alias("metric"), "value", (1 + F.col("event_id") % 8).alias("batch_size"))
        return _copied(E.epoch_rollup(log))

    put(0)
    put(1)
    table = S.advance(spark, feed, "resume")
    assert _copied(S.read_rollup(spark, table)) == exact()
    first = spark.read.parquet(table).select("batch").distinct().count()
    put(2)
    put(3)
    assert S.advance(spark, feed, "resume") == table
    assert _copied(S.read_rollup(spark, table)) == exact()
    batches = sorted(r[0] for r in spark.read.parquet(table).select("batch").distinct().collect())
    assert len(batches) > first  # the new files only, as new batches
    # The last batch was written, but the job died before it was recorded.
    commits = S.job_paths(spark, feed, "resume")[1].replace("file:", "") + "/commits"
    last = max((f for f in os.listdir(commits) if f.isdigit()), key=int)
    for f in (last, f".{last}.crc"):
        if os.path.exists(f"{commits}/{f}"):
            os.remove(f"{commits}/{f}")
    S.advance(spark, feed, "resume")
    assert _copied(S.read_rollup(spark, table)) == exact()
    # Another job on the same feed starts from the beginning.
    assert _copied(S.run_epoch_rollup(spark, feed, "other")) == exact()
