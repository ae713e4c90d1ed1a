import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.operators.windows import arrays
from orrery.plans.pipeline import STAGES, plan, run
from orrery.sources.manifest import Manifest
from orrery.streaming.windows import count_windows, event_time_statistics

OBS = "cohort string, signal_id string, signal_0 double, value double"


def test_plan_has_inputs_first():
    order = [s.name for s in plan(["ridge_proximity"])]
    assert order == ["velocity_field_components", "velocity_field", "ftle_rolling", "ridge_proximity"]
    assert len(plan()) == len(STAGES) and all(not s.fleet for s in plan(fleet=False))
    with pytest.raises(ValueError):
        plan(["nonsense"])


def test_run_writes_tables(spark, tmp_path):
    rng = np.random.default_rng(5)
    rows = [(f"c{c}", f"s{s}", float(t), float(v)) for c in range(2) for s in range(4) for t, v in enumerate(rng.normal(size=120))]
    spark.createDataFrame(rows, OBS).write.parquet(str(tmp_path / "obs"))
    m = Manifest(observations=str(tmp_path / "obs"), output=str(tmp_path / "out"), window=64, stride=16)
    made = run(spark, m, ["geometry_dynamics", "thermodynamics"])
    assert set(made) == {"typology_windows", "signal_vector", "cohort_geometry", "geometry_dynamics", "thermodynamics"}
    got = spark.read.parquet(made["cohort_geometry"])
    assert got.count() > 0 and got.where("effective_dim < 0.99 or effective_dim > n_features + 0.01").count() == 0


def test_count_windows_stream(spark, tmp_path):
    rng = np.random.default_rng(6)
    rows = [("c", s, float(t), float(v)) for s in ("a", "b") for t, v in enumerate(rng.normal(size=100))]
    spark.createDataFrame(rows, OBS).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(OBS).parquet(str(tmp_path / "in"))
    q = count_windows(stream, 32, 16).writeStream.format("memory").queryName("cw").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = {(r["signal_id"], r["window_id"]): r["mean"] for r in spark.table("cw").collect()}
    want = {(r["signal_id"], r["window_id"]): np.mean(r["y"]) for r in arrays(spark.createDataFrame(rows, OBS), 32, 16).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got)


def test_event_time_windows(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.lit("c").alias("cohort"), F.col("event_type").alias("signal_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").cast("double").alias("value"))
    events.coalesce(1).write.parquet(str(tmp_path / "ev"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "ev"))
    q = event_time_statistics(stream, "1 day", "1 day", "1 day").writeStream.format("memory").queryName("et").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp2")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("et").agg(F.sum("n_points")).first()[0] == events.count()
