"""Sources, guards, checkpoints and the driver contract."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from tabprep.errors import CheckpointError, EmptyInputError, MalformedRecordsError, MissingColumnsError, MissingSourceError
from tabprep.sources import checkpoint as ck
from tabprep.sources import readers


def test_read_csv_missing_tokens(spark):
    d = tempfile.mkdtemp(prefix="tabprep-csv-")
    path = os.path.join(d, "f.csv")
    with open(path, "w") as f:
        f.write("ROW_ID,ARR_DELAY,CANCELLED,DIVERTED,ORIGIN\n1,NA,0,0,JFK\n2,-3.5,0,0,\n3,NaN,0,1,null\n")
    df = readers.read_flights(spark, path)
    rows = {r["row_id"]: r for r in df.collect()}
    assert df.columns == ["row_id", "arr_delay", "cancelled", "diverted", "origin"]
    assert rows[1]["arr_delay"] is None and rows[3]["arr_delay"] is None
    assert rows[2]["arr_delay"] == -3.5 and rows[2]["origin"] is None
    assert dict(df.dtypes)["cancelled"] == "bigint"


def csv_file(text):
    path = os.path.join(tempfile.mkdtemp(prefix="tabprep-csv-"), "f.csv")
    with open(path, "w", newline="") as f:
        f.write(text)
    return path


def test_csv_dialect(spark):
    """Doubled quotes, separators and line ends in quoted fields, backslashes, short
    records, white space around a missing token, numbers that only look like ones."""
    path = csv_file('name,v,ok,x\n"a ""b"" c, d",5,True,1d\n"line\nend",6,false,2\n"back\\",7,,3\n NA ,8\n"",9,TRUE,\n')
    df = readers.read_flights(spark, path)
    assert [(r["name"], r.v, r.ok, r.x) for r in df.orderBy("v").collect()] == [
        ('a "b" c, d', 5, True, "1d"), ("line\nend", 6, False, "2"), ("back\\", 7, None, "3"), (" NA ", 8, None, None),
        (None, 9, True, None)]
    assert dict(df.dtypes) == {"name": "string", "v": "bigint", "ok": "boolean", "x": "string"}


@pytest.mark.parametrize("bad", ["1,2,3", '1,2,', '"a,b",2,,', '"q ""x"", y",2,"3"'])
def test_csv_records_with_surplus_fields(spark, bad):
    path = csv_file(f'a,b\n"x, ""y""",2\n{bad}\n3\n')
    with pytest.raises(MalformedRecordsError) as e:
        readers.read_flights(spark, path)
    assert e.value.count == 1
    with pytest.raises(Exception, match="more fields"):
        readers.read_flights(spark, path, schema=readers.T.StructType([])).collect()
    rest = readers.read_flights(spark, path, on_bad="side")
    assert sorted((r.a, r.b) for r in rest.collect()) == [("3", None), ('x, "y"', 2)]
    assert [r.record for r in readers.rejected_records(spark, path).collect()] == [bad]
    assert rest.select("b").count() == 2


def test_guards(spark):
    with pytest.raises(MissingSourceError):
        readers.read_flights(spark, "/nonexistent/x.csv")
    df = spark.createDataFrame([(1, 0)], "cancelled int, diverted int")
    with pytest.raises(MissingColumnsError):
        readers.require_columns(df, readers.REQUIRED_COLUMNS)
    with pytest.raises(EmptyInputError):
        readers.require_rows(df.where("false"))


def test_checkpoint_roundtrip(spark, run001):
    path = tempfile.mkdtemp(prefix="tabprep-splits-")
    counts = ck.save_splits(run001.featured, path, {"hour_map": run001.hour_map.mapping})
    back = ck.load_splits(spark, path, run001.featured.train.columns)
    assert counts == {"train": 504, "test": 135}
    assert back.train.count() == 504
    assert ck.load_state(spark, path, "hour_map").count() == 24
    rep = {(r["stage"], r["split"]): (r["n_rows"], r["n_cols"])
           for r in ck.stage_report({"cleaned": back}).collect()}
    assert rep[("cleaned", "train")] == (504, 20)


def test_interrupted_saves_leave_the_checkpoint_as_it_was(spark, run001):
    path = tempfile.mkdtemp(prefix="tabprep-splits-")
    broken = run001.featured._replace(test=run001.featured.test.withColumn("x", F.raise_error(F.lit("lost")).cast("int")))
    with pytest.raises(Exception, match="lost"):
        ck.save_splits(broken, path)
    with pytest.raises(CheckpointError):  # train is there, the manifest is not
        ck.load_splits(spark, path)
    ck.save_splits(run001.featured, path, hour_map=run001.hour_map)
    with pytest.raises(Exception, match="lost"):
        ck.save_splits(broken, path)
    assert ck.load_splits(spark, path).train.count() == 504
    hour_map, prep = ck.load_fitted(spark, path)
    assert prep is None and hour_map.n_keys == 24 and hour_map.default == run001.hour_map.default
    ck.save_splits(run001.featured.map(lambda d: d.limit(7)), path)
    assert ck.load_splits(spark, path).test.count() == 7


def test_entry_contract(spark):
    import __spark_entry__ as entry
    out = entry.entry(spark)
    assert out.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    import importlib.util
    there = all(importlib.util.find_spec(m) for m in ("corpus_pipeline", "tabprep.llm"))
    try:
        there = there and importlib.util.find_spec("tabprep.llm.queries") is not None
    except ModuleNotFoundError:
        there = False
    assert ("pipeline" in entry.queries()) == there


def test_streaming_stateless_stage(spark, flights001, run001):
    from tabprep.plans import flights as fl
    from tabprep.streaming import apply_hour_map, stateless_flight_stage

    src = tempfile.mkdtemp(prefix="tabprep-stream-src-")
    flights001.write.mode("overwrite").parquet(src)
    stream = spark.readStream.schema(flights001.schema).parquet(src)
    out = apply_hour_map(stateless_flight_stage(stream), run001.hour_map)
    q = (out.writeStream.format("memory").queryName("flights_stream")
         .option("checkpointLocation", tempfile.mkdtemp(prefix="tabprep-stream-ck-"))
         .outputMode("append").start())
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    got = spark.sql("select * from flights_stream")
    assert got.count() == 1483
    assert got.where("arr_delay < 0").count() == 0
    assert "avg_delay_per_hour" in got.columns
