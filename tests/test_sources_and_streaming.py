import pytest
from pyspark.sql import functions as F

from pitchlake.sources import readers, schemas, sinks
from pitchlake.streaming import live


def test_tracks_round_trip_and_prune(spark, tmp_path):
    rows = readers.track_rows(spark, "m1", 3, [(0.2, 0, 0, 2, 4), (0.1, 0, 0, 2, 4, 0.5)])
    sinks.write_tracks(rows.select(*[F.col(c.split()[0]).cast(c.split()[1]) for c in schemas.PLAYERS.split(", ")]), str(tmp_path / "players"))
    spark.createDataFrame([("m1", 3, 1, 0.9, None, 7, None, [3])], schemas.TRACK_META).write.parquet(str(tmp_path / "track_meta"))
    got = readers.read_tracks(spark, str(tmp_path)).orderBy("t").collect()
    assert [(r["t"], r["conf"], r["team"]) for r in got] == [(0.1, 0.5, 1), (0.2, 1.0, 1)]
    with pytest.raises(ValueError):
        readers.track_rows(spark, "m", 1, [(0, 1, 2)])
    assert readers.ball_rows(spark, "m", [(0.0, 1.0, 2.0)]).first()["conf"] == 1.0


def test_documents_are_lenient(spark, tmp_path):
    assert readers.read_document(spark, str(tmp_path / "none.json"), "a int").count() == 0
    (tmp_path / "bad.json").write_text("{oops")
    (tmp_path / "good.json").write_text('{"a": 4}')
    paths = [str(tmp_path / n) for n in ("none.json", "bad.json", "good.json")]
    assert readers.first_document(spark, paths, "a int").first()["a"] == 4


def test_roster_aliases_duplicates_and_missing(spark, tmp_path):
    (tmp_path / "r.csv").write_text("Name,Shirt Number,Side\nAnn,7,home\nBob,7,home\n,9,home\nCid,7,away\n")
    good, bad = readers.read_roster(spark, str(tmp_path / "r.csv"))
    assert sorted(r["player_name"] for r in good.collect()) == ["Ann", "Cid"]
    assert sorted(r["reason"] for r in bad.collect()) == ["duplicate", "missing"]


def test_partition_replacement_and_bookmarks(spark, tmp_path):
    path = str(tmp_path / "events")
    rows = lambda job, n: spark.createDataFrame([(job, i) for i in range(n)], "job int, i int")
    sinks.replace_partitions(rows(1, 3).unionByName(rows(2, 3)), path, "job")
    sinks.replace_partitions(rows(2, 1), path, "job")
    assert spark.read.parquet(path).groupBy("job").count().orderBy("job").collect() == [(1, 3), (2, 1)]
    sinks.write_bookmarks_csv(spark.createDataFrame([("b", ["x", "y"])], "id string, sources array<string>"), str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).first()["sources"] == "x,y"


def test_streams_equal_their_batch_forms(spark, tmp_path):
    schema = "match_id string, t double, x double, y double"
    rows = [("m", i * 0.1, float(i), 0.0) for i in range(40)] + [("m", 2.05, 500.0, 0.0), ("m", 900.0, 1.0, 1.0)]
    for n, part in enumerate((rows[:20], rows[20:])):
        spark.createDataFrame(part, schema).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).parquet(str(tmp_path / "in")).withColumn("ts", F.timestamp_seconds("t"))
    live.write_once(live.tumbling(source, ["match_id"], "1 second", "x"), str(tmp_path / "win"), str(tmp_path / "c1")).awaitTermination(120)
    windows = {r["start"].timestamp(): r["n"] for r in spark.read.parquet(str(tmp_path / "win")).collect()}
    assert sum(windows.values()) == 41 and windows[0.0] == 10
    live.write_once(live.live_ball(source.drop("ts"), 20.0, 2.0), str(tmp_path / "ball"), str(tmp_path / "c2")).awaitTermination(120)
    out = spark.read.parquet(str(tmp_path / "ball"))
    assert out.where("x > 100").count() == 0 and out.count() >= 21


def test_roster_with_two_names_for_a_field(spark, tmp_path):
    (tmp_path / "r.csv").write_text("Name,Player,Kit Number,E-mail\nAnn,Other,7,a@x\n")
    good, _ = readers.read_roster(spark, str(tmp_path / "r.csv"))
    assert [(r["player_name"], r["jersey_number"], r["email"]) for r in good.collect()] == [("Ann", "7", "a@x")]
    (tmp_path / "f.csv").write_text("Full Name,Shirt\nAnn,7\n")
    assert readers.read_roster(spark, str(tmp_path / "f.csv"))[0].count() == 1


def test_upserts_keep_the_rows_that_a_batch_does_not_name(spark, tmp_path):
    schema = "match_id long, ev string, v int, ts timestamp"
    batches = [[(1, "a", 1, 10), (2, "x", 1, 10)], [(1, "b", 2, 20)], [(1, "a", 3, 30), (1, "b", 9, 5), (3, "z", 1, 1)]]
    for n, batch in enumerate(batches):
        spark.createDataFrame([(m, e, v, None) for m, e, v, _ in batch], schema).withColumn("ts", F.timestamp_seconds(F.element_at(F.create_map(*[F.lit(x) for m, e, _, s in batch for x in (f"{m}{e}", s)]), F.concat("match_id", "ev")))).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        live.upsert_batches(stream, str(tmp_path / "out"), ["match_id", "ev"], str(tmp_path / "ck")).awaitTermination(120)
    rows = {(r["match_id"], r["ev"]): r["v"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert rows == {(1, "a"): 3, (1, "b"): 2, (2, "x"): 1, (3, "z"): 1}
