"""Sinks, readers and streams on real files."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from cellsight.plans import release
from cellsight.sources import scans, sinks
from cellsight.streaming import accumulate, alerts, ingest

KEY = ["run_id", "area_id"]


def rows(spark, *values):
    return spark.createDataFrame(list(values), "run_id string, area_id string, value double")


def stored(spark, path):
    return sorted((str(r.run_id), r.area_id, r.value) for r in spark.read.parquet(str(path)).collect())


def test_upsert_updates_inserts_and_leaves_other_partitions(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.upsert(rows(spark, ("r1", "a", 1.0), ("r1", "b", 2.0), ("r2", "a", 3.0)), path, KEY)
    untouched = sorted(p.name for p in (tmp_path / "t" / "run_id=r2").iterdir())
    change = rows(spark, ("r1", "b", 20.0), ("r1", "c", 30.0), ("r3", "a", 4.0))
    for _ in range(2):
        sinks.upsert(change, path, KEY)
        assert stored(spark, path) == [("r1", "a", 1.0), ("r1", "b", 20.0), ("r1", "c", 30.0), ("r2", "a", 3.0), ("r3", "a", 4.0)]
    assert untouched == sorted(p.name for p in (tmp_path / "t" / "run_id=r2").iterdir())


def test_run_ids_that_look_like_dates_stay_text(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.upsert(rows(spark, ("2026-01-01", "a", 1.0), ("007", "a", 2.0)), path, KEY)
    sinks.upsert(rows(spark, ("007", "b", 3.0), ("2026-01-01", "a", 4.0)), path, KEY)
    got = spark.read.schema("run_id string, area_id string, value double").parquet(path).collect()
    assert sorted((r.run_id, r.area_id, r.value) for r in got) == [("007", "a", 2.0), ("007", "b", 3.0), ("2026-01-01", "a", 4.0)]


def test_insert_absent_and_replace_partition(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.insert_absent(rows(spark, ("r1", "a", 1.0), ("r1", "a", 9.0)), path, KEY)
    sinks.insert_absent(rows(spark, ("r1", "a", 5.0), ("r1", "b", 2.0)), path, KEY)
    assert stored(spark, path) == [("r1", "a", 1.0), ("r1", "b", 2.0)]
    other = str(tmp_path / "p")
    sinks.replace_partitions(rows(spark, ("r1", "a", 1.0), ("r2", "a", 2.0)), other, "run_id")
    sinks.replace_partitions(rows(spark, ("r1", "z", 7.0)), other, "run_id")
    assert stored(spark, other) == [("r1", "z", 7.0), ("r2", "a", 2.0)]


def test_artifact_pair_round_trip(spark, tmp_path):
    table = spark.createDataFrame([("area-1", "A", "D", 1.5, 2.5, 50.0, "typical_range", 3, 100.0, "ok"), ("area-2", None, "D", None, None, None, "unavailable", 0, 0.0, "bad")], scans.schemas.RAINFALL_ARTIFACT)
    manifest = spark.createDataFrame([("run-x", "development")], "run_id string, status string")
    sinks.write_artifact(table, manifest, str(tmp_path / "a"))
    back = scans.artifact(spark, str(tmp_path / "a" / "rows"), str(tmp_path / "a" / "manifest"))
    assert {r.area_id: (r.run_id, r.rainfall_mm, r.name_en) for r in back.collect()} == {"area-1": ("run-x", 1.5, "A"), "area-2": ("run-x", None, None)}
    sinks.write_artifact(table.withColumn("area_id", F.concat(F.lit("b-"), "area_id")), manifest.select(F.lit("run-y").alias("run_id"), "status"), str(tmp_path / "b"))
    both = scans.artifact(spark, str(tmp_path / "*" / "rows"), str(tmp_path / "*" / "manifest"))
    assert {(r.area_id, r.run_id, r.run_status) for r in both.collect()} == {(p + a, run, "development") for p, run in (("", "run-x"), ("b-", "run-y")) for a in ("area-1", "area-2")}


def test_feature_collection_files(spark, tmp_path):
    square = [[[0, 0], [1, 0], [1, 1], [0, 0]]]
    doc = {"type": "FeatureCollection", "features": [
        {"id": "f1", "geometry": {"type": "Polygon", "coordinates": square}, "properties": {"id": "x"}},
        {"geometry": {"type": "Polygon", "coordinates": square}, "properties": {"id": "p2"}},
        {"geometry": {"type": "MultiPolygon", "coordinates": [square, square]}, "properties": {"name": "n"}},
    ]}
    (tmp_path / "c.geojson").write_text(json.dumps(doc))
    got = scans.feature_collections(spark, str(tmp_path)).withColumn("rings", scans.polygon_rings(F.col("geometry"))).collect()
    ids = [r.feature_id for r in got]
    assert ids[:2] == ["f1", "p2"] and len(ids[2]) == 16 and [len(r.rings) for r in got] == [1, 1, 2]


def test_documents_are_json_and_whole(spark, tables):
    features = sinks.features_json(tables.areas(), "area_id", ["area_id", "name_en"])
    groups = tables.raw("nation").select(F.col("n_nationkey").alias("district_key"))
    docs = sinks.feature_collections(groups, features, "district_key", "area_id", page_size=2).collect()
    parsed = [json.loads(d.document) for d in docs]
    assert sum(len(p["features"]) for p in parsed) == tables.areas().count()
    assert any(p["features"] == [] for p in parsed) and {d.district_key for d in docs} == set(range(25))


def test_asset_manifest_and_findings(spark, tmp_path):
    import hashlib

    (tmp_path / "a.json").write_bytes(b'{"x":1}')
    (tmp_path / "b.json").write_bytes(b"{}")
    stored_assets = sinks.asset_manifest(spark, str(tmp_path))
    by_name = {r.asset: r for r in stored_assets.collect()}
    assert by_name["a.json"].byte_size == 7 and by_name["a.json"].sha256 == hashlib.sha256(b'{"x":1}').hexdigest()
    day = dt.date(2026, 1, 1)
    declared = spark.createDataFrame([("2026-01-01T000000Z", "a.json", 7, by_name["a.json"].sha256, day, day), ("2026-01-01T000000Z", "c.json", 1, "x", day, day)], "release_id string, asset string, byte_size long, sha256 string, observation_start date, observation_end date")
    assert [(r.asset, r.rule) for r in release.asset_findings(declared, stored_assets).collect()] == [("c.json", "missing_file")]


def test_fingerprint_ignores_order_and_sees_copies(spark):
    df = rows(spark, *[("r", f"a{i}", float(i)) for i in range(50)])
    mark = lambda d: sinks.fingerprint(d, ["run_id", "area_id", "value"])
    same = df.orderBy(F.desc("value")).repartition(7)
    assert sinks.unchanged(mark(same), mark(df))
    assert not sinks.unchanged(mark(df.unionByName(df.limit(1))), mark(df))
    assert not sinks.unchanged(mark(df.where("value < 49")), mark(df))


def test_update_takes_nulls_of_matched_rows(spark):
    new = spark.createDataFrame([("r", "a", None)], "run_id string, area_id string, value double")
    got = sinks.update_columns(rows(spark, ("r", "a", 1.0), ("r", "b", 2.0)), new, KEY, ["value"]).collect()
    assert {r.area_id: r.value for r in got} == {"a": None, "b": 2.0}


def test_links_of_start_tags_only(spark):
    html = '<!-- <x href="no"> --><a href="/a?x=1&amp;y=2">t href="no"</a><a class=b href=\'b.json\'><img src="//cdn.org/i.png"><a href="#top"><a href="/a?x=1&amp;y=2">'
    pages = spark.createDataFrame([(1, "https://h.org/dir/page.html?q=1", html)], "page_id int, url string, html string")
    got = [r.link_url for r in scans.harvest_links(pages).orderBy("position").collect()]
    assert got == ["https://h.org/a?x=1&y=2", "https://h.org/dir/b.json", "https://cdn.org/i.png", "https://h.org/dir/page.html?q=1#top"]
    assert [r.link_url for r in scans.data_files(scans.harvest_links(pages)).collect()] == ["https://h.org/dir/b.json"]


# ---- streams


def drain(stream, target, state):
    q = stream.writeStream.format("parquet").option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start(target)
    q.awaitTermination()


def test_late_preliminary_never_replaces_final(spark, tmp_path):
    schema = "run_id string, area_id string, value double, maturity string, loaded_at timestamp"
    source, target, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    at = lambda d: dt.datetime(2026, 1, d)
    batches = [
        [("r1", "a", 1.0, "preliminary", at(1)), ("r1", "b", 2.0, "preliminary", at(1))],
        [("r1", "a", 10.0, "final", at(2)), ("r1", "a", 11.0, "final", at(3))],
        [("r1", "a", 5.0, "preliminary", at(9)), ("r1", "b", 3.0, "preliminary", at(9))],
    ]
    for batch in batches:
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(source)
        ingest.merge_revisions(ingest.evidence_stream(spark, source, schema), target, state).awaitTermination()
    assert stored(spark, target) == [("r1", "a", 11.0), ("r1", "b", 3.0)]


def test_repeated_delivery_within_the_watermark_counts_once(spark, tmp_path):
    schema = "run_id string, area_id string, value double, ts timestamp"
    at = lambda m: dt.datetime(2026, 1, 1, 0, m)
    spark.createDataFrame([("r", "a", 1.0, at(0)), ("r", "a", 1.0, at(1)), ("r", "b", 2.0, at(2))], schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = ingest.first_of_each(ingest.evidence_stream(spark, str(tmp_path / "in"), schema), KEY, "ts", "1 hour")
    drain(stream, str(tmp_path / "out"), str(tmp_path / "state"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_stream_pentads_equal_batch_after_shuffled_arrival(spark, tables, tmp_path):
    events = tables.raw("events").select("event_type", F.col("ts").cast("timestamp").alias("ts"), "value")
    for part in range(4):  # rows of all days in every file: heavily out of order
        events.where(F.pmod(F.xxhash64("ts"), F.lit(4)) == part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    drain(accumulate.pentad_sums(source, ["event_type"], "ts", "value", "60 days"), str(tmp_path / "open"), str(tmp_path / "s1"))
    assert spark.read.schema("event_type string, day timestamp, total double, observations long").parquet(str(tmp_path / "open")).count() == 0
    closing = events.unionByName(events.limit(1).withColumn("ts", F.expr("ts + INTERVAL 400 DAYS")))
    closing.coalesce(1).write.parquet(str(tmp_path / "in2"))
    source = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in2"))
    drain(accumulate.pentad_sums(source, ["event_type"], "ts", "value", "60 days"), str(tmp_path / "out"), str(tmp_path / "s2"))
    got = accumulate.pentads_of_days(spark.read.parquet(str(tmp_path / "out")), ["event_type"])
    want = accumulate.pentad_sums(events, ["event_type"], "ts", "value")
    as_rows = lambda df: {(r.event_type, r.pentad_ordinal): (round(r.total, 6), r.observations) for r in df.collect()}
    assert as_rows(got) == as_rows(want)


def test_alerts_only_on_change_and_on_silence(spark, tmp_path):
    schema = "source_key string, observation_end timestamp"
    at = lambda d: dt.datetime(2026, 1, d)
    source = str(tmp_path / "in")
    deliveries = [[("s", at(1)), ("t", at(1))], [("s", at(2)), ("t", at(2))], [("t", at(20))], [("t", at(21))], [("s", at(22)), ("t", at(23))]]
    for batch in deliveries:
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(source)
        stream = alerts.alert_stream(spark.readStream.schema(schema).parquet(source), F.lit(5), "1 hour")
        drain(stream, str(tmp_path / "out"), str(tmp_path / "state"))
    got = [(r.source_key, r.state, r.observation_end) for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    s = sorted((end, state) for key, state, end in got if key == "s")
    assert s == [(at(1), "current"), (at(2), "stale"), (at(22), "current")]


def test_a_batch_of_alerts_calls_python_once_for_each_bucket_of_sources(spark, tmp_path, monkeypatch):
    calls = spark.sparkContext.accumulator(0)
    whole = alerts._alerts

    def counted(key, rows, held):
        calls.add(1)
        yield from whole(key, rows, held)

    monkeypatch.setattr(alerts, "_alerts", counted)
    monkeypatch.setattr(alerts, "BUCKETS", 3)
    at = lambda d: dt.datetime(2026, 1, d)
    deliveries = [[(f"s{i}" if i else None, at(1 + i % 3)) for i in range(60)], [(f"s{i}", at(2 + i % 3)) for i in range(1, 60, 2)], [("late", at(1)), ("s1", at(25))], [("t", at(27))]]
    for batch in deliveries:
        spark.createDataFrame(batch, "source_key string, observation_end timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = alerts.alert_stream(spark.readStream.schema("source_key string, observation_end timestamp").parquet(str(tmp_path / "in")), F.lit(5), "1 hour")
        drain(stream, str(tmp_path / "out"), str(tmp_path / "state"))
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).select("source_key", "state", "at", "observation_end").collect()), key=str)
    last = {i: 1 + i % 3 + (i % 2 if i % 3 else 0) for i in range(60)}  # the second of January is behind the watermark by then
    want = [(f"s{i}" if i else None, "current", at(1 + i % 3), at(1 + i % 3)) for i in range(60)]
    want += [(f"s{i}" if i else None, "stale", at(last[i] + 5), at(last[i])) for i in range(60)] + [("s1", "current", at(25), at(25))]
    assert got == sorted(want, key=str)
    assert 0 < calls.value <= 3 * 10  # buckets by batches, with and without new rows; 60 sources would be more


def test_alerts_from_known_states(spark, tmp_path):
    at = lambda d: dt.datetime(2026, 1, d)
    known = spark.createDataFrame([("k", "current", at(1), at(6)), ("m", "current", at(1), at(6)), ("n", "stale", at(1), at(1))], "source_key string, state string, observation_end timestamp, stale_after timestamp")
    for batch in [("k", at(3)), ("n", at(4))], [("t", at(20))], [("t", at(22))]:
        spark.createDataFrame(batch, "source_key string, observation_end timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = alerts.alert_stream(spark.readStream.schema("source_key string, observation_end timestamp").parquet(str(tmp_path / "in")), F.lit(5), "1 hour", known)
        drain(stream, str(tmp_path / "out"), str(tmp_path / "state"))
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).select("source_key", "state", "at", "observation_end").collect()))
    assert got == sorted([("k", "stale", at(8), at(3)), ("m", "stale", at(6), at(1)), ("n", "current", at(4), at(4)), ("n", "stale", at(9), at(4)), ("t", "current", at(20), at(20))])


def test_batch_twin_of_the_alerts(spark):
    rows_ = [("s", i, state) for i, state in enumerate(["current", "current", "stale", "stale", "current"])]
    got = alerts.state_changes(spark.createDataFrame(rows_, "k string, at int, state string"), ["k"], ["at"], "state", F.floor(F.col("at") / 2))
    assert sorted(r.at for r in got.collect()) == [0, 2, 4]
