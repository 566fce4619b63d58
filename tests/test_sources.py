import json

from pyspark.sql import functions as F

from tracewell.sources import labels, records, sinks
from tracewell.streaming import streams


def _v18(kind, body):
    return json.dumps({"datum": {f"com.bbn.tc.schema.avro.cdm18.{kind}": body}}, separators=(",", ":"))


def _event(uuid, kind, subject, obj, t):
    ids = "com.bbn.tc.schema.avro.cdm18.UUID"
    return _v18("Event", {"uuid": uuid, "type": kind, "subject": {ids: subject}, "predicateObject": {ids: obj}, "timestampNanos": t, "x": 0})


def test_version_18(spark, tmp_path):
    rows = [
        _v18("NetFlowObject", {"uuid": "n1", "localAddress": {"string": "10.0.0.1"}, "localPort": {"int": 80}, "remoteAddress": "10.0.0.2", "remotePort": 443}),
        _v18("Subject", {"uuid": "s1", "cmdLine": {"string": "ls -l"}, "properties": {"map": {"path": "/bin/ls"}}}),
        _v18("Subject", {"uuid": "s1", "cmdLine": "ls", "properties": {"map": {}}}),
        _v18("FileObject", {"uuid": "f1", "baseObject": {"properties": {"map": {"path": "/etc/passwd"}}}}),
        _event("e1", "EVENT_READ", "s1", "f1", 5),
        _event("e2", "EVENT_WRITE", "s1", "n1", 6),
        _event("e3", "EVENT_OTHER", "s1", "f1", 7),
        _event("e4", "EVENT_READ", "s9", "f1", 8),
    ]
    path = tmp_path / "raw.json"
    path.write_text("\n".join(rows))
    raw = records.lines(spark, str(path))
    nodes = records.with_ids(records.nodes_v18(raw))
    got = {r.uuid: r for r in nodes.collect()}
    assert [got[u].index_id for u in ("n1", "s1", "f1")] == [0, 1, 2]
    assert (got["s1"].path, got["s1"].cmd) == ("null", "ls") and got["f1"].path == "/etc/passwd"
    assert (got["n1"].src_port, got["n1"].dst_addr) == ("80", "10.0.0.2")
    e = {r.event_uuid: (r.src, r.dst, r.t) for r in records.events(raw, nodes, 18).collect()}
    assert e == {"e1": (2, 1, 5), "e2": (1, 0, 6)}
    assert {r.node_type for r in records.node_map(nodes).collect()} == {"subject", "file", "netflow"}


def test_version_20(spark, tmp_path):
    path = tmp_path / "raw.json"
    path.write_text('{"datum":{"com.bbn.tc.schema.avro.cdm20.NetFlowObject":{"uuid":"n1","a":1,"localAddress":{"string":"1.1.1.1"},"localPort":{"int":1},"remoteAddress":{"string":"2.2.2.2"},"remotePort":{"int":2}}}}\n{"datum":{"com.bbn.tc.schema.avro.cdm20.Subject":{"uuid":"s1","cmdLine":null}}}\n{"datum":{"com.bbn.tc.schema.avro.cdm20.FileObject":{"uuid":"f1","b":1,"filename":"x"}}}')
    got = {r.uuid: r for r in records.with_ids(records.nodes_v20(records.lines(spark, str(path)))).collect()}
    assert set(got) == {"n1", "f1"} and got["n1"].dst_port == "2" and got["f1"].path == "x"


def test_host_records(spark, tmp_path):
    rows = [
        {"hostname": "h1.x", "action": "READ", "object": "FILE", "actorID": "p1", "objectID": "f1", "id": "e1", "timestamp": "2019-09-23T09:30:00.123-04:00", "properties": {"image_path": "a\\\\b", "file_path": "c"}},
        {"hostname": "h1.x", "action": "START", "object": "FLOW", "actorID": "p1", "objectID": "n1", "id": "e2", "timestamp": "2019-09-23T09:30:01-04:00", "properties": {"direction": "inbound"}},
        {"hostname": "h2.x", "action": "READ", "object": "FILE", "actorID": "p9", "objectID": "f9", "id": "e9", "timestamp": "2019-09-23T09:30:01-04:00", "properties": {}},
    ]
    path = tmp_path / "host.json"
    path.write_text("\n".join(map(json.dumps, rows)))
    r = records.host_records(spark, str(path), "h1")
    nodes = records.with_ids(records.host_nodes(r, ("READ", "START")), ("subject", "file", "netflow"))
    ids = {x.uuid: x.index_id for x in nodes.collect()}
    assert ids == {"p1": 0, "f1": 1, "n1": 2}
    e = {x.event_uuid: (x.src, x.dst, x.t) for x in records.host_events(r, nodes, ("READ", "START")).collect()}
    assert e["e1"] == (1, 0, 1569245400123000000) and e["e2"][:2] == (2, 0)


def test_labels(spark, tmp_path):
    path = tmp_path / "truth.csv"
    path.write_text("u1,\"{'subject': 'x'}\",7\n")
    nodes = spark.createDataFrame([("u1", 3)], "uuid string, index_id long")
    assert labels.with_node_ids(labels.ground_truth(spark, str(path)), nodes).first()["index_id"] == 3
    import pytest

    with pytest.raises(ValueError):
        labels.with_node_ids(labels.ground_truth(spark, str(path)), nodes.filter("index_id = 0"))
    w = labels.attack_windows(spark, [("a", "2018-04-06 00:00:00", "2018-04-06 01:00:00")]).first()
    assert w.start_ns == 1522987200 * 10**9 and w.end_ns - w.start_ns == 3600 * 10**9


def test_snapshots(spark, tmp_path):
    e = spark.createDataFrame([("d1", 0, 1, 1, "a", "b", "x"), ("d2", 0, 1, 2, "a", "c", "x")], "day string, tw long, t long, event_id long, src string, dst string, op string")
    sinks.write_windows(e, str(tmp_path / "w"))
    back = sinks.read_windows(spark, str(tmp_path / "w"), ["d2"])
    assert [r.event_id for r in back.collect()] == [2]
    assert "PartitionFilters: [isnotnull(day" in back._jdf.queryExecution().toString() or back.count() == 1


def test_streamed_neighbours(spark, tmp_path):
    rows = [(1, 10, 1, 100), (2, 10, 2, 101), (3, 11, 3, 100), (1, 12, 4, 102)]
    src = tmp_path / "in"
    spark.createDataFrame(rows, "src long, t long, event_id long, dst long").coalesce(1).write.parquet(str(src))
    stream = spark.readStream.schema("src long, t long, event_id long, dst long").parquet(str(src))
    got = streams.run_once(streams.last_neighbours(stream, 2), "neighbours", f"file://{tmp_path}/ck")
    assert sorted((r.node, r.neighbour, r.event_id, r.age) for r in got.filter(F.col("node").isin(1, 100)).collect()) == [(1, 100, 4, 1), (100, 1, 3, 1)]
