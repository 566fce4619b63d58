"""Raw audit records to node and event tables.

Lines are read as text; one scan serves nodes and events. Of several records of
one uuid the last one's attributes count and the first one's place. Node ids
are dense over (kind, first place).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewell.functions.taxonomy import EXCLUDED_OPS, oriented

NODE = ["kind", "uuid", "path", "cmd", "src_addr", "src_port", "dst_addr", "dst_port", "place"]


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(place, value): lines with a place that grows with file name and offset in it."""
    return spark.read.text(path).select(F.struct(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("line")).alias("place"), "value")


def _json(column: str, *paths: str) -> Column:
    """The first of several JSON paths that holds a value."""
    return F.coalesce(*[F.get_json_object(column, p) for p in paths])


def _union(root: str, name: str, kind: str) -> tuple[str, str]:
    """A field given as a union ({"string": ...}) or plain."""
    return f"{root}.{name}.{kind}", f"{root}.{name}"


def _nodes(df: DataFrame, kind: str, **columns: Column) -> DataFrame:
    own = {c: columns.get(c, F.lit(None).cast("string")) for c in NODE if c not in ("kind", "place")}
    return df.select(F.lit(kind).alias("kind"), *[v.alias(c) for c, v in own.items()], "place").filter("uuid is not null and uuid != ''")


def nodes_v18(raw: DataFrame) -> DataFrame:
    """netflow, subject and file records of version 18, from JSON."""
    p = "$.datum['com.bbn.tc.schema.avro.cdm18.{}']"
    flow, subject, file = p.format("NetFlowObject"), p.format("Subject"), p.format("FileObject")
    uuid = lambda root: F.get_json_object("value", f"{root}.uuid")
    one = lambda root, name, kind: F.coalesce(F.get_json_object("value", _union(root, name, kind)[0]), F.get_json_object("value", _union(root, name, kind)[1]))
    null = F.lit("null")
    flows = _nodes(raw.filter(F.col("value").contains("NetFlowObject")), "netflow", uuid=uuid(flow), src_addr=one(flow, "localAddress", "string"), src_port=one(flow, "localPort", "int"), dst_addr=one(flow, "remoteAddress", "string"), dst_port=one(flow, "remotePort", "int"))
    subjects = _nodes(raw.filter(F.col("value").contains("cdm18.Subject")), "subject", uuid=uuid(subject), cmd=F.coalesce(one(subject, "cmdLine", "string"), null), path=F.coalesce(_json("value", f"{subject}.properties.map.path"), null))
    own, base = f"{file}.properties.map", f"{file}.baseObject.properties.map"
    files = _nodes(raw.filter(F.col("value").contains("cdm18.FileObject")), "file", uuid=uuid(file), path=F.coalesce(_json("value", f"{own}.filename", f"{own}.path", f"{base}.filename", f"{base}.path"), null))
    return flows.unionByName(subjects).unionByName(files)


# What a version-20 record must hold, in this order.
FLOW_20 = r'NetFlowObject":\{"uuid":"(.*?)"(.*?)"localAddress":\{"string":"(.*?)"\},"localPort":\{"int":(.*?)\},"remoteAddress":\{"string":"(.*?)"\},"remotePort":\{"int":(.*?)\}'
SUBJECT_20 = r'avro.cdm20.Subject":\{"uuid":"(.*?)"(.*?)"cmdLine":\{"string":"(.*?)"\}(.*?)"path":"(.*?)"'
FILE_20 = r'avro.cdm20.FileObject":\{"uuid":"(.*?)",(.*?)"filename":"(.*?)"'


def nodes_v20(raw: DataFrame) -> DataFrame:
    """The same for version 20, by pattern; records that lack a field go."""
    part = lambda pattern, k: F.regexp_extract("value", pattern, k)
    flows = _nodes(raw.filter(F.col("value").contains("NetFlowObject")), "netflow", uuid=part(FLOW_20, 1), src_addr=part(FLOW_20, 3), src_port=part(FLOW_20, 4), dst_addr=part(FLOW_20, 5), dst_port=part(FLOW_20, 6))
    subjects = _nodes(raw.filter(F.col("value").contains("cdm20.Subject")), "subject", uuid=part(SUBJECT_20, 1), cmd=part(SUBJECT_20, 3), path=part(SUBJECT_20, 5))
    files = _nodes(raw.filter(F.col("value").contains("cdm20.FileObject")), "file", uuid=part(FILE_20, 1), path=part(FILE_20, 3))
    return flows.unionByName(subjects).unionByName(files)


def with_ids(nodes: DataFrame, kinds: tuple[str, ...] = ("netflow", "subject", "file")) -> DataFrame:
    """One row a (kind, uuid), with hash_id and a dense index_id in order of kind and first place.

    Ids come from ranks within kind and slice of uuid hash plus the counts of
    the slices before, so no task numbers all nodes.
    """
    attributes = F.struct(*[c for c in NODE if c not in ("kind", "uuid", "place")])
    one = nodes.groupBy("kind", "uuid").agg(F.max_by(attributes, "place").alias("a"), F.min("place").alias("first")).select("kind", "uuid", "a.*", "first")
    order = F.array_position(F.array(*map(F.lit, kinds)), F.col("kind"))
    one = one.withColumn("_k", order).withColumn("_file", F.col("first.file")).withColumn("_slice", F.floor(F.col("first.line") / 1_000_000))
    sizes = one.groupBy("_k", "_file", "_slice").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_start", F.coalesce(F.sum("_n").over(W.orderBy("_k", "_file", "_slice").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    local = F.row_number().over(W.partitionBy("_k", "_file", "_slice").orderBy("first"))
    placed = one.withColumn("_r", local).join(before, ["_k", "_file", "_slice"])
    return placed.withColumn("index_id", F.col("_start") + F.col("_r") - 1).withColumn("hash_id", F.sha2("uuid", 256)).drop("_k", "_file", "_slice", "_r", "_start", "first")


def events(raw: DataFrame, nodes: DataFrame, version: int) -> DataFrame:
    """(event_uuid, t, op, src, dst): events whose subject is a subject and whose object is known.

    An object's uuid is looked up as file, then netflow, then subject. Ends are
    in the direction of information flow.
    """
    v = f"com.bbn.tc.schema.avro.cdm{version}"
    part = lambda pattern: F.regexp_extract("value", pattern, 1)
    rows = raw.filter(F.col("value").contains(f'{{"datum":{{"{v}.Event"')).select(
        part(rf'"{v}.Event":\{{"uuid":"(.*?)",').alias("event_uuid"),
        part(r'"type":"(.*?)"').alias("op"),
        part(rf'"subject":\{{"{v}.UUID":"(.*?)"').alias("subject"),
        part(rf'"predicateObject":\{{"{v}.UUID":"(.*?)"').alias("object"),
        part(r'"timestampNanos":(\d+)').cast("long").alias("t"),
    ).filter(~F.col("op").isin(*EXCLUDED_OPS) & (F.col("subject") != "") & (F.col("object") != ""))
    subjects = nodes.filter("kind = 'subject'").select(F.col("uuid").alias("subject"), F.col("index_id").alias("s"))
    rank = F.when(F.col("kind") == "file", 0).when(F.col("kind") == "netflow", 1).otherwise(2)
    objects = nodes.groupBy(F.col("uuid").alias("object")).agg(F.min_by("index_id", rank).alias("o"))
    both = rows.join(subjects, "subject").join(objects, "object").withColumn("d", oriented(F.col("s"), F.col("o"), F.col("op")))
    return both.select("event_uuid", "t", "op", "d.src", "d.dst")


HOST_SCHEMA = "hostname string, action string, object string, actorID string, objectID string, id string, timestamp string, properties map<string,string>"


def host_records(spark: SparkSession, path: str, host: str | None = None) -> DataFrame:
    """Host-agent records with a known object, of one host by its short name."""
    rows = spark.read.schema(HOST_SCHEMA).json(path).withColumn("place", F.struct(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("line")))
    rows = rows.filter(F.col("object").isin("FILE", "FLOW", "PROCESS"))
    return rows if host is None else rows.filter(F.split_part("hostname", F.lit("."), F.lit(1)) == host)


def host_nodes(rows: DataFrame, actions: tuple[str, ...]) -> DataFrame:
    """Actors as subjects, targets by object type."""
    p = lambda k: F.replace(F.element_at("properties", k), F.lit("\\\\"), F.lit("/"))
    kept = rows.filter(F.col("action").isin(*actions))
    actors = _nodes(kept, "subject", uuid=F.col("actorID"), path=F.when(F.col("object") == "PROCESS", p("parent_image_path")).otherwise(p("image_path")))
    made = _nodes(kept.filter("object = 'PROCESS'"), "subject", uuid=F.col("objectID"), path=p("image_path"), cmd=p("command_line"))
    files = _nodes(kept.filter("object = 'FILE'"), "file", uuid=F.col("objectID"), path=p("file_path"))
    flows = _nodes(kept.filter("object = 'FLOW'"), "netflow", uuid=F.col("objectID"), src_addr=p("src_ip"), src_port=p("src_port"), dst_addr=p("dest_ip"), dst_port=p("dest_port"))
    return actors.unionByName(made).unionByName(files).unionByName(flows)


def host_events(rows: DataFrame, nodes: DataFrame, actions: tuple[str, ...]) -> DataFrame:
    """(event_uuid, t, op, src, dst); READ and inbound flows run from object to actor."""
    ids = nodes.groupBy("uuid").agg(F.min("index_id").alias("id"))
    kept = rows.filter(F.col("action").isin(*actions))
    both = kept.withColumnRenamed("id", "event_uuid").join(ids.select(F.col("uuid").alias("actorID"), F.col("id").alias("s")), "actorID").join(ids.select(F.col("uuid").alias("objectID"), F.col("id").alias("o")), "objectID")
    back = (F.col("action") == "READ") | ((F.col("object") == "FLOW") & (F.coalesce(F.element_at("properties", "direction"), F.lit("")) == "inbound"))
    t = F.unix_millis(F.to_timestamp("timestamp")) * F.lit(1_000_000)
    return both.select("event_uuid", t.alias("t"), F.col("action").alias("op"), F.when(back, F.col("o")).otherwise(F.col("s")).alias("src"), F.when(back, F.col("s")).otherwise(F.col("o")).alias("dst"))


def node_map(nodes: DataFrame) -> DataFrame:
    """(index_id, node_type, label): paths of files, path and command of subjects, addresses of flows."""
    none = lambda c: F.coalesce(c, F.lit("None"))
    label = F.when(F.col("kind") == "file", none(F.col("path"))).when(F.col("kind") == "subject", F.concat_ws(" ", none(F.col("path")), none(F.col("cmd")))).otherwise(F.concat(none(F.col("src_addr")), F.lit(":"), none(F.col("src_port")), F.lit("->"), none(F.col("dst_addr")), F.lit(":"), none(F.col("dst_port"))))
    return nodes.select("index_id", F.col("kind").alias("node_type"), label.alias("label"))


def ids_by_uuid(nodes: DataFrame) -> DataFrame:
    """(uuid, index_id)."""
    return nodes.select("uuid", "index_id")


def uuids_by_id(nodes: DataFrame) -> DataFrame:
    """(index_id, uuid, node_type)."""
    return nodes.select("index_id", "uuid", F.col("kind").alias("node_type"))


def events_between(events: DataFrame, start: int, end: int, nodes: DataFrame | None = None) -> DataFrame:
    """Events in a closed range of time, with both ends among nodes(index_id) if given."""
    inside = events.filter(F.col("t").between(start, end))
    if nodes is None:
        return inside
    n = nodes.select("index_id").distinct()
    return inside.join(n.withColumnRenamed("index_id", "src"), "src", "left_semi").join(n.withColumnRenamed("index_id", "dst"), "dst", "left_semi").select(*events.columns)
