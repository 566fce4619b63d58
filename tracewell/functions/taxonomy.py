"""Operation and node types, and their encodings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Operations whose information flows from object to subject.
REVERSED_OPS = ("EVENT_EXECUTE", "EVENT_LSEEK", "EVENT_MMAP", "EVENT_OPEN", "EVENT_ACCEPT", "EVENT_READ", "EVENT_RECVFROM", "EVENT_RECVMSG", "EVENT_READ_SOCKET_PARAMS", "EVENT_CHECK_FILE_ATTRIBUTES", "READ")

# Operations that ingestion leaves out.
EXCLUDED_OPS = ("EVENT_FCNTL", "EVENT_OTHER", "EVENT_ADD_OBJECT_ATTRIBUTE", "EVENT_FLOWS_TO")

# The ten kept operations of the ten-type family, in id order from 1.
TEN_OPS = ("EVENT_CONNECT", "EVENT_EXECUTE", "EVENT_OPEN", "EVENT_READ", "EVENT_RECVFROM", "EVENT_RECVMSG", "EVENT_SENDMSG", "EVENT_SENDTO", "EVENT_WRITE", "EVENT_CLONE")

# The ten operations of the host-agent family, in id order from 1.
HOST_OPS = ("OPEN", "READ", "CREATE", "MESSAGE", "MODIFY", "START", "RENAME", "DELETE", "TERMINATE", "WRITE")

# The operations of the endpoint-agent family, in id order from 1.
AGENT_OPS = ("FILE_OPENED", "FILE_CLOSED", "FILE_CREATED", "FILE_READ", "FILE_WRITTEN", "FILE_COPIED", "FILE_LINKED", "FILE_RENAMED", "FILE_TRUNCATED", "FILE_DELETED", "FILE_RESTORED", "NETFLOW_CREATED", "NETFLOW_CONNECTED", "NETFLOW_PACKET_RECEIVED", "NETFLOW_PACKET_SENT", "NETFLOW_DISCONNECTED", "PROCESS_EXECUTED", "PROCESS_KILLED", "MODULE_LOADED", "CROSS_PROCESS_INTERACTION", "REGISTRY_KEY_LOADED", "REGISTRY_KEY_UNLOADED", "REGISTRY_KEY_OPENED", "REGISTRY_KEY_CLOSED", "REGISTRY_KEY_CREATED", "REGISTRY_KEY_RENAMED", "REGISTRY_KEY_REPLACED", "REGISTRY_KEY_DELETED", "REGISTRY_KEY_RESTORED", "REGISTRY_VALUE_CREATED", "REGISTRY_VALUE_READ", "REGISTRY_VALUE_WRITTEN", "REGISTRY_VALUE_DELETED")

# Operations possible between node types, ten-type family.
POSSIBLE_EVENTS = {
    ("subject", "subject"): ("EVENT_READ", "EVENT_WRITE", "EVENT_OPEN", "EVENT_CONNECT", "EVENT_RECVFROM", "EVENT_SENDTO", "EVENT_CLONE", "EVENT_SENDMSG", "EVENT_RECVMSG"),
    ("subject", "file"): ("EVENT_WRITE", "EVENT_CONNECT", "EVENT_SENDMSG", "EVENT_SENDTO", "EVENT_CLONE"),
    ("subject", "netflow"): ("EVENT_WRITE", "EVENT_SENDTO", "EVENT_CONNECT", "EVENT_SENDMSG"),
    ("file", "subject"): ("EVENT_READ", "EVENT_OPEN", "EVENT_RECVFROM", "EVENT_EXECUTE", "EVENT_RECVMSG"),
    ("netflow", "subject"): ("EVENT_OPEN", "EVENT_READ", "EVENT_RECVFROM", "EVENT_RECVMSG"),
}

# Operations possible between node types, endpoint-agent family.
AGENT_EVENTS = {
    ("subject", "subject"): ("PROCESS_EXECUTED", "PROCESS_KILLED", "CROSS_PROCESS_INTERACTION"),
    ("subject", "file"): ("FILE_OPENED", "FILE_CLOSED", "FILE_CREATED", "FILE_WRITTEN", "FILE_COPIED", "FILE_LINKED", "FILE_RENAMED", "FILE_TRUNCATED", "FILE_DELETED", "FILE_RESTORED", "REGISTRY_KEY_UNLOADED", "REGISTRY_KEY_OPENED", "REGISTRY_KEY_CLOSED", "REGISTRY_KEY_CREATED", "REGISTRY_KEY_RENAMED", "REGISTRY_KEY_REPLACED", "REGISTRY_KEY_DELETED", "REGISTRY_KEY_RESTORED", "REGISTRY_VALUE_CREATED", "REGISTRY_VALUE_WRITTEN", "REGISTRY_VALUE_DELETED"),
    ("subject", "netflow"): ("NETFLOW_CREATED", "NETFLOW_CONNECTED", "NETFLOW_PACKET_SENT", "NETFLOW_DISCONNECTED"),
    ("file", "subject"): ("FILE_READ", "MODULE_LOADED", "REGISTRY_KEY_LOADED", "REGISTRY_VALUE_READ"),
    ("netflow", "subject"): ("NETFLOW_PACKET_RECEIVED",),
}

# Substrings of labels of common benign nodes, present and earlier list.
KEYWORDS = (":", "/dev/pts", "salt-minion.log", "null", "usr", "proc", "firefox", "tmp", "thunderbird", "bin/", "/data/replay_logdb", "/stat", "/boot", "qt-opensource-linux-x64", "/eraseme", "675")
EARLIER_KEYWORDS = (":", "null", "/dev/pts", "salt-minion.log", "675", "usr", "proc", "/.cache/mozilla/", "tmp", "thunderbird", "/bin/", "/sbin/sysctl", "/data/replay_logdb/", "/home/admin/eraseme", "/stat")

# Node types in id order from 1.
NODE_TYPES = ("subject", "file", "netflow")

# The operations of the driver's event stream, in id order from 1.
STREAM_OPS = ("click", "error", "purchase", "signup", "view")


FAMILIES = {"ten": POSSIBLE_EVENTS, "agent": AGENT_EVENTS}


def triplets(family: str) -> list[tuple[str, str, str]]:
    """(source type, operation, destination type) of a family in order of class."""
    return [(a, op, b) for (a, b), ops in FAMILIES[family].items() for op in ops]


def n_edge_types(family: str, ops: tuple[str, ...], by_triplet: bool) -> int:
    """Number of edge classes: triplets of the family, or operations."""
    return len(triplets(family)) if by_triplet else len(ops)


def ops_by_id(family: str, ops: tuple[str, ...], by_triplet: bool) -> dict[int, str]:
    """Operation of each class id from 1."""
    return dict(enumerate([t[1] for t in triplets(family)] if by_triplet else ops, 1))


def encode(value: Column, names: tuple[str, ...], first: int = 1) -> Column:
    """Id of a name, counted from `first`; null if unknown."""
    found = F.array_position(F.array(*map(F.lit, names)), value)
    return F.when(found > 0, found + (first - 1)).cast("int")


def one_hot(position: Column, size: int) -> Column:
    """Array of size doubles with 1 at the one-based position, all 0 if it is null."""
    return F.transform(F.sequence(F.lit(1), F.lit(size)), lambda i: F.when(i == position, F.lit(1.0)).otherwise(F.lit(0.0)))


def triplet(src_type: Column, op: Column, dst_type: Column, possible: list[tuple[str, str, str]]) -> Column:
    """Class of (source type, operation, destination type); class 0 also for those not listed."""
    key = F.concat_ws("|", src_type, op, dst_type)
    found = F.array_position(F.array(*[F.lit("|".join(p)) for p in possible]), key)
    return F.greatest(found - 1, F.lit(0)).cast("int")


def oriented(src: Column, dst: Column, op: Column) -> Column:
    """struct(src, dst) in the direction of information flow."""
    swap = op.isin(*REVERSED_OPS)
    return F.struct(F.when(swap, dst).otherwise(src).alias("src"), F.when(swap, src).otherwise(dst).alias("dst"))
