"""Conversations without quotations, in reply order.

Lines that begin with `>` marks are quoted, at the level of their number of
marks; neighbouring quoted lines of one level are a passage. A line right before a
passage introduces it and goes with it if it ends in a colon and says who wrote or when
(a word like `wrote`, an address, a date or time of day, or a name alone); any other line
is the message's own. A message's own text is the rest, and `introductions` keeps what
stood before passages that link, so no text is lost. Passages and own paragraphs are normalised (letters and digits,
lower-case, one blank between words) and hashed as a whole, by paragraph and by
line. A passage joins the message that holds the piece: the first earlier one of
its own conversation, else the first one of any other, whether or not its own holds
the piece later. Pieces of fewer than
LEAST_CHARS characters are no evidence across conversations; parts of a passage
that are so short count in its own only after all else.

A message replies to the message that its outermost linked passage quotes in its
own conversation; without one it stands where its turn puts it. `path` holds the
turns from the message that begins the thread down to the message; conversations
are built by sorting on (conv_id, path, turn), in which replies follow what they
answer. The result stays one row a message: no conversation is gathered in one
task, and the sort is by range. Passages that link nowhere are quotations of nothing
here; `unlinked` keeps each with its place, level, introduction and text.

Null texts count as empty. Equal rows are one message in several rows and equal
turns share their links. Null conv_id or turn: the message stands alone. Columns
other than conv_id, turn, role and text are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .support import extended, slices, stored, texts_of, with_columns

_MARKS = re.compile(r"^[ \t]{0,3}(>(?:[ \t]?>)*)[ \t]?(.*)$", re.S)
#: Evidence that a line before a quotation only introduces it.
_INTRODUCES = re.compile(r"\b(?:wrote|writes|said|says|asked|asks|answered|replied|schrieb|schreibt|sagte|a écrit|écrit|a dit|escribió|escribe|dijo|scrisse|ha scritto)\b|\S@\S|\b\d{1,4}[-/.]\d{1,2}[-/.]\d{1,4}\b|\b\d{1,2}:\d{2}\b", re.I)
_NAME = re.compile(r"\s*(?:@?[^\W\d_][\w.'-]*\s+){0,2}@?[^\W\d_][\w.'-]*\s*:\s*")
_WORD = re.compile(r"[^\W_]+")
_PARAGRAPH = re.compile(r"\n[ \t\r]*\n")
LEAST_CHARS = 5  # of a normalised piece that links to another conversation


def normal(text: str) -> str:
    return " ".join(_WORD.findall(text.lower()))


def hashed(text: str) -> tuple[int, bool] | None:
    """Hash of the normalised text, and whether it is long enough to link to other conversations; None if it is empty."""
    n = normal(text)
    if not n:
        return None
    h = xxhash.xxh3_64_intdigest(n.encode())
    return (h - (1 << 64) if h >> 63 else h), len(n) >= LEAST_CHARS


def introduces(line: str) -> bool:
    """Whether a line before a quotation says whose it is; a name alone has up to three capitalised words."""
    if not line.rstrip().endswith(":"):
        return False
    return bool(_INTRODUCES.search(line)) or (_NAME.fullmatch(line) is not None and all(w.lstrip("@")[:1].isupper() for w in line.rstrip(": \t\r").split()))


def parse(text: str) -> tuple[str, list[tuple[int, str, str]]]:
    """Own text, and (level, introduction, text) of each quoted passage in order."""
    own: list[str] = []
    passages: list[tuple[int, str, list[str]]] = []
    quoted = False
    for line in text.split("\n"):
        m = _MARKS.match(line)
        if m is None:
            own.append(line)
            quoted = False
            continue
        level, lead = m[1].count(">"), ""
        if not quoted:
            while own and not own[-1].strip():
                own.pop()
            if own and introduces(own[-1]):
                lead = own.pop()
        if quoted and passages[-1][0] == level:
            passages[-1][2].append(m[2])
        else:
            passages.append((level, lead, [m[2]]))
        quoted = True
    return ("\n".join(own).strip("\n") if passages else text), [(n, lead, "\n".join(p)) for n, lead, p in passages]


def pieces(text: str) -> list[tuple[int, bool]]:
    """Hashes, as of `hashed`, of the whole text, its paragraphs and its lines."""
    found = [text, *_PARAGRAPH.split(text), *text.split("\n")]
    return list(dict.fromkeys(h for h in map(hashed, found) if h is not None))


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    quote = pa.list_(pa.struct([("place", pa.int32()), ("level", pa.int32()), ("piece", pa.int32()), ("hash", pa.int64()), ("far", pa.bool_())]))
    for b in slices(batches):
        own, held, quotes, passages = [], [], [], []
        for text in texts_of(b):
            rest, found = parse(text)
            own.append(rest), held.append([h for h, _ in pieces(rest)])
            passages.append([{"place": i, "level": level, "lead": lead, "text": p} for i, (level, lead, p) in enumerate(found)])
            quotes.append([{"place": i, "level": level, "piece": j, "hash": h, "far": far} for i, (level, _, p) in enumerate(found) for j, (h, far) in enumerate(pieces(p))])
        whole = pa.list_(pa.struct([("place", pa.int32()), ("level", pa.int32()), ("lead", pa.string()), ("text", pa.string())]))
        yield with_columns(b.select(["conv_id", "turn", "role"]), text=pa.array(own, pa.string()), passages=pa.array(passages, whole), held=pa.array(held, pa.list_(pa.int64())), quotes=pa.array(quotes, quote))


def link_quotes(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(messages parsed, links): links hold conv_id, turn, place, level, to_conv, to_turn, one row a linked passage."""
    rows = messages.select("conv_id", "turn", "role", "text")
    parsed = stored(rows.mapInArrow(_parse, extended(rows.schema.fields[:3], "text string, passages array<struct<place:int,level:int,lead:string,text:string>>, held array<long>, quotes array<struct<place:int,level:int,piece:int,hash:long,far:boolean>>")), "messages")
    quotes = parsed.filter("conv_id is not null and turn is not null").select("conv_id", "turn", F.explode("quotes").alias("q")).select("conv_id", "turn", "q.*").distinct()
    wanted = quotes.select("hash").distinct()
    held = parsed.filter("conv_id is not null and turn is not null").select("conv_id", "turn", F.explode("held").alias("hash")).join(wanted, "hash", "left_semi")
    first = held.groupBy("conv_id", "hash").agg(F.min("turn").alias("to_turn"))
    least = first.groupBy("hash").agg(F.min(F.struct("conv_id", "to_turn")).alias("far"))
    other = first.join(least, "hash").filter(F.col("conv_id") != F.col("far.conv_id")).groupBy("hash").agg(F.min(F.struct("conv_id", "to_turn")).alias("next"))
    anywhere = least.join(other, "hash", "left")
    near = quotes.join(first, ["conv_id", "hash"], "left").withColumn("to_turn", F.when(F.col("to_turn") < F.col("turn"), F.col("to_turn")))
    away = F.when(F.col("far.conv_id") != F.col("conv_id"), F.col("far")).otherwise(F.col("next"))
    both = near.withColumnRenamed("far", "long").join(anywhere, "hash", "left").withColumn("far", F.when(F.col("long"), away))
    both = both.withColumn("to", F.when(F.col("to_turn").isNotNull(), F.struct(F.when(F.col("long") | (F.col("piece") == 0), 0).otherwise(2).alias("o"), "piece", F.col("conv_id").alias("to_conv"), "to_turn")).when(F.col("far").isNotNull(), F.struct(F.lit(1).alias("o"), "piece", F.col("far.conv_id").alias("to_conv"), F.col("far.to_turn").alias("to_turn"))))
    best = both.filter("to is not null").groupBy("conv_id", "turn", "place", "level").agg(F.min("to").alias("to"))
    return parsed, best.select("conv_id", "turn", "place", "level", "to.to_conv", "to.to_turn")


def reply_paths(parents: DataFrame) -> DataFrame:
    """(conv_id, turn, path) from (conv_id, turn, parent), by pointer doubling; a parent's turn is always less."""
    state = stored(parents.select("conv_id", "turn", F.col("parent").alias("top"), F.array("turn").alias("path")), "paths")
    while state.filter("top is not null").head(1):
        up = state.select("conv_id", F.col("turn").alias("top"), F.col("top").alias("next"), F.col("path").alias("above"))
        state = stored(state.join(up, ["conv_id", "top"], "left").select("conv_id", "turn", F.col("next").alias("top"), F.concat(F.coalesce("above", F.when(F.col("top").isNotNull(), F.array("top")).otherwise(F.slice("path", 1, 0))), "path").alias("path")), "paths")
    return state.select("conv_id", "turn", "path")


def chat_format(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, text (own), n_quotes, n_linked, reply_to, path, links array<struct<to_conv,to_turn>>, unlinked array<struct<place,level,lead,text>>, introductions array<struct<place,level,lead>>."""
    parsed, links = link_quotes(messages)
    links = stored(links, "links")
    per = links.groupBy("conv_id", "turn").agg(
        F.count("*").alias("n_linked"),
        F.array_sort(F.collect_set(F.struct("to_conv", "to_turn"))).alias("links"),
        F.collect_set(F.struct("place", "level")).alias("_linked"),
        F.min(F.when(F.col("to_conv") == F.col("conv_id"), F.struct("level", (-F.col("place")).alias("p"), "to_turn")))["to_turn"].alias("reply_to"),
    )
    joined = parsed.drop("held", "quotes").join(per, ["conv_id", "turn"], "left")
    linked_here = lambda x: F.coalesce(F.array_contains("_linked", F.struct(x["place"].alias("place"), x["level"].alias("level"))), F.lit(False))
    rows = joined.withColumn("n_quotes", F.size("passages").cast("long")).withColumn("unlinked", F.filter("passages", lambda x: ~linked_here(x)))
    introduced = F.filter("passages", lambda x: linked_here(x) & (x["lead"] != ""))
    rows = rows.withColumn("introductions", F.transform(introduced, lambda x: F.struct(x["place"].alias("place"), x["level"].alias("level"), x["lead"].alias("lead")))).drop("passages", "_linked")
    out = ["conv_id", "turn", "role", "text", "n_quotes", F.coalesce("n_linked", F.lit(0)).alias("n_linked"), "reply_to"]
    linked = per.filter("reply_to is not null").select("conv_id", "turn", F.col("reply_to").alias("parent"))
    if not linked.head(1):
        return rows.select(*out, F.array("turn").alias("path"), "links", "unlinked", "introductions")
    ends = linked.select("conv_id", F.col("parent").alias("turn")).join(linked.select("conv_id", "turn"), ["conv_id", "turn"], "left_anti").distinct().withColumn("parent", F.lit(None).cast(linked.schema["parent"].dataType))
    paths = reply_paths(linked.unionByName(ends))
    rows = rows.join(paths, ["conv_id", "turn"], "left")
    return rows.select(*out, F.coalesce("path", F.array("turn")).alias("path"), "links", "unlinked", "introductions")


def in_reply_order(formatted: DataFrame) -> DataFrame:
    """The rows of chat_format sorted across all partitions."""
    return formatted.orderBy("conv_id", "path", "turn")
