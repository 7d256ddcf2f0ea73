"""Entries of JSON objects of any size, whole ones and broken ones apart.

A file holds one object of very many entries (``{"q1": {...}, "q2": ...}``),
or many objects, one after the other. Either is read by as many tasks as it has
splits: Spark's text source cuts at every ``}`` and so deals a file out by
byte ranges, each task finds the entries of its range, and an entry that lies
across ranges is put together in the end.

Whether a range begins inside a string, and how deep, only shows in all that
precedes it. So there are two passes. The first scans each range twice, as if
it began outside and inside a string, and leaves two lines on it: whether it
ends inside one, and by how much the depth changed. The driver goes through
these (one record a split, as many as the tasks it schedules) and so knows
every range's beginning. The second pass cuts the ranges at the commas and
braces of the outer ``depth`` levels; the pieces at a range's edges, at most
two a range, meet in a group.

A record that is broken does not spoil the others. A string ends at the end of
its line, and a ``{`` at the beginning of a line begins a new record unless a
value is due there: what was open then is one broken record, with the file and
the byte at which it begins.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridwork.session import cut_lineage, ship_package

#: What the scan stops at outside strings: whole strings (skipped), an opening quote alone, and the marks of structure.
_TOKEN = re.compile(rb'"[^"\\\n]*+(?:\\[^\n][^"\\\n]*+)*+"|["{}\[\],:]|[^\s"{}\[\],:]+')
#: The rest of a string that was open where a piece began, with what ends it.
_IN_STRING = re.compile(rb'[^"\\\n]*+(?:\\[^\n][^"\\\n]*+)*+("|\\?\n|\\?\Z)')
#: Arrays count as so many levels, so that nothing in them is one of the outer levels.
_ARRAY = 1_000_000
#: Where a value may begin on a line of its own.
_BEFORE_VALUE = {b":", b",", b"["}

SEGMENTS = ("file string, portion bigint, seq bigint, place string, kind string, level int, start bigint, "
            "text string, outer_text string")


@dataclass
class _State:
    """Where a scan stands: inside a string, how deep, and the last token outside strings."""
    in_string: bool
    depth: int
    before: bytes
    restarted: bool = False


def _tokens(piece: bytes, state: _State) -> Iterator[tuple[int, bytes]]:
    """The marks of structure outside strings, with their places; ``state`` knows whether a string is open."""
    at = 0
    while True:
        if state.in_string:  # it ends with its quote or its line, or goes on in the next piece
            end = _IN_STRING.match(piece, at)
            if end[1][-1:] not in (b'"', b"\n"):
                return
            state.in_string, state.before, at = False, b'"', end.end() - (end[1] != b'"')
        token = _TOKEN.search(piece, at)
        if not token:
            return
        mark, at = token[0], token.end()
        if mark == b'"':
            state.in_string = True
        elif len(mark) == 1 and mark in b"{}[],:":
            yield token.start(), mark
            state.before = mark
        else:
            state.before = b"x"


def _restarts(state: _State, piece: bytes, at: int, first: bool) -> bool:
    """Whether a ``{`` here begins a new record: at the beginning of a line, where no value is due."""
    line = piece[at - 1:at] == b"\n" if at else first
    return line and state.before not in _BEFORE_VALUE


def _move(state: _State, mark: bytes) -> None:
    if mark == b"{":
        state.depth += 1
    elif mark == b"}":
        state.depth -= 1
    elif mark == b"[":
        state.depth += _ARRAY
    elif mark == b"]":
        state.depth -= _ARRAY


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """First pass: of each range, what it does to a scan that begins outside and inside a string."""
    found: dict[tuple[str, int], list] = {}
    for batch in batches:
        for file, start, size, value in zip(*[batch.column(c) for c in ("file", "start", "size", "value")], strict=True):
            key = file.as_py(), start.as_py()
            own = found.setdefault(key, [0, 0, size.as_py(), _State(False, 0, b"}"), _State(True, 0, b"}")])
            piece = value.as_py()
            fresh = own[1] == 0 and own[0] == 0
            own[0] += len(piece) + 1
            own[1] += 1
            for state in own[3:]:
                for at, mark in _tokens(piece + b"}", state):
                    if mark == b"{" and _restarts(state, piece, at, fresh and key[1] == 0):
                        state.depth, state.restarted = 0, True
                    _move(state, mark)
    rows = [(f, s, b, size, *(x for st in states for x in (st.in_string, st.depth, st.restarted)))
            for (f, s), (b, _, size, *states) in found.items()]
    names = ["file", "start", "bytes", "size", "in0", "depth0", "re0", "in1", "depth1", "re1"]
    types = [pa.string(), pa.int64(), pa.int64(), pa.int64()] + [pa.bool_(), pa.int64(), pa.bool_()] * 2
    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)


@dataclass
class _Portion:
    """What precedes a range: its number in the stream, its first byte, and the state of the scan."""
    number: int
    offset: int
    in_string: bool
    depth: int
    unended: bool  # its last piece ends with the file, not with a brace


def _folded(rows: list, together: bool) -> dict[tuple[str, int], _Portion]:
    """The beginnings of all ranges, in the order of the files' names and places."""
    found, files = {}, {}
    for r in rows:
        files.setdefault(r["file"], []).append(r)
    in_string, depth, number = False, 0, 0
    for file in sorted(files):
        if not together:
            in_string, depth, number = False, 0, 0
        offset, own = 0, sorted(files[file], key=lambda r: r["start"])
        # a mark of order at the beginning of a file takes three bytes and is not read
        missing = own[0]["size"] - sum(r["bytes"] for r in own)
        for r in own:
            last = r is own[-1]
            found[file, r["start"]] = _Portion(number, offset + (3 if missing in (2, 3) else 0), in_string, depth, last and missing in (-1, 2))
            side = "1" if in_string else "0"
            depth = (0 if r["re" + side] else depth) + r["depth" + side]
            depth += 1 if last and missing in (-1, 2) and not r["in" + side] else 0  # the brace that wasn't there
            in_string, offset, number = r["in" + side], offset + r["bytes"], number + 1
    return found


class _Cutter:
    """Second pass over one range: cuts at the commas and braces of the outer levels."""

    def __init__(self, file: str, portion: _Portion, depth: int):
        self.file, self.portion, self.levels = file, portion, depth
        self.state = _State(portion.in_string, portion.depth, b"}")
        self.text: list[bytes] = []
        self.start = self.offset = portion.offset
        self.seq, self.place, self.outer = 0, "head", None
        self.rows: list[tuple] = []
        self.fresh = portion.offset <= 3

    def cut(self, kind: str, level: int, piece: bytes, begin: int, end: int) -> None:
        """What was gathered up to piece[:end] is a segment; the next begins after the mark there."""
        text = b"".join(self.text) + piece[begin:end]
        if text.strip() or self.place == "head" or kind == "open":
            self.rows.append((self.file, self.portion.number, self.seq, self.place, kind, level, self.start,
                              text.decode("utf-8", "replace"), self.outer))
        if kind == "open":
            # the head of a range is a part of its text
            self.outer = text.decode("utf-8", "replace") if level > 1 and self.place != "head" else None
        self.text, self.place, self.seq = [], "whole", self.seq + 1
        self.start = self.offset + end + 1

    def feed(self, value: bytes, last: bool) -> None:
        piece = value if last and self.portion.unended else value + b"}"
        state, begin = self.state, 0
        for at, mark in _tokens(piece, state):
            if mark == b"{" and _restarts(state, piece, at, self.fresh):
                if state.depth > 0:
                    self.cut("broken", state.depth, piece, begin, at)
                    begin, self.start = at, self.offset + at
                state.depth, state.restarted = 0, True
            level = state.depth
            _move(state, mark)
            if mark == b"{" and level < self.levels:
                self.cut("open", level + 1, piece, begin, at)
            elif mark in b"},]" and level <= 0:
                self.cut("broken" if mark != b"," else "entry", 0, piece, begin, at)
                state.depth = 0
            elif mark in b",}" and level <= self.levels:
                self.cut("entry", level, piece, begin, at)
            else:
                continue
            begin = at + 1
        self.fresh = False
        self.text.append(piece[begin:])
        self.offset += len(piece)

    def finish(self) -> list[tuple]:
        text = b"".join(self.text).decode("utf-8", "replace")
        place = "through" if self.place == "head" else "tail"
        return [*self.rows, (self.file, self.portion.number, self.seq, place, "rest", self.state.depth, self.start, text, self.outer)]


def _cut(portions: dict[tuple[str, int], _Portion], depth: int):
    """Second pass, over the ranges as the first one saw them."""
    columns = [c.split()[0] for c in SEGMENTS.split(", ")]
    types = [{"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}[c.split()[1]] for c in SEGMENTS.split(", ")]

    def rows_of(own: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in own], t) for i, t in enumerate(types)], columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, cutter, waiting = None, None, None
        for batch in batches:
            for file, start, value in zip(*[batch.column(c) for c in ("file", "start", "value")], strict=True):
                now = file.as_py(), start.as_py()
                if now != key:
                    if cutter:
                        cutter.feed(waiting, True)
                        yield rows_of(cutter.finish())
                    if now not in portions:
                        raise LookupError("the splits changed")
                    key, cutter = now, _Cutter(now[0], portions[now], depth)
                else:
                    cutter.feed(waiting, False)
                waiting = value.as_py()
            if cutter and cutter.rows:
                yield rows_of(cutter.rows)
                cutter.rows = []
        if cutter:
            cutter.feed(waiting, True)
            yield rows_of(cutter.finish())
    return run


def _segments(spark: SparkSession, path: str, depth: int, together: bool) -> DataFrame:
    """The segments of all ranges, as a stored table."""
    ship_package(spark)
    for _ in range(4):
        raw = spark.read.option("lineSep", "}").text(path).select(
            F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
            F.col("_metadata.file_size").alias("size"), F.col("value").cast("binary").alias("value"))
        summaries = raw.mapInArrow(_summaries, "file string, start bigint, bytes bigint, size bigint, in0 boolean, depth0 bigint, "
                                               "re0 boolean, in1 boolean, depth1 bigint, re1 boolean")
        portions = spark.sparkContext.broadcast(_folded(summaries.collect(), together))
        cut = raw.select("file", "start", "value").mapInArrow(lambda b: _cut(portions.value, depth)(b), SEGMENTS)
        try:
            return cut_lineage(cut)
        except Exception as e:  # the cluster grew or shrank between the passes, and Spark split the files anew
            if "the splits changed" not in str(e):
                raise
    raise RuntimeError("the files' splits keep changing")


def json_entries(spark: SparkSession, path: str, depth: int = 1, together: bool = False) -> tuple[DataFrame, DataFrame]:
    """``(entries, broken)`` of the JSON objects of files.

    ``entries``: ``file, start, outer_text, text`` of every entry ``"key":
    value`` at ``depth`` (1: of the objects; 2: of the objects that are their
    entries; ``outer_text`` is then what stands before the brace, ``"key":``).
    ``broken``: ``file, start, text`` of what is no such entry. ``start`` is the
    byte in the file. With ``together`` the files, in the order of their names,
    are parts of one text (see :func:`gridwork.sources.io.write_one_object`).
    """
    if depth not in (1, 2):
        raise ValueError("entries of depth 1 or 2")
    stored = _segments(spark, path, depth, together)
    stream = F.lit("") if together else F.col("file")
    segments = stored.withColumn("stream", stream)
    order = Window.partitionBy("stream").orderBy("portion")
    before = order.rowsBetween(Window.unboundedPreceding, -1)

    # the pieces at the edges of ranges: from the range where a segment begins to the one where it ends
    ranges = segments.groupBy("stream", "portion").agg(F.bool_or(F.col("place") != "through").alias("cut"))
    begun = ranges.withColumn("run", F.coalesce(F.max(F.when(F.col("cut"), F.col("portion"))).over(before), F.lit(-1))).select(
        "stream", "portion", "run")
    edges = segments.filter("place <> 'whole'").join(begun, ["stream", "portion"])
    edges = edges.withColumn("run", F.when(F.col("place") == "tail", F.col("portion")).otherwise(F.col("run")))
    joined = edges.groupBy("stream", "run").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("portion", "text"))), lambda x: x["text"]), "").alias("text"),
        F.min_by("file", "portion").alias("file"), F.min_by("start", "portion").alias("start"),
        F.max(F.when(F.col("place") == "head", F.col("portion"))).alias("portion"),
        F.coalesce(F.max(F.when(F.col("place") == "head", F.col("kind"))), F.lit("rest")).alias("kind"),
        F.max(F.when(F.col("place") == "head", F.col("level"))).alias("level"),
        F.max_by("level", "portion").alias("rest_level"))
    joined = cut_lineage(joined)
    whole = segments.filter("place = 'whole'")

    # the key of the object around: the last one opened before, in the range or before it
    opened = whole.filter("kind = 'open' and level = 2").groupBy("stream", "portion").agg(F.max_by("text", "seq").alias("last"))
    heads = joined.filter("kind = 'open' and level = 2").select("stream", "portion", F.col("text").alias("head"))
    keys = (ranges.select("stream", "portion").join(opened, ["stream", "portion"], "left").join(heads, ["stream", "portion"], "left")
            .withColumn("upto", F.last(F.coalesce("last", "head"), ignorenulls=True).over(before))
            .select("stream", "portion", "upto", F.coalesce("head", "upto").alias("after")))
    columns = ["file", "start", "kind", "level", "outer_text", "text"]
    known = F.col("outer_text").isNotNull() if depth == 2 else F.lit(True)
    inside = whole.filter(known).select(*columns).unionByName(
        whole.filter(~known).join(keys, ["stream", "portion"]).withColumn("outer_text", F.col("after")).select(*columns))
    across = (joined.join(keys, ["stream", "portion"], "left").withColumn("outer_text", F.col("upto"))
              .withColumn("level", F.coalesce("level", "rest_level")).select(*columns))
    every = inside.unionByName(across).filter(F.trim(F.translate("text", "\r\n\t", "   ")) != "")
    fit = (F.col("kind") == "entry") & (F.col("level") == depth)
    entries = every.filter(fit).select("file", "start", F.when(F.lit(depth == 2), F.col("outer_text")).alias("outer_text"), "text")
    broken = every.filter(~fit & ~((F.col("kind") == "open") & ((F.col("level") == 2) | F.col("text").rlike(r"^\s*,?\s*$"))))
    return entries, broken.select("file", "start", "text")
