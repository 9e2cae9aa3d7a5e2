"""Delimited text files of any layout, good ones and bad ones together.

A read gives two relations: files (source_id, delimiter, columns, error), one row per file, and rows (source_id, values),
the records of the files without an error, the values being the fields in file order. Files of all delimiters and widths
are read by one plan; what is known of a file comes to its lines by a join, so no file name passes through the driver.

A quote opens a field only at its beginning and is written twice inside. A line that leaves a field open goes on in the
next one. Files are read in splits all the same: the first scan tells, for each split and each delimiter, in which state
it ends if it begins inside a field or outside one, and from that follows where each split's first record begins. Records
cut by the end of a split are put together from their pieces.
"""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from schemalign.operators.conform import BROADCAST_LAYOUTS
from schemalign.operators.settle import settle
from schemalign.operators.skew import salted_lookup

DELIMITERS = ("\t", "|", ",")

LINE_END = "\n"

# A record that is open for so many characters is taken for a quote that is never closed.
LONGEST_RECORD = 100_000_000

_CLOSING = re.compile(r'[^"]*(?:""[^"]*)*"(?!")')
_QUOTED = {d: re.compile(rf'(?:(?<={re.escape(d)})|^)"[^"]*(?:""[^"]*)*"(?!")') for d in DELIMITERS}
_OPENING = {d: re.compile(rf'(?:^|{re.escape(d)})"') for d in DELIMITERS}


def delimiter_of(first_line: Column) -> Column:
    """Tab if the line has one, else pipe if it has one, else comma."""
    return (
        F.when(first_line.contains("\t"), "\t").when(first_line.contains("|"), "|").otherwise(",")
    )


def _delimiter(first_line: str) -> str:
    return next((d for d in DELIMITERS if d in first_line), ",")


def distinct_headers(names: Sequence[str]) -> list[str]:
    """Headers made distinct: the first of equal names keeps it, later ones get the next of .1, .2 ... that no header
    has; empty ones are named by their position first."""
    given = [name if name else f"Unnamed: {at}" for at, name in enumerate(names)]
    taken, result = set(given), []
    used: dict[str, int] = {}
    for name in given:
        if name not in used:
            used[name] = 0
            result.append(name)
            continue
        while f"{name}.{used[name] + 1}" in taken:
            used[name] += 1
        used[name] += 1
        result.append(f"{name}.{used[name]}")
        taken.add(result[-1])
    return result


def _unquoted(line: str, delimiter: str, inside: bool) -> str | None:
    """The line with its complete quoted fields left out; None if it begins inside a field and does not close it."""
    if inside:
        closed = _CLOSING.match(line)
        if not closed:
            return None
        line = "x" + line[closed.end() :]
    return _QUOTED[delimiter].sub("x", line) if '"' in line else line


def ends_open(line: str, delimiter: str, inside: bool) -> bool:
    """Whether a quoted field is open behind a line that begins inside one or not."""
    rest = _unquoted(line, delimiter, inside)
    return rest is None or ('"' in rest and bool(_OPENING[delimiter].search(rest)))


def _parsed(record: str, delimiter: str) -> list[str]:
    """The fields of one record. A carriage return that ends no line and stands in no quotes is left out."""
    csv.field_size_limit(LONGEST_RECORD)
    try:
        return next(csv.reader(io.StringIO(record, newline=""), delimiter=delimiter), [])
    except csv.Error:
        return next(csv.reader(io.StringIO(record.replace("\r", ""), newline=""), delimiter=delimiter), [])


def _texts(raw: bytes) -> list[str]:
    """The lines in what stands between two line feeds: old files end theirs by carriage returns only."""
    text = raw.decode("utf-8")
    return text.removesuffix("\r").split("\r") if "\r" in text and '"' not in text else [text]


def placed_lines(lines: DataFrame) -> DataFrame:
    """(source_id, start, line) of lines read as text: start is that of their split."""
    return lines.select(
        F.col("_metadata.file_path").alias("source_id"),
        F.col("_metadata.file_block_start").alias("start"),
        F.col("value").cast("binary").alias("line"),
    )


def lines_of(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    listed = [paths] if isinstance(paths, str) else list(paths)
    return placed_lines(spark.read.option("lineSep", LINE_END).text(listed))


class _Split:
    """What the first scan notes of a split: for each delimiter and state at its beginning how it ends."""

    def __init__(self, start: int):
        self.start, self.known, self.valid, self.delimiter = start, start > 0, True, None
        self.head: str | None = None
        self.head_open = False
        self.state = {(d, s): s for d in DELIMITERS for s in (False, True)}
        self.opened = dict.fromkeys(self.state, False)
        self.widest = dict.fromkeys(DELIMITERS, 0)

    def read(self, raw: bytes) -> None:
        try:
            texts = _texts(raw)
        except UnicodeDecodeError:
            self.valid = False
            return
        for line in texts:
            self._read_line(line)

    def _read_line(self, line: str) -> None:
        if self.delimiter is None and not self.start:
            line = line.removeprefix("﻿")
            self.delimiter = _delimiter(line)
        if not self.known:
            if self.head_open or line.strip("\r"):
                self.head = line if self.head is None else f"{self.head}\n{line}"
                self.head_open = ends_open(line, self.delimiter, self.head_open) and len(self.head) <= LONGEST_RECORD
                self.known = not self.head_open
            return
        if '"' not in line:
            for d in DELIMITERS:
                fields = line.count(d) + 1
                if fields > self.widest[d]:
                    self.widest[d] = fields
            return
        for (d, s), inside in self.state.items():
            rest = _unquoted(line, d, inside)
            self.state[d, s] = open_ = rest is None or ('"' in rest and bool(_OPENING[d].search(rest)))
            self.opened[d, s] |= open_
            if not s and rest is not None:
                self.widest[d] = max(self.widest[d], rest.count(d) + 1)

    def row(self, source_id: str) -> tuple:
        ends, opened = ([held[d, s] for d in DELIMITERS for s in (False, True)] for held in (self.state, self.opened))
        head = None if self.head is None else self.head.removesuffix("\r")
        columns = None if head is None else distinct_headers(_parsed(head, self.delimiter))
        return (source_id, self.start, self.valid, self.delimiter, columns, self.head_open, ends, opened, [self.widest[d] for d in DELIMITERS])


_SPLITS = (
    "source_id string, start bigint, valid boolean, delimiter string, columns array<string>, head_open boolean, "
    "ends array<boolean>, opened array<boolean>, widest array<int>"
)


def _note(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each split."""
    names = [field.split(" ")[0] for field in _SPLITS.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.bool_(), pa.string(), pa.list_(pa.string()), pa.bool_(), pa.list_(pa.bool_()), pa.list_(pa.bool_()), pa.list_(pa.int32())]
    source, split, done = None, None, []
    for batch in batches:
        for file, start, line in zip(*[batch.column(c).to_pylist() for c in ("source_id", "start", "line")], strict=True):
            if split is None or (file, start) != (source, split.start):
                if split is not None:
                    done.append(split.row(source))
                source, split = file, _Split(start)
            split.read(line)
    if split is not None:
        done.append(split.row(source))
    columns = list(zip(*done, strict=True)) or [()] * len(names)
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def list_files(lines: DataFrame) -> DataFrame:
    """(source_id, delimiter, columns, error, starts) per file, settled.

    The delimiter is that of the first line, the columns are those of the first line that is not blank. error says why a
    file cannot be read: it is not UTF-8, it has no header, a quote is not closed, a row has more fields than the header.
    starts tells for each split where it begins and whether inside a field; it is NULL where no field runs over a line end.
    Files without a single byte are not listed: Spark's sources leave them out.
    """
    notes = settle(lines.select("source_id", "start", "line").mapInArrow(_note, _SPLITS))
    heads = notes.filter("start = 0").select("source_id", "delimiter", "columns", "head_open")
    own = F.array_position(F.array(*map(F.lit, DELIMITERS)), F.col("delimiter")).cast("int") - 1

    def held(name: str, inside: int) -> Column:
        return F.get(name, own * 2 + inside)

    # The splits of a file are few, one for each 128 MB or so.
    split = F.struct(
        "start", held("ends", 0).alias("shut"), held("ends", 1).alias("open"), held("opened", 0).alias("opened"),
        F.get("widest", own).alias("widest"), "valid",
    )
    files = (
        notes.drop("delimiter", "columns", "head_open")
        .join(heads, "source_id")
        .groupBy("source_id")
        .agg(
            F.sort_array(F.collect_list(split)).alias("splits"), F.first("delimiter").alias("delimiter"),
            F.first("columns").alias("columns"), F.first("head_open").alias("head_open"),
        )
    )
    ended = "concat(states, array(if(element_at(states, -1), s.open, s.shut)))"
    files = files.withColumn("states", F.expr(f"aggregate(splits, array(false), (states, s) -> {ended})"))
    spans = F.exists("splits", lambda s: s["opened"]) | F.exists("states", lambda s: s) | F.exists("columns", lambda c: c.contains("\n"))
    width, widest = F.size("columns"), F.array_max(F.transform("splits", lambda s: s["widest"]))
    error = (
        F.when(~F.forall("splits", lambda s: s["valid"]), F.lit("not UTF-8"))
        .when(F.col("columns").isNull(), F.lit("no header"))
        .when(F.col("head_open") | F.element_at("states", -1), F.lit("a quote is not closed"))
        .when(~spans & (widest > width), F.concat(F.lit("a row has "), widest, F.lit(" fields, the header "), width))
    )
    starts = F.transform("splits", lambda s, i: F.struct(s["start"].alias("start"), F.get("states", i).alias("inside")))
    return settle(files.select("source_id", "delimiter", "columns", error.alias("error"), F.when(spans, starts).alias("starts")))


_RECORDS = "source_id string, values array<string>, fields int, piece bigint, closes boolean, delimiter string, width int, text string"
_KINDS = [pa.string(), pa.list_(pa.string()), pa.int32(), pa.int64(), pa.bool_(), pa.string(), pa.int32(), pa.string()]


def _record(file: str, fields: list[str], width: int) -> tuple:
    values = [v if v else None for v in fields[:width]] + [None] * (width - len(fields))
    return (file, values, len(fields), None, None, None, None, None)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(_KINDS)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _KINDS, strict=True)], [f.split(" ")[0] for f in _RECORDS.split(", ")])


class _Reader:
    """Lines of one split in order -> its records, and pieces of those that its ends cut."""

    def __init__(self, file: str, start: int, delimiter: str, width: int, spans: bool, inside: bool | None, number: int | None):
        self.file, self.delimiter, self.width, self.spans, self.number = file, delimiter, width, spans, number
        self.inside = self.entered = bool(inside)
        self.header, self.held = start == 0, []

    def _piece(self, nth: int, closes: bool, text: str) -> tuple:
        return (self.file, None, None, nth, closes, self.delimiter, self.width, text)

    def read(self, raw: bytes) -> Iterator[tuple]:
        for line in _texts(raw):
            if not self.spans:
                self.held.append(line)
                if len(self.held) >= 1000:
                    yield from self.cut()
                continue
            self.inside = ends_open(line, self.delimiter, self.inside)
            self.held.append(line)
            if self.inside:
                continue
            text, self.held = "\n".join(self.held), []
            if self.entered:
                self.entered = False
                yield self._piece(2 * self.number, True, text)
            elif text.strip("\r\ufeff") or not self.header:
                if not self.header and text != "\r":
                    fields = _parsed(text.removesuffix("\r"), self.delimiter)
                    if fields:
                        yield _record(self.file, fields, self.width)
                self.header = False

    def cut(self) -> Iterator[tuple]:
        """The records among lines held, each a record of its own; blank ones are none, the first other one is the header."""
        lines, self.held = [line.removesuffix("\r") for line in self.held], []
        if self.header:
            at = next((k for k, line in enumerate(lines) if line.strip("\r\ufeff")), len(lines))
            self.header, lines = at == len(lines), lines[at + 1 :]
        try:
            csv.field_size_limit(LONGEST_RECORD)
            found = list(csv.reader(lines, delimiter=self.delimiter))
        except csv.Error:
            found = [_parsed(line, self.delimiter) for line in lines]
        yield from (_record(self.file, fields, self.width) for fields in found if fields)

    def end(self) -> Iterator[tuple]:
        if not self.spans:
            yield from self.cut()
        elif self.held:
            yield self._piece(2 * self.number + 1, False, "\n".join(self.held))


def _read_splits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, reader = None, None
    for batch in batches:
        out: list[tuple] = []
        for file, start, line, *facts in zip(*[column.to_pylist() for column in batch.columns], strict=True):
            if (file, start) != key:
                if reader:
                    out += reader.end()
                key, reader = (file, start), _Reader(file, start, *facts)
            out += reader.read(line)
        yield _batch(out)
    yield _batch(list(reader.end()) if reader else [])


def _put_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of files in order -> records: a record goes on until a piece closes it."""
    key, held = None, []
    for batch in batches:
        out = []
        for piece in batch.to_pylist():
            if piece["source_id"] != key:
                key, held = piece["source_id"], []
            held.append(piece["text"])
            if piece["closes"]:
                out.append(_record(key, _parsed("\n".join(held).removesuffix("\r"), piece["delimiter"]), piece["width"]))
                held = []
        yield _batch(out)


def _records(lines: DataFrame, files: DataFrame) -> DataFrame:
    """(source_id, values, fields) of the files given, in one scan of their lines."""
    facts = files.select("source_id", "delimiter", F.size("columns").alias("width"), "starts")
    lines = lines.withColumn("nth", F.monotonically_increasing_id())
    size = facts.agg(F.coalesce(F.sum(F.octet_length("source_id") + 64 + 16 * F.greatest(F.size("starts"), F.lit(0))), F.lit(0)).alias("bytes")).first()
    few = size["bytes"] <= BROADCAST_LAYOUTS
    known = lines.join(F.broadcast(facts), "source_id") if few else salted_lookup(lines, facts, ["source_id"], "inner")
    at = F.array_position(F.transform("starts", lambda s: s["start"]), F.col("start")).cast("int") - 1
    own = F.when(F.col("starts").isNotNull(), F.get("starts", at))
    laid = known.select(
        "source_id", "start", "nth", "line", "delimiter", "width", F.col("starts").isNotNull().alias("spans"), own["inside"].alias("inside"),
        F.when(F.col("starts").isNotNull(), at).alias("number"),
    )
    if not few:  # a shuffled join leaves no order
        laid = laid.repartition("source_id", "start").sortWithinPartitions("source_id", "start", "nth")
    found = laid.drop("nth").mapInArrow(_read_splits, _RECORDS)
    whole = found.filter("values IS NOT NULL")
    if not files.filter(F.size("starts") > 1).isEmpty():
        pieces = found.filter("values IS NULL").repartition("source_id").sortWithinPartitions("source_id", "piece")
        whole = whole.unionByName(pieces.mapInArrow(_put_together, _RECORDS))
    return whole.select("source_id", "values", "fields")


def read_lines(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """read_delimited of files given by their lines (source_id, start, line), in the order and the splits they are read in."""
    files = list_files(lines)
    good = files.filter("error IS NULL")
    spanning = good.filter("starts IS NOT NULL")
    if not spanning.isEmpty():
        widest = _records(lines, spanning).groupBy("source_id").agg(F.max("fields").alias("widest"))
        files = files.join(widest, "source_id", "left").withColumn("width", F.size("columns"))
        late = F.concat(F.lit("a row has "), "widest", F.lit(" fields, the header "), "width")
        error = F.coalesce("error", F.when(F.col("widest") > F.col("width"), late))
        files = settle(files.select("source_id", "delimiter", "columns", error.alias("error"), "starts"))
        good = files.filter("error IS NULL")
    return files.drop("starts"), _records(lines, good).select("source_id", "values")


def read_delimited(spark: SparkSession, paths: str | Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """files (source_id, delimiter, columns, error) and rows (source_id, values) of all files under the paths.

    Every row has the fields its file's header names, NULL where missing or empty; all values stay text as written. A
    file that cannot be read is told with its error and gives no rows; the others are not touched by it. Blank lines are
    no records. One scan tells what the files are; where fields run over line ends, another counts those files' fields.
    """
    return read_lines(lines_of(spark, paths))


def as_table(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows of one layout as named string columns."""
    return rows.select(*[F.get("values", F.lit(i)).alias(name) for i, name in enumerate(columns)])


def columns_of(files: DataFrame) -> DataFrame:
    """(source_id, position, src_col) of every file that could be read."""
    good = files.filter("error IS NULL") if "error" in files.columns else files
    return good.select("source_id", F.posexplode("columns").alias("position", "src_col"))
