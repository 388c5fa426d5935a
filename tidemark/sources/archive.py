"""Snapshot archives to long snapshot rows (S-1 .. S-8)."""

from __future__ import annotations

import codecs
import hashlib
import io
import zipfile
from collections.abc import Iterator
from typing import IO

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.config import rules as R
from tidemark.functions import predicates as P
from tidemark.session import broadcast_if_bounded, cut_lineage

MEMBERS = "path string, place int, member string, sha256 string, utf8 boolean"
PIECES = "path string, place int, part int, line long, header binary, content binary"
#: Bytes of a member that one piece holds, about; a longer record is a piece of its own.
PIECE_BYTES = 4 << 20

# --- Fixed values ---------------------------------------------------------------------------
CYCLE_IN_NAME = r"(\d{4}-\d{2}-\d{2})"
CYCLE_SPELLED = r"(\d{2}_[A-Za-z]{3}_\d{4})"
REQUIRED_FILES = ("APT_BASE", "APT_RWY", "APT_RWY_END", "APT_RMK", "FRQ", "NAV_BASE", "ILS_BASE", "ATC_BASE")
# --------------------------------------------------------------------------------------------


def cycle_of(path: Column) -> Column:
    """The cycle date in an archive's name, in either spelling."""
    name = F.element_at(F.split(path, "/"), -1)
    iso = F.try_to_date(F.nullif(F.regexp_extract(name, CYCLE_IN_NAME, 1), F.lit("")), "yyyy-MM-dd")
    spelled = F.try_to_date(F.nullif(F.regexp_extract(name, CYCLE_SPELLED, 1), F.lit("")), "dd_MMM_yyyy")
    return F.coalesce(iso, spelled)


def _csv_members(raw: bytes) -> Iterator[tuple[str, IO[bytes]]]:
    with zipfile.ZipFile(io.BytesIO(raw)) as archive:
        for info in archive.infolist():
            name = info.filename.lower()
            if name.endswith(".csv"):
                with archive.open(info) as member:
                    yield info.filename.rsplit("/", 1)[-1], member
            elif name.endswith(".zip"):
                yield from _csv_members(archive.read(info))


def _archives(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(paths).select("path", "content")


def members(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """S-1: every CSV member of every archive, nested archives included, with its digest and whether it is
    UTF-8; its content is read in blocks and not kept. Archives spread over tasks."""

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                for place, (name, member) in enumerate(_csv_members(content)):
                    digest, decoder, utf8 = hashlib.sha256(), codecs.getincrementaldecoder("utf-8")(), True
                    while block := member.read(PIECE_BYTES):
                        digest.update(block)
                        utf8 = utf8 and _decodes(decoder, block, False)
                    utf8 = utf8 and _decodes(decoder, b"", True)
                    yield pd.DataFrame({"path": [path], "place": [place], "member": [name], "sha256": [digest.hexdigest()], "utf8": [utf8]})

    return _archives(spark, paths).mapInPandas(unpack, MEMBERS).withColumn("cycle", cycle_of(F.col("path")))


def _decodes(decoder: codecs.IncrementalDecoder, block: bytes, final: bool) -> bool:
    try:
        decoder.decode(block, final)
    except UnicodeDecodeError:
        return False
    return True


class _Cutter:
    """Finds record ends in blocks of bytes that come one after another.

    Outside quotes a line's end is a record's end, and quotes are in order where an opening one follows a
    separator or another quote and a closing one precedes one. From the first quote on that is not,
    there are no more cuts: the rest of the member is one piece, and the CSV reader decides.
    """

    def __init__(self):
        self.quotes, self.in_order, self.last = 0, True, b"\n"

    def ends(self, block: bytes, following: bytes) -> np.ndarray:
        """Places just behind the record ends inside ``block``; ``following`` is the byte after it."""
        data = np.frombuffer(block, np.uint8)
        quote = np.flatnonzero(data == 34)
        around = np.frombuffer(self.last[-1:] + block + (following or b"\n"), np.uint8)
        opening = (self.quotes + np.arange(len(quote))) % 2 == 0
        beside = np.where(opening, around[quote], around[quote + 2])
        wrong = quote[~np.isin(beside, (44, 10, 13, 34))]
        line = np.flatnonzero((data == 10) | (data == 13) & (around[2:] != 10))
        outside = (self.quotes + np.searchsorted(quote, line)) % 2 == 0
        ends = line[outside] + 1
        if not self.in_order:
            ends = ends[:0]
        elif len(wrong):
            self.in_order, ends = False, ends[ends <= wrong[0]]
        self.quotes, self.last = self.quotes + len(quote), block
        return ends


def _cut(member: IO[bytes], piece_bytes: int) -> Iterator[tuple[str, bytes]]:
    """A member's bytes in pieces that end where records do: ('header', its first record), then ('rows', ..);
    one ('whole', ..) if no record's end is certain."""
    cutter, held, first = _Cutter(), [], True
    block = member.read(piece_bytes).removeprefix(codecs.BOM_UTF8)
    while block:
        following = member.read(piece_bytes)
        ends = cutter.ends(block, following[:1])
        start = 0
        if first and len(ends):
            yield "header", b"".join([*held, block[: ends[0]]])
            held, start, first = [], int(ends[0]), False
        if not first and len(ends) and ends[-1] > start:
            yield "rows", b"".join([*held, block[start : ends[-1]]])
            held, start = [], int(ends[-1])
        held.append(block[start:])
        block = following
    if any(held):
        yield "whole" if first else "rows", b"".join(held)


def pieces(spark: SparkSession, kept: DataFrame, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """``cycle, file, part, line, header, content`` of the members ``kept`` (cycle, file, path, place): each in pieces
    that end where records do, with the lines before the piece and the member's header.

    Only the members that are kept are unpacked again; the largest value is a piece, not a member.
    """
    paths = [r[0] for r in kept.select("path").distinct().collect()]  # one per archive
    if not paths:
        return spark.createDataFrame([], f"cycle date, file string, utf8 boolean, {PIECES}").drop("path", "place")
    places = kept.groupBy("path").agg(F.collect_set("place").alias("places"))

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content, wanted_places in zip(pdf["path"], pdf["content"], pdf["places"]):
                due = set(wanted_places)
                for place, (_, member) in enumerate(_csv_members(content)):
                    if place not in due:
                        continue
                    line, header = 0, b""
                    for part, (kind, piece) in enumerate(_cut(member, piece_bytes)):
                        if kind == "header":
                            header = piece
                        else:
                            yield pd.DataFrame({"path": [path], "place": [place], "part": [part], "line": [line], "header": [header], "content": [piece]})
                        line += piece.count(b"\n") + piece.count(b"\r") - piece.count(b"\r\n")

    found = _archives(spark, paths).join(broadcast_if_bounded(places), "path").mapInPandas(unpack, PIECES)
    return found.join(broadcast_if_bounded(kept.select("cycle", "file", "path", "place", "utf8")), ["path", "place"]).drop("path", "place")


def wanted(found: DataFrame) -> DataFrame:
    """S-3: without change reports, structure notes and noise tables."""
    file = P.file_base(F.col("member"))
    skip = P.starts_with_any(file, R.HIDDEN_FILES)
    for mark in R.SKIPPED_MEMBERS:
        skip = skip | F.contains(F.upper("member"), F.lit(mark))
    return found.filter(~skip).withColumn("file", file)


def unique_members(found: DataFrame) -> DataFrame:
    """S-4: a member packed twice counts once; two versions of one member fail the run.

    Digests alone are shuffled; of equal members the first by path stays, and contents stay where they are.
    """
    named = cut_lineage(found.select("cycle", "file", "path", "place", "sha256", "utf8"))
    kept = named.groupBy("cycle", "file").agg(
        F.count_distinct("sha256").alias("versions"), F.min(F.struct("path", "place")).alias("first")
    )
    two = F.raise_error(F.concat(F.lit("two versions of "), F.col("file"), F.lit(" in one snapshot")))
    kept = kept.filter(F.when(F.col("versions") > 1, two).otherwise(F.lit(True)))
    kept = kept.select("cycle", "file", "first.path", "first.place")
    return named.join(kept, ["cycle", "file", "path", "place"], "left_semi")


def decoded(content: Column, utf8: Column) -> Column:
    """S-2: UTF-8 (a leading mark dropped) or Latin-1; every line ending becomes a newline."""
    text = F.when(utf8, content.cast("string")).otherwise(F.decode(content, "ISO-8859-1"))
    return F.regexp_replace(F.regexp_replace(text, "^﻿", ""), "\r\n?", "\n")


def parse_rows(found: DataFrame) -> DataFrame:
    """S-1, S-5: ``cycle, file, row`` of every piece (see :func:`pieces`), each read wherever it lands. A member
    that does not parse to its end fails the run: its unread rows would read as removals."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import csv

        for pdf in batches:
            for cycle, file, line, head, text in zip(pdf["cycle"], pdf["file"], pdf["line"], pdf["header"], pdf["text"]):
                rows: list[dict[str, str]] = []
                reader = csv.reader(io.StringIO(text, newline=""), strict=True)
                try:
                    header = next(csv.reader(io.StringIO(head, newline=""), strict=True) if head else reader, [])
                    for values in reader:
                        if values:
                            rows.append({k.strip(): v for k, v in zip(header, values) if k.strip()})
                        if len(rows) == 10_000:
                            yield pd.DataFrame({"cycle": cycle, "file": file, "row": rows})
                            rows = []
                except csv.Error as e:
                    raise ValueError(f"{file} ({cycle}) does not parse after line {line + reader.line_num}: {e}") from e
                if rows:
                    yield pd.DataFrame({"cycle": cycle, "file": file, "row": rows})

    spread_out = found.repartition("cycle", "file", "part")
    text = spread_out.select("cycle", "file", "line", decoded(F.col("header"), F.col("utf8")).alias("header"), decoded(F.col("content"), F.col("utf8")).alias("text"))
    return text.mapInPandas(read, "cycle date, file string, row map<string,string>")


def clean_rows(rows: DataFrame, ignored=R.IGNORED_COLUMNS, padded=R.RUNWAY_ID_COLUMNS) -> DataFrame:
    """S-6: trimmed keys and values, always-changing columns dropped, runway ids padded."""
    kept = F.map_filter("row", lambda k, v: ~k.isin(*ignored))
    trimmed = F.transform_values(kept, lambda k, v: F.trim(F.coalesce(v, F.lit(""))))
    return rows.withColumn("row", F.transform_values(trimmed, lambda k, v: F.when(k.isin(*padded), padded_runway(v)).otherwise(v)))


def padded_runway(value: Column) -> Column:
    """F-3: '9/27' -> '09/27', '9L' -> '09L'."""
    return F.regexp_replace(value, r"(?<![\dA-Z])(\d)(?=[LRCW]?(?:/|$))", "0$1")


def missing_files(found: DataFrame, required=REQUIRED_FILES) -> DataFrame:
    """S-8: required tables a snapshot does not have, as ``cycle, file``."""
    need = F.explode(F.array(*[F.lit(f) for f in required])).alias("file")
    return found.select("cycle").distinct().select("cycle", need).join(found.select("cycle", "file").distinct(), ["cycle", "file"], "left_anti")


def read_snapshots(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """S-1 .. S-6 in one: ``cycle, file, row``, ready for attribution."""
    return clean_rows(parse_rows(pieces(spark, unique_members(wanted(members(spark, paths))))))
