"""Records of large delimited and JSON files, cut by many tasks.

A line break inside a quoted field (or a brace inside a string) looks like the
end of a record to a task that starts in the middle of a file. So every input
split is read under both assumptions, outside and inside a quotation: the pair
of end states is the split's transition. Composing the transitions of a file's
splits in order gives each split its true start state, and the second reading
cuts records with it. What a split holds of a record that crosses its border is
a fragment, joined to its record by (file, split where the record starts).

* delimited text: pieces are lines; the state is "inside quotes". A quote opens
  a field only at its start, a doubled quote stays inside, any other quote is a
  plain character.
* a JSON array: pieces end at ``}``, so that an array on one line is split too;
  the state is "inside a string" and the nesting depth, which adds up. A string
  never holds a raw line break: an unclosed one ends there.

A quotation that a file never closes is no record: its lines are rows with an
error, one each. No text passes through the driver; the table of splits (one
small row each) is composed per file and sent to the tasks.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelsift.session import ship_package, stored

MAX_SPLITS = 1_000_000  # rows of the split table that tasks are sent
NEVER = 1 << 40
UNCLOSED = "a quotation is not closed"
STRAY = "no JSON object"

_SUMMARY = ("file string, fid bigint, block bigint, inside0 int, inside1 int, delta0 bigint, delta1 bigint, "
            "low0 bigint, low1 bigint, started0 bigint, started1 bigint")
_STARTS = ("file string, fid bigint, block bigint, inside int, depth bigint, owner bigint, base bigint, "
           "lost_head boolean, lost_tail boolean, started bigint")
_RECORDS = "fid bigint, owner bigint, n bigint, part bigint, raw string, error string"
_RECORDS_ARROW = pa.schema([("fid", pa.int64()), ("owner", pa.int64()), ("n", pa.int64()), ("part", pa.int64()),
                            ("raw", pa.string()), ("error", pa.string())])


class Delimited:
    """Pieces are lines. ``floor`` is the depth at which no record is open."""

    ends, joint, floor = "\n", "\n", 0

    def __init__(self, sep: str = ","):
        self.sep = sep

    def step(self, line: str, inside: int) -> int:
        """Whether the line's end is inside quotes."""
        closed = False
        for i, before in enumerate(line.split('"')[:-1]):
            if inside:
                inside, closed = 0, True
            elif (not before and (closed or not i)) or before.endswith(self.sep):
                inside, closed = 1, False
            else:
                closed = False
        return inside

    def summarise(self, acc: dict, lines: list[str]) -> None:
        for h in (0, 1):
            inside, low, started = acc[f"inside{h}"], acc[f"low{h}"], acc[f"started{h}"]
            for v in lines:
                quoted = '"' in v
                if not inside and (quoted or v.strip()):
                    started += 1
                if quoted:
                    inside = self.step(v, inside)
                if not inside:
                    low = 0
            acc[f"inside{h}"], acc[f"low{h}"], acc[f"started{h}"] = inside, low, started

    def opened(self, state: dict) -> bool:
        return bool(state["inside"])

    def cut(self, state: dict, lines: list[str]):
        """Yields each record that ends here; ``state["held"]`` keeps an open one."""
        for v in lines:
            quoted = '"' in v
            if state["held"] is None:
                if not quoted:
                    if v.strip():
                        yield v.removesuffix("\r"), None
                    continue
                state["held"] = []
            state["held"].append(v)
            if quoted:
                state["inside"] = self.step(v, state["inside"])
            if not state["inside"]:
                held, state["held"] = state["held"], None
                yield "\n".join(held).removesuffix("\r"), None

    def rows(self, held: list[str]) -> list[str]:
        return held


class JsonArray:
    """Pieces end at ``}``; records are the objects of the outer array."""

    ends, joint, floor = "}", "", 1
    _string = re.compile(r'"[^"\\\n]*(?:\\.[^"\\\n]*)*"', re.S)
    _rest = re.compile(r'[^"\\\n]*(?:\\.[^"\\\n]*)*', re.S)

    def masked(self, piece: str, inside: int) -> tuple[str, int]:
        """The piece with strings blanked, and whether its end is inside one."""
        if not inside and '"' not in piece:
            return piece, 0
        head = ""
        if inside:
            at = self._rest.match(piece).end()
            if at >= len(piece) or piece[at] == "\\":
                return " " * len(piece), 1
            head = " " * (at + 1)
            piece = piece[at + 1:]
        text = self._string.sub(lambda m: " " * len(m[0]), piece)
        at = text.find('"')
        while at >= 0:
            end = text.find("\n", at)
            if end < 0:
                return head + text[:at] + " " * (len(text) - at), 1
            rest = piece[end:]
            text = text[:at] + " " * (end - at) + self._string.sub(lambda m: " " * len(m[0]), rest)
            at = text.find('"', end)
        return head + text, 0

    def summarise(self, acc: dict, pieces: list[str]) -> None:
        for h in (0, 1):
            inside, delta, low = acc[f"inside{h}"], acc[f"delta{h}"], acc[f"low{h}"]
            for v in pieces:
                text, inside = self.masked(v, inside)
                delta += text.count("{") + text.count("[") - text.count("]") - text.count("}") - (not inside)
                if not inside:
                    low = min(low, delta)
            acc[f"inside{h}"], acc[f"delta{h}"], acc[f"low{h}"] = inside, delta, low

    def opened(self, state: dict) -> bool:
        return bool(state["inside"]) or state["depth"] > self.floor

    def cut(self, state: dict, pieces: list[str]):
        for v in pieces:
            text, state["inside"] = self.masked(v, state["inside"])
            at = 0
            while state["held"] is None:
                if state["depth"] < 1:
                    at = text.find("[", at)
                    if at < 0:
                        break
                    state["depth"], at = 1, at + 1
                m = re.compile(r"[{\[\]]").search(text, at)
                between = v[at:m.start() if m else len(v)].strip(" \t\r\n,﻿")
                if between:
                    yield between, STRAY
                if not m:
                    break
                if m[0] == "]":
                    state["depth"], at = 0, m.end()
                else:
                    state["held"], at = [], m.start()
            if state["held"] is None:
                continue
            state["held"].append(v[at:] + "}")
            text = text[at:]
            state["depth"] += text.count("{") + text.count("[") - text.count("]") - (not state["inside"])
            if not self.opened(state):
                held, state["held"] = state["held"], None
                yield "".join(held), None

    def rows(self, held: list[str]) -> list[str]:
        return [v for v in "".join(held).split("\n") if v.strip()]


def _runs(batch: pa.RecordBatch):
    """Slices of a batch that lie in one split each."""
    block, fid = batch.column("block").to_numpy(), batch.column("fid").to_numpy()
    if not len(block):
        return
    cuts = np.flatnonzero((block[1:] != block[:-1]) | (fid[1:] != fid[:-1])) + 1
    for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(block)]):
        yield batch.slice(lo, hi - lo)


def _pieces(spark: SparkSession, path, ends: str) -> DataFrame:
    return spark.read.option("lineSep", ends).text(path).select(
        F.make_valid_utf8(F.col("value")).alias("value"), F.col("_metadata.file_path").alias("file"),
        F.xxhash64("_metadata.file_path").alias("fid"), F.col("_metadata.file_block_start").alias("block"))


def _summaries(cutter):
    """One row a split: its transition under either start state."""
    def run(batches):
        acc = None
        names = [c.split(" ")[0] for c in _SUMMARY.split(", ")]

        def row():
            return pa.RecordBatch.from_pylist([{k: acc[k] for k in names}], schema=pa.schema(
                [(k, pa.string() if k == "file" else pa.int32() if k.startswith("inside") else pa.int64()) for k in names]))

        for b in batches:
            for part in _runs(b):
                key = (part.column("fid")[0].as_py(), part.column("block")[0].as_py())
                if acc is None or (acc["fid"], acc["block"]) != key:
                    if acc:
                        yield row()
                    acc = {"file": part.column("file")[0].as_py(), "fid": key[0], "block": key[1], "inside0": 0,
                           "inside1": 1, "delta0": 0, "delta1": 0, "low0": NEVER, "low1": NEVER, "started0": 0,
                           "started1": 0}
                cutter.summarise(acc, part.column("value").to_pylist())
        if acc:
            yield row()
    return run


def _compose(floor: int):
    """The start state of every split of one file, in order."""
    def run(key, splits):
        inside, depth, owner, base, out = 0, 0, None, 0, []
        for s in splits.sort_values("block").to_dict("records"):
            h = inside
            out.append({"file": s["file"], "fid": s["fid"], "block": s["block"], "inside": inside, "depth": depth,
                        "owner": s["block"] if owner is None else owner, "base": base, "lost_head": False,
                        "lost_tail": False, "started": s[f"started{h}"]})
            fresh = owner is None or depth + s[f"low{h}"] <= floor
            inside, depth, base = s[f"inside{h}"], depth + s[f"delta{h}"], base + s[f"started{h}"]
            if not inside and depth <= floor:
                owner = None
            elif fresh:
                owner = s["block"]
        if owner is not None:
            for i, s in enumerate(out):
                s["lost_head"] = s["owner"] == owner and s["block"] != owner
                s["lost_tail"] = s["block"] == owner
        names = [c.split(" ")[0] for c in _STARTS.split(", ")]
        return pd.DataFrame(out, columns=names)
    return run


def _cut(cutter):
    """``_RECORDS`` rows: ``part`` is -1 for a whole record, else the split that
    holds the fragment; ``n`` numbers the records of a file."""
    def run(batches):
        state, out = None, []

        def put(owner, n, part, raw, error):
            out.append((state["fid"], owner, n, part, raw, error))

        def number():
            state["i"] += 1
            return state["base"] + state["i"] - 1

        def end():
            """What is still open at the end of a split."""
            if state is None or state["held"] is None:
                return
            own = not state["head"]
            lost = state["lost_tail"] if own else state["lost_head"]
            n = number() if own else None
            if lost:
                for v in cutter.rows(state["held"]):
                    put(state["block"], n, -1, v, UNCLOSED)
            else:
                put(state["block"] if own else state["owner"], n, state["block"], cutter.joint.join(state["held"]), None)

        def flush():
            cols = list(zip(*out)) or [[]] * 6
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(cols, _RECORDS_ARROW)],
                                              schema=_RECORDS_ARROW)

        for b in batches:
            for part in _runs(b):
                key = (part.column("fid")[0].as_py(), part.column("block")[0].as_py())
                if state is None or (state["fid"], state["block"]) != key:
                    end()
                    state = {c: part.column(c)[0].as_py() for c in
                             ("fid", "block", "inside", "depth", "owner", "base", "lost_head", "lost_tail")}
                    state["i"], state["held"] = 0, None
                    state["head"] = cutter.opened(state)
                    if state["head"]:
                        state["held"] = []
                for raw, error in cutter.cut(state, part.column("value").to_pylist()):
                    if not state["head"]:
                        put(state["block"], number(), -1, raw, error)
                    elif state["lost_head"]:
                        for v in cutter.rows([raw]):
                            put(state["owner"], None, -1, v, UNCLOSED)
                    else:
                        put(state["owner"], None, state["block"], raw, error)
                    state["head"] = False
            if out:
                yield flush()
        end()
        if out:
            yield flush()
    return run


@dataclass
class Records:
    """``table(fid, n, raw, error)`` and ``splits`` (``_STARTS``)."""

    table: DataFrame
    splits: DataFrame

    def unclosed(self) -> bool:
        return not self.splits.where("lost_tail").isEmpty()


def read_records(spark: SparkSession, path, cutter) -> Records:
    """Every record of the files under ``path``, whichever splits it crosses."""
    ship_package(spark)
    pieces = _pieces(spark, path, cutter.ends)
    summaries = pieces.mapInArrow(_summaries(cutter), _SUMMARY)
    splits = stored(summaries.groupBy("fid").applyInPandas(_compose(cutter.floor), _STARTS), "splits")
    count, crossing = splits.agg(F.count("*"), F.count_if((F.col("inside") == 1) | (F.col("depth") > cutter.floor))).first()
    if count > MAX_SPLITS:
        raise ValueError(f"{count} input splits; raise spark.sql.files.maxPartitionBytes")
    starts = F.broadcast(splits.drop("file", "started"))  # at most MAX_SPLITS small rows
    cut = pieces.drop("file").join(starts, ["fid", "block"]).mapInArrow(_cut(cutter), _RECORDS)
    whole = cut
    if crossing:
        cut = stored(cut, "records")
        whole = cut.where("part < 0")
        pieces_of = F.sort_array(F.collect_list(F.struct("part", "raw")))
        crossed = cut.where("part >= 0").groupBy("fid", "owner").agg(F.min("n").alias("n"), pieces_of.alias("p")).select(
            "fid", "n", F.array_join(F.col("p.raw"), cutter.joint).alias("raw"), F.lit(None).cast("string").alias("error"))
        if cutter.joint == "\n":
            crossed = crossed.withColumn("raw", F.regexp_replace("raw", "\r$", ""))
        whole = whole.select("fid", "n", "raw", "error").unionByName(crossed)
    return Records(whole.select("fid", "n", "raw", "error"), splits)
