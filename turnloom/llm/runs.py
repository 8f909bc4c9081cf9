"""Repeated consecutive events: symbol strings and a backreference regex.

Every entity's events are cut into blocks of positions. In a block the canonical events become Unicode
code points, the block a string, and ``(.)\\1*`` its runs. Runs touching a block's edge are events of the
next, coarser level, where the same regex joins them, until one block is left: as many levels as the positions need,
so no task ever sees more than ``BLOCK`` positions or ``2 * FAN`` edge runs, however long or sparse the entity is.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnloom.functions.staging import stage

#: Positions of a block: 2 ** 12; a block of the next level holds 2 ** 10 of them.
BLOCK_BITS, FAN_BITS = 12, 10
BREAK = "\x01"
RUN = re.compile(r"\x01+|([^\x01])\1*", re.S)
SCHEMA = "entity string, grp string, symbol string, child bigint, edge boolean, first_pos bigint, last_pos bigint, n_events bigint, start_s double, end_s double"


def speaker_key(speaker: Column) -> Column:
    """Letters, digits and marks of a label in lower case, without bracketed remarks; null if none is left."""
    plain = F.regexp_replace(speaker, r"\([^)]*\)|\[[^\]]*\]|\{[^}]*\}|<[^>]*>", " ")
    return F.nullif(F.regexp_replace(F.lower(plain), r"[^\p{L}\p{N}\p{M}]", ""), F.lit(""))


def _symbols(keys: list[str | None], children: list[int | None]) -> tuple[str, list[int]]:
    """The block as a string, and the event of each of its characters (-1 for an inserted break)."""
    codes: dict[str, str] = {}
    text, owner = [], []
    for i, key in enumerate(keys):
        if i and children[i] is not None and children[i] == children[i - 1]:
            text.append(BREAK)  # what lies between two edges of one block is settled already
            owner.append(-1)
        if key is None:
            text.append(BREAK)
        else:
            key = unicodedata.normalize("NFC", key)
            text.append(codes.setdefault(key, chr(0x100 + len(codes))))
        owner.append(i)
    return "".join(text), owner


def _runs_of(row: dict) -> Iterator[tuple]:
    events = sorted(row["events"], key=lambda e: (e["first_pos"], e["last_pos"]))
    if row["level"] == 1:  # of a position delivered twice, one event counts
        events = [e for i, e in enumerate(events) if not i or e["first_pos"] != events[i - 1]["first_pos"]]
    keys = [None if e["symbol"] is None else f"{e['grp']}\x00{e['symbol']}" for e in events]
    text, owner = _symbols(keys, [e["child"] for e in events])
    for m in RUN.finditer(text):
        own = [events[i] for i in owner[m.start() : m.end()] if i >= 0]
        if not own:
            continue
        first, last = own[0], own[-1]
        edge = m.start() == 0 or m.end() == len(text)
        if m[1] is None and not edge:
            continue
        starts = [e["start_s"] for e in own if e["start_s"] is not None]
        ends = [e["end_s"] for e in own if e["end_s"] is not None]
        yield (row["entity"], first["grp"] if m[1] else None, first["symbol"] if m[1] else None, row["block"], edge, first["first_pos"], last["last_pos"], sum(e["n_events"] for e in own), min(starts, default=None), max(ends, default=None))


def _collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    for batch in batches:
        for k in range(0, batch.num_rows, 64):
            out = [r for row in batch.slice(k, 64).to_pylist() for r in _runs_of(row)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)


def _level(events: DataFrame, level: int, bits: int | None) -> DataFrame:
    block = F.shiftright(F.col("first_pos"), bits) if bits else F.lit(0).cast("bigint")
    grouped = events.groupBy("entity", block.alias("block")).agg(F.collect_set(F.struct("grp", "symbol", "child", "first_pos", "last_pos", "n_events", "start_s", "end_s")).alias("events"))
    return grouped.withColumn("level", F.lit(level)).mapInArrow(_collapse, SCHEMA)


def collapse_runs(events: DataFrame, entity: str, group: str, symbol: Column, position: str, start: str, end: str, min_events: int = 1) -> DataFrame:
    """One row for each longest run of events of an ``entity`` that follow each other by ``position`` with the
    same ``group`` and ``symbol``: entity, grp, symbol, first_pos, last_pos, n_events, start_s, end_s, duration_s.

    An event with null group or symbol is in no run and ends the one before it. An event with null entity or
    position has no place in any sequence and is left out. A position delivered several times counts once
    (of differing deliveries the one with the least values). ``start_s``/``end_s`` are the earliest start and
    latest end known in the run, null if none is; ``duration_s`` is null with either. An empty input gives no rows;
    other columns of the input are not looked at.
    """
    base = events.select(
        F.col(entity).alias("entity"),
        F.when(symbol.isNotNull(), F.col(group)).cast("string").alias("grp"),
        F.when(F.col(group).isNotNull(), symbol).alias("symbol"),
        F.lit(None).cast("bigint").alias("child"),
        F.col(position).cast("bigint").alias("first_pos"),
        F.col(position).cast("bigint").alias("last_pos"),
        F.lit(1).cast("bigint").alias("n_events"),
        F.nanvl(F.col(start).cast("double"), F.lit(None)).alias("start_s"),
        F.nanvl(F.col(end).cast("double"), F.lit(None)).alias("end_s"),
    ).where("entity is not null and first_pos is not null")
    done, rest, level, bits = [], base, 1, BLOCK_BITS
    while True:
        runs = stage(_level(rest, level, bits), f"runs{level}")
        done.append(runs.where("not edge"))
        rest = runs.where("edge").withColumn("child", F.coalesce("child", F.lit(0)))
        level, bits = level + 1, bits + FAN_BITS
        # One block, or one on either side of 0, holds all that is left of an entity: the last level joins it.
        span = rest.agg(F.min(F.shiftright("first_pos", min(bits, 63))).alias("a"), F.max(F.shiftright("first_pos", min(bits, 63))).alias("b")).collect()[0]
        if span["a"] is None or span["b"] - span["a"] <= 1:
            break
    done.append(_level(rest, level, None))
    whole = done[0]
    for part in done[1:]:
        whole = whole.unionByName(part)
    whole = whole.where(F.col("symbol").isNotNull() & (F.col("n_events") >= min_events))
    return whole.select("entity", "grp", "symbol", "first_pos", "last_pos", "n_events", "start_s", "end_s", (F.col("end_s") - F.col("start_s")).alias("duration_s"))
