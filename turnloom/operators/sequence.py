"""Ordered operators: sessionisation, fills along an order, interval and as-of joins, sliding windows.

Fills along an episode run in two levels: inside blocks of ``BLOCK`` positions, and over one row for each block. An
episode of any length is thereby worked on by many tasks, and what meets in one task is a row for each block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Positions of a block of an ordered fill.
BLOCK = 4096


def running_last(df: DataFrame, entity: list[str], pos: str, value: Column, out: str, inclusive: bool = True, forward: bool = True) -> DataFrame:
    """``df`` with the last known ``value`` at or before each row (before it, unless ``inclusive``), or with
    ``forward=False`` the first known one at or after it. ``pos`` is an integer that orders an entity's rows."""
    keyed = df.withColumn("_v", value).withColumn("_b", F.floor(F.col(pos) / BLOCK))
    sort, upto = (F.col(pos).asc() if forward else F.col(pos).desc()), (0 if inclusive else -1)
    inside = W.partitionBy(*entity, "_b").orderBy(sort).rowsBetween(W.unboundedPreceding, upto)
    pick = F.max_by if forward else F.min_by
    blocks = keyed.groupBy(*entity, "_b").agg(pick("_v", F.when(F.col("_v").isNotNull(), F.col(pos))).alias("_last"))
    across = W.partitionBy(*entity).orderBy(F.col("_b").asc() if forward else F.col("_b").desc()).rowsBetween(W.unboundedPreceding, -1)
    carried = blocks.select(*entity, "_b", F.last("_last", True).over(across).alias("_carry")).where("_carry is not null")
    local = keyed.withColumn(out, F.last("_v", True).over(inside))
    return local.join(carried, [*entity, "_b"], "left").withColumn(out, F.coalesce(F.col(out), "_carry")).drop("_v", "_b", "_carry")


def nearest_values(df: DataFrame, entity: list[str], pos: str, value: Column, before: str, after: str) -> DataFrame:
    """``running_last`` in both directions at once: the last known ``value`` at or before each row and the first one at or
    after it. Rows are shuffled once, and blocks are summed up once."""
    keyed = df.withColumn("_v", value).withColumn("_b", F.floor(F.col(pos) / BLOCK))
    upto = lambda order: W.partitionBy(*entity, "_b").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    known = F.when(F.col("_v").isNotNull(), F.col(pos))
    blocks = keyed.groupBy(*entity, "_b").agg(F.max_by("_v", known).alias("_last"), F.min_by("_v", known).alias("_first"))
    over = lambda order: W.partitionBy(*entity).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    carried = blocks.select(*entity, "_b", F.last("_last", True).over(over(F.col("_b").asc())).alias("_fore"), F.last("_first", True).over(over(F.col("_b").desc())).alias("_aft")).where("_fore is not null or _aft is not null")
    local = keyed.withColumns({before: F.last("_v", True).over(upto(F.col(pos).asc())), after: F.last("_v", True).over(upto(F.col(pos).desc()))})
    return local.join(carried, [*entity, "_b"], "left").withColumns({before: F.coalesce(before, "_fore"), after: F.coalesce(after, "_aft")}).drop("_v", "_b", "_fore", "_aft")


def running_sum(df: DataFrame, entity: list[str], pos: str, value: Column, out: str) -> DataFrame:
    """``df`` with the sum of ``value`` up to each row, in two levels as above."""
    keyed = df.withColumn("_v", F.coalesce(value.cast("bigint"), F.lit(0))).withColumn("_b", F.floor(F.col(pos) / BLOCK))
    inside = W.partitionBy(*entity, "_b").orderBy(pos).rowsBetween(W.unboundedPreceding, 0)
    blocks = keyed.groupBy(*entity, "_b").agg(F.sum("_v").alias("_sum"))
    across = W.partitionBy(*entity).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    carried = blocks.select(*entity, "_b", F.sum("_sum").over(across).alias("_carry"))
    return keyed.withColumn(out, F.sum("_v").over(inside)).join(carried, [*entity, "_b"]).withColumn(out, F.col(out) + F.coalesce("_carry", F.lit(0))).drop("_v", "_b", "_carry")


def with_neighbours(df: DataFrame, entity: list[str], pos: str, value: Column) -> DataFrame:
    """``df`` with ``_prev`` and ``_next``: the ``value``, a struct, of the rows right before and after, null at the ends.
    Two levels again: neighbours inside a block, and each block's first and last row."""
    keyed = df.withColumn("_v", value).withColumn("_b", F.floor(F.col(pos) / BLOCK))
    inside, across = W.partitionBy(*entity, "_b").orderBy(pos), W.partitionBy(*entity).orderBy("_b")
    ends = keyed.groupBy(*entity, "_b").agg(F.min_by("_v", pos).alias("_first"), F.max_by("_v", pos).alias("_last"))
    beside = ends.select(*entity, "_b", F.lag("_last").over(across).alias("_before"), F.lead("_first").over(across).alias("_after"))
    local = keyed.withColumns({"_prev": F.lag("_v").over(inside), "_next": F.lead("_v").over(inside)})
    return local.join(beside, [*entity, "_b"], "left").withColumns({"_prev": F.coalesce("_prev", "_before"), "_next": F.coalesce("_next", "_after")}).drop("_v", "_b", "_before", "_after")


def word_sessionization(words: DataFrame, entity: list[str], pos: str, gap: float = 0.5) -> DataFrame:
    """Neighbouring words of one speaker with less than ``gap`` seconds between them as one utterance: entity, idx,
    speaker, start_s, end_s, n_words, text. Words keep the order of ``pos``; a word without end ends at its start."""
    if gap < 0:
        raise ValueError("the gap must not be negative")
    end = F.coalesce("end_s", "start_s")
    near = with_neighbours(words, entity, pos, F.struct("speaker", end.alias("end")))
    fresh = F.col("_prev").isNull() | ~F.col("_prev.speaker").eqNullSafe(F.col("speaker")) | (F.col("start_s") - F.col("_prev.end") >= gap)
    marked = near.withColumn("_end", end).withColumn("_new", F.when(F.coalesce(fresh, F.lit(False)), 1).otherwise(0)).drop("_prev", "_next")
    grouped = running_sum(marked, entity, pos, F.col("_new"), "_group").groupBy(*entity, "_group")
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(pos, "word"))), lambda x: x["word"]), " ")
    out = grouped.agg(F.first("speaker").alias("speaker"), F.min_by("start_s", pos).alias("start_s"), F.max_by("_end", pos).alias("end_s"), F.count("*").alias("n_words"), said.alias("text"))
    return out.withColumnRenamed("_group", "idx")


def event_sessions(events: DataFrame, gap_s: float = 4 * 3600.0) -> DataFrame:
    """Sessions of each user of the event stream: user_id, session, n_events, start and end. A user's days are worked on
    apart; each hands on its last time and its number of sessions."""
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    timed = events.select("user_id", "event_id", "ts", at.alias("_t"), F.floor(at / 86_400_000_000).alias("_day"))
    inside, across = W.partitionBy("user_id", "_day").orderBy("ts", "event_id"), W.partitionBy("user_id").orderBy("_day")
    last = timed.groupBy("user_id", "_day").agg(F.max("_t").alias("_end")).select("user_id", "_day", F.lag("_end").over(across).alias("_before"))
    joined = timed.join(last.withColumnRenamed("user_id", "_u").withColumnRenamed("_day", "_d"), F.col("user_id").eqNullSafe(F.col("_u")) & F.col("_day").eqNullSafe(F.col("_d")), "left").drop("_u", "_d")
    gap = F.col("_t") - F.coalesce(F.lag("_t").over(inside), "_before")
    marked = joined.withColumn("_new", F.when(F.coalesce(gap < gap_s * 1e6, F.lit(False)), 0).otherwise(1))
    upto = F.sum("_new").over(inside.rowsBetween(W.unboundedPreceding, 0))
    parts = marked.withColumn("_n", upto).groupBy("user_id", "_day", "_n").agg(F.count("*").alias("n_events"), F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"), F.max("_new").alias("_fresh"))
    days = parts.groupBy("user_id", "_day").agg(F.sum("_fresh").alias("_of_day")).select("user_id", "_day", F.coalesce(F.sum("_of_day").over(across.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_sum"))
    placed = parts.join(days.withColumnRenamed("user_id", "_u").withColumnRenamed("_day", "_d"), F.col("user_id").eqNullSafe(F.col("_u")) & F.col("_day").eqNullSafe(F.col("_d")))
    return placed.withColumn("session", F.col("_n") + F.col("_sum")).groupBy("user_id", "session").agg(F.sum("n_events").alias("n_events"), F.min("start_ts").alias("start_ts"), F.max("end_ts").alias("end_ts"))


def estimate_end_times(rows: DataFrame, entity: list[str], tie: list[str], least: float = 0.5, width: float = 600.0) -> DataFrame:
    """A missing end, or one not after the start, becomes the next start, but at least ``least`` after its own start.
    Stretches of ``width`` seconds are worked on apart; each hands its first start to the one before."""
    keyed = rows.withColumn("_k", F.floor(F.col("start_s") / width))
    inside, across = W.partitionBy(*entity, "_k").orderBy("start_s", *tie), W.partitionBy(*entity).orderBy(F.col("_k").asc_nulls_first())
    firsts = keyed.groupBy(*entity, "_k").agg(F.min("start_s").alias("_first")).select(*[F.col(c).alias(f"_e_{c}") for c in entity], F.col("_k").alias("_j"), F.lead("_first").over(across).alias("_after"))
    same = F.col("_k").eqNullSafe(F.col("_j"))
    for c in entity:
        same = same & F.col(c).eqNullSafe(F.col(f"_e_{c}"))
    near = keyed.withColumn("_next", F.lead("start_s").over(inside)).join(firsts, same, "left")
    guess = F.greatest(F.col("start_s") + least, F.coalesce("_next", "_after"))
    done = near.withColumn("end_s", F.when(F.col("end_s").isNull() | (F.col("end_s") <= F.col("start_s")), guess).otherwise(F.col("end_s")))
    return done.select(*rows.columns)


def fill_scene_ids(rows: DataFrame, entity: list[str], pos: str, first: int = 1) -> DataFrame:
    """The last known scene for rows without one; ``first`` before any is known."""
    return running_last(rows, entity, pos, F.col("scene_id"), "_scene").withColumn("scene_id", F.coalesce("_scene", F.lit(first)).cast("int")).drop("_scene")


def scene_ids_from_markers(rows: DataFrame, entity: list[str], pos: str, marker: Column) -> DataFrame:
    """Scenes counted by marker rows; rows before the first marker get its number. Without markers, null."""
    numbered = running_sum(rows, entity, pos, F.when(marker, 1).otherwise(0), "_n")
    any_of = rows.where(marker).select(*entity).distinct().withColumn("_any", F.lit(True))
    joined = numbered.join(any_of, entity, "left")
    return joined.withColumn("scene_id", F.when(F.col("_any"), F.greatest("_n", F.lit(1))).cast("int")).drop("_n", "_any")


def prev_next_speaker(rows: DataFrame, entity: list[str], pos: str) -> DataFrame:
    """The speakers of the rows right before and after, if of the same scene; empty otherwise."""
    near = with_neighbours(rows, entity, pos, F.struct("scene_id", "speaker"))
    side = lambda c: F.when(F.col(f"{c}.scene_id") == F.col("scene_id"), F.coalesce(F.trim(F.col(f"{c}.speaker")), F.lit(""))).otherwise("")
    return near.withColumns({"prev_speaker_scene": side("_prev"), "next_speaker_scene": side("_next")}).drop("_prev", "_next")


def scene_runs(rows: DataFrame, entity: list[str], pos: str) -> DataFrame:
    """``rows`` with ``run``: the position at which the contiguous stretch of one scene begins that a row is in. A row
    without a scene is a stretch of its own."""
    near = with_neighbours(rows, entity, pos, F.struct("scene_id"))
    fresh = ~F.coalesce(F.col("_prev.scene_id") == F.col("scene_id"), F.lit(False))
    return running_last(near.drop("_next"), entity, pos, F.when(fresh, F.col(pos)), "run").drop("_prev")


def nearest_known_speaker(rows: DataFrame, entity: list[str], pos: str) -> DataFrame:
    """The nearest known speaker on either side within the contiguous stretch of the scene; empty if there is none."""
    known = F.nullif(F.trim("speaker"), F.lit(""))
    w = W.partitionBy(*entity, "run").orderBy(pos)
    before = F.last(known, True).over(w.rowsBetween(W.unboundedPreceding, -1))
    after = F.first(known, True).over(w.rowsBetween(1, W.unboundedFollowing))
    return scene_runs(rows, entity, pos).withColumns({"prev_known": F.coalesce(before, F.lit("")), "next_known": F.coalesce(after, F.lit(""))})


def review_queue(rows: DataFrame, entity: list[str], pos: str, flagged: Column, context: int = 2) -> DataFrame:
    """The flagged rows with up to ``context`` rows on either side. Rows are numbered in blocks; a flagged one asks for the
    numbers around it."""
    numbered = running_sum(rows.withColumn("_flag", flagged), entity, pos, F.lit(1), "_nr")
    asked = numbered.where("_flag").select(*entity, F.explode(F.sequence(F.col("_nr") - context, F.col("_nr") + context)).alias("_nr")).distinct()
    return numbered.join(asked, [*entity, "_nr"], "left_semi").select(*rows.columns)


def restore_by_position(rows: DataFrame, original: DataFrame, entity: list[str], pos: str, columns: list[str]) -> DataFrame:
    """``rows`` with ``columns`` of the rows of ``original`` that stand at the same place of their entity, both in the order
    of ``pos``. An entity with more rows on either side is an error."""
    numbered = running_sum(rows, entity, pos, F.lit(1), "_nr")
    given = running_sum(original.select(*entity, pos, *columns), entity, pos, F.lit(1), "_nr").select(*entity, "_nr", *columns, F.lit(True).alias("_there")).drop(pos)
    met = numbered.drop(*columns).withColumn("_here", F.lit(True)).join(given, [*entity, "_nr"], "full")
    fits = F.col("_here").isNotNull() & F.col("_there").isNotNull()
    checked = met.withColumn("_nr", F.when(fits, F.col("_nr")).otherwise(F.raise_error(F.concat(F.lit("row counts differ: "), F.coalesce(F.col(entity[0]).cast("string"), F.lit("?"))))))
    return checked.where("_nr is not null").select(*rows.columns, *[c for c in columns if c not in rows.columns])


def scene_by_dialogue(events: DataFrame, entity: list[str], pos: str) -> DataFrame:
    """The last scene description before each dialogue of a list of events with ``kind`` and ``scene_desc``."""
    carried = running_last(events, entity, pos, F.when(F.col("kind") == "scene", F.col("scene_desc")), "scene")
    return carried.where("kind = 'dialogue'").withColumn("scene", F.coalesce("scene", F.lit("")))


def scene_marker_rows(rows: DataFrame, entity: list[str], pos: str, scene: str) -> DataFrame:
    """A row in front of each one whose scene differs from the last known one: the marker has ``is_marker`` and the scene."""
    known = F.nullif(F.col(scene), F.lit(""))
    carried = running_last(rows, entity, pos, known, "_last", inclusive=False)
    changed = known.isNotNull() & ~F.coalesce(known == F.col("_last"), F.lit(False))
    return carried.withColumn("is_marker", F.explode(F.when(changed, F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(False))))).drop("_last")


def shot_at(times: DataFrame, shots: DataFrame, entity: str, at: str, id_col: str, width: float = 60.0) -> DataFrame:
    """The first shot by start that covers a time, start included and end not, but the end of an entity's last shot
    too: id, shot_id; null where no shot does.

    Times and shots meet in buckets of ``width`` seconds; a shot is in each bucket it touches.
    """
    s = shots.where("start_s is not null and end_s is not null and end_s >= start_s").select(F.col(entity).alias("_e"), "shot_id", F.col("start_s").alias("_a"), F.col("end_s").alias("_b"))
    last = s.groupBy("_e").agg(F.max(F.struct("_a", "_b", "shot_id")).alias("m")).select("_e", F.col("m.shot_id").alias("_last"), F.col("m._a").alias("_last_a"))
    s = s.join(last, "_e").withColumn("_final", (F.col("shot_id") == F.col("_last")) & (F.col("_a") == F.col("_last_a")))
    buckets = s.withColumn("_k", F.explode(F.sequence(F.floor(F.col("_a") / width), F.floor(F.col("_b") / width))))
    t = times.where(F.col(at).isNotNull()).select(F.col(entity).alias("_e"), F.col(id_col).alias("_id"), F.col(at).alias("_t"), F.floor(F.col(at) / width).alias("_k"))
    inside = (F.col("_a") <= F.col("_t")) & ((F.col("_t") < F.col("_b")) | F.col("_final") & (F.col("_t") == F.col("_b")))
    hit = t.join(buckets, ["_e", "_k"]).where(inside).groupBy("_id").agg(F.min(F.struct("_a", "shot_id")).alias("m")).select(F.col("_id").alias(id_col), F.col("m.shot_id").alias("shot_id"))
    return times.select(id_col).distinct().join(hit, id_col, "left")


def asof_shot(times: DataFrame, shots: DataFrame, entity: str, at: str, id_col: str) -> DataFrame:
    """The last shot that starts at or before a time: id, shot_id, start; null where none does. Both tables are merged
    into one order and filled forward in blocks of a minute, so no row meets another table's rows one by one."""
    a = shots.where("start_s is not null").select(F.col(entity).alias("_e"), F.col("start_s").alias("_t"), F.lit(0).alias("_side"), F.col("shot_id").cast("bigint").alias("_i"))
    b = times.where(F.col(at).isNotNull()).select(F.col(entity).alias("_e"), F.col(at).alias("_t"), F.lit(1).alias("_side"), F.col(id_col).cast("bigint").alias("_i"))
    both = a.unionByName(b).withColumn("_k", F.floor(F.col("_t") / 60.0))
    shot = F.when(F.col("_side") == 0, F.struct(F.col("_t").alias("t"), F.col("_i").alias("i")))
    inside = W.partitionBy("_e", "_k").orderBy("_t", "_side", "_i").rowsBetween(W.unboundedPreceding, 0)
    last = both.where("_side = 0").groupBy("_e", "_k").agg(F.max(F.struct(F.col("_t").alias("t"), F.col("_i").alias("i"))).alias("m"))
    across = W.partitionBy("_e").orderBy("_k").rowsBetween(W.unboundedPreceding, -1)
    carry = both.select("_e", "_k").distinct().join(last, ["_e", "_k"], "left").select("_e", "_k", F.last("m", True).over(across).alias("_carry"))
    found = both.withColumn("_m", F.last(shot, True).over(inside)).where("_side = 1").join(carry, ["_e", "_k"], "left")
    best = F.coalesce("_m", "_carry")
    return found.select(F.col("_i").alias(id_col), best["i"].cast("int").alias("shot_id"), best["t"].alias("shot_start_s"))


def words_to_sentences(words: DataFrame, sentences: DataFrame, entity: list[str]) -> DataFrame:
    """Which sentence each word belongs to: entity, idx, sentence_idx. The pointer is the first sentence that doesn't
    end before the latest word start so far (the last one if all do); of it and its neighbours the first that holds the
    word's start wins, else the one of greatest overlap, if it is more than one second short of none.

    ``words`` and ``sentences`` have entity, idx, start_s and end_s; sentences start in the order of idx.
    """
    eps = 1e-3
    w = W.partitionBy(*entity).orderBy("idx")
    ws = words.where("start_s is not null").select(*entity, F.col("idx").alias("_w"), "start_s", F.coalesce("end_s", "start_s").alias("end_s"), F.max("start_s").over(w.rowsBetween(W.unboundedPreceding, 0)).alias("_m"))
    ss = sentences.select(*entity, F.row_number().over(w).alias("_k"), F.col("idx").alias("_s"), F.col("start_s").alias("_a"), F.coalesce("end_s", "start_s").alias("_b"))
    # The latest end so far is monotone, so the pointer is one past the sentences whose latest end lies before the word.
    ends = ss.withColumn("_end", F.max("_b").over(W.partitionBy(*entity).orderBy("_k").rowsBetween(W.unboundedPreceding, 0)))
    merged = ends.select(*entity, (F.col("_end") + eps).alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast("int").alias("_w"), "_k").unionByName(ws.select(*entity, F.col("_m").alias("_t"), F.lit(0).alias("_side"), "_w", F.lit(None).cast("int").alias("_k")))
    upto = W.partitionBy(*entity).orderBy("_t", "_side").rowsBetween(W.unboundedPreceding, 0)
    size = ss.groupBy(*entity).agg(F.max("_k").alias("_n"))
    pointed = merged.withColumn("_p", F.coalesce(F.max("_k").over(upto), F.lit(0)) + 1).where("_side = 0").select(*entity, "_w", "_p").join(size, entity).withColumn("_p", F.least("_p", "_n")).drop("_n")
    near = ws.join(pointed, [*entity, "_w"]).withColumn("_c", F.explode(F.array(F.struct(F.lit(0).alias("o"), F.col("_p").alias("k")), F.struct(F.lit(1).alias("o"), (F.col("_p") - 1).alias("k")), F.struct(F.lit(2).alias("o"), (F.col("_p") + 1).alias("k"))))).withColumn("_k", F.col("_c.k"))
    met = near.join(ss, [*entity, "_k"])
    holds = (F.col("_a") - eps <= F.col("start_s")) & (F.col("start_s") <= F.col("_b") + eps)
    overlap = F.least("end_s", "_b") - F.greatest("start_s", "_a")
    key = F.struct(F.when(holds, 0).otherwise(1).alias("h"), F.when(holds, 0.0).otherwise(-overlap).alias("v"), F.col("_c.o").alias("o"), F.col("_s").alias("s"))
    best = met.where(holds | (overlap > -1.0)).groupBy(*entity, "_w").agg(F.min(key).alias("m")).select(*entity, "_w", F.col("m.s").alias("sentence_idx"))
    return words.select(*entity, F.col("idx").alias("_w")).join(best, [*entity, "_w"], "left").withColumnRenamed("_w", "idx")


def propagate_unique(rows: DataFrame, group: list[str], value: str, filled: str = "fill_method") -> DataFrame:
    """Blank values take the group's value where the group has exactly one; ``filled`` says where."""
    known = F.nullif(F.trim(value), F.lit(""))
    single = rows.where(known.isNotNull()).groupBy(*group).agg(F.min(known).alias("_lo"), F.max(known).alias("_hi")).where("_lo = _hi").drop("_hi")
    joined = rows.join(single, group, "left")
    fill = known.isNull() & F.col("_lo").isNotNull()
    return joined.withColumn(filled, F.when(fill, "dialogue_propagation")).withColumn(value, F.when(fill, F.col("_lo")).otherwise(known)).drop("_lo")


def scene_summary(rows: DataFrame, shots: DataFrame, id_col: str = "sent_id") -> DataFrame:
    """For each scene with timed rows: episode, scene_id, start_s, end_s, n_rows and the sorted shots at the rows' ends."""
    timed = rows.where("scene_id is not null and start_s is not null").withColumn("end_s", F.coalesce("end_s", "start_s"))
    both = timed.select("episode", "scene_id", F.explode(F.array("start_s", "end_s")).alias("_t"), id_col)
    keyed = both.withColumn("_k2", F.xxhash64(id_col, "_t"))
    at = shot_at(keyed, shots, "episode", "_t", "_k2")
    found = keyed.join(at, "_k2", "left").groupBy("episode", "scene_id").agg(F.array_sort(F.collect_set("shot_id")).alias("shot_ids"))
    spans = timed.groupBy("episode", "scene_id").agg(F.min("start_s").alias("start_s"), F.max("end_s").alias("end_s"), F.count("*").alias("n_rows"))
    return spans.join(found, ["episode", "scene_id"], "left")


def scenes_from_rows(rows: DataFrame, pos: str) -> DataFrame:
    """Scenes of rows with scene, speaker and shot: bounds, speakers in the order first heard, shots and rows counted."""
    speaker = F.nullif(F.trim("speaker"), F.lit(""))
    heard = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(speaker.isNotNull(), F.struct(F.col(pos).alias("p"), speaker.alias("s"))))), lambda x: x["s"]))
    kept = rows.where("scene_id is not null and start_s is not null").withColumn("end_s", F.coalesce("end_s", "start_s"))
    return kept.groupBy("episode", "scene_id").agg(F.min("start_s").alias("start_s"), F.max("end_s").alias("end_s"), heard.alias("speakers"), F.countDistinct("shot_id").alias("n_shots"), F.count("*").alias("n_utterances"), F.array_sort(F.collect_list(pos)).alias("utterance_indices"))


def sliding_window_best(similarity: DataFrame, entity: list[str], left: str, right: str, value: str, size: int, n_right: DataFrame) -> DataFrame:
    """The stretch of ``size`` right rows on which the left rows' best similarities average highest; the first of equals:
    entity, start_idx, end_idx, score. ``similarity`` has a row for each left and right index (from 0), ``n_right`` the
    number of right rows of each entity as n."""
    if size <= 0:
        raise ValueError(f"the window must be positive, not {size}")
    ahead = W.partitionBy(*entity, left).orderBy(right).rowsBetween(0, size - 1)
    best = similarity.withColumn("_best", F.max(value).over(ahead)).join(n_right, entity).where(F.col(right) <= F.greatest(F.lit(0), F.col("n") - size))
    scored = best.groupBy(*entity, right, "n").agg((F.floor(F.sum(F.round(F.col("_best") * 1e6).cast("bigint")) / F.count("*")) / 1e6).alias("score"))
    top = scored.groupBy(*entity).agg(F.max(F.struct("score", -F.col(right), "n")).alias("m"))
    start = -F.col("m.col2")
    return top.select(*entity, start.alias("start_idx"), F.least(start + size, F.col("m.n")).alias("end_idx"), F.col("m.score").alias("score"))


def episode_window(similarity: DataFrame, entity: list[str], left: str, right: str, value: str, n_right: DataFrame, size: int | None = None) -> DataFrame:
    """Where the left rows lie among the right ones: the first window of greatest average best similarity, as entity,
    start_idx, end_idx (exclusive), score. ``size`` defaults to 1.2 times the left rows plus 5; every 25th part of the
    left rows is compared. A window as long as the right side is the whole; entities of ``n_right`` (entity, n) without
    left rows get the whole, with score null."""
    if size is not None and size <= 0:
        raise ValueError(f"the window must be positive, not {size}")
    rows = similarity.groupBy(*entity, left).agg(F.transform(F.array_sort(F.collect_list(F.struct(right, value))), lambda x: x[value]).alias("_row"))
    n_left = rows.groupBy(*entity).agg((F.max(left) + 1).alias("_m"))
    sized = n_right.join(n_left, entity, "left").withColumn("_w", F.least(F.col("n"), F.lit(size) if size else (F.floor(F.col("_m") * 1.2) + 5)))
    todo = sized.where("_m is not null and _w < n")
    step = F.greatest(F.lit(1), F.floor(F.col("_m") / 25))
    sampled = rows.join(todo, entity).where(F.col(left) % step == 0)
    spans = sampled.select(*entity, "n", "_w", F.posexplode(F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("n") - F.col("_w")), lambda j: F.array_max(F.slice("_row", (j + 1).cast("int"), F.col("_w").cast("int"))))).alias("_j", "_best"))
    scored = spans.groupBy(*entity, "_j", "_w").agg((F.floor(F.sum(F.round(F.col("_best") * 1e6).cast("bigint")) / F.count("*")) / 1e6).alias("score"))
    top = scored.groupBy(*entity).agg(F.max(F.struct("score", -F.col("_j"), "_w")).alias("t")).select(*entity, (-F.col("t.col2")).cast("bigint").alias("start_idx"), (-F.col("t.col2") + F.col("t._w")).cast("bigint").alias("end_idx"), F.col("t.score").alias("score"))
    whole = sized.where("_m is null or _w >= n").select(*entity, F.lit(0).cast("bigint").alias("start_idx"), F.col("n").cast("bigint").alias("end_idx"), F.lit(None).cast("double").alias("score"))
    return top.unionByName(whole)
