"""Imputation of missing speakers: direct fills, the rule cascade in closed form and as an ordered fold, review flags."""

from __future__ import annotations

from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from turnloom import schemas
from turnloom.functions import text as T
from turnloom.functions.staging import stage
from turnloom.operators.sequence import prev_next_speaker, scene_runs


@dataclass(frozen=True)
class Rules:
    """Markers, openers and scores of the rules; fixed values."""

    song_markers: tuple[str, ...] = T.SONG_MARKERS
    continuation_prefixes: tuple[str, ...] = ("and ", "but ", "so ", "because ", "well ")
    scores: dict[str, float] = field(default_factory=lambda: {"ct_match": 1.00, "direction": 0.95, "high_bridge": 0.88, "name_address": 0.74, "short_turn": 0.70, "scene_context": 0.68, "long_ambiguous": 0.66, "weak_ambiguous": 0.58, "scene_majority": 0.52})

    @classmethod
    def from_yaml(cls, path: str) -> Rules:
        """Rules of a YAML file with ``rules`` and ``scores``."""
        import yaml

        with open(path, encoding="utf-8") as f:
            data = yaml.safe_load(f)
        return cls(tuple(data["rules"]["song_markers"]), tuple(data["rules"]["continuation_prefixes"]), {k: float(v) for k, v in data["scores"].items()})


# What each rule writes. Method, confidence, key of its score and what is added to it, review, reason, note.
OUTCOMES = {
    "song": ("non_dialogue_rule", "high", "ct_match", -0.02, False, "", "Marked as song lyric rather than scene dialogue."),
    "bridge": ("scene_context_bridge", "high", "high_bridge", 0.0, False, "", "Same speaker appears on both sides within the same scene."),
    "names_previous": ("name_address_rule", "medium", "name_address", 0.0, False, "", "Utterance names the previous speaker, so the next speaker is more likely."),
    "names_next": ("name_address_rule", "medium", "name_address", 0.0, False, "", "Utterance names the next speaker, so the previous speaker is more likely."),
    "short": ("short_turn_alternation", "medium", "short_turn", 0.0, True, "short_utterance_between_two_speakers", "Short utterance inferred from local turn alternation."),
    "opener": ("scene_context_inference", "medium", "scene_context", 0.03, False, "", "Continuation-style opener favors previous speaker within the same scene."),
    "end": ("scene_context_inference", "medium", "scene_context", 0.0, False, "", "Filled from previous same-scene context."),
    "end_short": ("scene_context_inference", "medium", "scene_context", 0.0, True, "scene_end_short_utterance", "Filled from previous same-scene context."),
    "start": ("scene_context_inference", "medium", "scene_context", 0.0, False, "", "Filled from next same-scene context."),
    "start_short": ("scene_context_inference", "medium", "scene_context", 0.0, True, "scene_start_short_utterance", "Filled from next same-scene context."),
    "long": ("scene_context_inference", "medium", "long_ambiguous", 0.0, True, "two_sided_context_ambiguous", "No direct transcript match; longer line defaulted to previous speaker in same scene."),
    "weak": ("scene_context_inference", "low", "weak_ambiguous", 0.0, True, "two_sided_context_ambiguous", "No direct transcript match; weak local context only."),
    "majority": ("scene_majority_fallback", "low", "scene_majority", 0.0, True, "scene_majority_fallback", "Fallback to most common known speaker in the scene."),
}
DIRECTION_NOTE, BLANK_NOTE = "Stage direction or sound cue kept without speaker.", "No reliable automatic assignment available."


def outcome(name: str, scores: dict[str, float]) -> tuple[str, str, float, bool, str, str]:
    """(method, confidence, score, review, reason, note) of a rule."""
    method, confidence, key, more, review, reason, note = OUTCOMES[name]
    return method, confidence, scores[key] + more, review, reason, note


def direct_fill(rows: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Blank speakers from the typed transcript, and rows stamped where both agree. Needs utterance, speaker, speaker_ct;
    adds speaker_original, row_type, matched_to_ct, filled_from_missing, speaker_method, speaker_confidence,
    alignment_score, review_flag, review_reason and notes."""
    was, typed = T.clean(F.col("speaker")), T.clean(F.col("speaker_ct"))
    base = rows.withColumns({"speaker_original": was, "speaker_ct": typed, "row_type": T.row_type(F.col("utterance"), rules.song_markers)})
    direct = (F.col("speaker_original") == "") & (F.col("speaker_ct") != "")
    agreed = (F.col("speaker_original") != "") & (F.col("speaker_original") == F.col("speaker_ct"))
    return base.withColumns(
        {
            "speaker": F.when(direct, F.col("speaker_ct")).otherwise(F.col("speaker_original")),
            "matched_to_ct": F.col("speaker_ct") != "",
            "filled_from_missing": direct,
            "speaker_method": F.when(direct | agreed, "community_transcript_match").otherwise(""),
            "speaker_confidence": F.when(direct | agreed, "high").otherwise(""),
            "alignment_score": F.when(direct | agreed, rules.scores["ct_match"]).otherwise(0.0),
            "review_flag": F.lit(False),
            "review_reason": F.lit(""),
            "notes": F.when(direct, "Speaker copied from available community-transcript mapping.").when(agreed, "Speaker agrees with available community-transcript mapping.").otherwise(""),
        }
    )


def rule_cascade(rows: DataFrame, entity: list[str], pos: str, rules: Rules = Rules()) -> DataFrame:
    """The rules for blank speakers, first match wins, rows in order and each fill seen by the later ones.

    Closed form, without a fold over rows: between known rows, a blank row's previous speaker is the last known one (or
    ``Song`` after a song row) and its next one the next known. The first row of such a gap that takes the next speaker
    makes all later rows of the gap lie between equals. Adds or replaces speaker, filled_from_missing, speaker_method,
    speaker_confidence, alignment_score, review_flag, review_reason. Scene stretches without a known speaker but with a
    song, and scenes that recur after others, are folded row by row in the grouped fallback.
    """
    s = rules.scores
    known = F.nullif(T.clean(F.col("speaker")), F.lit(""))
    base = (rows if "run" in rows.columns else scene_runs(rows, entity, pos)).withColumn("_known", known)
    run = [*entity, "run"]
    todo = F.col("_known").isNull() & (F.col("row_type") != "direction")
    song = todo & (F.col("row_type") == "song")
    heard = F.coalesce("_known", F.when(song, F.lit("Song")))
    base = base.withColumns({"_song": song, "_todo": todo, "_stop": F.when(heard.isNotNull(), 1).otherwise(0)})
    w = W.partitionBy(*run).orderBy(pos)
    before, upto, after = w.rowsBetween(W.unboundedPreceding, -1), w.rowsBetween(W.unboundedPreceding, 0), w.rowsBetween(1, W.unboundedFollowing)
    b = base.withColumns({"_p": F.last(heard, True).over(before), "_n": F.first("_known", True).over(after), "_gap": F.sum("_stop").over(upto)})
    p, n = F.col("_p"), F.col("_n")
    b = b.withColumns({"_norm": T.normalize_rule(F.col("utterance")), "_wc": T.word_count(F.col("utterance"))})
    norm, wc = F.col("_norm"), F.col("_wc")
    padded = F.concat(F.lit(" "), norm, F.lit(" "))
    named = lambda who: F.contains(padded, F.concat(F.lit(" "), F.lower(who), F.lit(" ")))
    both = p.isNotNull() & n.isNotNull()
    opener = F.lit(False)
    for x in rules.continuation_prefixes:
        opener = opener | norm.startswith(x)

    def rule(who, name):
        fields = ("method", "confidence", "score", "review", "reason", "note")
        return F.struct(who.alias("who"), *[F.lit(v).alias(f) for f, v in zip(fields, outcome(name, s))])

    short = wc <= 2
    choice = (
        F.when(F.col("_song"), rule(F.lit("Song"), "song"))
        .when(both & (p == n), rule(p, "bridge"))
        .when(both & named(p) & ~named(n), rule(n, "names_previous"))
        .when(both & named(n) & ~named(p), rule(p, "names_next"))
        .when(short & both, rule(n, "short"))
        .when(p.isNotNull() & opener, rule(p, "opener"))
        .when(p.isNotNull() & n.isNull(), F.when(short, rule(p, "end_short")).otherwise(rule(p, "end")))
        .when(n.isNotNull() & p.isNull(), F.when(short, rule(n, "start_short")).otherwise(rule(n, "start")))
        .when(both & (wc >= 5), rule(p, "long"))
        .when(both, rule(n, "weak"))
    )
    c = b.withColumn("_c", F.when(F.col("_todo"), choice))
    took_next = F.when(F.col("_todo") & ~F.col("_song") & n.isNotNull() & (F.col("_c.who") == n) & (p.isNull() | (p != n)), F.col(pos))
    c = c.withColumn("_first", F.min(took_next).over(W.partitionBy(*run, "_gap")))
    later = F.col("_todo") & ~F.col("_song") & (F.col(pos) > F.col("_first"))
    final = F.when(later, rule(n, "bridge")).otherwise(F.col("_c"))
    c = c.withColumn("_f", final)
    hit = F.col("_todo") & F.col("_f.who").isNotNull()
    pick = lambda name, old: F.when(hit, F.col(f"_f.{name}")).otherwise(F.col(old))
    out = c.withColumns({"speaker": F.coalesce("_known", F.col("_f.who"), F.lit("")), "filled_from_missing": F.col("filled_from_missing") | hit, "speaker_method": pick("method", "speaker_method"), "speaker_confidence": pick("confidence", "speaker_confidence"), "alignment_score": pick("score", "alignment_score"), "review_flag": pick("review", "review_flag"), "review_reason": pick("reason", "review_reason"), "notes": pick("note", "notes")})
    return out.drop("_known", "_song", "_todo", "_stop", "_p", "_n", "_gap", "_first", "_c", "_f", "_norm", "_wc", "run")


def stamp_review(rows: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Directions and what is still blank are stamped; low fills, and medium ones from context, are put up for review."""
    direction = (F.col("row_type") == "direction") & (F.col("speaker_method") == "")
    blank = (F.col("speaker") == "") & (F.col("speaker_method") == "") & ~direction
    a = rows.withColumns(
        {
            "speaker_method": F.when(direction, "direction").when(blank, "unresolved").otherwise(F.col("speaker_method")),
            "speaker_confidence": F.when(direction, "high").when(blank, "low").otherwise(F.col("speaker_confidence")),
            "alignment_score": F.when(direction, rules.scores["direction"]).when(blank, 0.0).otherwise(F.col("alignment_score")),
            "review_flag": F.when(blank, True).otherwise(F.col("review_flag")),
            "review_reason": F.when(blank, "unresolved_no_reliable_inference").otherwise(F.col("review_reason")),
            "notes": F.when(direction, DIRECTION_NOTE).when(blank, BLANK_NOTE).otherwise(F.col("notes")),
        }
    )
    low = F.col("filled_from_missing") & (F.col("speaker_confidence") == "low")
    medium = F.col("filled_from_missing") & (F.col("speaker_confidence") == "medium") & F.col("speaker_method").isin("short_turn_alternation", "scene_context_inference") & (F.col("review_reason") == "")
    reason = F.col("review_reason")
    return a.withColumns({"review_flag": F.col("review_flag") | low | medium, "review_reason": F.when(low & (reason == ""), "low_confidence_fill").when(medium, "medium_confidence_context_fill").otherwise(reason)})


def fill_summary(rows: DataFrame, file: list[str]) -> DataFrame:
    """Counts of a file's fills."""
    n = lambda cond, name: F.count_if(cond).alias(name)
    conf = F.col("speaker_confidence")
    return rows.groupBy(*file).agg(
        F.count("*").alias("n_rows"), n(F.col("speaker_original") == "", "original_missing_speaker_rows"), n(F.col("filled_from_missing"), "filled_rows"), n(F.col("review_flag"), "review_rows"),
        n(F.col("speaker") == "", "unresolved_rows"), n(conf == "high", "high_confidence_rows"), n(conf == "medium", "medium_confidence_rows"), n(conf == "low", "low_confidence_rows"),
    )


def scene_majority(rows: DataFrame, scene: list[str], pos: str) -> DataFrame:
    """Each scene's most frequent speaker; of equals the one first heard."""
    counted = rows.where(F.trim("speaker") != "").groupBy(*scene, F.trim("speaker").alias("speaker")).agg(F.count("*").alias("n"), F.min(pos).alias("_first"))
    best = counted.groupBy(*scene).agg(F.min(F.struct(-F.col("n"), "_first", "speaker")).alias("m"))
    return best.select(*scene, F.col("m.speaker").alias("speaker"), (-F.col("m.col1")).alias("n"))


def scene_speaker_set(rows: DataFrame, scene: list[str], pos: str) -> DataFrame:
    """Each scene's speakers in the order first heard, joined by bars."""
    first = rows.where(F.trim("speaker") != "").groupBy(*scene, F.trim("speaker").alias("speaker")).agg(F.min(pos).alias("_first"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("_first", "speaker"))), lambda x: x["speaker"])
    return first.groupBy(*scene).agg(F.array_join(ordered, " | ").alias("scene_speaker_set"))


def fold_rows(pdf: pd.DataFrame, rules: Rules = Rules(), rounds: int = 3) -> pd.DataFrame:
    """The rules as an ordered fold over one file's rows: what the closed form is tested against, and what recurring
    scenes need. Needs scene_id, utterance, speaker, row_type, wc, norm, in order; adds fill_rule, the name of the rule
    that filled a row. Rows without a scene have no neighbours."""
    out = pdf.reset_index(drop=True).copy()
    who, scene, kind = list(out.speaker.fillna("").str.strip()), list(out.scene_id), list(out.row_type)
    norms, counts = list(out.norm), list(out.wc)
    run = list(out.run) if "run" in out else scene
    names = [""] * len(out)
    alone = [x is None or x != x for x in scene]
    heard: dict = {}  # of each scene the known speakers and how often, in the order of the rows that have them
    for x, w in zip(scene, who):
        if w:
            heard.setdefault(x, {}).setdefault(w, 0)
            heard[x][w] += 1

    def near(i: int, step: int) -> str:
        j = i + step
        while 0 <= j < len(who) and not alone[i] and run[j] == run[i] and scene[j] == scene[i]:
            if who[j]:
                return who[j]
            j += step
        return ""

    def most(i: int) -> str:
        """The most frequent speaker of the scene, of equals the one first in the scene."""
        known = {} if alone[i] else heard.get(scene[i], {})
        top = [w for w, k in known.items() if k == max(known.values())]
        if len(top) > 1:
            top = [next(w for w, x in zip(who, scene) if x == scene[i] and w in top)]
        return top[0] if top else ""

    def infer(i: int) -> tuple[str, str]:
        if kind[i] == "song":
            return "Song", "song"
        p, n, norm, wc = near(i, -1), near(i, 1), norms[i], counts[i]
        says = lambda x: f" {x.lower()} " in f" {norm} "
        if p and p == n:
            return p, "bridge"
        if p and n and says(p) != says(n):
            return (n, "names_previous") if says(p) else (p, "names_next")
        if wc <= 2 and p and n:
            return n, "short"
        if p and norm.startswith(rules.continuation_prefixes):
            return p, "opener"
        if p or n:
            if not (p and n):
                return p or n, ("end" if p else "start") + ("_short" if wc <= 2 else "")
            return (p, "long") if wc >= 5 else (n, "weak")
        return most(i), "majority"

    for _ in range(rounds):
        changed = False
        for i in range(len(who)):
            if not who[i] and kind[i] != "direction":
                found, name = infer(i)
                if found:
                    who[i], names[i], changed = found, name, True
                    heard.setdefault(scene[i], {}).setdefault(found, 0)
                    heard[scene[i]][found] += 1
        if not changed:
            break
    out["speaker"], out["fill_rule"] = who, names
    return out


def cascade(rows: DataFrame, entity: list[str], pos: str, rules: Rules = Rules()) -> DataFrame:
    """``rule_cascade`` for all scenes it covers, and the ordered fold, a scene at a time, for those it doesn't: scenes
    that recur after others, and stretches with a song and nobody known. A row without a scene has no context: it is
    filled only if it is a song."""
    scene = [*entity, "scene_id"]
    in_run, in_scene = W.partitionBy(*entity, "run"), W.partitionBy(*scene)
    known, song = F.when(F.trim("speaker") != "", 1).otherwise(0), F.when(F.col("row_type") == "song", 1).otherwise(0)
    runs = scene_runs(rows, entity, pos).withColumn("_mute", F.when((F.max(known).over(in_run) == 0) & (F.max(song).over(in_run) == 1), 1).otherwise(0))
    odd = F.col("scene_id").isNotNull() & ((F.min("run").over(in_scene) != F.max("run").over(in_scene)) | (F.max("_mute").over(in_scene) == 1))
    flagged = stage(runs.withColumn("_odd", odd).drop("_mute"), "cascade")
    plain = rule_cascade(flagged.where("not _odd").drop("_odd"), entity, pos, rules)
    columns = plain.columns
    todo = flagged.where("_odd").withColumns({"wc": T.word_count(F.col("utterance")), "norm": T.normalize_rule(F.col("utterance"))})
    schema = todo.select(*columns).schema
    written = {name: outcome(name, rules.scores) for name in OUTCOMES}

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        done = fold_rows(pdf.sort_values(pos, kind="stable"), rules)
        hit = done.fill_rule != ""
        if not hit.any():
            return done[columns]
        done.loc[hit, "filled_from_missing"] = True
        for k, c in enumerate(("speaker_method", "speaker_confidence", "alignment_score", "review_flag", "review_reason", "notes")):
            done.loc[hit, c] = [written[name][k] for name in done.fill_rule[hit]]
        return done[columns]

    return plain.unionByName(todo.groupBy(*scene).applyInPandas(fold, schema))


def scene_context(rows: DataFrame, entity: list[str], pos: str) -> DataFrame:
    """Rows with the scene's speakers and the speakers right before and after in the scene."""
    sets = scene_speaker_set(rows, [*entity, "scene_id"], pos)
    return prev_next_speaker(rows, entity, pos).join(sets, [*entity, "scene_id"], "left").withColumn("scene_speaker_set", F.coalesce("scene_speaker_set", F.lit("")))


def complete_schema(rows: DataFrame, keep: tuple[str, ...] = ("episode",)) -> DataFrame:
    """The enhanced columns in order, after those in ``keep`` that are there; a missing one has its type's empty value."""
    empty = {"filled_from_missing": F.lit(False), "matched_to_ct": F.lit(False), "review_flag": F.lit(False), "alignment_score": F.lit(0.0)}
    lacking = {c: empty.get(c, F.lit("")) for c in schemas.ENHANCED_COLUMNS if c not in rows.columns}
    return rows.withColumns(lacking).select(*[k for k in keep if k in rows.columns], *schemas.ENHANCED_COLUMNS)
