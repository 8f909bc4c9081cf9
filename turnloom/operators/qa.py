"""Quality checks of filled speakers. Steps that change a speaker are seen by the rows after them, so they are folds,
but never beyond a scene: the groups they run in are scenes, not files."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from turnloom.functions import text as T
from turnloom.functions.staging import stage
from turnloom.operators.sequence import nearest_known_speaker, scene_runs

WEAK = ("low", "medium")
# Method and reason of each correction, and method, least score and note of each settled review.
CORRECTIONS = {
    "ct": ("qa_speaker_ct_override", "speaker_ct mismatch override"),
    "bridge": ("qa_scene_bridge_override", "surrounded by same speaker within scene"),
    "anomaly": ("qa_scene_anomaly_override", "one-off scene speaker anomaly corrected by local scene pattern"),
    "unsupported": ("qa_scene_anomaly_override", "speaker absent from scene CT support and overridden by local scene evidence"),
}
RESOLVED = {
    "bridge": ("qa_review_resolved_bridge", 0.9, "QA resolved prior review by same-speaker bridge."),
    "ct_support": ("qa_review_resolved_ct_support", 1.0, "QA resolved prior review with community-transcript support."),
}


def ct_override(rows: DataFrame) -> DataFrame:
    """Rows whose speaker differs from the typed one, where the fill is weak, under review or not from a match, take the
    typed one. Adds new_speaker (null where nothing changes) and qa_reason."""
    sp, ct = T.clean(F.col("speaker")), T.clean(F.col("speaker_ct"))
    doubt = (F.coalesce("speaker_method", F.lit("")) != "community_transcript_match") | F.coalesce("review_flag", F.lit(False)) | F.coalesce(F.col("speaker_confidence").isin(*WEAK), F.lit(False))
    hit = (sp != "") & (ct != "") & (sp != ct) & doubt
    return rows.withColumns({"new_speaker": F.when(hit, ct), "qa_reason": F.when(hit, CORRECTIONS["ct"][1])})


def apply_changes(rows: DataFrame, method: Column, score: float) -> DataFrame:
    """Rows with their ``new_speaker`` put in place: method, high confidence, the greater score, a note; the review is
    closed. Where the new speaker is the old one nothing changes."""
    hit = F.col("new_speaker").isNotNull() & (F.col("new_speaker") != F.col("speaker"))
    new = {"speaker": F.col("new_speaker"), "speaker_method": method, "speaker_confidence": F.lit("high"), "alignment_score": F.greatest("alignment_score", F.lit(score)), "review_flag": F.lit(False), "review_reason": F.lit(""), "notes": T.append_note(F.col("notes"), F.concat(F.lit("QA correction: "), F.col("qa_reason")))}
    return rows.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in new.items()})


def changes(rows: DataFrame, keys: list[str], method: Column) -> DataFrame:
    """The log of what ``new_speaker`` changes: keys, utterance, old and new speaker and method, reason, typed speaker."""
    hit = F.col("new_speaker").isNotNull() & (F.col("new_speaker") != F.col("speaker"))
    return rows.where(hit).select(*keys, T.clean(F.col("utterance")).alias("utterance"), F.col("speaker").alias("old_speaker"), "new_speaker", F.coalesce("speaker_method", F.lit("")).alias("old_method"), method.alias("new_method"), "qa_reason", F.coalesce("speaker_ct", F.lit("")).alias("speaker_ct"))


def _near(who: list[str], run: list, i: int, step: int) -> str:
    j = i + step
    while 0 <= j < len(who) and run[j] == run[i]:
        if who[j]:
            return who[j]
        j += step
    return ""


def fold_scene(pdf: pd.DataFrame, bridge: bool = True, anomaly: bool = True) -> pd.DataFrame:
    """The two ordered corrections over one scene's rows, in order: a weak short row without typed speaker between two
    rows of one other speaker takes that speaker; so does a weak speaker heard once in the scene if a typed one is
    missing (anomaly), or if the scene's typed speakers know the neighbours but not it (unsupported). Adds fix: the
    correction's name, or empty."""
    out = pdf.reset_index(drop=True).copy()
    who, ct = list(out.speaker.fillna("").str.strip()), list(out.speaker_ct.fillna("").str.strip())
    run, wc = list(out.run), list(out.wc)
    weak = [c in WEAK or bool(r) for c, r in zip(out.speaker_confidence, out.review_flag.fillna(False))]
    fix = [""] * len(out)
    if bridge:
        for i in range(len(who)):
            p, n = _near(who, run, i, -1), _near(who, run, i, 1)
            if who[i] and p and p == n and who[i] != p and weak[i] and wc[i] <= 4 and not ct[i]:
                who[i], weak[i], fix[i] = p, False, "bridge"
    if anomaly:
        counts = {w: who.count(w) for w in set(who)}
        typed = {x for x in ct if x}
        for i in range(len(who)):
            if not who[i] or counts.get(who[i], 0) != 1 or not weak[i]:
                continue
            p, n = _near(who, run, i, -1), _near(who, run, i, 1)
            if p and p == n and p != who[i] and (not ct[i] or typed and who[i] not in typed and p in typed):
                who[i], weak[i], fix[i] = p, False, "unsupported" if ct[i] else "anomaly"
    out["new_speaker"], out["fix"] = who, fix
    return out


def scene_corrections(rows: DataFrame, entity: list[str], pos: str, bridge: bool = True, anomaly: bool = True) -> DataFrame:
    """``fold_scene`` over every scene; adds new_speaker (null where nothing changes), fix and qa_reason. Rows without a
    scene have no neighbours and stay as they are. Only scenes with a weak row are folded."""
    keyed = stage(scene_runs(rows, entity, pos).withColumn("wc", T.word_count(F.col("utterance"))), "qa")
    weak = F.coalesce(F.col("speaker_confidence").isin(*WEAK), F.lit(False)) | F.coalesce("review_flag", F.lit(False))
    keyed = keyed.withColumn("_fold", F.max(weak & F.col("scene_id").isNotNull()).over(W.partitionBy(*entity, "scene_id")))
    columns = [*rows.columns, "new_speaker", "fix"]
    schema = keyed.select(*rows.columns, F.lit("").alias("new_speaker"), F.lit("").alias("fix")).schema

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return fold_scene(pdf.sort_values(pos, kind="stable"), bridge, anomaly)[columns]

    folded = keyed.where("_fold").drop("_fold").groupBy(*entity, "scene_id").applyInPandas(run, schema)
    still = keyed.where("not _fold").select(*rows.columns, F.lit("").alias("new_speaker"), F.lit("").alias("fix"))
    reason = F.create_map(*[F.lit(x) for k, (_, why) in CORRECTIONS.items() for x in (k, why)])[F.col("fix")]
    return folded.unionByName(still).withColumns({"new_speaker": F.when(F.col("fix") != "", F.col("new_speaker")), "qa_reason": F.when(F.col("fix") != "", reason)})


def correction_method() -> Column:
    """The method of a row's ``fix``."""
    return F.create_map(*[F.lit(x) for k, (method, _) in CORRECTIONS.items() for x in (k, method)])[F.col("fix")]


def one_off_speakers(rows: DataFrame, scene: list[str]) -> DataFrame:
    """Speakers heard once in a scene: scene, speaker."""
    return rows.where(F.trim("speaker") != "").groupBy(*scene, F.trim("speaker").alias("speaker")).agg(F.count("*").alias("n")).where("n = 1").drop("n")


def resolve_reviews(rows: DataFrame, entity: list[str], pos: str) -> DataFrame:
    """Rows under review that lie between rows of their own speaker, or that the typed speaker supports, are settled.
    Adds resolved: bridge, ct_support or null; the speakers don't change."""
    near = nearest_known_speaker(rows, entity, pos)
    sp, ct = T.clean(F.col("speaker")), T.clean(F.col("speaker_ct"))
    bridge = (sp != "") & (F.col("prev_known") == sp) & (F.col("next_known") == sp)
    support = (sp != "") & (sp == ct)
    resolved = F.when(~F.coalesce("review_flag", F.lit(False)), F.lit(None)).when(bridge, "bridge").when(support, "ct_support")
    done = near.withColumn("resolved", resolved)
    hit = F.col("resolved").isNotNull()
    of = lambda k: F.create_map(*[F.lit(x) for name, v in RESOLVED.items() for x in (name, v[k])])[F.col("resolved")]
    new = {"review_flag": F.lit(False), "review_reason": F.lit(""), "speaker_confidence": F.lit("high"), "speaker_method": of(0), "alignment_score": F.greatest(F.col("alignment_score"), of(1)), "notes": T.append_note(F.col("notes"), of(2))}
    return done.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in new.items()}).drop("prev_known", "next_known")


def rollup(rows: DataFrame, season: str, file: str) -> DataFrame:
    """Counts for each file, each season and all: one pass by grouping sets; null stands for all."""
    n = lambda cond, name: F.count_if(cond).alias(name)
    blank = T.clean(F.col("speaker")) == ""
    return rows.rollup(season, file).agg(F.count("*").alias("n_rows"), n(blank, "blank_rows"), n(F.col("speaker_confidence") == "high", "high_rows"), n(F.col("speaker_confidence").isin(*WEAK), "weak_rows"), n(F.coalesce("review_flag", F.lit(False)), "review_rows"))


def summary(before: DataFrame, after: DataFrame, log: DataFrame, file: list[str]) -> DataFrame:
    """Of each file: rows, reviews before and after, corrections of each kind, settled reviews, rows still blank."""
    n = lambda cond, name: F.count_if(cond).alias(name)
    was = before.groupBy(*file).agg(n(F.coalesce("review_flag", F.lit(False)), "review_rows_before_qa"))
    now = after.groupBy(*file).agg(F.count("*").alias("rows"), n(F.coalesce("review_flag", F.lit(False)), "review_rows_after_qa"), n(F.col("resolved").isNotNull(), "review_rows_resolved"), n(T.clean(F.col("speaker")) == "", "remaining_unresolved_rows"))
    kinds = {"speaker_ct_overrides": "ct", "scene_bridge_fixes": "bridge", "scene_anomaly_fixes": "anomaly"}
    done = log.groupBy(*file).agg(*[n(F.col("new_method") == CORRECTIONS[k][0], name) for name, k in kinds.items()])
    whole = now.join(was, file, "left").join(done, file, "left").withColumns({name: F.coalesce(name, F.lit(0)) for name in kinds})
    return whole.select(*file, "rows", "review_rows_before_qa", "review_rows_after_qa", *kinds, "review_rows_resolved", "remaining_unresolved_rows")


def summary_rollup(files: DataFrame) -> DataFrame:
    """One row over all files."""
    counts = ("review_rows_before_qa", "review_rows_after_qa", "speaker_ct_overrides", "scene_bridge_fixes", "scene_anomaly_fixes", "review_rows_resolved", "remaining_unresolved_rows")
    return files.agg(F.count("*").alias("files_processed"), F.coalesce(F.sum("rows"), F.lit(0)).alias("total_rows"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counts])


def run_all(rows: DataFrame, entity: list[str], pos: str) -> tuple[DataFrame, list[DataFrame]]:
    """All corrections in order; the corrected rows (with resolved), and the change logs."""
    keys = [*(c for c in ("season",) if c in rows.columns), *entity, "scene_id", pos]
    one = ct_override(rows)
    ct = F.lit(CORRECTIONS["ct"][0])
    first = changes(one, keys, ct)
    a = apply_changes(one, ct, 1.0).drop("new_speaker", "qa_reason")
    two = stage(scene_corrections(a, entity, pos), "corrected")
    second = changes(two, keys, correction_method())
    b = apply_changes(two, correction_method(), 0.9).drop("new_speaker", "qa_reason", "fix")
    return resolve_reviews(b, entity, pos), [first, second]
