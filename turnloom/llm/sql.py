"""SQL twins of the pN queries, for DuckDB."""

RUNS = r"""
WITH once AS (SELECT DISTINCT episode, sentence_id, scene_id, speaker, start_s, end_s FROM sentences WHERE episode IS NOT NULL AND sentence_id IS NOT NULL),
keyed AS (SELECT *, nullif(regexp_replace(lower(regexp_replace(speaker, '\([^)]*\)|\[[^\]]*\]|\{[^}]*\}|<[^>]*>', ' ', 'g')), '[^\p{L}\p{N}\p{M}]', '', 'g'), '') AS k FROM once),
flagged AS (SELECT *, CASE WHEN k IS NOT NULL AND scene_id IS NOT NULL
    AND k = lag(k) OVER w AND scene_id = lag(scene_id) OVER w THEN 0 ELSE 1 END AS f FROM keyed WINDOW w AS (PARTITION BY episode ORDER BY sentence_id)),
numbered AS (SELECT *, sum(f) OVER (PARTITION BY episode ORDER BY sentence_id) AS run FROM flagged)
SELECT episode, CAST(scene_id AS INTEGER) AS scene_id, k AS speaker_key, min(sentence_id) AS first_sentence_id, max(sentence_id) AS last_sentence_id,
    count(*) AS n_events, min(start_s) AS start_s, max(end_s) AS end_s, round(max(end_s) - min(start_s), 3) AS duration_s
FROM numbered WHERE k IS NOT NULL AND scene_id IS NOT NULL GROUP BY episode, scene_id, k, run
"""

NEAREST = """
WITH s AS (SELECT DISTINCT lower(trim(episode)) AS episode, sent_id, start_s AS t FROM sentences WHERE start_s IS NOT NULL),
h AS (SELECT DISTINCT lower(trim(episode)) AS episode, shot_id, start_s AS u FROM shots WHERE start_s IS NOT NULL),
b AS (SELECT s.*, h.shot_id, h.u FROM s ASOF LEFT JOIN h ON s.episode = h.episode AND s.t >= h.u),
a AS (SELECT s.sent_id, h.shot_id, h.u FROM s ASOF LEFT JOIN h ON s.episode = h.episode AND s.t <= h.u),
both_ AS (SELECT b.episode, b.sent_id, b.t, b.shot_id AS p, b.u AS pu, a.shot_id AS n, a.u AS nu FROM b JOIN a USING (sent_id)),
picked AS (SELECT episode, sent_id, CASE WHEN pu IS NOT NULL AND (nu IS NULL OR t - pu <= nu - t) THEN p ELSE n END AS shot_id,
    CASE WHEN pu IS NOT NULL AND (nu IS NULL OR t - pu <= nu - t) THEN t - pu ELSE nu - t END AS gap FROM both_)
SELECT episode, sent_id, shot_id, round(gap, 3) AS gap_s FROM picked WHERE gap <= 1.5
"""

ORACLES = {
    "p1_runs": RUNS,
    "p1_found": f"SELECT episode, scene_id, first_sentence_id, last_sentence_id FROM ({RUNS}) WHERE n_events >= 2",
    "p5_nearest": NEAREST,
    "p5_found": f"SELECT shot_id, sent_id FROM ({NEAREST})",
}
