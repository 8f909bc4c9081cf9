"""SQL twins of the queries, for DuckDB over the same tables."""

from __future__ import annotations

S = "S AS (SELECT DISTINCT * EXCLUDE (loaded_at) FROM sentences)"
D = "D AS (SELECT DISTINCT * EXCLUDE (loaded_at) FROM dialogues)"
U = "U AS (SELECT DISTINCT * EXCLUDE (loaded_at) FROM utterances)"
H = "H AS (SELECT DISTINCT lower(trim(episode)) AS episode, shot_id, start_s, end_s FROM shots)"
TURNS = f"""{S}, T AS (SELECT episode, scene_id, row_number() OVER (PARTITION BY episode, scene_id ORDER BY start_s, sentence_id) AS pos, start_s,
    coalesce(end_s, start_s) AS end_s, trim(speaker) AS speaker FROM S WHERE scene_id IS NOT NULL AND trim(coalesce(speaker, '')) <> '' AND start_s IS NOT NULL)"""


def pairs(turns: str = "T") -> str:
    """Near pairs, nodes and scene edges over a relation of turns."""
    return f"""P AS (SELECT a.episode, a.scene_id, least(a.speaker, b.speaker) AS source, greatest(a.speaker, b.speaker) AS target, b.pos - a.pos AS distance
    FROM {turns} a JOIN {turns} b ON a.episode = b.episode AND a.scene_id = b.scene_id AND b.pos - a.pos BETWEEN 1 AND 3 AND a.speaker <> b.speaker),
N AS (SELECT DISTINCT episode, scene_id, speaker AS character FROM {turns}),
C AS (SELECT a.episode, a.scene_id, a.character AS source, b.character AS target FROM N a JOIN N b ON a.episode = b.episode AND a.scene_id = b.scene_id AND a.character < b.character),
M AS (SELECT episode, scene_id, source, target, sum(CASE WHEN distance = 1 THEN 1 ELSE 0 END) AS a, sum(CAST(6 / distance AS BIGINT)) AS p FROM P GROUP BY ALL),
E AS (SELECT C.episode, C.scene_id, C.source, C.target, round(1.0 * coalesce(a, 0) + 0.5 * coalesce(p, 0) / 6.0 + 0.25, 4) AS weight,
    CAST(coalesce(a, 0) AS DOUBLE) AS adjacency, round(coalesce(p, 0) / 6.0, 4) AS proximity, 1.0::DOUBLE AS copresence
    FROM C LEFT JOIN M USING (episode, scene_id, source, target)),
EE AS (SELECT episode, source, target, sum(CAST(round(weight * 10000) AS BIGINT)) / 10000 AS weight, sum(CAST(round(adjacency * 10000) AS BIGINT)) / 10000 AS adjacency,
    sum(CAST(round(proximity * 10000) AS BIGINT)) / 10000 AS proximity, sum(CAST(round(copresence * 10000) AS BIGINT)) / 10000 AS copresence FROM E GROUP BY ALL)"""


NET = f"WITH {TURNS}, {pairs()}"
#: Both ends of each scene edge, and of each episode edge.
BOTH = "B AS (SELECT episode, scene_id, source AS character, target AS other, weight FROM E UNION ALL SELECT episode, scene_id, target, source, weight FROM E)"
BOTH_E = "BE AS (SELECT episode, source AS character, target AS other, weight FROM EE UNION ALL SELECT episode, target, source, weight FROM EE)"
SHARE = """SH AS (SELECT episode, scene_id, character, coalesce(w, 0) AS w, sum(coalesce(w, 0)) OVER (PARTITION BY episode, scene_id) AS total
    FROM N LEFT JOIN (SELECT episode, scene_id, character, sum(CAST(round(weight * 10000) AS BIGINT)) AS w FROM B GROUP BY ALL) USING (episode, scene_id, character))"""
DEGREE = """DG AS (SELECT episode, scene_id, character, CASE WHEN n > 1 THEN coalesce(d, 0) / (n - 1) ELSE 0.0 END AS value FROM (SELECT *, count(*) OVER (PARTITION BY episode, scene_id) AS n FROM N)
    LEFT JOIN (SELECT episode, scene_id, character, count(*) AS d FROM B GROUP BY ALL) USING (episode, scene_id, character))"""
ENTROPY = "log2(sum(weight)) - sum(weight * log2(weight)) / sum(weight)"


def clean(x: str) -> str:
    return rf"coalesce(regexp_replace({x}, '^[\s\p{{Z}}\x1c-\x1f\x{{85}}]+|[\s\p{{Z}}\x1c-\x1f\x{{85}}]+$', '', 'g'), '')"


def norm(x: str) -> str:
    bare = rf"replace(replace(regexp_replace(lower({clean(x)}), '\([^)]*\)|\[[^\]]*\]', ' ', 'g'), '’', ''''), '`', '''')"
    return rf"trim(regexp_replace(regexp_replace({bare}, '[^a-z0-9''\s]', ' ', 'g'), '\s+', ' ', 'g'))"


def words(x: str) -> str:
    return rf"len(regexp_extract_all({clean(x)}, '[\p{{L}}\p{{N}}_]+'))"


def row_type(x: str) -> str:
    markers = ("theme song", "theme from", "i''ll be there for you", "if you ever need", "when the rain starts to pour", "your job''s a joke", "your love life''s doa")
    song = " OR ".join(f"contains(lower({clean(x)}), '{m}')" for m in markers)
    return rf"""CASE WHEN {clean(x)} = '' THEN 'empty' WHEN regexp_full_match({clean(x)}, '\[[^\n]*\]|\([^\n]*\)') THEN 'direction' WHEN {song} THEN 'song'
    WHEN regexp_full_match(lower({clean(x)}), '(la+|ha+|o+h+|ah+|uh+|um+|hmm+)[.!?]*') THEN 'reaction' ELSE 'dialogue' END"""


ROOT = r"CASE WHEN regexp_matches(lower(trim(episode)), '^.*s\d+e\d+[a-z]*$') THEN regexp_extract(lower(trim(episode)), '^(.*s\d+e\d+)[a-z]*$', 1) ELSE lower(trim(episode)) END"
MATCHED = f"""{S}, {D}, SN AS (SELECT *, {ROOT} AS root, {norm('utterance')} AS norm FROM S),
TY AS (SELECT episode_root AS root, scene_idx AS scene_id, {norm('utterance_ct')} AS norm, {clean('speaker_ct')} AS who, utterance_ct FROM D),
ONE AS (SELECT root, scene_id, norm, min(who) AS speaker_ct, min(utterance_ct) AS utterance_ct FROM TY WHERE norm <> '' AND who <> '' AND scene_id IS NOT NULL GROUP BY ALL HAVING min(who) = max(who)),
MS AS (SELECT SN.*, ONE.speaker_ct, ONE.utterance_ct FROM SN LEFT JOIN ONE USING (root, scene_id, norm))"""
OVERLAP = f"""{S}, {D}, X AS (SELECT {ROOT} AS root, scene_id, sent_id, sentence_id, list_distinct(list_filter(string_split({norm('utterance')}, ' '), lambda t: t <> '')) AS a FROM S WHERE scene_id IS NOT NULL),
Y AS (SELECT episode_root AS root, scene_idx AS scene_id, dialogue_id, dialogue_idx, list_distinct(list_filter(string_split({norm('utterance_ct')}, ' '), lambda t: t <> '')) AS b FROM D WHERE scene_idx IS NOT NULL),
O AS (SELECT X.root, X.scene_id, sent_id, dialogue_id, dialogue_idx, round(CASE WHEN least(len(a), len(b)) > 0 THEN len(list_intersect(a, b)) / least(len(a), len(b)) ELSE 0.0 END, 6) AS sim FROM X JOIN Y USING (root, scene_id))"""
FIRST_SHOT = """SELECT sent_id, shot_id FROM S LEFT JOIN (SELECT sent_id, arg_min(shot_id, (start_s, shot_id)) AS shot_id FROM (
    SELECT s.sent_id, h.shot_id, h.start_s FROM S s JOIN HL h ON s.episode = h.episode AND h.start_s <= s.start_s AND (s.start_s < h.end_s OR h.last AND s.start_s = h.end_s)) GROUP BY sent_id) USING (sent_id)"""
HL = "HL AS (SELECT *, row_number() OVER (PARTITION BY episode ORDER BY start_s DESC, end_s DESC, shot_id DESC) = 1 AS last FROM H WHERE start_s IS NOT NULL AND end_s IS NOT NULL AND end_s >= start_s)"
LINES = r"""LN AS (SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS line_no, unnest(string_split(text, chr(10))) AS line FROM documents WHERE doc_kind = 'excerpt' AND text IS NOT NULL),
LS AS (SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, """ + clean("line") + r""" AS l FROM LN),
LK AS (SELECT *, regexp_matches(l, '^\[.*\]$') AS br, regexp_matches(l, '^\(.*\)$') AS rd, lower(l) IN ('opening credits', 'closing credits') AS cr,
    regexp_extract(l, '^([^:]{1,80}):\s*(.+)$', 2) AS said FROM LS WHERE l <> ''),
EV AS (SELECT doc_id, line_no, l, br, rd, CASE WHEN NOT br AND NOT rd AND NOT cr AND said <> '' THEN 'dialogue' ELSE 'scene' END AS kind, said FROM LK),
PT AS (SELECT doc_id, line_no, kind, CAST(sum(CASE WHEN kind = 'scene' THEN 1 ELSE 0 END) OVER w + CASE WHEN first(kind) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) = 'dialogue' THEN 1 ELSE 0 END AS INTEGER) AS scene_idx,
    CASE WHEN kind = 'dialogue' THEN CAST(sum(CASE WHEN kind = 'dialogue' THEN 1 ELSE 0 END) OVER w - 1 AS INTEGER) END AS dialogue_idx,
    CASE WHEN kind = 'scene' THEN CASE WHEN br THEN regexp_replace(trim(substr(l, 2, length(l) - 2)), '^\s*(?i:scene)\s*:\s*', '') WHEN rd THEN trim(substr(l, 2, length(l) - 2)) ELSE l END END AS scene_desc,
    CASE WHEN kind = 'dialogue' THEN """ + clean("regexp_extract(l, '^([^:]{1,80}):', 1)") + " END AS speaker_ct, CASE WHEN kind = 'dialogue' THEN " + clean("said") + " END AS utterance_ct FROM EV WINDOW w AS (PARTITION BY doc_id ORDER BY line_no))"
RUNS = """R0 AS (SELECT sent_id, episode, sentence_id, scene_id, nullif(trim(speaker), '') AS k, CASE WHEN lag(scene_id) OVER w = scene_id THEN 0 ELSE 1 END AS f FROM S WINDOW w AS (PARTITION BY episode ORDER BY sentence_id)),
R AS (SELECT *, sum(f) OVER (PARTITION BY episode ORDER BY sentence_id) AS run FROM R0)"""
DIRECT = f"""{MATCHED}, DF AS (SELECT sent_id, season, episode, {clean('speaker')} AS was, coalesce(speaker_ct, '') AS ct, {row_type('utterance')} AS row_type FROM MS),
DD AS (SELECT *, was = '' AND ct <> '' AS direct, was <> '' AND was = ct AS agreed FROM DF),
RF AS (SELECT sent_id, season, episode, was, CASE WHEN direct THEN ct ELSE was END AS speaker, direct, row_type, direct OR agreed AS ok FROM DD),
RG AS (SELECT *, NOT ok AND row_type = 'direction' AS dir, NOT ok AND row_type <> 'direction' AND speaker = '' AS blank FROM RF),
RV AS (SELECT sent_id, season, episode, was, speaker, direct, CASE WHEN ok THEN 'community_transcript_match' WHEN dir THEN 'direction' WHEN blank THEN 'unresolved' ELSE '' END AS speaker_method,
    CASE WHEN ok OR dir THEN 'high' WHEN blank THEN 'low' ELSE '' END AS speaker_confidence, CASE WHEN ok THEN 1.0 WHEN dir THEN 0.95 ELSE 0.0 END AS alignment_score, blank AS review_flag,
    CASE WHEN blank THEN 'unresolved_no_reliable_inference' ELSE '' END AS review_reason FROM RG)"""
CHECKED = f"""{MATCHED}, CK AS (SELECT sent_id, episode, season, scene_id, sentence_id, utterance, {clean('speaker')} AS speaker, coalesce(speaker_ct, '') AS speaker_ct, speaker_confidence, speaker_method,
    coalesce(alignment_score, 0.0) AS alignment_score, coalesce(speaker_confidence IN ('low', 'none'), false) AS review_flag FROM MS)"""
OVERRIDE = "speaker <> '' AND speaker_ct <> '' AND speaker <> speaker_ct AND (coalesce(speaker_method, '') <> 'community_transcript_match' OR review_flag OR coalesce(speaker_confidence IN ('low', 'medium'), false))"

ORACLES: dict[str, str] = {
    "adjacency_counts": f"{NET} SELECT episode, scene_id, source, target, count(*) AS adjacency FROM P WHERE distance = 1 GROUP BY ALL",
    "proximity_scores": f"{NET} SELECT episode, scene_id, source, target, round(sum(CAST(6 / distance AS BIGINT)) / 6.0, 6) AS proximity FROM P GROUP BY ALL",
    "copresence_pairs": f"{NET} SELECT * FROM C",
    "scene_edges": f"{NET} SELECT * FROM E",
    "episode_edges": f"{NET} SELECT * FROM EE",
    "scene_bounds": f"WITH {TURNS} SELECT episode, scene_id, min(start_s) AS start_s, max(end_s) AS end_s, array_to_string(list_sort(list_distinct(list(speaker))), '|') AS nodes FROM T GROUP BY ALL",
    "episode_summary": f"WITH {TURNS} SELECT episode, min(start_s) AS start_s, max(end_s) AS end_s, count(DISTINCT scene_id) AS n_scenes, count(*) AS n_turns, count(DISTINCT speaker) AS n_speakers FROM T GROUP BY ALL",
    "event_edges": f"""WITH T AS (SELECT strftime(ts, '%Y-%m-%d') AS episode, hour(ts) AS scene_id, row_number() OVER (PARTITION BY strftime(ts, '%Y-%m-%d'), hour(ts) ORDER BY ts, event_id) AS pos, 'u' || user_id AS speaker FROM events), {pairs()} SELECT * FROM EE""",
    "lineitem_edges": f"""WITH T AS (SELECT 'orders' AS episode, l_orderkey AS scene_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey, 's' || l_suppkey, l_extendedprice) AS pos, 's' || l_suppkey AS speaker FROM lineitem), {pairs()}
SELECT source, target, sum(CAST(round(weight * 10000) AS BIGINT)) / 10000 AS weight, count(*) AS n_scenes FROM E GROUP BY ALL""",
    "scene_metrics": f"""{NET}, V AS (SELECT episode, scene_id, count(*) AS n_nodes FROM N GROUP BY ALL), W AS (SELECT episode, scene_id, max(end_s) - min(start_s) AS duration_s FROM T GROUP BY ALL),
G AS (SELECT episode, scene_id, count(*) AS n_edges, count_if(adjacency > 0 OR proximity > 0) AS n_interaction_edges, {ENTROPY} AS entropy FROM E GROUP BY ALL)
SELECT episode, scene_id, n_nodes, coalesce(n_edges, 0) AS n_edges, round(CASE WHEN n_nodes > 1 THEN 2.0 * coalesce(n_edges, 0) / (n_nodes * (n_nodes - 1)) ELSE 0 END, 6) AS density, round(duration_s, 6) AS duration_s,
    coalesce(n_interaction_edges, 0) AS n_interaction_edges, round(CASE WHEN n_nodes > 1 THEN 2.0 * coalesce(n_interaction_edges, 0) / (n_nodes * (n_nodes - 1)) ELSE 0 END, 6) AS interaction_density, round(coalesce(entropy, 0), 6) AS entropy
FROM V JOIN W USING (episode, scene_id) LEFT JOIN G USING (episode, scene_id)""",
    "interaction_entropy": f"{NET} SELECT episode, round({ENTROPY}, 6) AS entropy FROM EE GROUP BY ALL",
    "graph_density": f"""{NET}, V AS (SELECT episode, scene_id, count(*) AS n_nodes FROM N GROUP BY ALL), G AS (SELECT episode, scene_id, count(*) AS n_edges FROM E GROUP BY ALL)
SELECT episode, scene_id, n_nodes, coalesce(n_edges, 0) AS n_edges, round(CASE WHEN n_nodes > 1 THEN 2.0 * coalesce(n_edges, 0) / (n_nodes * (n_nodes - 1)) ELSE 0 END, 6) AS density FROM V LEFT JOIN G USING (episode, scene_id)""",
    "edge_birth_death": f"{NET} SELECT episode, source, target, min(scene_id) AS first_scene, max(scene_id) AS last_scene, count(*) AS n_scenes FROM E GROUP BY ALL",
    "degree_strength_share": f"{NET}, {BOTH}, {SHARE} SELECT episode, scene_id, character, round(CASE WHEN total > 0 THEN w / total ELSE 0.0 END, 6) AS value FROM SH",
    "degree_unweighted": f"{NET}, {BOTH}, {DEGREE} SELECT episode, scene_id, character, round(value, 6) AS value FROM DG",
    "dominant_character": f"{NET}, {BOTH}, {DEGREE} SELECT episode, scene_id, character, round(value, 6) AS value FROM (SELECT *, row_number() OVER (PARTITION BY episode, scene_id ORDER BY value DESC, character) AS r FROM DG) WHERE r = 1",
    "interaction_matrix": f"{NET}, {BOTH_E} SELECT episode, character AS row, other AS col, weight FROM BE",
    "centrality_ranking": f"""{NET}, {BOTH_E}, CA AS (SELECT DISTINCT episode, character FROM N), Q AS (SELECT episode, character, coalesce(w, 0) AS w, sum(coalesce(w, 0)) OVER (PARTITION BY episode) AS total FROM CA
    LEFT JOIN (SELECT episode, character, sum(CAST(round(weight * 10000) AS BIGINT)) AS w FROM BE GROUP BY ALL) USING (episode, character)), QV AS (SELECT episode, character, CASE WHEN total > 0 THEN w / total ELSE 0.0 END AS value FROM Q)
SELECT episode, character, round(value, 6) AS value, rank FROM (SELECT *, row_number() OVER (PARTITION BY episode ORDER BY value DESC, character) AS rank FROM QV) WHERE rank <= 10""",
    "centrality_timeseries": f"""{NET}, {BOTH}, {SHARE}, {DEGREE} SELECT episode, scene_id, 'degree' AS measure, character, round(CASE WHEN total > 0 THEN w / total ELSE 0.0 END, 6) AS value FROM SH
UNION ALL SELECT episode, scene_id, 'degree_unweighted', character, round(value, 6) FROM DG""",
    "connected_components": f"""WITH RECURSIVE {TURNS}, {pairs()}, {BOTH_E}, CA AS (SELECT DISTINCT episode, character FROM N), REACH AS (SELECT episode, character, character AS other FROM CA UNION SELECT r.episode, r.character, b.other FROM REACH r JOIN BE b ON r.episode = b.episode AND r.other = b.character)
SELECT episode, character, min(other) AS component FROM REACH GROUP BY ALL""",
    "word_sessionization": f"""WITH {U}, A AS (SELECT *, coalesce(end_s, start_s) AS e FROM U), B AS (SELECT *, CASE WHEN row_number() OVER w = 1 OR lag(speaker) OVER w IS DISTINCT FROM speaker OR coalesce(start_s - lag(e) OVER w >= 0.5, false) THEN 1 ELSE 0 END AS f FROM A WINDOW w AS (PARTITION BY episode ORDER BY idx)),
G AS (SELECT *, CAST(sum(f) OVER (PARTITION BY episode ORDER BY idx) AS BIGINT) AS g FROM B)
SELECT episode, g AS idx, any_value(speaker) AS speaker, arg_min(start_s, idx) AS start_s, arg_max(e, idx) AS end_s, count(*) AS n_words, coalesce(string_agg(text, ' ' ORDER BY idx), '') AS text FROM G GROUP BY episode, g""",
    "event_sessions": """WITH B AS (SELECT *, CASE WHEN coalesce(epoch_us(ts) - lag(epoch_us(ts)) OVER w < 14400000000, false) THEN 0 ELSE 1 END AS f FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
G AS (SELECT *, CAST(sum(f) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS session FROM B) SELECT user_id, session, count(*) AS n_events, min(ts) AS start_ts, max(ts) AS end_ts FROM G GROUP BY ALL""",
    "estimate_end_times": f"WITH {U} SELECT utt_id, episode, idx, start_s, CASE WHEN end_s IS NULL OR end_s <= start_s THEN greatest(start_s + 0.5, lead(start_s) OVER (PARTITION BY episode ORDER BY start_s, idx)) ELSE end_s END AS end_s FROM U",
    "fill_scene_ids": f"WITH {S} SELECT sent_id, episode, sentence_id, CAST(coalesce(last_value(scene_id IGNORE NULLS) OVER (PARTITION BY episode ORDER BY sentence_id), 1) AS INTEGER) AS scene_id FROM S",
    "scene_ids_from_markers": f"""WITH {LINES}, NU AS (SELECT doc_id, line_no, kind, sum(CASE WHEN kind = 'scene' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS n, max(CASE WHEN kind = 'scene' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id) AS any_ FROM EV)
SELECT doc_id, line_no, kind, CASE WHEN any_ = 1 THEN CAST(greatest(n, 1) AS INTEGER) END AS scene_id FROM NU""",
    "scene_marker_rows": f"""WITH {S}, A AS (SELECT episode, sentence_id, CAST(CAST(scene_id AS INTEGER) AS VARCHAR) AS scene, last_value(CAST(CAST(scene_id AS INTEGER) AS VARCHAR) IGNORE NULLS) OVER (PARTITION BY episode ORDER BY sentence_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS was FROM S)
SELECT episode, sentence_id, scene, false AS is_marker FROM A UNION ALL SELECT episode, sentence_id, scene, true FROM A WHERE scene IS NOT NULL AND scene IS DISTINCT FROM was""",
    "prev_next_speaker": f"""WITH {S} SELECT sent_id, CASE WHEN lag(scene_id) OVER w = scene_id THEN coalesce(trim(lag(speaker) OVER w), '') ELSE '' END AS prev_speaker_scene,
    CASE WHEN lead(scene_id) OVER w = scene_id THEN coalesce(trim(lead(speaker) OVER w), '') ELSE '' END AS next_speaker_scene FROM S WINDOW w AS (PARTITION BY episode ORDER BY sentence_id)""",
    "nearest_known_speaker": f"""WITH {S}, {RUNS} SELECT sent_id, coalesce(last_value(k IGNORE NULLS) OVER (PARTITION BY episode, run ORDER BY sentence_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS prev_known,
    coalesce(first_value(k IGNORE NULLS) OVER (PARTITION BY episode, run ORDER BY sentence_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS next_known FROM R""",
    "review_queue_context": f"""WITH {S} SELECT sent_id, episode, sentence_id, speaker_confidence FROM (SELECT *, max(CASE WHEN speaker_confidence IN ('low', 'unresolved') THEN 1 ELSE 0 END) OVER (PARTITION BY episode ORDER BY sentence_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS k FROM S) WHERE k = 1""",
    "scene_by_dialogue": f"""WITH {LINES} SELECT doc_id, dialogue_idx, coalesce(scene, '') AS scene FROM (SELECT *, last_value(scene_desc IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no) AS scene FROM PT) WHERE kind = 'dialogue'""",
    "interval_join_shot": f"WITH {S}, {H}, {HL} {FIRST_SHOT}",
    "asof_shot": f"WITH {S}, HH AS (SELECT DISTINCT lower(trim(episode)) AS episode, shot_id, start_s FROM shots WHERE start_s IS NOT NULL) SELECT s.sent_id, h.shot_id, h.start_s AS shot_start_s FROM S s ASOF LEFT JOIN HH h ON s.episode = h.episode AND s.start_s >= h.start_s WHERE s.start_s IS NOT NULL",
    "unique_group_propagation": f"""WITH {MATCHED}, G AS (SELECT episode, norm, min(speaker_ct) AS lo FROM MS WHERE trim(coalesce(speaker_ct, '')) <> '' GROUP BY ALL HAVING min(speaker_ct) = max(speaker_ct))
SELECT sent_id, CASE WHEN nullif(trim(speaker_ct), '') IS NULL AND lo IS NOT NULL THEN lo ELSE nullif(trim(speaker_ct), '') END AS speaker_ct, CASE WHEN nullif(trim(speaker_ct), '') IS NULL AND lo IS NOT NULL THEN 'dialogue_propagation' END AS fill_method FROM MS LEFT JOIN G USING (episode, norm)""",
    "scene_summary": f"""WITH {S}, {H}, {HL}, K AS (SELECT episode, scene_id, sent_id, start_s, coalesce(end_s, start_s) AS end_s FROM S WHERE scene_id IS NOT NULL AND start_s IS NOT NULL), X AS (SELECT episode, scene_id, sent_id, start_s AS t FROM K UNION SELECT episode, scene_id, sent_id, end_s FROM K),
F AS (SELECT x.episode, x.scene_id, x.sent_id, x.t, arg_min(h.shot_id, (h.start_s, h.shot_id)) AS shot_id FROM X x JOIN HL h ON x.episode = h.episode AND h.start_s <= x.t AND (x.t < h.end_s OR h.last AND x.t = h.end_s) GROUP BY ALL),
L AS (SELECT episode, scene_id, array_to_string(list_sort(list_distinct(list(shot_id))), ',') AS shot_ids FROM F GROUP BY ALL)
SELECT K.episode, K.scene_id, min(start_s) AS start_s, max(end_s) AS end_s, count(*) AS n_rows, coalesce(any_value(shot_ids), '') AS shot_ids FROM K LEFT JOIN L USING (episode, scene_id) GROUP BY K.episode, K.scene_id""",
    "scenes_from_rows": f"""WITH {S}, {H}, {HL}, A AS ({FIRST_SHOT}), K AS (SELECT S.*, A.shot_id, nullif(trim(speaker), '') AS k FROM S JOIN A USING (sent_id) WHERE scene_id IS NOT NULL AND start_s IS NOT NULL),
FS AS (SELECT episode, scene_id, k, min(sentence_id) AS f FROM K WHERE k IS NOT NULL GROUP BY ALL), SP AS (SELECT episode, scene_id, string_agg(k, '|' ORDER BY f) AS speakers FROM FS GROUP BY ALL)
SELECT K.episode, K.scene_id, min(start_s) AS start_s, max(coalesce(end_s, start_s)) AS end_s, coalesce(any_value(speakers), '') AS speakers, count(DISTINCT shot_id) AS n_shots, count(*) AS n_utterances, string_agg(CAST(sentence_id AS VARCHAR), ',' ORDER BY sentence_id) AS utterance_indices
FROM K LEFT JOIN SP USING (episode, scene_id) GROUP BY K.episode, K.scene_id""",
    "similarity_matrix_topk": f"WITH {OVERLAP} SELECT sent_id, dialogue_id, sim, rank FROM (SELECT *, row_number() OVER (PARTITION BY sent_id ORDER BY sim DESC, dialogue_id) AS rank FROM O) WHERE rank <= 2",
    "sliding_window_best": f"""WITH {OVERLAP}, PL AS (SELECT *, row_number() OVER (PARTITION BY root, scene_id ORDER BY dialogue_idx, dialogue_id) - 1 AS j, count(*) OVER (PARTITION BY root, scene_id) AS n FROM (SELECT DISTINCT root, scene_id, dialogue_id, dialogue_idx FROM O)),
Q AS (SELECT O.root, O.scene_id, sent_id, j, n, max(sim) OVER (PARTITION BY O.root, O.scene_id, sent_id ORDER BY j ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS best FROM O JOIN PL USING (root, scene_id, dialogue_id)),
SC AS (SELECT root, scene_id, j, n, floor(sum(CAST(round(best * 1000000.0) AS BIGINT)) / count(*)) / 1000000.0 AS score FROM Q WHERE j <= greatest(0, n - 5) GROUP BY ALL)
SELECT root, scene_id, j AS start_idx, least(j + 5, n) AS end_idx, score FROM (SELECT *, row_number() OVER (PARTITION BY root, scene_id ORDER BY score DESC, j) AS r FROM SC) WHERE r = 1""",
    "normalize_text_rule": f"WITH {S} SELECT sent_id, {norm('utterance')} AS norm FROM S",
    "word_count": f"WITH {S} SELECT sent_id, {words('utterance')} AS n_words FROM S",
    "classify_row_type": f"WITH {U} SELECT utt_id, {row_type('text')} AS row_type FROM U",
    "name_mentions": f"""WITH {S}, CA AS (SELECT episode, list_sort(list_distinct(list(string_split(canonical_name, ' ')[1]))) AS names FROM speaker_map GROUP BY ALL),
ME AS (SELECT sent_id, list_filter(names, lambda n: contains(' ' || norm || ' ', ' ' || lower(n) || ' ')) AS m FROM (SELECT *, {norm('utterance')} AS norm FROM S) JOIN CA USING (episode)) SELECT sent_id, array_to_string(m, '|') AS mentions FROM ME WHERE len(m) > 0""",
    "confidence_bucket": f"""WITH {S} SELECT sent_id, CASE WHEN NOT coalesce(alignment_score >= 0.52, false) THEN 'unresolved' WHEN alignment_score >= 0.85 THEN 'high' WHEN alignment_score >= 0.60 THEN 'medium' ELSE 'low' END AS confidence,
    CASE WHEN NOT coalesce(alignment_score >= 0.52, false) THEN 'none' WHEN alignment_score >= 0.85 THEN 'exact_align' ELSE 'fuzzy_align' END AS method FROM S""",
    "episode_key_parse": rf"""SELECT episode, {ROOT} AS root, CASE WHEN regexp_matches(lower(episode), '(?:^|_)s?0*(\d+)(?:e\d+[a-z]*)?$') THEN 's' || regexp_extract(lower(episode), '(?:^|_)s?0*(\d+)(?:e\d+[a-z]*)?$', 1) END AS season,
    nullif(regexp_extract(lower(trim(episode)), '^(.*?)_s\d', 1), '') AS series FROM (SELECT DISTINCT episode FROM shots)""",
    "append_note": f"""WITH {S} SELECT sent_id, CASE WHEN {clean('speaker_method')} = '' THEN speaker_confidence WHEN contains({clean('speaker_method')}, speaker_confidence) THEN {clean('speaker_method')} ELSE {clean('speaker_method')} || ' | ' || speaker_confidence END AS notes FROM S""",
    "token_overlap_similarity": f"WITH {OVERLAP} SELECT sent_id, dialogue_id, sim FROM O",
    "parse_transcript": f"WITH {LINES} SELECT doc_id, line_no, kind, scene_idx, dialogue_idx, scene_desc, speaker_ct, utterance_ct FROM PT",
    "direct_ct_fill": f"""WITH {DIRECT} SELECT sent_id, CASE WHEN direct THEN ct ELSE was END AS speaker, was AS speaker_original, row_type, ct <> '' AS matched_to_ct, direct AS filled_from_missing, CASE WHEN direct OR agreed THEN 'community_transcript_match' ELSE '' END AS speaker_method,
    CASE WHEN direct OR agreed THEN 'high' ELSE '' END AS speaker_confidence, CASE WHEN direct OR agreed THEN 1.0 ELSE 0.0 END AS alignment_score,
    CASE WHEN direct THEN 'Speaker copied from available community-transcript mapping.' WHEN agreed THEN 'Speaker agrees with available community-transcript mapping.' ELSE '' END AS notes FROM DD""",
    "review_flagging": f"WITH {DIRECT} SELECT sent_id, speaker_method, speaker_confidence, alignment_score, review_flag, review_reason FROM RV",
    "fill_summary": f"""WITH {DIRECT} SELECT season, episode, count(*) AS n_rows, count_if(was = '') AS original_missing_speaker_rows, count_if(direct) AS filled_rows, count_if(review_flag) AS review_rows, count_if(speaker = '') AS unresolved_rows,
    count_if(speaker_confidence = 'high') AS high_confidence_rows, count_if(speaker_confidence = 'medium') AS medium_confidence_rows, count_if(speaker_confidence = 'low') AS low_confidence_rows FROM RV GROUP BY ALL""",
    "scene_majority": f"""WITH {S}, K AS (SELECT episode, scene_id, trim(speaker) AS speaker, count(*) AS n, min(sentence_id) AS f FROM S WHERE scene_id IS NOT NULL AND trim(coalesce(speaker, '')) <> '' GROUP BY ALL)
SELECT episode, scene_id, speaker, n FROM (SELECT *, row_number() OVER (PARTITION BY episode, scene_id ORDER BY n DESC, f) AS r FROM K) WHERE r = 1""",
    "scene_speaker_set": f"""WITH {S}, K AS (SELECT episode, scene_id, trim(speaker) AS speaker, min(sentence_id) AS f FROM S WHERE scene_id IS NOT NULL AND trim(coalesce(speaker, '')) <> '' GROUP BY ALL) SELECT episode, scene_id, string_agg(speaker, ' | ' ORDER BY f) AS scene_speaker_set FROM K GROUP BY ALL""",
    "scene_anomalies": f"WITH {S} SELECT episode, scene_id, trim(speaker) AS speaker FROM S WHERE scene_id IS NOT NULL AND trim(coalesce(speaker, '')) <> '' GROUP BY episode, scene_id, trim(speaker) HAVING count(*) = 1",
    "qa_ct_override": f"WITH {CHECKED} SELECT sent_id, speaker_ct AS new_speaker, 'speaker_ct mismatch override' AS qa_reason FROM CK WHERE {OVERRIDE}",
    "qa_changes": f"WITH {CHECKED} SELECT sent_id, episode, scene_id, sentence_id, {clean('utterance')} AS utterance, speaker AS old_speaker, speaker_ct AS new_speaker, coalesce(speaker_method, '') AS old_method, 'qa_speaker_ct_override' AS new_method, 'speaker_ct mismatch override' AS qa_reason, speaker_ct FROM CK WHERE {OVERRIDE}",
    "qa_review_resolution": f"""WITH {CHECKED}, R0 AS (SELECT *, CASE WHEN row_number() OVER w > 1 AND lag(scene_id) OVER w = scene_id THEN 0 ELSE 1 END AS f FROM CK WINDOW w AS (PARTITION BY episode ORDER BY sentence_id)), R AS (SELECT *, sum(f) OVER (PARTITION BY episode ORDER BY sentence_id) AS run, nullif(trim(speaker), '') AS k FROM R0),
Z AS (SELECT *, last_value(k IGNORE NULLS) OVER (PARTITION BY episode, run ORDER BY sentence_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p, first_value(k IGNORE NULLS) OVER (PARTITION BY episode, run ORDER BY sentence_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS n FROM R),
Q AS (SELECT *, CASE WHEN NOT review_flag THEN NULL WHEN speaker <> '' AND p = speaker AND n = speaker THEN 'bridge' WHEN speaker <> '' AND speaker = speaker_ct THEN 'ct_support' END AS resolved FROM Z)
SELECT sent_id, resolved, 'high' AS speaker_confidence, 'qa_review_resolved_' || resolved AS speaker_method, CASE WHEN resolved = 'bridge' THEN greatest(alignment_score, 0.9) ELSE greatest(alignment_score, 1.0) END AS alignment_score FROM Q WHERE resolved IS NOT NULL""",
    "qa_rollup": f"""WITH {CHECKED} SELECT season, episode, count(*) AS n_rows, count_if(speaker = '') AS blank_rows, count_if(speaker_confidence = 'high') AS high_rows, count_if(speaker_confidence IN ('low', 'medium')) AS weak_rows, count_if(review_flag) AS review_rows FROM CK GROUP BY ROLLUP (season, episode)""",
}

SPACE = r"[\s\p{Z}\x1c-\x1f\x{85}]+"
ORACLES["title_case_speaker"] = f"""WITH {U} SELECT utt_id, CASE WHEN speaker IS NOT NULL THEN array_to_string(list_transform(regexp_extract_all({clean('speaker')}, '\\p{{L}}+|\\P{{L}}+'), lambda x: upper(x[1:1]) || lower(x[2:])), '') END AS speaker FROM U"""
ORACLES["split_chunks"] = rf"""WITH {D}, CH AS (SELECT dialogue_id, list_filter(list_transform(string_split_regex(replace(regexp_replace(coalesce(utterance_ct, ''), '\([^)]*\)|\[[^\]]*\]', ' ', 'g'), '...', '. '), '[.!?;]+'),
    lambda p: regexp_replace(trim(regexp_replace(p, '{SPACE}', ' ', 'g')), '^[ ,:\-]+|[ ,:\-]+$', '', 'g')), lambda p: {norm('p')} <> '') AS ps FROM D)
SELECT dialogue_id, unnest(range(len(ps))) AS pos, unnest(ps) AS raw, unnest(list_transform(ps, lambda p: {norm('p')})) AS norm FROM CH"""
ORACLES["interval_join_words"] = f"""WITH {S}, {U}, WS AS (SELECT episode, idx, start_s, coalesce(end_s, start_s) AS end_s, max(start_s) OVER (PARTITION BY episode ORDER BY idx) AS m FROM U WHERE start_s IS NOT NULL),
SK AS (SELECT episode, sentence_id, start_s AS a, coalesce(end_s, start_s) AS b, row_number() OVER (PARTITION BY episode ORDER BY sentence_id) AS k, count(*) OVER (PARTITION BY episode) AS n FROM S WHERE start_s IS NOT NULL),
SM AS (SELECT *, max(b) OVER (PARTITION BY episode ORDER BY k) AS pm FROM SK),
PT AS (SELECT w.episode, w.idx, w.start_s, w.end_s, least(any_value(s.n), 1 + count_if(s.pm + 1e-3 < w.m)) AS p FROM WS w JOIN SM s USING (episode) GROUP BY w.episode, w.idx, w.start_s, w.end_s),
CD AS (SELECT PT.episode, PT.idx, s.sentence_id, c.o, s.a - 1e-3 <= PT.start_s AND PT.start_s <= s.b + 1e-3 AS holds, least(PT.end_s, s.b) - greatest(PT.start_s, s.a) AS ov
    FROM PT JOIN (VALUES (0, 0), (1, -1), (2, 1)) c(o, d) ON true JOIN SM s ON s.episode = PT.episode AND s.k = PT.p + c.d),
BE AS (SELECT *, row_number() OVER (PARTITION BY episode, idx ORDER BY CASE WHEN holds THEN 0 ELSE 1 END, CASE WHEN holds THEN 0 ELSE -ov END, o) AS r FROM CD WHERE holds OR ov > -1.0)
SELECT U.episode, U.idx, BE.sentence_id AS sentence_idx FROM U LEFT JOIN BE ON BE.episode = U.episode AND BE.idx = U.idx AND BE.r = 1"""
