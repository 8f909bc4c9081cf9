"""Schemas of the canonical tables, as DDL."""

SENTENCES = "episode STRING, idx INT, text STRING, start_s DOUBLE, end_s DOUBLE, speaker STRING"
WORDS = "episode STRING, idx INT, word STRING, start_s DOUBLE, end_s DOUBLE, speaker STRING"
SHOTS = "episode STRING, shot_id INT, start_s DOUBLE, end_s DOUBLE"
DIALOGUES = "episode_root STRING, dialogue_idx INT, scene_idx INT, speaker_ct STRING, utterance_ct STRING, norm STRING"
SCENES = "scene_id INT, start_s DOUBLE, end_s DOUBLE, speakers ARRAY<STRING>, n_shots INT, n_utterances INT, utterance_indices ARRAY<INT>"
EDGES = "source STRING, target STRING, weight DOUBLE, adjacency DOUBLE, proximity DOUBLE, copresence DOUBLE"
SCENE_GRAPHS = f"scene_id INT, start_s DOUBLE, end_s DOUBLE, nodes ARRAY<STRING>, edges ARRAY<STRUCT<{EDGES.replace(' STRING', ': STRING').replace(' DOUBLE', ': DOUBLE')}>>"

#: Columns of the enhanced tables, in order; the two times come after the sentence number where they are kept.
ENHANCED_COLUMNS = (
    "scene_id sentence_id utterance speaker speaker_confidence speaker_method alignment_score row_type filled_from_missing matched_to_ct scene_speaker_set "
    "prev_speaker_scene next_speaker_scene review_flag review_reason notes utterance_ct speaker_ct speaker_original"
).split()
#: Columns of the aligned rows.
ALIGNED_COLUMNS = "start end shot_id scene_id speaker utterance speaker_ct utterance_ct scene_desc alignment_score speaker_confidence speaker_method".split()
