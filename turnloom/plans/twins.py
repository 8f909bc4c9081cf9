"""SQL twins, for DuckDB, of what needs composition, subsequences, alignment, ordered folds or whole graphs.

Folds are recursive queries that carry lists, one row for each group, and take one step of all groups at a time.
"""

from __future__ import annotations

import unicodedata

from turnloom.operators import align, impute, qa
from turnloom.plans import oracles as O


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def nfkc(x: str) -> str:
    """Compatibility composition: characters with a mapping of one character by one translation, those with a longer one
    in the blocks that typed text has by replacement, then canonical composition."""
    single, longer = [], []
    for code in range(0x80, 0x20000):
        ch = chr(code)
        if not unicodedata.decomposition(ch).startswith("<"):
            continue
        plain = unicodedata.normalize("NFKC", ch)
        if len(plain) == 1:
            single.append((ch, plain))
        elif code < 0x250 or 0x2000 <= code < 0x2150 or 0xFB00 <= code < 0xFB07:
            longer.append((ch, plain))
    out = f"translate({x}, {_quoted(''.join(a for a, _ in single))}, {_quoted(''.join(b for _, b in single))})"
    for a, b in longer:
        out = f"replace({out}, {_quoted(a)}, {_quoted(b)})"
    return f"CASE WHEN regexp_full_match({x}, '[\\x00-\\x7f]*') THEN {x} ELSE nfc_normalize({out}) END"


def quotes(x: str) -> str:
    return f"translate({x}, {_quoted('’‘“”')}, {_quoted(chr(39) * 2 + chr(34) * 2)})"


def match_form(x: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(regexp_replace(lower({x}), '\([^)]*\)|\[[^\]]*\]', ' ', 'g'), '[^a-z0-9'' ]', ' ', 'g'), ' +', ' ', 'g'))"


def match_norm(x: str) -> str:
    return f"coalesce({match_form(quotes(nfkc(x)))}, '')"


def who_norm(x: str) -> str:
    return rf"coalesce(trim(regexp_replace(regexp_replace(lower({quotes(nfkc(x))}), '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g')), '')"


# Common subsequences: a string of the shorter text's places in words of 60 bits, one step for each character of the longer.
BITS, N_WORDS = 60, 6
FULL = f"(1::BIGINT << {BITS}) - 1"


def _lcs_step() -> str:
    out, carry = [], "0::BIGINT"
    for i in range(1, N_WORDS + 1):
        added = f"(r[{i}] + (r[{i}] & m[{i}]) + {carry})"
        out.append(f"(({added} | (r[{i}] - (r[{i}] & m[{i}]))) & ({FULL}))")
        carry = f"({added} >> {BITS})"
    return f"[{', '.join(out)}]"


def similarities(pairs: str, out: str) -> str:
    """CTEs up to ``out``(a, b, sim) with the similarity of each distinct pair of texts in ``pairs``(a, b) of which neither is empty."""
    masks = ", ".join(f"coalesce(bit_or(CASE WHEN (i - 1) // {BITS} = {w} THEN 1::BIGINT << ((i - 1) % {BITS}) END), 0::BIGINT)" for w in range(N_WORDS))
    none, full = ", ".join(["0::BIGINT"] * N_WORDS), ", ".join([FULL] * N_WORDS)
    split = lambda c: f"list_sort(list_distinct(list_filter(string_split({c}, ' '), lambda t: t <> '')))"
    return f"""{out}0 AS (SELECT DISTINCT a, b FROM {pairs} WHERE a <> '' AND b <> ''),
{out}1 AS (SELECT a, b, {split('a')} AS x, {split('b')} AS y FROM {out}0),
{out}2 AS (SELECT *, list_filter(x, lambda t: list_contains(y, t)) AS c FROM {out}1),
{out}3 AS (SELECT *, array_to_string(c, ' ') AS s, array_to_string(list_filter(x, lambda t: NOT list_contains(c, t)), ' ') AS ra, array_to_string(list_filter(y, lambda t: NOT list_contains(c, t)), ' ') AS rb FROM {out}2),
{out}4 AS (SELECT *, trim(s || ' ' || ra) AS wa, trim(s || ' ' || rb) AS wb FROM {out}3),
{out}5 AS (SELECT DISTINCT CASE WHEN length(p) <= length(q) THEN p ELSE q END AS u, CASE WHEN length(p) <= length(q) THEN q ELSE p END AS v FROM (SELECT a AS p, b AS q FROM {out}4 UNION ALL SELECT wa, wb FROM {out}4)),
{out}6 AS (SELECT u, unnest(string_split(u, '')) AS ch, generate_subscripts(string_split(u, ''), 1) AS i FROM (SELECT DISTINCT u FROM {out}5)),
{out}7 AS (SELECT u, map_from_entries(list((ch, m))) AS mp FROM (SELECT u, ch, [{masks}] AS m FROM {out}6 GROUP BY u, ch) GROUP BY u),
{out}8 AS (SELECT u, v, list_reduce(list_transform(string_split(v, ''), lambda ch: coalesce(mp[ch], [{none}])), lambda r, m: {_lcs_step()}, [{full}]) AS r FROM {out}5 JOIN {out}7 USING (u)),
{out}9 AS (SELECT u, v, 2.0::DOUBLE * (length(u) - list_sum(list_transform(range(length(u)), lambda i: (r[1 + i // {BITS}] >> (i % {BITS})) & 1))) / (length(u) + length(v)) AS q FROM {out}8),
{out} AS (SELECT a, b, 0.65::DOUBLE * (0.7::DOUBLE * k.q + 0.3::DOUBLE * CASE WHEN s <> '' AND (ra = '' OR rb = '') THEN 1.0::DOUBLE WHEN s <> '' THEN
    greatest(t.q, 2.0::DOUBLE * length(s) / (length(s) + length(wa)), 2.0::DOUBLE * length(s) / (length(s) + length(wb))) ELSE t.q END) + 0.35::DOUBLE * (len(c) / least(len(x), len(y))) AS sim
    FROM {out}4 z JOIN {out}9 k ON k.u = CASE WHEN length(a) <= length(b) THEN a ELSE b END AND k.v = CASE WHEN length(a) <= length(b) THEN b ELSE a END
    JOIN {out}9 t ON t.u = CASE WHEN length(wa) <= length(wb) THEN wa ELSE wb END AND t.v = CASE WHEN length(wa) <= length(wb) THEN wb ELSE wa END)"""


def _scened(entity: str, pos: str, scene: str) -> str:
    return f"""coalesce(last_value({scene} IGNORE NULLS) OVER (PARTITION BY {entity} ORDER BY {pos} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
    first_value({scene} IGNORE NULLS) OVER (PARTITION BY {entity} ORDER BY {pos} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 1)"""


INPUTS = f"""{O.S}, {O.D},
A0 AS (SELECT {O.ROOT} AS root, episode, {_scened('episode', 'sentence_id', 'scene_id')} AS scene_id, sent_id AS idx, sentence_id, utterance, start_s, end_s, speaker FROM S),
A1 AS (SELECT *, {match_norm('utterance')} AS norm, {who_norm('speaker')} AS who, row_number() OVER (PARTITION BY root, scene_id ORDER BY idx) AS i FROM A0),
B0 AS (SELECT episode_root AS root, {_scened('episode_root', 'dialogue_idx', 'scene_idx')} AS scene_id, dialogue_id AS idx, speaker_ct, utterance_ct FROM D),
B1 AS (SELECT *, {match_norm('utterance_ct')} AS norm, {who_norm('speaker_ct')} AS who, row_number() OVER (PARTITION BY root, scene_id ORDER BY idx) AS j FROM B0)"""


def aligned(speakers: bool = False) -> str:
    """CTEs up to AL(root, scene_id, sent_idx, dialogue_idx, sim), for a WITH RECURSIVE."""
    bonus = f"CASE WHEN x.who <> '' AND x.who = y.who THEN {align.SAME_SPEAKER}::DOUBLE WHEN x.who <> '' AND y.who <> '' THEN {align.OTHER_SPEAKER}::DOUBLE ELSE 0.0::DOUBLE END" if speakers else "0.0::DOUBLE"
    worth = f"(coalesce(sim, 0.0) - {align.PAIR_FROM}::DOUBLE) * {align.PAIR_WORTH}::DOUBLE + {bonus}"
    up, left = f"{align.SKIP_LEFT}::DOUBLE", f"{align.SKIP_RIGHT}::DOUBLE"
    return f"""{INPUTS}, CP AS (SELECT x.norm AS a, y.norm AS b FROM A1 x JOIN B1 y USING (root, scene_id)), {similarities('CP', 'SM')},
CE AS (SELECT x.root, x.scene_id, i, j, x.idx AS sent_idx, y.idx AS dialogue_idx, coalesce(sim, 0.0) AS sim, {worth} AS gain FROM A1 x JOIN B1 y ON x.root = y.root AND x.scene_id = y.scene_id LEFT JOIN SM ON SM.a = x.norm AND SM.b = y.norm),
GR AS (SELECT *, max(i) OVER (PARTITION BY root, scene_id) AS n FROM (SELECT root, scene_id, i, list(gain ORDER BY j) AS g, max(j) AS m FROM CE GROUP BY root, scene_id, i)),
TB AS (SELECT root, scene_id, 0::BIGINT AS i, m, n, list_transform(range(m + 1), lambda j: 0.0::DOUBLE) AS v, list_transform(range(m), lambda j: 0) AS mv FROM GR WHERE i = 1
UNION ALL SELECT root, scene_id, i, m, n, v, list_transform(range(1, m + 1), lambda j: CASE WHEN old[j] + g[j] >= old[j + 1] - {up} AND old[j] + g[j] >= v[j] - {left} THEN 1 WHEN old[j + 1] - {up} >= v[j] - {left} THEN 2 ELSE 3 END) FROM (
    SELECT t.root, t.scene_id, GR.i, GR.m, GR.n, g, old, list_reduce(list_transform(range(1, GR.m + 1), lambda j: [greatest(old[j] + g[j], old[j + 1] - {up})]), lambda acc, e: list_append(acc, greatest(e[1], acc[len(acc)] - {left})), [old[1] - {up}]) AS v
    FROM (SELECT root, scene_id, i AS before, v AS old FROM TB) t JOIN GR ON GR.root = t.root AND GR.scene_id = t.scene_id AND GR.i = t.before + 1)),
TR AS (SELECT root, scene_id, i, list_position(v, list_max(v))::BIGINT - 1 AS j, 0 AS hit FROM TB WHERE i = n
UNION ALL SELECT TR.root, TR.scene_id, CASE WHEN mv[TR.j] = 3 THEN TR.i ELSE TR.i - 1 END, CASE WHEN mv[TR.j] = 2 THEN TR.j ELSE TR.j - 1 END, CASE WHEN mv[TR.j] = 1 THEN 1 ELSE 0 END
    FROM TR JOIN TB ON TB.root = TR.root AND TB.scene_id = TR.scene_id AND TB.i = TR.i WHERE TR.i > 0 AND TR.j > 0),
AL AS (SELECT CE.root, CE.scene_id, CE.sent_idx, CE.dialogue_idx, CE.sim FROM TR JOIN CE ON CE.root = TR.root AND CE.scene_id = TR.scene_id AND CE.i = TR.i + 1 AND CE.j = TR.j + 1 WHERE hit = 1)"""


#: The inputs of whole recordings: all lines of its root for each.
WHOLE_INPUTS = f"""{O.S}, {O.D},
A1 AS (SELECT {O.ROOT} AS root, episode, sent_id AS idx, {match_norm('utterance')} AS norm, '' AS who, row_number() OVER (PARTITION BY episode ORDER BY sentence_id NULLS LAST, sent_id) AS i FROM S WHERE episode IS NOT NULL),
B1 AS (SELECT root, episode, dialogue_id AS idx, {match_norm('utterance_ct')} AS norm, '' AS who, row_number() OVER (PARTITION BY episode ORDER BY dialogue_idx NULLS LAST, dialogue_id) AS j FROM D JOIN (SELECT DISTINCT root, episode FROM A1) p ON p.root = D.episode_root)"""


def aligned_whole() -> str:
    """CTEs up to AL(root, episode, sent_idx, dialogue_idx, sim): ``aligned`` with a recording as group, not a scene."""
    return aligned().replace(INPUTS, WHOLE_INPUTS, 1).replace("scene_id", "episode")


#: Aligned pairs with the rule forms of both texts and speakers.
PAIRED = f"""{aligned()}, PR AS (SELECT AL.*, {O.norm('x.utterance')} AS a, {O.norm('y.utterance_ct')} AS b, {O.norm('x.speaker')} AS wa, {O.norm('y.speaker_ct')} AS wb
    FROM AL JOIN A1 x ON x.idx = AL.sent_idx JOIN B1 y ON y.idx = AL.dialogue_idx)"""

ORACLES = {
    "normalize_text_match": f"WITH {O.D} SELECT dialogue_id, {match_norm('utterance_ct')} AS norm FROM D",
    "normalize_speaker": f"WITH {O.D} SELECT dialogue_id, {who_norm('speaker_ct')} AS who FROM D",
    "align_monotonic": f"WITH RECURSIVE {aligned_whole()} SELECT root, episode, sent_idx, dialogue_idx, round(sim, 6) AS sim FROM AL",
    "align_monotonic_speakers": f"WITH RECURSIVE {aligned(True)} SELECT root, CAST(scene_id AS INTEGER) AS scene_id, sent_idx, dialogue_idx, round(sim, 6) AS sim FROM AL",
    "fuzzy_similarity": f"""WITH RECURSIVE {PAIRED}, {similarities('PR', 'TX')}, WP AS (SELECT wa AS a, wb AS b FROM PR), {similarities('WP', 'WH')}
SELECT sent_idx AS sent_id, dialogue_idx AS dialogue_id, round(coalesce(TX.sim, 0.0), 6) AS sim, round(coalesce(WH.sim, 0.0), 6) AS name_sim FROM PR LEFT JOIN TX ON TX.a = PR.a AND TX.b = PR.b LEFT JOIN WH ON WH.a = PR.wa AND WH.b = PR.wb""",
    "length_ratio_filter": f"""WITH RECURSIVE {PAIRED}, LR AS (SELECT *, len(list_filter(string_split(a, ' '), lambda t: t <> '')) AS n, len(list_filter(string_split(b, ' '), lambda t: t <> '')) AS m FROM PR)
SELECT sent_idx AS sent_id, dialogue_idx AS dialogue_id, round(CASE WHEN m > 0 THEN n / m ELSE 0.0 END, 6) AS ratio, CASE WHEN m = 0 THEN true ELSE n / m <= 2.0 END AS length_ok FROM LR""",
    "best_span_removal": f"""WITH RECURSIVE {PAIRED}, WL AS (SELECT sent_idx, list_filter(string_split(b, ' '), lambda t: t <> '') AS w, list_filter(string_split(a, ' '), lambda t: t <> '') AS g, a FROM PR),
SZ AS (SELECT *, unnest(range(greatest(1, len(g) - 3), least(len(w), len(g) + 3) + 1)) AS size FROM WL WHERE len(w) > 0 AND len(g) > 0),
SI AS (SELECT *, unnest(range(len(w) - size + 1)) AS i FROM SZ), SX AS (SELECT sent_idx, w, size, i, a AS b, array_to_string(w[i + 1 : i + size], ' ') AS a FROM SI), {similarities('SX', 'SS')},
BS AS (SELECT sent_idx, w, SX.size, SX.i, sim, row_number() OVER (PARTITION BY sent_idx ORDER BY sim DESC, SX.size, SX.i) AS r FROM SX JOIN SS USING (a, b))
SELECT WL.sent_idx AS sent_id, array_to_string(CASE WHEN sim >= 0.55 THEN list_concat(WL.w[1 : BS.i], WL.w[BS.i + BS.size + 1 :]) ELSE WL.w END, ' ') AS rest FROM WL LEFT JOIN BS ON BS.sent_idx = WL.sent_idx AND r = 1""",
}

ORACLES["alignment_rows"] = f"""WITH RECURSIVE {aligned()},
RW AS (SELECT x.episode, x.idx, y.speaker_ct, y.utterance_ct, 'scene ' || y.scene_id AS scene, AL.sim, coalesce(AL.sim >= 0.52 OR AL.sim >= 0.52::DOUBLE - 0.08::DOUBLE AND x.who <> '' AND x.who = y.who, false) AS keep
    FROM A1 x LEFT JOIN AL ON AL.sent_idx = x.idx LEFT JOIN B1 y ON y.idx = AL.dialogue_idx)
SELECT episode, idx, CASE WHEN keep THEN speaker_ct END AS speaker_ct, CASE WHEN keep THEN utterance_ct END AS utterance_ct, CASE WHEN keep THEN scene END AS scene_desc, round(sim, 6) AS alignment_score,
    CASE WHEN NOT keep THEN 'unresolved' WHEN sim >= 0.85 THEN 'high' WHEN sim >= 0.60 THEN 'medium' ELSE 'low' END AS speaker_confidence,
    CASE WHEN NOT keep THEN 'none' WHEN sim >= 0.85 THEN 'exact_align' ELSE 'fuzzy_align' END AS speaker_method FROM RW"""
ORACLES["split_chunks"] = rf"""WITH {O.D}, CH AS (SELECT dialogue_id, list_filter(list_transform(string_split_regex(replace(regexp_replace(coalesce({quotes(nfkc('utterance_ct'))}, ''), '\([^)]*\)|\[[^\]]*\]', ' ', 'g'), '...', '. '), '[.!?;]+'),
    lambda p: regexp_replace(trim(regexp_replace(p, '{O.SPACE}', ' ', 'g')), '^[ ,:\-]+|[ ,:\-]+$', '', 'g')), lambda p: {match_form('p')} <> '') AS ps FROM D)
SELECT dialogue_id, unnest(range(len(ps))) AS pos, unnest(ps) AS raw, unnest(list_transform(ps, lambda p: {match_form('p')})) AS norm FROM CH"""

# Graphs

_EDGE_JSON = """'{"source":' || to_json(source) || ',"target":' || to_json(target) || ',"weight":' || weight || ',"adjacency":' || adjacency || ',"proximity":' || proximity || ',"copresence":' || copresence || '}'"""
ORACLES["scene_graphs"] = f"""{O.NET}, BD AS (SELECT episode, scene_id, min(start_s) AS start_s, max(end_s) AS end_s, CAST(to_json(list_sort(list_distinct(list(speaker)))) AS VARCHAR) AS nodes FROM T GROUP BY ALL),
EJ AS (SELECT episode, scene_id, '[' || string_agg({_EDGE_JSON}, ',' ORDER BY source, target) || ']' AS edges FROM E WHERE weight > 0 GROUP BY ALL)
SELECT episode, scene_id, start_s, end_s, nodes, coalesce(edges, '[]') AS edges FROM BD LEFT JOIN EJ USING (episode, scene_id)"""

#: Each graph with its nodes in order and the matrix of its weights.
MATRIX = f"""{O.NET}, {O.BOTH}, ND AS (SELECT episode, scene_id, list_sort(list(character)) AS names, count(*) AS n FROM N GROUP BY ALL),
WM AS (SELECT episode, scene_id, map_from_entries(list((character || chr(1) || other, weight))) AS w FROM B GROUP BY ALL),
GX AS (SELECT episode, scene_id, names, n, list_transform(names, lambda a: list_transform(names, lambda b: coalesce(w[a || chr(1) || b], 0.0))) AS w FROM ND LEFT JOIN WM USING (episode, scene_id))""".replace("WITH ", "WITH RECURSIVE ", 1)
ORACLES["eigenvector"] = f"""{MATRIX}, PW AS (SELECT episode, scene_id, names, n, w, 0 AS k, list_transform(names, lambda a: 1.0::DOUBLE / n) AS x, false AS settled FROM GX
UNION ALL SELECT episode, scene_id, names, n, w, k + 1, y, list_sum(list_transform(range(1, n + 1), lambda i: abs(y[i] - x[i]))) < n * 1e-6 FROM (
    SELECT *, list_transform(z, lambda v: v / sqrt(list_sum(list_transform(z, lambda u: u * u)))) AS y FROM (
    SELECT *, list_transform(range(1, n + 1), lambda i: x[i] + list_sum(list_transform(range(1, n + 1), lambda j: w[i][j] * x[j]))) AS z FROM PW WHERE NOT settled AND k < 1000))),
LT AS (SELECT *, list_sum(list_transform(w, lambda r: list_sum(r))) AS total FROM (SELECT *, row_number() OVER (PARTITION BY episode, scene_id ORDER BY k DESC) AS r FROM PW) WHERE r = 1)
SELECT episode, scene_id, unnest(names) AS character, round(unnest(CASE WHEN total = 0 THEN list_transform(names, lambda a: 0.0::DOUBLE) WHEN settled THEN x ELSE list_transform(w, lambda r: list_sum(r) / total) END), 6) AS value FROM LT"""

# Shortest ways from each node, the number of them, and what share of them lies on each other node.
ORACLES["betweenness"] = f"""{MATRIX}, D0 AS (SELECT episode, scene_id, names, n, list_transform(w, lambda r: list_transform(r, lambda v: CASE WHEN v > 0 THEN 1.0::DOUBLE / v ELSE 1e18 END)) AS l FROM GX),
DS AS (SELECT episode, scene_id, names, n, l, unnest(range(1, n + 1)) AS s, 0 AS k FROM D0),
DR AS (SELECT *, list_transform(range(1, n + 1), lambda v: CASE WHEN v = s THEN 0.0::DOUBLE ELSE 1e18 END) AS d FROM DS
UNION ALL SELECT episode, scene_id, names, n, l, s, k + 1, list_transform(range(1, n + 1), lambda v: least(d[v], list_min(list_transform(range(1, n + 1), lambda u: d[u] + l[u][v])))) FROM DR WHERE k < n),
PR AS (SELECT episode, scene_id, names, n, l, s, d, 0 AS k, list_transform(range(1, n + 1), lambda v: CASE WHEN v = s THEN 1.0::DOUBLE ELSE 0.0 END) AS q FROM DR WHERE k = n
UNION ALL SELECT episode, scene_id, names, n, l, s, d, k + 1, list_transform(range(1, n + 1), lambda v: CASE WHEN v = s THEN 1.0 ELSE list_sum(list_transform(range(1, n + 1), lambda u: CASE WHEN l[u][v] < 1e17 AND d[v] < 1e17 AND abs(d[u] + l[u][v] - d[v]) <= 1e-12 THEN q[u] ELSE 0.0 END)) END) FROM PR WHERE k < n),
PA AS (SELECT episode, scene_id, s, d, q FROM PR WHERE k = n),
PX AS (SELECT a.episode, a.scene_id, a.s, v.s AS v, list_sum(list_transform(range(1, len(a.d) + 1), lambda t: CASE WHEN t <> a.s AND t <> v.s AND a.d[t] < 1e17 AND a.d[v.s] < 1e17 AND abs(a.d[v.s] + v.d[t] - a.d[t]) <= 1e-9 THEN a.q[v.s] * v.q[t] / a.q[t] ELSE 0.0 END)) AS share
    FROM PA a JOIN PA v ON a.episode = v.episode AND a.scene_id = v.scene_id AND a.s <> v.s),
BV AS (SELECT episode, scene_id, v, sum(share) AS share FROM PX GROUP BY ALL),
NN AS (SELECT episode, scene_id, n, unnest(names) AS character, unnest(range(1, n + 1)) AS v FROM ND)
SELECT episode, scene_id, character, round(CASE WHEN n > 2 THEN coalesce(share, 0.0) / ((n - 1) * (n - 2)) ELSE 0.0 END, 6) AS value FROM NN LEFT JOIN BV USING (episode, scene_id, v)"""

# Ordered folds

_RULES = ", ".join(f"({_quoted(k)}, {_quoted(m)}, {_quoted(c)}, {s}::DOUBLE, {str(r).lower()}, {_quoted(why)}, {_quoted(note)})" for k, (m, c, s, r, why, note) in ((k, impute.outcome(k, impute.Rules().scores)) for k in impute.OUTCOMES))
_SAYS = "contains(' ' || norm[i] || ' ', ' ' || lower({0}) || ' ')"
_OPENER = " OR ".join(f"starts_with(norm[i], {_quoted(x)})" for x in impute.Rules().continuation_prefixes)
_PUT = "CASE WHEN {1} <> '' THEN list_concat({0}[1 : i - 1], [{1}], {0}[i + 1 :]) ELSE {0} END"


def _near(who: str = "who") -> str:
    """p and q: the nearest known speakers before and after row i in its stretch, or empty."""
    return f"""coalesce({who}[list_max(list_filter(range(1, i), lambda j: {who}[j] <> '' AND run[j] = run[i]))], '') AS p,
    coalesce({who}[list_min(list_filter(range(i + 1, n + 1), lambda j: {who}[j] <> '' AND run[j] = run[i]))], '') AS q"""


#: CA(sent_id, ..., speaker, and what the fills wrote), the rules folded over each scene for three rounds.
CASCADE = f"""{O.DIRECT}, C0 AS (SELECT MS.sent_id, MS.episode, MS.season, scene_id, sentence_id, utterance, utterance_ct, was, ct, row_type, direct, agreed, CASE WHEN direct THEN ct ELSE was END AS known, norm, {O.words('utterance')} AS wc,
    CASE WHEN lag(scene_id) OVER (PARTITION BY MS.episode ORDER BY sentence_id) = scene_id THEN 0 ELSE 1 END AS fresh FROM MS JOIN DD USING (sent_id)),
C1 AS (SELECT *, sum(fresh) OVER (PARTITION BY episode ORDER BY sentence_id) AS run, coalesce(CAST(scene_id AS VARCHAR), 'x' || sent_id) AS g FROM C0),
C2 AS (SELECT episode, g, count(*) AS n, list(sent_id ORDER BY sentence_id) AS ids, list(row_type ORDER BY sentence_id) AS kind, list(run ORDER BY sentence_id) AS run, list(norm ORDER BY sentence_id) AS norm, list(wc ORDER BY sentence_id) AS wc, list(known ORDER BY sentence_id) AS who FROM C1 GROUP BY ALL),
CR AS (SELECT *, 0::BIGINT AS t, list_transform(who, lambda w: '') AS rule FROM C2
UNION ALL SELECT episode, g, n, ids, kind, run, norm, wc, {_PUT.format('who', 'new')}, t + 1, {_PUT.format('rule', 'r')} FROM (
    SELECT *, CASE WHEN r = 'song' THEN 'Song' WHEN r IN ('bridge', 'names_next', 'opener', 'end', 'end_short', 'long') THEN p WHEN r IN ('names_previous', 'short', 'start', 'start_short', 'weak') THEN q WHEN r = 'majority' THEN most ELSE '' END AS new FROM (
    SELECT *, CASE WHEN who[i] <> '' OR kind[i] = 'direction' THEN '' WHEN kind[i] = 'song' THEN 'song' WHEN p <> '' AND p = q THEN 'bridge'
        WHEN p <> '' AND q <> '' AND {_SAYS.format('p')} AND NOT {_SAYS.format('q')} THEN 'names_previous' WHEN p <> '' AND q <> '' AND {_SAYS.format('q')} AND NOT {_SAYS.format('p')} THEN 'names_next'
        WHEN wc[i] <= 2 AND p <> '' AND q <> '' THEN 'short' WHEN p <> '' AND ({_OPENER}) THEN 'opener' WHEN p <> '' AND q = '' THEN CASE WHEN wc[i] <= 2 THEN 'end_short' ELSE 'end' END
        WHEN q <> '' AND p = '' THEN CASE WHEN wc[i] <= 2 THEN 'start_short' ELSE 'start' END WHEN p <> '' THEN CASE WHEN wc[i] >= 5 THEN 'long' ELSE 'weak' END WHEN most <> '' THEN 'majority' ELSE '' END AS r FROM (
    SELECT *, {_near()}, coalesce(nz[list_position(cn, list_max(cn))], '') AS most FROM (SELECT *, list_transform(nz, lambda w: len(list_filter(nz, lambda z: z = w))) AS cn FROM (
    SELECT *, t % n + 1 AS i, list_filter(who, lambda w: w <> '') AS nz FROM CR WHERE t < 3 * n)))))),
C4 AS (SELECT unnest(ids) AS sent_id, unnest(who) AS speaker, unnest(rule) AS rule FROM CR WHERE t = 3 * n),
CA AS (SELECT C1.*, C4.speaker, direct OR rule <> '' AS filled_from_missing, CASE WHEN rule <> '' THEN o.method WHEN direct OR agreed THEN 'community_transcript_match' ELSE '' END AS speaker_method,
    CASE WHEN rule <> '' THEN o.confidence WHEN direct OR agreed THEN 'high' ELSE '' END AS speaker_confidence, CASE WHEN rule <> '' THEN o.score WHEN direct OR agreed THEN 1.0 ELSE 0.0 END AS alignment_score,
    coalesce(o.review, false) AS review_flag, coalesce(o.reason, '') AS review_reason, CASE WHEN rule <> '' THEN o.note WHEN direct THEN 'Speaker copied from available community-transcript mapping.' WHEN agreed THEN 'Speaker agrees with available community-transcript mapping.' ELSE '' END AS notes
    FROM C1 JOIN C4 USING (sent_id) LEFT JOIN (VALUES {_RULES}) o(name, method, confidence, score, review, reason, note) ON o.name = rule)""".replace("WITH ", "", 1)

ORACLES["speaker_rule_cascade"] = f"WITH RECURSIVE {CASCADE} SELECT sent_id, speaker, filled_from_missing, speaker_method, speaker_confidence, round(alignment_score, 6) AS alignment_score, review_flag, review_reason, notes FROM CA"
ORACLES["enhanced_rows"] = f"""WITH RECURSIVE {CASCADE}, E1 AS (SELECT *, row_type = 'direction' AND speaker_method = '' AS dir, speaker = '' AND speaker_method = '' AND row_type <> 'direction' AS blank FROM CA),
E2 AS (SELECT * REPLACE (CASE WHEN dir THEN 'direction' WHEN blank THEN 'unresolved' ELSE speaker_method END AS speaker_method, CASE WHEN dir THEN 'high' WHEN blank THEN 'low' ELSE speaker_confidence END AS speaker_confidence,
    CASE WHEN dir THEN 0.95::DOUBLE WHEN blank THEN 0.0 ELSE alignment_score END AS alignment_score, review_flag OR blank AS review_flag, CASE WHEN blank THEN 'unresolved_no_reliable_inference' ELSE review_reason END AS review_reason,
    CASE WHEN dir THEN {_quoted(impute.DIRECTION_NOTE)} WHEN blank THEN {_quoted(impute.BLANK_NOTE)} ELSE notes END AS notes) FROM E1),
E3 AS (SELECT *, filled_from_missing AND speaker_confidence = 'low' AS low, filled_from_missing AND speaker_confidence = 'medium' AND speaker_method IN ('short_turn_alternation', 'scene_context_inference') AND review_reason = '' AS medium FROM E2),
ES AS (SELECT episode, scene_id, string_agg(speaker, ' | ' ORDER BY f) AS scene_speaker_set FROM (SELECT episode, scene_id, trim(speaker) AS speaker, min(sentence_id) AS f FROM E3 WHERE trim(speaker) <> '' GROUP BY ALL) GROUP BY ALL)
SELECT E3.episode, E3.scene_id, sent_id, season, sentence_id, utterance, speaker, utterance_ct, ct AS speaker_ct, was AS speaker_original, row_type, ct <> '' AS matched_to_ct, filled_from_missing, speaker_method, speaker_confidence, round(alignment_score, 6) AS alignment_score,
    review_flag OR low OR medium AS review_flag, CASE WHEN low AND review_reason = '' THEN 'low_confidence_fill' WHEN medium THEN 'medium_confidence_context_fill' ELSE review_reason END AS review_reason, notes,
    CASE WHEN lag(E3.scene_id) OVER w = E3.scene_id THEN trim(lag(speaker) OVER w) ELSE '' END AS prev_speaker_scene, CASE WHEN lead(E3.scene_id) OVER w = E3.scene_id THEN trim(lead(speaker) OVER w) ELSE '' END AS next_speaker_scene,
    coalesce(scene_speaker_set, '') AS scene_speaker_set FROM E3 LEFT JOIN ES ON ES.episode = E3.episode AND ES.scene_id = E3.scene_id WINDOW w AS (PARTITION BY E3.episode ORDER BY sentence_id)"""


def corrections(rows: str, bridge: bool = True, anomaly: bool = True) -> str:
    """CTEs up to FX(sent_id, new_speaker, fix) over ``rows``: both corrections folded over each scene, one after the other."""
    step = f"""UNION ALL SELECT episode, scene_id, n, ids, run, wc, ct, %s, t + 1, {_PUT.format('who', 'new')}, CASE WHEN new <> '' THEN list_concat(weak[1 : i - 1], [false], weak[i + 1 :]) ELSE weak END, {_PUT.format('fix', 'f')} FROM (
    SELECT *, CASE WHEN f <> '' THEN p ELSE '' END AS new FROM (SELECT *, CASE WHEN who[i] <> '' AND p <> '' AND p = q AND who[i] <> p AND weak[i] %s END AS f FROM (SELECT *, {_near()} FROM (SELECT *, t + 1 AS i FROM %s WHERE t < n))))"""
    first = step % ("counts", "AND wc[i] <= 4 AND ct[i] = '' THEN 'bridge' ELSE ''" if bridge else "AND false THEN '' ELSE ''", "F2")
    second = step % ("counts", "AND counts[i] = 1 AND ct[i] = '' THEN 'anomaly' WHEN who[i] <> '' AND p <> '' AND p = q AND who[i] <> p AND weak[i] AND counts[i] = 1 AND NOT list_contains(ct, who[i]) AND list_contains(ct, p) THEN 'unsupported' ELSE ''" if anomaly else "AND false THEN '' ELSE ''", "F3")
    return f"""F0 AS (SELECT *, {O.words('utterance')} AS wc, CASE WHEN lag(scene_id) OVER (PARTITION BY episode ORDER BY sentence_id) = scene_id THEN 0 ELSE 1 END AS fresh, coalesce(speaker_confidence IN ('low', 'medium'), false) OR review_flag AS weak FROM {rows}),
F1 AS (SELECT *, sum(fresh) OVER (PARTITION BY episode ORDER BY sentence_id) AS run FROM F0),
F2 AS (SELECT episode, scene_id, count(*) AS n, list(sent_id ORDER BY sentence_id) AS ids, list(run ORDER BY sentence_id) AS run, list(wc ORDER BY sentence_id) AS wc, list(speaker_ct ORDER BY sentence_id) AS ct, list(0::BIGINT ORDER BY sentence_id) AS counts, 0::BIGINT AS t,
    list(trim(speaker) ORDER BY sentence_id) AS who, list(weak ORDER BY sentence_id) AS weak, list('' ORDER BY sentence_id) AS fix FROM F1 WHERE scene_id IS NOT NULL GROUP BY episode, scene_id {first}),
F3 AS (SELECT episode, scene_id, n, ids, run, wc, ct, list_transform(who, lambda w: len(list_filter(who, lambda z: z = w))::BIGINT) AS counts, 0::BIGINT AS t, who, weak, fix FROM F2 WHERE t = n {second}),
FX AS (SELECT * FROM (SELECT unnest(ids) AS sent_id, unnest(who) AS new_speaker, unnest(fix) AS fix FROM F3 WHERE t = n) WHERE fix <> '')"""


_FIXES = ", ".join(f"({_quoted(k)}, {_quoted(m)}, {_quoted(why)})" for k, (m, why) in qa.CORRECTIONS.items())
for _name, _on in (("qa_bridge", (True, False)), ("qa_anomaly", (False, True))):
    ORACLES[_name] = f"WITH RECURSIVE {O.CHECKED}, {corrections('CK', *_on)} SELECT sent_id, new_speaker, fix, reason AS qa_reason FROM FX JOIN (VALUES {_FIXES}) v(fix, method, reason) USING (fix)"

_RESOLVED = ", ".join(f"({_quoted(k)}, {_quoted(m)}, {s}::DOUBLE, {_quoted(note)})" for k, (m, s, note) in qa.RESOLVED.items())
#: QF: the rows after all corrections, with resolved; QC: what the corrections changed.
CORRECTED = f"""{O.CHECKED}, QO AS (SELECT * REPLACE (CASE WHEN hit THEN speaker_ct ELSE speaker END AS speaker, CASE WHEN hit THEN 'qa_speaker_ct_override' ELSE speaker_method END AS speaker_method, CASE WHEN hit THEN 'high' ELSE speaker_confidence END AS speaker_confidence,
    CASE WHEN hit THEN greatest(alignment_score, 1.0) ELSE alignment_score END AS alignment_score, review_flag AND NOT hit AS review_flag), CASE WHEN hit THEN 'QA correction: speaker_ct mismatch override' ELSE '' END AS notes FROM (SELECT *, {O.OVERRIDE} AS hit FROM CK)),
{corrections('QO')}, QB AS (SELECT QO.* REPLACE (coalesce(new_speaker, speaker) AS speaker, coalesce(v.method, speaker_method) AS speaker_method, CASE WHEN v.fix IS NOT NULL THEN 'high' ELSE speaker_confidence END AS speaker_confidence,
    CASE WHEN v.fix IS NOT NULL THEN greatest(alignment_score, 0.9) ELSE alignment_score END AS alignment_score, review_flag AND v.fix IS NULL AS review_flag, CASE WHEN v.fix IS NOT NULL THEN 'QA correction: ' || v.reason ELSE notes END AS notes), v.fix AS fix
    FROM QO LEFT JOIN FX USING (sent_id) LEFT JOIN (VALUES {_FIXES}) v(fix, method, reason) ON v.fix = FX.fix),
QR AS (SELECT *, sum(fresh) OVER (PARTITION BY episode ORDER BY sentence_id) AS run, nullif(trim(speaker), '') AS k FROM (SELECT *, CASE WHEN lag(scene_id) OVER (PARTITION BY episode ORDER BY sentence_id) = scene_id THEN 0 ELSE 1 END AS fresh FROM QB)),
QN AS (SELECT *, last_value(k IGNORE NULLS) OVER (PARTITION BY episode, run ORDER BY sentence_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p, first_value(k IGNORE NULLS) OVER (PARTITION BY episode, run ORDER BY sentence_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS q FROM QR),
QV AS (SELECT *, CASE WHEN NOT review_flag THEN NULL WHEN speaker <> '' AND p = speaker AND q = speaker THEN 'bridge' WHEN speaker <> '' AND speaker = speaker_ct THEN 'ct_support' END AS resolved FROM QN),
QF AS (SELECT QV.* REPLACE (coalesce(z.method, speaker_method) AS speaker_method, CASE WHEN resolved IS NOT NULL THEN 'high' ELSE speaker_confidence END AS speaker_confidence, CASE WHEN resolved IS NOT NULL THEN greatest(alignment_score, z.score) ELSE alignment_score END AS alignment_score,
    review_flag AND resolved IS NULL AS review_flag, CASE WHEN resolved IS NULL THEN notes WHEN notes = '' THEN z.note ELSE notes || ' | ' || z.note END AS notes) FROM QV LEFT JOIN (VALUES {_RESOLVED}) z(name, method, score, note) ON z.name = resolved)"""
ORACLES["qa_final_rows"] = f"WITH RECURSIVE {CORRECTED} SELECT sent_id, speaker, speaker_method, speaker_confidence, round(alignment_score, 6) AS alignment_score, review_flag, notes FROM QF"
ORACLES["qa_summary"] = f"""WITH RECURSIVE {CORRECTED}, WS AS (SELECT season, episode, count_if(review_flag) AS review_rows_before_qa FROM CK GROUP BY ALL)
SELECT season, episode, count(*) AS rows, any_value(review_rows_before_qa) AS review_rows_before_qa, count_if(review_flag) AS review_rows_after_qa, count_if(notes LIKE '%speaker_ct mismatch override%') AS speaker_ct_overrides, count_if(coalesce(fix, '') = 'bridge') AS scene_bridge_fixes,
    count_if(coalesce(fix, '') IN ('anomaly', 'unsupported')) AS scene_anomaly_fixes, count_if(resolved IS NOT NULL) AS review_rows_resolved, count_if(trim(speaker) = '') AS remaining_unresolved_rows FROM QF JOIN WS USING (season, episode) GROUP BY season, episode"""

ORACLES["restore_times"] = f"WITH {O.S} SELECT sent_id, episode, sentence_id, start_s, end_s FROM S"
ORACLES["episode_window_search"] = f"""WITH {O.OVERLAP}, PJ AS (SELECT root, scene_id, dialogue_id, row_number() OVER (PARTITION BY root, scene_id ORDER BY dialogue_idx, dialogue_id) - 1 AS j, count(*) OVER (PARTITION BY root, scene_id) AS n FROM (SELECT DISTINCT root, scene_id, dialogue_id, dialogue_idx FROM O)),
PI AS (SELECT root, scene_id, sent_id, row_number() OVER (PARTITION BY root, scene_id ORDER BY sentence_id, sent_id) - 1 AS i, count(*) OVER (PARTITION BY root, scene_id) AS m FROM (SELECT DISTINCT O.root, O.scene_id, O.sent_id, X.sentence_id FROM O JOIN X USING (sent_id))),
RW AS (SELECT O.root, O.scene_id, i, m, n, least(n, floor(m * 1.2::DOUBLE)::BIGINT + 5) AS w, list(sim ORDER BY j) AS r FROM O JOIN PJ USING (dialogue_id) JOIN PI USING (sent_id) GROUP BY ALL),
SP AS (SELECT root, scene_id, w, unnest(range(n - w + 1)) AS j, r FROM RW WHERE w < n AND i % greatest(1, m // 25) = 0),
SC AS (SELECT root, scene_id, j, w, floor(sum(CAST(round(list_max(r[j + 1 : j + w]) * 1000000.0) AS BIGINT)) / count(*)) / 1000000.0 AS score FROM SP GROUP BY ALL)
SELECT root, scene_id, j AS start_idx, j + w AS end_idx, score FROM (SELECT *, row_number() OVER (PARTITION BY root, scene_id ORDER BY score DESC, j) AS k FROM SC) WHERE k = 1
UNION ALL SELECT DISTINCT root, scene_id, 0, n, NULL FROM RW WHERE w >= n"""
_OLD_METRICS = O.ORACLES["scene_metrics"]
ORACLES["scene_metrics"] = f"""{O.NET.replace('WITH ', 'WITH RECURSIVE ', 1)}, {O.BOTH}, RC AS (SELECT episode, scene_id, character, character AS other FROM N UNION SELECT r.episode, r.scene_id, r.character, B.other FROM RC r JOIN B ON B.episode = r.episode AND B.scene_id = r.scene_id AND B.character = r.other),
NC AS (SELECT episode, scene_id, count(DISTINCT least_one) AS n_components FROM (SELECT episode, scene_id, character, min(other) AS least_one FROM RC GROUP BY ALL) GROUP BY ALL)
SELECT m.*, n_components FROM ({_OLD_METRICS}) m JOIN NC USING (episode, scene_id)"""

_WORDS = f"WO AS ({O.ORACLES['interval_join_words']}), WS2 AS (SELECT WO.episode, WO.idx, WO.sentence_idx, CASE WHEN s.sent_id IS NOT NULL THEN coalesce(trim(s.speaker), '') END AS speaker FROM WO LEFT JOIN (SELECT DISTINCT * EXCLUDE (loaded_at) FROM sentences) s ON s.episode = WO.episode AND s.sentence_id = WO.sentence_idx)"
ORACLES["word_speakers"] = f"WITH {_WORDS} SELECT episode, idx, sentence_idx, speaker FROM WS2"
ORACLES["word_stats"] = f"WITH {_WORDS} SELECT episode, count(*) AS n_words, count(sentence_idx) AS n_in_sentences, count_if(coalesce(speaker, '') <> '') AS n_with_speaker FROM WS2 GROUP BY ALL"
