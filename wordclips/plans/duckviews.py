"""The derived tables of ``tables.Tables`` written as SQL common table expressions."""

from __future__ import annotations

from wordclips.plans.tables import LETTER_PHONES

_PHONES = "[" + ",".join(f"'{p}'" for p in LETTER_PHONES) + "]"
_CLEAN = r"lower(regexp_replace({}, '[^\p{{L}}\p{{N}}_]', '', 'g'))"
_WORDS = (r"list_filter(list_transform(regexp_split_to_array(text, '[ \n\t\r]+'), "
          r"lambda t: " + _CLEAN.format("t") + "), lambda w: w <> '')")
_KNOWN = "regexp_full_match(word, '[a-z]+') AND length(word) % 3 <> 0"

# name: (views it reads, SQL)
VIEWS: dict[str, tuple[str, str]] = {
    "tok": ("", f"""SELECT lang, source, doc_id, unnest(l) AS word, generate_subscripts(l, 1) - 1 AS i
        FROM (SELECT lang, source, doc_id, {_WORDS} AS l FROM documents)"""),
    "sources": ("", f"""SELECT lang AS corpus, doc_id AS source_id, 'vid' || doc_id AS video_id,
        'downloads/' || source || '/' || doc_id || '.mp4' AS source_file,
        CAST(len({_WORDS}) * 400 + 1000 AS BIGINT) AS duration_ms FROM documents"""),
    "clips": ("tok", """SELECT lang AS corpus, doc_id AS source_id, doc_id * 2147483648 + i AS clip_id, word,
        i * 400 + ((doc_id * 7 + i * 13) % 10) * 20 + CASE WHEN (i + doc_id) % 17 = 0 THEN 250 ELSE 0 END AS start_ms,
        i * 400 + ((doc_id * 7 + i * 13) % 10) * 20 + 120 + length(word) * 35 AS end_ms,
        'downloads/' || source || '/' || doc_id || '.mp4' AS source_file,
        CAST((doc_id + i) % 29 = 0 AS INTEGER) AS edited, i AS tok FROM tok"""),
    "noises": ("clips", """SELECT corpus, source_id, clip_id, ['click','spew','breath'][tok % 3 + 1] AS word,
        end_ms + 10 AS start_ms, end_ms + 130 AS end_ms, source_file FROM clips WHERE tok % 23 = 7"""),
    "idx": ("clips", """SELECT *, row_number() OVER w - 1 AS idx, lag(end_ms) OVER w AS prev_end,
        lead(start_ms) OVER w AS next_start, lead(word) OVER w AS next_word,
        lead(start_ms) OVER w - end_ms AS gap_after FROM clips WHERE end_ms > start_ms
        WINDOW w AS (PARTITION BY source_id ORDER BY start_ms, clip_id)"""),
    "lexicon": ("clips", f"""SELECT word, list_transform(string_split(word, ''), lambda c: {_PHONES}[ascii(c) - 96]) AS phones
        FROM (SELECT DISTINCT word FROM clips WHERE {_KNOWN})"""),
    "onsets": ("lexicon", """SELECT word, phones[1] IN ('AA','AE','AH','EH','IH','IY') AS vowel_onset FROM lexicon"""),
    "bleed": ("idx onsets", """SELECT idx.*, coalesce(gap_after < 120 AND vowel_onset, false) AS bleed_risk
        FROM idx LEFT JOIN onsets ON onsets.word = idx.next_word"""),
    "quality": ("clips", """SELECT source_id, count(*) AS n_clips,
        CAST(sum(CASE WHEN end_ms - start_ms >= 50 THEN 1 ELSE 0 END) AS BIGINT) AS n_good,
        sum(CASE WHEN end_ms - start_ms >= 50 THEN 1 ELSE 0 END) / count(*) AS quality FROM clips GROUP BY 1"""),
    "vocab": ("clips", """SELECT word, count(*) AS n FROM clips WHERE end_ms - start_ms >= 50 GROUP BY 1"""),
    "aligned": ("clips", f"""SELECT *, CASE WHEN {_KNOWN} AND end_ms > start_ms AND tok % 7 <> 0 THEN
        list_transform(string_split(word, ''), lambda c, k: {{
          'phone': {_PHONES}[ascii(c) - 96],
          'start_ms': CASE WHEN tok % 31 = 0 THEN 100 ELSE 0 END + (end_ms - start_ms) * (k - 1) // length(word),
          'end_ms': CASE WHEN tok % 31 = 0 THEN 100 ELSE 0 END + (end_ms - start_ms) * k // length(word)}}) END AS phones FROM clips"""),
    "captions": ("clips", """SELECT * FROM (SELECT source_id, tok, CASE WHEN tok % 13 = 5 THEN reverse(word) ELSE word END AS word,
        start_ms + ((source_id * 3 + tok * 7) % 9 - 4) * 90 AS t_ms FROM clips
        WHERE tok % 11 <> 3) WHERE t_ms >= 0"""),
    "texts": ("", "SELECT conv_id * 2147483648 + turn AS text_id, text FROM conversations"),
    "tokens": ("texts", r"""SELECT text_id, CAST(row_number() OVER w - 1 AS BIGINT) AS pos, word,
        ends OR lead(word) OVER w IS NULL AS ends FROM (
          SELECT text_id, k, """ + _CLEAN.format("raw") + r""" AS word,
            regexp_matches(raw, '[.!?]["'')\]]*$') AS ends
          FROM (SELECT text_id, unnest(l) AS raw, generate_subscripts(l, 1) AS k
                FROM (SELECT text_id, regexp_split_to_array(trim(text, E' \n\t\r'), '[ \n\t\r]+') AS l FROM texts)))
        WHERE word <> '' WINDOW w AS (PARTITION BY text_id ORDER BY k)"""),
    "contexts": ("texts", f"""SELECT text_id AS ctx_id, l[greatest(1, len(l) - 4):len(l) - 1] AS words,
        CASE WHEN text_id % 2 = 1 THEN substring(l[len(l)], 1, 1) ELSE '' END AS prefix
        FROM (SELECT text_id, {_WORDS} AS l FROM texts) WHERE len(l) >= 2"""),
    "wanted_lexicon": ("clips tokens", f"""SELECT word, list_transform(string_split(word, ''), lambda c: {_PHONES}[ascii(c) - 96]) AS phones
        FROM (SELECT word FROM clips WHERE {_KNOWN} UNION SELECT word FROM tokens WHERE {_KNOWN})"""),
    "pidx": ("clips ratings", """SELECT *, next_start - end_ms AS gap_after, coalesce(next_start - end_ms <= 600 AND NOT vetoed AND NOT next_vetoed, false) AS step
        FROM (SELECT *, row_number() OVER w - 1 AS idx, lag(end_ms) OVER w AS prev_end, lead(start_ms) OVER w AS next_start,
          lead(word) OVER w AS next_word, lead(vetoed) OVER w AS next_vetoed FROM (
            SELECT c.*, coalesce(score <= -2, false) AS vetoed FROM clips c LEFT JOIN ratings r ON r.word = c.word AND r.clip_id = c.clip_id
            WHERE end_ms > start_ms) WINDOW w AS (PARTITION BY source_id ORDER BY start_ms, clip_id))"""),
    "runs": ("pidx tokens", """SELECT text_id, pos, source_id, idx AS start_idx,
        max(pos) OVER (PARTITION BY text_id, source_id, diag, isl) - pos + 2 AS length FROM (
          SELECT *, pos - row_number() OVER (PARTITION BY text_id, source_id, diag ORDER BY pos) AS isl FROM (
            SELECT text_id, pos, source_id, idx, idx - pos AS diag FROM
              (SELECT text_id, pos, word, lead(word) OVER (PARTITION BY text_id ORDER BY pos) AS nw FROM tokens) q
              JOIN pidx c ON c.word = q.word AND c.next_word = q.nw AND c.step))"""),
    "best": ("runs quality", """SELECT text_id, pos, source_id, start_idx, length FROM (
        SELECT runs.*, row_number() OVER (PARTITION BY text_id, pos ORDER BY length DESC, quality DESC, source_id, start_idx) AS r
        FROM runs JOIN quality USING (source_id)) WHERE r = 1"""),
    "capped": ("best tokens", """SELECT t.text_id, t.pos, b.source_id, b.start_idx,
        CASE WHEN length IS NOT NULL AND least(length, stop - t.pos + 1) >= 2 THEN least(length, stop - t.pos + 1) ELSE 1 END AS cap
        FROM (SELECT *, min(CASE WHEN ends THEN pos END) OVER (PARTITION BY text_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS stop FROM tokens) t
        LEFT JOIN best b ON b.text_id = t.text_id AND b.pos = t.pos"""),
    "walk": ("capped", """SELECT text_id, pos FROM capped WHERE pos = 0 UNION ALL
        SELECT w.text_id, w.pos + c.cap FROM walk w JOIN capped c ON c.text_id = w.text_id AND c.pos = w.pos
        JOIN capped n ON n.text_id = w.text_id AND n.pos = w.pos + c.cap"""),
    "cover": ("walk", """SELECT text_id, pos, cap AS length, CASE WHEN cap >= 2 THEN source_id END AS source_id,
        CASE WHEN cap >= 2 THEN start_idx END AS start_idx FROM walk JOIN capped USING (text_id, pos)"""),
    "votes": ("", """SELECT event_id AS seq, ts, 'w' || (event_id % 20) AS word, user_id % 50 AS clip_id,
        CASE WHEN event_type = 'signup' THEN 'reset' ELSE 'add' END AS op,
        CASE WHEN event_type IN ('purchase','click') THEN 1 ELSE -1 END AS delta FROM events"""),
    "ratings": ("clips", """SELECT word, clip_id, clip_id % 9 - 4 AS score FROM clips
        WHERE (clip_id * 31 + length(word)) % 7 = 0"""),
    "report_log": ("", """SELECT event_id AS seq, ts, user_id % 50 AS clip_id,
        CASE event_type WHEN 'click' THEN 'starts early' WHEN 'view' THEN 'starts late'
          WHEN 'purchase' THEN 'ends early' WHEN 'error' THEN 'ends late' ELSE 'odd' END AS kind FROM events"""),
    "reports": ("clips", """SELECT * FROM (SELECT clip_id, unnest(['ends early','starts late']) AS kind, clip_id % 3 + 1 AS count
        FROM clips WHERE clip_id % 41 = 3) WHERE kind = 'ends early' OR clip_id % 2 = 0"""),
    "jobs": ("", """SELECT event_id AS seq, ts, user_id AS job_id, CASE WHEN event_type = 'signup' THEN 'queued'
        WHEN event_type IN ('view','click') THEN 'running' WHEN event_type = 'purchase' THEN 'done' ELSE 'error' END AS status FROM events"""),
    "notes": ("", """SELECT l_orderkey % 500 AS song_id, CAST(l_linenumber AS BIGINT) AS part_id,
        CAST(CASE WHEN l_linenumber = 4 THEN 9 ELSE l_linenumber END AS BIGINT) AS channel,
        l_partkey % 48 + 36 AS pitch, (l_suppkey * 31 + l_partkey * 17 + l_orderkey * 7) % 240 * 125 AS start_ms,
        (CAST(floor(l_quantity) AS BIGINT) % 8 + 1) * 125 AS dur_ms, l_partkey % 80 + 40 AS velocity,
        l_orderkey * 10 + l_linenumber AS note_id FROM lineitem"""),
    "tempo": ("", """SELECT o_orderkey % 500 AS song_id, o_custkey % 5 * 1920 AS tick,
        min(o_custkey % 9 * 50000 + 400000) AS usec FROM orders GROUP BY 1, 2"""),
    "features": ("", """SELECT vec_id AS clip_id, label, CAST(embedding[1] AS DOUBLE) AS pitch,
        CAST(embedding[2] AS DOUBLE) AS pitch_start, CAST(embedding[3] AS DOUBLE) AS pitch_end,
        CAST(embedding[4] AS DOUBLE) AS movement, CAST(embedding[5] AS DOUBLE) AS loudness,
        CAST(embedding[6] AS DOUBLE) AS pace, CAST(embedding[7] AS DOUBLE) AS brightness FROM embeddings"""),
    "frames": ("clips", """SELECT source_id, clip_id, start_ms + k * 10 AS t_ms, 200 + ((clip_id * 37 + k * 101) % 17) * 60 AS rms
        FROM (SELECT source_id, clip_id, start_ms, unnest(range(0, (end_ms - start_ms) // 10 + 1)) AS k
              FROM clips WHERE end_ms > start_ms)"""),
    "blocks": ("", """SELECT vec_id % 40 AS song_id, vec_id AS part_id, CAST(label AS BIGINT) AS role_id,
        CAST(generate_subscripts(embedding, 1) - 1 AS BIGINT) AS block,
        abs(CAST(unnest(embedding) AS DOUBLE)) + 1e-6 AS power FROM embeddings"""),
}


def with_views(needs: str, sql: str) -> str:
    """``sql`` after a WITH clause of the views it needs, in order."""
    done: dict[str, str] = {}

    def add(name: str) -> None:
        if name in done:
            return
        deps, body = VIEWS[name]
        for dep in deps.split():
            add(dep)
        done[name] = body

    for name in needs.split():
        add(name)
    if not done:
        return sql
    # A view read by a recursion is made once, not once per round.
    recursive = "walk" in done
    head = ",\n".join(f"{n} AS {'MATERIALIZED ' if recursive and n == 'capped' else ''}({b})"
                      for n, b in done.items())
    start = "WITH RECURSIVE" if recursive else "WITH"
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        start, body = "WITH RECURSIVE", "WITH " + body[15:]
    if body.upper().startswith("WITH "):
        return f"{start} {head},\n{body[5:]}"
    return f"{start} {head}\n{body}"
