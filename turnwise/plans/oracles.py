"""The same results in plain SQL, from the driver's tables alone."""

from __future__ import annotations

# ------------------------------------------------------------ shared pieces

_RAW = """
raw AS (SELECT event_id AS seq, ts, user_id, event_type, value,
        CAST(regexp_extract(props, '[0-9]+') AS INT) AS k FROM events),
tool AS (SELECT *, CASE event_type WHEN 'view' THEN 'read' WHEN 'click' THEN 'grep'
        WHEN 'purchase' THEN 'edit' WHEN 'signup' THEN 'write' ELSE 'bash' END AS tool_name,
        CASE event_type WHEN 'view' THEN 'read' WHEN 'click' THEN 'research'
        WHEN 'purchase' THEN 'mutation' WHEN 'signup' THEN 'mutation' ELSE 'other' END AS category,
        CASE WHEN k % 17 <> 0 THEN 'f' || (k % 10) END AS file_path FROM raw)"""


def _calls(key: str) -> str:
    """Numbered tool calls with the last read of the same file, and session values."""
    return f"""
calls AS (SELECT {key} AS session_key, seq, ts, user_id, tool_name, category, file_path,
        row_number() OVER (PARTITION BY {key} ORDER BY seq) AS call_no,
        row_number() OVER (PARTITION BY {key} ORDER BY seq DESC) AS back_no FROM tool),
seen AS (SELECT *, max(CASE WHEN category IN ('read', 'research') THEN call_no END) OVER (
        PARTITION BY session_key, file_path ORDER BY seq
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_read FROM calls),
per AS (SELECT session_key, any_value(user_id) AS user_id, count(*) AS event_count,
        min(ts) AS started_at, max(ts) AS ended_at,
        count(*) FILTER (WHERE category = 'read' AND back_no <= 50) AS reads,
        count(*) FILTER (WHERE category = 'research' AND back_no <= 50) AS research,
        count(*) FILTER (WHERE category = 'mutation' AND back_no <= 50) AS mutations,
        count(*) FILTER (WHERE category = 'other' AND back_no <= 50) AS other,
        count(*) FILTER (WHERE back_no <= 50) AS window_calls,
        count(*) FILTER (WHERE category = 'mutation') AS mutations_total,
        count(*) FILTER (WHERE category = 'mutation' AND file_path IS NOT NULL)
            AS mutations_with_path,
        count(*) FILTER (WHERE category = 'mutation' AND file_path IS NOT NULL
            AND (last_read IS NULL OR call_no - last_read > 20)) AS blind_mutations,
        count(*) FILTER (WHERE tool_name = 'write') AS write_calls
        FROM seen GROUP BY session_key),
metric AS (SELECT *, reads / greatest(mutations, 1) AS read_edit_ratio,
        (reads + research) / greatest(mutations, 1) AS research_mutation_ratio,
        CASE WHEN mutations_total = 0 THEN 1.0 ELSE mutations_with_path / mutations_total END
            AS tracking_confidence,
        CASE WHEN mutations_total = 0 THEN 0.0 ELSE blind_mutations / mutations_total END
            AS blind_edit_rate,
        CASE WHEN mutations_total > 0 THEN write_calls / mutations_total END AS write_precision,
        reads + research + mutations AS classified FROM per),
longm AS (SELECT session_key, user_id, started_at, ended_at, 'parse_health' AS metric_name,
        CAST(1.0 AS DOUBLE) AS value FROM metric
    UNION ALL SELECT session_key, user_id, started_at, ended_at, 'reasoning_loop', 0.0 FROM metric
    UNION ALL SELECT session_key, user_id, started_at, ended_at, 'stop_phrase', 0.0 FROM metric
    UNION ALL SELECT session_key, user_id, started_at, ended_at, 'read_edit_ratio',
        read_edit_ratio FROM metric
    UNION ALL SELECT session_key, user_id, started_at, ended_at, 'write_precision',
        write_precision FROM metric WHERE write_precision IS NOT NULL
    UNION ALL SELECT session_key, user_id, started_at, ended_at, 'blind_edit_rate',
        blind_edit_rate FROM metric WHERE tracking_confidence >= 0.95
    UNION ALL SELECT session_key, user_id, started_at, ended_at, 'research_mutation_ratio',
        research_mutation_ratio FROM metric WHERE mutations > 0)"""


_USER = "CAST(user_id AS VARCHAR)"
_DAY = "user_id || '-' || strftime(ts, '%Y-%m-%d')"
BY_USER = f"WITH {_RAW},{_calls(_USER)}"
BY_DAY = f"""WITH {_RAW},{_calls(_DAY)},
rep AS (SELECT metric.*, 'project-' || (user_id % 20) AS project_hash,
    CASE WHEN user_id % 3 = 0 THEN 'name-' || (user_id % 20) END AS project_name,
    CASE WHEN user_id % 4 <> 0 THEN 'model-' || (user_id % 4) END AS model,
    CASE WHEN user_id % 5 <> 0 THEN 'mode-' || (user_id % 2) END AS permission_mode,
    CASE WHEN user_id % 7 <> 0 THEN CASE user_id % 2 WHEN 0 THEN 'planning' ELSE 'mixed' END END
        AS session_task_type FROM metric),
rl AS (SELECT l.*, r.project_hash, r.project_name, r.model, r.permission_mode,
    r.session_task_type FROM longm l JOIN rep r USING (session_key)),
banded AS (SELECT *, CASE
    WHEN metric_name = 'read_edit_ratio' AND value < 2 THEN 0
    WHEN metric_name = 'read_edit_ratio' AND value < 4 THEN 1 ELSE 2 END AS band FROM rl),
worst AS (SELECT session_key, min(band) AS band FROM banded GROUP BY session_key)"""

_SEV = "CASE {} WHEN 0 THEN 'crit' WHEN 1 THEN 'warn' ELSE 'ok' END"
_T = "strftime({0}, '%Y-%m-%d %H:%M:%S.%f')"


def _time(column: str, alias: str | None = None) -> str:
    return f"{_T.format(column)} AS {alias or column}"


def _six(expr: str, alias: str) -> str:
    # Adding zero turns a rounded-away negative number into plain 0.
    return f"round(CAST({expr} AS DOUBLE), 6) + 0.0 AS {alias}"


_LINES = f"""WITH {_RAW},
ln AS (SELECT *, CAST(user_id AS VARCHAR) AS session_key, seq AS line_no,
    CASE WHEN event_type = 'view' AND k % 5 = 0 THEN 'm' || k END AS message_id,
    CASE event_type WHEN 'view' THEN 'message' WHEN 'click' THEN 'message'
        WHEN 'purchase' THEN 'flat' WHEN 'signup' THEN 'message'
        ELSE CASE k % 3 WHEN 0 THEN 'malformed' WHEN 1 THEN 'unknown_type'
        ELSE 'structural' END END AS line_class,
    CASE WHEN k % 17 <> 0 THEN 'f' || (k % 10) END AS path FROM raw),
dd AS (SELECT *, message_id IS NOT NULL AND row_number() OVER (
    PARTITION BY session_key, message_id ORDER BY line_no) > 1 AS duplicate FROM ln),
lo AS (SELECT *, line_class NOT IN ('malformed', 'unknown_type') AS ok,
    CASE WHEN line_class IN ('malformed', 'unknown_type') THEN 0
         WHEN event_type = 'click' THEN 3 ELSE 1 END AS parsed_events,
    row_number() OVER (PARTITION BY session_key ORDER BY line_no DESC) AS back_no FROM dd),
st AS (SELECT session_key, count(*) AS total_lines, sum(parsed_events) AS parsed_events,
    count(*) FILTER (WHERE duplicate) AS duplicate_count,
    least(1.0, sum(parsed_events) / count(*)) AS session_confidence,
    count(*) FILTER (WHERE ok AND back_no <= 200) / count(*) FILTER (WHERE back_no <= 200)
        AS parse_confidence FROM lo GROUP BY session_key),
ev AS (
    SELECT session_key, line_no, 0 AS block_no, ts, 'tool_call' AS kind, NULL AS text,
        NULL AS token_count, 'read' AS tool_name, 't' || line_no AS tool_use_id, path AS file_path,
        NULL AS thinking_len, NULL AS redacted, NULL AS signature, message_id, user_id
        FROM lo WHERE event_type = 'view' AND NOT duplicate
    UNION ALL SELECT session_key, line_no, 0, ts, 'assistant', 'looking', k, NULL, NULL, NULL,
        NULL, NULL, NULL, NULL, user_id FROM lo WHERE event_type = 'click'
    UNION ALL SELECT session_key, line_no, 1, ts, 'tool_call', NULL, NULL, 'grep', 't' || line_no,
        path, NULL, NULL, NULL, NULL, user_id FROM lo WHERE event_type = 'click'
    UNION ALL SELECT session_key, line_no, 2, ts, 'thinking',
        CASE WHEN k % 3 = 0 THEN '' ELSE repeat('x', k + 1) END, NULL, NULL, NULL, NULL,
        CASE WHEN k % 3 = 0 THEN 0 ELSE k + 1 END, k % 3 = 0, repeat('s', k % 7), NULL, user_id
        FROM lo WHERE event_type = 'click'
    UNION ALL SELECT session_key, line_no, 0, ts, 'tool_call', NULL, NULL, 'edit', '', path, NULL,
        NULL, NULL, NULL, user_id FROM lo WHERE event_type = 'purchase'
    UNION ALL SELECT session_key, line_no, 0, ts, 'user', 'add a test', NULL, NULL, NULL, NULL,
        NULL, NULL, NULL, NULL, user_id FROM lo WHERE event_type = 'signup')"""

# Words are counted on a text whose separators are doubled, so that neighbouring
# words do not share one.
_W = r"[^\p{L}\p{N}_]"


def _doubled(column: str) -> str:
    return rf"' ' || regexp_replace({column}, '([^\p{{L}}\p{{N}}_])', '\1\1', 'g') || ' '"


def _words(word: str, doubled: str = "d") -> str:
    return f"len(regexp_extract_all({doubled}, '(?i){_W}{word.replace(' ', '  ')}{_W}'))"


_HITS = f"""
d AS (SELECT *, {_doubled('text')} AS d FROM said),
h AS (SELECT *, {_words('the')} AS h0, {_words('die')} AS h1, {_words('of the')} AS h2,
    len(regexp_extract_all(text, '(?i)ing')) AS h3 FROM d)"""
_SAID = """WITH said AS (SELECT CAST(conv_id AS VARCHAR) AS session_key, turn, text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS message_index
    FROM conversations WHERE role = 'assistant' AND length(text) > 0)"""
_SPANS = f"""{_SAID},
phrases(phrase, category, intent, word) AS (VALUES ('the', 'article', 'english article', true),
    ('die', 'article', 'german article', true), ('of the', 'link', 'english link', true),
    ('ing', 'suffix', 'suffix anywhere', false)),
cut AS (SELECT s.*, p.*, unnest(range(1, length(text) - length(phrase) + 2)) AS pos
    FROM said s CROSS JOIN phrases p),
span AS (SELECT session_key, message_index, phrase, category, intent, CAST(pos - 1 AS INT) AS start,
    CAST(pos - 1 + length(phrase) AS INT) AS "end", substr(text, pos, length(phrase)) AS matched,
    substr(text, greatest(pos - 41, 0) + 1,
        least(pos - 1 + length(phrase) + 40, length(text)) - greatest(pos - 41, 0)) AS context_snippet
    FROM cut WHERE lower(substr(text, pos, length(phrase))) = phrase AND (NOT word OR (
        (pos = 1 OR regexp_full_match(substr(text, pos - 1, 1), '{_W}'))
        AND (pos + length(phrase) > length(text)
            OR regexp_full_match(substr(text, pos + length(phrase), 1), '{_W}')))))"""

_LABEL = """CASE WHEN n_mutations >= 3 AND n_bash = 0 THEN 'mutation_heavy'
    WHEN n_bash >= 1 AND n_mutations >= 1 THEN 'debug_loop'
    WHEN n_tool_calls = 0 THEN 'planning'
    WHEN n_bash = 0 AND n_mutations < 2 AND n_lookups > 2 * n_mutations THEN 'exploration'
    WHEN user_message_text = 'please fix this' THEN 'debug_loop'
    WHEN user_message_text = 'add a test' THEN 'mutation_heavy'
    WHEN user_message_text = 'why is it slow' THEN 'debug_loop'
    WHEN user_message_text = 'outline the work' THEN 'planning' ELSE 'mixed' END"""
_TURNS = f"""WITH {_RAW},
pe AS (SELECT CAST(user_id AS VARCHAR) AS session_key, seq, ts, event_type = 'signup' AS opens,
    CASE WHEN event_type <> 'signup' THEN tool_name END AS tool_name,
    ['please fix this', 'add a test', 'why is it slow', 'outline the work', 'hello there'][
        CAST(k % 5 AS INT) + 1] AS text FROM tool),
nt AS (SELECT *, CAST(sum(CASE WHEN opens THEN 1 ELSE 0 END) OVER (
    PARTITION BY session_key ORDER BY seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS turn_no FROM pe),
ag AS (SELECT session_key, turn_no, min(ts) AS started_at, max(ts) AS last_ts,
    min_by(text, seq) AS user_message_text, count(*) AS event_count,
    count(tool_name) AS n_tool_calls,
    count(*) FILTER (WHERE tool_name IN ('edit', 'write', 'multi_edit')) AS n_mutations,
    count(*) FILTER (WHERE tool_name = 'bash') AS n_bash,
    count(*) FILTER (WHERE tool_name IN ('read', 'glob')) AS n_lookups
    FROM nt WHERE turn_no > 0 GROUP BY ALL),
tu AS (SELECT *, coalesce(lead(started_at) OVER (PARTITION BY session_key ORDER BY turn_no),
    last_ts) AS ended_at, {_LABEL} AS task_type FROM ag)"""

_JUDGED = """WITH j AS (SELECT doc_id, CASE WHEN quality = 1 THEN 'good' ELSE 'poor' END AS label,
    CASE WHEN n_chars >= 1000 THEN 'good' ELSE 'poor' END AS predicted
    FROM documents JOIN labels USING (doc_id))"""


def _streamed_sessions() -> str:
    """Users with prompts and conversations, as closed sessions of the stream."""
    calls = _RAW.replace("FROM raw)", "FROM raw WHERE event_type <> 'signup')")
    said = f"""{_SAID}, d AS (SELECT *, {_doubled('text')} AS d FROM said),
        h AS (SELECT *, {_words('and')} + {_words('und')} + len(regexp_extract_all(text, '(?i)que')) AS n,
            {_words('the')} + {_words('die')} + {_words('of the')} + len(regexp_extract_all(text, '(?i)ing')) AS s FROM d),
        i AS (SELECT *, sum(CASE WHEN n = 0 THEN 1 ELSE 0 END) OVER (
            PARTITION BY session_key ORDER BY turn ROWS UNBOUNDED PRECEDING) AS island FROM h),
        b AS (SELECT session_key, island, count(*) AS said, count(*) FILTER (WHERE s > 0) AS with_hit, sum(s) AS s,
            count(*) FILTER (WHERE n > 0) AS run, sum(n) AS n FROM i GROUP BY ALL)
        SELECT session_key, sum(said) AS messages, sum(with_hit) AS messages_with_hit, sum(s) AS hits,
            sum(n) AS loop_matches, max(run) AS max_burst FROM b GROUP BY session_key"""
    labels = f"""{_TURNS}, v AS (SELECT session_key, task_type, count(*) AS n FROM tu GROUP BY ALL)
        SELECT session_key, sum(n) AS turns, CASE WHEN sum(n) >= 2 AND max(n) * 2 > sum(n)
            THEN max_by(task_type, n) ELSE 'mixed' END AS session_task_type FROM v GROUP BY session_key"""
    whole = ("calls", "reads", "research", "mutations", "other", "mutations_total", "blind_mutations")
    zero = ", ".join(f"coalesce({c}, 0)::BIGINT AS {c}" for c in whole)
    talk = ("messages", "messages_with_hit", "hits", "loop_matches", "max_burst")
    return f"""SELECT 'u' || u.session_key AS session_key, 'final' AS row_type, u.event_count, {zero},
            {", ".join(f"0::BIGINT AS {c}" for c in talk)}, u.prompts, coalesce(turns, 0)::BIGINT AS turns, session_task_type
        FROM (SELECT CAST(user_id AS VARCHAR) AS session_key, count(*) AS event_count,
                count(*) FILTER (WHERE event_type = 'signup') AS prompts FROM events GROUP BY user_id) u
        LEFT JOIN (WITH {calls},{_calls(_USER)} SELECT session_key, event_count AS calls, {", ".join(whole[1:])} FROM metric) m
            USING (session_key)
        LEFT JOIN ({labels}) l USING (session_key)
        UNION ALL BY NAME
        SELECT 'c' || c.session_key AS session_key, 'final' AS row_type, event_count,
            {", ".join(f"0::BIGINT AS {c}" for c in whole)}, {", ".join(f"coalesce({c}, 0)::BIGINT AS {c}" for c in talk)},
            prompts, prompts AS turns, CASE WHEN prompts >= 2 THEN 'planning' WHEN prompts = 1 THEN 'mixed' END AS session_task_type
        FROM (SELECT CAST(conv_id AS VARCHAR) AS session_key, count(*) AS event_count,
                count(*) FILTER (WHERE role = 'user') AS prompts FROM conversations GROUP BY conv_id) c
        LEFT JOIN ({said}) s USING (session_key)"""


def _window_sql(extra: str = "") -> str:
    now = "TIMESTAMP '2024-01-30 12:00:00'"
    return f"""WITH {_RAW},
w(label, a, b) AS (VALUES ('today', TIMESTAMP '2024-01-30', {now}),
    ('7d', {now} - INTERVAL 7 DAY, {now}), ('30d', {now} - INTERVAL 30 DAY, {now}){extra}),
inw AS (SELECT w.label AS "window", CAST(user_id AS VARCHAR) AS session_key, tool.seq, tool.ts,
    category, row_number() OVER (PARTITION BY w.label, user_id ORDER BY tool.seq DESC) AS back_no
    FROM tool JOIN w ON ts >= a AND ts <= b),
wr AS (SELECT "window", session_key, min(ts) AS started_at, count(*) AS event_count,
    count(*) FILTER (WHERE category = 'read' AND back_no <= 50)
    / greatest(count(*) FILTER (WHERE category = 'mutation' AND back_no <= 50), 1) AS ratio
    FROM inw GROUP BY ALL)"""


def _cells(dim: str) -> str:
    return f"""SELECT {dim} AS dimension_value, metric_name, {_six('avg(value)', 'mean')},
    {_six('stddev_pop(value)', 'stdev')}, count(*) AS n, {_six('min(value)', 'min_value')},
    {_six('max(value)', 'max_value')} FROM rl WHERE {dim} IS NOT NULL GROUP BY ALL"""


_DAYS = "strftime(started_at, '%Y-%m-%d')"
_WEEK = "strftime(started_at, '%G-W%V')"


def _compare(in_a: str, in_b: str) -> str:
    """Welch's test; p by Simpson's rule on cos(x)^(df-1)."""
    return f"""
sides AS (SELECT metric_name, count(*) FILTER (WHERE {in_a}) AS n_a,
    avg(value) FILTER (WHERE {in_a}) AS mean_a, var_samp(value) FILTER (WHERE {in_a}) AS var_a,
    count(*) FILTER (WHERE {in_b}) AS n_b, avg(value) FILTER (WHERE {in_b}) AS mean_b,
    var_samp(value) FILTER (WHERE {in_b}) AS var_b FROM rl WHERE {in_a} OR {in_b}
    GROUP BY metric_name),
tt AS (SELECT *, var_a / n_a AS sa, var_b / n_b AS sb FROM sides),
td AS (SELECT *, CASE WHEN n_a >= 2 AND n_b >= 2 THEN CASE WHEN sa + sb > 0
        THEN (mean_a - mean_b) / sqrt(sa + sb) WHEN mean_a = mean_b THEN 0.0
        ELSE CAST('inf' AS DOUBLE) END END AS t,
    CASE WHEN n_a >= 2 AND n_b >= 2 AND sa + sb > 0
        THEN (sa + sb) ^ 2 / (sa ^ 2 / (n_a - 1) + sb ^ 2 / (n_b - 1)) END AS df FROM tt),
lim AS (SELECT *, least(pi() / 2, 12 / sqrt(df - 1)) AS top, atan(abs(t) / sqrt(df)) AS lo FROM td),
area AS (SELECT metric_name,
    sum(w * greatest(cos(lo + (top - lo) * i / 4000), 0) ^ (df - 1)) * (top - lo) AS tail,
    sum(w * greatest(cos(top * i / 4000), 0) ^ (df - 1)) * top AS whole
    FROM lim, (SELECT i, CASE WHEN i IN (0, 4000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END AS w
        FROM range(4001) r(i)) WHERE df IS NOT NULL GROUP BY metric_name, top, lo),
cmp AS (SELECT lim.*, CASE WHEN t IS NULL THEN NULL
        WHEN df IS NULL THEN CASE WHEN t = 0 THEN 1.0 ELSE 0.0 END
        WHEN lo >= top THEN 0.0 ELSE least(1.0, tail / whole) END AS p,
    mean_b - mean_a AS delta,
    (mean_b - mean_a) / nullif(mean_a, 0) * 100 AS delta_pct
    FROM lim LEFT JOIN area USING (metric_name))"""


_COMPARED = f"""SELECT metric_name, n_a, {_six('mean_a', 'mean_a')}, n_b, {_six('mean_b', 'mean_b')},
    CASE WHEN n_b = 0 THEN 'a' WHEN n_a = 0 THEN 'b' END AS only_in, {_six('delta', 'delta')},
    {_six('delta_pct', 'delta_pct')}, {_six('t', 't_statistic')}, {_six('p', 'p_value')},
    coalesce(p < 0.05, false) AS significant FROM cmp"""
_IN_A = "CAST(started_at AS DATE) BETWEEN DATE '2024-01-01' AND DATE '2024-01-14'"
_IN_B = "CAST(started_at AS DATE) BETWEEN DATE '2024-01-10' AND DATE '2024-01-30'"
_PRE, _POST = "started_at < DATE '2024-01-15'", "started_at >= DATE '2024-01-15'"

#: Conversations as reports, in the columns of ``BY_DAY``.
BY_TALK = f"""{_SAID}, d AS (SELECT *, {_doubled('text')} AS d FROM said),
h AS (SELECT *, {_words('and')} + {_words('und')} + len(regexp_extract_all(text, '(?i)que')) AS n,
    {_words('the')} + {_words('die')} + {_words('of the')} + len(regexp_extract_all(text, '(?i)ing')) AS s FROM d),
spoke AS (SELECT session_key, count(*) AS messages, count(*) FILTER (WHERE s > 0) AS with_hit, sum(n) AS matches FROM h GROUP BY session_key),
turned AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back_no,
    coalesce(length(text), 0) % 7 <> 0 AS ok FROM conversations),
rep AS (SELECT CAST(conv_id AS VARCHAR) AS session_key, conv_id % 3 AS tier, conv_id, 'model-' || (conv_id % 3) AS model,
    TIMESTAMP '2024-01-08' + (conv_id % 12) * INTERVAL 1 DAY + min(turn) * INTERVAL 1 SECOND AS started_at,
    count(*) FILTER (WHERE role = 'user') AS prompts,
    count(*) FILTER (WHERE ok AND back_no <= 200) / count(*) FILTER (WHERE back_no <= 200) AS health
    FROM turned GROUP BY conv_id),
longm AS (SELECT session_key, 'parse_health' AS metric_name, CAST(health AS DOUBLE) AS value FROM rep
    UNION ALL SELECT session_key, unnest(['read_edit_ratio', 'blind_edit_rate']), 0.0 FROM rep
    UNION ALL SELECT session_key, 'stop_phrase', coalesce(with_hit / messages, 0) FROM rep LEFT JOIN spoke USING (session_key)
    UNION ALL SELECT session_key, 'reasoning_loop', coalesce(matches, 0) * 1000.0 FROM rep LEFT JOIN spoke USING (session_key)
    UNION ALL SELECT session_key, 'user_turns', prompts FROM rep WHERE prompts > 0
    UNION ALL SELECT session_key, 'team.tier', tier FROM rep
    UNION ALL SELECT session_key, 'team.only_' || tier, conv_id % 10 FROM rep),
rl AS (SELECT l.*, r.model, r.started_at FROM longm l JOIN rep r USING (session_key))"""


def _one(expr: str) -> str:
    """A number with one place, halves away from zero."""
    return f"printf('%.1f', floor(CAST({expr} AS DOUBLE) * 10 + 0.5) / 10)"


_LISTING = """WITH cnt AS (SELECT user_id, count(*) FILTER (WHERE ts < DATE '2024-01-13') AS old_size,
    count(*) AS new_size,
    max(ts) FILTER (WHERE ts < DATE '2024-01-13') AS old_time,
    max(ts) AS new_time,
    '/logs/' || user_id || '.jsonl' AS path FROM events GROUP BY user_id)"""

_FLEET = f"""{BY_USER},
fl AS (SELECT session_key, user_id, 'project-' || (user_id % 20) AS project_key, ended_at,
    read_edit_ratio, CASE WHEN classified < 10 THEN 2 WHEN read_edit_ratio < 2 THEN 0
    WHEN read_edit_ratio < 4 THEN 1 ELSE 2 END AS r FROM metric)"""

# Fixed rules of the redaction queries, RE2 form. The long-token rule has nothing
# left to do there: the only such runs are 40-digit hashes, which it leaves alone.
_CLEAN = r"""regexp_replace(regexp_replace(text,
    '\b(token|secret|key|password)(\s*=\s*)"[^"]+"', '\1\2"[REDACTED]"', 'g'),
    '[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}', '[REDACTED]', 'g')"""

ORACLES: dict[str, str] = {
    "tool_category_counts": f"WITH {_RAW} SELECT tool_name, category, count(*) AS n FROM tool GROUP BY ALL",
    "last_calls_window": f"""{BY_USER} SELECT session_key, reads, research, mutations, other,
        window_calls, {_six('read_edit_ratio', 'read_edit_ratio')},
        {_six('research_mutation_ratio', 'research_mutation_ratio')} FROM metric""",
    "rolling_read_edit_ratio": f"""{BY_USER}, r AS (SELECT session_key, seq, call_no,
        {', '.join(f"count(*) FILTER (WHERE category = '{c}') OVER w AS {a}"
                   for c, a in (('read', 'reads'), ('research', 'research'), ('mutation', 'mutations')))}
        FROM calls WINDOW w AS (PARTITION BY session_key ORDER BY seq
        ROWS BETWEEN 49 PRECEDING AND CURRENT ROW))
        SELECT *, {_six('reads / greatest(mutations, 1)', 'read_edit_ratio')} FROM r""",
    "blind_edit_rows": f"""{BY_USER} SELECT session_key, seq, file_path, call_no, last_read,
        last_read IS NULL OR call_no - last_read > 20 AS blind FROM seen
        WHERE category = 'mutation' AND file_path IS NOT NULL""",
    "read_edit_metric": f"""{BY_USER} SELECT session_key, {_six('read_edit_ratio', 'read_edit_ratio')},
        mutations_total, mutations_with_path, blind_mutations, write_calls,
        mutations_total - write_calls AS edit_calls,
        {_six('tracking_confidence', 'tracking_confidence')}, {_six('blind_edit_rate', 'blind_edit_rate')},
        CASE WHEN tracking_confidence < 0.95 THEN 'insufficient data' END AS blind_edit_label,
        {_six('write_precision', 'write_precision')},
        CASE WHEN classified < 10 THEN 'ok' WHEN read_edit_ratio < 2 THEN 'critical'
            WHEN read_edit_ratio < 4 THEN 'warn' ELSE 'ok' END AS read_edit_severity,
        CASE WHEN classified < 10 THEN 'warming up'
            ELSE 'R:E ' || printf('%.1f', floor(CAST(reads * 10 AS DOUBLE) / greatest(mutations, 1)
                + 0.5) / 10) END AS read_edit_label FROM metric""",
    "stop_phrase_metric": f"""{_SAID},{_HITS},
        s AS (SELECT session_key, count(*) AS messages,
            count(*) FILTER (WHERE h0 + h1 + h2 + h3 > 0) AS messages_with_hit,
            sum(h0 + h1 + h2 + h3) AS hits, sum(h0 + h1) AS article, sum(h2) AS link,
            sum(h3) AS suffix FROM h GROUP BY session_key)
        SELECT session_key, messages, messages_with_hit, CAST(hits AS BIGINT) AS hits,
            CAST(article AS BIGINT) AS article, CAST(link AS BIGINT) AS link,
            CAST(suffix AS BIGINT) AS suffix,
            {_six('messages_with_hit / greatest(messages, 1)', 'stop_phrase')},
            CASE WHEN hits >= 3 THEN 'critical' WHEN hits >= 1 THEN 'warn' ELSE 'ok' END
                AS stop_phrase_severity,
            CAST(hits AS BIGINT) || ' stop-phrase hit(s)' AS stop_phrase_label FROM s""",
    "phrase_hit_spans": f"""{_SPANS} SELECT session_key, message_index, phrase, category, start, "end",
        matched, context_snippet FROM span""",
    "recent_phrase_hits": f"""{_SPANS} SELECT session_key, message_index, start, phrase, intent FROM span
        QUALIFY row_number() OVER (PARTITION BY session_key
            ORDER BY message_index DESC, start DESC, phrase DESC) <= 5""",
    "last_hit_intent": f"""{_SPANS} SELECT session_key, intent FROM span
        QUALIFY row_number() OVER (PARTITION BY session_key
            ORDER BY message_index DESC, start DESC, phrase DESC) = 1""",
    "document_phrase_counts": f"""WITH said AS (SELECT lang, text FROM documents WHERE length(text) > 0),
        {_HITS} SELECT lang, count(*) AS messages,
            count(*) FILTER (WHERE h0 + h1 + h2 + h3 > 0) AS messages_with_hit,
            CAST(sum(h0 + h1 + h2 + h3) AS BIGINT) AS hits FROM h GROUP BY lang""",
    "custom_phrase_counts": rf"""{_SAID}, d AS (SELECT *, {_doubled('text')} AS d FROM said),
        h AS (SELECT *, {_words('the')} AS a, len(regexp_extract_all(text, '(?i)ion')) AS b,
            len(regexp_extract_all(text, '(?i)th[ae]\w*')) AS c FROM d)
        SELECT session_key, count(*) AS messages, count(*) FILTER (WHERE a + b + c > 0) AS messages_with_hit,
            CAST(sum(a + b + c) AS BIGINT) AS hits, CAST(sum(a) AS BIGINT) AS words, CAST(sum(b) AS BIGINT) AS endings,
            CAST(sum(c) AS BIGINT) AS patterns, 2 AS rejected FROM h GROUP BY session_key""",
    "files_of_roots": """WITH r AS (SELECT CASE WHEN user_id % 3 = 0 AND user_id // 3 % 2 = 1 THEN 'top=0/inner=1'
            WHEN user_id % 3 < 2 THEN 'top=' || (user_id % 3) ELSE 'none' END AS root, user_id, event_id FROM events)
        SELECT root, count(*) AS lines, count(DISTINCT user_id) AS sessions, 1 AS ids, count(DISTINCT user_id) AS files,
            CAST(sum(length('{"n": ' || event_id || '}') + 1) AS BIGINT) AS bytes FROM r GROUP BY root""",
    "reasoning_loop_metric": f"""{_SAID}, d AS (SELECT *, {_doubled('text')} AS d FROM said),
        h AS (SELECT *, {_words('and')} + {_words('und')}
            + len(regexp_extract_all(text, '(?i)que')) AS n FROM d),
        i AS (SELECT *, sum(CASE WHEN n = 0 THEN 1 ELSE 0 END) OVER (
            PARTITION BY session_key ORDER BY turn ROWS UNBOUNDED PRECEDING) AS island FROM h),
        b AS (SELECT session_key, island, count(*) FILTER (WHERE n > 0) AS run, sum(n) AS n
            FROM i GROUP BY ALL)
        SELECT session_key, CAST(sum(n) AS BIGINT) AS loop_matches, CAST(0 AS BIGINT) AS tool_calls,
            max(run) AS max_burst, {_six('sum(n) * 1000.0', 'reasoning_loop')},
            'ok' AS reasoning_loop_severity,
            printf('%.1f', CAST(sum(n) * 1000 AS DOUBLE)) || '/1k warming up' AS reasoning_loop_label
        FROM b GROUP BY session_key""",
    "prompt_counts": """SELECT CAST(conv_id AS VARCHAR) AS session_key,
        count(*) FILTER (WHERE role = 'user') AS prompts FROM conversations GROUP BY conv_id""",
    "conversation_turns": f"""WITH c AS (SELECT *, TIMESTAMP '2024-01-01' + turn * INTERVAL 1 MINUTE AS ts,
            sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn
                ROWS UNBOUNDED PRECEDING) AS turn_no FROM conversations),
        a AS (SELECT conv_id, turn_no, min(ts) AS started_at, max(ts) AS last_ts,
            min_by(text, turn) AS user_message_text, count(*) AS event_count
            FROM c WHERE turn_no > 0 GROUP BY ALL),
        e AS (SELECT *, coalesce(lead(started_at) OVER (PARTITION BY conv_id ORDER BY turn_no),
            last_ts) AS ended_at FROM a)
        SELECT CAST(conv_id AS VARCHAR) AS session_key, CAST(turn_no AS BIGINT) AS turn_no,
            {_time('started_at')}, {_time('ended_at')}, user_message_text, event_count,
            CAST(0 AS BIGINT) AS n_tool_calls, 'planning' AS task_type FROM e""",
    "labelled_turns": f"""{_TURNS} SELECT session_key, turn_no, {_time('started_at')},
        {_time('ended_at')}, user_message_text, event_count, n_tool_calls, n_mutations, n_bash,
        n_lookups, task_type FROM tu""",
    "turn_tool_sequence": f"""{_TURNS} SELECT session_key, turn_no, row_number() OVER (
        PARTITION BY session_key, turn_no ORDER BY seq) AS tool_no, seq, tool_name
        FROM nt WHERE turn_no > 0 AND tool_name IS NOT NULL""",
    "turn_tool_parts": f"""{_TURNS} SELECT session_key, turn_no, count(*) AS n_tools,
        max_by(tool_name, seq) AS last_tool, min_by(tool_name, seq) AS first_tool
        FROM nt WHERE turn_no > 0 AND tool_name IS NOT NULL GROUP BY ALL""",
    "session_task_labels": f"""{_TURNS}, v AS (SELECT session_key, task_type, count(*) AS n FROM tu GROUP BY ALL),
        s AS (SELECT session_key, CAST(sum(n) AS BIGINT) AS n_turns, max(n) AS top_n,
            max_by(task_type, n) AS top FROM v GROUP BY session_key)
        SELECT session_key, n_turns, CASE WHEN n_turns >= 2 AND top_n * 2 > n_turns THEN top
            ELSE 'mixed' END AS session_task_type FROM s""",
    "turn_label_timeline": f"{_TURNS} SELECT session_key, turn_no, task_type FROM tu",
    "label_confusion": f"{_JUDGED} SELECT label AS actual, predicted, count(*) AS n FROM j GROUP BY ALL",
    "label_confusion_matrix": f"""{_JUDGED} SELECT label AS actual,
        count(*) FILTER (WHERE predicted = 'good') AS good,
        count(*) FILTER (WHERE predicted = 'poor') AS poor FROM j GROUP BY label""",
    "label_precision_recall": f"""{_JUDGED}, l AS (SELECT unnest(['good', 'poor']) AS label)
        SELECT l.label, (SELECT count(*) FROM j WHERE j.label = l.label AND predicted = l.label) AS tp,
        round((SELECT avg(CASE WHEN j.label = l.label THEN 1.0 ELSE 0 END) FROM j WHERE predicted = l.label), 6)
            AS precision,
        round((SELECT avg(CASE WHEN predicted = l.label THEN 1.0 ELSE 0 END) FROM j WHERE j.label = l.label), 6)
            AS recall FROM l""",
    "label_agreement": f"""{_JUDGED} SELECT count(*) AS sessions, count(*) FILTER (WHERE label = predicted) AS correct,
        {_six('count(*) FILTER (WHERE label = predicted) / count(*)', 'agreement')},
        count(*) FILTER (WHERE label = predicted) / count(*) >= 0.85 AS passes FROM j""",
    "label_misclassified": f"{_JUDGED} SELECT * FROM j WHERE label <> predicted",
    "line_outcomes": f"""{_LINES} SELECT line_class, ok, duplicate, count(*) AS lines,
        CAST(sum(parsed_events) AS BIGINT) AS parsed_events FROM lo GROUP BY ALL""",
    "parsed_events": f"""{_LINES} SELECT session_key, line_no, block_no, {_time('ts')}, kind, text,
        token_count, tool_name, tool_use_id, file_path, thinking_len, redacted, signature, message_id
        FROM ev""",
    "events_without_dedup": f"""{_LINES}, x AS (SELECT unnest(CASE event_type WHEN 'view' THEN ['tool_call']
            WHEN 'click' THEN ['assistant', 'tool_call', 'thinking'] WHEN 'purchase' THEN ['tool_call']
            WHEN 'signup' THEN ['user'] ELSE [] END) AS kind FROM lo)
        SELECT kind, count(*) AS n FROM x GROUP BY kind""",
    "events_corpus_dedup": f"""{_LINES}, f AS (SELECT *, message_id IS NOT NULL AND row_number() OVER (
            PARTITION BY message_id ORDER BY session_key, line_no) > 1 AS again FROM lo),
        x AS (SELECT unnest(CASE event_type WHEN 'view' THEN ['tool_call']
            WHEN 'click' THEN ['assistant', 'tool_call', 'thinking'] WHEN 'purchase' THEN ['tool_call']
            WHEN 'signup' THEN ['user'] ELSE [] END) AS kind FROM f WHERE NOT again)
        SELECT kind, count(*) AS n FROM x GROUP BY kind""",
    # Every call has its own tool id, so no block repeats another.
    "events_block_dedup": f"""{_LINES}, x AS (SELECT unnest(CASE event_type WHEN 'view' THEN ['tool_call']
            WHEN 'click' THEN ['assistant', 'tool_call', 'thinking'] WHEN 'purchase' THEN ['tool_call']
            WHEN 'signup' THEN ['user'] ELSE [] END) AS kind FROM lo)
        SELECT kind, count(*) AS n FROM x GROUP BY kind""",
    "parse_statistics": f"""{_LINES} SELECT session_key, total_lines,
        CAST(parsed_events AS BIGINT) AS parsed_events, duplicate_count,
        {_six('session_confidence', 'session_confidence')},
        {_six('parse_confidence', 'parse_confidence')} FROM st""",
    "missing_field_counts": f"""{_LINES} SELECT session_key,
        CASE line_class WHEN 'malformed' THEN '__json__' ELSE 'type' END AS field, count(*) AS n
        FROM lo WHERE line_class IN ('malformed', 'unknown_type') GROUP BY ALL""",
    "drift_code_counts": f"""{_LINES}, c AS (
        SELECT 'warn' AS level, 'malformed_line' AS code, session_key FROM lo WHERE line_class = 'malformed'
        UNION ALL SELECT 'warn', 'unknown_type', session_key FROM lo WHERE line_class = 'unknown_type'
        UNION ALL SELECT 'info', 'duplicate_message', session_key FROM lo WHERE duplicate
        UNION ALL SELECT DISTINCT 'warn', 'unknown_fingerprint', session_key FROM lo
            WHERE event_type = 'error' AND k % 3 <> 0)
        SELECT level, code, count(*) AS n, count(DISTINCT session_key) AS sessions FROM c GROUP BY ALL""",
    "unknown_line_shapes": f"""{_LINES} SELECT session_key,
        left(sha256('[["session_id","timestamp","type"],[["session_id","str"],["timestamp","str"],["type","str"]]]'), 16)
            AS fingerprint, min(line_no) AS first_line_no, count(*) AS lines
        FROM lo WHERE event_type = 'error' AND k % 3 <> 0 GROUP BY session_key""",
    "unknown_line_shapes_sampled": f"""{_LINES}, n AS (SELECT *, row_number() OVER (PARTITION BY session_key ORDER BY line_no) AS nth,
            row_number() OVER (PARTITION BY session_key, line_class = 'malformed' ORDER BY line_no) AS decoded FROM lo)
        SELECT session_key,
        left(sha256('[["session_id","timestamp","type"],[["session_id","str"],["timestamp","str"],["type","str"]]]'), 16)
            AS fingerprint, min(line_no) AS first_line_no, count(*) AS lines
        FROM n WHERE event_type = 'error' AND k % 3 <> 0 AND (decoded <= 10 OR nth % 500 = 0) GROUP BY session_key""",
    "unknown_tool_names": f"""{_LINES} SELECT session_key, 'Probe' || (line_no % 3) AS tool_name,
        min(line_no) AS first_line FROM ev WHERE tool_name = 'grep' GROUP BY ALL""",
    "typed_field_drift": f"""{_LINES} SELECT 'missing_required' AS code, 'message' AS field, count(*) AS n FROM lo
        WHERE event_type = 'purchase' OR (event_type = 'error' AND k % 3 <> 0)""",
    "parse_health_metric": f"""{_LINES}, n AS (SELECT session_key, count(*) AS events FROM ev GROUP BY ALL),
        b AS (SELECT session_key, parse_confidence AS p, (total_lines >= 50 OR coalesce(events, 0) >= 50)
            AND parse_confidence < 0.9 AS bad FROM st LEFT JOIN n USING (session_key))
        SELECT session_key, {_six('p', 'parse_health')}, CASE WHEN bad THEN 'critical' ELSE 'ok' END AS parse_health_severity,
        CASE WHEN bad THEN 'schema drift detected' ELSE 'parse healthy' END AS parse_health_label, bad AS critical FROM b""",
    "thinking_metric": f"""{_LINES}, t AS (SELECT session_key, count(*) AS b, count(*) FILTER (WHERE NOT redacted) AS v,
            median(CASE WHEN NOT redacted AND thinking_len > 0 THEN CAST(thinking_len AS DOUBLE) END) AS m,
            median(CASE WHEN length(signature) > 0 THEN CAST(length(signature) AS DOUBLE) END) AS s
            FROM ev WHERE kind = 'thinking' GROUP BY session_key)
        SELECT session_key, b AS thinking_blocks, v AS visible_blocks, b - v AS redacted_blocks, {_six('v / b', 'thinking')},
        {_six('m', 'visible_chars_median')}, {_six('s', 'signature_chars_median')},
        v || '/' || b || ' visible' AS thinking_label FROM t""",
    "session_numbers": f"""{_LINES}, p AS (SELECT *, sum(CASE WHEN kind = 'user' THEN 1 ELSE 0 END) OVER (
            PARTITION BY session_key ORDER BY line_no, block_no ROWS UNBOUNDED PRECEDING) AS turn_no FROM ev),
        a AS (SELECT session_key, turn_no, count(*) AS events, count(tool_name) AS calls,
            count(*) FILTER (WHERE tool_name = 'edit') AS edits, count(*) FILTER (WHERE tool_name = 'read') AS reads
            FROM p WHERE turn_no > 0 GROUP BY ALL),
        l AS (SELECT *, CASE WHEN edits >= 3 THEN 'mutation_heavy' WHEN calls = 0 THEN 'planning'
            WHEN edits < 2 AND reads > 2 * edits THEN 'exploration' ELSE 'mutation_heavy' END AS task_type FROM a)
        SELECT task_type, count(*) AS turns, CAST(sum(events) AS BIGINT) AS events FROM l GROUP BY task_type""",
    "transcript_reports": f"""{_LINES}, c AS (SELECT *, row_number() OVER (PARTITION BY session_key
            ORDER BY line_no DESC, block_no DESC) AS back_no FROM ev WHERE kind = 'tool_call'),
        r AS (SELECT session_key, count(*) FILTER (WHERE tool_name = 'read' AND back_no <= 50)
            / greatest(count(*) FILTER (WHERE tool_name = 'edit' AND back_no <= 50), 1) AS ratio,
            count(*) FILTER (WHERE tool_name = 'edit') AS edits FROM c GROUP BY session_key),
        e AS (SELECT session_key, min(ts) AS started_at, max(ts) AS ended_at, count(*) AS event_count,
            count(*) FILTER (WHERE kind = 'user') AS users, count(*) FILTER (WHERE kind = 'thinking') AS th,
            count(*) FILTER (WHERE kind = 'thinking' AND NOT redacted) AS vis FROM ev GROUP BY session_key)
        SELECT session_key, {_time('started_at')}, {_time('ended_at')},
            {_six('(epoch_us(ended_at) - epoch_us(started_at)) / 1e6', 'duration_seconds')}, event_count,
            {_six('parse_confidence', 'parse_confidence')}, {_six('parse_confidence', 'parse_health')},
            {_six('coalesce(ratio, 0)', 'read_edit_ratio')},
            CASE WHEN edits > 0 THEN CAST(0 AS DOUBLE) END AS write_precision,
            CASE WHEN users > 0 THEN CAST(users AS DOUBLE) END AS user_turns,
            CASE WHEN th > 0 THEN {_six('vis / th', 'x').split(' AS x')[0]} END AS thinking_visible_ratio
        FROM e LEFT JOIN r USING (session_key) LEFT JOIN st USING (session_key)""",
    "reports_in_window": f"""{_LINES},
        conf AS (SELECT session_key, count(*) FILTER (WHERE ok) / count(*) AS p FROM (
            SELECT *, row_number() OVER (PARTITION BY session_key ORDER BY line_no DESC) AS b2 FROM lo)
            WHERE b2 <= 200 GROUP BY session_key),
        e AS (SELECT session_key, min(ts) AS started_at, max(ts) AS ended_at, count(*) AS event_count FROM ev
            WHERE ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-20' GROUP BY session_key)
        SELECT session_key, {_time('started_at')}, {_time('ended_at')}, event_count, {_six('p', 'parse_confidence')}
        FROM e JOIN conf USING (session_key)""",
    "reports_in_window_stopped": f"""{_LINES}, stop AS (SELECT session_key, min(line_no) AS cut FROM ev
            WHERE ts > TIMESTAMP '2024-01-20' GROUP BY session_key),
        seen AS (SELECT lo.*, row_number() OVER (PARTITION BY session_key ORDER BY line_no DESC) AS b2
            FROM lo LEFT JOIN stop USING (session_key) WHERE cut IS NULL OR line_no < cut),
        conf AS (SELECT session_key, count(*) FILTER (WHERE ok) / count(*) AS p FROM seen WHERE b2 <= 200 GROUP BY session_key),
        e AS (SELECT session_key, min(ts) AS started_at, max(ts) AS ended_at, count(*) AS event_count FROM ev
            WHERE ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-20' GROUP BY session_key)
        SELECT session_key, {_time('started_at')}, {_time('ended_at')}, event_count, {_six('p', 'parse_confidence')}
        FROM e JOIN conf USING (session_key)""",
    "reports_by_window": f"""{_window_sql()} SELECT "window", session_key, {_time('started_at')}, event_count,
        {_six('ratio', 'read_edit_ratio')} FROM wr""",
    "sessions_per_window": f"""{_window_sql(", ('future', TIMESTAMP '2030-01-01', TIMESTAMP '2030-01-02')")}
        SELECT w.label AS "window", count(session_key) AS sessions FROM w LEFT JOIN wr ON wr."window" = w.label
        GROUP BY w.label""",
    "metrics_long": f"{BY_DAY} SELECT session_key, metric_name, {_six('value', 'value')} FROM rl",
    "metric_snapshots": f"""{BY_USER}
        SELECT session_key, 'parse_health' AS metric_name, CAST(1 AS DOUBLE) AS value, 'ok' AS severity, 'parse healthy' AS label FROM metric
        UNION ALL SELECT session_key, 'read_edit_ratio', round(read_edit_ratio, 6),
            CASE WHEN classified < 10 THEN 'ok' WHEN read_edit_ratio < 2 THEN 'critical' WHEN read_edit_ratio < 4 THEN 'warn' ELSE 'ok' END,
            CASE WHEN classified < 10 THEN 'warming up' ELSE 'R:E ' || printf('%.1f',
                floor(CAST(reads * 10 AS DOUBLE) / greatest(mutations, 1) + 0.5) / 10) END FROM metric
        UNION ALL SELECT session_key, 'stop_phrase', 0, 'ok', '0 stop-phrase hit(s)' FROM metric
        UNION ALL SELECT session_key, 'reasoning_loop', 0, 'ok',
            CASE WHEN event_count < 20 THEN '0.0/1k warming up' ELSE '0.0/1k tool calls' END FROM metric
        UNION ALL SELECT session_key, 'thinking', 0, 'ok', 'no thinking blocks' FROM metric
        UNION ALL SELECT session_key, 'prompts', 0, 'ok', '0 user turns' FROM metric""",
    "snapshots_while_learning": f"""{BY_USER} SELECT unnest(['parse_health', 'read_edit_ratio', 'stop_phrase',
        'reasoning_loop', 'thinking', 'prompts']) AS metric_name, 'ok' AS severity, count(*) AS n FROM metric""",
    "value_trend_by_day": """WITH d AS (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY ALL),
        r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY day DESC) AS b FROM d),
        g AS (SELECT user_id, string_agg(n, ',' ORDER BY day) AS history,
            sum(CASE b WHEN 1 THEN n WHEN 2 THEN -n ELSE 0 END) AS step, count(*) AS c FROM r WHERE b <= 3 GROUP BY user_id)
        SELECT CAST(user_id AS VARCHAR) AS session_key, CASE WHEN c < 2 OR step = 0 THEN '→' WHEN step > 0 THEN '↗' ELSE '↘' END AS arrow,
            history FROM g""",
    "custom_metric": f"""WITH {_RAW} SELECT CAST(user_id AS VARCHAR) AS session_key,
        CAST(count(DISTINCT file_path) AS DOUBLE) AS files FROM tool GROUP BY user_id""",
    "session_states": """WITH q AS (SELECT user_id, greatest((epoch_us(TIMESTAMP '2024-01-30 23:40:00') - epoch_us(max(ts))) / 1e6, 0) AS s
            FROM events GROUP BY user_id)
        SELECT CAST(user_id AS VARCHAR) AS session_key, round(s, 6) AS silence_seconds,
            CASE WHEN s >= 2100 THEN 'evicted' WHEN s >= 300 THEN 'stale' ELSE 'active' END AS state FROM q""",
    "fleet_size": """WITH q AS (SELECT user_id, (epoch_us(TIMESTAMP '2024-01-30 23:40:00') - epoch_us(max(ts))) / 1e6 AS s
            FROM events GROUP BY user_id)
        SELECT count(*) FILTER (WHERE s < 2100) AS cohort_size, count(*) FILTER (WHERE s >= 2100) AS eviction_churn FROM q""",
    "session_keys": """WITH p AS (SELECT DISTINCT user_id, '/data/projects/p' || (user_id % 20) AS dir FROM events)
        SELECT dir || '/' || user_id || '.jsonl' AS path, 'root-' || left(sha256(dir), 12) || ':' || user_id AS session_key,
            CAST(user_id AS VARCHAR) AS session_id, 'p' || (user_id % 20) AS project_hash, 'root-legacy:' || user_id AS legacy_key FROM p""",
    "root_matches": """WITH p AS (SELECT DISTINCT '/data/projects/p' || (user_id % 20) || '/' || user_id || '.jsonl' AS path,
            CASE user_id % 20 WHEN 1 THEN '/data/projects/p1' WHEN 2 THEN '/data/projects/p2' ELSE '/data/projects' END AS root_path FROM events)
        SELECT path, root_path, 'root-' || left(sha256(root_path), 12) AS root_id FROM p""",
    "project_display_names": """WITH u AS (SELECT user_id, min(CASE WHEN event_type = 'signup' AND user_id % 3 <> 0 THEN event_id END) AS e
            FROM events GROUP BY user_id)
        SELECT sha256(CAST(user_id AS VARCHAR)) AS project_hash, CASE WHEN user_id % 7 = 0 THEN 'named-' || user_id
            WHEN e IS NOT NULL THEN 'work' || e ELSE left(sha256(CAST(user_id AS VARCHAR)), 8) END AS project_name FROM u""",
    "report_flags": f"{_LINES} SELECT false AS show_root, coalesce(bool_or(parse_confidence < 0.9), false) AS unhealthy FROM st",
    "report_validation": f"""{BY_DAY}, v AS (SELECT session_key, CASE WHEN user_id % 11 = 0 THEN 'newer schema_version'
            WHEN user_id % 13 = 0 THEN 'missing project_hash' ELSE 'ok' END AS reason,
            CASE WHEN user_id % 11 = 1 THEN 'root-legacy:' || session_key ELSE session_key END AS k FROM rep)
        SELECT reason, count(*) AS n, min(k) AS first_key FROM v GROUP BY reason""",
    "cohort_by_day": f"{BY_DAY} {_cells(_DAYS)}",
    "cohort_by_week": f"{BY_DAY} {_cells(_WEEK)}",
    "cohort_by_project": f"{BY_DAY} {_cells('project_hash')}",
    "cohort_by_model": f"{BY_DAY} {_cells('model')}",
    "cohort_by_permission_mode": f"{BY_DAY} {_cells('permission_mode')}",
    "cohort_headers": f"""{BY_DAY} SELECT 'model' AS dimension, count(*) AS session_count,
            count(*) FILTER (WHERE model IS NULL) AS excluded_null_count,
            strftime(min(started_at), '%Y-%m-%d') || '..' || strftime(max(started_at), '%Y-%m-%d') AS date_range FROM rep
        UNION ALL SELECT 'week', count(*), 0, strftime(min(started_at), '%Y-%m-%d') || '..' || strftime(max(started_at), '%Y-%m-%d') FROM rep""",
    "cohort_guarded": f"""{BY_DAY}, c AS (SELECT project_hash AS dimension_value, metric_name, avg(value) AS m,
            stddev_pop(value) AS s, count(*) AS n, min(value) AS lo, max(value) AS hi FROM rl GROUP BY ALL)
        SELECT dimension_value, metric_name, n, CASE WHEN n >= 60 THEN printf('%.2f', m) ELSE 'n<60' END AS display,
            CASE WHEN n >= 60 THEN round(m, 6) END AS mean, CASE WHEN n >= 60 THEN round(s, 6) END AS stdev,
            CASE WHEN n >= 60 THEN round(lo, 6) END AS min_value, CASE WHEN n >= 60 THEN round(hi, 6) END AS max_value FROM c""",
    "cohort_trend": f"""{BY_DAY}, c AS (SELECT {_DAYS} AS dimension_value, metric_name, avg(value) AS m, count(*) AS n FROM rl GROUP BY ALL),
        p AS (SELECT *, last_value(CASE WHEN n >= 5 THEN m END IGNORE NULLS) OVER (PARTITION BY metric_name ORDER BY dimension_value
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior FROM c)
        SELECT dimension_value, metric_name, n, 'ok' AS severity, CASE WHEN n >= 5 THEN round(m - prior, 6) + 0.0 END AS delta FROM p""",
    "cohort_size_distribution": f"""{BY_DAY}, c AS (SELECT {_DAYS} AS d, metric_name, count(*) AS n FROM rl GROUP BY ALL)
        SELECT b AS n_range, (SELECT count(*) FROM c WHERE CASE WHEN n < 5 THEN 'n<5' WHEN n < 10 THEN '5-9'
            WHEN n < 25 THEN '10-24' ELSE '25+' END = b) AS cell_count FROM (SELECT unnest(['n<5', '5-9', '10-24', '25+']) AS b)""",
    "cohort_summary": f"""{BY_DAY}, c AS (SELECT {_WEEK} AS d, metric_name, count(*) AS n FROM rl GROUP BY ALL)
        SELECT count(DISTINCT d) AS buckets, count(DISTINCT metric_name) AS metrics, count(*) AS cells,
            count(*) FILTER (WHERE n < 5) AS redacted FROM c""",
    "cohort_trend_table": f"""{BY_DAY}, c AS (SELECT {_WEEK} AS w, count(DISTINCT session_key) AS n FROM rl GROUP BY ALL)
        SELECT w AS dimension_value,
            CASE WHEN n < 5 THEN 'n<5' ELSE '1.00 ± 0.00 (n=' || n || ')' || CASE WHEN row_number() OVER (ORDER BY w) > 1 THEN ' [Δ+0.00]' ELSE '' END END AS parse_health,
            CASE WHEN n < 5 THEN 'n<5' ELSE '0.00 ± 0.00 (n=' || n || ')' || CASE WHEN row_number() OVER (ORDER BY w) > 1 THEN ' [Δ+0.00]' ELSE '' END END AS reasoning_loop,
            CASE WHEN n < 5 THEN 'n<5' ELSE '0.00 ± 0.00 (n=' || n || ')' || CASE WHEN row_number() OVER (ORDER BY w) > 1 THEN ' [Δ+0.00]' ELSE '' END END AS stop_phrase
        FROM c""",
    "cohort_top_movers": f"""{BY_DAY}, c AS (SELECT {_WEEK} AS w, metric_name, avg(value) AS m, count(*) AS n FROM rl GROUP BY ALL HAVING count(*) >= 5),
        e AS (SELECT metric_name, min(w) AS first_value, max(w) AS last_value, min_by(m, w) AS a, max_by(m, w) AS b FROM c GROUP BY metric_name)
        SELECT metric_name, first_value, last_value, round(a, 6) AS first_mean, round(b, 6) AS last_mean,
            round((b - a) / abs(a) * 100, 6) AS pct_change FROM e WHERE first_value <> last_value AND a <> 0
        ORDER BY abs((b - a) / abs(a)) DESC, metric_name LIMIT 3""",
    "cohort_in_period": f"""{BY_DAY} SELECT project_hash, count(*) AS n FROM rep
        WHERE CAST(started_at AS DATE) BETWEEN DATE '2024-01-10' AND DATE '2024-01-12' GROUP BY project_hash""",
    "long_periods": """WITH s AS (SELECT user_id, datediff('day', CAST(min(ts) AS DATE), CAST(max(ts) AS DATE)) AS days FROM events GROUP BY user_id)
        SELECT user_id, CAST(days AS INT) AS days FROM s WHERE days >= 28""",
    "compare_periods": f"{BY_DAY},{_compare(_IN_A, _IN_B)} {_COMPARED}",
    "compare_models": f"""{BY_DAY},{_compare("model IS NOT DISTINCT FROM 'model-1'", "model IS NOT DISTINCT FROM 'model-2'")} {_COMPARED}""",
    "pivot_comparison": f"{BY_DAY},{_compare(_PRE, _POST)} {_COMPARED}",
    "comparison_sentences": f"""{BY_DAY},{_compare(_PRE, _POST)} SELECT metric_name,
        CASE WHEN n_a < 5 OR n_b < 5 THEN 'insufficient data' WHEN delta > 0 THEN 'rose' WHEN delta < 0 THEN 'fell'
            ELSE 'held steady' END AS word FROM cmp WHERE n_a > 0 AND n_b > 0""",
    "talk_compare_models": f"""{BY_TALK},{_compare("model = 'model-1'", "model = 'model-2'")} {_COMPARED.replace(_six('t', 't_statistic'),
        "CASE WHEN isinf(t) THEN t ELSE round(t, 6) + 0.0 END AS t_statistic")}""",
    "talk_trend": f"""{BY_TALK}, c AS (SELECT {_DAYS} AS dimension_value, metric_name, avg(value) AS m, count(*) AS n FROM rl GROUP BY ALL),
        p AS (SELECT *, last_value(CASE WHEN n >= 5 THEN m END IGNORE NULLS) OVER (PARTITION BY metric_name ORDER BY dimension_value
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior FROM c)
        SELECT dimension_value, metric_name, n, CASE WHEN n < 5 THEN 'ok' WHEN metric_name = 'parse_health' AND m < 0.9 THEN 'critical'
            WHEN metric_name = 'reasoning_loop' AND m >= 20 THEN 'critical' WHEN metric_name = 'reasoning_loop' AND m >= 10 THEN 'warn'
            WHEN metric_name = 'stop_phrase' AND m >= 3 THEN 'critical' WHEN metric_name = 'stop_phrase' AND m >= 1 THEN 'warn' ELSE 'ok' END AS severity,
            {_six('m', 'mean')}, CASE WHEN n >= 5 THEN round(m - prior, 6) + 0.0 END AS delta FROM p""",
    "talk_sentences": f"""{BY_TALK},{_compare(_PRE, _POST)} SELECT metric_name, CASE WHEN n_a < 5 OR n_b < 5
            THEN 'insufficient data in one period (n_a=' || n_a || ', n_b=' || n_b || ') — not reported.'
            ELSE CASE WHEN delta > 0 THEN 'rose' WHEN delta < 0 THEN 'fell' ELSE 'held steady' END || ' from ' || {_one('mean_a')}
                || ' to ' || {_one('mean_b')} || ' over the w window; n=' || n_a || ', n=' || n_b END AS line
        FROM cmp WHERE n_a > 0 AND n_b > 0""",
    "talk_correlations": f"""{BY_TALK}, p AS (SELECT a.metric_name AS metric_a, b.metric_name AS metric_b, count(*) AS n,
            covar_pop(a.value, b.value) AS c, stddev_pop(a.value) * stddev_pop(b.value) AS s
            FROM longm a JOIN longm b ON a.session_key = b.session_key AND a.metric_name < b.metric_name GROUP BY ALL)
        SELECT metric_a, metric_b, n, {_six('c / s', 'r')} FROM p WHERE n >= 30 AND s > 0""",
    "comparison_movers": f"""{BY_DAY},{_compare(_IN_A, _IN_B)} SELECT metric_name, {_six('delta_pct', 'delta_pct')} FROM cmp
        WHERE delta_pct IS NOT NULL AND n_a >= 5 AND n_b >= 5 ORDER BY abs(delta_pct) DESC, metric_name LIMIT 2""",
    "metric_correlations": f"""{BY_DAY}, p AS (SELECT a.metric_name AS metric_a, b.metric_name AS metric_b, count(*) AS n,
            covar_pop(a.value, b.value) AS c, stddev_pop(a.value) * stddev_pop(b.value) AS s
            FROM longm a JOIN longm b ON a.session_key = b.session_key AND a.metric_name < b.metric_name GROUP BY ALL)
        SELECT metric_a, metric_b, n, {_six('c / s', 'r')} FROM p WHERE n >= 30 AND s > 0""",
    "history_severities": f"{BY_DAY} SELECT session_key, {_SEV.format('band')} AS severity FROM worst",
    "history_filtered": f"""{BY_DAY} SELECT session_key FROM rep JOIN worst USING (session_key)
        WHERE CAST(started_at AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-25' AND band = 0
        AND model = 'model-1' AND permission_mode = 'mode-1' AND session_task_type = 'mixed'""",
    "history_by_project": f"""{BY_DAY} SELECT session_key, 'name' AS by FROM rep WHERE project_name = 'name-3'
        UNION ALL SELECT session_key, 'hash' FROM rep WHERE project_hash = 'project-4'""",
    "history_list": f"""{BY_DAY},
        top AS (SELECT session_key, metric_name, value, row_number() OVER (PARTITION BY session_key ORDER BY abs(value) DESC, metric_name) AS r FROM longm),
        tops AS (SELECT session_key, string_agg(metric_name || '=' || printf('%.2f', floor(value * 100 + 0.5) / 100), ', ' ORDER BY r) AS metrics_summary
            FROM top WHERE r <= 2 GROUP BY session_key),
        d AS (SELECT *, CAST(floor((epoch_us(ended_at) - epoch_us(started_at)) / 1e6) AS BIGINT) AS secs FROM rep)
        SELECT session_key, left(session_key, 12) AS short_id, coalesce(project_name, project_hash) AS project,
            strftime(started_at, '%Y-%m-%d %H:%M') AS started_at,
            CASE WHEN secs < 60 THEN secs || 's' WHEN secs < 3600 THEN (secs // 60) || 'm' || lpad(CAST(secs % 60 AS VARCHAR), 2, '0') || 's'
                ELSE (secs // 3600) || 'h' || lpad(CAST(secs // 60 % 60 AS VARCHAR), 2, '0') || 'm' END AS duration,
            {_SEV.format('band')} AS severity, coalesce(model, '—') AS model, coalesce(permission_mode, '—') AS permission_mode,
            metrics_summary, coalesce(session_task_type, '—') AS task_type
        FROM d JOIN worst USING (session_key) JOIN tops USING (session_key)""",
    "history_diff": f"""{BY_DAY}, a AS (SELECT * FROM longm WHERE session_key = '1-2024-01-01'), b AS (SELECT * FROM longm WHERE session_key = '1-2024-01-02')
        SELECT metric_name, {_six('a.value', 'value_a')}, {_six('b.value', 'value_b')}, {_six('b.value - a.value', 'delta')},
            CASE WHEN b.value IS NULL THEN 'b' WHEN a.value IS NULL THEN 'a' END AS absent_in FROM a FULL JOIN b USING (metric_name)""",
    "history_diff_next_day": f"""{BY_DAY}, pr AS (SELECT x.session_key AS key_a, y.session_key AS key_b FROM rep x JOIN rep y
            ON y.session_key = x.user_id || '-' || strftime(CAST(x.started_at AS DATE) + 1, '%Y-%m-%d')),
        a AS (SELECT key_a, key_b, metric_name, value FROM pr JOIN longm ON session_key = key_a),
        b AS (SELECT key_a, key_b, metric_name, value FROM pr JOIN longm ON session_key = key_b)
        SELECT key_a, key_b, metric_name, {_six('a.value', 'value_a')}, {_six('b.value', 'value_b')}, {_six('b.value - a.value', 'delta')},
            CASE WHEN b.value IS NULL THEN 'b' WHEN a.value IS NULL THEN 'a' END AS absent_in
        FROM a FULL JOIN b USING (key_a, key_b, metric_name)""",
    "history_detail": f"{BY_DAY} SELECT session_key, metric_name, {_six('value', 'value')}, {_SEV.format('band')} AS severity FROM banded",
    "history_heatmap": f"""{BY_DAY}, m AS (SELECT *, max(value) OVER (PARTITION BY session_key, band) AS mx FROM banded)
        SELECT session_key, metric_name, CASE WHEN band = 2 THEN round(value, 6) END AS ok_value, CASE WHEN band = 1 THEN round(value, 6) END AS warn_value,
            CASE WHEN band = 0 THEN round(value, 6) END AS crit_value, round(mx, 6) AS column_max, round(value / nullif(mx, 0), 6) AS share_of_max FROM m""",
    "history_task_cross_tab": f"""{BY_DAY}, m AS (SELECT metric_name, coalesce(session_task_type, '(unclassified)') AS task_type, avg(value) AS mean,
            count(*) AS n FROM rl GROUP BY ALL)
        SELECT metric_name, task_type, round(mean, 6) AS mean, n, round(max(mean) OVER (PARTITION BY task_type), 6) AS column_max FROM m""",
    "history_task_cross_table": f"""{BY_DAY} SELECT metric_name, {_six("avg(value) FILTER (WHERE session_task_type IS NULL)", '"(unclassified)"')},
        {_six("avg(value) FILTER (WHERE session_task_type = 'mixed')", 'mixed')},
        {_six("avg(value) FILTER (WHERE session_task_type = 'planning')", 'planning')} FROM rl GROUP BY metric_name""",
    "fleet_projects": f"""{_FLEET} SELECT project_key, count(*) AS sessions,
        CASE min(r) WHEN 0 THEN 'critical' WHEN 1 THEN 'warn' ELSE 'ok' END AS severity, {_time('max(ended_at)', 'updated_at')},
        round(min_by(read_edit_ratio, r || '/' || session_key), 6) AS read_edit_ratio FROM fl GROUP BY project_key""",
    "fleet_overlay": f"""{_FLEET} SELECT project_key, count(*) AS sessions, CASE WHEN any_value(user_id % 20) < 8 THEN 'live' ELSE 'stored' END AS origin
        FROM fl GROUP BY project_key""",
    "fleet_recent_projects": f"""{BY_DAY}, g AS (SELECT coalesce(project_name, left(project_hash, 8)) AS project_key, session_key, ended_at, read_edit_ratio FROM rep)
        SELECT project_key, count(*) AS session_count, {_time('max(ended_at)', 'last_event_time')}, max_by(session_key, ended_at) AS session_key,
            round(max_by(read_edit_ratio, ended_at), 6) AS read_edit_ratio FROM g GROUP BY project_key ORDER BY max(ended_at) DESC, project_key LIMIT 6""",
    "fleet_counters": f"""{_FLEET} SELECT count(*) FILTER (WHERE r = 0) AS critical, count(*) FILTER (WHERE r = 1) AS warn,
        count(*) FILTER (WHERE r = 2) AS ok, count(*) AS sessions, count(DISTINCT project_key) AS projects FROM fl""",
    "fleet_worst_first": f"""{_FLEET} SELECT session_key, CAST(r AS INT) AS severity_rank, (SELECT count(*) FROM fl) AS total FROM fl
        ORDER BY r, ended_at DESC, session_key LIMIT 10""",
    "fleet_percentiles": f"""{BY_DAY}, base AS (SELECT metric_name, value FROM longm WHERE {_PRE}),
        cnt AS (SELECT metric_name, value, count(*) AS n FROM base GROUP BY ALL), tot AS (SELECT metric_name, count(*) AS t FROM base GROUP BY ALL),
        cur AS (SELECT session_key, metric_name, value FROM longm WHERE {_POST}),
        dv AS (SELECT DISTINCT metric_name, value FROM cur),
        le AS (SELECT dv.metric_name, dv.value, coalesce(sum(n), 0) AS le FROM dv LEFT JOIN cnt ON cnt.metric_name = dv.metric_name AND cnt.value <= dv.value GROUP BY ALL)
        SELECT session_key, metric_name, {_six('value', 'value')}, CAST(round_even(le * 100 / t, 0) AS INT) AS percentile
        FROM cur JOIN le USING (metric_name, value) JOIN tot USING (metric_name)""",
    "bootstrap_thresholds": f"""{BY_USER}, f AS (SELECT session_key FROM metric ORDER BY ended_at, session_key LIMIT 10),
        q AS (SELECT metric_name, count(*) AS n, quantile_cont(value, [0.05, 0.2, 0.8, 0.95]) AS q FROM longm
            WHERE session_key IN (SELECT session_key FROM f) AND metric_name <> 'parse_health' GROUP BY metric_name)
        SELECT metric_name, n, round(CASE metric_name WHEN 'read_edit_ratio' THEN greatest(q[2], 4.0) WHEN 'stop_phrase' THEN least(q[3], 1.0) ELSE q[3] END, 6) AS warn,
            round(CASE metric_name WHEN 'read_edit_ratio' THEN least(q[1], 2.0) WHEN 'stop_phrase' THEN greatest(q[4], 3.0) ELSE q[4] END, 6) AS critical FROM q""",
    "frozen_thresholds": f"""{BY_DAY}, f AS (SELECT session_key FROM metric WHERE started_at < TIMESTAMP '2024-01-05'
            ORDER BY CAST(started_at AS DATE), ended_at, session_key LIMIT 150),
        q AS (SELECT metric_name, count(*) AS n, quantile_cont(value, [0.05, 0.2, 0.8, 0.95]) AS q FROM longm
            WHERE session_key IN (SELECT session_key FROM f) AND metric_name <> 'parse_health' GROUP BY metric_name)
        SELECT metric_name, n, round(CASE metric_name WHEN 'read_edit_ratio' THEN greatest(q[2], 4.0) WHEN 'stop_phrase' THEN least(q[3], 1.0) ELSE q[3] END, 6) AS warn,
            round(CASE metric_name WHEN 'read_edit_ratio' THEN least(q[1], 2.0) WHEN 'stop_phrase' THEN greatest(q[4], 3.0) ELSE q[4] END, 6) AS critical FROM q""",
    "bootstrap_not_ready": """SELECT 'x' AS metric_name, CAST(0 AS BIGINT) AS n, CAST(0 AS DOUBLE) AS warn, CAST(0 AS DOUBLE) AS critical
        FROM events WHERE false""",
    "recalibrated_thresholds": f"""{BY_DAY} SELECT metric_name, count(*) AS n, round(quantile_cont(value, 0.8), 6) AS warn,
        round(quantile_cont(value, 0.95), 6) AS critical FROM longm
        WHERE metric_name IN ('read_edit_ratio', 'stop_phrase', 'reasoning_loop') GROUP BY metric_name""",
    "exact_value_quantiles": """SELECT event_type, count(*) AS total, round(quantile_cont(value, 0.05), 6) AS q0, round(quantile_cont(value, 0.2), 6) AS q1,
        round(quantile_cont(value, 0.5), 6) AS q2, round(quantile_cont(value, 0.8), 6) AS q3, round(quantile_cont(value, 0.95), 6) AS q4
        FROM events GROUP BY event_type""",
    # A cut-off first line has no readable time, so its session stays.
    "started_between": """WITH f AS (SELECT user_id, count(*) AS lines, min_by(CASE WHEN event_type = 'error'
            AND CAST(regexp_extract(props, '[0-9]+') AS INT) % 3 = 0 THEN NULL ELSE 1 END, event_id) AS x,
            arg_min(event_type = 'error' AND CAST(regexp_extract(props, '[0-9]+') AS INT) % 3 = 0, event_id) AS bad,
            arg_min(ts, event_id) AS t FROM events GROUP BY user_id)
        SELECT CAST(user_id AS VARCHAR) AS session_key, lines FROM f
        WHERE bad OR t BETWEEN TIMESTAMP '2024-01-01 06:00:00' AND TIMESTAMP '2024-01-02'""",
    "unread_lines": """WITH d AS (SELECT user_id, max(event_id) FILTER (WHERE event_id % 1000 < 500) AS done FROM events GROUP BY user_id)
        SELECT CAST(user_id AS VARCHAR) AS session_key, count(*) AS lines FROM events JOIN d USING (user_id)
        WHERE event_id > coalesce(done, 0) GROUP BY user_id""",
    "conversation_events": f"""SELECT CAST(conv_id AS VARCHAR) AS session_key, CAST(turn AS BIGINT) AS line_no,
        ['tool_result', 'system', 'assistant', 'user', 'assistant'][turn % 5 + 1] AS kind,
        CASE WHEN turn % 5 = 4 THEN 'other' ELSE CAST(conv_id AS VARCHAR) END AS event_session_id,
        CASE WHEN turn % 5 = 0 THEN 't' || turn END AS tool_use_id,
        CASE WHEN turn % 5 = 0 THEN turn % 2 = 0 END AS is_error,
        CASE WHEN turn % 5 = 1 THEN 'note' END AS subkind, turn % 5 <> 3 AS ts_resolved,
        md5(CASE turn % 5 WHEN 0 THEN coalesce(text, '') || chr(10) || 'more' WHEN 1 THEN '' ELSE coalesce(text, '') END) AS said_md5,
        CASE WHEN turn % 5 = 1 THEN '/home/user/x' END AS cwd,
        {_T.format("TIMESTAMP '2024-01-01' + to_seconds(CASE WHEN turn % 5 = 3 THEN 0 ELSE conv_id * 3600 + turn * 60 END)")} AS ts
        FROM conversations""",
    "conversation_missing_fields": """SELECT
        CASE turn % 5 WHEN 1 THEN 'system' WHEN 2 THEN 'flat_list' WHEN 4 THEN 'flat' ELSE 'message' END AS line_class,
        true AS ok, CASE WHEN turn % 5 = 3 THEN 'timestamp' ELSE '' END AS missing, count(*) AS lines
        FROM conversations GROUP BY ALL""",
    "file_lines": f"""{_LINES} SELECT session_key AS session, count(*) AS lines, count(*) AS complete_lines,
        count(*) AS numbers FROM ln GROUP BY session_key""",
    "file_changes": f"""{_LISTING}, o AS (SELECT * FROM cnt WHERE old_size > 0 AND user_id % 10 <> 0),
        n AS (SELECT *, CASE WHEN user_id % 8 = 0 THEN 0 ELSE new_size END AS size FROM cnt WHERE new_size > 0 AND user_id % 9 <> 0),
        j AS (SELECT coalesce(o.path, n.path) AS path, o.old_size, n.size, n.user_id, CASE WHEN o.path IS NULL THEN 'NEW' WHEN n.path IS NULL THEN 'DELETE'
            WHEN n.user_id % 7 = 0 THEN 'ROTATE' WHEN n.size < o.old_size THEN 'TRUNCATE' WHEN n.size > o.old_size THEN 'APPEND' ELSE 'SAME' END AS change
            FROM o FULL JOIN n ON o.path = n.path),
        g AS (SELECT *, coalesce(size, 0) - CASE WHEN change IN ('NEW', 'ROTATE', 'TRUNCATE') THEN 0 ELSE coalesce(old_size, 0) END AS d FROM j)
        SELECT path, change, greatest(d, 0) AS growth, d > 3 AS large_growth FROM g""",
    "changed_files": f"""{_LISTING} SELECT path, new_size AS size FROM cnt WHERE new_size > 0
        AND NOT (old_size = new_size AND old_time = new_time) OR (new_size > 0 AND old_size = 0)""",
    "bounded_listing": f"""{_LISTING}, n AS (SELECT path, new_size AS size FROM cnt),
        t AS (SELECT greatest(CAST(ceil(count(*) / 25) AS BIGINT), 1) AS batches FROM n)
        SELECT path, size, batches, CAST('0x' || md5(path)[1:8] AS BIGINT) % batches AS batch FROM n, t""",
    "store_upsert": f"""{BY_DAY} SELECT CAST(user_id AS VARCHAR) AS session_key, {_time('max(ended_at)', 'updated_at')},
        max_by(event_count, ended_at) AS event_count FROM rep GROUP BY user_id""",
    "store_replace_metrics": f"""{BY_DAY} SELECT session_key, metric_name, {_six('value', 'value')} FROM longm WHERE {_PRE}
        UNION ALL SELECT session_key, metric_name, -1.0 FROM longm WHERE {_POST} AND metric_name = 'read_edit_ratio'""",
    "store_delete": f"""{BY_DAY} SELECT (SELECT count(*) FROM rep WHERE model IS DISTINCT FROM 'model-1') AS sessions,
        (SELECT count(*) FROM rl WHERE model IS DISTINCT FROM 'model-1') AS metrics""",
    "store_report_lookup": f"{BY_DAY} SELECT session_key, event_count FROM rep WHERE session_key = '3-2024-01-05'",
    "store_resolve_ids": f"""{BY_DAY}, h AS (SELECT session_key, CAST(user_id AS VARCHAR) AS sid, 'root-' || right(session_key, 1) AS root, ended_at FROM rep),
        wt AS (SELECT DISTINCT CASE WHEN root = 'root-3' THEN 'x:' || sid ELSE sid END AS identifier, CASE WHEN root = 'root-1' THEN root END AS root_id FROM h)
        SELECT identifier, root_id, identifier AS session_key FROM wt WHERE contains(identifier, ':')
        UNION ALL SELECT identifier, root_id, max_by(session_key, ended_at) FROM wt JOIN h ON h.sid = identifier AND (root_id IS NULL OR root_id = root)
        GROUP BY identifier, root_id""",
    "store_list": f"""{BY_DAY} SELECT session_key, {_time('started_at')} FROM rep
        WHERE started_at BETWEEN TIMESTAMP '2024-01-03' AND TIMESTAMP '2024-01-04 12:00:00'""",
    "store_sessions_with_metrics": f"""{BY_DAY} SELECT session_key, CAST(count(*) AS INT) AS n_metrics, string_agg(metric_name, ',' ORDER BY metric_name) AS names
        FROM longm GROUP BY session_key""",
    "sink_events_json": f"{_LINES} SELECT session_key, kind, count(*) AS n FROM ev GROUP BY ALL",
    "sink_cohort_csv": f"""{BY_DAY} SELECT {_WEEK} AS week, metric_name, round(round(avg(value), 6), 5) AS mean, count(*) AS n FROM rl GROUP BY ALL""",
    "sink_cohort_json": f"""{BY_DAY} SELECT 'model' AS dimension, count(*) AS session_count, count(*) FILTER (WHERE model IS NULL) AS excluded_null_count,
        strftime(min(started_at), '%Y-%m-%d') || '..' || strftime(max(started_at), '%Y-%m-%d') AS date_range,
        (SELECT count(DISTINCT (model, metric_name)) FROM rl WHERE model IS NOT NULL) AS cells,
        (SELECT count(*) FROM rl WHERE model IS NOT NULL) AS observations FROM rep""",
    "sink_window_json": f"""{_window_sql()} SELECT "window", count(*) AS sessions, CAST(sum(event_count) AS BIGINT) AS events FROM wr GROUP BY "window" """,
    "sink_report_json": f"""{_SPANS}, c AS (SELECT CAST(conv_id AS VARCHAR) AS session_id, count(*) AS event_count FROM conversations GROUP BY conv_id),
        n AS (SELECT session_key, count(*) AS hits FROM span GROUP BY session_key)
        SELECT session_id, event_count, CAST(3 AS INT) AS n_metrics, CAST(least(coalesce(hits, 0), 5) AS INT) AS n_hits
        FROM c LEFT JOIN n ON session_key = session_id""",
    "sink_table_versions": f"{BY_DAY} SELECT session_key, event_count FROM rep",
    "sink_drift": f"""{_LINES}, c AS (
        SELECT 'malformed_line' AS code FROM lo WHERE line_class = 'malformed'
        UNION ALL SELECT 'unknown_type' FROM lo WHERE line_class = 'unknown_type'
        UNION ALL SELECT 'duplicate_message' FROM lo WHERE duplicate
        UNION ALL SELECT 'unknown_fingerprint' FROM (SELECT DISTINCT session_key FROM lo WHERE event_type = 'error' AND k % 3 <> 0))
        SELECT code, count(*) AS n FROM c GROUP BY code""",
    "redacted_documents": f"""WITH c AS (SELECT doc_id, text, {_CLEAN} AS clean FROM documents)
        SELECT doc_id, md5(clean) AS clean_md5, clean <> text AS changed FROM c""",
    "redacted_kinds": f"""WITH c AS (SELECT len(regexp_extract_all({_CLEAN}, '\\[REDACTED\\]')) AS n FROM documents)
        SELECT CAST(sum(n) AS BIGINT) AS redactions, count(*) FILTER (WHERE n > 0) AS documents FROM c""",
    "stable_tokens": f"""WITH {_RAW}, f AS (SELECT user_id, k, min(seq) AS first FROM raw GROUP BY ALL),
        r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY first) AS n FROM f)
        SELECT CAST(user_id AS VARCHAR) AS session_key, seq, 'tool-' || n AS tool_use_id_token FROM raw JOIN r USING (user_id, k)""",
    "anonymised_events": f"""{_LINES}, o AS (SELECT *, line_no * 16777216 + block_no AS seq FROM ev),
        f AS (SELECT session_key, tool_use_id, min(seq) AS first FROM o WHERE tool_use_id IS NOT NULL GROUP BY ALL),
        r AS (SELECT *, row_number() OVER (PARTITION BY session_key ORDER BY first) AS n FROM f),
        b AS (SELECT session_key, arg_min(ts, seq) AS t0 FROM o GROUP BY session_key)
        SELECT o.session_key, seq, kind, 'tool-' || n AS tool_use_id, message_id, file_path,
            {_T.format("TIMESTAMP '2026-01-01' + (ts - t0)")} AS ts
        FROM o JOIN b USING (session_key) LEFT JOIN r USING (session_key, tool_use_id)""",
    "shifted_times": """WITH s AS (SELECT CAST(user_id AS VARCHAR) AS session_key, event_id AS seq, ts, min_by(ts, event_id) OVER (PARTITION BY user_id) AS t0 FROM events)
        SELECT session_key, seq, strftime(TIMESTAMP '2026-01-01' + (ts - t0), '%Y-%m-%d %H:%M:%S.%f') AS ts FROM s""",
    "streamed_reports": f"""{BY_USER} SELECT session_key, event_count, reads, research, mutations, mutations_total, blind_mutations,
        {_six('read_edit_ratio', 'read_edit_ratio')}, CASE WHEN classified < 10 THEN 'ok' WHEN read_edit_ratio < 2 THEN 'critical'
        WHEN read_edit_ratio < 4 THEN 'warn' ELSE 'ok' END AS read_edit_severity FROM metric""",
    "streamed_segments": _streamed_sessions(),
    "resumed_stream": f"""{_LINES}, late AS (SELECT DISTINCT session_key FROM lo WHERE line_no > (SELECT (min(seq) + max(seq)) // 2 FROM raw)),
        calls AS (SELECT *, CASE tool_name WHEN 'read' THEN 'read' WHEN 'grep' THEN 'research' ELSE 'mutation' END AS category,
            row_number() OVER (PARTITION BY session_key ORDER BY line_no, block_no) AS call_no,
            row_number() OVER (PARTITION BY session_key ORDER BY line_no DESC, block_no DESC) AS back_no FROM ev WHERE kind = 'tool_call'),
        looked AS (SELECT *, max(CASE WHEN category <> 'mutation' THEN call_no END) OVER (PARTITION BY session_key, file_path ORDER BY call_no
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_look FROM calls),
        c AS (SELECT session_key, count(*) AS calls, count(*) FILTER (WHERE category = 'mutation') AS mutations_total,
            count(*) FILTER (WHERE category = 'mutation' AND file_path IS NOT NULL) AS mutations_with_path,
            count(*) FILTER (WHERE category = 'read' AND back_no <= 50) AS reads, count(*) FILTER (WHERE category = 'research' AND back_no <= 50) AS research,
            count(*) FILTER (WHERE category = 'mutation' AND back_no <= 50) AS mutations,
            count(*) FILTER (WHERE category = 'mutation' AND file_path IS NOT NULL AND (last_look IS NULL OR call_no - last_look > 20)) AS blind_mutations
            FROM looked GROUP BY session_key),
        e AS (SELECT session_key, count(*) AS event_count, count(*) FILTER (WHERE kind = 'thinking') AS thinking_blocks,
            count(*) FILTER (WHERE kind = 'thinking' AND NOT redacted) AS visible_blocks, count(*) FILTER (WHERE kind = 'user') AS prompts,
            {_six("median(CASE WHEN kind = 'thinking' AND NOT redacted AND thinking_len > 0 THEN CAST(thinking_len AS DOUBLE) END)", 'visible_chars_median')},
            {_six("median(CASE WHEN kind = 'thinking' AND length(signature) > 0 THEN CAST(length(signature) AS DOUBLE) END)", 'signature_chars_median')}
            FROM ev GROUP BY session_key)
        SELECT st.session_key, {", ".join(f"coalesce({c}, 0) AS {c}" for c in (
            'event_count', 'calls', 'mutations_total', 'mutations_with_path', 'thinking_blocks', 'visible_blocks', 'prompts', 'reads', 'research',
            'mutations', 'blind_mutations'))}, total_lines, CAST(parsed_events AS BIGINT) AS parsed_events, duplicate_count,
            {_six('parse_confidence', 'parse_confidence')}, visible_chars_median, signature_chars_median
        FROM st JOIN late USING (session_key) LEFT JOIN c USING (session_key) LEFT JOIN e USING (session_key)""",
    "tick_log": """WITH u AS (SELECT DISTINCT user_id % 3 AS first, user_id % 2 = 0 AS even, user_id FROM events),
        t AS (SELECT unnest([0, 1, 2]) AS tick)
        SELECT tick, count(*) FILTER (WHERE first <= tick) AS seen, count(*) FILTER (WHERE first = tick) AS new,
            count(*) FILTER (WHERE tick = 2 AND even) AS ended, count(*) FILTER (WHERE first <= tick AND NOT (tick = 2 AND even)) AS live
        FROM u, t GROUP BY tick""",
    "store_rewritten_buckets": f"""{BY_DAY}, v AS (SELECT unnest([1, 2, 3, 4]) AS version)
        SELECT version, CASE WHEN version = 1 THEN 32 ELSE 1 END AS rewritten,
            count(*) FILTER (WHERE version < 4 OR session_key <> '3-2024-01-05') AS "rows",
            sum(CASE WHEN session_key <> '3-2024-01-05' OR version = 1 THEN event_count WHEN version < 4 THEN -1 ELSE 0 END)::BIGINT AS events
        FROM rep, v GROUP BY version""",
    "files_by_root": """WITH p AS (SELECT DISTINCT user_id, user_id % 20 AS n FROM events)
        SELECT CASE WHEN n IN (1, 7) THEN '/data/projects/p' || n ELSE '/data/projects' END AS root_path,
            count(*) AS files, 1 AS roots FROM p GROUP BY ALL""",
    "sink_events_by_day": """SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS event_date, count(*) AS n FROM events
        WHERE ts >= DATE '2024-01-10' GROUP BY ALL""",
    "sink_events_every_day": "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS event_date, count(*) AS n FROM events GROUP BY ALL",
    "sink_snapshots": f"""{BY_USER}, n AS (SELECT unnest(['parse_health', 'read_edit_ratio', 'stop_phrase', 'reasoning_loop', 'thinking', 'prompts'])
        AS metric_name) SELECT 'snapshot' AS kind, metric_name, 2 * (SELECT count(*) FROM metric) AS n FROM n""",
    "migrated_keys": f"""{BY_DAY} SELECT 'root-legacy:' || session_key AS session_key, 'root-legacy' AS root_id,
        any_value(event_count) AS event_count, count(*) AS metrics FROM rep JOIN longm USING (session_key) GROUP BY session_key""",
    "paths_without_project": """SELECT DISTINCT '/data/other/' || user_id || '.jsonl' AS path, 'warn' AS level,
        'project_layout_unknown' AS code FROM events WHERE user_id % 2 <> 0""",
    "events_until_day": """SELECT CAST(user_id AS VARCHAR) AS session_key, count(*) AS n FROM events
        WHERE ts <= TIMESTAMP '2024-01-15 23:59:59' GROUP BY user_id""",
    "store_by_path": f"""{BY_DAY} SELECT session_key, '/logs/' || session_key AS path, event_count FROM rep
        WHERE session_key = '3-2024-01-05'""",
    "streamed_late_chunks": f"""{_LINES}, n AS (SELECT session_key, count(*) AS event_count,
            count(*) FILTER (WHERE tool_name = 'edit') AS mutations_total FROM ev GROUP BY session_key)
        SELECT 'root-legacy:' || st.session_key AS session_key, coalesce(event_count, 0) AS event_count,
            coalesce(mutations_total, 0) AS mutations_total, duplicate_count FROM st LEFT JOIN n USING (session_key)""",
    "history_diff_header": f"""{BY_DAY},
        d AS (SELECT *, CAST(floor((epoch_us(ended_at) - epoch_us(started_at)) / 1e6) AS BIGINT) AS secs,
            (epoch_us(ended_at) - epoch_us(started_at)) / 1e6 AS exact FROM rep JOIN worst USING (session_key)),
        t AS (SELECT *, CASE WHEN secs < 60 THEN secs || 's' WHEN secs < 3600 THEN (secs // 60) || 'm' || lpad(CAST(secs % 60 AS VARCHAR), 2, '0') || 's'
            ELSE (secs // 3600) || 'h' || lpad(CAST(secs // 60 % 60 AS VARCHAR), 2, '0') || 'm' END AS dur FROM d),
        a AS (SELECT * FROM t WHERE session_key = '1-2024-01-01'), b AS (SELECT * FROM t WHERE session_key = '1-2024-01-02'),
        ab AS (SELECT a.session_key AS sa, b.session_key AS sb, a.project_hash AS ph, a.model AS m, coalesce(a.permission_mode, '—') AS pm,
            strftime(a.started_at, '%Y-%m-%d %H:%M') AS ta, strftime(b.started_at, '%Y-%m-%d %H:%M') AS tb, a.dur AS da,
            b.dur || ' (' || CASE WHEN b.exact >= a.exact THEN '+' ELSE '' END || CAST(CAST(round(b.exact - a.exact) AS BIGINT) AS VARCHAR) || 's)' AS db,
            CAST(a.event_count AS VARCHAR) AS ea, CAST(b.event_count AS VARCHAR) AS eb, {_SEV.format('a.band')} AS va, {_SEV.format('b.band')} AS vb FROM a, b)
        SELECT unnest(['session_id', 'project', 'model', 'permission_mode', 'started_at', 'duration', 'events', 'severity']) AS field,
            unnest([sa, ph, m, pm, ta, da, ea, va]) AS session_a, unnest([sb, ph, m, pm, tb, db, eb, vb]) AS session_b FROM ab""",
}
