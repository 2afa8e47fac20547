"""SQL that recomputes each registered query the plain way, over all pairs."""

from __future__ import annotations

_WORDS = """['anvil', 'blue', 'bolt', 'cold', 'gear', 'gizmo', 'hot', 'large', 'new', 'old', 'plate', 'red', 'ring',
  'rod', 'small', 'widget']"""

_KINDS = "['blue', 'cold', 'hot', 'large', 'new', 'old', 'red', 'small']"
_THINGS = "['anvil', 'bolt', 'gear', 'gizmo', 'plate', 'ring', 'rod', 'widget']"

_VIEWS = {
    "L": """
SELECT k AS id_num, CAST(k AS VARCHAR) AS id, p.p_name || CASE WHEN k % 6 = 0 THEN ' / ' ELSE ' ' END || p.p_type AS title, p.p_brand AS company,
  CASE WHEN o.o_orderstatus = 'O' THEN 'Remote' ELSE 'NATION_' || CAST(k % 25 AS VARCHAR) END AS location,
  'NATION_' || CAST(k % 25 AS VARCHAR) AS country,
  CASE o.o_orderstatus WHEN 'O' THEN 'remote' WHEN 'F' THEN 'on-site' ELSE 'hybrid' END AS work_mode,
  CASE k % 4 WHEN 0 THEN 'full-time' WHEN 1 THEN 'part-time' WHEN 2 THEN 'freelance' ELSE 'contract' END AS type,
  CAST(FLOOR(k / 4.0) AS BIGINT) % 4 AS band,
  CASE CAST(FLOOR(k / 7.0) AS BIGINT) % 5 WHEN 0 THEN 'AUTOMOBILE' WHEN 1 THEN 'BUILDING' WHEN 2 THEN 'FURNITURE'
    WHEN 3 THEN 'HOUSEHOLD' ELSE 'MACHINERY' END AS field,
  CASE WHEN k % 10 = 0 THEN '$80–$100/hr' WHEN k % 10 = 1 THEN '$' || CAST(20 + k % 100 AS VARCHAR) || 'k'
    WHEN k % 10 = 2 THEN '€' || CAST(20 + k % 100 AS VARCHAR) || '–' || CAST(40 + k % 100 AS VARCHAR) || 'K'
    WHEN k % 10 = 3 THEN CAST(20 + k % 100 AS VARCHAR) || ',500 GBP'
    WHEN k % 10 = 4 THEN 'E£' || CAST(20 + k % 100 AS VARCHAR) || '.5k - E£' || CAST(40 + k % 100 AS VARCHAR) || 'k'
    WHEN k % 10 = 5 THEN CAST(20 + k % 100 AS VARCHAR) || ' € / hour'
    WHEN k % 10 = 6 THEN '$' || CAST(1 + k % 3 AS VARCHAR) || '.25M'
    WHEN k % 70 = 7 THEN 'Competitive'
    ELSE '$' || CAST(20 + k % 100 AS VARCHAR) || 'k–$' || CAST(40 + k % 100 AS VARCHAR) || 'k' END AS salary,
  CAST((k * 37) % 101 AS INT) AS score,
  CASE substring(o.o_orderpriority, 1, 1) WHEN '1' THEN 'LinkedIn' WHEN '2' THEN 'Indeed' WHEN '3' THEN 'RemoteOK'
    WHEN '4' THEN 'Wuzzuf' ELSE 'Glassdoor' END AS source,
  'https://example.org/jobs/' || CAST(k AS VARCHAR) AS link, CAST(o.o_orderdate AS DATE) AS posted_on,
  k % 9 = 0 AS bookmarked
FROM (SELECT *, o_orderkey AS k FROM orders) o JOIN part p ON p.p_partkey = k % (SELECT count(*) FROM part)""",
    "U": f"""
SELECT c.c_custkey AS user_id,
  CASE c.c_custkey % 3 WHEN 0 THEN 'remote' WHEN 1 THEN 'on-site' ELSE 'hybrid' END AS work_preference,
  n.n_name AS country, c.c_mktsegment AS field, skill1, skill2, skills, len(skills) AS n_skills, CAST(c.c_custkey % 15 AS INT) AS experience,
  CASE WHEN c.c_custkey % 15 < 2 THEN 0 WHEN c.c_custkey % 15 < 5 THEN 1 WHEN c.c_custkey % 15 < 10 THEN 2 ELSE 3 END AS band,
  CAST(FLOOR(GREATEST(c.c_acctbal, 0)) AS BIGINT) AS want_min,
  CASE WHEN c.c_custkey % 50 = 0 THEN 'Teams' WHEN c.c_custkey % 10 = 0 THEN 'Pro' ELSE 'Free' END AS plan
FROM (
  SELECT *, list_filter(listed, lambda x, i: list_position(listed, x) = i) AS skills
  FROM (
    SELECT c.*, words[1 + c % 16] AS skill1, words[1 + c // 16 % 16] AS skill2,
      [words[1 + c % 16], words[1 + c // 16 % 16]]
        || CASE WHEN c % 4 = 0 THEN [third, words[1 + (c * 7 + 3) % 16]] ELSE [] END
        || CASE WHEN c % 8 = 0 THEN [words[1 + (c // 64 + 11) % 16], words[1 + (c // 1024 + 2) % 16]] ELSE [] END AS listed
    FROM (
      SELECT *, CASE WHEN c % 8 = 0 THEN upper(kind || '-' || thing) ELSE kind || ' ' || thing END AS third
      FROM (SELECT *, c_custkey AS c, {_KINDS}[1 + c_custkey // 4 % 8] AS kind, {_THINGS}[1 + c_custkey // 32 % 8] AS thing FROM customer)
    ) c, (SELECT {_WORDS} AS words) w)
) c JOIN nation n ON n.n_nationkey = c.c_nationkey""",
    "E": """
SELECT event_id, ts, user_id, event_type, value, props,
  CAST(regexp_extract(props, '[0-9]+', 0) AS BIGINT) AS k FROM events""",
    "T": """
SELECT user_id, CASE WHEN event_id % 2 = 0 THEN k % 10 ELSE event_id END AS id_num, ts, event_id FROM E""",
    "R": """
SELECT *, '{"userId":"' || sender || '","workPreference":"'
    || CASE event_type WHEN 'view' THEN 'remote' WHEN 'click' THEN 'on-site' ELSE 'Hybrid' END
    || '","location":' || CASE k % 3 WHEN 0 THEN '{"country":"C' || CAST(k % 5 AS VARCHAR) || '","city":" Oslo "}'
      WHEN 1 THEN '{"country":"C9","city":""}' ELSE '{"country":"","city":""}' END
    || ',"field":"F' || CAST(k % 5 AS VARCHAR) || '","skills":'
    || CASE WHEN k % 10 = 1 THEN '"React"' ELSE '["a","b"]' END || ',"experience":' || CAST(years AS VARCHAR)
    || ',"jobType":' || CASE k % 7 WHEN 0 THEN '"Full-time"' WHEN 1 THEN '["contract"]' ELSE '[]' END
    || ',"seniority":' || CASE WHEN k % 8 = 0 THEN '" Senior "' ELSE '"mid"' END || ',"salary":'
    || CASE k % 9 WHEN 0 THEN '{"min":"' || CAST(k AS VARCHAR) || ',500","max":' || CAST(k * 1000 AS VARCHAR) || ',"currency":"EUR"}'
      WHEN 1 THEN '{"min":99999999999999999999,"max":0,"currency":"USD"}'
      ELSE '{"min":0,"max":0,"currency":"USD"}' END || ',"timestamp":"' || stamp || '"}' AS payload
FROM (SELECT *,
    CASE WHEN event_type = 'error' OR k = 50 THEN 500 WHEN event_type = 'signup' OR k % 10 = 0 THEN 400 ELSE 200 END AS status,
    CASE WHEN k = 7 THEN 99999999999 ELSE k % 6 END AS years,
    CASE WHEN k % 4 = 0 THEN 'user_' || CAST(epoch_us(ts) // 1000 AS VARCHAR) ELSE CAST(user_id AS VARCHAR) END AS sender,
    strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS stamp
  FROM E)""",
    "N": """
SELECT event_id, sender AS user_id,
  CASE event_type WHEN 'view' THEN 'remote' WHEN 'click' THEN 'on-site' ELSE 'hybrid' END AS work_preference,
  CASE k % 3 WHEN 0 THEN 'C' || CAST(k % 5 AS VARCHAR) WHEN 1 THEN 'C9' ELSE '' END AS country,
  CASE WHEN k % 3 = 0 THEN ' Oslo ' ELSE '' END AS city, 'F' || CAST(k % 5 AS VARCHAR) AS field,
  CASE WHEN k % 10 = 1 THEN 'React' ELSE 'a|b' END AS skills, CAST(years AS BIGINT) AS experience,
  CASE k % 7 WHEN 0 THEN 'full-time' WHEN 1 THEN 'contract' ELSE '' END AS job_type, CASE WHEN k % 8 = 0 THEN 'senior' ELSE 'mid' END AS seniority,
  CASE WHEN k % 9 = 0 THEN k ELSE CAST(0 AS BIGINT) END AS salary_min,
  CASE WHEN k % 9 = 0 THEN k * 1000 ELSE CAST(0 AS BIGINT) END AS salary_max,
  CASE WHEN k % 9 = 0 THEN 'EUR' ELSE 'USD' END AS currency, stamp, k % 9 <> 1 AS numbers_fit
FROM R WHERE status = 200""",
    # salaries read from their texts
    "PAY": """
SELECT id_num, salary, CAST(round(least(a, b)) AS BIGINT) AS lo, CAST(round(greatest(a, b)) AS BIGINT) AS hi,
  CASE WHEN a IS NULL THEN NULL WHEN contains(salary, 'E£') THEN 'EGP' WHEN contains(salary, '$') THEN 'USD'
    WHEN contains(salary, '€') THEN 'EUR' WHEN contains(salary, 'GBP') THEN 'GBP' END AS currency,
  CASE WHEN a IS NULL THEN NULL WHEN contains(salary, '/') THEN 'hour' ELSE 'year' END AS period
FROM (
  SELECT *, numbers[1] * CASE WHEN u1 <> '' THEN t1 ELSE t2 END AS a, numbers[len(numbers)] * t2 AS b
  FROM (
    SELECT *, CASE u1 WHEN 'k' THEN 1000 WHEN 'm' THEN 1000000 ELSE 1 END AS t1,
      CASE u2 WHEN 'k' THEN 1000 WHEN 'm' THEN 1000000 ELSE 1 END AS t2
    FROM (
      SELECT *, list_transform(texts, lambda x: CAST(regexp_extract(x, '^[0-9.]+') AS DOUBLE)) AS numbers,
        regexp_extract(texts[1], '[km]$') AS u1, regexp_extract(texts[len(texts)], '[km]$') AS u2
      FROM (SELECT id_num, salary, regexp_extract_all(replace(lower(salary), ',', ''), '[0-9.]+[km]?') AS texts FROM L))))""",
    # every relevant (user, listing) pair with the parts of its score
    "P": """
SELECT *, skill_points + experience_points + location_points AS score FROM (
  SELECT u.user_id, u.plan, l.id_num, l.source, l.posted_on,
    60 * hits // u.n_skills AS skill_points,
    CASE abs(u.band - l.band) WHEN 0 THEN 20 WHEN 1 THEN 10 ELSE 0 END AS experience_points,
    CASE WHEN l.work_mode = u.work_preference THEN 10 ELSE 0 END
      + CASE WHEN l.work_mode = 'remote' OR l.country = u.country THEN 10 ELSE 0 END AS location_points
  FROM (
    SELECT u.*, t.title, len(list_filter(u.skills, lambda s: contains(t.line, ' ' || replace(lower(s), '-', ' ') || ' '))) AS hits
    FROM U u, (SELECT DISTINCT title, ' ' || replace(lower(title), ' / ', ' ') || ' ' AS line FROM L) t
  ) u JOIN L l ON l.title = u.title AND l.field = u.field AND (
    (l.work_mode = 'remote' AND u.work_preference IN ('remote', 'hybrid'))
    OR (l.work_mode <> 'remote' AND l.country = u.country AND u.work_preference IN ('on-site', 'hybrid')))
  WHERE hits > 0
)""",
    "K": """
SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, posted_on DESC, id_num) AS rank FROM P""",
    "TOP": "SELECT * FROM K WHERE rank <= 20",
    "FLIPS": "SELECT user_id, id_num, count(*) AS toggles, count(*) % 2 = 1 AS flipped FROM T GROUP BY ALL",
}
_NEEDS = {
    "PAY": ["L"], "T": ["E"], "R": ["E"], "N": ["R"], "P": ["L", "U"], "K": ["P"], "TOP": ["K"], "FLIPS": ["T"],
}


def _with(views: str, body: str) -> str:
    """Prefix the query with the named views and those they need."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for need in _NEEDS.get(name, []):
            add(need)
        if name not in ordered:
            ordered.append(name)

    for name in views.split():
        add(name)
    heads = ", ".join(f"{name} AS ({_VIEWS[name].strip()})" for name in ordered)
    return f"WITH {heads} {body.strip()}" if heads else body.strip()


_CARD = "id_num, title, company, location, source, score"
_SKILL_LIST = "skills"

ORACLES: dict[str, str] = {
    "listings_scan": _with("L", """
        SELECT id, title, company, location, type, salary, score, source, link, posted_on, bookmarked,
          company || ' · ' || location AS line FROM L"""),
    "listings_union": _with("L", """
        SELECT id_num, title, CASE WHEN source <> 'Wuzzuf' THEN salary END AS salary, source FROM L"""),
    "listings_refresh": _with("L", """
        , A AS (SELECT id_num, title, CAST(posted_on + to_days(CAST(id_num // 3 % 3 - 1 AS INT)) AS DATE) AS posted_on, 100 - score AS score, 1 AS pull
          FROM L WHERE id_num % 3 = 0),
        B AS (SELECT id_num, title, CAST(posted_on - INTERVAL 1 DAY AS DATE) AS posted_on, 7 AS score, 1 AS pull FROM A WHERE id_num % 5 = 0)
        SELECT id_num, title, posted_on, score FROM (
          SELECT *, row_number() OVER (PARTITION BY id_num ORDER BY posted_on DESC, pull DESC) AS nth
          FROM (SELECT id_num, title, posted_on, score, 0 AS pull FROM L UNION ALL SELECT * FROM A UNION ALL SELECT * FROM B))
        WHERE nth = 1"""),
    "page_extract": """
        SELECT page_id, replace(replace(replace(replace(replace(replace(regexp_extract(html, '<title>([^<]*)</title>', 1),
            '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&nbsp;', ' '), '&amp;', '&') AS title,
          regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host,
          regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) AS path FROM pages""",
    "salary_parsed": _with("PAY", """
        SELECT id_num, salary, lo, hi, currency, period FROM PAY"""),
    "option_labels": _with("L", """
        SELECT id_num, type, work_mode,
          CASE band WHEN 0 THEN 'Entry Level' WHEN 1 THEN 'Mid Level' WHEN 2 THEN 'Senior Level' ELSE 'Lead / Staff' END AS seniority_label,
          upper(type[1]) || type[2:] AS type_label, upper(work_mode[1]) || work_mode[2:] AS work_label FROM L"""),
    "score_tier_counts": _with("L", """
        SELECT CASE WHEN score >= 90 THEN 'high' WHEN score >= 75 THEN 'medium' ELSE 'low' END AS tier,
          count(*) AS listings FROM L GROUP BY 1"""),
    "company_initial_counts": _with("L", "SELECT company[1] AS initial, count(*) AS listings FROM L GROUP BY 1"),
    "intake_status": _with("R", """
        SELECT event_id, status,
          CASE status WHEN 400 THEN 'Missing required fields' WHEN 500 THEN 'Failed to process onboarding data' END AS error,
          CASE WHEN status = 500 THEN CASE WHEN event_type = 'error' THEN 'body is not valid JSON' ELSE 'body is null' END END AS details,
          status = 200 AS success,
          CASE WHEN status = 200 THEN 'Onboarding completed. Job search initiated.' END AS message FROM R"""),
    "request_payload": _with("R", "SELECT event_id, payload FROM R WHERE status = 200"),
    "request_normalized": _with("N", "SELECT * FROM N"),
    "request_profiles": _with("N", """
        SELECT user_id, work_preference, country, field, skills, experience, job_type, seniority, currency
        FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY stamp DESC, event_id DESC) AS nth FROM N) WHERE nth = 1"""),
    "lenient_int": _with("E L", """
        SELECT 'props' AS origin, event_id AS id_num, props AS text, CAST(0 AS BIGINT) AS number FROM E
        UNION ALL SELECT 'number', event_id, CAST(k AS VARCHAR) || '}', k FROM E
        UNION ALL SELECT 'salary', id_num, text, coalesce(TRY_CAST(nullif(regexp_extract(text, '^[0-9]+'), '') AS BIGINT), 0)
        FROM (SELECT id_num, ltrim(salary, '$') AS text FROM L)"""),
    "zero_as_blank": _with("U", """
        SELECT user_id, CASE WHEN experience = 0 THEN '' ELSE CAST(experience AS VARCHAR) END AS experience_text,
          CASE WHEN want_min = 0 THEN '' ELSE CAST(want_min AS VARCHAR) END AS want_min_text FROM U"""),
    "secret_roundtrip": _with("U", """
        SELECT user_id, repeat('*', length('key-' || CAST(user_id AS VARCHAR))) AS shown, true AS hidden, true AS readable FROM U"""),
    "search_strings": _with("U", f"""
        SELECT user_id, skill || ' ' || field || ' remote' AS search
        FROM (SELECT *, unnest({_SKILL_LIST}) AS skill FROM U) WHERE work_preference IN ('remote', 'hybrid')
        UNION ALL SELECT user_id, field || ' ' || country || ' ' || skill
        FROM (SELECT *, unnest({_SKILL_LIST}) AS skill FROM U) WHERE work_preference IN ('on-site', 'hybrid')"""),
    "experience_band": _with("U", """
        SELECT user_id, experience, band, CASE band WHEN 0 THEN 'entry' WHEN 1 THEN 'mid' WHEN 2 THEN 'senior' ELSE 'lead' END AS code,
          CASE band WHEN 0 THEN 'Entry Level' WHEN 1 THEN 'Mid Level' WHEN 2 THEN 'Senior Level' ELSE 'Lead / Staff' END AS label FROM U"""),
    "skills_clean": _with("U", """
        SELECT user_id, skill1 || '|' || upper(skill2) || CASE WHEN skill1 <> skill2 THEN '|' || skill2 ELSE '' END AS skills FROM U"""),
    "skills_removed": _with("U", """
        SELECT user_id, array_to_string(skills[2:], '|') AS skills, CAST(n_skills - 1 AS INT) AS n FROM U"""),
    "jobtype_toggle": _with("U", """
        SELECT user_id, CASE WHEN user_id % 2 = 0 THEN '' ELSE 'full-time' END AS one_toggle,
          CASE WHEN user_id % 2 = 0 THEN 'contract' ELSE 'contract|full-time' END AS two_toggles,
          user_id % 2 = 1 AS has_full_time FROM U"""),
    "search_listings": _with("L", f"""
        SELECT {_CARD} FROM L WHERE contains(lower(title), 'ring') OR contains(lower(company), 'ring')"""),
    "filter_source": _with("L", f"SELECT {_CARD} FROM L WHERE source = 'RemoteOK'"),
    "dashboard_filter": _with("L", f"""
        SELECT {_CARD} FROM L WHERE source = 'LinkedIn'
          AND (contains(lower(title), 'brand#2') OR contains(lower(company), 'brand#2'))"""),
    "filter_facets": _with("L", f"""
        SELECT {_CARD}, type, work_mode, CASE band WHEN 1 THEN 'mid' ELSE 'senior' END AS seniority FROM L
        WHERE location IN ('Remote', 'NATION_3', 'NATION_7') AND type IN ('full-time', 'contract')
          AND work_mode IN ('remote', 'hybrid') AND band IN (1, 2)"""),
    "filter_salary": _with("PAY", """
        SELECT id_num, salary, lo, hi FROM PAY
        WHERE lo <= 90000 AND hi >= 50000 AND currency = 'USD' AND period = 'year'"""),
    "filter_score": _with("L", f"SELECT {_CARD} FROM L WHERE score >= 80"),
    "match_candidates": _with("L U", """
        SELECT u.user_id, count(*) AS candidates FROM U u JOIN L l ON l.field = u.field AND (
          (l.work_mode = 'remote' AND u.work_preference IN ('remote', 'hybrid'))
          OR (l.work_mode <> 'remote' AND l.country = u.country AND u.work_preference IN ('on-site', 'hybrid')))
        GROUP BY 1"""),
    "matches_scored": _with("P", """
        SELECT user_id, CAST(skill_points AS INT) AS skill_points, experience_points, location_points,
          CAST(score AS INT) AS score, count(*) AS listings FROM P GROUP BY ALL"""),
    "rank_ranges": _with("K", """
        SELECT user_id, CAST(score AS INT) AS score, count(*) AS listings, min(rank) AS first_rank, max(rank) AS last_rank
        FROM K GROUP BY ALL"""),
    "matches_ranked": _with("K", """
        SELECT user_id, id_num, posted_on, CAST(skill_points AS INT) AS skill_points, experience_points, location_points,
          CAST(score AS INT) AS score, CAST(rank AS INT) AS rank FROM K WHERE rank <= 50"""),
    "matches_topk": _with("TOP", """
        SELECT user_id, CAST(rank AS INT) AS rank, id_num, title, company, location, l.source, l.posted_on,
          CAST(t.score AS INT) AS score FROM TOP t JOIN L l USING (id_num)"""),
    "plan_topk": _with("P", """
        SELECT user_id, plan, CAST(rank AS INT) AS rank, id_num, CAST(score AS INT) AS score FROM (
          SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, posted_on DESC, id_num) AS rank
          FROM P WHERE plan <> 'Free' OR source IN ('LinkedIn', 'Indeed'))
        WHERE rank <= CASE WHEN plan = 'Free' THEN 10 ELSE 50 END"""),
    "result_documents": _with("TOP", """
        SELECT user_id, '{"jobs":[' || string_agg('{"title":"' || title || '","company":"' || company || '","location":"'
            || location || '","score":' || CAST(t.score AS VARCHAR) || ',"link":"' || link || '"}', ',' ORDER BY rank)
          || ']}' AS document FROM TOP t JOIN L l USING (id_num) GROUP BY 1"""),
    "jobs_roundtrip": _with("TOP", """
        SELECT l.id, user_id, title, company, location, type, salary, l.source, l.posted_on, CAST(t.score AS INT) AS score, link
        FROM TOP t JOIN L l USING (id_num)"""),
    "listings_fixed_schema": _with("L", """
        SELECT id, title, source, score, strftime(posted_on, '%Y-%m-%d') AS "postedAt" FROM L"""),
    "skills_added": _with("U", """
        SELECT user_id, array_to_string(skills, '|') || '|Spark' AS skills, CAST(n_skills + 1 AS INT) AS n FROM U"""),
    "search_is_empty": _with("L", """
        SELECT 'RING' AS term, count(*) = 0 AS empty FROM L WHERE contains(lower(title), 'ring') OR contains(lower(company), 'ring')
        UNION ALL SELECT 'no such words', count(*) = 0 FROM L WHERE contains(lower(title), 'no such words')"""),
    "alerts_new": _with("P T", """
        SELECT user_id, id_num, CAST(score AS INT) AS score FROM P ANTI JOIN T USING (user_id, id_num)
        WHERE score >= 90"""),
    "saved_search_hits": _with("L", """
        SELECT term, id_num FROM L, (VALUES ('ring'), ('RED'), ('brand#2'), ('widget economy'), ('%')) s(term)
        WHERE contains(lower(title), lower(term)) OR contains(lower(company), lower(term))"""),
    "dashboard_stats": _with("L", """
        SELECT count(*) AS total, count(*) FILTER (score >= 90) AS top_matches, count(*) FILTER (bookmarked) AS bookmarked,
          CAST(5 AS BIGINT) AS sources, count(DISTINCT source) AS sources_seen FROM L"""),
    "user_dashboard_stats": _with("TOP FLIPS", """
        SELECT t.user_id, count(*) AS total, count(*) FILTER (t.score >= 90) AS top_matches,
          count(*) FILTER (l.bookmarked <> coalesce(f.flipped, false)) AS bookmarked
        FROM TOP t JOIN L l USING (id_num) LEFT JOIN FLIPS f ON f.user_id = t.user_id AND f.id_num = t.id_num GROUP BY 1"""),
    "user_job_counts": _with("TOP", """
        SELECT c.c_custkey AS user_id, u.user_id IS NOT NULL AS has_profile, coalesce(n, 0) AS jobs
        FROM customer c LEFT JOIN U u ON u.user_id = c.c_custkey
        LEFT JOIN (SELECT user_id, count(*) AS n FROM TOP GROUP BY 1) t ON t.user_id = c.c_custkey"""),
    "source_rollup": _with("L", """
        SELECT source, count(*) AS results FROM L GROUP BY 1 UNION ALL SELECT 'total', count(*) FROM L"""),
    "daily_listings": _with("L", "SELECT posted_on, source, count(*) AS listings FROM L GROUP BY ALL"),
    "daily_matches": _with("TOP", """
        SELECT posted_on, count(*) AS matches, count(DISTINCT user_id) AS users FROM TOP GROUP BY 1"""),
    "avg_score": _with("L", """
        SELECT source, CAST(sum(score) AS DOUBLE) / count(score) AS avg_score FROM L GROUP BY 1
        UNION ALL SELECT 'total', CAST(sum(score) AS DOUBLE) / count(score) FROM L"""),
    "global_top": _with("L", "SELECT id_num, title, score FROM L ORDER BY score DESC, id_num LIMIT 100"),
    "bookmark_state": _with("FLIPS L", """
        SELECT f.user_id, f.id_num, toggles, l.bookmarked <> flipped AS bookmarked FROM FLIPS f JOIN L l USING (id_num)"""),
    "bookmark_overlay": _with("FLIPS L", """
        SELECT CAST(NULL AS BIGINT) AS user_id, id_num, title, bookmarked FROM L
        UNION ALL SELECT f.user_id, l.id_num, title, NOT bookmarked FROM FLIPS f JOIN L l USING (id_num) WHERE flipped"""),
    "profile_fold": _with("E", """
        , F AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS nth
          FROM E WHERE event_type <> 'error'),
        S AS (SELECT user_id, event_type, k, k % 10 = 0 AS emptied FROM F WHERE nth = 1)
        SELECT u.user_id, CASE WHEN NOT v.emptied THEN ['remote', 'on-site', 'hybrid'][1 + v.k % 3] END AS work_preference,
          CASE WHEN c.k IS NULL THEN '' WHEN NOT c.emptied THEN 'F' || CAST(c.k % 5 AS VARCHAR) END AS field,
          CAST(CASE WHEN s.k IS NULL THEN 0 WHEN NOT s.emptied THEN s.k % 15 END AS INT) AS experience,
          CASE WHEN p.k IS NULL THEN 0 WHEN NOT p.emptied THEN p.k * 1000 END AS salary_min,
          CASE WHEN p.k IS NULL THEN 0 WHEN NOT p.emptied THEN p.k * 2000 END AS salary_max,
          CASE WHEN p.k IS NULL THEN 'USD' WHEN NOT p.emptied THEN 'EUR' END AS currency
        FROM (SELECT DISTINCT user_id FROM S) u
        LEFT JOIN S v ON v.user_id = u.user_id AND v.event_type = 'view'
        LEFT JOIN S c ON c.user_id = u.user_id AND c.event_type = 'click'
        LEFT JOIN S s ON s.user_id = u.user_id AND s.event_type = 'signup'
        LEFT JOIN S p ON p.user_id = u.user_id AND p.event_type = 'purchase'"""),
    "rate_limited": _with("E", """
        SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS requests FROM E GROUP BY ALL HAVING count(*) > 3"""),
    "search_quota": _with("E U", """
        SELECT user_id, event_id, month, plan FROM (
          SELECT e.user_id, e.event_id, CAST(date_trunc('month', ts) AS DATE) AS month, plan,
            row_number() OVER (PARTITION BY e.user_id, date_trunc('month', ts) ORDER BY ts, event_id) AS nth
          FROM E e JOIN U u ON u.user_id = e.user_id WHERE event_type = 'click')
        WHERE plan <> 'Free' OR nth <= 3"""),
    "time_to_first": _with("E", """
        SELECT s.user_id, CAST((min(epoch_us(v.ts)) - s.started) // 60000000 AS BIGINT) AS minutes
        FROM (SELECT user_id, min(epoch_us(ts)) AS started FROM E WHERE event_type = 'signup' GROUP BY 1) s
        JOIN E v ON v.user_id = s.user_id AND v.event_type = 'view' AND epoch_us(v.ts) >= s.started
        GROUP BY s.user_id, s.started"""),
}

ORACLES |= {
    "listings_store": ORACLES["listings_refresh"],
    "experience_band_table": ORACLES["experience_band"],
    "alerts_by_class": _with("P T", """
        SELECT user_id, id_num, CAST(score AS INT) AS score FROM P ANTI JOIN T USING (user_id, id_num)
        WHERE score >= 90 AND id_num % 3 = 0"""),
    "matches_refreshed": _with("TOP", """
        SELECT user_id, id_num, posted_on, CAST(skill_points AS INT) AS skill_points, experience_points, location_points,
          CAST(score AS INT) AS score, CAST(rank AS INT) AS rank FROM TOP"""),
    "search_stored": _with("L", """
        SELECT term, id_num FROM L, (VALUES ('old RING'), ('brand#13'), ('#')) s(term)
        WHERE contains(lower(title), lower(term)) OR contains(lower(company), lower(term))"""),
    "stream_intake": _with("R", """
        SELECT 'payload' AS kind, payload AS content FROM R WHERE status = 200
        UNION ALL SELECT 'reject', CAST(event_id AS VARCHAR) || CASE status WHEN 400 THEN ' 400 Missing required fields'
          ELSE ' 500 Failed to process onboarding data' END FROM R WHERE status <> 200"""),
    "stream_bookmarks": ORACLES["bookmark_state"],
    "stream_profiles": ORACLES["profile_fold"],
    "stream_rate_limit": ORACLES["rate_limited"],
    "stream_alerts": _with("P", "SELECT user_id, id_num, CAST(score AS INT) AS score FROM P WHERE score >= 90"),
}
