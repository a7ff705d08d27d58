"""The same results as DuckDB SQL, written from the rules of the derived tables."""

from __future__ import annotations

# Pages numbered within their host.
_SITE = """
site AS (
  SELECT page_id, host, row_number() OVER (PARTITION BY host ORDER BY page_id) - 1 AS k,
         count(*) OVER (PARTITION BY host) AS n
  FROM (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host FROM pages)),
named AS (
  SELECT *, CASE WHEN k % 5 = 0 AND k > 0 THEN '/contact/p' ELSE '/p' END || k AS path,
         k % 13 = 12 AS bad, k % 11 = 7 AND 2 * k + 1 < n AS refr
  FROM site)
"""

# Links of the site pages: slot 0-3 as laid out, then those that leave the host.
_EDGES = """
slot AS (
  SELECT host, k, n, bad, refr, 0 AS slot, k + 1 AS dst FROM named
  UNION ALL SELECT host, k, n, bad, refr, 1, 2 * k + 1 FROM named
  UNION ALL SELECT host, k, n, bad, refr, 2, 2 * k + 2 FROM named
  UNION ALL SELECT host, k, n, bad, refr, 3, (k - 1) // 2 FROM named WHERE k > 0),
inside AS (
  SELECT *, row_number() OVER (PARTITION BY host, k ORDER BY slot) - 1 AS place,
         count(*) OVER (PARTITION BY host, k) AS links
  FROM slot WHERE dst < n),
edge AS (
  SELECT host, k, dst, CASE WHEN refr THEN 0 ELSE place END AS pos,
         CASE WHEN refr THEN 0 WHEN dst % 5 = 0 AND dst > 0 THEN 0 ELSE 1 END AS cost,
         refr
  FROM inside WHERE NOT bad AND (NOT refr OR slot = 1))
"""
_LINKS = f"{_SITE}, {_EDGES}"

_URL = "'https://' || {p}.host || {p}.path"

# Walks from the pages in "first", least depth, and the addresses on them.
_REACH = (
    _EDGES
    + """,
walk AS (
  SELECT host, k AS start, k, 0 AS depth FROM first
  UNION
  SELECT walk.host, walk.start, edge.dst, walk.depth + edge.cost
  FROM walk JOIN edge ON edge.host = walk.host AND edge.k = walk.k
  WHERE walk.depth + edge.cost <= 3),
reach AS (SELECT host, start, k, min(depth) AS depth FROM walk GROUP BY ALL),
mail AS (
  SELECT DISTINCT reach.host, reach.start, 'info.' || (reach.k % 7) || '@' || reach.host AS email
  FROM reach JOIN named USING (host, k) WHERE NOT bad AND NOT refr)
"""
)
_FIRST = f"WITH RECURSIVE {_SITE}, first AS (SELECT host, k FROM named WHERE k = 0),"

# What is stored per site page.
_RESULTS = (
    _SITE
    + """,
result AS (
  SELECT page_id, host, k, path, sha256(lower(host) || path) AS key, 'r' || page_id AS scan_id,
         TIMESTAMP '2022-11-01' + to_days(CAST(7 * k AS INTEGER)) AS cached_at, 3 AS depth,
         CAST(k + 1 AS INTEGER) AS pages_visited,
         CASE WHEN k % 10 = 9 THEN [] WHEN k % 2 = 0
              THEN ['info.' || (k % 7) || '@' || host, 'office@' || host]
              ELSE ['info.' || (k % 7) || '@' || host] END AS mails
  FROM named),
full_result AS (
  SELECT *, CAST(len(mails) AS INTEGER) AS n_emails, array_to_string(mails, ',') AS emails,
         TIMESTAMP '2024-01-15' < cached_at + INTERVAL 360 DAY AS live
  FROM result)
"""
)

_SEEDS = """
seeds AS (
  SELECT page_id * 4 + spelling AS seed_id, host, k, page_id * 4 AS leader
  FROM named, range(4) AS s(spelling) WHERE k = 0
  UNION ALL SELECT page_id * 4, host, k, page_id * 4 FROM named WHERE k > 0)
"""

_TIME = "strftime({c}, '%Y-%m-%d %H:%M:%S')"

# Body text of the given pages, by plain text replacement.
_BODY = r"""
stripped AS (
  SELECT page_id, url, html, regexp_replace(regexp_replace(
           regexp_extract(html, '(?s)<body[^>]*>(.*)$', 1),
           '(?s)<!--.*?-->', '', 'g'), '<[^>]*>', '', 'g') AS markup
  FROM pages),
text AS (
  SELECT page_id, url, regexp_replace(replace(replace(replace(markup, '&quot;', '"'),
           '&copy;', '©'), '&middot;', '·'), '&amp;?', '&', 'g') AS body
  FROM stripped)
"""
_ADDRESS = "[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\.[a-zA-Z]{2,}"
_HOST = "regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)"
_PATH = "regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1)"

_JOB_EVENTS = """
events_of_jobs AS (
  SELECT job_id, ts, event_id AS seq,
         CASE WHEN row_number() OVER (PARTITION BY job_id ORDER BY ts, event_id) = 1 THEN 'enqueue'
              WHEN event_type = 'purchase' THEN 'complete' WHEN event_type = 'error' THEN 'fail'
              WHEN event_type = 'click' THEN 'cancel' ELSE 'start' END AS action
  FROM (SELECT *, user_id || '-' || strftime(date_trunc('week', ts), '%Y%m%d') AS job_id
        FROM events)),
guarded AS (
  SELECT *, action = 'cancel' AND coalesce(
           last_value(CASE WHEN action <> 'cancel' THEN action END IGNORE NULLS) OVER (
             PARTITION BY job_id ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING
           ) = 'start', false) AS refused
  FROM events_of_jobs),
segmented AS (
  SELECT *, count(*) FILTER (action IN ('enqueue', 'complete', 'fail')) OVER (
           PARTITION BY job_id ORDER BY ts, seq) AS seg
  FROM guarded),
gapped AS (
  SELECT *, coalesce(ts - last_value(CASE WHEN NOT refused THEN ts END IGNORE NULLS) OVER (
                       PARTITION BY job_id, seg ORDER BY ts, seq
                       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
                     >= INTERVAL 24 HOUR, false) AS gap
  FROM segmented),
judged AS (
  SELECT *, bool_or(gap) OVER (PARTITION BY job_id, seg ORDER BY ts, seq) AS expired FROM gapped),
job AS (
  SELECT job_id,
         CASE arg_max(action, (ts, seq)) WHEN 'enqueue' THEN 'queued' WHEN 'start' THEN 'processing'
           WHEN 'complete' THEN 'completed' WHEN 'fail' THEN 'failed' ELSE 'cancelled' END AS status,
         min(ts) FILTER (action = 'enqueue') AS created_at,
         max(ts) FILTER (action = 'start') AS started_at,
         max(ts) FILTER (action IN ('complete', 'fail', 'cancel')) AS completed_at,
         max(ts) AS updated_at,
         NOT bool_or(action IN ('complete', 'fail', 'cancel')) AS active,
         TIMESTAMP '2024-01-31' < max(ts) + INTERVAL 24 HOUR AS visible
  FROM judged WHERE NOT expired AND NOT refused GROUP BY job_id)
"""

_OUTCOMES = (
    _RESULTS
    + """,
finished AS (
  SELECT 'job-' || event_id AS job_id, event_id, user_id, 10 * value AS crawl_seconds,
         r.scan_id, r.pages_visited AS old_pages, r.n_emails AS old_emails, r.emails AS old_list,
         event_id % 50 <> 49 AND coalesce(r.live, false) AS hit,
         CASE WHEN event_id % 50 = 49 THEN 'https://bad host/' || user_id
              ELSE coalesce('https://' || r.host || r.path, 'https://new.invalid/u' || user_id)
         END AS url
  FROM events LEFT JOIN full_result r ON r.page_id = user_id),
outcome AS (
  SELECT *, CASE WHEN hit THEN NULL WHEN event_id % 50 = 49 THEN 'Invalid URL: ' || url
                 WHEN crawl_seconds >= 300 THEN 'Job timed out' END AS error
  FROM finished),
told AS (
  SELECT *, CASE WHEN error IS NULL THEN 'completed' ELSE 'failed' END AS status,
         CASE WHEN hit THEN old_pages WHEN error IS NULL THEN 4 ELSE 0 END AS pages_visited,
         CASE WHEN hit THEN old_emails WHEN error IS NULL THEN 2 ELSE 0 END AS n_emails
  FROM outcome)
"""
)

_ATTEMPTS = """
attempts AS (
  SELECT user_id || '-' || strftime(ts, '%Y%m%d') AS job_id,
         row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS attempt,
         CASE event_type WHEN 'purchase' THEN 200 WHEN 'view' THEN 204 WHEN 'click' THEN 302
                         WHEN 'error' THEN 500 END AS http_status
  FROM events)
"""

_REQUEST = """
spelt AS (
  SELECT page_id * 4 + spelling AS id, spelling, host,
         CASE spelling WHEN 0 THEN 'https://' || host || '/p0' WHEN 1 THEN host || '/p0'
              WHEN 2 THEN 'https://' || upper(host) || '/p0/'
              ELSE 'http://' || host || '/p0?x=1' END AS url
  FROM named, range(4) AS s(spelling) WHERE k = 0),
request AS (
  SELECT id, host, id % 8 AS kind, CASE WHEN spelling = 1 THEN 'https://' || url ELSE url END AS target
  FROM spelt)
"""
_REQUEST_KINDS = f"{_SITE}, {_REQUEST}"


def _decoded_host_and_path() -> str:
    return f"lower({_HOST}) || regexp_replace({_PATH}, '/$', '')"


ORACLES: dict[str, str] = {
    "url_parts": f"""
        SELECT page_id, regexp_extract(url, '^([a-z]+):', 1) AS scheme, {_HOST} AS host,
               {_PATH} AS path, regexp_extract(url, '[?]([^#]*)', 1) AS query,
               regexp_extract(url, '#(.*)$', 1) AS fragment
        FROM pages""",
    "url_key": f"""
        SELECT page_id, sha256({_decoded_host_and_path()}) AS key,
               sha256({_decoded_host_and_path()}) AS bare_key,
               sha256(regexp_replace({_HOST} || {_PATH}, '/$', '')) AS compat_key,
               CASE WHEN contains(url, '?') AND NOT contains(url, '#')
                    THEN sha256({_decoded_host_and_path()}) ELSE sha256(url || '%') END AS broken_key
        FROM pages""",
    "canonical_links": f"""
        WITH hrefs AS (
          SELECT page_id, url, unnest(list) AS href, generate_subscripts(list, 1) - 1 AS pos
          FROM (SELECT page_id, url, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS list
                FROM pages))
        SELECT url AS src, pos, href,
               regexp_extract(url, '^[a-z]+://[^/?#]+') ||
               CASE WHEN regexp_full_match(href, '[A-Za-z0-9._~,/-]*') THEN href
                    ELSE replace(replace(url_encode(href), '%2F', '/'), '%2C', ',') END AS dst
        FROM hrefs""",
    "contact_links": f"""
        WITH {_LINKS},
        every AS (
          SELECT host, k, pos, 'https://' || host ||
                   CASE WHEN dst % 5 = 0 AND dst > 0 THEN '/contact/p' ELSE '/p' END || dst AS dst,
                 CASE WHEN refr THEN 'refresh' ELSE 'link' END AS kind,
                 dst % 5 = 0 AND dst > 0 AS contact, cost
          FROM edge
          UNION ALL
          SELECT host, k, links, 'https://other.invalid/contact', 'link', true, 0
          FROM (SELECT n.host, n.k, count(i.slot) AS links
                FROM named n LEFT JOIN inside i USING (host, k)
                WHERE NOT n.bad AND NOT n.refr AND n.k % 3 = 0 GROUP BY ALL)
          UNION ALL
          SELECT host, k, links + 1, 'mailto:hidden@' || host, 'link', false, 1
          FROM (SELECT n.host, n.k, count(i.slot) AS links
                FROM named n LEFT JOIN inside i USING (host, k)
                WHERE NOT n.bad AND NOT n.refr AND n.k % 3 = 0 GROUP BY ALL))
        SELECT {_URL.format(p="named")} AS src, pos, dst, kind, contact,
               CAST(cost AS INTEGER) AS cost
        FROM every JOIN named USING (host, k)""",
    "link_graph": f"""
        WITH {_LINKS}
        SELECT {_URL.format(p="a")} AS src, pos, {_URL.format(p="b")} AS dst,
               CAST(cost AS INTEGER) AS cost
        FROM edge JOIN named a ON a.host = edge.host AND a.k = edge.k
             JOIN named b ON b.host = edge.host AND b.k = edge.dst""",
    "meta_refresh_targets": f"""
        WITH {_SITE}
        SELECT {_URL.format(p="a")} AS url, {_URL.format(p="b")} AS target
        FROM named a JOIN named b ON b.host = a.host AND b.k = 2 * a.k + 1
        WHERE a.refr AND NOT a.bad""",
    "page_emails": f"""
        WITH {_BODY},
        hit AS (SELECT DISTINCT page_id, {_HOST} AS host,
                       lower(unnest(regexp_extract_all(body, '{_ADDRESS}'))) AS email FROM text)
        SELECT host, email, count(*) AS pages FROM hit GROUP BY ALL""",
    "document_emails": f"""
        SELECT doc_id, CAST(len(hits) AS INTEGER) AS n_hits, array_to_string(hits, ',') AS emails
        FROM (SELECT doc_id, list_transform(regexp_extract_all(text, '{_ADDRESS}'),
                                            lambda m: lower(m)) AS hits FROM documents)
        WHERE len(hits) > 0""",
    "dedup_emails": f"""
        SELECT doc_id, array_to_string(clean, ',') AS emails,
               CAST(2 * len(hits) + 2 AS INTEGER) AS n_untidy,
               CASE WHEN len(clean) > 0 THEN array_to_string(clean, ',') END AS shown
        FROM (SELECT doc_id, hits,
                     list_sort(list_distinct(list_transform(hits, lambda m: lower(m)))) AS clean
              FROM (SELECT doc_id, regexp_extract_all(text, '{_ADDRESS}') AS hits
                    FROM documents))""",
    "host_emails": f"""
        WITH {_SITE}, {_BODY},
        found AS (
          SELECT host, 'info.' || (k % 7) || '@' || host AS email FROM named
          WHERE NOT bad AND NOT refr
          UNION
          SELECT {_HOST}, lower(unnest(regexp_extract_all(body, '{_ADDRESS}'))) FROM text)
        SELECT host, 0 AS part, string_agg(email, ',' ORDER BY email) AS emails
        FROM found GROUP BY host""",
    "email_hits": f"""
        WITH {_SITE}
        SELECT host, count(*) AS hits FROM named WHERE NOT bad AND NOT refr GROUP BY host""",
    "page_preview": f"""
        WITH {_BODY}
        SELECT url, replace(left(body, 200), chr(10), ' ') AS preview,
               CAST(len(regexp_extract_all(body, '{_ADDRESS}')) AS INTEGER) AS hits
        FROM text""",
    "latest_snapshots": "SELECT page_id, url FROM pages",
    "validate_seeds": """
        SELECT page_id AS seed_id,
               CASE page_id % 6
                 WHEN 1 THEN 'https://' || regexp_replace(url, '^https?://', '')
                 WHEN 2 THEN NULL WHEN 3 THEN replace(url, '://', '://bad host.')
                 WHEN 4 THEN 'https://' WHEN 5 THEN url || '#%zz' ELSE url END AS target,
               CASE WHEN page_id % 6 = 2 THEN 'Missing ''url'' parameter'
                    WHEN page_id % 6 IN (3, 5) THEN 'Invalid URL provided' END AS error
        FROM pages""",
    "validate_requests": f"""
        WITH {_REQUEST_KINDS}
        SELECT id AS request_id,
               CASE WHEN kind IN (1, 2, 3) THEN NULL WHEN kind = 5 THEN target || chr(1)
                    ELSE target END AS target,
               CASE WHEN kind IN (1, 4) THEN NULL WHEN kind = 7 THEN 'http://hook.invalid:x/' || id
                    ELSE 'http://hook.invalid/' || id END AS webhook_url,
               CASE WHEN kind IN (1, 6) THEN NULL ELSE 'cb-' || id END AS callback_id,
               CASE kind WHEN 1 THEN 'Invalid JSON format' WHEN 2 THEN 'Missing ''url'' field'
                         WHEN 3 THEN 'Missing ''url'' field'
                         WHEN 4 THEN 'Missing ''webhook_url'' field'
                         WHEN 5 THEN 'Invalid URL format'
                         WHEN 7 THEN 'Invalid webhook_url format' END AS error
        FROM request""",
    "crawl_reach": f"""
        {_FIRST} {_REACH}
        SELECT {_URL.format(p="a")} AS start, {_URL.format(p="b")} AS url,
               CAST(depth AS INTEGER) AS depth
        FROM reach JOIN named a ON a.host = reach.host AND a.k = reach.start
             JOIN named b ON b.host = reach.host AND b.k = reach.k""",
    # One try per step: the last of the list is taken off; a page met first within the bound puts its links on.
    "crawl_exact_reach": f"""
        {_FIRST} {_EDGES},
        follow AS (
          SELECT host, k, list({{'k': dst, 'd': cost}} ORDER BY pos DESC) AS links
          FROM edge GROUP BY host, k),
        walk AS (
          SELECT host, k AS start, [{{'k': k, 'd': 0}}] AS todo, [-1] AS seen, -1 AS k, -1 AS depth
          FROM first
          UNION ALL
          SELECT host, start,
                 CASE WHEN took THEN list_concat(todo[:-2], list_transform(
                   coalesce(links, []), lambda x: {{'k': x.k, 'd': x.d + top.d}})) ELSE todo[:-2] END,
                 CASE WHEN took THEN list_append(seen, top.k) ELSE seen END,
                 CASE WHEN took THEN top.k ELSE -1 END, top.d
          FROM (SELECT w.host, w.start, w.todo, w.seen, w.todo[-1] AS top, f.links,
                       w.todo[-1].d <= 3 AND NOT list_contains(w.seen, w.todo[-1].k) AS took
                FROM walk w LEFT JOIN follow f ON f.host = w.host AND f.k = w.todo[-1].k
                WHERE len(w.todo) > 0) t)
        SELECT {_URL.format(p="a")} AS start, {_URL.format(p="b")} AS url,
               CAST(depth AS INTEGER) AS depth
        FROM walk JOIN named a ON a.host = walk.host AND a.k = walk.start
             JOIN named b ON b.host = walk.host AND b.k = walk.k
        WHERE walk.k >= 0""",
    "crawl_emails": f"""
        {_FIRST} {_REACH}
        SELECT {_URL.format(p="named")} AS start, email
        FROM mail JOIN named ON named.host = mail.host AND named.k = mail.start""",
    "crawl_figures": f"""
        {_FIRST} {_REACH}
        SELECT {_URL.format(p="named")} AS start, CAST(pages AS INTEGER) AS pages_visited,
               CAST(deepest AS INTEGER) AS max_depth_reached,
               CAST((SELECT count(*) FROM mail WHERE mail.host = r.host) AS INTEGER)
                 AS compat_pages_visited, 3 AS depth
        FROM (SELECT host, start, count(*) AS pages, max(depth) AS deepest
              FROM reach GROUP BY ALL) r
             JOIN named ON named.host = r.host AND named.k = r.start""",
    "scan_batch": f"""
        WITH RECURSIVE {_RESULTS}, {_SEEDS},
        first AS (SELECT host, k FROM full_result WHERE NOT live),
        {_REACH},
        fresh AS (
          SELECT r.host, r.start AS k, CAST(r.pages AS INTEGER) AS pages_visited,
                 CAST(coalesce(m.n, 0) AS INTEGER) AS n_emails, coalesce(m.emails, '') AS emails
          FROM (SELECT host, start, count(*) AS pages FROM reach GROUP BY ALL) r
          LEFT JOIN (SELECT host, start, count(*) AS n, string_agg(email, ',' ORDER BY email)
                       AS emails FROM mail GROUP BY ALL) m USING (host, start))
        SELECT seed_id, true AS from_cache, depth, pages_visited, n_emails, emails,
               CAST(NULL AS VARCHAR) AS error
        FROM seeds JOIN full_result USING (host, k) WHERE live
        UNION ALL
        SELECT seed_id, seed_id <> leader, 3, pages_visited, n_emails, emails, NULL
        FROM seeds JOIN fresh USING (host, k)""",
    "scan_uncached": f"""
        {_FIRST} {_REACH}, {_SEEDS}
        SELECT seed_id, false AS from_cache,
               CASE WHEN (seed_id - leader) IN (2, 3) THEN 1 ELSE (
                 SELECT CAST(count(*) AS INTEGER) FROM reach WHERE reach.host = seeds.host)
               END AS pages_visited,
               CASE WHEN (seed_id - leader) IN (2, 3) THEN 0 ELSE (
                 SELECT CAST(count(*) AS INTEGER) FROM mail WHERE mail.host = seeds.host)
               END AS n_emails
        FROM seeds WHERE k = 0""",
    "scan_messages": f"""
        WITH {_RESULTS}, {_SEEDS}
        SELECT seed_id, 0 AS part, CASE WHEN n_emails > 0 THEN emails END AS emails,
               true AS from_cache, n_emails > 0 AS has_emails
        FROM seeds JOIN full_result USING (host, k) WHERE live""",
    "cache_hits": f"""
        WITH {_RESULTS}, {_SEEDS}
        SELECT seed_id, key, {_TIME.format(c="cached_at")} AS cached_at,
               {_TIME.format(c="cached_at + INTERVAL 360 DAY")} AS expires_at,
               depth, pages_visited, n_emails
        FROM seeds JOIN full_result USING (host, k) WHERE live""",
    "cache_misses": f"""
        WITH {_RESULTS}, {_SEEDS}
        SELECT seed_id, key FROM seeds JOIN full_result USING (host, k) WHERE NOT live""",
    "cache_upsert": f"""
        WITH {_RESULTS}
        SELECT key, CASE WHEN page_id % 3 = 0 THEN 'w' || page_id ELSE scan_id END AS scan_id,
               CASE WHEN page_id % 3 = 0 THEN {_TIME.format(c="cached_at + INTERVAL 1 DAY")}
                    ELSE {_TIME.format(c="cached_at")} END AS cached_at,
               CASE WHEN page_id % 3 = 0 THEN 2 ELSE depth END AS depth,
               CASE WHEN page_id % 3 = 0 THEN 1 ELSE pages_visited END AS pages_visited,
               CASE WHEN page_id % 3 = 0 THEN 1 ELSE n_emails END AS n_emails,
               CASE WHEN page_id % 3 = 0 THEN 'w' || page_id || '@new.org' ELSE emails END AS emails
        FROM full_result""",
    "cache_import": f"""
        WITH {_RESULTS}
        SELECT key, 'import' AS scan_id, {_TIME.format(c="cached_at")} AS cached_at, depth,
               pages_visited, n_emails, emails
        FROM full_result WHERE page_id % 5 <> 0""",
    "cache_invalidate": f"""
        WITH {_RESULTS}
        SELECT key, scan_id, {_TIME.format(c="cached_at")} AS cached_at, depth, pages_visited,
               n_emails, emails
        FROM full_result WHERE k % 2 <> 0""",
    "cache_purge": f"""
        WITH {_RESULTS}
        SELECT key, scan_id, {_TIME.format(c="cached_at")} AS cached_at, depth, pages_visited,
               n_emails, emails
        FROM full_result WHERE live""",
    "cache_clear": f"WITH {_RESULTS} SELECT key, scan_id FROM full_result WHERE false",
    "cache_stats": f"""
        WITH {_RESULTS}
        SELECT true AS enabled, count(*) AS cached_urls FROM full_result WHERE live""",
    "job_state": f"""
        WITH {_JOB_EVENTS}
        SELECT job_id, status, epoch_us(created_at) AS created_at,
               epoch_us(started_at) AS started_at, epoch_us(completed_at) AS completed_at,
               epoch_us(updated_at) AS updated_at, active, visible
        FROM job""",
    "job_status": f"""
        WITH {_JOB_EVENTS}
        SELECT job_id, CASE WHEN visible THEN status END AS status,
               CASE WHEN NOT visible THEN 'Job not found' END AS error FROM job
        UNION ALL SELECT job_id || '-x', NULL, 'Job not found' FROM job""",
    "cancel_guard": f"""
        WITH {_JOB_EVENTS}
        SELECT job_id, seq, refused AND NOT expired AS refused FROM judged WHERE action = 'cancel'""",
    "job_expiry": f"""
        WITH {_JOB_EVENTS} SELECT job_id, seq, action FROM judged WHERE expired""",
    "latest_jobs": f"""
        WITH {_JOB_EVENTS}
        SELECT job_id, arg_max(seq, (ts, seq)) AS seq, arg_max(action, (ts, seq)) AS action
        FROM events_of_jobs GROUP BY job_id""",
    "queue_next": f"""
        WITH {_JOB_EVENTS}
        SELECT job_id, epoch_us(created_at) AS created_at FROM job WHERE status = 'queued'
        ORDER BY job.created_at, job_id LIMIT 5""",
    "queue_stats": f"""
        WITH {_JOB_EVENTS}
        SELECT count(*) FILTER (status = 'queued') AS queue_size,
               count(*) FILTER (active) AS active_jobs FROM job""",
    "jobs_overview": f"""
        WITH {_JOB_EVENTS}
        SELECT true AS async_enabled, count(*) FILTER (status = 'queued') AS queue_size,
               count(*) FILTER (active) AS active_jobs, 3 AS workers, 300 AS job_timeout_s
        FROM job""",
    "active_jobs": f"WITH {_JOB_EVENTS} SELECT job_id FROM job WHERE active",
    "remove_ids": f"""
        WITH {_JOB_EVENTS} SELECT job_id FROM job WHERE active AND status <> 'queued'""",
    "accept_responses": f"""
        WITH {_REQUEST_KINDS}
        SELECT CAST(id AS VARCHAR) AS job_id, 'queued' AS status, '30-60s' AS estimated_time,
               'http://hook.invalid/' || id AS webhook_url,
               '/scan/status/' || id AS check_status_url
        FROM request WHERE kind IN (0, 6)""",
    "job_outcome_rows": f"""
        WITH {_OUTCOMES}
        SELECT job_id, status, error, CAST(pages_visited AS INTEGER) AS pages_visited,
               CAST(n_emails AS INTEGER) AS n_emails, hit AS from_cache,
               error IS NULL AND NOT hit AS kept
        FROM told""",
    "jobs_from_results": f"""
        WITH {_OUTCOMES}
        SELECT job_id, scan_id, old_pages AS pages_visited, old_emails AS n_emails
        FROM finished WHERE hit""",
    "webhook_payloads": f"""
        WITH {_OUTCOMES}
        SELECT job_id, 'https://hook.invalid/' || user_id AS webhook_url, 0 AS part,
               CASE WHEN event_id % 3 = 0 THEN 'cb-' || user_id END AS callback_id, status, url,
               CASE WHEN hit AND old_emails > 0 THEN old_list END AS emails,
               CASE WHEN pages_visited > 0 THEN CAST(pages_visited AS INTEGER) END AS pages_visited,
               '2024-01-15T00:00:00' AS completed_at, error
        FROM told WHERE event_id % 4 <> 3""",
    "delivery_outcomes": f"""
        WITH {_ATTEMPTS},
        summary AS (
          SELECT job_id, CAST(min(attempt) FILTER (http_status BETWEEN 200 AND 299) AS INTEGER)
                   AS delivered_at, CAST(max(attempt) AS INTEGER) AS tried
          FROM attempts WHERE attempt <= 3 GROUP BY job_id)
        SELECT job_id, delivered_at IS NOT NULL AS delivered, delivered_at,
               coalesce(delivered_at, tried) AS attempts,
               coalesce(delivered_at, tried) * (coalesce(delivered_at, tried) - 1) AS waited_s
        FROM summary""",
    "backoff_schedule": f"""
        WITH {_ATTEMPTS}
        SELECT job_id, CAST(a AS INTEGER) AS attempt, CAST(2 * a AS INTEGER) AS wait_s
        FROM (SELECT DISTINCT job_id FROM attempts), generate_series(1, 2) AS s(a)""",
    "stream_contacts": f"""
        WITH {_SITE}
        SELECT DISTINCT host, 'info.' || (k % 7) || '@' || host AS email
        FROM named WHERE NOT bad AND NOT refr""",
    "stream_job_state": f"""
        WITH {_JOB_EVENTS}
        SELECT job_id, status, epoch_us(created_at) AS created_at,
               epoch_us(started_at) AS started_at, epoch_us(completed_at) AS completed_at,
               epoch_us(updated_at) AS updated_at, active
        FROM job""",
    # Every host has one good request; the one in capitals leads to no stored page.
    "stream_scan": f"""
        {_FIRST} {_REACH}, {_REQUEST}
        SELECT target AS url, 'http://hook.invalid/' || id AS webhook_url,
               CASE WHEN kind = 0 THEN 'cb-' || id END AS callback_id, 'completed' AS status,
               CAST(CASE WHEN kind = 0 THEN (SELECT count(*) FROM reach
                    WHERE reach.host = request.host) ELSE 1 END AS INTEGER) AS pages_visited,
               CAST(CASE WHEN kind = 0 THEN (SELECT count(*) FROM mail
                    WHERE mail.host = request.host) ELSE 0 END AS INTEGER) AS n_emails
        FROM request WHERE kind IN (0, 6)""",
}

# The keyed stream keeps the same job state as the stream that rewrites it whole.
ORACLES["stream_job_keyed"] = ORACLES["stream_job_state"]
# Records upserted part by part end as the whole log folded at once.
ORACLES["jobs_upsert"] = ORACLES["stream_job_state"]
# Published results are the upserted ones.
ORACLES["cache_publish"] = ORACLES["cache_upsert"]
# A scan over stored parsed pages answers as one that parses them.
ORACLES["scan_stored"] = ORACLES["scan_batch"]
# Refolded on late actions, the stream ends where the whole log folded at once does.
ORACLES["stream_job_refold"] = ORACLES["stream_job_state"]
