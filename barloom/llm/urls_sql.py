"""SQL of the URL lists."""


def _host(url: str) -> str:
    low = f"coalesce(regexp_extract(CASE WHEN strpos({url}, '://') > 0 THEN substr({url}, strpos({url}, '://') + 3) END, '^[^/?#]*'), '')"
    return f"translate({low}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _part(url: str, pattern: str) -> str:
    return f"coalesce(regexp_extract(CASE WHEN strpos({url}, '://') > 0 THEN substr({url}, strpos({url}, '://') + 3) END, '{pattern}', 1), '')"


def _path(url: str) -> str:
    return _part(url, "^[^/?#]*([^?#]*)")


def _key(url: str) -> str:
    query = _part(url, r"^[^?#]*(\?[^#]*)")
    return f"CASE WHEN strpos({url}, '://') > 0 THEN {_host(url)} || {_path(url)} || {query} END"


RULES = """
rules(verdict, rule, h, p) AS (VALUES ('allow', 'org/', 'org', '/'), ('block', 'example.org/es/', 'example.org', '/es/'),
  ('block', 'example.org/en/1', 'example.org', '/en/1'), ('allow', 'com/fr/', 'com', '/fr/'), ('block', 'com/de/', 'com', '/de/'))"""

# The page keys hold host and path, which is all that a rule looks at.
OP8 = rf"""
WITH RECURSIVE {RULES},
pg AS (SELECT page_id, url, {_host("url")} AS host, {_path("url")} AS path, {_key("url")} AS key, coalesce(html, '') AS html FROM pages),
tags AS (SELECT url, key, host, path, unnest(regexp_extract_all(html, '(?is)<(?:link|meta)\b[^<>]*>')) AS tag FROM pg),
tos AS (SELECT *, CASE
    WHEN regexp_matches(tag, '(?is)\srel\s*=\s*["'']?canonical\b') THEN regexp_extract(tag, '(?is)\shref\s*=\s*["'']?([^"''\s>]+)', 1)
    WHEN regexp_matches(tag, '(?is)\shttp-equiv\s*=\s*["'']?refresh\b')
      THEN regexp_extract(tag, '(?is)\scontent\s*=\s*["'']?[^"''>]*?\burl\s*=\s*["'']?([^"''\s>]+)', 1) END AS t FROM tags),
absolute AS (SELECT key AS a, CASE WHEN contains(t, '://') THEN t WHEN t LIKE '//%' THEN 'http:' || t WHEN t LIKE '/%' THEN 'http://' || host || t
    ELSE 'http://' || host || regexp_replace(path, '[^/]*$', '') || t END AS target FROM tos WHERE t <> ''),
e0 AS (SELECT DISTINCT a, {_key("target")} AS b FROM absolute),
edges AS (SELECT a, b FROM e0 WHERE a <> b UNION SELECT b, a FROM e0 WHERE a <> b),
reach(a, b) AS (SELECT a, a FROM edges UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a),
node_rules AS (SELECT k, verdict FROM (SELECT k, verdict, row_number() OVER (PARTITION BY k ORDER BY len(rule) DESC) AS n
    FROM (SELECT DISTINCT b AS k FROM reach) JOIN rules ON (regexp_extract(k, '^[^/?#]*') = h OR regexp_extract(k, '^[^/?#]*') LIKE '%.' || h)
      AND starts_with(regexp_extract(k, '^[^/?#]*([^?#]*)', 1), p)) WHERE n = 1),
alias AS (SELECT a, CASE WHEN bool_or(verdict = 'allow') THEN 'allow' WHEN bool_or(verdict = 'block') THEN 'block' END AS v
    FROM reach LEFT JOIN node_rules ON b = k GROUP BY a),
own AS (SELECT page_id, host, path, key, arg_max(rule, len(rule)) AS rule, arg_max(verdict, len(rule)) AS verdict
    FROM pg LEFT JOIN rules ON (host = h OR host LIKE '%.' || h) AND starts_with(path, p) GROUP BY ALL)
SELECT page_id, host, path, rule, coalesce(verdict, v, 'allow') AS verdict FROM own LEFT JOIN alias ON key = a
"""
