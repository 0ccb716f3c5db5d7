"""SQL of the collocations: all phrases by self-joins over word positions."""

from barloom.llm.phrases import DEPTH

_GRAMS = " UNION ALL ".join(
    f"SELECT lang, array_to_string(w[i:i + {k - 1}], ' ') AS phrase, {k} AS size FROM (SELECT lang, w, unnest(range(1, len(w) - {k - 2})) AS i FROM p)"
    for k in range(1, DEPTH + 1)
)

OP11 = rf"""
WITH s AS (SELECT coalesce(lang, 'und') AS lang,
    unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
p AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM s),
t AS (SELECT lang, sum(len(w))::HUGEINT AS n FROM p GROUP BY lang),
g AS MATERIALIZED (SELECT lang, phrase, size, count(*)::HUGEINT AS f FROM ({_GRAMS}) GROUP BY ALL HAVING count(*) >= 100),
c AS (SELECT *, string_split(phrase, ' ') AS w FROM g WHERE size > 1),
inside AS (SELECT DISTINCT lang, array_to_string(w[i:i + k - 1], ' ') AS phrase, f
  FROM (SELECT lang, w, f, k, unnest(range(1, size - k + 2)) AS i FROM (SELECT *, unnest(range(2, size)) AS k FROM c))),
kept AS (SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM inside i WHERE i.lang = c.lang AND i.phrase = c.phrase AND 100 * i.f >= 100 * c.f)),
cuts AS (SELECT lang, phrase, f AS a, k, array_to_string(w[1:k], ' ') AS lhs, array_to_string(w[k + 1:], ' ') AS rhs
  FROM (SELECT *, unnest(range(1, size)) AS k FROM kept)),
scored AS (SELECT cuts.*, x.f AS l, y.f AS r, n, (1000 * a * n) // (x.f * y.f) AS score FROM cuts
  JOIN g x ON x.lang = cuts.lang AND x.phrase = lhs JOIN g y ON y.lang = cuts.lang AND y.phrase = rhs JOIN t ON t.lang = cuts.lang),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score FROM o WHERE rank <= 2000
"""
