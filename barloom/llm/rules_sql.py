"""SQL of the quality rules: the rounds of the estimate are written out one after the other."""

from barloom.llm.rules import BELIEF, CATCHES, PASSES, PRIOR, ROUNDS, RULES

_K = range(len(RULES))
_POST = "1 / (1 + exp(-(ln(prior / (1 - prior)) + " + " + ".join(
    f"CASE v{k} WHEN 1 THEN ln(a{k} / (1 - b{k})) WHEN -1 THEN ln((1 - a{k}) / b{k}) ELSE 0 END" for k in _K
) + ")))"
_VOTES = ", ".join(
    f"CASE WHEN {m} <= {good} THEN 1 WHEN {m} >= {bad} THEN -1 ELSE 0 END AS v{k}" for k, (_, m, good, bad) in enumerate(RULES)
)


def _share(belief, hits: str, total: str) -> str:
    start, low, high = belief
    return f"greatest({low}, least({high}, ({start * BELIEF} + {hits}) / ({BELIEF} + {total})))::DOUBLE"


def _mass(k: int, vote: int, weight: str) -> str:
    return f"sum(CASE WHEN v{k} = {vote} THEN n * {weight} ELSE 0 END)"


def _rule(k: int) -> str:
    up, down = _mass(k, 1, "post"), _mass(k, -1, "post")
    bad_up, bad_down = _mass(k, 1, "(1 - post)"), _mass(k, -1, "(1 - post)")
    return f"{_share(PASSES, up, f'({up} + {down})')} AS a{k}, {_share(CATCHES, bad_down, f'({bad_up} + {bad_down})')} AS b{k}"


def _round(k: int) -> str:
    return (
        f"it{k} AS MATERIALIZED (SELECT {_share(PRIOR, 'sum(n * post)', 'sum(n)')} AS prior, {', '.join(map(_rule, _K))}"
        f" FROM (SELECT p.*, {_POST} AS post FROM p, it{k - 1}))"
    )


_START = f"it0 AS (SELECT {PRIOR[0]}::DOUBLE AS prior, " + ", ".join(
    f"{PASSES[0]}::DOUBLE AS a{k}, {CATCHES[0]}::DOUBLE AS b{k}" for k in _K
) + ")"
_VS = ", ".join(f"v{k}" for k in _K)

OP4 = rf"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
wins AS (SELECT r, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM t)),
dup AS (SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS k FROM wins),
rep AS (SELECT r, count(DISTINCT i + j) AS n_repeat_words FROM dup, (VALUES (0), (1), (2)) AS o(j) WHERE k > 1 GROUP BY r),
m AS (SELECT doc_id, len(w)::BIGINT AS n_words, len(array_to_string(w, ''))::BIGINT AS word_chars,
    len(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
    coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, len(l) AS n_lines,
    len(regexp_replace(text, '[^\p{{Lu}}]+', '', 'g')) AS n_capitals, len(regexp_replace(text, '[^!]+', '', 'g')) AS n_exclamations
  FROM t LEFT JOIN rep USING (r)),
v AS (SELECT *, {_VOTES} FROM m WHERE n_words > 0),
p AS MATERIALIZED (SELECT {_VS}, count(*)::DOUBLE AS n FROM v GROUP BY {_VS}),
{_START}, {", ".join(_round(k) for k in range(1, ROUNDS + 1))},
j AS (SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, {_POST} >= 0.5 AS good FROM v, it{ROUNDS}
  UNION ALL SELECT doc_id, 0, 0, n_symbols, 0, 0, true, false FROM m WHERE n_words = 0)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND good AS kept FROM j
"""
