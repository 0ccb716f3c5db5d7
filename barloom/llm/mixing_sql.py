"""SQL of the mix."""

OP2 = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size
  FROM documents
), s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
n AS (SELECT *, [3.0, 1.0, 2.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS weight,
        [-0.5, 0.0, 0.5][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS tilt,
        source_size * 2.0::DOUBLE AS cap FROM s),
l AS (SELECT *, (sum(source_size) OVER ()::DOUBLE * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST
          ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM n),
t AS (SELECT *, least(cap, coalesce(max(level) FILTER (level * weight <= cap) OVER () * weight, cap)) AS target FROM l),
p AS (SELECT d.*, source_size, target, tilt, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY
          ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT % 65536, md5(coalesce(doc_id::VARCHAR, '')), doc_id, size
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
w AS (SELECT *, greatest(0, least(size, floor(target)::BIGINT - start)) AS w0,
        greatest(0, least(size, floor(target)::BIGINT - start - source_size)) AS w1 FROM p)
SELECT doc_id, size, source_size, target, (w0 + w1)::BIGINT AS taken,
  CASE WHEN w0 > 0 THEN 2 * q / ((1 - tilt) + sqrt((1 - tilt) * (1 - tilt) + 4 * tilt * q)) WHEN w1 > 0 THEN
    2 * q1 / ((1 - tilt) + sqrt((1 - tilt) * (1 - tilt) + 4 * tilt * q1)) END AS position
FROM (SELECT *, (start + w0 / 2.0::DOUBLE) / target AS q, (start + source_size + w1 / 2.0::DOUBLE) / target AS q1 FROM w)
"""
