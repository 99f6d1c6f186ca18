"""DuckDB twin of the mix: every seat is handed out by itself, every block is a row."""

from __future__ import annotations

from loam.llm.mixing import BLOCK_WORDS, MOST, SHARD_BLOCKS


def sql(block: int = BLOCK_WORDS, shard: int = SHARD_BLOCKS, most: int = MOST, seed: int = 12) -> str:
    return rf"""
WITH sized AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
sums AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
src AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS g, {most} * source_size AS cap,
  (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w FROM sums),
-- the level if exactly the sources with a lower cap for each weight were full
levels AS (SELECT a.g, (SELECT sum(source_size) FROM src) - coalesce(sum(b.cap) FILTER (b.cap * a.w < a.cap * b.w), 0) AS num,
  sum(b.w) FILTER (b.cap * a.w >= a.cap * b.w) AS den, any_value(a.cap) AS cap, any_value(a.w) AS w FROM src a CROSS JOIN src b GROUP BY a.g),
level AS (SELECT num, den FROM levels WHERE w * num <= cap * den ORDER BY cap / w LIMIT 1),
tgt AS (SELECT src.*, CASE WHEN cap * den < w * num THEN cap::DOUBLE ELSE coalesce((w * num)::DOUBLE / nullif(den, 0), 0) END AS target,
  (source_size + {block - 1}) // {block} AS blocks FROM src LEFT JOIN level ON true),
seats AS (SELECT g, row_number() OVER (ORDER BY target / (2 * j + 1) DESC, g) AS nr
  FROM (SELECT g, target, unnest(range({most} * blocks)) AS j FROM tgt WHERE target > 0)),
won AS (SELECT g, count(*) AS won FROM seats WHERE nr <= (SELECT sum(source_size) // {block} FROM src) GROUP BY g),
shards AS (SELECT g, won, k, least({shard}, blocks - k * {shard}) AS b
  FROM (SELECT g, coalesce(won, 0) AS won, blocks, unnest(range((blocks + {shard - 1}) // {shard})) AS k FROM tgt LEFT JOIN won USING (g))),
shard_seats AS (SELECT g, k, won, row_number() OVER (PARTITION BY g ORDER BY b::DOUBLE / (2 * j + 1) DESC, k) AS nr
  FROM (SELECT *, unnest(range({most} * b)) AS j FROM shards)),
quotas AS (SELECT g, k, count(*) FILTER (nr <= won) AS quota FROM shard_seats GROUP BY g, k),
blocks AS (SELECT g, k, block, quota // b + (row_number() OVER (PARTITION BY g, k ORDER BY md5('{seed}:' || g || ':' || block), block) <= quota % b)::INT AS times
  FROM (SELECT g, k, b, quota, unnest(range(k * {shard}, k * {shard} + b)) AS block FROM shards JOIN quotas USING (g, k))),
placed AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lo,
  row_number() OVER () AS id FROM (SELECT doc_id, size, source_size, target, g FROM sized JOIN tgt ON sized.source IS NOT DISTINCT FROM tgt.source)),
given AS (SELECT id, sum(times * (least(lo + size, (block + 1) * {block}) - greatest(lo, block * {block}))) AS taken
  FROM placed JOIN blocks USING (g) WHERE block * {block} < lo + size AND (block + 1) * {block} > lo GROUP BY id)
SELECT doc_id, size::BIGINT AS size, source_size, target, coalesce(taken, 0)::BIGINT AS taken FROM placed LEFT JOIN given USING (id)"""
