"""DuckDB SQL for the mixing query.

Seats are stated plainly: every quotient of every source, and of every shard, is listed and the highest win. Nothing is
searched for, so the statement shares no step with the divisors of the Spark code; only the rule is the same.
"""

from tidemark.llm.mixing import BLOCK_WORDS, MOST_PASSES, MOST_SHARDS, SHARD_BLOCKS, SHARD_ROWS

SQL = rf"""
WITH sized AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN 'null' ELSE '=' || source END AS k,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5('mix-1:' || coalesce(doc_id::VARCHAR, '')) AS drawn
  FROM documents),
most AS (SELECT least({MOST_SHARDS}, greatest(1, (count(*) + {SHARD_ROWS - 1}) // {SHARD_ROWS})) AS most_shards FROM sized),
src AS (SELECT k, sum(size)::BIGINT AS source_size FROM sized GROUP BY k),
weighed AS (
  SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY k = 'null', k) - 1) % 3) + 1] AS weight, {MOST_PASSES} * source_size AS cap, sum(source_size) OVER ()::BIGINT AS total,
         row_number() OVER (ORDER BY k = 'null', k) AS at_
  FROM src),
-- With the sources in the order in which they reach their caps, the level is highest where the last capped one ends.
levels AS (
  SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / weight, at_ ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
            / (sum(weight) OVER (ORDER BY cap / weight, at_ ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
  FROM weighed),
targets AS (
  SELECT k, source_size, least(cap::DOUBLE, max(level) OVER () * weight) AS target, round(total / {BLOCK_WORDS})::BIGINT AS seats,
         greatest(1, least((SELECT most_shards FROM most), source_size // {BLOCK_WORDS * SHARD_BLOCKS}))::BIGINT AS shards
  FROM levels),
source_quotients AS (SELECT k, seats, target, unnest(range(0, seats)) AS s FROM targets WHERE target > 0),
source_seats AS (
  SELECT k, count(*) AS blocks
  FROM (SELECT k, seats, row_number() OVER (ORDER BY target / (2 * s + 1) DESC, k) AS place FROM source_quotients) WHERE place <= seats GROUP BY k),
sources AS (SELECT targets.*, coalesce(blocks, 0) AS blocks FROM targets LEFT JOIN source_seats USING (k)),
dealt AS (
  SELECT sized.*, source_size, target, blocks, ('0x' || substr(drawn, 9, 8))::BIGINT % shards AS shard
  FROM sized JOIN sources USING (k)),
shard_words AS (SELECT k, shard, blocks, sum(size)::BIGINT AS words FROM dealt WHERE size > 0 GROUP BY ALL),
shard_quotients AS (SELECT *, unnest(range(0, {MOST_PASSES} * words // {BLOCK_WORDS})) AS s FROM shard_words),
shard_seats AS (
  SELECT k, shard, count(*) AS quota
  FROM (SELECT k, shard, blocks, row_number() OVER (PARTITION BY k ORDER BY words / (2 * s + 1) DESC, shard) AS place FROM shard_quotients) WHERE place <= blocks GROUP BY ALL),
quotas AS (SELECT w.*, coalesce(quota, 0) AS quota, {MOST_PASSES} * words - coalesce(quota, 0) * {BLOCK_WORDS} AS room FROM shard_words w LEFT JOIN shard_seats USING (k, shard)),
-- Words of blocks that no shard holds whole fill the shards' room, those with the highest next quotient first.
filled AS (
  SELECT *, quota * {BLOCK_WORDS} + greatest(0, least(room, (blocks - sum(quota) OVER (PARTITION BY k)) * {BLOCK_WORDS}
         - coalesce(sum(room) OVER (PARTITION BY k ORDER BY words / (2 * quota + 1) DESC, shard ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS wanted
  FROM quotas),
circles AS (
  SELECT k, shard, words, wanted // words AS passes, wanted % words AS rest,
         (('0x' || substr(md5('mix-1:' || k || ':' || shard::VARCHAR), 1, 8))::BIGINT % ceil(words / {BLOCK_WORDS})::BIGINT) * {BLOCK_WORDS} AS start_
  FROM filled),
placed AS (
  SELECT *, sum(size) OVER (PARTITION BY k, shard ORDER BY drawn, doc_id, size ROWS UNBOUNDED PRECEDING) AS end_ FROM dealt WHERE size > 0)
SELECT doc_id, size, source_size, target,
       (passes * size + greatest(0, least(end_, start_ + rest, words) - greatest(end_ - size, start_))
        + greatest(0, least(end_, start_ + rest - words) - greatest(end_ - size, 0)))::BIGINT AS taken
FROM placed JOIN circles USING (k, shard)
UNION ALL SELECT doc_id, size, source_size, target, 0 FROM dealt WHERE size = 0
"""
