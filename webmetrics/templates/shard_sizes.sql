-- Rows and people per day shard and event name, :start .. :end, both included.
SELECT table_suffix, event_name, count(*) AS row_count, count(DISTINCT user_pseudo_id) AS people
FROM IDENTIFIER(:source)
WHERE table_suffix BETWEEN :start AND :end
GROUP BY table_suffix, event_name
