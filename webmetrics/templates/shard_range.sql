-- Raw records of the day shards :start .. :end, both included.
SELECT * FROM IDENTIFIER(:source) WHERE table_suffix BETWEEN :start AND :end
