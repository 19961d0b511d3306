"""SQL for the Merkle audit: a common table expression for every level of the trees."""

from __future__ import annotations

#: Levels of a source's tree and of the tree of sources: enough for 16 ** 7 leaves each.
LEVELS = 7


def _field(name: str, value: str | None = None) -> str:
    text = value or f"CAST({name} AS VARCHAR)"
    return f"coalesce(concat(strlen({text}), ':', {text}), '-')"


def _leaf(text: str | None = None) -> str:
    fields = [_field(name) for name in ("doc_id", "source", "lang", "n_chars")] + [_field("text", text)]
    return f"sha256(concat({', '.join(fields)}))"


def _levels(prefix: str) -> str:
    """Level 0 exists; each next one hashes runs of 16 where a tree has more than one node left."""
    return ",\n".join(f"""{prefix}{k + 1} AS (
  SELECT tree, r // 16 AS r, (any_value(width) + 15) // 16 AS width, sha256(string_agg(h, '' ORDER BY r)) AS h
  FROM {prefix}{k} WHERE width > 1 GROUP BY tree, r // 16
)""" for k in range(LEVELS))


def _siblings(prefix: str) -> str:
    return ",\n".join(f"""{prefix}s{k} AS (
  SELECT a.tree, a.r, coalesce(string_agg(b.h, '' ORDER BY b.r) FILTER (b.r < a.r), '') AS before,
         coalesce(string_agg(b.h, '' ORDER BY b.r) FILTER (b.r > a.r), '') AS after
  FROM {prefix}{k} a JOIN {prefix}{k} b ON a.tree = b.tree AND a.r // 16 = b.r // 16
  WHERE a.width > 1 GROUP BY a.tree, a.r
)""" for k in range(LEVELS))


def _tops(prefix: str) -> str:
    return " UNION ALL ".join(f"SELECT tree, h FROM {prefix}{k} WHERE width = 1" for k in range(LEVELS + 1))


def _climb() -> str:
    """Start with the leaf; at each level join the siblings, if the tree is that high, and fold."""
    steps, last = [], "fold0"
    for k in range(2 * LEVELS):
        prefix, level = ("n", k) if k < LEVELS else ("t", k - LEVELS)
        tree, rank = ("p.tree", "p.r") if prefix == "n" else ("0", "p.tree")
        steps.append(f"""fold{k + 1} AS (
  SELECT p.* EXCLUDE (h, path), CASE WHEN s.tree IS NULL THEN p.h ELSE sha256(concat(s.before, p.h, s.after)) END AS h,
         concat(p.path, s.before, s.after) AS path
  FROM {last} p LEFT JOIN {prefix}s{level} s ON s.tree = {tree} AND s.r = {rank} // {16 ** level}
)""")
        last = f"fold{k + 1}"
    return ",\n".join(steps)


#: crc32 of the id as text, by the usual table of 256 remainders.
_CRC = """
remainders AS (
  SELECT list_transform(range(256), lambda b: list_reduce(
           list_concat([b::BIGINT], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS of
),
crcs AS (
  SELECT doc_id, xor(4294967295, list_reduce(
           list_concat([4294967295::BIGINT], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda d: ascii(d)::BIGINT)),
           lambda c, b: xor(of[(xor(c, b) & 255) + 1], c >> 8))) AS crc
  FROM (SELECT DISTINCT doc_id FROM documents), remainders
)"""

AUDIT = f"""
WITH {_CRC.strip()},
sources AS (
  SELECT source AS name, row_number() OVER (ORDER BY encode(source) NULLS FIRST) - 1 AS tree, count(*) OVER () AS trees
  FROM (SELECT DISTINCT source FROM documents)
),
leaves AS (
  SELECT doc_id, tree, trees, {_leaf()} AS leaf,
         CASE WHEN crc % 5 = 0 THEN {_leaf("lowered")} END AS altered
  FROM (SELECT *, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lowered FROM documents)
  JOIN crcs USING (doc_id) JOIN sources ON source IS NOT DISTINCT FROM name
),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS r, count(*) OVER (PARTITION BY tree) AS width
  FROM leaves
),
n0 AS (SELECT tree, r, width, leaf AS h FROM ranked),
{_levels("n")},
{_siblings("n")},
ntop AS ({_tops("n")}),
t0 AS (SELECT 0 AS tree, tree AS r, (SELECT count(*) FROM sources) AS width, h FROM ntop),
{_levels("t")},
{_siblings("t")},
ttop AS ({_tops("t")}),
fold0 AS (SELECT doc_id, tree, r, leaf, coalesce(altered, leaf) AS h, '' AS path FROM ranked),
{_climb()}
SELECT f.doc_id, f.leaf, s.h AS subroot, t.h AS root, sha256(f.path) AS proof_sha256, f.h AS folded_root, f.h = t.h AS verified
FROM fold{2 * LEVELS} f JOIN ntop s ON s.tree = f.tree CROSS JOIN ttop t
"""
