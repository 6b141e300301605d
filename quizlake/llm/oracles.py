"""SQL of the operators whose results it can express level by level and round by round."""

from __future__ import annotations


def quantizer_sql(parts: int = 4, entries: int = 256, rounds: int = 4) -> str:
    """Lloyd's rounds, every part against every entry in each."""
    steps = [f"""x AS (SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label,
  list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL
  AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0)""",
        f"""p AS MATERIALIZED (SELECT r, part, v[part * len(v) // {parts} + 1 : (part + 1) * len(v) // {parts}] AS v
  FROM x, range({parts}) t(part))""",
        f"c0 AS MATERIALIZED (SELECT part, r - 1 AS entry, v FROM p WHERE r <= {entries})"]
    for k in range(rounds + 1):
        steps.append(f"""a{k} AS MATERIALIZED (SELECT r, part, least.entry AS entry, least.d AS d FROM (
  SELECT p.r, p.part, min({{'d': list_inner_product(p.v, p.v) - 2 * list_inner_product(p.v, c.v)
   + list_inner_product(c.v, c.v), 'entry': c.entry}}) AS least
  FROM p JOIN c{k} c ON c.part = p.part GROUP BY p.r, p.part))""")
        if k < rounds:
            steps.append(f"""c{k + 1} AS MATERIALIZED (SELECT c.part, c.entry, coalesce(m.v, c.v) AS v FROM c{k} c LEFT JOIN (
  SELECT part, entry, list(mean ORDER BY place) AS v FROM (
   SELECT part, entry, place, floor(sum(y) / count(*)) AS mean FROM (
    SELECT a.part, a.entry, unnest(p.v) AS y, generate_subscripts(p.v, 1) AS place
    FROM a{k} a JOIN p ON p.r = a.r AND p.part = a.part) GROUP BY part, entry, place)
  GROUP BY part, entry) m ON m.part = c.part AND m.entry = c.entry)""")
    steps.append(f"""b AS (SELECT sha256(string_agg(CAST(CAST(y AS BIGINT) AS VARCHAR), ',' ORDER BY part, entry, place)) AS books FROM (
  SELECT part, entry, unnest(v) AS y, generate_subscripts(v, 1) AS place FROM c{rounds}))""")
    steps.append(f"""e AS (SELECT r, string_agg(lower(printf('%02x', entry)), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error
  FROM a{rounds} GROUP BY r)""")
    return "WITH " + ",\n ".join(steps) + """
 SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, books AS codebooks_sha256
 FROM x JOIN e USING (r), b"""


def merkle_sql(levels: int = 5, source_levels: int = 4) -> str:
    """Both trees level by level; each leaf is folded along the siblings at its level."""
    def field(c: str) -> str:
        return f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || {c}, '-')"

    def tree(name: str, count: int) -> list[str]:
        """`name`_0 (g, i, h) is there; makes the others, and `name`_w: the siblings at each level."""
        made, sides = [], []
        for k in range(count):
            made.append(f"""{name}_n{k} AS MATERIALIZED (SELECT *, count(*) OVER (PARTITION BY g) AS n FROM {name}_{k})""")
            made.append(f"""{name}_{k + 1} AS MATERIALIZED (SELECT g, i // 16 AS i,
  CASE WHEN max(n) = 1 THEN min(h) ELSE sha256(string_agg(h, '' ORDER BY i)) END AS h FROM {name}_n{k} GROUP BY g, i // 16)""")
            sides.append(f"""SELECT g, {k} AS k, i,
  coalesce(string_agg(h, '') OVER (PARTITION BY g, i // 16 ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS b,
  coalesce(string_agg(h, '') OVER (PARTITION BY g, i // 16 ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS a, n
  FROM {name}_n{k}""")
        made.append(f"{name}_w AS MATERIALIZED (" + "\n UNION ALL ".join(sides) + ")")
        return made

    fields = [field(c) for c in ("doc_id", "source", "lang", "n_chars")]
    lowered = "CASE WHEN crc % 5 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END"
    crc = """list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, len(s) + 1), lambda j: ord(s[j]))),
   lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda v, z: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END))"""
    steps = [
        f"d AS (SELECT *, xor({crc}, 4294967295) AS crc FROM (SELECT *, CAST(doc_id AS VARCHAR) AS s FROM documents))",
        f"""l AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id, leaf) - 1 AS i FROM (
  SELECT doc_id, coalesce('+' || source, '') AS g, sha256({' || '.join([*fields, field('text')])}) AS leaf,
  sha256({' || '.join([*fields, field('lo')])}) AS changed FROM (SELECT *, {lowered} AS lo FROM d)))""",
        "t_0 AS (SELECT g, i, leaf AS h FROM l)", *tree("t", levels),
        f"s_0 AS (SELECT '' AS g, row_number() OVER (ORDER BY encode(g)) - 1 AS i, h FROM t_{levels})",
        f"u AS (SELECT g AS name, row_number() OVER (ORDER BY encode(g)) - 1 AS si, h AS subroot FROM t_{levels})",
        *tree("s", source_levels),
        """f_0 AS (SELECT doc_id, g, i, si, leaf, subroot, changed AS f, '' AS p FROM l JOIN u ON u.name = l.g)""",
    ]
    at = 0
    for name, count in (("t", levels), ("s", source_levels)):
        for k in range(count):
            here, group = ("f.i", "f.g") if name == "t" else ("f.si", "''")
            steps.append(f"""f_{at + 1} AS (SELECT f.doc_id, f.g, f.i, f.si, f.leaf, f.subroot, p || w.b || w.a AS p,
  CASE WHEN w.n = 1 THEN f ELSE sha256(w.b || f || w.a) END AS f
  FROM f_{at} f JOIN {name}_w w ON w.k = {k} AND w.g = {group} AND w.i = {here} // {16**k})""")
            at += 1
    return "WITH " + ",\n ".join(steps) + f"""
 SELECT doc_id, leaf, subroot, r.h AS root, sha256(p) AS proof_sha256, f AS folded_root, f = r.h AS verified
 FROM f_{at}, s_{source_levels} r"""
