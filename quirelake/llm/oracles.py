"""SQL of the operators whose rounds or levels are written out one by one."""

from __future__ import annotations


def lloyd_sql(clusters: int, rounds: int, width: int, seed: str, scale: int = 1024) -> str:
    """Rounds of assignment and of exact floors of means, each a common table."""
    parts = [
        f"""v AS MATERIALIZED (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v, row_number() OVER () AS row FROM embeddings
    WHERE len(embedding) = {width} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{seed}' || CAST(vec_id AS VARCHAR)) NULLS LAST, v) - 1 AS k, v AS c FROM v QUALIFY k < {clusters})",
    ]
    near = """a{n} AS MATERIALIZED (
    SELECT row, min(struct_pack(d := d, k := k)) AS a FROM (SELECT row, k, CAST(list_sum(list_transform(range(1, {w} + 1), lambda i: (v[i] - c[i]) * (v[i] - c[i]))) AS BIGINT) AS d FROM v, c{n}) GROUP BY row)"""
    move = """c{m} AS MATERIALIZED (
    SELECT k, coalesce(m, c) AS c FROM c{n} LEFT JOIN (
        SELECT k, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS m
        FROM (SELECT a.k AS k, i, sum(v[i]) AS s, count(*) AS n FROM v JOIN a{n} USING (row), range(1, {w} + 1) r(i) GROUP BY a.k, i) GROUP BY k) USING (k))"""
    for n in range(rounds):
        parts += [near.format(n=n, w=width), move.format(n=n, m=n + 1, w=width)]
    parts.append(near.format(n=rounds, w=width))
    return f"""WITH {", ".join(parts)}
SELECT vec_id, CAST(a.k AS INTEGER) AS cluster, a.d AS distance, CAST(sum(a.d) OVER (PARTITION BY a.k) AS BIGINT) AS cluster_inertia, CAST(sum(a.d) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(c, ',')) AS centroid_sha256
FROM v JOIN a{rounds} USING (row) JOIN c{rounds} c ON c.k = a.k"""


def merkle_sql(levels: int = 6, group_levels: int = 3, fanout: int = 8) -> str:
    """Levels of the trees, up to ``fanout ** levels`` rows of a group and ``fanout ** group_levels`` groups."""
    f = fanout
    field = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || {c} END"
    leaf = lambda text: "sha256(" + " || ".join(field(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    parts = [
        """tab AS (SELECT list(t ORDER BY i) AS tab FROM (
    SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, x: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END) AS t FROM range(256) r(i)))""",
        """bytes AS (SELECT *, list_transform(range(1, len(CAST(doc_id AS VARCHAR)) + 1), lambda i: CAST(ascii(substr(CAST(doc_id AS VARCHAR), i, 1)) AS BIGINT)) AS b FROM documents)""",
        """crc AS (SELECT bytes.*, xor(list_reduce(list_prepend(4294967295, b), lambda a, x: xor(a >> 8, tab[(xor(a, x) & 255) + 1])), 4294967295) AS crc FROM bytes, tab)""",
        f"d AS MATERIALIZED (SELECT doc_id, lang, {leaf('text')} AS leaf, CASE WHEN crc % 3 = 0 THEN {leaf(lower)} ELSE {leaf('text')} END AS read FROM crc)",
        "x0 AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n, read AS cur, '' AS proof FROM d)",
        "l0 AS MATERIALIZED (SELECT lang AS g, i, leaf AS h, n FROM x0)",
    ]

    def climb(level: str, nodes: str, above: str, runs: str) -> list[str]:
        return [
            f"{runs} AS MATERIALIZED (SELECT g, i // {f} AS run, n, list(h ORDER BY i) AS hs FROM {nodes} WHERE n > 1 GROUP BY g, i // {f}, n)",
            f"{above} AS MATERIALIZED (SELECT g, run AS i, sha256(array_to_string(hs, '')) AS h, (n + {f - 1}) // {f} AS n FROM {runs} UNION ALL SELECT g, i, h, n FROM {nodes} WHERE n = 1)",
        ]

    def walk(before: str, after: str, runs: str, group: str) -> str:
        left, right = f"coalesce(array_to_string(hs[: x.i % {f}], ''), '')", f"coalesce(array_to_string(hs[x.i % {f} + 2 :], ''), '')"
        return f"""{after} AS MATERIALIZED (
    SELECT x.* EXCLUDE (i, cur, proof), CASE WHEN hs IS NULL THEN x.i ELSE x.i // {f} END AS i, CASE WHEN hs IS NULL THEN cur ELSE sha256({left} || cur || {right}) END AS cur,
           CASE WHEN hs IS NULL THEN proof ELSE proof || {left} || {right} END AS proof
    FROM {before} x LEFT JOIN {runs} r ON {group} AND r.run = x.i // {f})"""

    for k in range(levels):
        parts += climb(str(k), f"l{k}", f"l{k + 1}", f"r{k}")
        parts.append(walk(f"x{k}", f"x{k + 1}", f"r{k}", "r.g IS NOT DISTINCT FROM x.lang"))
    parts.append(f"t0 AS MATERIALIZED (SELECT 0 AS g, g AS lang, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS i, h, count(*) OVER () AS n FROM l{levels})")
    parts.append(f"y0 AS MATERIALIZED (SELECT x.* EXCLUDE (i), t0.i AS i, t0.h AS subroot FROM x{levels} x JOIN t0 ON t0.lang IS NOT DISTINCT FROM x.lang)")
    for k in range(group_levels):
        parts += climb(str(k), f"t{k}", f"t{k + 1}", f"u{k}")
        parts.append(walk(f"y{k}", f"y{k + 1}", f"u{k}", "true"))
    return f"""WITH {", ".join(parts)}
SELECT doc_id, leaf, subroot, h AS root, sha256(proof) AS proof_sha256, cur AS folded_root, cur = h AS verified FROM y{group_levels}, t{group_levels}"""
