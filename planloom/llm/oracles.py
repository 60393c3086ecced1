"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from . import licences, mixing

_WARC = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h,
         min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first
  FROM pages
)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         CAST(1 + ((CAST('0x' || substr(h, CAST(1 + 5 * (i // 4) AS INTEGER), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31) AS INTEGER), 1)), '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM p
"""


def _mix_sql(rounds: int = mixing.ROUNDS, seed: int = mixing.SEED) -> str:
    """Plain running sums over all rows of a source, where the operator has thresholds."""
    ctes = [
        "d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM documents)",
        "per AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM d GROUP BY source)",
        "w AS (SELECT *, CASE (place - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, 2.0::DOUBLE * source_size AS cap, CAST(sum(source_size) OVER () AS BIGINT) AS total FROM per)",
        "l AS (SELECT *, (1.5::DOUBLE * total - coalesce(sum(cap) OVER (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0)) / sum(weight) OVER (ORDER BY cap / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w)",
        "water AS (SELECT arg_min(level, cap / weight) AS water FROM l WHERE cap / weight > level)",
        "t AS (SELECT source, source_size, coalesce(least(cap, water * weight), cap) AS target FROM l LEFT JOIN water ON true)",
        "r0 AS (SELECT d.*, source_size, target, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole, false AS taken FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)",
        "s0 AS (SELECT *, target - whole * source_size AS room FROM r0)",
    ]
    for k in range(rounds):
        h = f"CAST('0x' || substr(md5(concat_ws('|', {seed + k}, coalesce(CAST(doc_id AS VARCHAR), ''), size)), 1, 15) AS BIGINT)"
        ctes.append(f"c{k} AS (SELECT *, (NOT taken AND size > 0 AND size <= room) AS fit, {h} AS h FROM s{k})")
        ctes.append(f"u{k} AS (SELECT *, sum(CASE WHEN fit THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY h, doc_id ROWS UNBOUNDED PRECEDING) AS run FROM c{k})")
        ctes.append(f"v{k} AS (SELECT * EXCLUDE (fit, h, run, taken), taken OR (fit AND run <= room) AS taken, fit AND run <= room AS now FROM u{k})")
        ctes.append(f"s{k + 1} AS (SELECT * EXCLUDE (now, room), room - CAST(sum(CASE WHEN now THEN size ELSE 0 END) OVER (PARTITION BY source) AS BIGINT) AS room FROM v{k})")
    return "WITH " + ",\n".join(ctes) + f"\nSELECT doc_id, size, source_size, target, CAST(size * (whole + CASE WHEN taken THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM s{rounds}"


_KNN = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
s AS (
  SELECT q.vec_id AS query_id, v.vec_id, CAST(list_inner_product(q.e, v.e) AS BIGINT) AS score
  FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 100 = 0
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 10
"""


def _licence_sql() -> str:
    """The same normal form by DuckDB's functions."""

    def normal(text: str) -> str:
        out = f"translate({text}, '{licences.UPPER}', '{licences.LOWER}')"
        for pattern, to in licences.RULES:
            out = f"regexp_replace({out}, '{pattern}', '{to}', 'g')"
        return f"trim({out}, ' ')"

    known = ", ".join(f"('{name}', '{unit}', '{digest}')" for name, unit, digest in licences.known())
    return f"""
WITH known(licence, unit, digest) AS (VALUES {known}),
u AS (
  SELECT doc_id, 'text' AS unit, CAST(0 AS INTEGER) AS line, text AS part FROM documents WHERE text IS NOT NULL
  UNION ALL
  SELECT doc_id, 'line', CAST(i AS INTEGER), string_split(text, chr(10))[i] FROM (SELECT doc_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents WHERE text IS NOT NULL)
)
SELECT doc_id, u.unit, line, licence FROM u JOIN known ON known.unit = u.unit AND known.digest = sha256({normal("part")})
"""


ORACLES = {"op5_voronoi_knn": _KNN, "op8_licence_digests": _licence_sql(), "op3_warc": _WARC, "op9_water_filling": _mix_sql()}
