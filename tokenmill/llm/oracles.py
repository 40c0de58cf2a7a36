"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

from collections.abc import Sequence

from tokenmill.llm.path_templates import LOWER, UPPER


def near_duplicates(width: int, least: int) -> str:
    """All pairs that share a shingle, and the smallest id reachable over links."""
    return f"""
    WITH RECURSIVE w AS (
        SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
    s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {width} THEN [array_to_string(w, ' ')]
              ELSE list_transform(range(1, len(w) - {width} + 2), lambda i: array_to_string(w[i:i + {width - 1}], ' ')) END) AS g FROM w),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
    p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
    l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= {least} * (x.n + y.n - c)),
    r(doc_id, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.root),
    m AS (SELECT doc_id, min(root) AS component_id FROM r GROUP BY 1)
    SELECT doc_id, coalesce(n.n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM m LEFT JOIN n USING (doc_id)"""


def shards(limit: int) -> str:
    """The shallowest hash prefix whose documents fit, for unique ids."""
    return f"""
    WITH t AS (SELECT doc_id, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n_bytes,
                   CAST(('0x' || left(md5(CAST(doc_id AS VARCHAR)), 15)) AS BIGINT) AS h FROM documents),
    x AS (SELECT *, unnest(range(0, 41)) AS d FROM t),
    s AS (SELECT d, h >> CAST(60 - d AS INTEGER) AS p, CAST(sum(n_bytes) AS BIGINT) AS b, count(*) AS n FROM x GROUP BY ALL),
    f AS (SELECT x.doc_id, x.n_bytes, x.h, min(x.d) AS d, arg_min(s.b, x.d) AS b
          FROM x JOIN s ON s.d = x.d AND s.p = x.h >> CAST(60 - x.d AS INTEGER) WHERE s.b <= {limit} OR s.n = 1 GROUP BY ALL)
    SELECT doc_id, n_bytes, substr(lpad(bin(h), 60, '0'), 1, CAST(d AS INTEGER)) AS shard, CAST(d AS INTEGER) AS depth, b AS shard_bytes FROM f"""


def url_verdicts(
    rules: Sequence[tuple[str, str, str]], depth: int = 3, z_limit: float = 1.96, strength: float = 4.0, threshold: float = 0.5, levels: int = 12,
) -> str:
    """Rules and path-template trees, one group of tables for each of ``levels`` segments; longer paths are not told apart beyond."""
    listed = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in rules)
    sql = f"""
    WITH u AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
                   regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
    r(h, p, v) AS (VALUES {listed}),
    g AS (SELECT page_id, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS given
          FROM u JOIN r ON (host = h OR suffix(host, '.' || h)) AND starts_with(path, p) GROUP BY 1),
    b AS MATERIALIZED (SELECT u.page_id, host, path, rule, given, list_transform(list_filter(string_split(path, '/'), lambda x: x <> ''),
              lambda x: CASE WHEN regexp_full_match(x, '[0-9]+(\\.[A-Za-z0-9]+)?')
                  OR (regexp_full_match(x, '[0-9a-fA-F-]{{8,}}') AND regexp_matches(x, '[0-9]')) THEN '*' ELSE x END) AS w
          FROM u LEFT JOIN g USING (page_id)),
    k AS (SELECT host, w, count(given) AS lab, count(*) FILTER (WHERE given = 'block') AS blk FROM b GROUP BY ALL),
    z AS (SELECT CASE WHEN sum(lab) > 0 THEN CAST(sum(blk) AS DOUBLE) / CAST(sum(lab) AS DOUBLE) ELSE 0.0::DOUBLE END AS root FROM k),
    o AS (SELECT host, CAST(sum(lab) AS DOUBLE) AS ol, CAST(sum(blk) AS DOUBLE) AS ob FROM k GROUP BY 1),
    t0 AS MATERIALIZED (SELECT k.*, '' AS template, (ob + {strength}::DOUBLE * root) / (ol + {strength}::DOUBLE) AS purity FROM k JOIN o USING (host), z)"""
    for i in range(levels):
        parted = "true" if i < depth else f"count(*) > 1 AND max(len(w)) > {i}"
        sql += f""",
    d{i} AS (SELECT host, template FROM t{i} GROUP BY ALL HAVING {parted}),
    a{i} AS MATERIALIZED (SELECT t{i}.*, coalesce(w[{i + 1}], '$') AS s FROM t{i} JOIN d{i} USING (host, template)),
    c{i} AS (SELECT host, template, s, CAST(sum(lab) AS DOUBLE) AS cl, CAST(sum(blk) AS DOUBLE) AS cb FROM a{i} GROUP BY ALL),
    p{i} AS (SELECT host, template, sum(cl) AS pl, sum(cb) AS pb FROM c{i} GROUP BY ALL),
    e{i} AS (SELECT *, CASE WHEN cl > 0 THEN sqrt((pb / pl) * (1 - pb / pl) / cl) END AS error FROM c{i} JOIN p{i} USING (host, template)),
    n{i} AS (SELECT host, template, s, CASE WHEN s = '$' THEN '$' WHEN s = '*' THEN '*'
                 WHEN error > 0 AND abs(cb / cl - pb / pl) >= {z_limit}::DOUBLE * error THEN s ELSE '*' END AS name FROM e{i}),
    x{i} AS MATERIALIZED (SELECT a{i}.*, name FROM a{i} JOIN n{i} USING (host, template, s)),
    m{i} AS (SELECT host, template, name, (CAST(sum(blk) AS DOUBLE) + {strength}::DOUBLE * purity) / (CAST(sum(lab) AS DOUBLE) + {strength}::DOUBLE) AS own
             FROM x{i} GROUP BY host, template, name, purity),
    t{i + 1} AS MATERIALIZED (SELECT host, w, lab, blk, x{i}.template || '/' || name AS template, own AS purity FROM x{i} JOIN m{i} USING (host, template, name)
             UNION ALL SELECT host, w, lab, blk, template, purity FROM t{i} ANTI JOIN d{i} USING (host, template))"""
    return sql + f"""
    SELECT page_id, b.host, path, rule, coalesce(given, CASE WHEN purity >= {threshold} THEN 'block' ELSE 'allow' END) AS verdict, template,
           round(purity, 9) AS purity
    FROM b JOIN t{levels} USING (host, w)"""


def jaccard_components(width: int, least: int) -> str:
    """As ``near_duplicates``, without the mark of the kept ones."""
    return f"SELECT doc_id, n_shingles, component_id FROM ({near_duplicates(width, least)})"


def hard_negatives(positives: int, negatives: int, band: tuple[int, int, int]) -> str:
    """All scores of all anchors, ranked within labels and within bands."""
    return f"""
    WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                   list_transform(embedding, lambda c: CAST(floor(256 * CAST(c AS DOUBLE)) AS BIGINT)) AS x
               FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
                   AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
    s AS (SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id,
              CAST(list_sum(list_transform(range(1, len(a.x) + 1), lambda i: a.x[i] * b.x[i])) AS BIGINT) AS score
          FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
    p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
          QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {positives})
    SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
    FROM p JOIN s USING (anchor_id)
    WHERE NOT same AND {band[0]} * positive_score <= {band[2]} * score AND {band[2]} * score <= {band[1]} * positive_score
    WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= {negatives}"""
