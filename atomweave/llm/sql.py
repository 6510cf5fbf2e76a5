"""SQL that gives the rows of the corpus queries which SQL can express, for DuckDB."""

from __future__ import annotations

from atomweave.llm import decontaminate, jaccard, negatives, urls


def words(text: str, pattern: str) -> str:
    """The list of words of a text whose A-Z are lowered; null has none."""
    return f"coalesce(regexp_extract_all(translate({text}, '{urls.UPPER}', '{urls.LOWER}'), '{pattern}'), [])"


#: What isn't a word's letter in either kind of words.
SPACED, ALNUM = r"[^\x20\x09-\x0D]+", r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

K, PERCENT, WIDTH = jaccard.SHINGLE, jaccard.PERCENT, decontaminate.WIDTH

#: Every pair of documents that share a shingle, and components by following links.
OP3 = rf"""WITH RECURSIVE w AS (SELECT doc_id, {words("text", SPACED)} AS w FROM documents),
    s AS MATERIALIZED (SELECT doc_id, CASE WHEN len(w) >= {K} THEN list_distinct(list_transform(range(1, len(w) - {K - 2}), lambda i: array_to_string(w[i:i + {K - 1}], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w),
    x AS MATERIALIZED (SELECT doc_id, len(s) AS n, hash(unnest(s)) AS sh FROM s),
    p AS (SELECT a.doc_id AS i, b.doc_id AS j, any_value(a.n) AS n, any_value(b.n) AS m, count(*) AS c FROM x a JOIN x b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL),
    l AS MATERIALIZED (SELECT i, j FROM p WHERE 100 * c >= {PERCENT} * (n + m - c)),
    b AS MATERIALIZED (SELECT i, j FROM l UNION ALL SELECT j, i FROM l),
    r(id, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT b.j, r.root FROM r JOIN b ON b.i = r.id WHERE r.root < b.j)
    SELECT s.doc_id, len(s)::BIGINT AS n_shingles, c.component_id FROM s JOIN (SELECT id, min(root) AS component_id FROM r GROUP BY 1) c ON c.id = s.doc_id"""

#: Every run of words as long as some item's windows, looked up among these.
OP4 = rf"""WITH d AS MATERIALIZED (SELECT doc_id, {words("text", ALNUM)} AS w FROM documents), i AS (SELECT item_id, {words("text", ALNUM)} AS w FROM benchmark),
    g AS MATERIALIZED (SELECT DISTINCT item_id, least(len(w), {WIDTH}) AS n, array_to_string(w[p:p + least(len(w), {WIDTH}) - 1], ' ') AS g FROM i, LATERAL (SELECT unnest(range(1, len(w) - least(len(w), {WIDTH}) + 2)) AS p) WHERE len(w) > 0),
    m AS (SELECT DISTINCT n FROM g),
    r AS (SELECT doc_id, n, p, array_to_string(w[p:p + n - 1], ' ') AS g FROM d, m, LATERAL (SELECT unnest(range(1, len(w) - n + 2)) AS p) WHERE len(w) >= n),
    f AS MATERIALIZED (SELECT doc_id, r.n, p, item_id FROM r JOIN g ON g.g = r.g AND g.n = r.n),
    h AS (SELECT doc_id, count(DISTINCT p + k) AS n_hit FROM f, LATERAL (SELECT unnest(range(n)) AS k) GROUP BY 1),
    t AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM f GROUP BY 1)
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
    FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)"""


#: Every anchor against every row.
OP12 = f"""WITH e AS MATERIALIZED (SELECT vec_id, CASE WHEN vec_id % {negatives.WRONG_LABEL} = 0 THEN (label + 1) % {negatives.LABELS} ELSE label END AS label, list_transform(embedding, lambda x: floor({negatives.SCALE} * x::DOUBLE)::BIGINT) AS v
        FROM embeddings WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: NOT coalesce(isfinite(x), false))) = 0),
    s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2]))::BIGINT AS score FROM e a JOIN e b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE a.vec_id % {negatives.ANCHOR} = 0),
    p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= {negatives.POSITIVES}),
    n AS (SELECT p.*, s.id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.id) AS r
        FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND {negatives.LOW} * positive_score <= 100 * s.score AND s.score <= positive_score)
    SELECT anchor_id, positive_id, r::INT AS rank, negative_id, positive_score, negative_score FROM n WHERE r <= {negatives.NEGATIVES}"""


def op5(rules: list[tuple[str, str]]) -> str:
    """op5 in DuckDB's SQL: the same levels, each as a few common tables."""
    fits = lambda rule: f"((host = '{rule.split('/')[0]}' OR ends_with(host, '.{rule.split('/')[0]}')) AND starts_with(path, '/{rule.split('/', 1)[1]}'))"
    by_length = sorted(rules, key=lambda r: -len(r[0]))
    case = lambda i: "CASE " + " ".join(f"WHEN {fits(r[0])} THEN '{r[i]}'" for r in by_length) + " END"
    sql = f"""WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
    h AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM u),
    p AS (SELECT page_id, translate(raw, '{urls.UPPER}', '{urls.LOWER}') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
    l AS (SELECT *, {case(0)} AS rule, {case(1)} AS said FROM p),
    r0 AS (SELECT *, (rule IS NOT NULL)::INT AS labelled, (coalesce(said, '') = 'block')::INT AS block, '' AS node, string_split(path, '/') AS s FROM l)"""
    for d in range(1, urls.DEPTH + 1):
        part = f"coalesce(s[{d + 1}], '')" if d < urls.DEPTH else f"array_to_string(s[{d + 1}:], '/')"
        sums = "sum(n)::DOUBLE AS n, sum(b)::DOUBLE AS b, sum(m)::DOUBLE AS m"
        sql += f""",
    q{d} AS (SELECT *, {part} AS part FROM r{d - 1}),
    c{d} AS (SELECT host, node, part, count(*)::DOUBLE AS n, sum(block)::DOUBLE AS b, sum(labelled)::DOUBLE AS m FROM q{d} GROUP BY ALL),
    a{d} AS (SELECT host, node, {sums} FROM c{d} GROUP BY ALL),
    k{d} AS (SELECT c.* FROM c{d} c JOIN a{d} a USING (host, node) WHERE c.n >= {urls.LEAST_URLS} AND c.n * {urls.LEAST_PART} >= a.n),
    t{d} AS (SELECT host, node, {sums} FROM k{d} GROUP BY ALL),
    b{d} AS (SELECT * FROM k{d} UNION ALL SELECT a.host, a.node, NULL, a.n - coalesce(t.n, 0), a.b - coalesce(t.b, 0), a.m - coalesce(t.m, 0) FROM a{d} a LEFT JOIN t{d} t USING (host, node)),
    n{d} AS (SELECT b.host, b.node, b.part, CASE WHEN b.m = 0 OR (b.b * a.m - a.b * b.m) * (b.b * a.m - a.b * b.m) * a.m > {urls.DIFFERS} * b.m * (a.m - b.m) * a.b * (a.m - a.b) THEN coalesce(b.part, '*') ELSE '~' END AS label FROM b{d} b JOIN a{d} a USING (host, node)),
    r{d} AS (SELECT q.* EXCLUDE (node, part), q.node || '/' || coalesce(x.label, y.label) AS node FROM q{d} q LEFT JOIN n{d} x ON x.host = q.host AND x.node = q.node AND x.part = q.part LEFT JOIN n{d} y ON y.host = q.host AND y.node = q.node AND y.part IS NULL)"""
    last = f"r{urls.DEPTH}"
    return sql + f""",
    v AS (SELECT host, node, (sum(block)::DOUBLE + {urls.SMOOTHING}) / (sum(labelled)::DOUBLE + {2 * urls.SMOOTHING}) AS purity FROM {last} GROUP BY ALL)
    SELECT page_id, r.host, path, rule, coalesce(said, CASE WHEN purity >= {urls.REJECT} THEN 'block' ELSE 'allow' END) AS verdict, r.host || r.node AS template, purity FROM {last} r JOIN v USING (host, node)"""
