"""DuckDB statements for the corpus queries that SQL can express."""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORD = r"'[^\x20\x09-\x0D]+'"



def _rounds(n: int) -> str:
    """Assignments a0, a1, ... and centroids c1, c2, ... of n rounds, and the last assignment."""
    assign = """a{i} AS MATERIALIZED (SELECT row, min({{'d': d, 'k': k}}) AS m FROM (
            SELECT row, k, list_sum([(v.q[j] - c.q[j]) * (v.q[j] - c.q[j]) FOR j IN range(1, 65)])::BIGINT AS d FROM v, c{i} c) GROUP BY row)"""
    update = """s{i} AS (SELECT m.k AS k, j, sum(q[j])::BIGINT AS s, count(*) AS n FROM a{i} JOIN v USING (row), (SELECT unnest(range(1, 65)) AS j) GROUP BY 1, 2),
        c{n} AS MATERIALIZED (SELECT k, coalesce(u.q, c.q) AS q FROM c{i} c LEFT JOIN
            (SELECT k, list((s - ((s % n) + n) % n) // n ORDER BY j) AS q FROM s{i} GROUP BY k) u USING (k))"""
    return ",\n        ".join([(assign + ",\n        " + update).format(i=i, n=i + 1) for i in range(n)] + [assign.format(i=n)])


_RUN = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

SQL = {
    "op1_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))""",
    "op4_ngram_jaccard_join": f"""
        WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, {_WORD}) AS w FROM documents),
        sh AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN [array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)]
                                                   WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM d),
        n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
        both_ AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
        link AS (SELECT x, y FROM both_ JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 80 * (p.n + q.n - c)),
        edge AS (SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
        reach(node, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.y, r.root FROM reach r JOIN edge e ON e.x = r.node)
        SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id
        FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT node AS doc_id, min(root) AS component_id FROM reach GROUP BY 1) c USING (doc_id)""",
    "op7_substring_dedup": f"""
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_WORD}) AS w FROM documents),
        win AS (SELECT doc_id, unnest(range(1, len(w) - 18)) AS i, unnest([array_to_string(w[j:j + 19], ' ') FOR j IN range(1, len(w) - 18)]) AS s
                FROM d WHERE len(w) >= 20),
        later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS k FROM win) WHERE k > 1),
        gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM later),
        word AS (SELECT doc_id, unnest(w) AS v, unnest(range(1, len(w) + 1)) AS p FROM d),
        kept AS (SELECT doc_id, string_agg(v, ' ' ORDER BY p) AS t, count(*) AS n FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY 1)
        SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
        FROM d LEFT JOIN kept USING (doc_id)""",
    "op8_line_dedup": """
        WITH d AS (SELECT row_number() OVER () AS page, doc_id, source, string_split(coalesce(text, ''), chr(10)) AS l, text FROM documents),
        line AS (SELECT page, source, unnest(l) AS v, unnest(range(1, len(l) + 1)) AS p FROM d),
        pages AS (SELECT source, count(*) AS n FROM documents GROUP BY 1),
        seen AS (SELECT source, trim(v, ' ' || chr(9) || chr(13)) AS k, count(DISTINCT page) AS c FROM line GROUP BY 1, 2),
        bad AS (SELECT seen.source, k FROM seen JOIN pages ON seen.source IS NOT DISTINCT FROM pages.source WHERE k <> '' AND 100 * c > 3 * (n + 100)),
        kept AS (SELECT page, string_agg(v, chr(10) ORDER BY p) AS t, count(*) AS n FROM line
                 WHERE NOT EXISTS (SELECT 1 FROM bad WHERE bad.source IS NOT DISTINCT FROM line.source AND bad.k = trim(v, ' ' || chr(9) || chr(13))) GROUP BY 1)
        SELECT doc_id, len(l)::BIGINT AS n_lines, (len(l) - coalesce(n, 0))::BIGINT AS n_dropped, sha256(coalesce(t, '')) AS kept_sha256
        FROM d LEFT JOIN kept USING (page)""",
    "op9_benchmark_decontamination": rf"""
        WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        b AS (SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
        size AS (SELECT DISTINCT least(len(w), 10) AS k FROM b WHERE len(w) > 0),
        item AS (SELECT DISTINCT item_id, k, unnest([array_to_string(w[i:i + k - 1], ' ') FOR i IN range(1, len(w) - k + 2)]) AS s
                 FROM (SELECT *, least(len(w), 10) AS k FROM b WHERE len(w) > 0)),
        win AS (SELECT doc_id, k, unnest(range(1, len(w) - k + 2)) AS i, unnest([array_to_string(w[j:j + k - 1], ' ') FOR j IN range(1, len(w) - k + 2)]) AS s
                FROM d, size WHERE len(w) >= k),
        hit AS (SELECT doc_id, i, k, item_id FROM win JOIN item USING (s, k)),
        word AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + k)) AS p FROM hit) GROUP BY 1),
        items AS (SELECT doc_id, count(*) AS n_items, string_agg(v, ',' ORDER BY v) AS l
                  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS v FROM hit) GROUP BY 1)
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
               sha256(coalesce(l, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN word USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op11_centroid_clustering": f"""
        WITH v AS MATERIALIZED (SELECT row_number() OVER () AS row, vec_id, [floor(1024 * x::DOUBLE)::BIGINT FOR x IN embedding] AS q FROM embeddings
                   WHERE len(embedding) = 64 AND len([x FOR x IN embedding IF x IS NOT NULL AND isfinite(x::DOUBLE)]) = 64),
        c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id), q) - 1 AS k, q FROM v QUALIFY k < 8),
        {_rounds(10)},
        found AS (SELECT row, m.k AS k, m.d AS d FROM a10)
        SELECT vec_id, k::INT AS cluster, d AS distance, (sum(d) OVER (PARTITION BY k))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
               sha256(array_to_string(c10.q, ',')) AS centroid_sha256
        FROM found JOIN v USING (row) JOIN c10 USING (k)""",
    "op12_importance_resampling": f"""
        WITH d AS (SELECT doc_id, {_RUN} AS w FROM documents),
        f AS (SELECT doc_id, unnest(w || [w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) AS s FROM d),
        tf AS (SELECT unnest(w || [w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) AS s FROM (SELECT {_RUN} AS w FROM benchmark)),
        step AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce([i] || [0::BIGINT FOR z IN range(8)],
                     lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS c FROM range(256) r(i))),
        crc AS (SELECT s, xor(list_reduce([4294967295::BIGINT] || [('0x' || substr(h, 2 * i - 1, 2))::BIGINT FOR i IN range(1, len(h) // 2 + 1)],
                     lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) % 10000 AS b
                FROM (SELECT s, hex(encode(s)) AS h FROM (SELECT s FROM f UNION SELECT s FROM tf)), step),
        s AS (SELECT b, count(*) AS n FROM f JOIN crc USING (s) GROUP BY 1),
        t AS (SELECT b, count(*) AS n FROM tf JOIN crc USING (s) GROUP BY 1),
        gain AS (SELECT b, floor(1000 * ln(((coalesce(t.n, 0) + 1) * ((SELECT sum(n) FROM s) + 10000))::DOUBLE
                                           / ((coalesce(s.n, 0) + 1) * (coalesce((SELECT sum(n) FROM t), 0) + 10000))::DOUBLE))::BIGINT AS g
                 FROM range(10000) r(b) LEFT JOIN s USING (b) LEFT JOIN t USING (b)),
        weight AS (SELECT doc_id, count(*) AS n, sum(g)::BIGINT AS g FROM f JOIN crc USING (s) JOIN gain USING (b) GROUP BY 1),
        score AS (SELECT doc_id, len(w) AS words, coalesce(n, 0)::BIGINT AS n_features, coalesce((g - ((g % n) + n) % n) // n, 0)::BIGINT AS weight,
                         weight + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
                  FROM d LEFT JOIN weight w USING (doc_id)),
        drawn AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM score WHERE words >= 20
                  QUALIFY rank <= 25 * count(*) OVER () // 100)
        SELECT doc_id, n_features, weight, score, rank FROM score LEFT JOIN drawn USING (doc_id)""",
    "op13_source_mixing": f"""
        WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), {_WORD}))::BIGINT AS size,
                          ('0x' || substr(sha256('13:' || doc_id), 1, 8))::BIGINT AS h FROM documents),
        src AS (SELECT source, source_size, [5, 2, 1][(row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1] AS w
                FROM (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY 1)),
        -- of the sources by rising cap to weight ratio, those before the first whose share of the remainder is within its cap are capped
        cum AS (SELECT *, coalesce(sum(2 * source_size) OVER b, 0) AS fixed, sum(w) OVER a AS open, 150 * sum(source_size) OVER () / 100.0 AS budget
                FROM src WINDOW b AS (ORDER BY 2 * source_size / w, w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
                                a AS (ORDER BY 2 * source_size / w, w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
        share AS (SELECT (budget::DOUBLE - fixed::DOUBLE) / open::DOUBLE AS s FROM cum WHERE (budget::DOUBLE - fixed::DOUBLE) / open::DOUBLE * w <= 2 * source_size
                  ORDER BY 2 * source_size / w, w LIMIT 1),
        target AS (SELECT source, source_size, least(w * s, (2 * source_size)::DOUBLE) AS target FROM src, share),
        part AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target)::BIGINT // source_size ELSE 0 END AS copies FROM target),
        cut AS (SELECT doc_id, size, source_size, target, copies, floor(target)::BIGINT - copies * source_size AS rest,
                       coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
                FROM d JOIN part ON d.source IS NOT DISTINCT FROM part.source)
        SELECT doc_id, size, source_size, target, (copies * size + least(size, greatest(0, rest - before)))::BIGINT AS taken FROM cut""",
}
