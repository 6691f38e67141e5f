"""Independent SQL statements of every catalogue query (DuckDB dialect).

Each statement restates the driver-table panel as CTEs and then computes the
operator's result directly, without sharing code with the Spark side.
"""

from __future__ import annotations

_LIC = "['mit','apache-2.0','cc-by-nc-4.0','llama3','openrail','custom-terms']"

PANEL_CTES = f"""
_acc AS (
  SELECT n.n_nationkey, n.n_name AS author,
         CASE r.r_name WHEN 'AFRICA' THEN 'company' WHEN 'AMERICA' THEN 'university'
                       WHEN 'ASIA' THEN 'non-profit' WHEN 'EUROPE' THEN 'community' END AS org_type
  FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey),
_m0 AS (
  SELECT o_custkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS snapshot_date,
         CAST(SUM(CAST(floor(o_totalprice) AS BIGINT)) AS BIGINT) AS downloads,
         COUNT(*) AS likes, MIN(o_orderpriority) AS pmin, MAX(o_orderpriority) AS pmax,
         MAX(o_orderstatus) AS st
  FROM orders GROUP BY 1, 2),
_fz AS (SELECT CAST(b AS DATE) AS b, CAST(d AS DATE) AS d
        FROM (VALUES ('1995-05-01', '1995-06-01'), ('1996-08-01', '1996-09-01'), ('1998-02-01', '1998-03-01'),
                     ('1998-02-01', '1998-04-01'), ('2001-07-01', '2001-08-01')) v(b, d)),
_m AS (
  SELECT *, TRUE AS fresh FROM _m0 WHERE snapshot_date NOT IN (SELECT d FROM _fz)
  UNION ALL
  SELECT o_custkey, d, downloads, likes, pmin, pmax, st, FALSE FROM _m0 JOIN _fz ON snapshot_date = b),
_s AS (
  SELECT snapshot_date, CAST(row_number() OVER (ORDER BY snapshot_date) - 1 AS INTEGER) AS t
  FROM (SELECT DISTINCT snapshot_date FROM _m)),
panel AS (
  SELECT s.snapshot_date, s.t, m.o_custkey AS _id, c.c_name AS id,
         CASE WHEN c.c_custkey % 23 <> 0 THEN a.author END AS author,
         CASE WHEN c.c_custkey % 23 <> 0 THEN a.org_type END AS org_type,
         m.likes, m.downloads, c.c_acctbal AS mainSize,
         CASE WHEN c.c_custkey % 26 = 0 THEN CAST([] AS VARCHAR[])
              WHEN c.c_custkey % 13 = 0 THEN CAST(NULL AS VARCHAR[])
              ELSE list_filter([
                'task_categories:' || lower(c.c_mktsegment),
                CASE WHEN c.c_custkey % 11 <> 0 THEN 'license:' || {_LIC}[((CAST(substr(m.pmin, 1, 1) AS INTEGER) + c.c_custkey) % 6) + 1] END,
                CASE WHEN m.pmin <> m.pmax THEN 'license:' || {_LIC}[((CAST(substr(m.pmax, 1, 1) AS INTEGER) + c.c_custkey) % 6) + 1] END,
                CASE WHEN c.c_custkey % 7 = 0 THEN lower(c.c_mktsegment) END,
                'status-' || CASE m.st WHEN 'F' THEN 'finished' WHEN 'O' THEN 'open' WHEN 'P' THEN 'partial' END,
                'k' || CAST(c.c_custkey % 97 AS VARCHAR),
                CASE WHEN c.c_custkey % 5 = 0 THEN 'arxiv:' || CAST(c.c_custkey % 50 + 2300 AS VARCHAR) END,
                CASE WHEN c.c_custkey % 17 = 0 THEN 'size_categories:unmapped'
                     ELSE 'size_categories:' || CASE WHEN m.downloads < 50000 THEN 'n<1K'
                                                     WHEN m.downloads < 150000 THEN '1K<n<10K'
                                                     WHEN m.downloads < 300000 THEN '10K<n<100K'
                                                     WHEN m.downloads < 600000 THEN '100K<n<1M'
                                                     WHEN m.downloads < 1000000 THEN '1M<n<10M'
                                                     ELSE '10M<n<100M' END END
              ], lambda x: x IS NOT NULL) END AS tags,
         CASE WHEN s.snapshot_date >= DATE '1996-01-01'
              THEN CAST(SUM(m.downloads) FILTER (WHERE m.fresh) OVER (PARTITION BY m.o_custkey ORDER BY s.t
                                               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) END
           AS downloadsAllTime
  FROM _m m JOIN customer c ON m.o_custkey = c.c_custkey
            JOIN _acc a ON c.c_nationkey = a.n_nationkey
            JOIN _s s ON m.snapshot_date = s.snapshot_date),
types AS (
  SELECT * FROM (VALUES ('company'), ('university'), ('non-profit'), ('community'), ('classroom'),
                        ('government'), ('individual')) v(org_type)),
pb AS (SELECT * REPLACE (COALESCE(org_type, 'individual') AS org_type) FROM panel)
"""

# Second hub (suppliers x shipment month).
MODELS_CTES = """
_mm AS (
  SELECT l_suppkey, CAST(date_trunc('month', l_shipdate) AS DATE) AS snapshot_date,
         CAST(SUM(CAST(floor(l_extendedprice) AS BIGINT)) AS BIGINT) AS downloads, COUNT(*) AS likes
  FROM lineitem GROUP BY 1, 2),
_ms AS (
  SELECT snapshot_date, CAST(row_number() OVER (ORDER BY snapshot_date) - 1 AS INTEGER) AS t
  FROM (SELECT DISTINCT snapshot_date FROM _mm)),
mpanel AS (
  SELECT s.snapshot_date, s.t, m.l_suppkey AS _id, su.s_name AS id, a.author, a.org_type, m.likes, m.downloads,
         CASE WHEN s.snapshot_date >= DATE '1996-01-01'
              THEN CAST(SUM(m.downloads) OVER (PARTITION BY m.l_suppkey ORDER BY s.t
                                               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) END
           AS downloadsAllTime
  FROM _mm m JOIN supplier su ON m.l_suppkey = su.s_suppkey
             JOIN _acc a ON su.s_nationkey = a.n_nationkey
             JOIN _ms s ON m.snapshot_date = s.snapshot_date)
"""

ORGS_CTE = """
orgs AS (
  SELECT n.n_name AS author,
         CASE n.n_nationkey % 5 WHEN 0 THEN 'government' WHEN 1 THEN 'classroom' WHEN 2 THEN 'Lab' END AS csv_type,
         CAST(COALESCE(f.followers, 0) AS BIGINT) AS followers
  FROM nation n LEFT JOIN (SELECT s_nationkey, COUNT(*) AS followers FROM supplier GROUP BY 1) f
    ON n.n_nationkey = f.s_nationkey
  WHERE n.n_nationkey % 12 <> 7),
pr AS (
  SELECT p.* REPLACE (
           CASE WHEN COALESCE(o.csv_type, p.org_type, 'individual') IN
                     ('company','university','non-profit','community','classroom','government','individual')
                THEN COALESCE(o.csv_type, p.org_type, 'individual') ELSE 'individual' END AS org_type)
  FROM panel p LEFT JOIN orgs o ON p.author = o.author)
"""

COUNTRY_CTE = """
countries AS (
  SELECT n_name AS account,
         CASE n_nationkey % 6 WHEN 0 THEN 'US' WHEN 1 THEN 'CN' WHEN 2 THEN 'FR' WHEN 3 THEN 'unknown'
                              WHEN 4 THEN 'JP' WHEN 5 THEN 'GB' END AS country
  FROM nation),
countries_known AS (SELECT * FROM countries WHERE country <> 'unknown')
"""


def with_panel(body: str, *extra: str) -> str:
    ctes = ",\n".join([PANEL_CTES.strip(), *[e.strip() for e in extra]])
    return f"WITH {ctes}\n{body.strip()}\n"


SQL: dict[str, str] = {}


def register(name: str, body: str, *extra: str) -> None:
    SQL[name] = with_panel(body, *extra)


register("metric_by_type", """
SELECT COALESCE(g.snapshot_date, v.snapshot_date) AS snapshot_date, COALESCE(g.org_type, v.org_type) AS org_type,
       CAST(COALESCE(v.downloads, 0) AS BIGINT) AS downloads,
       CAST(COALESCE(v.likes, 0) AS BIGINT) AS likes,
       CAST(COALESCE(v.downloadsAllTime, 0) AS BIGINT) AS downloadsAllTime
FROM (SELECT d.snapshot_date, t0.org_type FROM (SELECT DISTINCT snapshot_date FROM pb) d CROSS JOIN types t0) g
     FULL OUTER JOIN (SELECT snapshot_date, org_type, SUM(downloads) AS downloads, SUM(likes) AS likes,
                             SUM(downloadsAllTime) AS downloadsAllTime
                      FROM pb GROUP BY 1, 2) v
       ON g.snapshot_date = v.snapshot_date AND g.org_type = v.org_type
""")

register("org_type_resolved", """
SELECT snapshot_date, org_type, COUNT(*) AS n FROM pr GROUP BY 1, 2
""", ORGS_CTE)

register("count_by_type", """
SELECT d.snapshot_date, d.org_type, CAST(d.n AS BIGINT) AS n, CAST(tl.total AS BIGINT) AS total,
       CAST(tl.delta AS BIGINT) AS delta
FROM (SELECT s.snapshot_date, ty.org_type, COALESCE(g.n, 0) AS n
      FROM _s s CROSS JOIN types ty
      LEFT JOIN (SELECT snapshot_date, org_type, COUNT(*) AS n FROM pb GROUP BY 1, 2) g
        ON g.snapshot_date = s.snapshot_date AND g.org_type = ty.org_type) d
JOIN (SELECT snapshot_date, total, COALESCE(total - LAG(total) OVER (ORDER BY snapshot_date), 0) AS delta
      FROM (SELECT snapshot_date, COUNT(*) AS total FROM pb GROUP BY 1)) tl
  ON d.snapshot_date = tl.snapshot_date
""")

register("type_vectors", """
SELECT s.snapshot_date, ty.org_type,
       CAST(COALESCE(g.dl, 0) AS BIGINT) AS dl,
       CASE WHEN gate.tracked > 0 THEN CAST(COALESCE(g.dlat, 0) AS BIGINT) END AS dlat,
       CAST(COALESCE(g.lk, 0) AS BIGINT) AS lk, CAST(COALESCE(g.n, 0) AS BIGINT) AS n,
       CAST(COALESCE(g.new, 0) AS BIGINT) AS new
FROM _s s CROSS JOIN types ty
LEFT JOIN (SELECT snapshot_date, org_type, SUM(downloads) AS dl, SUM(downloadsAllTime) AS dlat, SUM(likes) AS lk,
                  COUNT(*) AS n, SUM(CASE WHEN t = first_t THEN 1 ELSE 0 END) AS new
           FROM (SELECT *, MIN(t) OVER (PARTITION BY _id) AS first_t FROM pr) GROUP BY 1, 2) g
  ON g.snapshot_date = s.snapshot_date AND g.org_type = ty.org_type
JOIN (SELECT snapshot_date, COUNT(downloadsAllTime) AS tracked FROM panel GROUP BY 1) gate
  ON gate.snapshot_date = s.snapshot_date
""", ORGS_CTE)

register("hub_totals", """
SELECT snapshot_date, COUNT(*) AS n, CAST(COALESCE(SUM(downloads), 0) AS BIGINT) AS dl,
       CAST(SUM(downloadsAllTime) AS BIGINT) AS dlat, CAST(COALESCE(SUM(likes), 0) AS BIGINT) AS lk,
       COUNT(*) FILTER (WHERE hp) AS n_flag,
       CAST(COALESCE(SUM(downloads) FILTER (WHERE hp), 0) AS BIGINT) AS dl_flag,
       CASE WHEN COUNT(downloadsAllTime) > 0 THEN CAST(COALESCE(SUM(downloadsAllTime) FILTER (WHERE hp), 0) AS BIGINT) END AS dlat_flag,
       CAST(COALESCE(SUM(likes) FILTER (WHERE hp), 0) AS BIGINT) AS lk_flag
FROM (SELECT *, COALESCE(len(list_filter(tags, lambda x: starts_with(x, 'arxiv:'))) > 0, FALSE) AS hp FROM panel)
GROUP BY 1
""")

_SHARES = """
SELECT snapshot_date, org_type, v AS value, CAST(SUM(v) OVER (PARTITION BY snapshot_date) AS BIGINT) AS total,
       CAST(CASE WHEN SUM(v) OVER (PARTITION BY snapshot_date) = 0 THEN NULL
                 ELSE CAST(v AS DOUBLE) / SUM(v) OVER (PARTITION BY snapshot_date) END AS DECIMAL(20,6)) AS share
FROM (SELECT s.snapshot_date, ty.org_type, CAST(COALESCE(g.v, 0) AS BIGINT) AS v
      FROM _s s CROSS JOIN types ty
      LEFT JOIN (SELECT snapshot_date, org_type, SUM({m}) AS v FROM pb GROUP BY 1, 2) g
        ON g.snapshot_date = s.snapshot_date AND g.org_type = ty.org_type
      WHERE ty.org_type <> 'individual')
"""
register("type_shares", _SHARES.format(m="downloadsAllTime"))
register("company_share", "SELECT snapshot_date, value, total, share FROM (" + _SHARES.format(m="likes")
         + ") WHERE org_type = 'company'")

register("presence_outcome", """
SELECT snapshot_date, org_type, side, n, outcome,
       CAST(CAST(n AS DOUBLE) / SUM(n) OVER w AS DECIMAL(20,6)) AS presence_share,
       CAST(CASE WHEN SUM(outcome) OVER w = 0 THEN NULL ELSE CAST(outcome AS DOUBLE) / SUM(outcome) OVER w END AS DECIMAL(20,6)) AS outcome_share,
       CAST(CAST(SUM(n) OVER (PARTITION BY snapshot_date, side) AS DOUBLE) / SUM(n) OVER w AS DECIMAL(20,6)) AS side_presence_share,
       CAST(CASE WHEN SUM(outcome) OVER w = 0 THEN NULL
                 ELSE CAST(SUM(outcome) OVER (PARTITION BY snapshot_date, side) AS DOUBLE) / SUM(outcome) OVER w END
            AS DECIMAL(20,6)) AS side_outcome_share
FROM (SELECT snapshot_date, org_type, CASE WHEN org_type = 'individual' THEN 'individual' ELSE 'organisation' END AS side,
             COUNT(*) AS n, CAST(COALESCE(SUM(downloadsAllTime), 0) AS BIGINT) AS outcome
      FROM pr GROUP BY 1, 2)
WINDOW w AS (PARTITION BY snapshot_date)
""", ORGS_CTE)

register("topn_items", """
SELECT s.snapshot_date, ty.org_type, CAST(COALESCE(a.total, 0) AS BIGINT) AS total,
       CAST(COALESCE(b.topn, 0) AS BIGINT) AS topn
FROM _s s CROSS JOIN types ty
LEFT JOIN (SELECT snapshot_date, org_type, SUM(downloads) AS total FROM pb GROUP BY 1, 2) a
  ON a.snapshot_date = s.snapshot_date AND a.org_type = ty.org_type
LEFT JOIN (SELECT snapshot_date, org_type, SUM(downloads) AS topn
           FROM (SELECT *, row_number() OVER (PARTITION BY snapshot_date, org_type ORDER BY downloads DESC, _id) AS rk
                 FROM pb WHERE downloads IS NOT NULL) WHERE rk <= 10 GROUP BY 1, 2) b
  ON b.snapshot_date = s.snapshot_date AND b.org_type = ty.org_type
""")

register("topn_accounts", """
SELECT s.snapshot_date, ty.org_type, CAST(COALESCE(r.total, 0) AS BIGINT) AS total,
       CAST(COALESCE(r.topn, 0) AS BIGINT) AS topn, COALESCE(r.top3, '') AS top3
FROM _s s CROSS JOIN types ty
LEFT JOIN (SELECT snapshot_date, org_type, SUM(val) AS total, SUM(val) FILTER (WHERE rk <= 2) AS topn,
                  COALESCE(string_agg(COALESCE(author, '') || '=' || CAST(val AS VARCHAR), ',' ORDER BY rk)
                           FILTER (WHERE rk <= 3 AND val <> 0), '') AS top3
           FROM (SELECT *, row_number() OVER (PARTITION BY snapshot_date, org_type ORDER BY val DESC, author NULLS LAST) AS rk
                 FROM (SELECT snapshot_date, org_type, author, CAST(COALESCE(SUM(downloads), 0) AS BIGINT) AS val
                       FROM pr GROUP BY 1, 2, 3))
           GROUP BY 1, 2) r
  ON r.snapshot_date = s.snapshot_date AND r.org_type = ty.org_type
""", ORGS_CTE)

_BY_ACCOUNT = """
SELECT snapshot_date, t, author, CAST(COALESCE(SUM(downloads), 0) AS BIGINT) AS dl,
       CAST(COALESCE(SUM(likes), 0) AS BIGINT) AS lk, CAST(COALESCE(SUM(downloadsAllTime), 0) AS BIGINT) AS dlat,
       COUNT(*) AS n, MIN(org_type) AS org_type
FROM {src} WHERE author IS NOT NULL GROUP BY 1, 2, 3
"""
register("by_account", "SELECT * EXCLUDE (t) FROM (" + _BY_ACCOUNT.format(src="panel") + ")")

register("account_ranks", """
SELECT snapshot_date, author, metric, 'a' AS variant,
       CAST(row_number() OVER (PARTITION BY snapshot_date, metric ORDER BY v DESC, author) AS INTEGER) AS rk
FROM base
UNION ALL
SELECT snapshot_date, author, metric, 'o' AS variant,
       CAST(row_number() OVER (PARTITION BY snapshot_date, metric ORDER BY v DESC, author) AS INTEGER) AS rk
FROM base WHERE org_type <> 'individual'
""", ORGS_CTE, "acc AS (" + _BY_ACCOUNT.format(src="pr").replace("WHERE author IS NOT NULL ", "") + ")", """
base AS (SELECT snapshot_date, author, org_type, m.metric,
                CASE m.metric WHEN 'dl' THEN dl WHEN 'lk' THEN lk ELSE dlat END AS v
         FROM acc CROSS JOIN (VALUES ('dl'), ('lk'), ('dlat')) m(metric)
         WHERE m.metric <> 'dlat'
            OR snapshot_date IN (SELECT snapshot_date FROM pr GROUP BY 1 HAVING COUNT(downloadsAllTime) > 0))""")

_GROWTH = """
SELECT snapshot_date, _id, base, value, g, rk FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY snapshot_date ORDER BY g DESC, _id) AS INTEGER) AS rk
  FROM (SELECT snapshot_date, _id, downloadsAllTime AS value,
               first_value(downloadsAllTime) OVER (PARTITION BY _id ORDER BY t) AS base,
               downloadsAllTime - first_value(downloadsAllTime) OVER (PARTITION BY _id ORDER BY t) AS g
        FROM panel WHERE downloadsAllTime IS NOT NULL))
WHERE rk <= {n}
"""


def _top(src: str, metric: str, key: str, n: int) -> str:
    return (f"SELECT {key} FROM (SELECT {key}, row_number() OVER (PARTITION BY snapshot_date ORDER BY {metric} DESC, {key}) AS rk "
            f"FROM {src} WHERE {metric} IS NOT NULL) WHERE rk <= {n}")


register("ever_in_pool", " UNION ".join([_top("panel", m, "_id", 100) for m in ("downloads", "likes", "downloadsAllTime")]
                                       + [f"SELECT _id FROM ({_GROWTH.format(n=100)})"]))

register("pool_series", """
SELECT * EXCLUDE (t) FROM acc WHERE author IN (""" + _top("acc", "dl", "author", 5) + " UNION " + _top("acc", "lk", "author", 5) + ")",
         "acc AS (" + _BY_ACCOUNT.format(src="panel") + ")")

register("top_latest", """
SELECT _id, id, downloadsAllTime FROM panel
WHERE t = (SELECT MAX(t) - 1 FROM panel) AND downloadsAllTime IS NOT NULL
ORDER BY downloadsAllTime DESC, _id LIMIT 100
""")

register("topn_membership", """
SELECT _id, org_type, arg_max(id, t) AS id, COUNT(*) AS snapshots_in_topN,
       CAST(AVG(share) AS DECIMAL(20,6)) AS avg_share_in_org
FROM (SELECT *, CASE WHEN tot = 0 THEN NULL ELSE CAST(downloads AS DOUBLE) / tot END AS share
      FROM (SELECT *, SUM(downloads) OVER (PARTITION BY snapshot_date, org_type) AS tot,
                   row_number() OVER (PARTITION BY snapshot_date, org_type ORDER BY downloads DESC, _id) AS rk
            FROM pb) WHERE rk <= 10 AND downloads IS NOT NULL)
GROUP BY 1, 2
""")

register("top7_per_type", """
SELECT org_type, author, value, rk, group_total,
       CAST(DENSE_RANK() OVER (ORDER BY group_total DESC, org_type) AS INTEGER) AS group_rank
FROM (SELECT org_type, author, dl AS value, CAST(rk AS INTEGER) AS rk,
             CAST(SUM(dl) OVER (PARTITION BY org_type) AS BIGINT) AS group_total
      FROM (SELECT *, row_number() OVER (PARTITION BY org_type ORDER BY dl DESC, author) AS rk
            FROM acc WHERE t = (SELECT MAX(t) - 1 FROM panel)) WHERE rk <= 2)
""", ORGS_CTE, "acc AS (" + _BY_ACCOUNT.format(src="pr") + ")")

register("group_share", """
SELECT snapshot_date, _id, org_type,
       CAST(CASE WHEN SUM(downloads) OVER (PARTITION BY snapshot_date, org_type) = 0 THEN NULL
                 ELSE CAST(downloads AS DOUBLE) / SUM(downloads) OVER (PARTITION BY snapshot_date, org_type) END
            AS DECIMAL(20,8)) AS share
FROM pb
""")

_SPIKES = """
SELECT * FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY snapshot_date ORDER BY delta DESC, _id) AS INTEGER) AS rk
  FROM (SELECT snapshot_date, t, _id, id, org_type, downloads,
               LAG(downloads) OVER w AS downloads_prev, LAG(t) OVER w AS pt,
               downloads - LAG(downloads) OVER w AS delta
        FROM pb WINDOW w AS (PARTITION BY _id ORDER BY t))
  WHERE t - pt = 1 AND delta IS NOT NULL)
WHERE rk <= 5
"""
register("weekly_spikes", "SELECT snapshot_date, _id, id, org_type, downloads_prev, downloads, delta, rk FROM ("
         + _SPIKES + ")")

register("spike_summary", """
SELECT _id, snapshot_date, id, org_type, downloads_prev, downloads, delta, topK_appearances FROM (
  SELECT *, row_number() OVER (PARTITION BY _id ORDER BY delta DESC, t ASC) AS pick,
         COUNT(*) OVER (PARTITION BY _id) AS topK_appearances
  FROM (""" + _SPIKES + """))
WHERE pick = 1 ORDER BY delta DESC, _id LIMIT 25
""")

register("account_gain", """
SELECT snapshot_date, author, lk, lk_prev, lk - lk_prev AS lkd FROM (
  SELECT snapshot_date, t, author, lk, LAG(lk) OVER w AS lk_prev, LAG(t) OVER w AS pt
  FROM acc WINDOW w AS (PARTITION BY author ORDER BY t))
WHERE t - pt = 1
""", "acc AS (" + _BY_ACCOUNT.format(src="panel") + ")")

register("newly_added", """
SELECT s.snapshot_date, ty.org_type, COALESCE(g.new, 0) AS new
FROM _s s CROSS JOIN types ty
LEFT JOIN (SELECT snapshot_date, org_type, COUNT(*) AS new
           FROM (SELECT *, MIN(t) OVER (PARTITION BY _id) AS ft FROM pb) WHERE t = ft GROUP BY 1, 2) g
  ON g.snapshot_date = s.snapshot_date AND g.org_type = ty.org_type
""")

register("newly_added_cumulative", """
SELECT snapshot_date, newly_added, CAST(SUM(newly_added) OVER (ORDER BY snapshot_date) AS BIGINT) AS cumulative
FROM (SELECT s.snapshot_date, COALESCE(g.c, 0) AS newly_added
      FROM _s s LEFT JOIN (SELECT snapshot_date, COUNT(*) AS c
                           FROM (SELECT *, MIN(t) OVER (PARTITION BY _id) AS ft FROM panel) WHERE t = ft
                           GROUP BY 1) g ON g.snapshot_date = s.snapshot_date)
""")

register("growth_since_baseline", _GROWTH.format(n=100))

register("latest_attrs", """
SELECT l._id, l.id, l.author, array_to_string(list_sort(l.tags), '|') AS tags, o.org_type, l.t AS last_t
FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY _id ORDER BY t DESC) AS rn FROM panel) WHERE rn = 1) l
LEFT JOIN (SELECT _id, arg_max(org_type, t) AS org_type FROM panel WHERE org_type IS NOT NULL GROUP BY 1) o
  ON o._id = l._id
""")

register("series_bounds", """
SELECT _id, MIN(t) FILTER (WHERE downloads IS NOT NULL) AS downloads_start,
       MAX(t) FILTER (WHERE downloads IS NOT NULL) AS downloads_end,
       MIN(t) FILTER (WHERE downloadsAllTime IS NOT NULL) AS downloadsAllTime_start,
       MAX(t) FILTER (WHERE downloadsAllTime IS NOT NULL) AS downloadsAllTime_end
FROM panel GROUP BY 1
""")

register("entity_history", """
SELECT * REPLACE (array_to_string(COALESCE(tags, CAST([] AS VARCHAR[])), '|') AS tags) FROM panel
WHERE _id = (SELECT arg_max(_id, t) FROM panel WHERE id = 'Customer#000000007')
""")

_FROZEN = """
SELECT snapshot_date, t, n, lk,
       COALESCE(n = LAG(n) OVER (ORDER BY t) AND lk = LAG(lk) OVER (ORDER BY t), FALSE) AS frozen
FROM (SELECT snapshot_date, t, COUNT(*) AS n, CAST(COALESCE(SUM(likes), 0) AS BIGINT) AS lk FROM {src} GROUP BY 1, 2)
"""
register("frozen_snapshots", "SELECT snapshot_date, n, lk, frozen FROM (" + _FROZEN.format(src="panel") + ")")


def _interp(v: str) -> str:
    num = f"(a.{v} * (sm.bt - sm.at - (sm.t - sm.at)) + b.{v} * (sm.t - sm.at))"
    den = "(sm.bt - sm.at)"
    q = f"({num} // {den})"
    r = f"({num} % {den})"
    return (f"CASE WHEN sm.fz AND sm.at IS NOT NULL AND sm.bt IS NOT NULL AND a.{v} IS NOT NULL AND b.{v} IS NOT NULL "
            f"THEN CAST({q} + CASE WHEN 2 * {r} > {den} OR (2 * {r} = {den} AND {q} % 2 = 1) THEN 1 ELSE 0 END AS BIGINT) "
            f"ELSE sm.{v} END")


register("smoothed_series", f"""
SELECT sm.snapshot_date, sm.org_type, {_interp('dlat')} AS dlat, {_interp('lk')} AS lk
FROM sm LEFT JOIN d a ON a.org_type = sm.org_type AND a.t = sm.at
        LEFT JOIN d b ON b.org_type = sm.org_type AND b.t = sm.bt
""", ORGS_CTE, """
fr AS (""" + _FROZEN.format(src="pr") + """),
d AS (
  SELECT s.snapshot_date, s.t, ty.org_type,
         CASE WHEN gate.tracked > 0 AND g.org_type IS NOT NULL THEN CAST(COALESCE(g.dlat, 0) AS BIGINT) END AS dlat,
         CAST(COALESCE(g.lk, 0) AS BIGINT) AS lk, fr.frozen AS fz
  FROM _s s CROSS JOIN types ty
  JOIN fr ON fr.t = s.t
  JOIN (SELECT snapshot_date, COUNT(downloadsAllTime) AS tracked FROM pr GROUP BY 1) gate ON gate.snapshot_date = s.snapshot_date
  LEFT JOIN (SELECT snapshot_date, org_type, SUM(downloadsAllTime) AS dlat, SUM(likes) AS lk FROM pr GROUP BY 1, 2) g
    ON g.snapshot_date = s.snapshot_date AND g.org_type = ty.org_type),
sm AS (
  SELECT d.*,
         last_value(CASE WHEN NOT fz THEN t END IGNORE NULLS) OVER (PARTITION BY org_type ORDER BY t
                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS at,
         first_value(CASE WHEN NOT fz THEN t END IGNORE NULLS) OVER (PARTITION BY org_type ORDER BY t
                    ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS bt
  FROM d)""")


def _round_sig(v: str, sig: int = 3) -> str:
    a = f"abs({v})"
    p = f"CAST(pow(10, greatest(length(CAST({a} AS VARCHAR)) - {sig}, 0)) AS BIGINT)"
    q = f"({a} // {p})"
    r = f"({a} % {p})"
    return (f"CASE WHEN {v} IS NULL OR {v} = 0 THEN {v} ELSE CAST(sign({v}) * ({q} + CASE WHEN 2 * {r} > {p} "
            f"OR (2 * {r} = {p} AND {q} % 2 = 1) THEN 1 ELSE 0 END) * {p} AS BIGINT) END")


register("entity_series", f"""
SELECT _id, snapshot_date, {_round_sig('downloads')} AS dl, {_round_sig('downloadsAllTime')} AS dlat, likes AS lk
FROM panel WHERE _id IN (""" + " UNION ".join(_top("panel", m, "_id", 20) for m in ("downloads", "likes", "downloadsAllTime")) + ")")

_TOPIC = ("CASE WHEN starts_with(x, 'task_categories:') THEN substr(x, 17) "
          "WHEN NOT contains(x, ':') THEN x END")
_TOPICS = f"list_distinct(list_filter(list_transform(COALESCE(tags, CAST([] AS VARCHAR[])), lambda x: {_TOPIC}), lambda y: y IS NOT NULL))"

register("tag_topics", f"""
SELECT x AS tag, COUNT(*) AS n, {_TOPIC} AS topic
FROM (SELECT unnest(tags) AS x FROM panel) GROUP BY x
""")

register("has_paper", """
SELECT snapshot_date, _id,
       COALESCE(len(list_filter(tags, lambda x: starts_with(x, 'arxiv:'))) > 0, FALSE) AS has_paper,
       array_to_string(list_transform(list_filter(COALESCE(tags, CAST([] AS VARCHAR[])), lambda x: starts_with(x, 'arxiv:')),
                                      lambda x: substr(x, 7)), '|') AS arxiv
FROM panel
""")

_LIC_OF = "substr(list_filter(tags, lambda x: starts_with(x, 'license:'))[1], 9)"


def _lic_group(col: str) -> str:
    from ..functions.fixed import LICENSE_TAXONOMY
    whens = " ".join(f"WHEN '{slug}' THEN '{('AUP (' + sub + ')') if cat == 'AUP' else cat}'"
                     for slug, (cat, sub) in LICENSE_TAXONOMY.items())
    return f"CASE WHEN {col} IS NULL THEN 'unspecified' ELSE (CASE {col} {whens} ELSE 'Other' END) END"


register("license_groups", f"""
SELECT license, COUNT(*) AS n, {_lic_group('license')} AS license_group
FROM (SELECT {_LIC_OF} AS license FROM panel) GROUP BY license
""")

register("size_midpoints", """
SELECT org_type, x, COUNT(*) AS n FROM (
  SELECT org_type, CASE substr(list_filter(tags, lambda t: starts_with(t, 'size_categories:'))[1], 17)
    WHEN 'n<1K' THEN 1.5 WHEN '1K<n<10K' THEN 3.5 WHEN '10K<n<100K' THEN 4.5 WHEN '100K<n<1M' THEN 5.5
    WHEN '1M<n<10M' THEN 6.5 WHEN '10M<n<100M' THEN 7.5 WHEN '100M<n<1B' THEN 8.5 WHEN '1B<n<10B' THEN 9.5
    WHEN '10B<n<100B' THEN 10.5 WHEN '100B<n<1T' THEN 11.5 WHEN 'n>1T' THEN 12.5 END::DOUBLE AS x
  FROM pb) GROUP BY 1, 2
""")

_TOPIC_COUNTS = f"""
SELECT topic, COUNT(DISTINCT _id) AS n, bool_or(list_contains(tg, 'task_categories:' || topic)) AS is_task
FROM (SELECT _id, COALESCE(tags, CAST([] AS VARCHAR[])) AS tg, unnest({_TOPICS}) AS topic FROM panel)
GROUP BY topic
"""
_VOCAB = f"""
SELECT topic, n, kind, CAST(row_number() OVER (ORDER BY CASE WHEN kind = 'task' THEN 0 ELSE 1 END, n DESC, topic) - 1 AS INTEGER) AS idx
FROM (SELECT topic, n, 'task' AS kind FROM tc WHERE is_task
      UNION ALL
      SELECT * FROM (SELECT topic, n, 'community' AS kind FROM tc
                     WHERE NOT is_task AND topic NOT IN (SELECT topic FROM tc WHERE is_task)
                     ORDER BY n DESC, topic LIMIT 60))
"""
_FULL = "snapshot_date < (SELECT MAX(snapshot_date) FROM panel)"
_VOCAB_COUNTS = _TOPIC_COUNTS.replace("FROM panel)", f"FROM panel WHERE snapshot_date = (SELECT MAX(snapshot_date) FROM panel WHERE {_FULL}))")
register("topic_vocab", _VOCAB, f"tc AS ({_VOCAB_COUNTS})")

register("freeform_topics", """
SELECT topic, n FROM tc WHERE NOT is_task AND topic NOT IN (SELECT topic FROM tc WHERE is_task)
""", f"tc AS ({_TOPIC_COUNTS})")

register("topic_series", f"""
SELECT s.snapshot_date, v.topic, CAST(COALESCE(g.n, 0) AS BIGINT) AS n, CAST(COALESCE(g.dl, 0) AS BIGINT) AS dl,
       CASE WHEN gate.tr > 0 THEN CAST(g.dlat AS BIGINT) END AS dlat, CAST(COALESCE(g.lk, 0) AS BIGINT) AS lk
FROM _s s CROSS JOIN vocab v
JOIN (SELECT snapshot_date, COUNT(downloadsAllTime) AS tr FROM panel GROUP BY 1) gate ON gate.snapshot_date = s.snapshot_date
LEFT JOIN (SELECT snapshot_date, topic, COUNT(*) AS n, SUM(downloads) AS dl, COALESCE(SUM(downloadsAllTime), 0) AS dlat,
                  SUM(likes) AS lk
           FROM (SELECT snapshot_date, downloads, downloadsAllTime, likes, unnest({_TOPICS}) AS topic FROM panel)
           WHERE topic IN (SELECT topic FROM vocab) GROUP BY 1, 2) g
  ON g.snapshot_date = s.snapshot_date AND g.topic = v.topic
""", f"tc AS ({_VOCAB_COUNTS})", f"vocab AS ({_VOCAB})")

_LIC_LONG = f"""
SELECT snapshot_date, CASE WHEN org_type = 'company' THEN 'company' ELSE 'public organisations' END AS org_group,
       {_lic_group(_LIC_OF)} AS license_group, COUNT(*) AS n, CAST(COALESCE(SUM(downloads), 0) AS BIGINT) AS downloads
FROM pb WHERE org_type <> 'individual' GROUP BY 1, 2, 3
"""
register("license_long", _LIC_LONG)

register("license_shares", """
SELECT snapshot_date, org_group, license_group, n, downloads,
       CAST(COALESCE(CASE WHEN SUM(n) OVER w = 0 THEN NULL ELSE CAST(n AS DOUBLE) / SUM(n) OVER w END, 0) AS DECIMAL(20,6)) AS share_n,
       CAST(COALESCE(CASE WHEN SUM(downloads) OVER w = 0 THEN NULL ELSE CAST(downloads AS DOUBLE) / SUM(downloads) OVER w END, 0)
            AS DECIMAL(20,6)) AS share_dl
FROM (SELECT s.snapshot_date, c.org_group, c.license_group, CAST(COALESCE(l.n, 0) AS BIGINT) AS n,
             CAST(COALESCE(l.downloads, 0) AS BIGINT) AS downloads
      FROM _s s
      CROSS JOIN (SELECT * FROM (VALUES ('company'), ('public organisations')) a(org_group),
                               (VALUES ('Permissive'), ('AUP (Community)'), ('AUP (BigTech)'), ('Non-Commercial'),
                                       ('Other'), ('unspecified')) b(license_group)) c
      LEFT JOIN ll l ON l.snapshot_date = s.snapshot_date AND l.org_group = c.org_group AND l.license_group = c.license_group)
WINDOW w AS (PARTITION BY snapshot_date, org_group)
""", f"ll AS ({_LIC_LONG})")

register("round_sig", f"""
SELECT snapshot_date, author, dl, {_round_sig('dl')} AS dl_r, {_round_sig('dlat')} AS dlat_r,
       {_round_sig('(lk * 997)')} AS lk_r
FROM acc
""", "acc AS (" + _BY_ACCOUNT.format(src="panel") + ")")

_PARSE_T = "replace(trim(token), ',', '')"
_NUM = f"regexp_extract({_PARSE_T}, '^([0-9.]+)\\s*([kKmM]?)', 1)"
_SUF = f"lower(regexp_extract({_PARSE_T}, '^([0-9.]+)\\s*([kKmM]?)', 2))"
register("parse_abbrev", f"""
SELECT doc_id, pos, token,
       CASE WHEN {_NUM} = '' THEN 0
            ELSE COALESCE(TRY_CAST(round_even(TRY_CAST({_NUM} AS DECIMAL(30,8))
                   * CASE {_SUF} WHEN 'k' THEN 1000 WHEN 'm' THEN 1000000 ELSE 1 END, 0) AS BIGINT), 0) END AS value
FROM (SELECT doc_id, CAST(generate_subscripts(l, 1) - 1 AS INTEGER) AS pos, unnest(l) AS token
      FROM (SELECT doc_id, regexp_extract_all(text, '([0-9][0-9.,]*[ ]?[kKmM]?)', 1) AS l FROM documents))
""")

_LINKS = """
links AS (
  SELECT DISTINCT l_orderkey AS model_id, 'Customer#' || lpad(CAST(l_suppkey AS VARCHAR), 9, '0') AS dataset_id
  FROM lineitem WHERE l_linenumber % 3 <> 0),
models AS (SELECT DISTINCT l_orderkey AS model_id FROM lineitem),
adopt AS (SELECT dataset_id, COUNT(*) AS n_models FROM links GROUP BY 1)
"""
register("adoption", "SELECT dataset_id, n_models FROM adopt", _LINKS)

register("adoption_totals", """
SELECT (SELECT COUNT(*) FROM models) AS models_seen,
       (SELECT COUNT(DISTINCT model_id) FROM links) AS models_linked,
       CAST(round(100.0 * (SELECT COUNT(DISTINCT model_id) FROM links) / (SELECT COUNT(*) FROM models), 1) AS DECIMAL(10,1)) AS linked_pct,
       (SELECT COUNT(DISTINCT dataset_id) FROM links) AS datasets_adopted,
       (SELECT COUNT(*) FROM links) AS total_links
""", _LINKS)

register("adoption_join", """
SELECT p.snapshot_date, p._id, p.id, CAST(COALESCE(a.n_models, 0) AS BIGINT) AS n_models
FROM panel p LEFT JOIN adopt a ON a.dataset_id = p.id
""", _LINKS)

_IMPACT = """
SELECT g.snapshot_date, g.org_type, '{scope}' AS scope, g.n, pop.pop,
       CAST((CAST(g.downloads AS DOUBLE) / NULLIF(SUM(g.downloads) OVER w, 0)) / (CAST(g.n AS DOUBLE) / SUM(g.n) OVER w) AS DECIMAL(20,4)) AS dl,
       CAST((CAST(g.likes AS DOUBLE) / NULLIF(SUM(g.likes) OVER w, 0)) / (CAST(g.n AS DOUBLE) / SUM(g.n) OVER w) AS DECIMAL(20,4)) AS lk,
       CAST((CAST(g.adoption AS DOUBLE) / NULLIF(SUM(g.adoption) OVER w, 0)) / (CAST(g.n AS DOUBLE) / SUM(g.n) OVER w) AS DECIMAL(20,4)) AS ad,
       g.downloads, g.likes, g.adoption
FROM (SELECT snapshot_date, org_type, COUNT(*) AS n, CAST(COALESCE(SUM(downloadsAllTime), 0) AS BIGINT) AS downloads,
             CAST(COALESCE(SUM(likes), 0) AS BIGINT) AS likes, CAST(COALESCE(SUM(n_models), 0) AS BIGINT) AS adoption
      FROM {src} GROUP BY 1, 2) g
JOIN (SELECT snapshot_date, org_type, COUNT(*) AS pop FROM j GROUP BY 1, 2) pop
  ON pop.snapshot_date = g.snapshot_date AND pop.org_type = g.org_type
WINDOW w AS (PARTITION BY g.snapshot_date)
"""
_J = """j AS (SELECT p.*, CAST(COALESCE(a.n_models, 0) AS BIGINT) AS n_models
      FROM panel p LEFT JOIN adopt a ON a.dataset_id = p.id WHERE p.org_type IS NOT NULL)"""
register("impact_all", _IMPACT.format(scope="all", src="j"), _LINKS, _J)
register("impact_top", _IMPACT.format(scope="top", src="""(SELECT * FROM (SELECT *, row_number() OVER
      (PARTITION BY snapshot_date ORDER BY downloadsAllTime DESC, _id) AS rk FROM j WHERE downloadsAllTime IS NOT NULL)
      WHERE rk <= 50)"""), _LINKS, _J)

# --- distributions -----------------------------------------------------------------


def _near(q: float, v: str = "v", i: str = "i", n: str = "n") -> str:
    return f"MIN({v}) FILTER (WHERE {i} = floor(({n} - 1)::DOUBLE * {q}::DOUBLE + 0.5))"


_BOX = """
SELECT c.snapshot_date, c.org_type, c.n_rows, CAST(c.share AS DECIMAL(20,6)) AS share,
       {p5} AS p5, {q1} AS q1, {med} AS med, {q3} AS q3, {p95} AS p95, {p99} AS p99,
       CAST(SUM(v)::DOUBLE / COUNT(*) AS DECIMAL(24,6)) AS mean, MAX(v) AS max, '{m}' AS metric
FROM (SELECT snapshot_date, org_type, COUNT(*) AS n_rows,
             AVG(CASE WHEN {col} >= 1 THEN 1.0 WHEN {col} IS NOT NULL THEN 0.0 END) AS share
      FROM pr GROUP BY 1, 2) c
JOIN (SELECT snapshot_date, org_type, {col} AS v,
             row_number() OVER (PARTITION BY snapshot_date, org_type ORDER BY {col}) - 1 AS i,
             COUNT(*) OVER (PARTITION BY snapshot_date, org_type) AS n
      FROM pr WHERE {col} >= 1) s
  ON s.snapshot_date = c.snapshot_date AND s.org_type = c.org_type
GROUP BY c.snapshot_date, c.org_type, c.n_rows, c.share
"""


def _box(m: str, col: str) -> str:
    return _BOX.format(m=m, col=col, p5=_near(0.05), q1=_near(0.25), med=_near(0.5), q3=_near(0.75),
                       p95=_near(0.95), p99=_near(0.99))


register("box_stats", _box("dlat", "downloadsAllTime") + " UNION ALL " + _box("lk", "likes"), ORGS_CTE)


def _conc(src: str, v: str, label: str | None = None) -> str:
    def topk(p):
        return f"SUM(v) FILTER (WHERE rn <= greatest(1, ceil(n::DOUBLE * {p}::DOUBLE)))"
    c1, c10, c50 = (f"(CASE WHEN SUM(v) = 0 THEN NULL ELSE {topk(p)}::DOUBLE / SUM(v) END)" for p in (0.01, 0.1, 0.5))
    return f"""
SELECT snapshot_date, org_type, MAX(n) AS n, CAST(SUM(v) AS BIGINT) AS total,
       CAST({c1} AS DECIMAL(20,6)) AS c1, CAST({c10} AS DECIMAL(20,6)) AS c10, CAST({c50} AS DECIMAL(20,6)) AS c50,
       CAST({c1} AS DECIMAL(20,6)) AS top1, CAST({c10} - {c1} AS DECIMAL(20,6)) AS next9,
       CAST({c50} - {c10} AS DECIMAL(20,6)) AS next40, CAST(1.0::DOUBLE - {c50} AS DECIMAL(20,6)) AS bottom50
       {"" if label is None else f", '{label}' AS metric"}
FROM (SELECT snapshot_date, org_type, COALESCE({v}, 0) AS v,
             row_number() OVER (PARTITION BY snapshot_date, org_type ORDER BY COALESCE({v}, 0) DESC) AS rn,
             COUNT(*) OVER (PARTITION BY snapshot_date, org_type) AS n FROM {src})
GROUP BY 1, 2
"""


register("concentration", _conc("pr", "downloadsAllTime", "dlat") + " UNION ALL " + _conc("pr", "likes", "lk"),
         ORGS_CTE)
_BY_ACCOUNT_TYPE = """
SELECT snapshot_date, t, author, org_type, CAST(COALESCE(SUM(downloads), 0) AS BIGINT) AS dl,
       CAST(COALESCE(SUM(likes), 0) AS BIGINT) AS lk, CAST(COALESCE(SUM(downloadsAllTime), 0) AS BIGINT) AS dlat,
       COUNT(*) AS n
FROM pr WHERE author IS NOT NULL GROUP BY 1, 2, 3, 4
"""
_ACC_V = """
SELECT snapshot_date, org_type, author, CAST(COALESCE(SUM({col}), 0) AS BIGINT) AS v FROM pr GROUP BY 1, 2, 3
"""
register("quantile_segments", _conc("av_dlat", "v", "dlat") + " UNION ALL " + _conc("av_lk", "v", "lk"), ORGS_CTE,
         f"av_dlat AS ({_ACC_V.format(col='downloadsAllTime')})", f"av_lk AS ({_ACC_V.format(col='likes')})")

_SIZE_ROWS = """
sz AS (SELECT *, CASE substr(list_filter(tags, lambda q: starts_with(q, 'size_categories:'))[1], 17)
    WHEN 'n<1K' THEN 1.5 WHEN '1K<n<10K' THEN 3.5 WHEN '10K<n<100K' THEN 4.5 WHEN '100K<n<1M' THEN 5.5
    WHEN '1M<n<10M' THEN 6.5 WHEN '10M<n<100M' THEN 7.5 WHEN '100M<n<1B' THEN 8.5 WHEN '1B<n<10B' THEN 9.5
    WHEN '10B<n<100B' THEN 10.5 WHEN '100B<n<1T' THEN 11.5 WHEN 'n>1T' THEN 12.5 END::DOUBLE AS x FROM pr),
szr AS (SELECT * FROM sz WHERE x IS NOT NULL)
"""


def _wstat(k: str, w: str) -> str:
    wc = f"COALESCE({w}, 0)::DOUBLE"
    m = f"(CASE WHEN SUM({wc}) = 0 THEN NULL ELSE SUM({wc} * x) / SUM({wc}) END)"
    x2 = f"(CASE WHEN SUM({wc}) = 0 THEN NULL ELSE SUM({wc} * x * x) / SUM({wc}) END)"
    return (f"CAST({m} AS DECIMAL(20,6)) AS {k}_m, "
            f"CAST(CASE WHEN {m} IS NOT NULL THEN sqrt(greatest(0.0, {x2} - {m} * {m})) END AS DECIMAL(20,6)) AS {k}_s")


register("size_stats", f"""
SELECT snapshot_date, org_type, COUNT(*) AS cnt, CAST(AVG(x) AS DECIMAL(20,6)) AS u_m,
       CAST(stddev_pop(x) AS DECIMAL(20,6)) AS u_s,
       {_wstat('dl', 'downloads')}, {_wstat('lk', 'likes')}, {_wstat('dlat', 'downloadsAllTime')}
FROM szr GROUP BY 1, 2
""", ORGS_CTE, _SIZE_ROWS)

_RANKS_BKT = """
acc2 AS (""" + _BY_ACCOUNT.format(src="pr").replace("WHERE author IS NOT NULL ", "") + """),
base2 AS (SELECT snapshot_date, author, org_type, m.metric,
                 CASE m.metric WHEN 'dl' THEN dl WHEN 'lk' THEN lk ELSE dlat END AS v
          FROM acc2 CROSS JOIN (VALUES ('dl'), ('lk'), ('dlat')) m(metric)
          WHERE m.metric <> 'dlat'
             OR snapshot_date IN (SELECT snapshot_date FROM pr GROUP BY 1 HAVING COUNT(downloadsAllTime) > 0)),
rk AS (SELECT snapshot_date, author, metric, 'a' AS variant,
              row_number() OVER (PARTITION BY snapshot_date, metric ORDER BY v DESC, author) AS rk FROM base2
       UNION ALL
       SELECT snapshot_date, author, metric, 'o' AS variant,
              row_number() OVER (PARTITION BY snapshot_date, metric ORDER BY v DESC, author) AS rk
       FROM base2 WHERE org_type <> 'individual'),
bk AS (SELECT *, CASE WHEN rk <= 2 THEN 0 WHEN rk <= 5 THEN 1 WHEN rk <= 10 THEN 2 WHEN rk <= 20 THEN 3
                      WHEN rk <= 25 THEN 4 END AS bkt FROM rk),
bs AS (SELECT s.snapshot_date, b.variant, b.metric, b.bkt, s.org_type, COUNT(*) AS c,
              SUM(x) AS sx, SUM(x * x) AS sx2,
              SUM(COALESCE(CASE b.metric WHEN 'dl' THEN s.downloads WHEN 'lk' THEN s.likes ELSE s.downloadsAllTime END, 0)::DOUBLE) AS sw,
              SUM(COALESCE(CASE b.metric WHEN 'dl' THEN s.downloads WHEN 'lk' THEN s.likes ELSE s.downloadsAllTime END, 0)::DOUBLE * x) AS swx,
              SUM(COALESCE(CASE b.metric WHEN 'dl' THEN s.downloads WHEN 'lk' THEN s.likes ELSE s.downloadsAllTime END, 0)::DOUBLE * x * x) AS swx2
       FROM szr s JOIN bk b ON b.snapshot_date = s.snapshot_date AND b.author = s.author
       WHERE b.bkt IS NOT NULL GROUP BY 1, 2, 3, 4, 5)
"""
register("bucket_stats", """
SELECT snapshot_date, variant, metric, bkt, org_type, c, CAST(sx AS DECIMAL(24,4)) AS sx, CAST(sx2 AS DECIMAL(24,4)) AS sx2,
       CAST(sw AS DECIMAL(24,4)) AS sw, CAST(swx AS DECIMAL(24,4)) AS swx, CAST(swx2 AS DECIMAL(24,4)) AS swx2
FROM bs
""", ORGS_CTE, _SIZE_ROWS, _RANKS_BKT)

register("prefix_stats", """
SELECT snapshot_date, variant, metric, org_type, bkt, CAST(c AS BIGINT) AS c,
       CAST(sx / c AS DECIMAL(20,6)) AS mean,
       CAST(sqrt(greatest(0.0, sx2 / c - (sx / c) * (sx / c))) AS DECIMAL(20,6)) AS sd,
       CAST(CASE WHEN sw = 0 THEN NULL ELSE swx / sw END AS DECIMAL(20,6)) AS w_mean,
       CAST(CASE WHEN sw = 0 THEN NULL ELSE sqrt(greatest(0.0, swx2 / sw - (swx / sw) * (swx / sw))) END AS DECIMAL(20,6)) AS w_sd
FROM (SELECT snapshot_date, variant, metric, org_type, bkt,
             SUM(c) OVER w AS c, SUM(sx) OVER w AS sx, SUM(sx2) OVER w AS sx2, SUM(sw) OVER w AS sw,
             SUM(swx) OVER w AS swx, SUM(swx2) OVER w AS swx2
      FROM bs WINDOW w AS (PARTITION BY snapshot_date, variant, metric, org_type ORDER BY bkt
                           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
""", ORGS_CTE, _SIZE_ROWS, _RANKS_BKT)


def _hist(key: str, col: str, edges) -> str:
    b = " + ".join(f"CASE WHEN {col} >= {float(e)!r}::DOUBLE THEN 1 ELSE 0 END" for e in edges)
    return (f"SELECT snapshot_date, author, {b} AS bin, COUNT(*) AS c, '{key}' AS key FROM panel "
            f"WHERE {col} IS NOT NULL GROUP BY 1, 2, 3")


def _hist_all() -> str:
    from ..functions.fixed import HIST_COLS, HIST_EDGES
    return " UNION ALL ".join(_hist(k, c, HIST_EDGES[k]) for k, c in HIST_COLS.items())


register("account_hist", _hist_all())


def _np_bin(x: str, lo: str, step: str, bins: int = 80) -> str:
    """Histogram bin over linspace edges lo + k * step (floating point)."""
    cand = f"CAST(least(greatest(floor(({x} - {lo}) / {step}), 0), {bins - 1}) AS INTEGER)"
    def edge(k):
        return f"(CAST({k} AS DOUBLE) * {step} + {lo})"
    return (f"CAST(CASE WHEN {x} < {edge(cand)} THEN {cand} - 1 "
            f"WHEN {cand} < {bins - 1} AND {x} >= {edge(cand + ' + 1')} THEN {cand} + 1 ELSE {cand} END AS INTEGER)")


def _density_ctes(src: str, lower: bool, k: str) -> str:
    lo = _near(0.001, "x", "i", "n") if lower else "0.0::DOUBLE"
    return f"""
xs_{k} AS ({src}),
lim_{k} AS (SELECT *, CASE WHEN hi > lo THEN (hi - lo) / 80 ELSE 1.0::DOUBLE END AS w, CASE WHEN hi > lo THEN 0.12::DOUBLE / ((hi - lo) / 80) ELSE 1e-3::DOUBLE END AS s
        FROM (SELECT snapshot_date AS sd, {lo} AS lo, {_near(0.999, 'x', 'i', 'n')} AS hi
              FROM (SELECT snapshot_date, x, row_number() OVER (PARTITION BY snapshot_date ORDER BY x) - 1 AS i,
                           COUNT(*) OVER (PARTITION BY snapshot_date) AS n FROM xs_{k}) GROUP BY 1)),
h_{k} AS (SELECT snapshot_date, org_type, lo, hi, s, {_np_bin('x', 'lo', 'w')} AS bin, COUNT(*)::DOUBLE AS h
      FROM xs_{k} JOIN lim_{k} ON sd = snapshot_date WHERE x >= lo AND x <= hi GROUP BY 1, 2, 3, 4, 5, 6),
kj_{k} AS (SELECT sd, s, unnest(range(-CAST(ceil(4.0 * s) AS BIGINT), CAST(ceil(4.0 * s) AS BIGINT) + 1)) AS j FROM lim_{k}),
ks_{k} AS (SELECT sd, SUM(exp(-0.5 * pow(j / s, 2))) AS ksum FROM kj_{k} GROUP BY 1),
sm_{k} AS (SELECT snapshot_date, org_type, lo, hi, bin + j AS i, SUM(h * exp(-0.5 * pow(j / kj.s, 2)) / ksum) AS d
       FROM h_{k} h JOIN kj_{k} kj ON kj.sd = snapshot_date JOIN ks_{k} ks ON ks.sd = snapshot_date
       WHERE bin + j BETWEEN 0 AND 79 GROUP BY 1, 2, 3, 4, 5),
dn_{k} AS (SELECT g.snapshot_date, g.org_type, g.lo, g.hi, b.bin, COALESCE(sm.d, 0.0) AS d
       FROM (SELECT DISTINCT snapshot_date, org_type, lo, hi FROM sm_{k}) g CROSS JOIN range(0, 80) b(bin)
       LEFT JOIN sm_{k} sm ON sm.snapshot_date = g.snapshot_date AND sm.org_type = g.org_type AND sm.i = b.bin)"""


def _density_select(k: str, label: str | None) -> str:
    extra = "" if label is None else f", '{label}' AS metric"
    return f"""
SELECT snapshot_date, org_type, CAST(bin AS INTEGER) AS bin, CAST(lo AS DECIMAL(20,6)) AS lo, CAST(hi AS DECIMAL(20,6)) AS hi,
       CAST(d / MAX(d) OVER (PARTITION BY snapshot_date, org_type) AS DECIMAL(20,6)) AS d{extra}
FROM dn_{k}"""


register("log_density", _density_select("dlat", "dlat") + " UNION ALL " + _density_select("lk", "lk"), ORGS_CTE,
         _density_ctes("SELECT snapshot_date, org_type, log10(downloadsAllTime) AS x FROM pr WHERE downloadsAllTime >= 1", False, "dlat"),
         _density_ctes("SELECT snapshot_date, org_type, log10(likes) AS x FROM pr WHERE likes >= 1", False, "lk"))
register("size_density", _density_select("sz", None), ORGS_CTE,
         _density_ctes("SELECT snapshot_date, org_type, log10(mainSize) AS x FROM pr WHERE mainSize > 0", True, "sz"))


def _rank_density(width: float) -> str:
    w = int(round(width * 1000))
    return f"""
SELECT snapshot_date, org_type, CAST(bin AS INTEGER) AS bin, {width}::DOUBLE AS width,
       CAST(CASE WHEN MAX(d) OVER (PARTITION BY snapshot_date) = 0 THEN NULL
                 ELSE d / MAX(d) OVER (PARTITION BY snapshot_date) END AS DECIMAL(20,6)) AS d
FROM (SELECT g.snapshot_date, g.org_type, b.bin, COALESCE(sm.d, 0.0) AS d
      FROM (SELECT DISTINCT snapshot_date, org_type FROM acct) g CROSS JOIN range(0, 80) b(bin)
      LEFT JOIN sm_{w} sm ON sm.snapshot_date = g.snapshot_date AND sm.org_type = g.org_type AND sm.i = b.bin)
"""


def _rank_ctes(width: float) -> str:
    w = int(round(width * 1000))
    return f"""
hr_{w} AS (SELECT snapshot_date, org_type, {_np_bin('((i + 0.5) / n)', '0.0', f'({width}::DOUBLE / 80)')} AS bin,
                  SUM(v::DOUBLE / tot) AS h
           FROM (SELECT snapshot_date, org_type, v,
                        row_number() OVER (PARTITION BY snapshot_date, org_type ORDER BY v DESC) - 1 AS i,
                        COUNT(*) OVER (PARTITION BY snapshot_date, org_type) AS n,
                        SUM(CASE WHEN v >= 1 THEN v END) OVER (PARTITION BY snapshot_date, org_type) AS tot
                 FROM acct)
           WHERE v >= 1 AND (i + 0.5) / n <= {width}::DOUBLE GROUP BY 1, 2, 3),
sm_{w} AS (SELECT snapshot_date, org_type, bin + j AS i,
                  SUM(h * exp(-0.5 * pow(j / 0.64, 2)) / (SELECT SUM(exp(-0.5 * pow(jj / 0.64, 2))) FROM range(-3, 4) q(jj))) AS d
           FROM hr_{w}, range(-3, 4) g(j) WHERE bin + j BETWEEN 0 AND 79 GROUP BY 1, 2, 3)
"""


register("rank_density", _rank_density(1.0) + " UNION ALL " + _rank_density(0.1), ORGS_CTE,
         f"acct AS ({_ACC_V.format(col='downloadsAllTime')})", _rank_ctes(1.0), _rank_ctes(0.1))


def _icdf(q: float, weighted: bool) -> str:
    if weighted:
        return f"MIN(v) FILTER (WHERE tw > 0 AND cw >= tw * {q}::DOUBLE)"
    return f"MIN(v) FILTER (WHERE cn >= n * {q}::DOUBLE)"


_WEIGHTED = f"""
SELECT snapshot_date, org_type, {_icdf(.25, False)} AS q1, {_icdf(.5, False)} AS med, {_icdf(.75, False)} AS q3,
       MAX(n) AS n, {_icdf(.25, True)} AS w_q1, {_icdf(.5, True)} AS w_med, {_icdf(.75, True)} AS w_q3,
       CAST(MAX(tw) AS BIGINT) AS sum_w
FROM (SELECT snapshot_date, org_type, mainSize AS v,
             COUNT(*) OVER (PARTITION BY snapshot_date, org_type ORDER BY mainSize) AS cn,
             COUNT(*) OVER (PARTITION BY snapshot_date, org_type) AS n,
             SUM(COALESCE(downloadsAllTime, 0)) OVER (PARTITION BY snapshot_date, org_type ORDER BY mainSize) AS cw,
             SUM(COALESCE(downloadsAllTime, 0)) OVER (PARTITION BY snapshot_date, org_type) AS tw
      FROM pr WHERE mainSize > 0)
GROUP BY 1, 2
"""
register("weighted_quantiles", _WEIGHTED, ORGS_CTE)

_CSTATS = """
coh AS (SELECT p.*, COALESCE(k.country, 'unknown') AS country
        FROM panel p LEFT JOIN countries_known k ON k.account = p.author),
cs AS (SELECT snapshot_date, country, CAST(COALESCE(SUM(downloadsAllTime), 0) AS BIGINT) AS dl, COUNT(*) AS n,
              COUNT(*) FILTER (WHERE mainSize > 0) AS n_size,
              CAST(quantile_cont(CASE WHEN mainSize > 0 THEN log10(mainSize) END, 0.25) AS DECIMAL(20,6)) AS q1,
              CAST(quantile_cont(CASE WHEN mainSize > 0 THEN log10(mainSize) END, 0.5) AS DECIMAL(20,6)) AS med,
              CAST(quantile_cont(CASE WHEN mainSize > 0 THEN log10(mainSize) END, 0.75) AS DECIMAL(20,6)) AS q3
       FROM coh GROUP BY 1, 2)
"""
register("country_stats", "SELECT * FROM cs", COUNTRY_CTE, _CSTATS)

register("country_top_rest", """
SELECT snapshot_date, country, CAST(SUM(dl) AS BIGINT) AS dl, COUNT(*) AS members,
       CAST(CASE WHEN SUM(SUM(dl)) OVER (PARTITION BY snapshot_date) = 0 THEN NULL
                 ELSE SUM(dl)::DOUBLE / SUM(SUM(dl)) OVER (PARTITION BY snapshot_date) END AS DECIMAL(20,6)) AS share
FROM (SELECT snapshot_date,
             CASE WHEN row_number() OVER (PARTITION BY snapshot_date ORDER BY dl DESC, country) <= 3 THEN country
                  ELSE 'others' END AS country, dl
      FROM cs)
GROUP BY 1, 2
""", COUNTRY_CTE, _CSTATS)

register("region_rollup", """
SELECT snapshot_date,
       CASE country WHEN 'US' THEN 'United States' WHEN 'CN' THEN 'China' WHEN 'unknown' THEN 'Unknown'
                    WHEN 'ES' THEN 'Europe' WHEN 'FR' THEN 'Europe' WHEN 'GB' THEN 'Europe' WHEN 'NL' THEN 'Europe'
                    WHEN 'DE' THEN 'Europe' WHEN 'CH' THEN 'Europe' WHEN 'PL' THEN 'Europe' WHEN 'FI' THEN 'Europe'
                    WHEN 'CZ' THEN 'Europe' ELSE 'Rest of World' END AS region,
       CAST(SUM(dl) AS BIGINT) AS dl, CAST(SUM(n) AS BIGINT) AS n
FROM cs GROUP BY 1, 2
""", COUNTRY_CTE, _CSTATS)

# --- hubs and user-facing queries -----------------------------------------------------

_ACC_CTES = ("acc AS (" + _BY_ACCOUNT.format(src="panel") + ")",
             "macc AS (" + _BY_ACCOUNT.format(src="mpanel") + ")")
_CB = """
cbd AS (SELECT snapshot_date FROM acc INTERSECT SELECT snapshot_date FROM macc),
cbg AS (SELECT snapshot_date, author, CAST(SUM(dl) AS BIGINT) AS dl, CAST(SUM(lk) AS BIGINT) AS lk,
               CAST(SUM(dlat) AS BIGINT) AS dlat, CAST(SUM(n) AS BIGINT) AS n
        FROM (SELECT snapshot_date, author, dl, lk, dlat, n FROM acc
              UNION ALL SELECT snapshot_date, author, dl, lk, dlat, n FROM macc)
        WHERE snapshot_date IN (SELECT snapshot_date FROM cbd) GROUP BY 1, 2),
cb AS (SELECT g.*, s.t FROM cbg g JOIN (SELECT snapshot_date, CAST(row_number() OVER (ORDER BY snapshot_date) - 1 AS INTEGER) AS t
                                       FROM (SELECT DISTINCT snapshot_date FROM cbg)) s ON s.snapshot_date = g.snapshot_date)
"""
register("combined_hubs", "SELECT snapshot_date, author, dl, lk, dlat, n, t FROM cb", MODELS_CTES, *_ACC_CTES, _CB)

register("aligned_dates", """
SELECT snapshot_date, 'inner' AS how FROM (SELECT snapshot_date FROM panel INTERSECT SELECT snapshot_date FROM mpanel)
UNION ALL
SELECT snapshot_date, 'outer' AS how FROM (SELECT snapshot_date FROM panel UNION SELECT snapshot_date FROM mpanel)
""", MODELS_CTES)

register("account_totals", """
SELECT snapshot_date, CAST(COALESCE(SUM(dl), 0) AS BIGINT) AS dl, CAST(COALESCE(SUM(lk), 0) AS BIGINT) AS lk,
       CAST(SUM(dlat) AS BIGINT) AS dlat, CAST(COALESCE(SUM(n), 0) AS BIGINT) AS n_repo, COUNT(*) AS n_auth
FROM acc GROUP BY 1
""", _ACC_CTES[0])


def _pool(acc: str, n: int) -> str:
    return f"""(
SELECT author FROM (SELECT author, row_number() OVER (PARTITION BY snapshot_date ORDER BY dl DESC, author) AS r FROM {acc}) WHERE r <= {n}
UNION
SELECT author FROM (SELECT author, row_number() OVER (PARTITION BY snapshot_date ORDER BY dlat DESC, author) AS r FROM {acc}
                    WHERE snapshot_date IN (SELECT snapshot_date FROM {acc} GROUP BY 1 HAVING SUM(dlat) <> 0)) WHERE r <= {n}
UNION
SELECT author FROM (SELECT author, row_number() OVER (PARTITION BY snapshot_date ORDER BY lkd DESC, author) AS r
                    FROM (SELECT snapshot_date, author, lk - LAG(lk) OVER w AS lkd, t - LAG(t) OVER w AS dt
                          FROM {acc} WINDOW w AS (PARTITION BY author ORDER BY t)) WHERE dt = 1) WHERE r <= {n})"""


register("volume_proxy", f"""
SELECT per.snapshot_date, per.author, per.bytes, hub.hub_bytes, hub.dl_cov
FROM (SELECT snapshot_date, author, CAST(SUM(CAST(downloads AS DECIMAL(20,0)) * CAST(mainSize AS DECIMAL(20,2))) AS DECIMAL(38,2)) AS bytes
      FROM panel WHERE author IS NOT NULL AND downloads IS NOT NULL AND mainSize IS NOT NULL
        AND author IN {_pool('acc', 5)}
      GROUP BY 1, 2) per
JOIN (SELECT snapshot_date,
             CAST(COALESCE(SUM(CASE WHEN author IS NOT NULL AND downloads IS NOT NULL AND mainSize IS NOT NULL
                               THEN CAST(downloads AS DECIMAL(20,0)) * CAST(mainSize AS DECIMAL(20,2)) END), 0) AS DECIMAL(38,2)) AS hub_bytes,
             CAST(COALESCE(SUM(CASE WHEN author IS NOT NULL AND downloads IS NOT NULL AND mainSize IS NOT NULL THEN downloads END), 0)::DOUBLE
                  / greatest(1, COALESCE(SUM(downloads), 0)) AS DECIMAL(20,6)) AS dl_cov
      FROM panel GROUP BY 1) hub ON hub.snapshot_date = per.snapshot_date
WHERE per.bytes > 0
""", _ACC_CTES[0])


def _series(mode: str, acc: str) -> str:
    return f"""
SELECT '{mode}' AS mode, a.snapshot_date, a.author, {_round_sig('a.dl')} AS dl, a.lk, a.n,
       CASE WHEN h.hd <> 0 THEN {_round_sig('a.dlat')} END AS dlat
FROM {acc} a JOIN (SELECT snapshot_date, SUM(dlat) AS hd FROM {acc} GROUP BY 1) h ON h.snapshot_date = a.snapshot_date
WHERE a.author IN {_pool(acc, 5)}"""


register("account_series", " UNION ALL ".join([_series("ds", "acc"), _series("md", "macc"), _series("cb", "cb")]),
         MODELS_CTES, *_ACC_CTES, _CB)

register("explore", f"""
SELECT snapshot_date, _id, id, downloads, rk FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY snapshot_date ORDER BY downloads DESC, _id) AS INTEGER) AS rk
  FROM panel WHERE list_has_any({_TOPICS}, ['household', 'machinery']) AND downloads >= 100000 AND downloads IS NOT NULL)
WHERE rk <= 20
""")

register("explore_growth", f"""
SELECT snapshot_date, _id, id, growth, rk FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY snapshot_date ORDER BY growth DESC, _id) AS INTEGER) AS rk
  FROM (SELECT *, downloadsAllTime - first_value(downloadsAllTime IGNORE NULLS) OVER (PARTITION BY _id ORDER BY t
                   ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS growth
        FROM panel)
  WHERE list_has_any({_TOPICS}, ['household']) AND growth >= 1 AND growth IS NOT NULL)
WHERE rk <= 20
""")

register("rank_modes", """
SELECT mode, metric, snapshot_date, author, v, CAST(rk AS INTEGER) AS rk FROM (
  SELECT *, row_number() OVER (PARTITION BY mode, metric, snapshot_date ORDER BY v DESC, author) AS rk
  FROM (SELECT mode, 'dl' AS metric, snapshot_date, author, dl AS v FROM modes
        UNION ALL SELECT mode, 'dlat', snapshot_date, author, dlat FROM modes
        UNION ALL SELECT mode, 'lkd', snapshot_date, author, lkd FROM (
            SELECT mode, snapshot_date, author, lk - LAG(lk) OVER w AS lkd, t - LAG(t) OVER w AS dt
            FROM modes WINDOW w AS (PARTITION BY mode, author ORDER BY t)) WHERE dt = 1)
  WHERE v IS NOT NULL)
WHERE rk <= 5
""", MODELS_CTES, *_ACC_CTES, _CB, """
modes AS (SELECT 'ds' AS mode, snapshot_date, author, dl, lk, dlat, n, t FROM acc
          UNION ALL SELECT 'md', snapshot_date, author, dl, lk, dlat, n, t FROM macc
          UNION ALL SELECT 'cb', snapshot_date, author, dl, lk, dlat, n, t FROM cb)""")

_RANKED = """
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY snapshot_date ORDER BY dl DESC, author) AS INTEGER) AS rk
               FROM {acc}) WHERE rk <= {n}
"""
register("rank_accounts", "SELECT * EXCLUDE (t) FROM (" + _RANKED.format(acc="acc", n=5) + ")", _ACC_CTES[0])

register("top_share", """
SELECT t.snapshot_date, CAST(p.top AS BIGINT) AS top, CAST(t.total AS BIGINT) AS total,
       CAST(CASE WHEN t.total = 0 THEN NULL ELSE p.top::DOUBLE / t.total END AS DECIMAL(20,6)) AS share
FROM (SELECT snapshot_date, SUM(dl) AS total FROM acc GROUP BY 1) t
JOIN (SELECT snapshot_date, SUM(dl) AS top FROM (""" + _RANKED.format(acc="acc", n=5) + """) GROUP BY 1) p
  ON p.snapshot_date = t.snapshot_date
""", _ACC_CTES[0])


def _by_group(src: str, group: str) -> str:
    return f"""
SELECT snapshot_date, {group}, accounts, repos, value,
       CAST(CASE WHEN SUM(repos) OVER w = 0 THEN NULL ELSE repos::DOUBLE / SUM(repos) OVER w END AS DECIMAL(20,6)) AS repo_share,
       CAST(CASE WHEN SUM(value) OVER w = 0 THEN NULL ELSE value::DOUBLE / SUM(value) OVER w END AS DECIMAL(20,6)) AS value_share
FROM (SELECT snapshot_date, {group}, COUNT(*) AS accounts, CAST(SUM(n) AS BIGINT) AS repos, CAST(SUM(dl) AS BIGINT) AS value
      FROM ({src}) GROUP BY 1, 2)
WINDOW w AS (PARTITION BY snapshot_date)
"""


register("cohort_country", _by_group("SELECT r.*, COALESCE(k.country, 'unknown') AS country FROM ("
                                     + _RANKED.format(acc="acc", n=10) + ") r LEFT JOIN countries_known k ON k.account = r.author",
                                     "country"), COUNTRY_CTE, _ACC_CTES[0])

register("topn_sankey", _by_group(_RANKED.format(acc="racc", n=10), "org_type"), ORGS_CTE,
         "racc AS (" + _BY_ACCOUNT.format(src="pr") + ")")

register("donut", """
SELECT sh.*, COALESCE(tp.top3, '') AS top3 FROM (""" + _SHARES.format(m="downloads").replace("WHERE ty.org_type <> 'individual'", "")
         .replace("FROM pb GROUP BY", "FROM pr GROUP BY") + """) sh
LEFT JOIN (SELECT snapshot_date, org_type,
                  COALESCE(string_agg(COALESCE(author, '') || '=' || CAST(val AS VARCHAR), ',' ORDER BY rk)
                           FILTER (WHERE rk <= 3 AND val <> 0), '') AS top3
           FROM (SELECT *, row_number() OVER (PARTITION BY snapshot_date, org_type ORDER BY val DESC, author NULLS LAST) AS rk
                 FROM (SELECT snapshot_date, org_type, author, CAST(COALESCE(SUM(downloads), 0) AS BIGINT) AS val
                       FROM pr GROUP BY 1, 2, 3))
           GROUP BY 1, 2) tp ON tp.snapshot_date = sh.snapshot_date AND tp.org_type = sh.org_type
""", ORGS_CTE)

def _hist_text(key: str, col: str, edges) -> str:
    return f"""LEFT JOIN (SELECT snapshot_date, string_agg(CAST(bin AS VARCHAR) || ':' || CAST(c AS VARCHAR), '|' ORDER BY bin) AS {key}
                      FROM ({_hist(key, col, edges)}) WHERE author = 'NATION_1' GROUP BY 1) t_{key}
  ON t_{key}.snapshot_date = a.snapshot_date
"""


register("drill_down", """
SELECT a.snapshot_date, a.author, a.dl, a.lk, a.dlat, a.n, a.org_type, hs, hl, hd
FROM acc a """ + _hist_text("hs", "mainSize", [10.0 ** k for k in range(3, 13)])
         + _hist_text("hl", "likes", [1, 10, 100, 1000, 10000])
         + _hist_text("hd", "downloadsAllTime", [1, 10, 100, 1000, 10000, 100000, 1000000]) + """
WHERE a.author = 'NATION_1'
""", _ACC_CTES[0])

register("tooltip_share", _SHARES.format(m="downloadsAllTime").replace(
    "WHERE ty.org_type <> 'individual'", "WHERE ty.org_type NOT IN ('individual', 'classroom', 'government')"))

register("filtered_ranking", """
SELECT snapshot_date, org_type, COUNT(*) AS n, COUNT(*) < 10 AS thin
FROM pb WHERE org_type NOT IN ('individual') AND downloadsAllTime IS NOT NULL AND likes >= 2
GROUP BY 1, 2
""")

register("left_enrich", """
SELECT p.snapshot_date, p._id, p.author, o.csv_type, o.followers
FROM panel p LEFT JOIN orgs o ON o.author = p.author
""", ORGS_CTE)

register("country_join", """
SELECT a.snapshot_date, a.author, a.dl, COALESCE(k.country, 'unknown') AS country
FROM acc a LEFT JOIN countries_known k ON k.account = a.author
""", COUNTRY_CTE, _ACC_CTES[0])

register("snapshot_every_nth", """
SELECT snapshot_date FROM (
  SELECT snapshot_date, row_number() OVER (ORDER BY snapshot_date) - 1 AS i, COUNT(*) OVER () AS n
  FROM _s WHERE snapshot_date >= DATE '1996-01-01')
WHERE i % 7 = 0 OR i = n - 1
""")

register("slim_enriched", """
SELECT p.snapshot_date, p._id, p.id, p.author, array_to_string(COALESCE(p.tags, CAST([] AS VARCHAR[])), '|') AS tags,
       p.likes, p.downloads, p.downloadsAllTime, p.mainSize, o.csv_type AS org_type
FROM panel p LEFT JOIN orgs o ON o.author = p.author
""", ORGS_CTE)


def _cov(name: str, e: str) -> str:
    return (f"COUNT(*) FILTER (WHERE {e}) AS n_{name}, "
            f"CAST(AVG(CASE WHEN COALESCE({e}, FALSE) THEN 1.0 ELSE 0.0 END) AS DECIMAL(20,6)) AS share_{name}")


register("coverage_profile", f"""
SELECT snapshot_date, COUNT(*) AS n,
       {_cov('tags', "len(COALESCE(tags, CAST([] AS VARCHAR[]))) > 0")},
       {_cov('paper', "COALESCE(len(list_filter(tags, lambda x: starts_with(x, 'arxiv:'))) > 0, FALSE)")},
       {_cov('dlat', 'downloadsAllTime IS NOT NULL')}, {_cov('size', 'mainSize > 0')}
FROM panel GROUP BY 1
""")

def _parse_count(tok: str) -> str:
    t = f"replace(trim({tok}), ',', '')"
    num = f"regexp_extract({t}, '^([0-9.]+)\\s*([kKmM]?)', 1)"
    suf = f"lower(regexp_extract({t}, '^([0-9.]+)\\s*([kKmM]?)', 2))"
    return (f"CASE WHEN {num} = '' THEN 0 ELSE COALESCE(TRY_CAST(round_even(TRY_CAST({num} AS DECIMAL(30,8)) * "
            f"CASE {suf} WHEN 'k' THEN 1000 WHEN 'm' THEN 1000000 ELSE 1 END, 0) AS BIGINT), 0) END")


def _vis(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace({x}, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g'))"


_FOL = "regexp_extract(txt, '(?i)([\\d.,]+\\s*[km]?)\\s*followers?\\b', 1)"
_MOD = "regexp_extract(txt, '(?i)([\\d.,]+\\s*[km]?)\\s*models?\\b', 1)"
register("page_cards", f"""
SELECT slug, org_type, model_count, followers, badge
FROM (
  SELECT page_id, pos, substr(href, 2) AS slug,
         NULLIF(lower({_vis("regexp_extract(a, '(?s)<span[^>]*class=\"[^\"]*\\bcapitalize\\b[^\"]*\"[^>]*>(.*?)</span>', 1)")}), '') AS org_type,
         CASE WHEN {_MOD} <> '' THEN {_parse_count(_MOD)} ELSE CAST(0 AS BIGINT) END AS model_count,
         CAST({_parse_count(_FOL)} AS BIGINT) AS followers,
         NULLIF({_vis("regexp_extract(a, '(?s)<span[^>]*class=\"[^\"]*-skew-x-12[^\"]*\"[^>]*>(.*?)</span>', 1)")}, '') AS badge
  FROM (SELECT page_id, generate_subscripts(l, 1) - 1 AS pos, unnest(l) AS a
        FROM (SELECT page_id, regexp_extract_all(html, '(?s)(<a\\s[^>]*>.*?</a>)', 1) AS l FROM listing)),
       LATERAL (SELECT regexp_extract(a, 'href="([^"]*)"', 1) AS href, {_vis('a')} AS txt)
  WHERE starts_with(href, '/') AND NOT contains(substr(href, 2), '/') AND {_FOL} <> '')
QUALIFY row_number() OVER (PARTITION BY slug ORDER BY page_id, pos) = 1
""", """
listing AS (
  SELECT page_id, html FROM pages UNION ALL
  SELECT s_suppkey + 1000000000,
         '<html><body><a class="c" href="/org-' || s_nationkey || '"><h4>' || s_name || '</h4>'
         || CASE s_suppkey % 3 WHEN 1 THEN '<span class="x capitalize">Company</span>'
                               WHEN 2 THEN '<span class="x capitalize">university</span>' ELSE '' END
         || CASE WHEN s_suppkey % 5 = 0 THEN '<span class="a -skew-x-12">Team</span>' ELSE '' END || ' <b>'
         || CASE WHEN s_suppkey % 7 <> 0 THEN (s_suppkey % 50) || ' models' ELSE '' END || '</b>' || chr(10) || '<i>'
         || CASE s_suppkey % 4 WHEN 0 THEN (s_suppkey * 37 % 900) || '.' || lpad(CAST(s_suppkey % 100 AS VARCHAR), 2, '0') || 'k followers'
                               WHEN 1 THEN (s_suppkey * 37 % 900) || '.' || lpad(CAST(s_suppkey % 100 AS VARCHAR), 2, '0') || 'M followers'
                               WHEN 2 THEN (s_suppkey % 9 + 1) || ',' || lpad(CAST(s_suppkey * 7 % 1000 AS VARCHAR), 3, '0') || ' followers'
                               ELSE '' END
         || '</i></a><a href="/org-' || s_nationkey || '/repo">repo 9 followers</a></body></html>'
  FROM supplier)
""")


register("size_box", f"""
SELECT c.snapshot_date, c.org_type, c.n_rows, CAST(c.share AS DECIMAL(20,6)) AS share,
       {_near(0.05)} AS p5, {_near(0.25)} AS q1, {_near(0.5)} AS med, {_near(0.75)} AS q3,
       {_near(0.95)} AS p95, {_near(0.99)} AS p99,
       CAST(SUM(v) / COUNT(*) AS DECIMAL(24,6)) AS mean, MAX(v) AS max
FROM (SELECT snapshot_date, org_type, COUNT(*) AS n_rows,
             AVG(CASE WHEN mainSize > 0 THEN 1.0 WHEN mainSize IS NOT NULL THEN 0.0 END) AS share
      FROM pr GROUP BY 1, 2) c
JOIN (SELECT snapshot_date, org_type, mainSize AS v,
             row_number() OVER (PARTITION BY snapshot_date, org_type ORDER BY mainSize) - 1 AS i,
             COUNT(*) OVER (PARTITION BY snapshot_date, org_type) AS n
      FROM pr WHERE mainSize > 0) s
  ON s.snapshot_date = c.snapshot_date AND s.org_type = c.org_type
GROUP BY c.snapshot_date, c.org_type, c.n_rows, c.share
""", ORGS_CTE)

register("distinct_accounts", """
SELECT snapshot_date, org_type, COUNT(DISTINCT author) + MAX(CASE WHEN author IS NULL THEN 1 ELSE 0 END) AS n_accounts
FROM pr GROUP BY 1, 2
""", ORGS_CTE)

register("type_order", """
SELECT org_type, value, CAST(row_number() OVER (ORDER BY value DESC, org_type) AS INTEGER) AS position
FROM (SELECT ty.org_type, CAST(COALESCE(SUM(p.downloadsAllTime), 0) AS BIGINT) AS value
      FROM types ty LEFT JOIN pb p ON p.org_type = ty.org_type AND p.snapshot_date = (SELECT MAX(snapshot_date) FROM pb)
      GROUP BY 1)
""")

register("frozen_diff", """
SELECT snapshot_date, 'unexpected' AS side FROM (SELECT * FROM fz EXCEPT ALL SELECT * FROM known)
UNION ALL
SELECT snapshot_date, 'missing' AS side FROM (SELECT * FROM known EXCEPT ALL SELECT * FROM fz)
""", "fz AS (SELECT snapshot_date FROM (" + _FROZEN.format(src="panel") + ") WHERE frozen)",
         """known AS (SELECT CAST(d AS DATE) AS snapshot_date FROM (VALUES ('2024-08-07'), ('2025-07-02'), ('2025-11-12'),
          ('2025-11-19'), ('2026-04-08'), ('2026-05-27'), ('2026-06-03')) v(d))""")

register("entity_topics", f"""
SELECT l._id, l.id, o.org_type, COALESCE(t.ids, '') AS topic_ids
FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY _id ORDER BY t DESC) AS rn FROM panel) WHERE rn = 1) l
LEFT JOIN (SELECT _id, arg_max(org_type, t) AS org_type FROM panel WHERE org_type IS NOT NULL GROUP BY 1) o ON o._id = l._id
LEFT JOIN (SELECT _id, string_agg(CAST(idx AS VARCHAR), ',' ORDER BY idx) AS ids
           FROM (SELECT DISTINCT x._id, v.idx
                 FROM (SELECT _id, unnest({_TOPICS}) AS topic
                       FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY _id ORDER BY t DESC) AS rn FROM panel)
                             WHERE rn = 1)) x
                 JOIN vocab v ON v.topic = x.topic)
           GROUP BY 1) t ON t._id = l._id
""", f"tc AS ({_VOCAB_COUNTS})", f"vocab AS ({_VOCAB})")

SQL["topn_accounts_count"] = SQL["topn_accounts"].replace(
    "CAST(COALESCE(SUM(downloads), 0) AS BIGINT) AS val", "COUNT(*) AS val")

_BYTES = "szr AS (SELECT *, log10(CAST(mainSize AS DOUBLE)) AS x FROM pr WHERE mainSize > 0)"
register("size_stats_bytes", f"""
SELECT snapshot_date, org_type, COUNT(*) AS cnt, CAST(AVG(x) AS DECIMAL(20,6)) AS u_m,
       CAST(stddev_pop(x) AS DECIMAL(20,6)) AS u_s,
       {_wstat('dl', 'downloads')}, {_wstat('lk', 'likes')}, {_wstat('dlat', 'downloadsAllTime')}
FROM szr GROUP BY 1, 2
""", ORGS_CTE, _BYTES)

register("bucket_stats_bytes", """
SELECT snapshot_date, variant, metric, bkt, org_type, c, CAST(sx AS DECIMAL(24,1)) AS sx, CAST(sx2 AS DECIMAL(24,1)) AS sx2,
       CAST(sw AS DECIMAL(24,1)) AS sw, CAST(swx AS DECIMAL(24,1)) AS swx, CAST(swx2 AS DECIMAL(24,1)) AS swx2
FROM bs
""", ORGS_CTE, _BYTES, _RANKS_BKT)

register("org_pool", """
SELECT author, CAST(SUM(a) AS BIGINT) AS top_n, CAST(SUM(b) AS BIGINT) AS type_top
FROM (SELECT author, 1 AS a, 0 AS b
      FROM (SELECT *, row_number() OVER (PARTITION BY snapshot_date, metric ORDER BY v DESC, author NULLS LAST) AS rk
            FROM (SELECT snapshot_date, author, metric, SUM(v) AS v FROM st GROUP BY 1, 2, 3)) WHERE rk <= 2
      UNION ALL
      SELECT author, 0, 1
      FROM (SELECT *, row_number() OVER (PARTITION BY snapshot_date, org_type, metric ORDER BY v DESC, author NULLS LAST) AS rk
            FROM st WHERE v <> 0) WHERE rk <= 3)
WHERE author IS NOT NULL GROUP BY 1
""", ORGS_CTE, """st AS (
  SELECT snapshot_date, org_type, author, m.metric,
         CASE m.metric WHEN 'dl' THEN dl WHEN 'lk' THEN lk WHEN 'n' THEN n ELSE COALESCE(dlat, 0) END AS v
  FROM (SELECT snapshot_date, org_type, author, SUM(downloads) AS dl, SUM(likes) AS lk, COUNT(*) AS n,
               SUM(downloadsAllTime) AS dlat FROM pr GROUP BY 1, 2, 3)
       CROSS JOIN (VALUES ('dl'), ('lk'), ('n'), ('dlat')) m(metric)
  WHERE m.metric <> 'dlat' OR snapshot_date IN (SELECT snapshot_date FROM panel WHERE downloadsAllTime IS NOT NULL))""")

register("trimmed_series", """
SELECT a._id, a.metric, CAST(a.t AS INTEGER) AS t, l.value
FROM (SELECT _id, metric, unnest(range(MIN(t), MAX(t) + 1)) AS t FROM lg GROUP BY 1, 2) a
LEFT JOIN lg l ON l._id = a._id AND l.metric = a.metric AND l.t = a.t
""", """lg AS (SELECT _id, 'downloads' AS metric, t, downloads AS value FROM panel WHERE downloads IS NOT NULL
       UNION ALL SELECT _id, 'downloadsAllTime', t, downloadsAllTime FROM panel WHERE downloadsAllTime IS NOT NULL)""")

register("first_tracked", """
SELECT 'downloads' AS metric, MIN(t) AS t FROM panel WHERE downloads IS NOT NULL
UNION ALL SELECT 'likes', MIN(t) FROM panel WHERE likes IS NOT NULL
UNION ALL SELECT 'downloadsAllTime', MIN(t) FROM panel WHERE downloadsAllTime IS NOT NULL
""")


def _sig_float(x: str, sig: int) -> str:
    x = f"CAST({x} AS DOUBLE)"
    unit = f"pow(10.0::DOUBLE, floor(log10(abs({x}))) - {sig - 1})"
    return f"(CASE WHEN {x} IS NULL OR {x} = 0 THEN {x} ELSE round_even({x} / {unit}, 0) * {unit} END)"


SQL["volume_rounded"] = f"""
SELECT snapshot_date, author, CAST({_sig_float('hub_bytes', 4)} AS DECIMAL(38,2)) AS hub_bytes,
       CAST({_sig_float('bytes', 3)} AS DECIMAL(38,2)) AS bytes, CAST({_sig_float('dl_cov', 4)} AS DECIMAL(20,6)) AS dl_cov
FROM ({SQL['volume_proxy']})
"""

register("volume_share", """
SELECT h.snapshot_date, h.hub_bytes, t.top_bytes,
       CAST(CASE WHEN h.hub_bytes = 0 THEN NULL ELSE t.top_bytes::DOUBLE / h.hub_bytes::DOUBLE END AS DECIMAL(20,6)) AS share
FROM (SELECT snapshot_date, CAST(SUM(bytes) AS DECIMAL(38,2)) AS hub_bytes FROM va GROUP BY 1) h
LEFT JOIN (SELECT snapshot_date, CAST(SUM(bytes) AS DECIMAL(38,2)) AS top_bytes
           FROM (SELECT *, row_number() OVER (PARTITION BY snapshot_date ORDER BY dl DESC, author) AS rk FROM va
                 WHERE author IS NOT NULL)
           WHERE rk <= 5 AND bytes > 0 GROUP BY 1) t ON t.snapshot_date = h.snapshot_date
""", """va AS (SELECT snapshot_date, author, SUM(downloads) AS dl,
       SUM(CASE WHEN author IS NOT NULL THEN CAST(downloads AS DECIMAL(20,0)) * CAST(mainSize AS DECIMAL(20,2)) END) AS bytes
       FROM panel GROUP BY 1, 2)""")

register("explore_paper", " UNION ALL ".join(f"""
SELECT '{m}' AS metric, snapshot_date, _id, id, {m} AS value, rk FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY snapshot_date ORDER BY {m} DESC, _id) AS INTEGER) AS rk
  FROM panel WHERE len(list_filter(tags, lambda x: starts_with(x, 'arxiv:'))) > 0 AND {m} >= 2)
WHERE rk <= 20""" for m in ("likes", "downloadsAllTime")))

_LAST_FULL = "(SELECT MAX(snapshot_date) FROM panel WHERE snapshot_date < (SELECT MAX(snapshot_date) FROM panel))"
register("type_orders", f"""
SELECT order_by, org_type, CAST(v AS DECIMAL(24,2)) AS value,
       CAST(row_number() OVER (PARTITION BY order_by ORDER BY v DESC NULLS LAST, org_type) AS INTEGER) AS position
FROM (SELECT 'total' AS order_by, org_type, CAST(SUM(downloads) AS DOUBLE) AS v FROM pr GROUP BY 2
      UNION ALL SELECT 'median', org_type, med FROM ({_box('dlat', 'downloadsAllTime')}) WHERE snapshot_date = {_LAST_FULL}
      UNION ALL SELECT 'weighted_median', org_type, w_med FROM ({_WEIGHTED}) WHERE snapshot_date = {_LAST_FULL})
""", ORGS_CTE)

register("name_order", f"""
SELECT name, CAST(row_number() OVER (ORDER BY lower(name), name) AS INTEGER) AS position
FROM (SELECT author AS name FROM ({_top('acc', 'dl', 'author', 5)})
      UNION SELECT author FROM ({_top('acc', 'lk', 'author', 5)})
      UNION SELECT topic FROM ({_VOCAB}))
""", _ACC_CTES[0], f"tc AS ({_VOCAB_COUNTS})")
