"""DuckDB counterparts of the derived inputs, as named CTEs chained on demand."""

from __future__ import annotations

CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def define(name: str, body: str, *needs: str) -> None:
    CTES[name] = (needs, body)


def sql(final: str, *names: str) -> str:
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for dep in CTES[n][0]:
            visit(dep)
        order.append(n)

    for n in names:
        visit(n)
    chain = ",\n".join(f"{n} AS MATERIALIZED ({CTES[n][1]})" for n in order)
    if final.lstrip().upper().startswith("WITH"):
        final = f"SELECT * FROM ({final})"
    return f"WITH {chain}\n{final}" if chain else final


def r6(expr: str, digits: int = 6) -> str:
    """Rounded, without a negative zero."""
    return f"(round({expr}, {digits}) + 0.0)"


define("steps", """
  SELECT CAST(l_suppkey AS VARCHAR) fund_id, CAST(l_shipdate AS DATE) dt,
         CAST(SUM(CAST(ROUND(l_discount*100) AS BIGINT)) - 5*COUNT(*) AS BIGINT) step
  FROM lineitem GROUP BY 1, 2""")
define("nav_k", """
  SELECT fund_id, dt, 100.0*EXP((CAST(SUM(step) OVER w AS DOUBLE)*3 + ROW_NUMBER() OVER w)/1000.0) nav,
         ROW_NUMBER() OVER w k
  FROM steps WINDOW w AS (PARTITION BY fund_id ORDER BY dt)""", "steps")
define("nav", "SELECT fund_id, dt, nav FROM nav_k", "nav_k")
define("dirty", """
  SELECT fund_id, dt,
         nav * CASE WHEN (CAST(fund_id AS BIGINT)*31 + k) % 97 = 0 THEN 1.13::DOUBLE ELSE 1.0::DOUBLE END
             * CASE WHEN CAST(fund_id AS BIGINT) % 10 = 3 AND k > 200 THEN 0.94::DOUBLE ELSE 1.0::DOUBLE END nav,
         CAST(fund_id AS BIGINT) % 10 = 3 is_payout_plan
  FROM nav_k""", "nav_k")
define("ret", """
  SELECT * FROM (SELECT fund_id, dt, nav, nav/LAG(nav) OVER (PARTITION BY fund_id ORDER BY dt) - 1 r FROM nav)
  WHERE r IS NOT NULL""", "nav")
define("manifest", """
  SELECT CAST(s_suppkey AS VARCHAR) fund_id, 'Fund ' || s_name scheme_name, n_name amc, r_name region,
         CASE WHEN r_name IN ('AFRICA','EUROPE') THEN 'Sectoral/Thematic' ELSE r_name END category,
         CASE WHEN r_name IN ('AFRICA','EUROPE') THEN n_name END sector
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
define("months", """
  SELECT last_day(CAST(m AS DATE)) anchor
  FROM generate_series(TIMESTAMP '1996-01-01', TIMESTAMP '1998-10-01', INTERVAL 1 MONTH) g(m)""")
define("pairs", "SELECT CAST(s_suppkey AS VARCHAR) fund_id, anchor FROM supplier, months", "months")
define("bench", """
  SELECT name, dt, 100.0*EXP((CAST(SUM(step) OVER w AS DOUBLE)*3 + ROW_NUMBER() OVER w)/1000.0) AS level
  FROM (SELECT region name, dt, CAST(floor(SUM(step)/10.0) AS BIGINT) step
        FROM steps JOIN manifest USING (fund_id) WHERE region <> 'MIDDLE EAST' GROUP BY 1, 2
        UNION ALL
        SELECT 'ALL', dt, CAST(floor(SUM(step)/10.0) AS BIGINT) FROM steps GROUP BY 2)
  WINDOW w AS (PARTITION BY name ORDER BY dt)""", "steps", "manifest")
define("bench_ret", """
  SELECT * FROM (SELECT name, dt, level/LAG(level) OVER (PARTITION BY name ORDER BY dt) - 1 b FROM bench)
  WHERE b IS NOT NULL""", "bench")
define("bench_meta", """
  SELECT name, CASE WHEN name = 'MIDDLE EAST' THEN 'NONE' ELSE 'file' END source,
         CASE WHEN name = 'ASIA' THEN 'PRI' ELSE 'fund_NAV' END return_type
  FROM (SELECT r_name name FROM region UNION ALL SELECT 'ALL')""")
define("joint", """
  SELECT f.fund_id, f.dt, f.r f, x.b b
  FROM ret f JOIN manifest m USING (fund_id) JOIN bench_ret x ON x.name = m.region AND x.dt = f.dt""",
       "ret", "manifest", "bench_ret")
define("holdings", """
  WITH v AS (SELECT l_suppkey, last_day(CAST(date_trunc('quarter', l_shipdate) + INTERVAL 2 MONTH AS DATE)) as_of, l_partkey,
                    SUM(CAST(ROUND(l_extendedprice*100) AS BIGINT)) v
             FROM lineitem GROUP BY 1, 2, 3),
       t AS (SELECT l_suppkey, as_of, SUM(v) t FROM v GROUP BY 1, 2)
  SELECT CAST(l_suppkey AS VARCHAR) fund_id, as_of, CAST(l_partkey AS VARCHAR) instrument,
         CAST(v AS DOUBLE)/CAST(t AS DOUBLE) weight,
         CASE p_type WHEN 'PROMO' THEN 'debt' WHEN 'STANDARD' THEN 'cash' ELSE 'equity' END asset_type,
         p_brand sector, CASE WHEN p_size <= 16 THEN 'large' WHEN p_size <= 33 THEN 'mid' ELSE 'small' END cap_band,
         ['SOV','AAA','AA+','AA','A+','BBB','UNRATED','D'][l_partkey % 8 + 1] rating,
         CASE WHEN l_partkey % 3 = 0 THEN 'GROUP' || CAST(l_partkey % 5 AS VARCHAR) END corporate_group,
         CASE WHEN l_partkey % 11 <> 0 THEN p_retailprice END market_cap_cr,
         CASE WHEN l_partkey % 7 <> 0 THEN CAST(p_size AS DOUBLE)/4 + 1 END adv_cr,
         CASE WHEN l_partkey % 6 <> 0 THEN CAST(p_size AS DOUBLE)/10 END modified_duration,
         CASE WHEN l_partkey % 4 = 0 THEN CAST(p_size AS DOUBLE)/9 END macaulay_duration,
         CASE WHEN l_partkey % 5 <> 0 THEN CAST(p_size AS DOUBLE)/1000 END ytm,
         l_partkey % 9 = 0 is_hedged
  FROM v JOIN t USING (l_suppkey, as_of) JOIN part ON l_partkey = p_partkey""")
define("books", """
  WITH v AS (SELECT l_orderkey, l_suppkey, SUM(CAST(ROUND(l_extendedprice*100) AS BIGINT)) v FROM lineitem GROUP BY 1, 2),
       t AS (SELECT l_orderkey, SUM(v) t FROM v GROUP BY 1)
  SELECT CAST(l_orderkey AS VARCHAR) fund_id, DATE '2001-11-01' as_of, CAST(l_suppkey AS VARCHAR) instrument,
         CAST(v AS DOUBLE)/CAST(t AS DOUBLE) weight,
         CASE WHEN l_suppkey % 4 = 0 THEN 'debt' ELSE 'equity' END asset_type,
         'S' || CAST(l_suppkey % 7 AS VARCHAR) sector
  FROM v JOIN t USING (l_orderkey)""")
define("dweights", """
  WITH v AS (SELECT l_suppkey, CAST(l_shipdate AS DATE) dt, p_brand, SUM(CAST(ROUND(l_extendedprice*100) AS BIGINT)) v
             FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3),
       t AS (SELECT l_suppkey, dt, SUM(v) t FROM v GROUP BY 1, 2)
  SELECT CAST(l_suppkey AS VARCHAR) fund_id, dt, p_brand ticker, CAST(v AS DOUBLE)/CAST(t AS DOUBLE) weight
  FROM v JOIN t USING (l_suppkey, dt)""")
