"""DuckDB statements that state each query's result independently.

Base tables are common table expressions in integer cents; every statement pulls in only
the expressions it names. Formulations differ from the Spark side on purpose: windows where
Spark aggregates, self-joins where Spark folds, range frames where Spark cuts time buckets.
"""

from __future__ import annotations

import re

NOW = "TIMESTAMP '2024-01-04 00:00:00'"
T0 = 1704067200000
NOW_S = 1704326400


def ago(**parts: int) -> str:
    return " - ".join([NOW, *[f"INTERVAL {n} {unit.upper()}" for unit, n in parts.items()]])


def six(expr: str, name: str) -> str:
    return f"floor(({expr})::DOUBLE * 1e6 + 0.5) / 1e6 AS {name}"


def big(expr: str, name: str) -> str:
    return f"({expr})::BIGINT AS {name}"


def dollars(cents: str, name: str) -> str:
    return six(f"({cents}) / 100", name)


def sku(key: str) -> str:
    return f"'SKU-' || lpad(({key})::VARCHAR, 12, '0')"


def before(seconds: str) -> str:
    return f"make_timestamp((({NOW_S} - ({seconds})) * 1000000)::BIGINT)"


def ratio13(part: str, base: str) -> str:
    """part / base at 13 decimals, half up, as an integer."""
    return (
        f"(sign({part}) * ((abs({part})::HUGEINT * 20000000000000 + ({base})) // (2 * ({base})::HUGEINT)))::HUGEINT"
    )


def hundredths(q: str, limit: int) -> str:
    """A 13-decimal ratio as hundredths of a percent, NULL past the column's precision."""
    h = f"(sign({q}) * ((abs({q}) * 2 + 1000000000) // 2000000000))"
    return f"CASE WHEN abs({h}) < {limit} THEN {h}::BIGINT END"


def pct_text(q: str) -> str:
    """A 13-decimal ratio times 100, written with 13 decimals."""
    return f"(({q}) // 100000000000)::VARCHAR || '.' || lpad((({q}) % 100000000000)::VARCHAR, 11, '0') || '00'"


def label_case(high: str, medium: str, other: str) -> str:
    return f"CASE label WHEN 'high' THEN {high} WHEN 'medium' THEN {medium} ELSE {other} END"


def half_up(expr: str, digits: int) -> str:
    return f"CAST(CAST(({expr}) AS VARCHAR) AS DECIMAL(18,{digits}))"


ROLL5 = "time_bucket(INTERVAL 5 MINUTE, {}, TIMESTAMP '2024-01-01 00:00:00')"


def win5(ts: str) -> str:
    return ROLL5.format(ts)


CTE: dict[str, str] = {}

CTE["product"] = f"""
SELECT {sku('k')} AS sku, k, name, category, brand, cents, cents * 80 // 100 AS cost_c,
       CASE WHEN k % 3 <> 0 THEN cents * 85 // 100 END AS floor_c,
       CASE size % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' WHEN 2 THEN 'low' END AS label,
       CASE WHEN k % 4 <> 3 THEN (0 - (k % 4) * 6) / 10 END AS elasticity,
       CASE WHEN size % 4 < 3 THEN {before('(k % 48) * 3600')} END AS label_at,
       size % 200 AS label_n, size % 10 <> 0 AS stocked, size % 13 <> 0 AS live,
       TIMESTAMP '2023-12-01 00:00:00' AS created_at,
       CASE WHEN k % 2 <> 0 THEN {before('(k % 30) * 86400')} END AS updated_at
FROM (SELECT p_partkey // 10 AS k, sum(round(p_retailprice * 100)::BIGINT)::BIGINT // count(*) AS cents,
             sum(p_size)::BIGINT AS size, arg_max(p_name, p_partkey) AS name,
             arg_max(p_type, p_partkey) AS category, arg_max(p_brand, p_partkey) AS brand
      FROM part GROUP BY 1)"""

CTE["rival"] = """
SELECT id, name, CASE WHEN id = 4 THEN 'chain-' || lower(name) ELSE lower(name) END AS code,
       TIMESTAMP '2023-11-01 00:00:00' AS created_at
FROM (SELECT s_suppkey % 5 AS id, min(s_name) AS name FROM supplier GROUP BY 1)"""

CTE["quote"] = f"""
SELECT p.sku, 'Supplier#' || lpad((l_suppkey % 5)::VARCHAR, 9, '0') AS rival_name,
       p.cents * (850 + 20 * round(l_discount * 100)::BIGINT + 10 * round(l_tax * 100)::BIGINT + 5 * l_linenumber)
         // 1000 AS price,
       l_returnflag <> 'R' AS stock, l_orderkey::VARCHAR || '-' || l_linenumber::VARCHAR AS src,
       ms + 1000 * l_linenumber AS api_ms, CASE WHEN l_quantity <> 50 THEN ms END AS data_ms,
       epoch_ms(ms + 1000 * l_linenumber + 1000) AS broker_ts,
       epoch_ms(CASE WHEN l_quantity <> 50 THEN ms ELSE ms + 1000 * l_linenumber END) AS tick
FROM (SELECT *, {T0} + 1000 * ((7919 * l_orderkey + 104729 * l_partkey + 31 * l_linenumber) % 259200) AS ms
      FROM lineitem) l
JOIN product p ON p.k = l.l_partkey // 10"""

CTE["visit"] = f"""
SELECT {sku('user_id')} AS sku, user_id, event_type, 10 + kk % 20 AS visitors, 100 + kk AS views,
       CASE WHEN event_type <> 'error' THEN (kk * 7) % 60 END AS searches, (kk * 3) % 15 AS carts,
       kk % 5 AS bought, kk % 30 AS compared, value AS dwell, ms + (kk % 30) * 1000 AS api_ms, ms,
       epoch_ms(ms) AS tick
FROM (SELECT *, (props ->> '$.k')::BIGINT AS kk, {T0} + (epoch_us(ts) - {T0 * 1000}) // 10000 AS ms FROM events)"""

CTE["enveloped"] = """
SELECT sku, rival_name, minute, q.price AS price, q.stock AS stock, q.src AS src, q.data_ms AS data_ms, lo, hi, n
FROM (SELECT sku, rival_name, api_ms // 60000 AS minute,
             first({'price': price, 'stock': stock, 'src': src, 'data_ms': data_ms} ORDER BY price, src) AS q,
             min(price) AS lo, max(price) AS hi, count(*) AS n
      FROM quote GROUP BY ALL)"""

CTE["change"] = """
SELECT sku, 'r' AS op, TIMESTAMP '2023-12-31 00:00:00' AS op_ts, cents AS price, 0 AS turn FROM product
UNION ALL
SELECT sku, CASE WHEN NOT stock AND api_ms % 2000 = 0 THEN 'd' ELSE 'u' END, broker_ts,
       CASE WHEN NOT (NOT stock AND api_ms % 2000 = 0) THEN price END,
       CASE WHEN NOT stock AND api_ms % 2000 = 0 THEN 2 ELSE 1 END FROM quote"""

CTE["living"] = """
SELECT c.sku, c.price, c.op_ts
FROM (SELECT *, row_number() OVER (PARTITION BY sku ORDER BY op_ts DESC, turn DESC, price DESC) AS rn FROM change) c
WHERE rn = 1 AND op <> 'd'"""

CTE["unique_quote"] = """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sku, rival_name, data_ms
                                            ORDER BY broker_ts DESC, src DESC, price DESC, stock DESC) AS rn
               FROM quote WHERE data_ms IS NOT NULL) WHERE rn = 1"""

CTE["past"] = """
SELECT u.sku, r.id AS rival_id, u.price, u.stock, u.src, epoch_ms(u.data_ms) AS data_at, epoch_ms(u.api_ms) AS got_at
FROM unique_quote u JOIN rival r ON lower(u.rival_name) = r.code"""

CTE["five"] = f"""
SELECT sku, rival_name, {win5('tick')} AS w, count(*) AS n, sum(price)::HUGEINT AS total,
       sum(price::HUGEINT * price) AS squares, min(tick) AS first_at, max(tick) AS last_at
FROM quote GROUP BY ALL"""

CTE["trend"] = f"""
SELECT f.sku, f.rival_name, f.w, ((((total * 20000 + n) // (2 * n)) * 2 + 10000) // 20000)::BIGINT AS avg_c,
       round(sqrt(greatest(n * squares - total * total, 0)::DOUBLE) / n)::BIGINT AS vol_c, first_at, last_at,
       max(CASE WHEN q.tick = f.first_at THEN q.price END) AS opened,
       max(CASE WHEN q.tick = f.last_at THEN q.price END) AS closed
FROM five f JOIN quote q ON q.sku = f.sku AND q.rival_name = f.rival_name AND {win5('q.tick')} = f.w
GROUP BY ALL"""

CTE["direction"] = """
SELECT *, CASE WHEN closed > opened THEN 'up' WHEN closed < opened THEN 'down' ELSE 'stable' END AS dir FROM trend"""

CTE["low"] = """
SELECT *, min(price) OVER (PARTITION BY sku, rival_name ORDER BY tick
                           RANGE BETWEEN INTERVAL 24 HOUR PRECEDING AND CURRENT ROW) AS low_c FROM quote"""

CTE["known"] = """
SELECT q.*, p.cents AS ours, p.label, p.stocked, p.live, r.id AS rival_id
FROM low q JOIN product p ON p.sku = q.sku JOIN rival r ON lower(q.rival_name) = r.code"""


def signal(kind: str, q: str, texts: tuple[str, str, str], levels: tuple[int, int, int], where: str, source: str = "known") -> str:
    def text(t: str) -> str:
        head, _, tail = t.partition("{}")
        return f"'{head}' || {pct_text('q')} || '{tail}'" if "{}" in t else f"'{t}'"

    return f"""
SELECT sku, rival_id, '{kind}' AS kind, ours, price, {hundredths('q', 100000)} AS gap_h,
       {label_case(*[text(t) for t in texts])} AS advice, {label_case(*map(str, levels))} AS level, stock, tick
FROM (SELECT *, {q} AS q FROM {source}) WHERE {where}"""


OURS = "stocked AND live"
CTE["under"] = signal(
    "UNDERCUT", ratio13("ours - price", "ours"),
    ("URGENT: Competitor undercutting by {}%", "Consider price adjustment: {}% undercut", "Monitor: {}% undercut"),
    (1, 2, 3), "price < ours",
)
CTE["under_strict"] = signal(
    "UNDERCUT", ratio13("ours - price", "ours"),
    ("URGENT: Competitor undercutting by {}%", "Consider price adjustment: {}% undercut", "Monitor: {}% undercut"),
    (1, 2, 3), f"price < ours AND q > 500000000000 AND stock AND {OURS}",
)
CTE["over"] = signal(
    "OVERPRICED", ratio13("price - ours", "ours"),
    ("Opportunity: We are {}% cheaper", "Good position: {}% cheaper", "Competitive: {}% cheaper"),
    (2, 3, 3), f"price > ours AND q > 500000000000 AND stock AND {OURS}",
)
CTE["out"] = signal(
    "STOCKOUT", "0::HUGEINT",
    ("URGENT: Competitor out of stock - opportunity to capture market",
     "Competitor out of stock - consider inventory management", "Competitor out of stock"),
    (1, 2, 3), f"NOT stock AND {OURS}",
)
CTE["rise"] = signal(
    "PRICE_INCREASE_24H", ratio13("price - low_c", "low_c"),
    ("Opportunity: Competitor raised price {}% from 24h low", "Consider adjustment: Competitor up {}% from 24h low",
     "Monitor: Competitor up {}% from 24h low"),
    (2, 3, 3), f"price > low_c AND q > 1000000000000 AND stock AND {OURS} AND tick < {ago(minute=10)}",
)

CTE["live_signal"] = """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sku, rival_id, kind
                                            ORDER BY tick DESC, price DESC, stock DESC) AS rn
               FROM (SELECT * FROM under UNION ALL SELECT * FROM over UNION ALL SELECT * FROM out
                     UNION ALL SELECT * FROM rise)) WHERE rn = 1"""

CTE["move"] = f"""
SELECT sku, rival_id, was, price, q, CASE WHEN price > was THEN 'up' WHEN price < was THEN 'down' ELSE 'no change' END AS dir,
       stock, tick, {hundredths('q', 1000000)} AS change_h
FROM (SELECT m.*, r.id AS rival_id, {ratio13('m.price - m.was', 'm.was')} AS q
      FROM (SELECT *, lag(price) OVER (PARTITION BY sku, rival_name ORDER BY tick, api_ms, src, price) AS was FROM quote) m
      JOIN product p ON p.sku = m.sku AND p.stocked AND p.live
      JOIN rival r ON lower(m.rival_name) = r.code)
WHERE was IS NOT NULL AND abs(q) >= 1000000000000 AND stock"""

CTE["newest"] = """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sku, rival_name
                                            ORDER BY tick DESC, api_ms DESC, src DESC, price DESC) AS rn FROM quote)
WHERE rn = 1"""

CTE["tally"] = """
SELECT sku, count(*) AS rivals, count(*) FILTER (stock) AS stocked_rivals FROM newest GROUP BY sku"""

CTE["cheapest"] = """
SELECT sku, lower(rival_name) AS code, price, tick
FROM (SELECT *, row_number() OVER (PARTITION BY sku ORDER BY price, lower(rival_name)) AS pos FROM newest) WHERE pos = 1"""

CTE["posture"] = f"""
SELECT c.sku, r.id AS rival_id, c.price, p.cents AS ours, t.rivals, t.stocked_rivals,
       {hundredths(ratio13('p.cents - c.price', 'p.cents'), 1000000)} AS gap_h, {NOW} AS tick
FROM cheapest c JOIN tally t ON t.sku = c.sku JOIN rival r ON r.code = c.code JOIN product p ON p.sku = c.sku"""

CTE["shopping"] = f"""
SELECT sku, {win5('tick')} AS w, {win5('tick')} + INTERVAL 5 MINUTE AS w_end, sum(views) AS views, sum(visitors) AS visitors,
       sum(coalesce(searches, 0)) AS searches, sum(carts) AS carts, sum(bought) AS bought, sum(compared) AS compared,
       avg(dwell) AS dwell, sum(coalesce(searches, 0)) / sum(views) AS search_rate
FROM visit GROUP BY ALL"""

CTE["signal_window"] = f"""
SELECT sku, {win5('tick')} AS w, count(*) FILTER (kind = 'UNDERCUT') AS under_n,
       count(*) FILTER (kind = 'PRICE_INCREASE_24H') AS rise_n, count(*) FILTER (kind = 'OVERPRICED') AS over_n,
       {', '.join(f"(sum(gap_h) FILTER (kind = '{k}') * 20000 + count(gap_h) FILTER (kind = '{k}')) // (2 * nullif(count(gap_h) FILTER (kind = '{k}'), 0)) AS {n}_u" for k, n in (('UNDERCUT', 'under'), ('PRICE_INCREASE_24H', 'rise'), ('OVERPRICED', 'over')))}
FROM live_signal GROUP BY ALL"""

CTE["shift"] = """
SELECT c.sku, c.w, c.w_end, c.search_rate,
       (SELECT p.search_rate FROM shopping p WHERE p.sku = c.sku AND p.w_end = c.w) AS prev_rate
FROM shopping c"""

CTE["duel"] = """
SELECT b.sku, b.w, b.w_end, search_rate - coalesce(prev_rate, search_rate) AS delta, coalesce(under_n, 0) AS under_n,
       coalesce(rise_n, 0) AS rise_n, coalesce(over_n, 0) AS over_n,
       (coalesce(under_u, 0) * 2 + 10000) // 20000 AS under_h, (coalesce(rise_u, 0) * 2 + 10000) // 20000 AS rise_h,
       (coalesce(over_u, 0) * 2 + 10000) // 20000 AS over_h,
       CASE WHEN coalesce(under_u, 0) > 0 THEN 'competitor_cheaper' WHEN coalesce(over_u, 0) > 0 THEN 'we_cheaper'
            ELSE 'unknown' END AS stance,
       search_rate - coalesce(prev_rate, search_rate) + coalesce(under_n, 0) * 0.01::DOUBLE AS score
FROM shift b LEFT JOIN signal_window s ON s.sku = b.sku AND s.w = b.w"""

CTE["buyer"] = f"SELECT *, {sku('o_custkey // 10')} AS sku, o_orderkey AS id FROM orders"

CTE["repriced"] = f"""
SELECT b.sku, p.cents AS old_c, p.cents * (95 + id % 10) // 100 AS new_c, id,
       epoch_ms({T0} + ((id * 37) % 4320) * 60000) AS tick FROM buyer b JOIN product p ON p.sku = b.sku"""

CTE["seen"] = f"""
SELECT {sku('o_custkey // 40')} AS sku, {before('(o_orderkey * 7919) % 360000')} AS tick,
       90000 + (o_orderkey % 50) * 200 AS price,
       CASE WHEN o_orderkey % 101 = 0 THEN 0 ELSE 1000 - (o_orderkey % 50) * ((o_custkey // 40) % 5) END AS demand
FROM orders"""

CTE["felt"] = f"""
SELECT sku, e, CASE WHEN e <= -1.0 THEN 'high' WHEN e <= -0.3 THEN 'medium' ELSE 'low' END AS label, n, tick
FROM (SELECT sku, (0 - id % 250) / 100 AS e, 20 + id % 180 AS n, {before('(id % 1000) * 3600')} AS tick FROM buyer)"""

CTE["offer"] = f"""
SELECT o.*, CASE WHEN status = 'approved' AND id % 2 = 0 THEN created + INTERVAL 5 MINUTE END AS approved
FROM (SELECT id, b.sku, p.cents AS now_c,
       CASE WHEN id % 23 = 0 THEN NULL WHEN id % 3 <> 0 THEN p.cents ELSE p.cents * 97 // 100 END AS old_c,
       p.cents * (95 + id % 11) // 100 AS new_c,
       CASE WHEN id % 13 <> 0 THEN (id % 40 - 20) / 8 END AS demand_d,
       CASE WHEN id % 17 <> 0 THEN (id % 90 - 30) / 4 END AS profit_d,
       CASE WHEN id % 2 = 0 THEN -0.01::DOUBLE END AS gap_after, (100 + id % 50)::DOUBLE AS score,
       CASE WHEN id % 2 = 0 THEN 'elasticity+forecast' ELSE 'elasticity-only' END AS reason,
       ['pending', 'approved', 'approved', 'applied', 'rejected'][id % 5 + 1] AS status,
       CASE WHEN id % 4 = 0 THEN {before('(id * 37) % 20160 * 60 - (id % 7 - 3) * 86400')} END AS from_at,
       CASE WHEN id % 6 = 0 THEN {before('(id * 37) % 20160 * 60 - 2 * 86400')} END AS until_at,
       {before('(id * 37) % 20160 * 60')} AS created, CASE WHEN id % 9 = 0 THEN 'seen' END AS notes
      FROM buyer b JOIN product p ON p.sku = b.sku) o"""

CTE["job"] = f"""
SELECT d AS id, {before('d * 3600')} AS started, {before('d * 3600 - 300')} AS finished, d % 2 = 0 AS wide, n, ok
FROM (SELECT date_diff('day', o_orderdate::DATE, DATE '2001-12-31') AS d, count(*) AS n,
             count(*) FILTER (o_orderstatus <> 'F') AS ok FROM orders GROUP BY 1)"""

CTE["quality"] = f"""
SELECT *, greatest(0, 1 - mae / base) AS conf, mae <= 0.5 AND 1 - mae / base >= 0.2::DOUBLE AS good
FROM (SELECT {sku('k')} AS sku, rival_id, n - 5 AS samples, (n % 10) / 10 AS mae, (1 + n % 7) / 10 AS base,
             {before('(k * 5 + rival_id) * 60')} AS tick
      FROM (SELECT l_partkey // 10 AS k, l_suppkey % 5 AS rival_id, count(*) AS n FROM lineitem GROUP BY ALL))"""

CTE["bestof"] = """
SELECT sku, arg_min(rival_id, (pred, rival_id)) AS rival_id, min(pred) AS pred
FROM (SELECT *, 880 + samples + rival_id / 4 AS pred FROM quality WHERE good) GROUP BY sku"""

CTE["hist5"] = f"""
SELECT sku, rival_id, {win5('got_at')} AS w, sum(price) / 100 / count(*) AS avg_p, stddev_samp(price / 100) AS vol
FROM past WHERE got_at > {ago(day=14)} GROUP BY ALL"""

CTE["lagged"] = """
SELECT sku, rival_id, w, avg_p, coalesce(vol, 0) AS vol, before_p, after_p,
       row_number() OVER (PARTITION BY sku, rival_id ORDER BY w) AS rn, count(*) OVER (PARTITION BY sku, rival_id) AS n
FROM (SELECT *, lag(avg_p) OVER s AS before_p, lead(avg_p) OVER s AS after_p FROM hist5
      WINDOW s AS (PARTITION BY sku, rival_id ORDER BY w))
WHERE before_p IS NOT NULL AND after_p IS NOT NULL"""

CTE["fold"] = """
SELECT sku, rival_id, n, f AS fold, n - (6 - f) * (n // 6) AS train, n - (5 - f) * (n // 6) AS upto
FROM (SELECT DISTINCT sku, rival_id, n FROM lagged WHERE n >= 8), (SELECT unnest([1, 2, 3, 4, 5]) AS f)"""

CTE["rolled"] = f"""
SELECT sku, max(w_end) AS tick, sum(bought) AS demand FROM shopping WHERE w_end > {ago(minute=60)} GROUP BY sku"""

CTE["priced"] = """
SELECT r.sku, r.tick, r.demand, coalesce(
         (SELECT h.new_c FROM repriced h WHERE h.sku = r.sku AND h.tick <= r.tick ORDER BY h.tick DESC, h.new_c DESC LIMIT 1),
         p.cents) AS price
FROM rolled r JOIN product p ON p.sku = r.sku AND p.live"""

CTE["slope"] = f"""
SELECT sku, regr_slope(ln(demand), ln(price / 100)) AS e, count(*) AS n
FROM seen WHERE tick >= {ago(hour=72)} AND demand > 0 GROUP BY sku HAVING count(*) >= 20 AND var_pop(ln(price / 100)) > 1e-8"""

CTE["labelled"] = """
SELECT *, CASE WHEN e <= -1 THEN 'high' WHEN e <= -0.3 THEN 'medium' ELSE 'low' END AS label FROM slope"""

CTE["pace"] = f"""
WITH RECURSIVE step AS (
  SELECT sku, bought * 12.0::DOUBLE AS rate, row_number() OVER (PARTITION BY sku ORDER BY w_end) AS i
  FROM shopping WHERE w_end > {ago(minute=60)}),
smooth AS (
  SELECT sku, i, rate AS level FROM step WHERE i = 1
  UNION ALL
  SELECT s.sku, s.i, m.level * exp(-ln(2) / 60) + s.rate * (1 - exp(-ln(2) / 60))
  FROM smooth m JOIN step s ON s.sku = m.sku AND s.i = m.i + 1)
SELECT sku, CASE WHEN level > 0 THEN level ELSE 1 END AS pace
FROM smooth JOIN (SELECT sku, max(i) AS i FROM step GROUP BY sku) USING (sku, i)"""

CTE["pricing"] = """
SELECT sku, cents / 100 AS price, cost_c / 100 AS cost, floor_c / 100 AS least,
       CASE WHEN coalesce(elasticity, 0) = 0 THEN -1 ELSE elasticity END::DOUBLE AS e
FROM product WHERE live AND stocked"""

CTE["ready"] = "SELECT p.*, coalesce(b.pace, 1)::DOUBLE AS pace FROM pricing p LEFT JOIN pace b ON b.sku = p.sku"

CTE["anchored"] = f"""
SELECT sku, price, e, pred, candidate, pace * pow(candidate / price, e) AS demand, cost, pace
FROM (SELECT r.*, b.pred, greatest(b.pred * (1 - 0.01::DOUBLE), r.cost * (1 + 0.05::DOUBLE), r.least) AS candidate
      FROM ready r JOIN bestof b ON b.sku = r.sku)"""

CTE["grid"] = """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sku ORDER BY profit DESC, i) AS pick
  FROM (SELECT *, greatest(0, candidate - cost) * demand AS profit
    FROM (SELECT *, pace * pow(candidate / price, e) AS demand
      FROM (SELECT r.*, i, greatest(price * (1 + (-0.05::DOUBLE + i * (0.1::DOUBLE / 10))), cost * (1 + 0.05::DOUBLE), least) AS candidate
            FROM ready r, (SELECT unnest(range(11)) AS i)))))
WHERE pick = 1"""

CTE["proposal"] = f"""
SELECT sku, price AS old_p, {half_up('candidate', 2)} AS new_p, e, demand - pace AS demand_d,
       greatest(0, candidate - cost) * demand - greatest(0, price - cost) * pace AS profit_d,
       (candidate - pred) / pred AS gap_after, greatest(0, candidate - cost) * demand AS score,
       'elasticity+forecast' AS reason FROM anchored
UNION ALL
SELECT sku, price, {half_up('candidate', 2)}, e, demand - pace, profit - greatest(0, price - cost) * pace, NULL, profit,
       'elasticity-only' FROM grid WHERE sku NOT IN (SELECT sku FROM anchored)"""

LIVE = f"(from_at IS NULL OR from_at <= {NOW}) AND (until_at IS NULL OR until_at > {NOW})"
CTE["due"] = f"""
SELECT *, row_number() OVER (ORDER BY approved NULLS LAST, created, id) AS turn FROM offer
WHERE status = 'approved' AND {LIVE}"""

CTE["verdict"] = """
WITH RECURSIVE q AS (SELECT *, row_number() OVER (PARTITION BY sku ORDER BY turn) AS i FROM due),
go AS (
  SELECT sku, 0::BIGINT AS i, cents AS price, NULL::BIGINT AS id, NULL::BIGINT AS old_c, NULL::BIGINT AS new_c,
         NULL::VARCHAR AS reason, false AS ok FROM product WHERE sku IN (SELECT sku FROM due)
  UNION ALL
  SELECT q.sku, q.i, CASE WHEN q.old_c IS NULL OR q.old_c = go.price THEN q.new_c ELSE go.price END, q.id, q.old_c,
         q.new_c, q.reason, q.old_c IS NULL OR q.old_c = go.price
  FROM go JOIN q ON q.sku = go.sku AND q.i = go.i + 1)
SELECT *, last_value(price) OVER (PARTITION BY sku ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS final_c FROM go"""
CTE["outcome"] = "SELECT * FROM verdict WHERE i > 0"

CTE["card"] = f"""
SELECT s.*, p.name AS product, p.category, r.name AS rival,
       CASE kind WHEN 'UNDERCUT' THEN 'Undercut' WHEN 'OVERPRICED' THEN 'Overpriced' WHEN 'STOCKOUT' THEN 'Stockout'
                 WHEN 'PRICE_INCREASE_24H' THEN 'Abrupt Increase' END AS shown
FROM live_signal s JOIN product p ON p.sku = s.sku JOIN rival r ON r.id = s.rival_id WHERE tick > {ago(day=2)}"""

CTE["drift"] = f"SELECT *, w + INTERVAL 5 MINUTE AS w_end FROM direction WHERE w + INTERVAL 5 MINUTE > {ago(day=2)}"

CTE["mover"] = """
SELECT sku, rival_name, first_c, last_c, (last_c - first_c) / 100 / (first_c / 100) * 100 AS pct
FROM (SELECT DISTINCT sku, rival_name, first_value(avg_c) OVER s AS first_c, last_value(avg_c) OVER s AS last_c
      FROM drift WINDOW s AS (PARTITION BY sku, rival_name ORDER BY w
                              ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))"""

CTE["jump"] = f"SELECT m.*, r.code FROM move m JOIN rival r ON r.id = m.rival_id WHERE tick > {ago(day=2)}"

CTE["gap"] = f"""
SELECT h.rival_id, r.code, r.name AS rival, p.category, h.sku, p.name AS product, h.price, p.cents AS ours,
       ((h.price - p.cents) / 100) / (p.cents / 100) * 100 AS diff, h.stock, h.data_at
FROM past h JOIN product p ON p.sku = h.sku JOIN rival r ON r.id = h.rival_id WHERE h.data_at > {ago(day=2)}"""

CTE["board"] = f"""
SELECT d.*, p.name, p.category, coalesce(p.name || ' (' || d.sku || ')', d.sku) AS shown
FROM duel d LEFT JOIN product p ON p.sku = d.sku WHERE d.w_end > {ago(day=2)}"""

CTE["board_last"] = """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sku ORDER BY w_end DESC) AS rn FROM board) WHERE rn = 1"""

CTE["mood"] = f"""
SELECT f.*, p.name, p.category FROM felt f LEFT JOIN (SELECT * FROM product WHERE live AND stocked) p ON p.sku = f.sku
WHERE f.tick > {ago(day=30)}"""

CTE["recent_quality"] = "SELECT * FROM quality WHERE samples > 0"

CTE["our_line"] = f"""
SELECT g.sku, g.ts, coalesce(
    (SELECT arg_max(h.new_c, (h.tick, h.id)) FROM repriced h WHERE h.sku = g.sku AND h.tick > {ago(day=2)} AND h.tick <= g.ts),
    g.cents) AS price
FROM (SELECT sku, cents, unnest(generate_series({ago(day=2)}, {NOW}, INTERVAL 15 MINUTE)) AS ts FROM product) g"""

CTE["their_line"] = f"""
WITH win AS (SELECT sku, rival_id, {win5('got_at')} AS ts, sum(price) / 100 / count(*) AS avg_p
             FROM past WHERE got_at > {ago(day=2)} GROUP BY ALL),
best AS (SELECT sku, rival_id, row_number() OVER (PARTITION BY sku ORDER BY seen_at DESC, rival_id) AS pos
         FROM (SELECT sku, rival_id, max(ts) AS seen_at FROM win GROUP BY sku, rival_id))
SELECT win.*, coalesce(r.code, win.rival_id::VARCHAR) AS series
FROM win JOIN best USING (sku, rival_id) LEFT JOIN rival r ON r.id = win.rival_id WHERE pos <= 3"""

CTE["step_point"] = f"""
SELECT id, sku, coalesce(from_at, created) AS ts, new_c, status
FROM (SELECT *, bool_or(status = 'approved') OVER (PARTITION BY sku) AS any_ok FROM offer WHERE created > {ago(day=7)})
WHERE status = 'approved' OR NOT any_ok"""


def hist(source: str, value: str, bins: int, by: str = "") -> str:
    """Equal-width histogram over ``value`` of a source, optionally per group."""
    keys = f"{by}, " if by else ""
    join = f"JOIN lim USING ({by})" if by else "CROSS JOIN lim"
    group = f"GROUP BY {by}" if by else ""
    return f"""
WITH val AS (SELECT {keys}({value})::DOUBLE AS v FROM {source}),
lim AS (SELECT {keys}min(v) AS lo, max(v) AS hi FROM val {group}),
slot AS (SELECT {keys}lo, hi, CASE WHEN hi > lo THEN least(floor((v - lo) / (hi - lo) * {bins}.0::DOUBLE)::BIGINT, {bins - 1})
                              ELSE 0 END AS bin FROM val {join})
SELECT {keys}bin, {six(f'lo + bin * ((hi - lo) / {bins}.0::DOUBLE)', 'bin_start')},
       {six(f'lo + (bin + 1) * ((hi - lo) / {bins}.0::DOUBLE)', 'bin_end')}, count(*) AS rows
FROM slot GROUP BY ALL"""


def mean_c(expr: str) -> str:
    """Mean of an integer hundredths expression, in units."""
    return f"sum({expr})::DOUBLE / 100 / count({expr})"


SQL: dict[str, str] = {}

# ---- ingest ---------------------------------------------------------------------------
SQL["flatten_competitor_prices"] = f"""
SELECT sku AS product_sku, rival_name AS competitor_name, {dollars('price', 'price')}, stock AS in_stock, src AS source_sku,
       minute * 60000 AS api_collection_ts_ms, coalesce(data_ms, minute * 60000) AS data_ts_ms FROM enveloped"""
SQL["flatten_aggregator_prices"] = f"""
SELECT sku AS product_sku, 'pricewatch' AS aggregator_name, true AS available, {dollars('min(lo)', 'avg_price')},
       {dollars('min(lo)', 'min_price')}, {dollars('max(hi)', 'max_price')}, {big('sum(n)', 'stores_tracked')},
       minute * 60000 AS api_collection_ts_ms, minute * 60000 AS data_last_updated_ts_ms,
       epoch_ms(minute * 60000) AS collection_timestamp FROM enveloped GROUP BY sku, minute"""
SQL["flatten_user_behavior"] = f"""
SELECT sku, 'Item ' || user_id::VARCHAR AS title, event_type AS category, views AS page_views, visitors AS unique_visitors,
       {six('dwell', 'dwell_seconds')}, {six('searches', 'searches')}, carts AS cart_additions, bought AS purchases,
       compared AS price_comparisons, api_ms AS api_collection_ts_ms, ms AS data_ts_ms,
       'user_behavior_api' AS collection_source, 'user_interaction' AS data_type FROM visit"""
SQL["map_source_skus"] = f"""
SELECT ['amazon', 'ebay', 'bestbuy'][l_suppkey % 3 + 1] AS competitor_name,
       ['A', 'E', 'B'][l_suppkey % 3 + 1] || l_partkey::VARCHAR AS source_sku, l_orderkey AS order_key,
       {big('l_linenumber', 'line_number')}, {sku('l_partkey')} AS product_sku
FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_suppkey % 3 <> 1 OR p_size <> 7"""
SQL["with_lineage"] = f"""
SELECT sku, api_ms::BIGINT AS ingest_ms, {NOW} AS producer_timestamp, 'user-behavior-producer' AS producer_id,
       sku || '_' || api_ms::BIGINT::VARCHAR AS message_key,
       'user-behavior-events_' || sha256('{{"sku":"' || sku || '","ingest_ms":' || api_ms::BIGINT::VARCHAR || '}}') AS message_id FROM visit"""
SQL["archive_raw"] = """
SELECT 'user-behavior-events_' || sku AS message_id, epoch_ms(api_ms) AS ingest_time, views AS page_views
FROM (SELECT *, row_number() OVER (PARTITION BY sku ORDER BY api_ms DESC, event_type DESC, views DESC) AS rn FROM visit)
WHERE rn = 1"""

# ---- dimensions -----------------------------------------------------------------------
SQL["apply_changelog"] = f"""
SELECT l.sku, {dollars('l.price', 'current_price')}, p.stocked AS in_stock, l.op_ts FROM living l JOIN product p USING (sku)"""
SQL["publish_dim"] = SQL["source_changelog"] = SQL["apply_changelog"]
SQL["products_dim"] = f"""
SELECT l.sku, {dollars('l.price', 'current_price')}, p.label AS price_sensitivity, p.stocked AS in_stock, p.live AS is_active,
       coalesce(p.updated_at, p.created_at, l.op_ts) AS dim_time FROM living l JOIN product p USING (sku)"""
SQL["competitors_dim"] = "SELECT code, id, name, created_at AS dim_time FROM rival"

RATES = ", ".join(
    [
        six("CASE WHEN views > 0 THEN searches / views ELSE 0 END", "search_rate"),
        six("CASE WHEN searches > 0 THEN carts / searches ELSE 0 END", "search_cart_rate"),
        six("CASE WHEN carts > 0 THEN bought / carts ELSE 0 END", "cart_purchase_rate"),
        six("CASE WHEN views > 0 THEN compared / views ELSE 0 END", "view_compare_rate"),
        six("dwell", "avg_dwell_seconds"),
    ]
)
SUMS = ", ".join(
    big(a, b)
    for a, b in [
        ("views", "page_views"), ("visitors", "unique_visitors"), ("searches", "searches"), ("carts", "cart_additions"),
        ("bought", "purchases"), ("compared", "price_comparisons"),
    ]
)
SQL["behavior_dim"] = SQL["behavior_summary"] = f"""
SELECT sku AS product_sku, w AS window_start, w_end AS window_end, {SUMS}, {RATES} FROM shopping"""

SIGNAL_COLUMNS = f"""sku AS product_sku, rival_id AS competitor_id, kind AS signal_type, {dollars('ours', 'platform_price')},
       {dollars('price', 'competitor_price')}, {dollars('gap_h', 'percentage_diff')}, advice AS recommendation,
       {big('level', 'priority')}, stock AS in_stock, tick AS signal_timestamp, true AS is_active"""
SQL["signals_dim"] = SQL["current_signals"] = f"SELECT {SIGNAL_COLUMNS} FROM live_signal"

# ---- prices ---------------------------------------------------------------------------
SQL["competitor_prices"] = f"""
SELECT sku AS product_sku, rival_name AS competitor_name, {dollars('price', 'price')}, stock AS in_stock, src AS source_sku,
       api_ms AS api_collection_ts_ms, broker_ts AS kafka_ts, tick AS event_time FROM quote"""
SQL["source_prices"] = SQL["source_prices_stream"] = f"""
SELECT sku AS product_sku, rival_name AS competitor_name, {dollars('price', 'price')}, stock AS in_stock, src AS source_sku,
       api_ms AS api_collection_ts_ms, tick AS event_time FROM quote"""
SQL["dedup_prices"] = f"""
SELECT sku AS product_sku, rival_name AS competitor_name, data_ms AS data_ts_ms, {dollars('price', 'price')},
       stock AS in_stock, src AS source_sku, api_ms AS api_collection_ts_ms, broker_ts AS kafka_ts FROM unique_quote"""
SQL["competitor_price_history"] = f"""
SELECT sku AS product_sku, rival_id AS competitor_id, {dollars('price', 'price')}, stock AS in_stock, src AS source_sku,
       data_at AS data_timestamp, got_at AS collection_timestamp FROM past"""
SQL["price_window_stats"] = f"""
SELECT sku AS product_sku, rival_name AS competitor_name, w AS window_start, w + INTERVAL 5 MINUTE AS window_end,
       {dollars('avg_c', 'avg_price')}, {dollars('vol_c', 'price_volatility')}, first_at AS min_ts, last_at AS max_ts FROM trend"""
SQL["price_trends"] = f"""
SELECT sku AS product_sku, rival_name AS competitor_name, w AS window_start, w + INTERVAL 5 MINUTE AS window_end,
       {dollars('avg_c', 'avg_price')}, {dollars('vol_c', 'price_volatility')}, dir AS trend_direction FROM direction"""

# ---- signals --------------------------------------------------------------------------
for _name, _cte in {
    "undercut_signals": "under",
    "undercut_signals_strict": "under_strict",
    "overpriced_signals": "over",
    "stockout_signals": "out",
    "price_increase_signals": "rise",
}.items():
    SQL[_name] = f"SELECT {SIGNAL_COLUMNS} FROM {_cte}"
MOVE_COLUMNS = f"""sku AS product_sku, rival_id AS competitor_id, {dollars('was', 'previous_price')},
       {dollars('price', 'new_price')}, {dollars('change_h', 'pct_change')}, dir AS direction, stock AS in_stock, tick AS event_time"""
SQL["price_movements"] = f"SELECT {MOVE_COLUMNS} FROM move"

# ---- market ---------------------------------------------------------------------------
SQL["latest_prices"] = f"""
SELECT sku AS product_sku, rival_name AS competitor_name, {dollars('price', 'price')}, stock AS in_stock, tick AS event_time FROM newest"""
SQL["upsert_latest"] = SQL["latest_prices"]
SQL["insert_ignore"] = "SELECT sku AS product_sku, rival_name AS competitor_name, data_ms AS data_ts_ms FROM unique_quote"
SQL["insert_once"] = f"""
SELECT sku AS product_sku, rival_name AS competitor_name, data_ms AS data_ts_ms, {dollars('price', 'price')}, src AS source_sku, broker_ts AS kafka_ts
FROM (SELECT *, row_number() OVER (PARTITION BY sku, rival_name, data_ms ORDER BY broker_ts, src, price) AS rn
      FROM quote WHERE data_ms IS NOT NULL) WHERE rn = 1"""
SQL["export_csv"] = SQL["competitor_price_history"]
SQL["competitor_counts"] = """
SELECT sku AS product_sku, rivals AS competitor_count, stocked_rivals AS in_stock_competitor_count FROM tally"""
SQL["cheapest_competitor"] = f"""
SELECT sku AS product_sku, code AS competitor_code, {dollars('price', 'price')}, tick AS event_time FROM cheapest"""
POSTURE = f"""{dollars('price', 'cheapest_price')}, {dollars('ours', 'platform_price')}, {dollars('gap_h', 'gap_pct')},
       rivals AS competitor_count, stocked_rivals AS in_stock_competitor_count, tick AS summary_timestamp"""
SQL["product_market_summary"] = f"SELECT sku AS product_sku, rival_id AS cheapest_competitor_id, {POSTURE} FROM posture"

# ---- behaviour and demand -------------------------------------------------------------
SQL["behavior_events"] = f"""
SELECT sku AS product_sku, views AS page_views, visitors AS unique_visitors, {six('dwell', 'dwell_seconds')}, {six('searches', 'searches')},
       carts AS cart_additions, bought AS purchases, compared AS price_comparisons, tick AS data_timestamp,
       epoch_ms(api_ms) AS collection_timestamp FROM visit"""
SQL["source_behavior"] = SQL["behavior_events"]
SQL["signal_windows"] = f"""
SELECT sku AS product_sku, w AS window_start, w + INTERVAL 5 MINUTE AS window_end, under_n AS undercut_cnt,
       rise_n AS abrupt_inc_cnt, over_n AS overpriced_cnt, {six('under_u / 1000000', 'avg_undercut_gap_pct')},
       {six('rise_u / 1000000', 'avg_abrupt_inc_gap_pct')}, {six('over_u / 1000000', 'avg_overpriced_gap_pct')}
FROM signal_window"""
SQL["behavior_with_previous"] = f"""
SELECT sku AS product_sku, w AS window_start, w_end AS window_end, {six('search_rate', 'search_rate')},
       {six('prev_rate', 'prev_search_rate')} FROM shift"""
DUEL = f"""{six('delta', 'engagement_delta')}, under_n AS undercut_cnt, rise_n AS abrupt_inc_cnt, over_n AS overpriced_cnt,
       {dollars('under_h', 'avg_undercut_gap_pct')}, {dollars('rise_h', 'avg_abrupt_inc_gap_pct')},
       {dollars('over_h', 'avg_overpriced_gap_pct')}, stance AS price_position, {six('score', 'score')}"""
SQL["demand_vs_signals"] = f"SELECT sku AS product_sku, w AS window_start, w_end AS window_end, {DUEL} FROM duel"

# ---- elasticity -----------------------------------------------------------------------
SQL["demand_rollup"] = f"SELECT sku AS product_sku, tick AS observed_at, {big('demand', 'demand')} FROM rolled"
SQL["price_as_of"] = f"SELECT sku, tick AS observed_at, {dollars('price', 'price')}, {big('demand', 'demand')} FROM priced"
SQL["new_observations"] = f"""
SELECT sku, tick AS observed_at, {dollars('price', 'price')}, {big('demand', 'demand')} FROM priced p
WHERE price > 0 AND NOT EXISTS (SELECT 1 FROM seen s WHERE s.sku = p.sku AND s.tick >= p.tick)"""
SQL["price_elasticity"] = f"SELECT sku, {six('e', 'price_elasticity')}, n AS observations FROM slope"
SQL["incremental_elasticity"] = SQL["price_elasticity"]
SQL["sensitivity_labels"] = f"""
SELECT sku, {six('e', 'price_elasticity')}, n AS observations, label AS price_sensitivity FROM labelled"""
SQL["apply_sensitivity"] = f"""
SELECT p.sku, p.name, p.category, p.brand, {dollars('p.cost_c', 'cost')}, {dollars('p.floor_c', 'min_viable_price')},
       {dollars('p.cents', 'current_price')}, CASE WHEN hit THEN l.label ELSE p.label END AS price_sensitivity,
       {six(f"CASE WHEN hit THEN {half_up('l.e', 3)}::DOUBLE ELSE p.elasticity END", 'price_elasticity')},
       CASE WHEN hit THEN {NOW} ELSE p.label_at END AS sensitivity_last_updated,
       {big('CASE WHEN hit THEN l.n ELSE p.label_n END', 'sensitivity_observations')}, p.stocked AS in_stock,
       p.live AS is_active, p.created_at, p.updated_at
FROM (SELECT *, live AND sku IN (SELECT sku FROM labelled) AS hit FROM product) p LEFT JOIN labelled l ON l.sku = p.sku"""
SQL["sensitivity_history_rows"] = f"""
SELECT l.sku, {six('l.e', 'price_elasticity')}, l.label AS price_sensitivity, l.n AS observations, {NOW} AS updated_at
FROM labelled l JOIN product p ON p.sku = l.sku AND p.live"""

# ---- forecast -------------------------------------------------------------------------
SQL["history_windows"] = f"""
SELECT sku AS product_sku, rival_id AS competitor_id, w AS window_start, w + INTERVAL 5 MINUTE AS window_end,
       {six('avg_p', 'avg_price')}, {six('vol', 'price_volatility')} FROM hist5"""
SQL["recent_competitors"] = f"""
SELECT sku AS product_sku, rival_id AS competitor_id FROM past WHERE got_at > {ago(day=60)} GROUP BY ALL"""
SQL["forecast_features"] = f"""
SELECT sku AS product_sku, rival_id AS competitor_id, w + INTERVAL 5 MINUTE AS window_end, {six('avg_p', 'avg_price')},
       {six('vol', 'price_volatility')}, {six('before_p', 'lag_1')}, {six('after_p', 'target')} FROM lagged"""
SQL["naive_forecast"] = f"""
WITH wide AS (SELECT sku, rival_id, time_bucket(INTERVAL 12 HOUR, got_at, TIMESTAMP '2024-01-01 00:00:00') AS w,
                     sum(price) / 100 / count(*) AS avg_p FROM past WHERE got_at > {ago(day=14)} GROUP BY ALL),
one AS (SELECT sku, rival_id, last(avg_p ORDER BY w) AS p, greatest(count(*) - 2, 0) AS n FROM wide GROUP BY ALL)
SELECT sku, rival_id AS competitor_id, {big('1', 'horizon')}, {six(half_up('p', 2), 'prediction')},
       {six(half_up('p', 2), 'last_price')}, n AS n_samples, false AS reliable FROM one WHERE n < 8"""
SQL["cv_folds"] = f"""
SELECT sku AS product_sku, rival_id AS competitor_id, n AS n_samples, {big('5', 'splits')}, {big('fold', 'fold')},
       {big('train', 'train_rows')}, {big('upto', 'test_end')} FROM fold"""
SQL["forecast_baseline_mae"] = f"""
WITH err AS (SELECT f.sku, f.rival_id, f.n, f.fold, avg(abs(t.after_p - b.after_p)) AS mae
  FROM fold f JOIN lagged b ON b.sku = f.sku AND b.rival_id = f.rival_id AND b.rn = f.train
  JOIN lagged t ON t.sku = f.sku AND t.rival_id = f.rival_id AND t.rn > f.train AND t.rn <= f.upto
  WHERE f.train >= 6 GROUP BY ALL)
SELECT sku AS product_sku, rival_id AS competitor_id, n AS n_samples, {six('avg(mae)', 'baseline_mae')} FROM err GROUP BY sku, rival_id, n"""
# every part of every prefix summed anew; of nine sign patterns the valid one that costs least
SQL["forecast_competitor_prices"] = f"""
WITH s AS (SELECT sku, rival_id, rn, n, before_p - first_value(before_p) OVER o AS x, vol - first_value(vol) OVER o AS z,
                  after_p - first_value(after_p) OVER o AS y, first_value(before_p) OVER o AS x0, first_value(vol) OVER o AS z0,
                  first_value(after_p) OVER o AS y0
           FROM lagged WHERE n >= 8 WINDOW o AS (PARTITION BY sku, rival_id ORDER BY rn)),
series AS (SELECT sku, rival_id, n, any_value(x0) AS x0, any_value(z0) AS z0, any_value(y0) AS y0 FROM s GROUP BY ALL),
prefix AS (SELECT sku, rival_id, n, k, n - k * (n // 6) AS len FROM series, (SELECT unnest(range(6)) AS k) WHERE n - k * (n // 6) > 5),
part AS (SELECT *, len - j * (len // 6) AS upto, len // 6 AS step FROM prefix, (SELECT unnest(range(6)) AS j)),
train AS (SELECT p.sku, p.rival_id, k, j, avg(x) AS mx, avg(z) AS mz, avg(y) AS my, var_pop(x) AS xx, var_pop(z) AS zz,
                 covar_pop(x, z) AS xz, covar_pop(x, y) AS xy, covar_pop(z, y) AS zy
          FROM part p JOIN s ON s.sku = p.sku AND s.rival_id = p.rival_id AND s.rn <= p.upto GROUP BY ALL),
scale AS (SELECT sku, rival_id, k, CASE WHEN sqrt(xx) < 1e-9 THEN 1 ELSE sqrt(xx) END AS dx,
                 CASE WHEN sqrt(zz) < 1e-9 THEN 1 ELSE sqrt(zz) END AS dz FROM train WHERE j = 0),
stated AS (SELECT t.sku, t.rival_id, k, j, mx, mz, my, dx, dz, xx / (dx * dx) AS g, zz / (dz * dz) AS h, xz / (dx * dz) AS q,
                  xy / dx AS c, zy / dz AS d FROM train t JOIN scale USING (sku, rival_id, k)),
tried AS (SELECT *, CASE WHEN a = 0 THEN 0 WHEN b = 0 THEN CASE WHEN g > 1e-15 THEN (c - a * al) / g END
                         WHEN g * h - q * q > 1e-12 * greatest(g * h, 1e-300)
                           THEN (h * (c - a * al) - q * (d - b * al)) / (g * h - q * q) END AS u,
                    CASE WHEN b = 0 THEN 0 WHEN a = 0 THEN CASE WHEN h > 1e-15 THEN (d - b * al) / h END
                         WHEN g * h - q * q > 1e-12 * greatest(g * h, 1e-300)
                           THEN (g * (d - b * al) - q * (c - a * al)) / (g * h - q * q) END AS v
          FROM stated, (SELECT pow(10, -3 + 4 * unnest(range(30)) / 29) AS al), (SELECT unnest([0, 1, -1]) AS a),
               (SELECT unnest([0, 1, -1]) AS b)),
chosen AS (SELECT sku, rival_id, k, j, al, any_value(mx) AS mx, any_value(mz) AS mz, any_value(my) AS my,
                  arg_min({{'u': u / dx, 'v': v / dz}}, (0.5 * (g * u * u + h * v * v) + q * u * v - c * u - d * v
                                                       + al * (abs(u) + abs(v)), abs(a) + abs(b))) AS w
           FROM tried WHERE (a = 0 OR u * a > 0) AND (b = 0 OR v * b > 0) GROUP BY ALL),
fit AS (SELECT sku, rival_id, k, j, al, w.u AS u, w.v AS v, my - w.u * mx - w.v * mz AS b FROM chosen),
tested AS (SELECT p.sku, p.rival_id, k, j, avg(x) AS x, avg(z) AS z, avg(y) AS y, avg(x * x) AS xx, avg(z * z) AS zz, avg(y * y) AS yy,
                  avg(x * z) AS xz, avg(x * y) AS xy, avg(z * y) AS zy
           FROM part p JOIN s ON s.sku = p.sku AND s.rival_id = p.rival_id AND s.rn > p.upto AND s.rn <= p.upto + p.step
           WHERE j > 0 GROUP BY ALL),
loss AS (SELECT f.sku, f.rival_id, k, al, list_sum(list(yy + u * u * xx + v * v * zz + 2 * u * v * xz - 2 * u * xy - 2 * v * zy
                - 2 * b * (y - u * x - v * z) + b * b ORDER BY j)) AS e
         FROM fit f JOIN tested USING (sku, rival_id, k, j) GROUP BY ALL),
best AS (SELECT sku, rival_id, k, arg_min(al, (e, -al)) AS al FROM loss GROUP BY ALL),
model AS (SELECT f.sku, f.rival_id, k, al, u, v, b FROM fit f JOIN best USING (sku, rival_id, k, al) WHERE j = 0),
gone AS (SELECT p.sku, p.rival_id, p.k, t.y, t.y - (m.b + m.u * t.x + m.v * t.z) AS off, t.y - l.y AS still
         FROM prefix p JOIN model m USING (sku, rival_id, k)
         JOIN s l ON l.sku = p.sku AND l.rival_id = p.rival_id AND l.rn = p.len
         JOIN s t ON t.sku = p.sku AND t.rival_id = p.rival_id AND t.rn > p.len AND t.rn <= p.len + p.n // 6 WHERE p.k > 0),
by_fold AS (SELECT sku, rival_id, k, avg(abs(off)) AS mae, sqrt(avg(off * off)) AS rmse, avg(abs(still)) AS base,
                 CASE WHEN count(*) > 1 THEN CASE WHEN var_pop(y) = 0 THEN CASE WHEN sum(off * off) = 0 THEN 1 ELSE 0 END
                      ELSE 1 - avg(off * off) / var_pop(y) END END AS r2 FROM gone GROUP BY ALL),
err AS (SELECT sku, rival_id, avg(mae) AS mae, avg(rmse) AS rmse, avg(r2) AS r2, avg(base) AS base FROM by_fold GROUP BY ALL),
newest AS (SELECT sku, rival_id, arg_max(avg_p, w) AS p, arg_max(coalesce(vol, 0), w) AS z FROM hist5 GROUP BY ALL),
rated AS (SELECT sku, rival_id, CASE WHEN coalesce(mae, 0) <> 0 AND coalesce(base, 0) <> 0 THEN greatest(0, least(1, 1 - mae / base)) END AS conf FROM err),
ahead AS (SELECT l.sku, l.rival_id, l.p, coalesce(c.n, 0) AS n, al, mae, rmse, r2, base, conf,
                 coalesce(y0 + (b + u * (l.p - x0) + v * (l.z - z0)), l.p) AS pred, al IS NOT NULL AS fitted
          FROM newest l LEFT JOIN (SELECT sku, rival_id, count(*) AS n FROM lagged GROUP BY ALL) c USING (sku, rival_id)
          LEFT JOIN series r USING (sku, rival_id) LEFT JOIN (SELECT * FROM model WHERE k = 0) m USING (sku, rival_id)
          LEFT JOIN err USING (sku, rival_id) LEFT JOIN rated USING (sku, rival_id)),
told AS (SELECT *, CASE WHEN fitted THEN pred - p END AS diff FROM ahead)
SELECT sku, rival_id AS competitor_id, {big('1', 'horizon')}, {six(half_up(half_up('pred', 9), 2), 'prediction')}, {six(half_up(half_up('p', 9), 2), 'last_price')},
       {big('n', 'n_samples')}, {six(half_up(half_up('al', 9), 4), 'alpha')}, {six(half_up(half_up('mae', 9), 4), 'cv_mae')}, {six(half_up(half_up('rmse', 9), 4), 'cv_rmse')},
       {six(half_up(half_up('r2', 9), 3), 'cv_r2')}, {six(half_up(half_up('base', 9), 4), 'baseline_mae')}, {six(half_up(half_up('conf', 9), 4), 'confidence')},
       coalesce(mae <= 0.5 AND conf >= 0.2, false) AS reliable, {six(half_up(half_up('diff', 9), 4), 'pred_diff')},
       {six(half_up(half_up('CASE WHEN p > 0 THEN diff / p WHEN fitted THEN 0 END', 9), 4), 'pred_diff_pct')} FROM told"""
SQL["score_reliability"] = f"""
SELECT sku, rival_id AS competitor_id, {six('mae', 'cv_mae')}, {six('base', 'baseline_mae')},
       {six('CASE WHEN mae <> 0 THEN conf END', 'confidence')}, mae <> 0 AND good AS reliable FROM quality"""
SQL["cheapest_reliable_forecast"] = f"SELECT sku, rival_id AS competitor_id, {six('pred', 'prediction')} FROM bestof"
SQL["forecast_metrics"] = f"""
SELECT {big('7', 'run_id')}, sku, rival_id AS competitor_id, {big('1', 'horizon')},
       {six('880 + samples + rival_id / 4', 'prediction')}, {six('901', 'last_price')}, samples AS n_samples,
       {six('0.001', 'alpha')}, {six('mae', 'cv_mae')}, {six('mae * 2', 'cv_rmse')}, {six('0.5', 'cv_r2')},
       {six('base', 'baseline_mae')}, {six('conf', 'confidence')}, good AS reliable,
       {six('880 + samples + rival_id / 4 - 901', 'pred_diff')}, NULL::DOUBLE AS pred_diff_pct, {NOW} AS created_at
FROM quality WHERE samples > 0 AND sku IN (SELECT sku FROM quality WHERE good)"""

# ---- proposals ------------------------------------------------------------------------
SQL["pricing_features"] = f"""
SELECT sku, {six('price', 'price')}, {six('cost', 'cost')}, {six('least', 'min_viable_price')}, {six('e', 'elasticity')} FROM pricing"""
SQL["demand_baseline"] = f"SELECT sku, {six('pace', 'demand_baseline')} FROM pace"
SQL["forecast_proposals"] = f"""
SELECT sku, {six('price', 'old_price')}, {six('e', 'elasticity_used')}, {six(half_up('candidate', 2), 'proposed_price')},
       {six('demand - pace', 'expected_demand_delta')},
       {six('greatest(0, candidate - cost) * demand - greatest(0, price - cost) * pace', 'expected_profit_delta')},
       {six('(candidate - pred) / pred', 'competitor_gap_after')}, {six('greatest(0, candidate - cost) * demand', 'score')},
       'elasticity+forecast' AS reason_code FROM anchored"""
SQL["grid_proposals"] = f"""
SELECT sku, {six('price', 'old_price')}, {six('e', 'elasticity_used')}, {six(half_up('candidate', 2), 'proposed_price')},
       {six('demand - pace', 'expected_demand_delta')}, {six('profit - greatest(0, price - cost) * pace', 'expected_profit_delta')},
       NULL::DOUBLE AS competitor_gap_after, {six('profit', 'score')}, 'elasticity-only' AS reason_code FROM grid"""
SQL["price_proposals"] = f"""
SELECT sku, {six('old_p', 'old_price')}, {six('new_p', 'proposed_price')}, {six('e', 'elasticity_used')},
       {six('demand_d', 'expected_demand_delta')}, {six('profit_d', 'expected_profit_delta')},
       {six(half_up('gap_after', 2), 'competitor_gap_after')}, {six('score', 'score')}, reason AS reason_code,
       CASE reason WHEN 'elasticity-only'
         THEN '{{"min_margin_pct":0.05,"price_grid_pct":0.05,"demand_baseline_minutes":60,"demand_ema_halflife_minutes":60}}'
         ELSE '{{"min_margin_pct":0.05,"target_undercut_pct":0.01,"gap_tolerance_pct":0.003,"forecast_reliability":true,"demand_baseline_minutes":60,"demand_ema_halflife_minutes":60}}'
       END AS constraints,
       'pending' AS status, {big('7', 'run_id')}, {NOW} AS created_at, 'price-proposer' AS created_by FROM proposal"""
SQL["should_run"] = f"""
SELECT last AS last_finished, {six(f"date_diff('second', last, {NOW}) / 60", 'elapsed_min')}, n AS new_rows,
       last IS NULL OR NOT (date_diff('second', last, {NOW}) / 60 < 720 AND n < 100) AS run
FROM (SELECT (SELECT max(finished) FROM job) AS last,
             (SELECT count(*) FROM past WHERE got_at > (SELECT max(finished) FROM job)) AS n)"""
SQL["run_record"] = f"""
SELECT {big('7', 'id')}, {NOW} AS started_at, {NOW} + INTERVAL 5 MINUTE AS finished_at, '{{"price_grid_pct":0.05}}' AS parameters,
       count(*) AS candidates_count, (SELECT count(*) FROM proposal) AS proposed_count, 'price-proposer' AS created_by FROM pricing"""
SQL["apply_candidates"] = f"""
SELECT id, sku, {dollars('old_c', 'old_price')}, {dollars('new_c', 'proposed_price')}, reason AS reason_code,
       approved AS order_ts, created AS created_at FROM due"""
SQL["apply_candidates_auto"] = f"""
SELECT id, sku, {dollars('old_c', 'old_price')}, {dollars('new_c', 'proposed_price')}, reason AS reason_code,
       created AS order_ts, created AS created_at
FROM (SELECT * FROM offer WHERE status IN ('approved', 'pending') AND {LIVE})"""
SQL["apply_proposals"] = f"""
SELECT id, sku, {big('i - 1', 'seq')}, {dollars('old_c', 'old_price')}, {dollars('new_c', 'new_price')}, reason AS reason_code,
       CASE WHEN ok THEN 'applied' ELSE 'rejected_stale' END AS outcome, {dollars('final_c', 'final_price')} FROM outcome"""
SQL["applied_products"] = f"""
SELECT p.sku, {dollars('coalesce(o.new_c, p.cents)', 'current_price')},
       CASE WHEN o.new_c IS NULL THEN p.updated_at ELSE {NOW} END AS updated_at
FROM product p LEFT JOIN (SELECT sku, last(new_c ORDER BY i) AS new_c FROM outcome WHERE ok GROUP BY sku) o ON o.sku = p.sku"""
SQL["applied_history"] = f"""
SELECT sku, {dollars('old_c', 'old_price')}, {dollars('new_c', 'adjusted_price')}, 'proposal_apply' AS change_type,
       'price-applier' AS changed_by, {NOW} AS change_timestamp, reason AS notes, id AS proposal_id FROM outcome WHERE ok"""
SQL["applied_proposals"] = f"""
SELECT f.id, CASE WHEN o.id IS NULL THEN f.status WHEN o.ok THEN 'applied' ELSE 'rejected' END AS status,
       CASE WHEN o.ok = false THEN coalesce(f.notes, '') || ' stale_or_mismatch' ELSE f.notes END AS notes,
       CASE WHEN o.id IS NOT NULL THEN {NOW} END AS applied_at FROM offer f LEFT JOIN outcome o ON o.id = f.id"""
SQL["applied_counts"] = "SELECT count(*) FILTER (ok) AS applied, count(*) FILTER (NOT ok) AS rejected FROM outcome"
SQL["moderate"] = f"""
SELECT f.id, coalesce(d.v, f.status) AS status, CASE WHEN d.v = 'approved' THEN {NOW} ELSE f.approved END AS approved_at,
       CASE WHEN d.v IS NOT NULL THEN 'dashboard' END AS approved_by,
       CASE WHEN d.v IS NOT NULL THEN coalesce(f.notes, '') || CASE WHEN d.note IS NULL THEN '' ELSE ' ' || d.note END
            ELSE f.notes END AS notes
FROM offer f LEFT JOIN (SELECT o_orderkey AS id, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'approved' ELSE 'rejected' END AS v,
                               CASE WHEN o_orderpriority <> '5-LOW' THEN lower(o_orderpriority) END AS note
                        FROM orders WHERE o_orderstatus = 'O') d ON d.id = f.id"""

# ---- overview -------------------------------------------------------------------------
SQL["competitor_stats"] = f"""
SELECT s.rival_id AS competitor_id, count(*) AS signal_count, {six(mean_c('gap_h'), 'avg_change_pct')},
       count(*) FILTER (kind = 'UNDERCUT') AS undercuts, count(*) FILTER (kind = 'OVERPRICED') AS overpriced_count,
       count(*) FILTER (kind = 'PRICE_INCREASE_24H') AS price_increase_24h_count,
       count(*) FILTER (kind = 'STOCKOUT') AS stockout_count,
       {six(mean_c("CASE WHEN kind = 'UNDERCUT' THEN gap_h END"), 'avg_undercut_pct')},
       {six(mean_c("CASE WHEN kind = 'OVERPRICED' THEN gap_h END"), 'avg_overpriced_pct')},
       any_value(r.code) AS competitor_name, any_value(r.name) AS competitor_full_name,
       {six("count(*) FILTER (kind = 'UNDERCUT') / nullif(count(*) FILTER (kind IN ('UNDERCUT', 'OVERPRICED')), 0)", 'decrease_frequency')},
       {six(f"coalesce(count(*) FILTER (kind = 'UNDERCUT') / nullif(count(*) FILTER (kind IN ('UNDERCUT', 'OVERPRICED')), 0), 0) * ({mean_c('gap_h')})", 'price_aggression')}
FROM live_signal s LEFT JOIN rival r ON r.id = s.rival_id WHERE tick > {ago(day=30)} GROUP BY s.rival_id"""
SQL["product_stats"] = f"""
SELECT s.sku AS product_sku, count(*) AS signal_count, {six(mean_c('gap_h'), 'avg_change_pct')}, {dollars('min(price)', 'min_price')},
       {dollars('max(price)', 'max_price')}, max(tick) AS last_signal, count(*) FILTER (kind = 'UNDERCUT') AS undercut_count,
       count(*) FILTER (kind = 'OVERPRICED') AS overpriced_count, p.name AS product_name, p.category,
       {dollars('max(price) - min(price)', 'price_range')},
       {six('(max(price) - min(price)) / 100 / (min(price) / 100) * 100', 'price_volatility')}
FROM live_signal s JOIN product p ON p.sku = s.sku WHERE tick > {ago(day=30)} GROUP BY s.sku, p.name, p.category"""
CARD = f"""sku AS product_sku, product AS product_name, rival_id AS competitor_id, rival AS competitor_name, kind AS signal_type,
       {dollars('ours', 'platform_price')}, {dollars('price', 'competitor_price')}, {dollars('gap_h', 'percentage_diff')},
       advice AS recommendation, {big('level', 'priority')}, stock AS in_stock, tick AS signal_timestamp, category,
       kind AS signal_type_norm, shown AS signal_display,
       CASE kind WHEN 'UNDERCUT' THEN 'Competitor has lower price than our platform'
                 WHEN 'OVERPRICED' THEN 'Competitor has higher price than our platform'
                 WHEN 'STOCKOUT' THEN 'Competitor is out of stock'
                 WHEN 'PRICE_INCREASE_24H' THEN 'Abrupt increase from recent minimum' END AS signal_category"""
SQL["enriched_signals"] = f"SELECT {CARD} FROM card"
SQL["signal_freshness"] = f"""
SELECT max(tick) AS last_signal, {six(f"epoch({NOW} - max(tick)) / 60", 'age_minutes')},
       count(*) FILTER (tick > {ago(hour=1)}) AS signals_1h, count(*) FILTER (tick > {ago(day=1)}) AS signals_24h FROM live_signal"""
SQL["pipeline_status"] = f"""
SELECT pipeline, last_seen, {six(f'epoch({NOW} - last_seen) / 60', 'age_minutes')},
       CASE WHEN last_seen IS NULL THEN 'DOWN' WHEN epoch({NOW} - last_seen) / 60 <= lim THEN 'OK' ELSE 'STALE' END AS status
FROM (SELECT 'signals' AS pipeline, max(tick) AS last_seen, 10 AS lim FROM live_signal
      UNION ALL SELECT 'trends', max(w) + INTERVAL 5 MINUTE, 20 FROM trend
      UNION ALL SELECT 'summary', max(tick), 30 FROM posture)"""
SQL["engagement_delta"] = f"""
SELECT {six('h', 'rate_1h')}, {six('hp', 'rate_prev_1h')}, {six('d', 'rate_24h')}, {six('dp', 'rate_prev_24h')},
       {six('h - hp', 'delta_1h')}, {six('d - dp', 'delta_24h')}
FROM (SELECT avg(search_rate) FILTER (w_end > {ago(hour=1)}) AS h,
             avg(search_rate) FILTER (w_end <= {ago(hour=1)} AND w_end > {ago(hour=2)}) AS hp,
             avg(search_rate) FILTER (w_end > {ago(day=1)}) AS d,
             avg(search_rate) FILTER (w_end <= {ago(day=1)} AND w_end > {ago(day=2)}) AS dp FROM shopping)"""
SQL["top_opportunities"] = f"""
SELECT d.sku AS product_sku, coalesce(p.name || ' (' || d.sku || ')', d.sku) AS label, {six('d.score', 'score')},
       {six('d.delta', 'engagement_delta')}, d.under_n AS undercut_cnt, d.stance AS price_position
FROM (SELECT *, row_number() OVER (PARTITION BY sku ORDER BY w_end DESC) AS rn FROM duel WHERE w_end > {ago(day=1)}) d
LEFT JOIN product p ON p.sku = d.sku WHERE rn = 1 ORDER BY d.score DESC, d.sku LIMIT 5"""
SQL["signal_kpis"] = f"""
SELECT count(*) AS total_signals, count(*) FILTER (level = 1) AS high_priority, count(*) FILTER (kind = 'UNDERCUT') AS undercuts,
       count(*) FILTER (kind = 'OVERPRICED') AS overpriced, count(*) FILTER (kind = 'STOCKOUT') AS stockouts,
       count(*) FILTER (kind = 'PRICE_INCREASE_24H') AS increases_24h,
       {six('coalesce(' + mean_c("CASE WHEN kind = 'UNDERCUT' THEN gap_h END") + ', 0)', 'avg_undercut')},
       {six('coalesce(' + mean_c("CASE WHEN kind = 'OVERPRICED' THEN gap_h END") + ', 0)', 'avg_overpriced')},
       {six('count(*) FILTER (level = 1) / count(*) * 100', 'high_priority_pct')} FROM card"""
SQL["market_kpis"] = f"""
SELECT count(*) FILTER (gap_h > 0) AS competitor_cheaper, count(*) FILTER (gap_h < 0) AS we_cheapest,
       {six(mean_c('CASE WHEN gap_h > 0 THEN gap_h END'), 'avg_gap_undercut')}, {six('avg(rivals)', 'avg_competitors')} FROM posture"""
for _name, _level in {"priority_queue_high": 1, "priority_queue_medium": 2}.items():
    SQL[_name] = f"SELECT {CARD} FROM (SELECT * FROM card WHERE level = {_level} ORDER BY tick DESC, sku, rival_id, kind LIMIT 5)"
SQL["signal_type_counts"] = "SELECT shown AS signal_display, count(*) AS signals FROM card GROUP BY 1"
SQL["signal_category_counts"] = "SELECT category, shown AS signal_display, count(*) AS signals FROM card GROUP BY ALL"
EXPOSURE = f"""SELECT m.sku AS product_sku, coalesce(p.name || ' (' || m.sku || ')', m.sku) AS product_label, p.category,
       r.name AS cheapest_competitor_name, {POSTURE.replace(' tick AS', ' m.tick AS')}"""
JOINS = "LEFT JOIN product p ON p.sku = m.sku LEFT JOIN rival r ON r.id = m.rival_id"
SQL["market_exposure"] = f"{EXPOSURE} FROM posture m {JOINS}"
SQL["market_leaderboard"] = f"""
{EXPOSURE} FROM (SELECT * FROM posture ORDER BY gap_h DESC NULLS LAST, sku LIMIT 20) m {JOINS}"""
SQL["market_leaderboard_undercut"] = f"""
{EXPOSURE} FROM (SELECT * FROM posture WHERE gap_h > 0 ORDER BY gap_h DESC, sku LIMIT 20) m {JOINS}"""
SQL["top_undercutters"] = """
SELECT rival AS competitor_name, count(*) AS undercuts FROM card WHERE kind = 'UNDERCUT' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5"""
SQL["filter_categories"] = f"""
SELECT sku AS product_sku, rival_id AS cheapest_competitor_id, {POSTURE} FROM posture
WHERE sku IN (SELECT sku FROM product WHERE category IN ('ECONOMY', 'LARGE', 'PROMO'))"""
SQL["all_categories"] = "SELECT category FROM card UNION SELECT category FROM product"
SQL["trend_snapshot"] = f"""
SELECT dir AS trend_direction, count(*) AS windows FROM direction WHERE w + INTERVAL 5 MINUTE > {ago(day=1)} GROUP BY 1"""

# ---- trends page ----------------------------------------------------------------------
SQL["recent_trends"] = f"""
SELECT sku AS product_sku, rival_name AS competitor_code, w AS window_start, w + INTERVAL 5 MINUTE AS window_end,
       {dollars('avg_c', 'avg_price')}, {dollars('vol_c', 'price_volatility')}, dir AS trend_direction
FROM direction WHERE w + INTERVAL 5 MINUTE > {ago(day=1)} AND rival_name = 'Supplier#000000001'"""
SQL["trend_shares"] = f"""
SELECT u AS windows_up, d AS windows_down, s AS windows_stable, {six('u / n * 100', 'up_pct')}, {six('d / n * 100', 'down_pct')},
       {six('greatest(0, 100 - u / n * 100 - d / n * 100)', 'stable_pct')}
FROM (SELECT count(*) FILTER (dir = 'up') AS u, count(*) FILTER (dir = 'down') AS d, count(*) FILTER (dir = 'stable') AS s,
             count(*) AS n FROM drift)"""
MOVER = f"""sku AS product_sku, rival_name AS competitor_code, {dollars('first_c', 'first_price')}, {dollars('last_c', 'last_price')},
       {dollars('last_c - first_c', 'net_change')}, {six('pct', 'pct_change')}"""
SQL["price_movers"] = f"SELECT {MOVER} FROM mover"
SQL["top_gainers"] = f"SELECT {MOVER} FROM mover ORDER BY pct DESC, sku, rival_name LIMIT 5"
SQL["top_decliners"] = f"SELECT {MOVER} FROM mover ORDER BY pct, sku, rival_name LIMIT 5"
SQL["volatility_ranking"] = SQL["volatility_by_pair"] = f"""
SELECT sku AS product_sku, rival_name AS competitor_code, {six(mean_c('vol_c'), 'price_volatility')} FROM drift GROUP BY ALL"""
SQL["hourly_prices"] = f"""
SELECT sku AS product_sku, rival_name AS competitor_code, date_trunc('hour', w_end) AS hour, {six(mean_c('avg_c'), 'avg_price')}
FROM drift GROUP BY ALL"""
SQL["hourly_price_pivot"] = (
    "SELECT sku || ' | ' || rival_name AS product_competitor, "
    + ", ".join(
        six(mean_c(f"CASE WHEN date_trunc('hour', w_end) = TIMESTAMP '2024-01-{d:02d} {h:02d}:00:00' THEN avg_c END"), f'"2024-01-{d:02d} {h:02d}:00"')
        for d in range(1, 5)
        for h in range(24)
    )
    + " FROM drift GROUP BY 1"
)
SQL["recent_movements"] = f"SELECT {MOVE_COLUMNS}, code AS competitor_code, {win5('tick')} AS bucket_5m FROM jump"
SQL["movement_counts"] = f"SELECT {win5('tick')} AS bucket_5m, dir AS direction, count(*) AS movements FROM jump GROUP BY ALL"
SQL["movement_direction_counts"] = "SELECT dir AS direction, count(*) AS movements FROM jump GROUP BY ALL"
SQL["movement_histogram"] = hist("jump", "abs(change_h) / 100", 30)
SQL["latest_movements"] = f"""
SELECT tick AS event_time, sku AS product_sku, code AS competitor_code, {dollars('was', 'previous_price')}, {dollars('price', 'new_price')},
       {dollars('change_h', 'pct_change')}, dir AS direction
FROM (SELECT * FROM jump ORDER BY tick DESC, sku, code, price, was LIMIT 500)"""
SQL["movements_of_selection"] = SQL["recent_movements"] + " WHERE code IN ('supplier#000000000', 'supplier#000000002')"
SQL["movements_or_all"] = SQL["recent_movements"]

# ---- signals page ---------------------------------------------------------------------
SQL["triage"] = f"""
SELECT tick AS signal_timestamp, product AS product_name, sku AS product_sku, category, rival AS competitor_name,
       shown AS signal_display, {big('level', 'priority')}, {dollars('ours', 'platform_price')}, {dollars('price', 'competitor_price')},
       {dollars('gap_h', 'percentage_diff')}, advice AS recommendation FROM card
WHERE category IN ('ECONOMY', 'LARGE', 'PROMO') AND kind <> 'STOCKOUT' AND level IN (1, 2) AND abs(gap_h) >= 300"""
SQL["signal_page_kpis"] = f"""
SELECT count(*) AS total_signals, count(*) FILTER (level = 1) AS high_priority,
       {six('count(*) FILTER (level = 1) / count(*) * 100', 'high_priority_pct')},
       {six(mean_c("CASE WHEN kind = 'UNDERCUT' THEN gap_h END"), 'avg_undercut_gap')},
       {six(mean_c("CASE WHEN kind = 'OVERPRICED' THEN gap_h END"), 'avg_overpriced_gap')},
       count(DISTINCT sku) AS products_affected,
       (SELECT count(*) FROM (SELECT sku FROM card WHERE kind = 'UNDERCUT' GROUP BY sku HAVING count(*) >= 2)) AS repeat_undercut_products
FROM card"""
SQL["signals_by_competitor"] = """
SELECT rival AS competitor_name, count(*) AS signals FROM card GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20"""
SQL["signals_per_hour"] = """
SELECT h.hour, count(c.sku) AS signals
FROM (SELECT unnest(generate_series(date_trunc('hour', min(tick)), date_trunc('hour', max(tick)), INTERVAL 1 HOUR)) AS hour FROM card) h
LEFT JOIN card c ON date_trunc('hour', c.tick) = h.hour GROUP BY 1"""
SQL["latest_signal_per_competitor"] = f"""
SELECT sku AS product_sku, product AS product_name, rival_id AS competitor_id, rival AS competitor_name,
       {dollars('price', 'competitor_price')}, {dollars('ours', 'platform_price')}, shown AS signal_display, tick AS signal_timestamp
FROM (SELECT *, row_number() OVER (PARTITION BY sku, rival_id ORDER BY tick DESC, kind DESC) AS pos FROM card) WHERE pos = 1"""
SQL["competitor_aggression"] = f"""
SELECT rival AS competitor_name, count(*) AS signals, count(*) FILTER (kind = 'UNDERCUT') AS undercuts,
       {six("count(*) FILTER (kind = 'UNDERCUT') / (SELECT count(*) FROM card) * coalesce(" + mean_c("CASE WHEN kind = 'UNDERCUT' THEN gap_h END") + ", 0)", 'aggression')}
FROM card GROUP BY 1"""
SQL["top_affected_products"] = f"""
SELECT rival AS competitor_name, rank, sku AS product_sku, product || ' (' || sku || ')' AS product_label,
       {dollars('gap_h', 'percentage_diff')}, shown AS signal_display
FROM (SELECT *, row_number() OVER (PARTITION BY rival ORDER BY abs(gap_h) DESC, sku) AS rank
      FROM (SELECT *, row_number() OVER (PARTITION BY rival, sku ORDER BY tick DESC, kind DESC) AS pos FROM card) WHERE pos = 1)
WHERE rank <= 20"""
SQL["competitor_signal_mix"] = "SELECT rival AS competitor_name, shown AS signal_display, count(*) AS signals FROM card GROUP BY ALL"
SQL["product_signal_history"] = f"""
SELECT sku AS product_sku, tick AS signal_timestamp, rival AS competitor_name, shown AS signal_display,
       {dollars('price', 'competitor_price')}, {dollars('gap_h', 'percentage_diff')}, {big('level', 'priority')}, advice AS recommendation FROM card"""

# ---- competitor page ------------------------------------------------------------------
SQL["price_gaps"] = f"""
SELECT rival_id AS competitor_id, code AS competitor_name, rival AS competitor_full_name, category, sku AS product_sku,
       product AS product_name, {dollars('price', 'competitor_price')}, {dollars('ours', 'our_price')},
       {six('diff', 'price_diff_percent')}, stock AS in_stock, data_at AS data_timestamp FROM gap"""
SQL["price_gaps_by_day"] = SQL["price_gaps"]
SQL["competitor_kpis"] = f"""
SELECT code AS competitor_name, any_value(rival) AS competitor_full_name, count(DISTINCT sku) AS products_tracked,
       {six('avg(diff)', 'avg_gap_pct')}, count(*) FILTER (diff <= -5) AS undercut_count,
       {six('count(*) FILTER (diff <= -5) / count(*) * 100', 'undercut_pct')},
       {six('count(*) FILTER (diff < 0) / count(*) * 100', 'cheaper_pct')},
       {six('count(*) FILTER (diff > 0) / count(*) * 100', 'pricier_pct')},
       {six('count(*) FILTER (diff <= -5) / count(*) * coalesce(avg(abs(diff)) FILTER (diff <= -5), 0)', 'aggression')}
FROM gap GROUP BY code"""
SQL["category_competitor_prices"] = f"""
SELECT category, code AS competitor_name, {six(mean_c('price'), 'competitor_avg_price')}, {six('avg(diff)', 'price_diff_percent')},
       count(DISTINCT sku) AS product_count FROM gap GROUP BY ALL"""
SQL["our_category_prices"] = f"""
SELECT category, {six(mean_c('ours'), 'our_price')} FROM (SELECT DISTINCT category, sku, ours FROM gap) GROUP BY 1"""
SQL["category_price_comparison"] = f"""
SELECT category, code AS competitor_name, {six(mean_c('price'), 'competitor_avg_price')} FROM gap GROUP BY ALL
UNION ALL SELECT category, 'Our Prices', {six(mean_c('ours'), 'x')} FROM (SELECT DISTINCT category, sku, ours FROM gap) GROUP BY 1"""
SQL["gap_distribution"] = f"""
SELECT code AS competitor_name, {six('avg(diff)', 'mean_diff')}, {six('min(diff)', 'min_diff')}, {six('max(diff)', 'max_diff')},
       {six('stddev_samp(diff)', 'std_diff')}, count(*) FILTER (diff < 0) AS cheaper, count(*) FILTER (diff > 0) AS dearer,
       {six('median(diff)', 'median_diff')}, {six('count(*) FILTER (diff < 0) / count(*) * 100', 'cheaper_pct')},
       {six('count(*) FILTER (diff > 0) / count(*) * 100', 'dearer_pct')} FROM gap GROUP BY code"""
SQL["gap_histogram"] = hist("(SELECT code AS competitor_name, diff FROM gap)", "diff", 50, "competitor_name")
SQL["top_undercut_products"] = f"""
SELECT code AS competitor_name, sku AS product_sku, product AS product_name, {dollars('price', 'competitor_price')},
       {dollars('ours', 'our_price')}, {six('diff', 'price_diff_percent')}, rank
FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY diff, sku) AS rank
      FROM (SELECT *, row_number() OVER (PARTITION BY code, sku ORDER BY diff, data_at) AS pos FROM gap WHERE diff <= -5)
      WHERE pos = 1) WHERE rank <= 10"""
SQL["price_history_comparison"] = f"""
SELECT sku AS product_sku, product AS product_name, code AS competitor_name, {dollars('price', 'competitor_price')},
       {dollars('ours', 'our_price')}, data_at AS data_timestamp FROM gap WHERE code IN ('supplier#000000000', 'supplier#000000002')"""

# ---- demand page ----------------------------------------------------------------------
SQL["dvs_enriched"] = f"""
SELECT sku AS product_sku, w AS window_start, w_end AS window_end, {DUEL}, name, category, shown AS product_label FROM board"""
SQL["filter_by_competitor_signals"] = f"""
SELECT sku AS product_sku, w AS window_start, w_end AS window_end, {DUEL} FROM duel
WHERE sku IN (SELECT sku FROM live_signal WHERE tick > {ago(day=1)} AND rival_id IN (1, 3))"""
SQL["dvs_kpis"] = f"""
SELECT {six('avg(delta)', 'avg_engagement_delta')}, {big('sum(under_n)', 'total_undercuts')}, {six('avg(score)', 'avg_score')},
       {", ".join(six(f"count(*) FILTER (stance = '{s}') / count(*) * 100", s + '_pct') for s in ('competitor_cheaper', 'we_cheaper', 'unknown'))}
FROM board"""
SQL["score_over_time"] = f"SELECT w_end AS window_end, {six('avg(score)', 'score')} FROM board GROUP BY 1"
SQL["engagement_by_category"] = f"""
SELECT category, w_end AS window_end, {six('avg(delta)', 'engagement_delta')} FROM board WHERE category IS NOT NULL GROUP BY 1, 2"""
SQL["top_scored"] = f"""
SELECT sku AS product_sku, shown AS product_label, {six('score', 'score')}, {six('delta', 'engagement_delta')},
       under_n AS undercut_cnt, stance AS price_position FROM (SELECT * FROM board_last ORDER BY score DESC, sku LIMIT 15)"""
SQL["risk_triage"] = f"""
SELECT sku AS product_sku, shown AS product_label, {six('delta', 'engagement_delta')}, under_n AS undercut_cnt,
       {dollars('under_h', 'avg_undercut_gap_pct')}, {six('score', 'score')}, w_end AS window_end
FROM (SELECT * FROM board_last WHERE stance = 'competitor_cheaper' ORDER BY delta, sku LIMIT 15)"""
SQL["category_impact"] = f"SELECT category, {six('avg(score)', 'score')} FROM board WHERE category IS NOT NULL GROUP BY 1"
SQL["dvs_details"] = f"""
SELECT sku AS product_sku, w AS window_start, w_end AS window_end, {six('delta', 'engagement_delta')}, under_n AS undercut_cnt,
       {dollars('under_h', 'avg_undercut_gap_pct')}, {dollars('rise_h', 'avg_abrupt_inc_gap_pct')},
       {dollars('over_h', 'avg_overpriced_gap_pct')}, stance AS price_position, {six('score', 'score')} FROM board"""

# ---- elasticity page ------------------------------------------------------------------
MOOD = f"{six('e', 'price_elasticity')}, label AS price_sensitivity, {big('n', 'observations')}"
SQL["sensitivity_history"] = f"SELECT sku, {MOOD}, tick AS updated_at, name, category FROM mood"
SQL["sensitivity_kpis"] = """
SELECT count(label) AS products_with_sensitivity, count(*) FILTER (label = 'high') AS high, count(*) FILTER (label = 'medium') AS medium,
       count(*) FILTER (label = 'low') AS low, max(label_at) AS last_updated FROM product WHERE live AND stocked"""
SQL["observation_count"] = f"""
SELECT count(*) AS observations FROM seen WHERE tick > {ago(hour=24)} AND sku IN (SELECT sku FROM product WHERE live AND stocked)"""
SQL["elasticity_over_time"] = f"SELECT tick AS updated_at, {six('avg(e)', 'price_elasticity')} FROM mood GROUP BY 1"
SQL["elasticity_per_sku"] = f"SELECT sku, tick AS updated_at, {MOOD} FROM mood"
SQL["elasticity_histogram"] = hist("mood", "e", 40)
SQL["elasticity_by_category"] = f"SELECT category, {six('avg(e)', 'price_elasticity')} FROM mood WHERE category IS NOT NULL GROUP BY 1"
SQL["recent_sensitivity"] = f"""
SELECT tick AS updated_at, sku, name, category, {MOOD} FROM (SELECT * FROM mood ORDER BY tick DESC, sku, e, n LIMIT 500)"""

# ---- adjustments page -----------------------------------------------------------------
SQL["search_proposals"] = f"""
SELECT id, sku, status, created AS created_at, approved AS approved_at, NULL::TIMESTAMP AS applied_at, {dollars('old_c', 'old_price')},
       {dollars('new_c', 'proposed_price')}, {six('-1', 'elasticity_used')}, {six('profit_d', 'expected_profit_delta')},
       {six('demand_d', 'expected_demand_delta')}, {six('gap_after', 'competitor_gap_after')}, {six('score', 'score')}, reason AS reason_code
FROM (SELECT * FROM offer WHERE status IN ('pending', 'approved') AND created >= TIMESTAMP '2023-12-28 00:00:00' AND sku ILIKE '%sku-%'
      )"""
SQL["recent_runs"] = f"""
SELECT {big('id', 'id')}, started AS started_at, finished AS finished_at, n AS candidates_count, ok AS proposed_count,
       'price-proposer' AS created_by,
       CASE WHEN wide THEN 'price_grid_pct=0.05, target_undercut_pct=0.01' ELSE 'price_grid_pct=0.05' END AS params
FROM job"""
SQL["recent_price_changes"] = f"""
SELECT sku, {dollars('old_c', 'old_price')}, {dollars('new_c', 'adjusted_price')}, 'proposal_apply' AS change_type,
       'price-applier' AS changed_by, tick AS change_timestamp, id AS proposal_id FROM repriced WHERE tick >= {ago(hour=24)}"""
SQL["proposal_kpis"] = f"""
SELECT count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'approved') AS approved,
       count(*) FILTER (reason = 'elasticity+forecast') AS forecast_guided, count(*) FILTER (reason = 'elasticity-only') AS elasticity_only,
       {six('avg(profit_d)', 'avg_profit_delta')}, {six('avg(demand_d)', 'avg_demand_delta')},
       (SELECT ok FROM job ORDER BY started DESC, id DESC LIMIT 1) AS last_run_proposals,
       (SELECT count(*) FROM repriced WHERE tick >= {ago(hour=24)}) AS applied_recently FROM offer"""
SQL["forecast_kpis"] = f"""
SELECT count(*) AS rows, {six('avg(mae)', 'mean_cv_mae')}, {six('avg(base)', 'mean_baseline_mae')},
       {six('avg(1 - mae / base)', 'avg_improvement')} FROM recent_quality WHERE good"""
for _name, _key, _alias in (("forecast_by_sku", "sku", "sku"), ("forecast_by_competitor", "rival_id", "competitor_id")):
    SQL[_name] = f"""
SELECT {_key} AS {_alias}, count(*) AS n_rows, {six('avg(mae)', 'cv_mae')}, {six('avg(base)', 'baseline_mae')},
       {six('(1 - avg(mae) / avg(base)) * 100', 'improvement')} FROM recent_quality WHERE good GROUP BY 1"""
SQL["mae_by_sku"] = f"""
SELECT sku, {six('avg(mae)', 'mean_cv_mae')}, {six('avg(base)', 'mean_baseline_mae')},
       {six('(1 - avg(mae) / avg(base)) * 100', 'improvement_pct')} FROM quality WHERE samples > 0 AND good GROUP BY 1"""
SQL["mae_by_sku_long"] = f"""
SELECT sku, 'mean_cv_mae' AS metric, {six('avg(mae)', 'value')} FROM quality WHERE samples > 0 AND good GROUP BY 1
UNION ALL SELECT sku, 'mean_baseline_mae', {six('avg(base)', 'value')} FROM quality WHERE samples > 0 AND good GROUP BY 1"""
SQL["platform_price_series"] = f"SELECT sku, ts, {dollars('price', 'adjusted_price')} FROM our_line"
SQL["platform_price_steps"] = f"""
WITH m AS (SELECT sku, ts, price, row_number() OVER w AS n FROM our_line WINDOW w AS (PARTITION BY sku ORDER BY ts)),
moved AS (SELECT DISTINCT g.sku, g.ts FROM our_line g JOIN repriced h ON h.sku = g.sku AND h.tick > {ago(day=2)}
          AND h.tick > g.ts - INTERVAL 15 MINUTE AND h.tick <= g.ts AND h.new_c IS NOT NULL),
s AS (SELECT m.*, (n = 1 OR moved.ts IS NOT NULL) AS new FROM m LEFT JOIN moved USING (sku, ts)),
g AS (SELECT *, sum(new::INT) OVER (PARTITION BY sku ORDER BY ts) AS step FROM s)
SELECT sku, min(ts) AS ts_from, max(ts) AS ts_to, {dollars('any_value(price)', 'adjusted_price')} FROM g GROUP BY sku, step"""
SQL["competitor_price_series"] = f"""
SELECT sku, rival_id AS competitor_id, series, ts, {six('avg_p', 'avg_price')} FROM their_line"""
SQL["proposal_steps"] = f"""
SELECT sku, ts, {dollars('new_c', 'price')}, status, false AS closing FROM step_point
UNION ALL SELECT sku, {NOW}, {dollars('new_c', 'price')}, status, true
FROM (SELECT *, row_number() OVER (PARTITION BY sku ORDER BY ts DESC, id DESC) AS rn FROM step_point) WHERE rn = 1"""
SQL["upcoming_proposals"] = f"""
SELECT id, sku, coalesce(from_at, created) AS ts, {dollars('old_c', 'old_price')}, {dollars('new_c', 'proposed_price')}, status
FROM offer WHERE status = 'approved' AND coalesce(from_at, created) >= {ago(minute=5)}"""
SQL["series_overlap"] = """
WITH o AS (SELECT sku, min(ts) AS a, max(ts) AS b FROM our_line GROUP BY 1),
c AS (SELECT sku, min(ts) AS a, max(ts) AS b FROM their_line GROUP BY 1),
j AS (SELECT coalesce(o.sku, c.sku) AS sku,
             CASE WHEN o.sku IS NULL THEN c.a WHEN c.sku IS NULL THEN o.a ELSE greatest(o.a, c.a) END AS s,
             CASE WHEN o.sku IS NULL THEN c.b WHEN c.sku IS NULL THEN o.b ELSE least(o.b, c.b) END AS e,
             o.sku IS NOT NULL AND c.sku IS NOT NULL AND greatest(o.a, c.a) >= least(o.b, c.b) AS apart
      FROM o FULL JOIN c ON o.sku = c.sku),
l AS (SELECT sku, max(ts) AS t FROM step_point GROUP BY 1)
SELECT coalesce(j.sku, l.sku) AS sku, CASE WHEN NOT apart THEN s END AS domain_start,
       CASE WHEN apart OR e IS NULL OR t > e THEN t ELSE e END AS domain_end FROM j FULL JOIN l ON l.sku = j.sku"""
SQL["adjusted_skus"] = f"SELECT sku FROM offer UNION SELECT sku FROM repriced WHERE tick >= {ago(hour=24)}"

# ---- streaming: what the watermark has closed when the input ends ---------------------
PRICE_MARK = "(SELECT max(tick) - INTERVAL 10 MINUTE FROM quote)"
SQL["stream_price_trends"] = SQL["price_trends"] + f" WHERE w + INTERVAL 5 MINUTE <= {PRICE_MARK}"
SQL["stream_behavior_summary"] = (
    SQL["behavior_summary"] + " WHERE w_end <= (SELECT max(tick) - INTERVAL 5 MINUTE FROM visit)"
)
SQL["stream_price_movements"] = SQL["price_movements"] + f" WHERE tick < {PRICE_MARK}"
SQL["stream_price_increases"] = SQL["price_increase_signals"] + f" WHERE tick < {PRICE_MARK}"

CLOSED = f"WHERE tick < {PRICE_MARK}"
SQL["stream_current_signals"] = f"""
SELECT {SIGNAL_COLUMNS} FROM (
  SELECT *, row_number() OVER (PARTITION BY sku, rival_id, kind ORDER BY tick DESC, price DESC, stock DESC) AS rn
  FROM (SELECT * FROM under {CLOSED} UNION ALL SELECT * FROM over {CLOSED} UNION ALL SELECT * FROM out {CLOSED}
        UNION ALL SELECT * FROM rise {CLOSED})) WHERE rn = 1"""
SQL["stream_market_summary"] = SQL["product_market_summary"]
CTE["standing"] = """
SELECT q.*, l.price AS ours, p.label, p.stocked, p.live, r.id AS rival_id
FROM newest q JOIN living l ON l.sku = q.sku JOIN product p ON p.sku = q.sku JOIN rival r ON lower(q.rival_name) = r.code"""
CTE["under_now"] = signal(
    "UNDERCUT", ratio13("ours - price", "ours"),
    ("URGENT: Competitor undercutting by {}%", "Consider price adjustment: {}% undercut", "Monitor: {}% undercut"),
    (1, 2, 3), "price < ours", "standing",
)
CTE["over_now"] = signal(
    "OVERPRICED", ratio13("price - ours", "ours"),
    ("Opportunity: We are {}% cheaper", "Good position: {}% cheaper", "Competitive: {}% cheaper"),
    (2, 3, 3), f"price > ours AND q > 500000000000 AND stock AND {OURS}", "standing",
)
CTE["out_now"] = signal(
    "STOCKOUT", "0::HUGEINT",
    ("URGENT: Competitor out of stock - opportunity to capture market",
     "Competitor out of stock - consider inventory management", "Competitor out of stock"),
    (1, 2, 3), f"NOT stock AND {OURS}", "standing",
)
SQL["stream_pair_signals"] = f"""
SELECT {SIGNAL_COLUMNS} FROM (SELECT * FROM under_now UNION ALL SELECT * FROM over_now UNION ALL SELECT * FROM out_now)"""
SQL["stream_dims"] = f"""
SELECT 'products' AS source, sku AS row_key, {dollars('price', 'amount')}, label, op_ts FROM (SELECT l.*, p.label FROM living l JOIN product p USING (sku))
UNION ALL
SELECT 'competitors', id::VARCHAR, id::DOUBLE, name, TIMESTAMP '2024-01-01 00:00:00' + to_minutes(turn) FROM (
  SELECT s_suppkey % 5 AS id, max(s_suppkey) AS turn, arg_max(s_name, s_suppkey) AS name FROM supplier GROUP BY 1) WHERE turn % 7 <> 0
UNION ALL
SELECT 'behavior', sku || '|' || epoch(w)::BIGINT::VARCHAR, views::DOUBLE, sku, w_end FROM shopping WHERE bought % 3 <> 0
UNION ALL
SELECT 'signals', sku || '|' || rival_id::VARCHAR || '|' || kind, {six('price / 100', 'amount')}, kind || CASE WHEN level = 1 THEN '|false' ELSE '|true' END,
       CASE WHEN level = 1 THEN tick + INTERVAL 1 MINUTE ELSE tick END FROM live_signal"""
SQL["stream_price_history"] = SQL["competitor_price_history"] + f" WHERE {win5('data_at')} + INTERVAL 5 MINUTE <= {PRICE_MARK}"
SQL["stream_trends_table"] = SQL["stream_price_trends"]
SQL["source_prices_latest"] = SQL["source_prices"] + " WHERE (api_ms // 1000) % 3 <> 0"
SIGNAL_MARK = "(SELECT max(tick) - INTERVAL 5 MINUTE FROM live_signal)"
SQL["stream_signal_windows"] = SQL["signal_windows"] + f" WHERE w + INTERVAL 5 MINUTE <= {SIGNAL_MARK}"
VISIT_MARK = "(SELECT max(tick) - INTERVAL 5 MINUTE FROM visit)"
SQL["stream_demand_vs_signals"] = SQL["demand_vs_signals"] + f" WHERE w_end <= least({SIGNAL_MARK}, {VISIT_MARK})"


def _needed(sql: str) -> list[str]:
    """Expressions a statement names, dependencies first."""
    order: list[str] = []

    def visit(text: str) -> None:
        for name in CTE:
            if name not in order and re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", text):
                visit(CTE[name])
                order.append(name)

    visit(sql)
    return [n for n in CTE if n in order]


def statement(name: str) -> str:
    sql = SQL[name]
    shared = ", ".join(f"{n} AS ({CTE[n]})" for n in _needed(sql))
    return f"WITH {shared} SELECT * FROM ({sql})" if shared else sql


def statements() -> dict[str, str]:
    return {name: statement(name) for name in SQL}
