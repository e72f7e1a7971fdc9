"""Shared SQL building blocks of the comparison queries (name -> needed blocks, text)."""

from __future__ import annotations

_PRICE = "CAST(floor(l_extendedprice/l_quantity*1e6+0.5) AS BIGINT)"
_QUOTES = f"""sum({_PRICE})/(count(*)*1e6) AS mid, min({_PRICE})/1e6 AS bid, max({_PRICE})/1e6 AS ask,
 (sum(CAST(floor(l_discount*1e6+0.5) AS BIGINT))-sum(CAST(floor(l_tax*1e6+0.5) AS BIGINT)))/(count(*)*1e6) AS points"""
_CODE = "'N'||lpad(CAST({} AS VARCHAR),2,'0')"

CTES: dict[str, tuple[str, str]] = {
    "qd": ("", f"""SELECT CAST(l_shipdate AS DATE) AS date, {_CODE.format('s_nationkey')} AS asset, {_QUOTES}
 FROM lineitem JOIN supplier ON l_suppkey=s_suppkey GROUP BY 1,2"""),
    "qm": ("", f"""SELECT last_day(CAST(l_shipdate AS DATE)) AS month_end, {_CODE.format('s_nationkey')} AS asset, {_QUOTES}
 FROM lineitem JOIN supplier ON l_suppkey=s_suppkey GROUP BY 1,2"""),
    "wu": ("", f"""SELECT last_day(CAST(l_shipdate AS DATE)) AS month_end, l_partkey AS asset, {_QUOTES}
 FROM lineitem GROUP BY 1,2"""),
    "om": ("", f"""SELECT last_day(CAST(o_orderdate AS DATE)) AS month_end, {_CODE.format('c_nationkey')} AS asset,
 sum(CAST(floor(o_totalprice*100+0.5) AS BIGINT))/(count(*)*100.0::DOUBLE) AS value
 FROM orders JOIN customer ON o_custkey=c_custkey GROUP BY 1,2"""),
    "od": ("", """SELECT CAST(o_orderdate AS DATE) AS date,
 sum(CAST(floor(o_totalprice*100+0.5) AS BIGINT))/(count(*)*100.0::DOUBLE) AS value FROM orders GROUP BY 1"""),
    "ed": ("", """SELECT CAST(ts AS DATE) AS date, user_id AS asset,
 sum(CAST(floor(value*100+0.5) AS BIGINT))/(count(*)*100.0::DOUBLE) AS value FROM events GROUP BY 1,2"""),
    "dim": ("", f"""SELECT {_CODE.format('n_nationkey')} AS asset, r_name AS bucket, n_nationkey%3=0 AS invert,
 CASE WHEN n_nationkey%2=0 THEN 0.01::DOUBLE ELSE 0.02::DOUBLE END AS point_scale
 FROM nation JOIN region ON n_regionkey=r_regionkey"""),
    "lq": ("qd", """SELECT date, asset||' Curncy' AS ticker, 'PX_LAST' AS field, mid AS value FROM qd
 UNION ALL SELECT date, asset||' Curncy', 'PX_BID', bid FROM qd
 UNION ALL SELECT date, asset||' Curncy', 'PX_ASK', ask FROM qd
 UNION ALL SELECT date, asset||'1M Curncy', 'PX_LAST', points FROM qd"""),
    "dense": ("qd dim", """SELECT c.date, dim.asset, bucket, invert, point_scale, mid, bid, ask, points
 FROM (SELECT DISTINCT date FROM qd) c CROSS JOIN (SELECT DISTINCT asset FROM qd) a
 JOIN dim ON dim.asset=a.asset LEFT JOIN qd ON qd.date=c.date AND qd.asset=a.asset"""),
    "conv": ("dense", """SELECT *, CASE WHEN invert THEN 1/mid ELSE mid END AS spot,
 CASE WHEN invert THEN 1/(mid+points/point_scale) ELSE mid+points/point_scale END AS fwd FROM dense"""),
    "dp": ("conv", """SELECT *, sret + lag(carry) OVER (PARTITION BY asset ORDER BY date)/252.0 AS xret FROM (
 SELECT *, ln(spot/fwd)*12.0 AS carry, ln(spot)-lag(ln(spot)) OVER (PARTITION BY asset ORDER BY date) AS sret FROM conv)"""),
    "mp0": ("qm dim", """SELECT month_end, dim.asset, bucket, CASE WHEN invert THEN 1/mid ELSE mid END AS spot,
 CASE WHEN invert THEN 1/(mid+points/point_scale) ELSE mid+points/point_scale END AS fwd, ask-bid AS spread, points
 FROM qm JOIN dim ON dim.asset=qm.asset"""),
    "mp": ("mp0", """SELECT a.*, a.spot/a.fwd-1 AS carry_signal, b.spot AS next_spot, b.spot/a.fwd-1 AS realized
 FROM mp0 a LEFT JOIN mp0 b ON b.asset=a.asset AND b.month_end=last_day(a.month_end + INTERVAL 1 MONTH)"""),
    "wp": ("wu", """SELECT a.month_end, a.asset, a.mid/(a.mid+a.points/0.01::DOUBLE)-1 AS signal,
 b.mid/(a.mid+a.points/0.01::DOUBLE)-1 AS ret
 FROM wu a LEFT JOIN wu b ON b.asset=a.asset AND b.month_end=last_day(a.month_end + INTERVAL 1 MONTH)"""),
    "pairs": ("", f"""SELECT {_CODE.format('n_nationkey')} AS asset, n_nationkey%4=0 AS foreign_is_base,
 CASE WHEN n_nationkey%4=0 THEN {_CODE.format('n_nationkey')}||'USD' ELSE 'USD'||{_CODE.format('n_nationkey')} END AS option_pair FROM nation"""),
    "ol": ("qd pairs", """SELECT date, option_pair||c.code||'1M Curncy' AS ticker, 'PX_LAST' AS field,
 CASE c.code WHEN 'V' THEN ask-bid WHEN '25R' THEN points*100 WHEN '25B' THEN points*10
 WHEN '10R' THEN points*200 ELSE points*20 END AS value
 FROM qd JOIN pairs ON pairs.asset=qd.asset CROSS JOIN (SELECT unnest(['V','25R','25B','10R','10B']) AS code) c"""),
    # per-bucket and overall daily tracks
    "bt": ("dp", """SELECT date, bucket AS track, avg(xret) AS ret FROM dp WHERE xret IS NOT NULL GROUP BY 1,2
 UNION ALL SELECT date, 'ALL', avg(xret) FROM dp WHERE xret IS NOT NULL GROUP BY 1"""),
}


def compose(use: str, body: str) -> str:
    """``WITH`` clause holding the named blocks and everything they need, then the body."""
    order: list[str] = []

    def need(name: str) -> None:
        if name in order:
            return
        for d in CTES[name][0].split():
            need(d)
        order.append(name)

    for n in use.split():
        need(n)
    if not order:
        return body.strip()
    blocks = ",\n".join(f"{n} AS ({CTES[n][1]})" for n in order)
    body = body.strip()
    if body[:5].upper() == "WITH ":
        return f"WITH {blocks},\n{body[5:]}"
    return f"WITH {blocks}\n{body}"
