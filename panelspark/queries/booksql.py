"""SQL text of the sorted book, its volatility target and its costs, with knobs."""

from __future__ import annotations

HS = """, hs0 AS (SELECT date, asset, greatest(((ask+pa/point_scale)-(bid+pb/point_scale))/(2*(mid+(pb+pa)/(2*point_scale))),0) AS o, greatest((pa-pb)/point_scale/(2*mid),0) AS p
 FROM (SELECT *, points-(ask-bid)/1e5 AS pb, points+(ask-bid)/1e5 AS pa FROM dense) WHERE mid IS NOT NULL UNION ALL SELECT date, asset, NULL, NULL FROM dense WHERE mid IS NULL),
 hs1 AS (SELECT date, asset, least(o, quantile_cont(o,0.99) OVER w) AS o, least(p, quantile_cont(p,0.99) OVER w) AS p FROM hs0 WINDOW w AS (PARTITION BY asset)),
 hs2 AS (SELECT date, asset, CASE WHEN o IS NULL THEN NULL ELSE o END AS o, CASE WHEN p IS NULL THEN NULL ELSE p END AS p FROM (SELECT h.date, h.asset, CASE WHEN r.o IS NULL THEN NULL ELSE h.o END AS o, CASE WHEN r.p IS NULL THEN NULL ELSE h.p END AS p FROM hs1 h JOIN hs0 r ON r.date=h.date AND r.asset=h.asset)),
 hs AS (SELECT date, asset, last_value(o IGNORE NULLS) OVER w AS hs_out, last_value(p IGNORE NULLS) OVER w AS hs_pts FROM hs2 WINDOW w AS (PARTITION BY asset ORDER BY date ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)),
 hsa AS (SELECT date, asset, last_value(hs_out IGNORE NULLS) OVER w AS o, last_value(hs_pts IGNORE NULLS) OVER w AS p FROM hs WINDOW w AS (PARTITION BY asset ORDER BY date ROWS UNBOUNDED PRECEDING)),
 hsm AS (SELECT asset, median(o) AS mo, median(p) AS mp FROM hsa GROUP BY 1),
 hsf AS (SELECT date, hsa.asset, coalesce(o,mo) AS hs_out, coalesce(p,mp) AS hs_pts FROM hsa JOIN hsm ON hsm.asset=hsa.asset)"""

LABELS = {"M": "last_day(date)", "W": "CAST(date + CAST((7-isodow(date)) AS INT) AS DATE)", "Q": "last_day(make_date(year(date), quarter(date)*3, 1))",
          "2W": "CAST(anchor + CAST(14*ceil((date-anchor)/14.0) AS INT) AS DATE)"}


def legs(p: str, src: str = "dp", key: str = "", signal: str = "carry", n: int | str = 3, vw: int = 60, least: int = 2, freq: str = "M", filt: str = "") -> str:
    k = f"{key}," if key else ""
    f, fl = (f", {filt} AS f", ", max_by(f, date) AS f") if filt else ("", "")
    keep = "(leg=1 AND f>=0) OR (leg=-1 AND f<=0)" if filt else "leg<>0"
    extra = ", (SELECT CAST(min(date)+CAST((7-isodow(min(date))) AS INT) AS DATE) AS anchor FROM qd) anc" if freq == "2W" else ""
    nb = f", max(nb) AS nb" if n == "nb" else ""
    return f""", {p}v AS (SELECT {k} date, asset, {signal} AS s{', nb' if n == 'nb' else ''}{f}, CASE WHEN count(xret) OVER w>={vw // 2} THEN stddev_samp(xret) OVER w END AS vol FROM {src} WINDOW w AS (PARTITION BY {k} asset ORDER BY date ROWS BETWEEN {vw - 1} PRECEDING AND CURRENT ROW)),
 {p}t AS (SELECT {k} {LABELS[freq]} AS label, asset, max_by(s,date) AS s, max_by(vol,date) AS vol{fl}{nb} FROM {p}v{extra} GROUP BY ALL),
 {p}r AS (SELECT *, count(*) OVER w AS n, row_number() OVER (PARTITION BY {k} label ORDER BY s, asset) AS lo, row_number() OVER (PARTITION BY {k} label ORDER BY s DESC, asset) AS hi FROM {p}t WHERE s IS NOT NULL AND vol>0 WINDOW w AS (PARTITION BY {k} label)),
 {p}a AS (SELECT *, n//{n} AS k, CASE WHEN hi<=n//{n} THEN 1 WHEN lo<=n//{n} THEN -1 ELSE 0 END AS leg FROM {p}r WHERE n//{n}>={least}),
 {p}l AS (SELECT * FROM {p}a WHERE {keep})"""


def weights(p: str, key: str = "", cap: float = 0.4, raw: str = "1/vol", src: str | None = None) -> str:
    k = f"{key}," if key else ""
    part = f"(PARTITION BY {k} label, leg)"
    src = src or f"{p}l"
    out = f", {p}c0 AS (SELECT *, ({raw})/sum({raw}) OVER {part} AS share FROM {src})"
    for i in range(10):
        out += f""", {p}c{i + 1} AS (SELECT * EXCLUDE (share), CASE WHEN max(share) OVER {part} > {cap}::DOUBLE+1e-12 THEN least(share,{cap}::DOUBLE)/sum(least(share,{cap}::DOUBLE)) OVER {part} ELSE share END AS share FROM {p}c{i})"""
    on = f"c.label=t.label AND c.asset=t.asset" + (f" AND c.{key}=t.{key}" if key else "")
    onl = "l.label=t.label" + (f" AND l.{key}=t.{key}" if key else "")
    tk = f"t.{key}," if key else ""
    return out + f""", {p}w AS (SELECT {tk} t.label, t.asset, coalesce(c.leg*c.share,0.0) AS weight FROM {p}t t SEMI JOIN {p}a l ON {onl} LEFT JOIN {p}c10 c ON {on})"""


def daily(p: str, key: str = "", lag: int = 1) -> str:
    k = f"{key}," if key else ""
    if key:
        eff = f"""SELECT {key}, date, lag(l,{lag}) OVER (PARTITION BY {key} ORDER BY date) AS label FROM (SELECT s.{key}, c.date, e.label AS l FROM (SELECT DISTINCT {key} FROM {p}w) s CROSS JOIN (SELECT DISTINCT date FROM dense) c
 ASOF LEFT JOIN (SELECT DISTINCT {key}, label FROM {p}w) e ON e.{key}=s.{key} AND e.label<=c.date)"""
    else:
        eff = f"""SELECT date, lag(l,{lag}) OVER (ORDER BY date) AS label FROM (SELECT c.date, e.label AS l FROM (SELECT DISTINCT date FROM dense) c ASOF LEFT JOIN (SELECT DISTINCT label FROM {p}w) e ON e.label<=c.date)"""
    on = f"w.label=e.label" + (f" AND w.{key}=e.{key}" if key else "")
    wk = f"w.{key}," if key else ""
    return f", {p}e AS ({eff}), {p}d AS (SELECT {wk} e.date, w.asset, w.weight FROM {p}w w JOIN {p}e e ON {on})"


def returns(p: str, w: str, out: str, key: str = "") -> str:
    k = f"{key}," if key else ""
    wk = f"w.{key}," if key else ""
    return f", {out} AS (SELECT {wk} w.date, sum(w.weight*dp.xret) AS ret FROM {w} w LEFT JOIN dp ON dp.date=w.date AND dp.asset=w.asset GROUP BY ALL)"


def target(p: str, key: str = "", tgt: float | str = 0.10, vw: int = 60, freq: str = "M") -> str:
    """From daily unit weights {p}d: unit returns {p}u, scalar {p}s and scaled weights {p}vt."""
    k = f"{key}," if key else ""
    extra = ", (SELECT CAST(min(date)+CAST((7-isodow(min(date))) AS INT) AS DATE) AS anchor FROM qd) anc" if freq == "2W" else ""
    part = f"PARTITION BY {key} " if key else ""
    onk = f" AND e.{key}=u.{key}" if key else ""
    onw = f" AND s.{key}=w.{key}" if key else ""
    uk, wk = (f"u.{key},", f"w.{key},") if key else ("", "")
    return returns(p, f"{p}d", f"{p}u", key) + f""", {p}q AS (SELECT {k} date, ret, CASE WHEN count(ret) OVER w>={vw // 2} THEN least({tgt}::DOUBLE/greatest(stddev_samp(ret) OVER w*sqrt(252.0),0.01),4.0) END AS sc FROM {p}u WINDOW w AS ({part}ORDER BY date ROWS BETWEEN {vw - 1} PRECEDING AND CURRENT ROW)),
 {p}x AS (SELECT {k} {LABELS[freq]} AS label, max_by(sc,date) AS sc FROM {p}q{extra} GROUP BY ALL),
 {p}s AS (SELECT {k} date, lag(sc) OVER ({part}ORDER BY date) AS scalar FROM (SELECT {uk} u.date, e.sc FROM {p}u u ASOF LEFT JOIN {p}x e ON e.label<=u.date{onk})),
 {p}vt AS (SELECT {wk} w.date, w.asset, w.weight*s.scalar AS weight FROM {p}d w JOIN {p}s s ON s.date=w.date{onw})"""


def costs(p: str, w: str, out: str, key: str = "") -> str:
    k = f"{key}," if key else ""
    return f""", {out}0 AS (SELECT {k} date, asset, coalesce(weight,0) AS weight, coalesce(lag(coalesce(weight,0)) OVER (PARTITION BY {k} asset ORDER BY date),0) AS prev FROM {w}),
 {out} AS (SELECT {k} c.date, coalesce(sum(abs(weight-prev)*hs_out),0)+CASE WHEN sum(abs(weight-prev))>0 THEN coalesce(sum(least(abs(weight),abs(prev))*hs_pts),0) ELSE 0 END AS cost FROM {out}0 c LEFT JOIN hsf ON hsf.date=c.date AND hsf.asset=c.asset GROUP BY ALL)"""


def book(p: str = "b", key: str = "", src: str = "dp", vw: int = 60, tgt: float | str = 0.10, freq: str = "M", cap: float = 0.4, raw: str = "1/vol", **kw) -> str:
    """Everything up to the volatility-targeted daily weights {p}vt."""
    return legs(p, src, key, vw=vw, freq=freq, **kw) + weights(p, key, cap, raw) + daily(p, key) + target(p, key, tgt, vw, freq)
