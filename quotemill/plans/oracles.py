"""SQL of the sequential operators, stated bar by bar as their rules are: recursive queries that carry the state."""

from __future__ import annotations

KW = "PARTITION BY symbol, source ORDER BY bar_time"


def ordered_sql(source: str, name: str = "o") -> str:
    """Bars with their number, flags of swings, and the last swings strictly before a bar (p*) and up to it (c*)."""
    past, upto = f"({KW} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)", f"({KW} ROWS UNBOUNDED PRECEDING)"
    return f"""{name}0 AS (SELECT *, row_number() OVER ({KW}) AS n, CASE WHEN is_swing_high THEN bar_high END AS sh, CASE WHEN is_swing_low THEN bar_low END AS sl FROM {source}),
 {name} AS MATERIALIZED (SELECT *, last_value(sl IGNORE NULLS) OVER {past} AS pl, last_value(sh IGNORE NULLS) OVER {past} AS ph,
   last_value(sl IGNORE NULLS) OVER {upto} AS cl, last_value(sh IGNORE NULLS) OVER {upto} AS ch, min(sl) OVER {past} AS lowest, max(sh) OVER {past} AS highest,
   max(CASE WHEN sl IS NOT NULL THEN n END) OVER {upto} AS cl_n, max(CASE WHEN sh IS NOT NULL THEN n END) OVER {upto} AS ch_n FROM {name}0)"""


def structure_sql(mode: str, o: str = "o", name: str = "st") -> str:
    """One row for each bar: the trend, levels and events after it.  Needs WITH RECURSIVE."""
    start = f"SELECT symbol, source, 0::BIGINT AS n, NULL::VARCHAR AS trend, NULL::DOUBLE AS hh, NULL::DOUBLE AS ll, NULL::DOUBLE AS lo, NULL::DOUBLE AS hi, false AS up, false AS down, false AS turn_up, false AS turn_down FROM {o} GROUP BY 1, 2"
    # The bar's swings first: a high may raise hh unless the trend is down, a low may lower ll unless it is up.
    taken = f"""SELECT r.symbol, r.source, r.n, trend, r.bar_close AS c, r.cl, r.ch, r.lowest, r.highest,
      CASE WHEN r.sh IS NOT NULL AND coalesce(trend, 'bull') = 'bull' AND (hh IS NULL OR r.sh > hh) THEN r.sh ELSE hh END AS hh,
      CASE WHEN r.sh IS NOT NULL AND coalesce(trend, 'bull') = 'bull' AND (hh IS NULL OR r.sh > hh) THEN coalesce(r.pl, lo) ELSE lo END AS lo,
      CASE WHEN r.sl IS NOT NULL AND coalesce(trend, 'bear') = 'bear' AND (ll IS NULL OR r.sl < ll) THEN r.sl ELSE ll END AS ll,
      CASE WHEN r.sl IS NOT NULL AND coalesce(trend, 'bear') = 'bear' AND (ll IS NULL OR r.sl < ll) THEN coalesce(r.ph, hi) ELSE hi END AS hi
     FROM {name} s JOIN {o} r ON r.symbol = s.symbol AND r.source = s.source AND r.n = s.n + 1"""
    if mode == "bos":
        step = f"""SELECT symbol, source, n, CASE WHEN coalesce(c < ll, false) THEN 'bear' WHEN coalesce(c > hh, false) THEN 'bull' ELSE trend END, hh, ll,
      CASE WHEN c > hh THEN coalesce(cl, lo) ELSE lo END, CASE WHEN c < ll THEN coalesce(ch, hi) ELSE hi END,
      coalesce(c > hh, false), coalesce(c < ll, false), false, false FROM ({taken})"""
    else:
        judged = f"""SELECT *, coalesce(trend, 'bull') = 'bull' AND coalesce(c > hh, false) AS bu, coalesce(trend = 'bear' AND c < ll, false) AS bd FROM ({taken})"""
        turned = f"""SELECT *, NOT bu AND coalesce(trend, 'bull') = 'bull' AND coalesce(c < lo, false) AS td, NOT bd AND coalesce(trend = 'bear' AND c > hi, false) AS tu FROM ({judged})"""
        step = f"""SELECT symbol, source, n, CASE WHEN bu OR tu THEN 'bull' WHEN bd OR td THEN 'bear' ELSE trend END,
      CASE WHEN NOT (td OR tu) THEN hh END, CASE WHEN NOT (td OR tu) THEN ll END,
      CASE WHEN td THEN NULL WHEN tu THEN lowest WHEN bu AND trend = 'bull' THEN coalesce(cl, lo) ELSE lo END,
      CASE WHEN tu THEN NULL WHEN td THEN highest WHEN bd THEN coalesce(ch, hi) ELSE hi END,
      coalesce(bu AND trend = 'bull', false), bd, tu, td FROM ({turned})"""
    return f"{name} AS ({start} UNION ALL {step})"


def structured_sql(mode: str, o: str = "o", st: str = "st", name: str = "sd") -> str:
    """The operator's columns: zones are the extremes from the last opposite swing to the break."""
    zone = mode == "bos"
    low = f"(SELECT min(bar_low) FROM {o} z WHERE z.symbol = b.symbol AND z.source = b.source AND z.n BETWEEN b.cl_n AND b.n)" if zone else "NULL::DOUBLE"
    high = f"(SELECT max(bar_high) FROM {o} z WHERE z.symbol = b.symbol AND z.source = b.source AND z.n BETWEEN b.ch_n AND b.n)" if zone else "NULL::DOUBLE"
    return f"""{name} AS MATERIALIZED (SELECT b.symbol, b.source, b.bar_time, b.bar_open, b.bar_high, b.bar_low, b.bar_close, b.n, b.atr, b.r_dynamic, b.is_swing_high, b.is_swing_low, s.trend AS smc_trend_15m, s.hh AS hh_15m, s.ll AS ll_15m, s.lo AS strong_low_15m, s.hi AS strong_high_15m,
   up OR down AS bos_detected_15m, up AS bos_up_15m, down AS bos_down_15m, turn_up OR turn_down AS choch_detected_15m, turn_up AS choch_up_15m, turn_down AS choch_down_15m,
   CASE WHEN up OR down THEN epoch_ms(b.bar_time) END AS bos_time_ms, CASE WHEN up OR down THEN b.r_dynamic END AS r_dynamic_at_bos,
   CASE WHEN up AND b.cl_n IS NOT NULL THEN {low} END AS zone_low, CASE WHEN down AND b.ch_n IS NOT NULL THEN {high} END AS zone_high
  FROM {o} b JOIN {st} s ON b.symbol = s.symbol AND b.source = s.source AND b.n = s.n)"""


STRUCTURE = "symbol, source, bar_time, smc_trend_15m, hh_15m, ll_15m, strong_low_15m, strong_high_15m, bos_detected_15m, bos_up_15m, bos_down_15m, choch_detected_15m, choch_up_15m, choch_down_15m, bos_time_ms, r_dynamic_at_bos, zone_low, zone_high"


def breaks_v3_sql(source: str) -> str:
    """The older breaks: at each bar the swings 5 to 10 bars back that are confirmed by then may raise (lower) the level; a
    close beyond the level is a break and spends it, the high first."""
    seen = f"({KW} ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING)"
    found = lambda s, price, other, sign: f"""{s} AS (SELECT i.symbol, i.source, i.n, {'max' if sign == '<' else 'min'}(j.{price}) AS level FROM nb i JOIN nb j ON i.symbol = j.symbol AND i.source = j.source AND j.n BETWEEN i.n - 10 AND i.n - 5 AND j.n > 5 AND j.n + 5 <= j.total
   AND j.swing_{s} AND EXISTS (SELECT 1 FROM nb k WHERE k.symbol = j.symbol AND k.source = j.source AND k.n > j.n AND k.n <= least(j.n + 20, i.n) AND k.bar_close {sign} j.{other}) WHERE i.n > 5 GROUP BY 1, 2, 3)"""  # noqa: E731
    return f"""nb AS MATERIALIZED (SELECT *, row_number() OVER ({KW}) AS n, count(*) OVER (PARTITION BY symbol, source) AS total, bar_high >= max(bar_high) OVER {seen} - 1e-8 AS swing_h, bar_low <= min(bar_low) OVER {seen} + 1e-8 AS swing_l FROM {source}),
 {found('h', 'bar_high', 'bar_low', '<')}, {found('l', 'bar_low', 'bar_high', '>')},
 lv AS MATERIALIZED (SELECT nb.symbol, nb.source, nb.n, nb.bar_close AS c, h.level AS new_h, l.level AS new_l FROM nb LEFT JOIN h ON nb.symbol = h.symbol AND nb.source = h.source AND nb.n = h.n LEFT JOIN l ON nb.symbol = l.symbol AND nb.source = l.source AND nb.n = l.n),
 sb AS (SELECT symbol, source, 0::BIGINT AS n, NULL::DOUBLE AS th, NULL::DOUBLE AS tl, NULL::VARCHAR AS dir, false AS bos, false AS choch FROM lv GROUP BY 1, 2
  UNION ALL SELECT symbol, source, n, CASE WHEN NOT u THEN th END, CASE WHEN NOT d THEN tl END, CASE WHEN d THEN 'bearish' WHEN u THEN 'bullish' ELSE dir END,
    u AND coalesce(dir = 'bullish', false) OR d AND coalesce(CASE WHEN u THEN 'bullish' ELSE dir END = 'bearish', false),
    u AND NOT coalesce(dir = 'bullish', false) OR d AND NOT coalesce(CASE WHEN u THEN 'bullish' ELSE dir END = 'bearish', false)
   FROM (SELECT *, coalesce(c > th, false) AS u, coalesce(c < tl, false) AS d FROM
     (SELECT r.symbol, r.source, r.n, r.c, s.dir, greatest(s.th, r.new_h) AS th, least(s.tl, r.new_l) AS tl FROM sb s JOIN lv r ON r.symbol = s.symbol AND r.source = s.source AND r.n = s.n + 1)))"""


def gaps_sql(bars: str, sd: str = "sd", name: str = "fg") -> str:
    """Gaps by the rule's own loop: bar numbers from 0, the last trigger at or before the bar, its place among the bars,
    and the first later close beyond the far edge."""
    return f"""gb AS MATERIALIZED (SELECT *, row_number() OVER ({KW}) - 1 AS i, count(*) OVER (PARTITION BY symbol, source) AS total, median(atr) OVER (PARTITION BY symbol, source) AS med FROM {bars}),
 tr AS MATERIALIZED (SELECT t.symbol, t.source, t.bar_time AS trigger_time, (SELECT count(*) FROM gb WHERE gb.symbol = t.symbol AND gb.source = t.source AND gb.bar_time < t.bar_time) AS place FROM {sd} t WHERE bos_detected_15m OR choch_detected_15m),
 g0 AS (SELECT b.symbol, b.source, b.bar_time, b.i, coalesce(b.atr, b.med) AS a, abs(b.bar_close - b.bar_open) AS body, p.bar_high AS h0, p.bar_low AS l0, x.bar_high AS h2, x.bar_low AS l2
   FROM gb b JOIN gb p ON p.symbol = b.symbol AND p.source = b.source AND p.i = b.i - 1 JOIN gb x ON x.symbol = b.symbol AND x.source = b.source AND x.i = b.i + 1),
 g1 AS (SELECT *, CASE WHEN l2 > h0 THEN l2 ELSE l0 END AS fvg_high, CASE WHEN l2 > h0 THEN h0 ELSE h2 END AS fvg_low, CASE WHEN l2 > h0 THEN 'bullish_fvg' ELSE 'bearish_fvg' END AS fvg_side FROM g0 WHERE body > a * 0.5::DOUBLE AND (l2 > h0 OR h2 < l0)),
 g2 AS (SELECT g1.*, tr.trigger_time, tr.place FROM g1 ASOF JOIN tr ON tr.symbol = g1.symbol AND tr.source = g1.source AND g1.bar_time >= tr.trigger_time),
 g3 AS (SELECT g2.*, s.smc_trend_15m FROM g2 ASOF LEFT JOIN {sd} s ON s.symbol = g2.symbol AND s.source = g2.source AND g2.bar_time >= s.bar_time WHERE g2.i - g2.place <= 20 AND fvg_high - fvg_low >= greatest(a * 0.15::DOUBLE, 3.0)),
 {name} AS MATERIALIZED (SELECT symbol, source, bar_time AS formed_at, i + 1 AS bar_no, fvg_high, fvg_low, fvg_side, filled_at IS NOT NULL AS fvg_filled, filled_at, coalesce(smc_trend_15m, 'unknown') AS fvg_trend, trigger_time AS bos_bar_time FROM
   (SELECT g3.*, (SELECT min(k.bar_time) FROM gb k WHERE k.symbol = g3.symbol AND k.source = g3.source AND k.i BETWEEN g3.i + 2 AND g3.i + 21 AND CASE WHEN fvg_side = 'bullish_fvg' THEN k.bar_close < fvg_low ELSE k.bar_close > fvg_high END) AS filled_at FROM g3))"""


def active_gaps_sql(sd: str = "sd", gaps: str = "fg", name: str = "ag") -> str:
    """Each bar against every gap formed before it."""
    return f"""tb AS (SELECT b.symbol, b.source, b.bar_time, b.i, b.bar_close, t.smc_trend_15m AS trend FROM gb b ASOF LEFT JOIN (SELECT * FROM {sd} WHERE smc_trend_15m IS NOT NULL) t ON t.symbol = b.symbol AND t.source = b.source AND b.bar_time >= t.bar_time),
 ak AS (SELECT b.symbol, b.source, b.bar_time, b.i + 2 - g.bar_no AS one_more, g.fvg_high, g.fvg_low, g.fvg_side, g.formed_at, row_number() OVER (PARTITION BY b.symbol, b.source, b.bar_time ORDER BY abs((g.fvg_high + g.fvg_low) / 2.0 - b.bar_close), g.formed_at) AS rk
   FROM tb b JOIN {gaps} g ON g.symbol = b.symbol AND g.source = b.source AND g.formed_at < b.bar_time AND NOT coalesce(g.filled_at <= b.bar_time, false) AND g.fvg_trend <> 'unknown'
   AND g.fvg_side = CASE b.trend WHEN 'bull' THEN 'bullish_fvg' WHEN 'bear' THEN 'bearish_fvg' END AND b.i + 1 - g.bar_no <= 20),
 {name} AS MATERIALIZED (SELECT b.symbol, b.source, b.bar_time, fvg_high, fvg_low, fvg_side, false AS fvg_filled, CAST(coalesce(one_more - 1, 0) AS INTEGER) AS fvg_age_bars, formed_at AS fvg_timestamp FROM tb b LEFT JOIN (SELECT * FROM ak WHERE rk = 1) a ON a.symbol = b.symbol AND a.source = b.source AND a.bar_time = b.bar_time)"""


def equal_levels_sql(swings: str, bars: str, name: str = "eq") -> str:
    """Clusters: the earliest free swing of the last 80 gathers all free ones within tolerance; then strongest first."""
    return f"""em AS MATERIALIZED (SELECT symbol, source, median(atr) AS med FROM {bars} GROUP BY 1, 2),
 el AS (SELECT symbol, source, kind, list(price ORDER BY bar_time) AS free, any_value(med) * 0.25::DOUBLE AS tol FROM (SELECT * FROM {swings} QUALIFY row_number() OVER (PARTITION BY symbol, source, kind ORDER BY bar_time DESC) <= 80) JOIN em USING (symbol, source) GROUP BY 1, 2, 3),
 ec AS (SELECT symbol, source, kind, tol, free, 0 AS turn, NULL::DOUBLE[] AS members FROM el
  UNION ALL SELECT symbol, source, kind, tol, list_filter(free, lambda x: abs(free[1] - x) > tol), turn + 1, list_filter(free, lambda x: abs(free[1] - x) <= tol) FROM ec WHERE len(free) > 0),
 ef AS (SELECT symbol, source, kind, any_value(tol) AS tol, list({{'p': list_sum(members) / len(members), 's': len(members)}} ORDER BY len(members) DESC, turn) AS found FROM ec WHERE len(members) >= 2 GROUP BY 1, 2, 3),
 ed AS (SELECT symbol, source, kind, tol, found, 0 AS k, []::DOUBLE[] AS kept, NULL::DOUBLE AS price, NULL::BIGINT AS strength FROM ef
  UNION ALL SELECT symbol, source, kind, tol, found, k + 1, CASE WHEN ok THEN list_append(kept, found[k + 1].p) ELSE kept END, CASE WHEN ok THEN found[k + 1].p END, found[k + 1].s
   FROM (SELECT *, len(list_filter(kept, lambda x: abs(x - found[k + 1].p) <= tol)) = 0 AS ok FROM ed WHERE k < len(found))),
 e5 AS (SELECT symbol, source, count(*) AS m, min(bar_close) AS lo, max(bar_close) AS hi FROM (SELECT * FROM {bars} QUALIFY row_number() OVER (PARTITION BY symbol, source ORDER BY bar_time DESC) <= 5) GROUP BY 1, 2),
 {name} AS MATERIALIZED (SELECT ed.symbol, ed.source, kind AS direction, price, CAST(strength AS INTEGER) AS strength, k FROM ed JOIN e5 USING (symbol, source) JOIN em USING (symbol, source)
   WHERE price IS NOT NULL AND NOT (m >= 5 AND CASE WHEN kind = 'high' THEN lo > price + greatest(med * 0.15::DOUBLE, 2.0) ELSE hi < price - greatest(med * 0.15::DOUBLE, 2.0) END))"""


def sweeps_sql(bars: str, sessions: str, swings: str, equal: str = "eq", name: str = "sv") -> str:
    """Each bar against every level it can see, in the order the rule lists them: tiers, then snapshots, then swing highs,
    swing lows, equal highs, equal lows."""
    return f"""sl0 AS (SELECT symbol, source, snapshot_time AS visible, unnest([{{'p': prev_day_high, 'd': 'high', 't': 1, 'o': 0}}, {{'p': prev_day_low, 'd': 'low', 't': 1, 'o': 1}}, {{'p': current_session_high, 'd': 'high', 't': 2, 'o': 2}}, {{'p': current_session_low, 'd': 'low', 't': 2, 'o': 3}}, {{'p': prev_session_high, 'd': 'high', 't': 2, 'o': 4}}, {{'p': prev_session_low, 'd': 'low', 't': 2, 'o': 5}}]) AS l FROM {sessions}),
 sl1 AS (SELECT symbol, source, l.d AS d, l.p AS p, l.t AS tier, visible, l.o AS o FROM sl0 WHERE l.p IS NOT NULL QUALIFY row_number() OVER (PARTITION BY symbol, source, l.d, round_even(l.p * 100, 0) ORDER BY visible, l.o) = 1),
 all_levels AS MATERIALIZED (SELECT symbol, source, d, p, tier, visible, epoch_ms(visible) * 10 + o AS place FROM sl1
   UNION ALL SELECT symbol, source, kind, price, 3, NULL, CASE kind WHEN 'high' THEN 0 ELSE 1000000 END + row_number() OVER (PARTITION BY symbol, source, kind ORDER BY bar_time) FROM {swings}
   UNION ALL SELECT symbol, source, direction, price, 3, NULL, CASE direction WHEN 'high' THEN 2000000 ELSE 3000000 END + k FROM {equal}),
 sb0 AS MATERIALIZED (SELECT *, greatest(coalesce(atr, median(atr) OVER (PARTITION BY symbol, source), 0) * 0.15::DOUBLE, 2.0) AS tol FROM {bars}),
 first_level AS (SELECT b.symbol, b.source, b.bar_time, arg_min(d, (tier, place)) AS side, min(tier) AS tier FROM sb0 b JOIN all_levels l ON l.symbol = b.symbol AND l.source = b.source AND (visible IS NULL OR visible <= b.bar_time)
   AND CASE WHEN d = 'high' THEN b.bar_high >= p - tol AND b.bar_close < p ELSE b.bar_low <= p + tol AND b.bar_close > p END GROUP BY 1, 2, 3),
 {name} AS MATERIALIZED (SELECT b.*, f.side IS NOT NULL AS liq_swept, f.side AS liq_side, f.tier AS sweep_tier, CASE WHEN side IS NOT NULL THEN bar_low END AS sweep_candle_low, CASE WHEN side IS NOT NULL THEN bar_high END AS sweep_candle_high,
   CASE side WHEN 'high' THEN bar_high - greatest(bar_open, bar_close) WHEN 'low' THEN least(bar_open, bar_close) - bar_low END AS sweep_wick, CASE WHEN side IS NOT NULL THEN abs(bar_open - bar_close) END AS sweep_body
  FROM sb0 b LEFT JOIN first_level f ON f.symbol = b.symbol AND f.source = b.source AND f.bar_time = b.bar_time)"""


def rsi_sql(source: str, name: str) -> str:
    """RSI of 14 by its recursion: each average is 13/14 of the one before plus 1/14 of the bar's move, from 0 at the first bar."""
    return f"""rs0 AS MATERIALIZED (SELECT *, row_number() OVER ({KW}) - 1 AS rn, count(*) OVER (PARTITION BY symbol, source) AS cnt, bar_close - lag(bar_close) OVER ({KW}) AS dx FROM {source}),
 rs AS (SELECT symbol, source, 0::BIGINT AS rn, 0.0::DOUBLE AS up, 0.0::DOUBLE AS down FROM rs0 WHERE rn = 0
  UNION ALL SELECT r.symbol, r.source, r.rn, up + (greatest(r.dx, 0) - up) / 14, down + (greatest(-r.dx, 0) - down) / 14 FROM rs JOIN rs0 r ON r.symbol = rs.symbol AND r.source = rs.source AND r.rn = rs.rn + 1),
 {name} AS MATERIALIZED (SELECT a.* EXCLUDE (rn, cnt, dx), CASE WHEN cnt < 14 OR a.rn < 13 THEN NULL WHEN down = 0 THEN 100.0 ELSE 100 - 100 / (1 + up / down) END AS rsi_14 FROM rs0 a LEFT JOIN rs ON a.symbol = rs.symbol AND a.source = rs.source AND a.rn = rs.rn)"""


def features_sql(session: str) -> str:
    """Ticks with what the bars (sv, cf, ag by minute; sd by quarter; bias by 4 hours) and the facts (ses, cnt, sd's zones) say."""
    at = lambda width: f"time_bucket(INTERVAL '{width}', t.timestamp_utc)"
    on = lambda x: f"{x}.symbol = t.symbol AND {x}.source = t.source"
    return f"""ft0 AS (SELECT t.*, sv.bar_open, sv.bar_high, sv.bar_low, sv.bar_close, sv.atr AS atr_20_1m, sv.rsi_14, sv.liq_swept, sv.liq_side, sv.sweep_tier, sv.sweep_wick, sv.sweep_body, sv.sweep_candle_low AS low_1m, sv.sweep_candle_high AS high_1m,
   ag.fvg_high, ag.fvg_low, ag.fvg_side, ag.fvg_filled, ag.fvg_age_bars, ag.fvg_timestamp, cf.confirmed_1m_swing_high, cf.confirmed_1m_swing_low,
   sd.atr AS atr_15_15m, sd.r_dynamic, sd.smc_trend_15m, sd.hh_15m, sd.ll_15m, sd.strong_low_15m, sd.strong_high_15m, sd.bos_detected_15m, sd.bos_up_15m, sd.bos_down_15m, sd.choch_detected_15m, sd.choch_up_15m, sd.choch_down_15m, sd.bos_time_ms, sd.r_dynamic_at_bos,
   sd.is_swing_high AS is_swing_high_15m, sd.is_swing_low AS is_swing_low_15m, bias.market_bias_4h
  FROM ticks t LEFT JOIN sv ON {on('sv')} AND sv.bar_time = {at('1 minute')} LEFT JOIN ag ON {on('ag')} AND ag.bar_time = {at('1 minute')} LEFT JOIN cf ON {on('cf')} AND cf.bar_time = {at('1 minute')}
   LEFT JOIN sd ON {on('sd')} AND sd.bar_time = {at('15 minutes')} LEFT JOIN bias ON {on('bias')} AND bias.bar_time = {at('4 hours')}),
 ft1 AS (SELECT t.*, coalesce(ses.session_boundary, false) AS session_boundary, ses.session_name, ses.prev_day_high, ses.prev_day_low, ses.current_session_high, ses.current_session_low, ses.prev_session_high, ses.prev_session_low FROM ft0 t ASOF LEFT JOIN ses ON {on('ses')} AND t.timestamp_utc >= ses.snapshot_time),
 ft2 AS (SELECT t.*, cnt.n_highs AS n_confirmed_swing_highs_15m, cnt.n_lows AS n_confirmed_swing_lows_15m FROM ft1 t ASOF LEFT JOIN cnt ON {on('cnt')} AND t.timestamp_utc >= cnt.bar_time),
 ft AS MATERIALIZED (SELECT t.* EXCLUDE (low_1m, high_1m), coalesce(z.zone_low, low_1m) AS sweep_candle_low, coalesce(z.zone_high, high_1m) AS sweep_candle_high, {session} AS session
  FROM ft2 t ASOF LEFT JOIN (SELECT symbol, source, bar_time, zone_low, zone_high FROM sd WHERE zone_low IS NOT NULL OR zone_high IS NOT NULL) z ON {on('z')} AND t.timestamp_utc >= z.bar_time)"""


def stateless_sql(features: str = "ft", name: str = "dz", align_bias: bool = False) -> str:
    """What each tick says by itself: gates, first-stage action and the two scores, point by point."""
    with_bias = (" AND market_bias_4h = 'bullish'", " AND market_bias_4h = 'bearish'") if align_bias else ("", "")
    up, down = (f"coalesce((bos_{k}_15m OR choch_{k}_15m){b}, false)" for k, b in zip(("up", "down"), with_bias))
    return f"""{name} AS (SELECT *, coalesce(atr_15_15m > 0 AND ask - bid > atr_15_15m * 0.25::DOUBLE, false) AS spread_gate,
   CASE WHEN {up} THEN 'OPEN_T1_LONG' WHEN {down} THEN 'OPEN_T1_SHORT' END AS t1_action,
   CASE WHEN {up} THEN CASE WHEN bos_up_15m THEN 'BOS' ELSE 'CHoCH' END WHEN {down} THEN CASE WHEN bos_down_15m THEN 'BOS' ELSE 'CHoCH' END END AS t1_reason,
   CASE WHEN fvg_side IS NULL OR coalesce(fvg_filled, false) OR fvg_high IS NULL OR fvg_low IS NULL THEN 'REASON_NO_FVG' WHEN coalesce(atr_20_1m, 0) <= 0 THEN 'REASON_NO_ATR'
        WHEN fvg_high - fvg_low < greatest(0.15::DOUBLE * atr_20_1m, 3.0) THEN 'REASON_FVG_TOO_SMALL' END AS gap_gate,
   CASE WHEN NOT coalesce(liq_swept, false) THEN 'REASON_NO_LIQUIDITY' WHEN sweep_tier IS NULL THEN 'REASON_NO_LIQ_TIER' END AS sweep_gate,
   CAST(least(5, CASE sweep_tier WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE 0 END + CASE WHEN sweep_body > 0 AND sweep_wick > 0.5 * sweep_body THEN 1 ELSE 0 END + CASE WHEN session IN ('london', 'newyork') THEN 1 ELSE 0 END + CASE WHEN choch_detected_15m THEN 1 ELSE 0 END) AS INTEGER) AS sweep_score,
   CAST(least(5, CASE WHEN fvg_high - fvg_low > 15 THEN 2 ELSE 0 END + CASE WHEN fvg_age_bars > 3 THEN 1 ELSE 0 END) AS INTEGER) AS gap_score FROM {features})"""


def decide_sql(t1: str, t2: str, stopped: str, direction: str, since: str, r: str, action: str = "t1_action") -> tuple[str, str, str]:
    """(action, reason, score) of the two-stage decision, gate by gate, as expressions on a tick of dz and the relay."""
    score = "(sweep_score + gap_score)"
    intact = f"CASE {direction} WHEN 'bull' THEN hh_15m IS NOT NULL AND strong_low_15m IS NOT NULL WHEN 'bear' THEN ll_15m IS NOT NULL AND strong_high_15m IS NOT NULL ELSE false END"
    broken = f"coalesce(now_ms - {since} >= {r} * 900000, false) AND NOT {intact}"
    need = f"CASE WHEN coalesce({direction} = 'bull' AND market_bias_4h = 'bullish' OR {direction} = 'bear' AND market_bias_4h = 'bearish', false) THEN 4 ELSE 7 END"
    long = f"coalesce(({direction} = 'bull' OR liq_side = 'low') AND fvg_side = 'bullish_fvg', false)"
    short = f"coalesce(({direction} = 'bear' OR liq_side = 'high') AND fvg_side = 'bearish_fvg', false)"
    first = f"NOT ({t1}) AND NOT ({t2}) AND {action} IS NOT NULL"
    idle = f"({t1}) OR ({t2}) OR NOT ({stopped})"
    chosen = f"CASE WHEN spread_gate THEN 'HOLD' WHEN {first} THEN {action} WHEN {idle} OR gap_gate IS NOT NULL OR {broken} OR sweep_gate IS NOT NULL OR {score} < {need} THEN 'HOLD' WHEN {long} THEN 'OPEN_T2_LONG' WHEN {short} THEN 'OPEN_T2_SHORT' ELSE 'HOLD' END"
    reason = f"CASE WHEN spread_gate THEN 'REASON_SPREAD' WHEN {first} THEN t1_reason WHEN {idle} THEN 'hold' WHEN gap_gate IS NOT NULL THEN gap_gate WHEN {broken} THEN 'REASON_STRUCTURE_BROKEN' WHEN sweep_gate IS NOT NULL THEN sweep_gate WHEN {score} < {need} THEN 'REASON_SCORE_TOO_LOW' WHEN {long} OR {short} THEN 'LIQ_SWEEP' ELSE 'hold' END"
    total = f"CASE WHEN spread_gate OR {first} OR {idle} OR gap_gate IS NOT NULL OR {broken} OR sweep_gate IS NOT NULL THEN 0 ELSE {score} END"
    return chosen, reason, total


def audit_sql(name: str = "au") -> str:
    """Decisions of the ticks with a break, a gap or a sweep, one after another; a bar opens one first stage at most."""
    chosen, reason, total = decide_sql("opened", "false", "false", "direction", "since", "r", "t1_now")
    return f"""aq AS MATERIALIZED (SELECT *, epoch_ms(timestamp_utc) AS now_ms, epoch_ms(timestamp_utc) // 900000 AS bar, row_number() OVER (PARTITION BY symbol, source ORDER BY timestamp_utc, seq) AS k FROM dz WHERE bos_detected_15m OR choch_detected_15m OR fvg_side IS NOT NULL OR liq_swept),
 {name} AS (SELECT symbol, source, NULL::TIMESTAMP AS timestamp_utc, 0::BIGINT AS k, NULL::VARCHAR AS decision, NULL::VARCHAR AS reason, 0 AS score, NULL::DOUBLE AS bid, NULL::DOUBLE AS ask, NULL::VARCHAR AS market_bias_4h, NULL::VARCHAR AS session, false AS opened, NULL::BIGINT AS taken, NULL::VARCHAR AS direction, NULL::BIGINT AS since, NULL::INTEGER AS r FROM aq GROUP BY 1, 2
  UNION ALL SELECT symbol, source, timestamp_utc, k, decision, reason, score, bid, ask, market_bias_4h, session, opened OR decision LIKE 'OPEN_T1%', CASE WHEN decision LIKE 'OPEN_T1%' THEN bar ELSE taken END,
    CASE decision WHEN 'OPEN_T1_LONG' THEN 'bull' WHEN 'OPEN_T1_SHORT' THEN 'bear' ELSE direction END, CASE WHEN decision LIKE 'OPEN_T1%' THEN now_ms ELSE since END, CASE WHEN decision LIKE 'OPEN_T1%' THEN r_dynamic ELSE r END
   FROM (SELECT *, {chosen} AS decision, {reason} AS reason, {total} AS score FROM
     (SELECT q.*, a.opened, a.taken, a.direction, a.since, a.r, CASE WHEN a.taken IS DISTINCT FROM q.bar THEN q.t1_action END AS t1_now FROM {name} a JOIN aq q ON q.symbol = a.symbol AND q.source = a.source AND q.k = a.k + 1)))"""


#: Columns of the backtest's rows after symbol, source and n.
ROW = {
    "kind": "VARCHAR", "type": "VARCHAR", "pair_id": "INTEGER", "direction": "VARCHAR", "entry_time": "TIMESTAMP", "exit_time": "TIMESTAMP", "entry_price": "DOUBLE", "exit_price": "DOUBLE", "pnl": "DOUBLE", "pnl_pips": "DOUBLE", "lot": "DOUBLE",
    "exit_reason": "VARCHAR", "entry_reason": "VARCHAR", "session": "VARCHAR", "point1_hit": "BOOLEAN", "point2_hit": "BOOLEAN", "hold_minutes": "DOUBLE", "sl_pips": "DOUBLE", "mae_pips": "DOUBLE", "mfe_pips": "DOUBLE", "trend": "VARCHAR", "equity": "DOUBLE",
}
#: The account between two ticks: equity, what the first stage left (z_stopped to z_taken), and the one trade or order.
ACCOUNT = {
    "z_eq": "DOUBLE", "z_pair": "INTEGER", "z_stopped": "BOOLEAN", "z_dir": "VARCHAR", "z_since": "BIGINT", "z_r": "INTEGER", "z_taken": "BIGINT", "z_ty": "VARCHAR", "z_pend": "BOOLEAN", "z_side": "INTEGER", "z_entry": "DOUBLE", "z_sl": "DOUBLE",
    "z_lot": "DOUBLE", "z_time": "TIMESTAMP", "z_risk": "DOUBLE", "z_p1": "DOUBLE", "z_p2": "DOUBLE", "z_hit1": "BOOLEAN", "z_hit2": "BOOLEAN", "z_best": "DOUBLE", "z_worst": "DOUBLE", "z_why": "VARCHAR", "z_ses": "VARCHAR", "z_trend": "VARCHAR",
    "z_own": "INTEGER", "z_mid": "DOUBLE", "z_expires": "BIGINT", "z_tp": "DOUBLE",
}


def _row(**values: str) -> str:
    return "{" + ", ".join(f"'{c}': CAST({values.get(c, 'NULL')} AS {t})" for c, t in ROW.items()) + "}"


def _closed(why: str, best: str = "z_best", worst: str = "z_worst") -> tuple[str, str]:
    """(profit, row) of the open trade closed at this tick."""
    out = "CASE WHEN z_side > 0 THEN bid ELSE ask END"
    pips = f"z_side * ({out} - z_entry) / 0.1::DOUBLE"
    pnl = f"({pips}) * z_lot * 10"
    return pnl, _row(
        kind="'trade'", type="z_ty", pair_id="z_own", direction="CASE WHEN z_side > 0 THEN 'LONG' ELSE 'SHORT' END", entry_time="z_time", exit_time="timestamp_utc", entry_price="z_entry", exit_price=out, pnl=pnl, pnl_pips=pips, lot="z_lot",
        exit_reason=f"'{why}'", entry_reason="z_why", session="z_ses", point1_hit="z_hit1", point2_hit="z_hit2", hold_minutes="(epoch_us(timestamp_utc) - epoch_us(z_time)) / 60000000.0::DOUBLE", sl_pips="z_risk / 0.1::DOUBLE",
        mae_pips=f"coalesce(greatest(0, z_side * (z_entry - {worst}) / 0.1::DOUBLE), 0)", mfe_pips=f"coalesce(greatest(0, z_side * ({best} - z_entry) / 0.1::DOUBLE), 0)", trend="z_trend", equity=f"z_eq + {pnl}",
    )


def _after(source: str, flags: dict[str, str], changes: dict[str, str]) -> str:
    """source with flags added, then the changes made to its columns."""
    flagged = f"SELECT *, {', '.join(f'{e} AS {c}' for c, e in flags.items())} FROM ({source})"
    return f"SELECT * EXCLUDE ({', '.join(flags)}) REPLACE ({', '.join(f'{e} AS {c}' for c, e in changes.items())}) FROM ({flagged})"


def backtest_sql(ticks: str = "dz", relay: str = "compat", name: str = "bt") -> str:
    """The tick loop as the rule runs it: a wide spread closes, then the pending order, then stop, target, points 1 and 2
    and trail, then the decision.  At most one trade or order is open, as each needs the other to be gone."""
    size = lambda entry, sl: f"CASE WHEN abs({entry} - ({sl})) <= 0 THEN 0.01 ELSE greatest(0.01, round_even(eq0 * 0.005::DOUBLE / (abs({entry} - ({sl})) / 0.1::DOUBLE * 10) * 100, 0) / 100) END"
    p1 = lambda s, price, edge_hi, edge_lo, a: f"CASE WHEN {s} > 0 THEN greatest({edge_hi}, {price} + {a} * 0.3::DOUBLE) ELSE least({edge_lo}, {price} - {a} * 0.3::DOUBLE) END"
    p2 = lambda s, price, first, a: f"CASE WHEN {s} > 0 THEN greatest({price} + {a} * 1.25::DOUBLE, ({first}) + {a} * 0.3::DOUBLE) ELSE least({price} - {a} * 1.25::DOUBLE, ({first}) - {a} * 0.3::DOUBLE) END"
    out0 = "[]::STRUCT(" + ", ".join(f'"{c}" {t}' for c, t in ROW.items()) + ")[]"
    joined = f"SELECT q.*, {', '.join('b.' + c for c in ACCOUNT)}, {out0} AS z_out, b.z_eq AS eq0, q.ask - q.bid >= 2.0::DOUBLE AS wide FROM {name} b JOIN bq q ON q.symbol = b.symbol AND q.source = b.source AND q.k = b.k + 1"
    pnl, row = _closed("wide_spread")
    fled = _after(joined, {"x_close": "wide AND z_ty IS NOT NULL AND NOT z_pend"}, {"z_eq": f"CASE WHEN x_close THEN z_eq + {pnl} ELSE z_eq END", "z_out": f"CASE WHEN x_close THEN list_append(z_out, {row}) ELSE z_out END", "z_stopped": f"CASE WHEN x_close AND z_ty = 'T1' THEN {pnl} < 0 ELSE z_stopped END", "z_ty": "CASE WHEN NOT wide THEN z_ty END"})
    waiting = "NOT wide AND coalesce(z_ty = 'T2' AND z_pend, false)"
    cancel = "(now_ms >= z_expires OR coalesce(z_trend = 'bull' AND market_bias_4h = 'bearish' OR z_trend = 'bear' AND market_bias_4h = 'bullish', false) OR bar_close IS NOT NULL AND coalesce(fvg_filled, false))"
    a = "CASE WHEN atr_15_15m > 0 THEN atr_15_15m ELSE 0 END"
    first = p1("z_side", "z_mid", "coalesce(nullif(bar_high, 0), z_mid)", "coalesce(nullif(bar_low, 0), z_mid)", a)
    levels = "[prev_day_high, prev_day_low, current_session_high, current_session_low, prev_session_high, prev_session_low]"
    near = f"list_sort(list_transform(list_filter({levels}, lambda x: x IS NOT NULL AND z_side * x > z_side * z_mid), lambda x: {{'far': abs(x - z_mid), 'at': x}}))[1]"
    filled = _after(fled, {"x_off": f"{waiting} AND {cancel}", "x_fill": f"{waiting} AND NOT {cancel} AND CASE WHEN z_side > 0 THEN ask <= z_mid ELSE bid >= z_mid END"}, {
        "z_ty": "CASE WHEN NOT x_off THEN z_ty END", "z_stopped": "z_stopped AND NOT x_off AND NOT x_fill", "z_pend": "z_pend AND NOT x_fill", "z_entry": "CASE WHEN x_fill THEN z_mid ELSE z_entry END", "z_time": "CASE WHEN x_fill THEN timestamp_utc ELSE z_time END",
        "z_risk": "CASE WHEN x_fill THEN abs(z_mid - z_sl) ELSE z_risk END", "z_best": "CASE WHEN x_fill THEN z_mid ELSE z_best END", "z_p1": f"CASE WHEN x_fill THEN {first} ELSE z_p1 END", "z_p2": f"CASE WHEN x_fill THEN {p2('z_side', 'z_mid', first, a)} ELSE z_p2 END",
        "z_tp": f"CASE WHEN x_fill THEN CASE WHEN abs(z_mid - z_sl) > 0 AND ({near}).far >= 2.0 * abs(z_mid - z_sl) THEN ({near}).at END ELSE z_tp END",
    })
    live = "NOT wide AND z_ty IS NOT NULL AND NOT z_pend"
    price = "CASE WHEN z_side > 0 THEN bid ELSE ask END"
    seen = _after(filled, {"x_live": live}, {"z_best": f"CASE WHEN NOT x_live THEN z_best WHEN z_side > 0 THEN greatest(z_best, {price}) ELSE least(z_best, {price}) END", "z_worst": f"CASE WHEN NOT x_live THEN z_worst WHEN z_side > 0 THEN least(coalesce(z_worst, {price}), {price}) ELSE greatest(coalesce(z_worst, {price}), {price}) END"})
    (pnl, stop), (_, target) = _closed("sl"), _closed("tp")
    sl_hit = f"{live} AND z_side * ({price}) <= z_side * z_sl"
    ended = _after(seen, {"x_sl": sl_hit, "x_tp": f"{live} AND NOT ({sl_hit}) AND coalesce(z_side * ({price}) >= z_side * z_tp, false)"}, {
        "z_out": f"CASE WHEN x_sl THEN list_append(z_out, {stop}) WHEN x_tp THEN list_append(z_out, {target}) ELSE z_out END", "z_eq": f"CASE WHEN x_sl OR x_tp THEN z_eq + {pnl} ELSE z_eq END",
        "z_stopped": f"CASE WHEN x_sl AND z_ty = 'T1' THEN NOT z_hit1 AND {pnl} < 0 ELSE z_stopped END", "z_ty": "CASE WHEN NOT (x_sl OR x_tp) THEN z_ty END",
    })
    one = _after(ended, {"x_one": f"{live} AND NOT z_hit1 AND z_side * ({price}) >= z_side * z_p1"}, {"z_hit1": "z_hit1 OR x_one", "z_sl": "CASE WHEN x_one THEN z_entry ELSE z_sl END"})
    two = _after(one, {"x_two": f"{live} AND z_hit1 AND NOT z_hit2 AND z_side * ({price}) >= z_side * z_p2"}, {"z_hit2": "z_hit2 OR x_two"})
    trailed = _after(two, {"x_trail": f"{live} AND z_hit2"}, {"z_sl": "CASE WHEN NOT x_trail THEN z_sl WHEN z_side > 0 THEN greatest(z_sl, confirmed_1m_swing_low - 0.25::DOUBLE) ELSE least(z_sl, confirmed_1m_swing_high + 0.25::DOUBLE) END"})
    same_bar = "coalesce(z_taken = bar, false)"
    action, reason, _ = decide_sql("coalesce(z_ty = 'T1', false)", "coalesce(z_ty = 'T2', false)", "z_stopped", "z_dir", "z_since", "z_r", f"(CASE WHEN NOT {same_bar} THEN t1_action END)" if relay == "full" else "t1_action")
    decided = f"SELECT *, CASE WHEN wide THEN 'HOLD' ELSE {action} END AS act, CASE WHEN wide THEN 'hold' ELSE {reason} END AS why FROM ({trailed})"
    event = _row(kind="'event'", type="CASE WHEN bos_detected_15m THEN 'BOS' ELSE 'CHoCH' END", direction="CASE WHEN bos_up_15m OR choch_up_15m THEN 'bull' ELSE 'bear' END", entry_time="timestamp_utc", entry_reason="act", session="coalesce(session, 'off')", entry_price="bid", exit_price="ask")
    noted = f"""SELECT * REPLACE (CASE WHEN NOT wide AND (bos_detected_15m OR choch_detected_15m) AND NOT {same_bar} THEN list_append(z_out, {event}) ELSE z_out END AS z_out) FROM
      (SELECT * REPLACE (CASE WHEN NOT wide AND z_stopped AND act = 'HOLD' AND coalesce(z_ty <> 'T2', true) AND why LIKE 'REASON\\_%' ESCAPE '\\' THEN list_append(z_out, {_row(kind="'reason'", exit_reason='why')}) ELSE z_out END AS z_out) FROM ({decided}))"""
    s = "CASE WHEN act LIKE '%LONG' THEN 1 ELSE -1 END"
    price1 = "CASE WHEN act LIKE '%LONG' THEN ask ELSE bid END"
    sl1 = "CASE WHEN act LIKE '%LONG' THEN sweep_candle_low - 0.4::DOUBLE ELSE sweep_candle_high + 0.4::DOUBLE END"
    mid2, sl2 = "(fvg_high + fvg_low) / 2", "CASE WHEN act LIKE '%LONG' THEN fvg_low - 0.25::DOUBLE ELSE fvg_high + 0.25::DOUBLE END"
    mid = "(bid + ask) / 2"
    first1 = p1(s, f"({price1})", f"coalesce(nullif(bar_high, 0), {mid})", f"coalesce(nullif(bar_low, 0), {mid})", "atr_15_15m")
    trend = "CASE WHEN act LIKE '%LONG' THEN 'bull' ELSE 'bear' END"
    either = lambda one, two, old: f"CASE WHEN x_1 THEN {one} WHEN x_2 THEN {two} ELSE {old} END"
    opened = _after(noted, {"x_1": f"act LIKE 'OPEN_T1%' AND ({sl1}) IS NOT NULL AND coalesce(atr_15_15m > 0, false)", "x_2": "act LIKE 'OPEN_T2%'"}, {
        "z_ty": either("'T1'", "'T2'", "z_ty"), "z_pend": either("false", "true", "z_pend"), "z_side": either(s, s, "z_side"), "z_entry": either(price1, "NULL", "z_entry"), "z_sl": either(sl1, sl2, "z_sl"),
        "z_lot": either(size(f"({price1})", sl1), size(mid2, sl2), "z_lot"), "z_time": either("timestamp_utc", "NULL", "z_time"), "z_risk": either(f"abs(({price1}) - ({sl1}))", "0", "z_risk"), "z_p1": either(first1, "NULL", "z_p1"),
        "z_p2": either(p2(s, f"({price1})", first1, "atr_15_15m"), "NULL", "z_p2"), "z_hit1": either("false", "false", "z_hit1"), "z_hit2": either("false", "false", "z_hit2"), "z_best": either(price1, "NULL", "z_best"), "z_worst": either("NULL", "NULL", "z_worst"),
        "z_why": either("why", "why", "z_why"), "z_ses": either("coalesce(session, 'asian')", "coalesce(session, 'asian')", "z_ses"), "z_trend": either(trend, trend, "z_trend"), "z_own": either("z_pair", "z_pair - 1", "z_own"), "z_mid": either("NULL", mid2, "z_mid"),
        "z_expires": either("0", "now_ms + 600000", "z_expires"), "z_tp": either("NULL", "NULL", "z_tp"), "z_dir": f"CASE WHEN x_1 THEN {trend} ELSE z_dir END", "z_since": "CASE WHEN x_1 THEN now_ms ELSE z_since END", "z_r": "CASE WHEN x_1 THEN r_dynamic ELSE z_r END",
        "z_taken": "CASE WHEN x_1 THEN bar ELSE z_taken END", "z_stopped": "z_stopped AND NOT x_1", "z_pair": "CASE WHEN x_1 THEN z_pair + 1 ELSE z_pair END",
    })
    keep = ", ".join(f"CAST({c} AS {t}) AS {c}" for c, t in ACCOUNT.items())
    begin = {"z_eq": "10000.0", "z_pair": "1", "z_stopped": "false", "z_pend": "false"}
    account = ", ".join(f"CAST({begin.get(c, 'NULL')} AS {t}) AS {c}" for c, t in ACCOUNT.items())
    start = f"SELECT symbol, source, 0::BIGINT AS k, NULL::TIMESTAMP AS timestamp_utc, NULL::DOUBLE AS bid, NULL::DOUBLE AS ask, {account}, {out0} AS z_out FROM bq GROUP BY 1, 2"
    _, last = _closed("end_of_data")
    return f"""bq AS MATERIALIZED (SELECT *, epoch_ms(timestamp_utc) AS now_ms, epoch_ms(timestamp_utc) // 900000 AS bar, row_number() OVER (PARTITION BY symbol, source ORDER BY timestamp_utc, seq) AS k FROM {ticks}),
 {name} AS ({start} UNION ALL SELECT symbol, source, k, timestamp_utc, bid, ask, {keep}, z_out FROM ({opened})),
 {name}_rows AS (SELECT symbol, source, k, generate_subscripts(z_out, 1) AS j, unnest(z_out) AS o FROM {name}
   UNION ALL SELECT symbol, source, k + 1, 1, {last} FROM {name} WHERE z_ty IS NOT NULL AND NOT z_pend QUALIFY k = max(k) OVER (PARTITION BY symbol, source) AND k = (SELECT max(k) FROM {name} m WHERE m.symbol = {name}.symbol AND m.source = {name}.source)),
 {name}_out AS (SELECT symbol, source, row_number() OVER (PARTITION BY symbol, source ORDER BY k, j) - 1 AS n, unnest(o) FROM {name}_rows)"""
