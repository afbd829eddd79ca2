"""WIN-*: per-instrument window metrics and per-session cross-sections."""

from __future__ import annotations

from pyspark.sql import functions as F

from sessionloom.catalog.core import R, query
from sessionloom.catalog.sqltext import (
    I, bars as B, cont, full, lag, lr, needs, ret, rows, sess,
)
from sessionloom.functions.numeric import rnd
from sessionloom.functions.ranking import with_midrank
from sessionloom.operators import crosssection as X
from sessionloom.operators import windows as W
from sessionloom.sources.fixtures import bars

ID = ["instrument_id", "session_ix"]
IDS = "instrument_id, session_ix"


def out(df, *cols, digits=6, keep=()):
    return df.select(*ID, *keep, *[rnd(c, digits).alias(c) for c in cols])


@query("win_01_lagged_returns", f"with {B()} select {IDS}, {R(ret(1))} as r1, {R(ret(5))} as r5, {R(ret(20))} as r20 from b")
def _(t):
    return out(W.add_returns(bars(t)), "r1", "r5", "r20")


@query("win_02_log_returns", f"""with {B(grain='month')}, l as (select *, {lr()} as lr from b)
 select {IDS}, {R('lr')} as lr, {R(needs('lr', 5, 'sum(lr)'))} as lr5, {R(needs('lr', 20, 'sum(lr)'))} as lr20 from l""")
def _(t):
    df = W.add_log_return(bars(t, grain="month"))
    df = df.select("*", W.needs("lr", 5, F.sum("lr")).alias("lr5"), W.needs("lr", 20, F.sum("lr")).alias("lr20"))
    return out(df, "lr", "lr5", "lr20")


@query("win_03_trailing_means", f"""with {B(grain='month')},
 a as (select *, {full('avg(close)', 10)} as sma10, {full('avg(close)', 20)} as sma20 from b)
 select {IDS}, close>sma10 as above10, close>sma20 as above20, {R('sma10')} as sma10, {R('sma20')} as sma20,
  {R('sma10/sma20-1')} as sma_spread, {R('sma20/' + lag('sma20', 5) + '-1')} as sma20_slope5 from a""")
def _(t):
    return out(W.trailing_means(bars(t, grain="month")), "sma10", "sma20", "sma_spread", "sma20_slope5", keep=("above10", "above20"))


@query("win_04_realised_volatility", f"""with {B(grain='month')}, l as (select *, {lr()} as lr from b)
 select {IDS}, {R(needs('lr', 10, 'stddev_samp(lr)') + '*sqrt(252)')} as rv10, {R(needs('lr', 20, 'stddev_samp(lr)') + '*sqrt(252)')} as rv20 from l""")
def _(t):
    return out(W.realised_volatility(bars(t, grain="month")), "rv10", "rv20")


_MID = "rank() over (partition by session_ix order by v) + (count(*) over (partition by session_ix, v)-1)/2.0"


@query("win_05_midrank", f"""with {B()}, r as (select {IDS}, volume as v from b)
 select {IDS}, cast(v as double) as volume, {R(_MID)} as midrank, count(*) over (partition by session_ix) as n_group from r""")
def _(t):
    return with_midrank(bars(t), ["session_ix"], "volume").select(*ID, "volume", rnd("midrank").alias("midrank"), "n_group")


_PCT = f"""case when count(*) over (partition by session_ix, v) = count(*) over (partition by session_ix) then 50.0
  else 100.0*({_MID}-1)/(count(*) over (partition by session_ix)-1) end"""


@query("win_06_inclusive_percentile", f"""with {B()}, r as (select {IDS}, volume as v from b) select {IDS}, {R(_PCT)} as pct from r""")
def _(t):
    return out(X.percentile_0_100(bars(t), "volume"), "pct")


@query("win_07_robust_score", f"""with {B()}, r as (select {IDS}, {ret(1)} as x from b), c as (select * from r where x is not null),
 q as (select session_ix, quantile_cont(x,0.05) as lo, quantile_cont(x,0.95) as hi from c group by 1),
 w as (select c.*, least(hi, greatest(lo, x)) as v from c join q using (session_ix)),
 m as (select session_ix, median(v) as med from w group by 1),
 d as (select session_ix, any_value(med) as med, median(abs(v-med)) as mad from w join m using (session_ix) group by 1),
 p as (select *, {_PCT} as pct from w)
 select {IDS}, {R('v')} as winsorised,
  {R("case when mad=0 then pct else least(100.0, greatest(0.0, 50+15*0.67448975*(v-med)/mad)) end")} as score
 from p join d using (session_ix)""")
def _(t):
    df = W.add_returns(bars(t), lags=(1,))
    return out(X.robust_score(df, "r1"), "winsorised", "score")


_TR = f"case when {lag('close', 1)} is not null then greatest(high-low, abs(high-{lag('close', 1)}), abs(low-{lag('close', 1)})) end"


@query("win_08_average_true_range", f"""with {B(grain='month')}, x as (select *, {_TR} as tr from b)
 select {IDS}, {R('tr', 8)} as tr, {R(needs('tr', 14, 'avg(tr)'))} as atr14,
  {R(f"case when count(tr) {rows(14, 1)}=14 and {cont(2)} then avg(tr) {rows(14, 1)} end")} as atr14_prior,
  {R(f"case when count(tr) {rows(5, 1)}=5 and {cont(2)} then avg(tr) {rows(5, 1)} end")} as atr5_prior from x""")
def _(t):
    df = W.average_true_range(bars(t, grain="month"))
    return df.select(*ID, rnd("tr", 8).alias("tr"), *[rnd(c).alias(c) for c in ("atr14", "atr14_prior", "atr5_prior")])


@query("win_09_max_drawdown", f"""with {B()},
 k as (select unnest(range(0,6)) as k), g as (select {IDS} from (select *, {cont(6)} as ok from b) where ok),
 p as (select g.instrument_id, g.session_ix, 5-k.k as pos, b.close from g, k join b on b.instrument_id=g.instrument_id and b.session_ix=g.session_ix-k.k),
 a as (select *, max(close) over (partition by instrument_id, session_ix order by pos) as pk,
   max(close) over (partition by instrument_id, session_ix order by pos rows between unbounded preceding and 1 preceding) as pk0 from p),
 d as (select instrument_id, session_ix, min(least(0.0, close/pk-1)) as dd, min(least(0.0, coalesce(close/pk0-1, 0.0))) as dd0 from a group by 1,2)
 select b.instrument_id, b.session_ix, {R('dd')} as max_dd, {R('dd0')} as max_dd_prior_peak
 from b left join d on d.instrument_id=b.instrument_id and d.session_ix=b.session_ix""")
def _(t):
    return out(W.max_drawdown(bars(t)), "max_dd", "max_dd_prior_peak")


@query("win_10_prior_extremes", f"""with {B()} select {IDS},
 {R(f'case when {cont(6)} then max(close) {rows(5, 1)} end', 8)} as prior_high, {R(f'case when {cont(6)} then min(close) {rows(5, 1)} end', 8)} as prior_low from b""")
def _(t):
    return out(W.prior_extremes(bars(t)), "prior_high", "prior_low", digits=8)


@query("win_11_volume_ratio", f"""with {B()},
 a as (select *, {ret(1)} as r1, case when count(volume) {sess(20, 1)} >= 15 then median(volume) {sess(20, 1)} end as pm from b),
 c as (select *, case when pm>0 then volume/pm end as vr, case when pm is not null then case when volume>pm then 1.0 else 0.0 end end as ab from a)
 select {IDS}, {R('pm')} as prior_median_volume, {R('vr')} as volume_ratio,
  {R(f"case when count(ab) {sess(5)}>=5 then avg(ab) {sess(5)} end")} as persistence,
  {R("case when r1 is not null and vr is not null then case when r1>0 and vr>1 then 100.0 when r1>0 or vr>1 then 50.0 else 0.0 end end")} as participation from c""")
def _(t):
    return out(W.volume_ratio(bars(t)), "prior_median_volume", "volume_ratio", "persistence", "participation")


@query("win_12_open_gap", f"""with {B()}, g as (select *, open/{lag('close', 1)}-1 as gap from b)
 select {IDS}, {R('gap')} as gap, {R(needs('gap', 5, 'max(abs(gap))'))} as max_gap from g""")
def _(t):
    return out(W.open_gaps(bars(t)), "gap", "max_gap")


@query("win_13_downside_tail", f"""with {B()}, r as (select *, {ret(1)} as r1 from b),
 h as (select *, case when r1 is not null then case when r1<=-0.04 then 1.0 else 0.0 end end as hit from r)
 select {IDS}, count(hit) {sess(5)} as tail_obs, {R(f"case when count(hit) {sess(5)}>=4 then avg(hit) {sess(5)} end")} as tail_share from h""")
def _(t):
    return out(W.downside_tail(bars(t)), "tail_share", keep=("tail_obs",))


_PATH = f"""with {B(grain='month')}, l as (select *, {lr()} as lr from b), s as (select *, {needs('lr', 10, 'sum(lr)')} as net,
  {needs('lr', 10, 'sum(abs(lr))')} as sz, {needs('lr', 10, 'max(abs(lr))')} as big,
  {needs('lr', 10, 'sum(case when lr>0 then 1 else 0 end)')} as pos, {needs('lr', 10, 'sum(case when lr<0 then 1 else 0 end)')} as neg from l)"""


@query("win_14_path_shape", f"""{_PATH} select {IDS}, {R('net/nullif(sz,0)')} as path_efficiency, {R('big/nullif(sz,0)')} as largest_share,
 {R('pos/10.0')} as positive_share from s""")
def _(t):
    return out(W.path_shape(bars(t, grain="month")), "path_efficiency", "largest_share", "positive_share")


@query("win_15_information_discreteness", f"""{_PATH} select {IDS}, {R('sign(net)*(neg-pos)/nullif(neg+pos,0)')} as discreteness from s""")
def _(t):
    return out(W.path_shape(bars(t, grain="month")), "discreteness")


_UP = f"coalesce(case when close>{lag('close', 1)} then 1 else 0 end, 0)"


@query("win_16_up_run", f"""with {B()}, a as (select *, {_UP} as up from b),
 s as (select {IDS}, up, up*session_ix as z, coalesce(max(case when up=0 then session_ix end) over (partition by instrument_id order by session_ix), 0) as brk from a)
 select {IDS}, cast(least(session_ix-brk, 5) as int) as up_run from s""")
def _(t):
    return W.up_run(bars(t)).select(*ID, "up_run")


@query("win_17_state_run", f"""with {B(entity='type')}, s as (select {IDS}, case when close/{lag('close', 5)}-1>0 then 'up' else 'down' end as state from b),
 f as (select *, case when lag(state) {I}=state then 0 when lag(state) {I} is null then 0 else 1 end as fresh from s),
 g as (select *, sum(fresh) over (partition by instrument_id order by session_ix) as isle from f)
 select {IDS}, state, row_number() over (partition by instrument_id, isle order by session_ix) as run_length, isle=0 as reaches_start from g""")
def _(t):
    df = bars(t, "type").withColumn("state", F.when(W.simple_return(5) > 0, "up").otherwise("down"))
    return W.state_runs(df, "state").select(*ID, "state", F.col("run_length").cast("bigint").alias("run_length"), "reaches_start")


def _pairs(t):
    return W.pair_panel(bars(t, "type"))


_PAIR = f"""{B(entity='type')}, p as (select l.instrument_id||'/'||r.instrument_id as instrument_id, l.session_ix, l.close as lc, r.close as rc
  from b l join b r on l.session_ix=r.session_ix and l.instrument_id<r.instrument_id),
 pl as (select *, ln(lc/{lag('lc', 1)}) as l, ln(rc/{lag('rc', 1)}) as r from p)"""


def _pw(k):
    ok = f"count(l) {rows(k)}={k}"
    return (f"case when {ok} then lc/{lag('lc', k)}-1 end as lret{k}, case when {ok} then rc/{lag('rc', k)}-1 end as rret{k}, "
            f"case when {ok} then corr(l,r) {rows(k)} end as corr{k}")


_PAIRW = f"""{_PAIR}, pw as (select *, {_pw(5)}, {_pw(10)}, {_pw(20)}, {_pw(18)}, {_pw(22)} from pl),
 ps as (select *, lret5-rret5 as spread5, lret10-rret10 as spread10, lret20-rret20 as spread20 from pw)"""


def _dir(k):
    return (f"case when lret{k} is null or rret{k} is null then null when lret{k}>0 and rret{k}>0 then 'both_positive' "
            f"when lret{k}<0 and rret{k}<0 then 'both_negative' when lret{k}>0 and rret{k}<0 then 'left_positive_right_negative' "
            f"when lret{k}<0 and rret{k}>0 then 'left_negative_right_positive' when lret{k}=rret{k} then 'equal_returns' else 'flat_or_mixed' end")


@query("win_18_pair_windows", f"""with {_PAIRW} select {IDS}, {R('lret5')} as left_ret5, {R('rret5')} as right_ret5, {R('spread5')} as spread5,
 {R('spread10')} as spread10, {R('spread20')} as spread20, {R('corr5')} as corr5, {R('corr10')} as corr10, {R('corr20')} as corr20,
 {_dir(5)} as direction5, {_dir(20)} as direction20 from ps""")
def _(t):
    return out(W.pair_windows(_pairs(t)), "left_ret5", "right_ret5", "spread5", "spread10", "spread20", "corr5", "corr10", "corr20",
               keep=("direction5", "direction20"))


_LV = f"case when {cont(20)} then list(ratio) {rows(20)} end"
_LW = f"case when {cont(60)} then list(ratio) {rows(60)} end"


@query("win_19_ratio_statistics", f"""with {_PAIR}, q as (select *, ln(lc/rc) as ratio from p), v as (select *, {_LV} as s, {_LW} as w from q),
 m as (select *, list_aggregate(s,'median') as med from v), d as (select *, list_aggregate(list_transform(s, lambda x: abs(x-med)),'median') as mad from m)
 select {IDS}, {R('ratio')} as ratio, {R('case when mad>0 then (ratio-med)/mad end')} as ratio_z,
 {R('(len(list_filter(w, lambda x: x<ratio))+len(list_filter(w, lambda x: x=ratio))/2.0)/60')} as ratio_percentile from d""")
def _(t):
    return out(W.ratio_statistics(_pairs(t)), "ratio", "ratio_z", "ratio_percentile")


@query("win_20_perturbation", f"""with {_PAIRW} select {IDS}, {R('corr18')} as corr18, {R('corr20')} as corr20, {R('corr22')} as corr22,
 coalesce((corr18>=0.35)=(corr20>=0.35) and (corr20>=0.35)=(corr22>=0.35), false) as perturbation_consistent,
 coalesce(sign(spread20)=sign({lag('spread20', 20)}) and sign(spread20)<>0, false) as nonoverlap_consistent from ps""")
def _(t):
    return out(W.pair_windows(_pairs(t)), "corr18", "corr20", "corr22", keep=("perturbation_consistent", "nonoverlap_consistent"))


@query("win_21_amihud", f"""with {B(grain='month')}, l as (select *, {lr()} as lr, close*volume as dv from b),
 x as (select *, case when dv>0 then abs(lr)/dv end as x from l) select {IDS}, {R(needs('x', 20, 'avg(x)') + '*1e6')} as amihud from x""")
def _(t):
    return out(W.illiquidity(bars(t, grain="month")), "amihud")


def _versus(t, entity="brand", grain="week"):
    return W.versus_benchmark(bars(t, entity, grain), bars(t, "market", grain))


_VS = f"""{B('b0', 'brand')}, {B('mk', 'market')}, b as (select b0.*, mk.open as b_open, mk.close as b_close from b0 left join mk on mk.session_ix=b0.session_ix)"""


def _span(c, a, z):
    top = lag(c, z) if z else c
    return f"ln({top}/{lag(c, a)})"


@query("win_22_relative_windows", f"""with {_VS}, a as (select *, {_span('close', 126, 5)}-{_span('b_close', 126, 5)} as momentum,
  -({_span('close', 5, 0)}-{_span('b_close', 5, 0)}) as reversal, ln(close/open)-ln(b_close/b_open) as intra,
  ln(open/{lag('close', 1)})-ln(b_open/{lag('b_close', 1)}) as ov from b)
 select {IDS}, {R('momentum')} as momentum, {R('reversal')} as reversal,
  {R(f"case when {cont(5)} then {needs('intra', 5, 'sum(intra)')} end")} as intraday_5, {R(needs('ov', 5, 'sum(ov)'))} as overnight_5 from a""")
def _(t):
    return out(W.relative_windows(_versus(t)), "momentum", "reversal", "intraday_5", "overnight_5")


_DOWN = f"""with {_VS}, l as (select *, ln(close/{lag('close', 1)}) as s, ln(b_close/{lag('b_close', 1)}) as m from b),
 d as (select *, s-m as d, case when m<0 then s-m end as dn, pow(least(s-m,0.0),2) as sq from l),
 a as (select *, count(d) {rows(60)}=60 as whole, count(dn) {rows(60)} as ndn, avg(dn) {rows(60)} as adn, avg(sq) {rows(60)} as asq,
   var_samp(m) {rows(60)}*59 as sxx, var_samp(s) {rows(60)}*59 as syy, covar_samp(s,m) {rows(60)}*59 as sxy from d)"""


@query("win_23_down_market", f"""{_DOWN} select {IDS}, {R('case when whole and ndn>=12 then adn end')} as down_market_return,
 {R('case when whole then sqrt(252*asq) end')} as downside_deviation from a""")
def _(t):
    return out(W.down_market(_versus(t)), "down_market_return", "downside_deviation")


@query("win_24_residual_volatility", f"""{_DOWN} select {IDS},
 {R('case when whole and sxx>0 then sqrt(252*greatest(syy-sxy*sxy/sxx,0.0)/58) end')} as residual_volatility from a""")
def _(t):
    return out(W.down_market(_versus(t)), "residual_volatility")


_REL = f"""{B('b0', 'type')}, {B('mk', 'market')}, b as (select b0.*, mk.close as b_close from b0 left join mk on mk.session_ix=b0.session_ix),
 rel as (select *, {ret(5)}-(b_close/{lag('b_close', 5)}-1) as rel5, {ret(10)}-(b_close/{lag('b_close', 10)}-1) as rel10,
  {ret(20)}-(b_close/{lag('b_close', 20)}-1) as rel20 from b)"""


@query("win_25_acceleration", f"""with {_REL} select {IDS}, {R('rel5')} as rel5, {R('rel10')} as rel10, {R('rel20')} as rel20,
 {R('rel5-' + lag('rel5', 5))} as acceleration from rel""")
def _(t):
    return out(W.relative_strength(_versus(t, "type")), "rel5", "rel10", "rel20", "acceleration")


@query("win_26_peer_rank", f"""with {_REL} select {IDS}, {R('rel20')} as rel20,
 cast(case when rel20 is not null then dense_rank() over (partition by session_ix order by rel20 desc nulls last) end as bigint) as peer_rank,
 count(rel20) over (partition by session_ix) as peer_count from rel""")
def _(t):
    df = X.peer_rank(W.relative_strength(_versus(t, "type")), "rel20")
    return df.select(*ID, rnd("rel20").alias("rel20"), F.col("peer_rank").cast("bigint").alias("peer_rank"), "peer_count")


@query("win_30_discontinuity", f"""with {B()}, g as (select *, open/{lag('close', 1)} as open_ratio from b)
 select {IDS}, {R('open_ratio')} as open_ratio, open_ratio>=2 or open_ratio<=0.5 as severe from g""")
def _(t):
    return out(W.discontinuities(bars(t)), "open_ratio", keep=("severe",))


@query("win_32_chronological_half", f"""with {B()}, s as (select distinct session_ix from b),
 r as (select session_ix, row_number() over (order by session_ix) as rn, count(*) over () as n from s)
 select half, count(*) as n_bars, count(distinct b.session_ix) as n_sessions from b join
  (select session_ix, case when rn<=n//2 then 'first' else 'second' end as half from r) h on h.session_ix=b.session_ix group by 1""")
def _(t):
    from sessionloom.operators.aggregates import chronological_halves

    b = bars(t)
    return b.join(chronological_halves(b), "session_ix").groupBy("half").agg(
        F.count(F.lit(1)).alias("n_bars"), F.countDistinct("session_ix").alias("n_sessions"))


@query("win_33_rank_scale", f"""with {B()}, r as (select {IDS}, volume as v from b),
 u as (select {IDS}, 2.0*({_MID}-1)/(count(*) over (partition by session_ix)-1)-1 as unit, count(*) over (partition by session_ix) as n from r),
 k as (select * from u where n>1) select {IDS}, {R('unit')} as unit, {R('(unit-(select avg(unit) from k))/(select stddev_samp(unit) from k)')} as z from k""")
def _(t):
    return out(X.rank_scale(bars(t), "volume"), "unit", "z")


@query("win_35_sign_episodes", f"""with {B(entity='type')}, mk as (select instrument_id, session_ix, close from b),
 s as (select {IDS}, cast(sign({ret(5)}) as int) as side from b), c as (select * from s where side is not null),
 h as (select *, case when dense_rank() over (order by session_ix) <= (select count(distinct session_ix) from c)//2 then 'first' else 'second' end as half from c),
 f as (select *, case when lag(side) over (partition by instrument_id, half order by session_ix)=side then 0 else 1 end as fresh from h),
 g as (select *, sum(fresh) over (partition by instrument_id, half order by session_ix) as isle from f),
 e as (select instrument_id, half, isle, side, count(*) as n from g group by 1,2,3,4)
 select instrument_id, half, sum(case when side<>0 then 1 else 0 end)::bigint as episodes, max(n) as longest,
  {R('greatest(sum(case when side>0 then n else 0 end), sum(case when side<0 then n else 0 end))/sum(n)')} as dominant_share from e group by 1,2""")
def _(t):
    from sessionloom.operators.aggregates import sign_episodes

    df = bars(t, "type").withColumn("x", W.simple_return(5))
    return sign_episodes(df, "x").select("instrument_id", "half", "episodes", "longest", rnd("dominant_share").alias("dominant_share"))
