"""AGG-25 in full and JOB-49; the SQL finds the inverse by elimination and the components by its own rotations."""

from __future__ import annotations

from sessionloom.catalog.aggregates import FACTORS, FACTOR_SQL, factor_panel
from sessionloom.catalog.core import ORACLES, QUERIES, R, query
from sessionloom.catalog.jobs import _F1
from sessionloom.functions.numeric import rnd
from sessionloom.plans import factor_space as FS
from pyspark.sql import functions as F

ID = ["instrument_id", "session_ix"]
STATE = ["market_1", "market_5", "market_20", "rv10", "rv20", "median_1", "up_share", "dispersion"]


def _cell(i: int, j: int) -> str:
    return "1.0::double" if i == j else f"c_{min(i, j)}_{max(i, j)}"


def matrix_sql(z: str, columns: list[str]) -> str:
    """CTEs ending in ``mr`` (kind, item, value) from the complete rows of ``z``."""
    k = len(columns)
    pairs = [(i, j) for i in range(k) for j in range(i + 1, k)]
    n = len(pairs)
    matrix = "[" + ",".join("[" + ",".join(_cell(i, j) for j in range(k)) + "]" for i in range(k)) + "]"
    ident = "[" + ",".join("[" + ",".join("1.0::double" if i == j else "0.0::double" for j in range(k)) + "]" for i in range(k)) + "]"
    ps, qs = "[" + ",".join(str(i + 1) for i, _ in pairs) + "]", "[" + ",".join(str(j + 1) for _, j in pairs) + "]"
    right = f"list_transform(range(1,{k + 1}), lambda j: case when j=p then co*r[p]-si*r[q] when j=q then si*r[p]+co*r[q] else r[j] end)"
    entry = lambda kind, item, value: f"select '{kind}' as kind, {item} as item, cast({value} as double) as value"
    out = [entry("complete_rows", "''", "n") + " from co0", entry("rank", "''", "len(list_filter(ls, lambda x: abs(x)>list_max(ls)*" + str(k) + "*2.220446049250313e-16))") + " from es", entry("kaiser", "''", "len(list_filter(ls, lambda x: x>1.0))") + " from es",
           entry("participation", "''", "list_sum(ls)*list_sum(ls)/list_sum(list_transform(ls, lambda x: x*x))") + " from es", entry("condition", "''", "list_max(ls)/list_min(ls)") + " from es"]
    out += [entry("vif", f"'{c}'", f"g[{i + 1}][{k + i + 1}]") + f" from gj where step={k}" for i, c in enumerate(columns)]
    for j in range(1, k + 1):
        out += [entry("eigenvalue", f"'{j}'", f"ls[{j}]") + " from es", entry("ratio", f"'{j}'", f"ls[{j}]/list_sum(ls)") + " from es", entry("cumulative", f"'{j}'", f"list_sum(ls[1:{j}])/list_sum(ls)") + " from es"]
        out += [entry("loading", f"'{j}:{c}'", f"vs[{j}][{i + 1}]*case when list_first(list_filter(vs[{j}], lambda x: abs(x)=list_max(list_transform(vs[{j}], lambda y: abs(y)))))<0 then -1 else 1 end") + " from es" for i, c in enumerate(columns)]
    out += [entry("components", f"'{s}'", f"list_min(list_filter(list_transform(range(1,{k + 1}), lambda j: case when list_sum(ls[1:j])/list_sum(ls)>={s / 100} then j end), lambda x: x is not null))") + " from es" for s in (80, 90, 95)]
    return f"""cz as (select * from {z} where {' and '.join(f'{c} is not null' for c in columns)}), co0 as (select count(*) as n, {', '.join(f'corr({columns[i]},{columns[j]}) as c_{i}_{j}' for i, j in pairs)} from cz), mx as (select {matrix} as a from co0),
 jb as (select 0 as step, a, {ident} as v from mx union all select step+1,
   list_transform(range(1,{k + 1}), lambda i: case when i=p then list_transform(range(1,{k + 1}), lambda j: co*b[p][j]-si*b[q][j]) when i=q then list_transform(range(1,{k + 1}), lambda j: si*b[p][j]+co*b[q][j]) else b[i] end), w
   from (select step, p, q, co, si, list_transform(a, lambda r: {right}) as b, list_transform(v, lambda r: {right}) as w
     from (select *, 1/sqrt(tt*tt+1) as co, tt/sqrt(tt*tt+1) as si from (select *, case when a[p][q]=0 then 0.0 else (case when a[q][q]>=a[p][p] then 1.0 else -1.0 end)*(case when a[p][q]<0 then -1.0 else 1.0 end)/(abs((a[q][q]-a[p][p])/(2*a[p][q]))+sqrt(((a[q][q]-a[p][p])/(2*a[p][q]))**2+1)) end as tt
       from (select *, {ps}[step%{n}+1] as p, {qs}[step%{n}+1] as q from jb where step<{14 * n}))))),
 je as (select a[i][i] as l, list_transform(range(1,{k + 1}), lambda r: v[r][i]) as x from jb, (select unnest(range(1,{k + 1})) as i) where step={14 * n}),
 es as (select list(l order by l desc) as ls, list(x order by l desc) as vs from je),
 gj as (select 0 as step, list_transform(range(1,{k + 1}), lambda i: list_concat(a[i], {ident}[i])) as g from mx union all
   select step+1, list_transform(range(1,{k + 1}), lambda i: case when i=step+1 then list_transform(range(1,{2 * k + 1}), lambda j: g[step+1][j]/g[step+1][step+1]) else list_transform(range(1,{2 * k + 1}), lambda j: g[i][j]-g[i][step+1]*g[step+1][j]/g[step+1][step+1]) end) from gj where step<{k}),
 mr as ({' union all '.join(out)})"""


def panel_sql(raw: str, columns: list[str], session: bool) -> str:
    """CTEs ending in ``rep`` from a table ``raw`` with ID and the columns."""
    key = "instrument_id, session_ix" if session else "session_ix"
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1:]]
    if session:
        unit = "select *, 2.0*((rank() over (partition by session_ix, name order by value)+(count(*) over (partition by session_ix, name, value)-1)/2.0-0.5)/count(*) over (partition by session_ix, name)-0.5) as u, count(*) over (partition by session_ix, name) as gn from tl"
        scale = "un as (select * from (" + unit + ") where gn>=2), scl as (select name, count(*) as available, avg(u) as location, stddev_samp(u) as scale, 0 as fallback from un group by 1)"
    else:
        scale = ("un as (select *, value as u from tl), sm0 as (select name, median(value) as med, stddev_samp(value) as sd, count(*) as available from tl group by 1), sm1 as (select name, any_value(med) as location, any_value(sd) as sd, any_value(available) as available, "
                 "1.4826::double*median(abs(value-med)) as rob from tl join sm0 using (name) group by 1), scl as (select name, available, location, case when rob>0 then rob else sd end as scale, case when rob>0 then 0 else 1 end as fallback from sm1)")
    rank = lambda c: f"rank() over (order by {c})+(count(*) over (partition by {c})-1)/2.0"
    pr = [f"select 'both' as kind, '{a}/{b}' as item, cast(count(*) filter ({a} is not null and {b} is not null) as double) as value from {raw} union all select 'neither', '{a}/{b}', count(*) filter ({a} is null and {b} is null) from {raw} union all select 'pearson', '{a}/{b}', corr({a},{b}) from zw "
          f"union all select 'rank_dependence', '{a}/{b}', corr(x,y) from (select {rank(a)} as x, {rank(b)} as y from {raw} where {a} is not null and {b} is not null)" for a, b in pairs]
    sc = " union all ".join(f"select '{k}' as kind, name as item, cast({v} as double) as value from scl" for k, v in (("available", "available"), ("location", "location"), ("scale", "scale"), ("std_fallback", "fallback")))
    return f"""tl as (unpivot {raw} on {', '.join(columns)} into name name value value), {scale}, zt as (select un.*, (u-location)/scale as z from un join scl using (name)),
 zw as (select {key}, {', '.join(f"max(z) filter (name='{c}') as {c}" for c in columns)} from zt group by all), {matrix_sql('zw', columns)},
 rep as (select 'rows' as kind, '' as item, cast(count(*) as double) as value from {raw} union all {sc} union all {' union all '.join(pr)} union all select * from mr)"""


def _out(df):
    return df.select("kind", "item", rnd("value", 5).alias("value"))


_SELECT = f"select kind, item, {R('value', 5)} as value from rep"


@query("agg_25_components", f"with recursive {FACTOR_SQL}, {matrix_sql('fp', FACTORS)} select kind, item, {R('value', 5)} as value from mr")
def _(t):
    return _out(FS.matrix_report(FS.components(FS.correlation_row(factor_panel(t), FACTORS), FACTORS), FACTORS))


@query("job_49_security_factor_space", f"with recursive raw as ({ORACLES['job_46_factor_catalog']}), {panel_sql('raw', _F1, True)} {_SELECT}")
def _(t):
    return _out(FS.diagnostic(QUERIES["job_46_factor_catalog"](t.spark, t.sf_dir), ID, _F1, "session_ix"))


@query("job_49_market_state_space", f"with recursive raw as ({ORACLES['job_50_market_state_vector']}), {panel_sql('raw', STATE, False)} {_SELECT}")
def _(t):
    return _out(FS.diagnostic(QUERIES["job_50_market_state_vector"](t.spark, t.sf_dir), ["session_ix"], STATE))
