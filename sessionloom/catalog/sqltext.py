"""SQL text shared by the oracle queries (DuckDB dialect)."""

from __future__ import annotations

_KEYS = {
    "supplier": ("l_suppkey", "lineitem"),
    "market": ("'MARKET'", "lineitem"),
    "region": (
        "r_name",
        "lineitem join supplier on l_suppkey=s_suppkey join nation on s_nationkey=n_nationkey "
        "join region on n_regionkey=r_regionkey",
    ),
    "type": ("p_type", "lineitem join part on l_partkey=p_partkey"),
    "brand": ("p_brand", "lineitem join part on l_partkey=p_partkey"),
}


def ix(day: str, grain: str) -> str:
    if grain == "month":
        return f"cast((year({day})-1995)*12+month({day}) as int)"
    return f"cast(date_diff('day', date '1995-01-02', {day})//7+1 as int)"


def bars(name: str = "b", entity: str = "supplier", grain: str = "week") -> str:
    key, src = _KEYS[entity]
    row = "row(l_shipdate,l_orderkey,l_linenumber,l_partkey,l_extendedprice,l_quantity)"
    px = "l_extendedprice/l_quantity"
    return f"""{name} as (
  select *, {ix('session_date', grain)} as session_ix from (
    select {key} as instrument_id, cast(date_trunc('{grain}', l_shipdate) as date) as session_date,
      arg_min({px}, {row}) as open, max({px}) as high, min({px}) as low, arg_max({px}, {row}) as close,
      sum(l_quantity) as volume, cast(sum(cast(round(l_extendedprice*100) as bigint)) as bigint)/100.0 as notional,
      count(*) as trades
    from {src} group by 1,2))"""


MASTER = """m as (
  select s_suppkey as instrument_id, s_name as ticker, case when s_suppkey%5<>0 then 'CS' else 'ADRC' end as form,
    r_name as exchange, n_name as country, s_acctbal as acctbal, s_acctbal>0 as is_primary
  from supplier join nation on s_nationkey=n_nationkey join region on n_regionkey=r_regionkey)"""

UNIVERSE = "u as (select s_suppkey as instrument_id from supplier where s_acctbal>0)"

SPLITS = """sp0 as (select s_suppkey as instrument_id, s_name as ticker, cast(40+(s_suppkey*37)%280 as int) as effective_ix,
    cast(2+s_suppkey%3 as int) as step, s_suppkey%8=0 as rev, s_suppkey%16=0 as paired from supplier where s_suppkey%4=0),
  sp1 as (select *, case when rev then step else 1 end as split_from, case when rev then 1 else step end as split_to, 1 as seq from sp0),
  sp as (select 'S-'||instrument_id||'-'||seq as action_id, instrument_id, ticker, effective_ix, split_from, split_to, seq from sp1
    union all select 'S-'||instrument_id||'-2', instrument_id, ticker, effective_ix, split_to, split_from, 2 from sp1 where paired)"""

DIVIDENDS = """dv as (select 'D-'||s.instrument_id as action_id, s.instrument_id, s.ex_ix, b.close*0.01*s.pct as cash, b.close as prior_close
   from (select s_suppkey as instrument_id, cast(45+(s_suppkey*37)%280 as int) as ex_ix, cast(1+s_suppkey%40 as int) as pct
         from supplier where s_suppkey%3=0) s join b on b.instrument_id=s.instrument_id and b.session_ix+1=s.ex_ix)"""

FILINGS = """f as (select o_custkey as cik, o_orderpriority as concept,
    case o_orderstatus when 'F' then '10-K' when 'O' then '10-Q' else '8-K' end as form,
    cast(date_trunc('quarter', o_orderdate) - interval 1 day as date) as period_end,
    o_orderdate + interval '16 hours 5 minutes' as available_at, o_orderkey as accession, o_totalprice as value from orders)"""

I = "over (partition by instrument_id order by session_ix)"


def rows(n: int, end: int = 0) -> str:
    last = f"{end} preceding" if end else "current row"
    return f"over (partition by instrument_id order by session_ix rows between {n - 1 + end} preceding and {last})"


def sess(n: int, end: int = 0) -> str:
    last = f"{end} preceding" if end else "current row"
    return f"over (partition by instrument_id order by session_ix range between {n - 1 + end} preceding and {last})"


def lag(c: str, k: int) -> str:
    return f"(case when session_ix - lag(session_ix,{k}) {I} = {k} then lag({c},{k}) {I} end)"


def cont(n: int) -> str:
    return f"(session_ix - lag(session_ix,{n - 1}) {I} = {n - 1})"


def full(agg: str, n: int) -> str:
    return f"(case when {cont(n)} then {agg} {rows(n)} end)"


def needs(x: str, n: int, agg: str) -> str:
    return f"(case when count({x}) {rows(n)} = {n} then {agg} {rows(n)} end)"


def ret(k: int) -> str:
    return f"(close/{lag('close', k)}-1)"


def lr() -> str:
    return f"ln(close/{lag('close', 1)})"
