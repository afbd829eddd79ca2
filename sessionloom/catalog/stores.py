"""SRC-07: family tables published, republished and contradicted, then read back."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionloom.catalog.core import query
from sessionloom.catalog.filters import LADDER_SQL, ladder
from sessionloom.catalog.sqltext import DIVIDENDS, SPLITS, bars as B
from sessionloom.functions.staging import cut, shared_folder
from sessionloom.operators import joins as J
from sessionloom.sources import families as FT
from sessionloom.sources.fixtures import bars, dividends, master, session_range, splits


def family_rows(t) -> list[tuple[FT.Family, DataFrame]]:
    """Rows of each family, derived from the order tables."""
    b, c = bars(t), F.col
    year = lambda x: (F.lit(1995) + F.floor((c(x) - 1) / 52)).cast("int")
    none = F.lit(None)
    acts = splits(t).select(F.lit("first").alias("provider"), year("effective_ix").alias("event_year"), "action_id", F.lit("split").alias("action_type"), "instrument_id", "effective_ix", "split_from", "split_to", none.alias("cash_amount"),
                            F.lit("resolved").alias("resolution"))
    paid = dividends(t, b).select(F.lit("second").alias("provider"), year("ex_ix").alias("event_year"), "action_id", F.lit("cash_dividend").alias("action_type"), "instrument_id", c("ex_ix").alias("effective_ix"), none.alias("split_from"),
                                  none.alias("split_to"), F.round("cash", 6).alias("cash_amount"), F.lit("resolved").alias("resolution"))
    names = master(t).select("instrument_id", "ticker", c("exchange").alias("primary_exchange"))
    life = b.groupBy("instrument_id").agg(F.min("session_date").alias("first_tradable_date"), F.max("session_date").alias("last_tradable_date")).join(names, "instrument_id")
    life = life.select(F.lit("2002-01-01").alias("as_of_date"), "*", F.when(c("last_tradable_date") < "2001-06-01", "inactive").otherwise("active").alias("lifecycle_status"))
    member = ladder(t).select(c("policy").alias("methodology_version"), F.floor((c("session_ix") - 1) / 13).alias("quarter"), F.lit("primary").alias("universe_id"), "instrument_id", "session_ix", "disposition",
                              (c("disposition") == "included").alias("is_member"))
    last = session_range(t)[1]
    factor = J.split_factor(b, splits(t), F.lit(last)).select(F.lit("v1").alias("methodology_version"), F.lit(last).alias("basis_ix"), "instrument_id", c("session_ix").alias("source_ix"), F.round("price_factor", 8).alias("split_price_multiplier"),
                                                             F.lit("exact").alias("status"))
    return [(FT.ACTIONS, acts.unionByName(paid)), (FT.LIFECYCLE, life), (FT.MEMBERSHIP, member), (FT.ADJUSTMENTS, factor)]



def _published(t, family: FT.Family, rows: DataFrame) -> DataFrame:
    """Three publications: partitions with an even last key, all partitions, all with the first instrument's rows changed."""
    root = shared_folder(t.spark, "families")
    rows = cut(family.typed(rows))
    last, (k1, *more) = F.col(family.partitions[-1]), family.partitions
    even = (F.year(last) if family is FT.LIFECYCLE else last) % 2 == 0
    status = family.fields[-1] if family is not FT.MEMBERSHIP else "disposition"
    odd = rows.withColumn(status, F.when(F.col("instrument_id") == 3, "changed").otherwise(F.col(status)))
    plans = [FT.publish(x, root, family).select(*family.partitions, F.col("action").alias(f"step{i}")) for i, x in enumerate((rows.where(even), rows, odd), 1)]
    back = FT.read(t.spark, root, family)
    out = back.groupBy(*family.partitions).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("instrument_id").alias("n_instruments"), F.count_if(F.col(status) == "changed").alias("n_changed"), F.sum(F.length(F.col(status))).alias("letters"))
    for p in plans:
        out = out.join(p, [*family.partitions], "left")
    key = [F.col(k1).cast("string").alias("key1"), (F.col(more[0]).cast("string") if more else F.lit("")).alias("key2")]
    return out.select(F.lit(family.name).alias("family"), *key, "n", "n_instruments", "n_changed", "letters", "step1", "step2", "step3")


_STEPS = "case when even then 'write' end as step1, case when even then 'no_op' else 'write' end as step2, case when n3>0 then 'conflict' else 'no_op' end as step3"
_FAMILY_SQL = f"""with {LADDER_SQL}, {SPLITS}, {DIVIDENDS},
 ac as (select 'first' as p, effective_ix as ix, instrument_id from sp union all select 'second', ex_ix, instrument_id from dv),
 lf as (select instrument_id, max(session_date) as z from b group by 1),
 fr as (
  select 'corporate-action-observation' as family, p as key1, cast(1995+(ix-1)//52 as varchar) as key2, instrument_id, 'resolved' as s, (1995+(ix-1)//52)%2=0 as even from ac
  union all select 'instrument-lifecycle', '2002-01-01', '', instrument_id, case when z<date '2001-06-01' then 'inactive' else 'active' end, true from lf
  union all select 'universe-membership', policy, cast((session_ix-1)//13 as varchar), instrument_id, disposition, ((session_ix-1)//13)%2=0 from ld
  union all select 'adjustment-ledger', 'v1', cast((select max(session_ix) from b) as varchar), instrument_id, 'exact', (select max(session_ix) from b)%2=0 from b),
 fg as (select family, key1, key2, any_value(even) as even, count(*) as n, count(distinct instrument_id) as n_instruments, count(*) filter (instrument_id=3) as n3, cast(sum(length(s)) as bigint) as letters from fr group by 1,2,3)
 select family, key1, key2, n, n_instruments, cast(0 as bigint) as n_changed, letters, {_STEPS} from fg"""


@query("src_07_family_tables", _FAMILY_SQL)
def _(t):
    return reduce(DataFrame.unionByName, [_published(t, f, rows) for f, rows in family_rows(t)])
