"""Registered queries of the text operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ctph, divergence, exact, language, lines, mixing, pieces, probminhash, quality, ranked, tokens, topk, urls
from .common import table


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(table(spark, sf_dir, "pages"))


OP1 = r"""
with u as (select page_id, coalesce(url, '') as url from pages),
h as (select page_id, translate(regexp_extract(url, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
             regexp_extract(url, '://[^/?#]*([^?#]*)', 1) as path from u),
r(rh, rp, rv) as (values ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
f as (select h.*, (select arg_max(rh || rp || '|' || rv, length(rh || rp)) from r where (host = rh or ends_with(host, '.' || rh)) and starts_with(path, rp)) as hit from h)
select page_id, host, path, split_part(hit, '|', 1) as rule, coalesce(split_part(hit, '|', 2), 'allow') as verdict from f
"""


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.without_repeats(table(spark, sf_dir, "documents"))


OP2 = r"""
with l as (select doc_id, text, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 as i from documents),
w as (select *, trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as t, len(regexp_extract_all(line, '[^ 	-
]+')) as n from l),
f as (select *, row_number() over (partition by doc_id order by i) as p, sum(n) over (partition by doc_id order by i) as total from w where n > 0),
e as (select a.doc_id, a.i, a.p, a.total - a.n as before, b.i as last, b.p as q
      from f a asof join f b on a.doc_id = b.doc_id and a.total - a.n + 50 <= b.total),
lists as (select doc_id, list(t order by p) as ts from f group by doc_id),
k as (select e.doc_id, e.i as first, e.last, md5(list_slice(ts, e.p, e.q)::varchar) as h from e join lists using (doc_id)),
o as (select *, row_number() over (partition by h order by doc_id, first) as r from k),
g as (select distinct l.doc_id, l.i from o join l on l.doc_id = o.doc_id and l.i between o.first and o.last where o.r > 1),
z as (select l.doc_id, count(g.i) as deleted, coalesce(string_agg(l.line, chr(10) order by l.i) filter (g.i is null), '') as text, count(*) as lines
      from l left join g on g.doc_id = l.doc_id and g.i = l.i group by l.doc_id)
select d.doc_id, case when d.text is null then null else z.text end as text, case when coalesce(d.text, '') = '' then 0 else z.lines end as lines, z.deleted
from documents d join z using (doc_id)
"""


def op2_whole_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, with every repeated run deleted up to its last line."""
    return lines.without_repeats(table(spark, sf_dir, "documents"), whole=True)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.document_languages(table(spark, sf_dir, "documents"))


def page_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same operator on raw pages, where all four kinds of evidence exist."""
    return language.page_languages(table(spark, sf_dir, "pages"))


def op4_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


OP4 = """
with v as (select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as v from embeddings
           where embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
s as (select q.vec_id as query_id, c.vec_id, list_inner_product(q.v, c.v)::bigint as score from v q, v c where q.vec_id % 50 = 0 and c.vec_id <> q.vec_id),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, rank::int as rank, vec_id, score from r where rank <= 5
"""


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_documents(table(spark, sf_dir, "documents"))


def op6_quality_grade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.graded(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_piecewise_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctph.fingerprints(table(spark, sf_dir, "documents"))


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


OP8 = r"""
with d as (select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
                  ('0x' || substr(md5('mix-1:' || coalesce(doc_id::varchar, '')), 1, 15))::bigint as key from documents),
s as (select source, sum(size)::bigint as source_size from d group by source),
w as (select *, case (row_number() over (order by source nulls last) - 1) % 3 when 0 then 5 when 1 then 2 else 1 end as weight from s),
o as (select *, row_number() over (order by 3.0 * source_size / weight, source nulls last) as k from w),
c as (select k, (select sum(source_size) from o) - coalesce(sum(3 * source_size) over (order by k rows between unbounded preceding and 1 preceding), 0) as budget,
             sum(weight) over (order by k rows between current row and unbounded following) as left_weight, weight, source_size from o),
f as (select min(k) as k from c where weight * budget::double / left_weight < 3 * source_size),
l as (select budget::double as budget, left_weight::double as left_weight, c.k from c join f on c.k = f.k),
t as (select o.source, o.source_size, case when l.k is null or o.k < l.k then 3.0 * o.source_size else o.weight * l.budget / l.left_weight end::double as target from o left join l on true),
p as (select d.*, t.source_size, t.target, floor(t.target)::bigint as budget,
             coalesce(sum(size) over (partition by d.source order by key, doc_id, size rows between unbounded preceding and 1 preceding), 0) as before
      from d join t on d.source is not distinct from t.source)
select doc_id, size, source_size, target,
       (case when source_size > 0 then budget // source_size else 0 end * size
        + greatest(0, least(size, budget - (case when source_size > 0 then budget // source_size else 0 end) * source_size - before)))::bigint as taken
from p
"""

def op9_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, class_id (the smallest doc_id of its class), keep (whether it is that document)."""
    classes = probminhash.near_classes(table(spark, sf_dir, "documents"))
    return classes.select("doc_id", F.col("class").alias("class_id"), (F.col("key") == F.col("class")).alias("keep"))


def op10_section_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.section_tokens(table(spark, sf_dir, "documents"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


OP11 = r"""
with d as (select coalesce(lang, '') as lang, coalesce(source, '') as source, row_number() over () as k,
                  list_transform(regexp_extract_all(coalesce(text, ''), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) as ts from documents),
w as (select lang, source, k, unnest(ts) as term from d),
vocab as (select lang, term, count(*) as c from w group by lang, term having count(distinct k) >= 3),
size as (select lang, count(*) as v, sum(c) as n from vocab group by lang),
c as (select w.lang, w.source, w.term, count(*) as c from w join vocab using (lang, term) group by all),
g as (select lang, source, coalesce(max(v), 0) as v, coalesce((select sum(c) from c where c.lang = d.lang and c.source = d.source), 0) as n from d left join size using (lang) group by lang, source),
p as (select g.lang, g.source, vocab.term, coalesce(c.c, 0) as c, 1 + (1000000000::hugeint * (coalesce(c.c, 0) + 1)) // (g.n + g.v) as p, 1 + (1000000000::hugeint * (vocab.c + 1)) // (size.n + size.v) as q
      from g join vocab using (lang) join size using (lang) left join c on c.lang = g.lang and c.source = g.source and c.term = vocab.term),
pairs as (select a.lang, a.source, b.source as item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) as value from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
allpairs as (select a.lang, a.source, b.source as item, coalesce(value, 0) as value from g a join g b on a.lang = b.lang and a.source <> b.source
             left join pairs on pairs.lang = a.lang and pairs.source = a.source and pairs.item = b.source),
t as (select lang, source, 'term' as part, term as item, ((p - q) * (p - q)) // q as value from p where c > 0 and p > q),
r as (select *, row_number() over (partition by lang, source, part order by value desc, item) as rank from (select lang, source, 'pair' as part, item, value from allpairs union all select * from t))
select lang, source, part, item, value::bigint as value, rank::int as rank from r where part = 'pair' or rank <= 200
"""


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_classes(table(spark, sf_dir, "documents")).drop("hash")


OP12 = r"""
with d as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as t from documents)
select doc_id, min(doc_id) over (partition by t) as keep_id, count(*) over (partition by t) as group_size, row_number() over (partition by t order by doc_id nulls last) = 1 as kept, sha256(t) as text_sha256 from d
"""


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP13 = r"""
with d as (select doc_id, row_number() over () as k, list_transform(regexp_extract_all(coalesce(text, ''), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) as ts from documents),
q as (select distinct item_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as term from benchmark),
s as (select count(*) as n, sum(len(ts))::bigint as l from d where len(ts) > 0),
f as (select k, term, count(*) as tf from (select k, unnest(ts) as term from d) where term in (select term from q) group by all),
w as (select term, floor(1000 * ln((2 * (select n from s) + 2) / (2 * count(*) + 1)))::bigint as w from f group by term),
m as (select k, doc_id, 100 - 50 + (50 * len(ts) * (select n from s)) // (select l from s) as m from d where len(ts) > 0),
r as (select q.item_id, m.k, m.doc_id, sum(w.w * ((1000000000 * f.tf) // (1000 * f.tf + 20 * m.m))) as score from q join f using (term) join w using (term) join m using (k) group by all having sum(w.w * ((1000000000 * f.tf) // (1000 * f.tf + 20 * m.m))) > 0),
o as (select *, row_number() over (partition by item_id order by score desc, doc_id nulls last) as rank from r)
select item_id, rank::int as rank, doc_id, score::bigint as score from o where rank <= 50
"""

QUERIES = {"op1_url_filters": op1_url_filters, "op2_line_dedup": op2_line_dedup, "op2_whole_runs": op2_whole_runs, "op3_language_id": op3_language_id, "page_language_id": page_language_id, "op4_exact_top_k": op4_exact_top_k, "op5_sentencepiece": op5_sentencepiece, "op6_quality_grade": op6_quality_grade, "op7_piecewise_hash": op7_piecewise_hash, "op8_source_mix": op8_source_mix, "op9_minhash_dedup": op9_minhash_dedup, "op10_section_tokens": op10_section_tokens, "op11_source_divergence": op11_source_divergence, "op12_exact_dedup": op12_exact_dedup, "op13_ranked_search": op13_ranked_search}
ORACLES = {"op1_url_filters": OP1, "op2_line_dedup": OP2, "op4_exact_top_k": OP4, "op8_source_mix": OP8, "op11_source_divergence": OP11, "op12_exact_dedup": OP12, "op13_ranked_search": OP13}
