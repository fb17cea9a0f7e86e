"""SQL of the registered queries, for a second engine."""

ORACLE: dict[str, str] = {}

ORACLE["op10_exact_dedup"] = """
with d as (select doc_id, sha256(coalesce(text, '')) as text_sha256 from documents)
select doc_id, max(doc_id) over g as keep_id, count(*) over g as group_size,
       doc_id = max(doc_id) over g as kept, text_sha256
from d window g as (partition by text_sha256)
"""

ORACLE["op2_mix_sources"] = """
with sizes as (
  select source, sum(greatest(length(coalesce(text, '')), 1)) as size from documents group by source),
weighted as (select source, size, pow(size::double, 0.7) as weight from sizes),
rates as (
  select source, weight / (select sum(weight) from weighted) * (select sum(size) from weighted) / size as rate
  from weighted),
steps as (
  select source, k, exp(-rate + k * ln(rate) - lgamma(k + 1)) as p
  from rates, unnest(range(0, 400)) as t(k) where k <= ceil(rate + 12 * sqrt(rate) + 20)),
cdf as (select source, k, sum(p) over (partition by source order by k) as cdf from steps),
drawn as (
  select doc_id, source,
         (('0x' || substr(md5('17:' || doc_id), 1, 13))::bigint + 0.5) / 4503599627370496.0 as u from documents),
counted as (
  select d.doc_id, d.source, count(*) as n_copies
  from drawn d join cdf c on d.source is not distinct from c.source and c.cdf <= d.u group by all)
select doc_id, source, copy, n_copies,
       ('0x' || substr(md5('17 place:' || doc_id || ':' || copy), 1, 15))::bigint as place
from counted, unnest(range(0, n_copies)) as t(copy)
"""

ORACLE["op12_filter_audit"] = r"""
with d as (
  select doc_id, coalesce(source, '') as part, coalesce(text, '') as text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents),
l as (select doc_id, max(case when quality = 1 then 1 else 0 end) as good, max(case when toxic = 1 then 1 else 0 end) as toxic
      from labels group by doc_id),
failed as (
  select doc_id, part,
         case when len(words) < 50 then 1 else 0 end as a,
         case when 100 * len(list_distinct(words)) < 65 * len(words) then 1 else 0 end as b,
         case when 100 * len(regexp_extract_all(text, '[A-Z]')) > 5 * length(text) then 1 else 0 end as c,
         case when regexp_matches(text, '[#$%&*|]') then 1 else 0 end as d,
         case when min(doc_id) over (partition by text) < doc_id then 1 else 0 end as e from d),
counted as (
  select part, a, b, c, d, e, count(*) as n, coalesce(sum(good), 0) as good, coalesce(sum(toxic), 0) as toxic
  from failed left join l using (doc_id) group by all),
letters as (select unnest(['A', 'B', 'C', 'D', 'E']) as x),
orders as (
  select p.x || q.x || r.x || s.x || t.x as filter_order
  from letters p, letters q, letters r, letters s, letters t
  where len(list_distinct([p.x, q.x, r.x, s.x, t.x])) = 5),
steps as (select filter_order, step, substr(filter_order, step, 1) as letter, substr(filter_order, 1, step - 1) as prefix
          from orders, unnest(range(1, 6)) as u(step)),
seen as (
  select part, filter_order, step, n, good, toxic, a + b + c + d + e as fails,
         case letter when 'A' then a when 'B' then b when 'C' then c when 'D' then d else e end as now,
         (a = 1 and contains(prefix, 'A')) or (b = 1 and contains(prefix, 'B')) or (c = 1 and contains(prefix, 'C'))
         or (d = 1 and contains(prefix, 'D')) or (e = 1 and contains(prefix, 'E')) as gone
  from counted, steps)
select part, filter_order, step::int as step,
       coalesce(sum(n) filter (now = 0 and not gone), 0)::bigint as kept,
       coalesce(sum(n) filter (now = 1 and not gone), 0)::bigint as removed,
       coalesce(sum(n) filter (now = 1 and gone), 0)::bigint as redundant,
       coalesce(sum(n) filter (now = 1 and fails = 1), 0)::bigint as unique_fails,
       coalesce(sum(good) filter (now = 1 and not gone), 0)::bigint as good_lost,
       coalesce(sum(toxic) filter (now = 1 and not gone), 0)::bigint as toxic_lost,
       coalesce(sum(case when now = 1 then n * (120 // greatest(fails, 1)) end), 0)::bigint as shapley
from seen group by part, filter_order, step
"""
