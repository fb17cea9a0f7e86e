"""The registered queries in ANSI SQL, for a second engine on the same tables.

Written from the definitions, not from the Spark plans: all pairs are cross-joined, windows are global,
chunking is a recursion over lines.
"""

from __future__ import annotations

from siftrank.functions import fixed_values as fv

KS = fv.METRIC_KS


def _sql_text(value: str) -> str:
    """SQL expression for a text with line breaks."""
    lines = value.split("\n")
    return " || chr(10) || ".join("'" + line.replace("'", "''") + "'" for line in lines)


# --- Fixtures ------------------------------------------------------------------------------------

LINES = """(select *, ('0x' || substr(md5(concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity::int, l_returnflag,
    l_linestatus)), 1, 15))::bigint as row_no from lineitem) as lines"""
VECTOR_COUNT = "(select count(*) from embeddings)"

JUDGED_ROWS = f"""
judged_rows as (
  select l_suppkey as qid, d.vec_id as did, row_no,
    case when q.label = d.label then 1 else 0 end as relevance_label,
    case n_regionkey when 0 then ' Factual' when 1 then 'factual ' when 2 then 'how-to' else 'Open question' end as "Question_type",
    case when s_acctbal < 0 then 'FALSE' when s_acctbal < 4000 then '1' when s_acctbal < 7000 then 'true' else ' no ' end as specific_to_paper,
    case when l_linestatus = 'O' then '' else p_brand end as "IPAC_filename"
  from {LINES}
  join embeddings q on q.vec_id = l_suppkey % {VECTOR_COUNT}
  join embeddings d on d.vec_id = l_partkey % {VECTOR_COUNT}
  join supplier on s_suppkey = l_suppkey
  join nation on n_nationkey = s_nationkey
  join part on p_partkey = l_partkey)"""

VECTORS = f"""
qv as (select s_suppkey as qid, embedding::double[] as v from embeddings join supplier on s_suppkey % {VECTOR_COUNT} = vec_id),
dv as (select vec_id as did, embedding::double[] as v from embeddings),
all_pairs as (select qid, did, round(list_dot_product(qv.v, dv.v), 6) + 0.0 as score from qv cross join dv)"""

TEXT_PAIRS = f"""
text_pairs as (
  select row_no, ' ' || c.text || chr(10) as "Question", d.text as chunk_text,
    case when l_returnflag = 'R' and l_quantity >= 50 then 2 when l_returnflag = 'R' then 1 else 0 end as label
  from {LINES}
  join (select conv_id as sized, count(*) as n_turns from conversations group by conv_id)
    on sized = l_suppkey % (select count(distinct conv_id) from conversations)
  join conversations c on c.conv_id = sized and c.turn = l_linenumber % n_turns
  join documents d on d.doc_id = l_partkey % (select count(*) from documents)),
clean as (
  select row_no, trim("Question", ' ' || chr(10) || chr(9) || chr(13)) as question,
    trim(chunk_text, ' ' || chr(10) || chr(9) || chr(13)) as chunk_text, label from text_pairs),
kept as (select * from clean where question in (select question from clean group by question having max(label) = 1)),
q_ids as (select question, row_number() over (order by min(row_no)) - 1 as q_ord from kept group by question),
d_ids as (select chunk_text, row_number() over (order by min(row_no)) - 1 as d_ord from kept group by chunk_text),
judged as (
  select q_ord, d_ord, max(case when label = 1 then 1 else 0 end) as relevant, arg_min(label, row_no) as first_label,
    min(row_no) as first_row
  from kept join q_ids using (question) join d_ids using (chunk_text) group by q_ord, d_ord)"""


def _letters(text: str, folded: bool = False) -> str:
    count = "(length({0}) - length(replace({0}, chr({1}), '')))::double"
    found = count.format(text, "i::int") + (" + " + count.format(text, "(i - 32)::int") if folded else "")
    counts = f"list_transform(range(97, 123), lambda i: {found})"
    return (f"list_transform([{counts}], lambda c: list_transform(c, lambda x: "
            f"(x / (case when list_sum(c) = 0 then 1 else sqrt(list_dot_product(c, c)) end))::float::double))[1]")


def _chunks(min_tokens: str, name: str = "chunks", docs: str = "documents", sizes: str = "") -> str:
    """Chunks by recursion over the non-blank lines of each document."""
    return f"""
lines as (
  select doc_id, row_number() over (partition by doc_id order by i) as i, line,
    len(list_filter(regexp_split_to_array(line, '\\s+'), lambda w: w <> '')) as n
  from (select doc_id, unnest(range(1, len(parts) + 1)) as i, trim(unnest(parts), ' ' || chr(9) || chr(10) || chr(13)) as line
        from (select doc_id, string_split(text, chr(10)) as parts from {docs}))
  where line <> ''),
sizes as (select unnest([{min_tokens}]) as min_tokens),
walk as (
  select min_tokens, doc_id, i, n as held, 0 as pos from lines cross join sizes where i = 1
  union all
  select w.min_tokens, w.doc_id, l.i, case when w.held >= w.min_tokens then l.n else w.held + l.n end,
    case when w.held >= w.min_tokens then w.pos + 1 else w.pos end
  from walk w join lines l on l.doc_id = w.doc_id and l.i = w.i + 1),
{name} as (
  select min_tokens, doc_id, 'doc_' || doc_id as file_name, pos, string_agg(line, ' ' order by i) as text, sum(n)::int as num_tokens
  from walk join lines using (doc_id, i) group by min_tokens, doc_id, pos)"""


def _metric_sums() -> str:
    cols = [f"sum(case when relevant = 1 and rank <= {k} then 1 / log2(rank + 1) else 0 end) as dcg{k}" for k in KS]
    cols += [f"sum(case when relevant = 1 and rank <= {k} then hits * 1.0 / rank else 0 end) as ap{k}" for k in KS]
    return ", ".join(cols)


def _metrics(run: str, qrels: str, by: str = "", divisor: str = "num_relevant") -> str:
    """CTEs from run(by, qid, did, score) and qrels(by, qid, did) to per_query."""
    group = f"{by}, " if by else ""
    keys = f"{group}qid"
    using = f"using ({keys})"
    idcg = "list_sum(list_transform(range(1, least(num_relevant, {k}) + 1), lambda r: 1 / log2(r + 1)))"
    ndcg = ", ".join(f'coalesce(dcg{k}, 0) / {idcg.format(k=k)} as "ndcg@{k}"' for k in KS)
    maps = ", ".join(f'coalesce(ap{k}, 0) / ({divisor.format(k=k)}) as "map@{k}"' for k in KS)
    return f"""
ranked as (select *, row_number() over (partition by {keys} order by score desc, did) as rank from {run}),
flagged as (
  select r.*, case when q.did is null then 0 else 1 end as relevant
  from ranked r left join (select distinct {keys}, did from {qrels}) q using ({keys}, did)),
hit as (select *, sum(relevant) over (partition by {keys} order by rank) as hits from flagged),
sums as (select {keys}, {_metric_sums()} from hit group by {keys}),
counts as (select {keys}, count(distinct did) as num_relevant from {qrels} group by {keys}),
per_query as (select {keys}, num_relevant, {ndcg}, {maps} from counts left join sums {using})"""


NAMES = [f"ndcg@{k}" for k in KS] + [f"map@{k}" for k in KS]
MEANS = ", ".join(f'round(avg("{n}"), 6) + 0.0 as "{n}"' for n in NAMES)
QRELS = "qrels as (select qid, did from judged_rows where relevance_label = 1)"
ALLOW = "allow_run as (select qid, did, score from all_pairs join (select distinct qid, did from judged_rows) using (qid, did))"

FACET_TYPE = "lower(trim(\"Question_type\"))"
FACET_FLAG = ("case lower(trim(specific_to_paper)) when 'true' then 'yes' when '1' then 'yes' "
              "when 'false' then 'no' when '0' then 'no' else lower(trim(specific_to_paper)) end")
TITLES = ("case facet when 'factual' then 'Factual' when 'how-to' then 'How-To' when 'open question' then 'Open Question' end")


def _facet(expr: str, out: str, full: bool) -> str:
    rows = f"facets as (select distinct qid, {expr} as facet from judged_rows)"
    if full:
        # The full-corpus table carries each pair's first label, so relevance follows that.
        labels = "first_label as (select qid, did, arg_min(relevance_label, row_no) as lab from judged_rows group by qid, did)"
        parts = (f"{rows}, {labels}, f_run as (select facet, qid, did, score from all_pairs join facets using (qid)), "
                 "f_qrels as (select facet, qid, did from first_label join facets using (qid) where lab = 1)")
    else:
        # Equal scores rank by the first row of the document.
        firsts = "firsts as (select qid, did, min(row_no) as first_row from judged_rows group by qid, did)"
        parts = (f"{rows}, {ALLOW}, {firsts}, "
                 "f_run as (select facet, qid, first_row as did, score from allow_run join facets using (qid) join firsts using (qid, did)), "
                 "f_qrels as (select facet, qid, first_row as did from judged_rows join facets using (qid) join firsts using (qid, did) where relevance_label = 1)")
    label = TITLES if out == '"Question_type"' else "facet"
    return (f"with {JUDGED_ROWS}, {VECTORS}, {parts}, {_metrics('f_run', 'f_qrels', 'facet')} "
            f"select 'base' as model, {label} as {out}, {MEANS} from per_query group by facet")


SCORED = """
scored as (
  select 'base' as model, value as score, case when event_type = 'error' then 1 else 0 end as label from events
  union all
  select 'tuned', -value, case when event_type = 'error' then 1 else 0 end from events)"""


def _curve(source: str = SCORED) -> str:
    return f"""{source},
by_score as (select model, score, sum(label) as tp, sum(1 - label) as fp from scored group by model, score),
curve as (
  select *, sum(tp) over (partition by model order by score desc) as ctp, sum(fp) over (partition by model order by score desc) as cfp,
    sum(tp) over (partition by model) as pos, sum(fp) over (partition by model) as neg,
    lead(tp) over (partition by model order by score desc) as next_tp, lead(fp) over (partition by model order by score desc) as next_fp
  from by_score)"""


AP = "sum(tp * 1.0 / pos * ctp / (ctp + cfp))"
F1 = ("2 * (ctp * 1.0 / (ctp + cfp)) * (ctp * 1.0 / pos) / (ctp * 1.0 / (ctp + cfp) + ctp * 1.0 / pos + 1e-12)")

LABELLED = """
labelled as (
  select l.doc_id, d.lang || '-' || d.source as "Question", d.text as chunk_text,
    case when toxic = 1 then 'n/a'
      when quality = 1 then case lang when 'en' then ' Yes ' when 'de' then 'TRUE' else '1' end
      else case lang when 'en' then 'No' when 'de' then 'false' else '0' end end as label
  from labels l join documents d on d.doc_id = l.doc_id),
coerced as (
  select *, case when lower(trim(label)) in ('1', 'true', 'yes') then 1
    when lower(trim(label)) in ('0', 'false', 'no') then 0 end as label_num from labelled),
coverage as (
  select "Question", count(*) filter (label_num = 1) as pos_count, count(*) filter (label_num = 0) as neg_count, count(*) as total
  from coerced where label_num is not null group by "Question"),
flags as (select *, pos_count > 0 as has_pos, neg_count > 0 as has_neg, pos_count > 0 and neg_count > 0 as ok_pos_and_neg from coverage)"""

NUMERIC = """
numeric_rows as (
  select l.doc_id, d.lang || '-' || d.source as "Question", d.text as chunk_text,
    case when quality + 2 * toxic = 3 then 'n/a' else (quality + 2 * toxic)::varchar end as label
  from labels l join documents d on d.doc_id = l.doc_id),
usable as (select * from numeric_rows where label <> 'n/a' and "Question" <> '' and chunk_text <> '')"""

FILE_PAIRS = f"""{_chunks(str(fv.STORE_MIN_TOKENS))},
file_pairs as (
  select conv_id, turn, 'doc_' || conv_id as referenced_file, c.text as question, k.pos, k.text as chunk_text,
    sha256(concat(c.text, chr(30), k.text)) as pair_key
  from conversations c join chunks k on k.doc_id = c.conv_id where role = 'user')"""

ANNOTATION_TAIL = _sql_text("\n" + fv.ANNOTATION_PROMPT_TAIL)


def _reply(question: str, chunk: str) -> str:
    """Share of the question's words that occur in the chunk."""
    words = "list_distinct(list_transform(regexp_extract_all({}, '[A-Za-z0-9]+'), lambda w: lower(w)))"
    asked, found = words.format(question), words.format(chunk)
    return f"(100 * len(list_intersect({asked}, {found}))) // len({asked})"


def _annotated(pairs: str, columns: str, with_cache: bool) -> str:
    """CTEs from pairs (with filename and pair_key) to annotated rows."""
    cache = ("cache as (select distinct pair_key from {0} join labels on filename = 'doc_' || doc_id where toxic = 1)"
             if with_cache else "cache as (select pair_key from {0} where false)").format(pairs)
    return f"""
done as (select pair_key from {pairs} join labels on filename = 'doc_' || doc_id where quality = 0),
{cache},
pending as (select * from {pairs} where pair_key not in (select pair_key from done)),
graded as (select *, {_reply('question', 'chunk_text')} as share, pair_key in (select pair_key from cache) as cached from pending)
select {columns}, pair_key,
  case when cached then 'kept thought' else share || ' of 100 words' end as thought,
  case when cached then 'kept reply' else '[ Guess ]: ' || (case when share >= 50 then 'Yes' else 'No' end) || chr(10) || '[ Confidence ]: ' || share end as response,
  'ok' as status
from graded"""


TOPK_PAIRS = f"""{_chunks(str(fv.STORE_MIN_TOKENS))},
store as (select row_number() over (order by doc_id, pos) - 1 as c_ord, file_name, text, {_letters('text')} as v from chunks),
asked as (select item_id as q_ord, text as question, {_letters('text')} as v from benchmark),
placed as (
  select q_ord, c_ord, score, row_number() over (partition by q_ord order by score desc, c_ord) as rank
  from (select q_ord, c_ord, round(list_dot_product(a.v, s.v), 6) + 0.0 as score from asked a cross join store s)),
topk_pairs as (
  select q_ord, file_name as filename, c_ord, rank, score, question, text as chunk_text,
    sha256(concat(question, chr(30), text)) as pair_key
  from placed join asked using (q_ord) join store using (c_ord) where rank <= {fv.RETRIEVAL_DEPTH})"""

INDEX_RUN = f"""{TEXT_PAIRS},
q_vec as (select q_ord, question, {_letters('question')} as v from q_ids),
d_vec as (select d_ord, chunk_text, {_letters('chunk_text')} as v from d_ids),
allow_scores as (
  select q_ord, d_ord, question, q_vec.v as qv, chunk_text, round(list_dot_product(q_vec.v, d_vec.v), 6) + 0.0 as score
  from judged join q_vec using (q_ord) join d_vec using (d_ord))"""


def oracle_sql() -> dict[str, str]:
    o: dict[str, str] = {}

    # Index
    o["ir_index_stats"] = f"""with {TEXT_PAIRS}
select (select count(*) from q_ids) as num_queries, (select count(*) from d_ids) as num_docs,
  count(*) filter (p > 0) as num_with_positives, round(avg(n), 6) as avg_candidates
from (select q_ord, count(*) as n, sum(relevant) as p from judged group by q_ord)"""
    o["ir_index_judged"] = f"""with {TEXT_PAIRS}
select 'Q' || q_ord as qid, 'D' || d_ord as did, relevant, first_label, first_row from judged"""
    o["index_of_two_batches"] = f"""with {TEXT_PAIRS},
arrived as (select clean.*, batch from clean
  join (select row_no, (length("Question") + length(chunk_text)) % 2 as batch from text_pairs) using (row_no)),
q_num as (select question, row_number() over (order by min((batch, row_no))) - 1 as q_no, max(label) as top from arrived group by question),
d_num as (select chunk_text, row_number() over (order by min((batch, row_no))) - 1 as d_no from arrived group by chunk_text)
select 'Q' || q_no as qid, 'D' || d_no as did, max(case when label = 1 then 1 else 0 end) as relevant,
  arg_min(label, (batch, row_no)) as first_label, arg_min(row_no, (batch, row_no)) as first_row
from arrived join q_num using (question) join d_num using (chunk_text) where top = 1 group by q_no, d_no"""
    o["dense_ids"] = """
select row_number() over (order by min(doc_id)) - 1 as d_ord, 'D' || (row_number() over (order by min(doc_id)) - 1) as did,
  min(doc_id) as first_row, md5(text) as text_md5 from documents group by text"""
    o["keep_first"] = """
select doc_id, md5(text) as text, lang, source, n_chars from documents where doc_id in (select min(doc_id) from documents group by text)"""
    o["last_wins"] = o["keep_first"].replace("min(", "max(")
    o["distinct_chunks"] = "select md5(text) as text_md5 from documents group by text"
    o["label_conflicts"] = f"""with {TEXT_PAIRS},
per_pair as (select question, chunk_text, arg_min(label, row_no) as first_label, max(case when label = 1 then 1 else 0 end) as relevant
  from clean group by question, chunk_text)
select sha256(concat(question, chr(30), chunk_text)) as pair_key, first_label, relevant from per_pair where (first_label = 1) <> (relevant = 1)"""

    # Search
    o["topk_search"] = f"""with {VECTORS}
select qid, did, score, rank from (select *, row_number() over (partition by qid order by score desc, did) as rank from all_pairs)
where rank <= {fv.RETRIEVAL_DEPTH}"""
    o["topk_pruned"] = o["topk_search"]
    o["topk_unclean"] = f"""with {VECTORS},
clean as (select vec_id as did from embeddings where not (vec_id % 3 = 0 and label % 5 in (1, 2, 3)))
select qid, did, score, rank from (
  select *, row_number() over (partition by qid order by score desc, did) as rank from all_pairs join clean using (did))
where rank <= {fv.RETRIEVAL_DEPTH}"""
    o["unclean_vectors"] = """select vec_id, 'not finite' as problem from embeddings where embedding[1] < 0 or embedding[2] < 0"""
    o["topk_with_context"] = f"""with
turns as (select row_number() over (order by conv_id, turn, text) - 1 as c_ord, conv_id, turn, {_letters('text')} as v,
    coalesce(lag(text) over w, '') || text || coalesce(lead(text) over w, '') as context
  from conversations window w as (partition by conv_id order by turn)),
asked as (select item_id, {_letters('text')} as v from benchmark)
select item_id, rank, score, conv_id as file_name, md5(context) as context_md5 from (
  select *, row_number() over (partition by item_id order by score desc, c_ord) as rank
  from (select item_id, c_ord, conv_id, context, round(list_dot_product(asked.v, turns.v), 6) + 0.0 as score from asked cross join turns))
where rank <= 5"""
    o["sample_outside_topk"] = f"""with {VECTORS},
numbered as (select did, row_number() over (order by did) - 1 as d_ord from dv),
total as (select count(*) as n from dv),
drawn as (
  select qid, ('0x' || substr(md5('7:' || qid || ':' || step), 1, 15))::bigint % n as d_ord, lpad(min(step)::varchar, 4, '0') as step
  from qv, total, unnest(range(0, 80)) as t(step) where n >= 80 group by all
  union all
  select qid, place as d_ord, md5('7:' || qid || ':' || place) as step from qv, total, unnest(range(0, 80)) as t(place) where n < 80 and place < n),
pairs as (select qid, d_ord, score, row_number() over (partition by qid order by score desc, d_ord) as rank from all_pairs join numbered using (did)),
free as (select qid, d_ord, score, row_number() over (partition by qid order by step) as draw
  from drawn join pairs using (qid, d_ord) where rank > 5)
select qid, d_ord, draw, score from free where draw <= 15"""
    o["full_corpus_scores"] = f"""with {JUDGED_ROWS}, {VECTORS},
first_label as (select qid, did, arg_min(relevance_label, row_no) as lab from judged_rows group by qid, did),
q_attr as (select qid, arg_min("Question_type", row_no) as "Question_type", arg_min(specific_to_paper, row_no) as specific_to_paper from judged_rows group by qid),
d_src as (select did, case when trim(arg_min("IPAC_filename", row_no)) = '' then 'expert' else 'IPAC' end as "Source" from judged_rows group by did)
select qid, did, score as cos_full, row_number() over (partition by qid order by score desc, did) as rank_full, "Source", "Question_type",
  specific_to_paper, coalesce(lab, 0) as relevance_label, s_name as "Question", p_name as chunk_text
from all_pairs left join first_label using (qid, did) left join q_attr using (qid) left join d_src using (did)
  left join supplier on s_suppkey = qid left join part on p_partkey = did"""

    # Metrics
    o["ndcg_map_full"] = f"with {JUDGED_ROWS}, {VECTORS}, {QRELS}, {_metrics('all_pairs', 'qrels')} select {MEANS} from per_query"
    o["ndcg_map_allowlist"] = f"with {JUDGED_ROWS}, {VECTORS}, {QRELS}, {ALLOW}, {_metrics('allow_run', 'qrels')} select {MEANS} from per_query"
    rounded = ", ".join(f'round("{n}", 6) + 0.0 as "{n}"' for n in NAMES)
    o["ndcg_map_per_query"] = (
        f"with {JUDGED_ROWS}, {VECTORS}, {QRELS}, {ALLOW}, {_metrics('allow_run', 'qrels', divisor='least(num_relevant, {k})')} "
        f"select qid, num_relevant, {rounded} from per_query")
    long_rows = " union all ".join(
        f"""select '{n.split("@")[0]}' as metric, {n.split("@")[1]} as k, round(avg("{n}"), 6) + 0.0 as value from per_query""" for n in NAMES)
    o["ndcg_map_long"] = f"with {JUDGED_ROWS}, {VECTORS}, {QRELS}, {_metrics('all_pairs', 'qrels')} {long_rows}"
    o["facet_type_allow"] = _facet(FACET_TYPE, '"Question_type"', full=False)
    o["facet_flag_allow"] = _facet(FACET_FLAG, "specific_to_paper", full=False)
    o["facet_type_full"] = _facet(FACET_TYPE, '"Question_type"', full=True)
    o["facet_flag_full"] = _facet(FACET_FLAG, "specific_to_paper", full=True)
    facets = f"facets as (select distinct qid, {FACET_FLAG} as specific_to_paper from judged_rows)"
    o["facet_flag_topk"] = (
        f"with {JUDGED_ROWS}, {VECTORS}, {QRELS}, {facets}, {_metrics('all_pairs', 'qrels')} "
        f"select specific_to_paper, {MEANS} from per_query join facets using (qid) group by specific_to_paper")
    o["evaluation_report"] = f"""with {INDEX_RUN},
both_runs as (
  select 'allowlist' as task, q_ord as qid, d_ord as did, score from allow_scores
  union all
  select 'full corpus', q_ord, d_ord, round(list_dot_product(q_vec.v, d_vec.v), 6) + 0.0 from q_vec cross join d_vec),
both_qrels as (select task, q_ord as qid, d_ord as did from judged, (values ('allowlist'), ('full corpus')) t(task) where relevant = 1),
{_metrics('both_runs', 'both_qrels', 'task')}
select 'letters' as model, task, {MEANS} from per_query group by task"""
    prompt_length = f"length({_sql_text(f'<Instruct>: {fv.RERANK_INSTRUCTION}' + chr(10) + '<Query>: ')} || a.question || {_sql_text(chr(10) + '<Document>: ')} || a.chunk_text)"
    two = f"""with {INDEX_RUN},
f_vec as (select d_ord, chunk_text, {_letters('chunk_text', folded=True)} as v from d_ids),
two_pairs as (select q_ord, d_ord, chunk_text, round(list_dot_product(q_vec.v, f_vec.v), 6) + 0.0 as score from q_vec cross join f_vec)"""
    o["model_reports"] = f"""{two},
all_runs as (
  select 'two encoders' as model, 'allowlist' as task, q_ord as qid, d_ord as did, score from two_pairs join judged using (q_ord, d_ord)
  union all
  select 'two encoders', 'full corpus', q_ord, d_ord, score from two_pairs
  union all
  select 'lengths', 'allowlist (reranker)', q_ord, d_ord, 1 / (1 + exp(-{prompt_length.replace("a.", "")} / 1000.0::double)) from allow_scores),
all_qrels as (select concat_ws('/', model, task) as run, q_ord as qid, d_ord as did from judged, (select distinct model, task from all_runs) where relevant = 1),
keyed_runs as (select concat_ws('/', model, task) as run, qid, did, score from all_runs),
{_metrics('keyed_runs', 'all_qrels', 'run')}
select split_part(run, '/', 1) as model, split_part(run, '/', 2) as task, {MEANS} from per_query group by run"""
    o["model_score_files"] = f"""{two}
select 'two encoders' as model, q_ord, d_ord, score as cos_full, row_number() over (partition by q_ord order by score desc, d_ord) as rank_full,
  coalesce(first_label, 0) as relevance_label, 'expert' as "Source", md5(chunk_text) as chunk_md5
from two_pairs left join judged using (q_ord, d_ord)"""
    o["run_quality"] = """
select qid, sum(copies)::bigint as num_scores, count(*) as num_docs, count(*) filter (copies > 1) as repeated_docs, 0::bigint as bad_scores
from (select l_suppkey as qid, l_partkey, count(*) as copies from lineitem group by 1, 2) group by qid"""
    o["vector_dims"] = "select len(embedding)::int as dim, count(*) as num_vectors from embeddings group by 1"

    # Score tables
    stripped = "t.chunk_text, ' ' || chr(10) || chr(9) || chr(13)"
    attach = f"""from text_pairs t left join allow_scores a
  on a.question = trim(t."Question", ' ' || chr(10) || chr(9) || chr(13)) and a.chunk_text = trim({stripped})"""
    o["attach_pair_scores"] = f"with {INDEX_RUN} select t.row_no, a.score as cos {attach}"
    o["attach_rerank_scores"] = f"with {INDEX_RUN} select t.row_no, round(1 / (1 + exp(-{prompt_length} / 1000.0::double)), 6) as rerank_score {attach}"
    o["pair_scores_rowwise"] = f"""with {JUDGED_ROWS}, {VECTORS}
select row_no, qid, did, score as cos_score from judged_rows join all_pairs using (qid, did)"""
    o["pair_scores_full"] = f"""with {JUDGED_ROWS}, {VECTORS},
last_label as (select qid, did, arg_max(relevance_label, row_no) as lab from judged_rows group by qid, did)
select qid, did, coalesce(lab, 0) as "Label", score, s_name as "Question", p_name as chunk_text
from all_pairs left join last_label using (qid, did) left join supplier on s_suppkey = qid left join part on p_partkey = did"""

    o["score_blocks"] = f"""with {JUDGED_ROWS}, {VECTORS},
last_label as (select qid, did, arg_max(relevance_label, row_no) as lab from judged_rows group by qid, did),
size as (select (((select count(*) from qv) * n // 4 + 1) // n)::bigint as queries from (select count(*) as n from dv))
select qid // queries as block, qid, did, coalesce(lab, 0) as "Label", score
from all_pairs left join last_label using (qid, did), size"""

    # Curves
    o["pr_curve"] = f"""with {_curve()}
select model, score as threshold, round(ctp * 1.0 / (ctp + cfp), 6) as precision, round(ctp * 1.0 / pos, 6) as recall from curve
union all select distinct model, null, 1.0, 0.0 from curve"""
    o["average_precision"] = f"with {_curve()} select model, round({AP}, 6) as average_precision from curve group by model"
    o["prevalence"] = f"with {SCORED} select model, round(avg(label), 6) as prevalence from scored group by model"
    roc = """select model, score as threshold, round(cfp * 1.0 / neg, 6) as fpr, round(ctp * 1.0 / pos, 6) as tpr from curve {0}
union all select distinct model, null, 0.0, 0.0 from curve"""
    o["roc_curve"] = f"with {_curve()} {roc.format('')}"
    o["roc_curve_corners"] = f"with {_curve()} {roc.format('where next_tp is null or next_tp <> tp or next_fp <> fp')}"
    o["roc_auc"] = f"with {_curve()} select model, round(sum(fp * (ctp - tp / 2.0)) / (max(pos) * max(neg)), 6) as roc_auc from curve group by model"
    o["f1_by_threshold"] = f"with {_curve()} select model, score as threshold, round({F1}, 6) as f1 from curve"
    o["pr_curve_batches"], o["roc_auc_batches"] = o["pr_curve"], o["roc_auc"]
    o["best_f1"] = f"""with {_curve()}, scored_f1 as (select model, score, round({F1}, 12) as f1 from curve)
select model, round(f1, 6) as best_f1, score as threshold from (
  select *, row_number() over (partition by model order by f1 desc, score) as place from scored_f1) where place = 1"""
    o["model_delta"] = f"""with {_curve()}, ap as (select model, {AP} as v from curve group by model),
wanted as (select * from (values ('base', 'tuned'), ('other base', 'other tuned')) t(base, tuned))
select base, tuned, round(b.v, 6) as base_average_precision, round(t.v, 6) as tuned_average_precision,
  round(coalesce(t.v, 0) - coalesce(b.v, 0), 6) + 0.0 as delta
from wanted left join ap b on b.model = base left join ap t on t.model = tuned"""
    lines = "scored as (select 'price' as model, l_extendedprice as score, case when l_returnflag = 'R' then 1 else 0 end as label from lineitem)"
    o["order_line_average_precision"] = f"with {_curve(lines)} select model, round({AP}, 6) as average_precision from curve group by model"
    o["similarity_label_corr"] = f"""with {JUDGED_ROWS}, {VECTORS},
scored as (select score, relevance_label as label from judged_rows join all_pairs using (qid, did)),
ranks as (select score, label, rank() over (order by score) + (count(*) over (partition by score) - 1) / 2.0 as rs,
  rank() over (order by label) + (count(*) over (partition by label) - 1) / 2.0 as rl from scored)
select 'base' as model, round(corr(score, label), 6) as pearson, round(corr(rs, rl), 6) as spearman from ranks"""

    # Vectors and texts
    o["softmax_yes"] = """
select vec_id, round(exp(embedding[2]::double) / (exp(embedding[1]::double) + exp(embedding[2]::double)), 6) as p_yes from embeddings"""
    o["logsumexp_yes"] = """
select vec_id, round(ln(list_sum(list_transform(embedding, lambda x: exp(x::double)))), 6) as log_sum_exp from embeddings"""
    o["normalize_vectors"] = """
select vec_id, list_transform(s, lambda x: round((x / (case when vec_id = 0 then 1 else sqrt(list_dot_product(s, s)) end))::float::double, 5) + 0.0) as unit
from (select vec_id, list_transform(embedding, lambda x: x::double * vec_id) as s from embeddings)"""
    o["encode_texts"] = f"select doc_id, list_transform({_letters('text')}, lambda x: round(x, 5)) as embedding from documents"
    blank = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    o["text_cleanup"] = f"""
select page_id, md5(trim(html, {blank})) as stripped_md5,
  len(list_filter(regexp_split_to_array(html, '\\s+'), lambda w: w <> ''))::int as num_tokens,
  coalesce(try_cast(trunc(try_cast(regexp_extract(url, '([0-9.]+)', 1) as double)) as int), 0) as number,
  array_to_string(list_transform(regexp_extract_all(url, '([A-Za-z]+|[^A-Za-z]+)'), lambda w: upper(w[1]) || lower(w[2:])), '') as title
from pages"""
    o["pair_keys"] = f"with recursive {FILE_PAIRS} select conv_id, turn, pos, pair_key from file_pairs"
    o["prompt_render"] = f"""with recursive {FILE_PAIRS}
select conv_id, turn, pos,
  md5('Question: ' || question || chr(10) || 'Paragraph: ' || chunk_text || {ANNOTATION_TAIL}) as annotation_md5,
  md5({_sql_text(f'<Instruct>: {fv.RERANK_INSTRUCTION}' + chr(10) + '<Query>: ')} || question || {_sql_text(chr(10) + '<Document>: ')} || chunk_text) as rerank_md5,
  md5('{fv.BGE_QUERY_PROMPT}' || question) as prompted_md5
from file_pairs"""

    # Chunks
    o["chunk_paragraphs"] = f"""with recursive {_chunks(str(fv.CHUNK_MIN_TOKENS))}
select file_name, pos, md5(text) as text_md5, num_tokens from chunks"""
    o["chunk_size_sweep"] = f"""with recursive {_chunks(', '.join(map(str, fv.CHUNK_SIZE_CANDIDATES)))}
select min_tokens, round(avg(num_tokens), 6) as avg_tokens, count(*) as num_chunks from chunks group by min_tokens"""
    o["chunks_per_file"] = f"""with recursive {_chunks(str(fv.CHUNK_MIN_TOKENS))}
select file_name, count(*) as num_chunks from chunks group by file_name"""
    o["call_batch_plan"] = f"""with recursive {_chunks('20')},
per_file as (select file_name, count(*) as num_chunks from chunks group by file_name),
sized as (select *, case when num_chunks <= 10 then num_chunks else ceil(num_chunks / 10.0)::bigint end as batch_size from per_file)
select *, ceil(num_chunks * 1.0 / batch_size)::bigint as num_calls from sized"""
    o["ingest_resume"] = f"""with recursive todo as (select * from documents where doc_id not in (select doc_id from labels)),
{_chunks(str(fv.STORE_MIN_TOKENS), docs='todo')}
select file_name, pos, md5(text) as text_md5, round(list_max({_letters('text')}), 5) as largest from chunks"""
    o["file_reference_pairs"] = f"""with recursive {FILE_PAIRS}
select conv_id, turn, referenced_file, pos, md5(chunk_text) as chunk_md5 from file_pairs"""
    o["questions_without_chunks"] = """
select conv_id, turn, 'doc_' || conv_id as referenced_file from conversations
where role = 'user' and text <> '' and conv_id not in (select doc_id from labels join documents using (doc_id) where trim(text) <> '')"""

    # Annotation
    o["annotate_topk"] = f"with recursive {TOPK_PAIRS}, {_annotated('topk_pairs', 'q_ord, filename, c_ord, rank, score', True)}"
    by_file = f"{FILE_PAIRS}, by_file as (select *, referenced_file as filename from file_pairs)"
    o["annotate_by_file"] = f"with recursive {by_file}, {_annotated('by_file', 'conv_id, turn, filename, pos', False)}"
    o["pair_counts"] = f"""with recursive {by_file},
done as (select pair_key from by_file join labels on filename = 'doc_' || doc_id where quality = 0),
cache as (select pair_key from by_file join labels on filename = 'doc_' || doc_id where toxic = 1),
pending as (select * from by_file where pair_key not in (select pair_key from done))
select count(*) as to_process, count(distinct pair_key) filter (pair_key not in (select pair_key from cache)) as calls from pending"""

    # Labels and training
    o["label_coerce"] = f"with {LABELLED} select doc_id, label, label_num, coalesce(try_cast(label as int), 0) as as_int from coerced"
    o["label_distribution"] = f"with {LABELLED} select label_num, count(*) as num_rows from coerced where label_num is not null group by 1"
    o["label_summary"] = f"""with {LABELLED}
select count(*) filter (label_num = 1) as positives, count(*) filter (label_num = 0) as negatives,
  count(*) filter (label_num in (0, 1)) as total, count(*) filter (label_num is null) as dropped from coerced"""
    o["question_coverage"] = f"with {LABELLED} select * from flags"
    o["bad_questions"] = f"with {LABELLED} select * from flags where not ok_pos_and_neg"
    o["coverage_summary"] = f"""with {LABELLED}
select count(*) as num_questions, count(*) filter (ok_pos_and_neg) as num_ok, count(*) filter (not ok_pos_and_neg) as num_missing from flags"""
    o["positives_histogram"] = f"with {LABELLED} select pos_count as num_positives, count(*) as num_questions from flags group by 1"
    o["negatives_histogram"] = f"with {LABELLED} select neg_count as num_negatives, count(*) as num_questions from flags group by 1"
    o["pos_neg_crosstab"] = f"with {LABELLED} select pos_count, neg_count, count(*) as num_questions from flags group by 1, 2"
    pair = "md5({0}\"Question\") as sentence1, md5(chunk_text) as sentence2"
    o["training_pairs"] = f"""with {NUMERIC} select {pair.format(f"'{fv.BGE_QUERY_PROMPT}' || ")}, label::double as label from usable"""
    o["positives_only"] = f"with {NUMERIC} select {pair.format('')}, label::double as label from usable where label::double > 0"
    template = _sql_text(f"<Instruct>: {fv.DEFAULT_QUERY_INSTRUCTION}\n<Query>: ")
    o["instruct_pairs"] = f"with {NUMERIC} select {pair.format(template + ' || ')}, least(label::int, 1)::double as label from usable"
    o["unreadable_labels"] = f"with {NUMERIC} select label, count(*) as num_rows from numeric_rows where label = 'n/a' group by label"
    o["class_weights"] = f"""with {NUMERIC}
select (label::double > 0)::int as class, count(*) as num_rows, round(0.5 / count(*), 9) as weight from usable group by 1"""
    o["train_eval_split"] = f"""with {NUMERIC},
placed as (select doc_id, label, row_number() over (order by md5('7:' || doc_id), doc_id) - 1 as p, count(*) over () as n from numeric_rows)
select doc_id, label, case when p < ceil(0.1 * least(n, 300)) then 'eval' else 'train' end as split from placed where p < 300"""
    o["train_eval_split_all"] = f"""with {NUMERIC},
placed as (select doc_id, label, row_number() over (order by md5('7:' || doc_id), doc_id) - 1 as p, count(*) over () as n from numeric_rows)
select doc_id, label, case when p < ceil(0.1 * n) then 'eval' else 'train' end as split from placed"""
    o["sample_rows"] = """
select event_id, event_type from (select *, row_number() over (order by md5('7:' || event_id), event_id) as p from events) where p <= 1000"""

    # Files and guards
    o["csv_round_trip"] = o["csv_gz_round_trip"] = """
select doc_id, md5(coalesce(text, '')) as text_md5, coalesce(lang, '') as lang, coalesce(source, '') as source from documents"""
    o["csv_split_round_trip"] = """
select doc_id, md5(regexp_replace(coalesce(text, ''), '[^\\x{00}-\\x{FF}]', '?', 'g')) as text_md5, coalesce(lang, '') as lang,
  coalesce(source, '') as source from documents"""
    o["json_corpus_round_trip"] = o["json_array_round_trip"] = "select 'doc_' || doc_id as file_name, md5(text) as text_md5 from documents"
    o["json_reply_cache_import"] = """
select sha256(concat(text, chr(30), 'chunk ' || item_id)) as pair_key, 'thought' as thought, 'reply ' || item_id as response,
  (select count(*) from benchmark) as entries from benchmark"""
    o["model_set_round_trip"] = """
select source, model, (event_type = 'error')::int as label, count(*) as num_rows
from events, (values ('files'), ('folders')) s(source), (values ('base'), ('tuned')) m(model) group by all"""
    o["store_resume_round_trip"] = f"""with recursive {_chunks(str(fv.STORE_MIN_TOKENS))}
select case when doc_id in (select doc_id from labels) then 'first' else 'second' end as batch_id, count(distinct doc_id) as files,
  count(*) as chunks, (select count(*) from documents) as done from chunks group by 1"""
    o["annotation_job_twice"] = """with pairs as (
  select conv_id, turn, c.text, d.text as chunk, length(c.text) % 2 = 1 as odd
  from conversations c join documents d on d.doc_id = c.conv_id where role = 'user' and c.text <> '')
select conv_id, turn, case when odd then 'error' else 'ok' end as status, count(*) as num_rows,
  case when odd then 1 else 0 end as attempts, (select count(distinct (text, chunk)) from pairs where not odd) as cached
from pairs group by conv_id, turn, odd"""
    o["other_keys_resume"] = """with pairs as (
  select conv_id, turn, c.text as question, d.text as chunk
  from conversations c join documents d on d.doc_id = c.conv_id where role = 'user' and c.text <> '')
select conv_id, turn, sha256(question || chr(30) || chunk) as pair_key from pairs
where question is not null and chunk is not null
  and (question, chunk) not in (select (question, chunk) from pairs where conv_id % 2 = 0 and chunk is not null)"""
    o["failing_calls"] = """
select item_id, '' as thought, case when length(text) % 2 = 1 then 'ERROR: busy' else left(text, 5) end as response,
  case when length(text) % 2 = 1 then 'error' else 'ok' end as status, case when length(text) % 2 = 1 then 3 else 1 end as attempts
from benchmark"""
    o["annotation_messages"] = f"""
select item_id, md5({_sql_text(fv.ANNOTATION_SYSTEM_TEXT)}) as thought,
  md5('Question: ' || text || chr(10) || 'Paragraph: c' || {ANNOTATION_TAIL}) as response from benchmark"""
    o["report_files"] = f"""with {LABELLED}
select 'per_question_coverage' as report, count(*) as num_rows from flags
union all select 'questions_missing_pos_or_neg', count(*) from flags where not ok_pos_and_neg having count(*) > 0
union all select 'positives_per_question_histogram', count(distinct pos_count) from flags
union all select 'negatives_per_question_histogram', count(distinct neg_count) from flags
union all select 'joint_pos_neg_table', count(distinct pos_count) from flags"""
    def cells(name: str, key: str, columns: str, rows: str) -> str:
        return " union all ".join(f"""select '{name}' as report, {key}::varchar as "of", '{c}' as "column", {c}::varchar as value from {rows}"""
                                  for c in columns.split())

    flag_columns = "pos_count neg_count total has_pos has_neg ok_pos_and_neg"
    o["report_rows"] = f"""with {LABELLED},
joint as (select a.pos_count, b.neg_count, (select count(*) from flags c where c.pos_count = a.pos_count and c.neg_count = b.neg_count) as n
  from (select distinct pos_count from flags) a, (select distinct neg_count from flags) b)
{cells('per_question_coverage', '"Question"', flag_columns, 'flags')}
union all {cells('questions_missing_pos_or_neg', '"Question"', flag_columns, '(select * from flags where not ok_pos_and_neg)')}
union all {cells('positives_per_question_histogram', 'num_positives', 'num_questions', '(select pos_count as num_positives, count(*) as num_questions from flags group by 1)')}
union all {cells('negatives_per_question_histogram', 'num_negatives', 'num_questions', '(select neg_count as num_negatives, count(*) as num_questions from flags group by 1)')}
union all select 'joint_pos_neg_table', pos_count::varchar, neg_count::varchar, n::varchar from joint"""
    o["round_report"] = """
select l_returnflag, l_linestatus, round(avg(l_extendedprice::double), 4) as price, round(avg(l_quantity::double), 4) as quantity
from lineitem group by all"""
    o["guard_messages"] = """
select model, num_rows, guard, message
from (values ('base'), ('tuned')) m(model), (select count(*) as num_rows from events),
  (values ('columns', 'missing required columns: [''Question'', ''cos'']'),
          ('labels', 'need both labels 0 and 1 and no others: tuned'), ('mixed', 'fine')) g(guard, message)"""
    return o
