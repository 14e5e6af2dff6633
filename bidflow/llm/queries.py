"""Registered queries of the corpus operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from importlib import import_module

_QUERIES = {
    "op1_arc_to_warc": "warc_arc",
    "op2_substring_dedup": "substring_dedup",
    "op3_secret_scan": "secret_scan",
    "op4_bottomk_near_dup": "minhash",
    "op5_template_decontamination": "decontam",
    "op6_license_scan": "license_scan",
    "op7_pattern_packing": "packing",
    "op8_template_line_dedup": "line_dedup",
    "op9_projection_near_dup": "embed_dedup",
    "op10_knn_toxicity": "toxicity",
    "op11_fp_search": "fp_search",
    "op12_exact_topk": "exact_topk",
    "op13_filter_audit": "filter_audit",
}


def queries() -> dict:
    return {name: getattr(import_module(f"bidflow.llm.{module}"), name) for name, module in _QUERIES.items()}


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "regexp_extract_all({c}, '[^\\x20\\x09-\\x0D]+')"
#: Components of links (a, b) over nodes (id), by a recursive walk: for the small tables that SQL is run on.
_REACH = """ends as (select a, b from links union select b, a from links),
reach(id, node) as (select id, id from nodes union select r.id, e.b from reach r join ends e on r.node = e.a),
part as (select id, min(node) as component_id from reach group by 1)"""
_BASE32 = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((cast('0x' || substr(h, {5 * g + 1}, 5) as int) >> {shift}) & 31), 1)" for g in range(8) for shift in (15, 10, 5, 0))

_SQL = {
    "op1_arc_to_warc": f"""with p as (select page_id, coalesce(html, '') as html, sha1(coalesce(html, '')) as h from pages),
 d as (select *, min(page_id) over (partition by h, html) as first_id from p)
 select page_id, cast(strlen(html) as bigint) as payload_bytes, {_BASE32} as payload_digest, case when page_id = first_id then 'response' else 'revisit' end as record_type, case when page_id <> first_id then first_id end as refers_to from d""",
    "op2_substring_dedup": f"""with d as (select doc_id, {_WORDS.format(c="coalesce(text, '')")} as words from documents),
 w as (select doc_id, unnest(words) as word, generate_subscripts(words, 1) as pos, len(words) as n from d),
 k as (select doc_id, unnest(range(1, len(words) - 33)) as pos, words from d where len(words) >= 35),
 g as (select doc_id, pos, hash(list_slice(words, pos, pos + 34)) as h from k),
 r as (select doc_id, pos, 1 as again from (select *, count(*) over (partition by h) as c from g) where c > 1),
 m as (select w.*, coalesce(sum(again) over (partition by w.doc_id order by w.pos rows between 34 preceding and current row), 0) > 0 as gone from w left join r using (doc_id, pos)),
 f as (select doc_id, count(*) filter (gone) as n_removed, coalesce(string_agg(word, ' ' order by pos) filter (not gone), '') as kept from m group by 1)
 select d.doc_id, cast(len(words) as bigint) as n_words, coalesce(n_removed, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from d left join f using (doc_id)""",
    "op4_bottomk_near_dup": f"""with recursive d as (select doc_id as id, {_WORDS.format(c=_LOWER)} as words from documents),
 s as (select id, case when len(words) = 0 then [] when len(words) < 5 then [array_to_string(words, ' ')] else list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(list_slice(words, i, i + 4), ' '))) end as shingles from d),
 sizes as (select id, cast(len(shingles) as bigint) as n from s),
 e as (select id, unnest(shingles) as shingle from s),
 both_ as (select x.id as a, y.id as b, count(*) as c from e x join e y on x.shingle = y.shingle and x.id < y.id group by 1, 2),
 links as (select a, b from both_ join sizes p on p.id = a join sizes q on q.id = b where 100 * c >= 75 * (p.n + q.n - c)),
 nodes as (select id from d), {_REACH}
 select id as doc_id, n as n_shingles, component_id, id = component_id as kept from sizes join part using (id)""",
    "op9_projection_near_dup": f"""with recursive v as (select vec_id as id, cast(embedding as double[]) as x from embeddings),
 links as (select p.id as a, q.id as b from v p join v q on p.id < q.id where list_cosine_similarity(p.x, q.x) >= 0.95),
 nodes as (select id from v), {_REACH}, n as (select a, count(*) as n from ends group by 1)
 select id as vec_id, coalesce(n, 0) as n_links, component_id, id = component_id as kept from part left join n on n.a = id""",
    "op12_exact_topk": """with v as (select vec_id, list_transform(embedding, lambda x: floor(256 * cast(x as double))) as x from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
 s as (select q.vec_id as query_id, c.vec_id, cast(list_dot_product(q.x, c.x) as bigint) as score from v q join v c on q.vec_id % 50 = 0 and q.vec_id <> c.vec_id and len(q.x) = len(c.x)),
 r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
 select query_id, cast(rank as int) as rank, vec_id, score from r where rank <= 5""",
    "op11_fp_search": """with d as (select row_number() over () as row, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') as terms from documents where text is not null),
 s as (select count(*) as big_n, sum(len(terms)) as big_l from d where len(terms) > 0),
 i as (select row_number() over () as item, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) as term from (select distinct item_id, text from benchmark where item_id is not null)),
 q as (select item, item_id, term, count(*) as c from i group by all),
 t as (select row, doc_id, term, n, count(*) as tf from (select row, doc_id, len(terms) as n, unnest(terms) as term from d) where term in (select term from q) group by all),
 w as (select term, cast(floor(1000 * ln((2 * big_n + 2) / cast(2 * count(*) + 1 as double))) as bigint) as w from t, s group by term, big_n),
 x as (select item, item_id, row, doc_id, cast(sum(c * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + cast((25 * n * big_n) // big_l as bigint))))) as bigint) as score from q join w using (term) join t using (term), s group by all),
 r as (select *, row_number() over (partition by item order by score desc, doc_id nulls last) as rank from x where score > 0)
 select item_id, cast(rank as int) as rank, doc_id, score from r where rank <= 20""",
    "op13_filter_audit": """with recursive p as (select '' as o, 'ABCDE' as rest union all select o || substr(rest, i, 1), substr(rest, 1, i - 1) || substr(rest, i + 1) from p, (select unnest(range(1, 6)) as i) where i <= length(rest)),
 steps as (select o as filter_order, cast(step as int) as step, substr(o, cast(step as int), 1) as letter, substr(o, 1, cast(step as int) - 1) as before from (select o from p where length(o) = 5), (select unnest(range(1, 6)) as step)),
 t as (select doc_id, coalesce(source, '') as part, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as words from documents),
 f as (select doc_id, part, len(words) < 200 as a, 100 * len(list_distinct(words)) < 50 * len(words) as b, 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text) as c,
  regexp_matches(text, '[#$%&*|]') as d, coalesce(doc_id > min(doc_id) over (partition by text), false) as e from t),
 l as (select doc_id, max(case when quality = 1 then 1 else 0 end) as good, max(case when toxic = 1 then 1 else 0 end) as toxic from labels group by 1),
 m as (select part, case when a then 'A' else '' end || case when b then 'B' else '' end || case when c then 'C' else '' end || case when d then 'D' else '' end || case when e then 'E' else '' end as fails, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic from f left join l using (doc_id)),
 n as (select part, fails, good, toxic, count(*) as n from m group by all),
 x as (select part, filter_order, step, letter, n, good, toxic, contains(fails, letter) as here, fails = letter as alone, before <> '' and regexp_matches(fails, '[' || before || 'x]') as gone from n, steps),
 y as (select part, filter_order, step, letter, sum(n) filter (not here and not gone) as kept, sum(n) filter (here and not gone) as removed, sum(n) filter (here and gone) as redundant, sum(n) filter (alone) as unique_fails, sum(n * good) filter (here and not gone) as good_lost, sum(n * toxic) filter (here and not gone) as toxic_lost from x group by all)
 select part, filter_order, step, cast(coalesce(kept, 0) as bigint) as kept, cast(coalesce(removed, 0) as bigint) as removed, cast(coalesce(redundant, 0) as bigint) as redundant, cast(coalesce(unique_fails, 0) as bigint) as unique_fails,
  cast(coalesce(good_lost, 0) as bigint) as good_lost, cast(coalesce(toxic_lost, 0) as bigint) as toxic_lost, cast(coalesce(sum(removed) over (partition by part, letter), 0) as bigint) as shapley from y""",
}


def oracle_sql() -> dict[str, str]:
    """Of the operators that SQL can express on whole tables; tests hold the others against brute force."""
    return dict(_SQL)
