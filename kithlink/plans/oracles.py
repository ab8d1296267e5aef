"""SQL twins of the queries, for DuckDB over the same tables. Each is a chain of common table expressions."""

from __future__ import annotations

from kithlink.config import FEATURE_COLS
from kithlink.config import FIXTURE as C
from kithlink.functions.lookups import ADDRESS_ABBREVIATIONS, COUNTRY_ALIASES, LEGAL_SUFFIXES
from kithlink.sources.adapter import ENTITY_SQL


def _case(x: str, table: dict[str, str], other: str) -> str:
    return f"case {x} " + " ".join(f"when '{k}' then '{v}'" for k, v in table.items()) + f" else {other} end"


def _tokens(c: str) -> str:
    return rf"list_filter(string_split_regex(trim(regexp_replace(replace(lower({c}), '&', ' and '), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g')), '\s+'), lambda t: t <> '')"


_SUFFIX = "t in (" + ", ".join(f"'{s}'" for s in LEGAL_SUFFIXES) + ")"
_PLAIN = r"trim(regexp_replace(lower(trim(country)), '[^\p{L}\p{N}_\s]', '', 'g'))"

NORM = f"""
ent as ({ENTITY_SQL}),
tok as (select *, {_tokens("business_name")} as nt, list_transform({_tokens("business_address")}, lambda t: {_case("t", ADDRESS_ABBREVIATIONS, "t")}) as adt from ent),
core as (select *, list_filter(nt, lambda t: not ({_SUFFIX})) as name_tokens, list_filter(nt, lambda t: {_SUFFIX}) as sf, array_to_string(adt, ' ') as addr_norm from tok),
norm as (
  select k, src, entity_id, h, country, name_tokens, addr_norm, array_to_string(name_tokens, ' ') as name_norm, array_to_string(nt, ' ') as name_full_norm,
         case when len(sf) > 0 then {_case("sf[len(sf)]", LEGAL_SUFFIXES, "''")} else '' end as name_suffix,
         coalesce(name_tokens[1], '') as name_first_token,
         case when len(name_tokens) between 2 and 6 then array_to_string(list_transform(name_tokens, lambda w: substr(w, 1, 1)), '') else '' end as name_acronym,
         cast(len(name_tokens) as bigint) as name_token_count, cast(len(adt) as bigint) as addr_token_count,
         regexp_extract(business_address, '\\b(\\d{{5,6}})\\b', 1) as addr_pin, regexp_extract(addr_norm, '^(\\d+[a-z]?)\\b', 1) as addr_street_num,
         regexp_extract(addr_norm, 'near\\s+(.+)$', 1) as addr_landmark, {_case(_PLAIN, COUNTRY_ALIASES, _PLAIN)} as country_norm
  from core)"""

BLOCKS = f"""{NORM},
q as (select *, case when country_norm = '' then '*' else country_norm end as bk from norm where src = 1),
c as (select *, country_norm as bk from norm where src <> 1 and country_norm <> '' union all
      select *, '*' as bk from norm where src <> 1 and exists (select 1 from norm where src = 1 and country_norm = '')),
b as (select 'q' as side, * from q union all select 'c' as side, * from c where bk in (select bk from q)),
sz as (select bk, count(*) as n from b group by bk)"""

ANCHOR = "anc as (select q.entity_id as s, c.entity_id as d from b q join b c on q.side = 'q' and c.side = 'c' and q.bk = c.bk and q.addr_pin = c.addr_pin and q.addr_street_num = c.addr_street_num and q.addr_pin <> '' and q.addr_street_num <> '')"

TOKEN = f"""tkn as (select distinct bk, side, entity_id, t from (select bk, side, entity_id, unnest(name_tokens) as t from b) where length(t) >= {C.token_min_len}),
tkd as (select bk, t from tkn group by bk, t having count(*) between {C.token_min_df} and {C.token_max_df}),
tkk as (select tkn.*, count(*) over (partition by bk, side, entity_id) as n from tkn join tkd using (bk, t)),
tks as (select q.entity_id as s, c.entity_id as d, count(*) as shared, any_value(q.n) as n1, any_value(c.n) as n2
        from tkk q join tkk c on q.side = 'q' and c.side = 'c' and q.bk = c.bk and q.t = c.t group by q.bk, s, d),
tok2 as (select s, d, shared, shared / (n1 + n2 - shared) as j from (select *, row_number() over (partition by s order by shared desc, d) as rn from tks where shared >= {C.token_min_shared}) where rn <= {C.top_k})"""


def _grams(col: str, lo: int, hi: int, table: str = "b") -> str:
    """Terms of a column of a table, one row for each occurrence."""
    return f"""(select bk, side, entity_id, unnest(case when length(p) < {lo} then [p] else flatten(list_transform(range({lo}, least({hi}, length(p)) + 1),
       lambda n: list_transform(range(1, length(p) - n + 2), lambda i: substr(p, i, n)))) end) as t
     from (select bk, side, entity_id, ' ' || unnest(list_filter(string_split_regex(trim({col}), '\\s+'), lambda w: w <> '')) || ' ' as p from {table}))"""


def _tfidf(name: str, col: str, floor: float, top: int) -> str:
    return f"""{name}f as (select bk, side, entity_id, t, count(*) as tf from {_grams(col, *C.ngrams)} group by all),
{name}d as (select bk, t, count(*) as df, sum(tf) as total from {name}f group by bk, t),
{name}v as (select * from (select bk, t, df, n, row_number() over (partition by bk order by total desc, t) as rn from {name}d join sz using (bk)
            where df >= {C.min_df} and df <= {C.max_df} * n) where rn <= {C.max_features}),
{name}r as (select bk, side, entity_id, t, (1 + ln(tf)) * (ln((1 + n) / (1 + df)) + 1) as w from {name}f join {name}v using (bk, t)),
{name}w as (select bk, side, entity_id, t, w / sqrt(sum(w * w) over (partition by bk, side, entity_id)) as w from {name}r),
{name}s as (select q.entity_id as s, c.entity_id as d, round(sum(q.w * c.w), 6) as sim from {name}w q join {name}w c on q.side = 'q' and c.side = 'c' and q.bk = c.bk and q.t = c.t group by q.bk, s, d),
{name} as (select s, d, sim from (select *, row_number() over (partition by s order by sim desc, d) as rn from {name}s where sim >= {floor}) where rn <= {top})"""


PRUNE = f"""un as (select s, d, max(name_sim) as name_sim, 0.0::double as addr_sim, max(j) as token_jaccard, max(anchor) as addr_anchor from (
  select s, d, sim as name_sim, 0.0::double as j, 0.0::double as anchor from nm union all select s, d, 0, j, 0 from tok2 union all select s, d, 0, 0, 1 from anc) group by s, d),
bl as (select *, greatest(name_sim, addr_sim, token_jaccard, addr_anchor) as blend from un),
rk as (select *, row_number() over (partition by s order by blend desc, d) as rn from bl),
cand as (select s, d, name_sim, addr_sim, token_jaccard, addr_anchor, blend, cast(rank() over (partition by s order by name_sim desc) as double) as name_rank,
         cast(rank() over (partition by s order by addr_sim desc) as double) as addr_rank, count(*) over (partition by s) as cc
         from rk where rn <= {C.prune_hard_cap} and (rn <= {C.prune_top_k} or blend > {C.prune_min_score}))"""

CAND = ", ".join([BLOCKS, ANCHOR, TOKEN, _tfidf("nm", "name_norm", C.sim_floor, C.top_k), PRUNE])
TRUTH = "tr as (select distinct q.entity_id as s, c.entity_id as d from ent q join ent c on q.src = 1 and c.src <> 1 and q.h = c.h)"
PRED = "pr as (select s, d from cand where blend >= 0.8)"
SCORE = """ids as (select s from pr union select s from tr union select entity_id as s from norm where src = 1 and {all}),
es as (select s, (select count(*) from pr where pr.s = ids.s) as np, (select count(*) from tr where tr.s = ids.s) as nt,
       (select count(*) from pr join tr using (s, d) where pr.s = ids.s) as hits from ids)"""
F05 = "case when np = 0 and nt = 0 then 1.0 when np = 0 or nt = 0 or hits = 0 then 0.0 else 1.25 * (hits / np) * (hits / nt) / (0.25 * (hits / np) + hits / nt) end"
PAIR = "s as source1_entity_id, d as candidate_entity_id"


def _list(src: str, name: str) -> str:
    return f"select n.entity_id as source1_entity_id, coalesce(string_agg(d, ',' order by d), '') as {name} from norm n left join {src} x on x.s = n.entity_id where n.src = 1 group by n.entity_id"


ATTR = """pa as (select x.*, a.name_norm an, b.name_norm bn, a.name_suffix asx, b.name_suffix bsx, a.name_first_token af, b.name_first_token bf, a.name_acronym aa, b.name_acronym ba,
  a.name_token_count ac, b.name_token_count bc, a.name_tokens atk, b.name_tokens btk, a.addr_norm ad, b.addr_norm bd, a.addr_pin ap, b.addr_pin bp,
  a.addr_street_num ast, b.addr_street_num bst, a.country_norm aco, b.country_norm bco from cand x join norm a on a.entity_id = x.s join norm b on b.entity_id = x.d)"""


def _same(a: str, b: str, op: str = "=") -> str:
    return f"cast({a} <> '' and {b} <> '' and {a} {op} {b} as bigint)"


#: DuckDB counts bytes: accented letters of the tables' languages go to control characters, one each, which changes no distance.
_ACCENTED = "àâäáãçéèêëíìîïñóòôöõúùûüßœæ"
_CONTROL = " || ".join(f"chr({i})" for i in [*range(1, 9), *range(14, 32), 127][: len(_ACCENTED)])


def _bytes(c: str) -> str:
    return f"translate({c}, '{_ACCENTED}', {_CONTROL})"


def _lev(a: str, b: str) -> str:
    x, y = _bytes(a), _bytes(b)
    return f"round(case when greatest(length({a}), length({b})) = 0 then 1.0 else 1 - levenshtein({x}, {y}) / greatest(length({a}), length({b})) end, 4)"


def _jw(a: str, b: str) -> str:
    x, y = _bytes(a), _bytes(b)
    return f"case when {a} = '' and {b} = '' then 1.0 when {a} = '' or {b} = '' then 0.0 else jaro_winkler_similarity({x}, {y}) end"


ADDR = f"""da as (select distinct x as a from (select ad as x from pa union all select bd from pa) where x <> ''),
bb as (select '' as bk, '' as side, a as entity_id, a as addr from da),
af as (select entity_id, t, count(*) as tf from {_grams("addr", *C.addr_ngrams, table="bb")} group by all),
av as (select * from (select t, df, row_number() over (order by total desc, t) as rn from (select t, count(*) as df, sum(tf) as total from af group by t)
       where df >= {C.addr_min_df} and df <= {C.addr_max_df} * (select count(*) from da)) where rn <= {C.addr_max_features}),
ar as (select entity_id, t, tf * (ln((1 + (select count(*) from da)) / (1 + df)) + 1) as w from af join av using (t)),
aw as (select entity_id, t, w / sqrt(sum(w * w) over (partition by entity_id)) as w from ar),
ap2 as (select distinct ad, bd from pa),
dot as (select ad, bd, sum(x.w * y.w) as v from ap2 join aw x on x.entity_id = ad join aw y on y.entity_id = bd and y.t = x.t group by ad, bd)"""

def _lcs(a: str, b: str) -> str:
    """Length of the longest common subsequence: a row of the table for each character of a, from lists of where it is in b."""
    at = f"list_transform(string_split({a}, ''), lambda x: list_transform(string_split({b}, ''), lambda y: cast(x = y as int)))"
    zeros = f"list_transform(range(length({b})), lambda i: 0)"
    step = "list_transform(range(1, len(m) + 1), lambda j: case when m[j] = 1 then coalesce(r[j - 1], 0) + 1 else r[j] end)"
    row = f"list_transform(range(1, len(m) + 1), lambda k: list_max(list_slice({step}, 1, k)))"
    return f"case when {a} = '' or {b} = '' then 0 else list_max(list_reduce(list_concat([{zeros}], {at}), lambda r, m: {row})) end"


def _ratio(a: str, b: str) -> str:
    return f"case when length({a}) + length({b}) = 0 then 1.0 else 2 * ({_lcs(a, b)}) / (length({a}) + length({b})) end"


#: Of distinct pairs of names: the words that both have, and either's others, each sorted and joined.
RATIOS = f"""np0 as (select distinct an, bn, list_sort(list_filter(string_split(an, ' '), lambda w: w <> '')) as awords, list_sort(list_filter(string_split(bn, ' '), lambda w: w <> '')) as bwords from pa),
np1 as (select *, array_to_string(awords, ' ') as aj, array_to_string(bwords, ' ') as bj, array_to_string(list_sort(list_distinct(list_filter(awords, lambda w: list_contains(bwords, w)))), ' ') as cc,
        array_to_string(list_sort(list_distinct(list_filter(awords, lambda w: not list_contains(bwords, w)))), ' ') as ra, array_to_string(list_sort(list_distinct(list_filter(bwords, lambda w: not list_contains(awords, w)))), ' ') as rb from np0),
np2 as (select *, trim(cc || ' ' || ra) as one, trim(cc || ' ' || rb) as two from np1),
np3 as (select an, bn, case when aj = '' and bj = '' then 1.0 when aj = '' or bj = '' then 0.0 else {_ratio("aj", "bj")} end as sort_r,
        case when aj = '' or bj = '' then 0.0 when cc <> '' and (ra = '' or rb = '') then 1.0
             else greatest({_ratio("one", "two")}, case when cc = '' then 0.0 else 2 * length(cc) / (length(cc) + length(one)) end, case when cc = '' then 0.0 else 2 * length(cc) / (length(cc) + length(two)) end) end as set_r from np2)"""

ORACLES: dict[str, str] = {
    "features_token_ratio": f"with {CAND}, {ATTR}, {RATIOS} select {PAIR}, round(set_r, 4)::double as name_token_set, round(sort_r, 4)::double as name_token_sort from pa join np3 using (an, bn)",
    "pair_features": f"with {CAND}, {ATTR}, {RATIOS}, {ADDR}, rc as (select s, d, row_number() over (partition by d order by blend desc, s) = 1 as nn from cand), "
    f"all25 as (select s, d, {_same('an', 'bn')} as name_exact, {_jw('an', 'bn')} as name_jw, {_lev('an', 'bn')} as name_lev, set_r as name_token_set, sort_r as name_token_sort, "
    f"{_same('asx', 'bsx')} as suffix_match, {_same('af', 'bf')} as first_token_match, {_same('aa', 'ba')} as acronym_match, len(list_intersect(atk, btk)) as name_common_tokens, "
    "case when len(atk) > 0 and len(btk) > 0 then len(list_intersect(atk, btk)) / len(list_distinct(list_concat(atk, btk))) else 0.0 end as name_common_ratio, abs(ac - bc) as name_token_count_diff, "
    f"{_jw('ad', 'bd')} as addr_jw, {_lev('ad', 'bd')} as addr_lev, coalesce(v, 0.0) as addr_tfidf_cos, {_same('ap', 'bp')} as pin_match, {_same('ast', 'bst')} as street_num_match, {_same('aco', 'bco')} as country_match, "
    f"cast({_jw('an', 'bn')} >= {C.mismatch_name} and {_jw('ad', 'bd')} < {C.mismatch_addr} as int) as name_match_addr_mismatch, {_same('ap', 'bp', '<>')} as pin_conflict, {_same('ast', 'bst', '<>')} as street_num_conflict, "
    "blend as blend_score, name_rank, addr_rank, cc as candidate_count, cast(nn as int) as is_reciprocal_nn from pa join np3 using (an, bn) left join dot using (ad, bd) join rc using (s, d)) "
    f"select {PAIR}, " + ", ".join(f"round({c}::double, 4) as {c}" for c in FEATURE_COLS) + " from all25",
    "train_cap_ids": f"with {CAND} select s as source1_entity_id from (select distinct s from cand) order by md5('{C.seed}:' || s), s limit 50",
    "country_sample": f"with {NORM}, q as (select * from norm where src = 1 order by md5('{C.seed}:' || entity_id), entity_id limit 50), "
    "i as (select * from norm where src <> 1 and country_norm in (select country_norm from q)), "
    f"r as (select *, row_number() over (partition by country_norm order by md5('{C.seed}:' || entity_id), entity_id) as rn from i) "
    "select entity_id, country_norm from q union all select entity_id, country_norm from r "
    "where (select count(*) from i) <= 100 or rn <= greatest(1, 100 // (select count(distinct country_norm) from q))",
    "norm_name": f"with {NORM} select entity_id, name_norm, name_full_norm, name_suffix, name_first_token, name_acronym, name_token_count from norm",
    "norm_address": f"with {NORM} select entity_id, addr_norm, addr_pin, addr_street_num, addr_landmark, addr_token_count from norm",
    "norm_country": f"with {NORM} select country, country_norm, count(*) as n from norm group by all",
    "anchor_pairs": f"with {BLOCKS}, {ANCHOR} select {PAIR}, 1.0::double as addr_anchor from anc",
    "block_anchor": f"with {BLOCKS}, {ANCHOR}, kept as (select s, d from (select distinct s, d, dense_rank() over (partition by s order by d) as rn from anc) where rn <= {C.prune_hard_cap}) " + _list("kept", "candidate_entity_ids"),
    "block_token": f"with {BLOCKS}, {TOKEN} select {PAIR}, shared, round(j, 4) as token_jaccard from tok2",
    "fallback_block": f"with {BLOCKS}, bb as (select * from b where bk = '*'), {TOKEN.replace('from b)', 'from bb)')} select {PAIR}, shared, round(j, 4) as token_jaccard from tok2",
    "idf_vocab": f"with {BLOCKS}, {_tfidf('nm', 'name_norm', C.sim_floor, C.top_k)} select bk as block_key, t as term, df, n from nmv",
    "block_tfidf": f"with {BLOCKS}, {_tfidf('nm', 'name_norm', C.sim_floor, C.top_k)} select {PAIR}, round(sim, 6) as name_sim from nm",
    "block_tfidf_address": f"with {BLOCKS}, {_tfidf('am', 'addr_norm', 0.5, 5)} select {PAIR}, round(sim, 6) as addr_sim from am",
    "blocked_candidates": f"with {CAND} select {PAIR}, round(name_sim, 6) as name_sim, round(addr_sim, 4) as addr_sim, round(token_jaccard, 4) as token_jaccard, round(addr_anchor, 4) as addr_anchor, round(blend, 6) as blend_score, name_rank, addr_rank, cc as candidate_count from cand",
    "candidate_pairs": f"with {CAND} " + _list("cand", "candidate_entity_ids"),
    "matching_results": f"with {CAND}, {PRED} " + _list("pr", "matched_entity_ids"),
    "run_statistics": f"with {CAND}, {PRED} select count(x.s) as n_matched, count(*) - count(x.s) as n_singleton from (select entity_id as s from norm where src = 1) n left join (select distinct s from pr) x using (s)",
    "output_violations": f"with {CAND}, {PRED}, q1 as (select entity_id from norm where src = 1 union all select entity_id from norm where src = 1 and entity_id like '%6'), "
    "m2 as (select s, d from pr union select s, d || 'x' from pr where d like '%3'), c2 as (select s, d from cand union select s, d || 'z' from cand where d like '%1' union select s || 'y', d from cand where s like '%4'), "
    "v as (select 'query id repeated' as rule, count(*) as n from (select entity_id from q1 group by 1 having count(*) > 1) union all "
    "select 'match is no candidate', count(*) from (select s, d from m2 except select s, d from c2) union all "
    "select 'candidate isn''t in the catalogue', count(*) from c2 where d not in (select entity_id from norm where src <> 1) union all "
    "select 'candidate of an unknown query id', count(*) from c2 where s not in (select entity_id from q1)) select rule, n from v where n > 0",
    "features_native": f"with {CAND}, {ATTR} select {PAIR}, {_same('an', 'bn')} as name_exact, {_same('asx', 'bsx')} as suffix_match, {_same('af', 'bf')} as first_token_match, {_same('aa', 'ba')} as acronym_match, "
    f"cast(len(list_intersect(atk, btk)) as bigint) as name_common_tokens, abs(ac - bc) as name_token_count_diff, {_same('ap', 'bp')} as pin_match, {_same('ast', 'bst')} as street_num_match, {_same('aco', 'bco')} as country_match, "
    f"{_same('ap', 'bp', '<>')} as pin_conflict, {_same('ast', 'bst', '<>')} as street_num_conflict, {_lev('an', 'bn')} as name_lev, "
    f"round(case when len(atk) > 0 and len(btk) > 0 then len(list_intersect(atk, btk)) / len(list_distinct(list_concat(atk, btk))) else 0.0 end, 4) as name_common_ratio, {_lev('ad', 'bd')} as addr_lev from pa",
    "features_jw": f"with {CAND}, {ATTR}, s2 as (select s, d, {_jw('an', 'bn')} as nj, {_jw('ad', 'bd')} as aj from pa) "
    f"select {PAIR}, round(nj, 4) as name_jw, round(aj, 4) as addr_jw, cast(nj >= {C.mismatch_name} and aj < {C.mismatch_addr} as bigint) as name_match_addr_mismatch from s2",
    "feature_addr_cosine": f"with {CAND}, {ATTR}, {ADDR} select {PAIR}, round(coalesce(v, 0.0), 4) as addr_tfidf_cos from pa left join dot using (ad, bd)",
    "reciprocal_nn": f"with {CAND} select {PAIR}, cast(row_number() over (partition by d order by blend desc, s) = 1 as bigint) as is_reciprocal_nn from cand",
    "labels_weights": f"with {CAND}, {TRUTH}, lb as (select c.*, cast(tr.s is not null as bigint) as y, name_sim > 0.9 and addr_anchor = 0 as hard from cand c left join tr using (s, d)), "
    f"rt as (select sum(1 - y) / greatest(sum(y), 1) as r from lb) select {PAIR}, y as is_match, round(case when y = 1 then r when hard then {C.hard_neg_weight} else 1.0 end, 4)::double as weight, cast('0x' || substr(md5(s), 1, 7) as bigint) % {C.n_folds} as fold from lb, rt",
    "blocking_recall": f"with {CAND}, {TRUTH}, f as (select count(c.s) as n_found, count(*) as n_true from tr left join cand c using (s, d)) select n_found, n_true, round(case when n_true = 0 then 1.0 else n_found / n_true end, 4)::double as recall from f",
    "reduction_ratio": f"with {CAND}, f as (select (select count(*) from cand) as n_candidates, (select count(*) from norm where src = 1) as n_s1, (select count(*) from norm where src <> 1) as n_catalogue) "
    "select *, round(case when n_s1 * n_catalogue = 0 then 1.0 else 1 - n_candidates / (n_s1 * n_catalogue) end, 6)::double as reduction_ratio from f",
    "entity_f05": f"with {CAND}, {TRUTH}, {PRED}, {SCORE.format(all='true')} select s as source1_entity_id, np as n_pred, nt as n_true, hits, round({F05}, 4)::double as f_half from es",
    "macro_f05": f"with {CAND}, {TRUTH}, {PRED}, {SCORE.format(all='false')} select round(coalesce(avg({F05}), 0.0), 4)::double as macro_f_half from es",
    "threshold_sweep": f"with {CAND}, {TRUTH}, g as (select i, i / 100 as t from (select unnest(range({C.threshold_low}, {C.threshold_high})) as i)), "
    "ids as (select entity_id as s from norm where src = 1), np as (select t, s, count(*) as np from cand, g where blend >= t group by t, s), "
    "hh as (select t, s, count(*) as hits from cand join tr using (s, d), g where blend >= t group by t, s), nt as (select s, count(*) as nt from tr group by s), "
    "es as (select t, s, coalesce(np, 0) as np, coalesce(nt, 0) as nt, coalesce(hits, 0) as hits from ids cross join g left join np using (t, s) left join hh using (t, s) left join nt using (s)) "
    f"select round(t, 2)::double as threshold, round(avg({F05}), 4)::double as macro_f_half from es group by t",
    "ground_truth_lists": f"with {NORM}, {TRUTH} select entity_id as source1_entity_id, (select count(*) from tr where tr.s = norm.entity_id) as n from norm where src = 1",
}
