"""The opN queries over the driver's tables, with SQL where SQL can express them.

op2, op4, op5, op6, op8, op9 and op10 have no SQL: their library ids, hashes, models and wrappers are outside it. Their
tests hold them against plain Python.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kithlink.llm import edit_counts, exact_dedup, html_extraction, line_dedup, packing, piece, quality_rules, simhash, token_store, toxicity
from kithlink.llm.common import documents, scratch

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.score(documents(spark, sf_dir))


@query
def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece.encode_documents(documents(spark, sf_dir), digest=True)


@query
def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_dedup.line_stats(documents(spark, sf_dir))
    return rows.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


@query
def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash.near_groups(documents(spark, sf_dir))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op5_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "token-store")
    token_store.write_store(documents(spark, sf_dir), path)
    return token_store.read_store(spark, path)


@query
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(documents(spark, sf_dir), toxicity.train_labels(spark, sf_dir))


@query
def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.groups_of_copies(documents(spark, sf_dir), carry={"text_sha256": F.sha2("t", 256)})


@query
def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))


@query
def op9_edit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_counts.edit_counts(documents(spark, sf_dir), derive=edit_counts.cleaning_edits)


@query
def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


_W = r"[^\x20\x09-\x0D]+"
_BLANKS = "' ' || chr(9) || chr(11) || chr(12) || chr(13)"
_SPACES = f"{_BLANKS} || chr(10)"


def _chars(l: str, gone: str) -> str:
    return f"length(translate({l}, {gone}, ''))"


_NONBLANK = _chars("l", _BLANKS)
_NBLANK = f"(length(l) - {_NONBLANK})"
_SEP = f"(length(l) - {_chars('l', chr(39) + quality_rules.SEPARATORS + chr(39))})"
_ENDS = quality_rules.ENDS.replace("'", "''")

ORACLES["op1_quality_rules"] = f"""
with d as (
  select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '{_W}') as w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: trim(l, {_SPACES}) <> '') as ls
  from documents),
win as (
  select doc_id, i, array_to_string(list_slice(w, i, i + 7), ' ') as s
  from (select doc_id, w, unnest(generate_series(1, len(w) - 7)) as i from d)),
rep as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, s) as c from win) where c > 1),
cov as (select doc_id, count(distinct i + k) as n from rep, (select unnest(generate_series(0, 7)) as k) group by doc_id),
m as (
  select d.doc_id, cast(len(w) as bigint) as n_words, cast(length(array_to_string(w, '')) as bigint) as word_chars,
         cast(length(t) - {_chars("t", "'" + quality_rules.SYMBOLS + "'")} as bigint) as n_symbols,
         cast(len(ls) - len(list_distinct(ls)) as bigint) as n_dup_lines, cast(coalesce(n, 0) as bigint) as n_repeat_words,
         cast(coalesce(list_sum(list_transform(list_filter(ls, lambda l: not (
           (position(right(rtrim(l, {_BLANKS}), 1) in '{_ENDS}') = 0 and {_NBLANK} < 3)
           or 5 * length(regexp_replace(l, '[A-Za-z0-9\\x20\\x09-\\x0D\\x{{80}}-\\x{{10FFFF}}]+', '', 'g')) > {_NONBLANK}
           or ({_SEP} >= 3 and 6 * {_SEP} > {_NBLANK})
           or ({_NBLANK} >= 4 and 2 * length(regexp_replace(l, '[^\\p{{Lu}}]+', '', 'g')) > {_NONBLANK})
           or ({_NBLANK} < 20 and regexp_matches(lower(l), '{quality_rules.BOILERPLATE}')))), lambda l: {_NONBLANK})), 0) as bigint) as kept_chars
  from d left join cov using (doc_id))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, kept_chars,
       n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed,
       not (n_words < 20 or 100 * n_repeat_words > 30 * n_words) and 2 * kept_chars >= word_chars as kept
from m
"""

_KEY = f"translate(trim(l, {_SPACES}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLES["op3_line_dedup"] = f"""
with s as (select doc_id, string_split(coalesce(text, ''), chr(10)) as ls from documents),
u as (select doc_id, unnest(ls) as l, generate_subscripts(ls, 1) as i from s),
k as (select doc_id, i, l, {_KEY} as k from u),
h as (select k, max(doc_id) as keeper from k where length(k) >= 40 group by k having count(distinct doc_id) >= 5),
j as (select k.doc_id, i, l, keeper is not null and keeper <> k.doc_id as gone from k left join h using (k))
select doc_id, cast(count(*) as bigint) as n_lines, cast(count(*) filter (gone) as bigint) as n_dropped,
       sha256(coalesce(string_agg(l, chr(10) order by i) filter (not gone), '')) as kept_sha256
from j group by doc_id
"""
ORACLES["op7_exact_dedup"] = r"""
with n as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as t from documents),
g as (select t, min(doc_id) as keep_id, count(*) as group_size from n group by t)
select doc_id, keep_id, cast(group_size as bigint) as group_size, doc_id = keep_id as kept, sha256(t) as text_sha256 from n join g using (t)
"""
