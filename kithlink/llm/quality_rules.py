"""Line-first quality rules, with DataFrame functions only.

Each line that has words is held against the rules for punctuation, navigation, shouting and boilerplate; lines that
fail go, and a document that loses more than half of its non-blank characters this way is rejected. Before that, the
base measures reject documents with few words or with many words in repeated windows of eight.

Words are `[^\\x20\\x09-\\x0D]+`. Repeated windows are found by 64-bit hashes of each document's own windows: only
documents that have any are sorted, and the sort is by document, so that its size is bounded by the document.

Defined cases: null, empty and blank texts have no words and fail; rows that share a doc_id are judged each by itself;
an empty table gives no rows; other columns are ignored, or kept by `keep_good`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 20, 30, 8
#: Phrases of page furniture. Fixed values of this operator.
BOILERPLATE = (
    "all rights reserved|terms of (use|service)|privacy policy|cookie policy|uses cookies|accept cookies|enable javascript|click here|"
    "read more|sign up|log in|subscribe to|follow us|share (this|on)|powered by|back to top|skip to content"
)
#: Marks that a sentence can end with. Fixed values.
ENDS = ".!?…:;。！？؟।\"'”’»)]"
SEPARATORS = "|›»•·"
BLANKS = " \t\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"


def _q(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'").replace("\t", "\\t").replace("\x0b", "\\u000b").replace("\x0c", "\\u000c").replace("\r", "\\r").replace("\n", "\\n") + "'"


SPACE_SET = _q(" \t\n\x0b\x0c\r")
#: Of a line x.l with x.n characters that aren't blank: the rules. Cheap tests come first.
_BLANKS = "length(x.l) - x.n"
_SEPARATED = f"length(x.l) - length(translate(x.l, {_q(SEPARATORS)}, ''))"
_RULES = {
    "punctuation": f"(instr({_q(ENDS)}, right(rtrim({_q(BLANKS)}, x.l), 1)) = 0 and {_BLANKS} < 3) or 5 * length(regexp_replace(x.l, '[A-Za-z0-9\\\\x20\\\\x09-\\\\x0D\\\\x{{80}}-\\\\x{{10FFFF}}]+', '')) > x.n",
    "navigation": f"regexp_like(x.l, '[{SEPARATORS}][^{SEPARATORS}]*[{SEPARATORS}][^{SEPARATORS}]*[{SEPARATORS}]') and 6 * ({_SEPARATED}) > {_BLANKS}",
    "shouting": f"{_BLANKS} >= 4 and regexp_like(x.l, '\\\\p{{Lu}}[\\\\x20\\\\x09-\\\\x0D]*\\\\p{{Lu}}') and 2 * length(regexp_replace(x.l, '[^\\\\p{{Lu}}]+', '')) > x.n",
    "boilerplate": f"{_BLANKS} < 20 and regexp_like(lower(x.l), '{BOILERPLATE}')",
}


def _measured(docs: DataFrame) -> DataFrame:
    w = WINDOW
    rows = docs.withColumn("__t", F.expr("coalesce(text, '')"))
    rows = rows.withColumn("__w", F.expr(f"case when btrim(__t, {SPACE_SET}) = '' then array() else split(btrim(__t, {SPACE_SET}), '[\\\\x20\\\\x09-\\\\x0D]+', -1) end"))
    rows = rows.withColumn("__l", F.expr(f"filter(split(__t, '\\n', -1), l -> btrim(l, {SPACE_SET}) <> '')"))
    rows = rows.withColumn("__h", F.expr("transform(__w, x -> xxhash64(x))"))
    window = ", ".join(f"__h[i + {k}]" for k in range(w))
    rows = rows.withColumn("__v", F.expr(f"case when size(__h) < {w} then array(0L) else transform(sequence(0, size(__h) - {w}), i -> xxhash64({window})) end"))
    again = "filter(s, (x, i) -> coalesce(get(s, i - 1).h = x.h, false) or coalesce(get(s, i + 1).h = x.h, false))"
    covered = f"aggregate(transform(r, (p, i) -> least({w}, coalesce(get(r, i + 1) - p, {w}))), 0, (a, x) -> a + x)"
    repeated = (
        "case when size(array_distinct(__v)) = size(__v) then 0 else "
        f"transform(array(sort_array(transform(__v, (h, i) -> struct(h as h, i as p)))), s -> transform(array(sort_array(transform({again}, x -> x.p))), r -> {covered})[0])[0] end"
    )
    fails = " or ".join(f"({x})" for x in _RULES.values())
    return rows.select(
        *docs.columns,
        F.expr("cast(size(__w) as long)").alias("n_words"),
        F.expr("cast(length(array_join(__w, '')) as long)").alias("word_chars"),
        F.expr(f"cast(length(__t) - length(translate(__t, {_q(SYMBOLS)}, '')) as long)").alias("n_symbols"),
        F.expr("cast(size(__l) - size(array_distinct(__l)) as long)").alias("n_dup_lines"),
        F.expr(f"cast({repeated} as long)").alias("n_repeat_words"),
        F.expr(f"aggregate(filter(transform(__l, l -> struct(l as l, length(translate(l, {_q(BLANKS)}, '')) as n)), x -> not ({fails})), 0L, (a, x) -> a + x.n)").alias("kept_chars"),
    )


def _verdict(rows: DataFrame) -> DataFrame:
    rows = rows.withColumn("base_failed", F.expr(f"n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words"))
    return rows.withColumn("kept", F.expr("not base_failed and 2 * kept_chars >= word_chars"))


def score(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) with the base measures, kept_chars (non-blank characters of lines that pass), base_failed, kept."""
    return _verdict(_measured(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).drop("text"))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs that are kept, whole and with their own columns."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    plain = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names)), F.col("text"))
    rows = _verdict(_measured(plain))
    # A filter would be pushed below the measures and repeat them inside itself; an empty array drops a row without that.
    rows = rows.select(*names, F.explode(F.when(F.col("kept"), F.array(F.lit(1)))).alias("__one"))
    return rows.select(*(F.col(n).alias(c) for c, n in zip(docs.columns, names)))
