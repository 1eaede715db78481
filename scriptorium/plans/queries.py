"""Registered queries of the operators, over the driver's tables, and their DuckDB SQL.

Stand-ins: documents are transcriptions, adjacent turns of a conversation truth and
prediction, names of parts and customers short lines, integers of lineitem boxes of lines.
Each query reads its whole tables. Doubles that come from division are rounded alike on
both sides, or left as counts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import distance, text
from ..functions import lexicons as lex
from ..operators import align, contract, corpus, image, layout, metrics, nlp
from ..streaming import review

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- SQL pieces -------------------------------------------------------------------------


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _list(words) -> str:
    return "[" + ", ".join(_quoted(w) for w in words) + "]"


def _count_substrings(column: str, markers) -> str:
    return "(" + " + ".join(f"contains({column}, {_quoted(m)})::int" for m in markers) + ")"


WORDS = r"list_distinct(list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}_]+'), lambda w: w <> ''))"


def _overlap(words: str, lexicon) -> str:
    return f"len(list_intersect({words}, {_list(dict.fromkeys(lexicon))}))"


_LANGUAGE = f"""select doc_id, {_overlap("w", lex.LATIN_WORDS)}::int as latin, {_overlap("w", lex.FRENCH_WORDS)}::int as french from (select doc_id, {WORDS} as w from documents)"""
_NLP = f"""select doc_id, latin, french, case when latin * 2 > french * 3 then 'latin' when french * 2 > latin * 3 then 'old_french' else 'mixed' end as language from ({_LANGUAGE})"""

# --- languages --------------------------------------------------------------------------


@query(_NLP)
def language_nlp(spark, sf_dir):
    scored = table(spark, sf_dir, "documents").select("doc_id", F.inline(F.array(text.language_counts(F.col("text")))))
    return scored.withColumn("language", text.dominant(F.col("latin"), F.col("french")))


_CORPUS = f"""select doc_id, case when f > l then 'old_french' when l > f then 'latin' else 'unknown' end as language from
(select doc_id, {_count_substrings("t", lex.FRENCH_CORPUS)} as f, {_count_substrings("t", lex.LATIN_CORPUS)} as l from (select doc_id, lower(text) as t from documents))"""


@query(_CORPUS)
def language_corpus(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.corpus_language(F.col("text")).alias("language"))


@query(f"""select doc_id, f::int as french, l::int as latin, (f > l and f >= 2) as is_old_french from
(select doc_id, {_count_substrings("t", lex.FRENCH_FILTER)} as f, {_count_substrings("t", lex.LATIN_FILTER)} as l from (select doc_id, lower(text) as t from documents))""")
def old_french_filter(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.inline(F.array(text.old_french(F.col("text")))))


@query(f"select language, count(*)::bigint as n, round(count(*) * 100.0 / (select count(*) from documents), 4) as percent from ({_CORPUS}) group by language")
def language_distribution(spark, sf_dir):
    return corpus.language_shares(table(spark, sf_dir, "documents")).select("language", "n", F.round("percent", 4).alias("percent"))


# --- error rates ------------------------------------------------------------------------

_PAIRS = "(select a.conv_id, a.turn, a.text as truth, b.text as pred from conversations a join conversations b on a.conv_id = b.conv_id and b.turn = a.turn + 1)"
# white space of text.WS, as RE2 writes it
_SPACE = r"[\t-\r\x1c-\x20\x{85}\p{Z}]"


def _pairs(spark, sf_dir) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    b = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("pred"))
    return c.select("conv_id", "turn", F.col("text").alias("truth")).join(b, ["conv_id", "turn"])


def _stripped(column: str) -> str:
    return f"regexp_replace(coalesce({column}, ''), '^{_SPACE}+|{_SPACE}+$', '', 'g')"


_STRIPPED = f"(select conv_id, turn, {_stripped('truth')} as st, {_stripped('pred')} as sp from {_PAIRS})"
_CLEAN = f"(select *, case when st = '' then ' ' else st end as t, case when sp = '' then ' ' else sp end as p from {_STRIPPED})"
_UNITS = f"""(select *, string_split(t, '') as tc, string_split(p, '') as pc, list_filter(string_split_regex(t, '{_SPACE}+'), lambda w: w <> '') as tw, list_filter(string_split_regex(p, '{_SPACE}+'), lambda w: w <> '') as pw from {_CLEAN})"""


def _distance(a: str, b: str, common: str) -> str:
    """Levenshtein of two lists. DuckDB's counts bytes, so each unit that both sides hold becomes an ASCII letter of
    its own, and the others one letter for each side: they match nothing, whatever they are."""
    spelt = lambda x, other: f"array_to_string(list_transform({x}, lambda w: chr(coalesce(nullif(list_position({common}, w), 0) + 2, {other})::int)), '')"
    return f"levenshtein({spelt(a, 1)}, {spelt(b, 2)})"


_METRICS = f"""(select conv_id, turn, st, sp, t, p, pc, case when len(tw) = 0 then (t <> p)::int else {_distance("tc", "pc", "cs")} end::int as char_edits, case when len(tw) = 0 then 1 else length(t) end::int as char_len,
case when len(tw) = 0 then (t <> p)::int else {_distance("tw", "pw", "ws")} end::int as word_edits, case when len(tw) = 0 then 1 else len(tw) end::int as word_len, {_distance("pc", "tc", "cs")} as swapped
from (select *, list_distinct(list_intersect(tc, pc)) as cs, list_distinct(list_intersect(tw, pw)) as ws from {_UNITS}))"""


def _scored(spark, sf_dir) -> DataFrame:
    return metrics.with_metrics(_pairs(spark, sf_dir), "truth", "pred")


@query(f"select conv_id, turn, char_edits, char_len, round(char_edits / char_len, 6) as cer from {_METRICS}")
def line_cer(spark, sf_dir):
    return _scored(spark, sf_dir).select("conv_id", "turn", "char_edits", "char_len", F.round("cer", 6).alias("cer"))


@query(f"select conv_id, turn, word_edits, word_len, round(word_edits / word_len, 6) as wer from {_METRICS}")
def line_wer(spark, sf_dir):
    return _scored(spark, sf_dir).select("conv_id", "turn", "word_edits", "word_len", F.round("wer", 6).alias("wer"))


@query(f"select count(*)::bigint as num_samples, sum(char_edits)::bigint as char_edits, sum(char_len)::bigint as char_len, sum(word_edits)::bigint as word_edits, sum(word_len)::bigint as word_len, round(sum(char_edits) / sum(char_len), 6) as cer, round(sum(word_edits) / sum(word_len), 6) as wer, round(1 - sum(char_edits) / sum(char_len), 6) as accuracy from {_METRICS}")
def corpus_cer_micro(spark, sf_dir):
    return metrics.micro(_scored(spark, sf_dir)).withColumns({c: F.round(c, 6) for c in ("cer", "wer", "accuracy")})


@query(f"select conv_id, count(*)::bigint as num_aligned, round(avg(char_edits / char_len), 6) as cer_global, round(avg(word_edits / word_len), 6) as wer_global from {_METRICS} group by conv_id")
def page_cer_macro(spark, sf_dir):
    return metrics.macro(_scored(spark, sf_dir), "conv_id", truth="truth").withColumns({c: F.round(c, 6) for c in ("cer_global", "wer_global")})


@query(f"""select conv_id, count(*) filter (c < .05)::bigint as excellent, count(*) filter (c >= .05 and c < .15)::bigint as bon, count(*) filter (c >= .15 and c < .30)::bigint as moyen,
count(*) filter (c >= .30 and c < .50)::bigint as mauvais, count(*) filter (c >= .50)::bigint as catastrophique from (select conv_id, char_edits / char_len as c from {_METRICS}) group by conv_id""")
def cer_buckets(spark, sf_dir):
    return metrics.bucket_counts(_scored(spark, sf_dir), "conv_id")


@query(f"""with x as (select case when sp = '' then 1.0 when st = '' then 1.0 else swapped / length(sp) end as cer from {_METRICS}), s as (select min(cer) as lo, max(cer) as hi from x),
b as (select case when hi > lo then least(floor((cer - lo) / ((hi - lo) / 20)), 19) else 0 end::int as bin, count(*)::bigint as n from x, s group by 1)
select i::int as bin, coalesce(n, 0)::bigint as n from range(20) r(i) left join b on b.bin = r.i""")
def cer_swapped_hist(spark, sf_dir):
    p = _pairs(spark, sf_dir).select(metrics.swapped_cer(F.col("truth"), F.col("pred")).alias("cer"))
    return metrics.histogram(p, "cer").select("bin", "n")


@query("""select p_partkey, levenshtein(p_name, p_type)::int as edits, round(levenshtein(p_name, p_type) / length(p_name), 6) as cer from part""")
def name_distance(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", distance.char_edits(F.col("p_name"), F.col("p_type")).alias("edits"), F.round(distance.char_edits(F.col("p_name"), F.col("p_type")) / F.length("p_name"), 6).alias("cer"))


# --- confidence, review, contract -------------------------------------------------------

_CALIBRATE = "case when {0} < 0 then 0.10 when {0} < .05 then .95 when {0} < .10 then .90 when {0} < .15 then .85 when {0} < .20 then .75 when {0} < .30 then .65 when {0} < .50 then .50 when {0} < .75 then .35 when {0} < 1 then .20 else .10 end"


@query(f"select l_orderkey, l_linenumber, round(l_discount * l_quantity, 4) as cer, ({_CALIBRATE.format('round(l_discount * l_quantity, 4)')})::double as confidence from lineitem")
def calibrate(spark, sf_dir):
    cer = F.round(F.col("l_discount") * F.col("l_quantity"), 4)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", cer.alias("cer"), text.calibrated_confidence(cer).alias("confidence"))


@query(SQL["calibrate"])
def calibrate_by_table(spark, sf_dir):
    bounds = [0.0, *(b for b, _ in text.CALIBRATION), float("inf")]
    values = [v for _, v in text.CALIBRATION] + [0.10]
    ranges = spark.createDataFrame(list(zip(bounds, bounds[1:], values)), "low double, high double, confidence double")
    cer = F.round(F.col("l_discount") * F.col("l_quantity"), 4)
    return align.calibrate(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", cer.alias("cer")), ranges)


# turns of conversations are lines; the base confidence comes from the turn
_LINE = "(select conv_id, turn, text, 0.5 + (turn % 10) / 20.0 as base, regexp_replace(text, '^[\\s]+|[\\s]+$', '', 'g') as s from conversations)"
_KINDS = "len(list_distinct(string_split(text, '')))"
_FALLBACK = f"least(base * (case when length(s) <= 2 then 0.5 when length(s) > 100 then 0.9 else 1.0 end) * (case when {_KINDS} < 3 and length(text) > 5 then 0.3 else 1.0 end), 1.0)"
_SUSPICIOUS = r"(s = '' or (len(list_distinct(string_split(lower(text), ''))) = 1 and length(text) > 3) or (not regexp_matches(text, '[\p{L}\p{N}]') and length(text) > 2) or coalesce(list_max(list_transform(string_split_regex(text, '\s+'), lambda w: length(w))), 0) > 40)"


def _turns(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "conversations").withColumn("base", F.lit(0.5) + (F.col("turn") % 10) / 20.0)


@query(f"select conv_id, turn, round({_FALLBACK}, 6)::double as confidence from {_LINE}")
def fallback_confidence(spark, sf_dir):
    return _turns(spark, sf_dir).select("conv_id", "turn", F.round(text.fallback_confidence(F.col("text"), F.col("base")), 6).alias("confidence"))


@query(f"select conv_id, turn, {_SUSPICIOUS} as suspicious from {_LINE}")
def suspicious(spark, sf_dir):
    return _turns(spark, sf_dir).select("conv_id", "turn", text.is_suspicious(F.col("text")).alias("suspicious"))


@query(f"select conv_id, turn, (base < 0.80 or length(s) <= 1 or {_SUSPICIOUS}) as needs_review from {_LINE}")
def needs_review(spark, sf_dir):
    return _turns(spark, sf_dir).select("conv_id", "turn", text.needs_review(F.col("text"), F.col("base")).alias("needs_review"))


def _entries(spark, sf_dir) -> DataFrame:
    t = _turns(spark, sf_dir)
    n = lambda k: (F.col("turn") * k).cast("int")
    rows = t.select(
        F.col("conv_id").cast("string").alias("document_id"), F.concat(F.col("conv_id").cast("string"), F.lit("_line_"), F.lpad(F.col("turn").cast("string"), 4, "0")).alias("line_id"), "text", F.col("base").alias("confidence"),
        layout.rectangle(F.lit(10), n(20), F.lit(200), n(20) + 15).alias("polygon"), n(1).alias("reading_order"), F.when(F.col("turn") % 7 == 0, "heading").otherwise("main_text").alias("region_type"),
    )
    return contract.contract_lines(rows)


_ENTRY = f"""(select conv_id::varchar as document_id, conv_id::varchar || '_line_' || lpad(turn::varchar, 4, '0') as line_id, s as transcription, round(greatest(0, least(1, base)), 4)::double as confidence,
(base < 0.80 or length(s) <= 1 or {_SUSPICIOUS}) as needs_review, turn::int as reading_order, case when turn % 7 = 0 then 'heading' else 'main_text' end as region_type from {_LINE})"""


@query(f"select document_id, line_id, transcription, confidence, needs_review, reading_order, region_type from {_ENTRY}")
def contract_lines(spark, sf_dir):
    return _entries(spark, sf_dir).select("document_id", "line_id", "transcription", "confidence", "needs_review", "reading_order", "region_type")


@query(f"""select document_id, count(*)::bigint as total_lines, count(*) filter (needs_review)::bigint as needs_review_count, round(count(*) filter (needs_review) / count(*), 6) as needs_review_rate,
round(1 - count(*) filter (needs_review) / count(*), 6) as validated_rate, round(avg(confidence), 4) as avg_confidence, count(*) filter (region_type = 'heading')::bigint as headings, count(*) filter (confidence >= 0.9)::bigint as sure from {_ENTRY} group by document_id""")
def contract_stats(spark, sf_dir):
    s = contract.stats(_entries(spark, sf_dir))
    at = lambda m, k: F.coalesce(F.col(m)[k], F.lit(0)).cast("bigint")
    return s.select("document_id", "total_lines", "needs_review_count", F.round("needs_review_rate", 6).alias("needs_review_rate"), F.round("validated_rate", 6).alias("validated_rate"), "avg_confidence", at("region_distribution", "heading").alias("headings"), at("confidence_distribution", ">=0.9").alias("sure"))


@query(f"""select case when confidence < .5 then '<0.5' when confidence < .7 then '0.5-0.7' when confidence < .8 then '0.7-0.8' when confidence < .9 then '0.8-0.9' else '>=0.9' end as bucket, count(*)::bigint as n, count(*) filter (needs_review)::bigint as reviews from {_ENTRY} group by 1""")
def confidence_distribution(spark, sf_dir):
    return _entries(spark, sf_dir).groupBy(text.confidence_bucket(F.col("confidence")).alias("bucket")).agg(F.count("*").alias("n"), F.count_if("needs_review").alias("reviews"))


# broken lines: each rule is broken by the orders whose key says so
def _broken(spark, sf_dir) -> DataFrame:
    k = F.col("o_orderkey")
    on = lambda m, bad, good: F.when(k % m == 0, bad).otherwise(good)
    pts = on(7, F.array(F.array(F.lit(0), F.lit(0)), F.array(F.lit(1), F.lit(1))), layout.rectangle(F.lit(0), F.lit(0), F.lit(9), F.lit(9)))
    geometry = F.struct(on(11, F.lit("Circle"), F.lit("Polygon")).alias("type"), pts.alias("coordinates"), on(13, F.lit("mm"), F.lit("pixels")).alias("unit"))
    return table(spark, sf_dir, "orders").select(
        on(2, F.lit(None).cast("string"), k.cast("string")).alias("line_id"), F.col("o_orderstatus").alias("transcription"), on(3, F.lit(1.5), F.lit(0.5)).alias("confidence"), geometry.alias("geometry"), F.lit(True).alias("needs_review"),
        on(5, F.lit(-1), F.lit(1)).alias("reading_order"), on(17, F.lit("footer"), F.lit("main_text")).alias("region_type"), k.alias("o_orderkey"),
    )


@query("""select o_orderkey, array_to_string(list_filter([case when o_orderkey % 2 = 0 then 'line_id missing' end, case when o_orderkey % 3 = 0 then 'confidence outside 0..1' end, case when o_orderkey % 11 = 0 then 'geometry type' end,
case when o_orderkey % 13 = 0 then 'geometry unit' end, case when o_orderkey % 7 = 0 then 'geometry coordinates' end, case when o_orderkey % 5 = 0 then 'reading_order negative' end, case when o_orderkey % 17 = 0 then 'region_type unknown' end], lambda x: x is not null), '; ') as violations from orders""")
def contract_violations(spark, sf_dir):
    return _broken(spark, sf_dir).select("o_orderkey", F.array_join(contract.violations(), "; ").alias("violations"))


@query(f"""select line_id, (row_number() over (order by reading_order, document_id::bigint, line_id) - 1)::int as reading_order from {_ENTRY}""")
def merge_contracts(spark, sf_dir):
    rows = _entries(spark, sf_dir).withColumns({"contract_ord": F.col("document_id").cast("bigint"), "line_ord": F.col("line_id")})
    return contract.merge(rows, "merged").select("line_id", "reading_order")


@query(f"select t.conv_id, t.turn, coalesce(e.r, false) as needs_review from conversations t left join (select line_id, bool_or(needs_review) as r from {_ENTRY} group by 1) e on e.line_id = t.conv_id::varchar || '_line_' || lpad(t.turn::varchar, 4, '0')")
def review_lookup(spark, sf_dir):
    t = _turns(spark, sf_dir)
    keyed = t.select("conv_id", "turn", F.col("conv_id").cast("string").alias("document_id"), F.concat(F.col("conv_id").cast("string"), F.lit("_line_"), F.lpad(F.col("turn").cast("string"), 4, "0")).alias("line_id"))
    return align.review_flags(keyed, _entries(spark, sf_dir)).select("conv_id", "turn", "needs_review")


# --- layout -----------------------------------------------------------------------------

_BOX = """(select l_orderkey::varchar as page_id, l_linenumber::int as det_ord, (l_partkey % 900)::int as x0, (l_suppkey * 7 % 1400)::int as y0, (l_partkey % 900 + l_quantity::int * 17)::int as x1, (l_suppkey * 7 % 1400 + (l_partkey * l_suppkey) % 150)::int as y1, 1000 as img_w,
case l_returnflag when 'A' then 'default' when 'N' then 'heading' else 'marginalia' end as tag from lineitem)"""


def _boxes(spark, sf_dir) -> DataFrame:
    k, s = F.col("l_partkey"), F.col("l_suppkey")
    x0, y0 = k % 900, (s * 7) % 1400
    i = lambda c, name: c.cast("int").alias(name)
    tag = F.when(F.col("l_returnflag") == "A", "default").when(F.col("l_returnflag") == "N", "heading").otherwise("marginalia")
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("page_id"), i(F.col("l_linenumber"), "det_ord"), i(x0, "x0"), i(y0, "y0"), i(x0 + F.col("l_quantity").cast("int") * 17, "x1"), i(y0 + (k * s) % 150, "y1"), F.lit(1000).alias("img_w"), F.lit(1500).alias("img_h"), tag.alias("tag"))


# lines whose place on their page is unique
_PLACE = "row_number() over (partition by page_id order by det_ord, x0, y0, x1, y1, tag)::int"
_PLACED = f"(select * replace ({_PLACE} as det_ord) from {_BOX})"


def _placed(spark, sf_dir) -> DataFrame:
    w = Window.partitionBy("page_id").orderBy("det_ord", "x0", "y0", "x1", "y1", "tag")
    return _boxes(spark, sf_dir).withColumn("det_ord", F.row_number().over(w))


_MARGIN = "((x0 < img_w * 0.12 or x1 > img_w * (1 - 0.12)) and x1 - x0 < img_w * 0.35)"
_TYPE = "case tag when 'heading' then 'heading' when 'marginalia' then 'marginalia' else 'main_text' end"
_ROUTE = f"""(select *, case when reason is not null then 'discarded' when region_type = 'marginalia' then 'marginalia' else 'main' end as route from (select *, y1 - y0 as height, x1 - x0 as width,
case when y1 - y0 < 15 or x1 - x0 < 80 then 'too_small' when y1 - y0 > 120 and x1 - x0 < (y1 - y0) * 1.5 then 'drop_capital' end as reason, case when {_MARGIN} then 'marginalia' when y1 - y0 > 120 then 'heading' else {_TYPE} end as region_type from {_BOX}))"""


@query(f"select page_id, det_ord, height, width, region_type, route, reason from {_ROUTE}")
def route_lines(spark, sf_dir):
    return layout.route(_boxes(spark, sf_dir)).select("page_id", "det_ord", "height", "width", "region_type", "route", "reason")


@query(f"""select page_id, det_ord, reason, region_type, case when reason is not null then 'discarded' when region_type = 'marginalia' then 'marginalia' else 'main' end as route from (select *, case when y1 - y0 < 15 or x1 - x0 < 80 then 'too_small' when y1 - y0 > 120 then 'too_tall' end as reason, case when {_MARGIN} then 'marginalia' else {_TYPE} end as region_type from {_BOX})""")
def route_boxes(spark, sf_dir):
    return layout.route(_boxes(spark, sf_dir), "boxes").select("page_id", "det_ord", "reason", "region_type", "route")


@query(f"""select page_id, det_ord, reason, region_type, case when reason is not null then 'discarded' when {_MARGIN} then 'marginalia' else 'main' end as route from (select *, case when y1 - y0 < 15 or x1 - x0 < 80 then 'too_small' when y1 - y0 > 120 then 'too_tall' end as reason, case when {_MARGIN} then 'marginalia' else tag end as region_type from {_BOX})""")
def route_regions(spark, sf_dir):
    return layout.route(_boxes(spark, sf_dir), "regions").select("page_id", "det_ord", "reason", "region_type", "route")


@query(f"""select page_id, det_ord, case route when 'main' then page_id || '_line_' || lpad(i::varchar, 4, '0') when 'marginalia' then page_id || '_marg_' || lpad(i::varchar, 4, '0') end as line_id from (select *, row_number() over (partition by page_id, route order by det_ord) - 1 as i from {_ROUTE.replace(_BOX, _PLACED)})""")
def line_ids(spark, sf_dir):
    return layout.number(layout.route(_placed(spark, sf_dir))).select("page_id", "det_ord", "line_id")


@query(f"select page_id, round(greatest(median(y1 - y0) * 0.6, 12), 6)::double as y_tolerance from {_BOX} group by page_id")
def line_tolerance(spark, sf_dir):
    return layout.tolerance(_boxes(spark, sf_dir).withColumn("height", F.col("y1") - F.col("y0"))).select("page_id", F.round("y_tolerance", 6).alias("y_tolerance"))


@query(f"""with recursive s as (select page_id, det_ord, x0, (y0 + y1) / 2.0 as y, row_number() over (partition by page_id order by (y0 + y1) / 2.0, x0, det_ord) as i, (select greatest(median(b.y1 - b.y0) * 0.6, 12) from {_PLACED} b where b.page_id = a.page_id) as tol from {_PLACED} a),
g as (select page_id, det_ord, x0, i, tol, 0 as grp, y::double as m, 1 as n from s where i = 1
union all select s.page_id, s.det_ord, s.x0, s.i, s.tol, case when abs(s.y - g.m) <= s.tol then g.grp else g.grp + 1 end, case when abs(s.y - g.m) <= s.tol then (g.m * g.n + s.y) / (g.n + 1) else s.y end, case when abs(s.y - g.m) <= s.tol then g.n + 1 else 1 end from g join s on s.page_id = g.page_id and s.i = g.i + 1)
select page_id, det_ord, (row_number() over (partition by page_id order by grp, x0, i) - 1)::int as reading_order from g""")
def reading_order(spark, sf_dir):
    return layout.reading_order(_placed(spark, sf_dir), centre=True).select("page_id", "det_ord", "reading_order")


@query(f"select page_id, det_ord, (row_number() over (partition by page_id order by x0, y0, det_ord) - 1)::int as reading_order from {_PLACED}")
def vertical_order(spark, sf_dir):
    return layout.reading_order(_placed(spark, sf_dir), vertical=True).select("page_id", "det_ord", "reading_order")


@query(f"select page_id, det_ord, least(x0, x1 + 3) as x0, least(y0, y1 - 2) as y0, greatest(x0, x1 + 3) as x1, greatest(y0, y1 - 2) as y1 from {_BOX}")
def bbox_of_polygon(spark, sf_dir):
    b = _boxes(spark, sf_dir)
    p = F.array(F.array("x0", "y0"), F.array(F.col("x1") + 3, F.col("y0")), F.array(F.col("x0"), F.col("y1") - 2))
    return b.select("page_id", "det_ord", layout.bbox(p).alias("b")).select("page_id", "det_ord", "b.*")


@query(f"select page_id, det_ord, greatest(x0, 0) as x0, greatest(y0, 0) as y0, least(x1, img_w) as x1, least(y1, 1500) as y1, floor((least(x1, img_w) - x0) * 384.0 / (least(y1, 1500) - y0))::int as crop_w from {_BOX} where least(x1, img_w) > x0 and least(y1, 1500) > y0")
def clipped_lines(spark, sf_dir):
    return layout.clipped(_boxes(spark, sf_dir)).select("page_id", "det_ord", "x0", "y0", "x1", "y1", "crop_w")


@query("select p_partkey, (p_size * 40) / p_retailprice > 1.2 as is_double from part")
def double_page(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", layout.is_double_page(F.col("p_size") * 40, F.col("p_retailprice")).alias("is_double"))


@query(f"select o.o_orderkey, n::bigint as found, o.o_custkey % 9 as expected, abs(o.o_custkey % 9 - n) / greatest(o.o_custkey % 9, 1) > 0.15 as alert from orders o join (select page_id::bigint as k, count(*) as n from {_BOX} group by 1) b on b.k = o.o_orderkey")
def count_alert(spark, sf_dir):
    n = _boxes(spark, sf_dir).groupBy(F.col("page_id").cast("bigint").alias("o_orderkey")).agg(F.count("*").alias("found"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 9).alias("expected"))
    return o.join(n, "o_orderkey").select("o_orderkey", "found", "expected", text.count_alert(F.col("expected"), F.col("found")).alias("alert"))


_POINTS = "[[x0, y0], [x1, y0], [x1, y1], [x0, y1]]"


@query(f"""select page_id, det_ord, case det_ord % 4 when 0 then [[x0, y0], [x1, y0], [x0, y1]] when 1 then [[x0, y0], [x1, y1], [x0, y1]] when 2 then {_POINTS} else [[0, 0], [1000, 0], [1000, 1500], [0, 1500]] end::varchar as polygon,
case when det_ord % 3 = 0 then '[]' else [[x0, y1], [x1, y1]]::varchar end as baseline, case when det_ord % 3 = 0 then (y0 + y1) / 2.0 else y1 end::double as y from {_BOX}""")
def line_polygons(spark, sf_dir):
    """The polygon of a line by what its segmenter gives: boundary, envelope, box or nothing; its baseline, and the height it stands at."""
    b, k = _boxes(spark, sf_dir), F.col("det_ord") % 4
    real = lambda *p: F.array(*(F.array(*(F.col(v).cast("double") + 0.25 for v in q)) for q in p))
    boundary = F.when(k == 0, real(("x0", "y0"), ("x1", "y0"), ("x0", "y1"))).when(k == 1, real(("x0", "y0"), ("x1", "y0")))
    envelope = F.when(k == 1, real(("x0", "y0"), ("x1", "y1"), ("x0", "y1")))
    box = F.when(k == 2, F.array("x0", "y0", "x1", "y1"))
    points = F.when(F.col("det_ord") % 3 > 0, real(("x0", "y1"), ("x1", "y1")))
    shown = lambda p: F.concat(F.lit("["), F.array_join(F.transform(p, lambda q: F.concat(F.lit("["), F.array_join(q.cast("array<string>"), ", "), F.lit("]"))), ", "), F.lit("]"))
    base = layout.baseline(points)
    return b.select("page_id", "det_ord", shown(layout.polygon(boundary, envelope, box, F.col("img_w"), F.col("img_h"))).alias("polygon"), shown(base).alias("baseline"), layout.baseline_y(base, F.col("y0"), F.col("y1")).alias("y"))


# tags as segmenters write them
_TAGS = {0: '{"type": "Heading"}', 1: '{"type": [{"type": "marginalia"}]}', 2: '{"type": ["title"]}', 3: '"margin"', 4: "{}", 5: '{"other": 1}', 6: "text", 7: '{"type": []}'}
_KIND = {0: "heading", 1: "marginalia", 2: "heading", 3: "marginalia", 4: "main_text", 5: "main_text", 6: "main_text", 7: "main_text"}


@query("select l_orderkey, l_linenumber, case l_partkey % 8 " + " ".join(f"when {k} then '{v}'" for k, v in _KIND.items()) + " end as kind, case case l_partkey % 8 " + " ".join(f"when {k} then '{v}'" for k, v in _KIND.items()) + " end when 'main_text' then 'blue' when 'marginalia' then 'orange' else 'green' end as colour from lineitem")
def tag_types(spark, sf_dir):
    tags = F.element_at(F.array(*(F.lit(v) for v in _TAGS.values())), (F.col("l_partkey") % 8 + 1).cast("int"))
    kind = layout.tag_type(layout.tag_of(tags))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", kind.alias("kind"), text.region_colour(kind).alias("colour"))


@query(f"select page_id, det_ord, page_id || '_region_' || lpad((row_number() over (partition by page_id order by tag, det_ord) - 1)::varchar, 3, '0') as region_id, page_id || '_region_' || lpad((case tag when 'default' then 0 when 'heading' then 1 else 2 end)::varchar, 3, '0') as shared_id from {_PLACED}")
def region_ids(spark, sf_dir):
    kind = F.when(F.col("tag") == "default", 0).when(F.col("tag") == "heading", 1).otherwise(2)
    r = _placed(spark, sf_dir).select("page_id", F.col("det_ord").alias("ord"), kind.alias("type_ord"))
    own, shared = layout.region_ids(r), layout.region_ids(r, shared=True).withColumnRenamed("region_id", "shared_id")
    return own.join(shared.select("page_id", "ord", "shared_id"), ["page_id", "ord"]).select("page_id", F.col("ord").alias("det_ord"), "region_id", "shared_id")


@query(f"select distinct page_id, page_id || '_region_000' as region_id, 'text' as region_type, '1000x1500' as shape from {_BOX} where page_id not in (select page_id from {_BOX} where tag = 'heading')")
def synthetic_regions(spark, sf_dir):
    """A region over the whole page, for pages that have lines and no region (here: no heading)."""
    b = _boxes(spark, sf_dir)
    made = layout.synthetic_regions(b.select("page_id", "img_w", "img_h").distinct(), b.filter("tag = 'heading'"), b)
    corner = F.col("polygon")[2]
    return made.select("page_id", "region_id", "region_type", F.concat_ws("x", corner[0].cast("string"), corner[1].cast("string")).alias("shape"))


@query("select conv_id, turn, trim(substring(text, greatest(turn * 7 - 30, 0) + 1, least(turn * 7 + 5 + 30, length(text)) - greatest(turn * 7 - 30, 0)), E' \t\n\r') as around from conversations")
def context_windows(spark, sf_dir):
    start = F.col("turn").cast("int") * 7
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.context(F.col("text"), start, start + 5).alias("around"))


@query(f"""select conv_id, turn, round(case when c.cer > 0 and turn % 2 = 0 then {_CALIBRATE.format('c.cer')} else {_FALLBACK} end, 6)::double as confidence, case when c.cer < 0.1 then 'green' when c.cer < 0.3 then 'orange' else 'red' end as colour
from (select *, (turn * 13 % 11) / 10.0 as cer from {_LINE}) c""")
def chosen_confidence(spark, sf_dir):
    """Calibrated where there is a truth and an error, else the fallback; and the colour of a title."""
    cer = (F.col("turn") * 13 % 11) / 10.0
    t = _turns(spark, sf_dir)
    return t.select("conv_id", "turn", F.round(text.line_confidence(F.col("turn") % 2 == 0, cer, F.col("text"), F.col("base")), 6).alias("confidence"), text.title_colour(cer).alias("colour"))


@query("select a.conv_id, a.turn, a.text as text, b.text as pred from conversations a join conversations b on a.conv_id = b.conv_id and a.turn = b.turn where a.turn % 2 = 0")
def with_predictions(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").withColumn("img_name", F.concat_ws("_", F.col("conv_id").cast("string"), F.col("turn").cast("string")))
    p = c.filter("turn % 2 = 0").select("img_name", F.col("text").alias("pred"))
    return align.with_predictions(c, p).select("conv_id", "turn", "text", "pred")


@query("select conv_id, turn, case when turn % 2 = 0 then 'a' || turn end as extracted_image from conversations")
def extracted_images(spark, sf_dir):
    """Of several images of a line the first."""
    c = table(spark, sf_dir, "conversations").withColumn("line_id", F.concat_ws("_", F.col("conv_id").cast("string"), F.col("turn").cast("string")))
    x = c.filter("turn % 2 = 0").select("line_id", F.explode(F.array(F.lit("b"), F.lit("a"))).alias("k"), "turn").select("line_id", F.concat("k", F.col("turn").cast("string")).alias("img_path"))
    return align.with_extracted_images(c, x).select("conv_id", "turn", "extracted_image")


# --- alignment --------------------------------------------------------------------------

# one turn in three is known by its own id, by the prefixed id or not at all, as the conversation says
_GT_ID = "case when conv_id % 3 = 0 then 'l' || turn when conv_id % 3 = 1 then conv_id || '_l' || turn else 'x' || turn end"
_ALIGN = f"""with l as (select conv_id, turn, 'l' || turn as line_id from conversations), t as (select conv_id, turn, {_GT_ID} as gt_id, text as gt, row_number() over (partition by conv_id order by turn) as i from conversations where role <> 'assistant' or conv_id % 2 = 0),
h as (select l.*, coalesce(a.gt, b.gt) as by_id, row_number() over (partition by l.conv_id order by l.turn) as i from l left join t a on a.conv_id = l.conv_id and a.gt_id = l.line_id left join t b on b.conv_id = l.conv_id and b.gt_id = l.conv_id || '_' || l.line_id),
g as (select conv_id, count(by_id) as met, count(*) as n from h group by 1)
select h.conv_id, h.turn, coalesce(h.by_id, case when g.met < g.n * 0.5 then t.gt end) as ground_truth from h join g using (conv_id) left join t on t.conv_id = h.conv_id and t.i = h.i"""


def _alignment(spark, sf_dir) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    doc, turn = F.col("conv_id").cast("string"), F.col("turn").cast("string")
    name = F.when(F.col("conv_id") % 3 == 0, F.concat(F.lit("l"), turn)).when(F.col("conv_id") % 3 == 1, F.concat(doc, F.lit("_l"), turn)).otherwise(F.concat(F.lit("x"), turn))
    truth = c.filter("role <> 'assistant' or conv_id % 2 = 0").select(doc.alias("document_id"), name.alias("line_id"), "text", F.col("turn").alias("ord"))
    lines = c.select(doc.alias("document_id"), F.concat(F.lit("l"), turn).alias("line_id"), F.col("turn").alias("reading_order"))
    return align.align(lines, truth)


@query(_ALIGN)
def gt_alignment(spark, sf_dir):
    return _alignment(spark, sf_dir).select(F.col("document_id").cast("bigint").alias("conv_id"), F.col("reading_order").alias("turn"), "ground_truth")


# --- themes -----------------------------------------------------------------------------

_HITS = ", ".join(f"{_overlap('w', k)}::int as k{i}" for i, k in enumerate(lex.THEMES.values()))
_OPEN = ", ".join(f"{_count_substrings('h', lex.OPENINGS[t]) if t in lex.OPENINGS else '0'}::int as o{i}" for i, t in enumerate(lex.THEMES))
# the tables' texts are in other tongues: each gets a few words in front, by its number
_WORDED = [" ".join([*lex.OPENINGS.get(t, [""])[:1], *(k for k in keys if " " not in k)][: 2 + i]) for t, keys in lex.THEMES.items() for i in range(0, 6, 2)] + [f"{f} {k}" for t, fs in lex.OPENINGS.items() for f, k in zip(fs, lex.THEMES["commerce"])] + [""]
_CHARTERS = f"(select * replace ({_list(_WORDED)}[doc_id % {len(_WORDED)} + 1] || ' ' || coalesce(text, '') as text) from documents)"


def _charters(spark, sf_dir) -> DataFrame:
    words = F.array(*(F.lit(w) for w in _WORDED))
    return table(spark, sf_dir, "documents").withColumn("text", F.concat_ws(" ", F.element_at(words, (F.col("doc_id") % len(_WORDED) + 1).cast("int")), F.coalesce("text", F.lit(""))))


_RAW = f"(select doc_id, {_HITS}, {_OPEN} from (select doc_id, {WORDS} as w, substring(lower(text), 1, 200) as h from {_CHARTERS}))"
_SCORES = " union all ".join(f"select doc_id, {i} as i, {_quoted(t)} as theme, k{i} / {max(len(k) * 0.1, 1.0)} + o{i} * 2.0 as score, (k{i} = 0) as late from {_RAW}" for i, (t, k) in enumerate(lex.THEMES.items()))
_THEMES = f"""(select doc_id, theme, s, row_number() over (partition by doc_id order by s desc, late, i) as place from (select *, least(score / max(score) over (partition by doc_id), 1.0)::double as s from ({_SCORES}) where score > 0) where s > 0.15)"""


def _themes(spark, sf_dir) -> DataFrame:
    d = _charters(spark, sf_dir)
    return d.select("doc_id", F.posexplode(nlp.themes(F.col("text"))).alias("place", "t")).select("doc_id", (F.col("place") + 1).cast("bigint").alias("place"), "t.theme", "t.score")


@query(f"select doc_id, place::bigint as place, theme, round(s, 3) as score from {_THEMES}")
def themes(spark, sf_dir):
    return _themes(spark, sf_dir)


@query(f"select theme, count(*)::bigint as n, count(*) filter (place = 1)::bigint as first from {_THEMES} group by theme")
def theme_distribution(spark, sf_dir):
    return _themes(spark, sf_dir).groupBy("theme").agg(F.count("*").alias("n"), F.count_if(F.col("place") == 1).alias("first"))


@query(f"select doc_id, o0 as juridique, o1 as religieux, o2 as administratif from {_RAW}")
def opening_formulas(spark, sf_dir):
    o = nlp.opening_matches(F.col("text"))
    return _charters(spark, sf_dir).select("doc_id", *(c.alias(t) for t, c in o.items()))


# --- entities and relations -------------------------------------------------------------


@query()
def normalized_texts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.normalise("text").alias("normalized_text"))


@query()
def entities_rules(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.explode(nlp.entities(text.normalise("text"))).alias("e")).select("doc_id", "e.*")


@query()
def relations_patterns(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.explode(nlp.relations(text.normalise("text"))).alias("r")).select("doc_id", "r.*")


@query()
def document_analyses(spark, sf_dir):
    found = nlp.analyse(table(spark, sf_dir, "documents"), id_col="doc_id", text_col="text")
    return nlp.document_summaries(found)


@query()
def corpus_report(spark, sf_dir):
    return nlp.report(nlp.analyse(table(spark, sf_dir, "conversations"), id_col="conv_id", text_col="text"))


# events are entities: a user is a document, the day's minutes are offsets
_EVENT = "(select user_id, event_id as ord, event_type as text, case when event_id % 3 = 0 then 'PER' when event_id % 3 = 1 then 'DATE' else 'LOC' end as label, floor(value * 10)::bigint % 2000 as start, ((event_id * 7) % 10) / 10.0 as confidence from events)"


def _events(spark, sf_dir) -> DataFrame:
    k = F.col("event_id")
    label = F.when(k % 3 == 0, "PER").when(k % 3 == 1, "DATE").otherwise("LOC")
    return table(spark, sf_dir, "events").select("user_id", k.alias("ord"), F.col("event_type").alias("text"), label.alias("label"), (F.floor(F.col("value") * 10).cast("bigint") % 2000).alias("start"), (((k * 7) % 10) / 10.0).alias("confidence"))


@query(f"""select user_id, ord, text, label, start from (select *, row_number() over (partition by user_id, lower(text), label, start order by confidence desc, ord) as n from {_EVENT}) where n = 1""")
def entity_dedup(spark, sf_dir):
    return nlp.dedup_entity_rows(_events(spark, sf_dir), "user_id").select("user_id", "ord", "text", "label", "start")


@query(f"select p.user_id, p.ord as p_ord, q.ord as q_ord, p.text as subject, q.text as object, q.label from {_EVENT} p join {_EVENT} q on p.user_id = q.user_id and p.label = 'PER' and q.label <> 'PER' and abs(p.start - q.start) < 80 and p.text <> q.text")
def proximity(spark, sf_dir):
    return nlp.proximity_rows(_events(spark, sf_dir), doc="user_id")


@query(f"select user_id, ord, text, label, object from (select *, row_number() over (partition by user_id, lower(text), label, lower(object) order by ord) as n from (select *, case start % 5 when 0 then '' when 1 then ' Terra' when 2 then 'terra' when 3 then 'VILLA' else 'villa ' end as object from {_EVENT})) where n = 1 and object <> ''".replace("lower(object)", "lower(trim(object))"))
def relation_dedup(spark, sf_dir):
    k = F.col("start") % 5
    thing = F.when(k == 0, "").when(k == 1, " Terra").when(k == 2, "terra").when(k == 3, "VILLA").otherwise("villa ")
    r = _events(spark, sf_dir).select("user_id", "ord", F.col("text").alias("subject"), F.col("label").alias("predicate"), thing.alias("object"))
    return nlp.dedup_relation_rows(r, "user_id").select("user_id", "ord", F.col("subject").alias("text"), F.col("predicate").alias("label"), "object")


@query()
def lda_topics(spark, sf_dir):
    return nlp.topics(table(spark, sf_dir, "documents"), text_col="text")


# --- corpora, runs ----------------------------------------------------------------------


@query("""with n as (select count(*) as n from documents) select 'train' as split, floor(n * 0.9)::bigint as n from n union all select 'dev', floor(n * 0.05)::bigint from n union all select 'test', (n - floor(n * 0.9) - floor(n * 0.05))::bigint from n""")
def split_counts(spark, sf_dir):
    return corpus.split_counts(corpus.split(table(spark, sf_dir, "documents"), key="doc_id", total=None)).select("split", "n")


_SPLIT = "case when k < floor(n * 0.9::double) then 'train' when k < floor(n * 0.9::double) + floor(n * 0.05::double) then 'dev' else 'test' end"
_DEALT = "(select doc_id, row_number() over (order by md5('42:' || doc_id), doc_id) - 1 as k, count(*) over () as n from documents)"


@query(f"select doc_id, split, (row_number() over (partition by split order by k) - 1)::bigint as split_index, split || '_' || lpad((row_number() over (partition by split order by k) - 1)::varchar, greatest(4, length((row_number() over (partition by split order by k) - 1)::varchar))::int, '0') || '.png' as img_name from (select *, {_SPLIT} as split from {_DEALT})")
def split_members(spark, sf_dir):
    """Who is in which split, and the name that each gets there."""
    return corpus.split(table(spark, sf_dir, "documents"), key="doc_id", total=None).select("doc_id", "split", F.col("split_index").cast("bigint").alias("split_index"), "img_name")


@query("select doc_id, n_chars from documents order by md5('7:' || doc_id), doc_id limit 20")
def random_rows(spark, sf_dir):
    """Twenty rows by a hash of their key: a sample is the feature."""
    return corpus.random_rows(table(spark, sf_dir, "documents"), 20, "doc_id", seed=7).select("doc_id", "n_chars")


@query("select doc_id, case when doc_id % 10 < 8 then 'train' else 'dev' end as split from documents where doc_id % 10 < 9")
def manuscript_split(spark, sf_dir):
    k = F.col("doc_id") % 10
    d = table(spark, sf_dir, "documents").select("doc_id", F.when(k < 8, "train").when(k == 8, "dev").otherwise("test").alias("split"))
    return corpus.manuscript_split(d, order="doc_id", gen_split="split")


@query("select o_custkey, o_orderkey, o_totalprice as cer from (select *, row_number() over (partition by o_custkey order by o_totalprice, o_orderkey) as i from orders) where i = 1")
def best_epochs(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").alias("epoch"), F.col("o_totalprice").alias("cer"))
    return metrics.best_epoch(o, "o_custkey").select("o_custkey", F.col("epoch").alias("o_orderkey"), "cer")


@query("select s_suppkey::bigint as run_idx, s_acctbal as cer, s_nationkey as lora_r from supplier order by s_acctbal, s_suppkey limit 1")
def best_run(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("bigint").alias("run_idx"), F.col("s_acctbal").alias("cer"), F.col("s_nationkey").alias("lora_r"))
    return metrics.best_run(s)


@query("select (i * 2 + j)::int as run_idx, lr, lora_r, lora_r * 2 as lora_alpha from (values (0, 0.00005::double), (1, 0.0001::double)) a(i, lr), (values (0, 8), (1, 16)) b(j, lora_r)")
def grid(spark, sf_dir):
    return corpus.grid(spark)


@query("select doc_id, case doc_id % 10 when 0 then 'In nomine Domini amen' when 1 then 'Anno domini millesimo' when 2 then 'Ego frater Johannes' when 3 then 'testimonium perhibeo' when 4 then 'sub sigillo capituli' when 5 then 'donavit terram suam' when 6 then 'in villa de Parisius' when 7 then 'pro precio centum solidorum' when 8 then 'Testes frater Martinus et Robertus' else 'Sigillum capituli appositum est' end as text from documents")
def mock_lines(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.mock_transcription(F.col("doc_id")).alias("text"))


@query("select conv_id, string_agg(text, ' ' order by turn) as full_text from conversations group by conv_id")
def full_texts(spark, sf_dir):
    from ..sources import writers

    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("document_id"), F.col("turn").alias("reading_order"), "text")
    return writers.full_text(c).select(F.col("document_id").cast("bigint").alias("conv_id"), "full_text")


@query("select page_id, replace(replace(url, '.html', ''), '.jpg', '') as name from pages")
def image_names(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.replace(text.without_image_suffix(F.col("url")), F.lit(".html"), F.lit("")).alias("name"))


# --- images -----------------------------------------------------------------------------

_LEVELS = "(select l_suppkey as page_id, (l_partkey % 256)::int as level, count(*)::double as n from lineitem group by 1, 2)"


@query(f"""with h as (select page_id, level, sum(n) over u as b, sum(n * level) over u as m, sum(n) over w as bt, sum(n * level) over w as mt from {_LEVELS} window u as (partition by page_id order by level), w as (partition by page_id))
select page_id, level as threshold from (select page_id, level, row_number() over (partition by page_id order by case when bt - b > 0 then b * (bt - b) * (m / b - (mt - m) / (bt - b)) ** 2 else 0 end desc, level) as i from h) where i = 1""")
def otsu_thresholds(spark, sf_dir):
    p = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("page_id"), (F.col("l_partkey") % 256).cast("int").alias("level")).agg(F.count("*").alias("n"))
    return image.otsu_thresholds(p)


def _rasters(spark, sf_dir, width: int | None = None) -> DataFrame:
    """A page for each supplier, of all its parts' keys as grey levels: one row, or rows of a width, the last filled up with white."""
    p = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").cast("string").alias("page_id")).agg(F.sort_array(F.collect_list(F.struct("l_orderkey", "l_linenumber", (F.col("l_partkey") % 256).cast("int").alias("v")))).alias("px"))
    levels = F.array_join(F.transform("px", lambda x: F.lpad(F.hex(x["v"]), 2, "0")), "")
    w = F.size("px") if width is None else F.lit(width)
    h = F.ceil(F.size("px") / w).cast("int")
    return p.select("page_id", h.alias("height"), w.alias("width"), F.unhex(F.rpad(levels, 2 * h * w, "F")).alias("pixels"))


@query("""select l_suppkey::varchar as page_id, 1::int as height, count(*)::int as width, round(avg(l_partkey % 256), 6) as mean, round(stddev_pop(l_partkey % 256), 6) as std, min(l_partkey % 256)::int as min, max(l_partkey % 256)::int as max, count(*)::double as ratio from lineitem group by 1""")
def image_statistics(spark, sf_dir):
    return image.statistics(_rasters(spark, sf_dir)).withColumns({"mean": F.round("mean", 6), "std": F.round("std", 6)})


@query()
def image_prepared(spark, sf_dir):
    made = image.mapped(_rasters(spark, sf_dir, 30), image.prepare, binarise=True, target=40)
    return made.select("page_id", "height", "width", F.sha2("pixels", 256).alias("sha256"))


# --- time -------------------------------------------------------------------------------


@query("""select time_bucket(interval 1 hour, ts) as window_start, count(*)::bigint as lines, count(*) filter (value < 0.8)::bigint as reviews from events group by 1""")
def review_rate_tumbling(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("needs_review", F.col("value") < 0.8)
    return review.review_rate(e).select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "lines", "reviews")


@query("""select time_bucket(interval 15 minute, ts) - k * interval 15 minute as window_start, count(*)::bigint as lines, count(*) filter (value < 0.8)::bigint as reviews from events, range(4) r(k) group by 1""")
def review_rate_sliding(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("needs_review", F.col("value") < 0.8)
    return review.review_rate(e, slide="15 minutes").select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "lines", "reviews")


@query("""select user_id, min(ts) as session_start, count(*)::bigint as lines, count(*) filter (value < 0.8)::bigint as reviews from (select *, sum(new) over (partition by user_id order by ts, event_id) as s from (select *, case when ts - lag(ts) over (partition by user_id order by ts, event_id) < interval 30 minute then 0 else 1 end as new from events)) group by user_id, s""")
def user_sessions(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("needs_review", F.col("value") < 0.8)
    out = review.review_rate(e, gap="30 minutes", by=("user_id",))
    return out.select("user_id", F.col("window_start").cast("timestamp_ntz").alias("session_start"), "lines", "reviews")


# --- flagship ---------------------------------------------------------------------------

_FIRST = f"(select doc_id, theme from {_THEMES} where place = 1)"


@query(f"select d.lang, n.language, coalesce(t.theme, 'none') as theme, count(*)::bigint as docs, sum(d.n_chars)::bigint as chars from documents d join ({_NLP.replace('from documents', 'from ' + _CHARTERS)}) n using (doc_id) left join {_FIRST} t using (doc_id) group by 1, 2, 3")
def language_and_theme(spark, sf_dir):
    d = _charters(spark, sf_dir)
    theme = F.coalesce(F.get(nlp.themes(F.col("text")), F.lit(0))["theme"], F.lit("none"))
    return d.select("lang", text.language(F.col("text")).alias("language"), theme.alias("theme"), "n_chars").groupBy("lang", "language", "theme").agg(F.count("*").alias("docs"), F.sum("n_chars").alias("chars"))
