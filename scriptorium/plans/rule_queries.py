"""Registered queries of the text rules over lines put together from keys, with SQL that finds the same by RE2.

Each order is a document: a date, a person and a place or sum, chosen by its keys. The lines
are ASCII, where word borders of both engines agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import lexicons as lex
from ..functions import text
from ..operators import nlp
from .queries import _CHARTERS, _LANGUAGE, _THEMES, _list, _quoted, query, table

DATES = ["Anno domini millesimo ducentesimo", "anno domini MCCXX", "mense ianuarii die dominica", "written 1234", "XIV kalendas", "die lune", "sine data"]
PERSONS = [
    "frater Johannes Baptista donne librum ad Robertus Magnus", "ego Petrus Niger subscripsi", "episcopus Martinus", "testis: Guillelmus Albus", "datum in mense maii apud Romam",
    "domina Maria concessit villam in Parisius", "comes Hugo, comes Hugo", "Johannes a et Bernardus recognovit",
]
PLACES = ["in villa de Parisius", "apud Castrum Novum", "pro precio 12 solidi et 3 denarii", "ecclesia de Sancta", "monasterium Cluny", "prope Mons Albus.", "40 livres", "s. 12 et d 7", "coram dominus frater rex"]
SPELLINGS = ["Seruus  carta", "sieruos et testimonium", "a&b", "Tres dit DITE", "nostre\tseigneur ", " conuentus ecclesie", "sans rien"]

_TEXT = f"{_list(DATES)}[o_orderkey % {len(DATES)} + 1] || ' ' || {_list(PERSONS)}[o_custkey % {len(PERSONS)} + 1] || ' ' || {_list(PLACES)}[(o_orderkey * 7 + o_custkey) % {len(PLACES)} + 1]"
_DOCS = f"(select o_orderkey as doc_id, {_TEXT} as text from orders)"


def _pick(words: list[str], at) -> F.Column:
    return F.element_at(F.array(*(F.lit(w) for w in words)), (at % len(words) + 1).cast("int"))


def _lines(spark, sf_dir) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return table(spark, sf_dir, "orders").select(k.alias("doc_id"), F.concat_ws(" ", _pick(DATES, k), _pick(PERSONS, c), _pick(PLACES, k * 7 + c)).alias("text"))


def _found(rule: int, pattern: str, groups: tuple, insensitive: bool) -> str:
    """(doc_id, text, rule, k, m, first, last, a, b): matches of a pattern with their places, and two of its groups or fixed words."""
    p = _quoted(("(?i)" if insensitive else "") + pattern)
    group = lambda g: f"regexp_extract_all(text, {p}, {g})[k]" if isinstance(g, int) else _quoted(g)
    lengths = lambda x, upto: f"coalesce(list_sum(list_transform({x}[1:{upto}], lambda s: length(s))), 0)"
    return f"""select doc_id, text, {rule} as rule, k, m[k] as m, ({lengths('g', 'k')} + {lengths('m', 'k - 1')})::int as first, ({lengths('g', 'k')} + {lengths('m', 'k')})::int as last, {group(groups[0])} as a, {group(groups[1])} as b
from (select doc_id, text, regexp_extract_all(text, {p}) as m, string_split_regex(text, {p}) as g from {_DOCS}), unnest(range(1, len(m) + 1)) u(k)"""


def _entities() -> str:
    parts = []
    for i, p in enumerate(lex.DATES[:-1]):
        parts.append(f"select doc_id, trim(m) as text, 'DATE' as label, first as start, last as \"end\", 'regex' as source, 0.95 as confidence, rule, k from ({_found(i, p, (0, 0), True)}) where length(trim(m)) >= 3")
    # the last pattern of dates also matches nothing, so here words of its letters are tried as a whole
    roman = lex.DATES[-1].removeprefix(r"\b").removesuffix(r"\b")
    parts.append(f"select doc_id, m, 'DATE', first, last, 'regex', 0.95, rule, k from ({_found(len(lex.DATES) - 1, r'\b[MDCLXVI]{3,}\b', (0, 0), True)}) where regexp_full_match(m, {_quoted('(?i)' + roman)})")
    n = len(lex.DATES)
    plan = [
        (lex.PERSON_TITLED, 0, "PER", "rule", 0.85, 5, (), True), (lex.PERSON_FORMULA.replace("^|", ""), 1, "PER", "rule", 0.65, 4, lex.PERSON_STOP, False), (lex.PLACE_PREFIXED, 0, "LOC", "rule", 0.80, 6, (), True),
        (lex.PLACE_AFTER, 1, "LOC", "rule", 0.75, 3, lex.PLACE_STOP, True), (lex.COINS, 0, "MONEY", "regex", 0.90, 0, (), True), (lex.ORGANISATION, 0, "ORG", "rule", 0.80, 0, (), True),
    ]
    for i, (p, g, label, source, confidence, least, stop, insensitive) in enumerate(plan):
        stopped = f" and lower(a) not in ({', '.join(_quoted(w) for w in sorted(stop))})" if stop else ""
        # such a group ends its match
        parts.append(f"select doc_id, a, '{label}', last - length(a), last, '{source}', {confidence}, rule, k from ({_found(n + i, p, (g, g), insensitive)}) where length(a) >= {least}{stopped}")
    return " union all ".join(parts)


_ENTITIES = f"""(select doc_id, text, label, start::int as start, "end"::int as "end", source, confidence::double as confidence, row_number() over (partition by doc_id order by start, first_rule, first_k) as place from (select *, row_number() over w as n, min(rule) over v as first_rule, min(k) over v as first_k from ({_entities()})
window w as (partition by doc_id, lower(trim(text)), label, start order by confidence desc, rule, k), v as (partition by doc_id, lower(trim(text)), label, start)) where n = 1)"""


@query(f'select doc_id, text, label, start, "end", source, confidence from {_ENTITIES}')
def entities_lines(spark, sf_dir):
    return _lines(spark, sf_dir).select("doc_id", F.explode(nlp.entities("text")).alias("e")).select("doc_id", "e.*")


def _patterns() -> str:
    plan = [("donne_à", lex.GIVES, 1, 2, 3, 0.75), ("date_de", lex.DATED, "document", 1, 4, 0.85), ("lieu_de", lex.PLACED, "document", 1, 3, 0.70), ("signe", lex.SIGNED, 1, "document", 3, 0.80), ("témoin_de", lex.WITNESSED, 1, "document", 3, 0.75), ("montant", lex.PAID, "transaction", 0, 2, 0.90)]
    parts = []
    for name, patterns, a, b, least, confidence in plan:
        for p in patterns:
            long = " and ".join(f"length(trim({c})) >= {least}" for c, x in (("a", a), ("b", b)) if isinstance(x, int))
            around = "trim(substring(text, greatest(first - 30, 0) + 1, least(last + 30, length(text)) - greatest(first - 30, 0)))"
            parts.append(f"select doc_id, trim(a) as subject, '{name}' as predicate, trim(b) as object, {around} as sentence, {confidence}::double as confidence, rule, k from ({_found(len(parts), p, (a, b), True)}) where {long}")
    return " union all ".join(parts)


def _unique(rows: str) -> str:
    return f"(select doc_id, subject, predicate, object, sentence, confidence from (select *, row_number() over (partition by doc_id, lower(trim(subject)), predicate, lower(trim(object)) order by rule, k, k2) as n from (select * from ({rows}) where subject <> '' and object <> '')) where n = 1)"


@query(f"select * from {_unique(f'select *, 0 as k2 from ({_patterns()})')}")
def relations_lines(spark, sf_dir):
    return _lines(spark, sf_dir).select("doc_id", F.explode(nlp.relations("text")).alias("r")).select("doc_id", "r.*")


def _near(rule: int, label: str, predicate: str, confidence: float) -> str:
    return f"""select p.doc_id, p.text as subject, '{predicate}' as predicate, q.text as object, trim(substring(d.text, greatest(least(p.start, q.start) - 20, 0) + 1, least(greatest(p."end", q."end") + 20, length(d.text)) - greatest(least(p.start, q.start) - 20, 0))) as sentence, {confidence}::double as confidence, {rule} as rule, p.place as k, q.place as k2
from {_ENTITIES} p join {_ENTITIES} q on p.doc_id = q.doc_id and p.label = 'PER' and q.label = '{label}' and abs(p.start - q.start) < 80 and p.text <> q.text join {_DOCS} d on d.doc_id = p.doc_id"""


_RELATIONS = _unique(f"select *, 0 as k2 from ({_patterns()}) union all {_near(100, 'DATE', 'date_associée', 0.55)} union all {_near(101, 'LOC', 'associé_à_lieu', 0.50)}")
_LINE_LANGUAGE = f"(select doc_id, case when latin * 2 > french * 3 then 'latin' when french * 2 > latin * 3 then 'old_french' else 'mixed' end as language from ({_LANGUAGE.replace('from documents', 'from ' + _DOCS)}))"
_LINE_THEMES = _THEMES.replace(_CHARTERS, _DOCS)


def _analyses(spark, sf_dir) -> DataFrame:
    return nlp.analyse(_lines(spark, sf_dir), id_col="doc_id", text_col="text")


@query(f"select doc_id::varchar as document_id, subject, predicate, object, sentence, confidence from {_RELATIONS}")
def analysed_relations(spark, sf_dir):
    """Relations of whole analyses: those of patterns, and those of neighbours."""
    return _analyses(spark, sf_dir).select("document_id", F.explode("relations").alias("r")).select("document_id", "r.*")


@query(f"""select d.doc_id::varchar as document_id, language, coalesce(ne, 0)::int as num_entities, coalesce(nr, 0)::int as num_relations, coalesce(themes, '') as themes, round(coalesce(c, 0), 3)::double as confidence from {_DOCS} d join {_LINE_LANGUAGE} using (doc_id)
left join (select doc_id, count(*) as ne, list_reduce([0.0::double] || list(confidence order by place), lambda a, b: a + b) / count(*) as c from {_ENTITIES} group by 1) using (doc_id) left join (select doc_id, count(*) as nr from {_RELATIONS} group by 1) using (doc_id) left join (select doc_id, string_agg(theme, ' ' order by place) as themes from {_LINE_THEMES} group by 1) using (doc_id)""")
def analysed_lines(spark, sf_dir):
    found = nlp.document_summaries(_analyses(spark, sf_dir))
    return found.withColumns({"themes": F.array_join("themes", " "), "confidence": F.round("confidence", 3)})


@query(f"""select 'total' as kind, 'documents' as key, count(*)::bigint as n from {_DOCS} union all select 'total', 'entities', count(*)::bigint from {_ENTITIES} union all select 'total', 'relations', count(*)::bigint from {_RELATIONS}
union all select 'language', language, count(*)::bigint from {_LINE_LANGUAGE} group by 2 union all select 'entity', label, count(*)::bigint from {_ENTITIES} group by 2 union all select 'relation', predicate, count(*)::bigint from {_RELATIONS} group by 2 union all select 'theme', theme, count(*)::bigint from {_LINE_THEMES} group by 2""")
def report_lines(spark, sf_dir):
    return nlp.report(_analyses(spark, sf_dir))


def _normal(column: str) -> str:
    """Abbreviations of the lines' letters, spellings, white space: in this order, each list in its own."""
    out = column
    for k, v in [*lex.ABBREVIATIONS, *lex.VARIANTS]:
        if k.isascii():
            out = f"regexp_replace({out}, {_quoted(rf'(?i)\b{k}\b')}, {_quoted(v)}, 'g')"
    return f"trim(regexp_replace({out}, '\\s+', ' ', 'g'))"


@query(f"select doc_id, {_normal('text')} as normalized_text from (select doc_id, {_list(SPELLINGS)}[doc_id % {len(SPELLINGS)} + 1] || ' ' || text as text from {_DOCS})")
def normalized_lines(spark, sf_dir):
    d = _lines(spark, sf_dir)
    return d.select("doc_id", text.normalise(F.concat_ws(" ", _pick(SPELLINGS, F.col("doc_id")), "text")).alias("normalized_text"))
