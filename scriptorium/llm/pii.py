"""PII sanitisation guided by information theory; DataFrame functions only.

Base entities (mail and IP addresses, card and phone numbers) are found by patterns. Other
words of a document can give them away too: after Sanchez and Batet ("C-sanitized", 2016), a
term t discloses an entity e by the pointwise mutual information log2 p(t|e) / p(t), where
p(t) and p(t|e) are shares of all documents and of those that hold e. A term whose
information reaches a share of e's own, -log2 p(e), is sanitised wherever it stands in a
document that holds e. Base entities are generalised to their kind, such terms removed for
a general mark.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

# Kinds in their order, a quick test, and the pattern.
# Mail: a local part starts where its run of characters starts, or where the last match ended;
# card: a whole run of digits between single separators, of 12 to 19 digits.
KINDS = {
    "email": ("@", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    "ip": (r"[0-9]\.[0-9]", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    "card": (r"[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9]", r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){11,18}+(?![ -]?[0-9])"),
    "phone": (r"\+[0-9]", r"\+[0-9][ ().0-9-]+[0-9]"),
}
SPAN = "array<struct<start:int,ord:int,end:int,kind:string,value:string>>"

#: Documents with spans, and spans of all of them, that are broadcast at most.
BROADCAST_ROWS, BROADCAST_SPANS = 200_000, 1_000_000
#: Elements of an array that grow by appending, before the next block begins.
STEPS = 256
#: A term is a whole run of letters, of any length.
TERM = r"\p{L}+"
#: Different texts in which a term must stand with an entity: one alone has all its words there, whatever they are.
MIN_TEXTS = 2
#: Share of the entity's own information from which a term discloses it.
DISCLOSURE = 0.5


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(x: Column) -> Column:
    d = F.split(F.reverse(_digits(x)), "")
    values = F.transform(F.filter(d, lambda c: c != ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise((c.cast("int") * 2) % 10 + F.floor(c.cast("int") / 5).cast("int")))
    return F.aggregate(values, F.lit(0), lambda a, v: a + v) % 10 == 0


VALID = {
    "email": lambda m: F.lit(True),
    "ip": lambda m: F.forall(F.split(m, r"\."), lambda p: F.coalesce(p.try_cast("bigint") <= 255, F.lit(False))),
    "card": _luhn,
    "phone": lambda m: F.length(_digits(m)).between(9, 15),
}


def _bound(x: Column, use) -> Column:
    """use(x), with x evaluated once: inside a lambda an outer expression is made again for each element."""
    return F.get(F.transform(F.array(x), use), F.lit(0))


def running(sizes: Column) -> Column:
    """Sums of an array up to and with each element: in blocks, since an array that grows by one is copied each time."""
    last = lambda a: F.coalesce(F.get(a, F.size(a) - 1), F.lit(0))
    append = lambda a, x: F.concat(a, F.array(last(a) + x))
    none = F.array().cast("array<int>")
    parts = lambda s: F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size(s) / F.lit(STEPS)).cast("int"), F.lit(1)) - 1), lambda b: F.aggregate(F.slice(s, b * STEPS + 1, F.lit(STEPS)), none, append))
    before = lambda blocks: F.aggregate(blocks, F.array(F.lit(0)), lambda a, b: F.concat(a, F.array(F.element_at(a, -1) + last(b))))
    joined = lambda blocks: _bound(before(blocks), lambda base: F.flatten(F.transform(blocks, lambda b, i: F.transform(b, lambda x: x + F.get(base, i)))))
    return _bound(sizes, lambda s: _bound(parts(s), joined))


def located(text: Column, pattern: str, kind: str, order: int) -> Column:
    """All matches of a pattern with their code point offsets: what split leaves lies between them."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def spans(hits: Column) -> Column:
        gaps = F.transform(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(hits)), lambda g: F.length(g))
        ends = running(F.zip_with(gaps, hits, lambda g, h: g + F.length(h)))
        span = lambda end, h: F.struct((end - F.length(h)).alias("start"), F.lit(order).alias("ord"), end.alias("end"), F.lit(kind).alias("kind"), h.alias("value"))
        return F.zip_with(ends, hits, span).cast(SPAN)

    return _bound(found, lambda hits: F.when(F.size(hits) > 0, spans(hits)).otherwise(F.array().cast(SPAN)))


def _valid(spans: Column, test) -> Column:
    return F.filter(spans, lambda s: test(s["value"]))


def base_spans(text: Column) -> Column:
    """Valid entities of a text (null as empty), by start, then kind; not one overlaps another of its kind."""
    none = F.array().cast(SPAN)
    parts = []
    for i, (kind, (quick, pattern)) in enumerate(KINDS.items()):
        test = F.contains(text, F.lit(quick)) if kind == "email" else text.rlike(quick)
        parts.append(F.when(test, _valid(located(text, pattern, kind, i), VALID[kind])).otherwise(none))
    return F.coalesce(F.array_sort(F.concat(*parts)), none)


def _words(text: Column) -> Column:
    """Distinct terms of a text."""
    return F.array_distinct(F.transform(F.filter(F.split(text, r"[^\p{L}]+"), lambda w: w != ""), F.lower))


def found_entities(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, h, base, text) of each document row; h tells texts of the same id apart, text is null where there is no entity."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("h"), text.alias("text")).withColumn("base", base_spans(F.col("text")))
    return rows.select("id", "h", "base", F.when(F.size("base") > 0, F.col("text")).alias("text"))


def disclosing(docs: DataFrame, entities: DataFrame, text_col: str, *, min_texts: int, disclosure: float) -> tuple[DataFrame, DataFrame]:
    """(h, e, n, term): the terms of each text beside each entity e of it, n rows having that text; and (e, term, information, ratio) of those that disclose e."""
    total = float(entities.count())
    held = entities.filter("size(base) > 0")
    values = F.array_distinct(F.transform("base", lambda s: F.xxhash64(s["kind"], F.lower(s["value"]))))
    texts = held.groupBy("h").agg(F.count("*").alias("n"), F.first(values).alias("values"))
    of_text = texts.select("h", "n", F.explode("values").alias("e"))
    # an entity of fewer texts than a term needs has no terms
    of_entity = materialise(of_text.groupBy("e").agg(F.sum("n").alias("docs"), F.count("*").alias("texts")).filter(F.col("texts") >= min_texts).select("e", "docs"), "values")
    of_text = materialise(of_text.join(of_entity.select("e"), "e").groupBy("h").agg(F.first("n").alias("n"), F.collect_list("e").alias("values")), "texts")
    words = held.select("h", _words(F.col("text")).alias("terms")).join(of_text, "h").dropDuplicates(["h"])
    pairs = words.select("h", "n", F.explode("values").alias("e"), "terms").select("h", "n", "e", F.explode("terms").alias("term"))
    together = pairs.groupBy("e", "term").agg(F.sum("n").alias("together"), F.count("*").alias("texts")).filter(F.col("texts") >= min_texts).select("e", "term", "together")
    df = docs.select(F.explode(_words(F.coalesce(F.col(text_col), F.lit("")))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    known = together.join(of_entity, "e").join(df, "term")
    information = F.log2(F.col("together") / F.col("docs")) - F.log2(F.col("df") / F.lit(total))
    own = F.greatest(-F.log2(F.col("docs") / F.lit(total)), F.lit(1e-9))
    found = known.select("e", "term", information.alias("information"), (information / own).alias("ratio")).filter(F.col("ratio") >= disclosure)
    return pairs, materialise(found, "disclosing")


def term_spans(text: Column, base: Column, terms: Column) -> Column:
    """Spans of a text's words that are among the terms and not part of a base entity."""
    every = located(text, TERM, "term", len(KINDS))
    apart = lambda t: F.forall(base, lambda s: (s["end"] <= t["start"]) | (s["start"] >= t["end"]))
    lower = lambda t: F.lower(t["value"])
    named = F.filter(every, lambda t: F.array_contains(terms, lower(t)) & apart(t))
    return F.transform(named, lambda t: t.withField("value", lower(t))).cast(SPAN)


def sensitive_spans(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_texts: int = MIN_TEXTS, disclosure: float = DISCLOSURE) -> DataFrame:
    """(id, h, base, terms) of each document row: base spans, and spans of disclosing terms.

    h is xxhash64 of the text. A null text is an empty one and has no spans; rows that
    repeat an id are told apart by h. All counts are of document rows, but a term and an
    entity must meet in different texts, so exact copies disclose nothing by their number.
    """
    entities = materialise(found_entities(docs, id_col, text_col), "entities")
    pairs, flagged = disclosing(docs, entities, text_col, min_texts=min_texts, disclosure=disclosure)
    found = pairs.join(flagged.select("e", "term"), ["e", "term"]).groupBy("h").agg(F.collect_set("term").alias("found"))
    none = F.array().cast(SPAN)
    spans = F.when(F.col("found").isNotNull(), term_spans(F.col("text"), F.col("base"), F.col("found"))).otherwise(none)
    hits = entities.filter("size(base) > 0").join(found, "h", "left").select("id", "h", "base", spans.alias("terms"))
    return hits.unionByName(entities.filter("size(base) = 0").select("id", "h", "base", none.alias("terms")))


def joined(spans: Column) -> Column:
    """kind:start:end of all spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def sanitised(text: Column, spans: Column) -> Column:
    """The text with each span, overlapping ones as one, replaced by its kind in brackets.

    spans come by start. What follows a span up to the next that begins behind all ends so
    far is a piece of text; pieces are joined once.
    """

    def furthest(s: Column) -> Column:
        """The greatest end up to each span."""
        most = lambda a, x: F.concat(a, F.array(F.greatest(F.coalesce(F.get(a, F.size(a) - 1), F.lit(0)), x)))
        blocks = F.transform(F.sequence(F.lit(0), F.ceil(F.size(s) / F.lit(STEPS)).cast("int") - 1), lambda b: F.aggregate(F.transform(F.slice(s, b * STEPS + 1, F.lit(STEPS)), lambda x: x["end"]), F.array().cast("array<int>"), most))
        over = lambda bs: F.aggregate(bs, F.array(F.lit(0)), lambda a, b: F.concat(a, F.array(F.greatest(F.element_at(a, -1), F.element_at(b, -1)))))
        return _bound(blocks, lambda bs: _bound(over(bs), lambda base: F.flatten(F.transform(bs, lambda b, i: F.transform(b, lambda x: F.greatest(x, F.get(base, i)))))))

    def written(s: Column, ends: Column) -> Column:
        begin = lambda i: F.when(i > 0, F.get(ends, i - 1)).otherwise(0)
        piece = lambda x, i: F.when(x["start"] >= begin(i), F.concat(F.substring(text, begin(i) + 1, x["start"] - begin(i)), F.lit("["), F.upper(x["kind"]), F.lit("]"))).otherwise(F.lit(""))
        return F.concat(F.array_join(F.transform(s, piece), ""), F.substring(text, F.get(ends, F.size(ends) - 1) + 1, F.length(text)))

    return F.when(F.size(spans) > 0, _bound(spans, lambda s: _bound(furthest(s), lambda ends: written(s, ends)))).otherwise(text)


def sanitise(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents, all columns and rows kept, with their text sanitised.

    Where spans are few, they go to the documents; else both are shuffled.
    """
    plain = F.transform(F.array_sort(F.concat("base", "terms")), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    rows = sensitive_spans(docs, id_col=id_col, text_col=text_col, **options).select(F.col("id").alias("__id"), F.col("h").alias("__h"), plain.alias("__spans"))
    found = materialise(rows.filter("size(__spans) > 0").dropDuplicates(["__id", "__h"]), "spans")
    total = found.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("__spans")), F.lit(0)).alias("spans")).first()
    own = F.broadcast(found) if total.n <= BROADCAST_ROWS and total.spans <= BROADCAST_SPANS else found
    hashed = docs.withColumn("__hash", F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    joined = hashed.join(own, F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__hash") == F.col("__h")), "left")
    return joined.withColumn(text_col, F.when(F.col("__spans").isNotNull(), sanitised(F.col(text_col), F.col("__spans"))).otherwise(F.col(text_col))).select(*docs.columns)
