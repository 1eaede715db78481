"""Entities, relations, themes and topics of transcriptions.

Rules that need Python's regular expressions and code point offsets run in one Arrow UDF a
document, with deduplication and proximity; themes, scores and reports are Columns and joins.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import lexicons as lex
from ..functions import text
from ..functions.text import NORMALISER
from . import rules as rules_of
from .rules import EntityRules, RelationRules, Words


def _rows(**fields) -> T.ArrayType:
    return T.ArrayType(T.StructType([T.StructField(k, v) for k, v in fields.items()]))


_TEXT, _INT, _REAL = T.StringType(), T.IntegerType(), T.DoubleType()
ENTITY = _rows(text=_TEXT, label=_TEXT, start=_INT, end=_INT, source=_TEXT, confidence=_REAL)
RELATION = _rows(subject=_TEXT, predicate=_TEXT, object=_TEXT, sentence=_TEXT, confidence=_REAL)

THEME_FLOOR, OPENING_BONUS, OPENING_LETTERS = 0.15, 2.0, 200  # fixed values
NEAR = rules_of.NEAR
# what workers run: single objects, since a module would be sent as a whole
_unique_entities, _unique_relations, _near = rules_of.dedup_entities, rules_of.dedup_relations, rules_of.proximity


def _tuples(rows: list | None) -> list[tuple] | None:
    return None if rows is None else [tuple(r.values()) for r in rows]


def _column(lists: list[list[tuple] | None], kind: T.ArrayType) -> pa.Array:
    """Lists of rows as Arrow has them, field by field."""
    whole = to_arrow_type(kind)
    fields = list(whole.value_type)
    rows = [r for x in lists if x for r in x]
    columns = list(zip(*rows)) or [()] * len(fields)
    values = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields, strict=True)], fields=fields)
    ends = np.cumsum([0, *(len(x) if x else 0 for x in lists)], dtype=np.int32)
    gone = [x is None for x in lists]
    return pa.ListArray.from_arrays(pa.array(ends), values, type=whole, mask=pa.array(gone) if any(gone) else None)


def _found(s: str | None, entities: bool = True, relations: bool = True) -> tuple[list, list]:
    """Entities and relations of a text by the rules, as they are found."""
    w = Words(s) if s else None
    return EntityRules()(s, w) if s and entities else [], RelationRules()(s, w) if s and relations else []


def _each(use, texts: pa.Array) -> list:
    """use of each text of a batch; short lines often are the same, and then it is made once."""
    made: dict = {}
    return [made[s] if s in made else made.setdefault(s, use(s)) for s in texts.to_pylist()]


@F.arrow_udf(ENTITY)
def extract_entities(x: pa.Array) -> pa.Array:
    """All entities that the rules find, repeated ones too."""
    return _column(_each(lambda s: _found(s, relations=False)[0], x), ENTITY)


@F.arrow_udf(RELATION)
def extract_relations(x: pa.Array) -> pa.Array:
    """All relations that the patterns find, repeated ones too."""
    return _column(_each(lambda s: _found(s, entities=False)[1], x), RELATION)


@F.arrow_udf(ENTITY)
def dedup_entities(x: pa.Array) -> pa.Array:
    """Of equal text, label and start the most confident, of equal ones the first; by start, then by first appearance."""
    return _column([None if e is None else _unique_entities(_tuples(e)) for e in x.to_pylist()], ENTITY)


@F.arrow_udf(ENTITY)
def entities(x: pa.Array) -> pa.Array:
    """dedup_entities(extract_entities(x)) in one."""
    return _column(_each(lambda s: _unique_entities(_found(s, relations=False)[0]), x), ENTITY)


@F.arrow_udf(RELATION)
def relations(x: pa.Array) -> pa.Array:
    """dedup_relations(extract_relations(x)) in one."""
    return _column(_each(lambda s: _unique_relations(_found(s, entities=False)[1]), x), RELATION)


def dedup_entity_rows(entities: DataFrame, doc: str = "document_id") -> DataFrame:
    """The same over rows (document_id, ord, text, label, start, ...); adds rank, the place in the document."""
    key = [doc, F.lower(text.strip(F.col("text"))), "label", "start"]
    w = Window.partitionBy(*key)
    best = entities.withColumns({"__n": F.row_number().over(w.orderBy(F.desc("confidence"), "ord")), "__first": F.min("ord").over(w)}).filter("__n = 1")
    return best.withColumn("rank", F.row_number().over(Window.partitionBy(doc).orderBy("start", "__first"))).drop("__n", "__first")


@F.arrow_udf(RELATION)
def dedup_relations(x: pa.Array) -> pa.Array:
    """The first of equal subject, predicate and object; none with an empty end."""
    return _column([None if r is None else _unique_relations(_tuples(r)) for r in x.to_pylist()], RELATION)


def dedup_relation_rows(relations: DataFrame, doc: str = "document_id") -> DataFrame:
    w = Window.partitionBy(doc, F.lower(text.strip(F.col("subject"))), "predicate", F.lower(text.strip(F.col("object")))).orderBy("ord")
    return relations.filter("subject <> '' and object <> ''").withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


@F.arrow_udf(RELATION)
def proximity(s: pa.Array, e: pa.Array) -> pa.Array:
    """Relations between a person and each date, then each place, that begin near in the same text; e comes by start."""
    return _column([_near(x or "", _tuples(y) or []) for x, y in zip(s.to_pylist(), e.to_pylist(), strict=True)], RELATION)


def proximity_rows(entities: DataFrame, *, doc: str = "document_id", person: str = "PER", others: tuple = ("DATE", "LOC"), near: int = NEAR) -> DataFrame:
    """(document, p_ord, q_ord, subject, object, label) of entity rows: a band join.

    Starts are binned by the band's width; each other entity also goes into both
    neighbouring bins, so the join is by equality, and a document of very many entities
    spreads over its bins.
    """
    at = F.floor(F.col("start") / near)
    p = entities.filter(F.col("label") == person).select(doc, at.alias("bin"), F.col("ord").alias("p_ord"), F.col("text").alias("subject"), F.col("start").alias("ps"))
    q = entities.filter(F.col("label").isin(*others)).select(doc, F.explode(F.array(at - 1, at, at + 1)).alias("bin"), F.col("ord").alias("q_ord"), F.col("text").alias("object"), "label", F.col("start").alias("qs"))
    return p.join(q, [doc, "bin"]).filter((F.abs(F.col("ps") - F.col("qs")) < near) & (F.col("subject") != F.col("object"))).select(doc, "p_ord", "q_ord", "subject", "object", "label")


def _theme_counts(words: Column) -> Column:
    """For each theme by its place, how many of its keywords are among the words (twice-named ones once)."""
    return F.array(*(F.size(F.array_intersect(words, F.array(*(F.lit(k) for k in keys)))) for keys in lex.THEMES.values()))


def theme_matches(x: Column) -> dict[str, Column]:
    """For each theme, how many of its keywords a text's words have."""
    found = text.once(text.word_set(F.coalesce(x, F.lit(""))), _theme_counts)
    return {theme: F.get(found, F.lit(i)) for i, theme in enumerate(lex.THEMES)}


def _opening_counts(x: Column) -> Column:
    """For each theme by its place, how many of its formulas the first letters have."""
    # lower-casing never makes a text shorter, so twice the letters have what counts, and none of them ends at the cut
    head = F.substring(F.lower(F.substring(F.coalesce(x, F.lit("")), F.lit(1), F.lit(2 * OPENING_LETTERS))), F.lit(1), F.lit(OPENING_LETTERS))
    count = lambda h, formulas: sum((F.contains(h, F.lit(f)).cast("int") for f in formulas), F.lit(0))
    return text.once(head, lambda h: F.array(*(count(h, lex.OPENINGS.get(theme, [])) for theme in lex.THEMES)))


def opening_matches(x: Column) -> dict[str, Column]:
    found = _opening_counts(x)
    return {theme: F.get(found, F.lit(i)) for i, theme in enumerate(lex.THEMES) if theme in lex.OPENINGS}


def themes(x: Column) -> Column:
    """[(theme, score)], best first, in the themes' order where they tie: scores over the greatest, above the floor, to 3 places."""
    counts = F.struct(text.once(text.word_set(F.coalesce(x, F.lit(""))), _theme_counts).alias("found"), _opening_counts(x).alias("opened"))

    def raw(n: Column) -> Column:
        rows = []
        for i, (theme, keys) in enumerate(lex.THEMES.items()):
            found = F.get(n["found"], F.lit(i))
            score = found / F.lit(max(len(keys) * 0.1, 1.0)) + F.get(n["opened"], F.lit(i)) * F.lit(OPENING_BONUS)
            # a theme met by its opening alone comes after those met by keywords
            rows.append(F.struct(F.lit(theme).alias("theme"), score.alias("score"), F.when(found > 0, 0).otherwise(1).alias("late"), F.lit(i).alias("ord")))
        return F.filter(F.array(*rows), lambda r: r["score"] > 0)

    def ranked(every: Column) -> Column:
        share = lambda top: F.transform(every, lambda r: F.struct((-F.least(r["score"] / top, F.lit(1.0))).alias("s"), r["late"].alias("late"), r["ord"].alias("ord"), r["theme"].alias("theme")))
        shares = text.once(F.array_max(F.transform(every, lambda r: r["score"])), share)
        kept = F.filter(F.array_sort(shares), lambda r: -r["s"] > THEME_FLOOR)
        return F.transform(kept, lambda r: F.struct(r["theme"].alias("theme"), F.round(-r["s"], 3).alias("score")))

    return text.once(text.once(counts, raw), ranked)


_ANALYSIS = T.StructType([T.StructField("normalized_text", T.StringType()), T.StructField("entities", ENTITY), T.StructField("relations", RELATION)])


def _analysed(normal: bool, rules: bool):
    """UDF of a text and of entities and relations from elsewhere, or nulls: its normal form, all entities, all relations."""

    def one(s: str | None, more_entities: list, more_relations: list) -> tuple:
        t = NORMALISER(s) if normal else s or ""
        e, r = _found(t, entities=rules)
        e = _unique_entities(e + more_entities)
        return t, e, _unique_relations(r + more_relations + _near(t, e))

    @F.arrow_udf(_ANALYSIS)
    def run(x: pa.Array, tagged: pa.Array, parsed: pa.Array) -> pa.Array:
        if tagged.null_count == parsed.null_count == len(x):
            made = _each(lambda s: one(s, [], []), x)
        else:
            made = [one(s, _tuples(e) or [], _tuples(r) or []) for s, e, r in zip(x.to_pylist(), tagged.to_pylist(), parsed.to_pylist(), strict=True)]
        texts, entities, relations = zip(*made) if made else ((), (), ())
        return pa.StructArray.from_arrays([pa.array(texts, pa.string()), _column(entities, ENTITY), _column(relations, RELATION)], fields=list(to_arrow_type(_ANALYSIS)))

    return run.asNondeterministic()  # or a filter on what is found, as explode() brings its own, is moved below and finds all again


def analyse(docs: DataFrame, *, id_col: str = "document_id", text_col: str = "transcription", taggers: list | None = None, rules: bool = True, parser=None) -> DataFrame:
    """One analysis a document: language of the text as it is; entities, relations and themes of its normal form.

    taggers add entities, parser relations: pandas UDFs from text to ENTITY and RELATION. Without them a text goes to Python once.
    """
    taken = docs.select(F.col(id_col).cast("string").alias("document_id"), F.col(text_col).alias("transcription")).withColumn("language", text.language(F.col("transcription")))
    tagged, parsed = F.lit(None).cast(ENTITY), F.lit(None).cast(RELATION)
    alone = not taggers and not parser
    source = F.col("transcription")
    if not alone:
        taken, source = taken.withColumn("__normal", text.normalise("transcription")), F.col("__normal")
        tagged = F.concat(*(t("__normal") for t in taggers)).cast(ENTITY) if taggers else tagged
        parsed = parser("__normal") if parser else parsed
        taken = taken.withColumns({"__tagged": tagged, "__parsed": parsed})
        tagged, parsed = F.col("__tagged"), F.col("__parsed")
    taken = taken.withColumn("__found", _analysed(alone, rules)(source, tagged, parsed)).select("document_id", "transcription", "language", "__found.*")
    mean = F.aggregate("entities", F.lit(0.0), lambda a, e: a + e["confidence"]) / F.size("entities")
    order = ["document_id", "transcription", "language", "normalized_text", "entities", "relations", "themes", "confidence"]
    return taken.withColumns({"themes": F.transform(themes(F.col("normalized_text")), lambda t: t["theme"]), "confidence": F.when(F.size("entities") > 0, F.round(mean, 3)).otherwise(0.0)}).select(*order)


def report(analyses: DataFrame) -> DataFrame:
    """(kind, key, n) over a corpus: totals, and distributions of entities, relations, themes and languages, in one pass."""
    one = lambda kind, key: F.struct(F.lit(kind).alias("kind"), key.alias("key"), F.lit(1).cast("bigint").alias("n"))
    total = lambda key, n: F.struct(F.lit("total").alias("kind"), F.lit(key).alias("key"), n.cast("bigint").alias("n"))
    rows = F.concat(
        F.array(total("documents", F.lit(1)), total("entities", F.size("entities")), total("relations", F.size("relations")), one("language", F.col("language"))),
        F.transform("entities", lambda e: one("entity", e["label"])),
        F.transform("relations", lambda r: one("relation", r["predicate"])),
        F.transform("themes", lambda t: one("theme", t)),
    )
    return analyses.select(F.explode(rows).alias("r")).groupBy("r.kind", "r.key").agg(F.sum("r.n").alias("n"))


def report_document(analyses: DataFrame) -> DataFrame:
    """The report as one nested row: statistics and four distributions as maps."""
    r = report(analyses)
    maps = [F.map_from_entries(F.sort_array(F.collect_list(F.when(F.col("kind") == k, F.struct("key", "n"))))).alias(f"{k}_distribution") for k in ("entity", "relation", "theme", "language")]
    total = lambda k: F.coalesce(F.sum(F.when((F.col("kind") == "total") & (F.col("key") == k), F.col("n"))), F.lit(0))
    mean = lambda k: F.when(total("documents") > 0, F.round(total(k) / total("documents"), 2)).otherwise(0.0)
    stats = F.struct(total("documents").alias("total_documents"), total("entities").alias("total_entities"), total("relations").alias("total_relations"), mean("entities").alias("avg_entities_per_doc"), mean("relations").alias("avg_relations_per_doc"))
    return r.agg(stats.alias("corpus_stats"), *maps)


def document_summaries(analyses: DataFrame) -> DataFrame:
    return analyses.select("document_id", "language", F.size("entities").alias("num_entities"), F.size("relations").alias("num_relations"), "themes", "confidence")


def topics(docs: DataFrame, *, text_col: str = "transcription", n_topics: int = 5, words: int = 10, vocabulary: int = 1000, passes: int = 10, seed: int = 42) -> DataFrame:
    """(topic, words, weights): topics by variational LDA over words of two documents at least and 95 % at most.

    Each of the passes reads every document once. The ML estimator cannot do that: it draws
    its batches with replacement, so a rate of 1 too leaves out a third of the documents in a
    pass. Its optimizer in the JVM is therefore set up directly.
    """
    from pyspark.ml.feature import CountVectorizerModel, StopWordsRemover

    split = docs.select(F.filter(F.split(F.lower(F.coalesce(text_col, F.lit(""))), r"[^\p{L}\p{N}_]+"), lambda w: F.length(w) >= 2).alias("all_words"))
    clean = StopWordsRemover(inputCol="all_words", outputCol="words", stopWords=StopWordsRemover.loadDefaultStopWords("french")).transform(split)
    # CountVectorizer's own fit keeps every word of every document as an object; sums by word are all it needs
    word, first = F.explode("words").alias("word"), F.explode(F.array_distinct("words")).alias("word")
    total = clean.select(word).groupBy("word").agg(F.count("*").alias("n"))
    spread = clean.select(first).groupBy("word").agg(F.count("*").alias("docs")).filter((F.col("docs") >= 2) & (F.col("docs") <= 0.95 * docs.count()))
    known = [r["word"] for r in total.join(spread, "word").orderBy(F.desc("n"), "word").limit(vocabulary).collect()]
    counted = CountVectorizerModel.from_vocabulary(known, inputCol="words", outputCol="features")
    names = F.array(*(F.lit(w) for w in counted.vocabulary))
    spark = docs.sparkSession
    vectors = counted.transform(clean).select("features").persist()
    jvm = spark._jvm
    clustering = jvm.org.apache.spark.mllib.clustering
    rows = jvm.java.lang.Class.forName("org.apache.spark.ml.clustering.LDA$").getField("MODULE$").get(None).getOldDataset(vectors._jdf, "features")
    every = clustering.OnlineLDAOptimizer().setMiniBatchFraction(1.0).setSampleWithReplacement(False).setOptimizeDocConcentration(True)
    model = clustering.LDA().setK(max(2, n_topics)).setMaxIterations(passes).setSeed(seed).setOptimizer(every).run(rows)
    found = [(k, list(t._1()), list(t._2())) for k, t in enumerate(model.describeTopics(words))]
    vectors.unpersist()
    topic = spark.createDataFrame(found, "topic int, termIndices array<int>, weights array<double>")
    return topic.select("topic", F.transform("termIndices", lambda i: F.element_at(names, i + 1)).alias("words"), "weights")
