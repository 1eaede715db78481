"""Rules against their patterns' own finditer(), and how often and how long they run."""

import random
import re
import time

from pyspark.sql import functions as F

from scriptorium.functions import lexicons as lex
from scriptorium.operators import nlp
from scriptorium.plans import rule_queries

R = random.Random(3)
WORDS = [
    *lex.TITLES, *lex.TOPONYMS, *lex.CARDINALS[:9], *lex.MONTHS[:5], *lex.DAYS[:5], "anno", "domini", "millesimo", "mense", "die", "l'an", "l'an de grâce MCC", "en", "MCC", "mcxvi", "mix", "İV", "ıx", "1234", "2034", "12345", "12", "livres", "3livres", "s.", "d", "d12", "m̃r.", "ego", "moi", "nos", "in", "ad", "à", "près de", "apud", "vers",
    "donne", "donavit", "concessit", "legavit", "datum", "daté", "fait", "faites", "actum", "le", "testis", "témoin", "Témoin:", "xtestis", "subscripsit", "signe", "a signé", "recognovi", "ecclesia", "abbaye", "du", "d'", "Petrus", "Niger", "Jeané", "éPetrus", "X", "Ab", "ſit", "Kilo", "ͅego", "l'Abbé",
]


def plain(s):
    """All patterns tried everywhere."""
    entities = [(m[0].strip(), m.start(), m.end()) for p in lex.DATES for m in re.finditer(p, s, re.I) if len(m[0].strip()) >= 3]
    for p, g, least, stop, flag in [
        (lex.PERSON_TITLED, 0, 5, (), re.I), (lex.PERSON_FORMULA, 1, 4, lex.PERSON_STOP, 0), (lex.PLACE_PREFIXED, 0, 6, (), re.I),
        (lex.PLACE_AFTER, 1, 3, lex.PLACE_STOP, re.I), (lex.COINS, 0, 0, (), re.I), (lex.ORGANISATION, 0, 0, (), re.I),
    ]:
        entities += [(m[g], m.start(g), m.end(g)) for m in re.finditer(p, s, flag) if len(m[g]) >= least and m[g].lower() not in stop]
    relations = []
    for ps, groups, least in [(lex.GIVES, (1, 2), 3), (lex.DATED, (1,), 4), (lex.PLACED, (1,), 3), (lex.SIGNED, (1,), 3), (lex.WITNESSED, (1,), 3), (lex.PAID, (0,), 2)]:
        for m in (m for p in ps for m in re.finditer(p, s, re.I)):
            if all(len(m[g].strip()) >= least for g in groups):
                relations.append((*(m[g].strip() for g in groups), s[max(0, m.start() - 30) : m.end() + 30].strip()))
    return entities, relations


def found(s):
    e, r = nlp.EntityRules()(s), nlp.RelationRules()(s)
    return [(x[0], x[2], x[3]) for x in e], [(*(y for y in (x[0], x[2]) if y not in ("document", "transaction")), x[3]) for x in r]


def test_rules_find_what_their_patterns_find():
    for _ in range(400):
        s = "".join(R.choice((str, str.capitalize, str, str.upper))(w) + R.choice([" "] * 9 + [". ", ", ", "\n", "-", ""]) for w in R.choices(WORDS, k=R.randint(0, 40)))
        assert found(s) == plain(s), s


def test_patterns_are_tried_only_where_they_can_begin():
    s = " ".join(R.choices("the others were there with many words of their own, and then. Nothing else".split(), k=20_000))
    began = time.process_time()
    want = plain(s)
    between = time.process_time()
    assert found(s) == want
    assert time.process_time() - between < (between - began) / 3


def test_a_text_is_analysed_once(spark, tmp_path):
    spark.range(3).select(F.col("id").alias("o_orderkey"), F.col("id").alias("o_custkey")).write.parquet(f"{tmp_path}/orders.parquet")
    plan = rule_queries.analysed_relations(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    rows = spark.createDataFrame([(i, "anno domini MCC ego Petrus Niger", "x") for i in range(4)] + [(9, None, "x")], "document_id int, transcription string, t string")
    got = {r.document_id: (len(r.entities), len(r.relations), r.confidence) for r in nlp.analyse(rows).collect()}
    assert len({got[str(i)] for i in range(4)}) == 1 and got["0"][0] > 1 and got["9"] == (0, 0, 0.0)
