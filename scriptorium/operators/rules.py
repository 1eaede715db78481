"""The rules of entities and relations over one text, in plain Python.

A pattern is only tried where it can begin. Each needs certain words, so a text's words are
found once, and all patterns ask them where. Matches are those of the pattern's own finditer().
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator
from functools import cached_property

from ..functions import lexicons as lex
from ..functions.text import folded

# How near things are for a relation, and how much of the text around one is kept.
NEAR, NEAR_CONTEXT, PATTERN_CONTEXT = 80, 20, 30

_WORD, _DIGIT = re.compile(r"\w+"), re.compile(r"\d")


class Words:
    """A text's words, as re has them, in a form that leaves out case.

    Whatever a pattern asks of a word at its end or beginning it asks of joined, where each
    word has one blank on both sides.
    """

    def __init__(self, s: str):
        self.s = s
        found = _WORD.findall(s)
        line = folded(" ".join(found))
        self.words = line.split()
        if len(self.words) != len(found):
            self.words = [folded(w) for w in found]
        self.joined = f" {line} "
        self.known = [k for k, w in enumerate(self.words) if w in _KNOWN]
        self.present = {self.words[k] for k in self.known}

    @cached_property
    def starts(self) -> list[int]:
        return [m.start() for m in _WORD.finditer(self.s)]

    @cached_property
    def has_digit(self) -> bool:
        return _DIGIT.search(self.joined) is not None

    def where(self, words: frozenset) -> list[int]:
        """Places of the words among those that a pattern knows."""
        return [] if words.isdisjoint(self.present) else [k for k in self.known if self.words[k] in words]


class Whole:
    """A pattern that begins anywhere: tried if of each group of texts one is there."""

    def __init__(self, pattern: str, *needed: Iterable[str]):
        self.pattern, self.needed = re.compile(pattern, re.IGNORECASE), [tuple(folded(x) for x in g) for g in needed]

    def find(self, w: Words) -> Iterator[re.Match]:
        if all(any(x in w.joined for x in g) for g in self.needed):
            yield from self.pattern.finditer(w.s)


class Anchored:
    """A pattern that begins with one of these words; it may need another one."""

    def __init__(self, pattern: str, words: Iterable[str], needed: str = ""):
        self.pattern, self.words, self.needed = re.compile(pattern, re.IGNORECASE), frozenset(map(folded, words)), needed

    def find(self, w: Words) -> Iterator[re.Match]:
        if self.needed and self.needed not in w.present:
            return
        yield from _tried(self.pattern, w, w.where(self.words))


class Formed:
    """A pattern that begins with a word of this form (as regular expression over folded words)."""

    def __init__(self, pattern: str, form: str, digits: bool = True):
        self.pattern, self.form, self.digits = re.compile(pattern, re.IGNORECASE), re.compile(f" ({form})(?= )"), digits

    def find(self, w: Words) -> Iterator[re.Match]:
        if not self.digits or w.has_digit:
            if words := set(self.form.findall(w.joined)):
                yield from _tried(self.pattern, w, [k for k, x in enumerate(w.words) if x in words])


def _tried(pattern: re.Pattern, w: Words, places: list[int]) -> Iterator[re.Match]:
    s, end = w.s, 0
    for k in places:
        at = w.starts[k]
        if at >= end and (m := pattern.match(s, at)) and m.end() > at:
            yield m
            end = m.end()


class Formula:
    """PERSON_FORMULA: after a stop, at the text's beginning, or after a pronoun. Case counts."""

    _STOP, _PRONOUNS = re.compile(r"[.;,](?=\s+[A-Z][a-z])"), frozenset("ego nos moi nous".split())

    def __init__(self):
        self.pattern = re.compile(lex.PERSON_FORMULA)

    def find(self, w: Words) -> Iterator[re.Match]:
        s, end = w.s, 0
        places = [m.start() for m in self._STOP.finditer(s)]
        if said := w.where(self._PRONOUNS):
            places = sorted(places + [w.starts[k] for k in said])
        for at in [0, *places]:
            if at >= end and (m := self.pattern.match(s, at)):
                yield m
                end = m.end()


class Before:
    """A pattern whose first names, `most` words of them, stand before a verb.

    verbs: words, or with a star their beginnings. after: of these words one must follow.
    """

    def __init__(self, pattern: str, most: int, verbs: str, after: str = ""):
        self.pattern, self.most = re.compile(pattern, re.IGNORECASE), most
        found = [folded(v) for v in verbs.split()]
        self.words = frozenset(v for v in found if not v.endswith("*"))
        self.begun = tuple(v[:-1] for v in found if v.endswith("*"))
        self.after = frozenset(map(folded, after.split()))

    def find(self, w: Words) -> Iterator[re.Match]:
        verbs = w.where(self.words)
        if any(f" {v}" in w.joined for v in self.begun):
            verbs = sorted({*verbs, *(k for k, x in enumerate(w.words) if x.startswith(self.begun))})
        if verbs and self.after:
            last = max(w.where(self.after), default=-1)
            verbs = [k for k in verbs if k < last]
        at = 0
        for k in verbs:
            at, upto = max(at, w.starts[max(k - self.most, 0)]), w.starts[k]
            while at < upto:
                if m := self.pattern.match(w.s, at):
                    yield m
                    at = m.end()
                else:
                    at += 1


_AN = {"needed": "an"}
_PLACES = "in apud ad prope iuxta près à en".split()
_COINS = Formed(lex.COINS, r"\d\w*")


class EntityRules:
    """(rule, group, label, source, confidence, least length, stop words), tried in order, all matches kept."""

    dates = [
        *(Anchored(p, ["anno"]) for p in lex.DATES[:3]), Anchored(lex.DATES[3], ["mense"]), *(Anchored(p, ["die"]) for p in lex.DATES[4:6]), Anchored(lex.DATES[6], ["l"], **_AN), Anchored(lex.DATES[7], ["l", "en"], **_AN),
        Formed(lex.DATES[8], "1[0-9]{3}|20[0-9]{2}"), Formed(lex.DATES[9], "[mdclxvi]{3,}", digits=False),
    ]
    rules = [
        (Anchored(lex.PERSON_TITLED, lex.TITLES), 0, "PER", "rule", 0.85, 5, frozenset()),
        (Formula(), 1, "PER", "rule", 0.65, 4, lex.PERSON_STOP),
        (Anchored(lex.PLACE_PREFIXED, lex.TOPONYMS), 0, "LOC", "rule", 0.80, 6, frozenset()),
        (Anchored(lex.PLACE_AFTER, [*_PLACES, "vers"]), 1, "LOC", "rule", 0.75, 3, lex.PLACE_STOP),
        (_COINS, 0, "MONEY", "regex", 0.90, 0, frozenset()),
        (Anchored(lex.ORGANISATION, "monasterio monasterium ecclesia église abbaye couvent chapitre capitulum conuentus conventus universitas".split()), 0, "ORG", "rule", 0.80, 0, frozenset()),
    ]

    def __call__(self, s: str, words: Words | None = None) -> list[tuple]:
        out, w = [], words or Words(s)
        for p in self.dates:
            for m in p.find(w):
                if len(m[0].strip()) >= 3:
                    out.append((m[0].strip(), "DATE", m.start(), m.end(), "regex", 0.95))
        for p, g, label, source, confidence, least, stop in self.rules:
            for m in p.find(w):
                if len(m[g]) >= least and m[g].lower() not in stop:
                    out.append((m[g], label, m.start(g), m.end(g), source, confidence))
        return out


class RelationRules:
    """Rules in order: (predicate, rule, subject, object, least length, confidence); groups by number, fixed ends by name."""

    _VERBS, _TO = "donne donavit concessit tradidit assignavit legavit", "à ad in"
    rules = [
        ("donne_à", Before(lex.GIVES[0], 3, _VERBS, _TO), 1, 2, 3, 0.75),
        ("donne_à", Before(lex.GIVES[1], 1, "donne donavit", "à ad"), 1, 2, 3, 0.75),
        ("date_de", Whole(lex.DATED[0], ["datum ", "daté ", "donné ", "fait "], [" en ", " in ", " le ", " die "], [" anno ", " an ", " mense ", " die "]), "document", 1, 4, 0.85),
        ("lieu_de", Whole(lex.PLACED[0], ["actum ", "fait ", "faite ", "faites ", "datum "], [" à ", " in ", " apud ", " en "]), "document", 1, 3, 0.70),
        ("lieu_de", Anchored(lex.PLACED[1], _PLACES), "document", 1, 3, 0.70),
        ("signe", Whole(lex.SIGNED[0], ["ego ", "moi "], [" subscripsi", " signe", " recognovi"]), 1, "document", 3, 0.80),
        ("signe", Before(lex.SIGNED[1], 3, "a subscripsit* recognovit*"), 1, "document", 3, 0.80),
        ("témoin_de", Whole(lex.WITNESSED[0], ["testis", "témoin"]), 1, "document", 3, 0.75),
        ("témoin_de", Before(lex.WITNESSED[1], 3, "testis* témoin*"), 1, "document", 3, 0.75),
        ("montant", _COINS, "transaction", 0, 2, 0.90),
        ("montant", Formed(lex.PAID[1], r"[sd]\d*|m"), "transaction", 0, 2, 0.90),
    ]

    def __call__(self, s: str, words: Words | None = None) -> list[tuple]:
        out, w = [], words or Words(s)
        for name, p, a, b, least, confidence in self.rules:
            for m in p.find(w):
                ends = [m[x].strip() if isinstance(x, int) else x for x in (a, b)]
                if all(len(e) >= least for e, x in zip(ends, (a, b), strict=True) if isinstance(x, int)):
                    around = s[max(0, m.start() - PATTERN_CONTEXT) : min(len(s), m.end() + PATTERN_CONTEXT)].strip()
                    out.append((ends[0], name, ends[1], around, confidence))
        return out


def _known() -> frozenset:
    out = set(Formula._PRONOUNS)
    for p in [*EntityRules.dates, *(r[0] for r in EntityRules.rules), *(r[1] for r in RelationRules.rules)]:
        if isinstance(p, Anchored | Before):
            out |= p.words | getattr(p, "after", frozenset()) | {getattr(p, "needed", "")}
    return frozenset(out)


#: Words that some rule asks for.
_KNOWN = _known()


def _plain(x: str | None) -> str | None:
    return None if x is None else x.strip().lower()


def dedup_entities(found: list[tuple]) -> list[tuple]:
    """Of equal text, label and start the most confident, of equal ones the first; by start, then by first appearance."""
    best: dict = {}
    for e in found:
        key = (_plain(e[0]), e[1], e[2])
        if key not in best or e[5] > best[key][5]:
            best[key] = e  # which keeps the key's place
    return sorted(best.values(), key=lambda e: e[2])


def dedup_relations(found: list[tuple]) -> list[tuple]:
    """The first of equal subject, predicate and object; none with an empty end."""
    first: dict = {}
    for r in found:
        if r[0] and r[2]:
            first.setdefault((_plain(r[0]), r[1], _plain(r[2])), r)
    return list(first.values())


def proximity(s: str, entities: list[tuple]) -> list[tuple]:
    """Relations between a person and each date, then each place, that begin near in the same text; entities come by start."""
    out = []
    persons = [e for e in entities if e[1] == "PER"]
    for label, predicate, confidence in (("DATE", "date_associée", 0.55), ("LOC", "associé_à_lieu", 0.50)) if persons else ():
        others = [e for e in entities if e[1] == label]
        starts = [e[2] for e in others]
        for p in persons:
            for q in others[bisect_right(starts, p[2] - NEAR) : bisect_left(starts, p[2] + NEAR)]:
                if p[0] != q[0]:
                    around = s[max(min(p[2], q[2]) - NEAR_CONTEXT, 0) : min(max(p[3], q[3]) + NEAR_CONTEXT, len(s))].strip()
                    out.append((p[0], predicate, q[0], around, confidence))
    return out
