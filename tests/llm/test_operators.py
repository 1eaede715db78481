"""Operators of the llm subpackage against brute force, and on awkward inputs."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from scriptorium.llm import common, decontaminate, embed_dedup, hmm, html, langid, minhash, pii, quality, sentencepiece, token_counts

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, id string, body string, h bigint"


def docs(spark, texts, lang="en", source="s"):
    """Documents with columns whose names clash with those used inside."""
    return spark.createDataFrame([(i, t, lang, source, 0, "x", "y", 7) for i, t in enumerate(texts)], DOCS)


AWKWARD = [None, "", " \n\t ", "!!! ???", "word", "word", "A" * 20_000, "der Hund und die Katze " * 3000]


# --- shared -----------------------------------------------------------------------------


def test_components_follow_chains_and_keep_singles(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 102), (102, 101), (7, 7)]
    found = common.connected_components(spark.createDataFrame([(i,) for i in [*range(41), 100, 101, 102, 500]], "id bigint"), spark.createDataFrame(chain, "a bigint, b bigint"))
    got = {r.id: r.component for r in found.collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100, 500: 500}
    none = common.connected_components(spark.createDataFrame([(3,)], "id bigint"), spark.createDataFrame([], "a bigint, b bigint"))
    assert [tuple(r) for r in none.collect()] == [(3, 3)]


def test_slices_by_bytes_hold_every_row_once():
    import pyarrow as pa

    texts = ["a" * 5, None, "", "b" * 50, "cd", "e" * 9, "f"]
    batch = pa.record_batch([pa.array(range(len(texts))), pa.array(texts)], ["id", "body"])
    for part in (batch, batch.slice(2, 4), batch.slice(0, 0)):
        for size in (1, 10, 1000):
            got = [x.to_pydict() for x in common.pieces_of(part, 1, size)]
            assert [i for x in got for i in x["id"]] == part.column(0).to_pylist()
            assert all(sum(len(t or "") for t in x["body"]) <= size or sum(bool(t) for t in x["body"]) == 1 for x in got)


# --- 1, 2: pieces -----------------------------------------------------------------------

ALPHABET = [*" ▁aeinrst.,_²\n\t!0123日é🙂ж<>&", "  ", "the", "ing", "tion"]


def random_texts(n, seed=1, most=60):
    r = random.Random(seed)
    return ["".join(r.choice(ALPHABET) for _ in range(r.randint(0, most))) for _ in range(n)]


def library():
    import sentencepiece as sp

    return sp.SentencePieceProcessor(model_file=sentencepiece.MODEL)


def test_encoding_equals_the_library_and_decodes_again(spark):
    texts = [*random_texts(400), " " * 41 + "x", "a" * 500, "ab" * 300, *AWKWARD]
    model, lib = sentencepiece.Model(), library()
    back = sentencepiece.decode(sentencepiece.encode(docs(spark, texts), model), model)
    got = {r.id: r for r in back.collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        assert got[i].ids == lib.encode(t or ""), t
        if "▁" not in (t or ""):
            assert got[i].text == (t or "")


def test_words_beyond_the_table_are_encoded_too(spark):
    texts = random_texts(100, 2)
    model, lib = sentencepiece.Model(), library()
    got = {r.id: r.ids for r in sentencepiece.encode(docs(spark, texts), model, table_words=5).collect()}
    assert got == {i: lib.encode(t) for i, t in enumerate(texts)}


UNIGRAM = [("<unk>", 0.0), ("▁", -2.0), ("a", -3.0), ("b", -3.5), ("ab", -4.0), ("▁a", -3.2), ("bab", -5.0), ("aba", -5.5), ("▁ab", -4.9), ("c", -1.0)]


def test_words_beyond_the_table_share_one_fold(monkeypatch):
    r, model = random.Random(7), sentencepiece.Model()
    words = {w for t in random_texts(600, 8) for w in model.split(t)} | {"▁" * k for k in range(1, 60)} | {"▁" + "a" * k for k in range(60)}
    words |= {"▁" + "".join(r.choice("abcdeinrst") for _ in range(r.randint(1, 12))) for _ in range(9000)} | {"\U0010ffff", "▁\U0010ffffa"}
    alone = {w: model.encode_word(w) for w in words}
    fold, by_itself = sentencepiece.WordFold(model), []
    monkeypatch.setattr(model, "encode_word", lambda w: by_itself.append(w) or alone[w])
    row, starts, ids = fold.encode(list(words))
    assert len(starts) == len(words) + 1 and starts[-1] == len(ids)
    assert {w: ids[starts[k] : starts[k + 1]].tolist() for w, k in row.items()} == alone
    assert set(by_itself) == {w for w in words if len(w) > sentencepiece.LATTICE_LETTERS}
    row, starts, ids = fold.encode([])
    assert (row, starts.tolist(), len(ids)) == ({}, [0], 0)


def test_fold_of_models_without_bytes_and_of_unigram_models():
    pieces = [("<unk>", 0.0), ("▁", -7.0), ("a", -8.0), ("b", -9.0), ("ab", -1.0), ("▁a", -2.0), ("bab", -4.0), ("aba", -3.0), ("▁ab", -5.0)]
    for model in (sentencepiece.Model.of(pieces, sentencepiece.BPE), sentencepiece.Model.of(UNIGRAM)):
        words = ["▁" + "".join(w) for n in range(6) for w in itertools.product("abx", repeat=n)] + ["▁" + "ab" * 60]
        row, starts, ids = sentencepiece.WordFold(model).encode(words)
        assert all(ids[starts[row[w]] : starts[row[w] + 1]].tolist() == model.encode_word(w) for w in words)


def test_many_ids_are_spelt_without_a_step_for_each():
    import time

    import pyarrow as pa

    model = sentencepiece.Model()
    spell, lists = pa.array(model.spell, pa.binary()), [[130, 200, 500], None, [], [500], list(range(len(model.spell)))]

    def plain(x):
        s = b"".join([model.spell[k] for k in x]).decode("utf-8", "replace")
        return s[1:] if s.startswith(" ") else s

    ids = pa.array(lists, pa.list_(pa.int32()))
    want = [None if x is None else plain(x) for x in lists]
    assert sentencepiece.spelt(ids, spell, True).to_pylist() == want
    assert sentencepiece.spelt(ids.slice(1, 3), spell, True).to_pylist() == want[1:4]
    many = [[300 + k % 30_000 for k in range(i, i + 1000)] for i in range(400)]
    ids = pa.array(many, pa.list_(pa.int32()))
    at = [time.process_time()]
    got = sentencepiece.spelt(ids, spell, True)
    at.append(time.process_time())
    assert got.to_pylist() == [plain(x) for x in many]
    at.append(time.process_time())
    assert at[1] - at[0] < 3 * (at[2] - at[1])  # each id as a Python object of its own cost more than ten times as much


def brute_viterbi(model, word):
    """All segmentations; the best score."""
    low = min(model.score) - sentencepiece.UNKNOWN_PENALTY
    best = (-math.inf, None)
    for mask in range(1 << (len(word) - 1)):
        cuts = [0, *(i + 1 for i in range(len(word) - 1) if mask >> i & 1), len(word)]
        parts = [word[a:b] for a, b in zip(cuts, cuts[1:])]
        if all(p in model.pieces or len(p) == 1 for p in parts):
            score = sum(model.score[model.pieces[p]] if p in model.pieces else low for p in parts)
            best = max(best, (score, parts), key=lambda x: x[0])
    return best


def score_of(model, ids):
    low = min(model.score) - sentencepiece.UNKNOWN_PENALTY
    return sum(low if i == model.unknown else model.score[i] for i in ids)


def test_unigram_models_take_the_viterbi_fold(spark):
    model = sentencepiece.Model.of(UNIGRAM)
    r = random.Random(3)
    words = sorted({"▁" + "".join(r.choice("abcx") for _ in range(r.randint(0, 8))) for _ in range(80)})
    got = sentencepiece.encode_words(spark.createDataFrame([(w,) for w in words], "word string"), model).collect()
    assert {g.word for g in got} == set(words)
    for g in got:
        assert score_of(model, g.ids) == pytest.approx(brute_viterbi(model, g.word)[0]), g.word
        assert score_of(model, model.encode_word(g.word)) == pytest.approx(score_of(model, g.ids))
        trie = token_counts.Trie(model)
        trie.count(g.word)
        assert trie.states[-1][2] == pytest.approx(score_of(model, g.ids))


def test_token_counts_equal_the_library(spark):
    texts = [*random_texts(300, 5), *AWKWARD]
    model, lib = sentencepiece.Model(), library()
    want = {i: len(lib.encode(t or "")) for i, t in enumerate(texts)}
    for limit in (4_000_000, 3):
        got = {r.id: r.n_tokens for r in token_counts.token_counts(docs(spark, texts), model, table_words=limit).collect()}
        assert got == want


def test_trie_computes_shared_prefixes_once():
    trie = token_counts.Trie(sentencepiece.Model())
    for w in sorted(["▁inter", "▁internal", "▁internals", "▁interval"]):
        trie.count(w)
    assert trie.visited == len("▁internals") + len("val")


# --- 3: pages ---------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body>
<header><h2>Site</h2></header><nav><ul><li><a href=/>Home</a></li></ul></nav><div class="cookie-notice">We use cookies</div>
<div id="main-sidebar"><p>Side</p></div><!-- note --><article class="post"><h1>Title &amp; more</h1><p><b>First   line<br>goes
on</b><p>Second &eacute; <i>para</i>graph.</p><div class="ad">Buy</div><p>Z.</p><form><input value=1>Mail</form><aside>See also</aside></article>
<section class="comments"><p>Nice!</p></section><footer>&copy; 2020</footer></body></html>"""


def test_article_without_boilerplate():
    assert html.main_text(PAGE) == "Title & more\n\nFirst line goes on\n\nSecond é paragraph.\n\nZ."


def test_pages_without_an_article_element():
    body = "".join(f"<p>Paragraph {i} has a good many words in it, as texts do, and ends here.</p>" for i in range(5))
    links = "".join(f"<li><a href=/{i}>Link {i}</a></li>" for i in range(20))
    assert html.main_text(f"<body><div><ul>{links}</ul></div><div><h1>Head</h1>{body}</div><div><ul>{links}</ul></div></body>").split("\n\n")[0] == "Head"
    assert html.main_text(f"<body><div><ul>{links}</ul></div><div><h1>Head</h1>{body}</div></body>").count("Paragraph") == 5


def test_class_names_are_a_sign_and_no_more():
    body = "".join(f"<p>Paragraph {i} has a good many words in it, as texts do, and ends here.</p>" for i in range(4))
    text = [f"Paragraph {i} has a good many words in it, as texts do, and ends here." for i in range(4)]
    assert html.main_text(f"<body><article class='post form-factor'>{body}</article></body>").split("\n\n") == text
    assert html.main_text(f"<body><article>{body}<section class='related-work'><p>Earlier work did less.</p></section></article></body>").split("\n\n") == [*text, "Earlier work did less."]
    assert html.main_text(f"<body><div class='comments'>{body}</div></body>").split("\n\n") == text  # nothing else is there
    assert html.main_text(f"<body><div>{body}</div><div class='comments'>{body}{body}</div></body>").split("\n\n") == text
    for name in ("site-footer", "sidebar-container", "nav-wrapper", "share-buttons", "comment-list"):
        assert html.main_text(f"<body><div>{body}</div><div class={name}><p>Something else that nobody came here for, at some length.</p></div></body>").split("\n\n") == text
    assert html.main_text(f"<body class='has-sidebar'><div class='page-with-sidebar'>{body}</div></body>").split("\n\n") == text


def test_short_lines_around_the_main_section():
    body = "".join(f"<p>Paragraph {i} has a good many words in it, as texts do, and ends here.</p>" for i in range(9))
    assert html.main_text(f"<body><p>Lead.</p><div>{body}</div><p>End.</p></body>").split("\n\n")[:: len("ab") * 5] == ["Lead.", "End."]
    deep = "".join(f"<div>Line {i}" for i in range(2000))
    assert html.main_text(deep).split("\n\n") == [f"Line {i}" for i in range(2000)]


@pytest.mark.parametrize("page", ["<div>x" * 30_000, "<b>" * 30_000 + "</i>" * 30_000 + "x", "<div>" * 30_000 + "</section>" * 30_000 + "x", "<p><section>x" * 20_000, "<ul><li>x" * 20_000])
def test_deep_pages_take_linear_time(page):
    import time

    began = time.perf_counter()
    assert html.main_text(page)
    assert time.perf_counter() - began < 20


def test_generated_pages_give_what_they_were_made_of():
    """Pages are put together from known blocks: what was put into the article comes back, in order, and nothing else."""
    r = random.Random(12)
    word = lambda: "".join(r.choice("abcdefghilmnoprstuvé") for _ in range(r.randint(2, 9)))
    words = lambda a, b: " ".join(word() for _ in range(r.randint(a, b)))
    link = lambda: f"<a href='/{word()}'>{words(1, 4)}</a>"
    noise = [
        lambda: f"<nav><ul>{''.join(f'<li>{link()}' for _ in range(r.randint(2, 9)))}</ul></nav>",
        lambda: f"<div class='{r.choice(['ad', 'ad-banner', 'cookie-notice', 'sidebar', 'newsletter signup'])}'><p>{words(3, 30)}</p></div>",
        lambda: f"<aside><h3>{words(1, 3)}</h3><p>{words(5, 40)}</p></aside>",
        lambda: f"<section id=comments><p>{words(5, 60)}</p><p>{words(5, 60)}</p></section>",
        lambda: f"<form>{words(2, 5)}<input name=q><button>{words(1, 2)}</button></form>",
        lambda: f"<script>var a = '<p>{words(2, 9)}</p>';</script><style>p {{}}</style><!-- {words(1, 9)} -->",
    ]

    def block(truth):
        text = words(8, 60)
        truth.append(text)
        kind = r.randrange(4)
        if kind == 0:
            return f"<p>{text}</p>"
        if kind == 1:
            return f"<p>{text}"  # ended by the next block
        if kind == 2:
            half = len(text) // 2
            return f"<p>{text[:half]}<b>{text[half:]}</b></p>".replace(" ", r.choice([" ", "\n", "  \t"]))
        return f"<blockquote>{text}</blockquote>".replace("é", "&eacute;")

    for _ in range(200):
        truth, parts = [], []
        title = words(2, 6)
        truth.append(title)
        inside = "".join(block(truth) + (r.choice(noise)() if r.random() < 0.15 else "") for _ in range(r.randint(3, 12)))
        outside = [r.choice(noise)() for _ in range(r.randint(0, 6))]
        k = r.randint(0, len(outside))
        tag = r.choice(["article", "main", "article class='post'"])
        parts = [f"<header><p>{words(1, 4)}</p></header>", *outside[:k], f"<{tag}><h1>{title}</h1>{inside}</{tag.split()[0]}>", *outside[k:], f"<footer>&copy; {words(2, 6)}</footer>"]
        assert html.main_text("<!DOCTYPE html><html><body>" + "".join(parts) + "</body></html>") == "\n\n".join(truth)


def test_page_rows(spark):
    rows = [(1, "u", None), (2, "u", ""), (3, "u", PAGE), (3, "u", PAGE), (4, "u", "plain text"), (5, None, "<p>open <b>" + "x " * 100_000)]
    got = html.extract_pages(spark.createDataFrame(rows, "page_id bigint, url string, html string"), carry=["url"]).collect()
    assert sorted((r.id, len(r.text)) for r in got) == sorted([(1, 0), (2, 0), (3, len(html.main_text(PAGE))), (3, len(html.main_text(PAGE))), (4, 10), (5, 5 + 2 * 100_000 - 1)])
    assert html.extract_pages(spark.createDataFrame([], "page_id bigint, html string")).count() == 0


# --- 4: languages -----------------------------------------------------------------------


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(0)
    net = langid.Network(["a", "b", "c"], rng)
    x, y = rng.integers(0, 256, (4, langid.WINDOW)), np.array([0, 1, 2, 1])
    mask = np.arange(langid.WINDOW)[None, :] < np.array([64, 3, 20, 1])[:, None]

    def loss():
        p, h = net.p, langid.HIDDEN
        emb, states = p["E"][x], np.zeros((4, langid.WINDOW, 2 * h))
        for d, order, at in (("f", range(langid.WINDOW), 0), ("b", range(langid.WINDOW - 1, -1, -1), h)):
            now = np.zeros((4, h))
            for t in order:
                a, u = emb[:, t] @ p[f"W{d}"] + p[f"b{d}"], now @ p[f"U{d}"][:, : 2 * h]
                z, r = ((1 + langid.squash(a[:, i * h : i * h + h] + u[:, i * h : i * h + h])) / 2 for i in (0, 1))
                c = langid.squash(a[:, 2 * h :] + (r * now) @ p[f"U{d}"][:, 2 * h :])
                z = np.where(mask[:, t, None], z, 0)
                now = (1 - z) * now + z * c
                states[:, t, at : at + h] = now
        out = states @ p["V"] + p["c"]
        out -= np.log(np.exp(out).sum(2, keepdims=True))
        return -(np.take_along_axis(out, y[:, None, None], 2)[:, :, 0] * mask).sum() / mask.sum()

    grads = net.gradients(x, mask, y)
    for k, g in grads.items():
        i = np.unravel_index(np.abs(g).argmax(), g.shape)
        net.p[k][i] += 1e-6
        up = loss()
        net.p[k][i] -= 2e-6
        down = loss()
        net.p[k][i] += 1e-6
        assert g[i] == pytest.approx((up - down) / 2e-6, rel=1e-4)


def test_held_out_accuracy_and_awkward_rows(spark):
    r = random.Random(4)
    vocabulary = {"en": "the of and that with this was in which".split(), "de": "der die und nicht mit ist ein auf über".split()}
    rows = [(i, " ".join(r.choice(vocabulary[k]) for _ in range(r.randint(5, 80))), k, "s", 0, "x", "y", 7) for i in range(400) for k in [("en", "de")[i % 2]]]
    odd = [(1000 + i, t, None, "s", 0, "x", "y", 7) for i, t in enumerate([None, "", "123 !?"])] + [(1003, "und " * 20_000, None, "s", 0, "x", "y", 7)]
    got = {x.id: x for x in langid.identify(spark.createDataFrame(rows + odd, DOCS)).collect()}
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i in got)
    held = [x for x in rows if got[x[0]].held_out]
    assert sum(got[x[0]].lang_pred == x[2] for x in held) >= 0.97 * len(held)
    assert all(0 <= x.score <= 1 for x in got.values())
    assert [got[i].lang_pred for i in (1000, 1001, 1002, 1003)] == ["und", "und", "und", "de"]
    empty = langid.identify(spark.createDataFrame([], DOCS))
    assert empty.count() == 0
    assert [x.lang_pred for x in langid.identify(docs(spark, ["abc"], lang=None)).collect()] == ["und"]


# --- 5: quality -------------------------------------------------------------------------


def test_quality_combines_evidence_with_shrunken_sites(spark):
    r = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    good = lambda: " ".join(r.choice(words) for _ in range(60))
    bad = lambda: " ".join(r.choice(words) + "###" for _ in range(60))
    rows = [(i, good() if i % 4 else bad(), "en", "host/a" if i % 2 else None, 0, "x", "y", 7) for i in range(200)]
    rows += [(900 + i, t, None, "new", 0, "x", "y", 7) for i, t in enumerate([None, "", "### ### ###" * 2000])]
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(0, 120)] + [(5, None)], "doc_id bigint, quality int")
    got = {x.id: x for x in quality.classify(spark.createDataFrame(rows, DOCS), labels).collect()}
    assert all(got[i].kept == (i % 4 > 0) for i in range(200))
    assert not got[902].kept and {got[1].host, got[1].path} == {"host", "a"} and got[0].host == ""
    # a site of one document has the global prior
    share = (90 + 1) / (120 + 2)
    new = [got[900 + i] for i in range(3)]
    assert all(abs(1 / (1 + math.exp(-x.prior)) - share) < 0.15 for x in new)
    none = quality.classify(docs(spark, ["some text"]), spark.createDataFrame([], "doc_id bigint, quality int")).collect()
    assert [(x.kept, x.p_quality) for x in none] == [(True, 0.5)]
    assert quality.classify(spark.createDataFrame([], DOCS), labels).count() == 0


def test_posteriors_equal_a_plain_computation(spark):
    rows = [(i, ["plain words of a text that goes on for a while here", "### !!! ||| $$$"][i % 3 == 0], "en", f"h{i % 2}", 0, "x", "y", 7) for i in range(30)]
    frame, labels = spark.createDataFrame(rows, DOCS), spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(0, 30, 2)], "doc_id bigint, quality int")
    known = labels.select(F.col("doc_id").alias("id"), (F.col("quality") > 0).alias("good"))
    bins = quality.binned(frame, "doc_id", "text", "source", "lang")
    ratio, share = quality.fit(bins, known)
    got = {x.id: x for x in quality.posterior(bins, known, ratio, share).collect()}
    label = {i: float(i % 3 > 0) for i in range(0, 30, 2)}
    base = math.log(share / (1 - share))
    p = {i: label.get(i, 1 / (1 + math.exp(-(x.evidence + base)))) for i, x in got.items()}
    for i, x in got.items():
        site = [p[j] for j in got if j % 2 == i % 2 and j != i]
        host = (sum(site) + quality.HOST_WEIGHT * share) / (len(site) + quality.HOST_WEIGHT)
        path = (sum(site) + quality.PATH_WEIGHT * host) / (len(site) + quality.PATH_WEIGHT)
        assert x.p_quality == pytest.approx(1 / (1 + math.exp(-(x.evidence + math.log(path / (1 - path))))))


# --- 6: decontamination -----------------------------------------------------------------

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def brute_hits(text, items, size=10):
    words = WORD.findall((text or "").translate(LOWER))
    hit, found = set(), set()
    for name, t in items:
        w = WORD.findall((t or "").translate(LOWER))
        m = min(size, len(w))
        windows = {tuple(w[i : i + m]) for i in range(len(w) - m + 1)} if m else set()
        for i in range(len(words) - m + 1 if m else 0):
            if tuple(words[i : i + m]) in windows:
                hit |= set(range(i, i + m))
                found.add(str(name))
    return len(words), len(hit), sorted(found)


@pytest.mark.parametrize("pattern_bytes", [decontaminate.PATTERN_BYTES, 60])
def test_windows_against_brute_force(spark, pattern_bytes):
    r = random.Random(6)
    text = lambda n: " ".join(r.choice(["a", "b", "É", "c3", "x_y", "D-e"]) for _ in range(n))
    items = [(i, text(r.choice([1, 3, 9, 10, 11, 25]))) for i in range(12)] + [(90, None), (91, "..."), (3, text(12))]
    texts = [text(r.randint(0, 60)) + " " + r.choice(items)[1].__str__().upper() + " " + text(5) for _ in range(150)] + AWKWARD
    bench = spark.createDataFrame([(i, t, "z") for i, t in items], "item_id bigint, text string, name string")
    got = {x.id: x for x in decontaminate.contamination(docs(spark, texts), bench, pattern_bytes=pattern_bytes).collect()}
    for i, t in enumerate(texts):
        assert (got[i].n_words, sum(s.e - s.s for s in got[i].spans), list(got[i].items)) == brute_hits(t, items), t
    left = decontaminate.decontaminate(docs(spark, texts), bench, pattern_bytes=pattern_bytes)
    assert {x.doc_id for x in left.collect()} == {i for i, t in enumerate(texts) if not brute_hits(t, items)[1]}
    assert left.columns == docs(spark, []).columns


def test_no_benchmark_no_hits(spark):
    empty = spark.createDataFrame([], "item_id bigint, text string")
    assert [len(x.spans) for x in decontaminate.contamination(docs(spark, ["a b c"]), empty).collect()] == [0]
    assert decontaminate.contamination(docs(spark, []), empty).count() == 0


# --- 7: PII -----------------------------------------------------------------------------


def luhn(m):
    d = [int(c) for c in m if c.isdigit()][::-1]
    return sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(d)) % 10 == 0


n_digits = lambda m: sum(c.isdigit() for c in m)
BASE = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= n_digits(m) <= 19 and luhn(m)),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= n_digits(m) <= 15),
}


def brute_spans(t):
    out = [(m.start(), o, m.end(), k) for o, (k, (p, ok)) in enumerate(BASE.items()) for m in re.finditer(p, t or "") if ok(m.group())]
    return ",".join(f"{k}:{s}:{e}" for s, o, e, k in sorted(out))


def test_base_spans_against_brute_force(spark):
    r = random.Random(7)
    texts = ["".join(r.choice("ab.@-+ 12345()_%é🙂\n") for _ in range(r.randint(0, 60))) for _ in range(1500)]
    texts += ["".join(r.choice("0123456789 -.+4") for _ in range(r.randint(10, 60))) for _ in range(1500)]
    texts += ["4111 1111 1111 1111", "1-2--4111111111111111", "a@b.c_x@d.e", "1.2.3.4.5.6.7.8", "999.1.1.1", "9" * 30_000, "a" * 30_000 + "@b.c", "01.002.0003.255", "x@a" + ".b" * 50_000 + " y@c.d", "é a@b.c " * 3000, *AWKWARD]
    got = {x.id: x for x in pii.sensitive_spans(docs(spark, texts)).select("id", pii.joined(F.col("base")).alias("b")).collect()}
    assert [got[i].b for i in range(len(texts))] == [brute_spans(t) for t in texts]
    assert any("card" in x.b for x in got.values())


def test_terms_that_disclose_an_entity_are_removed(spark):
    filler = ["Plain words without anything to hide here."] * 60
    near = [f"In {m} the wizard Gandalf wrote to gandalf@shire.org about the {o}." for m, o in (("May", "ring"), ("June", "road"), ("July", "fire"), ("March", "elves"))]
    texts = [*filler, *near, *near[:1] * 20]
    rows = {x.id: x for x in pii.sensitive_spans(docs(spark, texts)).collect()}
    words = {texts[60][s.start : s.end] for s in rows[60].terms}
    assert "Gandalf" in words and "wizard" in words and not any(rows[i].terms for i in range(60))
    clean = {x.doc_id: x.text for x in pii.sanitise(docs(spark, texts)).collect()}
    assert "[EMAIL]" in clean[60] and "Gandalf" not in clean[60] and clean[0] == filler[0] and len(clean) == len(texts)


def test_overlapping_spans_become_one_mark(spark):
    r = random.Random(1)
    rows = []
    for i in range(60):
        text = "".join(r.choice("abé🙂 ") for _ in range(r.randint(1, 900)))
        spans = sorted((a := r.randrange(len(text)), r.randint(a + 1, min(len(text), a + 5))) for _ in range(r.choice([0, 1, 3, 300])))
        rows.append((i, text, [(s, 0, e, "x", "") for s, e in spans]))
    frame = spark.createDataFrame(rows, f"id bigint, text string, spans {pii.SPAN}")
    got = {x.id: x.out for x in frame.select("id", pii.sanitised(F.col("text"), F.col("spans")).alias("out")).collect()}
    for i, text, spans in rows:
        out, at = "", 0
        for s, _, e, _, _ in spans:
            if s >= at:
                out += text[at:s] + "[X]"
            at = max(at, e)
        assert got[i] == out + text[at:]


def test_copies_of_one_context_disclose_nothing(spark):
    texts = ["Plain words without anything to hide."] * 30 + ["Only Saruman knows s@ring.org today."] * 30
    assert all(not x.terms for x in pii.sensitive_spans(docs(spark, texts)).collect())


def test_sanitised_rows_and_columns_stay(spark):
    frame = docs(spark, [None, "", "a@b.cd and +1 234 567 8901 x", "same", "same"])
    out = pii.sanitise(frame)
    assert out.columns == frame.columns
    assert {x.doc_id: x.text for x in out.collect()} == {0: None, 1: "", 2: "[EMAIL] and [PHONE] x", 3: "same", 4: "same"}
    assert pii.sensitive_spans(docs(spark, [])).count() == 0


# --- 8: embeddings ----------------------------------------------------------------------


def brute_links(rows, threshold):
    unit = {}
    for i, v in rows:
        if v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            unit[i] = np.array(v) / np.linalg.norm(v)
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = collections.Counter()
    for a in unit:
        for b in unit:
            if a < b and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= threshold:
                links[a] += 1
                links[b] += 1
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: (links[i], find(i)) for i, _ in rows}


@pytest.mark.parametrize("block", [4096, 40])
def test_embeddings_against_brute_force(spark, block):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(12, 32))
    rows = [(i, (centres[i % 12] + rng.normal(size=32) * rng.choice([0.02, 0.3, 0.9])).tolist()) for i in range(260)]
    rows += [(300, rows[0][1]), (301, rows[0][1]), (302, [2 * x for x in rows[5][1]]), (400, None), (401, [0.0] * 32), (402, [1.0, None]), (403, [float("nan")] * 32), (404, [1.0, 0.0]), (405, [1.0, 0.0]), (406, [])]
    frame = spark.createDataFrame([(i, v, 1, "r") for i, v in rows], "vec_id bigint, embedding array<double>, label int, rep string")
    got = {x.id: (x.n_links, x.component) for x in embed_dedup.similar(frame, block=block).collect()}
    assert got == brute_links(rows, 0.9)


def test_no_embeddings(spark):
    assert embed_dedup.similar(spark.createDataFrame([], "vec_id bigint, embedding array<float>")).count() == 0
    assert [tuple(x) for x in embed_dedup.similar(spark.createDataFrame([(1, None)], "vec_id bigint, embedding array<float>")).collect()] == [(1, 0, 1)]


# --- 9: near-duplicates -----------------------------------------------------------------


def brute_components(texts, words, percent=80):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        k = min(words, len(w))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set())
    part = list(range(len(texts)))
    for b in range(len(texts)):
        for a in range(b):
            common_n = len(sets[a] & sets[b])
            if common_n and 100 * common_n >= percent * len(sets[a] | sets[b]):
                x, y = sorted((part[a], part[b]))
                part = [x if p == y else p for p in part]
    return {i: (len(s), part[i]) for i, s in enumerate(sets)}


@pytest.mark.parametrize("words", [2, 5])
def test_near_duplicates_against_brute_force(spark, words):
    r = random.Random(9)
    fresh = lambda n: [f"w{r.randint(0, 400)}" for _ in range(n)]
    passage, texts = fresh(60), []
    for _ in range(12):
        base = fresh(r.choice([3, 8, 30, 90, 400]))
        texts.append(" ".join(base))
        for _ in range(12):
            copy = list(base)
            for _ in range(r.randint(0, max(1, len(base) // 12))):
                copy[r.randrange(len(copy))] = f"w{r.randint(0, 400)}"
            texts.append(" ".join(copy))
    texts += [" ".join(passage + fresh(r.choice([2, 6, 12, 40]))) for _ in range(40)] + ["One", "one", "ONE two", "one  two\n", *AWKWARD]
    r.shuffle(texts)
    got = {x.id: (x.n_shingles, x.component) for x in minhash.near_duplicates(docs(spark, texts), words=words).collect()}
    want = brute_components(texts, words)
    assert got == want
    kept = {x.doc_id for x in minhash.keep_first(docs(spark, texts), words=words).collect()}
    assert kept == {i for i, (_, c) in want.items() if c == i}


@pytest.mark.parametrize("dense", [1, 64])
def test_near_duplicates_of_texts_near_the_threshold_in_small_cells(spark, monkeypatch, dense):
    """Texts that share a passage of two thirds to nine tenths, in lists cut into many tiles."""
    for name, value in {"DENSE": dense, "CELL_ROWS": 12, "CELL_SHINGLES": 900, "STAR_ROWS": 4, "COLUMNS": 32}.items():
        monkeypatch.setattr(minhash, name, value)
    r = random.Random(4)
    fresh = lambda n: [f"w{r.randint(0, 10**6)}" for _ in range(n)]
    texts = []
    for _ in range(3):
        passage = fresh(120)
        for _ in range(60):
            own = r.randint(6, 60)
            texts.append(" ".join(passage + fresh(own // 2)) + " " + " ".join(passage[: r.randint(1, 30)]))
    texts += texts[::9]
    r.shuffle(texts)
    got = {x.id: (x.n_shingles, x.component) for x in minhash.near_duplicates(docs(spark, texts), words=2).collect()}
    assert got == brute_components(texts, 2)


def test_shared_counts_equal_those_of_sets():
    r = random.Random(2)
    sides = [[sorted(r.sample(range(60), r.randint(0, 30))) for _ in range(9)] for _ in range(2)]
    ragged = [(np.array(sum(x, []), np.int64), np.cumsum([0, *map(len, x)])) for x in sides]
    got = minhash.shared_counts(*ragged)
    assert got.tolist() == [[len(set(a) & set(b)) for b in sides[1]] for a in sides[0]]


def test_repeated_ids_and_empty_tables(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (1, "quite another text that is here"), (2, "a b c d e f")]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), words=2).collect()
    assert len(got) == 4 and {x.component for x in got} == {1}
    assert minhash.near_duplicates(docs(spark, [])).count() == 0
    assert minhash.keep_first(spark.createDataFrame(rows, "doc_id bigint, text string"), words=2).count() == 2


# --- 10: language model -----------------------------------------------------------------


def test_forward_and_expected_counts_are_exact():
    rng = np.random.default_rng(10)
    model = hmm.Hmm.begin(rng.dirichlet(np.ones(15)), 3, rng)
    model.start = rng.dirichlet(np.ones(3))
    texts = [rng.integers(0, 15, n) for n in (1, 5, 64, 65, 128, 200, 1)]

    def passes(x):
        a, b = [model.start], [np.ones(3)]
        for o in x:
            a.append((a[-1] @ model.move) * model.emit[:, o])
        for o in x[::-1]:
            b.append(model.move @ (model.emit[:, o] * b[-1]))
        b, total = b[::-1], a[-1].sum()
        move, emit = np.zeros((3, 3)), np.zeros((3, 15))
        for t, o in enumerate(x):
            move += a[t][:, None] * model.move * (model.emit[:, o] * b[t + 1])[None] / total
            emit[:, o] += a[t + 1] * b[t + 1] / total
        return math.log(total), a[0] * b[0] / total, move, emit

    every = [passes(x) for x in texts]
    assert model.likelihood(texts) == pytest.approx([e[0] for e in every])
    for got, k in zip(model.expected(texts), (1, 2, 3), strict=True):
        assert got == pytest.approx(sum(e[k] for e in every))


@pytest.mark.parametrize("table_words", [hmm.TABLE_WORDS, 40])
def test_scores(spark, table_words):
    r = random.Random(10)
    texts = [" ".join(f"{'uv'[i % 2]}{min(r.randint(0, 90), r.randint(0, 90))}" for _ in range(r.randint(1, 150))) for i in range(160)] + [None, "", "  ", "New new", "x" * 5000]
    got = {x.id: x for x in hmm.score(docs(spark, texts), table_words=table_words).collect()}
    words = [(t or "").encode().lower().split() + [hmm.END] for t in texts]
    held = [zlib.crc32(str(i).encode()) % 7 == 2 for i in range(len(texts))]
    c = collections.Counter(w for x, h in zip(words, held, strict=True) if not h for w in x)
    total, distinct = sum(c.values()), len(c)
    for i, x in enumerate(words):
        assert (got[i].held_out, got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (held[i], len(x), sum(c[w] > 0 for w in x), total)
        assert got[i].base_score == pytest.approx(sum(math.log10((c[w] + 1) / (total + distinct + 1)) for w in x))
        assert got[i].score < 0 and math.isfinite(got[i].score)
    out = [i for i, h in enumerate(held) if h and i < 160]
    if table_words == hmm.TABLE_WORDS:  # two kinds of texts: states tell them apart where a unigram cannot
        assert sum(got[i].score for i in out) > sum(got[i].base_score for i in out)


def test_scores_of_nothing(spark):
    assert hmm.score(docs(spark, [])).count() == 0


def test_training_raises_the_likelihood():
    rng = np.random.default_rng(12)
    texts = [rng.integers(0, 6, 80) + 6 * (k % 2) for k in range(20)]
    share = np.full(12, 1 / 12)
    model, last = hmm.Hmm.begin(share, 2, rng), -math.inf
    for _ in range(6):
        now = model.likelihood(texts).sum()
        assert now >= last - 1e-6
        last, model = now, model.updated(*model.expected(texts), share * 1e-3)


def test_digest_of_nothing():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")
