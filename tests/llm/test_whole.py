"""Operators of the llm subpackage take whole texts and pages: each test fails on a prefix or a sample."""

import numpy as np
import pytest

from scriptorium.llm import hmm, html, pii


def test_terms_disclose_from_anywhere_in_a_document(spark):
    far = " ".join(["plain filler stands here"] * 10)
    foot = "Yours, Li Ann, li@sea.org, end of the same long passage that every letter has at its foot."
    texts = [f"{x} {far} {foot} {far} once more Li" for x in ("first", "second", "third")] + ["one Bo and x@y.org", "two Bo and x@y.org"]
    texts += [f"{far} the same end of passage and one two more {i}" for i in range(40)]
    rows = {x.id: x for x in pii.sensitive_spans(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    words = {i: [texts[i][s.start : s.end] for s in rows[i].terms] for i in rows}
    for i in range(3):
        assert words[i].count("Li") == 2 and "Ann" in words[i] and "filler" not in words[i] and "li" not in words[i]
    assert words[3] == words[4] == ["Bo"] and not any(words[i] for i in range(5, 45))


@pytest.mark.parametrize("outer", [("<article>{}</article>", "<article>{}</article>"), ("<main><article>{}</article>", "{}</main>"), ("<div>{}</div>", "<div>{}</div>")])
def test_content_outside_the_main_region_stays(outer):
    first = [f"Paragraph {i} has a good many words in it, as texts do, and ends here." for i in range(9)]
    second = [f"Another text {i} of as many words stands in a section of its own, too." for i in range(2)]
    tagged = [o.format("".join(f"<p>{x}</p>" for x in part)) for o, part in zip(outer, (first, second))]
    links = "".join(f"<li><a href=/{i}>Link {i}</a></li>" for i in range(20))
    assert html.main_text(f"<body><ul>{links}</ul>{''.join(tagged)}<ul>{links}</ul></body>").split("\n\n") == first + second


def test_all_passes_take_whole_texts(spark):
    rng = np.random.default_rng(3)
    texts = [np.concatenate([np.zeros(400, int), rng.integers(1, 6, 300) + 5 * (k % 2)]) for k in range(12)]
    share = np.full(11, 1 / 11)
    want = hmm.Hmm.begin(share, 2, np.random.default_rng(hmm.SEED))
    for _ in range(3):
        want = want.updated(*want.expected(texts), share)
    rows = spark.createDataFrame([(k, [int(x) for x in t]) for k, t in enumerate(texts)], "id bigint, symbols array<int>")
    got = hmm.train(rows, share, states=2, passes=3)
    assert got.emit == pytest.approx(want.emit) and got.move == pytest.approx(want.move)
