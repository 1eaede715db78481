"""The pooled prediction against the network computed plainly, and sampling for training."""

import numpy as np

from scriptorium.llm import langid


def plain(net, body):
    """Mean label probabilities of all positions, one byte and one window at a time, in double precision."""
    p, h, out = net.p, langid.HIDDEN, []
    for i in range(0, len(body), langid.WINDOW):
        x = np.frombuffer(body[i : i + langid.WINDOW], np.uint8)
        states = np.zeros((len(x), 2 * h))
        for d, order, at in (("f", range(len(x)), 0), ("b", range(len(x) - 1, -1, -1), h)):
            now = np.zeros(h)
            for t in order:
                a, u = p["E"][x[t]] @ p[f"W{d}"] + p[f"b{d}"], now @ p[f"U{d}"][:, : 2 * h]
                z, r = ((1 + langid.squash(a[k * h : k * h + h] + u[k * h : k * h + h])) / 2 for k in (0, 1))
                c = langid.squash(a[2 * h :] + (r * now) @ p[f"U{d}"][:, 2 * h :])
                now = (1 - z) * now + z * c
                states[t, at : at + h] = now
        e = np.exp(states @ p["V"] + p["c"])
        out.append(e / e.sum(1, keepdims=True))
    return np.concatenate(out).mean(0)


def test_pooled_probabilities_are_those_of_the_plain_network():
    rng = np.random.default_rng(4)
    net = langid.Network(["a", "b", "c"], rng)
    bodies = [bytes(rng.integers(0, 256, n, dtype=np.uint8)) for n in (1, 2, 63, 64, 65, 128, 700, 5)]
    got = langid.pooled(net.frozen(), bodies, 3)
    assert np.allclose(got, [plain(net, b) for b in bodies], atol=2e-5)
    assert np.allclose(got.sum(1), 1, atol=1e-4)


def test_all_labels_are_learnt(spark):
    """More labels than any fixed number, and one that holds a third of the rows."""
    rows = [(i, f"text number {i}", f"l{i % 260:03d}") for i in range(520)] + [(1000 + i, f"hot text {i}", "hot") for i in range(400)]
    net = langid.fit(spark.createDataFrame(rows, "id bigint, text string, label string"), sample_docs=522)
    assert net.labels == sorted({"hot", *(f"l{i:03d}" for i in range(260))})
