"""The recurrent model against a plain one in double precision: scores, sums of probabilities, gradients, windows and lanes."""

import numpy as np
import pytest

from tessera.llm import gru

END = 3
DOCS = [[1, 4, 0, 2, 2, 5], [], [6], [0] * 23, [5, 6, 1, 1, 0, 4, 2, 6, 6, 6, 1]]


@pytest.fixture
def model():
    mass = np.array([9.0, 7, 5, 4, 2, 1, 1])
    order, bounds = gru.classes_for(mass, 3)
    params = gru.init(mass[order], bounds, 5)
    rng = np.random.default_rng(1)
    return gru.Gru({n: (v + rng.normal(0, 0.4, v.shape)).astype(np.float32) for n, v in params.items()}, bounds)


def distribution(p, bounds, h):
    """Log-probability of every token at a state."""
    logits = h @ p["uc"] + p["bc"]
    out = np.empty(bounds[-1])
    for c in range(len(bounds) - 1):
        own = p["uw"][bounds[c] : bounds[c + 1]] @ h + p["bw"][bounds[c] : bounds[c + 1]]
        out[bounds[c] : bounds[c + 1]] = logits[c] - np.log(np.exp(logits).sum()) + own - np.log(np.exp(own).sum())
    return out


def plain(p, bounds, doc):
    """A document's log-likelihood, one token after the other, and the distributions on its way."""
    n, h, before, total, seen = p["wh"].shape[0], np.zeros(p["wh"].shape[0]), END, 0.0, []
    sigmoid = lambda a: 1 / (1 + np.exp(-a))
    for token in [*doc, END]:
        gates = p["emb"][before] @ p["wx"] + p["b"]
        z, r = np.split(sigmoid(gates[: 2 * n] + h @ p["wh"][:, : 2 * n]), 2)
        new = np.tanh(gates[2 * n :] + (r * h) @ p["wh"][:, 2 * n :])
        h = z * h + (1 - z) * new
        seen.append(distribution(p, bounds, h))
        total, before = total + seen[-1][token], token
    return total, seen


def double(model):
    return {n: v.astype(np.float64) for n, v in model.p.items()}


@pytest.mark.parametrize("window", [1, 4, 1000])
@pytest.mark.parametrize("lanes", [1, 3, 50])
def test_scores_of_whole_documents(model, window, lanes):
    """The state is carried from window to window and reset where a document begins, so that neither windows nor lanes matter."""
    got = model.run([np.array(d, np.int64) for d in DOCS], END, lanes, window)
    assert np.allclose(got, [plain(double(model), model.bounds, d)[0] for d in DOCS], atol=1e-4)


def test_probabilities_sum_to_one(model):
    for d in DOCS:
        for logs in plain(double(model), model.bounds, d)[1]:
            assert abs(np.exp(logs).sum() - 1) < 1e-12
    # and those of the model itself, at some states: every token for a target
    states = np.random.default_rng(2).uniform(-1, 1, (4, model.hidden)).astype(np.float32)
    k = int(model.bounds[-1])
    score, _, _ = model.output(np.repeat(states, k, axis=0), np.tile(np.arange(k), 4), False)
    assert np.allclose(np.exp(score).reshape(4, k).sum(axis=1), 1, atol=1e-5)


def test_gradients_against_differences(model):
    """Of one document in one window, for every weight."""
    doc = DOCS[4]
    y = np.array([*doc, END])
    x = np.array([END, *doc])[:, None]
    fresh = np.zeros((len(y), 1), bool)
    fresh[0] = True
    out, _, kept = model.forward(x, fresh, np.zeros((1, model.hidden), np.float32), True)
    _, dh, grads = model.output(out[:, 0], y, True)
    model.backward(x, fresh, dh[:, None, :].copy(), kept, grads)
    emb = np.zeros_like(model.p["emb"])
    emb[model.used] = grads["emb"]
    grads["emb"] = emb
    p = double(model)
    for name in gru.NAMES:
        for at in np.ndindex(p[name].shape):
            was, step = p[name][at], 1e-5
            p[name][at] = was + step
            up = plain(p, model.bounds, doc)[0]
            p[name][at] = was - step
            down = plain(p, model.bounds, doc)[0]
            p[name][at] = was
            assert abs(-(up - down) / (2 * step) - grads[name][at]) < 2e-3, (name, at)


def test_learning_lowers_the_loss(model):
    docs = [np.array(d, np.int64) for d in DOCS]
    before = model.run(docs, END, 2, 8).sum()
    for _ in range(20):
        model.run(docs, END, 2, 8, rate=0.1)
    assert model.run(docs, END, 2, 8).sum() > before


@pytest.mark.parametrize("scale", [1, 60])  # at 60 scores are shifted before exp
def test_scores_by_blocks_of_classes(model, scale):
    """Scores and gradients of the output, however many classes are worked off at once."""
    model.p = {n: v * np.float32(scale) if n in ("uc", "uw") else v for n, v in model.p.items()}
    states = np.random.default_rng(3).uniform(-1, 1, (40, model.hidden)).astype(np.float32)
    y = np.arange(40) % int(model.bounds[-1])
    want = [distribution(double(model), model.bounds, s.astype(float))[k] for s, k in zip(states, y, strict=True)]
    whole = model.output(states, y, True)
    for room in (1, 30, 1 << 16):
        score, dh, grads = model.output(states, y, True, room)
        assert np.allclose(score, want, rtol=1e-4, atol=1e-4)
        assert np.allclose(dh, whole[1], rtol=1e-4, atol=1e-4)
        assert all(np.allclose(g, whole[2][n], rtol=1e-4, atol=1e-4) for n, g in grads.items())
    for k in range(0, 40, 7):  # the gradient of a state against differences
        for i in range(model.hidden):
            up, down = states[k].astype(float), states[k].astype(float)
            up[i] += 1e-5
            down[i] -= 1e-5
            slope = (distribution(double(model), model.bounds, up)[y[k]] - distribution(double(model), model.bounds, down)[y[k]]) / 2e-5
            assert abs(-slope - whole[1][k, i]) < 1e-3 * scale


def test_classes_share_their_passes(monkeypatch):
    """The number of exponentials that are called for does not grow with the classes."""
    k, calls = 400, []
    bounds = np.arange(0, k + 1, 4)
    m = gru.Gru(gru.init(np.ones(k), bounds, 4), bounds)
    exp = np.exp
    monkeypatch.setattr(gru.np, "exp", lambda *a, **more: calls.append(1) or exp(*a, **more))
    m.output(np.zeros((k, 4), np.float32), np.arange(k), True)
    assert len(calls) == 2


def test_gates_far_out(model):
    """A gate whose exponential overflows is 0, without a warning."""
    model.p["b"] = np.full_like(model.p["b"], -200)
    with np.errstate(all="raise", under="ignore"):
        got = model.run([np.array(d, np.int64) for d in DOCS], END, 2, 8)
    assert np.isfinite(got).all()


def test_few_lanes_take_long_windows(model, monkeypatch):
    """The rest of a long document, in a lane of its own, is scored in few windows, and as by short ones; learning keeps its windows."""
    docs, widths, forward = [np.arange(1000) % 7, *(np.array(d, np.int64) for d in DOCS)], [], gru.Gru.forward
    monkeypatch.setattr(gru.Gru, "forward", lambda self, x, *more: widths.append(len(x)) or forward(self, x, *more))
    got = model.run(docs, END, 6, 4)
    assert sum(widths) == 1001 and len(widths) < 60
    assert np.allclose(got, [plain(double(model), model.bounds, d)[0] for d in docs], rtol=1e-4, atol=1e-3)
    widths.clear()
    model.run(docs, END, 6, 4, rate=0.1)
    assert max(widths) == 4
