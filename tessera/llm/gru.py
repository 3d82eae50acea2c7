"""A gated recurrent language model in numpy with a class-factored softmax and truncated backpropagation.

Tokens are numbers: 0 .. K-1 sorted by class. P(w | state) = P(class of w | state) * P(w | class, state).
Documents run beside each other in ``lanes``; the state goes on from window to window and is reset where
a document begins, so that a document's log-likelihood is that of all of it.
"""

from __future__ import annotations

import numpy as np

NAMES = ("emb", "wx", "wh", "b", "uc", "bc", "uw", "bw")


def classes_for(mass: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the tokens (most frequent first) and class bounds: classes of about equal shares of the square-rooted mass."""
    order = np.argsort(-mass, kind="stable")
    share = np.cumsum(np.sqrt(mass[order]))
    of = np.minimum((share / share[-1] * n).astype(np.int64), n - 1)
    of = np.unique(of, return_inverse=True)[1]
    return order, np.searchsorted(of, np.arange(of[-1] + 2))


def init(mass: np.ndarray, bounds: np.ndarray, hidden: int, seed: int = 7) -> dict[str, np.ndarray]:
    """Small random weights; biases at which the model is the unigram distribution of ``mass`` (by token, sorted by class)."""
    rng = np.random.default_rng(seed)
    k, n_classes = len(mass), len(bounds) - 1
    shapes = {"emb": (k, hidden), "wx": (hidden, 3 * hidden), "wh": (hidden, 3 * hidden), "b": (3 * hidden,), "uc": (hidden, n_classes), "bc": (n_classes,), "uw": (k, hidden), "bw": (k,)}
    scale = 1 / hidden**0.5
    out = {n: (rng.normal(0, scale, s) if len(s) > 1 else np.zeros(s)).astype(np.float32) for n, s in shapes.items()}
    whole = np.add.reduceat(np.maximum(mass, 1), bounds[:-1])
    out["bc"] = np.log(whole / whole.sum()).astype(np.float32)
    out["bw"] = np.log(np.maximum(mass, 1) / np.repeat(whole, np.diff(bounds))).astype(np.float32)
    out["uc"] *= np.float32(0.1)
    out["uw"] *= np.float32(0.1)
    return out


def lay_out(docs: list[np.ndarray], end: int, lanes: int):
    """Targets, documents and first steps of all lanes, one lane behind the other, and the lanes' starts and lengths, longest first: documents dealt to the
    lanes that are shortest so far, longest first. The room needed is that of the tokens, whatever the longest document."""
    import heapq

    sizes = np.array([len(d) + 1 for d in docs])
    lanes = min(lanes, len(docs))
    heap, lane = [(0, k) for k in range(lanes)], [[] for _ in range(lanes)]
    for d in np.argsort(-sizes, kind="stable"):
        total, k = heapq.heappop(heap)
        lane[k].append(d)
        heapq.heappush(heap, (total + int(sizes[d]), k))
    by_length = sorted(heap, reverse=True)  # so that the lanes still at work are the first ones
    row = [d for _, k in by_length for d in lane[k]]
    y = np.concatenate([x for d in row for x in (docs[d], [end])]).astype(np.int32)
    owner = np.repeat(np.array(row, np.int32), sizes[row])
    fresh = np.zeros(len(y), bool)
    fresh[np.concatenate(([0], np.cumsum(sizes[row])[:-1]))] = True
    length = np.array([n for n, _ in by_length])
    return y, owner, fresh, np.cumsum(length) - length, length


class Gru:
    def __init__(self, params: dict[str, np.ndarray], bounds: np.ndarray):
        self.p, self.bounds = params, bounds
        self.hidden = params["wh"].shape[0]
        of = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        self.of = of.astype(np.uint16) if len(bounds) <= 1 << 16 else of  # short numbers are sorted faster
        self.grad2 = {n: np.full_like(v, 1e-3) for n, v in params.items()}

    def forward(self, x: np.ndarray, fresh: np.ndarray, state: np.ndarray, keep: bool):
        """States after each step; what backpropagation needs, if ``keep``. Inside, the lanes of one unit stand together, so that each gate is one piece of memory."""
        p, h = self.p, self.hidden
        there = np.zeros(len(p["emb"]), bool)
        there[x] = True
        self.used = np.flatnonzero(there)
        number = np.empty(len(there), np.int32)
        number[self.used] = np.arange(len(self.used))
        self.at = number[x]
        # a sigmoid is 1 / (1 + exp(-a)), of which an overflow makes the 0 that it should be
        one = np.float32(1)
        gates = p["emb"][self.used] @ p["wx"] + p["b"]  # by token: inputs' part of the gates
        np.negative(gates[:, : 2 * h], out=gates[:, : 2 * h])
        gates = np.ascontiguousarray(gates[self.at].transpose(0, 2, 1))
        wzr, wn = -np.ascontiguousarray(p["wh"][:, : 2 * h].T), np.ascontiguousarray(p["wh"][:, 2 * h :].T)
        out = np.empty((len(x), h, x.shape[1]), np.float32)
        # one place for all steps, where nothing is kept
        reset, new, zr = (np.empty((len(x) if keep else 1, k * h, x.shape[1]), np.float32) for k in (1, 1, 2))
        place = range(len(x)) if keep else [0] * len(x)
        live = (~fresh).astype(np.float32)
        state = begin = np.ascontiguousarray(state.T)
        with np.errstate(over="ignore"):
            for row, begins, now, k, zr_in, n_in in zip(live, fresh.any(axis=1).tolist(), out, place, gates[:, : 2 * h], gates[:, 2 * h :], strict=True):
                before = state * row if begins else state
                gate, n, reset_ = zr[k], new[k], reset[k]
                np.dot(wzr, before, out=gate)
                gate += zr_in
                np.exp(gate, out=gate)
                gate += one
                np.divide(one, gate, out=gate)
                np.multiply(gate[h:], before, out=reset_)
                np.dot(wn, reset_, out=n)
                n += n_in
                np.tanh(n, out=n)
                state = np.subtract(before, n, out=now)
                state *= gate[:h]
                state += n
        if not keep:
            return out.transpose(0, 2, 1), state.T.copy(), None
        old = np.concatenate([begin[None], out[:-1]])
        old *= live[:, None, :]
        return out.transpose(0, 2, 1), state.T.copy(), (old, zr, reset, new)

    def output(self, hs: np.ndarray, ys: np.ndarray, learn: bool, room: int = 1 << 16):
        """Natural log-probability of each target; gradients of the states and output weights, if ``learn``. Scores of some ``room`` words at a time are made, class by class, and go through each further step as one array."""
        p, b, h = self.p, self.bounds, self.hidden
        # states are within -1 .. 1, so that scores this small need no shift before exp
        small = max(np.abs(p["uc"]).sum(axis=0).max() + np.abs(p["bc"]).max(), (np.abs(p["uw"]) @ np.ones(h, np.float32)).max() + np.abs(p["bw"]).max()) < 60
        of = self.of[ys]
        order = np.argsort(of, kind="stable")  # the tokens of one class stand together
        of = of[order]
        rows, hs = np.arange(len(ys)), np.concatenate([hs[order], np.ones((len(ys), 1), np.float32)], axis=1)  # the last column is that of the biases
        prob = hs @ np.concatenate([p["uc"], p["bc"][None]])
        if not small:
            prob -= prob.max(axis=1, keepdims=True)
        found = prob[rows, of]
        np.exp(prob, out=prob)
        total = prob @ np.ones(len(b) - 1, np.float32)
        found -= np.log(total)
        if learn:
            # what is divided by the sums are the narrow factors of the products, not the scores
            prob[rows, of] -= total
            g = (hs / total[:, None]).T @ prob
            back = prob @ p["uc"].T
            back /= total[:, None]
            grads, words_ = {"uc": g[:h], "bc": g[h]}, np.zeros((len(p["uw"]), h + 1), np.float32)
        w = np.concatenate([p["uw"], p["bw"][:, None]], axis=1)
        wide = np.diff(b)[of]
        end = np.cumsum(wide)
        start, target = end - wide, ys[order] - b[of]
        classes = np.flatnonzero(np.bincount(of, minlength=len(b) - 1))
        cut = np.append(np.searchsorted(of, classes), len(ys))
        low, high, first = b[classes].tolist(), b[classes + 1].tolist(), np.append(start, end[-1])[cut]
        k = 0
        while k < len(classes):
            z = max(k + 1, int(np.searchsorted(first, first[k] + room, side="right")) - 1)
            i, j = cut[k], cut[z]
            scores = np.empty(first[z] - first[k], np.float32)
            parts = [(scores[s:e].reshape(n, -1), u, v, c, d) for s, e, n, u, v, c, d in zip((first[k:z] - first[k]).tolist(), (first[k + 1 : z + 1] - first[k]).tolist(), np.diff(cut[k : z + 1]).tolist(), cut[k:z].tolist(), cut[k + 1 : z + 1].tolist(), low[k:z], high[k:z], strict=True)]
            for part, u, v, c, d in parts:
                np.dot(hs[u:v], w[c:d].T, out=part)
            at = start[i:j] - first[k]
            if not small:
                scores -= np.repeat(np.maximum.reduceat(scores, at), wide[i:j])
            own = at + target[i:j]
            found[i:j] += scores[own]
            np.exp(scores, out=scores)
            total = np.add.reduceat(scores, at)
            found[i:j] -= np.log(total)
            if learn:
                scores[own] -= total
                share = hs[i:j] / total[:, None]
                more = np.empty((j - i, h), np.float32)
                for part, u, v, c, d in parts:
                    np.dot(part.T, share[u - i : v - i], out=words_[c:d])
                    np.dot(part, p["uw"][c:d], out=more[u - i : v - i])
                more /= total[:, None]
                back[i:j] += more
            k = z
        score = np.empty_like(found)
        score[order] = found
        if not learn:
            return score, None, None
        dh = np.empty_like(back)
        dh[order] = back
        return score, dh, {**grads, "uw": words_[:, :h].copy(), "bw": words_[:, h].copy()}

    def backward(self, x: np.ndarray, fresh: np.ndarray, dout: np.ndarray, kept: tuple, grads: dict) -> None:
        p, h = self.p, self.hidden
        old, zr, reset, new = kept
        z, r = zr[:, :h], zr[:, h:]
        # what does not depend on later steps
        to_new, to_zr = (1 - z) * (1 - new * new), zr * (1 - zr)
        to_zr[:, :h] *= old - new
        to_zr[:, h:] *= old
        dgates = np.empty((len(x), 3 * h, x.shape[1]), np.float32)
        dout = np.ascontiguousarray(dout.transpose(0, 2, 1))
        dstate, both = np.zeros(dout.shape[1:], np.float32), np.empty(zr.shape[1:], np.float32)
        d, dreset = both[:h], both[h:]
        wzr, wn = np.ascontiguousarray(p["wh"][:, : 2 * h]), np.ascontiguousarray(p["wh"][:, 2 * h :])
        live = (~fresh).astype(np.float32)
        for row, begins, more, by_new, by_zr, gate, to_n, to_gate in zip(*(a[::-1] for a in (live, fresh.any(axis=1), dout, to_new, to_zr, zr, dgates[:, 2 * h :], dgates[:, : 2 * h])), strict=True):
            np.add(dstate, more, out=d)
            np.multiply(d, by_new, out=to_n)
            np.dot(wn, to_n, out=dreset)
            np.multiply(both, by_zr, out=to_gate)
            np.dot(wzr, to_gate, out=dstate)
            both *= gate
            dstate += d
            dstate += dreset
            if begins:
                dstate *= row
        flat, states, resets = (np.ascontiguousarray(a.transpose(0, 2, 1)).reshape(-1, a.shape[1]) for a in (dgates, old, reset))
        grads["wh"] = np.concatenate([states.T @ flat[:, : 2 * h], resets.T @ flat[:, 2 * h :]], axis=1)
        # by token, then through the embedding; grads["emb"] has a row for each token used
        at = self.at.ravel()
        order = np.argsort(at.astype(np.uint16) if len(self.used) <= 1 << 16 else at, kind="stable")
        by = np.add.reduceat(flat[order], np.searchsorted(at[order], np.arange(len(self.used))), axis=0)
        grads["wx"], grads["b"], grads["emb"] = p["emb"][self.used].T @ by, by.sum(axis=0), by @ p["wx"].T

    def run(self, docs: list[np.ndarray], end: int, lanes: int, window: int, rate: float = 0.0) -> np.ndarray:
        """Sum of natural log-probabilities of each document, its end included. rate: of Adagrad; over 0, the weights learn after each window."""
        if not docs:
            return np.zeros(0)
        y, owner, fresh, start, length = lay_out(docs, end, lanes)
        scores = np.empty(len(y), np.float32)
        state = np.zeros((len(length), self.hidden), np.float32)
        held, found, to = {}, 0, 0
        while (t := to) < length[0]:
            live = int((length > t).sum())
            # where nothing is learnt, windows do not matter: with few lanes left they are longer
            to = min(t + (window if rate > 0 else max(window, window * lanes // live)), int(length[0]))
            steps = np.arange(t, to)[:, None]
            at, place = steps < length[:live], start[:live] + steps
            full = bool(at[-1].all())
            if not full:
                place = np.where(at, place, 0)
            ys, new = y[place], fresh[place] | ~at
            # the token before; at the first step of a document the end of another
            xs = np.where(new, end, y[place - 1])
            out, state, kept = self.forward(xs, new, state[:live], rate > 0)
            some = slice(None) if full else np.flatnonzero(at)
            score, dh, grads = self.output(out.reshape(-1, self.hidden)[some], ys.ravel()[some], rate > 0)
            scores[place.ravel()[some]] = score
            if rate > 0:
                dout = np.zeros(out.shape, np.float32)
                dout.reshape(-1, self.hidden)[some] = dh
                self.backward(xs, new, dout, kept, grads)
                found += int(at.sum())
                whole = 2 * found >= lanes * window
                if whole and not held:
                    self.step(grads, 1 / (lanes * window), rate, self.used)
                    found = 0
                    continue
                # where few lanes are left, as in the rest of one long document, windows are gathered to a step
                for name, g in grads.items():
                    if name not in held:
                        held[name] = np.zeros_like(self.p[name])
                    held[name][self.used if name == "emb" else slice(None)] += g
                if whole or to == length[0]:
                    self.step(held, 1 / (lanes * window), rate, slice(None))
                    held, found = {}, 0
        return np.bincount(owner, scores, len(docs))

    def step(self, grads: dict, share: float, rate: float, used) -> None:
        """One step of Adagrad with the gradients times ``share``. used: the tokens that the rows of grads["emb"] are of."""
        for name, g in grads.items():
            p, seen = self.p[name], self.grad2[name]
            some = name == "emb" and not isinstance(used, slice)
            g *= np.float32(share)
            now = seen[used] if some else seen
            now += g * g
            g *= np.float32(rate)
            g /= np.sqrt(now)
            if some:
                seen[used] = now
                p[used] -= g
            else:
                p -= g
