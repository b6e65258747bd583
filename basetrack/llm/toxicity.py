"""Toxicity scores by a bidirectional gated recurrent network with attention pooling, in numpy.

A word's input is a hashed embedding joined to the two end states of a bidirectional gated network over its characters.
A bidirectional gated network runs over a window of words; attention pools its states into one logit.  All overlapping windows of a
text are scored, one from each word on; the text's score comes from its highest window.

Training is on a bounded sample of labelled rows (``sample`` texts of class 1 and a few times as many of class 0, by hash of the doc_id) on the driver.  A text's label says only
that some window is toxic, so words are learnt first and then, turn by turn, the highest windows of toxic texts (of one window start
in ``train_stride``); the threshold is set on all windows of the sample.

Edge cases: a null or empty text has no window and gets the score of the least logit, near 0; words longer than a character window
go in pieces, none is cut off; ties among windows need no order; repeated rows are scored each; labels null or of unknown documents are
left out; a doc_id with labels 0 and 1 counts as 1; without rows of both classes every score is the share of class 1 (0 without rows).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basetrack.llm import text as tx
from basetrack.llm.common import chunks, ship, unused
from basetrack.llm.ngram_join import minhashes, ngram_sets


@dataclass(frozen=True)
class Net:
    #: Words in this many texts of the sample have an embedding; rarer ones would be learnt by heart, and are known by their letters.
    word_texts: int = 5
    #: The share of known words that a training step reads by their letters alone.
    word_dropout: float = 0.3
    word_dim: int = 4
    char_dim: int = 8
    char_hidden: int = 8
    hidden: int = 8
    chars: int = 16  # characters in a piece of a word
    #: Of windows of 12, 16, 24 and 32 words, fitted without a fifth of the training rows, all told that fifth apart alike.
    window: int = 32
    #: Steps from window to window: of all texts that are scored, and of the sample when training picks its windows.
    stride: int = 1
    train_stride: int = 16
    #: The bound on the training sample: texts of class 1, of class 0 for each of these (they tell chance from meaning), characters of a text.
    sample: int = 300
    clean_times: int = 4
    sample_chars: int = 20_000
    #: |log odds| * sqrt(texts) from which a word's odds aren't chance.
    significance: float = 5.0
    word_rounds: int = 3
    #: Words that aren't marked for each marked one, in the words' training.
    word_balance: int = 8
    rounds: int = 3
    least_steps: int = 24
    batch: int = 256
    rate: float = 0.01
    seed: int = 11


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_EDGE = np.zeros(256, bool)
_EDGE[list(b".,;:!?\"'()[]{}<>|#*$%&-_/=+~`")] = True


def tokens(column: pa.Array, net: Net) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(data, starts, ends, bounds): lower-cased words without marks at their ends, in pieces of at most net.chars bytes."""
    w = tx.words(column)
    data = _LOWER[w.data]
    starts, ends = w.starts.copy(), w.ends.copy()
    left = right = np.arange(len(starts))
    for _ in range(4):  # a few marks at either end; a word that keeps one keeps it from then on
        left = left[(ends[left] - starts[left] > 1) & _EDGE[data[starts[left]]]]
        starts[left] += 1
        right = right[(ends[right] - starts[right] > 1) & _EDGE[data[ends[right] - 1]]]
        ends[right] -= 1
    pieces = -(-(ends - starts) // net.chars)
    word = np.repeat(np.arange(len(starts)), pieces)
    k = np.arange(len(word)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    lo = starts[word] + k * net.chars
    hi = np.minimum(lo + net.chars, ends[word])
    return data, lo, hi, np.concatenate([[0], np.cumsum(pieces)])[w.first]


def windows(bounds: np.ndarray, net: Net) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first token, length, row) of all overlapping windows; the last one of a text ends with it."""
    n = np.diff(bounds)
    count = np.where(n > 0, 1 + np.maximum(-(-(n - net.window) // net.stride), 0), 0)
    row = np.repeat(np.arange(len(n)), count)
    k = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    first = np.minimum(k * net.stride, np.maximum(n[row] - net.window, 0)) + bounds[:-1][row]
    return first, np.minimum(n[row], net.window), row


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return np.float32(1) / (np.float32(1) + np.exp(-np.clip(x, -30, 30)))


class Gru:
    """A gated recurrent layer over (time, batch) gate inputs; padding leaves the state as it is."""

    @staticmethod
    def forward(gates: np.ndarray, u: np.ndarray, mask: np.ndarray, keep: bool = False):
        """gates: (T, N, 3h) of the inputs: update, reset, candidate; mask: (T, N, 1)."""
        t, n, h3 = gates.shape
        h = h3 // 3
        state = np.zeros((n, h), np.float32)
        states, cache = np.empty((t, n, h), np.float32), []
        for i in range(t):
            a = gates[i, :, : 2 * h] + state @ u[:, : 2 * h]
            zr = _sigmoid(a)
            z, r = zr[:, :h], zr[:, h:]
            inner = r * state
            c = np.tanh(gates[i, :, 2 * h :] + inner @ u[:, 2 * h :])
            if keep:
                cache.append((state, z, r, inner, c))
            state = state + mask[i] * z * (c - state)
            states[i] = state
        return states, cache

    @staticmethod
    def backward(d_states: np.ndarray, u: np.ndarray, mask: np.ndarray, cache: list):
        t, n, h = d_states.shape
        d_gates, d_u, d = np.empty((t, n, 3 * h), np.float32), np.zeros_like(u), np.zeros((n, h), np.float32)
        for i in range(t - 1, -1, -1):
            state, z, r, inner, c = cache[i]
            d = d + d_states[i]
            m = mask[i]
            d_c = d * m * z * (1 - c * c)
            d_z = d * m * (c - state) * z * (1 - z)
            d_inner = d_c @ u[:, 2 * h :].T
            d_r = d_inner * state * r * (1 - r)
            d_zr = np.concatenate([d_z, d_r], 1)
            d_gates[i, :, : 2 * h], d_gates[i, :, 2 * h :] = d_zr, d_c
            d_u[:, : 2 * h] += state.T @ d_zr
            d_u[:, 2 * h :] += inner.T @ d_c
            d = d * (1 - m * z) + d_inner * r + d_zr @ u[:, : 2 * h].T
        return d_gates, d_u


def start(net: Net) -> dict[str, np.ndarray]:
    g = np.random.default_rng(net.seed)
    draw = lambda *shape, scale=None: (g.standard_normal(shape) * (scale or 1 / np.sqrt(shape[0]))).astype(np.float32)
    h, k, d = net.hidden, net.char_hidden, net.word_dim + 2 * net.char_hidden
    return {
        "char": draw(256, net.char_dim, scale=0.5),
        "cwf": draw(net.char_dim, 3 * k), "cuf": draw(k, 3 * k), "cbf": np.zeros(3 * k, np.float32), "cwb": draw(net.char_dim, 3 * k), "cub": draw(k, 3 * k), "cbb": np.zeros(3 * k, np.float32),
        "wf": draw(d, 3 * h), "uf": draw(h, 3 * h), "bf": np.zeros(3 * h, np.float32), "wb": draw(d, 3 * h), "ub": draw(h, 3 * h), "bb": np.zeros(3 * h, np.float32),
        "aw": draw(2 * h, 2 * h), "ab": np.zeros(2 * h, np.float32), "av": draw(2 * h, 1), "ow": draw(2 * h, 1), "ob": np.full(1, -1.0, np.float32),
    }


def _char_input(data: np.ndarray, lo: np.ndarray, hi: np.ndarray, chars: int) -> tuple[np.ndarray, np.ndarray]:
    """(T, N) bytes and (T, N, 1) mask of pieces of words."""
    at = lo[None, :] + np.arange(chars)[:, None]
    mask = at < hi[None, :]
    return np.where(mask, data[np.minimum(at, max(len(data) - 1, 0))], 0), mask[:, :, None].astype(np.float32)


def char_states(p: dict, data: np.ndarray, lo: np.ndarray, hi: np.ndarray, net: Net, keep: bool = False):
    """End states of both directions over the characters of distinct words."""
    n = max(int((hi - lo).max(initial=0)), 1)
    chars, mask = _char_input(data, lo, hi, n)
    forward = (p["char"] @ p["cwf"] + p["cbf"])[chars]
    f, cf = Gru.forward(forward, p["cuf"], mask, keep)
    back, mask_b = chars[::-1], mask[::-1]
    b, cb = Gru.forward((p["char"] @ p["cwb"] + p["cbb"])[back], p["cub"], mask_b, keep)
    return np.concatenate([f[-1], b[-1]], 1), (chars, mask, cf, cb)


def window_logits(p: dict, ids: np.ndarray, mask: np.ndarray, word_inputs: tuple[np.ndarray, np.ndarray], keep: bool = False):
    """Logits of windows; ids: (T, N) rows of the gate inputs of distinct words, forward and backward."""
    f, cf = Gru.forward(word_inputs[0][ids], p["uf"], mask, keep)
    b, cb = Gru.forward(word_inputs[1][ids[::-1]], p["ub"], mask[::-1], keep)
    states = np.concatenate([f, b[::-1]], 2)
    act = np.tanh(states @ p["aw"] + p["ab"])
    e = (act @ p["av"])[:, :, 0] + np.where(mask[:, :, 0] > 0, 0, -1e9).astype(np.float32)
    e = np.exp(e - e.max(0))
    a = e / e.sum(0)
    pooled = np.einsum("tn,tnh->nh", a, states)
    return (pooled @ p["ow"])[:, 0] + p["ob"][0], (states, act, a, pooled, cf, cb)


def loss_gradients(p: dict, ids: np.ndarray, mask: np.ndarray, distinct: tuple, y: np.ndarray, weight: np.ndarray, net: Net, chars: bool = True) -> tuple[float, dict]:
    """Weighted logistic loss of windows and its gradients; distinct: (data, lo, hi, bucket) of the words that ids point to."""
    data, lo, hi, bucket = distinct
    ends, ccache = char_states(p, data, lo, hi, net, chars)
    x = np.concatenate([p["word"][bucket], ends], 1)
    gf, gb = x @ p["wf"] + p["bf"], x @ p["wb"] + p["bb"]
    logit, (states, act, a, pooled, cf, cb) = window_logits(p, ids, mask, (gf, gb), True)
    prob = _sigmoid(logit)
    total = weight.sum()
    loss = float((weight * (np.logaddexp(0, logit) - y * logit)).sum() / total)
    d = (weight * (prob - y) / total).astype(np.float32)
    g = {"ow": pooled.T @ d[:, None], "ob": d.sum(keepdims=True)}
    d_pool = d[:, None] * p["ow"][:, 0]
    d_a = np.einsum("nh,tnh->tn", d_pool, states)
    d_e = a * (d_a - (a * d_a).sum(0))
    d_act = d_e[:, :, None] * p["av"][:, 0] * (1 - act * act)
    t, n, h2 = states.shape
    g["av"] = np.einsum("tnh,tn->h", act, d_e)[:, None]
    flat = d_act.reshape(-1, h2)
    g["aw"], g["ab"] = states.reshape(-1, h2).T @ flat, flat.sum(0)
    d_states = a[:, :, None] * d_pool + (flat @ p["aw"].T).reshape(t, n, h2)
    h = h2 // 2
    d_gf, g["uf"] = Gru.backward(np.ascontiguousarray(d_states[:, :, :h]), p["uf"], mask, cf)
    d_gb, g["ub"] = Gru.backward(np.ascontiguousarray(d_states[::-1, :, h:]), p["ub"], mask[::-1], cb)

    df, db = _gather(ids.ravel(), d_gf.reshape(t * n, -1), len(x)), _gather(ids[::-1].ravel(), d_gb.reshape(t * n, -1), len(x))
    g["wf"], g["bf"], g["wb"], g["bb"] = x.T @ df, df.sum(0), x.T @ db, db.sum(0)
    d_x = df @ p["wf"].T + db @ p["wb"].T
    g["word"] = _gather(bucket, d_x[:, : net.word_dim], len(p["word"]))
    g["word"][0] = 0
    if chars:
        g |= _char_backward(p, d_x[:, net.word_dim :], ccache, net)
    return loss, g


class Scorer:
    """Window logits of whole texts; gate inputs of distinct words are made once a slice."""

    def __init__(self, model: dict, net: Net) -> None:
        self.model, self.net = model, net

    def known(self, hashes: np.ndarray) -> np.ndarray:
        """Rows of the word embedding; 0 is any word that isn't in the vocabulary."""
        vocabulary = self.model.get("vocabulary", np.zeros(0, np.uint64))
        if not len(vocabulary):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
        return np.where(vocabulary[at] == hashes, at + 1, 0)

    def prepare(self, column: pa.Array) -> dict:
        net = self.net
        data, lo, hi, bounds = tokens(column, net)
        hashes = tx.byte_hashes(data, lo, hi)
        distinct, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        at, length, row = windows(bounds, net)
        return {"data": data, "lo": lo[first], "hi": hi[first], "hash": distinct, "bucket": self.known(distinct), "which": which, "token_row": np.repeat(np.arange(len(bounds) - 1), np.diff(bounds)), "at": at, "length": length, "row": row}

    def ids(self, s: dict, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        t = np.arange(int(s["length"][some].max(initial=1)))[:, None]
        mask = t < s["length"][some][None, :]
        at = s["at"][some][None, :] + np.where(mask, t, 0)
        return s["which"][at], mask[:, :, None].astype(np.float32)

    def logits(self, s: dict) -> np.ndarray:
        p, net = self.model, self.net
        out = np.empty(len(s["at"]), np.float32)
        if not len(out):
            return out
        x = np.empty((len(s["lo"]), net.word_dim + 2 * net.char_hidden), np.float32)
        letters = Letters(p)
        size = (s["hi"] - s["lo"]).astype(np.int16 if net.chars < 1 << 15 else np.int64)  # short numbers are sorted by their digits
        order = np.argsort(size, kind="stable")
        for own in np.split(order, np.flatnonzero(np.diff(size[order])) + 1):
            for i in range(0, len(own), SWEEP_STARTS):
                part = own[i : i + SWEEP_STARTS]
                x[part, net.word_dim :] = letters.ends(s["data"], s["lo"][part], int(size[own[0]]))
        x[:, : net.word_dim] = p["word"][s["bucket"]]
        inputs = x @ p["wf"] + p["bf"], x @ p["wb"] + p["bb"]
        # windows that start at one token after another share their inputs: a step reads a slice of the tokens
        dense = (s["length"] == net.window) if net.stride == 1 else np.zeros(len(out), bool)
        rest, whole = np.flatnonzero(~dense), np.flatnonzero(dense)
        rest = rest[np.argsort(s["length"][rest], kind="stable")]
        for i in range(0, len(rest), 1024):
            part = rest[i : i + 1024]
            out[part] = window_logits(p, *self.ids(s, part), inputs)[0]
        if len(whole):
            sweep = Sweep(p, inputs, net.window)
            at = s["at"][whole]
            i = 0
            while i < len(at):
                j = int(np.searchsorted(at, at[i] + SWEEP_STARTS))
                n = int(at[j - 1] - at[i]) + 1
                out[whole[i:j]] = sweep.logits(s["which"][at[i] : at[i] + n + net.window - 1], n)[at[i:j] - at[i]]
                i = j
        return out


#: Window starts of one sweep: a step's arrays stay in a core's cache, and a call takes little beside its work.
SWEEP_STARTS = 3025


def _tanh_is_wide() -> bool:
    """Whether numpy takes tangents 16 at once (AVX-512); with AVX2 an exponential takes less than half of a tangent's time."""
    try:
        return "AVX512" in np.lib.introspect.opt_func_info(func_name="^tanh$", signature="float32")["tanh"]["ff"]["current"]
    except (AttributeError, KeyError):
        return False


#: Gates by tangents or by exponentials; the states are the same within rounding.
BY_TANH = _tanh_is_wide()


_ONE, _TWO, _HALF = (np.array(x, np.float32) for x in (1, 2, 0.5))


class Cell:
    """A gated recurrent layer on columns: units run down the rows, sequences along the columns, and a step writes where it is told.

    By tangents, a sigmoid is half of one and the tangent of half the angle; by exponentials, a gate is divided by instead.  The factors are inside the weights.
    """

    def __init__(self, u: np.ndarray) -> None:
        h = self.h = u.shape[0]
        self.by_tanh = BY_TANH
        self.scale = np.repeat(np.array([0.5, 0.5, 1] if self.by_tanh else [-1, -1, -2], np.float32), h)
        u = u * self.scale
        self.u_zr, self.u_c = np.ascontiguousarray(u[:, : 2 * h].T), np.ascontiguousarray(u[:, 2 * h :].T) * np.float32(0.5 if self.by_tanh else 1)

    def room(self, a: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, ...]:
        """Room for a step's gates, (2h, N), and candidates, (h, N)."""
        return a, c, a[: self.h], a[self.h :]

    def step(self, gates: np.ndarray, own: np.ndarray, state: np.ndarray | None, out: np.ndarray, room: tuple[np.ndarray, ...]) -> None:
        """The state after one more input, into ``out``, which may be ``state``; gates, (2h, N), and own, (h, N), the candidate's: of the inputs, scaled; state: None is all zeros."""
        a, c, update, reset = room
        curve = np.tanh if self.by_tanh else np.exp
        if state is None:
            curve(gates, a)
            curve(own, c)
            np.add(a, _ONE, a)
        else:
            np.matmul(self.u_zr, state, a)
            np.add(a, gates, a)
            curve(a, a)
            np.add(a, _ONE, a)  # by tangents twice the gates, by exponentials what to divide by
            (np.multiply if self.by_tanh else np.divide)(state, reset, reset)
            np.matmul(self.u_c, reset, c)
            np.add(c, own, c)
            curve(c, c)
        if self.by_tanh:
            if state is not None:
                np.subtract(c, state, c)
            np.multiply(c, update, c)
            np.multiply(c, _HALF, c if state is not None else out)
        else:
            np.add(c, _ONE, c)
            np.divide(_TWO, c, c)
            np.subtract(c, _ONE, c)
            if state is not None:
                np.subtract(c, state, c)
            np.divide(c, update, c if state is not None else out)
        if state is not None:
            np.add(state, c, out)


def _lines(n: int) -> np.ndarray:
    """n numbers that begin with a cache line of 64 bytes."""
    out = np.empty(n + 16, np.float32)
    return out[-(out.ctypes.data // 4) % 16 :][:n]


class Letters:
    """End states of both directions over the letters of words of one length."""

    def __init__(self, p: dict) -> None:
        self.cells = Cell(p["cuf"]), Cell(p["cub"])
        self.table = [(p["char"] @ p[w] + p[b]) * cell.scale for w, b, cell in (("cwf", "cbf", self.cells[0]), ("cwb", "cbb", self.cells[1]))]

    def ends(self, data: np.ndarray, lo: np.ndarray, size: int) -> np.ndarray:
        h = self.cells[0].h
        room = self.cells[0].room(np.empty((2 * h, len(lo)), np.float32), np.empty((h, len(lo)), np.float32))
        out = np.zeros((2 * h, len(lo)), np.float32)
        with np.errstate(over="ignore"):
            for cell, table, own, way in zip(self.cells, self.table, (out[:h], out[h:]), (range(size), range(size - 1, -1, -1)), strict=True):
                state = None
                for i in way:
                    gates = np.ascontiguousarray(table[data[lo + i]].T)
                    cell.step(gates[: 2 * h], gates[2 * h :], state, own, room)
                    state = own
        return out.T


class Sweep:
    """Logits of full windows that start at consecutive tokens; units run down the rows and windows along the columns."""

    def __init__(self, p: dict, inputs: tuple[np.ndarray, np.ndarray], window: int) -> None:
        self.cells = Cell(p["uf"]), Cell(p["ub"])
        self.h, self.window, self.kept = self.cells[0].h, window, np.empty(0, np.float32)
        self.gates = [x * cell.scale for x, cell in zip(inputs, self.cells, strict=True)]
        # what attention and the output take from a state; the last column is the bias, for a row of ones
        read = np.concatenate([np.concatenate([p["aw"], p["ow"]], 1), np.append(p["ab"], 0)[None, :]], 0).T.astype(np.float32)
        if not BY_TANH:
            read[:-1] *= np.float32(2)  # weights' sum less twice the shares 1 / (1 + exp(2x)); the sum is the same for all words of a window
        self.read = np.ascontiguousarray(read)
        self.av, self.ob = np.ascontiguousarray(p["av"].T) * np.float32(1 if BY_TANH else -2), p["ob"][0]

    def _room(self, *shapes: tuple[int, ...]) -> list[np.ndarray]:
        """Arrays that begin with a cache line, in room that is kept from sweep to sweep, as new pages cost time."""
        sizes = [-(-int(np.prod(x)) // 16) * 16 for x in shapes]
        if len(self.kept) < sum(sizes):
            self.kept = _lines(sum(sizes))
        ends = np.cumsum(sizes)
        return [self.kept[e - k : e - k + int(np.prod(x))].reshape(x) for x, k, e in zip(shapes, sizes, ends, strict=True)]

    def _gates(self, side: int, which: np.ndarray, flat: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """The gates' and the candidates' inputs by place in the window, as one run of ``flat`` each: a column that has no such word sees another row's, and is no window's."""
        h, n = self.h, len(which)
        np.copyto(flat[: 3 * h * n].reshape(3 * h, n), self.gates[side][which].T)
        flat[3 * h * n :] = 0
        return [(flat[i : i + 2 * h * n].reshape(2 * h, n), flat[i + 2 * h * n : i + 3 * h * n].reshape(h, n)) for i in range(self.window)]

    def logits(self, which: np.ndarray, n: int) -> np.ndarray:
        h, t, asked = self.h, self.window, n
        n = (-(-len(which) // 16) | 1) * 16  # a column a word; rows begin with a cache line each, and not all with one that falls on the same place of the cache
        which = np.concatenate([which, np.full(n - len(which), which[-1])])
        forward, a, c, seen, weight, value, both, flat = self._room((t, h, n), (2 * h, n), (h, n), (2 * h + 1, n), (t, n), (t, n), (2 * h + 1, n), (3 * h * n + t,))
        room = self.cells[0].room(a, c)
        with np.errstate(over="ignore"):
            for i, gates in enumerate(self._gates(0, which, flat)):
                self.cells[0].step(*gates, forward[i - 1] if i else None, forward[i], room)
            gates = self._gates(1, which, flat)
            ahead, back, act, both[2 * h] = both[:h], both[h : 2 * h], seen[: 2 * h], 1  # both: the states of a word and a row of ones
            for i in range(t - 1, -1, -1):
                self.cells[1].step(*gates[i], back if i + 1 < t else None, back, room)
                np.copyto(ahead, forward[i])
                np.matmul(self.read, both, seen)
                np.copyto(value[i], seen[2 * h])
                if BY_TANH:
                    np.tanh(act, act)
                else:
                    np.exp(act, act)
                    np.add(act, _ONE, act)
                    np.divide(_ONE, act, act)
                np.matmul(self.av, act, weight[i : i + 1])
        weight -= weight.max(0)
        np.exp(weight, out=weight)
        value *= weight
        return (value.sum(0) / weight.sum(0) + self.ob)[:asked]


class Adam:
    def __init__(self, p: dict[str, np.ndarray]) -> None:
        self.p, self.step = p, 0
        self.moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in p.items()}

    def update(self, grads: dict[str, np.ndarray], rate: float) -> None:
        """One step with the gradients' norm clipped to 1."""
        self.step += 1
        norm = np.sqrt(sum(float((v * v).sum()) for v in grads.values()))
        for k, v in grads.items():
            v = v / max(norm, 1.0)
            m, q = self.moments[k]
            m += 0.1 * (v - m)
            q += 0.001 * (v * v - q)
            self.p[k] -= (rate * (m / (1 - 0.9**self.step)) / (np.sqrt(q / (1 - 0.999**self.step)) + 1e-8)).astype(np.float32)


def _gather(rows: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    """Sums of the values' rows by index."""
    out = np.zeros((size, values.shape[1]), np.float32)
    order = np.argsort(rows, kind="stable")
    ranked = rows[order]
    cuts = np.flatnonzero(np.diff(ranked, prepend=-1))
    if len(cuts):
        out[ranked[cuts]] = np.add.reduceat(values[order], cuts, 0)
    return out


def _char_backward(p: dict, d_ends: np.ndarray, cache: tuple, net: Net) -> dict[str, np.ndarray]:
    """Gradients of the character network from those of its end states."""
    chars, mask, cf, cb = cache
    k, (t, n) = net.char_hidden, chars.shape
    g, last = {}, np.zeros((t, n, k), np.float32)
    last[-1] = d_ends[:, :k]
    d_f, g["cuf"] = Gru.backward(last, p["cuf"], mask, cf)
    last[-1] = d_ends[:, k:]
    d_b, g["cub"] = Gru.backward(last, p["cub"], mask[::-1], cb)
    rows_f, rows_b = _gather(chars.ravel(), d_f.reshape(t * n, -1), 256), _gather(chars[::-1].ravel(), d_b.reshape(t * n, -1), 256)
    g["cwf"], g["cbf"], g["cwb"], g["cbb"] = p["char"].T @ rows_f, rows_f.sum(0), p["char"].T @ rows_b, rows_b.sum(0)
    g["char"] = rows_f @ p["cwf"].T + rows_b @ p["cwb"].T
    return g


def first_copies(texts: list[str], values: int = 8) -> list[int]:
    """Texts that share none of a few MinHash values of their 5-word windows with an earlier one."""
    hashes, bounds = ngram_sets(pa.array(texts, pa.string()), 5)
    signatures = minhashes(hashes, bounds, values).tolist()
    seen: set[tuple[int, int]] = set()
    out = []
    for i, signature in enumerate(signatures):
        own = set(enumerate(signature))
        if not own & seen or not any(signature):
            out.append(i)
        seen |= own
    return out


def word_odds(s: dict, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How often each distinct word is found in class 1 and in class 0, scaled to as many texts.

    The lesser of its texts and its distinct contexts (the word and its neighbours) counts: copies of a text repeat its
    contexts, and a text that says a word over and over is one text.
    """
    h, row, size = s["hash"][s["which"]], s["token_row"], len(s["lo"])
    before, after = np.roll(h, 1), np.roll(h, -1)
    before[np.flatnonzero(np.diff(row, prepend=-1))] = 0
    after[np.flatnonzero(np.diff(row, append=-1))] = 0
    context = tx.mix(h + tx.mix(before + np.uint64(1)) * np.uint64(3) + tx.mix(after + np.uint64(2)) * np.uint64(5))
    out = []
    for label in (1, 0):
        own = y[row] == label
        _, first = np.unique(context[own], return_index=True)
        contexts = np.bincount(s["which"][own][first], minlength=size)
        texts = np.bincount(np.unique(row[own].astype(np.int64) * size + s["which"][own]) % size, minlength=size)
        out.append(np.minimum(contexts, texts).astype(np.float64))
    return out[0], out[1] * (y.sum() / max((1 - y).sum(), 1))


def train(texts: list[str], labels: list[int], net: Net) -> dict[str, np.ndarray]:
    """Fit on whole texts.

    First the words: how many texts and contexts of either class hold a word gives the embedding's first column its start, and the character
    network learns to tell these odds from the letters.  Then the windows: of a toxic text its highest ones, by
    the words' odds and from then on by the network, against the highest of clean texts and some by chance.
    """
    own_texts = first_copies(texts)
    texts, y = [texts[i] for i in own_texts], np.array(labels)[own_texts]
    if not 0 < y.sum() < len(y):
        raise ValueError("texts of one class only")
    p = start(net)
    column = pa.array(texts, pa.string())
    scorer = Scorer(p, replace(net, stride=net.train_stride))
    s = scorer.prepare(column)
    g = np.random.default_rng(net.seed + 1)
    row = s["row"]
    if not len(row):
        return p | {"shift": np.zeros(1, np.float32)}
    ones, zeros = word_odds(s, y)
    frequent = np.bincount(np.unique(s["token_row"].astype(np.int64) * len(s["lo"]) + s["which"]) % len(s["lo"]), minlength=len(s["lo"])) >= net.word_texts
    vocabulary = s["hash"][frequent]  # sorted, as the distinct words are
    p["word"] = (g.standard_normal((len(vocabulary) + 1, net.word_dim)) * 0.1).astype(np.float32)
    p["word"][0] = 0
    odds = np.log((ones + 1) / (zeros + 1)).astype(np.float32)
    odds[np.abs(odds) * np.sqrt(ones + zeros) < net.significance] = 0  # what chance gives to a word in a few texts
    p["word"][1:, 0] = odds[frequent]

    own = {k: p[k] for k in ("char", "cwf", "cuf", "cbf", "cwb", "cub", "cbb")} | {"v": np.zeros((2 * net.char_hidden, 1), np.float32), "c": np.zeros(1, np.float32)}
    adam = Adam(own)
    marked = (odds > 0).astype(np.float32)
    some, rest = np.flatnonzero(marked), np.flatnonzero(odds <= 0)  # rare words too: a new text's words are mostly rare
    for turn in range(net.word_rounds if len(some) else 0):
        drawn = np.concatenate([rest, np.resize(some, len(rest) // net.word_balance + 1)])
        g.shuffle(drawn)
        for i in range(0, len(drawn), net.batch):
            part = drawn[i : i + net.batch]
            ends, cache = char_states(own, s["data"], s["lo"][part], s["hi"][part], net, True)
            d = ((_sigmoid((ends @ own["v"])[:, 0] + own["c"]) - marked[part]) / len(part)).astype(np.float32)[:, None]
            adam.update({"v": ends.T @ d, "c": d.sum(0)} | _char_backward(own, d @ own["v"].T, cache, net), net.rate * (1 - turn / net.word_rounds))

    adam = Adam({k: v for k, v in p.items() if k not in own})  # the characters are learnt
    p["vocabulary"] = vocabulary
    s["bucket"] = scorer.known(s["hash"])
    by_word = np.append(odds[s["which"]], -np.inf)
    logit = np.max(np.where(np.arange(net.window)[:, None] < s["length"], by_word[np.minimum(s["at"] + np.arange(net.window)[:, None], len(by_word) - 1)], -np.inf), 0)
    target = y[row].astype(np.float32)
    clean = np.flatnonzero(target == 0)
    for turn in range(net.rounds):
        top = np.full(len(y), -np.inf, np.float32)
        np.maximum.at(top, row, logit)
        sure = np.quantile(logit[clean], 0.999)
        positive = np.flatnonzero((target == 1) & ((logit > sure) | (turn > 0) & (logit >= top[row])))
        if not len(positive):
            positive = np.flatnonzero((target == 1) & (logit >= top[row]))
        hard = clean[np.argsort(-logit[clean], kind="stable")[: len(positive)]]
        chosen = np.concatenate([positive, np.union1d(hard, g.choice(clean, min(2 * len(positive), len(clean)), replace=False))])
        for _ in range(max(2, net.least_steps * net.batch // len(chosen))):
            g.shuffle(chosen)
            for i in range(0, len(chosen), net.batch):
                part = chosen[i : i + net.batch]
                ids, mask = scorer.ids(s, part)
                words, local = np.unique(ids, return_inverse=True)
                seen = np.where(g.random(len(words)) < net.word_dropout, 0, s["bucket"][words])
                distinct = (s["data"], s["lo"][words], s["hi"][words], seen)
                weight = np.where(target[part] == 1, (len(chosen) - len(positive)) / len(positive), 1.0)
                adam.update(loss_gradients(p, local.reshape(ids.shape), mask, distinct, target[part], weight, net, chars=False)[1], net.rate * (1 - turn / (net.rounds + 1)))
        logit = scorer.logits(s)
    top = np.full(len(y), -30.0, np.float32)  # over all windows, as texts are scored
    for i in range(0, len(y), 64):
        s = Scorer(p, net).prepare(column.slice(i, 64))
        np.maximum.at(top, s["row"] + i, Scorer(p, net).logits(s))
    return p | {"shift": np.array([_threshold(top, y)], np.float32)}


def _threshold(top: np.ndarray, y: np.ndarray) -> float:
    """The logit between the classes with the least balanced error, within its gap nearer to class 0."""
    order = np.argsort(top, kind="stable")
    ranked, is_one = top[order], y[order]
    missed = np.concatenate([[0], np.cumsum(is_one)]) / max(is_one.sum(), 1)
    false = (len(y) - is_one.sum() - np.concatenate([[0], np.cumsum(1 - is_one)])) / max((1 - is_one).sum(), 1)
    cost = missed + false
    best = np.flatnonzero(cost <= cost.min() + 1e-12)
    k = int(best[len(best) // 2])
    lo = ranked[k - 1] if k else ranked[0] - 2
    hi = ranked[k] if k < len(ranked) else ranked[-1] + 2
    return float(lo + 0.3 * (hi - lo))


def training_sample(docs: DataFrame, labels: DataFrame, net: Net) -> tuple[list[str], list[int]]:
    """At most ``sample`` labelled texts of class 1 and ``sample * clean_times`` of class 0, the least by hash of the doc_id."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("y"))
    text = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text")).where(F.length("text").between(1, net.sample_chars))
    names = text.select("doc_id").distinct().join(known, "doc_id").withColumn("o", F.md5(F.concat(F.lit(f"{net.seed}|"), F.col("doc_id").cast("string"))))
    chosen = names.where("y = 1").orderBy("o", "doc_id").limit(net.sample).unionAll(names.where("y = 0").orderBy("o", "doc_id").limit(net.sample * net.clean_times)).select("doc_id", "y")
    rows = text.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("y").alias("y")).collect()
    rows.sort(key=lambda r: r["doc_id"])
    return [r["text"] for r in rows], [r["y"] for r in rows]


def fit(docs: DataFrame, labels: DataFrame, net: Net = Net()) -> dict[str, np.ndarray] | float:
    """The model, or the share of class 1 where a class has no rows."""
    texts, y = training_sample(docs, labels, net)
    if not y or min(y) == max(y):
        return float(y[0]) if y else 0.0
    kept = {y[i] for i in first_copies(texts)}
    return train(texts, y, net) if len(kept) > 1 else float(sum(y)) / len(y)


def score(docs: DataFrame, model: dict | float, net: Net = Net(), keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns in ``keep``, score and n_windows of every row.

    Where ``keep`` has a column of such a name, in any case of letters, the new one gets a number: score_1.  The two new columns are the last.
    """
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)  # the network's size is fixed

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        scorer = Scorer(p, net) if isinstance(p, dict) else None
        for part in chunks(batches, "text"):
            n = part.num_rows
            if scorer is None:
                value, count = np.full(n, p), np.zeros(n, np.int64)
            else:
                texts = pc.fill_null(part.column("text"), "").dictionary_encode()  # copies side by side are scored once
                which, own = np.asarray(texts.indices), len(texts.dictionary)
                s = scorer.prepare(texts.dictionary)
                top = np.full(own, -30.0, np.float32)
                np.maximum.at(top, s["row"], scorer.logits(s))
                value, count = _sigmoid(top.astype(np.float64) - p["shift"][0])[which], np.bincount(s["row"], minlength=own)[which]
            names = part.schema.names[1:]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(value, pa.float64()), pa.array(count, pa.int64())], names=[*names, "score", "n_windows"])

    carried = {"doc_id": docs["doc_id"].cast("long")} | {c: docs[c] for c in keep}
    inner = docs.select(docs["text"].alias("text"), *(x.alias(f"k{i}") for i, x in enumerate(carried.values())))
    schema = T.StructType([*inner.schema.fields[1:], T.StructField("score", T.DoubleType()), T.StructField("n_windows", T.LongType())])
    out = inner.mapInArrow(run, schema)
    return out.select(*(F.col(f"k{i}").alias(c) for i, c in enumerate(carried)), *(F.col(c).alias(n) for c, n in zip(("score", "n_windows"), unused(carried, "score", "n_windows"), strict=True)))


def held_out(doc_id):
    """Rows that labels are never learnt from: crc32 of the doc_id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))
