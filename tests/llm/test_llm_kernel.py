"""The subsequence kernel of the toxicity machine against one that walks all letter triples."""

from itertools import combinations

import numpy as np
import pyarrow as pa

from sessionloom.llm import toxicity as tx

WORDS = ["idiot", "idxiot", "loser", "looser", "trash", "a", "ab", "abc", "thanwhenever", "aaaaaaa", "abcabcabcabc"]


def codes(word):
    return bytes(ord(c) - 97 for c in word)


def naive_map(word):
    """Weight of each three-letter subsequence."""
    out = {}
    for p, q, r in combinations(range(len(word)), 3):
        if r - p < tx.SPAN:
            sub = word[p] + word[q] + word[r]
            out[sub] = out.get(sub, 0.0) + tx.DECAY ** (r - p)
    return out


def naive_scale(length):
    """The length factor: the norm of a word whose subsequences all differ."""
    if length < 3:
        return 1.0
    return sum(tx.DECAY ** (2 * (r - p)) for p, q, r in combinations(range(length), 3) if r - p < tx.SPAN) ** 0.5


def naive_kernel(a, b):
    x, y = naive_map(a), naive_map(b)
    return sum(v * y.get(s, 0.0) for s, v in x.items()) / naive_scale(len(a)) / naive_scale(len(b))


def _dense(words):
    kinds, owner, place, weight = tx._features([codes(w) for w in words])
    phi = np.zeros((len(words), len(kinds)))
    np.add.at(phi, (owner, place), weight)
    return kinds, phi


def test_features_span_the_kernel():
    _, phi = _dense(WORDS)
    ratio = []
    for i, a in enumerate(WORDS):
        for j, b in enumerate(WORDS):
            want = naive_kernel(a, b)
            if want:
                ratio.append(phi[i] @ phi[j] / want)
            else:
                assert phi[i] @ phi[j] == 0
    assert np.allclose(ratio, ratio[0])  # one factor for all: the weight of a span counts its first letter or not


def test_table_look_ups_equal_sums_of_kernels():
    kinds, phi = _dense(WORDS)
    alpha = np.random.default_rng(3).normal(size=len(WORDS))
    table = np.zeros(tx.LETTERS**3)
    table[kinds] = alpha @ phi
    texts = ["idoit", "thrash", "lover", "x", "abcabc"]
    letters = np.frombuffer(b"".join(codes(t) for t in texts), np.uint8)
    size = np.array([len(t) for t in texts])
    got = tx._decisions(letters, np.cumsum(size) - size, size, table, 0.25)
    both = _dense(WORDS + texts)[1]
    want = both[len(WORDS) :] @ both[: len(WORDS)].T @ alpha + 0.25
    assert np.allclose(got, want)


def test_landmarks_explain_the_training_words():
    """With a landmark per word the Nystroem machine is the kernel machine: it separates its training words."""
    words = [codes(w) for w in ("idiot", "idiots", "loser", "losers", "table", "garden", "window", "river")]
    toxic = np.array([True] * 4 + [False] * 4)
    table, bias = tx.train(words, toxic, np.full(8, 100.0))
    letters, size = np.frombuffer(b"".join(words), np.uint8), np.array([len(w) for w in words])
    value = tx._decisions(letters, np.cumsum(size) - size, size, table, bias)
    assert (value[:4] > 0.8).all() and (value[4:] < -0.8).all()
    near = [codes(w) for w in ("idxiot", "looser", "tabble", "wwindow")]
    letters, size = np.frombuffer(b"".join(near), np.uint8), np.array([len(w) for w in near])
    value = tx._decisions(letters, np.cumsum(size) - size, size, table, bias)
    assert (value[:2] > 0).all() and (value[2:] < 0).all()


def test_units_join_single_letters_and_window_long_words():
    column = pa.array(["i d i o t here", None, "", "x" * 40])
    letters, first, size, text = tx.units(column)
    read = [(t, bytes(letters[f : f + s] + 97).decode()) for f, s, t in zip(first, size, text)]
    assert read[:2] == [(0, "idiot"), (0, "here")]
    assert all(t == 3 and set(w) == {"x"} and len(w) <= tx.WINDOW for t, w in read[2:]) and len(read) == 2 + 4
