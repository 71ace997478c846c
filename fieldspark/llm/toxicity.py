"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained and run in numpy.

A word enters as a learned vector of its own (one for all words that few training documents hold) beside the mean
vector of its character trigrams.  Windows of
WINDOW words start every STRIDE words, the last one ends at the last word, so all words of a text are read; a text's
score is a logistic curve over its highest window and its number of windows.

Training knows only document labels: windows of clean documents are clean, and of a toxic document the window that
scores highest so far stands for it; in the first round those that hold its word with the highest odds of being
found in a toxic document rather than in a clean one.

Edge cases: null and empty texts are one window of padding; ties and repeated rows are scored one by one; with fewer
than MIN_FIT documents of a class every score is 0.5; an empty table gives an empty result; other columns are passed
on by `score`, its output columns win over theirs.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldspark.llm import labelled

WINDOW, STRIDE = 32, 16
HIDDEN, WORD_DIM, CHAR_DIM = 8, 12, 12
CHAR_BUCKETS = 1 << 13
#: Training documents that must hold a word before it gets a vector of its own, and most such words.
MIN_DOCUMENTS, MOST_WORDS = 3, 1 << 15
#: Labelled rows of each class to learn from; the sample that reaches the driver is never larger.
PER_CLASS = 900
#: Windows of one document that training looks at, drawn at random from all of it.
TRAIN_WINDOWS = 40
MIN_FIT = 8
#: Training steps of a round at least; small samples are passed over again.
MIN_STEPS = 60
#: Windows scored together, and word vectors a task keeps.
BATCH_WINDOWS, KEPT_WORDS = 4096, 200_000

_EDGES = re.compile(r"^\W+|\W+$")


def words_of(text: str | None) -> list[str]:
    return (text or "").lower().split()


def window_starts(n: int) -> np.ndarray:
    """First words of the windows of n words."""
    if n <= WINDOW:
        return np.zeros(1, np.int64)
    starts = np.arange(0, n - WINDOW + 1, STRIDE)
    return starts if starts[-1] + WINDOW == n else np.append(starts, n - WINDOW)


def bare(word: str) -> str:
    return _EDGES.sub("", word) or word


def features(words: list[str], vocabulary: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word numbers, trigram buckets of all words in a row, and where each word's trigrams begin."""
    plain = [bare(w) for w in words]
    word = np.fromiter((vocabulary.get(w, 0) for w in plain), np.int64, len(plain))
    plain = [b"^" + w.encode("utf-8", "surrogatepass") + b"$$" for w in plain]
    size = np.fromiter(map(len, plain), np.int64, len(plain))
    b = np.frombuffer(b"".join(plain) + b"\0\0", np.uint8).astype(np.uint32)
    code = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
    begin = np.cumsum(size) - size
    inside = np.ones(len(code), bool)
    last = begin + size - 1
    inside[last] = inside[last - 1] = False
    bucket = ((code * np.uint32(2654435761)) >> np.uint32(19)).astype(np.int64)
    return word, bucket[inside], begin - 2 * np.arange(len(plain))


def sigmoid(x):
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Network:
    """Parameters p; inputs are windows of word numbers, -1 for padding."""

    def __init__(self, vocabulary: dict[str, int], seed: int = 7):
        self.vocabulary = vocabulary
        r = np.random.default_rng(seed)
        d, h = WORD_DIM + CHAR_DIM, HIDDEN
        init = lambda *s: (r.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.p = {
            "word": (r.standard_normal((len(vocabulary) + 1, WORD_DIM)) * 0.1).astype(np.float32),
            "char": (r.standard_normal((CHAR_BUCKETS, CHAR_DIM)) * 0.1).astype(np.float32),
            "w": init(d, 6 * h),
            "b": np.zeros(6 * h, np.float32),
            "uf": init(h, 3 * h),
            "ub": init(h, 3 * h),
            "pad": np.zeros(6 * h, np.float32),
            "att": init(2 * h),
            "out": init(2 * h),
            "bias": np.zeros(1, np.float32),
        }
        self.curve: tuple[float, ...] = (1.0, 0.0, 0.0)

    def inputs(self, word, chars, begin):
        p = self.p
        c = np.add.reduceat(p["char"][chars], begin, axis=0)
        n = np.diff(np.append(begin, len(chars)))[:, None]
        return np.concatenate([p["word"][word], c / n.astype(np.float32)], axis=1)

    def gates(self, word, chars, begin):
        """What each word adds to the six gates, 3 of either direction."""
        return self.inputs(word, chars, begin) @ self.p["w"] + self.p["b"]

    @staticmethod
    def _run(g, u, order, keep):
        h, states, kept = np.zeros((g.shape[1], HIDDEN), np.float32), [None] * len(g), [None] * len(g)
        for t in order:
            a = h @ u
            x = g[t]
            zr = sigmoid(x[:, : 2 * HIDDEN] + a[:, : 2 * HIDDEN])
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            n = np.tanh(x[:, 2 * HIDDEN :] + r * a[:, 2 * HIDDEN :])
            if keep:
                kept[t] = (h, z, r, n, a[:, 2 * HIDDEN :])
            h = n + z * (h - n)
            states[t] = h
        return states, kept

    def forward(self, g, pad, keep=False):
        """Log odds of windows; g: steps x windows x 6 HIDDEN, pad: steps x windows."""
        p, t = self.p, range(len(g))
        f, kf = self._run(g[:, :, : 3 * HIDDEN], p["uf"], t, keep)
        b, kb = self._run(g[:, :, 3 * HIDDEN :], p["ub"], reversed(t), keep)
        f, b = np.stack(f), np.stack(b)
        e = f @ p["att"][:HIDDEN] + b @ p["att"][HIDDEN:]
        e[pad] = -30
        e = np.exp(e - e.max(0))
        alpha = e / e.sum(0)
        pooled = np.concatenate([np.einsum("tn,tnh->nh", alpha, s) for s in (f, b)], axis=1)
        return pooled @ p["out"] + p["bias"][0], (f, b, kf, kb, alpha, pooled)

    @staticmethod
    def _back(d, u, kept, order):
        """Gradients of the inputs and of u; d: gradient of every state."""
        dg, du = np.empty((len(d), d.shape[1], 3 * HIDDEN), np.float32), np.zeros_like(u)
        dh = np.zeros_like(d[0])
        for t in order:
            h, z, r, n, a = kept[t]
            dh = dh + d[t]
            dn = dh * (1 - z) * (1 - n * n)
            dz = dh * (h - n) * z * (1 - z)
            dr = dn * a * r * (1 - r)
            dg[t] = np.concatenate([dz, dr, dn], axis=1)
            da = np.concatenate([dz, dr, dn * r], axis=1)
            du += h.T @ da
            dh = dh * z + da @ u.T
        return dg, du

    def step(self, words, windows, y, weight, rate, state):
        """One Adam step on windows of places in the feature lists `words`."""
        p = self.p
        used, places = np.unique(windows[windows >= 0], return_inverse=True)
        local = np.full(windows.shape, len(used))
        local[windows >= 0] = places
        word, lists = words[0][used], [words[1][i] for i in used]
        size = np.fromiter(map(len, lists), np.int64, len(lists))
        chars, begin = np.concatenate(lists) if lists else np.zeros(0, np.int64), np.cumsum(size) - size
        x = self.inputs(word, chars, begin) if lists else np.zeros((0, WORD_DIM + CHAR_DIM), np.float32)
        g = np.concatenate([x @ p["w"] + p["b"], p["pad"][None]])[local.T]
        logit, (f, b, kf, kb, alpha, pooled) = self.forward(g, windows.T < 0, True)
        d = (weight * (sigmoid(logit) - y) / len(y)).astype(np.float32)
        grad = {"out": pooled.T @ d, "bias": np.array([d.sum()], np.float32)}
        dpool = d[:, None] * p["out"]
        dalpha = np.einsum("nh,tnh->tn", dpool[:, :HIDDEN], f) + np.einsum("nh,tnh->tn", dpool[:, HIDDEN:], b)
        de = alpha * (dalpha - (alpha * dalpha).sum(0))
        grad["att"] = np.concatenate([np.einsum("tn,tnh->h", de, f), np.einsum("tn,tnh->h", de, b)])
        df = alpha[:, :, None] * dpool[:, :HIDDEN] + de[:, :, None] * p["att"][:HIDDEN]
        db = alpha[:, :, None] * dpool[:, HIDDEN:] + de[:, :, None] * p["att"][HIDDEN:]
        gf, grad["uf"] = self._back(df, p["uf"], kf, reversed(range(len(g))))
        gb, grad["ub"] = self._back(db, p["ub"], kb, range(len(g)))
        flat = np.concatenate([gf, gb], axis=2).reshape(-1, 6 * HIDDEN)
        where = local.T.reshape(-1)
        order = np.argsort(where, kind="stable")
        seen, at = np.unique(where[order], return_index=True)
        dx = np.zeros((len(used) + 1, 6 * HIDDEN), np.float32)
        dx[seen] = np.add.reduceat(flat[order], at, axis=0)
        grad["pad"], dx = dx[-1], dx[:-1]
        grad["w"], grad["b"] = x.T @ dx, dx.sum(0)
        into = dx @ p["w"].T
        for k, v in grad.items():
            m, s = state.setdefault(k, (np.zeros_like(p[k]), np.zeros_like(p[k])))
            m += 0.1 * (v - m)
            s += 0.02 * (v * v - s)
            p[k] -= rate * m / (np.sqrt(s) + 1e-7)
        for k, rows, v in (
            ("word", word, into[:, :WORD_DIM]),
            ("char", chars, np.repeat(into[:, WORD_DIM:] / np.maximum(size, 1)[:, None], size, axis=0)),
        ):
            total = state.setdefault(k, np.full(len(p[k]), 1e-8, np.float32))
            order = np.argsort(rows, kind="stable")
            seen, at = np.unique(rows[order], return_index=True)
            if len(seen):
                v = np.add.reduceat(v[order], at, axis=0)
                total[seen] += (v * v).mean(1)
                p[k][seen] -= 3 * rate * v / np.sqrt(total[seen])[:, None]


class Reader:
    """Texts to log odds of windows, with the gate inputs of words seen before kept."""

    def __init__(self, net: Network):
        self.net, self.numbers, self.used = net, {}, 0
        self.table = np.empty((KEPT_WORDS + 2, 6 * HIDDEN), np.float32)

    def _rows(self, words: list[str]) -> np.ndarray:
        """Gate inputs of words that are looked up in one go: their rows in `table`, or in `extra` after it."""
        get = self.numbers.get
        at = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        new = list(dict.fromkeys(words[i] for i in np.flatnonzero(at < 0)))
        self.extra = np.empty((0, 6 * HIDDEN), np.float32)
        if new:
            g = self.net.gates(*features(new, self.net.vocabulary))
            room = min(len(new), KEPT_WORDS - self.used)
            self.table[self.used : self.used + room] = g[:room]
            self.numbers.update(zip(new[:room], range(self.used, self.used + room), strict=True))
            self.used += room
            self.extra = g[room:]
            late = {w: KEPT_WORDS + 1 + i for i, w in enumerate(new[room:])}
            for i in np.flatnonzero(at < 0):
                at[i] = late.get(words[i], -1) if late else -1
                if at[i] < 0:
                    at[i] = self.numbers[words[i]]
        return at

    def log_odds(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """The highest log odds and the number of windows of each text."""
        best, count = np.full(len(texts), -np.inf), np.zeros(len(texts), np.int64)
        i = 0
        while i < len(texts):
            # As many texts as fill a batch; a very long one is read alone, batch after batch.
            words, starts, owner, base = [], [], [], 0
            first = i
            while i < len(texts) and (base == 0 or base < BATCH_WINDOWS * STRIDE):
                w = words_of(texts[i])
                s = window_starts(len(w))
                words.append(w)
                starts.append(s + base)
                owner.append(np.full(len(s), i))
                count[i] = len(s)
                base += len(w)
                i += 1
            at = self._rows([x for w in words for x in w])
            ends = np.repeat(np.cumsum([len(w) for w in words]), [len(s) for s in starts])
            starts, owner = np.concatenate(starts), np.concatenate(owner)
            self.table[KEPT_WORDS] = self.net.p["pad"]
            table = np.concatenate([self.table[: KEPT_WORDS + 1], self.extra]) if len(self.extra) else self.table
            for k in range(0, len(starts), BATCH_WINDOWS):
                place = np.arange(WINDOW)[:, None] + starts[None, k : k + BATCH_WINDOWS]
                pad = place >= ends[None, k : k + BATCH_WINDOWS]
                row = np.where(pad, KEPT_WORDS, at[np.minimum(place, len(at) - 1)] if len(at) else KEPT_WORDS)
                logit, _ = self.net.forward(table[row], pad)
                np.maximum.at(best, owner[k : k + BATCH_WINDOWS], logit)
            del words, first
        return best, count


def fit(rows: list[tuple[str, int]], prior: float = 0.5, rounds: int = 5, seed: int = 7) -> Network | None:
    """The network from three quarters of the rows, the curve over a document's windows from the others.

    prior: the share of toxic documents among those to be scored."""
    if min(sum(y == k for _, y in rows) for k in (0, 1)) < MIN_FIT:
        return None
    build = [r for i, r in enumerate(rows) if i % 4]
    tune = [r for i, r in enumerate(rows) if not i % 4]
    r = np.random.default_rng(seed)
    numbers: dict[str, int] = {}
    windows, owner = [], []
    for d, (text, _) in enumerate(build):
        at = np.array([numbers.setdefault(w, len(numbers)) for w in words_of(text)], np.int64)
        starts = window_starts(len(at))
        for s in r.permutation(starts)[:TRAIN_WINDOWS]:
            own = at[s : s + WINDOW]
            windows.append(np.pad(own, (0, WINDOW - len(own)), constant_values=-1))
            owner.append(d)
    windows, owner = np.stack(windows), np.array(owner)
    held = Counter(w for text, _ in build for w in {bare(x) for x in words_of(text)})
    frequent = [w for w, n in held.most_common(MOST_WORDS) if n >= MIN_DOCUMENTS]
    vocabulary = {w: i + 1 for i, w in enumerate(sorted(frequent))}
    odds = _odds(build, vocabulary)
    word_odds = np.array([odds.get(bare(w), 0.0) for w in numbers] + [0.0])
    word, chars, begin = features(list(numbers), vocabulary) if numbers else (np.zeros(0, int), np.zeros(0, int), np.zeros(0, int))
    words = (word, np.split(chars, begin[1:]) if len(begin) else [])
    toxic = np.array([y for _, y in build])[owner] == 1
    net, state = Network(vocabulary, seed), {}
    for k in range(rounds):
        clean = np.flatnonzero(~toxic)
        if k == 0:
            most = word_odds[windows].max(1)
            top = pd.Series(most).groupby(owner).transform("max").to_numpy()
            best = np.flatnonzero(toxic & (most >= 0.7 * top))
            use = np.concatenate([best, r.permutation(clean)[: 8 * len(best)]])
        else:
            logit = np.concatenate([_window_odds(net, words, windows[i : i + 4096]) for i in range(0, len(windows), 4096)])
            best = pd.Series(np.where(toxic, logit, -np.inf)).groupby(owner).idxmax().to_numpy()
            best = best[toxic[best]]
            hard = clean[np.argsort(-logit[clean])[: 4 * len(best)]]
            use = np.concatenate([np.repeat(best, 3), hard, r.permutation(clean)[: 4 * len(best)]])
        y = toxic[use].astype(np.float32)
        weight = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum())) * len(y)
        passes = max(1, MIN_STEPS * 256 // len(use))
        order = np.concatenate([r.permutation(len(use)) for _ in range(min(passes, 40))])
        for i in range(0, len(order), 256):
            b = order[i : i + 256]
            net.step(words, windows[use[b]], y[b], weight[b], 0.01 / (1 + 0.5 * k), state)
    best, count = Reader(net).log_odds([t for t, _ in tune])
    x = np.column_stack([best, np.log(count)])
    a, b, c = labelled.logistic(x, np.array([y for _, y in tune]))
    prior = min(max(prior, 1e-3), 1 - 1e-3)
    net.curve = (a, b, c + np.log(prior / (1 - prior)))
    return net


def _odds(rows: list[tuple[str, int]], vocabulary: dict[str, int]) -> dict[str, float]:
    """Log odds of a frequent word being held by a toxic document, against a clean one."""
    held = [Counter(w for text, y in rows if y == k for w in {bare(x) for x in words_of(text)}) for k in (0, 1)]
    n = [sum(y == k for _, y in rows) for k in (0, 1)]
    share = lambda w, k: (held[k][w] + 0.5) / (n[k] + 1)
    return {w: float(np.log(share(w, 1) / share(w, 0))) for w in vocabulary}


def _window_odds(net: Network, words, windows) -> np.ndarray:
    used, places = np.unique(windows[windows >= 0], return_inverse=True)
    local = np.full(windows.shape, len(used))
    local[windows >= 0] = places
    lists = [words[1][i] for i in used]
    size = np.fromiter(map(len, lists), np.int64, len(lists))
    g = net.gates(words[0][used], np.concatenate(lists), np.cumsum(size) - size) if lists else np.zeros((0, 6 * HIDDEN))
    return net.forward(np.concatenate([g, net.p["pad"][None]])[local.T].astype(np.float32), windows.T < 0)[0]


def score(docs: DataFrame, net: Network | None, threshold: float = 0.3, text: str = "text") -> DataFrame:
    """docs with score (0 to 1), predicted and the number of windows read; one pass, no shuffle."""
    if net is None:
        return docs.withColumns(
            {"score": F.lit(0.5), "predicted": F.lit(int(threshold <= 0.5)), "n_windows": F.lit(None).cast("long")}
        )
    shipped = docs.sparkSession.sparkContext.broadcast(net)

    @F.pandas_udf("score double, n_windows long")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        reader = Reader(shipped.value)
        a, b, c = reader.net.curve
        for texts in batches:
            best, count = reader.log_odds(list(texts))
            yield pd.DataFrame({"score": sigmoid(a * best + b * np.log(count) + c), "n_windows": count})

    return (
        docs.withColumn("__scored", scored(F.col(text)))
        .withColumns({"score": F.col("__scored.score"), "n_windows": F.col("__scored.n_windows")})
        .drop("__scored")
        .withColumn("predicted", (F.col("score") >= threshold).cast("int"))
    )
