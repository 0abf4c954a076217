"""Operator 8: toxicity by a bidirectional gated recurrent network, in numpy.

A word enters as its own vector (words that the training texts lack share one) and
as the vectors of its hashed character n-grams: its beginnings of four, five and six
characters and its last four.  Two gated recurrent layers
read a window in both directions, attention pools their states, and a logistic
unit gives the window's score.  All overlapping windows of a text are scored; the
text's score is that of its worst window.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_crc, keyed
from .tokens import batches

WINDOW, STRIDE = 64, 48
WORD, CHAR, HIDDEN, ATTEND = 12, 12, 12, 12
CHAR_BUCKETS = 1 << 15
VOCABULARY = 20_000
MARKS = ".,;:!?\"'()[]{}*#$%&|<>-_"

Params = dict[str, np.ndarray]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def plain_word(word: str) -> str:
    return word.lower().strip(MARKS)


class Words:
    """Numbers of words and their character trigrams, as far as training saw them."""

    def __init__(self, texts: list[str], least: int = 8) -> None:
        seen = Counter(w for t in texts for w in {plain_word(w) for w in t.split()})
        known = sorted((w for w, n in seen.items() if n >= least and w), key=lambda w: (-seen[w], w))[:VOCABULARY]
        self.number = {w: i + 1 for i, w in enumerate(known)}

    def __len__(self) -> int:
        return len(self.number) + 1

    def features(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers, and the buckets of each word's character n-grams."""
        plain = [plain_word(w) for w in words]
        ids = np.array([self.number.get(w, 0) for w in plain], np.int64)
        return ids, np.array([char_grams(w) for w in plain], np.int64).reshape(len(words), 4)


def char_grams(word: str) -> tuple[int, int, int, int]:
    raw = (word[:4], word[:5] + "^", word[:6] + "^^", word[-4:] + "$")
    return tuple(crc32(g.encode("utf-8", "surrogatepass")) % CHAR_BUCKETS for g in raw)


def windows_of(n: int) -> list[int]:
    """Starts of the overlapping windows of a text of n words; the last one ends with the text."""
    if n <= WINDOW:
        return [0]
    return [*range(0, n - WINDOW, STRIDE), n - WINDOW]


def initial(words: int, seed: int) -> Params:
    rng = np.random.default_rng(seed)
    d, h = WORD + CHAR, HIDDEN
    p = {"ew": rng.normal(0, 0.1, (words, WORD)), "ec": rng.normal(0, 0.1, (CHAR_BUCKETS, CHAR))}
    for s in "fb":
        p |= {f"w{s}": rng.normal(0, d**-0.5, (d, 3 * h)), f"u{s}": rng.normal(0, h**-0.5, (h, 3 * h)), f"b{s}": np.zeros(3 * h)}
    p |= {"wa": rng.normal(0, (2 * h) ** -0.5, (2 * h, ATTEND)), "ba": np.zeros(ATTEND), "va": rng.normal(0, ATTEND**-0.5, ATTEND), "wo": rng.normal(0, (2 * h) ** -0.5, 2 * h), "bo": np.full(1, -1.0)}
    return {k: v.astype(np.float32) for k, v in p.items()}


def recur(x: np.ndarray, u: np.ndarray, mask: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
    """States (time, batch, hidden) of a gated layer; x has the gates' inputs z, r, n."""
    t, b, _ = x.shape
    k = HIDDEN
    h = np.zeros((b, k), np.float32)
    out, tape = np.empty((t, b, k), np.float32), []
    for i in range(t):
        hu = h @ u
        zr = _sigmoid(x[i, :, :2 * k] + hu[:, :2 * k])
        z, r = zr[:, :k], zr[:, k:]
        n = np.tanh(x[i, :, 2 * k:] + r * hu[:, 2 * k:])
        new = n + z * (h - n)
        if keep:
            tape.append((h, z, r, n, hu[:, 2 * k:]))
        h = h + mask[i][:, None] * (new - h)
        out[i] = h
    return out, tape


def recur_back(grad: np.ndarray, u: np.ndarray, mask: np.ndarray, tape: list) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the gates' inputs and of u."""
    t, b, k = grad.shape
    dx, du, dh = np.zeros((t, b, 3 * k), np.float32), np.zeros_like(u), np.zeros((b, k), np.float32)
    for i in range(t - 1, -1, -1):
        h, z, r, n, hn = tape[i]
        m = mask[i][:, None]
        g = dh + grad[i]
        new = g * m
        dn = new * (1 - z) * (1 - n * n)
        dz = new * (h - n) * z * (1 - z)
        dr = dn * hn * r * (1 - r)
        dx[i] = np.concatenate([dz, dr, dn], 1)
        dhu = np.concatenate([dz, dr, dn * r], 1)
        du += h.T @ dhu
        dh = g * (1 - m) + new * z + dhu @ u.T
    return dx, du


def pool(p: Params, s: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, ...]:
    a = np.tanh(s @ p["wa"] + p["ba"])
    e = np.where(mask > 0, a @ p["va"], -1e9)
    w = np.exp(e - e.max(0))
    w /= w.sum(0)
    c = (w[:, :, None] * s).sum(0)
    return c @ p["wo"] + p["bo"][0], a, w, c


def gate_inputs(p: Params, words: Words, vocabulary: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words' input vectors, their numbers and n-grams."""
    ids, grams = words.features(vocabulary)
    return np.concatenate([p["ew"][ids], p["ec"][grams].sum(1)], 1).astype(np.float32), ids, grams


def scores(p: Params, words: Words, vocabulary: list[str], codes: np.ndarray, mask: np.ndarray, block: int = 1024) -> np.ndarray:
    """Logits of windows: codes (window, time) are places in the vocabulary."""
    x = gate_inputs(p, words, vocabulary)[0]
    gates = {s: (x @ p[f"w{s}"] + p[f"b{s}"]).astype(np.float32) for s in "fb"}
    out = np.empty(len(codes), np.float32)
    for a in range(0, len(codes), block):
        c, m = codes[a:a + block].T, mask[a:a + block].T.astype(np.float32)
        f, _ = recur(gates["f"][c], p["uf"], m, False)
        b, _ = recur(gates["b"][c[::-1]], p["ub"], m[::-1], False)
        out[a:a + block] = pool(p, np.concatenate([f, b[::-1]], 2), m)[0]
    return out


def learn(p: Params, words: Words, vocabulary: list[str], codes: np.ndarray, mask: np.ndarray, label: np.ndarray) -> Params:
    """Gradients of the mean logistic loss over a batch of windows."""
    used, codes = np.unique(codes, return_inverse=True)
    codes = codes.reshape(mask.shape)
    x, ids, grams = gate_inputs(p, words, [vocabulary[i] for i in used])
    c, m = codes.T, mask.T.astype(np.float32)
    f, tf = recur((x @ p["wf"] + p["bf"])[c], p["uf"], m, True)
    b, tb = recur((x @ p["wb"] + p["bb"])[c[::-1]], p["ub"], m[::-1], True)
    s = np.concatenate([f, b[::-1]], 2)
    logit, a, w, pooled = pool(p, s, m)
    d = ((_sigmoid(logit) - label) / len(label)).astype(np.float32)
    g: Params = {"bo": np.array([d.sum()]), "wo": pooled.T @ d}
    dc = d[:, None] * p["wo"]
    ds = w[:, :, None] * dc
    dw = (dc * s).sum(2)
    de = w * (dw - (w * dw).sum(0))
    da = de[:, :, None] * p["va"] * (1 - a * a)
    g |= {"va": np.tensordot(de, a, ((0, 1), (0, 1))), "wa": np.tensordot(s, da, ((0, 1), (0, 1))), "ba": da.sum((0, 1))}
    ds = ds + da @ p["wa"].T
    dx = np.zeros_like(x)
    k = HIDDEN
    for name, part, tape, cc, mm in (("f", ds[:, :, :k], tf, c, m), ("b", ds[::-1, :, k:], tb, c[::-1], m[::-1])):
        gates, g[f"u{name}"] = recur_back(part, p[f"u{name}"], mm, tape)
        per_word = np.zeros((len(x), 3 * k), np.float32)
        np.add.at(per_word, cc.ravel(), gates.reshape(-1, 3 * k))
        g |= {f"w{name}": x.T @ per_word, f"b{name}": per_word.sum(0)}
        dx += per_word @ p[f"w{name}"].T
    g["ew"], g["ec"] = np.zeros_like(p["ew"]), np.zeros_like(p["ec"])
    np.add.at(g["ew"], ids, dx[:, :WORD])
    np.add.at(g["ec"], grams, dx[:, None, WORD:])
    return g


def cut(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Vocabulary, windows' codes and masks, and the text of each window."""
    parts = [t.split() or [""] for t in texts]
    flat = pa.array([w for x in parts for w in x], pa.large_string()).dictionary_encode()
    code = flat.indices.to_numpy().astype(np.int64)
    starts, ends, owner = [], [], []
    at = 0
    for i, x in enumerate(parts):
        for s in windows_of(len(x)):
            starts.append(at + s)
            ends.append(min(at + s + WINDOW, at + len(x)))
            owner.append(i)
        at += len(x)
    place = np.array(starts)[:, None] + np.arange(WINDOW)
    mask = place < np.array(ends)[:, None]
    return flat.dictionary.to_pylist(), code[np.where(mask, place, 0)], mask, np.array(owner)


def evidence(rows: list[tuple[str, int]], parts: Callable[[str], set]) -> dict:
    """How much more often toxic training texts have each part than clean ones, in
    tens of standard errors, from -1 to 2."""
    seen = Counter(), Counter()
    for t, y in rows:
        seen[y].update(parts(t))
    total = [max(1, sum(1 for _, y in rows if y == label)) for label in (0, 1)]
    out = {}
    for x in seen[1].keys() | seen[0].keys():
        n0, n1 = seen[0][x], seen[1][x]
        p = (n0 + n1 + 1) / (sum(total) + 2)
        z = (n1 / total[1] - n0 / total[0]) / (p * (1 - p) * (1 / total[0] + 1 / total[1])) ** 0.5
        out[x] = min(2.0, max(-1.0, z / 10))
    return out


def train(rows: list[tuple[str, int]], epochs: int = 4, batch: int = 64, rate: float = 0.01, decay: float = 0.1, drop: float = 0.15, floor: float = 1e-4, clean: int = 8, seed: int = 3) -> tuple[Params, Words]:
    """Fit by Adam with decaying vectors.  A toxic text teaches by its worst window
    so far (in the first epoch, the one whose words have the highest odds), a clean
    one by its windows; words drop out at random."""
    words = Words([t for t, _ in rows])
    p = initial(len(words), seed)
    by_word = evidence(rows, lambda t: {plain_word(w) for w in t.split()})
    by_gram = evidence(rows, lambda t: {g for w in {plain_word(w) for w in t.split()} for g in char_grams(w)})
    for w, i in words.number.items():  # the first number of a vector starts at its evidence, the rest at random
        p["ew"][i, 0] = by_word.get(w, 0)
    p["ec"][[*by_gram], 0] = np.array([*by_gram.values()]) / 4
    vocabulary, codes, mask, owner = cut([t for t, _ in rows])
    toxic = np.array([y for _, y in rows])[owner] == 1
    rng = np.random.default_rng(seed)
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in p.items()}
    turn = 0
    for epoch in range(epochs):
        chosen = np.flatnonzero(~toxic)
        if toxic.any():
            bad = np.flatnonzero(toxic)
            if epoch == 0:
                known = p["ew"][:, 0][words.features(vocabulary)[0]] + p["ec"][:, 0][words.features(vocabulary)[1]].sum(1)
                rank = np.where(mask[bad], known[codes[bad]], -np.inf).max(1)
            else:
                rank = scores(p, words, vocabulary, codes[bad], mask[bad])
            best = pd.Series(rank).groupby(owner[bad]).idxmax().to_numpy()
            worst = bad[best]
            chosen = rng.permutation(chosen)[:max(clean * len(worst), 512)]
            chosen = np.concatenate([chosen, worst])
        chosen = rng.permutation(chosen)
        for a in range(0, len(chosen), batch):
            i = chosen[a:a + batch]
            held = mask[i] & (rng.random(mask[i].shape) > drop)
            held[:, 0] |= ~held.any(1)
            g = learn(p, words, vocabulary, codes[i], held, toxic[i].astype(np.float32))
            norm = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
            turn += 1
            step = rate * (1 - epoch / epochs) * np.sqrt(1 - 0.999**turn) / (1 - 0.9**turn)
            for k, v in g.items():
                v = v / max(1.0, norm)
                m1, m2 = moment[k]
                m1 += 0.1 * (v - m1)
                m2 += 0.001 * (v * v - m2)
                vectors = k in ("ew", "ec")  # what few windows move stays near zero
                p[k] -= (step * m1 / (np.sqrt(m2) + (floor if vectors else 1e-8))).astype(np.float32)
                if vectors:
                    p[k] *= np.float32(1 - step * decay)
    return p, words


def worst_logits(p: Params, words: Words, texts: list[str]) -> np.ndarray:
    """The worst window's logit of every text; windows are cut from the whole of it."""
    vocabulary, codes, mask, owner = cut(texts)
    logit = scores(p, words, vocabulary, codes, mask)
    worst = np.full(len(texts), -np.inf)
    np.maximum.at(worst, owner, logit)
    return worst.astype(np.float64)


def calibrate(logits: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope and offset that make the logits of whole texts fit the labels, by
    Newton's method with a weak pull towards slope 1 and offset 0."""
    w, x = np.array([1.0, 0.0]), np.stack([logits, np.ones(len(logits))], 1)
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (q - label) + 0.5 * (w - [1, 0])
        w -= np.linalg.solve((x * (q * (1 - q))[:, None]).T @ x + 0.5 * np.eye(2), grad)
    return (float(w[0]), float(w[1])) if np.isfinite(w).all() and w[0] > 0 else (1.0, 0.0)


def text_scores(model: tuple, texts: list[str]) -> np.ndarray:
    """Score of every text."""
    p, words, (slope, offset) = model
    return 1 / (1 + np.exp(-np.clip(slope * worst_logits(p, words, texts) + offset, -50, 50)))


def fit(rows: list[tuple[str, int]], whole: list[tuple[str, int]]) -> tuple[Params, Words, tuple[float, float]]:
    """Train on ``rows`` and calibrate on ``whole``, other rows of any length."""
    p, words = train(rows)
    if len({y for _, y in whole}) < 2:
        return p, words, (1.0, 0.0)
    return p, words, calibrate(worst_logits(p, words, [t for t, _ in whole]), np.array([y for _, y in whole]))


def labelled_rows(docs: DataFrame, labels: DataFrame, key: str, text: str, per_class: dict[int, int], words: int, calibrating: bool) -> list[tuple[str, int]]:
    """At most ``per_class`` rows of each label outside the held-out part, of at most
    ``words`` words (short texts say where the toxicity is), least hash first; a
    fourth of the keys is for calibration."""
    part = F.pmod(F.xxhash64(key), F.lit(4)) == 3
    labels = labels.filter(part if calibrating else ~part)
    label = labels.filter(F.col("toxic").isNotNull() & (id_crc(key) % 4 != 2)).select(F.col(key).alias("lk"), F.col("toxic").cast("int").alias("y"))
    out = []
    for y in (0, 1):
        chosen = label.filter(F.col("y") == y).orderBy(F.xxhash64("lk"), "lk").limit(8 * per_class[y])
        near = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).join(F.broadcast(chosen), F.col("k") == F.col("lk"))
        near = near.filter(F.length("t") <= 12 * words).orderBy(F.xxhash64("k"), "k").limit(per_class[y])
        out += [(r["t"], y) for r in near.select("t").collect() if r["t"] and len(r["t"].split()) <= words]
    return out


def score_toxicity(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.3, per_class: tuple[int, int] = (1600, 700), words: int = 400) -> DataFrame:
    """Score of every whole text, learned from labelled rows that are not held out.

    The fit takes at most ``per_class`` rows of each label, of ``words`` words or
    fewer, and a fourth as many of any length up to 5000 words to calibrate.  Null and empty texts are
    scored as a window without words; without labelled rows of both kinds every
    score is 0.  A text's score is its worst window's, so windows of equal scores make
    no difference; texts of any length are cut into windows as a whole.  Repeated rows
    give a row each; null keys stay null (and are not held out); other columns are left
    out; an empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = labelled_rows(docs, labels, key, text, dict(enumerate(per_class)), words, False)
    whole = labelled_rows(docs, labels, key, text, {y: n // 4 for y, n in enumerate(per_class)}, 5000, True)
    model = spark.sparkContext.broadcast(fit(rows, whole) if len({y for _, y in rows}) == 2 else None)  # of a bounded size

    def of(batch: pa.RecordBatch) -> list[pa.Array]:
        texts = ["" if t is None else t for t in batch.column("t").to_pylist()]
        score = np.zeros(len(texts))
        if model.value is not None:
            for a, b in batches(texts, 1_500_000):
                score[a:b] = text_scores(model.value, texts[a:b])
        return [pa.array(score), pa.array((score >= threshold).astype(np.int32))]

    held_out = F.coalesce(id_crc(key) % 4 == 2, F.lit(False))
    return keyed(docs, key, text, of, "score double, predicted int", {"held_out": held_out}).withColumnRenamed("k", key)
