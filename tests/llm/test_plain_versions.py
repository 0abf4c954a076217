"""Plain versions of the models: quality scores, decoding of languages, windows of the network."""

import collections
import math
import random
import re

import numpy as np
from pyspark.sql import functions as F

from braidline.llm import language, packing, quality, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_quality_scores_and_verdicts(spark):
    rng = random.Random(3)
    good = ["".join(rng.choice(["ka", "lo", "mi", "re"]) for _ in range(2)) for _ in range(40)]
    junk = [w + "%%" for w in good]
    rows = [(i, " ".join(rng.choice(junk if i % 4 == 0 else good) for _ in range(70 + i))) for i in range(40)]
    rows += [(100, None), (101, ""), (102, "short"), (103, rows[1][1]), (None, rows[1][1])]
    labels = [(i, int(i % 4 != 0)) for i in range(0, 40, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {(r.k, r.n_words): (r.score, r.kept) for r in quality.judged(docs, spark.createDataFrame(labels, "doc_id long, quality int"), buckets=512).collect()}

    words = {i: WORD.findall(t or "") for i, t in rows}
    pairs = sorted({p for w in words.values() for p in zip(w, [*w[1:], None])}, key=repr)
    x, y = F.col("x"), F.col("y")
    buckets = {(r.x, r.y): list(r.b) for r in spark.createDataFrame(pairs, "x string, y string").select("x", "y", F.array(*quality.gram_buckets(x, y, 512)).alias("b")).collect()}
    grams = {i: [b for p in zip(w, [*w[1:], None]) for b in buckets[p]] for i, w in words.items()}
    raw = collections.Counter(b for i, _ in rows for b in grams[i])
    trusted = collections.Counter(b for i, q in labels if q for b in grams[i])
    rate = sum(trusted.values()) / sum(raw.values())
    weight = {b: math.log(max((trusted[b] + 2) / (raw[b] * rate + 2), 0.1)) for b in raw}
    for i, t in rows:
        w, g = words[i], grams[i]
        score = sum(weight[b] for b in g) / len(g) if g else 0.0
        window = collections.Counter(zip(w, w[1:], w[2:]))
        covered = {k + j for k in range(len(w) - 2) if window[tuple(w[k:k + 3])] > 1 for j in range(3)}
        failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
        have = got[i, len(w)]
        assert abs(have[0] - score) < 1e-9
        assert have[1] == (not failed and score >= -0.25)


def test_languages_are_decoded_by_weighted_loss():
    rows = [(" ".join(random.Random(i).choice(v) for _ in range(30)), k) for i in range(20) for k, v in (("a", ["uno", "dos", "tres"]), ("b", ["ein", "zwei", "drei"]), ("c", ["one", "two", "three"]))]
    model = language.train(rows)
    for text, _ in rows[:9]:
        margins = model.margins(text)
        loss = [sum(t * math.log1p(math.exp(-m * c)) for t, m, c in zip(model.trust, margins, word)) for word in model.code]
        p = [math.exp(min(loss) - x) for x in loss]
        p = sorted(((x / sum(p), -i) for i, x in enumerate(p)), reverse=True)
        name, score, near = model.decide(margins)
        assert name == model.languages[-p[0][1]] and abs(score - p[0][0]) < 1e-9 and near == (p[0][0] - p[1][0] < 0.2)
    tie = language.Model(["a", "b"], np.array([[1.0, 1], [1, -1]]), np.zeros((1, 2)), np.zeros(2), np.ones(2))
    assert tie.decide(np.array([0.0, 0.0])) == ("a", 0.5, True)


def plain_window(p, vectors):
    """Logit of one window, a word at a time."""
    def sigmoid(v):
        return 1 / (1 + np.exp(-v))

    def states(xs, s):
        h, out, k = np.zeros(toxicity.HIDDEN), [], toxicity.HIDDEN
        for x in xs:
            g, u = x @ p[f"w{s}"] + p[f"b{s}"], h @ p[f"u{s}"]
            z, r = sigmoid(g[:k] + u[:k]), sigmoid(g[k:2 * k] + u[k:2 * k])
            n = np.tanh(g[2 * k:] + r * u[2 * k:])
            h = (1 - z) * n + z * h
            out.append(h)
        return out

    s = np.concatenate([states(vectors, "f"), states(vectors[::-1], "b")[::-1]], 1)
    e = np.tanh(s @ p["wa"] + p["ba"]) @ p["va"]
    w = np.exp(e - e.max())
    return (w / w.sum()) @ s @ p["wo"] + p["bo"][0]


def test_every_window_of_a_text_is_scored():
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(50)]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(n)) for n in (1, 5, 64, 65, 200, 333)] + [""]
    words = toxicity.Words(texts, least=1)
    p = {k: v.astype(np.float32) for k, v in toxicity.initial(len(words), 5).items()}
    got = toxicity.worst_logits(p, words, texts)
    for t, have in zip(texts, got):
        w = t.split() or [""]
        starts = [0] if len(w) <= 64 else [*range(0, len(w) - 64, 48), len(w) - 64]
        vectors = toxicity.gate_inputs(p, words, w)[0].astype(float)
        assert abs(max(plain_window(p, vectors[s:s + 64]) for s in starts) - have) < 1e-3


def test_few_items_are_packed_into_the_fewest_bins():
    def fewest(lengths, capacity):
        best = len(lengths)

        def place(i, room):
            nonlocal best
            if len(room) >= best:
                return
            if i == len(lengths):
                best = len(room)
                return
            for b in range(len(room)):
                if room[b] >= lengths[i]:
                    place(i + 1, [*room[:b], room[b] - lengths[i], *room[b + 1:]])
            place(i + 1, [*room, capacity - lengths[i]])

        place(0, [])
        return best

    rng = random.Random(6)
    over = 0
    for _ in range(60):
        lengths = sorted((rng.randint(10, 70) for _ in range(rng.randint(1, 11))), reverse=True)
        bins = packing.pack(lengths, 100)
        assert sorted(i for b in bins for i in b) == list(range(len(lengths))) and all(sum(lengths[i] for i in b) <= 100 for b in bins)
        over += len(bins) - fewest(lengths, 100)
    assert over <= 2  # a local search: now and then a bin more
