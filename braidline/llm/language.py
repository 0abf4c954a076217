"""Operator 2: language identification by error-correcting output codes.

Every language has a codeword.  One binary classifier per bit, a logistic model
over hashed byte n-grams, predicts that bit; the language whose codeword has the
least weighted loss wins, and a text whose two best are close is ambiguous.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_crc, keyed

HASH_BITS = 15
ORDERS = (1, 2, 3, 4)
#: Values of the hash by which training rows are chosen.
SPAN = 1 << 40
#: Odd multipliers of the n-gram hashes.
FACTORS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint32)


def codebook(languages: int, bits: int = 31, seed: int = 7) -> np.ndarray:
    """A row of +1 and -1 for each language.

    Up to five languages get the exhaustive code (every split into two non-empty
    parts, so any two rows differ in half of the bits or more); more get the best
    of 200 random codes by the least distance of two rows.
    """
    if languages < 2:
        return np.ones((languages, 1))
    if languages <= 5:
        cols = np.arange(1, 1 << (languages - 1))
        rows = [np.ones(len(cols))] + [1.0 - 2.0 * ((cols >> i) & 1) for i in range(languages - 1)]
        return np.array(rows)
    rng = np.random.default_rng(seed)
    best, apart = None, -1
    for _ in range(200):
        code = rng.choice([-1.0, 1.0], (languages, max(bits, 4 * languages)))
        dots = code @ code.T
        np.fill_diagonal(dots, -np.inf)
        least = int((code.shape[1] - dots.max()) // 2)
        if least > apart:
            best, apart = code, least
    return best


def gram_places(data: np.ndarray, order: int) -> np.ndarray:
    """Hash buckets of the n-grams that start at each byte."""
    h = np.zeros(len(data) - order + 1, np.uint32)
    for i in range(order):
        h = (h + data[i:len(data) - order + 1 + i]) * FACTORS[i]
        h ^= h >> np.uint32(15)
    return ((h * FACTORS[order - 1]) >> np.uint32(32 - HASH_BITS)).astype(np.int64) + (order - 1) * (1 << HASH_BITS)


def _lower_bytes(text: str) -> bytes:
    return b" " + " ".join(text.lower().split()).encode("utf-8", "surrogatepass") + b" "


def counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text and their share of it, each order with a share of one."""
    data = np.frombuffer(_lower_bytes(text), np.uint8).astype(np.uint32)
    places, share = [], []
    for n in ORDERS:
        if len(data) >= n:
            u, c = np.unique(gram_places(data, n), return_counts=True)
            places.append(u)
            share.append(np.sqrt(c / c.sum()))
    return np.concatenate(places), np.concatenate(share)


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray  # bucket x bit
    bias: np.ndarray
    trust: np.ndarray  # weight of each bit's loss

    def margins(self, text: str) -> np.ndarray:
        places, share = counts(text)
        return share @ self.weights[places] + self.bias

    def decide(self, margins: np.ndarray) -> tuple[str, float, bool]:
        """Language, score and whether two codewords are about as near."""
        loss = (self.trust * np.logaddexp(0, -margins * self.code)).sum(1)
        p = np.exp(loss.min() - loss)
        p /= p.sum()
        best = int(loss.argmin())
        rest = np.delete(p, best)
        return self.languages[best], float(p[best]), bool(len(rest) and p[best] - rest.max() < 0.2)


def train(rows: list[tuple[str, str]], epochs: int = 8, rate: float = 4.0, decay: float = 1e-5, seed: int = 11) -> Model:
    """Fit all bits together by AdaGrad on the logistic loss; rows are (text, language).

    A bit's loss weighs by how well it tells the training texts apart.
    """
    languages = sorted({lang for _, lang in rows})
    code = codebook(len(languages))
    bits = code.shape[1]
    w = np.zeros((len(ORDERS) << HASH_BITS, bits))
    bias, squares, bias_squares = np.zeros(bits), np.full_like(w, 1e-3), np.full(bits, 1e-3)
    seen = [(*counts(text), code[languages.index(lang)]) for text, lang in rows]
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(seen)):
            places, share, bit = seen[i]
            m = share @ w[places] + bias
            g = -bit / (1 + np.exp(np.clip(m * bit, -30, 30)))
            step = share[:, None] * g + decay * w[places]
            squares[places] += step**2
            w[places] -= rate * 0.1 * step / np.sqrt(squares[places])
            bias_squares += g**2
            bias -= rate * 0.02 * g / np.sqrt(bias_squares)
    right = np.mean([np.sign(s @ w[p] + bias) == b for p, s, b in seen], axis=0) if seen else np.ones(bits)
    trust = np.clip(2 * right - 1, 0.05, 1.0)
    return Model(languages, code, w.astype(np.float32), bias, trust / trust.mean())


def training_rows(docs: DataFrame, key: str, text: str, lang: str, per_language: int, chars: int, languages: int) -> list[tuple[str, str]]:
    """At most ``per_language`` rows of each language (least hash first) outside the held-out part.

    What is collected is bounded, whatever the table: about twice ``per_language``
    rows of each of at most ``languages`` languages (the first by name), and of a text at most ``chars``
    characters from a place that its hash chooses.
    """
    usable = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull() & (id_crc(key) % 3 != 1) & (F.length(text) > 0))
    place = F.pmod(F.xxhash64(text), F.greatest(F.char_length(text) - chars, F.lit(0)) + 1).cast("int") + 1
    h = F.pmod(F.xxhash64(key, text), F.lit(SPAN))
    part = usable.select(h.alias("h"), F.col(lang).alias("l"), F.substring(F.col(text), place, F.lit(chars)).alias("t"))
    # Rows below a cut that about twice the wanted number stay under, so that no task sends more than its share.
    cuts = [(r["l"], max(1, min(SPAN, SPAN * 2 * per_language // r["count"]))) for r in part.groupBy("l").count().orderBy("l").limit(languages).collect()]
    if not cuts:
        return []
    below = F.lit(False)
    for name, cut in cuts:
        below = below | ((F.col("l") == name) & (F.col("h") < cut))
    rows = sorted((r["l"], r["h"], r["t"]) for r in part.filter(below).collect())
    return [(t, name) for name, _ in cuts for _, _, t in [r for r in rows if r[0] == name][:per_language]]


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def identify(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = 600, chars: int = 2000, languages: int = 1000) -> DataFrame:
    """Language of every whole text, learned from the rows that are not held out.

    ``und`` with score 0 for null texts and for those without a letter, and for all
    if there is nothing to learn from.  A single language learned is predicted
    always.  Of languages with equal losses the first by name is predicted.  Texts of
    any length are read whole, a text at a time.  Repeated rows give a row each; null
    keys stay null (and are not held out); other columns are left out; an empty table
    gives no rows.
    """
    spark = docs.sparkSession
    rows = training_rows(docs, key, text, lang, per_language, chars, languages)
    model = spark.sparkContext.broadcast(train(rows) if rows else None)  # of a fixed size

    def of(batch: pa.RecordBatch) -> list[pa.Array]:
        m = model.value
        got = [m.decide(m.margins(t)) if m is not None and t is not None and has_letter(t) else ("und", 0.0, False) for t in batch.column("t").to_pylist()]
        return [pa.array([g[i] for g in got], t) for i, t in enumerate((pa.string(), pa.float64(), pa.bool_()))]

    held_out = F.coalesce(id_crc(key) % 3 == 1, F.lit(False))
    return keyed(docs, key, text, of, "lang_pred string, score double, ambiguous boolean", {"held_out": held_out}).withColumnRenamed("k", key)
