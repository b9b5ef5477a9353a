"""Language identification by error-correcting output codes.

Each language has a codeword; each bit has a binary classifier over hashed byte trigrams, learned
to tell the languages with that bit from those without. A text's bits are compared with every
codeword: the logistic loss of each classifier, weighted by how reliable it was on texts kept back
from its learning, is summed, and the codeword with the least loss wins. The gap to the second
flags ambiguous texts. Learned on the driver from a bounded, hash-ordered sample of each language.
"""

from __future__ import annotations

import numpy as np
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadsieve.llm.common import crc_mod, id_type, map_batches, small_batches, stored, texts_of

#: Hashed trigrams; bound of the learning sample (texts of each language, bytes of such a text).
#: A table with many languages learns from fewer texts of each: at most MOST_TEXTS in all.
BUCKETS, PER_LANGUAGE, LONGEST, MOST_TEXTS = 4096, 300, 20_000, 4000
ROUNDS, RATE, DECAY = 50, 0.3, 1e-5
#: Probability gap between the two nearest codewords below which a text is ambiguous.
GAP = 0.2
FOLDS, HELD = 3, 1
UNKNOWN = "und"
#: Bytes hashed at once, so that a text of any length takes bounded memory.
_SPAN = 1 << 20
#: Letters by category: fractions, Roman numerals and circled digits are none.
_LETTER = regex.compile(r"\p{L}")


def codewords(n: int, seed: int = 11) -> np.ndarray:
    """n rows of +1 and -1, no two rows and no two columns equal or opposite.

    All columns for few languages (the exhaustive code), random balanced ones for many, drawn until
    the two nearest codewords are far apart.
    """
    if n < 2:
        return np.ones((n, 1))
    if n <= 7:
        bits = np.array([[(c >> k) & 1 for c in range(1, 2 ** (n - 1))] for k in range(n)])
        return 1.0 - 2.0 * bits
    width = max(15, 10 * int(np.ceil(np.log2(n))))
    rng, best, far = np.random.default_rng(seed), None, -1
    for _ in range(100):
        code = np.stack([rng.permutation(np.resize([1.0, -1.0], n)) for _ in range(width)], axis=1)
        near = int(((width - code @ code.T) / 2 + width * np.eye(n)).min())
        if near > far:
            best, far = code, near
    return best


def trigrams(text: str) -> np.ndarray:
    """Square roots of hashed byte-trigram counts of the lower-cased text, scaled to length 1."""
    data = np.frombuffer(f" {text.lower()} ".encode("utf-8", "surrogatepass"), dtype=np.uint8)
    counts = np.zeros(BUCKETS)
    for at in range(0, max(1, len(data) - 2), _SPAN):
        part = data[at : at + _SPAN + 2].astype(np.uint32)
        key = (part[:-2] * 0x01000193 ^ part[1:-1]) * 0x01000193 ^ part[2:]
        counts += np.bincount((key * np.uint32(0x9E3779B1)) >> 20, minlength=BUCKETS)
    x = np.sqrt(counts, dtype=np.float64)
    return x / max(1.0, np.linalg.norm(x))


class Model:
    def __init__(self, languages: list[str], code: np.ndarray, weights: np.ndarray, bias: np.ndarray, trust: np.ndarray):
        self.languages, self.code, self.weights, self.bias, self.trust = languages, code, weights, bias, trust

    def decode(self, text: str | None) -> tuple[str, float, bool]:
        """(language, probability, whether two codewords are about equally near)."""
        if not text or not self.languages or not _LETTER.search(text):
            return UNKNOWN, 0.0, False
        margin = trigrams(text) @ self.weights + self.bias
        loss = np.logaddexp(0.0, -self.code * margin) @ self.trust
        p = np.exp(loss.min() - loss)
        p /= p.sum()
        best = int(p.argmax())
        second = float(np.partition(p, -2)[-2]) if len(p) > 1 else 0.0
        return self.languages[best], float(p[best]), bool(p[best] - second < GAP)


def learn(texts: list[str], labels: list[str]) -> Model:
    """One logistic classifier for each bit, all at once, by gradient descent with momentum."""
    languages = sorted(set(labels))
    code = codewords(len(languages))
    weights, bias = np.zeros((BUCKETS, code.shape[1])), np.zeros(code.shape[1])
    trust = np.ones(code.shape[1])
    if len(languages) < 2:
        return Model(languages, code, weights, bias, trust)
    x = np.stack([trigrams(t) for t in texts]).astype(np.float32)
    which = np.array([languages.index(y) for y in labels])
    y = code[which].astype(np.float32)
    # languages weigh the same, however many texts each has
    share = (1 / np.bincount(which))[which][:, None] / len(languages)
    kept_back = np.arange(len(texts)) % 5 == 4

    def fit(rows):
        w, b = weights.astype(np.float32), bias.astype(np.float32)
        dw, db = np.zeros_like(w), np.zeros_like(b)
        for _ in range(ROUNDS):
            g = -y[rows] / (1 + np.exp(np.clip(y[rows] * (x[rows] @ w + b), -30, 30))) * share[rows]
            dw, db = 0.9 * dw + x[rows].T @ g + DECAY * w, 0.9 * db + g.sum(axis=0)
            w, b = w - RATE * 100 * dw, b - RATE * 10 * db
        return w, b

    if kept_back.any() and not kept_back.all():
        w, b = fit(~kept_back)
        right = (y[kept_back] * (x[kept_back] @ w + b) > 0).mean(axis=0)
        trust = np.maximum(0.05, 2 * right - 1)
    w, b = fit(np.ones(len(texts), dtype=bool))
    return Model(languages, code, w.astype(np.float64), b.astype(np.float64), trust)


def sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str, per_language: int, longest: int) -> tuple[list[str], list[str]]:
    """At most `per_language` texts of each language outside the held-out fold, the first by a hash.

    Only these rows say which languages there are. The last hash of each language is found on hashes
    alone, cut before the shuffle (Spark's group limit); then the texts up to it are read, repeated
    rows once.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.col(lang_col).alias("_lang"), F.col(text_col).alias("_text")).where(
        F.col("_lang").isNotNull() & (crc_mod(F.col("_id"), FOLDS) != HELD) & F.octet_length("_text").between(1, longest)
    )
    rows = rows.withColumn("_hash", F.xxhash64("_id", "_text"))
    languages = rows.select("_lang").distinct().count()
    per_language = max(1, min(per_language, MOST_TEXTS // max(1, languages)))
    rank = F.row_number().over(Window.partitionBy("_lang").orderBy("_hash"))
    first = rows.select("_lang", "_hash").withColumn("_rank", rank).where(F.col("_rank") <= per_language)
    # written, so that Spark sees how small the table is and need not shuffle the texts
    last = stored(first.groupBy("_lang").agg(F.max("_hash").alias("_last")), "language-cuts")
    drawn = rows.join(last, "_lang").where(F.col("_hash") <= F.col("_last")).groupBy("_lang", "_hash").agg(F.min("_text").alias("_text"))
    found = sorted(drawn.collect(), key=lambda r: (r["_lang"], r["_hash"]))
    found = [r for r in found if _LETTER.search(r["_text"])]
    return [r["_text"] for r in found], [r["_lang"] for r in found]


def identify_languages(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    per_language: int = PER_LANGUAGE,
    longest: int = LONGEST,
) -> DataFrame:
    """One row per row: doc_id, held_out, lang_pred, score (its probability), ambiguous.

    NULL texts and texts without a letter are `und` with score 0, as is everything if no language
    can be learned. Ids may be NULL or repeat; other columns are not read; an empty table gives an
    empty one. Learns when called.
    """
    small_batches(docs.sparkSession)
    model = learn(*sample(docs, id_col, text_col, lang_col, per_language, longest))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType(
        [
            T.StructField("doc_id", id_type(docs, id_col)),
            T.StructField("lang_pred", T.StringType()),
            T.StructField("score", T.DoubleType()),
            T.StructField("ambiguous", T.BooleanType()),
        ]
    )

    def make():
        net = shared.value

        def work(batch):
            found = [net.decode(x) for x in texts_of(batch, text_col)]
            return [batch.column(id_col), *([f[k] for f in found] for k in range(3))]

        return work

    out = map_batches(docs.select(id_col, text_col), make, schema)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "ambiguous")


def held_out(doc_id: Column) -> Column:
    return crc_mod(doc_id, FOLDS) == HELD
