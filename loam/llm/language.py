"""Operator 7, language identification by error-correcting output codes over character n-grams.

Each learned language gets a binary codeword; one linear classifier on hashed character n-grams (one to three
letters, lower-cased, everything but letters one space) predicts each bit. Decoding sums, for each codeword, the logistic
losses of the bit margins, weighted by how well that bit's classifier does on held-back rows of that language, and
takes the nearest codeword; a small lead over the second nearest flags the text as ambiguous.

The classifiers are fitted on a bounded sample of labelled rows (``per_language`` for each language and
``most`` in all, chosen by a hash of the id); prediction reads every text whole.

Defined cases: a null text or one without a letter is ``und`` with score 0; rows with a null language are predicted but
never learned from; without any labelled row all texts are ``und``; with one language it is predicted for
all others; repeated rows give equal rows; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loam.llm.common import doc_fold, lean

DIM = 2048
PER_LANGUAGE, MOST, LANGUAGES = 600, 4800, 500
AMBIGUOUS = 0.1
#: Texts are featurised in pieces of so many characters, so that memory stays bounded; counts are those of whole texts.
PIECE = 1 << 20

_alpha = None


def _letters() -> np.ndarray:
    global _alpha
    if _alpha is None:
        _alpha = np.array([chr(i).isalpha() for i in range(0x110000)])
    return _alpha


def ngram_counts(text: str, piece: int = PIECE) -> np.ndarray | None:
    """Hashed counts of 1- to 3-grams, or None if there is no letter.

    A piece carries on the last two characters kept and whether the text before it ended in a letter, so that the
    counts are those of the text as a whole.
    """
    counts, found, last, after_letter = np.zeros(DIM), False, np.array([32], np.uint32), True
    text = text.lower()
    counts[(last * np.uint32(0x9E3779B1) >> np.uint32(21))[0]] += 1
    for a in range(0, len(text) + 1, piece):
        points = np.frombuffer(text[a : a + piece].encode("utf-32-le", "surrogatepass"), np.uint32)
        letters = _letters()[points]
        found |= bool(letters.any())
        keep = letters.copy()
        if len(points):
            keep |= np.concatenate([[after_letter], letters[:-1]])
            after_letter = bool(letters[-1])
        new = np.where(letters, points, np.uint32(32))[keep]
        if a + piece > len(text):
            new = np.append(new, np.uint32(32))
        one, n = np.concatenate([last, new]).astype(np.uint32), len(last)
        h1 = one * np.uint32(0x9E3779B1)
        h2 = (h1[:-1] ^ np.uint32(0x5BD1E995)) * np.uint32(0x85EBCA6B) + one[1:]
        h3 = (h2[:-1] ^ (h2[:-1] >> np.uint32(15))) * np.uint32(0xC2B2AE35) + one[2:]
        for h, before in ((h1, n), (h2 * np.uint32(0x27D4EB2F), n - 1), (h3 * np.uint32(0x165667B1), max(0, n - 2))):
            counts += np.bincount(h[before:] >> np.uint32(21), minlength=DIM)
        last = one[-2:]
    return counts if found else None


def ngram_vector(text: str | None) -> np.ndarray | None:
    counts = ngram_counts(text) if text else None
    if counts is None:
        return None
    v = np.sqrt(counts)
    return (v / np.sqrt(v @ v)).astype(np.float32)


def codewords(classes: int, seed: int = 7) -> np.ndarray:
    """Rows of +1 and -1. Up to six classes: every split of them into two; more: the widest apart of random codes."""
    if classes <= 6:
        bits = range(1, 1 << max(classes - 1, 1)) if classes > 1 else [1]
        return np.array([[1 if (c == 0 or not b >> (c - 1) & 1) else -1 for b in bits] for c in range(classes)], np.float32)
    rng, length, best = np.random.default_rng(seed), 10 * int(np.ceil(np.log2(classes))), None
    for _ in range(50):
        code = rng.choice([-1.0, 1.0], (classes, length)).astype(np.float32)
        apart = ((length - code @ code.T) / 2 + length * np.eye(classes)).min()
        if (best is None or apart > best[0]) and (np.abs(code.sum(0)) < classes).all():
            best = (apart, code)
    return best[1]


class Model:
    def __init__(self, languages, code, weights, bias, trust):
        self.languages, self.code, self.weights, self.bias, self.trust = languages, code, weights, bias, trust

    def predict(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Language numbers, scores in 0..1 and lead over the second."""
        margins = vectors @ self.weights + self.bias
        loss = np.logaddexp(0, -margins[:, None, :] * self.code[None])
        far = (loss * self.trust[None]).sum(2)
        odds = np.exp(-2 * (far - far.min(1, keepdims=True)) * len(self.code[0]) ** 0.5)
        odds /= odds.sum(1, keepdims=True)
        two = np.sort(odds, 1)[:, -2:]
        return far.argmin(1), odds.max(1), two[:, -1] - (two[:, 0] if odds.shape[1] > 1 else 0)


def fit(vectors: np.ndarray, labels: np.ndarray, languages: list[str], steps: int = 200) -> Model:
    code = codewords(len(languages))
    held = np.arange(len(labels)) % 5 == 0
    if len(labels) < 20:
        held[:] = False

    def train(x, y):
        target = (code[y] + 1) / 2
        w, b = np.zeros((x.shape[1], code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
        m, v = np.zeros_like(w), np.zeros_like(w)
        for i in range(1, steps + 1):
            r = (1 / (1 + np.exp(-(x @ w + b))) - target) / len(x)
            g = x.T @ r + 1e-6 * w
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            w -= 0.3 * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.99**i)) + 1e-8)
            b -= r.sum(0)
        return w, b

    trust = np.ones_like(code)
    w, b = train(vectors[~held], labels[~held])
    if held.any():
        right = (np.sign(vectors[held] @ w + b) == code[labels[held]]).astype(np.float32)
        for c in range(len(languages)):
            if (labels[held] == c).any():
                trust[c] = right[labels[held] == c].mean(0) + 1e-3
    return Model(languages, code, w, b, trust / trust.sum(1, keepdims=True))


def featurise(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """``keep`` columns and the n-gram vector as binary (null without letters)."""
    fields = [docs.schema[c] for c in keep]

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            vectors = [ngram_vector(t) for t in batch.column(len(keep)).to_pylist()]
            blobs = pa.array([None if v is None else v.tobytes() for v in vectors], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], blobs], names=[*keep, "vector"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", vector binary"
    return docs.select(*keep, text_col).mapInArrow(lean(run), schema)


def learn(docs: DataFrame, per_language: int = PER_LANGUAGE, most: int = MOST, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", languages: int = LANGUAGES) -> Model | None:
    """Fits on rows with a language and a fold (crc32 of the id, modulo 3) other than 1.

    At most ``languages`` of them, those with the most different rows, and of each at most ``per_language`` rows, or fewer that make ``most``
    together: those that a hash of id and text picks among the different ones. A row that repeats counts once, so
    that nothing beyond these bounds is brought together, and no language goes without rows because another row of it is frequent.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").alias("lang"))
    rows = rows.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (doc_fold(F.col("id")) % 3 != 1))
    rows = rows.withColumn("row", F.xxhash64("id", "text", F.lit("language")))
    counts = rows.groupBy("lang").agg(F.approx_count_distinct("row").alias("n")).orderBy(F.desc("n"), "lang").limit(languages).collect()
    counts = {r["lang"]: max(1, r["n"]) for r in counts}
    if not counts:
        return None
    each = max(1, min(per_language, most // len(counts)))
    # Twice as many as wanted, as the counts are estimates; then each row once, and the first of each language.
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, 2.0 * each / n))])
    luck = F.pmod(F.col("row"), F.lit(1 << 30)) / float(1 << 30)
    some = rows.filter(luck < share[F.col("lang")]).withColumn("luck", luck).dropDuplicates(["lang", "row"])
    vectors = featurise(some, ["id", "lang", "luck"]).filter("vector is not null")
    first = F.row_number().over(Window.partitionBy("lang").orderBy("luck", "id", "vector"))
    got = vectors.withColumn("nth", first).filter(F.col("nth") <= each).select("id", "lang", "vector").toPandas()
    if not len(got):
        return None
    got = got.sort_values(["lang", "id", "vector"], kind="stable")
    names = sorted(got["lang"].unique())
    number = {x: i for i, x in enumerate(names)}
    return fit(np.stack([np.frombuffer(v, np.float32) for v in got["vector"]]), got["lang"].map(number).to_numpy(), names)


def identify(docs: DataFrame, model: Model | None, keep: list[str], text_col: str = "text") -> DataFrame:
    """``keep`` columns, then lang_pred, score and ambiguous."""
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep) + ", lang_pred string, score double, ambiguous boolean"

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            vectors = [ngram_vector(t) if model else None for t in batch.column(len(keep)).to_pylist()]
            lang, score, unsure = ["und"] * len(vectors), [0.0] * len(vectors), [False] * len(vectors)
            at = [i for i, v in enumerate(vectors) if v is not None]
            if at:
                for i, c, s, lead in zip(at, *model.predict(np.stack([vectors[i] for i in at]))):
                    lang[i], score[i], unsure[i] = model.languages[c], float(s), bool(lead < AMBIGUOUS)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(keep)], pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(unsure, pa.bool_())],
                names=[*keep, "lang_pred", "score", "ambiguous"],
            )

    return docs.select(*keep, F.col(f"`{text_col}`").alias("_text")).mapInArrow(lean(run), schema)


def op7_language(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = identify(docs, learn(docs), ["doc_id"])
    return found.select("doc_id", (doc_fold(F.col("doc_id")) % 3 == 1).alias("held_out"), "lang_pred", "score", "ambiguous")
