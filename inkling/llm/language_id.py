"""Language ID by hierarchical discrimination.

A linear classifier over hashed character n-grams first predicts the language family; within a family, one-versus-one
linear support vector machines separate the related languages and vote. Models are fitted on a bounded, documented sample
of labelled rows; every text is then scored whole.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, batch_of, table

#: Families of languages (a parameter); a language that is not listed is a family of its own.
FAMILIES = {"germanic": ("en", "de", "nl", "sv", "da", "no", "is", "af"), "romance": ("fr", "es", "it", "pt", "ca", "ro", "gl"), "slavic": ("ru", "pl", "cs", "sk", "uk", "bg", "sr", "hr", "sl")}

#: Bound of the sample: labelled rows of each language. Their texts are used whole.
ROWS_PER_LANGUAGE = 400

BUCKETS = 1 << 13

#: Characters scored at once.
SLICE = 300_000

UNDETERMINED = "und"


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def ngram_buckets(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the character 1- to 3-grams of lower-cased texts, and the number of the text that each is from.

    Only letters count; every run of other characters is one space, and n-grams do not reach from text to text.
    """
    joined = "\0".join(texts).lower()
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    end = points == 0
    letter = (points >= 97) & (points <= 122) | (points >= 0xAA) & ~((points >= 0x2000) & (points <= 0x206F)) & (points != 0xD7) & (points != 0xF7)
    text = np.cumsum(end)
    keep = letter | end | np.r_[True, letter[:-1]]
    c = np.where(letter, points, np.where(end, 0, 32))[keep].astype(np.uint64)
    text = text[keep]
    mixed, texts_of = [], []
    for n in (1, 2, 3):
        if len(c) < n:
            continue
        h = np.full(len(c) - n + 1, n, np.uint64)
        ok = np.ones(len(h), bool)
        for j in range(n):
            part = c[j : len(c) - n + 1 + j]
            h = h * np.uint64(1000003) + part
            ok &= part != 0
        if n == 1:
            ok &= c != 32
        mixed.append(((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(51))[ok])
        texts_of.append(text[: len(h)][ok])
    return (np.concatenate(mixed), np.concatenate(texts_of)) if mixed else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def features(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text its buckets and their shares of its n-grams."""
    b, t = ngram_buckets(texts)
    found, counts = np.unique(t.astype(np.int64) * BUCKETS + b.astype(np.int64), return_counts=True)
    cuts = np.searchsorted(found, np.arange(1, len(texts)) * BUCKETS)
    return [(f % BUCKETS, n / max(1, n.sum())) for f, n in zip(np.split(found, cuts), np.split(counts, cuts))]


def linear_svm(x: np.ndarray, y: np.ndarray, c: float = 10.0, epochs: int = 15) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear SVM (hinge loss) by dual coordinate descent; rows are scaled to unit length."""
    scale = x.max(0)
    scale = 1 / np.where(scale > 0, scale, 1.0) ** 0.5
    z = np.empty((len(x), x.shape[1] + 1), np.float32)
    np.multiply(x, scale, out=z[:, :-1])
    norm = np.sqrt(np.einsum("ij,ij->i", z[:, :-1], z[:, :-1]))
    z[:, :-1] /= np.maximum(norm, 1e-12)[:, None]
    z[:, -1] = 0.1
    q = np.einsum("ij,ij->i", z, z)
    alpha, w, order = np.zeros(len(z)), np.zeros(z.shape[1]), np.random.default_rng(0)
    for _ in range(epochs):
        for i in order.permutation(len(z)):
            new = min(max(alpha[i] + (1 - y[i] * (w @ z[i])) / q[i], 0.0), c)
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * z[i]
                alpha[i] = new
    mean = float(np.median(norm))
    return w[:-1] * scale / max(mean, 1e-12), float(w[-1] * 0.1)


class Model:
    """Family and pair classifiers; each is a weight for every bucket and a bias, scored as a mean over n-grams."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]], langs: list[str]):
        self.langs = sorted(set(langs))
        family = {lang: next((f for f, members in FAMILIES.items() if lang in members), lang) for lang in self.langs}
        self.families = sorted(set(family.values()))
        self.members = {f: [x for x in self.langs if family[x] == f] for f in self.families}
        x, y = np.zeros((len(rows), BUCKETS), np.float32), np.array(langs)
        for i, (bucket, part) in enumerate(rows):
            x[i, bucket] = part
        of = np.array([family[lang] for lang in langs])
        self.tasks: list[tuple[str, str, str]] = []
        weights, bias = [], []
        if len(self.families) > 1:
            for f in self.families[: 1 if len(self.families) == 2 else None]:
                self.tasks.append(("family", f, ""))
                w, b = linear_svm(x, np.where(of == f, 1.0, -1.0))
                weights.append(w), bias.append(b)
        for f in self.families:
            for one, two in combinations(self.members[f], 2):
                rows = (y == one) | (y == two)
                self.tasks.append((f, one, two))
                w, b = linear_svm(x[rows], np.where(y[rows] == one, 1.0, -1.0))
                weights.append(w), bias.append(b)
        self.weights, self.bias = np.array(weights).reshape(len(self.tasks), BUCKETS), np.array(bias)

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        """Languages and scores, worked out in slices, so that memory follows SLICE or the longest text and not the batch."""
        langs, scores, at = [], [], 0
        while at < len(texts):
            end, size = at + 1, len(texts[at])
            while end < len(texts) and size + len(texts[end]) <= SLICE:
                size, end = size + len(texts[end]), end + 1
            some = self._predict(texts[at:end])
            langs += some[0]
            scores += some[1]
            at = end
        return langs, scores

    def _predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        b, t = ngram_buckets(texts)
        n = np.bincount(t, minlength=len(texts))
        b = b.astype(np.int64)
        z = np.stack([np.bincount(t, w[b], len(texts)) for w in self.weights], 1) / np.maximum(n, 1)[:, None] + self.bias if len(self.tasks) else np.zeros((len(texts), 0))
        p = 1 / (1 + np.exp(-np.clip(3 * z, -50, 50)))
        langs, scores = [], []
        for i, text in enumerate(texts):
            if not n[i] or not has_letter(text) or not self.langs:
                langs.append(UNDETERMINED), scores.append(0.0)
                continue
            share = {f: p[i, k] for k, (kind, f, _) in enumerate(self.tasks) if kind == "family"}
            if len(self.families) == 2:
                share[self.families[1]] = 1 - share[self.families[0]]
            best = max(self.families, key=lambda f: share.get(f, 1.0))
            votes = {lang: [0, 0.0] for lang in self.members[best]}
            for k, (kind, one, two) in enumerate(self.tasks):
                if kind == best:
                    votes[one if p[i, k] >= 0.5 else two][0] += 1
                    votes[one][1] += p[i, k]
                    votes[two][1] += 1 - p[i, k]
            lang = max(sorted(votes), key=votes.get)
            rivals = len(votes) - 1
            langs.append(lang)
            scores.append(float(share.get(best, 1.0) * (votes[lang][1] / rivals if rivals else 1.0)))
        return langs, scores


SAMPLE = arrow_schema("lang string,h long,buckets binary,shares binary")


def training_sample(docs: DataFrame) -> DataFrame:
    """(lang, h, buckets, shares): n-grams of some ROWS_PER_LANGUAGE labelled texts of each language, chosen by hash of id and text.

    Rows of the held-out fold, without id, label or letters take no part. A first pass counts different rows by language
    (approximately), a second featurises the whole texts below each language's share of the hash range in the tasks, so that the
    driver gets BUCKETS shares a row at most. Repeated rows count once. The bound holds up to chance and the count's error.
    """
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).select("text", "lang", F.xxhash64(F.col("doc_id").cast("string"), "text").alias("h"))
    # One row for each language.
    sizes = {r.lang: r.n for r in known.groupBy("lang").agg(F.approx_count_distinct("h", 0.02).alias("n")).collect()}
    if not sizes:
        return docs.sparkSession.createDataFrame([], "lang string, h long, buckets binary, shares binary")
    limits = F.create_map(*[F.lit(v) for lang, n in sizes.items() for v in (lang, min(1.0, ROWS_PER_LANGUAGE / max(1, n)))])
    place = F.pmod(F.col("h"), F.lit(1 << 40)) / F.lit(float(1 << 40))

    def featurise(batches):
        for b in batches:
            rows = [r for r in zip(*(b.column(c).to_pylist() for c in ("lang", "h", "text"))) if has_letter(r[2])]
            found = features([t.replace("\0", " ") for *_, t in rows])
            yield batch_of(SAMPLE, [r[0] for r in rows], [r[1] for r in rows], [k.astype("<u4").tobytes() for k, _ in found], [v.astype("<f4").tobytes() for _, v in found])

    chosen = known.filter(place < limits[F.col("lang")])
    return chosen.mapInArrow(featurise, "lang string, h long, buckets binary, shares binary").dropDuplicates(["lang", "h"])


def fit(docs: DataFrame) -> Model:
    rows = sorted(training_sample(docs).collect(), key=lambda r: (r.lang, r.h))  # about ROWS_PER_LANGUAGE rows a language
    return Model([(np.frombuffer(r.buckets, "<u4").astype(np.int64), np.frombuffer(r.shares, "<f4")) for r in rows], [r.lang for r in rows])


OUT = arrow_schema("lang_pred string,score double")


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with lang_pred and score, in place of columns of these names; ``und`` and 0 for null texts and texts without letters.

    The family of the highest share wins, then the language of most votes, then of the highest sum of shares, then the first
    by name. Repeated rows are scored each, texts of any length whole.
    """
    base = docs.drop("lang_pred", "score")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS weights for each classifier
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema) + ", lang_pred string, score double"

    def score(batches):
        import pyarrow as pa

        for b in batches:
            langs, scores = shared.value.predict([(x or "").replace("\0", " ") for x in b.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*b.schema.names, "lang_pred", "score"])

    return base.mapInArrow(score, schema)


def op10_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = predict(docs.select(F.col("doc_id").cast("long"), "text"), fit(docs))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def accepted(docs: DataFrame, min_score: float = 0.3) -> DataFrame:
    """``docs`` without the rows that get ``und`` or a score under ``min_score``. All columns are carried, of whatever names."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs))  # BUCKETS weights for each classifier

    def keep(batches):
        import pyarrow as pa

        for b in batches:
            langs, scores = shared.value.predict([(x or "").replace("\0", " ") for x in b.column("text").to_pylist()])
            yield b.filter(pa.array([lang != UNDETERMINED and s >= min_score for lang, s in zip(langs, scores)], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
