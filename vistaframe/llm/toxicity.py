"""Toxicity: a counterfactual-regularised linear classifier over words and word beginnings.

Labels come from a sample of at most SAMPLE labelled documents, those with the smallest hashes of their ids, one text an
id. Spark counts for every feature in how many toxic and clean sample documents it stands; features that lean
significantly to toxic documents (at most FEATURES of them) are kept. A logistic model with weights of at least 0 is then
fitted on which kept features each sample document has, so that no amount of clean text hides a toxic passage.

Each sentence of the sample that names a group (IDENTITY) gets a twin for every other group of its kind, in which the term
is swapped for the other group's term of the same number and language, and one that names no group there, as all groups
of a kind may be slandered alike. The squared difference between the sentence's and each twin's score is part of the loss,
so terms that merely name a group earn no weight.

Defined results: a null text counts as empty; an empty text has the score of a text without any feature; repeated
documents and labels are allowed (a document with several labels counts as toxic if one says so; of an id's texts the one
with the smallest hash teaches); labels or ids that are null teach nothing; without labels of both kinds every score is
the share of toxic labels; extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, dropped, small_batches, stored

SAMPLE = 20_000
FEATURES = 20_000
LEAST_Z = 2.5
PREFIXES = (4, 5, 6)
PENALTY = 20.0
DECAY = 1e-4
STEPS = 400

# Terms that name groups of people. The terms of a list are of one kind, language, number and form, and each
# names another group, so every term of a list may stand in for every other one. A term may be in several lists.
IDENTITY = {
    "gender": (
        "woman man", "women men", "girl boy", "girls boys", "female male", "frau mann", "frauen männer", "mädchen jungen",
        "femme homme", "femmes hommes", "fille garçon", "filles garçons", "mujer hombre", "mujeres hombres", "niña niño", "niñas niños",
    ),
    "religion": (
        "muslim christian jew hindu buddhist atheist", "muslims christians jews hindus buddhists atheists", "muslim christian jewish hindu buddhist",
        "muslime christen juden hindus buddhisten", "muslimisch christlich jüdisch buddhistisch",
        "musulman chrétien juif hindou bouddhiste", "musulmans chrétiens juifs hindous bouddhistes",
        "musulmán cristiano judío hindú budista", "musulmanes cristianos judíos hindúes budistas",
    ),
    "origin": (
        "african asian european american mexican", "africans asians europeans americans mexicans", "immigrant refugee native", "immigrants refugees natives",
        "afrikaner asiaten europäer amerikaner", "africain asiatique européen américain", "africains asiatiques européens américains",
        "africano asiático europeo americano", "africanos asiáticos europeos americanos",
    ),
    "colour": ("black white brown", "noir blanc", "noirs blancs", "negro blanco", "negros blancos"),
    "orientation": (
        "gay lesbian bisexual straight transgender queer", "homosexual heterosexual bisexual", "schwul lesbisch bisexuell",
        "homosexuel hétérosexuel bisexuel", "homosexuales heterosexuales bisexuales",
    ),
    "age": ("old young elderly teenage", "alte junge", "vieux jeunes", "viejo joven", "viejos jóvenes"),
    "ability": ("disabled blind deaf autistic", "blinde gehörlose", "aveugle sourd", "ciego sordo"),
}
WORDS = re.compile(r"[^\W\d_]+")
SENTENCE = re.compile(r"[.!?\n]+")


def swaps(identity: dict[str, tuple[str, ...]] = IDENTITY) -> dict[str, tuple[tuple[str, ...], ...]]:
    """term -> the other terms of each of its lists."""
    found: dict[str, list[tuple[str, ...]]] = {}
    for lists in identity.values():
        for terms in map(str.split, lists):
            for t in terms:
                found.setdefault(t, []).append(tuple(x for x in terms if x != t))
    return {t: tuple(x) for t, x in found.items()}


def twins(words: set[str], swap: dict[str, tuple[tuple[str, ...], ...]]) -> list[set[str]]:
    """The sets of words in which one named group is swapped for another of its kind, one a term and other group, or left out."""
    out = []
    for term in sorted(words & swap.keys()):
        out.append(words - {term})
        for others in swap[term]:
            out += [(words - {term}) | {o} for o in others]
    return out


class Extractor:
    """Features of words, kept for words seen before; `only` restricts them to a set of features."""

    MOST = 100_000

    def __init__(self, only: dict | None = None) -> None:
        self.only, self.kept = only, {}

    def of_word(self, word: str) -> tuple:
        found = self.kept.get(word)
        if found is None:
            raw = word.encode("utf-8", "surrogatepass")
            each = [zlib.crc32(raw, 1)] + [zlib.crc32(word[:n].encode("utf-8", "surrogatepass"), n) for n in PREFIXES if len(word) >= n]
            found = tuple(each if self.only is None else [f for f in each if f in self.only])
            if len(self.kept) >= self.MOST:
                self.kept.clear()
            self.kept[word] = found
        return found

    def of_words(self, words: set[str]) -> set[int]:
        out: set[int] = set()
        for w in words:
            if found := self.of_word(w):
                out.update(found)
        return out


def words_of(text: str | None) -> set[str]:
    return set(WORDS.findall((text or "").lower()))


def held_out(doc_id: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def labelled_sample(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """text, toxic of at most `sample` labelled documents that are not held out."""
    each = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    few = each.where(~held_out()).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(few), "doc_id")  # `sample` ids at most
    return found.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.first("toxic").alias("toxic")).select("text", "toxic")


def _counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    extract, found = Extractor(), ([], [])
    for batch in batches:
        for text, toxic in zip(batch.text, batch.toxic):
            found[int(toxic > 0)].append(np.fromiter(extract.of_words(words_of(text)), np.int64))
    sums = [np.unique(np.concatenate(f), return_counts=True) if f else (np.zeros(0, np.int64),) * 2 for f in found]
    yield pd.concat([pd.DataFrame({"feature": k, "toxic": n * side, "clean": n * (1 - side)}) for side, (k, n) in enumerate(sums)])


def selected(sample: DataFrame, features: int = FEATURES) -> tuple[dict[int, int], int, int]:
    """feature -> column of those that lean to toxic documents, and the number of toxic and clean documents."""
    n = sample.agg(F.sum((F.col("toxic") > 0).cast("long")).alias("p"), F.count("*").alias("n")).first()
    p, q = n.p or 0, n.n - (n.p or 0)
    if not p or not q:
        return {}, p, q
    both = sample.mapInPandas(_counts, "feature long, toxic long, clean long").groupBy("feature").agg(
        F.sum("toxic").alias("a"), F.sum("clean").alias("b")
    )
    a, b = F.col("a") + 0.5, F.col("b") + 0.5
    odds = F.log(a / (F.lit(p) - F.col("a") + 0.5)) - F.log(b / (F.lit(q) - F.col("b") + 0.5))
    z = odds / F.sqrt(1 / a + 1 / b + 1 / (F.lit(p) - F.col("a") + 0.5) + 1 / (F.lit(q) - F.col("b") + 0.5))
    best = both.withColumn("z", z).where((F.col("a") >= 2) & (F.col("z") >= LEAST_Z)).orderBy(F.col("z").desc(), "feature").limit(features)
    return {r.feature: i for i, r in enumerate(best.select("feature").collect())}, p, q


def _rows(columns: dict[int, int], swap: dict[str, tuple[tuple[str, ...], ...]]):
    """toxic and own columns of a document; own and twin columns of each sentence and twin that differ, and how many twins there are."""
    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        extract = Extractor(columns)
        at = lambda words: sorted(columns[f] for f in extract.of_words(words))
        for batch in batches:
            own, pairs, made = [], [], []
            for text in batch.text:
                own.append(at(words_of(text)))
                both, n = set(), 0
                for sentence in SENTENCE.split(text):
                    words = words_of(sentence)
                    each = twins(words, swap)
                    n += len(each)
                    mine = tuple(at(words)) if each else ()
                    both |= {(mine, t) for t in (tuple(at(x)) for x in each) if t != mine}
                pairs.append([{"own": list(a), "twin": list(b)} for a, b in sorted(both)])
                made.append(n)
            yield pd.DataFrame({"toxic": (batch.toxic > 0).astype(int), "own": own, "pairs": pairs, "twins": made})

    return of


def _flat(lists) -> tuple[np.ndarray, np.ndarray]:
    lists = [np.asarray(x, np.int64) for x in lists]
    row = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    return row, np.concatenate(lists) if lists else np.zeros(0, np.int64)


def fit(own: list, pairs: list[tuple], toxic: np.ndarray, n_features: int, penalty: float = PENALTY) -> tuple[np.ndarray, float]:
    """Weights (0 at least) and bias: log loss, a little decay, and the mean of penalty * (sentence's score - twin's) squared.

    A sentence's words are the same as its twin's but for one, so the difference is taken between the scores' logits near
    the threshold: it cannot hide in scores that other words have already driven to 1.
    """
    row, col = _flat(own)
    (o_row, o_col), (t_row, t_col) = (_flat([p[i] for p in pairs]) for i in (0, 1))
    n, y = len(toxic), toxic.astype(float)
    weight = np.where(y > 0, min(4.0, n / max(1.0, 2 * y.sum())), 1.0) / n
    w, b = np.zeros(n_features), -2.0
    m, v = np.zeros(n_features + 1), np.zeros(n_features + 1)
    for step in range(1, STEPS + 1):
        p = 1 / (1 + np.exp(-(b + np.bincount(row, w[col], n))))
        g = weight * (p - y)
        grad = np.append(np.bincount(col, g[row], n_features) + DECAY * w, g.sum())
        if pairs:
            gap = np.bincount(o_row, w[o_col], len(pairs)) - np.bincount(t_row, w[t_col], len(pairs))
            d = 2 * penalty * gap / (16 * len(pairs))  # a logit near the threshold counts a quarter as score
            grad[:-1] += np.bincount(o_col, d[o_row], n_features) - np.bincount(t_col, d[t_row], n_features)
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        move = 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-10)
        w, b = np.maximum(0, w - move[:-1]), b - move[-1]
    return w, float(b)


class Model:
    """Weights by feature and a bias; small enough to travel with the tasks. twins: how many the sample's sentences have."""

    def __init__(self, weights: dict[int, float], bias: float, twins: int = 0) -> None:
        self.weights, self.bias, self.twins = weights, bias, twins

    def score(self, text: str | None, extract: Extractor) -> float:
        x = self.bias + sum(self.weights[f] for f in extract.of_words(words_of(text)))
        return 1 / (1 + float(np.exp(-min(500.0, max(-500.0, x)))))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, penalty: float = PENALTY, identity: dict = IDENTITY) -> Model:
    small_batches(docs.sparkSession)
    rows = stored(labelled_sample(docs, labels, sample), "toxicity-sample")  # the documents are read once
    columns, p, q = selected(rows)
    if not columns:
        dropped(rows)
        share = p / (p + q) if p + q else 0.0
        return Model({}, float(np.log((share + 1e-9) / (1 - share + 1e-9))))
    made = "toxic int, own array<int>, pairs array<struct<own: array<int>, twin: array<int>>>, twins long"
    found = rows.mapInPandas(_rows(columns, swaps(identity)), made).collect()  # `sample` rows at most
    dropped(rows)
    found.sort(key=lambda r: (r.toxic, r.own, r.pairs))  # the same order, and so the same sums, in every run
    pairs = [(x.own, x.twin) for r in found for x in r.pairs]
    w, b = fit([r.own for r in found], pairs, np.array([r.toxic for r in found]), len(columns), penalty)
    return Model({f: float(w[i]) for f, i in columns.items() if w[i] > 1e-6}, b, sum(r.twins for r in found))


def scored(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """docs with score (or another name), the probability of label 1."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        extract = Extractor(model.weights)
        for texts in batches:
            yield pd.Series([model.score(t, extract) for t in texts], dtype=float)

    return docs.withColumn(name, score(F.coalesce("text", F.lit(""))))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored(docs, model).select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


QUERIES = {"op4_toxicity": op4_toxicity}
ORACLE_SQL: dict = {}
