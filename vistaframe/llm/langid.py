"""Language of web pages by Bayesian fusion of four kinds of evidence.

Text: a naive Bayes model of character trigrams in hash bins, counted over all documents with a language by grouped
aggregation. Markup: the language that the page declares. Address: a country suffix that stands for a language. Host:
what the other pages of the host, its domain and the whole table look like, smoothed level by level, so a host with few
pages leans on its domain and a domain on the table. How far declarations and suffixes can be trusted is counted, too,
as their agreement with the text over all pages. The product of all likelihoods and the host's prior is normalised.

Long texts would drown all other evidence, as neighbouring trigrams are not independent: the mean trigram counts as
FREE_TRIGRAMS independent ones at most.

Defined results: a null or empty page has no text evidence; a page without host stands by itself under the whole table;
without any document to learn from every page has a null language; repeated rows give repeated results; ties go to the
smaller language code; extra columns are ignored.
"""

from __future__ import annotations

import html as markup
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, dropped, small_batches, stored

BINS = 1 << 14
FREE_TRIGRAMS = 60
#: Pages' worth of the level above that a host or a domain starts with.
PRIOR_PAGES = 5.0

# Country suffixes that stand for one language.
SUFFIXES = {"de": "de", "at": "de", "fr": "fr", "es": "es", "mx": "es", "ar": "es", "co": "es", "uk": "en", "us": "en", "au": "en", "ie": "en", "nz": "en",
            "it": "it", "pt": "pt", "br": "pt", "nl": "nl", "pl": "pl", "ru": "ru", "se": "sv", "dk": "da", "fi": "fi", "cz": "cs", "jp": "ja", "cn": "zh", "kr": "ko"}
# Labels under which a country's own registry gives out names.
SECOND_LEVEL = ("co", "com", "org", "net", "ac", "gov", "edu")
HIDDEN = re.compile(r"(?is)<(script|style|noscript|template)\b.*?(?:</\1\s*>|\Z)|<!--.*?(?:-->|\Z)|<[^>]*>?")
LETTERS = re.compile(r"[\W\d_]+")
DECLARED = r"(?is)<html\b[^>]*?\slang\s*=\s*[\"']?\s*([a-z]{2,3})"
HOST = r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"


def visible(page: str | None) -> str:
    """The text of a page: no scripts, styles, comments or tags; entities decoded."""
    return markup.unescape(HIDDEN.sub(" ", page or ""))


def trigrams(text: str) -> np.ndarray:
    """Hash bins of the character trigrams of a text's words."""
    codes = np.frombuffer(f" {LETTERS.sub(' ', text.lower()).strip()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    if len(codes) < 4:
        return np.zeros(0, np.int64)
    h = (codes[:-2] * np.uint32(0x9E3779B1) + codes[1:-1]) * np.uint32(0x85EBCA6B) + codes[2:]
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0xC2B2AE35)
    return (h >> np.uint32(18)).astype(np.int64)  # the high 14 bits


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, text in zip(batch.lang, batch.text):
            sums.setdefault(lang, np.zeros(BINS, np.int64))
            sums[lang] += np.bincount(trigrams(text), minlength=BINS)
    for lang, n in sums.items():
        at = np.flatnonzero(n)
        yield pd.DataFrame({"lang": lang, "bin": at, "n": n[at]})


class TextModel:
    """Log probabilities of bins by language: as many numbers as languages times BINS."""

    def __init__(self, langs: list[str], logs: np.ndarray) -> None:
        self.langs, self.logs = langs, logs

    def likelihood(self, text: str) -> list[float]:
        """Log likelihood of a text under each language, as of FREE_TRIGRAMS independent trigrams at most."""
        bins = trigrams(text)
        if not len(bins):
            return [0.0] * len(self.langs)
        return (self.logs[:, bins].mean(1) * min(len(bins), FREE_TRIGRAMS)).tolist()


def train(docs: DataFrame) -> TextModel:
    """The text model of documents (text, lang); rows without either do not count."""
    small_batches(docs.sparkSession)
    rows = docs.where("text is not null and lang is not null").select("lang", "text").mapInPandas(_count, "lang string, bin int, n long")
    found = rows.groupBy("lang", "bin").agg(F.sum("n").alias("n")).toPandas()  # languages x BINS numbers at most
    langs = sorted(found.lang.unique())
    counts = np.zeros((len(langs), BINS))
    counts[found.lang.map({x: i for i, x in enumerate(langs)}).to_numpy(int), found.bin.to_numpy(int)] = found.n
    logs = np.log(counts + 0.5) - np.log(counts.sum(1, keepdims=True) + 0.5 * BINS) if len(langs) else counts
    return TextModel(langs, logs)


def evidence(pages: DataFrame, model: TextModel) -> DataFrame:
    """page_id, host, domain, declared, suffix, text: array of log likelihoods by language."""
    small_batches(pages.sparkSession)

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def likelihoods(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([model.likelihood(visible(t)) for t in texts], dtype=object)

    none = lambda c: F.when(c != "", F.lower(c))
    host = none(F.regexp_extract("url", HOST, 1))
    parts = F.split(F.col("host"), "\\.")
    registry = (F.size(parts) >= 3) & (F.length(F.element_at(parts, -1)) == 2) & F.element_at(parts, -2).isin(*SECOND_LEVEL)
    known = F.create_map(*[F.lit(x) for kv in SUFFIXES.items() for x in kv])
    return (
        pages.select(
            "page_id", host.alias("host"), none(F.regexp_extract("html", DECLARED, 1)).alias("declared"),
            likelihoods(F.coalesce("html", F.lit(""))).alias("text"),
        )
        .withColumn("domain", F.array_join(F.slice(parts, -F.least(F.size(parts), F.when(registry, F.lit(3)).otherwise(F.lit(2))), 3), "."))
        .withColumn("suffix", F.try_element_at(known, F.element_at(parts, -1)))
    )


def _normal(logs: Column) -> Column:
    """Probabilities of an array of log weights."""
    top = F.array_max(logs)
    raised = F.transform(logs, lambda x: F.exp(x - top))
    total = F.aggregate(raised, F.lit(0.0), lambda a, x: a + x)
    return F.transform(raised, lambda x: x / total)


def _trust(rows: DataFrame, langs: list[str], column: str) -> float:
    """How often a hint names the language that the text shows, over all pages that have the hint and any text."""
    r = rows.where(F.col(column).isin(langs) & F.exists("text", lambda x: x != 0)).agg(
        F.sum(F.get(F.col("seen"), F.array_position(_codes(langs), F.col(column)).cast("int") - 1)).alias("a"), F.count("*").alias("n")
    ).first()
    return min(0.98, ((r.a or 0.0) + 4.0) / (r.n + 5.0))


def _codes(langs: list[str]) -> Column:
    return F.array(*[F.lit(x) for x in langs])


def _hint(langs: list[str], column: str, trust: float) -> Column:
    """Log likelihood of a hint under each language; nothing for a hint that is missing or names no known language."""
    rest = (1 - trust) / max(1, len(langs) - 1)
    each = F.transform(_codes(langs), lambda x: F.when(x == F.col(column), F.lit(float(np.log(trust)))).otherwise(F.lit(float(np.log(max(rest, 1e-9))))))
    return F.when(F.col(column).isin(langs), each).otherwise(F.array_repeat(F.lit(0.0), len(langs)))


def _sums(rows: DataFrame, by: list[str], size: int) -> DataFrame:
    """n and s: pages and summed probabilities by group; sums of plain columns, combined before they are shuffled."""
    out = rows.groupBy(*by).agg(F.count("*").alias("n"), *[F.sum(F.get("seen", F.lit(i))).alias(f"s{i}") for i in range(size)])
    return out.select(*by, "n", F.array(*[F.col(f"s{i}") for i in range(size)]).alias("s"))


def identify(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """page_id, lang, confidence, host, declared for every page (page_id, url, html); docs (text, lang) teach the text model."""
    model = train(docs)
    langs, size = model.langs, len(model.langs)
    if not langs:
        none = F.lit(None).cast("string")
        return pages.select("page_id", none.alias("lang"), F.lit(None).cast("double").alias("confidence"), none.alias("host"), none.alias("declared"))
    found = stored(evidence(pages, model).withColumn("seen", _normal(F.col("text"))), "lang-text")
    trust = {c: _trust(found, langs, c) for c in ("declared", "suffix")}
    add = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    own = add(add(F.col("text"), _hint(langs, "declared", trust["declared"])), _hint(langs, "suffix", trust["suffix"]))
    rows = stored(found.withColumn("own", own).withColumn("seen", _normal(F.col("own"))).drop("text"), "lang-own")
    dropped(found)
    hosts = _sums(rows.where("host is not null"), ["host", "domain"], size)
    domains = hosts.groupBy("domain").agg(F.sum("n").alias("n"), *[F.sum(F.get("s", F.lit(i))).alias(f"s{i}") for i in range(size)]).select(
        "domain", F.col("n").alias("dn"), F.array(*[F.col(f"s{i}") for i in range(size)]).alias("ds")
    )
    every = rows.agg(F.count("*").alias("n"), *[F.sum(F.get("seen", F.lit(i))).alias(f"s{i}") for i in range(size)]).first()
    table = [((every[f"s{i}"] or 0.0) + 1.0) / (every.n + size) for i in range(size)]
    levels = hosts.join(domains, "domain").select("host", "n", "s", "dn", "ds")
    joined = rows.join(levels, "host", "left")

    def level(s: str, n: str, above: Column) -> Column:
        """Shares of a level without the page itself, with PRIOR_PAGES pages' worth of the level above."""
        rest = F.zip_with(F.col(s), F.col("seen"), lambda x, y: F.greatest(F.lit(0.0), x - y))
        return F.zip_with(rest, above, lambda x, p: (x + PRIOR_PAGES * p) / (F.col(n) - 1 + PRIOR_PAGES))

    top = F.array(*[F.lit(float(p)) for p in table])
    prior = F.when(F.col("n").isNotNull(), level("s", "n", level("ds", "dn", top))).otherwise(top)
    after = joined.select("page_id", "host", "declared", _normal(F.zip_with("own", prior, lambda x, p: x + F.ln(F.greatest(p, F.lit(1e-12))))).alias("p"))
    best = F.array_max("p")
    return after.select("page_id", F.get(_codes(langs), F.array_position("p", best).cast("int") - 1).alias("lang"), best.alias("confidence"), "host", "declared")


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every page, with its probability."""
    return identify(spark.read.parquet(f"{sf_dir}/pages.parquet"), documents(spark, sf_dir))


QUERIES = {"op9_langid": op9_langid}
ORACLE_SQL: dict = {}
