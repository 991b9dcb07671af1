"""Token counts by a count-only Viterbi over a unigram vocabulary.

A text is cut where a space follows another character: pieces hold spaces at their beginning only, so none reaches over
such a place. For each word, with the run of spaces before it, Aho-Corasick reports all pieces that end at each place, longest first; dynamic programming keeps for each
place the best sum of scores and the number of pieces on the way to it, and nothing else. Ties go to the piece that
starts first, and a character without a piece of its own costs the lowest score less 10 and counts one token a byte,
as in the tokenizers library's Unigram model with byte fallback. Words are counted once as long as a task keeps them.

Pieces and scores are those of piece_bpe_32k.model, taken as a unigram vocabulary.

Defined results: a null or empty text has no tokens; repeated rows give repeated results; columns of the input are kept,
and those named n_tokens and n_words are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, small_batches

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
PENALTY = 10.0
#: Words that a task keeps, and the longest one it keeps.
KEPT_WORDS, KEPT_LENGTH = 1_000_000, 64


@cache
def vocabulary(model: str = MODEL) -> list[tuple[str, float]]:
    """(piece, score) by id, of all pieces but control ones. No piece has a space behind another character."""
    import public_tokenizers
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(model))
    each = [(m.id_to_piece(i), m.get_score(i)) for i in range(m.get_piece_size()) if not m.is_control(i)]
    if any(SPACE in p.lstrip(SPACE) for p, _ in each):
        raise ValueError(f"{model} has pieces that reach over the beginning of a word")
    return each


class Counter:
    def __init__(self, pieces: list[tuple[str, float]] | None = None) -> None:
        import ahocorasick

        pieces = pieces or vocabulary()
        self.automaton = ahocorasick.Automaton()
        for p, s in pieces:
            self.automaton.add_word(p, (len(p), s))
        self.automaton.make_automaton()
        self.single = {p for p, _ in pieces if len(p) == 1}
        self.unknown = min(s for _, s in pieces) - PENALTY
        self.kept: dict[str, int] = {}

    def of_word(self, word: str) -> int:
        """Pieces on the best way through a word."""
        single, unknown, n = self.single, self.unknown, len(word)
        best: list = [None] * (n + 1)
        count = [0] * (n + 1)
        best[0] = 0.0
        at = 0  # places up to here are final

        def step(to: int) -> None:
            """Make the places up to `to` final: a character without a piece is a way of its own."""
            nonlocal at
            while at < to:
                c = word[at]
                at += 1
                if c not in single and (best[at] is None or best[at - 1] + unknown > best[at]):
                    best[at] = best[at - 1] + unknown
                    count[at] = count[at - 1] + len(c.encode("utf-8", "surrogatepass"))

        for end, (length, score) in self.automaton.iter(word):
            if end > at:
                step(end)
            end += 1
            start = end - length
            total = best[start] + score
            if best[end] is None or total > best[end]:
                best[end] = total
                count[end] = count[start] + 1
        step(n)
        return count[n]

    def of_text(self, text: str | None) -> tuple[int, int]:
        """(tokens, words that are not empty)."""
        if not text:
            return 0, 0
        words = text.replace(" ", SPACE).split(SPACE)
        if words[0] == "":
            words = words[1:]
        kept, total, n_words, run = self.kept, 0, 0, ""
        for w in words:
            if not w:
                run += SPACE
                continue
            n_words += 1
            if run:
                w, run = run + w, ""
            n = kept.get(w)
            if n is None:
                n = self.of_word(SPACE + w)
                if len(w) <= KEPT_LENGTH:
                    if len(kept) >= KEPT_WORDS:
                        kept.clear()
                    kept[w] = n
            total += n
        return total + (self.of_word(run) if run else 0), n_words


COUNTS = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("n_words", T.LongType())])


@F.pandas_udf(COUNTS)
def counts(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    counter = Counter()
    for texts in batches:
        yield pd.DataFrame([counter.of_text(t) for t in texts], columns=["n_tokens", "n_words"], dtype="int64")


def token_counts(df: DataFrame) -> DataFrame:
    """df with n_tokens and n_words of its column text."""
    small_batches(df.sparkSession)
    kept = df.drop("n_tokens", "n_words").withColumn("__n", counts(F.coalesce("text", F.lit(""))))
    return kept.select("*", "__n.n_tokens", "__n.n_words").drop("__n")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, n_words for every document."""
    return token_counts(documents(spark, sf_dir).select("doc_id", "text")).drop("text")


QUERIES = {"op6_token_counts": op6_token_counts}
ORACLE_SQL: dict = {}
