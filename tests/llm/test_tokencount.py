import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer, models, pre_tokenizers

from vistaframe.llm import tokencount

# the whole file's vocabulary, read here once more, and whole texts as one piece for the library
MODEL = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
VOCABULARY = [(MODEL.id_to_piece(i), MODEL.get_score(i)) for i in range(MODEL.get_piece_size()) if not MODEL.is_control(i)]
LIBRARY = Tokenizer(models.Unigram(VOCABULARY, 0, True))
LIBRARY.pre_tokenizer = pre_tokenizers.Metaspace("▁", "always", False)


def library(text):
    return len(LIBRARY.encode(text, add_special_tokens=False).ids)


def test_query_equals_the_library(spark, sf_dir):
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = tokencount.op6_token_counts(spark, sf_dir).collect()
    assert len(got) == len(rows) and all(r.n_tokens == library(rows[r.doc_id]) for r in got)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="abtheinr ▁\n\t1é漢\u0007🙂<0x41>", max_size=40))
def test_any_text_equals_the_library(text):
    assert COUNTER.of_text(text)[0] == library(text)


COUNTER = tokencount.Counter()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.from_regex("▁{0,3}[ab]{0,4}", fullmatch=True).filter(bool), st.integers(-3, -1)), min_size=1, max_size=12), st.text("abc ", max_size=12))
def test_ties_equal_the_library(pieces, text):
    vocab = [("<unk>", 0.0)] + [(f"<0x{i:02X}>", 0.0) for i in range(256)] + [(p, float(s)) for p, s in (dict(pieces) | {"▁": -1}).items()]
    t = Tokenizer(models.Unigram(vocab, 0, True))
    t.pre_tokenizer = pre_tokenizers.Metaspace("▁", "always", False)
    assert tokencount.Counter(vocab).of_text(text)[0] == len(t.encode(text).ids)


def test_no_piece_is_left_out():
    assert tokencount.vocabulary() == VOCABULARY and len(VOCABULARY) == 31_998


def test_edges(spark):
    data = [(1, None), (2, ""), (3, " "), (3, " "), (None, "  two  words "), (4, "x" * 20000), (5, "漢字" * 3000)]
    df = spark.createDataFrame(data, "doc_id long, text string").selectExpr("*", "'mine' as n_tokens", "1 as counts")
    got = tokencount.token_counts(df).collect()
    assert len(got) == len(data) and all(r.n_tokens == library(r.text or "") for r in got)
    assert tokencount.token_counts(df.limit(0)).collect() == []


@pytest.mark.parametrize("text", ["<s> </s>", "a<0x41>b", "▁▁a", "a▁b", "\x00", " " * 40 + "x" + " " * 7, "a  b   c    ", "      "])
def test_odd_texts(text):
    assert COUNTER.of_text(text)[0] == library(text)
