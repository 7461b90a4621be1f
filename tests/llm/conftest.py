"""Small tables with the cases that every operator must take."""

import random

import pytest

WORDS = "anat with by of nteres atre are that thing ering onheed und der die das queco ción los las été leaux".split()


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + ("." if rng.random() < 0.1 else "") + ("\n" if rng.random() < 0.05 else "") for _ in range(n))


CLASHING = "size string, digest string, score string, start string, length string, key string, part string, fp string, k string, n string, u string, v string, component string, h string, row string, evidence string, _spans string, _new string, _ID string, cut_id string, is_cut string, _copies string, _copy string, dropped_id string, _repeated string"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, repeated rows, ties, and columns whose names the operators use themselves."""
    rows = [(1, prose(1, 60), "en", "a"), (1, prose(1, 60), "en", "a"), (2, prose(1, 60), "en", None), (3, None, None, "b"), (4, "", "de", "b"), (5, " \n\t ", "de", None), (None, prose(2, 30), None, "c"), (6, prose(3, 9000), "fr", "a"), (7, "123 456 !!", "es", "c"), (8, "x", "en", "a"), (9, "Ünïcode \U0001F600 中文 it's", "fr", "b"), (10, "a" * 5000, "en", "a"), (11, "<|endoftext|>", None, "a")]
    rows = [(*r, None if r[1] is None else len(r[1])) + ("z",) * CLASHING.count(" string") for r in rows]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + CLASHING)


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def texts(docs):
    return {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}


@pytest.fixture(scope="session")
def vocabulary():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="session")
def tokenizer(vocabulary):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary)
