import random

import pytest

from sensorloom.llm import tokens
from tests.llm.data import documents, empty, texts

sentencepiece = pytest.importorskip("sentencepiece")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=tokens.default_model())


def check(library, cases):
    table, memo = tokens.piece_table(tokens.default_model()), {}
    assert tokens.count_texts(cases, table, memo) == [len(x) for x in library.encode(cases)]


def test_awkward_texts(library):
    check(library, ["", " ", "  ", "a  b", " a ", "\n\n\t", "a\r\n;\r", "<s> </s> <unk> <0x41>", "▁▁x ▁", "é ﬁ ① 　", "😀😀", "\x00\x01", "1234567890", "a" * 3000, " " * 2500, "=" * 500 + "-" * 500, "aaab" * 700 + " " * 3 + "ab" * 40, "日本語テキスト"])


def test_random_texts(library):
    r = random.Random(7)
    letters = "aabcdeehillnnoorsstt   ▁.,;{}()\n\r\té€漢😀AB01=-_/"
    check(library, ["".join(r.choice(letters) for _ in range(r.randrange(200))) for _ in range(400)])


def test_heap_and_rounds_agree():
    table = tokens.piece_table(tokens.default_model())
    r = random.Random(8)
    for _ in range(60):
        row = "▁" * r.randrange(6) + "".join(r.choice("theraniso=") for _ in range(r.randrange(1, 60)))
        assert table._heap(row) == table.count([row])[0]


def test_counts_of_a_table(spark, library):
    rows = texts()
    got = {(r.doc_id, r.n_bytes, r.n_tokens) for r in tokens.token_counts(documents(spark, rows)).collect()}
    assert got == {(i, len((t or "").encode()), len(library.encode(t or ""))) for i, t, *_ in rows}
    assert tokens.token_counts(documents(spark, rows)).count() == len(rows)
    assert tokens.token_counts(empty(spark)).collect() == []
