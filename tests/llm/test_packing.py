from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from creditledger.llm.packing import encoder, pack
from creditledger.llm.queries import tokenizer_file
from tests.llm.conftest import EDGES

WHOLE = Tokenizer.from_file(tokenizer_file())


def ids(text):
    return [*WHOLE.encode(text or "", add_special_tokens=False).ids, 0]


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60) | st.text(alphabet=" \n\t ab1'.s<|endoftext|>é😀", max_size=60))
def test_ids_are_the_tokenizers(text):
    assert encoder(tokenizer_file())(text) == ids(text)[:-1]


def check(rows, pieces, max_tokens, max_segments, max_loss):
    by_row, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        assert p.length == len(p.ids) // 4 > 0
        by_row[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
    padding = 0
    for at in by_sequence.values():
        at.sort(key=lambda p: p.offset)
        ends = np.cumsum([p.length for p in at])
        assert [p.offset for p in at] == [0, *ends[:-1]]
        assert ends[-1] <= max_tokens and len(at) <= max_segments and sum(p.n_loss for p in at) <= max_loss
        padding += 0 if ends[-1] & (ends[-1] - 1) == 0 else max_tokens - ends[-1]
    for i, text, free in rows:
        at = sorted(by_row[i], key=lambda p: p.start)
        assert b"".join(p.ids for p in at) == np.array(ids(text), "<u4").tobytes()
        assert [p.start for p in at] == [0, *np.cumsum([p.length for p in at])[:-1]]
        assert {p.doc_tokens for p in at} == {len(ids(text))}
        assert sum(p.n_loss for p in at) == max(0, len(ids(text)) - free)
    return padding


@pytest.mark.parametrize("limits", [(1024, 256, 1024), (64, 3, 64), (64, 8, 20)])
def test_limits_and_round_trip(spark, limits):
    rows = [(i, f"word {i} " * (i * 13 % 90), i % 17) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, loss_from long").repartition(3)
    pieces = pack(docs, tokenizer_file(), *limits).collect()
    padding = check(rows, pieces, *limits)
    if limits[0] == 1024:
        assert padding <= 0.01 * sum(p.length for p in pieces)


def test_edges(edges, nothing):
    unique = edges.dropDuplicates(["doc_id"])
    rows = [(i, t, 0) for i, t in {r[0]: r[1] for r in EDGES}.items()]
    check(rows, pack(unique, tokenizer_file()).collect(), 1024, 256, 1024)
    assert pack(nothing, tokenizer_file()).count() == 0
    assert sum(p.start == 0 for p in pack(edges, tokenizer_file()).collect()) == len(EDGES)


def test_added_tokens_are_one_id(spark):
    assert encoder(tokenizer_file())("a <|endoftext|> b") == [64, 220, 50256, 275]
    rows = [(1, "a <|endoftext|> b" * 300, 0), (2, "<|endoftext|>", 0), (3, "<|endoftext |>", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, loss_from long")
    check(rows, pack(docs, tokenizer_file()).collect(), 1024, 256, 1024)
