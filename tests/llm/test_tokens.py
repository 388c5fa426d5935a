import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidemark.llm.repair_files import Shard, compress, digest_token_files, read_token_files, shard_bytes, write_token_files
from tidemark.llm.tokens import encoder

ODD = [
    "", "  a  b", "don't 're'ady x'll", "é, ü. ñ! ç×, a÷b ÷,", "tab\tx\n\n y \r\n z", "a  b c", "x　 y", "1234 5,6;7",
    "İstanbul K ſs. Σας ", "a" * 400 + " b", "日本語 。text", "é, é! é'", "🙂🙂,x 🙂 ,", "\x1c a \x1f b", "<|endoftext|> a<|endoftext|>b",
    " ", "\n", "a ", "a\n\n\nb", "..\n..", "A'S B'Re", "½,² x²,", "\x00\x01 a\x00b", "ª, º. µ!", "x̀, ̀x", None, "zero​width ,", "a  b",
]
FILES = [("byte_bpe_50k.json", False), ("word_bpe_49k.json", True)]


def encoded(path, plain_case, texts):
    out = []
    for ids, n in encoder(path, plain_case).encode(pa.array(texts, pa.string())):
        at = np.cumsum(n)
        out += [ids[e - k : e].tolist() for e, k in zip(at.tolist(), n.tolist())]
    return out


@pytest.mark.parametrize("name, plain_case", FILES)
def test_pieces_give_the_ids_of_whole_texts(name, plain_case):
    path = public_tokenizers.path(name)
    library = Tokenizer.from_file(path)
    whole = [e.ids for e in library.encode_batch([t or "" for t in ODD], add_special_tokens=False)]
    assert encoded(path, plain_case, ODD) == whole


@pytest.mark.parametrize("name, plain_case", FILES)
@settings(max_examples=200, deadline=None)
@given(texts=st.lists(st.text(alphabet=st.one_of(st.sampled_from("abAB'st ,.\n\t1é×ñ<| "), st.characters(codec="utf-8")), max_size=30), max_size=5))
def test_any_text(name, plain_case, texts):
    path = public_tokenizers.path(name)
    library = Tokenizer.from_file(path)
    assert encoded(path, plain_case, texts) == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


@settings(max_examples=100, deadline=None)
@given(docs=st.lists(st.lists(st.integers(0, 3), max_size=40), max_size=12))
def test_grammar_round_trip(docs):
    ids = np.array([i for d in docs for i in d], np.uint32)
    ends = np.cumsum([len(d) for d in docs]).astype(np.int64)
    symbols, _, grammar = compress(ids, ends, rounds=6, least=2)
    assert grammar.decode(symbols).tolist() == ids.tolist()
    data, _ = shard_bytes(np.arange(len(docs)), np.ones(len(docs), bool), ids, ends, rounds=6, least=2)
    shard = Shard(data)
    for k, d in enumerate(docs):
        assert shard.ids(k).tolist() == d
        assert shard.ids(k, 3, 9).tolist() == d[3:9]


def test_files_give_back_every_document(spark, tmp_path):
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = [(100 - i, t) for i, t in enumerate(ODD)] + [(500, "word " * 3000), (7, "twin"), (7, "twin"), (None, "no key")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as key", "2 as start").repartition(3)
    manifest = write_token_files(df, f"{tmp_path}/ids", path, least=3)
    library = Tokenizer.from_file(path)
    want = sorted(((k is not None, k or 0), library.encode(t or "", add_special_tokens=False).ids + [0]) for k, t in rows)
    got = sorted(((r.doc_id is not None, r.doc_id or 0), list(r.ids)) for r in read_token_files(manifest).collect())
    assert got == want
    start = 0
    for r in digest_token_files(manifest).orderBy("start").collect():
        ids = next(i for (known, k), i in want if (known, k) == (r.doc_id is not None, r.doc_id or 0))
        assert r.start == start and r.n_tokens == len(ids)
        if r.doc_id not in (7,):
            assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += r.n_tokens
    assert not [p for p in (tmp_path / "ids").iterdir() if p.suffix == ".tmp"]


def test_empty_table(spark, tmp_path):
    empty = spark.createDataFrame([], "doc_id long, text string")
    manifest = write_token_files(empty, f"{tmp_path}/none", public_tokenizers.path("byte_bpe_50k.json"))
    assert digest_token_files(manifest).count() == 0


def test_slots_find_what_was_added():
    from tidemark.llm.tokens import Slots

    rnd = np.random.default_rng(4)
    hashes = np.unique(rnd.integers(0, 2**63, 5_000, dtype=np.uint64))
    table, half = Slots(50), len(hashes) // 2
    table.add(hashes[:half], np.arange(half, dtype=np.int32))
    table.add(hashes[half:], np.arange(half, len(hashes), dtype=np.int32))
    assert (table.find(hashes) == np.arange(len(hashes))).all()
    assert (table.find(hashes + np.uint64(1 << 63)) == -1).all() and len(table.find(hashes[:0])) == 0
