import json
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gristmill.llm import bpe, tokens

public = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda texts: [x.ids for x in t.encode_batch(texts, add_special_tokens=False)]


TABLES = bpe.load(bpe.default_path())


def encode(texts, encoder=None):
    raw = [t.encode() for t in texts]
    rows = np.concatenate([[0], np.cumsum([len(b) for b in raw])]).astype(np.int64)
    ids, n = (encoder or bpe.Encoder(TABLES)).encode(np.frombuffer(b"".join(raw), np.uint8), rows)
    return [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] if texts else []


PARTS = ["'", "'s", "'re", "'r", "e", "s", " ", "  ", "\n", "\t", "a", "aaaa", "ing", "é", "日", "本", "1", "23", "½", ".", "..", "!", " ", "　", "🙂", "x", "don't", "we'll", " 'd", "\x1c", "\x85", "​", "ß", "Д", "<|endoftext|>", "\x00"]


def test_texts_of_all_kinds(reference):
    rng = random.Random(5)
    texts = ["".join(rng.choices(PARTS, k=rng.randrange(40))) for _ in range(4000)]
    assert encode(texts) == reference(texts)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_any_text(reference, text):
    assert encode([text]) == reference([text])


def test_every_token_of_the_vocabulary(reference):
    texts = [t.decode("utf-8", "ignore") for t in TABLES.tokens]
    assert encode(texts) == reference(texts)


def test_documents(spark, data, reference):
    texts = [r.text for r in spark.read.parquet(f"{data}/documents.parquet").select("text").where("text is not null").collect()]
    assert encode(texts) == reference(texts)


def test_long_pieces_and_chunks(reference):
    texts = ["ab" * 5000, " " * 3000 + "x", "word " * 1000, "a" * 300 + "b" * 300, ""]
    e = bpe.Encoder(TABLES)
    assert encode(texts, e) == encode(texts, e) == reference(texts)


def test_cuts_do_not_change_ids(reference):
    text = "The quick brown fox  jumps over 12 lazy dogs, isn't it?\n" * 40_000
    data = np.frombuffer(text.encode(), np.uint8)
    assert len(bpe.safe_cuts(data, bpe.CHUNK_BYTES)) > 3
    ids, n = tokens.encode_rows(bpe.Encoder(TABLES), data, np.array([0, len(data)]))
    assert n.tolist() == [len(ids)] and [ids.tolist()] == reference([text])


def test_store_is_emptied(monkeypatch, reference):
    monkeypatch.setattr(bpe, "KEPT_PIECES", 10)
    e = bpe.Encoder(TABLES)
    for k in range(5):
        texts = [f"some {k} words {i} here" for i in range(20)]
        assert encode(texts, e) == reference(texts)


def test_edits_and_appends(reference):
    rng = random.Random(11)
    e, now = bpe.EditableText(TABLES), b""
    for k in range(150):
        new = "".join(rng.choices(PARTS, k=rng.randrange(12)))
        cuts = [0, *(i for i in range(1, len(now)) if now[i] & 0xC0 != 0x80), *([len(now)] if now else [])]
        i, j = sorted(rng.choices(cuts, k=2)) if k % 3 else (len(now), len(now))
        if k % 7:
            j = min(x for x in cuts if x >= min(j, i + 20))
        now = now[:i] + new.encode() + now[j:]
        e.replace(i, j, new)
        assert e.data == now and e.ids == reference([now.decode()])[0]
    e.append(" the end")
    assert e.ids == reference([now.decode() + " the end"])[0]


def test_an_edit_encodes_only_what_is_near():
    e = bpe.EditableText(TABLES, "a long text of many words, " * 2000)
    e.replace(20_000, 20_004, "small")
    assert e.encoded_bytes < 2000


def test_own_vocabulary(tmp_path):
    vocab = {chr(c): i for i, c in enumerate(range(33, 127))} | {"ab": 94, "abab": 95}
    path = tmp_path / "t.json"
    path.write_text(json.dumps({"model": {"vocab": vocab, "merges": ["a b", "ab ab"]}}))
    b = bpe.Bpe(str(path))
    data = np.frombuffer(b"ababab", np.uint8)
    assert b.trace(b.prefix_table(data, np.array([0])), np.array([0]))[0].tolist() == [95, 94]
    with pytest.raises(ValueError):
        b.prefix_table(np.frombuffer(b"\xff", np.uint8), np.array([0]))
