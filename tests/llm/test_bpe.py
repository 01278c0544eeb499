from __future__ import annotations

import pytest

from docengine.llm import bpe

public = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")
from hypothesis import given, settings  # noqa: E402
from hypothesis import strategies as st  # noqa: E402

PATH = public.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def both():
    return bpe.ForcedBoundaryBpe(open(PATH, encoding="utf-8").read()), tokenizers.Tokenizer.from_file(PATH)


def check(both, text):
    own, lib = both
    ids, decoded = own.encode(text)
    want = lib.encode(text, add_special_tokens=False).ids
    assert [int.from_bytes(ids[k : k + 4], "little") for k in range(0, len(ids), 4)] == want, text
    assert decoded.decode() == lib.decode(want, skip_special_tokens=False), text


@settings(max_examples=400, deadline=None)
@given(st.text(max_size=60))
def test_any_text(both, text):
    check(both, text)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="abqxzTS' .,!?0\n\t\x1cé\u0301ßİΣ\xa0\xad<|endoftext>", max_size=40))
def test_hard_texts(both, text):
    check(both, text)


@pytest.mark.parametrize("text", ["", " ", "<|endoftext|>a<|startoftext|>", "<|EndOfText|>", "it's WE'LL 'S", "q" * 5000, "xqzj" * 3000, "word " * 20000])
def test_some_texts(both, text):
    check(both, text)


def test_pieces_are_cut_where_no_token_joins(both):
    own, _ = both
    for word in ("xqzj", "hello", "qqxzzkj"):
        cut = own.pieces(word)
        assert "".join(cut) == word
        assert all(a[-1] + b[0] not in own.pairs for a, b in zip(cut, cut[1:], strict=False))


def test_table_is_bounded(both, monkeypatch):
    monkeypatch.setattr(bpe, "CACHED", 10)
    own = bpe.ForcedBoundaryBpe(open(PATH, encoding="utf-8").read())
    for k in range(40):
        check((own, both[1]), " ".join(f"word{chr(97 + i % 26)}{'x' * (k % 7)}" for i in range(k)))
    assert len(own.young) <= 10 and len(own.old) <= 10


def test_columns(docs, clash, empty, rows, both):
    out = bpe.encode(docs, PATH).collect()
    assert len(out) == len(rows)
    for r in out:
        want = both[1].encode(r["text"] or "", add_special_tokens=False).ids
        assert r["n_tokens"] == len(want) == len(r["ids"]) // 4 and r["decoded"] == both[1].decode(want, skip_special_tokens=False)
    more = bpe.encode(clash, PATH, decode=False)
    assert more.columns == [*clash.columns, "_n_tokens", "_ids"] and more.count() == len(rows)
    assert bpe.encode(empty, PATH).count() == 0
