import hashlib
import struct

import pytest
from llm_cases import HARD, texts


def brute_counts():
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    return {i: len(model.encode(t)) for i, t in texts().items()}


@pytest.mark.parametrize("chunk", [1, 7, 1 << 15])
def test_token_counts(hard, none, chunk):
    from riskloom.llm.token_counts import count_tokens

    got = {r.doc_id: r for r in count_tokens(hard, chunk=chunk, limit=50).collect()}
    want = brute_counts()
    assert {i: r.n_tokens for i, r in got.items()} == want
    assert all(r.n_bytes == len(texts()[i].encode()) and r.over_limit == (want[i] > 50) and r.score == "score" for i, r in got.items())
    assert count_tokens(none).collect() == []


def test_chunk_maps_compose():
    from riskloom.llm.token_counts import ChunkMap, composed, count_text, machine_for

    machine = machine_for("piece_bpe_32k.model")
    text = "▁the▁cat▁▁sat▁on" + "ab" * 40 + "▁mats"
    for size in (1, 2, 3, 5, 11):
        maps = [ChunkMap.of(machine, text[i : i + size]) for i in range(0, len(text), size)]
        left = maps[0]
        for m in maps[1:]:
            left = left.then(machine, m)
        whole = composed(machine, maps)
        assert (whole.head, whole.count, whole.exit) == (left.head, left.count, left.exit)
    assert count_text(machine, "", 5) == 0


def tiktoken_encoder():
    import public_tokenizers
    import tiktoken

    from riskloom.llm.byte_bpe import read_ranks

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks("byte_bpe_multi_50k.tiktoken"), special_tokens={})


def test_byte_bpe(hard, none):
    from riskloom.llm.byte_bpe import decode_ids, encode_texts

    plain, coded = tiktoken_encoder(), encode_texts(hard, keep_ids=True)
    rows = coded.collect()
    assert len(rows) == len(HARD)
    for r in rows:
        ids = plain.encode_ordinary(texts()[r.doc_id])
        assert r.ids == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts()[r.doc_id].encode()).hexdigest()
    back = {r.doc_id: bytes(r.decoded) for r in decode_ids(coded, carry=["doc_id"]).collect()}
    assert back == {i: t.encode() for i, t in texts().items()}
    assert encode_texts(none).collect() == []


def test_long_words_merge_like_short_ones():
    import random

    from riskloom.llm import byte_bpe

    draw = random.Random(3)
    words = ["".join(draw.choice("abeinrst") for _ in range(n)) for n in (300, 700)] + ["a" * 1000, "ab" * 400, "the" * 200]
    codec = byte_bpe._codec("byte_bpe_multi_50k.tiktoken")
    # No spaces, equal ranks side by side, parts of the vocabulary glued together, and words that only many rounds finish.
    parts = [t.decode() for t in codec.ranks if t.isalpha() and t.isascii()]
    words += ["".join(chr(draw.randrange(0x4E00, 0x4E00 + 600)) for _ in range(4000)), "".join(draw.choices(parts[:12], k=300)), "the" * 201 + "a" * 333]
    words += ["".join(draw.choices(parts, k=n)) for n in (90, 90, 90, 3000)] + ["".join(draw.choices(("in", "the", "er", "tion", "s", "ss", "i"), k=400))]
    assert codec.encode([w.encode() for w in words]) == [tiktoken_encoder().encode_ordinary(w) for w in words]
    with pytest.raises(ValueError):
        codec.decode([[60_000]])
    codec.close()


def test_units_forgotten_in_between(monkeypatch):
    from riskloom.llm import byte_bpe

    monkeypatch.setattr(byte_bpe, "KNOWN_UNITS", 2)
    monkeypatch.setattr(byte_bpe, "KNOWN_WORDS", 2)
    coder = byte_bpe.Texts(byte_bpe._codec("byte_bpe_multi_50k.tiktoken"))
    for t in ["the cat sat on the mat", " lead  two\n\n nl ", "the cat", "it's x y"] * 2:
        ids, back = coder.code([t.encode()])[0]
        assert struct.unpack(f"<{len(ids) // 4}I", ids) == tuple(tiktoken_encoder().encode_ordinary(t)) and back == t.encode()
