"""Pieces and token counts against the libraries and plain programs."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import pieces, token_counts
from tidemark.llm.queries import vocabulary

from .conftest import sentence


@pytest.fixture(scope="module")
def model():
    return vocabulary("piece_bpe_32k.model").read_bytes()


@pytest.fixture(scope="module")
def loaded(model):
    return pieces.load(model)


@pytest.fixture(scope="module")
def scores(model):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    return sp, {
        sp.id_to_piece(i): (i, sp.get_score(i)) for i in range(sp.get_piece_size())
        if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i))
    }


def best_score(text, scores, floor):
    """The largest sum of scores over all segmentations of a text, and how many characters have no piece."""
    best = [0.0] + [-np.inf] * len(text)
    for i in range(len(text)):
        alone = False
        for j in range(i + 1, min(len(text), i + 24) + 1):
            if text[i:j] in scores:
                alone |= j == i + 1
                best[j] = max(best[j], best[i] + scores[text[i:j]][1])
        if not alone:
            best[i + 1] = max(best[i + 1], best[i] + floor)
    return best[-1]


TEXTS = ["Hello  world, the\nfoo   bar", "é 😀 日本 <s> ", " ", "x\x00y", "thethe the", "a" * 700 + " 漢" * 90, "▁", "naïve façade"]


def test_paths_are_the_best(loaded, scores):
    sp, table = scores
    rng = random.Random(1)
    texts = TEXTS[:-2] + [sentence(rng, 30) for _ in range(40)]
    first, ids = pieces.encode_batch(loaded, pa.array(texts))
    for text, a, b in zip(texts, first, first[1:], strict=False):
        total = 0.0
        own = ids[a:b].tolist()
        k = 0
        while k < len(own):
            if sp.is_byte(own[k]):
                c = int(sp.id_to_piece(own[k])[1:-1], 16)
                k += 1 if c < 0x80 else 2 if c < 0xE0 else 3 if c < 0xF0 else 4
                total += loaded.floor
            else:
                total += sp.get_score(own[k])
                k += 1
        assert total == best_score("▁" + text.replace(" ", "▁"), table, loaded.floor)


def test_agrees_with_the_library_on_short_texts(loaded, scores, model):
    from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

    unigram = sentencepiece_model_pb2.ModelProto()
    unigram.ParseFromString(model)
    unigram.trainer_spec.model_type = 1  # the same pieces and scores, segmented by the best path
    sp = SentencePieceProcessor(model_proto=unigram.SerializeToString())
    rng = random.Random(2)
    for text in [sentence(rng, rng.randrange(1, 4)) for _ in range(60)]:
        _, ids = pieces.encode_batch(loaded, pa.array([text]))
        best = sp.nbest_encode_as_ids(text, 2)[0]
        assert sum(map(sp.get_score, best)) == sum(map(sp.get_score, ids.tolist()))


def test_decoding_gives_texts_back(loaded):
    texts = [*TEXTS, "", None, "  two  spaces  ", "\t\r\n"]
    first, ids = pieces.encode_batch(loaded, pa.array(texts))
    back = pieces.decode_batch(loaded, first, ids).to_pylist()
    assert back == [(t or "").replace("▁", " ") for t in texts]
    assert pieces.decode_batch(loaded, np.array([0, 1, 1]), loaded.byte_id[[0xFF]]).to_pylist() == ["�", ""]


def test_batches_do_not_matter(loaded):
    rng = random.Random(3)
    texts = [*TEXTS, None, ""] + [sentence(rng, rng.randrange(60)) for _ in range(50)]
    first, ids = pieces.encode_batch(loaded, pa.array(texts))
    for i, text in enumerate(texts):
        assert pieces.encode_batch(loaded, pa.array([text], pa.string()))[1].tolist() == ids[first[i] : first[i + 1]].tolist()


def test_double_array():
    rng = random.Random(4)
    keys = sorted({bytes(rng.randrange(256) for _ in range(rng.randrange(1, 5))) for _ in range(3000)})
    base, check, value = pieces.double_array(keys, list(range(len(keys))))

    def find(key):
        state = 0
        for c in key:
            to = base[state] + c + 1
            if check[to] != state:
                return -1
            state = to
        return value[state]

    assert [find(k) for k in keys] == list(range(len(keys)))
    absent = {bytes(rng.randrange(256) for _ in range(3)) for _ in range(3000)} - set(keys)
    assert all(find(k) == -1 for k in absent)


def test_pieces_of_rows(docs, rows, no_docs, model):
    got = pieces.encode(docs, model).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(i for i, _ in rows)
    assert all(len(r["ids"]) == r["n_tokens"] for r in got)
    assert [r["doc_id"] for r in got if not r["same"]] == [305]  # it holds a marker of its own
    digest = {r["doc_id"]: r["ids_sha256"] for r in pieces.round_trip(docs, model).collect()}
    assert all(digest[r["doc_id"]] == hashlib.sha256(np.array(r["ids"], "<i4").tobytes()).hexdigest() for r in got if r["doc_id"])
    back = pieces.decode(pieces.encode(docs, model), model).collect()
    assert Counter((r["doc_id"], r["text"]) for r in back) == Counter((i, (t or "").replace("▁", " ")) for i, t in rows)
    assert pieces.encode(no_docs, model).collect() == [] and pieces.round_trip(no_docs, model).collect() == []


@pytest.fixture(scope="module")
def spec():
    return vocabulary("byte_bpe_50k.json").read_text()


def test_token_counts(docs, rows, no_docs, spec):
    from tokenizers import Tokenizer

    library = Tokenizer.from_str(spec)
    want = Counter((i, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in rows)
    assert Counter(map(tuple, token_counts.token_counts(docs, spec).collect())) == want
    assert token_counts.token_counts(no_docs, spec).collect() == []


def test_counts_of_odd_texts(spec, monkeypatch):
    from tokenizers import Tokenizer

    library = Tokenizer.from_str(spec)
    texts = [
        "it's we'll  I'D\n\n  x\t\ty ", "a<|endoftext|>b <|endoftext|>", "<|endoftext", "日本語 text ééé १२३ Ⅷ ²", "   ", "\r\n\r\n", " a  b   c    d ",
        "  x ​ ý", "😀😀 😀", "word " * 400, "x" * 3000, "…'s don't' 'll", "\x00\x1f",
    ]
    want = [len(library.encode(t, add_special_tokens=False).ids) for t in texts]
    assert token_counts.counter(spec)(texts) == want
    monkeypatch.setattr(token_counts, "REMEMBERED", 5)
    assert token_counts.counter(spec)(texts) == want


def test_long_texts_are_split_safely(spec):
    from tokenizers import Tokenizer

    library = Tokenizer.from_str(spec)
    rng = random.Random(5)
    text = "".join(rng.choice(["word", " ", "  ", "\n", "é", "'s", "12", ", ", "the cat "]) for _ in range(3000))
    cut = token_counts.split_safely(text, 50)
    assert "".join(cut) == text and len(cut) > 50
    assert sum(len(library.encode(x, add_special_tokens=False).ids) for x in cut) == len(library.encode(text, add_special_tokens=False).ids)
    sizes = [sum(len(x) for _, x in block) for block in token_counts.blocks(["word " * 100, "", "x" * 900, "ab " * 9], 200)]
    assert max(sizes[:-1]) <= 900 + 200 and sum(sizes) == 500 + 900 + 27
