"""Both tokenizers' ids against the libraries' own, on texts that meet every border of pieces and parts."""

import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from headrisk.llm import sentencepieces, tokens

ODD = ["", None, " ", "  ", "\n\n", "a", " a", "a ", "a.b", "a.b c,d", " x'twas,", "é.é ×. ÷, x", "hello <|endoftext|> hi", "tab\there", "  lead", "trail  \n", "don't, we'll. I'M",
       "日本語。 ok", "a  b\n\n c", "0.5,1", "ÿ,ÿ ß!", "'s ,'s a,'s", "#*$ a#*$", " nbsp .", "\x1c x", "😀 x"]


def random_texts(alphabet: str, n: int = 4000) -> list[str]:
    rng = random.Random(7)
    return ["".join(rng.choice(alphabet) for _ in range(rng.randrange(30))) for _ in range(n)]


def coded(ids) -> list[bytes]:
    return [np.array(x, "<u4").tobytes() for x in ids]


def test_encoder_equals_the_plain_call(monkeypatch):
    monkeypatch.setattr(tokens, "JOINED", 7)  # many joined texts
    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = ODD + random_texts("ab cé\n.,'#×0 日d") + ODD
    plain = Tokenizer.from_file(path)
    want = coded(plain.encode(t or "", add_special_tokens=False).ids for t in texts)
    assert tokens.Encoder(path, 100).ids(texts) == want  # a memory that forgets
    assert tokens.Encoder(path, 10**6).ids(texts) == want


@pytest.mark.parametrize("chars", [1, 50, 1 << 20])
def test_results_do_not_depend_on_what_is_cut_together(monkeypatch, chars):
    monkeypatch.setattr(tokens, "CHARS_AT_ONCE", chars)
    own = tokens.Encoder(public_tokenizers.path("byte_bpe_50k.json"), 1000)
    assert own.ids(ODD) == [own.ids([t])[0] for t in ODD]
    assert own.ids([]) == []


def test_transducer_equals_the_library():
    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    own = sentencepieces.Transducer(path)
    texts = [t for t in ODD if t is None or "\x1c" not in t and " " not in t] + ["▁", "▁▁ a", "a▁ ▁b"] + random_texts("abe thé\n.,'#×0 日d▁")
    assert own.encode(texts) == coded(model.encode([t or "" for t in texts]))
    assert [own.text(x) for x in own.encode(texts)] == [(t or "").replace("▁", " ") for t in texts]


def test_a_state_that_leads_nowhere_is_left_once():
    own = sentencepieces.Transducer(public_tokenizers.path("piece_bpe_32k.model"))
    long = "ab" * 20_000
    assert b"".join(own.written[i] for i in own.path(long)).decode() == long
