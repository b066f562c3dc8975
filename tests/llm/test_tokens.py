"""Encoding word by word against encoding whole texts."""

import json
import random

import pytest
from tokenizers import Tokenizer

from tessera.llm import packing
from tessera.llm.queries import tokenizer_path


def odd_texts():
    rnd = random.Random(1)
    alphabet = [*"abzAZ09.,!?;:'sÀÉßÿ×÷İ́ı一é<|>_- 　\x01\x1c ªµñ퟿😀Σ", "'ll", "<|endoftext|>"]
    words = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(1, 9))) for _ in range(6000)]
    words += [w + t for w in ("Word", "École", "straße", "ÿ", "a") for t in ("", ".", ",", "!!", "?!.", ";:", ".a", "'s", "..b")]
    return [" ".join(words[i : i + 40]) for i in range(0, len(words), 40)] + ["", " ", "\n\t", "Only plain words here."]


def test_words_encode_like_whole_texts():
    texts, model = odd_texts(), Tokenizer.from_file(tokenizer_path())
    tokenizer = packing.load_tokenizer(tokenizer_path())
    assert isinstance(tokenizer, packing.WordTokenizer)
    expected = [e.ids for e in model.encode_batch(texts, add_special_tokens=False)]
    for _ in range(2):  # the second time all words are known
        assert [x.tolist() for x in tokenizer.encode([t.encode() for t in texts])] == expected
    assert [x.tolist() for x in tokenizer.encode([])] == []


@pytest.mark.parametrize("change", [{"normalizer": None}, {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}}])
def test_other_tokenizers_encode_whole_texts(tmp_path, change):
    with open(tokenizer_path(), encoding="utf-8") as f:
        description = json.load(f) | change
    path = tmp_path / "other.json"
    path.write_text(json.dumps(description))
    texts = odd_texts()[:20] + [""]
    tokenizer = packing.load_tokenizer(str(path))
    assert isinstance(tokenizer, packing.TextTokenizer)
    expected = [e.ids for e in Tokenizer.from_file(str(path)).encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in tokenizer.encode([t.encode() for t in texts])] == expected
