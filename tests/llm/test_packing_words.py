"""Ids of words: the tokenizer's own, with few texts going through all of its steps."""

import random

from helixspark.llm import packing


def test_odd_texts_have_the_tokenizers_ids(monkeypatch):
    monkeypatch.setattr(packing, "CACHE_WORDS", 40)
    ids, g = packing.WordIds(packing.default_tokenizer()), random.Random(11)
    parts = [chr(k) for k in range(256)] + [*"abcdefghABCDEFGH  \n,.'", "ÀÉÎ", "Straße", "<|endoftext|>", "<|ENDOFTEXT|>", "<|StartOfText|>", "'S ", "'ll", "...", ",.", "é", "́", "İ", "Σς", "ǅ", "K", " ", "日本", "слово,", "Слово", "😀"]
    latin = [p for p in parts if packing.latin(p)]
    texts = ["".join(g.choices(g.choice([parts, latin, parts[:128]]), k=g.randrange(1, 60))) for _ in range(3000)] + ["", "a" * 5000, "É" * 3000 + "!" * 500]
    assert ids.texts(texts) == [ids.alone(t) for t in texts] and ids.texts([None]) == [b""]
    assert len(ids) <= 40


def test_runs_of_letters_skip_the_steps_before_the_model():
    """op4_packing failed its CPU budget: each new word took all steps of the tokenizer."""
    ids = packing.WordIds(packing.default_tokenizer())
    text = "Quelque façon, OÙ thereof: größer... xyzzyx\nFrobnicated!! Ångström"
    want, taken, tokenizer = ids.alone(text), [], ids.tokenizer

    class Spy:
        def encode(self, text, **kw):
            taken.append(text)
            return tokenizer.encode(text, **kw)

    ids.tokenizer = Spy()
    assert ids.texts([text]) == [want] and not any(c.isalpha() for t in taken for c in t)
