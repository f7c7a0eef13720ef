"""New words of a batch of texts are encoded in one call, to the ids of the whole texts."""

import numpy as np
import public_tokenizers

from usagelens.llm import tokens


class Counting:
    def __init__(self, tokenizer):
        self.tokenizer, self.calls = tokenizer, 0

    def __getattr__(self, name):
        self.calls += name.startswith("encode")
        return getattr(self.tokenizer, name)


def _texts():
    letters = "aeinrstzäéøłšŽ"
    words = [letters[i % 14] + letters[i // 14 % 14] * (i % 3) + letters[i // 196 % 14] + "ing" * (i % 2) for i in range(2600)]
    return [" ".join(words[k : k + 100]) + f", {k} 'll\n\n" for k in range(0, len(words), 100)]


def test_new_words_take_one_call_and_keep_their_ids():
    encoder = tokens.Encoder(public_tokenizers.path(tokens.VOCABULARY))
    whole = [np.array(encoder.tokenizer.encode(t, add_special_tokens=False).ids, dtype=encoder.kind).tobytes() for t in _texts()]
    encoder.tokenizer = Counting(encoder.tokenizer)
    assert encoder.encode(_texts()) == whole
    assert sum(len(p) > 1 for p in encoder.known) > 2 * tokens.TOGETHER
    assert encoder.tokenizer.calls == 2  # the words, and the rest
    assert encoder.encode(_texts()) == whole and encoder.tokenizer.calls == 2


def test_other_widths_and_clean_ups_keep_the_ids(monkeypatch):
    encoder = tokens.Encoder(public_tokenizers.path(tokens.VOCABULARY))
    whole = encoder.encode(_texts())
    monkeypatch.setattr(tokens, "CACHE", 300)
    monkeypatch.setattr(tokens, "KEPT", 100)
    again = tokens.Encoder(public_tokenizers.path(tokens.VOCABULARY))
    again.width += 1  # as if characters of tokens were no bytes
    assert [again.encode([t])[0] for t in _texts()] == whole
