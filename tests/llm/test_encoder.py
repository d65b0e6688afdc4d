"""The byte-pair encoder of the packing: whole texts, nothing kept between them."""

import public_tokenizers

from keysieve.llm import packing


def test_a_text_is_one_call_however_many_words_it_has():
    encoder = packing._Encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN,
                               packing.added_tokens(public_tokenizers.path("byte_bpe_50k.json")))
    calls, plain = [], encoder.plain

    class Counted:
        def encode_ordinary(self, text):
            calls.append(text)
            return plain.encode_ordinary(text)

    encoder.plain = Counted()
    words = [f"w{i:x}é" for i in range(2000)]
    assert len(encoder.encode(" ".join(words))) > 4 * 2000 and len(calls) == 1
    added = next(iter(encoder.added))
    assert encoder.encode(f"a b{added}c") == encoder.encode("a b") + encoder.added[added] + encoder.encode("c")
