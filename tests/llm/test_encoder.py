"""op5: words of plain letters are encoded in one step; the ids are the tokenizer's."""

import pyarrow as pa

from quillspark.llm import token_files as T
from quillspark.llm.queries import tokenizer_path

TEXTS = ["Plain words here", " lead", "été zürich 北京 x", "a <|endoftext|> b", "", None, "it's 12 o'clock  twice", "word word Word"]


def ids(encoder):
    found, counts = encoder.column(pa.array(TEXTS))
    return [x.tolist() for x in T.np.split(found, T.np.cumsum(counts)[:-1])]


def test_plain_words_take_one_step(monkeypatch):
    encoder = T.Encoder(tokenizer_path())
    want = [encoder.tokenizer.encode(t or "", add_special_tokens=False).ids for t in TEXTS]
    steps = []
    monkeypatch.setattr(T.Encoder, "piece", lambda self, p, own=T.Encoder.piece: (steps.append(p), own(self, p))[1])
    assert ids(encoder) == want
    assert encoder.apart and " words" not in steps and " here" not in steps


def test_a_special_word_of_letters_is_looked_for():
    encoder = T.Encoder(tokenizer_path())
    encoder.tokenizer.add_special_tokens(["word"])
    encoder.special.append("word")
    encoder.apart = False
    assert ids(encoder) == [encoder.tokenizer.encode(t or "", add_special_tokens=False).ids for t in TEXTS]
