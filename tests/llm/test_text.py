import random
import re

import numpy as np
import pyarrow as pa
import pytest

from millrace.llm.textkit import PUNCTUATION, slices, word_hashes
from millrace.llm.word_bpe import WordBpe

LOWER = str.maketrans({chr(k): chr(k + 32) for k in range(65, 91)})


def test_equal_words_have_equal_hashes(odd_texts):
    texts = [t for t in odd_texts if t] + ["w" * 300 + " " + "w" * 300 + "v", "w" * 300]
    for separators, pattern in ((None, r"[^\x20\x09-\x0D]+"), (PUNCTUATION, r"[0-9A-Za-z\x80-\U0010FFFF]+")):
        own = [re.findall(pattern, t.translate(LOWER)) for t in texts]
        h, bounds = word_hashes(pa.array(texts), *([separators] if separators is not None else []))
        assert np.diff(bounds).tolist() == [len(w) for w in own]
        seen, back = {}, {}
        for w, x in zip((w for ws in own for w in ws), h.tolist(), strict=True):
            assert seen.setdefault(w, x) == x and back.setdefault(x, w) == w


def test_slices_keep_all_rows(odd_texts):
    batch = pa.RecordBatch.from_arrays([pa.array(odd_texts)], ["text"])
    parts = list(slices(batch, most=100_000))
    assert [x for p in parts for x in p.column(0).to_pylist()] == odd_texts and len(parts) > 2
    assert list(slices(batch.slice(0, 0))) == []
    few = list(slices(batch, rows=3))
    assert [x for p in few for x in p.column(0).to_pylist()] == odd_texts and max(map(len, few)) == 3


def test_word_ids_equal_the_tokenizers(odd_texts):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    bpe = WordBpe(public_tokenizers.path("word_bpe_49k.json"))
    rng = random.Random(1)
    pool = list("abcxyzABC019'.,-_!?()  \n\téÜİΣ中́ \xa0ẞﬁ\x1c\x85<|>")
    made = ["".join(rng.choices(pool, k=rng.randint(0, 60))) for _ in range(500)] + ["it's <|endoftext|> they'll 'S", "ΑΣ ΣΑΣ"]
    for t in [t for t in odd_texts if t is not None and len(t) < 60000] + made:
        assert np.frombuffer(bpe.encode(t), "<u4").tolist() == bpe.tokenizer.encode(t, add_special_tokens=False).ids
