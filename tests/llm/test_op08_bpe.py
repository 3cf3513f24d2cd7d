import hashlib
import random

import numpy as np
import pyarrow.parquet as pq
from tokenizers import Tokenizer

from wayline.llm.op08_bpe import codec, decoded, default_path, encoded, round_trip


def texts():
    r = random.Random(8)
    alphabet = "abcdeéèßñçıİΣσςĲﬁ漢字かな😀 \t\n\x0b\x1c\x1f\x85  ​́!!??''..--0123½²Ⅷ<|>_؀ىด์"
    out = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 60))) for _ in range(800)]
    out += ["It's WE'LL they'd I'M 'S x'ty", "<|startoftext|>Hi<|endoftext|> there<|endoftext|", "a" * 5000, "the" * 3000 + " é" * 10, "", " ", "ΑΣ ΟΔΥΣΣΕΥΣ", "éÉ", "!" * 100, "x\u0000y�"]
    return out + pq.read_table("/root/testdata/sf0.001/documents.parquet")["text"].to_pylist()[:120]


def expected(t, library):
    ids = library.encode(t, add_special_tokens=False).ids
    return ids, library.decode(ids, skip_special_tokens=False)


def test_equals_the_library(docs_of):
    library = Tokenizer.from_file(default_path())
    library.no_truncation()
    library.no_padding()
    all_texts = texts()
    got = {r.doc_id: r for r in round_trip(docs_of([*all_texts, None]), default_path()).collect()}
    for i, t in enumerate([*all_texts, None]):
        ids, text = expected(t or "", library)
        assert codec(default_path()).encode(t or "") == np.array(ids, "<u4").tobytes(), t
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()), t


def test_cuts_never_fall_inside_a_token():
    c = codec(default_path())
    letters = [c.tokens[i] for i in c.inner]
    byte_of = {x: b for b, x in enumerate(letters)}
    for token in c.made[::50]:
        raw = bytes(byte_of[x] for x in c.tokens[token].removesuffix(c.end))
        assert c.cuts(raw) == [0, len(raw)]
    assert 65536 - len(c.joined) > 10_000


def test_tables(docs_of):
    df = docs_of(["Hello, WORLD", None, "Hello, WORLD"], ids=[1, 2, 1]).selectExpr("*", "5 as n_tokens", "'x' as token_ids")
    ids = encoded(df, default_path())
    assert "text" not in ids.columns and [r.text for r in decoded(ids, default_path()).orderBy("doc_id").collect()] == ["hello</w> ,</w> world</w>"] * 2 + [""]
    assert round_trip(df.where("false"), default_path()).count() == 0
