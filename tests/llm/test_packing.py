"""Packing against a plain check of its pieces, and against best fit on the list of lengths."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from lorestone.llm import packing

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, doc_length long, piece string"


def test_pieces_cover_every_document_once(spark):
    rng = random.Random(9)
    words = ["alpha", "beta", " gamma", "\n", "δέλτα", "<|endoftext|>", "12", "!!"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 9, 40, 130]))) for _ in range(120)]
    texts += [None, "", "a <|endoftext|> b", "x" * (packing.LONG_RUN + 5), texts[3], texts[3]]
    df = spark.createDataFrame([(i % 124, t, 1, "own") for i, t in enumerate(texts)], DOCS)
    library = Tokenizer.from_file(VOCABULARY)
    most = 64
    want = Counter()
    for i, t in enumerate(texts):
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        first = len(ids) % most or min(most, len(ids))
        cuts = [0, *range(first, len(ids), most), len(ids)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            want[i % 124, k, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
    rows = packing.pack(df, VOCABULARY, most).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    places = defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
    for found in places.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at <= most
    # best fit over the single lengths, longest first
    room: list[int] = []
    for length in sorted((k[3] for k in want.elements()), reverse=True):
        fitting = [r for r in room if r >= length]
        if fitting:
            best = min(fitting)
            room.remove(best)
            room.append(best - length)
        else:
            room.append(most - length)
    assert len(places) == len(room)
    assert packing.pack(df.limit(0), VOCABULARY, most).count() == 0


def test_long_runs_give_the_same_ids():
    encode = packing.encoder(VOCABULARY)
    library = Tokenizer.from_file(VOCABULARY)
    for text in ("ab" * 4000, " " * 6000 + "x", "word " * 2000, "<|endoftext|>", "a<|endoftext|>", "<|endoftext|"):
        assert list(encode(text)) == library.encode(text, add_special_tokens=False).ids
