"""Prefix-table encoding against the sentencepiece library."""

import hashlib
import random

import pytest

from panelscore.llm import sentencepiece_bpe as sp


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=sp.default_model())


@pytest.fixture(scope="module")
def pieces():
    with open(sp.default_model(), "rb") as f:
        return sp.Pieces(f.read())


EDGES = ["", " ", "  ", "▁", "▁ ▁a", "a" * 3000, " " * 100, "ab" * 500 + " " * 37 + "x", "漢字" * 50, "\n\n\n", "<s></s><0x0A>", "a\x00b", "é😀ἡ", " lead", "trail ", "1234 5,6", "ﬁ Å Å"]


def texts_of(pieces, n, seed):
    rng = random.Random(seed)
    letters = "abcdeinothers     \n\t,.▁1234é漢字ἡ😀<s>ßZ"
    for _ in range(n):
        yield "".join(rng.choice(letters) for _ in range(rng.randint(0, 60)))
        # pieces side by side, however unlikely, put the compatibility test on trial
        yield "".join(rng.choice(pieces.text).replace("▁", " ") for _ in range(rng.randint(1, 30)))


def test_ids_and_text_equal_the_library(pieces, library):
    for text in EDGES + list(texts_of(pieces, 1500, 5)):
        ids = [i for s in pieces.split(text) for i in pieces.encode_stretch(s)] + [pieces.end]
        assert ids == library.encode(text, add_eos=True), text
        assert pieces.decode(ids) == library.decode(ids), text


def test_whole_text_without_cuts_gives_the_same_ids(pieces, library):
    for text in filter(None, texts_of(pieces, 300, 6)):
        marked = "▁" + text.replace(" ", "▁")
        assert pieces.encode_stretch(marked) == library.encode(text), text


def test_compatible_means_merging_leaves_both(pieces):
    rng = random.Random(7)
    def merged(text):
        symbols = list(text)
        while True:
            scores = [(pieces.score.get(a + b), -k) for k, (a, b) in enumerate(zip(symbols, symbols[1:]))]
            scores = [s for s in scores if s[0] is not None]
            if not scores:
                return symbols
            k = -max(scores)[1]
            symbols[k : k + 2] = [symbols[k] + symbols[k + 1]]
    for _ in range(4000):
        a, b = rng.randrange(len(pieces.text)), rng.randrange(len(pieces.text))
        assert pieces.compatible(a, b) == (merged(pieces.text[a] + pieces.text[b]) == [pieces.text[a], pieces.text[b]])


def test_decoding_arbitrary_ids(pieces, library):
    rng = random.Random(8)
    for _ in range(5000):
        ids = [rng.choice([rng.randrange(3, 259), rng.randrange(259, 32000), 0, 1, 2]) for _ in range(rng.randint(0, 8))]
        assert pieces.decode(ids) == library.decode(ids), ids


def test_query_rows(docs, sample, library, spark):
    rows = [(r["doc_id"], r["text"]) for r in sample] + [(10**6 + k, t) for k, t in enumerate(EDGES)] + [(None, "x y"), (5, None), (5, None)]
    got = sorted(sp.encode_digests(docs(rows).withColumnRenamed("n_chars", "n_tokens")).collect(), key=str)
    exp = []
    for i, text in rows:
        ids = library.encode(text or "", add_eos=True)
        exp.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, exp))


def test_general_interface_round_trip(docs, spark):
    d = docs([(1, "Hello  world"), (2, None), (3, "漢▁x")])
    enc = sp.encode(d)
    assert {r["doc_id"]: r["decoded"] for r in enc.collect()} == {1: "Hello  world", 2: "", 3: "漢 x"}
    assert {r["doc_id"]: r["text"] for r in sp.decode(enc).collect()} == {1: "Hello  world", 2: "", 3: "漢 x"}
    odd = spark.createDataFrame([(1, [None, 10**6, -3, 2]), (2, None)], "doc_id long, ids array<int>")
    assert {r["doc_id"]: r["text"] for r in sp.decode(odd).collect()} == {1: "", 2: ""}


def test_empty_table(docs):
    assert sp.encode_digests(docs([])).count() == 0
    assert sp.encode(docs([])).count() == 0


def test_small_caches_change_nothing(monkeypatch, pieces, library):
    monkeypatch.setattr(sp, "TASK_STRETCHES", 3)
    monkeypatch.setattr(sp, "TASK_PAIRS", 3)
    with open(sp.default_model(), "rb") as f:
        texts = sp._Texts(f.read())
    for text in texts_of(pieces, 100, 9):
        assert texts(text)[1] == " ".join(map(str, library.encode(text, add_eos=True)))
