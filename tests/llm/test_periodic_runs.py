"""Recompression runs against brute force by comparing words a period apart."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from panelscore.llm import periodic_runs as pr


def brute(seq, least=24, times=3):
    n, found = len(seq), {}
    for q in range(1, n // times + 1):
        k = 0
        while k < n - q:
            start = k
            while k < n - q and seq[k] == seq[k + q]:
                k += 1
            if k > start and k - start + q >= max(least, times * q):
                found.setdefault((start, k - start + q), q)
            k += k == start
    return sorted((s, length, q) for (s, length), q in found.items())


def kept(seq, runs):
    dropped = {i for s, length, q in runs for i in range(s + q, s + length)}
    return [w for i, w in enumerate(seq) if i not in dropped]


def random_texts(n, seed):
    rng = random.Random(seed)
    for _ in range(n):
        letters = rng.choice([1, 2, 3, 10])
        text = [rng.randrange(letters) for _ in range(rng.randint(0, 200))]
        if rng.random() < 0.7 and len(text) > 5:
            a = rng.randrange(len(text))
            p = rng.randint(1, max(1, (len(text) - a) // 3))
            text = text[:a] + [text[a + x % p] for x in range(len(text) - a)]
            if rng.random() < 0.5:
                text = text + text[::-1] + text
        yield text


def fibonacci(n):
    a, b = [0], [0, 1]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


SHAPES = [fibonacci(700), [0] * 1000, ([0] * 30 + [1]) * 20, list(range(500)) * 4, [0, 1] * 12, [0, 1] * 11 + [0], list(range(8)) * 3, list(range(9)) * 3, list(range(9)) * 2 + list(range(8)), [], [1]]


@pytest.mark.parametrize("least,times", [(24, 3), (6, 2), (2, 2), (10, 5)])
def test_runs_equal_brute_force(least, times):
    texts = list(random_texts(400, least)) + SHAPES
    for text, runs in zip(texts, pr.runs_of(texts, least, times)):
        assert [tuple(r) for r in runs.tolist()] == brute(text, least, times), text
        assert pr.collapsed(text, runs) == kept(text, brute(text, least, times))


def test_small_query_blocks_change_nothing(monkeypatch):
    texts = list(random_texts(60, 4)) + SHAPES
    whole = [r.tolist() for r in pr.runs_of(texts)]
    monkeypatch.setattr(pr, "BATCH_QUERIES", 50)
    assert [r.tolist() for r in pr.runs_of(texts)] == whole


def test_extensions_equal_comparison():
    rng = np.random.default_rng(3)
    for letters in (1, 2, 4):
        seq = np.append(rng.integers(0, letters, 300), letters)
        levels = pr.recompress(seq)
        i = rng.integers(0, 300, 500)
        j = rng.integers(0, 301, 500)
        i, j = np.minimum(i, j), np.maximum(i, j)
        i, j = i[i < j], j[i < j]
        got = pr.extensions(levels, i, j)
        for a, b, n in zip(i.tolist(), j.tolist(), got.tolist()):
            exp = 0
            while b + exp < len(seq) and seq[a + exp] == seq[b + exp]:
                exp += 1
            assert n == exp


def test_strongest_is_exact():
    runs = np.array([[5, 30, 10], [0, 27, 9], [50, 24, 8], [90, 24, 8]])
    assert pr.strongest(runs) == [0, 27, 9]
    # ratios that agree to many digits
    assert pr.strongest(np.array([[0, 3 * 10**7, 10**7], [1, 3 * 10**7 + 1, 10**7]])) == [1, 3 * 10**7 + 1, 10**7]


def test_query_rows(docs, sample):
    rows = [(r["doc_id"], r["text"]) for r in sample]
    rows += [(10**6, None), (10**6 + 1, " \t\n"), (None, "a b " * 40), (7, "x y " * 30), (7, "x y " * 30), (10**6 + 2, "w " * 30_000), (-4, "one two three " * 9)]
    got = pr.run_digests(docs(rows).withColumnRenamed("n_chars", "n_runs")).collect()
    exp = []
    for i, text in rows:
        seq = (text or "").encode().split()
        h = zlib.crc32(str(i).encode()) if i is not None else 1
        if h % 10 == 0 and seq:
            a = (h // 10) % len(seq)
            p = 1 + (len(seq) - a) // (3 + (h // 10) % 8)
            seq = [w if k < a else seq[a + (k - a) % p] for k, w in enumerate(seq)]
        runs = brute(seq) if len(seq) < 20_000 else [tuple(r) for r in pr.runs_of([seq])[0].tolist()]
        best = None
        for s, length, q in sorted(runs):
            if best is None or length * best[2] > best[1] * q:
                best = (s, length, q)
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        exp.append((i, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
                    hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(b" ".join(kept(seq, runs))).hexdigest()))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, exp))


def test_general_interface(docs):
    got = {r["doc_id"]: r for r in pr.periodic_runs(docs([(1, "go " + "a b c " * 10 + "end"), (2, None)])).collect()}
    assert [tuple(r) for r in got[1]["runs"]] == [(1, 30, 3)] and got[1]["text"] == "go a b c end"
    assert got[2]["runs"] == [] and got[2]["text"] == ""


def test_empty_table_and_bad_parameters(docs):
    assert pr.run_digests(docs([])).count() == 0
    assert pr.periodic_runs(docs([])).count() == 0
    with pytest.raises(ValueError):
        pr.runs_of([[1, 1, 1]], 1, 3)
