"""Exact, near, sentence-span and suffix-array dedup against brute force."""

import hashlib
import itertools
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from panelscore.llm import common, exact_dedup, ngram_join, substring_dedup, suffix_dedup

WHITE = re.compile(r"[\x20\x09-\x0D]+")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows(df):
    return [r.asDict() for r in df.collect()]


# ---------------------------------------------------------------- exact dedup


@pytest.mark.parametrize("text", ["", " ", "a", " a", "a ", "\t\na \x0b\x0c\r b\n", "  ", "ä  ö\xa0 x"])
def test_normalise(text):
    assert exact_dedup.normalise(text) == WHITE.sub(" ", text).encode()


def exact_brute(pairs):
    groups = defaultdict(list)
    for i, t in pairs:
        groups[WHITE.sub(" ", t or "")].append(i)
    out = []
    for t, ids in groups.items():
        for i in ids:
            out.append((i, min(ids), len(ids), i == min(ids), hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out)


COLUMNS = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def test_exact_dedup_matches_brute_force(docs, sample):
    pairs = [(r["doc_id"], r["text"]) for r in sample] + [(9001, None), (9002, ""), (9003, " "), (9004, "\t"), (9005, "x" * 200_000), (9000, "x" * 200_000)]
    got = rows(exact_dedup.dedup_rows(docs(pairs)))
    assert sorted(tuple(r[c] for c in COLUMNS) for r in got) == exact_brute(pairs)


def test_colliding_keys_chain_and_small_buckets(docs):
    pairs = [(i, f"text {i % 7}") for i in range(60)]
    got = rows(exact_dedup.dedup_rows(docs(pairs), key_fn=lambda data: len(data), bucket_keys=1, max_depth=3))
    assert sorted(tuple(r[c] for c in COLUMNS) for r in got) == exact_brute(pairs)
    assert {r["chain"] for r in got} == set(range(7))


def test_local_window_may_be_tiny(docs):
    pairs = [(i, f"text {i % 5}") for i in range(40)]
    got = rows(exact_dedup.dedup_rows(docs(pairs, parts=1), local_bytes=1))
    assert sorted(tuple(r[c] for c in COLUMNS) for r in got) == exact_brute(pairs)


def test_directory_doubles_until_buckets_fit():
    directory = exact_dedup.build_directory([(p, 10 if p < 8 else 1) for p in range(16)], 4, 20)
    assert [p for p, _ in sorted(directory)] == list(range(16))
    sizes = Counter()
    for p, b in directory:
        sizes[b] += 10 if p < 8 else 1
    assert max(sizes.values()) <= 20 and len(sizes) == 5


def test_exact_dedup_rows_null_ids_repeats_and_extra_columns(spark):
    schema = "doc_id long, text string, rid int, key string, chain int"
    data = [(None, "a", 1, "k", 1), (5, "a", 2, "k", 1), (5, "a", 3, "k", 1), (None, "b", 4, None, None), (7, None, 5, "", 0), (8, "", 6, "", 0)]
    df = spark.createDataFrame(data, schema)
    kept = exact_dedup.exact_dedup(df)
    assert kept.columns == df.columns
    assert sorted((r["doc_id"] is None, r["doc_id"], r["text"]) for r in rows(kept)) == [(False, 5, "a"), (False, 7, None), (True, None, "b")]
    assert exact_dedup.dedup_rows(df.limit(0)).count() == 0


# ---------------------------------------------------------------- n-gram join


def shingle_set(text, k):
    w = WORD.findall((text or "").translate({i: i + 32 for i in range(65, 91)}))
    return frozenset([tuple(w)] if 0 < len(w) < k else [tuple(w[i : i + k]) for i in range(len(w) - k + 1)])


def components_brute(pairs, k, pct):
    sets = [(i, shingle_set(t, k)) for i, t in pairs]
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(sets)), 2):
        x, y = sets[a][1], sets[b][1]
        o = len(x & y)
        if o and 100 * o >= pct * (len(x) + len(y) - o):
            parent[find(a)] = find(b)
    least = {}
    for a, (i, _) in enumerate(sets):
        least[find(a)] = min(least.get(find(a), i), i)
    return sorted((i, len(s), least[find(a)]) for a, (i, s) in enumerate(sets))


def edited(words, n, rng):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"e{rng.randrange(10**6)}"
    return " ".join(out)


@pytest.fixture(scope="module")
def near_pairs():
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(400)]
    pairs, at = [], 0
    for size in (3, 5, 8, 20, 60, 150, 400):
        for _ in range(4):
            base = [rng.choice(vocab) for _ in range(size)]
            pairs.append((at, " ".join(base)))
            at += 1
            for edits in (0, 1, 1, 2, 3, max(1, size // 40)):
                pairs.append((at, edited(base, edits, rng)))
                at += 1
    return pairs + [(at, None), (at + 1, ""), (at + 2, " \n"), (at + 3, "one"), (at + 4, "ONE"), (at + 5, "one two")]


@pytest.mark.parametrize("k, pct, tile_rows", [(4, 85, 1000), (5, 80, 1000), (4, 85, 3)])
def test_join_matches_brute_force(docs, near_pairs, k, pct, tile_rows):
    got = rows(ngram_join.jaccard_components(docs(near_pairs), k=k, pct=pct, tile_rows=tile_rows))
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == components_brute(near_pairs, k, pct)


def test_join_on_documents(docs, sample):
    pairs = [(r["doc_id"], r["text"]) for r in sample]
    got = rows(ngram_join.jaccard_components(docs(pairs)))
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == components_brute(pairs, 4, 85)


@pytest.mark.parametrize("tile_rows", [1000, 3])
def test_every_link_is_returned_and_counted(docs, near_pairs, tile_rows):
    pairs = near_pairs + [(10_000 + i, near_pairs[i][1]) for i in (1, 2, 100)]
    sets = [(i, shingle_set(t, 4)) for i, t in pairs]
    least, links, count = {}, set(), Counter()
    for i, x in sets:
        least.setdefault(x, i)
    for (i, x), (j, y) in itertools.combinations(sets, 2):
        o = len(x & y)
        if o and 100 * o >= 85 * (len(x) + len(y) - o):
            count.update((i, j))
            if x != y:
                links.add((*sorted((least[x], least[y])), o))
    got = rows(ngram_join.class_links(docs(pairs), tile_rows=tile_rows))
    assert sorted((*sorted((r["doc_a"], r["doc_b"])), r["overlap"]) for r in got) == sorted(links)
    per = rows(ngram_join.jaccard_components(docs(pairs), tile_rows=tile_rows))
    assert {r["doc_id"]: r["n_links"] for r in per} == {i: count[i] for i, _ in pairs}
    ids = {r["doc_id"]: r["class_id"] for r in per}
    assert all((ids[i] == ids[j]) == (x == y) for (i, x), (j, y) in itertools.combinations(sets, 2))
    # the groups are not trees: a spanning forest has fewer links
    assert len(links) > len({least[x] for _, x in sets}) - len({r["component_id"] for r in per})


@pytest.mark.parametrize("pct", [80, 85])
def test_linked_sets_share_a_name(pct):
    rng = np.random.default_rng(1)
    for n in [*range(1, 40), 100, 127, 128, 129, 300, 1000]:
        x = np.sort(rng.choice(10**9, n, replace=False)).astype(np.int64)
        for drop in range(0, n):
            y = np.concatenate([x[drop:], rng.choice(10**9, rng.integers(0, drop + 1)) + 10**9]).astype(np.int64)
            o = n - drop
            if 100 * o < pct * (n + len(y) - o):
                break
            assert len(np.intersect1d(ngram_join.names(x, pct), ngram_join.names(np.sort(y), pct)))


def test_near_dedup_keeps_columns_empty_sets_and_null_ids(spark):
    schema = "doc_id long, text string, cls int, comp string, n int"
    long = " ".join(f"w{i}" for i in range(50))
    data = [(3, long, 1, "a", 0), (2, long + " x", 1, "a", 0), (None, long, 1, "a", 0), (4, None, 1, "a", 0), (5, "", 1, "a", 0)]
    out = ngram_join.near_dedup(spark.createDataFrame(data, schema), k=5, pct=80)
    assert out.columns == ["doc_id", "text", "cls", "comp", "n"]
    # a row without an id cannot be named as a copy: it stays
    assert sorted(str(r["doc_id"]) for r in rows(out)) == ["2", "4", "5", "None"]
    assert ngram_join.near_dedup(spark.createDataFrame([], schema)).count() == 0


def test_near_dedup_keeps_one_row_of_each_group_whatever_the_ids(docs):
    rng = random.Random(5)
    a, b, c, d = (" ".join(f"w{rng.randrange(10**6)}" for _ in range(60)) for _ in range(4))
    # 7 names a copy of 1 and a text that stands alone; 2 names both texts of its group; c has no ids; d is repeated
    pairs = [(1, a), (7, a + " x"), (7, "alone " + a[::-1]), (2, b), (2, b + " y"), (None, c), (None, c + " z"), (None, c), (9, d), (9, d), (None, d), (3, ""), (3, "")]
    out = [(r["doc_id"], r["text"]) for r in rows(ngram_join.near_dedup(docs(pairs), unnamed=True, k=5, pct=80))]
    assert sorted(t for i, t in out if i in (1, 7)) == sorted([a, "alone " + a[::-1]])
    assert len([t for i, t in out if i == 2]) == 1 and len([t for i, t in out if i is None]) == 1
    assert out.count((9, d)) == 1 and out.count((3, "")) == 2 and len(out) == 7


def test_connected_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, i) for i in range(101, 300)] + [(400, 401), (401, 400), (500, 500)]
    rng.shuffle(edges)
    got = {r["node"]: r["label"] for r in rows(common.connected_components(spark.createDataFrame(edges, "a long, b long")))}
    assert len({got[i] for i in range(1, 61)}) == 1 and len({got[i] for i in range(100, 300)}) == 1
    assert got[400] == got[401] and len({got[1], got[100], got[400]}) == 3 and 500 not in got


# ---------------------------------------------------------------- sentence spans


def spans_brute(pairs, k, least):
    seen, out = set(), []
    for i, t in sorted(pairs):
        parts = substring_dedup.sentences(t or "")
        assert "".join(parts) == (t or "")
        words = [p.encode().split() for p in parts]
        gone = set()
        for a in range(len(parts)):
            for b in range(a + k - 1, len(parts)):
                if sum(map(len, words[a : b + 1])) >= least:
                    key = tuple(map(tuple, words[a : b + 1]))
                    if words[a]:
                        gone |= set(range(a, b + 1)) if key in seen else set()
                        seen.add(key)
                    break
        out.append((i, len(parts), len(gone), "".join(p for j, p in enumerate(parts) if j not in gone)))
    return out


def test_spans_match_brute_force(docs, sample):
    passage = " ".join(f"Passage word{i} and more of it{i}." for i in range(12))
    pairs = [(r["doc_id"], r["text"]) for r in sample] + [(9001, None), (9002, ""), (9003, f"Own start. {passage} Own end."), (9004, f"Other. {passage}\nTail here.")]
    pairs += [(9005, f"{passage} {passage}")]
    got = rows(substring_dedup.remove_repeats(docs(pairs), 2, 20))
    assert sorted((r["doc_id"], r["n_sentences"], r["n_removed"], r["text"]) for r in got) == spans_brute(pairs, 2, 20)
    by = {r["doc_id"]: r for r in got}
    assert by[9003]["n_removed"] == 0 and "word5" not in by[9004]["text"] and by[9004]["text"].startswith("Other.")


def test_spans_null_id_comes_last_and_repeated_rows_stay(docs):
    passage = " ".join(f"Passage word{i} and more of it{i}." for i in range(12))
    got = rows(substring_dedup.remove_repeats(docs([(None, passage), (5, passage), (5, passage)])))
    assert sorted((str(r["doc_id"]), r["n_removed"]) for r in got) == [("5", 0), ("5", 0), ("None", 12)]
    assert substring_dedup.remove_repeats(docs([])).count() == 0


def runs_brute(pairs, k, least):
    """Sentences kept when every sentence of any repeated run (k sentences and ``least`` words or more, any length) goes."""
    seen, out = set(), {}
    for i, t in sorted(pairs):
        words = [tuple(p.split()) for p in substring_dedup.sentences(t)]
        gone = set()
        for a, b in itertools.combinations(range(len(words) + 1), 2):
            run = tuple(words[a:b])
            if (b - a >= k and sum(map(len, run)) >= least) or (b - a == len(words) and run):
                gone |= set(range(a, b)) if run in seen else set()
                seen.add(run)
        out[i] = [j for j in range(len(words)) if j not in gone]
    return out


def test_tails_of_repeated_runs_and_copies_of_short_texts_go(docs):
    rng = random.Random(7)
    sentence = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n)) + "."
    shared = [[sentence(n) for n in lengths] for lengths in ((25, 30, 3, 10), (3, 4, 30), (9, 9, 9, 1, 1), (2, 30), (21, 1))]
    pairs = [(i, " ".join(p)) for i, p in enumerate(shared)]
    pairs += [(10 + i, " ".join([sentence(25), *p, sentence(25)])) for i, p in enumerate(shared)]
    pairs += [(20 + i, " ".join(p)) for i, p in enumerate(shared)]
    pairs += [(30, "Short text. Two."), (31, "Short text. Two."), (32, "one"), (33, "one"), (34, "Two.")]
    got = {r["doc_id"]: r for r in rows(substring_dedup.remove_repeats(docs(pairs), 2, 20, whole=True))}
    texts = dict(pairs)
    for i, kept in runs_brute(pairs, 2, 20).items():
        parts = substring_dedup.sentences(texts[i])
        assert got[i]["text"] == "".join(parts[j] for j in kept), i
    assert [got[i]["text"] for i in (20, 31, 33, 34)] == ["", "", "", "Two."]


def test_sentences_of_other_scripts_and_lengths():
    for text in ("He said \"go.\" Then (he left.) Now!", "一二三。四五六！「七八。」九", "no end", "", "a\n\nb", "x y " * 500, "漢" * 500, "स्वागत है। फिर मिलेंगे।"):
        assert "".join(substring_dedup.sentences(text)) == text
    assert substring_dedup.sentences('He said "go." Then (he left.) Now!') == ['He said "go." ', "Then (he left.) ", "Now!"]
    assert substring_dedup.sentences("一二三。四五六！「七八。」九") == ["一二三。", "四五六！", "「七八。」", "九"]
    # equal long sentences have equal pieces but for the first and last ones
    rng = random.Random(1)
    long = " ".join(f"w{rng.randrange(999)}" for _ in range(300))
    inner = {p.strip() for p in substring_dedup.sentences(long)}
    moved = {p.strip() for p in substring_dedup.sentences("some other words first " * 3 + long)}
    assert len(inner) > 20 and len(inner - moved) <= 4
    assert max(len(p.split()) for p in inner) <= substring_dedup.LONG_WORDS


def test_spans_of_long_chinese_and_quoted_sentences(docs):
    """One sentence of 80 words, 60 Chinese sentences, sentences ended by quotes: shared passages go from the later text."""
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    eighty = " ".join(word() for _ in range(80))
    chinese = "".join("".join(chr(0x4E00 + rng.randrange(2000)) for _ in range(9)) + "。" for _ in range(60))
    quoted = " ".join(f'"{" ".join(word() for _ in range(9))}."' for _ in range(8))
    for passage in (eighty, chinese, quoted):
        own = [" ".join(word() for _ in range(15)) + "." for _ in range(4)]
        texts = {1: f"{own[0]} {own[1]}\n{passage}\n", 2: f"{own[2]}\n{passage}\n{own[3]}"}
        got = {r["doc_id"]: r for r in rows(substring_dedup.remove_repeats(docs(list(texts.items())), whole=True))}
        assert got[1]["text"] == texts[1] and got[1]["n_removed"] == 0
        assert got[2]["text"].split() == f"{own[2]} {own[3]}".split()


def test_spans_of_very_long_texts(docs):
    rng = random.Random(3)
    long = " ".join(f"w{rng.randrange(10**6)}" for _ in range(300_000))
    got = {r["doc_id"]: r for r in rows(substring_dedup.remove_repeats(docs([(1, long), (2, long), (3, "a b. " * 100_000)]).withColumnRenamed("n_chars", "n_removed"), whole=True))}
    assert got[1]["text"] == long and got[2]["text"] == "" and got[3]["text"] != ""


# ---------------------------------------------------------------- suffix arrays


def bytes_brute(pairs, length):
    raw = [(i, (t or "").encode()) for i, t in pairs]
    count = Counter(b[j : j + length] for _, b in raw for j in range(len(b) - length + 1))
    out = []
    for i, b in raw:
        gone = np.zeros(len(b) + 1, bool)
        for j in range(len(b) - length + 1):
            if count[b[j : j + length]] > 1:
                gone[j : j + length] = True
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def suffix_rows(df):
    return sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows(df))


def text_pairs(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 7)))
    passages = [" ".join(word() for _ in range(rng.randrange(10, 40))) for _ in range(6)]
    pairs = []
    for i in range(60):
        parts = [" ".join(word() for _ in range(rng.randrange(0, 30)))]
        for _ in range(rng.randrange(0, 3)):
            parts += [rng.choice(passages)[: rng.randrange(20, 300)], " ".join(word() for _ in range(rng.randrange(0, 12)))]
        pairs.append((i, " ".join(parts)))
    return pairs + [(100, None), (101, ""), (102, "ab" * 300), (103, "x" * 500), (104, "abc " * 30), (105, pairs[3][1]), (106, pairs[3][1])]


@pytest.mark.parametrize("seed, shard_bytes, anchor_segments", [(1, 1 << 19, 4000), (2, 200, 4000), (3, 1 << 19, 1), (4, 300, 2)])
def test_suffix_dedup_matches_brute_force(docs, seed, shard_bytes, anchor_segments):
    pairs = text_pairs(seed)
    df = suffix_dedup.remove_repeated_bytes(docs(pairs), length=40, gram=8, shard_bytes=shard_bytes, anchor_segments=anchor_segments)
    assert suffix_rows(df) == bytes_brute(pairs, 40)


def test_suffix_dedup_on_documents(docs, sample):
    pairs = [(r["doc_id"], r["text"]) for r in sample]
    assert suffix_rows(suffix_dedup.remove_repeated_bytes(docs(pairs))) == bytes_brute(pairs, 400)


def test_suffix_dedup_planted_passages(docs):
    rng = random.Random(11)
    words = lambda n, size: " ".join("".join(rng.choices("abcdefgh", k=size)) for _ in range(n))
    long_, short = words(60, 7), words(51, 5)  # over 50 words each: 479 bytes, and 305
    pairs = [(i, " ".join([words(30 + 9 * i, 6), *([long_] if i < 10 else [short] if i < 20 else []), words(20, 6)])) for i in range(40)]
    got = suffix_rows(suffix_dedup.remove_repeated_bytes(docs(pairs)))
    assert got == bytes_brute(pairs, 400)
    # n_bytes is the input's length; what went stands in n_removed
    assert [(i, n) for i, n, *_ in got] == [(i, len(t)) for i, t in pairs]
    assert [i for i, _, removed, *_ in got if removed >= 479] == [*range(10)]
    assert [i for i, _, removed, *_ in got if removed == 0] == [*range(10, 40)]


def test_suffix_dedup_when_scratch_files_are_split(docs, spark):
    """Tiny row groups and splits: a shard's segments are still sorted together."""
    from panelscore.session import conf_override

    pairs = text_pairs(5)
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    conf.set("parquet.block.size", "2048")
    try:
        with conf_override(spark, {"spark.sql.files.maxPartitionBytes": "4096", "spark.sql.files.openCostInBytes": "0"}):
            for shard_bytes, segments in ((1 << 19, 4000), (300, 2)):
                df = suffix_dedup.remove_repeated_bytes(docs(pairs), length=40, gram=8, shard_bytes=shard_bytes, anchor_segments=segments)
                assert suffix_rows(df) == bytes_brute(pairs, 40)
    finally:
        conf.unset("parquet.block.size")


def test_suffix_dedup_cuts_long_segments(docs, monkeypatch):
    """Periodic texts keep one anchor; pieces and shards by bytes change nothing."""
    monkeypatch.setattr(suffix_dedup, "SEGMENT_STARTS", 50)
    rng = random.Random(6)
    block = "".join(rng.choice("abcdefgh") for _ in range(97))
    pairs = text_pairs(6) + [(200, block * 9), (201, "x" + block * 3 + "y"), (202, "ab" * 400), (203, "z" * 333), (204, block[:60] + "q" * 50 + block[60:])]
    for anchor_bytes in (1 << 22, 500):
        df = suffix_dedup.remove_repeated_bytes(docs(pairs), length=40, gram=8, anchor_bytes=anchor_bytes)
        assert suffix_rows(df) == bytes_brute(pairs, 40)


def test_suffix_dedup_very_long_periodic_text(docs):
    rng = random.Random(7)
    block = "".join(rng.choice("abcdefghijklmnop ") for _ in range(10_007))
    texts = [(1, block * 480), (2, "go " + block[:5000]), (3, "n" * 399)]
    got = {r["doc_id"]: r for r in rows(suffix_dedup.remove_repeated_bytes(docs(texts).withColumnRenamed("n_chars", "n_removed")))}
    assert (got[1]["n_bytes"], got[1]["n_removed"], got[1]["n_spans"]) == (4_803_360, 4_803_360, 1)
    assert got[2]["n_removed"] == 5000 and got[3]["n_removed"] == 0


def test_suffix_dedup_repeated_rows_and_null_ids(docs):
    t = "".join(chr(97 + i * i % 26) for i in range(90))
    got = rows(suffix_dedup.remove_repeated_bytes(docs([(1, t), (1, t), (None, t), (None, "short")]), length=40, gram=8))
    assert sorted(r["n_removed"] for r in got) == [0, 90, 90, 90]
    assert suffix_dedup.remove_repeated_bytes(docs([])).count() == 0


@pytest.mark.parametrize("text", ["banana", "aaaaaaaaaaaaaaaaaaaaaaaa", "abcabcabcabcabcabc", "x", "mississippi" * 9])
def test_suffix_array_and_kasai(text):
    data = np.frombuffer(text.encode(), np.uint8)
    sa = suffix_dedup.suffix_array(data)
    expected = sorted(range(len(text)), key=lambda i: text[i:])
    assert sa.tolist() == expected
    lcp = suffix_dedup.kasai(data, sa, np.array([0]), np.array([len(text)]), 1000)
    for a, b in zip(expected, expected[1:]):
        n = 0
        while text[a + n : a + n + 1] and text[a + n : a + n + 1] == text[b + n : b + n + 1]:
            n += 1
        assert lcp[b] == n


def test_found_by_search_handles_equal_first_keys():
    ordered = np.array([[1, 1], [1, 2], [1, 3], [2, 1], [5, 9]])
    keys = np.array([[1, 2], [1, 4], [2, 1], [3, 3], [5, 9], [9, 9]])
    assert suffix_dedup.found_by_search(keys, ordered).tolist() == [True, False, True, False, True, False]


def test_owner_tasks_follow_the_bytes(docs):
    """Small owner ranges give the same groups, in more tasks."""
    df = docs([(i, f"text number {i % 150} " * 20) for i in range(300)])
    key = lambda r: (r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"])
    few, many = exact_dedup.dedup_rows(df), exact_dedup.dedup_rows(df, owner_bytes=2_000)
    assert sorted(map(key, rows(few))) == sorted(map(key, rows(many)))
    _, index = exact_dedup.build_index(df, owner_bytes=2_000)
    assert index.select("rep").distinct().count() >= 150
