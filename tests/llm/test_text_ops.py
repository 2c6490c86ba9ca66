"""BPE, language ID, quality rules and mixing against the library, brute force and held-out labels."""

import hashlib
import json
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelscore.llm import bpe, common, langid, mixing, quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows(df):
    return [r.asDict() for r in df.collect()]


# ---------------------------------------------------------------- BPE


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.default_model())


def library_row(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    decoded = library.decode(ids, skip_special_tokens=False)
    return len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


ODD = [None, "", " ", "\n\t", "Hello, world's BIG  day 12 a1b2", "<|endoftext|>x<|startoftext|> <|endofte", "İstanbul ΣΑΣ ﬁ ½ ² é", "日本語 😀👍🏽 \x00\x1f", "a" * 3000, "don’t ʼn"]


@pytest.mark.parametrize("table_words", [0, 5, 200_000])
def test_bpe_equals_the_library(docs, sample, library, table_words):
    pairs = [(r["doc_id"], r["text"]) for r in sample[:60]] + [(9000 + i, t) for i, t in enumerate(ODD)] + [(None, "no id"), (1, sample[0]["text"])]
    got = rows(bpe.encode_digests(docs(pairs), table_words=table_words))
    expected = sorted((str(i), *library_row(library, t)) for i, t in pairs)
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got) == expected


def test_bpe_random_unicode(library):
    with open(bpe.default_model(), encoding="utf-8") as f:
        words = bpe.Words(f.read())
    shown = words.pieces()
    rng = random.Random(1)
    ranges = [(32, 127), (0, 0x250), (0x250, 0x3000), (0x3000, 0xD7FF), (0xE000, 0x10FFFF)]
    for _ in range(1500):
        text = "".join(chr(rng.randrange(*rng.choice(ranges))) for _ in range(rng.randrange(1, 30)))
        ids = [i for w in words.encode(words.split(text)) for i in w]
        expected = library.encode(text, add_special_tokens=False).ids
        assert ids == expected
        assert " ".join(shown[i] for i in ids) == library.decode(expected, skip_special_tokens=False)


def test_word_table_is_bounded_and_holds_the_most_frequent(spark, docs):
    with open(bpe.default_model(), encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())
    table = {r["word"] for r in bpe.word_table(docs([(1, "a a a b b c c d"), (2, "a b")]), spec, 2).collect()}
    assert table == {"a", "b"}


def test_bpe_ids_column_and_empty_table(docs, library):
    got = rows(bpe.encode(docs([(1, "Hello world")])))
    assert got == [{"doc_id": 1, "ids": library.encode("Hello world", add_special_tokens=False).ids, "decoded": "hello</w> world</w>"}]
    assert bpe.encode_digests(docs([])).count() == 0


# ---------------------------------------------------------------- language ID


def test_held_out_accuracy(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    truth = {r["doc_id"]: r["lang"] for r in table.select("doc_id", "lang").collect()}
    got = [r for r in rows(langid.language_id(table)) if r["held_out"] and truth[r["doc_id"]]]
    assert len(got) > 150
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in got) / len(got) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_edge_cases_and_folds(docs):
    train = [(i, "the cat and the dog went to the house", "en") for i in range(8)] + [(20 + i, "der hund und die katze gehen nach hause", "de") for i in range(8)]
    edge = [(100, None, "en"), (101, "", "en"), (102, "123 !?", None), (103, "the house and the dog", None), (104, "die katze und der hund", "xx"), (None, "the cat", None)]
    got = {r["doc_id"]: r for r in rows(langid.language_id(docs(train + edge)))}
    assert [got[i]["lang_pred"] for i in (100, 101, 102)] == ["und"] * 3 and got[102]["score"] == 0
    assert got[103]["lang_pred"] == "en" and got[None]["lang_pred"] == "en"
    for i, r in got.items():
        assert r["held_out"] == (langid.fold(i) == 2)
    assert {r["lang_pred"] for r in rows(langid.language_id(docs([(1, "abc", None)])))} == {"und"}
    assert langid.language_id(docs([])).count() == 0


def test_labels_of_the_held_out_fold_are_not_used(docs):
    ids = [i for i in range(60) if langid.fold(i) == 2]
    data = [(i, "alpha beta gamma", "aa") for i in range(60) if langid.fold(i) != 2] + [(i, "omega psi chi", "zz") for i in ids]
    assert {r["lang_pred"] for r in rows(langid.language_id(docs(data)))} == {"aa"}


def test_mixture_is_inferred():
    rng = np.random.default_rng(0)
    p = rng.dirichlet(np.full(200, 0.05), 3)
    logp = np.log(p + 1e-9)
    cells = np.concatenate([rng.choice(200, 600, p=p[2]), rng.choice(200, 400, p=p[0])])
    lead, score, parts = langid.infer(logp, cells)
    assert lead == 2 and {i for i, _ in parts} == {0, 2}
    assert abs(dict(parts)[2] - 0.6) < 0.06 and abs(score - 0.6) < 0.06
    lead, score, parts = langid.infer(logp, rng.choice(200, 500, p=p[1]))
    assert lead == 1 and [i for i, _ in parts] == [1] and score > 0.99


# ---------------------------------------------------------------- quality rules


def quality_brute(text):
    text = text or ""
    w = WORD.findall(text)
    tri = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {j for i in range(len(w) - 2) if tri[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed


BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
CASES = ["a b c a b c", "a a a a a", "x\ny\nx\n\n \nx", "\x0b\x0c #$ <b> | & \t*%", "é ü\xa0x 日本 a", "a b " * 40, " ".join(f"w{i}" for i in range(60)), "w " * 30000, "no\r\nno\r\nno\n"]


def test_base_counts_match_brute_force(spark, docs, sample, sample_dir):
    labels = spark.read.parquet(f"{sample_dir}/labels.parquet")
    pairs = [(r["doc_id"], r["text"]) for r in sample] + [(9000 + i, t) for i, t in enumerate([None, "", " ", *CASES])]
    got = {r["doc_id"]: r for r in rows(quality.quality(docs(pairs), labels))}
    assert len(got) == len(pairs)
    for i, t in pairs:
        assert tuple(got[i][c] for c in BASE) == quality_brute(t), (i, t and t[:40])
        assert not (got[i]["base_failed"] and got[i]["kept"])


def ratio_brute(pairs, good, alpha):
    """Mean log ratio over unigrams and bigrams, without hashing collisions (enough buckets for a small corpus)."""

    def grams(t):
        w = WORD.findall(t or "")
        return [(x,) for x in w] + list(zip(w, w[1:]))

    raw, target = Counter(), Counter()
    for i, t in pairs:
        raw.update(grams(t))
        if i in good:
            target.update(grams(t))
    n, m = sum(raw.values()), sum(target.values())
    cells = 1 << 22
    ratio = {g: math.log((target[g] + alpha) / (m + alpha * cells)) - math.log((raw[g] + alpha) / (n + alpha * cells)) for g in raw}
    return {i: (sum(ratio[g] for g in grams(t)) / len(grams(t)) if grams(t) else None) for i, t in pairs}


def test_scores_match_brute_force(spark, docs):
    rng = random.Random(5)
    pairs = [(i, " ".join(rng.choice("good fine nice text word".split() if i % 3 else "spam buy now click here".split()) for _ in range(60))) for i in range(30)] + [(99, None)]
    labels = spark.createDataFrame([(i, 1 if i % 3 else 0, 0) for i in range(20)] + [(None, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in rows(quality.quality(docs(pairs), labels, buckets=1 << 22))}
    expected = ratio_brute(pairs, {i for i in range(20) if i % 3}, 1.0)
    for i, s in expected.items():
        assert got[i]["score"] is None if s is None else abs(got[i]["score"] - s) < 1e-5
    assert got[1]["score"] > got[0]["score"]


def test_labelled_documents_are_told_apart(spark):
    d = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    got = quality.quality(spark.read.parquet(f"{d}/documents.parquet"), labels).join(labels, "doc_id").where("not base_failed")
    wrong = got.where("kept <> (quality = 1)").count()
    assert wrong / got.count() < 0.01


def test_best_cut():
    step = quality.STEP
    assert quality.best_cut([]) == quality.best_cut([(1, 4, 0)]) == quality.best_cut([(1, 0, 4)]) == quality.THRESHOLD
    # bad up to bin -40, good from bin -10 on: the middle of the gap
    assert quality.best_cut([(-10, 3, 0), (-60, 0, 2), (5, 9, 0), (-40, 0, 1)]) == round((-39 - 10) / 2 * step, 6)
    # nothing is told apart: all are kept
    assert quality.best_cut([(3, 5, 5)]) == round(3 * step, 6)
    # one good document among many bad ones is worth less than they are
    bins = [(-50, 1, 0), (-40, 0, 20), (0, 99, 0)]
    assert -39 * step <= quality.best_cut(bins) <= 0


def test_calibrated_threshold_keeps_unseen_good_documents(spark):
    d = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    # half of the labels are not shown: they test what was learnt from the others
    hidden = F.pmod(F.xxhash64("doc_id", F.lit("test")), F.lit(2)) == 0
    got = quality.quality(spark.read.parquet(f"{d}/documents.parquet"), labels.where(~hidden), threshold=None)
    got = got.join(labels.where(hidden), "doc_id").where("not base_failed")
    n = {(r["quality"], r["kept"]): r["count"] for r in rows(got.groupBy("quality", "kept").count())}
    assert n.get((1, False), 0) <= 0.005 * n[1, True] and n.get((0, True), 0) <= 0.03 * n[0, False], n


def test_calibration_edges(spark):
    text = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([(1, text), (1, text), (None, text), (2, None), (3, "")], "doc_id long, text string")
    labels = "doc_id long, quality int, toxic int, score string"
    for rows_ in ([], [(None, 1, 0, "x")], [(1, None, None, None)], [(i, i % 2, 0, "x") for i in range(20)] * 2):
        got = rows(quality.quality(df, spark.createDataFrame(rows_, labels), threshold=None))
        assert len(got) == 5 and not any(r["kept"] for r in got if r["n_words"] == 0)
    assert quality.quality(df.limit(0), spark.createDataFrame([], labels), threshold=None).count() == 0


def test_quality_edges(spark):
    schema = "doc_id long, text string, w int, h int, cell int, good int"
    text = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([(1, text, 1, 1, 1, 1), (1, text, 1, 1, 1, 1), (None, text, 0, 0, 0, 0), (2, None, 0, 0, 0, 0)], schema)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = rows(quality.quality(df, labels))
    assert len(got) == 4 and sum(r["kept"] for r in got) == 3 and {r["score"] for r in got if r["doc_id"] != 2} == {0.0}
    kept = quality.keep_good(df, labels)
    assert kept.columns == df.columns and sorted(str(r["doc_id"]) for r in rows(kept)) == ["1", "1", "None"]
    assert quality.quality(df.limit(0), labels).count() == 0


def test_trusted_sample_is_bounded(spark):
    labels = spark.createDataFrame([(i, 1, 0) for i in range(500)], "doc_id long, quality int, toxic int")
    assert quality.trusted_ids(labels, 100).count() == 100
    assert quality.trusted_ids(labels, 500).count() == 500


# ---------------------------------------------------------------- mixing


@pytest.fixture
def sources(docs):
    rng = random.Random(3)
    data = []
    for s, n in (("big", 400), ("mid", 60), ("small", 15), (None, 25)):
        data += [(len(data) + i, " ".join(["w"] * rng.randrange(1, 30)), "en", s) for i in range(n)]
    return docs(data + [(9000, None, "en", "big"), (9001, "", "en", "none")]), data


def by_source(got):
    tokens, uses = defaultdict(int), defaultdict(Counter)
    for r in got:
        tokens[r["source"]] += r["n_tokens"]
        uses[r["source"]][r["doc_id"]] += 1
    return tokens, uses


def test_full_mixture_uses_every_document_and_keeps_the_limit(sources):
    df, data = sources
    got = rows(mixing.mix(df, max_epochs=2.0, block_tokens=50))
    tokens, uses = by_source(got)
    assert {d for u in uses.values() for d in u} == {r[0] for r in data} | {9000, 9001}
    own = Counter()
    for _, t, _, s in data:
        own[s] += len(t.split())
    assert all(c == 1 for c in uses["big"].values())
    assert max(c for u in uses.values() for c in u.values()) <= 2
    # the exponent is the least that keeps the limit: the smallest source is used (nearly) twice
    a = got[0]["exponent"]
    assert 0 < a < 1
    for s, n in own.items():
        expected = n * (own["big"] / n) ** (1 - a)
        assert abs(tokens[s] - expected) <= 31


def test_entropy_target(sources):
    df, data = sources
    got = rows(mixing.mix(df, budget=4000, target_entropy=1.2, max_epochs=None, block_tokens=50))
    weights = {r["source"]: r["weight"] for r in got}
    entropy = -sum(w * math.log(w) for w in weights.values() if w > 0)
    assert abs(entropy - 1.2) < 1e-6
    tokens, _ = by_source(got)
    for s, w in weights.items():
        assert abs(tokens[s] - 4000 * w) <= 31


def test_mixture_is_deterministic_and_ordered_by_block(sources):
    df, _ = sources
    one, two = (sorted((r["doc_id"], r["epoch"], r["block_rank"], r["place"]) for r in rows(mixing.mix(df.repartition(k), block_tokens=50, seed=7))) for k in (1, 5))
    assert one == two
    assert one != sorted((r["doc_id"], r["epoch"], r["block_rank"], r["place"]) for r in rows(mixing.mix(df, block_tokens=50, seed=8)))
    order = {}
    for i, e, b, _ in one:
        if e == 0:
            order.setdefault(b, set()).add(i)
    assert len(order) > 5


def test_mixed_documents_columns_and_edges(spark, docs):
    schema = "doc_id long, text string, source string, block int, epoch int, weight int"
    df = spark.createDataFrame([(1, "a b c", "x", 1, 1, 1), (1, "a b c", "x", 1, 1, 1), (None, "a", "y", 2, 2, 2), (3, None, None, 0, 0, 0)], schema)
    out = mixing.mixed_documents(df)
    assert out.columns == df.columns
    ids = Counter(str(r["doc_id"]) for r in rows(out))
    assert ids["1"] == 2 and ids["None"] >= 1 and ids["3"] == 1
    assert mixing.mix(docs([])).count() == 0 and mixing.mixed_documents(docs([])).count() == 0
    assert mixing.mix(docs([(1, None), (2, "")])).count() == 2


def test_mixture_equals_a_brute_force_realisation(spark, docs, sources):
    """Exponent in closed form, then every source spent block by block, document by document, in plain Python."""
    df, data = sources
    data = [r for r in data] + [(9000, None, "en", "big")]
    df, size, limit, seed = docs(data), 50, 2.0, 3
    got = Counter((r["doc_id"], r["epoch"], r["block_rank"]) for r in rows(mixing.mix(df, max_epochs=limit, block_tokens=size, seed=seed)))
    words = {r[0]: len((r[1] or "").split()) for r in data}
    tokens = Counter()
    for r in data:
        tokens[r[3]] += words[r[0]]
    total, most, least = sum(tokens.values()), max(tokens.values()), min(tokens.values())
    a = max(0.0, 1 - math.log(limit) / math.log(most / least))
    spend = {s: max(n, round(most * (n / most) ** a)) for s, n in tokens.items()}
    count = {s: max(1, -(-n // size)) for s, n in tokens.items()}
    salt = "xxhash64(text)"
    facts = df.selectExpr("doc_id", "source", f"xxhash64({seed}, 'block', doc_id, {salt}, cast(null as long)) b", *[f"xxhash64({seed}, 'place', {e}L, doc_id, {salt}, cast(null as long)) p{e}" for e in range(3)])
    members = {}
    for r in rows(facts):
        members.setdefault((r["source"], r["b"] % count[r["source"]]), []).append(r)
    pairs = spark.createDataFrame([(s, b, e) for s, b in members for e in range(3)], "source string, block long, epoch long")
    order = {(r["source"], r["block"], r["epoch"]): r["o"] for r in rows(pairs.selectExpr("*", f"xxhash64({seed}, 'order', epoch, source, block) o"))}
    want = Counter()
    for s in tokens:
        full, rest = divmod(spend[s], tokens[s])
        for epoch in range(full + 1):
            left = tokens[s] if epoch < full else rest
            for rank, b in enumerate(sorted((b for t, b in members if t == s), key=lambda b: order[s, b, epoch]), 1):
                inside = sorted(members[s, b], key=lambda r: (r[f"p{epoch}"], r["doc_id"]))
                held = sum(words[r["doc_id"]] for r in inside)
                for r in inside:
                    if epoch < full or left > 0:
                        want[r["doc_id"], epoch, rank] += 1
                    if held > left and epoch == full:
                        left -= words[r["doc_id"]]
                if not (held > left and epoch == full) and left > 0:
                    left -= held
                if epoch == full and left <= 0:
                    break
    # a quota may be one token off by rounding, so only the last document of a source may differ
    assert sum(((got - want) + (want - got)).values()) <= len(tokens)
    assert sum(want.values()) > len(data)


def test_rows_without_ids_are_dealt_over_blocks(docs):
    got = rows(mixing.mix(docs([(None, f"w{i} x", "en", "hot") for i in range(600)] + [(7, f"y{i} z", "en", "hot") for i in range(600)]), block_tokens=60))
    assert len(got) == 1200
    ranks = Counter(r["block_rank"] for r in got)
    assert len(ranks) > 30 and max(ranks.values()) < 100
