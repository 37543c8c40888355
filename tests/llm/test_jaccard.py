"""The Jaccard join against brute force, for both settings in use."""

import random
import re

import pytest

from tessel.llm import jaccard

SCHEMA = "doc_id long, text string, n long, keys string"


def plain(rows, k, percent):
    def words(t):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        return re.findall(r"[^\x20\x09-\x0D]+", low)

    def grams(t):
        w = words(t)
        return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()

    sets = [grams(r[1]) for r in rows]
    ids = [r[0] for r in rows]
    near = {i: set() for i in ids if i is not None}
    for x, s in enumerate(sets):
        for y in range(x):
            t = sets[y]
            if ids[x] is not None and ids[y] is not None and s and t and 100 * len(s & t) >= percent * len(s | t):
                near[ids[x]].add(ids[y])
                near[ids[y]].add(ids[x])
    comp = {None: None}
    for i in sorted(near):
        todo = [i] if i not in comp else []
        while todo:
            j = todo.pop()
            if j not in comp:
                comp[j] = i
                todo += near[j]
    return sorted(((i, len(s), comp[i]) for i, s in zip(ids, sets)), key=str)


def corpus(seed, n=260):
    rnd = random.Random(seed)
    bag = [f"w{i}" for i in range(400)]
    bases = [[rnd.choice(bag) for _ in range(rnd.choice([1, 2, 3, 5, 9, 14, 30, 60, 120, 300]))] for _ in range(25)]
    rows = []
    for i in range(n):
        w = list(rnd.choice(bases))
        for _ in range(rnd.choice([0, 0, 1, 1, 2, 4, 8])):
            at = rnd.randrange(len(w) + 1)
            if rnd.random() < 0.4 and len(w) > 1:
                w.pop(min(at, len(w) - 1))
            else:
                w.insert(at, rnd.choice(bag))
        rows.append((i * 3 + 1, rnd.choice([" ", "\n", "  "]).join(w).upper() if i % 7 == 0 else " ".join(w), i, "x"))
    return rows + [(9001, None, 0, ""), (9002, "", 0, ""), (9003, " \n\t ", 0, ""), (None, rows[0][1], 0, ""), rows[4], (rows[5][0], rows[60][1], 0, ""), (9004, "é" * 4000, 0, ""), (9005, "é" * 4000, 0, "")]


@pytest.mark.parametrize("k,percent,listed", [(3, 90, 32), (5, 80, 32), (3, 90, 1)])
def test_components_equal_brute_force(spark, monkeypatch, k, percent, listed):
    monkeypatch.setattr(jaccard, "LISTED", listed)
    monkeypatch.setattr(jaccard, "OPEN_PAIRS", 0 if listed == 1 else 8)
    monkeypatch.setattr(jaccard, "FILTER_KEYS", 0 if percent == 80 else 1 << 25)
    monkeypatch.setattr(jaccard, "BLOCK_ROWS", 8 if listed == 1 else 1024)
    monkeypatch.setattr(jaccard, "BROADCAST_ROWS", 0 if listed == 1 else 10**6)
    rows = corpus(percent + listed)
    got = jaccard.link_documents(spark.createDataFrame(rows, SCHEMA), k, percent)
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain(rows, k, percent)


def test_different_texts_of_one_id_stay(spark):
    rows = [(1, "a b c d e f", 0, "x"), (1, "totally different words stand here now", 0, "y"), (1, "a b c d e f", 0, "z"), (2, "a b c d e f", 0, "x"), (None, "a b c d e f", 0, "x"), (3, None, 0, "x")]
    got = sorted(((r.doc_id, r.text) for r in jaccard.keep_one(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    assert got == sorted([(1, "a b c d e f"), (1, rows[1][1]), (None, "a b c d e f"), (3, None)], key=str)


def test_a_bucket_whose_smallest_links_to_nobody(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "LISTED", 2)
    monkeypatch.setattr(jaccard, "OPEN_PAIRS", 0)
    base = [f"w{i}" for i in range(60)]
    rows = [(0, " ".join(base[:20] + [f"z{i}" for i in range(40)]), 0, "")] + [(i, " ".join(base[:-1] + [f"x{i}"]), 0, "") for i in range(1, 40)]
    got = jaccard.link_documents(spark.createDataFrame(rows, SCHEMA), 3, 90)
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain(rows, 3, 90)


def test_one_document_of_each_group_stays(spark):
    rows = corpus(5, 120)
    df = spark.createDataFrame(rows, SCHEMA)
    kept = jaccard.keep_one(df)
    assert kept.columns == df.columns
    want = plain(rows, 5, 80)
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted({i for i, _, c in want if i == c}, key=str)


def test_empty_table(spark):
    assert jaccard.link_documents(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("percent", [80, 90])
def test_a_pair_at_the_threshold_shares_a_key(percent):
    import numpy as np

    rng = np.random.default_rng(percent)
    bands = jaccard.Bands(percent)
    for n in [*range(1, 60), 100, 333, 1000]:
        for _ in range(20):
            base = rng.integers(0, 2**63, n, dtype=np.uint64)
            differ = int((100 - percent) * n / 100)
            cut = int(rng.integers(0, differ + 1))
            other = np.concatenate([base[cut:], rng.integers(0, 2**63, int(rng.integers(0, differ + 1)), dtype=np.uint64)])
            both = len(np.intersect1d(base, other))
            if both and 100 * both >= percent * (len(base) + len(other) - both):
                assert set(bands.keys(base)) & set(bands.keys(other))


def thue_morse(n):
    """Words on which polynomials modulo a power of two agree: a word of 0 and 1 by the parity of its place's bits, and its complement."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_patterned_words_do_not_collide(spark):
    from tessel.llm.common import word_hashes

    for n in (256, 1024, 4096, 65536):
        x, y = (w.encode() for w in thue_morse(n))
        assert len(set(word_hashes([x, y, x + b" " + y])[0].tolist())) == 2
        assert len(set(word_hashes([x, y], window=100)[0].tolist())) == 2
    rows = [(i, t) for n in (1024, 4096) for i, t in enumerate(thue_morse(n), n)]
    rows = [(i, f"{t} {t[::-1]} {t[1:]} {t[2:]}") for i, t in rows]
    rows += [(9999, rows[0][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in jaccard.link_documents(df, 3, 90).collect()} == {i: i for i, _ in rows} | {9999: 1024}
    assert sorted(r.doc_id for r in jaccard.keep_one(df, 5, 80).collect()) == sorted(i for i, _ in rows if i != 9999)
