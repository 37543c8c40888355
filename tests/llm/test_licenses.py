"""License scans against a plain search of word lists."""

import random
import re

from tessel.llm.licenses import BASE, known_templates, scan


def plain(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places = [(i, x) for p, x in BASE.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    starts = [i for i, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


def test_base_places_equal_plain_search(spark):
    random.seed(4)
    bag = ["MIT", "mit", "License", "license,", "APACHE", "general", "Public", "public", "GNU", "é", "K", "2.0", "a-b", "\n", "licenſe", "licen", "the"]
    texts = [" ".join(random.choice(bag) for _ in range(random.randrange(60))) for _ in range(300)]
    texts += [None, "", "mit", "MIT License", "mit license mit license", "x" * 5000, "mit license " * 3000, "  ", "worK"]
    rows = [(i, t, "x", "label") for i, t in enumerate(texts)] + [(3, texts[3], "x", "label"), (None, "mit license", "", "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, words string, label string")
    got = scan(df).collect()
    assert sorted(map(str, [(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got])) == sorted(map(str, [(r[0], *plain(r[1])) for r in rows]))
    assert all(0 <= r.score <= 1 and set(r.base_labels.split(",")) <= set(r.labels.split(",")) for r in got)


def test_longer_templates_with_changed_words(spark):
    bsd = next(t for t in known_templates() if t.label == "bsd").words
    far = bsd[:9] + ["new", "words"] + bsd[9:]
    rows = [(1, "a b " + " ".join(bsd) + " c"), (2, " ".join(far).upper()), (3, " ".join(bsd[:8])), (4, "Licensed under the Apache License, Version 2.0."), (5, "Licensed under CC BY-NC 4.0."), (6, "nothing of it")]
    got = {r.doc_id: r for r in scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i].labels for i in range(1, 7)] == ["bsd", "bsd", "", "apache,apache-2.0", "cc-by-nc-4.0", ""]
    assert got[1].score == 1 and 0.8 <= got[2].score < 1 and got[6].score == 0 and got[4].base_labels == "apache"


def test_empty_table(spark):
    assert scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_a_long_text_costs_what_it_is_long(spark):
    """300,000 words are three times 100,000: words aren't carried along with each other."""
    import time

    took = []
    for n in (1000, 100_000, 300_000):
        text = "word mit license " * (n // 3)
        began = time.time()
        r = scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
        took.append(time.time() - began)
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (n // 3 * 3, n // 3, 1, n // 3 * 3 - 2)
    assert took[2] < 20
