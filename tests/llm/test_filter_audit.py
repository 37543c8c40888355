"""The filter audit against filters that are really applied one after another, in every order."""

import random
import re
from collections import Counter
from itertools import permutations

from pyspark.sql import functions as F

from tessel.llm import filter_audit
from tessel.llm.filter_audit import FILTERS, audit

DOCS, LABELS = "doc_id long, text string, lang string, mask string, n long, good string, part string", "doc_id long, quality int, toxic int, text string"


def fails(doc, others):
    text = doc[1] or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {
        "A": len(words) < 200,
        "B": 100 * len(set(words)) < 50 * len(words),
        "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text),
        "D": any(c in text for c in "#$%&*|"),
        "E": doc[0] is not None and any(o[0] is not None and o[0] < doc[0] and (o[1] or "") == text for o in others),
    }


def plain(docs, labels):
    out = {}
    failed = [(d[2] or "", fails(d, docs), any(x[0] == d[0] and d[0] is not None and x[1] == 1 for x in labels), any(x[0] == d[0] and d[0] is not None and x[2] == 1 for x in labels)) for d in docs]
    for part in {f[0] for f in failed}:
        own = [f for f in failed if f[0] == part]
        shapley = Counter()
        for order in permutations(FILTERS):
            left = own
            for k, f in enumerate(order):
                gone = [d for d in left if d[1][f]]
                left = [d for d in left if not d[1][f]]
                shapley[f] += len(gone)
                out[part, "".join(order), k + 1] = [len(left), len(gone), sum(d[1][f] for d in own) - len(gone), sum(d[1][f] and sum(d[1].values()) == 1 for d in own), sum(d[2] for d in gone), sum(d[3] for d in gone)]
        for (p, order, k), row in out.items():
            if p == part:
                row.append(shapley[order[k - 1]])
    return out


def found(spark, docs, labels):
    got = audit(spark.createDataFrame([(*d, "x", 1, "y", "z") for d in docs], DOCS), spark.createDataFrame([(*x, "t") for x in labels], LABELS))
    return {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in got.collect()}


def test_audit_equals_filters_in_every_order(spark):
    random.seed(3)
    bag = ["one", "two", "Three", "FOUR", "a|b", "50%", "\x0b", "é", "  ", "\x1c"]
    texts = [" ".join(random.choice(bag[: random.randrange(1, 11)]) for _ in range(random.choice([3, 20, 250]))) for _ in range(40)]
    texts += [None, "", "#", "AAA", " ".join(f"w{i}" for i in range(300)), "x" * 300_000]
    docs = [(i, random.choice(texts), random.choice(["en", "de", None, ""])) for i in range(150)]
    docs += [(7, docs[7][1], docs[7][2])] * 3 + [(8, docs[9][1], "en"), (None, docs[0][1], "en"), (None, docs[0][1], None)]
    docs += [(1000 + i, texts[-2], "en") for i in range(200)]  # a large group of copies
    labels = [(i, random.choice([0, 1, None]), random.choice([0, 1])) for i in range(0, 150, 2)] + [(4, 1, None), (None, 1, 1), (99999, 1, 1)]
    assert found(spark, docs, labels) == plain(docs, labels)


def test_parity_sums_invert_to_the_cells(spark):
    rows = [("p", m % 3 == 0, False, m, (m * 7) % 11) for m in range(32)] + [("p", False, False, 5, 3)]
    sums = filter_audit.parity_sums(spark.createDataFrame(rows, "part string, good boolean, toxic boolean, mask int, n long"))
    got = {r.good: r.c for r in sums.select("good", filter_audit.invert(F.col("w")).alias("c")).collect()}
    for good in (True, False):
        assert got[good] == [sum(n for _, g, _, k, n in rows if g == good and k == m) for m in range(32)]


def test_empty_tables(spark):
    assert found(spark, [], []) == {}
    assert len(found(spark, [(1, "a", "en")], [])) == 600
