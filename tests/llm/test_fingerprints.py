"""Merkle trees against a plain form, and where they say that texts differ."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from tessel.llm import fingerprints
from tessel.llm.fingerprints import as_string, compare_with_next, differing, likeness, tree


def md5(s):
    return hashlib.md5(s.encode()).hexdigest()


def plain(text):
    tops, out = [], ""
    for s in text.split("\n\n"):
        lines, below = [], ""
        for p in s.split("\n"):
            leaves = [md5(x) for x in re.sub("([.,;:!?] )", "\\1\x01", p).split("\x01")]
            lines.append(md5("".join(leaves)))
            below += "." + lines[-1][:12] + "".join("-" + x[:8] for x in leaves)
        tops.append(md5("".join(lines)))
        out += "/" + tops[-1][:16] + below
    return hashlib.sha256("".join(tops).encode()).hexdigest() + out


def near(a, b):
    x, y = (set(re.findall("-([0-9a-f]{8})", f)) for f in (a, b))
    return 1.0 if a[:64] == b[:64] else min(2 * len(x & y) / (len(x) + len(y)), 1 - 1 / (len(x) + len(y)))


def texts():
    r = random.Random(5)
    bag = ["one", "two. ", "three, ", "\n", "\n\n", "é", "😀", "x\x01y", "  ", "a.b", "! ", "\x00"]
    return ["".join(r.choice(bag) for _ in range(r.choice([1, 4, 30, 200]))) for _ in range(60)] + [None, "", "\n", "\n\n\n", ". ", "a"]


def fp(text):
    return as_string(tree(text))


def test_fingerprints_equal_the_plain_tree(spark):
    t = sorted({x or "" for x in texts()})
    got = {r.text: r.f for r in spark.createDataFrame([(x,) for x in t], "text string").select("text", fp(F.col("text")).alias("f")).collect()}
    assert got == {x: plain(x) for x in t} and len({f[:64] for f in got.values()}) == len(t)


def test_marks_in_a_text_do_not_give_another_texts_tree(spark):
    t = ["a. b", "a. \x01b", "a.\x01 b", "a\x01. b", "a. b\x01", "ab", "a\x01b", "a\n\nb", "a\nb", "a\n\n\nb"]
    got = spark.createDataFrame([(x,) for x in t], "text string").select(F.substring(fp(F.col("text")), 1, 64)).distinct().count()
    assert got == len(t)


def test_documents_against_their_next(spark):
    docs = [(i * 3 % 101, t, "x") for i, t in enumerate(texts())]
    docs += [(200, "x" * 1_000_000 + ". y", "x"), (201, docs[0][1], "x"), (docs[0][0], docs[0][1], "again"), (None, "last. one", "x")]
    got = compare_with_next(spark.createDataFrame(docs, "doc_id long, text string, fp string").repartition(7))
    rows = sorted(got.collect(), key=lambda r: (r.doc_id is None, r.doc_id, r.n_chars))
    ids = sorted({d[0] for d in docs if d[0] is not None}, reverse=True) + [None]
    own = {i: min(d[1] or "" for d in docs if d[0] == i) for i in ids}
    want = []
    for i, t, _ in sorted(docs, key=lambda d: (d[0] is None, d[0], len(d[1] or ""))):
        t, after = t or "", own[ids[(ids.index(i) + 1) % len(ids)]]
        k = len(t) // 3
        edited = t[: len(t) - k] + after[:k]
        want.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), plain(t), plain(edited), near(plain(t), plain(edited)), near(plain(t), plain(after))))
    assert [tuple(r[:7]) for r in rows] == want
    assert all((r.edited_at == "") for r in rows if r.near_edited == 1)


def test_one_document_is_its_own_next(spark):
    r = compare_with_next(spark.createDataFrame([(5, "abc. def")], "doc_id long, text string")).first()
    assert (r.n_chars, r.near_next) == (8, 1.0) and r.edited_sha256 == hashlib.sha256(b"abc. dab").hexdigest() and r.edited_at == "0.0"
    assert compare_with_next(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_differing_branches_locate_edits(spark):
    a = "s0 p0. x\ns0 p1\n\ns1 p0\ns1 p1, y\n\ns2 p0"
    cases = {a: [], a.replace("y", "z"): [(1, 1)], a.replace("s0 p1", "s0 p1\nnew"): [(0, 2)], "new\n\n" + a: [(0, 0)], "\n\n".join(reversed(a.split("\n\n"))): [], a.replace("x", "X").replace("s2", "S2"): [(0, 0), (2, 0)]}
    df = spark.createDataFrame([(a, b) for b in cases], "a string, b string").select("b", fp(F.col("a")).alias("x"), fp(F.col("b")).alias("y"))
    for r in df.select("b", differing(F.col("x"), F.col("y")).alias("d"), likeness(F.col("x"), F.col("y")).alias("l")).collect():
        assert [tuple(x) for x in r.d] == cases[r.b] and (r.l == 1) == (r.b == a) and 0 <= r.l <= 1


def test_likeness_follows_the_share_kept(spark, sf_dir):
    got = compare_with_next(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    r = got.select(F.avg("near_edited").alias("e"), F.avg("near_next").alias("n"), F.avg((F.col("near_edited") >= F.col("near_next")).cast("double")).alias("s")).first()
    assert r.e > 0.5 > 0.1 > r.n and r.s > 0.97
    assert fingerprints.BLOCK == 16
