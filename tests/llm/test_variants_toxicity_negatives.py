"""Spelling variants, hard negatives and toxicity against brute force and held-out labels, and on odd input."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from conftest import DATA
from pyspark.sql import functions as F
from test_text_operators import DOCS, odd_rows

from strataloom.llm import hardneg, spelling, toxicity

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# -- 12 ----------------------------------------------------------------------------------------------------------------


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def test_automaton_numbers_words_in_order_and_is_minimal():
    r = random.Random(1)
    words = sorted({"".join(r.choice("abé") for _ in range(r.randint(1, 7))) for _ in range(400)})
    a = spelling.Automaton(words)
    for k, w in enumerate(words):
        state, number = a.follow(a.start, 0, w)
        assert a.final[state] and number == k
    assert len({(f, tuple(sorted((c, to) for c, (to, _) in arcs.items()))) for f, arcs in zip(a.final, a.arcs, strict=True)}) == len(a.arcs)
    assert spelling.Automaton([]).near("", "a") == set()


def test_near_is_one_edit_after_an_exact_half():
    r = random.Random(2)
    words = sorted({"".join(r.choice("ab") for _ in range(r.randint(4, 8))) for _ in range(150)})
    a = spelling.Automaton(words)
    for w in words:
        h = len(w) // 2
        assert {words[k] for k in a.near(w[:h], w[h:])} == {v for v in words if v.startswith(w[:h]) and one_edit(w, v)}


def brute_variants(rows):
    count = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += 1
    n = {w: c for w, c in count.items() if len(w) >= 6 and c >= 5}
    near = {w: [v for v in n if abs(len(v) - len(w)) < 2 and one_edit(w, v)] for w in n}
    form = {w: f for w in n if near[w] and n[f := min(near[w], key=lambda v: (-n[v], v))] >= 5 * n[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {(w, form.get(w), root(w), n[w], len(near[w]), n.get(form.get(w))) for w in n}


def variant_rows():
    """A chain of forms, ties, words of six letters, accents, and a crowd of words alike in their first, and in their last letters."""
    r = random.Random(3)
    rows = [(k, " ".join(["banana"] * 30)) for k in range(20)] + [(100 + k, "bananaz " * 20 + "bananazz " * 4) for k in range(5)] + [(150, "bananazzz bananazzz bananazzz. BANANAZZZ-Bananazzz")]
    rows += [(200 + k, "éclairs éclairé Éclairs ×÷abcd abĀcdefgh " * 6) for k in range(3)]
    for k in range(60):
        rows.append((300 + k, " ".join(r.choice(["prefix", "xyzpre", "ending"]) + "".join(r.choice("ab") for _ in range(r.randint(0, 4))) + r.choice(["", "suffix"]) for _ in range(120))))
    return rows + [(None, "orphan words " * 5), (900, None), (901, ""), (902, "x" * 70_000 + " " + "long words " * 30_000)]


def test_variants_by_brute_force(spark):
    rows = variant_rows()
    docs = spark.createDataFrame([(*x, "w", 1, "k") for x in rows + rows[:1]], "doc_id long, text string, word string, n int, key string")
    want = brute_variants(rows + rows[:1])
    assert {r[1] for r in want if r[1]} and any(r[1] != r[2] for r in want if r[1])
    for shard, unit in ((32_768, 16_384), (5, 10)):  # the second deals words anew, and cuts shards
        got = spelling.group_variants(docs, shard=shard, unit=unit).collect()
        assert len(got) == len(want) and {tuple(r) for r in got} == want
    parts = spelling.shards(spelling.words(docs), True, 5).collect()
    assert max(r.part for r in parts) > 0 and any(not r.held for r in parts) and any(not r.asked for r in parts)


def test_variants_of_a_table_and_of_none(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet")
    got = spelling.group_variants(docs).collect()
    assert {tuple(r) for r in got} == brute_variants([(r.doc_id, r.text) for r in docs.collect()])
    assert spelling.group_variants(docs.where("false")).collect() == []
    assert spelling.group_variants(spark.createDataFrame(odd_rows(), DOCS)).count() == len(brute_variants([r[:2] for r in odd_rows()]))


# -- 13 ----------------------------------------------------------------------------------------------------------------


def brute_negatives(rows, is_anchor, k=5, n=3):
    """rows: (id, label, integers)."""
    size = max(len(v) for _, _, v in rows)
    dot = lambda a, b: sum(x * y for x, y in zip(a + [0] * (size - len(a)), b + [0] * (size - len(b)), strict=True))
    out = set()
    for i, label, v in rows:
        if not is_anchor(i):
            continue
        ranked = sorted(((-dot(v, w), j, m) for j, m, w in rows if j != i))
        for s, j, _ in [x for x in ranked if x[2] == label][:k]:
            good = [(t, m) for t, m, other in ranked if other != label and 50 * -s <= 100 * -t <= 95 * -s][:n]
            out |= {(i, j, r, m, -s, -t) for r, (t, m) in enumerate(good, 1)}
    return out


def vectors(spark, rows):
    return hardneg.scaled(spark.createDataFrame(rows, "vec_id long, label int, e array<double>, v string, part int"), "vec_id", "label", "e")


def odd_vectors():
    r = random.Random(4)
    rows = [(k, r.randrange(4), [round(r.gauss(0, 1), 3) for _ in range(6)], "x", 1) for k in range(300)]
    rows += [(1000 + k, k % 3, [0.5, 0.25, 0.0, -1.0, 2.0, 0.1], "x", 1) for k in range(120)]  # one vector, many times
    rows += [(2000, 9, [1.0] * 6, "x", 1), (2010, 8, [0.0] * 6, "x", 1), (2020, 0, [1.0, 2.0], None, None), (2030, 1, [], "x", 1), (2040, 1, [9.0, -9.0, 9.0, 9.0, 9.0, 9.0], "x", 1)]
    out = [(3000, None, [1.0] * 6, "x", 1), (3001, 1, None, "x", 1), (3002, 1, [1.0, None, 0.0, 0.0, 0.0, 0.0], "x", 1), (3003, 1, [float("nan")] * 6, "x", 1), (3004, 1, [float("-inf")] * 6, "x", 1), (None, 1, [1.0] * 6, "x", 1), (3005, 1, [1e200] * 6, "x", 1)]
    return rows, out


@pytest.mark.parametrize("group,block,pivots,part", [(65_536, 131_072, 32, 1024), (7, 40, 5, 4)])
def test_negatives_by_brute_force(spark, monkeypatch, group, block, pivots, part):
    for name, value in (("GROUP", group), ("BLOCK", block), ("PIVOTS", pivots), ("PART_ANCHORS", part), ("LEAST_BLOCK", block)):
        monkeypatch.setattr(hardneg, name, value)
    rows, out = odd_vectors()
    whole = [(i, label, [int(np.floor(256 * x)) for x in v]) for i, label, v, *_ in rows]
    got = hardneg.hard_negatives(vectors(spark, rows + out + rows[5:9]), F.col("vec_id") % 10 == 0).collect()
    want = brute_negatives(whole, lambda i: i % 10 == 0)
    assert len(got) == len(want) > 300 and {tuple(r) for r in got} == want


def test_negatives_with_far_rows_pruned(spark, monkeypatch):
    """Labels in clusters far apart: few rows of the other clusters are sent, none of use is missed."""
    r = random.Random(5)
    centres = [[r.gauss(0, 1) for _ in range(8)] for _ in range(6)]
    rows = [(k, k % 12, [c + r.gauss(0, 0.05) for c in centres[k % 6]], "x", 1) for k in range(400)]
    monkeypatch.setattr(hardneg, "GROUP", 8)
    whole = [(i, label, [int(np.floor(256 * x)) for x in v]) for i, label, v, *_ in rows]
    got = hardneg.hard_negatives(vectors(spark, rows), F.col("vec_id") % 9 == 0).collect()
    assert {tuple(x) for x in got} == brute_negatives(whole, lambda i: i % 9 == 0)
    seen = []
    kept = hardneg.sent
    monkeypatch.setattr(hardneg, "sent", lambda rows, anchors, *more: seen.append((kept(rows, anchors, *more).count(), rows.count() * anchors.select("part", "sub").distinct().count())) or kept(rows, anchors, *more))
    hardneg.hard_negatives(vectors(spark, rows), F.col("vec_id") % 9 == 0).count()
    assert seen[0][0] < seen[0][1] / 2


def test_negatives_of_none(spark):
    rows = vectors(spark, odd_vectors()[0])
    assert hardneg.hard_negatives(rows.where("false"), F.col("vec_id") % 10 == 0).collect() == []
    assert hardneg.hard_negatives(rows, F.lit(False)).collect() == []
    assert hardneg.hard_negatives(rows.where("vec_id = 10"), F.lit(True)).collect() == []
    big = [(k, k % 2, [float(40_000 + 13 * k), float(k * k), 1.0], "x", 1) for k in range(60)]  # beyond 2^24
    whole = [(i, label, [int(np.floor(256 * x)) for x in v]) for i, label, v, *_ in big]
    assert {tuple(x) for x in hardneg.hard_negatives(vectors(spark, big), F.lit(True)).collect()} == brute_negatives(whole, lambda i: True)


# -- 11 ----------------------------------------------------------------------------------------------------------------


def plain_score(network, text):
    """The network by loops over words, widths and filters."""
    b = toxicity.Buckets()
    ids = [b[w] for w in text.encode().lower().split()] + [0] * max(toxicity.WIDTHS)
    own = [(network.words[i // toxicity.BUCKETS].astype(float) + network.words[i % toxicity.BUCKETS]) / 2 for i in ids]
    hidden = []
    for w, f, shift in zip(toxicity.WIDTHS, network.filters, network.shift, strict=True):
        n = max(1, len(ids) - max(toxicity.WIDTHS))
        for k in range(toxicity.FILTERS):
            top = max(sum(float(own[s + j] @ f[j * toxicity.DIM : (j + 1) * toxicity.DIM, k]) for j in range(w)) + shift[k] for s in range(n))
            hidden.append(top if top > 0 else toxicity.LEAK * top)
    return 1 / (1 + np.exp(-np.clip(network.offset + network.scale * (np.dot(hidden, network.out) + network.bias), -30, 30)))


def toxic_table(spark, n=900):
    """Texts of invented words; toxic ones have words that begin alike, of another stem in each language."""
    r = random.Random(6)
    word = lambda: "".join(r.choice("aeioulnrst") for _ in range(r.randint(2, 7)))
    docs, labels = [], []
    for k in range(n):
        lang, toxic = r.choice(["en", "de"]), int(r.random() < 0.3)
        words = [word() for _ in range(r.randint(5, 60))]
        for _ in range(toxic * 2):
            words.insert(r.randrange(len(words)), {"en": "zzgrr", "de": "qkkff"}[lang] + word())
        docs.append((k, " ".join(words), lang, 0.5, "x"))
        labels.append((k, 1, toxic))
    return spark.createDataFrame(docs, "doc_id long, text string, lang string, score double, threshold string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_held_out(spark):
    docs, labels = toxic_table(spark)
    got = toxicity.score_documents(docs, labels).join(labels, "doc_id").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == 900 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    for column in ("predicted", "flagged"):
        assert np.mean([int(r[column]) == r.toxic for r in got if r.held_out]) > 0.95
    assert all(r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for r in got)
    assert len({r.threshold for r in got}) > 1 and len({(r.lang, r.threshold) for r in got}) == len({r.lang for r in got})


def test_toxicity_scores_by_loops(spark):
    docs, labels = toxic_table(spark, 240)
    network, _ = toxicity.fit(docs, labels)
    got = {r.doc_id: r.score for r in toxicity.score_documents(docs, labels).collect()}
    for r in docs.where("doc_id < 40").collect():
        assert abs(got[r.doc_id] - plain_score(network, r.text)) < 1e-4
    assert abs(network.scores([np.empty(0, np.int64)])[0] - plain_score(network, "")) < 1e-5


def test_toxicity_takes_no_label_or_language(spark):
    docs, labels = toxic_table(spark, 240)
    base = {r.doc_id: r.score for r in toxicity.score_documents(docs, labels).collect()}
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    other = toxicity.score_documents(docs, labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic"))))
    assert {r.doc_id: r.score for r in other.collect()} == base
    same = toxicity.score_documents(docs.withColumn("lang", F.when(held, F.lit(None)).otherwise(F.col("lang"))), labels)
    assert {r.doc_id: r.score for r in same.collect()} == base


def test_toxicity_on_odd_rows(spark):
    odd, labels = spark.createDataFrame(odd_rows(), DOCS), spark.createDataFrame([(k % 9, None, k % 2 if k % 5 else None) for k in range(20)] + [(None, 1, 1)], "doc_id long, quality int, toxic int")
    got = toxicity.score_documents(odd, labels).collect()
    assert len(got) == len(odd_rows()) and all(0 <= r.score <= 1 for r in got) and np.ptp([r.score for r in got if r.doc_id == 5]) < 1e-5
    assert {r.score for r in toxicity.score_documents(odd, labels.where("false")).collect()} == {0.5}
    assert toxicity.score_documents(odd.where("false"), labels).collect() == []
    few = toxicity.score_documents(odd, spark.createDataFrame([(1, 1, 1), (3, 1, 1)], "doc_id long, quality int, toxic int")).collect()
    assert len({r.score for r in few}) == 1 and few[0].score > 0.5
