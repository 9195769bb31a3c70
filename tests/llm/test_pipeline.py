"""The pipeline against a plain version of its stages, and on odd rows."""

from collections import Counter

from conftest import DATA
from test_text_operators import DOCS, brute_hits, odd_rows, sha, tokenizer

import corpus_pipeline
from strataloom.llm import rules, simhash

SF = f"{DATA}/sf0.001"


def brute_copies(docs):
    """The least id of each group of texts whose sets of five-word shingles have a similarity of 0.8 or more: every pair is compared."""

    def shingles(t):
        w = t.encode().lower().split()
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}

    sets, label, ids = {i: shingles(t) for i, t in docs.items()}, {i: i for i in docs}, sorted(docs)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            x, y = sets[i], sets[j]
            if label[i] != label[j] and 100 * len(x & y) >= 80 * len(x | y):
                low, high = sorted((label[i], label[j]))
                label = {k: low if v == high else v for k, v in label.items()}
    return label


def brute(rows, items, kept_ids):
    """rows: (doc_id, text); kept_ids: what the first stage keeps (its own tests compare it with SQL)."""
    docs = {i: t or "" for i, t in rows if i in kept_ids}
    holders, low = {}, lambda x: x.strip(" \t\n\v\f\r").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    for i, t in docs.items():
        for x in t.split("\n"):
            if len(low(x)) >= 40:
                holders.setdefault(low(x), set()).add(i)
    common = {k: max(v) for k, v in holders.items() if len(v) >= 5}
    docs = {i: "\n".join(x for x in t.split("\n") if common.get(low(x), i) == i) for i, t in docs.items()}
    first = brute_copies(docs)
    docs = {i: t for i, t in docs.items() if first[i] == i}
    bad = {r[0] for r in brute_hits(list(docs.items()), items) if r[-1]}
    t = tokenizer()
    out = []
    for i, x in docs.items():
        if i not in bad:
            ids = t.encode(x, add_special_tokens=False).ids
            out.append((i, len(ids), sha(" ".join(map(str, ids))), sha(t.decode(ids, skip_special_tokens=False))))
    return Counter(out)


def test_run_against_brute_force(spark):
    docs, bench = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    kept = {r.doc_id for r in rules.apply_rules(docs).where("kept").collect()}
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in bench.collect()], kept)
    assert Counter(map(tuple, corpus_pipeline.run(spark, SF).collect())) == want


def test_stages_on_odd_rows(spark):
    """Which rows each stage keeps of nulls, empty, long and repeated texts, and that it keeps none of an empty table."""
    rows = odd_rows()
    # rules: all are of under 50 words or repeat themselves; line dedup: nobody goes; near-dedup: one of the three texts without words, one of the repeated ones
    kept = {"quality_rules": [], "line_dedup": [r[0] for r in rows], "near_dedup": [0, 3, 4, 5, 7, None, 99], "decontamination": [r[0] for r in rows]}
    docs = spark.createDataFrame(rows, DOCS)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        assert sorted(map(str, [r.doc_id for r in out.collect()])) == sorted(map(str, kept[name])), name
        assert stage(spark, docs.limit(0), SF).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == len(rows) and corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), SF).count() == 0


def test_near_dedup_loses_no_text(spark):
    """Different texts with one id stay, copies with one id or another go, rows without an id stay."""
    long = [" ".join(f"{k}w{n}" for n in range(60)) for k in range(4)]
    near = long[0].replace("0w30 ", "changed ")
    rows = [(1, long[0], "a"), (1, long[1], "a"), (2, long[2], "a"), (2, long[2], "b"), (3, near, "a"), (None, long[3], "a"), (None, long[3], "a"), (4, long[1], "c"), (5, None, "a"), (6, "", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept_id string")
    got = [(r.doc_id, r.text) for r in simhash.keep_one(docs).collect()]
    assert sorted(map(str, got)) == sorted(map(str, [(1, long[0]), (1, long[1]), (2, long[2]), (None, long[3]), (None, long[3]), (5, None)]))


def test_near_dedup_by_brute_force_over_a_table(spark):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert {r.doc_id: r.component_id for r in simhash.near_copies(spark.read.parquet(f"{SF}/documents.parquet")).collect()} == brute_copies(docs)


def test_each_stage_decides_something(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet")
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, f"{DATA}/sf0.01").cache()
        sizes.append(docs.count())
        if name == "line_dedup":
            assert sizes[-1] == sizes[-2] and docs.alias("a").join(before.alias("b"), "doc_id").where("a.text <> b.text AND a.n_chars < b.n_chars").count() > 0
    assert sizes[0] > sizes[1] == sizes[2] > sizes[3] > sizes[4] > 0
