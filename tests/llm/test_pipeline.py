"""The pipeline's stages against plain versions of each, on awkward rows."""

import random

import corpus_pipeline as p

from tessera.llm import langid, line_rules, simhash


def rows(df):
    return sorted((repr(tuple(r)) for r in df.collect()))


def test_stages_keep_the_columns(spark, odd_docs):
    assert [name for name, _ in p.STAGES] == ["quality rules", "language id", "simhash near-dedup", "suffix-array dedup", "best-fit packing"]
    for _, stage in p.STAGES[:-1]:
        assert stage(spark, odd_docs, "").columns == odd_docs.columns


def test_stages_do_what_their_operators_say(spark, odd_docs):
    """All rows, those of one id and those without an id included."""
    many = lambda rows: sorted(map(repr, rows))
    rows = odd_docs.collect()
    kept = [r["doc_id"] for r in line_rules.judge(odd_docs).collect() if r["kept"]]
    assert many(r["doc_id"] for r in p.quality(spark, odd_docs, "").collect()) == many(kept)
    accepted = [r["doc_id"] for r in langid.predict(odd_docs, langid.fit(odd_docs)).collect() if r["accepted"]]
    assert many(r["doc_id"] for r in p.language(spark, odd_docs, "").collect()) == many(accepted)
    prints = [simhash.fingerprint((r["text"] or "").encode(), 5) for r in rows]
    label = list(range(len(rows)))
    for _ in rows:
        for i, x in enumerate(prints):
            label[i] = min(label[j] for j, y in enumerate(prints) if bin(x ^ y).count("1") <= 5)
    least = {}
    for i, r in enumerate(rows):
        key = (r["doc_id"] is None, r["doc_id"] or 0)
        least[label[i]] = min(least.get(label[i], key), key)
    assert many(r["doc_id"] for r in p.near_copies(spark, odd_docs, "").collect()) == many(None if k[0] else k[1] for k in least.values())
    got = p.repeats(spark, odd_docs, "").collect()
    assert many(r["doc_id"] for r in got) == many(r["doc_id"] for r in rows)
    texts = [(r["text"] or "").split() for r in rows]
    for r in got:
        whole = (next(x["text"] for x in rows if x["doc_id"] == r["doc_id"]) or "").split()
        seen = [sum(t[k : k + 60] == whole[i : i + 60] for t in texts for k in range(len(t) - 59)) for i in range(len(whole) - 59)]
        left = (r["text"] or "").split()
        if not any(n > 1 for n in seen):
            assert left == whole
        assert not any(whole[i : i + 60] == left[k : k + 60] for i, n in enumerate(seen) if n > 1 for k in range(len(left) - 59))


def test_near_copies_go_by_row(spark):
    """Clean texts of one id both stay; of near copies without an id one does."""
    texts = ["alpha beta gamma delta one", "quite other words stand in here", "Rows that have no id at all", "rows that have no id at all", "alpha beta gamma DELTA one"]
    df = spark.createDataFrame(list(zip([1, 1, None, None, 0], texts)), "doc_id long, text string")
    got = p.near_copies(spark, df, "").collect()
    assert sorted((r["doc_id"] is None, r["doc_id"], r["text"].lower()) for r in got) == [(False, 0, texts[0]), (False, 1, texts[1]), (True, None, texts[3])]


def test_passages_under_400_bytes_go(spark):
    rnd = random.Random(9)
    some = lambda n: " ".join(f"{rnd.randrange(9000)}" for _ in range(n))
    shared, own = some(55), [some(40) for _ in range(4)]
    assert 200 < len(shared) < 400
    rows = [(0, f"{own[0]} {shared} {own[1]}", 9), (1, f"{own[2]}\n{shared}\n{own[3]}", 9)]
    got = p.repeats(spark, spark.createDataFrame(rows, "doc_id long, text string, n_chars long"), "").collect()
    assert {r["doc_id"]: r["text"].split() for r in got} == {0: f"{own[0]} {own[1]}".split(), 1: f"{own[2]} {own[3]}".split()}
    assert all(r["n_chars"] == len(r["text"]) for r in got)


def test_empty_table(spark, no_docs):
    docs = no_docs
    for _, stage in p.STAGES:
        docs = stage(spark, docs, "")
    assert docs.count() == 0


def test_whole_run(spark, odd_docs, tmp_path):
    odd_docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in p.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
    want = {r["doc_id"] for r in docs.select("doc_id").collect()}
    assert {r["doc_id"] for r in p.run(spark, str(tmp_path)).collect()} == want
