"""The pipeline's stages, each against a brute-force version on its own input."""

import corpus_pipeline
from covaria.llm.common import stored
from tests.llm.test_operators import SPACE, brute_components, brute_counts

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs = docs.union(spark.createDataFrame([(10**9, None, None, "s", 0), (10**9 + 1, "12 !! 34", "en", "s", 0)], docs.schema))
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stored(stage(spark, docs, SF), "test")
        if k == len(corpus_pipeline.STAGES) - 1:
            assert {r["doc_id"] for r in out.select("doc_id").collect()} == set(before)
            break
        assert out.columns == docs.columns
        after = {r["doc_id"]: r["text"] for r in out.collect()}
        assert all(before[i] == t for i, t in after.items())
        if name == "language ID":
            assert set(before) - set(after) == {i for i, t in before.items() if not any(c.isalpha() for c in t or "")}
        elif name == "quality rules":
            for i, t in before.items():
                n, _, _, _, repeat = brute_counts(t)
                assert not (i in after and (n < 50 or 100 * repeat > 50 * n))
            labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
            good = [i for i, t in before.items() if labels.get(i) == 1 and brute_counts(t)[0] >= 50 and 2 * brute_counts(t)[4] <= brute_counts(t)[0]]
            assert sum(i in after for i in good) >= 0.98 * len(good)
        elif name == "exact dedup":
            best = {}
            for i, t in before.items():
                key = SPACE.sub("", t)
                best[key] = min(best.get(key, (0, 0)), (-len(t), i)) if key in best else (-len(t), i)
            assert set(after) == {i for _, i in best.values()}
        else:
            assert set(after) == {i for i, (_, c) in brute_components(sorted(before.items())).items() if i == c}
        docs, before = out, after


def test_run(spark):
    got = corpus_pipeline.run(spark, SF).collect()
    by_doc, by_bin = {}, {}
    for p in got:
        by_doc.setdefault(p["doc_id"], []).append(p)
        by_bin.setdefault(p["sequence_id"], []).append(p["length"])
    assert got and all(sum(p["length"] for p in ps) == ps[0]["doc_tokens"] for ps in by_doc.values())
    assert all(sum(n) <= 2048 for n in by_bin.values())


PROSE = " ".join(f"the subject{k} of this text was a kind{k * 7} of" for k in range(40))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, dropped_id long, d_id long, lang_pred string, `k text` string, row int"


def test_stages_on_repeats_clashes_and_nulls(spark):
    """Columns named as operators name theirs; rows that repeat an id with the same and with another text; a very long text."""
    other = PROSE.replace("subject", "topic").replace("kind", "sort")
    long = " ".join(f"word{k} the" for k in range(40_000))
    texts = [(1, PROSE), (1, PROSE), (2, PROSE + " "), (2, other), (3, other + " and more"), (4, long), (5, None), (6, ""), (None, PROSE), (None, PROSE + " x")]
    docs = spark.createDataFrame([(i, t, None, "s", 0, 1, 2, "z", "y", 3) for i, t in texts], SCHEMA)
    kept = lambda stage: sorted((r["doc_id"] or 0, len(r["text"] or "")) for r in stage(spark, docs, SF).collect())
    assert corpus_pipeline.language_id(spark, docs, SF).columns == docs.columns
    assert kept(corpus_pipeline.language_id) == sorted((i or 0, len(t)) for i, t in texts if t)
    assert kept(corpus_pipeline.quality) == [(4, len(long))]  # the others repeat most of their three-word windows
    assert kept(corpus_pipeline.exact) == sorted([(2, len(PROSE) + 1), (2, len(other)), (3, len(other) + 9), (4, len(long)), (5, 0), (0, len(PROSE) + 2)])
    assert {i for i, _ in kept(corpus_pipeline.near)} == {0, 1, 4, 5, 6}


def test_stages_on_an_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).collect() == []
