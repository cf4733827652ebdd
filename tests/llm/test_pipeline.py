"""The pipeline's stages: what each takes and gives, and that its decisions take effect."""

import regex
from pyspark.sql import functions as F

import corpus_pipeline


def staged(spark, sf, docs, tmp_path, upto=5):
    out = [docs]
    for i, (name, fn) in enumerate(corpus_pipeline.STAGES[:upto]):
        path = str(tmp_path / f"{i}-{name}")
        fn(spark, out[-1], sf).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    read, good, unique, clean, masked, ids = staged(spark, sf, docs, tmp_path)
    assert all(x.columns == docs.columns for x in (good, unique, clean, masked))
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    kept = good.join(labels, "doc_id").groupBy("quality").count()
    kept = {r["quality"]: r["count"] for r in kept.collect()}
    assert kept.get(0, 0) <= 0.1 * labels.where("quality = 0").count() and kept[1] >= 0.95 * labels.where("quality = 1").count()
    # no two documents that stay have near sets of trigrams
    sets = {}
    for r in unique.collect():
        w = regex.findall(r"[\p{L}\p{N}\p{M}]+", r.text.lower())
        sets[r.doc_id] = {tuple(w[i : i + 3]) for i in range(max(len(w) - 3, 0) + 1)}
    items = sorted(sets)
    for i, a in enumerate(items):
        for b in items[i + 1 :]:
            k = len(sets[a] & sets[b])
            assert 2 * k < len(sets[a]) + len(sets[b]) - k
    assert 0 < unique.count() < good.count()
    assert clean.count() == unique.count() == masked.count() == ids.count()
    assert clean.where(F.col("n_chars") != F.length("text")).count() == 0
    assert ids.where("NOT exact").count() == 0


def test_run_gives_the_last_stage(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert out.columns == ["doc_id", "n_tokens", "token_ids", "exact"] and out.count() > 50
    assert corpus_pipeline.ORACLE_SQL is None


def test_empty_documents(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("false")
    assert staged(spark, sf, docs, tmp_path)[-1].count() == 0


def test_hard_rows_go_through_all_stages(spark, tmp_path):
    """Nulls, empty and long texts, repeated rows and columns with clashing names, each stage against the operators' definitions."""
    good = "The committee met on Tuesday and agreed that the new bridge should be built before the winter, as the old one is too narrow for the buses. "
    passage = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    rows = [
        (1, None, "en"), (2, "", None), (3, good, "en"), (3, good, "en"), (4, good + "Nobody was against it.", "en"), (None, good, "en"), (5, "word " * 60_000, "en"), (6, f"Before it. {passage} And after. " + "Quite other words stand here about the harvest of apples.", "en"),
        (7, 'Rain fell all night on the roofs of the town and the token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" was lost.', "de"), (8, "日本語 \U0001f600 längere Wörter", "de"),
    ]
    docs = spark.createDataFrame([(*r, "s", len(r[1] or ""), 0.5, True, "x", 7) for r in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, keep boolean, class_id string, links int").repartition(3)
    for name, table in (("labels", spark.createDataFrame([(1, 1, 0)], "doc_id bigint, quality int, toxic int")), ("benchmark", spark.createDataFrame([(1, passage), (2, None)], "item_id bigint, text string")), ("documents", docs)):
        table.write.parquet(str(tmp_path / f"{name}.parquet"))
    _, kept, unique, clean, masked, ids = staged(spark, str(tmp_path), docs, tmp_path)
    assert all(x.dtypes == docs.dtypes for x in (kept, unique, clean, masked))
    key = lambda d: sorted(((r.doc_id, r.text) for r in d.collect()), key=repr)
    left = [r[:2] for r in rows if r[0] != 4]  # near to document 3, whose rows stay
    assert key(kept) == sorted((r[:2] for r in rows), key=repr) and key(unique) == sorted(left, key=repr)
    left = [(d, t and t.replace(passage, "")) for d, t in left]
    assert key(clean) == sorted(left, key=repr)
    left = [(d, t and t.replace("24be64439e3e49cf46b2d7c90f3602a3d0b907ff", "[SECRET]")) for d, t in left]
    assert key(masked) == sorted(left, key=repr)
    out = {(r.doc_id, r.n_tokens is None, r.exact) for r in ids.collect()}
    assert out == {(d, t is None, None if t is None else True) for d, t in left}
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(left)
