"""Curation, deduplication, retrieval, tokens, media and datasets on literal rows and by properties."""

import io
import json
import tarfile
import wave

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lakemill import streaming
from lakemill.functions import ai, kernels
from lakemill.functions import text as tx
from lakemill.operators import components, dedup, media, search, tokens, vectors
from lakemill.plans.catalog import Catalog, Flow, Metrics, dataset_lineage, pipeline_signature, read_lineage, write_lineage
from lakemill.sources.versioned import Dataset


def frame(spark, rows, schema="id bigint, text string"):
    return spark.createDataFrame(rows, schema)


def test_pii():
    t = "Ünïcode a.b@c.org, call (415) 555-2671 or 192.168.0.1; card 4111 1111 1111 1111, ssn 123-45-6789, see https://x.y/z. 12 and 999.1.1.1"
    out = kernels.redacted(t)
    for mark in ("[EMAIL]", "[PHONE]", "[IPV4]", "[CREDIT_CARD]", "[SSN]", "[URL]"):
        assert mark in out, mark
    assert out.endswith("12 and 999.1.1.1") and out.startswith("Ünïcode")


def test_chunks():
    assert tx.split_recursive("short", 10, 0, [" "]) == ["short"]
    parts = tx.split_recursive("aaa bbb. ccc ddd. eee", 9, 0, ["\n\n", ". ", " "])
    assert all(len(p) <= 9 for p in parts) and "".join(parts).replace(" ", "") == "aaabbbcccdddeee"
    assert tx.split_recursive("x" * 25, 10, 3, [" "])[1][:3] == "xxx"


def test_quality_rules_in_order(spark):
    df = frame(spark, [(1, "few words"), (2, " ".join(["the tiger and some elephants"] * 12)), (3, None), (4, " ".join(f"the word{i} of it" for i in range(30)))])
    out = {r.id: r.why for r in tx.quality_filter(df, reason_column="why").collect()}
    assert out[1] == "too_few_words:2<50" and out[3] == "too_few_words:0<50" and out[2].startswith("dup_ngram_ratio_high:") and out[4] is None
    assert [r.id for r in tx.quality_filter(df).collect()] == [4]
    with pytest.raises(ValueError):
        tx.quality_filter(df, no_such=1)


def test_top_word_of_texts_in_one_chunk():
    """A character in a text and another in another text once had the same key in the sort that counts words."""
    texts = [" ".join([chr(i + 76)] * 5 + [chr(i + 300)]) for i in range(400)]
    texts[49], texts[159] = "ê x", "| a | b | c | d"
    top = kernels.signals(pa.array(texts))["top_word_ratio"]
    assert top[159] == 4 / 8 and top[49] == 1 / 2


def test_round_as_sql(spark):
    import duckdb

    from lakemill.plans.curation import sql_round

    at = [(333 / 640,), (323 / 640,), (41 / 640,), (1 / 3,), (0.0,), (None,)]
    want = [duckdb.sql(f"SELECT round({x!r}::DOUBLE, 6)").fetchall()[0][0] if x is not None else None for (x,) in at]
    assert [r.x for r in frame(spark, at, "x double").coalesce(1).select(sql_round("x")).collect()] == want


def test_languages(spark):
    df = frame(spark, [(1, "the cat and the dog of it"), (2, "der Hund und die Katze ist nicht"), (3, "это русский текст"), (4, "中文文本"), (5, ""), (6, "le chat est dans une maison que les")])
    assert [r.lang for r in tx.detect_language(df).orderBy("id").collect()] == ["en", "de", "ru", "zh", "und", "fr"]


def test_entities_without_a_semicolon_stay(spark):
    pages = frame(spark, [(1, "<title>a&amp;b&amp</title>&eacute;&#233;&lt;x&quot</p>"), (2, "a<!-- <script> -->b<script>c</script>d")], "id bigint, html string")
    assert [r.text for r in tx.html_to_text(pages).orderBy("id").collect()] == ["a&b&amp éé<x&quot", "a b d"]


def test_blend_shares_and_rows(spark):
    """Halves go up as in SQL, and rows are those of the smallest hashes, without one task for all."""
    df = frame(spark, [(i, "x") for i in range(6)])
    mixed = tx.blend_datasets([df.where("id < 3"), df.where("id >= 3")], "id", [3, 1])
    got = [r.id for r in mixed.collect()]
    assert sum(i < 3 for i in got) == 5 and sum(i >= 3 for i in got) == 2 and max(map(got.count, got)) == 2
    many = spark.range(3000).withColumn("text", F.lit("x"))
    order = [r.id for r in many.orderBy(F.xxhash64("id", F.lit(0)), "id").collect()]
    for n in (1, 1500, 2999, 3000, 3001, 7000):
        part = tx.blend_datasets([many], "id", total_rows=n)
        assert [r.id for r in part.collect()] == (order * 3)[:n]
        assert n != 3000 or "GlobalLimit" not in part._jdf.queryExecution().toString()
    assert tx.blend_datasets([many], "id", total_rows=0).count() == 0


def test_kmeans_goes_on_until_means_stay(spark):
    """Two far points make the sum of squares so large that the moves of the other means don't show in it."""
    points = np.array([[1e12, 1e9], [1e12, -1e9], *([i / 100, 0.0] for i in range(100))])
    df = spark.createDataFrame([(p.tolist(),) for p in points], "embedding array<double>")
    for seed in range(40):
        first = [r[0][0] for r in df.orderBy(F.xxhash64("embedding", F.lit(seed)), "embedding").limit(3).collect()]
        if sum(x > 1e9 for x in first) == 1 and max(x for x in first if x < 1e9) < 0.3:
            break
    found = vectors.kmeans(df, k=3, max_iter=1000, tol=0.0, seed=seed)
    at = vectors.assign(points, found)
    assert all(np.allclose(points[at == c].mean(0), found[c], rtol=1e-12, atol=1e-12) for c in range(3))


def test_flat_shards_across_slices(spark, tmp_path, monkeypatch):
    """Slices end inside shards and shards inside slices; equal keys, null lists and empty ones come through whole, in order."""
    monkeypatch.setattr(tokens, "SLICE_TOKENS", 500)
    rows = [(i // 2, None if i == 7 else list(range(i, i + i % 23)), i) for i in range(300)]
    df = frame(spark, rows, "k bigint, input_ids array<int>, i bigint").repartition(5)
    want = sorted((k, x or []) for k, x, _ in rows)
    assert len(tokens.sliced(df, "k", "input_ids", 7)[1]) > 8
    for per in (7, 1000):
        at = str(tmp_path / f"t{per}")
        files = tokens.write_token_shards(df, at, "k", rows_per_shard=per)
        got = [d.tolist() for n, _, _ in files if n.endswith(".bin") for d in tokens.read_token_shard(f"{at}/{n}")]
        assert len(got) == 300 and [sorted(got[i : i + 2]) for i in range(0, 300, 2)] == [[x for _, x in want[i : i + 2]] for i in range(0, 300, 2)]
        assert sum(n.endswith(".bin") for n, _, _ in files) == -(-300 // per)
    files = tokens.write_shuffled_shards(df, str(tmp_path / "s"), "i", n_shards=3)
    got = [d.tolist() for n, _, _ in files if n.endswith(".bin") for d in tokens.read_token_shard(f"{tmp_path}/s/{n}")]
    assert got == [r.input_ids or [] for r in df.orderBy(F.xxhash64("i", F.lit(0))).collect()]


def test_split_lists():
    b = pa.RecordBatch.from_pydict({"ids": pa.array([[1] * 40, None, [], [2] * 70, [3] * 5], pa.list_(pa.int32()))})
    parts = list(tokens.split_lists(b, "ids", 50))
    assert len(parts) > 1 and pa.Table.from_batches(parts)["ids"].to_pylist() == b.column("ids").to_pylist()


def test_results_leave_slice_by_slice(monkeypatch):
    """The first slice's result is there before the second slice is read."""
    monkeypatch.setattr(tx.F, "arrow_udf", lambda run, kind: lambda x: run)
    sizes = []
    run = tx.by_arrow(lambda x: sizes.append(len(x)) or x, "string", None)
    batch = pa.array(["a b c. " * 20000] * 40)
    out = run(iter([batch, batch[:0]]))
    assert len(next(out)) == sizes[0] < 40 and len(sizes) == 1
    assert sum(map(len, out)) == 40 - sizes[0]


def test_lines_and_encodings(spark):
    df = frame(spark, [(1, "Shared line.\nown one here."), (2, "shared  LINE.\n\nother text."), (3, None)])
    assert [r.text for r in dedup.corpus_line_dedup(df, "id").orderBy("id").collect()] == ["own one here.", "\nother text.", None]
    assert tx.repair("cafÃ©") == "café" and tx.repair("café") == "café"
    c4 = tx.c4_line_filter(frame(spark, [(1, "A good line here.\nno end\nAccept the cookie now."), (2, "bad")]))
    assert [r.text for r in c4.orderBy("id").collect()] == ["A good line here.", ""]


def test_exact_and_incremental(spark, tmp_path):
    a = frame(spark, [(1, "A b"), (2, "a  B "), (3, None), (4, "c")])
    assert sorted(r.id for r in dedup.exact_dedup(a, "id").collect()) == [1, 4]
    p = str(tmp_path / "index")
    assert sorted(r.id for r in dedup.incremental_dedup(a, p, "id").collect()) == [1, 4]
    assert [r.id for r in dedup.incremental_dedup(frame(spark, [(9, "C"), (10, "new")]), p, "id").collect()] == [10]
    assert dedup.HashIndex(spark, p).contains(frame(spark, [(1, "c"), (2, "zz")])).orderBy("id").collect()[0].known


def test_fuzzy(spark):
    base = " ".join(f"w{i}" for i in range(120))
    near = base.replace("w60 ", "other ")
    df = frame(spark, [(1, base), (2, near), (3, " ".join(f"z{i}" for i in range(100))), (4, base), (5, None), (6, "")])
    out = {r.id: r.cluster_id for r in dedup.fuzzy_dedup(df, "id", keep_cluster=True).collect()}
    assert out == {1: 1, 2: 1, 4: 1, 3: 3, 5: 5, 6: 6}
    once = dedup.fuzzy_dedup(df, "id")
    assert dedup.fuzzy_dedup(once, "id").count() == once.count() == 4
    assert dedup.optimal_lsh_bands(0.7, 128)[0] * dedup.optimal_lsh_bands(0.7, 128)[1] <= 128


def test_minhash_against_big_integers():
    texts = [" ".join(f"w{i} Ü{i * i}" for i in range(700)), "a", "x" * 3000 + "  y\nz", "", None]
    a, b = dedup._coefficients(128, 1)

    def fnv(s):
        h = 0xCBF29CE484222325
        for c in s.encode():
            h = ((h ^ c) * 0x100000001B3) % 2**64
        return h

    h, first = kernels.gram_sets(pa.array(texts), 2)
    got = dedup.signatures(h, first, 128, 1).tolist()
    for t, sig in zip(texts, got, strict=True):
        w = (t or "").lower().split()
        x = {fnv(" ".join(w[i : i + 2])) for i in range(max(len(w) - 1, 1))} if w else set()
        assert sig == ([min((i * (y % dedup.PRIME) + j) % dedup.PRIME for y in x) for i, j in zip(a.tolist(), b.tolist(), strict=True)] if x else [0] * 128)


def test_signals_by_hand():
    from collections import Counter

    texts = ["", "   ", "The cat sat. The cat sat on # 12 mats!!\n# title\n\n  # title \nend", "ein Übermaß an Ähnlichkeit… ½ Ⅷ 日本 \u00a0x", "a b c a b c a b c\n", "\n\n", "x\r\ny\r\nx", "İstanbul ΣΑΣ the THE"] + ["word " * 300]
    got = kernels.signals(pa.array(texts))
    for i, t in enumerate(texts):
        w, lines = t.split(), [x.strip() for x in t.split("\n")]
        lines = lines[:-1] if t.endswith("\n") or not t else lines
        grams = [tuple(w[j : j + 3]) for j in range(len(w) - 2)]
        alpha = lambda c: kernels.regex.fullmatch(r"\p{Alphabetic}", c) is not None
        n = max(len(t), 1)
        want = {
            "char_count": len(t), "word_count": len(w), "mean_word_len": sum(map(len, w)) / max(len(w), 1), "alpha_ratio": sum(map(alpha, t)) / n, "digit_ratio": sum(c in "0123456789" for c in t) / n,
            "symbol_ratio": sum(not alpha(c) and c not in "0123456789" and not c.isspace() for c in t) / n, "alpha_word_ratio": sum(any(map(alpha, x)) for x in w) / max(len(w), 1),
            "dup_line_ratio": (len(lines) - len(set(lines))) / max(len(lines), 1), "hash_line_ratio": sum(x.startswith("#") for x in lines) / max(len(lines), 1), "top_word_ratio": max(Counter(w).values(), default=0) / max(len(w), 1),
            "stopword_ratio": sum(x.lower() in kernels.STOPWORDS for x in w) / max(len(w), 1), "dup_ngram_ratio": (len(grams) - len(set(grams))) / max(len(grams), 1),
        }
        assert {k: pytest.approx(v) for k, v in want.items()} == {k: v[i] for k, v in got.items()}, t


def test_languages_by_hand():
    texts = ["", "12 !?", "the cat and the dog", "der Hund ist nicht da", "это русский", "中文 ab", "Ελληνικά", "हिन्दी भाषा", "il gatto", "no votes here", "ひらがな", "한국어", "العربية"]
    lang, conf = kernels.languages(pa.array(texts))
    assert lang.to_pylist() == ["und", "und", "en", "de", "ru", "zh", "el", "hi", "it", "en", "ja", "ko", "ar"] and conf[0] == 0 and conf[5] == 0.5


def test_a_crowded_band(spark):
    """Thousands of different texts that agree in every band: pairs stay in proportion, all land in one cluster."""
    base = " ".join(f"w{i}" for i in range(400))
    df = spark.range(3000).selectExpr("id", f"concat('{base} x', id, ' y', id) AS text").repartition(4)
    pairs = dedup.fuzzy_pairs(df, "id")
    assert pairs.count() < 3000 * 200
    assert dedup.fuzzy_dedup(df, "id").count() == 1


def test_substrings_by_hand(spark):
    r = np.random.default_rng(2)
    vocabulary = [f"v{i}" for i in range(50)]
    rows, passage = [], list(r.choice(vocabulary, 40))
    for d in range(60):
        w = list(r.choice(vocabulary, int(r.integers(0, 90))))
        if d % 3 == 0:
            at = int(r.integers(0, len(w) + 1))
            w[at:at] = passage[: int(r.integers(5, 40))]
        rows.append((d, " ".join(w)))
    rows += [(100, "tic tac " * 40), (101, "a " * 60), (102, None), (103, ""), (104, rows[0][1]), (105, "  spaced   out  words ")]
    for k in (1, 2, 5, 12):
        seen, want = set(), {}
        for d, t in rows:
            w = (t or "").split()
            drop = [False] * len(w)
            for i in range(len(w) - k + 1):
                g = tuple(w[i : i + k])
                if g in seen:
                    drop[i : i + k] = [True] * k
                seen.add(g)
            want[d] = " ".join(x for x, y in zip(w, drop, strict=True) if not y) if any(drop) else t
        assert {x.id: x.text for x in dedup.substring_dedup(frame(spark, rows).repartition(3), "id", k=k).collect()} == want, k


def test_fuzzy_recall_and_false_links(spark):
    # two texts of a pair share a stretch of words of their own, so that the similarity is known
    r = np.random.default_rng(5)
    rows, want, pairs = [], set(), 40
    for k, share in enumerate(np.repeat([0.4, 0.5, 0.6, 0.72, 0.75, 0.8, 0.85, 0.9], pairs)):
        n = 200
        common = int(round(n * 2 * share / (1 + share)))
        word = lambda: str(r.integers(1 << 60))
        shared = [word() for _ in range(common)]
        one, two = (shared + [word() for _ in range(n - common)] for _ in range(2))
        rows += [(2 * k, " ".join(one)), (2 * k + 1, " ".join(two))]
        x, y = ({" ".join(w[i : i + 2]) for i in range(n - 1)} for w in (one, two))
        if len(x & y) / len(x | y) >= 0.7:
            want.add((2 * k, 2 * k + 1))
    got = {(p.a, p.b) for p in dedup.fuzzy_pairs(frame(spark, rows), "id").collect()}
    assert got <= want and len(got) >= 0.9 * len(want) and len(want) == 5 * pairs
    b, n = dedup.recall_lsh_bands(0.7, 128)
    assert b * n <= 128 and 1 - (1 - 0.7**n) ** b >= 0.9


def test_components_against_union_find(spark):
    r = np.random.default_rng(0)
    edges = [(int(a), int(b)) for a, b in r.integers(0, 150, (110, 2))]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    got = {x.node: x.component for x in components.connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {x: find(x) for x in parent}


def test_components_of_whole_lineitem_against_union_find(spark, sf, tmp_path):
    from lakemill.plans import curation

    def union_find(edges):
        parent = {x: x for e in edges for x in e}

        def find(x):
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for a, b in edges:
            a, b = sorted((find(a), find(b)))
            parent[b] = a
        return {x: find(x) for x in parent}

    # a chain of 600 orders, a hub of 900 parts, pairs that stay apart, and ids beyond any modulus
    made = [(k // 2 + k % 2, 10_000 + k // 2) for k in range(1200)] + [(5000, 20_000 + k) for k in range(900)] + [(10**9 + k, 10**10 + k) for k in range(50)]
    small = str(tmp_path)
    spark.createDataFrame(made, "l_orderkey bigint, l_partkey bigint").write.parquet(f"{small}/lineitem.parquet")
    for d in (small, sf):
        edges = [(2 * x.l_orderkey, 2 * x.l_partkey + 1) for x in spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_partkey").collect()]
        want = union_find(edges)
        assert {x.node: x.component for x in curation.connected_components(spark, d).collect()} == want
        assert d == sf or len(set(want.values())) == 52


def test_rows_of_a_hub_spread(spark):
    # 4,000 links of one node and 400 of others
    links = spark.range(4400).selectExpr("if(id < 4000, 50, 1000 + id % 100) AS hi", "if(id < 4000, 100 + id, 20000 + id) AS lo")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = components.star(links, 1000)
        sizes = [len(p) for p in found.rdd.glom().collect()]
        got = {(r.hi, r.lo): r.to for r in found.collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == {(r.hi, r.lo): r.hi for r in links.collect()} and len(got) == 4400
    assert max(sizes) < 1500  # of four partitions


def test_substrings(spark):
    passage = " ".join(f"p{i}" for i in range(12))
    df = frame(spark, [(1, "one " + passage + " end"), (2, "two " + passage + " fin"), (3, "short"), (4, None)])
    out = {r.id: r.text for r in dedup.substring_dedup(df, "id", k=10).collect()}
    assert out == {1: "one " + passage + " end", 2: "two fin", 3: "short", 4: None}


def test_semantic_is_greedy(spark):
    v = lambda a: [float(np.cos(a)), float(np.sin(a))]
    df = spark.createDataFrame([(1, v(0.0)), (2, v(0.35)), (3, v(0.7)), (4, [0.0, 0.0]), (5, None)], "id bigint, embedding array<double>")
    out = {r.id: r.semantic_cluster for r in vectors.semantic_dedup(df, "id", threshold=0.9, keep_cluster=True).collect()}
    assert out == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5}
    linked = {r.node: r.component for r in vectors.semantic_clusters(df, "id", threshold=0.9).collect()}
    assert linked == {1: 1, 2: 1, 3: 1, 4: 4}


def test_semantic_greedy_by_chunks(spark, monkeypatch):
    for name, value in (("CHUNK", 64), ("PIECE", 32), ("STEP", 16)):
        monkeypatch.setattr(vectors, name, value, raising=False)
    r = np.random.default_rng(5)
    x = r.normal(size=(40, 4))[r.integers(0, 40, 400)] + r.normal(size=(400, 4)) * 0.3
    x[17], x[200] = 0, np.nan
    ids = [f"k{i:04d}" for i in r.permutation(400)]
    df = spark.createDataFrame([(k, v.tolist()) for k, v in zip(ids, x)] + [("k9", None)], "id string, embedding array<double>")
    unit = x / np.where((n := np.linalg.norm(x, axis=1, keepdims=True)) > 0, n, 1)
    kept, want = [], {"k9": "k9"}
    for i in sorted(range(400), key=ids.__getitem__):
        s = unit[kept] @ unit[i] if len(kept) and i not in (17, 200) else np.zeros(0)
        near = int(s.argmax()) if len(s) and s.max() >= 0.9 else None
        want[ids[i]] = ids[i] if near is None else ids[kept[near]]
        if near is None and i not in (17, 200):
            kept.append(i)
    found = vectors.semantic_dedup(df, "id", threshold=0.9, keep_cluster=True)
    assert {r.id: r.semantic_cluster for r in found.collect()} == want and len(set(want.values())) < 350
    assert "FlatMapGroupsInArrow" not in found._jdf.queryExecution().toString()  # no task holds all vectors
    assert {r.id for r in vectors.semantic_dedup(df, "id", threshold=0.9).collect()} == set(want.values())


def test_semantic_greedy_large_groups_by_chunks(spark, monkeypatch):
    for name, value in (("CHUNK", 64), ("PIECE", 32), ("STEP", 16), ("GROUP", 100)):
        monkeypatch.setattr(vectors, name, value, raising=False)
    real = vectors._greedy

    def small(*given):
        inner = real(*given)

        def run(table):
            assert len(table) <= 100, "one task holds a large group"
            return inner(table)

        return run

    monkeypatch.setattr(vectors, "_greedy", small)
    r = np.random.default_rng(8)
    x = r.normal(size=(30, 4))[r.integers(0, 30, 500)] + r.normal(size=(500, 4)) * 0.3
    x[17], x[200] = 0, np.nan
    groups = [("a", "b", None, "d")[i] for i in r.choice(4, 500, p=[0.4, 0.3, 0.25, 0.05])]
    assert sorted(map(groups.count, ("a", "b", None, "d")))[1] > 100
    ids = r.permutation(500)
    df = spark.createDataFrame([(int(k), v.tolist(), g) for k, v, g in zip(ids, x, groups)] + [(900, None, "a")], "id bigint, embedding array<double>, g string")
    unit = x / np.where((n := np.linalg.norm(x, axis=1, keepdims=True)) > 0, n, 1)
    kept, want = {g: [] for g in groups}, {900: 900}
    for i in np.argsort(ids):
        own = kept[groups[i]]
        s = unit[own] @ unit[i] if own and i not in (17, 200) else np.zeros(0)
        near = int(s.argmax()) if len(s) and s.max() >= 0.9 else None
        want[int(ids[i])] = int(ids[i] if near is None else ids[own[near]])
        if near is None and i not in (17, 200):
            own.append(i)
    found = vectors.semantic_dedup(df, "id", threshold=0.9, keep_cluster=True, cluster_column="g").collect()
    assert {r.id: r.semantic_cluster for r in found} == want and len(found) == 501 and len(set(want.values())) < 450


def test_semantic_clusters_by_chunks(spark, monkeypatch):
    for name, value in (("CHUNK", 64), ("PIECE", 32), ("STEP", 16)):
        monkeypatch.setattr(vectors, name, value, raising=False)
    r = np.random.default_rng(6)
    x = r.normal(size=(60, 6))[r.integers(0, 60, 400)] + r.normal(size=(400, 6)) * 0.25
    x[100:200] = x[100] + r.normal(size=(100, 6)) * 1e-3  # a dense class: 4,950 pairs
    x[7] = 0
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(999, None)], "id bigint, embedding array<double>")
    unit = x / np.where((n := np.linalg.norm(x, axis=1, keepdims=True)) > 0, n, 1)
    want = np.arange(400)
    near = (unit @ unit.T >= 0.95) | np.eye(400, dtype=bool)
    while True:
        again = np.where(near, want[None], 400).min(1)
        if (again == want).all():
            break
        want = again
    seen = []
    whole = vectors.connected_components
    monkeypatch.setattr(vectors, "connected_components", lambda e: seen.append(e.count()) or whole(e))
    assert {q.node: q.component for q in vectors.semantic_clusters(df, "id", threshold=0.95).collect()} == dict(enumerate(want.tolist()))
    assert len(set(want.tolist())) < 300 and seen[0] < 3000  # not a link per pair


def test_vector_index_recall(spark, sf, tmp_path):
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    s = vectors.VectorSearch(e, "embedding", "vec_id").build_index(str(tmp_path / "ivf"), 8)
    q = [float(x) for x in e.first().embedding]
    assert s.recall_vs_exact(q, 10, nprobes=8) == 1.0 and s.recall_vs_exact(q, 10, nprobes=4) >= 0.5
    plan = s.index.search(q, 5, nprobes=2)._jdf.queryExecution().executedPlan().toString()
    assert "cluster" in plan and "PartitionFilters" in plan
    batch = s.search_batch({7: q}, 5).orderBy("rank").collect()
    assert [r.vec_id for r in batch] == [r.vec_id for r in vectors.knn(e, "embedding", q, 5, "cosine", "vec_id").collect()]


def test_text_index_equals_scan(spark, sf, tmp_path):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    index = search.TextIndex.build(d, str(tmp_path / "fts"), "doc_id", buckets=8)
    a = [(r.id, round(r.score, 9)) for r in index.search("stupid license the", 10).collect()]
    b = [(r.doc_id, round(r.score, 9)) for r in search.full_text_search(d, "stupid license the", "doc_id", k=10).collect()]
    assert a == b and a
    assert search.bm25(d, "  ", "doc_id").count() == 0


def test_postings_are_counted_where_they_are_read(spark, monkeypatch):
    monkeypatch.setattr(search, "TOKENS", 4, raising=False)
    df = frame(spark, [(1, "b a b, c"), (2, None), (3, ""), (4, "A a a a a a"), (5, "c"), (6, "d")])
    out = search.postings(df, "id")
    assert sorted(tuple(r) for r in out.select("term", "id", "tf", "length").collect()) == [("a", 1, 1, 4), ("a", 4, 6, 6), ("b", 1, 2, 4), ("c", 1, 1, 4), ("c", 5, 1, 1), ("d", 6, 1, 1)]
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()


def test_packing(spark, tmp_path):
    df = frame(spark, [(1, "aaaa"), (2, "bb"), (3, "cccccc"), (4, None)])
    t = tokens.tokenize(df.where("id < 4"))
    assert t.agg(F.sum("n_tokens")).first()[0] == 15
    flat = [97] * 4 + [256] + [98] * 2 + [256] + [99] * 6 + [256]
    p = tokens.pack_sequences(t, "id", seq_len=4, drop_remainder=False, pad_id=-9).orderBy("seq").collect()
    assert sum((r.input_ids for r in p), []) == flat + [-9] and p[-1].doc_ids[-1] == -1 and p[1].doc_ids == [0, 1, 1, 1]
    assert tokens.pack_sequences(t, "id", seq_len=4).count() == 3
    files = tokens.write_token_shards(t, str(tmp_path / "bin"), "id", rows_per_shard=2)
    assert [f[0] for f in files if f[0].endswith(".bin")] == ["tokens-00000.bin", "tokens-00001.bin"]
    back = [x.tolist() for i in range(2) for x in tokens.read_token_shard(str(tmp_path / f"bin/tokens-{i:05d}.bin"))]
    assert sum(back, []) == flat and len(back) == 3
    tokens.write_webdataset(df.where("id < 4"), str(tmp_path / "wds"), "id", 2, text_columns=["text"])
    with tarfile.open(tmp_path / "wds/shard-00000.tar") as tar:
        assert tar.getnames() == ["1.txt", "1.json", "2.txt", "2.json"]
    assert tokens.write_mds(df, str(tmp_path / "mds"), "id", 3)["rows"] == 4 and json.loads((tmp_path / "mds/index.json").read_text())["shards"][1]["rows"] == 1
    assert sum(r for n, r, _ in tokens.write_shuffled_shards(t, str(tmp_path / "sh"), "id", n_shards=2) if n.endswith(".bin")) == 3


def test_media(spark):
    r = np.random.default_rng(0)
    img = r.integers(0, 256, (20, 30, 3)).astype(np.uint8)
    assert (media.decode_image(media.encode_png(img)) == img).all()
    smooth = media.resize(r.integers(20, 230, (9, 9, 3)).astype(np.uint8), 60, 60)
    brighter = np.clip(smooth.astype(int) + 3, 0, 255).astype(np.uint8)
    df = spark.createDataFrame([(1, media.encode_png(smooth)), (2, media.encode_png(brighter)), (3, media.encode_png(img)), (4, None)], "id bigint, image binary")
    out = {x.id: x.cluster_id for x in media.image_dedup(df, "id", keep_cluster=True).collect()}
    assert out[1] == out[2] == 1 and out[3] == 3 and out[4] == 4
    assert [x.id for x in media.image_quality_filter(df, min_width=35).orderBy("id").collect()] == [1, 2]
    t = media.decode_images(df, size=(4, 5)).where("id = 3").first().tensor
    assert (t.height, t.width, len(t.data)) == (5, 4, 60)
    assert media.to_mode(img, "L").shape == (20, 30, 1) and media.to_mode(img, "RGBA").shape[2] == 4
    sink = io.BytesIO()
    with wave.open(sink, "wb") as w:
        w.setnchannels(2)
        w.setsampwidth(2)
        w.setframerate(8000)
        w.writeframes(np.array([[16384, 0]] * 100, "<i2").tobytes())
    a = media.decode_wav(sink.getvalue(), True, 4000)
    assert a["num_frames"] == 50 and a["num_channels"] == 1 and abs(a["samples"][3] - 0.25) < 1e-9
    h = spark.createDataFrame([("ffffffffffffffff", "0000000000000001")], "a string, b string")
    assert h.select(media.hamming_hex(F.col("a"), F.col("b"))).first()[0] == 63


def test_versions(spark, tmp_path):
    d = Dataset(spark, str(tmp_path / "ds"))
    assert d.write(spark.range(3).selectExpr("id", "'a' AS v")) == 1
    d.write(spark.range(3, 5).selectExpr("id", "'b' AS v"), "append")
    d.create_tag("two")
    d.delete("id = 1")
    d.merge_insert(spark.createDataFrame([(0, "new"), (9, "add")], "id bigint, v string"), ["id"])
    assert sorted(r.id for r in d.read().collect()) == [0, 2, 3, 4, 9] and d.read(where="id = 0").first().v == "new"
    assert d.read("two").count() == 5 and d.read(1).count() == 3 and len(d.versions()) == 4
    b = d.create_branch("dev", "two")
    b.delete("true")
    assert b.read().count() == 0 and d.read().count() == 5 and d.branches() == ["dev", "main"]
    assert d.shallow_clone(str(tmp_path / "clone"), 1).read().count() == 3
    d.add_columns({"w": "id * 2"})
    assert d.read(columns=["w"]).agg(F.sum("w")).first()[0] == 36
    assert d.restore(1) == 6 and d.read().count() == 3
    with pytest.raises(FileExistsError):
        d.write(spark.range(1))
    assert d.cleanup_old_versions() >= 1 and d.read("two").count() == 5


def test_catalog_lineage_metrics(spark, tmp_path):
    spark.range(4).withColumn("x", F.when(F.col("id") > 1, 1)).write.parquet(str(tmp_path / "data/p"))
    c = Catalog(spark, str(tmp_path / "cat.json"))
    assert c.discover(str(tmp_path / "data")) == ["p"] and c.stats("p") == {"rows": 4, "nulls": {"id": 0, "x": 2}}
    assert Catalog(spark, str(tmp_path / "cat.json")).describe("p")["columns"] == {"id": "bigint", "x": "int"} and c.validate() == {}
    assert c.information_schema().count() == 2
    assert pipeline_signature({"a": 1, "b": 2}) == pipeline_signature({"b": 2, "a": 1})
    write_lineage(str(tmp_path / "out"), dataset_lineage({"a": 1}, ["p"]))
    assert read_lineage(str(tmp_path / "out"))["inputs"] == ["p"] and read_lineage(str(tmp_path / "none")) is None
    m = Metrics(str(tmp_path / "audit"))
    with m.query("q"):
        pass
    with pytest.raises(ZeroDivisionError), m.query("bad"):
        1 / 0  # noqa: B018
    m.curate("f", 10, 4)
    s = m.summary()
    assert (s["queries"], s["errors"], s["keep_rate"]) == (2, 1, 0.4) and "lakemill_errors 1" in m.prometheus_text() and len(m.audit_list(status="error")) == 1
    f = Flow(frame(spark, [(1, "a"), (2, "a"), (3, "b")])).step("dedup", dedup.exact_dedup, "id").step("two", lambda d: d.where("id > 1"))
    f.df.collect()
    assert f.funnel() == [("input", 3), ("dedup", 2), ("two", 1)]


def test_models(spark):
    df = frame(spark, [(1, "good"), (2, "bad thing"), (3, None)])
    scored = {r.id: r.s for r in tx.model_score(df, lambda ts: [float(len(t)) for t in ts], out_column="s").collect()}
    assert scored == {1: 4.0, 2: 9.0, 3: 0.0}
    assert [r.id for r in tx.model_filter(df, lambda ts: [float(len(t)) for t in ts], threshold=5).collect()] == [2]
    out = ai.classify_text(df, "text", ["x", "y"], lambda ts: ["x" if "good" in t else "?" for t in ts]).orderBy("id").collect()
    assert [r.label for r in out] == ["x", None, None]
    calls = []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise OSError
        return 7

    waits = []
    assert ai.retry(flaky, 3, sleep=waits.append) == 7 and waits == [1, 2]
    got = tx.extract(df, "text", "n int", lambda ts: ['{"n": 3}' if t else "none" for t in ts]).orderBy("id").collect()
    assert got[0].n == 3 and got[0]._extract_error is None and got[2]._extract_error


def test_blends(spark):
    a, b = spark.range(100).withColumn("text", F.lit("aaaa")), spark.range(10).withColumn("text", F.lit("bb"))
    mix = tx.blend_datasets([a, b], "id", [1, 1], 60)
    counts = {r["text"]: r["count"] for r in mix.groupBy("text").count().collect()}
    assert counts == {"aaaa": 30, "bb": 30}
    by = tx.blend_by_tokens({"a": a, "b": b}, "id", total_tokens=80)
    assert {r["_source"]: r["count"] for r in by.groupBy("_source").count().collect()} == {"a": 10, "b": 20}


def test_blend_query_takes_all_rows(spark, tmp_path):
    from lakemill.plans import curation

    rows = [(i, "t", "en") for i in range(900)] + [(1000 + i, "t", None if i % 2 else "de") for i in range(100)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = [(r.lang, r.doc_id) for r in curation.blend_whole(spark, str(tmp_path)).collect()]
    assert len(got) == len(set(got)) == 1000 and any(lang is None for lang, _ in got)
    shares = {r.english: (r.rows, r.documents, r.most) for r in curation.blend_datasets(spark, str(tmp_path)).collect()}
    assert shares == {True: (750, 750, 1), False: (250, 100, 3)}


def test_streams(spark, sf, tmp_path):
    e = spark.read.parquet(f"{sf}/events.parquet")
    src = str(tmp_path / "src")
    e.repartition(2).write.parquet(src)
    ddl = ", ".join(f"{n} {t}" for n, t in e.dtypes)
    s = streaming.read_stream(spark, src, ddl, files_per_trigger=1)
    q = streaming.running_counts(s, "user_id").writeStream.format("memory").queryName("counts").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r.user_id: r.n for r in spark.sql("SELECT user_id, max(n) AS n FROM counts GROUP BY user_id").collect()}
    assert got == {r.user_id: r["count"] for r in e.groupBy("user_id").count().collect()}
    seen = []
    streaming.each_batch(s, lambda d, i: seen.append(d.count()), str(tmp_path / "cp")).awaitTermination()
    assert sum(seen) == e.count()
    w = streaming.windowed_counts(s, "ts", ["event_type"], "1 hour")
    streaming.write_stream(w, str(tmp_path / "out"), str(tmp_path / "cp2")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() >= 0
