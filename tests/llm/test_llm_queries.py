import zlib

import duckdb
import numpy as np
import pytest
from sqlcheck import assert_same, duck
from test_models import brute_print
from test_text_ops import brute_tiling

from rungs.llm import langid, oracle, queries, tiling


@pytest.mark.parametrize("name", sorted(oracle.SQL))
def test_query_gives_what_its_sql_gives(spark, data, name):
    assert_same(queries.QUERIES[name](spark, data), duck(data), oracle.SQL[name])


def test_pipeline_stages(spark, data):
    pytest.importorskip("public_tokenizers")
    import corpus_pipeline

    docs = spark.read.parquet(f"{data}/documents.parquet")
    start, columns = docs.count(), docs.columns
    counts = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(stage(spark, docs, data), name)
        counts[name] = docs.count()
        if name != "tokens":
            assert docs.columns == columns
            if name != "mixture":
                assert docs.select("doc_id").distinct().count() == counts[name] <= start
        if name == "decontamination":
            # verbatim items are gone, and few others
            bench = spark.read.parquet(f"{data}/benchmark.parquet")
            assert docs.crossJoin(bench.selectExpr("text AS item")).where("contains(text, item)").count() == 0
    assert counts["language"] > 0.9 * start and counts["decontamination"] > 0.9 * counts["near_duplicates"]
    assert counts["tokens"] == counts["mixture"] > counts["decontamination"]
    assert [r.doc_id for r in docs.orderBy("start").select("doc_id").collect()] == sorted(r.doc_id for r in docs.select("doc_id").collect())


def brute_near(rows, words=5, bits=4, share=0.8):
    """The smallest doc_id of each group of texts that are linked by fingerprints or by their sets of shingles."""
    ids = [d for d, _ in rows]
    prints = [brute_print(t, words) for _, t in rows]
    split = [(t or "").lower().encode().split() for _, t in rows]
    sets = [{tuple(w[i : i + words]) for i in range(len(w) - words + 1)} for w in split]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if (prints[i] ^ prints[j]).bit_count() <= bits or both and both >= share * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        least[find(i)] = min(d, least.get(find(i), d))
    return set(least.values())


def test_pipeline_is_what_brute_force_gives(spark, data, tmp_path):
    """Every stage, on what the stage before has kept, against a version of it without Spark."""
    tokenizers = pytest.importorskip("tokenizers")
    pytest.importorskip("public_tokenizers")
    import corpus_pipeline

    docs = spark.read.parquet(f"{data}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
        docs.coalesce(1).write.parquet(str(tmp_path / name))
        got = corpus_pipeline.written(stage(spark, docs, data), name)
        kept = [r.doc_id for r in got.select("doc_id").collect()]
        if name == "language":
            model = langid.fit(langid.training_rows(docs))
            said = {d: model.predict(t) for d, t in before.items()}
            assert sorted(kept) == sorted(d for d, (lang, score) in said.items() if lang != "und" and score >= model.threshold)
        elif name == "near_duplicates":
            assert sorted(kept) == sorted(brute_near(sorted(before.items())))
        elif name == "decontamination":
            items = [tiling.plain(r.text).split() for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
            out = set()
            for d, t in before.items():
                words = tiling.plain(t).split()
                grams = {tuple(words[i : i + 5]) for i in range(len(words) - 4)}
                for own in items:
                    hits = sum(tuple(own[i : i + 5]) in grams for i in range(len(own) - 4))
                    if words == own if len(own) < 5 else 5 * hits >= 0.8 * len(own) and brute_tiling(own, words, 5) >= 0.8 * len(own):
                        out.add(d)
            assert sorted(kept) == sorted(set(before) - out)
        elif name == "mixture":
            c = duckdb.connect()
            c.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path / name}/*.parquet'")
            rows = c.execute(f"SELECT doc_id, CAST(taken / size AS BIGINT) FROM ({oracle.SQL['op2_mixing']}) WHERE taken > 0").fetchall()
            assert sorted(kept) == sorted(d for d, n in rows for _ in range(n))
        else:
            encode = tokenizers.Tokenizer.from_file(queries.tokenizer()).encode
            ids = {d: np.array([*encode(t, add_special_tokens=False).ids, 0], "<u4") for d, t in before.items()}
            order = sorted(r.doc_id for r in docs.select("doc_id").collect())
            starts = np.cumsum([0, *[len(ids[d]) for d in order]])
            want = [(d, int(a), len(ids[d]), zlib.crc32(ids[d].tobytes())) for d, a in zip(order, starts, strict=False)]
            assert sorted(tuple(r) for r in got.select("doc_id", "start", "n_tokens", "ids_crc32").collect()) == want
        docs = got
    assert len(kept) > 0


def test_run_gives_what_its_stages_give(spark, data, tmp_path):
    pytest.importorskip("public_tokenizers")
    import corpus_pipeline

    docs = spark.read.parquet(f"{data}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(stage(spark, docs, data), name)
    assert sorted(map(tuple, corpus_pipeline.run(spark, data).collect())) == sorted(map(tuple, docs.collect()))
