import collections

import corpus_pipeline
from marlstone.llm import quality, secret_scan
from tests.llm import data


def test_stages_on_awkward_documents(spark, tmp_path):
    folder = f"file://{tmp_path}"
    docs = data.documents(spark)
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    now = spark.read.parquet(f"{folder}/documents.parquet")
    seen = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, now, folder)
        assert out.columns == docs.columns
        out.write.parquet(f"{folder}/{name}")
        now = spark.read.parquet(f"{folder}/{name}")
        seen.append(now.count())
    assert seen[0] == docs.count() and seen[1] < seen[0] and seen[2] == seen[1]
    assert corpus_pipeline.run(spark, folder).count() >= seen[1] // 2


def test_pipeline_on_the_given_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = corpus_pipeline.run(spark, sf).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    kept = {r.doc_id for r in rows}
    by_text = collections.defaultdict(list)
    for d, t in docs.items():
        by_text[t].append(d)
    assert all(len(kept & set(g)) <= 1 for g in by_text.values())
    m = quality.train(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    assert all(m.tails(quality.features(docs[d].encode()))[-1] >= quality.KEEP_AT for d in kept)
    used = collections.Counter()
    for r in rows:
        used[r.sequence_id] += r.length
    assert max(used.values()) <= 2048 and len(used) <= sum(used.values()) / 2048 * 1.02 + 1
    masked = [secret_scan.redact(docs[d]) for d in kept]
    assert all(not secret_scan.scan(t)[0] for t in masked)
