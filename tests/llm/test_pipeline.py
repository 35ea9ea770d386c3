"""The pipeline's stages, one after the other."""

import corpus_pipeline
import test_decontaminate
import test_neardup
from pyspark.sql import functions as F

from markerlake.llm import bpe, common, decontaminate, pii, toxicity
from test_tokens import bpe_brute, order


def test_stages_take_effect(spark, middle):
    docs = spark.read.parquet(f"{middle}/documents.parquet")
    columns, kept = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, middle).cache()
        assert kept.columns == columns, name
    rows = [(r["doc_id"], r["text"]) for r in kept.collect()]
    assert 0.5 * docs.count() < len(rows) < docs.count()
    final = [tuple(r) for r in corpus_pipeline.run(spark, middle).collect()]
    assert order(final) == order(bpe_brute(rows))


def test_stages_equal_brute_force(spark, middle):
    """Each stage, on what the one before kept, against its operator's brute force."""
    columns = spark.read.parquet(f"{middle}/documents.parquet").columns
    before = [tuple(r) for r in spark.read.parquet(f"{middle}/documents.parquet").collect()]
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert columns == frame(before).columns
    stages = dict(corpus_pipeline.STAGES)

    def run(name):
        return [tuple(r) for r in stages[name](spark, frame(before), middle).collect()]

    docs, labels = frame(before), spark.read.parquet(f"{middle}/labels.parquet")
    models = toxicity.train(docs, labels)
    scores = models.score(toxicity.Reader(models).features([r[1] or "" for r in before]))
    after = run("toxicity")
    assert sorted(after) == sorted(r for r, x in zip(before, scores) if x < 0.3) and len(after) < len(before)
    before = after
    first = {i for i, _, _, kept in test_neardup.brute([r[:2] for r in before]) if kept}
    after = run("near_duplicates")
    assert sorted(after) == sorted(r for r in before if r[0] in first) and len(after) < len(before)
    before = after
    items = [(r["item_id"], decontaminate.plain_words(r["text"])) for r in spark.read.parquet(f"{middle}/benchmark.parquet").orderBy("item_id").collect()]
    held = {d for d, _ in test_decontaminate.brute([(r[0], decontaminate.plain_words(r[1] or "")) for r in before], items)}
    after = run("benchmark")
    assert sorted(after) == sorted(r for r in before if r[0] not in held) and len(after) < len(before)
    before = after
    spans = {r["doc_id"]: r["spans"] for r in pii.find(frame(before)).collect()}  # its base against plain patterns: test_pii

    def redacted(text, found):
        out, at = "", 0
        for s, e, k in sorted((int(s), int(e), k) for k, s, e in (x.split(":") for x in found.split(",") if x)):
            if s >= at:
                out += text[at:s] + f"[{k.upper()}]"
            at = max(at, e)
        return out + text[at:]

    want = [(i, t if t is None else redacted(t, spans[i]), *r) for i, t, *r in before]
    after = run("personal_data")
    assert sorted(r[:4] for r in after) == sorted(r[:4] for r in want) and sum(a[1] != b[1] for a, b in zip(sorted(after), sorted(before))) > 5
    assert all(r[4] == len(r[1]) for r in after)
    before = after
    assert order(run("encoding")) == order(bpe_brute([r[:2] for r in before]))


def test_odd_rows_and_clashing_columns(spark, odd, small):
    """Columns that have the names of the stages' own go through them as they came."""
    clash = ("n", "score", "key", "component_id", "kept", "spans", "_keep_0", "_text", "copy", "bands", "n_shingles", "item_id", "predicted", "h", "words")
    kept = odd
    for name in clash:
        kept = kept.withColumn(name, F.lit(f"own {name}"))
    columns = kept.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, small)
        assert kept.columns == columns
    rows = kept.collect()
    assert {r["doc_id"] for r in rows} >= {1, 2, 3, 4, 6, 10} and all(r[c] == f"own {c}" for r in rows for c in clash)
    assert {r["doc_id"] for r in corpus_pipeline.encode(spark, kept, small).collect()} == {r["doc_id"] for r in rows}


def test_empty_tables(spark, empty, small):
    kept = empty
    for _, stage in corpus_pipeline.STAGES:
        kept = stage(spark, kept, small)
    assert kept.count() == 0


def test_a_task_has_one_python_worker(spark, middle, monkeypatch):
    """Between two Python steps of a stage lies an exchange or a table: workers of one task wait side by side in an executor."""
    counts, own = [], common.arrow_map

    def counted(df, work, schema):
        out = own(df, work, schema)
        counts.append(out._jdf.queryExecution().executedPlan().toString().count("MapInArrow"))
        return out

    for module in (bpe, decontaminate, toxicity):
        monkeypatch.setattr(module, "arrow_map", counted)
    for name in ("toxicity", "benchmark", "encoding"):
        dict(corpus_pipeline.STAGES)[name](spark, spark.read.parquet(f"{middle}/documents.parquet"), middle)
    assert len(counts) >= 6 and set(counts) == {1}
