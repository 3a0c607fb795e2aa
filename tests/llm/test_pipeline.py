from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from tessera.llm import toxicity

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_clean_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, SF).cache()
        assert after.columns == docs.columns and 100 < after.count() <= before.count(), name
        before = after
    assert corpus_pipeline.STAGES[-1][1](spark, before, SF).count() == before.count()


def test_registered():
    names = set(__spark_entry__.queries())
    assert {n.split("_")[0] for n in names if n.startswith("op")} >= {f"op{i}" for i in range(1, 11)} and "pipeline" in names


def test_null_and_repeated_ids(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    say = lambda word: " ".join(f"{word}{i}" for i in range(40))
    frame = lambda rows: spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], docs.schema).repartition(3)
    kept = lambda stage, rows: sorted(((r.doc_id, r.text) for r in stage(spark, frame(rows), SF).collect()), key=str)
    near = [(None, say("a")), (None, say("b")), (5, say("c")), (5, say("c")), (None, say("c") + " more"), (6, say("d")), (6, say("e")), (None, say("f")), (None, say("f"))]
    assert kept(corpus_pipeline.drop_near_duplicates, near) == sorted([near[0], near[1], near[2], near[5], near[6], near[7]], key=str)

    leak = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy(F.desc(F.length("text"))).first().text
    leaks = [(None, leak), (7, leak), (7, say("g")), (None, say("h")), (7, say("i"))]
    assert kept(corpus_pipeline.drop_contaminated, leaks) == sorted([leaks[2], leaks[3], leaks[4]], key=str)

    line, short = "one and the same long line of text", "short"
    assert kept(corpus_pipeline.drop_repeated_lines, [(None, f"{line}\n{say('j')}"), (None, f"{say('k')}\n{short}"), (3, line), (4, f"{say('l')}\n{line}"), (4, f"{say('m')}\n{say('n')}")]) == sorted(
        [(None, say("j")), (None, f"{say('k')}\n{short}"), (3, line), (4, say("l")), (4, f"{say('m')}\n{say('n')}")], key=str
    )

    model = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    bad, good = (toxicity.score(docs, model).where(f"predicted = {p}").join(docs, "doc_id").orderBy("doc_id").first().text for p in (1, 0))
    more = docs.unionByName(frame([(None, bad), (None, good)]))
    assert [r.text for r in corpus_pipeline.drop_toxic(spark, more, SF).where("doc_id is null").collect()] == [good]


def test_against_brute_force(spark):
    """Every stage on what the brute-force stage before it kept, over whole tables."""
    import hashlib

    import public_tokenizers
    import sentencepiece

    from tests.llm import test_decontaminate, test_line_dedup, test_ngram_join

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    labels = [(r.doc_id, r.toxic) for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if r.toxic is not None and r.doc_id in rows and not toxicity.held_out(r.doc_id)]
    model = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    assert len(labels) < toxicity.MAX_TRAIN  # all of them are learnt from
    kept = {i: t for i, t in rows.items() if toxicity.probabilities([t or ""], model)[0] < 0.5}
    stages = [s for _, s in corpus_pipeline.STAGES]

    def check(stage, before, want):
        out = stage(spark, spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in before.items()], docs.schema).repartition(3), SF)
        assert {r.doc_id: r.text for r in out.collect()} == want and len(want) > 100
        return want

    kept = check(stages[0], rows, kept)
    lines = test_line_dedup.brute([(i, t) for i, t in kept.items()])
    kept = check(stages[1], kept, {i: t for i, t in lines.items() if t == kept[i] or t.strip()})
    near = test_ngram_join.brute(list(kept.items()))
    kept = check(stages[2], kept, {i: t for i, t in kept.items() if near[i][1] == i})
    leaks = test_decontaminate.brute(list(kept.items()), [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()])
    kept = check(stages[3], kept, {i: t for i, t in kept.items() if not leaks[i][4]})
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    out = stages[4](spark, spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in kept.items()], docs.schema), SF)
    assert {r.doc_id: r.ids_sha256 for r in out.collect()} == {i: hashlib.sha256(",".join(map(str, sp.encode(t or ""))).encode()).hexdigest() for i, t in kept.items()}


def test_empty_tables_and_texts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0
    bare = spark.createDataFrame([(1, None, None, None, None), (2, "", "en", "s", 0), (None, "", "en", "s", 0), (2, " \n ", "en", "s", 3)], docs.schema)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert sorted(map(str, stage(spark, bare, SF).select("doc_id", "text").collect())) == sorted(map(str, bare.select("doc_id", "text").collect()))
    assert corpus_pipeline.STAGES[-1][1](spark, bare, SF).count() == 4
