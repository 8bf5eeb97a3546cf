"""Line deduplication in rounds, and the memory of stages that follow each other in the same workers."""

from pyspark.sql import functions as F

from brindle.llm import lines, tokens, toxicity


def test_lines_in_rounds(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = lambda: {tuple(r) for r in lines.op6(docs).collect()}
    whole, seen = rows(), []
    dealt = lines.dealt
    monkeypatch.setattr(lines, "ROUND", 300)
    monkeypatch.setattr(lines, "dealt", lambda df, key, n: seen.append(n) or dealt(df, key, n))
    assert rows() == whole
    assert seen and min(seen) == lines.ROUNDS


def test_dealt_parts_are_whole(spark):
    df = spark.range(1000).select((F.col("id") % 50).alias("k"), "id")
    parts = [{r.id: r.k for r in x.collect()} for x in lines.dealt(df, "k", 4)]
    assert sorted(i for p in parts for i in p) == list(range(1000))
    keys = [set(p.values()) for p in parts]
    assert sum(map(len, keys)) == 50


def test_toxicity_lets_coders_go(spark):
    path = tokens.default_file()
    docs = spark.createDataFrame([(i, "plain words here") for i in range(8)], "id long, text string").coalesce(1)
    model = toxicity.train(docs.withColumnRenamed("id", "doc_id").where("false"), spark.createDataFrame([], "doc_id long, toxic int"))

    def held(batches):
        tokens.id_coder(path)
        for b in batches:
            yield b

    def left(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([tokens.id_coder.cache_info().currsize] * b.num_rows)], ["n"])

    scored = toxicity.score(docs.mapInArrow(held, docs.schema), model)
    assert [r.n for r in scored.mapInArrow(left, "n long").collect()] == [0] * 8
