"""Operators on small literals with known results."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from docsieve.functions import text as T
from docsieve.functions import vector as V
from docsieve.operators import context, dedup, expansion, fusion, graph, ivf, lexical, metrics, providers, search, store
from docsieve.plans import pipelines
from docsieve.sources import ingest


def one(spark, expression):
    return spark.range(1).select(expression.alias("x")).first()["x"]


def test_cosine(spark):
    of = lambda a, b: one(spark, V.cosine(V.literal(a), V.literal(b)))
    assert of([1, 1], [1, 1]) == pytest.approx(1)
    assert of([1, 0], [0, 1]) == pytest.approx(0)
    assert of([1, 1], [-1, -1]) == pytest.approx(-1)
    assert of([0, 0], [1, 1]) is None
    with pytest.raises(Exception, match="differ in size"):
        of([1, 0, 1], [1, 0])


def test_mean_of_one_two_three(spark):
    df = spark.createDataFrame([("k", [float(i)] * 4) for i in (1, 2, 3)], "k string, v array<float>")
    assert search.mean_vectors(df, "k", "v").first()["mean"] == [2.0] * 4


def test_search_validation():
    with pytest.raises(ValueError):
        search.validated(3, 0, 0.5)
    with pytest.raises(ValueError):
        search.validated(3, 1, 1.5)
    with pytest.raises(ValueError):
        search.validated(3, 1, 0.5, expected=4)


def test_threshold_is_monotone(spark):
    rng = np.random.default_rng(0)
    chunks = spark.createDataFrame([(i, 0, rng.normal(size=8).tolist(), 5) for i in range(50)], "id long, document_id long, embedding array<double>, token_count int")
    docs = spark.createDataFrame([(0, "t")], "document_id long, content_type string")
    ids = [{r["id"] for r in search.similarity_search(chunks, docs, [1.0] * 8, 50, t).collect()} for t in (0.0, 0.2, 0.4)]
    assert ids[0] > ids[1] > ids[2]


@pytest.mark.parametrize(("kind", "size", "expected"), [("email", 30000, (300, 50)), ("application/pdf", 500000, (500, 100)), ("technical", 2000000, (800, 150)), ("unknown", 500000, (500, 100)), ("unknown", 100, (300, 50))])
def test_chunk_params(spark, kind, size, expected):
    assert tuple(one(spark, T.chunk_params(F.lit(kind), F.lit(size)))) == expected


def test_chunk_sentences(spark):
    of = lambda t, n, o: one(spark, T.chunk_sentences(F.lit(t), F.lit(n), F.lit(o)))
    assert of("First sentence. Second sentence. Third sentence.", 20, 10) == ["First sentence.", "Second sentence.", "Third sentence."]
    assert of("A b. C d. E f. G h.", 10, 5) == ["A b. C d.", "C d. E f.", "E f. G h."]
    assert of("", 20, 5) == []
    assert of("一. 二\t三!\n\n四?", 300, 50) == ["一. 二 三! 四?"]


def test_chunk_paragraphs(spark):
    """Against the sequential fold, on tokens of one word each."""

    def brute(text, most, carried=2):
        chunks, now = [], []
        for p in (x.strip() for x in text.split("\n\n") if x.strip()):
            if now and sum(len(x.split()) for x in now) + len(p.split()) > most:
                chunks.append("\n\n".join(now))
                now = now[-carried:]
            now = [*now, p]
        return [*chunks, "\n\n".join(now)] if now else chunks

    rng = np.random.default_rng(0)
    texts = ["\n\n".join(" ".join("w" for _ in range(n)) for n in rng.integers(0, 9, 12)) for _ in range(20)] + [""]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.chunk_paragraphs(F.col("t"), 12).alias("c"))
    for r in df.collect():
        assert r["c"] == brute(r["t"], 12)


def test_chunk_paragraphs_keeps_digits_at_the_ends(spark):
    """A paragraph's place (0, 1, ...) is not what is cut off its ends; spaces are, as in the SQL."""
    of = lambda t: one(spark, T.chunk_paragraphs(F.lit(t), 60))
    assert of("0 a 0\n\n1 b 1\n\n2 c 2") == ["0 a 0\n\n1 b 1\n\n2 c 2"]
    assert of(" 10 \n\n \n\n\u00a0b\u3000") == ["10\n\nb"]
    assert [one(spark, T.token_estimate(F.lit(t))) for t in ("a\u00bd", "a\u00a0b", "a\u200db", "a b, c")] == [1, 3, 3, 4]


def test_format_size_rounds_as_the_sql(spark):
    """The exact binary value counts, ties go to the even digit, as with Python's own formatting; null stays null."""
    rng = np.random.default_rng(0)
    sizes = [0.0, 1.005, 1.015, 1.125, 1023.995, *(k / 8 for k in range(80)), *(k / 1000 for k in range(5, 3000, 10)), *rng.uniform(0, 1024, 200).tolist()]
    df = spark.createDataFrame([(x, unit) for x in sizes for unit in range(5)], "x double, unit int")
    for r in df.select("*", T.format_size(F.col("x") * F.pow(F.lit(1024.0), "unit")).alias("size")).collect():
        if r["x"] >= 1 or r["unit"] == 0:
            assert r["size"] == f"{r['x']:.2f} {('B', 'KB', 'MB', 'GB', 'TB')[r['unit']]}"
    assert one(spark, T.format_size(F.lit(None).cast("long"))) is None
    assert one(spark, T.context_block(F.lit(1), F.lit(None), F.lit(None), F.lit("x"), F.lit(0.625))).endswith("Score: 0.62\n")


def test_chunk_fixed_needs_a_small_overlap():
    with pytest.raises(ValueError):
        T.chunk_fixed(F.lit("x"), 10, 10)


def test_suffix_and_routes(spark):
    assert one(spark, T.suffix(F.lit("test_document.PDF"))) == ".pdf"
    assert one(spark, T.suffix(F.lit("none"))) == ""
    assert one(spark, T.route(F.lit("text/x-python"), F.lit("a.py"))) == "code"
    assert one(spark, T.route(F.lit("video/mp4"), F.lit("a.mp4"))) == "error"


def test_window_scores(spark):
    assert one(spark, context.weighted_mean(V.literal([0.8, 0.7]))) == pytest.approx(0.744444, abs=1e-6)
    assert one(spark, context.weighted_mean(V.literal([0.8, 0.7, 0.9]))) == pytest.approx(0.803704, abs=1e-6)
    rows = spark.createDataFrame([(0, i, s, 10) for i, s in enumerate([0.8, 0.7, 0.9, 0.6, 0.7, 0.6])], "document_id long, chunk_index int, score double, length int")
    first = context.expanded_windows(rows, threshold=0.74).orderBy("start_idx").first()
    assert (first["start_idx"], first["end_idx"]) == (0, 2)
    assert context.merged_windows(context.expanded_windows(rows), rows).count() == 1


def test_bm25_fox(spark):
    docs = spark.createDataFrame([(1, "the quick brown fox"), (2, "the lazy dog sleeps"), (3, "a dog barks at a cat")], "id long, text string")
    q = spark.createDataFrame([(0, "quick fox")], "qid int, q string")
    found = lexical.Bm25(docs).search(q, 5).collect()
    assert [r["id"] for r in found] == [1]


def test_cover_density(spark):
    df = spark.createDataFrame([("a b",), ("a x x b",), ("a",), (None,)], "t string")
    got = [r[0] for r in df.select(lexical.cover_density(F.col("t"), ("a", "b"))).collect()]
    assert got == pytest.approx([0.1, 0.1 / 3, 0, 0])


def test_fusion(spark):
    v = spark.createDataFrame([(1, 0.7), (3, 0.5)], "id long, score double")
    b = spark.createDataFrame([(1, 0.8), (2, 0.6)], "id long, score double")
    got = {r["id"]: r["score"] for r in fusion.hybrid_fusion(v, b, fusion.fusion_weights()).collect()}
    assert got == pytest.approx({1: 0.73, 2: 0.18, 3: 0.35})
    norm = fusion.hybrid_fusion(spark.createDataFrame([(1, 10.0), (2, 5.0)], "id long, score double"), b, (0.5, 0.5), normalise=True)
    assert norm.agg(F.max("score")).first()[0] <= 1
    assert fusion.fusion_weights({"factual": 1.0}) == pytest.approx((0.4, 0.6))


def test_greedy_equals_sequential(spark):
    rng = np.random.default_rng(1)
    for _ in range(3):
        n = 12
        pairs = [(a, b) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.25]
        kept = []
        for i in range(n):
            if not any((k, i) in pairs for k in kept):
                kept.append(i)
        ranked = spark.createDataFrame([(i, i) for i in range(n)], "id long, pos long")
        state = dedup.greedy_kept(ranked, spark.createDataFrame(pairs or [(0, 0)], "a long, b long").filter("a <> b"))
        assert sorted(r["id"] for r in state.filter("kept").collect()) == kept


def test_graph(spark):
    docs = spark.createDataFrame(
        [(1, "doc1.txt", "t", 'see "doc2.pdf" and https://a.example/1', {"url": "https://a.example/1"}), (2, "DOC2.pdf", "t", "[1]", {}), (3, "c.txt", "t", "see section 1.2", {"section": "1.2"})],
        "id long, filename string, content_type string, content string, metadata map<string,string>",
    )
    nodes, edges = graph.build_graph(docs)
    assert sorted(map(tuple, edges.collect())) == [(1, 1, "url"), (1, 2, "file")]
    assert nodes.count() == 3
    assert one(spark, graph.section_number(F.lit("see section 1.2.3"))) == "1.2.3"
    chain = spark.createDataFrame([(1, 2, "url"), (3, 2, "file"), (3, 4, "url")], "src long, dst long, type string")
    root = spark.createDataFrame([(1,)], "root long")
    near = {r["id"]: r["distance"] for r in graph.related(chain, root, 2).collect()}
    assert near == {2: 1, 3: 2}
    assert {r["id"] for r in graph.related(chain, root, 1).collect()} <= set(near)
    assert graph.path_edges(chain, graph.levels(chain, root, 2)).count() == 2
    assert graph.common_references(chain, nodes, (1, 9)).count() == 0


def test_store(spark):
    rows = spark.createDataFrame([("a.txt", "x", 10), ("b.exe", "x", 10), ("c.pdf", " ", 10), ("d.md", "x", 17 * 1024 * 1024)], "filename string, content string, file_size long")
    assert [r["reject_reason"] for r in store.upload_checked(rows).orderBy("filename").collect()] == [None, "extension", "empty", "size"]
    cache = spark.createDataFrame([("k", 1, 0, 10), ("k", 2, 5, 100)], "key string, value int, t long, ttl long").withColumn("inserted_at", F.timestamp_seconds("t"))
    live = lambda t: [r["value"] for r in store.cache_live(cache, F.timestamp_seconds(F.lit(t))).collect()]
    assert (live(6), live(50), live(200)) == ([1], [2], [])
    store.created_tables(spark, drop=True)
    assert spark.table("document_chunks").columns[0] == "id"


def test_metrics(spark):
    rows = spark.createDataFrame([("GET", 0.1), ("POST", 0.2), ("GET", 0.05)], "method string, value double")
    h = metrics.histogram(rows, ["method"])
    assert h.agg(F.sum("count")).first()[0] == 3
    assert metrics.exposition(h, "latency", ["method"]).filter(F.col("line") == 'latency_count{method="GET"} 2').count() == 1
    assert one(spark, metrics.hit_rate(F.lit(0), F.lit(0))) == 0
    assert metrics.plan_advice(rows.crossJoin(rows)) != []


def test_ingest_sources(spark, tmp_path):
    (tmp_path / "a.txt").write_text("  hello \n")
    assert ingest.read_texts(spark, str(tmp_path)).first()["content"] == "hello"
    assert ingest.read_binaries(spark, str(tmp_path)).first()["content_type"] == "text/plain"
    (tmp_path / "log.json").write_text('{"level":"INFO","message":"m","duration":0.5}\n')
    assert ingest.read_logs(spark, str(tmp_path / "log.json")).first()["level"] == "INFO"
    bad = spark.createDataFrame([(bytearray(b"nozip"),)], "c binary")
    assert bad.select(ingest.docx_fields(F.col("c"))["error"]).first()[0]
    import io
    import zipfile

    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body><w:p><w:r><w:t>Hi</w:t></w:r></w:p><w:sectPr/></w:body></w:document>')
    good = spark.createDataFrame([(bytearray(buf.getvalue()),)], "c binary").select(ingest.docx_fields(F.col("c")).alias("d")).first()["d"]
    assert (good["text"], good["paragraphs"], good["sections"], good["error"]) == ("Hi", 1, 1, None)


def test_code(spark):
    py = "import os\nfrom x import y\nclass T:\n    def a(self): pass\n    def b(self): pass\ndef f(): pass\nz = 1\n"
    df = spark.createDataFrame([(py, "Python"), ("class A {}\nconst q = () => 1", "JavaScript"), ("def (", "Python")], "c string, l string")
    r = df.select(ingest.code_structure(F.col("c"), F.col("l")).alias("s")).collect()
    assert [len(r[0]["s"][k]) for k in ("classes", "functions", "imports", "variables")] == [1, 3, 2, 1]
    assert r[1]["s"]["functions"][0]["name"] == "q" and r[2]["s"]["error"]
    assert one(spark, T.cyclomatic(F.lit("if x&&y && z || for"))) == 4
    assert one(spark, ingest.code_body(F.lit("class A { int x; } class B {}"), "class", "A")) == "class A { int x; }"
    nested = "x; function f(a) { if (a) { g(); } return {}; } const h = (b) => { y; }"
    assert one(spark, ingest.code_body(F.lit(nested), "function", "f")) == "function f(a) { if (a) { g(); } return {}; }"
    assert one(spark, ingest.code_body(F.lit(nested), "function", "h")) == "const h = (b) => { y; }"
    assert one(spark, ingest.code_body(F.lit("class A {"), "class", "A")) is None and one(spark, ingest.code_body(F.lit(nested), "function", "z")) is None
    py = "import os\nclass A:\n    def m(self):\n        return 1\n\ndef f():\n    pass\n"
    got = [(c["kind"], c["name"], c["lineno"], c["code"].count("\n")) for c in one(spark, ingest.code_chunks(F.lit(py), F.lit("Python")))]
    assert got == [("class", "A", 2, 2), ("function", "m", 3, 1), ("function", "f", 6, 1)]
    got = one(spark, ingest.code_chunks(F.lit("class A extends B {\n}\nfunction f() {\n}"), F.lit("JavaScript")))
    assert [(c["kind"], c["name"], c["code"]) for c in got] == [("class", "A", "class A extends B {\n}"), ("function", "f", "function f() {\n}")]


def test_ocr_merge(spark):
    words = spark.createDataFrame([(0, 0, 0, 0, "Hello", 90.0, 0, 0, 50, 20), (0, 0, 0, 1, "World", 85.0, 60, 0, 50, 20)], "page int, block int, line int, word int, text string, conf double, left int, top int, width int, height int")
    b = ingest.ocr_blocks(words).first()
    assert (b["text"], b["confidence"], b["width"]) == ("Hello World", 87.5, 110)


def test_tables(spark):
    df = spark.createDataFrame([("Ann ", 30, None), (None, None, None), ("Bob", None, None)], "Name string, Age int, City string")
    clean = ingest.table_cleaned(df)
    assert [tuple(r) for r in clean.collect()] == [("Ann", "30"), ("Bob", "")]
    assert ingest.table_header(clean) == "Headers: Name | Age"
    s = ingest.table_stats(df).first()
    assert (s["row_count"], s["empty_cells"], s["numeric_columns"]) == (3, 6, "Age")


def test_ivf_recall(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 16)) + 3 * rng.normal(size=(12, 16))[rng.integers(0, 12, 600)]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<double>")
    index = ivf.IvfIndex.fit(df, 16)
    cells = df.withColumn("cell", index.cell(F.col("embedding"))).cache()
    hits = 0
    for i in range(0, 600, 100):
        sims = x @ x[i] / np.linalg.norm(x, axis=1)
        exact = set(np.argsort(-sims)[:5].tolist())
        hits += len(exact & {r["id"] for r in index.search(cells, x[i].tolist(), 5, 4).collect()})
    assert hits / 30 >= 0.9


def test_providers_and_pipelines(spark):
    docs = spark.createDataFrame([("a.txt", "The quick fox jumps. It runs far.", 100), ("b.txt", "A lazy dog sleeps. It snores.", 100), ("c.exe", "x", 1)], "filename string, content string, file_size long")
    got = pipelines.ingest(docs)
    assert got.rejected.count() == 1 and got.documents.count() == 2
    chunks = got.chunks.withColumn("id", F.monotonically_increasing_id()).cache()
    q = one(spark, providers.hashed_embedding(F.lit("quick fox")))
    best = pipelines.retrieve(chunks, "quick fox", q).first()
    assert best["id"] == got.documents.filter("filename = 'a.txt'").first()["id"]
    said = pipelines.answer(chunks, got.documents.select(F.col("id").alias("document_id")), "How does the fox run?", q, threshold=0.0).first()
    assert "Chunk 1" in said["context"] and said["prompt"] == "explanation"
    assert pipelines.context_windows(chunks, q, 0.0).count() >= 0
    flaky = {"n": 0}
    twice = providers.batched(lambda xs: [len(x) for x in xs], "int")
    assert docs.select(twice(F.col("content"))).collect() and not flaky["n"]
    assert one(spark, providers.stopword_language(F.lit("der Hund und die Katze"))) == "de"


def test_stream_first_writes(spark, tmp_path):
    from docsieve.streaming import rates

    spark.createDataFrame([(0, "k", 1), (10, "k", 2), (20, "m", 3)], "t long, key string, v int").select(F.timestamp_seconds("t").alias("ts"), "key", "v").write.parquet(str(tmp_path / "in"))
    stream = rates.first_writes(rates.event_stream(spark, str(tmp_path / "in")), "key")
    rates.to_table(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


@pytest.mark.parametrize("parts", [8, 200])
@pytest.mark.parametrize("wide", [False, True])
def test_numbering_loses_nothing(spark, parts, wide):
    """Every row gets one id, ids have no gaps and follow the order, with and without wide columns."""
    rows = spark.range(200_000).select((F.col("id") * 7919 % 200_003).alias("k"), (F.repeat(F.lit("x"), 200) if wide else F.lit(1)).alias("x"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        got = store.numbered(rows.repartition(16), ["k"], 5)
        want = rows.select("k").rdd.map(lambda r: r[0]).collect()
        found = [(r["id"], r["k"]) for r in got.select("id", "k", "x").collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sorted(found) == list(enumerate(sorted(want), 5))


def test_read_documents(spark, tmp_path):
    (tmp_path / "a.txt").write_text("  plain text\n")
    (tmp_path / "b.pdf").write_bytes(b"%PDF-1.4")
    (tmp_path / "c.bin").write_bytes(b"\x00\x01")
    (tmp_path / "d.docx").write_bytes(b"no zip")
    said = {r["filename"][-5:]: (r["content"], r["error"]) for r in ingest.read_documents(spark, str(tmp_path)).collect()}
    assert said["a.txt"] == ("plain text", None) and said["b.pdf"] == (None, "no provider for PDF files")
    assert said["c.bin"] == (None, "unsupported suffix: .bin") and said[".docx"][0] is None and said[".docx"][1]
    read = ingest.read_documents(spark, str(tmp_path), lambda c: F.lit("from a reader"))
    assert {r["filename"][-5:]: r["content"] for r in read.collect()}["b.pdf"] == "from a reader"


def test_semantic_terms(spark):
    """Threshold, cut, ties, own terms left out, domain terms for a query without context."""
    embed = lambda c: F.when(c == "q", F.array(F.lit(1.0), F.lit(0.0))).when(c == "near", F.array(F.lit(0.9), F.lit(0.1))).when(c == "far", F.array(F.lit(0.0), F.lit(1.0))).otherwise(F.array(F.lit(1.0), F.lit(1.0)))
    q = spark.createDataFrame([(1, "q", ["own"]), (2, "q", ["database"])], "qid long, q string, terms array<string>")
    context = spark.createDataFrame([(1, "near far own side")], "qid long, content string")
    of = expansion.candidates(q, context, lambda c: F.split(c, " "))
    assert {r["term"] for r in of.filter("qid = 1").collect()} == {"near", "far", "side"}
    assert of.filter("qid = 2").count() == len(expansion.DOMAIN_TERMS) - 1
    got = expansion.semantic_terms(q, of, embed, 0.7, 3)
    assert [(r["term"], r["rank"]) for r in got.filter("qid = 1").orderBy("rank").collect()] == [("near", 1), ("side", 2)]
    assert [r["term"] for r in got.filter("qid = 2").orderBy("rank").collect()] == sorted(t for t in expansion.DOMAIN_TERMS if t != "database")[:3]
