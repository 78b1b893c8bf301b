"""Ports, stems, the composed ingest, chat and suite on literal inputs."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from marlstone.functions import net
from marlstone.operators import chat, conversation, evaluation, gaps, grounding, ingest, lexical, ports, prompts, retrieval, stemming
from marlstone.sources import store, web

NOW = "2026-01-02 03:04:05"


# --- ports ---


def test_embedder_checks_its_answers():
    calls = []

    def call(texts, kind):
        calls.append((len(texts), kind))
        return [[float(len(t)), 0.0] for t in texts]

    e = ports.Embedder("x", "m", 2, call)
    assert e.embed(["a" * k for k in range(200)], "document")[150] == [150.0, 0.0] and calls == [(96, "document"), (96, "document"), (8, "document")]
    with pytest.raises(ports.ProviderError, match="1 vectors for 2 texts"):
        ports.Embedder("x", "m", 2, lambda t, k: [[1.0, 2.0]]).embed(["a", "b"], "query")
    with pytest.raises(ports.ProviderError, match="dimensions"):
        ports.Embedder("x", "m", 3, call).embed(["a"], "query")


def test_embedding_tables(spark):
    rows = spark.createDataFrame([(1, "Hola mundo"), (2, None), (3, "")], "id long, text string")
    got = {r.id: r.embedding for r in ports.embed_texts(rows, ports.deterministic(384), "id", "text").collect()}
    assert abs(sum(x * x for x in got[1]) - 1) < 1e-6 and not any(got[2]) and not any(got[3])
    with pytest.raises(ValueError):
        ports.embed_texts(rows, ports.deterministic(7), "id", "text")


def test_call_helpers():
    seen = []
    call = ports.prefixed(lambda texts: seen.extend(texts) or [[0.0]] * len(texts))
    call(["a"], "query")
    call(["b"], "document")
    assert seen == ["query: a", "passage: b"]
    assert ports.in_order([{"index": 1, "embedding": [2.0]}, {"index": 0, "embedding": [1.0]}]) == [[1.0], [2.0]]
    assert ports.create(ports.EMBEDDERS, "deterministic", dimensions=16).dimensions == 16
    with pytest.raises(ports.ProviderError, match="there are deterministic"):
        ports.create(ports.EMBEDDERS, "other")
    assert ports.status({"embedding": ports.EMBEDDERS, "generation": ports.GENERATORS}) == {"embedding": True, "generation": False}


@pytest.mark.parametrize(
    ("header", "text", "ms"),
    [("2", "", 2000), ("-1", "", 0), (None, "Please try again in 3.6525s.", 3903), (None, "try again in 1m2.5s", 62750), (None, "no", None), ("nonsense", "try again in 1s", 1250), ("Thu, 01 Jan 1970 00:00:12 GMT", "", 2000)],
)
def test_waits(spark, header, text, ms):
    assert ports.wait_ms(header, text, now=10.0) == ms
    if header is None:
        assert spark.range(1).select(ports.wait_column(F.lit(text))).first()[0] == ms


def test_generator_retries():
    answers = [ports.Response(429, "try again in 1s"), ports.Response(200, data="{}", input_tokens=1_000_000, output_tokens=500_000, reason="stop")]
    slept, sent = [], []
    g = ports.Generator("x", "m", lambda r: sent.append(r) or answers.pop(0), ports.Price(2.0, 4.0), sleep=slept.append)
    schema = {"type": "object", "properties": {"a": {"type": "string"}, "b": {"type": "array", "items": {"type": "object", "properties": {"c": {"type": ["string", "null"]}}}}}, "required": ["a"]}
    got = g.generate("p", schema, 0.2)
    assert (got.stop, got.cost, slept) == ("end_turn", 4.0, [1.25])
    assert sent[0]["schema"] == {
        "type": "object", "required": ["a", "b"], "additionalProperties": False,
        "properties": {"a": {"type": "string"}, "b": {"type": ["array", "null"], "items": {"type": "object", "properties": {"c": {"type": ["string", "null"]}}, "required": ["c"], "additionalProperties": False}}},
    }
    for status, again in ((400, False), (503, True), (408, True)):
        with pytest.raises(ports.ProviderError) as e:
            ports.Generator("x", "m", lambda r, s=status: ports.Response(s, "no")).generate("p")
        assert e.value.retryable is again
    with pytest.raises(ports.ProviderError, match="structured"):
        ports.Generator("x", "m", lambda r: None, structured=False).generate("p", schema)
    with pytest.raises(ports.ProviderError):
        ports.Generator("x", "m", lambda r: ports.Response(429, "try again in 1s"), sleep=lambda s: None).generate("p")


# --- language ---

STEMS = {
    "chicharrones": "chicharron", "chicas": "chic", "chihuahua": "chihuahu", "torear": "tor", "toreado": "tor", "torneos": "torne", "tornillo": "tornill", "torrenciales": "torrencial", "chimenea": "chimene", "chocado": "choc",
    "choferes": "chofer", "tormentas": "torment", "torturado": "tortur", "cheques": "chequ", "políticas": "polit", "gratuitamente": "gratuit", "facilidad": "facil", "haciéndola": "hac", "": "", "a": "a",
}


def test_stems(spark):
    assert {w: stemming.stem_es(w) for w in STEMS} == STEMS
    at = spark.createDataFrame([("Los envíos de las políticas",), (None,)], "t string")
    assert [r[0] for r in at.select(lexical.stemming_analyser("es")(F.col("t"))).collect()] == [["envi", "polit"], None]


def test_configurations(spark):
    got = spark.createDataFrame([("en",), ("en-US",), ("es",), (None,)], "l string").select(stemming.configuration(F.col("l")).alias("d"), stemming.configuration(F.col("l"), query=True).alias("q")).collect()
    assert [tuple(r) for r in got] == [("english", "english"), ("english", "spanish"), ("spanish", "spanish"), ("spanish", "spanish")]


@pytest.mark.parametrize("block", [2, 1024])
def test_lexical_search_by_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(lexical, "QUERY_BLOCK", block)
    docs = spark.createDataFrame([(1, "a a b"), (2, "b c"), (3, None), (4, ""), (5, "a b c d")], "doc_id long, text string")
    asked = spark.createDataFrame([("q1", ["a", "b", "a"]), ("q2", ["zz"]), ("q3", []), ("q4", ["c"]), ("q5", None)], "query_id string, terms array<string>")
    any_of = {(r.query_id, r.id): r.lexical_rank for r in lexical.search(docs, asked, need_all=False).collect()}
    assert any_of == {("q1", 1): 1, ("q1", 5): 2, ("q1", 2): 3, ("q4", 2): 1, ("q4", 5): 2}
    assert {(r.query_id, r.id) for r in lexical.search(docs, asked, k=None).collect()} == {("q1", 1), ("q1", 5), ("q4", 2), ("q4", 5)}
    assert {(r.query_id, r.id) for r in lexical.search(docs, asked, k=1).collect()} == {("q1", 1), ("q4", 2)}
    assert lexical.search(docs, asked.where("false")).count() == 0 and lexical.search(docs.where("false"), asked).count() == 0


def test_vectors_of_other_models(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0, 0.0]), (3, None)], "id int, embedding array<double>")
    q = spark.createDataFrame([("q", [1.0, 0.0])], "query_id string, embedding array<double>")
    assert [r.id for r in retrieval.vector_topk(rows, q).collect()] == [1]
    assert retrieval.vector_topk(rows, q.where("false")).count() == 0
    with pytest.raises(ValueError):
        retrieval.vector_topk(rows, q.unionByName(spark.createDataFrame([("r", [1.0])], q.schema)))


# --- answers ---


def test_malformed_answers(spark):
    questions = spark.createDataFrame([(1, "a", True), (2, "b", True), (3, "c", False), (4, "d", True)], "query_id int, question string, passed boolean")
    hits = spark.createDataFrame([(k, 1, "c1", "the text") for k in (1, 2, 4)], "query_id int, rank int, id string, content string")
    said = {"a": '{"answered": true, "response": "r", "citations": [{"chunk_id": "c1", "quote": "THE text"}]}', "b": '{"answered": true, "response": "r"}', "d": '{"answered": true, "response": "r", "citations": [{"chunk_id": "c9", "quote": "x"}]}'}
    generate = lambda q, h: F.create_map(*[F.lit(x) for kv in said.items() for x in kv])[q]
    got = {r.query_id: (r.answer.answered, r.degraded, [f.kind for f in r.failures]) for r in grounding.answer(questions, hits, generate).collect()}
    assert got == {1: (True, False, []), 2: (False, True, ["malformed"]), 3: (False, False, []), 4: (False, True, ["unknown_chunk"])}


# --- ingest ---

FILES = "file_id long, tenant_id string, document_id string, source_ref string, title string, source_id string, filename string, mime_type string, content binary, category string, tags array<string>, department string"
DOCUMENTS = "id string, tenant_id string, title string, source_ref string, source_id string"
VERSIONS = "id string, tenant_id string, document_id string, version int, checksum string, is_active boolean"


def test_ingest(spark):
    page = b"<html lang=en><title>From page</title><body><h1>One</h1><p>The first text of it.</p></body></html>"
    rows = [
        (1, "t", None, "ref-a", None, None, "a.html", "text/html", page, "c", ["x"], None), (2, "t", "gone", None, None, None, "b.md", None, b"text", None, [], None), (3, "t", None, "ref-c", "Given", None, "c.md", None, b"# H\n\nold words", None, [], None),
        (4, "t", None, "ref-d", None, None, "d.xls", None, b"?", None, [], None), (5, "t", "doc-e", None, None, None, "e.md", None, b"same", None, [], None), (6, "t", None, "ref-c", "Given", None, "c.md", None, b"# H\n\nnew words", None, [], None), (7, "t", None, "ref-f", None, None, "f.md", None, b"", None, [], None),
    ]
    files = spark.createDataFrame(rows, FILES)
    documents = spark.createDataFrame([("doc-c", "t", "Given", "ref-c", None), ("doc-e", "t", "E", None, None)], DOCUMENTS)
    from hashlib import sha256

    versions = spark.createDataFrame([("v1", "t", "doc-c", 3, "other", True), ("v0", "t", "doc-c", 2, "x", False), ("v2", "t", "doc-e", 1, sha256(b"same").hexdigest(), True)], VERSIONS)
    done = ingest.ingest(files, documents, versions, ports.deterministic(384), F.lit(NOW).cast("timestamp"))
    got = {r.file_id: (r.version, r.chunks_created, r.unchanged, bool(r.error)) for r in done.results.collect()}
    assert got == {1: (1, 1, False, False), 2: (None, 0, False, True), 3: (4, 0, True, False), 4: (None, 0, False, True), 5: (1, 0, True, False), 6: (4, 1, False, False), 7: (1, 1, False, False)}
    chunks = {r.title: r for r in done.chunks.collect()}
    assert set(chunks) == {"From page", "Given", "f.md"} and chunks["f.md"].content == "" and len(done.chunks.columns) == 21
    c = chunks["From page"]
    assert (c.language, c.breadcrumbs, c.category, c.tags, c.embedding_dimensions, c.is_active, c.created_at) == ("en", ["One"], "c", ["x"], 384, True, dt.datetime(2026, 1, 2, 3, 4, 5))
    assert {t.term: t.positions for t in c.search_vector} == {"first": [0], "text": [1]}
    assert chunks["Given"].content == "new words" and [r.version_id for r in done.closed.collect()] == ["v1"]
    assert {r.source_ref for r in done.documents.collect()} == {"ref-a", "ref-f"}


# --- chat and suites ---


def test_chat_refusals_and_costs(spark):
    requests = spark.createDataFrame([(1, "t", None, "web", "u1", " hi "), (2, "t", "c2", "web", None, "q"), (3, "t", "c3", "web", None, "and there?"), (4, "t", "nope", "web", None, "q"), (5, "t", None, "web", "u5", "x" * 4001), (6, "t", None, "web", "u6", " ")], "request_id long, tenant_id string, conversation_id string, channel string, external_id string, question string")
    known = spark.createDataFrame([("c2", "web", None, "CLOSED"), ("c3", "web", None, "OPEN")], "id string, channel string, external_id string, status string")
    messages = spark.createDataFrame([("c3", 0, "user", "to here?"), ("c3", 1, "assistant", "yes"), ("c3", 2, "system", "-")], "conv_id string, turn long, role string, text string")
    search = lambda asked: asked.select("query_id", F.lit("k").alias("id"), F.lit(1).alias("rank"), F.lit(0.9).alias("similarity"), F.concat(F.lit("about "), "question").alias("content"))
    resolve = lambda q, h: F.struct(F.lit(True).alias("is_follow_up"), F.concat(q, F.lit(" in full")).alias("standalone"), F.size(h).cast("double").alias("cost"))
    out = chat.replay(requests, known, messages, search, resolve)
    replies = {r.request_id: (r.refusal, r.response, r.resolved_question) for r in out.replies.collect()}
    assert replies == {1: (None, "about hi", None), 2: ("conversation_closed", None, None), 3: (None, "about and there? in full", "and there? in full"), 4: ("not_found", None, None), 5: ("invalid_message", None, None), 6: ("invalid_message", None, None)}
    assert sorted((r.request_id, r.turn, r.role, r.text, r.cost) for r in out.messages.collect()) == [(1, 0, "USER", " hi ", 0.0), (1, 1, "ASSISTANT", "about hi", 0.0), (3, 2, "USER", "and there?", 0.0), (3, 3, "ASSISTANT", "about and there? in full", 2.0)]
    assert out.usage.count() == 6 and {r.type for r in out.events.collect()} == {"message.received"}


CASES = "id string, kind string, question string, history array<string>, expected_sources array<string>, expected_contains array<string>, must_not_contain array<string>, expects_rewrite boolean"


def test_suite_with_all_ports(spark):
    cases = spark.createDataFrame(
        [("a", "ANSWERABLE", "returns", [], [], ["thirty days"], [], None), ("b", "UNANSWERABLE", "weather", [], [], [], [], None), ("c", "ANSWERABLE", "and to the isles", ["shipping?"], [], ["five euros"], [], True), ("d", "UNANSWERABLE", "returns of cars", [], [], [], [], None)],
        CASES,
    )
    corpus = {"returns": "Thirty days.", "weather": None, "shipping to the isles": "Five EUROS.", "returns of cars": "Thirty days."}

    def search(asked):
        known = spark.createDataFrame([(q, t, 0.9 if t else 0.1) for q, t in corpus.items()], "question string, content string, similarity double")
        return asked.join(known, "question").select("query_id", F.lit("k").alias("id"), F.lit(1).alias("rank"), "similarity", F.coalesce("content", F.lit("-")).alias("content"))

    resolve = lambda asked: asked.select("id", F.lit("shipping to the isles").alias("question"), F.lit(True).alias("rewritten"), F.lit(0.25).alias("cost"))
    generate = lambda q, h: q.join(h, "query_id").select("query_id", (~F.contains(F.col("question"), F.lit("cars"))).alias("answered"), F.col("content").alias("response"), F.lit(1.0).alias("cost"), F.array().cast("array<string>").alias("grounding_failures"))
    full = evaluation.run_suite(cases, search, generate, resolve)
    m = full.metrics.first()
    assert (full.mode, m.recall_at_k, m.correct_abstention, m.wrong_answers, m.follow_up_resolution, m.total_cost) == ("full", 1.0, 1.0, 0, 1.0, 3.25)
    assert full.gate.first().passed and full.skipped.count() == 0 and full.warnings.first().warnings == []
    bare = evaluation.run_suite(cases, search)
    assert [tuple(r) for r in bare.skipped.collect()] == [("c", "no resolver")] and bare.outcomes.count() == 3
    assert {"threads_skipped", "abstention_not_measured"} <= set(bare.warnings.first().warnings)
    found = {tuple(r) for r in evaluation.findings(cases, bare.outcomes.withColumn("response", F.lit("none of it"))).collect()}
    assert found == {("a", "wrong_answer")}


def test_matcher(spark):
    at = spark.createDataFrame([('{"matchId": "g1", "reasoning": ""}',), ('{"matchId": "g9"}',), ('{"matchId": ""}',), ("no json",), (None,)], "d string")
    candidates = F.array(F.struct(F.lit("g1").alias("id"), F.lit("Q?").alias("question"), F.array(F.lit("Q2?"), F.lit("Q3?")).alias("variants")), F.struct(F.lit("g2").alias("id"), F.lit("R?").alias("question"), F.array().cast("array<string>").alias("variants")))
    assert [r[0] for r in at.select(gaps.matched(F.col("d"), candidates)).collect()] == ["g1", None, None, None, None]
    assert spark.range(1).select(gaps.render_candidates(candidates)).first()[0] == "[g1] Q?\n   también preguntado como: Q2? · Q3?\n\n[g2] R?"


def test_gaps_of_many_tenants_in_batches(spark):
    rows = [(f"t{k % 3}", k, f"question {k % 5}", "R", [float(k % 5 == j) for j in range(5)]) for k in range(60)] + [("t9", 0, "zero", "R", [0.0] * 5), ("t9", 1, "zero", "R", [0.0] * 5)]
    q = spark.createDataFrame(rows, "tenant_id string, asked_at long, question string, reason string, embedding array<double>")
    got = sorted((r.tenant_id, r.question, r.occurrences) for r in gaps.group_stream(q).collect())
    assert got == sorted([(f"t{t}", f"question {n}", 4) for t in range(3) for n in range(5)] + [("t9", "zero", 1)] * 2)


# --- sources ---


def test_redirects():
    site = {"http://a.com/": (302, "/b", b""), "http://a.com/b": (301, "http://c.com/", b""), "http://c.com/": (200, None, b"ok"), "http://d.com/": (302, "http://10.0.0.1/", b""), "http://e.com/": (302, "http://e.com/", b"")}
    seen = []
    get = lambda url, headers: seen.append((url, dict(headers))) or site[url]
    resolve = lambda host: ["8.8.8.8"]
    assert net.fetched("http://a.com/", get, resolve, {"Authorization": "s", "Accept": "x"}) == ("http://c.com/", b"ok")
    assert [h.get("Authorization") for _, h in seen] == ["s", "s", None] and seen[2][1] == {"Accept": "x"}
    for url, reason in (("http://d.com/", "private_network"), ("http://e.com/", "redirects")):
        with pytest.raises(net.BlockedUrl) as e:
            net.fetched(url, get, resolve)
        assert e.value.reason == reason


def test_sitemaps_and_settings(spark):
    maps = [("http://a.com/sitemap.xml", "<sitemapindex><loc> http://a.com/s1.xml </loc><loc>http://a.com/p0</loc></sitemapindex>", True), ("http://a.com/s1.xml", "<urlset><LOC>http://a.com/p1</LOC><loc></loc></urlset>", False)]
    sitemaps = spark.createDataFrame(maps, "url string, xml string, is_start boolean")
    assert sorted(r.url for r in web.sitemap_pages(sitemaps).collect()) == ["http://a.com/p0", "http://a.com/p1"]
    pages = spark.createDataFrame([("http://a.com/", "<p>x</p>"), ("http://a.com/p1", "<p>y</p>"), ("http://a.com/p0", "<p>z</p>")], "url string, html string")
    seen = spark.createDataFrame([], "url string, checksum string")
    got = [(r.url, r.depth) for r in web.crawl(pages, web.WebConfig(("http://a.com/",), max_pages=2), seen, sitemaps=sitemaps).orderBy("url").collect()]
    assert got == [("http://a.com/", 0), ("http://a.com/p0", 0)]
    assert web.CONFIGS["NOTION"]({"token": "x", "maxPages": 99999}).most == 5000 and web.CONFIGS["GOOGLE_DRIVE"]({"serviceAccount": "k", "folderIds": ["f"]}).folders == ("f",)
    for bad in ({}, {"token": " "}, {"token": "x", "folderIds": [1]}):
        with pytest.raises(web.ConnectorError):
            web.CONFIGS["NOTION"](bad)


def test_store_refuses_keys(spark, tmp_path):
    s = store.FileStore(spark, str(tmp_path / "s"))
    keys = spark.createDataFrame([("a/b.md", b"1"), ("a/../c", b"2")], "key string, content binary")
    assert s.get(keys).count() == 0 and [r.there for r in s.exists(keys).collect()] == [False, False]
    with pytest.raises(store.StorageError):
        s.put(keys, 1)
    s.put(keys.limit(1), 1)
    assert [bytes(r.content) for r in s.get(keys).collect()] == [b"1"]


def test_prompt_seeding(spark):
    files = spark.createDataFrame([("a", "A", 1, "t1"), ("a", "A2", 2, "t2"), ("b", "B", 1, "u")], "key string, name string, version int, template string")
    stored = spark.createDataFrame([("a", 1, "t1")], "key string, version int, template string")
    new_prompts, new_versions = prompts.seed(files, spark.createDataFrame([("a",)], "key string"), stored)
    assert [tuple(r) for r in new_prompts.collect()] == [("b", "B")] and sorted((r.key, r.version) for r in new_versions.collect()) == [("a", 2), ("b", 1)]
    with pytest.raises(ValueError, match="versions never change"):
        prompts.seed(files, new_prompts, stored.withColumn("template", F.lit("other")))


def test_resolver_is_not_asked_without_history(spark):
    r = conversation.resolved(F.lit("q"), F.lit(0), F.lit(True), F.lit("other"))
    assert spark.range(1).select(r.alias("r")).first().r.question == "q"


def test_strict_schema_of_nested_schemas():
    inner = {"type": "object", "properties": {"a": {"type": "string"}, "b": {"type": ["integer", "null"]}, "c": {"enum": [1]}, "d": 5}, "required": ["a"]}
    given = {"type": "object", "title": "t", "properties": {"one": inner, "many": {"type": "array", "items": inner}, "maybe": inner}, "required": ["one", "many"]}
    before = repr(given)
    own = ports.strict_schema(given)
    closed = {"type": "object", "properties": {"a": {"type": "string"}, "b": {"type": ["integer", "null"]}, "c": {"enum": [1]}, "d": 5}, "required": ["a", "b", "c", "d"], "additionalProperties": False}
    assert own == {"type": "object", "title": "t", "properties": {"one": closed, "many": {"type": "array", "items": closed}, "maybe": closed | {"type": ["object", "null"]}}, "required": ["one", "many", "maybe"], "additionalProperties": False}
    assert repr(given) == before and ports.strict_schema({"type": "string"}) == {"type": "string"} and ports.strict_schema({}) == {}


def test_long_storage_keys(spark):
    from marlstone.functions import text as tx

    rows = spark.createDataFrame([("a" * 512,), ("a" * 513,), ("a/b.md",), ("../a",)], "k string")
    assert [r[0] for r in rows.select(tx.valid_storage_key(F.col("k"))).collect()] == [True, False, True, False]
