"""Operators on small literal inputs."""

import datetime as dt

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marlstone.functions import cron, net, vectors
from marlstone.functions import text as tx
from marlstone.operators import chunking, context, convert, evaluation, events, gaps, grounding, ingest, lexical, markup, prompts, retrieval, tenancy
from marlstone.sources import files, notes, source_for, web


def one(spark, c, **values):
    row = spark.range(1).select(*[(v if hasattr(v, "_jc") else F.lit(v)).alias(k) for k, v in values.items()])
    return row.select(c.alias("x")).first()["x"]


# --- text ---


def test_text_kernel(spark):
    a = F.col("a")
    assert one(spark, tx.trim(a), a="﻿  x \n") == "x"
    assert one(spark, tx.normalized(a), a="  Añó  ÁRBOL\n") == "ano arbol"
    assert one(spark, tx.comparable(a), a="¿Cuánto  cuesta?") == "cuanto cuesta"
    assert one(spark, tx.utf16_length(a), a="a\U0001f600ñ") == 4
    assert one(spark, tx.token_estimate(a), a="12345678") == 3
    assert one(spark, tx.decode_entities(a), a="&amp;lt; &#233;&#x1F600; &ntilde;") == "< é\U0001f600 ñ"
    assert one(spark, tx.normalize_blank_lines(a), a="a  \n\n\n\nb\t\n") == "a\n\nb"
    assert one(spark, tx.prohibited_marker(a), a="NUNCA digas la palabra gratis.") == "la palabra gratis"
    assert one(spark, tx.prohibited_marker(a), a="Sé amable") is None
    assert one(spark, tx.valid_storage_key(a), a="t/documents/a.md") and not one(spark, tx.valid_storage_key(a), a="t/../x")


def test_templates_name_what_is_missing(spark):
    assert one(spark, tx.render_template("{{a}}-{{ b }}", {"a": F.lit("{{b}}"), "b": F.lit("2")})) == "{{b}}-2"
    with pytest.raises(Exception, match="missing variables: b, c"):
        one(spark, tx.render_template("{{a}} {{b}} {{c}}", {"a": F.lit("1")}))


# --- conversion ---


def test_html():
    c = markup.html_to_markdown("<html lang='ES-mx'><title> A &amp; B </title><body><nav>no</nav><h2>T <b>x</b></h2><p>a <strong>b</strong> <a href='/u'>l</a><script>z</script><ul><li>i</li></ul><table><tr><th>h</th><th>k</th></tr><tr><td>1</td><td>&lt;2</td></tr></table></body>")
    assert (c.title, c.language) == ("A & B", "es")
    assert c.markdown == "## T x\n\na **b** [l](/u)\n- i\n\n| h | k |\n| --- | --- |\n| 1 | <2 |"
    assert "no" not in markup.html_to_markdown("<main>yes</main><footer>no</footer>").markdown


def test_plain_text():
    t = convert.text_to_markdown("Manual\n======\n\nENVÍOS Y PLAZOS\n\n1.2. Detalle\ntexto\n\nNO ES TÍTULO.\n").markdown
    assert t == "# Manual\n\n## Envíos Y Plazos\n\n### Detalle\ntexto\n\nNO ES TÍTULO."


def test_csv():
    assert convert.parse_csv('a, b\n"x ""y""", "1\n2"\n\n,\n') == [["a", "b"], ['x "y"', "1\n2"]]
    c = convert.csv_to_markdown("a,b\n1\n1,2,3")
    assert c.markdown == "| a | b |\n| --- | --- |\n| 1 |  |\n| 1 | 2 |" and c.warnings


def test_convert_dispatch(spark):
    rows = [(1, b"# x", "text/markdown; charset=utf-8", "a"), (2, b"a,b", None, "t.CSV"), (3, b"?", "application/zip", "a.zip"), (4, b"not a zip", None, "a.docx"), (5, None, "text/plain", "x")]
    got = {r.doc_id: r for r in convert.convert(spark.createDataFrame(rows, "doc_id int, content binary, mime_type string, filename string")).collect()}
    assert got[1].markdown == "# x" and got[2].markdown.startswith("| a | b |")
    assert "no converter" in got[3].error and got[4].error and got[5].markdown == "" and got[5].warnings == ["too little text"]


def test_pdf_layout(spark):
    glyphs = [("d", 1, 0.0, 700.2, 24.0, "Title"), ("d", 1, 0.0, 600.0, 11.0, "body text that is long enough"), ("d", 2, 5.0, 700.0, 16.0, "b"), ("d", 2, 0.0, 700.1, 16.0, "Su"), ("d", 2, 0.0, 10.0, 11.0, "more body")]
    m = convert.pdf_markdown(convert.pdf_layout(spark.createDataFrame(glyphs, "doc_id string, page int, x double, y double, height double, text string"))).first()
    assert m.page_count == 2
    assert m.markdown == "<!--page:1-->\n\n# Title\n\nbody text that is long enough\n\n<!--page:2-->\n\n## Sub\n\nmore body"


# --- chunking ---


def test_sections():
    s = chunking.sections("## A\n<!--page:2-->\nx\n### B\ny\n## C\nz")
    assert [(x.text, x.breadcrumbs, x.page) for x in s] == [("x", ("A",), 2), ("y", ("A", "B"), 2), ("z", ("C",), 2)]
    assert chunking.sections("<!--page:3-->")[0].text == ""


def test_sentences_keep_abbreviations():
    assert chunking.sentences("Consulte la Ref. AX-4402 para más detalle. Gracias.") == ["Consulte la Ref. AX-4402 para más detalle.", "Gracias."]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["# a", "## b", "word " * 30, "x" * 500, "Una frase. Otra frase!", "", "ñ" * 40]), max_size=25).map("\n\n".join))
def test_chunk_bounds(markdown):
    o = chunking.Options(target=60, most=90, overlap=9, least=6)
    chunks = chunking.chunk_document(markdown, o)
    assert [c["ordinal"] for c in chunks] == list(range(len(chunks)))
    assert all(c["token_count"] == chunking.tokens(c["content"]) for c in chunks)
    assert all(c["token_count"] <= 1.5 * o.most for c in chunks if "x" * 400 not in c["content"])


def test_overlap_starts_at_a_word():
    a, b = chunking.overlapped(["uno dos tres cuatro", "cinco"], 3)
    assert b == "cuatro\n\ncinco" and a == "uno dos tres cuatro"


# --- cron, addresses ---


@pytest.mark.parametrize(
    ("expression", "at", "zone", "fires"),
    [
        ("0 9 * * 1-5", "2026-08-10 07:00:00", "Europe/Madrid", True), ("0 9 * * 1-5", "2026-08-09 07:00:00", "Europe/Madrid", False), ("0 0 1 * 1", "2026-06-01 00:00:00", "UTC", True),
        ("0 0 13 * 5", "2026-02-06 00:00:00", "UTC", True), ("0 0 */2 * 7", "2026-02-03 00:00:00", "UTC", True), ("5/10 * * * *", "2026-02-03 00:15:00", "UTC", False), ("@daily", "2026-02-03 00:00:00", "UTC", True),
        ("30 2 * * *", "2026-03-29 01:30:00", "Europe/Madrid", False),
    ],
)
def test_cron(spark, expression, at, zone, fires):
    assert one(spark, cron.matches(expression, F.lit(at).cast("timestamp"), zone)) is fires


@pytest.mark.parametrize("bad", ["* * * *", "60 * * * *", "a * * * *", "5-1 * * * *", "*/0 * * * *", ", * * * *", ""])
def test_bad_cron(bad):
    assert not cron.is_valid(bad)


@pytest.mark.parametrize(("address", "private"), [("8.8.8.8", False), ("10.1.2.3", True), ("172.32.0.1", False), ("169.254.169.254", True), ("::1", True), ("2001:4860::8888", False), ("::ffff:10.0.0.1", True), ("fd00::1", True), ("999.1.1.1", True), ("host", True)])
def test_addresses(spark, address, private):
    assert one(spark, net.is_private(F.lit(address))) is private


def test_fetchable():
    assert net.blocked_reason("file:///etc/passwd") == "scheme" and net.blocked_reason("http://x.com:22/") == "port"
    assert net.blocked_reason("http://127.0.0.1/") == "private_network" and net.blocked_reason("http://x.com", lambda h: []) == "unresolvable"
    assert net.blocked_reason("http://x.com", lambda h: ["8.8.8.8", "10.0.0.1"]) == "private_network" and net.blocked_reason("http://x.com", lambda h: ["8.8.8.8"]) is None


# --- sources ---


def test_web_parts():
    assert web.canonical("HTTP://A.com:80#x") == "http://a.com/"
    assert web.parse_robots("User-agent: other\nDisallow: /a\nUser-agent: *\nDisallow: /b # c\nDisallow:\n") == ["/b"]
    assert web.WebConfig.of({"startUrls": ["http://a"], "maxPages": 9999, "maxDepth": -3}).max_pages == 2000
    for bad in ({}, {"startUrls": ["ftp://a"]}, {"startUrls": ["http://a"], "includePatterns": ["("]}):
        with pytest.raises(web.ConnectorError):
            web.WebConfig.of(bad)
    with pytest.raises(web.ConnectorError):
        source_for("nothing")


def test_crawl(spark):
    page = lambda *to: "<title>t</title>" + "".join(f'<a href="{x}">x</a>' for x in to)
    site = {"http://a.com/": page("/b#x", "/private/p", "http://other.com/", "mailto:x@y"), "http://a.com/b": page("c"), "http://a.com/c": page("/d"), "http://a.com/d": page(), "http://a.com/private/p": page(), "http://other.com/": page()}
    pages = spark.createDataFrame(list(site.items()), "url string, html string")
    seen = pages.where("url = 'http://a.com/b'").select("url", F.sha2("html", 256).alias("checksum"))
    robots = spark.createDataFrame([("http://a.com", ["/private"])], "origin string, rules array<string>")
    got = {r.url: (r.depth, r.state) for r in web.crawl(pages, web.WebConfig(("http://a.com",), max_depth=2), seen, robots).collect()}
    assert got == {"http://a.com/": (0, "discovered"), "http://a.com/b": (1, "unchanged"), "http://a.com/c": (2, "discovered")}


def test_notes(spark):
    t = lambda s, **a: {"rich_text": [{"plain_text": s, "annotations": a}]}
    blocks = [
        {"type": "heading_1", "heading_1": t("H")}, {"type": "numbered_list_item", "numbered_list_item": t("a"), "children": [{"type": "to_do", "to_do": t("n") | {"checked": True}}]},
        {"type": "numbered_list_item", "numbered_list_item": t("b")}, {"type": "paragraph", "paragraph": t("p", bold=True, italic=True)}, {"type": "numbered_list_item", "numbered_list_item": t("c")},
        {"type": "unheard_of", "unheard_of": t("kept")}, {"type": "table", "table": {}, "children": [{"type": "table_row", "table_row": {"cells": [[{"plain_text": "x|y"}], []]}}]},
    ]
    assert notes.blocks_to_markdown(blocks) == "# H\n\n1. a\n- [x] n\n2. b\n_**p**_\n\n1. c\nkept\n\n| x\\|y |  |\n| --- | --- |"
    spans = F.lit(None).cast(f"array<{notes.SPAN}>")
    assert one(spark, notes.rich_text(spans)) == ""


def test_drive(spark):
    listing = [("f1", "root", "d", "application/vnd.google-apps.folder", 0, "1"), ("a", "f1", "a", "application/vnd.google-apps.spreadsheet", None, "1"), ("b", "root", "b", "application/pdf", 10, "1"), ("c", "root", "c", "image/png", 10, "1"), ("e", "else", "e", "application/pdf", 1, "1"), ("g", "root", "g", "application/pdf", files.MAX_BYTES + 1, "1")]
    at = spark.createDataFrame(listing, "id string, parent_id string, name string, mime_type string, size long, modified string")
    got = files.drive_listing(at, ["root"], spark.createDataFrame([("b", "0")], "id string, modified string"))
    assert {(r.id, r.export, r.mime_type) for r in got.collect()} == {("a", True, "text/csv"), ("b", False, "application/pdf")}


# --- retrieval, lexical, grounding ---


def test_rrf_ties_and_branches(spark):
    v = spark.createDataFrame([(1, "a", 0.9, 1), (1, "b", 0.8, 2)], "query_id int, id string, similarity double, vector_rank int")
    x = spark.createDataFrame([(1, "b", 1), (1, "c", 2)], "query_id int, id string, lexical_rank int")
    got = retrieval.fuse_rrf(v, x).orderBy("rank").collect()
    assert [(r.id, r.matched_by) for r in got] == [("b", ["vector", "lexical"]), ("a", ["vector"]), ("c", ["lexical"])]
    assert got[2].similarity is None and abs(got[0].score - (1 / 62 + 1 / 61)) < 1e-12


def test_vectors(spark):
    with pytest.raises(ValueError):
        vectors.column_for(7)
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0, 1.0])], "id int, embedding array<double>")
    q = spark.createDataFrame([("q", [1.0, 0.0]), ("zero", [0.0, 0.0])], "query_id string, embedding array<double>")
    assert [(r.query_id, r.id, r.similarity) for r in retrieval.vector_topk(rows, q).orderBy("vector_rank").collect()] == [("q", 1, 1.0), ("q", 3, 0.707107)]
    docs = spark.createDataFrame([(1, "hola mundo hola"), (2, "")], "doc_id int, text string")
    d = vectors.dense(vectors.embedding_slots(docs, "doc_id", "text", 16), "doc_id", 16).collect()
    assert len(d) == 1 and abs(sum(x * x for x in d[0].embedding) - 1) < 1e-6


def test_websearch(spark):
    terms = lexical.identity_analyser(F.lit("el envío tarda dos días"))
    for q, hit in (("envío días", True), ("envío -dos", False), ('"tarda dos"', True), ('"dos tarda"', False), ("nada or días", True), ("", False), ('-"x y" envío', True), ('"', False)):
        assert one(spark, lexical.matches(terms, q)) is hit, q


def test_grounding(spark):
    a = spark.createDataFrame([(1, True, "ok", [("c", "PLAZO de")]), (2, True, "x", []), (3, True, "es gratis", [("zz", "q"), ("c", "")]), (4, False, "no", [])], "answer_id int, answered boolean, response string, citations array<struct<chunk_id:string,quote:string>>")
    r = spark.createDataFrame([(i, "c", "El plazo\nde entrega") for i in (1, 2, 3)], "answer_id int, chunk_id string, content string")
    p = spark.createDataFrame([(3, "Nunca digas gratis.")], "answer_id int, rule string")
    got = {x.answer_id: (x.valid, [f.kind for f in x.failures]) for x in grounding.validate(a, r, p).collect()}
    assert got == {1: (True, []), 2: (False, ["answered_without_citations"]), 3: (False, ["unknown_chunk", "quote_not_found", "prohibited_content"]), 4: (True, [])}


def test_answers_degrade(spark):
    q = spark.createDataFrame([(1, "q", True), (2, "q", False), (3, "q", True)], "query_id int, question string, passed boolean")
    hits = spark.createDataFrame([(1, 1, "a", "\nfirst line\nx")], "query_id int, rank int, id string, content string")
    got = {r.query_id: r for r in grounding.answer(q, hits).collect()}
    assert got[1].answer.response == "first line" and not got[1].degraded and not got[2].answer.answered and not got[3].answer.answered
    liar = lambda question, h: F.struct(F.lit(True).alias("answered"), F.lit("x").alias("response"), F.array(F.struct(F.lit("a").alias("chunk_id"), F.lit("no such").alias("quote"))).alias("citations"), F.array().cast("array<string>").alias("rules_applied"))
    assert {r.query_id: r.degraded for r in grounding.answer(q, hits, liar).collect()} == {1: True, 2: False, 3: True}
    assert one(spark, grounding.parse_answer(F.lit('{"answered": true}'))) is None


# --- gaps, context, prompts, evaluation ---


def test_gap_stream(spark):
    rows = [("t", 1, "¿Cuánto cuesta?", "R1", [1.0, 0.0]), ("t", 2, "cuanto cuesta", "R2", [1.0, 0.01]), ("t", 3, "otra cosa", "R1", [0.9, 0.1]), ("u", 4, "¿Cuánto cuesta?", "R1", [1.0, 0.0])]
    q = spark.createDataFrame(rows, "tenant_id string, asked_at int, question string, reason string, embedding array<double>")
    got = {(r.tenant_id, r.question): (r.occurrences, r.reason, r.variants) for r in gaps.group_stream(q).collect()}
    assert got == {("t", "¿Cuánto cuesta?"): (2, "R1", ["cuanto cuesta"]), ("t", "otra cosa"): (1, "R1", []), ("u", "¿Cuánto cuesta?"): (1, "R1", [])}
    joined = {(r.tenant_id, r.question): r.occurrences for r in gaps.group_stream(q, lambda question, near: 0).collect()}
    assert joined == {("t", "¿Cuánto cuesta?"): 3, ("u", "¿Cuánto cuesta?"): 1}


def test_packing(spark):
    items = F.array(*[F.struct(F.lit(c).cast("bigint").alias("cost"), F.lit(i).alias("id")) for i, c in (("a", 6), ("b", 9), ("d", 4))])
    got = one(spark, context.greedy(items, F.lit(10)))
    assert got.used == 10 and [x.id for x in got.kept] == ["a", "d"]
    assert one(spark, context.share_for("rules", F.lit(1000))) == 600 and one(spark, context.share_for("rules", F.lit(-5))) == 0
    with pytest.raises(ValueError):
        context.share_for("identity", F.lit(1))
    with pytest.raises(Exception, match="fixed slots"):
        one(spark, context.remaining_after(F.lit(5), F.lit(6)))


def test_prompt_files():
    assert prompts.parse_prompt_file("---\nkey: a.b\nversion: 3\n---\nHola {{x}}\n") == {"key": "a.b", "version": 3, "template": "Hola {{x}}"}
    with pytest.raises(ValueError):
        prompts.parse_prompt_file("no head")


def test_empty_evaluation(spark):
    cases = spark.createDataFrame([], "id string, kind string, history array<string>, expected_sources array<string>, expected_contains array<string>, must_not_contain array<string>, expects_rewrite boolean")
    outcomes = spark.createDataFrame([], "case_id string, kind string, answered boolean, retrieved array<string>, response string, latency_ms long, cost double, grounding_failures array<string>, source_found boolean, rewritten boolean")
    m = evaluation.metrics(cases, outcomes).first()
    assert (m.recall_at_k, m.correct_abstention, m.hallucination_rate, m.over_abstention, m.latency_p95) == (1.0, 1.0, 0.0, 0.0, 0.0)
    assert evaluation.gate(evaluation.metrics(cases, outcomes)).first().passed
    assert evaluation.composition_warnings(cases).first().warnings == ["empty"]


# --- ingestion, tenancy, events ---


def test_versions(spark):
    docs = spark.createDataFrame([("t", "d1", "ref", "T", None)], "tenant_id string, id string, source_ref string, title string, source_id string")
    incoming = spark.createDataFrame([("t", None, "ref", "T", None, "new text"), ("t", None, None, "N", None, "x"), ("t", "gone", None, "G", None, "x"), ("u", None, "ref", "T", None, "x")], "tenant_id string, document_id string, source_ref string, title string, source_id string, markdown string")
    got = ingest.resolve_documents(incoming, docs)
    assert sorted((r.tenant_id, r.title, r.state) for r in got.collect()) == [("t", "G", "missing"), ("t", "N", "new"), ("t", "T", "known"), ("u", "T", "new")]
    now = F.lit("2026-01-01").cast("timestamp")
    old = ingest.new_versions(spark.createDataFrame([("t", "d1", "old", "old")], "tenant_id string, resolved_id string, checksum string, markdown string"), spark.createDataFrame([], "document_id string, version int"), now)
    made = ingest.new_versions(ingest.changed(got, old).where("resolved_id = 'd1'"), old, now)
    both = ingest.superseded(old, made, now)
    assert sorted((r.version, r.is_active) for r in both.collect()) == [(1, False), (2, True)]
    assert not ingest.changed(got, both).where("resolved_id = 'd1'").count()


def test_tenants_fail_closed(spark, tmp_path):
    with pytest.raises(tenancy.TenantError):
        tenancy.TenantCatalog(spark, str(tmp_path), " ")
    with pytest.raises(tenancy.TenantError):
        tenancy.TenantCatalog.system(spark, str(tmp_path), "")
    rows = spark.createDataFrame([(1,)], "x int")
    for t in ("tenant-aa", "tenant-bb"):
        tenancy.TenantCatalog(spark, str(tmp_path), t).write(rows, "chunk")
    assert tenancy.TenantCatalog(spark, str(tmp_path), "tenant-aa").table("chunk").count() == 1
    assert tenancy.TenantCatalog.system(spark, str(tmp_path), "a test").table("chunk").count() == 2
    key = F.lit("0123456789abcdef")
    assert one(spark, tenancy.opened(tenancy.sealed(F.lit("s"), key), key)) == "s"


def test_dispatcher_and_trace():
    d = events.Dispatcher()

    def fail(e):
        raise events.HandlingError("no", permanent=e["id"] == 2)

    d.on("knowledge.gap", "h", fail)
    assert d.run({"id": 1, "type": "knowledge.gap", "attempts": 1})[0] == "PENDING"
    assert d.run({"id": 1, "type": "knowledge.gap", "attempts": 5})[0] == "DEAD" and d.run({"id": 2, "type": "knowledge.gap", "attempts": 1})[0] == "DEAD"
    assert d.run({"id": 3, "type": "usage.recorded", "attempts": 1}) == ("DONE", None)
    t = events.Trace("x", sampling=1.5)
    t.step("a", 3, 0.5, "c")
    assert t.close() == {"trace_id": "x", "steps": 1, "tokens": 3, "cost": 0.5} and t.steps[0]["content"] == "c"
    with pytest.raises(RuntimeError):
        t.close()


# --- streams ---


def test_outbox_stream(spark, tmp_path):
    from marlstone.streaming import outbox

    at = dt.datetime(2026, 1, 1)
    rows = [("1", "t", "knowledge.gap", '{"question": "q", "reason": "r"}', at, 0), ("2", "t", "knowledge.gap", "{}", at, 0), ("3", "t", "usage.recorded", "{}", at, 0), ("4", "t", "knowledge.gap", '{"question": "bad", "reason": "r"}', at, 4)]
    path = str(tmp_path / "events")
    outbox.publish(spark.createDataFrame(rows, outbox.SCHEMA), path)
    handle = lambda df: df.select("id", F.when(F.get_json_object("payload", "$.question") == "bad", "failed").alias("error"))
    for _ in range(2):  # the second run finds nothing new
        outbox.drain(spark, path, str(tmp_path / "out"), str(tmp_path / "ck"), {"knowledge.gap": handle}).awaitTermination()
    assert sorted((r.id, r.status) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [("1", "DONE"), ("2", "DEAD"), ("3", "DONE"), ("4", "DEAD")]


def test_limiter_stream_equals_batch(spark, tmp_path):
    from marlstone.streaming import limiter

    rows = [(1, i, dt.datetime(2026, 1, 1, 0, 0, s)) for i, s in enumerate((0, 1, 2, 30, 59))] + [(1, 9, dt.datetime(2026, 1, 1, 0, 1, 0)), (2, 10, dt.datetime(2026, 1, 1))]
    at = spark.createDataFrame(rows, "key_id bigint, event_id bigint, ts timestamp").withColumn("ms", F.unix_millis("ts"))
    at.write.parquet(str(tmp_path / "in"))
    stream = limiter.limited(spark.readStream.schema(at.schema).parquet(str(tmp_path / "in")), 2)
    stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
    got = sorted((r.event_id, r.allowed, r.retry_after) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == sorted((r.event_id, r.allowed, r.retry_after) for r in events.limited(at, 2).collect())
    assert [x[1] for x in got] == [True, True, False, False, False, True, True]


def test_limiter_by_event_time_forgets_closed_windows(spark, tmp_path):
    from marlstone.streaming import limiter

    start = dt.datetime(2026, 1, 1)
    rows = [(k % 20 + 20 * (k // 100), k, start + dt.timedelta(seconds=3 * k)) for k in range(600)]  # twenty keys at a time, others every five minutes
    at = spark.createDataFrame(rows, "key_id bigint, event_id bigint, ts timestamp")
    for k in range(6):
        at.where(f"event_id >= {100 * k} and event_id < {100 * k + 100}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(at.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run = limiter.limited_by_event_time(stream, 2).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    run.awaitTermination()
    got = sorted((r.event_id, r.allowed, r.retry_after) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == sorted((r.event_id, r.allowed, r.retry_after) for r in events.limited(at, 2).collect()) and len(got) == 600
    states = [p["stateOperators"][0]["numRowsTotal"] for p in run.recentProgress if p["stateOperators"]]
    assert states[-1] <= 3 * 20 < 3 * 120, states  # 120 keys have been seen
