from pyspark.sql import functions as F

from folioflow.operators import polish, reports
from folioflow.plans.providers import ModelOptions, Pacer, captioner, context_of, join_content, renderer, with_retries
from folioflow.sources import sinks
from folioflow.sources.files import blocks_of, extract


class Echo:
    def caption(self, context, content):
        if content == b"bad":
            raise ValueError("no")
        return [{"type": "text", "text": f" {len(content)} "}, "x", {"type": "other"}]

    def render(self, markdown, tail):
        return f"{markdown}|{tail}"


def test_pacer_and_retries():
    now, slept = [0.0], []

    def sleep(s):
        slept.append(s)
        now[0] += s

    p = Pacer(60, 2, clock=lambda: now[0], sleep=sleep)
    for _ in range(3):
        p.wait()
    assert slept == [2.0, 2.0]
    assert with_retries(lambda: 1 / 0, 3, "f", sleep=slept.append) == "f" and slept[2:] == [1, 2]
    assert ModelOptions(Echo).paced(9).requests_per_minute == 9 and ModelOptions(Echo, requests_per_minute=3).paced(9).requests_per_minute == 3
    assert join_content("a") == "a" and "Label: L" in context_of({"container_kind": "k", "container_index": 1, "label": "L"}, ModelOptions(Echo))


def test_captioner(spark):
    rows = [(1, "a", b"123", None), (1, "b", None, "alt"), (1, "c", b"<svg/>", None), (2, "d", b"bad", "fall"), (2, "e", None, None)]
    refs = spark.createDataFrame([(d, i, "k", 1, None, alt, None, bytearray(c) if c is not None else None) for d, i, c, alt in rows], "doc_id long, image_id string, container_kind string, container_index int, label string, alt_text string, context_text string, content binary")
    got = {r["image_id"]: r["caption"] for r in captioner(ModelOptions(Echo, attempts=1, tasks=2))(refs).collect()}
    assert got == {"a": "3  x", "b": "alt", "c": "[SVG diagram: caption unavailable]", "d": "fall", "e": "[Image: not found]"}


def test_renderer(spark):
    chunks = spark.createDataFrame([(1, 0, "m", None), (1, 1, "n", "m")], "doc_id long, chunk_index int, markdown string, previous_tail string")
    assert [r["markdown"] for r in renderer(ModelOptions(Echo))(chunks).orderBy("chunk_index").collect()] == ["m|", "n|m|"]
    # Two renderers of one function have a model each.
    makes = [lambda k=k: type("Said", (), {"render": lambda self, md, tail: f"{k}{md}"})() for k in (1, 2)]
    assert [renderer(ModelOptions(m, tasks=1))(chunks).orderBy("chunk_index").first()["markdown"] for m in makes] == ["1m", "2m"]


def test_polish(spark):
    df = spark.createDataFrame([("x\nPage 1 of 4\ny\nPage 2 of 4",)], "t string")
    assert df.select(polish.without_lines(F.col("t"), F.array(F.lit("Page 7 of 4")))).first()[0] == "x\ny"
    assert df.select(polish.with_title(F.lit("# T\nx"), F.lit("Q"))).first()[0] == "# T\nx"
    assert df.select(polish.without_fluff(F.lit("is a powerful data tool, a rich API"))).first()[0] == "is a data tool, an API"


def test_articles_that_do_not_fit_the_adjective_stay(spark):
    cases = {"auxeux an an rich works": "auxeux an an works", "An robust, open base": "An open base", "an innovative, rich tool": "a tool", "an rich (x)": "an (x)", "a rich works": "a works"}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r["t"]: r["md"] for r in df.select("t", polish.without_fluff(F.col("t")).alias("md")).collect()} == cases


def test_sinks_and_audit(spark, tmp_path):
    docs = extract(spark.createDataFrame([(1, "html", "<h1>a</h1><p>bcd</p>"), (2, "markdown", "")], "doc_id long, format string, content string"))
    sinks.write_dump(docs, f"{tmp_path}/d")
    assert spark.read.parquet(f"{tmp_path}/d/blocks").count() == 2 and spark.read.parquet(f"{tmp_path}/d/warnings").count() == 1
    sinks.write_markdown(spark.createDataFrame([(1, "a\nb")], "doc_id long, markdown string"), f"{tmp_path}/m")
    assert [r[0] for r in spark.read.text(f"{tmp_path}/m/doc_id=1").collect()] == ["a", "b"]
    raw = spark.createDataFrame([(1, 1, 1, 0, 4), (2, 0, 0, 0, 0)], "doc_id long, n_headings int, n_images int, n_tables int, n_chars int")
    report = reports.audit(blocks_of(docs), raw)
    assert {r["doc_id"]: (r["coverage_pct"], r["notes"]) for r in report.collect()} == {1: (100.0, "img diff"), 2: (0.0, "OK")}
    assert [r["line"] for r in reports.audit_markdown(report).collect()] == ["| doc_id | coverage % | notes |", "| --- | --- | --- |", "| 1 | 100.0 | img diff |", "| 2 | 0.0 | OK |"]
    sizes = spark.createDataFrame([("a", 4, 2), (None, 2, 2)], "k string, raw long, clean long")
    assert {r["sample"]: r["raw_bytes"] for r in reports.size_report(sizes, "k", "raw", "clean").collect()} == {"a": 4, None: 2, "TOTAL": 6}


def test_providers_speak_their_interfaces(monkeypatch):
    """Each provider against a small server on this machine."""
    import json
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    import pytest

    from folioflow.plans.providers import HttpChat, ModelConfig, PromptedModel, build_chat

    seen = []
    answers = {"/chat/completions": {"choices": [{"message": {"content": "said"}}]}, "/serving-endpoints/m/invocations": {"choices": [{"message": {"content": "said"}}]}, "/v1/messages": {"content": [{"type": "text", "text": "said"}]}, "/v1beta/models/m:generateContent": {"candidates": [{"content": {"parts": [{"text": "said"}]}}]}}

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            seen.append((self.path, json.loads(self.rfile.read(int(self.headers["Content-Length"]))), dict(self.headers)))
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps(answers[self.path]).encode())

        def log_message(self, *a):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    monkeypatch.setenv("A_KEY", "k1")
    base = f"http://127.0.0.1:{server.server_port}"
    try:
        for provider in ("openai", "databricks", "anthropic", "google"):
            chat = build_chat(ModelConfig(provider, "m", base, "A_KEY", extra=(("seed", 3),)))
            assert chat.ask("be brief", "what", b"png") == "said"
            path, body, headers = seen[-1]
            assert path in answers and body["seed"] == 3 and "k1" in str(headers) and "cG5n" in json.dumps(body) and "be brief" in json.dumps(body)
    finally:
        server.shutdown()
    for bad in (ModelConfig("custom"), ModelConfig("nobody"), ModelConfig("databricks", "m")):
        with pytest.raises(ValueError):
            build_chat(bad)
    assert HttpChat(ModelConfig("openai", "m")).base.startswith("https://")

    class Chat:
        def __init__(self):
            self.asked = []

        def ask(self, system, text, image=None):
            self.asked.append((system, text, image))
            return f"out{len(self.asked)}"

    for review, clean, calls in ((False, False, 1), (True, False, 2), (False, True, 2), (True, True, 3)):
        own = PromptedModel(ModelConfig("custom", instance=(chat := Chat())), review=review, clean=clean, caption_language="en")
        assert own.render("draft", "tail") == f"out{calls}" and len(chat.asked) == calls and "tail" in chat.asked[0][1] and all("draft" in t for _, t, _ in chat.asked)
        assert own.caption("ctx", b"i") == f"out{calls + 1}" and "English" in chat.asked[-1][0] and "Decorative image" in chat.asked[-1][0]


def test_convert_options(spark, tmp_path):
    from folioflow.plans.convert import ConvertOptions, convert

    docs = extract(spark.createDataFrame([(1, "html", "<title>T</title><p>head 1</p><p>A powerful tool.</p><p>head 2</p>")], "doc_id long, format string, content string"))
    lines = spark.createDataFrame([(1, ["head 9"])], "doc_id long, lines array<string>")
    row = convert(docs, ConvertOptions(polish=True, repeated=lines, return_blocks=True, debug_workspace=f"{tmp_path}/w")).first()
    assert row["markdown"] == "# T\n\nA tool.\n" or row["markdown"].strip() == "# T\n\nA tool.", row["markdown"]
    assert len(row["blocks"]) == 3 and spark.read.parquet(f"{tmp_path}/w").count() == 1
