"""Ingest, office files, schema changes, extension points and the compare-and-set stream."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from quarry import extend, ingest
from quarry.functions.filters import Leaf
from quarry.operators import changefeed, rerank
from quarry.session import scratch, stage, sweep
from quarry.sources import documents, files, office, schema
from quarry.streaming import spans

INPUTS = "input_id long, namespace string, source_id string, text string, writer_namespace string"
RECORDS = "row_id long, namespace string, source_id string, stable_key string, record_id string, body_text string, tx_to timestamp"
FIRST = "# A\n\nalpha\n\n# B\n\nbeta\n\n# A\n\nagain"


def test_ingest_asserts_supersedes_and_passes_over(spark):
    one = spark.createDataFrame([(1, "n", "s", FIRST, "n"), (2, "n", "x", "text", "m"), (3, "n", "e", None, "n"), (4, None, "s", "t", "n"), (1, "n", "s", FIRST, "n")], INPUTS)
    none = spark.createDataFrame([], RECORDS)
    ops = ingest.operations(one, none).collect()
    assert sorted((r.kind, r.stable_key, r.body_text) for r in ops) == [("assert", "s/A#0", "alpha"), ("assert", "s/A@1#0", "again"), ("assert", "s/B#0", "beta")]
    live = spark.createDataFrame([(n, "n", "s", r.stable_key, r.record_id, r.body_text, None) for n, r in enumerate(ops)], RECORDS)
    assert ingest.operations(one, live).count() == 0  # nothing changed
    edited = spark.createDataFrame([(9, "n", "s", FIRST.replace("beta", "BETA").replace("\n\n# A\n\nagain", ""), "n")], INPUTS)
    got = ingest.operations(edited, live).collect()
    assert [(r.kind, r.stable_key) for r in got] == [("supersede", "s/B#0")] and got[0].old_id == next(r.record_id for r in ops if r.stable_key == "s/B#0")
    pruned = {(r.kind, r.stable_key) for r in ingest.operations(edited, live, prune=True).collect()}
    assert pruned == {("supersede", "s/B#0"), ("forget", "s/A@1#0")}
    assert ingest.operations(edited, live, preconditions=[lambda new, old: old.isNull()]).count() == 0


def test_commit_numbers_logs_and_applies(spark):
    store, log, seen = changefeed.BucketStore(spark, scratch(spark, "t"), 4), scratch(spark, "log"), []
    none = spark.createDataFrame([], RECORDS)
    one = ingest.operations(spark.createDataFrame([(1, "n", "s", FIRST, "n")], INPUTS), none)
    assert ingest.commit(one, log, store, [lambda rows: seen.append(rows.count())]) == 3 and seen == [3]
    live = store.live().withColumns({"row_id": F.lit(1).cast("long"), "body_text": F.lit(""), "tx_to": F.lit(None).cast("timestamp")})
    two = ingest.operations(spark.createDataFrame([(2, "n", "s", FIRST.replace("beta", "BETA"), "n")], INPUTS), live)
    assert ingest.commit(two, log, store) == 1
    assert sorted(r.position for r in spark.read.parquet(log).collect()) == [1, 2, 3, 4] and store.live().count() == 3


def _zip(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name.replace("__", "/"), text)
    return out.getvalue()


def test_office_files(spark):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    doc = f'<w:document {w}><w:body><w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p><w:p><w:r><w:t>One</w:t><w:tab/><w:t>two</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a|b</w:t></w:r></w:p></w:tc><w:tc><w:p/></w:tc></w:tr></w:tbl></w:body></w:document>'
    assert office.file_text("x.docx", _zip(**{"word__document.xml": doc})) == "## Head\n\nOne\ttwo\n\n| a\\|b |  |\n|---|---|"
    a = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"'
    slide = lambda *t: f"<s {a}>" + "".join(f"<a:p><a:r><a:t>{x}</a:t></a:r></a:p>" for x in t) + "</s>"
    assert office.file_text("x.pptx", _zip(**{"ppt__slides__slide2.xml": slide("Two", "b"), "ppt__slides__slide1.xml": slide("One"), "ppt__slides__slide10.xml": slide()})) == "## One\n\n## Two\n\nb\n\n## Slide 10"
    m = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    book = {
        "xl__workbook.xml": f'<workbook {m}><sheets><sheet name="Costs"/></sheets></workbook>', "xl__sharedStrings.xml": f"<sst {m}><si><t>name</t></si></sst>",
        "xl__worksheets__sheet1.xml": f'<worksheet {m}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1"><v>4.5</v></c></row><row><c r="B2" t="inlineStr"><is><t>x</t></is></c></row></sheetData></worksheet>',
    }
    assert office.file_text("x.xlsx", _zip(**book)) == "## Costs\n\n| name |  | 4.5 |\n|---|---|---|\n|  | x |  |"
    assert office.file_text("x.docx", b"junk") is None and office.file_text("x.bin", b"a") is None and office.file_text("x.md", None) is None
    assert office.file_text("x.csv", "a,b\n1,\"2\n3\"\n".encode()) == "| a | b |\n|---|---|\n| 1 | 2 3 |"
    assert office.metadata_section({"Title": "T ``` x", "Author": None}) == "```\nTitle: T ''' x\n```" and office.metadata_section({}) == ""


def test_schema_changes_apply_once(spark):
    path, done = scratch(spark, "store"), []
    changes = {1: lambda s, p: done.append(1), 2: lambda s, p: done.append(2)}
    assert schema.migrate(spark, path, {1: changes[1]}) == [1] and schema.migrate(spark, path, changes) == [2] and schema.migrate(spark, path, changes) == []
    assert done == [1, 2] and schema.version(spark, path) == 2
    with pytest.raises(ValueError):
        schema.migrate(spark, path, {2: changes[2]})


def test_regression_sets_and_staged_folders(spark, tmp_path):
    (tmp_path / "c.yaml").write_text("- query: q\n  expected_content_substrings: [a]\n  principal_namespace: n\n")
    assert [tuple(r) for r in documents.regression_cases(spark, str(tmp_path / "c.yaml")).collect()] == [(0, "q", ["a"], 0.5, "n")]
    (tmp_path / "d.json").write_text('{"query": "q"}')
    with pytest.raises(ValueError):
        documents.regression_cases(spark, str(tmp_path / "d.json"))
    path = stage(spark.range(3), "x").inputFiles()[0].rsplit("/", 1)[0]
    assert files.exists(spark, path) and sweep(spark) > 0 and not files.exists(spark, path)


class Plain:
    kind, cost_ms = "plain", 1

    def run(self, rows, query, k):
        return rows.limit(k)

    def probe(self, rows, node):
        return rerank.reference_operator(rows, node)


class Leaky(Plain):
    kind = "leaky"

    def probe(self, rows, node):
        return rows.where(F.lit(isinstance(node, Leaf)))


def test_registry_refuses_what_breaks_a_rule(spark):
    registry = extend.Registry(spark)
    registry.register(Plain())
    assert registry.get("plain").cost_ms == 1
    for bad in (Leaky(), Plain()):
        with pytest.raises(ValueError):
            registry.register(bad)


def test_model_slots(spark):
    df = spark.createDataFrame([(1, "red fox"), (2, None), (3, ""), (4, "boom")], "id int, text string")
    rows = {r.id: r for r in extend.embedded(df, extend.HashEmbedder(8)).collect()}
    assert rows[2].embedding is None and rows[3].embedding == [0.0] * 8 and abs(sum(x * x for x in rows[1].embedding) - 1) < 1e-6 and rows[1].producer_version == "hash-1-8"
    units = {r.id: r.u for r in extend.embedded(df, extend.HashEmbedder(8)).select("id", extend.unit(F.col("embedding")).alias("u")).collect()}
    assert units[3] is None and units[2] is None and len(units[1]) == 8

    def translate(batch):
        if batch[0] == "boom":
            raise RuntimeError("no such language")
        return [x.upper() or None for x in batch]

    said = {r.id: (r.gloss, r.warning) for r in extend.glossed(df, translate).collect()}
    assert said == {1: ("[Machine translation] RED FOX", None), 2: (None, None), 3: (None, None), 4: (None, "RuntimeError: no such language")}
    assert extend.described(df, None).where("description is not null").count() == 0


def test_compare_and_set_over_a_stream(spark):
    kind = "namespace string, source_id string, stable_key string, op_seq long, kind string, record_id string, old_id string"
    rows = [("n", "s", k, *r) for k in "pq" for r in ((1, "assert", "A", None), (2, "assert", "A", None), (3, "supersede", "B", "A"), (4, "supersede", "C", "A"), (5, "forget", None, "B"), (6, "assert", "D", None), (7, "assert", "E", None))]
    folder, out = scratch(spark, "events"), scratch(spark, "out")
    for part in (rows[:3] + rows[7:12], rows[3:7] + rows[12:]):
        spark.createDataFrame(part + part[:1], kind).coalesce(1).write.mode("append").parquet(folder)
        stream = spans.outcomes(spark.readStream.schema(kind).parquet(folder))
        stream.writeStream.format("parquet").option("checkpointLocation", f"{out}-c").trigger(availableNow=True).start(out).awaitTermination()
    got = {(r.stable_key, r.op_seq): r.outcome for r in spark.read.schema(spans.OUT).parquet(out).where("op_seq > 1").collect()}
    want = {2: "unchanged", 3: "superseded", 4: "refused", 5: "forgotten", 6: "created", 7: "converted"}
    assert got == {(k, n): w for k in "pq" for n, w in want.items()}


def test_verbs_over_http(spark):
    import json
    import threading
    import urllib.error
    import urllib.request

    from quarry import surface
    from quarry.context import Principal
    from quarry.plans.search import Frames

    docs = spark.createDataFrame([(1, "cat and hat", "a", "x"), (2, "cat", "b", "y")], "doc_id long, text string, namespace string, source string")
    records = spark.createDataFrame([(1, "r1", "a", ["x", "H"], None)], "row_id long, record_id string, namespace string, section_path array<string>, tx_to timestamp")
    log = spark.createDataFrame([(1, "a", "assert", "r1", None), (2, "b", "assert", "r2", None), (3, "a", "forget", None, "r1")], "op_seq long, namespace string, kind string, record_id string, target_id string")
    traces, judged = [], []
    service = surface.Service(Frames(docs), records, log, b"k", traces.append, judged.append, available=("grep",))
    web = surface.server(service, {"t": Principal("p", "a")}.get, 0)
    threading.Thread(target=web.serve_forever, daemon=True).start()

    def ask(verb, token="t", **arguments):
        request = urllib.request.Request(f"http://127.0.0.1:{web.server_port}/{verb}", json.dumps(arguments).encode(), {"Authorization": f"Bearer {token}"})
        try:
            with urllib.request.urlopen(request, timeout=60) as got:
                return got.status, json.loads(got.read())["result"]
        except urllib.error.HTTPError as failed:
            return failed.code, None

    try:
        status, found = ask("search", query="cat")
        assert status == 200 and len(found["hits"]) == 1 and found["status"] == "sufficient" and len(traces) == 1
        hit = found["hits"][0]["hit_id"]
        assert ask("fetch", hit_id=hit)[1]["text"] == "cat and hat" and ask("fetch", hit_id="junk") == (200, None)
        assert ask("feedback", hit_id=hit, useful=True) == (200, True) and judged[0].first().record_id == "1"
        assert ask("navigate", ref="x")[1][0]["records"] == 1 and ask("since")[1]["marker"] == 3
        assert "acl_filter{namespace=a}" in ask("explain", query="cat")[1]["plan"]
        assert ask("search", token="no", query="cat")[0] == 401 and ask("search", namespace="b", query="cat")[0] == 400 and ask("drop")[0] == 404
        assert surface.answer(service, {}.get, "search", "t", b"x" * (surface.BODY + 1))[0] == 413
    finally:
        web.shutdown()
