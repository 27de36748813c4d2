import json
import random
import re

import pytest
from graphloom.operators import blocks, spans
from graphloom.sources import readers

BLOCK = "document_id string, block_no int, page_number int, block_type string, text string, category string"


def merge_model(rows):
    out, pending = [], None
    for no, category, text in rows:
        if category in ("heading", "equation"):
            if pending:
                out.append(pending)
            out.append((no, category, text))
            pending = None
            continue
        if pending:
            joined = re.sub(r"-\s*$", "", pending[2]) if re.search(r"[A-Za-z]-\s*$", pending[2]) else pending[2] + " "
            no, category, text = pending[0], pending[1], (joined + text).strip()
        pending = None
        if re.search(r"[.!?。]\s*\d*\s*$", text):
            out.append((no, category, text))
        else:
            pending = (no, category, text)
    return out + ([pending] if pending else [])


def test_merge_against_a_sequential_model(spark):
    r = random.Random(7)
    docs = {}
    for d in range(60):
        docs[str(d)] = [(i, r.choice(["heading", "equation", "main_text", "main_text", "abstract"]), r.choice(["It grew.", "It grew", "hyphen-", "and on", "end.12", "末尾。"])) for i in range(r.randint(1, 9))]
    df = spark.createDataFrame([(d, i, i + 1, "text", t, c) for d, rows in docs.items() for i, c, t in rows], BLOCK)
    got = {}
    for x in blocks.merged(df).orderBy("document_id", "block_no").collect():
        got.setdefault(x.document_id, []).append((x.block_no, x.category, x.text))
    assert got == {d: merge_model(rows) for d, rows in docs.items()}


def gates_model(rows):
    out, title, refs, body = [], False, False, False
    for no, kind, text in rows:
        stop = bool(re.search("[.!?。！？]", text))
        if kind == "title":
            title = True
        elif not title and ("doi.org" in text or re.search(r"(?i)\bjournal\b", text) or (len(text) < 30 and not stop)):
            continue
        if text.startswith("Keywords"):
            continue
        refs = refs or text == "References"
        if refs:
            continue
        if kind != "title" and title and not body and len(text) < 200 and not stop:
            continue
        if kind != "title" and len(text) >= 100:
            body = True
        out.append(no)
    return out


def test_gates_against_a_sequential_model(spark):
    r = random.Random(3)
    texts = ["Short scrap", "A sentence of the paper.", "See journal page for more of this.", "Keywords: a", "References", "word " * 30, "word " * 30 + "end.", "An author list without stop but long enough"]
    docs = {str(d): [(i, r.choice(["title", "text", "text", "text"]), r.choice(texts).strip()) for i in range(r.randint(1, 12))] for d in range(120)}
    df = spark.createDataFrame([(d, i, 1, k, t) for d, rows in docs.items() for i, k, t in rows], "document_id string, block_no int, page_number int, block_type string, text string")
    got = {}
    for x in blocks.gated(df).orderBy("document_id", "block_no").collect():
        got.setdefault(x.document_id, []).append(x.block_no)
    assert got == {d: m for d, rows in docs.items() if (m := gates_model(rows))}


def test_parser_output_to_markdown(spark):
    text = lambda t: {"type": "text", "content": t}
    pages = [
        [{"type": "page_header", "content": {"x": text("Head")}}, {"type": "title", "bbox": [1, 2, 3, 4], "content": {"title_content": [text("A title")]}}, {"type": "paragraph", "content": {"p": [text("Abstract: The energy "), {"type": "equation_inline", "content": "E_0"}, text(" of the film was measured in every state , over many days and nights and all of it held, as far as seen.")]}}],
        [{"type": "interline_equation", "content": {"m": {"type": "interline_equation", "content": "a=b"}}}, {"type": "paragraph", "content": [text("It did not re-")]}, {"type": "image", "content": "x"}],
        [{"type": "paragraph", "content": [text("cover.")]}, {"type": "title", "content": [text("References")]}, {"type": "paragraph", "content": [text("gone.")]}],
    ]
    files = spark.createDataFrame([("d", json.dumps(pages)), ("broken", "{"), ("none", None)], "document_id string, json string")
    parsed = readers.parsed_blocks(files)
    assert parsed.where("block_type = 'title'").first().bbox == [1, 2, 3, 4]
    clean = blocks.merged(blocks.gated(parsed))
    md = blocks.clean_document(clean).collect()
    assert len(md) == 1 and md[0].markdown == "# A title\n\n## Abstract\n\nThe energy $E_0$ of the film was measured in every state, over many days and nights and all of it held, as far as seen.\n\n$$a=b$$\n\nIt did not recover.\n"
    flat = spark.createDataFrame([("d", json.dumps([{"type": "text", "text": "One.", "page_idx": 2}, {"type": "table", "text": "x"}]))], "document_id string, json string")
    rows = blocks.flat_gated(readers.parsed_blocks(flat)).collect()
    assert [(r.page_number, r.text, r.category) for r in rows] == [(3, "One.", "main_text")]


def test_deep_nodes_do_not_overflow():
    node = {"type": "text", "content": "x"}
    for _ in range(5000):
        node = {"type": "p", "content": [node]}
    assert readers.rendered(node) == "x"


def test_markdown_source(spark):
    md = "# Title\n\nSome body text.\n\n![a](b.png)\n\nFig. 1 shows\n\nKeywords: x\n\n## References\n\n[1] gone"
    rows = blocks.markdown_blocks(spark.createDataFrame([("d", md), ("e", ""), ("f", None)], "document_id string, text string")).collect()
    assert [(r.category, r.text) for r in rows] == [("heading", "# Title"), ("main_text", "Some body text.")]


SPAN = "document_id string, page_number int, page_width double, block_no int, line_no int, span_no int, text string, font string, size double, x0 double, y0 double, x1 double, y1 double"


def page(*words):
    """Spans of one page from (text, x, y[, font, size, width, line])."""
    out = []
    for n, (text, x, y, *rest) in enumerate(words):
        font, size, w, line = (*rest, *("Roman", 10.0, 5.0, 0)[len(rest):])
        out.append(("d", 1, 600.0, 0, line, n, text, font, float(size), float(x), float(y), float(x + w), float(y + 8)))
    return out


def test_formula_spans(spark):
    data = page(("energy", 10, 100, "Roman", 10, 40), ("E", 60, 100, "Italic"), ("=", 68, 100), ("1", 76, 97, "Roman", 10, 4), ("2", 76, 105, "Roman", 10, 4), ("k", 84, 100, "Italic"), ("where", 92, 100), ("far", 400, 100, "Roman", 10, 20))
    df = spark.createDataFrame(data, SPAN)
    out = spans.page_formulas(df).collect()
    assert [(r.formula, r.x0, r.x1) for r in out] == [("E = (1/2)k", 60.0, 89.0)]
    assert spans.page_formulas(df.limit(0)).count() == 0
    # three numbers below each other make one fraction; a gap, prose and the other half end a formula; equal ones count once
    data = page(("x", 10, 50, "STIX"), ("≥", 18, 50), ("1", 26, 46), ("2", 26, 54), ("3", 26, 57), ("y", 60, 50, "Italic"), ("a", 310, 50, "Italic"), ("=", 318, 50), ("b", 326, 50, "Italic"), ("a", 310, 90, "Italic"), ("=", 318, 90), ("b", 326, 90, "Italic"), (None, 1, 1), ("=", 900, 50))
    got = [(r.formula, r.seed_no) for r in spans.page_formulas(spark.createDataFrame(data, SPAN)).orderBy("seed_no").collect()]
    assert got == [("x ≥ (1/2)3", 1), ("a = b", 7)]


def test_page_units(spark):
    data = page(("The film grew. It held.", 10, 20, "Roman", 10, 200, 0), ("E", 60, 100, "Italic", 10, 5, 1), ("=", 68, 100, "Roman", 10, 5, 2), ("k", 84, 100, "Italic", 10, 5, 3))
    rows = spans.page_units(spark.createDataFrame(data, SPAN)).orderBy("ordinal").collect()
    assert [(r.unit, r.x0) for r in rows] == [("The film grew.", None), ("It held.", None), ("E = k", None)]  # a unit already
    data = page(("p = q + 1", 10, 20, "Italic", 10, 60, 0), ("−", 10, 40, "Roman", 10, 5, 1))
    rows = spans.page_units(spark.createDataFrame(data, SPAN)).orderBy("ordinal").collect()
    assert [(r.unit, r.x0, r.x1) for r in rows] == [("p = q + 1", None, None), ("p = q+1", 10.0, 70.0)]  # the bare sign is gone
    assert spans.page_units(spark.createDataFrame([], SPAN)).count() == 0


def test_rescaled_boxes(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([([100.0, 200.0, 500.0, 1000.0],), ([1.0],), (None,)], "b array<double>")
    out = [r[0] for r in df.select(spans.rescaled(F.col("b"), F.lit(600.0), F.lit(800.0))).collect()]
    assert out[0] == [55.0, 155.0, 305.0, 800.0] and out[1:] == [None, None]


def test_sources(spark, tmp_path):
    (tmp_path / "a.PDF").write_bytes(b"%PDF")
    (tmp_path / "b.txt").write_bytes(b"x")
    files = readers.pdf_files(spark, str(tmp_path))
    assert [r.filename for r in files.collect()] == ["a.PDF"] and readers.new_documents(files).first().status == "parsing"
    (tmp_path / "o.yaml").write_text("version: \"1\"\nentity_types:\n  A:\n    label: x\nrelation_types:\n  R:\n    label: y\n    subject_types: [A]\n    object_types: []\n  S:\n    label: z\n    subject_types:\n      - A\n      - B\n", encoding="utf-8")
    version, e, r = readers.ontology(spark, str(tmp_path / "o.yaml"))
    assert version == "1" and e.count() == 1 and {x.relation_type: (x.subject_types, x.object_types) for x in r.collect()} == {"R": (["A"], []), "S": (["A", "B"], [])}
    (tmp_path / "x_content_list.json").write_text("[]")
    (tmp_path / "x_content_list_v2.json").write_text("[[]]")
    assert readers.content_list(str(tmp_path)).endswith("_v2.json")
    import zipfile

    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("../evil", "x")
    with pytest.raises(ValueError):
        readers.unpack(str(tmp_path / "z.zip"), str(tmp_path / "out"))
    assert readers.parser_for(readers.Settings()) == "local" and readers.parser_for(readers.Settings(parser_key="k")) == "remote"
    assert readers.Settings.from_env({"GRAPHLOOM_CANDIDATE_THRESHOLD": "0.5"}).candidate_threshold == 0.5


def test_ingest(spark):
    from graphloom.operators import ingest

    rows = [("d", 0, 1, "title", "A title of it", None), ("d", 1, 1, "text", "One grew. Two fell in the wide and open field of all the many tests that we ran over the years and in every single place.", None), ("d", 2, 1, "equation", "$$a = b + c$$", [1.0, 2.0, 3.0, 4.0]), ("d", 3, 2, "text", "Three held.", None), ("e", 0, 1, "header", "x", None)]
    parsed = spark.createDataFrame(rows, "document_id string, block_no int, page_number int, block_type string, text string, bbox array<double>")
    out = ingest.ingested(parsed)
    got = [(r.id, r.text, r.context_before, r.context_after) for r in out.orderBy("ordinal").collect()]
    assert [x[0] for x in got] == ["d-0", "d-1", "d-2", "d-3"] and got[2][1] == "$$a = b + c$$" and got[2][2].startswith("Two fell") and got[2][3] == "Three held."
    assert {r.document_id: r.status for r in ingest.ingest_status(parsed, out).collect()} == {"d": "reviewable", "e": "parse_failed"}
    assert ingest.formula_assets(out, parsed).first().bbox == [1.0, 2.0, 3.0, 4.0]
    assert [r.content_type for r in ingest.sentence_listing(out, "d").collect()] == ["sentence", "sentence", "formula", "sentence"]


def test_remote(tmp_path):
    import io
    import zipfile

    from graphloom.sources import remote

    box = io.BytesIO()
    with zipfile.ZipFile(box, "w") as z:
        z.writestr("a_content_list.json", "[]")

    class Fake:
        def __init__(self, states):
            self.states = list(states)

        def create(self, name):
            return "b", "up"

        def put(self, address, data):
            assert address == "up" and data == b"%PDF"

        def state(self, batch):
            return self.states.pop(0) if len(self.states) > 1 else self.states[0]

        def fetch(self, address):
            return box.getvalue()

    (tmp_path / "a.pdf").write_bytes(b"%PDF")
    ticks = iter(range(0, 10_000, 400))
    call = lambda s: remote.parse_remotely(str(tmp_path / "a.pdf"), str(tmp_path / "out"), Fake(s), clock=lambda: next(ticks), sleep=lambda _: None)
    assert call([("running", ""), ("done", "x")]).endswith("a_content_list.json")
    with pytest.raises(RuntimeError):
        call([("failed", "why")])
    with pytest.raises(TimeoutError):
        call([("running", "")])
    assert remote.ordered_vectors([{"index": 1, "embedding": [2.0]}, {"index": 0, "embedding": [1.0]}], 2, 1) == [[1.0], [2.0]]
    with pytest.raises(ValueError):
        remote.remote_embedder(lambda t, d: [], 256)(["x"])
