"""Objects, pages and outlines of PDF files of several kinds, and the source's partitions, filters and commits."""

import zlib

import pytest
from pyspark.sql.datasource import EqualTo, GreaterThan, In, StringEndsWith

from leafmill.functions import pdf
from leafmill.operators import pages
from leafmill.sources import pdf as source

PLAIN = pdf.written([[("Äß 日本 😀 (x) \\", 14), ("", 10)], [("two", 14)]], [(1, "One", 1), (2, "Two\n more", 2), (1, "Three", 1)], "A title that is long")


def packed(predictor: bool) -> bytes:
    """A file with an object stream, a stream of cross references, Latin 1 text, and rules."""
    content = b"q 2 0 0 2 10 0 cm 10 20 200 1 re f Q 5 5 m 5 90 l S 1 1 9 9 re n\nBT /F1 12 Tf 14 TL 100 700 Td (caf\\351 \\(a\\)) Tj T* [(b) -300 (c) 20 (d)] TJ (next) ' ET BI /W 1 ID (Tj) EI"
    inner = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Kids [3 0 R] /Count 1 /MediaBox [0 0 200 800] >>", 3: b"<< /Type /Page /Parent 2 0 R /Contents [5 0 R 7 0 R] >>", 8: b"42"}
    heads, bodies, at = [], b"", 0
    for n, body in inner.items():
        heads.append(b"%d %d" % (n, at))
        bodies += body + b" "
        at = len(bodies)
    head = b" ".join(heads) + b" "
    pack = zlib.compress(head + bodies)
    out, places = b"%PDF-1.5\n", {}
    for n, entries, stream in ((4, b"/Type /ObjStm /N 4 /First %d /Filter /FlateDecode" % len(head), pack), (5, b"", content), (7, b"/Filter [/ASCIIHexDecode /FlateDecode]", zlib.compress(b"BT /F1 9 Tf 1 0 0 1 0 50 Tm <64> Tj ET").hex().encode() + b">")):
        places[n] = len(out)
        out += b"%d 0 obj\n<< %s /Length %d >>\nstream\n" % (n, entries, len(stream)) + stream + b"\nendstream\nendobj\n"
    rows = b""
    for n in range(10):
        kind, a, b = (1, places[n], 0) if n in places else (2, 4, list(inner).index(n)) if n in inner else (1, len(out), 0) if n == 9 else (0, 0, 0)
        rows += bytes([kind]) + a.to_bytes(2, "big") + bytes([b])
    if predictor:
        lines = [rows[k : k + 4] for k in range(0, len(rows), 4)]
        before = [bytes(4), *lines]
        rows = b"".join(b"\x02" + bytes((x - y) & 255 for x, y in zip(a, b, strict=True)) for a, b in zip(lines, before, strict=False))
    table = zlib.compress(rows)
    parms = b"/DecodeParms << /Predictor 12 /Columns 4 >>" if predictor else b""
    at = len(out)
    out += b"9 0 obj\n<< /Type /XRef /Size 10 /W [1 2 1] /Root 1 0 R /Filter /FlateDecode %s /Length %d >>\nstream\n" % (parms, len(table)) + table + b"\nendstream\nendobj\n"
    return out + b"startxref\n%d\n%%%%EOF" % at


def test_objects():
    found = {n: (e, s) for n, e, s in pdf.objects(PLAIN)}
    assert found[0][0] == {"Root": "1 0 R", "Info": "4 0 R"} and found[4][0]["Title"] == "A title that is long"
    # a later definition in an update counts, and one that it frees is gone
    at = len(PLAIN)
    more = PLAIN + b"4 0 obj\n<< /Title (Other \\050x\\051) >>\nendobj\n"
    more += b"xref\n3 1\n0000000000 00001 f \n4 1\n%010d 00000 n \ntrailer\n<< /Root 1 0 R /Info 4 0 R /Prev %d >>\nstartxref\n%d\n%%%%EOF" % (at, PLAIN.rindex(b"xref\n0"), len(more))
    found = {n: e for n, e, _ in pdf.objects(more)}
    assert found[4]["Title"] == "Other (x)" and 3 not in found
    # without cross references objects are found by their beginnings
    broken = PLAIN[: PLAIN.rindex(b"startxref")] + b"startxref\n999999\n%%EOF"
    assert {n: s for n, _, s in pdf.objects(broken)} == {n: s for n, _, s in pdf.objects(PLAIN)}
    assert list(pdf.objects(PLAIN.replace(b"/Info", b"/Encrypt 4 0 R /Info"))) == [] and list(pdf.objects(b"%PDF-1.4 nothing")) == [] and list(pdf.objects(b"")) == []
    for cut in range(0, len(PLAIN), 97):
        list(pdf.objects(PLAIN[:cut]))


@pytest.mark.parametrize("predictor", [False, True])
def test_object_streams(predictor):
    found = {n: (e, s) for n, e, s in pdf.objects(packed(predictor))}
    assert sorted(found) == [0, 1, 2, 3, 5, 7, 8] and found[8][0] == {"": "42"} and found[3][0]["Contents"] == "[ 5 0 R 7 0 R ]"
    assert b"Tj ET" in found[7][1]
    shown = list(pdf.shown(found[5][1] + b"\n" + found[7][1], {}))
    assert [(k, t) for k, _, *_, t in shown] == [("rule", ""), ("rule", ""), ("run", "café (a)"), ("run", "b cd"), ("run", "next"), ("run", "d")]
    assert shown[0][2:6] == (30, 40, 430, 42) and shown[1][2:6] == (5, 5, 5, 90)
    assert [s[3] for s in shown[2:]] == [700, 686, 672, 50] and shown[2][4] == 100 + 8 * 6


def test_maps():
    font = pdf.Font(b"1 begincodespacerange <00> <ff> endcodespacerange 2 beginbfchar <01> <0041> <02> <00660069> endbfchar 2 beginbfrange <03> <05> <0061> <06> <07> [<0078> <D83DDE00>] endbfrange")
    assert font(b"\x01\x02\x03\x05\x06\x07\x09") == "Afiacx😀"
    assert pdf.Font(None)(b"\xe9") == "é"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("pdf"))
    rows = [(f"a{k}.pdf", PLAIN) for k in range(4)] + [("b.PDF", packed(True)), ("c.txt", PLAIN), ("d.pdf", b"no pdf"), ("e.pdf", b"%PDF-1.4\nbroken")]
    source.write_files(spark.createDataFrame(rows, "file string, content binary").repartition(3), path)
    return path


def test_reader(folder):
    """Filters choose files before any is opened; the others stay with Spark; a partition is a range of files."""
    reader = source.PdfReader({"path": folder, "rangeBytes": str(2 * len(PLAIN))})
    rest = [GreaterThan(("number",), 3)]
    assert list(reader.pushFilters([EqualTo(("kind",), "plain"), In(("file",), ("a1.pdf", "a3.pdf", "c.txt")), StringEndsWith(("file",), ".pdf"), *rest])) == rest
    parts = reader.partitions()
    assert [[p.rsplit("/", 1)[1] for p in x.paths] for x in parts] == [["a1.pdf", "a3.pdf"]]
    assert {(name, kind) for name, _, kind, *_ in reader.read(parts[0])} == {("a1.pdf", "plain"), ("a3.pdf", "plain")}
    assert len(source.PdfReader({"path": folder, "rangeBytes": "1"}).partitions()) == 7
    assert sum(len(p.paths) for p in source.PdfReader({"path": folder, "mostBytes": "20"}).partitions()) == 2


def test_pages(spark, folder):
    objects = source.read_objects(spark, folder)
    assert "a2.pdf" in objects.filter("file = 'a2.pdf'")._jdf.queryExecution().toString() and objects.filter("file = 'a2.pdf'").select("file").distinct().count() == 1
    parts = pages.structure(objects)
    assert {(r.file, r.n, r.title) for r in parts.filter("what = 'file'").collect()} == {*((f"a{k}.pdf", 2, "A title that is long") for k in range(4)), ("b.PDF", 1, None)}
    assert [(r.n, r.level, r.title, r.page) for r in parts.filter("what = 'outline' and file = 'a0.pdf'").orderBy("n").collect()] == [(1, 1, "One", 1), (2, 2, "Two more", 2), (3, 1, "Three", 1)]
    shown = pages.runs(objects, parts)
    lines = pages.lines(shown).filter("file in ('a0.pdf', 'b.PDF')").orderBy("file", "page", "seq").collect()
    assert [(r.page, r.text, r["size"]) for r in lines if r.file == "a0.pdf"] == [(1, "Äß 日本 😀 (x) \\", 14.0), (1, "", 10.0), (2, "two", 14.0)]
    assert [(r.text, r.y1) for r in lines if r.file == "b.PDF"] == [("café (a)", 100.0), ("b cd", 114.0), ("next", 128.0), ("d", 750.0)]
    assert pages.rules(shown).count() == 2


def test_writer_names_at_the_end(tmp_path):
    """What a task wrote has its name only when all is there; what is given up leaves nothing."""
    from pyspark.sql import Row

    writer = source.PdfWriter({"path": str(tmp_path)})
    done = writer.write(iter([Row(file="x.pdf", content=bytearray(b"%PDF"))]))
    again = writer.write(iter([Row(file="x.pdf", content=bytearray(b"%PDF"))]))
    assert not (tmp_path / "x.pdf").exists()
    writer.commit([done, None])
    writer.abort([again])
    assert [p.name for p in tmp_path.iterdir()] == ["x.pdf"]


def test_pages_are_read_once(spark, folder):
    """Lines read each page in one place of the plan; streams are left packed where none is asked for; documents are written by several tasks."""
    from leafmill.plans import files

    objects = source.read_objects(spark, folder)
    parts = pages.structure(objects)
    plan = pages.lines(pages.runs(objects, parts.localCheckpoint()))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and plan.count("Join") == 2
    assert [(n, e) for n, e, _ in pdf.objects(packed(True), False)] == [(n, e) for n, e, _ in pdf.objects(packed(True))]
    assert all(not s for *_, s in pdf.objects(PLAIN, False))
    docs = spark.createDataFrame([(k, "a line\nanother") for k in range(64)], "doc_id long, text string").coalesce(1)
    assert files.as_files(docs).rdd.getNumPartitions() >= 8


def test_driver_hears_of_folders_not_of_files(spark, tmp_path):
    """What a task tells the driver, and what the driver lists, does not grow with its files; files, in folders too, are all read."""
    import pickle

    from pyspark.sql import Row

    writer = source.PdfWriter({"path": f"{tmp_path}/w"})
    assert len(pickle.dumps(writer.write(Row(file=f"{k}.pdf", content=b"%PDF") for k in range(500)))) < 1000
    docs = spark.range(300).selectExpr("concat('d', id, '.pdf') as file", "encode('%PDF-x', 'utf-8') as content").repartition(6)
    source.write_files(docs, f"{tmp_path}/f", folders=True)
    (tmp_path / "f" / "alone.pdf").write_bytes(b"%PDF")
    (tmp_path / "f" / "_writing-x").mkdir()
    (tmp_path / "f" / "_writing-x" / "no.pdf").write_bytes(b"%PDF")
    parts = source.PdfReader({"path": f"{tmp_path}/f"}).partitions()
    assert len(parts) == 7 and sum(len(p.paths) for p in parts) == 1
    assert sorted(r.path.rsplit("/", 1)[1] for r in source.read_whole(spark, f"{tmp_path}/f").collect()) == sorted(["alone.pdf", *(f"d{k}.pdf" for k in range(300))])
