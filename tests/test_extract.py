import io
import zipfile
from xml.sax.saxutils import escape

import pytest
from pyspark.sql import functions as F

from foliant.errors import DesktopDirNotFound, InvalidPath
from foliant.functions import paths
from foliant.sources import extract, files

WORD = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def document(*paragraphs):
    """Markup of a document; a paragraph is a list of texts and empty elements."""
    runs = lambda parts: "".join(f"<w:{x[1:]}/>" if x.startswith("@") else f"<w:t>{escape(x)}</w:t>" for x in parts)
    body = "".join(f"<w:p><w:pPr/><w:r>{runs(p)}</w:r></w:p>" for p in paragraphs)
    return f'<w:document xmlns:w="{WORD}"><w:body>{body}<w:sectPr/></w:body></w:document>'.encode()


def docx_bytes(text):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as archive:
        archive.writestr("word/document.xml", document(*([line] if line else [] for line in text.split("\n"))))
    return out.getvalue()


def test_documents():
    assert extract.document_text(document(["Uno ", "dos", " tres"], [], ["quattro"])) == "Uno dos tres\nquattro"
    assert extract.document_text(document(["left", "@tab", "right", "@br", "below"])) == "left\tright\nbelow"
    assert extract.document_text(document(["R&D <3 \"x\""])) == "R&D <3 \"x\""
    assert extract.document_text(document()) == extract.document_text(document([], [])) == ""


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("folder")
    (root / "a.txt").write_text("plain text ё", encoding="utf-8")
    (root / "b.md").write_text("# title")
    (root / "bad.txt").write_bytes(b"\xff\xfe\x00bad")
    (root / "c.docx").write_bytes(docx_bytes("Line & one\n\nLine two"))
    (root / "broken.docx").write_bytes(b"not a zip")
    empty = io.BytesIO()
    with zipfile.ZipFile(empty, "w") as archive:
        archive.writestr("other.xml", "<x/>")
    (root / "empty.docx").write_bytes(empty.getvalue())
    (root / "d.pdf").write_bytes(b"%PDF-1.4 fake")
    (root / "e.png").write_bytes(b"\x89PNG")
    (root / "f.mp3").write_bytes(b"ID3")
    (root / "noext").write_text("x")
    (root / "big.txt").write_bytes(b"x" * (2 * 1024 * 1024))
    (root / ".hidden").write_text("x")
    (root / "Desktop.ini").write_text("x")
    (root / "sub").mkdir()
    (root / "sub" / "deep.txt").write_text("x")
    return str(root)


def results(df):
    return {r.path.rsplit("/", 1)[1]: r for r in df.collect()}


def test_folder_scan(spark, folder):
    names = {r.file_name for r in files.scan(spark, folder).select("file_name").collect()}
    assert names == {"a.txt", "b.md", "bad.txt", "c.docx", "broken.docx", "empty.docx", "d.pdf", "e.png", "f.mp3", "noext", "big.txt"}
    listed = {r.file_name for r in files.listing(spark, folder).collect()}
    # Spark itself leaves out names starting with a dot or an underscore.
    assert listed - names == {"Desktop.ini"}


def test_extraction(spark, folder):
    got = results(extract.extract_content(files.scan(spark, folder), max_mb=1))
    assert (got["a.txt"].text, got["a.txt"].content_type, got["a.txt"].error_code) == ("plain text ё", "text", None)
    assert got["c.docx"].text == "Line & one\nLine two" and got["c.docx"].error_code is None
    codes = {n: r.error_code for n, r in got.items() if r.error_code}
    assert codes == {
        "bad.txt": "extraction_failed", "broken.docx": "extraction_failed", "empty.docx": "extraction_failed",
        "d.pdf": "extraction_failed", "e.png": "unsupported_format", "f.mp3": "unsupported_format",
        "noext": "unsupported_format", "big.txt": "file_too_large",
    }
    assert got["big.txt"].content_type == "txt" and got["e.png"].content_type == "unsupported"


def test_requested_paths(spark, folder):
    wanted = spark.createDataFrame([(f"{folder}/a.txt",), ("/no/such.txt",), ("/no/ext",)], "path string")
    got = results(extract.extract_requested(wanted, files.scan(spark, folder)))
    assert {n: r.error_code for n, r in got.items()} == {"a.txt": None, "such.txt": "file_not_found", "ext": "unsupported_format"}


def test_pluggable_pdf(spark, folder):
    def reader(content, max_pages):
        assert content.startswith(b"%PDF")
        return "page text", min(7, max_pages), 7

    got = results(extract.extract_content(files.scan(spark, folder), max_pages=5, pdf_reader=reader))["d.pdf"]
    assert (got.text, got.pages_extracted, got.error_code) == ("page text", 5, "too_many_pages")


def test_ocr_and_transcription(spark, folder):
    scanned = files.scan(spark, folder)
    codes = {n: r.error_code for n, r in results(extract.ocr(scanned)).items()}
    assert codes["e.png"] == codes["d.pdf"] == "ocr_failed" and codes["a.txt"] == "unsupported_format"
    read = results(extract.ocr(scanned, lambda c, n: ("seen", 1, 1) if c.startswith(b"\x89") else (" \t\n", 1, 1)))
    assert (read["e.png"].text, read["e.png"].confidence, read["e.png"].error_code) == ("seen", 0.9, None)
    assert read["d.pdf"].error_code == "empty_image"

    def fails(content, pages):
        raise ValueError("not readable")

    broken = results(extract.ocr(scanned, fails))["e.png"]
    assert (broken.error_code, broken.detail) == ("ocr_failed", "ValueError: not readable")
    assert results(extract.transcribe(scanned))["f.mp3"].error_code == "not_implemented"
    assert {r.error_code for r in extract.transcribe(scanned, max_minutes=0).collect()} == {"transcription_disabled"}


def test_media_types(spark):
    kinds = {"a.WAV": "audio", "a.mkv": "video", "a.txt": "unsupported", "a": "unsupported"}
    df = spark.createDataFrame([(p,) for p in kinds], "p string")
    assert {r.p: r.k for r in df.select("p", paths.media_content_type(F.col("p")).alias("k")).collect()} == kinds
    ocr = {"a.JPG": "image", "a.pdf": "scan_pdf", "a.webp": "unsupported"}
    df = spark.createDataFrame([(p,) for p in ocr], "p string")
    assert {r.p: r.k for r in df.select("p", paths.ocr_content_type(F.col("p")).alias("k")).collect()} == ocr


def test_watch_folder_rules():
    for bad in ("", "  ", "relative/dir"):
        with pytest.raises(InvalidPath):
            files.resolve_watch_dir(bad)
    assert files.resolve_watch_dir("/abs") == "/abs"
    assert files.default_watch_dir("/home/u").endswith("/Desktop/Foliant")
    with pytest.raises(DesktopDirNotFound):
        files.default_watch_dir("")


def test_damaged_documents_fail_alone(spark):
    """Whatever is wrong with one archive is told in its own row."""
    good = docx_bytes("fine")
    cut = bytearray(good)
    at = cut.find(b"word/document.xml") + len("word/document.xml")
    cut[at + 3 : at + 20] = b"\xff" * 17  # the deflated data
    locked = bytearray(good)
    for head, place in ((b"PK\x03\x04", 6), (b"PK\x01\x02", 8)):
        locked[locked.find(head) + place] |= 1  # encrypted
    method = bytearray(good)
    for head, place in ((b"PK\x03\x04", 8), (b"PK\x01\x02", 10)):
        method[method.find(head) + place] = 99
    rows = [(f"/{n}.docx", bytearray(b)) for n, b in (("good", good), ("cut", cut), ("locked", locked), ("method", method), ("none", b""))]
    scanned = spark.createDataFrame([(p, len(b), b) for p, b in rows], "path string, length long, content binary")
    got = {r.path: r for r in extract.extract_content(scanned).collect()}
    assert got["/good.docx"].text == "fine" and got["/good.docx"].error_code is None
    for name in ("cut", "locked", "method", "none"):
        assert got[f"/{name}.docx"].error_code == "extraction_failed" and got[f"/{name}.docx"].detail


def test_media_too_long(spark):
    rows = [("/a.mp3", 1, bytearray(b"a")), ("/b.mp3", 1, bytearray(b"b"))]
    scanned = spark.createDataFrame(rows, "path string, length long, content binary")
    heard = lambda blob, minutes: ("words", 60, 90 if blob == b"a" else 61 * 60)
    got = {r.path: r for r in extract.transcribe(scanned, heard, max_minutes=60).collect()}
    assert got["/a.mp3"].error_code is None and got["/a.mp3"].duration_seconds == 60
    assert got["/b.mp3"].error_code == "media_too_long"
