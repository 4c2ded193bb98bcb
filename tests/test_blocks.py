"""Files made here, read part by part."""

import io
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions.fields import format_location
from ledgerloom.functions.fragments import image_regions
from ledgerloom.jobs.queries import PagedLines
from ledgerloom.sources.blocks import block_source, document_blocks, list_files, new_file
from ledgerloom.sources.readers import READERS, Block, Reader

NS = (
    'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships" '
    'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:v="urn:schemas-microsoft-com:vml"'
)


def para(text, *pictures):
    return f"<w:p><w:r><w:t>{text}</w:t></w:r>{''.join(f'<w:drawing><a:blip r:embed={chr(34)}{i}{chr(34)}/></w:drawing>' for i in pictures)}</w:p>"


def rels(**targets):
    kind = "http://schemas.openxmlformats.org/officeDocument/2006/relationships/"
    one = "".join(f'<Relationship Id="{i}" Type="{kind}{"image" if "media" in t else "styles"}" Target="{t}"/>' for i, t in targets.items())
    return f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{one}</Relationships>'


def word_file(path):
    body = (
        para("one") + para("two", "rId10", "rId2")
        + f"<w:sdt><w:sdtContent>{para('in a control')}</w:sdtContent></w:sdt>"
        + f"<w:tbl><w:tr><w:tc>{para('a')}</w:tc><w:tc>{para('b', 'rId3')}<w:tbl><w:tr><w:tc>{para('inner')}</w:tc></w:tr></w:tbl></w:tc></w:tr><w:tr><w:tc>{para('c')}</w:tc></w:tr></w:tbl>"
        + f"<w:tbl><w:tr><w:tc>{para('d')}</w:tc></w:tr></w:tbl>" + '<w:p><w:pict><v:imagedata r:id="rId4"/></w:pict></w:p>' + "<w:sectPr/>"
    )
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("word/document.xml", f"<w:document {NS}><w:body>{body}</w:body></w:document>")
        z.writestr("word/_rels/document.xml.rels", rels(rId1="styles.xml", **{f"rId{i}": f"media/image{i}.png" for i in (2, 3, 4, 10, 12, 5)}, rId6="media/lost.png"))
        z.writestr("word/header1.xml", f"<w:hdr {NS}>{para('head', 'rId1')}</w:hdr>")
        z.writestr("word/_rels/header1.xml.rels", rels(rId1="media/logo.png"))
        z.writestr("word/footer2.xml", f"<w:ftr {NS}>{para('foot')}</w:ftr>")
        for i in (2, 3, 4, 10, 12, 5):
            z.writestr(f"word/media/image{i}.png", f"picture {i}")
        z.writestr("word/media/logo.png", "logo")


def tiff(order, sizes):
    """Directories of a width and a height each."""
    out = (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "I", 8)
    for i, (w, h) in enumerate(sizes):
        wide = struct.pack(order + "HHI", 256, 3, 1) + struct.pack(order + "HH", w, 0)
        high = struct.pack(order + "HHII", 257, 4, 1, h)
        out += struct.pack(order + "H", 2) + wide + high + struct.pack(order + "I", 0 if i == len(sizes) - 1 else 8 + 30 * (i + 1))
    return out


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    at = tmp_path_factory.mktemp("files")
    (at / "sub/own").mkdir(parents=True)
    word_file(at / "sub/a.DOCX")
    word_file(at / "sub/own/left out.docx")
    (at / "bad.docx").write_bytes(b"no zip")
    with zipfile.ZipFile(at / "other.docx", "w") as z:
        z.writestr("x", "y")
    (at / "p.png").write_bytes(b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 13) + b"IHDR" + struct.pack(">II", 1700, 900) + b"rest")
    (at / "j.jpg").write_bytes(b"\xff\xd8\xff\xe0" + struct.pack(">H", 16) + b"x" * 14 + b"\xff\xff\xc2" + struct.pack(">HBHH", 11, 8, 333, 444) + b"rest")
    (at / "cut.jpg").write_bytes(b"\xff\xd8\xff\xe0")
    (at / "t.tif").write_bytes(tiff("<", [(100 + i, 70_000) for i in range(120)]))
    (at / "m.tiff").write_bytes(tiff(">", [(5, 6)]))
    (at / "pages.paged").write_text("one\ntwo\fthree\f")
    (at / "old.xlsx").write_bytes(b"x")
    (at / "none.docx").touch()
    return at


def both(spark, folder):
    """The rows by the data source and by a table of paths."""
    spark.dataSource.register(block_source({"paged": PagedLines()}))
    source = spark.read.format("document_blocks").option("exclude", f"{folder}/sub/own").option("partsPerPartition", "2").load(str(folder))
    files = [str(p) for p in folder.rglob("*") if p.is_file() and p.suffix != ".xlsx" and "own" not in p.parts]
    return source, document_blocks(spark.createDataFrame([(p,) for p in [*files, files[0], None]], "path string"), {"paged": PagedLines()})


def test_both_ways_give_the_same_rows(spark, folder):
    a, b = (sorted((tuple(r)[0].removeprefix("file://"), *map(str, tuple(r)[1:])) for r in df.collect()) for df in both(spark, folder))
    assert a == b and len(a) > 20
    assert not any("xlsx" in r[0] or "left out" in r[0] for r in a)


def test_a_word_file_in_its_order(spark, folder):
    rows = both(spark, folder)[0].where("file_id LIKE '%a.DOCX'").orderBy("part", "block_no")
    place = format_location(*(F.col(c) for c in ("kind", "page", "para", "row", "col")))
    got = [(r.kind, r.place, r.text if r.kind != "picture" else (r.name, bytes(r.content) if r.content is not None else None)) for r in rows.withColumn("place", place).collect()]

    def picture(i, where):
        return "picture", where, (f"word/media/image{i}.png", f"picture {i}".encode())

    assert got == [
        ("header", "header", "head"), ("picture", "picture", ("word/media/logo.png", b"logo")),
        ("para", "paragraph 1", "one"), ("para", "paragraph 2", "two"), picture(10, "picture in paragraph 2"), picture(2, "picture in paragraph 2"),
        ("para", "paragraph 3", "in a control"),
        ("cell", "table row 1 column 1", "a"), ("cell", "table row 1 column 2", "binner"), picture(3, "picture in table row 1 column 2"), ("cell", "table row 2 column 1", "c"),
        ("cell", "table row 1 column 1", "d"), ("para", "paragraph 4", ""), picture(4, "picture in paragraph 4"),
        picture(5, "picture"), ("picture", "picture", ("word/media/lost.png", None)), picture(12, "picture"), ("footer", "footer", "foot"),
    ]


def test_pages_reach_locations_and_regions(spark, folder):
    rows = both(spark, folder)[0].withColumn("file", F.regexp_extract("file_id", "([^/]+)$", 1))
    place = format_location(*(F.col(c) for c in ("kind", "page", "para", "row", "col")))
    paged = rows.where("file = 'pages.paged'").select("part", place.alias("place"), "text").collect()
    assert sorted(map(tuple, paged)) == [(0, "page 1", "one"), (0, "page 1", "two"), (1, "page 2", "three"), (2, "page 3", "")]
    tif = rows.where("file = 't.tif'").select("part", "page", "width", "height").collect()
    assert sorted(map(tuple, tif)) == sorted((i // 50, i + 1, 100 + i, 70_000) for i in range(120))
    sizes = {r.file: (r.page, r.width, r.height, r.content is not None) for r in rows.where("file IN ('p.png', 'j.jpg', 'm.tiff')").collect()}
    assert sizes == {"p.png": (1, 1700, 900, True), "j.jpg": (1, 444, 333, True), "m.tiff": (1, 5, 6, False)}
    regions = image_regions(rows.where("file = 'p.png'").select("page", "width", "height"), "width", "height", 1000, 100).collect()
    assert sorted((r.x0, r.y0, r.x1, r.y1) for r in regions) == [(0, 0, 1000, 900), (900, 0, 1700, 900)]
    empty = spark.createDataFrame([("image", None, None, None, None), ("picture", None, None, None, None), ("video", 1, 1, 1, 1)], "kind string, page int, para int, row int, col int")
    assert [r.p for r in empty.select(format_location(*(F.col(c) for c in empty.columns)).alias("p")).collect()] == [None, "picture", None]


def test_what_cannot_be_read_is_told(spark, folder):
    rows = both(spark, folder)[0].where("status <> 'read'").select(F.regexp_extract("file_id", "([^/]+)$", 1).alias("file"), F.split("status", ":")[1].alias("why"), "kind").collect()
    assert sorted((r.file, r.why.strip(), r.kind) for r in rows) == [("bad.docx", "BadZipFile", None), ("cut.jpg", "ValueError", None), ("none.docx", "BadZipFile", None), ("other.docx", "ValueError", None)]


def test_a_part_that_breaks_off_keeps_what_was_read(spark, tmp_path):
    class Breaks(Reader):
        def parts(self, file, size):
            return [1, 2]

        def read(self, file, part):
            yield Block("pdf", page=part, text="x")
            if part == 1:
                raise OSError("torn")

    (tmp_path / "a.pdf").write_bytes(b"x")
    out = document_blocks(spark.createDataFrame([(f"file:{tmp_path}/a.pdf",), (f"file:{tmp_path}/lost.pdf",)], "path string"), {"pdf": Breaks()}).orderBy("file_id", "part", "block_no").collect()
    assert [(r.part, r.page, r.status) for r in out][:3] == [(0, 1, "read"), (0, None, "failed: OSError: torn"), (1, 2, "read")]
    assert out[3].status.startswith("failed: FileNotFoundError") and len(out) == 4


def test_a_body_is_not_held_whole():
    """Of a body of 30,000 paragraphs only the one at hand stays in memory."""
    import tracemalloc

    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("word/document.xml", f"<w:document {NS}><w:body>{para('some words of a paragraph') * 30_000}</w:body></w:document>")
    tracemalloc.start()
    assert sum(1 for _ in READERS["docx"].read(raw, "word/document.xml")) == 30_000
    assert tracemalloc.get_traced_memory()[1] < 4 << 20
    tracemalloc.stop()


def test_files_are_written_with_their_folders(tmp_path):
    with new_file(f"file://{tmp_path}/x/y/z.bin") as f:
        f.write(b"abc")
    assert (tmp_path / "x/y/z.bin").read_bytes() == b"abc"


def test_the_source_opens_no_file_on_the_driver_and_makes_few_partitions(tmp_path, monkeypatch):
    for i in range(900):
        (tmp_path / str(i % 3)).mkdir(exist_ok=True)
        (tmp_path / str(i % 3) / f"{i}.pages").write_text("\f".join("abc"))
    (tmp_path / "large.pages").write_text("\f".join(f"page {i}" for i in range(5000)))
    monkeypatch.setattr("ledgerloom.sources.blocks.opened", lambda path: pytest.fail("opened while planning"))
    reader = block_source({"pages": PagedLines()})({"path": str(tmp_path), "exclude": f"{tmp_path}/2", "bytesPerPartition": "16000"}).reader(None)
    reader.size = 16_000
    parts = reader.partitions()
    monkeypatch.undo()
    rows = [row for p in parts for row in reader.read(p)]
    assert len([r for r in rows if not r[0].endswith("large.pages")]) == 600 * 3
    large = [r for r in rows if r[0].endswith("large.pages")]
    assert sorted(r[1] for r in large) == list(range(5000)) and sorted(r[8] for r in large) == sorted(f"page {i}" for i in range(5000))
    assert sum(any(x[1] == "large.pages" for x in p.items) for p in parts) >= 3
    reader.size = 32 << 20
    assert 1 <= len(reader.partitions()) <= 3


def test_files_are_listed_by_tasks(spark, folder):
    found = list_files(spark, [str(folder), f"file:{folder}/p.png"], ("docx", "png"), exclude=(f"file://{folder}/sub/own",)).collect()
    names = sorted((r.path.rpartition("/")[2], r.n_bytes > 0) for r in found)
    assert names == [("a.DOCX", True), ("bad.docx", True), ("none.docx", False), ("other.docx", True), ("p.png", True), ("p.png", True)]
    assert all(r.path.startswith("file:///") for r in found)
