"""Readers of file formats: which parts a file has, and the blocks of a part.

A reader gets an open, seekable file. `parts` looks at as little of it as it can and names pieces
that can be read one without another, in order; `read` gives the blocks of one of them. So a long
file is worked on by several tasks, and no task needs it whole.
"""

from __future__ import annotations

import posixpath
import re
import struct
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any, BinaryIO
from xml.etree import ElementTree


@dataclass(frozen=True)
class Block:
    """A piece of a file with its source position. kind: para, cell, header, footer, picture (in a
    Word file), image (a page image) or what a plugged-in reader calls its pages."""

    kind: str
    page: int | None = None
    para: int | None = None
    row: int | None = None
    col: int | None = None
    text: str | None = None
    name: str | None = None
    width: int | None = None
    height: int | None = None
    content: bytes | None = None


class Reader:
    """What is plugged in for an extension. A part is anything that can be pickled."""

    def parts(self, file: BinaryIO, size: int) -> list[Any]:
        return [None]

    def read(self, file: BinaryIO, part: Any) -> Iterator[Block]:
        raise NotImplementedError


#: Names of the XML name spaces and kinds of relationships in Word files.
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_V = "{urn:schemas-microsoft-com:vml}"
_RELS = "{http://schemas.openxmlformats.org/package/2006/relationships}"


def _by_number(name: str) -> tuple:
    """rId2 before rId10."""
    return tuple((int(x), "") if x.isdigit() else (-1, x) for x in re.split(r"(\d+)", name))


class WordReader(Reader):
    """Paragraphs, table cells and the pictures in them, in the order of the body; headers and
    footers. Parts are the members of the package that hold text. The body is parsed as it is
    read; of its tree only the paragraph or table at hand is held, of its pictures one at a time.
    A picture stands where the text refers to it, after the text of its paragraph or cell; those that
    nothing refers to come last, in the order of their relationship ids."""

    _TEXT = re.compile(r"word/(header|footer|document)\d*\.xml")

    def parts(self, file: BinaryIO, size: int) -> list[str]:
        with zipfile.ZipFile(file) as z:
            names = [x for x in z.namelist() if self._TEXT.fullmatch(x)]
        if "word/document.xml" not in names:
            raise ValueError("no Word document")
        order = {"header": 0, "document": 1, "footer": 2}
        return sorted(names, key=lambda x: (order[self._TEXT.fullmatch(x)[1]], _by_number(x)))

    def read(self, file: BinaryIO, part: str) -> Iterator[Block]:
        kind = self._TEXT.fullmatch(part)[1]
        with zipfile.ZipFile(file) as z:
            pictures = self._pictures(z, part)
            used: set[str] = set()
            with z.open(part) as f:
                body = self._body(f) if kind == "document" else self._frame(f, kind)
                for block, refers in body:
                    yield block
                    for i in refers:
                        if i in pictures:
                            used.add(i)
                            yield self._picture(z, pictures[i], block)
            for i in sorted(pictures.keys() - used, key=_by_number):
                yield self._picture(z, pictures[i], Block("picture"))

    @staticmethod
    def _picture(z: zipfile.ZipFile, name: str, at: Block) -> Block:
        content = z.read(name) if name in z.NameToInfo else None
        return Block("picture", para=at.para, row=at.row, col=at.col, name=name, content=content)

    @staticmethod
    def _pictures(z: zipfile.ZipFile, part: str) -> dict[str, str]:
        """The members of the package that hold the pictures of a part, by relationship id."""
        folder, name = posixpath.split(part)
        rels = f"{folder}/_rels/{name}.rels"
        if rels not in z.NameToInfo:
            return {}
        found = ElementTree.fromstring(z.read(rels)).iter(_RELS + "Relationship")
        inner = (r for r in found if r.get("Type", "").endswith("/image") and r.get("TargetMode") != "External")
        return {r.get("Id"): posixpath.normpath(posixpath.join("/", folder, r.get("Target"))).lstrip("/") for r in inner}

    @staticmethod
    def _words(node) -> str:
        return "".join(t.text or "" for t in node.iter(_W + "t"))

    @staticmethod
    def _refers(node) -> list[str]:
        """Relationship ids of the pictures in a node, in order."""
        return [x for n in node.iter() for x in ([n.get(_R + "embed")] if n.tag == _A + "blip" else [n.get(_R + "id")] if n.tag == _V + "imagedata" else []) if x]

    def _frame(self, f: BinaryIO, kind: str) -> Iterator[tuple[Block, list[str]]]:
        root = ElementTree.parse(f).getroot()
        yield Block(kind, text=self._words(root)), self._refers(root)

    def _body(self, f: BinaryIO) -> Iterator[tuple[Block, list[str]]]:
        path, para, row = [], 0, 0
        for event, node in ElementTree.iterparse(f, ("start", "end")):
            if event == "start":
                path.append(node)
                continue
            path.pop()
            tags = [x.tag for x in path[1:] if x.tag not in (_W + "sdt", _W + "sdtContent")]
            if tags == [_W + "body"] and node.tag == _W + "p":
                para += 1
                yield Block("para", para=para, text=self._words(node)), self._refers(node)
                path[-1].clear()
            elif tags == [_W + "body", _W + "tbl"] and node.tag == _W + "tr":
                row += 1
                for c, cell in enumerate(node.findall(_W + "tc"), 1):  # a table within a cell is part of that cell's text
                    yield Block("cell", row=row, col=c, text=self._words(cell)), self._refers(cell)
                path[-1].clear()
            elif tags == [_W + "body"]:
                row = 0
                path[-1].clear()


class ImageReader(Reader):
    """Size of a PNG or JPEG image, which is one page; nothing is decoded. The page's bytes are its content."""

    def read(self, file: BinaryIO, part: Any) -> Iterator[Block]:
        head = file.read(26)
        if head[:8] == b"\x89PNG\r\n\x1a\n" and head[12:16] == b"IHDR":
            width, height = struct.unpack(">II", head[16:24])
        elif head[:2] == b"\xff\xd8":
            width, height = self._jpeg(file)
        else:
            raise ValueError("no PNG or JPEG image")
        file.seek(0)
        yield Block("image", page=1, width=width, height=height, content=file.read())

    @staticmethod
    def _jpeg(file: BinaryIO) -> tuple[int, int]:
        file.seek(2)
        while len(mark := file.read(4)) == 4 and mark[0] == 0xFF:
            if mark[1] == 0xFF:  # a byte that fills up
                file.seek(-3, 1)
                continue
            # frames, but for tables of Huffman codes and arithmetic conditions
            if 0xC0 <= mark[1] <= 0xCF and mark[1] not in (0xC4, 0xC8, 0xCC):
                height, width = struct.unpack(">HH", file.read(5)[1:])
                return width, height
            file.seek(struct.unpack(">H", mark[2:])[0] - 2, 1)
        raise ValueError("no frame in the JPEG image")


class TiffReader(Reader):
    """Pages of a TIFF file and their sizes, by its chain of directories; parts of `most` pages."""

    def __init__(self, most: int = 50):
        self.most = most

    def parts(self, file: BinaryIO, size: int) -> list[tuple[int, list[int]]]:
        order = self._order(file)
        at, pages = struct.unpack(order + "I", file.read(4))[0], []
        while at:
            if at in pages or at >= size:
                raise ValueError("the TIFF file's directories are broken")
            pages.append(at)
            file.seek(at)
            n = struct.unpack(order + "H", file.read(2))[0]
            file.seek(12 * n, 1)
            at = struct.unpack(order + "I", file.read(4))[0]
        return [(i + 1, pages[i : i + self.most]) for i in range(0, len(pages), self.most)]

    @staticmethod
    def _order(file: BinaryIO) -> str:
        head = file.read(4)
        if head not in (b"II*\0", b"MM\0*"):
            raise ValueError("no TIFF image")
        return "<" if head[:2] == b"II" else ">"

    def read(self, file: BinaryIO, part: tuple[int, list[int]]) -> Iterator[Block]:
        order = self._order(file)
        for page, at in enumerate(part[1], part[0]):
            file.seek(at)
            sizes = {}
            for _ in range(struct.unpack(order + "H", file.read(2))[0]):
                tag, kind, _n = struct.unpack(order + "HHI", file.read(8))
                value = file.read(4)
                if tag in (256, 257):  # width and height, as a short or a long
                    sizes[tag] = struct.unpack(order + ("H" if kind == 3 else "I"), value[: 2 if kind == 3 else 4])[0]
            yield Block("image", page=page, width=sizes.get(256), height=sizes.get(257))


#: Built in, by extension; PDF and older Word files need a reader that is plugged in.
READERS: dict[str, Reader] = {"docx": WordReader(), "png": ImageReader(), "jpg": ImageReader(), "jpeg": ImageReader(), "tif": TiffReader(), "tiff": TiffReader()}
