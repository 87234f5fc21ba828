"""ESRI shapefiles (.shp, .shx, .dbf, .prj) as a Spark data source, from the published format.

``spark.read.format("shapefile").load("x.shp")`` gives fid, the attributes and ``shape``:
struct<kind string, parts array<array<struct<x, y>>>>.  Records are dealt to partitions by ranges
of the .shx index.  A path may also be a folder of shapefiles, a zip archive with all its shapefiles,
or one member, ``x.zip/dir/y.shp``; members are read where they lie, nothing is unpacked: by ranges
where they are stored, one task a member where they are compressed.

``df.write.format("shapefile").save("folder")`` writes complete shapefiles, one a task, each with its
index, header and box; the driver sees no row.  With a path ``x.shp`` the parts are put together at
the commit, as blocks of bytes that are not decoded; only the offsets of the index are made anew.
Paths are local or on a file system that all executors mount.
"""

from __future__ import annotations

import math
import os
import shutil
import struct
import uuid
import zipfile
from collections.abc import Iterator
from typing import BinaryIO

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import ArrayType, BooleanType, DateType, DoubleType, LongType, StringType, StructField, StructType

SHAPE = "struct<kind:string,parts:array<array<struct<x:double,y:double>>>>"
KINDS = {0: "null", 1: "point", 3: "polyline", 5: "polygon", 8: "multipoint"}
CODES = {v: k for k, v in KINDS.items()}
SIDECARS = (".shp", ".shx", ".dbf", ".prj", ".cpg")


def expand(files: list[str]) -> list[str]:
    """Every .shp with its side-car files; others as they are."""
    return [f[:-4] + e for f in files for e in (SIDECARS if f.endswith(".shp") else ("",))] if files else []


def pack_zip(shp: str, target: str) -> None:
    """All files of a shapefile in one zip."""
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for f in dict.fromkeys(expand([shp])):
            if os.path.exists(f):
                z.write(f, os.path.basename(f))


class Place:
    """One shapefile: its stem, and the zip archive that holds it or None."""

    def __init__(self, stem: str, archive: str | None = None):
        self.stem, self.archive = stem, archive

    def open(self, ext: str) -> BinaryIO:
        if self.archive is None:
            return open(self.stem + ext, "rb")
        try:
            return zipfile.ZipFile(self.archive).open(self.stem + ext)
        except KeyError:
            raise FileNotFoundError(f"{self.archive}/{self.stem}{ext}") from None

    def size(self, ext: str) -> int:
        if self.archive is None:
            return os.path.getsize(self.stem + ext)
        with zipfile.ZipFile(self.archive) as z:
            return z.getinfo(self.stem + ext).file_size

    def packed(self) -> bool:
        """Whether its files are compressed, so that they can only be read from the start."""
        if self.archive is None:
            return False
        with zipfile.ZipFile(self.archive) as z:
            return any(z.getinfo(self.stem + e).compress_type != zipfile.ZIP_STORED for e in (".shp", ".shx", ".dbf"))


def places_of(path: str) -> list[Place]:
    """The shapefiles of a path: one file, a folder of them, an archive of them, or a member of an archive.

    FileNotFoundError where there is none.
    """
    at = path.find(".zip/")
    archive, member = (path[: at + 4], path[at + 5 :]) if at >= 0 else (path if path.endswith(".zip") else None, "")
    if archive:
        if not os.path.isfile(archive):
            raise FileNotFoundError(archive)
        with zipfile.ZipFile(archive) as z:
            names = sorted(n for n in z.namelist() if n.endswith(".shp") and n.startswith(member))
        found = [Place(n[:-4], archive) for n in names if not member or n == member or n.startswith(member.rstrip("/") + "/")]
    elif os.path.isdir(path):
        found = [Place(os.path.join(path, n)[:-4]) for n in sorted(os.listdir(path)) if n.endswith(".shp")]
    else:
        found = [Place(path[:-4])] if os.path.isfile(path) else []
    if not found:
        raise FileNotFoundError(path)
    return found


def crs_of(shp: str) -> str | None:
    """The text of the .prj file (of the first shapefile of a folder or archive), None without one."""
    try:
        with places_of(shp)[0].open(".prj") as f:
            return f.read().decode().strip()
    except FileNotFoundError:
        return None


def dbf_fields(file: BinaryIO) -> tuple[list[tuple], int, int, int]:
    """(name, type, length, decimals) of each field; records; header and record size.  Reads the header, no more."""
    n, header, size = struct.unpack("<4xIHH20x", file.read(32))
    fields = []
    while (raw := file.read(1)) not in (b"\r", b""):
        raw += file.read(31)
        fields.append((raw[:11].split(b"\0")[0].decode(), chr(raw[11]), raw[16], raw[17]))
    file.read(max(0, header - 33 - 32 * len(fields)))
    return fields, n, header, size


def _type(kind: str, decimals: int):
    if kind in "NF":
        return DoubleType() if decimals or kind == "F" else LongType()
    return {"L": BooleanType(), "D": DateType()}.get(kind, StringType())


def _value(raw: bytes, kind: str, decimals: int):
    import datetime

    text = raw.decode("utf-8", "replace").strip().strip("\0")
    if not text or text.strip("*") == "":
        return None
    if kind in "NF":
        return float(text) if decimals or kind == "F" else int(float(text))
    if kind == "L":
        return {"T": True, "Y": True, "F": False, "N": False}.get(text.upper())
    return datetime.date(int(text[:4]), int(text[4:6]), int(text[6:8])) if kind == "D" else text


def decode_shape(raw: bytes):
    """(kind, parts) of a record's content, None for a null shape."""
    kind = KINDS.get(struct.unpack_from("<i", raw)[0])
    if kind is None:
        raise ValueError("unsupported kind of shape")
    if kind == "null":
        return None
    if kind == "point":
        return kind, [[struct.unpack_from("<2d", raw, 4)]]
    if kind == "multipoint":
        (n,) = struct.unpack_from("<i", raw, 36)
        return kind, [list(struct.iter_unpack("<2d", raw[40 : 40 + 16 * n]))]
    parts, n = struct.unpack_from("<2i", raw, 36)
    starts = [*struct.unpack_from(f"<{parts}i", raw, 44), n]
    at = 44 + 4 * parts
    points = list(struct.iter_unpack("<2d", raw[at : at + 16 * n]))
    return kind, [points[a:b] for a, b in zip(starts, starts[1:])]


def encode_shape(shape) -> bytes:
    if shape is None:
        return struct.pack("<i", 0)
    kind, parts = shape["kind"], [[(p["x"], p["y"]) for p in part] for part in shape["parts"]]
    points = [p for part in parts for p in part]
    if kind == "point":
        return struct.pack("<i2d", 1, *points[0])
    box = (min(p[0] for p in points), min(p[1] for p in points), max(p[0] for p in points), max(p[1] for p in points))
    body = b"".join(struct.pack("<2d", *p) for p in points)
    if kind == "multipoint":
        return struct.pack("<i4di", 8, *box, len(points)) + body
    starts = [sum(len(q) for q in parts[:k]) for k in range(len(parts))]
    return struct.pack(f"<i4d2i{len(parts)}i", CODES[kind], *box, len(parts), len(points), *starts) + body


def layout_of(place: Place) -> list[tuple]:
    with place.open(".dbf") as f:
        return dbf_fields(f)[0]


class Records(InputPartition):
    def __init__(self, place: Place, first: int, last: int, before: int):
        self.place, self.first, self.last, self.before = place, first, last, before


class ShapefileReader(DataSourceReader):
    def __init__(self, path: str, schema: StructType, options: dict):
        self.path, self.schema = path, schema
        self.size, self.shapes = int(options.get("records", 10_000)), options.get("shapes", "true").lower() == "true"

    def partitions(self) -> list[InputPartition]:
        out, before = [], 0
        for place in places_of(self.path):
            n = (place.size(".shx") - 100) // 8
            step = max(n, 1) if place.packed() else self.size
            out += [Records(place, a, min(n, a + step), before) for a in range(0, n, step)]
            before += n  # fids of a folder or archive go on from file to file
        return out or [Records(places_of(self.path)[0], 0, 0, 0)]

    def read(self, part: Records) -> Iterator[tuple]:
        names = [f.name for f in self.schema.fields if f.name not in ("fid", "shape")]
        with part.place.open(".shp") as shp, part.place.open(".shx") as shx, part.place.open(".dbf") as dbf:
            fields, _, header, size = dbf_fields(dbf)
            if [f[0] for f in fields] != names:
                raise ValueError(f"{part.place.stem} has the fields {[f[0] for f in fields]}, not {names}")
            shx.seek(100 + 8 * part.first)
            dbf.seek(header + size * part.first)
            for fid in range(part.first, part.last):
                offset, length = struct.unpack(">2i", shx.read(8))
                row, at, values = dbf.read(size), 1, [part.before + fid]
                for _, kind, width, decimals in fields:
                    values.append(_value(row[at : at + width], kind, decimals))
                    at += width
                if self.shapes:
                    shp.seek(2 * offset + 8)
                    if (shape := decode_shape(shp.read(2 * length))) is None:
                        continue  # null shapes are left out when shapes are read
                    values.append(shape)
                yield tuple(values)


_NO_BOX = (math.inf, math.inf, -math.inf, -math.inf)


def _joined_box(a: tuple, b: tuple) -> tuple:
    return (min(a[0], b[0]), min(a[1], b[1]), max(a[2], b[2]), max(a[3], b[3]))


def _box_of(raw: bytes) -> tuple:
    """The box of an encoded shape."""
    kind = struct.unpack_from("<i", raw)[0]
    if kind == 0:
        return _NO_BOX
    return struct.unpack_from("<2d", raw, 4) * 2 if kind == 1 else struct.unpack_from("<4d", raw, 4)


def _header(words: int, code: int, box: tuple) -> bytes:
    """The header of a .shp or .shx file of so many 16-bit words."""
    return struct.pack(">i5ii", 9994, 0, 0, 0, 0, 0, words) + struct.pack("<2i8d", 1000, code, *(box if box[0] <= box[2] else (0.0,) * 4), 0, 0, 0, 0)


class Part(WriterCommitMessage):
    """What a task has written: its stem, the number of its records, the bytes of its .shp, kind and box."""

    def __init__(self, stem: str, n: int, size: int, code: int, box: tuple):
        self.stem, self.n, self.size, self.code, self.box = stem, n, size, code, box


class ShapefileWriter(DataSourceWriter):
    def __init__(self, path: str, schema: StructType, options: dict, overwrite: bool = False):
        self.path, self.schema, self.wkt, self.zip = path, schema, options.get("wkt"), options.get("zip")
        self.single, self.overwrite = path.endswith(".shp"), overwrite
        # parts are written here, and are whole before any of them is seen under the path
        self.staging = os.path.join(os.path.dirname(path) if self.single else path, f".shapefile-{uuid.uuid4().hex}")
        kinds = {f.name: f.dataType for f in schema.fields}
        self.layout = [(name, *_field(kinds[name])) for name in self._names()]
        long = [n for n in self._names() if len(n.encode()) > 10]  # the format's limit
        if long:
            raise ValueError(f"field names of more than 10 bytes: {long}")
        if self.zip and not self.single:
            raise ValueError("a folder of shapefiles is not packed; write one file")

    def _dbf_header(self, n: int) -> bytes:
        size = 1 + sum(w for _, _, w, _ in self.layout)
        fields = b"".join(struct.pack("<11sc4xBB14x", name[:10].encode(), kind.encode(), w, dec) for name, kind, w, dec in self.layout)
        return struct.pack("<4BIHH20x", 3, 124, 1, 1, n, 33 + 32 * len(self.layout), size) + fields + b"\r"

    def write(self, rows: Iterator) -> WriterCommitMessage:
        os.makedirs(self.staging, exist_ok=True)
        stem = os.path.join(self.staging, f"part-{uuid.uuid4().hex}")
        names, at, n, code, box = self._names(), 50, 0, 0, _NO_BOX
        with open(stem + ".shp", "wb") as shp, open(stem + ".shx", "wb") as shx, open(stem + ".dbf", "wb") as dbf:
            shp.write(bytes(100))
            shx.write(bytes(100))
            dbf.write(self._dbf_header(0))
            for row in rows:
                raw = encode_shape(row["shape"])
                kind, n = struct.unpack_from("<i", raw)[0], n + 1
                if kind and code and kind != code:
                    raise ValueError(f"a shapefile holds one kind of shape, not {KINDS[code]} and {KINDS[kind]}")
                code, box = code or kind, _joined_box(box, _box_of(raw))
                shp.write(struct.pack(">2i", n, len(raw) // 2) + raw)
                shx.write(struct.pack(">2i", at, len(raw) // 2))
                at += 4 + len(raw) // 2
                dbf.write(b" " + b"".join(self._cell(row[c], kind, w, dec) for c, (_, kind, w, dec) in zip(names, self.layout)))
            self._finish(shp, shx, dbf, at, n, code, box)
        return Part(stem, n, 2 * at, code, box)

    def _finish(self, shp: BinaryIO, shx: BinaryIO, dbf: BinaryIO, words: int, n: int, code: int, box: tuple) -> None:
        for f, raw in ((shp, _header(words, code, box)), (shx, _header(50 + 4 * n, code, box)), (dbf, self._dbf_header(n))):
            f.seek(0)
            f.write(raw)

    def _names(self) -> list[str]:
        return [f.name for f in self.schema.fields if f.name not in ("shape", "fid")]

    def commit(self, messages: list) -> None:
        parts = [m for m in messages if m is not None]
        codes = {m.code for m in parts} - {0}
        if len(codes) > 1:
            self.abort(messages)
            raise ValueError(f"a shapefile holds one kind of shape, not {sorted(KINDS[c] for c in codes)}")
        (self._one_file if self.single else self._folder)(parts, max(codes, default=0))
        shutil.rmtree(self.staging, ignore_errors=True)

    def _folder(self, parts: list, code: int) -> None:
        """Give the parts their names; those of before go, if they are to be replaced."""
        os.makedirs(self.path, exist_ok=True)
        if self.overwrite:
            for name in os.listdir(self.path):
                if name.endswith(SIDECARS):
                    os.remove(os.path.join(self.path, name))
        for k, m in enumerate(parts):
            stem = os.path.join(self.path, f"part-{k:05d}-{os.path.basename(m.stem)[5:13]}")
            if self.wkt:
                with open(m.stem + ".prj", "w") as f:
                    f.write(self.wkt)
            for ext in (".dbf", ".shx", ".prj", ".shp"):  # the .shp last: with it the others are there
                if os.path.exists(m.stem + ext):
                    os.rename(m.stem + ext, stem + ext)

    def _one_file(self, parts: list, code: int) -> None:
        """Put the bodies of the parts behind one another, with the offsets of the index moved."""
        import numpy as np

        stem, at, n, box, head, begins = self.path[:-4], 50, 0, _NO_BOX, len(self._dbf_header(0)), []
        with open(self.path, "wb") as shp, open(stem + ".shx", "wb") as shx, open(stem + ".dbf", "wb") as dbf:
            for f, size in ((shp, 100), (shx, 100), (dbf, head)):
                f.write(bytes(size))
            for m in parts:
                with open(m.stem + ".shp", "rb") as f:
                    f.seek(100)
                    shutil.copyfileobj(f, shp, 1 << 22)
                with open(m.stem + ".dbf", "rb") as f:
                    f.seek(head)
                    shutil.copyfileobj(f, dbf, 1 << 22)
                with open(m.stem + ".shx", "rb") as f:
                    f.seek(100)
                    while block := f.read(1 << 20):
                        index = np.frombuffer(block, ">i4").copy()
                        index[::2] += at - 50
                        shx.write(index.tobytes())
                begins.append((2 * at, m, n))
                at, n, box = at + m.size // 2 - 50, n + m.n, _joined_box(box, m.box)
            self._finish(shp, shx, dbf, at, n, code, box)
        for begin, m, before in begins:
            if before and m.n:
                self._renumber(self.path, begin, m, before)
        if self.wkt:
            with open(stem + ".prj", "w") as f:
                f.write(self.wkt)
        if self.zip:
            pack_zip(self.path, self.zip)

    @staticmethod
    def _renumber(path: str, begin: int, part: Part, before: int) -> None:
        """Records of a part that now begins at ``begin`` are counted on from ``before``; a page of them at once."""
        import numpy as np

        body = np.memmap(path, np.uint8, "r+")
        with open(part.stem + ".shx", "rb") as f:
            f.seek(100)
            while block := f.read(1 << 20):
                offsets = np.frombuffer(block, ">i4")[::2].astype(np.int64)
                numbers = np.arange(before + 1, before + 1 + len(offsets), dtype=">i4")
                body[(begin + 2 * (offsets - 50))[:, None] + np.arange(4)] = numbers.view(np.uint8).reshape(-1, 4)
                before += len(offsets)
        body.flush()

    @staticmethod
    def _cell(v, kind: str, width: int, decimals: int) -> bytes:
        if v is None:
            return b" " * width
        text = repr(float(v)) if kind == "F" else str(int(v)) if kind == "N" else ("T" if v else "F") if kind == "L" else v.strftime("%Y%m%d") if kind == "D" else str(v)
        raw = text.encode()
        if len(raw) > width:
            raise ValueError(f"a value of {len(raw)} bytes does not fit into a field of {width}: {text[:40]!r}")
        return raw.rjust(width) if kind in "FN" else raw.ljust(width)

    def abort(self, messages: list) -> None:
        shutil.rmtree(self.staging, ignore_errors=True)


def _field(t) -> tuple[str, int, int]:
    """Type, length and decimals of the field for a column."""
    if t.typeName() in ("double", "float"):
        return "F", 24, 15
    return ("N", 20, 0) if t.typeName() in ("long", "integer", "short", "byte") else ("L", 1, 0) if isinstance(t, BooleanType) else ("D", 8, 0) if isinstance(t, DateType) else ("C", 254, 0)


class ShapefileSource(DataSource):
    """Options: shapes (false: attributes only), records (per partition), wkt and zip (when writing)."""

    @classmethod
    def name(cls) -> str:
        return "shapefile"

    def _path(self) -> str:
        return self.options["path"].removeprefix("file://")

    def schema(self) -> StructType:
        fields = layout_of(places_of(self._path())[0])
        out = StructType([StructField("fid", LongType())] + [StructField(n, _type(k, d)) for n, k, _, d in fields])
        if self.options.get("shapes", "true").lower() == "true":
            point = StructType([StructField("x", DoubleType()), StructField("y", DoubleType())])
            out.add("shape", StructType([StructField("kind", StringType()), StructField("parts", ArrayType(ArrayType(point)))]))
        return out

    def reader(self, schema: StructType) -> ShapefileReader:
        return ShapefileReader(self._path(), schema, dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> ShapefileWriter:
        return ShapefileWriter(self._path(), schema, dict(self.options), overwrite)
