"""Files with one feature each, made from table rows: fonts, drawing, structure, storage and encryption as a writer would lay them down."""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from inkwell.functions import crypto
from inkwell.plans.synth import stream, write_pdf
from inkwell.sources.shared import shared_dir

COURIER = b"<< /Type /Font /Subtype /Type1 /BaseFont /Courier /Encoding /WinAnsiEncoding >>"
HELVETICA = b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding >>"


class Book:
    """Objects of a file; 1 is the catalog and 2 the page tree, which are filled in at the end."""

    def __init__(self, box: tuple[int, int, int, int] = (0, 0, 612, 792)):
        self.objects: list[bytes] = [b"", b""]
        self.pages: list[int] = []
        self.resources: dict[str, bytes] = {}
        self.catalog, self.box = b"", box

    def add(self, body: bytes) -> int:
        self.objects.append(body)
        return len(self.objects)

    def resource(self, kind: str, name: str, body: bytes, direct: bool = False) -> None:
        self.resources[kind] = self.resources.get(kind, b"") + (b"/%s %s " % (name.encode(), body) if direct else b"/%s %d 0 R " % (name.encode(), self.add(body)))

    def page(self, content: bytes, attrs: bytes = b"", **how) -> int:
        at = self.add(stream(content, **how))
        self.pages.append(self.add(b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R %s >>" % (at, attrs)))
        return self.pages[-1]

    def bodies(self) -> list[bytes]:
        kinds = b" ".join(b"/%s << %s >>" % (k.encode(), v) for k, v in self.resources.items())
        kids = b" ".join(b"%d 0 R" % n for n in self.pages)
        self.objects[0] = b"<< /Type /Catalog /Pages 2 0 R %s >>" % self.catalog
        self.objects[1] = b"<< /Type /Pages /Count %d /Kids [%s] /MediaBox [%d %d %d %d] /Resources << %s >> >>" % (len(self.pages), kids, *self.box, kinds)
        return self.objects

    def file(self, trailer: bytes = b"") -> bytes:
        return write_pdf(self.bodies(), trailer)


def one_page(content: bytes, font: bytes = COURIER, **kinds: dict[str, bytes]) -> Book:
    """A page with the font F1 and other resources by kind and name."""
    book = Book()
    book.resource("Font", "F1", font)
    for kind, named in kinds.items():
        for name, body in named.items():
            book.resource(kind, name, body)
    book.page(content)
    return book


def made(spark: SparkSession, d: str, table: str, columns: list[str], make: Callable[..., bytes]) -> DataFrame:
    """(path, content): a file for each row; the first column names it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = list(zip(*(c.to_pylist() for c in b.columns), strict=True))
            yield pa.RecordBatch.from_arrays([pa.array([str(r[0]) for r in rows], pa.string()), pa.array([make(*r) for r in rows], pa.binary())], names=["path", "content"])

    tasks = spark.sparkContext.defaultParallelism
    return spark.read.parquet(f"{d}/{table}.parquet").select(*columns).repartition(tasks, columns[0]).mapInArrow(run, "path string, content binary")


def stored(files: DataFrame) -> str:
    """Put the files of a small, fixed table into a new shared folder, as a store would hold them; gives the folder. They pass through the driver: no use for tables that grow."""
    spark = files.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    folder = shared_dir(spark, "files")
    for row in files.collect():
        path = jvm.org.apache.hadoop.fs.Path(f"{folder}/{row['path']}.pdf")
        out = path.getFileSystem(conf).create(path)
        out.write(bytearray(row["content"]))
        out.close()
    return folder


# -- storage ---------------------------------------------------------------------------------------------------


def compact_file(bodies: list[bytes]) -> bytes:
    """All objects but streams in one object stream, found through a reference stream."""
    out, places = bytearray(b"%PDF-1.5\n"), {}
    plain = [n for n, b in enumerate(bodies, 1) if b"\nstream\n" not in b]
    for n, body in enumerate(bodies, 1):
        if n not in plain:
            places[n] = len(out)
            out += b"%d 0 obj\n%s\nendobj\n" % (n, body)
    holder, index = len(bodies) + 1, len(bodies) + 2
    heads, data = b"", b""
    for n in plain:
        heads += b"%d %d " % (n, len(data))
        data += bodies[n - 1] + b"\n"
    places[holder] = len(out)
    out += b"%d 0 obj\n%s\nendobj\n" % (holder, stream(heads + data, b"/Type /ObjStm /N %d /First %d" % (len(plain), len(heads))))
    places[index] = len(out)
    rows = b"".join(
        struct.pack(">BIH", *((0, 0, 65535) if n == 0 else (2, holder, plain.index(n)) if n in plain else (1, places[n], 0))) for n in range(index + 1)
    )
    out += b"%d 0 obj\n%s\nendobj\nstartxref\n%d\n%%%%EOF\n" % (index, stream(rows, b"/Type /XRef /W [1 4 2] /Size %d /Root 1 0 R" % (index + 1)), places[index])
    return bytes(out)


def updated(first: bytes, number: int, body: bytes) -> bytes:
    """A file with a later section that replaces one object."""
    before = int(first[first.rindex(b"startxref") + 9 :].split()[0])
    at = len(first)
    more = b"%d 0 obj\n%s\nendobj\n" % (number, body)
    table = b"xref\n%d 1\n%010d 00000 n \ntrailer\n<< /Size %d /Root 1 0 R /Prev %d >>\nstartxref\n%d\n%%%%EOF\n" % (number, at, number + 1, before, at + len(more))
    return first + more + table


# -- encryption ------------------------------------------------------------------------------------------------

FILE_ID = b"0123456789abcdef"
FLAGS = -44


def _hash_of(revision: int):
    probe = crypto.Handler.__new__(crypto.Handler)
    probe.revision = revision
    return probe._hash


def encryption(version: int, revision: int, method: str, user: bytes, owner: bytes) -> tuple[bytes, bytes]:
    """(body of the encryption dictionary, file key), as the format's algorithms 2 to 9 prescribe."""
    flags = FLAGS & 0xFFFFFFFF
    hexed = lambda x: b"<" + x.hex().encode() + b">"
    if version == 5:
        hashed, key, salts = _hash_of(revision), bytes(range(32)), (b"usersalt", b"userkeys", b"ownrsalt", b"ownrkeys")
        u = hashed(user, salts[0]) + salts[0] + salts[1]
        ue = crypto.aes_cbc(hashed(user, salts[1]), bytes(16), key, encrypting=True)
        o = hashed(owner, salts[2], u) + salts[2] + salts[3]
        oe = crypto.aes_cbc(hashed(owner, salts[3], u), bytes(16), key, encrypting=True)
        more = b"/OE %s /UE %s /StmF /StdCF /StrF /StdCF /CF << /StdCF << /CFM /AESV3 /Length 32 >> >>" % (hexed(oe), hexed(ue))
        return b"<< /Filter /Standard /V 5 /R %d /Length 256 /P %d /O %s /U %s %s >>" % (revision, FLAGS, hexed(o), hexed(u), more), key
    n, rounds = (5, 0) if revision == 2 else (16, 50)
    d = hashlib.md5((owner + crypto.PADDING)[:32]).digest()
    for _ in range(rounds):
        d = hashlib.md5(d).digest()
    o = (user + crypto.PADDING)[:32]
    for i in range(20 if revision > 2 else 1):
        o = crypto.rc4(bytes(b ^ i for b in d[:n]), o)
    key = hashlib.md5((user + crypto.PADDING)[:32] + o + struct.pack("<I", flags) + FILE_ID).digest()
    for _ in range(rounds):
        key = hashlib.md5(key[:n]).digest()
    key = key[:n]
    if revision == 2:
        u = crypto.rc4(key, crypto.PADDING)
    else:
        u = hashlib.md5(crypto.PADDING + FILE_ID).digest()
        for i in range(20):
            u = crypto.rc4(bytes(b ^ i for b in key), u)
        u += bytes(16)
    more = b"/StmF /StdCF /StrF /StdCF /CF << /StdCF << /CFM /%s /Length 16 >> >>" % method.encode() if version == 4 and method != "Identity" else b"/StmF /Identity /StrF /Identity" if version == 4 else b""
    return b"<< /Filter /Standard /V %d /R %d /Length %d /P %d /O %s /U %s %s >>" % (version, revision, 8 * n, FLAGS, hexed(o), hexed(u), more), key


def encrypted(data: bytes, method: str, key: bytes, number: int) -> bytes:
    """The bytes of a string or stream of object ``number``."""
    if method == "Identity":
        return data
    own = key
    if method != "AESV3":
        own = hashlib.md5(key + struct.pack("<I", number)[:3] + b"\0\0" + (b"sAlT" if method == "AESV2" else b"")).digest()[: min(len(key) + 5, 16)]
    if method == "V2":
        return crypto.rc4(own, data)
    fill, start = 16 - len(data) % 16, hashlib.md5(b"%d" % number).digest()
    return start + crypto.aes_cbc(own, start, data + bytes([fill]) * fill, encrypting=True)


def locked(text: bytes, title: bytes, version: int, revision: int, method: str, user: bytes, owner: bytes) -> bytes:
    """A file of one page whose stream and title are encrypted."""
    book = Book()
    book.resource("Font", "F1", COURIER)
    how, key = encryption(version, revision, method, user, owner)
    at = len(book.objects) + 1
    body = encrypted(b"BT /F1 10 Tf 36 700 Td (%s) Tj ET" % text, method, key, at)
    book.add(b"<< /Length %d >>\nstream\n%s\nendstream" % (len(body), body))
    book.pages.append(book.add(b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R >>" % at))
    info = len(book.objects) + 1
    book.add(b"<< /Title <%s> >>" % encrypted(title, method, key, info).hex().encode())
    lock = book.add(how)
    return book.file(b"/Info %d 0 R /Encrypt %d 0 R /ID [<%s> <%s>]" % (info, lock, FILE_ID.hex().encode(), FILE_ID.hex().encode()))
