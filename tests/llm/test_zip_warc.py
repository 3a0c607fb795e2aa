import base64
import hashlib
import io
import zipfile

from pyspark.sql import functions as F

from tessera.llm import zip_warc as Z

KIND = "page_id long, url string, html string, lang string"


def test_round_trip(spark, tmp_path):
    rows = [(5, "http://a/ b", "x" * 9, "e"), (3, None, "x" * 9, "e"), (9, "u", "", "e"), (7, "u", None, "e"), (1, "http://é", "ünï\r\n\r\n" * 40, "e"), (2, "v", "y", "e"), (8, "v", "z" * 300_000, "e"), (3, None, "x" * 9, "e")]
    folder = f"file://{tmp_path}/w"
    df = spark.createDataFrame(rows, KIND).repartition(3)
    packages = Z.write_packages(df, folder)
    got = sorted((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, bytes(r.payload)) for r in Z.read_records(packages, folder).collect())
    first = {}
    for i, _, h, _ in sorted(rows, key=lambda r: r[0]):
        first.setdefault(h or "", i)
    want = []
    for i, _, h, _ in rows:
        raw = (h or "").encode()
        again = first[h or ""] != i
        want.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if again else "response", first[h or ""] if again else None, b"" if again else raw))
    assert got == sorted(want, key=lambda x: x[:4])
    for r in packages.collect():  # other readers agree
        with zipfile.ZipFile(r.path) as z:
            assert z.testzip() is None and "indexes/index.cdxj" in z.namelist()
    large = Z.read_records(Z.write_packages(df, folder + "2", least=100), folder + "2")
    assert large.where("payload_bytes < 100 and record_type = 'revisit'").isEmpty()


def test_pages_with_two_payloads(spark, tmp_path):
    rows = [(1, "a", "first", "e"), (2, "b", "second", "e"), (5, "c", "first", "e"), (5, "d", "third", "e"), (6, "e", "first", "e"), (6, "f", "second", "e")]
    folder = f"file://{tmp_path}/w"
    got = sorted((r.page_id, r.url, r.record_type, r.refers_to, bytes(r.payload)) for r in Z.read_records(Z.write_packages(spark.createDataFrame(rows, KIND), folder), folder).collect())
    assert got == [
        (1, "a", "response", None, b"first"), (2, "b", "response", None, b"second"), (5, "c", "revisit", 1, b""), (5, "d", "response", None, b"third"),
        (6, "e", "revisit", 1, b""), (6, "f", "revisit", 2, b""),
    ]


def test_plain_zip_directory():
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("a.txt", "hello")
        z.writestr("b/ü.txt", "wörld", compress_type=zipfile.ZIP_DEFLATED)
    d = Z.directory(buf, len(buf.getvalue()))
    assert d["a.txt"][1:] == (5, 5, 0) and d["b/ü.txt"][3] == 8
    buf.seek(Z.data_place(buf, d["a.txt"][0]))
    assert buf.read(5) == b"hello"


def test_empty(spark, tmp_path):
    assert Z.read_records(Z.write_packages(spark.createDataFrame([], KIND), f"file://{tmp_path}/e"), f"file://{tmp_path}/e").select(F.count("*")).first()[0] == 0


def test_pages_without_an_id(spark, tmp_path):
    """They revisit the page with the same payload that has one; among themselves they are all responses."""
    rows = [(None, "a", "first", "e"), (4, "b", "first", "e"), (None, "c", "second", "e"), (None, "d", "second", "e"), (9, "e", "first", "e")]
    folder = f"file://{tmp_path}/n"
    got = sorted(((r.page_id, r.url, r.record_type, r.refers_to) for r in Z.read_records(Z.write_packages(spark.createDataFrame(rows, KIND), folder), folder).collect()), key=str)
    assert got == sorted([(4, "b", "response", None), (9, "e", "revisit", 4), (None, "a", "revisit", 4), (None, "c", "response", None), (None, "d", "response", None)], key=str)
