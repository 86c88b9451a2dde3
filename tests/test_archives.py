"""The archive source: what is read, what is not, how archives are cut, and what comes of broken ones."""

import io
import zipfile

import pytest
from pyspark.sql.types import StructType

from folioframe.operators import document as D
from folioframe.sources import archives as A
from folioframe.sources import package as P


def zipped(parts: dict[str, bytes]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, content in parts.items():
            z.writestr(name, content)
    return out.getvalue()


def sparse(path, holes: dict[str, int], parts: dict[str, bytes]) -> None:
    """An archive of stored entries that are holes in the file (their CRC is wrong) and of ordinary ones behind them."""
    with zipfile.ZipFile(path, "w") as z:
        for name, size in holes.items():
            info = zipfile.ZipInfo(name)
            info.file_size = info.compress_size = size
            info.CRC, info.header_offset = 1, z.fp.tell()
            z.fp.write(info.FileHeader())
            z.fp.seek(size, 1)
            z.filelist.append(info)
            z.NameToInfo[name] = info
            z.start_dir = z.fp.tell()
            z._didModify = True
        for name, content in parts.items():
            z.writestr(name, content)


class Counting:
    """A file that counts the bytes read of it."""

    def __init__(self, file, seen: list[int]):
        self.file, self.seen = file, seen

    def read(self, n=-1):
        got = self.file.read(None if n is None or n < 0 else n)
        self.seen.append(len(got))
        return got

    def __getattr__(self, name):
        return getattr(self.file, name)

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.file.close()


def test_sections_of_three_gigabytes(spark, tmp_path):
    """Read in full, in a few ranges, without a byte of the pictures."""
    section = b"<hs:sec xmlns:hp='p' xmlns:hs='s'><hp:p><hp:run><hp:t>said</hp:t></hp:run></hp:p></hs:sec>"
    sparse(tmp_path / "big.zip", {f"BinData/{i}.png": 3 << 28 for i in range(4)}, {p: c for _, p, c in P.blank() if not p.endswith("section0.xml")} | {"Contents/section0.xml": section})
    assert (tmp_path / "big.zip").stat().st_size > 3 << 30
    entries = P.read_archives(spark, str(tmp_path / "*.zip"), names=P.PARSED)
    assert [r.text for r in D.plain_text(D.paragraph_texts(P.flatten(entries))).collect()] == ["said"]
    names = A.load(spark, str(tmp_path / "big.zip"), "path string, size bigint")
    assert names.rdd.getNumPartitions() >= 24 and names.count() == 9 and names.where("size > 100000000").count() == 4
    large = A.load(spark, str(tmp_path / "big.zip"), maxEntry=1 << 20).where("content is null")
    assert {(r.path, r.reason) for r in large.collect()} == {(f"BinData/{i}.png", "larger than 1048576 bytes") for i in range(4)}

    seen: list[int] = []
    reader = A.Reader(StructType.fromDDL(A.SCHEMA), {"path": str(tmp_path / "big.zip"), "names": P.SECTIONS})
    opened = reader.opened
    reader.opened = lambda path: Counting(opened(path), seen)
    told = [b for part in reader.partitions() for b in reader.read(part)]
    assert sum(b.num_rows for b in told) == 1 and sum(seen) < 10_000 * len(reader.partitions())


def test_filters_reach_the_source(spark, tmp_path):
    for name in "ab":
        (tmp_path / f"{name}.zip").write_bytes(zipped({"Contents/section0.xml": b"<s/>", "BinData/x.png": b"\x89PNG", "dir/": b""}))
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        rows = lambda: A.load(spark, str(tmp_path / "*.zip"), pushdown=True)
        asked = rows().where("path like 'Contents/%' and path like '%.xml' and doc_id like '%a.zip' and size > 1")
        plan = asked._jdf.queryExecution().executedPlan().toString()
        assert "startswith" not in plan.lower() and "size" in plan.split("Filter", 1)[1]
        assert [(r.doc_id, r.path, bytes(r.content)) for r in asked.collect()] == [(f"file:{tmp_path}/a.zip", "Contents/section0.xml", b"<s/>")]
        assert rows().where("path in ('BinData/x.png', 'no')").count() == 2 and rows().where("path = 'no'").count() == 0 and rows().count() == 4
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    kept = A.load(spark, str(tmp_path / "*.zip"))
    assert kept.where("path like 'Contents/%'").count() == 2 and kept.where("path = 'no'").count() == 0 and kept.count() == 4


@pytest.mark.parametrize("named", ["*.zip", ""])
def test_broken_archives_and_entries(spark, tmp_path, named):
    whole = zipped({"a.txt": b"some words here", "b.txt": b"others"})
    (tmp_path / "ok.zip").write_bytes(whole)
    (tmp_path / "none.zip").write_bytes(b"no archive")
    (tmp_path / "empty.zip").write_bytes(b"")
    (tmp_path / "bent.zip").write_bytes(whole.replace(b"some words", b"sOme words"))
    rows = A.load(spark, str(tmp_path / named))
    got = {(r.doc_id.rsplit("/", 1)[1], r.path): (r.content and bytes(r.content), r.reason) for r in rows.collect()}
    assert got["ok.zip", "a.txt"] == (b"some words here", None) and got["bent.zip", "b.txt"] == (b"others", None)
    assert got["bent.zip", "a.txt"][0] is None and "CRC" in got["bent.zip", "a.txt"][1]
    assert {k for k in got if k[1] == A.BROKEN} == {("none.zip", A.BROKEN), ("empty.zip", A.BROKEN)} and len(got) == 6


def test_every_cut_reads_every_entry_once(spark, tmp_path):
    parts = {f"d{i}/{i}.txt": bytes([i]) * (i * 37) for i in range(60)}
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "a.zip").write_bytes(zipped(parts))
    for most in (100, 5_000, 1 << 30):
        got = A.load(spark, f"file:{tmp_path}/*/*.zip", maxBytes=most).collect()
        assert sorted((r.path, bytes(r.content)) for r in got) == sorted(parts.items())
    assert A.load(spark, f"{tmp_path}/*.zip").count() == 0
    assert [len(s.files) for s in A.sliced([("a", 10), ("b", 0), ("c", 300 << 20)], 128 << 20)] == [3, 1, 1]
    with pytest.raises(Exception, match="no columns"):
        A.load(spark, str(tmp_path), "doc_id string, other string").collect()


def test_saved_and_read_again(spark, tmp_path):
    rows = [("/x/d", p, c) for _, p, c in P.blank()] + [("/y/d", p, c) for _, p, c in P.blank(title="t")] + [("bad", "../up", b"")]
    saved = {r.doc_id: r for r in A.save(P.pack(spark.createDataFrame(rows, P.ENTRIES)), f"{tmp_path}/out").collect()}
    assert saved["bad"].file is None and "unsafe" in saved["bad"].reason and saved["/x/d"].file != saved["/y/d"].file
    back = P.read_archives(spark, f"{tmp_path}/out/*.zip")
    assert {(r.doc_id, r.path, bytes(r.content)) for r in back.collect()} == {(saved[d].file, p, c) for d, p, c in rows if d != "bad"}
