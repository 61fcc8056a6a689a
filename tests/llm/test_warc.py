from pyspark.sql import functions as F

from lodestone.llm import warc as W


def rows(df):
    return {r["origin_id"]: (r["segments"], r["length"], r["status"], None if r["body"] is None else bytes(r["body"])) for r in df.collect()}


def test_pages_come_back(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    got = rows(W.reassemble(W.as_records(pages)))
    want = {f"urn:page:{r['page_id']}": r["html"].encode() for r in pages.collect()}
    assert {k: v[3] for k, v in got.items()} == want and {v[2] for v in got.values()} == {"ok"}


def test_broken_records(spark):
    whole = {name: W.segments(name, "".join(chr(97 + k % 26) for k in range(9000))) for name in "abcdefgh"}
    bad = []
    for r, o, n, t, p in whole["b"]:
        if n != 2:
            bad.append((r, o, n, t, p))
    bad += [(r, o, n, t + 1 if t else None, p) for r, o, n, t, p in whole["c"]]
    bad += [*whole["d"], *whole["d"]]
    bad += [*whole["e"], (*whole["e"][0][:4], b"other")]
    bad += [(r, o, n, t, p) for r, o, n, t, p in whole["f"] if t is None]
    bad += [("g", None, None, None, W._HEAD + b"zz\r\nabc"), (None, None, 1, None, b"lost"), ("h", None, None, None, None), ("i", None, None, None, b"plain")]
    bad += [("j", None, 1, None, W._HEAD + b"3;x=y\r\nabc\r\n0\r\nTrailer: 1\r\n\r\n"), ("k", None, 1, 3, b"HTTP/1.1 200 OK\r\n\r\nraw"), ("l", None, 1, None, W._HEAD + b"5\r\nabc\r\n0\r\n\r\n")]
    df = spark.createDataFrame([*whole["a"], *bad], W.RECORDS).withColumn("body", F.lit(1)).withColumn("status", F.lit("x"))
    got = rows(W.reassemble(df))
    status = {k: v[2] for k, v in got.items()}
    assert status == {"a": "ok", "b": "missing_segment", "c": "length_mismatch", "d": "ok", "e": "conflict", "f": "missing_segment", "g": "bad_framing", "h": "ok", "i": "ok", "j": "ok", "k": "length_mismatch", "l": "bad_framing"}
    assert got["d"] == got["a"] and got["h"][3] == b"" and got["i"][3] == b"plain" and got["j"][3] == b"abc" and got["b"][3] is None
    assert W.reassemble(df.limit(0)).count() == 0


def test_odd_pages(spark):
    pages = spark.createDataFrame([(1, None), (2, ""), (3, "é" * 300_000), (None, "x"), (4, "0\r\n\r\n")], "page_id long, html string")
    got = rows(W.reassemble(W.as_records(pages)))
    assert {k: v[3].decode() for k, v in got.items()} == {"urn:page:1": "", "urn:page:2": "", "urn:page:3": "é" * 300_000, "urn:page:4": "0\r\n\r\n"}


def test_files(spark, tmp_path):
    one, two = W.segments("p", "x" * 5000), W.segments("q", "y" * 100)
    (tmp_path / "a.warc").write_bytes(W.to_bytes([*one[:1], *two]))
    (tmp_path / "b.warc.gz").write_bytes(W.to_bytes(one[1:], compressed=True))
    got = rows(W.reassemble(W.read(spark, str(tmp_path))))
    assert {k: v[2:] for k, v in got.items()} == {"p": ("ok", b"x" * 5000), "q": ("ok", b"y" * 100)}


def test_damaged_files(spark, tmp_path):
    one, two = W.segments("p", "x" * 5000), W.segments("q", "y" * 100)
    whole = W.to_bytes([*one, *two])
    (tmp_path / "zeros.warc.gz").write_bytes(W.to_bytes([*one, *two], compressed=True) + bytes(5000))
    assert {k: v[2] for k, v in rows(W.reassemble(W.read(spark, str(tmp_path)))).items()} == {"p": "ok", "q": "ok"}

    def read(data, name="a.warc"):
        for f in tmp_path.iterdir():
            f.unlink()
        (tmp_path / name).write_bytes(data)
        return {k.rsplit("/")[-1]: v[2:] for k, v in rows(W.reassemble(W.read(spark, str(tmp_path)))).items()}

    assert read(whole[:-60]) == {"p": ("ok", b"x" * 5000), "q": ("damaged", None)}  # cut off by the end of the file
    at = whole.index(b"Content-Length: ", 100) + 16
    assert {k: v[0] for k, v in read(whole[:at] + b"x" + whole[at + 1 :]).items()} == {"p": "damaged", "q": "ok"}
    assert {k: v[0] for k, v in read(whole.replace(b"Segment-Number: 2", b"Segment-Number: z")).items()} == {"p": "damaged", "q": "ok"}
    packed = W.to_bytes([*two, *one], compressed=True)
    assert set(v[0] for v in read(packed[:-20], "a.warc.gz").values()) == {"ok", "damaged"}
    assert read(packed + b"garbage", "a.warc.gz")["q"][0] == "ok"
    middle = len(packed) // 2
    got = read(packed[:middle] + b"!!!!" + packed[middle + 4 :], "a.warc.gz")
    assert got["q"] == ("ok", b"y" * 100) and "damaged" in {v[0] for v in got.values()}
    assert read(b"") == {} and read(b"no records here") == {}
    assert [v[0] for v in read(b"WARC/1.0\r\nWARC-Type: response").values()] == ["damaged"]


def test_streams_of_any_block_size(monkeypatch):
    import io

    records = [r for name in "abc" for r in W.segments(name, name * 7000)]
    want = [(*r, False) for r in records]
    for size in (1, 7, 1000, 1 << 20):
        monkeypatch.setattr(W, "READ_BYTES", size)
        for compressed in (False, True):
            assert list(W.parse(io.BytesIO(W.to_bytes(records, compressed)))) == want
