import gzip
import ipaddress
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.sources import csv_ingest, frames, netaddr, packed
from tessella.sources.formats import FORMATS, CsvFormat, FieldType, load_formats

LINES = [
    "3\t77\t5\t200\t9\t2024-01-02 03:04:05\t2024-01-02 03:05:05\t10.0.0.1\t2001:db8::1",
    "x\t-\t\tzz\t\tnever\t\tnowhere\t::5",
    "300\t12345678901\t7\t6\t0\t2024-01-02 03:04:05\t\t255.255.255.255\t",
]


@pytest.fixture
def flows(tmp_path):
    paths = []
    for hour in ("2024010203", "2024010204"):
        p = tmp_path / f"flow_{hour}.csv.gz"
        with gzip.open(p, "wt") as f:
            f.write("\n".join(LINES))
        paths.append(str(p))
    return paths


def test_typed_reading(spark, flows):
    rows = csv_ingest.read_csv(spark, flows[0], "example").collect()
    assert [r["small_vals"] for r in rows] == [3, -1, -1]
    assert [r["pos_ints"] for r in rows] == [77, -1, 12345678901]
    assert [r["flag"] for r in rows] == [5, 0x8000, 7]
    assert [r["flag2"] for r in rows] == [200, 6, 6]
    assert rows[0]["starttime"] == datetime(2024, 1, 2, 3, 4, 5) and rows[1]["starttime"] is None
    assert (rows[0]["srcIP"], rows[0]["srcIP2"]) == (167772161, 0)
    v6 = int(ipaddress.ip_address("2001:db8::1"))
    assert (rows[0]["dstIP"], rows[0]["dstIP2"]) == (v6 >> 64, 1)
    assert (rows[1]["dstIP"], rows[1]["dstIP2"]) == (0, 5) and rows[1]["srcIP"] is None
    plain = csv_ingest.read_csv(spark, flows, "example", sentinel=False, columns=["small_vals"])
    assert sum(r[0] is None for r in plain.collect()) == 4


def test_convert_read_concat(spark, flows, tmp_path):
    out = str(tmp_path / "out")
    assert csv_ingest.convert_files(spark, flows, out, "example") == ["flow_2024010203", "flow_2024010204"]
    csv_ingest.convert_files(spark, flows[:1], out, "example")  # again: replaced, not doubled
    assert spark.read.parquet(out).count() == 6
    parts = [f"{out}/file=flow_2024010203", f"{out}/file=flow_2024010204"]
    assert csv_ingest.read_columns(spark, parts, ["pos_ints"]).count() == 6
    meta = {r["name"]: r for r in csv_ingest.column_metadata(spark, parts[0]).collect()}
    assert meta["flag"]["dtype"] == "int" and meta["flag"]["na"] == str(0x8000) and meta["flag"]["rows"] == 3
    csv_ingest.concat_files(spark, parts, str(tmp_path / "all"))
    assert spark.read.parquet(str(tmp_path / "all")).count() == 6
    spark.range(3).write.parquet(str(tmp_path / "other"))
    with pytest.raises(ValueError, match="other columns"):
        csv_ingest.read_columns(spark, [*parts, str(tmp_path / "other")])
    with pytest.raises(ValueError, match="lacks"):
        csv_ingest.read_columns(spark, parts, ["nothing"])


def test_transforms_and_formats(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text("a,b\n1,2\n3,4\n")
    found = csv_ingest.infer_format(spark, str(p))
    assert found.fields["a"].sql == "int" and found.header
    fmt = CsvFormat({"a": FieldType("bigint", -1), "b": FieldType("bigint", -1)}, header=True, transforms=(lambda d: d.withColumn("c", F.col("a") + F.col("b")),))
    assert sorted(r["c"] for r in csv_ingest.read_csv(spark, str(p), fmt).collect()) == [3, 7]
    bad = CsvFormat(fmt.fields, header=True, transforms=(lambda d: d.withColumn("m", F.create_map(F.lit("x"), F.col("a"))),))
    with pytest.raises(TypeError, match="storable"):
        csv_ingest.read_csv(spark, str(p), bad)
    own = tmp_path / "formats.py"
    own.write_text("from tessella.sources.formats import CsvFormat, FieldType\nFORMATS = {'mine': CsvFormat({'a': FieldType('int')})}\n")
    assert load_formats(str(own)) == ["mine"] and "mine" in FORMATS


def test_text_sink(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.5), (2, 1.0)], "a long, b double")
    csv_ingest.write_text(df.coalesce(1), str(tmp_path / "t"), header=True)
    assert [r[0] for r in spark.read.text(str(tmp_path / "t")).collect()] == ["a b", "1 5.000000000000000e-01", "2 1.000000000000000e+00"]


def test_addresses_native(spark):
    df = spark.createDataFrame([("1.2.3.4",), ("1.2.3.400",), ("x",), (None,), ("::1",)], "ip string")
    native = netaddr.split_ip(df, ["ip"], v6=False).collect()
    assert [r["ip"] for r in native] == [16909060, None, None, None, None]
    assert [r["ip2"] for r in native][0] == 0


def test_packed_strings(spark):
    df = spark.createDataFrame([(0, "ab"), (1, None), (2, "ñ€"), (3, "")], "k long, s string")
    out = packed.pack_strings(df, "s", "k")
    assert [r["offset"] for r in sorted(out.collect())] == [0, 3, 4, 10]
    assert [r["value"] for r in sorted(packed.unpack_strings(out).collect())] == ["ab", "", "ñ€", ""]
    blob = spark.createDataFrame([(b"".join(bytes(r["bytes"]) for r in sorted(out.collect())),)], "values binary")
    cuts = out.select("key", "offset", F.octet_length("bytes").alias("n"))
    for piece in (1 << 20, 2, 3):
        assert [r["value"] for r in sorted(packed.slice_strings(blob, cuts, piece=piece).collect())] == ["ab", "", "ñ€", ""]


def test_save_and_insert(spark, tmp_path):
    frame = spark.createDataFrame([(i, i, "a") for i in range(6)], "idx long, v long, s string")
    rows = spark.createDataFrame([(5, None), (9, 70)], "idx long, v long")
    out = sorted(csv_ingest.insert_rows(frame, rows, 2).collect())
    assert [r["v"] for r in out] == [0, 1, None, 70, 4, 5] and {r["s"] for r in out} == {"a"}
    with pytest.raises(ValueError, match="fit"):
        csv_ingest.insert_rows(frame, rows, 5)
    assert csv_ingest.insert_rows(frame, rows.where("false"), 0).count() == 6
    assert csv_ingest.save(frame, str(tmp_path / "f"), attempts=1)
    (tmp_path / "g").write_text("x")
    with pytest.warns(UserWarning, match="not written"):
        assert not csv_ingest.save(frame, str(tmp_path / "g" / "h"), attempts=2, interval=0.01)
    with pytest.raises(Exception):  # noqa: B017
        csv_ingest.save(frame, str(tmp_path / "g" / "h"), raise_errors=True)


def test_frames(spark, tmp_path):
    a = np.arange(5)
    (idx, back) = frames.to_numpy(frames.from_numpy(spark, a=a).orderBy("idx"))
    assert (back == a).all() and (idx == a).all()
    with pytest.raises(ValueError):
        frames.from_numpy(spark, a=a, b=a[:2])
    frames.write_edges(spark.createDataFrame([(1, 2)], "src long, dst long"), str(tmp_path / "e"))
    assert spark.read.parquet(str(tmp_path / "e")).count() == 1
