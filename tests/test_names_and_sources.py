"""Near names, BSON, and line numbers of files read in ranges, against plain versions."""

import difflib
import json
import random
import struct

import pytest
from pyspark.sql import functions as F

from sparktrail.functions import documents as doc
from sparktrail.operators import names
from sparktrail.sources import bson, files


@pytest.mark.parametrize("cutoff", [0.6, 0.7, 0.8])
def test_near_names_against_difflib(spark, cutoff):
    rng = random.Random(int(cutoff * 10))
    word = lambda: "".join(rng.choice("abcdeé_A") for _ in range(rng.choice([1, 2, 3, 5, 8, 12])))
    known = sorted({word() for _ in range(150)})
    keys = sorted({word() for _ in range(60)} | {k[:-1] + rng.choice("abz") for k in known[::4]} | {k[::-1] for k in known[::7]})
    frame = lambda rows, c: spark.createDataFrame([(r,) for r in rows], f"{c} string")
    got = {}
    for r in names.near_names(frame([*keys, None, ""], "key"), frame([*known, *known[:3], None], "name"), cutoff, 3).collect():
        got.setdefault(r["key"], {})[r["nth"]] = r["name"]
    want = {k: difflib.get_close_matches(k, known, 3, cutoff) for k in keys}
    assert {k: [v[i] for i in sorted(v)] for k, v in got.items()} == {k: v for k, v in want.items() if v}
    assert sum(map(len, want.values())) > 40


def test_key_classes(spark):
    known = spark.createDataFrame([("a", "amount"), ("b", "country"), ("b", "Year"), ("a", None)], "source string, name string")
    keys = spark.createDataFrame([("a", k) for k in ("amount", "country", "year", "amonut", "zzz", None, "amount")], "source string, key string")
    assert {r["key"]: r["class"] for r in names.key_classes(keys, known).collect()} == {"amount": "exists-in-main", "country": "exists-elsewhere", "year": "case-mismatch", "amonut": "near-miss", "zzz": "absent"}


def test_line_numbers_of_a_file_read_in_ranges(spark, tmp_path):
    rng = random.Random(3)
    lines = ["" if rng.random() < 0.2 else " " if rng.random() < 0.05 else f"é{i} " + "x" * rng.randrange(90) for i in range(4000)]
    body = "".join(x + rng.choice(["\n", "\r\n"]) for x in lines[:-1]) + lines[-1].strip() + "end"
    (tmp_path / "long.txt").write_bytes(body.encode())
    (tmp_path / "short.txt").write_bytes(b"\n\none\n")
    (tmp_path / "empty.txt").write_bytes(b"")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(len(body.encode()) // 3 + 1))
        got = {(r["file"].rsplit("/", 1)[-1], r["line"]): r["text"] for r in files.numbered_lines(spark, str(tmp_path)).collect()}
        parts = spark.read.text(str(tmp_path)).select("_metadata.file_name", "_metadata.file_block_start").distinct().count()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert parts >= 4
    want = {("long.txt", i): x for i, x in enumerate(body.replace("\r\n", "\n").split("\n"), 1) if x.strip()}
    assert got == want | {("short.txt", 3): "one"}


def as_bson(value) -> tuple[int, bytes]:
    """The type byte and bytes of a Python value; tuples are (type, bytes) already."""
    match value:
        case tuple():
            return value
        case bool():
            return 8, bytes([value])
        case None:
            return 10, b""
        case float():
            return 1, struct.pack("<d", value)
        case int():
            return (16, struct.pack("<i", value)) if -(2**31) <= value < 2**31 else (18, struct.pack("<q", value))
        case str():
            return 2, struct.pack("<i", len(value.encode()) + 1) + value.encode() + b"\0"
        case dict() | list():
            items = value.items() if isinstance(value, dict) else enumerate(value)
            body = b"".join(bytes([kind]) + str(k).encode() + b"\0" + data for k, v in items for kind, data in [as_bson(v)])
            return (3 if isinstance(value, dict) else 4), struct.pack("<i", len(body) + 5) + body + b"\0"


def test_bson_of_all_types_and_of_cut_files(spark, tmp_path):
    plain = {"a": 1, "b": 2.5, "c": "é\U0001f600", "d": {"x": [1, None, {"y": True}], "z": {}}, "e": -(2**40), "f": False, "g": []}
    odd = {
        "id": (7, bytes(range(12))), "when": (9, struct.pack("<q", 1_500_000_000_123)), "old": (9, struct.pack("<q", -1)), "far": (9, struct.pack("<q", 2**62)), "bin": (5, struct.pack("<i", 3) + b"\0abc"),
        "rx": (11, b"^a\0i\0"), "ts": (17, struct.pack("<II", 5, 9)), "nan": float("nan"), "inf": float("-inf"), "js": (13, struct.pack("<i", 2) + b"x\0"), "max": (127, b""), "min": (255, b""), "dec": (19, bytes(16)), "und": (6, b""),
    }
    good = as_bson(plain)[1] + as_bson(odd)[1] + as_bson({})[1]
    (tmp_path / "good.bson").write_bytes(good)
    (tmp_path / "cut.bson").write_bytes(as_bson(plain)[1] + as_bson(plain)[1][:-7])
    (tmp_path / "empty.bson").write_bytes(b"")
    (tmp_path / "other.txt").write_bytes(b"no")
    (tmp_path / "bad.bson").write_bytes(as_bson({"a": (0x66, b"")})[1])
    rows = bson.bson_documents(spark, str(tmp_path)).collect()
    by = {}
    for r in sorted(rows, key=lambda r: r["at"]):
        by.setdefault(r["file"].rsplit("/", 1)[-1], []).append((r["document"] and json.loads(r["document"]), r["error"]))
    assert set(by) == {"good.bson", "cut.bson", "bad.bson"}
    read = by["good.bson"]
    assert read[0] == (plain, None) and read[2] == ({}, None)
    assert read[1][0] == {
        "id": {"$oid": bytes(range(12)).hex()}, "when": {"$date": "2017-07-14T02:40:00.123Z"}, "old": {"$date": "1969-12-31T23:59:59.999Z"}, "far": {"$date": {"$numberLong": str(2**62)}}, "bin": {"$binary": {"base64": "YWJj", "subType": "00"}},
        "rx": {"$regex": "^a", "$options": "i"}, "ts": {"$timestamp": {"t": 9, "i": 5}}, "nan": {"$numberDouble": "NaN"}, "inf": {"$numberDouble": "-Infinity"}, "js": "x", "max": {"$maxKey": 1}, "min": {"$minKey": 1}, "dec": {"$numberDecimal": "00" * 16}, "und": None,
    }
    assert by["cut.bson"][0] == (plain, None) and by["cut.bson"][1][0] is None and "document of" in by["cut.bson"][1][1]
    assert by["bad.bson"][0][0] is None and "0x66" in by["bad.bson"][0][1]


def test_a_table_written_as_bson_is_filtered(spark, tmp_path):
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet").limit(500).collect()
    for part in range(3):
        body = b"".join(as_bson({"key": r["o_orderkey"], "at": {"status": r["o_orderstatus"], "price": r["o_totalprice"]}})[1] for r in orders[part::3])
        (tmp_path / f"{part}.bson").write_bytes(body)
    docs = bson.bson_documents(spark, str(tmp_path))
    test = doc.matches({"at.status": {"$in": ["F", "P"]}, "at.price": {"$gt": 100000}})
    got = docs.where(test(F.col("document"))).select(F.get_json_object("document", "$.key").cast("long").alias("k")).collect()
    assert sorted(r["k"] for r in got) == sorted(r["o_orderkey"] for r in orders if r["o_orderstatus"] in "FP" and r["o_totalprice"] > 100000)
