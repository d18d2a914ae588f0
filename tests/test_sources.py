"""The statement source and the declaration sink on files of their own."""

import os

import pytest
from pyspark.sql import functions as F

from ledgerloom.sources import bank_files as B
from ledgerloom.sources import statements as ST


def plain(path):
    """Lines of a file with their offsets, read at once."""
    raw = open(path, "rb").read()
    first = raw.split(b"\n", 1)[0]
    mark, out, at = ";" if first.count(b";") >= first.count(b",") else ",", [], 0
    for line in raw.split(b"\n"):
        text = line.decode("utf-8", "replace").replace("\r", "")
        text = text.removeprefix("﻿") if at == 0 else text
        if text:
            out.append((at, mark, text))
        at += len(line) + 1
    return out


@pytest.mark.parametrize("size", [7, 64, 1000, 10**7])
def test_ranges_give_every_line_once(spark, tmp_path, size):
    files = {
        "a.csv": "﻿Date,Libellé,Montant\r\n" + "".join(f"0{i % 9 + 1}/06/2026,é{'x' * (i % 40)},{i}\r\n" for i in range(60)),
        "sub/b.txt": "Banque\n\n\nDate;Libellé;Débit\n01/06/2026;Achat;5",
        "empty.csv": "", "only.csv": "\n\n\n", "long.csv": "a;b\n" + "y" * 5000 + ";1\nz;2\n",
    }
    os.makedirs(tmp_path / "sub")
    for name, text in files.items():
        (tmp_path / name).write_bytes(text.encode())
    (tmp_path / "c.csv").write_bytes(b"l;\xff\xfe;1\nm;2")
    (tmp_path / "ignored.json").write_text("{}")
    ST.register(spark)
    got = spark.read.format("statement").option("path", str(tmp_path)).option("maxPartitionBytes", size).load()
    assert got.rdd.getNumPartitions() > 1 or size > 1000
    found = sorted((os.path.relpath(r.file, tmp_path), r.offset, r.mark, r.line) for r in got.collect())
    want = sorted((name, *x) for name in [*files, "c.csv"] for x in plain(tmp_path / name))
    assert found == want


def test_head_and_rows(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x;y\n\n" + "".join(f"{i};1\n" for i in range(5000)))
    rows = B.rows(spark, str(tmp_path), 4).orderBy("offset").collect()
    assert [(r.row, r.cells[0]) for r in rows] == [(0, "x"), (2, "0"), (3, "1")]
    assert B.rows(spark, str(tmp_path / "a.csv")).count() == 5001


def test_a_file_larger_than_a_partition(spark, tmp_path):
    """A statement of 40 MB is read in ranges of 1 MB, and no task holds more than a piece of it."""
    with open(tmp_path / "big.csv", "w") as f:
        f.write("Relevé\nDate;Libellé;Débit;Crédit\n")
        for i in range(1_000_000):
            f.write(f"{i % 28 + 1:02}/06/2026;Achat numéro {i};{i % 900 + 1},50;\n")
    ST.register(spark)
    parts = ST.StatementReader({"path": str(tmp_path), "maxPartitionBytes": 1 << 20}).partitions()
    assert len(parts) > 30 and all(r[2] - r[1] <= 1 << 20 for p in parts for r in p.ranges)
    out = B.transactions(spark, str(tmp_path)).agg(F.count("*"), F.sum("amount"), F.countDistinct("label")).first()
    assert out[0] == 1_000_000 == out[2] and out[1] == -sum(i % 900 + 1.5 for i in range(1_000_000))


DECLARED = "dossier long, " + B.DECLARED


def declared(spark, n, shift=0):
    rows = [(i % 3, i + shift, f"F,{i}", 'a "b"\nc', 1.5 * i, 0.1, 2.0, "", None, "0" * 15, 0.2, 4, None, 46000 + i, 146) for i in range(n)]
    return spark.createDataFrame(rows, DECLARED)


def test_declaration_files_are_replaced_together(spark, tmp_path):
    path, name = str(tmp_path / "out"), F.concat(F.lit("C"), F.col("dossier").cast("string"))
    for shift in (0, 1000, 1000):
        B.write_declaration(declared(spark, 50, shift).repartition(5), name, path)
    files = sorted(os.listdir(tmp_path / "out" / "data"))
    assert len(files) == 3 and sorted(f"{path}/data/{f}" for f in files) == sorted(ST.declared_files(path)) and os.listdir(tmp_path / "out").count("manifest.json") == 1
    first = open(f"{path}/data/{files[0]}").readline().strip().replace('"', "")
    assert first.split(",") == [c.split()[0] for c in B.DECLARED.split(", ")] and len(first.split(",")) == 14
    rows = spark.read.schema(B.DECLARED).option("header", True).option("multiLine", True).option("escape", '"').csv(ST.declared_files(path))
    assert sorted(r.or_ for r in rows.collect()) == list(range(1000, 1050))
    # a write that fails leaves the earlier set
    bad = declared(spark, 50).withColumn("or_", F.when(F.col("or_") == 49, F.raise_error(F.lit("broken"))).otherwise(F.col("or_")))
    with pytest.raises(Exception, match="broken"):
        B.write_declaration(bad, name, path)
    assert sorted(os.listdir(tmp_path / "out" / "data")) == files or set(files) <= set(os.listdir(tmp_path / "out" / "data"))
    assert sorted(f"{path}/data/{f}" for f in files) == sorted(ST.declared_files(path))


def test_payload(spark):
    ledgers = spark.createDataFrame([(1, "[" + ",".join(["{}"] * 500) + "]")], "dossier long, lines string")
    r = B.payload_bytes(ledgers, spark.createDataFrame([(1, 500)], "dossier long, lines long")).first()
    assert r.payload_bytes == len('{"dossier":1,"lines":""}') + 1501 and r.summary_bytes == len('{"dossier":1,"lines":500}') and r.ratio > 50
