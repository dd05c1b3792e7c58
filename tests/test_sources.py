"""Readers of papers, stores that skip what is unchanged, bundles, embedders and pages."""

from __future__ import annotations

import io
import struct
import unicodedata
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscope.functions import embedders
from folioscope.functions import text as X
from folioscope.operators import filters, windows
from folioscope.sources import exports, files, papers, tables


def zipped(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for k, v in parts.items():
            z.writestr(k, v)
    return out.getvalue()


def pdf(pages, packed=True):
    body = b"%PDF-1.4\n"
    for p in pages:
        data = b"BT /F1 12 Tf (" + p.replace("(", "\\(").replace(")", "\\)").encode("cp1252") + b") Tj T* [(se) -20 (cond)] TJ ET"
        data = zlib.compress(data) if packed else data
        body += b"1 0 obj << /Type /Page >> endobj\n2 0 obj << /Length 1 " + (b"/Filter /FlateDecode " if packed else b"") + b">>\nstream\n" + data + b"\nendstream endobj\n"
    return body


def test_papers(spark, tmp_path):
    made = {
        "a.pdf": pdf(["Le miroir (fragile) répond toujours au fleuve"] * 30), "b.pdf": pdf([""] * 3, False), "c.docx": zipped({"word/document.xml": "<w:p><w:t>Le &amp; mur</w:t></w:p><w:p>tient</w:p>"}),
        "d.epub": zipped({"x/b.xhtml": "<p>deux</p>", "x/a.xhtml": "<style>p{}</style><p>un</p>", "x/p.opf": '<item id="i1" href="b.xhtml"/><item id="i2" href="a.xhtml"/><itemref idref="i2"/><itemref idref="i1"/>'}),
        "e.doc": b"\xd0\xcf\x11\xe0" + "Le fleuve vivant".encode("utf-16-le"), "f.png": b"\x89PNG\r\n\x1a\n" + b"\0" * 8 + struct.pack(">II", 30, 20), "g.docx": b"no zip", "h.bin": b"\0\1", "i.gif": b"GIF89a" + struct.pack("<HH", 7, 5),
    }
    for k, v in made.items():
        (tmp_path / k).write_bytes(v)
    got = {r.path.rsplit("/", 1)[1]: r for r in papers.read_papers(spark, str(tmp_path)).collect()}
    assert got["a.pdf"].pages == 30 and got["a.pdf"].text.startswith("Le miroir (fragile) répond toujours au fleuve\nsecond") and got["b.pdf"].status == "NEEDS_OCR"
    assert got["c.docx"].text == "Le & mur\ntient" and got["d.epub"].text == "un\ndeux" and got["e.doc"].text == "Le fleuve vivant"
    assert [got[k].detail for k in ("f.png", "i.gif")] == ["30x20", "7x5"] and got["g.docx"].status == "BROKEN" and got["h.bin"].status == "UNSUPPORTED"
    assert len(papers.sampled([str(i) for i in range(100)])) == 12 and papers.sampled(["a"]) == ["a"]
    assert files.inventory(spark, str(tmp_path), 3).count() == 3


def test_unchanged_rows_are_not_written_again(spark, tmp_path):
    df = spark.createDataFrame([(2, "b"), (1, "a"), (3, None)], "k long, v string")
    for write, read in ((files.write_store, spark.read.parquet), (files.write_jsonl, spark.read.json)):
        path = str(tmp_path / write.__name__)
        assert write(df, path, "k") and not write(df.orderBy(F.desc("k")), path, "k") and write(df, path, "k", force=True)
        assert write(df.where("k > 1"), path, "k") and sorted(r.k for r in read(path).collect()) == [2, 3]
    assert files.read_jsonl(spark, str(tmp_path / "write_jsonl"), "k long, v string", limit=1).count() == 1


def test_kept_tables_follow_their_files(spark, tmp_path):
    spark.range(3).write.parquet(f"{tmp_path}/t.parquet")
    first = tables.kept_table(spark, str(tmp_path), "t")
    assert first.count() == 3 and tables.kept_table(spark, str(tmp_path), "t") is first
    spark.range(5).write.mode("overwrite").parquet(f"{tmp_path}/t.parquet")
    assert tables.kept_table(spark, str(tmp_path), "t").count() == 5
    assert tables.look_up(tables.table(spark, str(tmp_path), "t"), "id", 4) == {"id": 4} and tables.look_up(first, "id", 99) is None


def test_bundles():
    parts = {"a.json": b"{}", "b.md": "é".encode()}
    assert exports.bundle(parts) == exports.bundle(dict(reversed(parts.items())))
    for made in (exports.bundle(parts), exports.packed(parts)):
        assert exports.verified(made) == parts
    with pytest.raises(ValueError):
        exports.verified(zipped({"a": b"1", "manifest.json": b'{"a": "0"}'}))
    with pytest.raises(ValueError):
        exports.verified(zipped({"a": b"1", "manifest.json": b"{}"}))


def test_items_are_taken_or_rejected(spark):
    rows = ['{"id": "1", "title": "t", "URL": "ftp://x", "issued": {"date-parts": [[1990]]}}', '{"id": "2", "title": "t", "issued": {"date-parts": [[1990]]}}', '{"id": "3"}', "no json", '{"id": "4", "title": "t"}']
    got = exports.csl_items(spark.createDataFrame([(r,) for r in rows], "item string"), "item", 4).collect()
    assert [(r.id, r.reason) for r in got] == [(None, "not_json"), ("1", "bad_url"), ("2", None), ("3", "missing_title")]


def test_embedders(spark):
    embedders.register("letters", lambda folder: lambda texts: np.array([[len(t), t.count("a")] for t in texts], float))
    df = spark.createDataFrame([(1, "abab"), (2, None), (3, "")], "k long, t string")
    assert {r.k: r.v for r in embedders.embedded(df, "k", "t", "letters", size=1).collect()} == {1: [4.0, 2.0], 2: None, 3: [0.0, 0.0]}
    pytest.importorskip("onnxruntime")
    with pytest.raises(FileNotFoundError):
        embedders.onnx("/nowhere")
    v = embedders.mean_pooled(np.array([[[3.0, 0], [0, 4], [9, 9]]]), np.array([[1, 1, 0]]))
    assert np.allclose(v, [[0.6, 0.8]])


def test_numerals_and_forms(spark):
    df = spark.createDataFrame([("XLIV", "四十二", "L’Ｅ́té ﬁnit"), ("IIX", "十", "d'eux-mêmes"), (None, None, None), ("", "", "")], "r string, h string, t string")
    got = df.select(X.roman_number(F.col("r")), X.han_number(F.col("h")), X.norm_fr(F.col("t")), X.nfkc(F.col("t")), F.array_join(X.elision_variants(F.col("t")), "|")).collect()
    assert [tuple(r) for r in got] == [(44, 42, "lete finit", unicodedata.normalize("NFC", "L’Été finit"), "l|ete|lete|finit"), (None, 10, "deux memes", "d'eux-mêmes", "d|eux memes|deux memes"), (None, None, None, None, None), (None, None, "", "", "")]


def test_diversified_with_reasons(spark):
    rows = [("q", 1, "a", "f1", "s1", "g"), ("q", 2, "b", "f1", "s2", "g"), ("q", 3, "c", "f2", "s1", "h"), ("q", 4, "d", "f2", "s3", "h"), ("q", 5, "e", "f3", "s4", "h"), ("q", 6, "f", "f4", "s5", "k"), ("q", 7, "g", "f5", "s6", "k")]
    df = spark.createDataFrame(rows, "q string, rank int, i string, f string, s string, g string")
    got = windows.diversify(df, "q", "rank", "i", "f", "s", "g", 3, session_limit=1, streak=1).orderBy("rank").collect()
    # What the session limit dropped registered no fingerprint: d, with c's text, is kept.
    assert [(r.i, r.reason) for r in got] == [("a", None), ("b", "near_duplicate"), ("c", "session_concentration"), ("d", None), ("e", "streak"), ("f", None)]


def test_cursors_fail_closed():
    token = filters.cursor({"a": 1}, ("x",))
    assert filters.resume(token, {"a": 1}) == ("x",)
    for bad in ({"a": 2},), ({},):
        with pytest.raises(ValueError):
            filters.resume(token, *bad)
    with pytest.raises(ValueError):
        filters.resume("zz", {"a": 1})
    assert filters.budgeted(30, 50, 12) == 12 and filters.budgeted(30, 20, 99) == 20 and filters.budgeted(5, 50, 0) == 0
