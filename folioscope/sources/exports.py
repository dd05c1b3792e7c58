"""Bibliographic items in and out: CSL-JSON, BibTeX, Markdown, HTML and bundles with a manifest."""

from __future__ import annotations

import hashlib
import io
import json
import tarfile
import zipfile

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Shape of the items that are read; what else they hold is left out.
CSL = "id string, title string, URL string, DOI string, issued struct<`date-parts`: array<array<int>>>"


def csl_items(df: DataFrame, column: str, most: int) -> DataFrame:
    """id, title, year, reason of JSON items in the order of their ids, `most` at most; reason tells why one is rejected, null that it is taken."""
    item = df.select(F.from_json(column, CSL).alias("i")).select("i.*").withColumn("year", F.get(F.get(F.col("issued.date-parts"), 0), 0))
    reason = F.when(F.col("id").isNull(), "not_json").when(F.col("title").isNull(), "missing_title").when(F.col("URL").isNotNull() & ~F.col("URL").rlike("^https?://"), "bad_url").when(F.col("year").isNull(), "missing_year")
    return item.select("id", "title", "year", reason.alias("reason")).orderBy("id").limit(most)


def csl_json(id_: str, title: str, year: str) -> Column:
    """One CSL-JSON item a row."""
    return F.to_json(F.struct(F.col(id_).alias("id"), F.lit("book").alias("type"), F.col(title).alias("title"), F.when(F.col(year).isNotNull(), F.struct(F.array(F.array(year)).alias("date-parts"))).alias("issued")))


def bibtex(id_: str, title: str, year: str) -> Column:
    """One BibTeX entry a row."""
    when = F.when(F.col(year).isNull(), "").otherwise(F.concat(F.lit(", year = {"), F.col(year).cast("string"), F.lit("}")))
    return F.concat(F.lit("@book{"), F.replace(F.col(id_), F.lit("."), F.lit("_")), F.lit(", title = {"), F.col(title), F.lit("}"), when, F.lit("}"))


def markdown(title: str, year: str) -> Column:
    """A heading a row."""
    return F.concat(F.lit("## "), F.col(title), F.when(F.col(year).isNull(), "").otherwise(F.concat(F.lit(" ("), F.col(year).cast("string"), F.lit(")"))))


def html(title: str) -> Column:
    """An escaped heading a row."""
    c = F.col(title)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return F.concat(F.lit("<h2>"), c, F.lit("</h2>"))


def bundle(parts: dict[str, bytes]) -> bytes:
    """A ZIP of named parts and of manifest.json with the SHA-256 of each; the same parts give the same bytes."""
    manifest = json.dumps({k: hashlib.sha256(v).hexdigest() for k, v in parts.items()}, sort_keys=True).encode()
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in [*sorted(parts.items()), ("manifest.json", manifest)]:
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), data)
    return out.getvalue()


def verified(data: bytes) -> dict[str, bytes]:
    """The parts of a bundle (ZIP or TAR with manifest.json); an error if one differs from its hash, is missing or too many."""
    if data[:2] == b"PK":
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            parts = {n: z.read(n) for n in z.namelist()}
    else:
        with tarfile.open(fileobj=io.BytesIO(data)) as t:
            parts = {m.name: t.extractfile(m).read() for m in t.getmembers() if m.isfile()}
    manifest = json.loads(parts.pop("manifest.json"))
    if set(manifest) != set(parts):
        raise ValueError(f"not as listed: {sorted(set(manifest) ^ set(parts))}")
    for name, digest in manifest.items():
        if hashlib.sha256(parts[name]).hexdigest() != digest:
            raise ValueError(f"{name} was changed")
    return parts


def packed(parts: dict[str, bytes]) -> bytes:
    """A TAR of named parts and of manifest.json."""
    out = io.BytesIO()
    manifest = json.dumps({k: hashlib.sha256(v).hexdigest() for k, v in parts.items()}, sort_keys=True).encode()
    with tarfile.open(fileobj=out, mode="w") as t:
        for name, data in [*sorted(parts.items()), ("manifest.json", manifest)]:
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    return out.getvalue()
