"""Which files there are, and of what kind."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Kinds by the end of the name, longer ends first.
KINDS = {
    ".tsv.gz": "table", ".csv.gz": "table", ".txt.gz": "table", ".mtx.gz": "matrix", ".meta.json": "meta", ".textclipping": "residue", ".rhistory": "script",
    ".csv": "table", ".tsv": "table", ".xlsx": "table", ".xlsm": "table", ".xls": "table", ".ods": "table", ".pzfx": "prism", ".pzf": "prism", ".mtx": "matrix",
    ".docx": "manuscript", ".pdf": "pdf", ".txt": "text", ".md": "text", ".r": "script", ".rmd": "script", ".py": "script", ".ipynb": "script",
    ".yaml": "config", ".yml": "config", ".json": "config", ".png": "image", ".jpg": "image", ".jpeg": "image", ".tif": "image", ".tiff": "image",
    ".czi": "microscopy", ".lif": "microscopy", ".zip": "archive", ".ris": "bibliography", ".bib": "bibliography",
}
MEMBER_BYTES = 256 << 20


def kind(path: Column) -> Column:
    low = F.lower(path)
    out = F.when(F.lit(False), "")
    for end, name in KINDS.items():
        out = out.when(low.endswith(end), name)
    return out.otherwise("other")


def is_junk(path: Column) -> Column:
    """Lock files of office programs and hidden files, R history aside."""
    name = F.lower(F.element_at(F.split(path, "/"), -1))
    return (name.startswith("~$") | name.startswith(".")) & ~name.isin(".rhistory", ".rprofile")


def listed(spark: SparkSession, *paths: str) -> DataFrame:
    """(path, length, modificationTime, kind) of all files below the paths; content is not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(list(paths)).select("path", "length", "modificationTime")
    return files.filter(~is_junk(F.col("path"))).withColumn("kind", kind(F.col("path")))


def contents(spark: SparkSession, *paths: str, glob: str = "*") -> DataFrame:
    """(path, content) of files, and of the members of archives among them, two levels deep."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(list(paths))
    plain = files.filter(~is_junk(F.col("path"))).select("path", "content")
    zipped = plain.filter(F.lower("path").endswith(".zip"))
    return plain.filter(~F.lower("path").endswith(".zip")).union(unzipped(zipped))


def members(path: str, data: bytes, depth: int = 2) -> Iterator[tuple[str, bytes]]:
    """(path!member, bytes) of an archive; names that lead out of it, and members beyond MEMBER_BYTES, raise ValueError. A broken archive has none."""
    try:
        z = zipfile.ZipFile(io.BytesIO(data))
    except zipfile.BadZipFile:
        return
    for info in z.infolist():
        parts = info.filename.replace("\\", "/").split("/")
        if info.is_dir():
            continue
        if ".." in parts or parts[0] == "" or ":" in parts[0]:
            raise ValueError(f"{path}: {info.filename} leads out of the archive")
        if info.file_size > MEMBER_BYTES:
            raise ValueError(f"{path}: {info.filename} is too large")
        inner = f"{path}!{info.filename}"
        if info.filename.lower().endswith(".zip") and depth > 1:
            yield from members(inner, z.read(info), depth - 1)
        else:
            yield inner, z.read(info)


def unzipped(archives: DataFrame) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for path, data in zip(pdf["path"], pdf["content"], strict=True):
                for name, inner in members(path, data):
                    yield pd.DataFrame({"path": [name], "content": [inner]})

    return archives.select("path", "content").mapInPandas(run, "path string, content binary")


def set_fingerprint(files: DataFrame) -> DataFrame:
    """(n_files, sha): one hash over a set of files (path, sha), whatever their order; repeated rows count.

    Four sums and four exclusive ors of 64-bit hashes of the rows, which
    aggregate map-side, are hashed together: no list of files meets in a task.
    """
    h = [F.xxhash64(F.lit(i), "path", "sha") for i in range(4)]
    sums = [F.sum(x.cast("decimal(20,0)")).cast("string").alias(f"s{i}") for i, x in enumerate(h)] + [F.bit_xor(x).cast("string").alias(f"x{i}") for i, x in enumerate(h)]
    g = files.agg(F.count("*").alias("n_files"), *sums)
    return g.select("n_files", F.sha2(F.concat_ws("|", F.col("n_files").cast("string"), *(F.coalesce(f"{c}{i}", F.lit("0")) for c in "sx" for i in range(4))), 256).alias("sha"))
