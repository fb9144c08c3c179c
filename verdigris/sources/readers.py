"""Readers: JSON lines, registry and open-data files of several forms, archives, files with their digests."""

from __future__ import annotations

import csv
import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verdigris.functions.text import slug

CORRUPT = "_corrupt_record"


def read_jsonl(spark: SparkSession, path: str, schema: str | T.StructType, count_bad: bool = False) -> DataFrame:
    """One JSON object a line. Lines that can't be parsed are dropped, or kept in ``_corrupt_record`` to be counted."""
    kind = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    if not count_bad:
        return spark.read.schema(kind).json(path, mode="DROPMALFORMED")
    return spark.read.schema(T.StructType([*kind.fields, T.StructField(CORRUPT, T.StringType())])).json(path, mode="PERMISSIVE", columnNameOfCorruptRecord=CORRUPT)


#: How the names of a registry's files begin, and the tables that they belong to.
REGISTRY_FILES = {
    "empresa": "empresas", "estabelecimento": "estabelecimentos", "socio": "socios", "simples": "simples", "cnae": "cnaes", "motivo": "motivos",
    "municipio": "municipios", "natureza": "naturezas", "qualificacao": "qualificacoes", "pais": "paises",
}


def registry_table(name: str, files: dict[str, str] = REGISTRY_FILES) -> str | None:
    """The table that a registry's file belongs to, by the letters with which its name begins."""
    letters = "".join(c for c in name.replace("\\", "/").rsplit("/", 1)[-1].lower().replace(".zip", "") if "a" <= c <= "z")
    return next((table for prefix, table in files.items() if letters.startswith(prefix)), None)


def first_present(folder: str, names: tuple[str, ...]) -> str | None:
    """The first of some files that a local folder holds."""
    import os

    return next((p for p in (os.path.join(folder, n) for n in names) if os.path.isfile(p)), None)


def bases_in(root: str) -> list[str]:
    """The bases below a local folder: its folders, in order."""
    import os

    return sorted(e.name for e in os.scandir(root) if e.is_dir() and not e.name.startswith(".")) if os.path.isdir(root) else []


def read_registry(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A registry's files: Latin-1, semicolons, no header, every column a string; short rows are padded, long ones cut."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return spark.read.csv(path, schema=schema, sep=";", quote='"', escape='"', encoding="ISO-8859-1", header=False, mode="PERMISSIVE")


def sniff(head: bytes) -> dict[str, str]:
    """Encoding and separator of a table from its first bytes; a semicolon where nothing tells."""
    for encoding in ("utf-8-sig", "utf-8", "latin-1"):
        try:
            # The head may end inside a character.
            text = head.decode(encoding) if encoding == "latin-1" else head[: max(0, head.rfind(b"\n")) or None].decode(encoding)
            break
        except UnicodeDecodeError:
            continue
    try:
        sep = csv.Sniffer().sniff(text, ",;\t|").delimiter
    except csv.Error:
        sep = ";"
    return {"encoding": "ISO-8859-1" if encoding == "latin-1" else "UTF-8", "sep": sep}


def clean_columns(df: DataFrame) -> DataFrame:
    """Column names as identifiers; repeated ones get a number."""
    import re
    import unicodedata

    names: list[str] = []
    for raw in df.columns:
        # Spark puts a column's place behind a name that is repeated.
        place = str(df.columns.index(raw))
        again = sum(c.removesuffix(str(i)) == raw.removesuffix(place) for i, c in enumerate(df.columns)) > 1
        raw = raw.removesuffix(place) if again else raw
        bare = "".join(c for c in unicodedata.normalize("NFKD", raw) if not unicodedata.combining(c)).lower()
        name = re.sub("[^a-z0-9]+", "_", bare).strip("_") or "column"
        made, n = name, 2
        while made in names:
            made, n = f"{name}_{n}", n + 1
        names.append(made)
    return df.toDF(*names)


def read_table(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """A tabular file by its suffix: csv, tsv, txt, json, geojson or parquet."""
    kind = (kind or path.rsplit(".", 1)[-1]).lower()
    if kind == "parquet":
        return spark.read.parquet(path)
    if kind in ("csv", "tsv", "txt"):
        head = spark.read.format("binaryFile").load(path).select(F.substring("content", 1, 65_536)).first()
        return clean_columns(spark.read.csv(path, header=True, inferSchema=False, **sniff(bytes(head[0]) if head else b"")))
    if kind == "geojson":
        return read_geojson(spark, path)
    if kind == "json":
        return read_json_records(spark, path)
    raise ValueError(f"no reader for {kind}")


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """A feature collection's properties, with ``geometry_json``."""
    features = spark.read.json(path, multiLine=True).select(F.explode("features").alias("f"))
    return clean_columns(features.select("f.properties.*", F.to_json("f.geometry").alias("geometry_json")))


def read_json_records(spark: SparkSession, path: str, lists: tuple[str, ...] = ("data", "results", "registros", "items")) -> DataFrame:
    """Records of a JSON file: an array, the first list under one of some names, or the object itself."""
    df = spark.read.json(path, multiLine=True)
    for name in lists:
        if name in df.columns and isinstance(df.schema[name].dataType, T.ArrayType):
            inner = df.select(F.explode(name).alias("r"))
            return clean_columns(inner.select("r.*") if isinstance(inner.schema["r"].dataType, T.StructType) else inner)
    return clean_columns(df)


def zip_lines(spark: SparkSession, path: str, encoding: str = "latin-1", suffixes: tuple[str, ...] = (".csv", ".txt", ".tsv")) -> DataFrame:
    """``archive, member, line``: lines of the tables in ZIP files, with archives inside archives. A task streams one archive."""

    def lines(data: bytes) -> Iterator[tuple[str, str]]:
        with zipfile.ZipFile(io.BytesIO(data)) as archive:
            for name in sorted(archive.namelist()):
                if name.lower().endswith(".zip"):
                    yield from lines(archive.read(name))
                elif name.lower().endswith(suffixes) or "." not in name.rsplit("/", 1)[-1]:
                    with archive.open(name) as member:
                        for line in io.TextIOWrapper(member, encoding, newline=None):
                            yield name, line.rstrip("\r\n")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for where, content in zip(frame["path"], frame["content"], strict=True):
                held: list[tuple[str, str, str]] = []
                for name, line in lines(content):
                    held.append((where, name, line))
                    if len(held) == 10_000:
                        yield pd.DataFrame(held, columns=["archive", "member", "line"])
                        held = []
                yield pd.DataFrame(held, columns=["archive", "member", "line"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, "archive string, member string, line string")


def registry_from_zip(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A registry table out of ZIP files."""
    schema = ", ".join(f"`{c}` string" for c in columns)
    parsed = F.from_csv("line", schema, {"sep": ";", "quote": '"', "escape": '"'})
    return zip_lines(spark, path).select(parsed.alias("r")).select("r.*")


def files_with_digests(spark: SparkSession, path: str) -> DataFrame:
    """``name, hash, size`` of the files under a path: one side of a registry's difference."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("hash"), F.col("length").alias("size"))


def last_update(rows: DataFrame, names: list[str], key: str, order: str) -> DataFrame:
    """A sheet's last row for each document; ``names`` are the headers that may hold its name, the first filled one counts."""
    from pyspark.sql import Window

    from verdigris.functions.text import alnum_key

    filled = F.coalesce(*[F.when(F.trim(F.col(n)) != "", F.col(n)) for n in names if n in rows.columns])
    keyed = rows.withColumn(key, alnum_key(filled)).where(F.col(key).isNotNull() & (F.col(key) != ""))
    last = Window.partitionBy(key).orderBy(F.desc(order))
    return keyed.withColumn("_n", F.row_number().over(last)).withColumn("repeated", F.count(F.lit(1)).over(Window.partitionBy(key)) > 1).where("_n = 1").drop("_n")


def declared_format(declared: Column, mimetype: Column, url: Column) -> Column:
    """A resource's format from what is declared, its MIME type, or its address."""
    text = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    suffix = F.regexp_extract(F.lower(F.regexp_replace(url, r"[?#].*$", "")), r"\.([a-z0-9]{2,7})$", 1)
    out = F.when(suffix != "", suffix)
    for kind, words in (("geojson", "geo"), ("parquet", "parquet"), ("zip", "zip"), ("xlsx", "excel|spreadsheet"), ("json", "json"), ("csv", "csv")):
        out = F.when(F.rlike(text(mimetype), F.lit(words)), kind).otherwise(out)
    return F.when(text(declared) != "", slug(declared)).otherwise(out)
