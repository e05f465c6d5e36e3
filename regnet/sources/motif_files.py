"""Motif files. A file is small; it comes as one row of text per file and is parsed with plain rules."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions.motif_math import LETTERS

FORMATS = ("meme", "homer", "transfac")


def _blank(**values) -> dict:
    return {"motif_id": None, "motif_name": None, "alphabet": list(LETTERS), "pwm": [], "counts": None, "background": None, "url": None, "accession": None, "species": None, "ln_odds": None} | values


def _numbers(tokens: list[str]) -> list[float] | None:
    try:
        return [float(x) for x in tokens]
    except ValueError:
        return None


def parse_meme(text: str) -> Iterator[dict]:
    alphabet, background, motif, in_background = None, [], None, False
    for line in text.splitlines():
        words = line.split()
        if not words or words[0].startswith("letter-probability"):
            continue
        if words[0].upper().startswith("ALPHABET"):
            alphabet = list(line.split("=", 1)[-1].strip()) if "=" in line else list(words[-1])
        elif words[0] == "Background":
            in_background = True
        elif words[0] == "MOTIF":
            if motif and motif["pwm"]:
                yield motif
            in_background = False
            if alphabet is None:
                raise ValueError("a MEME file needs an ALPHABET line before its motifs")
            values = dict(zip(background[::2], _numbers(background[1::2]) or [], strict=False))
            bg = [values[a] for a in alphabet] if all(a in values for a in alphabet) else [1 / len(alphabet)] * len(alphabet)
            motif = _blank(motif_id=words[1], motif_name=words[2] if len(words) > 2 else words[1], alphabet=alphabet, background=bg)
        elif in_background:
            background += words
        elif motif is not None and words[0] == "URL":
            motif["url"] = words[1] if len(words) > 1 else None
        elif motif is not None and len(words) == len(alphabet) and (row := _numbers(words)):
            motif["pwm"].append(row)
    if motif and motif["pwm"]:
        yield motif


def parse_homer(text: str) -> Iterator[dict]:
    motif = None
    for line in text.splitlines():
        words = line.split()
        if line.startswith(">"):
            if motif and motif["pwm"]:
                yield motif
            motif = _blank(motif_id=words[1], motif_name=words[1], background=[0.25] * 4, ln_odds=float(words[2]) if len(words) > 2 else None)
        elif motif is not None and len(words) == 4 and (row := _numbers(words)):
            motif["pwm"].append(row)
    if motif and motif["pwm"]:
        yield motif


def parse_transfac(text: str) -> Iterator[dict]:
    motif, letters = _blank(counts=[]), list(LETTERS)
    for line in [*text.splitlines(), "//"]:
        code, rest = line[:2], line[2:].split()
        if code == "//":
            if motif["counts"]:
                motif["pwm"] = [[x / sum(row) for x in row] for row in motif["counts"]]
                motif["motif_name"] = motif["motif_name"] or motif["motif_id"]
                yield motif
            motif = _blank(counts=[], background=[0.25] * 4)
        elif code == "AC" and rest:
            motif["accession"] = rest[0]
        elif code == "ID" and rest:
            motif["motif_id"] = rest[0]
        elif code == "NA" and rest:
            motif["motif_name"] = " ".join(rest)
        elif code == "BF" and rest:
            motif["species"] = [*(motif["species"] or []), " ".join(rest)]
        elif code == "P0":
            letters = [x.upper() for x in rest[:4]]
            motif["alphabet"] = letters
        elif code.strip().isdigit() and (row := _numbers(rest[: len(letters)])):
            motif["counts"].append(row)


PARSERS = {"meme": parse_meme, "homer": parse_homer, "transfac": parse_transfac}


def read_motifs(spark: SparkSession, path: str | list[str], file_format: str | None = None) -> DataFrame:
    """Motifs of files of one format; without a format, .meme files are MEME and others HOMER."""
    kind = (file_format or ("meme" if str(path).lower().endswith(".meme") else "homer")).lower()
    if kind not in PARSERS:
        raise ValueError(f"motif formats are {', '.join(FORMATS)}")
    parse = PARSERS[kind]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([m for text in b.value for m in parse(text)], columns=[c.split()[0] for c in schemas.MOTIF.replace(", ", ",").split(",")])

    return spark.read.text(path, wholetext=True).mapInPandas(run, schemas.MOTIF)


def assert_unique_ids(motifs: DataFrame) -> DataFrame:
    twice = motifs.groupBy("motif_id").count().filter("count > 1").limit(5).collect()
    if twice:
        raise ValueError(f"motif ids occur twice: {', '.join(r['motif_id'] for r in twice)}")
    return motifs


def pwm_report(spark: SparkSession, path: str, info: DataFrame) -> DataFrame:
    """One row: files, those whose id info lacks (unknown), and those without a line of numbers (empty)."""
    lines = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+?)(\.[A-Za-z]+)?$", 1).alias("motif_id"), "value")
    known = info.select(F.col("Motif_ID").alias("motif_id")).distinct().withColumn("_known", F.lit(True))
    bare = ~F.rlike("value", F.lit(r"(?m)^\s*\d"))
    return lines.join(known, "motif_id", "left").agg(F.count(F.lit(1)).alias("files"), F.count_if(F.col("_known").isNull()).alias("unknown"), F.count_if(bare).alias("empty"))


def read_pwm_files(
    spark: SparkSession, path: str, info: DataFrame, *, direct_only: bool = False, indexed: bool = True, transpose: bool = False,
    name_column: str = "TF_Name", join_names: bool = True,
) -> DataFrame:
    """A directory of tables (Pos A C G T), the file's stem being the motif id, with the names of info (Motif_ID, TF_Name, TF_Status)."""
    lines = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+?)(\.[A-Za-z]+)?$", 1).alias("motif_id"), "value")
    rows = F.filter(F.split("value", "\n"), lambda x: F.trim(x) != "")
    body = F.slice(rows, F.lit(2 if indexed else 1), F.greatest(F.size(rows) - (1 if indexed else 0), F.lit(0)))
    numbers = F.transform(body, lambda line: F.transform(F.filter(F.split(F.trim(line), r"\s+"), lambda x: x != ""), lambda x: x.try_cast("double")))
    pwm = F.transform(numbers, lambda r: F.slice(r, F.lit(2 if indexed else 1), F.greatest(F.size(r) - (1 if indexed else 0), F.lit(0))))
    if transpose:
        pwm = F.transform(F.sequence(F.lit(0), F.size(F.get(pwm, F.lit(0))) - 1), lambda i: F.transform(pwm, lambda r: F.get(r, i)))
    motifs = lines.select("motif_id", pwm.alias("pwm"))
    whole = (F.size("pwm") > 0) & F.forall("pwm", lambda r: (F.size(r) == 4) & F.forall(r, lambda x: x.isNotNull()))
    names = info.filter(F.contains("TF_Status", F.lit("D"))) if direct_only else info
    names = names.select(F.col("Motif_ID").alias("motif_id"), F.col(name_column).alias("name")).distinct()
    if join_names:
        names = names.groupBy("motif_id").agg(F.array_join(F.array_sort(F.collect_set("name")), "/").alias("motif_name"))
        return motifs.filter(whole).join(names, "motif_id").select("motif_id", "motif_name", "pwm")
    several = names.groupBy("motif_id").agg(F.array_sort(F.collect_set("name")).alias("names")).select("motif_id", F.size("names").alias("n"), F.posexplode("names").alias("i", "motif_name"))
    out = motifs.filter(whole).join(several, "motif_id")
    return out.select(F.when(F.col("n") > 1, F.concat("motif_id", F.lit("_"), F.col("i").cast("string"))).otherwise(F.col("motif_id")).alias("motif_id"), "motif_name", "pwm")


def read_motif_info(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.option("sep", "\t").option("header", True).csv(path)
    missing = [c for c in schemas.TF_INFO_KEYS if c not in df.columns]
    if missing:
        raise ValueError(f"the motif table lacks {', '.join(missing)}")
    return df


def rename_motifs(motifs: DataFrame, info: DataFrame) -> DataFrame:
    """Motifs that info knows, under info's names."""
    named = info.select(F.col("Motif_ID").alias("motif_id"), F.col("Motif_Name").alias("_name")).na.drop()
    return motifs.join(named, "motif_id").withColumn("motif_name", F.col("_name")).drop("_name")
