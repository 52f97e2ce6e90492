"""Library configuration files: [global_setting] and [LIB] sections of `key = value` lines; # and ; start comments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed keys of the format.
GLOBAL_KEYS = ("max_rd_len", "min_rd_len")
LIBRARY_KEYS = ("name", "avg_insert_len", "insert_SD", "diverse_rd_len", "asm_flag", "seq_profile", "qual_benchmark", "f1", "f2")
SCHEMA = T.StructType(
    [T.StructField("max_rd_len", T.IntegerType()), T.StructField("min_rd_len", T.IntegerType()), T.StructField("name", T.StringType())]
    + [T.StructField(k, T.IntegerType()) for k in LIBRARY_KEYS[1:7]]
    + [T.StructField("files", T.ArrayType(T.StringType()))]
)


def parse_config(text: str, corrected: bool = False) -> list[dict]:
    """One dict a library. With corrected, only f1 counts, and names the corrected reads made from it."""
    whole, libraries = dict.fromkeys(GLOBAL_KEYS), []
    for line in text.splitlines():
        line = line.split("#")[0].split(";")[0].strip()
        if not line or line == "[global_setting]":
            continue
        if line == "[LIB]":
            libraries.append(dict.fromkeys(LIBRARY_KEYS[:7]) | {"files": []})
            continue
        key, _, value = (x.strip() for x in line.partition("="))
        if key in GLOBAL_KEYS:
            whole[key] = int(value)
        elif key not in LIBRARY_KEYS or not libraries:
            raise ValueError(f"unknown setting: {line}")
        elif key in ("f1", "f2"):
            if corrected and key == "f1":
                libraries[-1]["files"].append(f"{value.rpartition('1.')[0]}.Correct.fa{_packing(value)}")
            elif not corrected:
                libraries[-1]["files"].append(value)
        else:
            libraries[-1][key] = value if key == "name" else int(value)
    return [whole | x for x in libraries]


def _packing(path: str) -> str:
    return "." + path.rpartition(".")[2] if path.rpartition(".")[2] in ("br", "gz", "zst") else ""


def read_config(spark: SparkSession, path: str, corrected: bool = False) -> DataFrame:
    """The libraries of a small text file that Spark can read."""
    text = "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())
    return spark.createDataFrame([tuple(x[f.name] for f in SCHEMA) for x in parse_config(text, corrected)], SCHEMA)


def long_read_files(libraries: DataFrame) -> DataFrame:
    """(name, file) of the libraries of long reads, whose seq_profile is 2."""
    return libraries.where("seq_profile = 2").select("name", F.explode("files").alias("file"))


def format_of(path: Column) -> Column:
    """fa or fq of a path column by the rule of read_format, null for neither."""
    parts = F.slice(F.reverse(F.split(path, r"\.")), F.lit(1), F.least(F.lit(2), F.size(F.split(path, r"\.")) - 1))
    kind = F.transform(parts, lambda p: F.when(p.isin("fa", "fasta"), "fa").when(p.isin("fq", "fastq"), "fq"))
    return F.get(F.filter(kind, lambda k: k.isNotNull()), F.lit(0))


def read_format(path: str) -> str:
    """fa or fq, from the last suffix or the one before a packing suffix."""
    for part in path.split(".")[:0:-1][:2]:
        if part in ("fa", "fasta"):
            return "fa"
        if part in ("fq", "fastq"):
            return "fq"
    raise ValueError(f"neither FASTA nor FASTQ: {path}")
