"""S2 (language discovery from a folder) and S5 (the run catalogue)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The four settings and the path layout of their prediction files,
# formatted with (root, family in lower case, language, shots, source language).
SETTINGS = [
    ("fs", False, "{root}/fs {family}/few_shot_{lang}_{k}/generated_predictions.txt"),
    ("fs_prompt", True, "{root}/fs {family}/few_shot_{lang}_{k}_prompt/generated_predictions.txt"),
    ("mtl", False, "{root}/mtl {family}/multitask_{src}_{lang}_{k}/generated_predictions.txt"),
    ("mtl_prompt", True, "{root}/mtl {family}/multitask_{src}_{lang}_{k}_prompt/generated_predictions.txt"),
]


def _path_expr(template: str, root: str, k: int, src: str) -> F.Column:
    fmt = (template.replace("{root}", root.replace("%", "%%")).replace("{k}", str(k)).replace("{src}", src)
           .replace("{family}", "%1$s").replace("{lang}", "%2$s"))
    return F.format_string(fmt, F.lower(F.col("family")), F.col("lang"))


def run_catalog(langs: DataFrame, languages: DataFrame, root: str, k: int = 10, src: str = "en") -> DataFrame:
    """Every (language, setting) with its prediction path.

    ``langs`` holds the languages present in the data; ``languages`` is the
    family dimension (one row per language). The four settings are a
    fixed array exploded per language, so there is no cross join.
    """
    fam = langs.select("lang").distinct().join(languages.select("lang", "family"), "lang")
    settings = F.array(*[F.struct(F.lit(name).alias("setting"), F.lit(prompt).alias("is_prompt"),
                                  _path_expr(tpl, root, k, src).alias("path"))
                         for name, prompt, tpl in SETTINGS])
    return fam.select("family", "lang", F.explode(settings).alias("s")).select(
        "family", "lang", "s.setting", "s.is_prompt", "s.path")


def list_language_files(spark: SparkSession, root: str) -> list[str]:
    """Names of the entries directly below ``root`` (Hadoop listing, metadata only)."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(conf)
    return [st.getPath().getName() for st in fs.listStatus(path)]


def discover_languages(spark: SparkSession, root: str, source: str | None = "en",
                       blocklist: Sequence[str] = ("pl",)) -> DataFrame:
    """S2 + P4: language codes of the files in ``root`` (the part of the name
    before the first '_'), distinct and sorted, without the block list and the
    source language. Hidden and bookkeeping entries (``_``/``.`` prefix) are skipped.
    """
    names = [n for n in list_language_files(spark, root) if not n.startswith(("_", "."))]
    codes = sorted({n.split("_")[0] for n in names} - set(blocklist) - ({source} if source else set()))
    return spark.createDataFrame([(c,) for c in codes], "lang string")
