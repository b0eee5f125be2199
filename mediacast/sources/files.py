"""Publishing and replacing files and folders on whatever file system Spark sees."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: The file in a published folder that names the version to read.
POINTER = "CURRENT"


def _fs(spark: SparkSession, path: str):
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()), jvm_path


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _fs(spark, path)
    return fs.exists(where)


def publish(spark: SparkSession, staged: str, target: str) -> None:
    """Put the file ``staged`` in the place of the file ``target`` in one step."""
    fs, new = _fs(spark, staged)
    _, final = _fs(spark, target)
    if fs.exists(final) and fs.isDirectory(final):
        raise OSError(f"{target} is a folder")
    if final.getParent() is not None:
        fs.mkdirs(final.getParent())
    hadoop = spark._jvm.org.apache.hadoop.fs
    option = getattr(hadoop, "Options$Rename")
    overwrite = spark.sparkContext._gateway.new_array(option, 1)
    overwrite[0] = option.OVERWRITE
    context = hadoop.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    context.rename(fs.makeQualified(new), fs.makeQualified(final), overwrite)


def new_version(target: str) -> str:
    """Where to write the next version of the folder ``target``; nobody reads it before it is put in place."""
    return f"{target}/version-{uuid.uuid4().hex}"


def current_version(spark: SparkSession, target: str) -> str:
    """The version that was put in place last."""
    if not exists(spark, f"{target}/{POINTER}"):
        raise FileNotFoundError(f"nothing was published in {target}")
    return f"{target}/{spark.read.text(f'{target}/{POINTER}').first()[0]}"


def put_in_place(spark: SparkSession, target: str, version: str) -> None:
    """Make ``version`` what readers of ``target`` find.

    A small file names the version. It is replaced by an overwriting rename, so a reader finds the old version or the new one,
    and a stop at any moment leaves the old one or the new one. Versions before the last one are removed.
    """
    before = current_version(spark, target) if exists(spark, f"{target}/{POINTER}") else version
    staged = f"{target}/.{POINTER}-{uuid.uuid4().hex}"
    fs, path = _fs(spark, staged)
    out = fs.create(path)
    out.write(bytearray(version.rsplit("/", 1)[1].encode()))
    out.close()
    publish(spark, staged, f"{target}/{POINTER}")
    kept = {x.rsplit("/", 1)[1] for x in (before, version)}
    _, folder = _fs(spark, target)
    for status in fs.listStatus(folder):
        name = status.getPath().getName()
        if name.startswith("version-") and name not in kept:
            fs.delete(status.getPath(), True)


def _write_csv(df: DataFrame, folder: str) -> None:
    df.write.csv(folder, header=True, escape='"', lineSep="\n", emptyValue="", nullValue="")


def replace_csv_folder(df: DataFrame, target: str) -> None:
    """CSV part files as the next version of ``target``."""
    version = new_version(target)
    _write_csv(df, version)
    put_in_place(df.sparkSession, target, version)


def write_single_csv(df: DataFrame, target: str) -> None:
    """One CSV file with header and LF line ends, published in one step; for small results."""
    spark = df.sparkSession
    staged = f"{target}.new-{uuid.uuid4().hex}"
    _write_csv(df.coalesce(1), staged)
    fs, folder = _fs(spark, staged)
    parts = [s.getPath() for s in fs.listStatus(folder) if s.getPath().getName().startswith("part-")]
    publish(spark, parts[0].toString(), target)
    fs.delete(folder, True)


def replace_folder(df: DataFrame, target: str) -> None:
    """Parquet as the next version of ``target``."""
    version = new_version(target)
    df.write.parquet(version)
    put_in_place(df.sparkSession, target, version)
