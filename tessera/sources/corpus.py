"""Reading and writing: files, texts, HTML pages, versioned corpora, entities and records."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import written


def list_files(spark: SparkSession, root: str, recursive: bool = True) -> DataFrame:
    """(source, path, size, mtime): every directory below root is a source of its direct files; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(root)
    return files.select(F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("source"), "path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime")).dropDuplicates(["path"])


def read_text_documents(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """(path, page, text): whole files as page 1, not stripped."""
    return spark.read.text(paths, wholetext=True).select(F.input_file_name().alias("path"), F.lit(1).alias("page"), F.col("value").alias("text"))


def html_text(c: Column) -> Column:
    """Visible text of HTML: without scripts, styles, comments and tags; block ends become line ends."""
    bare = F.regexp_replace(c, r"(?is)<(script|style|head)\b.*?</\1>|<!--.*?-->", " ")
    lines = F.regexp_replace(bare, r"(?i)</(p|div|li|tr|h[1-6]|ul|nav|table)>|<br\s*/?>", "\n")
    text = F.regexp_replace(lines, r"<[^>]*>", " ")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"[ \t\r\f]+", " "), r"\s*\n\s*", "\n"))


def _hadoop(spark: SparkSession, path: str):
    """The file system of a path, and its path type."""
    kind = spark._jvm.org.apache.hadoop.fs.Path
    return kind(path).getFileSystem(spark._jsc.hadoopConfiguration()), kind


def commits(spark: SparkSession, path: str) -> dict[int, str]:
    """The folder of each version that is whole."""
    fs, at = _hadoop(spark, path)
    if not fs.exists(at(f"{path}/commits")):
        return {}
    names = [f.getPath().getName() for f in fs.listStatus(at(f"{path}/commits"))]
    found = {}
    for name in names:
        if name.isdigit():
            stream = fs.open(at(f"{path}/commits/{name}"))
            try:
                found[int(name)] = stream.readUTF()
            finally:
                stream.close()
    return found


def write_corpus(df: DataFrame, path: str, version: int) -> None:
    """Writes df as a version: rows go to a folder of their own, and a commit record that names it is renamed into place when they are whole.

    Until then readers see the version as it was before, or not at all. Writing a version again replaces it; the rows before stay until
    vacuum_corpus, so that readers who have begun can end."""
    spark, folder = df.sparkSession, f"data/{version}-{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{folder}")
    fs, at = _hadoop(spark, path)
    record = at(f"{path}/commits/.{uuid.uuid4().hex}")
    stream = fs.create(record, True)
    try:
        stream.writeUTF(folder)
    finally:
        stream.close()
    options = spark._jvm.org.apache.hadoop.fs.Options.Rename
    how = spark.sparkContext._gateway.new_array(options, 1)
    how[0] = options.OVERWRITE
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    context.rename(fs.makeQualified(record), fs.makeQualified(at(f"{path}/commits/{version}")), how)


def read_corpus(spark: SparkSession, path: str, version: int) -> DataFrame:
    """Rows of one version; one that is not committed counts as missing and has none. Without any version there is nothing to read."""
    known = commits(spark, path)
    if version in known:
        return spark.read.parquet(f"{path}/{known[version]}")
    if not known:
        raise FileNotFoundError(f"{path} holds no committed version")
    return spark.read.parquet(f"{path}/{known[max(known)]}").where("false")


def vacuum_corpus(spark: SparkSession, path: str) -> int:
    """Deletes the folders that no commit record names: replaced versions and writes that did not end. Not to be run beside a writer."""
    fs, at = _hadoop(spark, path)
    kept = {x.rpartition("/")[2] for x in commits(spark, path).values()}
    gone = [f.getPath() for f in fs.listStatus(at(f"{path}/data"))] if fs.exists(at(f"{path}/data")) else []
    gone = [x for x in gone if x.getName() not in kept]
    for x in gone:
        fs.delete(x, True)
    return len(gone)


def entities_from(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entities, issues) from rows(entity_type, id, name, tags, ord): the first definition of an id wins."""
    n = F.row_number().over(Window.partitionBy("entity_type", "id").orderBy("ord"))
    problem = F.when(~F.coalesce(F.col("id").rlike(r"^[a-z0-9][a-z0-9_.-]*$"), F.lit(False)), "bad id").when(F.trim(F.coalesce("name", F.lit(""))) == "", "empty name").when(F.col("n") > 1, "duplicate id")
    checked = rows.withColumn("n", n).withColumn("problem", problem).withColumn("tags", F.transform("tags", F.trim))
    return checked.where("problem is null").drop("n", "problem"), checked.where("problem is not null").select("entity_type", "id", "ord", "problem")


def read_records(spark: SparkSession, path: str, schema: str, owner: str | None = None) -> DataFrame:
    """JSON records with file names; unreadable ones are left out."""
    rows = spark.read.schema(schema + ", _bad string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").option("multiLine", True).json(path)
    rows = rows.withColumn("file", F.input_file_name()).where("_bad is null").drop("_bad")
    return rows if owner is None else rows.where(F.col("owner") == owner)


def check_envelopes(rows: DataFrame, format_name: str, version: int, required: tuple[str, ...] = ("owner", "record_id", "system_id")) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) of exported records(format, format_version, ...): rejected ones have a `problem`.

    The format and its version must be the given ones, and the required keys must not be blank."""
    blank = F.filter(F.array(*[F.when(F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == "", F.lit(c)) for c in required]), lambda x: x.isNotNull())
    problem = (F.when(~F.col("format").eqNullSafe(F.lit(format_name)), F.lit("unknown format")).when(~F.col("format_version").eqNullSafe(F.lit(version)), F.lit("unsupported version"))
               .when(F.size(blank) > 0, F.concat(F.lit("missing "), F.array_join(blank, ", "))))
    checked = rows.withColumn("problem", problem)
    return checked.where("problem is null").drop("problem"), checked.where("problem is not null")


def import_records(incoming: DataFrame, existing: DataFrame, mode: str = "copy") -> DataFrame:
    """existing and incoming(owner, record_id, ...): a clashing id gets a new id (copy) or replaces the stored record (replace)."""
    key = ["owner", "record_id"]
    clash = incoming.join(existing.select(*key), key, "left_semi")
    fresh = incoming.join(existing.select(*key), key, "left_anti")
    if mode == "replace":
        return existing.join(incoming.select(*key), key, "left_anti").unionByName(incoming)
    # The n-th copy of a record takes the n-th name, so that importing it again never meets an earlier copy.
    name = lambda n: F.substring(F.sha2(F.concat_ws("\0", F.lit("copy"), "owner", F.col("record_id").cast("string"), n.cast("string")), 256), 1, 32).cast(incoming.schema["record_id"].dataType)
    taken = existing.select(F.col("owner").alias("o"), F.col("record_id").alias("r"))
    turn = F.row_number().over(Window.partitionBy("owner", "record_id").orderBy(F.xxhash64(*incoming.columns)))
    open_, renamed, start = clash.withColumn("_n", turn), None, 0
    while renamed is None or not open_.isEmpty():
        tried = written(open_.withColumn("_new", name(F.col("_n") + start)))
        free = tried.join(taken, (F.col("owner") == F.col("o")) & (F.col("_new") == F.col("r")), "left_anti")
        done = free.drop("record_id", "_n").withColumnRenamed("_new", "record_id").select(incoming.columns)
        renamed = done if renamed is None else renamed.unionByName(done)
        open_ = written(tried.join(taken, (F.col("owner") == F.col("o")) & (F.col("_new") == F.col("r")), "left_semi").drop("_new"))
        start += 1_000
    return existing.unionByName(fresh).unionByName(renamed)
