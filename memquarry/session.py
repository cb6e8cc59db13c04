"""The session settings that the rest of the package assumes."""

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = 8, shuffle_partitions: int = 8, memory: str = "8g", app: str = "memquarry") -> SparkSession:
    """A session of one JVM, for tests and the bench; on a cluster the submitter's own session is used."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app).config("spark.driver.memory", memory).config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Gives this package to the session's Python workers, once per context, as a zip file that Spark distributes. Arrow batches of a session that says nothing of their rows are set to 2,000 in place of Spark's 10,000, as rows here hold whole texts."""
    import tempfile
    import zipfile
    from pathlib import Path

    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not spark._jsparkSession.sessionState().conf().contains(batch):
        spark.conf.set(batch, "2000")
    context = spark.sparkContext
    if getattr(context, "_memquarry_shipped", False):
        return
    root = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp(prefix="memquarry-code-")) / "memquarry.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for source in sorted(root.rglob("*.py")):
            z.write(source, source.relative_to(root.parent))
    context.addPyFile(str(path))
    context._memquarry_shipped = True


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which every executor sees. Where it is unset, as in local tests, a folder of this machine is set; on a cluster that is refused."""
    import tempfile

    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir") or context._jsc.sc().getCheckpointDir().getOrElse(None)
    if not base:
        if context.master != "local" and not context.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="memquarry-")
        context.setCheckpointDir(base)
    return str(base)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: computed once, without lineage, readable after the loss of executors."""
    path = passing_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def passing_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder that is removed when the driver ends."""
    import uuid

    path = f"{shared_folder(spark)}/memquarry/{name}-{uuid.uuid4().hex}"
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path
