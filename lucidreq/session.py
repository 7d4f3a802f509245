"""Session helper for local runs; on a cluster the caller brings the session."""

from __future__ import annotations

from pyspark.sql import SparkSession


def local_session(cpus: str = "*", partitions: int = 8) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Make this package importable on workers that can't see its folder; once for each application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    import tempfile
    import zipfile
    from pathlib import Path

    top = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="lucidreq-")) / "lucidreq.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent))
    # Spark's own file server hands the archive to the executors.
    spark.sparkContext.addPyFile(str(archive))
    _shipped.add(app)
