"""Session helpers shared by tests and the benchmark (the engine itself never builds a session)."""

from __future__ import annotations

from pyspark.sql import SparkSession


def local_session(cores: int | str = 8, app: str = "timelode", memory: str = "12g", **conf: str) -> SparkSession:
    """A local session with the settings that the small tables want.

    Shuffle partitions are kept low because the inputs are; on a cluster the
    caller's session decides, and nothing in the engine depends on these values.
    """
    settings = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.driver.memory": memory,
        "spark.ui.showConsoleProgress": "false",
    } | conf
    return SparkSession.builder.master(f"local[{cores}]").appName(app).config(map=settings).getOrCreate()
