"""Cutting lineage through tables written to the cluster's shared folder."""

import tempfile
import uuid

from pyspark.sql import Observation

_local_dirs = {}

#: Partitions that a side session shuffles lines to before small ones are put together; with few, each would spill.
LINE_PARTITIONS = 512

#: Bytes of lines, read or shuffled, that one of its tasks takes: as rows of an aggregate or a sort they are
#: some ten times as many, which have to fit a core's share of an executor's memory.
LINE_BYTES = "16m"


def shared_dir(spark):
    """The folder named by ``spark.checkpoint.dir``.

    Only a local session may go without the setting; it then gets one scratch
    folder of its own. On a cluster a machine-local folder would be lost with
    the machine, so a missing setting is an error there.
    """
    context = spark.sparkContext
    configured = context.getConf().get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    explicit = context.getCheckpointDir()
    if explicit:
        return explicit.rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder before running on a cluster")
    key = context.applicationId
    if key not in _local_dirs:
        _local_dirs[key] = tempfile.mkdtemp(prefix="ledgerlark-")
        context.setCheckpointDir(_local_dirs[key])
    return _local_dirs[key]


def run_dir(spark):
    """The folder below the shared one that holds all intermediate tables of this application."""
    return f"{shared_dir(spark)}/run-{spark.sparkContext.applicationId}"


def scratch_path(spark, name):
    """A fresh path in the run's folder."""
    return f"{run_dir(spark)}/{name}-{uuid.uuid4().hex}"


def remove_run(spark):
    """Delete the intermediate tables of this application. Results that were not written
    elsewhere go with them, so this is the last call of a run."""
    place = spark._jvm.org.apache.hadoop.fs.Path(run_dir(spark))
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def side_session(spark):
    """A session of its own for steps that write, shuffle or group all lines, in tasks small enough not to
    spill. Observed writes need one too: a session that has observed something can't be sent along
    with a task any more, which model pipelines of this version do."""
    side = spark.newSession()
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    side.conf.set("spark.sql.shuffle.partitions", partitions)
    side.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", str(max(LINE_PARTITIONS, int(partitions))))
    side.conf.set("spark.sql.files.maxPartitionBytes", LINE_BYTES)
    side.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", LINE_BYTES)
    return side


def observed(spark, df, measures, name="observed"):
    """``df``, of a side session, with aggregate ``measures`` that are taken in the pass that writes it, and
    a function that gives them as a frame of one row of ``spark`` once it is written."""
    observation = Observation(name)
    kinds = df.agg(*[column.alias(k) for k, column in measures.items()]).schema

    def values():
        found = observation.get
        return spark.createDataFrame([tuple(found[field.name] for field in kinds)], kinds)

    return df.observe(observation, *[column.alias(k) for k, column in measures.items()]), values


def cut(df, name="table", spark=None):
    """Write ``df`` once and read it back, in ``spark`` if that is not its own session: later jobs scan columns of
    the stored table instead of recomputing it, and losing an executor costs a re-read."""
    spark = spark or df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
