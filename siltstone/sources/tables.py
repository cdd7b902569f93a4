"""Parquet sources with declared schemas.

Schemas are always given explicitly: no inference job runs, a column missing
from a file reads as null, and extra columns are pruned at the scan.
"""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_META = (
    "min_seq bigint, max_seq bigint, file_size bigint, record_count bigint, tombstone_count bigint, "
    "data_block_count bigint, data_bytes bigint, smallest_key binary, largest_key binary"
)

SCHEMAS = {
    "changelog": "log_no bigint, db_id bigint, wal_id bigint, key_entry binary, value_entry binary, type int, "
    "seq_num bigint, logged_at timestamp_ntz",
    "wal_headers": "db_id bigint, wal_id bigint, start_seq bigint, version int, header_size int, block_size int, "
    "opened_at timestamp_ntz",
    "manifest_edits": f"db_id bigint, edit_no bigint, op string, table_id bigint, level int, path string, {_META}, "
    "next_table_id bigint, next_sequence_number bigint, current_wal_id bigint, commit_state string, "
    "committed_at timestamp_ntz",
    "table_meta": f"db_id bigint, table_id bigint, level int, path string, {_META}, edit_no bigint, "
    "committed_at timestamp_ntz",
    "sst_footers": "scan_no bigint, path string, seen_state string, file_size bigint, data_block_count bigint, "
    "index_size int, bloom_size int, scanned_at timestamp_ntz",
    "run_records": "db_id bigint, table_id bigint, level int, block_no int, key_entry binary, value_entry binary, "
    "type int, seq_num bigint",
    "bloom_sections": "db_id bigint, table_id bigint, bloom_bits bigint, hash_count int, key_count bigint, mask binary",
    "incoming_records": "in_no bigint, db_id bigint, key_entry binary, value_entry binary, type int, "
    "arrived_at timestamp_ntz",
    "level_targets": "level int, target_file_size bigint, small_file_size bigint",
    "pack_sizes": "pack_kind string, capacity_tokens int",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint, message_id string, "
    "in_reply_to string, sent_at timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
}


_SCRATCH: set[str] = set()


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of a test-data directory."""
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder shared by all executors for written tables and checkpoints.

    A cluster names it in ``spark.checkpoint.dir``. Only where that is unset
    and everything runs in one process (a ``local[..]`` master, as in tests) is
    an own one made, and removed when Python ends; on a cluster it is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    own = tempfile.mkdtemp(prefix="siltstone-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", f"file://{own}")
    return f"file://{own}"


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the application's own folder of the shared one, for a table that later steps read.

    Results read such tables lazily, so they stay as long as the application
    and go with it; what a killed driver leaves is one folder named by its id.
    """
    root = f"{shared_dir(spark)}/siltstone-{spark.sparkContext.applicationId}"
    if root not in _SCRATCH:
        _SCRATCH.add(root)
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        atexit.register(_remove, jvm, conf, root)
    return f"{root}/{name}-{uuid.uuid4().hex}"


def _remove(jvm, conf, root: str) -> None:
    with contextlib.suppress(Exception):  # the JVM may be gone
        at = jvm.org.apache.hadoop.fs.Path(root)
        at.getFileSystem(conf).delete(at, True)


def written(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """The rows written once to a scratch table (or the path given) and read from there, which cuts the lineage."""
    path = path or scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
