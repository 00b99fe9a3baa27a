"""Readers of nodes, snapshots, backups and JSON evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from quire.functions.digests import is_canonical_uuid
from quire.functions.names import valid_folder_name, valid_relative_path
from quire.operators.windows import distinct_backups
from quire.plans.ledger import MAX_CONTENT_BYTES


def read_nodes(spark: SparkSession, path: str, project_id: str, parent_id: str | None = None) -> DataFrame:
    """Nodes of one project; the filters reach the Parquet scan."""
    nodes = spark.read.parquet(path).where(F.col("project_id") == project_id)
    return nodes if parent_id is None else nodes.where(F.col("parent_id") == parent_id)


def parse_timestamp(text: Column) -> Column:
    """ISO time with or without a fraction; null if it is neither."""
    return F.try_to_timestamp(text)


# The columns a snapshot reader asks for.
DOCUMENT_COLUMNS = [
    "document_id", "project_id", "relative_path", "content", "revision", "is_deleted", "deleted_at", "updated_at",
]


def read_snapshot(spark: SparkSession, path: str, project_id: str, columns: list[str] = DOCUMENT_COLUMNS) -> DataFrame:
    """Chosen columns of a project's remote documents, times parsed."""
    rows = spark.read.parquet(path).where(F.col("project_id") == project_id).select(*columns)
    times = [c for c in ("deleted_at", "updated_at") if c in columns and rows.schema[c].dataType == T.StringType()]
    return rows.withColumns({c: parse_timestamp(F.col(c)) for c in times})


def snapshot_faults(snapshot: DataFrame) -> DataFrame:
    """Rows for which a whole snapshot is refused, with the reason."""
    counts = snapshot.groupBy("document_id").agg(F.count("*").alias("_n"))
    repeated = counts.where("_n > 1").select("document_id", F.lit("duplicateId").alias("fault"))
    fault = (
        F.when(F.col("revision") <= 0, "revision")
        .when(F.octet_length("content") > MAX_CONTENT_BYTES, "tooLarge")
        .when(~valid_relative_path(F.col("relative_path")), "path")
        .when(F.col("is_deleted") != F.col("deleted_at").isNotNull(), "deletionPair")
    )
    single = snapshot.withColumn("fault", fault).where("fault IS NOT NULL").select("document_id", "fault")
    return repeated.unionByName(single)


def validate_snapshot(snapshot: DataFrame) -> DataFrame:
    """The snapshot by id; raises if any row is at fault."""
    faults = snapshot_faults(snapshot).limit(1).collect()
    if faults:
        raise ValueError(f"invalid snapshot: {faults[0]['fault']} in {faults[0]['document_id']}")
    return snapshot.orderBy("document_id")



BACKUP_SCHEMA = (
    "backup_id string, project_id string, document_id string, relative_path string, created_at timestamp, "
    "content_hash string, reason string, is_pinned boolean, byte_count bigint"
)


def read_backups(spark: SparkSession, folders: list[str]) -> dict[str, DataFrame]:
    """Backup metadata of several folders: the ``inventory``, one row per id, and the ``rejects``.

    A file that is no JSON, or an entry without an id, is a reject with its file.
    """
    raw = (
        spark.read.schema(f"{BACKUP_SCHEMA}, _corrupt_record string")
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt_record")
        .option("pathGlobFilter", "*.json")
        .option("multiLine", "true")
        .json(folders)
        .withColumn("source_file", F.input_file_name())
    )
    sound = F.col("_corrupt_record").isNull() & F.col("backup_id").isNotNull()
    return {
        "inventory": distinct_backups(raw.where(sound).drop("_corrupt_record", "source_file")),
        "rejects": raw.where(~sound).select("source_file", "_corrupt_record"),
    }


def read_backup_inventory(spark: SparkSession, folders: list[str]) -> DataFrame:
    """The inventory alone."""
    return read_backups(spark, folders)["inventory"]


_FOLDER = "struct<folder_id:string,parent_folder_id:string,name:string,revision:bigint,is_deleted:boolean,updated_at:timestamp,last_operation_id:string>"
_DOCUMENT = (
    "struct<document_id:string,folder_id:string,relative_path:string,revision:bigint,is_deleted:boolean,"
    "deleted_at:timestamp,content:string,content_sha256:string,updated_at:timestamp,last_operation_id:string>"
)
_TREE_ORDER = (
    "struct<document_id:string,revision:bigint,representation:string,entries:map<string,array<string>>,"
    "folder_paths:array<string>,payload_sha256:string,updated_at:timestamp,last_operation_id:string>"
)
SERVER_SNAPSHOT_SCHEMA = (
    "snapshot_version string, captured_at timestamp, server_project_id string, project_name string, "
    "project_sync_mode string, migration_epoch bigint, minimum_write_protocol bigint, contract_version string, "
    "canonical_contract_sha256 string, last_successful_operation_id string, "
    f"folders array<{_FOLDER}>, documents array<{_DOCUMENT}>, tree_order {_TREE_ORDER}, "
    "server_capabilities array<string>, limitations array<string>, _corrupt_record string"
)
_DEVICE = (
    "struct<platform:string,device_id:string,device_name:string,client_build_id:string,client_build_sha256:string,"
    "git_commit:string,sync_protocol_version:bigint,contract_version:string,canonical_contract_sha256:string,"
    "client_capabilities:array<string>>"
)
_EVIDENCE = "struct<path:string,sha256:string,size_bytes:bigint,source:string,immutable_copy:boolean,captured_at:timestamp>"
_BATCH = (
    "struct<batch_id:string,writer_device_id:string,client_build_id:string,sync_protocol_version:bigint,"
    "contract_version:string,canonical_contract_sha256:string,client_capabilities:array<string>,status:string,"
    "created_at:timestamp>"
)
_OPERATION = "struct<operation_id:string,batch_id:string,sequence:bigint,entity_kind:string,entity_id:string,intent_kind:string,base_revision:bigint>"
INCIDENT_SCHEMA = (
    "incident_schema_version string, incident_id string, test_run_id string, captured_at timestamp, "
    "capture_timezone string, server_project_id string, project_name string, evidence_phase string, "
    f"source_devices array<{_DEVICE}>, evidence_files array<{_EVIDENCE}>, "
    "timeline array<struct<at:timestamp,kind:string,detail:string,source:string>>, "
    f"batches array<{_BATCH}>, operations array<{_OPERATION}>, limitations array<string>, "
    "source_mutations_performed boolean, _corrupt_record string"
)


def _read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return (
        spark.read.schema(schema)
        .option("multiLine", "true")
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt_record")
        .json(path)
        .withColumn("source_file", F.input_file_name())
    )


def read_server_snapshot(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Folders, documents, tree order and rejects of snapshot files."""
    raw = _read_json(spark, path, SERVER_SNAPSHOT_SCHEMA)
    required = ["snapshot_version", "server_project_id", "project_name", "project_sync_mode", "migration_epoch", "folders", "documents", "tree_order"]
    complete = F.col("_corrupt_record").isNull()
    for name in required:
        complete = complete & F.col(name).isNotNull()
    mode = F.col("project_sync_mode").isin("LEGACY", "MIGRATING", "ID_BASED")
    sound = F.coalesce(complete & mode & is_canonical_uuid(F.lower("server_project_id")), F.lit(False))
    good = raw.where(sound)
    return {
        "folders": good.select("server_project_id", F.inline("folders")),
        "documents": good.select("server_project_id", F.inline("documents")),
        "tree_order": good.select("server_project_id", "tree_order.representation", F.explode("tree_order.entries").alias("parent_key", "children")),
        "rejects": raw.where(~sound).select("source_file", "_corrupt_record"),
    }


def read_incident(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Devices, files, batches, operations and rejects of incident files."""
    raw = _read_json(spark, path, INCIDENT_SCHEMA)
    sound = F.coalesce(
        F.col("_corrupt_record").isNull()
        & is_canonical_uuid(F.lower("incident_id"))
        & (F.size("source_devices") > 0)
        & (F.size("evidence_files") > 0)
        & ~F.col("source_mutations_performed"),
        F.lit(False),
    )
    good = raw.where(sound)
    parts = {
        "devices": "source_devices", "files": "evidence_files", "batches": "batches",
        "operations": "operations", "timeline": "timeline",
    }
    out = {name: good.select("incident_id", F.inline(column)) for name, column in parts.items()}
    out["rejects"] = raw.where(~sound).select("source_file", "_corrupt_record")
    return out


# The keys a purge envelope has, and no others.
PURGE_KEYS = ["empty_generation", "purged_revisions", "version"]


def decode_trash_purge(df: DataFrame, column: str = "content") -> DataFrame:
    """Strict purge envelopes: ``generation``, ``revisions`` and ``fault``.

    Exactly three keys, whole numbers, version 1, canonical ids. A row at
    fault keeps its reason and has no values.
    """
    text = F.col(column)
    keys = F.array_sort(F.json_object_keys(text))
    wanted = F.array(*[F.lit(k) for k in PURGE_KEYS])
    inner = F.get_json_object(text, "$.purged_revisions")
    raw = F.from_json(inner, "map<string,string>")
    values = F.map_values(raw)
    version = F.get_json_object(text, "$.version")
    generation = F.get_json_object(text, "$.empty_generation")
    quoted = text.rlike(r'"version"\s*:\s*"') | inner.rlike(r':\s*"')
    whole = F.forall(values, lambda v: v.rlike("^-?(0|[1-9][0-9]*)$"))
    revisions = F.transform_values(raw, lambda _, v: v.try_cast("bigint"))
    sound_ids = F.forall(F.map_keys(raw), is_canonical_uuid)
    sound_revisions = F.forall(F.map_values(revisions), lambda v: F.coalesce(v >= 0, F.lit(False)))
    is_object = F.trim(inner).startswith("{")
    fault = (
        F.when(keys.isNull() | ~F.coalesce(keys == wanted, F.lit(False)), "invalidEnvelope")
        .when(~F.coalesce(is_object & whole & version.rlike("^-?[0-9]+$"), F.lit(False)) | quoted, "invalidEnvelope")
        .when(~F.coalesce(text.rlike(r'"empty_generation"\s*:\s*"'), F.lit(False)), "invalidWireTypes")
        .when(version != "1", "invalidVersion")
        .when((generation != "") & ~is_canonical_uuid(generation), "invalidGeneration")
        .when(~sound_ids | ~sound_revisions, "invalidRevision")
    )
    good = F.col("fault").isNull()
    return df.withColumn("fault", fault).withColumns(
        {"generation": F.when(good, generation), "revisions": F.when(good, revisions)}
    )
