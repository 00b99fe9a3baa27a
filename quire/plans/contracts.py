"""Audits of batches against a sync contract, and of the ledger's invariants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quire.operators.relational import capability_code
from quire.plans.hierarchy import cycles, tree_reference_audit
from quire.plans.ledger import path_ownership, reused_operation_ids
from quire.plans.storage_keys import storage_key_audit
from quire.operators.windows import sequence_gaps

# Entity and intent kinds, the protocol a contract batch speaks.
ENTITY_KINDS = ["project", "folder", "document", "tree_order", "trash_purge"]
INTENT_KINDS = ["ensure", "create", "update", "rename", "move", "delete", "restore", "reorder", "migrate"]
CONTRACT_PROTOCOL = 3

_STRING = r'"(?:[^"\\]|\\.)*"'


def canonical_json(text: Column) -> Column:
    """Canonical form: keys sorted, no spaces. Null if not a JSON the contract
    takes (integers only, keys of letters, digits and underscores)."""
    bare = F.regexp_replace(text, f"({_STRING}\\s*:)|{_STRING}", "$1")
    keys = F.regexp_extract_all(bare, F.lit(f"({_STRING})\\s*:"), F.lit(1))
    good_keys = F.forall(keys, lambda k: k.rlike('^"[A-Za-z_][A-Za-z0-9_]*"$'))
    numbers = F.regexp_replace(bare, f"{_STRING}\\s*:", "")
    whole = ~numbers.rlike("[0-9][.eE]")
    return F.when(good_keys & whole, F.to_json(F.try_parse_json(text)))


def payload_sha256(text: Column) -> Column:
    return F.sha2(canonical_json(text).cast("binary"), 256)


def payload_digest_audit(intents: DataFrame) -> DataFrame:
    """Intents whose payload does not have the digest they state."""
    actual = payload_sha256(F.col("payload"))
    problem = F.when(actual.isNull(), "INVALID_ARGUMENT").when(
        actual != F.col("payload_sha256"), "CONTRACT_DIGEST_MISMATCH"
    )
    return intents.withColumn("problem", problem).where("problem IS NOT NULL")


def contract_audit(
    batches: DataFrame, intents: DataFrame, projects: DataFrame, allowlist: DataFrame, operations: DataFrame
) -> DataFrame:
    """First contract fault of each batch, null if there is none.

    ``batches``: ``batch_id, project_id, mode, epoch, contract_version,
    contract_sha256, protocol_version, capabilities, client_build_id,
    ordered_intents`` (JSON array) and ``batch_payload_sha256``. ``intents``:
    one row per intent. ``projects``: ``project_id, actual_mode,
    actual_epoch``. ``allowlist``: one row per contract, ``contract_sha256,
    version, enabled, required, allowed``. ``operations``: known
    ``operation_id, project_id``.
    """
    versions = allowlist.select(F.col("version").alias("contract_version"), F.lit(True).alias("_known_version")).distinct()
    contracts = allowlist.select("contract_sha256", "enabled", "required", "allowed")

    # intents: one pass per batch over counts, never over their text
    same_id = intents.groupBy("batch_id", "operation_id").agg(F.count("*").alias("n"))
    repeated = same_id.groupBy("batch_id").agg((F.max("n") > 1).alias("_repeated"))
    known = operations.select(
        F.col("operation_id").alias("supersedes_operation_id"), "project_id", F.lit(True).alias("_original")
    )
    linked = intents.join(batches.select("batch_id", "project_id"), "batch_id").join(
        known, ["supersedes_operation_id", "project_id"], "left"
    )
    supersedes = F.col("supersedes_operation_id")
    bad_link = supersedes.isNotNull() & (
        (supersedes == F.col("operation_id")) | F.col("_original").isNull()
    )
    malformed = (
        ~F.col("entity_kind").isin(ENTITY_KINDS)
        | ~F.col("intent_kind").isin(INTENT_KINDS)
        | (F.col("base_revision") < 0)
        | ~F.coalesce(payload_sha256(F.col("payload")) == F.col("payload_sha256"), F.lit(False))
        | bad_link
    )
    shape = linked.groupBy("batch_id").agg(
        F.bool_or(malformed).alias("_malformed"),
        ((F.min("sequence") == 1) & (F.max("sequence") == F.count("*")) & (F.count_distinct("sequence") == F.count("*"))).alias("_contiguous"),
    )
    joined = (
        batches.join(projects, "project_id", "left")
        .join(contracts, "contract_sha256", "left")
        .join(versions, "contract_version", "left")
        .join(shape, "batch_id", "left")
        .join(repeated, "batch_id", "left")
    )
    code = (
        F.when(F.col("actual_mode") != F.col("mode"), "PROJECT_MIGRATING")
        .when(F.col("actual_epoch") != F.col("epoch"), "STALE_MIGRATION_EPOCH")
        .when(F.col("enabled").isNull() & F.col("_known_version"), "CONTRACT_DIGEST_MISMATCH")
        .when(~F.coalesce("enabled", F.lit(False)), "CONTRACT_NOT_ALLOWED")
        .when(F.col("protocol_version") != CONTRACT_PROTOCOL, "PROTOCOL_TOO_OLD")
        .when(
            capability_code(F.col("capabilities"), F.col("required"), F.col("allowed")).isNotNull(),
            "CAPABILITY_MISMATCH",
        )
        .when(F.coalesce("client_build_id", F.lit("")) == "", "INVALID_ARGUMENT")
        .when(
            ~F.coalesce(payload_sha256(F.col("ordered_intents")) == F.col("batch_payload_sha256"), F.lit(False)),
            "CONTRACT_DIGEST_MISMATCH",
        )
        .when(F.coalesce("_malformed", F.lit(False)), "INVALID_ARGUMENT")
        .when(F.coalesce("_repeated", F.lit(False)), "OPERATION_ID_REUSED")
        .when(~F.coalesce("_contiguous", F.lit(True)), "INVALID_ARGUMENT")
    )
    return joined.select("batch_id", code.alias("code"))


def invariant_audit(
    versions: DataFrame,
    current: DataFrame,
    requests: DataFrame,
    folders: DataFrame,
    orders: DataFrame,
    entities: DataFrame,
    events: DataFrame,
) -> DataFrame:
    """Violations of the ledger's invariants: ``invariant, subject, detail``.

    ``versions``: ``document_id, revision`` in order; ``current``:
    ``project_id, document_id, relative_path, is_deleted, deleted_at,
    structure_changed``; ``requests``: ``operation_id, payload_digest,
    provenance, batch_id``; ``folders``: ``id, parent_id, name, project_id,
    is_deleted``; ``orders``: ``children``; ``entities``: ``id, is_deleted``;
    ``events``: ``operation_id, event_sequence``.
    """

    def rows(df: DataFrame, invariant: str, subject: Column, detail: str) -> DataFrame:
        return df.select(
            F.lit(invariant).alias("invariant"), subject.cast("string").alias("subject"), F.lit(detail).alias("detail")
        )

    project_of = folders.select(F.col("id").alias("parent_id"), F.col("project_id").alias("_parent_project"))
    parts = [
        rows(
            sequence_gaps(versions, ["document_id"], "revision", ["revision"]),
            "INV-001", F.col("document_id"), "revision is not its predecessor plus one",
        ),
        rows(reused_operation_ids(requests), "INV-002", F.col("operation_id"), "operation id carries several payloads"),
        rows(path_ownership(current), "INV-003", F.col("relative_path"), "live path held by several documents"),
        rows(tree_reference_audit(orders, entities), "INV-005", F.col("id"), "tree order names no live entity once"),
        rows(
            current.where(F.col("is_deleted") != F.col("deleted_at").isNotNull()),
            "INV-006", F.col("document_id"), "tombstone without its time, or a time without it",
        ),
        rows(
            requests.where("provenance = 'CONTRACT_BATCH' AND batch_id IS NULL"),
            "INV-009", F.col("operation_id"), "contract operation without a batch",
        ),
        rows(cycles(folders).where("outcome = 'parentCycle'"), "INV-010", F.col("id"), "folder lies below itself"),
        rows(
            folders.join(project_of, "parent_id").where("project_id <> _parent_project"),
            "INV-010", F.col("id"), "parent belongs to another project",
        ),
        rows(
            sequence_gaps(events, ["operation_id"], "event_sequence", ["event_sequence"]),
            "INV-011", F.col("operation_id"), "event sequence has a gap",
        ),
        rows(
            storage_key_audit(folders.where("NOT is_deleted"), ["project_id", "parent_id"]),
            "INV-012", F.col("storage_key"), "siblings share a storage key",
        ),
        rows(
            current.where("structure_changed"),
            "INV-013", F.col("document_id"), "document commit changed structure",
        ),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
