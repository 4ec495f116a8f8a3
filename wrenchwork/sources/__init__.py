"""Readers of the entity tables and of API dumps, and the writers of new state."""

from .envelope import (
    checked_bodies,
    read_api_dump,
    read_checked_dump,
    rejected_bodies,
    rows_of_bodies,
    unwrap_envelope,
)
from .bucketed import by_vin, write_by_vin
from .postings import search_stored, write_postings
from .readers import (
    read_accidents,
    read_claims,
    read_decisions,
    read_inventory,
    read_maintenance,
    read_new_claims,
    read_outbound,
    read_parts,
    read_shipments,
    read_vehicles,
)
from .versions import Version, VersionTaken, exists, is_done, merge_claims, newest_version, read_version
from .writers import append_claims, append_rows, require_unique, write_claims, write_snapshot

__all__ = [
    "Version",
    "VersionTaken",
    "append_claims",
    "append_rows",
    "by_vin",
    "checked_bodies",
    "exists",
    "is_done",
    "merge_claims",
    "newest_version",
    "read_accidents",
    "read_api_dump",
    "read_checked_dump",
    "read_claims",
    "read_decisions",
    "read_inventory",
    "read_maintenance",
    "read_new_claims",
    "read_outbound",
    "read_parts",
    "read_shipments",
    "read_vehicles",
    "read_version",
    "rejected_bodies",
    "require_unique",
    "rows_of_bodies",
    "search_stored",
    "unwrap_envelope",
    "write_by_vin",
    "write_claims",
    "write_postings",
    "write_snapshot",
]
