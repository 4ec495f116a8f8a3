"""Operators on the entity tables, each a function from DataFrames to DataFrames."""

from .checked import split_checked
from .history import LEGAL_MOVES, claim_history, claim_states, illegal_moves
from .intake import (
    accepted_claims,
    check_intake,
    accepted_lines,
    claim_items,
    claim_payload,
    intake_claims,
    parse_payload,
    payload_pieces,
    rejected_claims,
)
from .kpis import (
    active_vehicles,
    admin_kpis,
    claims_per_status,
    claims_this_week,
    dealer_kpis,
    low_stock_count,
)
from .lists import (
    claim_list,
    escaped_rows,
    maintenance_timeline,
    newest_claims,
    part_cards,
    part_labels,
    part_picker,
    recent_claims,
    shipment_list,
    status_badges,
    stock_level,
    vehicle_list,
    vehicle_picker,
    vehicle_profile,
)
from .page import vehicle_page
from .partials import (
    admin_kpis_from,
    claim_partials,
    claims_per_status_from,
    claims_this_week_from,
    dealer_claims_from,
    merged_partials,
    minus,
    stock_partials,
)
from .related import (
    claim_lines,
    claimed_parts,
    related_claims,
    review_queue_dealer,
    shipments_with_claim,
    vehicle_by_id,
    vehicles_by_id,
)
from .review import (
    apply_decisions,
    check_decisions,
    decided_claims,
    newest_decisions,
    reviewed_claims,
)
from .search import (
    dealer_scope,
    filter_claims,
    low_stock,
    pending_review,
    search,
    search_claims,
    search_inventory,
    search_parts,
    search_vehicles,
)
from .shipping import booked_shipments, merged_claims, shipped_claims
from .stock import apply_outbound, check_outbound, moved_stock, stock_after_outbound
from .trigrams import query_trigrams, search_postings, trigram_postings, trigrams
from .warranty import (
    RULES,
    Rules,
    claim_checks,
    part_checks,
    review_card,
    vehicle_record,
    warranty_check,
    warranty_cover,
    warranty_recommendation,
    with_status,
)
from .writeoff import (
    approved_lines,
    awaiting_writeoff,
    shipment_requests,
    write_off,
    writeoff_orders,
    writeoff_stock,
)

__all__ = [name for name in dir() if not name.startswith("_")]
