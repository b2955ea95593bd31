"""Types, allow-lists and parameters of the knowledge graph."""

from __future__ import annotations

# Entity labels that are identifiers, which many aggregates exclude.
ID_TYPES = (
    "Email", "PhoneNumber", "PostalAddress", "DocumentDate", "Amount", "ContractNumber", "OrderNumber", "InvoiceNumber", "INN", "OGRN", "BIC", "BankAccount",
)
# Identifier labels that an organisation is expected to have.
EXPECTED_IDS = {"Organization": ("INN", "OGRN", "PostalAddress", "PhoneNumber", "Email")}
POLARITIES = ("affirmed", "negated", "uncertain")
STATUSES = ("pending", "processing", "completed", "failed", "skipped", "vector_only")
GRANULARITIES = ("day", "week", "month", "quarter", "year")
VALUE_KINDS = ("level", "share", "rate", "index")

ENTITIES = (
    "name string, label string, description string, mention_count long, created_at int, first_doc_id string, event_type string, event_ts_raw string, "
    "event_start_epoch long, event_end_epoch long, event_ts_precision string"
)
RELATIONS = (
    "rel_id string, src string, tgt string, rel_type string, polarity string, valid_from string, valid_to string, weight double, created_at int, first_doc_id string, source_chunks array<string>"
)


def clamp_top_n(n: int | None, default: int = 20, most: int = 200) -> int:
    """A requested row cap in [1, most]; nothing or a number below 1 means the default."""
    return min(int(n), most) if n and n > 0 else default
