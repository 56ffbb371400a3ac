"""Message-history analytics as PySpark DataFrame jobs.

    from msgloom import configure, read_contacts, read_messages, sync_files, top_contacts

    configure(spark)
    sync_files(spark, "/data/raw", read_contacts(spark, "/data/contacts.csv"), "/data/messages")
    top_contacts(read_messages(spark, "/data/messages"), limit=10).show()
"""

from msgloom.errors import CommitConflict, DatasetNotFound, SchemaMismatch, SourceNotFound
from msgloom.operators.contacts import conflicts, first_per_key, resolve
from msgloom.operators.messages import build_messages, with_counterparty
from msgloom.operators.sinks import json_rows, write_csv, write_json
from msgloom.plans.analyses import (
    contact_stats,
    direction,
    display,
    effects,
    group_message_count,
    links,
    reactions,
    search_contacts,
    seasonality,
    time_series,
    top_contacts,
)
from msgloom.plans.conversations import (
    compare_contacts,
    compare_periods,
    contact_deep_dive,
    group_chats,
    needs_reply,
    period_in_review,
)
from msgloom.plans.ingest import full_build, refresh, sync, sync_files
from msgloom.plans.sqlview import query, register
from msgloom.plans.upkeep import apply_links, compact, migrate, remove_superseded
from msgloom.session import configure
from msgloom.sources.contacts import address_book_entries, read_contacts
from msgloom.sources.raw import read_raw, read_raw_jdbc
from msgloom.sources.search import index_contacts, search_stored
from msgloom.sources.stored import data_files, read_messages, schema_gate, status
from msgloom.sources.summaries import contact_names, read_daily
from msgloom.streaming.ingest import start_ingest, start_links

__all__ = [
    "CommitConflict", "DatasetNotFound", "SchemaMismatch", "SourceNotFound", "address_book_entries", "apply_links", "build_messages", "compact", "compare_contacts", "compare_periods",
    "configure", "conflicts", "contact_names", "contact_deep_dive", "contact_stats", "data_files", "direction", "display", "effects", "first_per_key", "full_build", "group_chats", "group_message_count", "index_contacts",
    "json_rows", "links", "migrate", "needs_reply", "period_in_review", "query", "reactions", "read_contacts", "read_daily", "read_messages",
    "read_raw", "read_raw_jdbc", "refresh", "register", "remove_superseded", "resolve", "schema_gate", "search_contacts", "search_stored", "seasonality", "start_ingest", "start_links", "status",
    "sync", "sync_files", "time_series", "top_contacts", "with_counterparty", "write_csv", "write_json",
]
