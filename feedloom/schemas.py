"""Table schemas, value domains and keys of the curation model."""

from __future__ import annotations

FEED_ITEM = """
    source_name string, source_url string, external_id string, url string, title string,
    author string, published_at timestamp, content string, raw_payload map<string,string>,
    pos int, landed_seq string
"""
FEED_COLUMNS = (
    "source_name source_url external_id url title author published_at content raw_payload pos landed_seq"
).split()

# Append-only logs. Ids are hashes of the natural key, so a replay gives the same rows.
TABLES = {
    "sources": "id string, type string, name string, url string, enabled boolean, updated_at timestamp",
    "raw_items": """
        id string, source_id string, external_id string, url string, title string, author string,
        published_at timestamp, raw_content string, raw_payload map<string,string>,
        content_hash string, created boolean, pos int, landed_seq string, created_at timestamp
        """,
    "items": """
        id string, raw_item_id string, canonical_url string, title string, content string,
        language string, normalized_hash string, dedupe_group_id string, created_at timestamp,
        is_duplicate boolean
        """,
    "dedupe_groups": "id string, representative_item_id string, reason string, created_at timestamp",
    "analysis_results": """
        id string, item_id string, model_name string, summary string, topics array<string>,
        tags array<string>, importance_score decimal(4,3), novelty_score decimal(4,3),
        recommended_action string, reason string, raw_output string, created_at timestamp
        """,
    "messages": "id string, recipient string, card string, created_at timestamp",
    "push_events": """
        id string, item_id string, channel string, recipient string, message_id string,
        status string, sent_at timestamp, last_error string, created_at timestamp
        """,
    "feedback": """
        id string, item_id string, push_event_id string, user_id string, action string,
        metadata string, created_at timestamp
        """,
    "notes": """
        id string, item_id string, path string, markdown string, status string, updated_at timestamp
        """,
    "rejects": "stage string, key string, reason string, detail string, created_at timestamp",
    # Parsed feed items that wait for the one writer that turns them into raw items and items.
    "entries": FEED_ITEM,
    # The first raw item that had a URL or a content, and its group.
    "group_keys": """
        key string, group_id string, raw_item_id string, created_at timestamp, landed_seq string,
        source_id string, pos int
        """,
    # The shingles that items have brought, for the novelty of later ones.
    "novelty_keys": "key string",
    # Who wants to retry an item until when, and who may.
    "leases": "item_id string, leased_at timestamp, leased_until timestamp",
    "granted": "item_id string, leased_at timestamp",
    # Per digest: the items in its band that nobody was sent yet, what the next digest starts from.
    "open_items": """
        id string, created_at timestamp, importance_score decimal(4,3), analyzed_at timestamp, analysis_id string
        """,
    # What the client said to each message of a batch, written before anything is logged.
    "answers": "id string, message_id string, error string",
    "batch_times": "batch_at timestamp",
    # The batches of other writers that a batch may read, fixed on its first run.
    "batch_views": "seen_writer string, seen_batch bigint",
    "batch_done": "done_at timestamp",
}
TABLE_COLUMNS = {
    name: [part.split()[0] for part in ddl.replace("map<string,string>", "map").replace("(4,3)", "").split(",")]
    for name, ddl in TABLES.items()
}

# Allowed values per column.
DOMAINS = {
    ("sources", "type"): ["rss", "website", "api", "manual"],
    ("dedupe_groups", "reason"): ["canonical_url", "content_hash", "simhash", "semantic"],
    ("items", "status"): ["new", "analyzing", "ready", "pushed", "archived", "ignored"],
    ("push_events", "status"): ["pending", "sent", "failed"],
    ("feedback", "action"): ["useful", "not_useful", "read_later", "save_obsidian", "wrong_tag"],
    ("notes", "status"): ["pending", "written", "failed"],
}
FEEDBACK_ACTIONS = DOMAINS[("feedback", "action")]
NOTE_ACTION = "save_obsidian"
CHANNEL = "feishu"

UNIQUE_KEYS = [
    ("sources", ["url"]),
    ("raw_items", ["source_id", "external_id"]),
    ("raw_items", ["source_id", "url"]),
    ("items", ["raw_item_id"]),
    ("items", ["canonical_url"]),
    ("notes", ["item_id"]),
]
FOREIGN_KEYS = [
    ("raw_items", "source_id", "sources", "id"),
    ("items", "raw_item_id", "raw_items", "id"),
    ("items", "dedupe_group_id", "dedupe_groups", "id"),
    ("dedupe_groups", "representative_item_id", "items", "id"),
    ("analysis_results", "item_id", "items", "id"),
    ("push_events", "item_id", "items", "id"),
    ("feedback", "item_id", "items", "id"),
    ("feedback", "push_event_id", "push_events", "id"),
    ("notes", "item_id", "items", "id"),
]
