"""Tables of an archive and the values their columns may take."""

KINDS = ("file", "web", "chat", "text")
PURPOSES = ("memory", "reference")
AUTHORSHIPS = ("user", "other", "mixed", "unknown")
SCOPES = ("personal", "sourced", "fictional", "unknown")
PROVENANCES = ("explicit", "platform", "filename", "inferred", "unknown")
MODES = ("moment", "change", "relationship", "pattern", "quote")
JOB_STATES = ("pending", "running", "completed", "failed")
VERSION = 4

SOURCES = (
    "id string, kind string, origin string, original_path string, title string, object_hash string, imported_at timestamp, "
    "deleted_at timestamp, purpose string, authorship string, occurred_at string, occurred_end string, event_time_provenance string, "
    "published_at string, modified_at string, observed_at timestamp, author string, speaker string, subject string, content_scope string, "
    "external_id string, connection_id string, is_current boolean, superseded_at timestamp"
)
OBJECTS = "hash string, content string, created_at timestamp"
CHUNKS = "id string, object_hash string, ordinal int, start_line int, end_line int, content string, heading_path array<string>, occurred_at string"
POSTINGS = "chunk_id string, token string, in_heading boolean, in_body boolean, dl int, bucket int"
TOTALS = "n bigint, tokens bigint"
JOBS = "job_id string, connection_id string, state string, error string, completed int, total int, imported int, unchanged int, skipped int, created_at timestamp, updated_at timestamp"
CONNECTIONS = "connection_id string, input string, kind string, purpose string, authorship string, content_scope string, crawl_scope string, created_at timestamp, last_synced_at timestamp"

#: What an import takes; everything but kind, origin, title and content may be NULL.
DOCUMENTS = (
    "kind string, origin string, title string, content string, original_path string, purpose string, authorship string, occurred_at string, "
    "occurred_end string, event_time_provenance string, published_at string, modified_at string, observed_at timestamp, author string, "
    "speaker string, subject string, content_scope string, external_id string, connection_id string"
)


def check(name: str, value: str | None, allowed: tuple[str, ...]) -> str | None:
    if value is not None and value not in allowed:
        raise ValueError(f"{name} must be one of {', '.join(allowed)}")
    return value
