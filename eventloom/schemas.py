"""Table schemas of a set of sessions, limits and vocabularies."""

from __future__ import annotations

MAX_SAFE = 9007199254740991
FORMAT_VERSION = 1
KEEP_BACKUPS = 3
SEGMENT_BYTES = 2 << 20
FANOUT = 64

SESSIONS = (
    "session_id string, format_version int, created_at long, cwd string, parent_session string, origin string, "
    "delegation_depth long, agent_preset string, revision long, next_event_counter long, seed_boundary_id string, "
    "blob_id_watermark long, root_page string, blob_map_page string, references_page string, compacted_page string, "
    "backups array<struct<root_page: string, references_page: string, blob_map_page: string, compacted_page: string, seed_boundary_id: string>>"
)
ENTRIES = "session_id string, order double, event_id string, blob_id string"
BLOBS = "session_id string, blob_id string, payload binary"
REFERENCES = "session_id string, from_event_id string, ref_name string, to_event_ids array<string>"
BINDINGS = "session_id string, event_id string, blob_id string"
USAGE = "struct<inputTokens: long, outputTokens: long, totalTokens: long, cacheReadTokens: long, cacheWriteTokens: long, reasoningTokens: long>"
COMPACTED = (
    "session_id string, ord int, compaction_id string, checkpoint_event_id string, "
    "markers struct<start_event_id: string, summary_event_id: string, end_event_id: string>, "
    "shadowed_range struct<start_id: string, end_id: string>, shadowed_ids array<string>, "
    "shadowed_seq_range struct<start: long, end: long>, shadowed_seqs array<long>, summary string, shadowed_token_count long, "
    f"provider string, model string, source_command_id string, max_tokens long, usage {USAGE}, raw_output string, llm_stream_call boolean"
)
PAGES = "page_id string, page_no long, kind string, payload binary, checksum long"
TABLES = {"sessions": SESSIONS, "entries": ENTRIES, "blobs": BLOBS, "references": REFERENCES, "bindings": BINDINGS, "compacted": COMPACTED}

#: Event types (fixed values; both sets may be replaced by arguments).
SURFACE_TYPES = ("user/message", "assistant/message", "tool/result")
KNOWN_TYPES = (
    "user/message", "assistant/message", "tool/result", "turn/start", "turn/end", "request/header", "compaction/start",
    "compaction/summary", "compaction/end", "session/end-seed", "step/start", "assistant/chunk",
)
