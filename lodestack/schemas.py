"""Explicit schemas of the engine's tables."""

from __future__ import annotations

BLOCK = "struct<type:string,text:string,rows:array<array<string>>>"
PAGE = f"page_id string, space_key string, title string, status string, url string, last_updated string, version int, content_html string, content_text string, content_blocks array<{BLOCK}>, internal_links array<string>, synced_at string"
SPARSE = "struct<indices:array<int>,values:array<float>>"
CHUNK = f"id string, page_id string, title string, url string, parent_index int, child_index int, parent_text string, chunk string, linked_page_ids array<string>, has_table boolean, dense array<float>, sparse {SPARSE}"
POSTING = "id string, term int, weight float"
FEEDBACK = "feedback_id string, question string, answer string, feedback_type string, sources array<struct<title:string,url:string>>, user_id string, comment string, created_at timestamp"
EDGE = "src string, dst string, kind string"
EVENT = "query_id string, seq int, type string, sources array<struct<title:string,url:string>>, token string"
