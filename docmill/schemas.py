"""Schemas of stored tables (fixed values)."""

from __future__ import annotations

REGISTRY = "document_id string, category string, file_name string, title string, file_path string, relative_path string, pages int, file_size_bytes long, file_size_mb double, checksum_sha256 string, status string, created_at timestamp, modified_at timestamp, error_message string, is_duplicate_of string"
PARSED = "document_id string, document_name string, category string, pages array<struct<page:int,page_number:int,text:string>>"
CHUNK = "chunk_id string, document_id string, document_name string, page int, page_number int, category string, chunk_index int, text string, chunk_text string, char_count int, token_estimate int, file_path string, source string, metadata map<string,string>"
GOLDEN_OUT = ("query", "expected_answer", "source_document", "page_number", "category", "citation", "difficulty", "tags", "notes", "row_number", "status", "query_length", "answer_length")
