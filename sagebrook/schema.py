"""Schemas of the stored tables."""

from __future__ import annotations

METADATA = "struct<file_name:string,page:int,source_type:string,ocr_engine:string,ocr_used:boolean,ocr_lang:string,asset_id:bigint,chunk_order:int,char_count:int>"
PROJECTS = "project_id bigint, project_uuid string, project_name string, user_id string, created_at timestamp, updated_at timestamp"
ASSETS = "asset_id bigint, asset_uuid string, asset_type string, asset_name string, asset_size bigint, asset_config string, asset_project_id bigint, created_at timestamp, updated_at timestamp"
CHUNKS = f"chunk_id bigint, chunk_uuid string, chunk_text string, chunk_order int, chunk_project_id bigint, chunk_asset_id bigint, chunk_metadata {METADATA}, created_at timestamp, updated_at timestamp"
COLLECTION = "id bigint, text string, vector array<float>, metadata string, chunk_id bigint, embedding_size int, project_id bigint"
CHAT = "message_id bigint, message_uuid string, session_id string, project_id bigint, role string, content struct<text:string>, created_at timestamp"
LEDGER = "execution_id bigint, task_name string, task_args_hash string, task_id string, status string, task_args string, result string, started_at timestamp, completed_at timestamp, created_at timestamp, updated_at timestamp"
PROMPTS = "prompt_id bigint, project_id bigint, prompt_en string, prompt_ar string"
