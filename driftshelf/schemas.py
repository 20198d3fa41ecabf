"""Table layouts. Prices and ratings in an observation stay as cleaned text until
the content hash is taken (the hash is over the text); state tables hold decimals."""

from __future__ import annotations

IMAGE = "struct<url:string,high_resolution_url:string,type:string>"
SPECIFICATION = "struct<section:string,name:string,value:string>"
REVIEW = (
    "struct<external_id:string,reviewer_name:string,review_date:date,rating:string,"
    "title:string,text:string,verified_purchase:boolean>"
)
RELATION = (
    "struct<type:string,external_id:string,name:string,url:string,sku:string,"
    "price:string,currency:string>"
)
VARIANT = "struct<name:string,value:string,sku:string,url:string,price:string,availability:string>"

RECORD_FIELDS = {
    "external_id": "string", "canonical_url": "string", "title": "string",
    "description": "string", "brand": "string", "model_number": "string", "sku": "string",
    "current_price": "string", "original_price": "string", "currency": "string",
    "availability": "string", "category": "string", "subcategory": "string",
    "highlights": "array<string>", "whats_in_the_box": "array<string>",
    "rating": "string", "review_count": "int",
    "images": f"array<{IMAGE}>", "specifications": f"array<{SPECIFICATION}>",
    "reviews": f"array<{REVIEW}>", "relations": f"array<{RELATION}>",
    "variants": f"array<{VARIANT}>", "raw_data": "string",
}
RUN_FIELDS = {"site_id": "bigint", "run_id": "bigint", "run_ts": "timestamp", "item_seq": "bigint"}


def ddl(fields: dict[str, str]) -> str:
    return ", ".join(f"{name} {kind}" for name, kind in fields.items())


SITES = {
    "site_id": "bigint", "code": "string", "name": "string", "base_url": "string",
    "adapter": "string", "enabled": "boolean", "settings": "string",
    "created_at": "timestamp", "updated_at": "timestamp",
}
RUNS = {
    "run_id": "bigint", "site_id": "bigint", "run_no": "bigint", "run_ts": "timestamp",
    "run_type": "string", "status": "string", "limited": "boolean", "missing_threshold": "int",
}
OBSERVATIONS = {**RUN_FIELDS, **RECORD_FIELDS}

KEY = ["site_id", "canonical_url"]
PRODUCTS = {
    "site_id": "bigint", "canonical_url": "string", "external_id": "string", "title": "string",
    "description": "string", "brand": "string", "model_number": "string", "sku": "string",
    "current_price": "decimal(14,2)", "original_price": "decimal(14,2)", "currency": "string",
    "availability": "string", "category": "string", "subcategory": "string",
    "highlights": "array<string>", "whats_in_the_box": "array<string>",
    "rating": "decimal(4,2)", "review_count": "int", "content_hash": "string", "hash_version": "string",
    "raw_data": "string", "first_seen_at": "timestamp", "last_seen_at": "timestamp",
    "last_scraped_at": "timestamp", "unavailable_since": "timestamp",
    "consecutive_missing_runs": "int", "created_at": "timestamp", "updated_at": "timestamp",
}
IMAGES = {
    "site_id": "bigint", "canonical_url": "string", "image_url": "string",
    "high_resolution_url": "string", "image_type": "string", "display_order": "int",
    "content_hash": "string", "first_seen_at": "timestamp", "last_seen_at": "timestamp",
}
SPECIFICATIONS = {
    "site_id": "bigint", "canonical_url": "string", "section": "string", "spec_name": "string",
    "spec_value": "string", "first_seen_at": "timestamp", "last_seen_at": "timestamp",
}
REVIEWS = {
    "site_id": "bigint", "canonical_url": "string", "external_review_id": "string",
    "reviewer_name": "string", "review_date": "date", "rating": "decimal(3,2)",
    "review_title": "string", "review_text": "string", "verified_purchase": "boolean",
    "review_hash": "string", "first_seen_at": "timestamp", "last_seen_at": "timestamp",
}
RELATIONS = {
    "site_id": "bigint", "canonical_url": "string", "relation_type": "string",
    "related_external_id": "string", "related_name": "string", "related_url": "string",
    "related_sku": "string", "related_price": "decimal(14,2)", "currency": "string",
    "first_seen_at": "timestamp", "last_seen_at": "timestamp",
}
VARIANTS = {
    "site_id": "bigint", "canonical_url": "string", "variant_name": "string",
    "variant_value": "string", "variant_sku": "string", "variant_url": "string",
    "price": "decimal(14,2)", "availability": "string",
    "first_seen_at": "timestamp", "last_seen_at": "timestamp",
}
PRICE_HISTORY = {
    "site_id": "bigint", "canonical_url": "string", "run_id": "bigint",
    "old_price": "decimal(14,2)", "new_price": "decimal(14,2)", "currency": "string",
    "changed_at": "timestamp",
}
AVAILABILITY_HISTORY = {
    "site_id": "bigint", "canonical_url": "string", "run_id": "bigint",
    "old_status": "string", "new_status": "string", "changed_at": "timestamp",
}
RUN_ITEMS = {
    "run_id": "bigint", "url": "string", "item_seq": "bigint", "external_id": "string",
    "status": "string", "attempts": "int", "error_type": "string", "error_message": "string",
    "result": "string", "started_at": "timestamp", "completed_at": "timestamp",
    "updated_at": "timestamp",
}
FAILED_URLS = {
    "site_id": "bigint", "run_id": "bigint", "url": "string", "error_type": "string",
    "error_message": "string", "retry_count": "int", "last_retry_at": "timestamp",
    "updated_at": "timestamp",
}
RUN_ROWS = {
    "site_id": "bigint", "run_id": "bigint", "run_type": "string", "status": "string",
    "run_ts": "timestamp", "products_discovered": "bigint", "products_processed": "bigint",
    "products_new": "bigint", "products_updated": "bigint", "products_unchanged": "bigint",
    "products_unavailable": "bigint", "errors": "bigint", "last_item_seq": "bigint",
    "checkpoint": "string", "summary": "string", "completed_at": "timestamp",
}
MERGED_EXTRA = {
    "run_id": "bigint", "change_status": "string", "was_stored": "boolean",
    "old_hash": "string", "old_version": "string", "old_price": "decimal(14,2)", "old_availability": "string",
    "missed": "boolean",
}
