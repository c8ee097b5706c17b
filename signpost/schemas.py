"""Interchange schemas: fixed column order, text columns, empty string for missing."""

from __future__ import annotations

from pyspark.sql.types import (
    ArrayType, IntegerType, StringType, StructField, StructType,
)

# -- fixed values: names and order of the columns of every interchange table --
SERVICE_RECORD_REQUIRED = ("record_id", "service_name", "category_id", "category_label")
SERVICE_RECORD_FIELDS = (
    *SERVICE_RECORD_REQUIRED,
    "student_need", "intended_users", "access_method", "recommended_next_step", "limitations",
    "official_source_url", "source_name", "source_publisher", "source_license_or_terms",
    "source_retrieved_at", "source_record_id", "last_verified_date", "review_status",
)
REGISTRY_FIELDS = (
    "source_id", "organization", "url", "category", "authority_level", "own_organisation",
    "scope_status", "extraction_method", "mentioned_in", "rationale",
)
INVENTORY_FIELDS = (*REGISTRY_FIELDS, "execution_status", "evidence_location")
CANDIDATE_FIELDS = (
    "record_id", "source_id", "organization", "category", "authority_level", "own_organisation",
    "service_name", "record_type", "section", "source_page_title", "source_url", "service_url",
    "student_types", "eligibility_notes", "location", "language", "delivery_format",
    "contact_method", "recommended_next_step", "safety_notes", "source_last_updated",
    "retrieved_at", "requires_human_review", "review_status", "content_hash",
)
CANDIDATE_BLANKS = (
    "student_types", "eligibility_notes", "location", "language", "delivery_format",
    "contact_method", "recommended_next_step", "safety_notes",
)
GUIDANCE_FIELDS = (
    "record_id", "category", "record_type", "action_title", "section", "source_page_title",
    "source_page_url", "linked_resource_title", "linked_resource_url", "linked_resource_agency",
    "deep_parsed", "source_last_updated", "retrieved_at", "requires_human_review",
    "source_content_hash", "record_content_hash",
)
REVIEW_FIELDS = (
    "record_id", "category", "action_title", "source_page_url", "linked_resource_url",
    "eligibility", "delivery_format", "plain_language_summary", "safety_notes", "reviewer",
    "approval_status", "reviewed_at",
)
FACILITY_SOURCE_FIELDS = (
    "index", "facility_name", "source_facility_type", "odhf_facility_type", "provider", "unit",
    "street_no", "street_name", "postal_code", "city", "province", "source_format_str_address",
    "CSDname", "CSDuid", "Pruid", "latitude", "longitude",
)
FACILITY_FIELDS = (
    "facility_id", "facility_name", "source_facility_type", "normalized_facility_type", "provider",
    "unit", "street_no", "street_name", "postal_code", "city", "province",
    "source_formatted_address", "csd_name", "csd_uid", "province_uid", "latitude", "longitude",
    "source_url", "retrieved_at", "record_content_hash",
)
PARTNER_LISTING_FIELDS = (
    "name", "detail_url", "listing_address", "listing_languages", "map_url", "listing_website",
)
PARTNER_FIELDS = (
    *PARTNER_LISTING_FIELDS,
    "services", "regular_staff_languages", "casual_volunteer_languages", "reduced_mobility_access",
    "daycare", "contact_hours", "phone", "email", "website", "address", "holiday_period",
    "territory_covered", "administrative_region", "municipality", "source_last_updated",
)
SERVICE_SPEC_FIELDS = (
    "service_id", "service_name", "category", "source_url", "intended_users", "delivery_context",
    "recommended_next_step", "next_step_url", "limitation",
)
USEFUL_RECORD_FIELDS = (
    "service_id", "service_name", "category", "intended_users", "service_description",
    "delivery_context", "contact_or_access_methods", "recommended_next_step", "next_step_url",
    "source_url", "source_evidence_excerpt", "source_http_status", "next_step_http_status",
    "last_verified_date", "limitation", "review_status", "content_hash",
)
PROVENANCE_FIELDS = (
    "source_name", "source_publisher", "source_url", "source_license_or_terms",
    "source_retrieved_at", "source_record_id", "last_verified_date",
)


def text_schema(fields, required=()) -> StructType:
    """All-text schema in the given order."""
    return StructType([StructField(f, StringType(), f not in required) for f in fields])


SERVICE_RECORDS = text_schema(SERVICE_RECORD_FIELDS, SERVICE_RECORD_REQUIRED)

# One element of a page. ``seq`` is its position in document order and its index in the page's
# node array; its descendants are seq+1 .. end_seq. Its text is a range of the page's pieces of text.
NODE = StructType([
    StructField("seq", IntegerType(), False),
    StructField("end_seq", IntegerType(), False),
    StructField("parent_seq", IntegerType(), False),
    StructField("tag", StringType(), False),
    StructField("id", StringType()),
    StructField("classes", ArrayType(StringType())),
    StructField("role", StringType()),
    StructField("href", StringType()),
    StructField("href_abs", StringType()),
    StructField("piece_from", IntegerType(), False),
    StructField("pieces", IntegerType(), False),
    StructField("text_len", IntegerType(), False),
    StructField("raw_from", IntegerType(), False),
    StructField("raw_pieces", IntegerType(), False),
])
PARSED = StructType([
    StructField("text", StringType()),
    StructField("text_pieces", ArrayType(StringType(), False)),
    StructField("raw_pieces", ArrayType(StringType(), False)),
    StructField("nodes", ArrayType(NODE, False)),
    StructField("parse_error", StringType()),
    StructField("html_bytes", IntegerType()),
])
