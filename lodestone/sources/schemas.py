"""Tables of the engine as Spark schemas, with their keys."""

from __future__ import annotations

CRAWL_JOB = (
    "id string, seed_url string, root_host string, max_pages int, max_depth int, same_host_only boolean, respect_robots boolean, requests_per_second double, "
    "status string, pages_crawled int, pages_failed int, created_at timestamp, started_at timestamp, completed_at timestamp, updated_at timestamp, error_message string"
)
CRAWL_FRONTIER = (
    "id bigint, job_id string, canonical_url string, depth int, status string, attempts int, next_attempt_at timestamp, discovered_from string, last_error string, "
    "created_at timestamp, updated_at timestamp"
)
CRAWLED_PAGE = (
    "id string, job_id string, url string, depth int, status_code int, content_type string, title string, body_sha256 string, extracted_text string, outbound_links int, fetched_at timestamp"
)
CAREER_SCAN = "job_id string, careers_url string, created_at timestamp"
JOB_POSTING = (
    "id string, scan_id string, page_id string, source_url string, title string, company string, location string, skills array<string>, experience string, employment_type string, "
    "description string, extraction_method string, discovered_at timestamp"
)
UNIQUE = {"crawl_frontier": ("job_id", "canonical_url"), "crawled_page": ("job_id", "url"), "job_posting": ("scan_id", "source_url")}
LIMITS = {"url": 2048, "title": 1000, "error_message": 2000, "extracted_text": 50_000}
