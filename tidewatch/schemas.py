"""Closed vocabularies, tunable constants and the schemas of landed payloads."""

from __future__ import annotations

# The closed enumerations of the data model.
SOURCE_KINDS = ["rss", "github", "nvd", "hn"]
CATEGORIES = ["Security", "Product", "Pricing", "Business", "Ecosystem"]
DIMENSIONS = ["pricing", "capability", "positioning", "security", "release"]
CHANGE_KINDS = ["new", "update", "rephrase", "duplicate"]
CELL_LEVELS = ["strong", "partial", "none", "info"]
FREQUENCIES = ["immediate", "daily", "weekly"]

# Thresholds and weights of the scoring rules.
MAX_CONTENT_CHARS = 12_000
MAX_ITEMS_PER_SOURCE = 50
CURSOR_OVERLAP = "24 hours"
MAX_ENRICH_ATTEMPTS = 3
TARGET_TOKENS = 220
MAX_TOKENS = 320
OVERLAP_TOKENS = 40
TOKENS_PER_WORD = 1.3
RRF_K = 60
MAX_VECTOR_DISTANCE = 1.0
CANDIDATES_PER_LIST = 20
PASSAGES = 6
SIMILARITY_THRESHOLD = 0.92
CORROBORATION_DAYS = 7
RECENCY_HALF_LIFE_DAYS = 7.0
UNDATED_AGE_DAYS = 30.0
BRIEF_ITEMS = 8
CONFIDENCE_HALF_LIFE_DAYS = 30.0
CONFIDENCE_WEIGHTS = {"impact": 0.35, "corroboration": 0.25, "freshness": 0.25, "source": 0.15}
CONFIDENCE_HIGH = 0.62
CONFIDENCE_MEDIUM = 0.38
CORROBORATION_CAP = 3
EVIDENCE_PER_CELL = 5
SUGGESTIONS = 8
MIN_EVIDENCE_IMPACT = 3
DIGEST_ITEMS = 12
ALERT_IMPACT = 4
MIN_QUOTE_CHARS = 8
RELEVANCE_SHARE = 0.5
PAGE_SCAN_CHARS = 200_000
RATE_WINDOW_MS = 60_000
RATE_MAX_EVENTS = 20
BM25_K1 = 1.2
BM25_B = 0.75

RELEASE_PAYLOAD = """array<struct<
  id: bigint, html_url: string, tag_name: string, name: string, body: string,
  draft: boolean, prerelease: boolean, published_at: string, created_at: string,
  author: struct<login: string>>>"""

CVE_PAYLOAD = """struct<vulnerabilities: array<struct<cve: struct<
  id: string, published: string, lastModified: string,
  descriptions: array<struct<lang: string, value: string>>,
  metrics: struct<
    cvssMetricV31: array<struct<cvssData: struct<baseScore: double, baseSeverity: string>>>,
    cvssMetricV30: array<struct<cvssData: struct<baseScore: double, baseSeverity: string>>>>,
  references: array<struct<url: string>>>>>>"""

MATRIX_ASSET = """struct<focusVendor: string,
  vendors: array<struct<name: string, slug: string>>,
  axes: array<struct<id: string, label: string, description: string, categories: array<string>,
    cells: map<string, struct<level: string, note: string>>>>>"""
