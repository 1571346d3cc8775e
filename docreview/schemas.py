"""Schemas of the tables that cross a stage boundary."""

PAIR_DDL = "project string, bidder string, item_id string"

LINES = (
    "project string, bidder string, file_no int, file string, line_no int, page int, text string"
)
PARAGRAPHS = (
    "project string, bidder string, file_no int, file string, line_no int, kind string, "
    "style string, text string"
)
SECTIONS = (
    "project string, bidder string, id string, file string, item_guid string, "
    "path array<string>, level int, page int, text string, char_len int, file_no int, seq int"
)
SECTION_FIELDS = ["id", "file", "item_guid", "path", "level", "page", "text", "char_len"]
TIERS = "array<struct<tier:string,min:double,max:double>>"
ITEMS = (
    "project string, item_no int, item_id string, guid string, name string, max_score double, "
    f"criteria string, aspects array<string>, synonyms array<string>, tiers {TIERS}"
)
POINTS = (
    "project string, cat_no int, cat string, point_no int, point_id string, name string, "
    "phrases array<string>, terms array<string>"
)
PICK = (
    "struct<section_id:string,file:string,path:array<string>,unit:array<string>,page:int,"
    "match_score:double,hit:array<string>,chars:int,truncated:boolean>"
)
PACKAGES = (
    f"{PAIR_DDL}, item_guid string, name string, candidates bigint, units bigint, "
    "fallback boolean, evidence_chars bigint, budget int, pool_sections bigint, "
    f"picked array<{PICK}>"
)
PERF = "struct<in_tokens:bigint,out_tokens:bigint,latency_ms:bigint>"
SAMPLING = "struct<n:int,scores:array<double>,tiers:array<string>,agreement:double>"
REVIEWS = (
    f"{PAIR_DDL}, item_guid string, status string, tier string, score double, "
    "miss_reason string, cite array<int>, reason string, confidence double, attempts int, "
    f"last_error string, sampling {SAMPLING}, perf {PERF}"
)
ATTEMPTS = (
    f"{PAIR_DDL}, sample_no int, attempt_no int, content string, error string, "
    "in_tokens bigint, out_tokens bigint, latency_ms bigint"
)
EXPERT = (
    f"{PAIR_DDL}, action string, system_score double, expert_score double, delta double, "
    "note string, reviewed_at string, pos bigint"
)
EVENTS = (
    "seq bigint, ts timestamp, type string, project string, bidder string, item_id string, "
    "stage string, status string, action string, attempt int, max_attempts int, score double, "
    "tier string, miss_reason string, confidence double, attempts int, last_error string, "
    "in_tokens bigint, out_tokens bigint, latency_ms bigint, message string"
)
