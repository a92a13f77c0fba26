"""Schemas of the library's tables; nothing is inferred."""

REGIONS = (
    "doc_id long, attempt string, region_idx int, text string, conf double, x1 int, y1 int, x2 int, y2 int, "
    "engine string, cls_label string, cls_score double, label string, score double"
)
UPLOADS = "doc_id long, file_name string, n_bytes long, doc_type string, client_id string, ts timestamp"
PAGE_REQUESTS = "doc_id long, file_name string, pages string, page_count int"
PAGE_LINES = "doc_id long, page int, width int, height int, line_no int, text string, confidence double, bbox array<int>"
OUTCOMES = "doc_id long, ts timestamp, error_code string, status_code int, elapsed_sec double"
TRUTH = "doc_id string, side string, field string, want string"
#: A text line inside a page array, in the order in which reading order compares.
LINE = "struct<y1:int,x1:int,region_idx:int,text:string,conf:double,x2:int,y2:int>"
#: What a document is keyed by until one of its attempts is chosen.
KEYS = ("doc_id", "attempt")
