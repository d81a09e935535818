"""Column types of the two tables and of the JSON documents around them, as DDL for ``reader.schema``."""

WORKS = (
    "work_id STRING, slug STRING, title STRING, author STRING, description STRING, genres STRING, tags STRING, "
    "status STRING, publish_status STRING, source_url STRING, editorial_review STRING, character_analysis STRING, "
    "faq STRING, cover_image STRING, created_at TIMESTAMP, updated_at TIMESTAMP"
)
SECTIONS = (
    "section_id STRING, work_id STRING, number INT, title STRING, content STRING, word_count INT, summary STRING, "
    "highlight STRING, next_preview STRING, audio_url STRING, publish_status STRING, created_at TIMESTAMP, "
    "updated_at TIMESTAMP"
)
SECTION_JSON = (
    "number INT, title STRING, content STRING, summary STRING, highlight STRING, next_preview STRING, "
    "_corrupt_record STRING"
)
URL_LIST = "stories ARRAY<STRUCT<url: STRING>>"
WATCH_STATE = (
    "url STRING, title STRING, source STRING, known_sections INT, last_number INT, last_checked TIMESTAMP, "
    "added_at TIMESTAMP, new_numbers ARRAY<INT>"
)
