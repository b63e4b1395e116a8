"""Explicit schemas of the engine's tables; production reads never infer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REFERENCE = "array<struct<type:string,label:string,chapter:string,pages:string,note:string>>"
TABLES = {
    "questions": """id string, subject string, level string, topic string, subtopic string, paper_type string, command_term string, marks int, difficulty int,
        question string, figure string, answer string, explanation string, source string, tags array<string>, authored_by string, created_at timestamp,
        knowledge_point_ids array<string>, answer_figure string, question_image string, answer_image string, figure_image string, definition_basis string,
        book_id string, book_section string, book_page int, in_book_order int, source_type string, category string, review_status string,
        well_down int, well_down_at timestamp, well_down_note string""",
    "books": "id string, subject string, title string, publisher string, edition string, has_answers int, answer_source string, cover_path string, total_questions int, created_at timestamp",
    "progress": "question_id string, status string, attempts int, correct_count int, wrong_count int, last_result string, last_seen timestamp, mastery_level int, completed_at timestamp",
    "wrong_notebook": "question_id string, added_at timestamp, last_wrong_at timestamp, times_wrong int, mastered int, note string, srs_level int, next_review_at timestamp",
    "knowledge_points": f"id string, subject string, code string, theme string, title string, description string, refs {REFERENCE}",
    "collections": "id string, name string", "collection_items": "collection_id string, question_id string, seq bigint",
    "question_notes": "question_id string, note string, updated_at timestamp",
    "paper_templates": "id string, subject string, paper_type string, name string, duration_min int, total_marks int, calculator int, num_questions int, question_mode string, description string, sort_order int",
    "exam_papers": "id string, name string, subject string, paper_type string, total_marks int, created_at timestamp",
    "exam_paper_items": "exam_id string, question_id string, position int, marks int",
    "question_usage": "id string, question_id string, usage_type string, ref_id string, used_at timestamp",
    "reports": "id string, question_id string, reason string, detail string, page_ref string, status string, created_at timestamp, resolved_at timestamp, resolved_note string",
}
DEFAULTS = {"questions": {"authored_by": "ai", "in_book_order": 0, "source_type": "paper", "category": "past", "review_status": "new", "well_down": 0}}


def empty(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], TABLES[name])


def conform(df: DataFrame, name: str) -> DataFrame:
    """The table's columns in its types and order; missing ones take their default, unparsable numbers become null."""
    types = {f.name: f.dataType for f in empty(df.sparkSession, name).schema.fields}
    out = []
    for c, t in types.items():
        default = F.lit(DEFAULTS.get(name, {}).get(c))
        simple = t.simpleString() in ("int", "bigint", "timestamp")
        col = (F.col(c).try_cast(t) if simple else F.col(c).cast(t)) if c in df.columns else default.cast(t)
        out.append(F.coalesce(col, default.cast(t)).alias(c) if DEFAULTS.get(name, {}).get(c) is not None and c in df.columns else col.alias(c))
    return df.select(*out)
