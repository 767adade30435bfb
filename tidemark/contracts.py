"""Column contracts: which columns a table may hold, their types and its key.

Contracts are data. The five tables of an activity export and its two legacy tables are registered
below; ``Contract(...)`` describes any other table in the same way.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import types as T


_TYPES = {
    "STRING": T.StringType(),
    "BIGINT": T.LongType(),
    "DOUBLE": T.DoubleType(),
    "BOOLEAN": T.BooleanType(),
}


@dataclass(frozen=True)
class Contract:
    """``keys`` identify a row. ``multi_class`` tables describe many classes, so their files are
    not tied to one ``class_id``. ``legacy`` tables are recognised and reported, never loaded."""

    name: str
    schema: T.StructType
    keys: tuple[str, ...] = ()
    multi_class: bool = False
    legacy: bool = False

    @classmethod
    def of(cls, name: str, columns: str, keys: Iterable[str] = (), **flags: bool) -> Contract:
        """``columns`` is a list like ``"class_id STRING, students BIGINT"``; no session is needed."""
        pairs = [column.split() for column in columns.split(",")]
        schema = T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])
        return cls(name, schema, tuple(keys), **flags)

    @property
    def names(self) -> list[str]:
        return self.schema.names


def sql_names(contract: Contract) -> str:
    """The column names as an SQL array, for expressions over long contracts."""
    return "array(" + ", ".join("'" + name.replace("'", "\\'") + "'" for name in contract.names) + ")"


# Column names, order, types and keys of the export format.
MANIFEST = Contract.of(
    "manifest",
    """
    class_id STRING, department STRING, type STRING, institution_funding STRING,
    institution_level STRING, institution_tier_number BIGINT, institution_tier_name STRING,
    state STRING, lms STRING, course STRING, version STRING, book STRING, experiment STRING,
    status STRING, students BIGINT, n_opted_out BIGINT, class_type STRING,
    has_supplementary_materials STRING, date_created STRING, first_response STRING,
    last_response STRING, completed_at STRING, instructor_id STRING, institution_id STRING,
    school_district_id BIGINT
    """,
    keys=["class_id"],
    multi_class=True,
)

CLASSES = Contract.of(
    "classes",
    """
    institution_id STRING, class_id STRING, course_name STRING, release STRING, book STRING,
    teacher_id STRING, lms STRING, setup_yaml STRING
    """,
    keys=["class_id"],
    multi_class=True,
)

RESPONSES = Contract.of(
    "responses",
    """
    institution_id STRING, class_id STRING, course_name STRING, release STRING, book STRING,
    branch STRING, student_id STRING, lms_id STRING, item_id STRING, item_type STRING,
    chapter STRING, page STRING, response STRING, prompt STRING, points_possible BIGINT,
    points_earned BIGINT, dt_submitted STRING, completes_page BOOLEAN, attempt BIGINT,
    user_agent STRING, lrn_session_id STRING, lrn_response_id STRING,
    lrn_activity_reference STRING, lrn_question_reference STRING, lrn_question_position BIGINT,
    lrn_type STRING, lrn_dt_started STRING, lrn_dt_saved STRING, lrn_status STRING,
    lrn_response_json STRING, lrn_option_0 STRING, lrn_option_1 STRING, lrn_option_2 STRING,
    lrn_option_3 STRING, lrn_option_4 STRING, lrn_option_5 STRING, lrn_option_6 STRING,
    lrn_option_7 STRING, lrn_option_8 STRING, lrn_option_9 STRING, lrn_option_10 STRING,
    lrn_option_11 STRING, lrn_items_api_version STRING, lrn_response_api_version STRING
    """,
    keys=["student_id", "item_id", "lrn_question_position", "dt_submitted"],
)

MEDIA_VIEWS = Contract.of(
    "media_views",
    """
    institution_id STRING, class_id STRING, student_id STRING, chapter STRING, page STRING,
    type STRING, media_id STRING, dt_started STRING, dt_last_event STRING, access_count BIGINT,
    proportion_video DOUBLE, proportion_time DOUBLE, log_json STRING
    """,
    keys=["class_id", "student_id", "chapter", "page", "media_id"],
)

PAGE_VIEWS = Contract.of(
    "page_views",
    """
    institution_id STRING, class_id STRING, student_id STRING, chapter STRING, page STRING,
    dt_accessed STRING, tried_again_dt STRING, tried_again_clicks BIGINT, was_complete BOOLEAN,
    engaged BIGINT, idle_brief BIGINT, idle_long BIGINT, off_page_brief BIGINT,
    off_page_long BIGINT, trace STRING
    """,
    keys=["class_id", "student_id", "chapter", "page", "dt_accessed"],
)

TAGS = Contract.of("tags", "tag_type STRING, tag STRING, item_id STRING", legacy=True)

ITEMS = Contract.of(
    "items",
    """
    institution_id STRING, class_id STRING, item_id STRING, learnosity_id STRING,
    item_type STRING, chapter STRING, page STRING, dcl_pre_exercise_code STRING,
    dcl_sample_code STRING, dcl_solution STRING, dcl_sct STRING, dcl_hint STRING,
    lrn_activity_reference STRING, learnosity_question_reference STRING,
    learnosity_question_position STRING, learnosity_question_type STRING,
    learnosity_template_name STRING, learnosity_template_reference STRING,
    learnosity_item_status STRING, learnosity_question_data STRING
    """,
    legacy=True,
)

#: Formats a data file may have, and the directory name that holds opaque attachments.
FORMATS = ("csv", "parquet")
ATTACHMENTS = "supplementary"

EXPORT_CONTRACTS: tuple[Contract, ...] = (
    MANIFEST,
    CLASSES,
    RESPONSES,
    MEDIA_VIEWS,
    PAGE_VIEWS,
    TAGS,
    ITEMS,
)
