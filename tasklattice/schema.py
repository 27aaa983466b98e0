"""Schemas of issues, sprints and graphs, and the closed word lists of the model."""

from pyspark.sql import types as T

# Fixed values of the data model.
STATUSES = ("open", "in_progress", "blocked", "deferred", "pinned", "hooked", "review", "closed", "tombstone")
CLOSED_LIKE = ("closed", "tombstone")
ISSUE_TYPES = ("bug", "feature", "task", "epic", "chore")
DEPENDENCY_TYPES = ("blocks", "related", "parent-child", "discovered-from")
TYPE_ORDER = {"epic": 0, "feature": 1, "task": 2, "bug": 3, "chore": 4}
STATUS_ORDER = {"open": 0, "in_progress": 1, "blocked": 2, "closed": 3, "tombstone": 4}
OTHER_ORDER = 5

_TYPES = {
    "string": T.StringType(), "bigint": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "timestamp": T.TimestampType(),
    "array<string>": T.ArrayType(T.StringType()), "array<array<int>>": T.ArrayType(T.ArrayType(T.IntegerType())),
}


def _struct(fields: str) -> T.StructType:
    """From 'name type, ...'; needs no session."""
    pairs = [x.strip().split(" ") for x in fields.split(", ")]
    return T.StructType([T.StructField(n, _TYPES[t]) for n, t in pairs])


DEPENDENCY = _struct("issue_id string, depends_on_id string, type string, created_at timestamp, created_by string")
COMMENT = _struct("id bigint, issue_id string, author string, text string, created_at timestamp")
ISSUE = (
    _struct(
        "id string, title string, description string, design string, acceptance_criteria string, notes string, status string, "
        "priority int, issue_type string, assignee string, estimated_minutes int, created_at timestamp, updated_at timestamp, "
        "due_date timestamp, closed_at timestamp, external_ref string, compaction_level int, compacted_at timestamp, "
        "compacted_at_commit string, original_size int, labels array<string>, source_repo string"
    )
    .add("dependencies", T.ArrayType(DEPENDENCY))
    .add("comments", T.ArrayType(COMMENT))
)
#: Fields whose missing value is the empty string, or 0.
BLANK_TEXT = ("id", "title", "description", "design", "acceptance_criteria", "notes", "status", "issue_type", "assignee", "source_repo")
ZERO_INT = ("priority", "compaction_level", "original_size")

SPRINT = _struct("id string, name string, start_date timestamp, end_date timestamp, bead_ids array<string>, velocity_target double, created_at timestamp, updated_at timestamp")
GRAPH = _struct("description string, nodes array<string>, edges array<array<int>>")
FORECAST = _struct("issue_id string, estimated_date timestamp, confidence double, velocity_based boolean")
BURNDOWN = _struct("date timestamp, remaining int, completed int")
