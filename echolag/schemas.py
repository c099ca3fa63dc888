"""Column layouts of the tables that operators exchange."""

SNAPSHOT_JSON = (
    "id STRING, attributes ARRAY<STRUCT<id: STRING>>, rows ARRAY<STRUCT<id: STRING, fields: ARRAY<VARIANT>>>"
)
SNAPSHOTS = (
    "snapshot_date DATE, table_id STRING, attributes ARRAY<STRING>, "
    "rows ARRAY<STRUCT<id: STRING, fields: ARRAY<STRING>>>"
)
FIELD_CHANGES = "date DATE, change_type STRING, table_id STRING, column_id STRING, row_id STRING"
ENTITY_EVENTS = "date DATE, level STRING, change_type STRING, table_id STRING, item_id STRING"
ENTITY_CHANGES = "date DATE, level STRING, change_type STRING, table_id STRING, column_id STRING, row_id STRING"
EDITS_JSON = (
    "template STRING, validFrom STRING, type STRING, key STRING, pageID STRING, pageTitle STRING, "
    "changes ARRAY<STRUCT<property: STRUCT<name: STRING>, previousValue: STRING, currentValue: STRING>>"
)
RULES = "antecedent STRING, consequent STRING, support BIGINT, confidence DOUBLE, lift DOUBLE, hist ARRAY<INT>"
WHITELIST = "category STRING, template STRING"

LEVELS = ("table", "column", "row", "field")
CHANGE_TYPES = ("insert", "delete", "update")
