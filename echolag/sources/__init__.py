from .edits import read_edits
from .mined import (
    read_list_map,
    read_map,
    read_occurrence_json,
    read_rules,
    read_rules_csv,
    read_timepoints_json,
    write_list_map,
    write_map,
    write_merged_rules,
    write_occurrence_json,
    write_report,
    write_rules,
    write_rules_csv,
    write_scores,
    write_timepoints_json,
)
from .tables import (
    bad_snapshots,
    read_change_csv,
    read_change_log,
    read_download_log,
    read_entity_changes_csv,
    read_entity_events_csv,
    read_snapshots,
    read_table_list,
    read_versions,
    write_change_csv,
    write_change_log,
    write_download_log,
    write_entity_changes_csv,
    write_entity_events_csv,
    write_new_tables,
    write_snapshots,
    write_versions,
)

__all__ = [
    "bad_snapshots",
    "read_change_csv",
    "read_change_log",
    "read_download_log",
    "read_edits",
    "read_entity_changes_csv",
    "read_entity_events_csv",
    "read_list_map",
    "read_map",
    "read_occurrence_json",
    "read_rules",
    "read_rules_csv",
    "read_snapshots",
    "read_table_list",
    "read_timepoints_json",
    "read_versions",
    "write_change_csv",
    "write_change_log",
    "write_download_log",
    "write_entity_changes_csv",
    "write_entity_events_csv",
    "write_list_map",
    "write_map",
    "write_merged_rules",
    "write_new_tables",
    "write_occurrence_json",
    "write_report",
    "write_rules",
    "write_rules_csv",
    "write_scores",
    "write_snapshots",
    "write_timepoints_json",
    "write_versions",
]
