from .flows import EditRules, TableRules, rules_from_edits, rules_from_snapshots

__all__ = ["EditRules", "TableRules", "rules_from_edits", "rules_from_snapshots"]
