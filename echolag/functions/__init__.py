from .arith import support_ceiling, support_floor
from .ids import change_id, entity_columns, entity_id, key_of_change, seeded_digest, template_of_change, type_letter
from .numbering import dense_index, global_rank
from .spread import HEAVY_CHUNK, HEAVY_SHARE, join_heavy, lookup
from .text import NULL_MARKS, json_text_is_null, json_text_to_string, sanitize, string_is_null, strip_whitespace

__all__ = [
    "HEAVY_CHUNK",
    "HEAVY_SHARE",
    "NULL_MARKS",
    "change_id",
    "dense_index",
    "entity_columns",
    "entity_id",
    "global_rank",
    "join_heavy",
    "json_text_is_null",
    "json_text_to_string",
    "key_of_change",
    "lookup",
    "sanitize",
    "seeded_digest",
    "string_is_null",
    "strip_whitespace",
    "support_ceiling",
    "support_floor",
    "template_of_change",
    "type_letter",
]
