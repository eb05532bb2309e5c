"""Schemas of the tables that jobs exchange."""

LEDGER = (
    "row_id string, entity_id string, entity_name string, company_label string, metric_name string, related_entity_id string, num_value double, unit string, "
    "scale double, period_end string, doc_section string, source_chunk_id string, source_record_id string, text_nuance string, alignment_status string, confidence double"
)
BLOCKS = "id string, doc_id string, seq int, block_type string, content string, section_path array<string>"
PREDICTIONS = "model string, row_id long, pred int, valid boolean, confidence double"
