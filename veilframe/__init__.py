"""Find and pseudonymise sensitive values in texts and tables with Spark."""

from veilframe.functions.retention import NONE, STANDARD, Retention
from veilframe.operators.detect import detect, find, item_table, resplit
from veilframe.operators.redact import mapping_per_document, mapping_shared, merge_mappings, redact
from veilframe.operators.restore import missing_codes, restore, restore_report
from veilframe.operators.rules import BUILTIN_RULES, Rule, builtin_rules, custom_rule, rules_from_table, rules_table
from veilframe.operators.tables import redact_table
from veilframe.plans.pipelines import deidentify, deidentify_shared, deidentify_with_mapping

__all__ = [
    "BUILTIN_RULES", "NONE", "STANDARD", "Retention", "Rule", "builtin_rules", "custom_rule", "deidentify",
    "deidentify_shared", "deidentify_with_mapping", "detect", "find", "item_table", "mapping_per_document",
    "mapping_shared", "merge_mappings", "missing_codes", "redact", "redact_table", "resplit", "restore",
    "restore_report", "rules_from_table", "rules_table",
]
