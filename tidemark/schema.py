"""Schemas of the relations that stages hand on."""

from __future__ import annotations

FILES = "snapshot string, path string, module string, role string, content binary, blob_id string, mode string"
SYMBOLS = (
    "snapshot string, id string, kind string, module string, name string, path string, lineno int, container string, "
    "body_hash string, definition_hash string, docstring_hash string, annotation_hash string, imports array<string>, "
    "import_layout array<string>, statement_layout array<string>, line_ranges array<struct<start:int,end:int>>, "
    "defers_annotations boolean, decorated boolean"
)
EDGES = "snapshot string, source string, target string, kind string, detail string"
UNRESOLVED = "snapshot string, symbol string, kind string, name string, detail string"
EXTERNAL = "snapshot string, symbol string, module string"
ERRORS = "snapshot string, path string, message string"
TARGETS = "runner string, runner_id string, entry_symbol string, lifecycle_dependencies array<string>"
CASES = "run string, classname string, name string, outcome string, time double"
RECORDS = "store_id string, test_id string, flags int"

KINDS = ("module", "class", "function", "method", "variable")
EDGE_KINDS = ("references", "defined_in", "imports", "imports_name", "unresolved_name_match", "declared", "entry", "lifecycle")
MARKS = ("writes", "rebinds", "mutated_by", "registers")
CHANGE_KINDS = ("added", "deleted", "body_changed", "docstring_changed", "definition_changed", "annotations_changed", "dependencies_changed", "dependencies_added", "imports_added")

#: Impact modes, a lattice merged by max.
REGISTERED, CONTENT, BEHAVIOR, STRUCTURAL = 1, 2, 3, 4

#: Flags of a recorded test, merged by bit_or.
SUBPROCESS, UNSTABLE, TEXT, FAILED = 1, 2, 4, 8

#: Rule -> (conservative, needs recorded execution).
RULES = {
    "dependency": (False, False), "new_target": (False, False), "lifecycle_changed": (False, False), "entry_docstring_changed": (False, False),
    "declared_dependency": (False, False), "always_run": (False, False), "dynamic_reference": (True, False), "unresolved_name_match": (True, False),
    "entry_symbol_unresolved": (True, False), "lifecycle_dependency_unresolved": (True, False), "analysis_error": (True, False),
    "runner_dependency": (True, False), "unanalysed_file_changed": (True, False), "executed_changed": (False, True), "executed_reader": (False, True),
    "touched_file": (False, True), "changed_target": (False, True), "test_scope": (False, True), "collection_code": (False, True), "escalated": (False, True),
    "cython_caller": (False, True), "lookup_site": (True, True), "no_evidence": (True, True), "unstable": (True, True), "subprocess": (True, True),
    "text_code": (True, True), "pytest_hook_changed": (True, True), "unobserved_file_changed": (True, True), "unindexed_import": (True, True),
}
