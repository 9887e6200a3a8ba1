"""Domains and table schemas of the graph model."""

from __future__ import annotations

# The domains of the model.
NODE_KINDS = ("function", "method", "class", "module", "struct", "interface", "trait", "enum", "namespace", "contract", "state_variable", "library", "template", "schema", "table", "view", "procedure", "proxy", "binary_region")
TYPE_KINDS = ("class", "struct", "interface", "trait", "enum", "contract", "library", "template", "table", "view")
NODE_ORIGINS = ("source", "proxy", "binary", "synthetic")
EDGE_KINDS = ("calls", "references", "reads", "writes", "inherits", "contains", "imports", "implements", "resolves_to", "type_uses", "specializes", "corresponds_to")
CONFIDENCES = ("certain", "inferred", "uncertain")
ANNOTATION_KINDS = ("assumption", "precondition", "postcondition", "invariant", "blast_radius", "privilege_boundary", "taint_propagation", "finding", "audit_note")
ENTRYPOINT_KINDS = ("user_input", "api", "database", "file_system", "third_party")
TRUST_LEVELS = ("untrusted_external", "semi_trusted_external", "trusted_internal")
ASSET_VALUES = ("high", "medium", "low")
EXCEPTION_EVENTS = ("raise", "rethrow", "handler", "cleanup", "propagate", "terminate", "declares")
EVIDENCE_BASES = ("language", "declaration", "heuristic", "reference", "override")
EVIDENCE_BINDINGS = ("resolved", "unresolved", "ambiguous")

TYPE_PARAMETER = "struct<name:string,constraints:array<string>,default:string,variance:string>"
EVENT = "struct<kind:string,line:int,syntax:string,expression:string,types:array<string>,region:string,confidence:string>"

#: Attributes are canonical JSON text (sorted keys): maps and variants are no keys for grouping, joins or diffs.
SCHEMAS = {
    "nodes": f"node_seq long, id string, name string, kind string, origin string, language string, file_path string, start_line int, end_line int, start_col int, end_col int, cc int, parameters array<struct<name:string,type:string,default:string>>, return_type string, exception_types array<string>, type_parameters array<{TYPE_PARAMETER}>, exception_events array<{EVENT}>, docstring string, attrs string",
    "edges": "edge_seq long, src string, dst string, kind string, confidence string, file_path string, start_line int, attrs string",
    "type_refs": "node_id string, role int, ordinal int, path string, name string, module string",
    "annotations": "node_id string, seq long, kind string, description string, source string",
    "entrypoints": "node_id string, kind string, trust_level string, asset_value string, description string",
    "evidence": "evidence_id string, node_id string, basis string, rule string, file_path string, start_line int, source_id string, symbol string, binding string, details string",
    "subgraphs": "name string, node_id string",
    "dependencies": "seq long, name string",
    "source_files": "root string, path string, language string, status string, reason string",
    "diagnostics": "language string, file_path string, start_line int, kind string, message string",
    "binary_artifacts": "id string, name string, architecture string, sha256 string, path string, image_base decimal(20,0), format string",
    "binary_ranges": "artifact string, node_id string, start decimal(20,0), end decimal(20,0), rva decimal(20,0), file_offset decimal(20,0), section string",
    "binary_mappings": "artifact string, node_id string, start decimal(20,0), end decimal(20,0), rva decimal(20,0), file_offset decimal(20,0), source_path string, line int, col int, function string, inline_depth int",
}


def checked_kinds(kinds, domain=EDGE_KINDS) -> tuple[str, ...]:
    """The kinds as text; a ValueError names any outside the domain."""
    found = tuple(dict.fromkeys(kinds))
    if wrong := [k for k in found if k not in domain]:
        raise ValueError(f"unknown kinds: {wrong}; known are {list(domain)}")
    return found
