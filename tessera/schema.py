"""Schemas of the stored relations and fixed vocabularies."""

from __future__ import annotations

NODES = (
    "id string, node_type string, repo string, base_class string, summary string, start_line int, "
    "methods array<string>, events array<string>, api_paths array<string>, route_paths array<string>, error_types array<string>, classes array<string>"
)
EDGES = "src string, dst string, edge_type string, shared_usecases array<string>"
FILE_MAP = "id string, path string, line int"
FILES = "repo string, path string, content string, sha256 string"
HASHES = "path string, sha256 string"
VECTORS = "id string, file string, vec array<float>"

# Edge types, and those that flow and impact follow.
EDGE_TYPES = ("depends_on", "binds", "routes_to", "has_part", "similar_to")
FLOW_TYPES = ("routes_to", "depends_on")
WIDE_FLOW_TYPES = ("routes_to", "depends_on", "binds")
IMPACT_TYPES = ("depends_on", "binds", "has_part")
